"""Secret scan: fixed patterns, and a battery of randomness tests for what they miss.

The patterns (assignment of a credential, access key id, hex string) give the base spans. Every other run of
``MIN_RUN`` or more characters of an encoding's alphabet is a candidate, also after an equals sign; a run that mixes the
signs of base64 and base64url is cut at them. Its encoding is inferred from its characters, and three tests hold it against uniform random symbols of that encoding: chi-squared uniformity of the alphabet, runs
above and below the middle, and lag-1 serial correlation. Their p-values are combined (Fisher). A random string has
uniform p-values, while words, paths and identifiers pile up near zero.

The false-discovery control is aware of length, as the tests have little power on short strings: within each stratum of
encoding and length class, the p-values of the whole corpus give the share of random strings (Storey: twice the
candidates above 1/2, which others hardly reach), and with it for each cut the estimated share of non-random
strings among those above. A stratum's cut is the lowest with a share of at most ``FDR``. A stratum with fewer than
``LEAST`` candidates above 1/2 says too little of itself: it is judged together with the nearest lengths of its encoding
until they have as many, and where the whole encoding has not, by a fixed cut (``PRIOR``, for short and long strings), so
a lone strong candidate is decided as well. The histogram of all candidates has a fixed number of cells, and it is all
that the driver sees.

Texts are read once; what is kept of them is spans. Defined cases: null text is empty and has no spans; repeated rows
are each scanned (and count each in the histogram); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import Scratch, back_id, map_batches, texts

KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
_KEYWORDS = (b"passw", b"secret", b"token", b"api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
#: Shortest candidate, and share of non-random strings among the spans that the battery adds.
MIN_RUN, FDR = 20, 0.05
#: Cells of a stratum's histogram, and candidates above 1/2 of a stratum that is judged by itself.
CELLS, LEAST = 100, 5
#: The cut where an encoding has too few: that of strings shorter than ``LONG`` characters, and that of others.
PRIOR, LONG = (0.5, 0.05), 64
_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}")
_PIECE = re.compile(r"[A-Za-z0-9]{20,}={0,2}")
#: Symbols of each encoding in order of value (fixed values).
_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ENCODINGS = {
    "hex": _DIGITS + "ABCDEF",
    "base32": _UPPER + "234567",
    "base36": _DIGITS + _LOWER,
    "base62": _UPPER + _LOWER + _DIGITS,
    "base64": _UPPER + _LOWER + _DIGITS + "+/",
    "base64url": _UPPER + _LOWER + _DIGITS + "-_",
}
_VALUES = {name: {c: i for i, c in enumerate(symbols)} for name, symbols in ENCODINGS.items()}
_SETS = {name: frozenset(symbols) for name, symbols in ENCODINGS.items()}


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, by start, then kind."""
    out = []
    low = text.encode().lower()
    if any(k in low for k in _KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def infer_encoding(run: str) -> str | None:
    """The smallest encoding whose alphabet holds the run; none for words, numbers and names without digits."""
    used = set(run.rstrip("="))
    if used.isdisjoint(_DIGITS) or not any(c.isalpha() for c in used):
        return None
    if used <= _SETS["hex"]:
        return "hex"
    return next((name for name in list(ENCODINGS)[1:] if used <= _SETS[name]), None)


def _normal_tail(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _chi_tail(x: float, df: int) -> float:
    """Upper tail of chi-squared, by Wilson and Hilferty."""
    if x <= 0:
        return 1.0
    z = ((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    return 0.5 * math.erfc(z / math.sqrt(2))


def randomness(run: str, encoding: str) -> float:
    """Combined p-value of the battery under uniform random symbols."""
    values = [_VALUES[encoding][c] for c in run.rstrip("=")]
    n, size = len(values), len(ENCODINGS[encoding])
    cells = max(2, min(size, n // 5))
    expected = [n * ((b + 1) * size // cells - b * size // cells) / size for b in range(cells)]
    counts = Counter(next(b for b in range(cells) if v < (b + 1) * size // cells) for v in values)
    uniform = _chi_tail(sum((counts[b] - e) ** 2 / e for b, e in enumerate(expected)), cells - 1)
    high = [2 * v >= size for v in values]
    ups = sum(high)
    if 0 < ups < n:
        runs, mean = 1 + sum(a != b for a, b in zip(high, high[1:], strict=False)), 2 * ups * (n - ups) / n + 1
        runs_p = _normal_tail((runs - mean) / math.sqrt(max((mean - 1) * (mean - 2) / (n - 1), 1e-9)))
    else:
        runs_p = 0.5 ** (n - 1)
    centre = sum(values) / n
    spread = sum((v - centre) ** 2 for v in values)
    serial = sum((a - centre) * (b - centre) for a, b in zip(values, values[1:], strict=False)) / spread if spread else 1.0
    serial_p = _normal_tail(serial * math.sqrt(n))
    return _chi_tail(-2 * sum(math.log(max(p, 1e-12)) for p in (uniform, runs_p, serial_p)), 6)


def length_class(n: int) -> int:
    """Half powers of two: 20-22, 23-31, 32-45, 46-63, ..."""
    return int(2 * math.log2(n))


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, str, int, float]]:
    """(start, end, encoding, length class, p) of runs that no base span touches. taken is sorted by start, so the spans
    that reach past the runs so far are passed once."""
    out, k, reach = [], 0, 0
    for m in _RUN.finditer(text):
        mixed = infer_encoding(m[0]) is None and not set(m[0]).isdisjoint("+/") and not set(m[0]).isdisjoint("_-")
        for start, end in [x.span() for x in _PIECE.finditer(text, *m.span())] if mixed else [m.span()]:
            run = text[start:end]
            while k < len(taken) and taken[k][0] < end:
                reach = max(reach, taken[k][2])
                k += 1
            if reach <= start and (encoding := infer_encoding(run)):
                out.append((start, end, encoding, length_class(end - start), randomness(run, encoding)))
    return out


def span_string(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


SPANS = "array<struct<start:int,kind:int,end:int>>"
CANDIDATES = "array<struct<start:int,end:int,encoding:string,length_class:int,p:double>>"


def _scan(docs: DataFrame) -> DataFrame:
    schema = f"doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, base {SPANS}, found {CANDIDATES}"
    span = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
    candidate = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("encoding", pa.string()), ("length_class", pa.int32()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base = [base_spans(t) for t in batch.column(1).to_pylist()]
            found = [candidates(t, b) for t, b in zip(batch.column(1).to_pylist(), base, strict=True)]
            count = lambda k: pa.array([sum(x[1] == k for x in b) for b in base], pa.int64())  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), count(0), count(1), count(2),
                    pa.array([hashlib.sha256(span_string(b).encode()).hexdigest() for b in base], pa.string()),
                    pa.array([[dict(zip(("start", "kind", "end"), x, strict=True)) for x in b] for b in base], span),
                    pa.array([[dict(zip(("start", "end", "encoding", "length_class", "p"), x, strict=True)) for x in f] for f in found], candidate),
                ],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "base", "found"],
            )

    return map_batches(texts(docs), run, schema)


def cut(cells: list[int], fdr: float = FDR) -> float | None:
    """The lowest p from which on at most fdr of a stratum's candidates are estimated not to be random."""
    n, random = len(cells), 2 * sum(cells[len(cells) // 2 :])
    for i in range(n // 2 + 1):
        above = sum(cells[i:])
        if above and max(0.0, above - random * (1 - i / n)) <= fdr * above:
            return i / n
    return None


def cuts(strata: dict[tuple[str, int], list[int]], fdr: float = FDR) -> dict[tuple[str, int], float]:
    """The cut of each stratum (encoding, length class). Sparse ones are judged with the nearest lengths of their encoding,
    and by the fixed cut where that has too few candidates of any length."""
    half = lambda cells: sum(cells[len(cells) // 2 :])
    out: dict[tuple[str, int], float] = {}
    for encoding, size in strata:
        near = sorted((k for k in strata if k[0] == encoding), key=lambda k: (abs(k[1] - size), k[1]))
        pooled = [0] * len(strata[encoding, size])
        for k in near:
            pooled = [a + b for a, b in zip(pooled, strata[k], strict=True)]
            if half(pooled) >= LEAST:
                break
        found = cut(pooled, fdr) if half(pooled) >= LEAST else PRIOR[size >= length_class(LONG)]
        if found is not None:
            out[encoding, size] = found
    return out


def scan_secrets(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random, one row for each row of docs."""
    found = Scratch(docs.sparkSession).keep("spans", _scan(docs))
    cell = F.least(F.lit(CELLS - 1), F.floor(F.col("c.p") * CELLS)).cast("int")
    counts = found.select(F.explode("found").alias("c")).groupBy(F.col("c.encoding").alias("encoding"), F.col("c.length_class").alias("length_class"), cell.alias("cell")).count()
    strata: dict[tuple[str, int], list[int]] = {}
    for row in counts.collect():
        strata.setdefault((row["encoding"], row["length_class"]), [0] * CELLS)[row["cell"]] = row["count"]
    least_of = cuts(strata, fdr)

    def passes(c):
        ok = F.lit(False)
        for (encoding, size), least in sorted(least_of.items()):
            ok = ok | ((c["encoding"] == encoding) & (c["length_class"] == size) & (c["p"] >= least))
        return ok

    added = F.transform(F.filter("found", passes), lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end")))
    names = F.array(*map(F.lit, KINDS))
    spans = F.array_sort(F.concat("base", added.cast(SPANS)))
    text = F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select(back_id(), "n_assign", "n_access", "n_hex", "base_sha256", text.alias("spans"), F.size(added).cast("long").alias("n_random"))
