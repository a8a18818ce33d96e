"""URL filter: host and path rules first, then a weighted vocabulary of strict and soft terms.

One Aho-Corasick automaton finds every term in ``host + path`` in one pass. A hit counts if it stands between
boundaries (start, end, or a character that is no ASCII letter or digit). Each distinct term counts once, with its
weight: a strict term weighs ``REJECT``, so one rejects; soft terms weigh less, and reject when their weights reach
``REJECT`` together, which takes several. A rule overrides the vocabulary: it fits its host and all subdomains if the
path starts with the rule's, and the longest rule that fits wins.

The vocabulary is a parameter: ``VOCABULARY`` is the one given here, ``load_vocabulary`` reads another from a text file
(a term and its weight on each line).

Defined cases: a null url, or one without ``://``, has an empty host and path, fits no rule and is allowed; an empty
table gives an empty result; repeated rows are each judged; other columns are ignored. The automaton and the rules
are parameters of a fixed size, not data.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import map_batches

#: (verdict, host, path)
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: The weight from which a url is rejected, which is that of a strict term.
REJECT = 6
#: Soft terms by weight; two of the heavier ones reject, or three of the light ones.
STRICT = (
    "porn", "porno", "xxx", "hentai", "escort", "escorts", "camgirl", "camgirls", "nsfw", "warez", "keygen", "viagra", "cialis", "malware", "phishing",
    "pornos", "sexshop", "putas", "follar", "ficken", "pute", "milf", "onlyfans", "camsex", "xvideos",
)
HEAVY_SOFT = (
    "sex", "nude", "nudes", "adult", "erotic", "casino", "poker", "betting", "jackpot", "torrent", "torrents", "cracked", "pills", "pharmacy", "payday", "replica",
    "erotik", "nackt", "wetten", "gluecksspiel", "apotheke", "raubkopie", "erotique", "nue", "paris-sportifs", "pharmacie", "desnuda", "apuestas", "farmacia", "pirata",
)
LIGHT_SOFT = (
    "dating", "slots", "crack", "serial", "cheap", "loan", "loans", "credit", "bitcoin", "forex", "giveaway", "free", "download", "discount", "bonus", "win", "winner", "hot", "singles", "diet",
    "gratis", "billig", "kredit", "gewinn", "rabatt", "gratuit", "rencontre", "pret", "gagner", "barato", "prestamo", "ganar", "citas", "descarga",
)
VOCABULARY: dict[str, int] = dict.fromkeys(LIGHT_SOFT, 2) | dict.fromkeys(HEAVY_SOFT, 4) | dict.fromkeys(STRICT, REJECT)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def load_vocabulary(path: str) -> dict[str, int]:
    """A vocabulary from a UTF-8 text file: a term and its weight on each line, separated by white space. Empty lines and
    those that start with # are left out; a term without a weight is strict, and of repeated terms the heaviest counts."""
    out: dict[str, int] = {}
    with open(path, encoding="utf-8") as lines:
        for line in lines:
            if parts := line.partition("#")[0].split():
                term = parts[0].translate(str.maketrans(UPPER, LOWER))
                out[term] = max(out.get(term, 0), int(parts[1]) if len(parts) > 1 else REJECT)
    return out


def automaton(vocabulary: Mapping[str, int]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for term, weight in vocabulary.items():
        found.add_word(term, (term, weight))
    found.make_automaton()
    return found


def term_hits(text: str, found: ahocorasick.Automaton) -> tuple[int, int, int]:
    """Distinct strict and soft terms that stand between boundaries in text, which is lower case, and what they weigh."""
    hits: dict[str, int] = {}
    if len(found):
        for end, (term, weight) in found.iter(text):
            start = end - len(term) + 1
            if (start == 0 or text[start - 1] not in _WORD) and (end + 1 == len(text) or text[end + 1] not in _WORD):
                hits[term] = weight
    strict = sum(w >= REJECT for w in hits.values())
    return strict, len(hits) - strict, sum(hits.values())


def url_filter(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, vocabulary: Mapping[str, int] | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, n_strict, n_soft, weight, one row for each row of pages."""
    vocabulary = VOCABULARY if vocabulary is None else vocabulary
    split = F.locate("://", F.col("url"))
    rest = F.when(split > 0, F.expr("substring(url, locate('://', url) + 3)")).otherwise(F.lit(""))
    parts = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(rest, F.lit("")).alias("rest"))
    parts = parts.select(
        "page_id",
        F.translate(F.regexp_extract("rest", r"^[^/?#]*", 0), UPPER, LOWER).alias("host"),
        F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1).alias("path"),
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, lower = automaton(vocabulary), str.maketrans(UPPER, LOWER)
        for batch in batches:
            hits = [term_hits(h + p.translate(lower), found) for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            columns = [*batch.columns, *(pa.array([x[k] for x in hits], pa.int32()) for k in range(3))]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "host", "path", "n_strict", "n_soft", "weight"])

    counted = map_batches(parts, count, "page_id long, host string, path string, n_strict int, n_soft int, weight int")
    rule = verdict = None
    for says, host, path in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule = F.when(fits, host + path) if rule is None else rule.when(fits, host + path)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    by_terms = F.when(F.col("weight") >= REJECT, "block").otherwise("allow")
    return counted.select(
        "page_id", "host", "path",
        (rule if rule is not None else F.lit(None).cast("string")).alias("rule"),
        (by_terms if verdict is None else verdict.otherwise(by_terms)).alias("verdict"),
        "n_strict", "n_soft", "weight",
    )
