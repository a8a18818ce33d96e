"""Whitening of embeddings by an exact integer scatter.

Each entry c of a vector becomes the integer ``floor(64 c) + OFFSET``. A shift (that same offset) is subtracted, which
changes no scatter; vectors then are small integers and move as bytes of the least width. Over the distinct vectors, sums and
cross-products are accumulated without any rounding: in blocks through floating-point products that are exact, because
their operands are cut into limbs of 20 bits, and beyond as integers of arbitrary precision. From these n·XᵀX - SSᵀ is
formed exactly, and only then it is divided by n², converted to floating point and decomposed by eigh. Partial sums of tasks
are added row by row of the matrix, so neither the driver nor a task sees more than a vector's square.

``identity_error`` is measured, not derived: the whitened fit list is read again and its covariance taken.

Defined cases: a vector that is null or holds a null or non-finite entry has no row; vectors of different lengths are spaces
of their own, each with its own fit; an empty vector has no components and so no row; entries beyond the range of a long
count as its ends; a component without variance (under ``LEAST`` of the largest, as in a table of equal vectors) has whitened
values of 0 and takes no part in identity_error; a deviation of over 38 digits is null; a null vec_id stays null; repeated rows each get
theirs, while the fit list has a vector once; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import Scratch, map_batches

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
#: Share of the largest eigenvalue under which a component has no variance in double precision.
LEAST = 1e-13
_LIMB = 20
_INT64 = 1 << 62


def packed(values: np.ndarray) -> bytes:
    """Integers in the least width that holds them, so that equal vectors are equal bytes; the width comes first."""
    most = int(max(values.max(initial=0), -(values.min(initial=0) + 1)))
    width = next(w for w in (1, 2, 4, 8) if most < 1 << (8 * w - 1))
    return bytes([width]) + values.astype(f"<i{width}").tobytes()


def unpacked(keys: list[bytes], dim: int) -> np.ndarray:
    """The vectors of packed keys as a matrix of 64-bit integers."""
    out = np.empty((len(keys), dim), np.int64)
    widths = np.fromiter((k[0] for k in keys), np.int8, len(keys))
    for width in set(widths.tolist()):
        at = np.flatnonzero(widths == width)
        out[at] = np.frombuffer(b"".join([keys[i][1:] for i in at.tolist()]), f"<i{width}").reshape(len(at), dim)
    return out


def quantised(entries: np.ndarray) -> np.ndarray:
    """floor(64 c), as 64-bit integers: x without its offset, which is the shift."""
    scaled = np.floor(entries * SCALE)
    inside = np.clip(scaled, -float(1 << 62), float(1 << 62))
    return inside.astype(np.int64)


def vectors(rows: DataFrame) -> DataFrame:
    """vec_id, dim, key of the rows whose vector is whole and finite."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            lists = column.filter(column.is_valid())
            ids = ids.filter(column.is_valid())
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten()
            ends = np.cumsum(sizes)
            with np.errstate(over="ignore"):
                entries = flat.fill_null(float("nan")).to_numpy(zero_copy_only=False)
            bad = np.concatenate(([0], np.cumsum(~np.isfinite(entries))))
            ok = (bad[ends] == bad[ends - sizes]) & (sizes > 0)
            keep = np.flatnonzero(ok)
            with np.errstate(invalid="ignore", over="ignore"):
                ints = quantised(np.where(np.isfinite(entries), entries, 0.0))
            keys = [packed(ints[ends[i] - sizes[i] : ends[i]]) for i in keep.tolist()]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(keep)), pa.array(sizes[keep], pa.int32()), pa.array(keys, pa.binary())], ["vec_id", "dim", "key"])

    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return map_batches(rows, run, "vec_id long, dim int, key binary")


def _by_dim(batch: pa.RecordBatch, dim: str, key: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each length in a batch, its rows and their vectors."""
    dims = batch.column(dim).to_numpy()
    keys = batch.column(key).to_pylist()
    for d in np.unique(dims).tolist():
        at = np.flatnonzero(dims == d)
        yield d, at, unpacked([keys[i] for i in at.tolist()], d)


class Scatter:
    """Exact sums and cross-products of integer vectors."""

    def __init__(self, dim: int):
        self.n = 0
        self.sums = np.zeros(dim, object)
        self.cross = np.zeros((dim, dim), object)
        self._open: dict[int, np.ndarray] = {}
        self._added = 0

    def add(self, x: np.ndarray) -> None:
        for start in range(0, len(x), 4096):  # 2^12 products of 2^40 are exact in a double
            self._block(x[start : start + 4096])

    def _block(self, x: np.ndarray) -> None:
        self.n += len(x)
        sign, size = np.sign(x), np.abs(x)
        limbs = []
        while not limbs or size.any():
            limbs.append((sign * (size & ((1 << _LIMB) - 1))).astype(np.float64))
            size = size >> _LIMB
        for i, a in enumerate(limbs):
            self.sums += a.sum(0).astype(np.int64).astype(object) << (_LIMB * i)
            for j, b in enumerate(limbs):
                self._open[i + j] = self._open.get(i + j, 0) + (a.T @ b).astype(np.int64)
        self._added += len(limbs)
        if self._added >= 256:  # of 2^52 each at most
            self.settle()

    def settle(self) -> None:
        for place, values in self._open.items():
            self.cross += values.astype(object) << (_LIMB * place)
        self._open, self._added = {}, 0


def _scatters(fit: DataFrame) -> DataFrame:
    """dim, i, n, s, cross: for each task and row i of the matrix its sum and cross-products, as decimal text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Scatter] = {}
        for batch in batches:
            for d, _, x in _by_dim(batch, "dim", "key"):
                held.setdefault(d, Scatter(d)).add(x)
        for d, scatter in held.items():
            scatter.settle()
            for i in range(d):
                yield pa.RecordBatch.from_pydict({"dim": pa.array([d], pa.int32()), "i": pa.array([i], pa.int32()), "n": pa.array([scatter.n], pa.int64()), "s": [str(scatter.sums[i])], "cross": pa.array([[str(v) for v in scatter.cross[i]]], pa.list_(pa.string()))})

    return map_batches(fit, run, "dim int, i int, n long, s string, cross array<string>")


def _added(rows: pd.DataFrame) -> pd.DataFrame:
    cross = [0] * len(rows["cross"].iloc[0])
    for values in rows["cross"]:
        cross = [a + int(b) for a, b in zip(cross, values, strict=True)]
    return pd.DataFrame({"dim": [rows["dim"].iloc[0]], "i": [rows["i"].iloc[0]], "n": [rows["n"].sum()], "s": [str(sum(map(int, rows["s"])))], "cross": [[str(v) for v in cross]]})


def scatter_rows(fit: DataFrame) -> DataFrame:
    """The exact scatter of each length, a row for each row i of its matrix: dim, i, n, s, cross (shift subtracted)."""
    return _scatters(fit).groupBy("dim", "i").applyInPandas(_added, "dim int, i int, n long, s string, cross array<string>")


def model_of(n: int, sums: list[int], cross: list[list[int]], components: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Directions that whiten (a row for each component), their eigenvalues and shares of the trace."""
    exact = [[n * c - a * b for c, b in zip(row, sums, strict=True)] for a, row in zip(sums, cross, strict=True)]
    covariance = np.array([[v / (n * n) for v in row] for row in exact])  # a division of integers is rounded once
    values, directions = np.linalg.eigh(covariance)
    top = np.argsort(-values, kind="stable")[:components]
    values, directions = values[top], directions[:, top].T
    signs = np.sign(directions[np.arange(len(top)), np.abs(directions).argmax(1)])
    trace = sum(exact[i][i] for i in range(len(exact))) / (n * n)
    alive = values > LEAST * max(values.max(initial=0.0), 0.0)
    scale = np.where(alive, 1 / np.sqrt(np.where(alive, values, 1.0)), 0.0)
    return directions * signs[:, None] * scale[:, None], values, values / trace if trace else np.zeros(len(values))


def _models(scatter: DataFrame, components: int) -> DataFrame:
    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("i")
        n, sums = int(rows["n"].iloc[0]), [int(s) for s in rows["s"]]
        whitener, _, shares = model_of(n, sums, [[int(v) for v in r] for r in rows["cross"]], components)
        return pd.DataFrame({"dim": [len(rows)], "n": [n], "sums": [[str(s) for s in sums]], "whitener": [whitener.ravel().tolist()], "explained": [shares.tolist()]})

    return scatter.groupBy("dim").applyInPandas(one, "dim int, n long, sums array<string>, whitener array<double>, explained array<double>")


class Model:
    """What whitens the vectors of one length; it holds components times length numbers."""

    def __init__(self, n: int, sums: list[str], whitener: list[float], explained: list[float]):
        self.n, self.sums = n, [int(s) for s in sums]
        self.whitener = np.array(whitener).reshape(-1, len(sums))
        self.explained = np.array(explained)

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact: 64-bit where that holds it, else Python integers."""
        most = max(map(abs, self.sums), default=0) + self.n * (int(np.abs(x).max(initial=0)) + 1)
        if most < _INT64:
            return x * np.int64(self.n) - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def whitened(self, deviation: np.ndarray) -> np.ndarray:
        return (deviation / self.n).astype(np.float64) @ self.whitener.T


def squares(deviation: np.ndarray) -> list[int]:
    """The sum of squares of each row, exact."""
    if deviation.dtype == object:
        return (deviation * deviation).sum(1).tolist()
    most = int(np.abs(deviation).max(initial=0))
    if most * most * deviation.shape[1] < _INT64:
        return (deviation * deviation).sum(1).tolist()
    high, low = deviation >> 31, deviation & ((1 << 31) - 1)  # below 2^31 each, so sums of products hold up to 2 entries
    parts = [(a.astype(object) * b).sum(1) for a, b in ((high, high), (high, low), (low, low))]
    return [(int(a) << 62) + (int(b) << 32) + int(c) for a, b, c in zip(*parts, strict=True)]


def _whitened_moments(fit: DataFrame, models: dict[int, Model]) -> dict[int, float]:
    """For each length the largest difference of the whitened fit list's covariance from the identity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for d, _, x in _by_dim(batch, "dim", "key"):
                z = models[d].whitened(models[d].deviations(x))
                s = held.setdefault(d, [0, 0.0, 0.0])
                s[0], s[1], s[2] = s[0] + len(z), s[1] + z.sum(0), s[2] + z.T @ z
        for d, (n, z, zz) in held.items():
            yield pa.RecordBatch.from_pydict({"dim": pa.array([d], pa.int32()), "n": pa.array([n], pa.int64()), "z": pa.array([z.tolist()], pa.list_(pa.float64())), "zz": pa.array([zz.ravel().tolist()], pa.list_(pa.float64()))})

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        dim, n = int(rows["dim"].iloc[0]), int(rows["n"].sum())
        mean = np.sum([np.asarray(v) for v in rows["z"]], 0) / n
        covariance = np.sum([np.asarray(v) for v in rows["zz"]], 0).reshape(len(mean), -1) / n - np.outer(mean, mean)
        alive = np.flatnonzero(np.abs(models[dim].whitener).sum(1))
        error = np.abs(covariance - np.eye(len(mean)))[np.ix_(alive, alive)].max(initial=0.0)
        return pd.DataFrame({"dim": [dim], "error": [float(error)]})

    moments = map_batches(fit, run, "dim int, n long, z array<double>, zz array<double>")
    return {r["dim"]: r["error"] for r in moments.groupBy("dim").applyInPandas(one, "dim int, error double").collect()}  # a row for each length


def whiten(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation decimal(38,0), whitened, explained, identity_error, for each row and component."""
    scratch = Scratch(rows.sparkSession)
    known = scratch.keep("vectors", vectors(rows))
    fit = scratch.keep("fit", known.select("dim", "key").distinct())
    fitted = _models(scratch.keep("scatter", scatter_rows(fit)), components).collect()  # a row for each length
    models = {r["dim"]: Model(r["n"], r["sums"], r["whitener"], r["explained"]) for r in fitted}
    errors = _whitened_moments(fit, models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, at, x in _by_dim(batch, "dim", "key"):
                model = models[d]
                deviation = model.deviations(x)
                total, z = squares(deviation), model.whitened(deviation)
                if all(-_INT64 < t < _INT64 for t in total):
                    sums = pa.array(total, pa.int64()).cast(pa.decimal128(38, 0))
                else:
                    sums = pa.array([str(t) if t < 10**38 else None for t in total], pa.string()).cast(pa.decimal128(38, 0))
                k = z.shape[1]
                each = pa.array(np.repeat(np.arange(len(at)), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(at)).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))), pa.array(np.full(len(at) * k, model.n)),
                        sums.take(each), pa.array(z.ravel()), pa.array(np.tile(model.explained, len(at))), pa.array(np.full(len(at) * k, errors[d])),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return map_batches(known, run, "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
