"""Whitening of embeddings: pivoted Cholesky of the centred scatter, one-sided Jacobi on its factor.

Vectors are read as whole numbers x = floor(1024 c) + 100000, so counts and
sums are exact.  Tasks give n and the sums, then the scatter of the centred
vectors; partial results are merged band of rows by band of rows in two steps of GROUP
tasks, so what reaches the driver is one d x d table for each GROUP**2 tasks.

The scatter is factored as P' S P = R' R with the largest remaining diagonal
entry as the next pivot, until nothing above rounding remains (the rank).
Jacobi rotations make the columns of L = R' orthogonal; L J has columns whose
squared norms are the eigenvalues of S, and the normalised columns, put back
in the order of the dimensions, are its eigenvectors.  S itself is never
decomposed, so small eigenvalues keep their relative accuracy.
"""

from __future__ import annotations

import decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import AnalysisError
from .common import bounded_batches, packed

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
GROUP = 64
BAND = 1 << 16          # entries of the scatter in one record
LIMIT = float(1 << 40)  # of a scaled entry: larger ones leave no room for exact sums
SWEEPS = 60


def factor(scatter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(L, order): scatter[order][:, order] = L L', L lower trapezoidal [d, rank], by pivoted Cholesky."""
    d = len(scatter)
    rest, order = scatter.astype(np.float64).copy(), np.arange(d)
    low = np.zeros((d, d))
    least = d * np.finfo(float).eps * max(0.0, float(rest.diagonal().max(initial=0.0)))
    for k in range(d):
        j = k + int(np.argmax(rest.diagonal()[k:]))
        if rest[j, j] <= least:
            return low[:, :k], order
        for m in (rest, low):
            m[[k, j]] = m[[j, k]]
        rest[:, [k, j]] = rest[:, [j, k]]
        order[[k, j]] = order[[j, k]]
        low[k, k] = np.sqrt(rest[k, k])
        low[k + 1:, k] = rest[k + 1:, k] / low[k, k]
        rest[k + 1:, k + 1:] -= np.outer(low[k + 1:, k], low[k + 1:, k])
    return low, order


def rounds(n: int):
    """The pairs of n columns in rounds of disjoint pairs (a tournament); n is even."""
    ring = np.arange(n)
    for _ in range(n - 1):
        yield ring[: n // 2], ring[::-1][: n // 2]
        ring = np.concatenate([ring[:1], ring[-1:], ring[1:-1]])


def jacobi(low: np.ndarray) -> np.ndarray:
    """Columns of ``low`` rotated until they are orthogonal, largest norm first."""
    r = low.shape[1]
    a = np.concatenate([low, np.zeros((low.shape[0], r % 2))], axis=1)
    n, tiny = a.shape[1], np.finfo(float).eps * max(1.0, np.sqrt(len(low)))
    for _ in range(SWEEPS):
        turned = False
        for p, q in rounds(n) if n else ():
            x, y = a[:, p], a[:, q]
            alpha, beta, gamma = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            on = np.abs(gamma) > tiny * np.sqrt(alpha * beta)
            if not on.any():
                continue
            turned = True
            p, q, x, y = p[on], q[on], x[:, on], y[:, on]
            zeta = (beta[on] - alpha[on]) / (2 * gamma[on])
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1, zeta))
            c = 1 / np.hypot(1, t)
            s = c * t
            a[:, p], a[:, q] = c * x - s * y, s * x + c * y
        if not turned:
            break
    size = (a * a).sum(0)
    return a[:, np.argsort(-size, kind="stable")[:r]]


def principal(scatter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns) of a centred scatter; only those above rounding."""
    low, order = factor(scatter)
    turned = jacobi(low)
    norms = np.sqrt((turned * turned).sum(0))
    vectors = np.empty_like(turned)
    vectors[order] = turned / norms
    return norms ** 2, vectors


def _vectors(batch: pa.RecordBatch, at: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows whose vector takes part, scaled entries [row, dimension] as whole numbers)."""
    col = batch.column(at)
    size = np.where(np.asarray(col.is_valid()), col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0)
    flat = col.flatten()
    value = flat.fill_null(np.nan).to_numpy(zero_copy_only=False).astype(np.float64)
    if not len(value):
        return np.zeros(0, np.int64), np.zeros((0, 0), np.int64)
    start = np.cumsum(size) - size
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(value))])
    rows = np.flatnonzero((size > 0) & (bad[start + size] == bad[start]))
    if not len(rows):
        return rows, np.zeros((0, 0), np.int64)
    d = int(size[rows[0]])
    if (size[rows] != d).any():
        raise AnalysisError("vectors have different numbers of entries")
    scaled = np.floor(SCALE * value[start[rows][:, None] + np.arange(d)])
    if np.abs(scaled).max() > LIMIT:
        raise AnalysisError("vector entries are too large")
    return rows, scaled.astype(np.int64) + SHIFT


def _records(table: pa.Table) -> list[dict]:
    """Rows as dicts; arrays of doubles as numpy arrays."""
    lists = {c: table.column(c).combine_chunks() for c in table.column_names if pa.types.is_list(table.schema.field(c).type)
             and pa.types.is_floating(table.schema.field(c).type.value_type)}
    rows = table.drop_columns(list(lists)).to_pylist()
    return [{**r, **{c: v[i].values.to_numpy() for c, v in lists.items()}} for i, r in enumerate(rows)]


def _merged(parts: DataFrame, merge, kinds: str) -> list[dict]:
    """Records (_task, _band, ...) of each band merged by ``merge(list of dicts) -> dict`` in two steps of
    GROUP tasks; what is left (one record of a band for GROUP**2 tasks) is collected and merged."""
    names = [k.split()[0] for k in kinds.split(", ")]

    def group(table: pa.Table) -> pa.Table:
        rows = _records(table)
        out = merge(rows)
        return pa.Table.from_pylist([{"_task": rows[0]["_task"] // GROUP, "_band": rows[0]["_band"],
                                      **{k: out[k] for k in names}}], schema=table.schema)

    for _ in range(2):
        parts = parts.groupBy(F.floor(F.col("_task") / GROUP), "_band").applyInArrow(group, f"_task bigint, _band int, {kinds}")
    bands: dict[int, list] = {}
    for r in parts.collect():
        bands.setdefault(r["_band"], []).append(r.asDict())
    return [merge(bands[k]) for k in sorted(bands)]


def _tasks(vectors: DataFrame, run, kinds: str) -> DataFrame:
    """Records (_task, _band, ...) of each task that has vectors: ``run(iterator of [row, dimension]) -> list of dicts``."""
    names = [k.split()[0] for k in kinds.split(", ")]

    def task(batches):
        for k, got in enumerate(run(x for b in batches for rows, x in [_vectors(b, 0)] if len(rows))):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32())] + [pa.array([got[c]]) for c in names], ["_band", *names])

    return vectors.mapInArrow(task, f"_band int, {kinds}").withColumn("_task", F.spark_partition_id().cast("bigint")) \
        .select("_task", "_band", *names)


def _count(blocks):
    n, total = 0, None
    for x in blocks:
        s = [int(v) for v in x.sum(axis=0)]
        if total is not None and len(s) != len(total):
            raise AnalysisError("vectors have different numbers of entries")
        n, total = n + len(x), s if total is None else [a + b for a, b in zip(total, s)]
    return [{"n": n, "sums": [decimal.Decimal(v) for v in total]}] if n else []


def _add_counts(rows):
    if len({len(r["sums"]) for r in rows}) > 1:
        raise AnalysisError("vectors have different numbers of entries")
    return {"n": sum(r["n"] for r in rows), "sums": [sum(v) for v in zip(*[r["sums"] for r in rows])]}


class Fit:
    """n, exact sums, mean, eigenvalues of the covariance, components as columns, explained shares."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        whole = [divmod(s, n) for s in sums]
        self.near = np.array([a for a, _ in whole], np.int64)        # the mean is near + part
        self.part = np.array([b / n for _, b in whole])

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.near).astype(np.float64) - self.part

    def solve(self, scatter: np.ndarray, components: int) -> None:
        values, vectors = principal(scatter)
        k = min(components, len(values))
        values = values / self.n
        self.values, self.vectors = values[:k], vectors[:, :k]
        self.explained = values[:k] / (np.trace(scatter) / self.n) if k else values[:0]
        self.map = self.vectors / np.sqrt(self.values)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.map

    def deviations(self, x: np.ndarray) -> pa.Array:
        """Exact sums over the dimensions of (n x - sum)**2 = (n (x - near) - rest)**2, as decimals; null from 10**38 on."""
        rest = np.array([s - int(m) * self.n for s, m in zip(self.sums, self.near)], object)
        y = x - self.near
        most = int(np.abs(y).max(initial=0)) * self.n + self.n
        if most ** 2 * len(rest) < 1 << 63:
            z = y * self.n - rest.astype(np.int64)
            total = (z * z).sum(axis=1).tolist()
        elif most < 1 << 54 and len(rest) < 1 << 8:  # in two halves
            z = y * self.n - rest.astype(np.int64)
            high, low = z >> 27, z & ((1 << 27) - 1)
            sums = [(u * v).sum(axis=1).tolist() for u, v in ((high, high), (high, low), (low, low))]
            total = [(a << 54) + (b << 28) + c for a, b, c in zip(*sums)]
        else:
            z = y.astype(object) * self.n - rest
            total = (z * z).sum(axis=1).tolist()
        return pa.array([decimal.Decimal(v) if v < 10 ** 38 else None for v in total], pa.decimal128(38, 0))


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Fit | None:
    """``vectors`` has one column of arrays; None without any vector that takes part."""
    got = _merged(_tasks(vectors, _count, "n bigint, sums array<decimal(38,0)>"), _add_counts, "n bigint, sums array<decimal(38,0)>")
    if not got:
        return None
    model = Fit(got[0]["n"], [int(s) for s in got[0]["sums"]])
    data, d = packed(model), len(got[0]["sums"])
    band = max(1, BAND // d)  # rows of the scatter in one record

    def scatter(blocks):
        import pickle

        own, table = pickle.loads(data), None
        for x in blocks:
            y = own.centred(x)
            table = y.T @ y if table is None else table + y.T @ y
        return [{"scatter": table[a:a + band].ravel()} for a in range(0, d, band)] if table is not None else []

    def add(rows):
        return {"scatter": np.sum([r["scatter"] for r in rows], axis=0)}

    parts = _merged(_tasks(vectors, scatter, "scatter array<double>"), add, "scatter array<double>")
    model.solve(np.concatenate([r["scatter"] for r in parts]).reshape(d, d), components)
    return model


def identity_error(vectors: DataFrame, model: Fit) -> float:
    """Largest absolute entry of the whitened vectors' covariance (centred at their own mean) minus the identity."""
    k, data = len(model.values), packed(model)
    if not k:
        return 0.0

    def merge(rows):  # counts, means and centred products of two parts make those of both
        n, mean, table = 0, np.zeros(k), np.zeros((k, k))
        for r in rows:
            m, c = np.array(r["mean"]), np.array(r["products"]).reshape(k, k)
            gap, both = m - mean, n + r["n"]
            table += c + np.outer(gap, gap) * (n * r["n"] / both)
            mean, n = mean + gap * (r["n"] / both), both
        return {"n": n, "mean": mean.tolist(), "products": table.ravel().tolist()}

    def moments(blocks):
        import pickle

        own, rows = pickle.loads(data), []
        for x in blocks:
            z = own.whitened(x)
            m = z.mean(axis=0)
            rows = [merge([*rows, {"n": len(z), "mean": m.tolist(), "products": ((z - m).T @ (z - m)).ravel().tolist()}])]
        return rows

    kinds = "n bigint, mean array<double>, products array<double>"
    total = _merged(_tasks(vectors, moments, kinds), merge, kinds)[0]
    return float(np.abs(np.array(total["products"]).reshape(k, k) / total["n"] - np.eye(k)).max())


def whiten(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error: a row for each vector and component.

    Vectors that are null, empty or hold null or non-finite entries take no part.  Components are those
    with an eigenvalue above rounding (at most the rank), at most ``components``; without spread (one
    vector, equal vectors) there are none and the result is empty, as for an empty table.  Null and
    repeated ids pass through; equal vectors get equal values; other columns are ignored.  Vectors of
    different lengths, or entries beyond 2**30, end the job with an error.  ``deviation`` is a
    decimal(38,0), null where that is too small.  The fit is done when this is called.
    """
    spark = table.sparkSession
    bounded_batches(spark)
    vectors = table.select(F.col(f"`{vector_col}`").alias("_v"))
    model = fit(vectors, components)
    key = table.schema[id_col].dataType.simpleString()
    schema = f"vec_id {key}, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if model is None or not len(model.values):
        return table.select(F.col(f"`{id_col}`").alias("vec_id")).limit(0).select("vec_id", *[
            F.lit(None).cast(k).alias(c) for c, k in (x.split() for x in schema.split(", ")[1:])])
    error, data = identity_error(vectors, model), packed(model)

    def run(batches):
        import pickle

        own = pickle.loads(data)
        k = len(own.values)
        for b in batches:
            rows, x = _vectors(b, 1)
            if not len(rows):
                continue
            each = pa.array(np.repeat(np.arange(len(rows)), k))
            m = len(rows) * k
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(rows)).take(each), pa.array(np.tile(np.arange(1, k + 1), len(rows)), pa.int32()),
                 pa.array(np.full(m, own.n), pa.int64()), own.deviations(x).take(each), pa.array(own.whitened(x).ravel()),
                 pa.array(np.tile(own.explained, len(rows))), pa.array(np.full(m, error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return table.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{vector_col}`").alias("_v")).mapInArrow(run, schema)
