"""Approximate nearest neighbours with learned partitions.

Index: on a bounded sample the graph of nearest neighbours is cut into
balanced parts (recursive bisection by the Fiedler order of the graph, at the
median), and a small classifier is trained to tell a vector's part from its
coordinates, with each sample point's target spread over the parts of its
neighbours.  Every row is indexed under its most probable part.

Search: the classifier routes a query to its most probable parts, and all
rows of these are ranked by the exact measure.  The number of probed parts is
the smallest that finds ``TARGET`` of the true k neighbours, among all rows, of
``HELD`` sampled queries that neither graph nor router has seen; it may be all
parts.  A query whose parts hold fewer than k rows besides its own is routed to
further ones until they hold as many.

Parts are cut into blocks of at most about ``BLOCK_ROWS`` rows and queries
into groups of at most about ``BLOCK_QUERIES``, so a part that holds a third
of all rows is spread over many tasks.  A query is ranked in its most probable
parts first (an eighth of those it probes); the others give only rows that
reach the k-th score found there, and at most k a block.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, lowest, packed, stored, unpacked

SAMPLE = 4096
ROWS_A_PART = 400      # of the sample's rows at least LEAST_PART fall into each part
LEAST_PART = 64
NEIGHBOURS = 20
HELD = 512             # of the sample's rows are queries that calibrate the number of probes (at most a fifth)
TARGET = 0.97
BLOCK_ROWS, BLOCK_QUERIES = 8192, 4096


def valid_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, vec: rows with an id and a vector that is not null, empty, zero, nor holds a null or non-finite component."""
    v = F.col("vec")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return (df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("vec"))
            .filter(F.col("id").isNotNull() & v.isNotNull())
            .filter(F.forall(v, finite) & F.exists(v, lambda x: x != 0)))


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length, none null, as the rows of a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def inner_products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row-wise inner products in double precision, each summed in the same order whatever its place."""
    return np.einsum("ij,ij->i", q, x)


def neighbour_lists(q: np.ndarray, x: np.ndarray, k: int, own: np.ndarray | None = None) -> np.ndarray:
    """Positions of the k rows of x with the largest inner product for each row of q (own: row to leave out)."""
    k = min(k, len(x) - (own is not None))
    out = np.empty((len(q), k), np.int64)
    for a in range(0, len(q), 512):
        s = q[a:a + 512] @ x.T
        if own is not None:
            s[np.arange(len(s)), own[a:a + 512]] = -np.inf
        out[a:a + 512] = np.argpartition(-s, max(k - 1, 0), axis=1)[:, :k]
    return out


def balanced_parts(near: np.ndarray, parts: int, rounds: int = 60) -> np.ndarray:
    """Cut the graph of ``near`` (neighbour lists) into parts of equal size (parts: a power of two)."""
    n, k = near.shape
    a, b = np.repeat(np.arange(n), k), near.ravel()
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    label = np.zeros(n, np.int64)
    step = 1
    r = np.random.default_rng(5)
    while step < parts:
        new = label * 2
        for p in range(step):
            own = np.flatnonzero(label == p)
            where = np.full(n, -1)
            where[own] = np.arange(len(own))
            inside = (where[a] >= 0) & (where[b] >= 0)
            i, j = where[a[inside]], where[b[inside]]
            root = np.sqrt(np.bincount(i, minlength=len(own)) + 1.0)
            flat = root / np.linalg.norm(root)
            # power iteration for the second eigenvector of the normalised adjacency (plus identity)
            x = r.normal(size=len(own))
            for _ in range(rounds):
                x -= flat * (flat @ x)
                y = x / root
                x = x + (np.bincount(i, y[j], len(own)) + y) / root
                x /= np.linalg.norm(x) or 1.0
            new[own[np.argsort(x / root, kind="stable")[len(own) // 2:]]] += 1
        label, step = new, step * 2
    return label


class Router:
    """One hidden layer from a vector to the probabilities of the parts."""

    def __init__(self, dim: int, parts: int, hidden: int = 128, seed: int = 3):
        r = np.random.default_rng(seed)
        self.parts = parts
        self.p = {"w": r.normal(0, dim ** -0.5, (dim, hidden)), "b": np.zeros(hidden),
                  "v": r.normal(0, hidden ** -0.5, (hidden, parts)), "c": np.zeros(parts)}
        self.scale = 1.0

    def fit(self, x: np.ndarray, target: np.ndarray, epochs: int = 60, rate: float = 0.005, seed: int = 4) -> None:
        self.scale = 1 / (np.sqrt((x ** 2).mean()) or 1.0)
        r, state, t = np.random.default_rng(seed), {k: (0.0, 0.0) for k in self.p}, 0
        for _ in range(epochs):
            order = r.permutation(len(x))
            for a in range(0, len(x), 128):
                i = order[a:a + 128]
                z = x[i] * self.scale
                h = np.maximum(z @ self.p["w"] + self.p["b"], 0)
                d = (_softmax(h @ self.p["v"] + self.p["c"]) - target[i]) / len(i)
                dh = (d @ self.p["v"].T) * (h > 0)
                grads = {"w": z.T @ dh, "b": dh.sum(0), "v": h.T @ d, "c": d.sum(0)}
                t += 1
                for k, g in grads.items():
                    m, v = state[k]
                    m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
                    state[k] = (m, v)
                    self.p[k] = self.p[k] - rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum((x * self.scale) @ self.p["w"] + self.p["b"], 0)
        return _softmax(h @ self.p["v"] + self.p["c"])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def learn(sample: np.ndarray, rows: int) -> Router:
    """Router fitted on a sample of ``rows`` rows in all."""
    dim = sample.shape[1] if sample.ndim == 2 else 1
    parts = 1
    while parts * 2 * ROWS_A_PART <= rows and parts * 2 * LEAST_PART <= len(sample):
        parts *= 2
    router = Router(dim, parts)
    if parts == 1:
        return router
    own = np.arange(len(sample))
    near = neighbour_lists(sample, sample, NEIGHBOURS, own)
    label = balanced_parts(near, parts)
    target = np.zeros((len(sample), parts))
    target[own, label] = 0.5
    for j in range(near.shape[1]):
        target[own, label[near[:, j]]] += 0.5 / near.shape[1]
    router.fit(sample, target)
    return router


def calibrate(rows: DataFrame, router: Router, ids: np.ndarray, vecs: np.ndarray, held: int, k: int) -> int:
    """Number of parts to probe: the last ``held`` of the sampled rows (ids, vecs) are queries, and the smallest number
    that finds ``TARGET`` of their k nearest among all rows is taken."""
    if router.parts == 1 or not held:
        return router.parts
    asked, names = vecs[-held:], ids[-held:]
    s = asked @ vecs.T
    s[names[:, None] == ids[None, :]] = -np.inf
    n = min(k, s.shape[1])
    # k rows of the sample bound the k-th score from below: only better rows of the table are wanted besides them
    slack = 1e-9 * (1 + np.abs(s[np.isfinite(s)]).max(initial=0))
    bound = np.partition(s, s.shape[1] - n, axis=1)[:, s.shape[1] - n] + slack
    best = [(q, s[q, x], p) for p, x, q in _pairs(s, ~(s > bound[:, None]), router.probabilities(vecs).argmax(axis=1), k)]
    shared = rows.sparkSession.sparkContext.broadcast(packed((router, asked, names, bound)))  # fixed size

    def nearer(batches):
        r, q, own, least = unpacked(shared)
        for b in batches:
            if b.num_rows:
                x = matrix(b.column("vec"))
                t = q @ x.T
                t[own[:, None] == np.array(b.column("id").to_pylist())[None, :]] = -np.inf
                hit = list(_pairs(t, t > least[:, None], r.probabilities(x).argmax(axis=1), k))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i for _, _, i in hit], pa.int32()), pa.array([t[i, j] for _, j, i in hit], pa.float64()),
                     pa.array([p for p, _, _ in hit], pa.int32())], ["query", "score", "part"])

    down = Window.partitionBy("query").orderBy(F.desc("score"), "part")
    better = rows.mapInArrow(nearer, "query int, score double, part int").withColumn("place", F.row_number().over(down))
    best += [(r["query"], r["score"], r["part"]) for r in better.filter(F.col("place") <= k).collect()]  # HELD * k rows
    ranks = np.argsort(np.argsort(-router.probabilities(asked), axis=1, kind="stable"), axis=1)
    needed, taken = [], np.zeros(held, np.int64)
    for q, score, part in sorted(best, key=lambda x: -x[1]):
        if taken[q] < k and score > -np.inf:
            taken[q] += 1
            needed.append(ranks[q, part])
    needed.sort()
    return int(needed[min(len(needed), int(np.ceil(TARGET * len(needed)))) - 1]) + 1 if needed else router.parts


def _pairs(s: np.ndarray, some: np.ndarray, part: np.ndarray, k: int):
    """(part, row, query) of the k best at most of each query's ``some`` rows."""
    for q in np.flatnonzero(some.any(axis=1)):
        at = np.flatnonzero(some[q])
        if len(at) > k:
            at = at[np.argpartition(-s[q, at], k - 1)[:k]]
        yield from ((int(part[j]), int(j), int(q)) for j in at)


def _best(q: pd.DataFrame, x: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best rows of x for each row of q, of those with a score of at least q's ``least``."""
    out = [pd.DataFrame({"query_id": [], "vec_id": [], "score": []})]
    if not len(q) or not len(x):
        return out[0]
    qv, xv = np.stack(q["vec"].to_numpy()), np.stack(x["x_vec"].to_numpy())
    xi, qi, bound = x["x_id"].to_numpy(), q["id"].to_numpy(), q["least"].to_numpy(np.float64)
    s = qv @ xv.T
    s[qi[:, None] == xi[None, :]] = -np.inf
    slack = 1e-9 * (1 + np.abs(qv).max() * np.abs(xv).max() * qv.shape[1])
    for i in range(len(qi)):
        least = -np.inf if np.isnan(bound[i]) else bound[i] - slack
        if s.shape[1] > k:
            least = max(least, np.partition(s[i], len(xi) - k)[len(xi) - k] - slack)
        some = np.flatnonzero((s[i] >= least) & (s[i] > -np.inf))
        if len(some):
            exact = inner_products(np.broadcast_to(qv[i], (len(some), qv.shape[1])), xv[some])
            best = np.lexsort((xi[some], -exact))[:k]
            out.append(pd.DataFrame({"query_id": qi[i], "vec_id": xi[some][best], "score": exact[best]}))
    return pd.concat(out[1:]) if len(out) > 1 else out[0]


def _ranked(asked: DataFrame, index: DataFrame, load: DataFrame, k: int, key: str) -> DataFrame:
    """query_id, vec_id, score: the best rows of every block of each asked part (id, vec, part, least)."""
    groups = asked.groupBy("part").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("groups"))
    queries = asked.join(F.broadcast(groups), "part").join(F.broadcast(load), "part").select(  # one row a part
        "part", F.pmod(F.xxhash64("id"), F.col("groups")).cast("int").alias("grp"), "id", "vec", "least",
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    # every block of rows meets every group of queries that probe its part
    meets = index.join(F.broadcast(groups), "part").select(
        F.col("part").alias("x_part"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("x_grp"),
        F.col("block").alias("x_block"), F.col("id").alias("x_id"), F.col("vec").alias("x_vec"))

    def rank(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        return _best(q, x, k)

    return queries.groupBy("part", "grp", "block").cogroup(meets.groupBy("x_part", "x_grp", "x_block")).applyInPandas(
        rank, f"query_id {key}, vec_id {key}, score double")


def search(df: DataFrame, query_filter, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row where ``query_filter`` (a condition on ``id``) holds, the
    k nearest found among all rows with another id, by inner product in double precision; ties go to the smaller id.

    Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do
    rows without an id.  All vectors must have one length (others than the commonest are left out).
    Rows that repeat an id are separate candidates; queries that repeat an id count once (the
    first in the order of their components).  A query with fewer than k candidates in all gets all
    that its parts hold; an empty table gives an empty result.  Other columns are ignored.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    rows = valid_vectors(df, id_col, vec_col)
    sizes = rows.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n"), F.approx_count_distinct(F.xxhash64("id"), 0.02)
                                                       .alias("kinds")).orderBy(F.desc("n"), "d").limit(1).collect()
    key = df.schema[id_col].dataType.simpleString()
    if not sizes:
        return spark.createDataFrame([], f"query_id {key}, rank int, vec_id {key}, score double")
    dim, total = sizes[0]["d"], sizes[0]["n"]
    rows = rows.filter(F.size("vec") == dim)
    # rows that repeat an id are merged in each task
    few = rows.select(F.xxhash64("id").alias("h"), "id", "vec").filter(lowest(F.col("h"), F.lit(sizes[0]["kinds"]), SAMPLE + HELD))
    picked = few.groupBy("h", "id").agg(F.min("vec").alias("vec")).orderBy("h", "id").limit(SAMPLE + HELD).collect()  # so many vectors
    ids, vecs = np.array([r["id"] for r in picked]), np.array([r["vec"] for r in picked], np.float64)
    held = min(HELD, len(picked) // 5)
    router = learn(vecs[:len(vecs) - held], total)
    probes = calibrate(rows, router, ids, vecs, held, k)
    shared = spark.sparkContext.broadcast(packed(router))  # fixed size

    def place(batches):
        r = unpacked(shared)
        for b in batches:
            if b.num_rows:
                part = r.probabilities(matrix(b.column("vec"))).argmax(axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("vec"), pa.array(part)], ["id", "vec", "part"])

    placed = stored(rows.mapInArrow(place, f"id {key}, vec array<double>, part int"), "ann-index")
    held_rows = placed.groupBy("part").agg(F.count("*").alias("n"))
    load = held_rows.select("part", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("blocks"))
    index = placed.join(F.broadcast(load), "part").select(
        "part", F.pmod(F.xxhash64("id", "vec"), F.col("blocks")).cast("int").alias("block"), "id", "vec")
    in_part = np.zeros(router.parts, np.int64)
    for r in held_rows.collect():  # one row a part
        in_part[r["part"]] = r["n"]

    def route(batches):
        r = unpacked(shared)
        for b in batches:
            if b.num_rows:
                order = np.argsort(-r.probabilities(matrix(b.column("vec"))), axis=1, kind="stable").astype(np.int32)
                others = np.cumsum(in_part[order], axis=1) - b.column("own").to_numpy()[:, None]
                n = np.maximum(probes, np.minimum((others < k).sum(axis=1) + 1, r.parts))
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("vec"), pa.array([o[:m] for o, m in zip(order, n)], pa.list_(pa.int32()))],
                                                 ["id", "vec", "parts"])

    asked = placed.filter(query_filter).groupBy("id").agg(F.min("vec").alias("vec"), F.count("*").alias("own"))
    asked = stored(asked.mapInArrow(route, f"id {key}, vec array<double>, parts array<int>"), "ann-queries")
    early = max(1, -(-probes // 8))
    some = asked.select("id", "vec", F.explode(F.slice("parts", 1, early)).alias("part"), F.lit(None).cast("double").alias("least"))
    first = stored(_ranked(some, index, load, k, key), "ann-first")
    down = Window.partitionBy("query_id").orderBy(F.desc("score"))
    least = first.withColumn("place", F.row_number().over(down)).filter(F.col("place") <= k).groupBy("query_id").agg(
        F.when(F.count("*") >= k, F.min("score")).alias("least"))
    more = asked.join(least.select(F.col("query_id").alias("id"), "least"), "id", "left").select(
        "id", "vec", F.explode(F.slice("parts", early + 1, router.parts)).alias("part"), "least")
    found = first.union(_ranked(more, index, load, k, key))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
