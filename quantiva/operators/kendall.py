"""Exact Kendall tau-b at scale.

tau_b = (C - D) / sqrt((n0 - tx) (n0 - ty)), n0 = n(n-1)/2, with tx, ty, txy
the pairs tied in x, in y and in both (sums of c(c-1)/2 over grouped counts)
and C = n0 - tx - ty + txy - D.  Only the discordant count D needs pairs.

D is split over a grid of value buckets (edges from ``percentile_approx``
over a group's points; a value that is itself an edge gets a bucket of its
own):

(a) pairs in different x-buckets and different y-buckets: decided by the
    bucket numbers alone, so they are the discordant pairs of the table of
    grid cells;
(b) pairs in the same x-bucket: a group of its own for each x-bucket;
(c) pairs in different x-buckets but the same y-bucket: a group for each
    y-bucket, with x replaced by its bucket number.

Each of these is a smaller group of weighted points and is split again, for
as many rounds as it takes, until it holds at most ``TARGET_POINTS``; then it
is counted in ``applyInPandas``.  Buckets of one value hold no discordant
pair in (b) or (c) and are dropped, so a value holding a third of all rows
costs nothing extra.  All groups of a round go through the same few jobs; the
driver only sees whether a round is left.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import as_double
from .ranks import stored_table

TARGET_POINTS = 200_000   # of a group that one task counts
EDGES = 128               # of a grid axis; the cell table of a grid is always a small group
ACCURACY = 4096
PAIRS_AT_ONCE = 64


def weighted_discordant(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> int:
    """sum of w_i w_j over pairs with x_i < x_j and y_i > y_j (exact integer).

    Sort by (x, y); then a pair is discordant iff it is a strict inversion of
    y (equal x never is, because y ascends within equal x).  Bottom-up merge
    levels, each one vectorised sort + searchsorted: O(n log^2 n).
    """
    n = len(x)
    if n < 2:
        return 0
    order = np.lexsort((y, x))
    y = np.unique(y[order], return_inverse=True)[1].astype(np.int64)
    w = w[order].astype(np.int64)
    span = int(y.max()) + 2
    big = int(w.sum()) ** 2 >= 2 ** 62
    total = 0
    idx = np.arange(n, dtype=np.int64)
    s = 1
    while s < n:
        block = idx // (2 * s)
        right = (idx // s) % 2 == 1
        left = ~right
        lkey = block[left] * span + y[left]
        lw = w[left]
        o = np.argsort(lkey, kind="stable")
        lkey, lw = lkey[o], lw[o]
        cum = np.concatenate(([0], np.cumsum(lw)))
        rb, ry, rw = block[right], y[right], w[right]
        hi = np.searchsorted(lkey, rb * span + span - 1, side="right")
        lo = np.searchsorted(lkey, rb * span + ry, side="right")
        above = cum[hi] - cum[lo]
        if big:
            total += sum(int(a) * int(b) for a, b in zip(above, rw) if a)
        else:
            total += int(np.dot(above, rw))
        s *= 2
    return total


def _discordant_group(pdf: pd.DataFrame) -> pd.DataFrame:
    d = weighted_discordant(pdf["x"].to_numpy(), pdf["y"].to_numpy(), pdf["w"].to_numpy())
    return pd.DataFrame({"pid": [int(pdf["pid"].iloc[0])], "d": [str(d)]})


def _kernel(points: DataFrame) -> DataFrame:
    return points.groupBy("pid", "gid").applyInPandas(_discordant_group, "pid int, d string")


def _bucket(edges, v):
    """Even: between two edges; odd: exactly an edge."""
    return 2 * F.size(F.filter(edges, lambda e: e < v)) + F.array_contains(edges, v).cast("int")


def _split(points: DataFrame, edges: int) -> DataFrame:
    """The smaller groups (pid, gid, x, y, w) that stand for the pairs of large groups."""
    probs = [i / (edges + 1) for i in range(1, edges + 1)]
    grid = points.groupBy("pid", "gid").agg(
        F.array_distinct(F.percentile_approx("x", probs, ACCURACY)).alias("ex"),
        F.array_distinct(F.percentile_approx("y", probs, ACCURACY)).alias("ey"))
    placed = points.join(stored_table(grid, "kendall-grid"), ["pid", "gid"]).select(
        "pid", "gid", "x", "y", "w", _bucket(F.col("ex"), F.col("x")).alias("bx"), _bucket(F.col("ey"), F.col("y")).alias("by"))
    placed = stored_table(placed, "kendall-points")
    child = lambda kind, *key: F.xxhash64(F.lit(kind), "gid", *key).alias("gid")
    as_x = F.col("bx").cast("double").alias("x")
    cells = placed.groupBy("pid", "gid", "bx", "by").agg(F.sum("w").alias("w")).select(
        "pid", child("cells"), as_x, F.col("by").cast("double").alias("y"), "w")
    in_x = placed.where("bx % 2 = 0").select("pid", child("x", "bx"), "x", "y", "w")
    in_y = placed.where("by % 2 = 0").groupBy("pid", "gid", "by", "bx", "y").agg(F.sum("w").alias("w")).select(
        "pid", child("y", "by"), as_x, "y", "w")
    return cells.unionByName(in_x).unionByName(in_y)


def count_discordant(points: DataFrame) -> DataFrame:
    """(pid, d): weighted discordant pairs of every pair's points (pid, x, y, w)."""
    edges = max(1, min(EDGES, math.isqrt(TARGET_POINTS) // 2 - 1))
    largest = max(TARGET_POINTS, (2 * edges + 1) ** 2)
    work, parts = points.withColumn("gid", F.col("pid").cast("long")), []
    while True:
        big = stored_table(work.groupBy("pid", "gid").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > largest)
                           .select("pid", "gid"), "kendall-large")
        if big.isEmpty():
            parts.append(_kernel(work))
            break
        parts.append(_kernel(work.join(big, ["pid", "gid"], "left_anti")))
        work = stored_table(_split(work.join(big, ["pid", "gid"], "left_semi"), edges), "kendall-groups")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def kendall_pairs(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """column1, column2, n, concordant, discordant, ties_x, ties_y, ties_xy, tau_b (one row per pair).

    One scan per block of ``PAIRS_AT_ONCE`` pairs collapses the rows to distinct points, which are stored
    and read by everything else.  Pair counts are decimal(38,0).
    """
    parts = [_pairs_block(df, pairs[a:a + PAIRS_AT_ONCE]) for a in range(0, len(pairs), PAIRS_AT_ONCE)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("column1", "column2")


def _pairs_block(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    spark = df.sparkSession
    cells = F.array(*[F.struct(F.lit(k).alias("pid"), as_double(df, a).alias("x"), as_double(df, b).alias("y"))
                      for k, (a, b) in enumerate(pairs)])
    cells = F.filter(cells, lambda c: c["x"].isNotNull() & c["y"].isNotNull())
    g = stored_table(df.select(F.explode(cells).alias("p")).select("p.*").groupBy("pid", "x", "y").agg(
        F.count(F.lit(1)).alias("w")), "kendall-distinct")
    dec = "decimal(38,0)"
    disc = count_discordant(g).groupBy("pid").agg(F.sum(F.col("d").cast(dec)).alias("discordant"))

    def tied(c):
        return (F.col(c) * (F.col(c) - 1) / 2).cast(dec)

    def tie(column, name):
        t = g.groupBy("pid", column).agg(F.sum("w").cast(dec).alias("c"))
        return t.groupBy("pid").agg(F.sum(tied("c")).cast(dec).alias(name))

    tot = g.withColumn("c", F.col("w").cast("decimal(19,0)")).groupBy("pid").agg(
        F.sum("c").cast(dec).alias("n"), F.sum(tied("c")).cast(dec).alias("txy"))
    res = tot.join(tie("x", "tx"), "pid").join(tie("y", "ty"), "pid").join(disc, "pid", "left")
    n0 = tied("n")
    d = F.coalesce(F.col("discordant"), F.lit(0).cast(dec))
    conc = (n0 - F.col("tx") - F.col("ty") + F.col("txy") - d).cast(dec)
    den = F.sqrt((n0 - F.col("tx")).cast("double")) * F.sqrt((n0 - F.col("ty")).cast("double"))
    names = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "pid int, column1 string, column2 string")
    return names.join(res, "pid", "left").select(
        "column1", "column2", F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n"),
        conc.alias("concordant"), d.alias("discordant"), F.col("tx").alias("ties_x"), F.col("ty").alias("ties_y"),
        F.col("txy").alias("ties_xy"), F.try_divide((conc - d).cast("double"), F.when(den > 0, den)).alias("tau_b"))
