"""Pearson correlation of every pair of many columns in one scan (C1, C4, C10 on wide tables).

Each batch of rows is a matrix with a mask of its values.  Products of values
and masks give, for every pair at once, the number of rows in which both are
present and the means and centred products over just these rows.  Parts of
two batches are merged with the usual formulas for counts, means and centred
products, so nothing is subtracted from large sums.  A task gives one record
per column (its row of the tables against all columns); records are merged in
two steps of GROUP tasks, by column, and become pairs with built-in functions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GROUP = 64
ROWS = 4096             # of one matrix product
SMALL = 1e-10           # variance below this share of the squared mean: too close to rounding to decide here
NOISE = 64 * np.finfo(np.float64).eps  # share of a sum of squares that is rounding once the mean's part is taken off
_PARTS = ("n", "mx", "my", "xx", "yy", "xy")


def merged(a: dict | None, b: dict) -> dict:
    """Counts, means and centred products of two sets of rows together (arrays, element by element)."""
    if a is None:
        return b
    n = a["n"] + b["n"]
    part = np.divide(b["n"], n, out=np.zeros_like(n), where=n > 0)
    gx, gy, w = b["mx"] - a["mx"], b["my"] - a["my"], a["n"] * part
    return {"n": n, "mx": a["mx"] + gx * part, "my": a["my"] + gy * part, "xx": a["xx"] + b["xx"] + gx * gx * w,
            "yy": a["yy"] + b["yy"] + gy * gy * w, "xy": a["xy"] + b["xy"] + gx * gy * w}


def products(x: np.ndarray) -> dict:
    """The tables [column, column] of the rows of ``x`` (NaN: no value)."""
    there = ~np.isnan(x)
    m = there.astype(np.float64)
    count = m.sum(axis=0)
    shift = np.divide(np.where(there, x, 0.0).sum(axis=0), count, out=np.zeros(x.shape[1]), where=count > 0)
    z = np.where(there, x - shift, 0.0)
    if there.all():
        c = np.ones(x.shape[1])
        n, sx, qx = len(x) * np.outer(c, c), np.outer(z.sum(axis=0), c), np.outer((z * z).sum(axis=0), c)
    else:
        n, sx, qx = m.T @ m, z.T @ m, (z * z).T @ m     # over the rows in which the other column is present
    inv = np.divide(1.0, n, out=np.zeros_like(n), where=n > 0)
    xx = qx - sx * sx * inv
    xx[xx <= NOISE * qx] = 0.0  # a column that is constant in a pair's rows, far from its mean over all rows
    return {"n": n, "mx": shift[:, None] + sx * inv, "my": shift[None, :] + sx.T * inv, "xx": xx, "yy": xx.T,
            "xy": z.T @ z - sx * sx.T * inv}


def pair_table(df: DataFrame, values: list[Column]) -> DataFrame:
    """(i, j, n, xx, yy, xy, close): rows, centred products and whether a variance is too close to rounding,
    of every pair i < j of ``values`` (doubles, null: no value).  One scan."""
    k = len(values)
    kinds = ", ".join(f"{p} array<double>" for p in _PARTS)

    def task(batches):
        total = None
        for b in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], axis=1).astype(np.float64)
            for a in range(0, len(x), ROWS):
                total = merged(total, products(x[a:a + ROWS]))
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(k), pa.int32())] + [pa.array(list(total[p])) for p in _PARTS], ["i", *_PARTS])

    def add(table: pa.Table) -> pa.Table:
        lists = {p: table.column(p).combine_chunks() for p in _PARTS}
        total = None
        for r in range(table.num_rows):
            total = merged(total, {p: lists[p][r].values.to_numpy() for p in _PARTS})
        first = table.slice(0, 1).to_pylist()[0]
        return pa.Table.from_pylist([{"_task": first["_task"] // GROUP, "i": first["i"], **total}], schema=table.schema)

    parts = df.select(*[v.alias(f"_v{i}") for i, v in enumerate(values)]).mapInArrow(task, f"i int, {kinds}") \
        .select(F.spark_partition_id().cast("bigint").alias("_task"), "i", *_PARTS)
    for _ in range(2):
        parts = parts.groupBy(F.floor(F.col("_task") / GROUP), "i").applyInArrow(add, f"_task bigint, i int, {kinds}")
    # beyond GROUP ** 2 tasks several records of a column are left; the last merge is by column alone
    parts = parts.groupBy("i").applyInArrow(add, f"_task bigint, i int, {kinds}")
    each = parts.select("i", F.posexplode(F.arrays_zip(*_PARTS)).alias("j", "p")).where(F.col("j") > F.col("i"))
    p = {x: F.col("p")[x] for x in _PARTS}
    close = (p["xx"] <= SMALL * p["n"] * p["mx"] * p["mx"]) | (p["yy"] <= SMALL * p["n"] * p["my"] * p["my"]) | (p["xx"] <= 0) | (p["yy"] <= 0)
    return each.select("i", "j", p["n"].cast("long").alias("n"), p["xx"].alias("xx"), p["yy"].alias("yy"), p["xy"].alias("xy"),
                       close.alias("close"))
