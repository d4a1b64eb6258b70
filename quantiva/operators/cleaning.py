"""Typing and cleaning."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import NULL_TOKENS, coerce_numeric, col, normalize_null_tokens

# Integer widths chosen by min/max when narrowing.
INT_RANGES = [("tinyint", -128, 127), ("smallint", -32768, 32767), ("int", -2147483648, 2147483647)]


def null_tokens(df: DataFrame, columns=None, tokens=NULL_TOKENS) -> DataFrame:
    """Text cells equal to a missing-value token become NULL."""
    names = set(columns or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)])
    return df.select(*[normalize_null_tokens(col(f.name), tokens).alias(f.name) if f.name in names else col(f.name)
                       for f in df.schema.fields])


def coerce_numeric_columns(df: DataFrame, columns) -> DataFrame:
    """Listed columns to double; unparseable text becomes NULL."""
    names = set(columns)
    return df.select(*[coerce_numeric(col(f.name)).alias(f.name) if f.name in names else col(f.name)
                       for f in df.schema.fields])


def exact_integer(c):
    """Text as bigint without loss: digits are cast directly; other numeric text (1.0, 1e3) counts if its
    double is whole and below 2**53; NULL otherwise (also beyond 64 bits)."""
    t = F.trim(c)
    x = coerce_numeric(c)
    whole = (F.abs(x) < float(2 ** 53)) & (x % 1 == 0)
    return F.when(t.rlike(r"^[+-]?\d+$"), t.try_cast("bigint")).when(whole, x.try_cast("bigint"))


def infer_types(df: DataFrame, threshold: float = 0.5, narrow: bool = False, skip=()) -> tuple[DataFrame, DataFrame]:
    """Convert a text column when more than ``threshold`` of all rows parse
    as numbers (unparseable values become NULL); pick widths (T4); tag the rest
    as categorical (unique/rows < .5) or string.  One aggregate decides all
    columns, then one ``select`` applies the casts.  Returns (typed df, report).

    Integers keep all 64 bits; a column with a whole number beyond them is double.  Columns in
    ``skip`` stay as they are.
    """
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in skip]
    report_rows = []
    casts = {}
    if texts:
        aggs = [F.count(F.lit(1)).alias("rows")]
        for i, n in enumerate(texts):
            x, k = coerce_numeric(col(n)), exact_integer(col(n))
            aggs += [F.count(x).alias(f"p{i}"), F.min(x).alias(f"mn{i}"), F.max(x).alias(f"mx{i}"),
                     F.count(k).alias(f"k{i}"), F.min(k).alias(f"kmn{i}"), F.max(k).alias(f"kmx{i}")]
        row = df.agg(*aggs).collect()[0]
        # exact distinct counts from one long-form grouping (not an Expand of rows x columns)
        from .profile import distinct_counts
        uniq = {r["cid"]: r["unique_count"] for r in distinct_counts(df.select(*[col(n) for n in texts])).collect()}
        rows = row["rows"]
        for i, n in enumerate(texts):
            parsed, integral = row[f"p{i}"], row[f"k{i}"] == row[f"p{i}"]
            if parsed > 0 and rows and parsed / rows > threshold:
                no_nulls = parsed == rows
                if integral:
                    target = "bigint"
                    if narrow and no_nulls:
                        for name, lo, hi in INT_RANGES:
                            if row[f"kmn{i}"] >= lo and row[f"kmx{i}"] <= hi:
                                target = name
                                break
                else:
                    target = "float" if (narrow and no_nulls) else "double"
                casts[n] = target
                role = "numeric"
            else:
                target = "string"
                role = "categorical" if rows and uniq.get(i, 0) / rows < 0.5 else "text"
            report_rows.append((n, int(parsed), int(rows), bool(integral), row[f"mn{i}"], row[f"mx{i}"], target, role))

    def typed(name: str):
        target = casts[name]
        source = coerce_numeric(col(name)) if target in ("double", "float") else exact_integer(col(name))
        return source.cast(target).alias(name)

    out = df.select(*[typed(f.name) if f.name in casts else col(f.name) for f in df.schema.fields])
    report = df.sparkSession.createDataFrame(
        report_rows, "column string, parsed long, total long, all_integral boolean, min double, max double, target_type string, role string")
    return out, report


def sanitize_columns(df: DataFrame) -> DataFrame:
    """Runs of characters outside [0-9a-zA-Z_] become '_'; a name already given gets _2, _3, ...
    until it is new."""
    given: set[str] = set()
    names = []
    for n in df.columns:
        base = re.sub(r"[^0-9a-zA-Z_]+", "_", n)
        new, k = base, 1
        while new in given:
            k += 1
            new = f"{base}_{k}"
        given.add(new)
        names.append(new)
    return df.toDF(*names)
