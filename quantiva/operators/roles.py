"""Column roles: strict-numeric test (T6) and the four-way dtype role."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import NESTED_TYPES, coerce_numeric, col, is_numeric_type


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def numeric_columns(df: DataFrame) -> list[str]:
    """Strict numeric columns, in schema order.

    Typed numeric columns (and booleans) qualify from the schema alone; a text
    column qualifies when every non-null value parses.  Only text columns
    cost an aggregate, and all of them share one pass; composed reports hand
    the result on (``numeric=``).
    """
    texts = text_columns(df)
    ok_text: set[str] = set()
    if texts:
        row = df.agg(*[(F.count(col(n)) == F.count(coerce_numeric(col(n)))).alias(f"t{i}") for i, n in enumerate(texts)]).collect()[0]
        ok_text = {n for i, n in enumerate(texts) if row[f"t{i}"]}
    return [f.name for f in df.schema.fields if is_numeric_type(f.dataType) or f.name in ok_text]


def categorical_columns(df: DataFrame, numeric: list[str] | None = None) -> list[str]:
    """Complement of the strict numeric columns (nested columns excluded)."""
    numeric = numeric_columns(df) if numeric is None else numeric
    return [f.name for f in df.schema.fields
            if f.name not in numeric and not isinstance(f.dataType, NESTED_TYPES)]
