"""Column-expression helpers shared by all operators (JVM-side expressions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ValidationError

# The text tokens that pandas' CSV reader turns into missing
# values by default (its documented ``na_values`` list).
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
]

# Text that pandas' to_numeric accepts: optional blanks and sign, decimal or
# scientific notation, or inf/infinity.  Spark's cast alone would also take
# '1d' and 'nan', which pandas refuses, hence the guard.
NUMERIC_TEXT = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity))\s*$"

NUMERIC_TYPES = (
    T.ByteType, T.ShortType, T.IntegerType, T.LongType,
    T.FloatType, T.DoubleType, T.DecimalType, T.BooleanType,
)
NESTED_TYPES = (T.ArrayType, T.MapType, T.StructType)


def col(name: str) -> Column:
    """Column reference that survives dots and blanks in names."""
    return F.col(f"`{name}`")


def is_numeric_type(dt: T.DataType) -> bool:
    return isinstance(dt, NUMERIC_TYPES)


def is_datetime_type(dt: T.DataType) -> bool:
    return isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType))


def nan_to_null(c: Column, dt: T.DataType | None = None) -> Column:
    """NULL is the only missing value: NaN of float/double becomes NULL."""
    if dt is None or isinstance(dt, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(c), c)
    return c


def as_double(df: DataFrame, name: str) -> Column:
    """Numeric view of a column as double: typed columns are cast, text is coerced."""
    dt = df.schema[name].dataType
    c = col(name)
    if isinstance(dt, T.StringType):
        return coerce_numeric(c)
    if isinstance(dt, T.BooleanType):
        return c.cast("int").cast("double")
    if is_numeric_type(dt):
        return nan_to_null(c.cast("double"))
    raise ValidationError(f"Column '{name}' is not numeric")


def coerce_numeric(c: Column) -> Column:
    """Text to double, unparseable text to NULL (pandas ``to_numeric(errors='coerce')``)."""
    s = F.trim(c.cast("string"))
    return F.when(s.rlike(NUMERIC_TEXT), s.try_cast("double"))


def normalize_null_tokens(c: Column, tokens=None) -> Column:
    """NULL for any of the missing-value tokens (the CSV reader's implicit rule)."""
    tokens = NULL_TOKENS if tokens is None else list(tokens)
    return F.when(~c.isin(tokens), c)


def check_columns(df: DataFrame, names) -> list[str]:
    names = list(names)
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValidationError(f"Column(s) not found in dataset: {', '.join(missing)}")
    return names


def name_at(names: list[str], idx: Column) -> Column:
    """Map a 0-based column index back to its name (a literal array lookup)."""
    return F.element_at(F.array(*[F.lit(n) for n in names]), idx + 1)


def long_text(df: DataFrame, names: list[str], drop_null: bool = True) -> DataFrame:
    """Unpivot any columns to (cid int, value string)."""
    pairs = [F.struct(F.lit(i).alias("cid"), col(n).cast("string").alias("value")) for i, n in enumerate(names)]
    out = df.select(F.explode(F.array(*pairs)).alias("p")).select("p.cid", "p.value")
    return out.where(F.col("value").isNotNull()) if drop_null else out
