"""Column classes and small column expressions shared by every operator."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NESTED = (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.VariantType)
DATETIME = (T.TimestampType, T.TimestampNTZType, T.DateType)
FRACTIONAL = (T.DoubleType, T.FloatType)

# Text that reads as a number. Spark's own cast also accepts type suffixes
# such as "1.0f" or "1d", which are not numbers in a data file.
NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
INTEGER_PATTERN = r"^\s*[+-]?\d+\s*$"
INFINITY_PATTERN = r"(?i)^\s*[+-]?inf(inity)?\s*$"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """Reference a column by its literal name, dots included."""
    return F.col(quoted(name))


def type_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def columns_of(df: DataFrame, *kinds: type) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def numeric_columns(df: DataFrame) -> list[str]:
    return columns_of(df, T.NumericType)


def text_columns(df: DataFrame) -> list[str]:
    return columns_of(df, T.StringType)


def boolean_columns(df: DataFrame) -> list[str]:
    return columns_of(df, T.BooleanType)


def datetime_columns(df: DataFrame) -> list[str]:
    return columns_of(df, *DATETIME)


def categorical_columns(df: DataFrame) -> list[str]:
    """Text and boolean columns; dates are neither numeric nor categorical."""
    return columns_of(df, T.StringType, T.BooleanType)


def atomic_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, NESTED)]


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(type_of(df, name), T.NumericType)


def require_columns(df: DataFrame, names: Iterable[str]) -> None:
    unknown = [n for n in names if n not in df.columns]
    if unknown:
        raise ValueError(f"unknown columns: {', '.join(unknown)}")


def require_numeric(df: DataFrame, names: Iterable[str]) -> None:
    names = list(names)
    require_columns(df, names)
    wrong = [n for n in names if not is_numeric(df, n)]
    if wrong:
        raise TypeError(f"not numeric: {', '.join(wrong)}")


def value(df: DataFrame, name: str) -> Column:
    """The column with NaN read as missing, so NULL is the only gap."""
    c = col(name)
    if isinstance(type_of(df, name), FRACTIONAL):
        return F.when(~F.isnan(c), c)
    return c


def number(df: DataFrame, name: str) -> Column:
    return value(df, name).cast("double")


def missing(df: DataFrame, name: str) -> Column:
    c = col(name)
    if isinstance(type_of(df, name), FRACTIONAL):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def dtype_name(df: DataFrame, name: str) -> str:
    return type_of(df, name).simpleString()


def python_strip(c: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def parse_number(text: Column) -> Column:
    """Text as double; NULL where the text is not a number."""
    return F.when(
        text.rlike(NUMBER_PATTERN) | text.rlike(INFINITY_PATTERN),
        python_strip(text).try_cast("double"),
    )


def clip(c: Column, low: float | None, high: float | None) -> Column:
    """Clamp to [low, high]; a missing value stays missing."""
    inner = c
    if low is not None:
        inner = F.greatest(inner, F.lit(float(low)))
    if high is not None:
        inner = F.least(inner, F.lit(float(high)))
    return F.when(c.isNotNull(), inner)


def replace_columns(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """Overwrite columns in place, all from the values before the step."""
    return df.select(*[new[n].alias(n) if n in new else col(n) for n in df.columns])


def chosen(df: DataFrame, columns: Sequence[str] | None, default: Sequence[str]) -> list[str]:
    if columns is None:
        return list(default)
    require_columns(df, columns)
    return list(columns)
