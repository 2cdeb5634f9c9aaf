"""Text standardising, column names, recoding and type changes."""

from __future__ import annotations

import string
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.functions.columns import (
    INTEGER_PATTERN,
    chosen,
    col,
    dtype_name,
    missing,
    parse_number,
    python_strip,
    replace_columns,
    require_columns,
    text_columns,
    value,
)
from tabwright.functions.counts import value_counts as value_counts


NAME_CHARACTERS = frozenset(string.ascii_lowercase + string.digits)


def standard_name(name: str) -> str:
    """Lower-case words of letters and digits, joined by single underscores.

    Blanks and underscores part the words; other characters vanish.
    """
    parted = "".join(
        ch if ch in NAME_CHARACTERS else " " if ch == "_" or ch.isspace() else "" for ch in str(name).lower()
    )
    return "_".join(parted.split())


def standardize_column_names(df: DataFrame) -> DataFrame:
    """Standard names; an empty one becomes col_{i}, a repeated one gets _2, _3."""
    names: list[str] = []
    for i, old in enumerate(df.columns):
        base = standard_name(old) or f"col_{i}"
        name, n = base, 2
        while name in names:
            name, n = f"{base}_{n}", n + 1
        names.append(name)
    return df.toDF(*names)


def trim_text(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return replace_columns(df, {c: python_strip(col(c)) for c in chosen(df, columns, text_columns(df))})


def lower_text(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return replace_columns(df, {c: F.lower(col(c)) for c in chosen(df, columns, text_columns(df))})


def strip_characters(df: DataFrame, characters: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Remove every listed character wherever it stands."""
    characters = characters.strip()
    if not characters:
        return df
    names = chosen(df, columns, text_columns(df))
    return replace_columns(df, {c: F.translate(col(c), characters, "") for c in names})


def fit_numeric_text(df: DataFrame, columns: Sequence[str] | None = None) -> dict[str, str]:
    """Text columns whose every present value is a number, with the type they fit."""
    names = chosen(df, columns, text_columns(df))
    if not names:
        return {}
    aggs = []
    for i, c in enumerate(names):
        aggs += [
            F.count(col(c)).alias(f"n{i}"),
            F.count(parse_number(col(c))).alias(f"d{i}"),
            F.count(_parse_long(col(c))).alias(f"l{i}"),
        ]
    row = df.agg(*aggs).first()
    fitted = {}
    for i, c in enumerate(names):
        if row[f"n{i}"] and row[f"n{i}"] == row[f"d{i}"]:
            fitted[c] = "bigint" if row[f"n{i}"] == row[f"l{i}"] else "double"
    return fitted


def _parse_long(c: Column) -> Column:
    return F.when(c.rlike(INTEGER_PATTERN), python_strip(c).try_cast("bigint"))


def apply_numeric_text(df: DataFrame, fitted: Mapping[str, str]) -> DataFrame:
    return replace_columns(
        df, {c: _parse_long(col(c)) if t == "bigint" else parse_number(col(c)) for c, t in fitted.items()}
    )


def auto_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Text columns turn numeric only if all their present values parse."""
    return apply_numeric_text(df, fit_numeric_text(df, columns))


def format_standardize(
    df: DataFrame,
    column_names: bool = True,
    trim: bool = True,
    lower: bool = False,
    characters: str = "",
    numeric: bool = True,
) -> DataFrame:
    """Names, trim, lower case, characters, numbers; in this order."""
    if column_names:
        df = standardize_column_names(df)
    if trim:
        df = trim_text(df)
    if lower:
        df = lower_text(df)
    if characters:
        df = strip_characters(df, characters)
    return auto_numeric(df) if numeric else df


def _check_remap(dirty: str, target: str) -> str:
    target = str(target).strip()
    if not target:
        raise ValueError("the replacement must not be blank")
    if target == dirty:
        raise ValueError("the value is already the target")
    return target


def _remap_match(df: DataFrame, column: str, dirty: str) -> Column:
    """``nan`` stands for a missing value; other values compare as text."""
    if dirty == "nan":
        return missing(df, column)
    return F.coalesce(value(df, column).cast("string") == F.lit(dirty), F.lit(False))


def remap_value(df: DataFrame, column: str, dirty: str, target: str) -> DataFrame:
    require_columns(df, [column])
    target = _check_remap(dirty, target)
    text = value(df, column).cast("string")
    return replace_columns(
        df, {column: F.when(_remap_match(df, column, dirty), F.lit(target)).otherwise(text)}
    )


def remap_values(df: DataFrame, column: str, mapping: Mapping[str, str]) -> DataFrame:
    """Many replacements at once, each read from the values before the step."""
    require_columns(df, [column])
    out = None
    for dirty, target in mapping.items():
        cond, new = _remap_match(df, column, dirty), F.lit(_check_remap(dirty, target))
        out = F.when(cond, new) if out is None else out.when(cond, new)
    if out is None:
        return df
    return replace_columns(df, {column: out.otherwise(value(df, column).cast("string"))})


def remap_count(df: DataFrame, column: str, dirty: str) -> DataFrame:
    return df.agg(F.count_if(_remap_match(df, column, dirty)).alias("replaced"))


def _money(df: DataFrame, column: str) -> Column:
    if column in text_columns(df):
        return parse_number(python_strip(F.translate(col(column), "$,", "")))
    return value(df, column).cast("double")


def to_numeric(df: DataFrame, column: str) -> DataFrame:
    """Number after dropping $ and commas, else missing."""
    require_columns(df, [column])
    return replace_columns(df, {column: _money(df, column)})


def to_numeric_report(df: DataFrame, column: str) -> DataFrame:
    require_columns(df, [column])
    return df.agg(F.count(_money(df, column)).alias("parsed"), F.count(value(df, column)).alias("total"))


def to_boolean(df: DataFrame, column: str, true_values: Sequence[str]) -> DataFrame:
    """Listed texts are true, other present values false."""
    require_columns(df, [column])
    if not true_values:
        raise ValueError("name the values that mean true")
    x = value(df, column)
    return replace_columns(df, {column: F.when(x.isNotNull(), x.cast("string").isin(*true_values))})


def to_text(df: DataFrame, column: str) -> DataFrame:
    require_columns(df, [column])
    return replace_columns(df, {column: value(df, column).cast("string")})


def column_sample(df: DataFrame, column: str, n: int = 5) -> DataFrame:
    """One row: dtype, number of distinct values, the n smallest as text."""
    distinct = df.select(value(df, column).alias("v")).filter("v is not null").distinct()
    unique = distinct.count()
    least = [r[0] for r in distinct.orderBy("v").limit(n).select(F.col("v").cast("string")).collect()]
    row = (column, dtype_name(df, column), unique, ", ".join(least))
    return df.sparkSession.createDataFrame([row], "column string, dtype string, unique bigint, sample string")
