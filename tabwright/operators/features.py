"""New columns from one column, two columns or a date."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.functions.columns import (
    DATETIME,
    col,
    datetime_columns,
    number,
    require_columns,
    require_numeric,
    text_columns,
    type_of,
)

# Formats tried in turn, after the standard form (month first).
DATE_FORMATS = (
    "M/d/yyyy",
    "M/d/yyyy H:mm",
    "M/d/yyyy H:mm:ss",
    "yyyy/M/d",
    "yyyy/M/d H:mm:ss",
    "MMM d, yyyy",
    "MMMM d, yyyy",
    "d MMM yyyy",
    "d-MMM-yyyy",
    "yyyyMMdd",
)

# Date part -> suffix of the generated column name.
DATE_SUFFIXES = {
    "year": "year",
    "month": "month",
    "day": "day",
    "dayofweek": "dow",
    "hour": "hour",
    "minute": "minute",
    "quarter": "quarter",
    "is_weekend": "weekend",
    "dayofyear": "doy",
}


def feature_name(default: str, name: str | None) -> str:
    custom = (name or "").strip()
    return custom or default


def add_feature(df: DataFrame, default: str, feature: Column, name: str | None = None) -> DataFrame:
    """Append the feature, or overwrite the column of that name."""
    return df.withColumn(feature_name(default, name), feature)


def _single(df: DataFrame, column: str) -> Column:
    require_numeric(df, [column])
    return number(df, column)


def _floored(x: Column, low: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(x, F.lit(low)))


def log(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    return add_feature(df, f"{column}_log", F.ln(_floored(_single(df, column), 1e-10)), name)


def log1p(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    return add_feature(df, f"{column}_log1p", F.log1p(_floored(_single(df, column), 0.0)), name)


def sqrt(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    return add_feature(df, f"{column}_sqrt", F.sqrt(_floored(_single(df, column), 0.0)), name)


def square(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    x = _single(df, column)
    return add_feature(df, f"{column}_square", x * x, name)


def zscore(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """(x - mean) / sample deviation; a column that does not vary is refused."""
    x = _single(df, column)
    row = df.agg(F.avg(x).alias("m"), F.stddev_samp(x).alias("s")).first()
    if not row["s"]:
        raise ValueError(f"{column} does not vary")
    return add_feature(df, f"{column}_zscore", (x - F.lit(row["m"])) / F.lit(row["s"]), name)


def _ends(df: DataFrame, column: str) -> tuple[float, float]:
    x = _single(df, column)
    row = df.agg(F.min(x).alias("a"), F.max(x).alias("b")).first()
    if row["a"] is None:
        raise ValueError(f"{column} has no values")
    return row["a"], row["b"]


def minmax(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """To [0, 1]; a constant column is refused."""
    low, high = _ends(df, column)
    if low == high:
        raise ValueError(f"{column} is constant")
    return add_feature(df, f"{column}_minmax", (number(df, column) - F.lit(low)) / F.lit(high - low), name)


def bin_edges(low: float, high: float, bins: int) -> list[float]:
    """bins + 1 equally spaced edges; the lowest value lies above the first."""
    if low == high:
        slack = 0.001 * abs(low) if low != 0 else 0.001
        low, high = low - slack, high + slack
        drop = 0.0
    else:
        drop = 0.001 * (high - low)
    width = (high - low) / bins
    edges = [low + i * width for i in range(bins)] + [high]
    edges[0] -= drop
    return edges


def _shown(x: float, digits: int) -> float:
    """Digits after the point; small numbers keep that many leading digits."""
    if x == 0 or not math.isfinite(x):
        return x
    if abs(x) < 1:
        digits += -math.floor(math.log10(abs(x))) - 1
    return float(np.round(x, digits))


def bin_labels(edges: Sequence[float]) -> list[str]:
    """(a, b] with three digits, or as many as keep the edges apart."""
    digits = next((d for d in range(3, 20) if len({_shown(e, d) for e in edges}) == len(edges)), 3)
    ends = [_shown(e, digits) for e in edges]
    ends[0] -= 10.0**-digits
    return [f"({float(a)}, {float(b)}]" for a, b in zip(ends, ends[1:])]


def binning(df: DataFrame, column: str, bins: int = 4, name: str | None = None, na_label: str | None = None) -> DataFrame:
    """Text label of the equal-width, right-closed bin of each value."""
    if bins < 1:
        raise ValueError("at least one bin is needed")
    edges = bin_edges(*_ends(df, column), bins)
    labels = bin_labels(edges)
    x = number(df, column)
    label = F.when(x.isNull(), F.lit(na_label).cast("string"))
    for edge, text in zip(edges[1:], labels):
        label = label.when(x <= F.lit(edge), F.lit(text))
    return add_feature(df, f"{column}_binned", label, name)


def _whole(df: DataFrame, *columns: str) -> bool:
    return all(isinstance(type_of(df, c), T.IntegralType) for c in columns)


def add(df: DataFrame, first: str, second: str, name: str | None = None) -> DataFrame:
    require_numeric(df, [first, second])
    if _whole(df, first, second):
        both = F.try_add(col(first).cast("bigint"), col(second).cast("bigint"))
    else:
        both = number(df, first) + number(df, second)
    return add_feature(df, f"{first}_plus_{second}", both, name)


def multiply(df: DataFrame, first: str, second: str, name: str | None = None) -> DataFrame:
    require_numeric(df, [first, second])
    if _whole(df, first, second):
        both = F.try_multiply(col(first).cast("bigint"), col(second).cast("bigint"))
    else:
        both = number(df, first) * number(df, second)
    return add_feature(df, f"{first}_times_{second}", both, name)


def ratio(df: DataFrame, first: str, second: str, name: str | None = None) -> DataFrame:
    """first / second; a zero divisor gives a missing value."""
    require_numeric(df, [first, second])
    share = number(df, first) / F.nullif(number(df, second), F.lit(0.0))
    return add_feature(df, f"{first}_div_{second}", share, name)


def parse_datetime(c: Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """Text as timestamp without zone; NULL where no form fits."""
    tries = [c.try_cast("timestamp_ntz")]
    tries += [F.try_to_timestamp(c, F.lit(f)).cast("timestamp_ntz") for f in formats]
    return F.coalesce(*tries)


def as_datetime(df: DataFrame, column: str, formats: Sequence[str] = DATE_FORMATS) -> Column:
    kind = type_of(df, column)
    if isinstance(kind, DATETIME):
        return col(column).cast("timestamp_ntz")
    if isinstance(kind, T.StringType):
        return parse_datetime(col(column), formats)
    raise TypeError(f"{column} is neither a date nor text")


def to_datetime(df: DataFrame, column: str, formats: Sequence[str] = DATE_FORMATS) -> DataFrame:
    return df.withColumn(column, as_datetime(df, column, formats))


def datetime_candidates(df: DataFrame, sample: int = 50) -> DataFrame:
    """Date columns, and text columns where half of a small sample parses.

    A text column is a candidate by the first present values it yields.
    """
    fixed = datetime_columns(df)
    texts = text_columns(df)
    parts = [
        df.select(F.lit(c).alias("column"), col(c).alias("v")).filter("v is not null").limit(sample) for c in texts
    ]
    found: set[str] = set()
    if parts:
        union = parts[0]
        for p in parts[1:]:
            union = union.unionAll(p)
        rows = (
            union.groupBy("column")
            .agg(F.count("v").alias("n"), F.count(parse_datetime(F.col("v"))).alias("parsed"))
            .filter("parsed >= greatest(1, n div 2)")
            .collect()
        )
        found = {r["column"] for r in rows}
    names = [(c,) for c in df.columns if c in fixed or c in found]
    return df.sparkSession.createDataFrame(names, "column string")


def _part(ts: Column, part: str) -> Column:
    if part == "is_weekend":
        return F.coalesce(F.weekday(ts).isin(5, 6), F.lit(False)).cast("int")
    functions = {
        "year": F.year,
        "month": F.month,
        "day": F.dayofmonth,
        "dayofweek": F.weekday,
        "hour": F.hour,
        "minute": F.minute,
        "quarter": F.quarter,
        "dayofyear": F.dayofyear,
    }
    return functions[part](ts)


def date_part(df: DataFrame, column: str, part: str, name: str | None = None, check: bool = True) -> DataFrame:
    """Calendar part of a date or text column.

    A text column in which nothing parses is refused; ``check=False`` leaves
    that pass out.
    """
    require_columns(df, [column])
    if part not in DATE_SUFFIXES:
        raise ValueError(f"unknown date part: {part}")
    ts = as_datetime(df, column)
    if check and df.filter(ts.isNotNull()).isEmpty():
        raise ValueError(f"no value of {column} reads as a date")
    return add_feature(df, f"{column}_{DATE_SUFFIXES[part]}", _part(ts, part), name)


def preview_feature(df: DataFrame, sources: Sequence[str], feature: str) -> DataFrame:
    """Only the source columns and the new one, each once."""
    wanted = dict.fromkeys([*sources, feature])
    return df.select(*[col(c) for c in wanted if c in df.columns])


SINGLE = {"log": log, "log1p": log1p, "sqrt": sqrt, "square": square, "zscore": zscore, "minmax": minmax, "binning": binning}


