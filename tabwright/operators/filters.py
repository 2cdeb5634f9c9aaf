"""Row filters, their domains and column selection."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.functions.columns import (
    FRACTIONAL,
    categorical_columns,
    chosen,
    col,
    is_numeric,
    missing,
    number,
    numeric_columns,
    require_columns,
    type_of,
    value,
)

CATEGORICAL_LIMIT = 30
MISSING_LABEL = "(NA)"


@dataclass(frozen=True)
class InList:
    """Rows whose value is listed; ``"(NA)"`` in the list adds missing rows."""

    column: str
    values: Sequence[Any]

    def predicate(self, df: DataFrame) -> Column:
        listed = [v for v in self.values if v != MISSING_LABEL]
        tests = [is_listed(df, self.column, listed)] if listed else []
        if MISSING_LABEL in self.values:
            tests.append(missing(df, self.column))
        return reduce(lambda a, b: a | b, tests, F.lit(False))


@dataclass(frozen=True)
class InRange:
    """Closed range with optional ends; missing rows are dropped."""

    column: str
    low: Any = None
    high: Any = None

    def predicate(self, df: DataFrame) -> Column:
        # Plain comparisons reach the scan; NaN is above every number.
        x = col(self.column)
        tests = []
        if self.low is not None:
            tests.append(x >= F.lit(self.low))
        if self.high is not None:
            tests.append(x <= F.lit(self.high))
        if tests and isinstance(type_of(df, self.column), FRACTIONAL):
            tests.append(~F.isnan(x))
        return reduce(lambda a, b: a & b, tests, F.lit(True))


Filter = InList | InRange


def _typed(v: Any, kind: T.DataType) -> Column:
    """A listed value in the column's type; text that does not fit is NULL."""
    if isinstance(v, str) and not isinstance(kind, T.StringType):
        typed = F.lit(v).try_cast(kind)
        return F.nullif(typed, F.lit("NaN").cast(kind)) if isinstance(kind, FRACTIONAL) else typed
    if isinstance(kind, T.StringType):
        return F.lit(str(v))
    return F.lit(v)


def is_listed(df: DataFrame, column: str, values: Sequence[Any]) -> Column:
    """NULL for a missing value, which a filter drops."""
    kind = type_of(df, column)
    return col(column).isin(*[_typed(v, kind) for v in values])


@dataclass
class FilterSet:
    """Filters joined by AND; one per column, the newest wins."""

    filters: list[Filter] = field(default_factory=list)

    def add(self, f: Filter) -> "FilterSet":
        if isinstance(f, InList) and not f.values:
            raise ValueError("a value list must not be empty")
        if isinstance(f, InRange) and f.low is None and f.high is None:
            raise ValueError("a range needs at least one end")
        return FilterSet([g for g in self.filters if g.column != f.column] + [f])

    def remove(self, position: int) -> "FilterSet":
        if not 0 <= position < len(self.filters):
            return FilterSet(list(self.filters))
        return FilterSet(self.filters[:position] + self.filters[position + 1 :])

    def predicate(self, df: DataFrame) -> Column:
        tests = [f.predicate(df) for f in self.filters if f.column in df.columns]
        return reduce(lambda a, b: a & b, tests, F.lit(True))

    def apply(self, df: DataFrame) -> DataFrame:
        return df.filter(self.predicate(df))


def filter_categorical(df: DataFrame, column: str, values: Sequence[Any]) -> DataFrame:
    return df.filter(InList(column, values).predicate(df))


def filter_range(df: DataFrame, column: str, low: Any = None, high: Any = None) -> DataFrame:
    return df.filter(InRange(column, low, high).predicate(df))


def filter_all(df: DataFrame, filters: Sequence[Filter]) -> DataFrame:
    return reduce(FilterSet.add, filters, FilterSet()).apply(df)


def filtered_count(df: DataFrame, filters: Sequence[Filter]) -> DataFrame:
    """How many rows pass, of how many, in one pass."""
    keep = reduce(FilterSet.add, filters, FilterSet()).predicate(df)
    return df.agg(F.count_if(keep).alias("shown"), F.count(F.lit(1)).alias("total"))


def filter_kind(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """categorical or numeric control per column.

    A sketch clears the columns with many values: of at most ``CATEGORICAL_LIMIT``
    values it never tells twice as many, as so few leave most of its registers
    empty. The values of the columns that are left are counted exactly.
    """
    columns = chosen(df, columns, df.columns)
    numeric = [c for c in columns if is_numeric(df, c)]
    few: set[str] = set()
    if numeric:
        tags = {f"c{i}": c for i, c in enumerate(numeric)}
        numbers = df.select(*[(number(df, c).cast("double") + F.lit(0.0)).alias(tag) for tag, c in tags.items()])
        told = numbers.agg(*[F.approx_count_distinct(tag).alias(tag) for tag in tags]).first()
        near = [tag for tag in tags if told[tag] <= 2 * CATEGORICAL_LIMIT]
        few = {tags[tag] for tag in near}
        if near:
            tall = numbers.select(*near).unpivot([], near, "at", "v").filter("v is not null").distinct()
            many = tall.groupBy("at").count().filter(F.col("count") > CATEGORICAL_LIMIT).select("at").collect()
            few -= {tags[r["at"]] for r in many}
    rows = [(c, "numeric" if c in numeric and c not in few else "categorical") for c in columns]
    return df.sparkSession.createDataFrame(rows, "column string, kind string")


def filter_domain(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct values as text, ``(NA)`` last where any is missing."""
    x = value(df, column).cast("string")
    found = df.select(x.alias("value")).distinct()
    return found.orderBy(F.asc_nulls_last("value")).select(
        F.coalesce("value", F.lit(MISSING_LABEL)).alias("value")
    )


def eda_filter_domain(df: DataFrame, column: str) -> DataFrame:
    """Distinct present values in their own type."""
    return df.select(value(df, column).alias("value")).filter("value is not null").distinct()


def filter_bounds(df: DataFrame, column: str, widen: bool = False) -> DataFrame:
    """Least and greatest value, 0 when all are missing.

    ``widen`` lifts the upper end by 0.01 when both are equal (slider form).
    """
    x = number(df, column)
    low = F.coalesce(F.min(x), F.lit(0.0))
    high = F.coalesce(F.max(x), F.lit(0.0))
    out = df.agg(low.alias("low"), high.alias("high"))
    if widen:
        out = out.withColumn("high", F.when(F.col("low") == F.col("high"), F.col("high") + 0.01).otherwise(F.col("high")))
    return out


def eda_filter_range(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """Closed range, ignored when it lies wholly outside the data."""
    ends = df.agg(F.min(number(df, column)).alias("a"), F.max(number(df, column)).alias("b")).first()
    if ends["a"] is not None and (high < ends["a"] or low > ends["b"]):
        return df
    return filter_range(df, column, low, high)


def eda_filter_in(df: DataFrame, column: str, values: Sequence[Any]) -> DataFrame:
    """Listed values only; an empty list keeps nothing, missing rows drop."""
    if not values:
        return df.filter(F.lit(False))
    return df.filter(is_listed(df, column, values))


def drop_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop the listed columns; unknown names are ignored."""
    if not columns:
        raise ValueError("name at least one column to drop")
    return df.select(*[col(c) for c in df.columns if c not in columns])


def select_numeric(df: DataFrame) -> DataFrame:
    return df.select(*[col(c) for c in numeric_columns(df)])


def select_categorical(df: DataFrame, everything_else: bool = False) -> DataFrame:
    """Text and boolean columns; ``everything_else`` takes all non-numeric."""
    names = categorical_columns(df)
    if everything_else:
        numeric = set(numeric_columns(df))
        names = [c for c in df.columns if c not in numeric]
    return df.select(*[col(c) for c in names])


def first_numeric(df: DataFrame, n: int = 30) -> DataFrame:
    return df.select(*[col(c) for c in numeric_columns(df)[:n]])


def any_missing(df: DataFrame, columns: Sequence[str]) -> Column:
    require_columns(df, columns)
    return reduce(lambda a, b: a | b, [missing(df, c) for c in columns], F.lit(False))
