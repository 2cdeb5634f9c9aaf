"""Value counts, distinct counts and most frequent values.

Counting goes through (column, value) rows, so equal values collapse on the
map side and no value list is ever held by a single task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.functions.columns import FRACTIONAL, atomic_columns, col, type_of, value

#: Buckets of the first count of ``most_frequent``; so many rows reach the driver at most.
BUCKETS = 65_536
#: The fullest buckets, in which the first candidates are looked for.
FULLEST = 256

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def text_form(df: DataFrame, name: str) -> Column:
    """Text of a value; equal numbers get equal text (-0.0 is 0.0)."""
    c = value(df, name)
    kind = type_of(df, name)
    if isinstance(kind, FRACTIONAL):
        c = c + F.lit(0.0).cast(kind)
    return c.cast("string")


def value_counts(df: DataFrame, name: str) -> DataFrame:
    """value -> count, missing included, most frequent first, ties by value."""
    return (
        df.groupBy(value(df, name).alias("value"))
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), F.asc_nulls_first("value"))
    )


def most_frequent(df: DataFrame, name: str, k: int, buckets: int = BUCKETS) -> DataFrame:
    """value -> count of the ``k`` most frequent values; missing is a value, ties go by value.

    Exact, without a shuffle of the rare values. Rows are counted by a hash of their
    value into ``buckets``; no value has more rows than its bucket. The values of the
    fullest buckets are counted, and the k-th count among them is a floor: a value of
    a bucket below it is not among the first. Where buckets that were not looked into
    reach the floor, the values of all that do are counted. So a column whose values
    are all rare costs the count of every value, as in ``value_counts``.
    """
    if k < 1 or buckets < 1:
        raise ValueError("k and buckets must be positive")
    kind, c = type_of(df, name), value(df, name)
    slim = df.select((c + F.lit(0.0).cast(kind) if isinstance(kind, FRACTIONAL) else c).alias("value"))
    slim = slim.withColumn("__bucket", F.pmod(F.xxhash64("value"), F.lit(buckets)).cast("int"))
    sizes = {r["__bucket"]: r["n"] for r in slim.groupBy("__bucket").agg(F.count(F.lit(1)).alias("n")).collect()}
    fullest = sorted(sizes, key=sizes.get, reverse=True)[: max(FULLEST, 4 * k)]

    def first(rows: DataFrame) -> DataFrame:
        counted = rows.groupBy("value").agg(F.count(F.lit(1)).alias("count"))
        return counted.orderBy(F.desc("count"), F.asc_nulls_first("value")).limit(k)

    found = first(slim.filter(F.col("__bucket").isin(fullest)))
    rows = found.collect()
    floor = rows[-1]["count"] if len(rows) == k else 1
    reached = [b for b, n in sizes.items() if n >= floor]
    if set(reached) <= set(fullest):
        return df.sparkSession.createDataFrame(rows, found.schema)
    if len(reached) == len(sizes):
        return first(slim)
    chosen = df.sparkSession.createDataFrame([(b,) for b in reached], "__bucket int")
    return first(slim.join(F.broadcast(chosen), "__bucket", "left_semi"))


def long_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value as text, n) for every present value of every column."""
    return _counted(df, columns, [text_form(df, c) for c in columns])


def _counted(df: DataFrame, columns: Sequence[str], values: Sequence[Column]) -> DataFrame:
    """(column, value, n); the values have one type."""
    wide = df.select(*[v.alias(f"c{i}") for i, v in enumerate(values)])
    tall = wide.unpivot([], [f"c{i}" for i in range(len(columns))], "column", "value")
    counted = tall.filter("value is not null").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    # Short tags travel through the shuffle; names come back after it.
    names = F.array(*[F.lit(c) for c in columns])
    return counted.withColumn("column", F.get(names, F.substring("column", 2, 10).cast("int")))


def tops(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """column, distinct, top, freq: one row per column with a present value.

    ``top`` is the smallest of the most frequent values, in the order of the
    column's own type. Numbers are counted as numbers, everything else as text.
    """
    columns = atomic_columns(df) if columns is None else list(columns)
    kinds = {c: type_of(df, c) for c in columns}
    whole = [c for c in columns if isinstance(kinds[c], INTEGRAL)]
    broken = [c for c in columns if isinstance(kinds[c], FRACTIONAL)]
    other = [c for c in columns if c not in whole and c not in broken]
    exact = [c for c in other if isinstance(kinds[c], T.DecimalType)]
    floats = [c for c in broken if isinstance(kinds[c], T.FloatType)]
    name, v = F.col("column"), F.col("value")
    parts = []
    if whole:
        parts.append(_tops(_counted(df, whole, [col(c).cast("bigint") for c in whole]), v, v.cast("string")))
    if broken:
        shown = v.cast("string")
        if floats:
            shown = F.when(name.isin(*floats), v.cast("float").cast("string")).otherwise(shown)
        counted = _counted(df, broken, [value(df, c).cast("double") + F.lit(0.0) for c in broken])
        parts.append(_tops(counted, v, shown))
    if other:
        order = F.struct(F.when(name.isin(*exact), v.try_cast("double")), v) if exact else v
        parts.append(_tops(long_counts(df, other), order, v))
    if not parts:
        shape = "column string, distinct bigint, top string, freq bigint"
        return df.sparkSession.createDataFrame([], shape)
    return reduce(DataFrame.unionByName, parts)


def _tops(counted: DataFrame, order: Column, shown: Column) -> DataFrame:
    best = F.min(F.struct((-F.col("n")).alias("n"), order.alias("order"), shown.alias("shown")))
    return (
        counted.groupBy("column")
        .agg(F.count(F.lit(1)).alias("distinct"), best.alias("best"))
        .select("column", "distinct", F.col("best.shown").alias("top"), (-F.col("best.n")).alias("freq"))
    )


def fit_modes(df: DataFrame, columns: Sequence[str]) -> dict[str, str | None]:
    """Most frequent value of each column as text (one row per column)."""
    found = {r["column"]: r["top"] for r in tops(df, columns).collect()}
    return {c: found.get(c) for c in columns}
