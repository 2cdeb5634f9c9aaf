"""Duplicate rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.functions.columns import col, value


def _unified(df: DataFrame) -> DataFrame:
    """NaN as NULL, so that equal gaps are equal."""
    return df.select(*[value(df, c).alias(c) for c in df.columns])


def drop_duplicates(df: DataFrame) -> DataFrame:
    """One row of each set of identical rows; missing equals missing."""
    return _unified(df).dropDuplicates()


def row_copies(df: DataFrame) -> DataFrame:
    """Distinct rows with their number of copies, collapsed before the shuffle."""
    flat = _unified(df)
    return flat.groupBy(*[col(c) for c in flat.columns]).agg(F.count(F.lit(1)).alias("__copies"))


def duplicate_stats(df: DataFrame) -> DataFrame:
    """rows, duplicate rows (copies after the first) and their percentage."""
    rows = F.coalesce(F.sum("__copies"), F.lit(0))
    extra = F.coalesce(F.sum(F.col("__copies") - 1), F.lit(0))
    return row_copies(df).agg(rows.alias("rows"), extra.alias("duplicate_rows")).select(
        "rows",
        "duplicate_rows",
        F.when(F.col("rows") > 0, F.round(F.col("duplicate_rows") * 100.0 / F.col("rows"), 1))
        .otherwise(F.lit(0.0))
        .alias("duplicate_pct"),
    )
