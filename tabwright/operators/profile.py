"""Profiles: one row per column, in one pass for the plain statistics."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.functions.columns import (
    atomic_columns,
    categorical_columns,
    chosen,
    col,
    datetime_columns,
    dtype_name,
    missing,
    number,
    numeric_columns,
    replace_columns,
    require_numeric,
    type_of,
    value,
)
from tabwright.functions.counts import tops
from tabwright.functions.quantiles import fit_quantiles, quantiles_beside
from tabwright.operators.dedup import row_copies

# Times are profiled as their microseconds since this moment.
EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"
# Stated error of a sketched distinct count.
RSD = 0.02


def _aggregates(parts: dict[str, dict[str, Column]]) -> list[Column]:
    fields = list(next(iter(parts.values()))) if parts else []
    named = [p[f].alias(f"f{i}_{j}") for i, p in enumerate(parts.values()) for j, f in enumerate(fields)]
    return [F.count(F.lit(1)).alias("rows"), *named]


def _per_column(
    df: DataFrame, parts: dict[str, dict[str, Column]], more: dict[str, dict] | None = None, row: Row | None = None
) -> DataFrame:
    """One aggregate over the table, turned into one row per column.

    ``parts[column][field]`` is an aggregate; every column has the same fields.
    ``more`` adds fields whose values are known, ``row`` the aggregates where
    they were taken already. The single wide row is turned on the driver: it
    has a few numbers for each column.
    """
    fields = list(next(iter(parts.values()))) if parts else []
    known = list(next(iter(more.values()))) if more else []
    wide = df.agg(*_aggregates(parts))
    row = row or wide.first()
    entries = [
        (
            c,
            dtype_name(df, c),
            row["rows"],
            *[row[f"f{i}_{j}"] for j in range(len(fields))],
            *[more[c][k] for k in known],
        )
        for i, c in enumerate(parts)
    ]
    types = [wide.schema[f"f0_{j}"].dataType.simpleString() for j in range(len(fields))]
    shape = [f"{f} {t}" for f, t in zip(fields, types)] + [f"{k} double" for k in known]
    schema = ", ".join(["column string", "dtype string", "rows bigint", *shape])
    return df.sparkSession.createDataFrame(entries, schema)


def _share(part: Column, whole: Column, digits: int) -> Column:
    return F.when(whole > 0, F.round(part * 100.0 / whole, digits)).otherwise(F.lit(0.0))


def missing_by_column(df: DataFrame) -> DataFrame:
    """column, dtype, missing, missing_pct (2 decimals)."""
    table = _per_column(df, {c: {"missing": F.count_if(missing(df, c))} for c in df.columns})
    return table.select(
        "column", "dtype", "missing", _share(F.col("missing"), F.col("rows"), 2).alias("missing_pct")
    )


def missing_total(df: DataFrame) -> DataFrame:
    """Missing cells of the whole table and the table's size."""
    gaps = [F.count_if(missing(df, c)).alias(f"m{i}") for i, c in enumerate(df.columns)]
    total = sum((F.col(f"m{i}") for i in range(len(df.columns))), F.lit(0))
    return df.agg(F.count(F.lit(1)).alias("rows"), *gaps).select(
        "rows", F.lit(len(df.columns)).cast("bigint").alias("columns"), total.cast("bigint").alias("missing_cells")
    )


def missing_ranked(df: DataFrame) -> DataFrame:
    """Columns with gaps, most gaps first."""
    return (
        missing_by_column(df)
        .filter("missing > 0")
        .select("column", "missing")
        .orderBy(F.desc("missing"), "column")
    )


def column_info(df: DataFrame) -> DataFrame:
    """column, dtype, non_null, missing, unique."""
    names = atomic_columns(df)
    base = _per_column(df, {c: {"missing": F.count_if(missing(df, c))} for c in names})
    unique = tops(df, names).select(F.col("column").alias("__c"), "distinct")
    return base.join(F.broadcast(unique), F.col("column") == F.col("__c"), "left").select(
        "column",
        "dtype",
        (F.col("rows") - F.col("missing")).alias("non_null"),
        "missing",
        F.coalesce("distinct", F.lit(0)).alias("unique"),
    )


def quality_overview(df: DataFrame) -> DataFrame:
    """rows, columns, missing cells, duplicate rows, numeric / categorical columns.

    All from the distinct rows with their copies: one shuffle of the table.
    """
    copies = row_copies(df)
    gaps = sum((F.when(missing(df, c), 1).otherwise(0) for c in df.columns), F.lit(0))
    return copies.agg(
        F.coalesce(F.sum("__copies"), F.lit(0)).alias("rows"),
        F.lit(len(df.columns)).cast("bigint").alias("columns"),
        F.coalesce(F.sum(gaps * F.col("__copies")), F.lit(0)).alias("missing_cells"),
        F.coalesce(F.sum(F.col("__copies") - 1), F.lit(0)).alias("duplicate_rows"),
        F.lit(len(numeric_columns(df))).cast("bigint").alias("numeric_columns"),
        F.lit(len(categorical_columns(df))).cast("bigint").alias("categorical_columns"),
    )


def _mean(df: DataFrame, name: str) -> Column:
    exact = isinstance(type_of(df, name), T.DecimalType)
    return F.avg(col(name)).cast("double") if exact else F.avg(number(df, name))


def _described(
    df: DataFrame, columns: Sequence[str], accuracy: int | None, counted: Sequence[str]
) -> DataFrame:
    """Counts, moments and quartiles of every named column, tops of ``counted``."""
    numeric = [c for c in columns if c in numeric_columns(df)]
    none = F.max(F.lit(None).cast("double"))
    parts = {}
    for c in columns:
        x = number(df, c) if c in numeric else None
        parts[c] = {
            "missing": F.count_if(missing(df, c)),
            "mean": _mean(df, c) if x is not None else none,
            "std": F.stddev_samp(x) if x is not None else none,
            "min": F.min(x) if x is not None else none,
            "max": F.max(x) if x is not None else none,
        }
    quartiles, row = quantiles_beside(df, {c: [0.25, 0.5, 0.75] for c in numeric}, accuracy, _aggregates(parts))
    more = {c: dict(zip(("q1", "median", "q3"), quartiles.get(c, [None, None, None]))) for c in columns}
    base = _per_column(df, parts, more, row).withColumn("numeric", F.col("column").isin(*numeric))
    counts = tops(df, counted).withColumnRenamed("column", "__c")
    return base.join(F.broadcast(counts), F.col("column") == F.col("__c"), "left").drop("__c")


def column_summary(df: DataFrame, accuracy: int | None = None) -> DataFrame:
    """Profile table: counts for all columns, five numbers for numeric ones,
    the smallest most frequent value for the others."""
    names = atomic_columns(df)
    table = _described(df, names, accuracy, names)
    stats = [F.round(s, 4).alias(s) for s in ("min", "q1", "median", "q3", "max", "mean", "std")]
    return table.select(
        "column",
        "dtype",
        (F.col("rows") - F.col("missing")).alias("non_null"),
        "missing",
        _share(F.col("missing"), F.col("rows"), 1).alias("missing_pct"),
        F.coalesce("distinct", F.lit(0)).alias("unique"),
        *stats,
        F.when(F.col("numeric"), F.lit("")).otherwise(F.coalesce("top", F.lit(""))).alias("top_value"),
    )


def _micros(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The frame with the named times as microseconds, in decimals: their mean is exact."""
    new = {}
    for c in names:
        wall = col(c).cast("timestamp_ntz")
        new[c] = F.timestamp_diff("MICROSECOND", F.expr(EPOCH), wall).cast("decimal(20,0)")
    return replace_columns(df, new) if new else df


def describe_all(df: DataFrame, accuracy: int | None = None) -> DataFrame:
    """count; unique, top, freq of labels; moments and quartiles of numbers and times.

    Times have their mean, min, q1, median, q3 and max in columns of their own,
    as moments without a zone.
    """
    names, times = atomic_columns(df), datetime_columns(df)
    frame = _micros(df, times)
    counted = [c for c in names if c not in numeric_columns(frame)]
    table = _described(frame, names, accuracy, counted)
    label, time = ~F.col("numeric"), F.col("column").isin(*times)
    stats = ("mean", "std", "min", "q1", "median", "q3", "max")
    moment = lambda c: F.timestamp_add("MICROSECOND", F.round(c).cast("bigint"), F.expr(EPOCH))
    return table.select(
        "column",
        (F.col("rows") - F.col("missing")).alias("count"),
        F.when(label, F.coalesce("distinct", F.lit(0))).alias("unique"),
        F.when(label, F.col("top")).alias("top"),
        F.when(label, F.col("freq")).alias("freq"),
        *[F.when(~time, F.col(c)).alias(c) for c in stats],
        *[F.when(time, moment(c)).alias(f"time_{c}") for c in stats if c != "std"],
    )


def _matrix(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Values, 0 where missing, and where they are present."""
    x = part.to_numpy(float)
    there = ~np.isnan(x)
    return np.where(there, x, 0.0), there


def _pair_means(n: int):
    """Per task and pair (i, j): common rows, sum, least and largest of column i over them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count, total = np.zeros((n, n)), np.zeros((n, n))
        least, most = np.full((n, n), np.inf), np.full((n, n), -np.inf)
        for part in batches:
            x, there = _matrix(part)
            for j in range(n):
                both = there & there[:, j : j + 1]
                count[:, j] += both.sum(0)
                total[:, j] += np.where(both, x, 0.0).sum(0)
                np.minimum(least[:, j], np.where(both, x, np.inf).min(0, initial=np.inf), out=least[:, j])
                np.maximum(most[:, j], np.where(both, x, -np.inf).max(0, initial=-np.inf), out=most[:, j])
        i, j = np.indices((n, n))
        yield pd.DataFrame(
            {"i": i.ravel(), "j": j.ravel(), "n": count.ravel(), "s": total.ravel(), "low": least.ravel(), "high": most.ravel()}
        )

    return run


def _pair_products(centre: np.ndarray):
    """Per task and pair: sums and products of both columns, each less its mean over the pair's rows."""
    n = len(centre)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((5, n, n))
        for part in batches:
            x, there = _matrix(part)
            for j in range(n):
                both = there & there[:, j : j + 1]
                a = np.where(both, x - centre[:, j], 0.0)
                b = np.where(both, x[:, j : j + 1] - centre[j, :], 0.0)
                for k, v in enumerate((a, b, a * a, b * b, a * b)):
                    sums[k, :, j] += v.sum(0)
        i, j = np.indices((n, n))
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), **{f"v{k}": v.ravel() for k, v in enumerate(sums)}})

    return run


def _correlations(flat: DataFrame) -> np.ndarray:
    """Correlation of each pair of columns over its common rows; NaN if there is none.

    The first pass takes each pair's own means, the second one products of what
    is left. A column that is constant over a pair's rows has no correlation.
    """
    n = len(flat.columns)
    means = (
        flat.mapInPandas(_pair_means(n), "i int, j int, n double, s double, low double, high double")
        .groupBy("i", "j")
        .agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.min("low").alias("low"), F.max("high").alias("high"))
    )
    count, total, varies = np.zeros((n, n)), np.zeros((n, n)), np.zeros((n, n), bool)
    for r in means.collect():  # one number for each pair of columns
        at = r["i"], r["j"]
        count[at], total[at], varies[at] = r["n"], r["s"], r["low"] < r["high"]
    centre = np.divide(total, count, out=np.zeros((n, n)), where=count > 0)
    fields = [f"v{k}" for k in range(5)]
    products = (
        flat.mapInPandas(_pair_products(centre), "i int, j int, " + ", ".join(f"{v} double" for v in fields))
        .groupBy("i", "j")
        .agg(*[F.sum(v).alias(v) for v in fields])
    )
    out = np.full((n, n), np.nan)
    for r in products.collect():
        at = i, j = r["i"], r["j"]
        if count[at] and varies[i, j] and varies[j, i]:
            sa, sb, aa, bb, ab = (r[v] for v in fields)
            va, vb = aa - sa * sa / count[at], bb - sb * sb / count[at]
            if va > 0 and vb > 0:
                out[at] = (ab - sa * sb / count[at]) / (math.sqrt(va) * math.sqrt(vb))
    return np.clip(out, -1.0, 1.0)


def _correlated(df: DataFrame, columns: Sequence[str] | None, n: int) -> list[str]:
    """The columns asked for, all of them, or the first n numeric ones."""
    names = chosen(df, columns, numeric_columns(df)[:n])
    require_numeric(df, names)
    if len(names) < 2:
        raise ValueError("at least two numeric columns are needed")
    return names


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None, n: int = 30, digits: int = 2) -> DataFrame:
    """row, col, r for every pair of columns, over rows where both are present.

    ``n`` bounds the columns taken by default, not those asked for.
    """
    names = _correlated(df, columns, n)
    r = _correlations(df.select(*[number(df, c).alias(f"c{i}") for i, c in enumerate(names)]))
    cells = [
        (a, b, None if np.isnan(r[i, j]) else float(r[i, j])) for i, a in enumerate(names) for j, b in enumerate(names)
    ]
    table = df.sparkSession.createDataFrame(cells, "row string, col string, r double")
    return table.withColumn("r", F.round("r", digits) + F.lit(0.0))


def correlation_wide(df: DataFrame, columns: Sequence[str] | None = None, n: int = 30, digits: int = 2) -> DataFrame:
    """The same matrix with one column per variable."""
    names = _correlated(df, columns, n)
    long = correlation_matrix(df, names, n, digits)
    return long.groupBy(F.col("row").alias("column")).pivot("col", names).agg(F.first("r"))


def quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], accuracy: int | None = None
) -> DataFrame:
    """column, prob, quantile (linear between ranks)."""
    require_numeric(df, columns)
    fitted = fit_quantiles(df, {c: list(probs) for c in columns}, accuracy)
    rows = [(c, float(p), q) for c in columns for p, q in zip(probs, fitted[c])]
    return df.sparkSession.createDataFrame(rows, "column string, prob double, quantile double")


def distinct_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """column, unique: distinct present values."""
    names = chosen(df, columns, atomic_columns(df))
    found = tops(df, names).select(F.col("column").alias("__c"), "distinct")
    every = df.sparkSession.createDataFrame([(c,) for c in names], "column string")
    return every.join(F.broadcast(found), F.col("column") == F.col("__c"), "left").select(
        "column", F.coalesce("distinct", F.lit(0)).alias("unique")
    )


def approx_distinct_counts(df: DataFrame, columns: Sequence[str] | None = None, rsd: float = RSD) -> DataFrame:
    """The same from a sketch of the values' 64-bit hashes: no shuffle of values."""
    names = chosen(df, columns, atomic_columns(df))
    hashed = lambda c: F.when(~missing(df, c), F.xxhash64(value(df, c)))
    parts = {c: {"unique": F.approx_count_distinct(hashed(c), rsd)} for c in names}
    return _per_column(df, parts).select("column", "unique")


def modes(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """column, mode (as text), freq: the smallest most frequent value."""
    names = chosen(df, columns, atomic_columns(df))
    return tops(df, names).select("column", F.col("top").alias("mode"), "freq")
