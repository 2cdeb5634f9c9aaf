"""Outliers: fit bounds on the table before the step, then drop or clip."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.functions.columns import (
    chosen,
    clip,
    number,
    numeric_columns,
    replace_columns,
    require_numeric,
)
from tabwright.functions.quantiles import fit_quantiles

Bounds = dict[str, tuple[float, float]]
IQR_REACH = 1.5


def _numeric(df: DataFrame, columns: Sequence[str] | None) -> list[str]:
    names = chosen(df, columns, numeric_columns(df))
    require_numeric(df, names)
    return names


def fit_iqr(df: DataFrame, columns: Sequence[str] | None = None, accuracy: int | None = None) -> Bounds:
    """Quartiles widened by 1.5 times their distance; no spread, no bounds."""
    quartiles = fit_quantiles(df, {c: [0.25, 0.75] for c in _numeric(df, columns)}, accuracy)
    bounds: Bounds = {}
    for c, (q1, q3) in quartiles.items():
        if q1 is not None and q3 != q1:
            reach = IQR_REACH * (q3 - q1)
            bounds[c] = (q1 - reach, q3 + reach)
    return bounds


def fit_moments(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and sample deviation of columns that vary."""
    if not columns:
        return {}
    aggs = []
    for i, c in enumerate(columns):
        aggs += [F.avg(number(df, c)).alias(f"m{i}"), F.stddev_samp(number(df, c)).alias(f"s{i}")]
    row = df.agg(*aggs).first()
    return {c: (row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(columns) if row[f"s{i}"]}


def fit_zscore(df: DataFrame, columns: Sequence[str] | None = None, threshold: float | None = 3) -> Bounds:
    """mean ± threshold sample deviations."""
    t = threshold or 3
    moments = fit_moments(df, _numeric(df, columns))
    return {c: (m - t * s, m + t * s) for c, (m, s) in moments.items()}


def fit_percentiles(
    df: DataFrame, columns: Sequence[str] | None = None, cutoff: float | None = 1, accuracy: int | None = None
) -> Bounds:
    """The cutoff-th percentile from either end (percent)."""
    low = (cutoff or 1) / 100.0
    fitted = fit_quantiles(df, {c: [low, 1 - low] for c in _numeric(df, columns)}, accuracy)
    return {c: (q[0], q[1]) for c, q in fitted.items() if q[0] is not None}


def remove_outside(df: DataFrame, bounds: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Keep rows whose every bounded value is inside or missing."""
    tests = []
    for c, (low, high) in bounds.items():
        x = number(df, c)
        tests.append(x.isNull() | x.between(low, high))
    return df.filter(reduce(lambda a, b: a & b, tests)) if tests else df


def cap_outside(df: DataFrame, bounds: Mapping[str, tuple[float, float]]) -> DataFrame:
    return replace_columns(df, {c: clip(number(df, c), low, high) for c, (low, high) in bounds.items()})


def iqr_remove(df: DataFrame, columns: Sequence[str] | None = None, accuracy: int | None = None) -> DataFrame:
    return remove_outside(df, fit_iqr(df, columns, accuracy))


def iqr_cap(df: DataFrame, columns: Sequence[str] | None = None, accuracy: int | None = None) -> DataFrame:
    return cap_outside(df, fit_iqr(df, columns, accuracy))


def zscore_remove(df: DataFrame, columns: Sequence[str] | None = None, threshold: float | None = 3) -> DataFrame:
    """Drop rows with any |x - mean| / deviation above the threshold."""
    t = threshold or 3
    tests = []
    for c, (m, s) in fit_moments(df, _numeric(df, columns)).items():
        x = number(df, c)
        tests.append(x.isNull() | (F.abs((x - F.lit(m)) / F.lit(s)) <= F.lit(float(t))))
    return df.filter(reduce(lambda a, b: a & b, tests)) if tests else df


def zscore_cap(df: DataFrame, columns: Sequence[str] | None = None, threshold: float | None = 3) -> DataFrame:
    return cap_outside(df, fit_zscore(df, columns, threshold))


def percentile_cap(
    df: DataFrame, columns: Sequence[str] | None = None, cutoff: float | None = 1, accuracy: int | None = None
) -> DataFrame:
    return cap_outside(df, fit_percentiles(df, columns, cutoff, accuracy))
