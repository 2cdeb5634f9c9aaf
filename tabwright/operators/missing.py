"""Missing values: tokens, fills, drops and bulk imputation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.functions.columns import (
    categorical_columns,
    chosen,
    col,
    is_numeric,
    missing,
    number,
    numeric_columns,
    python_strip,
    replace_columns,
    require_columns,
    require_numeric,
    text_columns,
    type_of,
    value,
)
from tabwright.functions.counts import fit_modes
from tabwright.functions.ordered import Running, with_running
from tabwright.functions.quantiles import fit_quantiles, quantiles_beside
from tabwright.operators.filters import any_missing

# The texts that stand for a missing value by default.
MISSING_TOKENS = ("", " ", "NA", "N/A", "na", "null", "NULL", "None", "?", "-")
UNKNOWN = "Unknown"


def standardize_missing(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    tokens: Sequence[str] = MISSING_TOKENS,
    trim: bool = True,
) -> DataFrame:
    """Turn missing-like texts into NULL; trimmed text is kept trimmed."""
    new = {}
    for c in chosen(df, columns, text_columns(df)):
        x = python_strip(col(c)) if trim else col(c)
        new[c] = F.when(~x.isin(*tokens), x) if tokens else x
    return replace_columns(df, new)


def fill_with(df: DataFrame, fills: Mapping[str, Any]) -> DataFrame:
    """Put a value into the gaps of each named column.

    A fractional fill makes a whole-number column fractional, and a text fill
    makes any column text; a fill of None leaves the column as it is.
    """
    require_columns(df, fills)
    new = {}
    for c, fill in fills.items():
        if fill is None:
            continue
        kind = type_of(df, c)
        x = value(df, c)
        if isinstance(kind, T.StringType):
            new[c] = F.coalesce(x, F.lit(str(fill)))
        elif isinstance(kind, T.BooleanType) and isinstance(fill, bool):
            new[c] = F.coalesce(x, F.lit(fill))
        elif isinstance(kind, T.NumericType) and isinstance(fill, (int, float)):
            if isinstance(kind, T.IntegralType) and float(fill).is_integer() and not isinstance(fill, float):
                new[c] = F.coalesce(x, F.lit(fill).cast(kind))
            elif isinstance(kind, T.DecimalType):
                new[c] = F.coalesce(x, F.lit(fill).cast(kind))
            else:
                new[c] = F.coalesce(x.cast("double"), F.lit(float(fill)))
        else:
            new[c] = F.coalesce(x.cast("string"), F.lit(str(fill)))
    return replace_columns(df, new)


def fit_means(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    require_numeric(df, columns)
    if not columns:
        return {}
    row = df.agg(*[F.avg(number(df, c)).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    return {c: row[f"m{i}"] for i, c in enumerate(columns)}


def fit_medians(df: DataFrame, columns: Sequence[str], accuracy: int | None = None) -> dict[str, float | None]:
    require_numeric(df, columns)
    return {c: q[0] for c, q in fit_quantiles(df, {c: [0.5] for c in columns}, accuracy).items()}


def _typed_mode(df: DataFrame, column: str, text: str | None) -> Any:
    """A fitted mode (text) back in the type of its column."""
    if text is None:
        return None
    kind = type_of(df, column)
    if isinstance(kind, T.IntegralType):
        return int(text)
    if isinstance(kind, T.NumericType):
        return float(text)
    if isinstance(kind, T.BooleanType):
        return text == "true"
    return text


def fill_mean(df: DataFrame, column: str) -> DataFrame:
    return fill_with(df, fit_means(df, [column]))


def fill_median(df: DataFrame, column: str, accuracy: int | None = None) -> DataFrame:
    return fill_with(df, fit_medians(df, [column], accuracy))


def fill_zero(df: DataFrame, column: str) -> DataFrame:
    return fill_with(df, {column: 0})


def fill_constant(df: DataFrame, column: str, constant: Any) -> DataFrame:
    """Fill with a given value: not blank, and a number for numeric columns."""
    require_columns(df, [column])
    text = str(constant).strip()
    if not text:
        raise ValueError("the constant must not be blank")
    return fill_with(df, {column: float(text) if is_numeric(df, column) else text})


def fill_mode(df: DataFrame, column: str) -> DataFrame:
    """Fill with the smallest most frequent value, or Unknown without any."""
    require_columns(df, [column])
    top = _typed_mode(df, column, fit_modes(df, [column])[column])
    return _fill_typed(df, column, UNKNOWN if top is None else top)


def _fill_typed(df: DataFrame, column: str, fill: Any) -> DataFrame:
    kind = type_of(df, column)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)) and fill != UNKNOWN:
        return replace_columns(df, {column: F.coalesce(col(column), F.lit(fill).cast(kind))})
    return fill_with(df, {column: fill})


def fill_unknown(df: DataFrame, column: str) -> DataFrame:
    return fill_with(df, {column: UNKNOWN})


def _ordered_fill(df, columns, order_by, partition_by, ranges, kind):
    columns = [columns] if isinstance(columns, str) else list(columns)
    require_columns(df, [*columns, *order_by, *partition_by])
    base = replace_columns(df, {c: value(df, c) for c in columns})
    specs = [Running(f"__fill{i}", kind, c) for i, c in enumerate(columns)]
    filled = with_running(base, partition_by, order_by, specs, ranges)
    back = {c: F.col(f"__fill{i}") for i, c in enumerate(columns)}
    return filled.select(*[back[c].alias(c) if c in back else col(c) for c in df.columns])


def forward_fill(
    df: DataFrame,
    columns: str | Sequence[str],
    order_by: Sequence[str],
    partition_by: Sequence[str] = (),
    ranges: int | None = None,
) -> DataFrame:
    """Each gap takes the last present value before it; leading gaps stay."""
    return _ordered_fill(df, columns, list(order_by), list(partition_by), ranges, "last")


def backward_fill(
    df: DataFrame,
    columns: str | Sequence[str],
    order_by: Sequence[str],
    partition_by: Sequence[str] = (),
    ranges: int | None = None,
) -> DataFrame:
    """Each gap takes the next present value after it; trailing gaps stay."""
    return _ordered_fill(df, columns, list(order_by), list(partition_by), ranges, "first")


def drop_missing_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.filter(~any_missing(df, chosen(df, columns, df.columns)))


def fit_missing_counts(df: DataFrame) -> tuple[int, dict[str, int]]:
    row = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(missing(df, c)).alias(f"m{i}") for i, c in enumerate(df.columns)],
    ).first()
    return row["rows"], {c: row[f"m{i}"] for i, c in enumerate(df.columns)}


def drop_sparse_columns(df: DataFrame, threshold: float = 50) -> DataFrame:
    """Keep columns with at most ``threshold`` percent missing."""
    rows, gaps = fit_missing_counts(df)
    keep = [c for c in df.columns if rows and gaps[c] / rows <= threshold / 100.0]
    return df.select(*[col(c) for c in keep])


def fit_imputation(
    df: DataFrame,
    numeric: str = "median",
    categorical: str = "mode",
    accuracy: int | None = None,
) -> dict[str, Any]:
    """Fill value per column with gaps; dates are left alone."""
    if numeric not in ("mean", "median", "mode") or categorical not in ("mode", "unknown"):
        raise ValueError("numeric: mean, median or mode; categorical: mode or unknown")
    names = [*numeric_columns(df), *categorical_columns(df)]
    aggs = [F.count_if(missing(df, c)).alias(f"g{i}") for i, c in enumerate(names)]
    aggs += [F.avg(number(df, c)).alias(f"m{i}") for i, c in enumerate(names) if numeric == "mean" and c in numeric_columns(df)]
    gapped = lambda row: [c for i, c in enumerate(names) if row[f"g{i}"]]
    halves = {c: [0.5] for c in numeric_columns(df)} if numeric == "median" else {}
    medians, row = quantiles_beside(df, halves, accuracy, [F.count(F.lit(1)).alias("rows"), *aggs], gapped)
    numbers = [c for c in gapped(row) if c in numeric_columns(df)]
    labels = [c for c in gapped(row) if c not in numbers]
    fills: dict[str, Any] = {}
    if numeric == "mean":
        fills.update({c: row[f"m{names.index(c)}"] for c in numbers})
    elif numeric == "median":
        fills.update({c: medians[c][0] for c in numbers})
    counted = (numbers if numeric == "mode" else []) + (labels if categorical == "mode" else [])
    if counted:
        modes = fit_modes(df, counted)
        fills.update({c: _typed_mode(df, c, modes[c]) for c in counted})
    for c in labels:
        if fills.get(c) is None:
            fills[c] = UNKNOWN
    return fills


def impute_all(
    df: DataFrame,
    numeric: str = "median",
    categorical: str = "mode",
    accuracy: int | None = None,
) -> DataFrame:
    return fill_with(df, fit_imputation(df, numeric, categorical, accuracy))


def columns_with_missing(df: DataFrame) -> DataFrame:
    """column, missing: only columns that have gaps."""
    from tabwright.operators.profile import missing_by_column

    return missing_by_column(df).filter("missing > 0").select("column", "missing")


