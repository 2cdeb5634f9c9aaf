"""Scaling of numeric columns and encoding of text columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.functions.columns import (
    chosen,
    col,
    missing,
    number,
    numeric_columns,
    replace_columns,
    require_columns,
    require_numeric,
    text_columns,
)
from tabwright.functions.counts import long_counts
from tabwright.functions.joins import join_lookup
from tabwright.functions.ordered import Running, with_running
from tabwright.session import written

def fit_scale(
    df: DataFrame, method: str, columns: Sequence[str] | None = None, exclude: Sequence[str] = ()
) -> dict[str, tuple[float, float]]:
    """(shift, width) per column; columns with any gap are left out.

    standard: mean and population deviation; minmax: least value and range.
    """
    names = [c for c in chosen(df, columns, numeric_columns(df)) if c not in exclude]
    require_numeric(df, names)
    if not names:
        return {}
    aggs = []
    for i, c in enumerate(names):
        x = number(df, c)
        if method == "standard":
            shift, width = F.avg(x), F.stddev_pop(x)
        elif method == "minmax":
            shift, width = F.min(x), F.max(x) - F.min(x)
        else:
            raise ValueError("method: standard or minmax")
        aggs += [F.count_if(missing(df, c)).alias(f"g{i}"), shift.alias(f"a{i}"), width.alias(f"w{i}")]
    row = df.agg(*aggs).first()
    return {
        c: (row[f"a{i}"], row[f"w{i}"])
        for i, c in enumerate(names)
        if row[f"g{i}"] == 0 and row[f"a{i}"] is not None
    }


def apply_scale(df: DataFrame, fitted: Mapping[str, tuple[float, float]]) -> DataFrame:
    """(x - shift) / width; a column without width becomes 0."""
    new = {}
    for c, (shift, width) in fitted.items():
        x = number(df, c)
        new[c] = (x - F.lit(shift)) / F.lit(width) if width else x - F.lit(shift)
    return replace_columns(df, new)


def standard_scale(df: DataFrame, columns: Sequence[str] | None = None, exclude: Sequence[str] = ()) -> DataFrame:
    return apply_scale(df, fit_scale(df, "standard", columns, exclude))


def minmax_scale(df: DataFrame, columns: Sequence[str] | None = None, exclude: Sequence[str] = ()) -> DataFrame:
    return apply_scale(df, fit_scale(df, "minmax", columns, exclude))


#: Values of a column that the dense form takes at most.
MAX_CATEGORIES = 1000


def fit_one_hot(
    df: DataFrame, columns: Sequence[str] | None = None, max_categories: int = MAX_CATEGORIES
) -> dict[str, list[str]]:
    """Sorted values per text column, each a column of the result's schema.

    Columns of more than ``max_categories`` values raise before any is fetched;
    :func:`one_hot_sparse` encodes those.
    """
    names = chosen(df, columns, text_columns(df))
    if not names:
        return {}
    found: dict[str, list[str]] = {c: [] for c in names}
    values = long_counts(df, names).select("column", "value")
    many = values.groupBy("column").count().filter(F.col("count") > max_categories)
    wide = sorted(r["column"] for r in many.select("column").collect())
    if wide:
        raise ValueError(f"more than {max_categories} values in: {', '.join(wide)}; one_hot_sparse takes them")
    for r in values.collect():
        found[r["column"]].append(r["value"])
    return {c: sorted(v) for c, v in found.items()}


def apply_one_hot(df: DataFrame, fitted: Mapping[str, Sequence[str]], drop_first: bool = False) -> DataFrame:
    """Boolean columns col_value at the end in place of each source column."""
    kept = [col(c) for c in df.columns if c not in fitted]
    taken = [c for c in df.columns if c not in fitted]
    flags = []
    for c, values in fitted.items():
        for v in list(values)[1 if drop_first else 0 :]:
            name, n = f"{c}_{v}", 2
            while name in taken:
                name, n = f"{c}_{v}_{n}", n + 1
            taken.append(name)
            flags.append(F.coalesce(col(c) == F.lit(v), F.lit(False)).alias(name))
    return df.select(*kept, *flags)


def one_hot(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    drop_first: bool = False,
    max_categories: int = MAX_CATEGORIES,
) -> DataFrame:
    return apply_one_hot(df, fit_one_hot(df, columns, max_categories), drop_first)


def fit_label_codes(
    df: DataFrame, columns: Sequence[str] | None = None, ranges: int | None = None
) -> dict[str, DataFrame]:
    """Per column a table value -> code (sorted order from 0), rows behind it.

    All columns are numbered together, keyed by column, range by range: the
    dictionary may be as large as the columns are.
    """
    names = chosen(df, columns, text_columns(df))
    require_columns(df, names)
    if not names:
        return {}
    tall = df.select(*[col(c).alias(f"c{i}") for i, c in enumerate(names)])
    tall = tall.unpivot([], tall.columns, "__of", "__value").filter("__value is not null")
    counted = tall.groupBy("__of", "__value").agg(F.count(F.lit(1)).alias("__rows"))
    counted = written(counted.withColumn("__one", F.lit(1).cast("bigint")), "values")
    numbered = with_running(counted, ["__of"], ["__value"], [Running("__upto", "sum", "__one")], ranges)
    codes = written(numbered.withColumn("__code", F.col("__upto") - 1).select("__of", "__value", "__code", "__rows"), "codes")
    return {
        c: codes.filter(F.col("__of") == f"c{i}").select(F.col("__value").alias(c), "__code", "__rows")
        for i, c in enumerate(names)
    }


def apply_label_codes(df: DataFrame, codes: Mapping[str, DataFrame]) -> DataFrame:
    """Replace values by codes; missing and unknown values become -1."""
    out = df
    for i, (c, table) in enumerate(codes.items()):
        out = join_lookup(out, table.withColumnRenamed("__code", f"__code{i}"), [c], weight="__rows", stored=True)
    back = {c: F.coalesce(F.col(f"__code{i}"), F.lit(-1)) for i, c in enumerate(codes)}
    return out.select(*[back[c].alias(c) if c in back else col(c) for c in df.columns])


def label_encode(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return apply_label_codes(df, fit_label_codes(df, columns))


def one_hot_sparse(
    df: DataFrame, columns: Sequence[str] | None = None, drop_first: bool = False, ranges: int | None = None
) -> DataFrame:
    """Indicators of text columns of any number of values, one vector a column.

    Each source column becomes ``{column}_hot``: size (values of the column, less one
    with ``drop_first``) and indices (the place of the row's value among the sorted
    ones; none for a missing value, and for the first one with ``drop_first``). Codes
    are joined as in :func:`label_encode`: no value reaches the driver.
    """
    codes = fit_label_codes(df, columns, ranges)
    coded = apply_label_codes(df, codes)
    first = int(drop_first)
    hot = []
    for c, table in codes.items():
        size = max(table.count() - first, 0)
        place = col(c).cast("bigint") - first
        indices = F.when(place >= 0, F.array(place)).otherwise(F.array().cast("array<bigint>"))
        hot.append(F.struct(F.lit(size).cast("bigint").alias("size"), indices.alias("indices")).alias(f"{c}_hot"))
    return coded.select(*[col(c) for c in df.columns if c not in codes], *hot)
