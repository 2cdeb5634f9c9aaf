"""The aggregate behind each chart: bounded output, whatever the table's size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwright.functions.columns import col, is_numeric, number, require_columns, require_numeric, value
from tabwright.functions.counts import most_frequent, value_counts
from tabwright.functions.joins import join_lookup
from tabwright.functions.quantiles import GroupQuantiles, group_quantiles, sketched_quantiles
from tabwright.operators.features import as_datetime
from tabwright.operators.profile import correlation_matrix

OTHER = "Other"
PIE_SLICES = 20


def _ends(df: DataFrame, xs: Sequence[Column]) -> list[tuple[float, float] | None]:
    """Least and greatest value of each expression; a single value gets ±0.5."""
    aggs = []
    for i, x in enumerate(xs):
        aggs += [F.min(x).alias(f"a{i}"), F.max(x).alias(f"b{i}")]
    row = df.agg(*aggs).first()
    out: list[tuple[float, float] | None] = []
    for i in range(len(xs)):
        a, b = row[f"a{i}"], row[f"b{i}"]
        out.append(None if a is None else (a, b) if a < b else (a - 0.5, b + 0.5))
    return out


def bin_number(x: Column, low: float, high: float, bins: int) -> Column:
    """Equal-width bin from 0; the last bin is closed."""
    place = F.floor((x - F.lit(low)) / F.lit(high - low) * F.lit(bins))
    return F.when(x.isNotNull(), F.greatest(F.least(place, F.lit(bins - 1)), F.lit(0)).cast("bigint"))


def _bin_counts(df: DataFrame, x: Column, ends: tuple[float, float], bins: int, group: Column | None) -> DataFrame:
    """(group, bin, count) with empty bins, by two small aggregates."""
    low, high = ends
    keys = [group.alias("group")] if group is not None else []
    names = ["group"] if group is not None else []
    counted = (
        df.select(*keys, bin_number(x, low, high, bins).alias("bin"))
        .filter("bin is not null")
        .groupBy(*names, "bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    filled = counted.groupBy(*names).agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"))
    spread = filled.select(*names, "m", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(bins - 1).cast("bigint"))).alias("bin"))
    return spread.select(*names, "bin", F.coalesce(F.try_element_at("m", F.col("bin")), F.lit(0)).alias("count"))


def histogram(df: DataFrame, column: str, bins: int = 20, group: str | None = None) -> DataFrame:
    """[group,] bin, low, high, count; a column that is not numeric is counted by value."""
    require_columns(df, [column] + ([group] if group else []))
    if not is_numeric(df, column):
        return value_counts(df, column)
    x = number(df, column)
    ends = _ends(df, [x])[0] or (0.0, 1.0)
    width = (ends[1] - ends[0]) / bins
    counts = _bin_counts(df, x, ends, bins, value(df, group) if group else None)
    edges = [
        (F.lit(ends[0]) + F.col("bin") * F.lit(width)).alias("low"),
        (F.lit(ends[0]) + (F.col("bin") + 1) * F.lit(width)).alias("high"),
    ]
    return counts.select(*(["group"] if group else []), "bin", *edges, "count")


def time_histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """bin, start, count over the parsed timestamps."""
    seconds = F.unix_micros(as_datetime(df, column).cast("timestamp")) / F.lit(1e6)
    ends = _ends(df, [seconds])[0] or (0.0, 1.0)
    width = (ends[1] - ends[0]) / bins
    counts = _bin_counts(df, seconds, ends, bins, None)
    start = F.lit(ends[0]) + F.col("bin") * F.lit(width)
    return counts.select("bin", F.timestamp_seconds(F.floor(start)).cast("timestamp_ntz").alias("start"), "count")


def after_counts(df: DataFrame, column: str) -> DataFrame:
    """Bars of a new feature that is not numeric, missing included."""
    return value_counts(df, column)


def bar_average(df: DataFrame, x: str, y: str, group: str | None = None, bins: int = 20) -> DataFrame:
    """x [, group], average, n; a numeric x is cut into bins."""
    require_columns(df, [x] + ([group] if group else []))
    require_numeric(df, [y])
    if is_numeric(df, x):
        low, high = _ends(df, [number(df, x)])[0] or (0.0, 1.0)
        key = bin_number(number(df, x), low, high, bins)
    else:
        key = value(df, x)
    keys = [key.alias("x")] + ([value(df, group).alias("group")] if group else [])
    return df.groupBy(*keys).agg(F.avg(number(df, y)).alias("average"), F.count(number(df, y)).alias("n"))


def _grouped(df: DataFrame, y: str, by: Sequence[str]) -> DataFrame:
    require_columns(df, by)
    require_numeric(df, [y])
    return df.select(*[value(df, c).alias(c) for c in by], number(df, y).alias("__y"))


def _quantiles(
    rows: DataFrame, by: Sequence[str], probs: Sequence[float], names: Sequence[str], ranges: int | None, accuracy: int | None
) -> GroupQuantiles:
    if accuracy is not None:
        return sketched_quantiles(rows, by, "__y", probs, names, accuracy)
    return group_quantiles(rows, by, "__y", probs, names, ranges)


def _fenced(df: DataFrame, y: str, by: Sequence[str], ranges: int | None, accuracy: int | None) -> DataFrame:
    """The counted values with the quartiles and fences of their group."""
    found = _quantiles(_grouped(df, y, by), by, [0.25, 0.5, 0.75], ["q1", "median", "q3"], ranges, accuracy)
    fences = found.table.withColumns(
        {
            "lower": F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")),
            "upper": F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")),
        }
    )
    return join_lookup(found.values, fences.withColumnRenamed("n", "__size"), by, weight="__size")


def box_stats(
    df: DataFrame, y: str, by: Sequence[str] = (), ranges: int | None = None, accuracy: int | None = None
) -> DataFrame:
    """n, quartiles, whiskers and number of outliers per group.

    Quartiles are exact, or with ``accuracy`` those of a sketch of so many items in
    each group: two scans and no shuffle of values. Whiskers and outliers are exact
    for the quartiles shown.
    """
    by = list(by)
    fenced = _fenced(df, y, by, ranges, accuracy)
    inside = F.col("__v").between(F.col("lower"), F.col("upper"))
    return (
        fenced.groupBy(*[col(c) for c in by])
        .agg(
            F.sum("__n").alias("n"),
            *[F.max(q).alias(q) for q in ("q1", "median", "q3")],
            F.min(F.when(inside, F.col("__v"))).alias("whisker_low"),
            F.max(F.when(inside, F.col("__v"))).alias("whisker_high"),
            F.coalesce(F.sum(F.when(~inside, F.col("__n"))), F.lit(0)).alias("outliers"),
        )
        .withColumns(
            {
                "whisker_low": F.least("whisker_low", "q1"),
                "whisker_high": F.greatest("whisker_high", "q3"),
            }
        )
    )


def box_outliers(
    df: DataFrame, y: str, by: Sequence[str] = (), ranges: int | None = None, accuracy: int | None = None
) -> DataFrame:
    """Every value outside its group's fences, with its number of rows; ``accuracy`` as in :func:`box_stats`."""
    by = list(by)
    outside = _fenced(df, y, by, ranges, accuracy).filter(~F.col("__v").between(F.col("lower"), F.col("upper")))
    return outside.groupBy(*[col(c) for c in by], F.col("__v").alias("value")).agg(F.sum("__n").alias("n"))


def pie_top(df: DataFrame, column: str, slices: int = PIE_SLICES, buckets: int | None = None) -> DataFrame:
    """value, count: all values, or the most frequent ones and Other.

    A real value called Other is added to the rest. Only the slices shown come
    to the driver; the rest is the number of rows less theirs. With ``buckets`` the
    slices are found without a shuffle of the rare values (``most_frequent``): the
    same rows, for columns with very many values.
    """
    require_columns(df, [column])
    texts = df.select(value(df, column).cast("string").alias("value"))
    if buckets is None:
        counts = texts.groupBy("value").agg(F.count(F.lit(1)).alias("count"))
        found = counts.orderBy(F.desc("count"), F.asc_nulls_first("value")).limit(slices + 1)
    else:
        found = most_frequent(texts, "value", slices + 1, buckets)
    top = [tuple(r) for r in found.collect()]
    if len(top) > slices:
        shown = [(v, n) for v, n in top[: slices - 1] if v != OTHER]
        top = [*shown, (OTHER, df.count() - sum(n for _, n in shown))]
    return df.sparkSession.createDataFrame(top, "value string, count bigint")


def scatter_points(
    df: DataFrame,
    x: str,
    y: str,
    group: str | None = None,
    fraction: float | None = None,
    seed: int = 11,
    by: Sequence[str] = (),
    rows: int | None = None,
) -> DataFrame:
    """The points, a seeded share of them, or a sample of a stated size.

    Share and sample are taken by a hash of ``by`` (by default of the point itself),
    so the same rows are chosen whatever the partitions. ``rows`` gives so many
    points of each group (of the whole table without one), those of the smallest
    hashes: a task sends on at most so many for each group.
    """
    names = list(dict.fromkeys([x, y] + ([group] if group else [])))
    by = list(by) or names
    require_columns(df, [*names, *by])
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(col(c).cast("string"), F.lit("")) for c in by]).cast("binary"))
    kept = df
    if fraction is not None:
        place = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
        kept = df.filter(place < fraction)
    points = [value(df, c).alias(c) for c in names]
    if rows is None:
        return kept.select(*points)
    hashed = kept.select(*points, digest.alias("__place"))
    order = ["__place", *names]
    if group is None:
        return hashed.orderBy(*[col(c) for c in order]).limit(rows).select(*[col(c) for c in names])
    at = F.row_number().over(Window.partitionBy(col(group)).orderBy(*[col(c) for c in order]))
    return hashed.withColumn("__at", at).filter(F.col("__at") <= rows).select(*[col(c) for c in names])


def scatter_grid(df: DataFrame, x: str, y: str, bins: int = 50, group: str | None = None) -> DataFrame:
    """[group,] bin_x, bin_y, count over cells that hold points."""
    require_numeric(df, [x, y])
    cx, cy = number(df, x), number(df, y)
    ex, ey = [e or (0.0, 1.0) for e in _ends(df, [cx, cy])]
    keys = [value(df, group).alias("group")] if group else []
    cells = df.select(*keys, bin_number(cx, *ex, bins).alias("bin_x"), bin_number(cy, *ey, bins).alias("bin_y"))
    return (
        cells.filter("bin_x is not null and bin_y is not null")
        .groupBy(*(["group"] if group else []), "bin_x", "bin_y")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def ols_trend(df: DataFrame, x: str, y: str, group: str | None = None) -> DataFrame:
    """Least-squares line per group; a constant x has none (NULL)."""
    require_numeric(df, [x, y])
    cx, cy = number(df, x), number(df, y)
    keys = [value(df, group).alias("group")] if group else []
    sxx, sxy, syy = F.regr_sxx(cy, cx), F.regr_sxy(cy, cx), F.regr_syy(cy, cx)
    width = F.nullif(sxx, F.lit(0.0))
    return df.groupBy(*keys).agg(
        (sxy / width).alias("slope"),
        (F.regr_avgy(cy, cx) - sxy / width * F.regr_avgx(cy, cx)).alias("intercept"),
        F.when(syy == 0, F.when(sxx != 0, F.lit(1.0))).otherwise(sxy * sxy / F.nullif(sxx * syy, F.lit(0.0))).alias("r2"),
        F.regr_count(cy, cx).alias("n"),
    )


def violin_density(
    df: DataFrame,
    y: str,
    by: Sequence[str] = (),
    points: int = 100,
    bins: int = 512,
    ranges: int | None = None,
    accuracy: int | None = None,
) -> DataFrame:
    """by, point, at, density: a Gaussian kernel over fine bin counts per group.

    Bandwidth 1.059 min(deviation, IQR / 1.349) n^-0.2; the grid reaches two
    bandwidths beyond the data. A group without spread has no density. With
    ``accuracy`` the IQR comes from a sketch of so many items in each group.
    """
    by = list(by)
    keys = [col(c) for c in by]
    rows = _grouped(df, y, by).filter("__y is not null")
    found = _quantiles(rows, by, [0.25, 0.75], ["__q1", "__q3"], ranges, accuracy)
    moments = rows.groupBy(*keys).agg(
        F.min("__y").alias("__a"), F.max("__y").alias("__b"), F.stddev_samp("__y").alias("__sd"), F.count("__y").alias("__size")
    )
    boxes = found.table.withColumnRenamed("n", "__w")
    stats = join_lookup(moments, boxes, by, weight="__w")
    iqr = (F.col("__q3") - F.col("__q1")) / 1.349
    spread = F.when(iqr > 0, F.least("__sd", iqr)).otherwise(F.col("__sd"))
    stats = stats.withColumn("__h", 1.059 * spread * F.pow(F.col("__size").cast("double"), F.lit(-0.2)))
    stats = stats.filter("__h > 0").withColumn("__w", F.col("__size"))
    width = (F.col("__b") - F.col("__a")) / bins
    place = F.least(F.floor((F.col("__v") - F.col("__a")) / width), F.lit(bins - 1))
    binned = (
        join_lookup(found.values, stats, by, weight="__w")
        .filter("__h is not null")
        .groupBy(*keys, place.alias("__bin"), *[F.col(c) for c in ("__a", "__b", "__h", "__size")])
        .agg(F.sum("__n").alias("__n"))
    )
    curves = binned.groupBy(*keys, "__a", "__b", "__h", "__size").agg(
        F.collect_list(F.struct((F.col("__a") + (F.col("__bin") + 0.5) * width).alias("c"), F.col("__n").alias("n"))).alias("__cells")
    )
    low, high = F.col("__a") - 2 * F.col("__h"), F.col("__b") + 2 * F.col("__h")
    grid = curves.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
    grid = grid.withColumn("at", low + (high - low) * F.col("point") / (points - 1))
    total = F.aggregate(
        "__cells",
        F.lit(0.0),
        lambda acc, cell: acc + cell["n"] * F.exp(-0.5 * F.pow((F.col("at") - cell["c"]) / F.col("__h"), F.lit(2.0))),
    )
    density = total / (F.col("__size") * F.col("__h") * F.lit(2.5066282746310002))
    return grid.select(*keys, "point", "at", density.alias("density"))


def pair_grid(df: DataFrame, columns: Sequence[str], bins: int = 20) -> DataFrame:
    """row, col, bin_x, bin_y, count for the lower triangle of column pairs.

    The diagonal is the histogram of the column (bin_y equals bin_x).
    """
    names = list(columns)
    require_numeric(df, names)
    if len(names) < 2:
        raise ValueError("at least two numeric columns are needed")
    xs = [number(df, c) for c in names]
    ends = [e or (0.0, 1.0) for e in _ends(df, xs)]
    binned = df.select(*[bin_number(x, *e, bins).alias(f"b{i}") for i, (x, e) in enumerate(zip(xs, ends))])
    # Rows of equal bins are counted before they are spread over the pairs.
    tuples = binned.groupBy(*binned.columns).agg(F.count(F.lit(1)).alias("n"))
    cells = [
        F.struct(
            F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"b{j}").alias("bin_x"), F.col(f"b{i}").alias("bin_y")
        )
        for i in range(len(names))
        for j in range(i + 1)
    ]
    labels = F.array(*[F.lit(c) for c in names])
    return (
        tuples.select("n", F.inline(F.array(*cells)))
        .filter("bin_x is not null and bin_y is not null")
        .groupBy("i", "j", "bin_x", "bin_y")
        .agg(F.sum("n").alias("count"))
        .select(F.get(labels, F.col("i")).alias("row"), F.get(labels, F.col("j")).alias("col"), "bin_x", "bin_y", "count")
    )


def heatmap_long(df: DataFrame, columns: Sequence[str] | None = None, n: int = 30) -> DataFrame:
    """row, col, r with two decimals."""
    return correlation_matrix(df, columns, n)

