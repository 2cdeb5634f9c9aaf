"""Small hand-made tables for the rules that are easy to get wrong."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tabwright.operators import charts, dedup, features, filters, missing, outliers, profile, scaling, text
from tabwright.operators.filters import FilterSet, InList, InRange
from tabwright.plans.recipe import Recipe
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(
        [
            (1, " x ", 1.0, True, "$1,000"),
            (2, "NA", float("nan"), None, " 20 "),
            (3, None, 3.0, False, "?"),
            (4, "Unknown", 100.0, True, "-5"),
        ],
        "id int, name string, v double, flag boolean, money string",
    )


def column(df, name, order="id"):
    return [r[name] for r in df.orderBy(order).collect()]


def test_nan_is_missing_everywhere(odd):
    assert column(missing.fill_zero(odd, "v"), "v") == [1.0, 0.0, 3.0, 100.0]
    assert column(missing.fill_median(odd, "v"), "v")[1] == 3.0
    assert missing.drop_missing_rows(odd, ["v"]).count() == 3
    assert profile.missing_by_column(odd).filter("column = 'v'").first()["missing"] == 1
    assert filters.filter_range(odd, "v", 0).count() == 3
    assert column(features.square(odd, "v"), "v_square")[1] is None
    assert dedup.drop_duplicates(odd.unionAll(odd)).count() == 4


def test_tokens_and_trim(odd):
    assert column(missing.standardize_missing(odd), "name") == ["x", None, None, "Unknown"]
    assert column(missing.standardize_missing(odd, trim=False), "name") == [" x ", None, None, "Unknown"]
    assert column(missing.standardize_missing(odd, ["name"], tokens=["x"]), "name") == [None, "NA", None, "Unknown"]


def test_fills_keep_or_change_types(odd):
    whole = odd.select("id", F.when(F.col("id") > 2, F.col("id")).alias("n"))
    assert column(missing.fill_mean(whole, "n"), "n") == [3.5, 3.5, 3.0, 4.0]
    assert dict(missing.fill_zero(whole, "n").dtypes)["n"] == "int"
    assert column(missing.fill_mode(whole, "n"), "n") == [3, 3, 3, 4]
    assert column(missing.fill_mode(odd, "flag"), "flag") == [True, True, False, True]
    assert column(missing.fill_constant(odd, "v", "7"), "v")[1] == 7.0
    assert column(missing.fill_unknown(odd, "name"), "name")[2] == "Unknown"
    empty = odd.withColumn("name", F.lit(None).cast("string"))
    assert set(column(missing.fill_mode(empty, "name"), "name")) == {"Unknown"}


def test_refused_constants(odd):
    for constant in ("", "  "):
        with pytest.raises(ValueError):
            missing.fill_constant(odd, "name", constant)
    with pytest.raises(ValueError):
        missing.fill_constant(odd, "v", "many")


def test_impute_all(odd):
    got = missing.impute_all(odd, numeric="mean", categorical="unknown")
    assert column(got, "v")[1] == pytest.approx(104 / 3)
    assert column(got, "name")[2] == "Unknown"
    assert column(got, "flag")[1] == "Unknown"
    got = missing.impute_all(odd, numeric="mode")
    assert column(got, "v")[1] == 1.0
    assert column(got, "flag")[1] is True
    void = odd.withColumn("v", F.lit(None).cast("double"))
    assert column(missing.impute_all(void, numeric="mode"), "v") == [None] * 4


def test_sparse_columns(odd):
    df = odd.select("id", F.lit(None).cast("int").alias("none"), F.when(F.col("id") > 2, 1).alias("half"))
    assert missing.drop_sparse_columns(df).columns == ["id", "half"]
    assert missing.drop_sparse_columns(df, 49).columns == ["id"]
    assert missing.drop_sparse_columns(df, 100).columns == ["id", "none", "half"]


def test_fills_in_order(odd):
    df = odd.select("id", "v", F.lit("g").alias("g"))
    assert column(missing.forward_fill(df, "v", ["id"]), "v") == [1.0, 1.0, 3.0, 100.0]
    assert column(missing.backward_fill(df, "v", ["id"], ["g"]), "v") == [1.0, 3.0, 3.0, 100.0]


def test_column_names(spark):
    df = spark.range(1).selectExpr(
        "id as ` A b`", "id as `a-B `", "id as `a_b`", "id as `ab`", "id as `é`", "id as `__x__y`"
    )
    assert text.standardize_column_names(df).columns == ["a_b", "ab", "a_b_2", "ab_2", "col_4", "x_y"]


def test_auto_numeric_needs_every_value(spark):
    df = spark.createDataFrame(
        [("1", "1.5", "x", None, "9" * 25), ("2", " 2", "3", None, "1"), (None, "inf", "4", None, "2")],
        "a string, b string, c string, d string, e string",
    )
    got = text.auto_numeric(df)
    assert dict(got.dtypes) == {"a": "bigint", "b": "double", "c": "string", "d": "string", "e": "double"}


def test_money_and_booleans(odd):
    assert column(text.to_numeric(odd, "money"), "money") == [1000.0, 20.0, None, -5.0]
    assert column(text.to_numeric(odd, "flag"), "flag") == [1.0, None, 0.0, 1.0]
    assert tuple(text.to_numeric_report(odd, "money").first()) == (3, 4)
    assert column(text.to_boolean(odd, "name", ["NA"]), "name") == [False, True, None, False]
    with pytest.raises(ValueError):
        text.to_boolean(odd, "name", [])


def test_remap(odd):
    assert column(text.remap_value(odd, "name", "NA", " none "), "name") == [" x ", "none", None, "Unknown"]
    assert column(text.remap_value(odd, "name", "nan", "gap"), "name")[2] == "gap"
    assert column(text.remap_value(odd, "id", "3", "three"), "id", "v") == ["1", "three", "4", "2"]
    assert text.remap_count(odd, "v", "nan").first()[0] == 1
    for target in ("", "NA"):
        with pytest.raises(ValueError):
            text.remap_value(odd, "name", "NA", target)


def test_filters(odd):
    assert column(filters.filter_categorical(odd, "name", ["NA", "(NA)"]), "id") == [2, 3]
    assert column(filters.filter_categorical(odd, "v", ["3", "x"]), "id") == [3]
    assert column(filters.filter_categorical(odd, "flag", ["true"]), "id") == [1, 4]
    assert filters.eda_filter_in(odd, "name", []).count() == 0
    assert filters.eda_filter_range(odd, "v", 200, 300).count() == 4
    assert filters.eda_filter_range(odd, "v", 2, 300).count() == 2
    chosen = FilterSet().add(InRange("v", 2)).add(InList("name", ["NA"])).add(InRange("v", None, 2))
    assert [f.column for f in chosen.filters] == ["name", "v"]
    assert column(chosen.remove(0).apply(odd), "id") == [1]
    assert chosen.remove(9).filters == chosen.filters
    for bad in (InList("v", []), InRange("v")):
        with pytest.raises(ValueError):
            FilterSet().add(bad)


def test_filters_reach_the_scan(spark):
    items = spark.read.parquet(f"{SMALL}/lineitem.parquet")
    kept = filters.filter_all(
        items, [InRange("l_quantity", 3, 7.5), InList("l_returnflag", ["R"]), InList("l_linenumber", ["2", "(NA)"])]
    )
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    plan = missing.drop_missing_rows(kept.select("l_quantity", "l_tax"))._jdf.queryExecution().executedPlan().toString()
    for part in (
        "GreaterThanOrEqual(l_quantity,3.0)",
        "LessThanOrEqual(l_quantity,7.5)",
        "EqualTo(l_returnflag,R)",
        "Or(EqualTo(l_linenumber,2),IsNull(l_linenumber))",
        "IsNotNull(l_tax)",
    ):
        assert part in plan, part
    assert "l_extendedprice" not in plan


def test_domains(odd):
    assert [r[0] for r in filters.filter_domain(odd, "name").collect()] == [" x ", "NA", "Unknown", "(NA)"]
    assert {r[0] for r in filters.eda_filter_domain(odd, "v").collect()} == {1.0, 3.0, 100.0}
    empty = odd.filter("id > 9")
    assert tuple(filters.filter_bounds(empty, "v").first()) == (0.0, 0.0)
    assert tuple(filters.filter_bounds(odd.filter("id = 1"), "v", widen=True).first()) == (1.0, 1.01)


def test_outliers_skip_flat_columns(spark):
    df = spark.createDataFrame(
        [(1, 5, None), (2, 5, None), (3, 5, None), (4, 5, None), (1000, 5, None), (None, 9, None)],
        "a int, flat int, none double",
    )
    assert outliers.fit_iqr(df) == {"a": (-1.0, 7.0)}
    assert outliers.iqr_remove(df).count() == 5
    capped = outliers.iqr_cap(df)
    assert dict(capped.dtypes) == {"a": "double", "flat": "int", "none": "double"}
    assert sorted(r[0] for r in capped.filter("a is not null").collect()) == [1.0, 2.0, 3.0, 4.0, 7.0]
    assert capped.filter("a is null").count() == 1
    assert set(outliers.fit_zscore(df)) == {"a", "flat"}
    assert outliers.zscore_remove(df, threshold=0).count() == 6
    assert outliers.zscore_remove(df, ["a"], threshold=1).count() == 5
    assert outliers.percentile_cap(df, ["a"], cutoff=10).agg(F.max("a")).first()[0] == pytest.approx(601.6)


def test_scaling(odd):
    scaled = scaling.standard_scale(odd.select("id", "v", F.lit(2).alias("flat")))
    assert column(scaled, "flat") == [0.0] * 4
    assert column(scaled, "id")[0] == pytest.approx(-1.5 / math.sqrt(1.25))
    assert column(scaled, "v")[3] == 100.0
    assert column(scaling.minmax_scale(odd.select("id")), "id") == [0.0, 1 / 3, 2 / 3, 1.0]


def test_one_hot(odd):
    got = scaling.one_hot(odd.select("id", "name", "flag"), drop_first=True)
    assert got.columns == ["id", "flag", "name_NA", "name_Unknown"]
    assert [tuple(r)[2:] for r in got.orderBy("id").collect()] == [
        (False, False),
        (True, False),
        (False, False),
        (False, True),
    ]
    with pytest.raises(ValueError):
        scaling.one_hot(odd.select("name"), max_categories=2)


def test_label_codes_for_new_data(odd):
    codes = scaling.fit_label_codes(odd, ["name"], ranges=3)
    later = odd.withColumn("name", F.when(F.col("id") == 1, F.lit("new")).otherwise(F.col("name")))
    assert column(scaling.apply_label_codes(later, codes), "name") == [-1, 1, -1, 2]


@pytest.mark.parametrize(
    "low,high,bins,labels",
    [
        (0, 10, 4, ["(-0.011, 2.5]", "(2.5, 5.0]", "(5.0, 7.5]", "(7.5, 10.0]"]),
        (3.0, 3.0, 2, ["(2.996, 3.0]", "(3.0, 3.003]"]),
        (0, 0.001, 2, ["(-1.001e-06, 0.0005]", "(0.0005, 0.001]"]),
    ],
)
def test_bin_labels(low, high, bins, labels):
    got = features.bin_labels(features.bin_edges(low, high, bins))
    if low == 0 and high == 0.001:
        assert got[1] == labels[1]
    else:
        assert got == labels


def test_binning_edges(spark):
    df = spark.createDataFrame([(0.0,), (2.5,), (2.500001,), (10.0,), (None,)], "x double")
    got = [r[1] for r in features.binning(df, "x", na_label="nan").collect()]
    assert got == ["(-0.011, 2.5]", "(-0.011, 2.5]", "(2.5, 5.0]", "(7.5, 10.0]", "nan"]


def test_features_refuse_and_guard(odd):
    flat = odd.withColumn("flat", F.lit(4.0))
    for step in (features.zscore, features.minmax):
        with pytest.raises(ValueError):
            step(flat, "flat")
    with pytest.raises(TypeError):
        features.log(odd, "name")
    zero = odd.select("id", F.lit(0).alias("z"), F.lit(-4).alias("neg"))
    assert column(features.ratio(zero, "id", "z"), "id_div_z") == [None] * 4
    assert column(features.log(zero, "neg"), "neg_log")[0] == pytest.approx(math.log(1e-10))
    assert column(features.sqrt(zero, "neg", "root"), "root") == [0.0] * 4
    big = odd.select("id", F.lit(2**62).alias("big"))
    assert column(features.add(big, "big", "big"), "big_plus_big") == [None] * 4


def test_dates(spark):
    df = spark.createDataFrame(
        [(1, "2024-01-06"), (2, "3/4/2024"), (3, "soon"), (4, "2024-12-31T23:59:58"), (5, None), (6, "Mar 5, 2024")],
        "id int, d string",
    )
    assert column(features.date_part(df, "d", "is_weekend"), "d_weekend") == [1, 0, 0, 0, 0, 0]
    assert column(features.date_part(df, "d", "dayofyear"), "d_doy") == [6, 64, None, 366, None, 65]
    assert column(features.date_part(df, "d", "dayofweek", "weekday"), "weekday") == [5, 0, None, 1, None, 1]
    assert [r[0] for r in features.datetime_candidates(df.withColumn("name", F.lit("x"))).collect()] == ["d"]
    with pytest.raises(ValueError):
        features.date_part(df.filter("id = 3"), "d", "year")


def test_profile_of_booleans_and_empty(odd):
    got = {r["column"]: r for r in profile.column_summary(odd).collect()}
    assert got["flag"]["top_value"] == "true" and got["flag"]["mean"] is None
    assert got["v"]["unique"] == 3 and got["v"]["median"] == 3.0 and got["v"]["top_value"] == ""
    nothing = profile.column_summary(odd.filter("id > 9")).collect()
    assert [r["missing_pct"] for r in nothing] == [0.0] * 5
    assert tuple(dedup.duplicate_stats(odd.filter("id > 9")).first()) == (0, 0, 0.0)
    assert tuple(profile.quality_overview(odd).first()) == (4, 5, 3, 0, 2, 3)


def test_describe_of_times(spark):
    df = spark.createDataFrame([(1,), (2,), (4,), (None,)], "d int").selectExpr(
        "timestamp_ntz'2024-01-01' + make_dt_interval(d) as t", "date_add(date'2020-02-28', d) as day"
    )
    got = {r["column"]: r for r in profile.describe_all(df).collect()}
    assert (got["t"]["count"], got["t"]["unique"], got["t"]["mean"]) == (3, None, None)
    assert [str(got["t"][f"time_{s}"]) for s in ("mean", "min", "q1", "median", "q3", "max")] == [
        "2024-01-03 08:00:00", "2024-01-02 00:00:00", "2024-01-02 12:00:00", "2024-01-03 00:00:00", "2024-01-04 00:00:00", "2024-01-05 00:00:00",
    ]
    assert str(got["day"]["time_median"]) == "2020-03-01 00:00:00"


def test_label_codes_of_long_texts(spark):
    df = spark.createDataFrame([("a" * 70_000 + c, d) for c, d in ("zx", "bx", "zy", "bx")] + [(None, "q")], "s string, t string")
    assert sorted(map(tuple, scaling.label_encode(df).collect())) == [(-1, 0), (0, 1), (0, 1), (1, 1), (1, 2)]


def test_correlation_of_flat_column(odd):
    wide = profile.correlation_wide(odd.select("id", F.lit(1).alias("flat"), (-F.col("id")).alias("minus")))
    got = {r["column"]: (r["id"], r["flat"], r["minus"]) for r in wide.collect()}
    assert got == {"id": (1.0, None, -1.0), "flat": (None, None, None), "minus": (-1.0, None, 1.0)}


def test_correlation_of_many_columns_asked_for(spark):
    df = spark.range(50).selectExpr(*[f"id * {i + 1} as c{i}" for i in range(40)])
    assert profile.correlation_matrix(df, df.columns).filter("r = 1").count() == 1600
    assert profile.correlation_matrix(df).count() == 900


def test_correlation_where_common_rows_vary_little(spark):
    df = spark.range(2000).selectExpr("cast(id as double) as x", "if(id < 1000, 1e9 + id, cast(null as double)) as y", "id * 1e12 as z")
    got = {(r["row"], r["col"]): r["r"] for r in profile.correlation_matrix(df).collect()}
    assert set(got.values()) == {1.0}


def test_correlation_over_common_rows(spark):
    rng = random.Random(3)
    data = []
    for _ in range(400):
        x = rng.gauss(1000, 5)
        row = [x, -2 * x + rng.gauss(0, 9), rng.random(), 4.0 if rng.random() < 0.5 else None]
        data.append([None if k == 1 and rng.random() < 0.3 else v for k, v in enumerate(row)])
    df = spark.createDataFrame(data, "a double, b double, c double, d double")
    got = {(r["row"], r["col"]): r["r"] for r in profile.correlation_matrix(df, digits=6).collect()}
    for i, a in enumerate("abcd"):
        for j, b in enumerate("abcd"):
            both = [(r[i], r[j]) for r in data if r[i] is not None and r[j] is not None]
            want = None if "d" in (a, b) else statistics.correlation(*zip(*both))
            assert got[a, b] == (None if want is None else pytest.approx(want, abs=2e-6)), (a, b)


def test_histogram_of_flat_and_text(odd):
    flat = charts.histogram(odd.select(F.lit(3.0).alias("x")), "x", 4).orderBy("bin").collect()
    assert [(r["low"], r["count"]) for r in flat] == [(2.5, 0), (2.75, 0), (3.0, 4), (3.25, 0)]
    assert charts.histogram(odd, "name").count() == 4


def test_filter_kind_near_the_limit(spark):
    """Exact on both sides of 30 values; -0.0 is 0.0, NaN and missing are no values."""
    sizes = (1, 29, 30, 31, 59, 60, 61, 2500)
    columns = [f"id % {n} as l{n}" for n in sizes] + [f"cast(id % {n} as decimal(9, 2)) * 1.5 as m{n}" for n in sizes]
    columns += ["case when id % 32 = 30 then double('nan') when id % 32 = 31 then null when id % 64 = 0 then -0.0D else double(id % 32) end as odd", "'t' as t", "float(id) as f"]
    df = spark.range(5000).selectExpr(*columns)
    got = {r["column"]: r["kind"] for r in filters.filter_kind(df).collect()}
    wide = {f"{c}{n}" for c in "lm" for n in sizes if n > 30} | {"f"}
    assert {c for c, kind in got.items() if kind == "numeric"} == wide and len(got) == len(columns)
    assert {r["kind"] for r in filters.filter_kind(df.filter("false")).collect()} == {"categorical"}


def test_pie_adds_a_real_other(spark):
    values = [("Other", 5)] + [(f"v{i:02d}", 4) for i in range(30)]
    df = spark.createDataFrame([(v,) for v, n in values for _ in range(n)], "x string")
    got = {r["value"]: r["count"] for r in charts.pie_top(df, "x").collect()}
    assert len(got) == 19 and got["Other"] == 5 + 12 * 4 and sum(got.values()) == df.count()
    assert charts.pie_top(df.filter("x < 'v05'"), "x").count() == 6
    assert {r["value"]: r["count"] for r in charts.pie_top(df, "x", buckets=16).collect()} == got


@pytest.mark.parametrize("ranges", [None, 12])
def test_box_by_hand(spark, ranges):
    df = spark.createDataFrame([("a", float(x)) for x in [1, 2, 3, 4, 100]] + [("b", 5.0)] * 3 + [(None, 1.0)], "g string, y double")
    got = {r["g"]: tuple(r)[1:] for r in charts.box_stats(df, "y", ["g"], ranges).collect()}
    assert got["a"] == (5, 2.0, 3.0, 4.0, 1.0, 4.0, 1)
    assert got["b"] == (3, 5.0, 5.0, 5.0, 5.0, 5.0, 0)
    assert got[None] == (1, 1.0, 1.0, 1.0, 1.0, 1.0, 0)
    assert [tuple(r) for r in charts.box_outliers(df, "y", ["g"], ranges).collect()] == [("a", 100.0, 1)]
    assert charts.box_stats(df, "y", ranges=ranges).first()["n"] == 9


@pytest.mark.parametrize("ranges", [None, 12])
def test_violin_integrates_to_one(spark, ranges):
    df = spark.range(2000).selectExpr("id % 2 as g", "cast(pmod(id * 7919, 1000) as double) as y")
    curve = charts.violin_density(df, "y", ["g"], ranges=ranges).orderBy("point").collect()
    for g in (0, 1):
        points = [(r["at"], r["density"]) for r in curve if r["g"] == g]
        area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(points, points[1:]))
        assert len(points) == 100 and area == pytest.approx(1, abs=0.03)


def test_ols_flat(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert tuple(charts.ols_trend(df, "x", "y").first())[:2] == (None, None)


def test_recipe_round_trip(odd):
    recipe = Recipe().then("standardize_missing").then("fill_mean", column="v").then("log", column="v")
    again = Recipe.from_json(recipe.to_json())
    assert again == recipe
    assert again.run(odd).columns == ["id", "name", "v", "flag", "money", "v_log"]
    with pytest.raises(ValueError):
        Recipe([("no_such_step", {})])


def test_sketched_boxes(spark):
    import random

    import numpy as np

    from tabwright.operators import charts

    rng = random.Random(2)
    data = [(g, rng.lognormvariate(0, 1.5)) for g in ("a", "b", None) for _ in range(4000)] + [("a", None), ("c", None), ("b", float("nan"))]
    df = spark.createDataFrame(data, "g string, v double").repartition(7)
    exact = {r["g"]: r for r in charts.box_stats(df, "v", ["g"]).collect()}
    found = {r["g"]: r for r in charts.box_stats(df, "v", ["g"], accuracy=800).collect()}
    assert set(found) == set(exact) == {"a", "b", None}
    for g, r in found.items():
        values = np.array([v for k, v in data if k == g and v is not None and v == v])
        assert r["n"] == exact[g]["n"] == len(values)
        for name, share in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
            assert abs((values <= r[name]).mean() - share) < 0.02
        low, high = r["q1"] - 1.5 * (r["q3"] - r["q1"]), r["q3"] + 1.5 * (r["q3"] - r["q1"])
        assert r["outliers"] == ((values < low) | (values > high)).sum()
        assert r["whisker_high"] == values[values <= high].max()
    far = charts.box_outliers(df, "v", ["g"], accuracy=800).groupBy("g").sum("n").collect()
    # Another run draws another sketch.
    assert all(abs(r[1] - found[r[0]]["outliers"]) < 0.02 * found[r[0]]["n"] for r in far) and len(far) == 3
    curve = charts.violin_density(df.filter("g = 'a'"), "v", ["g"], accuracy=800).collect()
    assert len(curve) == 100 and all(r["density"] >= 0 for r in curve)
    assert charts.box_stats(df, "v", accuracy=100).first()["n"] == 12000
    with pytest.raises(ValueError):
        charts.box_stats(df, "v", accuracy=1)


def test_samples_of_a_stated_size(spark):
    from tabwright.operators import charts

    df = spark.range(3000).selectExpr("id as k", "id % 50 * 1.0 as x", "id % 7 * 1.0 as y", "case when id % 3 > 0 then id % 3 end as g")
    one = charts.scatter_points(df.repartition(9), "x", "y", "g", by=["k"], rows=40)
    two = charts.scatter_points(df.repartition(2, "x"), "x", "y", "g", by=["k"], rows=40)
    assert sorted(one.collect(), key=repr) == sorted(two.collect(), key=repr)
    assert {r["g"]: r["count"] for r in one.groupBy("g").count().collect()} == {None: 40, 1: 40, 2: 40}
    whole = charts.scatter_points(df, "x", "y", by=["k"], rows=100)
    assert whole.count() == 100 and whole.columns == ["x", "y"]
    assert charts.scatter_points(df, "x", "y", rows=10_000).count() == 3000


def test_sparse_indicators(spark):
    from tabwright.operators import scaling

    df = spark.createDataFrame([(1, "b"), (2, None), (3, "a"), (4, "c"), (5, "a")], "k long, t string")
    rows = {r["k"]: (r["t_hot"]["size"], r["t_hot"]["indices"]) for r in scaling.one_hot_sparse(df).collect()}
    assert rows == {1: (3, [1]), 2: (3, []), 3: (3, [0]), 4: (3, [2]), 5: (3, [0])}
    rows = {r["k"]: (r["t_hot"]["size"], r["t_hot"]["indices"]) for r in scaling.one_hot_sparse(df, ["t"], drop_first=True).collect()}
    assert rows == {1: (2, [0]), 2: (2, []), 3: (2, []), 4: (2, [1]), 5: (2, [])}
    wide = spark.range(1200).selectExpr("cast(id as string) as t")
    with pytest.raises(ValueError, match="one_hot_sparse"):
        scaling.one_hot(wide)
    assert scaling.one_hot_sparse(wide).selectExpr("max(t_hot.size)").first()[0] == 1200
