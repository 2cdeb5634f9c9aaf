"""Shared functions on the paths that large tables take, with hot keys."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tabwright.functions import joins, ordered, quantiles
from tabwright.functions.columns import parse_number, python_strip
from tabwright.functions.counts import fit_modes, most_frequent, tops, value_counts
from tabwright.functions.ordered import Running, with_running


def type7(values, p):
    values = sorted(values)
    at = p * (len(values) - 1)
    low, high = values[math.floor(at)], values[math.ceil(at)]
    return low + (high - low) * (at - math.floor(at))


@pytest.fixture(scope="module")
def skewed(spark):
    """Key 0 holds a third of the rows; a third of all values are equal."""
    rng = random.Random(5)
    data = []
    for i in range(6000):
        key = None if i % 97 == 0 else 0 if i % 3 == 0 else rng.randrange(1, 40)
        x = None if i % 11 == 0 else 7.0 if i % 3 == 1 else round(rng.gauss(0, 100), 3)
        data.append((i, key, rng.randrange(500), x))
    df = spark.createDataFrame(data, "id int, key int, t int, x double").repartition(6)
    return df, data


def test_exact_quantiles_over_several_passes(skewed, monkeypatch):
    df, data = skewed
    monkeypatch.setattr(quantiles, "SLICE", 20)
    monkeypatch.setattr(quantiles, "ACCURACY", 50)
    monkeypatch.setattr(quantiles, "MARGIN", 0.06)
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = quantiles.fit_quantiles(df, {"x": probs, "t": probs})
    xs = [r[3] for r in data if r[3] is not None]
    assert got["x"] == pytest.approx([type7(xs, p) for p in probs], abs=1e-9)
    assert got["t"] == pytest.approx([type7([r[2] for r in data], p) for p in probs], abs=1e-9)


def test_quantiles_with_margin_below_the_error(skewed, monkeypatch):
    """Pivots that miss the rank only cost another pass."""
    df, data = skewed
    monkeypatch.setattr(quantiles, "SLICE", 20)
    monkeypatch.setattr(quantiles, "ACCURACY", 20)
    monkeypatch.setattr(quantiles, "MARGIN", 0.0001)
    got = quantiles.fit_quantiles(df, {"t": [0.5, 0.9]})
    assert got["t"] == pytest.approx([type7([r[2] for r in data], p) for p in (0.5, 0.9)])


def test_quantiles_of_odd_columns(spark):
    df = spark.createDataFrame(
        [(None, 3.0, float("nan"), float("inf")), (None, 3.0, 1.0, 2.0)], "a double, b double, c double, d double"
    )
    got = quantiles.fit_quantiles(df, {c: [0.0, 0.5] for c in "abcd"})
    assert got == {"a": [None, None], "b": [3.0, 3.0], "c": [1.0, 1.0], "d": [2.0, float("inf")]}
    assert quantiles.fit_quantiles(df, {"a": [0.5], "b": [0.5]}, accuracy=100) == {"a": [None], "b": [3.0]}


@pytest.mark.parametrize("ranges", [None, 16])
def test_grouped_quantiles(skewed, ranges):
    df, data = skewed
    found = quantiles.group_quantiles(df, ["key"], "x", [0.25, 0.5], ["q1", "q2"], ranges)
    got = {r["key"]: (r["n"], r["q1"], r["q2"]) for r in found.table.collect()}
    for key in {r[1] for r in data}:
        xs = [r[3] for r in data if r[1] == key and r[3] is not None]
        n, q1, q2 = got[key]
        assert n == len(xs)
        assert (q1, q2) == pytest.approx((type7(xs, 0.25), type7(xs, 0.5)))


SPECS = [
    Running("total", "sum", "t"),
    Running("back", "last", "x"),
    Running("ahead", "first", "x"),
    Running("before", "lag", "x"),
    Running("after", "lead", "x"),
]


def by_hand(data, keyed):
    groups = {}
    for r in sorted(data, key=lambda r: (r[2], r[0])):
        groups.setdefault(r[1] if keyed else "all", []).append(r)
    out = {}
    for group in groups.values():
        total, last = 0, None
        for i, r in enumerate(group):
            total += r[2]
            last = r[3] if r[3] is not None else last
            ahead = next((g[3] for g in group[i:] if g[3] is not None), None)
            before = group[i - 1][3] if i else None
            after = group[i + 1][3] if i + 1 < len(group) else None
            out[r[0]] = (total, last, ahead, before, after)
    return out


@pytest.mark.parametrize("keyed,ranges", [(True, None), (True, 40), (True, 150), (False, None), (False, 100)])
def test_running_values(skewed, keyed, ranges):
    df, data = skewed
    got = with_running(df, ["key"] if keyed else [], ["t", "id"], SPECS, ranges)
    assert got.columns == ["id", "key", "t", "x", "total", "back", "ahead", "before", "after"]
    assert {r[0]: tuple(r[4:]) for r in got.collect()} == by_hand(data, keyed)


def test_hot_key_spreads_over_ranges(skewed):
    df, _ = skewed
    ranged = ordered.into_ranges(df, ["key"], ["t", "id"], 40)
    sizes = [r["count"] for r in ranged.groupBy(ordered.RANGE).count().collect()]
    assert len(sizes) > 30 and max(sizes) < 6000 / 8


def test_unkeyed_running_plan_has_no_single_partition_sort_of_rows(skewed):
    df, _ = skewed
    got = with_running(df.select("id", "x"), [], ["id"], [Running("back", "last", "x")])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan
    # Only the summary, one row per range, may be gathered.
    assert plan.count("SinglePartition") <= 1
    assert "hashpartitioning(__range" in plan


def test_ranges_follow_the_order_of_any_key_types(spark):
    df = spark.range(5000).selectExpr(
        "if(id % 50 = 0, null, concat(char(65 + cast(pmod(id * 31, 7) as int)), '\"é', cast(id % 3 as string))) as s",
        "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, pmod(id * 7919, 1000) / 7.0) as t",
        "cast(if(id % 9 = 0, -0.1, id / 3) as double) as d",
        "cast(id as decimal(20, 5)) as e",
    )
    keys = ["s", "t", "d", "e"]
    ranged = ordered.into_ranges(df, keys[:1], keys[1:], 60)
    numbers = [r[0] for r in ranged.orderBy(*[F.col(k).asc_nulls_first() for k in keys]).select(ordered.RANGE).collect()]
    assert numbers == sorted(numbers)
    assert len(set(numbers)) > 50
    plan = ranged._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" not in plan


def test_edges_of_long_texts_are_prefixes(spark):
    df = spark.range(3000).selectExpr("id", "concat(cast(pmod(id * 7919, 3000) as string), repeat('x', 5000)) as text")
    cut = ordered._cut_columns(df, [], ["text", "id"])
    edges = ordered.fit_edges(df, cut, 50, 3000)
    assert len(edges) > 40 and max(len(e) for e in edges) == 1 and max(len(e[0]) for e in edges) == ordered.PREFIX
    got = with_running(df, [], ["text", "id"], [Running("n", "sum", "id")], 50)
    rows = sorted((r["text"], r["id"], r["n"]) for r in got.collect())
    total = 0
    for _, i, n in rows:
        total += i
        assert n == total


def test_quantiles_with_many_infinite_values(spark):
    df = spark.range(200_000).selectExpr("if(id % 2 = 0, double('inf'), if(id % 10 = 1, double('-inf'), id)) as x")
    got = quantiles.fit_quantiles(df, {"x": [0.05, 0.3, 0.75, 1.0]})["x"]
    kept = sorted(float(i) for i in range(200_000) if i % 2 and i % 10 != 1)
    at = 0.3 * 199_999 - 20_000
    assert got[0] == -math.inf and got[2:] == [math.inf, math.inf]
    assert got[1] == pytest.approx(kept[int(at)] + (kept[int(at) + 1] - kept[int(at)]) * (at - int(at)))


def test_running_needs_an_order(skewed):
    with pytest.raises(ValueError):
        with_running(skewed[0], ["key"], [], SPECS)


@pytest.mark.parametrize("share", [0.1, 2.0])
def test_lookup_join_with_hot_and_null_keys(skewed, share, monkeypatch):
    df, data = skewed
    monkeypatch.setattr(joins, "HOT_SHARE", share)
    lookup = df.groupBy("key").agg(F.count("*").alias("w"), F.sum("t").alias("total")).filter("key is null or key <> 5")
    got = joins.join_lookup(df, lookup, ["key"], weight="w")
    sums = {}
    for r in data:
        sums[r[1]] = sums.get(r[1], 0) + r[2]
    sums[5] = None
    assert got.columns == ["id", "key", "t", "x", "total"]
    found = got.collect()
    assert len(found) == len(data)
    assert all(r["total"] == sums[r["key"]] for r in found)


def test_tops_order_by_type(spark):
    df = spark.createDataFrame(
        [(10, "b", 1.5, True), (9, "a", -0.0, False), (10, "a", 0.0, True), (9, "b", 1.5, False), (None, None, None, None)],
        "i int, s string, d double, b boolean",
    )
    got = {r["column"]: (r["distinct"], r["top"], r["freq"]) for r in tops(df).collect()}
    assert got == {"i": (2, "9", 2), "s": (2, "a", 2), "d": (2, "0.0", 2), "b": (2, "false", 2)}
    assert fit_modes(df.filter("false"), ["i"]) == {"i": None}


@pytest.mark.parametrize("k", [1, 7, 40, 5000])
@pytest.mark.parametrize("buckets", [1, 700, 65_536])
def test_most_frequent_equals_all_counts(spark, k, buckets):
    """A hot value, a few common ones with ties, missing ones, 2000 that come once."""
    df = spark.range(6000).selectExpr(
        "case when id < 2000 then 'hot' when id < 3600 then concat('c', id % 20) when id < 3700 then null when id < 4000 "
        "then '' else concat('r', id) end as x",
        "if(id % 3 = 0, 0.0D, if(id % 3 = 1, -0.0D, id / 7)) as d",
        "id as value",
    )
    for name in ("x", "d"):
        wanted = [tuple(r) for r in value_counts(df, name).limit(k).collect()]
        got = [tuple(r) for r in most_frequent(df, name, k, buckets).collect()]
        assert sorted(got, key=repr) == sorted(wanted, key=repr)
    assert most_frequent(df.filter("false"), "x", k, buckets).count() == 0


def test_most_frequent_leaves_rare_values_where_they_are(spark, monkeypatch):
    """What is counted by value: only buckets that reach the k-th count."""
    monkeypatch.setattr("tabwright.functions.counts.FULLEST", 1)
    df = spark.range(20_000).selectExpr("if(id < 10000, id % 10, id) as x")
    found = most_frequent(df, "x", 10)
    assert sorted((r["value"], r["count"]) for r in found.collect()) == [(i, 1000) for i in range(10)]
    with pytest.raises(ValueError, match="positive"):
        most_frequent(df, "x", 0)


def test_number_text(spark):
    texts = ["1", " 2.5 ", "-3e2", ".5", "1.", "inf", "1.0f", "1d", "0x1", "", "abc", "1 2", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(parse_number(F.col("t"))).collect()]
    assert got == [1.0, 2.5, -300.0, 0.5, 1.0, float("inf"), None, None, None, None, None, None, None]


def test_strip_like_python(spark):
    texts = ["  a b ", "\t\n x\r\n", " y　", "\x1cz\x1f", "", " "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(python_strip(F.col("t"))).collect()] == [t.strip() for t in texts]


def test_running_plans_read_their_source_twice_at_most(skewed, tmp_path):
    from tabwright.operators import charts, events, missing

    df, _ = skewed
    df.selectExpr("id", "key", "t", "x", "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, t) as ts", "cast(key as string) as tab").write.parquet(str(tmp_path / "p"))
    stored = df.sparkSession.read.parquet(str(tmp_path / "p"))
    scans = lambda made: made._jdf.queryExecution().executedPlan().toString().count("FileScan parquet")
    assert scans(with_running(stored, ["key"], ["t", "id"], SPECS)) == 2
    assert scans(missing.forward_fill(stored, ["x"], ["t", "id"], ["key"])) == 2
    assert scans(events.first_success(stored, "key", "tab", ["t", "id"], "1", "2")) == 2
    assert scans(events.tab_dwell(stored, "key", "ts", "tab", ["t", "id"])) == 2
    # Counted values and both parts of the written lookup; the source is not read again.
    assert scans(charts.box_stats(stored, "x", ["key"])) == 3
