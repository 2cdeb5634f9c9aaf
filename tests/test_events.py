"""Experiment, event log and streams."""

import datetime as dt
import math
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tabwright.operators import events, experiment
from tabwright.streaming import events as streams
from tabwright.streaming.ordered import slot_changes
from tabwright.streaming.run import drain


def exact_fisher(a, b, c, d):
    n, r, k = a + b + c + d, a + b, a + c
    weight = lambda x: math.comb(r, x) * math.comb(n - r, k - x)
    ways = [weight(x) for x in range(max(0, r + k - n), min(r, k) + 1)]
    return float(Fraction(sum(w for w in ways if w * 10**7 <= weight(a) * (10**7 + 1)), sum(ways)))


TABLES = [(9, 11, 4, 16), (0, 5, 5, 0), (3, 3, 3, 3), (1, 999, 20, 980), (500, 400, 450, 480), (7, 0, 1, 12), (1200, 3, 1100, 9)]


def test_fisher_against_exact_counts(spark):
    df = spark.createDataFrame(TABLES, "a long, b long, c long, d long")
    for r in experiment.fisher_exact(df).collect():
        assert r["p_value"] == pytest.approx(exact_fisher(*tuple(r)[:4]), rel=1e-9), r


def test_fisher_at_the_edges(spark):
    df = spark.createDataFrame([(0, 5, 0, 7), (5, 0, 3, 2), (400_000_000, 600_000_000, 400_100_000, 599_900_000)], "a long, b long, c long, d long")
    flat, endless, huge = experiment.fisher_exact(df).collect()
    assert (flat["odds_ratio"], flat["p_value"]) == (None, 1.0)
    assert endless["odds_ratio"] == math.inf
    z = 100_000 / math.sqrt(2e9 * 0.40005 * 0.59995)
    assert huge["p_value"] == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-3)


def test_assignment_is_stable_and_even(spark):
    users = spark.range(20000).withColumnRenamed("id", "user")
    first = experiment.assign_variant(users, "user", "s1")
    again = experiment.assign_variant(users.orderBy(F.desc("user")), "user", "s1")
    assert first.join(again, ["user", "variant"]).count() == 20000
    share = first.filter("variant = 'A'").count() / 20000
    assert abs(share - 0.5) < 0.02
    other = experiment.assign_variant(users, "user", "s2").withColumnRenamed("variant", "v2")
    assert 0.45 < first.join(other, "user").filter("variant = v2").count() / 20000 < 0.55


def test_clean_groups(spark):
    df = spark.createDataFrame([("A",), (None,), ("(not set)",), ("B",)], "group string")
    assert sorted(r[0] for r in experiment.clean_groups(df).collect()) == ["A", "B"]


def test_conversion_counts_users_once(spark):
    log = [("A", "u1", "ok"), ("A", "u1", "ok"), ("A", "u2", "no"), ("B", "u3", "no"), ("B", None, "ok")]
    df = spark.createDataFrame(log, "g string, u string, e string")
    got = {r["group"]: tuple(r)[1:] for r in experiment.conversion(df, "g", "e", "u", "ok").collect()}
    assert got == {"A": (1, 1, 2, 50.0), "B": (0, 1, 1, 0.0)}
    assert tuple(experiment.contingency(experiment.conversion(df, "g", "e", "u", "ok")).first()) == (1, 1, 0, 1)


def clock(seconds):
    return dt.datetime(2026, 3, 22) + dt.timedelta(seconds=seconds)


VISITS = [
    (1, "u", clock(0), "Load"),
    (2, "u", clock(10), "Load"),
    (3, "u", clock(12.4996), "Clean"),
    (4, "u", clock(20), None),
    (5, "u", clock(25), None),
    (6, "u", clock(30), "Clean"),
    (7, "u", clock(31.5), "EDA"),
    (8, "v", clock(5), None),
    (9, "v", clock(6), "Load"),
]
DWELL = [
    ("u", "Load", clock(0), clock(12.4996), 12499, 12),
    ("u", "Clean", clock(12.4996), clock(20), 7500, 8),
    ("u", "Clean", clock(30), clock(31.5), 1500, 2),
]


@pytest.fixture(scope="module")
def visits(spark):
    return spark.createDataFrame(VISITS, "id int, user string, ts timestamp_ntz, tab string")


@pytest.mark.parametrize("ranges", [None, 6])
def test_dwell(visits, rows, ranges):
    assert rows(events.tab_dwell(visits, "user", "ts", "tab", ["ts", "id"], ranges)) == sorted(DWELL, key=repr)


CLICKS = [
    ("confirm_load", "Go", None, ["button_click", "load_dataset_click"]),
    ("x", " Load Dataset ", None, ["button_click", "load_dataset_click"]),
    ("b", "Apply and Save", None, ["button_click", "cleaning_apply_and_save_click"]),
    ("b", " Apply ", None, ["button_click", "feature_apply_click"]),
    ("b", "Apply scaling", None, ["button_click"]),
    ("reload", "Save to Pipeline", "Download plot as a PNG", ["button_click", "load_dataset_click", "feature_save_to_pipeline_click", "plot_download_png_click"]),
    (None, None, " Download plot as a PNG ", ["plot_download_png_click"]),
    (None, None, "Zoom", []),
]


def test_clicks(spark):
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(CLICKS)], "i int, id string, name string, title string")
    got = {}
    for r in events.classify_click(df, "id", "name", "title").collect():
        got.setdefault(r["i"], []).append(r["event_name"])
    assert {i: sorted(v) for i, v in got.items()} == {i: sorted(c[3]) for i, c in enumerate(CLICKS) if c[3]}


SUCCESS, REARM = "dataset_loaded_success", "load_dataset_click"
LOADS = [(1, SUCCESS), (2, SUCCESS), (3, "tab_view"), (4, REARM), (5, REARM), (6, "tab_view"), (7, SUCCESS), (8, SUCCESS)]


@pytest.mark.parametrize("ranges", [None, 5])
def test_first_success(spark, ranges):
    df = spark.createDataFrame([(u, i, clock(i), e) for u in "ab" for i, e in LOADS], "u string, id int, ts timestamp_ntz, e string")
    got = events.first_success(df, "u", "e", ["id"], ranges=ranges)
    assert sorted((r["u"], r["id"]) for r in got.collect()) == [("a", 1), ("a", 7), ("b", 1), ("b", 7)]


def test_only_a_confirmed_load_rearms(spark):
    presses = [(1, "ok", None, None), (2, "no", "download_report", "Get"), (3, "ok", None, None), (4, "no", "x-Confirm_Load", ""), (5, "ok", None, None), (6, "no", "b", "\n Load Dataset"), (7, "ok", None, None)]
    df = spark.createDataFrame([("u", *p) for p in presses], "u string, id int, e string, b string, n string")
    got = events.first_success(df, "u", "e", ["id"], "ok", events.load_confirmed(F.col("b"), F.col("n")))
    assert sorted(r["id"] for r in got.collect()) == [1, 5, 7]


def test_white_space_of_any_kind_is_trimmed(spark):
    df = spark.createDataFrame([("b", "\n   Apply\n ", "\tDownload plot as a PNG\n")], "id string, name string, title string")
    got = {r["event_name"] for r in events.classify_click(df, "id", "name", "title").collect()}
    assert got == {"button_click", "feature_apply_click", "plot_download_png_click"}


def test_state_store_is_the_sessions_to_set(spark, log, tmp_path):
    from tabwright.streaming.ordered import PROVIDER, ordered_state

    stream = as_stream(spark, log, str(tmp_path / "in"), 1)
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    try:
        with pytest.raises(RuntimeError, match="RocksDB"):
            streams.stream_dedup_success(stream, "user", "ts", "event", "id")
        with ordered_state(spark):
            assert "RocksDB" in spark.conf.get(PROVIDER)
        assert "HDFS" in spark.conf.get(PROVIDER)
    finally:
        spark.conf.set(PROVIDER, before)


def test_funnel(spark):
    log = [("u", "dataset_loaded_success"), ("u", "cleaning_applied_success"), ("v", "dataset_loaded_success"), ("v", "dataset_loaded_success"), (None, "proceed_to_eda")]
    df = spark.createDataFrame(log, "u string, e string")
    assert [tuple(r)[1:] for r in events.funnel_counts(df, "u", "e").orderBy("position").collect()] == [
        ("dataset_loaded_success", 2),
        ("cleaning_applied_success", 1),
        ("pipeline_saved", 0),
        ("proceed_to_eda", 0),
    ]


# -- streams: several files, one batch each, closed by a late mark -----------


def as_stream(spark, df, folder, parts):
    """The rows in ``parts`` files (in order of time), then a row that ends time."""
    schema = df.schema
    ordered = df.orderBy("ts").collect()
    size = -(-len(ordered) // parts)
    for i in range(parts):
        spark.createDataFrame(ordered[i * size : (i + 1) * size], schema).coalesce(1).write.mode("append").parquet(folder)
    end = df.limit(1).withColumn("ts", F.lit(clock(10**6)).cast("timestamp_ntz"))
    end.coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


@pytest.fixture(scope="module")
def log(spark):
    """Half of the events are of one user; times repeat."""
    return spark.range(600).selectExpr(
        "cast(id as int) as id",
        "if(id % 2 = 0, 0, cast(pmod(id * 31, 17) as int)) as user",
        "timestamp_ntz'2026-03-22 00:00:00' + make_dt_interval(0, 0, 0, floor(pmod(id * 7907, 600) / 2) * 37) as ts",
        "element_at(array('load_dataset_click', 'dataset_loaded_success', 'tab_view'), cast(pmod(id * 13 + floor(id / 7), 3) as int) + 1) as event",
        "if(id % 3 = 0, 'A', 'B') as grp",
    )


def test_stream_success_equals_batch(spark, log, tmp_path, rows):
    stream = as_stream(spark, log, str(tmp_path / "in"), 3)
    got = drain(streams.stream_dedup_success(stream, "user", "ts", "event", "id", delay="10 minutes"), "t")
    want = events.first_success(log, "user", "event", ["ts", "id"]).select("user", "ts")
    assert rows(got) == rows(want) and got.count() > 50


def test_stream_dwell_equals_batch(spark, log, tmp_path, rows):
    tabs = log.withColumn("tab", F.when(F.col("event") != "tab_view", F.col("event"))).drop("event")
    stream = as_stream(spark, tabs, str(tmp_path / "in"), 3)
    got = drain(streams.stream_dwell(stream, "user", "ts", "tab", "id", delay="10 minutes"), "t")
    want = events.tab_dwell(tabs, "user", "ts", "tab", ["ts", "id"])
    assert rows(got) == rows(want) and got.count() > 50


@pytest.mark.parametrize("slot", ["1 minute", "2 hours"])
def test_streams_do_not_depend_on_the_slot(spark, log, tmp_path, rows, slot):
    """Visits and successes go on over the ends of slots and batches."""
    tabs = log.withColumn("tab", F.when(F.col("event") != "tab_view", F.col("event"))).drop("event")
    stream = as_stream(spark, tabs, str(tmp_path / "tabs"), 2)
    got = drain(streams.stream_dwell(stream, "user", "ts", "tab", "id", delay="10 minutes", slot=slot), "t")
    assert rows(got) == rows(events.tab_dwell(tabs, "user", "ts", "tab", ["ts", "id"]))


def test_changes_of_a_slot(spark):
    """Ties go by the tie column, missing events are equal, rows without a time or user have a defined place."""
    found = [(1, 5, 2, "b"), (1, 5, 1, "a"), (1, 7, 1, "b"), (1, 9, 1, None), (1, 9, 2, None), (1, 11, 1, "b"), (None, 5, 1, "z"), (1, None, 1, "q")]
    df = spark.createDataFrame(found, "user int, s int, tie bigint, event string").selectExpr(
        "user", "timestamp_seconds(s) as ts", "s * 1000000L as us", "tie", "event"
    )
    got = {(r["user"], r["at"]): list(zip(r["events"], r["us"])) for r in slot_changes(df, "10 seconds").collect()}
    assert got == {
        (1, 0): [("a", 5_000_000), ("b", 5_000_000), (None, 9_000_000)],
        (1, 10_000_000): [("b", 11_000_000)],
        (None, 0): [("z", 5_000_000)],
    }


def test_stream_rollup_equals_batch(spark, log, tmp_path, rows):
    stream = as_stream(spark, log, str(tmp_path / "in"), 3)
    got = drain(streams.stream_rollup(stream, "grp", "event", "user", "ts", "1 hour", "10 minutes"), "t")
    want = streams.window_rollup(log, "grp", "event", "user", "ts", "1 hour")
    assert rows(got) == rows(want) and got.count() > 10
