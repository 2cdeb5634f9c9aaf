"""Event-log analytics on streams; each equals its batch twin on a finished input.

Rows at the time of a closing mark (see ``run.py``) move the watermark and are
left out after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.functions.columns import col
from tabwright.operators.events import rounded_seconds, success_marks
from tabwright.streaming.ordered import require_rocksdb, user_changes
from tabwright.streaming.run import before_closing


def _prepared(df: DataFrame, user: str, ts: str, tie: str, event: Column, delay: str) -> DataFrame:
    """user, ts, us, tie, event with a watermark on ts."""
    moment = col(ts).cast("timestamp")
    return df.select(
        col(user).alias("user"),
        moment.alias("ts"),
        F.unix_micros(moment).alias("us"),
        col(tie).cast("bigint").alias("tie"),
        event.cast("string").alias("event"),
    ).withWatermark("ts", delay).where(before_closing())


UTC_NAME = "UTC"
SUCCESS, REARM = "success", "rearm"


def _moment(us: str) -> Column:
    return F.timestamp_micros(us).cast("timestamp_ntz")


def stream_dedup_success(
    df: DataFrame,
    user: str,
    ts: str,
    event: str,
    tie: str,
    success: str = "dataset_loaded_success",
    rearm: str | Column = "load_dataset_click",
    delay: str = "1 hour",
    slot: str = "10 minutes",
) -> DataFrame:
    """user, ts of each success that comes first after a re-arming event.

    ``rearm`` is the name of an event, or a condition. Only the two events that
    matter reach the shuffle and the state. Rows come out when the watermark has
    passed the end of their ``slot``.
    """
    require_rocksdb(df.sparkSession)
    mark = success_marks(col(event), success, rearm)
    kind = F.when(mark, F.lit(SUCCESS)).when(~mark, F.lit(REARM))
    slim = df.withColumn("__kind", kind).filter(col("__kind").isNotNull() | ~before_closing(ts))
    changes = user_changes(_prepared(slim, user, ts, tie, col("__kind"), delay), slot)
    own = lambda c: F.slice(c, F.col("carried") + 1, F.size(c))
    found = changes.select("user", F.inline(F.arrays_zip(own("events").alias("event"), own("us").alias("us"))))
    return found.filter(F.col("event") == SUCCESS).select("user", _moment("us").alias("ts"))


def stream_dwell(
    df: DataFrame, user: str, ts: str, tab: str, tie: str, delay: str = "1 hour", slot: str = "10 minutes"
) -> DataFrame:
    """user, tab, started, ended, duration_ms, engagement_seconds per visit.

    A visit ends with the next change of the tab, a missing tab included. It comes
    out when the watermark has passed the ``slot`` of its end.
    """
    require_rocksdb(df.sparkSession)
    changes = user_changes(_prepared(df, user, ts, tie, col(tab), delay), slot)
    ends = F.slice("us", 2, F.size("us"))
    visits = changes.select(
        "user", F.inline(F.arrays_zip(F.col("events").alias("tab"), F.col("us").alias("start_us"), ends.alias("end_us")))
    ).filter("tab is not null and end_us is not null")
    ms = F.floor((F.col("end_us") - F.col("start_us")) / 1000).cast("bigint")
    return visits.select(
        "user",
        "tab",
        _moment("start_us").alias("started"),
        _moment("end_us").alias("ended"),
        ms.alias("duration_ms"),
        rounded_seconds(ms).alias("engagement_seconds"),
    )


def _instant(ts: str) -> Column:
    """Times without a zone are read as UTC, so that windows start on its hours."""
    wall = col(ts).cast("timestamp_ntz")
    return F.convert_timezone(F.lit(UTC_NAME), F.current_timezone(), wall).cast("timestamp")


def stream_rollup(
    df: DataFrame, group: str, event: str, user: str, ts: str, width: str = "1 hour", delay: str = "1 hour"
) -> DataFrame:
    """window_start, group, event_name, active_users, event_count per window.

    Counting per user first and then over users gives exact user counts with
    two chained aggregations, and spreads a hot group by its users.
    """
    slim = df.select(
        _instant(ts).alias("ts"), col(group).alias("group"), col(event).alias("event_name"), col(user).alias("user")
    ).withWatermark("ts", delay).where(before_closing())
    per_user = slim.groupBy(F.window("ts", width), "group", "event_name", "user").agg(
        F.count(F.lit(1)).alias("n")
    )
    return (
        per_user.groupBy(F.window("window", width), "group", "event_name")
        .agg(F.count("user").alias("active_users"), F.sum("n").alias("event_count"))
        .select(
            F.convert_timezone(F.current_timezone(), F.lit(UTC_NAME), F.col("window.start").cast("timestamp_ntz")).alias(
                "window_start"
            ),
            "group",
            "event_name",
            "active_users",
            "event_count",
        )
    )


def window_rollup(df: DataFrame, group: str, event: str, user: str, ts: str, width: str = "1 hour") -> DataFrame:
    """Batch twin of :func:`stream_rollup`."""
    per_user = df.groupBy(
        F.window(col(ts).cast("timestamp_ntz"), width).alias("w"),
        col(group).alias("group"),
        col(event).alias("event_name"),
        col(user).alias("user"),
    ).agg(F.count(F.lit(1)).alias("n"))
    return per_user.groupBy(
        F.col("w.start").alias("window_start"), "group", "event_name"
    ).agg(F.count("user").alias("active_users"), F.sum("n").alias("event_count"))
