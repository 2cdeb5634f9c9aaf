"""Event-log analytics: time in a tab, click names, first successes, funnel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.functions.columns import col, python_strip, require_columns
from tabwright.functions.ordered import Running, into_ranges, running, with_running
from tabwright.session import written

# The names of the event log.
FUNNEL = ("dataset_loaded_success", "cleaning_applied_success", "pipeline_saved", "proceed_to_eda")


def milliseconds(start: Column, end: Column) -> Column:
    micros = lambda t: F.unix_micros(t.cast("timestamp"))
    return F.floor((micros(end) - micros(start)) / 1000).cast("bigint")


def rounded_seconds(ms: Column) -> Column:
    return F.floor(ms / 1000 + 0.5).cast("bigint")


def tab_dwell(
    df: DataFrame, user: str, ts: str, tab: str, order_by: Sequence[str], ranges: int | None = None
) -> DataFrame:
    """user, tab, started, ended, duration_ms, engagement_seconds per visit.

    A row without a tab ends the visit (page hidden or left); a row with the
    same tab as the row before does not start a new one. Visits without an end
    are not reported.
    """
    require_columns(df, [user, ts, tab, *order_by])
    slim = df.select(*[col(c) for c in dict.fromkeys([user, ts, tab, *order_by])])
    ranged = into_ranges(slim, [user], order_by, ranges)
    before = running(ranged, [user], order_by, [Running("__before", "lag", tab)])
    # Written with their ranges: what follows reads the changes twice.
    changes = written(before.filter(~col(tab).eqNullSafe(F.col("__before"))).drop("__before"), "changes")
    visits = running(changes, [user], order_by, [Running("__end", "lead", ts)])
    took = milliseconds(col(ts), F.col("__end"))
    return visits.filter(col(tab).isNotNull() & F.col("__end").isNotNull()).select(
        col(user).alias("user"),
        col(tab).alias("tab"),
        col(ts).alias("started"),
        F.col("__end").alias("ended"),
        took.alias("duration_ms"),
        rounded_seconds(took).alias("engagement_seconds"),
    )


def click_events(button_id: Column, button_name: Column, title: Column) -> Column:
    """Array of event names of one click; a click can match several."""
    ident = F.lower(F.coalesce(button_id, F.lit("")))
    name = F.lower(python_strip(F.coalesce(button_name, F.lit(""))))
    button = button_id.isNotNull() | button_name.isNotNull()
    return F.array_compact(
        F.array(
            F.when(button, F.lit("button_click")),
            F.when(button & (ident.contains("load") | name.contains("load dataset")), F.lit("load_dataset_click")),
            F.when(button & name.contains("apply and save"), F.lit("cleaning_apply_and_save_click")),
            F.when(button & (name == "apply"), F.lit("feature_apply_click")),
            F.when(button & name.contains("save to pipeline"), F.lit("feature_save_to_pipeline_click")),
            F.when(python_strip(title) == "Download plot as a PNG", F.lit("plot_download_png_click")),
        )
    )


def classify_click(df: DataFrame, button_id: str, button_name: str, title: str) -> DataFrame:
    """One row per event a click stands for, with ``event_name``."""
    names = click_events(col(button_id), col(button_name), col(title))
    return df.withColumn("event_name", F.explode(names))


def load_confirmed(button_id: Column, button_name: Column) -> Column:
    """Whether a pressed button starts a load: only these re-arm its success."""
    ident, name = F.lower(F.coalesce(button_id, F.lit(""))), F.lower(F.coalesce(button_name, F.lit("")))
    return ident.contains("confirm_load") | name.contains("load dataset")


def success_marks(event: Column, success: str, rearm: str | Column) -> Column:
    """True for a success, false for a re-arming event, NULL for any other."""
    again = event == rearm if isinstance(rearm, str) else rearm
    return F.when(event == success, F.lit(True)).when(again, F.lit(False))


def first_success(
    df: DataFrame,
    user: str,
    event: str,
    order_by: Sequence[str],
    success: str = "dataset_loaded_success",
    rearm: str | Column = "load_dataset_click",
    ranges: int | None = None,
) -> DataFrame:
    """Success events that come first, or first after a re-arming event.

    ``rearm`` is the name of an event, or a condition such as
    :func:`load_confirmed`. Among a user's success and re-arm events, these are
    the successes whose predecessor is not a success.
    """
    slim = df.withColumn("__mark", success_marks(col(event), success, rearm)).filter("__mark is not null")
    before = with_running(slim, [user], order_by, [Running("__before", "lag", "__mark")], ranges)
    return before.filter("__mark and not coalesce(__before, false)").drop("__mark", "__before")


def funnel_counts(df: DataFrame, user: str, event: str, stages: Sequence[str] = FUNNEL) -> DataFrame:
    """position, stage, users: how many users sent each stage event."""
    flags = [F.max(F.when(col(event) == s, 1).otherwise(0)).alias(f"f{i}") for i, s in enumerate(stages)]
    users = df.filter(col(event).isin(*stages) & col(user).isNotNull()).groupBy(col(user)).agg(*flags)
    sums = users.agg(*[F.coalesce(F.sum(f"f{i}"), F.lit(0)).alias(f"s{i}") for i in range(len(stages))])
    rows = [
        F.struct(F.lit(i + 1).alias("position"), F.lit(s).alias("stage"), F.col(f"s{i}").alias("users"))
        for i, s in enumerate(stages)
    ]
    return sums.select(F.inline(F.array(*rows)))
