"""A/B experiment: assignment, cleaning, counts, exact test."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.functions.columns import col, require_columns

NOT_SET = "(not set)"
SIGNIFICANCE = 0.05


def assign_variant(df: DataFrame, user: str, salt: str = "", variants: Sequence[str] = ("A", "B")) -> DataFrame:
    """Add ``variant``: a stable even split by user, without stored state."""
    require_columns(df, [user])
    digest = F.md5(F.concat(F.lit(salt), F.lit(":"), col(user).cast("string")).cast("binary"))
    number = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    names = F.array(*[F.lit(v) for v in variants])
    return df.withColumn("variant", F.get(names, (number % len(variants)).cast("int")))


def clean_groups(df: DataFrame, group: str = "group") -> DataFrame:
    """Drop rows without a group and the ``(not set)`` group."""
    return df.filter(col(group).isNotNull() & (col(group) != NOT_SET))


def event_rollup(df: DataFrame, group: str, event: str, user: str, total: bool = True) -> DataFrame:
    """group, event_name, active_users, event_count; the grand total has neither.

    Events collapse to one row per user first, so a hot group or event is
    counted from many tasks.
    """
    per_user = df.groupBy(
        col(group).alias("group"), col(event).alias("event_name"), col(user).alias("__user")
    ).agg(F.count(F.lit(1)).alias("__n"))
    counts = [F.count("__user").alias("active_users"), F.sum("__n").alias("event_count")]
    parts = per_user.groupBy("group", "event_name").agg(*counts)
    if not total:
        return parts
    users = per_user.groupBy("__user").agg(F.sum("__n").alias("__n"))
    none = F.lit(None).cast("string")
    whole = users.agg(*counts).select(
        none.alias("group"), none.alias("event_name"), "active_users", F.coalesce("event_count", F.lit(0)).alias("event_count")
    )
    return parts.unionByName(whole)


def conversion(df: DataFrame, group: str, event: str, user: str, success: str) -> DataFrame:
    """group, success, failure, total, rate: users with and without the event."""
    users = (
        df.filter(col(user).isNotNull())
        .groupBy(col(group).alias("group"), col(user).alias("__user"))
        .agg(F.max(F.when(col(event) == success, 1).otherwise(0)).alias("__hit"))
    )
    return _rates(users.groupBy("group").agg(F.sum("__hit").alias("success"), F.count(F.lit(1)).alias("total")))


def _rates(df: DataFrame) -> DataFrame:
    return df.select(
        "group",
        "success",
        (F.col("total") - F.col("success")).alias("failure"),
        "total",
        (F.col("success") * 100.0 / F.nullif(F.col("total"), F.lit(0))).alias("rate"),
    )


def conversion_from_report(
    report: DataFrame, success: str, totals: Mapping[str, int] | None = None, total_event: str = "ab_group"
) -> DataFrame:
    """The same from an exported report.

    Totals are given, or the active users of ``total_event``; a group without
    the success event has 0.
    """
    clean = clean_groups(report, "group")
    users = lambda name: F.coalesce(F.max(F.when(F.col("event_name") == name, F.col("active_users"))), F.lit(0))
    out = clean.groupBy("group").agg(users(success).alias("success"), users(total_event).alias("total"))
    if totals is not None:
        given = None
        for g, n in totals.items():
            cond = F.col("group") == g
            given = F.when(cond, F.lit(n)) if given is None else given.when(cond, F.lit(n))
        out = out.filter(F.col("group").isin(*totals)).withColumn("total", given.cast("bigint"))
    return _rates(out)


def contingency(conversions: DataFrame, first: str = "A", second: str = "B") -> DataFrame:
    """One row a, b, c, d: success and failure of either group."""
    cell = lambda g, what: F.coalesce(F.sum(F.when(F.col("group") == g, F.col(what))), F.lit(0))
    return conversions.agg(
        cell(first, "success").alias("a"),
        cell(first, "failure").alias("b"),
        cell(second, "success").alias("c"),
        cell(second, "failure").alias("d"),
    )


def _span(low: Column, high: Column) -> Column:
    """low, low + 1 .. high; empty when high is below low."""
    return F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))


def fisher_exact(df: DataFrame, a: str = "a", b: str = "b", c: str = "c", d: str = "d") -> DataFrame:
    """Add odds_ratio and two-sided p_value for each row's 2x2 table.

    The table's probabilities with fixed margins are taken relative to the
    likeliest table and stepped outwards from it by their ratio, so no
    factorials are needed. Tables more than 40 deviations and 200 steps away
    weigh less than 1e-300 and add nothing to a double.
    """
    # Named columns stay short in the lambdas below.
    a_, b_, c_, d_ = (col(n).cast("bigint") for n in (a, b, c, d))
    n, row, column = F.col("__n"), F.col("__row"), F.col("__col")
    base = (
        df.withColumn("__a", a_)
        .withColumn("__n", a_ + b_ + c_ + d_)
        .withColumn("__row", a_ + b_)
        .withColumn("__col", a_ + c_)
    )
    real = lambda x: x.cast("double")
    spread = F.sqrt(real(row) * real(column) * real(n - row) * real(n - column) / (real(n) * real(n) * F.greatest(real(n) - 1, F.lit(1.0))))
    base = base.withColumn("__peak", F.floor(real(row + 1) * real(column + 1) / real(n + 2)).cast("bigint"))
    base = base.withColumn("__reach", F.ceil(40 * spread + 200).cast("bigint"))
    peak, reach = F.col("__peak"), F.col("__reach")
    base = base.withColumn("__from", F.greatest(F.lit(0).cast("bigint"), row + column - n, peak - reach))
    base = base.withColumn("__to", F.least(row, column, peak + reach))

    def up(k: Column) -> Column:
        """Weight of k over weight of k - 1."""
        return real(row - k + 1) * real(column - k + 1) / (real(k) * real(n - row - column + k))

    def down(k: Column) -> Column:
        """Weight of k over weight of k + 1."""
        return real(k + 1) * real(n - row - column + k + 1) / (real(row - k) * real(column - k))

    seen = F.col("__a")
    ups, downs = _span(peak + 1, F.col("__to")), F.reverse(_span(F.col("__from"), peak - 1))
    reached = F.when(
        seen >= peak, F.aggregate(F.filter(ups, lambda k: k <= seen), F.lit(1.0), lambda w, k: w * up(k))
    ).otherwise(F.aggregate(F.filter(downs, lambda k: k >= seen), F.lit(1.0), lambda w, k: w * down(k)))
    base = base.withColumn(
        "__seen", F.when((seen >= F.col("__from")) & (seen <= F.col("__to")), reached).otherwise(F.lit(0.0))
    )
    limit = F.col("__seen") * (1 + 1e-7)

    def total(ks: Column, step) -> Column:
        start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("every"), F.lit(0.0).alias("rare"))

        def move(acc: Column, k: Column) -> Column:
            w = acc["w"] * step(k)
            return F.struct(
                w.alias("w"),
                (acc["every"] + w).alias("every"),
                (acc["rare"] + F.when(w <= limit, w).otherwise(F.lit(0.0))).alias("rare"),
            )

        return F.aggregate(ks, start, move)

    base = base.withColumn("__up", total(ups, up)).withColumn("__down", total(downs, down))
    every = 1.0 + F.col("__up.every") + F.col("__down.every")
    rare = F.when(limit >= 1.0, F.lit(1.0)).otherwise(F.lit(0.0)) + F.col("__up.rare") + F.col("__down.rare")
    flat = (row == 0) | (column == 0) | (row == n) | (column == n)
    odds = F.when(flat, F.lit(None).cast("double")).when(
        (b_ > 0) & (c_ > 0), real(a_) * real(d_) / (real(F.greatest(b_, F.lit(1))) * real(F.greatest(c_, F.lit(1))))
    ).otherwise(F.lit(float("inf")))
    p = F.when(flat, F.lit(1.0)).otherwise(F.least(rare / every, F.lit(1.0)))
    return base.select(*[col(x) for x in df.columns], odds.alias("odds_ratio"), p.alias("p_value"))


def verdict(df: DataFrame, level: float = SIGNIFICANCE) -> DataFrame:
    """Add ``significant`` and ``conclusion`` from the p-value."""
    hit = F.col("p_value") < level
    return df.withColumn("significant", hit).withColumn(
        "conclusion", F.when(hit, F.lit("reject")).otherwise(F.lit("fail to reject"))
    )


def compare_groups(
    df: DataFrame, group: str, event: str, user: str, success: str, first: str = "A", second: str = "B"
) -> DataFrame:
    """From raw events to the verdict in one row."""
    rates = conversion(clean_groups(df, group), group, event, user, success)
    return verdict(fisher_exact(contingency(rates, first, second)))
