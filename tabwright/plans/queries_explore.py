"""Registered queries: chart data, experiment, event log, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwright.functions.counts import BUCKETS, most_frequent
from tabwright.operators import charts, events, experiment, features, outliers
from tabwright.plans.fixtures import table, with_more, with_variant
from tabwright.plans.recipe import Recipe
from tabwright.streaming import events as streams
from tabwright.streaming.ordered import ordered_state
from tabwright.streaming.run import drain, read_stream

QUERIES = {}
SQL = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


def _rounded(df, *names, digits=4):
    return df.withColumns({n: F.round(n, digits) + F.lit(0.0) for n in names})


def _bin(x: str, low: str, high: str, n: int) -> str:
    return f"cast(greatest(least(floor(({x} - {low}) / ({high} - {low}) * {n}), {n - 1}), 0) as bigint)"


# -- chart data -------------------------------------------------------------


@query(
    "histogram",
    f"""with e as (select min(o_totalprice) as a, max(o_totalprice) as b from orders),
    c as (select {_bin('o_totalprice', 'a', 'b', 20)} as bin, count(*) as n from orders, e group by 1)
    select range as bin, round(a + range * ((b - a) / 20), 4) as low, round(a + (range + 1) * ((b - a) / 20), 4) as high,
    coalesce(n, 0) as "count" from range(20), e left join c on c.bin = range""",
)
def _(spark, sf):
    return _rounded(charts.histogram(table(spark, sf, "orders"), "o_totalprice"), "low", "high")


@query(
    "histogram_by_group",
    f"""with e as (select min(l_quantity) as a, max(l_quantity) as b from lineitem),
    c as (select l_returnflag as g, {_bin('l_quantity', 'a', 'b', 7)} as bin, count(*) as n from lineitem, e group by 1, 2)
    select gs.g as "group", range as bin, round(a + range * ((b - a) / 7), 4) as low,
    round(a + (range + 1) * ((b - a) / 7), 4) as high, coalesce(n, 0) as "count"
    from (select distinct l_returnflag as g from lineitem) gs, range(7), e left join c on c.bin = range and c.g = gs.g""",
)
def _(spark, sf):
    return _rounded(charts.histogram(table(spark, sf, "lineitem"), "l_quantity", 7, "l_returnflag"), "low", "high")


@query(
    "time_histogram",
    f"""with s as (select epoch_us(ts) / 1000000.0::double as t from events), e as (select min(t) as a, max(t) as b from s),
    c as (select {_bin('t', 'a', 'b', 30)} as bin, count(*) as n from s, e group by 1)
    select range as bin, make_timestamp(cast(floor(a + range * ((b - a) / 30)) as bigint) * 1000000) as start,
    coalesce(n, 0) as "count" from range(30), e left join c on c.bin = range""",
)
def _(spark, sf):
    return charts.time_histogram(table(spark, sf, "events"), "ts")


@query(
    "after_counts",
    with_variant("dirty_customer", 'select coalesce(seg, null) as value, count(*) as "count" from d group by 1'),
)
def _(spark, sf):
    return charts.after_counts(table(spark, sf, "dirty_customer"), "seg")


@query(
    "bar_average",
    """select l_returnflag as x, l_linestatus as "group", round(avg(l_extendedprice), 4) as average, count(*) as n
    from lineitem group by 1, 2""",
)
def _(spark, sf):
    return _rounded(charts.bar_average(table(spark, sf, "lineitem"), "l_returnflag", "l_extendedprice", "l_linestatus"), "average")


@query(
    "bar_average_binned",
    f"""with e as (select min(l_quantity) as a, max(l_quantity) as b from lineitem)
    select {_bin('l_quantity', 'a', 'b', 10)} as x, round(avg(l_extendedprice), 4) as average, count(*) as n
    from lineitem, e group by 1""",
)
def _(spark, sf):
    return _rounded(charts.bar_average(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", bins=10), "average")


_BOXES = """q as (select l_returnflag as g, l_linestatus as s, quantile_cont(v, 0.25) as q1, quantile_cont(v, 0.5) as median,
    quantile_cont(v, 0.75) as q3 from t group by 1, 2),
    f as (select t.*, q1, median, q3, v between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1) as inside
        from t join q on g = l_returnflag and s = l_linestatus)"""
# Prices to the fourth power, so that some of them are outliers.
_SKEWED = "t as (select l_returnflag, l_linestatus, l_extendedprice * l_extendedprice / 1e6 * (l_extendedprice * l_extendedprice / 1e6) as v from lineitem)"


def _skewed(spark, sf):
    p = F.col("l_extendedprice")
    return table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", (p * p / F.lit(1e6) * (p * p / F.lit(1e6))).alias("v"))


@query(
    "box_stats",
    f"""with {_SKEWED}, {_BOXES}
    select l_returnflag, l_linestatus, count(*) as n, round(max(q1), 3) as q1, round(max(median), 3) as median, round(max(q3), 3) as q3,
    round(min(v) filter (where inside), 3) as whisker_low, round(max(v) filter (where inside), 3) as whisker_high,
    count(*) filter (where not inside) as outliers from f group by 1, 2""",
)
def _(spark, sf):
    boxes = charts.box_stats(_skewed(spark, sf), "v", ["l_returnflag", "l_linestatus"])
    return _rounded(boxes, "q1", "median", "q3", "whisker_low", "whisker_high", digits=3)


@query(
    "box_stats_sketch",
    f"""with {_SKEWED}
    select l_returnflag, l_linestatus, count(*) as n, true as q1_near, true as median_near, true as q3_near from t group by 1, 2""",
)
def _(spark, sf):
    """Quartiles from sketches, each with whether its rank is within a hundredth of the rows."""
    keys = ["l_returnflag", "l_linestatus"]
    rows = _skewed(spark, sf)
    boxes = charts.box_stats(rows, "v", keys, accuracy=1000)
    near = {}
    for name, share in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
        below, upto = F.avg((F.col("v") < F.col(name)).cast("int")), F.avg((F.col("v") <= F.col(name)).cast("int"))
        near[name] = ((below <= share + 0.01) & (upto >= share - 0.01)).alias(f"{name}_near")
    return rows.join(boxes, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *near.values())


@query(
    "box_outliers",
    f"""with {_SKEWED}, {_BOXES}
    select l_returnflag, l_linestatus, round(v, 3) as value, count(*) as n from f where not inside group by 1, 2, v""",
)
def _(spark, sf):
    return _rounded(charts.box_outliers(_skewed(spark, sf), "v", ["l_returnflag", "l_linestatus"]), "value", digits=3)


@query(
    "pie_top",
    """with c as (select p_brand as value, count(*) as n from part group by 1),
    t as (select * from c order by n desc, value limit 19)
    select value, n as "count" from t union all
    select 'Other', (select count(*) from part) - (select cast(sum(n) as bigint) from t)""",
)
def _(spark, sf):
    return charts.pie_top(table(spark, sf, "part"), "p_brand")


@query(
    "pie_top_of_many",
    """with c as (select cast(l_partkey as varchar) as value, count(*) as n from lineitem group by 1),
    t as (select * from c order by n desc, value limit 19)
    select value, n as "count" from t union all
    select 'Other', (select count(*) from lineitem) - (select cast(sum(n) as bigint) from t)""",
)
def _(spark, sf):
    return charts.pie_top(table(spark, sf, "lineitem"), "l_partkey", buckets=BUCKETS)


@query(
    "most_frequent",
    """select user_id as value, count(*) as "count" from events group by 1 order by 2 desc, 1 nulls first limit 25""",
)
def _(spark, sf):
    return most_frequent(table(spark, sf, "events"), "user_id", 25)


@query("scatter_points", "select l_quantity, l_extendedprice, l_returnflag from lineitem")
def _(spark, sf):
    return charts.scatter_points(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", "l_returnflag")


@query(
    "scatter_sample",
    """select l_quantity, l_extendedprice from lineitem
    where cast('0x' || substr(md5('11|' || l_orderkey || '|' || l_linenumber), 1, 8) as bigint) / 4294967296.0 < 0.01""",
)
def _(spark, sf):
    """One point in a hundred, by a hash of the row's key."""
    key = ["l_orderkey", "l_linenumber"]
    return charts.scatter_points(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", fraction=0.01, by=key)


@query(
    "scatter_rows",
    """select l_returnflag, l_quantity, l_extendedprice from lineitem
    qualify row_number() over (partition by l_returnflag
        order by md5('11|' || l_orderkey || '|' || l_linenumber), l_quantity, l_extendedprice) <= 500""",
)
def _(spark, sf):
    """Five hundred points of each flag, by a hash of the row's key."""
    key = ["l_orderkey", "l_linenumber"]
    return charts.scatter_points(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", "l_returnflag", by=key, rows=500)


@query(
    "scatter_grid",
    f"""with e as (select min(l_quantity) as xa, max(l_quantity) as xb, min(l_extendedprice) as ya, max(l_extendedprice) as yb from lineitem)
    select l_returnflag as "group", {_bin('l_quantity', 'xa', 'xb', 25)} as bin_x,
    {_bin('l_extendedprice', 'ya', 'yb', 25)} as bin_y, count(*) as "count" from lineitem, e group by 1, 2, 3""",
)
def _(spark, sf):
    return charts.scatter_grid(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", 25, "l_returnflag")


@query(
    "ols_trend",
    """select l_returnflag as "group", round(regr_slope(l_extendedprice, l_quantity), 4) as slope,
    round(regr_intercept(l_extendedprice, l_quantity), 4) as intercept, round(regr_r2(l_extendedprice, l_quantity), 4) as r2,
    cast(regr_count(l_extendedprice, l_quantity) as bigint) as n from lineitem group by 1""",
)
def _(spark, sf):
    lines = charts.ols_trend(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", "l_returnflag")
    return _rounded(lines, "slope", "intercept", "r2")


@query(
    "violin_density",
    f"""with t as (select o_orderpriority as g, o_totalprice as v from orders),
    s as (select g, count(*) as n, min(v) as a, max(v) as b, 1.059 * least(stddev_samp(v),
        (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) / 1.349) * power(count(*), -0.2) as h from t group by 1),
    c as (select t.g, least(floor((v - a) / ((b - a) / 512)), 511) as k, count(*) as m from t join s using (g) group by 1, 2),
    p as (select g, n, a, b, h, range as point, a - 2 * h + (b + 2 * h - (a - 2 * h)) * range / 99 as x from s, range(100))
    select p.g as o_orderpriority, cast(point as integer) as point, round(any_value(p.x), 4) as "at",
    round(sum(m * exp(-0.5 * power((p.x - (a + (k + 0.5) * ((b - a) / 512))) / h, 2))) / (any_value(n) * any_value(h) * 2.5066282746310002), 12) as density
    from p join c on c.g = p.g group by 1, 2""",
)
def _(spark, sf):
    curves = charts.violin_density(table(spark, sf, "orders"), "o_totalprice", ["o_orderpriority"])
    return _rounded(_rounded(curves, "at"), "density", digits=12)


_PAIR = ("l_quantity", "l_extendedprice", "l_discount")


@query(
    "pair_grid",
    "with e as (select "
    + ", ".join(f"min({c}) as a_{c}, max({c}) as b_{c}" for c in _PAIR)
    + " from lineitem)\n"
    + "\nunion all ".join(
        f"""select '{y}' as "row", '{x}' as "col", {_bin(x, 'a_' + x, 'b_' + x, 12)} as bin_x,
        {_bin(y, 'a_' + y, 'b_' + y, 12)} as bin_y, count(*) as "count" from lineitem, e group by 1, 2, 3, 4"""
        for i, y in enumerate(_PAIR)
        for x in _PAIR[: i + 1]
    ),
)
def _(spark, sf):
    return charts.pair_grid(table(spark, sf, "lineitem"), list(_PAIR), 12)


_HEAT = ("p_partkey", "p_size", "p_retailprice")


@query(
    "heatmap_long",
    "\nunion all ".join(
        f"""select '{a}' as "row", '{b}' as "col",
        round(regr_sxy({a}, {b}) / nullif(sqrt(regr_sxx({a}, {b}) * regr_syy({a}, {b})), 0), 2) + 0.0 as r from part"""
        for a in _HEAT
        for b in _HEAT
    ),
)
def _(spark, sf):
    return charts.heatmap_long(table(spark, sf, "part"))


# -- experiment -------------------------------------------------------------


@query(
    "assign_variant",
    """select event_id, user_id, case when cast(concat('0x', substr(md5(concat('exp1:', user_id)), 1, 8)) as bigint) % 2 = 0
    then 'A' else 'B' end as variant from events""",
)
def _(spark, sf):
    return experiment.assign_variant(table(spark, sf, "events").select("event_id", "user_id"), "user_id", "exp1")


@query("clean_groups", with_variant("ab_events", "select * from d where grp <> '(not set)'"))
def _(spark, sf):
    return experiment.clean_groups(table(spark, sf, "ab_events"), "grp")


@query(
    "event_rollup",
    with_variant(
        "ab_events",
        """select grp as "group", event_type as event_name, count(distinct user_id) as active_users, count(*) as event_count
        from d group by 1, 2 union all select null, null, count(distinct user_id), count(*) from d""",
    ),
)
def _(spark, sf):
    return experiment.event_rollup(table(spark, sf, "ab_events"), "grp", "event_type", "user_id")


# A user of group A counts as converted by an early sign-up.
_CONVERTED = """select event_id, user_id, case when user_id % 2 = 0 then 'A' when user_id % 10 = 9 then '(not set)' else 'B' end as grp,
    case when event_type = 'signup' and event_id % 13 < 2 then 'loaded' else event_type end as event_type from {events}"""


def _converted(spark, sf):
    return spark.sql(_CONVERTED.format(events="{events}"), events=table(spark, sf, "events"))


_RATES = f"""d as ({_CONVERTED.format(events='events')}),
    u as (select grp, user_id, max(case when event_type = 'loaded' then 1 else 0 end) as hit from d
        where grp <> '(not set)' group by 1, 2),
    r as (select grp, cast(sum(hit) as bigint) as success, count(*) as total from u group by 1),
    x as (select max(success) filter (where grp = 'A') as a, max(total - success) filter (where grp = 'A') as b,
        max(success) filter (where grp = 'B') as c, max(total - success) filter (where grp = 'B') as d from r)"""


@query(
    "conversion",
    f"""with {_RATES} select grp as "group", success, total - success as failure, total, round(success * 100.0 / total, 4) as rate from r""",
)
def _(spark, sf):
    clean = experiment.clean_groups(_converted(spark, sf), "grp")
    return _rounded(experiment.conversion(clean, "grp", "event_type", "user_id", "loaded"), "rate")


@query(
    "conversion_from_report",
    with_variant(
        "ab_events",
        """select grp as "group", count(distinct user_id) filter (where event_type = 'purchase') as success,
        count(distinct user_id) filter (where event_type = 'view') - count(distinct user_id) filter (where event_type = 'purchase') as failure,
        count(distinct user_id) filter (where event_type = 'view') as total,
        round(count(distinct user_id) filter (where event_type = 'purchase') * 100.0 / count(distinct user_id) filter (where event_type = 'view'), 4) as rate
        from d where grp <> '(not set)' group by 1""",
    ),
)
def _(spark, sf):
    report = experiment.event_rollup(table(spark, sf, "ab_events"), "grp", "event_type", "user_id")
    return _rounded(experiment.conversion_from_report(report, "purchase", total_event="view"), "rate")


@query(
    "conversion_from_report_totals",
    with_variant(
        "ab_events",
        """select grp as "group", count(distinct user_id) filter (where event_type = 'purchase') as success,
        case grp when 'A' then 400 else 500 end - count(distinct user_id) filter (where event_type = 'purchase') as failure,
        cast(case grp when 'A' then 400 else 500 end as bigint) as total,
        round(count(distinct user_id) filter (where event_type = 'purchase') * 100.0 / case grp when 'A' then 400 else 500 end, 4) as rate
        from d where grp <> '(not set)' group by 1""",
    ),
)
def _(spark, sf):
    report = experiment.event_rollup(table(spark, sf, "ab_events"), "grp", "event_type", "user_id")
    return _rounded(experiment.conversion_from_report(report, "purchase", totals={"A": 400, "B": 500}), "rate")


@query("contingency", f"with {_RATES} select a, b, c, d from x")
def _(spark, sf):
    clean = experiment.clean_groups(_converted(spark, sf), "grp")
    return experiment.contingency(experiment.conversion(clean, "grp", "event_type", "user_id", "loaded"))


_FISHER = """ks as (select unnest(generate_series(greatest(0, r1 + c1 - n), least(r1, c1))) as k, r1, c1, n, a
        from (select a + b as r1, a + c as c1, a + b + c + d as n, a from x)),
    ls as (select k, a, lgamma(r1 + 1) - lgamma(k + 1) - lgamma(r1 - k + 1)
        + lgamma(n - r1 + 1) - lgamma(c1 - k + 1) - lgamma(n - r1 - c1 + k + 1)
        - lgamma(n + 1) + lgamma(c1 + 1) + lgamma(n - c1 + 1) as lp from ks)"""


def _fisher_sql(tail: str) -> str:
    return f"with {_RATES}, {_FISHER} {tail}"


_P = "least(1, (select sum(exp(lp)) from ls where lp <= (select lp from ls where k = a) + 1e-7))"


@query(
    "fisher_exact",
    _fisher_sql(f"select a, b, c, d, round(cast(a * d as double) / (b * c), 6) as odds_ratio, round({_P}, 6) as p_value from x"),
)
def _(spark, sf):
    clean = experiment.clean_groups(_converted(spark, sf), "grp")
    table_2x2 = experiment.contingency(experiment.conversion(clean, "grp", "event_type", "user_id", "loaded"))
    return _rounded(experiment.fisher_exact(table_2x2), "odds_ratio", "p_value", digits=6)


@query(
    "verdict",
    _fisher_sql(
        f"""select round({_P}, 6) as p_value, {_P} < 0.05 as significant,
        case when {_P} < 0.05 then 'reject' else 'fail to reject' end as conclusion from x"""
    ),
)
def _(spark, sf):
    found = experiment.compare_groups(_converted(spark, sf), "grp", "event_type", "user_id", "loaded")
    return _rounded(found, "p_value", digits=6).select("p_value", "significant", "conclusion")


# -- event log --------------------------------------------------------------


def _dwell_sql() -> str:
    return """with t as (select event_id, user_id, ts, case when event_type <> 'error' then event_type end as tab from events),
    c as (select *, lag(tab) over w as before from t window w as (partition by user_id order by ts, event_id)),
    v as (select *, lead(ts) over (partition by user_id order by ts, event_id) as ended from c where tab is distinct from before)
    select user_id as "user", tab, ts as started, ended, cast(floor((epoch_us(ended) - epoch_us(ts)) / 1000) as bigint) as duration_ms,
    cast(floor(floor((epoch_us(ended) - epoch_us(ts)) / 1000) / 1000 + 0.5) as bigint) as engagement_seconds
    from v where tab is not null and ended is not null"""


def _tabs(df):
    """The kind of event stands for the tab; an error leaves the page."""
    tab = F.when(F.col("event_type") != "error", F.col("event_type"))
    return df.select("event_id", "user_id", "ts", tab.alias("tab"))


@query("tab_dwell", _dwell_sql())
def _(spark, sf):
    return events.tab_dwell(_tabs(table(spark, sf, "events")), "user_id", "ts", "tab", ["ts", "event_id"])


@query(
    "classify_click",
    with_variant(
        "click_events",
        """select * from (select d.*, unnest([
            case when button_id is not null or button_name is not null then 'button_click' end,
            case when lower(button_id) like '%load%' or lower(button_name) like '%load dataset%' then 'load_dataset_click' end,
            case when lower(button_name) like '%apply and save%' then 'cleaning_apply_and_save_click' end,
            case when lower(trim(button_name, ' ' || chr(9) || chr(10))) = 'apply' then 'feature_apply_click' end,
            case when lower(button_name) like '%save to pipeline%' then 'feature_save_to_pipeline_click' end,
            case when trim(title, ' ' || chr(9) || chr(10)) = 'Download plot as a PNG' then 'plot_download_png_click' end]) as event_name from d) where event_name is not null""",
    ),
)
def _(spark, sf):
    return events.classify_click(table(spark, sf, "click_events"), "button_id", "button_name", "title")


def _first_sql() -> str:
    return """with t as (select event_id, user_id, ts, event_type, lag(event_type) over (partition by user_id order by ts, event_id) as before
        from events where event_type in ('purchase', 'click'))"""


@query(
    "first_success",
    _first_sql()
    + " select event_id, user_id, ts, event_type from t where event_type = 'purchase' and coalesce(before, 'click') = 'click'",
)
def _(spark, sf):
    df = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    return events.first_success(df, "user_id", "event_type", ["ts", "event_id"], "purchase", "click")


_STAGES = ("view", "click", "signup", "purchase")


@query(
    "first_success_by_clicks",
    """with t as (select event_id, user_id, ts, lag(event_type) over (partition by user_id order by ts, event_id) as before, event_type
    from events where event_type in ('purchase', 'click', 'signup'))
    select event_id, user_id, ts, event_type from t where event_type = 'purchase' and before is distinct from 'purchase'""",
)
def _(spark, sf):
    """Only a confirmed load re-arms: neither another id with "load" in it nor another text does."""
    kind = F.col("event_type")
    ident = F.when(kind == "click", F.lit("x-Confirm_LOAD")).when(kind == "view", F.lit("download_report"))
    name = F.when(kind == "signup", F.lit("\n Load Dataset\t")).when(kind == "error", F.lit("Reload"))
    log = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    return events.first_success(
        log, "user_id", "event_type", ["ts", "event_id"], "purchase", events.load_confirmed(ident, name)
    )


@query(
    "funnel_counts",
    "\nunion all ".join(
        f"select {i + 1} as position, '{s}' as stage, count(distinct user_id) as users from events where event_type = '{s}'"
        for i, s in enumerate(("view", "click", "signup", "purchase"))
    ),
)
def _(spark, sf):
    return events.funnel_counts(table(spark, sf, "events"), "user_id", "event_type", ("view", "click", "signup", "purchase"))


# -- streams ----------------------------------------------------------------

# Each finished input is closed, so that a stream gives what its batch twin gives.


@query(
    "stream_dedup_success",
    _first_sql() + " select user_id as \"user\", ts from t where event_type = 'purchase' and coalesce(before, 'click') = 'click'",
)
def _(spark, sf):
    with ordered_state(spark):
        source, close = read_stream(spark, sf, "events.parquet")
        found = streams.stream_dedup_success(source, "user_id", "ts", "event_type", "event_id", "purchase", "click")
        return drain(found, "dedup", close)


@query("stream_dwell", _dwell_sql())
def _(spark, sf):
    with ordered_state(spark):
        source, close = read_stream(spark, sf, "events.parquet")
        return drain(streams.stream_dwell(_tabs(source), "user_id", "ts", "tab", "event_id"), "dwell", close)


@query(
    "stream_rollup",
    """select time_bucket(interval 1 day, ts) as window_start, case when user_id % 2 = 0 then 'A' else 'B' end as "group",
    event_type as event_name, count(distinct user_id) as active_users, count(*) as event_count from events group by 1, 2, 3""",
)
def _(spark, sf):
    group = F.when(F.col("user_id") % 2 == 0, F.lit("A")).otherwise(F.lit("B"))
    source, close = read_stream(spark, sf, "events.parquet")
    found = streams.stream_rollup(source.withColumn("grp", group), "grp", "event_type", "user_id", "ts", "1 day")
    return drain(found, "rollup", close)


@query(
    "window_rollup",
    """select time_bucket(interval 1 day, ts) as window_start, event_type as "group", event_type as event_name,
    count(distinct user_id) as active_users, count(*) as event_count from events group by 1, 2, 3""",
)
def _(spark, sf):
    return streams.window_rollup(table(spark, sf, "events"), "event_type", "event_type", "user_id", "ts", "1 day")


# -- whole preparations -----------------------------------------------------

_FLAGSHIP = """with b as (select q1 - 1.5 * (q3 - q1) as lo, q3 + 1.5 * (q3 - q1) as hi from
    (select quantile_cont(o_totalprice, 0.25) as q1, quantile_cont(o_totalprice, 0.75) as q3 from orders)),
    c as (select o_orderpriority, ln(greatest(least(greatest(o_totalprice, lo), hi), 1e-10)) as y from orders, b)
    select o_orderpriority as x, round(avg(y), 6) as average, count(*) as n from c group by 1"""


@query("capped_log_average", _FLAGSHIP)
def flagship(spark, sf):
    """Cap prices, take their logarithm, average it by priority."""
    orders = table(spark, sf, "orders").select("o_orderpriority", "o_totalprice")
    capped = outliers.iqr_cap(orders, ["o_totalprice"])
    logged = features.log(capped, "o_totalprice")
    return _rounded(charts.bar_average(logged, "o_orderpriority", "o_totalprice_log"), "average", digits=6)


@query(
    "prepared_customers",
    with_more(
        "dirty_customer",
        """p as (select c_custkey, lower(case when trim(seg) not in ('N/A', '?') then trim(seg) end) as seg, bal,
            cast(replace(replace(money, '$', ''), ',', '') as bigint) as money, c_nationkey from d),
        m as (select (select median(bal) from p) as mb,
            (select seg from p where seg is not null group by seg order by count(*) desc, seg limit 1) as ms)""",
        """select c_custkey, coalesce(seg, ms) as seg, round(coalesce(bal, mb), 4) + 0.0 as bal, money, c_nationkey,
        round(ln(1 + money), 4) + 0.0 as money_log1p from p, m where c_nationkey >= 3""",
    ),
)
def _(spark, sf):
    recipe = (
        Recipe()
        .then("standardize_missing")
        .then("format_standardize", lower=True, characters="$,")
        .then("impute_all")
        .then("drop_duplicates")
        .then("filter_range", column="c_nationkey", low=3)
        .then("log1p", column="money")
    )
    return _rounded(recipe.run(table(spark, sf, "dirty_customer")), "bal", "money_log1p")
