"""Registered queries: outliers, scaling, encoding, features."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwright.operators import features, outliers, scaling
from tabwright.operators.features import DATE_SUFFIXES
from tabwright.plans.fixtures import table, with_more, with_variant

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
    """Rounded for comparison; adding 0.0 turns a negative zero positive."""
    return df.withColumns({n: F.round(n, digits) + F.lit(0.0) for n in names})


# -- outliers ---------------------------------------------------------------

_IQR = """b as (select q1 - 1.5 * (q3 - q1) as lo, q3 + 1.5 * (q3 - q1) as hi from
    (select quantile_cont(bal, 0.25) as q1, quantile_cont(bal, 0.75) as q3 from v))"""
_SPREAD = "v as (select c_custkey, case when c_custkey % 5 <> 0 then c_acctbal * c_acctbal * c_acctbal / 1000000 end as bal from customer)"


def _spread(spark, sf):
    """Account balances cubed (so that some lie far out), every fifth missing."""
    x = F.col("c_acctbal")
    return table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("c_custkey"),
        F.when(F.col("c_custkey") % 5 != 0, x * x * x / F.lit(1000000)).alias("bal"),
    )


def _on_spread(bounds: str, tail: str) -> str:
    return f"with {_SPREAD}, {bounds} {tail}"


_KEEP = "select cast(c_custkey as varchar) as c_custkey, round(bal, 4) + 0.0 as bal from v, b where bal is null or bal between lo and hi"
_CAP = "select cast(c_custkey as varchar) as c_custkey, round(case when bal is not null then least(greatest(bal, lo), hi) end, 4) + 0.0 as bal from v, b"
_Z = "b as (select avg(bal) - 2 * stddev_samp(bal) as lo, avg(bal) + 2 * stddev_samp(bal) as hi from v)"


@query("iqr_remove", _on_spread(_IQR, _KEEP))
def _(spark, sf):
    return _rounded(outliers.iqr_remove(_spread(spark, sf)), "bal")


@query("iqr_cap", _on_spread(_IQR, _CAP))
def _(spark, sf):
    return _rounded(outliers.iqr_cap(_spread(spark, sf)), "bal")


@query("zscore_remove", _on_spread(_Z, _KEEP))
def _(spark, sf):
    return _rounded(outliers.zscore_remove(_spread(spark, sf), threshold=2), "bal")


@query("zscore_cap", _on_spread(_Z, _CAP))
def _(spark, sf):
    return _rounded(outliers.zscore_cap(_spread(spark, sf), threshold=2), "bal")


@query(
    "percentile_cap",
    """with b as (select quantile_cont(l_extendedprice, 0.05) as pl, quantile_cont(l_extendedprice, 0.95) as ph,
    quantile_cont(l_quantity, 0.05) as ql, quantile_cont(l_quantity, 0.95) as qh from lineitem)
    select l_returnflag, round(least(greatest(l_extendedprice, pl), ph), 4) as l_extendedprice,
    round(least(greatest(l_quantity, ql), qh), 4) as l_quantity from lineitem, b""",
)
def _(spark, sf):
    df = table(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice", "l_quantity")
    return _rounded(outliers.percentile_cap(df, cutoff=5), "l_extendedprice", "l_quantity")


# -- scaling and encoding ---------------------------------------------------


@query(
    "standard_scale",
    """with s as (select avg(l_quantity) as qm, stddev_pop(l_quantity) as qs, avg(l_extendedprice) as pm,
    stddev_pop(l_extendedprice) as ps from lineitem)
    select l_orderkey, l_linenumber, round((l_quantity - qm) / qs, 4) + 0.0 as l_quantity,
    round((l_extendedprice - pm) / ps, 4) + 0.0 as l_extendedprice, cast(0 as double) as flat,
    case when l_linenumber > 1 then l_tax end as gap from lineitem, s""",
)
def _(spark, sf):
    df = table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_quantity",
        "l_extendedprice",
        F.lit(2.5).alias("flat"),
        F.when(F.col("l_linenumber") > 1, F.col("l_tax")).alias("gap"),
    )
    return _rounded(scaling.standard_scale(df, exclude=["l_orderkey", "l_linenumber"]), "l_quantity", "l_extendedprice")


@query(
    "minmax_scale",
    """with s as (select min(o_totalprice) as a, max(o_totalprice) as b from orders)
    select o_orderkey, round((o_totalprice - a) / (b - a), 6) as o_totalprice, o_orderpriority from orders, s""",
)
def _(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    return _rounded(scaling.minmax_scale(df, exclude=["o_orderkey"]), "o_totalprice", digits=6)


_FLAGS = ("A", "N", "R")
_STATES = ("F", "O")


@query(
    "one_hot",
    "select l_orderkey, l_linenumber, "
    + ", ".join(
        [f"coalesce(l_returnflag = '{v}', false) as \"l_returnflag_{v}\"" for v in _FLAGS]
        + [f"coalesce(st = '{v}', false) as \"st_{v}\"" for v in _STATES]
    )
    + " from (select *, case when l_linenumber <> 2 then l_linestatus end as st from lineitem)",
)
def _(spark, sf):
    df = table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_returnflag",
        F.when(F.col("l_linenumber") != 2, F.col("l_linestatus")).alias("st"),
    )
    return scaling.one_hot(df)


@query(
    "one_hot_sparse",
    """with c as (select p_name, dense_rank() over (order by p_name) - 1 as code from (select distinct p_name from part)),
    d as (select p_brand, dense_rank() over (order by p_brand) - 2 as code from (select distinct p_brand from part))
    select p_partkey, (select count(*) from c) as names, c.code as name, (select count(*) - 1 from d) as brands,
    case when d.code >= 0 then d.code end as brand from part join c using (p_name) join d using (p_brand)""",
)
def _(spark, sf):
    """Indicators of names, too many for columns, and of brands less the first."""
    parts = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand")
    hot = scaling.one_hot_sparse(scaling.one_hot_sparse(parts, ["p_name"]), ["p_brand"], drop_first=True)
    at = lambda c: F.get(F.col(f"{c}_hot.indices"), F.lit(0))
    return hot.select(
        "p_partkey", F.col("p_name_hot.size").alias("names"), at("p_name").alias("name"),
        F.col("p_brand_hot.size").alias("brands"), at("p_brand").alias("brand"),
    )


@query(
    "label_encode",
    with_more(
        "dirty_customer",
        """codes as (select money as v, dense_rank() over (order by money) - 1 as code from (select distinct money from d)),
        segs as (select seg as v, dense_rank() over (order by seg) - 1 as code from
            (select distinct seg from d where seg is not null))""",
        """select c_custkey, coalesce(s.code, -1) as seg, bal, coalesce(m.code, -1) as money, c_nationkey
        from d left join segs s on d.seg = s.v left join codes m on d.money = m.v""",
    ),
)
def _(spark, sf):
    return scaling.label_encode(table(spark, sf, "dirty_customer"))


@query(
    "label_encode_text",
    """select doc_id, dense_rank() over (order by encode(text)) - 1 as text, dense_rank() over (order by lang) - 1 as lang from documents""",
)
def _(spark, sf):
    """Whole texts as labels."""
    return scaling.label_encode(table(spark, sf, "documents").select("doc_id", "text", "lang"))


@query("one_hot_drop_first", "select l_orderkey, l_linenumber, " + ", ".join(f"l_returnflag = '{v}' as \"l_returnflag_{v}\"" for v in _FLAGS[1:]) + " from lineitem")
def _(spark, sf):
    return scaling.one_hot(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"), drop_first=True)


# -- features ---------------------------------------------------------------


def _gap(spark, sf):
    return table(spark, sf, "gap_events").select("event_id", (F.col("value") - 50).alias("x"))


def _single(name: str, expression: str) -> None:
    sql = f"select event_id, x, round({expression}, 6) + 0.0 as x_{name} from (select event_id, value - 50 as x from d)"

    def run(spark, sf, step=features.SINGLE[name]):
        return _rounded(step(_gap(spark, sf), "x"), f"x_{name}", digits=6)

    QUERIES[name] = run
    SQL[name] = with_variant("gap_events", sql)


_single("log", "case when x is not null then ln(greatest(x, 1e-10)) end")
_single("log1p", "case when x is not null then ln(1 + greatest(x, 0)) end")
_single("sqrt", "case when x is not null then sqrt(greatest(x, 0)) end")
_single("square", "x * x")
_single("zscore", "(x - avg(x) over ()) / stddev_samp(x) over ()")
_single("minmax", "(x - min(x) over ()) / (max(x) over () - min(x) over ())")


@query(
    "binning",
    """with e as (select min(p_retailprice) as a, max(p_retailprice) as b from part),
    t as (select p_partkey, p_retailprice, case when p_retailprice <= a + (b - a) / 4 then 1
        when p_retailprice <= a + 2 * ((b - a) / 4) then 2 when p_retailprice <= a + 3 * ((b - a) / 4) then 3 else 4 end as k,
        a - 0.001 * (b - a) as e0, a + (b - a) / 4 as e1, a + 2 * ((b - a) / 4) as e2, a + 3 * ((b - a) / 4) as e3, b as e4
        from part, e)
    select p_partkey, p_retailprice, case k
        when 1 then format('({}, {}]', round(round(e0, 3) - 0.001, 3), round(e1, 3))
        when 2 then format('({}, {}]', round(e1, 3), round(e2, 3))
        when 3 then format('({}, {}]', round(e2, 3), round(e3, 3))
        else format('({}, {}]', round(e3, 3), round(e4, 3)) end as p_retailprice_binned from t""",
)
def _(spark, sf):
    return features.binning(table(spark, sf, "part").select("p_partkey", "p_retailprice"), "p_retailprice")


@query("add", "select l_linenumber, l_suppkey, l_linenumber + l_suppkey as l_linenumber_plus_l_suppkey from lineitem")
def _(spark, sf):
    return features.add(table(spark, sf, "lineitem").select("l_linenumber", "l_suppkey"), "l_linenumber", "l_suppkey")


@query("multiply", "select l_quantity, l_tax, round(l_quantity * l_tax, 6) as l_quantity_times_l_tax from lineitem")
def _(spark, sf):
    made = features.multiply(table(spark, sf, "lineitem").select("l_quantity", "l_tax"), "l_quantity", "l_tax")
    return _rounded(made, "l_quantity_times_l_tax", digits=6)


@query("ratio", "select l_tax, l_discount, round(l_tax / nullif(l_discount, 0), 6) as share from lineitem")
def _(spark, sf):
    made = features.ratio(table(spark, sf, "lineitem").select("l_tax", "l_discount"), "l_tax", "l_discount", "share")
    return _rounded(made, "share", digits=6)


@query("datetime_candidates", "select 'day_text' as \"column\"")
def _(spark, sf):
    return features.datetime_candidates(table(spark, sf, "text_dates"))


@query(
    "to_datetime",
    with_variant(
        "text_dates",
        """select o_orderkey, case when o_orderkey % 11 = 0 then null else try_cast(day_text as timestamp) end as day_text,
        o_orderpriority from d""",
    ),
)
def _(spark, sf):
    """Three written forms of the same day, and some text that is no date."""
    df = table(spark, sf, "text_dates")
    key, day = F.col("o_orderkey"), F.col("day_text")
    american = F.concat_ws("/", F.substring(day, 6, 2), F.substring(day, 9, 2), F.substring(day, 1, 4))
    mixed = F.when(key % 11 == 0, F.lit("no date")).when(key % 3 == 0, american).when(key % 3 == 1, F.translate(day, "-", "/"))
    return features.to_datetime(df.withColumn("day_text", mixed.otherwise(day)), "day_text")


_PARTS_SQL = {
    "year": "date_part('year', {t})",
    "month": "date_part('month', {t})",
    "day": "date_part('day', {t})",
    "dayofweek": "isodow({t}) - 1",
    "hour": "date_part('hour', {t})",
    "minute": "date_part('minute', {t})",
    "quarter": "date_part('quarter', {t})",
    "is_weekend": "case when isodow({t}) >= 6 then 1 else 0 end",
    "dayofyear": "date_part('doy', {t})",
}


def _date_part(part: str) -> None:
    suffix = DATE_SUFFIXES[part]
    key = f"date_{ {'dayofweek': 'dow'}.get(part, part) }"
    gap = "case when event_id % 7 <> 0 then ts end"

    def run(spark, sf):
        df = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("ts")).alias("ts"))
        return features.date_part(df, "ts", part)

    QUERIES[key] = run
    SQL[key] = (
        f"select event_id, {gap} as ts, cast({_PARTS_SQL[part].format(t=f'({gap})')} as integer) as ts_{suffix} from events"
    )


for _part in DATE_SUFFIXES:
    _date_part(_part)
