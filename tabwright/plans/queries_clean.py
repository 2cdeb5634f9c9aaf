"""Registered queries: missing values, text, types, duplicates, profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwright.operators import dedup, missing, profile, text
from tabwright.plans.fixtures import DUP_ORDERS, table, with_variant

QUERIES = {}
SQL = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


TOKENS = "('', ' ', 'NA', 'N/A', 'na', 'null', 'NULL', 'None', '?', '-')"


@query(
    "standardize_missing",
    with_variant(
        "dirty_customer",
        f"""select c_custkey, case when trim(seg) not in {TOKENS} then trim(seg) end as seg, bal,
        case when trim(money) not in {TOKENS} then trim(money) end as money, c_nationkey from d""",
    ),
)
def _(spark, sf):
    return missing.standardize_missing(table(spark, sf, "dirty_customer"))


def _filled(fill: str) -> str:
    return with_variant(
        "dirty_customer", f"select c_custkey, seg, round(coalesce(bal, {fill}), 4) as bal, money, c_nationkey from d"
    )


def _rounded(df, name="bal", digits=4):
    return df.withColumn(name, F.round(name, digits))


@query("fill_mean", _filled("(select avg(bal) from d)"))
def _(spark, sf):
    return _rounded(missing.fill_mean(table(spark, sf, "dirty_customer"), "bal"))


@query("fill_median", _filled("(select median(bal) from d)"))
def _(spark, sf):
    return _rounded(missing.fill_median(table(spark, sf, "dirty_customer"), "bal"))


@query("fill_zero", _filled("0"))
def _(spark, sf):
    return _rounded(missing.fill_zero(table(spark, sf, "dirty_customer"), "bal"))


@query("fill_constant", _filled("12.5"))
def _(spark, sf):
    return _rounded(missing.fill_constant(table(spark, sf, "dirty_customer"), "bal", " 12.5 "))


@query(
    "fill_mode",
    with_variant(
        "dirty_customer",
        """select c_custkey, coalesce(seg, (select seg from d where seg is not null group by seg
        order by count(*) desc, seg limit 1)) as seg, bal, money, c_nationkey from d""",
    ),
)
def _(spark, sf):
    return missing.fill_mode(table(spark, sf, "dirty_customer"), "seg")


@query(
    "fill_unknown",
    with_variant("dirty_customer", "select c_custkey, coalesce(seg, 'Unknown') as seg, bal, money, c_nationkey from d"),
)
def _(spark, sf):
    return missing.fill_unknown(table(spark, sf, "dirty_customer"), "seg")


@query(
    "forward_fill",
    with_variant(
        "gap_events",
        """select event_id, ts, user_id, event_type,
        last_value(value ignore nulls) over (order by event_id rows between unbounded preceding and current row) as value
        from d""",
    ),
)
def _(spark, sf):
    return missing.forward_fill(table(spark, sf, "gap_events"), "value", ["event_id"])


@query(
    "backward_fill",
    with_variant(
        "gap_events",
        """select event_id, ts, user_id, event_type,
        first_value(value ignore nulls) over (order by event_id rows between current row and unbounded following) as value
        from d""",
    ),
)
def _(spark, sf):
    return missing.backward_fill(table(spark, sf, "gap_events"), "value", ["event_id"])


@query(
    "forward_fill_by_user",
    with_variant(
        "gap_events",
        """select event_id, ts, user_id, event_type, last_value(value ignore nulls) over
        (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as value from d""",
    ),
)
def _(spark, sf):
    return missing.forward_fill(table(spark, sf, "gap_events"), "value", ["ts", "event_id"], ["user_id"])


@query("drop_missing_rows", with_variant("dirty_customer", "select * from d where seg is not null and bal is not null"))
def _(spark, sf):
    return missing.drop_missing_rows(table(spark, sf, "dirty_customer"))


@query("drop_sparse_columns", with_variant("gap_events", "select event_id, ts, user_id, event_type from d"))
def _(spark, sf):
    return missing.drop_sparse_columns(table(spark, sf, "gap_events"), 50)


@query(
    "impute_all",
    with_variant(
        "dirty_customer",
        """select c_custkey, coalesce(seg, (select seg from d where seg is not null group by seg
        order by count(*) desc, seg limit 1)) as seg, round(coalesce(bal, (select median(bal) from d)), 4) as bal,
        money, c_nationkey from d""",
    ),
)
def _(spark, sf):
    return _rounded(missing.impute_all(table(spark, sf, "dirty_customer")))


def _imputed(number: str, label: str) -> str:
    return with_variant("dirty_customer", f"select c_custkey, coalesce(seg, {label}) as seg, round(coalesce(bal, {number}), 4) as bal, money, c_nationkey from d")


@query("impute_all_mean_unknown", _imputed("(select avg(bal) from d)", "'Unknown'"))
def _(spark, sf):
    return _rounded(missing.impute_all(table(spark, sf, "dirty_customer"), "mean", "unknown"))


_TOP_SEG = "(select seg from d where seg is not null group by seg order by count(*) desc, seg limit 1)"


@query("impute_all_mode", _imputed("(select bal from d where bal is not null group by bal order by count(*) desc, bal limit 1)", _TOP_SEG))
def _(spark, sf):
    return _rounded(missing.impute_all(table(spark, sf, "dirty_customer"), "mode", "mode"))


@query(
    "columns_with_missing",
    with_variant(
        "dirty_customer",
        """select * from (select 'seg' as "column", count(*) - count(seg) as missing from d
        union all select 'bal', count(*) - count(bal) from d
        union all select 'money', count(*) - count(money) from d) where missing > 0""",
    ),
)
def _(spark, sf):
    return missing.columns_with_missing(table(spark, sf, "dirty_customer"))


@query(
    "trim_text",
    with_variant("dirty_customer", "select c_custkey, trim(seg) as seg, bal, trim(money) as money, c_nationkey from d"),
)
def _(spark, sf):
    return text.trim_text(table(spark, sf, "dirty_customer"))


@query(
    "lower_text",
    with_variant("dirty_customer", "select c_custkey, lower(seg) as seg, bal, lower(money) as money, c_nationkey from d"),
)
def _(spark, sf):
    return text.lower_text(table(spark, sf, "dirty_customer"))


@query(
    "strip_characters",
    "select doc_id, translate(text, '.,aeiou', '') as text, lang, source, n_chars from documents",
)
def _(spark, sf):
    return text.strip_characters(table(spark, sf, "documents"), " .,aeiou ", ["text"])


@query(
    "auto_numeric",
    with_variant(
        "dirty_customer",
        """select c_custkey, seg, bal, cast(replace(replace(money, '$', ''), ',', '') as bigint) as money,
        c_nationkey from d""",
    ),
)
def _(spark, sf):
    return text.auto_numeric(text.strip_characters(table(spark, sf, "dirty_customer"), "$,"))


@query(
    "format_standardize",
    with_variant(
        "dirty_customer",
        """select c_custkey, lower(trim(seg)) as seg, bal,
        cast(replace(replace(money, '$', ''), ',', '') as bigint) as money, c_nationkey from d""",
    ),
)
def _(spark, sf):
    return text.format_standardize(table(spark, sf, "dirty_customer"), lower=True, characters="$,")


@query(
    "remap_value",
    with_variant(
        "dirty_customer",
        """select c_custkey, case when seg = '  BUILDING ' then 'building' when seg is null then 'none given' else seg end as seg,
        bal, money, c_nationkey from d""",
    ),
)
def _(spark, sf):
    once = text.remap_value(table(spark, sf, "dirty_customer"), "seg", "  BUILDING ", " building ")
    return text.remap_value(once, "seg", "nan", "none given")


@query(
    "remap_values",
    """select o_orderkey, o_custkey, case o_orderstatus when 'F' then 'O' when 'O' then 'F' else o_orderstatus end as o_orderstatus,
    o_totalprice, o_orderdate, o_orderpriority from orders""",
)
def _(spark, sf):
    return text.remap_values(table(spark, sf, "orders"), "o_orderstatus", {"F": "O", "O": "F"})


@query("remap_count", with_variant("dirty_customer", "select count(*) as replaced from d where seg is null"))
def _(spark, sf):
    return text.remap_count(table(spark, sf, "dirty_customer"), "seg", "nan")


@query("value_counts", with_variant("dirty_customer", 'select seg as value, count(*) as "count" from d group by 1'))
def _(spark, sf):
    return text.value_counts(table(spark, sf, "dirty_customer"), "seg")


@query(
    "to_numeric",
    with_variant(
        "dirty_customer",
        "select c_custkey, seg, bal, try_cast(replace(replace(money, '$', ''), ',', '') as double) as money, c_nationkey from d",
    ),
)
def _(spark, sf):
    return text.to_numeric(table(spark, sf, "dirty_customer"), "money")


@query(
    "to_numeric_report",
    with_variant("dirty_customer", "select count(try_cast(trim(seg) as double)) as parsed, count(seg) as total from d"),
)
def _(spark, sf):
    return text.to_numeric_report(table(spark, sf, "dirty_customer"), "seg")


@query(
    "to_boolean",
    with_variant(
        "dirty_customer",
        "select c_custkey, seg in ('  BUILDING ', 'N/A') as seg, bal, money, c_nationkey from d",
    ),
)
def _(spark, sf):
    return text.to_boolean(table(spark, sf, "dirty_customer"), "seg", ["  BUILDING ", "N/A"])


@query("to_text", "select c_custkey, c_name, cast(c_nationkey as varchar) as c_nationkey, c_acctbal, c_mktsegment from customer")
def _(spark, sf):
    return text.to_text(table(spark, sf, "customer"), "c_nationkey")


@query(
    "column_sample",
    """select 'p_size' as "column", 'int' as dtype, (select count(distinct p_size) from part) as "unique",
    (select string_agg(cast(v as varchar), ', ' order by v) from (select distinct p_size as v from part order by 1 limit 5)) as sample""",
)
def _(spark, sf):
    return text.column_sample(table(spark, sf, "part"), "p_size")


@query("drop_duplicates", with_variant("dup_orders", "select distinct * from d"))
def _(spark, sf):
    return dedup.drop_duplicates(table(spark, sf, "dup_orders"))


@query(
    "duplicate_stats",
    with_variant(
        "dup_orders",
        """select rows, rows - kept as duplicate_rows, round((rows - kept) * 100.0 / rows, 1) as duplicate_pct
        from (select count(*) as rows, (select count(*) from (select distinct * from d)) as kept from d)""",
    ),
)
def _(spark, sf):
    return dedup.duplicate_stats(table(spark, sf, "dup_orders"))


# -- profiles ---------------------------------------------------------------

DIRTY_COLUMNS = {"c_custkey": "bigint", "seg": "string", "bal": "double", "money": "string", "c_nationkey": "int"}


def _union(columns, template: str) -> str:
    return "\nunion all ".join(template.format(c=c, t=t) for c, t in columns.items())


@query(
    "missing_by_column",
    with_variant(
        "dirty_customer",
        _union(
            DIRTY_COLUMNS,
            """select '{c}' as "column", '{t}' as dtype, count(*) - count({c}) as missing,
            round((count(*) - count({c})) * 100.0 / count(*), 2) as missing_pct from d""",
        ),
    ),
)
def _(spark, sf):
    return profile.missing_by_column(table(spark, sf, "dirty_customer"))


@query(
    "missing_total",
    with_variant(
        "dirty_customer",
        """select count(*) as rows, cast(5 as bigint) as columns,
        count(*) - count(seg) + count(*) - count(bal) as missing_cells from d""",
    ),
)
def _(spark, sf):
    return profile.missing_total(table(spark, sf, "dirty_customer"))


@query(
    "missing_ranked",
    with_variant(
        "dirty_customer",
        "select * from ("
        + _union(DIRTY_COLUMNS, """select '{c}' as "column", count(*) - count({c}) as missing from d""")
        + ") where missing > 0 order by missing desc",
    ),
)
def _(spark, sf):
    return profile.missing_ranked(table(spark, sf, "dirty_customer"))


@query(
    "column_info",
    with_variant(
        "dirty_customer",
        _union(
            DIRTY_COLUMNS,
            """select '{c}' as "column", '{t}' as dtype, count({c}) as non_null, count(*) - count({c}) as missing,
            count(distinct {c}) as "unique" from d""",
        ),
    ),
)
def _(spark, sf):
    return profile.column_info(table(spark, sf, "dirty_customer"))


@query(
    "quality_overview",
    f"""with e as (select *, case when o_custkey % 3 = 0 then null else o_orderstatus end as status
        from ({DUP_ORDERS.format(orders='orders')})),
    d as (select o_custkey, status, o_totalprice from e)
    select count(*) as rows, cast(3 as bigint) as columns, count(*) - count(status) as missing_cells,
    count(*) - (select count(*) from (select distinct * from d)) as duplicate_rows,
    cast(2 as bigint) as numeric_columns, cast(1 as bigint) as categorical_columns from d""",
)
def _(spark, sf):
    df = table(spark, sf, "dup_orders")
    status = F.when(F.col("o_custkey") % 3 != 0, F.col("o_orderstatus"))
    return profile.quality_overview(df.select("o_custkey", status.alias("status"), "o_totalprice"))


def _summary(columns: dict[str, str]) -> str:
    parts = []
    for c, t in columns.items():
        if t == "string":
            stats = ", ".join(f"cast(null as double) as {s}" for s in ("min", "q1", "median", "q3", "max", "mean", "std"))
            top = f"(select {c} from d where {c} is not null group by {c} order by count(*) desc, {c} limit 1)"
        else:
            stats = f"""round(cast(min({c}) as double), 4) as min, round(quantile_cont(cast({c} as double), 0.25), 4) as q1,
            round(quantile_cont(cast({c} as double), 0.5), 4) as median, round(quantile_cont(cast({c} as double), 0.75), 4) as q3,
            round(cast(max({c}) as double), 4) as max, round(avg({c}), 4) as mean, round(stddev_samp({c}), 4) as std"""
            top = "''"
        parts.append(
            f"""select '{c}' as "column", '{t}' as dtype, count({c}) as non_null, count(*) - count({c}) as missing,
            round((count(*) - count({c})) * 100.0 / count(*), 1) as missing_pct, count(distinct {c}) as "unique",
            {stats}, {top} as top_value from d"""
        )
    return "\nunion all ".join(parts)


@query("column_summary", with_variant("dirty_customer", _summary(DIRTY_COLUMNS)))
def _(spark, sf):
    return profile.column_summary(table(spark, sf, "dirty_customer"))


_LINEITEM = {
    "l_orderkey": "number",
    "l_partkey": "number",
    "l_suppkey": "number",
    "l_linenumber": "number",
    "l_quantity": "number",
    "l_extendedprice": "number",
    "l_discount": "number",
    "l_tax": "number",
    "l_returnflag": "label",
    "l_linestatus": "label",
    "l_shipdate": "time",
}
_STATS = ("mean", "std", "min", "q1", "median", "q3", "max")


def _describe(columns: dict[str, str]) -> str:
    """Times are compared in whole seconds."""
    parts = []
    for c, kind in columns.items():
        number, time = dict.fromkeys(_STATS, "cast(null as double)"), dict.fromkeys(_STATS, "cast(null as timestamp)")
        label = 'cast(null as bigint) as "unique", cast(null as varchar) as top, cast(null as bigint) as freq'
        x = f"epoch_us({c})" if kind == "time" else c
        stats = {
            "mean": f"avg({x})", "std": f"stddev_samp({x})", "min": f"min({x})", "q1": f"quantile_cont(cast({x} as double), 0.25)",
            "median": f"quantile_cont(cast({x} as double), 0.5)", "q3": f"quantile_cont(cast({x} as double), 0.75)", "max": f"max({x})",
        }
        if kind == "label":
            most = f"from d where {c} is not null group by {c} order by count(*) desc, {c} limit 1"
            label = f'count(distinct {c}) as "unique", (select {c} {most}) as top, (select count(*) {most}) as freq'
        elif kind == "number":
            number = {s: f"round(cast({e} as double), 4)" for s, e in stats.items()}
        else:
            time = {s: f"date_trunc('second', make_timestamp(cast(round({e}) as bigint)))" for s, e in stats.items()}
        cells = [f"{number[s]} as {s}" for s in _STATS] + [f"{time[s]} as time_{s}" for s in _STATS if s != "std"]
        parts.append(f"""select '{c}' as "column", count({c}) as "count", {label}, {', '.join(cells)} from d""")
    return "\nunion all ".join(parts)


@query("describe_all", "with d as (select * from lineitem)\n" + _describe(_LINEITEM))
def _(spark, sf):
    out = profile.describe_all(table(spark, sf, "lineitem").select(*_LINEITEM))
    for s in _STATS:
        out = _rounded(out, s)
    return out.withColumns({f"time_{s}": F.date_trunc("second", f"time_{s}").cast("timestamp_ntz") for s in _STATS if s != "std"})


CORRELATED = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _correlations(columns, flat: str) -> str:
    r = "round(regr_sxy({a}, {b}) / nullif(sqrt(regr_sxx({a}, {b}) * regr_syy({a}, {b})), 0), 2) + 0.0"
    return "\nunion all ".join(
        f"""select '{a}' as "row", '{b}' as "col", {r.format(a=a, b=b)} as r from {flat}""" for a in columns for b in columns
    )


@query(
    "correlation_matrix",
    "with d as (select *, case when l_linenumber = 1 then null else l_tax end as gap, 1.5 as flat from lineitem)\n"
    + _correlations(("l_quantity", "l_extendedprice", "gap", "flat"), "d"),
)
def _(spark, sf):
    df = table(spark, sf, "lineitem").select(
        "l_quantity",
        "l_extendedprice",
        F.when(F.col("l_linenumber") != 1, F.col("l_tax")).alias("gap"),
        F.lit(1.5).alias("flat"),
    )
    return profile.correlation_matrix(df)


@query(
    "correlation_of_common_rows",
    "with d as (select l_quantity + 0.0 as x, case when l_linenumber = 1 then 1e9 + l_quantity * 3 when l_linenumber > 5 then -1e12 end as y, "
    "case when l_linenumber <= 5 then l_extendedprice end as z from lineitem)\n"
    + _correlations(("x", "y", "z"), "d"),
)
def _(spark, sf):
    """Common rows of y and z vary little next to the whole of y."""
    line = F.col("l_linenumber")
    y = F.when(line == 1, F.lit(1e9) + F.col("l_quantity") * 3).when(line > 5, F.lit(-1e12))
    df = table(spark, sf, "lineitem").select(
        F.col("l_quantity").alias("x"), y.alias("y"), F.when(line <= 5, F.col("l_extendedprice")).alias("z")
    )
    return profile.correlation_matrix(df)


@query(
    "correlation_wide",
    """with r as (select corr(l_quantity, l_extendedprice) as qe, corr(l_quantity, l_tax) as qt, corr(l_extendedprice, l_tax) as et from lineitem)
    select 'l_quantity' as "column", cast(1 as double) as l_quantity, round(qe, 2) + 0.0 as l_extendedprice, round(qt, 2) + 0.0 as l_tax from r
    union all select 'l_extendedprice', round(qe, 2) + 0.0, 1, round(et, 2) + 0.0 from r
    union all select 'l_tax', round(qt, 2) + 0.0, round(et, 2) + 0.0, 1 from r""",
)
def _(spark, sf):
    return profile.correlation_wide(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"])


@query(
    "quantiles_with_infinities",
    "with d as (select case when l_linenumber = 1 then 'inf'::double when l_linenumber = 2 then '-inf'::double else l_extendedprice end as x from lineitem)\n"
    + "\nunion all ".join(
        f"""select 'x' as "column", cast({p} as double) as prob, round(quantile_disc(x, {p}), 6) as quantile from d""" for p in (0.0, 0.05, 0.95, 1.0)
    ),
)
def _(spark, sf):
    line = F.col("l_linenumber")
    x = F.when(line == 1, F.lit(float("inf"))).when(line == 2, F.lit(float("-inf"))).otherwise(F.col("l_extendedprice"))
    return _rounded(profile.quantiles(table(spark, sf, "lineitem").select(x.alias("x")), ["x"], [0.0, 0.05, 0.95, 1.0]), "quantile", digits=6)


@query(
    "quantiles",
    "\nunion all ".join(
        f"""select '{c}' as "column", cast({p} as double) as prob, round(quantile_cont({c}, {p}), 6) as quantile from lineitem"""
        for c in ("l_extendedprice", "l_quantity")
        for p in (0.01, 0.25, 0.5, 0.75, 0.99)
    ),
)
def _(spark, sf):
    found = profile.quantiles(table(spark, sf, "lineitem"), ["l_extendedprice", "l_quantity"], [0.01, 0.25, 0.5, 0.75, 0.99])
    return _rounded(found, "quantile", 6)


_DOCUMENTS = ("doc_id", "text", "lang", "source", "n_chars")


@query(
    "distinct_counts",
    "\nunion all ".join(f"""select '{c}' as "column", count(distinct {c}) as "unique" from documents""" for c in _DOCUMENTS),
)
def _(spark, sf):
    return profile.distinct_counts(table(spark, sf, "documents"))


@query(
    "approx_distinct_counts",
    "\nunion all ".join(
        f"""select '{c}' as "column", count(distinct {c}) as exact, true as within from documents"""
        for c in ("doc_id", "text", "lang", "source", "n_chars")
    ),
)
def _(spark, sf):
    """The exact counts, and whether the sketch's lie within five times its stated error of them."""
    docs = table(spark, sf, "documents")
    exact = profile.distinct_counts(docs).withColumnRenamed("unique", "exact")
    close = F.abs(F.col("unique") - F.col("exact")) <= 5 * profile.RSD * F.col("exact")
    return exact.join(profile.approx_distinct_counts(docs), "column").select("column", "exact", close.alias("within"))


@query(
    "modes",
    "\nunion all ".join(
        f"""(select '{c}' as "column", cast({c} as varchar) as mode, count(*) as freq from part group by {c}
        order by count(*) desc, {c} limit 1)"""
        for c in ("p_partkey", "p_brand", "p_type", "p_size", "p_name")
    ),
)
def _(spark, sf):
    return profile.modes(table(spark, sf, "part"), ["p_partkey", "p_brand", "p_type", "p_size", "p_name"])


