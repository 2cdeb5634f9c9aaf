"""Given tables, and untidy variants derived from them.

The variants are plain SQL that reads the same on Spark and in the check SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region",
    "nation",
    "customer",
    "supplier",
    "part",
    "orders",
    "lineitem",
    "events",
    "documents",
    "embeddings",
    "pages",
    "benchmark",
    "labels",
    "conversations",
)

DIRTY_CUSTOMER = """
select c_custkey,
       case when c_custkey % 7 = 0 then null
            when c_custkey % 11 = 0 then 'N/A'
            when c_custkey % 13 = 0 then ' ? '
            else concat('  ', c_mktsegment, ' ') end as seg,
       case when c_custkey % 5 = 0 then null else c_acctbal end as bal,
       concat('$', cast(cast(c_custkey as bigint) * 1000 as varchar(20)), ',0') as money,
       c_nationkey
from {customer}"""

DUP_ORDERS = """
select o_custkey, o_orderstatus, o_totalprice from {orders}
union all
select o_custkey, o_orderstatus, o_totalprice from {orders} where o_orderkey % 10 = 0"""

GAP_EVENTS = """
select event_id, ts, user_id, event_type,
       case when event_id % 4 = 0 then value end as value from {events}"""

AB_EVENTS = """
select event_id, user_id,
       case when user_id % 2 = 0 then 'A'
            when user_id % 10 = 9 then '(not set)' else 'B' end as grp,
       event_type, ts from {events}"""

# Presses of buttons: the kind of event decides what was pressed.
CLICK_EVENTS = """
select event_id,
       case event_type when 'click' then 'confirm_LOAD' when 'error' then null else 'btn' end as button_id,
       case event_type when 'purchase' then ' Apply and Save ' when 'view' then concat(chr(10), '   Apply', chr(9), chr(10), ' ')
                       when 'signup' then 'Save to Pipeline' when 'click' then 'Load Dataset' end as button_name,
       case event_type when 'error' then concat(chr(9), 'Download plot as a PNG', chr(10)) else 'other' end as title
from {events}"""

TEXT_DATES = """
select o_orderkey, substr(cast(o_orderdate as varchar(30)), 1, 10) as day_text, o_orderpriority from {orders}"""

VARIANTS = {
    "dirty_customer": (DIRTY_CUSTOMER, "customer"),
    "dup_orders": (DUP_ORDERS, "orders"),
    "gap_events": (GAP_EVENTS, "events"),
    "ab_events": (AB_EVENTS, "events"),
    "click_events": (CLICK_EVENTS, "events"),
    "text_dates": (TEXT_DATES, "orders"),
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table or one of the variants."""
    if name in VARIANTS:
        sql, source = VARIANTS[name]
        return spark.sql(sql.format(**{source: "{source}"}), source=table(spark, folder, source))
    return spark.read.parquet(f"{folder}/{name}.parquet")


def with_variant(name: str, sql: str) -> str:
    """Check SQL that starts from a variant called ``d``."""
    text, source = VARIANTS[name]
    return f"with d as ({text.format(**{source: source})})\n{sql}"


def with_more(name: str, more: str, sql: str) -> str:
    """The same with further named parts."""
    text, source = VARIANTS[name]
    return f"with d as ({text.format(**{source: source})}),\n{more}\n{sql}"
