"""Registered queries: sources, stages, filters, projections."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from xml.sax.saxutils import escape

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from tabwright.operators import experiment, features, filters, missing, text
from tabwright.operators.filters import InList, InRange
from tabwright.plans.fixtures import TABLES, table, with_variant
from tabwright.session import fresh_folder
from tabwright.sources.excel import read_workbooks
from tabwright.sources.manifest import manifest
from tabwright.sources.readers import (
    Registry,
    assert_not_empty,
    dataset_info,
    load,
    read_csv,
    read_json,
    read_parquet,
    read_tsv,
)
from tabwright.sources.report import read_ga_report
from tabwright.sources.stages import StageStore, save_summary

QUERIES = {}
SQL = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


def _kept_text(writer):
    return writer.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)


@query("read_csv", "select c_custkey, c_name, cast(c_nationkey as bigint) as c_nationkey, c_acctbal, c_mktsegment from customer")
def _(spark, sf):
    path = fresh_folder(spark, "csv")
    _kept_text(table(spark, sf, "customer").write).csv(path)
    return read_csv(spark, path)


@query("read_tsv", with_variant(
        "dirty_customer",
        "select c_custkey, case when seg <> 'N/A' then seg end as seg, bal, money, cast(c_nationkey as bigint) as c_nationkey from d",
    )
)
def _(spark, sf):
    path = fresh_folder(spark, "tsv")
    _kept_text(table(spark, sf, "dirty_customer").write.option("sep", "\t")).csv(path)
    return read_tsv(spark, path)


@query("read_json", "select s_suppkey, s_name, cast(s_nationkey as bigint) as s_nationkey, s_acctbal from supplier")
def _(spark, sf):
    path = fresh_folder(spark, "json")
    table(spark, sf, "supplier").write.json(path)
    return read_json(spark, path)


@query("read_csv_mixed", "select o_orderkey, o_orderstatus, o_totalprice from orders")
def _(spark, sf):
    """A folder whose files order their columns in two ways."""
    path = fresh_folder(spark, "csv")
    orders = table(spark, sf, "orders")
    halves = (("o_orderkey", "o_orderstatus", "o_totalprice"), ("o_totalprice", "o_orderkey", "o_orderstatus"))
    for i, columns in enumerate(halves):
        part = orders.where(F.col("o_orderkey") % 2 == i).select(*columns)
        _kept_text(part.write.mode("append")).csv(path)
    return read_csv(spark, path).select(*halves[0])


#: Splits of the files below for each core, and the least that one holds.
SPLITS_PER_CORE = 4
SMALLEST_SPLIT = 1 << 18


def _split_bytes(spark, path):
    """A split's size: several for each core, whatever the tables' size, and never above the session's."""
    size = manifest(spark, path).agg(F.sum("length")).first()[0] or 0
    most = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    return max(SMALLEST_SPLIT, min(most, size // (SPLITS_PER_CORE * spark.sparkContext.defaultParallelism)))


@contextmanager
def _small_splits(spark, path):
    """Splits of a size that gives these tables several of them."""
    sizes = {"spark.sql.files.maxPartitionBytes": f"{_split_bytes(spark, path)}b", "spark.sql.files.openCostInBytes": "1k"}
    before = {k: spark.conf.get(k) for k in sizes}
    for k, v in sizes.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


_EMPTY_TEXT = "case when text not in ('', 'NA', 'N/A', 'NULL', 'None', 'nan', 'null') then text end as text"


@query("read_csv_line_ends", f"select doc_id, {_EMPTY_TEXT}, source, n_chars from documents")
def _(spark, sf):
    """Whole documents as cells, line ends and quotes in them, each file in many tasks."""
    path = fresh_folder(spark, "csv")
    rows = table(spark, sf, "documents").select("doc_id", "text", "source", "n_chars")
    _kept_text(rows.write.option("escape", '"')).csv(path)
    with _small_splits(spark, path):
        return read_csv(spark, path)


@query("read_tsv_line_ends", f"select conv_id, turn, role, {_EMPTY_TEXT} from conversations")
def _(spark, sf):
    """Turns of conversations with a tab and a line end after each sentence."""
    path = fresh_folder(spark, "tsv")
    rows = table(spark, sf, "conversations").withColumn("text", F.replace("text", F.lit(". "), F.lit(".\t\n")))
    _kept_text(rows.write.option("sep", "\t").option("escape", '"')).csv(path)
    with _small_splits(spark, path):
        df = read_tsv(spark, path)
    return df.withColumn("text", F.replace("text", F.lit(".\t\n"), F.lit(". "))).select("conv_id", "turn", "role", "text")


def _bracketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines as they come, between the brackets of an array; nothing is held."""
    line = lambda text: pa.RecordBatch.from_pydict({"value": pa.array([text], pa.string())})
    yield line("[")
    yield from batches
    yield line('{"o_orderkey": null}]')


@query("read_json_one_array", "select o_orderkey, o_orderstatus, o_totalprice, o_orderpriority from orders")
def _(spark, sf):
    """All orders as one array in one file, read in many tasks."""
    path = fresh_folder(spark, "json")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    lines = orders.select(F.concat(F.to_json(F.struct("*")), F.lit(",")).alias("value"))
    lines.repartition(1).mapInArrow(_bracketed, "value string").write.text(path)
    with _small_splits(spark, path):
        return read_json(spark, path).where("o_orderkey is not null")


@query("read_json_nested", "select c_custkey, c_nationkey as nation, c_acctbal as balance from customer")
def _(spark, sf):
    """Lines of nothing but nested objects."""
    path = fresh_folder(spark, "json")
    inner = F.struct(F.col("c_custkey").alias("custkey"), F.col("c_nationkey").alias("nation"))
    table(spark, sf, "customer").select(inner.alias("key"), F.struct(F.col("c_acctbal").alias("balance")).alias("money")).write.json(path)
    return read_json(spark, path).select(
        F.col("key.custkey").alias("c_custkey"), F.col("key.nation").cast("int").alias("nation"), "money.balance"
    )


def _documents(spark, rows, document):
    """One document for every fifty rows, each in a file of its own."""
    path = fresh_folder(spark, "json")
    groups = rows.withColumn("part", F.floor(F.col("s_suppkey") / 50)).groupBy("part").agg(document.alias("value"))
    groups.repartition("part").write.partitionBy("part").text(path)
    return f"{path}/*/*.txt"


@query("read_json_array", "select s_suppkey, s_name, s_acctbal from supplier")
def _(spark, sf):
    record = F.struct("s_suppkey", "s_name", "s_acctbal")
    path = _documents(spark, table(spark, sf, "supplier"), F.to_json(F.collect_list(record)))
    return read_json(spark, path)


@query("read_json_columns", "select s_suppkey, s_name, s_acctbal from supplier")
def _(spark, sf):
    cells = [
        F.map_from_entries(F.collect_list(F.struct(F.col("s_suppkey").cast("string"), F.col(c).cast("string")))).alias(c)
        for c in ("s_suppkey", "s_name", "s_acctbal")
    ]
    path = _documents(spark, table(spark, sf, "supplier"), F.to_json(F.struct(*cells)))
    return read_json(spark, path)


_SHEET = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
_LINK = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_BOOK = f'<workbook {_SHEET} xmlns:r="{_LINK}"><sheets><sheet name="s" sheetId="1" r:id="r1"/></sheets></workbook>'
_RELATIONS = (
    '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
    '<Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>'
)


def _workbooks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each batch of rows as a small workbook."""
    for batch in batches:
        lines = [list(batch.columns), *batch.itertuples(index=False)]
        cells = [
            "".join(
                f'<c t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>'
                if isinstance(v, str)
                else "<c/>" if pd.isna(v) else f"<c><v>{v!r}</v></c>"
                for v in (x.item() if hasattr(x, "item") else x for x in line)
            )
            for line in lines
        ]
        sheet = "".join(f"<row>{c}</row>" for c in cells)
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
            book.writestr("xl/workbook.xml", _BOOK)
            book.writestr("xl/_rels/workbook.xml.rels", _RELATIONS)
            book.writestr("xl/worksheets/sheet1.xml", f"<worksheet {_SHEET}><sheetData>{sheet}</sheetData></worksheet>")
        yield pd.DataFrame({"content": [out.getvalue()]})


@query(
    "read_excel",
    """select c_custkey, c_name, case when c_custkey % 5 <> 0 then c_acctbal end as c_acctbal,
    nullif(c_mktsegment, 'BUILDING') as c_mktsegment from customer""",
)
def _(spark, sf):
    """The customers as many workbooks; text for a missing segment is NA."""
    gap = F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal")).alias("c_acctbal")
    segment = F.when(F.col("c_mktsegment") == "BUILDING", F.lit("NA")).otherwise(F.col("c_mktsegment"))
    rows = table(spark, sf, "customer").select("c_custkey", "c_name", gap, segment.alias("c_mktsegment"))
    return read_workbooks(rows.mapInPandas(_workbooks, "content binary"))


@query("read_parquet", "select * from orders")
def _(spark, sf):
    return read_parquet(spark, f"{sf}/orders.parquet")


@query("load", "select * from part")
def _(spark, sf):
    return load(spark, f"{sf}/part.parquet")


@query("named_dataset", "select * from nation")
def _(spark, sf):
    registry = Registry()
    for name in TABLES:
        registry.register(name, f"{sf}/{name}.parquet", name.title())
    return registry.load(spark, "nation")


@query("assert_not_empty", "select * from supplier")
def _(spark, sf):
    return assert_not_empty(table(spark, sf, "supplier"))


@query("dataset_info", with_variant(
        "dirty_customer",
        """select 'customer.csv' as filename, 'CSV' as format, count(*) as rows, cast(5 as bigint) as columns,
        round((count(*) - count(seg) + count(*) - count(bal)) * 100.0 / (count(*) * 5), 1) as missing_pct from d""",
    )
)
def _(spark, sf):
    return dataset_info(table(spark, sf, "dirty_customer"), "customer.csv")


@query("save_stage", with_variant("dirty_customer", "select * from d where seg is not null and bal is not null"))
def _(spark, sf):
    store = StageStore(spark, fresh_folder(spark, "stages"))
    raw = store.save("raw", table(spark, sf, "dirty_customer"))
    store.save("cleaned", missing.drop_missing_rows(raw))
    return store.load("cleaned")


@query("latest_stage", """select 'cleaned' as stage, count(*) as rows from orders where o_totalprice >= 1000
    union all select 'raw', count(*) from orders"""
)
def _(spark, sf):
    store = StageStore(spark, fresh_folder(spark, "stages"))
    raw = store.save("raw", table(spark, sf, "orders"))
    before = store.latest_name()
    first = store.latest().agg(F.lit(before).alias("stage"), F.count(F.lit(1)).alias("rows"))
    store.save("cleaned", filters.filter_range(raw, "o_totalprice", 1000))
    after = store.latest_name()
    return first.unionByName(store.latest().agg(F.lit(after).alias("stage"), F.count(F.lit(1)).alias("rows")))


@query("reset_downstream", "select 'raw' as stage, true as was_ahead, false as still_ahead, count(*) as rows from supplier")
def _(spark, sf):
    store = StageStore(spark, fresh_folder(spark, "stages"))
    raw = store.save("raw", table(spark, sf, "orders"))
    store.save("cleaned", raw)
    ahead = store.has_downstream()
    new = store.save("raw", table(spark, sf, "supplier"))
    return new.agg(
        F.lit(store.latest_name()).alias("stage"),
        F.lit(ahead).alias("was_ahead"),
        F.lit(store.has_downstream()).alias("still_ahead"),
        F.count(F.lit(1)).alias("rows"),
    )


@query("read_ga_report", with_variant(
        "ab_events",
        """select grp as "group", event_type as event_name, count(distinct user_id) as active_users, count(*) as event_count
        from d group by 1, 2 union all
        select null, null, count(distinct user_id), count(*) from d""",
    )
)
def _(spark, sf):
    """The counts of the event table, written in the shape of the export."""
    counts = experiment.event_rollup(table(spark, sf, "ab_events"), "grp", "event_type", "user_id")
    preamble = spark.createDataFrame(
        [(0, i, t) for i, t in enumerate(["# ---", "# report", "# period", "# ---", "# ---", "", "Group,Event name,Active users,Event count"])],
        "part int, line int, value string",
    )
    line = F.concat_ws(
        ",", F.coalesce("group", F.lit("")), F.coalesce("event_name", F.lit("")), F.col("active_users"), F.col("event_count")
    )
    line = F.concat(line, F.when(F.col("group").isNull(), F.lit(",Grand total")).otherwise(F.lit("")))
    order = F.when(F.col("group").isNull(), F.lit(1)).otherwise(F.lit(2))
    body = counts.select(order.alias("part"), F.lit(0).alias("line"), line.alias("value"))
    path = fresh_folder(spark, "report")
    preamble.unionByName(body).coalesce(1).sortWithinPartitions("part", "line").select("value").write.text(path)
    return read_ga_report(spark, path)


@query("save_summary", with_variant(
        "dup_orders",
        """select count(*) as rows, cast(3 as bigint) as columns, cast(0 as bigint) as missing_cells,
        count(*) - (select count(*) from (select distinct * from d)) as duplicate_rows from d""",
    )
)
def _(spark, sf):
    return save_summary(table(spark, sf, "dup_orders"))


@query("filter_categorical", with_variant(
        "dirty_customer",
        "select * from d where seg in ('  BUILDING ', ' ? ') or seg is null",
    )
)
def _(spark, sf):
    return filters.filter_categorical(table(spark, sf, "dirty_customer"), "seg", ["  BUILDING ", " ? ", "(NA)"])


@query("filter_range", "select * from lineitem where l_quantity >= 10 and l_quantity <= 24.5")
def _(spark, sf):
    return filters.filter_range(table(spark, sf, "lineitem"), "l_quantity", 10, 24.5)


@query("filter_all", "select * from lineitem where l_returnflag in ('R', 'N') and l_discount <= 0.05")
def _(spark, sf):
    return filters.filter_all(
        table(spark, sf, "lineitem"),
        [
            InList("l_returnflag", ["A"]),
            InRange("l_discount", None, 0.05),
            InRange("no_such_column", 1, 2),
            InList("l_returnflag", ["R", "N"]),
        ],
    )


@query("filtered_count", with_variant(
        "dirty_customer",
        "select count(*) filter (where bal >= 0 and c_nationkey in (1, 5, 7)) as shown, count(*) as total from d",
    )
)
def _(spark, sf):
    return filters.filtered_count(
        table(spark, sf, "dirty_customer"), [InRange("bal", 0), InList("c_nationkey", ["1", "5", "7"])]
    )


_LINEITEM_NUMBERS = (
    "l_orderkey",
    "l_partkey",
    "l_suppkey",
    "l_linenumber",
    "l_quantity",
    "l_extendedprice",
    "l_discount",
    "l_tax",
)


@query("filter_kind", "\nunion all ".join(
        [
            f"select '{c}' as \"column\", case when count(distinct {c}) <= 30 then 'categorical' else 'numeric' end as kind from lineitem"
            for c in _LINEITEM_NUMBERS
        ]
        + [f"select '{c}', 'categorical'" for c in ("l_returnflag", "l_linestatus", "l_shipdate")]
    )
)
def _(spark, sf):
    return filters.filter_kind(table(spark, sf, "lineitem"))


@query("filter_domain", with_variant("dirty_customer", "select distinct coalesce(seg, '(NA)') as value from d"))
def _(spark, sf):
    return filters.filter_domain(table(spark, sf, "dirty_customer"), "seg")


@query("filter_bounds", with_variant("dirty_customer", "select min(bal) as low, max(bal) as high from d"))
def _(spark, sf):
    return filters.filter_bounds(table(spark, sf, "dirty_customer"), "bal", widen=True)


@query("eda_filter_range", """select * from orders where (o_totalprice >= 1e15 and o_totalprice <= 2e15)
    or not exists (select 1 from orders having max(o_totalprice) >= 1e15)"""
)
def _(spark, sf):
    return filters.eda_filter_range(table(spark, sf, "orders"), "o_totalprice", 1e15, 2e15)


@query("eda_filter_in", "select * from orders where o_orderstatus in ('F', 'P')")
def _(spark, sf):
    return filters.eda_filter_in(table(spark, sf, "orders"), "o_orderstatus", ["F", "P"])


@query("eda_filter_range_inside", "select * from orders where o_totalprice >= 1000 and o_totalprice <= 90000.5")
def _(spark, sf):
    return filters.eda_filter_range(table(spark, sf, "orders"), "o_totalprice", 1000, 90000.5)


@query("eda_filter_in_nothing", "select * from orders where false")
def _(spark, sf):
    return filters.eda_filter_in(table(spark, sf, "orders"), "o_orderstatus", [])


@query("eda_filter_domain", with_variant("dirty_customer", "select distinct seg as value from d where seg is not null"))
def _(spark, sf):
    return filters.eda_filter_domain(table(spark, sf, "dirty_customer"), "seg")


@query("filter_bounds_equal", "select min(l_quantity * 0 + 7) as low, max(l_quantity * 0 + 7) + 0.01 as high from lineitem")
def _(spark, sf):
    same = table(spark, sf, "lineitem").select((F.col("l_quantity") * 0 + 7).alias("seven"))
    return filters.filter_bounds(same, "seven", widen=True)


@query("drop_columns", "select o_orderkey, o_custkey, o_orderdate from orders")
def _(spark, sf):
    return filters.drop_columns(table(spark, sf, "orders"), ["o_orderstatus", "o_totalprice", "o_orderpriority", "nothing"])


@query("select_numeric", "select " + ", ".join(_LINEITEM_NUMBERS) + " from lineitem")
def _(spark, sf):
    return filters.select_numeric(table(spark, sf, "lineitem"))


@query("select_categorical", "select l_returnflag, l_linestatus from lineitem")
def _(spark, sf):
    return filters.select_categorical(table(spark, sf, "lineitem"))


@query("first_numeric", "select l_orderkey, l_partkey, l_suppkey, l_linenumber from lineitem")
def _(spark, sf):
    return filters.first_numeric(table(spark, sf, "lineitem"), 4)


@query("preview_feature", "select l_quantity, round(sqrt(l_quantity), 6) as q_root from lineitem")
def _(spark, sf):
    made = features.sqrt(table(spark, sf, "lineitem"), "l_quantity", " q_root ")
    made = made.withColumn("q_root", F.round("q_root", 6))
    return features.preview_feature(made, ["l_quantity", "l_quantity"], "q_root")


@query("add_feature", "select s_suppkey, s_name, s_nationkey, s_acctbal, s_acctbal * s_acctbal as s_acctbal_square from supplier")
def _(spark, sf):
    df = table(spark, sf, "supplier")
    return features.add_feature(df, "s_acctbal_square", F.col("s_acctbal") * F.col("s_acctbal"), "   ")


@query("standardize_column_names", """select r_regionkey as region_key_id, r_name as region_key_id_2, r_regionkey as col_2, r_name as a_b from region"""
)
def _(spark, sf):
    odd = table(spark, sf, "region").select(
        F.col("r_regionkey").alias("  Region  Key (ID)"),
        F.col("r_name").alias("region_key__id_"),
        F.col("r_regionkey").alias("%%"),
        F.col("r_name").alias("A\tB!"),
    )
    return text.standardize_column_names(odd)
