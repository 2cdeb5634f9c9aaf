"""Reading files by extension, with types inferred in one aggregate."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.functions.columns import (
    FRACTIONAL,
    INTEGER_PATTERN,
    col,
    columns_of,
    parse_number,
    python_strip,
    replace_columns,
    value,
)
from tabwright.session import fresh_folder
from tabwright.sources.manifest import headers, readable_by_range
from tabwright.sources.records import array_records, csv_records, has_open_lines, units

# Texts a delimited file uses for a missing value.
NA_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)
# Texts of truth values.
TRUE_TEXTS = ("True", "TRUE", "true")
FALSE_TEXTS = ("False", "FALSE", "false")
# Extension -> label.
FORMAT_LABELS = {
    ".csv": "CSV",
    ".tsv": "TSV",
    ".xlsx": "Excel",
    ".xls": "Excel",
    ".json": "JSON",
    ".parquet": "Parquet",
}


class EmptyDatasetError(ValueError):
    """A dataset without rows was loaded."""

    reason = "empty_file"


def column_names(header: list[str | None]) -> list[str]:
    """Names of a header line: empty ones numbered, repeated ones .1, .2."""
    names: list[str] = []
    for i, raw in enumerate(header):
        base = raw if raw else f"Unnamed: {i}"
        name, n = base, 1
        while name in names:
            name, n = f"{base}.{n}", n + 1
        names.append(name)
    return names


def _long(c: Column) -> Column:
    return F.when(c.rlike(INTEGER_PATTERN), python_strip(c).try_cast("bigint"))


def fit_types(df: DataFrame) -> dict[str, str]:
    """bigint, double, boolean or string for every text column, in one pass."""
    aggs = []
    for i, c in enumerate(df.columns):
        x = col(c)
        aggs += [
            F.count(x).alias(f"n{i}"),
            F.count(_long(x)).alias(f"l{i}"),
            F.count(parse_number(x)).alias(f"d{i}"),
            F.count_if(x.isin(*TRUE_TEXTS, *FALSE_TEXTS)).alias(f"b{i}"),
        ]
    row = df.agg(*aggs).first()
    types = {}
    for i, c in enumerate(df.columns):
        n = row[f"n{i}"]
        if n == row[f"l{i}"] and n:
            types[c] = "bigint"
        elif n == row[f"d{i}"]:
            types[c] = "double"
        elif n == row[f"b{i}"]:
            types[c] = "boolean"
        else:
            types[c] = "string"
    return types


def apply_types(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    casts = {
        "bigint": _long,
        "double": parse_number,
        "boolean": lambda c: F.when(c.isNotNull(), c.isin(*TRUE_TEXTS)),
    }
    return replace_columns(df, {c: casts[t](col(c)) for c, t in types.items() if t in casts})


def _scanned_headers(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """(file, header) from a scan, for stores that can only be read by Spark; a header is one line."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value"
    )
    top = lines.where("start = 0 and trim(value) <> ''").withColumn("at", F.monotonically_increasing_id())
    return top.groupBy("file").agg(F.ltrim(F.min_by("value", "at"), F.lit("\ufeff")).alias("header"))


def _split_header(record: str, sep: str) -> list[str]:
    return next(csv.reader(io.StringIO(record, newline=""), delimiter=sep))


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema)


def _by_name(rows: DataFrame, files: DataFrame, found: list[tuple[str, ...]]) -> DataFrame:
    """Cells by position (_c0, _c1 ...) of files with several headers, united by name.

    Each file's header has a number; a column takes the place it has in its row's file.
    """
    names = list(dict.fromkeys(n for header in found for n in header))
    numbered = rows.join(files, "file")
    out = []
    for name in names:
        cell = F.lit(None).cast("string")
        for number, header in enumerate(found):
            if name in header:
                cell = F.when(F.col("number") == number, F.col(f"_c{header.index(name)}")).otherwise(cell)
        out.append(cell.alias(name))
    return numbered.select(*out)


def _read_delimited(
    spark: SparkSession, path: str, sep: str, infer: bool, types: Mapping[str, str] | None, multiline: bool | None
) -> DataFrame:
    """Files of one header are read together; those of several are united by name."""
    options = {"sep": sep, "quote": '"', "escape": '"'}
    known = headers(spark, path, sep) if readable_by_range(spark, path) else _scanned_headers(spark, path, sep)
    # One row for each header that occurs, the first file's first.
    kinds = known.groupBy("header").agg(F.min("file").alias("file")).orderBy("file").select("header").collect()
    if not kinds:
        raise EmptyDatasetError("no header line")
    found = [tuple(column_names(_split_header(k["header"], sep))) for k in kinds]
    width = max(map(len, found))
    names = found[0] if len(found) == 1 else tuple(f"_c{i}" for i in range(width))
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    if multiline is None:
        multiline = has_open_lines(spark, path, sep)
    if multiline:
        # Texts with line ends are not to be changed by the parser, each is one record.
        cells = F.from_csv("text", _ddl(schema), {**options, "multiLine": "true"}).alias("cells")
        raw = csv_records(spark, path, sep).where("not first").select("file", cells)
        raw = raw.select("file", "cells.*") if len(found) > 1 else raw.select("cells.*")
    else:
        raw = spark.read.options(**options).schema(schema).option("header", True).option("enforceSchema", True).csv(path)
        raw = raw.select(F.col("_metadata.file_path").alias("file"), "*") if len(found) > 1 else raw
    if len(found) > 1:
        number = F.lit(None).cast("int")
        for i, k in enumerate(kinds):
            number = F.when(F.col("header") == k["header"], i).otherwise(number)
        raw = _by_name(raw, known.select("file", number.alias("number")), found)
    text = replace_columns(raw, {c: F.when(~col(c).isin(*NA_TOKENS), col(c)) for c in raw.columns})
    if types is not None:
        return apply_types(text, types)
    return apply_types(text, fit_types(text)) if infer else text


def read_csv(
    spark: SparkSession,
    path: str,
    infer: bool = True,
    types: Mapping[str, str] | None = None,
    multiline: bool | None = None,
) -> DataFrame:
    """Comma-separated text with a header in each file; dates stay text.

    Files of a folder may order their columns differently or lack some: columns
    are matched by name, in the order in which the files bring them.

    Line ends inside quotes belong to their cell, and a file with such cells is
    still read in many tasks: a scan looks for records that go on over a line end,
    and if there are any, records are put together and written once (see
    ``records.py``). ``multiline`` says what is known before: True goes there at
    once, False reads each line as a record. ``types`` skips the inference pass.
    """
    return _read_delimited(spark, path, ",", infer, types, multiline)


def read_tsv(
    spark: SparkSession,
    path: str,
    infer: bool = True,
    types: Mapping[str, str] | None = None,
    multiline: bool | None = None,
) -> DataFrame:
    """As :func:`read_csv`, with tabs between cells."""
    return _read_delimited(spark, path, "\t", infer, types, multiline)


def json_orientation(spark: SparkSession, path: str) -> str:
    """records (an array), lines (one object per line) or columns.

    Two lines of one file that are objects each mean lines. A file's only object
    is a column document if its values are objects of the same keys.
    """
    # What stands before the first closing bracket is short, whatever the line.
    top = units(spark, path, "}").select(F.ltrim(F.col("value"), F.lit("\ufeff \t\r\n")).alias("value")).where("value <> ''").head(1)
    if not top:
        raise EmptyDatasetError("no JSON document")
    if top[0]["value"].startswith("["):
        return "records"
    texts = spark.read.text(path).select(F.input_file_name().alias("file"), F.trim("value").alias("value"))
    lines = texts.filter("value <> ''").head(2)
    first, *others = [_parsed(line["value"]) for line in lines if line["file"] == lines[0]["file"]]
    if first is None:
        return "columns"
    if not isinstance(first, dict) or (others and isinstance(others[0], dict)):
        return "lines"
    cells = list(first.values())
    agree = cells and all(isinstance(v, dict) and v.keys() == cells[0].keys() for v in cells)
    return "columns" if agree else "lines"


def _parsed(line: str):
    try:
        return json.loads(line)
    except ValueError:
        return None


def _one_document_each(spark: SparkSession, path: str) -> None:
    """Refuse files in which another document follows the first: it would be lost."""
    bare = F.regexp_replace("value", r'"(?>[^"\\]+|\\.)*+"', "0")
    several = spark.read.text(path, wholetext=True).where(bare.rlike(r"[}\]]\s*[{\[]")).select(F.input_file_name().alias("file"))
    found = several.head(1)
    if found:
        raise ValueError(f"more than one JSON document in {found[0]['file']}")


def read_json(spark: SparkSession, path: str, orient: str = "auto") -> DataFrame:
    """An array of records, JSON lines, or a {column: {row: value}} document.

    Lines and arrays split within a file; the records of arrays are found by a
    scan and written once as lines (see ``records.py``). A column document takes
    one task. Arrays and column documents are the only one of their file.
    """
    if orient == "auto":
        orient = json_orientation(spark, path)
    if orient not in ("records", "lines", "columns"):
        raise ValueError("orient: auto, records, lines or columns")
    if orient == "columns":
        _one_document_each(spark, path)
        return _read_json_columns(spark, path)
    if orient == "records":
        records, path = array_records(spark, path), fresh_folder(spark, "json-lines")
        # Between tokens a line end is white space, and inside a string it is not allowed.
        line = F.regexp_replace("text", r"[\r\n]++", " ").alias("value")
        records.select(line).write.text(path)
        texts = records.where("first").select(line)
    else:
        texts = spark.read.text(path).filter(F.trim("value") != "")
    found = texts.select(F.json_object_keys("value").alias("keys")).head(1)
    keys = list(found[0]["keys"] or []) if found else []
    return no_nan(_in_document_order(spark.read.json(path), keys))


def _in_document_order(df: DataFrame, keys: list[str]) -> DataFrame:
    known = [k for k in keys if k in df.columns]
    return df.select(*[col(c) for c in known + [c for c in df.columns if c not in known]])


def _read_json_columns(spark: SparkSession, path: str) -> DataFrame:
    doc = spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("file"), F.from_json("value", "map<string,map<string,string>>").alias("doc")
    )
    cells = doc.select("file", F.explode("doc").alias("column", "cells")).select(
        "file", "column", F.explode("cells").alias("row", "value")
    )
    names = [
        r[0]
        for r in doc.select(F.posexplode(F.map_keys("doc")).alias("at", "column"))
        .groupBy("column")
        .agg(F.min("at").alias("at"))
        .orderBy("at", "column")
        .select("column")
        .collect()
    ]
    wide = cells.groupBy("file", "row").pivot("column", names).agg(F.first("value")).select(*[col(c) for c in names])
    return apply_types(wide, fit_types(wide))


def no_nan(df: DataFrame) -> DataFrame:
    """NaN as NULL in fractional columns."""
    fractional = columns_of(df, *FRACTIONAL)
    return replace_columns(df, {c: value(df, c) for c in fractional}) if fractional else df


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return no_nan(spark.read.parquet(path))


def extension(path: str) -> str:
    return PurePosixPath(path.rstrip("/")).suffix.lower()


def format_label(path: str) -> str:
    ext = extension(path)
    return FORMAT_LABELS.get(ext, ext.upper())


def load(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Read a file, folder or glob by extension (or ``kind``, e.g. ".csv")."""
    from tabwright.sources.excel import read_excel

    readers: dict[str, Callable[[SparkSession, str], DataFrame]] = {
        ".csv": read_csv,
        ".tsv": read_tsv,
        ".xlsx": read_excel,
        ".json": read_json,
        ".parquet": read_parquet,
    }
    ext = (kind or extension(path)).lower()
    if ext not in readers:
        raise ValueError(f"Unsupported file format: {ext}")
    return readers[ext](spark, path)


def assert_not_empty(df: DataFrame) -> DataFrame:
    """The frame itself, or EmptyDatasetError when it has no rows."""
    if df.isEmpty():
        raise EmptyDatasetError("the dataset has no rows")
    return df


@dataclass(frozen=True)
class NamedDataset:
    path: str
    label: str


class Registry:
    """Datasets by name, each with a path and a label."""

    def __init__(self, entries: Mapping[str, NamedDataset] | None = None):
        self._entries = dict(entries or {})

    def register(self, name: str, path: str, label: str | None = None) -> "Registry":
        self._entries[name] = NamedDataset(path, label or name)
        return self

    def names(self) -> list[str]:
        return sorted(self._entries)

    def label(self, name: str) -> str:
        return self._entries[name].label if name in self._entries else name

    def load(self, spark: SparkSession, name: str) -> DataFrame:
        if name not in self._entries:
            raise KeyError(f"no dataset called {name}")
        return load(spark, self._entries[name].path)


def dataset_info(df: DataFrame, filename: str, fmt: str | None = None) -> DataFrame:
    """filename, format, rows, columns, missing_pct (1 decimal) in one row."""
    from tabwright.operators.profile import missing_total

    cells = F.col("rows") * F.col("columns")
    return missing_total(df).select(
        F.lit(filename).alias("filename"),
        F.lit(fmt or format_label(filename)).alias("format"),
        "rows",
        "columns",
        F.when(cells > 0, F.round(F.col("missing_cells") * 100.0 / cells, 1)).otherwise(F.lit(0.0)).alias("missing_pct"),
    )
