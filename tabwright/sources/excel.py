"""First sheet of .xlsx workbooks; a workbook is never split over tasks."""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.functions.columns import parse_number
from tabwright.sources.readers import NA_TOKENS, EmptyDatasetError, column_names

# Built-in number formats of the file format that show dates.
DATE_FORMAT_IDS = frozenset([*range(14, 23), *range(45, 48)])
EPOCH = dt.datetime(1899, 12, 30)
BATCH = 5_000


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _text(node) -> str:
    return "".join(t.text or "" for t in node.iter() if _local(t.tag) == "t")


def _first_sheet(book: zipfile.ZipFile) -> str:
    sheets = [e for e in ET.fromstring(book.read("xl/workbook.xml")).iter() if _local(e.tag) == "sheet"]
    link = next(v for k, v in sheets[0].attrib.items() if _local(k) == "id")
    for rel in ET.fromstring(book.read("xl/_rels/workbook.xml.rels")):
        if rel.attrib["Id"] == link:
            target = rel.attrib["Target"]
            return target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    raise ValueError("workbook without a first sheet")


def _shared_strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    return [_text(e) for e in ET.fromstring(book.read("xl/sharedStrings.xml")) if _local(e.tag) == "si"]


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Cell styles whose number format shows a date or time."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ET.fromstring(book.read("xl/styles.xml"))
    custom = {
        int(e.attrib["numFmtId"])
        for e in root.iter()
        if _local(e.tag) == "numFmt"
        and re.search(r"[dmyhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", e.attrib["formatCode"]), re.I)
    }
    styles = next((e for e in root if _local(e.tag) == "cellXfs"), ())
    return {
        i for i, x in enumerate(styles) if int(x.attrib.get("numFmtId", 0)) in DATE_FORMAT_IDS | custom
    }


def _column_index(reference: str) -> int:
    n = 0
    for ch in reference:
        if not ch.isalpha():
            break
        n = n * 26 + ord(ch.upper()) - 64
    return n - 1


def _cell(node, shared: list[str], dates: set[int]) -> tuple[str, str] | None:
    """(kind, text): s text, n number, d date, b truth value; None if empty."""
    kind = node.attrib.get("t", "n")
    if kind == "inlineStr":
        return "s", _text(node)
    raw = next((e.text for e in node if _local(e.tag) == "v"), None)
    if raw is None or kind == "e":
        return None
    if kind == "s":
        return "s", shared[int(raw)]
    if kind == "str":
        return "s", raw
    if kind == "b":
        return "b", "true" if raw == "1" else "false"
    if kind == "d":
        return "d", raw.replace("T", " ")
    if int(node.attrib.get("s", 0)) in dates:
        moment = EPOCH + dt.timedelta(milliseconds=round(float(raw) * 86_400_000))
        return "d", moment.isoformat(sep=" ")
    return "n", raw


def sheet_rows(content: bytes) -> Iterator[list[tuple[str, str] | None]]:
    """Rows of the first sheet; the sheet is read as a stream."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared, dates = _shared_strings(book), _date_styles(book)
        with book.open(_first_sheet(book)) as sheet:
            for _, node in ET.iterparse(sheet):
                if _local(node.tag) != "row":
                    continue
                row: list[tuple[str, str] | None] = []
                for cell in node:
                    at = _column_index(cell.attrib["r"]) if "r" in cell.attrib else len(row)
                    row.extend([None] * (at - len(row)))
                    row.append(_cell(cell, shared, dates))
                yield row
                node.clear()


def _names(row: list[tuple[str, str] | None]) -> list[str]:
    return column_names([c[1] if c else None for c in row])


def _headers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for content in batch["content"]:
            names = _names(next(sheet_rows(content), []))
            yield pd.DataFrame({"at": range(len(names)), "name": names})


def read_excel(spark: SparkSession, path: str) -> DataFrame:
    """All workbooks under the path, columns matched by name."""
    return read_workbooks(spark.read.format("binaryFile").load(path).select("content"))


def read_workbooks(books: DataFrame) -> DataFrame:
    """Rows of workbooks given as a column ``content`` of bytes.

    A column is a number, date or truth value when all its cells are.
    """
    found = books.mapInPandas(_headers, "at int, name string")
    names = [
        r["name"] for r in found.groupBy("name").agg(F.min("at").alias("at")).orderBy("at", "name").collect()
    ]
    if not names:
        raise EmptyDatasetError("no header row")
    fields = [f"c{i}" for i in range(len(names))]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                lines = sheet_rows(content)
                here = {n: i for i, n in enumerate(_names(next(lines, [])))}
                places = [here.get(n) for n in names]
                kept = []
                for line in lines:
                    cells = [line[p] if p is not None and p < len(line) else None for p in places]
                    cells = [None if c and c[0] == "s" and c[1] in NA_TOKENS else c for c in cells]
                    if any(cells):
                        kept.append(["".join(c[0] if c else "-" for c in cells), *[c[1] if c else None for c in cells]])
                    if len(kept) == BATCH:
                        yield pd.DataFrame(kept, columns=["kinds", *fields])
                        kept = []
                if kept:
                    yield pd.DataFrame(kept, columns=["kinds", *fields])

    schema = T.StructType([T.StructField(f, T.StringType()) for f in ["kinds", *fields]])
    raw = books.mapInPandas(rows, schema)
    aggs = []
    for i, f in enumerate(fields):
        kind = F.substring("kinds", i + 1, 1)
        aggs += [F.count(f).alias(f"n{i}"), F.count_if(parse_number(F.col(f)) == F.floor(parse_number(F.col(f)))).alias(f"w{i}")]
        aggs += [F.count_if(kind == k).alias(f"{k}{i}k") for k in "ndb"]
    seen = raw.agg(*aggs).first()
    out = []
    for i, (f, name) in enumerate(zip(fields, names)):
        n, x = seen[f"n{i}"], F.col(f)
        if n == seen[f"n{i}k"]:
            x = parse_number(x)
            if n and n == seen[f"w{i}"]:
                x = x.cast("bigint")
        elif n == seen[f"d{i}k"]:
            x = x.cast("timestamp_ntz")
        elif n == seen[f"b{i}k"]:
            x = x.cast("boolean")
        out.append(x.alias(name))
    return raw.select(*out)
