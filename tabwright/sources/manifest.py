"""What the files of a path begin with, without reading them.

Listing gives each file's path and length. Executors read the first block of each
file, and more only while its first record has not ended, so the bytes read grow
with the number of files and not with their size. Headers are grouped where they
were read; only distinct ones reach the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.sources.records import _patterns

BLOCK = 1 << 16
#: Files that one task looks at, about.
FILES = 256


def file_system(path: str):
    """The file system of an address, for reads by range, and the path on it."""
    from pyarrow import fs

    scheme, found, rest = path.partition(":")
    if not found:
        return fs.LocalFileSystem(), path
    if scheme == "file":
        rest = "///" + rest.lstrip("/")
    return fs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}:{rest}")


def first_record(stream, sep: str) -> str | None:
    """The first record that is not blank, with line ends inside quotes; None if there is none."""
    outside, inside = (re.compile(p) for p in _patterns(sep, r"\Z"))
    data, done = b"", False
    while not done:
        block = stream.read(BLOCK)
        data, done = data + block, not block
        lines = data.decode("utf-8", "ignore").removeprefix("﻿").split("\n")
        held: list[str] = []
        for text in lines if done else lines[:-1]:
            if not held and not text.strip():
                continue
            quoted = (inside if held else outside).match(text) is not None
            held.append(text)
            if not quoted:
                return "\n".join(held).removesuffix("\r")
        if done and held:
            return "\n".join(held).removesuffix("\r")
    return None


def manifest(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, length) of every file of a path; nothing is read."""
    return spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file"), "length")


def headers(spark: SparkSession, path: str | list[str], sep: str) -> DataFrame:
    """(file, length, header) of every file that holds a record."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            found = []
            for file in part["file"]:
                files, at = file_system(file)
                with files.open_input_stream(at, compression="detect") as stream:
                    found.append(first_record(stream, sep))
            yield part.assign(header=pd.Series(found, dtype=object, index=part.index))

    files = manifest(spark, path)
    count = files.count()
    spread = files.repartition(max(1, min(-(-count // FILES), 10_000)), "file") if count > 1 else files
    return spread.mapInPandas(read, "file string, length long, header string").where("header is not null")


def readable_by_range(spark: SparkSession, path: str | list[str]) -> bool:
    """Whether the store of a path can be read by range here; else Spark's readers are all there is."""
    first = manifest(spark, path).head(1)
    try:
        return not first or file_system(first[0]["file"]) is not None
    except Exception:  # a scheme that is not known, or a client that is not there
        return False
