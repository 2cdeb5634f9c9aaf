"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable, Iterator
from contextlib import contextmanager, suppress
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.session import fresh_folder

T = TypeVar("T")

#: While a table is written: its shuffle files go once the write has ended, and
#: batches of texts for Python workers are small.
WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
}

#: What a Python worker keeps from one task to the next.
_KEPT: dict = {}


def kept(key: Hashable, make: Callable[[], T]) -> T:
    """A tokenizer or model that outlives a task; one at a time, as one worker serves all steps of a pipeline."""
    if key not in _KEPT:
        dropped()
        _KEPT[key] = make()
    return _KEPT[key]


def dropped() -> None:
    """What another step has left in this worker goes, back to the system too.

    Spark gives a task the worker that has waited longest, so all of an executor's
    workers come to hold what a step keeps, and outlive it. Steps that keep nothing
    call this first.
    """
    if not _KEPT:
        return
    _KEPT.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # glibc's; others do without
        ctypes.CDLL(None).malloc_trim(0)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings of the session for what runs inside; the old ones come back after."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def publish(df: DataFrame, label: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: lineage ends here."""
    path = fresh_folder(df.sparkSession, label)
    with settings(df.sparkSession, WRITING):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def only(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """The two columns an operator needs, under its own names."""
    return docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text_column}`").alias("text"))


def held_out(id_column: str, parts: int, part: int) -> Column:
    """Whether crc32(id as text) leaves this remainder; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_column).cast("string").cast("binary")), F.lit(parts)) == part, F.lit(False))


def parts_for(spark: SparkSession, factor: int = 1) -> int:
    """Shuffle partitions of the session, which the cluster sizes to its data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) * factor)
