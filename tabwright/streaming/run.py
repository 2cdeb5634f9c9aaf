"""Running a streaming frame to the end of its present input."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.functions.columns import col
from tabwright.session import fresh_folder

#: Time of the closing mark; streams leave out what is not before it.
CLOSING = "9000-01-01 00:00:00"


def read_stream(
    spark: SparkSession, folder: str, name: str, ts: str = "ts", files_per_batch: int | None = None
) -> tuple[DataFrame, Callable[[], None]]:
    """The Parquet file ``name`` of a folder as a stream, and what closes it.

    Closing writes a row of a far time to a second source, so that the watermark
    passes all that came before and a finished input gives all its results.
    """
    schema = spark.read.parquet(f"{folder}/{name}").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    marks = fresh_folder(spark, "closing")
    spark.createDataFrame([], schema).write.parquet(marks)

    def close() -> None:
        row = [F.lit(CLOSING if f.name == ts else None).cast(f.dataType).alias(f.name) for f in schema.fields]
        spark.range(1).select(*row).write.mode("append").parquet(marks)

    return reader.parquet(folder).unionByName(spark.readStream.schema(schema).parquet(marks)), close


def before_closing(ts: str = "ts"):
    """A condition on the event time itself, so that it stays above the watermark."""
    return col(ts) < F.lit(CLOSING).cast(T.TimestampType())


def drain(stream: DataFrame, label: str, close: Callable[[], None] | None = None) -> DataFrame:
    """Write what the stream yields to shared storage and read it back.

    With ``close`` the input is finished: the query runs on from its checkpoint
    after the closing mark.
    """
    spark = stream.sparkSession
    target, marks = fresh_folder(spark, f"{label}-out"), fresh_folder(spark, f"{label}-marks")

    def run() -> None:
        writer = stream.writeStream.format("parquet").outputMode("append").option("path", target)
        writer.option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()

    run()
    if close is not None:
        close()
        run()
    return spark.read.schema(stream.schema).parquet(target)
