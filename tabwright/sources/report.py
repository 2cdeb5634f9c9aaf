"""The analytics export: comment lines, header, grand total, event rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "group string, event_name string, active_users bigint, event_count bigint, extra string"


def read_ga_report(spark: SparkSession, path: str) -> DataFrame:
    """group, event_name, active_users, event_count by position.

    The stray fifth field of the total row is dropped, the row is kept.
    """
    return (
        spark.read.schema(SCHEMA)
        .option("header", True)
        .option("comment", "#")
        .option("enforceSchema", True)
        .csv(path)
        .drop("extra")
    )
