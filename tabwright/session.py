"""Session settings and the folder shared by all executors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


#: The state store that ordered events on streams need.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def local_session(cores: str = "*", name: str = "tabwright") -> SparkSession:
    """A session for tests and the benchmark on one machine; a cluster brings its own."""
    threads = 8 if cores == "*" else int(cores)
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(threads))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", f"/tmp/{name}-shared")
        .config("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, or the context's checkpoint folder.

    It must be on storage that the driver and every executor see.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    named = named or context.getCheckpointDir()
    if not named:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named.rstrip("/")


def fresh_folder(spark: SparkSession, label: str) -> str:
    """A path nobody has used yet, on storage every executor sees."""
    return f"{shared_folder(spark)}/tabwright-{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """The frame, written once to the shared folder and read from there."""
    path = fresh_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
