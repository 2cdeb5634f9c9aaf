"""Published stages of a dataset: raw, cleaned, engineered."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.operators.profile import quality_overview
from tabwright.sources.readers import assert_not_empty, dataset_info

STAGES = ("raw", "cleaned", "engineered")


class StageStore:
    """Stages as Parquet under one folder of shared storage.

    Each save goes to a new version folder, so a stage can be rebuilt from
    itself and a failed write never hides the version before it.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def _path(self, text: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(text)

    def _files(self):
        return self._path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self, stage: str) -> list[str]:
        """Complete versions, oldest first."""
        self._check(stage)
        fs, folder = self._files(), self._path(f"{self.root}/{stage}")
        if not fs.exists(folder):
            return []
        names = sorted(s.getPath().getName() for s in fs.listStatus(folder))
        return [n for n in names if fs.exists(self._path(f"{self.root}/{stage}/{n}/_SUCCESS"))]

    @staticmethod
    def _check(stage: str) -> None:
        if stage not in STAGES:
            raise ValueError(f"unknown stage: {stage}")

    def exists(self, stage: str) -> bool:
        return bool(self.versions(stage))

    def save(self, stage: str, df: DataFrame) -> DataFrame:
        """Publish a stage; a new raw dataset clears the later stages."""
        self._check(stage)
        if stage == "raw":
            assert_not_empty(df)
        target = f"{self.root}/{stage}/v{time.time_ns():020d}"
        df.write.parquet(target)
        if stage == "raw":
            self.reset_downstream()
        return self.spark.read.parquet(target)

    def load(self, stage: str) -> DataFrame:
        found = self.versions(stage)
        if not found:
            raise FileNotFoundError(f"stage {stage} has not been saved")
        return self.spark.read.parquet(f"{self.root}/{stage}/{found[-1]}")

    def latest_name(self) -> str:
        """Name of the most processed stage, or ``none``."""
        return next((s for s in reversed(STAGES) if self.exists(s)), "none")

    def latest(self) -> DataFrame | None:
        name = self.latest_name()
        return None if name == "none" else self.load(name)

    def has_downstream(self) -> bool:
        return any(self.exists(s) for s in STAGES[1:])

    def reset_downstream(self) -> None:
        """Drop the cleaned and engineered stages of this store."""
        fs = self._files()
        for s in STAGES[1:]:
            fs.delete(self._path(f"{self.root}/{s}"), True)

    def info(self, filename: str, fmt: str | None = None) -> DataFrame:
        return dataset_info(self.load("raw"), filename, fmt)


def save_summary(df: DataFrame, features_created: int | None = None) -> DataFrame:
    """Counts reported with a save.

    Cleaning: rows, columns, missing_cells, duplicate_rows. Features (when
    their number is given): rows, columns, features_created.
    """
    if features_created is None:
        return quality_overview(df).select("rows", "columns", "missing_cells", "duplicate_rows")
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.lit(len(df.columns)).cast("bigint").alias("columns"),
        F.lit(features_created).cast("bigint").alias("features_created"),
    )

