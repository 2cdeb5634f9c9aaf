"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as
Parquet and read again as the next stage's docs. All but the last return the
columns of ``documents``; the last returns one row for each packed piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabwright.llm import chunks, language, minhash, packing, quality
from tabwright.llm.common import publish, table

STAGES = [
    ("quality classifier", quality.stage),
    ("language id", language.stage),
    ("minhash near-dedup", minhash.stage),
    ("substring dedup", chunks.stage),
    ("best-fit packing", packing.stage),
]

#: Hash signatures, rolling hashes, fitted models and a tokenizer are no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, on the whole table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = publish(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
