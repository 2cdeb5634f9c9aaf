"""Joining a lookup table whose size grows with the data.

The lookup is written once. Keys that hold many rows are taken out and broadcast
alone, since only a bounded number of keys can each hold more than a fixed share
of all rows; the others are joined by shuffle, or by broadcast where Spark finds
what was written smaller than its threshold in bytes.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.functions.columns import col
from tabwright.session import written

HOT_SHARE = 1.0 / 2000
SPREAD = 256


def _match(keys: Sequence[str]):
    tests = [col(k).eqNullSafe(F.col(f"__j{i}")) for i, k in enumerate(keys)]
    return reduce(lambda a, b: a & b, tests)


def join_lookup(
    rows: DataFrame, lookup: DataFrame, keys: Sequence[str], weight: str, stored: bool = False
) -> DataFrame:
    """Left join ``lookup`` (unique on ``keys``) to ``rows``; NULL keys match.

    ``weight`` is the lookup column with the number of rows behind each key;
    it is not kept. ``stored`` says that the lookup is read from storage as it is.
    """
    values = [c for c in lookup.columns if c not in keys and c != weight]
    kept = [col(c) for c in rows.columns]
    if not keys:
        # One group in all: the lookup is a single row.
        only = lookup.drop(weight).withColumn("__j", F.lit(1))
        one = rows.withColumn("__all", F.lit(1)).join(F.broadcast(only), F.col("__all") == F.col("__j"), "left")
        return one.select(*kept, *[col(v) for v in values])
    lookup = lookup if stored else written(lookup, "lookup")
    renamed = lookup.select(
        *[col(k).alias(f"__j{i}") for i, k in enumerate(keys)], *[col(v) for v in values], col(weight).alias("__w")
    )
    total = renamed.agg(F.sum("__w")).first()[0]
    floor = F.lit((total or 0) * HOT_SHARE)
    hot = renamed.filter(F.col("__w") > floor).drop("__w")
    hot = hot.select(
        *[F.col(f"__j{i}") for i in range(len(keys))], F.struct(*[col(v) for v in values]).alias("__hot")
    )
    cold = renamed.filter(F.col("__w") <= floor).drop("__w").withColumn("__s", F.lit(0))
    tagged = rows.join(F.broadcast(hot), _match(keys), "left").drop(*[f"__j{i}" for i in range(len(keys))])
    # A hot row has no partner left in the shuffled part: spread it by its
    # other columns so that no task gets them all.
    spread = 1 + F.pmod(F.xxhash64(*[col(c) for c in rows.columns]), F.lit(SPREAD)).cast("int")
    tagged = tagged.withColumn("__rs", F.when(F.col("__hot").isNotNull(), spread).otherwise(F.lit(0)))
    joined = tagged.join(cold, _match(keys) & (F.col("__rs") == F.col("__s")), "left")
    out = [F.when(F.col("__hot").isNotNull(), F.col("__hot")[v]).otherwise(col(v)).alias(v) for v in values]
    return joined.select(*kept, *out)
