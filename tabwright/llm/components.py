"""Connected components of a link table, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import publish


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """The smallest id reachable from each id that occurs in an edge.

    Returns (id, root). Each round takes the smallest label among a node's
    neighbours, hooks the node's old label to it, and follows labels one step
    further, so the rounds grow with the logarithm of a component's diameter.
    Edges with a null end are ignored. Labels are written once a round; minima
    are combined before every shuffle, so a node with many links is no hot task.
    """
    ends = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null and x <> y")
    both = publish(ends.unionByName(ends.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "links")
    labels = publish(
        both.groupBy(F.col("x").alias("id")).agg(F.min("y").alias("m")).select("id", F.least("id", "m").alias("root")),
        "labels",
    )
    while True:
        near = both.join(labels.select(F.col("id").alias("y"), F.col("root").alias("seen")), "y").select(
            F.col("x").alias("id"), "seen"
        )
        least = near.groupBy("id").agg(F.min("seen").alias("seen"))
        offered = labels.join(least, "id").select("id", "root", F.least("root", "seen").alias("best"))
        hooks = offered.where("best < root").select(F.col("root").alias("id"), F.col("best").alias("seen"))
        moved = publish(
            offered.select("id", F.col("best").alias("seen")).unionByName(hooks).groupBy("id").agg(F.min("seen").alias("root")),
            "labels",
        )
        far = moved.select(F.col("id").alias("root"), F.col("root").alias("further"))
        after = publish(
            moved.join(far, "root").select("id", F.least("root", "further").alias("root")), "labels"
        )
        changed = after.join(labels.withColumnRenamed("root", "old"), "id").where("root <> old").limit(1).count()
        labels = after
        if not changed:
            return labels
