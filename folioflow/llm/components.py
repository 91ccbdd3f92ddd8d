"""Connected components on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.runtime import cut


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(id, component) for each id in ``edges``; component is the smallest id reachable.

    Each round takes the smallest label among the neighbours and then the label of that label
    (pointer jumping), so long chains end in a logarithmic number of rounds. Only aggregates with
    map-side combine and equi-joins, which Spark can split on a hot id; nothing is collected. Rounds
    are cut by reliable checkpoints. Edges with a null end are ignored.
    """
    whole = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null and a <> b")
    both = cut(whole.union(whole.select("b", "a")).distinct())
    labels = cut(both.groupBy(F.col("a").alias("id")).agg(F.least("id", F.min("b")).alias("component")))
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "near").alias("low"))
        jump = labels.select(F.col("id").alias("low"), F.col("component").alias("far"))
        after = cut(lower.join(jump, "low", "left").select("id", "old", F.least("low", F.coalesce("far", "low")).alias("component")))
        labels = after.select("id", "component")
        if not after.where("old <> component").limit(1).count():
            return labels
