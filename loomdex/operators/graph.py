"""Connected components as DataFrame iterations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.session import cut


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Rows (node, component): component is the least node of its component, by the order of the type.

    Alternating large-star and small-star rounds: each takes one shuffle by node, keeps at most as many edges as there
    were, and needs about log2 of the longest path in rounds. Every round is written to the shared checkpoint folder. A hub
    is folded by ``min`` over pre-aggregated partitions; its neighbours are joined back by key, where AQE splits a skewed side.
    No row of the graph reaches the driver, only a count of changed edges. Self loops give a component of one node; null ends
    are ignored; an empty table gives an empty result.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    e = cut(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    nodes = e.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    e = e.where("u <> v")
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        new = cut(small.where("u <> v").distinct())
        changed = new.exceptAll(e).limit(1).count() + e.exceptAll(new).limit(1).count()
        e = new
        if not changed:
            break
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    top = e.groupBy("u").agg(F.min("v").alias("component"))
    return nodes.join(top, nodes["node"] == top["u"], "left").select("node", F.coalesce("component", "node").alias("component"))
