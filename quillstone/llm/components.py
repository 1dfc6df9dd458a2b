"""Connected components of a link table, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import save


def _undirected(edges: DataFrame) -> DataFrame:
    return (
        edges.where(F.col("src") != F.col("dst"))
        .select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
        .distinct()
    )


def connected_components(edges: DataFrame) -> DataFrame | None:
    """`edges` (src long, dst long) to (node, label): one label per component, itself a node of it.

    Each round every node moves to the neighbour with the least priority, a hash salted by the round, so long
    chains shrink by a constant factor whatever the ids are. Aggregations combine map-side and joins have one
    row a node on one side, so that a node with a third of all links is split like any skewed join. Links and
    labels of each round are tables in the shared folder. None if there are no links. Loops and repeated links
    have no effect; rows with a null end are ignored.
    """
    edges = save(_undirected(edges.select("src", "dst")), "links")
    labels, turn = None, 0
    while not edges.isEmpty():
        turn += 1

        def priority(name: str, salt: int = turn) -> Column:
            return F.struct(F.xxhash64(F.col(name), F.lit(salt)).alias("h"), F.col(name).alias("node"))

        both = edges.union(edges.select("dst", "src"))
        least = both.groupBy("src").agg(F.min(priority("dst")).alias("best"))
        own = priority("src")
        parent = save(
            least.select(F.col("src").alias("node"), F.least(F.col("best"), own)["node"].alias("parent")), "parents"
        )
        labels = (
            parent.select("node", F.col("parent").alias("label"))
            if labels is None
            else save(
                labels.join(parent.withColumnRenamed("node", "label"), "label", "left").select(
                    labels["node"], F.coalesce("parent", "label").alias("label")
                ),
                "labels",
            )
        )
        left = parent.select(F.col("node").alias("src"), F.col("parent").alias("p"))
        right = parent.select(F.col("node").alias("dst"), F.col("parent").alias("q"))
        moved = edges.join(left, "src").join(right, "dst").select(F.col("p").alias("src"), F.col("q").alias("dst"))
        edges = save(_undirected(moved), "links")
    return labels
