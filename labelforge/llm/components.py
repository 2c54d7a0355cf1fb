"""Connected components of an edge table, by minimum labels with pointer jumping."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelforge.llm.store import materialize


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) → (id, component): the smallest id each vertex can reach, for the vertices
    that have an edge. Every round takes the smallest label around a vertex and then that label's
    own label, so chains shorten by half; it ends when nothing changes. Nothing is collected but
    the number of changes. Both tables of every join are written ones, so Spark can split a hub."""
    both = materialize(edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*"), "edges")
    label = materialize(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("a"), F.min("b")).alias("component")), "labels")
    while True:
        near = both.join(label.select(F.col("id").alias("b"), F.col("component").alias("c")), "b").groupBy(F.col("a").alias("id")).agg(F.min("c").alias("c"))
        low = materialize(near.join(label, "id").select("id", F.col("component").alias("was"), F.least("component", "c").alias("component")), "labels-near")
        if not low.where("was <> component").limit(1).count():
            return label
        up = low.select(F.col("id").alias("component"), F.col("component").alias("c"))
        label = materialize(low.join(up, "component").select("id", F.least("component", "c").alias("component")), "labels")
