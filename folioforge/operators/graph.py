"""Connected components on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.session import dropped, written


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that each node of an undirected edge list is connected to.

    Rounds of large-star and small-star steps: in each, the neighbours of a node are linked to the smallest of them by a partial
    aggregation and a join, never gathered in a list, and lineage is cut. Null ends, loops and repeated edges are ignored. Raises
    if the rounds don't suffice, which they do for any component of up to about 2^30 nodes.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    e = written(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.where("u <> v").distinct(), "large")
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        new = written(small.where("u <> v").distinct(), "edges")
        if not new.join(e, ["u", "v"], "left_anti").limit(1).count() and new.count() == e.count():
            dropped(e, large)
            return new.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(new.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
        dropped(e, large)
        e = new
    raise RuntimeError("components: more rounds needed")
