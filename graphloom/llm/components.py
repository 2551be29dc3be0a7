"""Connected components of a link table by alternating large-star and small-star steps.

Every step is a pair of joins and aggregations on Spark; nothing is collected.
Minima are aggregated before they are joined back, and are read back from the
shared folder, so that a hub's links are spread over tasks by the skew join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, passing


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node reachable, for every linked node but the roots.

    Links with a null end and links of a node with itself count for nothing.
    """
    with passing(links.sparkSession) as keep:
        edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), (F.col(a) != F.col(b)).alias("ok"))
        edges = cut(edges.where("ok").select("u", "v").distinct(), "links")
        before = _signature(edges)
        while before[0]:
            with passing(links.sparkSession) as keep_step:
                edges = keep_step(_step(edges))
            after = _signature(edges)
            if after == before:
                break
            before = after
        return keep(edges).select(F.col("u").alias("node"), F.col("v").alias("root"))


def _step(edges: DataFrame) -> DataFrame:
    # large star: every larger neighbour is linked to the smallest of the neighbourhood
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("mu"), F.least("u", "m").alias("m")), "star")
    large = both.where("v > u").join(least, F.col("u") == F.col("mu")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    large = cut(large.where("u != v").distinct(), "large-star")
    # small star: the node and its smaller neighbours are linked to the smallest of them
    least = cut(large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "mu"), "star")
    small = large.join(least, F.col("u") == F.col("mu")).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return cut(small.unionByName(least.select(F.col("mu").alias("u"), F.col("m").alias("v"))).distinct(), "small-star")
