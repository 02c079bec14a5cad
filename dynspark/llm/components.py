"""Connected components of a graph given as links, by alternating large stars and small stars.

Each round hangs every node's larger neighbours (large star) and then its smaller ones (small star) below the least node
that it sees. Both keep components and end when each component is one star around its least node. A round is two
aggregations with map-side combine and two joins on a node; nothing is gathered by node, so the centre of a large star
costs no more than its rows, and the joins are ones whose skewed partitions Spark splits. Links stay distributed, and
each round is written to the shared checkpoint folder. The driver sees two numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dynspark.llm.common import written


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """links: u, v (longs). Returns node, component (the least node reachable) for each node that has a link to another."""
    links = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct()
    links, before = written(links), None
    for _ in range(most_rounds):
        found = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if found == before:
            break
        before, links = found, written(_small_star(_large_star(links)))
    else:
        raise RuntimeError("the components didn't settle")
    ends = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(ends)
