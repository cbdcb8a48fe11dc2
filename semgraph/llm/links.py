"""Connected components of links between long ids, by alternating large and small stars.

Large stars tie every larger neighbour of a node to the least one, small stars every smaller neighbour; the links
shrink to one star per component in a few rounds. Each half round writes the least neighbours and the new
links as tables, so the join that follows is between two plain scans and Spark can split the centre of a
giant star. Loops and repeated links do no harm; null ends are dropped; no links give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semgraph.functions.scratch import Scratch

#: A loop that has not ended by then stops the job: rounds grow with the logarithm of the longest path.
ROUNDS = 60


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """node, root for every node of ``links`` (a, b); the root is the least node of the component."""
    scratch = Scratch(spark, "components")
    high, low = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    stars, before = scratch.measured(
        links.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(high, low).distinct(), "links", mark=_mark()
    )
    for _ in range(ROUNDS):
        if not before["n"]:
            break
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.save(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        stars = scratch.save(large, "large")
        least = scratch.save(stars.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = stars.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        own = least.select("u", F.col("m").alias("v"))
        stars, now = scratch.measured(small.unionByName(own).distinct(), "small", mark=_mark())
        if (now["n"], now["mark"]) == (before["n"], before["mark"]):
            break
        before = now
    else:
        raise RuntimeError(f"components were not found in {ROUNDS} rounds")
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _mark():
    return F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
