"""Numbers for the nodes of a graph, so that measures move numbers instead of names."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from semgraph.functions.scratch import FEW, Scratch


@dataclass
class Numbered:
    """A graph with a number for each of its nodes, written once for the rounds of a measure."""

    nodes: DataFrame
    links: DataFrame
    scratch: Scratch
    #: Different directed links that undirected ones stand for, where they were counted.
    stated: int | None = None

    @staticmethod
    def hashable(per_node: DataFrame) -> DataFrame:
        """One row per node, joined to links by hashing a part of it in each task: the links need no sort."""
        return per_node.hint("shuffle_hash")

    def named(self, measured: DataFrame) -> DataFrame:
        return self.nodes.join(measured, "id").drop("id")


def positions(ordered: DataFrame, column: str, out: str, scratch: Scratch) -> DataFrame:
    """0-based positions of a sorted frame without gathering it: offsets of sorted partitions are summed."""
    placed = scratch.save(
        ordered.select(column, F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")), "placed"
    )
    totals = placed.groupBy("_part").agg(F.count("*").alias("_rows"), F.min("_at").alias("_from"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    # One row per partition of the sorted frame.
    return placed.join(F.broadcast(starts), "_part").select(column, (F.col("_before") + F.col("_at") - F.col("_from")).alias(out))


def undirected(edges: DataFrame) -> DataFrame:
    """Every link once, smaller end first; self-links stay."""
    return edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def edge_nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()


def numbered(edges: DataFrame, job: str, *, directed: bool = True) -> Numbered:
    """Ids in the order of the node names. They do not depend on partitions: what is decided by an id repeats exactly."""
    scratch = Scratch(edges.sparkSession, job, FEW)
    plain = edges.select("src", "dst") if directed else undirected(edges)
    plain = scratch.save(plain, "named")
    nodes = scratch.save(positions(edge_nodes(plain).orderBy("node"), "node", "id", scratch), "nodes")
    left = nodes.select(F.col("node").alias("src"), F.col("id").alias("u"))
    right = nodes.select(F.col("node").alias("dst"), F.col("id").alias("v"))
    links = scratch.save(plain.join(left, "src").join(right, "dst").select("u", "v"), "links", sort=("u",), hint=False)
    scratch.forget("named", "placed")
    return Numbered(nodes, links, scratch)


def hashed(edges: DataFrame, job: str, *, directed: bool = True, bits: int = 64) -> Numbered:
    """Ids are hashes of the node names; each link once, however often it is in ``edges``, undirected ones as (smaller id, larger id).

    No name is joined or sorted: names meet once by their hash, to be found again and to see that no two share one. Should
    two do so, the nodes are numbered by their order instead.
    """
    scratch = Scratch(edges.sparkSession, job, FEW)

    def number(name: str):
        return F.xxhash64(name) if bits == 64 else F.pmod(F.xxhash64(name), F.lit(1 << bits))

    links, seen_links = edges.select(number("src").alias("u"), number("dst").alias("v")), Observation()
    if directed:
        links = links.distinct()
    else:  # one bit for each way that a link is stated
        ways = F.bit_or(F.when(F.col("u") <= F.col("v"), 1).otherwise(2)).alias("ways")
        links = links.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(ways)
        links = links.observe(seen_links, F.coalesce(F.sum(F.bit_count("ways")), F.lit(0)).alias("stated")).select("u", "v")
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"))
    found = ends.groupBy(number("node").alias("id")).agg(F.min("node").alias("node"), F.max("node").alias("_other"))
    nodes, seen = scratch.measured(found, "nodes", shared=F.count_if(F.col("node") != F.col("_other")))
    if seen["shared"]:
        g = numbered(edges.distinct(), job, directed=directed)
        return replace(g, stated=edges.select("src", "dst").distinct().count())
    links = scratch.save(links, "links", hint=False)
    return Numbered(nodes.drop("_other"), links, scratch, None if directed else seen_links.get["stated"])
