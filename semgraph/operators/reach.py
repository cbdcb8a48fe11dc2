"""Transitive closure of links, with cycles contracted to one node each.

Joins here are between written tables, so adaptive execution can split a node that most links point to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semgraph.functions.scratch import Scratch

#: Steps along single links before the graph is taken to be deep; a shallow one ends by then.
SHALLOW = 3
MAX_ROUNDS = 60


def closed(scratch: Scratch, links: DataFrame) -> DataFrame:
    """All (a, b) such that a path of links leads from a to b; links are (a, b) rows.

    Shallow graphs are closed step by step along their links. Where paths are longer, cycles are looked for and each
    is made one node, the condensed graph is closed by doubling the paths, and members are spelled out at the end, so
    that rounds grow with the logarithm of the longest path and a cycle's members are multiplied once.
    """
    links = scratch.save(links.where("a IS NOT NULL AND b IS NOT NULL").distinct(), "links")
    paths, fresh = _steps(scratch, links, SHALLOW)
    if fresh is None:
        return paths
    member = condensed(scratch, links)
    if member is None:
        return _doubled(scratch, paths, fresh)
    inner = _renamed(_renamed(links, member, "a"), member, "b")
    one, _ = scratch.measured(inner.where("a <> b").distinct(), "condensed")
    paths, fresh = _steps(scratch, one, SHALLOW)
    paths = paths if fresh is None else _doubled(scratch, paths, fresh)
    loops = member.select(F.col("root").alias("a"), F.col("root").alias("b")).distinct()  # each member of a cycle reaches all, itself too
    spread = paths.unionByName(loops.join(_known(paths), ["a", "b"], "left_anti"))
    for end in ("a", "b"):
        names = member.select(F.col("root").alias(end), F.col("node").alias("_m"))
        spread = spread.join(names, end, "left").withColumn(end, F.coalesce("_m", end)).drop("_m")
    # A link from a node to itself that lies on no other cycle is gone with the condensation.
    own = links.where("a = b").join(member.select(F.col("node").alias("a")), "a", "left_anti")
    return scratch.save(spread.select("a", "b").unionByName(own), "closed")


def extended(scratch: Scratch, paths: DataFrame, links: DataFrame) -> DataFrame:
    """New (a, b) that links (none of them in ``paths``) add to closed paths, the links left out."""
    both = scratch.save(paths.unionByName(links), "paths")
    return _doubled(scratch, both, links).join(_known(both), ["a", "b"], "left_anti")


def _known(paths: DataFrame) -> DataFrame:
    """Paths to be left out of a join: there may be many, so they never go through the driver."""
    return paths.hint("merge")


def _onward(links: DataFrame) -> DataFrame:
    return links.select(F.col("a").alias("b"), F.col("b").alias("c"))


def _steps(scratch: Scratch, links: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """Paths of up to ``most`` + 1 links, and those of the last step if there may be longer ones."""
    paths, fresh = links, links
    for _ in range(most):
        ahead = fresh.join(_onward(links), "b").select("a", F.col("c").alias("b"))
        fresh, seen = scratch.measured(ahead.distinct().join(_known(paths), ["a", "b"], "left_anti"), "step")
        if not seen["n"]:
            return paths, None
        paths = paths.unionByName(fresh)
    return paths, fresh


def _doubled(scratch: Scratch, paths: DataFrame, fresh: DataFrame) -> DataFrame:
    """Close paths by joining the last round's with all, on either side."""
    for _ in range(MAX_ROUNDS):
        left = fresh.join(_onward(paths), "b").select("a", F.col("c").alias("b"))
        right = paths.join(_onward(fresh), "b").select("a", F.col("c").alias("b"))
        found = left.unionByName(right).distinct().join(_known(paths), ["a", "b"], "left_anti")
        fresh, seen = scratch.measured(found, "doubled")
        if not seen["n"]:
            return paths
        paths = paths.unionByName(fresh)
    raise RuntimeError(f"no closure in {MAX_ROUNDS} rounds")


def _renamed(links: DataFrame, member: DataFrame, end: str) -> DataFrame:
    names = member.select(F.col("node").alias(end), F.col("root").alias("_r"))
    return links.join(names, end, "left").withColumn(end, F.coalesce("_r", end)).drop("_r")


def condensed(scratch: Scratch, links: DataFrame) -> DataFrame | None:
    """(node, root) of nodes on cycles, those of one strongly connected part under its least node; None without cycles.

    Each node keeps one link out, to its least and in every other pass to its greatest neighbour. Following these by
    doubling, only nodes that lead into a cycle are left, and the nodes reached are those on cycles. These are contracted
    and the passes go on until two find nothing. Cycles along other links may be left; the closure of paths that
    follows finds these as it finds any path.
    """
    member, idle, odd, work = None, 0, False, links
    for _ in range(MAX_ROUNDS):
        pick = F.max("b") if odd else F.min("b")
        onward = scratch.save(work.where("a <> b").groupBy("a").agg(pick.alias("b")), "onward")
        cycles = _cycles(scratch, onward)
        idle, odd = (0 if cycles is not None else idle + 1), not odd
        if idle == 2:
            return member
        if cycles is None:
            continue
        work = scratch.save(_renamed(_renamed(work, cycles, "a"), cycles, "b").where("a <> b").distinct(), "work")
        if member is None:
            member = cycles
        else:
            member = member.select("node", F.col("root").alias("_old")).join(
                cycles.select(F.col("node").alias("_old"), F.col("root").alias("_new")), "_old", "left")
            grown = member.select("node", F.coalesce("_new", "_old").alias("root"))
            member = scratch.save(grown.unionByName(cycles.join(grown.select("node"), "node", "left_anti")), "member")
    return member


def _cycles(scratch: Scratch, onward: DataFrame) -> DataFrame | None:
    """(node, root) of the cycles of a graph with one link (a, b) out of each node."""
    jump, seen = scratch.measured(onward.select("a", "b", F.least("a", "b").alias("m")), "jump")
    # Of a path of L links L - reach + 1 starts have ``reach`` links ahead: with fewer than that left, it is no path but a cycle.
    reach, enough = 1, 1 + seen["n"]
    while reach < enough:  # m is the least node among the ``reach`` first of a path
        ahead = jump.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("m").alias("_m"))
        jump, seen = scratch.measured(jump.join(ahead, "b").select("a", F.col("c").alias("b"), F.least("m", "_m").alias("m")), "jump")
        scratch.forget("jump", keep=1)
        if not seen["n"]:
            return None
        reach *= 2
        enough = min(enough, reach + seen["n"])
    on = jump.select(F.col("b").alias("a")).distinct()
    return scratch.save(jump.join(on, "a", "left_semi").select(F.col("a").alias("node"), F.col("m").alias("root")), "cycles")
