"""Connected components by contraction and alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semgraph.functions.scratch import Scratch
from semgraph.operators.nodes import Numbered, hashed

MAX_ROUNDS = 60
#: Times that nodes are taken into their smallest neighbours before the rounds.
CONTRACTIONS = 2


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node of an undirected edge list; the component is its smallest node.

    Rounds move numbers instead of text. Every round hangs the larger neighbours of a node onto its smallest neighbour,
    then the smaller ones; the number of rounds grows with the logarithm of the graph, not with its longest path. Minima
    combine before the shuffle and are written, so that the join after them is between two plain scans and the centre of
    a giant star can be split.
    """
    g = hashed(edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")), "components", directed=False)
    roots = g.scratch.save(g.named(rooted(g)), "roots")
    smallest = g.scratch.save(roots.groupBy("root").agg(F.min("node").alias("component")), "smallest")
    return roots.join(smallest, "root").select("node", "component")


def rooted(g: Numbered) -> DataFrame:
    """(id, root) for every node of a numbered graph of undirected links, each once; the root is a node of its component.

    First each node is taken into the smallest of itself and its neighbours. That leaves a small part of the nodes and
    links for the rounds; what they find is handed back. The links of ``g`` are used up: no copy of them is left.
    """
    scratch = g.scratch
    links = g.links.where("u != v")
    taken = []
    for _ in range(CONTRACTIONS):
        least = _least(links, scratch, "taken")
        taken.append(least.select(F.col("u").alias("id"), F.col("m").alias("root")))
        for end in ("u", "v"):
            to = least.select(F.col("u").alias(end), F.col("m").alias("_to"))
            links = links.join(g.hashable(to), end).select(*[F.col("_to" if c == end else c).alias(c) for c in ("u", "v")])
            links = scratch.save(_ordered(links) if end == "v" else links, "stars", hint=False)
            scratch.forget("links")
            scratch.forget("stars", keep=1)
    roots = _starred(links, scratch)
    for earlier in reversed(taken):
        onward = roots.select(F.col("id").alias("root"), F.col("root").alias("_to"))
        roots = scratch.save(earlier.join(onward, "root", "left").select("id", F.coalesce("_to", "root").alias("root")), "roots")
    return g.nodes.select("id").join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("root"))


def _starred(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, root) of all nodes but the roots, which are the smallest ids of their components."""
    # Order-independent digest of a link list: equal digests of two rounds mean that no link changed.
    digest = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    before = None
    for _ in range(MAX_ROUNDS):
        wide = scratch.save(_large_star(links, scratch), "wide", hint=False)
        links, now = scratch.measured(_small_star(wide, scratch), "stars", hint=False, digest=digest)
        scratch.forget("wide", "least")
        scratch.forget("stars", keep=1)
        if now == before or not now["n"]:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return links.select(F.col("u").alias("id"), F.col("v").alias("root"))


def _least(links: DataFrame, scratch: Scratch, name: str = "least") -> DataFrame:
    """(u, m): the smallest of each node and its neighbours."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return scratch.save(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), name)


def _ordered(links: DataFrame) -> DataFrame:
    """Every link once, from the larger to the smaller id."""
    return links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct()


def _large_star(links: DataFrame, scratch: Scratch) -> DataFrame:
    """Each node's larger neighbours hang on the smallest of the node and its neighbours."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = Numbered.hashable(_least(links, scratch))
    return _ordered(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small_star(links: DataFrame, scratch: Scratch) -> DataFrame:
    """Each node and its smaller neighbours hang on the smallest of those neighbours."""
    least = scratch.save(links.groupBy("u").agg(F.min("v").alias("m")), "least")
    own = least.select("u", F.col("m").alias("v"))
    others = links.join(Numbered.hashable(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _ordered(own.unionByName(others))
