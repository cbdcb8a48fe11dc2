"""Communities: parallel Louvain, label propagation and greedy agglomeration."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semgraph.functions.scratch import Scratch
from semgraph.functions.terms import IN_COMMUNITY, IRI, TRIPLE_COLUMNS
from semgraph.operators.components import rooted
from semgraph.operators.graph import with_label
from semgraph.operators.nodes import Numbered, numbered, positions, undirected

ALGORITHMS = ("louvain", "label_propagation", "greedy_modularity")
MAX_LEVELS, MAX_MOVES, MAX_ROUNDS = 12, 12, 40
SMALLEST_GAIN = 1e-6
#: Local moves end when no more than this share of the nodes would move; the next level goes on with what is left.
RESTLESS = 1 / 64


@dataclass
class Prepared:
    """A graph ready for any of the algorithms: weighted links read from both ends, also without leaves (id, host)."""

    g: Numbered
    weighted: DataFrame
    folded: DataFrame
    leaves: DataFrame


def prepared(edges: DataFrame) -> Prepared:
    g = numbered(edges, "communities", directed=False)
    loops = g.links.where("u = v").select("u", "v", F.lit(2.0).alias("w"))
    plain = g.links.where("u != v")
    pairs = plain.select("u", "v", F.lit(1.0).alias("w")).unionByName(
        plain.select(F.col("v").alias("u"), F.col("u").alias("v"), F.lit(1.0).alias("w"))
    )
    weighted = g.scratch.save(pairs.unionByName(loops), "weighted", sort=("u",))
    g.scratch.forget("links")
    return Prepared(g, weighted, *_folded(weighted, g.scratch))


def communities(edges: DataFrame, algorithm: str = "louvain", resolution: float = 1.0, seed: int = 42) -> DataFrame:
    """(node, community, converged) with communities numbered by size, then by first member.

    Which nodes move in a round is decided by a hash of the node's place in the order of names, round and seed, so
    runs repeat exactly, however rows are partitioned. ``converged`` is false where a phase used up its rounds.
    """
    _known(algorithm)
    return communities_of(prepared(edges), algorithm, resolution, seed)


def _known(algorithm: str) -> None:
    if algorithm not in ALGORITHMS:
        raise ValueError(f"algorithm is one of {', '.join(ALGORITHMS)}")


def communities_of(graph: Prepared, algorithm: str = "louvain", resolution: float = 1.0, seed: int = 42) -> DataFrame:
    """``communities`` of a graph that several algorithms share."""
    _known(algorithm)
    g, scratch = graph.g, graph.g.scratch
    fold = algorithm == "label_propagation" or resolution <= 1.0
    links = graph.folded if fold else graph.weighted
    if algorithm == "label_propagation":
        found, settled = _label_propagation(links, graph.leaves, scratch, seed)
    elif algorithm == "louvain":
        found, settled = _louvain(links, scratch, resolution, seed)
    else:
        found, settled = _agglomerate(links, scratch, resolution, seed)
    found = _connected(links.where("u < v"), found, scratch)
    if fold:
        found = scratch.save(found, "found")
        hosts = found.select(F.col("id").alias("host"), "label")
        found = found.unionByName(graph.leaves.join(hosts, "host").select("id", "label"))
    named = scratch.save(g.nodes.join(found, "id").select("node", F.col("label")), "named")
    sizes = named.groupBy("label").agg(F.count("*").alias("_size"), F.min("node").alias("_first"))
    # Numbering sorts one row per community.
    ordered = sizes.orderBy(F.desc("_size"), "_first").select("label")
    indexed = positions(ordered, "label", "community", scratch)
    return named.join(indexed, "label").select("node", "community", F.lit(settled).alias("converged"))


def _folded(links: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """A graph without its leaves, whose links become loops of their hosts, and (id, host) of the leaves.

    A node with one link and no loop is best placed with its neighbour, whatever the rest does: by modularity up to a
    resolution of 1, for what it adds to the inside outweighs what any community can expect of it; in label propagation,
    for it hears no other label. Of two nodes that have only each other the larger is the leaf.
    """
    ends = links.groupBy("u").agg(F.count("*").alias("_n"), F.min("v").alias("host")).where("_n = 1 AND host != u")
    single = scratch.save(ends.select(F.col("u").alias("id"), "host"), "single")
    pair = single.select(F.col("id").alias("host"), F.lit(True).alias("_pair"))
    leaves = scratch.save(single.join(pair, "host", "left").where("_pair IS NULL OR id > host").select("id", "host"), "leaves")
    rest = links.join(leaves.select(F.col("id").alias("u")), "u", "left_anti").join(
        leaves.select(F.col("id").alias("v")), "v", "left_anti").select("u", "v", "w")
    held = leaves.groupBy(F.col("host").alias("u")).agg((2.0 * F.count("*")).alias("w")).select("u", F.col("u").alias("v"), "w")
    folded = scratch.save(rest.unionByName(held).groupBy("u", "v").agg(F.sum("w").alias("w")), "folded")
    scratch.forget("single")
    return folded, leaves


def _connected(links: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """Communities whose members hang together only through others are split into their parts, which never lowers modularity."""
    labels = scratch.save(labels, "found")
    a = labels.select(F.col("id").alias("u"), F.col("label").alias("_a"))
    b = labels.select(F.col("id").alias("v"), F.col("label").alias("_b"))
    inner = links.join(a, "u").join(b, "v").where("_a = _b").select("u", "v")
    return rooted(Numbered(labels.select("id"), scratch.save(inner, "inner", hint=False), scratch)).select("id", F.col("root").alias("label"))


def _coin(node: Column, round_: int, seed: int) -> Column:
    return F.pmod(F.xxhash64(node, F.lit(round_), F.lit(seed)), F.lit(2)) == 0


def _label_propagation(links: DataFrame, leaves: DataFrame, scratch: Scratch, seed: int) -> tuple[DataFrame, bool]:
    """Each node takes its neighbours' most frequent label, ties to the smallest; half of them per round.

    Leaves have their host's label, hence vote for it.
    """
    labels = scratch.save(links.select(F.col("u").alias("id")).distinct().withColumn("label", F.col("id")), "labels")
    own = leaves.groupBy(F.col("host").alias("u")).agg(F.count("*").alias("n")).select("u", F.col("u").alias("v"), "n")
    steps = links.where("u != v").select("u", "v", F.lit(1).cast("long").alias("n"))
    steps = scratch.save(steps.unionByName(own), "steps", sort=("u",))
    for round_ in range(MAX_ROUNDS):
        heard = steps.join(labels, steps.v == labels.id).groupBy("u", "label").agg(F.sum("n").alias("votes"))
        mine = heard.join(labels.select(F.col("id").alias("u"), F.col("label").alias("_mine")), "u")
        best = mine.groupBy("u").agg(
            F.min(F.struct((-F.col("votes")).alias("votes"), "label")).alias("best"),
            F.max(F.when(F.col("label") == F.col("_mine"), F.col("votes"))).alias("own"),
        )
        moved = labels.join(best, labels.id == best.u, "left")
        better = F.coalesce("own", F.lit(0)) < -F.col("best.votes")
        takes = _coin(F.col("id"), round_, seed) & better
        moved = moved.select(
            "id", F.when(takes, F.col("best.label")).otherwise(F.col("label")).alias("label"),
            F.coalesce(better, F.lit(False)).alias("_restless"),
        )
        moved, seen = scratch.measured(moved, "labels", restless=F.count_if("_restless"))
        labels = moved.drop("_restless")
        scratch.forget("labels", keep=1)
        if not seen["restless"]:
            return labels, True
    return labels, False


def _strengths(links: DataFrame) -> DataFrame:
    return links.groupBy(F.col("u").alias("id")).agg(F.sum("w").alias("k"))


def modularity_of(links: DataFrame, labels: DataFrame, total: float, resolution: float = 1.0) -> float:
    """Modularity of a labelling of a weighted link list read from both ends."""
    a = labels.select(F.col("id").alias("u"), F.col("label").alias("_a"))
    b = labels.select(F.col("id").alias("v"), F.col("label").alias("_b"))
    inner = links.join(a, "u").join(b, "v").where("_a = _b").agg(F.sum("w").alias("x")).withColumn("part", F.lit("in"))
    spread = _strengths(links).join(labels, "id").groupBy("label").agg(F.sum("k").alias("k"))
    squares = spread.agg(F.sum(F.col("k") * F.col("k")).alias("x")).withColumn("part", F.lit("out"))
    parts = {r["part"]: r["x"] or 0.0 for r in inner.unionByName(squares).collect()}
    inside, expected = parts["in"], parts["out"]
    return inside / total - resolution * expected / (total * total)


def _reached(contracted: DataFrame, total: float, resolution: float) -> float:
    """Modularity of a labelling, read off the links of its communities."""
    spread = _strengths(contracted).agg(F.sum(F.col("k") * F.col("k")).alias("out"))
    inside = contracted.where("u = v").agg(F.sum("w").alias("in"))
    parts = inside.crossJoin(spread).first()
    return (parts["in"] or 0.0) / total - resolution * (parts["out"] or 0.0) / (total * total)


def modularity(edges: DataFrame, membership: DataFrame, resolution: float = 1.0) -> float:
    """Modularity of (node, community) over an edge list."""
    single = undirected(edges)
    pairs = single.select(F.col("src").alias("u"), F.col("dst").alias("v")).where("u != v")
    links = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).withColumn("w", F.lit(1.0))
    loops = single.where("src = dst").select(F.col("src").alias("u"), F.col("dst").alias("v"), F.lit(2.0).alias("w"))
    links = links.unionByName(loops)
    labels = membership.select(F.col("node").alias("id"), F.col("community").alias("label"))
    return modularity_of(links, labels, links.count() + loops.count(), resolution)


def _louvain(links: DataFrame, scratch: Scratch, resolution: float, seed: int) -> tuple[DataFrame, bool]:
    total = links.agg(F.sum("w").alias("w")).first()["w"] or 1.0
    membership = scratch.save(links.select(F.col("u").alias("id")).distinct().withColumn("label", F.col("id")), "member")
    best = _reached(links, total, resolution)
    level_links, settled = links, True
    for level in range(MAX_LEVELS):
        labels, quiet = _local_moves(level_links, scratch, total, resolution, seed + level)
        level_links = scratch.save(_contracted(level_links, labels), "contracted")
        gained = _reached(level_links, total, resolution)
        if gained < best + SMALLEST_GAIN:
            return membership, settled
        best, settled = gained, settled and quiet
        onward = labels.select(F.col("id").alias("label"), F.col("label").alias("_to"))
        membership = scratch.save(
            membership.join(onward, "label").select("id", F.col("_to").alias("label")), "member"
        )
    return membership, False


def _contracted(links: DataFrame, labels: DataFrame) -> DataFrame:
    a = labels.select(F.col("id").alias("u"), F.col("label").alias("_a"))
    b = labels.select(F.col("id").alias("v"), F.col("label").alias("_b"))
    return links.join(a, "u").join(b, "v").groupBy(F.col("_a").alias("u"), F.col("_b").alias("v")).agg(
        F.sum("w").alias("w")
    )


def _local_moves(
    links: DataFrame, scratch: Scratch, total: float, resolution: float, seed: int
) -> tuple[DataFrame, bool]:
    """Nodes change to the neighbouring community with the largest gain, about half of them per round."""
    strength = scratch.save(_strengths(links), "strength")
    labels = scratch.save(strength.select("id", F.col("id").alias("label")), "labels")
    for round_ in range(MAX_MOVES):
        held = labels.join(strength, "id")
        weight = held.groupBy("label").agg(F.sum("k").alias("tot"), F.count("*").alias("members"))
        a = labels.select(F.col("id").alias("v"), "label")
        toward = links.where("u != v").join(a, "v").groupBy("u", "label").agg(F.sum("w").alias("w"))
        home = held.join(weight, "label").select(
            F.col("id").alias("u"), F.col("label").alias("_home"), "k", F.col("tot").alias("_home_tot"),
            F.col("members").alias("_alone"),
        )
        options = toward.join(weight, "label").join(home, "u")
        here = F.col("label") == F.col("_home")
        others = F.when(here, F.col("tot") - F.col("k")).otherwise(F.col("tot"))
        gain = F.col("w") - resolution * F.col("k") * others / total
        options = options.withColumn("gain", gain)
        # Two lone nodes would only swap places: the larger id joins the smaller.
        swap = (F.col("_alone") == 1) & (F.col("members") == 1) & (F.col("label") > F.col("_home"))
        staying = -resolution * F.first("k") * (F.first("_home_tot") - F.first("k")) / total
        best_move = options.where(here | ~swap).groupBy("u").agg(
            F.min(F.struct((-F.col("gain")).alias("g"), "label")).alias("best"),
            F.coalesce(F.max(F.when(here, F.col("gain"))), staying).alias("stay"),
        )
        moved = labels.join(best_move, labels.id == best_move.u, "left")
        better = (-F.col("best.g") > F.col("stay") + 1e-12) & (F.col("best.label") != F.col("label"))
        takes = F.coalesce(better & _coin(F.col("id"), round_, seed), F.lit(False))
        moved = moved.select(
            "id", F.when(takes, F.col("best.label")).otherwise(F.col("label")).alias("label"),
            F.coalesce(better, F.lit(False)).alias("_better"),
        )
        moved, seen = scratch.measured(moved, "labels", better=F.count_if("_better"))
        labels = moved.drop("_better")
        if seen["better"] <= RESTLESS * seen["n"]:
            return labels, True
    return labels, False


def _agglomerate(links: DataFrame, scratch: Scratch, resolution: float, seed: int) -> tuple[DataFrame, bool]:
    """Merge communities with the pair gain that raises modularity most, many pairs per round.

    Every community names its best partner. The weaker of two that chose each other joins the other, as does every
    weaker community that would still gain if all that chose its partner joined it; of the others some join a partner
    that receives this round. The best labelling seen is kept.
    """
    total = links.agg(F.sum("w").alias("w")).first()["w"] or 1.0
    membership = scratch.save(links.select(F.col("u").alias("id")).distinct().withColumn("label", F.col("id")), "member")
    best, kept, steps = None, 0, []
    current, inside = links, links.where("u = v").agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("w")).first()["w"]
    for round_ in range(MAX_ROUNDS + 1):
        strength, seen = scratch.measured(_strengths(current), "strength", squares=F.sum(F.col("k") * F.col("k")))
        reached = inside / total - resolution * (seen["squares"] or 0.0) / (total * total)
        if best is None or reached > best:
            best, kept = reached, len(steps)
        if round_ == MAX_ROUNDS:
            break
        ku = strength.select(F.col("id").alias("u"), F.col("k").alias("_ku"))
        kv = strength.select(F.col("id").alias("v"), F.col("k").alias("_kv"))
        pairs = current.where("u != v").join(ku, "u").join(kv, "v")
        gain = 2 * (F.col("w") / total - resolution * F.col("_ku") * F.col("_kv") / (total * total))
        pairs = pairs.withColumn("gain", gain).where("gain > 0")
        choice = pairs.groupBy("u").agg(
            F.min(F.struct((-F.col("gain")).alias("g"), F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"),
                           "v", "w", "_ku", "_kv")).alias("c")
        ).select("u", "c.v", "c.w", "c._ku", "c._kv")
        choice, seen = scratch.measured(choice, "choice")
        if not seen["n"]:
            return _followed(membership, steps[:kept], scratch), True
        weaker = F.struct("_ku", -F.col("u")) < F.struct("_kv", -F.col("v"))
        asking = choice.groupBy("v").agg(F.sum(F.when(weaker, F.col("_ku"))).alias("_asking"))
        back = choice.select(F.col("u").alias("v"), F.col("v").alias("_back"))
        judged = choice.join(back, "v", "left").join(asking, "v").withColumn("_mutual", F.coalesce(F.col("_back") == F.col("u"), F.lit(False)))
        fits = F.col("w") * total > resolution * F.col("_ku") * (F.col("_kv") + F.col("_asking") - F.col("_ku"))
        sends = ~_coin(F.col("u"), round_, seed) & _coin(F.col("v"), round_, seed)
        goes = F.when(F.col("_mutual"), weaker).otherwise((weaker & fits) | sends)
        chosen = scratch.save(judged.where(goes).select("u", "v"), "chosen")
        # A receiver of a joining community must not leave itself in the same round.
        leaving = chosen.select(F.col("u").alias("v"))
        chosen, seen = scratch.measured(chosen.join(leaving, "v", "left_anti").select("u", "v"), "merge")
        if not seen["n"]:
            continue
        labels = strength.select("id").join(chosen, strength.id == chosen.u, "left").select(
            "id", F.coalesce("v", "id").alias("label")
        )
        labels = scratch.save(labels, "labels")
        steps.append(labels)
        current, seen = scratch.measured(
            _contracted(current, labels), "contracted", inside=F.coalesce(F.sum(F.when(F.col("u") == F.col("v"), F.col("w"))), F.lit(0.0)))
        inside = seen["inside"]
    return _followed(membership, steps[:kept], scratch), False


def _followed(membership: DataFrame, steps: list[DataFrame], scratch: Scratch) -> DataFrame:
    """Where merges in turn take each node. The last are the smallest and are put together first."""
    to = None
    for labels in (*reversed(steps), membership):
        if to is None:
            to = labels
            continue
        onward = to.select(F.col("id").alias("label"), F.col("label").alias("_to"))
        to = scratch.save(labels.join(onward, "label").select("id", F.col("_to").alias("label")), "member")
    return to


def summary(membership: DataFrame, degrees: DataFrame, triples: DataFrame) -> DataFrame:
    """Size and label of every community; the best connected member names it."""
    joined = membership.join(degrees.select("node", "degree"), "node")
    found = joined.groupBy("community").agg(
        F.count("*").alias("size"), F.min("node").alias("first"),
        F.min_by("node", F.struct(-F.col("degree"), "node")).alias("hub"),
    )
    return with_label(found, triples, "hub")


def membership_triples(membership: DataFrame, base_iri: str) -> DataFrame:
    """Membership as inferred triples."""
    empty = F.lit(None).cast("string")
    return membership.select(
        F.col("node").alias("subject"), F.lit(IN_COMMUNITY).alias("predicate"),
        F.concat(F.lit(f"{base_iri}community/"), F.col("community").cast("string")).alias("object"),
        F.lit(IRI).alias("object_type"), empty.alias("datatype"), empty.alias("lang"),
        F.lit(True).alias("inferred"), empty.alias("source_table"),
    ).select(*TRIPLE_COLUMNS)


def replace_membership(inferred: DataFrame, membership: DataFrame, base_iri: str) -> DataFrame:
    return inferred.where(F.col("predicate") != IN_COMMUNITY).unionByName(membership_triples(membership, base_iri))
