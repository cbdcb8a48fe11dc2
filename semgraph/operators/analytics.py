"""Measures of the entity graph: degrees, ranks, centralities, clustering, health."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semgraph.functions.scratch import FEW as BROADCAST_ROWS
from semgraph.functions.scratch import Scratch
from semgraph.functions.terms import IN_COMMUNITY, LITERAL, RDF_TYPE
from semgraph.operators.components import rooted
from semgraph.operators.graph import FEW, with_label
from semgraph.operators.nodes import Numbered, edge_nodes, hashed, numbered, positions, undirected  # noqa: F401
from semgraph.operators.quantiles import exact_quantiles

# PageRank settings, histogram width.
DAMPING, TOLERANCE, MAX_ITERATIONS = 0.85, 1e-6, 200
BINS = 20


def entity_edges(triples: DataFrame, include_inferred: bool = False, distinct: bool = True) -> DataFrame:
    """Directed (src, dst) links between entities; without ``distinct`` as often as stated, for measures that reduce them."""
    found = triples.where(
        (F.col("predicate") != RDF_TYPE) & (F.col("object_type") != LITERAL) & (F.col("predicate") != IN_COMMUNITY)
    )
    if not include_inferred:
        found = found.where(~F.col("inferred"))
    links = found.select(F.col("subject").alias("src"), F.col("object").alias("dst"))
    return links.distinct() if distinct else links


def both_ways(links: DataFrame) -> DataFrame:
    """An undirected link list read from either end, without self-links."""
    loose = links.where("u != v")
    return loose.unionByName(loose.select(F.col("v").alias("u"), F.col("u").alias("v")))


def kpis(edges: DataFrame, components: DataFrame | None = None) -> DataFrame:
    """Nodes, directed edges, components, average degree and undirected density in one row."""
    g = hashed(edges, "kpis", directed=False)
    m, directed = g.links.count(), g.stated
    if components is None:
        roots = rooted(g)
        counted = roots.agg(F.count("*").alias("nodes"), F.count_if(F.col("id") == F.col("root")).alias("components")).first()
    else:
        groups = F.count_if(F.col("node") == F.col("component"))
        counted = components.agg(F.count("*").alias("nodes"), groups.alias("components")).first()
    n = counted["nodes"]
    row = edges.sparkSession.range(1)
    return row.select(
        F.lit(n).cast("bigint").alias("nodes"), F.lit(directed).cast("bigint").alias("edges"),
        F.lit(counted["components"]).cast("bigint").alias("components"),
        F.round(F.lit(directed * 2 / max(n, 1)), 4).alias("avg_degree"),
        F.round(F.lit(2.0 * m / (n * (n - 1)) if n > 1 else 0.0), 6).alias("density"),
    )


def degree(edges: DataFrame) -> DataFrame:
    """(node, degree, centrality) of the undirected graph; a self-link counts twice."""
    g = hashed(edges, "degree", directed=False)
    counted, seen = g.scratch.measured(_ends(g.links).groupBy("id").agg(F.count("*").alias("degree")), "degrees")
    return g.named(counted).withColumn("centrality", F.col("degree") / max(seen["n"] - 1, 1))


def _ends(links: DataFrame) -> DataFrame:
    return links.select(F.explode(F.array("u", "v")).alias("id"))


def pagerank(
    edges: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE, max_iterations: int = MAX_ITERATIONS
) -> DataFrame:
    """(node, pagerank); rank of nodes without links out is spread over all nodes. All errors sum to ``tolerance`` at most.

    Spreading that rank evenly only scales the ranks found without it, so these are found and divided by their sum.
    Each node holds a residual it has not passed on yet. In each round residuals above a threshold become rank and are
    pushed along the links, weighted once and kept by their start; the others wait. What all residuals could still add
    bounds the error, and the threshold is the largest that keeps it within ``tolerance``. A graph without cycles is
    done after as many rounds as its longest path has links.
    """
    g = hashed(edges, "pagerank")
    return g.named(ranks(g, damping, tolerance, max_iterations))


def ranks(
    g: Numbered, damping: float = DAMPING, tolerance: float = TOLERANCE, max_iterations: int = MAX_ITERATIONS
) -> DataFrame:
    """(id, pagerank) of a numbered graph."""
    n = g.nodes.count()
    if n == 0:
        return g.nodes.select("id", F.lit(0.0).alias("pagerank"))
    out = g.links.groupBy("u").agg((F.lit(damping) / F.count("*")).alias("share"))
    links = g.links.join(g.hashable(out), "u").repartition("u").persist()
    try:
        return _pushed(g, links, n, damping, tolerance, max_iterations)
    finally:
        links.unpersist()


def _pushed(g: Numbered, links: DataFrame, n: int, damping: float, tolerance: float, max_iterations: int) -> DataFrame:
    r, ranked, held = F.col("r"), [], 0.0
    residual = g.nodes.select("id", F.lit((1.0 - damping) / n).alias("r"))
    for _ in range(max_iterations):
        # Ranks are off by 2 * (all residuals) / (1 - damping) / (their sum) at most; the sum only grows.
        least = tolerance * (1.0 - damping) * max(held, 1.0 - damping) / (2.0 * n)
        residual, seen = g.scratch.measured(residual, "residual", moving=F.coalesce(F.sum(F.when(r > least, r)), F.lit(0.0)))
        ranked.append(residual.where(r > least))
        if not seen["moving"]:
            break
        held += seen["moving"]
        sent = ranked[-1].join(links, F.col("id") == F.col("u")).select(F.col("v").alias("id"), (r * F.col("share")).alias("r"))
        residual = residual.where(r <= least).unionByName(sent).groupBy("id").agg(F.sum("r").alias("r"))
    else:
        raise RuntimeError(f"PageRank did not settle in {max_iterations} rounds")
    rank = reduce(DataFrame.unionByName, ranked).groupBy("id").agg((F.sum("r") / held).alias("pagerank"))
    return g.scratch.save(rank, "ranks")


def _pivots(nodes: DataFrame, count: int | None, seed: int) -> DataFrame:
    starts = nodes.select(F.col("id").alias("pivot"), "node")
    if count is None:
        return starts.drop("node")
    return starts.orderBy(F.xxhash64(F.lit(seed), "node"), "node").limit(count).drop("node")


def _levels(g: Numbered, pivots: DataFrame) -> list[DataFrame]:
    """Breadth-first levels from every pivot: (pivot, id, sigma) with the number of shortest ways in."""
    steps = g.scratch.save(both_ways(g.links), "steps", sort=("u",))
    level = g.scratch.save(pivots.select("pivot", F.col("pivot").alias("id"), F.lit(1.0).alias("sigma")), "level")
    levels = [level]
    while True:
        reached = level.join(steps, level.id == steps.u).groupBy("pivot", F.col("v").alias("id")).agg(
            F.sum("sigma").alias("sigma")
        )
        # A neighbour of level d lies in d - 1, d or d + 1, so older levels need no look.
        for seen in levels[-2:]:
            reached = reached.join(seen.select("pivot", "id"), ["pivot", "id"], "left_anti")
        level, found = g.scratch.measured(reached, "level")
        if not found["n"]:
            return levels
        levels.append(level)


def path_centralities(edges: DataFrame, pivots: int | None, seed: int = 42) -> DataFrame:
    """(node, betweenness, closeness, estimated) of the undirected graph.

    ``pivots``: None reads ways from every node, whose number is squared; a number estimates from so many nodes.

    The forward pass counts shortest ways level by level, the backward pass hands dependencies back one
    level at a time; every step is a join on (pivot, node).
    """
    g = numbered(edges, "paths", directed=False)
    n = g.nodes.count()
    sampled = pivots is not None and pivots < n
    starts = _pivots(g.nodes, pivots if sampled else None, seed)
    levels = _levels(g, starts)
    steps = both_ways(g.links)
    used = min(pivots, n) if sampled else n
    distances = None
    for depth, level in enumerate(levels):
        part = level.select("pivot", "id", F.lit(depth).alias("distance"))
        distances = part if distances is None else distances.unionByName(part)
    near = distances.groupBy("id").agg(F.count("*").alias("reached"), F.sum("distance").alias("total"))
    if sampled:
        close = F.coalesce(F.try_divide("reached", "total"), F.lit(0.0))
    else:
        others = F.col("reached") - 1
        close = F.coalesce(F.try_divide(others, "total") * F.try_divide(others, F.lit(n - 1)), F.lit(0.0))
    closeness = near.select("id", close.alias("closeness"))

    depends = g.scratch.save(levels[-1].withColumn("delta", F.lit(0.0)), "delta")
    parts = [depends]
    for level in reversed(levels[:-1]):
        below = depends.select("pivot", "id", ((1.0 + F.col("delta")) / F.col("sigma")).alias("share"))
        handed = below.join(steps, below.id == steps.u).groupBy("pivot", F.col("v").alias("id")).agg(
            F.sum("share").alias("share")
        )
        depends = level.join(handed, ["pivot", "id"], "left").select(
            "pivot", "id", "sigma", (F.col("sigma") * F.coalesce("share", F.lit(0.0))).alias("delta")
        )
        depends = g.scratch.save(depends, "delta")
        parts.append(depends)
    summed = None
    for part in parts[:-1] or parts:
        summed = part if summed is None else summed.unionByName(part)
    scale = (1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0) * (n / used if sampled else 1.0)
    between = summed.where("pivot != id").groupBy("id").agg((F.sum("delta") * scale).alias("betweenness"))
    out = g.nodes.join(between, "id", "left").join(closeness, "id", "left")
    zero = F.lit(0.0)
    return out.select(
        "node", F.coalesce("betweenness", zero).alias("betweenness"), F.coalesce("closeness", zero).alias("closeness"),
        F.lit(sampled).alias("estimated"),
    )


def clustering(edges: DataFrame) -> DataFrame:
    """(node, triangles, clustering) of the undirected graph, self-links ignored.

    Links point from the rarer to the more frequent end, so a hub keeps few outgoing links (at most the
    square root of twice the number of links). Two links out of one node make a wedge; it is a triangle if its ends are
    linked. Each node has a mark of where its own links lead, 64 bits; wedges that a mark shows to be open are never
    moved, of the others one join tells. Each triangle is found once, at its rarest node, and stays a row: no neighbour
    list is ever made. What a step has used up is deleted.
    """
    g = hashed(edges, "clustering", directed=False)
    single = g.links.where("u != v")
    degrees = g.scratch.save(_ends(single).groupBy("id").agg(F.count("*").alias("degree")), "degrees")
    # places in the order of degrees tell the rarer end
    place = positions(degrees.select("id", F.struct("degree", "id").alias("_by")).orderBy("_by"), "id", "place", g.scratch)
    place = g.scratch.save(place, "place")
    g.scratch.forget("placed")
    left = g.hashable(place.select(F.col("id").alias("u"), F.col("place").alias("_a")))
    right = g.hashable(place.select(F.col("id").alias("v"), F.col("place").alias("_b")))
    half = g.scratch.save(single.join(left, "u").select("_a", "v"), "half", hint=False)
    g.scratch.forget("links")
    turned = half.join(right, "v").select(F.least("_a", "_b").alias("at"), F.greatest("_a", "_b").alias("to"))
    turned = g.scratch.save(turned, "turned", hint=False)
    g.scratch.forget("half")

    def bit(place: str) -> Column:
        return F.expr(f"shiftleft(1L, cast(pmod(xxhash64({place}), 64) AS int))")

    marks = g.hashable(turned.groupBy(F.col("at").alias("u")).agg(F.bit_or(bit("to")).alias("_mark")))
    marked = g.scratch.save(turned.select("at", F.col("to").alias("u")).join(marks, "u"), "marked", hint=False)
    wedges = marked.join(turned.select("at", F.col("to").alias("v")), "at").where("u < v")
    wedges = wedges.where(F.col("_mark").bitwiseAND(bit("v")) != 0).select("at", "u", "v")
    closing = turned.select(F.col("at").alias("u"), F.col("to").alias("v"))
    triangles = wedges.join(closing.hint("shuffle_hash"), ["u", "v"])
    credit = triangles.select(F.explode(F.array("at", "u", "v")).alias("place")).groupBy("place").agg(F.count("*").alias("triangles"))
    credit = g.scratch.save(place.join(credit, "place").select("id", "triangles"), "credit")
    g.scratch.forget("turned", "marked", "place")
    found = g.nodes.join(degrees, "id", "left").join(credit, "id", "left")
    triangles = F.coalesce("triangles", F.lit(0))
    ratio = F.try_divide(2.0 * triangles, F.col("degree") * (F.col("degree") - 1))
    return found.select("node", triangles.alias("triangles"), F.coalesce(ratio, F.lit(0.0)).alias("clustering"))


def centralities(edges: DataFrame, pivots: int | None) -> DataFrame:
    """All five measures per node; ``pivots`` as for the path measures, of which ``estimated`` tells."""
    degrees = degree(edges)
    out = degrees.select("node", F.col("centrality").alias("degree"))
    for part in (pagerank(edges), path_centralities(edges, pivots), clustering(edges).select("node", "clustering")):
        out = out.join(part, "node", "left")
    return out


def histograms(measured: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Per metric: 20 equal bins, minimum, maximum, median and the 90th percentile by nearest rank."""
    scratch = Scratch(measured.sparkSession, "histograms", BROADCAST_ROWS)
    cells = [c for m in metrics for c in (F.lit(m), F.col(m).cast("double"))]
    long = scratch.save(measured.select(F.stack(F.lit(len(metrics)), *cells).alias("metric", "value")), "long")
    bounds = long.groupBy("metric").agg(
        F.min("value").alias("min"), F.max("value").alias("max"), F.count("value").alias("_n")
    )
    bounds = scratch.save(bounds, "bounds")
    n = max((r["_n"] for r in bounds.select("_n").collect()), default=0)
    p90 = min(n - 1, round(0.9 * (n - 1))) / (n - 1) if n > 1 else 0.0
    at = exact_quantiles(long, "metric", "value", (0.5, p90)).groupBy("metric").agg(
        F.max(F.when(F.col("p") == 0.5, F.col("quantile"))).alias("median"),
        F.max(F.when(F.col("p") == p90, F.col("quantile"))).alias("p90"),
    )
    width = (F.col("max") - F.col("min")) / BINS
    # One row per metric on the bounds side.
    placed = long.join(F.broadcast(bounds), "metric").withColumn(
        "bin",
        F.when(width > 0, F.least(F.floor((F.col("value") - F.col("min")) / width), F.lit(BINS - 1))).otherwise(0),
    )
    counted = placed.groupBy("metric", "bin").agg(F.count("*").alias("n"))
    by_bin = [F.coalesce(F.sum(F.when(F.col("bin") == b, F.col("n"))), F.lit(0)) for b in range(BINS)]
    bins = counted.groupBy("metric").agg(F.array(*by_bin).alias("bins"))
    return bins.join(bounds.drop("_n"), "metric").join(at, "metric")


def best_ranked(edges: DataFrame, count: int) -> DataFrame:
    """(node, degree, pagerank) of the ``count`` nodes of highest rank and of all that tie with the last of them.

    Names and degrees, as of ``degree``, are looked up for these nodes only.
    """
    g = hashed(edges, "best")
    found = ranks(g)
    least = found.select("pagerank").orderBy(F.desc("pagerank")).limit(count).agg(F.min("pagerank").alias("least")).first()["least"]
    best = g.scratch.save(found.where(F.col("pagerank") >= F.lit(least).cast("double")), "best")
    ids = best.select("id")
    near = [g.links.join(ids, g.links[end] == ids.id, "left_semi") for end in ("u", "v")]
    near = near[0].unionByName(near[1]).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    degrees = _ends(near).groupBy("id").agg(F.count("*").alias("degree"))
    share = (F.col("degree") / max(g.nodes.count() - 1, 1)).alias("degree")
    return g.named(best.join(degrees, "id").select("id", share, "pagerank"))


def top_entities(measured: DataFrame, triples: DataFrame, count: int = 20) -> DataFrame:
    """Best ranked nodes with labels and all measures to six digits."""
    best = measured.orderBy(F.desc("pagerank"), "node").limit(count)
    best = Scratch(measured.sparkSession, "top").save(best, "best")  # read twice, found once
    named = with_label(best, triples, "node", few=count <= FEW)
    return named.select(
        "node", "label", *[F.round(F.coalesce(c, F.lit(0.0)), 6).alias(c) for c in measured.columns if c != "node"]
    )


def health(triples: DataFrame) -> DataFrame:
    """Per class: instances, kinds of outgoing relations, and a flag where the model looks thin.

    Relations are first reduced to distinct (subject, predicate), so a hub adds one row per predicate.
    """
    typed = triples.where(F.col("predicate") == RDF_TYPE).select("subject", F.col("object").alias("type")).distinct()
    links = triples.where(
        (F.col("predicate") != RDF_TYPE) & (F.col("object_type") != LITERAL) & (F.col("predicate") != IN_COMMUNITY)
    ).select("subject", "predicate").distinct()
    kinds = typed.join(links, "subject").select("type", "predicate").distinct().groupBy("type").agg(
        F.count("*").alias("relations")
    )
    sizes = typed.groupBy("type").agg(F.count("*").alias("instances"))
    relations = F.coalesce("relations", F.lit(0))
    flag = F.when(relations == 0, "flat").when((relations == 1) & (F.col("instances") > 20), "time-series")
    advice = F.when(flag == "flat", "No outgoing relations: add some or leave the class out.").when(
        flag == "time-series", "One relation and many instances: looks like measurements, consider aggregating."
    )
    return sizes.join(kinds, "type", "left").select(
        "type", "instances", relations.alias("relation_predicates"), flag.alias("flag"), advice.alias("advice")
    )
