"""Graph measures over the sample graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from semgraph.checks.registry import BASE, LINK_NAMES, NS, RDF_TYPE, query, shop_graph, tables, with_facts
from semgraph.functions.scratch import Scratch
from semgraph.operators import analytics, communities, triples
from semgraph.operators.components import connected_components
from semgraph.operators.nodes import hashed, undirected
from semgraph.plans import shop
from semgraph.plans.mapping import ClassMap, Mapping, Relation

_names = ("inRegion", "inNation", "placedBy")


def _edges(spark, folder, *names: str):
    """Links as they are stated; the measures count each once."""
    return analytics.entity_edges(shop_graph(spark, folder, *(names or _names)), distinct=False)


_E = "e AS (SELECT DISTINCT subject AS src, object AS dst FROM t)"
_U = f"{_E}, u AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM e), x AS (SELECT a AS node FROM u UNION ALL SELECT b FROM u)"


@query("entity_edges", with_facts(f", {_E} SELECT src, dst FROM e", "inRegion", "inNation", "placedBy", "contains", "suppliedBy", "performedBy"))
def entity_edges(spark, folder):
    return analytics.entity_edges(shop_graph(spark, folder, *LINK_NAMES))


@query("degree", with_facts(f""", {_U}
SELECT node, count(*) AS degree, count(*) / ((SELECT count(DISTINCT node) FROM x) - 1) AS centrality FROM x GROUP BY node""", *LINK_NAMES))
def degree(spark, folder):
    return analytics.degree(_edges(spark, folder, *LINK_NAMES))


_region_of = f"""
, c AS (
 SELECT '{BASE}Region/' || r_regionkey AS node, r_regionkey AS k FROM region
 UNION ALL SELECT '{BASE}Nation/' || n_nationkey, n_regionkey FROM nation
 UNION ALL SELECT '{BASE}Customer/' || c_custkey, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey
 UNION ALL SELECT '{BASE}Supplier/' || s_suppkey, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey
 UNION ALL SELECT '{BASE}Order/' || o_orderkey, n_regionkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
"""


@query("components_by_region", with_facts(_region_of + ", m AS (SELECT k, min(node) AS component FROM c GROUP BY k) SELECT node, component FROM c JOIN m USING (k)", "inRegion"))
def components_by_region(spark, folder):
    """Along three relations each region is one component."""
    return connected_components(_edges(spark, folder))


@query("components", with_facts(f", {_U} SELECT DISTINCT node, (SELECT min(node) FROM x) AS component FROM x", *LINK_NAMES))
def components(spark, folder):
    """Along all relations everything hangs together."""
    return connected_components(_edges(spark, folder, *LINK_NAMES))


@query("graph_kpis", with_facts(f""", {_U}, n AS (SELECT count(DISTINCT node) AS n FROM x), m AS (SELECT count(*) AS m FROM e), s AS (SELECT count(*) AS s FROM u)
SELECT n AS nodes, m AS edges, 1 AS components, round(2 * m / n, 4) AS avg_degree,
 round(2.0 * s / (CAST(n AS DOUBLE) * (n - 1)), 6) AS density FROM n, m, s""", *LINK_NAMES))
def graph_kpis(spark, folder):
    return analytics.kpis(_edges(spark, folder, *LINK_NAMES))


@query("pagerank")
def pagerank(spark, folder):
    return analytics.pagerank(_edges(spark, folder, *LINK_NAMES))


@query("pagerank_balance", with_facts(f", {_E} SELECT count(DISTINCT node) AS nodes, CAST(1 AS DOUBLE) AS total, true AS settled "
                                       "FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e)", *LINK_NAMES))
def pagerank_balance(spark, folder):
    """Ranks sum to one, and one more step of the definition leaves every rank where it is."""
    g = hashed(_edges(spark, folder, *LINK_NAMES), "balance")
    ranks = analytics.ranks(g, tolerance=1e-8)
    out = g.links.groupBy("u").agg(F.count("*").alias("out"))
    n = F.lit(float(g.nodes.count()))
    held = g.scratch.save(ranks.join(out, ranks.id == out.u, "left").select("id", "pagerank", "out"), "held")
    loose = held.where("out IS NULL").agg(F.coalesce(F.sum("pagerank"), F.lit(0.0)).alias("loose")).first()["loose"]
    shares = held.where("out IS NOT NULL").select(F.col("id").alias("u"), (F.col("pagerank") / F.col("out")).alias("s"))
    sent = g.links.join(shares, "u").groupBy("v").agg(F.sum("s").alias("s"))
    again = held.join(sent, held.id == sent.v, "left")
    step = 0.85 * (F.coalesce("s", F.lit(0.0)) + F.lit(loose) / n) + 0.15 / n
    return again.agg(
        F.count("*").alias("nodes"), F.round(F.sum("pagerank"), 6).alias("total"),
        (F.max(F.abs(step - F.col("pagerank"))) < 1e-6).alias("settled"),
    )


@query("path_centralities_stars", f"""
WITH s AS (SELECT n_regionkey AS k, count(*) AS c FROM nation GROUP BY 1), n AS (SELECT sum(c) + count(*) AS n FROM s)
SELECT '{BASE}Region/' || k AS node, round(c * (c - 1) / ((n - 1) * (n - 2)), 9) AS betweenness, round(c / (n - 1), 9) AS closeness, false AS estimated FROM s, n
UNION ALL SELECT '{BASE}Nation/' || n_nationkey, 0.0, round(c / (2 * c - 1) * c / (n - 1), 9), false FROM nation JOIN s ON k = n_regionkey, n""")
def path_centralities_stars(spark, folder):
    """Regions and their nations are stars, where ways are counted by hand."""
    found = analytics.path_centralities(_edges(spark, folder, "inRegion"), None)
    return found.select("node", F.round("betweenness", 9).alias("betweenness"), F.round("closeness", 9).alias("closeness"), "estimated")


@query("path_centralities")
def path_centralities(spark, folder):
    return analytics.path_centralities(_edges(spark, folder, "inRegion", "inNation"), pivots=64)


_LINES = Mapping(
    BASE,
    (ClassMap(shop.ORDER, "orders", ("o_orderkey",)), ClassMap(shop.PART, "part", ("p_partkey",)),
     ClassMap(shop.SUPPLIER, "supplier", ("s_suppkey",))),
    (
        Relation(NS + "contains", shop.ORDER, shop.PART, ("l_partkey",), ("l_orderkey",), table="lineitem"),
        Relation(NS + "suppliedBy", shop.PART, shop.SUPPLIER, ("l_suppkey",), ("l_partkey",), table="lineitem"),
        Relation(NS + "filledBy", shop.ORDER, shop.SUPPLIER, ("l_suppkey",), ("l_orderkey",), table="lineitem"),
    ),
)


def _line_edges(spark, folder):
    links = _LINES.restricted({NS + "contains", NS + "suppliedBy", NS + "filledBy"})
    return analytics.entity_edges(triples.build(spark, _LINES, tables(spark, folder), maps=links), distinct=False)


@query("clustering", f"""
WITH op AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem),
ps AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem),
os AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS s FROM lineitem),
tri AS (SELECT o, p, s FROM op JOIN os USING (o) JOIN ps USING (p, s)),
x AS (SELECT '{BASE}Order/' || o AS a, '{BASE}Part/' || p AS b FROM op UNION ALL SELECT '{BASE}Part/' || p, '{BASE}Supplier/' || s FROM ps
      UNION ALL SELECT '{BASE}Order/' || o, '{BASE}Supplier/' || s FROM os),
d AS (SELECT node, count(*) AS degree FROM (SELECT a AS node FROM x UNION ALL SELECT b FROM x) GROUP BY 1),
c AS (SELECT node, count(*) AS triangles FROM (SELECT '{BASE}Order/' || o AS node FROM tri UNION ALL SELECT '{BASE}Part/' || p FROM tri
      UNION ALL SELECT '{BASE}Supplier/' || s FROM tri) GROUP BY 1)
SELECT node, coalesce(triangles, 0) AS triangles,
 coalesce(round(2.0 * triangles / nullif(degree * (degree - 1), 0), 9), 0.0) AS clustering FROM d LEFT JOIN c USING (node)""")
def clustering(spark, folder):
    return analytics.clustering(_line_edges(spark, folder)).withColumn("clustering", F.round("clustering", 9))


@query("degree_histogram", with_facts(f""", {_U}, d AS (SELECT node, CAST(count(*) AS DOUBLE) AS v FROM x GROUP BY node),
b AS (SELECT min(v) AS lo, max(v) AS hi, count(*) AS n, quantile_cont(v, 0.5) AS median FROM d)
SELECT r.bin AS bin, (SELECT count(*) FROM d WHERE least(floor((v - lo) / ((hi - lo) / 20)), 19) = r.bin) AS n, lo AS min, hi AS max, median,
 (SELECT v FROM d ORDER BY v LIMIT 1 OFFSET CAST(round_even(0.9 * ((SELECT count(*) FROM d) - 1), 0) AS BIGINT)) AS p90
FROM b, range(20) r(bin)""", *LINK_NAMES))
def degree_histogram(spark, folder):
    found = analytics.histograms(analytics.degree(_edges(spark, folder, *LINK_NAMES)), ["degree"])
    rows = found.select(F.posexplode("bins").alias("bin", "n"), "min", "max", "median", F.round("p90", 6).alias("p90"))
    return rows.withColumn("bin", F.col("bin").cast("bigint"))


@query("top_entities")
def top_entities(spark, folder):
    found = shop_graph(spark, folder, "name")
    measured = analytics.best_ranked(_edges(spark, folder, *LINK_NAMES), 20)
    return analytics.top_entities(measured, found, 20)


@query("graph_health", with_facts(f"""
, y AS (SELECT DISTINCT subject, object AS type FROM t WHERE predicate = '{RDF_TYPE}'),
l AS (SELECT DISTINCT subject, predicate FROM t WHERE object_type <> 'literal' AND predicate <> '{RDF_TYPE}'),
h AS (SELECT type, count(DISTINCT y.subject) AS instances, count(DISTINCT predicate) AS relation_predicates FROM y LEFT JOIN l USING (subject) GROUP BY type)
SELECT *, CASE WHEN relation_predicates = 0 THEN 'flat' WHEN relation_predicates = 1 AND instances > 20 THEN 'time-series' END AS flag FROM h""",
    "type", "inRegion", "inNation", "placedBy", "contains", "suppliedBy", "performedBy"))
def graph_health(spark, folder):
    return analytics.health(shop_graph(spark, folder, "type", *LINK_NAMES)).drop("advice")


def _register_communities(algorithm: str) -> None:
    @query(f"communities_{algorithm}")
    def run(spark, folder):
        return communities.communities(_edges(spark, folder, "inRegion", "inNation"), algorithm)


for _algorithm in communities.ALGORITHMS:
    _register_communities(_algorithm)


@query("community_quality", with_facts(f""", {_U}
SELECT algorithm, count(DISTINCT node) AS nodes, true AS good FROM x, (VALUES ('louvain'), ('label_propagation'), ('greedy_modularity')) a(algorithm)
GROUP BY 1""", *_names))
def community_quality(spark, folder):
    """Every node is in one community, and modularity reaches what the links of this graph give."""
    edges, rows = Scratch(spark, "quality").save(undirected(_edges(spark, folder))), None  # read by all three
    graph = communities.prepared(edges)
    for algorithm, least in (("louvain", 0.5), ("label_propagation", 0.3), ("greedy_modularity", 0.4)):
        found = Scratch(spark, "quality").save(communities.communities_of(graph, algorithm), "found")
        good = communities.modularity(edges, found) >= least
        row = found.agg(F.countDistinct("node").alias("nodes")).select(F.lit(algorithm).alias("algorithm"), "nodes", F.lit(good).alias("good"))
        rows = row if rows is None else rows.unionByName(row)
    return rows


@query("community_summary")
def community_summary(spark, folder):
    edges = _edges(spark, folder, "inRegion", "inNation")
    found = shop_graph(spark, folder, "name")
    member = communities.communities(edges, "label_propagation")
    return communities.summary(member, analytics.degree(edges), found)


@query("community_triples")
def community_triples(spark, folder):
    member = communities.communities(_edges(spark, folder, "inRegion", "inNation"), "label_propagation")
    earlier = shop_graph(spark, folder).where("inferred")
    return communities.replace_membership(earlier, member, BASE).select("subject", "predicate", "object", "inferred")
