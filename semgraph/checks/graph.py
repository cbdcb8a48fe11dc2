"""Questions asked of the sample graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from semgraph.checks.registry import (
    BASE, LINK_NAMES, NS, RDF_TYPE, facts_sql, iri_sql, query, shop_graph, tables, with_facts,
)
from semgraph.operators import graph
from semgraph.plans import shop

_links = ", ".join(f"'{NS}{n}'" for n in LINK_NAMES)


@query("graph_counts", with_facts(
    "SELECT count(*) AS triples, count(*) FILTER (WHERE inferred) AS inferred, "
    "count(*) FILTER (WHERE NOT inferred) AS asserted FROM t"))
def graph_counts(spark, folder):
    return graph.counts(shop_graph(spark, folder))


@query("type_inventory", with_facts("SELECT object AS type, count(*) AS n FROM t GROUP BY 1", "type"))
def type_inventory(spark, folder):
    return graph.type_inventory(shop_graph(spark, folder, "type"))


@query("predicate_inventory", with_facts("SELECT predicate, count(*) AS n FROM t GROUP BY 1"))
def predicate_inventory(spark, folder):
    return graph.predicate_inventory(shop_graph(spark, folder))


@query("predicates_distinct", with_facts("SELECT DISTINCT predicate FROM t"))
def predicates_distinct(spark, folder):
    return graph.predicates(shop_graph(spark, folder))


@query("status_card", with_facts(f"""
SELECT 'total' AS section, '*' AS name, count(*) AS n, CAST(0 AS BIGINT) AS inferred FROM t
UNION ALL SELECT 'predicate', predicate, count(*), 0 FROM t GROUP BY predicate
UNION ALL SELECT 'type', object, count(*), 0 FROM t WHERE predicate = '{RDF_TYPE}' GROUP BY object"""))
def status_card(spark, folder):
    return graph.status(shop_graph(spark, folder))


# -- search --------------------------------------------------------------------------------------------------------

def _search_sql(text: str, match: str, field: str, *facts: str, type_class: str | None = None, limit: int = 20) -> str:
    test = {
        "contains": "contains(lower({}), '{}')", "exact": "lower({}) = '{}'",
        "starts_with": "starts_with(lower({}), '{}')", "ends_with": "ends_with(lower({}), '{}')",
    }[match]
    literal = f"(object_type = 'literal' AND {test.format('object', text)})"
    iri = test.format("subject", text)
    where = {"any": f"({literal} OR {iri})", "label": literal, "iri": iri}[field]
    typed = (
        f" AND subject IN (SELECT subject FROM t WHERE predicate = '{RDF_TYPE}' AND object = '{NS}{type_class}')"
        if type_class else ""
    )
    rank = (
        f"min(CASE WHEN lower(object) = '{text}' THEN 0 WHEN starts_with(lower(object), '{text}') THEN 1 "
        "WHEN object_type = 'literal' THEN 2 ELSE 3 END)"
    )
    return with_facts(
        f"SELECT subject, {rank} AS rank, min(length(object)) AS length FROM t WHERE {where}{typed} "
        f"GROUP BY subject ORDER BY rank, length, subject LIMIT {limit}", *facts)


def _register_search(name: str, text: str, match: str, field: str, type_class: str | None = None):
    @query(name, _search_sql(text, match, field, type_class=type_class))
    def run(spark, folder):
        cls = NS + type_class if type_class else None
        return graph.search(shop_graph(spark, folder), text, match=match, field=field, type_iri=cls, label=False)

    return run


_register_search("search_contains", "ro", "contains", "label")
_register_search("search_any", "customer", "contains", "any")
_register_search("search_exact", "building", "exact", "label")
_register_search("search_prefix", "cust", "starts_with", "label")
_register_search("search_suffix", "99", "ends_with", "any")
_register_search("search_iri", "/order/7", "contains", "iri")
_register_search("search_typed", "1", "contains", "label", "Supplier")


@query("search_labelled", f"""
WITH hits AS ({_search_sql('00001', 'contains', 'label', 'type', 'name')})
SELECT h.subject, h.rank, h.length, coalesce(n.object, regexp_extract(h.subject, '[^/]+/[^/]+$')) AS label
FROM hits h LEFT JOIN ({facts_sql('name')}) n ON n.subject = h.subject""")
def search_labelled(spark, folder):
    found = shop_graph(spark, folder, "type", "name")
    return graph.search(found, "00001", field="label")


_texts = ("building", "asia", "urgent", "1")
_values = ", ".join(f"('{t}')" for t in _texts)


@query("search_many", with_facts(f"""
, q AS (SELECT * FROM (VALUES {_values}) v(query)),
best AS (
  SELECT query, subject, min(CASE WHEN lower(object) = query THEN 0 WHEN starts_with(lower(object), query) THEN 1
    WHEN object_type = 'literal' THEN 2 ELSE 3 END) AS rank, min(length(object)) AS length
  FROM t JOIN q ON object_type = 'literal' AND contains(lower(object), query) GROUP BY query, subject)
SELECT query, subject, rank, length, position FROM (
  SELECT *, row_number() OVER (PARTITION BY query ORDER BY rank, length, subject) AS position FROM best)
WHERE position <= 20""", "name", "segment", "priority"))
def search_many(spark, folder):
    found = shop_graph(spark, folder, "name", "segment", "priority")
    return graph.search_many(found, _texts, field="label")


@query("entity_labels", with_facts("SELECT subject, min(object) AS label FROM t GROUP BY subject", "name"))
def entity_labels(spark, folder):
    return graph.labels(shop_graph(spark, folder))


@query("entity_types", with_facts(f"""
, n AS (SELECT subject, min(object) AS label FROM t WHERE predicate = '{NS}name' GROUP BY 1)
SELECT e.iri, coalesce(n.label, regexp_extract(e.iri, '[^/]+/[^/]+$')) AS label, string_agg(object, '|' ORDER BY object) AS types
FROM (SELECT DISTINCT subject AS iri FROM t WHERE predicate = '{RDF_TYPE}') e
JOIN t ON t.subject = e.iri AND t.predicate = '{RDF_TYPE}' LEFT JOIN n ON n.subject = e.iri GROUP BY ALL""", "type", "name"))
def entity_types(spark, folder):
    found = shop_graph(spark, folder, "type", "name")
    typed = found.where(F.col("predicate") == RDF_TYPE).select(F.col("subject").alias("iri"))
    out = graph.entities(found, typed)
    return out.withColumn("types", F.array_join("types", "|"))


# -- entities -------------------------------------------------------------------------------------------------------

_describe = f"""
, w AS (SELECT subject AS iri FROM t WHERE predicate = '{RDF_TYPE}' AND object IN ('{NS}Nation', '{NS}Region'))
SELECT iri, CASE WHEN object_type = 'literal' THEN 'attribute' WHEN predicate = '{RDF_TYPE}' THEN 'type' ELSE 'outgoing' END AS section,
  predicate, object AS value, datatype, lang, inferred FROM t JOIN w ON t.subject = w.iri
UNION ALL SELECT iri, 'incoming', predicate, subject, NULL, NULL, inferred FROM t JOIN w ON t.object = w.iri
WHERE object_type <> 'literal'"""


@query("describe_entities", with_facts(_describe))
def describe_entities(spark, folder):
    found = shop_graph(spark, folder)
    typed = found.where((F.col("predicate") == RDF_TYPE) & F.col("object").isin(shop.NATION, shop.REGION))
    return graph.describe(found, typed.select(F.col("subject").alias("iri")))


@query("entity_context", with_facts(f"""
, w AS (SELECT subject AS iri FROM t WHERE predicate = '{RDF_TYPE}' AND object = '{NS}Nation'),
o AS (SELECT iri, count(*) FILTER (WHERE object_type = 'literal') AS attributes,
        count(*) FILTER (WHERE object_type <> 'literal' AND predicate <> '{RDF_TYPE}') AS out_degree FROM t JOIN w ON t.subject = w.iri GROUP BY iri),
i AS (SELECT iri, count(*) AS in_degree, string_agg(DISTINCT predicate, '|' ORDER BY predicate) AS in_predicates
      FROM t JOIN w ON t.object = w.iri GROUP BY iri),
n AS (SELECT subject AS iri, object AS label FROM t WHERE predicate = '{NS}name')
SELECT o.iri, n.label, o.attributes, o.out_degree, coalesce(i.in_degree, 0) AS in_degree, coalesce(i.in_predicates, '') AS in_predicates,
  'nation' AS source_table, 'n_nationkey' AS key_columns, 'orders|population' AS attachments
FROM o LEFT JOIN i USING (iri) LEFT JOIN n USING (iri)"""))
def entity_context(spark, folder):
    found = shop_graph(spark, folder)
    typed = found.where((F.col("predicate") == RDF_TYPE) & (F.col("object") == shop.NATION))
    out = graph.context(found, typed.select(F.col("subject").alias("iri")), shop.MAPPING,
                        attachments={shop.NATION: ["population", "orders"], shop.ORDER: ["invoice"]})
    return out.select(
        "iri", "label", "attributes", "out_degree", "in_degree", F.array_join("in_predicates", "|").alias("in_predicates"),
        "source_table", F.array_join("key_columns", "|").alias("key_columns"), F.array_join("attachments", "|").alias("attachments"),
    )


@query("entity_neighbours", f"""
SELECT '{BASE}Nation/' || n_nationkey AS iri, 'outgoing' AS direction, '{NS}inRegion' AS predicate, '{BASE}Region/' || n_regionkey AS neighbour, r_name AS label
FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT '{BASE}Nation/' || c_nationkey, 'incoming', '{NS}inNation', '{BASE}Customer/' || c_custkey, c_name FROM customer
UNION ALL SELECT '{BASE}Nation/' || s_nationkey, 'incoming', '{NS}inNation', '{BASE}Supplier/' || s_suppkey, s_name FROM supplier""")
def entity_neighbours(spark, folder):
    found = shop_graph(spark, folder, layout="branches")
    typed = found.where((F.col("predicate") == RDF_TYPE) & (F.col("object") == shop.NATION))
    return graph.neighbours(found, typed.select(F.col("subject").alias("iri")))


@query("entity_neighbours_first", f"""
WITH l AS (SELECT n_regionkey AS k, '{BASE}Nation/' || n_nationkey AS neighbour, n_name AS label FROM nation)
SELECT '{BASE}Region/' || k AS iri, 'incoming' AS direction, '{NS}inRegion' AS predicate, neighbour, label FROM l
QUALIFY row_number() OVER (PARTITION BY k ORDER BY neighbour) <= 3""")
def entity_neighbours_first(spark, folder):
    """The first three nations of each region."""
    found = shop_graph(spark, folder, layout="branches")
    typed = found.where((F.col("predicate") == RDF_TYPE) & (F.col("object") == shop.REGION))
    return graph.neighbours(found, typed.select(F.col("subject").alias("iri")), limit=3)


_steps = f"""
, e AS (SELECT DISTINCT subject, predicate, object FROM t),
s AS (SELECT subject AS a, object AS b FROM e UNION SELECT object, subject FROM e),
d0 AS (SELECT DISTINCT '{BASE}Region/' || r_regionkey AS seed FROM region),
d1 AS (SELECT DISTINCT seed, b AS node FROM d0 JOIN s ON a = seed WHERE b <> seed),
d2 AS (SELECT DISTINCT seed, b AS node FROM d1 JOIN s ON a = node
       WHERE b <> seed AND NOT EXISTS (SELECT 1 FROM d1 x WHERE x.seed = d1.seed AND x.node = s.b)),
n AS (SELECT seed, seed AS node, 0 AS distance FROM d0 UNION ALL SELECT seed, node, 1 FROM d1 UNION ALL SELECT seed, node, 2 FROM d2)
"""
_near = ("inRegion", "inNation", "placedBy")


def _neighbourhood(spark, folder):
    found = shop_graph(spark, folder, *_near)
    regions = tables(spark, folder)("region").select(F.concat(F.lit(BASE + "Region/"), "r_regionkey").alias("iri"))
    return graph.neighbourhood(found, regions, depth=2)


@query("neighbourhood_nodes", with_facts(_steps + "SELECT seed, node, distance FROM n", *_near))
def neighbourhood_nodes(spark, folder):
    return _neighbourhood(spark, folder)[0]


_named = {"Region": ("region", "r_regionkey", "r_name"), "Nation": ("nation", "n_nationkey", "n_name"),
          "Customer": ("customer", "c_custkey", "c_name"), "Supplier": ("supplier", "s_suppkey", "s_name")}
_names_sql = " UNION ALL ".join(f"SELECT {iri_sql(c, k)} AS node, {n} AS label, '{NS}{c}' AS types FROM {t}" for c, (t, k, n) in _named.items())


@query("neighbourhood_labelled", with_facts(_steps + f"SELECT seed, node, distance, label, types FROM n JOIN ({_names_sql}) USING (node)", *_near))
def neighbourhood_labelled(spark, folder):
    """Nodes within two steps of every region, by name and type."""
    nodes = _neighbourhood(spark, folder)[0]
    found = graph.described(shop_graph(spark, folder, "type", "name"), nodes)
    return found.select("seed", "node", "distance", "label", F.array_join("types", " ").alias("types"))


@query("neighbourhood_edges", with_facts(_steps + """
SELECT DISTINCT seed, subject, predicate, object FROM e JOIN n ON (n.node = e.subject OR n.node = e.object) AND n.distance < 2""", *_near))
def neighbourhood_edges(spark, folder):
    return _neighbourhood(spark, folder)[1]


@query("neighbourhood_capped", with_facts(_steps + """
SELECT seed, node, distance FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY distance, node) AS k FROM n) WHERE k <= 100""", *_near))
def neighbourhood_capped(spark, folder):
    found = shop_graph(spark, folder, *_near)
    regions = tables(spark, folder)("region").select(F.concat(F.lit(BASE + "Region/"), "r_regionkey").alias("iri"))
    return graph.neighbourhood(found, regions, depth=2, limit=100)[0]


@query("overview_sample", with_facts("""
, r AS (SELECT *, row_number() OVER (PARTITION BY predicate ORDER BY md5(object), subject, object) AS k FROM t)
SELECT subject, predicate, object FROM r WHERE k <= 300 // 6""", *LINK_NAMES))
def overview_sample(spark, folder):
    return graph.overview(shop_graph(spark, folder, *LINK_NAMES), 300)


@query("overview_nodes", with_facts(f"""
, r AS (SELECT *, row_number() OVER (PARTITION BY predicate ORDER BY md5(object), subject, object) AS k FROM t)
SELECT DISTINCT object AS node, label, types FROM r JOIN ({_names_sql} UNION ALL SELECT {iri_sql('Part', 'p_partkey')}, p_name, '{NS}Part' FROM part) x ON x.node = object
WHERE k <= 300 // 6""", *LINK_NAMES))
def overview_nodes(spark, folder):
    """What the sampled relationships point at, by name and type."""
    sample = graph.overview(shop_graph(spark, folder, *LINK_NAMES), 300)
    ends = sample.select(F.col("object").alias("node")).distinct()
    return graph.described(shop_graph(spark, folder, "type", "name"), ends).select("node", "label", F.array_join("types", " ").alias("types"))


@query("triples_page", with_facts("""
SELECT subject, predicate, object, object_type, datatype, lang, inferred FROM t
WHERE contains(lower(object), 'building') OR contains(lower(subject), 'building') OR contains(lower(predicate), 'building')
ORDER BY object DESC, subject, predicate LIMIT 100 OFFSET 5"""))
def triples_page(spark, folder):
    return graph.page(shop_graph(spark, folder), text="building", sort="object", descending=True, limit=100, offset=5)[1]


@query("triples_page_total", with_facts(f"SELECT count(*) AS total FROM t WHERE predicate = '{NS}priority' AND contains(lower(object), 'urgent')",
                                        "priority"))
def triples_page_total(spark, folder):
    return graph.page(shop_graph(spark, folder, "priority"), predicate=NS + "priority", text="urgent")[0]


# -- aggregation ---------------------------------------------------------------------------------------------------------

_measures = ("round(sum({0}), 4) AS sum, round(round(round(sum({0}), 4) / nullif(count({0}), 0), 8), 4) AS avg, round(min({0}), 4) AS min, round(max({0}), 4) AS max")



@query("agg_by_relation", f"""
SELECT {iri_sql('Nation', 'n_nationkey')} AS "group", count(*) AS count, {_measures.format('o_totalprice')}, n_name AS label
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_name""")
def agg_by_relation(spark, folder):
    return graph.aggregate(
        shop_graph(spark, folder, "type", "name", "totalPrice", "placedBy", "inNation", layout="branches"), shop.ORDER, measure=NS + "totalPrice", group_by=[NS + "placedBy", NS + "inNation"]
    )


def _dated(name: str, width: int, kind: str):
    @query(name, f"""
SELECT substr(CAST(o_orderdate AS VARCHAR), 1, {width}) AS "group", count(*) AS count, {_measures.format('o_totalprice')}
FROM orders GROUP BY 1""")
    def run(spark, folder):
        return graph.aggregate(
            shop_graph(spark, folder, "type", "totalPrice", "orderDate", layout="branches"), shop.ORDER, measure=NS + "totalPrice", group_by=NS + "orderDate",
            group_kind=kind, label=False,
        )

    return run


_dated("agg_by_year", 4, "year")
_dated("agg_by_month", 7, "month")


@query("agg_path_filter", f"""
SELECT o_orderstatus AS "group", count(*) AS count, {_measures.format('o_totalprice')}
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE n_regionkey = 2 AND c_mktsegment = 'MACHINERY' GROUP BY 1""")
def agg_path_filter(spark, folder):
    return graph.aggregate(
        shop_graph(spark, folder, "type", "totalPrice", "status", "placedBy", "inNation", "inRegion", "segment", layout="branches"), shop.ORDER, measure=NS + "totalPrice", group_by=NS + "status", label=False,
        filters=[
            ([NS + "placedBy", NS + "inNation", NS + "inRegion"], BASE + "Region/2"),
            ([NS + "placedBy", NS + "segment"], "MACHINERY"),
        ],
    )


@query("agg_inverse", f"""
SELECT o_orderpriority AS "group", count(DISTINCT c_custkey) AS count, {_measures.format('c_acctbal')}
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def agg_inverse(spark, folder):
    return graph.aggregate(
        shop_graph(spark, folder, "type", "balance", "placedBy", "priority", layout="branches"), shop.CUSTOMER, measure=NS + "balance", group_by=["^" + NS + "placedBy", NS + "priority"],
        label=False,
    )


@query("agg_total", f"""
SELECT CAST(NULL AS VARCHAR) AS "group", count(*) AS count, {_measures.format('p_retailprice')} FROM part""")
def agg_total(spark, folder):
    return graph.aggregate(shop_graph(spark, folder, "type", "price", layout="branches"), shop.PART, measure=NS + "price", label=False)


@query("agg_distinct_rows", f"""
SELECT p_brand AS "group", count(DISTINCT o) AS count, {_measures.format('v')} FROM (
  SELECT DISTINCT l_orderkey AS o, p_brand, o_totalprice AS v
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
  UNION ALL SELECT o_orderkey, NULL, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem))
GROUP BY 1""")
def agg_distinct_rows(spark, folder):
    return graph.aggregate(
        shop_graph(spark, folder, "type", "totalPrice", "contains", "brand", layout="branches"), shop.ORDER, measure=NS + "totalPrice", group_by=[NS + "contains", NS + "brand"],
        label=False, dedupe=True,
    )


@query("resolve_values", f"""
WITH v AS (SELECT * FROM (VALUES ('ASIA'), ('europe'), ('nowhere')) x(value)),
h AS (SELECT value, {iri_sql('Region', 'r_regionkey')} AS iri, r_name FROM v LEFT JOIN region ON contains(lower(r_name), lower(value)))
SELECT value, min(iri) AS iri, CASE WHEN min(iri) IS NOT NULL THEN 'label' END AS how, count(iri) AS near FROM h GROUP BY value""")
def resolve_values(spark, folder):
    found = shop_graph(spark, folder, "type", "name")
    return graph.resolve_values(found, ["ASIA", "europe", "nowhere"], type_iri=shop.REGION)


@query("resolve_ambiguous", f"""
WITH v AS (SELECT DISTINCT substr(c_name, 1, length(c_name) - 1) AS value FROM customer UNION SELECT min(c_name) FROM customer),
h AS (SELECT value, {iri_sql('Customer', 'c_custkey')} AS iri, lower(c_name) = lower(value) AS same FROM v JOIN customer ON contains(lower(c_name), lower(value)))
SELECT value, coalesce(min(iri) FILTER (same), CASE WHEN count(*) = 1 THEN min(iri) END) AS iri,
 CASE WHEN count(*) FILTER (same) > 0 THEN 'label' WHEN count(*) = 1 THEN 'single hit' END AS how, count(*) AS near
FROM h WHERE value IN (SELECT value FROM v ORDER BY value LIMIT 12) GROUP BY value""")
def resolve_ambiguous(spark, folder):
    """Beginnings of names, each with many hits, and a whole name among them."""
    names = tables(spark, folder)("customer").select("c_name")
    starts = names.select(F.expr("substr(c_name, 1, length(c_name) - 1)").alias("v")).union(names.agg(F.min("c_name").alias("v")))
    values = [r["v"] for r in starts.distinct().orderBy("v").limit(12).collect()]  # a report on the first twelve
    return graph.resolve_values(shop_graph(spark, folder, "type", "name"), values, type_iri=shop.CUSTOMER)


# -- classes ----------------------------------------------------------------------------------------------------------------

@query("class_edges", with_facts(f"""
SELECT a.object AS source_class, t.predicate, b.object AS target_class, count(*) AS n
FROM t JOIN t a ON a.subject = t.subject AND a.predicate = '{RDF_TYPE}' JOIN t b ON b.subject = t.object AND b.predicate = '{RDF_TYPE}'
WHERE t.predicate <> '{RDF_TYPE}' GROUP BY ALL""", "type", *LINK_NAMES))
def class_edges(spark, folder):
    return graph.class_edges(shop_graph(spark, folder, "type", *LINK_NAMES))


@query("class_paths", f"""
WITH RECURSIVE e AS (
  SELECT DISTINCT 'Order' AS a, '{NS}placedBy' AS step, 'Customer' AS b FROM orders JOIN customer ON o_custkey = c_custkey
  UNION SELECT 'Customer', '{NS}inNation', 'Nation' FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION SELECT 'Supplier', '{NS}inNation', 'Nation' FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION SELECT 'Order', '{NS}contains', 'Part' FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey
  UNION SELECT 'Part', '{NS}suppliedBy', 'Supplier' FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
  UNION SELECT 'Event', '{NS}performedBy', 'Customer' FROM events JOIN customer ON user_id = c_custkey
  UNION SELECT 'Nation', '{NS}inRegion', 'Region' FROM nation JOIN region ON n_regionkey = r_regionkey),
h AS (SELECT a, step, b FROM e UNION ALL SELECT b, '^' || step, a FROM e),
w AS (
  SELECT CAST(1 AS BIGINT) AS length, step AS steps, [a, b] AS seen, b AS at_ FROM h WHERE a = 'Order'
  UNION ALL SELECT length + 1, steps || ' > ' || step, list_append(seen, b), b FROM w JOIN h ON a = at_
  WHERE at_ <> 'Region' AND NOT list_contains(seen, b) AND length < 8)
SELECT length, steps FROM w WHERE at_ = 'Region' ORDER BY length, steps LIMIT 5""")
def class_paths(spark, folder):
    found = graph.class_paths(graph.class_edges(shop_graph(spark, folder, "type", *LINK_NAMES)), shop.ORDER, shop.REGION)
    return found.select("length", F.array_join("steps", " > ").alias("steps"))


@query("class_view_customer", f"""
SELECT {iri_sql('Customer', 'c_custkey')} AS id, c_name AS label, '{NS}Customer' AS types, c_name AS name, c_acctbal AS balance,
  c_mktsegment AS segment, {iri_sql('Nation', 'c_nationkey')} AS "inNation" FROM customer""")
def class_view_customer(spark, folder):
    out = graph.class_view(shop_graph(spark, folder, "type", "name", "balance", "segment", "inNation"), shop.ONTOLOGY, shop.CUSTOMER)
    return out.withColumn("types", F.array_join("types", "|"))


@query("class_view_party", f"""
SELECT {iri_sql('Customer', 'c_custkey')} AS id, c_name AS label, c_acctbal AS balance FROM customer
UNION ALL SELECT {iri_sql('Supplier', 's_suppkey')}, s_name, s_acctbal FROM supplier""")
def class_view_party(spark, folder):
    return graph.class_view(shop_graph(spark, folder, "type", "name", "balance", "inNation"), shop.ONTOLOGY, shop.PARTY).select("id", "label", "balance")


@query("class_view_search", f"""
SELECT {iri_sql('Part', 'p_partkey')} AS id, p_name AS name, p_size AS size, p_retailprice AS price FROM part
WHERE contains(lower(p_name), 'bolt') OR contains(lower(p_type), 'bolt') OR contains(lower(p_brand), 'bolt')
ORDER BY id LIMIT 50""")
def class_view_search(spark, folder):
    out = graph.class_view(shop_graph(spark, folder, "type", "name", "brand", "partType", "size", "price"), shop.ONTOLOGY, shop.PART, search_text="bolt", limit=50)
    return out.select("id", "name", "size", "price")


@query("class_relations", f"""
SELECT {iri_sql('Order', 'l_orderkey')} AS id, 'contains' AS relation, {iri_sql('Part', 'l_partkey')} AS target, p_name AS target_label
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey""")
def class_relations(spark, folder):
    return graph.class_relations(shop_graph(spark, folder, "type", "name", "contains"), shop.ONTOLOGY, shop.ORDER)


@query("subclass_instances", " UNION ALL ".join(
    [f"SELECT '{NS}{c}' AS class, count(*) AS instances FROM {t}" for c, t in (
        ("Region", "region"), ("Nation", "nation"), ("Customer", "customer"), ("Supplier", "supplier"), ("Part", "part"),
        ("Order", "orders"), ("Event", "events"))]
    + [f"SELECT '{NS}Party', (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier)"]))
def subclass_instances(spark, folder):
    return graph.instance_counts(shop_graph(spark, folder, "type"), shop.ONTOLOGY)
