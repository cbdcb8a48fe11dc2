"""Sources and mapping: rows to triples."""

from __future__ import annotations

from pyspark.sql import functions as F

from semgraph.checks.registry import BASE, NS, XSD, facts_sql, iri_sql, query, shop_graph, tables
from semgraph.functions.terms import BNODE, LITERAL
from semgraph.operators import graph, triples
from semgraph.plans import shop
from semgraph.plans.mapping import Attribute, ClassMap, Mapping, Properties, Reference, Relation, Source, Term, TripleMap
from semgraph.sources import store
from semgraph.sources.files import statistics
from semgraph.sources.tables import catalog_columns, preview, read_query, register_views

SHORT = ("subject", "predicate", "object")
FULL = "subject, predicate, object, object_type, datatype, source_table"


def _build(spark, folder, mapping, *columns):
    return triples.build(spark, mapping, tables(spark, folder)).select(*columns)


# -- sources ---------------------------------------------------------------------------------------------------

@query("source_query", "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total "
                       "FROM orders GROUP BY o_orderstatus")
def source_query(spark, folder):
    register_views(tables(spark, folder), ["orders"])
    return read_query(spark, "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total "
                             "FROM orders GROUP BY o_orderstatus")


@query("source_parameters", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal >= 500")
def source_parameters(spark, folder):
    register_views(tables(spark, folder), ["customer"])
    return read_query(
        spark, "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = :segment AND c_acctbal >= :least",
        {"segment": "BUILDING", "least": 500},
    )


@query("source_preview", "SELECT p_partkey, p_name, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 50")
def source_preview(spark, folder):
    part = tables(spark, folder)("part").select("p_partkey", "p_name", "p_retailprice")
    return preview(part.orderBy(F.desc("p_retailprice"), "p_partkey"), 50)


@query("source_statistics")
def source_statistics(spark, folder):
    return statistics(spark, tables(spark, folder).location("lineitem"))


@query("catalog_columns")
def listed_columns(spark, folder):
    register_views(tables(spark, folder), ["orders", "customer"])
    listed = catalog_columns(
        spark, keys={"orders": ["o_orderkey"], "customer": ["c_custkey"]}, references={("orders", "o_custkey"): "customer"})
    return listed.where(F.col("table").isin("orders", "customer"))


@query("table_signatures", " UNION ALL ".join(
    f"SELECT '{t}' AS \"table\", 'rows' AS method, count(*) AS items FROM {t} UNION ALL SELECT '{t}', 'files', 1"
    for t in ("customer", "lineitem", "orders")))
def table_signatures(spark, folder):
    """By rows and by files; each table of the sample lies in one file."""
    names, resolve = ("customer", "lineitem", "orders"), tables(spark, folder)
    both = store.signatures(spark, names, resolve).unionByName(store.signatures(spark, names, resolve, "rows"))
    return both.select("table", "method", "items")


# -- classes, attributes, relations -------------------------------------------------------------------------------

@query("triples_types", f"SELECT subject, predicate, object FROM ({facts_sql('type')})")
def triples_types(spark, folder):
    return shop_graph(spark, folder, "type").select(*SHORT)


@query("triples_attributes", f"SELECT {FULL} FROM ({facts_sql('name', 'balance', 'segment', 'brand', 'size', 'price')})")
def triples_attributes(spark, folder):
    found = shop_graph(spark, folder, "name", "balance", "segment", "brand", "size", "price")
    return found.select(*[c.strip() for c in FULL.split(",")])


@query("triples_dates", f"SELECT {FULL} FROM ({facts_sql('orderDate', 'totalPrice', 'status')})")
def triples_dates(spark, folder):
    found = shop_graph(spark, folder, "orderDate", "totalPrice", "status")
    return found.select(*[c.strip() for c in FULL.split(",")])


@query("triples_fk", f"SELECT {FULL} FROM ({facts_sql('inRegion', 'inNation', 'placedBy', 'performedBy')})")
def triples_fk(spark, folder):
    found = shop_graph(spark, folder, "inRegion", "inNation", "placedBy", "performedBy")
    return found.select(*[c.strip() for c in FULL.split(",")])


@query("triples_link", f"SELECT subject, predicate, object FROM ({facts_sql('contains', 'suppliedBy')})")
def triples_link(spark, folder):
    return shop_graph(spark, folder, "contains", "suppliedBy").select(*SHORT)


@query("triples_build", f"SELECT source_table, predicate, object_type, count(*) AS n, count(DISTINCT subject) AS subjects "
                        f"FROM ({facts_sql()}) GROUP BY ALL")
def triples_build(spark, folder):
    found = triples.build(spark, shop.MAPPING, tables(spark, folder))
    return found.groupBy("source_table", "predicate", "object_type").agg(
        F.count("*").alias("n"), F.countDistinct("subject").alias("subjects")
    )


@query("triples_one_class", f"SELECT subject, predicate, object FROM "
                            f"({facts_sql('type:Customer', 'Customer.name', 'Customer.balance', 'segment', 'Customer.inNation')})")
def triples_one_class(spark, folder):
    return triples.class_triples(spark, shop.MAPPING, shop.CUSTOMER, tables(spark, folder)).select(*SHORT)


def _two_way(direction: str) -> Mapping:
    return Mapping(
        BASE,
        (ClassMap(shop.ORDER, "orders", ("o_orderkey",)), ClassMap(shop.CUSTOMER, "customer", ("c_custkey",))),
        (Relation(NS + "placedBy", shop.ORDER, shop.CUSTOMER, ("o_custkey",), direction=direction),),
    )


_there = f"SELECT {iri_sql('Order', 'o_orderkey')} AS subject, '{NS}placedBy' AS predicate, {iri_sql('Customer', 'o_custkey')} AS object FROM orders"
_back = f"SELECT {iri_sql('Customer', 'o_custkey')} AS subject, '{NS}placedBy' AS predicate, {iri_sql('Order', 'o_orderkey')} AS object FROM orders"


@query("triples_bidirectional", f"{_there} UNION ALL {_back}")
def triples_bidirectional(spark, folder):
    mapping = _two_way("bidirectional")
    return triples.build(spark, mapping, tables(spark, folder), maps=mapping.restricted({NS + "placedBy"})).select(*SHORT)


@query("triples_reverse", _back)
def triples_reverse(spark, folder):
    mapping = _two_way("reverse")
    return triples.build(spark, mapping, tables(spark, folder), maps=mapping.restricted({NS + "placedBy"})).select(*SHORT)


# -- hand-written triple maps ------------------------------------------------------------------------------------

_ENC = "url_encode({})"


@query("triples_encoding", f"""
SELECT '{BASE}part/' || url_encode(p_name) || '/' || url_encode(p_type) || '-' || p_partkey AS subject,
       '{NS}brand' AS predicate, p_brand AS object FROM part
UNION ALL
SELECT '{BASE}order/' || o_orderkey || '/' || url_encode(o_orderpriority), '{NS}priority', o_orderpriority FROM orders""")
def triples_encoding(spark, folder):
    mapping = Mapping(
        BASE,
        (
            ClassMap(shop.PART, "part", attributes=(Attribute(NS + "brand", "p_brand"),),
                     template=BASE + "part/{p_name}/{p_type}-{p_partkey}"),
            ClassMap(shop.ORDER, "orders", attributes=(Attribute(NS + "priority", "o_orderpriority"),),
                     template=BASE + "order/{o_orderkey}/{o_orderpriority}"),
        ),
    )
    maps = mapping.restricted({NS + "brand", NS + "priority"})
    return triples.build(spark, mapping, tables(spark, folder), maps=maps).select(*SHORT)


def _extra(*maps: TripleMap) -> Mapping:
    return Mapping(BASE, extra_maps=maps)


_customer_by_name = TripleMap("customer", Source("customer"), Term(template=BASE + "customer/{c_name}"))


@query("triples_reference_join", f"""
SELECT '{BASE}Order/' || o_orderkey AS subject, '{NS}buyer' AS predicate,
       '{BASE}customer/' || url_encode(c_name) AS object, 'iri' AS object_type, 'orders' AS source_table
FROM orders JOIN customer ON o_custkey = c_custkey""")
def triples_reference_join(spark, folder):
    orders = TripleMap(
        "orders", Source("orders"), Term(template=BASE + "Order/{o_orderkey}"),
        properties=(Properties((Term(constant=NS + "buyer"),), (Reference("customer", (("o_custkey", "c_custkey"),)),)),),
    )
    return _build(spark, folder, _extra(_customer_by_name, orders), *SHORT, "object_type", "source_table")


@query("triples_same_row", f"""
SELECT '{BASE}account/' || c_custkey AS subject, '{NS}holder' AS predicate,
       '{BASE}customer/' || url_encode(c_name) AS object FROM customer""")
def triples_same_row(spark, folder):
    account = TripleMap(
        "account", Source("customer"), Term(template=BASE + "account/{c_custkey}"),
        properties=(Properties((Term(constant=NS + "holder"),), (Reference("customer"),)),),
    )
    return _build(spark, folder, _extra(_customer_by_name, account), *SHORT)


@query("triples_bnode", f"""
SELECT '_:' || event_id AS subject, '{NS}kind' AS predicate, event_type AS object, 'literal' AS object_type FROM events
UNION ALL SELECT '_:' || event_id, '{NS}source', '{BASE}log', 'iri' FROM events
UNION ALL SELECT '_:' || event_id, '{NS}note', event_type || ' by ' || user_id, 'literal' FROM events
UNION ALL SELECT '_:' || event_id, '{NS}twin', '_:' || event_type || '/' || event_id, 'bnode' FROM events""")
def triples_bnode(spark, folder):
    events = TripleMap(
        "events", Source("events"), Term(column="event_id", kind=BNODE),
        properties=(
            Properties((Term(constant=NS + "kind"),), (Term(column="event_type", kind=LITERAL),)),
            Properties((Term(constant=NS + "source"),), (Term(constant=BASE + "log"),)),
            Properties((Term(constant=NS + "note"),), (Term(template="{event_type} by {user_id}", kind=LITERAL),)),
            Properties((Term(constant=NS + "twin"),), (Term(template="{event_type}/{event_id}", kind=BNODE),)),
        ),
    )
    return _build(spark, folder, _extra(events), *SHORT, "object_type")


_by_customer = (
    "SELECT o_custkey AS custkey, count(*) AS orders, max(o_orderdate) AS last FROM orders GROUP BY o_custkey"
)


@query("triples_query_map", f"""
WITH q AS ({_by_customer})
SELECT '{BASE}Customer/' || custkey AS subject, '{NS}orderCount' AS predicate, CAST(orders AS VARCHAR) AS object,
       '{XSD}integer' AS datatype, CAST(NULL AS VARCHAR) AS source_table FROM q
UNION ALL SELECT '{BASE}Customer/' || custkey, '{NS}lastOrder', CAST(last AS VARCHAR), '{XSD}dateTime', NULL FROM q""")
def triples_query_map(spark, folder):
    register_views(tables(spark, folder), ["orders"])
    totals = TripleMap(
        "totals", Source(query=_by_customer), Term(template=BASE + "Customer/{custkey}"),
        properties=(
            Properties((Term(constant=NS + "orderCount"),), (Term(column="orders", kind=LITERAL),)),
            Properties((Term(constant=NS + "lastOrder"),), (Term(column="last", kind=LITERAL),)),
        ),
    )
    return _build(spark, folder, _extra(totals), *SHORT, "datatype", "source_table")


_gaps = (
    "SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS segment, nullif(c_nationkey, 7) AS nation, "
    "CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS balance FROM customer"
)


@query("triples_null_values", f"""
WITH q AS ({_gaps})
SELECT '{BASE}Customer/' || c_custkey AS subject, '{NS}segment' AS predicate, segment AS object FROM q WHERE segment IS NOT NULL
UNION ALL SELECT '{BASE}Customer/' || c_custkey, '{NS}balance', CAST(balance AS VARCHAR) FROM q WHERE balance IS NOT NULL
UNION ALL SELECT '{BASE}Customer/' || c_custkey, '{NS}inNation', '{BASE}Nation/' || nation FROM q WHERE nation IS NOT NULL""")
def triples_null_values(spark, folder):
    register_views(tables(spark, folder), ["customer"])
    rows = TripleMap(
        "rows", Source(query=_gaps), Term(template=BASE + "Customer/{c_custkey}"),
        properties=(
            Properties((Term(constant=NS + "segment"),), (Term(column="segment", kind=LITERAL),)),
            Properties((Term(constant=NS + "balance"),), (Term(column="balance", kind=LITERAL),)),
            Properties((Term(constant=NS + "inNation"),), (Term(template=BASE + "Nation/{nation}"),)),
        ),
    )
    return _build(spark, folder, _extra(rows), *SHORT)


@query("triples_fan_out", " UNION ALL ".join(
    f"SELECT '{BASE}Part/' || p_partkey AS subject, '{NS}{p}' AS predicate, {o} AS object, {d} AS datatype, {l} AS lang FROM part"
    for p in ("title", "caption")
    for o, d, l in (("p_name", "CAST(NULL AS VARCHAR)", "'en'"), ("CAST(p_size AS VARCHAR)", f"'{XSD}string'", "CAST(NULL AS VARCHAR)"))
))
def triples_fan_out(spark, folder):
    part = TripleMap(
        "part", Source("part"), Term(template=BASE + "Part/{p_partkey}"),
        properties=(
            Properties(
                (Term(constant=NS + "title"), Term(constant=NS + "caption")),
                (Term(column="p_name", kind=LITERAL, lang="en"),
                 Term(column="p_size", kind=LITERAL, datatype=XSD + "string")),
            ),
        ),
    )
    return _build(spark, folder, _extra(part), *SHORT, "datatype", "lang")


@query("triples_mapped_predicate", f"""
SELECT '{BASE}Event/' || event_id AS subject, '{NS}on-' || url_encode(event_type) AS predicate,
       CAST(value AS VARCHAR) AS object, '{XSD}double' AS datatype FROM events""")
def triples_mapped_predicate(spark, folder):
    events = TripleMap(
        "events", Source("events"), Term(template=BASE + "Event/{event_id}"),
        properties=(Properties((Term(template=NS + "on-{event_type}"),), (Term(column="value", kind=LITERAL),)),),
    )
    return _build(spark, folder, _extra(events), *SHORT, "datatype")


# -- keys and IRIs ---------------------------------------------------------------------------------------------------

_line = Mapping(BASE, (ClassMap(NS + "Line", "lineitem", ("l_orderkey", "l_linenumber")),
                       ClassMap(NS + "Label", "part", ("p_name", "p_partkey"))))


@query("keys_from_iris", f"SELECT '{BASE}Label/' || url_encode(p_name) || '-' || p_partkey AS subject, p_name, "
                         "CAST(p_partkey AS VARCHAR) AS p_partkey FROM part")
def keys_from_iris(spark, folder):
    found = triples.class_triples(spark, _line, NS + "Label", tables(spark, folder)).select("subject")
    return triples.entity_keys(found, _line, NS + "Label")


@query("iris_from_keys", f"SELECT l_orderkey, l_linenumber, '{BASE}Line/' || l_orderkey || '-' || l_linenumber AS iri "
                         "FROM lineitem")
def iris_from_keys(spark, folder):
    keys = tables(spark, folder)("lineitem").select("l_orderkey", "l_linenumber")
    return keys.withColumn("iri", triples.iris_for(keys, _line, NS + "Line", ("l_orderkey", "l_linenumber")))


@query("asserted_export", f"SELECT subject, predicate, object FROM ({facts_sql('segment', 'inRegion')}) WHERE NOT inferred")
def asserted_export(spark, folder):
    return graph.asserted(shop_graph(spark, folder, "segment", "inRegion")).select(*SHORT)
