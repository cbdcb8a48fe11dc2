"""Rules and OWL consequences over the sample graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from semgraph.checks.registry import BASE, NS, RDF_TYPE, iri_sql, query, shop_graph, tables
from semgraph.functions.terms import OWL, OWL_NOTHING, RDFS, RDFS_LABEL
from semgraph.operators import owl, rules, triples
from semgraph.operators.rules import Atom, Rule
from semgraph.plans import shop
from semgraph.plans.mapping import Attribute, ClassMap, Mapping, Relation
from semgraph.plans.ontology import DataProperty, ObjectProperty, Ontology, OntologyClass, Restriction
from semgraph.sources.tables import register_views

SPO = ("subject", "predicate", "object")


def _is(cls: str, x: str) -> Atom:
    return Atom("class", NS + cls, (x,))


def _has(prop: str, x, y) -> Atom:
    return Atom("property", NS + prop, (x, y))


def _test(name: str, a, b) -> Atom:
    return Atom("builtin", name, (a, b))


PREMIUM = Rule("premium", (_is("Customer", "?c"), _has("balance", "?c", "?b"), _test("greaterThan", "?b", 5000)),
               (_is("Premium", "?c"),))
NATION_OF = Rule("orderNation", (_has("placedBy", "?o", "?c"), _has("inNation", "?c", "?n")), (_has("orderNation", "?o", "?n"),))
REGION_OF = Rule("orderRegion", (_has("orderNation", "?o", "?n"), _has("inRegion", "?n", "?r")), (_has("orderRegion", "?o", "?r"),))
PREMIUM_ORDER = Rule("premiumOrder", (_has("placedBy", "?o", "?c"), _is("Premium", "?c")),
                     (_is("PremiumOrder", "?o"), _has("tier", "?o", "gold")))

_cust, _order, _nation = iri_sql("Customer", "c_custkey"), iri_sql("Order", "o_orderkey"), iri_sql("Nation", "c_nationkey")
_premium_sql = f"SELECT {_cust} AS subject, '{RDF_TYPE}' AS predicate, '{NS}Premium' AS object FROM customer WHERE c_acctbal > 5000"
_nation_sql = f"SELECT DISTINCT {_order} AS subject, '{NS}orderNation' AS predicate, {_nation} AS object FROM orders JOIN customer ON o_custkey = c_custkey"


@query("rule_premium", _premium_sql)
def rule_premium(spark, folder):
    return rules.infer(shop_graph(spark, folder, "type", "balance"), [PREMIUM]).triples.select(*SPO)


@query("rule_order_nation", _nation_sql)
def rule_order_nation(spark, folder):
    return rules.infer(shop_graph(spark, folder, "placedBy", "inNation"), [NATION_OF]).triples.select(*SPO)


_chain_sql = f"""{_premium_sql} UNION ALL {_nation_sql}
UNION ALL SELECT {_order}, '{NS}orderRegion', '{BASE}Region/' || n_regionkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT {_order}, '{RDF_TYPE}', '{NS}PremiumOrder' FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 5000
UNION ALL SELECT {_order}, '{NS}tier', 'gold' FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 5000"""
_CHAIN = [REGION_OF, PREMIUM_ORDER, PREMIUM, NATION_OF]


@query("rule_fixpoint", _chain_sql)
def rule_fixpoint(spark, folder):
    return rules.infer(shop_graph(spark, folder, "type", "balance", "placedBy", "inNation", "inRegion"), _CHAIN).triples.select(*SPO)


@query("rule_counts", f"""
SELECT CASE predicate WHEN '{NS}orderNation' THEN 'orderNation' WHEN '{NS}orderRegion' THEN 'orderRegion' WHEN '{NS}tier' THEN 'premiumOrder'
 ELSE CASE object WHEN '{NS}Premium' THEN 'premium' ELSE 'premiumOrder' END END AS rule, count(*) AS n FROM ({_chain_sql}) GROUP BY 1""")
def rule_counts(spark, folder):
    return rules.infer(shop_graph(spark, folder, "type", "balance", "placedBy", "inNation", "inRegion"), _CHAIN).per_rule


@query("rule_violation", f"""
SELECT DISTINCT {_order} AS o, {_cust} AS c, CAST(o_totalprice AS VARCHAR) AS p, CAST(c_acctbal AS VARCHAR) AS b
FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 200000 AND c_acctbal < 0""")
def rule_violation(spark, folder):
    rule = Rule("risky", (
        _has("placedBy", "?o", "?c"), _has("totalPrice", "?o", "?p"), _has("balance", "?c", "?b"),
        _test("greaterThan", "?p", 200000), _test("lessThan", "?b", 0)), (_is("Risky", "?o"),), mode="violation")
    return rules.check(shop_graph(spark, folder, "placedBy", "totalPrice", "balance"), rule)


# Customers and nations that carry the nation's number as a literal, not as a link.
_NUMBERED = Mapping(BASE, (
    ClassMap(shop.CUSTOMER, "customer", ("c_custkey",), (Attribute(NS + "nationNumber", "c_nationkey"),)),
    ClassMap(shop.NATION, "nation", ("n_nationkey",), (Attribute(NS + "number", "n_nationkey"),))))


@query("rule_equal_link", f"""
SELECT {_cust} AS c, {_nation} AS n, CAST(c_nationkey AS VARCHAR) AS a, CAST(n_nationkey AS VARCHAR) AS b
FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def rule_equal_link(spark, folder):
    rule = Rule("numbered", (
        _is("Customer", "?c"), _has("nationNumber", "?c", "?a"), _is("Nation", "?n"), _has("number", "?n", "?b"),
        _test("equal", "?a", "?b")), (_has("inNation", "?c", "?n"),), mode="violation")
    return rules.check(triples.build(spark, _NUMBERED, tables(spark, folder)), rule)


@query("rule_run", f"""
SELECT 'derived' AS what, '{NS}orderNation' AS name, count(*) AS n FROM ({_nation_sql})
UNION ALL SELECT 'violated', 'far', count(DISTINCT o_orderkey) FROM orders JOIN customer ON o_custkey = c_custkey
 JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 200000""")
def rule_run(spark, folder):
    """Derive to the fixpoint, then look for violations among derived facts too."""
    far = Rule("far", (_has("orderNation", "?o", "?n"), _has("totalPrice", "?o", "?p"), _test("greaterThan", "?p", 200000)),
               (_is("Far", "?o"),), mode="violation")
    derived, broken = rules.run(shop_graph(spark, folder, "placedBy", "inNation", "totalPrice"), [NATION_OF, far])
    found = derived.triples.groupBy(F.lit("derived").alias("what"), F.col("predicate").alias("name")).agg(F.count("*").alias("n"))
    return found.unionByName(broken.groupBy(F.lit("violated").alias("what"), F.col("rule").alias("name")).agg(F.count("*").alias("n")))


@query("rule_constants", f"""
SELECT {_order} AS subject, '{NS}flag' AS predicate, 'urgent and open' AS object FROM orders
WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'""")
def rule_constants(spark, folder):
    rule = Rule("urgent", (_has("status", "?o", "O"), _has("priority", "?o", "1-URGENT")), (_has("flag", "?o", "urgent and open"),))
    return rules.infer(shop_graph(spark, folder, "status", "priority"), [rule]).triples.select(*SPO)


# Rules reaching their own premises: who is served from which region, along derived links.
_RECURSIVE = [
    Rule("base", (_has("placedBy", "?x", "?y"),), (_has("within", "?x", "?y"),)),
    Rule("nation", (_has("inNation", "?x", "?y"),), (_has("within", "?x", "?y"),)),
    Rule("region", (_has("inRegion", "?x", "?y"),), (_has("within", "?x", "?y"),)),
    Rule("step", (_has("within", "?x", "?y"), _has("within", "?y", "?z")), (_has("within", "?x", "?z"),)),
]
_edges_sql = f"""SELECT {_order} AS a, '{BASE}Customer/' || o_custkey AS b FROM orders
UNION ALL SELECT {_cust}, {_nation} FROM customer UNION ALL SELECT '{BASE}Supplier/' || s_suppkey, '{BASE}Nation/' || s_nationkey FROM supplier
UNION ALL SELECT '{BASE}Nation/' || n_nationkey, '{BASE}Region/' || n_regionkey FROM nation"""
_closure_sql = f"""WITH RECURSIVE e AS ({_edges_sql}), w AS (SELECT a, b FROM e UNION SELECT w.a, e.b FROM w JOIN e ON w.b = e.a)"""


@query("rule_recursive", f"{_closure_sql} SELECT a AS subject, '{NS}within' AS predicate, b AS object FROM w")
def rule_recursive(spark, folder):
    return rules.infer(shop_graph(spark, folder, "placedBy", "inNation", "inRegion"), _RECURSIVE).triples.select(*SPO)


# -- OWL ------------------------------------------------------------------------------------------------------------

def _closed(spark, folder, ontology, *names):
    return owl.closure(shop_graph(spark, folder, *names), ontology)


_family = Ontology((OntologyClass(shop.PARTY, parents=(NS + "Agent",)), OntologyClass(NS + "Agent"),
                    OntologyClass(shop.CUSTOMER, parents=(shop.PARTY,), equivalent=(NS + "Client",)),
                    OntologyClass(shop.SUPPLIER, parents=(shop.PARTY,)), OntologyClass(NS + "Client")))


@query("owl_subclass", " UNION ALL ".join(
    f"SELECT {iri} AS subject, '{RDF_TYPE}' AS predicate, '{NS}{c}' AS object FROM {t}"
    for t, iri, classes in (("customer", _cust, ("Party", "Agent", "Client")), ("supplier", iri_sql("Supplier", "s_suppkey"), ("Party", "Agent")))
    for c in classes))
def owl_subclass(spark, folder):
    return _closed(spark, folder, _family, "type").triples.select(*SPO)


@query("owl_domain_range", f"""
SELECT DISTINCT {_order} AS subject, '{RDF_TYPE}' AS predicate, '{NS}Purchase' AS object FROM orders
UNION ALL SELECT DISTINCT '{BASE}Customer/' || o_custkey, '{RDF_TYPE}', c FROM orders, (VALUES ('{NS}Buyer'), ('{NS}Party')) v(c)""")
def owl_domain_range(spark, folder):
    ontology = Ontology((OntologyClass(NS + "Buyer", parents=(NS + "Party",)),),
                        (ObjectProperty(NS + "placedBy", NS + "Purchase", NS + "Buyer"),))
    return _closed(spark, folder, ontology, "placedBy").triples.select(*SPO)


@query("owl_inverse", f"SELECT '{BASE}Customer/' || o_custkey AS subject, '{NS}placed' AS predicate, {_order} AS object FROM orders")
def owl_inverse(spark, folder):
    ontology = Ontology(object_properties=(ObjectProperty(NS + "placedBy", inverse_of=NS + "placed"), ObjectProperty(NS + "placed")))
    return _closed(spark, folder, ontology, "placedBy").triples.select(*SPO)


@query("owl_symmetric_subproperty", f"""
SELECT {_nation} AS subject, '{NS}near' AS predicate, {_cust} AS object FROM customer
UNION ALL SELECT {_cust}, '{NS}near', {_nation} FROM customer
UNION ALL SELECT '{BASE}Nation/' || s_nationkey, '{NS}near', '{BASE}Supplier/' || s_suppkey FROM supplier
UNION ALL SELECT '{BASE}Supplier/' || s_suppkey, '{NS}near', '{BASE}Nation/' || s_nationkey FROM supplier""")
def owl_symmetric_subproperty(spark, folder):
    ontology = Ontology(object_properties=(ObjectProperty(NS + "inNation", parents=(NS + "near",)),
                                           ObjectProperty(NS + "near", characteristics=("symmetric",))))
    return _closed(spark, folder, ontology, "inNation").triples.select(*SPO)


_within = tuple(ObjectProperty(NS + p, parents=(NS + "within",)) for p in ("placedBy", "inNation", "inRegion"))


@query("owl_transitive", f"{_closure_sql} SELECT a AS subject, '{NS}within' AS predicate, b AS object FROM w")
def owl_transitive(spark, folder):
    ontology = Ontology(object_properties=(*_within, ObjectProperty(NS + "within", characteristics=("transitive",))))
    return _closed(spark, folder, ontology, "placedBy", "inNation", "inRegion").triples.select(*SPO)


# Nations in a ring, each within the next; customers hang on it.
_RING = Mapping(BASE, (ClassMap(shop.NATION, "nation", ("n_nationkey",)), ClassMap(shop.CUSTOMER, "customer", ("c_custkey",))), (
    Relation(NS + "within", shop.NATION, shop.NATION, target_key=("next",), source_key=("n_nationkey",),
             query="SELECT n_nationkey, CAST((n_nationkey + 1) % 25 AS INT) AS next FROM nation"),
    Relation(NS + "within", shop.CUSTOMER, shop.NATION, target_key=("c_nationkey",))))


@query("owl_transitive_cycle", f"""
SELECT {_cust} AS subject, '{NS}within' AS predicate, '{BASE}Nation/' || n_nationkey AS object FROM customer, nation WHERE n_nationkey <> c_nationkey
UNION ALL SELECT '{BASE}Nation/' || a.n_nationkey, '{NS}within', '{BASE}Nation/' || b.n_nationkey FROM nation a, nation b
WHERE b.n_nationkey <> (a.n_nationkey + 1) % 25""")
def owl_transitive_cycle(spark, folder):
    register_views(tables(spark, folder), ["nation"])
    maps = _RING.restricted({NS + "within"})
    ring = triples.build(spark, _RING, tables(spark, folder), maps=maps)
    ontology = Ontology(object_properties=(ObjectProperty(NS + "within", characteristics=("transitive",)),))
    return owl.closure(ring, ontology).triples.select(*SPO)


@query("owl_chain", f"""
SELECT DISTINCT {_order} AS subject, '{NS}shipsTo' AS predicate, '{BASE}Region/' || n_regionkey AS object
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")
def owl_chain(spark, folder):
    ontology = Ontology(object_properties=(
        ObjectProperty(NS + "shipsTo", chains=((NS + "placedBy", NS + "inNation", NS + "inRegion"),)),))
    return _closed(spark, folder, ontology, "placedBy", "inNation", "inRegion").triples.select(*SPO)


@query("owl_restrictions", f"""
SELECT {_order} AS subject, '{NS}channel' AS predicate, 'web' AS object FROM orders
UNION ALL SELECT DISTINCT '{BASE}Customer/' || o_custkey, '{RDF_TYPE}', '{NS}Buyer' FROM orders""")
def owl_restrictions(spark, folder):
    ontology = Ontology(
        (OntologyClass(shop.ORDER, restrictions=(Restriction(NS + "channel", "has_value", "web"),
                                                 Restriction(NS + "placedBy", "only", NS + "Buyer"))),),
        (ObjectProperty(NS + "placedBy"),))
    found = shop_graph(spark, folder, "type", "placedBy").where(
        ((F.col("predicate") == RDF_TYPE) & (F.col("object") == shop.ORDER)) | (F.col("predicate") == NS + "placedBy"))
    return owl.closure(found, ontology).triples.select(*SPO)


@query("owl_disjoint", f"SELECT DISTINCT '{BASE}Customer/' || o_custkey AS subject FROM orders JOIN customer ON o_custkey = c_custkey")
def owl_disjoint(spark, folder):
    ontology = Ontology((OntologyClass(shop.CUSTOMER, disjoint=(NS + "Debtor",)), OntologyClass(NS + "Debtor")),
                        (ObjectProperty(NS + "placedBy", range=NS + "Debtor"),))
    return _closed(spark, folder, ontology, "type", "placedBy").inconsistent


@query("owl_nothing", f"""
SELECT '{BASE}Customer/' || o_custkey AS subject, '{RDF_TYPE}' AS predicate, o AS object
FROM (SELECT DISTINCT o_custkey FROM orders JOIN customer ON o_custkey = c_custkey), (VALUES ('{NS}Debtor'), ('{OWL_NOTHING}')) v(o)""")
def owl_nothing(spark, folder):
    ontology = Ontology((OntologyClass(shop.CUSTOMER, disjoint=(NS + "Debtor",)), OntologyClass(NS + "Debtor")),
                        (ObjectProperty(NS + "placedBy", range=NS + "Debtor"),))
    return _closed(spark, folder, ontology, "type", "placedBy").triples.select(*SPO)


# Two accounts with one holder key are one holder: customers and the accounts named after them.
_HOLDERS = Mapping(
    BASE,
    (ClassMap(NS + "Account", "customer", ("c_custkey",)), ClassMap(NS + "Person", "customer", template=BASE + "Person/{c_name}"),
     ClassMap(NS + "Holder", "customer", template=BASE + "Holder/{c_custkey}"),
     ClassMap(NS + "Nation", "nation", ("n_nationkey",))),
    (Relation(NS + "heldBy", NS + "Account", NS + "Person", ("c_name",)),
     Relation(NS + "heldBy", NS + "Account", NS + "Holder", ("c_custkey",)),
     Relation(NS + "livesIn", NS + "Person", NS + "Nation", ("c_nationkey",))),
)


@query("owl_same_as", f"""
SELECT '{BASE}Holder/' || c_custkey AS subject, '{NS}livesIn' AS predicate, {_nation} AS object FROM customer""")
def owl_same_as(spark, folder):
    ontology = Ontology(object_properties=(ObjectProperty(NS + "heldBy", characteristics=("functional",)), ObjectProperty(NS + "livesIn")))
    maps = _HOLDERS.restricted({NS + "heldBy", NS + "livesIn"})
    found = triples.build(spark, _HOLDERS, tables(spark, folder), maps=maps)
    return owl.closure(found, ontology).triples.select(*SPO)


# The same the other way round: a person and a holder hold the account; the holder's nation is known.
_HOLDING = Mapping(BASE, _HOLDERS.classes, (
    Relation(NS + "holds", NS + "Person", NS + "Account", ("c_custkey",)),
    Relation(NS + "holds", NS + "Holder", NS + "Account", ("c_custkey",)),
    Relation(NS + "livesIn", NS + "Holder", NS + "Nation", ("c_nationkey",))))


@query("owl_inverse_functional", f"""
SELECT '{BASE}Person/' || url_encode(c_name) AS subject, '{NS}livesIn' AS predicate, {_nation} AS object FROM customer""")
def owl_inverse_functional(spark, folder):
    """Whoever holds one account is one: what is known of the holder is said of the person."""
    ontology = Ontology(object_properties=(ObjectProperty(NS + "holds", characteristics=("inverse_functional",)), ObjectProperty(NS + "livesIn")))
    found = triples.build(spark, _HOLDING, tables(spark, folder), maps=_HOLDING.restricted({NS + "holds", NS + "livesIn"}))
    return owl.closure(found, ontology).triples.select(*SPO)


@query("owl_max_one", f"""
SELECT '{BASE}Holder/' || c_custkey AS subject, '{NS}livesIn' AS predicate, {_nation} AS object FROM customer""")
def owl_max_one(spark, folder):
    """An account has one holder at most, said of the class and not of the property."""
    ontology = Ontology((OntologyClass(NS + "Account", restrictions=(Restriction(NS + "heldBy", "max", 1),)),),
                        (ObjectProperty(NS + "heldBy"), ObjectProperty(NS + "livesIn")))
    maps = _HOLDERS.restricted({RDF_TYPE, NS + "heldBy", NS + "livesIn"})
    found = triples.build(spark, _HOLDERS, tables(spark, folder), maps=maps)
    typed = (F.col("predicate") != RDF_TYPE) | (F.col("object") == NS + "Account")
    return owl.closure(found.where(typed), ontology).triples.select(*SPO)


@query("owl_noise", f"SELECT {_cust} AS subject, '{RDF_TYPE}' AS predicate, '{NS}Agent' AS object FROM customer")
def owl_noise(spark, folder):
    """Consequences that say nothing about entities are not kept: everything is a Thing, a name is a label."""
    ontology = Ontology(
        (OntologyClass(shop.CUSTOMER, parents=(NS + "Agent", OWL + "Thing", RDFS + "Resource")), OntologyClass(NS + "Agent")),
        data_properties=(DataProperty(NS + "name", parents=(RDFS_LABEL,)),))
    return _closed(spark, folder, ontology, "type", "name").triples.select(*SPO)
