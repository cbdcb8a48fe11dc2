"""Constraints and cohorts over the sample graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from semgraph.checks.registry import BASE, NS, XSD, iri_sql, query, shop_graph, tables
from semgraph.operators import cohorts, constraints, triples
from semgraph.operators.cohorts import Cohort, Criterion
from semgraph.operators.constraints import Constraint
from semgraph.plans import shop
from semgraph.plans.mapping import Attribute, ClassMap, Mapping, Relation
from semgraph.plans.ontology import Ontology, OntologyClass, Restriction
from semgraph.sources.tables import register_views

# A graph with something wrong in it: missing segments and nations, dangling nations, odd notes.
_FLAWED = (
    "SELECT c_custkey, c_name, nullif(c_mktsegment, 'BUILDING') AS segment, "
    "CASE WHEN c_acctbal < 0 THEN c_nationkey + 1000 WHEN c_mktsegment = 'FURNITURE' THEN NULL ELSE c_nationkey END AS nation, "
    "CASE WHEN c_mktsegment = 'MACHINERY' THEN 'unknown' ELSE CAST(c_acctbal AS VARCHAR(40)) END AS balance FROM customer"
)
_FLAWED_MAPPING = Mapping(
    BASE,
    (
        ClassMap(shop.CUSTOMER, query=_FLAWED, key=("c_custkey",),
                 attributes=(Attribute(NS + "name", "c_name"), Attribute(NS + "segment", "segment"),
                             Attribute(NS + "balance", "balance"))),
        ClassMap(shop.NATION, "nation", ("n_nationkey",), (Attribute(NS + "name", "n_name"),)),
        ClassMap(shop.SUPPLIER, "supplier", ("s_suppkey",), (Attribute(NS + "balance", "s_acctbal"),)),
        ClassMap(shop.PART, "part", ("p_partkey",), (Attribute(NS + "name", "p_name"), Attribute(NS + "size", "p_size"))),
    ),
    (
        Relation(NS + "inNation", shop.CUSTOMER, shop.NATION, ("nation",)),
        Relation(NS + "suppliedBy", shop.PART, shop.SUPPLIER, ("l_suppkey",), ("l_partkey",), table="lineitem"),
    ),
)


def flawed_graph(spark, folder):
    register_views(tables(spark, folder), ["customer"])
    return triples.build(spark, _FLAWED_MAPPING, tables(spark, folder))


_C = f"(SELECT '{BASE}Customer/' || c_custkey AS focus, * FROM ({_FLAWED}))"
_SHAPES: dict[str, tuple[Constraint, str]] = {}


def _shape(c: Constraint, sql: str) -> None:
    _SHAPES[c.name] = (c, sql)


_none = "CAST(NULL AS VARCHAR) AS value"
_shape(Constraint("min_count", shop.CUSTOMER, NS + "inNation", "min_count", 1, "warning"),
       f"SELECT focus, '0' AS value FROM {_C} WHERE nation IS NULL")
_shape(Constraint("max_count", shop.PART, NS + "suppliedBy", "max_count", 30),
       f"SELECT {iri_sql('Part', 'p_partkey')} AS focus, CAST(count(*) AS VARCHAR) AS value FROM part JOIN lineitem ON l_partkey = p_partkey "
       "GROUP BY p_partkey HAVING count(*) > 30")
_shape(Constraint("datatype", shop.PARTY, NS + "balance", "datatype", XSD + "double"),
       f"SELECT focus, balance AS value FROM {_C} WHERE balance IS NOT NULL")
_shape(Constraint("class", shop.CUSTOMER, NS + "inNation", "class", shop.NATION),
       f"SELECT focus, '{BASE}Nation/' || nation AS value FROM {_C} WHERE nation NOT IN (SELECT n_nationkey FROM nation)")
_shape(Constraint("pattern", shop.CUSTOMER, NS + "name", "pattern", "[13579]$", "info"),
       f"SELECT focus, c_name AS value FROM {_C} WHERE NOT regexp_matches(c_name, '[13579]$')")
_shape(Constraint("in", shop.CUSTOMER, NS + "segment", "in", ["AUTOMOBILE", "HOUSEHOLD"]),
       f"SELECT focus, segment AS value FROM {_C} WHERE segment NOT IN ('AUTOMOBILE', 'HOUSEHOLD')")
for _kind, _op in (("min_inclusive", ">="), ("max_inclusive", "<="), ("min_exclusive", ">"), ("max_exclusive", "<")):
    _shape(Constraint(_kind, shop.CUSTOMER, NS + "balance", _kind, 1000),
           f"SELECT focus, balance AS value FROM {_C} WHERE balance = 'unknown' OR NOT CAST(nullif(balance, 'unknown') AS DOUBLE) {_op} 1000")
_shape(Constraint("unique", shop.PART, NS + "name", "unique"),
       f"SELECT {iri_sql('Part', 'p_partkey')} AS focus, p_name AS value FROM part WHERE p_name IN "
       "(SELECT p_name FROM part GROUP BY 1 HAVING count(DISTINCT p_partkey) > 1)")
_shape(Constraint("node_kind", shop.CUSTOMER, NS + "segment", "node_kind", "iri"),
       f"SELECT focus, segment AS value FROM {_C} WHERE segment IS NOT NULL")
_shape(Constraint("require_label", shop.PARTY, None, "require_label"),
       f"SELECT {iri_sql('Supplier', 's_suppkey')} AS focus, {_none} FROM supplier")
_shape(Constraint("no_orphans", shop.CUSTOMER, None, "no_orphans"),
       f"SELECT focus, {_none} FROM {_C} WHERE nation IS NULL")
_shape(Constraint("has_value", shop.CUSTOMER, NS + "segment", "has_value", "HOUSEHOLD"),
       f"SELECT focus, {_none} FROM {_C} WHERE segment IS NULL OR segment <> 'HOUSEHOLD'")


def _register_shape(c: Constraint, sql: str) -> None:
    @query(f"shape_{c.name}", sql)
    def run(spark, folder):
        return constraints.violations(flawed_graph(spark, folder), c, shop.ONTOLOGY)


for _constraint, _sql in list(_SHAPES.values()):
    _register_shape(_constraint, _sql)

_targets = {
    shop.CUSTOMER: "(SELECT count(*) FROM customer)", shop.PART: "(SELECT count(*) FROM part)",
    shop.PARTY: "(SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier)",
}
_report_sql = " UNION ALL ".join(
    f"SELECT '{c.name}' AS \"constraint\", '{c.kind}' AS kind, '{c.severity}' AS severity, CAST({_targets[c.target_class]} AS BIGINT) AS targets, "
    f"(SELECT count(*) FROM ({sql})) AS violations" for c, sql in _SHAPES.values()
)
_all = [c for c, _ in _SHAPES.values()]


@query("shape_report", _report_sql)
def shape_report(spark, folder):
    report, _ = constraints.validate(flawed_graph(spark, folder), _all, shop.ONTOLOGY)
    return report.drop("message")


@query("shape_summary", f"""
SELECT CAST(sum(violations) FILTER (WHERE severity = 'violation') AS BIGINT) AS violation,
 CAST(sum(violations) FILTER (WHERE severity = 'warning') AS BIGINT) AS warning,
 CAST(sum(violations) FILTER (WHERE severity = 'info') AS BIGINT) AS info,
 sum(violations) FILTER (WHERE severity = 'violation') = 0 AS conforms FROM ({_report_sql})""")
def shape_summary(spark, folder):
    return constraints.summary(constraints.validate(flawed_graph(spark, folder), _all, shop.ONTOLOGY)[0])


_some = [n for n in ("min_count", "class", "in", "unique")]
_sampled = " UNION ALL ".join(f"SELECT '{n}' AS \"constraint\", focus, value FROM ({_SHAPES[n][1]})" for n in _some)


@query("shape_samples", f"""SELECT "constraint", focus, value, position FROM (
 SELECT *, row_number() OVER (PARTITION BY "constraint" ORDER BY focus, value) AS position FROM ({_sampled})) WHERE position <= 20""")
def shape_samples(spark, folder):
    _, broken = constraints.validate(flawed_graph(spark, folder), [_SHAPES[n][0] for n in _some], shop.ONTOLOGY)
    return constraints.samples(broken)


_RESTRICTED = Ontology(
    (OntologyClass(shop.CUSTOMER, restrictions=(
        Restriction(NS + "inNation", "exactly", 1), Restriction(NS + "segment", "some", shop.CUSTOMER),
        Restriction(NS + "segment", "has_value", "HOUSEHOLD"))),
     OntologyClass(shop.NATION)),
    shop.ONTOLOGY.object_properties[1:2],
)


@query("shape_derived", f"""
SELECT 'Customer/inNation: class' AS "constraint", count(*) AS violations FROM ({_SHAPES['class'][1]})
UNION ALL SELECT 'Customer/inNation: max_count', 0
UNION ALL SELECT 'Customer/inNation: min_count', count(*) FROM ({_SHAPES['min_count'][1]})
UNION ALL SELECT 'Customer/segment: in', count(*) FROM {_C} WHERE segment <> 'HOUSEHOLD'
UNION ALL SELECT 'Customer/segment: min_count', count(*) FROM {_C} WHERE segment IS NULL""")
def shape_derived(spark, folder):
    derived = constraints.from_ontology(_RESTRICTED)
    return constraints.validate(flawed_graph(spark, folder), derived, _RESTRICTED)[0].select("constraint", "violations")


@query("shape_validation_rows", f"""
SELECT focus, '{NS}inNation' AS path, value, 'Customer/inNation: class' AS shape FROM ({_SHAPES['class'][1]})
UNION ALL SELECT focus, '{NS}inNation', value, 'Customer/inNation: min_count' FROM ({_SHAPES['min_count'][1]})
UNION ALL SELECT focus, '{NS}segment', NULL, 'Customer/segment: in' FROM ({_SHAPES['has_value'][1]})
UNION ALL SELECT focus, '{NS}segment', '0', 'Customer/segment: min_count' FROM {_C} WHERE segment IS NULL""")
def shape_validation_rows(spark, folder):
    rows = constraints.validation_rows(flawed_graph(spark, folder), constraints.shapes(_RESTRICTED), _RESTRICTED)
    return rows.select("focus", "path", "value", "shape")


# -- cohorts -----------------------------------------------------------------------------------------------------------

_cust = iri_sql("Customer", "c_custkey")


def _people(spark, folder):
    return shop_graph(spark, folder, "type", "name", "balance", "segment", "inNation", "placedBy", "orderDate")


def _register_cohort(cohort: Cohort, where: str, why: str) -> None:
    sql = f"SELECT {_cust} AS subject, {why} AS explanation FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE {where}"

    @query(f"cohort_{cohort.name}", sql)
    def run(spark, folder):
        found = cohorts.evaluate(_people(spark, folder), cohort, shop.ONTOLOGY, limit=None, label=False)
        return found.select("subject", F.array_join("explanation", "; ").alias("explanation"))

    @query(f"cohort_{cohort.name}_size", f"SELECT '{cohort.name}' AS cohort, (SELECT count(*) FROM ({sql})) AS size, "
                                         "(SELECT count(*) FROM customer) AS candidates")
    def size(spark, folder):
        return cohorts.size(_people(spark, folder), cohort, shop.ONTOLOGY)


@query("cohort_not_a_number", f"SELECT {_cust} AS subject FROM customer WHERE c_acctbal > 100 AND c_mktsegment <> 'BUILDING'")
def cohort_not_a_number(spark, folder):
    """Balances of one segment read NaN: no number is above or below that."""
    people = _people(spark, folder)
    of = people.where((F.col("predicate") == NS + "segment") & (F.col("object") == "BUILDING")).select("subject", F.lit(True).alias("_of"))
    value = F.when(F.col("_of") & (F.col("predicate") == NS + "balance"), "NaN").otherwise(F.col("object"))
    changed = people.join(of, "subject", "left").withColumn("object", value).drop("_of")
    above = Cohort("above", shop.CUSTOMER, (Criterion("attribute", NS + "balance", "gt", 100),))
    return cohorts.evaluate(changed, above, shop.ONTOLOGY, label=False).select("subject")


_rich = Criterion("attribute", NS + "balance", "gte", 5000)
_near = Criterion("related_attribute", NS + "inNation", "contains", "on_1", NS + "name")
_register_cohort(
    Cohort("all", shop.CUSTOMER, (_rich, Criterion("relation", NS + "inNation", "exists"), _near)),
    "c_acctbal >= 5000 AND contains(lower(n_name), 'on_1')",
    "'balance = ' || c_acctbal || ' (>= 5000); inNation -> ' || c_nationkey || ' exists; inNation -> name = ' || n_name || ' (contains on_1)'",
)
_register_cohort(
    Cohort("any", shop.CUSTOMER, (Criterion("attribute", NS + "balance", "lt", 0),
                                  Criterion("attribute", NS + "segment", "eq", "BUILDING")), "any"),
    "c_acctbal < 0 OR c_mktsegment = 'BUILDING'",
    "concat_ws('; ', CASE WHEN c_acctbal < 0 THEN 'balance = ' || c_acctbal || ' (< 0)' END, "
    "CASE WHEN c_mktsegment = 'BUILDING' THEN 'segment = BUILDING (= BUILDING)' END)",
)
_register_cohort(
    Cohort("idle", shop.CUSTOMER, (Criterion("attribute", NS + "orderDate", "missing"),
                                   Criterion("relation", NS + "placedBy", "not_exists"),
                                   Criterion("attribute", NS + "name", "matches", "[05]$"))),
    "regexp_matches(c_name, '[05]$')",
    "'orderDate missing; no placedBy; name = ' || c_name || ' (~ [05]$)'",
)
_register_cohort(
    Cohort("home", shop.CUSTOMER, (Criterion("relation", NS + "inNation", "eq", BASE + "Nation/7"),
                                   Criterion("attribute", NS + "segment", "neq", "MACHINERY"),
                                   Criterion("attribute", NS + "name", "exists"))),
    "c_nationkey = 7 AND c_mktsegment <> 'MACHINERY'",
    "'inNation -> 7; segment = ' || c_mktsegment || ' (!= MACHINERY); name = ' || c_name",
)


@query("cohort_labelled", f"SELECT {_cust} AS subject, c_name AS label FROM customer WHERE c_acctbal >= 5000 ORDER BY subject LIMIT 1000")
def cohort_labelled(spark, folder):
    """The first thousand in the order of their IRIs, as the SQL asks."""
    found = cohorts.evaluate(_people(spark, folder), Cohort("rich", shop.CUSTOMER, (_rich,)), shop.ONTOLOGY, limit=1000)
    return found.select("subject", "label").orderBy("subject")


@query("cohort_triples", f"SELECT {_cust} AS subject, 'urn:semgraph:analytics#inCohort' AS predicate, '{BASE}cohort/rich' AS object, "
                         "true AS inferred FROM customer WHERE c_acctbal >= 5000")
def cohort_triples(spark, folder):
    rich = Cohort("rich", shop.CUSTOMER, (_rich,))
    found = _people(spark, folder)
    members = cohorts.evaluate(found, rich, shop.ONTOLOGY, limit=None, label=False)
    return cohorts.replace_members(found.where("inferred"), rich, members, BASE).select(
        "subject", "predicate", "object", "inferred"
    )
