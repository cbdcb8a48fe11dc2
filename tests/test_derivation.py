"""Constraints, cohorts, rules and OWL consequences."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from conftest import BASE, EX, iri
from semgraph.functions.terms import RDF_TYPE, TRIPLE_SCHEMA
from semgraph.functions.scratch import Scratch
from semgraph.operators import cohorts, constraints, owl, reach, rules, triples
from semgraph.operators.cohorts import Cohort, CohortError, Criterion
from semgraph.operators.constraints import Constraint, ConstraintError
from semgraph.operators.rules import Atom, Rule, RuleError
from semgraph.plans.mapping import Attribute, ClassMap, Mapping, Relation
from semgraph.plans.ontology import DataProperty, ObjectProperty, Ontology, OntologyClass, Restriction

EMPLOYEE, DEPARTMENT, SHOP = EX + "Employee", EX + "Department", "http://s/ns#"


def spo(df) -> set[tuple[str, str, str]]:
    short = lambda x: x.replace(EX, "").replace(BASE, "").replace(RDF_TYPE, "a")
    return {tuple(short(v) for v in (r["subject"], r["predicate"], r["object"])) for r in df.collect()}


# -- constraints --------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def small_shop(spark):
    """Nine parts from three suppliers in two nations, one of which is not there; prices in steps, one of them a word."""
    parts = [(k, f"part {k % 4}", None if k == 8 else "dear" if k == 5 else str(100 * k), k % 3) for k in range(9)]
    tables = {
        "part": spark.createDataFrame(parts, "id int, name string, price string, supplier int"),
        "supplier": spark.createDataFrame([(0, 7), (1, 7), (2, 90)], "id int, nation int"),
        "nation": spark.createDataFrame([(7, "Utopia"), (8, "Laputa")], "id int, name string"),
    }
    mapping = Mapping("http://s/", (
        ClassMap(SHOP + "Part", "part", ("id",), (Attribute(SHOP + "name", "name"), Attribute(SHOP + "price", "price"))),
        ClassMap(SHOP + "Supplier", "supplier", ("id",)), ClassMap(SHOP + "Nation", "nation", ("id",), (Attribute(SHOP + "name", "name"),)),
    ), (Relation(SHOP + "from", SHOP + "Part", SHOP + "Supplier", ("supplier",)), Relation(SHOP + "in", SHOP + "Supplier", SHOP + "Nation", ("nation",))))
    return triples.build(spark, mapping, tables.__getitem__)


def at(cls: str, key: int) -> str:
    return f"http://s/{cls}/{key}"


def test_constraint_report(small_shop):
    checks = [
        Constraint("nameless", SHOP + "Supplier", None, "require_label", severity="info"),
        Constraint("priced", SHOP + "Part", SHOP + "price", "min_count", 1),
        Constraint("cheap", SHOP + "Part", SHOP + "price", "max_exclusive", 600, "warning"),
        Constraint("own name", SHOP + "Part", SHOP + "name", "unique"),
        Constraint("known nation", SHOP + "Supplier", SHOP + "in", "class", SHOP + "Nation"),
        Constraint("used", SHOP + "Nation", None, "no_orphans"),
    ]
    report, broken = constraints.validate(small_shop, checks)
    found = {}
    for r in broken.collect():
        found.setdefault(r["constraint"], set()).add((r["focus"], r["value"]))
    assert found == {
        "nameless": {(at("Supplier", k), None) for k in range(3)}, "priced": {(at("Part", 8), "0")},
        "cheap": {(at("Part", 5), "dear"), (at("Part", 6), "600"), (at("Part", 7), "700")},
        "own name": {(at("Part", k), f"part {k % 4}") for k in range(9)}, "known nation": {(at("Supplier", 2), at("Nation", 90))},
        "used": {(at("Nation", 8), None)},
    }
    assert {r["constraint"]: (r["targets"], r["violations"]) for r in report.collect()} == {
        "nameless": (3, 3), "priced": (9, 1), "cheap": (9, 3), "own name": (9, 9), "known nation": (3, 1), "used": (2, 1)}
    total = constraints.summary(report).first()
    assert (total["violation"], total["warning"], total["info"], total["conforms"]) == (12, 3, 3, False)
    for c in checks:  # the compiled report holds what each constraint finds alone
        alone = constraints.violations(small_shop, c)
        assert {(r["focus"], r["value"]) for r in alone.collect()} == found[c.name]


def test_constraint_report_reads_the_graph_twice(spark, small_shop, tmp_path, monkeypatch):
    """However many constraints there are; more sums than fit one pass cost one more each."""
    small_shop.write.parquet(str(tmp_path / "graph"))
    graph, scans = spark.read.parquet(str(tmp_path / "graph")), []
    save = constraints.Scratch.save
    monkeypatch.setattr(constraints.Scratch, "save", lambda self, df, *a, **k: (
        scans.append(df._jdf.queryExecution().executedPlan().toString().count(str(tmp_path / "graph"))), save(self, df, *a, **k))[1])
    checks = [Constraint(f"c{i}", SHOP + "Part", SHOP + "price", kind, value) for i, (kind, value) in enumerate(
        [("min_count", i) for i in range(9)] + [("max_inclusive", i) for i in range(9)] + [("unique", None), ("in", ["1"])])]
    constraints.validate(graph, checks)
    assert sum(scans) == 2
    scans.clear()
    many = [Constraint(f"n{i}", SHOP + "Part", SHOP + f"p{i}", "max_count", 0) for i in range(100)]
    report, broken = constraints.validate(graph, many)
    assert report.count() == 100 and broken.isEmpty() and sum(scans) == 3


def test_constraints_reach_subclasses(hr):
    orphan = Constraint("o", EX + "Person", None, "no_orphans")
    assert constraints.violations(hr.graph, orphan, hr.ontology).isEmpty()
    assert constraints.validate(hr.graph, [orphan], hr.ontology)[0].first()["targets"] == 4
    assert constraints.validate(hr.graph, [orphan])[0].first()["targets"] == 0


def test_constraints_from_an_ontology():
    ontology = Ontology(
        (OntologyClass(EX + "P", restrictions=(Restriction(EX + "n", "min", 1),)),
         OntologyClass(EX + "E", (EX + "P",), restrictions=(Restriction(EX + "n", "min", 3), Restriction(EX + "n", "exactly", 5)))),
        (ObjectProperty(EX + "w", EX + "P", EX + "D", characteristics=("functional",)),),
        (DataProperty(EX + "s", EX + "E", "xsd:decimal"),))
    got = {c.name: c.value for c in constraints.from_ontology(ontology)}
    assert got["E/n: min_count"] == 5 and got["P/n: min_count"] == 1
    assert got["E/w: class"] == EX + "D" and got["E/w: max_count"] == 1
    assert got["E/s: datatype"] == "xsd:decimal" and "P/s: datatype" not in got


def test_bad_constraints():
    for args in (("x", "magic", 1), ("x", "min_count", "a"), ("x", "in", "a"), ("x", "node_kind", "thing"), (None, "pattern", "a"), ("x", "pattern", None)):
        with pytest.raises(ConstraintError):
            Constraint("c", EMPLOYEE, args[0], args[1], args[2])
    with pytest.raises(ConstraintError):
        Constraint("c", EMPLOYEE, "x", "unique", None, "fatal")


# -- cohorts ------------------------------------------------------------------------------------------------

def test_cohort_of_parts(small_shop):
    """Parts at 300 or more whose supplier sits in a nation with a name in u."""
    cohort = Cohort("imported", SHOP + "Part", (
        Criterion("related_attribute", SHOP + "from", "missing", None, SHOP + "name"), Criterion("relation", SHOP + "from", "exists"),
        Criterion("attribute", SHOP + "price", "gte", 300)))
    found = cohorts.evaluate(small_shop, cohort).collect()
    assert {r["subject"] for r in found} == {at("Part", k) for k in (3, 4, 6, 7)} and {len(r["explanation"]) for r in found} == {3}
    assert {r["label"] for r in found} == {"part 0", "part 2", "part 3"}
    size = cohorts.size(small_shop, cohort).first()
    assert (size["size"], size["candidates"]) == (4, 9)
    members = cohorts.evaluate(small_shop, cohort, limit=None, label=False)
    layer = cohorts.member_triples(members, cohort, "http://s/")
    fewer = cohorts.replace_members(layer, cohort, members.where(F.col("subject") == at("Part", 3)), "http://s/")
    assert fewer.count() == 1 and fewer.first()["object"] == "http://s/cohort/imported"


def test_cohort_operators(small_shop):
    def members(*criteria, match="all"):
        found = cohorts.evaluate(small_shop, Cohort("c", SHOP + "Part", criteria, match), label=False)
        return {int(r["subject"].rsplit("/", 1)[-1]) for r in found.collect()}

    price, name = SHOP + "price", SHOP + "name"
    assert members(Criterion("attribute", price, "missing")) == {8}
    assert members(Criterion("attribute", name, "matches", "[02]$"), Criterion("attribute", price, "lt", 400)) == {0, 2}
    assert members(Criterion("attribute", name, "contains", "T 3"), Criterion("attribute", price, "gte", 700), match="any") == {3, 7}
    assert members(Criterion("relation", SHOP + "from", "eq", at("Supplier", 2))) == {2, 5, 8}
    assert members(Criterion("relation", SHOP + "in", "not_exists")) == set(range(9))


def test_bad_cohorts():
    with pytest.raises(CohortError):
        Criterion("attribute", "p", "gt")
    with pytest.raises(CohortError):
        Criterion("related_attribute", "p", "exists")
    with pytest.raises(CohortError):
        Cohort("bad name", EMPLOYEE, (Criterion("attribute", "p", "exists"),))


# -- rules ------------------------------------------------------------------------------------------------

def has(p, x, y):
    return Atom("property", EX + p, (x, y))


def test_rules_to_a_fixpoint(hr):
    found = rules.infer(hr.graph, [
        Rule("up", (has("collaboratesWith", "?x", "?y"),), (has("linked", "?x", "?y"),)),
        Rule("on", (has("linked", "?x", "?y"), has("linked", "?y", "?z")), (has("linked", "?x", "?z"),))])
    assert spo(found.triples) == {("Employee/1", "linked", "Employee/2"), ("Employee/2", "linked", "Employee/3"),
                                  ("Employee/1", "linked", "Employee/3")}
    assert {r["rule"]: r["n"] for r in found.per_rule.collect()} == {"up": 2, "on": 1}
    again = rules.infer(hr.graph.unionByName(found.triples), [Rule("up", (has("collaboratesWith", "?x", "?y"),), (has("linked", "?x", "?y"),))])
    assert again.triples.isEmpty()


def test_rule_builtins_and_literals(hr):
    rich = Rule("rich", (Atom("class", EMPLOYEE, ("?x",)), has("salary", "?x", "?s"), Atom("builtin", "greaterThan", ("?s", 700))),
                (Atom("class", EX + "Rich", ("?x",)), has("pay", "?x", "?s"), has("band", "?x", "high")))
    found = rules.infer(hr.graph, [rich]).triples
    assert spo(found.where(F.col("predicate") == RDF_TYPE)) == {("Employee/1", "a", "Rich"), ("Employee/3", "a", "Rich")}
    pay = found.where(F.col("predicate") == EX + "pay").first()
    assert pay["object_type"] == "literal" and pay["datatype"].endswith("decimal")
    low = Rule("low", (has("salary", "?x", "?s"), Atom("builtin", "lessThan", ("?s", 600))), (Atom("class", EX + "Low", ("?x",)),), "violation")
    assert rules.violations(hr.graph, [low]).first()["bindings"] == {"x": iri("Employee", 4), "s": "500"}


def test_rule_existence_and_links_without_cross_products(hr):
    exists = Rule("e", (Atom("class", DEPARTMENT, ("?d",)), has("name", "?y", "WARD")), (Atom("class", EX + "Known", ("?d",)),))
    assert len(spo(rules.infer(hr.graph, [exists]).triples)) == 2
    none = Rule("n", (Atom("class", DEPARTMENT, ("?d",)), has("name", "?y", "NOBODY")), (Atom("class", EX + "Known", ("?d",)),))
    assert rules.infer(hr.graph, [none]).triples.isEmpty()
    linked = Rule("l", (has("name", "?x", "?a"), has("name", "?y", "?b"), Atom("builtin", "equal", ("?a", "?b"))), (has("same", "?x", "?y"),))
    assert rules.infer(hr.graph, [linked]).triples.count() == 6
    pairs = Rule("p", (Atom("class", DEPARTMENT, ("?d",)), Atom("class", EMPLOYEE, ("?x",))), (has("near", "?d", "?x"),))
    with pytest.raises(RuleError):
        rules.infer(hr.graph, [pairs])


def test_rule_limits_and_checks(hr):
    grow = [Rule("up", (has("collaboratesWith", "?x", "?y"),), (has("l", "?x", "?y"),)),
            Rule("on", (has("l", "?x", "?y"), has("l", "?y", "?z")), (has("l", "?x", "?z"),))]
    with pytest.raises(RuleError):
        rules.infer(hr.graph, grow, max_rounds=1)
    with pytest.raises(RuleError):
        Rule("r", (has("p", "?x", "?y"),), (has("q", "?x", "?z"),))
    with pytest.raises(RuleError):
        rules.infer(hr.graph, [grow[0], grow[0]])


def test_strata_run_rules_once(hr, monkeypatch):
    step = lambda a, b: Rule(f"{a}>{b}", (has(a, "?x", "?y"),), (has(b, "?x", "?y"),))
    chain = [step("p3", "p4"), step("p2", "p3"), step("p1", "p2"), step("collaboratesWith", "p1")]
    loop = [step("p4", "q"), step("q", "r"), step("r", "q"), step("r", "out")]
    assert [[r.name for r in s.rules] for s in rules.strata(chain + loop)] == [
        ["collaboratesWith>p1"], ["p1>p2"], ["p2>p3"], ["p3>p4"], ["p4>q"], ["q>r", "r>q"], ["r>out"]]
    assert [len(s.looping) for s in rules.strata(chain + loop)] == [0, 0, 0, 0, 0, 2, 0]
    joined = []
    bindings = rules.bindings
    monkeypatch.setattr(rules, "bindings", lambda facts, rule, *more: (joined.append(rule.name), bindings(facts, rule, *more))[1])
    found = rules.infer(hr.graph, chain)
    assert sorted(joined) == sorted(r.name for r in chain) and found.rounds == 4 and found.triples.count() == 8
    joined.clear()
    assert rules.infer(hr.graph, chain + loop).triples.count() == 14
    assert all(joined.count(r.name) == 1 for r in (*chain, loop[0], loop[3]))


# -- reach ------------------------------------------------------------------------------------------------

def plain_closure(links):
    out, ahead = set(), {}
    for a, b in links:
        ahead.setdefault(a, set()).add(b)
    for start in ahead:
        seen, todo = set(), list(ahead[start])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += ahead.get(x, ())
        out |= {(start, x) for x in seen}
    return out


def graphs():
    name = lambda k: f"n{k:03d}"
    pick = random.Random(3)
    yield "ring with a tail and an exit", [(name(k), name((k + 1) % 20)) for k in range(20)] + [("t0", "t1"), ("t1", name(4)), (name(9), "e0"), ("e0", "e1")]
    yield "loops on a path", [("a", "a"), ("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "f"), ("f", "f"), (None, "a")]
    yield "random", [(name(pick.randrange(60)), name(pick.randrange(60))) for _ in range(75)]


@pytest.mark.parametrize("what, links", list(graphs()), ids=[w for w, _ in graphs()])
def test_closure_of_any_graph(spark, what, links):
    df = spark.createDataFrame(links, "a string, b string")
    rows = reach.closed(Scratch(spark, "test"), df).collect()
    want = plain_closure([x for x in links if None not in x])
    assert len(rows) == len(want) and {tuple(r) for r in rows} == want


def test_cycles_are_contracted_before_they_are_closed(spark):
    ring = [(f"n{k:03d}", f"n{(k + 1) % 70:03d}") for k in range(70)] + [("in", "n005"), ("n006", "out")]
    member = reach.condensed(Scratch(spark, "test"), spark.createDataFrame(ring, "a string, b string"))
    assert {tuple(r) for r in member.collect()} == {(f"n{k:03d}", "n000") for k in range(70)}
    assert reach.condensed(Scratch(spark, "test"), spark.createDataFrame([("a", "b"), ("b", "c")], "a string, b string")) is None


# -- OWL ----------------------------------------------------------------------------------------------------

def test_only_facts_of_merged_terms_are_derived_from_again(spark, hr):
    """One merge in a graph of 60 other facts: what is fed again are the facts that name the merged terms."""
    rows = [("a", "has", "x"), ("a", "has", "y"), ("y", "likes", "z")] + [(f"s{k}", "likes", f"o{k}") for k in range(60)]
    data = spark.createDataFrame([(BASE + s, EX + p, BASE + o, "iri", None, None, False, None) for s, p, o in rows], TRIPLE_SCHEMA)
    ontology = Ontology((), (ObjectProperty(EX + "has", characteristics=("functional",)), ObjectProperty(EX + "likes", parents=(EX + "knows",)),
                             ObjectProperty(EX + "knows")))
    found = owl.closure(data, ontology)
    assert found.rederived == [2]  # y likes z, y knows z; a has y is a has x by then
    assert spo(found.triples) >= {("x", "likes", "z"), ("x", "knows", "z"), ("y", "knows", "z")} and found.triples.count() == 63


def test_owl_closure(hr):
    ontology = Ontology(
        (OntologyClass(EX + "Person"), OntologyClass(EMPLOYEE, (EX + "Person",), equivalent=(EX + "Staff",), disjoint=(EX + "Contractor",)),
         OntologyClass(EX + "Staff"), OntologyClass(EX + "Contractor"), OntologyClass(DEPARTMENT)),
        (
            ObjectProperty(EX + "worksIn", EMPLOYEE, DEPARTMENT), ObjectProperty(EX + "hasMember", inverse_of=EX + "worksIn"),
            ObjectProperty(EX + "reportsTo", characteristics=("transitive",), inverse_of=EX + "manages"), ObjectProperty(EX + "manages"),
            ObjectProperty(EX + "knows"), ObjectProperty(EX + "colleague", chains=((EX + "worksIn", EX + "hasMember"),)),
            ObjectProperty(EX + "collaboratesWith", parents=(EX + "knows",), characteristics=("symmetric",)),
        ))
    contractor = hr.graph.where(F.col("predicate") == RDF_TYPE).limit(1).select(
        F.lit(iri("Employee", 3)).alias("subject"), "predicate", F.lit(EX + "Contractor").alias("object"), "object_type",
        "datatype", "lang", "inferred", "source_table")
    chain = contractor.select(F.lit(iri("Employee", 1)).alias("subject"), F.lit(EX + "reportsTo").alias("predicate"),
                              F.lit(iri("Employee", 9)).alias("object"), "object_type", "datatype", "lang", "inferred", "source_table")
    data = hr.graph.unionByName(contractor).unionByName(chain)
    found = owl.closure(data, ontology)
    got = spo(found.triples)
    assert {
        ("Employee/2", "reportsTo", "Employee/9"), ("Employee/2", "collaboratesWith", "Employee/1"), ("Employee/1", "knows", "Employee/2"),
        ("Employee/1", "manages", "Employee/2"), ("Employee/1", "colleague", "Employee/1"), ("Employee/1", "a", "Staff"),
        ("Employee/1", "a", "Person"), ("Department/99", "a", "Department"),
    } <= got
    assert [r["subject"] for r in found.inconsistent.collect()] == [iri("Employee", 3)]
    again = owl.closure(data.unionByName(found.triples), ontology)
    assert spo(again.triples) == got


def test_owl_equality_and_restrictions(spark, hr):
    rows = [("a", "has", "x"), ("a", "has", "y"), ("y", "likes", "z"), ("q", "likes", "x")]
    data = spark.createDataFrame(
        [(BASE + s, EX + p, BASE + o, "iri", None, None, False, None) for s, p, o in rows]
        + [(BASE + "a", RDF_TYPE, EX + "Owner", "iri", None, None, False, None)], hr.graph.select("*").schema.simpleString()[7:-1].replace(":", " "))
    ontology = Ontology(
        (OntologyClass(EX + "Owner", restrictions=(Restriction(EX + "colour", "has_value", "red"), Restriction(EX + "has", "only", EX + "Thing"))),),
        (ObjectProperty(EX + "has", characteristics=("functional",)), ObjectProperty(EX + "likes")))
    assert spo(owl.closure(data, ontology).triples) == {
        ("x", "likes", "z"), ("q", "likes", "y"), ("a", "colour", "red"), ("x", "a", "Thing"), ("y", "a", "Thing")}
