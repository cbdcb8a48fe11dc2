from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import BASE, EX, iri
from semgraph.functions.templates import Slot, fill_text, join_template, rename_slots, slot_pattern, split_template
from semgraph.functions.terms import RDF_TYPE, XSD, fallback_label, iri_decode, iri_encode, local_name, number
from semgraph.operators import triples
from semgraph.plans.mapping import ClassMap, Mapping, Properties, Reference, Relation, Source, Term, TripleMap
from semgraph.sources.tables import guard_select, safe_name


def test_templates_split_escape_and_rename():
    assert split_template(r"a\{b\}{c}\\") == ("a{b}", Slot("c"), "\\")
    assert split_template('{"First Name"}x') == (Slot("First Name"), "x")
    assert join_template(split_template(r"\{{x}")) == r"\{{x}"
    assert rename_slots("{a}/{b}", ("a", "b"), ("x", "y"), "r") == "{x}/{y}"
    assert fill_text("e/{k}", {"K": "Zürich/HQ"}) == "e/Z%C3%BCrich%2FHQ"
    assert slot_pattern("a.b/{x}-{y}") == r"^a\.b/(.+?)-(.+?)$"
    for bad in ("{", "}", "{}", "a}b"):
        with pytest.raises(ValueError):
            split_template(bad)
    with pytest.raises(ValueError):
        rename_slots("{a}", ("a",), ("x", "y"), "r")


def test_encoding_follows_unreserved_characters(spark):
    text = "aZ09._~- */+%ü"
    df = spark.createDataFrame([(text,)], "x string").select(iri_encode(F.col("x")).alias("e"))
    row = df.select("e", iri_decode(F.col("e")).alias("d")).first()
    assert row["e"] == "aZ09._~-%20%2A%2F%2B%25%C3%BC"
    assert row["d"] == text


def test_names_and_numbers(spark):
    iris = ["http://a/b#c", "http://a/Employee/42", "http://a/Employee/42/", "http://a"]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(iris)], "n int, i string").orderBy("n").select(
        local_name(F.col("i")), fallback_label(F.col("i"))).collect()
    assert [tuple(r) for r in rows] == [("c", "c"), ("42", "Employee/42"), ("42", "Employee/42"), ("a", "a")]
    values = spark.createDataFrame([("12",), ("-1.5",), ("1e5",), (" 2",), ("x",)], "t string")
    assert [r[0] for r in values.select(number(F.col("t"))).collect()] == [12.0, -1.5, None, None, None]


def test_hr_triples(spark, hr):
    counts = {r["predicate"]: r["count"] for r in hr.graph.groupBy("predicate").count().collect()}
    assert counts == {
        RDF_TYPE: 6, EX + "name": 6, EX + "salary": 3, EX + "hired": 3, EX + "worksIn": 3, EX + "reportsTo": 2,
        EX + "collaboratesWith": 2,
    }
    salary = hr.graph.where((F.col("predicate") == EX + "salary") & (F.col("subject") == iri("Employee", 1))).first()
    assert (salary["object"], salary["datatype"], salary["object_type"]) == ("800", XSD + "decimal", "literal")
    assert not hr.graph.where("inferred").count()


def test_both_layouts_agree_and_branches_prune(spark, hr):
    virtual = triples.virtual(spark, hr.mapping, hr.tables.__getitem__)
    assert virtual.exceptAll(hr.graph).isEmpty() and hr.graph.exceptAll(virtual).isEmpty()
    plan = virtual.where(F.col("predicate") == EX + "worksIn")._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan


def test_restricted_and_one_class(spark, hr):
    only = triples.class_triples(spark, hr.mapping, EX + "Department", hr.tables.__getitem__)
    assert {r["predicate"] for r in only.select("predicate").distinct().collect()} == {RDF_TYPE, EX + "name"}
    some = triples.build(spark, hr.mapping, hr.tables.__getitem__, maps=hr.mapping.restricted({EX + "reportsTo"}))
    assert some.count() == 2


def test_directions(spark, hr):
    def ends(direction):
        relation = Relation(EX + "worksIn", EX + "Employee", EX + "Department", ("deptno",), direction=direction)
        mapping = Mapping(BASE, hr.mapping.classes, (relation,))
        found = triples.build(spark, mapping, hr.tables.__getitem__, maps=mapping.restricted({EX + "worksIn"}))
        return {(r["subject"], r["object"]) for r in found.collect()}

    forward, reverse = ends("forward"), ends("reverse")
    assert reverse == {(o, s) for s, o in forward} and ends("bidirectional") == forward | reverse


def test_joined_reference_keeps_fan_out_and_drops_dangling(spark, hr):
    departments = TripleMap("d", Source("departments"), Term(template=BASE + "dept/{dname}"))
    employees = TripleMap(
        "e", Source("employees"), Term(template=BASE + "e/{empno}"),
        properties=(Properties((Term(constant=EX + "in"),), (Reference("d", (("deptno", "deptno"),)),)),))
    doubled = {**hr.tables, "departments": hr.tables["departments"].union(hr.tables["departments"])}
    mapping = Mapping(BASE, extra_maps=(departments, employees))
    found = triples.build(spark, mapping, doubled.__getitem__)
    assert sorted(r["object"] for r in found.collect()) == [BASE + "dept/RESEARCH"] * 2 + [BASE + "dept/SALES"] * 2


def test_reference_without_join_needs_the_same_source(spark, hr):
    departments = TripleMap("d", Source("departments"), Term(template=BASE + "dept/{dname}"))
    employees = TripleMap("e", Source("employees"), Term(template=BASE + "e/{empno}"),
                          properties=(Properties((Term(constant=EX + "in"),), (Reference("d"),)),))
    with pytest.raises(ValueError):
        triples.build(spark, Mapping(BASE, extra_maps=(departments, employees)), hr.tables.__getitem__)


def test_keys_round_trip_through_iris(spark):
    line = Mapping(BASE, (ClassMap(EX + "Line", "lines", ("order_id", "line_no")),))
    found = triples.entity_keys(spark.createDataFrame([(BASE + "Line/A%2F1-7",), ("http://x/1",)], "subject string"),
                                line, EX + "Line")
    assert [tuple(r) for r in found.collect()] == [(BASE + "Line/A%2F1-7", "A/1", "7")]
    back = found.select(triples.iris_for(found, line, EX + "Line", ("order_id", "line_no")).alias("i")).first()
    assert back["i"] == BASE + "Line/A%2F1-7"


def test_bad_mappings():
    with pytest.raises(ValueError):
        Term(constant="a", column="b")
    with pytest.raises(ValueError):
        Term(column="a", kind="literal", datatype="x", lang="en")
    with pytest.raises(ValueError):
        Source()
    with pytest.raises(ValueError):
        Mapping(BASE, (ClassMap(EX + "A", "a", ("k",)), ClassMap(EX + "B", "b", ("x", "y"))),
                (Relation(EX + "r", EX + "A", EX + "B", ("z",)),)).triple_maps()


def test_guards():
    assert guard_select(" SELECT 1; ") == "SELECT 1"
    for bad in ("", "DROP TABLE x", "SELECT 1; SELECT 2", "selection"):
        with pytest.raises(ValueError):
            guard_select(bad)
    assert safe_name("a.b.c") == "`a`.`b`.`c`"
    for bad in ("a.b.c.d", "a b", "x;", ""):
        with pytest.raises(ValueError):
            safe_name(bad)
