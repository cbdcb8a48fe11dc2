from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import EX, iri
from semgraph.functions.terms import RDF_TYPE, TRIPLE_SCHEMA
from semgraph.operators import graph


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_aggregate_by_relation_with_labels(hr):
    found = graph.aggregate(hr.graph, EX + "Employee", measure=EX + "salary", group_by=[EX + "worksIn"])
    by_label = {r["label"]: r for r in found.collect()}
    assert (by_label["SALES"]["count"], by_label["SALES"]["sum"]) == (1, 800.0)
    assert by_label["RESEARCH"]["sum"] is None
    assert by_label["SALES"]["group"] == iri("Department", 10)


def test_aggregate_by_year_filters_and_totals(hr):
    years = graph.aggregate(hr.graph, EX + "Employee", group_by=EX + "hired", group_kind="year", label=False)
    assert {r["group"]: r["count"] for r in years.collect()} == {"2020": 1, "2021": 1, "2022": 1, None: 1}
    one = graph.aggregate(hr.graph, EX + "Employee", measure=EX + "salary", label=False,
                          filters=[([EX + "worksIn"], iri("Department", 10))]).collect()
    assert [(r["count"], r["sum"]) for r in one] == [(1, 800.0)]
    back = graph.aggregate(hr.graph, EX + "Department", label=False,
                           filters=[(["^" + EX + "worksIn", EX + "name"], "SMITH")]).first()
    assert back["count"] == 1
    total = graph.aggregate(hr.graph, EX + "Employee", measure=EX + "salary", label=False).first()
    assert (total["count"], total["sum"], total["min"], total["max"]) == (4, 2550.0, 500.0, 1250.0)


def test_repeated_group_path_repeats_the_measure(hr):
    twice = hr.graph.unionByName(hr.graph.where((F.col("predicate") == EX + "worksIn")))
    plain = graph.aggregate(twice, EX + "Employee", measure=EX + "salary", group_by=[EX + "worksIn"], label=False)
    once = graph.aggregate(twice, EX + "Employee", measure=EX + "salary", group_by=[EX + "worksIn"], label=False, dedupe=True)
    pick = lambda df: next(r for r in df.collect() if r["group"] == iri("Department", 10))
    assert (pick(plain)["count"], pick(plain)["sum"]) == (1, 1600.0)
    assert (pick(once)["count"], pick(once)["sum"]) == (1, 800.0)


def test_search(hr):
    assert rows(graph.search(hr.graph, "smi"), "subject", "label") == [(iri("Employee", 1), "SMITH")]
    assert graph.search(hr.graph, "S%", field="label").isEmpty()
    assert rows(graph.search(hr.graph, "ard", match="ends_with", field="label"), "subject") == [(iri("Employee", 3),)]
    typed = graph.search(hr.graph, "1", type_iri=EX + "Department", field="iri", label=False)
    assert rows(typed, "subject") == [(iri("Department", 10),)]
    many = graph.search_many(hr.graph, ["smi", "sales", "none"], field="label")
    assert rows(many, "query", "subject") == [("sales", iri("Department", 10)), ("smi", iri("Employee", 1))]
    with pytest.raises(ValueError):
        graph.search(hr.graph, "x", match="fuzzy")


def test_neighbourhood(spark, hr):
    seed = spark.createDataFrame([(iri("Employee", 1),)], "iri string")
    nodes, edges = graph.neighbourhood(hr.graph, seed, 1)
    assert {r["node"] for r in nodes.collect()} == {iri("Employee", n) for n in (1, 2, 3)} | {iri("Department", 10)}
    assert edges.count() == 4
    nodes, edges = graph.neighbourhood(hr.graph, seed, 2, limit=3)
    assert [r["node"] for r in nodes.orderBy("distance", "node").collect()] == [
        iri("Employee", 1), iri("Department", 10), iri("Employee", 2)]
    nodes, _ = graph.neighbourhood(hr.graph, seed, 0)
    assert nodes.count() == 1


def test_describe_unknown_and_context(spark, hr):
    known = spark.createDataFrame([(iri("Employee", 1),), (iri("Employee", 77),)], "iri string")
    facts = graph.describe(hr.graph, known)
    assert {r["iri"] for r in facts.select("iri").distinct().collect()} == {iri("Employee", 1)}
    counts = {r["section"]: r["count"] for r in facts.groupBy("section").count().collect()}
    assert counts == {"type": 1, "attribute": 3, "outgoing": 2, "incoming": 2}
    context = graph.context(hr.graph, known, hr.mapping).first()
    assert (context["label"], context["out_degree"], context["in_degree"], context["source_table"]) == (
        "SMITH", 2, 2, "employees")


def test_class_views(hr):
    people = graph.class_view(hr.graph, hr.ontology, EX + "Person")
    assert people.count() == 4
    employee = {r["label"]: r for r in graph.class_view(hr.graph, hr.ontology, EX + "Employee").collect()}
    assert employee["WARD"]["salary"] == 1250.0 and employee["ALLEN"]["salary"] is None
    assert graph.class_view(hr.graph, hr.ontology, EX + "Employee", search_text="smi").count() == 1
    related = graph.class_relations(hr.graph, hr.ontology, EX + "Employee")
    assert ("reportsTo", "SMITH") in rows(related, "relation", "target_label")


def test_classes(hr):
    edges = graph.class_edges(hr.graph)
    assert (EX + "Employee", EX + "worksIn", EX + "Department", 2) in rows(
        edges, "source_class", "predicate", "target_class", "n")
    path = graph.class_paths(edges, EX + "Department", EX + "Employee").first()
    assert path["steps"] == ["^" + EX + "worksIn"]
    counts = dict(rows(graph.instance_counts(hr.graph, hr.ontology), "class", "instances"))
    assert counts[EX + "Person"] == 4


def test_inventories_and_pages(hr):
    assert rows(graph.type_inventory(hr.graph), "type", "n") == [(EX + "Department", 2), (EX + "Employee", 4)]
    card = graph.status(hr.graph)
    assert card.where("section = 'total'").first()["n"] == 25
    assert card.where("section = 'type'").count() == 2
    total, page = graph.page(hr.graph, text="smith", inferred=False)
    assert total.first()["total"] == 1 and page.first()["object"] == "SMITH"
    with pytest.raises(ValueError):
        graph.page(hr.graph, sort="datatype")
    sample = graph.overview(hr.graph, 3)
    assert rows(sample.groupBy("predicate").count(), "predicate", "count") == [
        (EX + "collaboratesWith", 1), (EX + "reportsTo", 1), (EX + "worksIn", 1)]


def test_blank_nodes_are_no_entities(spark, hr):
    blank = spark.createDataFrame([("_:x", RDF_TYPE, EX + "Employee", "iri", None, None, False, None),
                                   ("_:x", EX + "name", "SMITHY", "literal", None, None, False, None)], TRIPLE_SCHEMA)
    wide = hr.graph.unionByName(blank)
    assert dict(rows(graph.type_inventory(wide), "type", "n"))[EX + "Employee"] == 4
    assert rows(graph.search(wide, "smi"), "subject") == [(iri("Employee", 1),)]


def test_resolve_values(hr):
    found = {r["value"]: r for r in graph.resolve_values(hr.graph, ["SALES", "nix"]).collect()}
    assert found["SALES"]["iri"] == iri("Department", 10) and found["nix"]["iri"] is None
