"""Stores, builds, drift, keys and attachments."""

from __future__ import annotations

from dataclasses import replace
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from conftest import BASE, EX, iri
from semgraph.functions.terms import IRI
from semgraph.operators import attach, build, drift, keys, profile, triples
from semgraph.operators.attach import AttachmentError
from semgraph.plans import statement
from semgraph.plans.mapping import Attribute, ClassMap, Mapping
from semgraph.sources.store import GraphStore, publish, signatures
from semgraph.sources.tables import FolderTables, catalog_columns, catalog_tables


def counts(store):
    return {r["source_table"]: r["count"] for r in store.read(inferred=False).groupBy("source_table").count().collect()}


def test_store_replaces_and_layers(spark, hr, tmp_path):
    store = GraphStore(spark, str(tmp_path))
    assert store.read().isEmpty() and store.tables() == {}
    assert store.replace(hr.graph) == 25 and store.read().count() == 25
    extra = hr.graph.limit(1).withColumn("predicate", F.lit("urn:x"))
    assert store.set_inferred(extra) == 1
    before = files_of(store, "inferred=true")
    store.add_inferred(extra)
    assert before < files_of(store, "inferred=true")  # added to, not rewritten
    assert store.read(inferred=True).count() == 2 and store.read(inferred=False).count() == 25
    assert GraphStore(spark, str(tmp_path)).read().count() == 27
    store.set_inferred(store.read(inferred=True).limit(1))  # a layer drawn from itself
    assert store.read(inferred=True).count() == 1
    store.clear_inferred()
    assert store.read().count() == 25
    store.set_inferred(extra.where("false"))
    assert store.read(inferred=True).isEmpty()
    asserted = store.read(inferred=False).select("predicate")
    assert "PartitionFilters: [isnotnull(inferred" in asserted._jdf.queryExecution().toString()
    store.load(hr.graph.where("false"), {}, {"collaborations": "h"})
    assert "collaborations" not in counts(store) and store.read().count() == 23 and store.tables()["collaborations"].rows == 0
    store.clear()
    assert GraphStore(spark, str(tmp_path)).read().isEmpty()


def files_of(store, part):
    return {p.name for p in (Path(store.path) / part).rglob("*.parquet")}


class Kept(FolderTables):
    """Tables written to a folder, anew whenever one changes."""

    def put(self, name, df):
        df.write.mode("overwrite").parquet(self.location(name))


@pytest.fixture
def kept(spark, hr, tmp_path):
    tables = Kept(spark, str(tmp_path / "tables"))
    for name, df in hr.tables.items():
        tables.put(name, df)
    return tables


@pytest.mark.parametrize("method", [None, "rows"])
def test_incremental_builds(spark, hr, kept, tmp_path, method):
    store = GraphStore(spark, str(tmp_path / "graph"))
    run = lambda mapping=hr.mapping, **more: build.build(spark, mapping, kept, store, signature=method, **more)
    first = run()
    assert first.plan.mode == "full" and store.read().count() == 25
    store.set_inferred(hr.graph.limit(2))
    lying = files_of(store, "")
    same = run()
    assert same.plan.mode == "incremental" and same.plan.changed == () and files_of(store, "") == lying
    assert {r["step"]: (r["state"], r["rows"]) for r in same.steps.collect()}["load"] == ("skipped", 0)
    kept.put("departments", hr.tables["departments"].union(spark.createDataFrame([(30, "OPS")], "deptno int, dname string")))
    untouched = files_of(store, "inferred=false/source_table=employees")
    moved = run()
    assert moved.plan.changed == ("departments",) and store.read(inferred=False).count() == 27 and store.read(inferred=True).isEmpty()
    assert files_of(store, "inferred=false/source_table=employees") == untouched
    kept.put("collaborations", hr.tables["collaborations"].where("false"))
    emptied = run()
    assert emptied.plan.changed == ("collaborations",) and store.read().count() == 25
    assert run().plan.changed == ()
    fewer = replace(hr.mapping, relations=hr.mapping.relations[:2])
    dropped = run(fewer)
    assert dropped.plan.dropped == ("collaborations",) and dropped.plan.changed == ()
    remapped = replace(fewer, classes=(hr.mapping.classes[0], replace(hr.mapping.classes[1], attributes=())))
    again = run(remapped)
    assert again.plan.changed == ("departments",) and store.read().count() == 22
    assert run(remapped, full=True).plan.reason == "requested"
    assert again.steps.where("step = 'finalize'").first()["rows"] == 22


def test_a_build_writes_rows_as_they_come(spark, hr, kept, tmp_path, monkeypatch):
    """Nothing is shuffled or sorted for a build: a file holds one predicate; the session is left as it was."""
    store, setting = GraphStore(spark, str(tmp_path / "graph")), "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(setting)
    build.build(spark, hr.mapping, kept, store)
    files = store.read().groupBy(F.input_file_name().alias("file")).agg(F.countDistinct("predicate").alias("n"))
    assert {r["n"] for r in files.collect()} == {1} and spark.conf.get(setting) == before
    columns = hr.graph.columns
    assert sorted(map(tuple, store.read().select(columns).collect()), key=str) == sorted(map(tuple, hr.graph.collect()), key=str)


def test_changed_files_of_equal_size_are_seen(spark, hr, kept):
    mark = lambda method: signatures(spark, ["departments"], kept, method).first()
    files, rows = mark("files"), mark(None)
    assert files == rows and (files["method"], files["items"] > 0) == ("files", True) and mark("files") == files
    byrows = mark("rows")
    kept.put("departments", hr.tables["departments"])  # the same rows, written again
    assert mark("files")["digest"] != files["digest"] and mark("rows") == byrows
    with pytest.raises(ValueError):
        signatures(spark, ["departments"], hr.tables.__getitem__, "files").collect()
    plan = signatures(spark, ["departments"], kept)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan and "dname" not in plan


def test_file_statistics_of_a_profile(spark, kept):
    found = profile.profile(kept("departments"), table="departments")
    facts = profile.with_file_stats(found.table_facts, kept.location("departments")).first()
    files = list(Path(kept.location("departments")).rglob("*.parquet"))
    assert facts["size_bytes"] == sum(f.stat().st_size for f in files) and facts["row_count"] == 2
    assert abs(facts["last_modified"].timestamp() - max(f.stat().st_mtime for f in files)) < 1


def test_failed_load_keeps_the_graph(spark, hr, tmp_path):
    store = GraphStore(spark, str(tmp_path))
    build.build(spark, hr.mapping, hr.tables.__getitem__, store)
    broken = {**hr.tables, "departments": hr.tables["departments"].withColumn("dname", F.expr("cast(dname as int)").cast("string"))}
    with pytest.raises(Exception):
        build.build(spark, hr.mapping, broken.__getitem__, store)
    assert GraphStore(spark, str(tmp_path)).read().count() == 25


def test_graph_dealt_by_subject_joins_without_exchange(spark, hr, tmp_path):
    name = "hr_dealt"
    publish(hr.graph, name, "table", path=str(tmp_path / "dealt"), buckets=4)
    dealt = spark.table(name)
    assert sorted(map(tuple, dealt.collect()), key=str) == sorted(map(tuple, hr.graph.select(dealt.columns).collect()), key=str)
    a = dealt.where(F.col("predicate") == EX + "worksIn").select("subject", F.col("object").alias("x"))
    b = dealt.where(F.col("predicate") == EX + "salary").select("subject", F.col("object").alias("y"))
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Exchange" not in a.join(b, "subject")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_persistent_view_shows_the_tables_as_they_are(spark, hr, kept):
    place = lambda t: f"parquet.`{kept.location(t)}`"
    statement.create_view(spark, "hr_view", hr.mapping, lambda t: hr.tables[t].schema, place)
    read = lambda: sorted(map(tuple, spark.newSession().table("hr_view").select(*hr.graph.columns).collect()), key=str)
    assert read() == sorted(map(tuple, hr.graph.collect()), key=str)
    kept.put("departments", hr.tables["departments"].where("deptno = 10"))
    assert len(read()) == 23
    spark.sql("DROP VIEW hr_view")


def test_signatures_ignore_order(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (2, None)], "a int, b string")
    b = spark.createDataFrame([(2, None), (1, "x"), (2, None)], "a int, b string")
    c = spark.createDataFrame([(2, None), (1, "x")], "a int, b string")
    found = signatures(spark, ["a", "b", "c"], {"a": a, "b": b, "c": c}.__getitem__).collect()
    marks = {r["table"]: (r["method"], r["items"], r["digest"]) for r in found}
    assert marks["a"] == marks["b"] != marks["c"] and marks["a"][:2] == ("rows", 3)


def test_publish_and_catalog(spark, hr):
    publish(hr.graph, "hr_triples")
    assert spark.table("hr_triples").count() == 25
    columns = catalog_columns(spark, keys={"hr_triples": ["subject", "object"]}, references={("hr_triples", "source_table"): "tables"})
    columns = columns.where("table = 'hr_triples'")
    declared = {r["column"]: (r["key_place"], r["refers_to"]) for r in columns.collect()}
    assert declared["subject"] == (1, None) and declared["object"] == (2, None) and declared["source_table"] == (None, "tables")
    assert columns.count() == 8 and catalog_tables(columns).first()["columns"] == 8
    with pytest.raises(ValueError):
        publish(hr.graph, "bad name")


def test_schema_diff_and_drift(spark, hr):
    before = drift.snapshot(spark, hr.tables, {("employees", "ename"): "family name"})
    changed = {**hr.tables, "employees": hr.tables["employees"].drop("manager").withColumn("sal", F.col("sal").cast("double")).withColumn("Site", F.lit("x"))}
    changed.pop("employee_skills")
    after = drift.snapshot(spark, changed)
    diff = {(r["table"], r["column"]): r["change"] for r in drift.schema_diff(before, after).where("change <> 'same'").collect()}
    assert diff == {("employees", "manager"): "removed", ("employees", "sal"): "retyped", ("employees", "Site"): "added",
                    ("employee_skills", "empno"): "missing table", ("employee_skills", "skill"): "missing table"}
    kept = drift.schema_diff(before, after).where("column = 'ename'").first()
    assert kept["comment"] == "family name"
    gone = dict(changed)
    gone.pop("departments")
    issues = drift.mapping_drift(hr.mapping, drift.snapshot(spark, gone), before, unreadable={"collaborations": "denied"})
    got = {(r["kind"], r["table"], r["column"], r["severity"]) for r in issues.collect()}
    assert got == {
        ("missing-column", "employees", "manager", "error"), ("type-changed", "employees", "sal", "warning"),
        ("missing-table", "departments", None, "error"), ("unreadable", "collaborations", None, "warning")}
    only = drift.mapping_drift(hr.mapping, drift.snapshot(spark, gone), before, tables={"departments"})
    assert {r["table"] for r in only.collect()} == {"departments"}
    a = drift.key_frame(spark, {"employees": ("empno",)})
    b = drift.key_frame(spark, {"employees": ("empno", "deptno")})
    assert drift.keys_changed(a, b).count() == 1 and drift.keys_changed(a, a).isEmpty()


def test_keys_by_name():
    got = keys.keys_by_name({
        "dim_customer": ["customer_sk", "customer_id", "name"], "dim_promotion": ["promo_id", "label"],
        "dim_product": ["dim_product_sk", "sku_id"], "dim_calendar": ["date_id", "year"], "plain": ["id", "x"],
        "fact_sales": ["customer_sk", "promo_id", "sku_id", "date_id", "amount"]})
    assert got["dim_customer"].key == ("customer_sk",) and got["dim_promotion"].key == ("promo_id",)
    assert got["plain"].key == ("id",)
    assert {f.table for f in got["fact_sales"].foreign} >= {"dim_customer", "dim_promotion"}


def test_discovery_and_draft(spark, hr):
    found = keys.discover({t: hr.tables[t] for t in ("employees", "departments", "employee_skills")})
    assert found["employees"].key == ("empno",) and found["departments"].key == ("deptno",)
    tables = {
        "dim_author": spark.createDataFrame([(1, "A"), (2, "B")], "author_id int, name string"),
        "books": spark.createDataFrame([(7, 1, "T"), (8, 1, "U")], "book_id int, author_id int, title string"),
        "tags": spark.createDataFrame([(3, "x")], "tag_id int, word string"),
        "book_tags": spark.createDataFrame([(7, 3), (8, 3)], "book_id int, tag_id int"),
    }
    draft, graph = keys.auto_graph(spark, tables, namespace=EX, base_iri=BASE)
    assert {c.iri for c in draft.ontology.classes} == {EX + "Author", EX + "Book", EX + "Tag"}
    assert {p.iri for p in draft.ontology.object_properties} == {EX + "author", EX + "bookTag"}
    by = {r["predicate"]: r["count"] for r in graph.groupBy("predicate").count().collect()}
    assert by[EX + "author"] == 2 and by[EX + "bookTag"] == 2 and by[EX + "title"] == 2
    assert draft.inferred == sorted(tables) and draft.declared == []


def test_virtual_attributes(spark, hr):
    for name, df in hr.tables.items():
        df.createOrReplaceTempView(name)
    people = triples.entity_keys(
        hr.graph.where(F.col("object") == EX + "Employee").select("subject"), hr.mapping, EX + "Employee")
    out = attach.virtual(people, ["empno"], {
        "skillCount": "SELECT count(*) FROM employee_skills WHERE empno = :empno",
        "deptName": "SELECT dname FROM employees e JOIN departments d ON e.deptno = d.deptno WHERE e.empno = :empno",
        "firstSkill": "SELECT skill FROM employee_skills WHERE empno = :empno",
    })
    assert out.count() == 4
    rows = {r["empno"]: (r["skillCount"], r["deptName"], r["firstSkill"]) for r in out.collect()}
    assert rows == {"1": ("2", "SALES", "python"), "2": ("1", "RESEARCH", "sql"), "3": ("0", None, None), "4": ("0", None, None)}
    _, refused = attach.virtual_all(people, ["empno"], {"bad": "SELECT nothing FROM employees WHERE empno = :empno"})
    assert set(refused) == {"bad"}
    for bad in ("DELETE FROM x", "SELECT 1; SELECT 2", "SELECT :other", "SELECT skill FROM employee_skills WHERE empno = :empno LIMIT 1"):
        with pytest.raises(ValueError):
            attach.virtual(people, ["empno"], {"x": bad})


def test_actions_and_datasets(spark, hr):
    hr.tables["employee_skills"].createOrReplaceTempView("employee_skills")
    rows = attach.action(spark, "SELECT skill FROM employee_skills WHERE empno = :empno", {"empno": 1})
    assert {r["skill"] for r in rows.collect()} == {"sql", "python"}
    one = attach.action(spark, "SELECT count(*) FROM employee_skills WHERE empno = :empno", {"empno": 1}, scalar=True)
    assert one.first()["value"] == "2"
    with pytest.raises(AttachmentError):
        attach.action(spark, "SELECT :nope", {"empno": 1})
    people = triples.entity_keys(
        hr.graph.where(F.col("object") == EX + "Employee").select("subject"), hr.mapping, EX + "Employee")
    first = attach.dataset(people, ["empno"], hr.tables["employee_skills"], ["empno"], limit=1).collect()
    assert {(r["subject"], r["skill"]) for r in first} == {(iri("Employee", 1), "python"), (iri("Employee", 2), "sql")}


def test_bridge(spark, hr):
    other = Mapping("http://o/", (ClassMap("http://o/ns#Worker", "w", ("k",), (Attribute("http://o/ns#name", "n"),)),))
    workers = spark.createDataFrame([(1, "Smith J"), (7, "X")], "k int, n string")
    target = triples.build(spark, other, lambda _: workers)
    people = hr.graph.where(F.col("object") == EX + "Employee").select("subject")
    rows = {r["subject"]: (r["target"], r["exists"], r["label"]) for r in attach.bridge(
        people, hr.mapping, EX + "Employee", target, other, "http://o/ns#Worker").collect()}
    assert rows[iri("Employee", 1)] == ("http://o/Worker/1", True, "Smith J")
    assert rows[iri("Employee", 2)] == ("http://o/Worker/2", False, None)
    unknown = attach.bridge(people, hr.mapping, EX + "Employee", None, other, "http://o/ns#Worker").first()
    assert unknown["exists"] is None


def test_iri_kinds_in_the_store(spark, hr, tmp_path):
    store = GraphStore(spark, str(tmp_path))
    store.replace(hr.graph)
    assert store.read().where(F.col("object_type") == IRI).count() == 13
