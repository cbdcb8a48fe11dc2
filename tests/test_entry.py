"""The registered queries and their SQL, on the smallest sample tables."""

from __future__ import annotations

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from compare import compare, duck

FOLDER = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="sample tables are not here")
SOME = (
    "triples_build", "triples_encoding", "triples_reference_join", "keys_from_iris", "status_card", "search_many",
    "agg_by_relation", "agg_by_month", "class_paths", "class_view_search", "profile_numeric_orders", "profile_histogram",
    "dq_run_isolated", "dq_flag", "dq_overview", "shape_report", "rule_fixpoint", "owl_same_as", "clustering",
    "cohort_all", "dataset_rows", "reference_evidence", "build_incremental",
)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 200


@needs_data
@pytest.mark.parametrize("name", SOME)
def test_query_equals_its_sql(spark, name):
    state, _, note = compare(spark, duck(FOLDER), name, entry.queries()[name], entry.oracle_sql()[name], FOLDER)
    assert state == "ok", note


@needs_data
def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@needs_data
def test_labelled_cohort_is_as_long_as_its_sql(spark, tmp_path):
    """More members than the statement's limit: the first by IRI."""
    customers = spark.range(1, 1206).select(
        F.col("id").cast("int").alias("c_custkey"), F.concat(F.lit("c"), "id").alias("c_name"), F.lit(3).alias("c_nationkey"),
        (F.lit(4995.0) + F.col("id")).alias("c_acctbal"), F.lit("BUILDING").alias("c_mktsegment"))
    customers.write.parquet(str(tmp_path / "customer.parquet"))
    for t in ("region", "nation", "supplier", "part", "orders", "lineitem", "events"):
        os.symlink(f"{FOLDER}/{t}.parquet", tmp_path / f"{t}.parquet")
    name = "cohort_labelled"
    found = [tuple(r) for r in entry.queries()[name](spark, str(tmp_path)).collect()]
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
        assert found == con.execute(entry.oracle_sql()[name]).fetchall()
    assert len(found) == 1000
