from __future__ import annotations

import os
import sys
from types import SimpleNamespace

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from semgraph.functions.terms import XSD  # noqa: E402
from semgraph.operators import triples  # noqa: E402
from semgraph.plans.mapping import Attribute, ClassMap, Mapping, Relation  # noqa: E402
from semgraph.plans.ontology import DataProperty, ObjectProperty, Ontology, OntologyClass  # noqa: E402

EX, BASE = "http://d/hr#", "http://d/hr/"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


def iri(kind: str, key) -> str:
    return f"{BASE}{kind}/{key}"


@pytest.fixture(scope="session")
def hr(spark):
    """Employees with a missing salary, a missing and a dangling department and a missing manager."""
    employees = spark.createDataFrame(
        [
            (1, "SMITH", 800, 10, None, "2020-01-15"), (2, "ALLEN", None, 20, 1, "2021-03-01"),
            (3, "WARD", 1250, None, 1, "2022-07-30"), (4, "GHOST", 500, 99, None, None),
        ],
        "empno int, ename string, sal int, deptno int, manager int, hired string",
    ).withColumn("sal", F.col("sal").cast("decimal(10,0)")).withColumn("hired", F.to_date("hired"))
    tables = {
        "employees": employees,
        "departments": spark.createDataFrame([(10, "SALES"), (20, "RESEARCH")], "deptno int, dname string"),
        "collaborations": spark.createDataFrame([(1, 2), (2, 3)], "a int, b int"),
        "employee_skills": spark.createDataFrame([(1, "sql"), (1, "python"), (2, "sql")], "empno int, skill string"),
    }
    employee, department = EX + "Employee", EX + "Department"
    mapping = Mapping(
        BASE,
        (
            ClassMap(employee, "employees", ("empno",), (
                Attribute(EX + "name", "ename"), Attribute(EX + "salary", "sal"), Attribute(EX + "hired", "hired"))),
            ClassMap(department, "departments", ("deptno",), (Attribute(EX + "name", "dname"),)),
        ),
        (
            Relation(EX + "worksIn", employee, department, ("deptno",)),
            Relation(EX + "reportsTo", employee, employee, ("manager",)),
            Relation(EX + "collaboratesWith", employee, employee, ("b",), ("a",), table="collaborations"),
        ),
    )
    ontology = Ontology(
        (OntologyClass(EX + "Person"), OntologyClass(employee, (EX + "Person",)), OntologyClass(department)),
        (
            ObjectProperty(EX + "worksIn", employee, department),
            ObjectProperty(EX + "reportsTo", employee, employee, inverse_of=EX + "manages"),
            ObjectProperty(EX + "manages"), ObjectProperty(EX + "collaboratesWith", employee, employee),
        ),
        (DataProperty(EX + "name"), DataProperty(EX + "salary", employee, XSD + "decimal"),
         DataProperty(EX + "hired", employee, XSD + "date")),
    )
    graph = triples.build(spark, mapping, tables.__getitem__).cache()
    return SimpleNamespace(tables=tables, mapping=mapping, ontology=ontology, graph=graph)
