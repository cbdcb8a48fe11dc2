"""Cohorts: members of a class picked by criteria, with the reasons."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semgraph.functions.skew import split_join
from semgraph.functions.terms import IN_COHORT, IRI, LITERAL, TRIPLE_COLUMNS, iri_local_name, local_name, number
from semgraph.operators.graph import FEW, instances, with_label
from semgraph.plans.ontology import Ontology

# Criterion kinds, operators and how an operator is written in an explanation.
KINDS = ("attribute", "relation", "related_attribute")
VALUE_OPERATORS = ("eq", "neq", "gt", "gte", "lt", "lte", "matches", "contains", "exists", "missing")
RELATION_OPERATORS = ("exists", "not_exists", "eq")
SIGNS = {"eq": "=", "neq": "!=", "gt": ">", "gte": ">=", "lt": "<", "lte": "<=", "matches": "~", "contains": "contains"}


class CohortError(ValueError):
    pass


@dataclass(frozen=True)
class Criterion:
    kind: str
    property: str
    operator: str
    value: object = None
    via: str | None = None

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise CohortError(f"criterion kind is one of {', '.join(KINDS)}")
        allowed = RELATION_OPERATORS if self.kind == "relation" else VALUE_OPERATORS
        if self.operator not in allowed:
            raise CohortError(f"{self.kind} operators are {', '.join(allowed)}")
        if self.kind == "related_attribute" and not self.via:
            raise CohortError("related_attribute needs via, the attribute of the related entity")
        if self.value is None and self.operator not in ("exists", "missing", "not_exists"):
            raise CohortError(f"{self.operator} needs a value")


@dataclass(frozen=True)
class Cohort:
    name: str
    class_iri: str
    criteria: tuple[Criterion, ...]
    match: str = "all"

    def __post_init__(self) -> None:
        if self.match not in ("all", "any"):
            raise CohortError("match is all or any")
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_\-]{0,119}", self.name):
            raise CohortError("a cohort name has letters, digits, '-' and '_'")
        if not self.criteria:
            raise CohortError("a cohort needs a criterion")


def candidates(triples: DataFrame, cohort: Cohort, ontology: Ontology | None = None) -> DataFrame:
    scope = ontology.with_descendants(cohort.class_iri) if ontology else (cohort.class_iri,)
    return instances(triples, scope)


def _holds(value: Column, operator: str, expected: object) -> Column:
    if operator == "matches":
        return value.rlike(str(expected))
    if operator == "contains":
        return F.contains(F.lower(value), F.lit(str(expected).lower()))
    numeric = isinstance(expected, (int, float)) and not isinstance(expected, bool)
    left = number(value) if numeric else value  # NaN and other words are no numbers
    right = F.lit(float(expected)) if numeric else F.lit(str(expected))
    test = {
        "eq": left == right, "neq": left != right, "gt": left > right, "gte": left >= right, "lt": left < right,
        "lte": left <= right,
    }[operator]
    return F.coalesce(test, F.lit(False))


def _by_value(values: DataFrame, subjects: DataFrame, c: Criterion, label: str) -> DataFrame:
    """(subject, why) of the subjects whose literals satisfy the criterion; the smallest one explains."""
    literals = values.where(F.col("object_type") == LITERAL)
    if c.operator == "missing":
        return subjects.join(literals, "subject", "left_anti").select("subject", F.lit(f"{label} missing").alias("why"))
    held = literals.join(subjects, "subject", "left_semi")
    if c.operator != "exists":
        held = held.where(_holds(F.col("object"), c.operator, c.value))
    ending = "" if c.operator == "exists" else f" ({SIGNS[c.operator]} {c.value})"
    return held.groupBy("subject").agg(
        F.concat(F.lit(f"{label} = "), F.min("object"), F.lit(ending)).alias("why")
    )


def hits(triples: DataFrame, c: Criterion, subjects: DataFrame) -> DataFrame:
    """(subject, why) of every candidate the criterion selects."""
    name = iri_local_name(c.property)
    values = triples.where(F.col("predicate") == c.property).select("subject", "object", "object_type")
    if c.kind == "attribute":
        return _by_value(values, subjects, c, name)
    links = values.where(F.col("object_type") != LITERAL)
    if c.kind == "relation":
        if c.operator == "not_exists":
            return subjects.join(links, "subject", "left_anti").select("subject", F.lit(f"no {name}").alias("why"))
        if c.operator == "eq":
            links = links.where(F.col("object") == str(c.value))
        ending = " exists" if c.operator == "exists" else ""
        held = links.join(subjects, "subject", "left_semi")
        first = local_name(F.min("object"))
        return held.groupBy("subject").agg(F.concat(F.lit(f"{name} -> "), first, F.lit(ending)).alias("why"))
    reached = links.join(subjects, "subject", "left_semi").select("subject", "object")
    targets = reached.select(F.col("object").alias("subject")).distinct()
    facts = triples.where(F.col("predicate") == c.via).select("subject", "object", "object_type")
    found = _by_value(facts, targets, c, f"{name} -> {iri_local_name(c.via)}")
    found = found.select(F.col("subject").alias("object"), "why")
    return split_join(reached, found, ["object"]).groupBy("subject").agg(F.min_by("why", "object").alias("why"))


def evaluate(
    triples: DataFrame, cohort: Cohort, ontology: Ontology | None = None, *, limit: int | None = None,
    label: bool = True,
) -> DataFrame:
    """Members with label and one explanation per satisfied criterion, in criterion order."""
    subjects = candidates(triples, cohort, ontology)
    found = reduce(
        DataFrame.unionByName,
        [hits(triples, c, subjects).withColumn("_i", F.lit(i)) for i, c in enumerate(cohort.criteria)],
    )
    # At most one row per member and criterion.
    why = F.transform(F.array_sort(F.collect_list(F.struct("_i", "why"))), lambda e: e["why"])
    members = found.groupBy("subject").agg(F.count("*").alias("_n"), why.alias("explanation"))
    needed = len(cohort.criteria) if cohort.match == "all" else 1
    members = members.where(F.col("_n") >= needed).select("subject", "explanation")
    if limit is not None:
        members = members.orderBy("subject").limit(limit)
    return with_label(members, triples, "subject", few=limit is not None and limit <= FEW) if label else members


def size(triples: DataFrame, cohort: Cohort, ontology: Ontology | None = None) -> DataFrame:
    """One row: members and candidates."""
    subjects = candidates(triples, cohort, ontology).withColumn("_member", F.lit(False))
    members = evaluate(triples, cohort, ontology, limit=None, label=False).select("subject", F.lit(True).alias("_member"))
    return subjects.unionByName(members).agg(
        F.lit(cohort.name).alias("cohort"), F.count_if("_member").alias("size"),
        F.count_if(~F.col("_member")).alias("candidates"),
    )


def member_triples(members: DataFrame, cohort: Cohort, base_iri: str) -> DataFrame:
    """Membership as inferred triples."""
    empty = F.lit(None).cast("string")
    return members.select(
        "subject", F.lit(IN_COHORT).alias("predicate"), F.lit(f"{base_iri}cohort/{cohort.name}").alias("object"),
        F.lit(IRI).alias("object_type"), empty.alias("datatype"), empty.alias("lang"),
        F.lit(True).alias("inferred"), empty.alias("source_table"),
    ).select(*TRIPLE_COLUMNS)


def replace_members(inferred: DataFrame, cohort: Cohort, fresh: DataFrame, base_iri: str) -> DataFrame:
    """The inferred layer with this cohort's earlier membership replaced."""
    old = (F.col("predicate") == IN_COHORT) & (F.col("object") == f"{base_iri}cohort/{cohort.name}")
    return inferred.where(~old).unionByName(member_triples(fresh, cohort, base_iri))
