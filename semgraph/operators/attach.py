"""Attaching live data to entities: virtual attributes, actions, datasets, bridges between graphs."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from semgraph.functions.terms import quoted
from semgraph.operators.graph import labels
from semgraph.operators.triples import entity_keys, iris_for
from semgraph.plans.mapping import Mapping
from semgraph.sources.tables import guard_select, read_query

_PLACEHOLDER = re.compile(r"(?<![:\w]):([A-Za-z_]\w*)")
_STRING = re.compile(r"'(?:[^']|'')*'")


class AttachmentError(ValueError):
    pass


def placeholders(sql: str) -> list[str]:
    """Distinct ``:name`` placeholders outside string literals, in order."""
    return list(dict.fromkeys(_PLACEHOLDER.findall(_STRING.sub("''", sql))))


def _bound_to_keys(sql: str, keys: Sequence[str]) -> str:
    """The statement with placeholders read from the entity row ``k`` instead of bound one by one."""
    text = guard_select(sql)
    spelled = {k.lower(): k for k in keys}
    unknown = [p for p in placeholders(text) if p.lower() not in spelled]
    if unknown:
        raise AttachmentError(f"unknown placeholder :{unknown[0]}; the key columns are {', '.join(keys)}")
    out, at = [], 0
    for literal in _STRING.finditer(text):
        out += [_replaced(text[at:literal.start()], spelled), literal.group()]
        at = literal.end()
    return "".join([*out, _replaced(text[at:], spelled)])


def _replaced(text: str, spelled: dict[str, str]) -> str:
    return _PLACEHOLDER.sub(lambda m: f"k.{quoted(spelled[m.group(1).lower()])}", text)


def virtual(entities: DataFrame, keys: Sequence[str], attributes: dict[str, str]) -> DataFrame:
    """One text column per attribute: the SQL's value for each entity's key, NULL where it has no row.

    The statement is correlated once for all entities; the optimizer turns it into a join, so nothing
    runs per entity. Statements refer to catalogued tables and views. Of several rows the smallest value
    is taken, reduced before the join; an ORDER BY or LIMIT at the end is refused, because only an
    aggregate (min_by, max_by) states that choice for all entities at once.
    """
    out = entities
    for name, sql in attributes.items():
        body = _bound_to_keys(sql, keys)
        if re.search(r"\b(order\s+by\s+[^()]*|limit\s+\S+)$", _STRING.sub("''", body), re.IGNORECASE):
            raise AttachmentError(f"{name}: use an aggregate such as min_by instead of ORDER BY or LIMIT")
        column = quoted(read_query(out.sparkSession, re.sub(r"k\.`[^`]*`", "NULL", body)).columns[0])
        value = f"SELECT min(CAST(r.{column} AS STRING)) AS {quoted(name)} FROM ({body}) r"
        out = out.sparkSession.sql(
            f"SELECT k.*, v.{quoted(name)} FROM {{entities}} k LEFT JOIN LATERAL ({value}) v ON true", entities=out
        )
    return out


def virtual_all(entities: DataFrame, keys: Sequence[str], attributes: dict[str, str]) -> tuple[DataFrame, dict[str, str]]:
    """``virtual`` for every attribute the analyser accepts, and the reason for each it refuses."""
    out, refused = entities, {}
    for name, sql in attributes.items():
        try:
            out = virtual(out, keys, {name: sql})
        except Exception as problem:  # noqa: BLE001
            refused[name] = str(problem).splitlines()[0]
    return out, refused


def action(spark: SparkSession, sql: str, keys: dict, *, scalar: bool = False, limit: int | None = None) -> DataFrame:
    """Run a statement for one entity with its key values bound as parameters; all its rows, or ``limit`` of them."""
    names = placeholders(guard_select(sql))
    lower = {k.lower(): v for k, v in keys.items()}
    unknown = [n for n in names if n.lower() not in lower]
    if unknown:
        raise AttachmentError(f"unknown placeholder :{unknown[0]}; the key columns are {', '.join(keys)}")
    found = read_query(spark, sql, {n: lower[n.lower()] for n in names} or None)
    if scalar:
        return found.select(found[quoted(found.columns[0])].cast("string").alias("value")).limit(1)
    return found if limit is None else found.limit(limit)


def action_all(entities: DataFrame, keys: Sequence[str], sql: str) -> DataFrame:
    """All rows of a statement for all entities."""
    body = _bound_to_keys(sql, keys)
    return entities.sparkSession.sql(f"SELECT k.*, v.* FROM {{entities}} k JOIN LATERAL ({body}) v ON true", entities=entities)


def dataset(
    entities: DataFrame, keys: Sequence[str], table: DataFrame, key_columns: Sequence[str], limit: int | None = None
) -> DataFrame:
    """Table rows belonging to each entity; with a ``limit`` the first by all columns, numbered from 1."""
    if len(keys) != len(key_columns):
        raise AttachmentError("a dataset names one key column per entity key")
    wanted = entities.select("subject", *[F.col(quoted(k)).alias(f"_k{i}") for i, k in enumerate(keys)])
    # Keys read back from IRIs are text: they, not the table's columns, are turned into the other type, so that filters
    # reach the table's files and its statistics. Text that is no such value, or spells it otherwise, matches nothing.
    types = [table.schema[c].dataType for c in key_columns]
    typed = [F.col(f"_k{i}").try_cast(t) for i, t in enumerate(types)]
    spelled = [v.cast("string") == F.col(f"_k{i}").cast("string") for i, v in enumerate(typed)]
    wanted = wanted.where(reduce(lambda a, b: a & b, spelled))
    wanted = wanted.select("subject", *[v.alias(f"_k{i}") for i, v in enumerate(typed)])
    match = [table[quoted(c)] == F.col(f"_k{i}") for i, c in enumerate(key_columns)]
    joined = wanted.join(table, match, "inner").drop(*[f"_k{i}" for i in range(len(keys))])
    if limit is None:
        return joined
    order = Window.partitionBy("subject").orderBy(*[F.col(quoted(c)) for c in table.columns])
    numbered = joined.withColumn("position", F.row_number().over(order))
    return numbered.where(F.col("position") <= limit)


def bridge(
    entities: DataFrame, mapping: Mapping, class_iri: str, target: DataFrame | None, target_mapping: Mapping,
    target_class: str,
) -> DataFrame:
    """(subject, target, exists, label): the same key in another graph.

    An entity exists there as a subject or as an object. Without the other graph ``exists`` is NULL.
    """
    keyed = entity_keys(entities.select("subject"), mapping, class_iri)
    names = mapping.class_map(class_iri).key_columns
    if len(names) != len(target_mapping.class_map(target_class).key_columns):
        raise AttachmentError(f"{target_class} has another number of key columns")
    aimed = keyed.select("subject", iris_for(keyed, target_mapping, target_class, names).alias("target"))
    if target is None:
        return aimed.select("subject", "target", F.lit(None).cast("boolean").alias("exists"),
                            F.lit(None).cast("string").alias("label"))
    ends = target.select(F.col("subject").alias("target")).unionByName(
        target.where(F.col("object_type") != "literal").select(F.col("object").alias("target"))
    )
    there = ends.distinct().withColumn("_there", F.lit(True))
    named = labels(target).select(F.col("subject").alias("target"), "label")
    return aimed.join(there, "target", "left").join(named, "target", "left").select(
        "subject", "target", F.coalesce("_there", F.lit(False)).alias("exists"), "label"
    )
