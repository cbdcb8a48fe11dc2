"""Turning mapped tables into triples.

Two layouts give the same rows:

* ``rows`` reads every table once and unfolds each row into all of its triples: for building a graph.
* ``branches`` is a union with one branch per predicate. A filter on the predicate (or on a class) is
  constant inside a branch, so the optimizer drops every other branch and reads only the columns the
  remaining one needs: for asking questions of a graph that was never written.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semgraph.functions.templates import fill, slots
from semgraph.functions.terms import (
    BNODE, IRI, LITERAL, RDF_TYPE, TRIPLE_COLUMNS, TRIPLE_SCHEMA, iri_encode, lexical, needs_encoding, quoted,
    xsd_for,
)
from semgraph.plans.mapping import Mapping, Reference, Source, Term, TripleMap
from semgraph.sources.tables import Resolver, read_query, read_table

_PARTS = ("subject", "predicate", "object", "object_type", "datatype", "lang")


def build(
    spark: SparkSession,
    mapping: Mapping,
    tables: Resolver | None = None,
    *,
    maps: Iterable[TripleMap] | None = None,
    layout: str = "rows",
    iso: bool = False,
) -> DataFrame:
    """All triples of the mapping (duplicates kept), or of some of its triple maps."""
    resolve = tables or (lambda name: read_table(spark, name))
    chosen = tuple(maps) if maps is not None else mapping.triple_maps()
    named = {m.name: m for m in (*mapping.triple_maps(), *chosen)}
    frames: dict[Source, DataFrame] = {}

    def frame(source: Source) -> DataFrame:
        if source not in frames:
            frames[source] = resolve(source.table) if source.table else read_query(spark, source.query)
        return frames[source]

    own_rows: dict[Source, list[tuple[Column, ...]]] = {}
    parts: list[DataFrame] = []
    for m in chosen:
        df = frame(m.source)
        entries = own_rows.setdefault(m.source, [])
        subject = _term(df, m.subject, iso)
        entries += [_entry(subject, F.lit(RDF_TYPE), F.lit(c), IRI) for c in m.classes]
        for group in m.properties:
            for p in group.predicates:
                predicate = _term(df, p, iso)
                for o in group.objects:
                    if isinstance(o, Reference) and o.on:
                        parts.append(_joined(df, frame, m, predicate_term=p, ref=o, named=named, iso=iso))
                    elif isinstance(o, Reference):
                        parent = named[o.parent]
                        if parent.source != m.source:
                            raise ValueError(f"{m.name}: a reference without a join needs the same source")
                        entries.append(_entry(subject, predicate, _term(df, parent.subject, iso), parent.subject.kind))
                    else:
                        entries.append(_object_entry(df, subject, predicate, o, iso))
    unfold = _unfolded if layout == "rows" else _branched
    for source, entries in own_rows.items():
        if entries:
            parts.append(unfold(frame(source), entries, source.table))
    if not parts:
        return spark.createDataFrame([], TRIPLE_SCHEMA)
    return reduce(DataFrame.unionByName, parts)


def virtual(spark: SparkSession, mapping: Mapping, tables: Resolver | None = None) -> DataFrame:
    return build(spark, mapping, tables, layout="branches")


def class_triples(spark: SparkSession, mapping: Mapping, class_iri: str, tables: Resolver | None = None) -> DataFrame:
    return build(spark, mapping, tables, maps=mapping.only_class(class_iri))


def preview_class(
    spark: SparkSession, mapping: Mapping, class_iri: str, rows: int, tables: Resolver | None = None
) -> DataFrame:
    return class_triples(spark, mapping, class_iri, tables).orderBy("subject", "predicate", "object").limit(rows)


def entity_keys(entities: DataFrame, mapping: Mapping, class_iri: str, column: str = "subject") -> DataFrame:
    """Key values read back from entity IRIs, one string column per key; other IRIs are dropped."""
    from semgraph.functions.templates import slot_pattern
    from semgraph.functions.terms import iri_decode

    template = mapping.subject_template(class_iri)
    pattern = slot_pattern(template)
    keys = [
        iri_decode(F.regexp_extract(F.col(column), pattern, i + 1)).alias(name)
        for i, name in enumerate(slots(template))
    ]
    return entities.where(F.col(column).rlike(pattern)).select("*", *keys)


def iris_for(keys: DataFrame, mapping: Mapping, class_iri: str, columns: Iterable[str]) -> Column:
    """IRI expression from key columns given in the order of the class key."""
    names = mapping.class_map(class_iri).key_columns
    columns = list(columns)
    if len(columns) != len(names):
        raise ValueError(f"{class_iri}: {len(columns)} key value(s) given for a key of {len(names)}")
    values = {n: _encoded(keys, c) for n, c in zip(names, columns)}
    template = mapping.subject_template(class_iri)
    lower = {n.lower(): v for n, v in values.items()}
    return fill(template, {s: lower[s.lower()] for s in slots(template)})


def _type_of(df: DataFrame, column: str) -> T.DataType:
    for f in df.schema.fields:
        if f.name.lower() == column.lower():
            return f.dataType
    raise ValueError(f"the source has no column {column!r}")


def _encoded(df: DataFrame, column: str) -> Column:
    dtype = _type_of(df, column)
    text = lexical(df[quoted(column)], dtype)
    return iri_encode(text) if needs_encoding(dtype) else text


def _term(df: DataFrame, term: Term, iso: bool) -> Column:
    if term.constant is not None:
        return F.lit(("_:" if term.kind == BNODE else "") + term.constant)
    if term.column is not None:
        text = lexical(df[quoted(term.column)], _type_of(df, term.column), iso=iso)
        return F.concat(F.lit("_:"), text) if term.kind == BNODE else text
    values = {
        s: _encoded(df, s) if term.kind == IRI else lexical(df[quoted(s)], _type_of(df, s), iso=iso)
        for s in slots(term.template)
    }
    filled = fill(term.template, values)
    return F.concat(F.lit("_:"), filled) if term.kind == BNODE else filled


def _entry(subject, predicate, obj, kind, datatype=None, lang=None) -> tuple[Column, ...]:
    text = lambda v: F.lit(v).cast("string")
    return subject, predicate, obj, text(kind), text(datatype), text(lang)


def _object_entry(df: DataFrame, subject: Column, predicate: Column, term: Term, iso: bool) -> tuple[Column, ...]:
    datatype = term.datatype
    if term.kind == LITERAL and term.column is not None and not datatype and not term.lang:
        datatype = xsd_for(_type_of(df, term.column))
    return _entry(subject, predicate, _term(df, term, iso), term.kind, datatype, term.lang)


def _finish(df: DataFrame, table: str | None) -> DataFrame:
    return (
        df.where(F.col("subject").isNotNull() & F.col("predicate").isNotNull() & F.col("object").isNotNull())
        .withColumn("inferred", F.lit(False))
        .withColumn("source_table", F.lit(table).cast("string"))
        .select(*TRIPLE_COLUMNS)
    )


def _unfolded(df: DataFrame, entries: list[tuple[Column, ...]], table: str | None) -> DataFrame:
    """One scan: every term is computed once per row, then the row is stacked into its triples."""
    if len(entries) == 1:
        return _branched(df, entries, table)
    terms: dict[str, str] = {}
    columns: list[Column] = []
    cells: list[Column] = []
    for entry in entries:
        for cell in entry[:3]:
            key = str(cell)
            if key not in terms:
                terms[key] = f"_t{len(terms)}"
                columns.append(cell.alias(terms[key]))
            cells.append(F.col(terms[key]))
        cells += entry[3:]
    stacked = df.select(*columns).select(F.stack(F.lit(len(entries)), *cells).alias(*_PARTS))
    return _finish(stacked, table)


def _branched(df: DataFrame, entries: list[tuple[Column, ...]], table: str | None) -> DataFrame:
    branches = [df.select(*[c.alias(n) for c, n in zip(entry, _PARTS)]) for entry in entries]
    return reduce(DataFrame.unionByName, [_finish(b, table) for b in branches])


def _joined(df, frame, m: TripleMap, *, predicate_term: Term, ref: Reference, named, iso: bool) -> DataFrame:
    """Child rows joined to the parent rows their columns point at; matches are not deduplicated."""
    parent = named[ref.parent]
    right = frame(parent.source)
    left = df.select(
        _term(df, m.subject, iso).alias("subject"),
        _term(df, predicate_term, iso).alias("predicate"),
        *[df[quoted(c)].alias(f"_k{i}") for i, (c, _) in enumerate(ref.on)],
    )
    right = right.select(
        _term(right, parent.subject, iso).alias("object"),
        *[right[quoted(p)].alias(f"_k{i}") for i, (_, p) in enumerate(ref.on)],
    )
    joined = left.join(right, [f"_k{i}" for i in range(len(ref.on))], "inner")
    empty = F.lit(None).cast("string")
    return _finish(
        joined.select(
            "subject", "predicate", "object", F.lit(parent.subject.kind).alias("object_type"),
            empty.alias("datatype"), empty.alias("lang"),
        ),
        m.source.table,
    )
