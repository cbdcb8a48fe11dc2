"""The mapping as one SQL statement, so that the graph can be a view of the catalogue that any session reads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from semgraph.functions.templates import Slot, split_template
from semgraph.functions.terms import BNODE, IRI, LITERAL, RDF_TYPE, needs_encoding, quoted, text_literal, xsd_for
from semgraph.plans.mapping import Mapping, Reference, Source, Term
from semgraph.sources.tables import guard_select, safe_name

Schemas = Callable[[str], T.StructType]

_PARTS = ("subject", "predicate", "object", "object_type", "datatype", "lang")


def _text(value: str | None) -> str:
    return "CAST(NULL AS STRING)" if value is None else text_literal(value)


def _lexical(types: dict[str, T.DataType], column: str) -> str:
    dtype = types[column.lower()]
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        raise ValueError("nested columns have no single text form: select a leaf column")
    return f"hex({quoted(column)})" if isinstance(dtype, T.BinaryType) else f"CAST({quoted(column)} AS STRING)"


def _encoded(types: dict[str, T.DataType], column: str) -> str:
    text = _lexical(types, column)
    if not needs_encoding(types[column.lower()]):
        return text
    return f"replace(replace(replace(url_encode({text}), '+', '%20'), '*', '%2A'), '%7E', '~')"


def term_sql(term: Term, types: dict[str, T.DataType]) -> str:
    mark = ["'_:'"] if term.kind == BNODE else []
    if term.constant is not None:
        return text_literal(("_:" if mark else "") + term.constant)
    if term.column is not None:
        pieces = [_lexical(types, term.column)]
    else:
        slot = _encoded if term.kind == IRI else _lexical
        pieces = [slot(types, p.column) if isinstance(p, Slot) else text_literal(p) for p in split_template(term.template)]
    return f"concat({', '.join([*mark, *pieces])})"


def statement(mapping: Mapping, schemas: Schemas, relation: Callable[[str], str] = safe_name) -> str:
    """One SELECT with the rows of a full build. ``relation`` spells a table in FROM; ``schemas`` gives its columns.

    Each source is read once and its rows are unfolded; only references through other tables are joined.
    """
    maps = mapping.triple_maps()
    named = {m.name: m for m in maps}
    unfolded: dict[Source, list[tuple[str, ...]]] = {}
    branches: list[str] = []

    def place(source: Source) -> str:
        return relation(source.table) if source.table else f"({guard_select(source.query)})"

    known: dict[Source, dict[str, T.DataType]] = {}

    def types(source: Source) -> dict[str, T.DataType]:
        if source not in known:
            known[source] = {f.name.lower(): f.dataType for f in schemas(source.table or source.query).fields}
        return known[source]

    for m in maps:
        mine, entries = types(m.source), unfolded.setdefault(m.source, [])
        subject = term_sql(m.subject, mine)
        entries += [(subject, text_literal(RDF_TYPE), text_literal(c), text_literal(IRI), _text(None), _text(None)) for c in m.classes]
        for predicate, o in ((p, o) for group in m.properties for p in group.predicates for o in group.objects):
            verb = term_sql(predicate, mine)
            if isinstance(o, Reference) and o.on:
                parent = named[o.parent]
                left = ", ".join(f"{quoted(c)} AS k{i}" for i, (c, _) in enumerate(o.on))
                right = ", ".join(f"{quoted(p)} AS k{i}" for i, (_, p) in enumerate(o.on))
                branches.append(_finished(
                    f"SELECT subject, predicate, object, {text_literal(parent.subject.kind)} AS object_type, {_text(None)} AS datatype, "
                    f"{_text(None)} AS lang FROM (SELECT {subject} AS subject, {verb} AS predicate, {left} FROM {place(m.source)}) "
                    f"JOIN (SELECT {term_sql(parent.subject, types(parent.source))} AS object, {right} FROM {place(parent.source)}) "
                    f"USING ({', '.join(f'k{i}' for i in range(len(o.on)))})", m.source.table))
                continue
            target = named[o.parent].subject if isinstance(o, Reference) else o
            if isinstance(o, Reference) and named[o.parent].source != m.source:
                raise ValueError(f"{m.name}: a reference without a join needs the same source")
            datatype = target.datatype
            if target.kind == LITERAL and target.column is not None and not datatype and not target.lang:
                datatype = xsd_for(mine[target.column.lower()])
            entries.append((subject, verb, term_sql(target, mine), text_literal(target.kind), _text(datatype), _text(target.lang)))
    for source, entries in unfolded.items():
        if entries:
            branches.append(_finished(_stacked(entries, place(source)), source.table))
    return "\nUNION ALL\n".join(branches)


def _stacked(entries: list[tuple[str, ...]], place: str) -> str:
    """Terms are spelled once, however many triples of a row they stand in."""
    terms = {t: f"t{i}" for i, t in enumerate(dict.fromkeys(t for e in entries for t in e[:3]))}
    cells = ", ".join(", ".join([*(terms[t] for t in e[:3]), *e[3:]]) for e in entries)
    columns = ", ".join(f"{t} AS {name}" for t, name in terms.items())
    return f"SELECT stack({len(entries)}, {cells}) AS ({', '.join(_PARTS)}) FROM (SELECT {columns} FROM {place})"


def _finished(body: str, table: str | None) -> str:
    return (
        f"SELECT {', '.join(_PARTS)}, false AS inferred, {_text(table)} AS source_table FROM (\n{body}\n)"
        " WHERE subject IS NOT NULL AND predicate IS NOT NULL AND object IS NOT NULL"
    )


def create_view(spark: SparkSession, name: str, mapping: Mapping, schemas: Schemas, relation: Callable[[str], str] = safe_name) -> None:
    """A persistent view with the rows of a full build; it lasts as long as the catalogue and always shows the tables as they are."""
    spark.sql(f"CREATE OR REPLACE VIEW {safe_name(name)} AS {statement(mapping, schemas, relation)}")
