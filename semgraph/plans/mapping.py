"""Mapping configuration: how rows of tables become triples."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field, replace

from semgraph.functions.templates import rename_slots, slots
from semgraph.functions.terms import IRI, LITERAL, RDF_TYPE, iri_local_name

DIRECTIONS = ("forward", "reverse", "bidirectional")


@dataclass(frozen=True)
class Source:
    """A table name or one SELECT, exactly one of the two."""

    table: str | None = None
    query: str | None = None

    def __post_init__(self) -> None:
        if (self.table is None) == (self.query is None):
            raise ValueError("a source is a table name or a query, exactly one of them")


@dataclass(frozen=True)
class Term:
    """A constant, column or template valued term."""

    constant: str | None = None
    column: str | None = None
    template: str | None = None
    kind: str = IRI
    datatype: str | None = None
    lang: str | None = None

    def __post_init__(self) -> None:
        if sum(v is not None for v in (self.constant, self.column, self.template)) != 1:
            raise ValueError("a term is a constant, a column or a template, exactly one of them")
        if self.datatype and self.lang:
            raise ValueError("a term has a datatype or a language, not both")
        if (self.datatype or self.lang) and self.kind != LITERAL:
            raise ValueError("only literals have a datatype or a language")

    @property
    def columns(self) -> tuple[str, ...]:
        if self.column is not None:
            return (self.column,)
        return slots(self.template) if self.template is not None else ()


@dataclass(frozen=True)
class Reference:
    """The object is another map's subject, joined on (child, parent) column pairs."""

    parent: str
    on: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Properties:
    """Every predicate with every object."""

    predicates: tuple[Term, ...]
    objects: tuple[Term | Reference, ...]


@dataclass(frozen=True)
class TripleMap:
    name: str
    source: Source
    subject: Term
    classes: tuple[str, ...] = ()
    properties: tuple[Properties, ...] = ()


@dataclass(frozen=True)
class Attribute:
    property_iri: str
    column: str
    datatype: str | None = None
    lang: str | None = None


@dataclass(frozen=True)
class ClassMap:
    class_iri: str
    table: str | None = None
    key: tuple[str, ...] = ()
    attributes: tuple[Attribute, ...] = ()
    query: str | None = None
    template: str | None = None

    def __post_init__(self) -> None:
        if not self.key and not self.template:
            raise ValueError(f"{self.class_iri}: key columns or a subject template are required")
        Source(self.table, self.query)

    @property
    def source(self) -> Source:
        return Source(self.table, self.query)

    @property
    def key_columns(self) -> tuple[str, ...]:
        return self.key or slots(self.template)


@dataclass(frozen=True)
class Relation:
    """Without a table the target key lies on the source class's own rows and no join is needed."""

    property_iri: str
    source_class: str
    target_class: str
    target_key: tuple[str, ...] = ()
    source_key: tuple[str, ...] = ()
    table: str | None = None
    query: str | None = None
    direction: str = "forward"

    def __post_init__(self) -> None:
        if self.direction not in DIRECTIONS:
            raise ValueError(f"direction is one of {', '.join(DIRECTIONS)}")


@dataclass(frozen=True)
class Mapping:
    base_iri: str
    classes: tuple[ClassMap, ...] = ()
    relations: tuple[Relation, ...] = ()
    extra_maps: tuple[TripleMap, ...] = ()
    _by_class: dict = field(init=False, repr=False, compare=False, default=None)

    def __post_init__(self) -> None:
        object.__setattr__(self, "_by_class", {c.class_iri: c for c in self.classes})

    def class_map(self, class_iri: str) -> ClassMap:
        if class_iri not in self._by_class:
            raise KeyError(f"{class_iri} has no class mapping")
        return self._by_class[class_iri]

    def subject_template(self, class_iri: str) -> str:
        c = self.class_map(class_iri)
        if c.template:
            return c.template
        return f"{self.base_iri}{iri_local_name(class_iri)}/" + "-".join("{" + k + "}" for k in c.key)

    def triple_maps(self) -> tuple[TripleMap, ...]:
        """Classes and relations spelled as triple maps, followed by the hand-written ones."""
        maps = [self._class_triples(c) for c in self.classes]
        for i, r in enumerate(self.relations):
            maps += self._relation_triples(r, i)
        maps += self.extra_maps
        if not maps:
            raise ValueError("the mapping produces no triples")
        return tuple(maps)

    def _class_triples(self, c: ClassMap) -> TripleMap:
        return TripleMap(
            name=f"class:{c.class_iri}",
            source=c.source,
            subject=Term(template=self.subject_template(c.class_iri)),
            classes=(c.class_iri,),
            properties=tuple(
                Properties(
                    (Term(constant=a.property_iri),),
                    (Term(column=a.column, kind=LITERAL, datatype=a.datatype, lang=a.lang),),
                )
                for a in c.attributes
            ),
        )

    def _relation_triples(self, r: Relation, position: int) -> list[TripleMap]:
        source, target = self.class_map(r.source_class), self.class_map(r.target_class)
        linked = r.table is not None or r.query is not None
        if linked:
            where = Source(r.table, r.query)
            source_key = r.source_key
            target_key = r.target_key or (target.key_columns if r.table == target.table else ())
        else:
            where, source_key, target_key = source.source, source.key_columns, r.target_key
        if not source_key or not target_key:
            raise ValueError(f"{r.property_iri}: a link table needs a source key and a target key")
        left = rename_slots(
            self.subject_template(r.source_class), source.key_columns, tuple(source_key), r.property_iri
        )
        right = rename_slots(
            self.subject_template(r.target_class), target.key_columns, tuple(target_key), r.property_iri
        )
        ends = {"forward": [(left, right)], "reverse": [(right, left)]}.get(
            r.direction, [(left, right), (right, left)]
        )
        return [
            TripleMap(
                name=f"relation:{position}:{r.property_iri}:{n}",
                source=where,
                subject=Term(template=s),
                properties=(Properties((Term(constant=r.property_iri),), (Term(template=o),)),),
            )
            for n, (s, o) in enumerate(ends)
        ]

    def only_class(self, class_iri: str) -> tuple[TripleMap, ...]:
        """The class's own map and the relations whose subjects are its instances."""
        template = self.subject_template(class_iri)
        shape = [p if isinstance(p, str) else None for p in _pieces(template)]
        return tuple(
            m
            for m in self.triple_maps()
            if class_iri in m.classes
            or (
                not m.classes
                and m.subject.template is not None
                and [p if isinstance(p, str) else None for p in _pieces(m.subject.template)] == shape
            )
        )

    def restricted(self, predicates: set[str]) -> tuple[TripleMap, ...]:
        """Only what produces the given predicates (``rdf:type`` keeps the class triples)."""
        kept = []
        for m in self.triple_maps():
            properties = tuple(
                replace(p, predicates=found)
                for p in m.properties
                if (found := tuple(t for t in p.predicates if t.constant is None or t.constant in predicates))
            )
            classes = m.classes if RDF_TYPE in predicates else ()
            if classes or properties:
                kept.append(replace(m, classes=classes, properties=properties))
        return tuple(kept)

    def columns_read(self) -> list[tuple[str, str, str]]:
        """(table, what reads it, column) for every column the mapping reads."""
        out = []
        for c in self.classes:
            if c.table:
                what = f"class {iri_local_name(c.class_iri)}"
                out += [(c.table, what, k) for k in c.key_columns + tuple(a.column for a in c.attributes)]
        for r in self.relations:
            table = r.table or (None if r.query else self.class_map(r.source_class).table)
            if table:
                what = f"relation {iri_local_name(r.property_iri)}"
                out += [(table, what, k) for k in tuple(r.source_key) + tuple(r.target_key)]
        return list(dict.fromkeys(out))

    def tables_of(self) -> dict[str, set[str]]:
        """Producing table to every table its triples depend on (a joined parent included)."""
        maps = self.triple_maps()
        by_name = {m.name: m for m in maps}
        out: dict[str, set[str]] = {}
        for m in maps:
            if m.source.table is None:
                continue
            needed = out.setdefault(m.source.table, {m.source.table})
            for p in m.properties:
                for o in p.objects:
                    if isinstance(o, Reference) and by_name[o.parent].source.table:
                        needed.add(by_name[o.parent].source.table)
        return out

    def table_hashes(self) -> dict[str, str]:
        """Fingerprint of what the mapping does with each producing table."""
        maps = self.triple_maps()
        by_name = {m.name: m for m in maps}
        grouped: dict[str, list[str]] = {}
        for m in maps:
            if m.source.table:
                # A map also changes when the subject it refers to changes.
                parents = [
                    asdict(by_name[o.parent]) for p in m.properties for o in p.objects if isinstance(o, Reference)
                ]
                body = {k: v for k, v in asdict(m).items() if k != "name"}
                grouped.setdefault(m.source.table, []).append(json.dumps([body, parents], sort_keys=True))
        return {t: hashlib.sha256("\n".join(sorted(v)).encode()).hexdigest() for t, v in grouped.items()}

    def has_query_sources(self) -> bool:
        return any(m.source.query is not None for m in self.triple_maps())


def _pieces(template: str):
    from semgraph.functions.templates import split_template

    return split_template(template)
