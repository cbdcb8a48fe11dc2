"""OWL 2 RL consequences of an ontology over a graph.

Axioms are configuration: each family of them is one small table joined to the facts of the last round.
Hierarchies are closed before they meet the data, so one join reaches every ancestor.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semgraph.functions.scratch import FEW, Scratch
from semgraph.functions.skew import split_join
from semgraph.functions.terms import (
    IRI, LITERAL, OWL, OWL_NOTHING, RDF, RDF_TYPE, RDFS, RDFS_COMMENT, RDFS_LABEL, TRIPLE_COLUMNS, is_bnode,
)
from semgraph.operators import reach
from semgraph.operators.components import connected_components
from semgraph.plans.ontology import Ontology, reachable

FACT = ("subject", "predicate", "object", "object_type", "datatype")
KEY = ["subject", "predicate", "object"]
MAX_ROUNDS = 50

# Terms whose consequences say nothing about entities.
NOISE_TYPES = (
    OWL + "Thing", RDFS + "Resource", OWL + "NamedIndividual", RDFS + "Literal", OWL + "Class", RDF + "Property",
    OWL + "ObjectProperty", OWL + "DatatypeProperty", OWL + "Ontology",
)
NOISE_PREDICATES = (
    OWL + "sameAs", OWL + "differentFrom", RDFS + "subClassOf", RDFS + "subPropertyOf", OWL + "equivalentClass",
    OWL + "equivalentProperty", RDFS + "domain", RDFS + "range", OWL + "inverseOf",
)


@dataclass
class Closure:
    triples: DataFrame
    inconsistent: DataFrame
    rounds: int
    rederived: list[int]  # facts fed again after each merge


@dataclass
class _Axioms:
    """The ontology as small tables of pairs; an empty family stays None and costs no join."""

    superclass: DataFrame | None
    superproperty: DataFrame | None
    domain: DataFrame | None
    range: DataFrame | None
    swapped: DataFrame | None
    transitive: list[str]
    chains: list[tuple[str, tuple[str, ...]]]
    has_value: list[tuple[str, str, str]]
    only: DataFrame | None
    same_object: list[str]
    same_subject: list[str]
    max_one: list[tuple[str, str]]
    disjoint: DataFrame | None


def _pairs(spark: SparkSession, rows: Iterable[tuple], schema: str) -> DataFrame | None:
    rows = sorted(set(rows))
    return F.broadcast(spark.createDataFrame(rows, schema)) if rows else None


def _compile(spark: SparkSession, o: Ontology) -> _Axioms:
    up: dict[str, set[str]] = {}
    for c in o.classes:
        up.setdefault(c.iri, set()).update(c.parents, c.equivalent)
        for e in c.equivalent:
            up.setdefault(e, set()).add(c.iri)
    class_family = {c: reachable(up, c) for c in set(up) | set().union(*up.values())} if up else {}
    family = lambda c: class_family.get(c, {c})
    props = (*o.object_properties, *o.data_properties)
    prop_up = {p.iri: set(p.parents) for p in props}
    swapped = [(p.iri, p.iri) for p in o.object_properties if "symmetric" in p.characteristics]
    for p in o.object_properties:
        if p.inverse_of:
            swapped += [(p.iri, p.inverse_of), (p.inverse_of, p.iri)]
    with_trait = lambda t: [p.iri for p in o.object_properties if t in p.characteristics]
    # A union domain types its subjects with an anonymous class at most: it says nothing.
    domains = [(p.iri, a) for p in props if len(p.all_domains) == 1 for a in family(p.all_domains[0])]
    ranges = [(p.iri, a) for p in o.object_properties if p.range for a in family(p.range)]
    restrictions = [(c.iri, r) for c in o.classes for r in c.restrictions]
    disjoint = [(c.iri, d) for c in o.classes for d in c.disjoint]
    return _Axioms(
        superclass=_pairs(spark, [(c, a) for c, f in class_family.items() for a in f if a != c],
                          "object string, _super string"),
        superproperty=_pairs(spark, [(p, a) for p in prop_up for a in reachable(prop_up, p) if a != p],
                             "predicate string, _super string"),
        domain=_pairs(spark, domains, "predicate string, _class string"),
        range=_pairs(spark, ranges, "predicate string, _class string"),
        swapped=_pairs(spark, swapped, "predicate string, _back string"),
        transitive=with_trait("transitive"),
        chains=[(p.iri, chain) for p in o.object_properties for chain in p.chains],
        has_value=[(c, r.property, str(r.value)) for c, r in restrictions if r.kind == "has_value"],
        only=_pairs(
            spark,
            [(c, r.property, str(r.value)) for c, r in restrictions
             if r.kind == "only" and o.is_object_property(r.property)],
            "_of string, predicate string, _class string",
        ),
        same_object=with_trait("functional"),
        same_subject=with_trait("inverse_functional"),
        max_one=[(c, r.property) for c, r in restrictions if r.kind == "max" and int(r.value) == 1],
        disjoint=_pairs(spark, disjoint + [(b, a) for a, b in disjoint], "_a string, _b string"),
    )


def _fact(df: DataFrame, subject, predicate, obj, kind, datatype=None) -> DataFrame:
    empty = F.lit(None).cast("string")
    return df.select(
        subject.alias("subject"), predicate.alias("predicate"), obj.alias("object"), kind.alias("object_type"),
        (datatype if datatype is not None else empty).alias("datatype"),
    )


def _typed(df: DataFrame, subject: str, cls: str) -> DataFrame:
    return _fact(df, F.col(subject), F.lit(RDF_TYPE), F.col(cls), F.lit(IRI))


def _consequences(new: DataFrame, facts: DataFrame, ax: _Axioms) -> list[DataFrame]:
    """Facts that follow when at least one premise is new."""
    c = F.col
    types = new.where(c("predicate") == RDF_TYPE)
    links = new.where((c("predicate") != RDF_TYPE) & (c("object_type") != LITERAL))
    out = []
    if ax.superclass is not None:
        out.append(_typed(types.join(ax.superclass, "object"), "subject", "_super"))
    if ax.superproperty is not None:
        up = new.join(ax.superproperty, "predicate")
        out.append(_fact(up, c("subject"), c("_super"), c("object"), c("object_type"), c("datatype")))
    if ax.domain is not None:
        out.append(_typed(new.join(ax.domain, "predicate"), "subject", "_class"))
    if ax.range is not None:
        out.append(_typed(links.join(ax.range, "predicate"), "object", "_class"))
    if ax.swapped is not None:
        back = links.join(ax.swapped, "predicate")
        out.append(_fact(back, c("object"), c("_back"), c("subject"), F.lit(IRI)))
    for cls, prop, value in ax.has_value:
        held = types.where(c("object") == cls)
        kind = IRI if value.startswith(("http://", "https://", "urn:")) else LITERAL
        out.append(_fact(held, c("subject"), F.lit(prop), F.lit(value), F.lit(kind)))
    for prop, chain in ax.chains:
        out += [_chained(prop, chain, new, facts, at) for at in range(len(chain))]
    if ax.only is not None:
        all_types = facts.where(c("predicate") == RDF_TYPE)
        all_links = facts.where((c("predicate") != RDF_TYPE) & (c("object_type") != LITERAL))
        for t, l in ((types, all_links), (all_types, links)):
            holders = t.join(ax.only, t["object"] == ax.only["_of"]).select(
                c("subject"), ax.only["predicate"].alias("predicate"), c("_class")
            )
            out.append(_typed(l.join(holders, ["subject", "predicate"]), "object", "_class"))
    return out


def _chained(prop: str, chain: tuple[str, ...], new: DataFrame, facts: DataFrame, new_at: int) -> DataFrame:
    """Compose a chain of properties; the ``new_at``-th step is read from the new facts."""
    steps = []
    for i, p in enumerate(chain):
        source = new if i == new_at else facts
        rows = source.where((F.col("predicate") == p) & (F.col("object_type") != LITERAL))
        steps.append(rows.select(F.col("subject").alias(f"_n{i}"), F.col("object").alias(f"_n{i + 1}")))
    path = steps[0]
    for i, step in enumerate(steps[1:], start=1):
        path = path.join(step, f"_n{i}").select("_n0", f"_n{i + 1}")
        if i + 1 < len(steps):  # many ways to one end would multiply; the last step's are reduced with all new facts
            path = path.distinct()
    return _fact(path, F.col("_n0"), F.lit(prop), F.col(f"_n{len(chain)}"), F.lit(IRI))


def _same_pairs(facts: DataFrame, ax: _Axioms, fresh: DataFrame | None) -> DataFrame | None:
    """Links between terms that must be equal: every value to the smallest of its group, never all pairs.

    ``fresh`` are the facts found since the last look (None: all are): only groups that one of them joined are looked at.
    """
    links = facts.where((F.col("predicate") != RDF_TYPE) & (F.col("object_type") != LITERAL))
    parts = []

    def star(rows: DataFrame, by: list[str], member: str, whole: bool = False) -> DataFrame:
        if fresh is not None and not whole:
            joined = fresh.where(F.col("predicate").isin(*ax.same_object, *ax.same_subject)).select(*by).distinct()
            rows = rows.join(joined, by, "left_semi")
        least = rows.groupBy(*by).agg(F.min(member).alias("src"), F.max(member).alias("_last"))
        several = least.where(F.col("src") != F.col("_last")).drop("_last")
        return split_join(rows, several, by).where(F.col(member) != F.col("src")).select("src", F.col(member).alias("dst"))

    if ax.same_object:
        parts.append(star(links.where(F.col("predicate").isin(*ax.same_object)), ["subject", "predicate"], "object"))
    if ax.same_subject:
        parts.append(star(links.where(F.col("predicate").isin(*ax.same_subject)), ["predicate", "object"], "subject"))
    for cls, prop in ax.max_one:  # a new type may count an old link: these are looked at whole
        typed = facts.where((F.col("predicate") == RDF_TYPE) & (F.col("object") == cls)).select("subject")
        rows = links.where(F.col("predicate") == prop).join(typed, "subject", "left_semi")
        parts.append(star(rows, ["subject", "predicate"], "object", whole=True))
    return reduce(DataFrame.unionByName, parts).distinct() if parts else None


def _touched(facts: DataFrame, canon: DataFrame) -> DataFrame:
    """Facts that name a term which is not its class's representative, with both ends replaced."""
    moved = canon.where("node <> component")
    for place in ("subject", "object"):
        names = moved.select(F.col("node").alias(place), F.col("component").alias(f"_{place}"))
        facts = split_join(facts, names, [place], "left")
    facts = facts.where(F.col("_subject").isNotNull() | F.col("_object").isNotNull())
    return facts.withColumn("subject", F.coalesce("_subject", "subject")).withColumn("object", F.coalesce("_object", "object")).select(*FACT)


def _untouched(facts: DataFrame, canon: DataFrame) -> DataFrame:
    moved = canon.where("node <> component")
    for place in ("subject", "object"):
        facts = split_join(facts, moved.select(F.col("node").alias(place)), [place], "left_anti")
    return facts


def _expanded(facts: DataFrame, canon: DataFrame) -> DataFrame:
    """Every fact about a representative stated for all members of its class."""
    for place in ("subject", "object"):
        members = canon.select(F.col("component").alias(place), F.col("node").alias("_member"))
        facts = facts.join(members, place, "left").withColumn(place, F.coalesce("_member", place)).drop("_member")
    return facts.select(*FACT).distinct()


def closure(triples: DataFrame, ontology: Ontology, max_rounds: int = MAX_ROUNDS) -> Closure:
    """New facts about entities, and the entities that are inconsistent.

    Only asserted triples are read, so running it twice gives the same layer. Equality from functional
    properties is kept as one representative per class while facts are derived, and spelled out for all
    members at the end. After a merge only facts that name a merged term are rewritten and derived from again.
    A transitive property is closed as a whole when facts of it appear, and extended by later ones.
    """
    spark = triples.sparkSession
    scratch = Scratch(spark, "owl", FEW)
    ax = _compile(spark, ontology)
    asserted = triples.where(~F.col("inferred")).select(*FACT)
    counts = {f"t{i}": F.count_if((F.col("predicate") == p) & (F.col("object_type") != LITERAL)) for i, p in enumerate(ax.transitive)}
    facts, seen = scratch.measured(asserted.distinct().sortWithinPartitions("predicate", "subject"), "facts", **counts)
    base, new, canon = facts, facts, None
    paths: dict[str, DataFrame] = {}
    fresh: list[DataFrame] | None = None  # facts since the last look for equal terms; None: all
    rounds, rederived = 0, []
    while True:
        while True:
            rounds += 1
            if rounds > max_rounds:
                raise RuntimeError(f"no closure after {max_rounds} rounds")
            for i, prop in enumerate(ax.transitive):
                if not seen[f"t{i}"]:
                    continue
                more = _closed_links(scratch, prop, facts, new, paths)
                new, facts = new.unionByName(more), facts.unionByName(more)
                if fresh is not None:
                    fresh.append(more)
            derived = _consequences(new, facts, ax)
            if not derived:
                break
            # The kind of a derived fact does not depend on how it was derived.
            found = reduce(DataFrame.unionByName, derived).dropDuplicates(KEY)
            new, seen = scratch.measured(found.join(_known(facts), KEY, "left_anti"), "round", **counts)
            if not seen["n"]:
                break
            facts = facts.unionByName(new)
            if fresh is not None:
                fresh.append(new)
        since = None if fresh is None else reduce(DataFrame.unionByName, fresh)
        same = _same_pairs(facts, ax, since)
        if same is None:
            break
        same, seen = scratch.measured(same, "same")
        if not seen["n"]:
            break
        merged = connected_components(same)
        if canon is not None:
            earlier = canon.join(merged.select(F.col("node").alias("component"), F.col("component").alias("_to")),
                                 "component", "left")
            merged = earlier.select("node", F.coalesce("_to", "component").alias("component")).unionByName(
                merged.join(canon.select("node"), "node", "left_anti")
            )
        canon = scratch.save(merged, "canon")
        left = scratch.save(_untouched(facts, canon), "facts", sort=("predicate", "subject"))
        moved = _touched(facts, canon).dropDuplicates(KEY).join(_known(left), KEY, "left_anti")
        new, seen = scratch.measured(moved, "moved", **counts)
        rederived.append(seen["n"])
        facts, fresh, paths = left.unionByName(new), [new], {}
    if ax.disjoint is not None:
        types = facts.where(F.col("predicate") == RDF_TYPE).select("subject", "object")
        clashing = types.join(ax.disjoint, types["object"] == F.col("_a")).select("subject", F.col("_b").alias("object"))
        broken = clashing.join(types, ["subject", "object"], "left_semi").select("subject").distinct()
        nothing = _fact(broken, F.col("subject"), F.lit(RDF_TYPE), F.lit(OWL_NOTHING), F.lit(IRI))
        facts = facts.unionByName(nothing)
    if canon is not None:
        facts = _expanded(facts, canon)
    kept = facts.dropDuplicates(KEY).join(_known(base), KEY, "left_anti").where(_kept(ontology))
    empty = F.lit(None).cast("string")
    kept = kept.withColumns({"lang": empty, "inferred": F.lit(True), "source_table": empty}).select(*TRIPLE_COLUMNS)
    kept = scratch.save(kept, "inferred")
    wrong = kept.where((F.col("predicate") == RDF_TYPE) & (F.col("object") == OWL_NOTHING)).select("subject")
    return Closure(kept, wrong.orderBy("subject"), rounds, rederived)


def _known(facts: DataFrame) -> DataFrame:
    """Facts to be left out of a join: as many as the graph has, so they never go through the driver."""
    return facts.select(*KEY).hint("merge")


def _closed_links(scratch: Scratch, prop: str, facts: DataFrame, new: DataFrame, paths: dict[str, DataFrame]) -> DataFrame:
    """Facts that make a transitive property closed. ``paths`` keeps what is closed already, up to ``new``."""
    def links(rows: DataFrame) -> DataFrame:
        rows = rows.where((F.col("predicate") == prop) & (F.col("object_type") != LITERAL))
        return rows.select(F.col("subject").alias("a"), F.col("object").alias("b"))

    known = links(facts)
    if prop in paths:
        old = paths[prop]
        added = links(new).distinct().join(old.hint("merge"), ["a", "b"], "left_anti")
        added = scratch.save(added, "added")
        more = scratch.save(reach.extended(scratch, old, added), "more")
        paths[prop] = old.unionByName(added).unionByName(more)
    else:
        paths[prop] = reach.closed(scratch, known)
        more = scratch.save(paths[prop].join(known.hint("merge"), ["a", "b"], "left_anti"), "more")
    return _fact(more, F.col("a"), F.lit(prop), F.col("b"), F.lit(IRI))


def _kept(ontology: Ontology):
    """Whether a derived fact is about an entity and worth keeping."""
    s, p, o = F.col("subject"), F.col("predicate"), F.col("object")
    terms = sorted(ontology.terms())
    keep = ~is_bnode(s) & ~p.isin(*NOISE_PREDICATES)
    if terms:
        keep = keep & ~s.isin(*terms)
    keep = keep & ~((p == RDF_TYPE) & o.isin(*NOISE_TYPES))
    return keep & ~((F.col("object_type") == LITERAL) & p.isin(RDFS_LABEL, RDFS_COMMENT))
