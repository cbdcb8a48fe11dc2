"""Questions asked of a triple DataFrame."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semgraph.functions.scratch import Scratch
from semgraph.functions.skew import split_join, tasks_for
from semgraph.functions.terms import (
    LITERAL, RDF_TYPE, RDFS_LABEL, XSD, extracted_number, fallback_label, is_bnode, local_name, quoted,
)
from semgraph.plans.ontology import Ontology

# Local names that mark a naming property, and the endings that do too.
LABEL_NAMES = ("name", "label", "title", "fullname", "displayname")
LABEL_ENDINGS = ("name", "_label", "title")
MATCHES = ("contains", "exact", "starts_with", "ends_with")
FIELDS = ("any", "label", "iri")
SORTABLE = ("subject", "predicate", "object", "inferred")
# A result of at most this many rows is named by broadcasting it; a larger one is joined.
FEW = 10_000
# XSD types that become typed columns; everything else stays text.
SCALARS = {
    XSD + "integer": "bigint", XSD + "int": "bigint", XSD + "long": "bigint", XSD + "decimal": "double",
    XSD + "double": "double", XSD + "float": "double", XSD + "boolean": "boolean",
}


# -- inventories ---------------------------------------------------------------------------------------

def counts(triples: DataFrame) -> DataFrame:
    return triples.agg(
        F.count("*").alias("triples"),
        F.count_if("inferred").alias("inferred"),
        F.count_if(~F.col("inferred")).alias("asserted"),
    )


def type_inventory(triples: DataFrame) -> DataFrame:
    typed = triples.where((F.col("predicate") == RDF_TYPE) & ~is_bnode(F.col("subject")))
    return typed.groupBy(F.col("object").alias("type")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "type")


def predicate_inventory(triples: DataFrame) -> DataFrame:
    return triples.groupBy("predicate").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "predicate")


def predicates(triples: DataFrame) -> DataFrame:
    return triples.select("predicate").distinct()


def status(triples: DataFrame) -> DataFrame:
    """Totals, inventory of types and inventory of predicates, from one pass over the graph.

    Both inventories roll up from counts per (predicate, class), which are as few as the vocabulary.
    """
    kind = F.when((F.col("predicate") == RDF_TYPE) & ~is_bnode(F.col("subject")), F.col("object"))
    base = triples.groupBy("predicate", kind.alias("type")).agg(
        F.count("*").alias("n"), F.count_if("inferred").alias("inferred")
    )
    rolled = base.groupingSets([["predicate"], ["type"], []], "predicate", "type").agg(
        F.grouping_id().alias("level"), F.sum("n").alias("n"), F.sum("inferred").alias("inferred")
    )
    section = F.when(F.col("level") == 3, "total").when(F.col("level") == 1, "predicate").otherwise("type")
    out = rolled.select(
        section.alias("section"), F.coalesce("predicate", "type", F.lit("*")).alias("name"), "type", "n", "inferred"
    )
    return out.where((F.col("section") != "type") | F.col("type").isNotNull()).drop("type")


def asserted(triples: DataFrame) -> DataFrame:
    return triples.where(~F.col("inferred"))


def inferred(triples: DataFrame) -> DataFrame:
    return triples.where("inferred")


def page(
    triples: DataFrame, *, subject: str | None = None, predicate: str | None = None, text: str | None = None,
    inferred: bool | None = None, sort: str = "subject", descending: bool = False, limit: int = 100, offset: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """(matching total, one page of rows) for a triples grid."""
    if sort not in SORTABLE:
        raise ValueError(f"sort by one of {', '.join(SORTABLE)}")
    found = triples
    if subject:
        found = found.where(F.col("subject") == subject)
    if predicate:
        found = found.where(F.col("predicate") == predicate)
    if text:
        needle = F.lit(text.lower())
        hit = F.lit(False)
        for c in ("object", "subject", "predicate"):
            hit = hit | F.contains(F.lower(c), needle)
        found = found.where(hit)
    if inferred is not None:
        found = found.where(F.col("inferred") == inferred)
    first = F.desc(sort) if descending else F.asc(sort)
    order = [first] + [F.asc(c) for c in ("subject", "predicate", "object") if c != sort]
    rows = found.select("subject", "predicate", "object", "object_type", "datatype", "lang", "inferred")
    return found.agg(F.count("*").alias("total")), rows.orderBy(*order).offset(offset).limit(limit)


# -- names -----------------------------------------------------------------------------------------------

def label_rank(predicate: Column) -> Column:
    """0 for rdfs:label, 1 for a property whose name says it names things, else NULL."""
    name = F.lower(local_name(predicate))
    ending = name.rlike("(" + "|".join(LABEL_ENDINGS) + ")$")
    return F.when(predicate == RDFS_LABEL, 0).when(name.isin(*LABEL_NAMES) | ending, 1)


def labels(triples: DataFrame) -> DataFrame:
    """(subject, label) of everything that carries a naming literal."""
    named = triples.where(F.col("object_type") == LITERAL).withColumn("_rank", label_rank(F.col("predicate")))
    named = named.where(F.col("_rank").isNotNull()).repartition("subject")  # sorted there, not in the tasks of a scan
    return named.groupBy("subject").agg(
        F.min_by("object", F.struct("_rank", "predicate", "object")).alias("label")
    )


def with_label(df: DataFrame, triples: DataFrame, iri: str, out: str = "label", *, few: bool = False) -> DataFrame:
    """Add the label of ``iri``, or its last IRI segments. ``few`` says df is a bounded top-k result."""
    names = triples
    if few:
        wanted = df.select(F.col(iri).alias("subject")).distinct()
        names = triples.join(F.broadcast(wanted), "subject", "left_semi")
    found = labels(names).select(F.col("subject").alias("_iri"), F.col("label").alias("_label"))
    if few:
        joined = df.join(F.broadcast(found), df[quoted(iri)] == F.col("_iri"), "left")
    else:  # most rows may name one entity; names are many times larger than their files: never sent to every task
        joined = split_join(df.withColumn("_iri", F.col(quoted(iri))), found, ["_iri"], "left", hint="merge")
    return joined.withColumn(out, F.coalesce("_label", fallback_label(F.col(iri)))).drop("_iri", "_label")


def entities(triples: DataFrame, iris: DataFrame, column: str = "iri") -> DataFrame:
    """Label and sorted types of each IRI. The type list is as long as the vocabulary at most."""
    wanted = iris.select(F.col(column).alias("iri")).distinct()
    types = triples.where(F.col("predicate") == RDF_TYPE).groupBy(F.col("subject").alias("iri")).agg(
        F.array_sort(F.collect_set("object")).alias("types")
    )
    out = with_label(wanted, triples, "iri").join(types, "iri", "left")
    return out.withColumn("types", F.coalesce("types", F.array().cast("array<string>")))


def described(triples: DataFrame, nodes: DataFrame, column: str = "node") -> DataFrame:
    """The rows with ``label`` and ``types`` of the entity in a column: nodes of a neighbourhood, ends of an overview."""
    about = entities(triples, nodes, column).withColumnRenamed("iri", column)
    return nodes.join(about, column, "left")


# -- search ----------------------------------------------------------------------------------------------

def _hit(col: Column, needle: Column, match: str) -> Column:
    text = F.lower(col)
    return {
        "contains": F.contains(text, needle),
        "exact": text == needle,
        "starts_with": F.startswith(text, needle),
        "ends_with": F.endswith(text, needle),
    }[match]


def _candidates(triples: DataFrame, type_iri: str | None) -> DataFrame:
    found = triples.where(~is_bnode(F.col("subject")))
    if type_iri is not None:
        typed = triples.where((F.col("predicate") == RDF_TYPE) & (F.col("object") == type_iri))
        found = found.join(typed.select("subject").distinct(), "subject", "left_semi")
    return found


def _field_hit(needle: Column, match: str, field: str) -> Column:
    literal = (F.col("object_type") == LITERAL) & _hit(F.col("object"), needle, match)
    iri = _hit(F.col("subject"), needle, match)
    return {"any": literal | iri, "label": literal, "iri": iri}[field]


def _rank(needle: Column) -> Column:
    text = F.lower("object")
    return (
        F.when(text == needle, 0).when(F.startswith(text, needle), 1)
        .when(F.col("object_type") == LITERAL, 2).otherwise(3)
    )


def search(
    triples: DataFrame, text: str, *, type_iri: str | None = None, limit: int = 20, match: str = "contains",
    field: str = "any", label: bool = True,
) -> DataFrame:
    """Best ``limit`` entities: exact before prefix before inner match, shortest first."""
    _check_search(match, field)
    needle = F.lit(text.lower())
    found = _candidates(triples.where(_field_hit(needle, match, field)), None)
    if type_iri is not None:
        typed = triples.where((F.col("predicate") == RDF_TYPE) & (F.col("object") == type_iri))
        found = found.join(typed.select("subject"), "subject", "left_semi")
    best = found.groupBy("subject").agg(
        F.min(_rank(needle)).alias("rank"), F.min(F.length("object")).alias("length")
    )
    top = best.orderBy("rank", "length", "subject").limit(limit)
    return with_label(top, triples, "subject", few=limit <= FEW) if label else top


def search_many(
    triples: DataFrame, texts: Sequence[str], *, type_iri: str | None = None, limit: int | None = 20,
    match: str = "contains", field: str = "any",
) -> DataFrame:
    """``search`` for a configured list of texts in one pass: each triple is tested against every text.

    The ``limit`` best of each text, numbered by ``position``; without one all, unnumbered.
    """
    _check_search(match, field)
    asked = F.array(*[F.lit(t.lower()) for t in texts])
    matching = F.filter(asked, lambda q: _field_hit(q, match, field))
    found = _candidates(triples, type_iri).withColumn("query", F.explode(matching))
    best = found.groupBy("query", "subject").agg(
        F.min(_rank(F.col("query"))).alias("rank"), F.min(F.length("object")).alias("length")
    )
    if limit is None:
        return best
    order = Window.partitionBy("query").orderBy("rank", "length", "subject")
    return best.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit)


def _check_search(match: str, field: str) -> None:
    if match not in MATCHES:
        raise ValueError(f"match is one of {', '.join(MATCHES)}")
    if field not in FIELDS:
        raise ValueError(f"field is one of {', '.join(FIELDS)}")


# -- entities ----------------------------------------------------------------------------------------------

def relationships(triples: DataFrame) -> DataFrame:
    """Triples between entities: no types, no literals."""
    return triples.where((F.col("predicate") != RDF_TYPE) & (F.col("object_type") != LITERAL))


def _asked(iris: DataFrame, column: str) -> DataFrame:
    """The distinct IRIs, written and counted: a few are sent to the graph, so that it is not shuffled for them."""
    wanted = iris.select(F.col(column).alias("iri")).distinct()
    return Scratch(iris.sparkSession, "asked", few=FEW).save(wanted, "iris")


def describe(triples: DataFrame, iris: DataFrame, column: str = "iri") -> DataFrame:
    """Everything known about each IRI, one row per fact.

    Sections are ``type``, ``attribute``, ``outgoing`` and ``incoming``. Facts stay rows, not nested
    lists, because a hub has as many incoming facts as the graph has edges.
    """
    wanted = _asked(iris, column)
    out = triples.join(wanted, triples.subject == wanted.iri)
    section = (
        F.when(F.col("object_type") == LITERAL, "attribute")
        .when(F.col("predicate") == RDF_TYPE, "type").otherwise("outgoing")
    )
    forward = out.select(
        "iri", section.alias("section"), "predicate", F.col("object").alias("value"), "datatype", "lang", "inferred"
    )
    pointing = triples.where(F.col("object_type") != LITERAL).join(wanted, F.col("object") == wanted.iri)
    backward = pointing.select(
        "iri", F.lit("incoming").alias("section"), "predicate", F.col("subject").alias("value"),
        F.lit(None).cast("string").alias("datatype"), F.lit(None).cast("string").alias("lang"), "inferred",
    )
    return forward.unionByName(backward)


def context(
    triples: DataFrame, iris: DataFrame, mapping, column: str = "iri", attachments: Mapping[str, Iterable[str]] | None = None,
) -> DataFrame:
    """Degrees, relation names, label, types, the source table and key of each IRI, and what is attached to its classes.

    ``attachments`` names by class the attributes, actions and datasets that can be asked of an instance; classes of an
    entity add up. Who its neighbours are is told by ``neighbours``.
    """
    facts = describe(triples, iris, column)
    summary = facts.groupBy("iri").agg(
        F.count_if(F.col("section") == "attribute").alias("attributes"),
        F.count_if(F.col("section") == "outgoing").alias("out_degree"),
        F.count_if(F.col("section") == "incoming").alias("in_degree"),
        F.array_sort(F.collect_set(F.when(F.col("section") == "outgoing", F.col("predicate")))).alias("out_predicates"),
        F.array_sort(F.collect_set(F.when(F.col("section") == "incoming", F.col("predicate")))).alias("in_predicates"),
    )
    where = facts.sparkSession.createDataFrame(
        [(c.class_iri, c.table, list(c.key_columns)) for c in mapping.classes],
        "class string, source_table string, key_columns array<string>",
    )
    held = facts.sparkSession.createDataFrame(
        sorted((c, name) for c, names in (attachments or {}).items() for name in names), "class string, attachment string")
    typed = facts.where(F.col("section") == "type").select("iri", F.col("value").alias("class"))
    origin = typed.join(where, "class").groupBy("iri").agg(
        F.min(F.struct("class", "source_table", "key_columns")).alias("origin")
    )
    offered = typed.join(F.broadcast(held), "class").groupBy("iri").agg(F.array_sort(F.collect_set("attachment")).alias("attachments"))
    out = entities(triples, iris, column).join(summary, "iri").join(origin, "iri", "left").join(offered, "iri", "left")
    nothing = F.array().cast("array<string>")
    return out.withColumn("attachments", F.coalesce("attachments", nothing)).select("*", "origin.source_table", "origin.key_columns").drop("origin")


def neighbours(triples: DataFrame, iris: DataFrame, column: str = "iri", limit: int | None = None) -> DataFrame:
    """(iri, direction, predicate, neighbour, label) of each IRI's links; with a ``limit`` the first of each direction.

    Links stay rows, for a hub has as many as the graph has edges.
    """
    facts = describe(triples.where(F.col("object_type") != LITERAL), iris, column).where(F.col("section").isin("outgoing", "incoming"))
    links = facts.select("iri", F.col("section").alias("direction"), "predicate", F.col("value").alias("neighbour"))
    links = links.repartition(*links.columns).distinct()  # grouped there, not in the tasks of a scan
    if limit is not None:
        order = Window.partitionBy("iri", "direction").orderBy("predicate", "neighbour")
        links = links.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= limit).drop("_place")
    # Written once: the join with names counts its keys first.
    return with_label(Scratch(triples.sparkSession, "neighbours").save(links, "links"), triples, "neighbour")


def neighbourhood(
    triples: DataFrame, seeds: DataFrame, depth: int = 1, limit: int | None = None, column: str = "iri"
) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) within ``depth`` undirected steps of every seed.

    ``limit`` keeps the nearest nodes per seed, ties by IRI; edges join kept nodes. Each round joins the new
    frontier to the links as they stand; only what was touched is made distinct.
    """
    if not 0 <= depth <= 6:
        raise ValueError("depth lies between 0 and 6")
    scratch = Scratch(triples.sparkSession, "neighbourhood")
    links = relationships(triples).select("subject", "predicate", "object")
    steps = links.select(F.col("subject").alias("node"), F.col("object").alias("next")).unionByName(
        links.select(F.col("object").alias("node"), F.col("subject").alias("next"))
    )
    start = seeds.select(F.col(column).alias("seed")).distinct()
    seen = scratch.save(start.select("seed", F.col("seed").alias("node"), F.lit(0).alias("distance")), "seen")
    frontier = seen
    for round_ in range(1, depth + 1):
        reached = frontier.select("seed", "node").join(steps, "node").select("seed", F.col("next").alias("node"))
        fresh = reached.distinct().join(seen, ["seed", "node"], "left_anti").withColumn("distance", F.lit(round_))
        frontier, found = scratch.measured(fresh, "frontier")
        if not found["n"]:
            break
        seen = seen.unionByName(frontier)
    nodes = seen
    if limit is not None:
        order = Window.partitionBy("seed").orderBy("distance", "node")
        nodes = nodes.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit).drop("_n")
        nodes = scratch.save(nodes, "nodes")
    grown = nodes.where(F.col("distance") < depth).select("seed", "node")
    out = grown.join(links, grown.node == links.subject).select("seed", "subject", "predicate", "object")
    into = grown.join(links, grown.node == links.object).select("seed", "subject", "predicate", "object")
    edges = out.unionByName(into).distinct()
    if limit is not None:
        for end in ("subject", "object"):
            kept = nodes.select("seed", F.col("node").alias(end))
            edges = edges.join(kept, ["seed", end], "left_semi")
    return nodes, edges.select("seed", "subject", "predicate", "object")


def overview(triples: DataFrame, limit: int = 300) -> DataFrame:
    """A first picture: the same number of relationships of every kind, spread by hash."""
    links = relationships(triples)
    kinds = links.select("predicate").distinct().count()
    if kinds == 0:
        return links.select("subject", "predicate", "object")
    share = max(1, limit // kinds)
    links = links.where(~is_bnode(F.col("subject"))).select("subject", "predicate", "object")
    order = Window.partitionBy("predicate").orderBy(F.md5(F.col("object")), "subject", "object")
    spread = links.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= share)
    return spread.orderBy("predicate", "_n").limit(limit).drop("_n")


# -- aggregation along paths ---------------------------------------------------------------------------------

def _walk(
    df: DataFrame, triples: DataFrame, steps: Sequence[str], start: str, end: str, how: str, tasks: int | None = None
) -> DataFrame:
    """Follow ``P`` forwards or ``^P`` backwards from column ``start``; the end lands in ``end``.

    Links of a large graph are dealt over ``tasks`` tasks, and the rows they are joined to with them.
    """
    at = start
    for i, step in enumerate(steps):
        back = step.startswith("^")
        here, there = ("object", "subject") if back else ("subject", "object")
        to = f"_{end}{i}"
        hop = triples.where(F.col("predicate") == step.lstrip("^")).select(
            F.col(here).alias("_at"), F.col(there).alias(to)
        )
        hop = hop.repartition(tasks, "_at") if tasks else hop
        df = df.join(hop, df[at] == hop["_at"], how).drop("_at")
        if at != start:
            df = df.drop(at)
        at = to
    return df.withColumnRenamed(at, end)


def instances(triples: DataFrame, classes: Iterable[str]) -> DataFrame:
    """Distinct subjects typed with any of the classes."""
    typed = triples.where((F.col("predicate") == RDF_TYPE) & F.col("object").isin(*classes))
    return typed.select("subject").distinct()


def aggregate(
    triples: DataFrame, class_iri: str, *, measure: str | None = None, group_by: str | Sequence[str] = (),
    group_kind: str = "value", filters: Sequence[tuple[Sequence[str], str]] = (), limit: int | None = None,
    label: bool = True, dedupe: bool = False,
) -> DataFrame:
    """Count instances of a class and sum up a numeric attribute, grouped by the end of a path.

    An instance without the group path counts under NULL. A path with several ends repeats the measure
    on every joined row, as a join does; ``dedupe`` counts each (instance, group, value) once instead.
    """
    rows = triples.where(
        (F.col("predicate") == RDF_TYPE) & (F.col("object") == class_iri) & ~is_bnode(F.col("subject"))
    ).select(F.col("subject").alias("_i"))
    for n, (path, value) in enumerate(filters):
        rows = _walk(rows, triples, path, "_i", f"_f{n}", "inner").where(F.col(f"_f{n}") == value).drop(f"_f{n}")
    steps = [group_by] if isinstance(group_by, str) else list(group_by)
    followed = {s.lstrip("^") for s in steps}
    # Sorts and groups of a task hold its rows in memory: their number follows the links, not the session.
    tasks = tasks_for(triples.sparkSession, triples.where(F.col("predicate").isin(*followed)).count()) if steps else None
    if steps:
        rows = _walk(rows, triples, steps, "_i", "_g", "left", tasks)
        width = {"year": 4, "month": 7}.get(group_kind)
        group = F.substring("_g", 1, width) if width else F.col("_g")
    else:
        group = F.lit(None).cast("string")
    if measure:
        values = triples.where(F.col("predicate") == measure).select(
            F.col("subject").alias("_m"), extracted_number(F.col("object")).alias("_v")
        )
        values = values.repartition(tasks, "_m") if tasks else values
        rows = rows.join(values, rows["_i"] == values["_m"], "left").drop("_m")
    else:
        rows = rows.withColumn("_v", F.lit(None).cast("double"))
    rows = rows.select("_i", group.alias("group"), "_v")
    if dedupe:
        rows = rows.distinct()
    # A sum of doubles depends on the order of its rows in the last digits: those are rounded off first.
    settled = lambda x: F.round(F.round(x, 8), 4)
    total = settled(F.sum("_v"))
    out = rows.groupBy("group").agg(
        F.countDistinct("_i").alias("count"),
        total.alias("sum"), settled(F.try_divide(total, F.count("_v"))).alias("avg"),
        F.round(F.min("_v"), 4).alias("min"), F.round(F.max("_v"), 4).alias("max"),
    )
    if limit is not None:
        out = out.orderBy(F.desc("count"), F.col("group").asc_nulls_last()).limit(limit)
    if not label:
        return out
    iri = F.col("group").rlike("^(https?://|urn:)")
    named = with_label(out, triples, "group", "_name", few=limit is not None and limit <= FEW)
    return named.withColumn("label", F.when(iri, F.col("_name")).otherwise(F.col("group"))).drop("_name")


def resolve_values(triples: DataFrame, values: Sequence[str], type_iri: str | None = None) -> DataFrame:
    """(value, iri, how) of plain values naming entities: by label, by local name, else by a single hit.

    Every hit is looked at. Ambiguous and unknown values come back with a NULL IRI and the number of near ones.
    """
    hits = search_many(triples, list(dict.fromkeys(values)), type_iri=type_iri, limit=None)
    named = with_label(hits, triples, "subject")
    exact = F.lower("label") == F.col("query")
    local = F.lower(local_name(F.col("subject"))) == F.col("query")
    picked = named.groupBy("query").agg(
        F.count("*").alias("near"),
        F.min(F.when(exact, F.col("subject"))).alias("_label"),
        F.min(F.when(local, F.col("subject"))).alias("_local"),
        F.min("subject").alias("_only"),
    )
    asked = triples.sparkSession.createDataFrame([(v, v.lower()) for v in values], "value string, query string")
    single = F.when(F.col("near") == 1, F.col("_only"))
    return asked.join(picked, "query", "left").select(
        "value",
        F.coalesce("_label", "_local", single).alias("iri"),
        F.when(F.col("_label").isNotNull(), "label").when(F.col("_local").isNotNull(), "local name")
        .when(single.isNotNull(), "single hit").alias("how"),
        F.coalesce("near", F.lit(0)).alias("near"),
    )


# -- classes ---------------------------------------------------------------------------------------------------

def class_edges(triples: DataFrame) -> DataFrame:
    """(source class, predicate, target class, edges), counted before the object side is joined.

    Counting per (class, predicate, object) first turns a hub with most of the edges into one row.
    """
    types = triples.where(F.col("predicate") == RDF_TYPE).select(
        F.col("subject").alias("_s"), F.col("object").alias("_class")
    ).distinct()
    links = relationships(triples).select("subject", "predicate", "object")
    source = links.join(types, links.subject == types["_s"]).groupBy(
        F.col("_class").alias("source_class"), "predicate", "object"
    ).agg(F.count("*").alias("_n"))
    target = source.join(types, source.object == types["_s"])
    return target.groupBy("source_class", "predicate", F.col("_class").alias("target_class")).agg(
        F.sum("_n").alias("n")
    )


def class_paths(edges: DataFrame, start: str, goal: str, max_depth: int = 8, limit: int = 5) -> DataFrame:
    """Shortest ways between two classes over the class-edge summary, both directions, no class twice.

    The summary has one row per (class, predicate, class): it grows with the vocabulary, not the data.
    """
    if not 1 <= max_depth <= 8:
        raise ValueError("max_depth lies between 1 and 8")
    scratch = Scratch(edges.sparkSession, "class-paths")
    forward = edges.select(F.col("source_class").alias("a"), F.col("predicate").alias("step"),
                           F.col("target_class").alias("b"))
    backward = edges.select(F.col("target_class").alias("a"), F.concat(F.lit("^"), "predicate").alias("step"),
                            F.col("source_class").alias("b"))
    hops = scratch.save(forward.unionByName(backward).distinct(), "hops")
    paths = hops.where(F.col("a") == start).select(
        F.array("step").alias("steps"), F.array("a", "b").alias("classes"), F.col("b").alias("at")
    )
    found, complete = None, 0
    for depth in range(1, max_depth + 1):
        paths, seen = scratch.measured(paths, "paths", arrived=F.count_if(F.col("at") == goal))
        arrived = paths.where(F.col("at") == goal)
        found = arrived if found is None else found.unionByName(arrived)
        complete += seen["arrived"]
        if depth == max_depth or complete >= limit or not seen["n"]:
            break
        going = paths.where(F.col("at") != goal)
        paths = going.join(hops, going["at"] == hops["a"]).where(~F.array_contains("classes", F.col("b"))).select(
            F.concat("steps", F.array("step")).alias("steps"), F.concat("classes", F.array("b")).alias("classes"),
            F.col("b").alias("at"),
        )
    return found.select(F.size("steps").alias("length"), "steps", "classes").orderBy("length", "steps").limit(limit)


def class_view(
    triples: DataFrame, ontology: Ontology, class_iri: str, *, search_text: str | None = None, limit: int | None = None
) -> DataFrame:
    """A typed row per instance of the class or a subclass.

    Columns come from the ontology, never from the data: one per attribute, cast to its XSD type (text
    that does not parse gives NULL), and one per functional relation. Relations with many targets are
    rows of ``class_relations``.
    """
    scope = ontology.with_descendants(class_iri)
    attributes = [p for p in ontology.data_properties if p.domain is None or p in ontology.data_properties_of(class_iri)]
    single = [p for p in ontology.object_properties_of(class_iri) if "functional" in p.characteristics]
    found = instances(triples, scope).where(~is_bnode(F.col("subject")))
    if search_text:
        hits = triples.where(_field_hit(F.lit(search_text.lower()), "contains", "any")).select("subject")
        found = found.join(hits, "subject", "left_semi")
    if limit is not None:
        found = found.orderBy("subject").limit(limit)
    wanted = [p.iri for p in (*attributes, *single)] + [RDF_TYPE]
    rank = label_rank(F.col("predicate"))
    is_name = (F.col("object_type") == LITERAL) & rank.isNotNull()
    facts = triples.where(F.col("predicate").isin(*wanted) | is_name).join(found, "subject", "left_semi")
    columns = []
    for p in attributes:
        text = F.min(F.when((F.col("predicate") == p.iri) & (F.col("object_type") == LITERAL), F.col("object")))
        columns.append(text.try_cast(SCALARS.get(p.range, "string")).alias(ontology.local(p.iri)))
    for p in single:
        target = F.min(F.when((F.col("predicate") == p.iri) & (F.col("object_type") != LITERAL), F.col("object")))
        columns.append(target.alias(ontology.local(p.iri)))
    out = facts.groupBy(F.col("subject").alias("id")).agg(
        F.min_by("object", F.when(is_name, F.struct(rank, "predicate", "object"))).alias("_label"),
        F.array_sort(F.collect_set(F.when(F.col("predicate") == RDF_TYPE, F.col("object")))).alias("types"),
        *columns,
    )
    label = F.coalesce("_label", fallback_label(F.col("id"))).alias("label")
    return out.select("id", label, "types", *[ontology.local(p.iri) for p in (*attributes, *single)])


def class_relations(triples: DataFrame, ontology: Ontology, class_iri: str) -> DataFrame:
    """(id, relation, target, target label) rows of a class's relations with any number of targets."""
    many = [p.iri for p in ontology.object_properties_of(class_iri) if "functional" not in p.characteristics]
    found = instances(triples, ontology.with_descendants(class_iri))
    links = relationships(triples).where(F.col("predicate").isin(*many)).join(found, "subject", "left_semi")
    rows = links.select(F.col("subject").alias("id"), local_name(F.col("predicate")).alias("relation"),
                        F.col("object").alias("target"))
    return with_label(rows, triples, "target", "target_label")


def instance_counts(triples: DataFrame, ontology: Ontology) -> DataFrame:
    """Instances per class, counting every instance for all ancestors of its classes too."""
    pairs = triples.sparkSession.createDataFrame(ontology.subclass_pairs(), "class string, ancestor string")
    typed = triples.where(F.col("predicate") == RDF_TYPE).select("subject", F.col("object").alias("class")).distinct()
    # The hierarchy is configuration: its size does not depend on the data.
    spread = typed.join(F.broadcast(pairs), "class").select("ancestor", "subject").distinct()
    return spread.groupBy(F.col("ancestor").alias("class")).agg(F.count("*").alias("instances"))
