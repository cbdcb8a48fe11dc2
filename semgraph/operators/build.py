"""Building a graph in full, or only the part whose source tables changed."""

from __future__ import annotations

from collections.abc import Mapping as Dict
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from semgraph.operators import drift, triples
from semgraph.plans.mapping import Mapping
from semgraph.sources.store import GraphStore, Load, signatures
from semgraph.sources.tables import Resolver


@dataclass(frozen=True)
class Plan:
    mode: str
    reason: str
    changed: tuple[str, ...]
    unchanged: tuple[str, ...] = ()
    dropped: tuple[str, ...] = ()


@dataclass
class Report:
    plan: Plan
    steps: DataFrame
    issues: DataFrame


def plan(mapping: Mapping, now: Dict[str, str], known: Dict[str, Load], *, full: bool = False) -> Plan:
    """Which producing tables must be read again. ``now`` holds the tables' present signatures, ``known`` their loads.

    A table is read when its own signature moved, that of a table it is joined to moved, or the mapping
    treats it differently.
    """
    needs = mapping.tables_of()
    every = tuple(sorted(needs))
    dropped = tuple(sorted(set(known) - set(every)))
    if full:
        return Plan("full", "requested", every, dropped=dropped)
    if mapping.has_query_sources():
        return Plan("full", "query-based source", every, dropped=dropped)
    if not known:
        return Plan("full", "first build", every)
    hashes = mapping.table_hashes()
    remapped = {t for t in every if t not in known or known[t].mapping_hash != hashes[t]}
    present = {t: _joint(now, needs[t]) for t in every}
    changed = tuple(t for t in every if t in remapped or present[t] is None or known[t].signature != present[t])
    reason = f"mapping changed for {len(remapped)} table(s)" if remapped else "signatures compared"
    return Plan("incremental", reason, changed, tuple(t for t in every if t not in changed), dropped)


def _joint(now: Dict[str, str], tables: set[str]) -> str | None:
    marks = [now.get(t) for t in sorted(tables)]
    return None if None in marks else "|".join(marks)


def build(
    spark: SparkSession, mapping: Mapping, resolve: Resolver, store: GraphStore, *, full: bool = False,
    snapshot: DataFrame | None = None, signature: str | None = None,
) -> Report:
    """Plan, compare schemas, load what changed, and report step by step.

    ``signature`` is how tables are compared, see ``store.signatures``: by their files where known, unless it says
    ``rows``. Nothing is read of tables that did not change, nothing at all is loaded when none did, and counts come
    from the write and from earlier loads. A failing load leaves the earlier graph in place.
    """
    needs = mapping.tables_of()
    every = sorted(set().union(*needs.values())) if needs else []
    marks = {
        r["table"]: f"{r['method']}:{r['items']}:{r['digest']}" for r in signatures(spark, every, resolve, signature).collect()
    } if every else {}
    known = store.tables()
    chosen = plan(mapping, marks, known, full=full)
    live = drift.snapshot(spark, {t: resolve(t) for t in every})
    issues = drift.mapping_drift(mapping, live, snapshot)
    hashes = mapping.table_hashes()
    loaded = 0
    if mapping.has_query_sources():
        loaded = store.replace(triples.build(spark, mapping, resolve))
    elif chosen.changed or chosen.dropped:
        maps = [m for m in mapping.triple_maps() if m.source.table in chosen.changed]
        loaded = store.load(
            triples.build(spark, mapping, resolve, maps=maps, layout="branches"), {t: _joint(marks, needs[t]) for t in chosen.changed},
            {t: hashes[t] for t in chosen.changed}, chosen.dropped, lying=True,
        )
    kept = sum(known[t].rows for t in chosen.unchanged)
    steps = spark.createDataFrame(
        [
            (1, "plan", chosen.mode, chosen.reason, len(chosen.changed)),
            (2, "drift", "checked", "columns the mapping reads", issues.count()),
            (3, "load", "done" if loaded or chosen.changed else "skipped", ", ".join(chosen.changed), loaded),
            (4, "finalize", "done", f"{len(chosen.unchanged)} table(s) left as they lie", loaded + kept),
        ],
        "position int, step string, state string, detail string, rows bigint",
    )
    return Report(chosen, steps, issues)
