"""Data-quality rules over tables: pass rates, failing rows, flags, history and suggestions."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semgraph.functions.skew import split_join
from semgraph.functions.terms import quoted

# Rule kinds with their quality dimension, and the parameters each cannot do without.
KINDS = {
    "not_null": "completeness", "not_empty": "completeness", "unique": "uniqueness",
    "in_set": "validity", "not_in_set": "validity", "range": "validity", "not_in_range": "validity",
    "equal_to": "validity", "not_equal_to": "validity", "not_less_than": "validity",
    "not_greater_than": "validity", "regex": "validity", "valid_email": "validity", "valid_uuid": "validity",
    "valid_ipv4": "validity", "valid_date": "validity", "valid_timestamp": "validity",
    "string_case": "validity", "length_between": "validity", "not_in_future": "timeliness",
    "older_than_days": "timeliness", "older_than_column": "consistency", "referential": "consistency",
    "freshness": "timeliness", "row_count": "volume", "aggregate": "volume", "custom": "validity",
}
DIMENSIONS = ("completeness", "uniqueness", "validity", "consistency", "timeliness", "volume")
REQUIRED = {
    "in_set": ("values",), "not_in_set": ("values",), "not_in_range": ("min", "max"), "equal_to": ("value",),
    "not_equal_to": ("value",), "not_less_than": ("limit",), "not_greater_than": ("limit",),
    "regex": ("pattern",), "string_case": ("case",), "older_than_days": ("days",),
    "older_than_column": ("column2",), "referential": ("ref_table", "ref_column"),
    "aggregate": ("aggr", "op", "limit"), "custom": ("predicate",),
}
WITHOUT_COLUMN = ("unique", "row_count", "aggregate", "custom")
TABLE_LEVEL = ("freshness", "row_count", "aggregate")
AGGREGATES = ("count", "count_distinct", "sum", "avg", "min", "max")
COMPARISONS = ("<=", ">=", "=", "!=", "<", ">")
# The formats the valid_* kinds accept.
PATTERNS = {
    "valid_email": r"^[^@\s]+@[^@\s]+\.[^@\s]+$",
    "valid_uuid": r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "valid_ipv4": r"^((25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$",
    "valid_date": r"^\d{4}-\d{2}-\d{2}",
    "valid_timestamp": r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}",
}
GUID_PATTERN = "^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$"
WARN_BAND = 0.15
HISTORY = 14

RESULT_SCHEMA = (
    "rule string, column string, kind string, dimension string, threshold double, pass_rate double, "
    "passed bigint, failed bigint, total bigint, status string, error string"
)

References = Callable[[str], DataFrame]


class RuleError(ValueError):
    pass


@dataclass(frozen=True)
class DqRule:
    name: str
    kind: str
    column: str | None = None
    params: Mapping = field(default_factory=dict)
    threshold: float = 0.95
    dimension: str | None = None
    enabled: bool = True

    @property
    def quality(self) -> str:
        return self.dimension or KINDS[self.kind]

    @property
    def key_columns(self) -> list[str]:
        return list(self.params.get("columns") or ([self.column] if self.column else []))


def validate(rule: DqRule, columns: Iterable[str]) -> DqRule:
    """The rule with its column spelled as in the table, or RuleError."""
    spelled = {c.lower(): c for c in columns}
    if not rule.name.strip():
        raise RuleError("a rule needs a name")
    if rule.kind not in KINDS:
        raise RuleError(f"unknown kind {rule.kind!r}")
    if rule.kind not in WITHOUT_COLUMN and not rule.column:
        raise RuleError(f"{rule.kind} needs a column")
    empty = [p for p in REQUIRED.get(rule.kind, ()) if rule.params.get(p) in (None, "", [])]
    if empty:
        raise RuleError(f"{rule.kind} needs {' and '.join(empty)}")
    if rule.kind == "range" and rule.params.get("min") is None and rule.params.get("max") is None:
        raise RuleError("range needs min or max")
    if rule.kind == "unique" and not rule.key_columns:
        raise RuleError("unique needs a column or params.columns")
    mentioned = [rule.column, rule.params.get("column"), *(rule.params.get("columns") or [])]
    if rule.kind == "older_than_column":
        mentioned.append(rule.params["column2"])
    for c in mentioned:
        if c and str(c).lower() not in spelled:
            raise RuleError(f"unknown column {c!r}")
    for text in ("filter", "predicate"):
        if ";" in str(rule.params.get(text) or ""):
            raise RuleError(f"{text} is one boolean expression without ';'")
    if rule.kind == "aggregate":
        if rule.params["aggr"] not in AGGREGATES or rule.params["op"] not in COMPARISONS:
            raise RuleError("unknown aggregate or comparison")
        if rule.params["aggr"] != "count" and not rule.params.get("column"):
            raise RuleError(f"{rule.params['aggr']} needs a column")
    if rule.quality not in DIMENSIONS:
        raise RuleError(f"unknown dimension {rule.quality!r}")
    if not 0 < float(rule.threshold) <= 1:
        raise RuleError("the threshold lies in (0, 1]")
    return replace(rule, column=spelled[rule.column.lower()]) if rule.column else rule


# -- predicates -------------------------------------------------------------------------------------------

def _now(as_of: dt.datetime | None) -> Column:
    """The moment rules are judged at; a pinned one is a wall-clock time, whatever the session's zone."""
    return F.lit(as_of.isoformat(sep=" ")).cast("timestamp_ntz") if as_of is not None else F.current_timestamp()


def _hours_before(moment: Column, hours: int) -> Column:
    return moment - F.make_dt_interval(hours=F.lit(int(hours)))


def row_predicate(rule: DqRule, as_of: dt.datetime | None = None) -> Column:
    """What a row must satisfy. Kinds about present values let NULL pass. Not for referential rules."""
    p, kind = rule.params, rule.kind
    if kind == "custom":
        return F.expr(str(p.get("predicate") or "true"))
    c = F.col(quoted(rule.column))
    text = c.cast("string")
    if kind == "not_null":
        return c.isNotNull()
    if kind == "not_empty":
        return c.isNotNull() & (F.trim(text) != "")
    low, high = p.get("min"), p.get("max")
    size = F.length(text)
    allowed = [str(v) for v in p.get("values", [])]

    def within(value: Column) -> Column:
        bounds = ([value >= F.lit(low)] if low is not None else []) + ([value <= F.lit(high)] if high is not None else [])
        return reduce(lambda a, b: a & b, bounds, F.lit(True)) if bounds else F.lit(True)

    def case(value: Column) -> Column:
        return F.lower(value) if str(p.get("case", "upper")).lower() == "lower" else F.upper(value)

    def before_other() -> Column:
        other = F.col(quoted(p["column2"]))
        return other.isNull() | (c <= _hours_before(other, 24 * int(p.get("days") or 0)))

    checks: dict[str, Callable[[], Column]] = {
        "in_set": lambda: text.isin(*allowed),
        "not_in_set": lambda: ~text.isin(*allowed),
        "range": lambda: within(c),
        "not_in_range": lambda: (c < F.lit(low)) | (c > F.lit(high)),
        "equal_to": lambda: c == F.lit(p["value"]),
        "not_equal_to": lambda: c != F.lit(p["value"]),
        "not_less_than": lambda: c >= F.lit(p["limit"]),
        "not_greater_than": lambda: c <= F.lit(p["limit"]),
        "regex": lambda: text.rlike(str(p.get("pattern", ""))),
        "string_case": lambda: text == case(text),
        "length_between": lambda: within(size),
        "not_in_future": lambda: c <= _now(as_of),
        "older_than_days": lambda: c <= _hours_before(_now(as_of), 24 * int(p.get("days") or 0)),
        "older_than_column": before_other,
    }
    if kind in PATTERNS:
        return c.isNull() | text.rlike(PATTERNS[kind])
    if kind not in checks:
        raise RuleError(f"{kind} does not judge single rows")
    return c.isNull() | checks[kind]()


def _scoped(rule: DqRule, predicate: Column) -> Column:
    """Rows outside the rule's filter count as passing."""
    condition = rule.params.get("filter")
    return ~F.expr(str(condition)) | predicate if condition else predicate


def _ref_keys(rule: DqRule, refs: References, name: str) -> DataFrame:
    ref = refs(rule.params["ref_table"])
    value = F.col(quoted(rule.params["ref_column"]))
    return ref.select(value.alias(name)).where(F.col(name).isNotNull()).distinct()


# -- measuring ------------------------------------------------------------------------------------------------

def _aggregate_target(rule: DqRule, as_of: dt.datetime | None) -> Column:
    """0/1 verdict of a table-level rule that fits into one aggregate."""
    p = rule.params
    if rule.kind == "freshness":
        newest = F.max(F.col(quoted(rule.column)))
        met = newest >= _hours_before(_now(as_of), int(p.get("hours", 24)))
    elif rule.kind == "row_count":
        met = F.lit(True)
        if p.get("min") is not None:
            met = met & (F.count("*") >= int(p["min"]))
        if p.get("max") is not None:
            met = met & (F.count("*") <= int(p["max"]))
    else:
        column = F.col(quoted(p["column"])) if p.get("column") else None
        value = F.count("*") if column is None else getattr(F, p["aggr"])(column)
        met = _compared(value, p["op"], p["limit"])
    return F.when(met, 1.0).otherwise(0.0)


def _compared(value: Column, op: str, limit) -> Column:
    bound = F.lit(limit)
    return {
        "<=": value <= bound, ">=": value >= bound, "=": value == bound,
        "!=": value != bound, "<": value < bound, ">": value > bound,
    }[op]


def _one_pass(df: DataFrame, rules: Sequence[DqRule], as_of) -> DataFrame:
    """(rule, pass_rate, failed, total) of every rule that is a plain aggregate, from one scan."""
    measures, rows = [F.count("*").alias("_n")], []
    for i, r in enumerate(rules):
        if r.kind in TABLE_LEVEL:
            measures.append(_aggregate_target(r, as_of).alias(f"_{i}"))
            rate, failed = F.col(f"_{i}"), F.lit(None).cast("bigint")
        else:
            measures.append(F.count_if(_scoped(r, row_predicate(r, as_of))).alias(f"_{i}"))
            rate, failed = F.try_divide(F.col(f"_{i}"), F.col("_n")), F.col("_n") - F.col(f"_{i}")
        rows.append(
            F.struct(
                F.lit(r.name).alias("rule"), rate.cast("double").alias("pass_rate"), failed.alias("failed"),
                F.col("_n").alias("total"),
            )
        )
    return df.agg(*measures).select(F.inline(F.array(*rows)))


def _distinct_pass(df: DataFrame, rule: DqRule) -> DataFrame:
    """Uniqueness from counts per key, which combine before the shuffle; NULLs are values of a tuple."""
    columns = rule.key_columns
    keys = [F.col(quoted(c)).alias(f"_k{i}") for i, c in enumerate(columns)]
    groups = df.select(*keys).groupBy(*[f"_k{i}" for i in range(len(keys))]).agg(F.count("*").alias("_n"))
    present = F.col("_k0").isNotNull() if len(keys) == 1 else F.lit(True)
    counted = groups.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("_total"),
        F.coalesce(F.sum(F.when(present, F.col("_n"))), F.lit(0)).alias("_present"),
        F.count_if(present).alias("_distinct"),
    )
    return counted.select(
        F.lit(rule.name).alias("rule"), F.try_divide("_distinct", "_present").alias("pass_rate"),
        (F.col("_present") - F.col("_distinct")).alias("failed"), F.col("_total").alias("total"),
    )


def _distinct_limit_pass(df: DataFrame, rule: DqRule) -> DataFrame:
    column = F.col(quoted(rule.params["column"])).alias("_v")
    groups = df.select(column).groupBy("_v").agg(F.count("*").alias("_n"))
    counted = groups.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("total"), F.count("_v").alias("_distinct")
    )
    met = F.when(_compared(F.col("_distinct"), rule.params["op"], rule.params["limit"]), 1.0).otherwise(0.0)
    return counted.select(
        F.lit(rule.name).alias("rule"), met.alias("pass_rate"), F.lit(None).cast("bigint").alias("failed"), "total"
    )


def _reference_pass(df: DataFrame, rule: DqRule, refs: References) -> DataFrame:
    """Referential integrity on counts per value: a hot key is one row by the time it is joined."""
    condition = rule.params.get("filter")
    inside = F.coalesce(F.expr(str(condition)), F.lit(True)) if condition else F.lit(True)
    values = df.select(F.col(quoted(rule.column)).alias("_v"), inside.alias("_in"))
    groups = values.groupBy("_v").agg(F.count("*").alias("_n"), F.count_if("_in").alias("_checked"))
    known = _ref_keys(rule, refs, "_v").withColumn("_known", F.lit(True))
    joined = groups.join(known, "_v", "left")
    missing = F.col("_v").isNotNull() & F.col("_known").isNull()
    counted = joined.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("total"),
        F.coalesce(F.sum(F.when(missing, F.col("_checked"))), F.lit(0)).alias("failed"),
    )
    return counted.select(
        F.lit(rule.name).alias("rule"),
        F.try_divide(F.col("total") - F.col("failed"), F.col("total")).alias("pass_rate"), "failed", "total",
    )


def status_of(rate: Column, threshold: Column) -> Column:
    return (
        F.when(rate.isNull(), "error").when(rate >= threshold, "passing")
        .when(rate >= threshold - WARN_BAND, "warning").otherwise("failing")
    )


def _measured(df: DataFrame, rules: Sequence[DqRule], refs: References | None, as_of) -> list[DataFrame]:
    plain, parts = [], []
    for r in rules:
        if r.kind == "unique":
            parts.append(_distinct_pass(df, r))
        elif r.kind == "referential":
            parts.append(_reference_pass(df, r, refs))
        elif r.kind == "aggregate" and r.params["aggr"] == "count_distinct":
            parts.append(_distinct_limit_pass(df, r))
        else:
            plain.append(r)
    if plain:
        parts.append(_one_pass(df, plain, as_of))
    return parts


def _finished(spark: SparkSession, rules: Sequence[DqRule], measured: DataFrame, errors: dict[str, str]) -> DataFrame:
    catalog = spark.createDataFrame(
        [(r.name, r.column, r.kind, r.quality, float(r.threshold), errors.get(r.name)) for r in rules],
        "rule string, column string, kind string, dimension string, threshold double, error string",
    )
    rate = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("pass_rate")))
    # One row per configured rule on both sides.
    return catalog.join(F.broadcast(measured), "rule", "left").select(
        "rule", "column", "kind", "dimension", "threshold",
        F.when(F.col("pass_rate").isNotNull(), rate).alias("pass_rate"),
        (F.col("total") - F.col("failed")).alias("passed"), "failed", "total",
        F.when(F.col("error").isNotNull(), "error").otherwise(status_of(F.col("pass_rate"), F.col("threshold"))).alias(
            "status"
        ),
        "error",
    )


def evaluate(
    df: DataFrame, rules: Sequence[DqRule], refs: References | None = None, as_of: dt.datetime | None = None
) -> DataFrame:
    """One result row per enabled rule. A rule that is not valid, or the analyser rejects, comes back as ``error``."""
    active = _active(rules)
    valid, errors = [], {}
    for r in active:
        try:
            r = validate(r, df.columns)
            for part in _measured(df, [r], refs, as_of):
                part.schema  # noqa: B018 - analyses the plan without running it
            valid.append(r)
        except Exception as problem:  # noqa: BLE001
            errors[r.name] = _reason(problem)
    parts = _measured(df, valid, refs, as_of)
    empty = df.sparkSession.createDataFrame([], "rule string, pass_rate double, failed bigint, total bigint")
    measured = reduce(DataFrame.unionByName, parts) if parts else empty
    return _finished(df.sparkSession, active, measured, errors)


def run(
    df: DataFrame, rules: Sequence[DqRule], refs: References | None = None, as_of: dt.datetime | None = None
) -> DataFrame:
    """``evaluate`` carried out now: a rule that fails while running cannot hide the others.

    One attempt measures all rules together; only if it fails is each measured alone.
    """
    spark = df.sparkSession
    results = evaluate(df, rules, refs, as_of)
    try:
        rows = results.collect()
    except Exception:  # noqa: BLE001
        rows = []
        for r in _active(rules):
            try:
                rows += evaluate(df, [r], refs, as_of).collect()
            except Exception as problem:  # noqa: BLE001
                rows.append(
                    (r.name, r.column, r.kind, r.quality, float(r.threshold), None, None, None, None, "error",
                     _reason(problem))
                )
    return spark.createDataFrame(rows, RESULT_SCHEMA)


def _active(rules: Sequence[DqRule]) -> list[DqRule]:
    active = [r for r in rules if r.enabled]
    if not active:
        raise RuleError("no rules to run")
    return active


def _reason(problem: Exception) -> str:
    return f"{type(problem).__name__}: {str(problem).splitlines()[0] if str(problem) else ''}"


def score(results: DataFrame) -> DataFrame:
    """Mean pass rate of the measured rules."""
    return results.agg(F.round(F.avg("pass_rate"), 4).alias("score"))


# -- rows ---------------------------------------------------------------------------------------------------------

def failing_rows(
    df: DataFrame, rule: DqRule, refs: References | None = None, as_of: dt.datetime | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Rows that break a rule, all of them or the first ``limit`` by all columns.

    A row whose check or filter is NULL breaks the rule, here as in the counts.
    """
    if rule.kind in TABLE_LEVEL:
        raise RuleError(f"{rule.kind} is about the whole table and has no failing rows")
    condition = rule.params.get("filter")
    if rule.kind == "unique":
        keys = rule.key_columns
        present = reduce(lambda a, b: a & b, [F.col(quoted(c)).isNotNull() for c in keys])
        repeated = df.where(present).groupBy(*[F.col(quoted(c)) for c in keys]).agg(F.count("*").alias("_times"))
        bad = split_join(df, repeated.where(F.col("_times") > 1).drop("_times"), keys, "left_semi").select(*df.columns)
    elif rule.kind == "referential":
        value = F.col(quoted(rule.column))
        keyed = df.where(value.isNotNull()).withColumn("_ref", value)
        bad = split_join(keyed, _ref_keys(rule, refs, "_ref"), ["_ref"], "left_anti").select(*df.columns)
    else:
        bad = df.where(~F.coalesce(_scoped(rule, row_predicate(rule, as_of)), F.lit(False)))
    if condition and rule.kind == "referential":
        bad = bad.where(F.coalesce(F.expr(str(condition)), F.lit(True)))
    if limit is None:
        return bad
    sortable = [F.col(quoted(f.name)) for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]
    return bad.orderBy(*sortable).limit(limit)


def flag_rows(
    df: DataFrame, rules: Sequence[DqRule], refs: References | None = None, as_of: dt.datetime | None = None
) -> DataFrame:
    """The table with ``failed_rules``: names of the row rules each row breaks, in rule order."""
    out, broken, extra = df, [], []
    for i, r in enumerate(_active(rules)):
        if r.kind in TABLE_LEVEL:
            continue
        if r.kind == "unique":
            keys = r.key_columns
            present = reduce(lambda a, b: a & b, [F.col(quoted(c)).isNotNull() for c in keys])
            groups = df.where(present).groupBy(*[F.col(quoted(c)).alias(f"_u{i}_{n}") for n, c in enumerate(keys)]).agg(
                F.count("*").alias("_times")
            )
            repeated = groups.where(F.col("_times") > 1).withColumn(f"_bad{i}", F.lit(True)).drop("_times")
            named = {f"_u{i}_{n}": F.col(quoted(c)) for n, c in enumerate(keys)}
            out = split_join(out.withColumns(named), repeated, list(named), "left")
            extra += [*named, f"_bad{i}"]
            bad = F.col(f"_bad{i}").isNotNull()
        elif r.kind == "referential":
            known = _ref_keys(r, refs, f"_ref{i}").withColumn(f"_known{i}", F.lit(True))
            value = F.col(quoted(r.column))
            out = split_join(out.withColumn(f"_ref{i}", value), known, [f"_ref{i}"], "left")
            extra += [f"_ref{i}", f"_known{i}"]
            bad = value.isNotNull() & F.col(f"_known{i}").isNull()
            if r.params.get("filter"):
                bad = bad & F.coalesce(F.expr(str(r.params["filter"])), F.lit(True))
        else:
            bad = ~F.coalesce(_scoped(r, row_predicate(r, as_of)), F.lit(False))
        broken.append(F.when(bad, F.lit(r.name)))
    flagged = out.withColumn("failed_rules", F.array_compact(F.array(*broken)))
    return flagged.drop(*extra)


def split_rows(flagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, rows to quarantine)."""
    good = flagged.where(F.size("failed_rules") == 0).drop("failed_rules")
    return good, flagged.where(F.size("failed_rules") > 0)


# -- history ----------------------------------------------------------------------------------------------------

def stamp(results: DataFrame, table: str, run_id: str, ran_at: dt.datetime) -> DataFrame:
    """Results tagged with their run, ready to append to a history table."""
    return results.select(
        F.lit(table).alias("table"), F.lit(run_id).alias("run_id"), F.lit(ran_at).alias("ran_at"), "*"
    )


def runs(history: DataFrame) -> DataFrame:
    """One row per run with its score."""
    return history.groupBy("table", "run_id").agg(
        F.max("ran_at").alias("ran_at"), F.round(F.avg("pass_rate"), 4).alias("score")
    )


def _newest(df: DataFrame, by: Sequence[str], keep: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("ran_at"), F.desc("run_id"))
    return df.withColumn("position", F.row_number().over(order)).where(F.col("position") <= keep)


def latest(history: DataFrame) -> DataFrame:
    return _newest(history, ("table", "rule"), 1).drop("position")


def rule_history(history: DataFrame, keep: int = HISTORY) -> DataFrame:
    return _newest(history, ("table", "rule"), keep).select("table", "rule", "ran_at", "run_id", "pass_rate", "position")


def run_history(history: DataFrame, keep: int = HISTORY) -> DataFrame:
    return _newest(runs(history), ("table",), keep)


def column_scores(newest: DataFrame, column_facts: DataFrame) -> DataFrame:
    """Per column the mean of its rules' newest rates, else the profile's completeness."""
    ruled = newest.where(F.col("column").isNotNull() & F.col("pass_rate").isNotNull()).groupBy(
        F.lower("column").alias("_c")
    ).agg(F.round(F.avg("pass_rate"), 4).alias("_rules"))
    joined = column_facts.select("column", "null_rate").join(ruled, F.lower("column") == F.col("_c"), "left")
    complete = F.round(1 - F.col("null_rate"), 4)
    source = F.when(F.col("_rules").isNotNull(), "rules").when(complete.isNotNull(), "profile")
    return joined.select("column", F.coalesce("_rules", complete).alias("score"), source.alias("source"))


def summary(newest: DataFrame) -> DataFrame:
    return newest.groupBy("table").agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in ("passing", "warning", "failing", "error")]
    )


def rule_frame(spark: SparkSession, rules: Mapping[str, Sequence[DqRule]]) -> DataFrame:
    rows = [
        (t, r.name, r.column, r.kind, r.quality, float(r.threshold), r.enabled, json.dumps(dict(r.params), default=str))
        for t, rs in rules.items() for r in rs
    ]
    return spark.createDataFrame(
        rows, "table string, rule string, column string, kind string, dimension string, threshold double, "
              "enabled boolean, params string"
    )


def overview(rules: DataFrame, history: DataFrame) -> DataFrame:
    """Per table: rules, enabled ones, counts by kind, dimension and status, and the newest score."""
    def counted(by: str) -> DataFrame:
        entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct(by, "n"))))
        return rules.groupBy("table", by).agg(F.count("*").alias("n")).groupBy("table").agg(entries.alias(f"by_{by}"))

    totals = rules.groupBy("table").agg(F.count("*").alias("rules"), F.count_if("enabled").alias("enabled"))
    last = _newest(runs(history), ("table",), 1).select("table", "score", F.col("ran_at").alias("last_run_at"))
    live = latest(history).join(rules.where("enabled").select("table", "rule"), ["table", "rule"], "left_semi")
    out = totals
    for part in (counted("kind"), counted("dimension"), summary(live), last):
        out = out.join(part, "table", "left")
    return out


# -- suggestions ----------------------------------------------------------------------------------------------

#: What a profile justifies as (kind, condition, parameters, threshold, name), conditions, parameters and names in
#: SQL over a column's facts and the helpers ``low``, ``high``, ``pad`` and ``age``. The numbers are fixed values.
PROPOSALS = (
    ("not_null", "role = 'row key'", "'{}'", 1.0, "'key is filled'"),
    ("unique", "role = 'row key'", "'{}'", 1.0, "'key is unique'"),
    ("not_null", "role <> 'row key' AND nulls = 0 AND non_null > 0", "'{}'", 0.99, "'is filled'"),
    ("range", "role <> 'row key' AND kind = 'numeric' AND high >= low",
     "to_json(named_struct('min', round(if(low >= 0, greatest(0.0D, low - pad), low - pad), 4), 'max', round(high + pad, 4)))",
     0.99, "'stays near its range'"),
    ("in_set", "role <> 'row key' AND kind = 'categorical' AND size(values) > 0 AND distinct <= 12 AND try_divide(distinct, non_null) < 0.5",
     "to_json(named_struct('values', transform(values, v -> v.value)))", 0.99, "'keeps to its values'"),
    ("regex", "role <> 'row key' AND kind = 'categorical' AND guid AND unique_pct > 0.9", "guid_params", 0.99, "'is an identifier'"),
    ("freshness", "role <> 'row key' AND kind = 'date' AND lower(column) rlike 'modif|updat|load|ingest' AND age <= 30",
     "'{\"hours\":48}'", 0.99, "'is loaded daily'"),
)


def suggest(
    column_facts: DataFrame, row_count: int, existing: Sequence[tuple[str, str | None]] = (),
    as_of: dt.datetime | None = None,
) -> DataFrame:
    """Rules a profile justifies: (name, kind, column, params as JSON, threshold)."""
    spark = column_facts.sparkSession
    tenth = F.expr("CASE WHEN high <> low THEN (high - low) / 10 WHEN high <> 0 THEN abs(high) / 10 ELSE 1 END")
    facts = (
        column_facts.withColumn("low", F.expr("try_cast(min AS double)")).withColumn("high", F.expr("try_cast(max AS double)"))
        .withColumn("pad", tenth).withColumn("guid", F.coalesce(F.col("top").rlike(GUID_PATTERN), F.lit(False)))
        .withColumn("guid_params", F.lit(json.dumps({"pattern": GUID_PATTERN})))
        .withColumn("age", F.datediff(_now(as_of).cast("date"), F.substring("max", 1, 10).try_cast("date")))
    )
    proposed = [
        F.when(
            F.expr(condition),
            F.struct(
                F.concat_ws(" ", "column", F.expr(name)).alias("name"), F.lit(kind).alias("kind"), F.col("column"),
                F.expr(params).alias("params"), F.lit(threshold).alias("threshold"),
            ),
        )
        for kind, condition, params, threshold, name in PROPOSALS
    ]
    found = facts.select(F.inline(F.array_compact(F.array(*proposed))))
    if row_count:
        about = json.dumps({"min": row_count * 4 // 5, "max": row_count * 6 // 5 + 1})
        found = found.unionByName(spark.createDataFrame([("table keeps its size", "row_count", None, about, 1.0)], found.schema))
    if not existing:
        return found
    have = spark.createDataFrame([(k, (c or "").lower()) for k, c in existing], "_kind string, _column string")
    taken = (F.col("kind") == F.col("_kind")) & (F.lower(F.coalesce("column", F.lit(""))) == F.col("_column"))
    return found.join(have, taken, "left_anti")


def parsed_rules(suggested: DataFrame) -> list[DqRule]:
    """Suggested rules as configuration: a handful per column of the table."""
    return [
        DqRule(r["name"], r["kind"], r["column"], json.loads(r["params"]), r["threshold"]) for r in suggested.collect()
    ]
