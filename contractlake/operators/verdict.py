"""Verdicts, roll-ups and the merge gate over change tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import non_empty, plural, rule_array, severity_rank, verdict_name, verdict_rank
from ..session import cut_lineage
from . import diff

KEYS = diff.KEYS

# Change type prefix -> area shown to readers, first match wins.
CHANGE_AREAS = (
    ("ENDPOINT", "Endpoint"), ("REQUEST", "Request body"), ("RESPONSE", "Response"), ("PARAM", "Parameters"),
    ("VALIDATION", "Validation"), ("SECURITY", "Security"), ("ERROR_STATUS", "Status codes"),
    ("SUCCESS_STATUS", "Status codes"),
)
# Verdict wording.
VERDICT_TITLES = {
    "hold": "Hold before merging",
    "review": "Review before merging",
    "clear": "Clear to merge",
}
# What a verdict means on the impact page, in a sentence.
IMPACT_EXPLANATIONS = {
    "hold": "Breaking changes: existing clients fail until they are updated.",
    "review": "Changes clients may notice, such as new error codes or new downstream systems.",
    "clear": "No change existing clients could notice.",
}
NOTHING_CHANGED = "Nothing in the API contract or its dependencies changed."
NO_CALLERS = " No callers were found in the scanned code; external clients may still exist."
# Verdict of analyses that only know an impact level.
LEVEL_VERDICTS = {"high": "hold", "medium": "hold", "low": "review", "none": "clear"}


def verdict_of(breaking: Column, minor: Column, delta: Column) -> Column:
    return F.when(breaking > 0, "hold").when((minor > 0) | (delta > 0), "review").otherwise("clear")


def _marks(changes: DataFrame, delta: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    count = lambda name: F.when(F.col("severity") == name, 1).otherwise(0).alias(name)
    out = changes.select(*keys, count("breaking"), count("minor"), count("additive"), count("delta"))
    if delta is not None:
        zero = [F.lit(0).alias(c) for c in ("breaking", "minor", "additive")]
        out = out.unionByName(delta.select(*keys, *zero, F.lit(1).alias("delta")))
    return out


def endpoint_verdict(changes: DataFrame, delta: DataFrame | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per endpoint: change counts by severity, delta count and verdict. One map-combined shuffle."""
    sums = [F.sum(c).alias(c) for c in ("breaking", "minor", "additive", "delta")]
    out = _marks(changes, delta, keys).groupBy(*keys).agg(*sums)
    return out.withColumn("verdict", verdict_of(F.col("breaking"), F.col("minor"), F.col("delta")))


def _endpoint_states(base: dict[str, DataFrame], head: dict[str, DataFrame], keys: Sequence[str],
                     complete: bool, pos: str | None) -> DataFrame:
    """Every endpoint of either snapshot with status, counts and verdict.

    Changes of all families are found in one aggregate and counted per endpoint (integers, combined map-side); the counts
    then meet the paired endpoints, which are already clustered the same way. No family is joined
    with the endpoints that exist on both sides.
    """
    pairs = diff.pair_routes(base["routes"], head["routes"], keys)
    return _states(pairs, diff.unscoped_changes(base, head, pairs, keys, pos, ("severity",)), keys, complete)


def _states(pairs: DataFrame, changes: DataFrame, keys: Sequence[str], complete: bool) -> DataFrame:
    """Paired endpoints with the counts of their changes, which may include endpoints of one side."""
    sums = ("breaking", "minor", "additive", "delta")
    counts = _marks(changes, None, keys).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])
    status = F.when(~F.col("in_base"), "added").when(~F.col("in_head"), "removed").otherwise("changed")
    known = pairs.select(*keys, status.alias("status"), F.coalesce("head.method", "base.method").alias("method"),
                         F.coalesce("head.path", "base.path").alias("path")).join(counts, list(keys), "left")
    both = F.col("status") == "changed"
    # an added or removed endpoint is one change; the items it brought or took along do not count
    fixed = {"breaking": F.col("status") == "removed", "minor": F.lit(False), "additive": F.col("status") == "added", "delta": F.lit(False)}
    known = known.withColumns({c: F.when(both, F.coalesce(c, F.lit(0))).otherwise(fixed[c].cast("long")) for c in sums})
    touched = F.when(both, F.col("breaking") + F.col("minor") + F.col("additive") + F.col("delta") > 0)
    touched = touched.when(F.col("status") == "removed", F.lit(complete)).otherwise(F.lit(True))
    return known.withColumns({"verdict": verdict_of(F.col("breaking"), F.col("minor"), F.col("delta")), "touched": touched})


def compare_snapshots(base: dict[str, DataFrame], head: dict[str, DataFrame], keys: Sequence[str] = KEYS,
                      complete: bool = True, pos: str | None = None, ordered: bool = True) -> DataFrame:
    """One row per added, removed or changed endpoint, worst verdict first.

    The single changes stay in the long tables of `compare_changes`: a row holding all of
    them would be unbounded for a hot endpoint.
    """
    out = _touched(_endpoint_states(base, head, keys, complete, pos), keys)
    return out.orderBy(verdict_rank("verdict").desc(), *keys) if ordered else out


def _touched(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    return states.where("touched").select(*keys, "status", "method", "path", "verdict", "breaking", "minor", "additive", "delta")


def compare_changes(base: dict[str, DataFrame], head: dict[str, DataFrame], keys: Sequence[str] = KEYS,
                    complete: bool = True, pos: str | None = None) -> DataFrame:
    """Every single change of the comparison, additions and removals included."""
    pairs = diff.pair_routes(base["routes"], head["routes"], keys)
    return (diff.contract_changes(base, head, keys, pos, pairs)
            .unionByName(diff.endpoint_presence(pairs, keys, complete)))


def compare_summary(base: dict[str, DataFrame], head: dict[str, DataFrame], keys: Sequence[str] = KEYS,
                    complete: bool = True, pos: str | None = None) -> DataFrame:
    """One row: overall verdict, endpoints compared and changed, change counts, completeness."""
    states = _endpoint_states(base, head, keys, complete, pos)
    touched = F.col("touched")
    total = lambda c: F.coalesce(F.sum(F.when(touched, F.col(c))), F.lit(0)).alias(c)
    return states.agg(
        verdict_name(F.coalesce(F.max(F.when(touched, verdict_rank("verdict"))), F.lit(0))).alias("verdict"),
        F.count_if(F.col("status") == "changed").alias("endpoints_compared"),
        F.count_if(touched).alias("endpoints_changed"),
        total("breaking"), total("minor"), total("additive"),
    ).withColumn("complete", F.lit(complete))


def gate(verdicts: DataFrame, threshold: str = "hold") -> DataFrame:
    """Adds `failed`: verdict at or above the threshold. `never` lets everything pass."""
    failed = F.lit(False) if threshold == "never" else verdict_rank("verdict") >= verdict_rank(F.lit(threshold))
    return verdicts.withColumn("failed", failed)


def impact_level(breaking: Column, changes: Column, consumers: Column, shared: Column, delta: Column) -> Column:
    return (F.when((breaking > 0) & ((consumers > 0) | (shared > 0)), "high").when(breaking > 0, "medium")
            .when((changes > 0) | (delta > 0), "low").otherwise("none"))


def change_area(change_type: Column) -> Column:
    out = F.lit("Contract")
    for prefix, label in reversed(CHANGE_AREAS):
        out = F.when(change_type.startswith(prefix), label).otherwise(out)
    return out


# ---------------------------------------------------------------- rendering

# How the rendered comparison marks verdicts.
VERDICT_ICONS = {"clear": "✅", "review": "🟡", "hold": "🔴"}
VERDICT_LABELS = {"clear": "Clear", "review": "Review", "hold": "Hold"}
VERDICT_EXPLANATIONS = {
    "clear": "No change existing clients could notice.",
    "review": "Changes clients may notice; worth a look before merging.",
    "hold": "Breaking changes: existing clients fail until they are updated.",
}


def _lookup(values: dict[str, str], key: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, text in values.items():
        out = F.when(key == name, text).otherwise(out)
    return out


def comparison_lines(base: dict[str, DataFrame], head: dict[str, DataFrame], keys: Sequence[str] = KEYS,
                     complete: bool = True, fmt: str = "text", pos: str | None = None) -> DataFrame:
    """The comparison as lines: one header per endpoint, then its changes and dependency deltas.

    Every line is a row with its sort position (keys, section, severity_rank, item), so nothing
    is collected per endpoint however many changes it has. The changes are worked out and written once; headers, changes and deltas are
    read from there.
    """
    markdown = fmt == "markdown"
    pairs = diff.pair_routes(base["routes"], head["routes"], keys)
    found = cut_lineage(diff.contract_changes(base, head, keys, pos, pairs, downstream=True))
    states = _touched(_states(pairs, found, keys, complete), keys)
    changes = found.where("severity <> 'delta'").unionByName(diff.endpoint_presence(pairs, keys, complete))
    icon = _lookup(VERDICT_ICONS, F.col("verdict"))
    route = F.concat(F.coalesce("method", F.lit("None")), F.lit(" "), F.coalesce("path", F.lit("None")))
    if markdown:
        title = F.concat(F.lit("#### "), icon, F.lit(" `"), route, F.lit("`"))
        change_line = F.concat(F.lit("- **"), "severity", F.lit("**: "), "detail")
    else:
        title = F.concat(icon, F.lit(" "), route, F.lit("  ("), F.col(keys[-1]), F.lit(", "), F.col("status"), F.lit(")"))
        change_line = F.concat(F.lit("    "), F.rpad("severity", 9, " "), F.lit(" "), F.replace("detail", F.lit("`"), F.lit("")))
    header = states.select(*keys, F.lit(0).alias("section"), F.lit(0).alias("severity_rank"), F.lit("").alias("item"),
                           title.alias("line"))
    change_rows = changes.select(*keys, F.lit(1).alias("section"), severity_rank("severity").alias("severity_rank"),
                                 F.concat("type", F.lit(":"), "item").alias("item"), change_line.alias("line"))
    parts = [header, change_rows]
    if "downstream" in base:
        delta = diff.delta_of(found, keys)
        group = F.replace("grp", F.lit("_"), F.lit(" "))
        added = F.col("change") == "added"
        if markdown:
            line = F.concat(F.when(added, "- **new dependency** (").otherwise("- **dropped dependency** ("), group,
                            F.lit("): `"), "item", F.lit("`"))
        else:
            line = F.concat(F.lit("    "), F.when(added, "new dep  ").otherwise("dropped  "), F.lit(" "), group, F.lit(": "), "item")
        parts.append(delta.select(*keys, F.lit(2).alias("section"), F.when(added, 0).otherwise(1).alias("severity_rank"),
                                  F.concat("grp", F.lit(":"), "item").alias("item"), line.alias("line")))
    return reduce(DataFrame.unionByName, parts)


def summary_line(summary: DataFrame) -> DataFrame:
    """First line of a rendered comparison, from `compare_summary`."""
    v = F.col("verdict")
    n = lambda c: F.col(c).cast("string")
    return summary.select(F.concat(
        _lookup(VERDICT_ICONS, v), F.lit(" "), _lookup(VERDICT_LABELS, v), F.lit(": "), _lookup(VERDICT_EXPLANATIONS, v), F.lit(" "),
        n("endpoints_changed"), F.lit(" endpoint(s) changed · "), n("breaking"), F.lit(" breaking · "), n("minor"), F.lit(" minor · "),
        n("additive"), F.lit(" additive"), F.when(~F.col("complete"), F.lit(
            " (a report is an incremental scan, removed endpoints are not detected)")).otherwise("")).alias("line"))


def write_result(lines: DataFrame, path: str, keys: Sequence[str] = KEYS) -> None:
    lines.orderBy(*keys, "section", "severity_rank", "item").select("line").write.mode("overwrite").text(path)


# ---------------------------------------------------------------- recommendations and facts

STRICTER_TYPES = ("VALIDATION_ADDED", "VALIDATION_CHANGED", "PARAM_NOW_REQUIRED", "REQUEST_FIELD_ADDED")


def recommendation_inputs(changes: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Counts and flags of a change table that the recommendation rules read."""
    breaking = F.col("severity") == "breaking"
    return changes.groupBy(*keys).agg(
        F.count("*").alias("changes"), F.count_if(breaking).alias("breaking"),
        F.coalesce(F.bool_or(breaking & F.col("type").isin(*STRICTER_TYPES)), F.lit(False)).alias("stricter_input"),
        F.coalesce(F.bool_or(breaking & F.col("type").startswith("RESPONSE_")), F.lit(False)).alias("response_broken"),
        F.coalesce(F.bool_or(F.col("type") == "SECURITY_CHANGED"), F.lit(False)).alias("access_changed"))


def smallest_per_group(df: DataFrame, keys: Sequence[str], value: str, k: int) -> DataFrame:
    """The k smallest distinct values per key as a sorted array; rank limits run before the shuffle."""
    return smallest_of_distinct(df.select(*keys, value).distinct(), keys, value, k)


def smallest_of_distinct(df: DataFrame, keys: Sequence[str], value: str, k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(value)
    top = df.select(*keys, value).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k)
    return top.groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias(value))


# Downstream groups in the order they are reported.
DOWNSTREAM_GROUPS = ("databases", "caches", "messaging", "external_apis", "other")
COORDINATE = "Coordinate the release with calling services"


def new_dependency_notes(delta: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, new_dependencies, database_delta): one sentence per group with new items, naming the first three.

    There are five groups, so the sentences of an endpoint are few.
    """
    group = F.array_position(F.array(*[F.lit(g) for g in DOWNSTREAM_GROUPS]), F.col("grp"))
    first = smallest_per_group(delta.where("change = 'added'"), [*keys, "grp"], "item", 3)
    note = F.concat(F.lit("New downstream "), F.replace("grp", F.lit("_"), F.lit(" ")), F.lit(": "), F.array_join("item", ", "),
                    F.lit(" - check availability, permissions and load"))
    notes = first.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(group.alias("o"), note.alias("n")))).alias("_n"))
    databases = delta.groupBy(*keys).agg(F.bool_or(F.col("grp") == "databases").alias("database_delta"))
    return databases.join(notes.select(*keys, F.transform("_n", lambda x: x["n"]).alias("new_dependencies")), list(keys), "left")


def recommendations(facts: DataFrame) -> DataFrame:
    """Rule-driven sentences, one array per endpoint.

    Reads breaking, stricter_input, response_broken, access_changed, caller_count, new_dependencies and
    database_delta (see new_dependency_notes), shared_users and shared_names (first names). The sentence `COORDINATE`
    concerns every calling service; `recommendation_rows` names them, one row each.
    """
    breaking = F.col("breaking") > 0
    before = F.array(
        F.when(breaking, F.concat(F.col("breaking").cast("string"), F.lit(
            " breaking change(s): version the endpoint or keep the old contract until clients migrate"))),
        F.when(breaking & (F.col("caller_count") > 0), F.lit(COORDINATE)),
        F.when(F.col("stricter_input"), F.lit(
            "Stricter input rules: requests that passed before can now fail with 400 - check client payloads")),
        F.when(F.col("response_broken"), F.lit("Response shape changed: update client deserialization and contract tests")),
        F.when(F.col("access_changed"), F.lit("Access rules changed: verify roles/scopes of every client")))
    after = F.array(F.when(
        (F.col("shared_users") > 0) & (breaking | F.coalesce("database_delta", F.lit(False))),
        F.concat(F.lit("Shares data with "), F.col("shared_users").cast("string"), F.lit(" other endpoint(s) through "),
                 F.array_join("shared_names", ", "), F.lit(": regression-test them"))))
    none = F.array().cast("array<string>")
    kept = F.filter(F.concat(before, F.coalesce("new_dependencies", none), after), lambda r: r.isNotNull())
    default = F.array(F.lit("No contract change detected between these versions"))
    return facts.withColumn("recommendations", F.when(F.size(kept) > 0, kept).otherwise(default))


def recommendation_rows(found: DataFrame, callers: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, recommendation, name): one row per sentence, and for `COORDINATE` one per calling service, however many there are.

    found: result of recommendations; callers: keys, caller, caller_module.
    """
    rows = found.select(*keys, F.explode("recommendations").alias("recommendation"))
    names = callers.select(*keys, F.coalesce(non_empty("caller_module"), "caller").alias("name")).distinct()
    alone = rows.where(F.col("recommendation") != COORDINATE).withColumn("name", F.lit(None).cast("string"))
    return alone.unionByName(rows.where(F.col("recommendation") == COORDINATE).join(names, list(keys)))


def impact_facts(counts: DataFrame, scanner_based: bool = True) -> DataFrame:
    """Verdict, title, explanation and fact sentences from counts: changes, breaking, minor, callers, sharers, added, removed.

    `affected_rows` lists who is affected, `diff.dependency_items` the dependencies by group, as long tables.
    """
    if scanner_based:
        verdict = verdict_of(F.col("breaking"), F.col("minor"), F.col("added") + F.col("removed"))
    else:
        levels = rule_array(list(LEVEL_VERDICTS.items()), ["level", "verdict"])
        verdict = F.coalesce(F.get(F.filter(levels, lambda r: r["level"] == F.col("level")), F.lit(0))["verdict"], F.lit("clear"))
    titles = F.create_map(*[F.lit(x) for pair in VERDICT_TITLES.items() for x in pair])
    n_deps = F.col("added") + F.col("removed")
    meaning = F.create_map(*[F.lit(x) for pair in IMPACT_EXPLANATIONS.items() for x in pair])
    alone = (F.col("callers") == 0) & (F.col("sharers") == 0) & F.lit(scanner_based)
    nothing = (verdict == "clear") & (F.col("changes") == 0) & (n_deps == 0)
    explanation = F.when(nothing, F.lit(NOTHING_CHANGED)).otherwise(F.concat(meaning[verdict], F.when((verdict == "hold") & alone, F.lit(NO_CALLERS)).otherwise("")))
    dep_text = F.concat_ws(", ", F.when(F.col("added") > 0, F.concat(F.col("added").cast("string"), F.lit(" new"))),
                           F.when(F.col("removed") > 0, F.concat(F.col("removed").cast("string"), F.lit(" removed"))))
    facts = F.filter(F.array(
        F.when(F.col("changes") > 0, F.concat(plural("breaking", "breaking change"), F.when(
            F.col("breaking") != F.col("changes"), F.concat(F.lit(" of "), F.col("changes").cast("string"))).otherwise(""))),
        F.when(F.col("callers") > 0, F.concat(plural("callers", "caller"), F.lit(" in the scanned code"))),
        F.when(F.col("sharers") > 0, F.concat(plural("sharers", "endpoint"), F.lit(" sharing data"))),
        F.when(n_deps > 0, F.concat(dep_text, F.lit(" dependenc"), F.when(n_deps == 1, "y").otherwise("ies"))),
    ), lambda f: f.isNotNull())
    return (counts.withColumn("explanation", explanation).withColumn("verdict", verdict).withColumn("title", titles[F.col("verdict")])
            .withColumn("facts", facts))


def affected_rows(targets: DataFrame, callers: DataFrame, usage: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, kind, name, module, how, detail): who is affected by a change of each target endpoint, one row per reason.

    targets(keys), callers(keys, caller, caller_module, kind, detail), usage(kind, resource, user): endpoints by the resources they use, where
    the last of `keys` is the user and the others scope it. A sharer is written `name (handler)` and has a row for each resource it shares.
    """
    keys = list(keys)
    *scope, own = keys
    calling = callers.join(targets.select(*keys), keys, "left_semi").select(
        *keys, F.lit("caller").alias("kind"), F.col("caller").alias("name"), F.col("caller_module").alias("module"),
        F.when(F.col("kind") == "gateway_route", "Routes requests to this API").otherwise("Calls this API").alias("how"), F.col("detail"))
    mine = usage.select(*scope, F.col("kind").alias("_kind"), F.col("resource").alias("_resource"), F.col("user").alias(own)).join(targets.select(*keys), keys, "left_semi").distinct()
    others = usage.select(*scope, F.col("kind").alias("_kind"), F.col("resource").alias("_resource"), F.col("user").alias("_user")).distinct()
    handler = F.when(F.col("_user").contains(" ("), F.regexp_replace(F.expr("substring(_user, instr(_user, ' (') + 2)"), r"\)+$", "")).otherwise("")
    sharing = mine.join(others, [*scope, "_kind", "_resource"]).where(F.col("_user") != F.col(own)).select(
        *keys, F.lit("shares").alias("kind"), F.substring_index("_user", " (", 1).alias("name"), handler.alias("module"),
        F.concat(F.lit("Shares "), "_kind", F.lit(" "), "_resource").alias("how"), F.lit("").alias("detail"))
    return calling.unionByName(sharing)
