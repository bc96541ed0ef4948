"""From changed lines to changed symbols and, through the call graph, to impacted endpoints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .closure import closure
from .intervals import overlap_join


def changed_symbols(hunks: DataFrame, types: DataFrame, methods: DataFrame, scope: Sequence[str] = (),
                    whole_files: DataFrame | None = None) -> DataFrame:
    """(symbol_kind, symbol) touched by changed line ranges.

    hunks(hunk, file, h_start, h_end), types(type, file, t_start, t_end, outer), methods(method, type, file, m_start, m_end).
    A hunk inside a type that meets none of its methods and no nested type changes the whole type
    and all its methods; so do `whole_files` (file), used when there is no parent commit.
    """
    on = [*scope, "file"]
    # each overlap is read twice below
    in_types = cut_lineage(overlap_join(hunks, types, on, ("h_start", "h_end"), ("t_start", "t_end")).select(*on, "hunk", "type", "outer"))
    in_methods = cut_lineage(overlap_join(hunks, methods.select(*on, "method", F.col("type"), "m_start", "m_end"), on, ("h_start", "h_end"), ("m_start", "m_end"))
                             .select(*on, "hunk", "type", "method"))
    covered = (in_methods.select(*on, "hunk", "type")
               .unionByName(in_types.where("outer IS NOT NULL").select(*on, "hunk", F.col("outer").alias("type"))).distinct())
    whole = in_types.join(covered, [*on, "hunk", "type"], "left_anti").select(*scope, "type")
    if whole_files is not None:
        whole = whole.unionByName(types.join(whole_files, on, "left_semi").select(*scope, "type"))
    whole = whole.distinct()
    of_types = methods.select(*scope, "type", "method").join(whole, [*scope, "type"], "left_semi").select(*scope, "method")
    hit = in_methods.select(*scope, "method").unionByName(of_types).distinct()
    return (whole.select(*scope, F.lit("type").alias("symbol_kind"), F.col("type").cast("string").alias("symbol"))
            .unionByName(hit.select(*scope, F.lit("method").alias("symbol_kind"), F.col("method").cast("string").alias("symbol"))))


def repo_usage_reasons(facts: DataFrame, repositories: DataFrame, changed_types: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Methods that use a repository whose own type or entity changed: (method, reason).

    facts(method, repository), repositories(repository, type, entity), changed_types(type).
    """
    either = repositories.select(*scope, "repository", F.explode(F.array("type", "entity")).alias("type")).where("type IS NOT NULL")
    changed = either.join(changed_types, [*scope, "type"], "left_semi").select(*scope, "repository").distinct()
    reason = F.concat(F.lit("uses changed repository/entity: "), F.col("repository"))
    return (facts.where("repository IS NOT NULL").join(changed, [*scope, "repository"], "left_semi")
            .select(*scope, "method", reason.alias("reason")).distinct())


def propagate_reasons(calls: DataFrame, reasons: DataFrame, scope: Sequence[str] = (), handlers: DataFrame | None = None) -> DataFrame:
    """Reasons of changed methods carried to every direct or indirect caller: (scope, method, reason), distinct.

    calls(scope, caller, callee), reasons(scope, method, reason), handlers(scope, method): only these methods are wanted. Kept long: a
    method's reasons are as many as the changes below it, so they are never gathered into one row.
    """
    upward = calls.select(*scope, F.col("callee").alias("src"), F.col("caller").alias("dst"))
    seeds = reasons.select(*scope, F.col("reason").alias("origin"), F.col("method").alias("node"))
    targets = None if handlers is None else handlers.select(*scope, F.col("method").alias("node"))
    return closure(upward, seeds, True, scope, targets).select(*scope, F.col("node").alias("method"), F.col("origin").alias("reason"))


def impacted_endpoints(reached: DataFrame, endpoints: DataFrame, references: DataFrame, changed_types: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """(scope, endpoint, reason): the handler is reached, or a referenced model type changed.

    reached(scope, method, reason), endpoints(scope, endpoint, handler), references(scope, endpoint, type), changed_types(scope, type).
    """
    by_call = reached.join(endpoints.select(*scope, "endpoint", F.col("handler").alias("method")), [*scope, "method"]).select(*scope, "endpoint", "reason")
    short = F.substring_index("type", ".", -1)
    # written, so that the real size of what changed decides whether references meet it where they are read, before they are made distinct
    by_model = (references.join(cut_lineage(changed_types.select(*scope, "type")), [*scope, "type"], "left_semi")
                .select(*scope, "endpoint", F.concat(F.lit("changed model: "), short).alias("reason")))
    return by_call.unionByName(by_model).distinct()


def endpoint_model_changes(impacted: DataFrame, references: DataFrame, model_changes: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Field changes of the model types an impacted endpoint refers to, each once."""
    ends = impacted.select(*scope, "endpoint").distinct()
    changes = cut_lineage(model_changes.withColumnRenamed("type", "change"))
    # changed types are few beside the references: those to other types go first, and only the rest meets the endpoints
    told = references.select(*scope, "endpoint", F.col("type").alias("dto")).join(changes.select(*scope, "dto"), [*scope, "dto"], "left_semi")
    return told.join(ends, [*scope, "endpoint"], "left_semi").join(changes, [*scope, "dto"]).distinct()


def changed_functions(routes: DataFrame, changed_files: DataFrame, extension: str = ".py", scope: Sequence[str] = ()) -> DataFrame:
    """File-level variant: every route of a changed source file counts as changed. routes(file, function)."""
    files = changed_files.where(F.col("file").endswith(extension)).select(*scope, "file").distinct()
    return routes.join(files, [*scope, "file"], "left_semi").select(*scope, "function").distinct()


def function_impact(routes: DataFrame, changed: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Callees by simple name that each changed function reaches: (scope, function, callee). routes(scope, function, calls ARRAY)."""
    edges = routes.select(*scope, F.col("function").alias("src"), F.explode(F.transform("calls", call_name)).alias("dst")).where("dst <> ''")
    seeds = changed.select(*scope, F.col("function").alias("origin"), F.col("function").alias("node"))
    return closure(edges, seeds, scope=scope).where("origin <> node").select(*scope, F.col("origin").alias("function"), F.col("node").alias("callee"))


def displayable(listed: DataFrame, methods: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Drops abstract methods from a list when it also holds an implementation of the same name.

    listed(keys, method), methods(method, name, abstract).
    """
    rows = listed.join(methods, "method", "left")
    done = rows.where("abstract = false").select(*keys, "name").distinct().withColumn("_done", F.lit(True))
    marked = rows.join(done, [*keys, "name"], "left")
    return marked.where(~(F.coalesce("abstract", F.lit(False)) & F.coalesce("_done", F.lit(False)))).select(*listed.columns)


# ---------------------------------------------------------------- call names

# Calls that are no service calls.
IGNORED_CALLS = ("lower", "strip", "str", "isinstance")


def call_name(call: Column) -> Column:
    """Simple name of a call text: before the bracket, after the last dot."""
    return F.substring_index(F.regexp_replace(F.substring_index(call, "(", 1), r"^\s+|\s+$", ""), ".", -1)


def service_calls(calls: Column) -> Column:
    """Distinct simple names without validators and the ignored builtins."""
    names = F.transform(calls, call_name)
    return F.array_sort(F.array_distinct(F.filter(names, lambda n: ~n.startswith("validate") & ~n.isin(*IGNORED_CALLS))))


def call_graph_entries(calls: Column) -> Column:
    """Simple names in call order without the ignored builtins."""
    return F.filter(F.transform(calls, call_name), lambda n: ~n.isin(*IGNORED_CALLS))
