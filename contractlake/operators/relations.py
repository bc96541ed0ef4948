"""Relations of endpoints: callers, shared resources, endpoint lookup and impact."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import first_non_empty, non_empty
from .verdict import impact_level, new_dependency_notes, recommendations, smallest_of_distinct, smallest_per_group

# ---------------------------------------------------------------- paths and patterns


def segments(path: Column) -> Column:
    """Path parts without the outer slashes."""
    return F.split(F.regexp_replace(path, "^/+|/+$", ""), "/")


def quote(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\.\[\]{}()*+?^$|\-&#~\s])", r"\\$1")


def path_regex(path: Column) -> Column:
    """/owners/{id}/pets -> anchored pattern of the concrete and templated variants."""
    parts = F.transform(segments(path), lambda s: F.when(s.rlike(r"^\{[^}]+\}$"), "[^/]+").otherwise(quote(s)))
    return F.concat(F.lit("^/"), F.array_join(parts, "/"), F.lit("/?$"))


def url_path(detail: Column) -> Column:
    """Path of `GET http://svc/owners/{id}?x=1`; NULL when nothing rooted is left."""
    url = F.when(detail.contains(" "), F.regexp_replace(detail, r"^[^ ]* ", "")).otherwise(detail)
    bare = F.substring_index(F.regexp_replace(url, r"^\w+://[^/]+", ""), "?", 1)
    return F.when(bare.startswith("/"), bare)


def call_verb(detail: Column) -> Column:
    return F.when(detail.contains(" "), F.substring_index(detail, " ", 1))


def gateway_regex(predicate: Column) -> Column:
    """Pattern of a gateway predicate (`Path=/x/**`); it matches from the start, open at the end."""
    pattern = F.when(predicate.contains("="), F.regexp_replace(predicate, "^[^=]*=", "")).otherwise(predicate)
    quoted = quote(F.trim(pattern))
    return F.concat(F.lit("^"), F.replace(F.replace(quoted, F.lit(r"\*\*"), F.lit(".*")), F.lit(r"\*"), F.lit("[^/]*")))


def ant_regex(pattern: Column) -> Column:
    """Pattern of a URL rule: `/**` also matches nothing, `**` anything, `*` within a part, {x} one part."""
    quoted = quote(pattern)
    quoted = F.replace(quoted, F.lit(r"/\*\*"), F.lit("(/.*)?"))
    quoted = F.replace(quoted, F.lit(r"\*\*"), F.lit(".*"))
    quoted = F.replace(quoted, F.lit(r"\*"), F.lit("[^/]*"))
    return F.concat(F.lit("^"), F.regexp_replace(quoted, r"\\\{[^}]*\\\}", "[^/]+"), F.lit("$"))


def literal_prefix(pattern: Column) -> Column:
    """Whole leading path parts of a pattern before its first wildcard, each with its slash ('' when none)."""
    plain = F.regexp_extract(pattern, r"^([^*{]*)", 1)
    return F.when(plain.contains("/"), F.regexp_replace(plain, "/[^/]*$", "/")).otherwise("")


def path_prefixes(path: Column) -> Column:
    """'' and every leading run of whole parts with its slash: /a/b/c -> '', '/', '/a/', '/a/b/', '/a/b/c/'."""
    clean = F.filter(F.split(path, "/"), lambda s: s != "")
    runs = F.transform(F.sequence(F.lit(0), F.size(clean)), lambda n: F.concat(
        F.lit("/"), F.array_join(F.slice(clean, 1, n), "/"), F.when(n > 0, "/").otherwise("")))
    return F.array_distinct(F.concat(F.array(F.lit("")), runs))


def template_mask(path: Column) -> Column:
    """One letter per path part: v for a {variable}, l for a literal."""
    return F.array_join(F.transform(segments(path), lambda s: F.when(s.rlike(r"^\{[^}]+\}$"), "v").otherwise("l")), "")


def masked_key(path: Column, mask: Column) -> Column:
    """Path with the parts the mask calls variable replaced by `*` (whole text, parts joined by /)."""
    return F.array_join(F.transform(segments(path), lambda s, i: F.when(F.substr(mask, i + 1, F.lit(1)) == "v", "*").otherwise(s)), "/")


def match_templates(urls: DataFrame, templates: DataFrame, by: Sequence[str], url: str = "url_path", template: str = "path") -> DataFrame:
    """URL paths joined with the path templates they match, within the `by` columns.

    No pattern is tried against every URL: each URL is masked with the few distinct template
    shapes of its length and then meets the templates through an equality join on the masked text,
    which also spreads the URLs of a hot module.
    """
    shaped = (templates.withColumn("_mask", template_mask(F.col(template))).withColumn("_n", F.size(segments(F.col(template))))
              .withColumn("_key", masked_key(F.col(template), F.col("_mask"))))
    shapes = shaped.select(*by, "_n", "_mask").distinct()
    # an empty part fits no variable and one closing slash is allowed, so a double slash never matches
    usable = urls.where(~F.col(url).contains("//")).withColumn("_n", F.size(segments(F.col(url))))
    # the root path is one empty part, which no variable takes
    masked = (usable.join(shapes, [*by, "_n"]).where((F.col(url) != "/") | (F.col("_mask") != "v"))
              .withColumn("_key", masked_key(F.col(url), F.col("_mask"))))
    return masked.join(shaped, [*by, "_n", "_mask", "_key"]).drop("_n", "_mask", "_key")


# shares of the paths that meet patterns without a literal part
SALTS = 16


def match_patterns(paths: DataFrame, patterns: DataFrame, by: Sequence[str], path: str, pattern: str, regex: str) -> DataFrame:
    """Paths joined with wildcard patterns: equality on a literal prefix first, the regex only on what meets.

    Every path has the prefixes '' and '/', so for these two the paths are dealt out over `SALTS` shares, each with all the patterns.
    """
    short = F.length("_prefix") <= 1
    left = (paths.withColumn("_prefix", F.explode(path_prefixes(F.col(path))))
            .withColumn("_salt", F.when(short, F.pmod(F.xxhash64(path), F.lit(SALTS))).otherwise(0).cast("int")))
    right = (patterns.withColumn("_prefix", literal_prefix(F.col(pattern)))
             .withColumn("_salt", F.explode(F.when(short, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))))
    return left.join(right, [*by, "_prefix", "_salt"]).where(F.expr(f"`{path}` RLIKE `{regex}`")).drop("_prefix", "_salt")


# ---------------------------------------------------------------- callers

def consumers(edges: DataFrame, nodes: DataFrame, endpoints: DataFrame, scope: Sequence[str] = (), modules: DataFrame | None = None) -> DataFrame:
    """Callers of endpoints: other services over HTTP and gateways that route to them.

    edges(src, dst, kind, detail), nodes(id, type, name, module), endpoints(endpoint, method, path, module, context_path).
    The module-level twin of a component caller is dropped. With `modules` callers carry the name their module runs under.
    """
    module_id = F.concat(F.lit("module:"), F.col("module"))
    ends = endpoints.withColumn("dst", module_id).withColumn("full_path", F.concat(F.coalesce("context_path", F.lit("")), "path"))
    who = nodes.select(*scope, F.col("id").alias("src"), F.col("type").alias("caller_type"), F.coalesce(non_empty("name"), F.col("id")).alias("caller"),
                       F.col("module").alias("caller_module"))
    raw = edges.where("kind IN ('http', 'routes')").select(*scope, "src", "dst", "kind", "detail").distinct()

    calls = (raw.where("kind = 'http'").withColumn("url_path", url_path(F.col("detail"))).withColumn("verb", call_verb(F.col("detail")))
             .where("url_path IS NOT NULL"))
    both = F.array_distinct(F.array("full_path", "path"))
    templates = ends.select(*scope, "dst", "endpoint", "method", F.explode(both).alias("template"))
    served = (match_templates(calls, templates, [*scope, "dst"], "url_path", "template")
              .where("verb IS NULL OR verb = method OR verb = 'ANY'").select(*scope, "endpoint", "src", "detail").distinct()
              .withColumn("kind", F.lit("service_call")))

    predicates = (raw.where("kind = 'routes'").withColumn("predicate", F.explode(F.split("detail", ",")))
                  .withColumn("_pattern", F.trim(F.regexp_replace("predicate", "^[^=]*=", ""))).withColumn("_regex", gateway_regex(F.col("predicate"))))
    routed = (match_patterns(ends.select(*scope, "dst", "endpoint", "full_path"), predicates, [*scope, "dst"], "full_path", "_pattern", "_regex")
              .select(*scope, "endpoint", "src", "detail").distinct().withColumn("kind", F.lit("gateway_route")))

    found = served.unionByName(routed).join(who, [*scope, "src"], "left").withColumn("caller", F.coalesce("caller", "src"))
    found = found.select(*scope, "endpoint", "kind", "caller", "caller_type", "caller_module", "detail")
    # one aggregate tells for (endpoint, caller module, detail) whether a component caller exists
    keys = [*scope, "endpoint", "caller_module", "detail"]
    precise = found.where("caller_type = 'component'").select(*keys).distinct()
    twin = (F.col("caller_type") == "module") & (F.col("kind") == "service_call")
    twin = F.coalesce(twin, F.lit(False))
    out = found.where(~twin).unionByName(found.where(twin).join(precise, keys, "left_anti")).distinct()
    if modules is None:
        return out
    named = module_runtime_lookup(out.withColumnRenamed("caller_module", "module"), modules, scope)
    # a gateway is known by its own name
    shown = F.when(F.col("kind") == "gateway_route", F.col("caller")).otherwise(F.col("module_name"))
    return named.withColumn("caller_module", shown).select(*out.columns)


def find_endpoint(wanted: DataFrame, endpoints: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """The endpoint a document name refers to: same handler first, then same method and path, then the first.

    wanted(api, handler, method, path), endpoints(endpoint, doc_name, handler, method, path, pos). An endpoint
    answers to its doc name, its handler and the last part of it. Each way of asking is a lookup key that
    holds one endpoint, so a name that many endpoints share never multiplies.
    """
    bar = F.lit("|")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    by_handler = F.concat(F.lit("h:"), F.col("api"), bar, text("handler"))
    by_route = F.concat(F.lit("p:"), F.col("api"), bar, text("method"), bar, text("path"))
    by_name = F.concat(F.lit("a:"), F.col("api"))
    names = F.array_distinct(F.filter(F.array("doc_name", "handler", F.substring_index("handler", ".", -1)), lambda n: n.isNotNull()))
    listed = endpoints.select(*scope, F.explode(names).alias("api"), "endpoint", "handler", "method", "path", "pos")
    keyed = listed.select(*scope, "endpoint", "pos", F.explode(F.array(by_handler, by_route, by_name)).alias("_key"))
    first = keyed.groupBy(*scope, "_key").agg(F.min_by("endpoint", F.struct("pos", "endpoint")).alias("endpoint"))
    asked = wanted.distinct().withColumn("_k", F.explode(F.array(*[
        F.struct(F.lit(i).alias("rank"), k.alias("key")) for i, k in enumerate((by_handler, by_route, by_name))])))
    rows = asked.select(*scope, "api", "handler", "method", "path", F.col("_k.rank").alias("_rank"), F.col("_k.key").alias("_key")).join(first, [*scope, "_key"])
    return rows.groupBy(*scope, "api", "handler", "method", "path").agg(F.min_by("endpoint", "_rank").alias("endpoint"))


def module_runtime_lookup(refs: DataFrame, modules: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Adds module_name (application name, else name, else the path) and context_path of the module a row refers to."""
    m = modules.select(*scope, F.col("path").alias("module"), "app_name", "name", "context_path")
    out = refs.join(m, [*scope, "module"], "left")
    return (out.withColumn("module_name", first_non_empty("app_name", "name", "module"))
            .withColumn("context_path", F.coalesce("context_path", F.lit(""))).drop("app_name", "name"))


# ---------------------------------------------------------------- shared resources

def resource_users(usage: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Resources that several endpoints use, as (kind, name, user, users).

    Star form: endpoints share a resource exactly when both hang on it. It grows with the usage
    rows, where the list of all pairs grows with the square of a hot table's users.
    """
    distinct = usage.select(*scope, "kind", "name", "user").distinct()
    hubs = distinct.groupBy(*scope, "kind", "name").agg(F.count("*").alias("users")).where("users > 1")
    return distinct.join(hubs, [*scope, "kind", "name"])


def shared_resources(usage: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Per endpoint and shared resource, (kind, name, user, others): how many others use it.

    The others are the rows of the same resource (star form), all of them.
    """
    found = resource_users(usage, scope)
    return found.select(*scope, "kind", "name", "user", (F.col("users") - 1).alias("others"))


def first_sharers(usage: DataFrame, scope: Sequence[str] = (), shown: int = 8) -> DataFrame:
    """Per endpoint and shared resource: how many others use it and the first `shown` of them by name, for display."""
    keys = [*scope, "kind", "name"]
    distinct = usage.select(*keys, "user").distinct()
    hubs = distinct.groupBy(*keys).agg(F.count("*").alias("_users")).where("_users > 1")
    # one more than shown, so that the endpoint itself can be left out
    first = smallest_of_distinct(distinct, keys, "user", shown + 1).withColumnRenamed("user", "_first")
    others = F.slice(F.filter("_first", lambda u: u != F.col("user")), 1, shown)
    return distinct.join(hubs.join(first, keys), keys).select(*keys, "user", (F.col("_users") - 1).alias("others"), others.alias("also_used_by"))


def published_topics(publishes: DataFrame, listeners: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Topics an endpoint publishes that somebody consumes, with the number of consumers."""
    listening = listeners.where("member IS NOT NULL").select(*scope, F.col("destination").alias("name"), "technology", "member").distinct()
    counts = listening.groupBy(*scope, "name", "technology").agg(F.count("*").alias("others"))
    return publishes.select(*scope, "user", "name").distinct().join(counts, [*scope, "name"]).withColumn("kind", F.lit("topic"))


def affected_apis(targets: DataFrame, callers: DataFrame, usage: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Caller modules and sharers of the requested endpoints: (target, affected), distinct.

    targets(user), callers(endpoint, caller, caller_module), usage(kind, name, user).
    """
    who = F.coalesce(non_empty("caller_module"), "caller")
    calling = callers.join(targets.withColumnRenamed("user", "endpoint"), [*scope, "endpoint"], "left_semi").select(
        *scope, F.col("endpoint").alias("target"), who.alias("affected"))
    mine = usage.join(targets, [*scope, "user"], "left_semi").select(*scope, "kind", "name", F.col("user").alias("target")).distinct()
    sharing = usage.join(mine, [*scope, "kind", "name"]).where("user <> target").select(*scope, "target", F.col("user").alias("affected"))
    return calling.unionByName(sharing).distinct()


# ---------------------------------------------------------------- impact

def endpoint_impact(verdicts: DataFrame, inputs: DataFrame, callers: DataFrame, shared: DataFrame, delta: DataFrame,
                    key: str = "api", scope: Sequence[str] = ()) -> DataFrame:
    """Impact record of every changed endpoint at once: counts, level, migration flag, recommendations.

    verdicts: key, breaking, minor, additive, delta; inputs: recommendation_inputs; callers: key, caller, caller_module;
    shared: key, kind, name, others; delta: key, grp, item, change.
    """
    keys = [*scope, key]
    caller_counts = callers.distinct().groupBy(*keys).agg(F.count("*").alias("caller_count"))
    shared_counts = shared.groupBy(*keys).agg(
        F.count("*").alias("shared_count"), F.sum(F.when(F.col("kind") == "table", F.col("others")).otherwise(0)).alias("shared_users"))
    shared_names = smallest_per_group(shared.where("kind = 'table'").select(*keys, F.col("name").alias("shared_names")), keys, "shared_names", 3)
    flags = inputs.drop("changes", "breaking")
    out = verdicts
    for part in (flags, caller_counts, shared_counts, shared_names, new_dependency_notes(delta, keys)):
        out = out.join(part, keys, "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("caller_count", "shared_count", "shared_users")})
    out = out.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("stricter_input", "response_broken", "access_changed")})
    total = F.col("breaking") + F.col("minor") + F.col("additive")
    level = impact_level(F.col("breaking"), total, F.col("caller_count"), F.col("shared_count"), F.col("delta"))
    return recommendations(out.withColumn("impact_level", level).withColumn("migration_required", F.col("breaking") > 0))


# Change types of stored model diffs that break clients on their own.
BREAKING_MODEL_TYPES = ("FIELD_REMOVED", "TYPE_CHANGED", "VALIDATION_ADDED", "VALIDATION_CHANGED")


def stored_change_severity(kind: Column, required: Column) -> Column:
    """Severity of a stored model change when only one version has structured data."""
    return F.when(kind.isin(*BREAKING_MODEL_TYPES) | F.coalesce(required, F.lit(False)), "breaking").otherwise("minor")


# shares of an endpoint's callers
SPREAD = 64


def impact_graph(endpoints: DataFrame, callers: DataFrame, usage: DataFrame, shared: DataFrame, scope: Sequence[str] = (),
                 declared: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, links) around each endpoint: callers in, resources out, up to eight sharers per resource.

    endpoints(center, label, has_route), callers(center, caller, kind, detail), usage(center, kind, name, operation, detail) from the endpoint's route: the detail is the
    call that reaches a table, the technology of a cache or topic, verb and URL of a service. An endpoint without a route shows what its model
    declares(center, kind, name) instead, without details. shared(center, kind, name, also_used_by).
    """
    routed = endpoints.where("has_route").select(*scope, "center") if "has_route" in endpoints.columns else endpoints.select(*scope, "center")
    used = [usage.join(routed, [*scope, "center"], "left_semi").select(*scope, "center", "kind", "name", "operation", F.coalesce("detail", F.lit("")).alias("detail"))]
    if declared is not None:
        operation = F.when(F.col("kind") == "topic", "publish").when(F.col("kind") == "service", "http").otherwise("uses")
        used.append(declared.join(routed, [*scope, "center"], "left_anti").select(*scope, "center", "kind", "name", operation.alias("operation"), F.lit("").alias("detail")))
    usage = reduce(DataFrame.unionByName, used)
    c = F.col
    center = F.concat(F.lit("endpoint:"), "label")
    ids = endpoints.select(*scope, "center", center.alias("_id"))
    call = callers.select(*scope, "center", F.concat(F.lit("caller:"), "caller").alias("id"), c("kind").alias("type"), "detail")
    res = usage.select(*scope, "center", F.concat("kind", F.lit(":"), "name").alias("id"), "operation", "detail")
    near = shared.select(*scope, "center", F.concat("kind", F.lit(":"), "name").alias("resource"), F.explode("also_used_by").alias("other"))

    # rows travel once and narrow: a kind and a name, the sharers of a resource as one list. Ids, labels and sharers' nodes are made where the rows of an endpoint meet;
    # only its callers, which can be many, are spread
    def spread(node_id: Column) -> Column:
        return F.when(node_id.startswith("caller:"), F.pmod(F.xxhash64(node_id), F.lit(SPREAD)).cast("short")).otherwise(F.lit(0).cast("short")).alias("_part")

    def part(df: DataFrame, order: int, kind: Column, name: Column, node_id: Column) -> DataFrame:
        return df.select(*scope, "center", kind.alias("kind"), name.alias("name")).select(
            *scope, "center", spread(node_id), F.lit(order).cast("byte").alias("_o"), "kind", "name", F.lit(None).cast("array<string>").alias("_others"))

    resource, caller = F.concat("kind", F.lit(":"), "name"), F.concat(F.lit("caller:"), "name")
    seen = shared.where(F.size("also_used_by") > 0).select(*scope, "center", "kind", "name", "also_used_by", spread(resource))
    row = lambda at, order, kind, name, others: F.struct(at.alias("_part"), F.lit(order).cast("byte").alias("_o"), kind.alias("kind"), name.alias("name"), others.alias("_others"))
    none, home = F.lit(None).cast("string"), F.lit(0).cast("short")
    both = F.array(row(c("_part"), 3, c("kind"), c("name"), c("also_used_by")))
    apart = F.array(row(c("_part"), 3, c("kind"), c("name"), F.lit(None).cast("array<string>")), row(home, 4, none, none, c("also_used_by")))
    parts = [part(endpoints, 0, F.lit("endpoint"), c("label"), F.concat(F.lit("endpoint:"), "name")), part(callers, 1, c("kind"), c("caller"), caller),
             # already dealt out by their endpoint, to tell which have a route: operations and details need not come that far
             *[part(u.select(*scope, "center", "kind", "name").distinct(), 2, c("kind"), c("name"), resource) for u in used], seen.select(*scope, "center", F.inline(F.when(c("_part") == 0, both).otherwise(apart)))]
    dealt = reduce(DataFrame.unionByName, parts).repartition(*scope, "center", "_part")
    # the endpoint, then callers, resources and sharers: of an id the first is shown
    own = F.struct(F.when(c("_o") == 1, caller).otherwise(resource).alias("id"), "_o", c("name").alias("label"), c("kind").alias("type"))
    sharer = F.transform(F.coalesce("_others", F.array().cast("array<string>")), lambda x: F.struct(
        F.concat(F.lit("api:"), x).alias("id"), F.lit(4).cast("byte").alias("_o"), none.alias("label"), none.alias("type")))
    told = dealt.select(*scope, "center", "_part", F.inline(F.when(c("_o") == 4, sharer).when(c("_others").isNull(), F.array(own)).otherwise(F.concat(F.array(own), sharer))))
    best = told.groupBy(*scope, "center", "_part", "id").agg(F.min(F.struct("_o", "label", "type")).alias("_n"))
    shares = c("_n._o") == 4
    # what a sharer shows is read from its id
    nodes = best.select(*scope, "center", "id", F.when(shares, F.substring_index(F.expr("substring(id, 5)"), " (", 1)).otherwise(c("_n.label")).alias("label"),
                        F.when(shares, F.lit("related_endpoint")).otherwise(c("_n.type")).alias("type"))
    into = F.when(c("type") == "service_call", "calls this API").otherwise("routes to")
    links = [
        call.join(ids, [*scope, "center"]).select(*scope, "center", c("id").alias("source"), c("_id").alias("target"), into.alias("kind"), "detail"),
        res.join(ids, [*scope, "center"]).select(*scope, "center", c("_id").alias("source"), c("id").alias("target"),
                                                 F.lower(F.coalesce("operation", F.lit("uses"))).alias("kind"), "detail"),
        near.select(*scope, "center", F.concat(F.lit("api:"), "other").alias("source"), c("resource").alias("target"), F.lit("shares").alias("kind"),
                    F.lit("").alias("detail")),
    ]
    return nodes, reduce(DataFrame.unionByName, links)
