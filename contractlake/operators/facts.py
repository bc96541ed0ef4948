"""Classification of libraries, types and calls, and the facts endpoints inherit from their call chain."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.core import first_match, first_non_empty, non_empty, rule_array
from ..session import cut_lineage
from .graph import lookup
from .relations import ant_regex, match_patterns

# ---------------------------------------------------------------- classification


def classify_library(group: Column, artifact: Column, catalog: Sequence[tuple] = rules.LIBRARY_CATALOG) -> Column:
    """First catalogue entry (category, technology) of a dependency, or NULL.

    Needles with a separator match anywhere in group:artifact, single words the start of a name part.
    """
    name = F.lower(F.coalesce(artifact, F.lit("")))
    key = F.concat(F.lower(F.coalesce(group, F.lit(""))), F.lit(":"), name)
    # every name part with one mark before it, so that the start of a part is a plain search
    parts = F.concat(F.lit("-"), F.translate(name, ".:_", "---"))
    # plain searches, all in one expression: its texts are lower-cased once a row, and the first entry that hits has the least number
    found = [F.when(key.contains(needle) if re.search("[-:.]", needle) else parts.contains(f"-{needle}"), i) for i, (needle, _, _) in enumerate(catalog)]
    return F.get(rule_array(catalog, ["needle", "category", "technology"]), F.least(*found, F.lit(None).cast("int")))


def classify_stereotype(df: DataFrame) -> DataFrame:
    """Adds stereotype and layer; the first rule that fits wins.

    Reads annotations ARRAY, kind, name, ancestors ARRAY (reference names), xml_mapper, mapstruct, listens, n_fields, plain_methods.
    """
    has = lambda a: F.array_contains("annotations", a)
    entries = rule_array(rules.STEREOTYPES, ["annotation", "stereotype", "layer"])
    by_annotation = first_match(entries, lambda r: F.array_contains(F.col("annotations"), r["annotation"]))
    made = lambda s, layer: F.struct(F.lit(s).alias("stereotype"), F.lit(layer).alias("layer"))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    inherits = lambda names: F.arrays_overlap("ancestors", F.array(*[F.lit(n) for n in names]))
    suffix = F.col("name").rlike("(" + "|".join(rules.DTO_SUFFIXES) + ")$")
    picked = (F.when(flag("xml_mapper"), made("repository", "data"))
              .when(flag("mapstruct") & has("Mapper"), made("mapper", "service"))
              .when((by_annotation["stereotype"] == "controller") & has("ResponseBody"), made("rest_controller", "web"))
              .when(by_annotation.isNotNull(), F.struct(by_annotation["stereotype"].alias("stereotype"), by_annotation["layer"].alias("layer")))
              .when((F.col("kind") == "interface") & inherits(rules.REPOSITORY_BASES), made("repository", "data"))
              .when(flag("listens"), made("message_listener", "integration"))
              .when(F.col("kind") == "enum", made("enum", "domain")).when(F.col("kind") == "annotation", made("annotation", "other"))
              .when(F.col("name").isin("Exception", "RuntimeException") | inherits(("Exception", "RuntimeException")) | F.col("name").endswith("Exception"), made("exception", "domain"))
              .when(F.col("kind").isin("class", "record") & (F.col("n_fields") > 0) & (F.col("plain_methods") == 0), made("dto", "domain"))
              .when(suffix, made("dto", "domain")).otherwise(made("class", "other")))
    return df.withColumn("_s", picked).select("*", "_s.stereotype", "_s.layer").drop("_s")


# Method-name prefixes of repository calls, tried in this order.
WRITE_NAMES = "^(save|insert|persist|merge|update|upsert|create|store|add|flush)"
DELETE_NAMES = "^(delete|remove|purge|truncate)"
READ_NAMES = "^(find|get|read|query|search|stream|count|exists|load|fetch|list|select|lookup|retrieve)"
REDIS_READS = "^(get|has|members|range|size|keys|exists|entries|values|ismember|scan|multiget|rank|score|index)"
REDIS_DELETES = "^(delete|remove|pop|expire|unlink|evict|invalidate|trim|left pop|rightpop|leftpop)"


def op_from_name(name: Column) -> Column:
    return F.when(name.rlike(WRITE_NAMES), "WRITE").when(name.rlike(DELETE_NAMES), "DELETE").when(name.rlike(READ_NAMES), "READ").otherwise("CALL")


def cache_op_from_name(name: Column) -> Column:
    n = F.lower(name)
    return F.when(n.rlike(REDIS_READS), "READ").when(n.rlike(REDIS_DELETES), "DELETE").otherwise("WRITE")


# ---------------------------------------------------------------- SQL texts

# Where a statement names its tables.
TABLE_POSITION = r"(?i)\b(?:FROM|JOIN|INTO|UPDATE|MERGE INTO|TRUNCATE TABLE|TABLE)\s+([\w.\"`\[\]]+)"
FROM_POSITION = r"(?i)\bFROM\s+([\w.\"`\[\]]+)"
NO_TABLES = ("SELECT", "WHERE", "SET", "VALUES", "(")


def sql_operation(sql: Column) -> Column:
    """READ, WRITE, DELETE, CALL or QUERY by the first word; NULL for an empty text."""
    first = F.upper(F.regexp_extract(sql, r"^\s*(\S+)", 1))
    return F.when(F.coalesce(first, F.lit("")) == "", None).otherwise(lookup(rules.SQL_OPERATIONS, first, "QUERY"))


def sql_tables(sql: Column) -> Column:
    """Distinct table names in order. Joins along an entity path (o.items) are no tables."""
    text = F.coalesce(sql, F.lit(""))
    after_from = F.regexp_extract_all(text, F.lit(FROM_POSITION), F.lit(1))
    names = F.transform(F.regexp_extract_all(text, F.lit(TABLE_POSITION), F.lit(1)), lambda n: F.regexp_replace(n, "^[\"`\\[\\]]+|[\"`\\[\\]]+$", ""))
    path_join = lambda n: n.rlike(r"^[a-z]\w*\.\w+$") & ~F.exists(after_from, lambda f: F.lower(f).startswith(F.lower(n)))
    return F.array_distinct(F.filter(names, lambda n: ~path_join(n) & ~F.upper(n).isin(*NO_TABLES)))


def snake_case(name: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(name, "([A-Z])", "_$1"), "^_", ""))


def decapitalized(name: Column) -> Column:
    return F.concat(F.lower(F.substring(name, 1, 1)), F.substr(name, F.lit(2)))


def default_table(name: Column, store: Column) -> Column:
    """Table of an entity without a declared one: document stores keep the name, others use snake case."""
    return F.when(store.isin("mongodb", "redis", "elasticsearch", "couchbase"), decapitalized(name)).otherwise(snake_case(name))


def entity_table(refs: DataFrame, entities: DataFrame, keys: Sequence[str], scope: Sequence[str] = ()) -> DataFrame:
    """Adds `table`: of the entity a name refers to (by entity or declared name) within its `scope`, else the name itself.

    entities(name, declared_name, table, store, pos); a table left empty follows the naming rule.
    """
    table = first_non_empty("table", default_table(first_non_empty("declared_name", "name"), F.col("store")))
    names = F.array_distinct(F.filter(F.array("name", "declared_name"), lambda n: n.isNotNull()))
    known = entities.select(*scope, F.explode(names).alias("ref"), table.alias("_table"), "pos")
    one = known.groupBy(*scope, "ref").agg(F.min_by("_table", F.struct("pos", "_table")).alias("_table"))
    return refs.join(one, [*scope, "ref"], "left").withColumn("table", F.coalesce("_table", "ref")).drop("_table")


# ---------------------------------------------------------------- call facts

def data_access_facts(calls: DataFrame, repositories: DataFrame, queries: DataFrame) -> DataFrame:
    """Database facts of calls: (call, method, technology, operation, tables, repository).

    calls(call, method, receiver_kind, target, name, sql, entity_table), repositories(target, repository, store, table),
    queries(target, name, sql_operation, sql_tables). A declared query decides; else the method name and the entity's table.
    """
    repo = calls.join(repositories, "target").join(queries, ["target", "name"], "left")
    tables = F.coalesce(F.when(F.size("sql_tables") > 0, F.col("sql_tables")), F.when(F.col("table").isNotNull(), F.array("table")))
    by_repo = repo.select("call", "method", F.col("store").alias("technology"), F.coalesce("sql_operation", op_from_name(F.col("name"))).alias("operation"),
                          tables.alias("tables"), "repository")
    direct = calls.where("receiver_kind IN ('jdbc', 'jpa_entity_manager', 'hibernate_session', 'mongo_template', 'r2dbc', 'dynamodb')")
    kind, name = F.col("receiver_kind"), F.col("name")
    is_sql = ((kind == "jdbc") & name.rlike("^(sql$|query|update|batchUpdate|execute)")) | (kind.isin("jpa_entity_manager", "hibernate_session") & name.isin("createQuery", "createNativeQuery"))
    is_entity = kind.isin("jpa_entity_manager", "hibernate_session") & name.isin("persist", "merge", "remove", "find", "getReference", "refresh", "detach")
    writes = name.rlike("^(update|batch)")
    operation = (F.when(is_sql & (kind == "jdbc") & F.col("sql").isNull() & name.startswith("update"), "WRITE")
                 .when(is_sql & (kind == "jdbc"), F.coalesce(sql_operation(F.col("sql")), F.when(writes, "WRITE").otherwise("READ")))
                 .when(is_sql, sql_operation(F.col("sql")))
                 .when(is_entity, F.when(name.isin("persist", "merge"), "WRITE").when(name == "remove", "DELETE").otherwise("READ"))
                 .when(kind == "mongo_template", op_from_name(F.when(name.startswith("aggregate"), "find").otherwise(name)))
                 .when(kind.isin("r2dbc", "dynamodb"), op_from_name(name)))
    used = is_sql | is_entity | kind.isin("mongo_template", "r2dbc", "dynamodb")
    technology = F.when(kind.isin("jpa_entity_manager", "hibernate_session"), "jpa").when(kind == "mongo_template", "mongodb").otherwise(kind)
    named = F.when(is_sql, sql_tables(F.col("sql"))).when(F.col("entity_table").isNotNull(), F.array("entity_table"))
    by_client = direct.where(used).select("call", "method", technology.alias("technology"), operation.alias("operation"), named.alias("tables"),
                                          F.lit(None).cast("string").alias("repository"))
    return by_repo.unionByName(by_client)


def message_facts(calls: DataFrame) -> DataFrame:
    """Published messages: (call, method, technology, destination). calls(call, method, receiver_kind, name, args ARRAY)."""
    entries = rule_array(rules.MESSAGE_CALLS, ["kind", "pattern", "technology", "arg", "least"])
    rule = first_match(entries, lambda r: (r["kind"] == F.col("receiver_kind")) & F.rlike(F.col("name"), r["pattern"]))
    rows = calls.withColumn("_r", rule).where("_r IS NOT NULL")
    given = F.size("args")
    # with three and more arguments the first is the exchange, with two it is the routing key: both name the destination
    destination = F.when(given >= F.col("_r.least"), F.get("args", F.col("_r.arg")))
    fallback = F.when(F.col("name") == "sendDefault", "<default topic>")
    destination = F.when(F.col("name") == "sendDefault", fallback).otherwise(destination)
    return rows.select("call", "method", F.col("_r.technology").alias("technology"), destination.alias("destination"))


def cache_facts(calls: DataFrame) -> DataFrame:
    """Cache accesses: (call, method, technology, operation, name).

    calls(call, method, receiver_kind, first_name, name, args ARRAY); a chain that starts with a template
    setter is setup and no access.
    """
    kind, name = F.col("receiver_kind"), F.col("name")
    setup = (kind == "redis") & F.col("first_name").rlike("^set|^afterPropertiesSet$|^get.*(Serializer|ConnectionFactory)$")
    rows = calls.where(kind.isin("redis", "cache_manager", "hazelcast", "local_cache") & ~setup & ~((kind == "redis") & name.isin("convertAndSend", "publish")))
    technology = F.when(kind == "cache_manager", "spring-cache").otherwise(kind)
    evicts = (kind == "cache_manager") & name.isin("evict", "clear", "invalidate", "evictIfPresent")
    return rows.select("call", "method", technology.alias("technology"), F.when(evicts, "EVICT").otherwise(cache_op_from_name(name)).alias("operation"),
                       F.get("args", F.lit(0)).alias("name"))


def event_facts(calls: DataFrame) -> DataFrame:
    """In-process events: (call, method, event_type)."""
    return calls.where((F.col("receiver_kind") == "event") & (F.col("name") == "publishEvent") & (F.size("args") > 0)).select(
        "call", "method", F.get("args", F.lit(0)).alias("event_type"))


def storage_facts(calls: DataFrame) -> DataFrame:
    """Object storage and mail: (call, method, kind, technology, operation, bucket)."""
    k = lookup(rules.GENERIC_CLIENTS, F.col("receiver_kind"))
    rows = calls.withColumn("kind", k).where("kind IN ('storage', 'search') OR (kind = 'email' AND name LIKE 'send%')")
    n = F.lower("name")
    stored = F.when(n.rlike("get|list|download|head"), "READ").when(n.contains("delete"), "DELETE").otherwise("WRITE")
    return rows.select("call", "method", "kind", F.col("receiver_kind").alias("technology"),
                       F.when(F.col("kind") == "storage", stored).when(F.col("kind") == "search", op_from_name(F.col("name"))).alias("operation"),
                       F.when(F.col("kind") == "storage", F.get("args", F.lit(0))).alias("bucket"))


def http_facts(calls: DataFrame, apps: DataFrame, base_urls: DataFrame, feign: DataFrame) -> DataFrame:
    """HTTP calls: (call, method, client, http_method, url, host, target_service, target_module).

    calls(call, method, module, receiver_kind, bean, target, name, verb, args), apps(app, module), base_urls(module, client, bean, base_url),
    feign(target, name, service, url, http_method, path, target_module).
    """
    kind = F.col("receiver_kind")
    template_verb = lookup(rules.REST_TEMPLATE_VERBS, F.col("name"))
    by_template = calls.where((kind == "rest_template") & (template_verb.isNotNull() | F.col("name").isin("exchange", "execute"))).select(
        "call", "method", "module", "bean", F.lit("rest_template").alias("client"), F.coalesce(template_verb, "verb").alias("http_method"), F.get("args", F.lit(0)).alias("url"))
    fluent = calls.where(kind.isin("web_client", "rest_client", "java_http_client", "okhttp")).select(
        "call", "method", "module", "bean", kind.alias("client"), F.upper("verb").alias("http_method"), F.get("args", F.lit(0)).alias("url"))
    plain = by_template.unionByName(fluent).where("http_method IS NOT NULL OR url IS NOT NULL")
    with_base = plain.join(client_base(base_urls, plain), "call", "left")
    relative = F.col("client").isin("web_client", "rest_client") & ~F.coalesce(F.col("url").rlike(r"^\w+://"), F.lit(False))
    target = F.when(relative, F.col("base_url")).otherwise(F.col("url"))
    direct = url_target(with_base.withColumn("_t", target), "_t", apps).select("call", "method", "client", "http_method", "url", "host", "target_service", "target_module")
    f = calls.join(feign, ["target", "name"])
    whole = F.when(non_empty("url").isNotNull(), F.concat(F.regexp_replace("url", "/+$", ""), F.coalesce("path", F.lit("")))).otherwise(F.col("path"))
    named = f.select("call", "method", F.lit("feign").alias("client"), "http_method", whole.alias("url"), F.col("url").alias("_given"), "service",
                     F.col("target_module").alias("_module"))
    explicit = url_target(named.where("_given IS NOT NULL AND _given <> ''"), "_given", apps)
    implicit = named.where("_given IS NULL OR _given = ''").withColumn("host", F.lit(None).cast("string")).withColumn(
        "target_service", F.col("service")).withColumn("target_module", F.col("_module"))
    cols = ["call", "method", "client", "http_method", "url", "host", "target_service", "target_module"]
    return direct.select(*cols).unionByName(explicit.select(*cols)).unionByName(implicit.select(*cols))


def client_base(base_urls: DataFrame, calls: DataFrame) -> DataFrame:
    """Base URL of a call's client: by bean name, else the only one of its module and client."""
    only = base_urls.groupBy("module", "client").agg(F.count("*").alias("_n"), F.min("base_url").alias("_only")).where("_n = 1")
    by_bean = base_urls.groupBy("module", "client", F.lower("bean").alias("_bean")).agg(F.min("base_url").alias("_named"))  # of several the least, so that reruns agree
    rows = calls.select("call", "module", "client", F.lower("bean").alias("_bean"))
    return (rows.join(by_bean, ["module", "client", "_bean"], "left").join(only, ["module", "client"], "left")
            .select("call", F.coalesce("_named", "_only").alias("base_url")))


# Scheme, host and port of a URL text.
URL_TARGET = r"^(?:(\w+)://)?(\{[^}]+\}|[^/{}:]+)(?::(\d+))?"


def url_target(df: DataFrame, url: str, apps: DataFrame) -> DataFrame:
    """Adds host, target_service and target_module of a URL; without a scheme nothing is known.

    A host that is an application's name means its module, `lb://` hosts are services. apps(app, module).
    """
    scheme = non_empty(F.regexp_extract(url, URL_TARGET, 1))
    host = F.when(scheme.isNotNull(), F.regexp_extract(url, URL_TARGET, 2))
    known = apps.groupBy(F.col("app").alias("host")).agg(F.min("module").alias("target_module"))
    out = df.withColumn("host", host).withColumn("_scheme", scheme).join(known, "host", "left")
    service = F.when(F.col("target_module").isNotNull() | (F.col("_scheme") == "lb"), F.col("host"))
    return out.withColumn("target_service", service).drop("_scheme")


# ---------------------------------------------------------------- endpoint roll-ups

# Group of a fact kind in an endpoint record.
FACT_GROUPS = {
    "database": "databases", "cache": "caches", "messaging": "messaging", "http": "external_apis", "event": "events", "email": "email",
    "storage": "storage", "search": "search", "transaction": "transactions", "async": "async", "resilience": "resilience",
}


def endpoint_facts(closure: DataFrame, facts: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Distinct facts of every method an endpoint reaches: (endpoint, grp, fields), with the depth of the first sighting if the closure has depths.

    closure(origin, node[, depth]) with the handler itself at depth 0; facts(method, kind, fields).
    Facts are reduced to distinct rows before they meet the closure. Methods that the same endpoints reach (at the same depths) form a class, told by a count and
    two sums of hashes: the facts of a class are reduced once, and only then met by its endpoints, read from one of its methods.
    """
    grouped = facts.withColumn("grp", lookup(FACT_GROUPS, F.col("kind"), "other")).select("method", "grp", *fields).distinct()
    depth = [c for c in closure.columns if c == "depth"]
    seen = closure.select(F.col("origin").alias("endpoint"), F.col("node").alias("method"), *depth).distinct()
    mark = lambda salt: F.sum(F.xxhash64("endpoint", *depth, F.lit(salt)).cast("decimal(38,0)")).alias(f"_h{salt}")
    classes = seen.where("method IS NOT NULL").groupBy("method").agg(F.count(F.lit(1)).alias("_n"), mark(1), mark(2))
    first = classes.groupBy("_n", "_h1", "_h2").agg(F.min("method").alias("_class"))
    of = cut_lineage(classes.join(first, ["_n", "_h1", "_h2"]).select("method", "_class"))
    own = grouped.join(of.hint("merge"), "method").select("_class", "grp", *fields).distinct()
    ends = seen.join(of.select(F.col("_class").alias("method")).distinct(), "method", "left_semi").withColumnRenamed("method", "_class")
    rows = own.join(ends, "_class").drop("_class").select("endpoint", "grp", *fields, *depth)
    return rows.groupBy("endpoint", "grp", *fields).agg(*[F.min(d).alias(d) for d in depth]) if depth else rows.distinct()


def endpoint_status_codes(declared: DataFrame, own: DataFrame, deeper: DataFrame, exceptions: DataFrame, validated: DataFrame, endpoints: DataFrame) -> DataFrame:
    """(endpoint, code, source) of the five origins, with 200 where no success code is known.

    declared(endpoint, code), own(endpoint, code, source), deeper(endpoint, code, source, label),
    exceptions(endpoint, code, exception, mapped_by), validated(endpoint), endpoints(endpoint).
    """
    c = F.col
    rows = (declared.select("endpoint", "code", F.lit("@ResponseStatus").alias("source"))
            .unionByName(own.select("endpoint", "code", "source"))
            .unionByName(deeper.where("code >= 400").select("endpoint", "code", F.concat("source", F.lit(" in "), "label").alias("source")))
            .unionByName(exceptions.where("code IS NOT NULL").select("endpoint", "code", F.concat("exception", F.lit(" ("), F.coalesce("mapped_by", F.lit("mapping")), F.lit(")")).alias("source")))
            .unionByName(validated.select("endpoint", F.lit(400).alias("code"), F.lit("bean validation").alias("source")))).distinct()
    good = rows.where(c("code").between(200, 299)).select("endpoint").distinct()
    default = endpoints.select("endpoint").distinct().join(good, "endpoint", "left_anti").select("endpoint", F.lit(200).alias("code"), F.lit("default").alias("source"))
    return rows.unionByName(default)


def exception_mapping(thrown: DataFrame, mappings: DataFrame, ancestors: DataFrame, keys: Sequence[str] = ("endpoint",)) -> DataFrame:
    """(keys, exception, status, mapped_by) of thrown exceptions; what nothing maps is a 500.

    thrown(keys, controller, exception), mappings(exception, status, handler, is_global, pos), ancestors(exception, ancestor, depth)
    with every declared parent, indexed or not. Order: own or nearest ancestor mapping that is global
    or of this controller, framework default of a parent, of the exception, then a mapping of the same simple name.
    """
    keys = list(keys)
    simple = lambda c: F.substring_index(c, ".", -1)
    known = rule_array(list(rules.KNOWN_EXCEPTION_STATUS.items()), ["name", "status"])
    default = lambda c: first_match(known, lambda r: r["name"] == c)["status"]
    t = thrown.select(*keys, "controller", "exception").distinct()
    line = t.withColumn("ancestor", F.col("exception")).withColumn("depth", F.lit(0)).unionByName(t.join(ancestors, "exception").select(*keys, "controller", "exception", "ancestor", "depth"))
    m = mappings.select(F.col("exception").alias("ancestor"), "status", "handler", "is_global", "pos")
    fits = F.col("is_global") | (F.substring_index("handler", ".", 1) == F.col("controller"))
    mapped = line.join(m, "ancestor").where(fits).select(*keys, "controller", "exception", "status", F.col("handler").alias("mapped_by"), F.col("depth").alias("_rank"), F.lit(0).alias("_tier"), "pos")
    framework = F.lit("spring-default")
    parents = line.where("depth > 0").withColumn("status", default(simple("ancestor"))).where("status IS NOT NULL").select(
        *keys, "controller", "exception", "status", framework.alias("mapped_by"), F.col("depth").alias("_rank"), F.lit(1).alias("_tier"), F.lit(0).cast("long").alias("pos"))
    itself = t.withColumn("status", default(simple("exception"))).where("status IS NOT NULL").select(
        *keys, "controller", "exception", "status", framework.alias("mapped_by"), F.lit(0).alias("_rank"), F.lit(2).alias("_tier"), F.lit(0).cast("long").alias("pos"))
    by_simple = mappings.groupBy(simple("exception").alias("_simple")).agg(F.min_by(F.struct("status", "handler"), F.struct("pos", "exception")).alias("_m"))
    named = t.withColumn("_simple", simple("exception")).join(by_simple, "_simple").select(
        *keys, "controller", "exception", F.col("_m.status").alias("status"), F.col("_m.handler").alias("mapped_by"), F.lit(0).alias("_rank"), F.lit(3).alias("_tier"), F.lit(0).cast("long").alias("pos"))
    unhandled = t.select(*keys, "controller", "exception", F.lit(500).alias("status"), F.lit("unhandled").alias("mapped_by"), F.lit(0).alias("_rank"), F.lit(4).alias("_tier"), F.lit(0).cast("long").alias("pos"))
    rows = mapped.withColumn("pos", F.col("pos").cast("long"))
    for part in (parents, itself, named, unhandled):
        rows = rows.unionByName(part)
    best = rows.groupBy(*keys, "controller", "exception").agg(F.min_by(F.struct("status", "mapped_by"), F.struct("_tier", "_rank", "pos")).alias("b"))
    return best.select(*keys, "controller", "exception", "b.status", "b.mapped_by")


def security_rule(endpoints: DataFrame, url_rules: DataFrame, scope: Sequence[str] = ("module",)) -> DataFrame:
    """First URL rule of the module whose verb and one pattern fit: endpoint columns plus rule (NULL when none).

    endpoints(endpoint, module, method, path), url_rules(module, rule, ord, http_method, patterns ARRAY). Path variables are
    also tried as a literal part.
    """
    patterns = url_rules.select(*scope, "rule", "ord", "http_method", F.explode("patterns").alias("_pattern")).withColumn("_regex", ant_regex(F.col("_pattern")))
    plain = F.regexp_replace("path", r"\{[^}]+\}", "x")
    paths = endpoints.select(*scope, "endpoint", "method", F.explode(F.array_distinct(F.array(F.col("path"), plain))).alias("_path"))
    found = match_patterns(paths, patterns, scope, "_path", "_pattern", "_regex").where("http_method IS NULL OR method = http_method OR method = 'ANY'")
    first = found.groupBy(*scope, "endpoint").agg(F.min_by("rule", "ord").alias("rule"))
    return endpoints.join(first, [*scope, "endpoint"], "left")


# ---------------------------------------------------------------- endpoints and parameters

def join_path(base: Column, path: Column) -> Column:
    parts = F.filter(F.transform(F.array(base, path), lambda p: F.regexp_replace(F.coalesce(p, F.lit("")), "^/+|/+$", "")), lambda p: p != "")
    return F.concat(F.lit("/"), F.array_join(parts, "/"))


def endpoints_from_mappings(controllers: DataFrame, methods: DataFrame) -> DataFrame:
    """base paths x paths x verbs: (controller, handler, method, path), one row per endpoint and path.

    controllers(controller, base_paths ARRAY), methods(controller, handler, annotation, paths ARRAY, verbs ARRAY).
    """
    fixed = lookup({k: v for k, v in rules.MAPPING_VERBS.items() if v}, F.col("annotation"))
    given = F.when(F.size("verbs") > 0, F.col("verbs")).otherwise(F.array(F.lit("ANY")))
    verbs = F.when(fixed.isNotNull(), F.array(fixed)).otherwise(given)
    some = lambda c: F.when(F.size(c) > 0, F.col(c)).otherwise(F.array(F.lit("")))
    rows = methods.where(F.col("annotation").isin(*rules.MAPPING_VERBS)).join(controllers, "controller")
    return (rows.select("controller", "handler", F.explode(verbs).alias("method"), some("base_paths").alias("_b"), some("paths").alias("_p"))
            .select("controller", "handler", "method", F.explode("_b").alias("_b"), "_p").select("controller", "handler", "method", "_b", F.explode("_p").alias("_p"))
            .select("controller", "handler", "method", join_path(F.col("_b"), F.col("_p")).alias("path")))


def inherited_mappings(methods: DataFrame, mappings: DataFrame, supers: DataFrame) -> DataFrame:
    """The mapping of a handler, from itself or the nearest supertype method of the same name and arity.

    methods(method, owner, name, n_params), mappings(owner, name, n_params, annotation), supers(type, ancestor, depth).
    """
    line = methods.select("method", "owner", "name", "n_params", F.lit(0).alias("depth")).unionByName(
        methods.withColumnRenamed("owner", "type").join(supers, "type").select("method", F.col("ancestor").alias("owner"), "name", "n_params", "depth"))
    found = line.join(mappings, ["owner", "name", "n_params"])
    return found.groupBy("method").agg(F.min_by(F.struct("annotation", "owner"), F.struct("depth", "owner")).alias("m")).select("method", "m.*")


def validation_rules(annotations: Column) -> Column:
    """Rule -> value of an ARRAY<STRUCT<name, args MAP>> of annotations; the last of equal rules wins."""
    entry = lambda k, v: F.struct(k.alias("key"), v.alias("value"))
    true = F.lit("true")

    def of(a):
        n, args = a["name"], a["args"]
        arg = lambda k: F.try_element_at(args, F.lit(k))
        keyed = lambda k: F.when(arg(k).isNotNull(), entry(F.lit(k), arg(k)))
        lower = F.concat(F.lower(F.substring(n, 1, 1)), F.substring(n, 2, 100))
        none = F.slice(F.array(entry(F.lit(""), true)), 1, 0)
        return (F.when(~n.isin(*rules.VALIDATION_ANNOTATIONS) | (n == "Valid"), none)
                .when(n == "NotBlank", F.array(entry(F.lit("notEmpty"), true), entry(F.lit("required"), true), entry(F.lit("notBlank"), true)))
                .when(n == "NotEmpty", F.array(entry(F.lit("notEmpty"), true), entry(F.lit("required"), true)))
                .when(n == "NotNull", F.array(entry(F.lit("required"), true)))
                .when(n.isin("Size", "Length"), F.filter(F.array(keyed("min"), keyed("max")), lambda e: e.isNotNull()))
                .when(n.isin("Min", "DecimalMin"), F.filter(F.array(F.when(arg("value").isNotNull(), entry(F.lit("minimum"), arg("value")))), lambda e: e.isNotNull()))
                .when(n.isin("Max", "DecimalMax"), F.filter(F.array(F.when(arg("value").isNotNull(), entry(F.lit("maximum"), arg("value")))), lambda e: e.isNotNull()))
                .when(n == "Pattern", F.array(entry(F.lit("pattern"), arg("regexp"))))
                .otherwise(F.array(entry(lower, true))))

    entries = F.flatten(F.transform(annotations, of))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["key"] == e["key"]))
    return F.map_from_entries(last)


def param_contract(params: DataFrame, enums: DataFrame, keys: Sequence[str]) -> DataFrame:
    """HTTP parameters of handlers: (keys, pos, sub, name, type, loc, required, default_value, validation).

    params(keys, pos, name, type, annotations ARRAY<STRUCT<name, args MAP>>), enums(type). Framework
    parameters vanish, a pageable one becomes three.
    """
    simple_name = F.regexp_extract("type", r"^([\w\[\]]+)", 1)
    is_enum = F.col("_enum").isNotNull()
    rows = params.withColumn("_simple", simple_name).join(enums.select(F.col("type").alias("_simple"), F.lit(True).alias("_enum")).distinct(), "_simple", "left")
    named = lambda n: F.exists("annotations", lambda a: a["name"] == n)
    framework = F.col("_simple").isin(*rules.FRAMEWORK_PARAM_TYPES)
    for n in rules.FRAMEWORK_PARAM_ANNOTATIONS:
        framework = framework | named(n)
    rows = rows.where(~framework)
    locations = rule_array(rules.PARAM_LOCATIONS, ["annotation", "loc"])
    rule = first_match(locations, lambda r: F.exists(F.col("annotations"), lambda a: a["name"] == r["annotation"]))
    chosen = F.get(F.filter("annotations", lambda a: a["name"] == F.col("_rule.annotation")), F.lit(0))
    rows = rows.withColumn("_rule", rule).withColumn("_args", chosen["args"])
    arg = lambda k: F.try_element_at("_args", F.lit(k))
    wrapped = F.regexp_extract("type", r"^Optional<(\w+)>", 1)
    is_simple = F.col("_simple").isin(*rules.SIMPLE_TYPES) | wrapped.isin(*rules.SIMPLE_TYPES) | is_enum
    pageable = F.col("_rule").isNull() & (F.col("_simple") == "Pageable")
    loc = F.coalesce(F.col("_rule.loc"), F.when(is_simple, "query").otherwise("model"))
    explicit = F.coalesce(non_empty(arg("name")), non_empty(arg("value")))
    name = F.when(explicit.isNotNull() & (loc != "body"), explicit).otherwise(F.col("name"))
    optional = F.coalesce(arg("required") == "false", F.lit(False)) | arg("defaultValue").isNotNull() | (F.col("_simple") == "Optional")
    made = lambda n, t, l, r, d, v: F.struct(n.alias("name"), t.alias("type"), l.alias("loc"), r.alias("required"), d.alias("default_value"), v.alias("validation"))
    no_text, no_rules = F.lit(None).cast("string"), F.create_map().cast("map<string,string>")
    three = F.array(*[made(F.lit(n), F.lit(t), F.lit("query"), F.lit(False), no_text, no_rules) for n, t in rules.PAGEABLE_PARAMS])
    one = F.array(made(name, F.col("type"), loc, ~optional, arg("defaultValue"), validation_rules(F.col("annotations"))))
    return rows.select(*keys, "pos", F.posexplode(F.when(pageable, three).otherwise(one)).alias("sub", "p")).select(*keys, "pos", "sub", "p.*")


def feign_operations(clients: DataFrame, methods: DataFrame, apps: DataFrame) -> DataFrame:
    """(client, name, http_method, path, service, target_module) of declared HTTP clients.

    clients(client, service, base_path, mapping_path), methods(client, name, annotation, verb, path, request_line).
    """
    line = F.coalesce("request_line", F.lit(""))
    fixed = lookup({k: v for k, v in rules.MAPPING_VERBS.items() if v}, F.col("annotation"))
    verb = F.when(F.col("annotation").isNotNull(), F.coalesce(fixed, "verb", F.lit("ANY"))).otherwise(non_empty(F.substring_index(line, " ", 1)))
    path = F.when(F.col("annotation").isNotNull(), F.coalesce("path", F.lit(""))).otherwise(F.regexp_extract(line, "^[^ ]+ (.*)$", 1))
    base = F.concat(F.coalesce("base_path", F.lit("")), F.coalesce("mapping_path", F.lit("")))
    rows = methods.join(clients, "client").withColumn("http_method", verb).where("http_method IS NOT NULL")
    known = apps.groupBy(F.col("app").alias("service")).agg(F.min("module").alias("target_module"))
    return rows.select("client", "name", "http_method", F.concat(base, path).alias("path"), "service").join(known, "service", "left")


def module_of_file(files: DataFrame, modules: DataFrame, path: str = "path", scope: Sequence[str] = ()) -> DataFrame:
    """Adds `module`: the longest module directory that holds the file, '' for the root.

    Every leading directory of the path meets the module list through an equality join. modules(dir).
    """
    parts = F.split(path, "/")
    dirs = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    keys = [c for c in files.columns]
    # compressed tables look small to the optimizer: with these hints it sends neither the paths nor their modules through the driver
    known = modules.where("dir <> ''").select(*scope, F.col("dir").alias("_dir")).distinct()
    rows = files.select(*scope, path).distinct().withColumn("_dir", F.explode(dirs)).join(known.hint("merge"), [*scope, "_dir"])
    best = rows.groupBy(*scope, path).agg(F.max_by("_dir", F.length("_dir")).alias("module"))
    return files.join(best.hint("merge"), [*scope, path], "left").select(*keys, F.coalesce("module", F.lit("")).alias("module"))


def listener_topology(annotations: DataFrame) -> DataFrame:
    """Listener rows (method, technology, destination, group_id, payload_type, schedule) from method annotations.

    annotations(method, annotation, args MAP<STRING, ARRAY<STRING>>, payload_type).
    """
    arg = lambda k: F.try_element_at("args", F.lit(k))
    destinations = F.lit(None).cast("array<string>")
    technology = F.lit(None).cast("string")
    for name, tech, names in rules.LISTENER_RULES:
        hit = F.col("annotation") == name
        technology = F.when(hit, tech).otherwise(technology)
        destinations = F.when(hit, F.coalesce(*[arg(n) for n in names])).otherwise(destinations)
    events = F.col("annotation").isin("EventListener", "TransactionalEventListener")
    # without a declared event class the listener hears its parameter's type
    destinations = F.when(events & (F.size(F.coalesce(destinations, F.array().cast("array<string>"))) == 0), F.array("payload_type")).otherwise(destinations)
    listening = annotations.where(technology.isNotNull()).select(
        "method", technology.alias("technology"), F.explode_outer(destinations).alias("destination"),
        F.coalesce(F.get(arg("groupId"), F.lit(0)), F.get(arg("id"), F.lit(0))).alias("group_id"), "payload_type", F.lit(None).cast("string").alias("schedule"))
    times = F.array_join(F.filter(F.array(*[F.when(arg(k).isNotNull(), F.concat(F.lit(f"{k}="), F.get(arg(k), F.lit(0)))) for k in rules.SCHEDULE_KEYS]),
                                  lambda t: t.isNotNull()), ",")
    no = F.lit(None).cast("string")
    scheduled = annotations.where("annotation = 'Scheduled'").select("method", F.lit("schedule").alias("technology"), no.alias("destination"),
                                                                     no.alias("group_id"), "payload_type", times.alias("schedule"))
    return listening.unionByName(scheduled)
