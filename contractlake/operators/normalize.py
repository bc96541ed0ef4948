"""Route records in comparable form: flat fields, downstream entries, signatures and names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import non_empty, shown

# a producer nests schemas at most four levels deep, the fifth level holds their leaves
SCHEMA_LEVELS = 5

# One fact of each integration group.
DATABASE = "array<struct<operation:string,`table`:array<string>,entity:string,technology:string>>"
CACHE = "array<struct<operation:string,cache_names:array<string>,key:string,technology:string>>"
MESSAGE = "array<struct<direction:string,destination:string,technology:string,payload_type:string>>"
HTTP = "array<struct<http_method:string,url:string,target_service:string,host:string,client:string>>"
OTHER = "array<struct<event_type:string,bucket:string,technology:string>>"
INTEGRATIONS = (f"struct<databases:{DATABASE},caches:{CACHE},messaging:{MESSAGE},external_apis:{HTTP},"
                f"events:{OTHER},storage:{OTHER},email:{OTHER},search:{OTHER}>")


def _children(fields_json: Column, prefix: Column) -> Column:
    """Entries (path, json) of a field map; values that are no objects are skipped."""
    entries = F.map_entries(F.from_json(fields_json, "map<string,string>"))
    objects = F.filter(F.coalesce(entries, F.array().cast("array<struct<key:string,value:string>>")), lambda e: e["value"].startswith("{"))
    return F.transform(objects, lambda e: F.struct(F.concat(prefix, e["key"]).alias("path"), e["value"].alias("json")))


def _nested(json: Column) -> Column:
    """Field map below a field: of its schema, or of the items of an array schema."""
    is_array = F.get_json_object(json, "$.schema.type") == "array"
    below = F.when(is_array, F.get_json_object(json, "$.schema.items.fields")).otherwise(F.get_json_object(json, "$.schema.fields"))
    # leaves, most of all fields, are not parsed for a schema; its name may be written with escapes
    return F.when(json.contains('"schema"') | json.contains("\\u"), below)


def _flat_fields(fields_json: Column) -> Column:
    level = _children(fields_json, F.lit(""))
    levels = [level]
    for _ in range(SCHEMA_LEVELS - 1):
        level = F.flatten(F.transform(level, lambda e: _children(_nested(e["json"]), F.concat(e["path"], F.lit(".")))))
        levels.append(level)
    return F.concat(*levels)


def flatten_schema(df: DataFrame, keys: Sequence[str], fields: str = "fields") -> DataFrame:
    """Field map JSON as rows: keys, path, type, rules MAP, required. One row-wise expression over rows dealt out by their keys.

    `map` values are not descended, arrays one level.
    """
    # reading JSON is dear and its table may lie in one small file, which is one task
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.where(F.col(fields).isNotNull()).repartition(tasks, *keys).select(*keys, F.explode(_flat_fields(F.col(fields))).alias("f"))
    rules = F.coalesce(F.from_json(F.get_json_object("f.json", "$.validation"), "map<string,string>"), F.create_map().cast("map<string,string>"))
    required = ~F.coalesce(F.try_element_at("rules", F.lit("required")), F.lit("false")).isin("false", "0", "", "null")
    return (rows.select(*keys, "f.path", F.get_json_object("f.json", "$.type").alias("type"), rules.alias("rules")).withColumn("required", required))


def response_fields(df: DataFrame, keys: Sequence[str], schema: str = "schema") -> DataFrame:
    """Fields of a response schema; an array schema stands for its items."""
    s = F.col(schema)
    is_array = F.get_json_object(s, "$.type") == "array"
    fields = F.when(is_array, F.get_json_object(s, "$.items.fields")).when(s.startswith("{"), s)
    return flatten_schema(df.withColumn("_fields", fields), keys, "_fields").select(*keys, "path", "type")


def status_sets(statuses: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sorted success (< 300) and error (>= 400) codes per endpoint; HTTP codes are few."""
    pick = lambda cond: F.array_sort(F.collect_set(F.when(cond, F.col("code"))))
    real = (F.col("code").isNotNull()) & (F.col("code") != 0)
    return statuses.groupBy(*keys).agg(pick(real & (F.col("code") < 300)).alias("success"), pick(F.col("code") >= 400).alias("error"))


# ---------------------------------------------------------------- downstream systems

def downstream_entries(routes: DataFrame, keys: Sequence[str], integrations: str = "integrations") -> DataFrame:
    """What an endpoint reaches: keys, grp, item (display key), operation, name, technology; each item once.

    All groups come from one array per route (one row per route): no shuffle, no join.
    """
    r = routes.withColumn("i", F.from_json(integrations, INTEGRATIONS))
    entry = lambda grp, item, operation, name, technology: F.struct(
        F.lit(grp).alias("grp"), item.alias("item"), F.lower(F.coalesce(operation, F.lit(""))).alias("operation"), name.alias("name"),
        F.coalesce(technology, F.lit("")).alias("technology"))
    none = F.slice(F.array(entry("", F.lit(""), F.lit(""), F.lit(""), F.lit(""))), 1, 0)
    tech = lambda f: F.concat(F.lit(" ("), shown(f["technology"]), F.lit(")"))

    def database(f):
        tables = F.when(F.size(f["table"]) > 0, f["table"]).otherwise(F.array(F.coalesce(non_empty(f["entity"]), F.lit("?"))))
        return F.transform(tables, lambda t: entry("databases", F.concat(shown(f["operation"]), F.lit(" "), t, tech(f)), f["operation"], t, f["technology"]))

    def cache(f):
        name = F.coalesce(non_empty(F.array_join(F.coalesce(f["cache_names"], F.array().cast("array<string>")), ", ")), non_empty(f["key"]), f["technology"])
        return entry("caches", F.concat(shown(f["operation"]), F.lit(" "), shown(name), tech(f)), f["operation"], name, f["technology"])

    def message(f):
        return entry("messaging", F.concat(shown(f["direction"]), F.lit(" "), shown(f["destination"]), tech(f)), f["direction"], shown(f["destination"]), f["technology"])

    def http(f):
        target = F.coalesce(non_empty(f["target_service"]), non_empty(f["host"]))
        line = F.trim(F.concat(F.coalesce(f["http_method"], F.lit("")), F.lit(" "), F.coalesce(f["url"], F.lit(""))))
        item = F.concat(line, F.when(target.isNotNull(), F.concat(F.lit(" → "), target)).otherwise(""))
        return entry("external_apis", item, f["http_method"], F.coalesce(target, non_empty(f["url"]), F.lit("unresolved")), F.when(target.isNotNull(), f["url"]))

    def other(group, operation):
        def make(f):
            name = F.coalesce(non_empty(f["event_type"]), non_empty(f["bucket"]), f["technology"])
            return entry("other", F.concat(F.lit(f"{group}: "), shown(name)), F.lit(operation), name,
                         F.when(~name.eqNullSafe(f["technology"]), f["technology"]))
        return make

    some = lambda c, f: F.coalesce(F.transform(c, f), none)
    lists = [F.coalesce(F.flatten(F.transform("i.databases", database)), none), some("i.caches", cache), some("i.messaging", message), some("i.external_apis", http)]
    rest = F.concat(some("i.events", other("events", "event")), some("i.storage", other("storage", "storage")),
                    some("i.email", other("email", "email")), some("i.search", other("search", "search")))
    # only these items can repeat with another technology: the last one stays
    rest = F.filter(rest, lambda e, i: ~F.exists(F.slice(rest, i + 2, F.size(rest)), lambda later: later["item"] == e["item"]))
    return r.select(*keys, F.explode(F.array_distinct(F.concat(*lists, rest))).alias("e")).select(*keys, "e.*")


# ---------------------------------------------------------------- signatures and names

def contract_signature(routes: DataFrame) -> Column:
    """MD5 over method, path, sorted parameters, errors and codes, and the response when there is one.

    Order of lists and status sources do not matter; access rules and downstream systems are no part
    of the contract, so a change of those alone makes no new version.
    """
    have = lambda c: c in routes.columns
    part = lambda c: F.coalesce(c.cast("string"), F.lit("\u0000"))
    as_list = lambda c: F.to_json(F.array_sort(F.transform(c, lambda x: F.to_json(F.struct(x.alias("v"))))))
    params = as_list(F.coalesce(F.col("params"), F.array())) if have("params") else F.lit("")
    empty = F.array().cast("array<string>")
    codes = F.transform(F.array_distinct(F.coalesce(F.col("status_codes.code"), F.array().cast("array<int>"))), lambda c: c.cast("string")) if have("status_codes") else empty
    errors = F.coalesce(F.col("errors"), empty) if have("errors") else empty
    statuses = F.to_json(F.array_sort(F.concat(errors, codes)))
    response = F.lit("")
    if have("response"):
        body, schema = F.col("response.body_type"), F.col("response.schema")
        response = F.when(non_empty(body).isNotNull() | non_empty(schema).isNotNull(), F.concat_ws("\u0001", part(body), part(schema))).otherwise("")
    return F.md5(F.concat_ws("\u0002", part(F.col("method")), part(F.col("path")), params, statuses, response))


def parameter_signature(params: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Order-free signature of long parameter rows: sums of two row hashes, so a hot endpoint is combined map-side."""
    row = F.to_json(F.struct(*values), {"ignoreNullFields": "false"})
    h, other = F.xxhash64(row), F.hash(row).cast("long")
    distinct = params.select(*keys, *values).distinct()
    return distinct.groupBy(*keys).agg(F.md5(F.concat_ws("|", F.count("*").cast("string"), F.bit_xor(h).cast("string"), F.sum(other).cast("string"))).alias("signature"))


def normalize_doc_name(endpoints: DataFrame, keys: Sequence[str] = ("module", "handler")) -> DataFrame:
    """Adds doc_name: the handler, or handler-METHOD-path when several endpoints share it.

    The counts come from a combined aggregate and are joined back; a window would hold a hot handler in one task.
    """
    counts = endpoints.groupBy(*keys).agg(F.count("*").alias("_n"))
    slug = F.regexp_replace(F.regexp_replace("path", "[^A-Za-z0-9]+", "_"), "^_+|_+$", "")
    slug = F.coalesce(non_empty(slug), F.lit("root"))
    name = F.when(F.col("_n") > 1, F.concat_ws("-", F.col(keys[-1]), F.col("method"), slug)).otherwise(F.col(keys[-1]))
    return endpoints.join(counts, list(keys)).withColumn("doc_name", name).drop("_n")


def endpoint_summary(items: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Long endpoint summary (keys, kind, name), distinct: codes, tables, caches, published topics and external targets.

    items(keys, kind, name, ...) with kind in code, table, cache, publishes, external; kept long because a
    hot endpoint may reach any number of systems.
    """
    return items.where(non_empty("name").isNotNull()).select(*keys, "kind", "name").distinct()


def summary_text(summary: Column, description: Column) -> Column:
    return F.coalesce(non_empty(summary), non_empty(F.substring(F.coalesce(description, F.lit("")), 1, 200)))
