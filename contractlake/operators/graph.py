"""Application graph: building nodes and edges, views, diagram roles and model roll-ups.

Raw edges are rows (src, dst, kind, detail, pos); merged edges hold at most `cap` details.
`scope` names leading key columns such as (repo, commit_id) when one job covers many snapshots.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import first_non_empty, keep_first_per_key, non_empty, plural
from ..session import cut_lineage

# Edge kinds and node types the views tell apart.
STRUCTURAL_KINDS = ("contains", "injects", "calls")
CALL_KINDS = ("http", "routes", "calls", "injects", "feign")
MESSAGING_KINDS = ("publishes", "subscribes", "consumes", "listens", "delivers", "sends", "triggers")
MESSAGING_TYPES = ("broker", "email")
TECHNOLOGY_LABELLED = ("cache", "broker", "storage", "email", "search")
ACCESS_FRAMEWORKS = ("mybatis", "mybatis-plus", "jpa", "hibernate", "jdbc", "jdbctemplate", "spring-data-jpa", "spring-data-jdbc",
                     "r2dbc", "jooq")
RELATIONAL_TECHNOLOGIES = ("jpa", "jdbc", "r2dbc", "hibernate_session")
BUS_SHARE = 0.5
BUS_MINIMUM = 3
DETAILS_BUILD, DETAILS_VIEW, DETAILS_LAYERED = 50, 30, 12

# Diagram groups of node types (order, label).
SYSTEM_GROUPS = {"datastore": "0 Databases", "search": "0 Databases", "cache": "1 Caches", "storage": "2 Storage", "broker": "3 Messaging",
                 "email": "3 Messaging", "external_service": "4 External services"}
COMPONENT_GROUPS = {"module": "0 Other services", "datastore": "1 Data", "cache": "1 Data", "storage": "1 Data", "search": "1 Data",
                    "broker": "2 Messaging", "email": "2 Messaging", "external_service": "3 External"}
LAYER_RANK = {"web": 0, "messaging": 0, "scheduling": 0, "service": 1, "data": 2, "integration": 2}
TYPE_LABELS = {
    "module": "Service", "datastore": "Database", "cache": "Cache", "storage": "Storage", "search": "Search",
    "broker": "Message broker", "email": "Email", "external_service": "External service",
    "infrastructure": "Platform", "component": "Component",
}


def lookup(values: dict, key: Column, default=None) -> Column:
    """Small constant map as a CASE expression."""
    out = F.lit(default) if not isinstance(default, Column) else default
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


# ---------------------------------------------------------------- merging

def first_details(edges: DataFrame, keys: Sequence[str], cap: int) -> DataFrame:
    """Distinct non-empty details of each edge in first-seen order, at most `cap` (a display limit).

    Distinct details are found by a combined aggregate, the rank limit cuts them before the
    second shuffle, so a hot edge never travels whole.
    """
    distinct = (edges.withColumn("detail", non_empty("detail")).groupBy(*keys, "detail").agg(F.min("pos").alias("pos")))
    w = Window.partitionBy(*keys).orderBy(F.col("detail").isNull(), "pos", "detail")
    top = distinct.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= cap)
    entry = F.when(F.col("detail").isNotNull(), F.struct("pos", "detail"))
    return top.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(entry)), lambda d: d["detail"]).alias("details"))


def named_details(rows: DataFrame, keys: Sequence[str], cap: int) -> DataFrame:
    """Distinct non-empty details of each key by name, at most `cap`: what `first_details` gives when all positions are equal.

    One sort finds equal details side by side and lists them, so nothing is kept in a hash table or dealt out twice; rows that lie with their key stay there.
    """
    w = Window.partitionBy(*keys).orderBy(F.col("detail").asc_nulls_last())
    told = rows.select(*keys, non_empty("detail").alias("detail"))
    told = told.select("*", F.row_number().over(w).alias("_n"), F.dense_rank().over(w).alias("_rank"), F.lag("detail").over(w).alias("_before"))
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    listed = told.where((F.col("_rank") <= cap) & ((F.col("_n") == 1) | (F.col("_before") != F.col("detail")))).withColumn("details", F.collect_list("detail").over(whole))
    return listed.where("_n = 1").select(*keys, "details")


def merge_edges(edges: DataFrame, scope: Sequence[str] = (), cap: int = DETAILS_BUILD) -> DataFrame:
    """One edge per (src, dst, kind) without self loops."""
    return first_details(edges.where("src <> dst"), [*scope, "src", "dst", "kind"], cap)


def explode_details(edges: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Merged edges back as raw rows; edges without details keep one row."""
    return edges.select(*scope, "src", "dst", "kind", F.posexplode_outer("details").alias("pos", "detail")).withColumn(
        "pos", F.coalesce("pos", F.lit(0)))


# ---------------------------------------------------------------- building

def build_graph(model: dict[str, DataFrame], scope: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(nodes, merged edges) of an application model given as tables; absent tables are skipped.

    modules(path, name, app_name, port, is_app, aggregator), components(id, name, stereotype, layer, module),
    injections(component, target, field), calls(caller, callee, label), datastores(module, profile, type, host, database),
    mongodb / redis(module, host, database), brokers(module, technology), discovery(module, type, url),
    config_servers / identity_providers(module, url), gateway_routes(module, target, target_module, predicates),
    facts(component, module, kind, technology, operation, names ARRAY, host, target_service, target_module, http_method, url),
    listeners(component, module, technology, destinations ARRAY), scheduled(component, handler).
    """
    nodes: list[DataFrame] = []
    edges: list[DataFrame] = []
    blank = F.lit(None).cast("string")
    have = model.get

    def node(df: DataFrame, order: int, node_id: Column, kind: Column | str, **attrs: Column) -> None:
        names = ("name", "module", "technology", "host", "stereotype", "layer")
        nodes.append(df.select(
            *scope, node_id.alias("id"), (F.lit(kind) if isinstance(kind, str) else kind).alias("type"),
            *[attrs.get(n, blank).cast("string").alias(n) for n in names], F.lit(order).alias("_order")))

    def edge(df: DataFrame, src: Column, dst: Column, kind: Column | str, detail: Column = blank) -> DataFrame:
        edges.append(df.select(*scope, src.alias("src"), dst.alias("dst"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"),
                               detail.cast("string").alias("detail")))
        return edges[-1]

    module_id = F.concat(F.lit("module:"), F.col("module"))
    component_id = F.concat(F.lit("component:"), F.col("component"))
    c = F.col
    if have("modules") is not None:
        apps = model["modules"].where(~F.coalesce(c("aggregator"), F.lit(False)))
        node(apps, 0, F.concat(F.lit("module:"), "path"), "module", name=first_non_empty("app_name", "name"), module=c("path"))
    if have("components") is not None:
        comps = model["components"].withColumnRenamed("id", "component")
        node(comps, 1, component_id, "component", name=c("name"), stereotype=c("stereotype"), layer=c("layer"), module=c("module"))
        edge(comps, module_id, component_id, "contains")
    if have("injections") is not None:
        # no other rule has a component injected, and a pair is seldom told twice: pairs are merged apart, under their short names
        pairs = model["injections"].where("component <> target").select(*scope, "component", "target", c("field").cast("string").alias("detail"))
        injected = named_details(pairs, [*scope, "component", "target"], DETAILS_BUILD).select(
            *scope, component_id.alias("src"), F.concat(F.lit("component:"), "target").alias("dst"), F.lit("injects").alias("kind"), "details")
    if have("calls") is not None:
        edge(model["calls"], F.concat(F.lit("component:"), "caller"), F.concat(F.lit("component:"), "callee"), "calls", c("label"))

    if have("datastores") is not None:
        ds = _configured_stores(model, scope)
        node(ds, 2, c("store"), "datastore", technology=c("technology"), host=c("host"))
        edge(ds, module_id, c("store"), "connects", c("profile"))
    if have("redis") is not None:
        rid = F.concat(F.lit("cache:redis:"), F.coalesce("host", F.lit("default")))
        node(model["redis"], 2, rid, "cache", technology=F.lit("redis"), host=c("host"))
        edge(model["redis"], module_id, rid, "connects")
    if have("brokers") is not None:
        bid = F.concat(F.lit("broker:"), "technology")
        node(model["brokers"], 2, bid, "broker", technology=c("technology"))
        edge(model["brokers"], module_id, bid, "connects")
    if have("discovery") is not None:
        did = F.concat(F.lit("infra:discovery:"), "type")
        node(model["discovery"], 2, did, "infrastructure", technology=c("type"))
        edge(model["discovery"], module_id, did, "registers")
    for table, infra, tech, kind in (("config_servers", "infra:config-server", "spring-cloud-config", "reads_config"),
                                     ("identity_providers", "infra:identity-provider", "oauth2", "authenticates")):
        if have(table) is not None:
            node(model[table], 2, F.lit(infra), "infrastructure", technology=F.lit(tech))
            edge(model[table], module_id, F.lit(infra), kind)
    if have("gateway_routes") is not None:
        routes = model["gateway_routes"]
        to = F.when(c("target_module").isNotNull(), F.concat(F.lit("module:"), "target_module")).otherwise(F.concat(F.lit("external:"), "target"))
        node(routes.where("target_module IS NULL"), 2, F.concat(F.lit("external:"), "target"), "external_service", name=c("target"))
        edge(routes, module_id, to, "routes", c("predicates"))
    served = _fact_rules(model, scope, node, edge) if have("facts") is not None else None
    if have("listeners") is not None:
        rows = model["listeners"].where(c("technology") != "spring-event").withColumn("destination", F.explode_outer("destinations"))
        bid = F.concat(F.lit("broker:"), "technology")
        node(rows, 4, bid, "broker", technology=c("technology"))
        edge(rows, bid, F.when(c("component").isNotNull(), component_id).otherwise(module_id), "delivers", c("destination"))
    if have("scheduled") is not None:
        node(model["scheduled"], 5, F.lit("infra:scheduler"), "infrastructure", technology=F.lit("spring-scheduling"))
        edge(model["scheduled"], F.lit("infra:scheduler"), component_id, "triggers", c("handler"))

    all_nodes = keep_first_per_key(reduce(DataFrame.unionByName, nodes), [*scope, "id"], ["_order", "name", "module", "host"]).drop("_order")
    # repeated edges vanish when their details are merged; nodes and edges are read apart, so neither is worked out for the other
    raw = [e.where("src <> dst") for e in edges]
    if have("components") is not None and served is not None:
        # a component that calls its own module leaves a loop on the module
        raw.append(_module_edges(served.where("src <> dst"), model["components"], scope))
    merged = [named_details(reduce(DataFrame.unionByName, raw).distinct(), [*scope, "src", "dst", "kind"], DETAILS_BUILD)] if raw else []
    return all_nodes, reduce(DataFrame.unionByName, merged + ([injected] if have("injections") is not None else []))


def _configured_stores(model: dict[str, DataFrame], scope: Sequence[str]) -> DataFrame:
    """Datastores from configuration: module, store id, family, profile, technology, host."""
    ds = model["datastores"]
    store = F.concat(F.lit("datastore:"), F.col("type"), F.lit(":"), F.coalesce("host", F.lit("embedded")), F.lit("/"), F.coalesce("database", F.lit("")))
    out = ds.select(*scope, "module", store.alias("store"), F.lit("relational").alias("family"), "profile", F.col("type").alias("technology"), "host")
    if model.get("mongodb") is not None:
        mongo = F.concat(F.lit("datastore:mongodb:"), F.coalesce("host", F.lit("default")), F.lit("/"), F.coalesce("database", F.lit("")))
        out = out.unionByName(model["mongodb"].select(
            *scope, "module", mongo.alias("store"), F.lit("mongodb").alias("family"), F.lit(None).cast("string").alias("profile"),
            F.lit("mongodb").alias("technology"), "host"))
    return out


def _fact_rules(model: dict[str, DataFrame], scope: Sequence[str], node, edge) -> DataFrame:
    """Adds nodes and edges of facts. Returns those of services that are called: the only rule that leads from components to modules."""
    c = F.col
    facts = model["facts"]
    src = F.when(c("component").isNotNull(), F.concat(F.lit("component:"), "component")).otherwise(F.concat(F.lit("module:"), "module"))
    operation = F.lower(F.coalesce(non_empty("operation"), F.lit("uses")))
    names = F.explode_outer("names")

    db = facts.where("kind = 'database'").withColumn("name_", names).withColumn(
        "family", F.when(c("technology") == "mongodb", "mongodb").when(c("technology").isin(*RELATIONAL_TECHNOLOGIES), "relational")
        .otherwise(c("technology")))
    if model.get("datastores") is not None:
        stores = _configured_stores(model, scope)
        # the default profile's store, or the only one a module has
        per = stores.groupBy(*scope, "module", "family").agg(
            F.count("*").alias("_n"), F.max(F.when(c("profile").isNull() | (c("profile") == "default"), c("store"))).alias("_default"), F.max("store").alias("_any"))
        chosen = per.select(*scope, "module", "family", F.coalesce("_default", F.when(c("_n") == 1, c("_any"))).alias("_store"))
        db = db.join(chosen, [*scope, "module", "family"], "left")
    else:
        db = db.withColumn("_store", F.lit(None).cast("string"))
    own = F.concat(F.lit("store:"), "module", F.lit(":"), "technology")
    node(db.where("_store IS NULL"), 3, own, "datastore", technology=c("technology"), module=c("module"))
    edge(db, src, F.coalesce("_store", own), operation, c("name_"))

    cache = facts.where("kind = 'cache'")
    cid = F.concat(F.lit("cache:"), "module", F.lit(":"), "technology")
    node(cache, 3, cid, "cache", technology=c("technology"), module=c("module"))
    edge(cache, src, cid, operation, F.array_join("names", ", "))

    msg = facts.where("kind = 'messaging'").withColumn("name_", names)
    bid = F.concat(F.lit("broker:"), "technology")
    node(msg, 3, bid, "broker", technology=c("technology"))
    edge(msg, src, bid, "publishes", c("name_"))

    http = facts.where("kind = 'http'").withColumn("_target", first_non_empty("target_service", "host", F.lit("unresolved")))
    ext = F.concat(F.lit("external:"), "_target")
    node(http.where("target_module IS NULL"), 3, ext, "external_service", name=c("_target"))
    served = edge(http, src, F.when(c("target_module").isNotNull(), F.concat(F.lit("module:"), "target_module")).otherwise(ext), "http",
                  F.concat_ws(" ", non_empty("http_method"), non_empty("url")))

    other = facts.where("kind IN ('email', 'storage', 'search')").withColumn("name_", names)
    oid = F.concat("kind", F.lit(":"), "technology")
    node(other, 3, oid, c("kind"), technology=c("technology"))
    edge(other, src, oid, operation, c("name_"))
    return served


def _module_edges(served: DataFrame, components: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Component edges onto modules, repeated from the owning module where it has no such edge itself."""
    owners = components.select(*scope, F.concat(F.lit("component:"), "id").alias("src"), F.concat(F.lit("module:"), "module").alias("_owner"))
    outward = served.where(F.col("src").startswith("component:") & F.col("dst").startswith("module:"))
    lifted = outward.join(owners, [*scope, "src"]).select(*scope, F.col("_owner").alias("src"), "dst", "kind", "detail")
    direct = served.where(F.col("src").startswith("module:")).select(*scope, "src", "dst", "kind").distinct()
    return lifted.join(direct, [*scope, "src", "dst", "kind"], "left_anti")


# ---------------------------------------------------------------- views

def lift_to_module(edges: DataFrame, nodes: DataFrame, scope: Sequence[str] = (), cap: int = DETAILS_VIEW) -> DataFrame:
    """Non-structural edges between modules and outside systems; component ends become their module."""
    owners = nodes.where("type = 'component'").select(*scope, "id", F.concat(F.lit("module:"), F.coalesce("module", F.lit(""))).alias("_owner"))
    # distinct details first: the joins then see each (edge, detail) once however often it was recorded
    rows = edges.where(~F.col("kind").isin(*STRUCTURAL_KINDS)).groupBy(*scope, "src", "dst", "kind", "detail").agg(F.min("pos").alias("pos"))
    for end in ("src", "dst"):
        rows = (rows.join(owners.withColumnRenamed("id", end), [*scope, end], "left")
                .withColumn(end, F.coalesce("_owner", end)).drop("_owner"))
    return merge_edges(rows, scope, cap)


def system_view(edges: DataFrame, nodes: DataFrame, scope: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(nodes, links): all modules and every outside system that a link uses."""
    links = lift_to_module(edges, nodes, scope)
    used = links.select(*scope, F.col("src").alias("id")).union(links.select(*scope, F.col("dst").alias("id"))).distinct()
    outside = nodes.where("type <> 'component'")
    shown = outside.where("type = 'module'").unionByName(outside.where("type <> 'module'").join(used, [*scope, "id"], "left_semi"))
    return shown.withColumn("label", node_label()), links


def component_view(edges: DataFrame, nodes: DataFrame, module: str | None = None, scope: Sequence[str] = (),
                   cap: int = DETAILS_VIEW) -> DataFrame:
    """Links that touch the components of a module; component-to-component ones only inside it."""
    inside = nodes.where("type = 'component'")
    inside = inside if module is None else inside.where(F.col("module") == module)
    flag = inside.select(*scope, "id", F.lit(True).alias("_in"))
    rows = edges.where("kind <> 'contains'").groupBy(*scope, "src", "dst", "kind", "detail").agg(F.min("pos").alias("pos"))
    for end in ("src", "dst"):
        rows = rows.join(flag.withColumnsRenamed({"id": end, "_in": f"_{end}"}), [*scope, end], "left")
    s, d = F.col("_src").isNotNull(), F.col("_dst").isNotNull()
    kept = rows.where((s | d) & (~F.col("kind").isin("injects", "calls") | (s & d)))
    return merge_edges(kept, scope, cap)


def node_label() -> Column:
    """Display label of a node from name, technology, host and type."""
    base = F.coalesce(non_empty("name"), non_empty("technology"), F.regexp_replace("id", "^[^:]*:", ""))
    at = F.when(non_empty("host").isNotNull(), F.concat(F.lit(" @ "), "host"))
    return (F.when((F.col("type") == "datastore") & at.isNotNull(), F.concat(F.coalesce("technology", F.lit("None")), at))
            .when(F.col("type").isin(*TECHNOLOGY_LABELLED) & non_empty("technology").isNotNull(), F.concat("technology", F.coalesce(at, F.lit(""))))
            .otherwise(base))


def node_facts(nodes: DataFrame) -> DataFrame:
    """nodes with what a diagram shows beside the label: `type_label`, `meta` and `badges` (short arrays), and the label of unresolved targets.

    Modules: name they run under, port, number of endpoints, whether a library. Others: technology unless the label says it, database.
    Missing columns (application_name, port, endpoint_count, is_app, database) count as null.
    """
    has = lambda name, kind: F.col(name) if name in nodes.columns else F.lit(None).cast(kind)
    module, unresolved = F.col("type") == "module", F.col("id") == "external:unresolved"
    count, port = has("endpoint_count", "long"), non_empty(has("port", "string").cast("string"))
    label = F.when(unresolved, "Unresolved URLs").when(module, F.coalesce(non_empty(has("application_name", "string")), non_empty("name"), node_label())).otherwise(node_label())
    technology = non_empty("technology")
    meta = F.filter(F.array(
        F.when(module & port.isNotNull(), F.concat(F.lit("port "), port)),
        F.when(module & (count > 0), plural(count, "endpoint")),
        F.when(~module & (technology != F.substring_index(node_label(), " @ ", 1)), technology),
        F.when(~module & non_empty(has("database", "string")).isNotNull(), F.concat(F.lit("db "), has("database", "string"))),
        F.when(~module & unresolved, F.lit("URL built at runtime"))), lambda m: m.isNotNull())
    badges = F.when(module & ~F.coalesce(has("is_app", "boolean"), F.lit(True)), F.array(F.lit("library"))).otherwise(F.array().cast("array<string>"))
    return nodes.withColumns({"label": label, "type_label": lookup(TYPE_LABELS, F.col("type"), F.col("type")), "meta": meta, "badges": badges})


# ---------------------------------------------------------------- layered diagrams

def link_category(kinds: Column, target_type: Column) -> Column:
    has = lambda names: F.arrays_overlap(kinds, F.array(*[F.lit(n) for n in names]))
    return (F.when(target_type == "external_service", "external")
            .when(has(MESSAGING_KINDS) | target_type.isin(*MESSAGING_TYPES), "messaging")
            .when(has(CALL_KINDS) & target_type.isin("module", "component"), "call").otherwise("data"))


def display_kinds(kinds: Column) -> Column:
    shown = F.array_sort(F.filter(kinds, lambda k: ~k.isin("connects", "injects")))
    return (F.when(F.size(shown) > 0, shown).when(F.array_contains(kinds, "injects"), F.array(F.lit("uses")))
            .otherwise(F.array_sort(kinds)))


def merge_links(edges: DataFrame, nodes: DataFrame, scope: Sequence[str] = (), cap: int = DETAILS_LAYERED) -> DataFrame:
    """One link per (src, dst) with display kinds, category and details.

    A broker that delivers to a listener is drawn from the listener, as `consumes`. Kinds are a
    small fixed vocabulary, so collecting them per link is bounded.
    """
    types = nodes.select(*scope, "id", "type")
    rows = edges.where("src <> dst").groupBy(*scope, "src", "dst", "kind", "detail").agg(F.min("pos").alias("pos"))
    for end in ("src", "dst"):
        rows = rows.join(types.withColumnsRenamed({"id": end, "type": f"_{end}_type"}), [*scope, end])
    flip = F.col("_src_type").isin(*MESSAGING_TYPES) & F.col("_dst_type").isin("module", "component")
    turned = rows.select(
        *scope, F.when(flip, F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(flip, F.col("src")).otherwise(F.col("dst")).alias("dst"),
        F.when(flip, F.lit("consumes")).otherwise(F.col("kind")).alias("kind"),
        F.when(flip, F.col("_src_type")).otherwise(F.col("_dst_type")).alias("target_type"), "detail", "pos")
    keys = [*scope, "src", "dst"]
    # reading `pos` here as well lets both aggregates share one shuffle of the distinct edges
    kinds = turned.groupBy(*keys).agg(F.collect_set("kind").alias("_kinds"), F.max("target_type").alias("target_type"), F.min("pos").alias("_p")).drop("_p")
    return (kinds.join(first_details(turned, keys, cap), keys)
            .withColumn("category", link_category(F.col("_kinds"), F.col("target_type")))
            .withColumn("kinds", display_kinds(F.col("_kinds"))).drop("_kinds"))


def resolve_systems(nodes: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Node id -> id it is drawn as: components and access-framework stores fold into their module,
    other per-module stores merge per technology."""
    store = F.col("id").startswith("store:") & F.col("module").isNotNull()
    framework = F.lower(F.coalesce("technology", F.lit(""))).isin(*ACCESS_FRAMEWORKS)
    owner = F.concat(F.lit("module:"), F.coalesce("module", F.lit("")))
    drawn = (F.when((F.col("type") == "component") | (store & framework), owner)
             .when(store, F.concat(F.lit("store-tech:"), F.lower(F.coalesce("technology", F.lit(""))))).otherwise(F.col("id")))
    return nodes.select(*scope, "id", drawn.alias("drawn"))


def system_links(edges: DataFrame, nodes: DataFrame, scope: Sequence[str] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(drawn nodes, links, platform uses) of the system diagram.

    Links onto infrastructure do not become lines but rows (platform id, user, kind).
    """
    alias = resolve_systems(nodes, scope)
    rows = edges.where("kind <> 'contains'").groupBy(*scope, "src", "dst", "kind", "detail").agg(F.min("pos").alias("pos"))
    for end in ("src", "dst"):
        rows = (rows.join(alias.withColumnsRenamed({"id": end, "drawn": "_drawn"}), [*scope, end], "left")
                .withColumn(end, F.coalesce("_drawn", end)).drop("_drawn"))
    merged = nodes.join(alias, [*scope, "id"]).where("drawn LIKE 'store-tech:%'").withColumn("id", F.col("drawn")).drop("drawn")
    merged = keep_first_per_key(merged, [*scope, "id"], ["technology"]).withColumn("module", F.lit(None).cast("string"))
    # one row per system: small, and read again for both ends of every line
    systems = cut_lineage(nodes.where("type <> 'component'").unionByName(merged))
    infra = nodes.where("type = 'infrastructure'").select(*scope, F.col("id").alias("dst"), F.lit(True).alias("_infra"))
    # lines and platform rows both read the drawn edges, which are far fewer than the recorded ones
    rows = cut_lineage(rows.where("src <> dst").groupBy(*scope, "src", "dst", "kind", "detail").agg(F.min("pos").alias("pos"))
                       .join(infra, [*scope, "dst"], "left"))
    names = nodes.select(*scope, F.col("id").alias("src"), "name")
    platform = (rows.where("_infra").select(*scope, "src", "dst", "kind").distinct().join(names, [*scope, "src"], "left")
                .select(*scope, F.col("dst").alias("platform"),
                        F.coalesce(non_empty("name"), F.regexp_replace("src", "^[^:]*:", "")).alias("used_by"), "kind").distinct())
    inner = F.col("kind").isin("injects", "calls") & ~(F.col("src").startswith("module:") & F.col("dst").startswith("module:"))
    drawn = rows.where("_infra IS NULL").where(~inner).drop("_infra")
    return systems, merge_links(drawn, systems, scope), platform


def platform_summary(platform: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Platform systems with user count and kinds, most used first."""
    users = platform.select(*scope, "platform", "used_by").distinct().groupBy(*scope, "platform").agg(F.count("*").alias("users"))
    kinds = platform.groupBy(*scope, "platform").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))
    return users.join(kinds, [*scope, "platform"]).orderBy(F.col("users").desc(), "platform")


def bus_brokers(links: DataFrame, nodes: DataFrame, scope: Sequence[str] = ("repo",)) -> DataFrame:
    """Brokers that most modules merely connect to: id, plain links, all links."""
    plain = (F.size("kinds") == 1) & (F.get("kinds", F.lit(0)) == "connects")
    ends = links.select(*scope, F.col("dst").alias("id"), plain.alias("_plain")).unionByName(
        links.select(*scope, F.col("src").alias("id"), plain.alias("_plain")))
    counted = ends.groupBy(*scope, "id").agg(F.count_if("_plain").alias("bus_links"), F.count("*").alias("all_links"))
    modules = nodes.where("type = 'module'").groupBy(*scope).agg(F.count("*").alias("_modules"))
    brokers = nodes.where("type = 'broker'").select(*scope, "id")
    found = counted.where(F.col("bus_links") >= BUS_MINIMUM).join(brokers, [*scope, "id"], "left_semi")
    return found.join(modules, list(scope)).where(F.col("bus_links") >= F.col("_modules") * BUS_SHARE).drop("_modules")


def diagram_links(links: DataFrame, buses: DataFrame, roles: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Links that are drawn: without those onto a message bus, calls of libraries marked as such."""
    bus = buses.select(*scope, F.col("id").alias("dst"), F.lit(True).alias("_bus"))
    library = roles.where("type_label = 'Library'").select(*scope, F.col("id").alias("dst"), F.lit(True).alias("_library"))
    rows = links.join(bus, [*scope, "dst"], "left").join(library, [*scope, "dst"], "left")
    plain = (F.size("kinds") == 1) & (F.get("kinds", F.lit(0)) == "connects")
    used = F.col("_library").isNotNull() & (F.col("category") == "call")
    return (rows.where(F.col("_bus").isNull() | ~plain)
            .withColumn("kinds", F.when(used, F.array(F.lit("uses library"))).otherwise(F.col("kinds")))
            .withColumn("category", F.when(used, "library").otherwise(F.col("category"))).drop("_bus", "_library"))


def system_roles(nodes: DataFrame, links: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Column and group of every drawn node: gateways first, services, then systems. `node_facts` gives meta and badges."""
    ends = links.select(*scope, F.explode(F.array(
        F.struct(F.col("src").alias("id"), F.array_contains("kinds", "routes").alias("_gateway")),
        F.struct(F.col("dst").alias("id"), F.lit(False).alias("_gateway")))).alias("e")).select(*scope, "e.*")
    ends = ends.groupBy(*scope, "id").agg(F.bool_or("_gateway").alias("_gateway"))
    library = (F.col("type") == "module") & ~F.coalesce(F.col("is_app"), F.lit(True)) if "is_app" in nodes.columns else F.lit(False)
    rows = (nodes.where("type NOT IN ('component', 'infrastructure')").join(ends, [*scope, "id"], "left")
            .where("type = 'module' OR _gateway IS NOT NULL").withColumn("library", library))
    gateway = F.coalesce("_gateway", F.lit(False)) & (F.col("type") == "module") & ~F.col("library")
    return rows.select(
        *scope, "id", "type", node_label().alias("label"),
        F.when(F.col("library"), "Library").otherwise(lookup(TYPE_LABELS, F.col("type"), F.col("type"))).alias("type_label"),
        F.when(gateway, 0).when(F.col("type") == "module", 1).otherwise(2).alias("column_no"),
        F.when(F.col("library"), "1 Shared libraries").otherwise(F.coalesce(lookup(SYSTEM_GROUPS, F.col("type")), F.lit("0"))).alias("group_label"),
        gateway.alias("gateway"))


def component_columns(edges: DataFrame, nodes: DataFrame, module: str, scope: Sequence[str] = ()) -> DataFrame:
    """Nodes of one module's component diagram with column and group; hidden ones are flagged."""
    own = nodes.where((F.col("type") == "component") & (F.col("module") == module))
    hidden = F.coalesce(F.col("layer") == "config", F.lit(False)) | F.coalesce(F.col("stereotype") == "controller_advice", F.lit(False))
    own = own.withColumn("hidden", hidden)
    shown = own.where("NOT hidden").select(*scope, "id", F.lit(True).alias("_in"))
    rows = edges.where("kind <> 'contains'").select(*scope, "src", "dst", "kind").distinct()
    for end in ("src", "dst"):
        rows = rows.join(shown.withColumnsRenamed({"id": end, "_in": f"_{end}"}), [*scope, end], "left")
    s, d = F.col("_src").isNotNull(), F.col("_dst").isNotNull()
    rows = rows.where((s | d) & (~F.col("kind").isin("injects", "calls") | (s & d)))
    ends = rows.where(~s).select(*scope, F.col("src").alias("id")).union(rows.where(~d).select(*scope, F.col("dst").alias("id"))).distinct()
    others = (nodes.where("type <> 'infrastructure'").join(ends, [*scope, "id"], "left_semi")
              .where(~((F.col("type") == "component") & (F.col("module") == module))).withColumn("hidden", F.lit(False)))
    rank = F.least(lookup(LAYER_RANK, F.col("layer"), 1), F.lit(2))
    every = own.unionByName(others)
    return every.select(*scope, "id", "type", node_label().alias("label"),
                        F.when(F.col("type") == "component", F.coalesce(rank, F.lit(1))).otherwise(3).alias("column_no"),
                        F.coalesce(lookup(COMPONENT_GROUPS, F.col("type")), F.lit("0")).alias("group_label"), "hidden")


# ---------------------------------------------------------------- model roll-ups

def topic_topology(producers: DataFrame, consumers: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Distinct members of each (technology, destination) with their role; either side may be missing."""
    side = lambda df, role, who: df.select(*scope, "technology", "destination", F.lit(role).alias("role"), F.col(who).alias("member"))
    return side(producers, "producer", "source").unionByName(side(consumers, "consumer", "handler")).distinct()


def topic_counts(topology: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    named = non_empty("member").isNotNull()
    return topology.groupBy(*scope, "technology", "destination").agg(
        F.count_if(named & (F.col("role") == "producer")).alias("producers"), F.count_if(named & (F.col("role") == "consumer")).alias("consumers"))


def table_access(facts: DataFrame, entities: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Per table: store of the first sighting, operations, and counts of entities, methods and modules.

    entities(table, store, entity, module, pos), facts(table, technology, operation, source, module, pos).
    Members are counted after a distinct, so no table's member list is held in one place.
    """
    blank = F.lit(None).cast("string")
    seen = entities.select(*scope, "table", F.col("store").alias("store"), F.col("entity").alias("entity"), blank.alias("operation"),
                           blank.alias("source"), "module", F.lit(0).alias("_side"), "pos").unionByName(
        facts.select(*scope, "table", F.col("technology").alias("store"), blank.alias("entity"), "operation", "source", "module",
                     F.lit(1).alias("_side"), "pos"))
    keys = [*scope, "table"]
    head = seen.groupBy(*keys).agg(F.min_by("store", F.struct("_side", "pos")).alias("store"),
                                   F.array_sort(F.collect_set("operation")).alias("operations"))
    member = lambda kind, c: F.struct(F.lit(kind).alias("kind"), F.col(c).alias("member"))
    members = seen.select(*keys, F.explode(F.array(member("entity", "entity"), member("source", "source"), member("module", "module"))).alias("m"))
    counts = (members.where("m.member IS NOT NULL").distinct().groupBy(*keys).agg(
        *[F.count_if(F.col("m.kind") == k).alias(n) for k, n in (("entity", "entities"), ("source", "accessed_by"), ("module", "modules"))]))
    return head.join(counts, keys, "left")


def facts_by_kind(facts: DataFrame, kind: str, fields: Sequence[str], scope: Sequence[str] = (), pos: str = "pos") -> DataFrame:
    """Distinct facts of a kind with the position of their first sighting."""
    return facts.where(F.col("kind") == kind).groupBy(*scope, *fields).agg(F.min(pos).alias(pos))


def model_summary(modules: DataFrame, components: DataFrame, dependencies: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Long summary (metric, name, value) of a model: totals, components per stereotype, technologies, style.

    modules(path, is_app, aggregator), components(stereotype), dependencies(category, technology).
    """
    metric = lambda df, m, n, v: df.select(*scope, F.lit(m).alias("metric"), n.cast("string").alias("name"), v.cast("string").alias("value"))
    per = modules.groupBy(*scope).agg(F.count_if(~F.coalesce("aggregator", F.lit(False))).alias("n"), F.count_if("is_app").alias("apps"))
    style = F.when(F.col("apps") > 1, "microservices").otherwise("monolith")
    stereo = components.groupBy(*scope, "stereotype").agg(F.count("*").alias("n"))
    tech = dependencies.where("category IS NOT NULL AND category NOT IN ('test', 'code-generation')").select(*scope, "category", "technology").distinct()
    return reduce(DataFrame.unionByName, [
        metric(per, "modules", F.lit(""), F.col("n")), metric(per, "apps", F.lit(""), F.col("apps")),
        metric(per, "style", F.lit(""), style), metric(stereo, "components", F.col("stereotype"), F.col("n")),
        metric(tech, "technology", F.col("category"), F.col("technology"))])


def module_rollup(modules: DataFrame, types: DataFrame, endpoints: DataFrame, dependencies: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Per module: types per stereotype, endpoints, technologies (category: name) and the aggregator flag.

    Stereotypes and catalogued technologies are fixed vocabularies, so the per-module lists are bounded.
    """
    keys = [*scope, "module"]
    kinds = types.groupBy(*keys, "stereotype").agg(F.count("*").alias("n")).groupBy(*keys).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("stereotype", "n")))).alias("type_counts"))
    ends = endpoints.groupBy(*keys).agg(F.count("*").alias("endpoint_count"))
    shown = dependencies.where("scope_ <> 'test' AND category IS NOT NULL AND category NOT IN ('test', 'code-generation')")
    tech = shown.groupBy(*keys).agg(F.array_sort(F.collect_set(F.concat("category", F.lit(": "), "technology"))).alias("technologies"))
    out = modules.join(kinds, keys, "left").join(ends, keys, "left").join(tech, keys, "left")
    bare = F.col("type_counts").isNull() & (F.coalesce("config_files", F.lit(0)) == 0) & (F.col("packaging") == "pom")
    return out.withColumn("endpoint_count", F.coalesce("endpoint_count", F.lit(0))).withColumn("aggregator", bare)


def security_summary(modules: DataFrame, dependencies: DataFrame, mechanisms: DataFrame, endpoints: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Security technologies, mechanisms, annotated endpoints and the enabled flag per key.

    modules: keys; dependencies(category, technology); mechanisms(mechanism); endpoints(annotations).
    """
    tech = dependencies.where("category = 'security'").groupBy(*keys).agg(F.array_sort(F.collect_set("technology")).alias("technologies"))
    mech = mechanisms.groupBy(*keys).agg(F.array_sort(F.collect_set("mechanism")).alias("mechanisms"),
                                         F.coalesce(F.bool_or(F.col("mechanism") == "csrf disabled"), F.lit(False)).alias("csrf_disabled"))
    guarded = endpoints.where("annotations > 0").groupBy(*keys).agg(F.count("*").alias("endpoints_with_method_security"))
    out = modules.select(*keys).distinct()
    for part in (tech, mech, guarded):
        out = out.join(part, list(keys), "left")
    none = F.array().cast("array<string>")
    return (out.withColumn("technologies", F.coalesce("technologies", none)).withColumn("mechanisms", F.coalesce("mechanisms", none))
            .withColumn("csrf_disabled", F.coalesce("csrf_disabled", F.lit(False)))
            .withColumn("endpoints_with_method_security", F.coalesce("endpoints_with_method_security", F.lit(0)))
            .withColumn("enabled", (F.size("technologies") > 0) | (F.size("mechanisms") > 0)))
