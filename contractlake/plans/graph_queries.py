"""Application graph operators on module, component and system relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph
from .bindings import RELATIONS, oracle, relation
from .registry import ORACLE, Source, query

# edges without self loops, each detail with its first position
RELATIONS["ED"] = "SELECT src, dst, kind, detail, min(pos) AS pos FROM E GROUP BY src, dst, kind, detail"


def _joined(df, *cols, details: str = "details"):
    return df.select(*cols, F.array_join(details, ",").alias("details"))


def _top(source: str, keys: str, cap: int) -> str:
    """SQL: first `cap` distinct details of each key in order of first position."""
    return (f"SELECT {keys}, string_agg(detail, ',' ORDER BY pos, detail) AS details FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY pos, detail) AS rn "
            f"FROM (SELECT {keys}, detail, min(pos) AS pos FROM {source} GROUP BY {keys}, detail)) WHERE rn <= {cap} GROUP BY {keys}")


@query("merge_edges", oracle(_top("(SELECT * FROM E WHERE src <> dst)", "src, dst, kind", 12)))
def merge_edges(src: Source):
    return _joined(graph.merge_edges(relation(src, "E"), cap=graph.DETAILS_LAYERED), "src", "dst", "kind")


_OWNED = ("SELECT coalesce(s.m, e.src) AS src, coalesce(d.m, e.dst) AS dst, kind, detail, pos FROM ED e "
          "LEFT JOIN (SELECT id, 'module:' || module AS m FROM N WHERE type = 'component') s ON e.src = s.id "
          "LEFT JOIN (SELECT id, 'module:' || module AS m FROM N WHERE type = 'component') d ON e.dst = d.id WHERE kind <> 'calls'")


@query("lift_to_module", oracle(_top(f"(SELECT * FROM ({_OWNED}) WHERE src <> dst)", "src, dst, kind", 30)))
def lift_to_module(src: Source):
    return _joined(graph.lift_to_module(relation(src, "E"), relation(src, "N")), "src", "dst", "kind")


_SCOPE1 = "(SELECT id FROM N WHERE type = 'component' AND module = 'region-1')"
RELATIONS["CV"] = (f"SELECT *, src IN {_SCOPE1} AS s, dst IN {_SCOPE1} AS d FROM ED WHERE src <> dst")


@query("component_view", oracle(_top("(SELECT * FROM CV WHERE (s OR d) AND (kind <> 'calls' OR (s AND d)))", "src, dst, kind", 30)))
def component_view(src: Source):
    return _joined(graph.component_view(relation(src, "E"), relation(src, "N"), "region-1"), "src", "dst", "kind")


# one node per customer with every mix of type, technology and host
RELATIONS["NL"] = (
    "SELECT 'x:' || c_custkey AS id, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'datastore' WHEN 'BUILDING' THEN 'cache' WHEN 'FURNITURE' THEN 'component' "
    "WHEN 'HOUSEHOLD' THEN 'broker' ELSE 'external_service' END AS type, CASE WHEN c_acctbal > 8000 THEN NULL WHEN c_acctbal > 6000 THEN '' ELSE c_name END AS name, "
    "CASE WHEN c_acctbal > 9000 THEN NULL ELSE 'tech-' || c_nationkey END AS technology, CASE WHEN c_nationkey > 12 THEN 'host-' || c_nationkey END AS host FROM customer")


@query("node_label", oracle(
    "SELECT id, CASE WHEN type = 'datastore' AND host IS NOT NULL THEN coalesce(technology, 'None') || ' @ ' || host "
    "WHEN type IN ('cache', 'broker') AND technology IS NOT NULL THEN technology || coalesce(' @ ' || host, '') "
    "ELSE coalesce(nullif(name, ''), technology, substr(id, 3)) END AS label FROM NL"))
def node_label(src: Source):
    return relation(src, "NL").select("id", graph.node_label().alias("label"))


# the same customers, those of one segment as modules with a port and endpoints
RELATIONS["NF"] = (
    "SELECT id, CASE type WHEN 'component' THEN 'module' ELSE type END AS type, name, technology, host, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'app-' || c_custkey END AS application_name, "
    "CASE WHEN c_custkey % 2 = 0 THEN 8000 + c_nationkey END AS port, c_custkey % 4 AS endpoint_count, c_custkey % 5 > 0 AS is_app, CASE WHEN c_custkey % 7 = 0 THEN 'd' || c_custkey ELSE '' END AS database "
    "FROM NL JOIN customer ON id = 'x:' || c_custkey")

@query("node_facts", oracle(
    "SELECT id, label, meta, CASE WHEN type = 'module' AND NOT is_app THEN 'library' ELSE '' END AS badges FROM (SELECT *, CASE WHEN type = 'module' THEN coalesce(nullif(application_name, ''), nullif(name, ''), base) ELSE base END AS label, "
    "concat_ws(' | ', CASE WHEN type = 'module' AND port IS NOT NULL THEN 'port ' || port END, CASE WHEN type = 'module' AND endpoint_count > 0 THEN endpoint_count || ' endpoint' || CASE WHEN endpoint_count = 1 THEN '' ELSE 's' END END, "
    "CASE WHEN type <> 'module' AND technology <> split_part(base, ' @ ', 1) THEN technology END, CASE WHEN type <> 'module' AND database <> '' THEN 'db ' || database END) AS meta FROM ("
    "SELECT *, CASE WHEN type = 'datastore' AND host IS NOT NULL THEN coalesce(technology, 'None') || ' @ ' || host WHEN type IN ('cache', 'broker') AND technology IS NOT NULL THEN technology || coalesce(' @ ' || host, '') "
    "ELSE coalesce(nullif(name, ''), technology, substr(id, 3)) END AS base FROM NF))"))
def node_facts(src: Source):
    return graph.node_facts(relation(src, "NF")).select("id", "label", F.array_join("meta", " | ").alias("meta"), F.array_join("badges", " | ").alias("badges"))


_TYPED = ("SELECT e.*, s.type AS st, d.type AS dt, s.type = 'broker' AND d.type = 'component' AS flip FROM ED e "
          "JOIN N s ON e.src = s.id JOIN N d ON e.dst = d.id WHERE src <> dst")
_TURNED = ("SELECT CASE WHEN flip THEN dst ELSE src END AS src, CASE WHEN flip THEN src ELSE dst END AS dst, CASE WHEN flip THEN 'consumes' ELSE kind END AS kind, "
           f"CASE WHEN flip THEN st ELSE dt END AS tt, detail, pos FROM ({_TYPED})")


@query("link_category", oracle(
    f"SELECT k.src, k.dst, kinds, details, CASE WHEN tt = 'external_service' THEN 'external' "
    "WHEN contains(kinds, 'publishes') OR contains(kinds, 'consumes') OR tt = 'broker' THEN 'messaging' "
    "WHEN (contains(kinds, 'http') OR contains(kinds, 'calls')) AND tt = 'component' THEN 'call' ELSE 'data' END AS category FROM "
    f"(SELECT src, dst, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, max(tt) AS tt FROM ({_TURNED}) GROUP BY src, dst) k "
    f"JOIN ({_top(f'({_TURNED})', 'src, dst', 12)}) t ON k.src = t.src AND k.dst = t.dst"))
def link_category(src: Source):
    links = graph.merge_links(relation(src, "E"), relation(src, "N"))
    return _joined(links.withColumn("kinds", F.array_join("kinds", ",")), "src", "dst", "kinds", "category")


# ---------------------------------------------------------------- system diagram

RELATIONS["SUP"] = "SELECT s_suppkey, s_name, 'region-' || n_regionkey AS module FROM supplier JOIN nation ON s_nationkey = n_nationkey"
RELATIONS["N2"] = (
    "SELECT 'shop' AS repo, 'module:region-' || r_regionkey AS id, 'module' AS type, r_name AS name, 'region-' || r_regionkey AS module, NULL AS technology, "
    "NULL AS host, r_name <> 'ASIA' AS is_app FROM region UNION ALL "
    "SELECT 'shop', 'component:' || s_suppkey, 'component', s_name, module, NULL, NULL, NULL FROM SUP UNION ALL "
    "SELECT 'shop', 'store:region-' || r_regionkey || ':jpa', 'datastore', NULL, 'region-' || r_regionkey, 'jpa', NULL, NULL FROM region UNION ALL "
    "SELECT 'shop', 'store:region-' || r_regionkey || ':Cassandra', 'datastore', NULL, 'region-' || r_regionkey, 'Cassandra', NULL, NULL FROM region UNION ALL "
    "SELECT DISTINCT 'shop', 'broker:' || event_type, 'broker', NULL, NULL, event_type, NULL, NULL FROM events UNION ALL "
    "SELECT DISTINCT 'shop', 'infra:' || c_mktsegment, 'infrastructure', NULL, NULL, c_mktsegment, NULL, NULL FROM customer UNION ALL "
    "SELECT DISTINCT 'shop', 'external:' || o_orderpriority, 'external_service', o_orderpriority, NULL, NULL, NULL, NULL FROM orders")
RELATIONS["E2"] = (
    "SELECT 'shop' AS repo, CASE WHEN l_linenumber = 3 AND l_returnflag = 'R' THEN 'broker:click' ELSE 'component:' || l_suppkey END AS src, "
    "CASE l_linenumber WHEN 1 THEN 'store:' || module || ':jpa' WHEN 2 THEN 'store:' || module || ':Cassandra' "
    "WHEN 3 THEN CASE WHEN l_returnflag = 'R' THEN 'component:' || l_suppkey ELSE 'broker:view' END WHEN 4 THEN 'infra:' || c_mktsegment "
    "WHEN 5 THEN 'external:' || o_orderpriority WHEN 6 THEN 'module:region-' || n_regionkey ELSE 'component:' || s_suppkey END AS dst, "
    "CASE l_linenumber WHEN 1 THEN 'read' WHEN 2 THEN 'write' WHEN 3 THEN CASE WHEN l_returnflag = 'R' THEN 'delivers' ELSE 'publishes' END "
    "WHEN 4 THEN 'reads_config' WHEN 5 THEN 'http' WHEN 6 THEN CASE WHEN l_returnflag = 'A' THEN 'routes' ELSE 'http' END ELSE 'calls' END AS kind, "
    "l_returnflag || l_linenumber || l_linestatus AS detail, l_orderkey * 10 + l_linenumber AS pos "
    "FROM lineitem JOIN SUP ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey "
    "JOIN nation ON c_nationkey = n_nationkey UNION ALL "
    "SELECT DISTINCT 'shop', 'module:region-' || r_regionkey, 'broker:error', 'connects', NULL, 0 FROM region")
RELATIONS["AL"] = ("SELECT id, CASE WHEN type = 'component' OR id LIKE 'store:%:jpa' THEN 'module:' || module WHEN id LIKE 'store:%' THEN 'store-tech:' || lower(technology) "
                   "ELSE id END AS drawn, type, name FROM N2")
RELATIONS["DR"] = ("SELECT s.drawn AS src, d.drawn AS dst, d.type AS tt, kind, detail, min(pos) AS pos FROM E2 e JOIN AL s ON e.src = s.id JOIN AL d ON e.dst = d.id "
                   "WHERE s.drawn <> d.drawn GROUP BY ALL")
_PLATFORM = "SELECT DISTINCT dst AS platform, (SELECT r_name FROM region WHERE 'module:region-' || r_regionkey = src) AS used_by, kind FROM DR WHERE tt = 'infrastructure'"
RELATIONS["LK"] = (
    "SELECT CASE WHEN src LIKE 'broker:%' THEN dst ELSE src END AS src, CASE WHEN src LIKE 'broker:%' THEN src ELSE dst END AS dst, "
    "CASE WHEN src LIKE 'broker:%' THEN 'consumes' ELSE kind END AS kind, detail, pos FROM DR "
    "WHERE tt <> 'infrastructure' AND NOT (kind = 'calls' AND NOT (src LIKE 'module:%' AND dst LIKE 'module:%'))")


def _system(src: Source):
    return graph.system_links(relation(src, "E2"), relation(src, "N2"), ["repo"])


@query("system_links", oracle(
    "SELECT k.src, k.dst, kinds, details, CASE WHEN k.dst LIKE 'external:%' THEN 'external' WHEN k.dst LIKE 'broker:%' THEN 'messaging' "
    "WHEN k.dst LIKE 'module:%' THEN 'call' ELSE 'data' END AS category FROM "
    "(SELECT src, dst, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM LK GROUP BY src, dst) k LEFT JOIN "
    f"({_top('(SELECT * FROM LK WHERE detail IS NOT NULL)', 'src, dst', 12)}) t ON k.src = t.src AND k.dst = t.dst"))
def system_links(src: Source):
    links = _system(src)[1]
    details = F.when(F.size("details") > 0, F.array_join("details", ","))
    return links.select("src", "dst", F.array_join("kinds", ",").alias("kinds"), details.alias("details"), "category")


@query("platform_summary", oracle(
    f"SELECT platform, count(DISTINCT used_by) AS users, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM ({_PLATFORM}) GROUP BY platform"))
def platform_summary(src: Source):
    return graph.platform_summary(_system(src)[2], ["repo"]).select("platform", "users", F.array_join("kinds", ",").alias("kinds"))


@query("bus_brokers", oracle(
    "SELECT dst AS id, count(*) FILTER (kinds = 'connects') AS bus_links, count(*) AS all_links FROM "
    "(SELECT src, dst, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM LK WHERE dst LIKE 'broker:%' GROUP BY src, dst) GROUP BY dst "
    "HAVING count(*) FILTER (kinds = 'connects') >= 3 AND count(*) FILTER (kinds = 'connects') >= (SELECT count(*) FROM region) * 0.5"))
def bus_brokers(src: Source):
    systems, links, _ = _system(src)
    return graph.bus_brokers(links, systems, ["repo"]).drop("repo")


@query("system_roles", oracle(
    "SELECT id, type, label, CASE WHEN label = 'ASIA' THEN 'Library' WHEN type = 'module' THEN 'Service' WHEN type = 'broker' THEN 'Message broker' "
    "WHEN type = 'datastore' THEN 'Database' ELSE 'External service' END AS type_label, "
    "CASE WHEN gateway THEN 0 WHEN type = 'module' THEN 1 ELSE 2 END AS column_no, CASE WHEN label = 'ASIA' THEN '1 Shared libraries' "
    "WHEN type = 'datastore' THEN '0 Databases' WHEN type = 'broker' THEN '3 Messaging' WHEN type = 'external_service' THEN '4 External services' ELSE '0' END AS group_label, gateway FROM ("
    "SELECT id, type, coalesce(name, technology) AS label, type = 'module' AND name <> 'ASIA' AND id IN (SELECT src FROM LK WHERE kind = 'routes') AS gateway FROM N2 "
    "WHERE type = 'module' OR (type IN ('broker', 'external_service') AND id IN (SELECT dst FROM LK)) UNION ALL "
    "SELECT 'store-tech:cassandra', 'datastore', 'Cassandra', false)"))
def system_roles(src: Source):
    systems, links, _ = _system(src)
    return graph.system_roles(systems, links, ["repo"]).drop("repo")


@query("diagram_links", oracle(
    "SELECT src, dst, CASE WHEN category = 'call' AND dst = (SELECT 'module:region-' || r_regionkey FROM region WHERE r_name = 'ASIA') THEN 'uses library' ELSE kinds END AS kinds, "
    "CASE WHEN category = 'call' AND dst = (SELECT 'module:region-' || r_regionkey FROM region WHERE r_name = 'ASIA') THEN 'library' ELSE category END AS category "
    f"FROM ({ORACLE['system_links']}) WHERE NOT (dst IN (SELECT id FROM ({ORACLE['bus_brokers']})) AND kinds = 'connects')"))
def diagram_links(src: Source):
    systems, links, _ = _system(src)
    buses, roles = graph.bus_brokers(links, systems, ["repo"]), graph.system_roles(systems, links, ["repo"])
    return graph.diagram_links(links, buses, roles, ["repo"]).select("src", "dst", F.array_join("kinds", ",").alias("kinds"), "category")


RELATIONS["N3"] = ("SELECT id, type, name, module, technology, host, CASE WHEN type = 'component' THEN CASE WHEN name < 'Supplier#000000020' THEN 'web' "
                   "WHEN name < 'Supplier#000000050' THEN 'service' WHEN name < 'Supplier#000000080' THEN 'data' ELSE 'config' END END AS layer, "
                   "CASE WHEN type = 'component' AND name LIKE '%7' THEN 'controller_advice' WHEN type = 'component' THEN 'service' END AS stereotype FROM N2")
_OWN3 = "SELECT id, layer = 'config' OR stereotype = 'controller_advice' AS hidden FROM N3 WHERE type = 'component' AND module = 'region-2'"
_IN3 = f"(SELECT id FROM ({_OWN3}) WHERE NOT hidden)"


@query("component_columns", oracle(
    "SELECT n.id, n.type, coalesce(n.name, n.technology) AS label, CASE n.layer WHEN 'web' THEN 0 WHEN 'service' THEN 1 WHEN 'data' THEN 2 ELSE 1 END AS column_no, '0' AS group_label, hidden "
    f"FROM N3 n JOIN ({_OWN3}) o ON n.id = o.id UNION ALL "
    "SELECT id, type, coalesce(name, technology), CASE WHEN type = 'component' THEN CASE layer WHEN 'web' THEN 0 WHEN 'data' THEN 2 ELSE 1 END ELSE 3 END, "
    "CASE type WHEN 'module' THEN '0 Other services' WHEN 'datastore' THEN '1 Data' WHEN 'broker' THEN '2 Messaging' WHEN 'external_service' THEN '3 External' ELSE '0' END, false "
    f"FROM N3 WHERE type <> 'infrastructure' AND id NOT IN (SELECT id FROM ({_OWN3})) AND id IN (SELECT CASE WHEN s THEN dst ELSE src END FROM "
    f"(SELECT *, src IN {_IN3} AS s, dst IN {_IN3} AS d FROM E2) WHERE s <> d AND kind NOT IN ('calls', 'injects'))"))
def component_columns(src: Source):
    return graph.component_columns(relation(src, "E2"), relation(src, "N3"), "region-2")


# ---------------------------------------------------------------- building

RELATIONS["FACTS"] = (
    "SELECT CAST(l_suppkey AS VARCHAR(20)) AS component, module, CASE l_linenumber WHEN 1 THEN 'database' WHEN 2 THEN 'cache' WHEN 3 THEN 'messaging' "
    "WHEN 4 THEN 'http' WHEN 5 THEN 'storage' WHEN 6 THEN 'database' ELSE 'http' END AS kind, "
    "CASE l_linenumber WHEN 1 THEN 'jpa' WHEN 2 THEN 'redis' WHEN 3 THEN 'kafka' WHEN 5 THEN 's3' WHEN 6 THEN 'elastic' END AS technology, "
    "CASE l_returnflag WHEN 'A' THEN 'READ' WHEN 'N' THEN 'WRITE' END AS operation, p_brand AS item, "
    "CASE WHEN l_linenumber = 4 THEN 'host-' || p_type END AS host, CASE WHEN l_linenumber = 7 THEN 'region-' || n_regionkey END AS target_module, "
    "'GET' AS http_method, '/' || p_type AS url, l_orderkey * 10 + l_linenumber AS pos "
    "FROM lineitem JOIN SUP ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey JOIN nation ON p_size % 25 = n_nationkey")
RELATIONS["INJ"] = ("SELECT DISTINCT CAST(l_suppkey AS VARCHAR(20)) AS component, CAST(s_suppkey AS VARCHAR(20)) AS target, 'f' || l_linenumber AS field FROM lineitem "
                    "JOIN supplier ON s_nationkey = l_linenumber")
# modules of three regions have one configured store, the others none
RELATIONS["DS"] = ("SELECT 'region-' || r_regionkey AS module, 'default' AS profile, 'postgresql' AS type, 'db-' || lower(r_name) AS host, 'main' AS database FROM region WHERE r_name < 'B' OR r_name > 'E'")


def _injections(src: Source):
    # the rows of INJ; both sides are distinct before they meet, so their pairs are. There are few line numbers, so that pairs dealt out by them would be few tasks:
    # they are made where their component lies, from all targets, which are the square root of the pairs
    holders = src.sql("SELECT DISTINCT CAST(l_suppkey AS VARCHAR(20)) AS component, l_linenumber FROM lineitem")
    targets = src.sql("SELECT DISTINCT CAST(s_suppkey AS VARCHAR(20)) AS target, s_nationkey FROM supplier")
    dealt = holders.repartition(int(src.spark.conf.get("spark.sql.shuffle.partitions")), "component")
    return dealt.join(F.broadcast(targets), F.col("s_nationkey") == F.col("l_linenumber")).select("component", "target", F.expr("'f' || l_linenumber").alias("field"))


def _model(src: Source):
    facts = relation(src, "FACTS").withColumn("names", F.array("item")).withColumn("target_service", F.lit(None).cast("string"))
    return {
        "modules": src.sql("SELECT 'region-' || r_regionkey AS path, r_name AS name, CAST(NULL AS STRING) AS app_name, false AS aggregator FROM region"),
        "components": relation(src, "SUP").selectExpr("CAST(s_suppkey AS STRING) AS id", "s_name AS name", "'service' AS stereotype", "'service' AS layer", "module"),
        "injections": _injections(src), "datastores": relation(src, "DS"), "facts": facts,
    }


_SRC = "'component:' || component"
RELATIONS["FE"] = (
    "SELECT 'module:' || module AS src, 'component:' || s_suppkey AS dst, 'contains' AS kind, NULL AS detail FROM SUP UNION ALL "
    "SELECT 'component:' || component, 'component:' || target, 'injects', field FROM INJ UNION ALL "
    "SELECT 'module:' || module, 'datastore:postgresql:' || host || '/main', 'connects', profile FROM DS UNION ALL "
    f"SELECT {_SRC}, CASE WHEN technology = 'jpa' AND d.host IS NOT NULL THEN 'datastore:postgresql:' || d.host || '/main' ELSE 'store:' || f.module || ':' || technology END, "
    "lower(coalesce(operation, 'uses')), item FROM FACTS f LEFT JOIN DS d ON f.module = d.module WHERE kind = 'database' UNION ALL "
    f"SELECT {_SRC}, 'cache:' || module || ':redis', lower(coalesce(operation, 'uses')), item FROM FACTS WHERE kind = 'cache' UNION ALL "
    f"SELECT {_SRC}, 'broker:kafka', 'publishes', item FROM FACTS WHERE kind = 'messaging' UNION ALL "
    f"SELECT {_SRC}, coalesce('module:' || target_module, 'external:' || host), 'http', http_method || ' ' || url FROM FACTS WHERE kind = 'http' UNION ALL "
    f"SELECT {_SRC}, 'storage:s3', lower(coalesce(operation, 'uses')), item FROM FACTS WHERE kind = 'storage' UNION ALL "
    "SELECT 'module:' || module, 'module:' || target_module, 'http', http_method || ' ' || url FROM FACTS WHERE target_module IS NOT NULL")


@query("build_edges", oracle(
    "SELECT e.src, e.dst, e.kind, coalesce(details, '') AS details FROM (SELECT DISTINCT src, dst, kind FROM FE WHERE src <> dst OR src LIKE 'module:%') e LEFT JOIN ("
    + _top("(SELECT *, 0 AS pos FROM FE WHERE detail IS NOT NULL)", "src, dst, kind", 50) + ") t ON e.src = t.src AND e.dst = t.dst AND e.kind = t.kind"))
def build_edges(src: Source):
    return _joined(graph.build_graph(_model(src))[1], "src", "dst", "kind")


@query("build_nodes", oracle(
    "SELECT 'module:region-' || r_regionkey AS id, 'module' AS type, r_name AS name FROM region UNION ALL "
    "SELECT 'component:' || s_suppkey, 'component', s_name FROM SUP UNION ALL "
    "SELECT DISTINCT dst, split_part(dst, ':', 1).replace('store', 'datastore').replace('datadatastore', 'datastore').replace('external', 'external_service'), "
    "CASE WHEN dst LIKE 'external:%' THEN substr(dst, 10) ELSE '' END FROM FE WHERE dst NOT LIKE 'module:%' AND dst NOT LIKE 'component:%'"))
def build_nodes(src: Source):
    return graph.build_graph(_model(src))[0].select("id", "type", F.coalesce("name", F.lit("")).alias("name"))


# ---------------------------------------------------------------- roll-ups

@query("topic_topology", (
    "SELECT DISTINCT 'kafka' AS technology, event_type AS destination, CASE WHEN value < 20 THEN 'producer' ELSE 'consumer' END AS role, 'user-' || user_id AS member FROM events"))
def topic_topology(src: Source):
    e = src.table("events").select(F.lit("kafka").alias("technology"), F.col("event_type").alias("destination"),
                                   F.concat(F.lit("user-"), "user_id").alias("who"), "value")
    return graph.topic_topology(e.where("value < 20").withColumnRenamed("who", "source"), e.where("value >= 20").withColumnRenamed("who", "handler"))


@query("topic_counts", (
    "SELECT 'kafka' AS technology, event_type AS destination, count(DISTINCT user_id) FILTER (value < 20) AS producers, "
    "count(DISTINCT user_id) FILTER (value >= 20) AS consumers FROM events GROUP BY event_type"))
def topic_counts(src: Source):
    return graph.topic_counts(topic_topology(src))


RELATIONS["FT"] = ("SELECT 'part-' || l_partkey AS \"table\", CASE WHEN l_linestatus = 'F' THEN 'jpa' ELSE 'jdbc' END AS technology, "
                   "CASE l_returnflag WHEN 'A' THEN 'READ' WHEN 'N' THEN 'WRITE' END AS operation, 'sup-' || l_suppkey AS source, module, "
                   "l_orderkey * 10 + l_linenumber AS pos FROM lineitem JOIN SUP ON l_suppkey = s_suppkey")


@query("table_access", oracle(
    "SELECT 'part-' || p_partkey AS \"table\", CASE WHEN p_size < 25 THEN 'mongodb' ELSE (SELECT min_by(technology, pos) FROM FT WHERE \"table\" = 'part-' || p_partkey) END AS store, "
    "coalesce((SELECT string_agg(DISTINCT operation, ',' ORDER BY operation) FROM FT WHERE \"table\" = 'part-' || p_partkey), '') AS operations, "
    "CASE WHEN p_size < 25 THEN 1 ELSE 0 END AS entities, (SELECT count(DISTINCT source) FROM FT WHERE \"table\" = 'part-' || p_partkey) AS accessed_by, "
    "(SELECT count(DISTINCT module) FROM (SELECT module, \"table\" AS t FROM FT UNION ALL SELECT p_brand, 'part-' || q.p_partkey FROM part q WHERE q.p_size < 25) "
    "WHERE t = 'part-' || part.p_partkey) AS modules FROM part"))
def table_access(src: Source):
    facts = src.sql(_spark_sql("FT"))
    entities = src.sql("SELECT 'part-' || p_partkey AS `table`, 'mongodb' AS store, p_name AS entity, p_brand AS module, p_partkey AS pos FROM part WHERE p_size < 25")
    return graph.table_access(facts, entities).withColumn("operations", F.array_join("operations", ","))


def _spark_sql(name: str) -> str:
    """A relation whose quoted names need Spark's quoting."""
    return oracle(f"SELECT * FROM {name}").replace('"', "`")


@query("facts_by_kind", oracle("SELECT technology, operation, item, min(pos) AS pos FROM FACTS WHERE kind = 'database' GROUP BY ALL"))
def facts_by_kind(src: Source):
    return graph.facts_by_kind(relation(src, "FACTS"), "database", ["technology", "operation", "item"])


@query("model_summary", (
    "SELECT 'modules' AS metric, '' AS name, CAST(count(*) FILTER (n_name <> 'NATION_3') AS VARCHAR) AS value FROM nation UNION ALL "
    "SELECT 'apps', '', CAST(count(*) FILTER (n_regionkey <> 2) AS VARCHAR) FROM nation UNION ALL SELECT 'style', '', 'microservices' UNION ALL "
    "SELECT 'components', p_type, CAST(count(*) AS VARCHAR) FROM part GROUP BY p_type UNION ALL "
    "SELECT DISTINCT 'technology', p_type, p_brand FROM part WHERE p_type <> 'PROMO'"))
def model_summary(src: Source):
    modules = src.table("nation").selectExpr("n_name AS path", "n_regionkey <> 2 AS is_app", "n_name = 'NATION_3' AS aggregator")
    p = src.table("part")
    deps = p.selectExpr("CASE WHEN p_type = 'PROMO' THEN 'test' ELSE p_type END AS category", "p_brand AS technology")
    return graph.model_summary(modules, p.selectExpr("p_type AS stereotype"), deps)


@query("module_rollup", (
    "WITH c AS (SELECT 'm' || c_nationkey AS module, c_mktsegment AS s FROM customer) SELECT 'm' || n_nationkey AS module, "
    "(SELECT string_agg(s || '=' || n, ',' ORDER BY s) FROM (SELECT s, count(*) AS n FROM c WHERE module = 'm' || n_nationkey GROUP BY s)) AS type_counts, "
    "(SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS endpoint_count, "
    "(SELECT string_agg(DISTINCT 'web: ' || o_orderpriority, ',' ORDER BY 'web: ' || o_orderpriority) FROM orders JOIN customer ON o_custkey = c_custkey "
    "WHERE c_nationkey = n_nationkey AND o_orderstatus = 'F') AS technologies, false AS aggregator FROM nation"))
def module_rollup(src: Source):
    modules = src.sql("SELECT 'm' || n_nationkey AS module, 'pom' AS packaging, 0 AS config_files FROM nation")
    types = src.sql("SELECT 'm' || c_nationkey AS module, c_mktsegment AS stereotype FROM customer")
    ends = src.sql("SELECT 'm' || s_nationkey AS module FROM supplier")
    deps = src.sql("SELECT 'm' || c_nationkey AS module, 'web' AS category, o_orderpriority AS technology, CASE o_orderstatus WHEN 'F' THEN 'compile' ELSE 'test' END AS scope_ "
                   "FROM orders JOIN customer ON o_custkey = c_custkey")
    counts = F.array_join(F.transform(F.map_entries("type_counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return graph.module_rollup(modules, types, ends, deps).select("module", counts.alias("type_counts"), "endpoint_count",
                                                                  F.array_join("technologies", ",").alias("technologies"), "aggregator")


@query("security_summary", (
    "SELECT 'm' || n_nationkey AS module, coalesce((SELECT string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 9900), '') AS technologies, "
    "coalesce((SELECT string_agg(DISTINCT CASE WHEN s_acctbal < 0 THEN 'csrf disabled' ELSE 'jwt' END, ',' ORDER BY CASE WHEN s_acctbal < 0 THEN 'csrf disabled' ELSE 'jwt' END) "
    "FROM supplier WHERE s_nationkey = n_nationkey), '') AS mechanisms, EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal < 0) AS csrf_disabled, "
    "(SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 0) AS endpoints_with_method_security, "
    "EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey) OR EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 9900) AS enabled FROM nation"))
def security_summary(src: Source):
    modules = src.sql("SELECT 'm' || n_nationkey AS module FROM nation")
    deps = src.sql("SELECT 'm' || c_nationkey AS module, CASE WHEN c_acctbal > 9900 THEN 'security' ELSE 'web' END AS category, c_mktsegment AS technology FROM customer")
    mech = src.sql("SELECT 'm' || s_nationkey AS module, CASE WHEN s_acctbal < 0 THEN 'csrf disabled' ELSE 'jwt' END AS mechanism FROM supplier")
    ends = src.sql("SELECT 'm' || c_nationkey AS module, CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END AS annotations FROM customer")
    out = graph.security_summary(modules, deps, mech, ends, ["module"])
    return out.withColumn("technologies", F.array_join("technologies", ",")).withColumn("mechanisms", F.array_join("mechanisms", ","))
