"""Endpoint relations: callers, lookups, shared resources and the composed impact record."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import diff, relations, verdict
from ..session import cut_lineage
from . import verdict_queries  # noqa: F401 - the composed texts read its registered SQL
from .bindings import RELATIONS, oracle, relation, snapshot
from .registry import ORACLE, Source, query

K = ("api",)
_PATH = "regexp_extract(url, '^\\\\w+://[^/]+([^?]*)', 1)"
_TLD = "regexp_extract(url, '^\\\\w+://[^/]*?\\\\.(com|net|org)', 1)"


def _duck(text: str) -> str:
    return text.replace("\\\\", "\\")


# every page is a call of its host's module; templates are the page paths with numbers as variables
RELATIONS["PG_CALLS"] = _duck(f"SELECT page_id, {_TLD} AS module, {_PATH} AS path, url, CASE WHEN contains(url, 'utm') THEN 'POST' WHEN url LIKE 'https%' THEN 'GET' ELSE 'ANY' END AS verb FROM pages")
RELATIONS["PG_ENDS"] = _duck("SELECT DISTINCT module, regexp_replace(path, '\\\\d+', '{id}') AS path, 'GET' AS method FROM PG_CALLS UNION SELECT DISTINCT module, '/{lang}/{id}', 'POST' FROM PG_CALLS")


def _calls(src: Source):
    return src.sql(f"SELECT page_id, {_TLD} AS module, {_PATH} AS path, url, CASE WHEN contains(url, 'utm') THEN 'POST' WHEN url LIKE 'https%' THEN 'GET' ELSE 'ANY' END AS verb FROM pages")


def _ends(src: Source):
    calls = _calls(src)
    own = calls.select("module", F.regexp_replace("path", r"\d+", "{id}").alias("path"), F.lit("GET").alias("method"))
    wide = calls.select("module", F.lit("/{lang}/{id}").alias("path"), F.lit("POST").alias("method"))
    return own.unionByName(wide).distinct()


_REGEX = ("'^/' || array_to_string(list_transform(string_split(regexp_replace(e.path, '^/+|/+$', '', 'g'), '/'), lambda s: CASE WHEN regexp_full_match(s, '\\{[^}]+\\}') "
          "THEN '[^/]+' ELSE regexp_escape(s) END), '/') || '/?$'")
_SERVED = (f"SELECT e.module || ' ' || e.path || ' ' || e.method AS endpoint, 'service_call' AS kind, 'page-' || c.page_id AS caller, c.verb || ' ' || c.url AS detail FROM PG_CALLS c JOIN PG_ENDS e ON e.module = c.module "
           f"AND regexp_matches(c.path, {_REGEX}) AND c.verb IN (e.method, 'ANY')")
_ROUTED = ("SELECT e.module || ' ' || e.path || ' ' || e.method, 'gateway_route', 'gate', r.detail FROM PG_ENDS e JOIN "
           "(SELECT DISTINCT module, regexp_extract(path, '^/([^/]+)', 1) AS lang, 'Path=/' || regexp_extract(path, '^/([^/]+)', 1) || '/**, Path=/none' AS detail FROM PG_CALLS) r "
           "ON e.module = r.module AND starts_with(e.path, '/' || r.lang || '/')")


@query("consumers", oracle(f"SELECT DISTINCT * FROM ({_SERVED} UNION ALL {_ROUTED})"))
def consumers(src: Source):
    calls, ends = _calls(src), _ends(src)
    target = F.concat(F.lit("module:"), "module").alias("dst")
    detail = F.concat_ws(" ", "verb", "url")
    by_component = calls.select(F.concat(F.lit("component:"), "page_id").alias("src"), target, F.lit("http").alias("kind"), detail.alias("detail"))
    # the same calls lifted to the module of the page: twins that must vanish
    lifted = calls.select(F.concat(F.lit("module:own-"), "page_id").alias("src"), target, F.lit("http").alias("kind"), detail.alias("detail"))
    lang = F.regexp_extract("path", "^/([^/]+)", 1)
    gates = calls.select(F.lit("module:gate").alias("src"), target, F.lit("routes").alias("kind"), F.concat(F.lit("Path=/"), lang, F.lit("/**, Path=/none")).alias("detail")).distinct()
    nodes = (calls.select(F.concat(F.lit("component:"), "page_id").alias("id"), F.lit("component").alias("type"), F.concat(F.lit("page-"), "page_id").alias("name"), F.concat(F.lit("own-"), "page_id").alias("module"))
             .unionByName(calls.select(F.concat(F.lit("module:own-"), "page_id").alias("id"), F.lit("module").alias("type"), F.concat(F.lit("mod-"), "page_id").alias("name"), F.concat(F.lit("own-"), "page_id").alias("module")))
             .unionByName(gates.select(F.col("src").alias("id"), F.lit("module").alias("type"), F.lit("gate").alias("name"), F.lit("gate").alias("module")).distinct()))
    endpoint = F.concat_ws(" ", "module", "path", "method")
    e = ends.withColumn("endpoint", endpoint).withColumn("context_path", F.lit(""))
    return relations.consumers(by_component.unionByName(lifted).unionByName(gates), nodes, e).select("endpoint", "kind", "caller", "detail")


@query("url_path", _duck(f"SELECT page_id, {_PATH} AS url_path, 'GET' AS verb, {_PATH} AS bare FROM pages WHERE {_PATH} <> ''"))
def url_path(src: Source):
    p = src.table("pages")
    full = F.concat(F.lit("GET "), "url")
    rows = p.select("page_id", relations.url_path(full).alias("url_path"), relations.call_verb(full).alias("verb"), relations.url_path(F.col("url")).alias("bare"))
    return rows.where("url_path IS NOT NULL")


@query("path_regex", oracle(
    f"SELECT module, path, regexp_matches('/en/7', {_REGEX}) AS hits_concrete, regexp_matches('/en/{{x}}/', {_REGEX}) AS hits_template, regexp_matches('/en/7/8', {_REGEX}) AS hits_longer FROM PG_ENDS e"))
def path_regex(src: Source):
    e = _ends(src).withColumn("_r", relations.path_regex(F.col("path")))
    hit = lambda text, name: F.rlike(F.lit(text), F.col("_r")).alias(name)
    return e.select("module", "path", hit("/en/7", "hits_concrete"), hit("/en/{x}/", "hits_template"), hit("/en/7/8", "hits_longer"))


@query("gateway_match", (
    "SELECT page_id, starts_with(path, '/fr/') AS any_french, regexp_matches(path, '^/[^/]*/9') AS nine FROM (SELECT page_id, " + _duck(_PATH) + " AS path FROM pages)"))
def gateway_match(src: Source):
    p = src.sql(f"SELECT page_id, {_PATH} AS path FROM pages")
    hit = lambda pattern, name: F.rlike(F.col("path"), relations.gateway_regex(F.lit(pattern))).alias(name)
    return p.select("page_id", hit("Path=/fr/**", "any_french"), hit(" /*/9 ", "nine"))


# ---------------------------------------------------------------- lookups

RELATIONS["EPS"] = ("SELECT p_partkey AS endpoint, CASE WHEN p_size < 10 THEN 'doc' || p_partkey END AS doc_name, p_brand || '.' || replace(p_name, ' ', '') AS handler, p_type AS method, '/' || p_size AS path, p_partkey AS pos FROM part")
RELATIONS["ASK"] = ("SELECT DISTINCT CASE WHEN l_returnflag = 'A' THEN replace(a.p_name, ' ', '') WHEN l_returnflag = 'N' THEN a.p_brand || '.' || replace(a.p_name, ' ', '') ELSE 'doc' || a.p_partkey END AS api, "
                    "b.p_brand || '.' || replace(a.p_name, ' ', '') AS handler, b.p_type AS method, '/' || b.p_size AS path FROM lineitem JOIN part a ON l_partkey = a.p_partkey JOIN part b ON l_suppkey = b.p_partkey")


@query("find_endpoint", oracle(
    "SELECT api, handler, method, path, min_by(endpoint, rank) AS endpoint FROM (SELECT a.*, e.endpoint, (CASE WHEN e.handler = a.handler THEN 0 WHEN e.method = a.method AND e.path = a.path THEN 1 ELSE 2 END) * 100000000 + e.pos AS rank "
    "FROM ASK a JOIN EPS e ON a.api IN (e.doc_name, e.handler, split_part(e.handler, '.', 2))) GROUP BY api, handler, method, path"))
def find_endpoint(src: Source):
    return relations.find_endpoint(relation(src, "ASK"), relation(src, "EPS"))


@query("module_runtime_lookup", (
    "SELECT c_custkey, CASE WHEN n_nationkey IS NULL THEN 'n' || (c_nationkey + 5) WHEN n_regionkey = 0 THEN 'app-' || n_name ELSE n_name END AS module_name, "
    "CASE WHEN n_regionkey = 1 THEN '/ctx' ELSE '' END AS context_path FROM customer LEFT JOIN nation ON c_nationkey + 5 = n_nationkey"))
def module_runtime_lookup(src: Source):
    modules = src.sql("SELECT 'n' || n_nationkey AS path, CASE WHEN n_regionkey = 0 THEN 'app-' || n_name ELSE '' END AS app_name, n_name AS name, CASE WHEN n_regionkey = 1 THEN '/ctx' END AS context_path FROM nation")
    refs = src.sql("SELECT c_custkey, 'n' || (c_nationkey + 5) AS module FROM customer")
    return relations.module_runtime_lookup(refs, modules).select("c_custkey", "module_name", "context_path")


# ---------------------------------------------------------------- shared resources

# orders share the parts they list
RELATIONS["USE"] = "SELECT DISTINCT 'table' AS kind, 'part-' || l_partkey AS name, 'order-' || l_orderkey AS \"user\" FROM lineitem"
RELATIONS["HUB"] = "SELECT name, count(*) AS users FROM USE GROUP BY name HAVING count(*) > 1"


def _usage(src: Source):
    return src.sql("SELECT DISTINCT 'table' AS kind, 'part-' || l_partkey AS name, 'order-' || l_orderkey AS user FROM lineitem")


@query("resource_users", oracle("SELECT u.kind, u.name, u.\"user\", h.users FROM USE u JOIN HUB h ON u.name = h.name"))
def resource_users(src: Source):
    return relations.resource_users(_usage(src))


@query("shared_resources", oracle("SELECT u.kind, u.name, u.\"user\", h.users - 1 AS others FROM USE u JOIN HUB h ON u.name = h.name"))
def shared_resources(src: Source):
    return relations.shared_resources(_usage(src))


@query("first_sharers", oracle(
    "SELECT u.kind, u.name, u.\"user\", h.users - 1 AS others, array_to_string(list_filter(t.first, lambda x: x <> u.\"user\")[1:8], ',') AS also_used_by FROM USE u JOIN HUB h ON u.name = h.name JOIN "
    "(SELECT name, list(\"user\" ORDER BY \"user\")[1:9] AS first FROM USE GROUP BY name) t ON t.name = u.name"))
def first_sharers(src: Source):
    return relations.first_sharers(_usage(src)).select("kind", "name", "user", "others", F.array_join("also_used_by", ",").alias("also_used_by"))


@query("published_topics", (
    "WITH l AS (SELECT DISTINCT event_type, user_id FROM events WHERE value > 50) SELECT DISTINCT 'part-' || l_partkey AS \"user\", t AS name, 'kafka' AS technology, "
    "(SELECT count(*) FROM l WHERE event_type = t) AS others FROM (SELECT *, CASE l_returnflag WHEN 'A' THEN 'click' WHEN 'N' THEN 'view' ELSE 'nobody' END AS t FROM lineitem) WHERE t <> 'nobody'"))
def published_topics(src: Source):
    sends = src.sql("SELECT 'part-' || l_partkey AS user, CASE l_returnflag WHEN 'A' THEN 'click' WHEN 'N' THEN 'view' ELSE 'nobody' END AS name FROM lineitem")
    hears = src.sql("SELECT event_type AS destination, 'kafka' AS technology, 'user-' || user_id AS member FROM events WHERE value > 50")
    return relations.published_topics(sends, hears).select("user", "name", "technology", "others")


# the orders asked for; they are compared with all orders
_TARGET = "SELECT 'order-' || o_orderkey AS {0} FROM orders WHERE o_orderkey % 100 = 0"


@query("affected_apis", oracle(
    "SELECT t.u AS target, x.affected FROM (" + _TARGET.format("u") + ") t, LATERAL (SELECT DISTINCT v.\"user\" AS affected FROM USE m JOIN USE v ON m.name = v.name WHERE m.\"user\" = t.u AND v.\"user\" <> t.u "
    "UNION SELECT CASE o_orderstatus WHEN 'F' THEN 'cust-' || o_custkey ELSE 'mod-' || o_custkey END FROM orders WHERE 'order-' || o_orderkey = t.u) x"))
def affected_apis(src: Source):
    callers = src.sql("SELECT 'order-' || o_orderkey AS endpoint, 'cust-' || o_custkey AS caller, CASE o_orderstatus WHEN 'F' THEN '' ELSE 'mod-' || o_custkey END AS caller_module FROM orders")
    return relations.affected_apis(src.sql(_TARGET.format("user")), callers, _usage(src))


@query("affected_rows", oracle(
    "SELECT 'order-' || o_orderkey AS api, 'caller' AS kind, 'cust-' || o_custkey AS name, 'mod-' || o_custkey AS module, CASE o_orderstatus WHEN 'F' THEN 'Routes requests to this API' ELSE 'Calls this API' END AS how, "
    "'GET /' || o_orderkey AS detail FROM orders WHERE o_orderkey % 100 = 0 UNION ALL "
    "SELECT m.\"user\", 'shares', v.\"user\", '', 'Shares table ' || m.name, '' FROM (SELECT USE.* FROM USE JOIN (" + _TARGET.format("t") + ") ON \"user\" = t) m JOIN USE v ON m.name = v.name AND m.\"user\" <> v.\"user\""))
def affected_rows(src: Source):
    callers = src.sql("SELECT 'order-' || o_orderkey AS api, 'cust-' || o_custkey AS caller, 'mod-' || o_custkey AS caller_module, CASE o_orderstatus WHEN 'F' THEN 'gateway_route' ELSE 'service_call' END AS kind, "
                      "'GET /' || o_orderkey AS detail FROM orders")
    return verdict.affected_rows(src.sql(_TARGET.format("api")), callers, _usage(src).withColumnRenamed("name", "resource"), K)


# ---------------------------------------------------------------- composed impact

RELATIONS["CALLERS"] = ("SELECT DISTINCT 'part-' || l_partkey AS api, 'cust-' || o_custkey AS caller, CASE WHEN o_orderstatus = 'F' THEN 'mod-' || o_orderpriority ELSE '' END AS caller_module "
                        "FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
RELATIONS["SHARE"] = ("SELECT 'part-' || l_partkey AS api, CASE WHEN l_returnflag = 'A' THEN 'table' ELSE 'cache' END AS kind, 'sup-' || l_suppkey AS name, CAST(count(*) AS BIGINT) AS others "
                      "FROM lineitem GROUP BY l_partkey, CASE WHEN l_returnflag = 'A' THEN 'table' ELSE 'cache' END, l_suppkey")
_FLAGS = (f"SELECT api, bool_or(severity = 'breaking' AND (type LIKE 'VALIDATION_ADDED' OR type IN ('VALIDATION_CHANGED', 'PARAM_NOW_REQUIRED', 'REQUEST_FIELD_ADDED'))) AS stricter, "
          f"bool_or(severity = 'breaking' AND type LIKE 'RESPONSE\\_%' ESCAPE '\\') AS response, bool_or(type = 'SECURITY_CHANGED') AS access FROM ({ORACLE['compare_changes']}) GROUP BY api")
_IMPACT = (
    f"SELECT v.api, v.breaking, CASE WHEN breaking > 0 AND (coalesce(c.n, 0) > 0 OR coalesce(s.n, 0) > 0) THEN 'high' WHEN breaking > 0 THEN 'medium' ELSE 'low' END AS impact_level, coalesce(c.n, 0) AS caller_count, "
    "coalesce(s.n, 0) AS shared_count, coalesce(s.users, 0)::BIGINT AS shared_users, coalesce(d.db, false) AS db, coalesce(f.stricter, false) AS stricter, coalesce(f.response, false) AS response, coalesce(f.access, false) AS access, s.names AS shared_names "
    f"FROM ({ORACLE['endpoint_verdict']}) v LEFT JOIN ({_FLAGS}) f ON f.api = v.api "
    "LEFT JOIN (SELECT api, count(*) AS n FROM CALLERS GROUP BY api) c ON c.api = v.api "
    "LEFT JOIN (SELECT api, count(*) AS n, sum(others) FILTER (kind = 'table') AS users, array_to_string(list(DISTINCT name ORDER BY name) FILTER (kind = 'table')[1:3], ', ') AS names FROM SHARE GROUP BY api) s ON s.api = v.api "
    f"LEFT JOIN (SELECT api, bool_or(grp = 'databases') AS db FROM ({ORACLE['diff_downstream']}) GROUP BY api) d ON d.api = v.api")
_NOTES = ("SELECT api, 'New downstream ' || replace(grp, '_', ' ') || ': ' || array_to_string(list(DISTINCT item ORDER BY item)[1:3], ', ') || ' - check availability, permissions and load' AS note "
          f"FROM ({ORACLE['diff_downstream']}) WHERE change = 'added' GROUP BY api, grp")


@query("endpoint_impact", oracle(f"SELECT api, impact_level, breaking > 0 AS migration_required, caller_count, shared_count, shared_users FROM ({_IMPACT})"))
def endpoint_impact(src: Source):
    return _impact(src).select("api", "impact_level", "migration_required", "caller_count", "shared_count", "shared_users")


def _impact(src: Source):
    base, head = snapshot(src, "base"), snapshot(src, "head")
    found = cut_lineage(diff.contract_changes(base, head, K, downstream=True, told=diff.TOLD_DELTA))
    return relations.endpoint_impact(verdict.endpoint_verdict(found, None, K), verdict.recommendation_inputs(found.where("severity <> 'delta'"), K),
                                     relation(src, "CALLERS"), relation(src, "SHARE"), diff.delta_of(found, K))


_NO_NAME = "CAST(NULL AS VARCHAR) AS name"


@query("recommendations", oracle(
    f"SELECT * FROM (WITH i AS MATERIALIZED ({_IMPACT}), r AS (SELECT api, breaking || ' breaking change(s): version the endpoint or keep the old contract until clients migrate' AS recommendation, {_NO_NAME} FROM i WHERE breaking > 0 UNION ALL "
    "SELECT i.api, 'Coordinate the release with calling services', c.name FROM i JOIN (SELECT DISTINCT api, coalesce(nullif(caller_module, ''), caller) AS name FROM CALLERS) c ON c.api = i.api WHERE breaking > 0 UNION ALL "
    "SELECT api, 'Stricter input rules: requests that passed before can now fail with 400 - check client payloads', NULL FROM i WHERE stricter UNION ALL "
    "SELECT api, 'Response shape changed: update client deserialization and contract tests', NULL FROM i WHERE response UNION ALL "
    "SELECT api, 'Access rules changed: verify roles/scopes of every client', NULL FROM i WHERE access UNION ALL "
    f"SELECT i.api, n.note, NULL FROM i JOIN ({_NOTES}) n ON n.api = i.api UNION ALL "
    "SELECT api, 'Shares data with ' || shared_users || ' other endpoint(s) through ' || shared_names || ': regression-test them', NULL FROM i WHERE shared_users > 0 AND (breaking > 0 OR db)) "
    "SELECT * FROM r UNION ALL SELECT api, 'No contract change detected between these versions', NULL FROM i WHERE api NOT IN (SELECT api FROM r))"))
def recommendations(src: Source):
    return verdict.recommendation_rows(_impact(src), relation(src, "CALLERS"), K)


@query("stored_change_severity", oracle(
    "SELECT dto, field, type, CASE WHEN type IN ('FIELD_REMOVED', 'TYPE_CHANGED', 'VALIDATION_ADDED', 'VALIDATION_CHANGED') OR required THEN 'breaking' ELSE 'minor' END AS severity "
    f"FROM ({ORACLE['model_field_changes']})"))
def stored_change_severity(src: Source):
    from .diff_queries import model_field_changes
    rows = model_field_changes(src)
    return rows.select("dto", "field", "type", relations.stored_change_severity(F.col("type"), F.col("required")).alias("severity"))


# parts of every tenth size have no route: of those the model's own lists are shown
RELATIONS["GEND"] = "SELECT 'part-' || p_partkey AS center, 'GET /' || p_partkey AS label, p_size % 10 <> 0 AS has_route FROM part"
RELATIONS["GUSE"] = ("SELECT DISTINCT 'part-' || l_partkey AS center, CASE l_linenumber % 4 WHEN 0 THEN 'cache' WHEN 1 THEN 'service' ELSE 'table' END AS kind, 'sup-' || l_suppkey AS name, "
                     "CASE l_linenumber % 4 WHEN 0 THEN 'GET' WHEN 1 THEN 'http' ELSE 'READ' END AS operation, "
                     "CASE l_linenumber % 4 WHEN 0 THEN 'redis' WHEN 1 THEN 'POST /pay/' || l_suppkey ELSE 'repo.find' || l_linenumber END AS detail FROM lineitem")
RELATIONS["GDECL"] = ("SELECT DISTINCT 'part-' || l_partkey AS center, CASE l_returnflag WHEN 'A' THEN 'table' WHEN 'N' THEN 'topic' ELSE 'service' END AS kind, 'sup-' || l_suppkey AS name FROM lineitem")
RELATIONS["GSHOW"] = ("SELECT u.* FROM GUSE u JOIN GEND e ON e.center = u.center AND e.has_route UNION ALL SELECT d.center, d.kind, d.name, "
                      "CASE d.kind WHEN 'topic' THEN 'publish' WHEN 'service' THEN 'http' ELSE 'uses' END, '' FROM GDECL d JOIN GEND e ON e.center = d.center AND NOT e.has_route")
RELATIONS["GTABLE"] = "SELECT DISTINCT center, name FROM GUSE WHERE kind = 'table'"
RELATIONS["GNEAR"] = ("SELECT u.center, u.name, unnest(list_filter(t.first, lambda x: x <> u.center)[1:8]) AS other FROM GTABLE u JOIN "
                      "(SELECT name, list(center ORDER BY center)[1:9] AS first FROM GTABLE GROUP BY name) t ON t.name = u.name")


def _of_centers(src: Source, code: str, *columns: str):
    """Distinct rows of a part, a supplier's number and a code of its lines, told as columns. They are dealt out by the part as they are and made distinct there, so that the endpoints
    meet them without another shuffle."""
    told = src.sql(f"SELECT 'part-' || l_partkey AS center, l_suppkey, {code} AS code FROM lineitem").repartition("center").distinct()
    return told.selectExpr("center", *columns)


def _graph(src: Source):
    # the rows of GUSE and GDECL; line numbers that are told alike have one code
    use = _of_centers(src, "CASE WHEN l_linenumber % 4 IN (0, 1) THEN l_linenumber % 4 ELSE l_linenumber END",
                      "CASE code % 4 WHEN 0 THEN 'cache' WHEN 1 THEN 'service' ELSE 'table' END AS kind", "'sup-' || l_suppkey AS name", "CASE code % 4 WHEN 0 THEN 'GET' WHEN 1 THEN 'http' ELSE 'READ' END AS operation",
                      "CASE code % 4 WHEN 0 THEN 'redis' WHEN 1 THEN 'POST /pay/' || l_suppkey ELSE 'repo.find' || code END AS detail")
    declared = _of_centers(src, "CASE l_returnflag WHEN 'A' THEN 'table' WHEN 'N' THEN 'topic' ELSE 'service' END", "code AS kind", "'sup-' || l_suppkey AS name")
    tables = relation(src, "GUSE").where("kind = 'table'").select("kind", "name", F.col("center").alias("user")).distinct()
    near = relations.first_sharers(tables).withColumnRenamed("user", "center")
    # the rows of GCALL: numbers are made distinct, and texts of what is left
    callers = src.sql("SELECT 'part-' || l_partkey AS center, 'cust-' || o_custkey AS caller, CASE WHEN called THEN 'service_call' ELSE 'gateway_route' END AS kind, 'GET /' || l_partkey AS detail "
                      "FROM (SELECT DISTINCT l_partkey, o_custkey, o_orderstatus <=> 'F' AS called FROM lineitem JOIN orders ON l_orderkey = o_orderkey)")
    return relations.impact_graph(relation(src, "GEND"), callers, use, near, declared=declared)


RELATIONS["GCALL"] = ("SELECT DISTINCT 'part-' || l_partkey AS center, 'cust-' || o_custkey AS caller, CASE WHEN o_orderstatus = 'F' THEN 'service_call' ELSE 'gateway_route' END AS kind, 'GET /' || l_partkey AS detail "
                      "FROM lineitem JOIN orders ON l_orderkey = o_orderkey")


@query("impact_graph_nodes", oracle(
    "SELECT 'part-' || p_partkey AS center, 'endpoint:GET /' || p_partkey AS id, 'GET /' || p_partkey AS label, 'endpoint' AS type FROM part UNION "
    "SELECT center, 'caller:' || caller, caller, max(CASE kind WHEN 'gateway_route' THEN 'gateway_route' ELSE '' END) || CASE WHEN max(kind) = 'service_call' AND min(kind) = 'service_call' THEN 'service_call' ELSE '' END FROM GCALL GROUP BY center, caller UNION "
    "SELECT center, kind || ':' || name, name, kind FROM GSHOW UNION SELECT center, 'table:' || name, name, 'table' FROM GNEAR UNION SELECT center, 'api:' || other, other, 'related_endpoint' FROM GNEAR"))
def impact_graph_nodes(src: Source):
    return _graph(src)[0]


@query("impact_graph", oracle(
    "SELECT center, 'caller:' || caller AS source, 'endpoint:GET /' || substr(center, 6) AS target, CASE kind WHEN 'service_call' THEN 'calls this API' ELSE 'routes to' END AS kind, detail FROM GCALL UNION ALL "
    "SELECT center, 'endpoint:GET /' || substr(center, 6), kind || ':' || name, lower(operation), detail FROM GSHOW UNION ALL SELECT center, 'api:' || other, 'table:' || name, 'shares', '' FROM GNEAR"))
def impact_graph(src: Source):
    return _graph(src)[1]
