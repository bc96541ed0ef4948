"""Reports, files, stored tables and normalised routes on relations built from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import normalize, versions
from ..sources import files, reports, store
from .bindings import RELATIONS, oracle, relation
from .registry import Source, query

# ---------------------------------------------------------------- reports

# one uploaded report per event: errors are no JSON, signups have no routes, purchases use the older field names
_REPORT = ("CASE event_type WHEN 'error' THEN 'oops ' || props WHEN 'signup' THEN '{\"repository\":\"r\"}' WHEN 'purchase' THEN "
           "'{\"repository\":\"r' || user_id || '\",\"commit\":\"c' || event_id || '\",\"routes\":[{\"function_name\":\"old_' || user_id || '\",\"method\":\"PUT\",\"path\":\"/o\",\"parameters\":[{\"name\":\"p\",\"type\":\"int\"}]}]}' "
           "ELSE '{\"repository\":\"r' || user_id || '\",\"commit\":\"c' || event_id || '\",\"routes\":[{\"handler\":\"H.' || event_type || '\",\"method\":\"GET\",\"path\":\"/u/' || user_id || '\",\"params\":[]},"
           "{\"method\":\"POST\",\"path\":\"/x\",\"extra\":1}]}' END")


def _reports(src: Source):
    return reports.parse_reports(src.sql(f"SELECT event_id, event_type, {_REPORT} AS report FROM events"))


@query("read_reports", (
    "SELECT event_type, count(*) AS n, count(*) FILTER (event_type NOT IN ('error', 'signup')) AS good, "
    "(CASE event_type WHEN 'error' THEN 0 WHEN 'signup' THEN 0 WHEN 'purchase' THEN count(*) ELSE 2 * count(*) END)::BIGINT AS routes FROM events GROUP BY event_type"))
def read_reports(src: Source):
    size = F.when(F.col("is_report"), F.size("r.routes")).otherwise(0)
    return _reports(src).groupBy("event_type").agg(F.count("*").alias("n"), F.count_if("is_report").alias("good"), F.sum(size).alias("routes"))


RELATIONS["ROUTES"] = (
    "SELECT event_id, 0 AS pos, CASE event_type WHEN 'purchase' THEN 'old_' || user_id ELSE 'H.' || event_type END AS api, CASE event_type WHEN 'purchase' THEN 'PUT' ELSE 'GET' END AS method, "
    "CASE event_type WHEN 'purchase' THEN '/o' ELSE '/u/' || user_id END AS path, CASE event_type WHEN 'purchase' THEN 1 ELSE 0 END AS n_params FROM events WHERE event_type NOT IN ('error', 'signup') UNION ALL "
    "SELECT event_id, 1, 'POST /x', 'POST', '/x', 0 FROM events WHERE event_type NOT IN ('error', 'signup', 'purchase')")


@query("routes_of", oracle("SELECT * FROM ROUTES"))
def routes_of(src: Source):
    routes = reports.routes_of(_reports(src).where("is_report"), ["event_id"])
    merged = routes.withColumn("api", F.when(F.col("function").isNotNull(), F.col("function")).otherwise(F.col("api")))
    return merged.select("event_id", "pos", "api", "method", "path", F.size("params").alias("n_params"))


@query("route_key", (
    "SELECT p_partkey, CASE WHEN p_size < 10 THEN p_name WHEN p_size < 20 THEN 'h' || p_partkey WHEN p_size < 30 THEN p_brand ELSE p_type || ' /' || p_partkey END AS key FROM part"))
def route_key(src: Source):
    rows = src.sql("SELECT p_partkey, CASE WHEN p_size < 10 THEN p_name ELSE '' END AS doc_name, CASE WHEN p_size BETWEEN 10 AND 19 THEN 'h' || p_partkey END AS handler, "
                   "CASE WHEN p_size < 30 THEN p_brand ELSE '' END AS function, p_type AS method, '/' || p_partkey AS path FROM part")
    return rows.select("p_partkey", reports.route_key(rows).alias("key"))


@query("normalize_report", (
    "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'default' WHEN 'MACHINERY' THEN c_name WHEN 'FURNITURE' THEN 'default' ELSE c_mktsegment END AS repo, "
    "CASE c_mktsegment WHEN 'BUILDING' THEN c_name WHEN 'MACHINERY' THEN c_name WHEN 'FURNITURE' THEN c_name ELSE c_mktsegment END AS scanned_as, "
    "CASE WHEN c_acctbal > 0 THEN 'c' || c_custkey ELSE 'local-20240101-000000' END AS label FROM customer"))
def normalize_report(src: Source):
    project = F.expr("CASE c_mktsegment WHEN 'BUILDING' THEN '' WHEN 'MACHINERY' THEN NULL WHEN 'FURNITURE' THEN '  ' ELSE ' ' || c_mktsegment || ' ' END")
    commit = F.expr("CASE WHEN c_acctbal > 0 THEN 'c' || c_custkey ELSE ' ' END")
    return src.table("customer").select(
        "c_custkey", reports.repository_name(project, F.col("c_name")).alias("repo"),
        reports.report_repository(project, F.lit(None).cast("string"), F.col("c_name")).alias("scanned_as"),
        reports.scan_label(commit, F.lit("2024-01-01").cast("timestamp")).alias("label"))


# ---------------------------------------------------------------- normalised contracts

# nested field maps: customer -> nation -> regions (an array) -> code
_SCHEMA = ("'{\"id\":{\"type\":\"Long\"},\"skip\":\"text\",\"nation\":{\"type\":\"Nation\",\"schema\":{\"type\":\"object\",\"fields\":{\"name\":{\"type\":\"String\",\"validation\":{\"required\":true,\"max\":' || c_nationkey || '}},"
           "\"regions\":{\"type\":\"List\",\"schema\":{\"type\":\"array\",\"items\":{\"type\":\"object\",\"fields\":{\"code\":{\"type\":\"T' || c_mktsegment || '\"}}}}}}}}}'")
_FLAT = ("SELECT c_custkey, v.path, CASE v.path WHEN 'id' THEN 'Long' WHEN 'nation' THEN 'Nation' WHEN 'nation.name' THEN 'String' WHEN 'nation.regions' THEN 'List' ELSE 'T' || c_mktsegment END AS type, "
         "CASE v.path WHEN 'nation.name' THEN 'max=' || c_nationkey || ',required=true' ELSE '' END AS rules, v.path = 'nation.name' AS required "
         "FROM customer, (VALUES ('id'), ('nation'), ('nation.name'), ('nation.regions'), ('nation.regions.code')) AS v(path)")


def _rules_text():
    return F.array_join(F.transform(F.array_sort(F.map_entries("rules")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")


@query("flatten_schema", _FLAT)
def flatten_schema(src: Source):
    rows = src.sql(f"SELECT c_custkey, {_SCHEMA} AS fields FROM customer")
    return normalize.flatten_schema(rows, ["c_custkey"]).select("c_custkey", "path", "type", _rules_text().alias("rules"), "required")


@query("response_fields", f"SELECT c_custkey, path, type FROM ({_FLAT}) WHERE c_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def response_fields(src: Source):
    # rich customers answer with an array, poor ones with plain text
    schema = f"CASE WHEN c_acctbal > 5000 THEN '{{\"type\":\"array\",\"items\":{{\"fields\":' || {_SCHEMA} || '}}}}' WHEN c_acctbal > 0 THEN {_SCHEMA} ELSE 'text' END"
    return normalize.response_fields(src.sql(f"SELECT c_custkey, {schema} AS schema FROM customer"), ["c_custkey"])


@query("status_sets", oracle(
    "SELECT api, coalesce(string_agg(code, ',' ORDER BY code) FILTER (code < 300), '') AS success, coalesce(string_agg(code, ',' ORDER BY code) FILTER (code >= 400), '') AS error FROM S_base GROUP BY api"))
def status_sets(src: Source):
    sets = normalize.status_sets(relation(src, "S_base"), ["api"])
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return sets.select("api", text("success"), text("error"))


@query("security_fingerprint", oracle("SELECT api, string_agg(annotation || ':' || expression, ',' ORDER BY annotation || ':' || expression) AS annotations FROM A_base GROUP BY api"))
def security_fingerprint(src: Source):
    from ..operators.diff import security_fingerprint as fingerprint
    from .bindings import access
    return fingerprint(access(src, "base"), ["api"]).select("api", F.array_join("annotations", ",").alias("annotations"))


_INTEGRATIONS = ("CASE l_linenumber WHEN 1 THEN '{\"databases\":[{\"operation\":\"READ\",\"table\":[\"a' || l_suppkey || '\",\"b\"],\"technology\":\"jpa\"},{\"operation\":\"WRITE\",\"table\":[],\"entity\":\"E\",\"technology\":\"jdbc\"}]}' "
                 "WHEN 2 THEN '{\"caches\":[{\"operation\":\"READ\",\"key\":\"k' || l_suppkey || '\",\"technology\":\"redis\"},{\"operation\":\"EVICT\",\"cache_names\":[\"x\",\"y\"],\"technology\":\"spring-cache\"}]}' "
                 "WHEN 3 THEN '{\"messaging\":[{\"direction\":\"publish\",\"destination\":\"t' || l_suppkey || '\",\"technology\":\"kafka\"}]}' "
                 "WHEN 4 THEN '{\"external_apis\":[{\"http_method\":\"GET\",\"url\":\"/c/{id}\",\"target_service\":\"s' || l_suppkey || '\"},{\"url\":\"/bare\"}]}' "
                 "WHEN 5 THEN '{\"events\":[{\"event_type\":\"Paid\",\"technology\":\"spring-event\"}],\"storage\":[{\"technology\":\"s3\"}]}' ELSE '{}' END")
_ENTRY = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, '{0}' AS grp, {1} AS item, '{2}' AS operation, {3} AS name, {4} AS technology FROM lineitem WHERE l_linenumber = {5}"
_ENTRIES = " UNION ".join([
    _ENTRY.format("databases", "'READ a' || l_suppkey || ' (jpa)'", "read", "'a' || l_suppkey", "'jpa'", 1), _ENTRY.format("databases", "'READ b (jpa)'", "read", "'b'", "'jpa'", 1),
    _ENTRY.format("databases", "'WRITE E (jdbc)'", "write", "'E'", "'jdbc'", 1), _ENTRY.format("caches", "'READ k' || l_suppkey || ' (redis)'", "read", "'k' || l_suppkey", "'redis'", 2),
    _ENTRY.format("caches", "'EVICT x, y (spring-cache)'", "evict", "'x, y'", "'spring-cache'", 2), _ENTRY.format("messaging", "'publish t' || l_suppkey || ' (kafka)'", "publish", "'t' || l_suppkey", "'kafka'", 3),
    _ENTRY.format("external_apis", "'GET /c/{id} → s' || l_suppkey", "get", "'s' || l_suppkey", "'/c/{id}'", 4), _ENTRY.format("external_apis", "'/bare'", "", "'/bare'", "''", 4),
    _ENTRY.format("other", "'events: Paid'", "event", "'Paid'", "'spring-event'", 5), _ENTRY.format("other", "'storage: s3'", "storage", "'s3'", "''", 5)])


@query("downstream_entries", _ENTRIES)
def downstream_entries(src: Source):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return normalize.downstream_entries(src.sql(f"SELECT DISTINCT {', '.join(keys)}, {_INTEGRATIONS} AS integrations FROM lineitem"), keys)


@query("contract_signature", "SELECT event_id, true AS order_free, true AS source_free, event_type <> 'view' AS params_count FROM events")
def contract_signature(src: Source):
    # parameters swapped, status sources replaced, one parameter type changed (not for views)
    param = lambda n, t: F.struct(n.alias("name"), t.alias("type"))
    a, b = param(F.lit("a"), F.col("event_type")), param(F.lit("b"), F.col("user_id").cast("string"))
    changed = param(F.lit("a"), F.when(F.col("event_type") == "view", "view").otherwise("other"))
    code = lambda c, s: F.struct(F.lit(c).alias("code"), F.lit(s).alias("source"))
    e = src.table("events").withColumns({"method": F.lit("GET"), "path": F.concat(F.lit("/"), "user_id")})

    def sig(name, params, codes):
        frame = e.withColumns({"params": params, "status_codes": codes})
        return frame.select("event_id", normalize.contract_signature(frame).alias(name))

    codes = F.array(code(200, "x"), code(404, "y"))
    out = sig("s0", F.array(a, b), codes).join(sig("s1", F.array(b, a), codes), "event_id").join(
        sig("s2", F.array(a, b), F.array(code(404, "z"), code(200, "w"))), "event_id").join(sig("s3", F.array(changed, b), codes), "event_id")
    return out.selectExpr("event_id", "s0 = s1 AS order_free", "s0 = s2 AS source_free", "s0 <> s3 AS params_count")


@query("parameter_signature", oracle(
    "SELECT b.api, b.s IS DISTINCT FROM h.s AS changed FROM (SELECT api, string_agg(DISTINCT concat_ws('|', coalesce(loc, '-'), name, coalesce(type, '-'), required), ';' "
    "ORDER BY concat_ws('|', coalesce(loc, '-'), name, coalesce(type, '-'), required)) AS s FROM P_base GROUP BY api) b JOIN (SELECT api, string_agg(DISTINCT concat_ws('|', coalesce(loc, '-'), name, coalesce(type, '-'), required), ';' "
    "ORDER BY concat_ws('|', coalesce(loc, '-'), name, coalesce(type, '-'), required)) AS s FROM P_head GROUP BY api) h ON b.api = h.api"))
def parameter_signature(src: Source):
    sig = lambda side: normalize.parameter_signature(relation(src, f"P_{side}"), ["api"], ["loc", "name", "type", "required"])
    both = sig("base").join(sig("head").withColumnRenamed("signature", "s2"), "api")
    return both.select("api", (F.col("signature") != F.col("s2")).alias("changed"))


@query("normalize_doc_name", (
    "SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY p_brand, p_type, p_name) > 1 THEN p_name || '-' || p_type || '-' || "
    "CASE WHEN p_size < 10 THEN 'root' ELSE 'a_' || p_size || '_b_' || p_partkey END ELSE p_name END AS doc_name FROM part"))
def normalize_doc_name(src: Source):
    rows = src.sql("SELECT p_partkey, p_brand || p_type AS module, p_name AS handler, p_type AS method, CASE WHEN p_size < 10 THEN '/' ELSE '/a/{' || p_size || '}/b-' || p_partkey || '/' END AS path FROM part")
    return normalize.normalize_doc_name(rows).select("p_partkey", "doc_name")


@query("endpoint_summary", (
    "SELECT DISTINCT l_partkey, CASE WHEN l_linenumber <= 2 THEN 'table' WHEN l_linenumber <= 4 THEN 'code' ELSE 'external' END AS kind, "
    "CASE WHEN l_linenumber <= 2 THEN 't' || l_suppkey WHEN l_linenumber <= 4 THEN CAST(200 + l_linenumber AS VARCHAR) ELSE 'host' || l_returnflag END AS name FROM lineitem"))
def endpoint_summary(src: Source):
    items = src.sql("SELECT l_partkey, CASE WHEN l_linenumber <= 2 THEN 'table' WHEN l_linenumber <= 4 THEN 'code' ELSE 'external' END AS kind, "
                    "CASE WHEN l_linenumber <= 2 THEN 't' || l_suppkey WHEN l_linenumber <= 4 THEN CAST(200 + l_linenumber AS STRING) ELSE 'host' || l_returnflag END AS name FROM lineitem "
                    "UNION ALL SELECT l_partkey, 'cache', '' FROM lineitem")
    return normalize.endpoint_summary(items, ["l_partkey"])


@query("group_of", (
    "SELECT page_id, CASE WHEN url LIKE 'https%' THEN regexp_extract(url, '([^.]*)$', 1) WHEN contains(url, '#') THEN regexp_extract(url, '^([^.]*)', 1) ELSE 'APIs' END AS group_label FROM pages"))
def group_of(src: Source):
    controller = F.when(F.col("url").startswith("https"), F.col("url")).otherwise("")
    handler = F.when(F.col("url").contains("#"), F.col("url")).otherwise("run")
    return src.table("pages").select("page_id", versions.group_of(controller, handler).alias("group_label"))


# ---------------------------------------------------------------- files

_FILE = ("p_brand || '/' || CASE p_type WHEN 'ECONOMY' THEN 'target/classes/' WHEN 'LARGE' THEN 'src/test/java/' WHEN 'PROMO' THEN 'srcs/test/' WHEN 'SMALL' THEN 'src/integrationTest/' ELSE 'src/main/' END || "
         "replace(p_name, ' ', '/') || CASE WHEN p_size < 25 THEN '.java' ELSE '.py' END")


@query("source_files", f"SELECT p_partkey, {_FILE} AS path FROM part WHERE p_type IN ('PROMO', 'MEDIUM', 'STANDARD') AND p_size < 25")
def source_files(src: Source):
    return files.source_files(src.sql(f"SELECT p_partkey, {_FILE} AS path FROM part"), ".java")


@query("detect_frameworks", (
    "SELECT DISTINCT source AS repo, 'spring' AS framework FROM documents WHERE lang = 'en' AND (contains(text, 'tion the') OR contains(text, 'zzz')) UNION "
    "SELECT DISTINCT source, 'fastapi' FROM documents WHERE lang = 'fr' AND contains(lower(text), 'leau')"))
def detect_frameworks(src: Source):
    d = src.sql("SELECT source AS repo, source || '/src/' || doc_id || CASE lang WHEN 'en' THEN '.java' WHEN 'fr' THEN '.py' ELSE '.txt' END AS path, text AS content FROM documents")
    return files.detect_frameworks(d, markers=(("spring", ".java", False, ("tion the", "zzz")), ("fastapi", ".py", True, ("leau",))))


@query("changed_files", (
    "SELECT DISTINCT o_custkey AS repo, 'f' || l_partkey || '.java' AS file FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag IN ('A', 'N') AND l_linenumber <= 5 "
    "AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) UNION SELECT DISTINCT o_custkey, 'f' || l_partkey || '.java' FROM lineitem JOIN orders ON l_orderkey = o_orderkey "
    "WHERE l_linenumber <= 5 AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)"))
def changed_files(src: Source):
    every = src.sql("SELECT o_custkey AS repo, 'f' || l_partkey || CASE WHEN l_linenumber <= 5 THEN '.java' ELSE '.md' END AS file, l_returnflag FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
    parents = src.sql("SELECT c_custkey AS repo FROM customer WHERE c_acctbal > 0")
    return files.changed_files(every.where("l_returnflag = 'A'"), every.where("l_returnflag = 'N'"), every, parents, [".java", ".kt"])


@query("parse_diff_hunks", (
    "SELECT o_orderkey, 'src/' || o_custkey || '.java' AS file, o_orderkey + 1 AS h_start, o_orderkey + 1 + greatest(o_custkey, 1) - 1 AS h_end FROM orders UNION ALL "
    "SELECT o_orderkey, 'src/' || o_custkey || '.java', 7, 7 FROM orders UNION ALL SELECT o_orderkey, 'b.py', 5, 5 FROM orders"))
def parse_diff_hunks(src: Source):
    text = ("'diff --git a/x b/x\n--- a/x\n+++ b/src/' || o_custkey || '.java\n@@ -1,2 +' || (o_orderkey + 1) || ',' || o_custkey || ' @@ fn\n-old\n+new @@ -1 +1 @@\n@@ -9 +7 @@\n+x\n"
            "diff --git a/gone b/gone\n+++ /dev/null\n@@ -1,3 +0,0 @@\n-a\n--- a/b.py\n+++ b/b.py  \n@@ -5,0 +5,0 @@\n'")
    return files.parse_diff_hunks(src.sql(f"SELECT o_orderkey, {text} AS diff FROM orders"), ["o_orderkey"])


@query("find_modules", (
    "SELECT DISTINCT p_brand || '/' || p_type AS dir FROM part WHERE p_size < 20 AND p_type NOT IN ('LARGE', 'ECONOMY') UNION SELECT ''"))
def find_modules(src: Source):
    paths = src.sql("SELECT CASE WHEN p_size = 50 THEN '' ELSE p_brand || '/' || p_type || CASE p_type WHEN 'LARGE' THEN '/src/main/' WHEN 'ECONOMY' THEN '/build/x/' ELSE '/' END END || "
                    "CASE WHEN p_size < 20 OR p_size = 50 THEN 'pom.xml' ELSE 'readme.md' END AS path FROM part")
    return files.find_modules(paths)


@query("safe_name", (
    "SELECT page_id, part, length(part) BETWEEN 1 AND 200 AND part NOT IN ('.', '..') AND NOT contains(part, '/') AS safe FROM (SELECT page_id, unnest(string_split(url, '?')) AS part FROM pages "
    "UNION ALL SELECT page_id, unnest(string_split(url, '/')) FROM pages)"))
def safe_name(src: Source):
    p = src.table("pages")
    parts = p.select("page_id", F.explode(F.split("url", r"\?")).alias("part")).unionByName(p.select("page_id", F.explode(F.split("url", "/")).alias("part")))
    return parts.withColumn("safe", files.safe_name(F.col("part")))


_TREE = "SELECT p_partkey, 'docs/' || CASE WHEN p_size < 5 THEN '..' ELSE p_brand END || '/api' || p_partkey || CASE WHEN p_size < 10 THEN '/notes' ELSE '' END || '/v' || (1 + p_size % 3) || CASE WHEN p_size > 45 THEN '.txt' ELSE '.md' END AS path, p_name AS content FROM part"
_STORED = "SELECT p_brand AS repo, 'api' || p_partkey AS api, CAST(2 AS BIGINT) AS version FROM part WHERE p_type = 'PROMO'"
_PARSED = "SELECT CASE WHEN p_size < 10 THEN 'api' || p_partkey ELSE p_brand END AS repo, CASE WHEN p_size < 10 THEN 'notes' ELSE 'api' || p_partkey END AS api, CAST(1 + p_size % 3 AS BIGINT) AS version, p_type FROM part WHERE p_size <= 45"


def _tree(src: Source):
    meta = src.sql("SELECT p_brand AS repo, 'api' || p_partkey AS api, CAST(1 + p_size % 3 AS BIGINT) AS version, CASE WHEN p_type = 'LARGE' THEN 'sig' || p_partkey ELSE '' END AS signature FROM part")
    return files.import_doc_tree(src.sql(_TREE), src.sql(_STORED), meta)


@query("import_doc_tree", (
    f"SELECT repo, api, version, CASE WHEN p_type = 'LARGE' AND repo LIKE 'Brand%' THEN 'sig' || substr(api, 4) ELSE 'imported-v' || version END AS signature FROM ({_PARSED}) p "
    f"WHERE (repo, api, version) NOT IN (SELECT (repo, api, version) FROM ({_STORED}))"))
def import_doc_tree(src: Source):
    return _tree(src)[0].select("repo", "api", "version", "signature")


@query("import_doc_counts", (
    f"SELECT CASE WHEN (repo, api, version) IN (SELECT (repo, api, version) FROM ({_STORED})) THEN 'skipped' ELSE 'versions' END AS kind, count(*) AS n FROM ({_PARSED}) GROUP BY kind"))
def import_doc_counts(src: Source):
    return _tree(src)[1]


# ---------------------------------------------------------------- stored tables

@query("upsert_rows", (
    "SELECT c_custkey, coalesce(u.s, c_mktsegment) AS segment FROM customer LEFT JOIN (SELECT user_id, max_by(event_type, event_id) AS s FROM events GROUP BY user_id) u ON c_custkey = user_id"))
def upsert_rows(src: Source):
    stored = src.table("customer").selectExpr("c_custkey", "c_mktsegment AS segment")
    updates = src.table("events").selectExpr("user_id AS c_custkey", "event_type AS segment", "event_id")
    return store.upsert_rows(stored, updates, ["c_custkey"], "event_id")


@query("delete_repo", "SELECT o_orderkey, o_custkey AS repo FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 1000)")
def delete_repo(src: Source):
    tables = {"orders": src.table("orders").selectExpr("o_orderkey", "o_custkey AS repo")}
    return store.delete_repo(tables, src.sql("SELECT c_custkey AS repo FROM customer WHERE c_acctbal < 1000"))["orders"]


@query("latest_document", "SELECT user_id AS repo, max(event_id) AS id, max_by(props, event_id) AS document FROM events GROUP BY user_id")
def latest_document(src: Source):
    return store.latest_document(src.table("events").selectExpr("user_id AS repo", "event_id AS id", "props AS document"))


_SCAN = "SELECT 'repo-' || event_type AS repo, 'user-' || user_id AS api, event_id AS version, props AS content, value FROM events"


@query("version_entries", f"SELECT repo, api, version FROM ({_SCAN}) WHERE repo = 'repo-click' AND api = 'user-8'")
def version_entries(src: Source):
    return store.version_entries(src.sql(_SCAN), "repo-click", "user-8").select("repo", "api", "version")


@query("list_apis", f"SELECT DISTINCT api FROM ({_SCAN}) WHERE repo = 'repo-view'")
def list_apis(src: Source):
    return store.list_apis(src.sql(_SCAN), "repo-view")


@query("api_exists", (
    "SELECT c_custkey, repo, api, c_custkey IN (SELECT user_id FROM events WHERE event_type = 'click') AND c_acctbal > 0 AS found FROM "
    "(SELECT c_custkey, c_acctbal, CASE WHEN c_acctbal > 0 THEN 'repo-click' ELSE 'repo/click' END AS repo, 'user-' || c_custkey AS api FROM customer)"))
def api_exists(src: Source):
    wanted = src.sql("SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 'repo-click' ELSE 'repo/click' END AS repo, 'user-' || c_custkey AS api FROM customer")
    return store.api_exists(src.sql(_SCAN), wanted)
