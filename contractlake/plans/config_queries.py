"""Configuration and build files written from the driver tables, and what is read from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import config
from ..sources import builds
from .bindings import RELATIONS, oracle, relation
from .registry import Source, query


@query("parse_properties", (
    "SELECT p_partkey AS file, v.key, CASE v.key WHEN 'server.port' THEN CAST(p_size AS VARCHAR) WHEN 'name' THEN p_name || 'tail = end' WHEN 'empty' THEN '' ELSE 'a=b' END AS value "
    "FROM part, (VALUES ('server.port'), ('name'), ('empty'), ('eq')) AS v(key)"))
def parse_properties(src: Source):
    text = ("'# ' || p_brand || '\n! server.port=1\nserver.port = 80\n\nname : ' || p_name || '\\\\\n   tail = end  \nempty=\n  eq a=b\r\n  server.port=' || p_size || '\n#last=1'")
    return config.parse_properties(src.sql(f"SELECT p_partkey AS file, {text} AS content FROM part"))


@query("flatten_config", (
    "SELECT event_id, v.key, CASE v.key WHEN 'a.b' THEN json_extract_string(props, '$.k') WHEN 'list' THEN 'x,,' || user_id WHEN 'list[0]' THEN 'x' WHEN 'list[1]' THEN '' WHEN 'list[2]' THEN CAST(user_id AS VARCHAR) "
    "WHEN 'objs[0].q' THEN event_type ELSE 'True' END AS value FROM events, (VALUES ('a.b'), ('list'), ('list[0]'), ('list[1]'), ('list[2]'), ('objs[0].q'), ('objs[1].r.s')) AS v(key)"))
def flatten_config(src: Source):
    doc = ("'{\"a\":{\"b\":' || get_json_object(props, '$.k') || '},\"list\":[\"x\",null,' || user_id || '],\"objs\":[{\"q\":\"' || event_type || '\"},{\"r\":{\"s\":true}}]}'")
    return config.flatten_config(src.sql(f"SELECT event_id, {doc} AS content FROM events"), ["event_id"]).select("event_id", "key", "value")


RELATIONS["CFG"] = ("SELECT 'm' || user_id AS module, CASE event_type WHEN 'click' THEN '' WHEN 'view' THEN 'default' ELSE event_type END AS profile, "
                    "'key' || CAST(floor(value / 10) AS INT) AS key, 'v' || event_id AS value, event_id AS source_order FROM events")
_OVERLAY = "SELECT module, CASE WHEN profile = '' THEN 'default' ELSE profile END AS profile, key, max_by(value, source_order) AS value FROM CFG GROUP BY 1, 2, 3"


@query("profile_overlay", oracle(_OVERLAY))
def profile_overlay(src: Source):
    return config.profile_overlay(relation(src, "CFG")).drop("source_order")


@query("effective_values", oracle(
    f"SELECT module, key, coalesce(max(value) FILTER (profile = 'error'), max(value) FILTER (profile = 'default')) AS value FROM ({_OVERLAY}) WHERE profile IN ('error', 'default') GROUP BY module, key"))
def effective_values(src: Source):
    return config.effective_values(relation(src, "CFG"), "error")


@query("apply_central", (
    "WITH m AS (SELECT p_brand AS repo, 'm' || p_partkey AS module, CASE WHEN p_size < 25 THEN 'svc-' || p_partkey ELSE 'svc' || p_partkey END AS app, p_type = 'PROMO' AS client FROM part) "
    "SELECT repo, module, '' AS profile, 'shared' AS key, 'all-' || repo AS value, 0 AS \"order\" FROM m WHERE client UNION ALL SELECT repo, module, 'dev', 'shared', 'dev', 0 FROM m WHERE client UNION ALL "
    "SELECT repo, module, 'prod', 'own', app, 0 FROM m UNION ALL SELECT repo, module, 'default', p_name, p_name, 1 FROM m JOIN part ON module = 'm' || p_partkey"))
def apply_central(src: Source):
    modules = src.sql("SELECT p_brand AS repo, 'm' || p_partkey AS module, CASE WHEN p_size < 25 THEN 'svc-' || p_partkey ELSE 'svc' || p_partkey END AS app_name, p_type = 'PROMO' AS is_client FROM part")
    shared = src.sql("SELECT DISTINCT p_brand AS repo, s AS stem, 'shared' AS key, CASE s WHEN 'application' THEN 'all-' || p_brand ELSE 'dev' END AS value FROM part LATERAL VIEW explode(array('application', 'application-dev')) AS s")
    own = modules.select("repo", F.concat("app_name", F.lit("-prod")).alias("stem"), F.lit("own").alias("key"), F.col("app_name").alias("value"))
    local = src.sql("SELECT p_brand AS repo, 'm' || p_partkey AS module, 'default' AS profile, p_name AS key, p_name AS value, CAST(1 AS BIGINT) AS source_order FROM part")
    found = config.apply_central(local, shared.unionByName(own), modules)
    return found.select("repo", "module", "profile", "key", "value", F.when(F.col("source_order") < config.CENTRAL_ORDER, 1).otherwise(0).alias("order"))


_HOLDERS = "SELECT 'm' || p_partkey AS module, 'default' AS profile, v.key, CASE v.key WHEN 'url' THEN 'http://${host}:${port:80}/${miss}/${zone:eu}' WHEN 'host' THEN '${name}.local' WHEN 'name' THEN p_name ELSE p_brand END AS value FROM part, (VALUES ('url'), ('host'), ('name'), ('plain')) AS v(key)"
_PORTS = "SELECT 'm' || p_partkey AS module, 'prod' AS profile, 'port' AS key, CAST(p_size AS {t}) AS value FROM part WHERE p_type = 'PROMO'"


@query("resolve_placeholders", (
    "SELECT module, profile, key, CASE key WHEN 'url' THEN 'http://' || p_name || '.local:' || CASE WHEN p_type = 'PROMO' THEN CAST(p_size AS VARCHAR) ELSE '80' END || '/${miss}/eu' WHEN 'host' THEN p_name || '.local' ELSE value END AS value "
    f"FROM ({_HOLDERS}) JOIN part ON module = 'm' || p_partkey UNION ALL {_PORTS.format(t='VARCHAR')}"))
def resolve_placeholders(src: Source):
    keys = F.explode(F.array(*[F.lit(k) for k in ("url", "host", "name", "plain")]))
    # literals, because SQL texts have their own ${} substitution
    value = (F.when(F.col("key") == "url", "http://${host}:${port:80}/${miss}/${zone:eu}").when(F.col("key") == "host", "${name}.local")
             .when(F.col("key") == "name", F.col("p_name")).otherwise(F.col("p_brand")))
    rows = src.table("part").select(F.concat(F.lit("m"), "p_partkey").alias("module"), F.lit("default").alias("profile"), keys.alias("key"), "p_name", "p_brand")
    rows = rows.select("module", "profile", "key", value.alias("value"))
    return config.resolve_placeholders(rows.unionByName(src.sql(_PORTS.format(t="STRING"))))


@query("mask_secrets", (
    "SELECT doc_id, regexp_replace(text || ' http://bob:' || source || '@host/x', '(\\w+://[^:/@\\s]+:)([^@\\s]+)(@)', '\\1****\\3', 'g') AS shown, "
    "CASE lang WHEN 'en' THEN '****' WHEN 'fr' THEN source WHEN 'de' THEN '${X}' ELSE source END AS value FROM documents"))
def mask_secrets(src: Source):
    key = F.expr("CASE lang WHEN 'en' THEN 'db.Password' WHEN 'fr' THEN 'token.url' WHEN 'de' THEN 'api-key' ELSE 'plain' END")
    value = F.when(F.col("lang") == "de", F.lit("${X}")).otherwise(F.col("source"))
    text = F.concat("text", F.lit(" http://bob:"), "source", F.lit("@host/x"))
    return src.table("documents").select("doc_id", config.mask_urls(text).alias("shown"), config.mask_secrets(key, value).alias("value"))


_JDBC = ("CASE p_type WHEN 'ECONOMY' THEN 'jdbc:postgresql://' || p_brand || ':54' || p_size || '/db' || p_partkey || '?ssl=1' WHEN 'LARGE' THEN 'jdbc:h2:mem:t' || p_size "
         "WHEN 'PROMO' THEN 'jdbc:sqlserver://h' || p_size || ';databaseName=x' ELSE 'mongodb://u:p' || p_size || '@h' END")


@query("jdbc_target", (
    "SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'postgresql' WHEN 'LARGE' THEN 'h2' WHEN 'PROMO' THEN 'sqlserver' ELSE 'none' END AS type, CASE p_type WHEN 'ECONOMY' THEN p_brand WHEN 'PROMO' THEN 'h' || p_size ELSE '' END AS host, "
    "CASE p_type WHEN 'ECONOMY' THEN CAST('54' || p_size AS INT) ELSE 0 END AS port, CASE p_type WHEN 'ECONOMY' THEN 'db' || p_partkey ELSE '' END AS database, p_type = 'LARGE' AS in_memory, "
    f"CASE WHEN p_type IN ('ECONOMY', 'LARGE', 'PROMO') THEN {_JDBC} ELSE 'mongodb://u:****@h' END AS url FROM part"))
def jdbc_target(src: Source):
    t = src.sql(f"SELECT p_partkey, {_JDBC} AS u FROM part").withColumn("t", config.jdbc_target(F.col("u")))
    blank = lambda c, d: F.coalesce(F.col(f"t.{c}"), F.lit(d)).alias(c)
    return t.select("p_partkey", blank("type", "none"), blank("host", ""), blank("port", 0), blank("database", ""), "t.in_memory", "t.url")


# configuration of one module per part, in the words of real keys
_APP_KEYS = (
    "spring.application.name",
    "server.context-path",
    "server.servlet.context-path",
    "spring.redis.host",
    "spring.kafka.bootstrap-servers",
    "spring.config.import",
    "eureka.client.serviceUrl.defaultZone",
    "shop.api.url",
    "spring.cloud.gateway.routes[0].id",
    "spring.cloud.gateway.routes[0].uri",
    "spring.cloud.gateway.routes[0].predicates[0]",
    "spring.cloud.gateway.routes[0].predicates[1]",
    "spring.cloud.gateway.routes[10].id",
    "spring.cloud.stream.bindings.out-0.destination",
    "spring.cloud.stream.bindings.out-0.group",
    "spring.datasource.url",
)
_APP_VALUE = (
    "CASE key WHEN 'spring.application.name' THEN 'app-' || p_partkey WHEN 'server.context-path' THEN '/old' "
    "WHEN 'server.servlet.context-path' THEN CASE WHEN p_size < 25 THEN '/new' ELSE '' END WHEN 'spring.redis.host' THEN p_brand WHEN 'spring.kafka.bootstrap-servers' THEN 'k:' || p_size "
    "WHEN 'spring.config.import' THEN 'optional:configserver:http://c' || p_size WHEN 'eureka.client.serviceUrl.defaultZone' THEN 'http://e/' "
    "WHEN 'shop.api.url' THEN 'https://me:pw' || p_size || '@shop/x' WHEN 'spring.cloud.gateway.routes[0].id' THEN 'r' || p_partkey WHEN 'spring.cloud.gateway.routes[0].uri' THEN 'lb://svc' "
    "WHEN 'spring.cloud.gateway.routes[0].predicates[0]' THEN 'Path=/a/**' WHEN 'spring.cloud.gateway.routes[0].predicates[1]' THEN 'Path=/b/**' WHEN 'spring.cloud.gateway.routes[10].id' THEN 'ten' "
    "WHEN 'spring.cloud.stream.bindings.out-0.destination' THEN 'topic' || p_size WHEN 'spring.cloud.stream.bindings.out-0.group' THEN p_type "
    "ELSE 'jdbc:mysql://db' || p_size || ':3306/shop' END")


def _app(src: Source):
    rows = src.table("part").withColumn("key", F.explode(F.array(*[F.lit(k) for k in _APP_KEYS])))
    return rows.select(F.concat(F.lit("m"), "p_partkey").alias("module"), F.lit("default").alias("profile"), "key", F.expr(_APP_VALUE).alias("value"))


@query("derive_infrastructure", (
    "SELECT 'm' || p_partkey AS module, 'app-' || p_partkey AS application_name, CASE WHEN p_size < 25 THEN '/new' ELSE '/old' END AS context_path, p_brand AS redis_host, 'k:' || p_size AS kafka, "
    "'http://c' || p_size AS config_server, 'eureka' AS service_discovery, 'http://e/' AS discovery_url FROM part"))
def derive_infrastructure(src: Source):
    return config.derive_infrastructure(_app(src)).select(
        "module", "application_name", "context_path", "redis_host", "kafka", "config_server", "service_discovery", "discovery_url")


@query("datasources", "SELECT 'm' || p_partkey AS module, 'mysql' AS type, 'db' || p_size AS host, 3306 AS port, 'shop' AS database FROM part")
def datasources(src: Source):
    return config.datasources(_app(src)).select("module", "type", "host", "port", "database")


@query("external_urls", "SELECT 'm' || p_partkey AS module, 'shop.api.url' AS key, 'https://me:****@shop/x' AS url FROM part")
def external_urls(src: Source):
    return config.external_urls(_app(src))


@query("stream_bindings", "SELECT 'm' || p_partkey AS module, 'out-0' AS binding, 'topic' || p_size AS destination, p_type AS binding_group FROM part")
def stream_bindings(src: Source):
    return config.stream_bindings(_app(src)).select("module", "binding", "destination", "binding_group")


@query("indexed_groups", (
    "SELECT 'm' || p_partkey AS module, 0 AS idx, 'id=r' || p_partkey || ';predicates[0]=Path=/a/**;predicates[1]=Path=/b/**;uri=lb://svc' AS fields FROM part UNION ALL SELECT 'm' || p_partkey, 10, 'id=ten' FROM part"))
def indexed_groups(src: Source):
    text = F.array_join(F.transform(F.array_sort(F.map_entries("fields")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return config.indexed_groups(_app(src), "spring.cloud.gateway.routes").select("module", "idx", text.alias("fields"))


@query("gateway_routes", (
    "SELECT 'm' || p_partkey AS module, 'r' || p_partkey AS route_id, 'lb://svc' AS uri, 'Path=/a/**,Path=/b/**' AS predicates FROM part UNION ALL SELECT 'm' || p_partkey, 'ten', '', '' FROM part"))
def gateway_routes(src: Source):
    return config.gateway_routes(_app(src)).select("module", "route_id", F.coalesce("uri", F.lit("")).alias("uri"), F.array_join("predicates", ",").alias("predicates"))


# ---------------------------------------------------------------- build files

# a parent description per brand, a child per part
_POM = ("'<?xml version=\"1.0\"?><project xmlns=\"http://maven.apache.org/POM/4.0.0\"><parent><groupId>org.' || p_type || '</groupId><artifactId>' || p_brand || '</artifactId><version>1.' || p_size || '</version></parent>"
        "<artifactId>a' || p_partkey || '</artifactId><properties><lib.version>$' || '{base}.' || p_size || '</lib.version></properties><dependencies><dependency><groupId>g</groupId><artifactId>lib</artifactId>"
        "<version>$' || '{lib.version}</version></dependency><dependency><groupId>g</groupId><artifactId>t</artifactId><scope>test</scope></dependency></dependencies></project>'")
_PARENT = ("'<project><groupId>root</groupId><artifactId>' || b || '</artifactId><version>9</version><packaging>pom</packaging><properties><java.version>17</java.version><base>5</base></properties>"
           "<modules><module>x</module></modules></project>'")


def _modules(src: Source):
    children = src.sql(f"SELECT 'r' AS repo, 'z' || p_partkey AS path, {_POM} AS content FROM part")
    parents = src.sql(f"SELECT 'r' AS repo, 'p' || b AS path, {_PARENT} AS content FROM (SELECT DISTINCT p_brand AS b FROM part)")
    return builds.maven_modules(children.unionByName(parents))


@query("maven_modules", (
    "SELECT 'a' || p_partkey AS artifact, p_brand AS parent_artifact, 'org.' || p_type AS \"group\", '1.' || p_size AS version, 'jar' AS packaging, '17' AS java_version, "
    "'g:lib:5.' || p_size || ':compile,g:t:-:test' AS dependencies FROM part UNION ALL SELECT DISTINCT p_brand, '', 'root', '9', 'pom', '17', '' FROM part"))
def maven_modules(src: Source):
    deps = F.array_join(F.transform("dependencies", lambda d: F.concat_ws(":", d["group"], d["artifact"], F.coalesce(d["version"], F.lit("-")), d["scope"])), ",")
    return _modules(src).select("artifact", F.coalesce("parent_artifact", F.lit("")).alias("parent_artifact"), "group", "version", "packaging", "java_version",
                                F.coalesce(deps, F.lit("")).alias("dependencies"))


@query("inherit_from_parent", (
    "SELECT 'n' || n_nationkey AS path, CASE WHEN n_nationkey < 10 THEN 'own' ELSE r_name END AS version FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'c' || c_custkey, 'R' || c_nationkey FROM customer UNION ALL "
    "SELECT 'r' || r_regionkey, r_name FROM region UNION ALL SELECT 'k' || n_nationkey, 'R' || n_nationkey FROM nation"))
def inherit_from_parent(src: Source):
    modules = src.sql("SELECT 'n' || n_nationkey AS path, CAST(NULL AS STRING) AS artifact, 'reg' || n_regionkey AS parent_artifact, CASE WHEN n_nationkey < 10 THEN 'own' ELSE '' END AS version FROM nation UNION ALL "
                      "SELECT 'r' || r_regionkey, 'reg' || r_regionkey, NULL, r_name FROM region UNION ALL SELECT 'k' || n_nationkey, 'nat' || n_nationkey, NULL, 'R' || n_nationkey FROM nation UNION ALL "
                      "SELECT 'c' || c_custkey, 'cust' || c_custkey, 'nat' || c_nationkey, NULL FROM customer")
    return builds.inherit_from_parent(modules).select("path", "version")


_GRADLE = ("'/* implementation \"x:y:1\" */\nplugins { id \"org.springframework.boot\" version \"3.' || p_size || '\" }\ngroup = \"com.' || p_type || '\"\nversion = \"1\"\nsourceCompatibility = JavaVersion.VERSION_1_8\n"
           "dependencies {\n  implementation \"g:a' || p_partkey || ':1.2\" // api \"no:no:1\"\n  testImplementation(\"g:t\")\n  runtimeOnly (platform(\"g:p:7\"))\n  api project(\":core' || p_size || '\")\n  compileOnly \"bad\"\n}\n'")


@query("gradle_dependencies", (
    "SELECT p_partkey, CASE v.i WHEN 4 THEN 'module' ELSE 'library' END AS kind, CASE v.i WHEN 4 THEN '' ELSE 'g' END AS \"group\", CASE v.i WHEN 1 THEN 'a' || p_partkey WHEN 2 THEN 't' WHEN 3 THEN 'p' ELSE 'core' || p_size END AS artifact, "
    "CASE v.i WHEN 1 THEN '1.2' WHEN 3 THEN '7' ELSE '' END AS version, CASE v.i WHEN 2 THEN 'test' WHEN 3 THEN 'runtime' ELSE 'compile' END AS scope FROM part, (VALUES (1), (2), (3), (4)) AS v(i)"))
def gradle_dependencies(src: Source):
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    out = builds.gradle_dependencies(src.sql(f"SELECT p_partkey, {_GRADLE} AS content FROM part"), ["p_partkey"])
    return out.select("p_partkey", "kind", blank("group"), "artifact", blank("version"), "scope")


@query("gradle_versions", "SELECT p_partkey, 'com.' || p_type AS \"group\", '1' AS version, '1.8' AS java_version, '3.' || p_size AS boot_version FROM part")
def gradle_versions(src: Source):
    return builds.gradle_versions(src.sql(f"SELECT p_partkey, {_GRADLE} AS content FROM part"), ["p_partkey"]).drop("cloud_version")


_MAPPER = ("'<?xml version=\"1.0\"?><mapper namespace=\"n.' || p_partkey || '\"><resultMap id=\"first\" type=\"A\"/><resultMap id=\"BaseResultMap\" type=\"B' || p_size || '\"/><sql id=\"cols\">id,\n name</sql>"
           "<select id=\"all\">SELECT <include refid=\"cols\"/> FROM t' || p_size || ' <if test=\"x\">WHERE a = 1</if></select><delete id=\"gone\">DELETE FROM t</delete><cache/></mapper>'")


@query("mapper_statements", (
    "SELECT p_partkey, 'n.' || p_partkey AS namespace, 'B' || p_size AS entity, 'all' AS id, 'READ' AS operation, 'SELECT id, name FROM t' || p_size || ' WHERE a = 1' AS sql FROM part UNION ALL "
    "SELECT p_partkey, 'n.' || p_partkey, 'B' || p_size, 'gone', 'DELETE', 'DELETE FROM t' FROM part"))
def mapper_statements(src: Source):
    return builds.mapper_statements(src.sql(f"SELECT p_partkey, {_MAPPER} AS content FROM part"), ["p_partkey"])
