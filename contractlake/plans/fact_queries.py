"""Symbol-table joins, call facts and endpoint roll-ups on code-like relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..operators import facts, types
from ..operators.closure import closure
from .bindings import RELATIONS, oracle, relation
from .registry import ORACLE, Source, query

# ---------------------------------------------------------------- type resolution

_NAME = "replace(p_name, ' ', '') || p_size"
RELATIONS["TY"] = (
    f"SELECT type, max(name) AS name, max(package) AS package, max(outer_type) AS outer_type, min_by(module, pos) AS module, min(pos) AS pos FROM ("
    f"SELECT p_type || '.' || {_NAME} AS type, {_NAME} AS name, p_type AS package, NULL AS outer_type, p_brand AS module, p_partkey AS pos FROM part UNION ALL "
    f"SELECT p_type || '.Outer.' || {_NAME}, {_NAME}, p_type, p_type || '.Outer', p_brand, p_partkey + 100000000 FROM part WHERE p_size < 10) GROUP BY type")
RELATIONS["CX"] = ("SELECT DISTINCT p_type || '@' || p_brand AS context, p_type AS package, p_brand AS module, p_brand < 'Brand#2' AS wild, p_brand > 'Brand#5' AS scoped FROM part")
RELATIONS["RF"] = (f"SELECT DISTINCT l_partkey, l_suppkey, a.n AS name, b.context FROM lineitem JOIN (SELECT p_partkey, {_NAME} AS n FROM part) a ON l_partkey = a.p_partkey "
                   "JOIN (SELECT p_partkey, p_type || '@' || p_brand AS context FROM part) b ON l_suppkey = b.p_partkey")
_FIRST = "(SELECT {k} AS k, min_by(type, pos) AS t FROM TY WHERE {w} GROUP BY {k})"


@query("resolve_type", oracle(
    "SELECT r.l_partkey, r.l_suppkey, coalesce(n.t, i.t, p.t, w1.t, w2.t, m.t, s.t) AS resolved FROM RF r JOIN CX c ON r.context = c.context "
    "LEFT JOIN TY nt ON false "
    f"LEFT JOIN {_FIRST.format(k='type', w='outer_type IS NOT NULL')} n ON c.scoped AND n.k = c.package || '.Outer.' || r.name "
    f"LEFT JOIN {_FIRST.format(k='type', w='true')} i ON c.package = 'SMALL' AND r.name LIKE 'red%' AND i.k = 'PROMO.' || r.name "
    f"LEFT JOIN {_FIRST.format(k='type', w='outer_type IS NULL')} p ON p.k = c.package || '.' || r.name "
    f"LEFT JOIN {_FIRST.format(k='type', w='true')} w1 ON c.wild AND w1.k = 'LARGE.' || r.name "
    f"LEFT JOIN {_FIRST.format(k='type', w='true')} w2 ON c.wild AND w2.k = 'ECONOMY.' || r.name "
    "LEFT JOIN (SELECT module || '/' || name AS k, min_by(type, pos) AS t FROM TY GROUP BY module || '/' || name) m ON m.k = c.module || '/' || r.name "
    f"LEFT JOIN {_FIRST.format(k='name', w='true')} s ON s.k = r.name"))
def resolve_type(src: Source):
    cx = relation(src, "CX")
    # the names of red parts are imported wherever the package is SMALL
    red = src.sql(f"SELECT DISTINCT 'SMALL' AS package, {_NAME} AS name FROM part WHERE p_name LIKE 'red%'")
    imports = cx.select("context", "package").join(red, "package").select("context", "name", F.concat(F.lit("PROMO."), "name").alias("qualified"))
    none = F.array().cast("array<string>")
    cx = cx.select("context", "package", "module",
                   F.when(F.col("scoped"), F.array(F.concat("package", F.lit(".Outer")))).otherwise(none).alias("scopes"),
                   F.when(F.col("wild"), F.array(F.lit("LARGE"), F.lit("ECONOMY"))).otherwise(none).alias("wildcards"))
    ty = relation(src, "TY").withColumnRenamed("outer_type", "outer")
    return types.resolve_type(relation(src, "RF"), cx, ty, imports, ["l_partkey", "l_suppkey"]).select("l_partkey", "l_suppkey", "resolved")


# every part extends the part of half its number
RELATIONS["PAR"] = "SELECT p_partkey AS type, CAST(floor(p_partkey / 2) AS BIGINT) AS parent FROM part WHERE p_partkey > 0"
RELATIONS["SUPER"] = ("SELECT * FROM (WITH RECURSIVE a AS (SELECT type, parent AS ancestor, 1 AS depth FROM PAR UNION ALL "
                      "SELECT a.type, p.parent, a.depth + 1 FROM a JOIN PAR p ON a.ancestor = p.type) SELECT * FROM a)")


def _supers(src: Source):
    return types.supertypes(relation(src, "PAR"))


@query("supertypes", oracle("SELECT type, ancestor, depth FROM SUPER"))
def supertypes(src: Source):
    return _supers(src)


@query("subtypes", oracle("SELECT ancestor AS type, type AS subtype, depth FROM SUPER"))
def subtypes(src: Source):
    return types.subtypes(relation(src, "PAR"))


@query("is_subtype", oracle("SELECT p_partkey AS type FROM part WHERE p_partkey = 3 UNION SELECT type FROM SUPER WHERE ancestor = 3"))
def is_subtype(src: Source):
    ty = src.sql("SELECT p_partkey AS type, 'T' || p_partkey AS name FROM part")
    refs = relation(src, "PAR").select("type", F.concat(F.lit("T"), "parent").alias("ref_name"))
    return types.is_subtype(ty, refs, _supers(src), "T3")


RELATIONS["FLD"] = ("SELECT l_partkey AS owner, 'f' || l_linenumber AS name, min(l_returnflag) AS field_type FROM lineitem GROUP BY l_partkey, l_linenumber")
RELATIONS["SC"] = "SELECT p_partkey AS type, p_partkey AS scope, 0 AS scope_depth FROM part UNION ALL SELECT p_partkey, (3 * p_partkey + 1) % (SELECT count(*) FROM part), 1 FROM part"
RELATIONS["FREF"] = "SELECT DISTINCT l_suppkey AS type, 'f' || l_linenumber AS name FROM lineitem"


@query("find_field", oracle(
    "SELECT type, name, min_by(owner, rank) AS owner, min_by(field_type, rank) AS field_type FROM (SELECT r.type, r.name, f.owner, f.field_type, s.scope_depth * 1000 + o.d AS rank "
    "FROM FREF r JOIN SC s ON r.type = s.type JOIN (SELECT p_partkey AS t, p_partkey AS o, 0 AS d FROM part UNION ALL SELECT type, ancestor, depth FROM SUPER) o ON s.scope = o.t "
    "JOIN FLD f ON f.owner = o.o AND f.name = r.name) GROUP BY type, name"))
def find_field(src: Source):
    ty = src.sql("SELECT p_partkey AS type FROM part")
    owners = types.owner_chain(ty, _supers(src), relation(src, "SC"))
    return types.find_field(relation(src, "FREF"), relation(src, "FLD"), owners, ["type", "name"])


RELATIONS["MET"] = ("SELECT l_partkey || '.m' || l_linenumber || '/' || (CAST(round(l_discount * 100) AS INT) % 3) AS method, l_partkey AS owner, 'm' || l_linenumber AS name, "
                    "CAST(round(l_discount * 100) AS INT) % 3 AS n_params, min(l_returnflag) = 'R' AND CAST(round(l_discount * 100) AS INT) % 3 > 0 AS varargs, "
                    "min(l_linestatus) = 'F' AS abstract, CAST(round(l_discount * 100) AS INT) % 3 AS pos FROM lineitem "
                    "GROUP BY l_partkey, l_linenumber, CAST(round(l_discount * 100) AS INT) % 3")
RELATIONS["CALL"] = "SELECT DISTINCT l_suppkey AS type, 'm' || l_linenumber AS name, CAST(round(l_tax * 100) AS INT) % 3 AS argc FROM lineitem"
RELATIONS["OWN"] = ("SELECT c.type, c.name, c.argc, m.method, m.abstract, m.n_params = c.argc OR (m.varargs AND c.argc >= m.n_params - 1) AS fit FROM CALL c JOIN "
                    "(SELECT c.type, c.name, c.argc, min_by(l.o, l.d) AS o FROM CALL c JOIN (SELECT p_partkey AS t, p_partkey AS o, 0 AS d FROM part UNION ALL SELECT type, ancestor, depth FROM SUPER) l "
                    "ON l.t = c.type JOIN (SELECT DISTINCT owner, name FROM MET) m ON m.owner = l.o AND m.name = c.name GROUP BY ALL) n ON n.type = c.type AND n.name = c.name AND n.argc = c.argc "
                    "JOIN MET m ON m.owner = n.o AND m.name = c.name")
RELATIONS["OWNX"] = "SELECT * FROM OWN o WHERE fit OR NOT EXISTS (SELECT 1 FROM OWN x WHERE x.type = o.type AND x.name = o.name AND x.argc = o.argc AND x.fit)"
RELATIONS["DOWN"] = ("SELECT c.type, c.name, c.argc, m.owner, m.method, m.abstract, m.n_params = c.argc OR (m.varargs AND c.argc >= m.n_params - 1) AS fit FROM CALL c "
                     "JOIN SUPER s ON s.ancestor = c.type JOIN MET m ON m.owner = s.type AND m.name = c.name "
                     "WHERE NOT EXISTS (SELECT 1 FROM OWNX o WHERE o.type = c.type AND o.name = c.name AND o.argc = c.argc AND NOT o.abstract)")
_DISPATCH = ("SELECT type, name, argc, method, true AS inherited FROM OWNX UNION ALL SELECT type, name, argc, method, false FROM DOWN d WHERE NOT abstract AND "
             "(fit OR NOT EXISTS (SELECT 1 FROM DOWN x WHERE x.type = d.type AND x.name = d.name AND x.argc = d.argc AND x.owner = d.owner AND x.fit))")


@query("virtual_dispatch", oracle(_DISPATCH))
def virtual_dispatch(src: Source):
    calls = relation(src, "CALL").withColumnRenamed("type", "t")
    keyed = calls.select(F.col("t").alias("type"), "name", "argc", F.concat_ws("|", "t", "name", "argc").alias("call"))
    hits = types.virtual_dispatch(keyed, relation(src, "MET"), _supers(src), ["call"])
    return hits.join(keyed, "call").select("type", "name", "argc", "method", "inherited")


@query("resolve_calls", oracle(
    f"SELECT DISTINCT 'c' || type AS caller, method AS callee FROM ({_DISPATCH}) UNION "
    f"SELECT DISTINCT 'c' || d.type, e.method FROM (SELECT type, name, argc, min_by(method, (CASE WHEN inherited THEN 0 ELSE 1 END, right(method, 1), method)) AS method FROM ({_DISPATCH}) "
    f"WHERE type IN (SELECT DISTINCT l_suppkey FROM lineitem) GROUP BY ALL) d JOIN ({_DISPATCH}) e ON e.type = CAST(split_part(d.method, '.', 1) AS BIGINT) % (SELECT count(*) FROM supplier) "
    "AND e.name = 'm2' AND e.argc = 1"))
def resolve_calls(src: Source):
    # two-step chains: the first method returns a type among the callers, whose m2(x) is called next
    one = relation(src, "CALL").select(F.concat_ws("|", "type", "name", "argc").alias("chain"), F.concat(F.lit("c"), "type").alias("caller"),
                                       F.col("type").alias("root_type"), F.lit(1).alias("step"), "name", "argc")
    two = one.withColumns({"step": F.lit(2), "name": F.lit("m2"), "argc": F.lit(1)})
    methods = src.sql(oracle("SELECT *, owner % (SELECT count(*) FROM supplier) AS return_type FROM MET"))
    return types.resolve_calls(one.unionByName(two), methods, _supers(src))


RELATIONS["TF"] = ("SELECT caller AS type, 'a' AS name, callee AS target, 'object' AS kind FROM G WHERE callee = CAST(floor(caller / 2) AS BIGINT) UNION ALL "
                   "SELECT caller, 'b', callee, 'array' FROM G WHERE callee = (3 * caller + 1) % (SELECT count(*) FROM part) UNION ALL "
                   "SELECT p_partkey, 'c', NULL, 'simple' FROM part")


@query("expand_schema", oracle(
    "SELECT * FROM (WITH RECURSIVE t AS (SELECT p_partkey AS root, p_partkey AS type, '' AS path, [p_partkey] AS seen, -1 AS depth, '' AS kind, false AS ref FROM part UNION ALL "
    "SELECT t.root, f.target, CASE WHEN t.depth < 0 THEN f.name ELSE t.path || '.' || f.name END, list_append(t.seen, f.target), t.depth + 1, f.kind, "
    "coalesce(f.target IS NOT NULL AND (list_contains(t.seen, f.target) OR t.depth + 1 >= 2), false) FROM t JOIN TF f ON f.type = t.type "
    "WHERE t.depth < 2 AND NOT t.ref) SELECT root, path, kind, ref, depth FROM t WHERE depth >= 0)"))
def expand_schema(src: Source):
    f = relation(src, "TF").withColumn("field_type", F.col("target").cast("string"))
    roots = src.sql("SELECT p_partkey AS root, p_partkey AS type FROM part")
    return types.expand_schema(roots, f, max_depth=2).select("root", "path", "kind", "ref", "depth")


@query("effective_fields", oracle(
    "SELECT t AS type, name, min_by(field_type, d) AS field_type FROM (SELECT p_partkey AS t, p_partkey AS o, 0 AS d FROM part UNION ALL SELECT type, ancestor, depth FROM SUPER) l "
    "JOIN FLD f ON f.owner = l.o GROUP BY t, name"))
def effective_fields(src: Source):
    return types.effective_fields(relation(src, "FLD"), _supers(src))


RELATIONS["INJF"] = ("SELECT DISTINCT l_partkey AS type, 'f' || l_linenumber AS field, 'S' || l_suppkey AS field_type, l_returnflag = 'A' AS injected, l_linestatus = 'F' AS is_final FROM lineitem")


@query("component_dependencies", oracle(
    "SELECT * FROM (WITH t AS (SELECT p_partkey AS type, p_size < 25 AS lombok FROM part), x AS ("
    "SELECT type, field, field_type AS target_type, 'field' AS injection FROM INJF WHERE injected UNION "
    "SELECT f.type, field, field_type, 'constructor' FROM INJF f JOIN t ON f.type = t.type WHERE NOT injected AND is_final AND lombok) "
    "SELECT d.*, s_name AS target FROM (SELECT * FROM x UNION SELECT p_partkey, 'f' || (1 + p_size % 9), 'S' || p_size, 'constructor' FROM part "
    "WHERE (p_partkey, 'f' || (1 + p_size % 9)) NOT IN (SELECT (type, field) FROM x) UNION SELECT p_partkey, 'dep', 'S1', 'setter' FROM part WHERE p_type = 'PROMO') d "
    "LEFT JOIN supplier ON target_type = 'S' || s_suppkey)"))
def component_dependencies(src: Source):
    ty = src.sql("SELECT p_partkey AS type, p_size < 25 AS lombok FROM part")
    f = relation(src, "INJF").withColumns({"static": F.lit(False), "has_init": F.lit(False), "final": F.col("is_final")})
    ctors = src.sql("SELECT p_partkey AS type, 1 AS ctor, false AS autowired, 'f' || (1 + p_size % 9) AS param, 'S' || p_size AS param_type, false AS is_value FROM part")
    setters = src.sql("SELECT p_partkey AS type, 'dep' AS param, 'S1' AS param_type FROM part WHERE p_type = 'PROMO'")
    targets = src.sql("SELECT 'S' || s_suppkey AS field_type, s_name AS target FROM supplier")
    return types.component_dependencies(ty, f, ctors, setters, targets).select("type", "field", "target_type", "injection", "target")


# ---------------------------------------------------------------- classification

@query("classify_stereotype", (
    "SELECT p_partkey, CASE WHEN p_type = 'ECONOMY' THEN 'rest_controller' WHEN p_type = 'LARGE' THEN 'service' WHEN p_type = 'PROMO' AND p_size < 25 THEN 'repository' "
    "WHEN p_type = 'PROMO' THEN 'class' WHEN p_type = 'SMALL' THEN 'exception' WHEN p_size < 10 THEN 'dto' WHEN p_brand = 'Brand#3' THEN 'message_listener' WHEN p_size > 45 THEN 'dto' ELSE 'class' END AS stereotype, "
    "CASE WHEN p_type = 'ECONOMY' THEN 'web' WHEN p_type = 'LARGE' THEN 'service' WHEN p_type = 'PROMO' AND p_size < 25 THEN 'data' WHEN p_type = 'PROMO' THEN 'other' "
    "WHEN p_type = 'SMALL' THEN 'domain' WHEN p_size < 10 THEN 'domain' WHEN p_brand = 'Brand#3' THEN 'integration' WHEN p_size > 45 THEN 'domain' ELSE 'other' END AS layer FROM "
    "(SELECT *, CASE WHEN p_size < 10 AND p_brand = 'Brand#3' AND p_type NOT IN ('ECONOMY', 'LARGE', 'PROMO', 'SMALL') THEN 'Brand#0' ELSE p_brand END AS b FROM part)"))
def classify_stereotype(src: Source):
    t = src.sql(
        "SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN array('Controller', 'ResponseBody') WHEN 'LARGE' THEN array('Component', 'Service') ELSE CAST(array() AS ARRAY<STRING>) END AS annotations, "
        "CASE p_type WHEN 'PROMO' THEN 'interface' ELSE 'class' END AS kind, CASE WHEN p_type = 'SMALL' THEN p_name || 'Exception' WHEN p_size > 45 AND p_type <> 'PROMO' THEN p_name || 'Payload' ELSE p_name END AS name, "
        "CASE WHEN p_type = 'PROMO' AND p_size < 25 THEN array('Base', 'JpaRepository') ELSE array('Base') END AS ancestors, false AS xml_mapper, false AS mapstruct, "
        "p_brand = 'Brand#3' AND p_size >= 10 AND p_type NOT IN ('SMALL', 'PROMO') AS listens, CASE WHEN p_size < 10 THEN 3 ELSE 0 END AS n_fields, 0 AS plain_methods FROM part")
    return facts.classify_stereotype(t).select("p_partkey", "stereotype", "layer")


def _library_sql() -> str:
    lines = []
    for i, (needle, category, tech) in enumerate(rules.LIBRARY_CATALOG):
        if any(s in needle for s in "-:."):
            cond = f"contains('org.' || lower(b) || ':' || lower(a), '{needle}')"
        else:
            cond = f"len(list_filter(string_split_regex(lower(a), '[-.:_]'), lambda t: starts_with(t, '{needle}'))) > 0"
        lines.append(f"WHEN {cond} THEN '{category}|{tech}'")
    return "CASE " + " ".join(lines) + " END"


# artifacts built from part words and library words
_ARTIFACT = ("CASE p_type WHEN 'ECONOMY' THEN 'spring-boot-starter-' || CASE WHEN p_size < 20 THEN 'web' WHEN p_size < 30 THEN 'webflux' ELSE 'data-redis' END "
             "WHEN 'LARGE' THEN replace(p_name, ' ', '-') || '-oauth2' WHEN 'PROMO' THEN 'h2-' || p_size WHEN 'SMALL' THEN 'kafka-clients' WHEN 'MEDIUM' THEN 'my.jooqish_' || p_size ELSE p_name END")


@query("classify_library", f"SELECT p_partkey, coalesce({_library_sql()}, 'none') AS library FROM (SELECT p_partkey, p_brand AS b, {_ARTIFACT} AS a FROM part)")
def classify_library(src: Source):
    hit = facts.classify_library(F.concat(F.lit("org."), "p_brand"), F.expr(_ARTIFACT))
    text = F.concat_ws("|", "hit.category", "hit.technology")
    return src.table("part").select("p_partkey", hit.alias("hit")).select("p_partkey", F.when(F.col("hit").isNotNull(), text).otherwise("none").alias("library"))


_METHOD = ("CASE p_type WHEN 'ECONOMY' THEN 'saveAll' || p_size WHEN 'LARGE' THEN 'deleteBy' || p_size WHEN 'PROMO' THEN 'findBy' || p_size WHEN 'SMALL' THEN 'expire' || p_size "
           "WHEN 'MEDIUM' THEN 'countBy' || p_size ELSE 'hotGear' END")


@query("op_from_name", (
    f"SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'WRITE' WHEN 'LARGE' THEN 'DELETE' WHEN 'PROMO' THEN 'READ' WHEN 'MEDIUM' THEN 'READ' ELSE 'CALL' END AS operation, "
    "CASE p_type WHEN 'LARGE' THEN 'DELETE' WHEN 'SMALL' THEN 'DELETE' ELSE 'WRITE' END AS cache_operation FROM part"))
def op_from_name(src: Source):
    name = F.expr(_METHOD)
    return src.table("part").select("p_partkey", facts.op_from_name(name).alias("operation"), facts.cache_op_from_name(name).alias("cache_operation"))


_SQL = ("CASE l_linenumber WHEN 1 THEN 'SELECT  o.id FROM \"Orders' || l_suppkey || '\" o JOIN items i ON i.id = o.id' WHEN 2 THEN 'insert into log_' || l_suppkey || ' VALUES (1)' "
        "WHEN 3 THEN 'UPDATE `t' || l_suppkey || '` SET a = 1' WHEN 4 THEN 'select p from Owner o join o.pets p' WHEN 5 THEN 'DELETE FROM shop.t' || l_suppkey || ' WHERE x = 1' "
        "WHEN 6 THEN 'CALL proc' || l_suppkey || '()' ELSE '' END")


@query("parse_sql_tables", (
    "SELECT l_orderkey, l_linenumber, l_suppkey, CASE l_linenumber WHEN 1 THEN 'READ' WHEN 2 THEN 'WRITE' WHEN 3 THEN 'WRITE' WHEN 4 THEN 'READ' WHEN 5 THEN 'DELETE' WHEN 6 THEN 'CALL' ELSE 'none' END AS operation, "
    "CASE l_linenumber WHEN 1 THEN 'Orders' || l_suppkey || ',items' WHEN 2 THEN 'log_' || l_suppkey WHEN 3 THEN 't' || l_suppkey WHEN 4 THEN 'Owner' WHEN 5 THEN 'shop.t' || l_suppkey ELSE '' END AS tables FROM lineitem"))
def parse_sql_tables(src: Source):
    s = F.expr(_SQL)
    return src.table("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", F.coalesce(facts.sql_operation(s), F.lit("none")).alias("operation"),
                                        F.array_join(facts.sql_tables(s), ",").alias("tables"))


@query("entity_table", (
    "SELECT l_partkey, l_linenumber, l_suppkey, CASE WHEN l_linenumber = 1 THEN 'raw_' || l_suppkey WHEN p_size < 10 THEN 'tbl_' || p_partkey WHEN p_size < 30 THEN 'big_order' || p_partkey ELSE 'bigOrder' || p_partkey END AS \"table\" "
    "FROM lineitem JOIN part ON l_partkey = p_partkey"))
def entity_table(src: Source):
    entities = src.sql("SELECT 'BigOrder' || p_partkey AS name, CASE WHEN p_size % 2 = 0 THEN 'BigOrder' || p_partkey END AS declared_name, CASE WHEN p_size < 10 THEN 'tbl_' || p_partkey ELSE '' END AS `table`, "
                       "CASE WHEN p_size < 30 THEN 'jpa' ELSE 'mongodb' END AS store, p_partkey AS pos FROM part")
    refs = src.sql("SELECT l_partkey, l_linenumber, l_suppkey, CASE WHEN l_linenumber = 1 THEN 'raw_' || l_suppkey ELSE 'BigOrder' || l_partkey END AS ref FROM lineitem")
    return facts.entity_table(refs, entities, ["l_partkey"]).drop("ref")


# ---------------------------------------------------------------- call facts

RELATIONS["CF"] = (
    "SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS call, 'm' || l_partkey AS method, l_linenumber AS n, l_suppkey AS s, l_returnflag AS f FROM lineitem")


@query("data_access_facts", oracle(
    "SELECT call, technology, operation, tables FROM (SELECT call, CASE n WHEN 1 THEN 'jdbc' WHEN 2 THEN 'jpa' WHEN 3 THEN 'mongodb' WHEN 4 THEN 'mybatis' ELSE 'jpa' END AS technology, "
    "CASE n WHEN 1 THEN CASE f WHEN 'A' THEN 'READ' ELSE 'WRITE' END WHEN 2 THEN CASE f WHEN 'A' THEN 'WRITE' WHEN 'N' THEN 'DELETE' ELSE 'READ' END WHEN 3 THEN 'READ' "
    "WHEN 4 THEN 'READ' ELSE 'DELETE' END AS operation, CASE n WHEN 1 THEN CASE f WHEN 'A' THEN 't' || s ELSE '' END WHEN 4 THEN 'custom' || s ELSE 'e' || s END AS tables FROM CF WHERE n <= 5)"))
def data_access_facts(src: Source):
    calls = relation(src, "CF").selectExpr(
        "call", "method", "CASE n WHEN 1 THEN 'jdbc' WHEN 2 THEN 'jpa_entity_manager' WHEN 3 THEN 'mongo_template' END AS receiver_kind",
        "CASE WHEN n IN (4, 5) THEN 'repo' || s || '-' || n END AS target",
        "CASE n WHEN 1 THEN CASE f WHEN 'A' THEN 'queryForList' ELSE 'update' END WHEN 2 THEN CASE f WHEN 'A' THEN 'persist' WHEN 'N' THEN 'remove' ELSE 'find' END "
        "WHEN 3 THEN 'aggregateStream' WHEN 4 THEN 'lookItUp' WHEN 5 THEN 'removeOld' ELSE 'toString' END AS name",
        "CASE WHEN n = 1 AND f = 'A' THEN 'SELECT a FROM t' || s END AS sql", "CASE WHEN n IN (2, 3) THEN 'e' || s END AS entity_table")
    repos = src.sql("SELECT 'repo' || s_suppkey || '-4' AS target, 'Repo' || s_suppkey AS repository, 'mybatis' AS store, CAST(NULL AS STRING) AS `table` FROM supplier UNION ALL "
                    "SELECT 'repo' || s_suppkey || '-5', 'Repo' || s_suppkey, 'jpa', 'e' || s_suppkey FROM supplier")
    queries = src.sql("SELECT 'repo' || s_suppkey || '-4' AS target, 'lookItUp' AS name, 'READ' AS sql_operation, array('custom' || s_suppkey) AS sql_tables FROM supplier")
    out = facts.data_access_facts(calls, repos, queries)
    return out.select("call", "technology", "operation", F.coalesce(F.array_join("tables", ","), F.lit("")).alias("tables"))


@query("message_facts", oracle(
    "SELECT call, CASE n WHEN 1 THEN 'kafka' WHEN 2 THEN 'rabbitmq' WHEN 3 THEN 'sns' WHEN 4 THEN 'redis-pubsub' ELSE 'kafka' END AS technology, "
    "CASE n WHEN 3 THEN 'none' WHEN 5 THEN '<default topic>' ELSE 'dest' || s END AS destination FROM CF WHERE n <= 5"))
def message_facts(src: Source):
    calls = relation(src, "CF").withColumns({
        "receiver_kind": F.expr("CASE n WHEN 1 THEN 'kafka' WHEN 2 THEN 'rabbitmq' WHEN 3 THEN 'sns' WHEN 4 THEN 'redis' WHEN 5 THEN 'kafka' WHEN 6 THEN 'kafka' ELSE 'jdbc' END"),
        "name": F.expr("CASE n WHEN 1 THEN 'send' WHEN 2 THEN 'convertAndSend' WHEN 3 THEN 'publish' WHEN 4 THEN 'publish' WHEN 5 THEN 'sendDefault' WHEN 6 THEN 'flush' ELSE 'send' END"),
        "args": F.expr("CASE WHEN n = 3 THEN array('dest' || s) ELSE array('dest' || s, 'payload') END")})
    return facts.message_facts(calls).select("call", "technology", F.coalesce("destination", F.lit("none")).alias("destination"))


@query("cache_facts", oracle(
    "SELECT call, CASE n WHEN 1 THEN 'redis' WHEN 2 THEN 'redis' WHEN 3 THEN 'spring-cache' ELSE 'hazelcast' END AS technology, CASE n WHEN 1 THEN 'READ' WHEN 2 THEN 'WRITE' WHEN 3 THEN 'EVICT' ELSE 'DELETE' END AS operation, "
    "'k' || s AS name FROM CF WHERE n <= 4"))
def cache_facts(src: Source):
    calls = relation(src, "CF").withColumns({
        "receiver_kind": F.expr("CASE n WHEN 3 THEN 'cache_manager' WHEN 4 THEN 'hazelcast' WHEN 7 THEN 'jdbc' ELSE 'redis' END"),
        "first_name": F.expr("CASE WHEN n <= 2 THEN 'opsForValue' WHEN n = 5 THEN 'setKeySerializer' WHEN n = 6 THEN 'getConnectionFactory' ELSE 'get' END"),
        "name": F.expr("CASE n WHEN 1 THEN 'multiGet' WHEN 2 THEN 'set' WHEN 3 THEN 'evict' WHEN 4 THEN 'remove' ELSE 'x' END"), "args": F.expr("array('k' || s)")})
    return facts.cache_facts(calls).drop("method")


@query("event_storage_facts", oracle(
    "SELECT call, CASE n WHEN 1 THEN 'event' WHEN 2 THEN 'storage' WHEN 3 THEN 'email' ELSE 'search' END AS kind, CASE n WHEN 2 THEN 'DELETE' WHEN 4 THEN 'READ' ELSE '' END AS operation, "
    "CASE WHEN n <= 2 THEN 'x' || s ELSE '' END AS name FROM CF WHERE n <= 4"))
def event_storage_facts(src: Source):
    calls = relation(src, "CF").withColumns({
        "receiver_kind": F.expr("CASE n WHEN 1 THEN 'event' WHEN 2 THEN 's3' WHEN 3 THEN 'email' WHEN 4 THEN 'elasticsearch' WHEN 5 THEN 'email' ELSE 'event' END"),
        "name": F.expr("CASE n WHEN 1 THEN 'publishEvent' WHEN 2 THEN 'deleteObject' WHEN 3 THEN 'sendMail' WHEN 4 THEN 'searchFor' WHEN 5 THEN 'createMessage' ELSE 'other' END"), "args": F.expr("array('x' || s)")})
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    ev = facts.event_facts(calls).select("call", F.lit("event").alias("kind"), F.lit("").alias("operation"), F.col("event_type").alias("name"))
    return ev.unionByName(facts.storage_facts(calls).select("call", "kind", blank("operation"), F.coalesce("bucket", F.lit("")).alias("name")))


@query("http_facts", oracle(
    "SELECT call, CASE n WHEN 1 THEN 'rest_template' WHEN 2 THEN 'web_client' WHEN 3 THEN 'web_client' ELSE 'feign' END AS client, CASE n WHEN 1 THEN 'POST' WHEN 2 THEN 'GET' WHEN 3 THEN 'GET' ELSE 'PUT' END AS http_method, "
    "CASE n WHEN 1 THEN 'http://Supplier#' || lpad(s::VARCHAR, 9, '0') || '/x' WHEN 2 THEN '/rel' WHEN 3 THEN 'lb://svc' || s || '/y' ELSE '/feign/' || s END AS url, "
    "CASE n WHEN 1 THEN 'Supplier#' || lpad(s::VARCHAR, 9, '0') WHEN 2 THEN 'base' || f WHEN 3 THEN 'svc' || s ELSE '' END AS host, "
    "CASE n WHEN 1 THEN 'Supplier#' || lpad(s::VARCHAR, 9, '0') WHEN 2 THEN '' WHEN 3 THEN 'svc' || s ELSE 'service' || s END AS target_service, CASE n WHEN 1 THEN 'mod' || s WHEN 4 THEN 'fm' ELSE '' END AS target_module FROM CF WHERE n <= 4"))
def http_facts(src: Source):
    calls = relation(src, "CF").withColumns({
        "receiver_kind": F.expr("CASE n WHEN 1 THEN 'rest_template' WHEN 2 THEN 'web_client' WHEN 3 THEN 'web_client' WHEN 4 THEN 'feign' ELSE 'jdbc' END"),
        "module": F.concat(F.lit("module"), "f"), "bean": F.expr("CASE WHEN s < 50 THEN 'Shop' ELSE 'other' END"), "target": F.expr("CASE n WHEN 4 THEN 'Client' || s END"),
        "name": F.expr("CASE n WHEN 1 THEN 'postForObject' WHEN 4 THEN 'store' ELSE 'get' END"), "verb": F.expr("CASE WHEN n IN (2, 3) THEN 'get' END"),
        "args": F.expr("CASE n WHEN 1 THEN array('http://Supplier#' || lpad(CAST(s AS STRING), 9, '0') || '/x') WHEN 2 THEN array('/rel') ELSE array('lb://svc' || s || '/y') END")})
    apps = src.sql("SELECT s_name AS app, 'mod' || s_suppkey AS module FROM supplier")
    base = src.sql("SELECT DISTINCT 'module' || l_returnflag AS module, 'web_client' AS client, 'shop' AS bean, 'http://base' || l_returnflag || ':80' AS base_url FROM lineitem")
    feign = src.sql("SELECT 'Client' || s_suppkey AS target, 'store' AS name, 'service' || s_suppkey AS service, '' AS url, 'PUT' AS http_method, '/feign/' || s_suppkey AS path, 'fm' AS target_module FROM supplier")
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return facts.http_facts(calls, apps, base, feign).select("call", "client", "http_method", "url", blank("host"), blank("target_service"), blank("target_module"))


@query("cache_messaging_http_facts", " UNION ALL ".join([
    f"SELECT call, 'messaging' AS kind, technology, destination AS target FROM ({ORACLE['message_facts']})",
    f"SELECT call, 'cache', technology, name FROM ({ORACLE['cache_facts']})",
    f"SELECT call, 'http', client, url FROM ({ORACLE['http_facts']})"]))
def cache_messaging_http_facts(src: Source):
    kind = lambda df, k, tech, target: df.select("call", F.lit(k).alias("kind"), F.col(tech).alias("technology"), F.col(target).alias("target"))
    return (kind(message_facts(src), "messaging", "technology", "destination").unionByName(kind(cache_facts(src), "cache", "technology", "name"))
            .unionByName(kind(http_facts(src), "http", "client", "url")))


@query("url_target", (
    "SELECT page_id, regexp_extract(url, '://([^/:]+)', 1) AS host, CASE WHEN regexp_extract(url, '://([^/:]+)', 1) LIKE 'blog.%' THEN 'blog' ELSE '' END AS target_module FROM pages"))
def url_target(src: Source):
    apps = src.sql("SELECT DISTINCT regexp_extract(url, '://([^/:]+)', 1) AS app, 'blog' AS module FROM pages").where("app LIKE 'blog.%'")
    return facts.url_target(src.table("pages"), "url", apps).select("page_id", "host", F.coalesce("target_module", F.lit("")).alias("target_module"))


# ---------------------------------------------------------------- endpoint roll-ups

_CLOSURE0 = ("SELECT origin, node FROM (WITH RECURSIVE r AS (SELECT origin, node FROM SEEDS UNION SELECT r.origin, g.callee FROM r JOIN G g ON g.caller = r.node) SELECT * FROM r)")


@query("endpoint_facts", oracle(
    f"SELECT DISTINCT c.origin AS endpoint, CASE l_linenumber WHEN 1 THEN 'databases' WHEN 2 THEN 'caches' WHEN 3 THEN 'external_apis' ELSE 'other' END AS grp, l_suppkey AS item "
    f"FROM ({_CLOSURE0}) c JOIN lineitem ON l_partkey = c.node"))
def endpoint_facts(src: Source):
    edges = relation(src, "G").selectExpr("caller AS src", "callee AS dst")
    closed = closure(edges, relation(src, "SEEDS"), include_seeds=True)
    f = src.sql("SELECT l_partkey AS method, CASE l_linenumber WHEN 1 THEN 'database' WHEN 2 THEN 'cache' WHEN 3 THEN 'http' ELSE 'x' END AS kind, l_suppkey AS item FROM lineitem")
    return facts.endpoint_facts(closed, f, ["item"])


RELATIONS["ST"] = ("SELECT 'e' || l_partkey AS endpoint, CASE l_linenumber WHEN 1 THEN 200 WHEN 2 THEN 201 WHEN 3 THEN 404 WHEN 4 THEN 409 WHEN 5 THEN 500 WHEN 6 THEN 302 ELSE 422 END AS code, "
                   "l_linenumber AS n, l_returnflag AS f, 's' || l_suppkey AS label, l_quantity AS q FROM lineitem")
_CODES = ("SELECT endpoint, code, '@ResponseStatus' AS source FROM ST WHERE n = 2 AND q > 48 UNION SELECT endpoint, code, 'ResponseEntity.ok' FROM ST WHERE n = 1 AND q > 45 UNION "
          "SELECT endpoint, code, 'deep in ' || label FROM ST WHERE f = 'A' AND code >= 400 UNION SELECT endpoint, code, 'NotFound (' || f || ')' FROM ST WHERE n = 3 UNION "
          "SELECT endpoint, 400, 'bean validation' FROM ST WHERE n = 7 AND q > 40")


@query("endpoint_status_codes", oracle(
    f"{_CODES} UNION SELECT 'e' || p_partkey, 200, 'default' FROM part WHERE 'e' || p_partkey NOT IN (SELECT endpoint FROM ({_CODES}) WHERE code BETWEEN 200 AND 299)"))
def endpoint_status_codes(src: Source):
    s = relation(src, "ST")
    return facts.endpoint_status_codes(
        s.where("n = 2 AND q > 48").select("endpoint", "code"), s.where("n = 1 AND q > 45").select("endpoint", "code", F.lit("ResponseEntity.ok").alias("source")),
        s.where("f = 'A'").select("endpoint", "code", F.lit("deep").alias("source"), "label"),
        s.where("n = 3").select("endpoint", "code", F.lit("NotFound").alias("exception"), F.col("f").alias("mapped_by")),
        s.where("n = 7 AND q > 40").select("endpoint"), src.sql("SELECT 'e' || p_partkey AS endpoint FROM part"))


_EXC = ("CASE l_linenumber WHEN 1 THEN 'com.Own' || l_suppkey WHEN 2 THEN 'com.Child' || l_suppkey WHEN 3 THEN 'com.Kid' WHEN 4 THEN 'javax.EntityNotFoundException' "
        "WHEN 5 THEN 'other.Own1' WHEN 6 THEN 'com.Strange' ELSE 'com.Private' || l_suppkey END")


@query("exception_mapping", (
    f"SELECT DISTINCT l_partkey AS endpoint, {_EXC} AS exception, CASE l_linenumber WHEN 1 THEN 410 WHEN 2 THEN 410 WHEN 3 THEN 409 WHEN 4 THEN 404 WHEN 5 THEN 410 WHEN 6 THEN 500 "
    "ELSE CASE WHEN l_returnflag = 'A' THEN 418 ELSE 418 END END AS status, CASE l_linenumber WHEN 1 THEN 'Advice.h' || l_suppkey WHEN 2 THEN 'Advice.h' || l_suppkey WHEN 3 THEN 'spring-default' "
    "WHEN 4 THEN 'spring-default' WHEN 5 THEN 'Advice.h1' WHEN 6 THEN 'unhandled' ELSE 'Ctl' || l_suppkey || '.local' END AS mapped_by FROM lineitem"))
def exception_mapping(src: Source):
    thrown = src.sql(f"SELECT DISTINCT l_partkey AS endpoint, 'Ctl' || l_suppkey AS controller, {_EXC} AS exception FROM lineitem")
    mappings = src.sql("SELECT 'com.Own' || s_suppkey AS exception, 410 AS status, 'Advice.h' || s_suppkey AS handler, true AS is_global, s_suppkey AS pos FROM supplier UNION ALL "
                       "SELECT 'com.Private' || s_suppkey, 418, 'Ctl' || s_suppkey || '.local', false, 1000000 + s_suppkey FROM supplier")
    anc = src.sql("SELECT 'com.Child' || s_suppkey AS exception, 'com.Own' || s_suppkey AS ancestor, 1 AS depth FROM supplier UNION ALL "
                  "SELECT 'com.Kid', 'org.OptimisticLockingFailureException', max(1) FROM supplier")
    return facts.exception_mapping(thrown, mappings, anc, ["endpoint"]).drop("controller").distinct()


_PATH = "regexp_extract(url, '^\\\\w+://[^/]+([^?#]*)', 1)"
_TLD = "regexp_extract(url, '^\\\\w+://[^/]*?\\\\.(com|net|org)', 1)"


def _duck(text: str) -> str:
    return text.replace("\\\\", "\\")


@query("security_rule", _duck(
    f"SELECT page_id, CASE WHEN regexp_full_match(path, '/en(/.*)?') AND page_id < 0 THEN '' WHEN regexp_full_match(path, '/fr(/.*)?') AND m = 'com' THEN 'french' "
    f"WHEN regexp_full_match(path, '/[^/]*/[^/]*') AND v = 'GET' THEN 'two-parts' WHEN regexp_full_match(path, '/en(/.*)?') THEN 'english' WHEN m <> 'net' THEN 'rest' ELSE 'none' END AS rule "
    f"FROM (SELECT page_id, {_PATH} AS path, {_TLD} AS m, CASE WHEN url LIKE 'https%' THEN 'GET' ELSE 'POST' END AS v FROM pages)"))
def security_rule(src: Source):
    ends = src.sql(f"SELECT page_id AS endpoint, {_TLD} AS module, CASE WHEN url LIKE 'https%' THEN 'GET' ELSE 'POST' END AS method, {_PATH} AS path FROM pages")
    mods = ends.select("module").distinct()
    rule = lambda n, o, verb, p, cond: mods.where(cond).select("module", F.lit(n).alias("rule"), F.lit(o).alias("ord"), F.lit(verb).cast("string").alias("http_method"), F.array(F.lit(p)).alias("patterns"))
    url_rules = (rule("french", 1, None, "/fr/**", "module = 'com'").unionByName(rule("two-parts", 2, "GET", "/*/*", "true"))
                 .unionByName(rule("english", 3, None, "/en/**", "true")).unionByName(rule("rest", 4, None, "/**", "module <> 'net'")))
    return facts.security_rule(ends, url_rules).select(F.col("endpoint").alias("page_id"), F.coalesce("rule", F.lit("none")).alias("rule"))


@query("endpoints_from_mappings", (
    "SELECT p_partkey AS handler, v.method, '/' || lower(r_name) || CASE s.p WHEN '' THEN '' ELSE '/' || s.p END AS path FROM part, region, "
    "(VALUES ('GET'), ('POST')) AS v(method), (VALUES ('a'), ('')) AS s(p) WHERE (p_size < 25) = (v.method = 'GET') OR (p_size >= 25 AND p_type = 'PROMO')"))
def endpoints_from_mappings(src: Source):
    controllers = src.sql("SELECT 1 AS controller, collect_list('/' || lower(r_name) || '/') AS base_paths FROM region")
    methods = src.sql("SELECT 1 AS controller, p_partkey AS handler, CASE WHEN p_size < 25 THEN 'GetMapping' ELSE 'RequestMapping' END AS annotation, array('/a/', '') AS paths, "
                      "CASE WHEN p_size >= 25 AND p_type = 'PROMO' THEN array('GET', 'POST') ELSE array('POST') END AS verbs FROM part")
    return facts.endpoints_from_mappings(controllers, methods).select("handler", "method", "path")


@query("inherited_mappings", oracle(
    "SELECT t AS method, min_by(o, d) AS owner FROM (SELECT p_partkey AS t, p_partkey AS o, 0 AS d FROM part UNION ALL SELECT type, ancestor, depth FROM SUPER) JOIN part q ON q.p_partkey = o "
    "WHERE q.p_type = 'PROMO' GROUP BY t"))
def inherited_mappings(src: Source):
    methods = src.sql("SELECT p_partkey AS method, p_partkey AS owner, 'run' AS name, 2 AS n_params FROM part")
    mapped = src.sql("SELECT p_partkey AS owner, 'run' AS name, 2 AS n_params, 'GetMapping' AS annotation FROM part WHERE p_type = 'PROMO'")
    return facts.inherited_mappings(methods, mapped, _supers(src)).select("method", "owner")


@query("param_contract", (
    "SELECT o_orderkey, o_orderstatus AS name0, CASE o_orderstatus WHEN 'F' THEN 'X-Id' WHEN 'O' THEN 'body' ELSE p.n END AS name, "
    "CASE o_orderstatus WHEN 'F' THEN 'header' WHEN 'O' THEN 'body' ELSE 'query' END AS loc, CASE o_orderstatus WHEN 'F' THEN o_orderpriority <> '1-URGENT' WHEN 'O' THEN true ELSE false END AS required, "
    "CASE o_orderstatus WHEN 'F' THEN 'max=' || o_custkey || ',min=1,notBlank=true,notEmpty=true,required=true' ELSE '' END AS rules FROM orders JOIN (VALUES ('page'), ('size'), ('sort')) AS p(n) ON o_orderstatus = 'P' OR n = 'page'"))
def param_contract(src: Source):
    args = lambda *kv: F.create_map(*[F.lit(x) if isinstance(x, str) else x for x in kv]).cast("map<string,string>")
    ann = lambda n, m: F.struct(F.lit(n).alias("name"), m.alias("args"))
    no = F.create_map().cast("map<string,string>")
    header = F.when(F.col("o_orderpriority") == "1-URGENT", args("name", "X-Id", "required", "false")).otherwise(args("value", "X-Id"))
    listed = (F.when(F.col("o_orderstatus") == "F", F.array(ann("RequestHeader", header), ann("NotBlank", no), ann("NotNull", no),
                                                            ann("Size", args("min", "1", "max", F.col("o_custkey").cast("string")))))
              .when(F.col("o_orderstatus") == "O", F.array(ann("RequestBody", args("value", "ignored")), ann("Valid", no))).otherwise(F.slice(F.array(ann("x", no)), 1, 0)))
    o = src.table("orders")
    typed = F.expr("CASE o_orderstatus WHEN 'F' THEN 'String' WHEN 'O' THEN 'Order' ELSE 'Pageable' END")
    real = o.select("o_orderkey", "o_orderstatus", F.lit(0).alias("pos"), F.lit("body").alias("name"), typed.alias("type"), listed.alias("annotations"))
    noise = real.withColumns({"pos": F.lit(1), "type": F.lit("HttpServletRequest")})
    enums = src.sql("SELECT DISTINCT o_orderstatus AS type FROM orders")
    out = facts.param_contract(real.unionByName(noise), enums, ["o_orderkey", "o_orderstatus"])
    text = F.array_join(F.transform(F.array_sort(F.map_entries("validation")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return out.select("o_orderkey", F.col("o_orderstatus").alias("name0"), "name", "loc", "required", text.alias("rules"))


@query("feign_operations", (
    "SELECT p_partkey AS client, 'op' AS name, CASE WHEN p_size < 25 THEN 'DELETE' ELSE 'GET' END AS http_method, '/base' || '/m' || CASE WHEN p_size < 25 THEN '/x' ELSE '/line?q=1' END AS path, "
    "coalesce('mod' || s_suppkey, '') AS target_module FROM part LEFT JOIN supplier ON s_suppkey = p_partkey"))
def feign_operations(src: Source):
    clients = src.sql("SELECT p_partkey AS client, 'svc' || p_partkey AS service, '/base' AS base_path, '/m' AS mapping_path FROM part")
    methods = src.sql("SELECT p_partkey AS client, 'op' AS name, CASE WHEN p_size < 25 THEN 'DeleteMapping' END AS annotation, CAST(NULL AS STRING) AS verb, '/x' AS path, 'GET /line?q=1' AS request_line FROM part "
                      "UNION ALL SELECT p_partkey, 'helper', NULL, NULL, NULL, NULL FROM part")
    apps = src.sql("SELECT 'svc' || s_suppkey AS app, 'mod' || s_suppkey AS module FROM supplier")
    return facts.feign_operations(clients, methods, apps).select("client", "name", "http_method", "path", F.coalesce("target_module", F.lit("")).alias("target_module"))


@query("module_of_file", (
    "SELECT p_partkey, CASE WHEN p_size < 10 THEN '' WHEN p_type = 'PROMO' THEN 'apps/' || p_brand || '/PROMO' WHEN p_brand < 'Brand#3' THEN 'apps/' || p_brand ELSE 'apps' END AS module FROM part"))
def module_of_file(src: Source):
    files = src.sql("SELECT p_partkey, CASE WHEN p_size < 10 THEN 'appsx/' ELSE 'apps/' END || p_brand || '/' || p_type || '/src/' || p_partkey || '.java' AS path FROM part")
    modules = src.sql("SELECT DISTINCT 'apps/' || p_brand || '/PROMO' AS dir FROM part UNION SELECT DISTINCT 'apps/' || p_brand FROM part WHERE p_brand < 'Brand#3' UNION SELECT DISTINCT 'apps' FROM part")
    return facts.module_of_file(files, modules).select("p_partkey", "module")


@query("listener_topology", (
    "SELECT event_id, CASE event_type WHEN 'click' THEN 'kafka' WHEN 'view' THEN 'spring-event' WHEN 'error' THEN 'schedule' ELSE 'jms' END AS technology, "
    "CASE event_type WHEN 'click' THEN unnest(['t' || user_id, 'dlq']) WHEN 'view' THEN 'Paid' || user_id WHEN 'error' THEN '' ELSE 'q' || user_id END AS destination, "
    "CASE event_type WHEN 'error' THEN 'cron=0 * * * *,zone=UTC' ELSE '' END AS schedule FROM events WHERE event_type <> 'signup'").replace(
        "unnest(['t' || user_id, 'dlq'])", "d").replace("FROM events WHERE", "FROM (SELECT *, 't' || user_id AS d FROM events UNION ALL SELECT *, 'dlq' FROM events WHERE event_type = 'click') WHERE"))
def listener_topology(src: Source):
    texts = lambda *xs: F.array(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    user = lambda p: F.concat(F.lit(p), "user_id")
    args = (F.when(F.col("event_type") == "click", F.create_map(F.lit("topics"), texts(user("t"), "dlq"), F.lit("groupId"), texts("g")))
            .when(F.col("event_type") == "error", F.create_map(F.lit("zone"), texts("UTC"), F.lit("cron"), texts("0 * * * *")))
            .when(F.col("event_type") == "purchase", F.create_map(F.lit("destination"), texts(user("q")))).otherwise(F.create_map().cast("map<string,array<string>>")))
    name = F.expr("CASE event_type WHEN 'click' THEN 'KafkaListener' WHEN 'view' THEN 'EventListener' WHEN 'error' THEN 'Scheduled' WHEN 'purchase' THEN 'JmsListener' ELSE 'Transactional' END")
    rows = src.table("events").select(F.col("event_id").alias("method"), name.alias("annotation"), args.alias("args"), user("Paid").alias("payload_type"))
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return facts.listener_topology(rows).select(F.col("method").alias("event_id"), "technology", blank("destination"), blank("schedule"))
