"""Change impact operators on line ranges and the call graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import impact
from ..operators.closure import call_tree, closure
from .bindings import RELATIONS, oracle, relation
from .registry import Source, query

# every brand is a file with one outer type, one nested type per part, one method inside each
RELATIONS["T"] = ("SELECT 'T' || p_partkey AS type, p_brand AS file, 10 * p_partkey - 2 AS t_start, 10 * p_partkey + p_size + 2 AS t_end, p_brand AS outer_type FROM part "
                  "UNION ALL SELECT p_brand, p_brand, 0, max(10 * p_partkey + 60), NULL FROM part GROUP BY p_brand")

_HT = "SELECT h.hunk, h.file, t.type, t.outer_type FROM H h JOIN T t ON h.file = t.file AND h.h_start <= t.t_end AND t.t_start <= h.h_end"
_HM = "SELECT h.hunk, 'T' || m.id AS type, m.id FROM H h JOIN M m ON h.file = m.file AND h.h_start <= m.line_end AND m.line_start <= h.h_end"
RELATIONS["HT"], RELATIONS["HM"] = _HT, _HM
RELATIONS["CT"] = ("SELECT DISTINCT type FROM HT a WHERE NOT EXISTS (SELECT 1 FROM HM b WHERE b.hunk = a.hunk AND b.type = a.type) "
                   "AND NOT EXISTS (SELECT 1 FROM HT c WHERE c.hunk = a.hunk AND c.outer_type = a.type)")
RELATIONS["CM"] = "SELECT id FROM HM UNION SELECT id FROM M WHERE 'T' || id IN (SELECT type FROM CT)"


def _changed(src: Source):
    types = relation(src, "T").withColumnRenamed("outer_type", "outer")
    methods = relation(src, "M").selectExpr("id AS method", "'T' || id AS type", "file", "line_start AS m_start", "line_end AS m_end")
    return impact.changed_symbols(relation(src, "H"), types, methods)


@query("changed_symbols", oracle("SELECT 'type' AS symbol_kind, type AS symbol FROM CT UNION ALL SELECT 'method', CAST(id AS VARCHAR) FROM CM"))
def changed_symbols(src: Source):
    return _changed(src)


@query("hunk_methods", oracle("SELECT hunk, id FROM HM"))
def hunk_methods(src: Source):
    from ..operators.intervals import overlap_join
    return overlap_join(relation(src, "H"), relation(src, "M"), ["file"], ("h_start", "h_end"), ("line_start", "line_end")).select("hunk", "id")


def _edges(src: Source):
    return relation(src, "G").selectExpr("caller AS src", "callee AS dst")


def _closure(seeds: str, up: bool = False) -> str:
    """SQL: closure of (origin, node) rows over the call graph, without the starts."""
    a, b = ("callee", "caller") if up else ("caller", "callee")
    return oracle(f"SELECT * FROM (WITH RECURSIVE r AS (SELECT DISTINCT s.origin, g.{b} AS node FROM ({seeds}) s JOIN G g ON g.{a} = s.node "
                  f"UNION SELECT r.origin, g.{b} FROM r JOIN G g ON g.{a} = r.node) SELECT origin, node FROM r)")


@query("reachable", _closure("SELECT * FROM SEEDS"))
def reachable_methods(src: Source):
    return closure(_edges(src), relation(src, "SEEDS")).select("origin", "node")


@query("call_tree", oracle(
    "SELECT * FROM (WITH RECURSIVE t AS (SELECT node AS root, [node] AS path, node, 0 AS depth FROM SEEDS UNION ALL "
    "SELECT t.root, list_append(t.path, g.callee), g.callee, t.depth + 1 FROM t JOIN G g ON g.caller = t.node WHERE t.depth < 6 "
    "AND NOT list_contains(t.path[1:t.depth], t.node)) SELECT root, array_to_string(path, '>') AS path, depth FROM t WHERE depth > 0)"))
def call_tree_paths(src: Source):
    tree = call_tree(_edges(src), relation(src, "SEEDS"))
    return tree.select("root", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"), "depth")


# changed methods: the largest parts of each type, with their reason
_REASONS = "SELECT 'changed: ' || p_type AS origin, max(p_partkey) AS node FROM part WHERE p_size = 50 GROUP BY p_type"
_UP = _closure(_REASONS, up=True)


def _reached(src: Source, handlers=None):
    # one start for each type with a part of that size: the changed methods are the input here
    reasons = src.sql(_REASONS).selectExpr("origin AS reason", "node AS method")
    return impact.propagate_reasons(relation(src, "G"), reasons, handlers=handlers)


@query("propagate_reasons", f"SELECT node AS method, origin AS reason FROM ({_UP}) UNION SELECT node, origin FROM ({_REASONS})")
def propagate_reasons(src: Source):
    return _reached(src)


@query("repo_usage_reasons", (
    "SELECT DISTINCT l_partkey AS method, 'uses changed repository/entity: ' || s_name AS reason FROM lineitem JOIN supplier ON l_suppkey = s_suppkey "
    "WHERE s_acctbal > 9000 OR s_nationkey = 3"))
def repo_usage_reasons(src: Source):
    facts = src.sql("SELECT l_partkey AS method, s_name AS repository FROM lineitem JOIN supplier ON l_suppkey = s_suppkey")
    repos = src.sql("SELECT s_name AS repository, 'repo' || s_suppkey AS type, 'nation' || s_nationkey AS entity FROM supplier")
    changed = src.sql("SELECT 'repo' || s_suppkey AS type FROM supplier WHERE s_acctbal > 9000 UNION ALL SELECT 'nation' || n_nationkey FROM nation WHERE n_nationkey = 3")
    return impact.repo_usage_reasons(facts, repos, changed)


_REF = "SELECT DISTINCT 'e' || l_partkey AS endpoint, 'com.shop.' || CAST(l_suppkey AS VARCHAR(20)) AS type FROM lineitem"
_CHANGED_TYPES = "SELECT 'com.shop.' || CAST(s_suppkey AS VARCHAR(20)) AS type FROM supplier WHERE s_acctbal > 9000"
_IMPACTED = (f"SELECT 'e' || method AS endpoint, reason FROM (SELECT node AS method, origin AS reason FROM ({_UP}) UNION SELECT node, origin FROM ({_REASONS})) UNION "
             f"SELECT r.endpoint, 'changed model: ' || substr(r.type, 10) FROM ({_REF}) r JOIN ({_CHANGED_TYPES}) c ON r.type = c.type")


def _impacted(src: Source):
    ends = src.sql("SELECT 'e' || p_partkey AS endpoint, p_partkey AS handler FROM part")
    return impact.impacted_endpoints(_reached(src, ends.selectExpr("handler AS method")), ends, src.sql(_REF), src.sql(_CHANGED_TYPES))


@query("impacted_endpoints", _IMPACTED)
def impacted_endpoints(src: Source):
    return _impacted(src)


@query("endpoint_model_changes", (
    f"SELECT DISTINCT r.endpoint, r.type AS dto, 'balance' AS field FROM ({_REF}) r JOIN supplier ON r.type = 'com.shop.' || s_suppkey "
    f"WHERE s_acctbal < 0 AND r.endpoint IN (SELECT endpoint FROM ({_IMPACTED}))"))
def endpoint_model_changes(src: Source):
    changes = src.sql("SELECT 'com.shop.' || s_suppkey AS dto, 'balance' AS field, 'TYPE_CHANGED' AS type FROM supplier WHERE s_acctbal < 0")
    return impact.endpoint_model_changes(_impacted(src), src.sql(_REF), changes).drop("change")


_PY = "SELECT p_brand || CASE WHEN p_type = 'PROMO' THEN '.py' ELSE '.java' END AS file, 'f' || p_partkey AS function FROM part"
_FILES = "SELECT DISTINCT 'Brand#' || (1 + c_nationkey) || '.py' AS file FROM customer WHERE c_acctbal > 9900"


@query("changed_functions_file_level", f"SELECT DISTINCT function FROM ({_PY}) WHERE file IN (SELECT file FROM ({_FILES}))")
def changed_functions_file_level(src: Source):
    return impact.changed_functions(src.sql(_PY), src.sql(_FILES))


@query("function_impact", oracle(
    "SELECT * FROM (WITH RECURSIVE e AS (SELECT 'f' || caller AS src, 'f' || callee AS dst FROM G), s AS "
    "(SELECT 'f' || min(p_partkey) AS origin FROM part WHERE p_type = 'PROMO' GROUP BY p_brand), r AS "
    "(SELECT DISTINCT s.origin, e.dst AS node FROM s JOIN e ON e.src = s.origin UNION SELECT r.origin, e.dst FROM r JOIN e ON e.src = r.node) "
    "SELECT origin AS function, node AS callee FROM r WHERE origin <> node)"))
def function_impact(src: Source):
    # one calls array per function: both callees as call texts
    routes = src.sql(oracle("SELECT 'f' || caller AS function, collect_list('self.repo.f' || callee || '(x)') AS calls FROM G GROUP BY caller"))
    changed = src.sql("SELECT 'f' || min(p_partkey) AS function FROM part WHERE p_type = 'PROMO' GROUP BY p_brand")
    return impact.function_impact(routes, changed)


@query("displayable", (
    "WITH l AS (SELECT DISTINCT l_orderkey, l_partkey AS method FROM lineitem), m AS (SELECT p_partkey AS method, p_type AS name, p_size < 15 AS abstract FROM part) "
    "SELECT l.l_orderkey, l.method FROM l JOIN m ON l.method = m.method WHERE NOT (m.abstract AND EXISTS (SELECT 1 FROM l k JOIN m n ON k.method = n.method "
    "WHERE k.l_orderkey = l.l_orderkey AND n.name = m.name AND NOT n.abstract))"))
def displayable(src: Source):
    listed = src.sql("SELECT DISTINCT l_orderkey, l_partkey AS method FROM lineitem")
    methods = src.sql("SELECT p_partkey AS method, p_type AS name, p_size < 15 AS abstract FROM part")
    return impact.displayable(listed, methods, ["l_orderkey"])


_CALLS = "SELECT event_id, event_type, user_id FROM events"


@query("call_name", (
    "SELECT event_id, CASE WHEN event_type = 'error' THEN 'err' ELSE event_type END || ',load' || user_id AS names, CASE WHEN event_type = 'error' THEN 'err' ELSE event_type END || "
    "',load' || user_id || ',load' || user_id || ',validate_' || event_type AS entries FROM events"))
def call_name(src: Source):
    # names: repeated and validating calls vanish; entries: call order, only builtins vanish
    name = F.expr("CASE WHEN event_type = 'error' THEN 'err' ELSE event_type END")
    calls = F.array(F.concat(F.lit("svc.api."), name, F.lit("(a.b(c))")), F.concat(F.lit(" load"), "user_id", F.lit("()")), F.lit("text.strip()"),
                    F.concat(F.lit("x.load"), "user_id", F.lit("(1)")), F.lit("isinstance(a, b)"), F.concat(F.lit("validate_"), "event_type", F.lit("(q)")))
    names = impact.service_calls(calls)
    # sorted names: event types sort before or after load..., so show them in call order
    return src.table("events").select(
        "event_id", F.array_join(F.concat(F.filter(names, lambda n: ~n.startswith("load")), F.filter(names, lambda n: n.startswith("load"))), ",").alias("names"),
        F.array_join(impact.call_graph_entries(calls), ",").alias("entries"))
