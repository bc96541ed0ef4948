"""Contract diff operators on the snapshot relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import diff
from ..operators.snapshots import on_both_sides
from .bindings import access, fields, oracle, relation
from .registry import Source, query

K = ("api",)
B = "WHERE h.api IN (SELECT api FROM R_both)"


def _both(src: Source):
    return on_both_sides(relation(src, "R_base"), relation(src, "R_head"), K)


def _kind(df, kind: str):
    return df.where(F.col("type") == kind).drop("type")


def _routes(src: Source):
    return diff.pair_routes(relation(src, "R_base"), relation(src, "R_head"), K)


_CHANGE = "'breaking' AS severity, '' AS item, {detail} AS detail FROM R_base b JOIN R_head h ON b.api = h.api WHERE {cond}"


def _route_sql(detail: str, cond: str) -> str:
    return oracle("SELECT h.api, " + _CHANGE.format(detail=detail, cond=cond))


@query("diff_endpoint_changed", _route_sql(
    "b.method || ' ' || b.path || ' → ' || h.method || ' ' || h.path",
    "b.method IS DISTINCT FROM h.method OR b.path IS DISTINCT FROM h.path"))
def diff_endpoint_changed(src: Source):
    return _kind(diff.route_changes(_routes(src), K), "ENDPOINT_CHANGED")


@query("diff_request_body_changed", _route_sql(
    "'request body ' || coalesce(b.body_type, 'None') || ' → ' || coalesce(h.body_type, 'None')",
    "b.body_type IS DISTINCT FROM h.body_type"))
def diff_request_body_changed(src: Source):
    return _kind(diff.route_changes(_routes(src), K), "REQUEST_BODY_CHANGED")


@query("diff_response_type_changed", _route_sql(
    "coalesce(b.response_type, 'None') || ' → ' || coalesce(h.response_type, 'None')",
    "b.response_type IS DISTINCT FROM h.response_type"))
def diff_response_type_changed(src: Source):
    return _kind(diff.route_changes(_routes(src), K), "RESPONSE_TYPE_CHANGED")


@query("diff_endpoint_added", oracle(
    "SELECT api, 'additive' AS severity, '' AS item, method || ' ' || path AS detail FROM R_head "
    "WHERE api NOT IN (SELECT api FROM R_base)"))
def diff_endpoint_added(src: Source):
    return _kind(diff.endpoint_presence(_routes(src), K), "ENDPOINT_ADDED")


@query("diff_endpoint_removed", oracle(
    "SELECT api, 'breaking' AS severity, '' AS item, method || ' ' || path AS detail FROM R_base "
    "WHERE api NOT IN (SELECT api FROM R_head)"))
def diff_endpoint_removed(src: Source):
    return _kind(diff.endpoint_presence(_routes(src), K), "ENDPOINT_REMOVED")


# ---------------------------------------------------------------- parameters

_PKEY = "b.api = h.api AND b.loc IS NOT DISTINCT FROM h.loc AND b.name = h.name"
_PNAME = "coalesce(h.loc, 'None') || ' parameter `' || h.name || '`'"
_PITEM = "coalesce(h.loc, '') || ':' || h.name AS item"


def _params(src: Source):
    return diff.param_changes(relation(src, "P_base"), relation(src, "P_head"), _both(src), K, pos=None)


@query("diff_param_added", oracle(
    f"SELECT h.api, CASE WHEN h.required THEN 'breaking' ELSE 'additive' END AS severity, {_PITEM}, "
    f"{_PNAME} || ' (' || coalesce(h.type, 'None') || ')' || CASE WHEN h.required THEN ' is required' ELSE ' (optional)' END AS detail "
    f"FROM P_head h {B} AND NOT EXISTS (SELECT 1 FROM P_base b WHERE {_PKEY})"))
def diff_param_added(src: Source):
    return _kind(_params(src), "PARAM_ADDED")


@query("diff_param_type_changed", oracle(
    f"SELECT h.api, 'breaking' AS severity, {_PITEM}, "
    f"{_PNAME} || ': ' || coalesce(b.type, 'None') || ' → ' || coalesce(h.type, 'None') AS detail "
    f"FROM P_head h JOIN P_base b ON {_PKEY} {B} AND b.type IS DISTINCT FROM h.type"))
def diff_param_type_changed(src: Source):
    return _kind(_params(src), "PARAM_TYPE_CHANGED")


@query("diff_param_now_required", oracle(
    f"SELECT h.api, 'breaking' AS severity, {_PITEM}, {_PNAME} || ' became required' AS detail "
    f"FROM P_head h JOIN P_base b ON {_PKEY} {B} AND h.required AND NOT coalesce(b.required, false)"))
def diff_param_now_required(src: Source):
    return _kind(_params(src), "PARAM_NOW_REQUIRED")


@query("diff_param_removed", oracle(
    f"SELECT h.api, CASE WHEN h.loc = 'path' THEN 'breaking' ELSE 'minor' END AS severity, {_PITEM}, "
    f"{_PNAME} || ' removed' AS detail FROM P_base h {B} AND NOT EXISTS (SELECT 1 FROM P_head b WHERE {_PKEY})"))
def diff_param_removed(src: Source):
    return _kind(_params(src), "PARAM_REMOVED")


@query("contract_params", oracle(
    "SELECT api, coalesce(loc, '') AS loc, name, type, required FROM P_base WHERE loc IS NULL OR loc <> 'header'"))
def contract_params(src: Source):
    # header parameters play the part of body ones; every parameter is sent twice, the last wins
    base = relation(src, "P_base")
    twice = (base.withColumn("pos", F.lit(1)).withColumn("type", F.lit("older"))
             .unionByName(base.withColumn("pos", F.lit(2))))
    renamed = twice.withColumn("loc", F.when(F.col("loc") == "header", "body").otherwise(F.col("loc")))
    return diff.contract_params(renamed, K).select("api", F.coalesce("loc", F.lit("")).alias("loc"), "name", "type", "required")


# ---------------------------------------------------------------- fields

_FKEY = "b.api = h.api AND b.path = h.path"
_F = "'`' || h.path || '`'"


def _pairs(src: Source):
    return diff.pair_fields(fields(src, "base"), fields(src, "head"), _both(src), K)


def _req(src: Source):
    return diff.request_field_changes(_pairs(src), K)


def _resp(src: Source):
    return diff.response_field_changes(relation(src, "O_base"), relation(src, "O_head"), _both(src), K)


def _rules(src: Source):
    return diff.validation_changes(_pairs(src), K)


@query("diff_request_field_added", oracle(
    f"SELECT h.api, CASE WHEN h.required THEN 'breaking' ELSE 'additive' END AS severity, h.path AS item, "
    f"{_F} || ' (' || coalesce(h.type, 'None') || ')' || CASE WHEN h.required THEN ' is required' ELSE ' (optional)' END AS detail "
    f"FROM F_head h {B} AND NOT EXISTS (SELECT 1 FROM F_base b WHERE {_FKEY})"))
def diff_request_field_added(src: Source):
    return _kind(_req(src), "REQUEST_FIELD_ADDED")


@query("diff_request_field_type_changed", oracle(
    f"SELECT h.api, 'breaking' AS severity, h.path AS item, "
    f"{_F} || ': ' || coalesce(b.type, 'None') || ' → ' || coalesce(h.type, 'None') AS detail "
    f"FROM F_head h JOIN F_base b ON {_FKEY} {B} AND b.type IS DISTINCT FROM h.type"))
def diff_request_field_type_changed(src: Source):
    return _kind(_req(src), "REQUEST_FIELD_TYPE_CHANGED")


@query("diff_request_field_removed", oracle(
    f"SELECT h.api, 'minor' AS severity, h.path AS item, {_F} || ' is no longer read' AS detail "
    f"FROM F_base h {B} AND NOT EXISTS (SELECT 1 FROM F_head b WHERE {_FKEY})"))
def diff_request_field_removed(src: Source):
    return _kind(_req(src), "REQUEST_FIELD_REMOVED")


def _rule_sql(rule_cond: str, severity: str, detail: str) -> str:
    side = lambda s: (f"SELECT api, path, 'min' AS rule, rule_min AS value FROM F_{s} WHERE rule_min IS NOT NULL UNION ALL "
                      f"SELECT api, path, 'pattern', rule_pattern FROM F_{s} WHERE rule_pattern IS NOT NULL")
    return oracle(
        f"SELECT coalesce(b.api, h.api) AS api, '{severity}' AS severity, "
        f"coalesce(b.path, h.path) || ':' || coalesce(b.rule, h.rule) AS item, '`' || coalesce(b.path, h.path) || '`' || {detail} AS detail "
        f"FROM ({side('base')}) b FULL JOIN ({side('head')}) h ON b.api = h.api AND b.path = h.path AND b.rule = h.rule "
        f"WHERE {rule_cond} AND coalesce(b.api, h.api) IN (SELECT api FROM R_both) AND (coalesce(b.api, h.api), coalesce(b.path, h.path)) IN "
        f"(SELECT (api, path) FROM F_base INTERSECT SELECT (api, path) FROM F_head)")


@query("diff_validation_added", _rule_sql("b.rule IS NULL", "breaking", "' now validated: ' || h.rule || '=' || h.value"))
def diff_validation_added(src: Source):
    return _kind(_rules(src), "VALIDATION_ADDED")


@query("diff_validation_changed", _rule_sql("b.value <> h.value", "breaking", "' ' || h.rule || ': ' || b.value || ' → ' || h.value"))
def diff_validation_changed(src: Source):
    return _kind(_rules(src), "VALIDATION_CHANGED")


@query("diff_validation_removed", _rule_sql("h.rule IS NULL", "minor", "' no longer validated: ' || b.rule"))
def diff_validation_removed(src: Source):
    return _kind(_rules(src), "VALIDATION_REMOVED")


@query("diff_response_field_removed", oracle(
    f"SELECT h.api, 'breaking' AS severity, h.path AS item, {_F} || ' is no longer returned' AS detail "
    f"FROM O_base h {B} AND NOT EXISTS (SELECT 1 FROM O_head b WHERE {_FKEY})"))
def diff_response_field_removed(src: Source):
    return _kind(_resp(src), "RESPONSE_FIELD_REMOVED")


@query("diff_response_field_type_changed", oracle(
    f"SELECT h.api, 'breaking' AS severity, h.path AS item, "
    f"{_F} || ': ' || coalesce(b.type, 'None') || ' → ' || coalesce(h.type, 'None') AS detail "
    f"FROM O_head h JOIN O_base b ON {_FKEY} {B} AND b.type IS DISTINCT FROM h.type"))
def diff_response_field_type_changed(src: Source):
    return _kind(_resp(src), "RESPONSE_FIELD_TYPE_CHANGED")


@query("diff_response_field_added", oracle(
    f"SELECT h.api, 'additive' AS severity, h.path AS item, {_F} || ' (' || coalesce(h.type, 'None') || ')' AS detail "
    f"FROM O_head h {B} AND NOT EXISTS (SELECT 1 FROM O_base b WHERE {_FKEY})"))
def diff_response_field_added(src: Source):
    return _kind(_resp(src), "RESPONSE_FIELD_ADDED")


# ---------------------------------------------------------------- statuses, access, downstream, models

def _statuses(src: Source):
    return diff.status_changes(relation(src, "S_base"), relation(src, "S_head"), _both(src), K)


@query("diff_success_status_changed", oracle(
    "SELECT o.api, 'breaking' AS severity, '' AS item, '[' || o.codes || '] → [' || n.codes || ']' AS detail FROM "
    "(SELECT api, string_agg(code, ', ' ORDER BY code) AS codes FROM S_base WHERE code < 300 GROUP BY api) o JOIN "
    "(SELECT api, string_agg(code, ', ' ORDER BY code) AS codes FROM S_head WHERE code < 300 GROUP BY api) n ON o.api = n.api "
    "WHERE o.codes <> n.codes AND o.api IN (SELECT api FROM R_both)"))
def diff_success_status_changed(src: Source):
    return _kind(_statuses(src), "SUCCESS_STATUS_CHANGED")


@query("diff_error_status_added", oracle(
    "SELECT api, 'minor' AS severity, CAST(code AS VARCHAR) AS item, 'may now return ' || code AS detail FROM "
    "(SELECT api, code FROM S_head WHERE code >= 400 EXCEPT SELECT api, code FROM S_base) WHERE api IN (SELECT api FROM R_both)"))
def diff_error_status_added(src: Source):
    return _kind(_statuses(src), "ERROR_STATUS_ADDED")


@query("diff_error_status_removed", oracle(
    "SELECT api, 'additive' AS severity, CAST(code AS VARCHAR) AS item, 'no longer returns ' || code AS detail FROM "
    "(SELECT api, code FROM S_base WHERE code >= 400 EXCEPT SELECT api, code FROM S_head) WHERE api IN (SELECT api FROM R_both)"))
def diff_error_status_removed(src: Source):
    return _kind(_statuses(src), "ERROR_STATUS_REMOVED")


_SEC = "(SELECT api, string_agg(annotation || ':' || expression, ', ' ORDER BY annotation || ':' || expression) AS f FROM {} GROUP BY api)"


@query("diff_security_changed", oracle(
    "SELECT coalesce(b.api, h.api) AS api, 'breaking' AS severity, '' AS item, 'access rules changed' AS detail, "
    "b.f AS \"old\", h.f AS \"new\" FROM " + _SEC.format("A_base") + " b FULL JOIN " + _SEC.format("A_head") +
    " h ON b.api = h.api WHERE b.f IS DISTINCT FROM h.f AND coalesce(b.api, h.api) IN (SELECT api FROM R_both)"))
def diff_security_changed(src: Source):
    return _kind(diff.security_changes(access(src, "base"), access(src, "head"), _both(src), K), "SECURITY_CHANGED")


@query("diff_downstream", oracle(
    "SELECT api, grp, item, 'added' AS change FROM (SELECT * FROM D_head EXCEPT SELECT * FROM D_base) WHERE api IN (SELECT api FROM R_both) "
    "UNION ALL SELECT api, grp, item, 'removed' FROM (SELECT * FROM D_base EXCEPT SELECT * FROM D_head) WHERE api IN (SELECT api FROM R_both)"))
def diff_downstream(src: Source):
    return diff.downstream_delta(relation(src, "D_base"), relation(src, "D_head"), _both(src), K)


@query("dependency_items", oracle(
    "SELECT coalesce(b.api, h.api) AS api, coalesce(b.grp, h.grp) AS grp, coalesce(b.item, h.item) AS item, "
    "CASE WHEN h.api IS NULL THEN 'removed' WHEN b.api IS NULL THEN 'new' ELSE 'same' END AS status "
    "FROM D_base b FULL JOIN D_head h ON b.api = h.api AND b.grp = h.grp AND b.item = h.item"))
def dependency_items(src: Source):
    return diff.dependency_items(relation(src, "D_base"), relation(src, "D_head"), K)


_MODEL_RULES = ("SELECT {c} AS dto, path, 'min' AS rule, rule_min AS value FROM F_{s} WHERE rule_min IS NOT NULL UNION ALL "
                "SELECT {c}, path, 'pattern', rule_pattern FROM F_{s} WHERE rule_pattern IS NOT NULL")


@query("model_field_changes", oracle(
    "SELECT coalesce(b.api, h.api) AS dto, coalesce(b.path, h.path) AS field, "
    "CASE WHEN h.api IS NULL THEN 'FIELD_REMOVED' WHEN b.api IS NULL THEN 'FIELD_ADDED' ELSE 'TYPE_CHANGED' END AS type, "
    "NULL AS rule, CASE WHEN b.api IS NOT NULL THEN b.type END AS \"old\", CASE WHEN h.api IS NOT NULL THEN h.type END AS \"new\", "
    "coalesce(b.api IS NULL AND h.required, false) AS required "
    "FROM F_base b FULL JOIN F_head h ON b.api = h.api AND b.path = h.path "
    "WHERE b.api IS NULL OR h.api IS NULL OR b.type IS DISTINCT FROM h.type UNION ALL "
    "SELECT coalesce(b.dto, h.dto), coalesce(b.path, h.path), CASE WHEN b.rule IS NULL THEN 'VALIDATION_ADDED' "
    "WHEN h.rule IS NULL THEN 'VALIDATION_REMOVED' ELSE 'VALIDATION_CHANGED' END, coalesce(b.rule, h.rule), "
    "CASE WHEN h.rule IS NOT NULL THEN b.value END, CASE WHEN b.rule IS NOT NULL THEN h.value END, false "
    f"FROM ({_MODEL_RULES.format(c='api', s='base')}) b FULL JOIN ({_MODEL_RULES.format(c='api', s='head')}) h "
    "ON b.dto = h.dto AND b.path = h.path AND b.rule = h.rule WHERE b.value IS DISTINCT FROM h.value AND "
    "(coalesce(b.dto, h.dto), coalesce(b.path, h.path)) IN (SELECT (api, path) FROM F_base INTERSECT SELECT (api, path) FROM F_head)"))
def model_field_changes(src: Source):
    dto = lambda side: fields(src, side).withColumnRenamed("api", "dto")
    return diff.model_field_changes(dto("base"), dto("head"), ["dto"])
