"""Verdicts and comparison roll-ups. The SQL side unites the single-change queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import diff_queries  # noqa: F401 - the single-change SQL must be registered first
from .bindings import oracle, snapshot
from .registry import ORACLE, Source, query
from ..operators import verdict

K = ("api",)

# change queries that run on the shared snapshot relations
_KINDS = ("endpoint_changed", "request_body_changed", "response_type_changed", "param_added", "param_type_changed",
          "param_now_required", "param_removed", "request_field_added", "request_field_type_changed", "request_field_removed",
          "validation_added", "validation_changed", "validation_removed", "response_field_removed", "response_field_type_changed",
          "response_field_added", "success_status_changed", "error_status_added", "error_status_removed", "security_changed")


def _body(key: str) -> str:
    """A registered SQL text as a subquery."""
    return f"({ORACLE[key]})"


def _changes_sql(kinds=_KINDS) -> str:
    return " UNION ALL ".join(f"SELECT api, '{k.upper()}' AS type, severity, item, detail FROM {_body('diff_' + k)}" for k in kinds)


_COUNTS = ("SELECT api, count(*) FILTER (severity = 'breaking') AS breaking, count(*) FILTER (severity = 'minor') AS minor, "
           "count(*) FILTER (severity = 'additive') AS additive, count(*) FILTER (severity = 'delta') AS delta FROM ("
           f"SELECT api, severity FROM ({_changes_sql()}) UNION ALL SELECT api, 'delta' FROM {_body('diff_downstream')}) GROUP BY api")
_VERDICT = "CASE WHEN breaking > 0 THEN 'hold' WHEN minor > 0 OR delta > 0 THEN 'review' ELSE 'clear' END AS verdict"

_SNAPSHOTS = oracle(
    f"SELECT c.api, 'changed' AS status, h.method, h.path, {_VERDICT}, breaking, minor, additive, delta "
    f"FROM ({_COUNTS}) c JOIN R_head h ON c.api = h.api "
    "UNION ALL SELECT api, 'added', method, path, 'clear', 0, 0, 1, 0 FROM R_head WHERE api NOT IN (SELECT api FROM R_base) "
    "UNION ALL SELECT api, 'removed', method, path, 'hold', 1, 0, 0, 0 FROM R_base WHERE api NOT IN (SELECT api FROM R_head)")


def _both_sides(src: Source):
    return snapshot(src, "base"), snapshot(src, "head")


@query("compare_snapshots", _SNAPSHOTS)
def compare_snapshots(src: Source):
    return verdict.compare_snapshots(*_both_sides(src), keys=K)


@query("endpoint_verdict", f"SELECT api, breaking, minor, additive, delta, {_VERDICT} FROM ({_COUNTS})")
def endpoint_verdict(src: Source):
    from ..operators import diff
    return verdict.endpoint_verdict(diff.contract_changes(*_both_sides(src), K, downstream=True, told=("severity",)), None, K)


@query("compare_changes", f"{_changes_sql()} UNION ALL {_changes_sql(('endpoint_added', 'endpoint_removed'))}")
def compare_changes(src: Source):
    return verdict.compare_changes(*_both_sides(src), keys=K)


@query("compare_summary", oracle(
    "SELECT CASE max(CASE verdict WHEN 'hold' THEN 2 WHEN 'review' THEN 1 ELSE 0 END) WHEN 2 THEN 'hold' WHEN 1 THEN 'review' ELSE 'clear' END AS verdict, "
    "(SELECT count(*) FROM R_both) AS endpoints_compared, count(*) AS endpoints_changed, CAST(sum(breaking) AS BIGINT) AS breaking, "
    f"CAST(sum(minor) AS BIGINT) AS minor, CAST(sum(additive) AS BIGINT) AS additive, true AS complete FROM ({_SNAPSHOTS})"))
def compare_summary(src: Source):
    return verdict.compare_summary(*_both_sides(src), keys=K)


@query("gate", f"SELECT api, verdict, verdict IN ('review', 'hold') AS failed FROM ({_SNAPSHOTS})")
def gate(src: Source):
    out = verdict.compare_snapshots(*_both_sides(src), keys=K, ordered=False)
    return verdict.gate(out, "review").select("api", "verdict", "failed")


@query("change_area", (
    "SELECT type, area, count(*) AS n FROM (SELECT type, CASE WHEN starts_with(type, 'ENDPOINT') THEN 'Endpoint' WHEN starts_with(type, 'REQUEST') THEN 'Request body' "
    "WHEN starts_with(type, 'RESPONSE') THEN 'Response' WHEN starts_with(type, 'PARAM') THEN 'Parameters' WHEN starts_with(type, 'VALIDATION') THEN 'Validation' WHEN starts_with(type, 'SECURITY') THEN 'Security' "
    f"ELSE 'Status codes' END AS area FROM ({_changes_sql()} UNION ALL {_changes_sql(('endpoint_added', 'endpoint_removed'))})) GROUP BY ALL"))
def change_area(src: Source):
    rows = verdict.compare_changes(*_both_sides(src), keys=K)
    return rows.select("type", verdict.change_area(F.col("type")).alias("area")).groupBy("type", "area").agg(F.count("*").alias("n"))


_ICON = "CASE verdict WHEN 'hold' THEN '🔴' WHEN 'review' THEN '🟡' ELSE '✅' END"


@query("write_result", oracle(
    f"SELECT api, {_ICON} || ' ' || method || ' ' || path || '  (' || api || ', ' || status || ')' AS line FROM ({_SNAPSHOTS}) UNION ALL "
    f"SELECT api, '    ' || rpad(severity, 9, ' ') || ' ' || replace(detail, '`', '') FROM ({_changes_sql()} UNION ALL {_changes_sql(('endpoint_added', 'endpoint_removed'))}) UNION ALL "
    f"SELECT api, '    ' || CASE change WHEN 'added' THEN 'new dep  ' ELSE 'dropped  ' END || ' ' || replace(grp, '_', ' ') || ': ' || item FROM {_body('diff_downstream')}"))
def write_result(src: Source):
    return verdict.comparison_lines(*_both_sides(src), keys=K).select("api", "line")


@query("write_result_markdown", oracle(
    f"SELECT api, '#### ' || {_ICON} || ' `' || method || ' ' || path || '`' AS line FROM ({_SNAPSHOTS}) UNION ALL "
    f"SELECT api, '- **' || severity || '**: ' || detail FROM ({_changes_sql()} UNION ALL {_changes_sql(('endpoint_added', 'endpoint_removed'))}) UNION ALL "
    f"SELECT api, '- **' || CASE change WHEN 'added' THEN 'new dependency' ELSE 'dropped dependency' END || '** (' || replace(grp, '_', ' ') || '): `' || item || '`' "
    f"FROM {_body('diff_downstream')}"))
def write_result_markdown(src: Source):
    return verdict.comparison_lines(*_both_sides(src), keys=K, fmt="markdown").select("api", "line")


_COUNTS_SQL = ("SELECT o_custkey, count(*) AS changes, count(*) FILTER (o_orderstatus = 'F') AS breaking, count(*) FILTER (o_orderstatus = 'O') AS minor, "
               "count(*) FILTER (o_orderpriority = '1-URGENT') AS callers, count(*) FILTER (o_orderpriority = '2-HIGH') AS sharers, "
               "count(*) FILTER (o_totalprice > 450000) AS added, count(*) FILTER (o_totalprice < 20000) AS removed FROM orders GROUP BY o_custkey")


def _counts(src: Source):
    return src.sql(_COUNTS_SQL.replace("FILTER (", "FILTER (WHERE "))


@query("impact_level", (
    "SELECT o_custkey, CASE WHEN breaking > 0 AND (callers > 0 OR sharers > 0) THEN 'high' WHEN breaking > 0 THEN 'medium' WHEN changes > 0 OR added > 0 THEN 'low' ELSE 'none' END AS level "
    f"FROM ({_COUNTS_SQL})"))
def impact_level(src: Source):
    level = verdict.impact_level(F.col("breaking"), F.col("changes"), F.col("callers"), F.col("sharers"), F.col("added"))
    return _counts(src).select("o_custkey", level.alias("level"))


_PL = "CASE WHEN {0} = 1 THEN '' ELSE 's' END"


@query("impact_facts", (
    "SELECT o_custkey, verdict, CASE verdict WHEN 'hold' THEN 'Hold before merging' WHEN 'review' THEN 'Review before merging' ELSE 'Clear to merge' END AS title, "
    "CASE verdict WHEN 'hold' THEN 'Breaking changes: existing clients fail until they are updated.' || CASE WHEN callers + sharers = 0 THEN ' No callers were found in the scanned code; external clients may still exist.' ELSE '' END "
    "WHEN 'review' THEN 'Changes clients may notice, such as new error codes or new downstream systems.' ELSE 'No change existing clients could notice.' END AS explanation, "
    f"concat_ws(' | ', breaking || ' breaking change' || {_PL.format('breaking')} || CASE WHEN breaking <> changes THEN ' of ' || changes ELSE '' END, "
    f"CASE WHEN callers > 0 THEN callers || ' caller' || {_PL.format('callers')} || ' in the scanned code' END, "
    f"CASE WHEN sharers > 0 THEN sharers || ' endpoint' || {_PL.format('sharers')} || ' sharing data' END, "
    "CASE WHEN added + removed > 0 THEN concat_ws(', ', CASE WHEN added > 0 THEN added || ' new' END, CASE WHEN removed > 0 THEN removed || ' removed' END) || ' dependenc' || "
    "CASE WHEN added + removed = 1 THEN 'y' ELSE 'ies' END END) AS facts FROM (SELECT *, CASE WHEN breaking > 0 THEN 'hold' WHEN minor > 0 OR added + removed > 0 THEN 'review' ELSE 'clear' END AS verdict "
    f"FROM ({_COUNTS_SQL}))"))
def impact_facts(src: Source):
    return verdict.impact_facts(_counts(src)).select("o_custkey", "verdict", "title", "explanation", F.array_join("facts", " | ").alias("facts"))
