"""Contract diff, verdict and signatures on the golden pairs of routes."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from contractlake.operators import diff, normalize, verdict
from contractlake.sources import reports
from tests.conftest import rows

PARAMS_OLD = {"method": "GET", "path": "/items", "handler": "Items.list", "params": [
    {"name": "q", "in": "query", "type": "String", "required": False}, {"name": "id", "in": "path", "type": "Long", "required": True},
], "status_codes": [{"code": 200}], "security": {"annotations": []}}
PARAMS_NEW = {"method": "GET", "path": "/items", "handler": "Items.list", "params": [
    {"name": "q", "in": "query", "type": "String", "required": True}, {"name": "tenant", "in": "header", "type": "String", "required": True},
], "status_codes": [{"code": 200}, {"code": 404}], "security": {"annotations": [{"annotation": "PreAuthorize", "expression": "hasRole('ADMIN')"}]}}


def create_route(minimum, extra, status, tracking, version):
    lines = {"quantity": {"type": "Integer", "validation": {"minimum": minimum}}, **extra}
    return {
        "method": "POST", "path": "/orders", "handler": "OrderController.create",
        "request_body": {"type": "OrderRequest", "schema": {"lines": {"type": "List<Line>", "schema": {"type": "array", "items": {"type": "object", "fields": lines}}}}},
        "response": {"type": "OrderDto", "body_type": "OrderDto", "schema": {"id": {"type": "Long"}, "status": {"type": status}, **tracking}},
        "status_codes": [{"code": 201, "source": "x"}],
        "integrations": {"external_apis": [{"http_method": "POST", "url": f"https://api.payments.example.com/{version}/charges/{{id}}", "host": "api.payments.example.com"}],
                         "databases": [{"operation": "WRITE", "table": ["orders"], "technology": "jpa"}]},
    }


ORDER_V1 = create_route(1, {}, "String", {}, "v1")
ORDER_V2 = create_route(5, {"warehouse": {"type": "String", "validation": {"required": True}}}, "OrderStatus", {"trackingUrl": {"type": "String"}}, "v2")


SNAPSHOTS: dict[str, dict] = {}


def snapshot(spark, *routes, repo="shop"):
    """Tables of a report, computed once and kept as rows."""
    report = json.dumps({"repository": repo, "commit": "c", "routes": list(routes)})
    if report not in SNAPSHOTS:
        parsed = reports.parse_reports(spark.createDataFrame([(repo, report)], "repo string, report string"))
        tables = reports.snapshot_tables(reports.last_routes(reports.routes_of(parsed, ["repo"]), ["repo"]), ["repo"])
        SNAPSHOTS[report] = {name: spark.createDataFrame(df.collect(), df.schema) for name, df in tables.items()}
    return SNAPSHOTS[report]


def changes(spark, old, new):
    return rows(verdict.compare_changes(snapshot(spark, *old), snapshot(spark, *new), pos="pos"), "type", "severity", "detail")


def test_params_and_security(spark):
    found = {(t, s) for t, s, _ in changes(spark, [PARAMS_OLD], [PARAMS_NEW])}
    assert found == {("PARAM_NOW_REQUIRED", "breaking"), ("PARAM_ADDED", "breaking"), ("PARAM_REMOVED", "breaking"),
                     ("ERROR_STATUS_ADDED", "minor"), ("SECURITY_CHANGED", "breaking")}


def test_nested_fields_and_downstream(spark):
    assert changes(spark, [ORDER_V1], [ORDER_V2]) == sorted([
        ("VALIDATION_CHANGED", "breaking", "`lines.quantity` minimum: 1 → 5"),
        ("REQUEST_FIELD_ADDED", "breaking", "`lines.warehouse` (String) is required"),
        ("RESPONSE_FIELD_TYPE_CHANGED", "breaking", "`status`: String → OrderStatus"),
        ("RESPONSE_FIELD_ADDED", "additive", "`trackingUrl` (String)"),
    ], key=repr)
    b, h = snapshot(spark, ORDER_V1), snapshot(spark, ORDER_V2)
    assert rows(diff.downstream_delta(b["downstream"], h["downstream"]), "grp", "item", "change") == [
        ("external_apis", "POST https://api.payments.example.com/v1/charges/{id} → api.payments.example.com", "removed"),
        ("external_apis", "POST https://api.payments.example.com/v2/charges/{id} → api.payments.example.com", "added")]


@pytest.mark.parametrize("route", [PARAMS_OLD, ORDER_V2])
def test_diff_with_itself_is_empty(spark, route):
    swapped = {**route, "params": list(reversed(route.get("params", []))), "status_codes": list(reversed(route["status_codes"]))}
    assert changes(spark, [route], [swapped]) == []
    summary = verdict.compare_summary(snapshot(spark, route), snapshot(spark, swapped)).first()
    assert (summary.verdict, summary.endpoints_compared, summary.endpoints_changed) == ("clear", 1, 0)


def test_added_removed_and_incremental(spark):
    base, head = snapshot(spark, PARAMS_OLD, ORDER_V1), snapshot(spark, PARAMS_OLD, {**ORDER_V1, "handler": "OrderController.other"})
    full = rows(verdict.compare_snapshots(base, head), "api", "status", "verdict")
    assert full == [("OrderController.create", "removed", "hold"), ("OrderController.other", "added", "clear")]
    assert rows(verdict.compare_snapshots(base, head, complete=False), "api", "status") == [("OrderController.other", "added")]
    assert verdict.compare_summary(base, head, complete=False).first().verdict == "clear"


def test_downstream_alone_means_review(spark):
    head = {**ORDER_V1, "integrations": ORDER_V2["integrations"]}
    one = verdict.compare_snapshots(snapshot(spark, ORDER_V1), snapshot(spark, head)).first()
    assert (one.verdict, one.breaking, one.delta) == ("review", 0, 2)
    gated = {t: verdict.gate(verdict.compare_snapshots(snapshot(spark, ORDER_V1), snapshot(spark, head)), t).first().failed for t in ("hold", "review", "never")}
    assert gated == {"hold": False, "review": True, "never": False}


def test_severities_sum_to_changes(spark):
    base, head = snapshot(spark, PARAMS_OLD, ORDER_V1), snapshot(spark, PARAMS_NEW, ORDER_V2)
    s = verdict.compare_summary(base, head, pos="pos").first()
    assert s.breaking + s.minor + s.additive == verdict.compare_changes(base, head, pos="pos").count()
    assert (s.verdict, s.endpoints_changed) == ("hold", 2)


def test_last_duplicate_route_and_param_win(spark):
    twice = {**PARAMS_OLD, "params": [{"name": "q", "in": "query", "type": "Integer"}, *PARAMS_OLD["params"]]}
    assert changes(spark, [PARAMS_NEW, twice], [PARAMS_OLD]) == []


def test_params_without_location_stay_apart(spark):
    schema = "repo string, api string, pos int, loc string, name string, type string, required boolean"
    base = spark.createDataFrame([("r", "a", 0, None, "x", "int", True)], schema)
    head = spark.createDataFrame([("r", "a", 0, "query", "x", "int", True), ("r", "a", 1, "body", "y", "int", True)], schema)
    assert rows(diff.param_changes(base, head), "type", "item") == [("PARAM_ADDED", "query:x"), ("PARAM_REMOVED", ":x")]
    assert rows(diff.param_changes(base, base)) == []


def test_signature_follows_the_contract_only(spark):
    def sign(**change):
        text = json.dumps({"routes": [{**ORDER_V1, "params": PARAMS_OLD["params"], "errors": [404, "NOT_FOUND"], **change}]})
        frame = reports.routes_of(reports.parse_reports(spark.createDataFrame([("r", text)], "repo string, report string")), ["repo"])
        return frame.select(normalize.contract_signature(frame)).first()[0]

    base = sign()
    assert sign(params=list(reversed(PARAMS_OLD["params"])), errors=["NOT_FOUND", 404]) == base
    assert sign(status_codes=[{"code": 201, "source": "elsewhere"}]) == base
    assert sign(integrations=ORDER_V2["integrations"], security={"annotations": []}) == base
    assert len({base, sign(errors=[404]), sign(params=[]), sign(status_codes=[]), sign(response=ORDER_V2["response"]), sign(path="/x")}) == 6


def test_bad_reports_are_error_rows(spark, tmp_path):
    for name, text in (("a.json", json.dumps({"routes": [ORDER_V1]}, indent=2)), ("b.json", "[1, 2]"), ("c.json", "oops"), ("d.json", '{"commit": "x"}')):
        (tmp_path / name).write_text(text)
    found = {r.file.rsplit("/", 1)[-1]: r.is_report for r in reports.read_reports(spark, str(tmp_path)).collect()}
    assert found == {"a.json": True, "b.json": False, "c.json": False, "d.json": False}


def test_rendered_lines(spark, tmp_path):
    base, head = snapshot(spark, ORDER_V1), snapshot(spark, ORDER_V2)
    verdict.write_result(verdict.comparison_lines(base, head, ["repo", "api"]), str(tmp_path / "out"), ["repo", "api"])
    text = "\n".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    lines = text.splitlines()
    assert lines[0] == "🔴 POST /orders  (OrderController.create, changed)"
    assert "    breaking  lines.quantity minimum: 1 → 5" in lines and lines[-1].startswith("    dropped   external apis: POST https")
    first = verdict.summary_line(verdict.compare_summary(base, head)).first()[0]
    assert first.startswith("🔴 Hold: Breaking changes") and "1 endpoint(s) changed · 3 breaking" in first


def test_required_defaults_and_levels(spark):
    counts = spark.createDataFrame([(1, 0, 0, 2, 0, 0, 0), (0, 0, 0, 0, 0, 0, 0), (0, 0, 1, 0, 0, 0, 0)], "breaking int, minor int, changes int, callers int, sharers int, added int, removed int")
    level = verdict.impact_level(F.col("breaking"), F.col("changes"), F.col("callers"), F.col("sharers"), F.col("added"))
    assert [r[0] for r in counts.select(level).collect()] == ["high", "none", "low"]
