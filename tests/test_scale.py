"""What keeps large inputs within bounds: plans without oversized broadcasts or tasks, whole results where keys are hot."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from contractlake.functions import rules
from contractlake.operators import config, diff, facts, impact, linediff, normalize, ordered, relations, snapshots, text, types, verdict
from contractlake.plans import bindings
from contractlake.plans.catalog import ORACLE, QUERIES
from contractlake.plans.registry import Source
from contractlake.sources import files
from tests.conftest import DATA, rows


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_module_of_file_sends_no_paths_through_the_driver(spark):
    files = spark.createDataFrame([("a/b/C.java",), ("a/D.java",), ("E.java",), ("a/b/C.java",)], "path string")
    modules = spark.createDataFrame([("a",), ("a/b",), ("",)], "dir string")
    found = facts.module_of_file(files, modules)
    assert rows(found) == [("E.java", ""), ("a/D.java", "a"), ("a/b/C.java", "a/b"), ("a/b/C.java", "a/b")]
    assert "BroadcastExchange" not in plan(found)


def test_classify_library_is_compiled_and_takes_the_first_entry(spark):
    names = [("org.Spring", "spring-boot-starter-data-jpa"), ("g", "My.KAFKA-clients"), ("g", "xkafka"), (None, None), ("com.h2database", "h2_x"), ("g", "jooqish")]

    def first(group, artifact):
        key, tokens = f"{group or ''}:{artifact or ''}".lower(), re.split("[-.:_]", (artifact or "").lower())
        return next((n for n, _, _ in rules.LIBRARY_CATALOG if (n in key if re.search("[-:.]", n) else any(t.startswith(n) for t in tokens))), None)

    df = spark.createDataFrame(names, "g string, a string")
    found = df.select("g", "a", facts.classify_library(F.col("g"), F.col("a"))["needle"].alias("n"))
    assert rows(found) == sorted(((g, a, first(g, a)) for g, a in names), key=repr)
    # a function called for every entry of the catalogue is interpreted, row by row
    assert "lambda" not in plan(found)


def test_keyword_search_scores_equal_texts_once_and_returns_all_rows(spark):
    # every text and query 300 times: the pairs that are scored must not grow with the copies
    apis = spark.range(300).selectExpr("id", "explode(array('red ring', 'blue bolt')) AS api").selectExpr("id", "api", "'x' AS title", "'shop' AS repo")
    queries = spark.range(300).selectExpr("id AS query_id", "'Red  RING' AS query")
    found = text.keyword_search(apis, queries)
    assert found.count() == 300 * 300 and rows(found.select("api", "score").distinct()) == [("red ring", 0.8 * 0.9)]
    # pairs meet the rows behind a text by its number, not by the text of every API
    assert re.search(r"Join \[_class", plan(found))


def test_related_documents_by_classes_equal_all_pairs(spark):
    import random
    rng = random.Random(5)
    docs = [(i, t) for i in range(60) for t in {f"/t{rng.randrange(9)}" for _ in range(4)} | {f"/r{rng.randrange(40)}"}] + [(60, "/alone"), (61, "/t1"), (61, "/t1")]
    have = {}
    for i, t in docs:
        have.setdefault(i, set()).add(t)
    want = sorted((a, b, sorted(have[a] & have[b])[:3]) for a in have if a % 10 == 0 for b in have if a != b and have[a] & have[b])
    tokens = spark.createDataFrame(docs, "doc long, token string")
    for hub in (0, 5, 1000):
        found = text.related_documents(tokens, spark.range(0, 70, 10).toDF("doc"), "doc", hub=hub or 1)
        assert sorted(tuple(r) for r in found.select("target", "neighbour", "token").collect()) == want


def test_related_documents_are_asked_for_every_page(spark):
    src = Source(spark, DATA)
    have = {}
    for page, token in text.extract_endpoints(src.table("pages"), ["page_id"], "html").collect():
        have.setdefault(page, set()).add(token)
    want = sorted((a, b, ",".join(sorted(have[a] & have[b])[:3])) for a in have for b in have if a != b and have[a] & have[b])
    assert rows(QUERIES["related_documents"](spark, DATA), "target", "neighbour", "token") == sorted(want, key=repr)
    assert {a for a, *_ in want} == set(have) and "%" not in ORACLE["related_documents"]


def dealt_out_first(df):
    """Whether the rows are shuffled before the first aggregate sorts them, not after it."""
    text = plan(df)
    return text.index("partial_min_by") < text.index("Exchange")


CONFIG = "module string, profile string, key string, value string"


def test_config_rows_are_dealt_out_before_they_are_sorted(spark):
    data = [("m", "default", "shop.url", "http://a"), ("m", "dev", "shop.url", "ftp://b"), ("m", "dev", "x.url", "https://u:p@h"), ("m", "default", "eureka.u", "http://e"),
            ("n", "default", "spring.redis.host", "r"), ("n", "default", "z", None)]
    rows_ = spark.createDataFrame(data, CONFIG)
    urls, infra = config.external_urls(rows_), config.derive_infrastructure(rows_)
    assert rows(urls) == [("m", "shop.url", "http://a"), ("m", "x.url", "https://u:****@h")]
    assert rows(infra, "module", "redis_host") == [("n", "r")]
    assert dealt_out_first(urls) and dealt_out_first(infra)


def test_flatten_schema_is_dealt_out_and_reads_escaped_names(spark):
    plain = '{"a":{"type":"T","schema":{"type":"object","fields":{"b":{"type":"U"}}}},"c":{"type":"V"}}'
    df = spark.createDataFrame([(1, plain), (2, plain.replace("schema", "sch\\u0065ma"))], "id long, fields string")
    found = normalize.flatten_schema(df, ["id"])
    assert rows(found, "id", "path", "type") == [(i, p, t) for i in (1, 2) for p, t in (("a", "T"), ("a.b", "U"), ("c", "V"))]
    assert "REPARTITION" in plan(found)


def test_effective_fields_are_dealt_out_by_type(spark):
    fields = spark.createDataFrame([(1, "f", "A"), (2, "f", "B"), (1, "g", "C")], "owner long, name string, field_type string")
    supers = spark.createDataFrame([(3, 2, 1), (3, 1, 2), (2, 1, 1)], "type long, ancestor long, depth int")
    found = types.effective_fields(fields, supers)
    assert rows(found) == [(1, "f", "A"), (1, "g", "C"), (2, "f", "B"), (2, "g", "C"), (3, "f", "B"), (3, "g", "C")]
    assert dealt_out_first(found)


def test_changed_files_send_no_repositories_to_every_task(spark):
    files_ = spark.createDataFrame([(1, "a.java"), (2, "b.java"), (2, "c.md")], "repo long, file string")
    found = files.changed_files(files_.where("repo = 1"), files_.where("false"), files_, spark.createDataFrame([(1,)], "repo long"), [".java"])
    assert rows(found) == [(1, "a.java"), (2, "b.java")]
    assert "BroadcastExchange" not in plan(found)


def test_dispatch_judges_overrides_where_they_lie_and_shuffles_no_pairs(spark):
    import itertools
    import random
    rng = random.Random(3)
    parent = {t: t // 2 for t in range(1, 24)}
    line = lambda t: [t] if t not in parent else [t, *line(parent[t])]
    supers = [(t, a, d) for t in range(24) for d, a in enumerate(line(t)) if d]
    made = [(t, n, k, rng.choice([True, False, None]), rng.random() < 0.7) for t, n in itertools.product(range(24), "ab") for k in rng.sample([0, 1, 2, None], rng.randrange(3))]
    methods = [(f"{t}.{n}{i}", t, n, k, v, a, i) for i, (t, n, k, v, a) in enumerate(made)]
    calls = [(f"{t}{n}{k}", t, n, k) for t, n, k in itertools.product(range(12), "abc", (0, 1, 2, None))]

    def fits(m, argc):
        n, var = m[3], m[4] is not False
        return argc is None or n is None or n == argc or (var and argc >= n - 1)

    def chosen(owner, name, argc):
        own = [m for m in methods if m[1] == owner and m[2] == name]
        return [m for m in own if fits(m, argc)] or own

    want = []
    for call, t, n, k in calls:
        near = next((c for o in line(t) if (c := chosen(o, n, k))), [])
        want += [(call, m[0], True) for m in near]
        if all(m[5] for m in near):
            want += [(call, m[0], False) for s, a, _ in supers if a == t for m in chosen(s, n, k) if not m[5]]
    c = spark.createDataFrame(calls, "call string, type long, name string, argc int")
    m = spark.createDataFrame(methods, "method string, owner long, name string, n_params int, varargs boolean, abstract boolean, pos int")
    s = spark.createDataFrame(supers, "type long, ancestor long, depth int")
    found = types.virtual_dispatch(c, m, s)
    assert found.columns == ["call", "method", "pos", "inherited"] and rows(found, "call", "method", "inherited") == sorted(want, key=repr)
    # a window over signatures and overrides would sort every pair of them
    assert "Window" not in plan(found)


def test_impact_graph_nodes_are_dealt_out_before_they_are_sorted(spark):
    ends = spark.createDataFrame([(1, "GET /a", True), (2, "GET /b", False)], "center long, label string, has_route boolean")
    callers = spark.createDataFrame([(1, "x", "service_call", "d"), (1, "x", "gateway_route", "d"), (2, None, "service_call", "d")], "center long, caller string, kind string, detail string")
    use = spark.createDataFrame([(1, "table", "t", "READ", "r"), (1, "api", "o (H.m)", "READ", "r"), (2, "table", "t", "READ", "r")], "center long, kind string, name string, operation string, detail string")
    shared = spark.createDataFrame([(1, "table", "t", ["o (H.m)", "p (q) (r)"]), (1, "table", "u", ["p (q) (r)"]), (2, "table", "t", [])], "center long, kind string, name string, also_used_by array<string>")
    nodes = relations.impact_graph(ends, callers, use, shared)[0]
    # a resource is told before a sharer of the same id
    assert rows(nodes, "center", "id", "label", "type") == sorted([
        (1, "endpoint:GET /a", "GET /a", "endpoint"), (2, "endpoint:GET /b", "GET /b", "endpoint"), (1, "caller:x", "x", "gateway_route"), (2, None, None, "service_call"),
        (1, "table:t", "t", "table"), (1, "table:u", "u", "table"), (1, "api:o (H.m)", "o (H.m)", "api"), (1, "api:p (q) (r)", "p", "related_endpoint")], key=repr)
    found = plan(nodes)
    assert "REPARTITION" in found and found.index("min(struct") < found.index("REPARTITION") and "min_by" not in found


def test_impact_graph_nodes_deal_out_sharers_as_lists(spark):
    import random
    rng = random.Random(4)
    kinds = ["table", "caller", "api", "endpoint", "caller:x"]
    ends = [(e, f"GET /{e}", e % 3 > 0) for e in range(6)] + [(None, "n", True)]
    callers = [(e, rng.choice(["a", "b", "x:c", None]), rng.choice(["service_call", "gateway_route"]), "d") for e in range(6) for _ in range(4)]
    use = [(e, rng.choice(kinds), rng.choice("abc"), "READ", rng.choice(["r", "s"])) for e in range(6) for _ in range(8)]
    declared = [(e, rng.choice(kinds), rng.choice(["a", "b", "GET /3"])) for e in range(6) for _ in range(5)]
    shared = [(e, rng.choice(kinds), rng.choice("abc"), rng.sample(["a", "b (H.m)", "c", "d"], rng.randrange(4))) for e in range(6) for _ in range(6)] + [(1, "table", "t", None)]
    routed = {e for e, _, r in ends if r and e is not None}
    told = [(e, f"endpoint:{n}", 0, n, "endpoint") for e, n, _ in ends] + [(e, None if n is None else f"caller:{n}", 1, n, k) for e, n, k, _ in callers]
    told += [(e, f"{k}:{n}", 2, n, k) for e, k, n in [u[:3] for u in use if u[0] in routed] + [d for d in declared if d[0] not in routed]]
    told += [(e, f"{k}:{n}", 3, n, k) for e, k, n, o in shared if o] + [(e, f"api:{x}", 4, x.split(" (")[0], "related_endpoint") for e, _, _, o in shared for x in o or []]
    best = {}
    for e, i, *rest in told:
        best[e, i] = min(best.get((e, i), rest), rest, key=lambda r: (r[0], r[1] or "", r[2]))
    made = spark.createDataFrame
    nodes = relations.impact_graph(
        made(ends, "center long, label string, has_route boolean"), made(callers, "center long, caller string, kind string, detail string"),
        made(use, "center long, kind string, name string, operation string, detail string"), made(shared, "center long, kind string, name string, also_used_by array<string>"),
        declared=made(declared, "center long, kind string, name string"))[0]
    assert rows(nodes, "center", "id", "label", "type") == sorted(((e, i, label, kind) for (e, i), (_, label, kind) in best.items()), key=repr)
    # sharers' nodes are made behind the shuffle; only callers are spread, by their id
    found = plan(nodes)
    assert found.index("Generate") < found.index("REPARTITION") and "_others" in found and "_part" in found


def test_endpoints_meet_what_they_use_where_it_is_made_distinct(spark):
    from contractlake.plans import relation_queries
    seen = {}
    kept, relations.impact_graph = relations.impact_graph, lambda ends, callers, usage, near, declared: seen.update(GCALL=callers, GUSE=usage, GDECL=declared)
    try:
        relation_queries._graph(Source(spark, DATA))
    finally:
        relations.impact_graph = kept
    for name, df in seen.items():
        assert rows(df) == rows(bindings.relation(Source(spark, DATA), name)), name
    # as on large tables, whatever their size here
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = {name: plan(seen[name].join(spark.range(9).selectExpr("'part-' || id AS center"), "center", "left_semi")) for name in ("GUSE", "GDECL")}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    # one shuffle of the rows, one of the endpoints
    assert {name: text_.count("Exchange hashpartitioning") for name, text_ in found.items()} == {"GUSE": 2, "GDECL": 2}


def test_line_edits_show_texts_without_dealing_out_their_lines(spark):
    pairs = spark.createDataFrame([(1, "a\nb\nc", "a\nx\ny\nc"), (2, None, "n"), (3, "o\n", None), (4, None, None)], "id long, old string, new string")
    found = linediff.line_edits(pairs, ["id"])
    assert rows(found, "id", "idx", "status", "left_line", "left_text", "right_line", "right_text") == sorted([
        (1, 1, "same", 1, "a", 1, "a"), (1, 2, "change", 2, "b", 2, "x"), (1, 3, "add", None, None, 3, "y"), (1, 4, "same", 3, "c", 4, "c"),
        (2, 1, "add", None, None, 1, "n"), (3, 1, "remove", 1, "o", None, None), (3, 2, "remove", 2, "", None, None)], key=repr)
    assert "posexplode" not in plan(found)


def test_previous_values_move_only_the_first_rows_of_chunks_again(spark):
    data = [(k, p, f"{k}{p}") for k in "ab" for p in (1, 2, 4, 5, 9)] + [(None, 3, "n3"), (None, 4, None)]
    found = ordered.previous_values(spark.createDataFrame(data, "k string, p long, v string"), ["k"], "p", ["p", "v"], 3).select("k", "p", "v", "previous.*")
    want = [(k, p, v, *next(((q, w) for j, q, w in sorted(data, key=lambda r: -r[1]) if j == k and q < p), (None, None))) for k, p, v in data]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)
    # the rows that have their previous one in the chunk are united with those that were joined
    assert "Union" in plan(found)


def test_items_are_dealt_out_once_to_cancel_and_pair(spark):
    base = spark.createDataFrame([(1, "a", "x"), (1, "b", "x"), (None, "a", "x"), (2, "a", None)], "k long, n string, v string")
    head = spark.createDataFrame([(1, "a", "y"), (1, "b", "x"), (None, "a", "x"), (2, "b", None)], "k long, n string, v string")
    found = snapshots.pair_items(base, head, ["k", "n"], ["v"])
    assert rows(found, "k", "n", "in_base", "in_head", "base.v", "head.v") == sorted([
        (1, "a", True, True, "x", "y"), (2, "a", True, False, None, None), (2, "b", False, True, None, None)], key=repr)
    assert len(re.findall(r"Exchange hash", plan(found))) == 1


def test_counting_changes_makes_no_texts(spark):
    side = lambda v: {"routes": spark.createDataFrame([("a", "GET", "/a", None, None)], "api string, method string, path string, body_type string, response_type string"),
                      "request_fields": spark.createDataFrame([("a", "f", v, True, {"min": v})], "api string, path string, type string, required boolean, rules map<string,string>"),
                      "downstream": spark.createDataFrame([("a", "databases", v)], "api string, grp string, item string")}
    slim = diff.contract_changes(side("1"), side("2"), ["api"], downstream=True, told=("severity",))
    assert rows(slim) == [("a", "breaking"), ("a", "breaking"), ("a", "delta"), ("a", "delta")]
    assert "now validated" in plan(diff.contract_changes(side("1"), side("2"), ["api"])) and "now validated" not in plan(slim)
    assert "now validated" not in plan(verdict.compare_snapshots(side("1"), side("2"), ["api"]))


def test_comparison_lines_work_out_changes_once(spark):
    side = lambda v: {"routes": spark.createDataFrame([("a", "GET", "/a", None, None), (f"only{v}", "GET", "/b", None, None)], "api string, method string, path string, body_type string, response_type string"),
                      "params": spark.createDataFrame([("a", "query", "p", v, False), ("only1", "query", "p", v, False)], "api string, loc string, name string, type string, required boolean"),
                      "downstream": spark.createDataFrame([("a", "databases", v)], "api string, grp string, item string")}
    found = verdict.comparison_lines(side("1"), side("2"), ["api"])
    assert rows(found, "api", "section", "line") == sorted([
        ("a", 0, "🔴 GET /a  (a, changed)"), ("a", 1, "    breaking  query parameter p: 1 → 2"), ("a", 2, "    new dep   databases: 2"), ("a", 2, "    dropped   databases: 1"),
        ("only1", 0, "🔴 GET /b  (only1, removed)"), ("only1", 1, "    breaking  GET /b"), ("only2", 0, "✅ GET /b  (only2, added)"), ("only2", 1, "    additive  GET /b")], key=repr)
    # headers, changes and deltas read the written table; nothing compares parameters again
    assert "FileScan parquet" in plan(found) and "parameter `" not in plan(found)


def test_endpoint_facts_reduce_the_facts_of_a_class_once(spark):
    import random
    rng = random.Random(8)
    closed = [(o, n, rng.randrange(3)) for o in "abcd" for n in range(40) if rng.random() < 0.3 or n < 20] + [(None, 3, 0), ("a", None, 0)]
    seen = [(rng.randrange(45), rng.choice(["database", "cache", "x"]), i) for i in list(range(6)) * 60]
    grp = {"database": "databases", "cache": "caches", "x": "other"}
    c, f = spark.createDataFrame(closed, "origin string, node long, depth int"), spark.createDataFrame(seen, "method long, kind string, item int")
    met = [(o, grp[k], i, d) for o, n, d in closed for m, k, i in seen if m == n]
    assert rows(facts.endpoint_facts(c.drop("depth"), f, ["item"])) == sorted({r[:3] for r in met}, key=repr)
    nearest = {r[:3]: min(d for *q, d in met if tuple(q) == r[:3]) for r in met}
    found = facts.endpoint_facts(c, f, ["item"])
    assert rows(found) == sorted(((*k, d) for k, d in nearest.items()), key=repr)
    # endpoints meet the facts of classes, not those of every method
    assert re.search(r"Join \[_class", plan(found))


def test_items_that_are_names_are_not_paired_and_only_downstream_is_named(spark):
    side = lambda codes, items: {"routes": spark.createDataFrame([("a", "GET", "/a", None, None)], "api string, method string, path string, body_type string, response_type string"),
                                 "statuses": spark.createDataFrame([("a", c) for c in codes], "api string, code int"),
                                 "downstream": spark.createDataFrame([("a", *i) for i in items], "api string, grp string, item string")}
    base, head = side([400, 404, 404], [("caches", "x"), (None, "y"), ("caches", None)]), side([404, 500], [("caches", "x"), ("caches", "z"), ("caches", None), ("caches", "z")])
    whole = diff.contract_changes(base, head, ["api"], downstream=True)
    assert rows(whole) == sorted([
        ("a", "ERROR_STATUS_REMOVED", "additive", "400", "no longer returns 400"), ("a", "ERROR_STATUS_ADDED", "minor", "500", "may now return 500"),
        ("a", "DOWNSTREAM_REMOVED", "delta", None, "y"), ("a", "DOWNSTREAM_ADDED", "delta", "caches", "z")], key=repr)
    slim = diff.contract_changes(base, head, ["api"], downstream=True, told=diff.TOLD_DELTA)
    assert rows(slim, "type", "grp", "name") == sorted([
        ("ERROR_STATUS_REMOVED", None, None), ("ERROR_STATUS_ADDED", None, None), ("DOWNSTREAM_REMOVED", None, "y"), ("DOWNSTREAM_ADDED", "caches", "z")], key=repr)
    assert rows(diff.delta_of(slim, ["api"])) == rows(diff.delta_of(whole, ["api"])) == [("a", "caches", "z", "added"), ("a", None, "y", "removed")]
    # no text of a code is made, and the changes are not sorted to meet the endpoints of both sides
    assert "may now return" not in plan(slim) and "ShuffledHashJoin" in plan(slim) and "SortMergeJoin" not in plan(slim)


def test_model_changes_drop_references_to_other_types_before_they_are_made_distinct(spark):
    refs = spark.createDataFrame([("e1", "t1"), ("e1", "t1"), ("e1", "t2"), ("e2", "t1"), ("e3", "t1"), (None, "t1"), ("e1", None)], "endpoint string, type string").distinct()
    changes = spark.createDataFrame([("t1", "f", "TYPE_CHANGED"), ("t1", "f", "TYPE_CHANGED"), ("t1", "g", "FIELD_REMOVED"), ("t9", "f", "TYPE_CHANGED"), (None, "f", "TYPE_CHANGED")], "dto string, field string, type string")
    hit = spark.createDataFrame([("e1", "r"), ("e1", "s"), ("e2", "r"), (None, "r")], "endpoint string, reason string")
    found = impact.endpoint_model_changes(hit, refs, changes)
    assert found.columns == ["dto", "endpoint", "field", "change"]
    assert rows(found, "endpoint", "dto", "field", "change") == [(e, "t1", *c) for e in ("e1", "e2") for c in (("f", "TYPE_CHANGED"), ("g", "FIELD_REMOVED"))]
    # the types that changed are met under the aggregate that makes the references distinct
    assert re.search(r"keys=\[endpoint#\d+, type#\d+\][^\n]*\n[ :|+-]*BroadcastHashJoin \[type#\d+\], \[dto#\d+\], LeftSemi", plan(found))


def test_snapshots_read_lines_once_for_both_sides(spark):
    src = Source(spark, DATA)
    for side in ("base", "head"):
        found = bindings.snapshot(src, side)
        want = {"params": bindings.relation(src, f"P_{side}"), "request_fields": bindings.fields(src, side), "response_fields": bindings.relation(src, f"O_{side}"),
                "statuses": bindings.relation(src, f"S_{side}"), "downstream": bindings.relation(src, f"D_{side}")}
        for name, df in want.items():
            assert found[name].schema.simpleString() == df.schema.simpleString() and rows(found[name]) == rows(df), name
            assert ("lineitem.parquet" in plan(found[name])) == (name == "downstream"), name
    # one written table for lines, taxes and codes each
    assert len(src._written) == 3
