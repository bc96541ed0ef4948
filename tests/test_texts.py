"""Text, configuration and naming helpers on literal inputs."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from contractlake.operators import config, documents, facts, qa, text
from contractlake.sources import builds, files
from tests.conftest import rows


def value(spark, column, **inputs):
    frame = spark.createDataFrame([tuple(inputs.values())], ", ".join(f"{k} string" for k in inputs)) if inputs else spark.range(1)
    return frame.select(column.alias("v")).first().v


@pytest.mark.parametrize("sql, operation, tables", [
    ("SELECT o.id FROM orders o JOIN order_line l ON l.order_id = o.id", "READ", ["orders", "order_line"]),
    ("insert into audit_log (a) values (?)", "WRITE", ["audit_log"]),
    ("DELETE FROM sessions WHERE expired = true", "DELETE", ["sessions"]),
    ("select o from Owner o join o.pets p", "READ", ["Owner"]),
    ("FROM PetType ptype WHERE ptype.id = :id", "READ", ["PetType"]),
    ("  ", None, []),
])
def test_sql_tables(spark, sql, operation, tables):
    assert value(spark, facts.sql_operation(F.col("s")), s=sql) == operation
    assert value(spark, facts.sql_tables(F.col("s")), s=sql) == tables


@pytest.mark.parametrize("group, artifact, expected", [
    ("org.springframework.security.oauth", "spring-security-oauth2", ("security", "OAuth2")),
    ("com.h2database", "h2", ("database", "H2")), ("org.springframework.kafka", "spring-kafka", ("messaging", "Kafka")), ("x", "oauth2", None)])
def test_libraries(spark, group, artifact, expected):
    hit = value(spark, facts.classify_library(F.col("g"), F.col("a")), g=group, a=artifact)
    assert (hit and (hit.category, hit.technology)) == expected


@pytest.mark.parametrize("name", ["..", "", "a/b", "../../evil", "x" * 201, "a\\b"])
def test_unsafe_names(spark, name):
    assert value(spark, files.safe_name(F.col("n")), n=name) is False
    assert value(spark, files.safe_name(F.col("n")), n="shop") is True


def test_titles(spark):
    title = lambda **kw: value(spark, documents.fallback_title(*[F.col(c) for c in ("s", "d", "f", "h")]), **kw)
    assert title(s="", d="", f="processFindForm", h="OwnerRestController.processFindForm") == "Process Find Form (Owner)"
    assert title(s="", d="", f="get_user_by_id", h="UserController.get") == "Get User By Id"
    assert title(s="", d="lists all. Then more", f="x", h="") == "Lists all"
    assert title(s=" Short ", d="", f="x", h="") == "Short"
    assert value(spark, documents.clean_title(F.col("t")), t='  "A  title"**. ') == "A title"
    assert value(spark, documents.clean_title(F.col("t")), t="a/b") is None


def test_markdown_errors(spark):
    route = spark.createDataFrame([("shop", "get", "GET", "/users/{id}", ["NOT_FOUND", '{"type":"VALIDATION_ERROR","status":400,"fields":[{"name":"email","rule":"max"}]}'])],
                                  "repo string, api string, method string, path string, errors array<string>").withColumn("handler", F.lit("Users.get"))
    content = documents.render_docs(route).first().content
    assert "| NOT_FOUND | - | - |" in content and "| 400 | email | max |" in content
    assert "## Security" not in content and content.startswith("# Users.get\n")


def test_masking_and_urls(spark):
    mask = lambda k, v: value(spark, config.mask_secrets(F.col("k"), F.col("v")), k=k, v=v)
    assert mask("db.password", "x") == "****" and mask("db.password", "${PW}") == "${PW}" and mask("token.uri", "http://t") == "http://t"
    assert mask("plain", "amqp://u:secret@h/x") == "amqp://u:****@h/x"
    t = value(spark, config.jdbc_target(F.col("u")), u="jdbc:postgresql://db:5432/shop?ssl=true")
    assert (t.type, t.host, t.port, t.database, t.in_memory) == ("postgresql", "db", 5432, "shop", False)
    assert value(spark, config.jdbc_target(F.col("u")), u="jdbc:h2:mem:test").in_memory


def test_nested_documents(spark):
    docs = [("f", '{"server": {"port": 80}, "list": ["a", null, true], "deep": [{"id": 1.5}, [{"x": "y"}]], "none": null, "no": [], "empty": {}}'), ("bad", "{oops"), ("list", "[1]"), ("blank", " "), ("null", None)]
    found = config.flatten_config(spark.createDataFrame(docs, "file string, content string"))
    assert rows(found) == sorted([("f", "server.port", "80", False), ("f", "list", "a,,True", False), ("f", "list[0]", "a", False), ("f", "list[1]", "", False), ("f", "list[2]", "True", False),
                                  ("f", "deep[0].id", "1.5", False), ("f", "deep[1][0].x", "y", False), ("f", "none", "", False), ("f", "no", "", False), ("bad", None, None, True)], key=repr)
    assert config.flatten_config(spark.createDataFrame([], "file string, content string")).count() == 0


def test_central_files_stay_in_their_repository(spark):
    modules = spark.createDataFrame([("r1", "m", "svc", True), ("r2", "m", "svc", True)], "repo string, module string, app_name string, is_client boolean")
    central = spark.createDataFrame([("r1", "application-" + "p" * 300, "k", "1"), ("r2", "svc-prod", "k", "2"), ("r2", "application", "s", "3")], "repo string, stem string, key string, value string")
    local = spark.createDataFrame([("r1", "m", "", "k", "0", 1)], "repo string, module string, profile string, key string, value string, source_order long")
    found = config.apply_central(local, central, modules)
    assert rows(found, "repo", "module", "profile", "value") == sorted([("r1", "m", "", "0"), ("r1", "m", "p" * 300, "1"), ("r2", "m", "", "3"), ("r2", "m", "prod", "2")], key=repr)


def test_placeholder_cycles_end(spark):
    data = [("m", "default", "a", "${b}"), ("m", "default", "b", "${a}"), ("m", "default", "c", "${none:d}-${none}")]
    found = {r.key: r.value for r in config.resolve_placeholders(spark.createDataFrame(data, "module string, profile string, key string, value string")).collect()}
    assert found["c"] == "d-${none}" and set(found) == {"a", "b", "c"} and "${" in found["a"]


def test_search_scores(spark):
    score = lambda q, name, repo: round(value(spark, text.search_score(q, F.col("n"), F.col("r")), n=name, r=repo), 3)
    assert score("get user", "get user", "") == 1.0
    assert score("user", "getUser getUser", "") == 0.8
    assert score("fetch the order", "orders list", "shop") == 0.63
    assert score("get things", "retrieve x", "") == 0.65
    assert score("zzz", "abc abc", "") == 0.0


def test_document_tokens_and_levels(spark):
    tokens = value(spark, text.endpoint_tokens(F.col("t")), t="GET /api/users/{id} and POST /api/users/{id} plus /x")
    assert sorted(tokens) == ["/api/users/{id}", "/x", "GET", "POST"]
    level = lambda r, t: value(spark, text.doc_impact_level(F.lit(r), F.lit(t)))
    assert [level(0, 0), level(0, 5), level(1, 10), level(1, 4), level(1, 2)] == ["none", "none", "low", "medium", "high"]


def test_coverage(spark):
    c = spark.createDataFrame([("a", 3, 5, 4, 4, 2), ("b", 1, 0, 0, 0, 0)], "api string, happy_path long, error_cases long, security_tests long, edge_cases long, performance_tests long")
    full, poor = qa.qa_coverage(c).orderBy("api").collect()
    assert full.overall_score == 100.0 and full.recommendations == ["✅ Comprehensive test coverage - ready for QA execution"]
    assert (poor.happy_path_score, poor.overall_score, len(poor.recommendations)) == (33.3, 6.7, 4)


def test_mapper_and_files(spark):
    xml = '<mapper namespace="n"><sql id="c">a, b</sql><select id="s">SELECT <include refid="c"/>\n FROM t</select></mapper>'
    found = builds.mapper_statements(spark.createDataFrame([("f", xml), ("g", "<broken mapper namespace")], "file string, content string"), ["file"])
    assert rows(found, "id", "operation", "sql") == [("s", "READ", "SELECT a, b FROM t")]
    xml = ('<?xml version="1.0"?><!-- <select id="x">no</select> --><mapper namespace="n.s"><resultMap id="r"/><resultMap id="q" type="T"><id column="i"/></resultMap><sql id="w">WHERE a &lt; $1</sql>'
           "<insert id='i'>INSERT <![CDATA[ INTO t VALUES (a < b && c) ]]></insert><update\n id=\"u\" x='a>b'>UPDATE t <if test=\"a > 1\">SET a=#{a}</if><include refid=\"w\"></include></update><delete>x</delete><select id=\"e\"/></mapper>")
    found = builds.mapper_statements(spark.createDataFrame([("f", xml)], "file string, content string"), ["file"])
    assert rows(found, "namespace", "entity", "id", "operation", "sql") == [("n.s", "T", "i", "WRITE", "INSERT INTO t VALUES (a < b && c)"), ("n.s", "T", "u", "WRITE", "UPDATE t SET a=#{a}WHERE a < $1")]
    paths = spark.createDataFrame([("src/main/A.java",), ("src/test/java/A.java",), ("build/A.java",), ("a/src/it/x.java",), ("a/source/test/x.java",), ("A.kt",)], "path string")
    assert rows(files.source_files(paths, ".java")) == [("a/source/test/x.java",), ("src/main/A.java",)]


@pytest.mark.parametrize("seed", range(4))
def test_neighbour_counts_by_all_pairs(spark, seed):
    rng = random.Random(seed)
    words = [f"/t{k}" for k in range(3 + 9 * (seed % 2))] + ["GET", "no token", "PUT"]
    names = ["user list", "profile", "auth user", "order", "plain", "payment order", "Token"]
    docs = [(rng.choice(["a", "b"]), k, " ".join(rng.choices(words, k=rng.randint(0, 4))), rng.choice(names)) for k in range(60)]
    docs += [("a", 100, None, None), ("b", 101, "", ""), ("c", 102, "/alone", "user")]
    frame = spark.createDataFrame(docs, "repo string, doc long, content string, api string").repartition(3)

    def tokens(x):
        return set(re.findall(text.PATH_TOKEN, x or "") + re.findall(text.VERB_TOKEN, x or ""))

    def related(x, y):
        return any(a in x and any(w in y for w in words) or a in y and any(w in x for w in words) for a, words in text.NAME_RELATIONS)

    want = set()
    for repo, k, content, name in docs:
        near = sorted(str(j) for other, j, c, n in docs if other == repo and j != k and (tokens(content) & tokens(c) or name and n and related(name.lower(), n.lower())))
        if near:
            want.add((repo, k, len(near), tuple(near[:3])))
    stars = text.document_stars(frame, "doc", "content", "api", scope=["repo"])
    got = {(r["repo"], r["doc"], r["affected"], tuple(r["names"])) for r in text.neighbour_counts(stars, "doc", ["repo"]).collect() if r["affected"]}
    assert got == want


@pytest.mark.parametrize("seed", range(2))
def test_search_with_a_table_of_queries(spark, seed):
    """Scores, keyword rule and top-k of every query against the single-query score."""
    rng = random.Random(seed)
    words = ["get", "list", "users", "user", "create", "order", "to", "a", "branches", "api", "x", "payment", "the"]
    apis = [(k, " ".join(rng.choices(words, k=rng.randint(1, 4))), rng.choice([None, "v1", "Users Api"]), rng.choice([None, "", "shop", "order", "user"])) for k in range(40)]
    apis += [(100, None, None, "shop"), (101, "get", "users", None)]
    asked = [(k, rng.choice([" ", "  "]).join(rng.choices(words, k=rng.randint(1, 4))).upper()) for k in range(12)] + [(50, ""), (51, None), (52, "get  users of the whole shop"), (53, "get users")]
    frame = spark.createDataFrame(apis, "id long, api string, title string, repo string").repartition(2)
    queries = spark.createDataFrame(asked, "query_id long, query string")
    want = set()
    for qid, q in asked:
        plain = " ".join((q or "").lower().split())
        if not plain:
            continue
        for r in text.score_queries(frame, [plain]).collect():
            own, of = f"{r['api'] or ''} {r['title'] or ''}".lower(), (r["repo"] or "").lower()
            if any(w in own or w in of for w in plain.split()) and r["score"] >= 0.3:
                want.add((qid, r["id"], round(r["score"], 4)))
    got = text.keyword_search(frame, queries)
    assert {(r["query_id"], r["id"], round(r["score"], 4)) for r in got.collect()} == want and got.count() == len(want)
    best = text.keyword_search(frame, queries, top=3).collect()
    for qid in {q for q, _, _ in want}:
        scores = sorted((x for q, _, x in want if q == qid), reverse=True)[:3]
        assert sorted((round(r["score"], 4) for r in best if r["query_id"] == qid), reverse=True) == scores
