"""Document text, search and QA operators on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import qa, text
from .bindings import RELATIONS, oracle
from .registry import Source, query, with_relations

RELATIONS["TOK"] = ("SELECT DISTINCT page_id, token FROM (SELECT page_id, unnest(regexp_extract_all(html, '/[a-zA-Z0-9/_\\-{}]+')) AS token FROM pages "
                    "UNION ALL SELECT page_id, unnest(regexp_extract_all(html, 'GET|POST|PUT|DELETE|PATCH')) FROM pages)")
HOST = "regexp_extract(url, '//([^/]+)', 1)"


@query("extract_endpoints", oracle("SELECT page_id, token FROM TOK"))
def extract_endpoints(src: Source):
    return text.extract_endpoints(src.table("pages"), ["page_id"], "html")


@query("extract_endpoints_documents", (
    "SELECT DISTINCT doc_id, token FROM (SELECT doc_id, unnest(regexp_extract_all(text, '/[a-zA-Z0-9/_\\-{}]+')) AS token FROM documents "
    "UNION ALL SELECT doc_id, unnest(regexp_extract_all(text, 'GET|POST|PUT|DELETE|PATCH')) FROM documents)"))
def extract_endpoints_documents(src: Source):
    return text.extract_endpoints(src.table("documents"), ["doc_id"], "text")


# consecutive pages of a host play the versions of a document
RELATIONS["PG"] = (f"SELECT page_id, {HOST} AS host, lag(page_id) OVER (PARTITION BY {HOST} ORDER BY page_id) AS prev_id FROM pages")
RELATIONS["GONE"] = ("SELECT g.page_id, t.token FROM PG g JOIN TOK t ON t.page_id = g.prev_id "
                     "WHERE NOT EXISTS (SELECT 1 FROM TOK n WHERE n.page_id = g.page_id AND n.token = t.token)")
RELATIONS["CAME"] = ("SELECT g.page_id, t.token FROM PG g JOIN TOK t ON t.page_id = g.page_id WHERE g.prev_id IS NOT NULL "
                     "AND NOT EXISTS (SELECT 1 FROM TOK n WHERE n.page_id = g.prev_id AND n.token = t.token)")


def _delta(src: Source):
    pages = src.table("pages").withColumn("host", F.regexp_extract("url", "//([^/]+)", 1))
    return text.token_delta(pages, ["host"], "page_id", "html")


@query("doc_breaking", oracle("SELECT page_id, 'added' AS change, token FROM CAME UNION ALL SELECT page_id, 'removed', token FROM GONE"))
def doc_breaking(src: Source):
    d = _delta(src)
    side = lambda c: d.select("page_id", F.lit(c).alias("change"), F.explode(c).alias("token"))
    return side("added").unionByName(side("removed"))


@query("affected_resources", oracle("SELECT page_id, token AS endpoint, regexp_extract(token, '([^/]*)$', 1) AS resource FROM GONE "
                                    "WHERE token NOT LIKE '%/'"))
def affected_resources(src: Source):
    return text.affected_resources(_delta(src), ["page_id"])


RELATIONS["LEVELS"] = (
    "SELECT g.page_id, count(x.token) AS removed, (SELECT count(*) FROM TOK t WHERE t.page_id = g.prev_id) AS total "
    "FROM PG g LEFT JOIN GONE x ON x.page_id = g.page_id WHERE g.prev_id IS NOT NULL GROUP BY g.page_id, g.prev_id")
_LEVEL = ("CASE WHEN total = 0 OR removed = 0 THEN 'none' WHEN removed / total < 0.2 THEN 'low' "
          "WHEN removed / total < 0.5 THEN 'medium' ELSE 'high' END")


@query("doc_impact_level", oracle(f"SELECT page_id, removed > 0 AS migration_required, {_LEVEL} AS impact_level FROM LEVELS"))
def doc_impact_level(src: Source):
    return _delta(src).select("page_id", "migration_required", "impact_level")


# keyword groups over the words that hosts and paths of the pages use
PAGE_RELATIONS = (("blog", ("cheap", "/de/")), ("example.net/fr", ("example.org", "//m.")), ("pills", ("blog",)))
RELATIONS["SIDES"] = " UNION ALL ".join(
    f"SELECT page_id, '{key}' AS hub, '{side}' AS side FROM pages WHERE " + " OR ".join(f"contains(lower(url), '{w}')" for w in words)
    for key, related in PAGE_RELATIONS for side, words in (("holder", (key,)), ("related", related)))
RELATIONS["STARS"] = (
    "SELECT t.page_id, t.token AS hub, 'shared' AS side, c.members FROM TOK t JOIN (SELECT token, count(*) AS members FROM TOK GROUP BY token HAVING count(*) > 1) c ON t.token = c.token "
    "UNION ALL SELECT s.page_id, s.hub, s.side, c.members FROM SIDES s JOIN (SELECT hub, CASE side WHEN 'holder' THEN 'related' ELSE 'holder' END AS side, count(*) AS members "
    "FROM SIDES GROUP BY ALL) c ON c.hub = s.hub AND c.side = s.side")
RELATIONS["LINKED"] = (
    "SELECT DISTINCT a.page_id AS target, b.page_id AS neighbour FROM STARS a JOIN STARS b ON a.hub = b.hub AND a.page_id <> b.page_id "
    "AND b.side = CASE a.side WHEN 'holder' THEN 'related' WHEN 'related' THEN 'holder' ELSE a.side END")


def _stars(src: Source):
    return text.document_stars(src.table("pages"), "page_id", "html", "url", PAGE_RELATIONS)


@query("doc_dependency_graph", oracle("SELECT hub, side, page_id, members FROM STARS"))
def doc_dependency_graph(src: Source):
    return _stars(src)


_NEAR = "SELECT m.page_id AS target, t.page_id AS neighbour, t.token FROM TOK m JOIN TOK t ON m.token = t.token AND m.page_id <> t.page_id"


def _neighbours(src: Source):
    # every page is a target
    pages = src.table("pages")
    return text.related_documents(text.extract_endpoints(pages, ["page_id"], "html"), pages, "page_id")


@query("related_documents", oracle(
    f"SELECT target, neighbour, string_agg(token, ',' ORDER BY token) AS token FROM (SELECT *, row_number() OVER (PARTITION BY target, neighbour "
    f"ORDER BY token) AS rn FROM ({_NEAR})) WHERE rn <= 3 GROUP BY target, neighbour"))
def related_documents(src: Source):
    return _neighbours(src).select("target", "neighbour", F.array_join("token", ",").alias("token"))


@query("doc_impact", oracle(
    "SELECT p.page_id, coalesce(l.impact_level, 'none') AS impact_level, coalesce(n.affected, 0) AS affected, coalesce(n.names, '') AS names, CASE impact_level WHEN 'high' THEN 3 WHEN 'medium' THEN 3 WHEN 'low' THEN 2 "
    f"ELSE 0 END + CASE WHEN removed > 0 THEN 1 ELSE 0 END + CASE WHEN n.affected > 0 THEN 1 ELSE 0 END AS advice FROM pages p LEFT JOIN (SELECT *, {_LEVEL} AS impact_level FROM LEVELS) l ON l.page_id = p.page_id "
    "LEFT JOIN (SELECT target, max(n) AS affected, string_agg(neighbour, ', ' ORDER BY neighbour) FILTER (rn <= 3) AS names FROM (SELECT target, neighbour::VARCHAR AS neighbour, "
    "count(*) OVER (PARTITION BY target) AS n, row_number() OVER (PARTITION BY target ORDER BY neighbour::VARCHAR) AS rn FROM LINKED) GROUP BY target) n ON n.target = p.page_id"))
def doc_impact(src: Source):
    near = text.neighbour_counts(_stars(src), "page_id")
    d = src.table("pages").select("page_id").join(_delta(src), "page_id", "left").join(near, "page_id", "left")
    level, removed = F.coalesce("impact_level", F.lit("none")), F.coalesce(F.size("removed"), F.lit(0))
    affected, names = F.coalesce("affected", F.lit(0)).cast("long"), F.coalesce("names", F.array().cast("array<string>"))
    advice = text.doc_recommendations(level, affected, names, removed)
    return d.select("page_id", level.alias("impact_level"), affected.alias("affected"), F.array_join(names, ", ").alias("names"), F.size(advice).alias("advice"))


# keyword groups over the words the part names use
PART_RELATIONS = (("ring", ("bolt", "gear")), ("widget", ("plate", "hot")), ("red", ("anvil",)))


@query("name_relation_links", (
    "WITH s AS (SELECT p_partkey, 'ring' AS relation, 'holder' AS side FROM part WHERE contains(p_name, 'ring') UNION ALL "
    "SELECT p_partkey, 'ring', 'related' FROM part WHERE contains(p_name, 'bolt') OR contains(p_name, 'gear') UNION ALL "
    "SELECT p_partkey, 'widget', 'holder' FROM part WHERE contains(p_name, 'widget') UNION ALL "
    "SELECT p_partkey, 'widget', 'related' FROM part WHERE contains(p_name, 'plate') OR contains(p_name, 'hot') UNION ALL "
    "SELECT p_partkey, 'red', 'holder' FROM part WHERE contains(p_name, 'red') UNION ALL "
    "SELECT p_partkey, 'red', 'related' FROM part WHERE contains(p_name, 'anvil')) "
    "SELECT * FROM s WHERE relation IN (SELECT relation FROM s GROUP BY relation HAVING count(DISTINCT side) = 2)"))
def name_relation_links(src: Source):
    return text.name_relation_links(src.table("part"), "p_name", ["p_partkey"], PART_RELATIONS)


@query("name_relation", (
    "SELECT o_orderkey, (contains(a, 'user') AND (contains(b, 'auth') OR contains(b, 'profile'))) OR (contains(b, 'user') AND (contains(a, 'auth') OR contains(a, 'profile'))) "
    "OR (contains(a, 'order') AND contains(b, 'payment')) OR (contains(b, 'order') AND contains(a, 'payment')) AS related FROM ("
    "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'userlist' WHEN 'O' THEN 'orderlist' ELSE 'payment' END AS a, "
    "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'authtoken' WHEN '2' THEN 'profile' WHEN '3' THEN 'payments' WHEN '4' THEN 'orders' ELSE 'users' END AS b FROM orders)"))
def name_relation(src: Source):
    a = "CASE o_orderstatus WHEN 'F' THEN 'UserList' WHEN 'O' THEN 'OrderList' ELSE 'Payment' END"
    b = ("CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'authToken' WHEN '2' THEN 'profile' WHEN '3' THEN 'payments' "
         "WHEN '4' THEN 'orders' ELSE 'users' END")
    return src.table("orders").select("o_orderkey", text.name_relation(F.expr(a), F.expr(b)).alias("related"))


SEARCHES = ("red widget", "create new ring for Brand#1", "list all bolt")
_NAME = "lower(p_name || ' ' || p_type)"


def _score_sql(q: str) -> str:
    words = q.lower().split()
    syn = dict(text.SYNONYMS)
    hits = " + ".join(f"CASE WHEN contains({_NAME}, '{w}') THEN 1 ELSE 0 END" for w in words)
    parts = [f"CASE WHEN contains({_NAME}, '{q.lower()}') OR contains('{q.lower()}', {_NAME}) THEN 0.8::DOUBLE ELSE 0 END", f"least(0.6::DOUBLE, ({hits}) * 0.15::DOUBLE)"]
    parts += [f"CASE WHEN contains({_NAME}, '{w}') THEN 0.7::DOUBLE ELSE 0 END" for w in words if len(w) >= 4 and w not in text.STOP_WORDS]
    parts += [f"CASE WHEN contains({_NAME}, '{s}') THEN 0.65::DOUBLE ELSE 0 END" for w in words for s in syn.get(w, ())]
    best = f"greatest({', '.join(parts)})"
    foreign = f"NOT contains('{q.lower()}', lower(p_brand)) AND NOT contains(lower(p_brand), '{q.lower()}')"
    keyword = " OR ".join(f"contains({_NAME}, '{w}') OR contains(lower(p_brand), '{w}')" for w in words)
    return (f"SELECT p_partkey, '{q}' AS query, round(CASE WHEN {_NAME} = '{q.lower()}' THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, {best} * "
            f"CASE WHEN {foreign} THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END) END, 4) AS score, {keyword} AS keyword FROM part")


_SCORES = " UNION ALL ".join(_score_sql(q) for q in SEARCHES)


def _apis(src: Source):
    return src.table("part").selectExpr("p_partkey", "p_name AS api", "p_type AS title", "p_brand AS repo")


@query("search_score", f"SELECT p_partkey, query, score FROM ({_SCORES})")
def search_score(src: Source):
    return text.score_queries(_apis(src), SEARCHES).select("p_partkey", "query", F.round("score", 4).alias("score"))


# the queries asked: every hundredth part gives one, against all parts
_ASKED = ("SELECT p_partkey AS query_id, CASE p_partkey % 3 WHEN 0 THEN 'List  all ' || p_name WHEN 1 THEN 'create ' || p_type || ' for ' || p_brand ELSE p_name || ' ' || p_type END AS query "
          "FROM part WHERE p_partkey % 100 = 0")
_VALUES = ", ".join(f"('{w}', '{s}')" for w, others in text.SYNONYMS for s in others)
_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
_FOUND = (
    f"WITH asked AS (SELECT query_id, trim(regexp_replace(lower(query), '\\s+', ' ', 'g')) AS q FROM ASK), syn(word, other) AS (VALUES {_VALUES}), "
    "w AS (SELECT query_id, unnest(string_split(q, ' ')) AS word FROM asked), "
    f"t AS (SELECT p_partkey, {_NAME} AS name, lower(p_brand) AS repo FROM part), "
    f"m AS (SELECT w.query_id, t.p_partkey, count(*) AS hits, max(CASE WHEN length(word) >= 4 AND word NOT IN ({_STOP}) THEN 0.7::DOUBLE ELSE 0 END) AS best FROM w JOIN t ON contains(t.name, w.word) GROUP BY ALL), "
    "o AS (SELECT DISTINCT w.query_id, t.p_partkey FROM w JOIN syn ON syn.word = w.word JOIN t ON contains(t.name, syn.other)), "
    "s AS (SELECT a.query_id, t.p_partkey, t.name, a.q, coalesce(m.hits, 0) AS hits, "
    "CASE WHEN NOT contains(a.q, t.repo) AND NOT contains(t.repo, a.q) THEN 0.9::DOUBLE ELSE 1 END * greatest(coalesce(m.best, 0), CASE WHEN o.query_id IS NULL THEN 0 ELSE 0.65::DOUBLE END, "
    "least(0.6::DOUBLE, coalesce(m.hits, 0) * 0.15::DOUBLE), CASE WHEN contains(t.name, a.q) OR contains(a.q, t.name) THEN 0.8::DOUBLE ELSE 0 END) AS score, "
    "EXISTS (SELECT 1 FROM w WHERE w.query_id = a.query_id AND contains(t.repo, w.word)) AS of_repo FROM asked a CROSS JOIN t LEFT JOIN m ON m.query_id = a.query_id AND m.p_partkey = t.p_partkey "
    "LEFT JOIN o ON o.query_id = a.query_id AND o.p_partkey = t.p_partkey) "
    "SELECT query_id, p_partkey, round(CASE WHEN name = q THEN 1 ELSE score END, 4) AS score FROM s WHERE (hits > 0 OR of_repo) AND CASE WHEN name = q THEN 1 ELSE score END >= 0.3")


@query("keyword_search", with_relations({"ASK": _ASKED}, _FOUND).replace("\nWITH asked AS", ", asked AS"))
def keyword_search(src: Source):
    found = text.keyword_search(_apis(src), src.sql(_ASKED))
    return found.select("query_id", "p_partkey", F.round("score", 4).alias("score"))



@query("extract_route_decorators", (
    "SELECT doc_id, upper(CASE lang WHEN 'en' THEN 'get' WHEN 'fr' THEN 'delete' ELSE 'post' END) AS method, '/' || source || '/' || doc_id AS path, "
    "'handle_' || lang AS function_name, 'handle_' || lang AS api_id FROM documents WHERE lang <> 'es'"))
def extract_route_decorators(src: Source):
    # a decorated function behind the prose of each document; Spanish ones get the decorator only
    d = src.table("documents")
    verb = F.expr("CASE lang WHEN 'en' THEN 'get' WHEN 'fr' THEN 'delete' ELSE 'post' END")
    code = F.concat("text", F.lit("\n@router."), verb, F.lit('("/'), "source", F.lit("/"), "doc_id", F.lit('")\n'),
                    F.when(F.col("lang") != "es", F.concat(F.lit("async def handle_"), "lang", F.lit("(q):\n"))).otherwise("pass\n"))
    return text.extract_route_decorators(d.select("doc_id", code.alias("code")), ["doc_id"], "code")


# ---------------------------------------------------------------- QA plans

_CATEGORY = ("CASE event_type WHEN 'click' THEN 'happy_path' WHEN 'view' THEN 'edge_cases' WHEN 'error' THEN 'error_cases' "
             "WHEN 'signup' THEN 'security_tests' ELSE 'performance_tests' END")
RELATIONS["CASES"] = (f"SELECT 'u' || user_id || '-' || CAST(CAST(ts AS DATE) AS VARCHAR(10)) AS api, {_CATEGORY} AS category, "
                      "'case ' || event_id AS test_case, event_id AS pos FROM events")
RELATIONS["COUNTS"] = ("SELECT api, " + ", ".join(f"sum(CASE WHEN category = '{c}' THEN 1 ELSE 0 END)::BIGINT AS {c}" for c, _, _ in qa.CATEGORIES)
                       + " FROM CASES GROUP BY api")


def _cases(src: Source):
    return src.sql(RELATIONS["CASES"])


def _counts(src: Source):
    return qa.case_counts(_cases(src), ["api"])


_S = {c: f"least(100.0::DOUBLE, {c} / {t}.0::DOUBLE * 100)" for c, t, _ in qa.CATEGORIES}


@query("qa_coverage", oracle(
    "SELECT api, " + ", ".join(f"round({_S[c]}, 1) AS {c}_score" for c in _S) + ", (happy_path + edge_cases + error_cases + security_tests + "
    "performance_tests)::BIGINT AS total_test_count, round(" + " + ".join(f"{_S[c]} * {w}::DOUBLE" for c, _, w in qa.CATEGORIES) + ", 1) AS overall_score, "
    "CASE WHEN error_cases >= 4 AND security_tests >= 3 AND edge_cases >= 3 AND performance_tests > 0 THEN 1 ELSE "
    "(error_cases < 4)::INT + (security_tests < 3)::INT + (edge_cases < 3)::INT + (performance_tests = 0)::INT END AS advice FROM COUNTS"))
def qa_coverage(src: Source):
    scores = [f"{c}_score" for c in _S]
    return qa.qa_coverage(_counts(src)).select("api", *scores, "total_test_count", "overall_score", F.size("recommendations").alias("advice"))


@query("qa_checklist", oracle(
    "SELECT api, (happy_path + error_cases)::BIGINT AS total_test_scenarios, greatest(2.0::DOUBLE, (happy_path + error_cases) / 10) AS estimated_testing_hours, "
    "3 + CASE WHEN security_tests > 0 THEN 3 ELSE 0 END + CASE WHEN performance_tests > 0 THEN 3 ELSE 0 END + 5 AS lines, "
    "'Core Functionality: ☐ Run ' || happy_path || ' happy path tests - all must pass' AS first_line FROM COUNTS"))
def qa_checklist(src: Source):
    return qa.qa_checklist(_counts(src)).select("api", "total_test_scenarios", "estimated_testing_hours", F.size("checklist").alias("lines"),
                                                F.get("checklist", F.lit(0)).alias("first_line"))


@query("template_plan", "SELECT c_custkey, category, pos, test_case FROM customer, (VALUES " + ", ".join(
    f"('{c}', {i}, '{t}')" for c, ts in qa.TEMPLATE_CASES.items() for i, t in enumerate(ts, start=1)) +
    ") AS t(category, pos, test_case) WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def template_plan(src: Source):
    planned = src.table("orders").where("o_totalprice > 300000").selectExpr("o_custkey AS c_custkey")
    return qa.template_plan(src.table("customer").select("c_custkey"), planned, ["c_custkey"])


@query("recommend_templates", (
    "WITH p AS (SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'UserLogin' WHEN 'LARGE' THEN 'orderSearch' WHEN 'PROMO' THEN 'listFilter' ELSE p_name END AS n FROM part) "
    "SELECT p_partkey, 'Happy Path - REST Standard' AS template FROM p UNION ALL SELECT p_partkey, 'HTTP Error Codes' FROM p UNION ALL "
    "SELECT p_partkey, 'OWASP Top 10' FROM p UNION ALL SELECT p_partkey, 'Authentication & Authorization' FROM p WHERE n = 'UserLogin' UNION ALL "
    "SELECT p_partkey, 'Load Testing Basics' FROM p WHERE n = 'orderSearch' UNION ALL SELECT p_partkey, 'Boundary Value Testing' FROM p WHERE n IN ('orderSearch', 'listFilter')"))
def recommend_templates(src: Source):
    name = F.expr("CASE p_type WHEN 'ECONOMY' THEN 'UserLogin' WHEN 'LARGE' THEN 'orderSearch' WHEN 'PROMO' THEN 'listFilter' ELSE p_name END")
    return qa.recommend_templates(src.table("part").withColumn("n", name), ["p_partkey"], "n").drop("pos")


RELATIONS["TPL"] = ("SELECT p_brand AS repo, p_partkey AS created_at, CASE WHEN p_size < 25 THEN upper(p_name) ELSE p_name || ' ' END AS name, "
                    "p_type AS category, p_size AS n FROM part")


def _templates(src: Source):
    t = src.sql(RELATIONS["TPL"])
    return t.withColumn("test_cases", F.transform(F.sequence(F.lit(1), "n"), lambda i: F.concat(F.lit("step "), i.cast("string"))))


@query("list_templates", oracle(
    "SELECT repo, key, max(created_at) AS created_at, max_by(category, created_at) AS category, max_by(n, created_at) AS test_count FROM "
    "(SELECT *, replace(lower(trim(name)), ' ', '_') AS key FROM TPL) GROUP BY repo, key"))
def list_templates(src: Source):
    return qa.list_templates(_templates(src)).select("repo", "key", "created_at", "category", "test_count")


@query("apply_templates", oracle(
    "SELECT api AS repo, category, 0 AS source, pos, test_case FROM CASES UNION ALL SELECT repo, category, CASE name WHEN 'RED RING' THEN 1 ELSE 2 END, "
    "i - 1, 'step ' || i FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM TPL WHERE name IN ('RED RING', 'hot gear '))"))
def apply_templates(src: Source):
    cases = _cases(src).withColumnRenamed("api", "repo")
    return qa.apply_templates(cases, _templates(src), ["RED RING", "hot gear "], ["repo"])
