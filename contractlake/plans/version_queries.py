"""Version history operators on the version events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import documents, versions
from ..operators.ordered import dense_index
from .bindings import RELATIONS, oracle, relation
from .registry import Source, query

K = ("repo", "api")

RELATIONS["VX"] = ("SELECT *, coalesce(lag(signature) OVER (PARTITION BY repo, api ORDER BY pos), '') AS prev FROM V")
RELATIONS["VT"] = ("SELECT repo, api, signature, commit_id, pos, ts, "
                   "row_number() OVER (PARTITION BY repo, api ORDER BY pos) AS version FROM VX WHERE prev <> signature")
RELATIONS["VL"] = ("SELECT repo, api, max(version) AS version, count(*) AS versions, max_by(signature, version) AS signature, "
                   "max_by(commit_id, version) AS commit_id, max_by(ts, version) AS ts FROM VT GROUP BY repo, api")
RELATIONS["TITLES"] = ("SELECT 'repo-c' AS repo, 'user-' || c_custkey AS api, c_name AS title, "
                       "CASE WHEN c_mktsegment = 'BUILDING' THEN 'llm' ELSE 'fallback' END AS source FROM customer "
                       "WHERE c_mktsegment <> 'MACHINERY'")
RELATIONS["JOBS"] = (
    "SELECT event_id AS id, 'analyze' AS kind, props AS payload, 'user-' || user_id AS repo, "
    "'commit-abcdef-' || event_id AS commit_id, CASE event_type WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'queued' "
    "WHEN 'error' THEN 'failed' ELSE 'done' END AS status, CASE WHEN value < 30 THEN 0 ELSE 1 END AS attempts, "
    "CAST(floor(value) AS INT) AS progress_done, CASE WHEN value < 5 THEN 0 ELSE 250 END AS progress_total, "
    "CASE WHEN event_type = 'error' THEN ' boom ' || props || chr(10) || 'at line 2' ELSE '' END AS error, ts AS finished_at, "
    "(SELECT max(ts) FROM events) AS now_ts FROM events")


def _versions(src: Source):
    return versions.append_if_changed(relation(src, "V"), keys=K)


@query("append_if_changed", oracle("SELECT repo, api, version, signature, commit_id FROM VT"))
def append_if_changed(src: Source):
    return _versions(src).select(*K, "version", "signature", "commit_id")


@query("append_to_existing", oracle("SELECT repo, api, version, signature, commit_id FROM VT"))
def append_to_existing(src: Source):
    # the events of the first half of the month are stored first, the rest arrives later
    v = relation(src, "V")
    early = F.col("ts") < F.lit("2024-01-15").cast("timestamp")
    stored = versions.append_if_changed(v.where(early), keys=K)
    later = versions.append_if_changed(v.where(~early), stored, keys=K, size=500_000)
    return stored.unionByName(later).select(*K, "version", "signature", "commit_id")


@query("upload_counts", oracle("SELECT count(*) FILTER (prev <> signature) AS created, count(*) FILTER (prev = signature) AS unchanged FROM VX"))
def upload_counts(src: Source):
    return versions.upload_counts(versions.classify_uploads(relation(src, "V"), keys=K))


@query("latest_signature", oracle("SELECT repo, api, signature FROM VL"))
def latest_signature(src: Source):
    return versions.latest_signature(_versions(src), K)


@query("latest_versions", oracle("SELECT repo, api, version, versions, signature, commit_id FROM VL"))
def latest_versions(src: Source):
    return versions.latest_versions(_versions(src), K, ["signature", "commit_id"])


@query("latest_docs", oracle("SELECT l.repo, l.api, l.version, coalesce(t.title, l.api) AS title, 'doc of ' || l.commit_id AS content "
                             "FROM VL l LEFT JOIN TITLES t ON l.repo = t.repo AND l.api = t.api"))
def latest_docs(src: Source):
    docs = _versions(src).withColumn("content", F.concat(F.lit("doc of "), "commit_id"))
    return versions.latest_docs(docs, relation(src, "TITLES"), K)


@query("version_rows", oracle("SELECT v.repo, v.api, v.version, CAST(v.version - 1 AS VARCHAR) AS previous, v.commit_id, "
                              "v.version = l.version AS is_latest FROM VT v JOIN VL l ON v.repo = l.repo AND v.api = l.api "
                              "WHERE v.version > 1 UNION ALL SELECT v.repo, v.api, v.version, 'none', v.commit_id, v.version = l.version "
                              "FROM VT v JOIN VL l ON v.repo = l.repo AND v.api = l.api WHERE v.version = 1"))
def version_rows(src: Source):
    rows = versions.version_rows(_versions(src), K)
    return rows.select(*K, "version", F.coalesce(F.col("previous").cast("string"), F.lit("none")).alias("previous"), "commit_id", "is_latest")


@query("default_version_pair", oracle("SELECT repo, api, coalesce(max(version) FILTER (rn = 2), 0) AS v1, max(version) FILTER (rn = 1) AS v2 FROM "
                                      "(SELECT *, row_number() OVER (PARTITION BY repo, api ORDER BY version DESC) AS rn FROM VT) GROUP BY repo, api"))
def default_version_pair(src: Source):
    return versions.default_version_pair(_versions(src), K).withColumn("v1", F.coalesce("v1", F.lit(0)))


def _catalog_input(src: Source):
    v = _versions(src)
    controller = F.when(F.col("signature") == "low", F.concat(F.lit("com.shop."), "repo")).otherwise("")
    handler = F.when(F.col("signature") == "mid", F.concat(F.lit("H"), "version", F.lit(".run"))).otherwise("run")
    return v.withColumn("controller", controller).withColumn("handler", handler)


_CATALOG = ("SELECT l.repo, l.api, l.version, l.versions, l.commit_id, coalesce(t.title, l.api) AS title, CASE l.signature WHEN 'low' THEN l.repo "
            "WHEN 'mid' THEN 'H' || l.version ELSE 'APIs' END AS group_label FROM VL l LEFT JOIN TITLES t ON l.repo = t.repo AND l.api = t.api")
_CATALOG_COLS = ("repo", "api", "version", "versions", "commit_id", "title", "group_label")


@query("api_catalog", oracle(_CATALOG + " WHERE l.repo = 'repo-c'"))
def api_catalog(src: Source):
    # one repository: the filter reaches the scan before anything is numbered
    one = _catalog_input(src).where(F.col("repo") == "repo-c")
    return versions.api_catalog(one, relation(src, "TITLES"), K).select(*_CATALOG_COLS)


@query("all_apis", oracle(_CATALOG))
def all_apis(src: Source):
    return versions.all_apis(_catalog_input(src), relation(src, "TITLES"), K).select(*_CATALOG_COLS)


_SUMMARY = ("SELECT repo, count(*) AS api_count, CAST(sum(versions) AS BIGINT) AS version_count, count(*) FILTER (versions > 1) AS changed_apis, "
            "CAST(max(ts) AS VARCHAR) AS updated, repo <> 'repo-v' AS has_architecture, "
            "CASE WHEN repo <> 'repo-v' THEN 'web-' || repo || ',db1,db2,kafka' ELSE '' END AS technologies FROM VL GROUP BY repo")


def _summary(src: Source):
    v = _versions(src)
    names = lambda *xs: F.array(*xs)
    tech = F.create_map(F.lit("messaging"), names(F.lit("kafka")), F.lit("database"), names(F.lit("db1"), F.lit("db2")),
                        F.lit("test"), names(F.lit("junit")), F.lit("web"), names(F.concat(F.lit("web-"), "repo")))
    models = v.where(F.col("repo") != "repo-v").groupBy("repo").agg(F.max("commit_id").alias("architecture"))
    models = models.withColumn("technologies", versions.summary_technologies(tech))
    return versions.repo_summary(v, models, K)


@query("repo_summary", oracle(_SUMMARY))
def repo_summary(src: Source):
    updated = F.regexp_replace(F.date_format("updated", "yyyy-MM-dd HH:mm:ss.SSSSSS"), r"\.?0+$", "")
    return _summary(src).select("repo", "api_count", "version_count", "changed_apis", updated.alias("updated"), "has_architecture",
                                F.coalesce(F.array_join("technologies", ","), F.lit("")).alias("technologies"))


@query("recent_changes", oracle("SELECT repo, api, version, greatest(version - 1, 0) AS previous FROM VL ORDER BY ts DESC, repo, api LIMIT 8"))
def recent_changes(src: Source):
    return versions.recent_changes(_versions(src), K).select(*K, "version", F.coalesce("previous", F.lit(0)).alias("previous"))


@query("fleet_totals", oracle(f"SELECT count(*) AS repos, CAST(sum(api_count) AS BIGINT) AS apis, CAST(sum(version_count) AS BIGINT) AS versions, "
                              f"count(*) FILTER (has_architecture) AS architectures FROM ({_SUMMARY})"))
def fleet_totals(src: Source):
    return versions.fleet_totals(_summary(src))


@query("stable_title", oracle(
    "SELECT coalesce(t.repo, p.repo) AS repo, coalesce(t.api, p.api) AS api, "
    "CASE WHEN t.title IS NOT NULL AND (t.source = 'llm' OR p.source IS NULL OR p.source <> 'llm') THEN t.title ELSE p.title END AS title "
    "FROM TITLES t FULL JOIN (SELECT repo, api, 'Title ' || version AS title, CASE WHEN signature = 'low' THEN 'fallback' ELSE 'llm' END AS source "
    "FROM VL) p ON t.repo = p.repo AND t.api = p.api"))
def stable_title(src: Source):
    new = versions.latest_versions(_versions(src), K, ["signature"]).select(
        *K, F.concat(F.lit("Title "), "version").alias("title"), F.when(F.col("signature") == "low", "fallback").otherwise("llm").alias("source"))
    return versions.stable_title(relation(src, "TITLES"), new, K).drop("source")


@query("current_route", oracle("SELECT repo, api, version, signature FROM VL"))
def current_route(src: Source):
    return versions.version_at(_versions(src), None, K, ["signature"])


@query("version_table_scan", oracle("SELECT DISTINCT repo, api, version, commit_id FROM VT WHERE version = 2"))
def version_table_scan(src: Source):
    return versions.version_at(_versions(src), 2, K, ["commit_id"])


_PANEL_COLS = "id, repo, label, percent, error_line, commit_short, panel"


@query("job_panel", oracle(
    f"SELECT {_PANEL_COLS} FROM (SELECT id, repo, CASE status WHEN 'running' THEN 'Documenting' WHEN 'failed' THEN 'Failed' "
    "ELSE CASE WHEN attempts > 0 THEN 'Retrying soon' ELSE 'Queued' END END AS label, "
    "CASE WHEN progress_total > 0 THEN CAST(floor(progress_done * 100 / progress_total) AS INT) ELSE 0 END AS percent, "
    "split_part(trim(error), chr(10), 1) AS error_line, substr(commit_id, 1, 12) AS commit_short, "
    "CASE WHEN status = 'failed' THEN 'failed' ELSE 'active' END AS panel, finished_at, now_ts FROM "
    "((SELECT * FROM JOBS WHERE status IN ('queued', 'running') ORDER BY id DESC LIMIT 20) UNION ALL "
    "(SELECT * FROM JOBS WHERE status = 'failed' ORDER BY id DESC LIMIT 5))) "
    "WHERE panel = 'active' OR finished_at > now_ts - INTERVAL 1 DAY"))
def job_panel(src: Source):
    jobs = relation(src, "JOBS")
    return versions.job_panel(jobs, F.col("now_ts")).selectExpr(*_PANEL_COLS.split(", "))


@query("dedupe_uploads", oracle(
    "SELECT id, status, sha256(kind || '|{\"k\":\"' || json_extract_string(payload, '$.k') || '\"}') AS payload_hash FROM JOBS "
    "WHERE status NOT IN ('queued', 'running') OR id IN (SELECT min(id) FROM JOBS WHERE status IN ('queued', 'running') GROUP BY payload)"))
def dedupe_uploads(src: Source):
    return versions.dedupe_uploads(relation(src, "JOBS")).select("id", "status", "payload_hash")


@query("qa_plan_index", oracle("SELECT repo, api, version, commit_id AS generated_at, signature = 'low' AS is_template FROM VT"))
def qa_plan_index(src: Source):
    plans = _versions(src).select(*K, "version", F.col("commit_id").alias("generated_at"),
                                  F.when(F.col("signature") == "low", True).alias("is_template"))
    return versions.qa_plan_index(plans, K)


def _increasing(rows: str, name: str) -> dict[str, str]:
    """Relations that keep a longest increasing run of `rows` (pair, seg, l, r): chain lengths, then the way back from the last longest chain."""
    return {
        f"{name}_n": f"SELECT pair, seg, l, r, 1 AS n FROM {rows} UNION SELECT b.pair, b.seg, b.l, b.r, a.n + 1 FROM {name}_n a JOIN {rows} b ON a.pair = b.pair AND a.seg = b.seg AND a.l < b.l AND a.r < b.r",
        f"{name}_x": f"SELECT pair, seg, l, r, max(n) AS n FROM {name}_n GROUP BY pair, seg, l, r",
        name: (f"SELECT pair, seg, max(l) AS l, n FROM {name}_x WHERE (pair, seg, n) IN (SELECT pair, seg, max(n) FROM {name}_x GROUP BY pair, seg) GROUP BY pair, seg, n "
               f"UNION ALL SELECT pair, seg, l, n FROM (SELECT b.pair, b.seg, b.l, b.n, row_number() OVER (PARTITION BY b.pair, b.seg ORDER BY b.l DESC) AS k FROM {name} a JOIN {name}_x b "
               "ON a.pair = b.pair AND a.seg = b.seg AND b.n = a.n - 1 AND b.l < a.l) WHERE k = 1")}


def _diff_oracle(table: str, key: str, order: str) -> str:
    """Two rounds of anchors, enough for these tables: lines that occur once on both sides, then the n-th of equal lines between them."""
    relations = {
        "p": f"SELECT row_number() OVER () AS pair, * FROM (SELECT {key}, {order} AS v2, \"text\" AS new, lag({order}) OVER w AS v1, lag(\"text\") OVER w AS old FROM {table} "
             f"WINDOW w AS (PARTITION BY {key} ORDER BY {order})) WHERE v1 IS NOT NULL",
        "ln": "SELECT pair, 0 AS side, unnest(string_split(old, chr(10))) AS line, generate_subscripts(string_split(old, chr(10)), 1) AS pos FROM p UNION ALL "
              "SELECT pair, 1, unnest(string_split(new, chr(10))), generate_subscripts(string_split(new, chr(10)), 1) FROM p",
        "u": "SELECT pair, 0 AS seg, min(CASE side WHEN 0 THEN pos END) AS l, min(CASE side WHEN 1 THEN pos END) AS r FROM ln GROUP BY pair, line HAVING count(*) FILTER (side = 0) = 1 AND count(*) FILTER (side = 1) = 1",
        **_increasing("u", "c1"),
        "s1": "SELECT c1.pair, c1.l, u.r FROM c1 JOIN u ON c1.pair = u.pair AND c1.l = u.l",
        "g1": "SELECT ln.*, (SELECT count(*) FROM s1 WHERE s1.pair = ln.pair AND CASE ln.side WHEN 0 THEN s1.l ELSE s1.r END < ln.pos) AS seg FROM ln "
              "WHERE NOT EXISTS (SELECT 1 FROM s1 WHERE s1.pair = ln.pair AND CASE ln.side WHEN 0 THEN s1.l ELSE s1.r END = ln.pos)",
        "o": "SELECT *, row_number() OVER (PARTITION BY pair, seg, side, line ORDER BY pos) AS k FROM g1",
        "w": "SELECT a.pair, a.seg, a.pos AS l, b.pos AS r FROM o a JOIN o b ON a.pair = b.pair AND a.seg = b.seg AND a.line = b.line AND a.k = b.k AND a.side = 0 AND b.side = 1",
        **_increasing("w", "c2"),
        "s": "SELECT * FROM s1 UNION ALL SELECT c2.pair, c2.l, w.r FROM c2 JOIN w ON c2.pair = w.pair AND c2.l = w.l",
        "d": "SELECT ln.*, (SELECT count(*) FROM s WHERE s.pair = ln.pair AND CASE ln.side WHEN 0 THEN s.l ELSE s.r END < ln.pos) AS gap FROM ln "
             "WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.pair = ln.pair AND CASE ln.side WHEN 0 THEN s.l ELSE s.r END = ln.pos)",
        # the queue: x counts the lines that wait less those that found none
        "e": "SELECT *, row_number() OVER (PARTITION BY pair, side ORDER BY pos) AS k, sum(2 * side - 1) OVER (PARTITION BY pair ORDER BY gap, side, pos) AS x, row_number() OVER (PARTITION BY pair ORDER BY gap, side, pos) AS t FROM d",
        "f": "SELECT *, coalesce(greatest(max(x) OVER (PARTITION BY pair ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS most FROM e",
        "q": "SELECT *, CASE WHEN side = 1 AND x <= most THEN k - most END AS takes FROM f",
        "tk": "SELECT pair, coalesce(max(takes), 0) AS taken, (SELECT count(*) FROM ln WHERE ln.pair = q.pair AND side = 1) AS n_right FROM q GROUP BY pair",
        "ed": "SELECT pair, r AS idx, 'same' AS status, l AS left_line, r AS right_line FROM s UNION ALL "
              "SELECT a.pair, a.pos, CASE WHEN a.takes IS NULL THEN 'add' ELSE 'change' END, b.pos, a.pos FROM q a LEFT JOIN q b ON a.pair = b.pair AND b.side = 0 AND b.k = a.takes WHERE a.side = 1 UNION ALL "
              "SELECT q.pair, n_right + k - taken, 'remove', pos, NULL FROM q JOIN tk ON q.pair = tk.pair WHERE side = 0 AND k > taken",
    }
    head = ", ".join(f"{n} AS ({body})" for n, body in relations.items())
    return (f"WITH RECURSIVE {head} SELECT {key}, v1, v2, idx, status, left_line, a.line AS left_text, right_line, b.line AS right_text FROM ed JOIN p ON ed.pair = p.pair "
            "LEFT JOIN ln a ON a.pair = ed.pair AND a.side = 0 AND a.pos = left_line LEFT JOIN ln b ON b.pair = ed.pair AND b.side = 1 AND b.pos = right_line")


@query("doc_line_diff", _diff_oracle("conversations", "conv_id", "turn"))
def doc_line_diff(src: Source):
    turns = src.table("conversations").select("conv_id", F.col("turn").alias("version"), "text")
    return documents.doc_line_diff(versions.version_pairs(turns, ["conv_id"], "text"), ["conv_id"])


# documents of a source and language follow each other like versions; they share licence lines and repeat lines
@query("doc_line_diff_documents", _diff_oracle("documents", "source, lang", "doc_id"))
def doc_line_diff_documents(src: Source):
    docs = src.table("documents").select("source", "lang", F.col("doc_id").alias("version"), "text")
    return documents.doc_line_diff(versions.version_pairs(docs, ["source", "lang"], "text"), ["source", "lang"])


@query("collapse_unchanged", oracle(
    "SELECT repo, api, idx, status, status = 'same' AND len_ - head - tail > 2 AND idx - first_ >= head AND last_ - idx >= tail AS hidden FROM ("
    "SELECT *, last_ - first_ + 1 AS len_, CASE WHEN first_ = 1 THEN 0 ELSE least(2, last_ - first_ + 1) END AS head, "
    "CASE WHEN next_mark IS NULL THEN 0 ELSE least(2, last_ - first_ + 1) END AS tail FROM ("
    "SELECT *, coalesce(prev_mark, 0) + 1 AS first_, coalesce(next_mark - 1, n) AS last_ FROM (SELECT *, "
    "max(CASE WHEN status <> 'same' THEN idx END) OVER (PARTITION BY repo, api ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_mark, "
    "min(CASE WHEN status <> 'same' THEN idx END) OVER (PARTITION BY repo, api ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_mark, "
    "count(*) OVER (PARTITION BY repo, api) AS n FROM ("
    "SELECT repo, api, row_number() OVER (PARTITION BY repo, api ORDER BY pos) AS idx, "
    "CASE WHEN signature = 'high' THEN 'same' ELSE 'change' END AS status FROM V))))"))
def collapse_unchanged(src: Source):
    rows = dense_index(relation(src, "V"), K, "pos", "idx")
    rows = rows.select(*K, "idx", F.when(F.col("signature") == "high", "same").otherwise("change").alias("status"))
    return documents.collapse_unchanged(rows, K)


@query("relative_age", oracle(
    "SELECT id, CASE WHEN s >= 604800 THEN floor(s / 604800)::BIGINT || ' week' || CASE WHEN floor(s / 604800) = 1 THEN '' ELSE 's' END || ' ago' "
    "WHEN s >= 86400 THEN floor(s / 86400)::BIGINT || ' day' || CASE WHEN floor(s / 86400) = 1 THEN '' ELSE 's' END || ' ago' "
    "WHEN s >= 3600 THEN floor(s / 3600)::BIGINT || ' hour' || CASE WHEN floor(s / 3600) = 1 THEN '' ELSE 's' END || ' ago' "
    "WHEN s >= 60 THEN floor(s / 60)::BIGINT || ' minute' || CASE WHEN floor(s / 60) = 1 THEN '' ELSE 's' END || ' ago' ELSE 'just now' END AS age, "
    "strftime(finished_at, '%Y-%m-%d %H:%M UTC') AS shown_at FROM (SELECT *, (epoch_us(now_ts) - epoch_us(finished_at)) / 1000000 AS s FROM JOBS)"))
def relative_age(src: Source):
    return relation(src, "JOBS").select("id", versions.relative_age(F.col("finished_at"), F.col("now_ts")).alias("age"),
                                        versions.absolute_time(F.col("finished_at")).alias("shown_at"))


@query("fallback_title", oracle(
    "SELECT doc_id, CASE WHEN n_chars < 500 THEN 'Summary ' || lang WHEN length(sent) BETWEEN 1 AND 60 THEN upper(substr(sent, 1, 1)) || substr(sent, 2) "
    "ELSE 'Get ' || upper(substr(source, 1, 1)) || substr(source, 2) || ' By Id (Order Item)' END AS title FROM ("
    "SELECT *, regexp_replace(split_part(regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '([.!?])\\s', '\\1' || chr(1)), chr(1), 1), '[.!? ]+$', '') AS sent FROM documents)"))
def fallback_title(src: Source):
    d = src.table("documents")
    summary = F.when(F.col("n_chars") < 500, F.concat(F.lit(" Summary "), "lang", F.lit(" "))).otherwise("")
    name = F.concat(F.lit("get_"), "source", F.lit("ById"))
    return d.select("doc_id", documents.fallback_title(summary, F.col("text"), name, F.lit("OrderItemRestController.find")).alias("title"))


@query("clean_title", oracle(
    "SELECT doc_id, CASE WHEN length(t) BETWEEN 1 AND 80 AND NOT contains(t, '/') AND NOT contains(t, '{') THEN t ELSE 'none' END AS title FROM ("
    "SELECT doc_id, trim(regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '^[\"''`*#.]+|[\"''`*#.]+$', '', 'g')) AS t FROM documents)"))
def clean_title(src: Source):
    return src.table("documents").select("doc_id", F.coalesce(documents.clean_title(F.col("text")), F.lit("none")).alias("title"))


@query("render_docs", oracle(
    "SELECT event_id, '# ' || event_type || ' call' || chr(10) || chr(10) || '## Overview' || chr(10) || 'No overview available.' || chr(10) || chr(10) || chr(10) || "
    "'## Endpoint' || chr(10) || '- **API id:** `' || event_type || '.run`' || chr(10) || '- **Method:** GET' || chr(10) || '- **Path:** `/u/' || user_id || '`' || chr(10) || "
    "'- **Handler:** `' || event_type || '.run`' || chr(10) || chr(10) || chr(10) || "
    "'## Request' || chr(10) || '### k (' || json_extract_string(props, '$.k') || ')' || chr(10) || chr(10) || chr(10) || "
    "'## Response' || chr(10) || '- **Description:** Returns result of operation' || chr(10) || chr(10) || chr(10) || "
    "CASE WHEN event_type = 'error' THEN '## Errors' || chr(10) || chr(10) || '| Code | Field | Rule |' || chr(10) || '|------|------|------|' || chr(10) || '| 500 | - | - |' || chr(10) || chr(10) || chr(10) ELSE '' END || "
    "'## Process Flow' || chr(10) || '1. Invoke load' || chr(10) || '2. Invoke ' || event_type || chr(10) || chr(10) || chr(10) || "
    "'## Business Logic' || chr(10) || 'No details available.' || chr(10) || chr(10) || chr(10) || '## Change Impact' || chr(10) || 'No impact details available.' || chr(10) || chr(10) AS content FROM events"))
def render_docs(src: Source):
    e = src.table("events")
    params = F.transform(F.map_entries(F.from_json("props", "map<string,string>")),
                         lambda p: F.struct(p["key"].alias("name"), p["value"].alias("type")))
    routes = e.select(
        "event_id", F.concat("event_type", F.lit(" call")).alias("title"), F.lit("GET").alias("method"),
        F.concat(F.lit("/u/"), "user_id").alias("path"), F.concat("event_type", F.lit(".run")).alias("handler"), params.alias("params"),
        F.when(F.col("event_type") == "error", F.array(F.lit("500"))).otherwise(F.array().cast("array<string>")).alias("errors"),
        F.array(F.lit("load"), F.col("event_type")).alias("calls"))
    return documents.render_docs(routes, ["event_id"])
