"""Endpoint tokens in documentation, document relations and API search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import any_of
from ..session import cut_lineage
from .ordered import CHUNK, previous_values
from .verdict import smallest_of_distinct, smallest_per_group

# What counts as an endpoint token in a document.
PATH_TOKEN = r"/[a-zA-Z0-9/_\-{}]+"
VERB_TOKEN = "GET|POST|PUT|DELETE|PATCH"

# Keyword groups that make two API names related.
NAME_RELATIONS = (
    ("user", ("profile", "auth", "account", "permission")),
    ("order", ("payment", "shipping", "inventory", "product")),
    ("product", ("inventory", "catalog", "pricing", "category")),
    ("auth", ("user", "permission", "token", "session")),
)

# Scoring of search words.
STOP_WORDS = ("how", "to", "get", "all", "and", "or", "the", "a", "an")
SYNONYMS = (
    ("get", ("fetch", "retrieve", "query", "list")),
    ("create", ("add", "new", "insert", "post")),
    ("update", ("modify", "edit", "put", "patch")),
    ("delete", ("remove", "destroy", "drop")),
    ("branches", ("branch", "branchdetails")),
    ("users", ("user",)),
    ("api", ("endpoint", "service")),
)
MIN_CONFIDENCE = 0.3

# Advice per impact level of a document change.
LEVEL_ADVICE = {
    "high": ("🚨 HIGH IMPACT: Schedule migration meetings with dependent teams",
             "📋 Create detailed migration guide for clients",
             "⏱️  Plan extended deprecation period (90+ days)"),
    "medium": ("⚠️  MEDIUM IMPACT: Notify affected teams about changes",
               "📝 Update documentation with migration path",
               "🔔 Send deprecation notices to API consumers"),
    "low": ("ℹ️  LOW IMPACT: Changes are minor", "✅ Update changelog and release notes"),
}
REMOVED_ADVICE = "🛠️  Plan backward compatibility layer or version strategy"


def endpoint_tokens(text: Column) -> Column:
    """Distinct path and verb tokens of a whole text."""
    return F.array_union(F.regexp_extract_all(text, F.lit(PATH_TOKEN), F.lit(0)), F.regexp_extract_all(text, F.lit(VERB_TOKEN), F.lit(0)))


def extract_endpoints(docs: DataFrame, keys: Sequence[str], text: str = "content") -> DataFrame:
    return docs.select(*keys, F.explode(endpoint_tokens(F.col(text))).alias("token"))


def token_delta(docs: DataFrame, keys: Sequence[str], pos: str, text: str = "content", size: int = CHUNK) -> DataFrame:
    """Endpoint tokens added and removed against the document before, with impact level.

    Tokens are extracted before the ordering step, so the texts themselves are not shuffled.
    """
    tokens = docs.select(*keys, pos, endpoint_tokens(F.col(text)).alias("tokens"))
    rows = previous_values(tokens, keys, pos, ["tokens"], size).where("previous IS NOT NULL")
    before = F.col("previous.tokens")
    added, removed = F.array_except("tokens", before), F.array_except(before, F.col("tokens"))
    return rows.select(
        *keys, pos, added.alias("added"), removed.alias("removed"), (F.size(removed) > 0).alias("migration_required"),
        doc_impact_level(F.size(removed), F.size(before)).alias("impact_level"))


def affected_resources(delta: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Last path part of each removed token; tokens ending in a slash name no resource."""
    rows = delta.select(*keys, F.explode("removed").alias("endpoint"))
    return rows.withColumn("resource", F.substring_index("endpoint", "/", -1)).where("resource <> ''")


def doc_impact_level(removed: Column, total: Column) -> Column:
    ratio = removed / total
    return (F.when((total == 0) | (removed == 0), "none").when(ratio < 0.2, "low").when(ratio < 0.5, "medium").otherwise("high"))


# ---------------------------------------------------------------- document relations

def token_links(tokens: DataFrame, keys: Sequence[str], scope: Sequence[str] = ()) -> DataFrame:
    """Documents tied through a shared token: (scope, token, document, members).

    Two documents are related exactly when they hang on the same token, so the star form says
    the same as the list of all pairs, yet grows with the tokens instead of their square.
    """
    distinct = tokens.select(*scope, *keys, "token").distinct()
    members = distinct.groupBy(*scope, "token").agg(F.count("*").alias("members")).where("members > 1")
    return distinct.join(members, [*scope, "token"])


# a token of more documents than this is met through classes of documents, and as many are listed at a time
HUB = 1000


def related_documents(tokens: DataFrame, targets: DataFrame, key: str, scope: Sequence[str] = (), shown: int = 3, hub: int = HUB) -> DataFrame:
    """Neighbours of the target documents with up to three shared tokens: target, neighbour, tokens.

    Whole and exact, though pairs are not shuffled for every token they share. Documents with the same frequent tokens (more than `hub` documents) are one class; what two classes
    share is worked out once. Pairs that share a rarer token too are listed by it and merged with what their classes share; the others come from lists of a class's
    documents, of at most about `hub` each, without those pairs.
    """
    scope = list(scope)
    rows = tokens.where(F.col(key).isNotNull()).select(*scope, key, "token").distinct()
    counts = rows.groupBy(*scope, "token").agg(F.count("*").alias("_n"))
    rows = cut_lineage(rows.join(counts, [*scope, "token"]).select(*scope, key, "token", (F.col("_n") > hub).alias("_hub")))
    sets = rows.where("_hub").groupBy(*scope, key).agg(F.array_sort(F.collect_list("token")).alias("_set")).withColumn("_class", F.md5(F.to_json("_set")))
    sets = cut_lineage(sets)
    wanted = targets.select(*scope, F.col(key).alias("target")).distinct()
    asked = cut_lineage(wanted.join(sets.select(*scope, F.col(key).alias("target"), "_class"), [*scope, "target"], "left"))
    classes = sets.groupBy(*scope, "_class").agg(F.first("_set").alias("_set"), F.count("*").alias("_n"))
    members = classes.select(*scope, "_class", F.explode("_set").alias("token"))
    mine = members.join(asked.select(*scope, "_class").distinct(), [*scope, "_class"], "left_semi")
    both = members.withColumnRenamed("_class", "_other").join(mine, [*scope, "token"])
    common = cut_lineage(smallest_per_group(both, [*scope, "_class", "_other"], "token", shown))
    # pairs by rarer tokens
    rare = rows.where("NOT _hub").select(*scope, F.col(key).alias("neighbour"), "token")
    near = rare.join(wanted.join(rare.withColumnRenamed("neighbour", "target"), [*scope, "target"]), [*scope, "token"]).where("neighbour <> target")
    # a document has few tokens, so the list of a pair is short
    near = near.groupBy(*scope, "target", "neighbour").agg(F.collect_list("token").alias("_rare"))
    parted = cut_lineage(sets.join(classes.select(*scope, "_class", "_n"), [*scope, "_class"]).select(
        *scope, F.col(key).alias("neighbour"), F.col("_class").alias("_other"), F.pmod(F.xxhash64(key), F.ceil(F.col("_n") / hub)).alias("_part")))
    near = cut_lineage(near.join(asked, [*scope, "target"], "left").join(parted, [*scope, "neighbour"], "left").join(common, [*scope, "_class", "_other"], "left"))
    merged = F.slice(F.array_sort(F.array_union("_rare", F.coalesce("token", F.array().cast("array<string>")))), 1, shown)
    listed = near.select(*scope, "target", "neighbour", merged.alias("token"))
    # all others: lists of a class without the target and the pairs above
    gone = near.where("_part IS NOT NULL").groupBy(*scope, "target", "_other", "_part").agg(F.collect_list("neighbour").alias("_gone"))
    lists = cut_lineage(parted.groupBy(*scope, "_other", "_part").agg(F.collect_list("neighbour").alias("_ids")))
    # the parts of a class are counted off in its row: one large class met by key would bring all targets with all its parts into one task
    size = classes.select(*scope, F.col("_class").alias("_other"), F.col("_n").alias("_size"))
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("_size") / hub) - 1)).alias("_part")
    met = asked.join(common.join(size, [*scope, "_other"]), [*scope, "_class"]).select(*scope, "target", "token", "_other", parts).join(gone, [*scope, "target", "_other", "_part"], "left")
    rest = met.select(*scope, "target", "token", "_other", "_part", "_gone").join(lists.hint("merge"), [*scope, "_other", "_part"])
    left = F.array_except("_ids", F.array_append(F.coalesce("_gone", F.slice("_ids", 1, 0)), F.col("target")))
    return listed.unionByName(rest.select(*scope, "target", F.explode(left).alias("neighbour"), "token"))


def name_relation(a: Column, b: Column) -> Column:
    """Names that hold a keyword and a word related to it, either way round."""
    x, y = F.lower(a), F.lower(b)
    out = F.lit(False)
    for key, related in NAME_RELATIONS:
        out = out | (x.contains(key) & any_of(y, related)) | (y.contains(key) & any_of(x, related))
    return out


def name_relation_links(apis: DataFrame, name: str, keys: Sequence[str], relations=NAME_RELATIONS, scope: Sequence[str] = ()) -> DataFrame:
    """Name relations in star form: each API hangs on a relation as `holder` or as `related`.

    Every holder is related to every related API of the same relation; a relation with only
    one side is left out.
    """
    lower = F.lower(F.col(name))
    sides = []
    for key, related in relations:
        sides.append(F.when(lower.contains(key), F.struct(F.lit(key).alias("relation"), F.lit("holder").alias("side"))))
        sides.append(F.when(any_of(lower, related), F.struct(F.lit(key).alias("relation"), F.lit("related").alias("side"))))
    rows = apis.select(*scope, *keys, F.explode(F.filter(F.array(*sides), lambda s: s.isNotNull())).alias("s")).select(*scope, *keys, "s.*")
    live = (rows.groupBy(*scope, "relation")
            .agg(F.bool_or(F.col("side") == "holder").alias("h"), F.bool_or(F.col("side") == "related").alias("r")).where("h AND r"))
    return rows.join(live.select(*scope, "relation"), [*scope, "relation"], "left_semi")


def document_stars(docs: DataFrame, key: str, text: str, name: str, relations=NAME_RELATIONS, scope: Sequence[str] = ()) -> DataFrame:
    """The document graph in star form: (scope, hub, side, document, members).

    Documents that share an endpoint token hang on it with side `shared`. A name relation has the sides `holder` and `related`; its links run from every holder
    to every related document, `members` counts those on the other side.
    """
    tokens = token_links(extract_endpoints(docs, [*scope, key], text), [key], scope)
    shared = tokens.select(*scope, F.col("token").alias("hub"), F.lit("shared").alias("side"), key, "members")
    names = name_relation_links(docs, name, [key], relations, scope)
    other = F.when(F.col("side") == "holder", "related").otherwise("holder")
    counts = names.select(*scope, "relation", other.alias("side")).groupBy(*scope, "relation", "side").agg(F.count("*").alias("members"))
    related = names.join(counts, [*scope, "relation", "side"]).select(*scope, F.col("relation").alias("hub"), "side", key, "members")
    return shared.unionByName(related)


def neighbour_counts(stars: DataFrame, key: str, scope: Sequence[str] = (), shown: int = 3) -> DataFrame:
    """(scope, document, affected, names): how many different documents each document is linked with, and the first of them by name.

    Exact, without listing pairs of documents. Documents with the same hubs are one class. A class counts the members of its largest hub at once; what its other
    hubs add are classes outside that hub, which are looked up once for each (largest hub, other hub) that occurs. Hubs that lie within a larger one add nothing.
    """
    scope = list(scope)
    opposite = F.when(F.col("side") == "holder", "related").when(F.col("side") == "related", "holder").otherwise(F.col("side"))
    rows = stars.select(*scope, key, F.concat_ws(":", "side", "hub").alias("own"), F.concat_ws(":", opposite, "hub").alias("near"))
    sets = (rows.groupBy(*scope, key).agg(F.array_sort(F.collect_set("own")).alias("own"), F.array_sort(F.collect_set("near")).alias("near"))
            .withColumn("class", F.md5(F.concat_ws("\u0001", "own", F.lit("\u0002"), "near"))))
    sets = cut_lineage(sets)
    sizes = sets.groupBy(*scope, "class").agg(F.count("*").alias("n"), F.min(key).alias(key))
    classes = cut_lineage(sizes.join(sets, [*scope, "class", key]).dropDuplicates([*scope, "class"]).select(*scope, "class", "n", "own", "near"))
    members = classes.select(*scope, F.explode("own").alias("hub"), "class", "n")
    asked = classes.select(*scope, "class", F.explode("near").alias("hub")).join(members.groupBy(*scope, "hub").agg(F.sum("n").alias("weight")), [*scope, "hub"])
    largest = asked.groupBy(*scope, "class").agg(F.max_by("hub", F.struct("weight", "hub")).alias("top"), F.max("weight").alias("weight"))
    asked = cut_lineage(asked.drop("weight").join(largest, [*scope, "class"]))
    others = asked.where("hub <> top").select(*scope, "class", "top", "hub")
    outside = (others.select(*scope, "top", "hub").distinct().join(members.withColumnRenamed("class", "other"), [*scope, "hub"])
               .join(members.select(*scope, F.col("hub").alias("top"), F.col("class").alias("other")), [*scope, "top", "other"], "left_anti"))
    more = others.join(outside, [*scope, "top", "hub"]).select(*scope, "class", "other", "n").distinct().groupBy(*scope, "class").agg(F.sum("n").alias("more"))
    # the first neighbours lie among the first members of the hubs, one more as the document itself may be among them
    first = smallest_of_distinct(sets.select(*scope, F.explode("own").alias("hub"), F.col(key).cast("string").alias("names")), [*scope, "hub"], "names", shown + 1)
    names = smallest_per_group(asked.join(first, [*scope, "hub"]).select(*scope, "class", F.explode("names").alias("names")), [*scope, "class"], "names", shown + 1)
    found = largest.drop("top").join(more, [*scope, "class"], "left").join(names, [*scope, "class"], "left")
    itself = F.arrays_overlap("own", "near").cast("long")
    return (sets.join(found, [*scope, "class"])
            .select(*scope, key, (F.col("weight") + F.coalesce("more", F.lit(0)) - itself).alias("affected"),
                    F.slice(F.array_except(F.coalesce("names", F.array().cast("array<string>")), F.array(F.col(key).cast("string"))), 1, shown).alias("names")))


def doc_recommendations(level: Column, affected: Column, names: Column, removed: Column) -> Column:
    advice = F.array().cast("array<string>")
    for name, lines in LEVEL_ADVICE.items():
        advice = F.when(level == name, F.array(*[F.lit(x) for x in lines])).otherwise(advice)
    related = F.when(affected > 0, F.array(F.concat(
        F.lit("🔗 "), affected.cast("string"), F.lit(" related APIs may be affected: "), F.array_join(names, ", "))))
    gone = F.when(removed > 0, F.array(F.lit(REMOVED_ADVICE)))
    none = F.array().cast("array<string>")
    return F.concat(advice, F.coalesce(related, none), F.coalesce(gone, none))


# ---------------------------------------------------------------- search

def search_score(query: str, name: Column, repo: Column) -> Column:
    """Match of one query against a lower-case API text: 0 to 1, as one codegen expression."""
    q = " ".join(query.lower().split()) if query.strip() else query.lower()
    words = q.split()
    name = F.lower(name)
    repo = F.lower(F.coalesce(repo, F.lit("")))
    has = lambda w: name.contains(w)
    # literals on purpose: the words of the query are constants of the plan
    hits = sum((F.when(has(w), 1).otherwise(0) for w in words), F.lit(0))
    scores = [F.when(name.contains(q) | F.lit(q).contains(name), 0.8).otherwise(0.0), F.least(F.lit(0.6), hits * F.lit(0.15))]
    scores += [F.when(has(w), 0.7).otherwise(0.0) for w in words if len(w) >= 4 and w not in STOP_WORDS]
    synonyms = dict(SYNONYMS)
    scores += [F.when(has(s), 0.65).otherwise(0.0) for w in words for s in synonyms.get(w, ())]
    best = F.greatest(*scores)
    foreign = (repo != "") & ~F.lit(q).contains(repo) & ~repo.contains(q)
    return F.when(name == q, 1.0).otherwise(F.least(F.lit(1.0), F.when(foreign, best * F.lit(0.9)).otherwise(best)))


def api_text(api: Column, title: Column) -> Column:
    return F.concat(F.coalesce(api, F.lit("")), F.lit(" "), F.coalesce(title, F.lit("")))


def score_queries(apis: DataFrame, queries: Sequence[str], api: str = "api", title: str = "title", repo: str = "repo") -> DataFrame:
    """Score of every API for every query of a short list: no join, one pass over the APIs."""
    text = api_text(F.col(api), F.col(title))
    scored = [F.struct(F.lit(q).alias("query"), search_score(q, text, F.col(repo)).alias("score")) for q in queries]
    return apis.withColumn("_s", F.explode(F.array(*scored))).select(*apis.columns, "_s.*")


# characters that a term and the texts that hold it meet by
GRAM = 3


def _grams(text: Column) -> Column:
    """Distinct substrings of up to `GRAM` characters."""
    at = F.sequence(F.lit(1), F.greatest(F.char_length(text), F.lit(1)))
    return F.array_distinct(F.flatten(F.array(*[F.transform(at, lambda i: F.substr(text, i, F.lit(n))) for n in range(1, GRAM + 1)])))


def _terms(asked: DataFrame) -> DataFrame:
    """(_q, term, kind, times): the words of each distinct query, the synonyms of its words, and the whole query; `times` counts a repeated word."""
    words = asked.select("_q", F.explode(F.split("_q", " ")).alias("term")).groupBy("_q", "term").agg(F.count("*").alias("times"))
    pairs = F.create_map(*[x for w, others in SYNONYMS for x in (F.lit(w), F.array(*[F.lit(o) for o in others]))])
    synonyms = words.select("_q", F.explode(pairs[F.col("term")]).alias("term")).distinct()
    never = F.lit(0).cast("long").alias("times")
    return (words.select("_q", "term", F.lit("word").alias("kind"), "times").unionByName(synonyms.select("_q", "term", F.lit("synonym").alias("kind"), never))
            .unionByName(asked.select("_q", F.col("_q").alias("term"), F.lit("query").alias("kind"), never)))


def keyword_search(apis: DataFrame, queries: DataFrame, key: str = "query_id", query: str = "query", api: str = "api", title: str = "title", repo: str = "repo",
                   top: int | None = None) -> DataFrame:
    """(key, columns of apis, score) of the APIs with a query word in name, title or repository and enough confidence, for a table of queries (key, query).

    Scores are those of `search_score`. An index of the short substrings of the distinct texts meets the distinct terms of all queries by their first characters; only texts
    that share them are looked at. Distinct texts are scored for distinct queries; each found pair then meets the APIs and the keys behind it in the last join, which makes
    the rows of the result and nothing else. With `top`, only each query's best APIs, ties by name. Queries without words find nothing.
    """
    plain = F.array_join(F.filter(F.split(F.lower(query), r"\s+"), lambda w: w != ""), " ")
    asked = cut_lineage(queries.select(key, plain.alias("_q")).where("_q <> ''").distinct())
    terms = cut_lineage(_terms(asked.select("_q").distinct()))
    text = F.lower(api_text(F.col(api), F.col(title)))
    texts = cut_lineage(apis.withColumns({"_id": F.monotonically_increasing_id(), "_text": text, "_repo": F.lower(F.coalesce(repo, F.lit("")))}))
    kinds = cut_lineage(texts.groupBy("_text", "_repo").agg(F.min("_id").alias("_class")))
    names = kinds.select("_text").distinct()
    index = names.select("_text", F.explode(_grams(F.col("_text"))).alias("_gram"))
    wanted = terms.select("term").distinct().withColumn("_gram", F.left("term", F.lit(GRAM)))
    held = index.join(wanted, "_gram").where(F.contains("_text", "term")).select("_text", "term")
    found = held.join(terms, "term").select("_q", "_text", "kind", "term", "times")
    # the other way round: a query that holds the whole text
    whole = terms.where("kind = 'query'").select("_q", F.explode(_grams(F.col("_q"))).alias("_gram"))
    within = (names.where("_text <> ''").select("_text", F.left("_text", F.lit(GRAM)).alias("_gram")).join(whole, "_gram").where(F.contains("_q", "_text"))
              .select("_q", "_text", F.lit("query").alias("kind"), F.col("_q").alias("term"), F.lit(0).cast("long").alias("times")))
    weight = (F.when(F.col("kind") == "query", 0.8).when(F.col("kind") == "synonym", 0.65)
              .when((F.char_length("term") >= 4) & ~F.col("term").isin(*STOP_WORDS), 0.7).otherwise(0.0))
    sums = found.unionByName(within).groupBy("_q", "_text").agg(F.max(weight).alias("_best"), F.sum("times").alias("_hits"))
    q, own = F.col("_q"), F.col("_repo")
    best = F.greatest("_best", F.least(F.lit(0.6), F.col("_hits") * F.lit(0.15)))
    foreign = (own != "") & ~F.contains(q, own) & ~F.contains(own, q)
    score = F.when(F.col("_text") == q, 1.0).otherwise(F.least(F.lit(1.0), F.when(foreign, best * F.lit(0.9)).otherwise(best)))
    keyword = (F.col("_hits") > 0) | F.exists(F.split("_q", " "), lambda w: F.contains(own, w))
    scored = sums.join(kinds, "_text").withColumn("score", score).where(keyword & (F.col("score") >= MIN_CONFIDENCE)).select("_q", "_class", "score")
    members = texts.join(kinds, ["_text", "_repo"]).select("_class", "_id", "_text", *apis.columns)
    rows = scored.join(asked, "_q").select(key, "_class", "score").join(members.hint("merge"), "_class")
    if top is not None:
        rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col("score").desc(), "_text", "_id"))
        rows = rows.withColumn("_rank", rank).where(F.col("_rank") <= top)
    return rows.select(key, *apis.columns, "score")


# ---------------------------------------------------------------- decorators

# The route decorator and the function under it.
ROUTE_DECORATOR = r'@(app|router)\.(get|post|put|delete)\("(.*?)"\)'
FUNCTION_NAME = r"def\s+(\w+)\("


def extract_route_decorators(texts: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """First decorated route and first function name of a text; texts without both give no row."""
    found = texts.where(F.col(text).rlike(ROUTE_DECORATOR) & F.col(text).rlike(FUNCTION_NAME))
    name = F.regexp_extract(text, FUNCTION_NAME, 1)
    return found.select(*keys, F.upper(F.regexp_extract(text, ROUTE_DECORATOR, 2)).alias("method"),
                        F.regexp_extract(text, ROUTE_DECORATOR, 3).alias("path"), name.alias("function_name"), name.alias("api_id"))
