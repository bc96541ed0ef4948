"""Append-only contract versions: detection of new versions and the reads over them.

The version table has keys (repo, api), version, signature, commit_id, ts and open columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import keep_first_per_key, non_empty
from .ordered import CHUNK, attach, in_chunk, over_chunks, previous_values, with_chunk

KEYS = ("repo", "api")



def micros(ts: Column) -> Column:
    """Microseconds since the epoch; stamps without a zone mean UTC."""
    return F.unix_micros(ts.cast("timestamp"))


# ---------------------------------------------------------------- detection

def classify_uploads(uploads: DataFrame, existing: DataFrame | None = None, keys: Sequence[str] = KEYS,
                     pos: str = "pos", size: int = CHUNK) -> DataFrame:
    """Every upload with `created` and the version number current after it.

    An upload makes a version when its signature differs from the one before it of the same
    key; the first is compared with the latest stored version. A running count over a hot key
    is split into chunks of arrival numbers.
    """
    w = in_chunk(keys, pos)
    rows = (with_chunk(uploads, pos, size)
            .withColumn("_rn", F.row_number().over(w))
            .withColumn("_lag", F.lag("signature").over(w)))
    inner = F.when((F.col("_rn") > 1) & ~F.col("signature").eqNullSafe(F.col("_lag")), 1).otherwise(0)
    rows = rows.withColumn("_inner", inner).withColumn("_run", F.sum("_inner").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    chunks = rows.groupBy(*keys, "_chunk").agg(
        F.min_by("signature", pos).alias("_first"), F.max_by("signature", pos).alias("_last"), F.sum("_inner").alias("_changes"))
    if existing is None:
        stored = chunks.withColumn("_stored", F.lit(None).cast("string")).withColumn("_base", F.lit(0).cast("long"))
    else:
        # only the history of uploaded keys is aggregated
        uploaded = existing.join(uploads.select(*keys).distinct(), list(keys), "left_semi")
        seed = latest_of(uploaded, keys, ["signature"]).select(
            *keys, F.col("signature").alias("_stored"), F.col("version").cast("long").alias("_base"))
        stored = chunks.join(seed, list(keys), "left").withColumn("_base", F.coalesce("_base", F.lit(0)))
    o = over_chunks(keys)
    edges = (stored
             .withColumn("_n", F.row_number().over(o))
             .withColumn("_before_sig", F.when(F.col("_n") == 1, F.col("_stored")).otherwise(F.lag("_last").over(o)))
             .withColumn("_has_before", (F.col("_n") > 1) | (F.col("_base") > 0))
             .withColumn("_edge", F.when(F.col("_has_before") & F.col("_first").eqNullSafe(F.col("_before_sig")), 0).otherwise(1))
             .withColumn("_prior", F.col("_base") + F.coalesce(
                 F.sum(F.col("_changes") + F.col("_edge")).over(o.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    out = attach(rows, edges, keys, ["_edge", "_prior"])
    created = F.when(F.col("_rn") == 1, F.col("_edge") == 1).otherwise(F.col("_inner") == 1)
    return (out.withColumn("created", created)
            .withColumn("version", (F.col("_prior") + F.col("_edge") + F.col("_run")).cast("long"))
            .drop("_chunk", "_rn", "_lag", "_inner", "_run", "_edge", "_prior"))


def append_if_changed(uploads: DataFrame, existing: DataFrame | None = None, keys: Sequence[str] = KEYS,
                      pos: str = "pos", size: int = CHUNK) -> DataFrame:
    """Only the uploads that become new versions, numbered on from the stored ones."""
    return classify_uploads(uploads, existing, keys, pos, size).where("created").drop("created")


def upload_counts(classified: DataFrame) -> DataFrame:
    """created / unchanged totals of classified uploads."""
    return classified.agg(F.count_if("created").alias("created"), F.count_if(~F.col("created")).alias("unchanged"))


# ---------------------------------------------------------------- latest rows

def latest_of(versions: DataFrame, keys: Sequence[str] = KEYS, values: Sequence[str] = ("signature",)) -> DataFrame:
    """Highest version per key with the given values and the number of versions, in one combined aggregate."""
    row = F.max_by(F.struct(*values), F.col("version")).alias("_row")
    return (versions.groupBy(*keys).agg(F.max("version").alias("version"), F.count("*").alias("versions"), row)
            .select(*keys, "version", "versions", *[F.col(f"_row.{v}").alias(v) for v in values]))


def latest_signature(versions: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return latest_of(versions, keys).select(*keys, "signature")


def latest_versions(versions: DataFrame, keys: Sequence[str] = KEYS, values: Sequence[str] = ("signature", "commit_id", "ts")) -> DataFrame:
    return latest_of(versions, keys, values)


def latest_docs(versions: DataFrame, titles: DataFrame, keys: Sequence[str] = KEYS, content: str = "content") -> DataFrame:
    """Latest content of every API with its display title (the API name when there is none).

    The wide content is only read for rows that survive the semi join on (key, version).
    """
    top = versions.groupBy(*keys).agg(F.max("version").alias("version"))
    docs = versions.select(*keys, "version", content).join(top, [*keys, "version"], "left_semi")
    named = docs.join(titles.select(*keys, "title"), list(keys), "left")
    return named.select(*keys, "version", F.coalesce(non_empty("title"), F.col(keys[-1])).alias("title"), content)


def version_at(versions: DataFrame, version: int | None = None, keys: Sequence[str] = KEYS,
               values: Sequence[str] = ("signature", "commit_id")) -> DataFrame:
    """The row of one version number, or of the latest when none is given."""
    if version is not None:
        return versions.where(F.col("version") == version).select(*keys, "version", *values)
    return latest_of(versions, keys, values).drop("versions")


def version_rows(versions: DataFrame, keys: Sequence[str] = KEYS, size: int = 10_000) -> DataFrame:
    """Each version with the one before it and a latest flag."""
    rows = previous_values(versions, keys, "version", ["version"], size)
    top = versions.groupBy(*keys).agg(F.max("version").alias("_top"))
    return (rows.join(top, list(keys))
            .withColumn("previous", F.col("previous.version"))
            .withColumn("is_latest", F.col("version") == F.col("_top")).drop("_top"))


def default_version_pair(versions: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Latest version and the one before it. Rank limits cut hot keys before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.col("version").desc())
    top = versions.select(*keys, "version").withColumn("_rn", F.row_number().over(w)).where("_rn <= 2")
    return top.groupBy(*keys).agg(F.max(F.when(F.col("_rn") == 2, F.col("version"))).alias("v1"),
                                  F.max(F.when(F.col("_rn") == 1, F.col("version"))).alias("v2"))


def version_pairs(versions: DataFrame, keys: Sequence[str] = KEYS, content: str = "content", size: int = 10_000) -> DataFrame:
    """Consecutive versions side by side: v1, v2, old and new content."""
    rows = previous_values(versions, keys, "version", ["version", content], size).where("previous IS NOT NULL")
    return rows.select(*keys, F.col("previous.version").alias("v1"), F.col("version").alias("v2"),
                       F.col(f"previous.{content}").alias("old"), F.col(content).alias("new"))


# ---------------------------------------------------------------- catalog and summaries

def group_of(controller: Column, handler: Column) -> Column:
    """Group label: last part of the controller, else the handler before its first dot, else APIs."""
    c, h = non_empty(controller), F.coalesce(handler, F.lit(""))
    return (F.when(c.isNotNull(), F.substring_index(c, ".", -1))
            .when(h.contains("."), F.substring_index(h, ".", 1)).otherwise("APIs"))


def api_catalog(versions: DataFrame, titles: DataFrame, keys: Sequence[str] = KEYS,
                values: Sequence[str] = ("commit_id", "ts", "controller", "handler")) -> DataFrame:
    """Latest version of every API with title and group, sorted by group and title."""
    named = latest_of(versions, keys, values).join(titles.select(*keys, "title"), list(keys), "left")
    out = (named.withColumn("title", F.coalesce(non_empty("title"), F.col(keys[-1])))
           .withColumn("group_label", group_of(F.col("controller"), F.col("handler"))))
    return out.orderBy(F.lower("group_label"), F.lower("title"))


def all_apis(versions: DataFrame, titles: DataFrame, keys: Sequence[str] = KEYS, **kw) -> DataFrame:
    """The catalog of every repository, sorted by repository, group and title."""
    return api_catalog(versions, titles, keys, **kw).orderBy(F.lower(keys[0]), F.lower("group_label"), F.lower("title"))


# Technology categories shown in a repository summary, in this order.
SUMMARY_CATEGORIES = ("web", "database", "cache", "messaging", "http-client", "security", "service-discovery")


def summary_technologies(technologies: Column) -> Column:
    """First eight technologies of a category -> names map, categories in their fixed order."""
    empty = F.array().cast("array<string>")
    lists = [F.coalesce(F.try_element_at(technologies, F.lit(c)), empty) for c in SUMMARY_CATEGORIES]
    return F.slice(F.concat(*lists), 1, 8)


def repo_summary(versions: DataFrame, architectures: DataFrame | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per repository: APIs, versions, changed APIs, last update, and its newest architecture facts."""
    repo = keys[0]
    per_api = latest_of(versions, keys, ["ts"])
    out = per_api.groupBy(repo).agg(
        F.count("*").alias("api_count"), F.sum("versions").alias("version_count"),
        F.count_if(F.col("versions") > 1).alias("changed_apis"), F.max("ts").alias("updated"))
    if architectures is None:
        return out
    return out.join(architectures, repo, "left").withColumn("has_architecture", F.col("architecture").isNotNull())


def recent_changes(versions: DataFrame, keys: Sequence[str] = KEYS, limit: int = 8) -> DataFrame:
    """The newest latest versions over all repositories (a top-k report)."""
    previous = F.when(F.col("version") > 1, F.col("version") - 1)
    return (latest_of(versions, keys, ["ts"]).withColumn("previous", previous)
            .orderBy(F.col("ts").desc(), *keys).limit(limit))


def fleet_totals(summary: DataFrame) -> DataFrame:
    return summary.where("api_count > 0").agg(
        F.count("*").alias("repos"), F.sum("api_count").alias("apis"), F.sum("version_count").alias("versions"),
        F.count_if("has_architecture").alias("architectures"))


def stable_title(stored: DataFrame, proposed: DataFrame, keys: Sequence[str] = KEYS, trusted: str = "llm") -> DataFrame:
    """Title to show: a stored one stays unless it was a fallback and the new one is trusted."""
    s = stored.select(*keys, F.col("title").alias("_t"), F.col("source").alias("_s"))
    p = proposed.select(*keys, F.col("title").alias("_pt"), F.coalesce("source", F.lit("fallback")).alias("_ps"))
    both = s.join(p, list(keys), "full")
    keep = non_empty("_t").isNotNull() & ((F.col("_s") == trusted) | F.col("_ps").isNull() | (F.col("_ps") != trusted))
    return both.select(
        *keys,
        F.when(keep, F.col("_t")).otherwise(F.coalesce(non_empty("_pt"), F.col(keys[-1]))).alias("title"),
        F.when(keep, F.col("_s")).otherwise(F.col("_ps")).alias("source"))


def qa_plan_index(plans: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Generation time and template flag of the stored plan of each version."""
    return plans.select(*keys, "version", "generated_at", F.coalesce("is_template", F.lit(False)).alias("is_template"))


# ---------------------------------------------------------------- uploads

def payload_key(kind: Column, payload: Column) -> Column:
    """SHA-256 of kind and payload with sorted keys; equal payloads give equal keys."""
    fields = F.from_json(payload, "map<string,string>")
    return F.sha2(F.concat(kind, F.lit("|"), F.to_json(F.map_from_entries(F.array_sort(F.map_entries(fields))))), 256)


def dedupe_uploads(uploads: DataFrame, active: Sequence[str] = ("queued", "running")) -> DataFrame:
    """Of identical payloads that are still active only the first one stays; finished ones all stay."""
    keyed = uploads.withColumn("payload_hash", payload_key(F.col("kind"), F.col("payload")))
    is_active = F.col("status").isin(*active)
    first = keep_first_per_key(keyed.where(is_active), ["payload_hash"], ["id"])
    return keyed.where(~is_active).unionByName(first)


def job_view(jobs: DataFrame) -> DataFrame:
    """Label, percentage, first error line and short commit of upload jobs."""
    label = (F.when(F.col("status") == "running", "Documenting")
             .when((F.col("status") == "queued") & (F.coalesce("attempts", F.lit(0)) > 0), "Retrying soon")
             .when(F.col("status") == "queued", "Queued").when(F.col("status") == "failed", "Failed").otherwise("Done"))
    done, total = F.coalesce("progress_done", F.lit(0)), F.coalesce("progress_total", F.lit(0))
    percent = F.when(total > 0, F.floor(done * 100 / total)).otherwise(0).cast("int")
    error_line = F.get(F.split(F.trim(F.coalesce("error", F.lit(""))), "\n"), F.lit(0))
    return (jobs.withColumn("label", label).withColumn("percent", percent).withColumn("error_line", error_line)
            .withColumn("commit_short", F.substring(F.coalesce("commit_id", F.lit("")), 1, 12)))


def job_panel(jobs: DataFrame, now: Column, active_limit: int = 20, failed_limit: int = 5) -> DataFrame:
    """Newest active jobs, and of the newest failed ones those of the last day (two top-k reports)."""
    active = jobs.where(F.col("status").isin("queued", "running")).orderBy(F.col("id").desc()).limit(active_limit)
    failed = (jobs.where(F.col("status") == "failed").orderBy(F.col("id").desc()).limit(failed_limit)
              .where(micros(F.col("finished_at")) > micros(now) - F.lit(86_400_000_000)))
    return job_view(active).withColumn("panel", F.lit("active")).unionByName(
        job_view(failed).withColumn("panel", F.lit("failed")))


# ---------------------------------------------------------------- ages

# Units of relative ages in seconds, largest first.
AGE_UNITS = (("year", 31536000), ("month", 2592000), ("week", 604800), ("day", 86400), ("hour", 3600), ("minute", 60))


def relative_age(ts: Column, now: Column) -> Column:
    seconds = F.greatest(F.lit(0), micros(now) - micros(ts)) / F.lit(1_000_000)
    out = F.lit("just now")
    for unit, size in reversed(AGE_UNITS):
        n = F.floor(seconds / size)
        text = F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"), F.lit(" ago"))
        out = F.when(seconds >= size, text).otherwise(out)
    return F.when(ts.isNull(), "").otherwise(out)


def absolute_time(ts: Column) -> Column:
    return F.coalesce(F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm"), F.lit(" UTC")), F.lit(""))
