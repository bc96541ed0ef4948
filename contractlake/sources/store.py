"""Stored tables: keyed writes, deletions, and the newest document of a repository."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import keep_first_per_key


def upsert_rows(stored: DataFrame, updates: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Stored rows replaced or extended by updates; of several updates of a key the last in `order` wins."""
    newest = keep_first_per_key(updates, keys, [order], last=True).drop(order)
    kept = stored.join(newest.select(*keys), list(keys), "left_anti")
    return kept.unionByName(newest)


def delete_keys(stored: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stored rows without those of the deleted keys."""
    return stored.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def delete_repo(tables: dict[str, DataFrame], repos: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of the given repositories."""
    return {name: delete_keys(df, repos, ["repo"]) for name, df in tables.items()}


def latest_document(documents: DataFrame, keys: Sequence[str] = ("repo",), document: str = "document", commit: str | None = None) -> DataFrame:
    """Newest document per repository, optionally of one commit.

    Only ids are aggregated; the wide documents are read for the winners alone.
    """
    rows = documents if commit is None else documents.where(F.col("commit_id") == commit)
    top = rows.groupBy(*keys).agg(F.max("id").alias("id"))
    return rows.select(*keys, "id", document).join(top, [*keys, "id"], "left_semi")


def list_repos(versions: DataFrame) -> DataFrame:
    return versions.select("repo").distinct().orderBy("repo")


def list_apis(versions: DataFrame, repo: str) -> DataFrame:
    return versions.where(F.col("repo") == repo).select("api").distinct().orderBy("api")


def list_versions(versions: DataFrame, repo: str, api: str) -> DataFrame:
    return versions.where((F.col("repo") == repo) & (F.col("api") == api)).select("version").orderBy("version")


def version_entries(versions: DataFrame, repo: str, api: str, content: str = "content") -> DataFrame:
    """Every version of an API, ascending, without the content column (the scan then skips it)."""
    return versions.drop(content).where((F.col("repo") == repo) & (F.col("api") == api)).orderBy("version")


def read_version(versions: DataFrame, repo: str, api: str, version: int, content: str = "content") -> DataFrame:
    return versions.where((F.col("repo") == repo) & (F.col("api") == api) & (F.col("version") == version)).select(content)


def api_exists(versions: DataFrame, wanted: DataFrame) -> DataFrame:
    """Adds `found` to (repo, api) rows; names unfit for a path are never found."""
    from .files import safe_name
    known = versions.select("repo", "api").distinct().withColumn("_known", F.lit(True))
    safe: Column = safe_name(F.col("repo")) & safe_name(F.col("api"))
    return wanted.join(known, ["repo", "api"], "left").withColumn("found", safe & F.coalesce("_known", F.lit(False))).drop("_known")
