"""Named queries over the driver tables, each with the SQL that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..session import cut_lineage

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
# schemas by file, so that a query which reads a table many times infers it once
SCHEMAS: dict[str, StructType] = {}


class Source:
    """Driver tables and derived relations of one scale folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._written: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        path = f"{self.folder}/{name}.parquet"
        if path not in SCHEMAS:
            SCHEMAS[path] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(SCHEMAS[path]).parquet(path)

    def written(self, text: str) -> DataFrame:
        """What the text selects, worked out and written once for this query, however often it is read."""
        if text not in self._written:
            self._written[text] = cut_lineage(self.sql(text))
        return self._written[text]

    def sql(self, text: str) -> DataFrame:
        for name in TABLES:
            if re.search(rf"\b{name}\b", text):
                self.table(name).createOrReplaceTempView(name)
        return self.spark.sql(text)


def query(key: str, sql: str | None = None):
    """Register f(Source) -> DataFrame under `key`, with its DuckDB text when there is one."""
    def wrap(f: Callable[[Source], DataFrame]):
        if key in QUERIES:
            raise ValueError(f"query {key} is registered twice")
        QUERIES[key] = lambda spark, folder: f(Source(spark, folder))
        if sql is not None:
            ORACLE[key] = sql
        return f
    return wrap


def with_relations(relations: dict[str, str], body: str) -> str:
    """`WITH` clause holding the relations the body (or a kept relation) mentions, in order."""
    names = list(relations)
    needed: set[str] = set()
    frontier = body
    while True:
        found = {n for n in names if n not in needed and re.search(rf"\b{n}\b", frontier)}
        if not found:
            break
        needed |= found
        frontier = " ".join(relations[n] for n in found)
    head = ",\n".join(f"{n} AS ({relations[n]})" for n in names if n in needed)
    return f"WITH {head}\n{body}" if head else body
