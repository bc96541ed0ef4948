"""Helpers on DataFrames: columns added by Arrow code, fold tests, set digests, connected components."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..session import release, write_scratch
from .arrays import slices


def arrow_columns(df: DataFrame, fields: Sequence[tuple[str, str]], setup: Callable[[], Callable[[pa.RecordBatch], list]],
                  text: str = "text") -> DataFrame:
    """df with more columns, worked out by setup()(slice of rows) in each task.

    Input columns that carry a new column's name are replaced. `text` only sizes the slices.
    """
    kept = df.drop(*[name for name, _ in fields])
    schema = StructType(kept.schema.fields + [StructField(name, StructType.fromDDL(f"x {kind}")[0].dataType) for name, kind in fields])
    names = schema.names

    def run(batches):
        work = setup()
        for batch in batches:
            for part in slices(batch, text):
                yield pa.RecordBatch.from_arrays([*part.columns, *work(part)], names=names)

    return kept.mapInArrow(run, schema)


def fold(key: str | Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; null for a null key."""
    return F.crc32(F.col(key).cast("string") if isinstance(key, str) else key.cast("string")) % n


def components(links: DataFrame, src: str, dst: str) -> DataFrame:
    """(node, component): smallest node reachable over undirected links, for every node that has a link.

    Rounds of two steps over a shrinking edge list: every node's greater neighbours move to its smallest
    neighbour, then every node's smaller neighbours do. Stars remain, with the smallest node as centre.
    Each round is written as a table, so a lost executor costs one round, and the table of the round before goes; one count per round reaches the driver.
    """
    a, b = F.col("a"), F.col("b")
    edges = (links.select(F.greatest(src, dst).alias("a"), F.least(src, dst).alias("b")).where(a > b).distinct())
    edges, path = write_scratch(edges)
    size = edges.count()
    while size:
        both = edges.unionByName(edges.select(b.alias("a"), a.alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("low", "a"))
        large = both.join(low, "a").where(b > a).select(b.alias("a"), F.col("low").alias("b")).distinct()
        down = large.where(a > b)
        lows = down.groupBy("a").agg(F.min("b").alias("low"))
        small = (down.join(lows, "a").select(F.explode(F.array(F.struct(a.alias("a"), F.col("low").alias("b")), F.struct(b.alias("a"), F.col("low").alias("b")))).alias("e"))
                 .select("e.a", "e.b").where(a > b).distinct())
        after, written = write_scratch(small)
        count = after.count()
        moved = count != size or not after.join(edges, ["a", "b"], "left_anti").isEmpty()
        release(links.sparkSession, path)
        edges, path, size = after, written, count
        if not moved:
            break
    nodes = edges.select(a.alias("node"), b.alias("component"))
    return nodes.unionByName(edges.select(b.alias("node"), b.alias("component")).distinct())
