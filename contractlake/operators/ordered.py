"""Order-dependent steps that stay parallel when one key holds most of the rows.

A window over a hot key would put all its rows into one task. Here rows are cut into chunks of
the position column (a unique, growing integer, so a chunk has at most `size` rows), the window
runs per (key, chunk), and one small row per chunk carries what the next chunk must know.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 1_000_000


def with_chunk(df: DataFrame, pos: str, size: int = CHUNK) -> DataFrame:
    return df.withColumn("_chunk", F.floor(F.col(pos) / F.lit(size)))


def in_chunk(keys: Sequence[str], pos: str):
    return Window.partitionBy(*keys, "_chunk").orderBy(pos)


def over_chunks(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy("_chunk")


def same_keys(keys: Sequence[str], a: str, b: str) -> Column:
    cond = F.lit(True)
    for k in [*keys, "_chunk"]:
        cond = cond & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return cond


def attach(rows: DataFrame, edges: DataFrame, keys: Sequence[str], edge_cols: Sequence[str]) -> DataFrame:
    """Give every row the values of its chunk. Rows are already clustered by (key, chunk)."""
    picked = edges.select(*keys, "_chunk", *edge_cols)
    return (rows.alias("r").join(picked.alias("e"), same_keys(keys, "r", "e"))
            .select("r.*", *[F.col(f"e.{c}").alias(c) for c in edge_cols]))


def dense_index(df: DataFrame, keys: Sequence[str], pos: str, name: str, size: int = CHUNK) -> DataFrame:
    """1-based row number per key by position."""
    rows = with_chunk(df, pos, size).withColumn("_rn", F.row_number().over(in_chunk(keys, pos)))
    counts = rows.groupBy(*keys, "_chunk").agg(F.count("*").alias("_n"))
    before = over_chunks(keys).rowsBetween(Window.unboundedPreceding, -1)
    edges = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return (attach(rows, edges, keys, ["_before"])
            .withColumn(name, F.col("_before") + F.col("_rn")).drop("_before", "_rn", "_chunk"))


def previous_values(df: DataFrame, keys: Sequence[str], pos: str, values: Sequence[str], size: int = CHUNK) -> DataFrame:
    """`previous` struct of the values of the row before, NULL on the first row of a key."""
    payload = F.struct(*values)
    rows = (with_chunk(df, pos, size)
            .withColumn("_rn", F.row_number().over(in_chunk(keys, pos)))
            .withColumn("_lag", F.lag(payload).over(in_chunk(keys, pos))))
    lasts = rows.groupBy(*keys, "_chunk").agg(F.max_by(payload, F.col(pos)).alias("_last"))
    edges = lasts.withColumn("_carry", F.lag("_last").over(over_chunks(keys)))
    # only the first row of a chunk looks back into another, so the others do not travel again
    first = attach(rows.where("_rn = 1").drop("_lag", "_rn"), edges, keys, ["_carry"]).withColumnRenamed("_carry", "previous")
    rest = rows.where("_rn > 1").drop("_rn").withColumnRenamed("_lag", "previous")
    return rest.drop("_chunk").unionByName(first.drop("_chunk"))


def nearest_marks(df: DataFrame, keys: Sequence[str], pos: str, mark: Column, size: int = CHUNK) -> DataFrame:
    """Positions of the nearest marked row before and after each row, and the last position of the key."""
    at = F.when(mark, F.col(pos))
    rows = with_chunk(df, pos, size).withColumn("_at", at)
    w = in_chunk(keys, pos)
    rows = (rows
            .withColumn("_prev", F.max("_at").over(w.rowsBetween(Window.unboundedPreceding, -1)))
            .withColumn("_next", F.min("_at").over(w.rowsBetween(1, Window.unboundedFollowing))))
    chunks = rows.groupBy(*keys, "_chunk").agg(
        F.max("_at").alias("_hi"), F.min("_at").alias("_lo"), F.max(pos).alias("_end"))
    o = over_chunks(keys)
    edges = (chunks
             .withColumn("_cprev", F.max("_hi").over(o.rowsBetween(Window.unboundedPreceding, -1)))
             .withColumn("_cnext", F.min("_lo").over(o.rowsBetween(1, Window.unboundedFollowing)))
             .withColumn("_last", F.max("_end").over(Window.partitionBy(*keys))))
    return (attach(rows, edges, keys, ["_cprev", "_cnext", "_last"])
            .withColumn("prev_mark", F.coalesce("_prev", "_cprev"))
            .withColumn("next_mark", F.coalesce("_next", "_cnext"))
            .withColumnRenamed("_last", "last_pos")
            .drop("_prev", "_next", "_cprev", "_cnext", "_at", "_chunk"))


def running(df: DataFrame, keys: Sequence[str], pos: str, totals: dict[str, tuple[Column, str]], size: int = CHUNK) -> DataFrame:
    """Running totals per key by position: name -> (value, `sum`, `max`, or `max before` for the rows before only)."""
    make = {"sum": F.sum, "max": F.max, "max before": F.max}
    w = in_chunk(keys, pos)
    rows = with_chunk(df, pos, size).withColumns({f"_v_{n}": value for n, (value, _) in totals.items()})
    rows = rows.withColumns({n: make[kind](f"_v_{n}").over(w.rowsBetween(Window.unboundedPreceding, -1 if kind == "max before" else 0)) for n, (_, kind) in totals.items()})
    chunks = rows.groupBy(*keys, "_chunk").agg(*[make[kind](f"_v_{n}").alias(f"_t_{n}") for n, (_, kind) in totals.items()])
    before = over_chunks(keys).rowsBetween(Window.unboundedPreceding, -1)
    edges = chunks.select(*keys, "_chunk", *[make[kind](f"_t_{n}").over(before).alias(f"_b_{n}") for n, (_, kind) in totals.items()])
    out = attach(rows, edges, keys, [f"_b_{n}" for n in totals])
    joined = {n: F.coalesce(f"_b_{n}", F.lit(0)) + F.col(n) if kind == "sum" else F.greatest(f"_b_{n}", n) for n, (_, kind) in totals.items()}
    return out.withColumns(joined).drop("_chunk", *[f"{x}_{n}" for n in totals for x in ("_v", "_b")])
