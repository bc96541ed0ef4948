"""Snapshot pairing: the primitive under every contract diff.

Both sides are tagged and united, never joined. Items are dealt out once by their whole key; there the
first aggregate groups whole items with plain flags as buffers (a hash aggregate), so what is equal on
both sides cancels out, and only real differences are sorted to be paired. Grouping treats NULL keys as
equal and spreads a hot endpoint over all its items. A full outer join would sort both sides whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.core import keep_first_per_key


def _flagged(base: DataFrame, head: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Distinct rows over `cols` with integer flags for the sides that hold them, dealt out by the columns `by`, if any."""
    side = lambda df, b, h: df.select(*cols, F.lit(b).alias("_b"), F.lit(h).alias("_h"))
    both = side(base, 1, 0).unionByName(side(head, 0, 1))
    both = both.repartition(*by) if by else both
    return both.groupBy(*cols).agg(F.max("_b").alias("_b"), F.max("_h").alias("_h"))


def pair_keys(base: DataFrame, head: DataFrame, keys: Sequence[str], dealt: bool = False) -> DataFrame:
    """One row per key of either side with in_base and in_head. `dealt` moves the rows as they are, for sides without repeated keys."""
    return _flagged(base, head, keys, keys if dealt else ()).select(*keys, (F.col("_b") == 1).alias("in_base"), (F.col("_h") == 1).alias("in_head"))


def pair_items(base: DataFrame, head: DataFrame, keys: Sequence[str], values: Sequence[str],
               pos: str | None = None, keep_equal: bool = False) -> DataFrame:
    """One row per key that differs: keys, in_base, in_head, and base / head structs of the values.

    Keys are unique per side, or `pos` is given and the highest position wins. `keep_equal` also
    returns the keys whose values are the same on both sides.
    """
    if pos:
        last = lambda df: keep_first_per_key(df.select(*keys, *values, pos), keys, [pos], last=True)
        base, head = last(base), last(head)
    rows = _flagged(base, head, [*keys, *values], keys)
    if not keep_equal:
        rows = rows.where("_b + _h = 1")
    payload = F.struct(F.lit(1).alias("_set"), *[F.col(v) for v in values])
    # rows are sorted by a number first: keys often begin alike, and comparing their texts costs more than the sort
    paired = rows.groupBy(F.xxhash64(*keys).alias("_k"), *keys).agg(F.max(F.when(F.col("_b") == 1, payload)).alias("base"), F.max(F.when(F.col("_h") == 1, payload)).alias("head"))
    return (paired.drop("_k").withColumn("in_base", F.col("base").isNotNull()).withColumn("in_head", F.col("head").isNotNull()))


def on_both_sides(base_routes: DataFrame, head_routes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Endpoint keys present in both snapshots."""
    return pair_keys(base_routes, head_routes, keys).where("in_base AND in_head").select(*keys)


def within(df: DataFrame, scope: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    # a task holds its share of the scope's keys; the long side is not sorted
    return df if scope is None else df.join(scope.hint("shuffle_hash"), list(keys), "left_semi")
