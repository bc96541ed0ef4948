"""Overlap join of line ranges without comparing all ranges of a file.

A range lives in at most two bins of the smallest width that holds it (its own level) and visits
the bins of greater widths. Two ranges meet in the level of the longer one: residents meet
residents and visitors, visitors never meet each other. Of two shared bins the one that holds the
later start counts. So an equality join yields every overlap exactly once and short ranges are
only compared when they are near, also when one file holds a third of all ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTHS = (64, 1_024, 16_384, 262_144, 16_777_216, 2 ** 40)


def _own_level(start: str, end: str, widths: Sequence[int]) -> Column:
    length = F.col(end) - F.col(start)
    own = F.lit(len(widths) - 1)
    for i in reversed(range(len(widths))):
        own = F.when(length < widths[i], i).otherwise(own)
    return own


def _level_bins(level: int, roles: Column, first: Column, last: Column) -> Column:
    """(level, bin, role) entries of one level."""
    return F.flatten(F.transform(F.sequence(first, last), lambda b: F.transform(
        roles, lambda r: F.struct(F.lit(level).alias("level"), b.alias("bin"), r.alias("role")))))


def _binned(df: DataFrame, start: str, end: str, widths: Sequence[int], homes: DataFrame, resident: Column, visitor: Column) -> DataFrame:
    """Bin entries as a resident of the own level and as a visitor of those greater ones among `homes`, where the other side has residents."""
    none = F.array().cast("array<struct<level:int,bin:bigint,role:string>>")
    parts = []
    for i, w in enumerate(widths):
        first, last = F.floor(F.col(start) / F.lit(w)), F.floor(F.col(end) / F.lit(w))
        entry = F.when(F.col("_own") == i, _level_bins(i, resident, first, last)).when(F.col("_own") < i, _level_bins(i, visitor, first, last))
        parts.append(F.coalesce(entry, none))
    rows = df.withColumn("_own", _own_level(start, end, widths)).withColumn("_b", F.explode(F.concat(*parts)))
    rows = rows.select("*", F.col("_b.level").alias("_level"), F.col("_b.bin").alias("_bin"), F.col("_b.role").alias("_role")).drop("_b")
    # one row for each width at most
    met = rows.join(F.broadcast(homes.withColumn("_met", F.lit(True))), "_level", "left").where("_level = _own OR _met")
    return met.drop("_own", "_met")


def _homes(df: DataFrame, start: str, end: str, widths: Sequence[int]) -> DataFrame:
    return df.select(_own_level(start, end, widths).alias("_level")).distinct()


def overlap_join(left: DataFrame, right: DataFrame, on: Sequence[str], left_range: tuple[str, str], right_range: tuple[str, str],
                 widths: Sequence[int] = WIDTHS) -> DataFrame:
    """Rows whose closed ranges overlap and whose `on` columns are equal. Range columns need distinct names."""
    ls, le = left_range
    rs, re = right_range
    role = lambda *names: F.array(*[F.lit(n) for n in names])
    a = _binned(left, ls, le, widths, _homes(right, rs, re, widths), role("both", "left"), role("right"))
    b = _binned(right, rs, re, widths, _homes(left, ls, le, widths), role("both", "right"), role("left"))
    width = F.element_at(F.array(*[F.lit(w).cast("long") for w in widths]), F.col("_level") + 1)
    joined = a.join(b, [*on, "_level", "_bin", "_role"])
    later = F.floor(F.greatest(ls, rs) / width)
    return (joined.where((F.col(ls) <= F.col(re)) & (F.col(rs) <= F.col(le)) & (later == F.col("_bin")))
            .drop("_level", "_bin", "_role"))
