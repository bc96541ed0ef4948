"""Column helpers for the empty-value rules and labels used across operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ColumnOrName = Column | str

# Severities and verdicts, worst first.
SEVERITIES = ("breaking", "minor", "additive")
VERDICTS = ("clear", "review", "hold")


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def non_empty(c: ColumnOrName) -> Column:
    """NULL for the empty string, else the value itself."""
    return F.nullif(col(c), F.lit(""))


def non_blank(c: ColumnOrName) -> Column:
    """Trimmed text, NULL when nothing is left."""
    return F.nullif(F.regexp_replace(col(c), r"^\s+|\s+$", ""), F.lit(""))


def first_non_empty(*cols: ColumnOrName) -> Column:
    return F.coalesce(*[non_empty(c) for c in cols])


def is_true(c: ColumnOrName) -> Column:
    return F.coalesce(col(c), F.lit(False))


def shown(c: ColumnOrName) -> Column:
    """Text for readable details; a missing value prints as None."""
    return F.coalesce(col(c).cast("string"), F.lit("None"))


def plural(count: ColumnOrName, word: str) -> Column:
    n = col(count)
    return F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"))


def severity_rank(c: ColumnOrName) -> Column:
    """0 breaking, 1 minor, 2 additive, 3 anything else."""
    out = F.lit(3)
    for rank, name in reversed(list(enumerate(SEVERITIES))):
        out = F.when(col(c) == name, rank).otherwise(out)
    return out


def verdict_rank(c: ColumnOrName) -> Column:
    out = F.lit(0)
    for rank, name in enumerate(VERDICTS):
        out = F.when(col(c) == name, rank).otherwise(out)
    return out


def verdict_name(rank: ColumnOrName) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in VERDICTS]), col(rank) + 1)


def rule_array(rules: Sequence[Sequence], names: Sequence[str]) -> Column:
    """An ordered literal rule list as one array column (folded once, no join)."""
    return F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, rule)]) for rule in rules])


def first_match(rules: Column, test) -> Column:
    """First rule struct passing `test`, else NULL."""
    return F.get(F.filter(rules, test), F.lit(0))


def any_of(c: Column, words: Sequence[str]) -> Column:
    """True when the text contains one of the words."""
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: c.contains(w))


def keep_first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[ColumnOrName], last: bool = False) -> DataFrame:
    """One whole row per key, the first (or last) by `order`.

    An aggregate with map-side combine, so a hot key never lands whole in one task.
    """
    value_cols = [c for c in df.columns if c not in keys]
    rank = F.struct(*[col(c) for c in order])
    pick = F.max_by if last else F.min_by
    row = pick(F.struct(*value_cols), rank).alias("_row")
    return df.groupBy(*keys).agg(row).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in value_cols]).select(*df.columns)
