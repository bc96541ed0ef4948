"""Ordered line differences of many text pairs at once: anchors found in rounds over all pairs, then changes by a queue of removed lines."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ordered import CHUNK, dense_index, running


def longest_increasing(matches: DataFrame) -> DataFrame:
    """Of the matches (pair, seg, left, right) of each segment a longest run that grows on both sides.

    Among several the one that ends last, and that steps back to the latest match each time. Segments pass in sorted streams; a task holds one segment's numbers.
    """
    def chosen(rights: list[int]) -> list[int]:
        tops, at, before = [], [], []
        for k, right in enumerate(rights):
            pile = bisect_left(tops, right)
            before.append(at[pile - 1] if pile else -1)
            tops[pile:pile + 1] = [right]
            at[pile:pile + 1] = [k]
        out, k = [], at[-1]
        while k >= 0:
            out.append(k)
            k = before[k]
        return out[::-1]

    def run(batches):
        now, rows = None, []

        def kept():
            return pa.RecordBatch.from_pylist([rows[k] for k in chosen([r["right"] for r in rows])], schema)

        for batch in batches:
            for row in batch.to_pylist():
                if (row["pair"], row["seg"]) != now:
                    if rows:
                        yield kept()
                    now, rows = (row["pair"], row["seg"]), []
                rows.append(row)
        if rows:
            yield kept()

    names = ("pair", "seg", "left", "right")
    schema = pa.schema([(n, pa.int64()) for n in names])
    return matches.select(*names).repartition("pair", "seg").sortWithinPartitions("pair", "seg", "left").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _flagged(lines: DataFrame, anchors: DataFrame, size: int) -> DataFrame:
    """Lines with `anchor` and the number of anchors at or before them on their side."""
    ends = anchors.select("pair", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("left").alias("line")), F.struct(F.lit(1).alias("side"), F.col("right").alias("line")))).alias("e"))
    marked = lines.join(ends.select("pair", "e.side", "e.line", F.lit(1).alias("anchor")), ["pair", "side", "line"], "left")
    return running(marked, ["pair", "side"], "line", {"before": (F.coalesce("anchor", F.lit(0)), "sum")}, size)


def matched_lines(lines: DataFrame, size: int = CHUNK) -> DataFrame:
    """(pair, left, right): equal lines in equal order, of lines (pair, side, line, mark) where `mark` stands for the text.

    Each round takes the lines that occur once on both sides of a segment, keeps a longest run in order, and cuts the segments there; all pairs and segments go at
    once. Where no such line is left, the n-th of equal lines meets the n-th on the other side, again a longest run in order.
    """
    rest, found = lines.withColumn("seg", F.lit(0).cast("long")), []
    while True:
        left, right = F.when(F.col("side") == 0, F.col("line")), F.when(F.col("side") == 1, F.col("line"))
        shared = cut_lineage(rest.groupBy("pair", "seg", "mark").agg(F.count(left).alias("l"), F.count(right).alias("r"), F.min(left).alias("left"), F.min(right).alias("right"))
                             .where("l > 0 AND r > 0"))
        # lines that one side lacks are done with
        rest = cut_lineage(rest.join(shared.select("pair", "seg", "mark"), ["pair", "seg", "mark"], "left_semi"))
        anchors = cut_lineage(longest_increasing(shared.where("l = 1 AND r = 1")))
        if anchors.isEmpty():
            break
        found.append(anchors)
        rest = _flagged(rest, anchors, size).where("anchor IS NULL").select("pair", "side", "line", "mark", (F.col("seg") + F.col("before")).alias("seg"))
    counted = dense_index(rest, ["pair", "seg", "side", "mark"], "line", "n", size)
    twin = [counted.where(F.col("side") == k).select("pair", "seg", "mark", "n", F.col("line").alias(name)) for k, name in enumerate(("left", "right"))]
    found.append(longest_increasing(twin[0].join(twin[1], ["pair", "seg", "mark", "n"])))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.select("pair", "left", "right")


def line_edits(pairs: DataFrame, keys: Sequence[str], old: str = "old", new: str = "new", size: int = CHUNK) -> DataFrame:
    """Edit rows of every (old, new) text pair: keys, idx, status, left_line, left_text, right_line, right_text.

    `same` lines stay in order. Between them the removed lines stand before the added ones; removed lines wait in a queue, and each added line takes the first that
    waits as a `change`, also one from an earlier place; without one it is an `add`. What waits at the end is a `remove`. `idx` numbers the rows of a pair from 1: the right
    texts of all rows that have one, in this order, are the new text. A null text has no lines. Rows that repeat the keys are pairs of their own.
    """
    held = cut_lineage(pairs.select(*keys, F.col(old).alias("_old"), F.col(new).alias("_new"), F.monotonically_increasing_id().alias("pair")))

    def lines(content: str, side: int) -> DataFrame:
        return (held.where(F.col(content).isNotNull()).select("pair", F.lit(side).alias("side"), F.posexplode(F.split(content, "\n", -1)).alias("n", "text"))
                .select("pair", "side", (F.col("n") + 1).cast("long").alias("line"), "text"))

    texts = lines("_old", 0).unionByName(lines("_new", 1))
    slim = cut_lineage(texts.select("pair", "side", "line", F.md5("text").alias("mark")))
    same = cut_lineage(matched_lines(slim, size))
    placed = cut_lineage(_flagged(slim.drop("mark"), same, size).select("pair", "side", "line", "anchor", F.col("before").alias("gap")))
    # the anchors around each gap and the ends of the texts give every removed and added line its place in the edits
    numbered = dense_index(same, ["pair"], "left", "gap", size)
    total = held.select("pair", *[F.when(F.col(c).isNull(), 0).otherwise(F.size(F.split(c, "\n", -1))).cast("long").alias(n) for c, n in (("_old", "n_left"), ("_new", "n_right"))])
    events = (placed.where("anchor IS NULL").join(total, "pair")
              .join(numbered.select("pair", "gap", F.col("right").alias("last_right")), ["pair", "gap"], "left")
              .join(numbered.select("pair", (F.col("gap") - 1).alias("gap"), F.col("left").alias("next_left")), ["pair", "gap"], "left"))
    removed, next_left = F.col("side") == 0, F.coalesce("next_left", F.col("n_left") + 1)
    place = F.when(removed, F.col("line") - 1 + F.coalesce("last_right", F.lit(0)) - F.col("gap")).otherwise(next_left + F.col("line") - 2 - F.col("gap"))
    events = events.select("pair", "side", "line", "n_right", place.alias("place"))
    counted = running(events, ["pair"], "place", {"r": ((F.col("side") == 0).cast("long"), "sum"), "a": ((F.col("side") == 1).cast("long"), "sum")}, size)
    # added lines that find the queue empty are those at which added exceed removed lines by more than ever before
    over = running(counted, ["pair"], "place", {"most": (F.greatest(F.col("a") - F.col("r"), F.lit(0)), "max before")}, size)
    most = F.coalesce("most", F.lit(0))
    over = cut_lineage(over.select("pair", "side", "line", "n_right", "r", F.when((F.col("side") == 1) & (F.col("a") - F.col("r") <= most), F.col("a") - most).alias("takes")))
    gone = over.where("side = 0").select("pair", "r", F.col("line").alias("left_line"), "n_right")
    came = over.where("side = 1").select("pair", F.col("takes").alias("r"), F.col("line").alias("right_line"))
    taken = over.groupBy("pair").agg(F.max("takes").alias("taken"))
    left_over = (gone.join(taken, "pair").where("taken IS NULL OR r > taken")
                 .select("pair", F.lit("remove").alias("status"), "left_line", F.lit(None).cast("long").alias("right_line"), (F.col("n_right") + F.col("r") - F.coalesce("taken", F.lit(0))).alias("idx")))
    new_lines = (came.join(gone.select("pair", "r", "left_line"), ["pair", "r"], "left")
                 .select("pair", F.when(F.col("r").isNull(), "add").otherwise("change").alias("status"), "left_line", "right_line", F.col("right_line").alias("idx")))
    kept = same.select("pair", F.lit("same").alias("status"), F.col("left").alias("left_line"), F.col("right").alias("right_line"), F.col("right").alias("idx"))
    edits = kept.unionByName(new_lines).unionByName(left_over)
    # a pair's texts are one row, so its edits may be: texts meet them once, whole, and are cut into lines where they are shown
    listed = edits.groupBy("pair").agg(F.collect_list(F.struct("idx", "status", "left_line", "right_line")).alias("_edits"))
    cut = held.join(listed.hint("merge"), "pair").select(*keys, "_edits", *[F.split(c, "\n", -1).alias(c) for c in ("_old", "_new")])
    at = lambda c, n: F.get(c, (F.col(f"_e.{n}") - 1).cast("int"))
    return (cut.select(*keys, "_old", "_new", F.explode("_edits").alias("_e"))
            .select(*keys, "_e.idx", "_e.status", "_e.left_line", at("_old", "left_line").alias("left_text"), "_e.right_line", at("_new", "right_line").alias("right_text")))
