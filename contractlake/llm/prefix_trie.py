"""Trie of conversations by their first turns, from sorted matrices of turn ids.

1. A turn's id is the MD5 of its role and text, so nodes are told apart by 128 bits. Turns are numbered by a range sort, so one conversation may lie in many
   tasks, and cut into bands of 64: a row of the sorted table is (band, digest of all turns before it, ids of the band, conversation).
2. The rows are sorted by range into shards. A shard pads its rows to matrices of eight columns at a time, sorts them with `lexsort`, compares neighbours, and accumulates
   the changes from left to right by OR: a mark in column d starts a node of that depth. `reduceat` gives members, smallest member, children, leaves and saved tokens of
   every depth; only rows that are long enough stay in the matrix of the next columns.
3. Nodes on the paths of a shard's first and last row may go on in the next shard. Only those, at most two for each depth and shard, are sent as parts and recombined:
   counts are summed, shared children and their subtrees are counted once.
4. Bands of longer conversations hang below nodes of the band before. Their totals are added at the conversation that is their smallest member.

Null role or text is empty, a null turn comes first, equal turns are ordered by role and MD5 of the text. Rows without a conversation id belong to no conversation and are left
out. Repeated rows are turns of their own. Other columns, whatever their names, are not read. An empty table has no nodes. Texts of any length are read whole. The list of
members that end at a node is hashed in order: parts of a list are joined in the shards, one task hashes a list that lies in several.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..session import cut_lineage
from .arrays import U64, segment_sums

# Turns in a band, columns of a matrix, rows of a shard at most on average, characters of a part of a list.
BAND = 64
COLUMNS = 8
SHARD_ROWS = 200_000
PART_CHARS = 1 << 20

_EMPTY = hashlib.sha256().hexdigest()
_NODE = ("kind int, key binary, parent binary, band long, level int, conv_id long, parent_conv long, n_convs long, n_children long, n_leaves long, saved_tokens long, size long, "
         "ends string, above array<binary>, goes_on boolean")


def turn_rows(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, id, size) of every turn; id is hexadecimal, size counts UTF-8 bytes of the text."""
    role, text = (F.coalesce(F.col(x).cast("string"), F.lit("")) for x in ("role", "text"))
    return (conversations.where("conv_id is not null")
            .select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"),
                    F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("id"), F.octet_length(text).cast("long").alias("size")))


def numbered(rows: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """rows with their places, from 0, among the rows of a key, a long without nulls. Sorted by range: a key may fill many tasks."""
    line, schema = [key, *order], StructType([*rows.schema.fields, StructField("_shard", IntegerType()), StructField(name, LongType())])
    names = schema.names

    def count(batches):
        shard, now, so_far = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            keys = batch.column(at).to_numpy()
            if not len(keys):
                continue
            starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            runs = np.diff(np.append(starts, len(keys)))
            places = np.arange(len(keys)) - np.repeat(starts, runs)
            if keys[0] == now:
                places[:runs[0]] += so_far
            now, so_far = keys[-1], int(places[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(keys), shard), pa.int32()), pa.array(places, pa.int64())], names=names)

    at = rows.columns.index(key)
    placed = cut_lineage(rows.repartitionByRange(*line).sortWithinPartitions(*line).mapInArrow(count, schema))
    # only the first key of a shard can have rows in earlier shards
    firsts = placed.groupBy("_shard").agg(F.min(key).alias(key)).select(key).distinct()
    parts = placed.join(F.broadcast(firsts), key).groupBy(key, "_shard").agg(F.count("*").alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy(key).orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1))
    shifts = parts.select(key, "_shard", earlier.alias("_shift")).where("_shift > 0")  # no more rows than shards
    return (placed.join(F.broadcast(shifts), [key, "_shard"], "left")
            .select(*rows.columns, (F.col(name) + F.coalesce("_shift", F.lit(0))).alias(name)))


def rebuilt(turns: DataFrame, group: int, heads: int) -> DataFrame:
    """(conv_id, first, at, id, size): conversation c with its first h turns, h = crc32(c) mod `heads`, replaced by those of conversation c - c % group.

    `first` orders the borrowed turns before the own ones; a row without an id stands first in each conversation.
    """
    base = F.col("conv_id") - F.col("conv_id") % group
    head = F.crc32(F.col("conv_id").cast("string")) % heads
    own = turns.where(F.col("at") >= head).select("conv_id", F.lit(1).alias("first"), "at", "id", "size")
    lent = (turns.where((F.col("at") < heads) & (F.col("conv_id") == base))
            .select(F.explode(F.array(*[F.try_add("conv_id", F.lit(k)) for k in range(1 - group, group)])).alias("conv_id"), F.col("conv_id").alias("lender"), "at", "id", "size")
            .where((F.col("at") < head) & (F.col("lender") == base))
            .select("conv_id", F.lit(0).alias("first"), "at", "id", "size"))
    mark = turns.select("conv_id").distinct().select("conv_id", F.lit(-1).alias("first"), F.lit(-1).cast("long").alias("at"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("long").alias("size"))
    return own.unionByName(lent).unionByName(mark)


def bands(turns: DataFrame) -> DataFrame:
    """(conv_id, band, prefix, least, ids, sizes, goes_on) of turns in order, `least` being the smallest member of the node above a later band. Every conversation has its row without an id at place 0, and none is returned without it."""
    pieces = (turns.withColumn("band", F.floor(F.greatest(F.col("place") - 1, F.lit(0)) / F.lit(BAND)))
              .groupBy("conv_id", "band")
              .agg(F.array_sort(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("place", "id", "size")))).alias("turns"), F.max(F.col("id").isNull()).alias("is_conversation"))
              .where("is_conversation or band > 0")
              .select("conv_id", "band", F.unhex(F.array_join(F.transform("turns", lambda x: x["id"]), "")).alias("ids"), F.transform("turns", lambda x: x["size"]).alias("sizes")))
    pieces = cut_lineage(pieces)
    # only conversations of several bands have a digest of what lies before; a sum over (band, ids) that grows band by band
    full = pieces.where(F.size("sizes") == BAND).select("conv_id", "band", F.xxhash64("band", "ids").alias("x"), F.xxhash64(F.lit("second"), "ids", "band").alias("y"))
    so_far = Window.partitionBy("conv_id").orderBy("band").rowsBetween(Window.unboundedPreceding, 0)
    sums = full.select("conv_id", (F.col("band") + 1).alias("band"), *[F.sum(F.shiftright(c, 32)).over(so_far).alias(c + "1") for c in "xy"],
                       *[F.sum(F.col(c).bitwiseAND(0xFFFFFFFF)).over(so_far).alias(c + "0") for c in "xy"])
    before = sums.select("conv_id", "band", F.unhex(F.md5(F.concat_ws(",", "x1", "x0", "y1", "y0"))).alias("prefix"))
    later = pieces.where("band > 0").select("conv_id", (F.col("band") - 1).alias("band"), F.lit(True).alias("goes_on"))
    # the node above a later band also has members that end there
    least = before.groupBy("band", "prefix").agg(F.min("conv_id").alias("least"))
    first = pieces.where("band = 0").withColumn("prefix", F.unhex(F.lit(""))).withColumn("least", F.col("conv_id"))
    rest = pieces.where("band > 0").join(before, ["conv_id", "band"]).join(least, ["band", "prefix"])
    return first.unionByName(rest.select(*first.columns)).join(later, ["conv_id", "band"], "left").withColumn("goes_on", F.coalesce("goes_on", F.lit(False)))


# -- one shard

def _level_nodes(rows: np.ndarray, starts: np.ndarray, conv: np.ndarray):
    """Members and smallest member of nodes whose rows begin at `starts` of `rows`."""
    return np.diff(np.append(starts, len(rows))), np.minimum.reduceat(conv[rows], starts)


class _Shard:
    """Nodes of the rows of a shard, level by level. Level 0 has the roots of the bands' subtries."""

    def __init__(self, table: pa.Table, depth: int, columns: int):
        self.depth, self.columns = depth, columns
        column = {name: table.column(name).combine_chunks() for name in table.column_names}
        self.n = table.num_rows
        self.band = column["band"].to_numpy()
        self.conv = column["conv_id"].to_numpy()
        self.goes_on = column["goes_on"].to_numpy(zero_copy_only=False)
        self.least = column["least"].to_numpy()
        self.more = [column[x].to_numpy() for x in ("more_children", "more_leaves", "more_saved")]
        sizes = column["sizes"]
        self.offsets = sizes.offsets.to_numpy().astype(np.int64)
        self.size = sizes.values.to_numpy()
        self.length = np.diff(self.offsets)
        self.offsets -= self.offsets[0] if self.n else 0
        self.size = self.size[sizes.offsets[0].as_py():] if self.n else self.size
        # ids as pairs of 64-bit numbers; how they are ordered does not matter, as all shards order them alike
        raw = column["ids"]
        bounds = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset:raw.offset + self.n + 1]
        data = raw.buffers()[2]
        self.bytes = np.frombuffer(data, np.uint8)[bounds[0]:bounds[-1]] if self.n and data is not None else np.zeros(0, np.uint8)
        self.ids = np.ascontiguousarray(self.bytes).view(">u8").astype(U64).reshape(-1, 2)
        prefix = np.zeros((self.n, 16), np.uint8)
        some = np.flatnonzero(self.band > 0)
        if len(some):
            prefix[some] = np.frombuffer(b"".join(column["prefix"].take(pa.array(some)).to_pylist()), np.uint8).reshape(-1, 16)
        self.prefix = prefix.view(">u8").astype(U64)
        self._sort()
        self._levels()

    def _sort(self) -> None:
        self.order = np.lexsort((self.conv, self.prefix[:, 1], self.prefix[:, 0], self.band))
        key = np.column_stack([self.band.astype(U64), self.prefix])[self.order]
        change = np.ones(self.n, bool)
        change[1:] = (key[1:] != key[:-1]).any(axis=1)
        self.roots = np.flatnonzero(change)
        self.starts = []  # of each level: rows of the sorted order that are long enough, and where nodes begin among them
        rows, begins = np.arange(self.n), change
        for first in range(0, self.depth, self.columns):
            # rows of the order still in play; the sort puts ended rows of a node first, then the others by their next columns
            long = self.length[self.order[rows]] > first
            if first:
                rows, begins = rows[long], self._carry(begins, long)
            if not len(rows):
                break
            own = self.order[rows]
            wide = min(self.columns, int(self.length[own].max()) - first)
            if wide <= 0:
                break
            at = self.offsets[own][:, None] + first + np.arange(wide)
            there = first + np.arange(wide) < self.length[own][:, None]
            matrix = np.where(there[:, :, None], self.ids[np.where(there, at, 0)], U64(0))
            node = np.cumsum(begins)
            line = np.lexsort((self.conv[own], self.length[own] > first + self.columns, *[matrix[:, k, half] for k in range(wide - 1, -1, -1) for half in (1, 0)], node))
            self.order[rows] = own[line]
            matrix, there = matrix[line], there[line]
            change = np.zeros((len(rows), wide + 1), bool)
            change[:, 0] = begins
            change[1:, 1:] = (matrix[1:] != matrix[:-1]).any(axis=2)
            marks = np.logical_or.accumulate(change, axis=1)[:, 1:]
            for k in range(wide):
                live = there[:, k]
                self.starts.append((rows[live], np.flatnonzero(self._carry(marks[:, k], live))))
            begins = marks[:, -1]

    @staticmethod
    def _carry(begins: np.ndarray, kept: np.ndarray) -> np.ndarray:
        """Starts of groups among the kept rows, where a group's first rows may go."""
        group = np.cumsum(begins)[kept]
        out = np.ones(len(group), bool)
        out[1:] = group[1:] != group[:-1]
        return out

    def _levels(self) -> None:
        """Per level: row ranges, members, smallest member, parent, children, leaves and saved tokens of the subtree."""
        columns = self.conv, self.length, self.goes_on, self.band, self.offsets[:-1], self.least
        self.conv, self.length, self.goes_on, self.band, self.offsets, self.least = (x[self.order] for x in columns)
        self.more, self.prefix = [x[self.order] for x in self.more], self.prefix[self.order]
        everything = [(np.arange(self.n), self.roots), *self.starts]
        self.levels = []
        for rows, starts in everything:
            members, least = _level_nodes(rows, starts, self.conv)
            self.levels.append({"rows": rows, "starts": starts, "first": rows[starts], "n": members, "conv": least})
        for level, (above, here) in enumerate(zip(self.levels, self.levels[1:]), 1):
            here["parent"] = np.searchsorted(above["first"], here["first"], "right") - 1
            here["size"] = self.size[self.offsets[here["first"]] + level - 1]
        for level in range(len(self.levels) - 1, -1, -1):
            here = self.levels[level]
            count = len(here["first"])
            children = leaves = saved = np.zeros(count, np.int64)
            if level + 1 < len(self.levels):
                below = self.levels[level + 1]
                n = np.bincount(below["parent"], minlength=count)
                at = np.cumsum(n) - n
                children, leaves, saved = n, segment_sums(below["leaves"], at, n), segment_sums(below["saved"], at, n)
            on = np.zeros(count, bool)
            if level == self.depth:
                more = [np.add.reduceat(x[here["rows"]], here["starts"]) for x in self.more]
                children, leaves, saved = children + more[0], leaves + more[1], saved + more[2]
                on = np.logical_or.reduceat(self.goes_on[here["rows"]], here["starts"])
            here["children"], here["goes_on"] = children, on
            here["below"] = leaves, saved
            here["own"] = ((children == 0) & ~on).astype(np.int64), (here["n"] - 1) * here["size"] if level else np.zeros(count, np.int64)
            here["leaves"], here["saved"] = leaves + here["own"][0], saved + here["own"][1]

    def edge_path(self, row: int) -> list[int]:
        """Nodes of a row, level by level."""
        return [int(np.searchsorted(self.levels[k]["first"], row, "right")) - 1 for k in range(self.length[row] + 1)]

    def key(self, row: int, level: int) -> bytes:
        at = int(self.offsets[row])
        return hashlib.md5(b"%d," % self.band[row] + self.prefix[row].tobytes() + self.ids[at:at + level].tobytes()).digest()


def _joined(ids: np.ndarray) -> str:
    return ",".join(map(str, ids.tolist()))


def _shard_rows(table: pa.Table, depth: int, columns: int, step: int):
    """Batches of _NODE: 0 whole nodes, 1 whole nodes below a node of the shard's edge, 2 parts of edge nodes, 3 parts of the lists of members that end at one."""
    shard = _Shard(table, depth, columns)
    if not shard.n:
        return
    first, last = shard.edge_path(0), shard.edge_path(shard.n - 1)
    keys = [{} for _ in shard.levels]
    for row, path in ((0, first), (shard.n - 1, last)):
        for level, node in enumerate(path):
            keys[level][node] = shard.key(row, level)
    for level, here in enumerate(shard.levels):
        count = len(here["first"])
        edge = np.zeros(count, bool)
        edge[list(keys[level])] = True
        parent = here.get("parent", np.zeros(count, np.int64))
        parent_conv = shard.levels[level - 1]["conv"][parent] if level else np.zeros(count, np.int64)
        kind = np.where(edge, 2, 0)
        if level:
            under = np.zeros(len(shard.levels[level - 1]["first"]), bool)
            under[list(keys[level - 1])] = True
            named = (shard.band[here["first"]] > 0) & (level == 1)
            parent_conv = np.where(named, shard.least[here["first"]], parent_conv)
            kind[~edge & under[parent] & ~named] = 1
        # members that end here are a node's first rows; members of an edge node that touch the shard's edge go out in parts
        ended = segment_sums((shard.length[here["rows"]] == level).astype(np.int64), here["starts"], here["n"]) if count else np.zeros(0, np.int64)
        if level == depth:
            ended = ended - segment_sums(shard.goes_on[here["rows"]].astype(np.int64), here["starts"], here["n"])
        ends, parts = [_EMPTY] * count, []
        for k in np.flatnonzero(ended > 0):
            own = here["first"][k] + np.arange(here["n"][k] if level == depth else ended[k])
            if level == depth:
                own = own[~shard.goes_on[own]]
            ids = np.sort(shard.conv[own])
            if edge[k] and (level == depth or own[0] == 0 or own[-1] == shard.n - 1):
                ends[k] = None
                parts += [(keys[level][int(k)], int(ids[i]), _joined(ids[i:i + step])) for i in range(0, len(ids), step)]
            else:
                ends[k] = hashlib.sha256(_joined(ids).encode()).hexdigest()
        for k in np.flatnonzero(edge & (ended == 0)):
            ends[k] = None
        edge_child = np.zeros(count, np.int64)
        if level + 1 < len(shard.levels):
            below = shard.levels[level + 1]
            for node in keys[level + 1]:
                edge_child[below["parent"][node]] += 1
        # what hangs below an edge node without its edge descendants
        sums = [x.copy() for x in here["below"]]
        for node in keys[level]:
            for s in (0, 1):
                sums[s][node] = _apart(shard, keys, level, node, s)
        whole = kind < 2
        above = [None] * count
        for node in keys[level]:
            row = here["first"][node]
            above[node] = [shard.key(row, k) for k in range(level + 1)]
        yield pa.RecordBatch.from_pydict({
            "kind": pa.array(kind, pa.int32()), "key": pa.array([keys[level].get(k) for k in range(count)], pa.binary()),
            "parent": pa.array([keys[level - 1].get(int(p)) if level else None for p in parent], pa.binary()),
            "band": pa.array(shard.band[here["first"]], pa.int64()), "level": pa.array(np.full(count, level), pa.int32()), "conv_id": pa.array(here["conv"], pa.int64()),
            "parent_conv": pa.array(parent_conv, pa.int64()),
            "n_convs": pa.array(here["n"], pa.int64()), "n_children": pa.array(here["children"] - edge_child, pa.int64()),
            "n_leaves": pa.array(np.where(whole, here["leaves"], sums[0]), pa.int64()), "saved_tokens": pa.array(np.where(whole, here["saved"], sums[1]), pa.int64()),
            "size": pa.array(here["size"] if level else np.zeros(count, np.int64), pa.int64()), "ends": pa.array(ends, pa.string()),
            "above": pa.array(above, pa.list_(pa.binary())), "goes_on": pa.array(here["goes_on"], pa.bool_())})
        if parts:
            n = len(parts)
            none = pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_pydict({
                "kind": pa.array([3] * n, pa.int32()), "key": pa.array([p[0] for p in parts], pa.binary()), "parent": pa.nulls(n, pa.binary()), "band": none, "level": pa.nulls(n, pa.int32()),
                "conv_id": pa.array([p[1] for p in parts], pa.int64()), **{x: none for x in ("parent_conv", "n_convs", "n_children", "n_leaves", "saved_tokens", "size")},
                "ends": pa.array([p[2] for p in parts], pa.string()), "above": pa.nulls(n, pa.list_(pa.binary())), "goes_on": pa.nulls(n, pa.bool_())})


def _apart(shard: _Shard, keys: list[dict], level: int, node: int, which: int) -> int:
    """Sum over the subtree of an edge node, without it and without edge nodes below; what deeper bands add stays in."""
    total = int(shard.levels[level]["below"][which][node])
    if level + 1 < len(shard.levels):
        below = shard.levels[level + 1]
        for child in keys[level + 1]:
            if below["parent"][child] == node:
                total -= int(below["leaves" if which == 0 else "saved"][child])
                total += _apart(shard, keys, level + 1, child, which)
    return total


# -- all shards

def _spread(rows: DataFrame) -> DataFrame:
    """Nodes and parts of nodes of all shards, written once."""
    wanted = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = max(wanted, -(-rows.count() // SHARD_ROWS))
    line = ("band", "prefix", "ids", "conv_id")
    ordered = rows.select("band", "prefix", "ids", "sizes", "conv_id", "least", "goes_on", "more_children", "more_leaves", "more_saved").repartitionByRange(shards, *line)

    sizes = BAND, COLUMNS, max(1, PART_CHARS // 20)

    def run(batches):
        own = [batch for batch in batches if batch.num_rows]
        if own:
            yield from _shard_rows(pa.Table.from_batches(own), *sizes)

    return cut_lineage(ordered.mapInArrow(run, _NODE))


def _list_digests(parts: DataFrame) -> DataFrame:
    """(key, ends): digest of each list from its parts in order, a part at a time."""
    def run(batches):
        now, sha, out = None, None, []
        for batch in batches:
            for key, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if key != now:
                    if now is not None:
                        out.append((now, sha.hexdigest()))
                    now, sha = key, hashlib.sha256(part.encode())
                else:
                    sha.update(b"," + part.encode())
        if now is not None:
            out.append((now, sha.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.string())], names=["key", "ends"])

    return parts.select("key", "ends", "conv_id").repartition("key").sortWithinPartitions("key", "conv_id").select("key", "ends").mapInArrow(run, "key binary, ends string")


def _recombined(rows: DataFrame) -> DataFrame:
    """(band, level, conv_id, parent_conv, n_convs, n_children, n_leaves, saved_tokens, ends) of every node of every band."""
    found = _spread(rows)
    lists = _list_digests(found.where("kind = 3")).select(F.col("key").alias("k"), F.col("ends").alias("listed"))
    parts = found.where("kind = 2").groupBy("key").agg(
        F.first("parent").alias("parent"), F.first("band").alias("band"), F.first("level").alias("level"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"),
        F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"), F.first("size").alias("size"),
        F.max("ends").alias("ends"), F.first("above").alias("above"), F.max("goes_on").alias("goes_on"), F.first("parent_conv").alias("part_conv"))
    parts = cut_lineage(parts)
    shared = parts.where("parent is not null").groupBy(F.col("parent").alias("k")).agg(F.count("*").alias("n_shared"))
    merged = (parts.join(shared, F.col("key") == F.col("k"), "left").drop("k").join(lists, F.col("key") == F.col("k"), "left").drop("k")
              .withColumn("n_children", F.col("n_children") + F.coalesce("n_shared", F.lit(0)))
              .withColumn("ends", F.coalesce("listed", "ends", F.lit(_EMPTY)))
              .withColumn("own_leaf", ((F.col("n_children") == 0) & ~F.col("goes_on")).cast("long")).withColumn("own_saved", F.when(F.col("level") > 0, (F.col("n_convs") - 1) * F.col("size")).otherwise(0)))
    merged = cut_lineage(merged)
    sums = merged.select(F.explode("above").alias("k"), "own_leaf", "own_saved").groupBy("k").agg(F.sum("own_leaf").alias("leaves"), F.sum("own_saved").alias("saved"))
    names = merged.select(F.col("key").alias("p"), F.col("conv_id").alias("p_conv"))
    edge = (merged.join(sums, F.col("key") == F.col("k")).join(names, F.col("parent") == F.col("p"), "left")
            .select("band", "level", "conv_id", F.when((F.col("band") > 0) & (F.col("level") == 1), F.col("part_conv")).otherwise(F.col("p_conv")).alias("parent_conv"), "n_convs", "n_children", (F.col("n_leaves") + F.col("leaves")).alias("n_leaves"),
                    (F.col("saved_tokens") + F.col("saved")).alias("saved_tokens"), "ends"))
    plain = [c for c in edge.columns]
    below = found.where("kind = 1").drop("parent_conv").join(names.withColumnRenamed("p_conv", "parent_conv"), F.col("parent") == F.col("p"))
    return found.where("kind = 0").select(*plain).unionByName(below.select(*plain)).unionByName(edge)


def trie(turns: DataFrame) -> DataFrame:
    """One row a node of turns (conv_id, place, id, size) in order, see `bands`: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)."""
    nothing = {x: F.lit(0).cast("long") for x in ("more_children", "more_leaves", "more_saved")}
    rows = cut_lineage(bands(turns))
    # what hangs below: every later band's subtries, each at its smallest member
    tops = _recombined(rows.where("band > 0").withColumns(nothing)).where("level = 0")
    later = rows.where("goes_on or band > 0").select("conv_id", "band")
    behind = (later.join(tops.select("conv_id", "band", "n_children", F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved")), ["conv_id", "band"], "left"))
    after = Window.partitionBy("conv_id").orderBy("band").rowsBetween(1, Window.unboundedFollowing)
    extra = (behind.select("conv_id", "band", F.lead("n_children").over(Window.partitionBy("conv_id").orderBy("band")).alias("more_children"),
                           F.sum("leaves").over(after).alias("more_leaves"), F.sum("saved").over(after).alias("more_saved"))
             .where("more_children is not null or more_leaves is not null"))
    extra = cut_lineage(extra)
    whole = rows.join(extra, ["conv_id", "band"], "left").withColumns({x: F.coalesce(x, F.lit(0)).cast("long") for x in nothing})
    return (_recombined(whole).where("band = 0 or level > 0")
            .select("conv_id", (F.col("band") * BAND + F.col("level")).cast("long").alias("depth"),
                    F.when((F.col("band") > 0) | (F.col("level") > 0), F.col("parent_conv")).alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
                    F.col("ends").alias("ends_sha256")))


def with_marks(turns: DataFrame) -> DataFrame:
    """Turns of `turn_rows` in order and a row without an id before each conversation, as `bands` takes them."""
    mark = turns.select("conv_id").distinct().select("conv_id", F.lit(0).alias("first"), *[F.lit(None).cast(turns.schema[c].dataType).alias(c) for c in ("turn", "role", "id", "size")])
    return numbered(turns.withColumn("first", F.lit(1)).unionByName(mark), "conv_id", ["first", "turn", "role", "id"], "place")


def conversation_trie(conversations: DataFrame, group: int = 0, heads: int = 9) -> DataFrame:
    """Trie of whole conversations; with a `group`, of conversations whose first turns are borrowed as `rebuilt` says."""
    turns = cut_lineage(turn_rows(conversations))
    if not group:
        return trie(with_marks(turns))
    placed = cut_lineage(numbered(turns, "conv_id", ["turn", "role", "id"], "at"))
    return trie(numbered(rebuilt(placed, group, heads), "conv_id", ["first", "at"], "place"))
