"""Near-duplicate vectors by a pigeonhole join over subspaces.

Unit vectors with cosine c or more are at a squared distance of 2 - 2c at most. A fixed orthogonal rotation spreads the coordinates;
they are split into blocks of a few dimensions, and the budget in proportion to their sizes. Two linked vectors must keep to
the budget in at least one block, so the union of the blocks' range joins holds every link. The vectors are dealt into chunks, each written as one row; two
chunks meet in a tile, which reads them where they lie and does the range joins of all blocks: a vector travels once, however many blocks, cells and chunks there are. In each block a grid over the first two
coordinates, as wide as the block's radius, brings vectors together by equality: a vector stays at home in its cell and visits the neighbouring cells
(half of them where a chunk meets itself). Pairs that keep to the block's budget are candidates, and
the cosine of the candidates is worked out in double precision from the vectors as given.

No pair leaves its tile. A pair that several blocks find counts in the first block whose budget it keeps to. A tile sums the links of each of its vectors
and joins its linked vectors to stars, so it gives as many rows as it has vectors, however many of them are near copies.

Equal vectors are one class and are compared once; the class with all its rows counts as linked. A vector that is null, zero, or
holds null or non-finite components links with nothing, and vectors of different lengths don't link. Rows of one id are one node; if they hold
different vectors, it has the links of all of them.
A null id gets no links and a null component.
Only the id and the vector are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..session import cut_lineage
from .frames import components

BLOCK = 8
# rows of a chunk at most, about; and from how many on vectors are dealt into more of them, so that more tasks share the tiles
TILE_ROWS = 32768
SHARED_ROWS, SHARES = 1024, 8
SLACK = 1e-9
SIFT = 1e-5
# Forward half of the neighbouring cells, and all of them; the vector itself is at home in (0, 0).
_VISITS = ((0, 1), (1, -1), (1, 0), (1, 1))
_ALL_VISITS = (*_VISITS, *((-x, -y) for x, y in _VISITS))


def rotation(size: int) -> np.ndarray:
    """The orthogonal matrix used for vectors of this length."""
    q, r = np.linalg.qr(np.random.default_rng(size).normal(size=(size, size)))
    return q * np.sign(np.diag(r))


def blocks(size: int, width: int = BLOCK) -> list[slice]:
    return [slice(a, min(a + width, size)) for a in range(0, size, width)]


def budget(block: slice, size: int, cosine: float) -> float:
    return (2 - 2 * cosine) * (block.stop - block.start) / size + SLACK


def _exact_squares(a: np.ndarray, b: np.ndarray) -> list[float]:
    """Squared distance of two vectors in each block, from correctly rounded sums: the same in every task."""
    size = len(a)
    a, b = ([x / math.sqrt(math.fsum(y * y for y in v)) for x in v] for v in (a.tolist(), b.tolist()))
    gap = [x - y for x, y in zip(a, b)]
    turned = [math.fsum(x * y for x, y in zip(gap, column)) for column in rotation(size).T.tolist()]
    return [math.fsum(x * x for x in turned[block]) for block in blocks(size)]


def counted_here(own: int, left: np.ndarray, right: np.ndarray, turned_left: np.ndarray, turned_right: np.ndarray, cosine: float) -> np.ndarray:
    """Whether `own` is the first block whose budget a pair keeps to, for pairs of vectors and of their turned unit vectors.

    The bar lies half the slack below what the blocks search, so the first block does find the pair. Sums that come close to the bar are worked out again
    by a rule that doesn't depend on the task.
    """
    size = left.shape[1]
    upto = blocks(size)[own].stop
    gaps = (turned_left[:, :upto] - turned_right[:, :upto]) ** 2
    bars = np.array([budget(block, size, cosine) - SLACK / 2 for block in blocks(size)[:own + 1]])
    squares = np.column_stack([gaps[:, block].sum(axis=1) for block in blocks(size)[:own + 1]])
    for k in np.flatnonzero((np.abs(squares - bars) < SLACK / 1000).any(axis=1)):
        squares[k] = _exact_squares(left[k], right[k])[:own + 1]
    keeps = squares <= bars
    return keeps[:, own] & ~keeps[:, :own].any(axis=1)


def hook(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots after the rows a and b are joined; the smallest row of each group is its root."""
    while True:
        a, b = root[a], root[b]
        apart = a != b
        if not apart.any():
            return root
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _cells(y: np.ndarray, radius: float, visits: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, cell and whether at home of every entry: each row in its cell and in those of `visits` that reach within the radius of it. A cell is one number."""
    plane = y[:, :2] if y.shape[1] > 1 else np.column_stack([y, np.zeros(len(y))])
    home = np.floor(plane / radius).astype(np.int64)
    inside = plane - home * radius
    far = [{1: radius - inside[:, k], 0: 0.0, -1: inside[:, k]} for k in (0, 1)]
    rows, cells = [np.arange(len(y))], [home]
    for dx, dy in visits:
        near = np.flatnonzero(far[0][dx] ** 2 + far[1][dy] ** 2 <= radius ** 2 + SLACK)
        rows.append(near)
        cells.append(home[near] + (dx, dy))
    at, cell = np.concatenate(rows), np.concatenate(cells)
    return at, (cell[:, 0] << 21) + cell[:, 1], np.arange(len(at)) < len(y)


def _join_block(own: int, left: np.ndarray, right: np.ndarray, turned: np.ndarray, cosine: float, same: bool):
    """Pairs of a row of `left` and one of `right` that may keep to a block's budget, in lots; each pair once, also if both are the same chunk."""
    block = blocks(turned.shape[1])[own]
    most = budget(block, turned.shape[1], cosine)
    radius = np.sqrt(most)
    y = turned[:, block]
    third = y[:, 2] if y.shape[1] > 2 else np.zeros(len(y))
    _, own_cell, _ = _cells(y[left], radius, ())
    order = np.lexsort((third[left], own_cell))
    left, own_cell = left[order], own_cell[order]
    at, cell, home = _cells(y[right], radius, _VISITS if same else _ALL_VISITS)
    # both sides by cells, and in a cell in order of the third coordinate, so that only rows within the radius of it are multiplied
    order = np.lexsort((third[right[at]], cell))
    right, cell, home = right[at[order]], cell[order], home[order]
    # one product gives squared distances; single precision only sifts, with room for its error
    square, ones = (y * y).sum(axis=1), np.ones(len(y))
    near = np.column_stack([-2 * y, square, ones]).astype(np.float32)[left]
    far = np.column_stack([y, ones, square]).astype(np.float32)[right]
    low, height, wide, bar = third[left], third[right], radius + SLACK, np.float32(most + SIFT)
    cells, begins = np.unique(own_cell, return_index=True)
    ends = np.append(begins[1:], len(left))
    starts, stops = np.searchsorted(cell, cells), np.searchsorted(cell, cells, "right")
    for k in np.flatnonzero(stops - starts > same):  # in its own chunk a row meets itself
        for first in range(begins[k], ends[k], 128):
            last = min(first + 128, ends[k])
            start = starts[k] + np.searchsorted(height[starts[k]:stops[k]], low[first] - wide)
            stop = starts[k] + np.searchsorted(height[starts[k]:stops[k]], low[last - 1] + wide, "right")
            for lot in range(start, stop, 4096):
                upto = min(lot + 4096, stop)
                p, q = np.divmod(np.flatnonzero(near[first:last] @ far[lot:upto].T <= bar), upto - lot)
                if len(p):
                    p, q, at_home = left[first + p], right[lot + q], home[lot + q]
                    once = (p < q) | ~at_home if same else slice(None)
                    yield p[once], q[once]


def _by_size(batch: pa.RecordBatch):
    """Parts of a batch whose vectors have one length."""
    sizes = np.array([len(x) for x in batch.column("body").to_pylist()])
    for size in np.unique(sizes):
        yield int(size), batch.take(pa.array(np.flatnonzero(sizes == size)))


def vector_classes(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, str]:
    """(id, key, body) of each row, key and body null where the vector can't link; and numpy's name of the components' type."""
    double = isinstance(vectors.schema[vector_col].dataType, ArrayType) and isinstance(vectors.schema[vector_col].dataType.elementType, DoubleType)
    kind = "<f8" if double else "<f4"

    def run(batches):
        for batch in batches:
            keys, bodies = [], []
            for one in batch.column(1):
                values = one.values
                ok = values is not None and len(values) and not values.null_count
                x = values.to_numpy(zero_copy_only=False).astype(kind) + 0 if ok else None
                if not ok or not np.isfinite(x).all() or not x.any():
                    keys.append(None)
                    bodies.append(None)
                else:
                    bodies.append(x.tobytes())
                    keys.append(hashlib.blake2b(bodies[-1], digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(bodies, pa.binary())], names=["id", "key", "body"])

    picked = vectors.select(F.col(id_col).cast("long").alias("id"), vector_col)
    found = picked.mapInArrow(run, "id long, key binary, body binary")
    return found.select("id", *[F.when(F.col("id").isNotNull(), F.col(c)).alias(c) for c in ("key", "body")]), kind


def links(reps: DataFrame, cosine: float, kind: str = "<f4", tile_rows: int = TILE_ROWS) -> DataFrame:
    """(id, m, root) of reps(id, n, body), a few rows for an id: the sum of m is the sum of n over all reps of that cosine or more, and the stars of id
    and root connect what links connect. `reps` is read twice."""
    sizes = reps.groupBy(F.length("body").alias("bytes")).agg(F.count("*").alias("n"))
    # vectors of a length with fewer rows are one chunk, so this doesn't grow with the number of lengths
    counted = sizes.where(F.col("n") > min(tile_rows, SHARED_ROWS)).collect()
    chunks = {r["bytes"]: max(-(-r["n"] // tile_rows), min(SHARES, -(-r["n"] // SHARED_ROWS))) for r in counted}
    sent = reps.sparkSession.sparkContext.broadcast(chunks)

    def deal(batches):
        for batch in batches:
            for size, part in _by_size(batch):
                chunk = (part.column("id").to_numpy() * 0x9E3779B1 >> 7) % sent.value.get(size, 1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(part.num_rows, size)), pa.array(chunk)] + [part.column(c) for c in ("id", "n", "body")], names=["size", "chunk", "id", "n", "body"])

    def pack(table: pa.Table) -> pa.Table:
        numbers = [table.column(c).to_numpy().tobytes() for c in ("id", "n")]
        return pa.table({"size": table.column("size")[:1], "chunk": table.column("chunk")[:1], "ids": pa.array([numbers[0]], pa.binary()), "counts": pa.array([numbers[1]], pa.binary()),
                         "bodies": pa.array([b"".join(table.column("body").to_pylist())], pa.binary())})

    def tile(ids: np.ndarray, n: np.ndarray, bodies: np.ndarray, upto: int) -> pa.RecordBatch:
        """The first `upto` rows are one chunk, the others the second; if there are no others, a chunk meets itself."""
        vectors = bodies.view(kind).reshape(len(ids), -1).astype(np.float64)
        same = upto == len(ids)
        turned = _unit(vectors) @ rotation(vectors.shape[1])
        length = np.linalg.norm(vectors, axis=1)
        left = np.arange(upto)
        right = left if same else np.arange(upto, len(ids))
        m, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for own in range(len(blocks(vectors.shape[1]))):
            for p, q in _join_block(own, left, right, turned, cosine, same):
                some = ids[p] != ids[q]
                p, q = p[some], q[some]
                for c in range(0, len(p), 4096):
                    a, b = p[c:c + 4096], q[c:c + 4096]
                    mine = counted_here(own, vectors[a], vectors[b], turned[a], turned[b], cosine)
                    a, b = a[mine], b[mine]
                    linked = np.einsum("ij,ij->i", vectors[a], vectors[b]) / (length[a] * length[b]) >= cosine
                    a, b = a[linked], b[linked]
                    np.add.at(m, a, n[b])
                    np.add.at(m, b, n[a])
                    root = hook(root, a, b)
        linked = np.flatnonzero(m)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[linked], m[linked], ids[root[linked]])], names=["id", "m", "root"])

    def join(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                sides = ("", "2") if batch.column("ids2")[k].is_valid else ("",)
                ids, n, bodies = (np.concatenate([np.frombuffer(batch.column(c + side)[k].as_buffer(), kind_) for side in sides])
                                  for c, kind_ in (("ids", np.int64), ("counts", np.int64), ("bodies", np.uint8)))
                yield tile(ids, n, bodies, len(batch.column("ids")[k].as_buffer()) // 8)

    dealt = reps.select("id", "n", "body").mapInArrow(deal, "size long, chunk long, id long, n long, body binary")
    # a file for nearly every chunk, so that nearly every tile is a task
    packed = cut_lineage(dealt.repartition(max(1, 4 * sum(chunks.values())), "size", "chunk").groupBy("size", "chunk").applyInArrow(pack, "size long, chunk long, ids binary, counts binary, bodies binary"))
    other = packed.select(*[F.col(c).alias(c + "2") for c in packed.columns]).hint("shuffle_replicate_nl")
    # equal lengths are told without an equality, by which Spark would shuffle the chunks
    met = packed.join(other, (F.col("size") <= F.col("size2")) & (F.col("size") >= F.col("size2")) & (F.col("chunk") <= F.col("chunk2")))
    tiles = met.select("ids", "counts", "bodies", *[F.when(F.col("chunk") < F.col("chunk2"), F.col(c)).alias(c) for c in ("ids2", "counts2", "bodies2")])
    return tiles.mapInArrow(join, "id long, m long, root long")


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept) of every row."""
    found, kind = vector_classes(vectors, id_col, vector_col)
    # the vectors themselves are kept once, one for each class
    rows = cut_lineage(found.select("id", "key"))
    reps = cut_lineage(found.where("key is not null").groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.first("body").alias("body")))
    linked = cut_lineage(links(reps, cosine, kind, TILE_ROWS))
    degrees = linked.groupBy("id").agg(F.sum("m").alias("m"))
    groups = components(linked, "id", "root").withColumnRenamed("node", "id")
    settled = cut_lineage(reps.select("key", "id", "n").join(degrees, "id", "left").join(groups, "id", "left")
                          .select("key", (F.col("n") - 1 + F.coalesce("m", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id")))
    return (rows.select("id", "key").join(settled, "key", "left")
            .select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
            .withColumn("kept", F.col(id_col) == F.col("component_id")))
