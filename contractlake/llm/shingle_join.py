"""N-gram Jaccard join with vertical partitioning, giving connected components of near duplicates.

A document's set holds its distinct runs of five words (a shorter text: one run of all words), as 48-bit hashes. Two sets link when
100 * intersection >= 75 * union. The steps:

1. Vertical cut for counting: blocks of documents send their hashes, cut by hash range, to one task a range, which counts in how many sets
   each hash occurs and sends the counts back to the blocks. Blocks hold a bounded number of hashes; a hash that many documents
   of a block share travels once with the list of them, and equal sets of a block travel once.
2. A set can only link when 75 % of its hashes occur in other sets too; all others leave here. The rest keep their shared hashes in
   global order, rarest first, and index the prefix of it that any linked set must meet (n - ceil(0.75 n) + 1 places, those without
   partner counted).
3. Each set is compared with its best hub: of the first set in each bucket it is in (the one with the fewest hashes of its own), the one
   it meets most often. The linked ones make components.
4. Buckets that still hold several components are compared in full, but without listing their pairs: sets tied by such buckets make a region;
   within it every set outside the largest component is compared, in tiles of bounded size, with all others of the region. Only links
   between components leave a tile. So large groups of near copies cost one comparison with the hub for most members, and
   no link that could join two components is left out.
5. Vertical cut for comparing, in 3 and in 4: the hashes of the sets are cut into ranges of the hash order; partial overlaps are counted range by range,
   and summed up per pair.

A hash collision could miscount one run; with 48 bits that has a chance of about 1e-9 for a pair of sets of 500 runs.
Null or empty texts and texts without words have the empty set and link with nothing; a null doc_id too, and its component is null. Repeated rows link
through their equal sets. `docs` must be read from a table, so that a lost task sees the same rows again.
Texts of any length are read whole, a long one as a slice of its own. Only `doc_id` and `text` are read, so other columns may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .arrays import U64, Words, mix, segment_sums, shingles, slices, text_bytes
from .frames import components

SIZE = 5
PERCENT = 75
BITS = 48
BLOCK_TOKENS = 800_000
BLOCK_DOCS = 60_000
# Tokens that one counting task gathers, on average.
RANGE_TOKENS = 1_000_000
FRAGMENTS = 4
MEMBERS_PER_TASK = 256
# Sets on either side of a tile.
TILE_ASKED, TILE_INDEXED = 1000, 4000


def _planes(values: np.ndarray) -> bytes:
    """Bytes of integers, first all lowest bytes, then the next."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def _from_planes(data: memoryview, n: int, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, n).T).view(kind).ravel()


def _packed(*columns: np.ndarray) -> bytes:
    sizes = np.array([len(c) for c in columns], "<u4")
    return zstandard.ZstdCompressor(level=1).compress(sizes.tobytes() + b"".join(_planes(c) for c in columns))


def _unpacked(blob: bytes, *kinds: str) -> list[np.ndarray]:
    data = memoryview(zstandard.ZstdDecompressor().decompress(blob))
    sizes = np.frombuffer(data[:4 * len(kinds)], "<u4").tolist()
    out, at = [], 4 * len(kinds)
    for n, kind in zip(sizes, kinds):
        width = np.dtype(kind).itemsize * n
        out.append(_from_planes(data[at:at + width], n, kind))
        at += width
    return out


def sets_of(batch: pa.RecordBatch, size: int = SIZE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document number, hash) of the distinct runs ordered by both, and two digests of each document's set."""
    data, offsets = text_bytes(batch.column(batch.schema.get_field_index("text")))
    doc, token = shingles(Words(data, offsets), size)
    token = token >> U64(64 - BITS)
    order = np.lexsort((token, doc))
    doc, token = doc[order], token[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (token[1:] != token[:-1])
    doc, token = doc[new], token[new]
    counts = np.bincount(doc, minlength=batch.num_rows)
    first = np.cumsum(counts) - counts
    return doc, token, segment_sums(mix(token + U64(1)), first, counts) ^ mix(counts.astype(U64)), segment_sums(mix(token ^ U64(0x5BD1E9955BD1E995)), first, counts)


def _least_overlap(n: np.ndarray | int, percent: int):
    return -(-n * percent // 100)


class _Block:
    """Documents of a task gathered until they make a block."""

    def __init__(self, key: int):
        self.key, self.docs, self.tokens = key, 0, 0
        self.parts: list[tuple] = []

    def add(self, ids: pa.Array, doc: np.ndarray, token: np.ndarray, d1: np.ndarray, d2: np.ndarray) -> None:
        self.parts.append((ids, doc + self.docs, token, d1, d2))
        self.docs += len(d1)
        self.tokens += len(token)

    def rows(self, range_bits: int) -> pa.RecordBatch:
        """One row with what is known of the documents, and one for each range of hashes."""
        ids = pa.concat_arrays([p[0] for p in self.parts])
        doc, token, d1, d2 = (np.concatenate([p[k] for p in self.parts]) for k in (1, 2, 3, 4))
        counts = np.bincount(doc, minlength=self.docs)
        known = ~np.asarray(ids.is_null())
        number = ids.fill_null(0).to_numpy()
        # the set of several equal ones that stands for them: that of the smallest id
        order = np.lexsort((number, ~known, d2, d1))
        change = np.ones(self.docs, bool)
        change[1:] = (d1[order][1:] != d1[order][:-1]) | (d2[order][1:] != d2[order][:-1])
        lead = np.zeros(self.docs, bool)
        lead[order[change]] = True
        lead &= known & (counts > 0)
        head = _packed(number.astype("<i8"), known.astype("u1"), counts.astype("<u4"), d1.astype("<u8"), lead.astype("u1"))
        stay = lead[doc]
        doc, token = doc[stay], token[stay]
        order = np.argsort(token, kind="stable")
        doc, token = doc[order].astype("<u2"), token[order]
        first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
        times = np.diff(np.append(first, len(token)))
        token = token[first]
        part = (token >> U64(BITS - range_bits)).astype(np.int64)
        cuts = np.searchsorted(part, np.arange((1 << range_bits) + 1))
        ends = np.append(first, len(doc))
        # heads are dealt by a hash: the key itself counts from the same number in every task
        parts, blobs = [int(mix(np.array([self.key], U64))[0] >> U64(64 - range_bits))], [b"\x00" + head]
        for p in np.unique(part).tolist():
            a, b = cuts[p], cuts[p + 1]
            blob = _packed(np.diff(token[a:b], prepend=U64(0)).astype("<u8"), times[a:b].astype("<u2"), doc[ends[a]:ends[b]])
            parts.append(p)
            blobs.append(b"\x01" + blob)
        return pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array([self.key] * len(parts), pa.int64()), pa.array(blobs, pa.binary())], names=["part", "block", "blob"])


def _send(size: int, range_bits: int):
    def run(batches):
        base, block = TaskContext.get().partitionId() << 32, None
        count = 0
        for batch in batches:
            for part in slices(batch):
                if block is None:
                    block = _Block(base + count)
                block.add(part.column(0), *sets_of(part, size))
                if block.tokens >= BLOCK_TOKENS or block.docs >= BLOCK_DOCS - 10_000:
                    yield block.rows(range_bits)
                    block, count = None, count + 1
        if block is not None:
            yield block.rows(range_bits)
    return run


def _count(table: pa.Table) -> pa.Table:
    """In how many sets each hash of a range occurs, answered to the blocks it came from."""
    blocks, blobs = table.column("block").to_pylist(), table.column("blob").to_pylist()
    out = [(k, b) for k, b in zip(blocks, blobs) if b[0] == 0]
    asked = [(k, *_unpacked(b[1:], "<u8", "<u2", "<u2")) for k, b in zip(blocks, blobs) if b[0] == 1]
    if asked:
        tokens = [np.cumsum(a[1], dtype=U64) for a in asked]
        every, where = np.unique(np.concatenate(tokens), return_inverse=True)
        total = np.bincount(where, np.concatenate([a[2] for a in asked]), len(every)).astype(np.int64)
        # 0: in one set only; otherwise the size of the count in bits, which orders hashes by how common they are
        code = np.where(total > 1, np.ceil(np.log2(np.maximum(total, 2))), 0).astype("u1")[where]
        at = 0
        for (key, _, times, docs), token in zip(asked, tokens):
            own = code[at:at + len(token)]
            at += len(token)
            shared = own > 0
            alone = docs[np.repeat(~shared, times)]
            lone_docs, lone = np.unique(alone, return_counts=True)
            out.append((key, b"\x01" + _packed(lone_docs.astype("<u2"), lone.astype("<u4"), token[shared].astype("<u8"), own[shared], times[shared].astype("<u2"), docs[np.repeat(shared, times)])))
    return pa.table({"block": pa.array([k for k, _ in out], pa.int64()), "blob": pa.array([b for _, b in out], pa.binary())})


def _gather(percent: int):
    def run(table: pa.Table) -> pa.Table:
        """Documents of one block, with the shared hashes (rarest first, 6 bytes each) of the sets that may link."""
        blobs = table.column("blob").to_pylist()
        number, known, counts, d1, lead = next(_unpacked(b[1:], "<i8", "u1", "<u4", "<u8", "u1") for b in blobs if b[0] == 0)
        answers = [_unpacked(b[1:], "<u2", "<u4", "<u8", "u1", "<u2", "<u2") for b in blobs if b[0] == 1]
        alone = np.zeros(len(counts), np.int64)
        for docs, lone, *_ in answers:
            alone[docs] += lone
        n = counts.astype(np.int64)
        may = (lead > 0) & (n - alone >= _least_overlap(n, percent))
        tokens: list = [None] * len(n)
        if answers and may.any():
            times = np.concatenate([a[4] for a in answers])
            docs = np.concatenate([a[5] for a in answers])
            token, code = np.repeat(np.concatenate([a[2] for a in answers]), times), np.repeat(np.concatenate([a[3] for a in answers]), times)
            stay = may[docs]
            docs, token, code = docs[stay], token[stay], code[stay]
            order = np.lexsort((token, code, docs))
            docs, token = docs[order], token[order]
            body = np.ascontiguousarray(token.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes()
            ends = np.searchsorted(docs, np.arange(len(n) + 1))
            for k in np.flatnonzero(may):
                tokens[k] = body[6 * ends[k]:6 * ends[k + 1]]
        return pa.table({"doc_id": pa.array(number, mask=known == 0), "node": pa.array(d1.view(np.int64)), "n": pa.array(n), "tokens": pa.array(tokens, pa.binary())})
    return run


def _tokens(body: bytes) -> np.ndarray:
    wide = np.zeros((len(body) // 6, 8), np.uint8)
    wide[:, 2:] = np.frombuffer(body, np.uint8).reshape(-1, 6)
    return wide.view(">u8").ravel().astype(np.int64)


def _prefixes(percent: int):
    def run(batches):
        """(token, node, alone): the shared hashes in each set's prefix; alone: how many of its hashes no other set has."""
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                nodes, sizes, bodies = (c.to_pylist() for c in part.columns)
                own = [_tokens(b[:6 * max(0, len(b) // 6 - int(_least_overlap(n, percent)) + 1)]) for b, n in zip(bodies, sizes)]
                counts = [len(x) for x in own]
                alone = np.array(sizes, np.int64) - np.array([len(b) // 6 for b in bodies], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own)), pa.array(np.repeat(np.array(nodes, np.int64), counts)), pa.array(np.repeat(alone, counts))], names=["token", "node", "alone"])
    return run


def _hubs(batches):
    """(a, hub, met) of rows sorted by token and rank: the bucket's first set is the hub of the others. Sums up what one batch holds."""
    token = hub = None
    for batch in batches:
        tokens, nodes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        first = np.ones(len(tokens), bool)
        first[1:] = tokens[1:] != tokens[:-1]
        if token is not None and len(tokens):
            first[0] = tokens[0] != token
        group = np.cumsum(first) - 1
        lead = np.concatenate([[hub if hub is not None else 0], nodes[first]])[group + 1]
        other = lead != nodes
        pairs, met = np.unique(np.column_stack([nodes[other], lead[other]]), axis=0, return_counts=True) if other.any() else (np.zeros((0, 2), np.int64), np.zeros(0, np.int64))
        if len(tokens):
            token, hub = tokens[-1], lead[-1]
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(met)], names=["a", "hub", "met"])


def _tile(rows: list[tuple], percent: int) -> list[tuple[int, int]]:
    """Links between components from the asked sets of a tile to its indexed ones; rows of (asked, node, component, n, tokens)."""
    sides = [{r[1]: r for r in rows if r[0] == asked} for asked in (False, True)]
    index, asked = (list(side.values()) for side in sides)
    if not index or not asked:
        return []
    tokens = [_tokens(r[4]) for r in index]
    which = np.repeat(np.arange(len(index)), [len(t) for t in tokens])
    every = np.concatenate(tokens)
    order = np.argsort(every, kind="stable")
    every, which = every[order], which[order]
    sizes, parts = np.array([r[3] for r in index]), np.array([r[2] for r in index])
    bounds = np.arange(FRAGMENTS + 1) << (BITS - (FRAGMENTS - 1).bit_length())
    joined: dict[int, int] = {}

    def root(c: int) -> int:
        while joined.get(c, c) != c:
            c = joined[c]
        return c

    out = []
    for _, node, component, n, body in asked:
        own = np.sort(_tokens(body))
        both = np.zeros(len(index), np.int64)
        for f in range(FRAGMENTS):  # partial overlaps with all indexed sets, one range of the hash order after the other
            some = own[np.searchsorted(own, bounds[f]):np.searchsorted(own, bounds[f + 1])]
            low, high = np.searchsorted(every, some), np.searchsorted(every, some, "right")
            times = high - low
            both += np.bincount(which[np.repeat(low - (np.cumsum(times) - times), times) + np.arange(times.sum())], minlength=len(index))
        for y in np.flatnonzero((parts != component) & (100 * both >= percent * (sizes + n - both))):
            a, b = root(component), root(int(parts[y]))
            if a != b:
                joined[max(a, b)] = min(a, b)
                out.append((max(node, index[y][1]), min(node, index[y][1])))
    return out


def _tiles(percent: int):
    def run(batches):
        """(a, hub) links of tiles; rows sorted by tile."""
        key, held = None, []
        for batch in batches:
            out = []
            for region, x, y, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if key != (region, x, y):
                    out += _tile(held, percent)
                    key, held = (region, x, y), []
                held.append(tuple(row))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], names=["a", "hub"])
        out = _tile(held, percent)
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], names=["a", "hub"])
    return run


def _cut(batches):
    """Rows of a set's hashes, cut into ranges of the hash order."""
    for batch in batches:
        for k in range(0, batch.num_rows, 500):
            part = batch.slice(k, 500)
            hubs, salts, members, nodes, sizes, bodies = (c.to_pylist() for c in part.columns)
            rows: list[tuple] = []
            for hub, salt, member, node, n, body in zip(hubs, salts, members, nodes, sizes, bodies):
                own = np.sort(_tokens(body))
                cuts = np.searchsorted(own, np.arange(FRAGMENTS + 1) << (BITS - (FRAGMENTS - 1).bit_length()))
                rows += [(hub, salt, f, member, node, n, own[a:b].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()) for f, (a, b) in enumerate(zip(cuts, cuts[1:]))]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["hub", "salt", "fragment", "member", "node", "n", "segment"])


def _segment(body: bytes) -> np.ndarray:
    wide = np.zeros((len(body) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(body, np.uint8).reshape(-1, 6)
    return wide.view("<u8").ravel()


def _overlaps(batches):
    """Partial overlaps of members with their hub; each hub's row comes before its members', equal rows follow each other."""
    key = own = hub_n = last = None
    for batch in batches:
        rows = []
        for hub, salt, fragment, member, node, n, body in zip(*(c.to_pylist() for c in batch.columns)):
            if not member:
                if key != (hub, salt, fragment):
                    key, own, hub_n, last = (hub, salt, fragment), _segment(body), n, None
                continue
            if node == last:
                continue
            last = node
            other = _segment(body)
            both = 0
            if len(own) and len(other):
                at = np.minimum(np.searchsorted(own, other), len(own) - 1)
                both = int((own[at] == other).sum())
            rows.append((node, hub, n + hub_n, both))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], names=["a", "hub", "sizes", "both"])


def _compare(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, hub) that link: partial overlaps counted range by range and summed up."""
    salt = F.pmod(F.xxhash64("a"), F.ceil(F.col("members") / MEMBERS_PER_TASK))
    counted = pairs.join(pairs.groupBy("hub").agg(F.count("*").alias("members")), "hub").select("hub", salt.alias("salt"), "a")
    asked = counted.select("hub", "salt", F.lit(True).alias("member"), F.col("a").alias("node")).unionByName(
        counted.select("hub", "salt", F.lit(False).alias("member"), F.col("hub").alias("node")).distinct())
    rows = asked.join(sets, "node").select("hub", "salt", "member", "node", "n", "tokens")
    cut = rows.mapInArrow(_cut, "hub long, salt long, fragment int, member boolean, node long, n long, segment binary")
    dealt = cut.repartition("hub", "salt", "fragment").sortWithinPartitions("hub", "salt", "fragment", "member", "node")
    partial = dealt.mapInArrow(_overlaps, "a long, hub long, sizes long, both long")
    summed = partial.groupBy("a", "hub").agg(F.sum("both").alias("both"), F.first("sizes").alias("sizes"))
    return summed.where(F.col("both") * 100 >= (F.col("sizes") - F.col("both")) * percent).select("a", "hub")


def _best_hub(buckets: DataFrame, rank: Column) -> DataFrame:
    dealt = buckets.repartition("token").sortWithinPartitions("token", rank, "node").select("token", "node")
    met = dealt.mapInArrow(_hubs, "a long, hub long, met long").groupBy("a", "hub").agg(F.sum("met").alias("met"))
    return met.groupBy("a").agg(F.max(F.struct("met", "hub")).alias("best")).select("a", F.col("best.hub").alias("hub"))


def _compare_regions(sets: DataFrame, buckets: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """Links (a, hub) between components of sets that share a bucket."""
    named = buckets.select("token", "node").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = named.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("node").alias("hub")).where("low <> high").select("token", "hub")
    tied = cut_lineage(named.select("token", "node").join(mixed, "token").select("node", "hub").where("node <> hub").distinct())
    regions = components(tied, "node", "hub").withColumnRenamed("component", "region")
    members = cut_lineage(regions.join(groups, "node", "left").select("region", "node", F.coalesce("component", "node").alias("component")))
    sizes = members.groupBy("region", "component").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("region").agg(F.max(F.struct("n", "component"))["component"].alias("largest"), F.sum("n").alias("indexed"), F.max("n").alias("most"))
    plan = largest.select("region", "largest", F.ceil((F.col("indexed") - F.col("most")) / TILE_ASKED).alias("xs"), F.ceil(F.col("indexed") / TILE_INDEXED).alias("ys"))
    placed = members.join(plan, "region").withColumns({"x": F.pmod(F.xxhash64("node"), "xs"), "y": F.pmod(F.xxhash64("node", F.lit(1)), "ys")})
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    asked = placed.where("component <> largest").select("region", "x", each("ys").alias("y"), F.lit(True).alias("asked"), "node", "component")
    indexed = placed.select("region", each("xs").alias("x"), "y", F.lit(False).alias("asked"), "node", "component")
    rows = asked.unionByName(indexed).join(sets, "node").select("region", "x", "y", "asked", "node", "component", "n", "tokens")
    dealt = rows.repartition("region", "x", "y").sortWithinPartitions("region", "x", "y", "asked", "node")
    return dealt.mapInArrow(_tiles(percent), "a long, hub long")


def _range_bits(docs: DataFrame) -> int:
    """Ranges so that each gets about `RANGE_TOKENS`; a word with its space is taken as 6 bytes."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(3, int(np.ceil(np.log2(max(1, size / 6 / RANGE_TOKENS)))))


def near_duplicates(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs(doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sent = docs.mapInArrow(_send(size, _range_bits(docs)), "part long, block long, blob binary")
    counted = sent.groupBy("part").applyInArrow(_count, "block long, blob binary")
    known = cut_lineage(counted.groupBy("block").applyInArrow(_gather(percent), "doc_id long, node long, n long, tokens binary"))
    sets = known.where("tokens is not null").select("node", "n", "tokens")

    buckets = cut_lineage(sets.mapInArrow(_prefixes(percent), "token long, node long, alone long"))
    first = cut_lineage(_compare(sets, _best_hub(buckets, F.col("alone")), percent))
    groups = cut_lineage(components(first, "a", "hub"))
    late = cut_lineage(_compare_regions(sets, buckets, groups, percent))
    if late.limit(1).count():
        groups = cut_lineage(components(first.unionByName(late), "a", "hub"))

    docs_known = known.select("doc_id", "node", "n")
    named = docs_known.where("n > 0 and doc_id is not null").select("node", "doc_id").groupBy("node").agg(F.min("doc_id").alias("least"))
    rooted = cut_lineage(named.join(groups, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component")))
    labels = rooted.groupBy("component").agg(F.min("least").alias("component_id"))
    settled = cut_lineage(rooted.join(labels, "component").select("node", "component_id"))
    linked = docs_known.where("n > 0 and doc_id is not null").join(settled, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return linked.unionByName(docs_known.where("not (n > 0 and doc_id is not null)").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
