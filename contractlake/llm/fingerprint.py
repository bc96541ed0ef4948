"""Document fingerprints by content-defined chunking.

A gear hash of the last 32 bytes decides where a chunk may end. Chunk lengths are normalised: before the normal length a cut needs
more zero bits than after it, so lengths gather around it; no chunk is shorter than the least length (but for a text's last one)
or longer than the greatest. Cuts depend on nearby bytes only, so an insertion changes the chunks around it and leaves the others.

A fingerprint is the set of a text's chunk digests, each with its length; the likeness of one to another is containment: the share of
its distinct chunks, by length, that the other has too. Two empty fingerprints are alike (1), an empty and another are not (0).
Texts of any length are read whole, a long one as a slice of its own. Only `doc_id` and `text` are read, so other columns may have any name.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .arrays import U64, byte_table, mix, powers
from .frames import arrow_columns

LEAST, NORMAL, GREATEST = 24, 64, 256
HARD_BITS, EASY_BITS = 7, 5
WINDOW = 32
_GEAR = (byte_table(3) >> U64(32)).astype(np.uint32)
_DIGEST = byte_table(4)
_BATCH_BYTES = 2 << 20


def gear_hash(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hash of the last 32 bytes at each byte. Each text is preceded by 32 bytes of padding that count nothing; starts: where texts begin."""
    h = _GEAR[data]
    for k in range(1, WINDOW + 1):
        h[starts - k] = 0
    for step in (1, 2, 4, 8, 16):
        shifted = h[:-step] << np.uint32(step)
        h = h.copy()
        h[step:] += shifted
    return h


def _ends(n: int, places: list[int], hard: list[bool]) -> list[int]:
    """Chunk ends of a text of n bytes from the places where a chunk may end."""
    start, ends = 0, []
    for place, firm in zip(places, hard):
        while place - start > GREATEST:
            start += GREATEST
            ends.append(start)
        size = place - start
        if size >= NORMAL or firm and size >= LEAST:
            ends.append(place)
            start = place
    while n - start > GREATEST:
        start += GREATEST
        ends.append(start)
    if start < n:
        ends.append(n)
    return ends


def fingerprints(texts: Sequence[bytes]) -> list[np.ndarray]:
    """Sorted distinct chunks of each text: 56 bits of digest, then 8 bits of length less 1."""
    pad = bytes(WINDOW)
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(pad + pad.join(texts) + pad, np.uint8)
    starts = WINDOW + np.cumsum(sizes + WINDOW) - sizes - WINDOW
    h = gear_hash(data, np.append(starts, len(data)))
    easy = np.flatnonzero(h < np.uint32(1 << (32 - EASY_BITS)))
    hard = h[easy] < np.uint32(1 << (32 - HARD_BITS))
    low, high = np.searchsorted(easy, starts), np.searchsorted(easy, starts + sizes)
    counts, ends = [], []
    for start, n, a, b in zip(starts.tolist(), sizes.tolist(), low.tolist(), high.tolist()):
        own = _ends(n, (easy[a:b] + (1 - start)).tolist(), hard[a:b].tolist())
        counts.append(len(own))
        ends.extend(own)
    counts = np.array(counts, np.int64)
    stop = np.array(ends, np.int64) + np.repeat(starts, counts)
    first = np.cumsum(counts) - counts
    begin = np.empty_like(stop)
    if len(stop):
        begin[1:] = stop[:-1]
        begin[first[counts > 0]] = starts[counts > 0]
    up, down = powers(len(data))
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(_DIGEST[data] * up[:len(data)], out=total[1:])
    digest = mix((total[stop] - total[begin]) * down[begin] + (stop - begin).astype(U64))
    chunk = digest & U64(0xFFFFFFFFFFFFFF00) | (stop - begin - 1).astype(U64)
    return [np.unique(x) for x in np.split(chunk, np.cumsum(counts)[:-1])] if len(texts) else []


def likeness(own: np.ndarray, other: np.ndarray) -> float:
    """Share of own's chunks, by length, that other has too."""
    if not len(own) or not len(other):
        return float(len(own) == len(other))
    length = (own & U64(0xFF)).astype(np.int64) + 1
    at = np.minimum(np.searchsorted(other, own), len(other) - 1)
    return float(length[other[at] == own].sum() / length.sum())


def text_of(chunks: np.ndarray) -> str:
    return base64.b64encode(chunks.astype("<u8").tobytes()).decode()


def chunks_of(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), "<u8")


def with_fingerprint(docs: DataFrame, fingerprint: str = "fingerprint") -> DataFrame:
    """docs with the fingerprint of each whole text; a null or empty text has the empty one."""
    def setup():
        def work(batch):
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            return [pa.array([text_of(c) for c in fingerprints([(t or "").encode() for t in texts])], pa.string())]
        return work
    return arrow_columns(docs, [(fingerprint, "string")], setup)


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(rows: list[tuple]) -> list[tuple]:
    """Result rows of (doc_id, text, fingerprint, next text, next fingerprint)."""
    edited = [(t[:len(t) - len(t) // 2] + after[:len(t) // 2]).encode() for _, t, _, after, _ in rows]
    out = []
    for (doc_id, text, own, _, after), body, changed in zip(rows, edited, fingerprints(edited)):
        out.append((doc_id, len(text), hashlib.sha256(body).hexdigest(), text_of(own), text_of(changed), likeness(own, changed), likeness(own, after)))
    return out


def _grouped(items: Iterator[tuple], size: int) -> Iterator[list[tuple]]:
    held, total = [], 0
    for doc_id, text in items:
        held.append((doc_id, text))
        total += len(text)
        if total >= size:
            yield held
            held, total = [], 0
    if held:
        yield held


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Each document against an edited form of itself, and against the next document.

    docs(doc_id, text). The edited text has the last floor(n/2) code points replaced by the first as many (or all) of the next document.
    Next: the next greater doc_id, after the last the first; a null doc_id comes before all others; of several rows with that id the
    least text counts. Null text: empty. Returns `EDITED`, one row for each input row.

    Texts are dealt out by ranges of doc_id (compressed, one shuffle) and pass each task in descending order, so that the next document
    is the one just seen. What meets at the edge of two ranges, a few rows for each task, is put together afterwards.
    """
    def shrink(batches):
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            ids, texts = batch.columns
            for k in range(0, batch.num_rows, 500):
                yield pa.RecordBatch.from_arrays([ids.slice(k, 500), pa.array([pack((t or "").encode()) for t in texts.slice(k, 500).to_pylist()], pa.binary())], names=["doc_id", "body"])

    def walk(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        part = TaskContext.get().partitionId()
        items = ((i, unpack(b).decode()) for batch in batches for i, b in zip(*(c.to_pylist() for c in batch.columns)))
        seen = False  # a document of this range
        group = lead = after = None  # id of the group at hand; (id, text, fingerprint) of its least text and of the next document
        edge = True  # the group at hand has its next document in another range
        for rows in _grouped(items, _BATCH_BYTES):
            ready, waiting = [], []
            for (doc_id, text), own in zip(rows, fingerprints([t.encode() for _, t in rows])):
                if seen and doc_id != group:
                    after, edge, lead = lead, False, None
                if lead is None or text < lead[1]:
                    lead = (doc_id, text, own)
                seen, group = True, doc_id
                if edge:
                    waiting.append((doc_id, text))
                else:
                    ready.append((doc_id, text, own, after[1], after[2]))
            if ready:
                yield _batch(part, 0, _compare(ready))
            if waiting:
                yield _edge_batch(part, 1, waiting)
        if seen:
            yield _edge_batch(part, 2, [(lead[0], lead[1])])

    schema = f"part int, kind int, body string, {EDITED}"
    packed = docs.selectExpr("cast(doc_id as bigint) as doc_id", "text").mapInArrow(shrink, "doc_id long, body binary")
    ordered = packed.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").desc_nulls_last())
    walked = cut_lineage(ordered.mapInArrow(walk, schema))
    done = walked.where("kind = 0").drop("part", "kind", "body")
    # one row for each task from here on
    heads = walked.where("kind = 2").select(F.col("part").alias("head"), F.col("body").alias("after"))
    after_it = F.coalesce(F.lead("head").over(Window.orderBy("head")), F.min("head").over(Window.orderBy("head")))
    follows = heads.select(F.col("head").alias("part"), after_it.alias("head"))
    waiting = walked.where("kind = 1").select("part", "doc_id", "body").join(follows, "part").join(heads, "head")

    def finish(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                rows = batch.slice(k, 500).to_pylist()
                own, after = fingerprints([r["body"].encode() for r in rows]), fingerprints([r["after"].encode() for r in rows])
                yield _batch(0, 0, _compare([(r["doc_id"], r["body"], a, r["after"], b) for r, a, b in zip(rows, own, after)])).select([name for name, _ in _TYPES])

    return done.unionByName(waiting.select("doc_id", "body", "after").mapInArrow(finish, EDITED))


_TYPES = (("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
          ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()))


def _batch(part: int, kind: int, rows: list[tuple]) -> pa.RecordBatch:
    n = len(rows)
    columns = [pa.array([part] * n, pa.int32()), pa.array([kind] * n, pa.int32()), pa.nulls(n, pa.string())]
    columns += [pa.array([r[k] for r in rows], kind_of) for k, (_, kind_of) in enumerate(_TYPES)]
    return pa.RecordBatch.from_arrays(columns, names=["part", "kind", "body", *(name for name, _ in _TYPES)])


def _edge_batch(part: int, kind: int, rows: list[tuple]) -> pa.RecordBatch:
    n = len(rows)
    columns = [pa.array([part] * n, pa.int32()), pa.array([kind] * n, pa.int32()), pa.array([t for _, t in rows], pa.string()), pa.array([i for i, _ in rows], pa.int64())]
    columns += [pa.nulls(n, kind_of) for _, kind_of in _TYPES[1:]]
    return pa.RecordBatch.from_arrays(columns, names=["part", "kind", "body", *(name for name, _ in _TYPES)])
