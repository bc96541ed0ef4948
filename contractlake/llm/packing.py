"""Best-fit packing of tokenised documents into sequences of fixed capacity, by patterns fitted with non-negative least squares.

1. Every document is tokenised and closed with a separator id; only documents longer than the capacity are cut.
2. The histogram of piece lengths (as many numbers as the capacity) goes to the driver. Patterns of two or three lengths that fill a
   sequence exactly are enumerated; their repeat counts are fitted to the histogram by non-negative least squares and rounded,
   never beyond what the histogram still holds. What is left is packed by best fit, longest first, over counts of equal bins. Of the plans with all or a
   share of the fitted counts the shortest is taken. Work and memory of the plan depend on the capacity, not on the number of documents.
3. Pieces of one length are numbered (in salted groups, so a length that a third of all pieces share is not one task) and take the
   plan's places of that length in turn.

A null text is empty: its one piece is the separator alone. Repeated rows are packed each. Texts of any length are tokenised whole, a long one as a slice of its own. Of the input only
`doc_id` and `text` are read, so other columns may have any name. An empty table gives no pieces.
"""

from __future__ import annotations

import os
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .arrays import U64, WORD_BYTES, mix, powers, slices, text_bytes

SEPARATOR = 0
# Distinct parts of words whose ids a task remembers at once.
REMEMBERED = 400_000

# Byte classes: 0 white space, 1 ASCII letter, 2 digit, 3 apostrophe, 4 other ASCII, 5 beyond ASCII
_KIND = np.full(256, 4, np.uint8)
_KIND[[32, *range(9, 14)]] = 0
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[range(48, 58)] = 2
_KIND[39] = 3
_KIND[128:] = 5
# Between which neighbouring classes the tokenizer's splitting pattern always cuts: its matches are runs of letters, single digits,
# runs of other characters, or an apostrophe with letters after it.
_CUT = np.zeros((6, 6), bool)
for _a, _b in ((1, 2), (2, 1), (1, 4), (4, 1), (2, 4), (4, 2), (2, 2), (2, 3), (3, 2), (1, 3)):
    _CUT[_a, _b] = True


class WordTokenizer:
    """Ids of whole texts by a tokenizer that splits at white space first; each distinct part of a word is tokenised once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.closes = np.zeros(size, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.closes[i] = token.endswith("</w>")
        self._forget()

    def _forget(self) -> None:
        self.codes: dict[int, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.first, self.count = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.used = 0

    def _remember(self, keys: list[int], ids: np.ndarray, counts: np.ndarray) -> None:
        n = len(self.codes)
        while len(self.first) < n + len(keys):
            self.first, self.count = np.resize(self.first, 2 * len(self.first)), np.resize(self.count, 2 * len(self.count))
        while len(self.flat) < self.used + len(ids):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used:self.used + len(ids)] = ids
        self.count[n:n + len(keys)] = counts
        self.first[n:n + len(keys)] = self.used + np.cumsum(counts) - counts
        self.used += len(ids)
        self.codes.update(zip(keys, range(n, n + len(keys))))

    def _learn(self, keys: list[int], words: list[str]) -> None:
        single = [w.isascii() and (w.isalpha() or not any(c.isalnum() or c == "'" for c in w) or len(w) == 1) or w.isalpha() for w in words]
        plain = [k for k, one in enumerate(single) if one]
        rest = [k for k, one in enumerate(single) if not one]
        # each plain part is one match of the splitting pattern, so exactly one of its ids closes a word
        for i in range(0, len(plain), 2000):
            some = plain[i:i + 2000]
            ids = np.array(self.tokenizer.encode(" ".join([words[k] for k in some]), add_special_tokens=False).ids, np.uint32)
            last = np.flatnonzero(self.closes[ids])
            if len(last) == len(some) and last[-1] == len(ids) - 1:
                self._remember([keys[k] for k in some], ids, np.diff(last, prepend=-1))
            else:
                rest += some
        if rest:
            ids = [e.ids for e in self.tokenizer.encode_batch([words[k] for k in rest], add_special_tokens=False)]
            self._remember([keys[k] for k in rest], np.array([x for own in ids for x in own], np.uint32), np.array([len(x) for x in ids], np.int64))

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text, as the tokenizer gives for the whole text without added special tokens."""
        data, offsets = text_bytes(texts)
        n = len(texts)
        if not len(data):
            return [np.zeros(0, np.uint32)] * n
        kind = _KIND[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        edge[1:-1] |= _CUT[kind[:-1], kind[1:]]
        inside = kind > 0
        begins, stops = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1] | edge[1:-1]
        stops[:-1] &= ~inside[1:] | edge[1:-1]
        start, end = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        up, down = powers(len(data))
        total = np.zeros(len(data) + 1, U64)
        np.cumsum(WORD_BYTES[data] * up[:len(data)], out=total[1:])
        hashes = mix((total[end] - total[start]) * down[start] + (end - start).astype(U64))
        distinct, at, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.codes) + len(distinct) > REMEMBERED:
            self._forget()
        keys = distinct.tolist()
        new = [k for k, key in enumerate(keys) if key not in self.codes]
        if new:
            raw = data.tobytes()
            where = at[new]
            # parts that differ in the case of A-Z only are the same to the tokenizer
            self._learn([keys[k] for k in new], [raw[a:b].decode() for a, b in zip(start[where].tolist(), end[where].tolist())])
        codes = np.fromiter(map(self.codes.__getitem__, keys), np.int64, len(keys))[inverse]
        counts = self.count[codes]
        ends = np.cumsum(counts)
        ids = self.flat[np.repeat(self.first[codes] - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.concatenate([[0], ends])[np.searchsorted(start, offsets)]
        out = [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        raw = None
        for k in np.flatnonzero(_has(data, offsets, b"<|")):  # may hold a special token, which is found before the text is split
            raw = raw or data.tobytes()
            out[k] = np.array(self.tokenizer.encode(raw[offsets[k]:offsets[k + 1]].decode(), add_special_tokens=False).ids, np.uint32)
        return out


def _has(data: np.ndarray, offsets: np.ndarray, pair: bytes) -> np.ndarray:
    """Which texts hold the two bytes next to each other."""
    at = np.flatnonzero((data[:-1] == pair[0]) & (data[1:] == pair[1]))
    doc = np.searchsorted(offsets, at, "right") - 1
    out = np.zeros(len(offsets) - 1, bool)
    out[doc[at + 1 < offsets[doc + 1]]] = True
    return out


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of docs(doc_id, text)."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<long>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]):
        coder = WordTokenizer(tokenizer_path)
        for batch in batches:
            for part in slices(batch):
                rows, kept = [], []
                for doc_id, ids in zip(part.column(0).to_pylist(), coder.encode(part.column(1))):
                    ids = np.append(ids, np.uint32(SEPARATOR)).astype("<u4")
                    for k, start in enumerate(range(0, len(ids), capacity)):
                        own = ids[start:start + capacity]
                        rows.append((doc_id, k, start, len(own), zlib.crc32(own.tobytes())))
                        kept.append(own)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
                if with_ids:
                    columns.append(pa.array([x.astype(np.int64) for x in kept], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][:len(columns)])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def fitted_patterns(histogram: np.ndarray, capacity: int, stride: int = 16, rounds: int = 400) -> list[tuple[tuple[int, ...], float]]:
    """Patterns of two or three lengths that sum up to the capacity, with fitted repeat counts.

    All pairs are enumerated, and of the triples (a, b, c) those whose middle length is a multiple of `stride` off the smallest one.
    min |A x - h|^2 with x >= 0 is solved by projected gradient steps with momentum.
    """
    there = histogram > 0
    pairs = [(a, capacity - a) for a in range(1, capacity // 2 + 1) if there[a] and there[capacity - a]]
    triples = []
    for a in np.flatnonzero(there[:capacity // 3 + 1]).tolist():
        b = np.arange(a, (capacity - a) // 2 + 1, stride)
        c = capacity - a - b
        triples += [(a, int(x), int(y)) for x, y in zip(b[there[b] & there[c]], c[there[b] & there[c]])]
    patterns = pairs + triples
    if not patterns:
        return []
    column = np.repeat(np.arange(len(patterns)), [len(p) for p in patterns])
    row = np.array([x for p in patterns for x in p])
    apply = lambda x: np.bincount(row, x[column], capacity + 1)
    back = lambda r: np.bincount(column, r[row], len(patterns))
    v = np.ones(len(patterns))
    for _ in range(30):  # greatest eigenvalue of A'A, for the step
        v = back(apply(v))
        top = np.linalg.norm(v)
        v /= top
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(rounds):
        nearer = np.maximum(0, y - back(apply(y) - histogram) / top)
        faster = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = nearer + (t - 1) / faster * (nearer - x)
        x, t = nearer, faster
    order = np.argsort(-x, kind="stable")
    return [(patterns[k], float(x[k])) for k in order if x[k] > 0]


# Shares of the fitted repeat counts that plans are made with; what a plan leaves is packed by best fit.
SHARES = (1.0, 0.9, 0.75, 0.5, 0.0)


def plan(histogram: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, how often) that use up histogram[length] exactly.

    The fitted counts say nothing about how well the rest packs, so plans with all of them (rounded to the nearest, and down) and with shares of them are made. The one with
    the fewest sequences is taken, of equal ones the one with the most patterns; with none of them it is best fit alone, so no plan is worse than that.
    """
    left = histogram.astype(np.int64).copy()
    full: list[tuple[tuple[int, ...], int]] = [((capacity,), int(left[capacity]))] if left[capacity] else []
    left[capacity] = 0
    fitted = fitted_patterns(left, capacity)
    plans = [_with_patterns(left, capacity, [(p, round(x)) for p, x in fitted])]
    plans += [_with_patterns(left, capacity, [(p, int(share * x)) for p, x in fitted]) for share in SHARES]
    return full + min(plans, key=lambda p: sum(times for _, times in p))


def _with_patterns(histogram: np.ndarray, capacity: int, patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[tuple[int, ...], int]]:
    """Patterns as often as wanted, never beyond what the histogram still holds, and best fit of the rest."""
    left, out = histogram.copy(), []
    for pattern, times in patterns:
        lengths, needs = np.unique(pattern, return_counts=True)
        use = int(min(times, (left[lengths] // needs).min()))
        if use > 0:
            left[lengths] -= needs * use
            out.append((pattern, use))
    return out + best_fit(left, capacity)


def best_fit(histogram: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first: each piece goes to the open bin with the least room that holds it. Equal bins are counted, not listed."""
    room: list[dict[tuple[int, ...], int]] = [defaultdict(int) for _ in range(capacity + 1)]
    for length in np.flatnonzero(histogram)[::-1].tolist():
        todo = int(histogram[length])
        space = length
        while todo and space <= capacity:
            if not room[space]:
                space += 1
                continue
            bins, times = room[space].popitem()
            use = min(todo, times)
            if times > use:
                room[space][bins] = times - use
            room[space - length][(*bins, length)] += use
            todo -= use
            space = max(length, min(space, space - length)) if space - length >= length else space
        if todo:
            fits = capacity // length
            whole, rest = divmod(todo, fits)
            if whole:
                room[capacity - fits * length][(length,) * fits] += whole
            if rest:
                room[capacity - rest * length][(length,) * rest] += 1
    return [(bins, times) for spaces in room for bins, times in sorted(spaces.items())]


def place(found: DataFrame, capacity: int = 2048, group_rows: int = 100_000) -> DataFrame:
    """found(doc_id, piece, start, length, ids_crc32) with sequence_id and offset. `found` is read several times: pass a written table."""
    counted = found.groupBy("length").count().collect()  # at most `capacity` rows
    histogram = np.zeros(capacity + 1, np.int64)
    for row in counted:
        histogram[row["length"]] = row["count"]
    keys, firsts, sequences, offsets = [], [], [], []
    taken, sequence = np.zeros(capacity + 1, np.int64), 0
    for lengths, times in plan(histogram, capacity):
        at = 0
        for length in lengths:
            keys.append((length << 44) + int(taken[length]))
            firsts.append(int(taken[length]))
            sequences.append(sequence)
            offsets.append(at)
            taken[length] += times
            at += length
        sequence += times
    order = np.argsort(np.array(keys, np.int64), kind="stable")
    slots = tuple(np.array(x, np.int64)[order] for x in (keys, firsts, sequences, offsets))
    # as many rows as the plan has places of equal sequences, whatever the number of documents
    sent = found.sparkSession.sparkContext.broadcast(slots)

    # rows are dealt by their number in the written table, so repeated rows spread like any others
    salts = int(histogram.sum() // group_rows) + 1
    salted = found.withColumn("row", F.monotonically_increasing_id()).withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)))
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = sizes.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("row")) - 1
    numbered = salted.withColumn("rank", rank).join(before, ["length", "salt"]).select(*found.columns, (F.col("rank") + F.col("before")).alias("rank"))
    names = [*found.columns, "sequence_id", "offset"]

    def run(batches):
        keys, firsts, sequences, offsets = sent.value
        for batch in batches:
            length, number = batch.column(batch.schema.get_field_index("length")).to_numpy(), batch.column(batch.num_columns - 1).to_numpy()
            slot = np.searchsorted(keys, (length << 44) + number, "right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequences[slot] + number - firsts[slot]), pa.array(offsets[slot])], names=names)

    return numbered.mapInArrow(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in found.schema)}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, with_ids: bool = False) -> DataFrame:
    """Pieces of docs(doc_id, text) with their place: sequence_id, and offset in it (gapless from 0)."""
    return place(cut_lineage(pieces(docs, tokenizer_path, capacity, with_ids)), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) of pieces packed with their ids; a sequence holds `capacity` ids at most."""
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda p: p["ids"])).alias("ids"))
