"""Removal of repeated byte strings by a multi-document Burrows-Wheeler transform, built column by column.

Every byte that lies in a string of `least` bytes which also starts earlier (smaller doc_id, or same document at an earlier start) is
removed. Strings are judged on the input and never cross documents.

1. Winnowing. Each window of `least` bytes is named by the smallest hash of the 32-byte strings in it, so equal windows have equal
   names wherever they stand. Consecutive windows of one name make a run. Runs whose name turns up once in the whole input repeat nothing
   and are left out; names are counted by hash range, block by block.
2. The text below the remaining runs goes, as short documents, to the task of their name. Equal ones are one document with all its places.
   A document whose name no other one has repeats nothing either, unless its name stands in it twice.
3. Each task sorts the suffixes of its other documents: round by round one symbol of every document, from the right, is inserted into
   the Burrows-Wheeler transform of the collection, and the array of common prefixes is updated with it. Both lie in files
   that a round reads and writes front to back. In the end a stretch of common prefixes of `least` or more is a class of equal windows;
   all but the earliest of a class are marked.
4. Marked windows return to their blocks and are cut out.

A name with very many runs is split: its windows go one by one to the task of their own hash, from each block only the earliest place of each distinct
window. They are different or equal as a whole, so they need no sorting: the task answers whether that place repeats an earlier one, and the block
looks up the window's other places in its own texts.
Null text: empty, nothing removed; texts shorter than `least` lose nothing. A null doc_id comes before all others. Rows that repeat a doc_id stand at the
same places, so neither counts as earlier than the other.
"""

from __future__ import annotations

import hashlib
import os
import tempfile

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..session import cut_lineage
from .arrays import U64, byte_table, mix, powers, slices, text_bytes
from .shingle_join import _packed, _unpacked

LEAST = 100
GRAM = 32
NAME_BITS = 48
BLOCK_BYTES = 2 << 20
# Bytes of input for each range of names.
RANGE_BYTES = 2 << 20
HOT_RUNS = 50_000
# Bytes whose names are worked out at once.
STRETCH = 1 << 17
_BYTES = byte_table(7)
NO_ID = np.iinfo(np.int64).min
WIDTH = 8
HALF = 32
TAIL = (1 << HALF) - 1
NO_TAIL = 1 << (HALF - 1)


# -- blocks of whole rows

def _blocks(names: list[str]):
    def run(batches):
        base, count, held, size = TaskContext.get().partitionId() << 32, 0, [], 0

        def block():
            table = pa.Table.from_batches(held).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_table(table)
            return pa.RecordBatch.from_arrays([pa.array([base + count], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "blob"])

        for batch in batches:
            for part in slices(batch, limit=BLOCK_BYTES // 2):
                held.append(part)
                size += len(text_bytes(part.column(names.index("text")))[0])
                if size >= BLOCK_BYTES:
                    yield block()
                    held, size, count = [], 0, count + 1
        if held:
            yield block()
    return run


def _rows(blob: bytes) -> pa.RecordBatch:
    table = pa.ipc.open_stream(blob).read_all().combine_chunks()
    return table.to_batches()[0] if table.num_rows else pa.RecordBatch.from_pylist([], schema=table.schema)


def _numbers(rows: pa.RecordBatch) -> np.ndarray:
    return rows.column(rows.schema.get_field_index("doc_id")).cast(pa.int64()).fill_null(int(NO_ID)).to_numpy()


# -- names and runs

def _slide(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over every `width` neighbouring values."""
    have = 1
    while have * 2 <= width:
        values = pick(values[:-have], values[have:])
        have *= 2
    return pick(values[:have - width], values[width - have:]) if have < width else values


class Names:
    """Window names of a block's texts. window[i] is the name of the window that starts at byte i, 0 where none fits into its document.

    anchors: the names of the grams that name a window, as often as they stand in the block; so repeats inside a run count too.
    The bytes are gone through in stretches, so that only the names themselves are held for the whole block.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, least: int):
        self.data, self.offsets, self.least = data, offsets, least
        gram = min(GRAM, least)
        width = least - gram + 1
        n = max(0, len(data) - least + 1)
        self.window = np.zeros(n, U64)
        ends = np.repeat(offsets[1:], np.diff(offsets))
        anchors = [np.zeros(0, U64)]
        for a in range(0, n + width - 1, STRETCH):
            low, high = max(0, a - width + 1), min(len(data), a + STRETCH + width + gram - 2)
            if high - low < least:
                continue
            total, down = _sums(data[low:high])
            grams = (mix((total[gram:] - total[:-gram]) * down[:high - low - gram + 1]) >> U64(64 - NAME_BITS)) | U64(1)
            window = _slide(grams, width, np.minimum)
            window[np.arange(low + least, low + least + len(window)) > ends[low:low + len(window)]] = 0
            self.window[low:low + len(window)] = window
            # the grams from a on; windows before the first or behind the last one name nothing
            padded = np.concatenate([np.zeros(width - 1 - (a - low), U64), window, np.zeros(max(0, len(grams) - len(window)), U64)])
            named = _slide(padded, width, np.maximum)[:STRETCH]
            own = grams[a - low:a - low + len(named)]
            named = named[:len(own)]
            anchors.append(own[(named == own) & (named > 0)])
        self.anchors = _spread(np.concatenate(anchors))

    def hash(self, starts: np.ndarray, length: int) -> np.ndarray:
        total, down = _sums(self.data)
        return mix((total[starts + length] - total[starts]) * down[starts])

    def runs(self, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(name, first start, number of starts) of the runs, longer ones cut."""
        n = len(self.window)
        if not n:
            return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        new = np.ones(n, bool)
        new[1:] = self.window[1:] != self.window[:-1]
        new[self.offsets[self.offsets < n]] = True
        first = np.flatnonzero(new)
        counts = np.diff(np.append(first, n))
        some = self.window[first] > 0
        first, counts = first[some], counts[some]
        parts = -(-counts // longest)
        number = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        first, counts = np.repeat(first, parts) + number * longest, np.minimum(np.repeat(counts, parts) - number * longest, longest)
        return _spread(self.window[first]), first, counts


def _spread(names: np.ndarray) -> np.ndarray:
    """Names dealt evenly over their range: as smallest hashes they crowd at its low end."""
    return (mix(names) >> U64(64 - NAME_BITS)) | U64(1)


def _sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running hash of the bytes, with a 0 before it, and inverse powers."""
    up, down = powers(len(data))
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTES[data] * up[:len(data)], out=total[1:])
    return total, down


def _ask(least: int, range_bits: int):
    def run(batches):
        for batch in batches:
            for block, blob in zip(*(c.to_pylist() for c in batch.columns)):
                rows = _rows(blob)
                names, counts = np.unique(Names(*text_bytes(rows.column(rows.schema.get_field_index("text"))), least).anchors, return_counts=True)
                part = (names >> U64(NAME_BITS - range_bits)).astype(np.int64)
                cuts = np.searchsorted(part, np.arange((1 << range_bits) + 1))
                parts = np.flatnonzero(np.diff(cuts)).tolist()
                blobs = [_packed(np.diff(names[cuts[p]:cuts[p + 1]], prepend=U64(0)), counts[cuts[p]:cuts[p + 1]].astype("<u4")) for p in parts]
                yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array([block] * len(parts), pa.int64()), pa.array(blobs, pa.binary())], names=["part", "block", "blob"])
    return run


def _answer(hot_runs: int):
    def run(table: pa.Table) -> pa.Table:
        """For each block the names that turn up more than once anywhere, and which of them are hot."""
        asked = [_unpacked(b, "<u8", "<u4") for b in table.column("blob").to_pylist()]
        names = [np.cumsum(a[0], dtype=U64) for a in asked]
        every, where = np.unique(np.concatenate(names), return_inverse=True)
        total = np.bincount(where, np.concatenate([a[1] for a in asked]), len(every))
        total = total[where]
        out, at = [], 0
        for own in names:
            seen = total[at:at + len(own)]
            at += len(own)
            out.append(_packed(own[seen > 1], (seen[seen > 1] > hot_runs).astype("u1")))
        return pa.table({"block": table.column("block"), "blob": pa.array(out, pa.binary())})
    return run


# -- short documents

def _earliest(raw: bytes, starts: np.ndarray, numbers: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(byte where the earliest place of each distinct window begins, whether it has more places) of windows that begin at starts."""
    of: dict[bytes, int] = {}
    window = np.array([of.setdefault(raw[s:s + least], len(of)) for s in starts.tolist()], np.int64)
    row = np.searchsorted(offsets, starts, "right") - 1
    order = np.lexsort((starts - offsets[row], numbers[row], window))
    head = np.flatnonzero(np.diff(window[order], prepend=-1))
    return starts[order[head]], np.diff(np.append(head, len(order))) > 1


def _documents(least: int, range_bits: int):
    def run(table: pa.Table) -> pa.Table:
        """Short documents of one block, by task: texts, and (document, doc_id, row, start) of their places; split windows, and (doc_id, row, start, whether
        there are more) of their earliest places."""
        kinds, blobs = table.column("kind").to_pylist(), table.column("blob").to_pylist()
        block = table.column("block")[0].as_py()
        answers = [_unpacked(b, "<u8", "u1") for k, b in zip(kinds, blobs) if k == 1]
        rows = _rows(next(b for k, b in zip(kinds, blobs) if k == 0))
        empty = pa.table({"part": pa.array([], pa.int64()), "block": pa.array([], pa.int64()), "blob": pa.array([], pa.binary())})
        if not answers:
            return empty
        data, offsets = text_bytes(rows.column(rows.schema.get_field_index("text")))
        numbers = _numbers(rows)
        names = Names(data, offsets, least)
        name, first, counts = names.runs(least - min(GRAM, least) + 1)
        known, hot = np.concatenate([a[0] for a in answers]), np.concatenate([a[1] for a in answers])
        order = np.argsort(known)
        known, hot = known[order], hot[order]
        if not len(known):
            return empty
        at = np.minimum(np.searchsorted(known, name), len(known) - 1)
        some = known[at] == name
        name, first, counts, split = name[some], first[some], counts[some], hot[at[some]] > 0
        part = (name >> U64(NAME_BITS - range_bits)).astype(np.int64)
        starts = np.repeat(first[split], counts[split]) + np.arange(counts[split].sum()) - np.repeat(np.cumsum(counts[split]) - counts[split], counts[split])
        first, counts, part = first[~split], counts[~split], part[~split]
        order = np.argsort(part, kind="stable")
        first, counts, part = first[order], counts[order], part[order]
        row = np.searchsorted(offsets, first, "right") - 1
        raw = data.tobytes()
        # hot names: each distinct window goes to the task of its own hash, with its earliest place
        single, several = _earliest(raw, starts, numbers, offsets, least)
        single_part = (names.hash(single, least) >> U64(64 - range_bits)).astype(np.int64) if len(single) else np.zeros(0, np.int64)
        order = np.argsort(single_part, kind="stable")
        single, several, single_part = single[order], several[order], single_part[order]
        single_row = np.searchsorted(offsets, single, "right") - 1
        parts, out = np.union1d(part, single_part).tolist(), []
        for p in parts:
            a, b = np.searchsorted(part, p), np.searchsorted(part, p, "right")
            of: dict[bytes, int] = {}
            which = [of.setdefault(raw[s:s + c + least - 1], len(of)) for s, c in zip(first[a:b].tolist(), counts[a:b].tolist())]
            c, d = np.searchsorted(single_part, p), np.searchsorted(single_part, p, "right")
            windows = b"".join(raw[s:s + least] for s in single[c:d].tolist())
            out.append(_packed(np.array([len(t) for t in of], "<u4"), np.frombuffer(b"".join(of), "u1"), np.array(which, "<u4"), numbers[row[a:b]].astype("<i8"),
                               row[a:b].astype("<u4"), (first[a:b] - offsets[row[a:b]]).astype("<u4"),
                               np.frombuffer(windows, "u1"), numbers[single_row[c:d]].astype("<i8"), single_row[c:d].astype("<u4"),
                               (single[c:d] - offsets[single_row[c:d]]).astype("<u4"), several[c:d].astype("u1")))
        return pa.table({"part": pa.array(parts, pa.int64()), "block": pa.array([block] * len(parts), pa.int64()), "blob": pa.array(out, pa.binary())})
    return run


# -- column-wise construction

class _File:
    """An array in a file, written and read front to back."""

    def __init__(self, folder: str, name: str, kind):
        self.file, self.kind, self.n = open(os.path.join(folder, name), "w+b", buffering=0), kind, 0

    def write(self, values: np.ndarray) -> None:
        self.file.seek(0)
        self.file.write(memoryview(np.ascontiguousarray(values, self.kind)).cast("B"))
        self.n = len(values)

    def read(self) -> np.ndarray:
        out = np.empty(self.n, self.kind)
        self.file.seek(0)
        view, at = memoryview(out).cast("B"), 0
        while at < len(view):
            at += self.file.readinto(view[at:])
        return out


class _Least:
    """Least value of any stretch of an array, by tables of stretches of 1, 2, 4, ... elements."""

    def __init__(self, values: np.ndarray):
        self.tables = [values]
        while 2 << (len(self.tables) - 1) <= len(values):
            half, last = 1 << (len(self.tables) - 1), self.tables[-1]
            self.tables.append(np.minimum(last[:-half], last[half:]))

    def of(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Least of first..last, both included."""
        out = np.empty(len(first), self.tables[0].dtype)
        level = np.log2(last - first + 1).astype(np.int64) if len(first) else np.zeros(0, np.int64)
        for k in np.unique(level).tolist():
            own = level == k
            out[own] = np.minimum(self.tables[k][first[own]], self.tables[k][last[own] - (1 << k) + 1])
        return out


class Columns:
    """Burrows-Wheeler transform and common prefixes of a collection, extended by one symbol of every document a round.

    A symbol is eight bytes, and each text enters as eight documents, which end 0 to 7 bytes before its end; what is left over there is
    a last, shorter symbol. So every suffix is inserted, in an eighth of the rounds that single bytes would take. Suffixes stand in
    byte order. The file `tails` has for each its first symbol (upper half) and the place of its tail (lower half): it lists for
    each symbol the places before which it stands, which is the transform sorted by symbol. The file `lcp` has the common prefix of each
    suffix and the one before it, `least` at most.
    """

    def __init__(self, texts: list[bytes], least: int, folder: str):
        self.least, self.n = least, len(texts)
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.base = np.cumsum(self.sizes + 1) - self.sizes - 1  # suffix of length t of text i: base[i] + t
        self._symbols(np.frombuffer(b"".join(texts) + bytes(WIDTH), np.uint8))
        self.tails, self.lcp = _File(folder, "tails", np.int64), _File(folder, "lcp", np.uint8)
        self.text, self.length = np.repeat(np.arange(self.n), WIDTH), np.tile(np.arange(WIDTH), self.n)
        some = self.length <= self.sizes[self.text]
        self.text, self.length = self.text[some], self.length[some]
        key = (self.first[self.base[self.text] + self.length] << HALF) | (NO_TAIL + np.arange(len(self.text)))
        order = np.argsort(key)
        self.text, self.length, self.place = self.text[order], self.length[order], np.arange(len(order))
        self.tails.write(key[order])
        symbol = key[order] >> HALF
        common = np.zeros(len(symbol), np.int64)
        common[1:] = np.where(symbol[1:] == symbol[:-1], self.width[symbol[1:]], self._shared(symbol[1:], symbol[:-1]))
        self.lcp.write(np.minimum(common, least))

    def _symbols(self, data: np.ndarray) -> None:
        """Number the first symbols of all suffixes in byte order, a shorter one before those it begins."""
        value = np.zeros(len(data) - WIDTH + 1, U64)
        for k in range(WIDTH):
            value |= data[k:len(data) - WIDTH + 1 + k].astype(U64) << U64(8 * (WIDTH - 1 - k))
        text = np.repeat(np.arange(self.n), self.sizes + 1)
        length = np.arange(len(text)) - self.base[text]
        own = value[np.cumsum(self.sizes)[text] - length]
        width = np.minimum(length, WIDTH)
        short = np.flatnonzero(width < WIDTH)
        own[short] &= ~(U64(0xFFFFFFFFFFFFFFFF) >> (8 * width[short]).astype(U64))
        whole = np.flatnonzero(width == WIDTH)
        wholes, number = np.unique(own[whole], return_inverse=True)
        order = np.lexsort((width[short], own[short]))
        short = short[order]
        new = np.ones(len(short), bool)
        new[1:] = (own[short][1:] != own[short][:-1]) | (width[short][1:] != width[short][:-1])
        shorts, short_number = short[new], np.cumsum(new) - 1
        slot = np.searchsorted(wholes, own[shorts], "left")
        self.first = np.empty(len(text), np.int64)
        self.first[short] = (slot + np.arange(len(slot)))[short_number]
        self.first[whole] = (np.arange(len(wholes)) + np.searchsorted(slot, np.arange(len(wholes)), "right"))[number]
        self.value, self.width = np.empty(len(wholes) + len(shorts), U64), np.empty(len(wholes) + len(shorts), np.int64)
        self.value[self.first], self.width[self.first] = own, width

    def _shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bytes that different symbols have in common at their beginning."""
        differ = self.value[a] ^ self.value[b]
        same = np.full(len(a), WIDTH)
        for k in range(WIDTH - 1, -1, -1):
            same[(differ >> U64(8 * (WIDTH - 1 - k))) > 0] = k
        # the least k for which the first k + 1 bytes differ was set last
        return np.minimum(same, np.minimum(self.width[a], self.width[b]))

    def build(self) -> None:
        while len(self.text):
            self._insert()

    def _insert(self) -> None:
        """Insert the next longer suffix of each document that has one."""
        self.length = self.length + WIDTH
        more = self.length <= self.sizes[self.text]
        text, length, place = self.text[more], self.length[more], self.place[more]
        if len(text):
            tails, lcp = self.tails.read(), self.lcp.read()
            # a suffix that begins with c stands among those as its tail does among the tails before which c stands
            key = (self.first[self.base[text] + length] << HALF) | place
            order = np.argsort(key)
            key, text, length, place = key[order], text[order], length[order], place[order]
            rank = np.searchsorted(tails, key)
            new = rank + np.arange(len(key))
            old = np.ones(len(tails) + len(key), bool)
            old[new] = False
            merged = np.empty(len(old), np.int64)
            merged[old] = tails
            merged[new] = key
            least = _Least(lcp)
            prefix = np.empty(len(old), np.uint8)
            prefix[old] = lcp
            prefix[new] = self._common(merged, np.maximum(new - 1, 0), new, least)
            prefix[new[new == 0]] = 0
            behind = new[new + 1 < len(merged)] + 1
            prefix[behind] = self._common(merged, behind - 1, behind, least)
            # where the tails stand from now on
            moved = np.repeat(np.arange(len(key) + 1), np.diff(rank, prepend=0, append=len(tails)))
            tail = merged & TAIL
            inner = tail < NO_TAIL
            merged[inner] += moved[tail[inner]]
            self.tails.write(merged)
            self.lcp.write(prefix)
            place = new
        self.text, self.length, self.place = text, length, place

    def _common(self, merged: np.ndarray, a: np.ndarray, b: np.ndarray, least: _Least) -> np.ndarray:
        """Common prefix of the suffixes at a and at b, neighbours in order; tails still have their former places."""
        first, second = merged[a] >> HALF, merged[b] >> HALF
        out = self._shared(first, second)
        same = np.flatnonzero(first == second)
        out[same] = self.width[first[same]]
        longer = same[self.width[first[same]] == WIDTH]
        longer = longer[(merged[a[longer]] != merged[b[longer]])]
        out[longer] += least.of((merged[a[longer]] & TAIL) + 1, merged[b[longer]] & TAIL)
        return np.minimum(out, self.least).astype(np.uint8)

    def classes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, start, class) of every window; windows of one class are equal."""
        stretch = np.cumsum(self.lcp.read() < self.least)
        tails = self.tails.read()
        tail = tails & TAIL
        ends = np.flatnonzero(tail >= NO_TAIL)
        longer = np.full(len(tails), -1)  # place of the suffix with one symbol more
        inner = np.flatnonzero(tail < NO_TAIL)
        longer[tail[inner]] = inner
        # the documents' shortest suffixes, in the order in which they were numbered
        text, length = np.repeat(np.arange(self.n), WIDTH), np.tile(np.arange(WIDTH), self.n)
        some = length <= self.sizes[text]
        text, length, place = text[some], length[some], np.empty(some.sum(), np.int64)
        place[tail[ends] - NO_TAIL] = ends
        found = []
        while len(text):
            window = length >= self.least
            found.append((text[window], (self.sizes[text] - length)[window], stretch[place[window]]))
            length = length + WIDTH
            stay = length <= self.sizes[text]
            text, length, place = text[stay], length[stay], longer[place[stay]]
        return tuple(np.concatenate([f[k] for f in found]) for k in range(3))

    def close(self) -> None:
        self.tails.file.close()
        self.lcp.file.close()


def _may_repeat(texts: list[bytes], least: int) -> np.ndarray:
    """Which of different texts may have a window in common with another one or with themselves.

    Equal windows have equal names, and two in one run have its gram twice. So a text whose name no other text has, and which has
    that gram once, has none.
    """
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    names = Names(data, offsets, least)
    own = _spread(names.window[offsets[:-1]])
    _, where, texts_of = np.unique(own, return_inverse=True, return_counts=True)
    anchors, times = np.unique(names.anchors, return_counts=True)
    return np.flatnonzero((texts_of[where] > 1) | (times[np.searchsorted(anchors, own)] > 1))


def _mark(least: int):
    def run(table: pa.Table) -> pa.Table:
        """For each block the (row, start, number of starts) of windows that also stand earlier, and (row, start, whether it also stands earlier) of split windows."""
        blocks = table.column("block").to_pylist()
        of: dict[bytes, int] = {}
        text, doc, row, start, block = [], [], [], [], []
        window_of: dict[bytes, int] = {}
        singles = []
        for k, blob in enumerate(table.column("blob").to_pylist()):
            sizes, data, which, numbers, rows, starts, windows, *places = _unpacked(blob, "<u4", "u1", "<u4", "<i8", "<u4", "<u4", "u1", "<i8", "<u4", "<u4", "u1")
            windows = windows.tobytes()
            window = [window_of.setdefault(windows[s:s + least], len(window_of)) for s in range(0, len(windows), least)]
            singles.append((np.array(window, np.int64), *places, np.full(len(window), k)))
            raw, ends = data.tobytes(), np.cumsum(sizes.astype(np.int64)).tolist()
            number = np.array([of.setdefault(raw[e - s:e], len(of)) for s, e in zip(sizes.tolist(), ends)], np.int64)
            text.append(number[which])
            doc.append(numbers)
            row.append(rows.astype(np.int64))
            start.append(starts.astype(np.int64))
            block.append(np.full(len(which), k))
        text, doc, row, start, block = (np.concatenate(x) for x in (text, doc, row, start, block))
        order = np.lexsort((start, doc, text))
        text, doc, row, start, block = text[order], doc[order], row[order], start[order], block[order]
        head = np.flatnonzero(np.diff(text, prepend=-1))
        lead_doc, lead_start = doc[head], start[head]
        texts = list(of)
        some = _may_repeat(texts, least) if texts else np.zeros(0, np.int64)
        document = offset = stretch = np.zeros(0, np.int64)
        if len(some):
            with tempfile.TemporaryDirectory(prefix="columns-") as folder:
                columns = Columns([texts[k] for k in some], least, folder)
                columns.build()
                document, offset, stretch = columns.classes()
                columns.close()
            document = some[document]
        at = lead_start[document] + offset
        order = np.lexsort((at, lead_doc[document], stretch))
        document, offset, stretch, at = document[order], offset[order], stretch[order], at[order]
        new = np.ones(len(stretch), bool)
        new[1:] = stretch[1:] != stretch[:-1]
        best = np.flatnonzero(new)[np.cumsum(new) - 1]
        later = (lead_doc[document] != lead_doc[document[best]]) | (at != at[best])
        document, offset = document[later], offset[later]
        # stretches of marked windows in the first places of each text
        order = np.lexsort((offset, document))
        document, offset = document[order], offset[order]
        begin = np.flatnonzero(np.concatenate([[True], (document[1:] != document[:-1]) | (offset[1:] != offset[:-1] + 1)])) if len(document) else np.zeros(0, np.int64)
        span_text, span_from, span_n = document[begin], offset[begin], np.diff(np.append(begin, len(document)))
        # a place after a text's first one repeats all of it
        leads = (doc == lead_doc[text]) & (start == lead_start[text])
        windows = np.array([len(t) for t in texts], np.int64) - least + 1
        out_block, out_row, out_start, out_n = [block[~leads]], [row[~leads]], [start[~leads]], [windows[text[~leads]]]
        low, high = np.searchsorted(span_text, text[leads]), np.searchsorted(span_text, text[leads], "right")
        times = high - low
        spans = np.repeat(low - (np.cumsum(times) - times), times) + np.arange(times.sum())
        out_block.append(np.repeat(block[leads], times))
        out_row.append(np.repeat(row[leads], times))
        out_start.append(np.repeat(start[leads], times) + span_from[spans])
        out_n.append(span_n[spans])
        out_block, out_row, out_start, out_n = (np.concatenate(x) for x in (out_block, out_row, out_start, out_n))
        window, doc, row, start, several, block = (np.concatenate(x) for x in zip(*singles))
        order = np.lexsort((start, doc, window))
        window, doc, row, start, several, block = window[order], doc[order], row[order], start[order], several[order], block[order]
        head = np.flatnonzero(np.diff(window, prepend=-1))
        later = (doc != doc[head][window]) | (start != start[head][window])
        told = later | (several > 0)
        row, start, later, block = row[told], start[told], later[told], block[told]
        order = np.argsort(out_block, kind="stable")
        out_block, out_row, out_start, out_n = out_block[order], out_row[order], out_start[order], out_n[order]
        order = np.argsort(block, kind="stable")
        row, start, later, block = row[order], start[order], later[order], block[order]
        keys, blobs = [], []
        for k in np.union1d(out_block, block).tolist():
            own = slice(*np.searchsorted(out_block, [k, k + 1]).tolist())
            single = slice(*np.searchsorted(block, [k, k + 1]).tolist())
            keys.append(blocks[k])
            blobs.append(_packed(out_row[own].astype("<u4"), out_start[own].astype("<u4"), out_n[own].astype("<u4"),
                                 row[single].astype("<u4"), start[single].astype("<u4"), later[single].astype("u1")))
        return pa.table({"block": pa.array(keys, pa.int64()), "blob": pa.array(blobs, pa.binary())})
    return run


# -- removal

def _merged(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of ranges first:last, as disjoint ranges that don't touch."""
    order = np.argsort(first, kind="stable")
    first, last = first[order], np.maximum.accumulate(last[order])
    new = np.concatenate([[True], first[1:] > last[:-1]])
    return first[new], last[np.append(np.flatnonzero(new)[1:] - 1, len(last) - 1)]


def _singles(data: np.ndarray, offsets: np.ndarray, numbers: np.ndarray, row: np.ndarray, start: np.ndarray, later: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, start) of every repeated place of split windows, of which the block's earliest places are given and whether those repeat an earlier one."""
    raw = data.tobytes()
    lead = offsets[row] + start
    known = {raw[s:s + least]: k for k, s in enumerate(lead.tolist())}
    total, down = _sums(data)
    hashes = mix((total[least:] - total[:-least]) * down[:len(data) - least + 1])
    near = np.zeros(1 << 20, bool)  # which beginnings of hashes are asked for
    near[hashes[lead] >> U64(44)] = True
    places = np.flatnonzero(near[hashes >> U64(44)])
    places = places[np.isin(hashes[places], hashes[lead])]
    of = np.searchsorted(offsets, places, "right") - 1
    inside = places + least <= offsets[of + 1]
    places, of = places[inside], of[inside]
    window = np.array([known.get(raw[s:s + least], -1) for s in places.tolist()], np.int64)
    places, of, window = places[window >= 0], of[window >= 0], window[window >= 0]
    starts = places - offsets[of]
    repeated = (later[window] > 0) | (numbers[of] != numbers[row[window]]) | (starts != start[window])
    return of[repeated], starts[repeated]


def _remove(least: int, names: list[str], replace: bool):
    def run(table: pa.Table) -> pa.Table:
        kinds, blobs = table.column("kind").to_pylist(), table.column("blob").to_pylist()
        rows = _rows(next(b for k, b in zip(kinds, blobs) if k == 0))
        texts = rows.column(rows.schema.get_field_index("text"))
        data, offsets = text_bytes(texts)
        marks = [_unpacked(b, "<u4", "<u4", "<u4", "<u4", "<u4", "u1") for k, b in zip(kinds, blobs) if k == 1]
        at, start, n, *singles = (np.concatenate([m[k] for m in marks]).astype(np.int64) if marks else np.zeros(0, np.int64) for k in range(6))
        if len(singles[0]):
            more_at, more_start = _singles(data, offsets, _numbers(rows), *singles, least)
            at, start, n = np.concatenate([at, more_at]), np.concatenate([start, more_start]), np.concatenate([n, np.ones(len(more_at), np.int64)])
        order = np.argsort(at, kind="stable")
        at, start, n = at[order], start[order], n[order]
        low, high = np.searchsorted(at, np.arange(rows.num_rows)), np.searchsorted(at, np.arange(rows.num_rows), "right")
        sizes, removed, spans, digests, kept = np.diff(offsets), [], [], [], []
        raw = data.tobytes()
        for k, (a, b) in enumerate(zip(low.tolist(), high.tolist())):
            body = raw[offsets[k]:offsets[k + 1]]
            size, count = len(body), 0
            if b > a:
                first, last = _merged(start[a:b], start[a:b] + n[a:b] + least - 1)
                count = len(first)
                edges = np.concatenate([[0], np.column_stack([first, last]).ravel(), [len(body)]]).tolist()
                body = b"".join(body[x:y] for x, y in zip(edges[::2], edges[1::2]))
            removed.append(size - len(body))
            spans.append(count)
            digests.append(hashlib.sha256(body).hexdigest())
            kept.append(None if count == 0 else body.decode(errors="ignore"))
        out = dict(zip(rows.schema.names, rows.columns))
        if replace:
            whole = texts.to_pylist()
            out["text"] = pa.array([t if k is None else k for t, k in zip(whole, kept)], pa.string())
        out |= {"n_bytes": pa.array(sizes, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
        return pa.table({name: out[name] for name in names})
    return run


RESULT = (("n_bytes", LongType()), ("n_removed", LongType()), ("n_spans", LongType()), ("kept_sha256", StringType()))


def without_repeats(docs: DataFrame, least: int = LEAST, replace: bool = False, hot_runs: int = HOT_RUNS) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans (maximal removed stretches) and kept_sha256 of the remaining bytes; columns of those names are replaced.

    With replace, text is what remains; a character of which a cut leaves only some bytes goes too (a null text stays null).
    """
    docs = docs.drop(*[name for name, _ in RESULT])
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    range_bits = max(3, int(np.ceil(np.log2(max(1, size / RANGE_BYTES)))))
    blocks = cut_lineage(docs.mapInArrow(_blocks(docs.columns), "block long, blob binary"))
    whole = blocks.select("block", F.lit(0).alias("kind"), "blob")
    asked = blocks.mapInArrow(_ask(least, range_bits), "part long, block long, blob binary")
    answered = asked.groupBy("part").applyInArrow(_answer(hot_runs), "block long, blob binary").select("block", F.lit(1).alias("kind"), "blob")
    short = whole.unionByName(answered).groupBy("block").applyInArrow(_documents(least, range_bits), "part long, block long, blob binary")
    marks = short.groupBy("part").applyInArrow(_mark(least), "block long, blob binary").select("block", F.lit(1).alias("kind"), "blob")
    schema = StructType([StructField(f.name, f.dataType, True) for f in docs.schema] + [StructField(name, kind, True) for name, kind in RESULT])
    return whole.unionByName(marks).groupBy("block").applyInArrow(_remove(least, schema.names, replace), schema)
