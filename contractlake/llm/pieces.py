"""SentencePiece encoding and decoding with N-best segmentations.

The lattice of a text has an edge for each vocabulary piece that matches; a character without a piece of its own has one edge
of byte pieces. Forward Viterbi gives every place the best score of the text before it. A backward A* search from the end takes that
score as its estimate of the way left; as it is exact, the first N complete ways it pops are the N best.

No piece spans two neighbouring characters that stand next to each other in no piece, so the lattice falls apart there, and the best
segmentations of a text are combinations of those of its parts. The forward pass runs over many distinct parts at once, in arrays, and also gives
what each part's second best segmentation loses. The N best of a text take other ways in the parts with the smallest losses only, so
the search runs on those parts. Each task works on a distinct part once.

Scores: a model of merges has only the order of its pieces; their probability then falls with the rank (Zipf-Mandelbrot). Other
models' scores are taken as they are. Spaces are written as U+2581, with one put before the text; a U+2581 of the text itself goes by
bytes, so decoding gives back every text exactly. An empty or null text has no pieces.
Texts of any length are read whole, a long one as a slice of its own. Input columns that carry the name of a new column are replaced; all others are kept, whatever their names.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrays import U64, mix, powers
from .frames import arrow_columns

NBEST = 3
MARK = "▁"
# Distinct strings a task remembers at once.
REMEMBERED = 150_000
_CHUNK = re.compile(" +[^ ]*")
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")
# Parts of up to so many characters go through the arrays.
LONG = 24
TABLE_BITS = 19
BEGUN = -2
NEAR_BITS = 11
# Added to the score of the rarest piece for each byte of a character without a piece.
BYTE_PENALTY = -10.0


def _code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), np.array([len(t) for t in texts], np.int64)


def _running(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running hash along the last axis, with a 0 before it, and inverse powers."""
    up, down = powers(points.shape[-1])
    total = np.zeros((*points.shape[:-1], points.shape[-1] + 1), U64)
    np.cumsum(mix(points.astype(U64) + U64(0x51ED2701)) * up[:points.shape[-1]], axis=-1, out=total[..., 1:])
    return total, down


def _span_hash(total: np.ndarray, down: np.ndarray, start, end) -> np.ndarray:
    """Hashes of the code points start:end, never 0."""
    return mix((total[..., end] - total[..., start]) * down[start] + np.asarray(end - start).astype(U64)) | U64(1)


class Pieces:
    """Vocabulary with scores; encodes and decodes."""

    def __init__(self, pieces: list[str], scores: list[float], nbest: int = NBEST):
        """pieces: id is the place in the list; spaces as U+2581; byte pieces as <0x00>; control pieces as None."""
        self.nbest = nbest
        self.bytes = [b""] * len(pieces)
        self.edges: dict[str, tuple[int, float]] = {}
        self.byte_ids: dict[int, int] = {}
        for i, (piece, score) in enumerate(zip(pieces, scores)):
            if piece is None:
                continue
            if m := _BYTE.fullmatch(piece):
                self.byte_ids[int(m[1], 16)] = i
                self.bytes[i] = bytes([int(m[1], 16)])
            else:
                piece = piece.replace(MARK, " ")
                self.edges.setdefault(piece, (i, score))
                self.bytes[i] = piece.encode()
        self.longest = max(map(len, self.edges), default=1)
        self.prefixes = {p[:k] for p in self.edges for k in range(1, len(p) + 1)}
        self.pairs = {p[k:k + 2] for p in self.edges for k in range(len(p) - 1)}
        self.byte_score = min((s for _, s in self.edges.values()), default=0.0) + BYTE_PENALTY
        self.parts: dict[str, list] = {}

    @classmethod
    def load(cls, path: str, nbest: int = NBEST) -> Pieces:
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        skipped = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_unused(i)
        names = [None if skipped(i) else model.id_to_piece(i) for i in range(n)]
        scores = [model.get_score(i) for i in range(n)]
        plain = [i for i in range(n) if names[i] is not None and not model.is_byte(i)]
        gaps = np.diff([scores[i] for i in plain])
        if np.mean((gaps == -1) | (gaps == 0)) > 0.9:  # a model of merges: scores only count down
            weights = 1 / (np.arange(len(plain)) + 2.7)
            for i, w in zip(plain, np.log(weights / weights.sum()).tolist()):
                scores[i] = w
        return cls(names, scores, nbest)

    def _lattice(self, text: str) -> tuple[list[float], list[list[tuple[int, tuple[int, ...], float]]]]:
        """Best score before each place, and the edges that end there: (start, ids, score)."""
        n = len(text)
        best, into = [float("-inf")] * (n + 1), [[] for _ in range(n + 1)]
        best[0] = 0.0
        edges, prefixes = self.edges, self.prefixes
        for i in range(n):
            here = best[i]
            if text[i] not in edges:
                ids = tuple(self.byte_ids[b] for b in text[i].encode())
                score = self.byte_score * len(ids)
                into[i + 1].append((i, ids, score))
                if here + score > best[i + 1]:
                    best[i + 1] = here + score
            for j in range(i + 1, min(n, i + self.longest) + 1):
                part = text[i:j]
                if part not in prefixes:
                    break
                if part in edges:
                    piece, score = edges[part]
                    into[j].append((i, (piece,), score))
                    if here + score > best[j]:
                        best[j] = here + score
        return best, into

    def segmentations(self, text: str) -> list[tuple[float, tuple[int, ...]]]:
        """The N best (score, ids) of a part, best first; ties in the order of the search."""
        best, into = self._lattice(text)
        out, count = [], 0
        heap = [(-best[len(text)], 0, len(text), 0.0, None)]
        while heap and len(out) < self.nbest:
            _, _, at, score, path = heapq.heappop(heap)
            if not at:
                ids: list[int] = []
                while path:
                    ids.extend(path[0])
                    path = path[1]
                out.append((score, tuple(ids)))
                continue
            for start, ids, own in into[at]:
                count += 1
                heapq.heappush(heap, (-(score + own + best[start]), count, start, score + own, (ids, path)))
        return out

    def _part(self, part: str) -> list[tuple[float, tuple[int, ...]]]:
        found = self.parts.get(part)
        if found is None:
            if len(self.parts) >= REMEMBERED:
                self.parts.clear()
            found = self.parts[part] = self.segmentations(part)
        return found

    def combined(self, lists: Iterable[list[tuple[float, tuple[int, ...]]]]) -> list[tuple[float, tuple[int, ...]]]:
        """The N best ways to take one of each list; (loss against the best, which of each list)."""
        kept = [(0.0, ())]
        for options in lists:
            if len(options) == 1:
                kept = [(loss, (*which, 0)) for loss, which in kept]
                continue
            top = options[0][0]
            kept = heapq.nsmallest(self.nbest, [(loss + top - score, (*which, k)) for loss, which in kept for k, (score, _) in enumerate(options)])
        return kept

    def _split(self, text: str) -> list[str]:
        """Parts that no piece spans."""
        pairs = self.pairs
        cuts = [0, *[k for k in range(1, len(text)) if text[k - 1:k + 1] not in pairs], len(text)]
        return [text[a:b] for a, b in zip(cuts, cuts[1:])]

    # -- many texts at once

    def _prepare(self) -> None:
        """Arrays of the vocabulary for the forward pass: a hash table of the pieces, their scores, ids and bytes."""
        names = list(self.edges)
        begun = [*names, *(self.prefixes - self.edges.keys())]
        points, sizes = _code_points(begun)
        total, down = _running(points)
        ends = np.cumsum(sizes)
        hashes = _span_hash(total, down, ends - sizes, ends)
        self.slots = np.zeros(1 << TABLE_BITS, U64)
        self.slot_piece = np.zeros(1 << TABLE_BITS, np.int64)
        for k, h in enumerate(hashes.tolist()):
            at = h & (len(self.slots) - 1)
            while self.slots[at]:
                at = (at + 1) & (len(self.slots) - 1)
            self.slots[at], self.slot_piece[at] = h, k if k < len(names) else BEGUN
        self.piece_id = np.array([self.edges[n][0] for n in names], np.int64)
        self.piece_score = np.array([self.edges[n][1] for n in names])
        keys = np.array(sorted((ord(p[0]) << 32) | ord(p[1]) for p in self.pairs), np.int64)
        self.pair_keys = keys
        self.near_pairs = np.zeros((1 << NEAR_BITS) ** 2, bool)
        near = keys[((keys >> 32) < 1 << NEAR_BITS) & ((keys & 0xFFFFFFFF) < 1 << NEAR_BITS)]
        self.near_pairs[((near >> 32) << NEAR_BITS) | (near & 0xFFFFFFFF)] = True
        sizes = np.array([len(b) for b in self.bytes], np.int64)
        self.byte_sizes, self.byte_first, self.all_bytes = sizes, np.cumsum(sizes) - sizes, np.frombuffer(b"".join(self.bytes), np.uint8)
        self._forget()

    def _forget(self) -> None:
        self.codes: dict[int, int] = {}
        self.known = [np.zeros(0), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)]  # score, loss, first id, ids, all ids

    def _look_up(self, hashes: np.ndarray) -> np.ndarray:
        """Number of the piece with each hash, BEGUN for what only begins one, -1 for anything else."""
        at = (hashes & U64(len(self.slots) - 1)).astype(np.int64)
        own = self.slots[at]
        out = np.where(own == hashes, self.slot_piece[at], -1)
        again = np.flatnonzero((own != hashes) & (own != 0))
        while len(again):
            at[again] = (at[again] + 1) & (len(self.slots) - 1)
            own = self.slots[at[again]]
            hit = own == hashes[again]
            out[again[hit]] = self.slot_piece[at[again[hit]]]
            again = again[~hit & (own != 0)]
        return out

    def _forward(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Viterbi over parts of one length (a row each): best score, loss of the second best, and the best way's ids as (ids, ids of each part).

        A character that goes by bytes stands as -1 - its code point.
        """
        m, n = points.shape
        total, down = _running(points)
        best, second = np.full((n + 1, m), -np.inf), np.full((n + 1, m), -np.inf)
        best[0] = 0
        start, piece = np.zeros((n + 1, m), np.int64), np.zeros((n + 1, m), np.int64)
        for i in range(n):
            rows = np.arange(m)
            for j in range(i + 1, min(n, i + self.longest) + 1):
                number = self._look_up(mix((total[rows, j] - total[rows, i]) * down[i] + U64(j - i)) | U64(1))
                hit = number >= 0
                at, score, own = rows[hit], self.piece_score[number[hit]], self.piece_id[number[hit]]
                if j == i + 1 and len(at) < m:
                    alone = rows[~hit]
                    c = points[alone, i]
                    at, own = np.concatenate([at, alone]), np.concatenate([own, -1 - c])
                    score = np.concatenate([score, self.byte_score * (1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF))])
                first, top = best[i, at] + score, best[j, at]
                second[j, at] = np.maximum(np.maximum(second[j, at], second[i, at] + score), np.minimum(top, first))
                better = first > top
                at, first, own = at[better], first[better], own[better]
                best[j, at], start[j, at], piece[j, at] = first, i, own
                rows = rows[number != -1]
                if not len(rows):
                    break
        rows, place = np.arange(m), np.full(m, n)
        ids, owner = [], []
        while len(rows):
            ids.append(piece[place, rows])
            owner.append(rows)
            place = start[place, rows]
            rows, place = rows[place > 0], place[place > 0]
        ids, owner = np.concatenate(ids[::-1]), np.concatenate(owner[::-1])
        order = np.argsort(owner, kind="stable")
        return best[n], best[n] - second[n], ids[order], np.bincount(owner, minlength=m)

    def _learn(self, keys: list[int], points: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        """Best segmentations of new parts: code points start:start + size."""
        order = np.argsort(size, kind="stable")
        scores, losses, ids, counts = [], [], [], []
        for n in np.unique(size).tolist():
            own = order[np.searchsorted(size[order], n):np.searchsorted(size[order], n, "right")]
            if n > LONG:  # rare: one after the other
                for k in own.tolist():
                    text = "".join(map(chr, points[start[k]:start[k] + n].tolist()))
                    found = self._part(text)
                    scores.append(np.array([found[0][0]]))
                    losses.append(np.array([found[0][0] - found[1][0] if len(found) > 1 else np.inf]))
                    ids.append(np.array(found[0][1], np.int64))
                    counts.append(np.array([len(found[0][1])]))
                continue
            score, loss, some, count = self._forward(points[start[own][:, None] + np.arange(n)].astype(np.int64))
            if (some < 0).any():
                whole, bounds = [], np.cumsum(count) - count
                for a, c in zip(bounds.tolist(), count.tolist()):
                    whole.append([i for one in some[a:a + c].tolist() for i in ((one,) if one >= 0 else [self.byte_ids[b] for b in chr(-1 - one).encode()])])
                some, count = np.array([i for w in whole for i in w], np.int64), np.array([len(w) for w in whole])
            scores.append(score)
            losses.append(loss)
            ids.append(some)
            counts.append(count)
        scores, losses, ids, counts = (np.concatenate(x) for x in (scores, losses, ids, counts))
        old = self.known
        first = len(old[4]) + np.cumsum(counts) - counts
        self.known = [np.concatenate([a, b]) for a, b in zip(old, (scores, losses, first, counts, ids))]
        base = len(self.codes)
        self.codes.update(zip([keys[k] for k in order.tolist()], range(base, base + len(keys))))

    def encode_all(self, texts: list[str]) -> list[tuple[np.ndarray, list[float]]]:
        """(ids of the best segmentation, scores of the N best) of each text."""
        if not hasattr(self, "slots"):
            self._prepare()
        points, sizes = _code_points([" " + t if t else "" for t in texts])
        if not len(points):
            return [(np.zeros(0, np.int64), [0.0]) for _ in texts]
        cut = np.ones(len(points), bool)
        a, b = points[:-1].astype(np.int64), points[1:].astype(np.int64)
        near = (a < 1 << NEAR_BITS) & (b < 1 << NEAR_BITS)
        together = self.near_pairs[np.where(near, (a << NEAR_BITS) | b, 0)] & near
        far = np.flatnonzero(~near)
        if len(far) and len(self.pair_keys):
            key = (a[far] << 32) | b[far]
            together[far] = self.pair_keys[np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)] == key
        cut[1:] = ~together
        bounds = np.cumsum(sizes)
        cut[bounds[:-1][bounds[:-1] < len(points)]] = True
        start = np.flatnonzero(cut)
        size = np.diff(np.append(start, len(points)))
        total, down = _running(points)
        hashes = _span_hash(total, down, start, start + size)
        distinct, at, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.codes) + len(distinct) > REMEMBERED:
            self._forget()
        keys = distinct.tolist()
        new = [k for k, h in enumerate(keys) if h not in self.codes]
        if new:
            self._learn([keys[k] for k in new], points, start[at[new]], size[at[new]])
        code = np.fromiter(map(self.codes.__getitem__, keys), np.int64, len(keys))[inverse]
        score, loss, first, count, ids = self.known
        counts = count[code]
        ends = np.cumsum(counts)
        ids = ids[np.repeat(first[code] - (ends - counts), counts) + np.arange(ends[-1])]
        part_bounds = np.searchsorted(start, np.append(0, bounds))
        id_bounds = np.append(0, ends)[part_bounds]
        sums = np.append(0, np.cumsum(score[code]))
        out = []
        for k in range(len(texts)):
            low, high = int(part_bounds[k]), int(part_bounds[k + 1])
            own = loss[code[low:high]]
            few = np.argsort(own, kind="stable")[:self.nbest - 1]
            few = few[np.isfinite(own[few])]
            losses = [0.0]
            for p in sorted(few.tolist()):
                options = self._part("".join(map(chr, points[start[low + p]:start[low + p] + size[low + p]].tolist())))
                losses = sorted(x + options[0][0] - o for x in losses for o, _ in options)[:self.nbest]
            best = float(score[code[low:high]].sum()) if high > low else 0.0
            out.append((ids[id_bounds[k]:id_bounds[k + 1]], [best - x for x in losses]))
        return out

    def encode(self, text: str) -> tuple[np.ndarray, list[float]]:
        return self.encode_all([text])[0]

    def text_bytes(self, ids: np.ndarray) -> bytes:
        """UTF-8 bytes of the text that ids stand for."""
        size = self.byte_sizes[ids]
        ends = np.cumsum(size)
        return self.all_bytes[np.repeat(self.byte_first[ids] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)].tobytes()[1:]

    def nbest_ids(self, text: str) -> list[tuple[float, list[int]]]:
        """The N best (score, ids) of a whole text."""
        if not text:
            return [(0.0, [])]
        lists = [self._part(p) for c in _CHUNK.findall(" " + text) for p in self._split(c)]
        top = sum(options[0][0] for options in lists)
        return [(top - loss, [i for options, k in zip(lists, which) for i in options[k][1]]) for loss, which in self.combined(lists)]

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids))[1:].decode(errors="replace")


COLUMNS = (("n_pieces", "bigint"), ("ids_crc32", "bigint"), ("best_score", "double"), ("nbest_scores", "array<double>"), ("round_trip", "boolean"))


def with_pieces(docs: DataFrame, model_path: str, nbest: int = NBEST, with_ids: bool = False) -> DataFrame:
    """docs with `COLUMNS` for each whole text: length and crc32 of the best segmentation's ids, its score, the scores of the N best
    (fewer where the text has fewer segmentations), and whether decoding the ids gives back the text. With `with_ids`, the ids too."""
    def setup():
        pieces = Pieces.load(model_path, nbest)

        def work(batch):
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            found = pieces.encode_all([t or "" for t in texts])
            ids = [f[0] for f in found]
            out = [pa.array([len(i) for i in ids], pa.int64()), pa.array([zlib.crc32(i.astype("<u4").tobytes()) for i in ids], pa.int64()), pa.array([f[1][0] for f in found], pa.float64()),
                   pa.array([f[1] for f in found], pa.list_(pa.float64())), pa.array([pieces.text_bytes(i) == (t or "").encode() for i, t in zip(ids, texts)], pa.bool_())]
            return out + ([pa.array([i.astype(np.int64) for i in ids], pa.list_(pa.int64()))] if with_ids else [])
        return work
    return arrow_columns(docs, [*COLUMNS, *([("ids", "array<bigint>")] if with_ids else [])], setup)


def decoded(rows: DataFrame, model_path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """rows with the text of their ids; a null list gives null."""
    from pyspark.sql.types import StringType, StructField, StructType
    kept = rows.drop(text)
    schema = StructType([*kept.schema.fields, StructField(text, StringType())])
    names = schema.names

    def run(batches):
        pieces = Pieces.load(model_path)
        for batch in batches:
            out = [None if own is None else pieces.decode(own) for own in batch.column(batch.schema.get_field_index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=names)
    return kept.mapInArrow(run, schema)
