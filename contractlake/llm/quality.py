"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_j x_j + sum_{i<j} <v_i, v_j> x_i x_j). The pair term is worked out in linear time as
half of sum_f ((sum_j v_jf x_j)^2 - sum_j v_jf^2 x_j^2).

Inputs are hashed words (1 + log of the count, scaled to length 1 per text), and structure statistics and numeric metadata
cut into bins at quantiles of the training rows. A null or empty text has no words and its own statistics, so it gets a score
too; missing metadata is a bin of its own. Equal texts with equal metadata get equal scores; repeated rows are scored each.
Texts of any length are read whole, a long one as a slice of its own. Input columns that carry the name of a new column are replaced; all others are kept, whatever their names.
"""

from __future__ import annotations

import pickle
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import U64, Words, segment_sums, shingles, text_bytes
from .frames import arrow_columns

WORD_BITS = 15
BINS = 12
RANK = 8
# At most so many labelled rows are fitted on: those with the smallest hash of their id.
SAMPLE_ROWS = 6_000

# Byte classes: 0 other, 1 a-z, 2 A-Z, 3 digit, 4 space, 5 line break, 6 !, 7 |, 8 symbol, 9 end of sentence, 10 beyond ASCII
_CLASS = np.zeros(256, np.int64)
for _class, _bytes in ((1, range(97, 123)), (2, range(65, 91)), (3, range(48, 58)), (4, (9, 32)), (5, (10, 13)), (6, b"!"), (7, b"|"),
                       (8, b"#$%&*@^~<>{}[]\\/=+_"), (9, b".?"), (10, range(128, 256))):
    _CLASS[list(_bytes)] = _class
CLASSES = 11
STATISTICS = CLASSES + 7


def statistics(data: np.ndarray, offsets: np.ndarray, words: Words) -> np.ndarray:
    """One row of structure statistics for each document."""
    n, sizes = words.n_docs, np.diff(offsets)
    doc_of_byte = np.repeat(np.arange(n), sizes)
    shares = np.bincount(doc_of_byte * CLASSES + _CLASS[data], minlength=n * CLASSES).reshape(n, CLASSES) / np.maximum(sizes, 1)[:, None]
    counts = np.maximum(words.counts, 1)
    lengths = segment_sums((words.end - words.start).astype(float), words.first, words.counts)
    doc, _, times = _distinct(words.doc, words.hash)
    distinct = np.bincount(doc, minlength=n)
    most = np.zeros(n)
    np.maximum.at(most, doc, times)
    run_doc, run = shingles(words, 3)
    runs, distinct_runs = np.bincount(run_doc, minlength=n), np.bincount(_distinct(run_doc, run)[0], minlength=n)
    return np.column_stack([shares, lengths / counts, np.log1p(sizes), np.log1p(words.counts), distinct / counts, most / counts,
                            distinct_runs / np.maximum(runs, 1), np.log1p(runs - distinct_runs)])


def _distinct(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, key), ordered by document, with counts."""
    order = np.lexsort((key, doc))
    doc, key = doc[order], key[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
    at = np.flatnonzero(new)
    return doc[at], key[at], np.diff(np.append(at, len(doc)))


def hashed_words(words: Words, bits: int = WORD_BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, bucket, weight) of distinct words, ordered by document."""
    doc, key, times = _distinct(words.doc, words.hash >> U64(64 - bits))
    weight = 1 + np.log(times)
    norm = np.sqrt(np.bincount(doc, weight * weight, minlength=words.n_docs))
    return doc, key.astype(np.int64), weight / norm[doc] if len(doc) else weight


@dataclass
class Rows:
    """Sparse rows: index and value of each entry, entries per row."""
    index: np.ndarray
    value: np.ndarray
    counts: np.ndarray


@dataclass
class Machine:
    """Fitted machine; `edges` are the cut points of each statistic."""
    edges: np.ndarray
    metadata: tuple[str, ...]
    w0: float
    w: np.ndarray
    v: np.ndarray

    def rows(self, doc: np.ndarray, bucket: np.ndarray, weight: np.ndarray, stats: np.ndarray) -> Rows:
        n, m = stats.shape
        bins = np.stack([np.searchsorted(self.edges[j], stats[:, j], "right") for j in range(m)], axis=1) if n else np.zeros((0, m), np.int64)
        bins = np.where(np.isnan(stats), BINS, bins)
        own = bins + np.arange(m) * (BINS + 1)
        words = np.bincount(doc, minlength=n)
        index = np.concatenate([own.ravel(), bucket + m * (BINS + 1)])
        value = np.concatenate([np.full(n * m, 1 / np.sqrt(m)), weight])
        order = np.argsort(np.concatenate([np.repeat(np.arange(n), m), doc]), kind="stable")
        return Rows(index[order], value[order], words + m)

    def raw(self, rows: Rows) -> tuple[np.ndarray, np.ndarray]:
        """Sum before the sigmoid, and the factor sums of each row."""
        first = np.cumsum(rows.counts) - rows.counts
        x = rows.value[:, None]
        vx = self.v[rows.index] * x
        s = segment_sums(vx, first, rows.counts)
        q = segment_sums(vx * vx, first, rows.counts)
        return self.w0 + segment_sums(self.w[rows.index] * rows.value, first, rows.counts) + 0.5 * (s * s - q).sum(axis=1), s

    def score(self, rows: Rows) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(rows)[0], -30, 30)))


def _described(batch: pa.RecordBatch, metadata: Sequence[str]) -> tuple:
    data, offsets = text_bytes(batch.column(batch.schema.get_field_index("text")))
    words = Words(data, offsets)
    extra = [np.log1p(np.abs(pc.cast(batch.column(batch.schema.get_field_index(c)), pa.float64()).to_numpy(zero_copy_only=False).astype(float))) for c in metadata]
    stats = np.column_stack([statistics(data, offsets, words), *extra]) if extra else statistics(data, offsets, words)
    return (*hashed_words(words), stats)


def features(docs: DataFrame, metadata: Sequence[str] = ()) -> DataFrame:
    """docs with buckets, weights and stats of each text as arrays."""
    def setup():
        def work(batch):
            doc, bucket, weight, stats = _described(batch, metadata)
            ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=batch.num_rows))]).astype(np.int32)
            rows = np.arange(0, stats.size + 1, stats.shape[1], dtype=np.int32)
            return [pa.ListArray.from_arrays(ends, pa.array(bucket.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(weight.astype(np.float32))),
                    pa.ListArray.from_arrays(rows, pa.array(stats.ravel()))]
        return work
    return arrow_columns(docs, [("buckets", "array<int>"), ("weights", "array<float>"), ("stats", "array<double>")], setup)


def training_rows(labels: DataFrame, label: str, wanted: Column, limit: int) -> DataFrame:
    """(doc_id, label) of at most `limit` labelled documents, those with the smallest hash of the id; nulls don't count, of several labels the least does."""
    marked = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & wanted).groupBy("doc_id").agg(F.min(label).alias("label"))
    return marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def fit(docs: DataFrame, labels: DataFrame, label: str, wanted: Column, metadata: Sequence[str] = (), limit: int = SAMPLE_ROWS,
        epochs: int = 6, rate: float = 0.1, decay: float = 1e-5, seed: int = 7) -> Machine:
    """Fit on labels where `wanted` (a condition on doc_id) holds, at most `limit` of them: they are broadcast, and fitted in one task.

    Only the model reaches the driver.
    """
    chosen = training_rows(labels, label, wanted, limit)
    sample = docs.select("doc_id", "text", *metadata).join(F.broadcast(chosen), "doc_id")
    described = features(sample, metadata).select("doc_id", "label", "buckets", "weights", "stats")

    def run(batches):
        model = _fitted([b for b in batches if b.num_rows], tuple(metadata), epochs, rate, decay, seed)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((model.edges, model.w0, model.w, model.v))], pa.binary())], names=["model"])

    edges, w0, w, v = pickle.loads(described.repartition(1).mapInArrow(run, "model binary").first()["model"])
    return Machine(edges, tuple(metadata), w0, w, v)


def _fitted(batches: list[pa.RecordBatch], metadata: tuple[str, ...], epochs: int, rate: float, decay: float, seed: int) -> Machine:
    """Machine fitted on described rows (doc_id, label, buckets, weights, stats)."""
    width = STATISTICS + len(metadata)
    size = width * (BINS + 1) + (1 << WORD_BITS)
    if not batches:
        return Machine(np.zeros((width, BINS - 1)), metadata, 0.0, np.zeros(size), np.zeros((size, RANK)))
    table = pa.Table.from_batches(batches)
    n = table.num_rows
    table = table.take(pc.sort_indices(table, [("doc_id", "ascending")])).combine_chunks()
    flat = lambda c: table.column(c).combine_chunks()
    stats = flat("stats").flatten().to_numpy(zero_copy_only=False).reshape(n, width)
    truth = (table.column("label").to_numpy() > 0).astype(float)
    counts = np.diff(flat("buckets").offsets.to_numpy())
    edges = np.nan_to_num(np.nanquantile(np.where(np.isnan(stats).all(axis=0), 0.0, stats), np.arange(1, BINS) / BINS, axis=0).T)
    rng = np.random.default_rng(seed)
    prior = np.clip(truth.mean(), 1e-3, 1 - 1e-3)
    model = Machine(edges, metadata, float(np.log(prior / (1 - prior))), np.zeros(size), rng.normal(0, 0.02, (size, RANK)))
    rows = model.rows(np.repeat(np.arange(n), counts), flat("buckets").flatten().to_numpy().astype(np.int64), flat("weights").flatten().to_numpy().astype(float), stats)
    _descend(model, rows, truth, epochs, rate, decay, rng)
    return model


def _descend(model: Machine, rows: Rows, truth: np.ndarray, epochs: int, rate: float, decay: float, rng, batch: int = 128) -> None:
    """Steps scaled by past gradients (AdaGrad) over shuffled small batches."""
    ends = np.cumsum(rows.counts)
    starts = ends - rows.counts
    gw, gv, g0 = np.full(model.w.shape, 1e-6), np.full(model.v.shape, 1e-6), 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(truth))
        for k in range(0, len(order), batch):
            some = order[k:k + batch]
            counts = rows.counts[some]
            at = np.repeat(starts[some] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
            part = Rows(rows.index[at], rows.value[at], counts)
            raw, s = model.raw(part)
            off = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - truth[some]) / len(some)
            row = np.repeat(np.arange(len(some)), counts)
            pull = off[row] * part.value
            to_v = pull[:, None] * (s[row] - model.v[part.index] * part.value[:, None])
            by = np.argsort(part.index, kind="stable")
            index = part.index[by]
            first = np.flatnonzero(np.concatenate([[True], index[1:] != index[:-1]]))
            own = index[first]
            dw = np.add.reduceat(pull[by], first) + decay * model.w[own]
            dv = np.add.reduceat(to_v[by], first, axis=0) + decay * model.v[own]
            gw[own] += dw * dw
            gv[own] += dv * dv
            g0 += off.sum() ** 2
            model.w[own] -= rate * dw / np.sqrt(gw[own])
            model.v[own] -= 0.5 * rate * dv / np.sqrt(gv[own])
            model.w0 -= rate * off.sum() / np.sqrt(g0)


def with_scores(docs: DataFrame, model: Machine, score: str = "score") -> DataFrame:
    """docs with the machine's score of each whole text."""
    sent = docs.sparkSession.sparkContext.broadcast((model.edges, model.w0, model.w.astype(np.float32), model.v.astype(np.float32)))
    metadata = model.metadata

    def setup():
        edges, w0, w, v = sent.value
        own = Machine(edges, metadata, w0, w, v)

        def work(batch):
            return [pa.array(own.score(own.rows(*_described(batch, metadata))).astype(float))]
        return work
    return arrow_columns(docs, [(score, "double")], setup)
