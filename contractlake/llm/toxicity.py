"""Toxicity severity by cumulative-link ordinal regression over sparse text features.

P(grade > k) = sigmoid(w.x - threshold_k): one weight for each feature, shared by all thresholds, and ordered thresholds. The expected
severity is the sum of P(grade > k) over the thresholds, from 0 to the highest grade.

Features are the distinct runs of letters of a text and the first 3 to 6 bytes of longer ones (stems), hashed. A feature counts
with the logarithm of how much more often it stands in texts of a grade above 0 than in the others (smoothed, from the fitted sample), so that
few telling words outweigh many chance ones; weights are fitted with a soft threshold (FTRL), so features that tell nothing get none. Labels of more than two values are grades as
they are; 0/1 labels are refined: labelled texts are graded 1 to 3 by thirds of the share of their features that mark the label.

A null or empty text has no features and gets the severity of the thresholds alone. Labels that are null don't count. Repeated rows are scored each.
Texts of any length are read whole, a long one as a slice of its own. Input columns that carry the name of a new column are replaced; all others are kept, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import U64, Words, segment_sums, text_bytes
from .frames import arrow_columns
from .quality import _distinct, training_rows

BITS = 18
STEMS = (3, 4, 5, 6)
GRADES = 3
SPACING = 4.0
# At most so many labelled rows are fitted on: those with the smallest hash of their id.
SAMPLE_ROWS = 12_000
_NOT_LETTER = np.ones(256, bool)
_NOT_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False


def features(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each feature, features per text), text after text."""
    words = Words(*text_bytes(batch.column(batch.schema.get_field_index("text"))), _NOT_LETTER)
    docs, keys = [words.doc], [words.hash]
    for size in STEMS:
        long = words.end - words.start > size
        docs.append(words.doc[long])
        keys.append(words.spans(words.start[long], words.start[long] + size) ^ U64(0x5555555555555555))
    doc, bucket, _ = _distinct(np.concatenate(docs), np.concatenate(keys) >> U64(64 - BITS))
    return bucket.astype(np.int64), np.bincount(doc, minlength=batch.num_rows)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Scale:
    """Weights, shared by all grades, and ascending thresholds."""
    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, bucket: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """P(grade > k) for each text and threshold."""
        raised = segment_sums(self.weights[bucket], np.cumsum(counts) - counts, counts)
        return _sigmoid(raised[:, None] - self.thresholds)


def refined(bucket: np.ndarray, counts: np.ndarray, label: np.ndarray, grades: int = GRADES) -> np.ndarray:
    """Grades of 0/1 labels: 0 stays, 1 becomes 1..grades by equal parts of the share of features that mark the label."""
    text = np.repeat(np.arange(len(counts)), counts)
    marked = np.bincount(bucket[label[text] > 0], minlength=1 << BITS)
    plain = np.bincount(bucket[label[text] == 0], minlength=1 << BITS)
    odds = ((marked + 0.5) / ((label > 0).sum() + 1)) / ((plain + 0.5) / ((label == 0).sum() + 1))
    marks = (odds >= 20) & (marked >= 5)
    share = np.bincount(text, marks[bucket], len(counts)) / np.maximum(counts, 1)
    out = np.zeros(len(label), np.int64)
    some = np.flatnonzero(label > 0)
    out[some[np.argsort(share[some], kind="stable")]] = 1 + np.arange(len(some)) * grades // max(len(some), 1)
    return out


def fit(docs: DataFrame, labels: DataFrame, label: str, wanted: Column, limit: int = SAMPLE_ROWS, epochs: int = 4, rate: float = 0.1, sparsity: float = 2.0,
        batch: int = 64, seed: int = 11) -> Scale:
    """Fit on labels where `wanted` (a condition on doc_id) holds, at most `limit` of them (they are broadcast and fitted on the driver)."""
    sample = docs.select("doc_id", "text").join(F.broadcast(training_rows(labels, label, wanted, limit)), "doc_id")

    def setup():
        def work(part):
            bucket, counts = features(part)
            return [pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), pa.array(bucket.astype(np.int32)))]
        return work
    table = arrow_columns(sample, [("buckets", "array<int>")], setup).select("doc_id", "label", "buckets").toArrow()
    if not table.num_rows:
        return Scale(np.zeros(1 << BITS), np.arange(1, GRADES + 1, dtype=float) * 4)
    table = table.take(pc.sort_indices(table, [("doc_id", "ascending")])).combine_chunks()
    lists = table.column("buckets").combine_chunks()
    bucket, counts = lists.flatten().to_numpy().astype(np.int64), np.diff(lists.offsets.to_numpy())
    grade = np.maximum(table.column("label").to_numpy().astype(np.int64), 0)
    if grade.max() <= 1:
        grade = refined(bucket, counts, grade)
    return _fitted(bucket, counts, grade, epochs, rate, sparsity, batch, seed)


def telling(bucket: np.ndarray, counts: np.ndarray, grade: np.ndarray, smoothing: float = 10.0) -> np.ndarray:
    """Logarithm of each feature's rate in texts of a grade above 0 against its rate in the others, 0 where that is lower."""
    text = np.repeat(np.arange(len(counts)), counts)
    share = min(max((grade > 0).mean(), 1e-3), 1 - 1e-3)
    high = np.bincount(bucket[grade[text] > 0], minlength=1 << BITS) + smoothing * share
    low = np.bincount(bucket[grade[text] == 0], minlength=1 << BITS) + smoothing * (1 - share)
    return np.maximum(np.log(high / share) - np.log(low / (1 - share)), 0)


def _fitted(bucket: np.ndarray, counts: np.ndarray, grade: np.ndarray, epochs: int, rate: float, sparsity: float, batch: int, seed: int) -> Scale:
    top = max(int(grade.max()), 1)
    below = np.clip([(grade <= k).mean() for k in range(top)], 1e-3, 1 - 1e-3)
    # from the grades' shares, and far enough apart that each grade has room between its thresholds
    thresholds = np.maximum.accumulate(np.log(below / (1 - below)) + SPACING * np.arange(top))
    scale = telling(bucket, counts, grade)
    z, n, gt = np.zeros(1 << BITS), np.zeros(1 << BITS), np.full(top, 1.0)
    ends = np.cumsum(counts)
    starts = ends - counts
    rng = np.random.default_rng(seed)

    def weight(own):
        return np.where(np.abs(z[own]) <= sparsity, 0.0, -(z[own] - np.sign(z[own]) * sparsity) / ((1 + np.sqrt(n[own])) / rate))

    for _ in range(epochs):
        order = rng.permutation(len(grade))
        for k in range(0, len(order), batch):
            some = order[k:k + batch]
            size = counts[some]
            at = np.repeat(starts[some] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            own, inverse = np.unique(bucket[at], return_inverse=True)
            w = weight(own)
            row = np.repeat(np.arange(len(some)), size)
            raised = np.bincount(row, (w * scale[own])[inverse], len(some))
            y = grade[some]
            upper = np.where(y < top, _sigmoid(thresholds[np.minimum(y, top - 1)] - raised), 1.0)
            lower = np.where(y > 0, _sigmoid(thresholds[np.maximum(y - 1, 0)] - raised), 0.0)
            pull = 1 - upper - lower  # slope of -log(upper - lower)
            g = np.bincount(inverse, pull[row], len(own)) * scale[own]
            step = (np.sqrt(n[own] + g * g) - np.sqrt(n[own])) / rate
            z[own] += g - step * w
            n[own] += g * g
            within = np.maximum(upper - lower, 1e-9)
            to = np.zeros(top)
            np.add.at(to, y[y < top], -(upper * (1 - upper) / within)[y < top])
            np.add.at(to, y[y > 0] - 1, (lower * (1 - lower) / within)[y > 0])
            gt += to * to
            thresholds = np.maximum.accumulate(thresholds - 0.5 * to / np.sqrt(gt))
    return Scale(weight(np.arange(1 << BITS)) * scale, thresholds)


def with_severity(docs: DataFrame, scale: Scale, severity: str = "severity", grade: str = "grade", above: str = "p_toxic") -> DataFrame:
    """docs with expected severity, likeliest grade, and the probability of a grade above 0, of each whole text."""
    sent = docs.sparkSession.sparkContext.broadcast((scale.weights, scale.thresholds))

    def setup():
        own = Scale(*sent.value)

        def work(part):
            p = own.above(*features(part))
            within = np.column_stack([np.ones(len(p)), p]) - np.column_stack([p, np.zeros(len(p))])
            return [pa.array(p.sum(axis=1)), pa.array(within.argmax(axis=1).astype(np.int32)), pa.array(p[:, 0])]
        return work
    return arrow_columns(docs, [(severity, "double"), (grade, "int"), (above, "double")], setup)
