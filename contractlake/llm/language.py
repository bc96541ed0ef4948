"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of n-grams of 1 to 3 lower-case code points cover every learned document. The matrix of log probabilities
(n-gram bucket x language) has a fixed number of rows, so it is broadcast. A slice of texts is a sparse matrix, one row of bucket
numbers for each text; its product with the matrix gives the log likelihoods.
A null text or one without a letter is `und` with score 0. The score is the posterior probability of the predicted language.
Languages that tie are settled by name. Rows with null text or language are not learned from; without any learned row all texts are `und`.
Texts of any length are read whole, a long one as a slice of its own. Input columns that carry the name of a new column are replaced; all others are kept, whatever their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import arrow_columns

BITS = 15
ORDERS = 3
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_STEP = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35))


def buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of all n-grams, text after text, and how many each text has."""
    lowered = [t.lower() for t in texts]
    sizes = np.array([len(t) for t in lowered], np.int64)
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    # entry (i, n) is the n-gram that begins at code point i; those beyond the text's end are masked
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(points))
    found, inside = np.zeros((len(points), ORDERS), np.int32), np.zeros((len(points), ORDERS), bool)
    value = np.zeros(len(points), np.uint32)
    for n in range(ORDERS):
        value[:len(points) - n] += (points[n:] + np.uint32(n)) * _STEP[n]
        mixed = value ^ (value >> np.uint32(15))
        mixed *= np.uint32(0x2C1B3C6D)
        found[:, n] = ((mixed ^ (mixed >> np.uint32(13))) * np.uint32(0x297A2D39)) >> np.uint32(32 - BITS)
        inside[:, n] = left > n
    counts = sum(np.maximum(sizes - n, 0) for n in range(ORDERS))
    return found[inside], counts


@dataclass
class Model:
    languages: list[str]
    log_prior: np.ndarray
    log_prob: np.ndarray  # bucket x language

    def log_likelihoods(self, found: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """One row a text, in double precision: its distinct buckets, counted first, times their rows of the matrix. Memory does not grow with a text's length times languages."""
        out, at = np.tile(self.log_prior, (len(counts), 1)), 0
        for k, n in enumerate(counts.tolist()):
            times = np.bincount(found[at:at + n], minlength=len(self.log_prob))
            some = np.flatnonzero(times)
            out[k] += times[some] @ self.log_prob[some]
            at += n
        return out


def count_ngrams(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, bucket, n) over all documents that have both; bucket -1 counts the documents. Summed up in each task before the shuffle."""
    def run(batches):
        sums: dict[str, np.ndarray] = {}
        docs_of: dict[str, int] = {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for k in range(0, len(texts), 256):
                some, own = texts[k:k + 256], np.array(langs[k:k + 256])
                found, counts = buckets(some)
                of = np.repeat(own, counts)
                for name in np.unique(own):
                    name = str(name)
                    sums[name] = sums.get(name, 0) + np.bincount(found[of == name], minlength=1 << BITS)
                    docs_of[name] = docs_of.get(name, 0) + int((own == name).sum())
        for name, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([name] * (len(at) + 1)), pa.array(np.append(at, -1)), pa.array(np.append(total[at], docs_of[name]))],
                                             names=["lang", "bucket", "n"])
    known = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    return known.mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, smoothing: float = 0.1) -> Model:
    """Model over all rows of docs(text, lang). One number per language and bucket reaches the driver."""
    table = count_ngrams(docs).toArrow().to_pandas()
    languages = sorted(table.lang.unique())
    counts, seen = np.zeros((1 << BITS, len(languages))), np.zeros(len(languages))
    for k, name in enumerate(languages):
        own = table[table.lang == name]
        words = own[own.bucket >= 0]
        counts[words.bucket.to_numpy(), k] = words.n.to_numpy()
        seen[k] = own[own.bucket < 0].n.sum()
    counts += smoothing
    return Model(languages, np.log(seen / max(seen.sum(), 1)), np.log(counts / counts.sum(axis=0)))


def with_language(docs: DataFrame, model: Model, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with the likeliest language of each whole text and its posterior probability."""
    sent = docs.sparkSession.sparkContext.broadcast((model.languages, model.log_prior, model.log_prob))

    def setup():
        own = Model(*sent.value)

        def work(batch):
            texts = [t or "" for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            n = len(texts)
            best, sure = [UNKNOWN] * n, np.zeros(n)
            if own.languages:
                for k in range(0, n, 256):
                    some = texts[k:k + 256]
                    logs = own.log_likelihoods(*buckets(some))
                    odds = np.exp(logs - logs.max(axis=1, keepdims=True))
                    top = logs.argmax(axis=1)
                    for i, t in enumerate(some):
                        if _LETTER.search(t):
                            best[k + i] = own.languages[top[i]]
                            sure[k + i] = odds[i, top[i]] / odds[i].sum()
            return [pa.array(best, pa.string()), pa.array(sure)]
        return work
    return arrow_columns(docs, [(lang, "string"), (score, "double")], setup)
