"""Classifiers: held-out accuracy on made-up texts, and the defined results of odd rows."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from contractlake.llm import language, quality, toxicity
from contractlake.llm.frames import fold

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def made(spark, texts, **columns):
    rows = [(i, t, columns.get("lang", [None] * len(texts))[i], "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def words(rng, pool, n):
    return " ".join(rng.choice(pool) for _ in range(n))


@pytest.fixture(scope="module")
def pool():
    rng = random.Random(3)
    return ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8))) for _ in range(400)]


def test_quality_learns_structure(spark, pool):
    rng = random.Random(1)
    texts = [words(rng, pool, 60) if i % 3 else words(rng, pool, 5).upper() + "!! " * 30 for i in range(240)]
    docs = made(spark, [*texts, None, "", "x" * 200_000])
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(240)] + [(5, None), (None, 1)], "doc_id long, quality int")
    model = quality.fit(docs, labels, "quality", fold("doc_id", 5) != 0, metadata=("n_chars",))
    scored = {r["doc_id"]: r["score"] for r in quality.with_scores(docs.withColumn("score", F.lit("old")), model).collect()}
    held = [i for i in range(240) if __import__("zlib").crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(scored[i] >= 0.3) == (i % 3 > 0) for i in held]) > 0.95
    assert len(scored) == 243 and all(0 <= s <= 1 for s in scored.values())


def test_quality_pair_term_equals_the_double_sum():
    rng = np.random.default_rng(0)
    model = quality.Machine(np.zeros((0, 0)), (), 0.3, rng.normal(size=50), rng.normal(size=(50, 4)))
    index, value = np.array([3, 7, 9, 4, 11]), rng.normal(size=5)
    raw, _ = model.raw(quality.Rows(index, value, np.array([3, 0, 2])))
    for got, part in zip(raw, (slice(0, 3), slice(0, 0), slice(3, 5))):
        i, x = index[part], value[part]
        pairs = sum(model.v[i[a]] @ model.v[i[b]] * x[a] * x[b] for a in range(len(i)) for b in range(a))
        assert got == pytest.approx(0.3 + model.w[i] @ x + pairs)


def test_quality_without_labels_or_rows(spark):
    docs = made(spark, ["a b c", None])
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.fit(docs, none, "quality", F.lit(True))
    assert [r["score"] for r in quality.with_scores(docs, model).collect()] == [0.5, 0.5]
    assert quality.with_scores(docs.limit(0), model).count() == 0


def test_toxicity_grades_follow_the_share_of_marked_words(spark, pool):
    rng = random.Random(2)
    texts, grade = [], []
    for i in range(300):
        bad = (0, 0, 0, 2, 12)[i % 5]
        text = words(rng, pool, 40).split() + [rng.choice(("zzfoul", "zzfoulish", "qqvile")) for _ in range(bad)]
        rng.shuffle(text)
        texts.append(" ".join(text))
        grade.append(bad)
    docs = made(spark, [*texts, None, ""])
    labels = spark.createDataFrame([(i, int(g > 0)) for i, g in enumerate(grade)], "doc_id long, toxic int")
    scale = toxicity.fit(docs, labels, "toxic", fold("doc_id", 5) != 0)
    assert (np.diff(scale.thresholds) >= 0).all()
    got = {r["doc_id"]: r for r in toxicity.with_severity(docs, scale).collect()}
    held = [i for i in range(300) if __import__("zlib").crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i]["p_toxic"] >= 0.3) == (grade[i] > 0) for i in held]) > 0.95
    mean = {b: np.mean([got[i]["severity"] for i in held if grade[i] == b]) for b in (0, 2, 12)}
    assert mean[0] < 0.3 < mean[2] and mean[0] < mean[12]
    assert got[300]["severity"] == got[301]["severity"] < 0.3
    assert toxicity.with_severity(docs.limit(0), scale).count() == 0


def test_toxicity_probabilities_share_weights():
    scale = toxicity.Scale(np.arange(1 << toxicity.BITS) / 10.0, np.array([0.0, 1.0, 3.0]))
    p = scale.above(np.array([1, 2, 5]), np.array([2, 0, 1]))
    assert p.shape == (3, 3) and p[1] == pytest.approx(1 / (1 + np.exp([0, 1, 3])))
    assert p[0] == pytest.approx(1 / (1 + np.exp(np.array([0, 1, 3]) - 0.3)))


def test_toxicity_without_labels(spark):
    docs = made(spark, ["a"])
    scale = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"), "toxic", F.lit(True))
    assert toxicity.with_severity(docs, scale).first()["grade"] == 0


def test_language_counts_and_scores_by_brute_force(spark):
    texts = ["abc abd", "xyz xyy", None, "", "123 !?", "ABCABC", "a" * 100_000]
    langs = ["l1", "l2", "l1", None, "l2", None, None]
    docs = made(spark, texts, lang=langs)
    model = language.fit(docs)
    assert model.languages == ["l1", "l2"]
    counts = {name: np.zeros(1 << language.BITS) for name in model.languages}
    for t, name in zip(texts, langs):
        if t is not None and name is not None:
            np.add.at(counts[name], language.buckets([t])[0], 1)
    want = np.log(np.column_stack([(c + 0.1) / (c + 0.1).sum() for c in counts.values()]))
    assert np.allclose(model.log_prob, want)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.with_language(docs.withColumn("score", F.lit(1)), model).collect()}
    assert got[0][0] == got[5][0] == got[6][0] == "l1" and got[1][0] == "l2"
    assert got[2] == got[3] == got[4] == ("und", 0.0) and all(0 <= s <= 1 for _, s in got.values())


def test_language_ngrams_stay_in_their_text():
    together, counts = language.buckets(["ab", "", "cde"])
    alone = np.concatenate([language.buckets(["ab"])[0], language.buckets(["cde"])[0]])
    assert counts.tolist() == [3, 0, 6] and together.tolist() == alone.tolist()


def test_language_without_learned_rows(spark):
    docs = made(spark, ["abc", None])
    model = language.fit(docs)
    assert {r["lang_pred"] for r in language.with_language(docs, model).collect()} == {"und"}


def test_features_of_a_slice_do_not_depend_on_the_slice():
    texts = ["One two,two three", None, "", "two ONE"]
    batch = lambda t: pa.RecordBatch.from_arrays([pa.array(t, pa.string())], names=["text"])
    bucket, counts = toxicity.features(batch(texts))
    apart = [toxicity.features(batch([t]))[0].tolist() for t in texts]
    assert bucket.tolist() == sum(apart, []) and counts.tolist() == [len(a) for a in apart]
