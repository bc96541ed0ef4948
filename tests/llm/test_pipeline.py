"""The pipeline's stages on a small corpus, and the shape of the registered queries."""

from __future__ import annotations

import os
import random

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from contractlake.llm.queries import ORACLE, QUERIES, WORD_TOKENIZER

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_every_operator_has_a_query():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(ORACLE) <= set(QUERIES)


@pytest.mark.skipif(not os.path.exists(WORD_TOKENIZER), reason="vocabulary files are not here")
@pytest.mark.parametrize("empty", [False, True])
def test_stages(spark, tmp_path, empty):
    rng = random.Random(8)
    pool = ["".join(rng.choice("aeiourst") for _ in range(rng.randint(3, 8))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(pool) for _ in range(n))
    good = [prose(60) for _ in range(60)]
    bad = [prose(6).upper() + "!! " * 40 for _ in range(30)]
    passage = prose(40)
    rows = [(i, t, 1) for i, t in enumerate(good)] + [(100 + i, t, 0) for i, t in enumerate(bad)]
    rows += [(200, good[0], 1), (201, good[1] + " end", 1), (202, prose(30) + passage, 1), (203, passage + prose(30), 1), (204, prose(30) + " password=hunter22x", 1), (205, None, None), (206, "", None)]
    frame = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t, _ in rows][:0 if empty else None], DOCS)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, y) for i, _, y in rows if y is not None], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append({r["doc_id"]: r for r in docs.collect()})
        if k < 4:
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    if empty:
        assert not any(kept)
        return
    assert set(range(60)) <= set(kept[0]) and sum(i in kept[0] for i in range(100, 130)) <= 2
    assert not {200, 201} & set(kept[1]) and {0, 1, 202, 203, 204} <= set(kept[1])
    assert passage in kept[2][202]["text"] and passage[5:-5] not in kept[2][203]["text"] and kept[2][203]["n_chars"] == len(kept[2][203]["text"])
    assert "hunter" not in kept[3][204]["text"]
    assert {i for i in kept[4]} == set(kept[3])
    assert entry.queries()["pipeline"](spark, str(tmp_path)).count() == docs.count()
