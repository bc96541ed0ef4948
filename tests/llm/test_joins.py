"""Vector join, n-gram Jaccard join and repeat removal against brute force, and odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from contractlake.llm import shingle_join, suffix_dedup, vector_join
from contractlake.llm.frames import components


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in (pair for pair in links if pair[0] != pair[1]):
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("links", [[], [(5, 5)], [(1, 2), (2, 3), (9, 8), (8, 7), (3, 1), (2, 1)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)] + [(30, 29)]])
def test_components(spark, links):
    found = components(spark.createDataFrame(links, "x long, y long"), "x", "y").collect()
    nodes = {n for a, b in links if a != b for n in (a, b)}
    assert {r["node"]: r["component"] for r in found} == roots(nodes, links) and len(found) == len(nodes)


# -- vectors

def plain_links(vectors, cosine):
    out = set()
    for i, a in vectors:
        for j, b in vectors:
            if i is not None and j is not None and i < j and a is not None and b is not None and len(a) == len(b) and None not in a and None not in b:
                x, y = np.array(a, np.float32).astype(float), np.array(b, np.float32).astype(float)
                if np.isfinite(x).all() and np.isfinite(y).all() and x.any() and y.any() and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= cosine:
                    out.add((i, j))
    return out


@pytest.mark.parametrize(("size", "cosine", "tile"), [(12, 0.9, 8192), (20, 0.95, 3), (3, 0.99, 8192), (9, 0.8, 10)])
def test_vectors_by_brute_force(spark, monkeypatch, size, cosine, tile):
    monkeypatch.setattr(vector_join, "TILE_ROWS", tile)
    rng = np.random.default_rng(size)
    base = rng.normal(size=(12, size))
    rows = [(i, (base[i % 12] + rng.normal(scale=0.12, size=size) * (i % 4)).tolist()) for i in range(60)]
    rows += [(60, rows[3][1]), (61, rows[3][1]), (62, [2 * x for x in rows[5][1]]), (63, None), (64, [0.0] * size), (65, [float("nan")] * size), (66, [None] * size), (67, []), (68, rows[0][1][:-1]), (None, rows[0][1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("kept", F.lit(1)).withColumn("n_links", F.lit("x"))
    links = plain_links(rows, cosine)
    found = vector_join.near_duplicates(frame, cosine).collect()
    assert len(found) == len(rows)
    root = roots([i for i, _ in rows if i is not None], links)
    for r in found:
        i = r["vec_id"]
        assert r["n_links"] == sum(i in pair for pair in links), i
        assert r["component_id"] == (root[i] if i is not None else None) and r["kept"] == (i == root[i] if i is not None else None)


def test_tiles_give_no_pairs(spark):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=16)
    rows = [(i, 1, (centre + rng.normal(scale=0.02, size=16)).astype("<f4").tobytes()) for i in range(300)]
    found = vector_join.links(spark.createDataFrame(rows, "id long, n long, body binary"), 0.95).collect()
    assert {r["id"]: 0 for r in found}.keys() == set(range(300)) and len(found) <= 300 * 2 * 4  # a tile a block, or two where a cell ends within the group
    for i in range(300):
        assert sum(r["m"] for r in found if r["id"] == i) == 299


def test_chunks_of_vectors_meet_where_they_lie(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(1400, 64))
    rows = [(i, 1, (base[i % 1400] + rng.normal(scale=0.01, size=64) * (i >= 1400)).astype("<f4").tobytes()) for i in range(1500)]
    # four chunks, and so ten tiles; and two vectors of another length
    rows += [(i, 1, np.array([1, i / 1e6], "<f4").tobytes()) for i in (2000, 2001)]
    found = vector_join.links(spark.createDataFrame(rows, "id long, n long, body binary"), 0.95, tile_rows=400)
    got = {}
    for r in found.collect():
        got[r["id"]] = got.get(r["id"], 0) + r["m"]
    assert got == {i: 1 for i in (*range(100), *range(1400, 1500), 2000, 2001)}
    # no vector is sent to a block, a cell or a tile
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in text and "Exchange" not in text


def test_pairs_at_a_bar_count_once():
    rng = np.random.default_rng(5)
    size, cosine = 20, 0.95
    turn, own = vector_join.rotation(size), vector_join.blocks(size)
    for trial in range(200):
        gap = np.zeros(size)
        for block in own:  # every block at its bar, give or take some last digits
            part = rng.normal(size=block.stop - block.start)
            bar = vector_join.budget(block, size, cosine) - vector_join.SLACK / 2
            gap[block] = part / np.linalg.norm(part) * np.sqrt(bar) * (1 + rng.integers(-3, 4) * 1e-16)
        middle = np.linalg.qr(np.column_stack([gap, rng.normal(size=size)]))[0][:, 1] * np.sqrt(1 - gap @ gap / 4)
        pair = np.stack([middle + gap / 2, middle - gap / 2]) @ turn.T
        noise = rng.integers(-5, 6, (len(own), 2, size)) * 1e-17
        counted = sum(int(vector_join.counted_here(b, pair[:1], pair[1:], pair[:1] @ turn + noise[b, 0], pair[1:] @ turn + noise[b, 1], cosine)[0]) for b in range(len(own)))
        keeps = [x <= vector_join.budget(block, size, cosine) - vector_join.SLACK / 2 for x, block in zip(vector_join._exact_squares(*pair), own)]
        assert counted == any(keeps)


def test_no_vectors(spark):
    assert vector_join.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_budgets_add_up_and_rotation_keeps_lengths():
    for size in (3, 8, 64, 70):
        own = vector_join.blocks(size)
        assert sum(vector_join.budget(b, size, 0.95) - vector_join.SLACK for b in own) == pytest.approx(0.1)
        assert np.allclose(vector_join.rotation(size) @ vector_join.rotation(size).T, np.eye(size))


# -- shingles

def plain_sets(texts, size=5):
    out = []
    for t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(words[k:k + size]) for k in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)} - {()})
    return out


def plain_groups(ids, texts):
    sets = plain_sets(texts)
    links = [(a, b) for a, x in zip(ids, sets) for b, y in zip(ids, sets) if a is not None and b is not None and a < b and x and y and 100 * len(x & y) >= 75 * len(x | y)]
    root = roots({i for i in ids if i is not None}, links)
    return sorted(((i, len(s), root.get(i)) for i, s in zip(ids, sets)), key=repr)


def near_copies(rng, n, edits, length=80):
    pool = [f"w{k}" for k in range(60)]
    base = [rng.choice(pool) for _ in range(length)]
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(edits):
            words[rng.randrange(len(words))] = f"e{rng.randrange(10 ** 6)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize(("edits", "block"), [(1, 2_000_000), (2, 500), (3, 2_000_000)])
def test_groups_by_brute_force(spark, monkeypatch, edits, block):
    monkeypatch.setattr(shingle_join, "BLOCK_TOKENS", block)
    monkeypatch.setattr(shingle_join, "MEMBERS_PER_TASK", 3)
    rng = random.Random(edits)
    passage = " ".join(f"p{k}" for k in range(40))
    texts = near_copies(rng, 12, edits) + [passage + " " + t for t in near_copies(rng, 8, edits)] + [f"{passage} own{k} " * 2 for k in range(5)]
    texts += texts[:3] + ["a b c", "A B  c", "a b", "", None, " \t\n", "a b c d e", "a b c d e f", "repeat " * 30, "x" * 50_000]
    ids = list(range(100, 100 + len(texts)))
    rng.shuffle(ids)
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").withColumn("component_id", F.lit(0))
    found = shingle_join.near_duplicates(docs)
    assert sorted(map(tuple, found.collect()), key=repr) == plain_groups(ids, texts)


def test_large_group_of_near_copies(spark):
    rng = random.Random(9)
    texts = near_copies(rng, 150, 2, 60)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(map(tuple, shingle_join.near_duplicates(docs).collect()), key=repr) == plain_groups(range(150), texts)


def test_odd_ids(spark):
    text = "one two three four five six seven eight"
    rows = [(4, text), (4, text), (7, text), (None, text), (4, "quite another text with more words"), (9, "quite another text with more words")]
    found = sorted(map(tuple, shingle_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert found == sorted([(4, 4, 4), (4, 4, 4), (7, 4, 4), (None, 4, None), (4, 2, 4), (9, 2, 4)], key=repr)
    assert shingle_join.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# -- repeats

def plain_removal(rows, least):
    """(doc_id, bytes, removed, spans, digest) by looking at every window."""
    first: dict[bytes, tuple] = {}
    place = lambda i, k: (i is not None, i or 0, k)
    bodies = [(i, (t or "").encode()) for i, t in rows]
    for i, b in bodies:
        for k in range(len(b) - least + 1):
            w = b[k:k + least]
            first[w] = min(first.get(w, place(i, k)), place(i, k))
    out = []
    for i, b in bodies:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - least + 1):
            if first[b[k:k + least]] < place(i, k):
                gone[k:k + least] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("least", "hot", "block"), [(40, 50_000, 8 << 20), (40, 3, 300), (100, 50_000, 1000), (12, 50_000, 8 << 20)])
def test_removal_by_brute_force(spark, monkeypatch, least, hot, block):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", block)
    rng = random.Random(least + hot)
    prose = lambda n: "".join(rng.choice("abcdefghé ") for _ in range(n))
    passage, line = prose(260), prose(least + 7)
    texts = [prose(rng.randint(0, 300)) + (passage[rng.randint(0, 60):rng.randint(100, 260)] if k % 3 else "") + prose(50) + line + prose(rng.randint(0, 90)) for k in range(25)]
    texts += [texts[2], texts[2], "", None, "ab" * 400, "ab" * 401, "z" * 1000, passage, passage + passage, "é" * 300, texts[1] * 3]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    ids[4], ids[9], ids[11] = None, ids[8], ids[25]
    rows = list(zip(ids, texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_spans", F.lit("old")).withColumn("block", F.lit(1))
    found = suffix_dedup.without_repeats(docs, least, hot_runs=hot)
    assert "block" in found.columns
    assert sorted(map(tuple, found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=repr) == plain_removal(rows, least)


@pytest.mark.parametrize("block", [300, 2000, 8 << 20])
def test_split_names_by_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", block)
    rng = random.Random(block)
    prose = lambda n: "".join(rng.choice("abcdefghé ") for _ in range(n))
    passage = prose(90)
    texts = [passage] * 6 + [prose(20) + passage[rng.randint(0, 20):] + prose(rng.randint(0, 60)) for _ in range(20)]
    texts += ["", None, "=" * 300, "=" * 41, "a" + "=" * 39, passage * 3, "ab" * 100, prose(80) + passage + "=" * 60]
    ids = [rng.randint(0, 25) if k % 2 else 100 + k for k in range(len(texts))]
    ids[0], ids[7], ids[9] = None, None, ids[10]
    rows = list(zip(ids, texts))
    found = suffix_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 40, hot_runs=1)
    assert sorted(map(tuple, found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=repr) == plain_removal(rows, 40)


def test_split_windows_leave_a_block_once():
    rng = random.Random(8)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(300))

    def sent(copies):
        docs = pa.table({"doc_id": [rng.randrange(1 << 60) for _ in range(copies)], "text": pa.array([passage] * copies, pa.large_string())})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, docs.schema) as writer:
            writer.write_table(docs)
        blob = sink.getvalue().to_pybytes()
        asked = pa.Table.from_batches(suffix_dedup._ask(100, 3)([pa.RecordBatch.from_arrays([pa.array([5]), pa.array([blob])], names=["block", "blob"])]))
        answers = [suffix_dedup._answer(1)(asked.filter(pc.equal(asked["part"], p)))["blob"][0].as_py() for p in asked["part"].to_pylist()]
        whole = pa.table({"block": [5] * (1 + len(answers)), "kind": [0] + [1] * len(answers), "blob": [blob, *answers]})
        return sum(len(b) for b in suffix_dedup._documents(100, 3)(whole)["blob"].to_pylist())
    assert sent(2000) < 2 * sent(20)


def test_removal_replaces_text(spark):
    rng = random.Random(4)
    passage = "".join(rng.choice("abcdef") for _ in range(150))
    docs = spark.createDataFrame([(1, passage), (2, "é" + passage + "ü"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in suffix_dedup.without_repeats(docs, replace=True).collect()}
    assert got == {1: passage, 2: "éü", 3: None}
    assert suffix_dedup.without_repeats(docs.limit(0)).count() == 0


@pytest.mark.parametrize("least", [3, 8, 9, 20])
def test_columns_by_sorting_all_suffixes(least):
    rng = random.Random(least)
    for alphabet in (b"ab", b"a\x00", b"abcdefgh"):
        texts = list({bytes(rng.choice(alphabet) for _ in range(rng.randint(least, least + 30))) for _ in range(25)})
        texts = list(dict.fromkeys([*texts, (texts[0] * 9)[:least + 25]]))
        with tempfile.TemporaryDirectory() as folder:
            columns = suffix_dedup.Columns(texts, least, folder)
            columns.build()
            text, start, stretch = columns.classes()
            prefixes = columns.lcp.read().tolist()
            columns.close()
        suffixes = sorted(t[k:] for t in texts for k in range(len(t) + 1))
        common = lambda a, b: next((n for n, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert prefixes == [0, *[min(least, common(a, b)) for a, b in zip(suffixes, suffixes[1:])]]
        by = {}
        for t, s, c in zip(text.tolist(), start.tolist(), stretch.tolist()):
            by.setdefault(c, set()).add(texts[t][s:s + least])
        windows = [t[k:k + least] for t in texts for k in range(len(t) - least + 1)]
        assert all(len(w) == 1 for w in by.values()) and len(by) == len(set(windows)) and len(text) == len(windows)
