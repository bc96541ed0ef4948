"""Conversation trie against a plain one of dictionaries, over small bands, matrices and many shards; odd rows."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from contractlake.llm import prefix_trie


def plain(rows, group, heads=9):
    conv = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            conv[c].append((t is not None, t or 0, r, hashlib.md5(f"{len(r)}:{r}{x}".encode()).hexdigest(), x))
    conv = {c: [(r, x) for _, _, r, _, x in sorted(own)] for c, own in conv.items()}
    sequences = {}
    for c, own in conv.items():
        h = zlib.crc32(str(c).encode()) % heads if group else 0
        lender = c - (abs(c) % group if c >= 0 else -(abs(c) % group)) if group else c
        sequences[c] = tuple(conv.get(lender, [])[:h] + own[h:])
    members, children = defaultdict(list), defaultdict(set)
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
            if d:
                children[turns[:d - 1]].add(turns[:d])
    leaves, saved, out = {}, {}, []
    for node in sorted(members, key=len, reverse=True):
        own = members[node]
        leaves[node] = sum(leaves[k] for k in children[node]) or 1
        saved[node] = sum(saved[k] for k in children[node]) + ((len(own) - 1) * len(node[-1][1].encode()) if node else 0)
        ends = ",".join(str(c) for c in sorted(own) if len(sequences[c]) == len(node))
        out.append((min(own), len(node), min(members[node[:-1]]) if node else None, len(own), len(children[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations(seed, longest):
    rng = random.Random(seed)
    rows = []
    for c in range(70):
        base = random.Random(c % 3)
        for t in range(rng.randint(1, longest)):
            shared = base.random() < 0.9 and rng.random() < 0.95
            rows.append((c * rng.choice([1, 1, 1]) - 10, t, ("user", "assistant")[t % 2], f"turn {t} of {c % 3}" if shared else rng.choice(["é", "", None, f"x{rng.random()}"])))
    rows += [(500 + k, t, "user", f"same {t}") for k in range(30) for t in range(3)]  # copies
    rows += [(k, None, None, None) for k in (900, 901, 902)] + [(903, None, "", ""), (904, 1, "a", "b"), (904, 1, "a", "b"), (904, None, "a", "z"), (None, 1, "user", "nobody")]
    rows += [(1000, t, "user", f"turn {t} of 0") for t in range(3 * longest)] + [(1001, 0, "user", "long " * 400_000)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "group", "band", "columns", "shards", "longest"), [
    (1, 5, 64, 8, 1, 9), (2, 5, 64, 8, 23, 9), (3, 0, 4, 2, 11, 13), (4, 5, 3, 2, 17, 12), (5, 0, 1, 1, 5, 6), (6, 0, 64, 8, 40, 70)])
def test_trie_by_dictionaries(spark, monkeypatch, seed, group, band, columns, shards, longest):
    monkeypatch.setattr(prefix_trie, "BAND", band)
    monkeypatch.setattr(prefix_trie, "COLUMNS", columns)
    monkeypatch.setattr(prefix_trie, "SHARD_ROWS", 200 // shards)
    monkeypatch.setattr(prefix_trie, "PART_CHARS", 60)
    rows = conversations(seed, longest)
    frame = (spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
             .withColumn("id", F.lit("clash")).withColumn("depth", F.lit(7)).withColumn("size", F.lit(None).cast("string")))
    got = prefix_trie.conversation_trie(frame, group)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain(rows, group)


def test_turnless_conversations_end_at_the_root(spark):
    # conversations 1 to 4 borrow from 0, which does not exist
    rows = [(c, t, "user", f"{c} {t}") for c in range(1, 5) for t in range(2)]
    got = prefix_trie.conversation_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), 5)
    assert sorted(map(tuple, got.collect()), key=repr) == plain(rows, 5)


def test_empty_table(spark):
    assert prefix_trie.conversation_trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string"), 5).collect() == []


def test_a_conversation_in_many_shards_is_numbered_through(spark):
    rows = [(1, t) for t in range(500)] + [(2, 0), (3, 0), (3, 1)]
    frame = spark.createDataFrame(rows, "c long, t long").repartition(4)
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        got = prefix_trie.numbered(frame, "c", ["t"], "place").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
    assert sorted((r["c"], r["t"], r["place"]) for r in got) == sorted((c, t, t) for c, t in rows)
