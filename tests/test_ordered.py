"""Order-dependent operators: any chunk size must give what a plain pass over the rows gives."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from contractlake.operators import documents, versions
from contractlake.operators.intervals import overlap_join
from contractlake.operators.ordered import dense_index, nearest_marks, previous_values
from contractlake.streaming import uploads
from tests.conftest import rows


def uploads_of(seed, n=400):
    """One key holds most of the rows."""
    rnd = random.Random(seed)
    return [("hot" if rnd.random() < 0.7 else f"k{rnd.randrange(4)}", pos, rnd.choice("abc")) for pos in range(n)]


def plain_versions(data, stored=None):
    latest, out = dict(stored or {}), []
    for key, pos, sig in data:
        version, last = latest.get(key, (0, None))
        if last != sig:
            latest[key] = (version + 1, sig)
            out.append((key, pos, version + 1))
    return sorted(out, key=repr), latest


def frame(spark, data):
    return spark.createDataFrame(data, "api string, pos long, signature string")


@pytest.mark.parametrize("size", [1, 7, 64, 1_000_000])
def test_versions_do_not_depend_on_chunks(spark, size):
    data = uploads_of(size)
    assert rows(versions.append_if_changed(frame(spark, data), keys=["api"], size=size), "api", "pos", "version") == plain_versions(data)[0]


def test_six_signatures_then_a_repeat(spark):
    data = [("get_item", i, f"sig-{i}") for i in range(1, 7)] + [("get_item", 7, "sig-6")]
    classified = versions.classify_uploads(frame(spark, data), keys=["api"], size=3)
    assert [r.version for r in classified.where("created").orderBy("pos").collect()] == [1, 2, 3, 4, 5, 6]
    assert tuple(versions.upload_counts(classified).first()) == (6, 1)


def test_replay_adds_nothing_and_later_uploads_continue(spark):
    data = uploads_of(3)
    first, second = data[:150], data[150:]
    stored = versions.append_if_changed(frame(spark, first), keys=["api"], size=40)
    last = versions.latest_of(stored, ["api"], ["signature"]).select("api", F.lit(999).cast("long").alias("pos"), "signature")
    assert versions.append_if_changed(last, stored, ["api"]).count() == 0
    later = versions.append_if_changed(frame(spark, second), stored, ["api"], size=16)
    assert rows(stored.unionByName(later), "api", "pos", "version") == plain_versions(data)[0]


@pytest.mark.parametrize("size", [1, 5, 1000])
def test_helpers_match_a_plain_pass(spark, size):
    data = uploads_of(11, 120)
    df = frame(spark, data)
    seen, index, previous = {}, [], []
    for key, pos, sig in data:
        n, last = seen.get(key, (0, None))
        index.append((key, pos, n + 1))
        previous.append((key, pos, last))
        seen[key] = (n + 1, sig)
    assert rows(dense_index(df, ["api"], "pos", "n", size), "api", "pos", "n") == sorted(index, key=repr)
    assert rows(previous_values(df, ["api"], "pos", ["signature"], size).select("api", "pos", "previous.signature")) == sorted(previous, key=repr)
    marks = []
    for key, pos, _ in data:
        at = [p for k, p, s in data if k == key and s == "a"]
        marks.append((key, pos, max((p for p in at if p < pos), default=None), min((p for p in at if p > pos), default=None), max(p for k, p, _ in data if k == key)))
    found = nearest_marks(df, ["api"], "pos", F.col("signature") == "a", size)
    assert rows(found, "api", "pos", "prev_mark", "next_mark", "last_pos") == sorted(marks, key=repr)


def plain_collapse(statuses, context=2):
    hidden, run, first = [], [], True

    def flush(last):
        nonlocal first
        head = 0 if first else min(context, len(run))
        tail = 0 if last else min(context, len(run))
        middle = run[head:len(run) - tail]
        if run and len(middle) > 2:
            hidden.extend(middle)
        first = first and not run
        run.clear()

    for i, s in enumerate(statuses, start=1):
        if s == "same":
            run.append(i)
        else:
            flush(False)
            first = False
    flush(True)
    return hidden


@pytest.mark.parametrize("seed", range(4))
def test_collapse_unchanged(spark, seed):
    rnd = random.Random(seed)
    statuses = [rnd.choice(["same"] * 6 + ["change"]) for _ in range(80)]
    df = spark.createDataFrame([("d", i, s) for i, s in enumerate(statuses, start=1)], "doc string, idx long, status string")
    found = documents.collapse_unchanged(df, ["doc"], size=9)
    assert [r.idx for r in found.where("hidden").orderBy("idx").collect()] == plain_collapse(statuses)


@pytest.mark.parametrize("seed", range(3))
def test_overlaps_once_each(spark, seed):
    rnd = random.Random(seed)

    def ranges(n):
        out = []
        for i in range(n):
            start = rnd.randrange(5000)
            out.append((i, "hot" if rnd.random() < 0.8 else "other", start, start + rnd.choice([0, 1, 5, 63, 64, 300, 2000, 10 ** 6])))
        return out

    a, b = ranges(60), ranges(60)
    left = spark.createDataFrame(a, "l long, file string, ls long, le long")
    right = spark.createDataFrame(b, "r long, file string, rs long, re long")
    want = sorted(((x[0], y[0]) for x in a for y in b if x[1] == y[1] and x[2] <= y[3] and y[2] <= x[3]), key=repr)
    assert rows(overlap_join(left, right, ["file"], ("ls", "le"), ("rs", "re")), "l", "r") == want


def plain_limiter(times, limit):
    kept, out = [], []
    for now in times:
        kept = [t for t in kept if t > now - 60]
        if len(kept) >= limit:
            out.append(max(1, int(kept[0] + 60 - now) + 1))
        else:
            kept.append(now)
            out.append(0)
    return out


def test_limiter_golden_sequence(spark):
    hits = spark.createDataFrame([("k", 0, 0.0), ("k", 1, 10.0), ("k", 2, 20.0), ("other", 3, 20.0), ("k", 4, 60.5)], "key string, pos long, at double")
    assert [r.wait for r in uploads.rate_audit(hits, ["key"], "pos", "at", 2).orderBy("pos").collect()] == [0, 0, 41, 0, 0]
    assert {r.wait for r in uploads.rate_audit(hits, ["key"], "pos", "at", 0).collect()} == {0}


@pytest.mark.parametrize("size", [3, 1000])
def test_limiter_sessions_match_a_plain_pass(spark, size):
    rnd, now, times = random.Random(size), 0.0, []
    for _ in range(300):
        now += rnd.choice([0.0, 0.5, 3.0, 11.0, 59.0, 60.0, 90.0])
        times.append(now)
    hits = spark.createDataFrame([("k", i, t) for i, t in enumerate(times)], "key string, pos long, at double")
    found = uploads.rate_audit(hits, ["key"], "pos", "at", 4, size).orderBy("pos").collect()
    assert [r.wait for r in found] == plain_limiter(times, 4)


@pytest.mark.parametrize(("limit", "size"), [(1, 7), (4, 7), (30, 25)])
def test_one_busy_account_runs_in_chunks(spark, limit, size):
    """No pause of a minute, so the whole account is one session."""
    rnd, now, times = random.Random(size + limit), 0.0, []
    for _ in range(400):
        now += rnd.choice([0.0, 0.25, 1.0, 7.0, 31.0])
        times.append(now)
    hits = spark.createDataFrame([("k", i, t) for i, t in enumerate(times)] + [(None, i, t) for i, t in enumerate(times[:50])], "key string, pos long, at double")
    found = uploads.rate_audit(hits, ["key"], "pos", "at", limit, size).orderBy("key", "pos").collect()
    assert [r.wait for r in found if r.key] == plain_limiter(times, limit) and [r.wait for r in found if not r.key] == plain_limiter(times[:50], limit)


def test_pairs_and_latest(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "api string, version long, content string")
    assert rows(versions.version_pairs(df, ["api"])) == [("a", 1, 2, "x", "y")]
    assert rows(versions.default_version_pair(df, ["api"])) == [("a", 1, 2), ("b", None, 1)]
    assert rows(documents.doc_line_diff(versions.version_pairs(df, ["api"]), ["api"]), "idx", "status", "left_text", "right_text") == [(1, "change", "x", "y")]
    two = spark.createDataFrame([("a", 1, 2, "p\nq\np\n", "q\np\nr"), ("b", 1, 2, None, "")], "api string, v1 long, v2 long, old string, new string")
    assert rows(documents.doc_line_diff(two, ["api"]), "api", "idx", "status", "left_line", "left_text", "right_line", "right_text") == [
        ("a", 1, "same", 2, "q", 1, "q"), ("a", 2, "same", 3, "p", 2, "p"), ("a", 3, "change", 1, "p", 3, "r"), ("a", 4, "remove", 4, "", None, None), ("b", 1, "add", None, None, 1, "")]
