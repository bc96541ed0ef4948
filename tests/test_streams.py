"""Streams must give what the batch operators give, over several batches and on replay."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from contractlake.operators import versions
from contractlake.streaming import uploads
from tests.conftest import rows


def test_versions_over_several_files(spark, tmp_path):
    rnd = random.Random(5)
    data = [("r", "hot" if rnd.random() < 0.6 else f"a{rnd.randrange(3)}", rnd.choice("xyz"), pos) for pos in range(200)]
    schema = "repo string, api string, signature string, pos long"
    for i in range(4):
        spark.createDataFrame(data[i * 50:(i + 1) * 50], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = uploads.run_available(uploads.stream_versions(stream), str(tmp_path / "run"))
    got = rows(out, "api", "pos", "version")
    assert got == rows(versions.append_if_changed(spark.createDataFrame(data, schema)), "api", "pos", "version")
    # numbering goes on from what was stored before the stream
    stored = versions.latest_of(versions.append_if_changed(spark.createDataFrame(data[:50], schema)))
    for i in range(1, 4):
        spark.createDataFrame(data[i * 50:(i + 1) * 50], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "rest"))
    rest = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "rest"))
    out = uploads.run_available(uploads.stream_versions(rest, stored=stored), str(tmp_path / "again"))
    assert rows(out, "api", "pos", "version") == [r for r in got if r[1] >= 50]


def test_uploads_meet_the_body_before(spark, tmp_path):
    schema = "api string, pos long, body string"
    for part in ([("a", 2, "a2"), ("a", 1, "a1"), ("b", 1, "b1")], [("a", 3, "a3"), ("c", 1, None)], [("c", 2, "c2"), ("b", 2, "b1")]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stored = spark.createDataFrame([("b", "b0"), ("z", "z0")], "api string, body string")
    out = uploads.run_available(uploads.stream_bodies(stream, ["api"], "pos", stored), str(tmp_path / "run"))
    assert rows(out, "api", "pos", "before", "body") == sorted([
        ("a", 1, None, "a1"), ("a", 2, "a1", "a2"), ("a", 3, "a2", "a3"), ("b", 1, "b0", "b1"), ("b", 2, "b1", "b1"), ("c", 1, None, None), ("c", 2, None, "c2")], key=repr)


def test_streamed_limits_equal_batch(spark, tmp_path):
    """Hits in any order, in several micro-batches; a closing row has all of them judged."""
    rnd, now, hits = random.Random(3), 0, []
    for _ in range(1500):
        now += rnd.choice([0, 500, 3000, 11_000, 59_000, 60_000])
        hits.append((rnd.choice("kkkj"), now))
    late = sorted(range(len(hits)), key=lambda i: hits[i][1] + rnd.random() * 500_000)
    schema = "key string, ts timestamp, closing boolean"
    for part in range(3):
        some = [hits[i] for i in late[part * 500:(part + 1) * 500]]
        (spark.createDataFrame(some, "key string, ms long").select("key", F.timestamp_millis("ms").alias("ts"), F.lit(False).alias("closing")).coalesce(1)
         .write.mode("append").parquet(str(tmp_path / "in")))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    closing = uploads.closing_row(spark, str(tmp_path), spark.read.schema(schema).parquet(str(tmp_path / "in")), "key", "ts", "closing")
    # the closing row arrives with the last files
    closing_file = next(p for p in (tmp_path / "closing").iterdir() if p.suffix == ".parquet")
    (tmp_path / "in" / "z-closing.parquet").write_bytes(closing_file.read_bytes())
    assert closing.isStreaming
    out = rows(uploads.run_available(uploads.stream_rate_audit(stream, "key", "ts", 3, closing="closing"), str(tmp_path / "run")).select("key", F.unix_millis("ts"), "wait"))
    frame = spark.createDataFrame([(k, i, ms / 1000) for i, (k, ms) in enumerate(hits)], "key string, pos long, at double")
    assert out == rows(uploads.rate_audit(frame, ["key"], "pos", "at", 3).select("key", (F.col("at") * 1000).cast("long"), "wait"))


class _State:
    """State of one key, as a processor sees it."""

    def __init__(self):
        self.held, self.value, self.timers = {}, None, set()

    getMapState = getValueState = lambda self, *_: _State()
    registerTimer = lambda self, at: self.timers.add(at)
    exists = lambda self: self.value is not None
    get = lambda self: self.value
    keys = lambda self: list(self.held)
    getValue = lambda self, k: self.held[k]
    removeKey = lambda self, k: self.held.pop(k)
    updateValue = lambda self, k, v: self.held.update({k: v})

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


class _Mark:
    getCurrentWatermarkInMs = lambda self: 10**12


def test_limits_hold_neither_a_batch_nor_its_decisions(monkeypatch):
    monkeypatch.setattr(uploads, "GATHERED", 50)
    monkeypatch.setattr(uploads, "FRAME", 20)
    rnd = random.Random(4)
    hits = [rnd.randrange(300) * 1_000_000 for _ in range(1000)]
    frames = (uploads.pd.DataFrame({"us": hits[k:k + 10], "skip": [False] * len(hits[k:k + 10])}) for k in range(0, 1000, 10))
    limiter, handle = uploads._Limiter(7), _State()
    limiter.init(handle)
    assert list(limiter.handleInputRows(("a",), frames, None)) == []
    # what was gathered went to the store in parts, before the batch was through
    assert max(len(v[0]) for v in limiter.waiting.held.values()) <= 50 and handle.timers == {m * 60_000 for m in range(1, 6)}
    out = list(limiter.handleExpiredTimer(("a",), _Mark(), None))
    assert max(map(len, out)) <= 20 and not limiter.waiting.held
    times = sorted(hits)
    assert [(u, w) for f in out for u, w in zip(f["us"], f["wait"])] == list(zip(times, uploads.waits([t / 1e6 for t in times], 7, [])))


def test_streamed_limits_take_numbered_accounts(spark, tmp_path):
    frame = spark.createDataFrame([(k, n) for k in (7, 2**60 + 1) for n in range(100, 103)], "key long, s long").select("key", F.timestamp_seconds("s").alias("ts"), F.lit(False).alias("closing"))
    frame.unionByName(spark.createDataFrame([(None, 820, True)], "key long, s long, closing boolean").select("key", F.timestamp_seconds("s").alias("ts"), "closing")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    out = uploads.run_available(uploads.stream_rate_audit(stream, "key", "ts", 2, closing="closing"), str(tmp_path / "run"))
    assert rows(out.select("key", F.unix_seconds("ts"), "wait")) == sorted(((k, n, 59 if n == 102 else 0) for k in (7, 2**60 + 1) for n in range(100, 103)), key=repr)


def test_duplicates_count_once(spark, tmp_path):
    data = [("2024-01-01 00:00:00", '{"a":1,"b":2}'), ("2024-01-01 00:01:00", '{"b":2,"a":1}'), ("2024-01-01 00:02:00", '{"a":2}')]
    spark.createDataFrame(data, "ts string, payload string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, payload string").parquet(str(tmp_path / "in"))
    out = uploads.run_available(uploads.stream_dedupe_uploads(stream, "ts", F.lit("analyze"), F.col("payload")), str(tmp_path / "run"))
    assert out.count() == 2
