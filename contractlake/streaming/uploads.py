"""Continuous ingest of uploads: routes, duplicates, new versions, rate limits and the merge gate.

Streams end in `foreachBatch` or a file sink and keep their progress in a checkpoint. What an API or an account was last is keyed state in the state store,
so a batch reads and writes only the keys that arrive, however long the history is, and a batch that runs again starts from the same state.
"""

from __future__ import annotations

import uuid
from array import array
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import ArrayType

from ..operators import versions
from ..operators.ordered import CHUNK, attach, in_chunk, over_chunks, previous_values, with_chunk
from ..operators.verdict import compare_snapshots, gate
from ..session import cut_lineage, ensure_checkpoint_dir

WINDOW_SECONDS = 60.0
# state of keyed operators lives in this store: on local disk, with change logs in the checkpoint folder
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the reliable checkpoints, for stream progress and results."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def run_available(stream: DataFrame, folder: str, batch: Callable[[DataFrame, int], None] | None = None, mode: str = "append") -> DataFrame | None:
    """Process everything that has arrived, then stop. Without `batch` the rows go to a Parquet sink and come back."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True)
    if batch is not None:
        writer.foreachBatch(batch).start().awaitTermination()
        return None
    writer.format("parquet").option("path", f"{folder}/rows").start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


def read_uploads(spark: SparkSession, folder: str, pattern: str, schema) -> DataFrame:
    """Upload rows arriving as Parquet files."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


# ---------------------------------------------------------------- reports and duplicates

def stream_reports(uploads: DataFrame, column: str, keys: Sequence[str]) -> DataFrame:
    """Route rows of the reports in a stream; texts that are no report give none."""
    from ..sources.reports import parse_reports, routes_of
    return routes_of(parse_reports(uploads, column).where("is_report"), keys)


def stream_dedupe_uploads(uploads: DataFrame, ts: str, kind: Column, payload: Column, delay: str = "10 minutes") -> DataFrame:
    """Identical payloads count once while the first may still be active.

    A batch run knows which upload is active; a stream bounds its state by time instead, so `delay`
    must be at least as long as an upload takes.
    """
    keyed = uploads.withColumn("payload_hash", versions.payload_key(kind, payload))
    return keyed.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["payload_hash"])


# ---------------------------------------------------------------- versions

class _Versions(StatefulProcessor):
    """Keeps the last signature and version of a key."""

    def __init__(self, pos: str):
        self.pos = pos

    def init(self, handle) -> None:
        self.latest = handle.getValueState("latest", "signature string, version long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        signature, version = self.latest.get() if self.latest.exists() else (None, 0)
        for row in sorted(rows, key=lambda r: r[self.pos]):
            if not version or row["signature"] != signature:
                signature, version = row["signature"], version + 1
                yield Row(**row.asDict(), version=version)
        self.latest.update((signature, version))

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.latest.update((initialState["signature"], initialState["version"]))

    def close(self) -> None:
        pass


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def stream_versions(uploads: DataFrame, keys: Sequence[str] = versions.KEYS, pos: str = "pos", stored: DataFrame | None = None) -> DataFrame:
    """The uploads of a stream that make new versions, with `version`; `stored` holds the last signature and version of keys from before the stream.

    A key's uploads of one batch are taken in the order of `pos`; uploads of later batches come after. A null signature is a signature. A task holds one key's
    uploads of one batch.
    """
    initial = stored.select(*keys, "signature", F.col("version").cast("long")).groupBy(*keys) if stored is not None else None
    return uploads.groupBy(*keys).transformWithState(_Versions(pos), f"{_ddl(uploads)}, version long", "Append", "None", initialState=initial)


# ---------------------------------------------------------------- rate limits

def waits(times: Iterable[float], limit: int, admitted: list[float]) -> list[int]:
    """Seconds each hit has to wait, 0 when it is admitted, under `limit` admitted hits in any minute.

    A hit is admitted when the limit-th last admitted one is at least a minute old. `admitted` holds the last `limit` of them, oldest first, and is
    brought up to date. Denied hits leave no trace; they are told the whole seconds until a place is free, rounded up past it.
    """
    out = []
    for now in times:
        left = admitted[-limit] + WINDOW_SECONDS - now if len(admitted) >= limit else 0.0
        if left > 0:
            out.append(max(1, int(left) + 1))
            continue
        admitted.append(now)
        del admitted[:-limit]
        out.append(0)
    return out


def rate_sessions(hits: DataFrame, keys: Sequence[str], pos: str, seconds: str, size: int = CHUNK) -> DataFrame:
    """Adds `session`: the position of the last hit that came a whole window after the one before.

    Such a hit finds an empty window whatever happened earlier, so sessions are independent and the
    traffic of one busy account spreads over many tasks.
    """
    rows = previous_values(hits, keys, pos, [seconds], size)
    gap = F.col("previous").isNull() | (F.col(seconds) - F.col(f"previous.{seconds}") >= WINDOW_SECONDS)
    marked = with_chunk(rows.withColumn("_start", F.when(gap, F.col(pos))).drop("previous"), pos, size)
    w = in_chunk(keys, pos).rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.withColumn("_in", F.max("_start").over(w))
    chunks = marked.groupBy(*keys, "_chunk").agg(F.max("_start").alias("_hi"))
    edges = chunks.withColumn("_carry", F.max("_hi").over(over_chunks(keys).rowsBetween(Window.unboundedPreceding, -1)))
    return (attach(marked, edges, keys, ["_carry"]).withColumn("session", F.coalesce("_in", "_carry"))
            .drop("_start", "_in", "_carry", "_chunk"))


def rate_audit(hits: DataFrame, keys: Sequence[str], pos: str, seconds: str, limit: int, size: int = CHUNK) -> DataFrame:
    """Adds `wait`: seconds an account had to wait under a sliding one-minute limit; denied hits do not count.

    Each decision depends on the ones before, so no window frame gives it. Rows of a session stream in
    order through one task that holds at most `limit` times.
    """
    if limit <= 0:
        return hits.withColumn("wait", F.lit(0))
    keys = list(keys)
    rows = with_chunk(rate_sessions(hits, keys, pos, seconds, size), pos, size)
    rows = cut_lineage(rows.withColumn("_line", F.to_json(F.struct(*keys, "session"))))
    starts = _window_starts(rows, pos, seconds, limit)
    ordered = (rows.join(starts, ["_line", "_chunk"], "left").repartition("_line", "_chunk").sortWithinPartitions("_line", "_chunk", pos))
    columns = [c for c in ordered.columns if c not in ("_line", "_chunk", "session", "_start")]

    def audit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, admitted = None, []
        for batch in batches:
            found = []
            for line, chunk, start, now in zip(batch["_line"], batch["_chunk"], batch["_start"], batch[seconds]):
                if (line, chunk) != current:
                    current, admitted = (line, chunk), [] if start is None else [float(x) for x in start]
                found += waits([float(now)], limit, admitted)
            yield batch[columns].assign(wait=found)

    return ordered.mapInPandas(audit, _ddl(ordered.select(*columns)) + ", wait int")


def _window_starts(rows: DataFrame, pos: str, seconds: str, limit: int) -> DataFrame:
    """(_line, _chunk, _start): the admitted hits of the last minute before each chunk of a session, where there are any.

    Speculative: every chunk runs from the window it is thought to start with, at first an empty one, and hands on the window it ends with. Only chunks that turn out to
    start otherwise run again, until none does. A session that is one chunk never waits for another.
    """
    def ends(todo: DataFrame) -> DataFrame:
        ordered = rows.select("_line", "_chunk", pos, seconds).join(todo, ["_line", "_chunk"]).repartition("_line", "_chunk").sortWithinPartitions("_line", "_chunk", pos)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            current, admitted = None, []
            for batch in batches:
                done = []
                for line, chunk, start, now in zip(batch["_line"], batch["_chunk"], batch["_start"], batch[seconds]):
                    if (line, chunk) != current:
                        if current:
                            done.append((*current, admitted))
                        current, admitted = (line, chunk), [float(x) for x in start]
                    waits([float(now)], limit, admitted)
                yield pd.DataFrame(done, columns=["_line", "_chunk", "_end"])
            if current:
                yield pd.DataFrame([(*current, admitted)], columns=["_line", "_chunk", "_end"])

        return ordered.select("_line", "_chunk", "_start", seconds).mapInPandas(run, "_line string, _chunk long, _end array<double>")

    along = Window.partitionBy("_line").orderBy("_chunk")
    units = rows.groupBy("_line", "_chunk").agg(F.min(seconds).cast("double").alias("_first"))
    units = units.withColumns({"_n": F.count("*").over(Window.partitionBy("_line")), "_next": F.lead("_chunk").over(along)}).where("_n > 1")
    none = F.array().cast("array<double>")
    state = cut_lineage(units.select("_line", "_chunk", "_first", "_next", none.alias("_start"), none.alias("_end"), F.col("_next").isNotNull().alias("_again")))
    while not state.where("_again").isEmpty():
        fresh = ends(state.where("_again").select("_line", "_chunk", "_start")).withColumnRenamed("_end", "_fresh")
        known = state.join(fresh, ["_line", "_chunk"], "left").withColumn("_end", F.coalesce("_fresh", "_end"))
        handed = F.filter(F.coalesce(F.lag("_end").over(along), none), lambda t: t > F.col("_first") - WINDOW_SECONDS)
        moved = known.withColumn("_handed", handed)
        state = cut_lineage(moved.select("_line", "_chunk", "_first", "_next", F.col("_handed").alias("_start"), "_end",
                                         ((F.col("_handed") != F.col("_start")) & F.col("_next").isNotNull()).alias("_again")))
    return state.where(F.size("_start") > 0).select("_line", "_chunk", "_start")


# hits of an account that are gathered before they go to the state store, and rows of a frame that goes out
GATHERED, FRAME = 1_000_000, 10_000


class _Limiter(StatefulProcessor):
    """Hits wait by the minute until the watermark has passed it; the last admitted ones are kept for a minute.

    A minute's hits lie in numbered parts, so neither a batch nor an account is held whole; what is judged goes out in frames, minute by minute.
    """

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "minute long, part long", "hits array<long>")
        self.parts = handle.getValueState("parts", "part long")
        self.admitted = handle.getValueState("admitted", "hits array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new: dict[int, array] = {}
        held = 0
        for frame in rows:
            hits = np.sort(frame["us"].to_numpy(dtype="int64")[~frame["skip"].to_numpy(dtype=bool)])
            minutes, starts = np.unique(hits // 60_000_000, return_index=True)
            for minute, some in zip(minutes.tolist(), np.split(hits, starts[1:])):
                new.setdefault(minute, array("q")).frombytes(some.tobytes())
            held += len(hits)
            if held >= GATHERED:
                self._store(new)
                new, held = {}, 0
        self._store(new)
        return iter(())

    def _store(self, new: dict[int, array]) -> None:
        if not new:
            return
        part = self.parts.get()[0] + 1 if self.parts.exists() else 0
        for minute, hits in new.items():
            self.handle.registerTimer((minute + 1) * 60_000)
            self.waiting.updateValue((minute, part), (hits.tolist(),))
        self.parts.update((part,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        ripe: dict[int, list[int]] = {}
        for minute, part in self.waiting.keys():
            if (minute + 1) * 60_000 <= mark:
                ripe.setdefault(minute, []).append(part)
        admitted = list(self.admitted.get()[0]) if self.admitted.exists() else []
        for minute in sorted(ripe):
            hits = []
            for part in ripe[minute]:
                hits += self.waiting.getValue((minute, part))[0]
                self.waiting.removeKey((minute, part))
            hits.sort()
            seconds = [t / 1e6 for t in admitted]
            found = waits([t / 1e6 for t in hits], self.limit, seconds)
            admitted = (admitted + [t for t, w in zip(hits, found) if not w])[-self.limit:]
            for k in range(0, len(hits), FRAME):
                yield pd.DataFrame({"account": pd.Series([key[0]] * len(hits[k:k + FRAME]), dtype=object), "us": hits[k:k + FRAME], "wait": found[k:k + FRAME]})
        if ripe:
            # once a minute has passed after the last admitted hit, nothing of it counts any more
            self.admitted.update((admitted,))
            self.handle.registerTimer(admitted[-1] // 1000 + 120_000)
        elif admitted and admitted[-1] // 1000 + 60_000 <= mark and not any(True for _ in self.waiting.keys()):
            self.admitted.clear()
            self.parts.clear()

    def close(self) -> None:
        pass


def stream_rate_audit(hits: DataFrame, key: str, ts: str, limit: int, delay: str = "10 minutes", closing: str | None = None) -> DataFrame:
    """The limiter over a stream: (key, ts, wait) of every hit, once its minute is older than the watermark.

    Hits may arrive up to `delay` late and in any order: they wait in the account's state, each minute for itself, until the watermark has passed them, and are judged by
    event time. The state holds the waiting hits and the last `limit` admitted ones, and expires after the last. Rows whose `closing` column is true are no hits: they
    only move the watermark, so one of them, `delay` and a minute after the last hit, has everything judged. Later hits are dropped, as with any
    watermark, and hits without a time can't be judged. An account's decisions depend on each other, so one account is one task at a time.
    """
    mark = F.lit(False) if closing is None else F.coalesce(F.col(closing), F.lit(False))
    if limit <= 0:
        return hits.where(~mark & F.col(ts).isNotNull()).select(key, ts, F.lit(0).alias("wait"))
    kind = hits.schema[key].dataType
    # closing rows go on to the operator: a filter would be pushed below the watermark. Frames turn columns with nulls into floats, so the account goes as text
    skip = (mark | F.col(ts).isNull()).alias("skip")
    timed = hits.withWatermark(ts, delay).select(F.col(key).cast("string").alias("account"), F.col(ts).alias("ts"), F.coalesce(F.unix_micros(ts), F.lit(0)).alias("us"), skip)
    # frames go out one by one; rows would be gathered until all timers of a task are through
    found = timed.groupBy("account").transformWithStateInPandas(_Limiter(limit), "account string, us long, wait int", "Append", "EventTime")
    return found.select(F.col("account").cast(kind).alias(key), F.timestamp_micros("us").alias(ts), "wait")


def closing_row(spark: SparkSession, folder: str, hits: DataFrame, key: str, ts: str, closing: str, seconds: float = 720) -> DataFrame:
    """A stream of one row, `seconds` after the last of the given hits, that closes `stream_rate_audit`; unite it with the stream of hits."""
    row = hits.agg(F.max(ts).alias("last")).select(
        F.lit(None).cast(hits.schema[key].dataType).alias(key), F.timestamp_micros(F.unix_micros("last") + int(seconds * 1e6)).alias(ts), F.lit(True).alias(closing))
    row.write.mode("overwrite").parquet(f"{folder}/closing")
    return spark.readStream.schema(row.schema).parquet(f"{folder}/closing")


# ---------------------------------------------------------------- gate

class _Bodies(StatefulProcessor):
    """Keeps the last body of a key and gives every upload the one before it."""

    def __init__(self, pos: str, names: Sequence[str]):
        self.pos, self.names = pos, tuple(names)

    def init(self, handle) -> None:
        self.last = handle.getValueState("last", "body string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = self.last.get()[0] if self.last.exists() else None
        for row in sorted(rows, key=lambda r: r[self.pos]):
            yield Row(**dict(zip(self.names, key)), **{self.pos: row[self.pos]}, before=before, body=row["body"])
            before = row["body"]
        self.last.update((before,))

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.last.update((initialState["body"],))

    def close(self) -> None:
        pass


def endpoint_bodies(snapshot: dict[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """(keys, body) of every endpoint with a route: all its items by family, as one text. The items of an endpoint are one upload."""
    parts = None
    for family, rows in snapshot.items():
        items = F.struct(*[c for c in rows.columns if c not in keys])
        own = rows.groupBy(*keys).agg(F.to_json(F.collect_list(items)).alias("items")).select(*keys, F.lit(family).alias("family"), "items")
        parts = own if parts is None else parts.unionByName(own)
    body = F.to_json(F.map_from_entries(F.collect_list(F.struct("family", "items"))))
    return parts.groupBy(*keys).agg(body.alias("body"), F.bool_or(F.col("family") == "routes").alias("_has")).where("_has").drop("_has")


def _families(rows: DataFrame, body: str, like: dict[str, DataFrame], keys: Sequence[str]) -> dict[str, DataFrame]:
    parsed = rows.where(F.col(body).isNotNull()).withColumn("_families", F.from_json(body, "map<string,string>"))
    out = {}
    for family, model in like.items():
        columns = [f for f in model.schema.fields if f.name not in keys]
        kind = ArrayType(model.select(*[f.name for f in columns]).schema).simpleString()
        items = parsed.select(*keys, F.explode(F.from_json(F.col("_families")[family], kind)).alias("x"))
        out[family] = items.select(*keys, *[F.col("x")[f.name].alias(f.name) for f in columns])
    return out


def stream_bodies(uploads: DataFrame, keys: Sequence[str], pos: str, stored: DataFrame | None = None) -> DataFrame:
    """(keys, pos, before, body) of a stream of (keys, pos, body): each upload beside the body its endpoint had before, `stored` ones (keys, body) first."""
    kinds = {f.name: f.dataType.simpleString() for f in uploads.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*keys, pos]) + ", before string, body string"
    initial = stored.select(*keys, "body").groupBy(*keys) if stored is not None else None
    return uploads.groupBy(*keys).transformWithState(_Bodies(pos, keys), schema, "Append", "None", initialState=initial)


def gate_writer(path: str, like: dict[str, DataFrame], keys: Sequence[str] = ("repo", "api"), pos: str = "pos", threshold: str = "hold") -> Callable[[DataFrame, int], None]:
    """Batch function that compares the uploads of `stream_bodies` with what was there before and writes the gate's verdicts.

    A batch reads its own rows only. `like` has the families' columns. An upload lists what its commit touched, so absent endpoints are no removals; an
    endpoint without a body before is added.
    """
    def write(batch: DataFrame, number: int) -> None:
        own = cut_lineage(batch)
        verdicts = compare_snapshots(_families(own, "before", like, [*keys, pos]), _families(own, "body", like, [*keys, pos]), [*keys, pos], complete=False, ordered=False)
        gate(verdicts, threshold).write.mode("overwrite").parquet(f"{path}/batch={number}")
    return write
