"""Streaming operators: driver tables arrive as files and are processed until nothing is left."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import version_queries  # noqa: F401 - its relations must be registered first
from ..streaming import uploads
from .bindings import oracle, snapshot
from .registry import Source, query
from .source_queries import _REPORT
from .verdict_queries import _SNAPSHOTS


def _stream(src: Source, table: str):
    return uploads.read_uploads(src.spark, src.folder, f"{table}.parquet", src.table(table).schema)


@query("stream_reports", oracle("SELECT event_id, pos, method, path FROM ROUTES"))
def stream_reports(src: Source):
    events = _stream(src, "events").select("event_id", F.expr(_REPORT).alias("report"))
    rows = uploads.stream_reports(events, "report", ["event_id"]).select("event_id", "pos", "method", "path")
    return uploads.run_available(rows, uploads.scratch_folder(src.spark, "reports"))


@query("stream_dedupe_uploads", (
    "SELECT DISTINCT sha256('analyze|{\"k\":\"' || json_extract_string(props, '$.k') || '\"}') AS payload_hash FROM events"))
def stream_dedupe_uploads(src: Source):
    # the month is shorter than the delay, so a payload counts once like in a batch
    events = _stream(src, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = uploads.stream_dedupe_uploads(events, "ts", F.lit("analyze"), F.col("props"), "60 days").select("payload_hash")
    return uploads.run_available(rows, uploads.scratch_folder(src.spark, "dedupe"))


@query("stream_append_if_changed", oracle("SELECT repo, api, version, signature, commit_id FROM VT"))
def stream_append_if_changed(src: Source):
    e = _stream(src, "events")
    v = e.select(F.expr("'repo-' || substr(event_type, 1, 1)").alias("repo"), F.expr("'user-' || user_id").alias("api"),
                 F.expr("CASE WHEN value < 20 THEN 'low' WHEN value < 60 THEN 'mid' ELSE 'high' END").alias("signature"),
                 F.expr("'c' || event_id").alias("commit_id"), F.col("event_id").alias("pos"), "ts")
    rows = uploads.run_available(uploads.stream_versions(v), uploads.scratch_folder(src.spark, "versions"))
    return rows.select("repo", "api", "version", "signature", "commit_id")


def _hits(events):
    # accounts by event type, with the days of a month squeezed into seconds so that limits bite
    return events.select("event_type", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6 * 60)).alias("at"))


def _limiter(hits: str, order: str) -> str:
    """SQL: decisions on hits(account, id, at), one after the other along each account; `live` are the admitted hits of the last minute."""
    return ("WITH RECURSIVE h AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY account ORDER BY " + order + f") AS n FROM ({hits})), "
            "r AS (SELECT account, id, \"at\", n, 0 AS wait, [\"at\"] AS kept FROM h WHERE n = 1 UNION ALL "
            "SELECT account, id, \"at\", n, CASE WHEN len(live) >= 5 THEN greatest(1, CAST(floor(live[1] + 60 - \"at\") AS INT) + 1) ELSE 0 END, "
            "CASE WHEN len(live) >= 5 THEN live ELSE list_append(live, \"at\") END "
            "FROM (SELECT h.*, list_filter(r.kept, lambda x: x > h.\"at\" - 60) AS live FROM r JOIN h ON h.account = r.account AND h.n = r.n + 1))")


@query("rate_audit", _limiter("SELECT event_type AS account, event_id AS id, epoch_us(ts) / 60000000.0::DOUBLE AS \"at\" FROM events", "id") +
       " SELECT account AS event_type, id AS event_id, \"at\", wait FROM r")
def rate_audit(src: Source):
    return uploads.rate_audit(_hits(src.table("events")), ["event_type"], "event_id", "at", 5)


# the same hits as a stream, closed by a row of its own after the last hit, so that every hit is judged
_SQUEEZED = "CAST(floor(epoch_us(ts) / 60) AS BIGINT)"


@query("stream_rate_audit", _limiter(f"SELECT event_type AS account, event_id AS id, {_SQUEEZED} / 1e6::DOUBLE AS \"at\", {_SQUEEZED} AS us FROM events", "us, id").replace(
    "h.*", "h.* EXCLUDE (us)") + " SELECT r.account AS event_type, h.us, r.wait FROM r JOIN h ON h.account = r.account AND h.n = r.n")
def stream_rate_audit(src: Source):
    def squeezed(events):
        return events.select("event_type", F.timestamp_micros(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 60)).alias("at"), F.lit(False).alias("closing"))

    folder = uploads.scratch_folder(src.spark, "limits")
    closing = uploads.closing_row(src.spark, folder, squeezed(src.table("events")), "event_type", "at", "closing")
    rows = uploads.stream_rate_audit(squeezed(_stream(src, "events")).unionByName(closing), "event_type", "at", 5, closing="closing")
    return uploads.run_available(rows, folder).select("event_type", F.unix_micros("at").alias("us"), "wait")


@query("stream_gate", oracle(f"SELECT api, status, verdict, verdict = 'hold' AS failed FROM ({_SNAPSHOTS}) WHERE status <> 'removed'"))
def stream_gate(src: Source):
    stored, head = snapshot(src, "base"), snapshot(src, "head")
    folder = uploads.scratch_folder(src.spark, "gate")
    # the head's endpoints arrive as uploads, in three batches
    arriving = uploads.endpoint_bodies(head, ["api"]).withColumn("pos", F.lit(1).cast("long"))
    arriving.repartition(3, "api").write.parquet(f"{folder}/uploads")
    stream = src.spark.readStream.schema(arriving.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/uploads")
    rows = uploads.stream_bodies(stream, ["api"], "pos", uploads.endpoint_bodies(stored, ["api"]))
    uploads.run_available(rows, folder, uploads.gate_writer(f"{folder}/table", head, ["api"]))
    return src.spark.read.parquet(f"{folder}/table").select("api", "status", "verdict", "failed")
