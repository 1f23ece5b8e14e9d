"""Structured Streaming jobs over the batch operations."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from palisade.functions.dimensions import DEDUP_MINUTES
from palisade.operators.alerts import dedup_key
from palisade.operators.anomaly import Model, detect_anomaly
from palisade.operators.bruteforce import MAX_PER_IP
from palisade.operators.engine import detect_payloads, generate_alerts, with_risk
from palisade.operators.parse import parse_logs
from palisade.sources.store import drop_days_before
from palisade.streaming.histories import (
    AddressHistory, ServiceHistory, UserHistory, followed, live_attempts, live_bruteforce)
from palisade.streaming.tables import BatchTable

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_lines(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Live log lines; ingestion time is the file's."""
    reader = spark.readStream
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.text(path).select(
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_modification_time").alias("ingest_ts"))


def run(writer, checkpoint: str) -> StreamingQuery:
    """Process everything available now and stop."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def stream_parse(lines: DataFrame, out: str, checkpoint: str) -> None:
    """Lines to stored events, one folder per day."""
    events = parse_logs(lines)
    run(events.writeStream.format("parquet").option("path", out).partitionBy("event_date").outputMode("append"), checkpoint)


def stream_detect(
    events: DataFrame, detections_out: str, alerts_out: str, checkpoint: str, min_risk: float | None = None, *,
    brute_force: bool = False, model: str | None = None, vectors: Callable[[DataFrame], DataFrame] | None = None,
) -> None:
    """Detection on live events; writes detections and alerts.

    The payload detectors see one event at a time.  With ``brute_force`` every
    attempt passes the live histories of its address, service and user.  With
    ``model`` (a stored ``Model``, read again for every batch, so that a newly
    fitted one counts from the next batch on) the vectors that ``vectors``
    makes of a batch (``id, features``) are scored too.  The risk is that of
    ``detect_all``.
    """
    found = detect_payloads(events)
    blank = {"brute_force": "struct<detected:boolean,confidence:double,risk_level:string>", "anomaly": "struct<detected:boolean,score:double>"}
    kept = ["source", "severity", "event_type", "sqli", "xss"]
    if brute_force:
        events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
        # the verdicts travel beside the attempt as one text, which nothing on the way looks into
        held = found.select(F.struct(*kept, *(["raw_message", "parsed"] if vectors else [])).alias("held")).schema["held"].dataType
        names = [f.name for f in held]
        scored = live_bruteforce(live_attempts(found, held=F.to_json(F.struct(*names))))
        found = scored.select("id", "ts", "source_ip", "brute_force", F.from_json("held", held).alias("held")).select(
            "id", "ts", "source_ip", "brute_force", "held.*")
    else:
        found = found.withColumn("brute_force", F.lit(None).cast(blank["brute_force"]))

    def sink(batch: DataFrame, batch_id: int) -> None:
        rows = batch.persist()
        try:
            scored = rows.withColumn("anomaly", F.lit(None).cast(blank["anomaly"]))
            if model is not None and vectors is not None:
                fitted = Model.load(rows.sparkSession.read.parquet(model))
                odd = detect_anomaly(vectors(rows), fitted).select("id", F.struct(
                    F.col("is_anomaly").alias("detected"), F.col("anomaly_score").alias("score")).alias("anomaly"))
                scored = rows.join(odd, "id", "left")
            scored = with_risk(scored)
            scored.select("id", "ts", "event_type", "severity", "has_threats", "risk_score", "sqli", "xss", "brute_force", "anomaly").write.mode(
                "overwrite").parquet(os.path.join(detections_out, f"batch={batch_id}"))
            generate_alerts(scored, min_risk).write.mode("overwrite").parquet(os.path.join(alerts_out, f"batch={batch_id}"))
        finally:
            rows.unpersist()

    run(found.writeStream.foreachBatch(sink), checkpoint)


# --- keyed histories --------------------------------------------------------

def bruteforce_history(events: DataFrame) -> DataFrame:
    """Each live attempt with its address's history, as ``ip_history`` has it."""
    tries = live_attempts(events).where(F.col("source_ip").isNotNull())
    return followed(tries, "source_ip", AddressHistory).select(
        "id", "source_ip", "ip_total", "ip_failed", "ip_services", "ip_agents", "ip_users", (F.col("ip_failed") >= MAX_PER_IP).alias("blocked"))


def user_history(events: DataFrame) -> DataFrame:
    """Each live attempt that names a user with the user's history, as in the batch."""
    tries = live_attempts(events).where(F.col("username").isNotNull())
    return followed(tries, "username", UserHistory).select("id", "username", "user_total", "user_failed", "user_ips", "user_compromised")


def service_history(events: DataFrame) -> DataFrame:
    """Each live attempt with its service's history, as in the batch."""
    tries = live_attempts(events).where(F.col("source_ip").isNotNull())
    return followed(tries, "service", ServiceHistory).select("id", "service", "service_total", "service_ips", "service_users", "service_peak")


def _store(rows: DataFrame, out: str, checkpoint: str) -> None:
    """Append live rows to a folder; maps and lists as state need the state store that has them."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    run(rows.writeStream.format("parquet").option("path", out).outputMode("append"), checkpoint)


def stream_bruteforce(events: DataFrame, out: str, checkpoint: str) -> None:
    _store(bruteforce_history(events), out, checkpoint)


def stream_users(events: DataFrame, out: str, checkpoint: str) -> None:
    _store(user_history(events), out, checkpoint)


def stream_services(events: DataFrame, out: str, checkpoint: str) -> None:
    _store(service_history(events), out, checkpoint)


_KEPT = T.StructType([T.StructField("id", T.LongType()), T.StructField("key", T.StringType()), T.StructField("us", T.LongType())])
_LAST = T.StructType([T.StructField("us", T.LongType())])


def throttled(alerts: DataFrame, minutes: int = DEDUP_MINUTES) -> DataFrame:
    """Live alerts without repeats of a kept one, as ``alert_dedup`` does it."""
    span = minutes * 60_000_000

    def keep(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(parts)).sort_values(["us", "id"], ignore_index=True)
        us, ids = rows["us"].to_numpy(), rows["id"].to_numpy()
        kept, at = [], int(np.searchsorted(us, state.get[0] + span)) if state.exists else 0
        while at < len(us):  # from one kept alert to the next, not from row to row
            kept.append(at)
            at = int(np.searchsorted(us, us[at] + span))
        last = int(us[kept[-1]]) if kept else state.get[0]
        state.update((last,))
        state.setTimeoutTimestamp(max((last + span) // 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"id": ids[kept], "key": key[0], "us": us[kept]})

    keyed = alerts.withWatermark("ts", f"{minutes} minutes").select("id", dedup_key().alias("key"), F.unix_micros("ts").alias("us"), "ts")
    return keyed.groupBy("key").applyInPandasWithState(keep, _KEPT, _LAST, "append", GroupStateTimeout.EventTimeTimeout)


def stream_dedup(alerts: DataFrame, out: str, checkpoint: str, minutes: int = DEDUP_MINUTES) -> None:
    run(throttled(alerts, minutes).writeStream.format("parquet").option("path", out).outputMode("append"), checkpoint)


# --- rates ------------------------------------------------------------------

def rates(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Events per window and type; windows close once ``late`` has passed."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("starts_at"), "event_type", "n")


def _rates_table(spark: SparkSession, out: str, fold_every: int = 20) -> BatchTable:
    return BatchTable(spark, out, lambda rows: rows.groupBy("starts_at", "event_type").agg(F.max_by("n", "batch").alias("n")), fold_every)


def stream_rates(events: DataFrame, out: str, checkpoint: str, fold_every: int = 20, **windows) -> int:
    """Keep the last count of every window (see ``latest_rates``); returns how many rows came too late for theirs.

    A batch writes the windows it changes; folded, the table has a row per
    window, however many batches there were.
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", 10_000)
    table = _rates_table(spark, out, fold_every)
    query = run(rates(events, **windows).writeStream.outputMode("update").foreachBatch(table.add), checkpoint)
    return sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"])


def latest_rates(spark: SparkSession, out: str) -> DataFrame:
    """The last count written for each window."""
    return _rates_table(spark, out).read()


# --- retention --------------------------------------------------------------

def _remember(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Keep a key's last time until it has been idle for a day, then report it."""
    if state.hasTimedOut:
        last = state.get[0]
        state.remove()
        yield pd.DataFrame([(key[0], last)], columns=["key", "us"])
        return
    newest = max(int(p["us"].max()) for p in parts)
    last = max(newest, state.get[0]) if state.exists else newest
    state.update((last,))
    state.setTimeoutTimestamp(max(last // 1000 + 86_400_000, state.getCurrentWatermarkMs() + 1))
    yield pd.DataFrame({"key": pd.Series(dtype="str"), "us": pd.Series(dtype="int64")})


def idle_keys(rows: DataFrame, key: str) -> DataFrame:
    """Keys whose state expires: idle for 24 h by event time."""
    seen = rows.where(F.col(key).isNotNull()).withWatermark("ts", "15 minutes")
    keyed = seen.select(F.col(key).cast("string").alias("key"), F.unix_micros("ts").alias("us"), "ts")
    return keyed.groupBy("key").applyInPandasWithState(
        _remember, "key string, us long", _LAST, "append", GroupStateTimeout.EventTimeTimeout)


def stream_retention(rows: DataFrame, key: str, out: str, checkpoint: str) -> None:
    run(idle_keys(rows, key).writeStream.format("parquet").option("path", out).outputMode("append"), checkpoint)


def stream_cleanup(events: DataFrame, store: str, checkpoint: str, days: int) -> None:
    """Remove the days of a store that are over ``days`` before the newest live event's.

    The clock is the events' own, so a stream that stands still removes
    nothing, and a repeated or late batch nothing that has not gone already.
    """
    def sink(batch: DataFrame, batch_id: int) -> None:
        limit = batch.agg(F.date_format(F.date_sub(F.to_date(F.max("ts")), days), "yyyy-MM-dd")).first()[0]
        if limit is not None:
            drop_days_before(batch.sparkSession, store, limit)

    run(events.select("ts").writeStream.foreachBatch(sink), checkpoint)
