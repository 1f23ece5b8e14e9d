"""The alert pipeline as tables: throttle, batch, route, limit, retry, payload."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from palisade.functions import dimensions as D
from palisade.operators.query import at
from palisade.plans.running import running, shared
from palisade.session import truncate_lineage


def dedup_key() -> Column:
    return F.concat_ws(":", "title", "severity")


def _runs(values: np.ndarray):
    """(start, end) of each run of equal values."""
    cuts = np.flatnonzero(values[1:] != values[:-1]) + 1
    return zip(np.append(0, cuts), np.append(cuts, len(values)))


def alert_dedup(alerts: DataFrame, minutes: int = D.DEDUP_MINUTES, key: Column | None = None, block_rows: int = 200_000) -> DataFrame:
    """Keep an alert unless one with its key was kept less than ``minutes`` ago.

    Each kept alert opens the next window, so a key is a chain.  The chain is
    cut into time blocks.  Per block, the possible first alerts map to the time
    the chain is open again at the block's end; following that small map from
    block to block tells where the chain enters every block, and each block
    then walks its part alone.  Blocks are runs of cells of two windows' length
    and end where ``block_rows`` alerts have been counted, so a stray time makes
    no block longer.  Keys share task calls by their hash, as many as keep a
    call near ``block_rows`` rows.
    """
    span = minutes * 60_000_000
    width = 2 * span
    key = dedup_key() if key is None else key
    # only the first alert of an instant can be kept
    firsts = alerts.groupBy(key.alias("k"), F.unix_micros("ts").alias("us")).agg(F.min("id").alias("id"))
    firsts = firsts.withColumn("cell", F.floor(F.col("us") / width).cast("long"))
    sizes = firsts.groupBy("cell").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    blocks = truncate_lineage(sizes.withColumn("block", F.floor(F.coalesce(before, F.lit(0)) / block_rows).cast("long")))
    largest = blocks.groupBy("block").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0
    firsts = firsts.join(blocks.select("cell", "block"), "cell")
    bins = max(1, -(-largest // block_rows))
    firsts = shared(firsts.withColumn("bin", F.pmod(F.xxhash64("k"), F.lit(bins))))

    def block_map(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["k", "us"], ignore_index=True)
        keys, times, block = pdf["k"].to_numpy(), pdf["us"].to_numpy(), int(pdf["block"].iloc[0])
        start = int(pdf["cell"].min()) * width
        found = []
        for lo, hi in _runs(keys):
            t, n = times[lo:hi], hi - lo
            follows = np.append(np.searchsorted(t, t + span), n)
            last, step = np.arange(n), follows[:n]
            while (step < n).any():
                last = np.where(step < n, step, last)
                step = follows[last]
            # the chain enters at the first alert after a time below block start + span
            entries = min(n, int(np.searchsorted(t, start + span)) + 1)
            upto, leave = t[:entries], t[last[:entries]] + span
            keep = np.append(leave[1:] != leave[:-1], True)
            found.append(pd.DataFrame({"k": keys[lo], "block": block, "upto": upto[keep], "leave": leave[keep]}))
        return pd.concat(found)

    def enter_blocks(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["k", "block", "upto"], ignore_index=True)
        keys, blocks = pdf["k"].to_numpy(), pdf["block"].to_numpy()
        upto, leave = pdf["upto"].to_numpy(), pdf["leave"].to_numpy()
        rows = []
        for lo, hi in _runs(keys):
            opens = np.iinfo("int64").min
            for b, e in _runs(blocks[lo:hi]):
                rows.append((keys[lo], blocks[lo + b], opens))
                i = lo + b + int(np.searchsorted(upto[lo + b:lo + e], opens))
                if i < lo + e:
                    opens = int(leave[i])
        out = pd.DataFrame(rows, columns=["k", "block", "enter"])
        return out

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["k", "us"], ignore_index=True)
        keys, times, ids, enter = (pdf[c].to_numpy() for c in ("k", "us", "id", "enter"))
        kept = []
        for lo, hi in _runs(keys):
            t, i = times[lo:hi], int(np.searchsorted(times[lo:hi], enter[lo]))
            while i < hi - lo:
                kept.append(ids[lo + i])
                i = int(np.searchsorted(t, t[i] + span))
        return pd.DataFrame({"id": np.array(kept, dtype="int64")})

    maps = shared(firsts.groupBy("bin", "block").applyInPandas(block_map, "k string, block long, upto long, leave long"))
    groups = max(1, -(-maps.count() // block_rows))
    entered = maps.groupBy(F.pmod(F.xxhash64("k"), F.lit(groups)).alias("bin")).applyInPandas(enter_blocks, "k string, block long, enter long")
    placed = firsts.join(entered, ["k", "block"])
    kept = placed.groupBy("bin", "block").applyInPandas(walk, "id long")
    return alerts.join(kept, "id", "left_semi")


def alert_priority(severity: Column) -> Column:
    return (
        F.when(severity.isin("Low", "Info"), "Low").when(severity.isin("Medium", "Warning"), "Normal")
        .when(severity == "High", "High").when(severity == "Critical", "Emergency")
    )


def alert_batch(alerts: DataFrame, minutes: int = D.BATCH_MINUTES, size: int = D.BATCH_SIZE) -> DataFrame:
    """Add ``batch_id``; NULL for critical alerts, which go out at once.

    A batch holds at most ``size`` alerts of one severity and window.
    """
    grouped = alerts.where("severity <> 'Critical'").withColumn("_w", F.window("ts", f"{minutes} minutes")["start"])
    # places are counted second by second, so a flood of one severity is many small groups
    grouped = running(grouped, ["severity", "_w"], ["ts", "id"], ts="ts", sums={"_place": F.lit(1)}, width=1)
    part = F.floor((F.col("_place") - 1) / size).cast("string")
    batch = F.concat_ws("/", "severity", F.unix_seconds("_w").cast("string"), part)
    batched = grouped.withColumn("batch_id", batch).drop("_w", "_place")
    now = alerts.where("severity = 'Critical'").withColumn("batch_id", F.lit(None).cast("string"))
    return batched.unionByName(now)


def alert_summary(batches: DataFrame, latest: int = 5) -> DataFrame:
    """Per batch: size, counts by severity, the latest titles."""
    batched = batches.where(F.col("batch_id").isNotNull())
    cells = batched.groupBy("batch_id", "severity").agg(F.count("*").alias("n"))
    counts = cells.groupBy("batch_id").agg(
        F.sum("n").alias("alerts"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("severity", "n")))).alias("by_severity"))
    rank = F.row_number().over(Window.partitionBy("batch_id").orderBy(F.desc("ts"), F.desc("id")))
    top = batched.withColumn("_n", rank).where(F.col("_n") <= latest).groupBy("batch_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_n", "title"))), lambda x: x["title"]).alias("latest"))
    return counts.join(top, "batch_id").withColumn("more", F.greatest(F.col("alerts") - latest, F.lit(0)))


def alert_deliveries(routed: DataFrame, enabled: list[str], emergency: bool = False) -> DataFrame:
    """One row per alert and channel to try, in order.

    Emergency alerts go console, e-mail, webhook until one works, so all
    enabled channels are listed by that order whatever the routing.
    """
    if not emergency:
        return routed.select("id", "ts", "severity", "channel", "position")
    order = [c for c in ("console", "email", "webhook") if c in enabled]
    alerts = routed.dropDuplicates(["id"])
    return alerts.select("id", "ts", "severity", F.posexplode(F.array(*[F.lit(c) for c in order])).alias("position", "channel"))


def rate_limit(deliveries: DataFrame, channel: str, limit: int, window: str) -> DataFrame:
    """The channel's first ``limit`` deliveries of every fixed window."""
    mine = deliveries.where(F.col("channel") == channel).withColumn("_w", F.window("ts", window)["start"])
    place = F.row_number().over(Window.partitionBy("_w").orderBy("ts", "alert_id"))
    return mine.withColumn("_n", place).where(F.col("_n") <= limit).drop("_w", "_n")


def retry_schedule(
    deliveries: DataFrame, attempts: int = D.RETRY_ATTEMPTS, seconds: int = D.RETRY_SECONDS,
    factor: float = D.RETRY_FACTOR, most: int = D.RETRY_MAX_SECONDS,
) -> DataFrame:
    """Failed deliveries worth retrying, with delay and time of the next try."""
    failed = deliveries.where(
        ~F.col("success") & ~F.col("status").isin(*D.NO_RETRY_STATUS) & (F.col("attempt") <= attempts))
    delay = F.least(F.lit(float(most)), seconds * F.pow(F.lit(factor), F.col("attempt") - 1)).cast("long")
    out = failed.withColumn("delay_seconds", delay)
    return out.withColumn("next_retry", F.timestamp_micros(F.unix_micros("ts") + F.col("delay_seconds") * 1_000_000))


def due_retries(schedule: DataFrame, as_of=None) -> DataFrame:
    return schedule.where(F.col("next_retry") <= at(as_of, schedule, "next_retry"))


def alert_payload(
    targets: DataFrame, *, source: str = "palisade", version: str = "1.0.0",
    environment: str = "production",
) -> DataFrame:
    """(id, endpoint, value): the JSON a webhook or a Kafka topic receives.

    ``targets`` has one row per alert and endpoint, as ``alert_endpoints``
    gives, with the endpoint's template (NULL: the standard payload); it may
    carry batch_id and batch_size.  A template that does not give JSON is
    wrapped.
    """
    has_batch = "batch_id" in targets.columns
    alert = F.struct("id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), "severity", "title", "description")
    in_batch = F.col("batch_id").isNotNull() if has_batch else F.lit(False)
    batch = F.when(in_batch, F.struct(F.col("batch_id"), F.col("batch_size").alias("total_alerts"))) if has_batch else F.lit(None)
    meta = F.struct(F.lit(source).alias("source"), F.lit(version).alias("version"), F.lit(environment).alias("environment"))
    standard = F.to_json(F.struct(
        F.when(in_batch, "security_alert_batch").otherwise("security_alert").alias("event_type"),
        alert.alias("alert"), meta.alias("metadata"), *([batch.alias("batch_info")] if has_batch else [])))
    text = F.col("template")
    for mark, value in (
        ("{{alert.title}}", F.col("title")), ("{{alert.severity}}", F.col("severity")),
        ("{{alert.description}}", F.col("description")), ("{{alert.id}}", F.col("id").cast("string")),
        ("{{timestamp}}", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")),
    ):
        text = F.replace(text, F.lit(mark), value)
    filled = targets.withColumn("_text", text)
    is_json = F.expr("try_parse_json(_text)").isNotNull()
    wrapped = F.to_json(F.struct(F.col("_text").alias("message"), alert.alias("alert"), meta.alias("metadata")))
    value = F.when(F.col("template").isNull(), standard).when(is_json, F.col("_text")).otherwise(wrapped)
    return filled.select("id", "endpoint", value.alias("value"))
