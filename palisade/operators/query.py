"""Filtering, searching, retention, top-k and set operations on events and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from palisade.schema import severity_rank

RANGE_HOURS = {"1h": 1, "24h": 24, "7d": 168, "30d": 720}


def at(as_of: str | Column | None, df: DataFrame, ts: str = "ts") -> Column:
    """The reference time: given, or the newest ``ts`` of the table."""
    if as_of is None:
        return df.agg(F.max(ts)).scalar()
    return F.lit(as_of).cast("timestamp") if isinstance(as_of, str) else as_of


def ago(now: Column, **parts: int) -> Column:
    seconds = sum({"days": 86400, "hours": 3600, "minutes": 60, "seconds": 1}[k] * v for k, v in parts.items())
    return now - F.expr(f"INTERVAL '{seconds}' SECOND")


def newest(df: DataFrame, limit: int | None) -> DataFrame:
    """The newest rows, newest first; ties by id so that a page is always the same page.

    Without a limit all rows come back, unsorted: nobody reads a whole table as a page.
    """
    return df.orderBy(F.desc("ts"), F.desc("id")).limit(limit) if limit is not None else df


def between(df: DataFrame, from_ts, to_ts) -> DataFrame:
    has_date = "event_date" in df.columns
    for bound, op in ((from_ts, "__ge__"), (to_ts, "__le__")):
        if bound is not None:
            limit = F.lit(bound).cast("timestamp") if isinstance(bound, str) else bound
            df = df.where(getattr(F.col("ts"), op)(limit))
            if has_date:  # prunes the partitions of stored events
                df = df.where(getattr(F.col("event_date"), op)(F.to_date(limit)))
    return df


def select_events(
    events: DataFrame, *, severity: str | None = None, source: str | None = None, event_type: str | None = None,
    from_ts=None, to_ts=None,
) -> DataFrame:
    for column, wanted in (("severity", severity), ("source", source), ("event_type", event_type)):
        if wanted is not None:
            events = events.where(F.col(column) == wanted)
    return between(events, from_ts, to_ts)


def filter_events(events: DataFrame, *, limit: int | None = None, **wanted) -> DataFrame:
    """The selection of ``select_events``; with a limit its newest rows."""
    return newest(select_events(events, **wanted), limit)


def event_by_id(events: DataFrame, event_id) -> DataFrame:
    return events.where(F.col("id") == event_id)


def recent_events(events: DataFrame, limit: int) -> DataFrame:
    return newest(events, limit)


def search_events(events: DataFrame, text: str, severity: str | None = None) -> DataFrame:
    """Case-insensitive substring in message, source or event type."""
    needle = text.lower()
    hit = (
        F.lower("raw_message").contains(needle) | F.lower("source").contains(needle)
        | F.lower("event_type").contains(needle)
    )
    found = events.where(hit)
    return found.where(F.col("severity") == severity) if severity else found


def time_range(events: DataFrame, name: str | None = "24h", as_of=None) -> DataFrame:
    """Events of the last 1h, 24h, 7d or 30d; anything else means 24h."""
    now = at(as_of, events)
    return between(events, ago(now, hours=RANGE_HOURS.get(name or "24h", 24)), now)


# --- alerts -----------------------------------------------------------------

def first_acks(acks: DataFrame) -> DataFrame:
    return acks.groupBy(F.col("alert_id").alias("id")).agg(F.min("ts").alias("acked_at"))


def with_status(alerts: DataFrame, acks: DataFrame) -> DataFrame:
    """Alerts with ``acked_at`` and ``status``; the first acknowledgement counts."""
    return alerts.join(first_acks(acks), "id", "left").withColumn(
        "status", F.when(F.col("acked_at").isNull(), "active").otherwise("acknowledged"))


def acknowledge(acks: DataFrame, alerts: DataFrame, requests: DataFrame) -> DataFrame:
    """New acknowledgements: requests for known alerts not acknowledged yet."""
    fresh = requests.groupBy("alert_id").agg(F.min("ts").alias("ts"))
    known = fresh.join(alerts.select(F.col("id").alias("alert_id")), "alert_id", "left_semi")
    return known.join(acks, "alert_id", "left_anti")


def active_alerts(alerts: DataFrame, acks: DataFrame) -> DataFrame:
    return newest(alerts.join(acks, alerts["id"] == acks["alert_id"], "left_anti"), None)


def all_alerts(alerts: DataFrame, limit: int | None = None) -> DataFrame:
    return newest(alerts, limit)


def filter_alerts(
    alerts: DataFrame, acks: DataFrame, *, severity: str | None = None, from_ts=None, to_ts=None, limit: int | None = None,
) -> DataFrame:
    open_alerts = alerts.join(acks, alerts["id"] == acks["alert_id"], "left_anti")
    if severity is not None:
        open_alerts = open_alerts.where(F.col("severity") == severity)
    return newest(between(open_alerts, from_ts, to_ts), limit)


def filter_alert_status(alerts: DataFrame, acks: DataFrame, status: str) -> DataFrame:
    return with_status(alerts, acks).where(F.col("status") == status)


# --- retention --------------------------------------------------------------

def retain_events(events: DataFrame, days: int, as_of=None) -> DataFrame:
    return between(events, ago(at(as_of, events), days=days), None)


def retain_alerts(alerts: DataFrame, acks: DataFrame, days: int, as_of=None) -> DataFrame:
    """Drop alerts acknowledged more than ``days`` ago; open ones stay."""
    cutoff = ago(at(as_of, alerts), days=days)
    seen = with_status(alerts, acks)
    return seen.where(F.col("acked_at").isNull() | (F.col("acked_at") >= cutoff)).drop("acked_at", "status")


def retain_newest(events: DataFrame, capacity: int) -> DataFrame:
    return newest(events, capacity)


def retain_alert_capacity(alerts: DataFrame, acks: DataFrame, capacity: int) -> DataFrame:
    """The newest alerts; acknowledged ones give way first."""
    seen = with_status(alerts, acks)
    kept = seen.orderBy(F.col("acked_at").isNotNull().asc(), F.desc("ts"), F.desc("id")).limit(capacity)
    return kept.drop("acked_at", "status")


def retain_active_keys(rows: DataFrame, key: str, as_of=None, hours: int = 24) -> DataFrame:
    """Keys (address, user, service) seen within ``hours``, with their last time."""
    cutoff = ago(at(as_of, rows), hours=hours)
    last = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max("ts").alias("last_ts"))
    return last.where(F.col("last_ts") > cutoff)


def retain_since(rows: DataFrame, hours: int, as_of=None, ts: str = "ts") -> DataFrame:
    """Training samples (48 h), open batches (1 h), planned retries (24 h)."""
    return rows.where(F.col(ts) > ago(at(as_of, rows, ts), hours=hours))


# --- gates ------------------------------------------------------------------

def severity_gate(severity: Column, minimum: str) -> Column:
    """E-mail and webhook filter: All, Warning (Warning or Critical), Critical."""
    if minimum == "All":
        return F.lit(True)
    return severity.isin("Warning", "Critical") if minimum == "Warning" else severity == "Critical"


def console_gate(severity: Column, minimum: str) -> Column:
    return severity_rank(severity) >= severity_rank(F.lit(minimum))


def active_hours_gate(ts: Column, start: Column, end: Column, weekdays_only: Column, tz: Column | str = "UTC") -> Column:
    """Hour within [start, end], which may wrap past midnight, in the zone ``tz``."""
    local = F.from_utc_timestamp(ts, tz)
    hour = F.hour(local)
    inside = F.when(start <= end, hour.between(start, end)).otherwise((hour >= start) | (hour <= end))
    return inside & (~weekdays_only | (F.weekday(local) < 5))


# --- set operations ---------------------------------------------------------

def merge_stores(hot: DataFrame, cold: DataFrame, limit: int | None = None) -> DataFrame:
    """Both stores as one by id; the hot copy of an event wins."""
    older = cold.join(hot.select("id"), "id", "left_anti")
    return newest(hot.unionByName(older), limit)
