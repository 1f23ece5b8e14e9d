"""Statistics and report tables over events and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from palisade.functions.dimensions import COUNTRIES, GEO_PREFIXES
from palisade.operators.query import RANGE_HOURS, ago, at, first_acks, select_events, time_range
from palisade.plans.running import shared
from palisade.schema import EVENT_TYPE_LABELS


def count_table(counts: Column) -> Column:
    """``map<string,bigint>`` from an array of (name, n) structs, name order."""
    return F.map_from_entries(F.array_sort(counts))


def events_by_severity(events: DataFrame) -> DataFrame:
    return events.groupBy("severity").agg(F.count("*").alias("events"))


def events_by_source(events: DataFrame, limit: int = 10) -> DataFrame:
    return events.groupBy("source").agg(F.count("*").alias("events")).orderBy(F.desc("events"), "source").limit(limit)


def threat_score(open_recent: Column) -> Column:
    return (
        F.when(open_recent == 0, F.lit(1.0))
        .when(open_recent <= 5, 3.0 + open_recent * 0.5)
        .otherwise(6.0 + F.least((open_recent - 5) * 0.3, F.lit(4.0)))
    )


def alert_totals(alerts: DataFrame, acks: DataFrame, as_of=None) -> DataFrame:
    """One row: totals, open critical alerts, open alerts of the last 24 h."""
    day_ago = ago(at(as_of, alerts), hours=24)
    is_open = F.col("acked_at").isNull()
    return alerts.join(first_acks(acks), "id", "left").agg(
        F.count("*").alias("total_alerts"),
        F.count_if(~is_open).alias("acknowledged_alerts"),
        F.count_if(is_open & (F.col("severity") == "Critical")).alias("critical_alerts"),
        F.count_if(is_open & (F.col("ts") > day_ago)).alias("open_last_day"),
    )


def dashboard_stats(events: DataFrame, alerts: DataFrame, acks: DataFrame, as_of=None) -> DataFrame:
    """One row of headline figures."""
    now = at(as_of, events)
    totals = alert_totals(alerts, acks, as_of)
    figures = totals.select(F.struct(*totals.columns)).scalar()
    seen = events.agg(
        F.count("*").alias("total_events"),
        (F.count_if(F.col("ts") > ago(now, hours=1)) / 3600).alias("events_per_second"),
        F.count_distinct(F.when(F.col("ts") > ago(now, hours=24), F.col("source"))).alias("active_sources"),
    )
    return seen.withColumn("a", figures).select(
        "total_events", "events_per_second", "active_sources", "a.*",
        threat_score(F.col("a.open_last_day")).alias("threat_score"),
    ).drop("open_last_day")


def events_by_type(events: DataFrame) -> DataFrame:
    names = F.create_map(*[F.lit(x) for pair in EVENT_TYPE_LABELS.items() for x in pair])
    counts = events.groupBy("event_type").agg(F.count("*").alias("events"))
    share = F.col("events") / F.sum("events").over(Window.partitionBy()) * 100
    return counts.select("event_type", F.element_at(names, F.col("event_type")).alias("label"), "events", share.alias("percentage"))


def _count(n: Column, condition: Column | None = None) -> Column:
    """How many events: rows stand for ``n`` of them each."""
    return F.coalesce(F.sum(n if condition is None else F.when(condition, n)), F.lit(0)).cast("long")


def threat_trends(events: DataFrame, range_name: str = "24h", as_of=None, n: Column | None = None) -> DataFrame:
    """Attacks per bucket from ``as_of - range``; empty buckets count zero.  A row is ``n`` events, else one."""
    n = F.lit(1) if n is None else n
    hours = RANGE_HOURS.get(range_name, 24)
    width = 1 if hours <= 24 else hours // 24
    now = at(as_of, events)
    start = ago(now, hours=hours)
    span = width * 3_600_000_000
    inside = events.where((F.col("ts") >= start) & (F.col("ts") < now))
    bucket = F.floor((F.unix_micros("ts") - F.unix_micros(start)) / span).cast("long")
    kinds = {"sql_injection": "SqlInjection", "xss": "XssAttempt", "brute_force": "BruteForce", "anomaly": "Anomaly"}
    counts = inside.groupBy(bucket.alias("bucket")).agg(
        *[_count(n, F.col("event_type") == t).alias(name) for name, t in kinds.items()])
    buckets = events.sparkSession.range(hours // width).withColumnRenamed("id", "bucket")
    return buckets.join(counts, "bucket", "left").select(
        "bucket", F.timestamp_micros(F.unix_micros(start) + F.col("bucket") * span).alias("starts_at"),
        *[F.coalesce(name, F.lit(0)).alias(name) for name in kinds],
    )


def country_of(ip: Column) -> Column:
    """Country of an address by the shipped prefixes."""
    chain = F
    for prefix, country in GEO_PREFIXES:
        chain = chain.when(ip.startswith(prefix), country)
    return chain.otherwise("Unknown")


def place_of(country: Column, field: str) -> Column:
    at_field = {"code": 1, "name": 2, "lat": 3, "lon": 4}[field]
    chain = F
    for row in COUNTRIES:
        chain = chain.when(country == row[0], F.lit(row[at_field]))
    return chain


def geo_heatmap(events: DataFrame) -> DataFrame:
    counts = events.where(F.col("source_ip").isNotNull()).groupBy(country_of(F.col("source_ip")).alias("country")).agg(
        F.count("*").alias("threat_count"))
    top = F.max("threat_count").over(Window.partitionBy())
    country = F.col("country")
    level = (
        F.when(F.col("threat_count") > F.floor(top / 2), "High")
        .when(F.col("threat_count") > F.floor(top / 4), "Medium").otherwise("Low")
    )
    return counts.select(
        "country", place_of(country, "code").alias("country_code"), place_of(country, "name").alias("country_name"),
        place_of(country, "lat").alias("lat"), place_of(country, "lon").alias("lon"), "threat_count",
        level.alias("threat_level"),
    )


def hourly_timeline(events: DataFrame, n: Column | None = None) -> DataFrame:
    """24 rows; a peak hour has more than half the busiest hour's events.  A row is ``n`` events, else one."""
    n = F.lit(1) if n is None else n
    counts = events.groupBy(F.hour("ts").cast("long").alias("hour")).agg(
        _count(n).alias("total_events"), _count(n, F.col("severity") == "Critical").alias("critical_events"),
        _count(n, F.col("event_type") == "Anomaly").alias("ml_detected"))
    hours = events.sparkSession.range(24).withColumnRenamed("id", "hour")
    full = hours.join(counts, "hour", "left").na.fill(0)
    peak = F.col("total_events") > F.floor(F.max("total_events").over(Window.partitionBy()) / 2)
    return full.withColumn("is_peak", peak)


def top_threat_sources(events: DataFrame, limit: int = 10) -> DataFrame:
    """The busiest addresses.  Counting per (ip, severity, type) first keeps
    the per-address step small however hot an address is."""
    cells = events.where(F.col("source_ip").isNotNull()).groupBy("source_ip", "severity", "event_type").agg(
        F.count("*").alias("n"))
    by_severity = cells.groupBy("source_ip", "severity").agg(
        F.sum("n").alias("n"), F.collect_set("event_type").alias("types"))
    per_ip = by_severity.groupBy("source_ip").agg(
        F.sum("n").alias("threat_count"),
        count_table(F.collect_list(F.struct("severity", "n"))).alias("severity_distribution"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("types")))).alias("attack_types"),
    )
    top = per_ip.orderBy(F.desc("threat_count"), "source_ip").limit(limit)
    return top.select(
        "source_ip", country_of(F.col("source_ip")).alias("country"), "threat_count", "severity_distribution",
        "attack_types", (F.log10("threat_count") * 2).alias("risk_score"))


def detection_efficiency(events: DataFrame) -> DataFrame:
    sums = events.agg(
        F.count("*").alias("total_events"), F.count_if(F.col("severity") == "Critical").alias("threats_detected"),
        F.count_if(F.col("event_type") == "Anomaly").alias("ml_detected"))

    def pct(n: Column) -> Column:
        return F.when(F.col("total_events") > 0, n / F.col("total_events") * 100).otherwise(F.lit(0.0))

    return sums.select(
        "total_events", "threats_detected", pct(F.col("threats_detected")).alias("detection_rate"),
        pct(F.col("ml_detected")).alias("ml_contribution"),
        pct(F.col("total_events") - F.col("ml_detected")).alias("rule_based_contribution"))


def report_bundle(
    events: DataFrame, range_name: str = "24h", as_of=None, *, severity: str | None = None,
    source: str | None = None, event_types: list[str] | None = None,
) -> dict[str, DataFrame]:
    """Every report over one filtered range; the filtered events are shared."""
    chosen = time_range(events, range_name, as_of)
    chosen = select_events(chosen, severity=severity, source=source)
    if event_types:
        chosen = chosen.where(F.col("event_type").isin(*event_types))
    chosen = shared(chosen.select("id", "ts", "source", "source_ip", "severity", "event_type"))
    return {
        "events_by_type": events_by_type(chosen),
        "threat_trends": threat_trends(chosen, range_name, at(as_of, events)),
        "geo_heatmap": geo_heatmap(chosen),
        "hourly_timeline": hourly_timeline(chosen),
        "top_threat_sources": top_threat_sources(chosen),
        "detection_efficiency": detection_efficiency(chosen),
    }


# --- alert statistics -------------------------------------------------------

def alert_activity(alerts: DataFrame, routed: DataFrame, hours: int, as_of=None) -> DataFrame:
    """Long table (measure, name, n) of the last hours: total, severity, channel.

    ``routed`` has one row per alert and channel.
    """
    cutoff = ago(at(as_of, alerts), hours=hours)
    recent = alerts.where(F.col("ts") > cutoff)
    sent = routed.where(F.col("ts") > cutoff)
    # total and per-severity counts in one pass: the total is their sum
    by_severity = recent.groupBy(F.lit("severity").alias("measure"), F.col("severity").alias("name")).agg(
        F.count("*").alias("n"))
    total = by_severity.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(
        F.lit("total").alias("measure"), F.lit("all").alias("name"), "n")
    by_channel = sent.groupBy(F.lit("channel").alias("measure"), F.col("channel").alias("name")).agg(F.count("*").alias("n"))
    return total.unionByName(by_severity).unionByName(by_channel)


def latest_alerts(alerts: DataFrame, hours: int, as_of=None, limit: int = 10) -> DataFrame:
    recent = alerts.where(F.col("ts") > ago(at(as_of, alerts), hours=hours))
    return recent.orderBy(F.desc("ts"), F.desc("id")).limit(limit)


def channel_statistics(deliveries: DataFrame) -> DataFrame:
    ok = F.col("success")
    cells = deliveries.groupBy("channel", "severity").agg(
        F.count_if(ok).alias("sent"), F.count_if(~ok).alias("failed"),
        F.max(F.when(ok, F.col("ts"))).alias("last_success"), F.max(F.when(~ok, F.col("ts"))).alias("last_failure"),
        F.sum("response_ms").alias("ms"))
    return cells.groupBy("channel").agg(
        F.sum("sent").alias("sent"), F.sum("failed").alias("failed"), F.max("last_success").alias("last_success"),
        F.max("last_failure").alias("last_failure"),
        (F.sum("ms") / (F.sum("sent") + F.sum("failed"))).alias("mean_response_ms"),
        count_table(F.collect_list(F.struct("severity", F.col("sent").alias("n")))).alias("sent_by_severity"))


def endpoint_statistics(deliveries: DataFrame) -> DataFrame:
    """Per endpoint; trailing failures are those after the last success."""
    place = F.struct("ts", "alert_id")
    last_ok = deliveries.where("success").groupBy("endpoint").agg(F.max(place).alias("last_ok"))
    joined = deliveries.join(last_ok, "endpoint", "left")
    trailing = ~F.col("success") & (F.col("last_ok").isNull() | (place > F.col("last_ok")))
    return joined.groupBy("endpoint").agg(
        F.count("*").alias("requests"), F.count_if(~F.col("success")).alias("failures"),
        F.avg("response_ms").alias("mean_response_ms"), F.count_if(trailing).alias("consecutive_failures"))


def retry_queue_status(retries: DataFrame) -> DataFrame:
    """Pending retries and the earliest, per endpoint."""
    return retries.groupBy("endpoint").agg(F.count("*").alias("pending"), F.min("next_retry").alias("next_retry"))
