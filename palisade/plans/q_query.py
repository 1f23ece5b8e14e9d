"""Registered queries: filters, retention, gates, top-k, set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from palisade.operators import query as Q
from palisade.plans import oracle as O
from palisade.plans.oracle import NOW, al, ev
from palisade.plans.registry import query, secs
from palisade.schema import EVENTS
from palisade.session import scratch_folder
from palisade.sources import fixtures as fx, store as W
from palisade.sources.fixtures import AS_OF
from palisade.sources.search_index import index_events, search_indexed as trigram_search
from palisade.sources.upkeep import compact_days


def _brief(df: DataFrame) -> DataFrame:
    return df.select("id", secs("ts").alias("ts_s"), "source", "severity", "source_ip", "event_type")


_BRIEF = f"SELECT id, {O.secs('ts')} AS ts_s, source, severity, source_ip, event_type FROM ev "


def _alert(df: DataFrame) -> DataFrame:
    return df.select("id", secs("ts").alias("ts_s"), "severity", "title")


_ALERT = f"SELECT id, {O.secs('ts')} AS ts_s, severity, title FROM alerts "
_OPEN = "id NOT IN (SELECT alert_id FROM acks)"


@query("filter_events", ev(_BRIEF + """WHERE severity = 'Critical' AND ts >= TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-20 12:00:00'
   ORDER BY ts DESC, id DESC LIMIT 200"""))
def filter_events(spark, sf):
    return _brief(Q.filter_events(
        fx.events(spark, sf), severity="Critical", from_ts="2024-01-10 00:00:00", to_ts="2024-01-20 12:00:00", limit=200))


@query("filter_events_by_type", ev(_BRIEF + "WHERE source = 'apache' AND event_type = 'SqlInjection'"))
def filter_events_by_type(spark, sf):
    return _brief(Q.filter_events(fx.events(spark, sf), source="apache", event_type="SqlInjection"))


@query("event_by_id", ev(_BRIEF + "WHERE id = 777"))
def event_by_id(spark, sf):
    return _brief(Q.event_by_id(fx.events(spark, sf), 777))


@query("recent_events", ev(_BRIEF + "ORDER BY ts DESC, id DESC LIMIT 100"))
def recent_events(spark, sf):
    return _brief(Q.recent_events(fx.events(spark, sf), 100))


@query("search_events", ev(_BRIEF + "WHERE (contains(lower(raw_message), 'passwd') OR contains(lower(source), 'passwd') OR contains(lower(event_type), 'passwd')) AND severity = 'Critical'"))
def search_events(spark, sf):
    return _brief(Q.search_events(fx.events(spark, sf), "PassWD", "Critical"))


@query("search_indexed", ev(_BRIEF + "WHERE contains(lower(raw_message), 'passwd') OR contains(lower(source), 'passwd') OR contains(lower(event_type), 'passwd')"))
def search_indexed(spark, sf):
    """The same search over stored events by their trigrams."""
    store, index = scratch_folder(spark, "searched"), scratch_folder(spark, "trigrams")
    W.write_events(fx.events(spark, sf), store)
    index_events(W.read_events(spark, store), index)
    return _brief(trigram_search(spark, store, index, "PassWD"))


@query("event_by_id_stored", ev(_BRIEF + "WHERE id = 777"))
def event_by_id_stored(spark, sf):
    store = scratch_folder(spark, "by-id")
    W.write_events(fx.events(spark, sf), store)
    return _brief(Q.event_by_id(W.read_events(spark, store), 777))


@query("search_documents", "SELECT doc_id AS id, source FROM documents WHERE contains(lower(text), 'data') OR contains(lower(source), 'data')")
def search_documents(spark, sf):
    docs = fx.table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), "source", F.col("text").alias("raw_message"), F.lit("").alias("event_type"))
    return Q.search_events(docs, "data").select("id", "source")


@query("active_alerts", al(_ALERT + f"WHERE {_OPEN}"))
def active_alerts(spark, sf):
    return _alert(Q.active_alerts(fx.alerts(spark, sf), fx.acks(spark, sf)))


@query("all_alerts", al(_ALERT + "ORDER BY ts DESC, id DESC LIMIT 250"))
def all_alerts(spark, sf):
    return _alert(Q.all_alerts(fx.alerts(spark, sf), 250))


@query("filter_alerts", al(_ALERT + f"WHERE {_OPEN} AND severity = 'High' AND ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-28' ORDER BY ts DESC, id DESC LIMIT 50"))
def filter_alerts(spark, sf):
    return _alert(Q.filter_alerts(
        fx.alerts(spark, sf), fx.acks(spark, sf), severity="High", from_ts="2024-01-05 00:00:00", to_ts="2024-01-28 00:00:00", limit=50))


@query("filter_alert_status", al(f"SELECT a.id, a.severity, {O.secs('k.ts')} AS acked_s, 'acknowledged' AS status FROM alerts a JOIN acks k ON a.id = k.alert_id"))
def filter_alert_status(spark, sf):
    seen = Q.filter_alert_status(fx.alerts(spark, sf), fx.acks(spark, sf), "acknowledged")
    return seen.select("id", "severity", secs("acked_at").alias("acked_s"), "status")


@query("acknowledge", al(f"""SELECT alert_id, {O.secs('min(ts)')} AS ts_s FROM (
   SELECT id AS alert_id, ts + INTERVAL 2 HOUR AS ts FROM alerts WHERE id % 2 = 0
   UNION ALL SELECT id, ts + INTERVAL 3 HOUR FROM alerts WHERE id % 6 = 0 UNION ALL SELECT id + 1000000000, ts FROM alerts)
   WHERE alert_id NOT IN (SELECT alert_id FROM acks) AND alert_id IN (SELECT id FROM alerts) GROUP BY 1"""))
def acknowledge(spark, sf):
    alerts = fx.alerts(spark, sf)
    later = lambda keep, h: alerts.where(keep).select(F.col("id").alias("alert_id"), (F.col("ts") + F.expr(f"INTERVAL {h} HOUR")).alias("ts"))
    unknown = alerts.select((F.col("id") + 1_000_000_000).alias("alert_id"), "ts")
    requests = later("id % 2 = 0", 2).unionByName(later("id % 6 = 0", 3)).unionByName(unknown)
    return Q.acknowledge(fx.acks(spark, sf), alerts, requests).select("alert_id", secs("ts").alias("ts_s"))


@query("retain_events", ev(_BRIEF + f"WHERE ts >= {NOW} - INTERVAL 7 DAY"))
def retain_events(spark, sf):
    return _brief(Q.retain_events(fx.events(spark, sf), 7, AS_OF))


@query("retain_alerts", al(_ALERT + f"WHERE id NOT IN (SELECT alert_id FROM acks WHERE ts < {NOW} - INTERVAL 10 DAY)"))
def retain_alerts(spark, sf):
    return _alert(Q.retain_alerts(fx.alerts(spark, sf), fx.acks(spark, sf), 10, AS_OF))


@query("retain_events_stored", ev(_BRIEF + f"WHERE ts >= {NOW} - INTERVAL 7 DAY"))
def retain_events_stored(spark, sf):
    """What a store holds once the retention has been applied to it and its small files are gathered."""
    path = scratch_folder(spark, "retained")
    W.write_events(fx.events(spark, sf), path)
    W.retain_stored_events(spark, path, 7, AS_OF)
    compact_days(spark, path, EVENTS)
    return _brief(W.read_events(spark, path))


@query("retain_alerts_stored", al(_ALERT + f"WHERE id NOT IN (SELECT alert_id FROM acks WHERE ts < {NOW} - INTERVAL 10 DAY)"))
def retain_alerts_stored(spark, sf):
    path = scratch_folder(spark, "retained-alerts")
    W.write_alerts(fx.alerts(spark, sf), path)
    W.retain_stored_alerts(spark, path, fx.acks(spark, sf), 10, AS_OF)
    return _alert(W.read_alerts(spark, path))


@query("retain_capacity", f"""WITH {O._EV}, {O.ALERT_CTES}
   SELECT 'event' AS kind, id FROM (SELECT id FROM ev ORDER BY ts DESC, id DESC LIMIT 5000)
   UNION ALL SELECT 'alert', id FROM (SELECT id FROM alerts ORDER BY (id IN (SELECT alert_id FROM acks)), ts DESC, id DESC LIMIT 1600)""")
def retain_capacity(spark, sf):
    events = Q.retain_newest(fx.events(spark, sf), 5000).select(F.lit("event").alias("kind"), "id")
    kept = Q.retain_alert_capacity(fx.alerts(spark, sf), fx.acks(spark, sf), 1600)
    return events.unionByName(kept.select(F.lit("alert").alias("kind"), "id"))


@query("retain_tracking", ev(f"""SELECT 'ip' AS kind, source_ip AS key, {O.secs('max(ts)')} AS last_s FROM ev WHERE source_ip IS NOT NULL GROUP BY source_ip HAVING max(ts) > {NOW} - INTERVAL 24 HOUR
   UNION ALL SELECT 'user', "user", {O.secs('max(ts)')} FROM ev WHERE "user" IS NOT NULL GROUP BY "user" HAVING max(ts) > {NOW} - INTERVAL 24 HOUR
   UNION ALL SELECT 'service', split_part(source, '_', 1), {O.secs('max(ts)')} FROM ev GROUP BY 2 HAVING max(ts) > {NOW} - INTERVAL 24 HOUR
   UNION ALL SELECT 'sample', CAST(id AS VARCHAR), {O.secs('ts')} FROM ev WHERE ts > {NOW} - INTERVAL 48 HOUR"""))
def retain_tracking(spark, sf):
    from palisade.operators.parse import event_fields

    events = event_fields(fx.events(spark, sf))
    kinds = {"ip": "source_ip", "user": "username", "service": "service"}
    parts = [
        Q.retain_active_keys(events, c, AS_OF).select(F.lit(k).alias("kind"), F.col(c).alias("key"), secs("last_ts").alias("last_s"))
        for k, c in kinds.items()
    ]
    samples = Q.retain_since(events, 48, AS_OF).select(
        F.lit("sample").alias("kind"), F.col("id").cast("string").alias("key"), secs("ts").alias("last_s"))
    out = samples
    for part in parts:
        out = out.unionByName(part)
    return out


@query("time_range", " UNION ALL ".join(
    f"SELECT '{n}' AS range_name, CAST(count(*) AS BIGINT) AS events FROM (SELECT ts FROM events WHERE ts >= {NOW} - INTERVAL {h} HOUR AND ts <= {NOW})"
    for n, h in [("1h", 1), ("24h", 24), ("7d", 168), ("30d", 720), ("other", 24)]))
def time_range(spark, sf):
    events = fx.table(spark, sf, "events").select("ts")
    counts = [
        Q.time_range(events, n, AS_OF).agg(F.count("*").alias("events")).select(F.lit(n).alias("range_name"), "events")
        for n in ("1h", "24h", "7d", "30d", "other")
    ]
    out = counts[0]
    for part in counts[1:]:
        out = out.unionByName(part)
    return out


@query("severity_gate", al("""SELECT id, true AS all_gate, severity IN ('Warning', 'Critical') AS warning_gate, severity = 'Critical' AS critical_gate,
   severity IN ('Warning', 'High', 'Critical') AS console_warning FROM alerts"""))
def severity_gate(spark, sf):
    s = F.col("severity")
    return fx.alerts(spark, sf).select(
        "id", Q.severity_gate(s, "All").alias("all_gate"), Q.severity_gate(s, "Warning").alias("warning_gate"),
        Q.severity_gate(s, "Critical").alias("critical_gate"), Q.console_gate(s, "Warning").alias("console_warning"))


@query("active_hours_gate", al("""SELECT id, hour(ts) BETWEEN 9 AND 17 AND isodow(ts) <= 5 AS office, (hour(ts) >= 22 OR hour(ts) <= 6) AS night FROM alerts"""))
def active_hours_gate(spark, sf):
    return fx.alerts(spark, sf).select(
        "id", Q.active_hours_gate(F.col("ts"), F.lit(9), F.lit(17), F.lit(True)).alias("office"),
        Q.active_hours_gate(F.col("ts"), F.lit(22), F.lit(6), F.lit(False)).alias("night"))


@query("merge_stores", ev(f"""SELECT id, {O.secs('ts')} AS ts_s, 'hot' AS store FROM ev WHERE ts >= {NOW} - INTERVAL 10 DAY
   UNION ALL SELECT id, {O.secs('ts')}, 'cold' FROM ev WHERE ts < {NOW} - INTERVAL 10 DAY"""))
def merge_stores(spark, sf):
    events = fx.events(spark, sf).select("id", "ts")
    hot = events.where(F.col("ts") >= Q.ago(F.lit(AS_OF).cast("timestamp"), days=10)).withColumn("store", F.lit("hot"))
    cold = events.where(F.col("ts") < Q.ago(F.lit(AS_OF).cast("timestamp"), days=5)).withColumn("store", F.lit("cold"))
    return Q.merge_stores(hot, cold).select("id", secs("ts").alias("ts_s"), "store")


@query("merge_stores_recent", ev(f"SELECT id, {O.secs('ts')} AS ts_s FROM ev ORDER BY ts DESC, id DESC LIMIT 300"))
def merge_stores_recent(spark, sf):
    events = fx.events(spark, sf).select("id", "ts")
    hot = events.where(F.col("ts") >= Q.ago(F.lit(AS_OF).cast("timestamp"), days=3))
    return Q.merge_stores(hot, events, limit=300).select("id", secs("ts").alias("ts_s"))
