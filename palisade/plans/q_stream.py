"""Registered queries: streams, run to the end of their input in several batches."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from palisade.plans import oracle as O
from palisade.plans.oracle import ev
from palisade.plans.q_alerts import _ENGINE, _dedup_sql, _folder
from palisade.plans.q_bruteforce import ATT, IP, SERVICE, USER
from palisade.plans.q_parse import _flat
from palisade.plans.q_payload import SQLI, XSS
from palisade.plans import q_reports  # noqa: F401  its oracles are used again here
from palisade.plans.registry import ORACLES, big, query, r6, secs
from palisade.plans.running import shared
from palisade.sources import fixtures as fx, store as W
from palisade.sources.fixtures import AS_OF
from palisade.streaming import jobs as S, rollups as R

#: Time slices that arrive one after the other.
SLICES = 3


def _in_slices(spark, table, name, start):
    """Write ``table`` in slices of equal time; after each, run ``start`` on the stream.

    The second and third run restart from the checkpoint.  The first and last
    slice are open to their side; rows without a time come with the first.
    """
    source = _folder(spark, f"{name}-in")
    table = shared(table)
    us = F.unix_micros("ts")
    ends = table.agg(F.min(us).alias("lo"), F.max(us).alias("hi")).first()
    lo, hi = ends["lo"] or 0, ends["hi"] or 0
    cuts = [lo + (hi - lo) * i // SLICES for i in range(1, SLICES)]
    slice_of = sum((F.when(us >= c, 1).otherwise(0) for c in cuts), F.lit(0))
    for i in range(SLICES):
        table.where(slice_of == i).write.mode("append").parquet(source)
        start(spark.readStream.schema(table.schema).parquet(source))


def _cut_sql(i):
    """The end of slice ``i`` of the events, as SQL in microseconds."""
    return f"(SELECT min(epoch_us(ts)) + (max(epoch_us(ts)) - min(epoch_us(ts))) * {i} // {SLICES} FROM events)"


@query("stream_parse", f"""WITH {O.events_ctes(source_type=None)} SELECT id, CASE WHEN source IN ('apache_unknown', 'ssh') THEN 0 ELSE {O.secs('ts')} END AS ts_s,
   source, severity, source_ip, event_type, {O.joined('iocs')} AS iocs, method, path, CAST(status_code AS BIGINT) AS status_code, format FROM ev""")
def stream_parse(spark, sf):
    source, out, mark = _folder(spark, "lines-in"), _folder(spark, "events-out"), _folder(spark, "mark")
    lines = shared(fx.log_lines(spark, sf, known_origin=False))
    for part in range(2):
        lines.where(F.col("id") % 2 == part).select(F.concat_ws(" ", F.lit("#"), "id", F.lit("#"), "line")).write.mode("append").text(source)
        live = S.read_lines(spark, source)
        # the test lines carry their key in front
        live = live.select(
            F.regexp_extract("line", r"^# (\d+) # ", 1).cast("long").alias("id"),
            F.regexp_replace("line", r"^# \d+ # ", "").alias("line"), "ingest_ts")
        S.stream_parse(live, out, mark)
    stored = W.read_events(spark, out)
    flat = _flat(stored, "method", "path", "status_code", "format")
    # lines without a full date take theirs from the file, which is new each run
    dated = ~F.col("source").isin("apache_unknown", "ssh")
    return flat.withColumn("ts_s", F.when(dated, F.col("ts_s")).otherwise(F.lit(0).cast("long")))


@query("stream_detect", ev("""SELECT 'detection' AS kind, CAST(count(*) AS BIGINT) AS n, CAST(count_if(s.conf >= 0.3) AS BIGINT) AS sqli, CAST(count_if(x.conf >= 0.25) AS BIGINT) AS xss, CAST(sum(s.id) AS BIGINT) AS ids FROM sq3 s JOIN xs5 x ON s.id = x.id
   UNION ALL SELECT 'alert', CAST(count(*) AS BIGINT), 0::BIGINT, 0::BIGINT, CAST(sum(s.id) AS BIGINT) FROM sq3 s JOIN xs5 x ON s.id = x.id WHERE s.conf >= 0.3 OR x.conf >= 0.25""", f"{SQLI}, {XSS}"))
def stream_detect(spark, sf):
    found, raised, mark = _folder(spark, "detections"), _folder(spark, "alerts"), _folder(spark, "mark")
    _in_slices(spark, fx.events(spark, sf), "detect", lambda live: S.stream_detect(live, found, raised, mark))
    detections = spark.read.parquet(found).agg(
        F.count("*").alias("n"), F.count_if("sqli.detected").alias("sqli"), F.count_if("xss.detected").alias("xss"), F.sum("id").alias("ids"))
    alerts = spark.read.parquet(raised).agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("sqli"), F.lit(0).cast("long").alias("xss"), F.sum("id").alias("ids"))
    return detections.select(F.lit("detection").alias("kind"), "*").unionByName(alerts.select(F.lit("alert").alias("kind"), "*"))


@query("stream_bruteforce", ev("""SELECT id, source_ip, CAST(ip_total AS BIGINT) AS ip_total, CAST(ip_failed AS BIGINT) AS ip_failed, CAST(ip_services AS BIGINT) AS ip_services,
   CAST(ip_agents AS BIGINT) AS ip_agents, CAST(ip_users AS BIGINT) AS ip_users, ip_failed >= 10 AS blocked FROM iph""", f"{ATT}, {IP}"))
def stream_bruteforce(spark, sf):
    out, mark = _folder(spark, "history"), _folder(spark, "mark")
    _in_slices(spark, fx.events(spark, sf), "bruteforce", lambda live: S.stream_bruteforce(live, out, mark))
    return spark.read.parquet(out)


@query("stream_users", ev("SELECT id, username, CAST(user_total AS BIGINT) AS user_total, CAST(user_failed AS BIGINT) AS user_failed, CAST(user_ips AS BIGINT) AS user_ips, user_compromised FROM uh", f"{ATT}, {USER}"))
def stream_users(spark, sf):
    out, mark = _folder(spark, "users"), _folder(spark, "mark")
    _in_slices(spark, fx.events(spark, sf), "users", lambda live: S.stream_users(live, out, mark))
    return spark.read.parquet(out)


@query("stream_services", ev("SELECT id, service, CAST(service_total AS BIGINT) AS service_total, service_ips, service_users, CAST(service_peak AS BIGINT) AS service_peak FROM sh", f"{ATT}, {SERVICE}"))
def stream_services(spark, sf):
    out, mark = _folder(spark, "services"), _folder(spark, "mark")
    _in_slices(spark, fx.events(spark, sf), "services", lambda live: S.stream_services(live, out, mark))
    return spark.read.parquet(out)


@query("stream_detect_all", ev("SELECT id, sqli, xss, brute, sqli OR xss OR brute AS has_threats, round(risk, 6) AS risk_score FROM risk", _ENGINE))
def stream_detect_all(spark, sf):
    """Live detection with the histories of addresses, services and users: what ``detect_all`` finds in the whole table."""
    found, raised, mark = _folder(spark, "detections"), _folder(spark, "alerts"), _folder(spark, "mark")
    _in_slices(spark, fx.events(spark, sf), "detect", lambda live: S.stream_detect(live, found, raised, mark, brute_force=True))
    return spark.read.parquet(found).select(
        "id", F.col("sqli.detected").alias("sqli"), F.col("xss.detected").alias("xss"),
        F.coalesce("brute_force.detected", F.lit(False)).alias("brute"), "has_threats", r6("risk_score").alias("risk_score"))


@query("stream_dedup", _dedup_sql(300))
def stream_dedup(spark, sf):
    out, mark = _folder(spark, "kept"), _folder(spark, "mark")
    _in_slices(spark, fx.alerts(spark, sf), "dedup", lambda live: S.stream_dedup(live, out, mark, minutes=300))
    return spark.read.parquet(out).select("id")


@query("stream_rates", ev(f"SELECT {O.secs('h')} AS starts_s, event_type, CAST(count(*) AS BIGINT) AS n FROM (SELECT date_trunc('hour', ts) AS h, event_type FROM ev) GROUP BY 1, 2"))
def stream_rates(spark, sf):
    out, mark = _folder(spark, "rates"), _folder(spark, "mark")
    _in_slices(spark, fx.events(spark, sf).select("ts", "event_type"), "rates", lambda live: S.stream_rates(live, out, mark))
    return S.latest_rates(spark, out).select(secs("starts_at").alias("starts_s"), "event_type", "n")


def _rollup(spark, sf, name):
    """Cells kept by a stream over three runs; the last third of the day comes late, after the rest of all days."""
    out, mark, source, store = (_folder(spark, f"{name}-{part}") for part in ("cells", "mark", "in", "store"))
    W.write_events(fx.events(spark, sf), store)
    events = W.read_events(spark, store)
    for late in (False, True):
        events.where((F.hour("ts") >= 16) == late).write.mode("append").parquet(source)
        R.stream_rollup(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(source), out, mark, fold_every=3)
    return R.Rollup(R.rollup_table(spark, out).read(), events)


@query("dashboard_rollup", ORACLES["dashboard_stats"])
def dashboard_rollup(spark, sf):
    """The dashboard's figures from the cells that a stream keeps."""
    stats = _rollup(spark, sf, "dashboard").dashboard_stats(fx.alerts(spark, sf), fx.acks(spark, sf), AS_OF)
    return stats.withColumns({"events_per_second": r6("events_per_second"), "threat_score": r6("threat_score")})


@query("trends_rollup", ORACLES["threat_trends"])
def trends_rollup(spark, sf):
    out = _rollup(spark, sf, "trends").threat_trends("30d", AS_OF)
    return out.withColumn("starts_s", secs("starts_at")).drop("starts_at")


@query("timeline_rollup", ORACLES["hourly_timeline"])
def timeline_rollup(spark, sf):
    return _rollup(spark, sf, "timeline").hourly_timeline()


def _idle_sql(i):
    """Keys that are idle for a day, and 15 minutes for late rows, at the end of slice ``i``."""
    seen = f"(SELECT * FROM events WHERE epoch_us(ts) < {_cut_sql(i)})" if i < SLICES else "events"
    return f"""SELECT CAST(user_id AS VARCHAR) AS key, {O.secs('max(ts)')} AS last_s FROM {seen} e GROUP BY user_id
   HAVING max(ts) <= (SELECT max(ts) FROM {seen} e) - INTERVAL 24 HOUR - INTERVAL 15 MINUTE"""


@query("stream_retention", " UNION ".join(_idle_sql(i) for i in range(1, SLICES + 1)))
def stream_retention(spark, sf):
    out, mark = _folder(spark, "idle"), _folder(spark, "mark")
    rows = fx.table(spark, sf, "events").select("ts", "user_id")
    _in_slices(spark, rows, "retention", lambda live: S.stream_retention(live, "user_id", out, mark))
    idle = spark.read.schema("key string, us long").parquet(out)
    return idle.select("key", F.floor(F.col("us") / 1_000_000).cast("long").alias("last_s"))


@query("stream_cleanup", ev(f"SELECT id, {O.secs('ts')} AS ts_s FROM ev WHERE CAST(ts AS DATE) >= (SELECT CAST(max(ts) AS DATE) FROM ev) - 7"))
def stream_cleanup(spark, sf):
    """What is left of a store once a stream over the same events has removed the days that grew too old."""
    store, mark = _folder(spark, "store"), _folder(spark, "mark")
    W.write_events(fx.events(spark, sf), store)
    _in_slices(spark, W.read_events(spark, store).select("id", "ts"), "cleanup", lambda live: S.stream_cleanup(live, store, mark, 7))
    return W.read_events(spark, store).select("id", secs("ts").alias("ts_s"))
