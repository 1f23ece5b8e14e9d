"""Registered queries: alert pipeline, sources and sinks, engine."""

from __future__ import annotations


from pyspark.sql import functions as F

from palisade.functions import dimensions as D, rules as R
from palisade.operators import alerts as A, engine as E, enrich as N, query as Q, reports as S
from palisade.operators.bruteforce import bf_patterns, ip_block_state, attempts
from palisade.operators.payload import detection_text, sqli_detect, xss_detect
from palisade.plans import oracle as O
from palisade.plans.oracle import ALERT_CTES, NOW, al, ev, q
from palisade.plans.q_bruteforce import ATT, DETECT, HITS, _BLOCKS
from palisade.plans.q_enrich import _ROUTE
from palisade.plans.q_payload import SQLI, XSS
from palisade.plans.q_reports import pairs
from palisade.plans.registry import big, joined, query, r6, secs
from palisade.session import scratch_folder, truncate_lineage
from palisade.sources import fixtures as fx, store as W
from palisade.sources.fixtures import AS_OF

J = O.joined


_folder = scratch_folder


# --- alert pipeline ---------------------------------------------------------

_DEDUP = """RECURSIVE keyed AS (SELECT id, ts, title || ':' || severity AS k FROM alerts),
   kept(k, ts) AS (SELECT k, min(ts) FROM keyed GROUP BY k
     UNION ALL SELECT c.k, (SELECT min(x.ts) FROM keyed x WHERE x.k = c.k AND x.ts >= c.ts + INTERVAL {m} MINUTE) FROM kept c
       WHERE EXISTS (SELECT 1 FROM keyed x WHERE x.k = c.k AND x.ts >= c.ts + INTERVAL {m} MINUTE))"""


def _dedup_sql(minutes):
    body = _DEDUP.format(m=minutes).replace("RECURSIVE ", "")
    return f"WITH RECURSIVE {ALERT_CTES}, {body} SELECT min(id) AS id FROM keyed JOIN kept USING (k, ts) GROUP BY k, ts"


@query("alert_dedup", _dedup_sql(30))
def alert_dedup(spark, sf):
    return A.alert_dedup(fx.alerts(spark, sf)).select("id")


@query("alert_dedup_long_window", _dedup_sql(2000))
def alert_dedup_long_window(spark, sf):
    return A.alert_dedup(fx.alerts(spark, sf), minutes=2000).select("id")


@query("alert_priority", al("SELECT id, CASE WHEN severity IN ('Low', 'Info') THEN 'Low' WHEN severity IN ('Medium', 'Warning') THEN 'Normal' WHEN severity = 'High' THEN 'High' ELSE 'Emergency' END AS priority FROM alerts"))
def alert_priority(spark, sf):
    return fx.alerts(spark, sf).select("id", A.alert_priority(F.col("severity")).alias("priority"))


_BATCH = """bat AS (SELECT id, ts, severity, title, CASE WHEN severity <> 'Critical' THEN severity || '/' || CAST(w AS VARCHAR) || '/' || CAST((row_number() OVER (PARTITION BY severity, w ORDER BY ts, id) - 1) // {n} AS VARCHAR) END AS batch_id
   FROM (SELECT *, CAST(floor(epoch_us(ts) / 1000000 / {s}) * {s} AS BIGINT) AS w FROM alerts))"""


@query("alert_batch", al("SELECT id, batch_id FROM bat", _BATCH.format(n=20, s=600)))
def alert_batch(spark, sf):
    return A.alert_batch(fx.alerts(spark, sf)).select("id", "batch_id")


@query("alert_batch_day", al("SELECT id, batch_id FROM bat", _BATCH.format(n=5, s=86400)))
def alert_batch_day(spark, sf):
    return A.alert_batch(fx.alerts(spark, sf), minutes=1440, size=5).select("id", "batch_id")


@query("alert_summary", al("""SELECT batch_id, CAST(count(*) AS BIGINT) AS alerts, any_value(severity) || '=' || CAST(count(*) AS VARCHAR) AS by_severity,
   array_to_string(list(title ORDER BY ts DESC, id DESC)[1:5], '|') AS latest, CAST(greatest(count(*) - 5, 0) AS BIGINT) AS more FROM bat WHERE batch_id IS NOT NULL GROUP BY batch_id""", _BATCH.format(n=20, s=86400)))
def alert_summary(spark, sf):
    out = A.alert_summary(A.alert_batch(fx.alerts(spark, sf), minutes=1440))
    return out.select("batch_id", "alerts", pairs("by_severity").alias("by_severity"), joined("latest").alias("latest"), big("more").alias("more"))


@query("alert_deliveries", al("""SELECT id, 'normal' AS mode, channel, CAST(position AS BIGINT) AS position FROM route
   UNION ALL SELECT id, 'emergency', c, CAST(p AS BIGINT) FROM alerts, (VALUES ('console', 0), ('email', 1), ('webhook', 2)) v(c, p)""", _ROUTE))
def alert_deliveries(spark, sf):
    every = ["console", "email", "webhook"]
    routed = N.alert_route(fx.alerts(spark, sf), D.routing(spark), every)
    normal = A.alert_deliveries(routed, every).withColumn("mode", F.lit("normal"))
    urgent = A.alert_deliveries(routed, every, emergency=True).withColumn("mode", F.lit("emergency"))
    return normal.unionByName(urgent).select("id", "mode", "channel", big("position").alias("position"))


@query("rate_limit", al("""SELECT alert_id, channel FROM (SELECT *, row_number() OVER (PARTITION BY channel, CASE channel WHEN 'email' THEN date_trunc('hour', ts) ELSE date_trunc('minute', ts) END ORDER BY ts, alert_id) AS n FROM deliveries
   WHERE channel IN ('email', 'webhook')) WHERE n <= CASE channel WHEN 'email' THEN 2 ELSE 1 END"""))
def rate_limit(spark, sf):
    sent = fx.deliveries(spark, sf)
    mail = A.rate_limit(sent, "email", 2, "1 hour")
    return mail.unionByName(A.rate_limit(sent, "webhook", 1, "1 minute")).select("alert_id", "channel")


_RETRY = """ret AS (SELECT *, CAST(least(3600, 30 * pow(2, attempt - 1)) AS BIGINT) AS delay FROM deliveries WHERE NOT success AND status NOT IN (400, 401, 403, 404, 422) AND attempt <= 3)"""


@query("retry_schedule", al(f"SELECT alert_id, channel, delay AS delay_seconds, {O.secs('ts')} + delay AS next_s FROM ret", _RETRY))
def retry_schedule(spark, sf):
    out = A.retry_schedule(fx.deliveries(spark, sf))
    return out.select("alert_id", "channel", "delay_seconds", secs("next_retry").alias("next_s"))


@query("retry_queue_status", al(f"SELECT endpoint, CAST(count(*) AS BIGINT) AS pending, min({O.secs('ts')} + delay) AS next_s FROM ret WHERE ts + to_seconds(delay) > TIMESTAMP '2024-01-20' GROUP BY endpoint", _RETRY))
def retry_queue_status(spark, sf):
    later = A.retry_schedule(fx.deliveries(spark, sf)).where(F.col("next_retry") > F.lit("2024-01-20").cast("timestamp"))
    return S.retry_queue_status(later).select("endpoint", "pending", secs("next_retry").alias("next_s"))


@query("alert_activity", al(f"""SELECT 'total' AS measure, 'all' AS name, CAST(count(*) AS BIGINT) AS n FROM alerts WHERE ts > {NOW} - INTERVAL 72 HOUR
   UNION ALL SELECT 'severity', severity, CAST(count(*) AS BIGINT) FROM alerts WHERE ts > {NOW} - INTERVAL 72 HOUR GROUP BY severity
   UNION ALL SELECT 'channel', channel, CAST(count(*) AS BIGINT) FROM route WHERE ts > {NOW} - INTERVAL 72 HOUR GROUP BY channel
   UNION ALL SELECT 'latest', title, id FROM (SELECT title, id FROM alerts ORDER BY ts DESC, id DESC LIMIT 10)""", _ROUTE))
def alert_activity(spark, sf):
    alerts = fx.alerts(spark, sf)
    routed = N.alert_route(alerts, D.routing(spark), ["console", "email", "webhook"])
    latest = S.latest_alerts(alerts, 72, AS_OF).select(F.lit("latest").alias("measure"), F.col("title").alias("name"), F.col("id").alias("n"))
    return S.alert_activity(alerts, routed, 72, AS_OF).unionByName(latest)


_PAYLOAD_SQL = """SELECT id, 'standard' AS endpoint, 'security_alert|' || CAST(id AS VARCHAR) || '|' || severity || '|' || title || '|palisade' AS content, true AS valid FROM alerts
   UNION ALL SELECT id, 'json', title || '|' || severity || '|' || CAST(id AS VARCHAR), true FROM alerts
   UNION ALL SELECT id, 'text', 'ALERT ' || title || ' at ' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ'), true FROM alerts"""


@query("alert_payload", al(_PAYLOAD_SQL))
def alert_payload(spark, sf):
    hooks = spark.createDataFrame(
        [("standard", True, "All", [], None), ("json", True, "All", [], '{"t": "{{alert.title}}", "s": "{{alert.severity}}", "i": {{alert.id}}}'),
         ("text", True, "All", [], "ALERT {{alert.title}} at {{timestamp}}")],
        "endpoint string, enabled boolean, severity_filter string, alert_types array<string>, template string")
    v, part = F.col("value"), lambda p: F.get_json_object("value", p)
    content = (
        F.when(F.col("endpoint") == "standard", F.concat_ws("|", part("$.event_type"), part("$.alert.id"), part("$.alert.severity"), part("$.alert.title"), part("$.metadata.source")))
        .when(F.col("endpoint") == "json", F.concat_ws("|", part("$.t"), part("$.s"), part("$.i"))).otherwise(part("$.message"))
    )
    return A.alert_payload(N.alert_endpoints(fx.alerts(spark, sf), hooks)).select("id", "endpoint", content.alias("content"), F.expr("try_parse_json(value) IS NOT NULL").alias("valid"))


# --- sources and sinks ------------------------------------------------------

@query("scan_log_lines", f"SELECT line FROM ({fx.LOG_LINES})")
def scan_log_lines(spark, sf):
    path = _folder(spark, "lines")
    fx.log_lines(spark, sf).select("line").write.text(path)
    return W.scan_log_lines(spark, path).select("line")


@query("file_format_vote", f"""WITH l AS (SELECT event_id, event_id % 7 AS site, {O.detect_format('line')} AS f, row_number() OVER (PARTITION BY event_id % 7 ORDER BY event_id) AS n FROM ({fx.LOG_LINES})),
   v AS (SELECT site, f, count(*) AS votes FROM l WHERE n <= 10 GROUP BY 1, 2)
   SELECT CAST(site AS VARCHAR) AS site, first(f ORDER BY votes DESC, f) AS format FROM v GROUP BY site""")
def file_format_vote(spark, sf):
    path = _folder(spark, "sites")
    lines = fx.log_lines(spark, sf).withColumn("site", F.col("id") % 7)
    lines.repartition("site").sortWithinPartitions("site", "id").select("site", F.col("line").alias("value")).write.partitionBy("site").text(path)
    votes = W.file_format_vote(spark, path + "/*/*.txt")
    return votes.select(F.regexp_extract("file", r"site=(\d+)/", 1).alias("site"), "format")


@query("write_events", ev("SELECT strftime(ts, '%Y-%m-%d') AS day, severity, CAST(count(*) AS BIGINT) AS n, CAST(sum(status_code) AS BIGINT) AS statuses FROM ev GROUP BY 1, 2"))
def write_events(spark, sf):
    path = _folder(spark, "events")
    W.write_events(fx.events(spark, sf), path)
    stored = W.read_events(spark, path)
    return stored.groupBy(F.date_format("event_date", "yyyy-MM-dd").alias("day"), "severity").agg(
        F.count("*").alias("n"), big(F.sum("parsed.status_code")).alias("statuses"))


@query("write_alerts", al("SELECT strftime(ts, '%Y-%m-%d') AS day, severity, CAST(count(*) AS BIGINT) AS n FROM alerts GROUP BY 1, 2"))
def write_alerts(spark, sf):
    path = _folder(spark, "alerts")
    W.write_alerts(fx.alerts(spark, sf), path)
    return W.read_alerts(spark, path).groupBy(F.date_format("event_date", "yyyy-MM-dd").alias("day"), "severity").agg(F.count("*").alias("n"))


@query("read_events", ev(f"SELECT id, {O.secs('ts')} AS ts_s, source, severity, source_ip, path, {J('iocs')} AS iocs FROM ev WHERE id % 11 <> 0 AND id % 13 <> 0"))
def read_events(spark, sf):
    rows = W.encode_rows(fx.events(spark, sf))
    n = F.col("id").cast("long")
    damaged = rows.withColumns({
        "severity": F.when(n % 11 == 0, "Severe").otherwise(F.col("severity")),
        "timestamp": F.when(n % 13 == 0, "yesterday").otherwise(F.col("timestamp"))})
    return W.decode_rows(damaged).select("id", secs("ts").alias("ts_s"), "source", "severity", "source_ip", F.col("parsed.path").alias("path"), joined("iocs").alias("iocs"))


@query("migrate_store", ev("SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT id) AS BIGINT) AS ids, CAST(sum(id) AS BIGINT) AS id_sum FROM ev"))
def migrate_store(spark, sf):
    old, new = _folder(spark, "old"), _folder(spark, "new")
    W.write_events(fx.events(spark, sf), old)
    source = W.read_events(spark, old)
    W.migrate_store(source.where("event_date < '2024-01-15'"), new, None)
    W.migrate_store(source, new, W.read_events(spark, new))
    W.migrate_store(source, new, W.read_events(spark, new))
    return W.read_events(spark, new).agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.sum("id").alias("id_sum"))


# --- engine -----------------------------------------------------------------

RISK = """risk AS MATERIALIZED (SELECT ev.id, ev.ts, ev.source_ip, ev.severity, s.conf >= 0.3 AS sqli, x.conf >= 0.25 AS xss, coalesce(p.conf >= 0.3 OR p.ip_total >= 10, false) AS brute,
   s.conf AS sc, x.conf AS xc, p.conf AS bc,
   (s.conf * 0.3::DOUBLE + x.conf * 0.25::DOUBLE + coalesce(p.conf * 0.25::DOUBLE, 0.0)) / (0.3::DOUBLE + 0.25::DOUBLE + CASE WHEN p.conf IS NULL THEN 0.0::DOUBLE ELSE 0.25::DOUBLE END) AS risk
   FROM ev JOIN sq3 s ON s.id = ev.id JOIN xs5 x ON x.id = ev.id LEFT JOIN pr p ON p.id = ev.id)"""
_ENGINE = f"{SQLI}, {XSS}, {DETECT}, {RISK}"


def _detections(spark, sf):
    return E.detect_all(fx.events(spark, sf))


@query("combine_risk", ev("SELECT id, round(risk, 6) AS risk_score FROM risk", _ENGINE))
def combine_risk(spark, sf):
    return _detections(spark, sf).select("id", r6("risk_score").alias("risk_score"))


@query("detect_all", ev("SELECT id, sqli, xss, brute, sqli OR xss OR brute AS has_threats, round(risk, 6) AS risk_score FROM risk", _ENGINE))
def detect_all(spark, sf):
    return _detections(spark, sf).select(
        "id", F.col("sqli.detected").alias("sqli"), F.col("xss.detected").alias("xss"),
        F.coalesce("brute_force.detected", F.lit(False)).alias("brute"), "has_threats", r6("risk_score").alias("risk_score"))


_SEV = "CASE WHEN risk >= 0.8 THEN 'Critical' WHEN risk >= 0.6 THEN 'Warning' ELSE 'Info' END"


@query("generate_alerts", ev(f"""SELECT id, 'scored' AS mode, {_SEV} AS severity, 'Security Threat Detected from ' || coalesce(source_ip, 'Unknown') AS title FROM risk WHERE (sqli OR xss OR brute) AND risk >= 0.45
   UNION ALL SELECT id, 'any', severity, 'Security Threat Detected from ' || coalesce(source_ip, 'Unknown') FROM risk WHERE sqli OR xss OR brute""", _ENGINE))
def generate_alerts(spark, sf):
    found = truncate_lineage(_detections(spark, sf))
    scored = E.generate_alerts(found, 0.45).withColumn("mode", F.lit("scored"))
    return scored.unionByName(E.generate_alerts(found, None).withColumn("mode", F.lit("any"))).select("id", "mode", "severity", "title")


_RULES = [("sqli", r) for r in R.SQLI_RULES] + [("xss", r) for r in R.XSS_RULES] + [("brute_force", r) for r in R.BRUTE_FORCE_RULES]
_RULE_ROWS = "(VALUES " + ", ".join(f"('{d}', {q(r.name)}, {q(r.attack_type)}, {q(r.scope) if r.scope else 'NULL'})" for d, r in _RULES) + ") r(detector, rule, attack_type, context)"


@query("rule_statistics", ev(f"""SELECT r.detector, r.rule, r.attack_type, r.context, CAST(count(h.rule) AS BIGINT) AS hits FROM {_RULE_ROWS} LEFT JOIN (
   SELECT 'sqli' AS detector, unnest(list_transform(hits, lambda h: h.n)) AS rule FROM sq3 UNION ALL SELECT 'xss', unnest(list_transform(hits, lambda h: h.n)) FROM xs5
   UNION ALL SELECT 'brute_force', unnest(list_transform(hits, lambda h: h.n)) FROM bt) h ON h.detector = r.detector AND h.rule = r.rule GROUP BY 1, 2, 3, 4""", f"{SQLI}, {XSS}, {HITS}"))
def rule_statistics(spark, sf):
    events = fx.events(spark, sf)
    found = bf_patterns(E.detect_payloads(events))
    named = [("sqli", "sqli.matched"), ("xss", "xss.matched"), ("brute_force", "patterns")]

    def tagged(detector, matched):
        return F.transform(matched, lambda m: F.struct(F.lit(detector).alias("detector"), m.alias("rule")))

    hits = found.select(F.explode(F.concat(*[tagged(d, c) for d, c in named])).alias("h")).select("h.*")
    rules = spark.createDataFrame([(d, r.name, r.attack_type, r.scope) for d, r in _RULES], "detector string, rule string, attack_type string, context string")
    counts = hits.groupBy("detector", "rule").agg(F.count("*").alias("hits"))
    return rules.join(counts, ["detector", "rule"], "left").select("detector", "rule", "attack_type", "context", F.coalesce("hits", F.lit(0)).alias("hits"))


@query("active_threats", f"""WITH {O._EV}, {ALERT_CTES}, {SQLI}, {XSS}, {ATT}, {_BLOCKS}
   SELECT 'active_alerts' AS measure, CAST(count(*) AS BIGINT) AS n FROM alerts WHERE id NOT IN (SELECT alert_id FROM acks)
   UNION ALL SELECT 'blocked_ips', CAST(count(*) AS BIGINT) FROM blk WHERE last_ts + INTERVAL 30 MINUTE > TIMESTAMP '2024-01-30 20:00:00'
   UNION ALL SELECT 'detections_today', CAST(count(*) AS BIGINT) FROM ev JOIN sq3 s ON s.id = ev.id JOIN xs5 x ON x.id = ev.id WHERE (s.conf >= 0.3 OR x.conf >= 0.25) AND ev.ts >= TIMESTAMP '2024-01-30' AND ev.ts <= TIMESTAMP '2024-01-30 20:00:00'
   UNION ALL SELECT 'false_positives', CAST(count(*) AS BIGINT) FROM sq3 s JOIN xs5 x ON x.id = s.id WHERE (s.conf >= 0.3 OR x.conf >= 0.25) AND s.id % 50 = 0
   UNION ALL SELECT 'type:' || event_type, CAST(count(*) AS BIGINT) FROM ev GROUP BY event_type""")
def active_threats(spark, sf):
    now = "2024-01-30 20:00:00"
    events = fx.events(spark, sf)
    found = E.detect_payloads(events).where(F.col("sqli.detected") | F.col("xss.detected")).select("id", "ts")
    marked = fx.feedback(spark, sf).select(F.col("event_id").alias("id"), F.lit(1).alias("fp"))
    day = F.to_date(F.lit(now).cast("timestamp"))
    totals = found.join(marked, "id", "left").agg(
        F.count_if((F.col("ts") >= day) & (F.col("ts") <= F.lit(now).cast("timestamp"))).alias("detections_today"),
        F.count("fp").alias("false_positives"))

    def one(df, name):
        return df.agg(F.count("*").alias("n")).select(F.lit(name).alias("measure"), "n")

    out = one(Q.active_alerts(fx.alerts(spark, sf), fx.acks(spark, sf)), "active_alerts")
    out = out.unionByName(one(ip_block_state(attempts(events), now).where("blocked"), "blocked_ips"))
    out = out.unionByName(totals.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("measure"), F.col(c).alias("n")) for c in totals.columns])).alias("m")).select("m.*"))
    return out.unionByName(events.groupBy(F.concat(F.lit("type:"), "event_type").alias("measure")).agg(F.count("*").alias("n")))
