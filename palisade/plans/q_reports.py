"""Registered queries: statistics and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from palisade.functions.dimensions import COUNTRIES, GEO_PREFIXES
from palisade.operators import query as Q, reports as S
from palisade.plans import oracle as O
from palisade.plans.oracle import ALERT_CTES, NOW, al, ev
from palisade.plans.registry import big, joined, query, r6, secs
from palisade.sources import fixtures as fx
from palisade.sources.fixtures import AS_OF
from palisade.schema import EVENT_TYPE_LABELS

COUNTRY = "CASE " + " ".join(f"WHEN starts_with(source_ip, '{p}') THEN '{c}'" for p, c in GEO_PREFIXES) + " ELSE 'Unknown' END"


def pairs(col, key="severity"):
    """A map as 'k=v' text in key order."""
    return joined(F.transform(F.array_sort(F.map_entries(col)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))))


@query("events_by_severity", ev("SELECT severity, CAST(count(*) AS BIGINT) AS events FROM ev GROUP BY 1"))
def events_by_severity(spark, sf):
    return S.events_by_severity(fx.events(spark, sf))


@query("events_by_source", ev("SELECT source, CAST(count(*) AS BIGINT) AS events FROM ev GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"))
def events_by_source(spark, sf):
    return S.events_by_source(fx.events(spark, sf))


_SCORE = "CASE WHEN n = 0 THEN 1.0 WHEN n <= 5 THEN 3.0 + 0.5 * n ELSE 6.0 + least(0.3 * (n - 5), 4.0) END"
_RECENT_OPEN = f"(SELECT count(*) AS n FROM alerts WHERE ts > {NOW} - INTERVAL 24 HOUR AND id NOT IN (SELECT alert_id FROM acks))"


@query("dashboard_stats", f"""WITH {O._EV}, {ALERT_CTES}
 SELECT CAST((SELECT count(*) FROM ev) AS BIGINT) AS total_events,
   round((SELECT count(*) FROM ev WHERE ts > {NOW} - INTERVAL 1 HOUR) / 3600.0, 6)::DOUBLE AS events_per_second,
   CAST((SELECT count(DISTINCT source) FROM ev WHERE ts > {NOW} - INTERVAL 24 HOUR) AS BIGINT) AS active_sources,
   CAST((SELECT count(*) FROM alerts) AS BIGINT) AS total_alerts, CAST((SELECT count(*) FROM acks) AS BIGINT) AS acknowledged_alerts,
   CAST((SELECT count(*) FROM alerts WHERE severity = 'Critical' AND id NOT IN (SELECT alert_id FROM acks)) AS BIGINT) AS critical_alerts,
   (SELECT CAST({_SCORE} AS DOUBLE) FROM {_RECENT_OPEN}) AS threat_score""")
def dashboard_stats(spark, sf):
    stats = S.dashboard_stats(fx.events(spark, sf), fx.alerts(spark, sf), fx.acks(spark, sf), AS_OF)
    return stats.withColumns({"events_per_second": r6("events_per_second"), "threat_score": r6("threat_score")})


@query("threat_score", f"""WITH {ALERT_CTES}, hours AS (SELECT date_trunc('hour', ts) AS h, CAST(count(*) AS BIGINT) AS n FROM alerts
   WHERE id NOT IN (SELECT alert_id FROM acks) GROUP BY 1)
   SELECT {O.secs('h')} AS hour_s, n, round(CAST({_SCORE} AS DOUBLE), 6) AS threat_score FROM hours""")
def threat_score(spark, sf):
    open_alerts = Q.active_alerts(fx.alerts(spark, sf), fx.acks(spark, sf))
    hours = open_alerts.groupBy(F.date_trunc("hour", "ts").alias("h")).agg(F.count("*").alias("n"))
    return hours.select(secs("h").alias("hour_s"), "n", r6(S.threat_score(F.col("n"))).alias("threat_score"))


_LABELS = "CASE event_type " + " ".join(f"WHEN '{t}' THEN '{n}'" for t, n in EVENT_TYPE_LABELS.items()) + " END"


@query("events_by_type", ev(f"""SELECT event_type, {_LABELS} AS label, CAST(count(*) AS BIGINT) AS events,
   round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM ev), 6) AS percentage FROM ev GROUP BY 1"""))
def events_by_type(spark, sf):
    return S.events_by_type(fx.events(spark, sf)).withColumn("percentage", r6("percentage"))


def _trend_sql(hours, width):
    n = hours // width
    kinds = [("sql_injection", "SqlInjection"), ("xss", "XssAttempt"), ("brute_force", "BruteForce"), ("anomaly", "Anomaly")]
    cols = ", ".join(f"CAST(coalesce(count_if(e.event_type = '{t}'), 0) AS BIGINT) AS {k}" for k, t in kinds)
    return ev(f"""SELECT CAST(b AS BIGINT) AS bucket, {O.secs('lo')} AS starts_s, {cols}
      FROM (SELECT b, {NOW} - INTERVAL {hours} HOUR + to_hours(CAST(b * {width} AS INTEGER)) AS lo FROM range({n}) t(b)) g
      LEFT JOIN ev e ON e.ts >= g.lo AND e.ts < g.lo + INTERVAL {width} HOUR GROUP BY b, lo""")


@query("threat_trends", _trend_sql(720, 30))
def threat_trends(spark, sf):
    out = S.threat_trends(fx.events(spark, sf), "30d", AS_OF)
    return out.withColumn("starts_s", secs("starts_at")).drop("starts_at")


@query("threat_trends_day", _trend_sql(24, 1))
def threat_trends_day(spark, sf):
    out = S.threat_trends(fx.events(spark, sf), "24h", AS_OF)
    return out.withColumn("starts_s", secs("starts_at")).drop("starts_at")


_PLACES = "(VALUES " + ", ".join(
    f"('{c}', '{k}', '{n}', {lat if lat is not None else 'NULL'}, {lon if lon is not None else 'NULL'})" for c, k, n, lat, lon in COUNTRIES
) + ") p(country, country_code, country_name, lat, lon)"


@query("geo_heatmap", ev(f"""SELECT g.country, p.country_code, p.country_name, CAST(p.lat AS DOUBLE) AS lat, CAST(p.lon AS DOUBLE) AS lon, n AS threat_count,
   CASE WHEN n > (SELECT max(n) FROM g) // 2 THEN 'High' WHEN n > (SELECT max(n) FROM g) // 4 THEN 'Medium' ELSE 'Low' END AS threat_level
   FROM g JOIN {_PLACES} ON g.country = p.country""",
   f"g AS (SELECT {COUNTRY} AS country, CAST(count(*) AS BIGINT) AS n FROM ev WHERE source_ip IS NOT NULL GROUP BY 1)"))
def geo_heatmap(spark, sf):
    return S.geo_heatmap(fx.events(spark, sf))


@query("hourly_timeline", ev("""SELECT h.hour, coalesce(total, 0) AS total_events, coalesce(critical, 0) AS critical_events, coalesce(ml, 0) AS ml_detected,
   coalesce(total, 0) > (SELECT max(total) FROM c) // 2 AS is_peak FROM (SELECT CAST(range AS BIGINT) AS hour FROM range(24)) h LEFT JOIN c ON c.hour = h.hour""",
   """c AS (SELECT CAST(hour(ts) AS BIGINT) AS hour, CAST(count(*) AS BIGINT) AS total, CAST(count_if(severity = 'Critical') AS BIGINT) AS critical,
       CAST(count_if(event_type = 'Anomaly') AS BIGINT) AS ml FROM ev GROUP BY 1)"""))
def hourly_timeline(spark, sf):
    return S.hourly_timeline(fx.events(spark, sf))


@query("top_threat_sources", ev(f"""SELECT source_ip, {COUNTRY} AS country, n AS threat_count,
   (SELECT array_to_string(list(severity || '=' || CAST(k AS VARCHAR) ORDER BY severity), '|') FROM s WHERE s.source_ip = t.source_ip) AS severity_distribution,
   (SELECT array_to_string(list(DISTINCT event_type ORDER BY event_type), '|') FROM ev e WHERE e.source_ip = t.source_ip) AS attack_types,
   round(log10(n) * 2, 6) AS risk_score FROM t ORDER BY n DESC, source_ip LIMIT 10""",
   """s AS (SELECT source_ip, severity, count(*) AS k FROM ev WHERE source_ip IS NOT NULL GROUP BY 1, 2),
      t AS (SELECT source_ip, CAST(count(*) AS BIGINT) AS n FROM ev WHERE source_ip IS NOT NULL GROUP BY 1)"""))
def top_threat_sources(spark, sf):
    return S.top_threat_sources(fx.events(spark, sf)).select(
        "source_ip", "country", "threat_count", pairs("severity_distribution").alias("severity_distribution"),
        joined("attack_types").alias("attack_types"), r6("risk_score").alias("risk_score"))


@query("detection_efficiency", ev("""SELECT CAST(count(*) AS BIGINT) AS total_events, CAST(count_if(severity = 'Critical') AS BIGINT) AS threats_detected,
   round(count_if(severity = 'Critical') * 100.0::DOUBLE / count(*), 6) AS detection_rate, round(count_if(event_type = 'Anomaly') * 100.0::DOUBLE / count(*), 6) AS ml_contribution,
   round(count_if(event_type <> 'Anomaly') * 100.0::DOUBLE / count(*), 6) AS rule_based_contribution FROM ev"""))
def detection_efficiency(spark, sf):
    out = S.detection_efficiency(fx.events(spark, sf))
    return out.withColumns({c: r6(c) for c in ("detection_rate", "ml_contribution", "rule_based_contribution")})


@query("report_bundle", ev(f"""SELECT 'events_by_type' AS report, event_type AS item, CAST(count(*) AS BIGINT) AS n FROM w GROUP BY 2
   UNION ALL SELECT 'geo_heatmap', {COUNTRY}, CAST(count(*) AS BIGINT) FROM w WHERE source_ip IS NOT NULL GROUP BY 2
   UNION ALL SELECT 'hourly_timeline', CAST(h AS VARCHAR), CAST(count(w.id) AS BIGINT) FROM range(24) r(h) LEFT JOIN w ON hour(w.ts) = h GROUP BY 2
   UNION ALL SELECT 'top_threat_sources', source_ip, n FROM (SELECT source_ip, CAST(count(*) AS BIGINT) AS n FROM w WHERE source_ip IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)
   UNION ALL SELECT 'threat_trends', CAST(b AS VARCHAR), CAST(coalesce(count_if(event_type = 'SqlInjection'), 0) AS BIGINT) FROM range(24) r(b)
      LEFT JOIN w ON w.ts >= {NOW} - INTERVAL 168 HOUR + to_hours(CAST(b * 7 AS INTEGER)) AND w.ts < {NOW} - INTERVAL 168 HOUR + to_hours(CAST(b * 7 + 7 AS INTEGER)) GROUP BY 2
   UNION ALL SELECT 'detection_efficiency', 'total', CAST(count(*) AS BIGINT) FROM w""",
   f"w AS (SELECT * FROM ev WHERE ts >= {NOW} - INTERVAL 7 DAY AND ts <= {NOW} AND source = 'apache')"))
def report_bundle(spark, sf):
    reports = S.report_bundle(fx.events(spark, sf), "7d", AS_OF, source="apache")
    picks = {
        "events_by_type": ("event_type", "events"), "geo_heatmap": ("country", "threat_count"),
        "hourly_timeline": ("hour", "total_events"), "top_threat_sources": ("source_ip", "threat_count"),
        "threat_trends": ("bucket", "sql_injection"),
    }
    out = reports["detection_efficiency"].select(
        F.lit("detection_efficiency").alias("report"), F.lit("total").alias("item"), big("total_events").alias("n"))
    for name, (item, n) in picks.items():
        out = out.unionByName(reports[name].select(F.lit(name).alias("report"), F.col(item).cast("string").alias("item"), big(n).alias("n")))
    return out


@query("channel_statistics", al(f"""SELECT channel, CAST(count_if(success) AS BIGINT) AS sent, CAST(count_if(NOT success) AS BIGINT) AS failed,
   {O.secs('max(ts) FILTER (WHERE success)')} AS last_success_s, {O.secs('max(ts) FILTER (WHERE NOT success)')} AS last_failure_s,
   round(avg(response_ms), 6) AS mean_response_ms,
   (SELECT array_to_string(list(severity || '=' || CAST(k AS VARCHAR) ORDER BY severity), '|') FROM (SELECT severity, count_if(success) AS k FROM deliveries x WHERE x.channel = d.channel GROUP BY 1)) AS sent_by_severity
   FROM deliveries d GROUP BY channel"""))
def channel_statistics(spark, sf):
    out = S.channel_statistics(fx.deliveries(spark, sf))
    return out.select("channel", "sent", "failed", secs("last_success").alias("last_success_s"), secs("last_failure").alias("last_failure_s"),
                      r6("mean_response_ms").alias("mean_response_ms"), pairs("sent_by_severity").alias("sent_by_severity"))


@query("endpoint_statistics", al("""SELECT endpoint, CAST(count(*) AS BIGINT) AS requests, CAST(count_if(NOT success) AS BIGINT) AS failures, round(avg(response_ms), 6) AS mean_response_ms,
   CAST(count_if(NOT success AND (ts, alert_id) > (SELECT (ts, alert_id) FROM deliveries o WHERE o.endpoint = d.endpoint AND success ORDER BY ts DESC, alert_id DESC LIMIT 1)) AS BIGINT) AS consecutive_failures
   FROM deliveries d GROUP BY endpoint"""))
def endpoint_statistics(spark, sf):
    return S.endpoint_statistics(fx.deliveries(spark, sf)).withColumn("mean_response_ms", r6("mean_response_ms"))
