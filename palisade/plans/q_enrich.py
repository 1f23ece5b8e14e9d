"""Registered queries: joins, enrichment and hunts."""

from __future__ import annotations

from pyspark.sql import functions as F

from palisade.functions import dimensions as D, rules as R
from palisade.operators import enrich as N, hunt as H, similar
from palisade.operators.engine import detect_payloads
from palisade.plans import oracle as O
from palisade.plans.oracle import NOW, al, ev, q, qlist
from palisade.plans.q_bruteforce import ATT
from palisade.plans.q_payload import SQLI, XSS
from palisade.plans.q_reports import COUNTRY
from palisade.plans.registry import big, joined, query, r6, secs
from palisade.session import truncate_lineage
from palisade.sources import fixtures as fx
from palisade.sources.fixtures import AS_OF

J = O.joined
_ANY = "(a.source_ip = b.source_ip OR a.source = b.source OR a.event_type = b.event_type)"
_RELATED = f"""rel AS MATERIALIZED (SELECT id, list(rid ORDER BY rts DESC, rid DESC) AS ids FROM (
   SELECT a.id, b.id AS rid, b.ts AS rts, row_number() OVER (PARTITION BY a.id ORDER BY b.ts DESC, b.id DESC) AS n
   FROM ev a JOIN ev b ON b.ts BETWEEN a.ts - INTERVAL 1 HOUR AND a.ts + INTERVAL 1 HOUR AND a.id <> b.id AND {_ANY}) WHERE n <= 10 GROUP BY id)"""


def _ids(col):
    return joined(F.transform(col, lambda r: r["id"].cast("string")))


def _slim(spark, sf):
    return truncate_lineage(fx.events(spark, sf).select("id", "ts", "source", "source_ip", "event_type"))


@query("related_events", ev("SELECT ev.id, coalesce(array_to_string(rel.ids, '|'), '') AS related FROM ev LEFT JOIN rel ON rel.id = ev.id", _RELATED))
def related_events(spark, sf):
    return N.related_events(_slim(spark, sf)).select("id", _ids("related").alias("related"))


@query("related_to_event", ev(f"SELECT b.id, {O.secs('b.ts')} AS ts_s FROM ev a JOIN ev b ON a.id = 4321 AND b.id <> a.id AND b.ts BETWEEN a.ts - INTERVAL 1 HOUR AND a.ts + INTERVAL 1 HOUR AND {_ANY} ORDER BY b.ts DESC, b.id DESC LIMIT 5"))
def related_to_event(spark, sf):
    return N.related_to(fx.events(spark, sf), 4321, 5).select("id", secs("ts").alias("ts_s"))


@query("event_details", ev("""SELECT ev.id, coalesce(array_to_string(rel.ids, '|'), '') AS related, 'Request from ' || coalesce(source_ip, 'unknown source') AS entry,
   sq3.conf >= 0.3 AS sqli_detected, xs5.conf >= 0.25 AS xss_detected FROM ev LEFT JOIN rel ON rel.id = ev.id JOIN sq3 ON sq3.id = ev.id JOIN xs5 ON xs5.id = ev.id""", f"{_RELATED}, {SQLI}, {XSS}"))
def event_details(spark, sf):
    detections = detect_payloads(fx.events(spark, sf)).select("id", F.col("sqli.detected").alias("sqli_detected"), F.col("xss.detected").alias("xss_detected"))
    out = N.event_details(_slim(spark, sf), detections)
    return out.select("id", _ids("related").alias("related"), F.get("timeline", F.lit(0))["description"].alias("entry"), "sqli_detected", "xss_detected")


def _iocs(spark):
    extra = spark.createDataFrame(
        [("x1", "Domain", "example.com"), ("x2", "Url", "/etc/passwd"), ("x3", "UserAgent", "sqlmap")], "id string, ioc_type string, value string")
    return D.indicators(spark, AS_OF).select("id", "ioc_type", "value").unionByName(extra)


_IOC_SQL = """SELECT id, list_filter([CASE WHEN source_ip = '203.0.113.45' THEN '203.0.113.45' END, CASE WHEN contains(raw_message, 'malicious-c2.example.com') THEN 'malicious-c2.example.com' END,
   CASE WHEN contains(raw_message, 'example.com') THEN 'example.com' END, CASE WHEN contains(raw_message, '/etc/passwd') THEN '/etc/passwd' END,
   CASE WHEN contains(raw_message, 'User-Agent') AND contains(raw_message, 'sqlmap') THEN 'sqlmap' END], lambda v: v IS NOT NULL) AS found FROM ev"""


@query("ioc_match", ev(f"SELECT id, {J('list_sort(found)')} AS indicators FROM ({_IOC_SQL}) WHERE len(found) > 0"))
def ioc_match(spark, sf):
    return N.ioc_match(fx.events(spark, sf), _iocs(spark)).select("id", joined("indicators").alias("indicators"))


# The user rule pack and its thresholds.
USER_RULES = [
    ("sql_words", r"(?i)(union|select|insert|update|delete|drop|create|alter)\s+", 0.7, "SqlInjection"),
    ("sql_marks", r"(?i)(\'|\"|;|--|\#|\|\|)", 0.7, "SqlInjection"),
    ("sql_logic", r"(?i)(or|and)\s+\d+\s*=\s*\d+", 0.7, "SqlInjection"),
    ("xss_tag", r"(?i)<script[^>]*>", 0.8, "XssAttempt"),
    ("xss_scheme", r"(?i)javascript:", 0.8, "XssAttempt"),
    ("xss_event", r"(?i)on(click|load|error|mouseover)\s*=", 0.8, "XssAttempt"),
]
_RULE_ROWS = "(VALUES " + ", ".join(f"({q(n)}, {q(p)}, {c}::DOUBLE, {q(t)})" for n, p, c, t in USER_RULES) + ") r(name, pattern, confidence, attack_type)"


@query("rule_match", f"""SELECT id, array_to_string(list(name ORDER BY name), '|') AS rules, max(confidence) AS confidence, array_to_string(list(DISTINCT attack_type ORDER BY attack_type), '|') AS attack_types
   FROM (SELECT event_id AS id, url_decode(line) AS t FROM ({fx.LOG_LINES}) UNION ALL SELECT -1 - page_id, html FROM pages), {_RULE_ROWS} WHERE regexp_matches(t, pattern) GROUP BY id""")
def rule_match(spark, sf):
    from palisade.functions.decode import url_decode

    rules = spark.createDataFrame(USER_RULES, "name string, pattern string, confidence double, attack_type string")
    lines = fx.log_lines(spark, sf).select("id", url_decode(F.col("line")).alias("raw_message"))
    pages = fx.table(spark, sf, "pages").select((F.lit(-1) - F.col("page_id")).alias("id"), F.col("html").alias("raw_message"))
    out = N.rule_match(lines.unionByName(pages), rules)
    return out.select("id", joined("rules").alias("rules"), "confidence", joined("attack_types").alias("attack_types"))


_CODE = "CASE country WHEN 'China' THEN 'CN' WHEN 'Russia' THEN 'RU' WHEN 'North Korea' THEN 'KP' WHEN 'Internal' THEN 'INT' ELSE 'XX' END"


@query("geo_enrich", ev(f"SELECT id, country, {_CODE} AS code, CASE country WHEN 'China' THEN 39.9042::DOUBLE WHEN 'Russia' THEN 55.7558::DOUBLE WHEN 'North Korea' THEN 39.0392::DOUBLE END AS lat FROM (SELECT id, {COUNTRY} AS country FROM ev)"))
def geo_enrich(spark, sf):
    return N.geo_enrich(fx.events(spark, sf), D.geo(spark)).select("id", "country", "code", "lat")


#: Nested networks of lengths that end inside an octet, and of IPv6.
_NETWORKS = [("45.0.0.0/8", "A"), ("45.16.0.0/12", "B"), ("45.24.0.0/13", "C"), ("45.28.16.0/22", "D"), ("45.28.18.128/25", "E"), ("46.128.0.0/9", "F"),
             ("46.200.77.0/28", "G"), ("46.129.64.0/18", "H"), ("47.", "I"), ("2001:db8::/32", "J"), ("2001:db8:3::/48", "K"), ("2001:db8:3::9", "L")]


def _number(octets):
    return sum(o << 24 - 8 * i for i, o in enumerate(octets))


def _v4_ranges():
    for network, name in _NETWORKS:
        if ":" not in network:
            address, _, length = network.partition("/")
            octets = [int(o) for o in address.split(".") if o]
            size = int(length or 8 * len(octets))
            yield f"({_number(octets)}, {_number(octets) + (1 << 32 - size) - 1}, {size}, '{name}')"


@query("geo_networks", f"""WITH a AS (SELECT event_id, user_id, 45 + user_id % 3 AS o1, event_id * 7 % 256 AS o2, event_id * 13 % 256 AS o3, event_id % 256 AS o4 FROM events),
   n(lo, hi, size, name) AS (VALUES {", ".join(_v4_ranges())}),
   m AS (SELECT event_id, max_by(name, size) AS name FROM a JOIN n ON ((o1 * 256 + o2) * 256 + o3) * 256 + o4 BETWEEN lo AND hi WHERE event_id % 5 <> 0 GROUP BY event_id)
   SELECT a.event_id AS id, CASE WHEN a.event_id % 5 = 0 THEN CASE WHEN a.event_id // 5 % 5 <> 3 THEN 'J' WHEN a.user_id % 16 = 9 THEN 'L' ELSE 'K' END ELSE coalesce(m.name, 'Unknown') END AS country
   FROM a LEFT JOIN m ON m.event_id = a.event_id""")
def geo_networks(spark, sf):
    """Addresses made of the events' numbers, looked up in nested networks of any length."""
    i, u = F.col("event_id"), F.col("user_id")
    v4 = F.concat_ws(".", *[c.cast("string") for c in (45 + u % 3, i * 7 % 256, i * 13 % 256, i % 256)])
    v6 = F.concat(F.lit("2001:DB8:"), F.floor(i / 5).cast("long") % 5, F.lit("::"), F.lower(F.hex(u % 16)))
    rows = fx.table(spark, sf, "events").select(i.alias("id"), F.when(i % 5 == 0, v6).otherwise(v4).alias("source_ip"))
    places = spark.createDataFrame(_NETWORKS, "prefix string, country string")
    return N.geo_enrich(rows, places).select("id", "country")


_INTEL = "(VALUES " + ", ".join(f"({q(c)}, {q(k)}, {q(r)}, {q('|'.join(a))}, {q('|'.join(g))})" for c, k, r, a, g in D.THREAT_INTEL) + ") t(country, country_code, risk_assessment, attack_types, actor_groups)"


@query("threat_intel_enrich", ev(f"""SELECT e.id, t.* FROM (SELECT id, CASE WHEN c IN ('China', 'Russia', 'North Korea') THEN c ELSE 'Unknown/Various' END AS c FROM (SELECT id, {COUNTRY} AS c FROM ev)) e JOIN {_INTEL} ON t.country = e.c"""))
def threat_intel_enrich(spark, sf):
    out = N.threat_intel_enrich(fx.events(spark, sf), D.threat_intel(spark))
    return out.select("id", "country", "country_code", "risk_assessment", joined("attack_types").alias("attack_types"), joined("actor_groups").alias("actor_groups"))


_CTX = "(VALUES " + ", ".join(
    f"({q(t)}, {q(c['attack_name'])}, {q(c['difficulty_level'])}, {q('|'.join(c['mitre_techniques']))}, {q(c['vulnerability_id']) if c['vulnerability_id'] else 'NULL'}, "
    f"{c['cvss_score'] if c['cvss_score'] is not None else 'NULL'}, {q('|'.join(c['mitigation_steps']))}, {q('|'.join(c['incidents']))})"
    for t, c in D.EVENT_CONTEXT.items()) + ") c(k, attack_name, difficulty_level, mitre_techniques, vulnerability_id, cvss_score, mitigation_steps, incidents)"


@query("event_context_enrich", ev(f"""SELECT e.id, attack_name, difficulty_level, mitre_techniques, vulnerability_id, CAST(cvss_score AS DOUBLE) AS cvss_score, mitigation_steps, incidents
   FROM (SELECT id, CASE WHEN event_type IN ('SqlInjection', 'XssAttempt', 'BruteForce', 'Anomaly') THEN event_type ELSE '*' END AS k FROM ev) e JOIN {_CTX} ON c.k = e.k"""))
def event_context_enrich(spark, sf):
    out = N.event_context_enrich(fx.events(spark, sf), D.event_context(spark))
    return out.select("id", "attack_name", "difficulty_level", joined("mitre_techniques").alias("mitre_techniques"), "vulnerability_id", "cvss_score",
                      joined("mitigation_steps").alias("mitigation_steps"), joined("incidents").alias("incidents"))


_TRIAGE = """contains(m, 'encode') OR contains(m, '%') AS encoding_detected,
   coalesce(array_to_string(list_filter([CASE WHEN contains(m, '%') THEN 'URL Encoding detected' END, CASE WHEN contains(m, '\\x') THEN 'Hexadecimal encoding detected' END,
     CASE WHEN contains(m, 'base64') OR contains(m, 'btoa') THEN 'Base64 encoding detected' END, CASE WHEN strlen(m) > length(m) THEN 'Unicode obfuscation possible' END], lambda x: x IS NOT NULL), '|'), '') AS obfuscation,
   coalesce(array_to_string(list_filter(['IP Address:' || ip, CASE WHEN contains(m, 'UNION') THEN 'Attack Pattern:SQL UNION' END, CASE WHEN contains(m, '<script>') THEN 'Attack Pattern:<script> tag' END], lambda x: x IS NOT NULL), '|'), '') AS found_indicators"""


@query("payload_triage", ev(f"SELECT id, {_TRIAGE} FROM (SELECT id, raw_message AS m, source_ip AS ip FROM ev UNION ALL SELECT -1 - doc_id, text, NULL FROM documents)"))
def payload_triage(spark, sf):
    docs = fx.table(spark, sf, "documents").select(
        (F.lit(-1) - F.col("doc_id")).alias("id"), F.col("text").alias("raw_message"), F.lit(None).cast("string").alias("source_ip"))
    both = fx.events(spark, sf).select("id", "raw_message", "source_ip").unionByName(docs)
    return N.payload_triage(both).select("id", "encoding_detected", joined("obfuscation").alias("obfuscation"), joined("found_indicators").alias("found_indicators"))


_TECH = ["T1190", "T1110", "T1059"]
_SHOWN = """list_filter([CASE WHEN contains(m, 'HTTP') AND (contains(m, 'UNION') OR contains(m, '<script>') OR contains(m, '../')) THEN 'T1190' END,
   CASE WHEN contains(m, 'Failed') AND contains(m, 'login') THEN 'T1110' END, CASE WHEN contains(m, '<script>') OR contains(m, 'javascript:') THEN 'T1059' END], lambda x: x IS NOT NULL)"""
_TECH_ROWS = f"tech AS (SELECT id, source, {_SHOWN} AS t FROM (SELECT event_id AS id, 'line' AS source, url_decode(line) AS m FROM log_lines UNION ALL SELECT -1 - page_id, 'page', html FROM pages))"


def _decoded_texts(spark, sf):
    from palisade.functions.decode import url_decode

    lines = fx.log_lines(spark, sf).select("id", F.lit("line").alias("source"), url_decode(F.col("line")).alias("raw_message"))
    return lines.unionByName(fx.table(spark, sf, "pages").select((F.lit(-1) - F.col("page_id")).alias("id"), F.lit("page").alias("source"), F.col("html").alias("raw_message")))


@query("hunt_techniques", ev(f"SELECT CAST(id AS VARCHAR) AS subject, {J('t')} AS indicators, source AS systems, 0.75::DOUBLE AS confidence, 'High' AS severity FROM tech WHERE len(t) > 0", _TECH_ROWS))
def hunt_techniques(spark, sf):
    out = H.hunt_techniques(_decoded_texts(spark, sf), _TECH)
    return out.select("subject", joined("indicators").alias("indicators"), joined("systems").alias("systems"), "confidence", "severity")


_STEPS = "MAP {" + ", ".join(f"{q(k)}: {qlist(v)}" for k, v in D.TECHNIQUE_MITIGATIONS.items()) + "}"


@query("technique_mitigation", ev(f"SELECT id, {J(f'flatten(list_transform(t, lambda x: {_STEPS}[x]))')} AS mitigations FROM tech WHERE len(t) > 0", _TECH_ROWS))
def technique_mitigation(spark, sf):
    found = _decoded_texts(spark, sf).select("id", H.techniques_of(F.col("raw_message"), _TECH).alias("techniques"))
    advice = spark.createDataFrame(list(D.TECHNIQUE_MITIGATIONS.items()), "technique string, steps array<string>")
    return N.technique_mitigation(found, advice).select("id", joined("mitigations").alias("mitigations"))


_SIMILAR = """WITH s AS (SELECT vec_id, embedding::DOUBLE[] AS f FROM embeddings),
   c AS (SELECT e.vec_id AS id, s.vec_id AS sid, list_cosine_similarity(e.embedding::DOUBLE[], s.f) AS sim FROM embeddings e, s WHERE e.vec_id <> s.vec_id),
   k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, sid) AS n FROM c WHERE sim > {least})
   SELECT id, sid AS similar_id, round(sim, 6) AS similarity FROM k WHERE n <= 5"""


def _similar(spark, sf, least):
    vecs = fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features"))
    samples = vecs.withColumn("ts", F.timestamp_seconds(F.col("id")))
    out = N.similar_events(vecs, samples, least=least).select("id", F.explode("similar").alias("s"))
    return out.select("id", F.col("s.id").alias("similar_id"), r6("s.similarity").alias("similarity"))


@query("similar_events", _SIMILAR.format(least=0.8))
def similar_events(spark, sf):
    return _similar(spark, sf, 0.8)


@query("similar_events_loose", _SIMILAR.format(least=0.1))
def similar_events_loose(spark, sf):
    """The same at a threshold that vectors of the given table reach."""
    return _similar(spark, sf, 0.1)


@query("similar_indexed", """WITH s AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
   v AS (SELECT vec_id AS id, e AS f FROM s UNION ALL SELECT vec_id + 1000000, list_transform(e, lambda x, i: CASE WHEN i % 4 = vec_id % 4 THEN x * 0.5 ELSE x END) FROM s),
   c AS (SELECT a.id, list_cosine_similarity(a.f, s.e) AS sim, s.vec_id AS sid FROM v a, s WHERE a.id <> s.vec_id),
   k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, sid) AS n FROM c WHERE sim > 0.9)
   SELECT id, sid AS similar_id, round(sim, 6) AS similarity FROM k WHERE n <= 5""")
def similar_indexed(spark, sf):
    """Every vector and a copy of it with a quarter of its components halved, among the vectors, through the index."""
    vecs = fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features"))
    halved = vecs.select((F.col("id") + 1000000).alias("id"), F.transform("features", lambda x, i: F.when((i + 1) % 4 == F.col("id") % 4, x * 0.5).otherwise(x)).alias("features"))
    out = similar.similar_indexed(vecs.unionByName(halved), vecs, least=0.9, miss=1e-6).select("id", F.explode("similar").alias("s"))
    return out.select("id", F.col("s.id").alias("similar_id"), r6("s.similarity").alias("similarity"))


@query("whitelist_filter", ev("SELECT id, source_ip IN (SELECT source_ip FROM wl) AS whitelisted FROM ev", "wl AS (SELECT DISTINCT source_ip FROM ev WHERE id % 50 = 0 AND (starts_with(source_ip, '192.168.') OR starts_with(source_ip, '10.')))"))
def whitelist_filter(spark, sf):
    from palisade.operators.anomaly import whitelist_patterns

    events = fx.events(spark, sf)
    marked = events.join(fx.feedback(spark, sf).select(F.col("event_id").alias("id")), "id", "left_semi")
    return N.whitelist_filter(events, whitelist_patterns(marked), flag=True).select("id", "whitelisted")


@query("whitelist_suppress", ev("SELECT id FROM ev WHERE source_ip NOT IN (SELECT source_ip FROM wl)", "wl AS (SELECT DISTINCT source_ip FROM ev WHERE id % 50 = 0 AND (starts_with(source_ip, '192.168.') OR starts_with(source_ip, '10.')))"))
def whitelist_suppress(spark, sf):
    from palisade.operators.anomaly import whitelist_patterns

    events = fx.events(spark, sf)
    marked = events.join(fx.feedback(spark, sf).select(F.col("event_id").alias("id")), "id", "left_semi")
    return N.whitelist_filter(events, whitelist_patterns(marked)).select("id")


# --- routing ----------------------------------------------------------------

_ROUTE = """route AS (SELECT a.*, unnest(ch) AS channel, generate_subscripts(ch, 1) - 1 AS position FROM (SELECT *, CASE severity WHEN 'Critical' THEN ['console', 'email', 'webhook']
   WHEN 'Warning' THEN ['console', 'webhook'] WHEN 'Info' THEN ['console'] ELSE ['console'] END AS ch FROM alerts) a)"""


@query("alert_route", al("SELECT id, channel FROM route WHERE channel IN ('console', 'webhook')", _ROUTE))
def alert_route(spark, sf):
    return N.alert_route(fx.alerts(spark, sf), D.routing(spark), ["console", "webhook"]).select("id", "channel")


_RECIPIENTS = [
    ("soc@example.com", "All", [], None, None, False), ("lead@example.com", "Critical", [], 9, 17, True),
    ("night@example.com", "Warning", [], 22, 6, False), ("audit@example.com", "All", ["High", "Low"], None, None, False),
]


@query("alert_recipients", al("""SELECT id, 'soc@example.com' AS address FROM alerts
   UNION ALL SELECT id, 'lead@example.com' FROM alerts WHERE severity = 'Critical' AND hour(ts) BETWEEN 9 AND 17 AND isodow(ts) < 6
   UNION ALL SELECT id, 'night@example.com' FROM alerts WHERE severity IN ('Warning', 'Critical') AND (hour(ts) >= 22 OR hour(ts) <= 6)
   UNION ALL SELECT id, 'audit@example.com' FROM alerts WHERE severity IN ('High', 'Low')"""))
def alert_recipients(spark, sf):
    people = spark.createDataFrame(
        _RECIPIENTS, "address string, severity_filter string, alert_types array<string>, start_hour int, end_hour int, weekdays_only boolean")
    return N.alert_recipients(fx.alerts(spark, sf), people).select("id", "address")


_ENDPOINTS = [("hub", True, "All", []), ("pager", True, "Critical", []), ("chat", True, "Warning", ["Warning"]), ("old", False, "All", [])]


@query("alert_endpoints", al("""SELECT id, 'hub' AS endpoint FROM alerts UNION ALL SELECT id, 'pager' FROM alerts WHERE severity = 'Critical'
   UNION ALL SELECT id, 'chat' FROM alerts WHERE severity = 'Warning'"""))
def alert_endpoints(spark, sf):
    hooks = spark.createDataFrame(_ENDPOINTS, "endpoint string, enabled boolean, severity_filter string, alert_types array<string>")
    return N.alert_endpoints(fx.alerts(spark, sf), hooks).select("id", "endpoint")


# --- hunts ------------------------------------------------------------------

@query("hunt_indicators", ev(f"SELECT CAST(id AS VARCHAR) AS subject, {J('list_sort(found)')} AS indicators, 0.8::DOUBLE AS confidence, 'Critical' AS severity FROM ({_IOC_SQL}) WHERE len(found) > 0"))
def hunt_indicators(spark, sf):
    out = H.hunt_indicators(fx.events(spark, sf), _iocs(spark))
    return out.select("subject", joined("indicators").alias("indicators"), "confidence", "severity")


def _evidence(key, k):
    return f"(SELECT array_to_string(list(id ORDER BY ts DESC, id DESC)[1:{k}], '|') FROM ev x WHERE x.{key} = g.{key})"


@query("hunt_anomalies", ev(f"SELECT source AS subject, {_evidence('source', 5)} AS evidence, 0.7::DOUBLE AS confidence, 'Warning' AS severity FROM (SELECT source FROM ev GROUP BY 1 HAVING count(*) > 100) g"))
def hunt_anomalies(spark, sf):
    out = H.hunt_anomalies(fx.events(spark, sf))
    return out.select("subject", joined(F.col("evidence").cast("array<string>")).alias("evidence"), "confidence", "severity")


@query("hunt_apt", ev(f"""SELECT source_ip AS subject, {_evidence('source_ip', 10)} AS evidence, systems, 0.65::DOUBLE AS confidence FROM (
   SELECT source_ip, array_to_string(list(DISTINCT source ORDER BY source), '|') AS systems FROM ev WHERE source_ip IS NOT NULL GROUP BY 1 HAVING count(*) > 20 AND count(DISTINCT source) > 3) g"""))
def hunt_apt(spark, sf):
    out = H.hunt_apt(fx.events(spark, sf))
    return out.select("subject", joined(F.col("evidence").cast("array<string>")).alias("evidence"), joined("systems").alias("systems"), "confidence")


@query("hunt_hypothesis", """SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS subject, 0.6::DOUBLE AS confidence FROM (
   SELECT conv_id, turn, text AS m, TIMESTAMP '2024-01-01' + to_hours(CAST((conv_id * 7 + turn) % 700 AS INTEGER)) AS ts FROM conversations)
   WHERE (hour(ts) >= 21 OR hour(ts) <= 7) AND (contains(m, 'download') OR contains(m, 'export') OR strlen(m) > 500)""")
def hunt_hypothesis(spark, sf):
    chats = fx.table(spark, sf, "conversations").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.lit("chat").alias("source"),
        F.timestamp_seconds(F.lit(1704067200) + (F.col("conv_id") * 7 + F.col("turn")) % 700 * 3600).alias("ts"), F.col("text").alias("raw_message"))
    return H.hunt_hypothesis(chats).select("subject", "confidence")


def _hunts():
    keys = ("id", "name", "category", "severity", "hunt_type", "techniques", "confidence_threshold", "window_hours")
    return [dict(zip(keys, h)) for h in D.HUNTS]


@query("run_hunt", ev(f"""SELECT hunt_id, name, n AS matches_found, round(c, 6) AS confidence, CASE WHEN c >= 0.8 THEN 'HIGH' WHEN c >= 0.6 THEN 'MEDIUM' WHEN c >= 0.4 THEN 'LOW' ELSE 'MINIMAL' END AS risk_level,
   fp AS false_positive_likelihood, CAST(least(10, base + floor(2 * c)) AS BIGINT) AS priority FROM (
   SELECT 'hunt_001' AS hunt_id, 'Exfiltración de Datos Fuera de Horario' AS name, CAST(count(*) AS BIGINT) AS n, CASE WHEN count(*) > 0 THEN 0.6::DOUBLE ELSE 0.0 END AS c, 0.4::DOUBLE AS fp, 7 AS base
     FROM ev WHERE ts BETWEEN {NOW} - INTERVAL 72 HOUR AND {NOW} AND (hour(ts) >= 21 OR hour(ts) <= 7) AND (contains(raw_message, 'download') OR contains(raw_message, 'export') OR strlen(raw_message) > 500)
   UNION ALL SELECT 'hunt_002', 'Actividad APT - Movimiento Lateral', CAST(count(*) AS BIGINT), CASE WHEN count(*) > 0 THEN 0.65::DOUBLE ELSE 0.0 END, 0.25::DOUBLE, 9
     FROM (SELECT source_ip FROM ev WHERE ts BETWEEN {NOW} - INTERVAL 168 HOUR AND {NOW} AND source_ip IS NOT NULL GROUP BY 1 HAVING count(*) > 20 AND count(DISTINCT source) > 3)
   UNION ALL SELECT 'hunt_003', 'IOCs de Malware Conocido', CAST(count(*) AS BIGINT), CASE WHEN count(*) > 0 THEN 0.8::DOUBLE ELSE 0.0 END, 0.1::DOUBLE, 9
     FROM ev WHERE ts BETWEEN {NOW} - INTERVAL 24 HOUR AND {NOW} AND (source_ip = '203.0.113.45' OR contains(raw_message, 'malicious-c2.example.com')))"""))
def run_hunt(spark, sf):
    out = H.run_hunts(fx.events(spark, sf), _hunts(), D.indicators(spark, AS_OF), AS_OF)
    return out.withColumns({"confidence": r6("confidence"), "priority": big("priority")})


@query("hunt_catalog", " UNION ALL ".join(
    f"SELECT {q(h[0])} AS id, {q(h[1])} AS name, {q(h[4])} AS hunt_type, {q('|'.join(h[5]))} AS techniques, CAST({h[7]} AS BIGINT) AS window_hours, (SELECT CAST(count(*) AS BIGINT) FROM events WHERE ts BETWEEN {NOW} - INTERVAL {h[7]} HOUR AND {NOW}) AS events_in_window"
    for h in D.HUNTS))
def hunt_catalog(spark, sf):
    out = H.hunt_catalog(D.hunts(spark), fx.table(spark, sf, "events"), AS_OF)
    return out.select("id", "name", "hunt_type", joined("techniques").alias("techniques"), big("window_hours").alias("window_hours"), "events_in_window")


@query("behavior_baseline", ev(f"""SELECT {O.secs('hour')} AS hour_s, logins, failed, round(z, 6) AS z_score, abs(z) > 3 AS is_anomalous, logins > 15 AS over_peak, failed::DOUBLE / logins > 0.05::DOUBLE AS failing FROM (
   SELECT *, CASE WHEN sigma > 0 THEN (logins - mean) / sigma ELSE 0.0 END AS z FROM (
     SELECT *, avg(logins) OVER w AS mean, stddev_pop(logins) OVER w AS sigma FROM (
       SELECT date_trunc('hour', ts) AS hour, CAST(count(*) AS BIGINT) AS logins, CAST(count_if(NOT success) AS BIGINT) AS failed FROM att WHERE username IS NOT NULL GROUP BY 1)
     WINDOW w AS (ORDER BY hour ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)))""", ATT))
def behavior_baseline(spark, sf):
    out = H.behavior_baseline(fx.events(spark, sf))
    return out.select(secs("hour").alias("hour_s"), "logins", "failed", r6("z_score").alias("z_score"), "is_anomalous", "over_peak", "failing")
