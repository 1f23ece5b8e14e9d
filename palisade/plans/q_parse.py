"""Registered queries: log parsing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from palisade.functions import rules as R, text as tx
from palisade.operators import parse as P
from palisade.plans import oracle as O
from palisade.plans.registry import big, joined, query, secs
from palisade.sources import fixtures as fx

LINES = f"WITH log_lines AS MATERIALIZED ({fx.LOG_LINES}) "


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return fx.log_lines(spark, sf, known_origin=False)


@query("detect_format", LINES + f"SELECT event_id AS id, {O.detect_format('line')} AS format FROM log_lines")
def detect_format(spark, sf):
    return _lines(spark, sf).select("id", P.detect_format(F.col("line")).alias("format"))


_ISO = r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}"


@query("extract_ts", LINES + f""",
v AS (SELECT event_id AS id, ingest_ts, line, {O.detect_format('line')} AS f FROM log_lines
  UNION ALL SELECT event_id, ingest_ts, '{{"time":"' || strftime(ingest_ts, '%Y-%m-%d %H:%M:%S') || '"}}', 'Json' FROM log_lines
  UNION ALL SELECT event_id, ingest_ts, 'nginx ' || strftime(ingest_ts, '%Y-%m-%dT%H:%M:%S') || ' x', 'Nginx' FROM log_lines)
SELECT id, f AS format, {O.secs('''coalesce(CASE WHEN f = 'Apache' THEN try_strptime(left(regexp_extract(line, '\\[([^\\]]+)\\]', 1), 20), '%d/%b/%Y:%H:%M:%S')
  WHEN f = 'Ssh' THEN try_strptime('2024 ' || regexp_extract(line, '^(\\w{3}\\s+\\d{1,2}\\s+\\d{2}:\\d{2}:\\d{2})', 1), '%Y %b %d %H:%M:%S')
  WHEN f = 'Json' THEN try_strptime(json_extract_string(line, '$.time'), '%Y-%m-%d %H:%M:%S')
  WHEN f = 'Nginx' THEN try_strptime(regexp_extract(line, '\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2}', 0), '%Y-%m-%dT%H:%M:%S') END, ingest_ts)''')} AS ts_s FROM v""")
def extract_ts(spark, sf):
    lines = _lines(spark, sf)
    as_json = F.concat(F.lit('{"time":"'), F.date_format("ingest_ts", "yyyy-MM-dd HH:mm:ss"), F.lit('"}'))
    as_iso = F.concat(F.lit("nginx "), F.date_format("ingest_ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(" x"))
    forms = lines.select("id", "ingest_ts", F.explode(F.array("line", as_json, as_iso)).alias("line"))
    forms = forms.withColumn("format", P.detect_format(F.col("line")))
    ts = P.extract_ts(F.col("line"), F.col("format"), F.col("ingest_ts"))
    return forms.select("id", "format", secs(ts).alias("ts_s"))


_IP = f"coalesce(nullif(regexp_extract(t, {O.q(R.IPV4)}, 0), ''), nullif(regexp_extract(t, {O.q(R.IPV6)}, 0), ''))"


@query("extract_ip", f"SELECT doc_id AS id, {_IP} AS ip FROM (SELECT doc_id, text AS t FROM documents) WHERE {_IP} IS NOT NULL")
def extract_ip(spark, sf):
    docs = fx.table(spark, sf, "documents")
    return docs.select(F.col("doc_id").alias("id"), tx.extract_ip(F.col("text")).alias("ip")).where("ip IS NOT NULL")


_PRIVATE = " OR ".join(f"starts_with(ip, '{p}')" for p in R.PRIVATE_PREFIXES)


@query("is_private_ip", LINES + f"SELECT event_id AS id, ip, ({_PRIVATE}) AS private FROM (SELECT event_id, {_IP} AS ip FROM (SELECT event_id, line AS t FROM log_lines))")
def is_private_ip(spark, sf):
    ips = _lines(spark, sf).select("id", tx.extract_ip(F.col("line")).alias("ip"))
    return ips.withColumn("private", tx.is_private_ip(F.col("ip")))


_LEVELS = ["Emergency", "Alert", "Critical", "Error", "Warning", "Notice", "Info", "Debug"]


@query("loglevel_severity", f"""SELECT level, CASE WHEN level IN ('Emergency','Alert','Critical','Error') THEN 'Critical'
  WHEN level IN ('Warning','Notice') THEN 'Warning' ELSE 'Info' END AS severity, CAST(count(*) AS BIGINT) AS n
  FROM (SELECT {O.qlist(_LEVELS)}[event_id % 8 + 1] AS level FROM events) GROUP BY 1, 2""")
def loglevel_severity(spark, sf):
    levels = F.array(*[F.lit(x) for x in _LEVELS])
    ev = fx.table(spark, sf, "events").select(F.get(levels, (F.col("event_id") % 8).cast("int")).alias("level"))
    return ev.groupBy("level", P.loglevel_severity(F.col("level")).alias("severity")).agg(F.count("*").alias("n"))


@query("classify_event_type", f"""SELECT 'line' AS kind, id, t AS event_type FROM (SELECT event_id AS id, {O.classify('lower(line)')} AS t FROM ({fx.LOG_LINES}))
  UNION ALL SELECT 'page', page_id, {O.classify('lower(html)')} FROM pages""")
def classify_event_type(spark, sf):
    lines = _lines(spark, sf).select(F.lit("line").alias("kind"), "id", P.classify_event_type(F.col("line")).alias("event_type"))
    pages = fx.table(spark, sf, "pages").select(
        F.lit("page").alias("kind"), F.col("page_id").alias("id"), P.classify_event_type(F.col("html")).alias("event_type"))
    return lines.unionByName(pages)


def _flat(events: DataFrame, *fields: str) -> DataFrame:
    return events.select(
        "id", secs("ts").alias("ts_s"), "source", "severity", "source_ip", "event_type", joined("iocs").alias("iocs"),
        *[(big("parsed.status_code") if f == "status_code" else F.col(f"parsed.{f}")).alias(f) for f in fields],
    )


def _flat_sql(*fields: str, line_sql="line", source_type="by_id", parser=None) -> str:
    cols = "".join(f', CAST(status_code AS BIGINT) AS status_code' if f == "status_code" else f', "{f}"' for f in fields)
    return f"""WITH {O.events_ctes(line_sql, source_type, parser)}
      SELECT id, {O.secs('ts')} AS ts_s, source, severity, source_ip, event_type, {O.joined('iocs')} AS iocs{cols} FROM ev"""


_APACHE_FIELDS = ("ip", "method", "path", "protocol", "status_code", "size", "referer", "user_agent", "format")
_ACCESS_FIELDS = ("ip", "user", "method", "path", "protocol", "status_code", "body_bytes", "referer", "user_agent", "forwarded_for", "request_time", "log_type")
_ERROR_FIELDS = ("log_level", "pid", "tid", "message", "ip", "server", "request", "host", "log_type")
_CUSTOM_FIELDS = ("ip", "method", "path", "protocol", "status_code", "body_bytes", "referer", "user_agent", "response_time",
                  "upstream_connect_time", "upstream_header_time", "upstream_response_time", "log_type")
_NO_USER = r"regexp_replace(line, ' - \S+ \[', ' - - [')"


@query("parse_apache", _flat_sql(*_APACHE_FIELDS, parser="Apache"))
def parse_apache(spark, sf):
    return _flat(P.parse_logs(_lines(spark, sf), parser="Apache"), *_APACHE_FIELDS)


@query("parse_nginx", _flat_sql("method", "path", "status_code", "log_level", "log_type", "format", parser="Nginx"))
def parse_nginx(spark, sf):
    return _flat(P.parse_logs(_lines(spark, sf), parser="Nginx"), "method", "path", "status_code", "log_level", "log_type", "format")


@query("parse_nginx_access", _flat_sql(*_ACCESS_FIELDS, parser="Nginx") + " WHERE kind = 'nginx_access'")
def parse_nginx_access(spark, sf):
    return _flat(P.parse_logs(_lines(spark, sf), parser="Nginx"), *_ACCESS_FIELDS).where(F.col("source") == "nginx_access")


@query("parse_nginx_error", _flat_sql(*_ERROR_FIELDS, parser="Nginx") + " WHERE kind = 'nginx_error'")
def parse_nginx_error(spark, sf):
    return _flat(P.parse_logs(_lines(spark, sf), parser="Nginx"), *_ERROR_FIELDS).where(F.col("source") == "nginx_error")


@query("parse_nginx_custom", _flat_sql(*_CUSTOM_FIELDS, line_sql=_NO_USER, parser="Nginx") + " WHERE kind = 'nginx_custom'")
def parse_nginx_custom(spark, sf):
    lines = _lines(spark, sf).withColumn("line", F.regexp_replace("line", r" - \S+ \[", " - - ["))
    return _flat(P.parse_logs(lines, parser="Nginx"), *_CUSTOM_FIELDS).where(F.col("source") == "nginx_custom")


@query("parse_nginx_generic", _flat_sql("format", parser="Nginx") + " WHERE kind = 'nginx_generic'")
def parse_nginx_generic(spark, sf):
    return _flat(P.parse_logs(_lines(spark, sf), parser="Nginx"), "format").where(F.col("source") == "nginx_generic")


@query("parse_ssh", _flat_sql("auth_outcome", "auth_method", "user", parser="Ssh"))
def parse_ssh(spark, sf):
    return _flat(P.parse_logs(_lines(spark, sf), parser="Ssh"), "auth_outcome", "auth_method", "user")


@query("parse_logs", _flat_sql("method", "path", "status_code", "user", "user_agent"))
def parse_logs(spark, sf):
    return _flat(fx.events(spark, sf), "method", "path", "status_code", "user", "user_agent")


@query("parse_logs_detected", _flat_sql("method", "path", "status_code", "format", source_type=None))
def parse_logs_detected(spark, sf):
    return _flat(P.parse_logs(_lines(spark, sf)), "method", "path", "status_code", "format")


_APACHE_EV = f"WITH {O.events_ctes(parser='Apache')} "
_NGINX_EV = f"WITH {O.events_ctes(line_sql=_NO_USER, parser='Nginx')} "


@query("apache_severity", _APACHE_EV + f"SELECT id, {O.APACHE_SEVERITY} AS severity FROM ev WHERE source = 'apache'")
def apache_severity(spark, sf):
    ev = P.parse_logs(_lines(spark, sf), parser="Apache").where("source = 'apache'")
    return ev.select("id", P.apache_severity(F.col("parsed.status_code"), F.col("parsed.path")).alias("severity"))


@query("apache_event_type", _APACHE_EV + f"SELECT id, {O.APACHE_EVENT_TYPE} AS event_type FROM ev WHERE source = 'apache'")
def apache_event_type(spark, sf):
    ev = P.parse_logs(_lines(spark, sf), parser="Apache").where("source = 'apache'")
    p = F.col("parsed")
    return ev.select("id", P.apache_event_type(p.method, p.path, p.status_code).alias("event_type"))


@query("apache_iocs", f"SELECT page_id AS id, {O.joined(O.found('''lower(url || ' ' || html)''', R.APACHE_IOCS))} AS iocs FROM pages "
       + f"UNION ALL SELECT id, {O.joined('iocs')} FROM ({_APACHE_EV} SELECT id, iocs FROM ev WHERE source = 'apache')")
def apache_iocs(spark, sf):
    pages = fx.table(spark, sf, "pages").select(
        F.col("page_id").alias("id"), joined(P.apache_iocs(F.col("url"), F.col("html"))).alias("iocs"))
    ev = P.parse_logs(_lines(spark, sf), parser="Apache").where("source = 'apache'")
    agent = F.when(F.col("parsed.format") == "combined", F.col("parsed.user_agent")).otherwise("")
    return pages.unionByName(ev.select("id", joined(P.apache_iocs(F.col("parsed.path"), agent)).alias("iocs")))


@query("split_request", LINES + """, r AS (SELECT event_id AS id, regexp_extract(line, '"([^"]*)"', 1) AS req FROM log_lines
   UNION ALL SELECT event_id, split_part(regexp_extract(line, '"([^"]*)"', 1), ' HTTP', 1) FROM log_lines
   UNION ALL SELECT event_id, split_part(regexp_extract(line, '"([^"]*)"', 1), ' ', 1) FROM log_lines),
 p AS (SELECT id, req, list_filter(string_split(req, ' '), lambda x: x <> '') AS x FROM r)
 SELECT id, req, CASE WHEN len(x) >= 2 THEN x[1] WHEN len(x) = 1 THEN 'GET' ELSE 'UNKNOWN' END AS method,
   CASE WHEN len(x) >= 2 THEN x[2] WHEN len(x) = 1 THEN x[1] ELSE '-' END AS path,
   CASE WHEN len(x) >= 3 THEN x[3] WHEN len(x) >= 1 THEN 'HTTP/1.0' ELSE '-' END AS protocol FROM p""")
def split_request(spark, sf):
    full = F.regexp_extract("line", '"([^"]*)"', 1)
    lines = _lines(spark, sf).withColumn("full", full)
    forms = lines.select("id", F.explode(F.array(
        "full", F.regexp_extract("full", "^(.*?)(?: HTTP.*)?$", 1), F.regexp_extract("full", "^[^ ]*", 0))).alias("req"))
    return forms.select("id", "req", P.split_request(F.col("req")).alias("r")).select("id", "req", "r.*")


@query("nginx_severity", _NGINX_EV + f"""SELECT id, source, CASE source WHEN 'nginx_error' THEN {O.NGINX_LEVEL_SEVERITY} ELSE {O.NGINX_STATUS_SEVERITY} END AS severity
   FROM ev WHERE source IN ('nginx_access', 'nginx_custom', 'nginx_error')""")
def nginx_severity(spark, sf):
    lines = _lines(spark, sf).withColumn("line", F.regexp_replace("line", r" - \S+ \[", " - - ["))
    ev = P.parse_logs(lines, parser="Nginx").where("source <> 'nginx_generic'")
    by_level, by_status = P.nginx_level_severity(F.col("parsed.log_level")), P.nginx_status_severity(F.col("parsed.status_code"))
    return ev.select("id", "source", F.when(F.col("source") == "nginx_error", by_level).otherwise(by_status).alias("severity"))


@query("nginx_iocs", f"""WITH p AS (SELECT page_id AS id, html AS path, url AS user_agent, 'TRACE' AS method FROM pages)
   SELECT id, {O.joined(O.NGINX_IOCS)} AS iocs FROM p
   UNION ALL SELECT id, {O.joined('iocs')} FROM ({_NGINX_EV} SELECT id, iocs FROM ev WHERE source IN ('nginx_access', 'nginx_custom'))""")
def nginx_iocs(spark, sf):
    pages = fx.table(spark, sf, "pages").select(
        F.col("page_id").alias("id"), joined(P.nginx_iocs(F.col("html"), F.col("url"), F.lit("TRACE"))).alias("iocs"))
    lines = _lines(spark, sf).withColumn("line", F.regexp_replace("line", r" - \S+ \[", " - - ["))
    ev = P.parse_logs(lines, parser="Nginx").where("source IN ('nginx_access', 'nginx_custom')")
    p = F.col("parsed")
    return pages.unionByName(ev.select("id", joined(P.nginx_iocs(p.path, p.user_agent, p.method)).alias("iocs")))


@query("nginx_error_iocs", f"""WITH p AS (SELECT doc_id AS id, text AS message, 'upstream timed out, ' || source AS request FROM documents)
   SELECT id, {O.joined(O.NGINX_ERROR_IOCS)} AS iocs FROM p""")
def nginx_error_iocs(spark, sf):
    docs = fx.table(spark, sf, "documents")
    request = F.concat(F.lit("upstream timed out, "), F.col("source"))
    return docs.select(F.col("doc_id").alias("id"), joined(P.nginx_error_iocs(F.col("text"), request)).alias("iocs"))


@query("can_parse", LINES + f""", c AS (SELECT {O.detect_format('line')} AS format,
     regexp_matches(line, {O.q('^' + R.APACHE_COMMON)}) OR regexp_matches(line, {O.q('^' + R.APACHE_COMBINED)}) AS apache,
     contains(line, 'nginx') OR regexp_matches(line, {O.q(O.GROUPS['nginx_access'][0])}) OR regexp_matches(line, {O.q(O.GROUPS['nginx_error'][0])})
       OR regexp_matches(line, {O.q(R.NGINX_CUSTOM)}) OR (contains(line, '[') AND contains(line, ']') AND contains(line, '"') AND contains(line, ' - ')) AS nginx,
     contains(line, 'ssh') AS ssh FROM log_lines)
   SELECT format, CAST(count(*) AS BIGINT) AS lines, CAST(count_if(apache) AS BIGINT) AS apache, CAST(count_if(nginx) AS BIGINT) AS nginx,
     CAST(count_if(ssh) AS BIGINT) AS ssh FROM c GROUP BY 1""")
def can_parse(spark, sf):
    checks = _lines(spark, sf).select(P.detect_format(F.col("line")).alias("format"), P.can_parse(F.col("line")).alias("c"))
    return checks.groupBy("format").agg(
        F.count("*").alias("lines"), *[F.count_if(f"c.{n}").alias(n) for n in ("apache", "nginx", "ssh")])


@query("event_fields", O.ev("""SELECT id, "user" AS username, user_agent, CAST(status_code AS BIGINT) AS status,
   CASE WHEN contains(source, 'apache') THEN 'apache' WHEN contains(source, 'nginx') THEN 'nginx' WHEN contains(source, 'ssh') THEN 'ssh' ELSE 'web' END AS service FROM ev"""))
def event_fields(spark, sf):
    return P.event_fields(fx.events(spark, sf)).select("id", "username", "user_agent", big("status").alias("status"), "service")


_KV = "'kv|' || CAST(event_id AS VARCHAR) || '|10.1.' || CAST(user_id % 7 AS VARCHAR) || '.' || CAST(user_id % 200 AS VARCHAR) || '|user' || CAST(user_id AS VARCHAR) || '|' || event_type"


@query("register_parser", """SELECT event_id AS id, 'kv' AS source, '10.1.' || CAST(user_id % 7 AS VARCHAR) || '.' || CAST(user_id % 200 AS VARCHAR) AS source_ip,
   'user' || CAST(user_id AS VARCHAR) AS "user", CASE WHEN event_type = 'error' THEN 'Critical' ELSE 'Info' END AS severity, event_type FROM events""")
def register_parser(spark, sf):
    """Lines of a format of their own, read by a registered parser."""
    lines = fx.table(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.col("ts").alias("ingest_ts"), F.expr(_KV.replace("VARCHAR", "STRING")).alias("line"))

    def part(n):
        return lambda line: F.get(F.split(line, r"\|"), F.lit(n))

    P.register_parser("kv", lambda line: line.startswith("kv|"), lambda line: {
        "source_ip": part(2)(line), "user": part(3)(line), "event_type": part(4)(line),
        "severity": F.when(part(4)(line) == "error", "Critical").otherwise("Info")})
    try:
        events = P.parse_logs(lines)
    finally:
        P.unregister_parser("kv")
    return events.select("id", "source", "source_ip", F.col("parsed.user").alias("user"), "severity", "event_type")


@query("parse_logs_repeated", f"""WITH r AS (SELECT line, event_id % 3 AS site FROM ({fx.LOG_LINES}), range(3))
   SELECT CAST(count(*) AS BIGINT) AS lines, CAST(count(*) AS BIGINT) AS ids, CAST(count(DISTINCT line) AS BIGINT) AS texts FROM r""")
def parse_logs_repeated(spark, sf):
    """Every line three times in its file: each occurrence is an event."""
    lines = fx.log_lines(spark, sf).select("line", "ingest_ts", F.format_string("site%d", F.col("id") % 3).alias("file"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("n")).drop("n")
    events = P.parse_logs(lines)
    return events.agg(F.count("*").alias("lines"), F.countDistinct("id").alias("ids"), F.countDistinct("raw_message").alias("texts"))
