"""Building blocks of the oracle SQL (DuckDB dialect).

The oracle states each operation a second time, from its definition; it shares
only the fixed patterns and word lists with the engine.
"""

from __future__ import annotations

from palisade.functions import rules as R
from palisade.schema import PARSED_FIELDS, SEVERITIES
from palisade.sources.fixtures import AS_OF, LOG_LINES


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def qlist(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def found(text: str, words, prefix: str = "") -> str:
    """List of the words contained in ``text``."""
    return f"list_transform(list_filter({qlist(words)}, lambda w: contains({text}, w)), lambda w: {q(prefix)} || w)"


def any_word(text: str, words) -> str:
    return f"(len(list_filter({qlist(words)}, lambda w: contains({text}, w))) > 0)"


def matching(text: str, pairs) -> str:
    """List of names whose pattern is found."""
    cases = ", ".join(f"CASE WHEN regexp_matches({text}, {q(p)}) THEN {q(n)} END" for n, p in pairs)
    return f"list_filter([{cases}], lambda m: m IS NOT NULL)"


def joined(lst: str) -> str:
    return f"coalesce(array_to_string({lst}, '|'), '')"


def secs(ts: str) -> str:
    return f"CAST(floor(epoch_us({ts}) / 1000000) AS BIGINT)"


def severity_rank(col: str) -> str:
    return f"(list_position({qlist(SEVERITIES)}, {col}) - 1)"


# group numbers of each pattern, from 1
GROUPS = {
    "apache_combined": ("^" + R.APACHE_COMBINED, dict(
        ip=1, time=2, method=3, path=4, protocol=5, status=6, size=7, referer=8, user_agent=9)),
    "apache_common": ("^" + R.APACHE_COMMON, dict(
        ip=1, time=2, method=3, path=4, protocol=5, status=6, size=7)),
    "nginx_custom": (R.NGINX_CUSTOM, dict(
        ip=1, time=2, request_line=3, status=4, body_bytes=5, referer=6, user_agent=7, response_time=8,
        upstream_connect_time=9, upstream_header_time=10, upstream_response_time=11)),
    "nginx_access": ("^" + R.NGINX_ACCESS + "$", dict(
        ip=1, user=2, time=3, request_line=4, status=5, body_bytes=6, referer=7, user_agent=8,
        forwarded_for=9, request_time=10)),
    "nginx_error": ("^" + R.NGINX_ERROR + "$", dict(
        time=1, log_level=2, pid=3, tid=4, message=5, ip=6, server=7, request=8, host=9)),
    "ssh_auth": (R.SSH_AUTH, dict(auth_outcome=1, auth_method=2, user=3)),
}


def only_group(pattern: str, number: int) -> str:
    """The pattern with just one capturing group; DuckDB numbers at most nine."""
    out, seen, i, in_class = [], 0, 0, False
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            out.append(pattern[i:i + 2])
            i += 2
            continue
        if ch == "[":
            in_class = True
        elif ch == "]":
            in_class = False
        elif ch == "(" and not in_class and pattern[i + 1] != "?":
            seen += 1
            if seen != number:
                ch = "(?:"
        out.append(ch)
        i += 1
    return "".join(out)


def field(name: str) -> str:
    whens = " ".join(
        f"WHEN {q(kind)} THEN regexp_extract(line, {q(only_group(pattern, groups[name]))}, 1)"
        for kind, (pattern, groups) in GROUPS.items() if name in groups
    )
    return f"nullif(nullif(CASE kind {whens} END, ''), '-')"


def classify(low: str) -> str:
    whens = " ".join(f"WHEN {any_word(low, words)} THEN {q(t)}" for t, words in R.EVENT_TYPE_WORDS)
    return f"CASE {whens} ELSE 'Normal' END"


def detect_format(line: str) -> str:
    return f"""CASE
      WHEN contains({line}, '[') AND contains({line}, ']') AND len({line}) - len(replace({line}, '"', '')) >= 2 THEN 'Apache'
      WHEN contains({line}, 'nginx') OR (contains({line}, ' - ') AND contains({line}, ' [')) THEN 'Nginx'
      WHEN contains({line}, 'ssh') OR contains({line}, 'SSH') THEN 'Ssh'
      WHEN regexp_matches({line}, {q(R.SYSLOG_HEAD)}) THEN 'Syslog'
      WHEN starts_with(trim({line}), '{{') AND ends_with(trim({line}), '}}') THEN 'Json'
      ELSE 'Unknown' END"""


APACHE_SEVERITY = """CASE WHEN status_code BETWEEN 500 AND 599 THEN 'Critical'
    WHEN status_code = 404 AND contains(path, 'admin') THEN 'Warning' WHEN status_code = 403 THEN 'Warning' ELSE 'Info' END"""
NGINX_STATUS_SEVERITY = """CASE WHEN status_code BETWEEN 500 AND 599 THEN 'Critical' WHEN status_code IN (401, 403, 429) THEN 'Warning'
    WHEN status_code BETWEEN 200 AND 499 THEN 'Info' ELSE 'Warning' END"""
NGINX_LEVEL_SEVERITY = """CASE WHEN lower(log_level) IN ('emerg', 'emergency', 'alert', 'crit', 'critical', 'err', 'error') THEN 'Critical'
    WHEN lower(log_level) IN ('warn', 'warning', 'notice') THEN 'Warning' ELSE 'Info' END"""
APACHE_EVENT_TYPE = f"""CASE WHEN {any_word('lower(path)', R.APACHE_SQL_WORDS)} THEN 'SqlInjection'
    WHEN {any_word('lower(path)', R.APACHE_XSS_WORDS)} THEN 'XssAttempt'
    WHEN method = 'POST' AND status_code = 401 THEN 'BruteForce' ELSE 'Normal' END"""
_REQ = "lower(coalesce(path, '-') || ' ' || coalesce(user_agent, '-') || ' ' || coalesce(method, '-'))"
NGINX_IOCS = (
    f"list_concat(list_concat({found(_REQ, R.NGINX_IOCS)}, "
    + found("lower(coalesce(user_agent, ''))", R.NGINX_TOOL_AGENTS, "suspicious_user_agent:") + "), "
    + f"list_transform(list_filter({qlist(R.NGINX_RISKY_METHODS)}, lambda w: upper(method) = w), lambda w: 'suspicious_method:' || w))"
)
APACHE_IOCS = found(
    "lower(path || ' ' || CASE kind WHEN 'apache_combined' THEN coalesce(user_agent, '-') ELSE '' END)", R.APACHE_IOCS)
NGINX_ERROR_IOCS = found(
    "lower(coalesce(message, '-') || ' ' || coalesce(request, '-'))", R.NGINX_ERROR_IOCS, "error_pattern:")

_REQUEST_PARTS = "list_filter(regexp_split_to_array(coalesce(request_line, ''), '\\s+'), lambda p: p <> '')"
_DIRECT = [
    "auth_method", "auth_outcome", "body_bytes", "forwarded_for", "host", "ip", "log_level", "message", "pid",
    "referer", "request", "request_time", "response_time", "server", "size", "tid", "upstream_connect_time",
    "upstream_header_time", "upstream_response_time", "user", "user_agent",
]
_JSON = " , ".join(
    f"CASE WHEN \"{f}\" IS NOT NULL THEN '\"{f}\":' || CAST(to_json(\"{f}\") AS VARCHAR) END" for f in PARSED_FIELDS
)
_IPV4_OR_6 = f"coalesce(nullif(regexp_extract(line, {q(R.IPV4)}, 0), ''), nullif(regexp_extract(line, {q(R.IPV6)}, 0), ''))"


def events_ctes(line_sql: str = "line", source_type: str | None = "by_id", parser: str | None = None) -> str:
    """CTEs up to ``ev``, the parsed events of the log-lines view."""
    st = f"CASE WHEN event_id % 5 < 2 THEN 'Apache' WHEN event_id % 5 < 4 THEN 'Nginx' ELSE 'Ssh' END"
    if source_type is None:
        st = detect_format(line_sql)
    if parser:
        st = q(parser)
    kind = f"""CASE WHEN st = 'Nginx' THEN
        CASE WHEN regexp_matches(line, {q(GROUPS['nginx_custom'][0])}) THEN 'nginx_custom'
             WHEN regexp_matches(line, {q(GROUPS['nginx_access'][0])}) THEN 'nginx_access'
             WHEN regexp_matches(line, {q(GROUPS['nginx_error'][0])}) THEN 'nginx_error' ELSE 'nginx_generic' END
      WHEN st = 'Ssh' THEN CASE WHEN regexp_matches(line, {q(R.SSH_AUTH)}) THEN 'ssh_auth' ELSE 'ssh' END
      ELSE CASE WHEN regexp_matches(line, {q(GROUPS['apache_combined'][0])}) THEN 'apache_combined'
             WHEN regexp_matches(line, {q(GROUPS['apache_common'][0])}) THEN 'apache_common' ELSE 'apache_unknown' END END"""
    direct = ", ".join(f'{field(f)} AS "{f}"' for f in _DIRECT)
    return f"""
log_lines AS MATERIALIZED ({LOG_LINES}),
kinds AS MATERIALIZED (SELECT id, ingest_ts, line, st, {kind} AS kind FROM (
  SELECT event_id AS id, ingest_ts, {line_sql} AS line, {st} AS st FROM log_lines)),
parts AS MATERIALIZED (SELECT id, ingest_ts, line, kind, {direct}, {field('time')} AS "time", {field('request_line')} AS request_line,
    {field('method')} AS m0, {field('path')} AS p0, {field('protocol')} AS v0, CAST({field('status')} AS INTEGER) AS status_code FROM kinds),
reqs AS (SELECT *, {_REQUEST_PARTS} AS rp FROM parts),
fields AS MATERIALIZED (SELECT * EXCLUDE (m0, p0, v0, rp, request_line, auth_outcome), lower(auth_outcome) AS auth_outcome,
    CASE WHEN kind IN ('nginx_access', 'nginx_custom') THEN CASE WHEN len(rp) >= 2 THEN rp[1] WHEN len(rp) = 1 THEN 'GET' ELSE 'UNKNOWN' END ELSE m0 END AS method,
    CASE WHEN kind IN ('nginx_access', 'nginx_custom') THEN nullif(CASE WHEN len(rp) >= 2 THEN rp[2] WHEN len(rp) = 1 THEN rp[1] END, '-') ELSE p0 END AS path,
    CASE WHEN kind IN ('nginx_access', 'nginx_custom') THEN CASE WHEN len(rp) >= 3 THEN rp[3] WHEN len(rp) >= 1 THEN 'HTTP/1.0' END ELSE v0 END AS protocol,
    CASE kind WHEN 'apache_combined' THEN 'combined' WHEN 'apache_common' THEN 'common' WHEN 'apache_unknown' THEN 'unknown' WHEN 'nginx_generic' THEN 'generic' END AS format,
    CASE kind WHEN 'nginx_access' THEN 'access' WHEN 'nginx_custom' THEN 'custom' WHEN 'nginx_error' THEN 'error' END AS log_type
  FROM reqs),
ev AS MATERIALIZED (SELECT id,
    coalesce(CASE WHEN kind IN ('apache_combined', 'apache_common', 'nginx_access', 'nginx_custom') THEN try_strptime(left("time", 20), '%d/%b/%Y:%H:%M:%S')
         WHEN kind = 'nginx_error' THEN try_strptime("time", '%Y/%m/%d %H:%M:%S')
         WHEN kind IN ('ssh', 'ssh_auth') THEN try_strptime(CAST(year(ingest_ts) AS VARCHAR) || ' ' || regexp_replace(regexp_extract(line, {q(R.SYSLOG_HEAD)}, 0), '\\s+', ' ', 'g'), '%Y %b %d %H:%M:%S') END, ingest_ts) AS ts,
    CASE WHEN kind LIKE 'apache_co%' THEN 'apache' WHEN kind IN ('ssh', 'ssh_auth') THEN 'ssh' ELSE kind END AS source,
    CASE WHEN kind LIKE 'apache_co%' THEN {APACHE_SEVERITY} WHEN kind IN ('nginx_access', 'nginx_custom') THEN {NGINX_STATUS_SEVERITY}
         WHEN kind = 'nginx_error' THEN {NGINX_LEVEL_SEVERITY} ELSE 'Info' END AS severity,
    CASE WHEN kind = 'nginx_generic' THEN {_IPV4_OR_6} WHEN kind IN ('ssh', 'ssh_auth') THEN nullif(regexp_extract(line, {q(R.DOTTED_QUAD)}, 1), '') ELSE ip END AS source_ip,
    line AS raw_message,
    CASE WHEN kind LIKE 'apache_co%' THEN {APACHE_EVENT_TYPE} WHEN kind LIKE 'nginx%' THEN {classify('lower(line)')} ELSE 'Normal' END AS event_type,
    CASE WHEN kind LIKE 'apache_co%' THEN {APACHE_IOCS} WHEN kind IN ('nginx_access', 'nginx_custom') THEN {NGINX_IOCS}
         WHEN kind = 'nginx_error' THEN {NGINX_ERROR_IOCS} ELSE [] END AS iocs,
    '{{' || concat_ws(',', {_JSON}) || '}}' AS parsed_json, kind, ingest_ts,
    {", ".join('"' + f + '"' for f in PARSED_FIELDS)}
  FROM fields)"""


_EV = events_ctes()


def ev(select: str, ctes: str = "") -> str:
    """A query over the parsed events ``ev``."""
    return f"WITH {_EV}{', ' + ctes if ctes else ''} {select}"


ALERT_CTES = """
alerts AS (SELECT event_id AS id, ts, ['Low','Info','Medium','Warning','High','Critical'][event_id % 6 + 1] AS severity,
    'Threat from ' || CAST(user_id % 10 AS VARCHAR) AS title FROM events WHERE event_type = 'error'),
acks AS (SELECT id AS alert_id, ts + INTERVAL 1 HOUR AS ts FROM alerts WHERE id % 4 = 0),
deliveries AS (SELECT id AS alert_id, channel, channel || '-' || CAST(id % 3 AS VARCHAR) AS endpoint, ts, severity, id % 7 <> 0 AS success,
    CASE WHEN id % 7 = 0 THEN CASE id % 3 WHEN 0 THEN 500 WHEN 1 THEN 404 ELSE 429 END ELSE 200 END AS status,
    20 + id % 50 AS response_ms, 1 + id % 3 AS attempt FROM alerts, (VALUES ('console'), ('email'), ('webhook')) c(channel))"""


def al(select: str, ctes: str = "") -> str:
    """A query over the alert fixtures."""
    return f"WITH {ALERT_CTES}{', ' + ctes if ctes else ''} {select}"


NOW = f"TIMESTAMP '{AS_OF}'"
