"""Log lines to typed events, as projections only."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from palisade.functions import rules as R
from palisade.functions.text import (
    captures, contains_any, extract_ip, let, settle, words_found,
)
from palisade.schema import PARSED, severity_rank

_APACHE = rf"(?s)^(?:{R.APACHE_COMBINED}|{R.APACHE_COMMON}).*$"
_NGINX = rf"(?s)^(?:.*?{R.NGINX_CUSTOM}.*|{R.NGINX_ACCESS}|{R.NGINX_ERROR})$"
_SSH = r"(?is)^.*?" + R.SSH_AUTH.removeprefix("(?i)") + r".*$"
_GROUPS = {"apache": 16, "nginx": 30, "ssh": 4}

#: Where each line kind keeps its fields among the captured groups.
_LAYOUT = {
    "apache_combined": dict(ip=0, time=1, method=2, path=3, protocol=4, status=5, size=6, referer=7, user_agent=8),
    "apache_common": dict(ip=9, time=10, method=11, path=12, protocol=13, status=14, size=15),
    "nginx_custom": dict(
        ip=0, time=1, request_line=2, status=3, body_bytes=4, referer=5, user_agent=6, response_time=7,
        upstream_connect_time=8, upstream_header_time=9, upstream_response_time=10),
    "nginx_access": dict(
        ip=11, user=12, time=13, request_line=14, status=15, body_bytes=16, referer=17, user_agent=18,
        forwarded_for=19, request_time=20),
    "nginx_error": dict(
        time=21, log_level=22, pid=23, tid=24, message=25, ip=26, server=27, request=28, host=29),
    "ssh_auth": dict(auth_outcome=0, auth_method=1, user=2),
}

_FIELDS = sorted({field for layout in _LAYOUT.values() for field in layout})


class LineParser(NamedTuple):
    """A parser of one's own: which lines it claims, and what it reads in them."""

    claims: Callable[[Column], Column]
    read: Callable[[Column], dict[str, Column]]


_OWN_PARSERS: dict[str, LineParser] = {}


def register_parser(name: str, claims: Callable[[Column], Column], read: Callable[[Column], dict[str, Column]]) -> None:
    """Let ``parse_logs`` read lines that ``claims`` accepts with ``read``, ahead of the formats it knows.

    ``read`` gives column expressions for any of ``ts, severity, source_ip,
    event_type, iocs`` and the fields of ``parsed``; what it leaves out is as for a
    line of no known format.  The event's source is ``name``.
    """
    _OWN_PARSERS[name] = LineParser(claims, read)


def unregister_parser(name: str) -> None:
    _OWN_PARSERS.pop(name, None)


def detect_format(line: Column) -> Column:
    """Apache, Nginx, Ssh, Syslog, Json or Unknown; the first test that holds."""
    bare = F.trim(line)
    return (
        F.when(line.contains("[") & line.contains("]") & line.like('%"%"%'), "Apache")
        .when(line.contains("nginx") | (line.contains(" - ") & line.contains(" [")), "Nginx")
        .when(line.contains("ssh") | line.contains("SSH"), "Ssh")
        .when(line.rlike(R.SYSLOG_HEAD), "Syslog")
        .when(bare.startswith("{") & bare.endswith("}"), "Json")
        .otherwise("Unknown")
    )


def _syslog_ts(line: Column, ingest_ts: Column) -> Column:
    """Syslog stamps carry no year: take the one of ingestion."""
    head = F.regexp_replace(F.regexp_extract(line, R.SYSLOG_HEAD, 0), r"\s+", " ")
    return F.try_to_timestamp(
        F.concat_ws(" ", F.year(ingest_ts).cast("string"), head), F.lit("yyyy MMM d HH:mm:ss")
    )


def _first_ts(text: Column, *formats: str) -> Column:
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def extract_ts(line: Column, fmt: Column, ingest_ts: Column) -> Column:
    """Event time by line format; ``ingest_ts`` when nothing can be read."""
    bracket = F.regexp_extract(line, r"\[([^\]]+)\]", 1)
    iso = F.regexp_extract(line, r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}", 0)
    day = F.regexp_extract(line, r"\d{2}/\w{3}/\d{4}:\d{2}:\d{2}:\d{2}", 0)
    fields = [
        _first_ts(
            F.get_json_object(line, path),
            "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]'Z'", "yyyy-MM-dd HH:mm:ss", "dd/MM/yyyy HH:mm:ss",
        )
        for path in ("$.timestamp", "$.time", "$['@timestamp']", "$.datetime", "$.date")
    ]
    return F.coalesce(
        F.when(fmt == "Apache", _first_ts(bracket, "dd/MMM/yyyy:HH:mm:ss Z", "dd/MMM/yyyy:HH:mm:ss"))
        .when(fmt == "Nginx", F.coalesce(
            F.try_to_timestamp(iso, F.lit("yyyy-MM-dd'T'HH:mm:ss")),
            F.try_to_timestamp(day, F.lit("dd/MMM/yyyy:HH:mm:ss"))))
        .when(fmt.isin("Ssh", "Syslog"), _syslog_ts(line, ingest_ts))
        .when(fmt == "Json", F.coalesce(*fields)),
        ingest_ts,
    )


def loglevel_severity(level: Column) -> Column:
    return (
        F.when(level.isin("Emergency", "Alert", "Critical", "Error"), "Critical")
        .when(level.isin("Warning", "Notice"), "Warning")
        .when(level.isin("Info", "Debug"), "Info")
    )


def classify_event_type(line: Column) -> Column:
    """Event type from substrings of the lower-cased line; first group wins."""

    def pick(low):
        chain = F
        for event_type, words in R.EVENT_TYPE_WORDS:
            chain = chain.when(contains_any(low, words), event_type)
        return chain.otherwise("Normal")

    return let(F.lower(line), pick)


def apache_severity(status: Column, path: Column) -> Column:
    return (
        F.when(status.between(500, 599), "Critical")
        .when((status == 404) & path.contains("admin"), "Warning")
        .when(status == 403, "Warning")
        .otherwise("Info")
    )


def apache_event_type(method: Column, path: Column, status: Column) -> Column:
    return let(F.lower(path), lambda low: (
        F.when(contains_any(low, R.APACHE_SQL_WORDS), "SqlInjection")
        .when(contains_any(low, R.APACHE_XSS_WORDS), "XssAttempt")
        .when((method == "POST") & (status == 401), "BruteForce")
        .otherwise("Normal")
    ))


def apache_iocs(path: Column, user_agent: Column) -> Column:
    return words_found(_request_text(path, user_agent), R.APACHE_IOCS)


def _request_text(*parts: Column) -> Column:
    return F.lower(F.concat_ws(" ", *[F.coalesce(p, F.lit("-")) for p in parts]))


def split_request(request: Column) -> Column:
    """``struct<method, path, protocol>`` of a request line."""

    def fields(parts):
        n = F.size(parts)
        return F.struct(
            F.when(n >= 2, F.get(parts, F.lit(0))).when(n == 1, "GET").otherwise("UNKNOWN").alias("method"),
            F.when(n >= 2, F.get(parts, F.lit(1))).when(n == 1, F.get(parts, F.lit(0))).otherwise("-").alias("path"),
            F.when(n >= 3, F.get(parts, F.lit(2))).when(n >= 1, "HTTP/1.0").otherwise("-").alias("protocol"),
        )

    return let(F.filter(F.split(request, r"\s+"), lambda p: p != ""), fields)


def nginx_status_severity(status: Column) -> Column:
    return (
        F.when(status.between(500, 599), "Critical")
        .when(status.isin(401, 403, 429), "Warning")
        .when(status.between(200, 499), "Info")
        .otherwise("Warning")
    )


def nginx_level_severity(level: Column) -> Column:
    low = F.lower(level)
    return (
        F.when(low.isin("emerg", "emergency", "alert", "crit", "critical", "err", "error"), "Critical")
        .when(low.isin("warn", "warning", "notice"), "Warning")
        .otherwise("Info")
    )


def nginx_iocs(path: Column, user_agent: Column, method: Column) -> Column:
    """Attack substrings, then scanner user agents, then unusual methods."""
    agent = F.lower(F.coalesce(user_agent, F.lit("")))
    return F.concat(
        words_found(_request_text(path, user_agent, method), R.NGINX_IOCS),
        words_found(agent, R.NGINX_TOOL_AGENTS, "suspicious_user_agent:"),
        F.array_compact(F.array(*[
            F.when(F.upper(method) == m, F.lit("suspicious_method:" + m)) for m in R.NGINX_RISKY_METHODS
        ])),
    )


def nginx_error_iocs(message: Column, request: Column) -> Column:
    return words_found(_request_text(message, request), R.NGINX_ERROR_IOCS, "error_pattern:")


def can_parse(line: Column) -> Column:
    """``struct<apache, nginx, ssh>``: which parsers could read the line."""
    return F.struct(
        line.rlike("^" + R.APACHE_COMMON).alias("apache"),
        (
            line.contains("nginx") | line.rlike(_NGINX)
            | (line.contains("[") & line.contains("]") & line.contains('"') & line.contains(" - "))
        ).alias("nginx"),
        line.contains("ssh").alias("ssh"),
    )


def _dash_to_null(value: Column) -> Column:
    return F.when(~value.isin("", "-"), value)


#: Marks the kind of a line that a registered parser claims.
_OWN = "own:"


def with_line_id(lines: DataFrame) -> DataFrame:
    """Add ``id``: a hash of the file, the line and which of its equal lines in that file it is.

    Equal lines are interchangeable, so any numbering of them gives the same
    set of ids, and a file that is read again the same ids.  Numbering shuffles
    by file and line; a group is the equal lines of one file.  A stream can't
    number across its batches: there a random part, drawn anew by a batch that
    runs again, keeps equal lines apart.  Without ``file`` the time of
    ingestion stands in.
    """
    place = "file" if "file" in lines.columns else "ingest_ts"
    if lines.isStreaming:
        return lines.withColumn("id", F.xxhash64(place, "line", F.uuid()))
    nth = F.row_number().over(Window.partitionBy(place, "line").orderBy(place))
    return lines.withColumn("id", F.xxhash64(place, "line", nth))


def parse_logs(lines: DataFrame, parser: str | Column | None = None) -> DataFrame:
    """Read every line with the parser of its format.

    ``lines`` has ``line`` and ``ingest_ts``, may carry ``id`` (else ``line_id``
    makes one) and ``source_type`` (a format that overrides detection, for logs
    whose origin is known by path).  ``parser`` forces one parser.  Works on a
    table and on a stream.
    """
    fmt = detect_format(F.col("line"))
    if parser is not None:
        fmt = F.lit(parser) if isinstance(parser, str) else parser
    elif "source_type" in lines.columns:
        fmt = F.coalesce(F.col("source_type"), fmt)
    if "id" not in lines.columns:
        lines = with_line_id(lines)
    row_id = F.col("id")
    line = F.col("line")

    def cleaned(groups: Column) -> Column:
        return F.transform(groups, lambda x: F.when(~x.isin("", "-"), x))

    base = lines.select(
        row_id.alias("id"), "line", "ingest_ts",
        F.when(fmt == "Nginx", "nginx").when(fmt == "Ssh", "ssh").otherwise("apache").alias("_parser"),
    )
    base = base.withColumn(
        "_g",
        cleaned(
            F.when(F.col("_parser") == "nginx", captures(line, _NGINX, _GROUPS["nginx"]))
            .when(F.col("_parser") == "ssh", captures(line, _SSH, _GROUPS["ssh"]))
            .otherwise(captures(line, _APACHE, _GROUPS["apache"]))
        ),
    )

    def starts(parser_name: str, layout: str, mark: str) -> Column:
        """The line matched, through the alternative whose ``mark`` is set."""
        return (
            (F.col("_parser") == parser_name)
            & (F.size("_g") == _GROUPS[parser_name] + 1)
            & F.get("_g", F.lit(_LAYOUT[layout][mark])).isNotNull()
        )

    own = F
    for name, reader in _OWN_PARSERS.items():
        own = own.when(reader.claims(line), F.lit(_OWN + name))
    base = base.withColumn(
        "_kind",
        own.when(starts("apache", "apache_combined", "time"), "apache_combined")
        .when(starts("apache", "apache_common", "time"), "apache_common")
        .when(F.col("_parser") == "apache", "apache_unknown")
        .when(starts("nginx", "nginx_custom", "time"), "nginx_custom")
        .when(starts("nginx", "nginx_access", "time"), "nginx_access")
        .when(starts("nginx", "nginx_error", "time"), "nginx_error")
        .when(F.col("_parser") == "nginx", "nginx_generic")
        .when(starts("ssh", "ssh_auth", "auth_outcome"), "ssh_auth")
        .otherwise("ssh"),
    )

    kind = F.col("_kind")
    places = F
    for k, layout in _LAYOUT.items():
        order = ",".join(str(layout.get(f, -1)) for f in _FIELDS)
        places = places.when(kind == k, F.expr(f"array({order})"))
    base = base.withColumn("_f", F.transform(places, lambda i: F.get("_g", i)))

    def group(field: str) -> Column:
        return F.get("_f", F.lit(_FIELDS.index(field)))

    direct = [f for f in _FIELDS if f not in ("status", "request_line", "time", "method", "path", "protocol")]
    base = base.select(
        "id", "line", "ingest_ts", "_kind",
        *[group(f).alias(f) for f in direct],
        group("status").cast("int").alias("status_code"),
        group("time").alias("_time"),
        *[group(f).alias("_" + f) for f in ("method", "path", "protocol")],
        F.when(kind.isin("nginx_custom", "nginx_access"), split_request(
            F.coalesce(group("request_line"), F.lit("")))).alias("_req"),
    )
    base = base.withColumns({
        f: _dash_to_null(F.coalesce(F.col("_" + f), F.col("_req." + f))) for f in ("method", "path", "protocol")
    })
    return _to_events(base)


def _to_events(base: DataFrame) -> DataFrame:
    kind, line = F.col("_kind"), F.col("line")
    is_apache = kind.isin("apache_combined", "apache_common")
    is_request = kind.isin("nginx_custom", "nginx_access")
    is_nginx = kind.startswith("nginx")

    ts = F.coalesce(
        F.when(is_apache, F.try_to_timestamp("_time", F.lit("dd/MMM/yyyy:HH:mm:ss Z")))
        .when(is_request, _first_ts(
            F.col("_time"), "dd/MMM/yyyy:HH:mm:ss Z", "dd/MMM/yyyy:HH:mm:ss", "yyyy/MM/dd HH:mm:ss",
            "dd-MMM-yyyy HH:mm:ss"))
        .when(kind == "nginx_error", F.try_to_timestamp("_time", F.lit("yyyy/MM/dd HH:mm:ss")))
        .when(kind.startswith("ssh"), _syslog_ts(line, F.col("ingest_ts"))),
        F.col("ingest_ts"),
    )
    severity = (
        F.when(is_apache, apache_severity(F.col("status_code"), F.col("path")))
        .when(is_request, nginx_status_severity(F.col("status_code")))
        .when(kind == "nginx_error", nginx_level_severity(F.col("log_level")))
        .otherwise("Info")
    )
    event_type = (
        F.when(is_apache, apache_event_type(F.col("method"), F.col("path"), F.col("status_code")))
        .when(is_nginx, classify_event_type(line))
        .otherwise("Normal")
    )
    iocs = (
        F.when(is_apache, apache_iocs(
            F.col("path"), F.when(kind == "apache_combined", F.col("user_agent")).otherwise("")))
        .when(is_request, nginx_iocs(F.col("path"), F.col("user_agent"), F.col("method")))
        .when(kind == "nginx_error", nginx_error_iocs(F.col("message"), F.col("request")))
        .otherwise(F.array().cast("array<string>"))
    )
    source_ip = (
        F.when(kind == "nginx_generic", extract_ip(line))
        .when(kind.startswith("ssh"), F.nullif(F.regexp_extract(line, R.DOTTED_QUAD, 1), F.lit("")))
        .otherwise(F.col("ip"))
    )
    log_format = (
        F.when(kind == "apache_combined", "combined").when(kind == "apache_common", "common")
        .when(kind == "apache_unknown", "unknown").when(kind == "nginx_generic", "generic")
    )
    log_type = F.when(kind.isin("nginx_access", "nginx_custom", "nginx_error"), F.replace(kind, F.lit("nginx_"), F.lit("")))
    derived = {"format": log_format, "log_type": log_type, "auth_outcome": F.lower("auth_outcome")}
    parsed = F.struct(*[
        derived.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in PARSED.fields
    ])
    source = F.when(is_apache, "apache").when(kind.startswith("ssh"), "ssh").otherwise(F.regexp_replace(kind, f"^{_OWN}", ""))
    for name, reader in _OWN_PARSERS.items():
        mine, read = kind == _OWN + name, reader.read(line)
        ts, severity, source_ip, event_type, iocs = (
            F.when(mine, F.coalesce(read[c], old) if c != "source_ip" else read[c]).otherwise(old) if c in read else old
            for c, old in (("ts", ts), ("severity", severity), ("source_ip", source_ip), ("event_type", event_type), ("iocs", iocs)))
        parsed = F.when(mine, F.struct(*[
            read.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in PARSED.fields])).otherwise(parsed)
    out = base.select(
        "id", ts.alias("ts"), source.alias("source"), severity.alias("severity"),
        source_ip.alias("source_ip"), F.col("line").alias("raw_message"), parsed.alias("parsed"),
        event_type.alias("event_type"), iocs.alias("iocs"),
    )
    # columns are settled so that filters on events never repeat the parser
    out = out.select("id", "raw_message", *[
        settle(F.col(c)).alias(c) for c in ("ts", "source", "severity", "source_ip", "parsed", "event_type", "iocs")
    ])
    return out.select(
        "id", "ts", "source", "severity", severity_rank(F.col("severity")).alias("severity_rank"),
        "source_ip", "raw_message", "parsed", "event_type", "iocs", F.to_date("ts").alias("event_date"),
    )


def _usable(value: Column) -> Column:
    return F.when(~value.isin("", "-"), value)


def event_fields(events: DataFrame) -> DataFrame:
    """Username, user agent, status and service of each event."""
    return events.withColumns({
        "username": username(events), "user_agent": user_agent(events),
        "status": F.col("parsed.status_code"), "service": service_of(F.col("source")),
    })


def _first_present(events: DataFrame, names: list[str]) -> Column:
    have = set(events.schema["parsed"].dataType.names)
    return F.coalesce(*[_usable(F.col(f"parsed.{n}")) for n in names if n in have])


def username(events: DataFrame) -> Column:
    return _first_present(events, ["user", "username", "login", "email", "account"])


def user_agent(events: DataFrame) -> Column:
    return _first_present(events, ["user_agent", "useragent", "ua"])


def service_of(source: Column) -> Column:
    return (
        F.when(source.contains("apache"), "apache").when(source.contains("nginx"), "nginx")
        .when(source.contains("ssh"), "ssh").when(source.contains("ftp"), "ftp")
        .when(source.contains("mysql") | source.contains("postgres"), "database")
        .otherwise("web")
    )
