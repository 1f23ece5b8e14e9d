"""Schemas and ordered vocabularies of the event model."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

# Severities in rank order 0..5.
SEVERITIES = ["Low", "Info", "Medium", "Warning", "High", "Critical"]

# Event types and the names reports show for them.
EVENT_TYPES = ["Normal", "SqlInjection", "XssAttempt", "BruteForce", "Anomaly", "SuspiciousActivity"]
EVENT_TYPE_LABELS = {
    "SqlInjection": "SQL Injection",
    "XssAttempt": "XSS Attempt",
    "BruteForce": "Brute Force",
    "Anomaly": "Anomaly Detection",
    "Normal": "Normal Activity",
    "SuspiciousActivity": "Suspicious Activity",
}

#: Parsed fields in alphabetical order, the order they take in the JSON text
#: that the payload detectors read.
PARSED = T.StructType(
    [
        T.StructField("auth_method", T.StringType()),
        T.StructField("auth_outcome", T.StringType()),
        T.StructField("body_bytes", T.StringType()),
        T.StructField("format", T.StringType()),
        T.StructField("forwarded_for", T.StringType()),
        T.StructField("host", T.StringType()),
        T.StructField("ip", T.StringType()),
        T.StructField("log_level", T.StringType()),
        T.StructField("log_type", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("method", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("pid", T.StringType()),
        T.StructField("protocol", T.StringType()),
        T.StructField("referer", T.StringType()),
        T.StructField("request", T.StringType()),
        T.StructField("request_time", T.StringType()),
        T.StructField("response_time", T.StringType()),
        T.StructField("server", T.StringType()),
        T.StructField("size", T.StringType()),
        T.StructField("status_code", T.IntegerType()),
        T.StructField("tid", T.StringType()),
        T.StructField("upstream_connect_time", T.StringType()),
        T.StructField("upstream_header_time", T.StringType()),
        T.StructField("upstream_response_time", T.StringType()),
        T.StructField("user", T.StringType()),
        T.StructField("user_agent", T.StringType()),
    ]
)
PARSED_FIELDS = [f.name for f in PARSED.fields]

EVENTS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("source", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("severity_rank", T.IntegerType()),
        T.StructField("source_ip", T.StringType()),
        T.StructField("raw_message", T.StringType()),
        T.StructField("parsed", PARSED),
        T.StructField("event_type", T.StringType()),
        T.StructField("iocs", T.ArrayType(T.StringType())),
        T.StructField("event_date", T.DateType()),
    ]
)

ALERTS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("severity", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("related_events", T.ArrayType(T.LongType())),
        T.StructField("mitigation_steps", T.ArrayType(T.StringType())),
        T.StructField("event_date", T.DateType()),
    ]
)


def severity_rank(severity: Column) -> Column:
    """0 (Low) .. 5 (Critical); NULL for an unknown name."""
    return F.nullif(
        F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity), F.lit(0)
    ).cast("int") - F.lit(1)


def epoch_us(ts: Column) -> Column:
    return F.unix_micros(ts)
