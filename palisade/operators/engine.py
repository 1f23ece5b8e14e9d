"""All detectors together, their combined risk, and the alerts they raise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from palisade.operators.bruteforce import attempts, bf_detect, bf_profile
from palisade.operators.payload import detection_text, sqli_detect, xss_detect
from palisade.plans.running import shared
from palisade.session import truncate_lineage

# Weight of each detector in the combined risk.
WEIGHTS = {"sqli": 0.3, "xss": 0.25, "brute_force": 0.25, "anomaly": 0.2}


def combine_risk(**scores: Column) -> Column:
    """Weighted mean of the detectors that ran, within 0..1.

    A NULL score means the detector did not run on the event.
    """
    total, weight = F.lit(0.0), F.lit(0.0)
    for name, score in scores.items():
        total = total + F.coalesce(score * WEIGHTS[name], F.lit(0.0))
        weight = weight + F.when(score.isNotNull(), F.lit(WEIGHTS[name])).otherwise(F.lit(0.0))
    return F.when(weight > 0, F.greatest(F.least(total / weight, F.lit(1.0)), F.lit(0.0))).otherwise(F.lit(0.0))


def detect_payloads(events: DataFrame) -> DataFrame:
    """The detectors that need one event at a time; for tables and streams."""
    text = events.withColumn("_input", detection_text(events))
    found = sqli_detect(text, F.col("_input"))
    return xss_detect(found, F.col("_input")).drop("_input")


def detect_all(
    events: DataFrame, *, brute_force: bool = True, auth_only: bool = False, anomaly: DataFrame | None = None,
) -> DataFrame:
    """One row per event: sqli, xss, brute_force, anomaly, has_threats, risk_score.

    ``anomaly`` (id, is_anomaly, anomaly_score) comes from a fitted model.  The
    message texts stay behind: only verdicts meet in the joins by id.
    """
    if brute_force:
        events = shared(events)  # the payload path and the histories both read it
    out = detect_payloads(events).select("id", "ts", "source", "source_ip", "severity", "event_type", "sqli", "xss")
    out = out.withColumns({
        "brute_force": F.lit(None).cast("struct<detected:boolean,confidence:double,risk_level:string>"),
        "anomaly": F.lit(None).cast("struct<detected:boolean,score:double>"),
    })
    if brute_force:
        tries = truncate_lineage(attempts(events, auth_only))  # read by many steps
        scored = bf_detect(bf_profile(tries)).select(
            "id", F.struct("detected", "confidence", "risk_level").alias("brute_force"))
        out = out.drop("brute_force").join(scored, "id", "left")
    if anomaly is not None:
        scored = anomaly.select("id", F.struct(
            F.col("is_anomaly").alias("detected"), F.col("anomaly_score").alias("score")).alias("anomaly"))
        out = out.drop("anomaly").join(scored, "id", "left")
    return with_risk(out)


def with_risk(detections: DataFrame) -> DataFrame:
    flags = [F.coalesce(F.col(f"{d}.detected"), F.lit(False)) for d in ("sqli", "xss", "brute_force", "anomaly")]
    return detections.withColumns({
        "has_threats": flags[0] | flags[1] | flags[2] | flags[3],
        "risk_score": combine_risk(
            sqli=F.col("sqli.confidence"), xss=F.col("xss.confidence"),
            brute_force=F.col("brute_force.confidence"), anomaly=F.col("anomaly.score")),
    })


def risk_severity(risk: Column) -> Column:
    return F.when(risk >= 0.8, "Critical").when(risk >= 0.6, "Warning").otherwise("Info")


def generate_alerts(detections: DataFrame, min_risk: float | None = 0.7) -> DataFrame:
    """Alerts for threats of at least ``min_risk``.

    With ``min_risk=None`` every threat alerts, at its event's own severity.
    """
    threats = detections.where("has_threats")
    if min_risk is None:
        severity = F.col("severity")
    else:
        threats, severity = threats.where(F.col("risk_score") >= min_risk), risk_severity(F.col("risk_score"))
    names = {"sqli": "SQL Injection", "xss": "XSS Attack", "brute_force": "Brute Force", "anomaly": "Anomaly"}
    lines = [
        F.when(F.col(f"{d}.detected"), F.format_string(
            f"- {n} detected (Confidence: %.2f)", F.col(f"{d}.{'score' if d == 'anomaly' else 'confidence'}")))
        for d, n in names.items()
    ]
    return threats.select(
        F.col("id"), "ts", severity.alias("severity"),
        F.concat(F.lit("Security Threat Detected from "), F.coalesce("source_ip", F.lit("Unknown"))).alias("title"),
        F.concat_ws("\n", F.format_string("Risk Score: %.2f", "risk_score"), *lines).alias("description"),
        F.array("id").alias("related_events"),
        F.array_distinct(F.concat(
            F.coalesce("sqli.mitigations", F.array().cast("array<string>")),
            F.coalesce("xss.mitigations", F.array().cast("array<string>")))).alias("mitigation_steps"),
        F.to_date("ts").alias("event_date"),
    )
