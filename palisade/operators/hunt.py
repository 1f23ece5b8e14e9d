"""Threat hunts: indicators, volume, techniques, persistence, hypotheses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from palisade.functions.dimensions import LOGIN_PATTERN
from palisade.operators.enrich import ioc_match
from palisade.operators.parse import event_fields
from palisade.operators.query import ago, at, between
from palisade.operators.bruteforce import attempt_outcome
from palisade.plans.running import shared

# Share of findings expected to be harmless, by kind of hunt.
FALSE_POSITIVE = {"IndicatorBased": 0.1, "AnomalyBased": 0.3, "TechniqueBased": 0.2, "APTHunting": 0.25, "HypothesisDriven": 0.4}
# Base priority by severity.
PRIORITY = {"Critical": 9, "High": 7, "Warning": 5, "Medium": 4, "Info": 2, "Low": 1}

#: Columns of a finding: ``evidence`` holds event ids.
FINDING = ["finding_type", "subject", "evidence", "indicators", "systems", "confidence", "severity"]


def _finding(df: DataFrame, kind: str, subject: Column, evidence: Column, indicators: Column, systems: Column,
             confidence: float, severity: Column) -> DataFrame:
    return df.select(
        F.lit(kind).alias("finding_type"), subject.cast("string").alias("subject"), evidence.alias("evidence"),
        indicators.alias("indicators"), systems.alias("systems"), F.lit(confidence).alias("confidence"),
        severity.alias("severity"))


def _newest_ids(events: DataFrame, key: str, k: int) -> DataFrame:
    """(key, evidence): ids of the newest ``k`` events; Spark limits each task's
    share of a key before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("ts"), F.desc("id")))
    top = events.select(key, "ts", "id").withColumn("_n", rank).where(F.col("_n") <= k)
    ordered = F.array_sort(F.collect_list(F.struct("_n", "id")))
    return top.groupBy(key).agg(F.transform(ordered, lambda e: e["id"]).alias("evidence"))


def hunt_indicators(events: DataFrame, indicators: DataFrame, severity: str = "Critical") -> DataFrame:
    hits = ioc_match(events, indicators).withColumnRenamed("indicators", "_found")
    found = events.join(hits, "id")
    return _finding(found, "IOC Match", F.col("id"), F.array("id"), F.col("_found"), F.array("source"), 0.8, F.lit(severity))


def hunt_anomalies(events: DataFrame, more_than: int = 100) -> DataFrame:
    busy = events.groupBy("source").agg(F.count("*").alias("n")).where(F.col("n") > more_than)
    found = busy.join(_newest_ids(events, "source", 5), "source")
    return _finding(
        found, "Anomalous Activity", F.col("source"), F.col("evidence"), F.array(F.lit("high_event_volume")),
        F.array("source"), 0.7, F.lit("Warning"))


def techniques_of(message: Column, techniques: list[str]) -> Column:
    """The techniques, of those asked for, that a message shows."""
    has = message.contains
    shows = {
        "T1190": has("HTTP") & (has("UNION") | has("<script>") | has("../")),
        "T1110": has("Failed") & has("login"),
        "T1059": has("<script>") | has("javascript:"),
    }
    return F.array_compact(F.array(*[F.when(shows[t], F.lit(t)) for t in techniques if t in shows]))


def hunt_techniques(events: DataFrame, techniques: list[str], severity: str = "High") -> DataFrame:
    found = events.withColumn("_t", techniques_of(F.col("raw_message"), techniques)).where(F.size("_t") > 0)
    return _finding(found, "MITRE Technique Match", F.col("id"), F.array("id"), F.col("_t"), F.array("source"), 0.75, F.lit(severity))


def hunt_apt(events: DataFrame, more_than: int = 20, sources: int = 3) -> DataFrame:
    known = events.where(F.col("source_ip").isNotNull())
    per_source = known.groupBy("source_ip", "source").agg(F.count("*").alias("n"))
    wide = per_source.groupBy("source_ip").agg(
        F.sum("n").alias("n"), F.array_sort(F.collect_list("source")).alias("systems"),
    ).where((F.col("n") > more_than) & (F.size("systems") > sources))
    found = wide.join(_newest_ids(known, "source_ip", 10), "source_ip")
    return _finding(
        found, "APT Behavior Pattern", F.col("source_ip"), F.col("evidence"),
        F.array(F.lit("multi_system_access"), F.lit("high_activity_volume")), F.col("systems"), 0.65, F.lit("High"))


def hunt_hypothesis(events: DataFrame) -> DataFrame:
    """Possible data exfiltration outside working hours."""
    m = F.col("raw_message")
    late = (F.hour("ts") >= 21) | (F.hour("ts") <= 7)
    found = events.where(late & (m.contains("download") | m.contains("export") | (F.octet_length(m) > 500)))
    return _finding(
        found, "Data Exfiltration Hypothesis", F.col("id"), F.array("id"),
        F.array(F.lit("off_hours_activity"), F.lit("data_transfer")), F.array("source"), 0.6, F.lit("High"))


def findings_of(events: DataFrame, hunt: dict, indicators: DataFrame, as_of=None) -> DataFrame:
    """Findings of one hunt within its window.  ``hunt``: hunt_type,
    techniques, severity, window_hours."""
    now = at(as_of, events)
    inside = events.where(F.col("ts").between(ago(now, hours=hunt["window_hours"]), now))
    kind = hunt["hunt_type"]
    if kind == "IndicatorBased":
        return hunt_indicators(inside, indicators, hunt["severity"])
    if kind == "AnomalyBased":
        return hunt_anomalies(inside)
    if kind == "TechniqueBased":
        return hunt_techniques(inside, hunt["techniques"], hunt["severity"])
    if kind == "APTHunting":
        return hunt_apt(inside)
    return hunt_hypothesis(inside)


def run_hunt(events: DataFrame, hunt: dict, indicators: DataFrame, as_of=None) -> DataFrame:
    """One row: matches, mean confidence, level, false-positive share, priority."""
    found = findings_of(events, hunt, indicators, as_of).agg(
        F.count("*").alias("matches_found"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("confidence"))
    c = F.round("confidence", 9)  # a mean of equal values must compare as the value
    level = F.when(c >= 0.8, "HIGH").when(c >= 0.6, "MEDIUM").when(c >= 0.4, "LOW").otherwise("MINIMAL")
    priority = F.least(F.lit(10), PRIORITY[hunt["severity"]] + F.floor(c * 2)).cast("int")
    return found.select(
        F.lit(hunt["id"]).alias("hunt_id"), F.lit(hunt["name"]).alias("name"), "matches_found", "confidence",
        level.alias("risk_level"), F.lit(FALSE_POSITIVE[hunt["hunt_type"]]).alias("false_positive_likelihood"),
        priority.alias("priority"))


def run_hunts(events: DataFrame, hunts: list[dict], indicators: DataFrame, as_of=None) -> DataFrame:
    """A row per hunt.  The events of the widest window are read once and shared; stored events are pruned by day."""
    now = at(as_of, events)
    widest = max(h["window_hours"] for h in hunts)
    inside = shared(between(events, ago(now, hours=widest), now).select("id", "ts", "source", "source_ip", "raw_message"))
    out = None
    for hunt in hunts:
        one = run_hunt(inside, hunt, indicators, as_of)
        out = one if out is None else out.unionByName(one)
    return out


def hunt_catalog(hunts: DataFrame, events: DataFrame, as_of=None) -> DataFrame:
    """Hunts with the number of events their window covers now."""
    now = at(as_of, events)
    hours = F.ceil((F.unix_micros(now) - F.unix_micros("ts")) / 3_600_000_000)
    ages = events.where(F.col("ts") <= now).groupBy(hours.alias("age")).agg(F.count("*").alias("n"))
    covered = hunts.join(ages, F.col("age") <= F.col("window_hours"), "left")
    return covered.groupBy(*[c for c in hunts.columns]).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("events_in_window"))


def behavior_baseline(events: DataFrame, trailing_hours: int = 24) -> DataFrame:
    """Logins per hour against the trailing hours and the login pattern."""
    logins = event_fields(events).where(F.col("username").isNotNull()).select(
        F.date_trunc("hour", "ts").alias("hour"), attempt_outcome(F.col("status"), F.col("raw_message")).alias("ok"))
    hourly = logins.groupBy("hour").agg(F.count("*").alias("logins"), F.count_if(~F.col("ok")).alias("failed"))
    # one row per hour: small enough for one ordered window
    before = Window.partitionBy(F.lit(0)).orderBy("hour").rowsBetween(-trailing_hours, -1)
    out = hourly.withColumns({
        "mean": F.avg("logins").over(before), "sigma": F.stddev_pop("logins").over(before),
        "failed_rate": F.col("failed") / F.col("logins"),
    })
    z = F.when(F.col("sigma") > 0, (F.col("logins") - F.col("mean")) / F.col("sigma")).otherwise(F.lit(0.0))
    return out.withColumn("z_score", z).withColumns({
        "is_anomalous": F.abs("z_score") > LOGIN_PATTERN["sigmas"],
        "over_peak": F.col("logins") > LOGIN_PATTERN["peak_hour_logins"],
        "failing": F.col("failed_rate") > LOGIN_PATTERN["failed_login_rate"],
    })
