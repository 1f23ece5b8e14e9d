"""Reading logs and keeping events, alerts and acknowledgements as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from palisade.operators.parse import detect_format
from palisade.operators.query import ago, at, retain_alerts
from palisade.schema import ALERTS, EVENT_TYPES, EVENTS, PARSED, SEVERITIES, severity_rank
from palisade.session import truncate_lineage
from palisade.sources.upkeep import replace_days, retain_stored


def scan_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """``line, file, ingest_ts`` of text logs; ingestion time is the file's."""
    lines = spark.read.text(path)
    return lines.select(
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_modification_time").alias("ingest_ts"))


def file_format_vote(spark: SparkSession, path: str, sample: int = 10) -> DataFrame:
    """(file, format): majority format of each file's first lines.

    Lines of a file's first block arrive in order in one task; Spark keeps only
    the first ``sample`` per file there, so nothing else is shuffled.
    """
    lines = spark.read.text(path).select(
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start")).where(F.col("start") == 0)
    placed = lines.withColumn("at", F.monotonically_increasing_id())
    rank = F.row_number().over(Window.partitionBy("file").orderBy("at"))
    first = placed.withColumn("n", rank).where(F.col("n") <= sample)
    votes = first.groupBy("file", detect_format(F.col("line")).alias("format")).agg(F.count("*").alias("votes"))
    best = votes.groupBy("file").agg(F.min_by("format", F.struct(-F.col("votes"), "format")).alias("format"))
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"))
    return files.join(best, "file", "left").select("file", F.coalesce("format", F.lit("Unknown")).alias("format"))


def write_events(events: DataFrame, path: str, row_group_bytes: int = 32 << 20) -> None:
    """Append events, one folder per day, in order of id within a file.

    Row groups have a Bloom filter of their ids, so a lookup by id reads the
    few that may have it, whatever ids look like.
    """
    rows = events.select(*EVENTS.names).sortWithinPartitions("event_date", "id")
    rows.write.mode("append").partitionBy("event_date").option("parquet.bloom.filter.enabled#id", "true").option(
        "parquet.bloom.filter.adaptive.enabled", "true").option("parquet.block.size", row_group_bytes).parquet(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVENTS).parquet(path)


def write_alerts(alerts: DataFrame, path: str) -> None:
    alerts.select(*ALERTS.names).write.mode("append").partitionBy("event_date").parquet(path)


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ALERTS).parquet(path)


def encode_rows(events: DataFrame) -> DataFrame:
    """Events as text rows, the form of an older row store."""
    return events.select(
        F.col("id").cast("string").alias("id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'").alias("timestamp"),
        "source", "severity", "source_ip", "raw_message", F.to_json("parsed").alias("parsed_data"), "event_type",
        F.to_json("iocs").alias("iocs"))


def decode_rows(rows: DataFrame) -> DataFrame:
    """Typed events of text rows; rows that cannot be read are left out."""
    ts = F.coalesce(
        F.try_to_timestamp("timestamp", F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")),
        F.try_to_timestamp("timestamp", F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")))
    out = rows.select(
        F.col("id").try_cast("long").alias("id"), ts.alias("ts"), "source",
        F.when(F.col("severity").isin(*SEVERITIES), F.col("severity")).alias("severity"), "source_ip", "raw_message",
        F.from_json("parsed_data", PARSED).alias("parsed"),
        F.when(F.col("event_type").isin(*EVENT_TYPES), F.col("event_type")).alias("event_type"),
        F.from_json("iocs", T.ArrayType(T.StringType())).alias("iocs"))
    required = ["id", "ts", "source", "severity", "raw_message", "parsed", "event_type", "iocs"]
    return out.dropna(subset=required).select(
        "id", "ts", "source", "severity", severity_rank(F.col("severity")).alias("severity_rank"), "source_ip",
        "raw_message", "parsed", "event_type", "iocs", F.to_date("ts").alias("event_date"))


def migrate_store(source: DataFrame, target_path: str, existing: DataFrame | None) -> None:
    """Append what the target lacks, by id; running it again adds nothing."""
    missing = source if existing is None else source.join(existing.select("id"), "id", "left_anti")
    missing.select(*source.columns).write.mode("append").partitionBy("event_date").parquet(target_path)


def drop_days_before(spark: SparkSession, path: str, day: str) -> int:
    """Remove whole days of stored events before ``day``; returns how many."""
    days = [r[0] for r in read_events(spark, path).where(F.col("event_date") < F.lit(day).cast("date")).select(
        F.date_format("event_date", "yyyy-MM-dd")).distinct().collect()]
    if days:
        replace_days(spark, path, None, days)
    return len(days)


def retain_stored_events(spark: SparkSession, path: str, days: int, as_of=None) -> int:
    """Make a store hold what ``retain_events`` returns of it; returns how many days changed."""
    limit = ago(at(as_of, read_events(spark, path)), days=days)
    return retain_stored(spark, path, EVENTS, F.col("ts") >= limit)


def retain_stored_alerts(spark: SparkSession, path: str, acks: DataFrame, days: int, as_of=None) -> int:
    """Make a store hold what ``retain_alerts`` returns of it; returns how many days changed."""
    alerts = read_alerts(spark, path)
    gone = truncate_lineage(alerts.select("id", "event_date").join(retain_alerts(alerts, acks, days, as_of).select("id"), "id", "left_anti"))
    changed = [str(r[0]) for r in gone.select("event_date").distinct().collect()]
    if changed:
        rest = alerts.where(F.col("event_date").cast("string").isin(changed)).join(gone.select("id"), "id", "left_anti").select(*ALERTS.names)
        replace_days(spark, path, rest, changed)
    return len(changed)
