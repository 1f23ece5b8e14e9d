"""Security-log views derived from the given tables.

The SQL of ``LOG_LINES`` is valid in Spark and in DuckDB, so the engine and
its oracle read the same lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from palisade.functions.text import settle
from palisade.operators.parse import parse_logs

AS_OF = "2024-01-31 00:00:00"
#: The smallest split of a scan, and the rows that a task gets at most.
SPLIT_BYTES, TASK_ROWS = 4 * 1024 * 1024, 65_536

LOG_LINES = """
WITH e AS (
  SELECT event_id, ts, user_id, event_type,
    CASE user_id % 5 WHEN 0 THEN '203.0.113.' || CAST(40 + user_id % 20 AS STRING)
                     WHEN 1 THEN '46.10.0.'   || CAST(user_id % 20 AS STRING)
                     WHEN 2 THEN '27.5.1.'    || CAST(user_id % 20 AS STRING)
                     WHEN 3 THEN '192.168.1.' || CAST(user_id % 20 AS STRING)
                     ELSE        '175.45.176.' || CAST(user_id % 20 AS STRING) END AS ip,
    CASE WHEN event_type = 'error' THEN CASE event_id % 3 WHEN 0 THEN 401 WHEN 1 THEN 500 ELSE 404 END
         WHEN event_type = 'signup' THEN 201 ELSE 200 END AS status,
    CASE WHEN event_type IN ('click', 'view') THEN 'GET' ELSE 'POST' END AS method,
    CASE (event_id + user_id) % 20 WHEN 0 THEN '/search?q=1%27%20UNION%20SELECT%20*%20FROM%20users--'
                       WHEN 1 THEN '/search?q=%3Cscript%3Ealert(1)%3C/script%3E'
                       WHEN 2 THEN '/../../etc/passwd'
                       WHEN 3 THEN '/admin'
                       WHEN 4 THEN '/login?user=admin&id=' || CAST(user_id AS STRING)
                       ELSE '/api/items/' || CAST(event_id % 97 AS STRING) END AS path,
    CASE event_id % 4 WHEN 0 THEN 'Mozilla/5.0 (X11; Linux x86_64)' WHEN 1 THEN 'curl/7.68.0'
                      WHEN 2 THEN 'sqlmap/1.0' ELSE 'python-requests/2.0' END AS ua,
    CAST(CAST(floor(value * 10) AS BIGINT) AS STRING) AS bytes,
    lpad(CAST(day(ts) AS STRING), 2, '0') AS dd,
    lpad(CAST(hour(ts) AS STRING), 2, '0') || ':' || lpad(CAST(minute(ts) AS STRING), 2, '0') || ':'
      || lpad(CAST(CAST(floor(second(ts)) AS INT) AS STRING), 2, '0') AS hms
  FROM events)
SELECT event_id, ts AS ingest_ts, user_id,
  CASE event_id % 5
    WHEN 0 THEN ip || ' - - [' || dd || '/Jan/2024:' || hms || ' +0000] "' || method || ' ' || path || ' HTTP/1.1" ' || CAST(status AS STRING) || ' ' || bytes
    WHEN 1 THEN ip || ' - - [' || dd || '/Jan/2024:' || hms || ' +0000] "' || method || ' ' || path || ' HTTP/1.1" ' || CAST(status AS STRING) || ' ' || bytes || ' "-" "' || ua || '"'
    WHEN 2 THEN ip || ' - user' || CAST(user_id AS STRING) || ' [' || dd || '/Jan/2024:' || hms || ' +0000] "' || method || ' ' || path || ' HTTP/1.1" ' || CAST(status AS STRING) || ' ' || bytes || ' "http://example.com" "' || ua || '" rt=0.250 uct="0.001" uht="0.010" urt="0.240"'
    WHEN 3 THEN '2024/01/' || dd || ' ' || hms || ' [error] 1234#0: *5 open() failed (2: No such file or directory), client: ' || ip || ', server: example.com, request: "' || method || ' ' || path || ' HTTP/1.1", host: "example.com"'
    ELSE 'Jan ' || dd || ' ' || hms || ' host sshd[99]: ' || CASE WHEN event_type = 'error' THEN 'Failed' ELSE 'Accepted' END || ' password for user' || CAST(user_id AS STRING) || ' from ' || ip || ' port 22 ssh2'
  END AS line
FROM e
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    zoneless = {c: F.col(c).cast("timestamp") for c, t in df.dtypes if t == "timestamp_ntz"}
    return spread(df.withColumns(zoneless) if zoneless else df)


def spread(df: DataFrame) -> DataFrame:
    """Use every core, and give no task more rows than ``TASK_ROWS``.

    Splits have 4 MB at least (``spark.sql.files.openCostInBytes``), and a row
    group is one task's however many splits it has; a million short rows fit
    into one, which a parser then turns into many times their bytes.  Rows that
    come thicker than that from the scan are dealt out; they are counted from
    the footers.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    small = size < cores * SPLIT_BYTES
    rows = df.count() if size >= SPLIT_BYTES else 0
    wanted = max(cores, -(-rows // TASK_ROWS))
    if not small and wanted <= df._jdf.queryExecution().toRdd().getNumPartitions():
        return df
    return df.repartition(wanted)


def log_lines(spark: SparkSession, sf_dir: str, known_origin: bool = True) -> DataFrame:
    """``id, line, ingest_ts`` and, with ``known_origin``, the format by path."""
    lines = spark.sql(LOG_LINES.replace("FROM events", "FROM {events}"), events=table(spark, sf_dir, "events"))
    lines = lines.select(F.col("event_id").alias("id"), "ingest_ts", settle(F.col("line")).alias("line"))
    if known_origin:
        lines = lines.withColumn(
            "source_type",
            F.when(F.col("id") % 5 < 2, "Apache").when(F.col("id") % 5 < 4, "Nginx").otherwise("Ssh"),
        )
    return lines


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_logs(log_lines(spark, sf_dir))


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One alert per ``error`` row of the events table."""
    severities = F.array(*[F.lit(s) for s in ("Low", "Info", "Medium", "Warning", "High", "Critical")])
    return (
        table(spark, sf_dir, "events").where(F.col("event_type") == "error")
        .select(
            F.col("event_id").alias("id"), "ts",
            F.get(severities, (F.col("event_id") % 6).cast("int")).alias("severity"),
            F.concat(F.lit("Threat from "), (F.col("user_id") % 10).cast("string")).alias("title"),
            F.concat(F.lit("value "), F.col("value").cast("string")).alias("description"),
            F.array("event_id").alias("related_events"),
            F.array(F.lit("review")).alias("mitigation_steps"),
            F.to_date("ts").alias("event_date"),
        )
    )


def acks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth alert, acknowledged one hour after it was raised."""
    raised = alerts(spark, sf_dir).where(F.col("id") % 4 == 0)
    return raised.select(F.col("id").alias("alert_id"), (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("ts"))


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One attempt per alert and channel."""
    status = F.when(F.col("id") % 3 == 0, 500).when(F.col("id") % 3 == 1, 404).otherwise(429)
    failed = F.col("id") % 7 == 0
    return (
        alerts(spark, sf_dir)
        .select("id", "ts", "severity", F.explode(F.array(F.lit("console"), F.lit("email"), F.lit("webhook"))).alias("channel"))
        .select(
            F.col("id").alias("alert_id"), "channel", F.concat(F.col("channel"), F.lit("-"), (F.col("id") % 3).cast("string")).alias("endpoint"),
            "ts", "severity", (~failed).alias("success"), F.when(failed, status).otherwise(200).alias("status"),
            (F.lit(20) + F.col("id") % 50).cast("long").alias("response_ms"),
            (F.lit(1) + F.col("id") % 3).cast("int").alias("attempt"),
        )
    )


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events an analyst marked as false positives."""
    return (
        table(spark, sf_dir, "events").where(F.col("event_id") % 50 == 0)
        .select(F.col("event_id").alias("event_id"), "ts", F.lit("reviewed").alias("reason"))
    )
