"""Counts of events per span of time, kept by a stream, and the reports that need no more than them.

A cell is (starts_at, severity, source, event_type, n).  Late rows add to
their own cell.  Reports sum whole cells and read from the events themselves
only what lies in the few cells that a bound of theirs cuts in two.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from palisade.operators.query import RANGE_HOURS
from palisade.operators.reports import alert_totals, threat_score, threat_trends
from palisade.streaming.tables import BatchTable

#: Seconds of a cell.
WIDTH = 3600
KEYS = ["starts_at", "severity", "source", "event_type"]


def cells_of(events: DataFrame, width: int = WIDTH) -> DataFrame:
    start = F.timestamp_micros(F.floor(F.unix_micros("ts") / (width * 1_000_000)).cast("long") * (width * 1_000_000))
    return events.groupBy(start.alias("starts_at"), "severity", "source", "event_type").agg(F.count("*").alias("n"))


def _sum(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).agg(F.sum("n").alias("n"))


def rollup_table(spark: SparkSession, path: str, fold_every: int = 20) -> BatchTable:
    return BatchTable(spark, path, _sum, fold_every)


def stream_rollup(events: DataFrame, out: str, checkpoint: str, width: int = WIDTH, fold_every: int = 20) -> None:
    """Add every batch of live events to the table of cells."""
    from palisade.streaming.jobs import run

    table = rollup_table(events.sparkSession, out, fold_every)
    run(events.select("ts", "severity", "source", "event_type").writeStream.foreachBatch(
        lambda batch, batch_id: table.add(cells_of(batch, width), batch_id)), checkpoint)


def _moment(value: str | datetime) -> datetime:
    moment = datetime.fromisoformat(value) if isinstance(value, str) else value
    return moment if moment.tzinfo else moment.replace(tzinfo=timezone.utc)


def _micros(moment: datetime) -> int:
    return (moment - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)


class Rollup:
    """Cells and, for what cuts them, the events they count."""

    def __init__(self, cells: DataFrame, events: DataFrame, width: int = WIDTH):
        self.cells, self.events, self.span = cells, events, width * 1_000_000

    def _rows_of(self, cell: int) -> Column:
        """The events of one cell; the day goes to the scan as well, so that other days are not read."""
        low, high = F.timestamp_micros(F.lit(cell)), F.timestamp_micros(F.lit(cell + self.span))
        inside = (F.col("ts") >= low) & (F.col("ts") < high)
        if "event_date" in self.events.columns:
            days = {date(1970, 1, 1) + timedelta(days=us // 86_400_000_000) for us in (cell, cell + self.span - 1)}
            inside &= F.col("event_date").isin(*days)
        return inside

    def split(self, bounds: list[int]) -> tuple[Column, DataFrame | None]:
        """A condition for the cells that no bound cuts, and the events of the others."""
        cut = sorted({b // self.span * self.span for b in bounds if b % self.span})
        if not cut:
            return F.lit(True), None
        rows = self._rows_of(cut[0])
        for cell in cut[1:]:
            rows |= self._rows_of(cell)
        return ~F.unix_micros("starts_at").isin(*cut), self.events.where(rows)

    def parts(self, bounds: list[int]) -> DataFrame:
        """Cells between the bounds: whole ones, and events of cut ones as cells of one event that start at its time."""
        whole, rest = self.split(bounds)
        cells = self.cells.where(whole).select(*KEYS, "n")
        if rest is None:
            return cells
        return cells.unionByName(rest.select(F.col("ts").alias("starts_at"), "severity", "source", "event_type", F.lit(1).cast("long").alias("n")))

    def dashboard_stats(self, alerts: DataFrame, acks: DataFrame, as_of: str | datetime) -> DataFrame:
        """As ``reports.dashboard_stats``."""
        now = _micros(_moment(as_of))
        hour, day = now - 3_600_000_000, now - 86_400_000_000
        at = F.unix_micros("starts_at")
        # events exactly at a bound are outside, so it cuts its cell even at its start
        parts = self.parts([hour + 1, day + 1])
        seen = parts.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("total_events"),
            (F.coalesce(F.sum(F.when(at > hour, F.col("n"))), F.lit(0)) / 3600).alias("events_per_second"),
            F.count_distinct(F.when(at > day, F.col("source"))).alias("active_sources"))
        totals = alert_totals(alerts, acks, as_of if isinstance(as_of, str) else F.lit(as_of))
        figures = totals.select(F.struct(*totals.columns)).scalar()
        return seen.withColumn("a", figures).select(
            "total_events", "events_per_second", "active_sources", "a.*", threat_score(F.col("a.open_last_day")).alias("threat_score")).drop("open_last_day")

    def threat_trends(self, range_name: str, as_of: str | datetime) -> DataFrame:
        """As ``reports.threat_trends``."""
        hours = RANGE_HOURS.get(range_name, 24)
        width = 1 if hours <= 24 else hours // 24
        now = _micros(_moment(as_of))
        start = now - hours * 3_600_000_000
        parts = self.parts([start + k * width * 3_600_000_000 for k in range(hours // width)] + [now])
        return threat_trends(parts.withColumnRenamed("starts_at", "ts"), range_name, F.timestamp_micros(F.lit(now)), n=F.col("n"))

    def hourly_timeline(self) -> DataFrame:
        from palisade.operators.reports import hourly_timeline

        return hourly_timeline(self.cells.withColumnRenamed("starts_at", "ts"), n=F.col("n"))
