"""Upkeep of stored tables with a folder per day: replacing, dropping and compacting days.

New files of a day are written beside the table, in a folder whose name Spark
doesn't read.  Once they are complete a plan is put down, and the old folders
step aside and the new ones into their places by renames.  A run that breaks
off before the plan leaves the table as it was; after it, ``recover`` (which
every change calls first) takes the remaining steps.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

DAY = "event_date"
_PENDING = "_replace-"


class _Files:
    """The file system that holds a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self._new = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.root = path.rstrip("/")
        self.fs = self._new(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self._new(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def names(self, name: str = "") -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.path(name))] if self.exists(name) else []

    def move(self, old: str, new: str) -> None:
        self.fs.mkdirs(self.path(new).getParent())
        if not self.fs.rename(self.path(old), self.path(new)):
            raise OSError(f"{self.root}/{old} could not be renamed to {new}")

    def remove(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def write(self, name: str, text: str) -> None:
        """All of the text or no file."""
        out = self.fs.create(self.path(name + ".part"))
        out.write(bytearray(text.encode()))
        out.close()
        self.move(name + ".part", name)

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()


def _finish(files: _Files, pending: str) -> None:
    """Take the steps of a plan that are still to be taken."""
    for day, renewed in json.loads(files.read(f"{pending}/plan")):
        place, old, new = f"{DAY}={day}", f"{pending}/old/{DAY}={day}", f"{pending}/new/{DAY}={day}"
        waiting = files.exists(new) if renewed else not files.exists(old)
        if waiting and files.exists(place) and not files.exists(old):
            files.move(place, old)
        if renewed and waiting:
            files.move(new, place)
    files.remove(pending)


def recover(spark: SparkSession, path: str) -> None:
    """Finish what broke off: changes with a plan are completed, others undone."""
    files = _Files(spark, path)
    for pending in files.names():
        if pending.startswith(_PENDING):
            _finish(files, pending) if files.exists(f"{pending}/plan") else files.remove(pending)


def replace_days(spark: SparkSession, path: str, rows: DataFrame | None, days: list[str]) -> None:
    """Let ``rows`` be all that is stored of ``days``; a day without rows loses its folder.

    Only one run may change a table at a time; appends to other days don't
    disturb it.
    """
    recover(spark, path)
    files, pending = _Files(spark, path), f"{_PENDING}{uuid.uuid4().hex}"
    if rows is not None:
        rows.write.partitionBy(DAY).parquet(f"{files.root}/{pending}/new")
    made = {n.partition("=")[2] for n in files.names(f"{pending}/new") if n.startswith(f"{DAY}=")}
    if made - set(days):
        files.remove(pending)
        raise ValueError(f"rows of other days: {sorted(made - set(days))[:3]}")
    files.write(f"{pending}/plan", json.dumps([[d, d in made] for d in days]))
    _finish(files, pending)


def _day(name: str = DAY) -> Column:
    return F.coalesce(F.date_format(name, "yyyy-MM-dd"), F.lit("__HIVE_DEFAULT_PARTITION__"))


def retain_stored(spark: SparkSession, path: str, schema: T.StructType, keep: Column, file_rows: int = 1_000_000) -> int:
    """Remove stored rows for which ``keep`` isn't true; returns how many days changed.

    Days that lose nothing are not touched, days that lose everything are not
    read again, and only the others are written anew.
    """
    recover(spark, path)
    stored = spark.read.schema(schema).parquet(path)
    counts = stored.groupBy(_day().alias("day")).agg(F.count("*").alias("n"), F.count_if(keep).alias("kept")).where("kept < n").collect()
    days = [r["day"] for r in counts]
    cut = {r["day"]: r["kept"] for r in counts if r["kept"]}
    if days:
        rest = _in_files(stored.where(_day().isin(list(cut))).where(keep), sum(cut.values()), file_rows) if cut else None
        replace_days(spark, path, rest, days)
    return len(days)


def _in_files(rows: DataFrame, n: int, file_rows: int) -> DataFrame:
    """Rows in order of day and id, about ``file_rows`` of them to a file."""
    return rows.repartitionByRange(max(1, -(-n // file_rows)), DAY, "id").sortWithinPartitions(DAY, "id")


def compact_days(spark: SparkSession, path: str, schema: T.StructType, file_rows: int = 1_000_000, spare: int = 2) -> int:
    """Write the days anew that have over ``spare`` files more than their rows need; returns how many."""
    recover(spark, path)
    stored = spark.read.schema(schema).parquet(path)
    files = stored.groupBy(_day().alias("day"), F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n"))
    days = files.groupBy("day").agg(F.count("*").alias("files"), F.sum("n").alias("n")).where(
        F.col("files") > F.ceil(F.col("n") / file_rows) + spare).collect()
    if days:
        rows = _in_files(stored.where(_day().isin([r["day"] for r in days])), sum(r["n"] for r in days), file_rows)
        replace_days(spark, path, rows, [r["day"] for r in days])
    return len(days)
