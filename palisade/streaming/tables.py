"""Tables that a stream adds to batch by batch, and that stay small by being folded.

A batch writes a folder of its own, so a repeated batch replaces itself.  From
time to time the folders are folded into one, ``base=n``, which stands for all
batches up to ``n`` from the moment it has its name; readers take the newest
base and the batches after it.  A break between the steps leaves folders that
nobody reads and the next fold removes.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from palisade.sources.upkeep import _Files


class BatchTable:
    """``merge`` turns rows of several batches, each with its number in ``batch``, into the rows they stand for."""

    def __init__(self, spark: SparkSession, path: str, merge: Callable[[DataFrame], DataFrame], fold_every: int = 20):
        self.spark, self.path, self.merge, self.fold_every = spark, path.rstrip("/"), merge, fold_every
        self.files = _Files(spark, self.path)

    def _numbers(self, kind: str) -> list[int]:
        return sorted(int(n.partition("=")[2]) for n in self.files.names() if n.startswith(f"{kind}="))

    def _current(self) -> tuple[int, list[str]]:
        base = max(self._numbers("base"), default=-1)
        return base, [f"{self.path}/base={base}"] * (base >= 0) + [f"{self.path}/batch={n}" for n in self._numbers("batch") if n > base]

    def add(self, rows: DataFrame, batch_id: int) -> None:
        """Take the rows of a batch; a batch that is in the base already changes nothing."""
        base, _ = self._current()
        if batch_id <= base:
            return
        rows.withColumn("batch", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")
        if len([n for n in self._numbers("batch") if n > base]) >= self.fold_every:
            self.fold()

    def _rows(self, folders: list[str]) -> DataFrame:
        first = self.spark.read.parquet(folders[0])
        out = first
        if folders[1:]:  # the number is a column of the files, not of their folders
            out = out.unionByName(self.spark.read.schema(first.schema).option("basePath", self.path).option("recursiveFileLookup", "true").parquet(*folders[1:]))
        return out

    def read(self) -> DataFrame:
        """The merged rows, without the numbers of batches."""
        _, folders = self._current()
        if not folders:
            raise FileNotFoundError(f"{self.path} has no batch")
        return self.merge(self._rows(folders))

    def fold(self) -> None:
        _, folders = self._current()
        batches = self._numbers("batch")
        newest = max([*batches, *self._numbers("base")])
        if len(folders) > 1:
            name = f"_fold-{uuid.uuid4().hex}"
            self.read().withColumn("batch", F.lit(newest).cast("long")).coalesce(8).write.parquet(f"{self.path}/{name}")
            self.files.move(name, f"base={newest}")
        base, _ = self._current()
        for stale in self.files.names():
            kind, _, number = stale.partition("=")
            if stale.startswith("_fold-") or kind == "batch" and int(number) <= base or kind == "base" and int(number) < base:
                self.files.remove(stale)
