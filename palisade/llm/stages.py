"""Running the stages of a pipeline one after another."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from palisade.session import checkpoint_dir


def _remove(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def run_stages(spark: SparkSession, docs: DataFrame, sf_dir: str, stages) -> DataFrame:
    """Apply the stages; every result but the last is written as Parquet, read by the next one and then removed.

    The last stage reads the one before it, so that one's files stay with the
    checkpoints.
    """
    folder = f"{checkpoint_dir(spark).rstrip('/')}/stages-{uuid.uuid4().hex}"
    written = []
    for k, (name, stage) in enumerate(stages):
        docs = stage(spark, docs, sf_dir)
        if k == len(stages) - 1:
            return docs
        path = f"{folder}/{k}-{name}"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        if written:
            _remove(spark, written.pop())
        written.append(path)
    return docs
