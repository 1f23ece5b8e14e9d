"""Helpers that the operators of this package share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from palisade.session import scratch_folder, truncate_lineage

#: Rows that a grouped task gathers before it works on them.
CHUNK_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder all executors share."""
    return truncate_lineage(df)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage with a compressed table in the folder all executors share; later readers take the columns they need."""
    folder = scratch_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def words_of(text: str | None) -> list[bytes]:
    """``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased, in UTF-8; none for a null.

    ``bytes.lower`` and ``bytes.split`` know ASCII only, which is what the rule asks for.
    """
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def small_batches(batches: Iterable[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches: only so many texts are Python objects at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str], rows: int = CHUNK_ROWS) -> Iterator[pa.Table]:
    """Cut a stream of batches, sorted by integer ``keys``, into tables that hold whole groups only.

    A table has about ``rows`` rows, or those of one group if that is more.
    """
    held, n = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        whole = pa.Table.from_batches(held)
        last = np.ones(n, bool)
        for k in keys:
            values = whole.column(k).to_numpy()
            last &= values == values[-1]
        start = n - (n if last.all() else int(np.argmin(last[::-1])))
        if start:
            yield whole.slice(0, start)
            held, n = whole.slice(start).combine_chunks().to_batches(), n - start
    if n:
        yield pa.Table.from_batches(held)


def group_bounds(keys: list[np.ndarray]) -> np.ndarray:
    """Where the groups of sorted key columns begin, and the end of the last one."""
    change = np.zeros(len(keys[0]), bool)
    change[0] = True
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    return np.append(np.flatnonzero(change), len(change))


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The components of the links a-b as (node, smallest node) pairs, smallest nodes left out."""
    if not len(a):
        return a, b
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]
