"""A trigram index beside stored events: which ids of a day hold which three characters.

The index is a table (event_date, gram, ids) sorted by gram, so a lookup reads
the row groups of a few grams.  A text can only be in events that have all its
trigrams; those are fetched by day and id and the text is confirmed in them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from palisade.functions.text import grams
from palisade.operators.query import search_events
from palisade.sources.store import read_events

#: Candidates whose ids go into the scan's filter; more are joined.
FILTER_IDS = 1000
#: Lists of a file, about, events whose postings one task makes, and characters that it takes at a time.
FILE_ROWS, TASK_EVENTS, STEP_CHARS = 5_000_000, 32_768, 4_000_000
POSTINGS = "gram string, ids array<long>, event_date date"
_FIELDS = ("raw_message", "source", "event_type")


def trigrams(text: Column) -> Column:
    """The distinct three-character pieces of a text."""
    return F.array_distinct(grams(text, F.lit(3)))


def _posted(days: list, ids: np.ndarray, texts: list[str], of: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(event_date, gram, ids) of some texts, each with the place ``of`` its event; a text has what ``trigrams`` finds in it.

    A gram is a number of three characters, each its place among the characters that occur.  Sorted by day, gram and event, what
    is equal lies together.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(sizes)[sizes > 0]
    begins = np.ones(len(chars), bool)
    for back in (1, 2):  # before a text of one character lies the end of another text
        begins[ends - back] = False
    start = np.flatnonzero(begins)
    if not len(start):
        return
    there = np.zeros(int(chars.max()) + 1, bool)
    there[chars] = True
    place_of, alphabet = np.cumsum(there) - 1, np.flatnonzero(there).astype(np.uint32)
    chars, n, size = place_of[chars], len(ids), len(alphabet)
    gram = (chars[start] * size + chars[start + 1]) * size + chars[start + 2]
    known, day = np.unique([str(d) for d in days], return_inverse=True)
    number, grams, most = {str(d): d for d in days}, None, size ** 3
    if most * len(known) * n >= 1 << 63:
        grams, gram = np.unique(gram, return_inverse=True)
        most = len(grams)
    order = np.argsort(ids, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    place = np.repeat((day * most * n + rank)[of], sizes)[start] + gram * n
    place.sort()
    place = place[np.r_[True, place[1:] != place[:-1]]]
    listed, who = place // n, ids[order[place % n]]
    first = np.flatnonzero(np.r_[True, listed[1:] != listed[:-1]])
    text = listed[first] % most
    text = text if grams is None else grams[text]
    names = alphabet[np.stack([text // size ** 2, text // size % size, text % size], axis=1)].tobytes().decode("utf-32-le", "surrogatepass")
    yield pa.RecordBatch.from_arrays([
        pa.array([number[known[d]] for d in listed[first] // most], pa.date32()),
        pa.array([names[3 * k:3 * k + 3] for k in range(len(first))], pa.string()),
        pa.ListArray.from_arrays(pa.array(np.append(first, len(who)), pa.int32()), pa.array(who))], ["event_date", "gram", "ids"])


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The postings of a task's events, ``STEP_CHARS`` at a time; an event without an id can't be asked for."""
    days, ids, texts, of, size = [], [], [], [], 0
    for batch in batches:
        columns = [[(v or b"").decode("utf-8", "replace") for v in batch.column(c).cast(pa.binary()).to_pylist()] for c in _FIELDS]
        for day, who, *fields in zip(batch.column("event_date").to_pylist(), batch.column("id").to_pylist(), *columns):
            if who is None:
                continue
            texts += fields
            of += [len(ids)] * len(fields)
            days.append(day)
            ids.append(who)
            size += sum(map(len, fields))
            if size >= STEP_CHARS:
                yield from _posted(days, np.array(ids, np.int64), texts, np.array(of))
                days, ids, texts, of, size = [], [], [], [], 0
    if ids:
        yield from _posted(days, np.array(ids, np.int64), texts, np.array(of))


def index_events(events: DataFrame, path: str) -> None:
    """Add events to the index; searched are message, source and event type, in lower case.

    An event may be indexed twice: a posting is a fact.  Events are dealt out by
    day and id before they become hundreds of postings each, which are listed by
    gram where they arise: a file holds the grams of a block of ids, and a
    lookup reads the pages of its grams in the files of all blocks.
    """
    blocks = max(events.sparkSession.sparkContext.defaultParallelism, -(-events.count() // TASK_EVENTS))
    events = events.select("event_date", "id", *_FIELDS).repartitionByRange(blocks, "event_date", "id")
    postings = events.select("event_date", "id", *[F.lower(c).alias(c) for c in _FIELDS]).mapInArrow(
        _postings, "event_date date, gram string, ids array<long>")
    rows = postings.sortWithinPartitions("event_date", "gram")
    rows.select("gram", "ids", "event_date").write.mode("append").partitionBy("event_date").option("maxRecordsPerFile", FILE_ROWS).option(
        "parquet.bloom.filter.enabled#gram", "true").parquet(path)


def candidates(spark: SparkSession, index: str, text: str) -> DataFrame:
    """(event_date, id) of the events that have every trigram of ``text`` (three characters at least)."""
    needle = text.lower()
    wanted = sorted({needle[i:i + 3] for i in range(len(needle) - 2)})
    lists = spark.read.schema(POSTINGS).parquet(index).where(F.col("gram").isin(wanted))
    found = lists.select("event_date", "gram", F.explode("ids").alias("id"))
    return found.groupBy("event_date", "id").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(wanted)).drop("n")


def search_indexed(spark: SparkSession, store: str, index: str, text: str, severity: str | None = None) -> DataFrame:
    """``search_events`` over stored and indexed events, reading only the days that can hold the text.

    Texts of fewer than three characters have no trigram and are searched by
    reading everything.
    """
    events = read_events(spark, store)
    if len(text) < 3:
        return search_events(events, text, severity)
    found = candidates(spark, index, text).persist()
    try:
        days = [r["event_date"] for r in found.select("event_date").distinct().collect()]
        few = [r["id"] for r in found.select("id").limit(FILTER_IDS + 1).collect()]
        if not few:
            return search_events(events.where(F.lit(False)), text, severity)
        events = events.where(F.col("event_date").isin(days))
        if len(few) <= FILTER_IDS:
            return search_events(events.where(F.col("id").isin(few)), text, severity)
        return search_events(events.join(candidates(spark, index, text), ["event_date", "id"], "left_semi"), text, severity)
    finally:
        found.unpersist()
