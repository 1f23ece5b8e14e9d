"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Documents are cut into blocks of words.  Every source's target becomes an exact
quota of blocks: whole passes over the source and a part of one more, drawn in
permuted order.  A tree splits the quotas among output shards: a node hands its
left half as many blocks as its shards need, and how many of them come from
each source is a multivariate-hypergeometric draw, as if blocks had been drawn
one by one without putting back.  A shard takes a run of each source's permuted
blocks, which no other shard takes, and shuffles locally.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from palisade.llm.common import cut

BLOCK_WORDS = 256
SHARD_BLOCKS = 1024
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
#: Rows of a permutation that one task orders; blocks whose shard is looked up together.
BUCKET_ROWS = 4096
RUN_BLOCKS = 32
#: Sources whose sizes are broadcast at most (a few dozen bytes each).
MOST_SOURCES = 50_000
#: Subtrees that are split in tasks of their own.
SUBTREES = 64


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``sid, source, source_size, target`` of each source of ``sizes`` (``source, source_size``).

    Sources in code point order, null last, take the weights in turn.  They
    share ``share`` of all words by weight, none above ``most`` times its size.
    A source is full where its cap divided by its weight is at most the level
    that the rest would share; the level is highest where the last full source
    has been taken out, so one pass over the sources, ordered by that ratio,
    finds it.  The windows hold one row per source.
    """
    ordered = sizes.withColumn("sid", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))))
    table = F.array(*[F.lit(float(w)) for w in weights])
    ordered = ordered.withColumn("_w", F.get(table, (F.col("sid") - 1) % len(weights))).withColumn("_cap", most * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_w"), "sid")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (share * F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(onward)
    filled = ordered.withColumn("_level", level).withColumn("_level", F.max("_level").over(every))
    return filled.select("sid", "source", "source_size", F.least("_cap", F.col("_w") * F.col("_level")).alias("target"))


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, take: int) -> int:
    """Good ones among ``take`` drawn without putting back.

    From 10^9 on, numpy draws no more; there a normal of equal mean and
    variance, cut to what is possible, stands in.
    """
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, take))
    total = good + bad
    mean = take * (good / total)
    spread = np.sqrt(mean * (bad / total) * ((total - take) / max(total - 1, 1)))
    return int(min(max(round(rng.normal(mean, spread)), take - bad, 0), good, take))


def split_quotas(seed: int, low: int, high: int, quotas: np.ndarray, offsets: np.ndarray, until: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Nodes (low, high, quotas, offsets) of the tree over shards low..high-1 with at most ``until`` shards.

    The draw of a node depends on the seed and its shards alone, so a task that
    runs again draws the same.
    """
    stack = [(low, high, quotas, offsets)]
    while stack:
        low, high, quotas, offsets = stack.pop()
        if high - low <= until:
            yield low, high, quotas, offsets
            continue
        mid = (low + high) // 2
        rng = np.random.default_rng([seed, low, high])
        total = int(quotas.sum())
        need = total * (mid - low) // (high - low)
        left, rest = np.zeros_like(quotas), total
        for i, q in enumerate(quotas.tolist()):
            rest -= q
            left[i] = _hypergeometric(rng, q, rest, need) if need and q else 0
            need -= int(left[i])
        stack.append((mid, high, quotas - left, offsets + left))
        stack.append((low, mid, left, offsets))


def shard_plan(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """``shard, sid, first, quota``: the run of permuted blocks that a shard takes from a source.

    The top of the tree is split in one task (a row per source), the subtrees
    in tasks of their own.
    """
    until = max(1, -(-shards // SUBTREES))

    def top(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("sid")
        sids = rows.sid.to_numpy()
        parts = [pd.DataFrame({"low": lo, "high": hi, "sid": sids, "first": o, "quota": q}) for lo, hi, q, o in split_quotas(
            seed, 0, shards, rows.quota.to_numpy(), np.zeros(len(rows), np.int64), until)]
        return pd.concat(parts).astype("int64")

    def below(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("sid")
        sids = rows.sid.to_numpy()
        parts = [pd.DataFrame({"shard": lo, "sid": sids, "first": o, "quota": q}) for lo, hi, q, o in split_quotas(
            seed, int(rows.low.iloc[0]), int(rows.high.iloc[0]), rows.quota.to_numpy(), rows["first"].to_numpy(), 1)]
        out = pd.concat(parts).astype("int64")
        return out[out.quota > 0]

    tree = quotas.select(F.col("sid").cast("long").alias("sid"), "quota").groupBy(F.lit(0).alias("_all")).applyInPandas(top, "low long, high long, sid long, first long, quota long")
    return tree.groupBy("low", "high").applyInPandas(below, "shard long, sid long, first long, quota long")


def mix_blocks(docs: DataFrame, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS, seed: int = 11,
               weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> tuple[DataFrame, DataFrame]:
    """The mix of ``docs`` (``doc_id, text, source``; others are ignored) as (rows, blocks).

    ``rows``: one per document with ``doc_id, sid, size, copy, source,
    source_size, target``; equal rows are told apart by ``copy``.  ``blocks``:
    ``shard, position, doc_id, sid, size, copy, pass, block, words``, one per
    drawn block.  ``block_words`` 0 takes whole documents as blocks.  A null
    text has no words; documents without words are never drawn.  A null source
    is a source.  Reruns agree: order comes from hashes of ids.
    """
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size"))
    counted = cut(sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n")))
    sources = cut(source_targets(counted.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, most))
    # a row per source: broadcast while they are few, so that no task gets all of a hot source
    few = sources.count() <= MOST_SOURCES
    rows = counted.withColumnRenamed("source", "_source").join(F.broadcast(sources) if few else sources, F.col("_source").eqNullSafe(F.col("source"))).select(
        "doc_id", "sid", "size", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("copy"), "source", "source_size", "target")
    step = F.lit(block_words) if block_words else F.greatest(F.col("size"), F.lit(1))
    blocks = rows.where("size > 0").withColumn("whole", F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(int(most))).cast("int"))
    blocks = blocks.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    blocks = blocks.select("doc_id", "sid", "size", "copy", "whole", "rest",
                           F.explode(F.sequence(F.lit(0), (F.ceil(F.col("size") / step) - 1).cast("int"))).alias("block"))
    blocks = blocks.withColumn("words", F.least(step.cast("long"), F.col("size") - F.col("block") * step))
    drawn = blocks.withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("whole"))))
    lot = F.xxhash64(F.lit(seed), "pass", "doc_id", "copy", "size", "block")
    drawn = drawn.where((F.col("pass") < F.col("whole")) | (F.col("rest") > 0)).withColumn("lot", lot)

    # the place of a block in its source's permutation: buckets of the lot, then rows of a bucket
    sizes = cut(blocks.groupBy("sid").agg(F.count("*").alias("n_blocks")))
    drawn = drawn.join(F.broadcast(sizes) if few else sizes, "sid")
    buckets = F.ceil(F.col("n_blocks") / BUCKET_ROWS)
    drawn = drawn.withColumn("bucket", F.floor((F.col("lot").cast("double") / F.lit(2.0**64) + 0.5) * buckets))
    cells = ["sid", "pass", "bucket"]
    cell = drawn.groupBy(*cells).agg(F.count("*").alias("_n"), F.sum("words").alias("_w"))
    before = Window.partitionBy("sid", "pass").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    cell = cell.select(*cells, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_w").over(before), F.lit(0)).alias("_w0"))
    inside = Window.partitionBy(*cells).orderBy("lot", "doc_id", "copy", "size", "block")
    ranked = drawn.withColumns({
        "_r": F.row_number().over(inside) - 1, "_b": F.sum("words").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("words")}).join(cell, cells)
    kept = ranked.where((F.col("pass") < F.col("whole")) | (F.col("_w0") + F.col("_b") + F.col("words") / 2 <= F.col("rest")))
    kept = cut(kept.select("doc_id", "sid", "size", "copy", "pass", "block", "words",
                           (F.col("pass") * F.col("n_blocks") + F.col("_n0") + F.col("_r")).alias("place")))

    quotas = cut(kept.groupBy("sid").agg(F.count("*").alias("quota")))
    total = quotas.agg(F.sum("quota")).first()[0] or 0
    plan = shard_plan(quotas, max(1, -(-total // shard_blocks)), seed)
    runs = plan.withColumn("run", F.explode(F.sequence(F.floor(F.col("first") / RUN_BLOCKS), F.floor((F.col("first") + F.col("quota") - 1) / RUN_BLOCKS))))
    placed = kept.withColumn("run", F.floor(F.col("place") / RUN_BLOCKS)).join(runs, ["sid", "run"]).where(
        (F.col("place") >= F.col("first")) & (F.col("place") < F.col("first") + F.col("quota")))
    local = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed + 1), "shard", "sid", "place"), "sid", "place")
    return rows, placed.select("shard", (F.row_number().over(local) - 1).alias("position"), "doc_id", "sid", "size", "copy", "pass", "block", "words")


def mixed_sizes(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """How many words the mix takes from each document, and where it puts them.

    ``doc_id, source, size, copy, source_size, target, taken, draws,
    first_shard, last_shard, first_position``: blocks drawn, the lowest and
    highest of their shards, and the first place in the lowest; the shards and
    the place of a document that is not drawn are null.
    """
    key = ["doc_id", "sid", "size", "copy"]
    none = F.lit(None)
    place = F.struct("shard", "position")
    of_docs = rows.select(*key, "source", "source_size", "target", F.lit(0).cast("long").alias("words"),
                          none.cast("struct<shard:bigint,position:int>").alias("place"))
    of_blocks = blocks.select(*key, none.cast("string").alias("source"), none.cast("long").alias("source_size"),
                              none.cast("double").alias("target"), "words", place.alias("place"))
    return of_docs.unionByName(of_blocks).groupBy(*key).agg(
        F.max("source").alias("source"), F.max("source_size").alias("source_size"), F.max("target").alias("target"), F.sum("words").alias("taken"),
        F.count("place").alias("draws"), F.min("place").alias("_low"), F.max("place.shard").alias("last_shard")).select(
        *key, "source", "source_size", "target", "taken", "draws", F.col("_low.shard").alias("first_shard"), "last_shard", F.col("_low.position").alias("first_position"))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix draws it whole; all columns are kept."""
    rows, blocks = mix_blocks(docs, block_words=0, **options)
    times = blocks.groupBy("doc_id", "sid", "size", "copy").agg(F.count("*").alias("__times")).join(
        rows.select("sid", "source").distinct(), "sid")
    times = times.select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__size"), F.col("copy").alias("__copy"), "__times")
    own = Window.partitionBy(F.col("doc_id").cast("long"), "source", "__words").orderBy("text")
    told = docs.withColumn("__words", word_count(F.col("text"))).withColumn("__nth", F.row_number().over(own) - 1)
    met = told.join(times, told.doc_id.cast("long").eqNullSafe(F.col("__id")) & told.source.eqNullSafe(F.col("__source"))
                    & (F.col("__words") == F.col("__size")) & (F.col("__nth") == F.col("__copy")))
    return met.withColumn("__time", F.explode(F.sequence(F.lit(1), F.col("__times").cast("int")))).select(*[docs[c] for c in docs.columns])
