"""SimHash fingerprints and their near pairs by Golay-code fuzzy hashing.

The binary Golay code of 23 bits is perfect: every word lies within three bits
of exactly one codeword.  So if two words differ in at most one bit, the
codeword nearest to the first lies within four bits of the second, and a word
has one or six codewords that near.  A fingerprint is cut into segments of 22, 21 and 21
bits.  Of three errors at most one segment can hold two or more, so two
segments have at most one error each: for each of the three pairs of segments,
one side of the join offers its pair of nearest codewords (a key of 24 bits),
the other side all pairs of codewords within four bits.  Fingerprints that
meet are then compared bit by bit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from palisade.llm.common import cut, group_bounds, small_batches, stars, whole_groups, words_of
from palisade.llm.graph import components

#: Generator polynomial of the binary Golay code (a fixed value).
GOLAY_GENERATOR = 0b110001110101
SEGMENTS = ((0, 22), (22, 21), (43, 21))
PAIRS = ((0, 1), (0, 2), (1, 2))
#: A bucket with more rows than this on a side is cut into blocks.
BLOCK_ROWS = 2048
#: Hot buckets fewer than this are broadcast; more are joined.
HOT_ROWS = 50_000


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of word shingles: a bit is 1 if over half of the shingle hashes have it.

    Fewer words than ``width`` are one shingle; no words give 0.
    """
    words = words_of(text)
    if not words:
        return 0
    count = max(1, len(words) - width + 1)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    hashes = np.fromiter((digest(join(words[i:i + width]), seed) for i in range(count)), np.uint64, count)
    ones = np.zeros(64, np.int64)
    for start in range(0, count, 4096):
        bits = np.unpackbits(hashes[start:start + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > count, bitorder="little").view(np.uint64)[0])


def _remainders() -> np.ndarray:
    """Remainder by the generator of each single bit of a 23-bit word."""
    out = []
    for bit in range(23):
        word = 1 << bit
        for at in range(22, 10, -1):
            if word >> at & 1:
                word ^= GOLAY_GENERATOR << (at - 11)
        out.append(word)
    return np.array(out, np.int32)


def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """Remainders of single bits, and per remainder the error patterns of up to four bits (nearest first, -1: none)."""
    single = _remainders()
    patterns = np.full((2048, 6), -1, np.int32)
    filled = np.zeros(2048, np.int64)
    for weight in range(5):
        for bits in combinations(range(23), weight):
            of = int(np.bitwise_xor.reduce(single[list(bits)])) if bits else 0
            patterns[of, filled[of]] = sum(1 << b for b in bits)
            filled[of] += 1
    return single, patterns


def codewords(words: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Indices (12 bits) of the codewords within four bits of each word, the nearest first; -1: none."""
    single, patterns = tables
    remainder = np.zeros(len(words), np.int32)
    for bit in range(23):
        remainder ^= np.where(words >> bit & 1, single[bit], 0).astype(np.int32)
    errors = patterns[remainder]
    return np.where(errors < 0, -1, (words[:, None].astype(np.int32) ^ errors) >> 11)


def bucket_keys(prints: np.ndarray, tables) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, side, fingerprint) rows: side 0 offers nearest codewords, side 1 looks them up."""
    unsigned = prints.view(np.uint64)
    segments = [codewords((unsigned >> np.uint64(at) & np.uint64((1 << size) - 1)).astype(np.int32), tables) for at, size in SEGMENTS]
    keys, sides, values = [], [], []
    for family, (a, b) in enumerate(PAIRS):
        base = family << 24
        keys.append(base | segments[a][:, 0] << 12 | segments[b][:, 0])
        sides.append(np.zeros(len(prints), np.int8))
        values.append(prints)
        both = segments[a][:, :, None] << 12 | segments[b][:, None, :]
        there = (segments[a][:, :, None] >= 0) & (segments[b][:, None, :] >= 0)
        of, _, _ = np.nonzero(there)
        keys.append(base | both[there])
        sides.append(np.ones(len(of), np.int8))
        values.append(prints[of])
    return np.concatenate(keys).astype(np.int32), np.concatenate(sides), np.concatenate(values)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches):
        prints = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints)], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fp`` (signed 64 bits) of every row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_fingerprints, "doc_id long, fp long")


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tables = golay_tables()
    for batch in batches:
        if batch.num_rows:
            key, side, fp = bucket_keys(batch.column("fp").to_numpy(), tables)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(side), pa.array(fp)], ["key", "side", "fp"])


def _near(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    return np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)) <= bits


def linked(key: np.ndarray, side: np.ndarray, fp: np.ndarray, bits: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """A spanning set of the links inside the buckets; rows sorted by key, then side."""
    bounds = group_bounds([key])
    first = np.add.reduceat((side == 0).astype(np.int64), bounds[:-1])
    starts, sizes = bounds[:-1], np.diff(bounds)
    second = sizes - first
    found: list[tuple[np.ndarray, np.ndarray]] = []
    small = (first > 0) & (second > 0) & (first * second <= 4096)
    left, right, at = first[small], second[small], starts[small]
    work = left * right
    ends = np.cumsum(work)
    step = 2_000_000
    for lo in range(0, int(ends[-1]) if len(ends) else 0, step):
        take = slice(np.searchsorted(ends, lo, "right"), np.searchsorted(ends, lo + step, "right"))
        w, n = work[take], right[take]
        if not len(w):
            continue
        which = np.repeat(np.arange(len(w)), w)
        offset = np.arange(len(which)) - np.repeat(np.cumsum(w) - w, w)
        a = fp[at[take][which] + offset // n[which]]
        b = fp[at[take][which] + left[take][which] + offset % n[which]]
        keep = (a < b) & _near(a, b, bits)
        found.append(stars(a[keep], b[keep]))
    for i in np.flatnonzero((first > 0) & (second > 0) & ~small):
        mine = fp[starts[i]:starts[i] + first[i]]
        others = fp[starts[i] + first[i]:bounds[i + 1]]
        parts = []
        for lo in range(0, len(others), 512):
            some = others[lo:lo + 512]
            x, y = np.nonzero(_near(some[:, None], mine[None, :], bits))
            parts.append(stars(some[x], mine[y]))
        found.append(stars(*(np.concatenate(p) for p in zip(*parts, strict=True))))
    if not found:
        return fp[:0], fp[:0]
    return stars(*(np.concatenate(p) for p in zip(*found, strict=True)))


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for chunk in whole_groups(batches, ["key", "ib", "pb"]):
        k = chunk.column("key").to_numpy().astype(np.int64)
        bounds = group_bounds([k, chunk.column("ib").to_numpy(), chunk.column("pb").to_numpy()])
        group = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        a, b = linked(group, chunk.column("side").to_numpy(), chunk.column("fp").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def near_links(prints: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``a, b``: links that connect the same distinct fingerprints ``fp`` as all pairs within three bits do.

    A bucket that is hot on either side is cut into blocks of about
    ``block_rows`` rows, and every block of one side meets every block of the
    other in a group of its own, so no task holds a whole hot bucket.
    """
    keyed = prints.select("fp").mapInArrow(_keyed, "key int, side byte, fp long")
    sizes = keyed.groupBy("key").agg(F.sum(1 - F.col("side")).alias("n0"), F.sum("side").alias("n1"))
    hot = cut(sizes.where((F.col("n0") > 0) & (F.col("n1") > 0) & ((F.col("n0") > block_rows) | (F.col("n1") > block_rows))).select(
        "key", F.ceil(F.col("n0") / block_rows).cast("int").alias("b0"), F.ceil(F.col("n1") / block_rows).cast("int").alias("b1")))
    n_hot = hot.count()
    if not n_hot:
        dealt = keyed.withColumns({"ib": F.lit(0), "pb": F.lit(0)})
    else:
        dealt = keyed.join(F.broadcast(hot) if n_hot <= HOT_ROWS else hot, "key", "left").fillna(1, ["b0", "b1"])
        mine = F.pmod(F.xxhash64("fp"), F.when(F.col("side") == 0, F.col("b0")).otherwise(F.col("b1"))).cast("int")
        dealt = dealt.withColumn("mine", mine).withColumn(
            "other", F.explode(F.sequence(F.lit(0), F.when(F.col("side") == 0, F.col("b1")).otherwise(F.col("b0")) - 1)))
        dealt = dealt.select("key", "side", "fp", F.when(F.col("side") == 0, F.col("mine")).otherwise(F.col("other")).alias("ib"),
                             F.when(F.col("side") == 0, F.col("other")).otherwise(F.col("mine")).alias("pb"))
    order = ["key", "ib", "pb"]
    return dealt.repartition(*order).sortWithinPartitions(*order, "side").mapInArrow(_links, "a long, b long")


def simhash_groups(docs: DataFrame) -> DataFrame:
    """``doc_id, fp, component_id`` of every row of ``docs`` (columns ``doc_id, text``; others are ignored).

    ``component_id`` is the smallest id reachable over links of three or fewer
    differing bits.  Null and empty texts have fingerprint zero and link like
    any other.  Repeated rows come back once each.  A row without an id takes
    its group's id, null if no row of the group has one.  Equal fingerprints
    are one node, so copies are never paired.
    """
    prints = cut(fingerprints(docs))
    classes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(near_links(classes))
    named = classes.join(roots, classes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    of = named.join(smallest, "root").select("fp", "root", "component_id")
    return prints.join(of, "fp").select("doc_id", "fp", "component_id", F.col("root").alias("group"))


def simhash_dedup(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are the first of their group, with all their columns.

    The smallest id of a group stays, once if its row is repeated.  Rows
    without an id stay only where their group has no id, once per text.
    """
    return keep_first(docs, simhash_groups(docs), lambda text: int(np.uint64(fingerprint(text)).view(np.int64)))


def keep_first(docs: DataFrame, groups: DataFrame, print_of: Callable[[str | None], int]) -> DataFrame:
    """The first rows of ``groups`` (``doc_id, fp, component_id, group``); ``print_of`` gives the ``fp`` of a text."""
    kept = groups.where("doc_id = component_id").select("doc_id").distinct()
    first = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    lone = docs.where("doc_id IS NULL")
    free = groups.where("component_id IS NULL").select("fp", "group").distinct()
    named = lone.select("text").distinct()
    named = named.mapInArrow(_text_prints(print_of), "text string, fp long").join(free, "fp").groupBy("group").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    rest = lone.withColumn("__t", F.coalesce("text", F.lit(""))).join(named.select(F.col("text").alias("__t")), "__t", "left_semi").dropDuplicates(["__t"]).drop("__t")
    return first.unionByName(rest.select(*first.columns))


def _text_prints(print_of: Callable[[str | None], int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            prints = pa.array([print_of(t) for t in batch.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("text"), prints], ["text", "fp"])
    return run
