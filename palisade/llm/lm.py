"""Language-model scores from a probabilistic suffix tree over bytes.

A text becomes its lower-cased words, joined by single spaces, and an end
mark.  The tree holds contexts of up to ``DEPTH`` bytes.  A context is kept if
it was seen often enough (a fixed number of times) and its next-byte
distribution diverges from that of its longest proper suffix; so are the
suffixes of kept ones.  Distributions are smoothed with the parent's (the more
distinct bytes were seen, the more), and a byte is scored in the longest kept
context that ends before it.

The tree grows with the texts, so it is a distributed table.  Contexts of up to
``TOP`` bytes are few by their length; longer ones that end in the same bytes
form a group with all their suffixes and are judged together.  Short contexts
and those above a share of all bytes are broadcast.  A byte that a rarer kept
context may decide (a bit table of fixed size tells) is left open.  A unit of
documents names each of its open grams once and its documents refer to them by
number; blocks of grams meet the tree by the endings of contexts, and their
logarithms go back to the unit, which sums them by document.

Beside it stands the base score, a unigram model over words with one added to
each count.  Words above a share of all tokens are few, whatever the corpus,
and are broadcast; the others meet their counts in a join.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from palisade.llm.common import group_bounds, small_batches, stored, whole_groups, words_of

#: Bytes of the longest context.
DEPTH = 5
#: Contexts up to this length are judged on the driver: 65,792 at most.
TOP = 2
#: A kept context was seen at least this often.
MIN_COUNT = 10
#: Kept contexts with at least this share of all bytes are broadcast, so of a level no more than the reciprocal.
BROADCAST_SHARE = 4e-6
#: Size of the table of bits that tells which contexts may have rarer kept ones.
SLOT_BITS = 25
#: Divergence from the parent, in nats over all occurrences, that keeps a context.
DIVERGENCE = 12.0
#: Occurrences that the parent's distribution counts as, per distinct byte seen after a context.
SMOOTHING = 4.0
#: Words with at least this share of all tokens are broadcast: 200,000 at most.
COMMON_SHARE = 5e-6
BLOCK_BYTES = 1_000_000
FLUSH_GRAMS, FLUSH_WORDS = 800_000, 150_000
CACHE_BITS = 20
#: Open grams, counted once a document, from which on a unit of documents is closed.
UNIT_GRAMS = 1_000_000
#: Rows of kept contexts that a bucket of endings holds on average, and the least number of buckets.
BUCKET_ROWS, BUCKETS = 500_000, 64


def training_rows(doc_id: Column, folds: int = 7, held: int = 2) -> Column:
    """Rows to learn from; a missing id is not learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds != held, F.lit(False))


def held_out(doc_id: Column, folds: int = 7, held: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == held, F.lit(False))


def grams_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Packed (context, byte) of every byte of the texts, and where each text begins.

    The lowest byte is the symbol, the one above it came just before.  Each
    text is preceded by zeros.
    """
    pad = b"\0" * DEPTH
    flat = np.frombuffer(pad + pad.join(texts), np.uint8)
    packed = flat.astype(np.uint64)
    for k in range(1, DEPTH + 1):
        packed[k:] |= flat[:-k].astype(np.uint64) << np.uint64(8 * k)
    sizes = np.array([len(t) for t in texts])
    begins = np.cumsum(sizes + DEPTH) - sizes
    own = np.ones(len(flat), bool)
    for k in range(1, DEPTH + 1):
        own[begins - k] = False
    return packed[own], np.cumsum(sizes) - sizes


def _mask(size: int) -> np.uint64:
    """The lowest ``size`` bytes."""
    return np.uint64((1 << 8 * size) - 1)


def _sums(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    out, place = np.unique(keys, return_inverse=True)
    return out, np.bincount(place, n, len(out)).astype(np.int64)


def _add(keys: np.ndarray, counts: np.ndarray, more: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return _sums(np.concatenate([keys, more]), np.concatenate([counts, times]))


def _text_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list[bytes]]]:
    for batch in small_batches(batches, 2000):
        held, size = [], 0
        for text in batch.column("text").to_pylist():
            held.append(words_of(text))
            size += len(text or "")
            if size > BLOCK_BYTES:
                yield held
                held, size = [], 0
        if held:
            yield held


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], ["gram", "n"])

    for block in _text_blocks(batches):
        found, times = np.unique(grams_of([b" ".join(w) + b"\n" for w in block])[0], return_counts=True)
        keys, counts = _add(keys, counts, found, times)
        if len(keys) > FLUSH_GRAMS:
            yield out()
            keys, counts = keys[:0], counts[:0]
    if len(keys):
        yield out()


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[bytes] = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    for block in _text_blocks(batches):
        for words in block:
            counts.update(words)
        if len(counts) > FLUSH_WORDS:
            yield out()
            counts.clear()
    if counts:
        yield out()


@dataclass
class SuffixTree:
    """Kept contexts by length with their entries, all sorted; logs are natural."""

    root: np.ndarray  # log probability of each byte without context
    contexts: list[np.ndarray]  # of length k + 1
    escapes: list[np.ndarray]  # log weight of the parent's distribution
    entries: list[np.ndarray]  # packed (context, byte) that were seen
    logs: list[np.ndarray]

    def score(self, grams: np.ndarray) -> np.ndarray:
        """Log probability of the last byte of each packed gram in its longest kept context."""
        return self.walk(grams)[0]

    def walk(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The scores, and the length of the longest kept context of each gram."""
        out = self.root[(grams & np.uint64(255)).astype(np.int64)].copy()
        depth = np.zeros(len(grams), np.int64)
        for k, (contexts, escapes, entries, logs) in enumerate(zip(self.contexts, self.escapes, self.entries, self.logs, strict=True), 1):
            if not len(contexts):
                continue
            here = grams & np.uint64((1 << 8 * (k + 1)) - 1)
            at = np.minimum(np.searchsorted(contexts, here >> np.uint64(8)), len(contexts) - 1)
            kept = contexts[at] == here >> np.uint64(8)
            place = np.minimum(np.searchsorted(entries, here), len(entries) - 1)
            seen = entries[place] == here
            out = np.where(kept, np.where(seen, logs[place], escapes[at] + out), out)
            depth[kept] = k
        return out, depth


def judge_levels(grams: list[tuple[np.ndarray, np.ndarray]], above: tuple[np.ndarray, np.ndarray], divergence: float, min_count: int = 1,
                 start: int = 1) -> list[dict]:
    """Contexts of lengths from ``start`` on, from counts per level: (packed grams, sorted; counts), and the logs of the entries above the first.

    Every byte seen after each context has to be there.  Parents are judged
    before children; a context stays if it or a longer one diverges.
    """
    levels: list[dict] = []
    entries, smooth = above
    for k, (keys, n) in enumerate(grams, start):
        contexts, first, kinds = np.unique(keys >> np.uint64(8), return_index=True, return_counts=True)
        total = np.add.reduceat(n, first) if len(contexts) else np.zeros(0, np.int64)
        often = total >= min_count
        keys, n = keys[np.repeat(often, kinds)], n[np.repeat(often, kinds)]
        contexts, kinds, total = contexts[often], kinds[often], total[often].astype(np.float64)
        if not len(contexts):
            break
        first = np.cumsum(kinds) - kinds
        of = np.repeat(np.arange(len(contexts)), kinds)
        # probabilities of the longest proper suffix, smoothed: all its entries are one level up
        parent = smooth[np.searchsorted(entries, keys & _mask(k))]
        weight = SMOOTHING * kinds.astype(np.float64)
        logs = np.log((n + weight[of] * np.exp(parent)) / (total + weight)[of])
        gain = np.add.reduceat(n * (np.log(n / total[of]) - parent), first)
        levels.append({"contexts": contexts, "entries": keys, "logs": logs, "of": of, "total": total,
                       "escapes": np.log(weight / (total + weight)), "keep": gain >= divergence})
        entries, smooth = keys, logs
    return levels


def keep_suffixes(levels: list[dict], start: int = 1) -> None:
    """Suffixes of kept contexts stay."""
    for i in range(len(levels) - 1, 0, -1):
        needed = np.unique(levels[i]["contexts"][levels[i]["keep"]] & _mask(start + i - 1))
        levels[i - 1]["keep"][np.searchsorted(levels[i - 1]["contexts"], needed)] = True


def _root(grams: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    counts = np.zeros(256)
    if len(grams[0]):
        counts[grams[0].astype(np.int64)] = grams[1]
    return np.log((counts + 1) / (counts.sum() + 256))


def _kept_tree(root: np.ndarray, levels: list[dict]) -> SuffixTree:
    tree = SuffixTree(root, [], [], [], [])
    for level in levels:
        keep, own = level["keep"], level["keep"][level["of"]]
        tree.contexts.append(level["contexts"][keep])
        tree.escapes.append(level["escapes"][keep])
        tree.entries.append(level["entries"][own])
        tree.logs.append(level["logs"][own])
    return tree


def grow_tree(grams: list[tuple[np.ndarray, np.ndarray]], divergence: float = DIVERGENCE, min_count: int = 1) -> SuffixTree:
    """Build the whole tree from counts per level: (packed grams, sorted; counts), the level without context first."""
    root = _root(grams[0])
    levels = judge_levels(grams[1:], (np.arange(256, dtype=np.uint64), root), divergence, min_count)
    keep_suffixes(levels)
    return _kept_tree(root, levels)


def _part(gram: Column) -> Column:
    """The last bytes of a context longer than ``TOP``, which it shares with all its suffixes that are."""
    return F.shiftrightunsigned(gram, 8).bitwiseAND(F.lit((1 << 8 * (TOP + 1)) - 1))


def _slots(contexts: np.ndarray, sizes: np.ndarray | int) -> np.ndarray:
    mixed = (contexts | np.asarray(sizes).astype(np.uint64) << np.uint64(48)) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _judge(above: Broadcast, often: float, divergence: float, min_count: int):
    """Rows of the kept contexts longer than ``TOP``; ``slot`` is -1 where a context is common or its parent is rare too."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in whole_groups(batches, ["part"]):
            keys, n = chunk.column("gram").to_numpy().view(np.uint64), chunk.column("n").to_numpy()
            levels = judge_levels([_sums(keys & _mask(k + 1), n) for k in range(TOP + 1, DEPTH + 1)], above.value, divergence, min_count, TOP + 1)
            keep_suffixes(levels, TOP + 1)
            for i, level in enumerate(levels):
                k, common = TOP + 1 + i, level["total"] >= often
                edge = ~common
                if i:
                    up = levels[i - 1]
                    edge &= up["total"][np.searchsorted(up["contexts"], level["contexts"] & _mask(k - 1))] >= often
                slots = np.where(edge, _slots(level["contexts"], k), -1)
                own = np.flatnonzero(level["keep"][level["of"]])
                of = level["of"][own]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(own), k, np.int32)), pa.array(level["entries"][own].view(np.int64)), pa.array(level["logs"][own]),
                    pa.array(level["escapes"][of]), pa.array(common[of]), pa.array(slots[of])], ["k", "gram", "log", "escape", "common", "slot"])
    return run


def _levels_of(rows: pa.Table) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """Contexts, escapes, entries and logs of the levels above ``TOP``."""
    level, packed, logs, escapes = (rows.column(c).to_numpy() for c in ("k", "gram", "log", "escape"))
    out: tuple = ([], [], [], [])
    for k in range(TOP + 1, DEPTH + 1):
        own = np.flatnonzero(level == k)
        own = own[np.argsort(packed[own], kind="stable")]
        entries = packed[own].view(np.uint64)
        contexts, first = np.unique(entries >> np.uint64(8), return_index=True)
        for held, made in zip(out, (contexts, escapes[own][first], entries, logs[own]), strict=True):
            held.append(made)
    return out


@dataclass
class FittedTree:
    """The tree: short and common contexts, rows of all kept ones longer than ``TOP``, and the bits of rare ones."""

    top: SuffixTree
    common: SuffixTree
    rows: DataFrame
    bits: np.ndarray


def fit_tree(docs: DataFrame, min_count: int = MIN_COUNT, divergence: float = DIVERGENCE, broadcast_share: float = BROADCAST_SHARE) -> FittedTree:
    """Count (context, byte) over all texts of ``docs`` and grow the tree.

    Only contexts of up to ``TOP`` bytes and kept ones with at least
    ``broadcast_share`` of all bytes reach the driver.  A group of the others
    has no more contexts than there are bytes before its ending.
    """
    spark = docs.sparkSession
    counted = docs.select("text").mapInArrow(_count_grams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    grams = stored(counted.sortWithinPartitions("gram"), "grams")
    few = grams.groupBy(F.col("gram").bitwiseAND(F.lit((1 << 8 * (TOP + 1)) - 1)).alias("gram")).agg(F.sum("n").alias("n")).toArrow()
    keys, n = few.column("gram").to_numpy().view(np.uint64), few.column("n").to_numpy()
    counts = [_sums(keys & _mask(k + 1), n) for k in range(TOP + 1)]
    root = _root(counts[0])
    levels = judge_levels(counts[1:], (np.arange(256, dtype=np.uint64), root), divergence, min_count)
    full = len(levels) == TOP
    above = spark.sparkContext.broadcast((levels[-1]["entries"], levels[-1]["logs"]) if full else (np.zeros(0, np.uint64), np.zeros(0)))
    keyed = grams.where(F.lit(full)).repartition(_part(F.col("gram"))).withColumn("part", _part(F.col("gram")))
    rows = stored(keyed.sortWithinPartitions("part").mapInArrow(
        _judge(above, broadcast_share * float(n.sum()), divergence, min_count), "k int, gram long, log double, escape double, common boolean, slot long"), "tree")
    if full:
        needed = rows.where(F.col("k") == TOP + 1).select(F.shiftrightunsigned("gram", 8).bitwiseAND(F.lit((1 << 8 * TOP) - 1)).alias("c")).distinct().toArrow()
        levels[-1]["keep"][np.searchsorted(levels[-1]["contexts"], needed.column("c").to_numpy().view(np.uint64))] = True
    keep_suffixes(levels)
    top = _kept_tree(root, levels)
    common = top
    if full:
        longer = _levels_of(rows.where("common").toArrow())
        common = SuffixTree(root, *(a + b for a, b in zip((top.contexts, top.escapes, top.entries, top.logs), longer, strict=True)))
    bits = np.zeros(1 << SLOT_BITS - 3, np.uint8)
    slots = rows.where("slot >= 0").select("slot").distinct().toArrow().column("slot").to_numpy()
    np.bitwise_or.at(bits, slots >> 3, (1 << (slots & 7)).astype(np.uint8))
    return FittedTree(top, common, rows, bits)


def _buckets(grams: np.ndarray, many: int) -> np.ndarray:
    """The bucket of each gram's ending; grams that meet the same kept contexts share it."""
    part = grams >> np.uint64(8) & _mask(TOP + 1)
    return ((part * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(many)).astype(np.int64)


def _pack(numbers: np.ndarray) -> bytes:
    """Numbers as planes of equal bytes, compressed."""
    return zstandard.compress(np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, numbers.itemsize).T).tobytes(), 1)


def _unpack(blob: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


_BLOCKS = "unit long, bucket int, blobs array<binary>"


def _blocks(units: list[int], buckets: list[int], blobs: list[list[bytes]]) -> list[pa.Array]:
    return [pa.array(units, pa.int64()), pa.array(buckets, pa.int32()), pa.array(blobs, pa.list_(pa.binary()))]


def _steps(sorted_numbers: np.ndarray) -> np.ndarray:
    """Differences, modulo the width of the type; ``_unsteps`` sums them again."""
    return np.diff(sorted_numbers, prepend=sorted_numbers.dtype.type(0))


def _unsteps(steps: np.ndarray) -> np.ndarray:
    return np.cumsum(steps, dtype=steps.dtype)


class _Unit:
    """Open grams of some documents of a task, until they are many enough to be written."""

    def __init__(self, buckets: int):
        self.buckets = buckets
        self.clear()

    def clear(self) -> None:
        self.rows, self.kinds, self.grams, self.often, self.size = [], [], [], [], 0

    def add(self, rows: np.ndarray, kinds: np.ndarray, grams: np.ndarray, often: np.ndarray) -> None:
        """``kinds[i]`` distinct grams of document ``rows[i]``, one document after the other, and how often they occur."""
        own = kinds > 0
        for held, more in zip((self.rows, self.kinds, self.grams, self.often), (rows[own], kinds[own], grams, often), strict=True):
            held.append(more)
        self.size += len(grams)

    def close(self) -> tuple[list[int], list[int], list[list[bytes]]]:
        """Blocks of distinct grams by bucket, and as bucket -1 the documents with their grams' numbers."""
        if not self.size:
            return [], [], []
        rows, kinds, grams, often = (np.concatenate(x) for x in (self.rows, self.kinds, self.grams, self.often))
        self.clear()
        grams, place = np.unique(grams, return_inverse=True)
        bucket = _buckets(grams, self.buckets)
        order = np.argsort(bucket, kind="stable")
        number = np.empty(len(order), np.uint32)
        number[order] = np.arange(len(order), dtype=np.uint32)
        place, of = number[place], np.repeat(np.arange(len(kinds)), kinds)
        by = np.lexsort((place, of))
        links = [_pack(_steps(rows)), _pack(kinds.astype(np.uint32)), _pack(_steps(place[by])), _pack(often[by].astype(np.uint32))]
        grams, bucket = grams[order], bucket[order]
        bounds = group_bounds([bucket])
        here = bucket[bounds[:-1]].tolist()
        blobs = [[_pack(_steps(grams[a:b]))] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        return [int(rows[0])] * (len(here) + 1), [-1, *here], [links, *blobs]


def _tree_blocks(buckets: int):
    """Kept contexts in blocks by bucket, as unit -1."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            k, gram, log, escape = (batch.column(c).to_numpy() for c in ("k", "gram", "log", "escape"))
            bucket = _buckets(gram.view(np.uint64), buckets)
            order = np.argsort(bucket, kind="stable")
            bounds = group_bounds([bucket[order]])
            blobs = [[_pack(x[order[a:b]]) for x in (k, gram, log, escape)] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(_blocks([-1] * len(blobs), bucket[order][bounds[:-1]].tolist(), blobs), ["unit", "bucket", "blobs"])
    return run


def _answer(shared: Broadcast):
    """Logs of each unit's grams of a bucket, in their order; the bucket's kept contexts come before them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = SuffixTree(**shared.value)
        bucket, held, tree = -1, [], None
        for batch in small_batches(batches, 100):
            units, logs, of = [], [], []
            for unit, here, blobs in zip(*(batch.column(c).to_pylist() for c in ("unit", "bucket", "blobs")), strict=True):
                if here != bucket:
                    bucket, held, tree = here, [], None
                if unit < 0:
                    held.append([_unpack(b, t) for b, t in zip(blobs, (np.int32, np.int64, np.float64, np.float64), strict=True)])
                    continue
                if tree is None:
                    kept = [np.concatenate(x) for x in zip(*held, strict=True)] if held else [np.zeros(0, t) for t in (np.int32, np.int64, np.float64, np.float64)]
                    longer = _levels_of(pa.table(dict(zip(("k", "gram", "log", "escape"), kept, strict=True))))
                    tree = SuffixTree(top.root, *(a + b for a, b in zip((top.contexts, top.escapes, top.entries, top.logs), longer, strict=True)))
                    held = []
                units.append(unit)
                of.append(here)
                logs.append([_pack(tree.score(_unsteps(_unpack(blobs[0], np.uint64))))])
            yield pa.RecordBatch.from_arrays(_blocks(units, of, logs), ["unit", "bucket", "blobs"])
    return run


def _open_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums by document; a unit's documents come first, then the logs of its grams by bucket."""
    links, logs = None, []

    def out() -> pa.RecordBatch:
        rows, kinds = _unsteps(_unpack(links[0], np.int64)), _unpack(links[1], np.uint32).astype(np.int64)
        found = np.concatenate(logs)[_unsteps(_unpack(links[2], np.uint32))] * _unpack(links[3], np.uint32)
        return pa.RecordBatch.from_arrays([pa.array(rows), pa.array(np.add.reduceat(found, np.cumsum(kinds) - kinds) / np.log(10))], ["row", "open_part"])

    for batch in small_batches(batches, 100):
        for bucket, blobs in zip(batch.column("bucket").to_pylist(), batch.column("blobs").to_pylist(), strict=True):
            if bucket >= 0:
                logs.append(_unpack(blobs[0], np.float64))
                continue
            if links:
                yield out()
            links, logs = blobs, []
    if links:
        yield out()


_MASKS = np.array([(1 << 8 * k) - 1 for k in range(DEPTH + 1)], np.uint64)


class GramScores:
    """Scores of grams, remembered in a direct-mapped table of fixed size; NaN where a rarer context may decide."""

    def __init__(self, tree: SuffixTree, bits: np.ndarray):
        self.tree, self.bits = tree, bits
        self.keys = np.full(1 << CACHE_BITS, np.uint64(2**64 - 1))
        self.logs = np.zeros(1 << CACHE_BITS)

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        slot = ((grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - CACHE_BITS)).astype(np.int64)
        out = self.logs[slot]
        miss = np.flatnonzero(self.keys[slot] != grams)
        if len(miss):
            wanted, place = np.unique(grams[miss], return_inverse=True)
            logs, depth = self.tree.walk(wanted)
            slots = _slots(wanted >> np.uint64(8) & _MASKS[np.minimum(depth + 1, DEPTH)], depth + 1)
            logs[(depth < DEPTH) & (self.bits[slots >> 3] >> (slots & 7).astype(np.uint8) & 1).astype(bool)] = np.nan
            out[miss] = logs[place]
            at = ((wanted * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - CACHE_BITS)).astype(np.int64)
            self.keys[at], self.logs[at] = wanted, logs  # of equal slots the last one stays in both
        return out


_SCORED = ("doc_id long, row long, n_tokens long, known long, part double, score double, rare array<binary>, times array<long>, " + _BLOCKS)


def _score(shared: Broadcast, buckets: int):
    """A row for each document, and rows without ``row`` for the blocks of units."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, bits, common = shared.value
        score, unit = GramScores(SuffixTree(**parts), bits), _Unit(buckets)
        schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("part", pa.float64()),
                            ("score", pa.float64()), ("rare", pa.list_(pa.binary())), ("times", pa.list_(pa.int64())),
                            ("unit", pa.int64()), ("bucket", pa.int32()), ("blobs", pa.list_(pa.binary()))])

        def closed() -> pa.RecordBatch:
            made = _blocks(*unit.close())
            return pa.RecordBatch.from_arrays([pa.nulls(len(made[0]), f.type) for f in schema][:8] + made, schema=schema)

        for batch in small_batches(batches, 2000):
            if not batch.num_rows:
                continue
            logs, sizes, known, base, rare, times = [], [], [], [], [], []
            ids, done = batch.column("row").to_numpy(), 0
            for block in _text_blocks([batch]):
                grams, begins = grams_of([b" ".join(words) + b"\n" for words in block])
                found = score(grams)
                still = np.flatnonzero(np.isnan(found))
                found[still] = 0.0
                logs.extend((np.add.reduceat(found, begins) / np.log(10)).tolist())
                of, left = np.searchsorted(begins, still, "right") - 1, grams[still]
                order = np.lexsort((left, of))
                bounds = group_bounds([of[order], left[order]]) if len(order) else np.zeros(1, np.int64)
                unit.add(ids[done:done + len(block)], np.bincount(of[order][bounds[:-1]], minlength=len(block)), left[order][bounds[:-1]], np.diff(bounds))
                done += len(block)
                if unit.size > UNIT_GRAMS:
                    yield closed()
                for words in block:
                    counts = Counter(words)
                    there = [(n, c) for w, n in counts.items() if (c := common.get(w))]
                    other = [(w, n) for w, n in counts.items() if w not in common]
                    sizes.append(len(words) + 1)
                    known.append(sum(n for n, _ in there))
                    base.append(float(np.dot([n for n, _ in there], np.log10([c + 1 for _, c in there]))) if there else 0.0)
                    rare.append([w for w, _ in other])
                    times.append([n for _, n in other])
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("row"), pa.array(sizes, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()),
                pa.array(logs, pa.float64()), pa.array(rare, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int64())),
                *(pa.nulls(batch.num_rows, f.type) for f in list(schema)[8:])], schema=schema)
        if unit.size:
            yield closed()
    return run


def score_texts(docs: DataFrame, learn: Column | None = None, common_share: float = COMMON_SHARE,
                min_count: int = MIN_COUNT, broadcast_share: float = BROADCAST_SHARE) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` of every row of ``docs`` (``doc_id, text``).

    ``learn`` marks the rows to learn from (default: ``training_rows``).  Scores
    are log10 probabilities of the whole text.  A null text is an empty one:
    one token, its end.  With nothing to learn from, bytes are uniform and
    the base score is 0.  Repeated rows come back once each.
    """
    learn = training_rows(F.col("doc_id")) if learn is None else learn
    texts = docs.where(learn).select("text")
    tree = fit_tree(texts, min_count, broadcast_share=broadcast_share)
    counts = stored(texts.mapInArrow(_count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    ends = texts.count()
    words, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    tokens, distinct = words + ends, kinds + (ends > 0)
    often = counts.where(F.col("n") >= F.lit(max(1.0, common_share * tokens)))
    often = often.toArrow()
    shared = docs.sparkSession.sparkContext.broadcast((vars(tree.common), tree.bits, dict(zip(often.column("word").to_pylist(), often.column("n").to_pylist(), strict=True))))
    buckets = max(BUCKETS, tree.rows.count() // BUCKET_ROWS)
    scored = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("row")).mapInArrow(
        _score(shared, buckets), _SCORED), "scored")
    found = scored.where(F.col("row").isNotNull())
    tail = found.select("row", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("row", F.col("r.rare").alias("word"), F.col("r.times").alias("times"))
    met = tail.join(counts.withColumnRenamed("n", "c"), "word").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("rare_part"), F.sum("times").alias("rare_known"))
    # bytes whose longest kept context is, or may be, rare
    blocks = scored.where(F.col("row").isNull()).select("unit", "bucket", "blobs")
    kept = tree.rows.select("k", "gram", "log", "escape").mapInArrow(_tree_blocks(buckets), _BLOCKS)
    top = docs.sparkSession.sparkContext.broadcast(vars(tree.top))
    answers = kept.unionByName(blocks.where("bucket >= 0")).repartition("bucket").sortWithinPartitions("bucket", "unit").mapInArrow(_answer(top), _BLOCKS)
    longer = answers.unionByName(blocks.where("bucket < 0")).repartition("unit").sortWithinPartitions("unit", "bucket").mapInArrow(
        _open_sums, "row long, open_part double")
    zero = F.lit(0)
    return found.drop("rare", "times", "unit", "bucket", "blobs").join(met, "row", "left").join(longer, "row", "left").select(
        "doc_id", "n_tokens", (F.col("known") + F.coalesce("rare_known", zero) + F.lit(int(ends > 0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("part") + F.coalesce("rare_part", F.lit(0.0)) + F.lit(float(np.log10(ends + 1))) - F.col("n_tokens") * F.lit(float(np.log10(tokens + distinct + 1)))).alias("base_score"),
        (F.col("score") + F.coalesce("open_part", F.lit(0.0))).alias("score"))
