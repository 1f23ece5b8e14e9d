"""Near-duplicate vectors by Euclidean p-stable hashing and exact cosine checks.

Normalised vectors with cosine c lie sqrt(2 - 2c) apart.  A table hashes a
vector by ``k`` quantised random projections floor((a.x + s) / w); vectors that
share a bucket in some table are compared.  A pair is counted in the first
table where it meets, so no pair has to be shuffled to be counted once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from palisade.llm.common import cut, group_bounds, stars, whole_groups
from palisade.llm.graph import components

#: Width of a quantisation step in distances at the threshold.
WIDTH = 4.0
#: Vectors in a bucket, on average over a table of unrelated vectors.
BUCKET_ROWS = 64
#: Chance that a pair exactly at the threshold meets in no table.
MISS = 0.004
BLOCK_ROWS = 1024
HOT_ROWS = 50_000


def meets(ratio: float) -> float:
    """Chance that one projection puts two vectors, a step width of ``ratio`` distances apart, into one step."""
    tail = 0.5 * math.erfc(ratio / math.sqrt(2))
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * ratio) * (1 - math.exp(-ratio * ratio / 2))


def table_sizes(rows: int, cosine: float) -> tuple[int, int]:
    """Projections per table and tables: buckets of bounded size, and the wanted chance to meet."""
    distance = math.sqrt(2 - 2 * cosine)
    apart = meets(WIDTH * distance / math.sqrt(2))
    k = max(4, round(math.log(max(rows, 1) / BUCKET_ROWS) / -math.log(apart))) if rows > BUCKET_ROWS else 4
    return k, math.ceil(math.log(MISS) / math.log1p(-meets(WIDTH) ** k))


def bucket_ids(unit: np.ndarray, k: int, tables: int, cosine: float, seed: int = 17) -> np.ndarray:
    """One 32-bit bucket number per vector and table."""
    rng = np.random.default_rng([seed, unit.shape[1]])
    width = WIDTH * math.sqrt(2 - 2 * cosine)
    steps = unit @ rng.standard_normal((unit.shape[1], tables * k)) + rng.uniform(0, width, tables * k)
    cells = np.floor(steps / width).astype(np.int64).reshape(len(unit), tables, k)
    mix = rng.integers(1, 1 << 62, (tables, k), dtype=np.int64) | 1
    with np.errstate(over="ignore"):
        mixed = (cells * mix).sum(axis=2)
        mixed ^= mixed >> 29
    return (mixed & 0xFFFFFFFF).astype(np.uint32).view(np.int32)


def _matrix(column, dtype) -> np.ndarray:
    flat = np.frombuffer(b"".join(column.to_pylist()), dtype)
    return flat.reshape(len(column), -1)


def _units(rows: np.ndarray) -> np.ndarray:
    wide = rows.astype(np.float64)
    scale = np.abs(wide).max(axis=1, keepdims=True)
    wide = wide / scale
    return wide / np.sqrt((wide * wide).sum(axis=1, keepdims=True))


def usable(vector: str = "embedding"):
    """Vectors that can be compared: not null, not empty or zero, all components finite."""
    x = F.col(vector)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return x.isNotNull() & ~F.coalesce(bad, F.lit(False)) & F.coalesce(F.exists(x, lambda v: v != 0), F.lit(False))


def _hash_rows(k: int, tables: int, cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["tab", "key", "dim", "vec_id", "n", "vec", "keys"]
        for batch in batches:
            lists = batch.column("embedding").to_pylist()
            dims = np.array([len(v) for v in lists])
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                for some in (at[i:i + 512] for i in range(0, len(at), 512)):
                    raw = np.array([lists[i] for i in some], np.float64)
                    ids = bucket_ids(_units(raw), k, tables, cosine)
                    vecs, keys = [r.tobytes() for r in raw.astype(np.float32 if np.array_equal(raw, raw.astype(np.float32)) else np.float64)], [r.tobytes() for r in ids]
                    take = np.repeat(np.arange(len(some)), tables)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.tile(np.arange(tables, dtype=np.int32), len(some))), pa.array(ids.reshape(-1)),
                        pa.array(np.full(len(take), dim, np.int32)), batch.column("vec_id").take(pa.array(some[take])),
                        batch.column("n").take(pa.array(some[take])), pa.array(vecs, pa.binary()).take(pa.array(take)),
                        pa.array(keys, pa.binary()).take(pa.array(take))], names)
    return run


def _unit_rows(column, dim: int) -> np.ndarray:
    blobs = column.to_pylist()
    wide = [np.frombuffer(b, np.float32 if len(b) == 4 * dim else np.float64) for b in blobs]
    return _units(np.stack(wide))


def _pairs(tab: int, x: np.ndarray, y: np.ndarray, kx: np.ndarray, ky: np.ndarray, same: bool, cosine: float):
    """Positions of pairs with the wanted cosine that meet in no earlier table, a few rows at a time."""
    for lo in range(0, len(x), 128):
        i, j = np.nonzero(x[lo:lo + 128] @ y.T >= cosine)
        i += lo
        if same:
            i, j = i[i < j], j[i < j]
        if tab:
            new = ~(kx[i, :tab] == ky[j, :tab]).any(axis=1)
            i, j = i[new], j[new]
        yield i, j


def _compare(cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = ["tab", "key", "dim", "b0", "b1"]
        for chunk in whole_groups(batches, order, 20_000):
            bounds = group_bounds([chunk.column(c).to_numpy() for c in order])
            keep = np.repeat(np.diff(bounds) > 1, np.diff(bounds))
            if not keep.any():
                continue
            chunk = chunk.filter(pa.array(keep)).combine_chunks()
            bounds = group_bounds([chunk.column(c).to_numpy() for c in order])
            tab, dim, side, b0, b1, ids, n = (chunk.column(c).to_numpy() for c in ("tab", "dim", "side", "b0", "b1", "vec_id", "n"))
            keys, vecs = chunk.column("keys"), chunk.column("vec")
            counts_of, counts, left, right = [], [], [], []
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                unit, k = _unit_rows(vecs.slice(lo, hi - lo), dim[lo]), _matrix(keys.slice(lo, hi - lo), np.int32)
                same = b0[lo] == b1[lo]
                mid = len(unit) if same else int((side[lo:hi] == 0).sum())
                first, second = (slice(0, mid), slice(0, mid)) if same else (slice(0, mid), slice(mid, None))
                if not len(unit[second]) or not len(unit[first]):
                    continue
                mine, other = ids[lo:hi][first], ids[lo:hi][second]
                found = np.zeros(len(mine), np.int64), np.zeros(len(other), np.int64)
                for i, j in _pairs(tab[lo], unit[first], unit[second], k[first], k[second], same, cosine):
                    np.add.at(found[0], i, n[lo:hi][second][j])
                    np.add.at(found[1], j, n[lo:hi][first][i])
                    a, b = stars(mine[i], other[j])
                    left.append(a)
                    right.append(b)
                for who, many in zip((mine, other), found, strict=True):
                    counts_of.append(who[many > 0])
                    counts.append(many[many > 0])
            if not counts:
                continue
            a, b = stars(np.concatenate(left or [ids[:0]]), np.concatenate(right or [ids[:0]]))
            who, place = np.unique(np.concatenate(counts_of), return_inverse=True)
            many = np.bincount(place, np.concatenate(counts), len(who)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([a, who])), pa.array([*b.tolist(), *[None] * len(who)], pa.int64()),
                pa.array(np.concatenate([np.zeros(len(a), np.int64), many]))], ["a", "b", "n"])
    return run


def near_vectors(vectors: DataFrame, cosine: float = 0.9, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``vectors`` (``vec_id, embedding``; other columns are ignored).

    Links join vectors of equal length whose cosine, in double precision, is at
    least ``cosine``.  Identical vectors are one class: compared once, counted
    as often as they occur.  A vector that is null, empty, zero or holds a null
    or non-finite component links with nothing, nor does a row without an id,
    whose component is null and ``kept`` false.  A bucket over ``block_rows``
    classes is cut into blocks, and pairs of blocks are groups of their own.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    able = rows.where(usable() & F.col("vec_id").isNotNull())
    classes = cut(able.groupBy("embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("n")))
    k, tables = table_sizes(classes.count(), cosine)
    hashed = classes.mapInArrow(_hash_rows(k, tables, cosine), "tab int, key int, dim int, vec_id long, n long, vec binary, keys binary")
    narrow = classes.select("vec_id", "n", "embedding").mapInArrow(_hash_rows(k, tables, cosine), "tab int, key int, dim int, vec_id long, n long, vec binary, keys binary")
    hot = cut(narrow.groupBy("tab", "key", "dim").count().where(F.col("count") > block_rows).select(
        "tab", "key", "dim", F.ceil(F.col("count") / block_rows).cast("int").alias("blocks")))
    n_hot = hot.count()
    if n_hot:
        dealt = hashed.join(F.broadcast(hot) if n_hot <= HOT_ROWS else hot, ["tab", "key", "dim"], "left").fillna(1, ["blocks"])
    else:
        dealt = hashed.withColumn("blocks", F.lit(1))
    mine = F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")
    dealt = dealt.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("tab", "key", "dim", F.least("mine", "other").alias("b0"), F.greatest("mine", "other").alias("b1"),
                         (F.col("mine") > F.col("other")).cast("int").alias("side"), "vec_id", "n", "vec", "keys")
    order = ["tab", "key", "dim", "b0", "b1"]
    met = cut(dealt.repartition(*order).sortWithinPartitions(*order, "side").mapInArrow(_compare(cosine), "a long, b long, n long"))
    others = met.where("b IS NULL").groupBy(F.col("a").alias("first")).agg(F.sum("n").alias("others"))
    roots = components(met.where("b IS NOT NULL").select("a", "b"))
    named = classes.select("embedding", F.col("vec_id").alias("first"), "n").join(others, "first", "left").join(
        roots, F.col("first") == roots.node, "left")
    named = named.select("embedding", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "first").alias("root"))
    linked = able.join(named, "embedding").select("vec_id", "n_links", F.col("root").alias("component_id"))
    alone = rows.where(~(usable() & F.col("vec_id").isNotNull())).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
