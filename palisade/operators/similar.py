"""Similar events through an index: random hyperplanes bring likely neighbours together, exact cosines decide.

The sign of a vector's product with a random vector is the same for two
vectors at the angle a with chance 1 - a / pi.  A table's key is ``bits`` such
signs, enough for buckets of bounded size; there are so many tables that two
vectors at the threshold miss each other in all of them with chance ``miss``.

Tables share their first signs in groups.  A group deals out the vectors by
these signs, so that each travels once per group, and its tables are built by
the tasks that get a cell of it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from palisade.session import truncate_lineage

#: Samples in a bucket, on average over unrelated vectors.
BUCKET_ROWS = 64
#: A larger bucket is compared in blocks of this many rows, and four times as many samples.
BLOCK_ROWS = 1024
#: Bytes of a block of vectors, of a block of samples, and of the samples that a task meets at a time.
VECTORS_BYTES, SAMPLES_BYTES, TASK_BYTES = 2 << 20, 8 << 20, 64 << 20
#: More tables than this cost more than comparing everything.
MAX_TABLES = 400
#: Cells that all groups have together, at least; more where a cell would have over ``TASK_BYTES`` of samples.
LEAST_CELLS = 32
#: Crowded cells that are broadcast; more are joined.
HOT_ROWS = 50_000
_MEMBER = "struct<id:bigint,ts:timestamp,source_ip:string,event_type:string,was_anomaly:boolean>"


def references(samples: DataFrame, newest: int | None = None) -> DataFrame:
    """``id, features`` and what comes back with a neighbour; missing columns are NULL."""
    have = {"ts": "timestamp", "source_ip": "string", "event_type": "string", "label": "boolean"}
    known = {c: F.col(c) if c in samples.columns else F.lit(None).cast(t) for c, t in have.items()}
    refs = samples.select("id", "features", known["ts"].alias("ts"), known["source_ip"].alias("source_ip"),
                          known["event_type"].alias("event_type"), F.coalesce(known["label"], F.lit(False)).alias("was_anomaly"))
    return refs.orderBy(F.desc("ts"), F.desc("id")).limit(newest) if newest is not None else refs


def packed(rows: DataFrame, member: Column, room: int, task_room: int) -> DataFrame:
    """(block, dim, vec, members): ``rows`` in blocks of ``room`` bytes of vectors; a partition has ``task_room`` bytes of them."""
    size = rows.agg(F.sum(F.size("features"))).first()[0] or 0
    dealt = rows.select(member.alias("member"), "features").repartition(max(1, -(-8 * size // task_room)))
    kind = dealt.schema["member"].dataType.simpleString()
    blocks = dealt.mapInArrow(_in_blocks(room), f"dim int, vec binary, members array<{kind}>")
    return truncate_lineage(blocks.select(F.monotonically_increasing_id().alias("block"), "*"))


def _in_blocks(room: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.RecordBatch]] = {}

        def blocks(dim: int, least: int) -> Iterator[pa.RecordBatch]:
            most = max(1, room // (8 * dim))
            while sum(b.num_rows for b in held[dim]) >= least:
                whole = pa.Table.from_batches(held[dim]).combine_chunks()
                block, held[dim] = whole.slice(0, most), whole.slice(most).to_batches()
                members = block.column("member").combine_chunks()
                vec = block.column("features").combine_chunks().flatten().to_numpy(zero_copy_only=False).tobytes()
                yield pa.RecordBatch.from_arrays([
                    pa.array([dim], pa.int32()), pa.array([vec], pa.binary()),
                    pa.ListArray.from_arrays(pa.array([0, len(members)], pa.int32()), members)], ["dim", "vec", "members"])

        for batch in batches:
            dims = batch.column("features").value_lengths().to_numpy()
            for dim in np.unique(dims):
                held.setdefault(int(dim), []).append(batch.take(pa.array(np.flatnonzero(dims == dim))))
                yield from blocks(int(dim), max(1, room // (8 * int(dim))))
        for dim in held:
            yield from blocks(dim, 1)
    return run


def slack(dim: int) -> float:
    """By how much the product of two unit vectors can be off, in whatever order it is summed."""
    return (dim + 16) * 1e-15


def likely(own: np.ndarray, other: np.ndarray, floor: np.ndarray, top: int, same: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of unit vectors that have at least ``floor`` and may be among the ``top`` of i; never those of ``same`` (rows i, j)."""
    cosine = own @ other.T
    if same is not None:
        cosine[same[0], same[1]] = -2.0
    hit = cosine >= floor[:, None]
    crowded = np.flatnonzero(np.count_nonzero(hit, axis=1) > 4 * top)  # so there are more columns than ``top``
    if len(crowded):
        some = cosine[crowded]
        last = np.partition(some, some.shape[1] - top, axis=1)[:, some.shape[1] - top]
        hit[crowded] &= some >= (last - 2 * slack(own.shape[1]))[:, None]
    return np.nonzero(hit)


def products(own: np.ndarray, other: np.ndarray, i: np.ndarray, j: np.ndarray, room: int = 50_000) -> np.ndarray:
    """The cosine of every pair, the same for the same two vectors wherever they lie."""
    parts = [np.einsum("ij,ij->i", own[i[s:s + room]], other[j[s:s + room]]) for s in range(0, len(i), room)]
    return np.concatenate(parts) if parts else np.zeros(0)


def ranked(rows: int, i: np.ndarray, value: np.ndarray, tie: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of the ``top`` pairs of every row, in order, and each row's last value if it has that many."""
    order = np.lexsort([tie, -value, i])
    mine = i[order]
    place = np.arange(len(order)) - np.searchsorted(mine, mine, "left")
    last = np.full(rows, -np.inf)
    full = order[place == top - 1]
    last[i[full]] = value[full]
    return order[place < top], last


def _unit(vec: bytes, dim: int) -> np.ndarray:
    raw = np.frombuffer(vec).reshape(-1, dim)
    scale = np.linalg.norm(raw, axis=1)[:, None]
    return np.divide(raw, scale, out=np.zeros_like(raw), where=(scale > 0) & np.isfinite(scale))


class _Best:
    """The best samples so far of a block of vectors."""

    def __init__(self, block: int, dim: int, vec: bytes, ids: pa.Array, least: float, top: int):
        self.block, self.dim, self.least, self.top = block, dim, least, top
        self.unit, self.ids = _unit(vec, dim), ids.to_numpy()
        self.order = np.argsort(self.ids, kind="stable")
        self.i, self.value, self.tie, self.members = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), None
        self.last = np.full(len(self.ids), -np.inf)

    def meet(self, vec: bytes, members: pa.StructArray) -> None:
        other, ids = _unit(vec, self.dim), members.field("id").to_numpy()
        before, off = len(self.i), slack(self.dim)
        i, value, tie, at = self.i, self.value, self.tie, np.arange(-before, 0)
        low, high = (np.searchsorted(self.ids[self.order], ids, side) for side in ("left", "right"))
        twins = np.repeat(np.arange(len(ids)), high - low)
        own = self.order[np.arange(len(twins)) - np.repeat(np.cumsum(high - low) - high, high - low)]
        for c in range(0, len(other), 4 * BLOCK_ROWS):
            for r in range(0, len(self.unit), BLOCK_ROWS):
                rows, columns = self.unit[r:r + BLOCK_ROWS], other[c:c + 4 * BLOCK_ROWS]
                here = (own >= r) & (own < r + len(rows)) & (twins >= c) & (twins < c + len(columns))
                floor = np.maximum(self.least - off, self.last[r:r + len(rows)] - 2 * off)
                a, b = likely(rows, columns, floor, self.top, (own[here] - r, twins[here] - c))
                exact = products(rows, columns, a, b)
                good = exact > self.least
                i, value = np.concatenate([i, a[good] + r]), np.concatenate([value, exact[good]])
                tie, at = np.concatenate([tie, ids[b[good] + c]]), np.concatenate([at, b[good] + c])
            best, self.last = ranked(len(self.ids), i, value, tie, self.top)
            i, value, tie, at = i[best], value[best], tie[best], at[best]
        new = np.unique(at[at >= 0])
        both = members.take(pa.array(new))
        both = pa.concat_arrays([self.members, both]) if before else both
        self.members = both.take(pa.array(np.where(at < 0, at + before, before + np.searchsorted(new, at))))
        self.i, self.value, self.tie = i, value, tie

    def found(self) -> Iterator[pa.RecordBatch]:
        if len(self.i):
            rows, start = np.unique(self.i, return_index=True)
            names = [f.name for f in self.members.type]
            each = pa.StructArray.from_arrays([pa.array(self.value), *self.members.flatten()], names=["similarity", *names])
            ends = pa.array(np.append(start, len(self.i)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(self.ids[rows]), pa.ListArray.from_arrays(ends, each)], ["id", "similar"])


def best_of_blocks(least: float, top: int):
    """Over rows of two blocks: the ``top`` samples above ``least`` of every vector among the blocks of samples that follow each other."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = None
        for batch in batches:
            for n in range(batch.num_rows):
                block, dim, samples_dim = (batch.column(c)[n].as_py() for c in ("block", "dim", "samples_dim"))
                if dim != samples_dim:
                    continue
                if mine is None or mine.block != block:
                    if mine is not None:
                        yield from mine.found()
                    mine = _Best(block, dim, batch.column("vec")[n].as_buffer(), batch.column("members")[n].values.field("id"), least, top)
                mine.meet(batch.column("samples_vec")[n].as_buffer(), batch.column("samples")[n].values)
        if mine is not None:
            yield from mine.found()
    return run


def index_sizes(rows: int, least: float, miss: float) -> tuple[int, int]:
    """Bits of a key and tables for a number of samples and a cosine."""
    same = 1 - math.acos(max(-1.0, min(1.0, least))) / math.pi
    bits = max(1, round(math.log2(max(rows, 1) / BUCKET_ROWS))) if rows > BUCKET_ROWS else 1
    return bits, max(1, math.ceil(math.log(miss) / math.log1p(-same ** bits))) if same < 1 else 1


def group_sizes(bits: int, least: float, miss: float, cells: int) -> tuple[int, int, int]:
    """First signs that the tables of a group share, groups, and tables of a group.

    So few first signs that a group has ``cells`` at least, and tables enough that more of them would spare few groups.
    """
    same = 1 - math.acos(max(-1.0, min(1.0, least))) / math.pi

    def groups(first: int, tables: float) -> int:
        meet = same ** first * (1 - (1 - same ** (bits - first)) ** tables)
        return max(1, math.ceil(math.log(miss) / math.log1p(-meet))) if meet < 1 else 1

    for first in range(1, bits + 1):
        fewest = groups(first, math.inf)
        tables = next(t for t in (1 << k for k in range(64)) if groups(first, t) <= max(fewest * 1.15, fewest + 1))
        if 1 << first >= cells and groups(first, tables) << first >= LEAST_CELLS:
            break
    return first, groups(first, tables), tables


def hyperplane_keys(vectors: np.ndarray, bits: int, tables: int, seed: int) -> np.ndarray:
    """The key of every vector in every table."""
    planes = np.random.default_rng([seed, vectors.shape[1]]).standard_normal((vectors.shape[1], tables * bits))
    signs = (vectors @ planes > 0).reshape(len(vectors), tables, bits)
    keys = np.zeros((len(vectors), tables), np.int64)
    for b in range(bits):
        keys = keys * 2 + signs[:, :, b]
    return keys


def _scaled(raw: np.ndarray) -> np.ndarray:
    unit = raw / np.abs(raw).max(axis=1, keepdims=True)
    return unit / np.linalg.norm(unit, axis=1, keepdims=True)


def _hashed(first: int, groups: int, seed: int):
    """Every vector with its key in every group; a vector that single precision holds exactly travels in it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("features").value_lengths().to_numpy()
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                for some in (at[i:i + 512] for i in range(0, len(at), 512)):
                    rows = batch.take(pa.array(some))
                    raw = rows.column("features").flatten().to_numpy(zero_copy_only=False).reshape(len(some), dim)
                    with np.errstate(over="ignore"):
                        short = raw.astype(np.float32)
                    exact = (short == raw).all(axis=1)
                    keys = hyperplane_keys(_scaled(raw), first, groups, seed).reshape(-1)
                    yield pa.RecordBatch.from_arrays([
                        rows.column("mine"), rows.column("class"), pa.array(np.full(len(some), dim, np.int32)),
                        pa.array([(s if e else r).tobytes() for s, r, e in zip(short, raw, exact)], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, len(keys) + 1, groups, dtype=np.int32)), pa.array(keys))],
                        ["mine", "class", "dim", "vec", "keys"])
    return run


def _read(vec: pa.BinaryArray, dim: int) -> np.ndarray:
    raw, out = vec.to_pylist(), np.empty((len(vec), dim))
    short = np.fromiter((len(v) == 4 * dim for v in raw), bool, len(raw))
    for kind, at in ((np.float32, np.flatnonzero(short)), (np.float64, np.flatnonzero(~short))):
        out[at] = np.frombuffer(b"".join(raw[i] for i in at), kind).reshape(len(at), dim)
    return out


GROUP = ["tab", "key", "dim", "b0", "b1"]


def _buckets(batches: Iterator[pa.RecordBatch], rows: int = 20_000) -> Iterator[pa.Table]:
    """Sorted batches as tables of whole groups."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            whole = pa.Table.from_batches(held)
            last = np.ones(n, bool)
            for c in GROUP:
                values = whole.column(c).to_numpy()
                last &= values == values[-1]
            start = n - int(np.argmin(last[::-1])) if not last.all() else 0
            if start:
                yield whole.slice(0, start)
                held, n = whole.slice(start).combine_chunks().to_batches(), n - start
    if n:
        yield pa.Table.from_batches(held)


def _near(own: np.ndarray, other: np.ndarray, keys: Iterator[tuple[np.ndarray, np.ndarray]], tie: np.ndarray, least: float, top: int):
    """(i, j, cosine): the ``top`` of every row among what has its key in one of the tables."""
    off, last = slack(own.shape[1]), np.full(len(own), -np.inf)
    i, j, value = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    for mine, theirs in keys:
        left, right = np.argsort(mine, kind="stable"), np.argsort(theirs, kind="stable")
        shared = np.intersect1d(mine, theirs)
        ends = [np.searchsorted(k[o], shared, side) for k, o in ((mine, left), (theirs, right)) for side in ("left", "right")]
        found = [(i, j, value)]
        for l0, l1, r0, r1 in zip(*ends):
            for a in (left[k:min(k + BLOCK_ROWS, l1)] for k in range(l0, l1, BLOCK_ROWS)):
                rows, floor = own[a], np.maximum(least - off, last[a] - 2 * off)
                for b in (right[k:min(k + 4 * BLOCK_ROWS, r1)] for k in range(r0, r1, 4 * BLOCK_ROWS)):
                    columns = other[b]
                    x, y = likely(rows, columns, floor, top)
                    if len(x):
                        found.append((a[x], b[y], products(rows, columns, x, y)))
        if len(found) > 1:
            i, j, value = (np.concatenate(c) for c in zip(*found))
            once = np.unique(i * len(other) + j, return_index=True)[1]
            once = once[value[once] > least]
            best, last = ranked(len(own), i[once], value[once], tie[j[once]], top)
            i, j, value = (c[once][best] for c in (i, j, value))
    return i, j, value


def _compared(bits: int, tables: int, seed: int, least: float, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _buckets(batches):
            columns = [table.column(c).to_numpy() for c in GROUP]
            change = np.ones(table.num_rows, bool)
            change[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
            bounds = np.append(np.flatnonzero(change), table.num_rows)
            mine, theirs, vecs = (table.column(c).combine_chunks() for c in ("mine", "class", "vec"))
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                left, right = (np.flatnonzero(c.slice(lo, hi - lo).is_valid().to_numpy(zero_copy_only=False)) for c in (mine, theirs))
                if not len(left) or not len(right):
                    continue
                dim, start = int(columns[2][lo]), seed + 1 + int(columns[0][lo]) * tables
                unit = _scaled(_read(vecs.slice(lo, hi - lo), dim))
                ids, classes = (c.take(pa.array(lo + at)).to_numpy() for c, at in ((mine, left), (theirs, right)))
                every = (hyperplane_keys(unit, bits, 1, start + t)[:, 0] for t in range(tables))
                i, j, value = _near(unit[left], unit[right], ((k[left], k[right]) for k in every), classes, least, top)
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (ids[i], classes[j], value)], ["mine", "class", "similarity"])
    return run


def similar_indexed(vectors: DataFrame, samples: DataFrame, *, newest: int | None = None, least: float = 0.8, top: int = 5,
                    miss: float = 0.03, seed: int = 11) -> DataFrame:
    """``similar_events`` through the index: work in proportion to the rows instead of to rows times samples.

    What it returns is exact, but a neighbour at the threshold is missed with
    chance ``miss``, a nearer one less often.  Equal vectors are one class, of
    whose samples only those with the smallest ids can be asked for.  Vectors
    that are NULL, zero or hold NULL or non-finite numbers are similar to
    nothing.  A vector travels once per group of tables, crowded cells are cut
    into blocks that meet each other, and only the best of a block leave it.  A
    threshold so low that it would take over 400 tables is an error: use
    ``similar_events``.
    """
    def able(df: DataFrame) -> DataFrame:
        x = F.col("features")
        bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
        return df.where(x.isNotNull() & ~F.coalesce(bad, F.lit(False)) & F.exists(x, lambda v: v != 0))

    refs = able(references(samples, newest)).withColumn("features", F.col("features").cast("array<double>"))
    rank = F.row_number().over(Window.partitionBy("features").orderBy("id"))
    few = refs.withColumn("n", rank).where(F.col("n") <= top + 1)
    member = F.struct(*[F.col(c) for c in ("id", "ts", "source_ip", "event_type", "was_anomaly")])
    known = truncate_lineage(few.groupBy("features").agg(F.min("id").alias("class"), F.collect_list(member).alias("members")))
    mine = able(vectors.select("id", F.col("features").cast("array<double>").alias("features")))
    own = truncate_lineage(mine.groupBy("features").agg(F.min("id").alias("class")))
    n, numbers = known.agg(F.count("*"), F.coalesce(F.sum(F.size("features")), F.lit(0))).first()
    bits, tables = index_sizes(n, least, miss)
    if tables > MAX_TABLES:
        raise ValueError(f"{tables} tables for cosines above {least}; similar_events compares everything")
    first, groups, tables = group_sizes(bits, least, miss, -(-8 * numbers // TASK_BYTES))
    none = F.lit(None).cast("long")
    both = own.select(F.col("class").cast("long").alias("mine"), none.alias("class"), "features").unionByName(
        known.select(none.alias("mine"), F.col("class").cast("long").alias("class"), "features"))
    both = both.groupBy("features").agg(F.max("mine").alias("mine"), F.max("class").alias("class"))
    hashed = truncate_lineage(both.mapInArrow(_hashed(first, groups, seed), "mine long, class long, dim int, vec binary, keys array<long>"))
    spread = hashed.select("mine", "class", "dim", "vec", F.posexplode("keys").alias("tab", "key"))
    sizes = spread.groupBy("tab", "key", "dim").agg(F.count("mine").alias("n0"), F.count("class").alias("n1"))
    room = F.greatest(F.floor(F.lit(2 * TASK_BYTES) / (8 * F.col("dim"))), F.lit(1))
    sizes = truncate_lineage(sizes.select("tab", "key", "dim", F.ceil(F.col("n0") / room).cast("int").alias("c0"), F.ceil(F.col("n1") / room).cast("int").alias("c1")))
    hot = sizes.where("greatest(c0, c1) > 1").select("tab", "key", "dim", *[F.greatest(c, F.lit(1)).alias(c) for c in ("c0", "c1")])
    n_cells, n_hot = sizes.agg(F.count("*"), F.count_if(F.greatest("c0", "c1") > 1)).first()
    if n_hot:
        spread = spread.join(F.broadcast(hot) if n_hot <= HOT_ROWS else hot, ["tab", "key", "dim"], "left").fillna(1, ["c0", "c1"])

        def at(c: str) -> Column:
            return F.pmod(F.xxhash64("vec"), F.col(c)).cast("int")

        def dealt_out(to: str, copy) -> Column:
            return F.transform(F.sequence(F.lit(0), F.col(to) - 1), copy)

        left = dealt_out("c1", lambda k: F.struct(at("c0").alias("b0"), k.alias("b1"), F.col("mine"), none.alias("class")))
        right = dealt_out("c0", lambda k: F.struct(k.alias("b0"), at("c1").alias("b1"), none.alias("mine"), F.col("class")))
        nothing = F.array().cast("array<struct<b0:int,b1:int,mine:bigint,class:bigint>>")
        split = F.concat(F.when(F.col("mine").isNotNull(), left).otherwise(nothing), F.when(F.col("class").isNotNull(), right).otherwise(nothing))
        whole = F.array(F.struct(F.lit(0).alias("b0"), F.lit(0).alias("b1"), F.col("mine"), F.col("class")))
        dealt = spread.select("tab", "key", "dim", "vec", F.inline(F.when((F.col("c0") == 1) & (F.col("c1") == 1), whole).otherwise(split)))
    else:
        dealt = spread.withColumns({"b0": F.lit(0), "b1": F.lit(0)})
    parts = max(vectors.sparkSession.sparkContext.defaultParallelism, min(2 * n_cells, 2000), -(-8 * numbers * groups // TASK_BYTES))
    met = dealt.repartition(parts, *GROUP).sortWithinPartitions(*GROUP).mapInArrow(
        _compared(bits - first, tables, seed, least, top + 1), "mine long, class long, similarity double")
    pairs = met.groupBy("mine", "class").agg(F.max("similarity").alias("similarity"))
    near = F.row_number().over(Window.partitionBy("mine").orderBy(F.desc("similarity"), "class"))
    best = pairs.withColumn("n", near).where(F.col("n") <= top + 1).join(known.select("class", "members"), "class")
    each = F.transform("members", lambda m: F.struct((-F.col("similarity")).alias("k"), m["id"].alias("i"), m.alias("m")))
    found = best.groupBy("mine").agg(F.sort_array(F.flatten(F.collect_list(each))).alias("found"))
    by_id = mine.join(own.withColumnRenamed("class", "mine"), "features").select("id", "mine").join(found, "mine")
    taken = F.slice(F.filter("found", lambda o: o["i"] != F.col("id")), 1, top)
    similar = F.transform(taken, lambda o: F.struct(
        (-o["k"]).alias("similarity"), *[o["m"][c].alias(c) for c in ("id", "ts", "source_ip", "event_type", "was_anomaly")]))
    empty = F.array().cast(f"array<struct<similarity:double,{_MEMBER[7:-1]}>>")
    return vectors.select("id").join(by_id.select("id", similar.alias("similar")), "id", "left").select("id", F.coalesce("similar", empty).alias("similar"))
