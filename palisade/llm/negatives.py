"""Hard negatives by slot-decomposed selection.

An anchor's positives are the best rows of its own label; every positive asks
for the best rows of other labels whose score lies in a window below its own.
The windows overlap.  Their upper limits cut the scores into disjoint slots, a
row falls into one slot at most, and of every slot only the best ``top`` rows
can ever be asked for: tasks keep those, Spark merges them per slot, and going
through an anchor's slots from the lowest limit up, each merged with what lies
below it, answers all windows.

Anchors are a stated query set that meets all rows, in blocks: rows are packed
where they are read, packed blocks are dealt to shards and blocks of anchors
to groups, and a task scores the cell of one shard and one group.  Shards and
groups are bounded in bytes, whatever ids or labels the rows have.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from palisade.llm.common import cut

#: Vectors in a packed block, at most; and bytes.
BLOCK_ROWS = 1024
BLOCK_BYTES = 4 << 20
#: Bytes of rows in a shard and of anchors in a group.
CELL_BYTES = 32 << 20
#: Scores that a task holds at a time.
SCORES = 1 << 20
LIMIT = (1 << 63) - 1
HUGE = float(np.finfo(np.float64).max)

PACKED = pa.schema([("dim", pa.int32()), ("n", pa.int32()), ("kind", pa.string()), ("ids", pa.binary()), ("labels", pa.binary()), ("vecs", pa.binary())])
BLOCK = "dim int, n int, kind string, ids binary, labels binary, vecs binary"
FOUND = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-numbered doubles, held to the range of a long.

    Rows whose products could leave the 53 bits of a double are multiplied as Python integers.
    """
    out = np.zeros((len(a), len(b)), np.int64)
    if not a.shape[1] or not len(a) or not len(b):
        return out
    safe = math.sqrt(2.0 ** 53 / a.shape[1])
    fits, fits_b = np.abs(a).max(axis=1) < safe, np.abs(b).max(axis=1) < safe
    out[np.ix_(fits, fits_b)] = (a[fits] @ b[fits_b].T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    for x, y in ((~fits, fits_b | True), (fits, ~fits_b)):
        if x.any() and y.any():
            out[np.ix_(x, y)] = np.clip(whole(a[x]) @ whole(b[y]).T, -LIMIT, LIMIT).astype(np.int64)
    return out


def window_of(positive: int, low: int, high: int) -> tuple[int, int]:
    """Least and greatest n with low * positive <= 100 * n <= high * positive, held to the range of a long."""
    return max(-LIMIT, min(LIMIT, -(-low * positive // 100))), max(-LIMIT, min(LIMIT, high * positive // 100))


def best_per_group(keys: list[np.ndarray], score: np.ndarray, ids: np.ndarray, top: int) -> np.ndarray:
    """Places of the ``top`` highest scores of every group, ties to smaller ids."""
    order = np.lexsort([ids, -score, *keys[::-1]])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    start = np.flatnonzero(new)
    place = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
    return order[place < top]


class _Best:
    """The best rows per group so far, thinned out whenever many have gathered; columns are keys, score and id."""

    def __init__(self, names: list[str], top: int):
        self.names, self.top, self.held, self.n, self.room = names, top, [], 0, 2 * SCORES

    def add(self, *columns: np.ndarray) -> None:
        at = best_per_group(list(columns[:-2]), *columns[-2:], self.top)
        self.held.append([c[at] for c in columns])
        self.n += len(at)
        if self.n > self.room:
            self.thin()
            self.room = 2 * max(SCORES, self.n)

    def thin(self) -> None:
        columns = [np.concatenate(c) for c in zip(*self.held, strict=True)]
        at = best_per_group(columns[:-2], *columns[-2:], self.top)
        self.held, self.n = [[c[at] for c in columns]], len(at)

    def table(self) -> pa.Table:
        if not self.held:
            return pa.table({n: pa.array([], pa.int64()) for n in self.names})
        self.thin()
        return pa.table({n: pa.array(c.astype(np.int64)) for n, c in zip(self.names, self.held[0], strict=True)})


def _pack(scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels, column = batch.column("id").to_numpy(), batch.column("label").to_numpy(), batch.column("vec")
            dims = column.value_lengths().to_numpy()
            for dim in np.unique(dims):
                at, rows = np.flatnonzero(dims == dim), max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * max(int(dim), 1))))
                for some in (at[i:i + rows] for i in range(0, len(at), rows)):
                    flat = column.take(pa.array(some)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                    with np.errstate(over="ignore"):
                        vecs = np.clip(np.floor(scale * flat), -HUGE, HUGE)
                    kind = "i2" if not len(vecs) or np.abs(vecs).max() < 2 ** 15 else "f8"
                    yield pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip(
                        (int(dim), len(some), kind, ids[some].tobytes(), labels[some].tobytes(), vecs.astype(kind).tobytes()), PACKED, strict=True)], schema=PACKED)
    return run


def _blocks(table: pa.Table) -> Iterator[dict]:
    for row in table.to_pylist():
        row["ids"], row["labels"] = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
        row["vecs"] = np.frombuffer(row["vecs"], row["kind"]).astype(np.float64).reshape(row["n"], row["dim"])
        yield row


def _meetings(anchors: pa.Table, rows: pa.Table) -> Iterator[tuple[dict, slice, dict]]:
    """Blocks of equal dimension, with so many anchors at a time that the scores fit."""
    anchors = list(_blocks(anchors))
    for k in range(rows.num_rows):
        for other in _blocks(rows.slice(k, 1)):
            for mine in anchors:
                if mine["dim"] == other["dim"]:
                    step = max(1, SCORES // max(other["n"], 1))
                    for lo in range(0, mine["n"], step):
                        yield mine, slice(lo, lo + step), other


def _positives(count: int):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        best = _Best(["block", "pos", "score", "id"], count)
        for mine, part, other in _meetings(anchors, rows):
            for label in np.intersect1d(mine["labels"][part], other["labels"]):
                at, there = np.flatnonzero(mine["labels"][part] == label), np.flatnonzero(other["labels"] == label)
                scores = inner_products(mine["vecs"][part][at], other["vecs"][there])
                scores[mine["ids"][part][at][:, None] == other["ids"][there][None, :]] = -LIMIT - 1
                wanted = scores > -LIMIT - 1
                if len(there) > count:  # what is below an anchor's own count-th best of this block can't be among its best of all
                    wanted &= scores >= np.partition(scores, -count, axis=1)[:, -count][:, None]
                i, j = np.nonzero(wanted)
                best.add(np.full(len(i), mine["block"]), part.start + at[i], scores[i, j], other["ids"][there[j]])
        return best.table()
    return run


def _limits(count: int, low: int, high: int):
    """Give every block of anchors its positives: how many, the least score any asks for, upper limits in order, ids and scores."""
    def run(anchors: pa.Table, positives: pa.Table) -> pa.Table:
        out = []
        by_pos: dict[int, list[tuple[int, int]]] = {}
        for r in positives.to_pylist():
            by_pos.setdefault(r["pos"], []).append((r["score"], r["id"]))
        for row in anchors.to_pylist():
            table = np.zeros((row["n"], 2 + 3 * count), np.int64)
            for pos in range(row["n"]):
                mine = sorted(by_pos.get(pos, []), key=lambda p: (-p[0], p[1]))
                windows = [window_of(score, low, high) for score, _ in mine]
                uppers = sorted(w[1] for w in windows) or [-LIMIT]
                table[pos, 0], table[pos, 1] = len(mine), min((w[0] for w in windows), default=LIMIT)
                table[pos, 2:2 + count] = uppers + uppers[-1:] * (count - len(uppers))
                for k, (score, who) in enumerate(mine):
                    table[pos, 2 + count + k], table[pos, 2 + 2 * count + k] = who, score
            out.append({**row, "limits": table.tobytes()})
        names = [*PACKED.names, "block", "grp", "limits"]
        types = [*PACKED.types, pa.int64(), pa.int32(), pa.binary()]
        return pa.table({n: pa.array([r[n] for r in out], t) for n, t in zip(names, types, strict=True)})
    return run


def _slots(top: int, count: int):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        best = _Best(["block", "pos", "slot", "score", "id"], top)
        for mine, part, other in _meetings(anchors, rows):
            table = np.frombuffer(mine["limits"], np.int64).reshape(mine["n"], -1)[part]
            least, uppers = table[:, 1], table[:, 2:2 + count]
            scores = inner_products(mine["vecs"][part], other["vecs"])
            i, j = np.nonzero((scores >= least[:, None]) & (scores <= uppers[:, -1:]) & (mine["labels"][part][:, None] != other["labels"][None, :])
                              & (mine["ids"][part][:, None] != other["ids"][None, :]))
            found = scores[i, j]
            slot = np.zeros(len(i), np.int64)
            for k in range(count):  # a limit given twice leaves a slot without rows
                slot += uppers[i, k] < found
            best.add(np.full(len(i), mine["block"]), part.start + i, slot, found, other["ids"][j])
        return best.table()
    return run


def _answers(top: int, count: int, low: int, high: int):
    def run(anchors: pa.Table, tops: pa.Table) -> pa.Table:
        out = []
        by_pos: dict[int, list[list[tuple[int, int]]]] = {}
        for r in tops.to_pylist():
            by_pos.setdefault(r["pos"], [[] for _ in range(count)])[r["slot"]].append((-r["score"], r["id"]))
        for row in anchors.select(["ids", "n", "limits"]).to_pylist():
            ids, table = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["limits"], np.int64).reshape(row["n"], -1)
            for pos, slots in by_pos.items():
                upto, merged = [], []
                for slot in slots:  # from the lowest limit up
                    merged = sorted(merged + slot)[:top]
                    upto.append(merged)
                line = table[pos].tolist()
                for k in range(line[0]):
                    who, score = line[2 + count + k], line[2 + 2 * count + k]
                    least, most = window_of(score, low, high)
                    own = sum(u < most for u in line[2:2 + count])
                    chosen = [(-s, i) for s, i in upto[own] if -s >= least]
                    out += [(int(ids[pos]), who, rank, i, score, s) for rank, (s, i) in enumerate(chosen, 1)]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        names = [f.split()[0] for f in FOUND.split(", ")]
        return pa.table({n: pa.array([r[k] for r in out], t) for k, (n, t) in enumerate(zip(names, types, strict=True))})
    return run


def _best_rows(found: DataFrame, keys: list[str], top: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("id")))
    return found.withColumn("place", place).where(F.col("place") <= top).drop("place")


def hard_negatives(vectors: DataFrame, anchors: Column, *, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
                   scale: float = 256, positives: int = 5, top: int = 3, low: int = 50, high: int = 95, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the rows that the condition ``anchors`` picks.

    A component x counts as floor(scale * x) in double precision, and a score
    is the exact integer inner product, held to the range of a long.  Higher
    scores come first, ties by smaller id.  An anchor's positives are its
    first ``positives`` rows with its label and another id; a positive's
    negatives the first ``top`` rows of other labels and ids with ``low *
    positive_score <= 100 * negative_score <= high * positive_score`` (a
    negative positive score leaves no room).

    Rows with a null id, label or vector, or a null or non-finite component
    take no part; zero vectors do; vectors of other lengths than the anchor's
    don't score.  Repeated rows count as often as they occur, also as anchors;
    rows of the anchor's own id are none of its rows.  Other columns are
    ignored.  No rows, no anchors or no negatives: no rows.
    """
    x = F.col(vector)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    able = vectors.where(F.col(vec_id).isNotNull() & F.col(label).isNotNull() & x.isNotNull() & ~F.coalesce(bad, F.lit(False)))
    wanted = [F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), x.cast("array<double>").alias("vec")]
    pack = _pack(scale)
    rows = cut(able.select(*wanted).mapInArrow(pack, BLOCK).withColumn("block", F.monotonically_increasing_id()))
    queries = cut(able.where(anchors).select(*wanted))
    parts = max(1, math.ceil(queries.count() / BLOCK_ROWS))
    packed = cut(queries.repartition(parts).mapInArrow(pack, BLOCK).withColumn("block", F.monotonically_increasing_id()))
    size = F.coalesce(F.sum(F.length("vecs") * F.when(F.col("kind") == "i2", 4).otherwise(1)), F.lit(0))
    groups = max(1, math.ceil(packed.agg(size).first()[0] / cell_bytes))
    workers = vectors.sparkSession.sparkContext.defaultParallelism
    shards = max(math.ceil(rows.agg(size).first()[0] / cell_bytes), math.ceil(2 * workers / groups))
    mine = packed.withColumn("grp", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int"))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("block"), F.lit(shards)).cast("int")).withColumn(
        "grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def meet(blocks: DataFrame, fn, schema: str) -> DataFrame:
        copies = blocks.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
        return copies.groupBy("grp", "shard").cogroup(dealt.groupBy("grp", "shard")).applyInArrow(fn, schema)

    near = _best_rows(meet(mine, _positives(positives), "block long, pos long, score long, id long"), ["block", "pos"], positives)
    limited = cut(mine.groupBy("block").cogroup(near.groupBy("block")).applyInArrow(
        _limits(positives, low, high), f"{BLOCK}, block long, grp int, limits binary"))
    found = meet(limited, _slots(top, positives), "block long, pos long, slot long, score long, id long")
    tops = _best_rows(found, ["block", "pos", "slot"], top)
    return limited.groupBy("block").cogroup(tops.groupBy("block")).applyInArrow(_answers(top, positives, low, high), FOUND)
