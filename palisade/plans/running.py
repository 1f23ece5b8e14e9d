"""Running and sliding aggregates per key that survive hot keys.

A window over one key runs in one task, so a key that holds a third of all
rows would too.  Everything here splits a key by time bucket: buckets are
first reduced to one small row each (with map-side combining), a window over
those rows yields what each bucket inherits from the past, and the row-level
window then runs per (key, bucket).  Results are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window, functions as F

HOUR = 3600
#: Rows from which a cell is split, parts it is split into, and split cells that are broadcast at most.
CELL_ROWS, PARTS, MOST_CROWDED = 1_000_000, 64, 10_000
#: Rows that a task gets for its windows, as far as cells allow.
TASK_ROWS = 200_000
_HELD: list[DataFrame] = []


def shared(df: DataFrame) -> DataFrame:
    """Keep an intermediate result that later steps read more than once.

    Each step here reads its input twice (bucket totals, then rows); without
    this, a chain of steps would recompute its start once per path.  Lost
    blocks are recomputed.  Release with ``release_shared``.
    """
    held = df.persist(StorageLevel.MEMORY_AND_DISK)
    _HELD.append(held)
    return held


def release_shared() -> None:
    """Give back what ``shared`` keeps; the caller's own cached tables stay."""
    while _HELD:
        held = _HELD.pop()
        try:
            held.unpersist()
        except Exception:  # its session has ended, and the blocks with it
            continue


def _bucket(ts: Column, width: int) -> Column:
    return F.floor(F.unix_micros(ts) / F.lit(width * 1_000_000))


def _dealt(rows: DataFrame, n: int | None, by: list[str]) -> DataFrame:
    """Deal out ``rows``, about ``n``, for windows ``by`` these columns.

    Their number counts, not their bytes: narrow rows that are alike shrink to
    so little that adaptive execution leaves them to a single task, and where
    they are few, a task per shuffle partition writes a file for each other.
    """
    if n is None:
        return rows
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(cores, -(-n // TASK_ROWS)), *by)


def _with_cells(rows: DataFrame, keys: list[str], ts: str, width: int, at_most: int | None) -> DataFrame:
    """Add ``_bucket``: the time bucket, and within a crowded one the part between two split points.

    A cell (key, bucket) that holds more than ``CELL_ROWS`` rows is split at
    quantiles of its own times, so that only rows of one instant must stay
    together.  Cells are counted first, unless ``at_most`` rows (a count that
    the caller has anyway) can't fill one.
    """
    rows = rows.withColumn("_bucket", _bucket(F.col(ts), width))
    if at_most is not None and at_most <= CELL_ROWS:
        return rows
    cells = [*keys, "_bucket"]
    crowded = rows.groupBy(*cells).agg(F.count("*").alias("_n")).where(F.col("_n") > CELL_ROWS).drop("_n")
    crowded = crowded.persist()
    n_crowded = crowded.count()
    if not n_crowded:
        crowded.unpersist()
        return rows
    _HELD.append(crowded)
    small = F.broadcast(crowded) if n_crowded <= MOST_CROWDED else crowded
    shares = F.array(*[F.lit(i / PARTS) for i in range(1, PARTS)])
    points = rows.join(small, cells, "left_semi").groupBy(*cells).agg(
        F.percentile_approx(F.unix_micros(ts), shares, F.lit(10_000)).alias("_points"))
    points = shared(points)
    small = F.broadcast(points) if n_crowded <= MOST_CROWDED else points
    passed = F.size(F.filter("_points", lambda p: p <= F.unix_micros(ts)))
    part = F.when(F.col("_points").isNotNull(), passed).otherwise(F.lit(0))
    return rows.join(small, cells, "left").withColumn("_bucket", F.col("_bucket") * (PARTS + 1) + part).drop("_points")


def running(
    df: DataFrame, keys: list[str], order: list[str], *, ts: str, sums: dict[str, Column] | None = None,
    mins: dict[str, Column] | None = None, maxs: dict[str, Column] | None = None, width: int = HOUR,
    at_most: int | None = None,
) -> DataFrame:
    """Add totals of each key from its first row up to and including this one.

    ``order`` must be a total order within a key that starts with ``ts``.
    ``at_most``: an upper bound of the rows, if one is known.
    """
    specs = [(n, c, F.sum) for n, c in (sums or {}).items()]
    specs += [(n, c, F.min) for n, c in (mins or {}).items()]
    specs += [(n, c, F.max) for n, c in (maxs or {}).items()]
    cells = [*keys, "_bucket"]
    rows = _with_cells(df, keys, ts, width, at_most).withColumns({f"_in_{n}": c for n, c, _ in specs})
    cell = rows.groupBy(*cells).agg(*[f(f"_in_{n}").alias(f"_cell_{n}") for n, _, f in specs])
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    inherited = _dealt(cell, at_most, keys).select(*cells, *[f(f"_cell_{n}").over(before).alias(f"_past_{n}") for n, _, f in specs])
    inside = Window.partitionBy(*cells).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = {}
    for n, _, f in specs:
        here, past = f(f"_in_{n}").over(inside), F.col(f"_past_{n}")
        if f is F.sum:
            totals[n] = F.coalesce(past, F.lit(0)) + F.coalesce(here, F.lit(0))
        else:
            totals[n] = (F.least if f is F.min else F.greatest)(past, here)
    out = _dealt(rows, at_most, cells).join(_dealt(inherited, at_most, cells), cells).withColumns(totals)
    return out.drop("_bucket", *[f"_in_{n}" for n, _, _ in specs], *[f"_past_{n}" for n, _, _ in specs])


def previous_rows(
    df: DataFrame, keys: list[str], order: list[str], value: Column, k: int, *, ts: str | None = None,
    out: str = "prev", width: int = HOUR, bucket: Column | None = None, at_most: int | None = None,
) -> DataFrame:
    """Add the ``value`` of up to ``k`` preceding rows of the key, oldest first.

    Rows are split by time, or by ``bucket``, which must never decrease along
    ``order``.
    """
    cells = [*keys, "_bucket"]
    rows = _with_cells(df, keys, ts, width, at_most) if bucket is None else df.withColumn("_bucket", bucket)
    rows = rows.withColumn("_value", value)
    if k == 1:
        return _previous_row(rows, keys, cells, order, at_most).withColumn(out, F.array_compact(F.array("_lag"))).drop(
            "_bucket", "_value", "_lag")
    newest = Window.partitionBy(*cells).orderBy(*[F.desc(c) for c in order])
    oldest = Window.partitionBy(*cells).orderBy(*order)
    tails = (
        rows.select(*cells, *[c for c in order if c not in cells], "_value")
        .withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= k)
    )
    tails = _dealt(tails, at_most, keys)
    along = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-k, -1)
    inherited = (
        tails.withColumn("_past", F.collect_list("_value").over(along))
        .withColumn("_first", F.row_number().over(oldest)).where(F.col("_first") == 1)
        .select(*cells, "_past")
    )
    here = F.collect_list("_value").over(oldest.rowsBetween(-k, -1))
    joined = _dealt(rows, at_most, cells).join(_dealt(inherited, at_most, cells), cells).withColumn("_all", F.concat("_past", here))
    last_k = F.when(F.size("_all") > k, F.slice("_all", -k, k)).otherwise(F.col("_all"))
    return joined.withColumn(out, last_k).drop("_bucket", "_value", "_past", "_all")


def _previous_row(rows: DataFrame, keys: list[str], cells: list[str], order: list[str], at_most: int | None) -> DataFrame:
    """``previous_rows`` for one row: buckets reduce to their newest value."""
    newest = rows.groupBy(*cells).agg(F.max_by("_value", F.struct(*order)).alias("_newest"))
    inherited = _dealt(newest, at_most, keys).select(*cells, F.lag("_newest").over(Window.partitionBy(*keys).orderBy("_bucket")).alias("_past"))
    here = F.lag("_value").over(Window.partitionBy(*cells).orderBy(*order))
    return _dealt(rows, at_most, cells).join(_dealt(inherited, at_most, cells), cells).withColumn("_lag", F.coalesce(here, "_past")).drop("_past")


#: Cells back from which a halving mean is taken over; each halves it once at least, so none before them changes a double.
HALVING_CELLS = 53


def _walk(cells: list[str], whole: bool):
    """Over rows in order: the halving mean at every row, or a cell's rows and mean at its end."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, mean, n, ended = None, 0.0, 0, []
        for batch in batches:
            means = []
            for cell, x, past in zip(zip(*[batch.column(c).to_pylist() for c in cells]), batch.column("_x").to_pylist(), batch.column("_past").to_pylist()):
                if cell != here:
                    if here is not None:
                        ended.append((*here, n, mean))
                    here, mean, n = cell, past, 0
                mean, n = (mean + x) / 2.0, n + 1
                means.append(mean)
            if whole:
                ended = []
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(means, pa.float64())], [*batch.schema.names, "_mean"])
        if not whole and here is not None:
            columns = zip(*ended, (*here, n, mean))
            kinds = [batch.schema.field(c).type for c in cells] + [pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], [*cells, "_n", "_end"])
    return run


def halving_mean(df: DataFrame, keys: list[str], order: list[str], value: Column, *, ts: str, out: str, width: int = HOUR, at_most: int | None = None) -> DataFrame:
    """Add the mean = (mean + value) / 2 of each key up to this row, started at 0; rows without a value or time are left out.

    A cell is walked from 0 first, and again from what the cells before it come to.
    """
    cells = [*keys, "_bucket"]
    rows = _with_cells(df, keys, ts, width, at_most).withColumn("_x", value.cast("double")).where(F.col("_x").isNotNull() & F.col("_bucket").isNotNull())

    def laid(some: DataFrame) -> DataFrame:  # dealt out by number, so that no cell is cut
        dealt = some.repartition(*cells) if at_most is None else _dealt(some, at_most, cells)
        return dealt.sortWithinPartitions(*cells, *order, "_x")

    bare = rows.select(*dict.fromkeys([*cells, *order, "_x"]), F.lit(0.0).alias("_past"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    ends = laid(bare).mapInArrow(_walk(cells, False), ", ".join(f"{c} {kinds[c]}" for c in cells) + ", _n long, _end double")
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(-HALVING_CELLS, -1)
    past = F.aggregate(F.collect_list(F.struct("_n", "_end")).over(before), F.lit(0.0), lambda a, e: a * F.pow(F.lit(0.5), e["_n"]) + e["_end"])
    inherited = _dealt(ends, at_most, keys).select(*cells, past.alias("_past"))
    joined = rows.join(inherited, cells)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in joined.schema.fields)
    return laid(joined).mapInArrow(_walk(cells, True), f"{kinds}, _mean double").drop("_bucket", "_x", "_past").withColumnRenamed("_mean", out)


class Sliding(NamedTuple):
    """A sliding measure ending at each row.

    Without ``previous`` it counts rows.  With ``previous`` (time of the last
    row of the key with the same value) it counts distinct values.  ``closed``
    keeps a row exactly ``seconds`` old inside the window.
    """

    name: str
    seconds: int
    closed: bool
    present: Column
    previous: Column | None = None


def sliding(
    df: DataFrame, keys: list[str], *, ts: str = "ts", row_id: str = "id", windows: list[Sliding],
    sums: dict[str, Column] | None = None, mins: dict[str, Column] | None = None,
    maxs: dict[str, Column] | None = None, distinct: dict[str, Column] | None = None, width: int = HOUR,
    at_most: int | None = None,
) -> DataFrame:
    """Sliding counts, together with running totals and running distinct counts.

    A value enters with +1 at its row and leaves with -1 when it expires, so a
    sliding count is a running sum over arrivals and departures; the departure
    of a value seen again in time is cancelled.  No window is ever rescanned.
    """
    sums, mins, maxs, distinct = sums or {}, mins or {}, maxs or {}, distinct or {}
    payload = [c for c in df.columns]
    t = F.unix_micros(F.col(ts))
    zero = {w.name: F.lit(0) for w in windows} | {n: F.lit(0) for n in distinct}

    def entry(pos: Column, tie: Column, phase: int, deltas: dict[str, Column], row: Column) -> Column:
        values = zero | deltas
        return F.struct(
            pos.alias("_pos"), tie.alias("_tie"), F.lit(phase).alias("_phase"), row.alias("_row"),
            *[values[n].cast("long").alias("_d_" + n) for n in values],
        )

    row_struct = F.struct(*[F.col(c) for c in payload])
    no_row = F.lit(None).cast(df.select(row_struct.alias("r")).schema["r"].dataType)
    arrivals, moves = {}, []
    for w in windows:
        span = w.seconds * 1_000_000
        tie = F.lit((1 << 63) - 1 if w.closed else -(1 << 63)).cast("long")
        if w.previous is None:
            arrivals[w.name] = w.present.cast("int")
        else:
            age = t - F.unix_micros(w.previous)
            still = w.previous.isNotNull() & ((age <= span) if w.closed else (age < span))
            arrivals[w.name] = (w.present & ~still).cast("int")
            moves.append(F.when(w.present & still, entry(
                F.unix_micros(w.previous) + span, tie, 0, {w.name: F.lit(1)}, no_row)))
        moves.append(F.when(w.present, entry(t + span, tie, 0, {w.name: F.lit(-1)}, no_row)))
    own = entry(t, F.col(row_id).cast("long"), 1, arrivals, row_struct)
    steps = df.select(*keys, F.explode(F.array_compact(F.array(own, *moves))).alias("_s")).select(*keys, "_s.*")

    for name, value in distinct.items():
        first = (
            df.withColumn("_v", value).where(F.col("_v").isNotNull()).groupBy(*keys, "_v")
            .agg(F.min(F.struct(t.alias("p"), F.col(row_id).cast("long").alias("i"))).alias("f"))
        )
        steps = steps.unionByName(first.select(
            *keys, entry(F.col("f.p"), F.col("f.i"), 0, {name: F.lit(1)}, no_row).alias("_s")
        ).select(*keys, "_s.*"))

    steps = steps.withColumn("_at", F.timestamp_micros("_pos"))
    own_row = F.col("_phase") == 1

    def over_row(c: dict[str, Column]) -> dict[str, Column]:
        return {n: F.when(own_row, v) for n, v in c.items()}

    # the row travels as plain columns, once
    steps = steps.select("*", *[F.col("_row." + c).alias(c) for c in payload if c not in keys]).drop("_row")
    total = running(
        steps, keys, ["_at", "_tie", "_phase"], ts="_at", width=width,
        at_most=None if at_most is None else at_most * (1 + 2 * len(windows) + len(distinct)),
        sums={n: F.col("_d_" + n) for n in zero} | over_row(sums), mins=over_row(mins), maxs=over_row(maxs),
    )
    kept = [c for c in payload] + [n for n in (*zero, *sums, *mins, *maxs)]
    return total.where(own_row).select(*kept)
