"""Live histories of addresses, services and users, as keyed state.

Every key keeps its counters in one value and its distinct names in maps with
an entry per name, so a batch writes what it adds and removes, whatever the
key's past; a window's map holds what the window holds.  Rows are taken in
order of time within a batch; a row that comes after newer ones counts from
when it comes.  Rows without a key pass through, spread over many groups, and
leave no state.  Of a key with many rows in a batch only what its history reads
is in memory; the rows themselves wait in a scratch file.
"""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from palisade.operators.bruteforce import (
    WINDOW_SECONDS, attempt_outcome, bf_detect, ip_behavior, service_behavior, user_behavior)
from palisade.operators.parse import event_fields

SPAN = WINDOW_SECONDS * 1_000_000
MINUTE = 60_000_000
#: Groups that rows without a key are spread over.
SPREAD = 64
SPREAD_COLUMN = "spread"
#: Rows of a key and batch that are held whole, and rows of a larger one that are followed at a time.
HELD_ROWS, STEP_ROWS = 20_000, 500_000


def distinct_so_far(values: pd.Series, known, count: int) -> np.ndarray:
    """How many different values the key has had up to each row; new ones enter the map ``known``."""
    first = (values.notna() & ~values.duplicated()).to_numpy()
    for at in np.flatnonzero(first):
        name = (values.iloc[at],)
        if known.containsKey(name):
            first[at] = False
        else:
            known.updateValue(name, (True,))
    return count + first.cumsum()


def distinct_within(values: pd.Series, us: np.ndarray, seen, span: int) -> np.ndarray:
    """How many different values occurred in the ``span`` up to each row; the map ``seen`` has the last time of those inside.

    A value is present from a row on that finds it absent until ``span`` after
    the last row before its next absence, so a count is starts less ends.
    """
    held = {name: last for (name,), (last,) in seen.iterator()}
    there = values.notna().to_numpy()
    name = np.concatenate([np.array(list(held), object), values.to_numpy(object)[there]])
    time = np.concatenate([np.array(list(held.values()), np.int64), us[there]])
    code = pd.factorize(name)[0]
    order = np.lexsort((time, code))
    code, time, name = code[order], time[order], name[order]
    gap = np.ones(len(code) + 1, bool)
    gap[1:-1] = (code[1:] != code[:-1]) | (time[1:] - time[:-1] > span)
    ends = np.sort(time[gap[1:]])
    own = np.zeros(len(order), bool)
    own[order] = gap[:-1]
    here = np.zeros(len(us), bool)
    here[there] = own[len(held):]
    present = int(own[:len(held)].sum()) + here.cumsum() - np.searchsorted(ends, us - span, "left")
    last = dict(zip(name, time.tolist()))  # in order of time, so the last one stays
    edge = int(us[-1]) - span
    for who, when in last.items():
        if when < edge:
            if who in held:
                seen.removeKey((who,))
        elif held.get(who) != when:
            seen.updateValue((who,), (when,))
    return present


def in_order(parts: list[pd.DataFrame]) -> pd.DataFrame:
    """The rows of a key by time and id, as a frame of its own; most keys bring few rows, so a frame's fixed costs count."""
    rows = parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)
    us, ids = rows["us"].to_numpy(), rows["id"].to_numpy()
    if us.dtype.kind not in "if" or ids.dtype.kind not in "if":
        return rows.sort_values(["us", "id"], ignore_index=True)
    rows = rows.take(np.lexsort((ids, us)))
    rows.index = pd.RangeIndex(len(rows))
    return rows


class _Waiting:
    """Rows that wait, part by part, in a scratch file without a name, so that nothing is left of it."""

    def __init__(self):
        self.file, self.sizes = tempfile.TemporaryFile(), []

    def add(self, part: pd.DataFrame) -> None:
        raw = pickle.dumps(part, protocol=5)
        packed = pa.compress(raw, codec="lz4", asbytes=True)
        self.file.write(packed)
        self.sizes.append((len(packed), len(raw)))

    def parts(self) -> Iterator[pd.DataFrame]:
        self.file.seek(0)
        for packed, raw in self.sizes:
            yield pickle.loads(pa.decompress(self.file.read(packed), decompressed_size=raw, codec="lz4", asbytes=True))


def interned(values: pd.Series, names: dict) -> pd.Series:
    """The same values, each name once in memory for all parts; anything but names stays as it is."""
    if values.dtype != object:
        return values
    code, found = pd.factorize(values)
    if not all(isinstance(v, str) for v in found):
        return values
    table = np.array([*(names.setdefault(v, v) for v in found), None], object)
    return pd.Series(table[code], values.index, dtype=object)


class _History(StatefulProcessor):
    """Follows one key; ``added`` are the columns that it gives every row, ``reads`` those that it looks at besides."""

    added: list[str] = []
    reads: list[str] = []

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if key[0] is None:
            for part in rows:
                yield self._with(in_order([part]), {c: pd.Series([None] * len(part), dtype="object") for c in self.added})
            return
        held, n = [], 0
        for part in rows:
            held.append(part)
            n += len(part)
            if n > HELD_ROWS:
                yield from self._in_steps(chain(held, rows))
                return
        part = in_order(held)
        yield self._with(part, self.follow(part))

    def _in_steps(self, rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """As for few rows, with as much of each in memory as the history reads; they come back in the order in which they came."""
        waiting, read, names, n = _Waiting(), [], {}, 0
        with waiting.file:
            for part in rows:
                waiting.add(part)
                some = {c: interned(part[c], names) for c in dict.fromkeys(["us", "id", *self.reads])}
                read.append(pd.DataFrame({**some, "at": np.arange(n, n + len(part))}))
                n += len(part)
            rows = in_order(read)
            del part, read
            values = {}
            for start in range(0, n, STEP_ROWS):
                step = rows.iloc[start:start + STEP_ROWS].reset_index(drop=True)
                for name, found in self.follow(step).items():
                    values.setdefault(name, np.empty(n, found.dtype))[step["at"].to_numpy()] = found
            del rows
            start = 0
            for part in waiting.parts():
                yield self._with(part, {name: found[start:start + len(part)] for name, found in values.items()})
                start += len(part)

    def _with(self, part: pd.DataFrame, added: dict) -> pd.DataFrame:
        del part[SPREAD_COLUMN]
        for name, values in added.items():
            part[name] = values
        return part

    def follow(self, rows: pd.DataFrame) -> dict[str, np.ndarray]:
        raise NotImplementedError


class AddressHistory(_History):
    """Totals never expire; users leave after 15 minutes."""

    added = ["ip_total", "ip_failed", "ip_services", "ip_agents", "ip_users", "ip_first_us"]
    reads = ["success", "service", "user_agent", "username"]

    def init(self, handle) -> None:
        self.totals = handle.getValueState("totals", "total long, failed long, services long, agents long, first long")
        self.services = handle.getMapState("services", "name string", "known boolean")
        self.agents = handle.getMapState("agents", "name string", "known boolean")
        self.users = handle.getMapState("users", "name string", "us long")

    def follow(self, rows):
        us = rows["us"].to_numpy(np.int64)
        total, failed, services, agents, first = self.totals.get() if self.totals.exists() else (0, 0, 0, 0, int(us[0]))
        fails = failed + (~rows["success"].astype(bool)).to_numpy().cumsum()
        n_services = distinct_so_far(rows["service"], self.services, services)
        n_agents = distinct_so_far(rows["user_agent"], self.agents, agents)
        n_users = distinct_within(rows["username"], us, self.users, SPAN)
        firsts = np.minimum.accumulate(np.minimum(us, first))
        self.totals.update((total + len(rows), int(fails[-1]), int(n_services[-1]), int(n_agents[-1]), int(firsts[-1])))
        return {"ip_total": total + np.arange(1, len(rows) + 1), "ip_failed": fails, "ip_services": n_services, "ip_agents": n_agents,
                "ip_users": n_users, "ip_first_us": firsts}


class ServiceHistory(_History):
    """Addresses and users of 15 minutes, and the highest count of any 60 seconds."""

    added = ["service_total", "service_ips", "service_users", "service_peak"]
    reads = ["source_ip", "username"]

    def init(self, handle) -> None:
        self.totals = handle.getValueState("totals", "total long, peak long")
        self.ips = handle.getMapState("ips", "name string", "us long")
        self.users = handle.getMapState("users", "name string", "us long")
        self.minute = handle.getListState("minute", "us long, n long")

    def follow(self, rows):
        us = rows["us"].to_numpy(np.int64)
        total, peak = self.totals.get() if self.totals.exists() else (0, 0)
        ips = distinct_within(rows["source_ip"], us, self.ips, SPAN)
        users = distinct_within(rows["username"], us, self.users, SPAN)
        before = np.array([t for t, n in self.minute.get() for _ in range(n)], np.int64)
        times = np.sort(np.concatenate([before, us]))
        counts = len(before) + np.arange(1, len(us) + 1) - np.searchsorted(times, us - MINUTE, "right")
        peaks = np.maximum.accumulate(np.maximum(counts, peak))
        recent, n = np.unique(times[times > us[-1] - MINUTE], return_counts=True)
        self.minute.put(list(zip(recent.tolist(), n.tolist())))
        self.totals.update((total + len(us), int(peaks[-1])))
        return {"service_total": total + np.arange(1, len(us) + 1), "service_ips": ips, "service_users": users, "service_peak": peaks}


class UserHistory(_History):
    """A success after a failure marks the account for good."""

    added = ["user_total", "user_failed", "user_ips", "user_compromised"]
    reads = ["success", "source_ip"]

    def init(self, handle) -> None:
        self.totals = handle.getValueState("totals", "total long, failed long, ips long, compromised boolean")
        self.ips = handle.getMapState("ips", "name string", "known boolean")

    def follow(self, rows):
        total, failed, ips, compromised = self.totals.get() if self.totals.exists() else (0, 0, 0, False)
        ok = rows["success"].astype(bool).to_numpy()
        fails = failed + (~ok).cumsum()
        n_ips = distinct_so_far(rows["source_ip"], self.ips, ips)
        marked = np.logical_or.accumulate(ok & (fails > 0)) | bool(compromised)
        self.totals.update((total + len(rows), int(fails[-1]), int(n_ips[-1]), bool(marked[-1])))
        return {"user_total": total + np.arange(1, len(rows) + 1), "user_failed": fails, "user_ips": n_ips, "user_compromised": marked}


def followed(rows: DataFrame, key: str, history: type[_History]) -> DataFrame:
    """Live ``rows`` with the columns of their key's history."""
    spread = F.when(F.col(key).isNull(), F.pmod(F.xxhash64("id"), F.lit(SPREAD))).otherwise(0).cast("int")
    added = [T.StructField(c, T.BooleanType() if c == "user_compromised" else T.LongType()) for c in history.added]
    schema = T.StructType([*rows.schema.fields, *added])
    return rows.withColumn(SPREAD_COLUMN, spread).groupBy(key, SPREAD_COLUMN).transformWithStateInPandas(
        history(), schema, "Append", "None")


def live_attempts(events: DataFrame, **carried: Column) -> DataFrame:
    """Events as attempts, with ``carried`` columns beside; those without an address are no attempts and belong to no history."""
    known = event_fields(events)
    mine = F.col("source_ip").isNotNull()
    return known.select(
        "id", F.unix_micros("ts").alias("us"), "source_ip", *[F.when(mine, F.col(c)).alias(c) for c in ("username", "service", "user_agent")],
        attempt_outcome(F.col("status"), F.col("raw_message")).alias("success"), *[c.alias(n) for n, c in carried.items()])


def live_profile(tries: DataFrame) -> DataFrame:
    """``bf_profile`` of live attempts: one history after the other, each with its own state."""
    rows = tries
    for key, history in (("source_ip", AddressHistory), ("service", ServiceHistory), ("username", UserHistory)):
        rows = followed(rows, key, history)
    rows = rows.withColumns({"ts": F.timestamp_micros("us"), "ip_first": F.timestamp_micros("ip_first_us")}).drop("us", "ip_first_us")
    profile = service_behavior(user_behavior(ip_behavior(rows)))
    return profile.withColumn("compromise_confidence", F.when(F.col("username").isNotNull(), F.col("compromise_confidence")))


def live_bruteforce(tries: DataFrame) -> DataFrame:
    """``bf_detect`` of live attempts; rows without an address have no verdict."""
    scored = bf_detect(live_profile(tries))
    verdict = F.struct("detected", "confidence", "risk_level")
    return scored.withColumn("brute_force", F.when(F.col("source_ip").isNotNull(), verdict))
