"""State of the live histories, batch by batch, against a row-by-row walk, and what a batch writes."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from palisade.streaming import histories as H

SECOND, DAY = 1_000_000, 86_400_000_000


class Handle:
    """State in memory that counts what is written."""

    def __init__(self):
        self.written, self.states = 0, {}

    def getValueState(self, name, schema):
        return self.states.setdefault(name, Value(self))

    def getMapState(self, name, key, value):
        return self.states.setdefault(name, Map(self))

    def getListState(self, name, schema):
        return self.states.setdefault(name, List(self))


class Value:
    def __init__(self, handle):
        self.handle, self.value = handle, None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value
        self.handle.written += 1


class Map(dict):
    def __init__(self, handle):
        self.handle = handle

    def containsKey(self, key):
        return key in self

    def updateValue(self, key, value):
        self[key] = value
        self.handle.written += 1

    def removeKey(self, key):
        del self[key]
        self.handle.written += 1

    def iterator(self):
        return iter(list(self.items()))


class List(list):
    def __init__(self, handle):
        self.handle = handle

    def get(self):
        return iter(list(self))

    def put(self, rows):
        self[:] = rows
        self.handle.written += len(rows)


def started(kind):
    handle, history = Handle(), kind()
    history.init(handle)
    return handle, history


def follow(history, rows, key="k"):
    part = pd.DataFrame(rows).assign(spread=0)
    part = part.astype({"username": object, "user_agent": object}).where(part.notna(), None)
    half = len(part) // 2
    return pd.concat(history.handleInputRows((key, 0), iter([part[:half], part[half:]]), None))


def within(last, us, span):
    return sum(t >= us - span for t in last.values())


def walk(rows):
    """Every history's columns, as if all rows had one key."""
    total = failed = peak = 0
    sets, users, ips, compromised, out = {"service": set(), "user_agent": set(), "source_ip": set()}, {}, {}, False, []
    for i, r in enumerate(rows):
        total, failed = total + 1, failed + (not r["success"])
        compromised |= bool(r["success"] and failed)
        for c, known in sets.items():
            known |= {r[c]} - {None}
        ips[r["source_ip"]] = r["us"]
        if r["username"] is not None:
            users[r["username"]] = r["us"]
        peak = max(peak, sum(q["us"] > r["us"] - 60 * SECOND for q in rows[:i + 1]))
        out.append({"id": r["id"], "ip_total": total, "ip_failed": failed, "ip_services": len(sets["service"]), "ip_agents": len(sets["user_agent"]),
                    "ip_users": within(users, r["us"], H.SPAN), "ip_first_us": rows[0]["us"], "service_total": total, "service_ips": within(ips, r["us"], H.SPAN),
                    "service_users": within(users, r["us"], H.SPAN), "service_peak": peak, "user_total": total, "user_failed": failed,
                    "user_ips": len(sets["source_ip"]), "user_compromised": compromised})
    return out


def some_rows(seed, n):
    rng = random.Random(seed)
    us, rows = 1_700_000_000 * SECOND, []
    for i in range(n):
        # bursts, minutes, and now and then days without an attempt
        us += rng.choice([0, 1, SECOND, SECOND, 60 * SECOND, 449 * SECOND, 900 * SECOND, 900 * SECOND + 1, 3 * DAY])
        rows.append({"id": i, "us": us, "success": rng.random() < 0.3, "service": rng.choice("abc"), "source_ip": rng.choice(["1", "2", "3", "4"]),
                     "user_agent": rng.choice(["x", "y", None]), "username": rng.choice(["u", "v", "w", "z", None])})
    return rows


@pytest.mark.parametrize("kind", [H.AddressHistory, H.ServiceHistory, H.UserHistory])
@pytest.mark.parametrize("seed", range(4))
def test_histories_in_batches(kind, seed):
    rng, rows, got = random.Random(seed), some_rows(seed, 300), []
    _, history = started(kind)
    while rows[len(got):]:
        part = rows[len(got):len(got) + rng.randrange(1, 60)]
        out = follow(history, rng.sample(part, len(part)))
        assert "spread" not in out
        got += out[["id", *kind.added]].to_dict("records")
    assert got == [{c: r[c] for c in ("id", *kind.added)} for r in walk(rows)]


def test_a_batch_writes_what_it_adds():
    handle, history = started(H.AddressHistory)
    names = 5000
    many = [{"id": i, "us": i, "success": False, "service": f"s{i}", "source_ip": "1", "user_agent": f"a{i}", "username": None} for i in range(names)]
    follow(history, many)
    assert handle.written > 2 * names
    for later in (DAY, 2 * DAY):
        handle.written = 0
        follow(history, [{**many[7], "id": names, "us": later, "username": "u", "service": "new" if later == DAY else "s1"}])
        assert handle.written <= 4  # counters, a service, a user in and one out
    handle, history = started(H.ServiceHistory)
    follow(history, many)
    follow(history, [{**many[0], "us": DAY}])
    assert handle.states["minute"] == [(DAY, 1)] and list(handle.states["ips"]) == [("1",)]


def test_an_address_idle_for_days_stays_blocked():
    _, history = started(H.AddressHistory)
    follow(history, [{"id": i, "us": i * 1000, "success": False, "service": "ssh", "source_ip": "1", "user_agent": None, "username": "root"} for i in range(12)])
    out = follow(history, [{"id": 99, "us": 9 * DAY, "success": True, "service": "ssh", "source_ip": "1", "user_agent": None, "username": None}])
    assert out[["ip_total", "ip_failed", "ip_users"]].values.tolist() == [[13, 12, 0]]


def test_rows_without_a_key_pass_and_leave_no_state():
    handle, history = started(H.UserHistory)
    out = follow(history, some_rows(1, 5), key=None)
    assert handle.written == 0 and out["user_total"].isna().all() and len(out) == 5


def test_live_risk_with_a_model_equals_that_of_the_table(spark, sf, tmp_path):
    from palisade.operators import anomaly as M
    from palisade.operators.engine import detect_all
    from palisade.sources import fixtures as fx
    from palisade.streaming import jobs as S

    stored = str(tmp_path / "events")
    fx.events(spark, sf).where("id % 3 = 0").write.parquet(stored)
    events = spark.read.parquet(stored)

    def vectors(rows):
        return rows.select("id", "ts", "source_ip", "event_type", F.array(
            F.length("raw_message").cast("double"), F.hour("ts").cast("double"), F.when(F.col("severity") == "Critical", 9.0).otherwise(1.0)).alias("features"))

    samples = vectors(events).withColumn("label", F.when(F.col("id") % 5 == 0, False))
    model = M.train_model(samples, min_samples=10)
    model.table(spark).write.parquet(str(tmp_path / "model"))
    names = ["length", "hour", "critical"]
    want = detect_all(events, anomaly=M.detect_anomaly(vectors(events), model, names)).select("id", "has_threats", "risk_score", "anomaly.score").collect()
    ends = [r[0] for r in events.select(F.explode(F.expr("percentile(unix_micros(ts), array(0.4, 1.0))"))).collect()]
    for low, high in zip([-1, ends[0]], ends):  # the second run goes on from the checkpoint
        events.where(F.unix_micros("ts").between(int(low) + 1, int(high))).write.mode("append").parquet(str(tmp_path / "live"))
        live = spark.readStream.schema(events.schema).parquet(str(tmp_path / "live"))
        S.stream_detect(live, str(tmp_path / "found"), str(tmp_path / "alerts"), str(tmp_path / "mark"), brute_force=True, model=str(tmp_path / "model"), vectors=vectors)
    got = spark.read.parquet(str(tmp_path / "found")).select("id", "has_threats", "risk_score", "anomaly.score").collect()
    assert len(got) == len(want) and {r.id for r in got} == {r.id for r in want}
    order = {r.id: r for r in want}
    assert max(abs(r.score - order[r.id].score) for r in got) < 1e-9 and any(r.score for r in got)
    assert max(abs(r.risk_score - order[r.id].risk_score) for r in got) < 1e-9
    assert all(r.has_threats == order[r.id].has_threats for r in got)


def test_a_key_with_few_rows_costs_no_copies(monkeypatch):
    """Rows come in order of time and id, ties as given and missing ids last, from one part or many; one part is not joined or sorted as a frame."""
    parts = [pd.DataFrame({"us": [5, 3, 3, 3], "id": [1.0, 9.0, None, 9.0], "x": list("abcd")}), pd.DataFrame({"us": [4, 3], "id": [2.0, 1.0], "x": ["e", None]})]
    want = [pd.concat(p).sort_values(["us", "id"], ignore_index=True) for p in (parts[:1], parts)]
    objects = pd.DataFrame({"us": [2, 1], "id": pd.Series([None, 1], dtype=object), "x": ["a", "b"]})
    assert H.in_order([objects])["x"].tolist() == ["b", "a"]
    for got, frame in zip([H.in_order(parts[:1]), H.in_order(parts)], want):
        pd.testing.assert_frame_equal(got, frame)

    def refuse(*args, **kwargs):
        raise AssertionError("a whole frame is joined or sorted")

    _, history = started(H.UserHistory)
    part = pd.DataFrame(some_rows(3, 9)).assign(spread=0).astype({"username": object, "user_agent": object})
    before = part.copy()
    for name in ("sort_values", "assign", "drop"):
        monkeypatch.setattr(pd.DataFrame, name, refuse)
    monkeypatch.setattr(H.pd, "concat", refuse)
    (out,) = history.handleInputRows(("k", 0), iter([part]), None)
    assert out["user_total"].tolist() == list(range(1, 10)) and part.equals(before)


@pytest.mark.parametrize("kind", [H.AddressHistory, H.ServiceHistory, H.UserHistory])
def test_a_key_with_many_rows_keeps_what_it_reads_only(kind, monkeypatch):
    """Its rows wait in a file, and the history goes over them step by step; values and other columns as for few rows."""
    rows = some_rows(5, 400) + [{**some_rows(5, 400)[-1], "id": 400}]  # two rows of one instant
    texts = [f"verdict {i} " + "x" * 500 for i in range(len(rows))]
    rng, got = random.Random(5), []
    _, history = started(kind)
    monkeypatch.setattr(H, "HELD_ROWS", 30)
    monkeypatch.setattr(H, "STEP_ROWS", 17)
    taken, whole = [], H.in_order
    monkeypatch.setattr(H, "in_order", lambda parts: taken.append(parts) or whole(parts))
    for some in (rows[:150], rows[150:160], rows[160:]):
        mixed = pd.DataFrame(rng.sample(some, len(some))).assign(spread=0)
        mixed["held"] = [texts[i] for i in mixed["id"]]
        mixed = mixed.astype({"username": object, "user_agent": object}).where(mixed.notna(), None)
        parts = [mixed[i:i + 13] for i in range(0, len(mixed), 13)]
        out = list(history.handleInputRows(("k", 0), iter([p.copy() for p in parts]), None))
        assert len(out) == (len(parts) if len(some) > 30 else 1)  # many rows don't come back as one frame
        got += pd.concat(out)[["id", "held", *kind.added]].to_dict("records")
    assert [["held" in p.columns for p in parts] for parts in taken] == [[False] * 12, [True], [False] * 19]
    want = [{c: r[c] for c in ("id", *kind.added)} | {"held": texts[r["id"]]} for r in walk(rows)]
    assert sorted(got, key=lambda r: r["id"]) == [{c: r[c] for c in got[0]} for r in want]
