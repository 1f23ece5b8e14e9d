"""One pass over all kinds of key gives what the histories of each kind give."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from palisade.operators.anomaly import behavior_features
from palisade.operators.bruteforce import bf_profile, ip_behavior, ip_history, service_behavior, service_history, user_behavior, user_history
from palisade.operators.enrich import related_events
from palisade.plans import running

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
TRIES = "id long, ts timestamp, source_ip string, username string, service string, user_agent string, success boolean"


def _tries(n: int, seed: int):
    rng = random.Random(seed)
    at = 0
    for i in range(n):
        at += rng.choice([0, 0, 1, 20, 60, 61, 300, 900, 901])  # ties and both ends of the windows
        # one address holds most rows; any column may lack a value
        yield (i * 7 % n, START + dt.timedelta(seconds=at), rng.choice(["10.0.0.1"] * 6 + ["10.0.0.2", "10.0.0.3"]),
               rng.choice(["root", "admin", "guest", None]), rng.choice(["ssh", "ssh", "http", "ftp", None]),
               rng.choice(["a", "b", "c", "d", None]), rng.random() < 0.3)


def _rows(df, columns):
    return sorted(tuple(repr(r[c]) for c in columns) for r in df.collect())


@pytest.mark.parametrize("cell_rows", [1_000_000, 20])
def test_profile_equals_the_three_histories(spark, monkeypatch, cell_rows):
    monkeypatch.setattr(running, "CELL_ROWS", cell_rows)  # 20: crowded cells are split
    tries = spark.createDataFrame(list(_tries(300, 3)), TRIES).repartition(3)
    by_user = user_behavior(user_history(tries)).select("id", "user_total", "user_failed", "user_ips", "user_compromised", "compromise_confidence")
    by_service = service_behavior(service_history(tries)).select(
        "id", "service_total", "service_ips", "service_users", "service_peak", "under_attack")
    want = ip_behavior(ip_history(tries)).join(by_service, "id").join(by_user, "id", "left")
    got = bf_profile(tries)
    assert dict(got.dtypes) == dict(want.dtypes)
    columns = sorted(want.columns)
    rows = _rows(got, columns)
    assert rows == _rows(want, columns)
    assert 0 < len(rows) < 300  # rows without a service have no history of one


def test_profile_of_nothing(spark):
    assert bf_profile(spark.createDataFrame([], TRIES)).collect() == []


def test_related_events_against_plain_lists(spark):
    rng = random.Random(8)
    rows = []
    for i in range(120):
        rows.append((i, START + dt.timedelta(seconds=rng.choice([0, 1, 1800, 3600, 3601]) * rng.randrange(4)), rng.choice(["a", "b", None]),
                     rng.choice(["s", "t"]), rng.choice(["x", "y", "z", None])))
    df = spark.createDataFrame(rows, "id long, ts timestamp, source_ip string, source string, event_type string")
    got = {r["id"]: [x["id"] for x in r["related"]] for r in related_events(df, limit=5).collect()}
    hour = dt.timedelta(hours=1)
    for row in rows:
        near = [o for o in rows if o[0] != row[0] and abs(o[1] - row[1]) <= hour
                and any(row[k] is not None and row[k] == o[k] for k in (2, 3, 4))]
        want = [o[0] for o in sorted(near, key=lambda o: (o[1], o[0]), reverse=True)[:5]]
        assert got[row[0]] == want


def test_behavior_features_against_plain_loops(spark):
    rng = random.Random(5)
    rows = [(i, START + dt.timedelta(seconds=i // 2), rng.choice(["a", "a", "b", None]), rng.choice(["u", "v", None]), rng.choice(["/p", "/q"]),
             rng.choice(["GET", None]), rng.choice([None, 0, 100, 5000]), rng.choice([None, 3.0, 90.0])) for i in range(90)]
    df = spark.createDataFrame(
        rows, "id long, ts timestamp, source_ip string, user_agent string, path string, method string, request_size long, response_time_ms double")
    got = {r["id"]: r for r in behavior_features(df).collect()}
    assert set(got) == {r[0] for r in rows if r[2] is not None}
    averages, seen = {}, {}
    for row in rows:
        if row[2] is None:
            continue
        for k, name, missing in ((3, "user_agent_deviation", 1.0), (4, "path_deviation", 0.5), (5, "method_deviation", 0.5)):
            want = missing
            if row[k] is not None:
                past = seen.setdefault((row[2], k), [])
                past.append(row[k])
                want = 1 - past.count(row[k]) / len(past)
            assert got[row[0]][name] == pytest.approx(want, abs=1e-12)
        for k, name in ((6, "request_size_deviation"), (7, "response_time_deviation")):
            want = 0.0
            if row[k] is not None:
                avg = averages[row[2], k] = (averages.get((row[2], k), 0.0) + row[k]) / 2
                want = min(abs(row[k] - avg) / avg, 10.0) if avg > 0 else 0.0
            assert got[row[0]][name] == pytest.approx(want, abs=1e-9)
