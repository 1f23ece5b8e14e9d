"""Tables kept by streams: folding, repeated batches, late rows, and reports from cells."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from palisade.operators import reports as P
from palisade.sources import fixtures as fx, store as W, upkeep as U
from palisade.streaming import jobs as S, rollups as R
from palisade.streaming.tables import BatchTable


def total(rows):
    return rows.groupBy("k").agg(F.sum("n").alias("n"))


def batch(spark, *rows):
    return spark.createDataFrame(list(rows), "k string, n long")


def content(table):
    return {r.k: r.n for r in table.read().collect()}


def test_folding_keeps_the_sum_and_bounds_the_folders(spark, tmp_path):
    table = BatchTable(spark, str(tmp_path), total, fold_every=3)
    for i in range(10):
        table.add(batch(spark, ("a", 1), (f"k{i % 2}", 10)), i)
        table.add(batch(spark, ("a", 1), (f"k{i % 2}", 10)), i)  # a batch that is repeated
        assert len(list(tmp_path.iterdir())) <= 4
    assert content(table) == {"a": 10, "k0": 50, "k1": 50}
    table.add(batch(spark, ("a", 100)), 2)  # long folded
    assert content(table)["a"] == 10
    table.fold()
    assert content(table) == {"a": 10, "k0": 50, "k1": 50} and [p.name for p in tmp_path.iterdir()] == ["base=9"]


@pytest.mark.parametrize("step", ["move", "remove"])
def test_a_break_while_folding_changes_nothing(spark, tmp_path, monkeypatch, step):
    table = BatchTable(spark, str(tmp_path), total, fold_every=100)
    for i in range(4):
        table.add(batch(spark, ("a", 1)), i)

    def breaks(*args):
        raise OSError("gone")

    with monkeypatch.context() as m:
        m.setattr(U._Files, step, breaks)
        with pytest.raises(OSError):
            table.fold()
    assert content(table) == {"a": 4}
    table.add(batch(spark, ("a", 1)), 4)
    table.fold()
    assert content(table) == {"a": 5} and [p.name for p in tmp_path.iterdir()] == ["base=4"]


def test_rates_report_late_rows_and_stay_small(spark, tmp_path):
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    schema = "ts timestamp, event_type string"
    late = []
    for hour in (0, 1, 5, 9, 0, 12):  # the second hour 0 comes long after its window was closed
        rows = spark.createDataFrame([(hour * 3600 + 60 * i, "x") for i in range(7)], "s long, event_type string")
        rows.select(F.timestamp_seconds("s").alias("ts"), "event_type").coalesce(1).write.mode("append").parquet(source)
        late.append(S.stream_rates(spark.readStream.schema(schema).parquet(source), out, mark, fold_every=2))
    got = {r.starts_at.hour: r.n for r in S.latest_rates(spark, out).collect()}
    assert got == {0: 7, 1: 7, 5: 7, 9: 7, 12: 7}
    assert late == [0, 0, 0, 0, 1, 0]  # one partial count of seven rows
    assert len(list(Path(out).iterdir())) <= 3


@pytest.fixture(scope="module")
def rollup(spark, sf, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("rollup") / "events")
    W.write_events(fx.events(spark, sf), path)
    events = W.read_events(spark, path).persist()
    return R.Rollup(R.cells_of(events).persist(), events)


@pytest.mark.parametrize("as_of", ["2024-01-30 20:00:00", "2024-01-30 19:17:33.25", "2024-01-12 00:00:00.000001"])
def test_reports_equal_the_full_scan_also_at_cut_cells(spark, sf, rollup, as_of):
    alerts, acks = fx.alerts(spark, sf), fx.acks(spark, sf)
    want = P.dashboard_stats(rollup.events, alerts, acks, as_of).collect()
    assert rollup.dashboard_stats(alerts, acks, as_of).collect() == want
    for name in ("24h", "30d"):
        assert sorted(rollup.threat_trends(name, as_of).collect()) == sorted(P.threat_trends(rollup.events, name, as_of).collect())


def test_whole_cells_need_no_events(rollup):
    hour = 3_600_000_000
    assert rollup.split([5 * hour, 9 * hour])[1] is None
    assert rollup.split([5 * hour + 1])[1] is not None
