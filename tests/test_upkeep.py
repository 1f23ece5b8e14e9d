"""Stored days that are replaced, dropped, compacted, looked up and searched."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from palisade.operators.query import search_events
from palisade.schema import EVENTS
from palisade.sources import fixtures as fx, search_index as X, store as W, upkeep as U

SCHEMA = "id long, v string, event_date date"


def table(spark, rows):
    return spark.createDataFrame(rows, "id long, v string, day string").select("id", "v", F.to_date("day").alias("event_date"))


def start(spark, path):
    rows = [(i, "old", f"2024-01-0{1 + i % 4}") for i in range(40)]
    table(spark, rows).repartition(5).write.partitionBy("event_date").parquet(path)
    return rows


def content(spark, path):
    return sorted((r.id, r.v, str(r.event_date)) for r in spark.read.schema(SCHEMA).parquet(path).collect())


def hidden(path):
    return [p.name for p in Path(path).iterdir() if p.name.startswith(U._PENDING)]


def test_days_are_replaced_vanish_and_appear(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = start(spark, path)
    new = [(100, "new", "2024-01-02"), (101, "new", "2024-01-09")]
    U.replace_days(spark, path, table(spark, new), ["2024-01-02", "2024-01-03", "2024-01-09", "2024-01-30"])
    want = sorted(new + [r for r in rows if r[2] not in ("2024-01-02", "2024-01-03")])
    assert content(spark, path) == want and not hidden(path)
    with pytest.raises(ValueError):
        U.replace_days(spark, path, table(spark, new), ["2024-01-02"])
    assert content(spark, path) == want and not hidden(path)


@pytest.mark.parametrize("step", range(8))
def test_a_crash_loses_nothing(spark, tmp_path, monkeypatch, step):
    """Broken off at any step, the next change finds the table as before or as after."""
    path = str(tmp_path / "t")
    rows, done, whole = start(spark, path), [0], U._Files.move
    new = [(100, "new", "2024-01-02"), (101, "new", "2024-01-09")]

    def breaks(self, old, place):
        if done[0] == step:
            raise OSError("gone")
        done[0] += 1
        whole(self, old, place)

    monkeypatch.setattr(U._Files, "move", breaks)
    before, after = sorted(rows), sorted(new + [r for r in rows if r[2] not in ("2024-01-02", "2024-01-03")])
    try:
        U.replace_days(spark, path, table(spark, new), ["2024-01-02", "2024-01-03", "2024-01-09"])
        assert step >= 5
    except OSError:
        pass
    monkeypatch.setattr(U._Files, "move", whole)
    U.recover(spark, path)
    assert content(spark, path) == (before if step == 0 else after) and not hidden(path)
    U.recover(spark, path)
    assert content(spark, path) == (before if step == 0 else after)


def test_retention_touches_only_days_that_lose_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = start(spark, path)
    kept = {p.name for p in (tmp_path / "t" / "event_date=2024-01-04").iterdir()}
    schema = table(spark, rows).schema
    keep = (F.col("event_date") > "2024-01-02") | ((F.col("event_date") == "2024-01-02") & (F.col("id") > 20))
    assert U.retain_stored(spark, path, schema, keep) == 2
    assert content(spark, path) == sorted(r for r in rows if r[2] > "2024-01-02" or r[2] == "2024-01-02" and r[0] > 20)
    assert {p.name for p in (tmp_path / "t" / "event_date=2024-01-04").iterdir()} == kept
    assert not (tmp_path / "t" / "event_date=2024-01-01").exists()
    assert U.retain_stored(spark, path, schema, keep) == 0


def test_small_files_are_gathered(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = start(spark, path)
    schema = table(spark, rows).schema
    assert U.compact_days(spark, path, schema, spare=1) == 4
    assert content(spark, path) == sorted(rows)
    assert all(len(list(d.glob("*.parquet"))) == 1 for d in (tmp_path / "t").glob("event_date=*"))
    assert U.compact_days(spark, path, schema, spare=1) == 0


def rows_read(df):
    """Rows that the scans of an executed plan gave."""
    df.collect()
    plan, read, waiting = df._jdf.queryExecution().executedPlan(), 0, []
    waiting.append(plan.executedPlan() if "AdaptiveSparkPlan" in plan.nodeName() else plan)
    while waiting:
        node = waiting.pop()
        if node.nodeName().startswith("Scan"):
            read += node.metrics().get("numOutputRows").get().value()
        children = node.children()
        waiting += [children.apply(i) for i in range(children.size())]
    return read


@pytest.fixture(scope="module")
def store(spark, sf, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("store") / "events")
    events = fx.events(spark, sf)
    many = events.crossJoin(spark.range(30).select(F.col("id").alias("copy"))).withColumn("id", F.abs(F.xxhash64("id", "copy"))).drop("copy")
    W.write_events(many.withColumn("event_date", F.lit("2024-01-01").cast("date")).coalesce(2), path, row_group_bytes=64 << 10)
    return path


def test_an_id_is_found_without_reading_all(spark, store):
    events = W.read_events(spark, store)
    total, some = events.count(), [r.id for r in events.select("id").orderBy(F.xxhash64("id")).limit(3).collect()]
    for i in some:
        one = events.where(F.col("id") == i).select("id", "source")
        assert rows_read(one) < total / 5 and one.count() == 1
    assert rows_read(events.where(F.col("id") == 12345).select("id", "source")) < total / 5


def test_trigrams(spark):
    rows = ["abcab", "ab", "", None, "aaaa", "é😀ü+"]
    got = spark.createDataFrame([(r,) for r in rows], "t string").select("t", X.trigrams(F.col("t")).alias("g")).collect()
    assert {r.t: sorted(r.g) for r in got} == {r: sorted({r[i:i + 3] for i in range(len(r) - 2)}) if r else [] for r in rows}


def test_indexed_search_equals_reading_everything(spark, sf, tmp_path):
    store, index = str(tmp_path / "s"), str(tmp_path / "i")
    W.write_events(fx.events(spark, sf), store)
    events = W.read_events(spark, store).persist()
    X.index_events(events.where("id % 2 = 0"), index)
    X.index_events(events.where("id % 2 = 1 OR id % 10 = 0"), index)  # some twice
    message = events.where("length(raw_message) > 60").orderBy("id").first().raw_message
    for text in ("PassWD", "union select", message[20:45], "no such text", "zz", "GET /"):
        got = sorted(r.id for r in X.search_indexed(spark, store, index, text).collect())
        assert got == sorted(r.id for r in search_events(events, text).collect()), text
    events.unpersist()
    absent = X.search_indexed(spark, store, index, "qqxqqx")
    assert absent.count() == 0 and "FileScan" not in absent._jdf.queryExecution().executedPlan().toString()
    rare = X.search_indexed(spark, store, index, message[20:45])
    filters = rare._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1]
    assert rare.count() and "event_date" in filters.split("]")[0] and "(id," in filters.split("PushedFilters: [")[1]


def test_a_stream_removes_days_that_grew_too_old(spark, tmp_path):
    from palisade.streaming import jobs as S

    path, source, mark = (str(tmp_path / n) for n in ("t", "in", "mark"))
    rows = start(spark, path)  # 1 to 4 January
    left = []
    for moment in ("2024-01-05 10:00:00", "2024-01-01 00:00:00", "2024-01-06 23:59:59", "2024-02-01 00:00:00"):
        spark.createDataFrame([(moment,)], "m string").select(F.to_timestamp("m").alias("ts")).write.mode("append").parquet(source)
        S.stream_cleanup(spark.readStream.schema("ts timestamp").parquet(source), path, mark, 2)
        left.append({r[2] for r in content(spark, path)})
    assert left[0] == left[1] == {"2024-01-03", "2024-01-04"} and left[2] == {"2024-01-04"} and left[3] == set()
    assert rows
