"""Work per task and per row stays bounded as tables grow."""

import math
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from palisade.functions.text import text_entropy
from palisade.operators import anomaly as M
from palisade.plans import running as RN
from palisade.schema import EVENTS
from palisade.sources import fixtures as fx, search_index as X


def test_one_row_group_becomes_many_tasks(spark, tmp_path, monkeypatch):
    """A large table whose rows lie in one row group is read by one task, but not worked on by one."""
    monkeypatch.setattr(fx, "SPLIT_BYTES", 1)
    monkeypatch.setattr(fx, "TASK_ROWS", 50)
    ids = [*range(2000), None, 7, 7]
    pq.write_table(pa.table({"k": pa.array(ids, pa.int64())}), tmp_path / "wide.parquet")
    out = fx.table(spark, str(tmp_path), "wide")
    sizes = [r["n"] for r in out.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert max(sizes) <= 60 and len(sizes) >= 40
    assert Counter(r["k"] for r in out.collect()) == Counter(ids)


def test_entropy_takes_one_pass(spark):
    """Equal to the definition, also for characters beyond 16 bits, and without a replacement per distinct character."""
    texts = ["", None, "x", "aab\n\n  a", "a\U0001F600b\U0001F600é.*\\1$", "".join(chr(33 + i % 90) for i in range(5000))]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text_entropy(F.col("t")).alias("e"))
    for row in df.collect():
        text, size = row["t"] or "", len((row["t"] or "").encode())
        want = -sum(n / size * math.log2(n / size) for n in Counter(text).values())
        assert math.isclose(row["e"], want, abs_tol=1e-9), text
    assert "replace(" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_postings_arise_in_blocks_of_events(spark, tmp_path, monkeypatch):
    """The index deals out events, not their postings; repeated and null ids are searched too."""
    monkeypatch.setattr(X, "TASK_EVENTS", 10)
    rows = [(i, f"GET /{'etc/passwd' if i and i % 9 == 0 else 'index'} {i}") for i in [*range(150), 9, 9]] + [(None, "no id")]
    text = spark.createDataFrame(rows, "id long, raw_message string")
    fill = {"ts": "timestamp '2024-01-05 10:00:00'", "event_date": "date '2024-01-05'", "source": "'nginx'", "event_type": "'Normal'", "severity": "'Info'"}
    events = text.select(*[
        F.col(f.name) if f.name in text.columns else F.expr(fill.get(f.name, "null")).cast(f.dataType).alias(f.name) for f in EVENTS.fields])
    store, index = str(tmp_path / "store"), str(tmp_path / "index")
    events.write.partitionBy("event_date").parquet(store)
    X.index_events(X.read_events(spark, store), index)
    files = [r[0] for r in spark.read.parquet(index).select(F.input_file_name()).distinct().collect()]
    assert len(files) >= 10
    found = X.search_indexed(spark, store, index, "PassWD")
    assert Counter(r["id"] for r in found.collect()) == Counter(i for i, m in rows if "passwd" in m)


def test_windows_get_their_rows_by_number(spark, monkeypatch):
    """Narrow rows that are alike weigh next to nothing, and are yet worked on by many tasks; repeated rows and null keys as before."""
    monkeypatch.setattr(RN, "TASK_ROWS", 100)
    rows = [(i % 4, i // 4 * 60, i, 1) for i in range(4000)] + [(0, 0, 0, 1), (None, 5, 5, 1)]
    df = spark.createDataFrame(rows, "k int, s long, id long, x int").withColumn("ts", F.timestamp_seconds("s"))
    known = [r for r in rows if r[0] is not None]
    n = len(rows)
    summed = RN.running(df, ["k"], ["ts", "id"], ts="ts", sums={"total": F.col("x")}, at_most=n)
    before = RN.previous_rows(df, ["k"], ["ts", "id"], F.col("id"), 3, ts="ts", at_most=n)
    one = RN.previous_rows(df, ["k"], ["ts", "id"], F.col("id"), 1, ts="ts", at_most=n)
    for out in (summed, before, one):
        tasks = out.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()
        assert len(tasks) >= 20 and sum(t["n"] for t in tasks) == len(known)
    of_key = {k: sorted((s, i) for kk, s, i, _ in known if kk == k) for k in range(4)}
    assert sorted((r["k"], r["total"]) for r in summed.collect()) == sorted((k, m + 1) for k, v in of_key.items() for m in range(len(v)))
    for out, k in ((before, 3), (one, 1)):
        want = sorted((key, i, [b for _, b in v[max(0, m - k):m]]) for key, v in of_key.items() for m, (_, i) in enumerate(v))
        assert sorted((r["k"], r["id"], r["prev"]) for r in out.collect()) == want


def test_repeated_rows_count_alike_whatever_the_join(spark):
    """Rows of one id that come twice have the same deviations with broadcast joins and without."""
    rows = [(i // 2, i // 2 * 30, "10.0.0.1", f"a{i // 2 % 3}", f"/p{i // 2 % 5}", "GET", 100, 7) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, s long, source_ip string, user_agent string, path string, method string, request_size long, response_time_ms long")
    df = df.withColumn("ts", F.timestamp_seconds("s"))
    found = {}
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for limit in ("-1", "10MB"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        try:
            found[limit] = sorted(tuple(r) for r in M._rarities(df, len(rows)).collect())
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert found["-1"] == found["10MB"]


def test_an_index_task_lists_its_postings(spark, tmp_path, monkeypatch):
    """A row per day and gram and not per posting; characters beyond 16 bits, steps that end within a task, days and ids that are missing."""
    monkeypatch.setattr(X, "TASK_EVENTS", 40)
    texts = ["GET /etc/passwd", "a\U0001F600b\U0001F600\u0130\u00e9", "", None, "ab", "aaaaaa", "x" * 300]
    rows = [(i, f"2024-01-{5 + i % 2:02d}" if i % 9 else None, texts[i % 7], ["nginx", "ssh", None][i % 3], "Normal") for i in [*range(120), 7, 7]]
    rows.append((None, "2024-01-05", "no id", "ssh", "Normal"))
    events = spark.createDataFrame(rows, "id long, day string, raw_message string, source string, event_type string").withColumn("event_date", F.to_date("day"))
    X.index_events(events, str(tmp_path / "index"))
    got = spark.read.schema(X.POSTINGS).parquet(str(tmp_path / "index"))
    fields = F.concat(*[X.trigrams(F.coalesce(F.lower(c), F.lit(""))) for c in ("raw_message", "source", "event_type")])
    want = events.where("id IS NOT NULL").select("event_date", "id", F.explode(F.array_distinct(fields)).alias("gram")).distinct()
    posted = {tuple(r) for r in got.select("event_date", F.explode("ids"), "gram").collect()}
    assert posted == {tuple(r) for r in want.collect()}
    assert got.count() * 3 < len(posted)  # a task lists events together
    steps = []
    monkeypatch.setattr(X, "_posted", lambda days, ids, texts, of: steps.append(len(ids)) or iter(()))
    monkeypatch.setattr(X, "STEP_CHARS", 50)
    batch = pa.table({"event_date": pa.array([None] * 10, pa.date32()), "id": [*range(9), None], "raw_message": ["y" * 20] * 10, "source": ["s"] * 10, "event_type": [None] * 10})
    list(X._postings(iter(batch.to_batches())))
    assert steps == [3, 3, 3]


def test_a_halving_mean_walks_each_cell_once(spark, monkeypatch):
    """Equal to the plain walk, over cells of any size, with repeated rows and missing values, times and keys, and without arrays of earlier values."""
    monkeypatch.setattr(RN, "TASK_ROWS", 50)
    monkeypatch.setattr(RN, "CELL_ROWS", 40)
    rows = [("a", (i * i * 37) % 90_000 + 400_000 * (i % 3), i, float(i * 7 % 23)) for i in range(300)] + [("b", 10_000 * i, i, 1e6 / (i + 1)) for i in range(150)]
    rows += [("a", 5, 900, None), ("a", None, 901, 3.0), (None, 5, 902, 3.0), ("a", 2000, 903, 4.0), ("a", 2000, 903, 4.0)]
    df = spark.createDataFrame(rows, "k string, s long, id long, x double").withColumn("ts", F.timestamp_seconds("s"))
    want = []
    for key in "ab":
        mean = 0.0
        for s, i, x in sorted((s, i, x) for k, s, i, x in rows if k == key and s is not None and x is not None):
            mean = (mean + x) / 2
            want.append((key, s, i, mean))
    for n in (len(rows), None):
        out = RN.halving_mean(df.where("k IS NOT NULL"), ["k"], ["ts", "id"], F.col("x"), ts="ts", out="mean", at_most=n and 10 * n)
        assert out.columns == ["k", "s", "id", "x", "ts", "mean"]
        assert "collect_list(_x" not in out._jdf.queryExecution().optimizedPlan().toString()
        got = sorted((r["k"], r["s"], r["id"], r["mean"]) for r in out.collect())
        assert [g[:3] for g in got] == sorted(w[:3] for w in want)
        assert all(math.isclose(g[3], w[3], rel_tol=1e-12) for g, w in zip(got, sorted(want)))


def test_quantiles_send_bins_and_not_rows(spark):
    """Exact with ties, missing and unlike features; a task gives at most a row per bin, feature and value it looks at."""
    import numpy as np

    rng = np.random.default_rng(3)
    rows = [(rng.standard_normal(2).tolist() + [float(i % 5)],) for i in range(9000)] + [(None,), ([1.0],), ([None, 0.5, 2.0],)]
    df = spark.createDataFrame(rows, "features array<double>").repartition(3)
    values = [sorted(f[i] for f, in rows if f and i < len(f) and f[i] is not None) for i in range(3)]
    got = M.exact_quantile(df, 0.95, [(len(v), v[0], v[-1]) for v in values], bins=16, few=10)
    assert np.allclose(got, [np.quantile(v, 0.95) for v in values], rtol=0, atol=1e-12)
    made = df.mapInPandas(M._bin_counts({0: (-9.0, 9.0), 2: (0.0, 4.0)}, 16), "i int, b int, n long, lo double, hi double").collect()
    assert len(made) <= 3 * 2 * 16 and sum(r["n"] for r in made) == len(values[0]) + len(values[2])


def test_the_risk_needs_no_sorted_features(spark):
    rows = [(1, [0.0, 0.0, 0.0]), (2, [9.0, 0.0, 5.0]), (3, [9.0, 9.0, 5.0]), (4, [None, 9.0]), (5, None), (6, [float("nan"), 0.0, 5.0])]
    df = spark.createDataFrame(rows, "id long, features array<double>")
    model = M.Model([1.0, 1.0, 5.0], [0.0] * 3, [[0.0] * 3], 1e9, [0.0, 0.0, 5.0], [1.0, 1.0, 0.0], False, 6)
    out = M.detect_anomaly(df, model, ["a", "b", "c"])
    risk = out.select("id", "risk_level")
    assert "sort_array" not in risk._jdf.queryExecution().optimizedPlan().toString()
    want = out.select("id", M.anomaly_risk(F.col("anomaly_score"), F.col("importance")).alias("risk_level"))
    assert sorted(map(tuple, risk.collect())) == sorted(map(tuple, want.collect()))
