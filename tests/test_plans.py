"""The skew-safe helpers and joins against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from palisade.operators import alerts as A, anomaly as M, bruteforce as B
from palisade.operators.enrich import geo_enrich, ioc_match, related_events
from palisade.functions.text import grams
from palisade.plans.running import Sliding, previous_rows, running, sliding
from palisade.plans.sizing import pattern_join, substring_join


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    # one key holds most rows; many rows share a second
    return [(i, 1_700_000_000 + rng.randrange(20_000) // 7 * 7, "hot" if rng.random() < 0.7 else f"k{rng.randrange(4)}",
             None if rng.random() < 0.2 else f"v{rng.randrange(6)}") for i in range(900)]


def frame(spark, rows):
    df = spark.createDataFrame(rows, "id long, s long, k string, v string")
    return df.withColumn("ts", F.timestamp_seconds("s"))


def before(rows, me):
    return [r for r in rows if r[2] == me[2] and (r[1], r[0]) <= (me[1], me[0])]


def test_running(spark, rows):
    out = running(frame(spark, rows), ["k"], ["ts", "id"], ts="ts", sums={"n": F.lit(1)}, mins={"lo": F.col("id")}, maxs={"hi": F.col("id")}, width=600)
    got = {r.id: (r.n, r.lo, r.hi) for r in out.collect()}
    for me in rows:
        seen = [r[0] for r in before(rows, me)]
        assert got[me[0]] == (len(seen), min(seen), max(seen))


@pytest.mark.parametrize("k", [1, 4])
def test_previous_rows(spark, rows, k):
    out = previous_rows(frame(spark, rows), ["k"], ["ts", "id"], F.col("id"), k, ts="ts", width=300)
    got = {r.id: r.prev for r in out.collect()}
    for me in rows:
        seen = sorted(before(rows, me), key=lambda r: (r[1], r[0]))[:-1]
        assert got[me[0]] == [r[0] for r in seen[-k:]]


def test_sliding(spark, rows):
    df = frame(spark, rows).withColumn("own", F.coalesce("v", F.concat(F.lit("-"), F.col("id").cast("string"))))
    df = previous_rows(df, ["k", "own"], ["ts", "id"], F.col("ts"), 1, ts="ts", out="p").withColumn("p", F.get("p", F.lit(0)))
    out = sliding(df, ["k"], windows=[
        Sliding("closed", 700, True, F.col("v").isNotNull(), F.col("p")), Sliding("open", 700, False, F.lit(True))],
        distinct={"kinds": F.col("v")}, width=500)
    got = {r.id: (r.closed, r.open, r.kinds) for r in out.collect()}
    for me in rows:
        seen = before(rows, me)
        assert got[me[0]] == (
            len({r[3] for r in seen if r[3] and r[1] >= me[1] - 700}), len([r for r in seen if r[1] > me[1] - 700]),
            len({r[3] for r in seen if r[3]}))


def test_dedup_is_a_greedy_chain(spark):
    rng = random.Random(3)
    data = [(i, 1_700_000_000 + rng.randrange(400_000), "hot" if rng.random() < 0.8 else "cold") for i in range(1500)]
    df = spark.createDataFrame(data, "id long, s long, title string").withColumn("ts", F.timestamp_seconds("s")).withColumn("severity", F.lit("High"))
    for block_rows in (50, 1_000_000):
        kept = {r.id for r in A.alert_dedup(df, minutes=30, block_rows=block_rows).collect()}
        want, last = set(), {}
        for i, s, title in sorted(data, key=lambda r: (r[1], r[0])):
            if title not in last or s - last[title] >= 1800:
                last[title] = s
                want.add(i)
        assert kept == want


def test_related_events(spark):
    rng = random.Random(5)
    data = [(i, 1_700_000_000 + rng.randrange(30_000), rng.choice([None, "a", "b", "c"]), rng.choice("pq"), rng.choice("xyz")) for i in range(250)]
    df = spark.createDataFrame(data, "id long, s long, source_ip string, source string, event_type string").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.id: [x.id for x in r.related] for r in related_events(df, limit=4).collect()}
    for me in data:
        near = [o for o in data if o[0] != me[0] and abs(o[1] - me[1]) <= 3600 and (
            (me[2] and o[2] == me[2]) or o[3] == me[3] or o[4] == me[4])]
        want = [o[0] for o in sorted(near, key=lambda o: (o[1], o[0]), reverse=True)[:4]]
        assert got[me[0]] == want


def test_substring_join_in_chunks(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["evil.com/x", "no", "a evil.com b /etc", "é/etc", "ab"])], "id long, t string")
    words = spark.createDataFrame([("evil.com",), ("/etc",), ("ab",), ("zzz",), ("",), (None,), ("ab",)], "w string")
    small = {tuple(r) for r in substring_join(df, "t", words, "w").select("id", "w").collect()}
    large = {tuple(r) for r in substring_join(df, "t", words, "w", chunk_bytes=5).select("id", "w").collect()}
    assert small == large == {(0, "evil.com"), (2, "evil.com"), (2, "/etc"), (3, "/etc"), (4, "ab")}


def test_a_short_list_is_one_pass_over_the_texts(spark):
    """Few words are tested for in place; texts are neither cut into pieces nor joined.  A longer list finds the same."""
    rows = [(0, "a %_' evil.com /etc"), (0, "a %_' evil.com /etc"), (None, "evil.com"), (2, None), (3, ""), (4, "EVIL.com")]
    df = spark.createDataFrame(rows, "id long, t string")
    words = ["evil.com", "/etc", "%_'", "evil.com", "", None, "zzz"]
    more = [f"never-there-{i}" for i in range(100)]
    short, long = (substring_join(df, "t", spark.createDataFrame([(w,) for w in ws], "w string"), "w") for ws in (words, words + more))
    assert "Join" not in short._jdf.queryExecution().optimizedPlan().toString()
    want = sorted(((i, w) for i, t in rows if t for w in {w for w in words if w} if w in t), key=str)
    for out in (short, long):
        assert sorted(((r.id, r.w) for r in out.collect()), key=str) == want


def test_pattern_join_in_chunks(spark):
    df = spark.createDataFrame([(0, "abc"), (1, "xyz"), (2, "abxz")], "id long, t string")
    rules = spark.createDataFrame([("a.c",), ("z$",), ("^x",), ("b",), ("q",)], "p string")
    small = {tuple(r) for r in pattern_join(df, "t", rules, "p").select("id", "p").collect()}
    large = {tuple(r) for r in pattern_join(df, "t", rules, "p", chunk_rules=2).select("id", "p").collect()}
    assert small == large and (0, "a.c") in small
    equal = spark.createDataFrame([("a.c", i) for i in range(9)] + [(None, 9)], "p string, n int")
    for chunk in (1, 4):
        assert sorted(r.n for r in pattern_join(df, "t", equal, "p", chunk_rules=chunk).collect()) == list(range(9))


def test_many_indicators(spark):
    iocs = spark.range(20_000).select(F.lit("Url").alias("ioc_type"), F.format_string("http://h%d.example/x", "id").alias("value"))
    events = spark.createDataFrame([(i, None, f"GET http://h{i}.example/x HTTP/1.1") for i in range(0, 30_000, 1000)], "id long, source_ip string, raw_message string")
    got = {r.id: r.indicators for r in ioc_match(events, iocs).collect()}
    want = {i: sorted(w for n in {i, int(str(i)[1:] or -1)} for w in [f"http://h{n}.example/x"] if n == i and n < 20_000) for i in range(0, 30_000, 1000)}
    assert got == {i: w for i, w in want.items() if w}


def test_one_hot_hour_is_many_cells(spark, rows, monkeypatch):
    """A key whose rows all lie in one hour is split by row count, and nothing changes."""
    from palisade.plans import running as R

    hot = [(i, 1_700_000_000 + i % 50 * 3 + i % 7, "hot", None if i % 5 == 0 else f"v{i % 6}") for i in range(600)]
    df = frame(spark, hot)

    def results():
        total = {r.id: r.n for r in running(df, ["k"], ["ts", "id"], ts="ts", sums={"n": F.lit(1)}).collect()}
        near = {r.id: r.prev for r in previous_rows(df, ["k"], ["ts", "id"], F.col("id"), 3, ts="ts").collect()}
        slid = {r.id: r.w for r in sliding(df, ["k"], windows=[Sliding("w", 60, True, F.lit(True))]).collect()}
        return total, near, slid

    whole = results()
    monkeypatch.setattr(R, "CELL_ROWS", 40)
    assert results() == whole
    cells = R._with_cells(df, ["k"], "ts", R.HOUR, None).groupBy("_bucket").count().collect()
    assert len(cells) > 10 and max(c["count"] for c in cells) <= 40
    R.release_shared()


def chain(rows, span):
    last, kept = {}, set()
    for i, s, k in sorted(rows, key=lambda r: (r[1], r[0])):
        if k not in last or s - last[k] >= span:
            last[k] = s
            kept.add(i)
    return kept


@pytest.mark.parametrize("block", [200_000, 50])
def test_a_stray_time_makes_no_long_block(spark, block):
    rng = random.Random(3)
    rows = [(i, 1_700_000_000 + rng.randrange(40_000), "a" if rng.random() < 0.6 else f"k{rng.randrange(30)}") for i in range(1500)]
    rows += [(9001, 0, "a"), (9002, 4_000_000_000, "a"), (9003, 4_000_000_001, "a")]
    df = spark.createDataFrame(rows, "id long, s long, title string").withColumn("ts", F.timestamp_seconds("s")).withColumn("severity", F.lit("x"))
    got = {r.id for r in A.alert_dedup(df, minutes=5, block_rows=block).select("id").collect()}
    assert got == chain(rows, 300)


def test_batches_of_a_flood(spark):
    df = spark.range(95).select("id", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") % 4).alias("ts"), F.lit("High").alias("severity"), F.lit("t").alias("title"))
    got = A.alert_batch(df, minutes=5, size=10).groupBy("batch_id").count().collect()
    assert sorted(r["count"] for r in got) == [5] + [10] * 9


def test_equal_lines_are_events_of_their_own(spark):
    from palisade.operators.bruteforce import attempts, bf_detect, bf_profile
    from palisade.operators.parse import parse_logs

    line = "Jan 05 10:00:00 host sshd[99]: Failed password for root from 203.0.113.9 port 22 ssh2"
    lines = spark.createDataFrame([("a", line)] * 30 + [("b", line)], "file string, line string").withColumn("ingest_ts", F.lit("2024-01-05 10:00:01").cast("timestamp"))
    events = parse_logs(lines)
    ids = [r.id for r in events.collect()]
    assert len(set(ids)) == 31
    assert sorted(ids) == sorted(r.id for r in parse_logs(lines.repartition(7)).collect())
    assert bf_detect(bf_profile(attempts(events))).count() == 31


def test_nth_samples_are_narrowed(spark):
    rows = [(i, 1_700_000_000 + (i * 7919 % 3000 if i < 2500 else 77), [float(i)]) for i in range(6000)]
    df = spark.createDataFrame(rows, "id long, s long, features array<double>").withColumn("ts", F.timestamp_seconds("s"))
    ordered = sorted(rows, key=lambda r: (r[1], r[0]))
    for place in (0, 100, 3000, 5999):
        assert M._nth_samples(df, [place]) == [ordered[place][2]]


def test_stored_events_are_pruned_by_day(spark, tmp_path):
    from palisade.operators.query import filter_events
    from palisade.sources import fixtures as fx
    from palisade.sources.store import read_events, write_events

    write_events(fx.events(spark, "/root/testdata/sf0.001"), str(tmp_path / "e"))
    stored = read_events(spark, str(tmp_path / "e"))
    some = filter_events(stored, severity="Critical", from_ts="2024-01-10 00:00:00", to_ts="2024-01-11 12:00:00")
    plan = some._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in plan.splitlines() if "FileScan" in x)
    assert "event_date" in scan.split("PartitionFilters: [")[1].split("]")[0]
    assert "Critical" in scan.split("PushedFilters: [")[1].split("]")[0]


def test_geo_takes_the_longest_prefix(spark):
    events = spark.createDataFrame([("10.1.2.3",), ("10.1.9.9",), ("8.8.8.8",), (None,)], "source_ip string")
    geo = spark.createDataFrame([("10.", "Wide", "W", "w"), ("10.1.2.", "Narrow", "N", "n")], "prefix string, country string, code string, name string")
    got = {r.source_ip: r.country for r in geo_enrich(events, geo).collect()}
    assert got == {"10.1.2.3": "Narrow", "10.1.9.9": "Wide", "8.8.8.8": "Unknown", None: "Unknown"}


def test_ioc_kinds(spark):
    events = spark.createDataFrame([(1, "1.2.3.4", "x"), (2, None, "to bad.example now"), (3, None, "User-Agent: evilbot"), (4, None, "evilbot")], "id long, source_ip string, raw_message string")
    iocs = spark.createDataFrame([("IpAddress", "1.2.3.4"), ("Domain", "bad.example"), ("UserAgent", "evilbot")], "ioc_type string, value string")
    assert {r.id: r.indicators for r in ioc_match(events, iocs).collect()} == {1: ["1.2.3.4"], 2: ["bad.example"], 3: ["evilbot"]}


def lloyd(x, k, rounds):
    centers = np.array([x[i * len(x) // k] for i in range(k)])
    for _ in range(rounds):
        near = np.sqrt(((x[:, None] - centers[None]) ** 2).sum(2)).argmin(1)
        centers = np.array([x[near == c].mean(0) if (near == c).any() else np.zeros(x.shape[1]) for c in range(k)])
    return centers, 2 * np.sqrt(((x[:, None] - centers[None]) ** 2).sum(2)).min(1).mean()


def samples(spark, x):
    return spark.createDataFrame([(i, 1_700_000_000 + i * 977, [float(v) for v in row]) for i, row in enumerate(x)], "id long, s long, features array<double>").select(
        "id", F.timestamp_seconds("s").alias("ts"), "features", F.lit(None).cast("boolean").alias("label"), F.lit("10.0.0.1").alias("source_ip"), F.lit("web_request").alias("event_type"))


def test_clusters_follow_lloyd(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.4, (60, 5)) for c in (0, 3, 9)])
    rng.shuffle(x)
    centers, threshold = M.fit_clusters(samples(spark, x))
    want, want_threshold = lloyd(x, 3, 10)
    assert np.allclose(centers, want) and threshold == pytest.approx(want_threshold)


def test_exact_quantile_narrows_down(spark):
    rng = np.random.default_rng(2)
    x = np.stack([rng.normal(size=3000), rng.integers(0, 2, 3000), np.where(np.arange(3000) < 2850, rng.random(3000), 50 + rng.random(3000)), np.ones(3000)], axis=1)
    got = M.exact_quantile(samples(spark, x), 0.95, [(3000, float(c.min()), float(c.max())) for c in x.T], bins=16, few=20)
    assert got == pytest.approx([float(np.quantile(c, 0.95)) for c in x.T])


def test_training_needs_samples(spark):
    with pytest.raises(ValueError):
        M.train_model(samples(spark, np.ones((5, 2))))
    assert not M.detect_anomaly(samples(spark, np.ones((1, 2))), None).first().is_anomaly


# --- login attempts, by hand ------------------------------------------------

def tries(spark, data):
    df = spark.createDataFrame(data, "id long, s long, source_ip string, username string, service string, user_agent string, success boolean")
    return df.withColumn("ts", F.timestamp_seconds("s")).drop("s")


def test_five_failures_by_hand(spark):
    data = [(i, 1_700_000_000 + 10 * i, "9.9.9.9", "admin", "ssh", None, False) for i in range(5)]
    last = B.bf_detect(B.bf_profile(tries(spark, data))).orderBy("id").collect()[-1]
    assert last.ip_total == 5 and last.failure_rate == 1.0 and last.per_minute == 5.0
    assert last.confidence == pytest.approx((0.3 + 0.125 + 0.4 * 0.15) / 3) and not last.detected


def test_success_after_failures_compromises(spark):
    data = [(i, 1_700_000_000 + 10 * i, "9.9.9.9", "bob", "ssh", None, i == 3) for i in range(4)]
    rows = {r.id: r for r in B.user_history(tries(spark, data)).collect()}
    assert not rows[2].user_compromised and rows[3].user_compromised


def test_block_and_unblock(spark):
    t = tries(spark, [(i, 1_700_000_000 + i, "9.9.9.9", None, "ssh", None, False) for i in range(10)])
    state = B.ip_block_state(t, "2023-11-14 22:30:00")
    assert state.first().blocked
    lifted = spark.createDataFrame([("9.9.9.9",)], "source_ip string").withColumn("ts", F.lit("2023-11-14 22:20:00").cast("timestamp"))
    assert B.unblock_ip(state, lifted).count() == 0


def test_sequential_usernames(spark):
    names = ["100", "101", "102", "7", "admin2"]
    df = spark.createDataFrame([("a", n) for n in names] + [("b", "10"), ("b", "11"), ("b", "110"), ("b", "12")], "source_ip string, username string")
    got = {r.source_ip: r.patterns for r in B.username_patterns(df).collect()}
    assert got == {"a": ["common_username_admin", "sequential_numeric_usernames"], "b": []}


def test_a_constant_feature_has_its_value_as_threshold(spark):
    """ln(101) added up 8,000 times and divided is not ln(101) any more; the threshold has to be."""
    from palisade.operators import anomaly as M

    value = 4.61512051684126
    rows = spark.range(8000).select(F.array(F.lit(value), F.rand(3)).alias("features"), F.lit(False).alias("label"))
    found = {(n, r.feature): r.threshold for n in (1, 3, 7) for r in M.fit_fp_thresholds(rows.repartition(n), 2).collect()}
    assert {found[n, 0] for n in (1, 3, 7)} == {value}
    mean = [found[n, 1] for n in (1, 3, 7)]
    assert max(mean) - min(mean) < 1e-12
    scored = spark.createDataFrame([([mean[0] + 1e-13, value],), ([mean[0] * 1.001, value],)], "features array<double>")
    assert [r[0] for r in scored.select(M.score_fp([mean[0], value], False)).collect()] == [0.7, 0.35]


def test_grams(spark):
    texts = ["abcab", "ab", "", None, "é😀ü+x", "0123456789" * 130, "x" * 63, "y" * 64, "z" * 65, "ab" * 300]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for size in (1, 3, 8):
        got = {r.t: r.g for r in rows.select("t", grams(F.col("t"), F.lit(size)).alias("g")).collect()}
        assert got == {t: [t[i:i + size] for i in range(len(t) - size + 1)] if t else [] for t in texts}


def test_twenty_thousand_words_without_python(spark):
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abcd") for _ in range(rng.choice([1, 2, 3, 5, 7, 8, 9, 15]))) for _ in range(400)} | {f"https://evil.example/{i}" for i in range(20_000)})
    texts = ["".join(rng.choice("abcde") for _ in range(rng.choice([0, 3, 40, 900]))) + f" https://evil.example/{i * 37} " for i in range(60)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    out = substring_join(df, "t", spark.createDataFrame([(w,) for w in words * 2] + [(None,), ("",)], "w string"), "w", chunk_bytes=200_000)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan and "BroadcastHashJoin" in plan
    assert sorted((r.id, r.w) for r in out.collect()) == sorted((i, w) for i, t in enumerate(texts) if t for w in words if w in t)
