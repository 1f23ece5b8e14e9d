"""Operators over vectors and addresses, and the pipeline."""

from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import brute
import corpus_pipeline
from palisade.llm import ann, embed_dedup, graph, stages, urls
from palisade.llm.queries import QUERIES

VECTORS = "vec_id long, embedding array<float>, label int, n_links string, key string, rank string, score string, dim string"


def awkward_vectors():
    rng = np.random.default_rng(4)
    base = brute.unit_vectors(60, 8, rng)
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(100 + i, (base[3] * (1 + i) + 0.02 * rng.standard_normal(8)).tolist()) for i in range(30)]
    rows += [(200 + i, base[5].tolist()) for i in range(25)]
    rows += [(300, None), (301, []), (302, [0.0] * 8), (303, [float("nan")] * 8), (304, [1.0, None] * 4), (305, [float("inf")] * 8),
             (None, base[7].tolist()), (310, base[8].tolist()), (310, base[8].tolist()), (320, [1.0, 2.0]), (340, [2.0, 4.0]), (341, [1.0, 2.0]),
             (360, (base[9] * 1e-20).tolist()), (361, (base[9] * 1e18).tolist())]
    return [(i, v, None, "x", "x", "x", "x", "x") for i, v in rows]


def usable(v):
    return bool(v) and None not in v and bool(np.isfinite(v).all()) and any(v)


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame(awkward_vectors(), VECTORS).cache()


@pytest.mark.parametrize("block", [1024, 4])
def test_near_vectors_of_awkward_rows(vectors, block):
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    good = [k for k, (i, v) in enumerate(rows) if usable(v) and i is not None]
    unit = {k: np.array(rows[k][1], np.float64) / np.linalg.norm(np.array(rows[k][1], np.float64)) for k in good}
    links = [(a, b) for a in good for b in good if b < a and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.9]
    many = Counter(x for p in links for x in p)
    of = brute.component_of(len(rows), links)
    first = {}
    for k in good:
        first[of[k]] = min(rows[k][0], first.get(of[k], rows[k][0]))
    want = Counter((i, many[k], first[of[k]] if k in unit else i) for k, (i, _) in enumerate(rows))
    got = embed_dedup.near_vectors(vectors, block_rows=block)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    got = got.collect()
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in got) == want
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)
    assert embed_dedup.near_vectors(vectors.limit(0)).count() == 0


def test_chance_to_meet():
    rng = np.random.default_rng(0)
    gap = rng.standard_normal(200_000) / 4.0 + rng.uniform(0, 1, 200_000)
    assert ((gap >= 0) & (gap < 1)).mean() == pytest.approx(embed_dedup.meets(4.0), abs=0.005)
    k, tables = embed_dedup.table_sizes(50_000, 0.9)
    assert (1 - embed_dedup.meets(embed_dedup.WIDTH) ** k) ** tables <= embed_dedup.MISS


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(8)
    a = brute.unit_vectors(1000, 32, rng)
    side = rng.standard_normal((1000, 32))
    side -= (side * a).sum(1, keepdims=True) * a
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    b = 0.902 * a + np.sqrt(1 - 0.902**2) * side
    rows = [(int(i), v.tolist()) for i, v in enumerate(np.concatenate([a, b]))]
    got = embed_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert got.where("n_links > 0").count() >= 0.98 * 2000


def exact(rows, k=20):
    out = {}
    seen = {}
    for i, v in rows:
        if usable(v) and i is not None and (i not in seen or v < seen[i]):
            seen[i] = v
    for i, v in seen.items():
        if i % 20 == 0:
            found = sorted((-float(np.dot(np.array(v, np.float64), np.array(w, np.float64))), j) for j, w in seen.items() if j != i and len(w) == len(v))
            out[i] = [j for _, j in found[:k]]
    return out


def test_nearest_of_awkward_rows(vectors):
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    want = exact(rows)
    got = ann.nearest(vectors, F.col("vec_id") % 20 == 0)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    table = got.toPandas().sort_values(["query_id", "rank"])
    hits = [len(set(table[table.query_id == q].vec_id) & set(w)) / len(w) for q, w in want.items()]
    assert set(table.query_id) == set(want) and np.mean(hits) >= 0.95
    assert not table.duplicated(["query_id", "vec_id"]).any()
    for _, rank in table.groupby("query_id"):
        assert rank["rank"].tolist() == list(range(1, len(rank) + 1))
        assert rank[["score", "vec_id"]].apply(lambda r: (-r.score, r.vec_id), axis=1).is_monotonic_increasing
    assert ann.nearest(vectors.limit(0), F.lit(True)).count() == 0


def test_graph_recall_and_layers():
    x, _ = ann.level_lengths(np.random.default_rng(1).standard_normal((3000, 32)))
    order, layers = ann.build_graph(x)
    assert sorted(order.tolist()) == list(range(3000))
    for k, layer in enumerate(layers):
        assert layer.shape[1] == (32 if k == 0 else 16) and layer.max() < len(layer)
        for row in layer[:200]:
            own = row[row >= 0].tolist()
            assert len(own) == len(set(own))
    x = x[order]
    found = ann.search_graph(x, layers, x[:200])
    truth = np.argsort(-(x[:200] @ x.T), axis=1)[:, :20]
    assert np.mean([len(set(f) & set(t)) / 20 for f, t in zip(found.tolist(), truth.tolist())]) >= 0.9


def test_shards_are_merged(spark, sf):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    want = exact(rows)
    table = ann.nearest(vectors, F.col("vec_id") % 20 == 0, shard_rows=60).toPandas()
    assert np.mean([len(set(table[table.query_id == q].vec_id) & set(w)) / 20 for q, w in want.items()]) >= 0.95


def test_components_against_union_find(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(400, 440)] + [(500, 501 + i) for i in range(50)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame([*edges, (None, 3), (7, 7)], "a long, b long")).collect()}
    want = brute.component_of(600, edges)
    assert {i: got.get(i, i) for i in range(600)} == dict(enumerate(want))
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# addresses

PAGES = "page_id long, url string, html string, host string, path string, rule string, verdict string"
URLS = [
    "https://a.example.net/en/5", "HTTP://A.EXAMPLE.NET/en/5?x=1#y", "http://example.net/de/", "http://net", "http://net/", "http://xnet/", "http://a.net?x",
    "https://x.org/fr/1.html", "https://x.org/en/fr/", "https://w.example.com/de/7/", "https://example.com/DE/", "https://notexample.com/de/", "no address", "",
    None, "file:///de/x", "http://u@h.example.com:80/de/", "https://x.org/a/3", "https://x.org/a/3", "http://.net/", "http://a..net/en/", "x://" + "b." * 5000 + "net/" + "p" * 3000,
    "https://é.ORG/fr/", "a://b://c.net/d", "https://x.org/3\nnet/",
]


def judged(url, listed):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:cut].translate(brute.LOWER), rest[cut:]
    path = rest[:min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    return host, path, None, "block" if url in listed else "allow"


def test_judgements_of_awkward_rows(spark):
    pages = spark.createDataFrame([(None if i == 3 else i, u, None, "x", "x", "x", "x") for i, u in enumerate(URLS)], PAGES)
    listed = spark.createDataFrame([("https://x.org/a/3",), (None,), ("no address",)], "url string")
    entries = urls.build_list(spark, urls.RULES, listed)
    got = urls.judge_urls(pages, entries, urls.RULES).collect()
    want = Counter((None if i == 3 else i, *judged(u, {"https://x.org/a/3", "no address"})) for i, u in enumerate(URLS))
    assert Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got) == want
    assert urls.judge_urls(pages.limit(0), entries, urls.RULES).count() == 0
    nothing = urls.judge_urls(pages, urls.build_list(spark, []), []).collect()
    assert {(r.rule, r.verdict) for r in nothing} == {(None, "allow")} and len(nothing) == len(URLS)


def test_colliding_digests_are_told_apart_by_their_strings():
    entries = pd.DataFrame({"key": ["a", "b", "c"], "digest": [5, 5, 9], "verdict": ["block", "allow", "block"]})
    probes = pd.DataFrame({"url": list("uvwxy"), "key": ["b", "a", "z", "c", "c"], "digest": [5, 5, 5, 9, 8]})
    got = urls.find_in_segment(entries, probes)
    assert got[["url", "verdict"]].values.tolist() == [["u", "allow"], ["v", "block"], ["x", "block"]]
    assert urls.find_in_segment(entries.iloc[:0], probes).empty and urls.find_in_segment(entries, probes.iloc[:0]).empty


def test_segments(spark, monkeypatch):
    monkeypatch.setattr(urls, "SEGMENT_ENTRIES", 8)
    monkeypatch.setattr(urls, "GROUP_PROBES", 50)
    pages = spark.createDataFrame([(i, f"http://h{i % 40}.org/p") for i in range(400)], "page_id long, url string")
    listed = spark.createDataFrame([(f"http://h{i}.org/p",) for i in range(0, 80, 2)], "url string")
    got = urls.judge_urls(pages, urls.build_list(spark, urls.RULES, listed), urls.RULES).collect()
    assert len(got) == 400 and all((r.verdict == "block") == (r.page_id % 40 % 2 == 0) for r in got)


# the pipeline

def test_stages(spark, docs, no_docs, tmp_path):
    some = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for start in (some, no_docs.select(*some.columns)):
        now = start
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            before, now = now, stage(spark, now, "/nowhere")
            if k < len(corpus_pipeline.STAGES) - 1:
                assert now.columns == before.columns and dict(now.dtypes) == dict(before.dtypes), name
                now.write.parquet(str(tmp_path / f"{start is some}{k}"))
                now = spark.read.parquet(str(tmp_path / f"{start is some}{k}"))
        assert (now.count() > 0) == (start is some)


def test_redaction_takes_effect_and_languages_are_dropped(spark, docs):
    some = docs.select("doc_id", "text", "lang", "source", "n_chars")
    known = corpus_pipeline.keep_known_language(spark, some, "")
    assert not any(r.doc_id in (3, 4, 5, 12) for r in known.collect())
    clean = {r.doc_id: r for r in corpus_pipeline.redact_personal_data(spark, some.where("doc_id = 13"), "").collect()}
    assert "@" not in clean[13].text and clean[13].n_chars == len(clean[13].text)


def test_run(spark, sf):
    out = QUERIES["pipeline"](spark, sf)
    rows = out.collect()
    assert rows and all(r.n_tokens * 4 == len(r.ids) for r in rows)
    ids = [r.doc_id for r in rows]
    assert max(Counter(ids).values()) <= 2
    assert Counter(ids) == Counter(r.doc_id for r in corpus_pipeline.run(spark, sf).collect())


def test_runs_leave_no_stage_behind(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stages, "checkpoint_dir", lambda spark: str(tmp_path))
    add = lambda n: lambda spark, docs, sf: docs.withColumn("x", F.col("x") + n)
    out = stages.run_stages(spark, spark.createDataFrame([(1,)], "x int"), "", [("a", add(1)), ("b", add(2)), ("c", add(3))])
    assert out.collect()[0].x == 7
    assert [p.name for p in tmp_path.glob("*/*")] == ["1-b"]


def test_a_key_of_many_addresses_is_probed_once(spark, monkeypatch):
    monkeypatch.setattr(urls, "SEGMENT_ENTRIES", 4)
    monkeypatch.setattr(urls, "GROUP_PROBES", 50)
    rows = [(i, f"http://a{i}.net/p/{i}") for i in range(300)] + [(1000 + i, f"http://b{i}.org/{'fr/' if i % 2 else 'x/'}{i}") for i in range(40)]
    pages = spark.createDataFrame(rows + [(2000, None), (2001, "http://b4.org/x/4")], "page_id long, url string")
    listed = spark.createDataFrame([(u,) for i, u in rows if i >= 1000 and i % 5 == 0], "url string")
    host, path = urls.url_parts(F.col("url"))
    probes = urls.probes_of(pages.where("url IS NOT NULL").withColumns({"host": host, "path": path}), list(urls.RULES))
    assert probes.where("key = 'r:net/'").count() == 1 and probes.count() == probes.distinct().count()
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge_urls(pages, urls.build_list(spark, urls.RULES, listed), urls.RULES).collect()}
    assert len(got) == len(rows) + 2 and got[2000] == (None, "allow") and got[2001] == (None, "allow")
    for i, u in rows:
        if i < 1000:
            assert got[i] == ("net/", "block")
        elif i % 2:
            assert got[i] == ("org/fr/", "allow")
        else:
            assert got[i] == (None, "block" if i % 5 == 0 else "allow")
