"""Hard negatives against a plain search."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from palisade.llm import negatives

VECTORS = "vec_id long, embedding array<double>, label int, id string, vec string, block string, grp string, shard string, score string"


def awkward_vectors():
    rng = np.random.default_rng(6)
    rows = [(i, (rng.standard_normal(6) / 2).tolist(), int(rng.integers(3))) for i in range(150)]
    rows += [(200 + i, rows[20][1], i % 2) for i in range(40)]  # equal scores, in both labels
    rows += [(50, rows[50][1], 1), (50, rows[50][1], 1), (51, rows[51][1], 0), (51, rows[51][1], 0)]
    rows += [(300, None, 1), (301, [0.0] * 6, 1), (302, [float("nan")] * 6, 1), (303, [1.0, None] * 3, 1), (304, [float("inf")] * 6, 2),
             (350, rows[3][1], None), (None, rows[4][1], 1), (400, [], 1), (401, [], 1), (402, [], 2), (450, [1.0, 2.0], 1), (451, [2.0, 1.0], 1),
             (452, [1.5, 1.5], 2), (453, [0.5, -0.5], 2), (500, [1e300] * 3, 1), (501, [1e300, 2.0, 1e299], 1), (502, [1e250, -1.0, 4e9], 2),
             (503, [1.7e308, 0.0, 0.0], 2), (550, [3e9, 1.0, 2.0], 1), (551, [1.0, 3e9, 5.0], 1), (552, [1e9, 2e9, 0.0], 2), (-50, rows[7][1], 1), (600, [-1.0], 7), (601, [2.0], 7), (602, [1.0], 8)]
    return [(i, v, n, "x", "x", "x", "x", "x", "x") for i, v, n in rows]


def plain(rows, count=5, top=3, low=50, high=95):
    able = [(i, [math.floor(min(max(256 * x, -1.7976931348623157e308), 1.7976931348623157e308)) for x in v], n) for i, v, n, *_ in rows
            if i is not None and n is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    for a, v, n in able:
        if a % 50:
            continue
        scored = [(-max(-2 ** 63 + 1, min(2 ** 63 - 1, sum(x * y for x, y in zip(v, w)))), i, m) for i, w, m in able if i != a and len(w) == len(v)]
        for p, pid, _ in sorted(s for s in scored if s[2] == n)[:count]:
            fit = sorted(s for s in scored if s[2] != n and low * -p <= 100 * -s[0] <= high * -p)[:top]
            out.update((a, pid, k, nid, -p, -s) for k, (s, nid, _) in enumerate(fit, 1))
    return out


@pytest.mark.parametrize("block, cell, scores", [(1024, 32 << 20, 1 << 20), (7, 1000, 30)])
def test_awkward_rows(spark, monkeypatch, block, cell, scores):
    monkeypatch.setattr(negatives, "BLOCK_ROWS", block)
    monkeypatch.setattr(negatives, "SCORES", scores)
    df = spark.createDataFrame(awkward_vectors(), VECTORS)
    got = negatives.hard_negatives(df, F.col("vec_id") % 50 == 0, cell_bytes=cell)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert Counter(map(tuple, got.collect())) == plain(awkward_vectors())


def test_other_sizes_and_no_rows(spark):
    df = spark.createDataFrame(awkward_vectors(), VECTORS)
    got = negatives.hard_negatives(df, F.col("vec_id") % 50 == 0, positives=9, top=2, low=-100, high=100)
    assert Counter(map(tuple, got.collect())) == plain(awkward_vectors(), 9, 2, -100, 100)
    assert negatives.hard_negatives(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert negatives.hard_negatives(df, F.lit(False)).count() == 0


def test_exact_products():
    a = np.array([[3.0, 2.0 ** 40], [1.0, -2.0], [-negatives.HUGE, negatives.HUGE]])
    whole = [[int(x) for x in r] for r in a]
    want = [[max(-negatives.LIMIT, min(negatives.LIMIT, sum(x * y for x, y in zip(r, s)))) for s in whole] for r in whole]
    assert negatives.inner_products(a, a).tolist() == want
    for score in (-7, 0, 1, 19, 20, 21, 99, 100, 10 ** 17):
        least, most = negatives.window_of(score, 50, 95)
        assert 50 * score <= 100 * least < 50 * score + 100 and 95 * score - 100 < 100 * most <= 95 * score
