"""Nearest neighbours by a navigable small-world graph per shard.

Distinct vectors are dealt to shards of bounded size.  A shard's graph has
layers; nodes are numbered so that those of a layer are a prefix, and a layer
is one flat array of neighbour numbers, a row per node.  Nodes are inserted,
and queries searched, many at a time: each keeps a beam, and all beams step
together.  For the largest inner product the vectors of a shard get one more
component that makes their lengths equal, so that near in product is near in
space.  Shard results are scored exactly, in double precision, and merged.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from palisade.llm.common import cut
from palisade.llm.embed_dedup import usable

SHARD_ROWS = 8192
#: Queries that meet a shard in one group.
BLOCK_QUERIES = 8192
LINKS = 16
BUILD_BEAM, SEARCH_BEAM = 96, 160
TOGETHER = 512
EXPAND = 4
MAX_BANDS = 1_000


def search_layer(x: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Best ``beam`` nodes (and products) found for each query, best first; -1 fills up."""
    n = len(queries)
    beam = max(beam, entry.shape[1])
    seen = np.zeros((n, len(links)), bool)
    row = np.arange(n)[:, None]
    valid = entry >= 0
    seen[np.broadcast_to(row, entry.shape)[valid], entry[valid]] = True
    product = np.where(valid, np.einsum("nd,nkd->nk", queries, x[entry]), -np.inf)
    ids = np.full((n, beam), -1, np.int32)
    best = np.full((n, beam), -np.inf, np.float32)
    order = np.argsort(-product, axis=1, kind="stable")
    ids[:, :entry.shape[1]] = np.take_along_axis(entry, order, 1)
    best[:, :entry.shape[1]] = np.take_along_axis(product, order, 1)
    done = ids < 0
    live = np.arange(n)
    while len(live):
        pick = np.argsort(done[live], axis=1, kind="stable")[:, :EXPAND]
        fresh = ~np.take_along_axis(done[live], pick, 1)
        some = fresh[:, 0]
        live, pick, fresh = live[some], pick[some], fresh[some]
        if not len(live):
            break
        at = live[:, None]
        nodes = np.where(fresh, ids[at, pick], -1)
        done[at, pick] = True
        near = links[nodes]
        near[nodes < 0] = -1
        for e in range(near.shape[1]):
            step = near[:, e]
            new = step >= 0
            new &= ~seen[at, step]
            r, c = np.nonzero(new)
            seen[live[r], step[r, c]] = True
            step[~new] = -1
        near = near.reshape(len(live), -1)
        r, c = np.nonzero(near >= 0)
        found = np.full(near.shape, -np.inf, np.float32)
        found[r, c] = np.einsum("ij,ij->i", queries[live[r]], x[near[r, c]])
        all_best = np.concatenate([best[live], found], axis=1)
        order = np.argsort(-all_best, axis=1, kind="stable")[:, :beam]
        best[live] = np.take_along_axis(all_best, order, 1)
        ids[live] = np.take_along_axis(np.concatenate([ids[live], near], axis=1), order, 1)
        done[live] = np.take_along_axis(np.concatenate([done[live], near < 0], axis=1), order, 1) | (ids[live] < 0)
    return ids, best


def choose_links(x: np.ndarray, near: np.ndarray, product: np.ndarray, most: int) -> np.ndarray:
    """At most ``most`` of each row's candidates (best first, -1: none): those nearer to the node than to a chosen one, then the best others."""
    count = near.shape[1]
    vectors = x[near]
    between = vectors @ vectors.transpose(0, 2, 1)
    chosen = np.zeros(near.shape, bool)
    for j in range(count):
        crowded = (between[:, j, :j] > product[:, j, None]) & chosen[:, :j]
        chosen[:, j] = (near[:, j] >= 0) & ~crowded.any(axis=1)
    rank = np.where(near < 0, 2 * count, np.where(chosen, 0, count) + np.arange(count))
    order = np.argsort(rank, axis=1, kind="stable")[:, :most]
    out = np.take_along_axis(near, order, 1)
    if count < most:
        out = np.pad(out, ((0, 0), (0, most - count)), constant_values=-1)
    return out.astype(np.int32)


def _best_of(ids: np.ndarray, product: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(-product, axis=1, kind="stable")[:, :keep]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(product, order, 1)


def _link_back(x: np.ndarray, links: np.ndarray, new: np.ndarray, first: int) -> None:
    """Add the reverse of new links; a full list is chosen anew."""
    most = links.shape[1]
    r, c = np.nonzero(new >= 0)
    target, source = new[r, c], (r + first).astype(np.int32)
    mutual = (links[target] == source[:, None]).any(axis=1)
    target, source = target[~mutual], source[~mutual]
    if not len(target):
        return
    product = np.einsum("ij,ij->i", x[target], x[source])
    order = np.lexsort((-product, target))
    target, source = target[order], source[order]
    nodes, begin = np.unique(target, return_index=True)
    place = np.arange(len(target)) - np.repeat(begin, np.diff(np.append(begin, len(target))))
    inside = place < most
    more = np.full((len(nodes), most), -1, np.int32)
    more[np.searchsorted(nodes, target[inside]), place[inside]] = source[inside]
    for lo in range(0, len(nodes), TOGETHER):
        own = nodes[lo:lo + TOGETHER]
        both = np.concatenate([links[own], more[lo:lo + TOGETHER]], axis=1)
        product = np.where(both >= 0, np.einsum("nd,nkd->nk", x[own], x[both]), -np.inf)
        both, product = _best_of(both, product, both.shape[1])
        wide = int((both >= 0).sum(axis=1).max())
        links[own] = choose_links(x, both[:, :wide], product[:, :wide], most)


def build_graph(x: np.ndarray, links: int = LINKS, beam: int = BUILD_BEAM, seed: int = 5) -> tuple[np.ndarray, list[np.ndarray]]:
    """(order, layers): the numbering of the rows of ``x`` (of equal length) and a neighbour array per layer, the lowest first."""
    n = len(x)
    rng = np.random.default_rng([seed, n])
    level = (-np.log(1 - rng.random(n)) / np.log(links)).astype(int)
    order = np.argsort(-level, kind="stable")
    x, level = x[order], level[order]
    sizes = [int((level >= k).sum()) for k in range(level[0] + 1)]
    layers = [np.full((size, 2 * links if k == 0 else links), -1, np.int32) for k, size in enumerate(sizes)]
    start, end = 0, min(n, 128)
    while start < n:
        rows = np.arange(start, end)
        entry = np.zeros((len(rows), 1), np.int32)
        for k in range(len(layers) - 1, -1, -1):
            there, inside = min(start, sizes[k]), max(0, min(end, sizes[k]) - start)
            found, product = np.full((len(rows), 1), -1, np.int32), np.full((len(rows), 1), -np.inf, np.float32)
            if there:
                wide = beam if inside else 8
                found, product = search_layer(x, layers[k][:there], x[rows], entry, wide)
                entry = found[:, :8]
            if inside:
                own = x[rows[:inside]] @ x[rows[:inside]].T
                np.fill_diagonal(own, -np.inf)
                mates, near = _best_of(np.broadcast_to(rows[:inside].astype(np.int32), own.shape), own, 2 * links)
                mates = np.where(np.isneginf(near), -1, mates)
                ids, best = _best_of(np.concatenate([found[:inside], mates], axis=1), np.concatenate([product[:inside], near], axis=1), 4 * links)
                chosen = choose_links(x, ids, best, links)
                layers[k][start:start + inside, :links] = chosen
                _link_back(x, layers[k], chosen, start)
        start, end = end, min(n, end + min(TOGETHER, end))
    return order, layers


def search_graph(x: np.ndarray, layers: list[np.ndarray], queries: np.ndarray, beam: int = SEARCH_BEAM) -> np.ndarray:
    """Numbers of the nodes found for each query, best first; -1 fills up."""
    out = []
    for lo in range(0, len(queries), TOGETHER):
        some = queries[lo:lo + TOGETHER]
        entry = np.zeros((len(some), 1), np.int32)
        for layer in layers[:0:-1]:
            entry = search_layer(x, layer, some, entry, 8)[0]
        out.append(search_layer(x, layers[0], some, entry, beam)[0])
    return np.concatenate(out)


def level_lengths(vectors: np.ndarray) -> tuple[np.ndarray, float]:
    """Vectors divided by the greatest length, with a component that makes all lengths one."""
    scale = float(np.sqrt(np.max(np.einsum("ij,ij->i", vectors / np.abs(vectors).max(), vectors / np.abs(vectors).max()))) * np.abs(vectors).max())
    short = vectors / scale
    rest = np.sqrt(np.maximum(0, 1 - np.einsum("ij,ij->i", short, short)))
    return np.column_stack([short, rest]).astype(np.float32), scale


def _build(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("first")
    vectors = np.stack(rows.embedding.to_numpy()).astype(np.float64)
    order, layers = build_graph(level_lengths(vectors)[0])
    rows, vectors = rows.iloc[order], vectors[order]
    ids = [np.asarray(i, np.int64) for i in rows.ids]
    return pd.DataFrame({
        "dim": [rows.dim.iloc[0]], "band": [rows.band.iloc[0]], "shard": [rows.shard.iloc[0]], "n": [len(rows)], "vectors": [vectors.tobytes()],
        "ids": [np.concatenate(ids).tobytes()], "many": [np.array([len(i) for i in ids], np.int64).tobytes()],
        "widths": [[layer.shape[1] for layer in layers]], "layers": [[layer.tobytes() for layer in layers]]})


INDEX = "dim int, band int, shard int, n long, vectors binary, ids binary, many binary, widths array<int>, layers array<binary>"


def magnitude(vector: str = "embedding") -> Column:
    """The Euclidean length of a vector as a whole power of two, nearest on the logarithmic scale."""
    most = F.array_max(F.transform(vector, F.abs))
    squares = F.aggregate(vector, F.lit(0.0), lambda a, v: a + (v / most) * (v / most))
    return F.floor(F.log2(most) + F.log2(squares) / 2 + 0.5).cast("int")


def build_index(vectors: DataFrame, copies: int, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, dict[int, list[tuple[int, int]]]]:
    """The index (a row per shard), and per number of components the bands with their numbers of shards.

    A band holds vectors of about one length: beside a giant, all others would
    look alike to a graph.  ``vectors`` has ``vec_id, embedding``.  Identical vectors are one node that
    carries their ``copies`` smallest ids; a query that wants fewer neighbours
    than that loses none.  The window is cut short before the shuffle.
    """
    nth = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    nodes = vectors.withColumn("_n", nth).where(F.col("_n") <= copies).groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    nodes = cut(nodes.select("embedding", "ids", F.get("ids", F.lit(0)).alias("first"), F.size("embedding").alias("dim"), magnitude().alias("band")))
    sizes = nodes.groupBy("dim", "band").count().orderBy("dim", "band").limit(MAX_BANDS + 1).collect()
    if len(sizes) > MAX_BANDS:
        raise ValueError(f"vectors of more than {MAX_BANDS} kinds of size and length")
    bands: dict[int, list[tuple[int, int]]] = {}
    shards = F.lit(1)
    for r in sizes:
        many = -(-r["count"] // shard_rows)
        bands.setdefault(r["dim"], []).append((r["band"], many))
        shards = F.when((F.col("dim") == r["dim"]) & (F.col("band") == r["band"]), many).otherwise(shards)
    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("first"), shards).cast("int"))
    return cut(dealt.groupBy("dim", "band", "shard").applyInPandas(_build, INDEX)), bands


def _bands_of(bands: dict[int, list[tuple[int, int]]]) -> Column:
    """The bands that a query of ``dim`` components has to visit, with their numbers of shards."""
    out = F.lit(None).cast("array<struct<band:int,shards:int>>")
    for dim, some in bands.items():
        own = F.array(*[F.struct(F.lit(b).alias("band"), F.lit(n).alias("shards")) for b, n in some])
        out = F.when(F.col("dim") == dim, own).otherwise(out)
    return out


def _search(k: int, beam: int):
    def run(shards: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        if not len(shards) or not len(queries):
            return none
        s = shards.iloc[0]
        vectors = np.frombuffer(s.vectors).reshape(s.n, -1)
        many = np.frombuffer(s.many, np.int64)
        ids, begin = np.frombuffer(s.ids, np.int64), np.cumsum(many) - many
        layers = [np.frombuffer(b, np.int32).reshape(-1, w) for b, w in zip(s.layers, s.widths, strict=True)]
        x, _ = level_lengths(vectors)
        wanted = np.stack(queries.embedding.to_numpy()).astype(np.float64)
        unit = wanted / np.abs(wanted).max(axis=1, keepdims=True)
        unit /= np.sqrt(np.einsum("ij,ij->i", unit, unit))[:, None]
        found = search_graph(x, layers, np.column_stack([unit, np.zeros(len(unit))]).astype(np.float32), beam)
        own = queries.query_id.to_numpy()
        parts = []
        for lo in range(0, len(found), 256):
            r, c = np.nonzero(found[lo:lo + 256] >= 0)
            r += lo
            nodes = found[r, c]
            score = np.einsum("ij,ij->i", wanted[r], vectors[nodes])
            times = many[nodes]
            r, score = np.repeat(r, times), np.repeat(score, times)
            offset = np.arange(len(r)) - np.repeat(np.cumsum(times) - times, times)
            of = ids[np.repeat(begin[nodes], times) + offset]
            other = of != own[r]
            r, score, of = r[other], score[other], of[other]
            order = np.lexsort((of, -score, r))
            r, score, of = r[order], score[order], of[order]
            start = np.searchsorted(r, r, "left")
            keep = np.arange(len(r)) - start < k
            parts.append(pd.DataFrame({"query_id": own[r[keep]], "vec_id": of[keep], "score": score[keep]}))
        return pd.concat(parts) if parts else none
    return run


def nearest(vectors: DataFrame, queries: Column, k: int = 20, beam: int = SEARCH_BEAM, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` vectors with the largest inner product found for each query row.

    ``vectors`` has ``vec_id, embedding``; other columns are ignored.  Every
    row may be found, but a query's own.  Ranks start at 1, ties go to the
    smaller id.  Vectors that are null, empty, zero or hold null or non-finite
    components, and rows without an id, take no part; vectors of another length
    than the query's are not candidates.  Of rows with equal ids one counts,
    that with the smallest vector.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), queries.alias("asks"))
    rows = rows.where(usable() & F.col("vec_id").isNotNull())
    rows = cut(rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"), F.max("asks").alias("asks")))
    index, bands = build_index(rows.select("vec_id", "embedding"), k + 1, shard_rows)
    asked = rows.where("asks").select(F.col("vec_id").alias("query_id"), "embedding", F.size("embedding").alias("dim"))
    blocks = max(1, -(-asked.count() // BLOCK_QUERIES))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).select("*", F.inline(_bands_of(bands)))
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    shards = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    key = ["dim", "band", "shard", "block"]
    found = shards.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(_search(k, beam), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
