"""Byte-level BPE with a given vocabulary: encoding and decoding.

A short word is a contiguous array of part ids with the ranks of adjacent
parts beside it.  The lowest rank is found by scanning, its boundary deleted,
the two neighbouring ranks looked up again, until no pair has a rank.  Words of
a batch go through these steps together, a row of a matrix each.  A word too
long for scanning again and again keeps its ranks in a heap instead; the
merges are the same ones in the same order.

Between words separated by single spaces the pre-tokenizer always cuts, so a
text is looked up space by space in a bounded cache of whole pieces.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Pre-tokenizer of the byte-level format (a fixed value); white space is Unicode's.
WORDS = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
         r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
#: Bytes of the longest word that is scanned; pieces kept in a worker's cache.
SCANNED_BYTES = 48
CACHED = 150_000
NO_RANK = np.int32(2**31 - 1)
#: Spaces that do not stand alone between two other characters.
LOOSE_SPACE = re.compile(r"\A | \Z|\s | \s")


def byte_symbols() -> dict[str, int]:
    """The character that stands for each byte in the vocabulary file: printable ones for themselves, the rest from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_vocabulary(path: str) -> dict:
    """Plain tables from a tokenizer file: byte ids, sorted pair keys with ranks and merged ids, token bytes, special tokens."""
    with open(path, encoding="utf-8") as f:
        raw = json.load(f)
    vocab, of = raw["model"]["vocab"], byte_symbols()
    special = {t["content"]: t["id"] for t in raw.get("added_tokens", []) if t.get("special")}
    size = max([*vocab.values(), *special.values()]) + 1
    tokens = [b""] * size
    for text, i in vocab.items():
        tokens[i] = bytes(of[c] for c in text) if all(c in of for c in text) else text.encode()
    for text, i in special.items():
        tokens[i] = text.encode()
    pairs = [m if isinstance(m, list) else m.split(" ") for m in raw["model"]["merges"]]
    keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
    merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
    order = np.argsort(keys, kind="stable")
    single = np.zeros(256, np.int64)
    for c, b in of.items():
        single[b] = vocab[c]
    return {"single": single, "keys": keys[order], "ranks": order.astype(np.int32), "merged": merged[order],
            "tokens": tokens, "special": special}


def _look_up(vocab: dict, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Place of each pair in the table, -1 where it has no rank."""
    wanted = left << 32 | right
    at = np.minimum(np.searchsorted(vocab["keys"], wanted), len(vocab["keys"]) - 1)
    return np.where(vocab["keys"][at] == wanted, at, -1)


def _ranks(vocab: dict, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    at = _look_up(vocab, left, right)
    return np.where(at < 0, NO_RANK, vocab["ranks"][at])


def merge_short(vocab: dict, words: list[bytes]) -> list[bytes]:
    """Packed ids of words of equal length class, one matrix row per word."""
    sizes = np.array([len(w) for w in words])
    wide = int(sizes.max())
    raw = np.frombuffer(b"".join(w.ljust(wide, b"\0") for w in words), np.uint8).reshape(len(words), wide)
    ids = vocab["single"][raw]
    ids[np.arange(wide)[None, :] >= sizes[:, None]] = -1
    ranks = np.full((len(words), wide), NO_RANK, np.int32)
    if wide > 1:
        there = ids[:, 1:] >= 0
        ranks[:, :-1][there] = _ranks(vocab, ids[:, :-1][there], ids[:, 1:][there])
    open_rows = np.arange(len(words))
    columns = np.arange(wide)
    while len(open_rows):
        part = ranks[open_rows]
        at = part.argmin(axis=1)
        live = part[np.arange(len(at)), at] != NO_RANK
        open_rows, at, part = open_rows[live], at[live], part[live]
        if not len(open_rows):
            break
        row, some = np.arange(len(at)), ids[open_rows]
        new = vocab["merged"][_look_up(vocab, some[row, at], some[row, at + 1])]
        source = np.minimum(columns + (columns > at[:, None]), wide - 1)  # the boundary after the pair's first part goes
        some = np.take_along_axis(some, source, 1)
        some[:, -1] = -1
        some[row, at] = new
        source = np.minimum(columns + (columns >= at[:, None]), wide - 1)
        part = np.take_along_axis(part, source, 1)
        part[:, -1] = NO_RANK
        left = row[at > 0]
        part[left, at[left] - 1] = _ranks(vocab, some[left, at[left] - 1], new[left])
        follows = np.where(at + 1 < wide, some[row, np.minimum(at + 1, wide - 1)], -1)
        part[row, at] = np.where(follows >= 0, _ranks(vocab, new, follows), NO_RANK)
        ids[open_rows], ranks[open_rows] = some, part
    packed = ids.astype("<u4")
    many = (ids >= 0).sum(axis=1)
    return [packed[i, :n].tobytes() for i, n in enumerate(many.tolist())]


def merge_long(vocab: dict, word: bytes) -> bytes:
    """Packed ids of one long word: the same merges, the lowest rank kept by a heap."""
    if "pairs" not in vocab:
        vocab["pairs"] = {k: (r, m) for k, r, m in zip(vocab["keys"].tolist(), vocab["ranks"].tolist(), vocab["merged"].tolist(), strict=True)}
    pairs = vocab["pairs"]
    ids = vocab["single"][np.frombuffer(word, np.uint8)].tolist()
    after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
    after[-1] = -1
    heap = [(pairs[k][0], i, k) for i in range(len(ids) - 1) if (k := ids[i] << 32 | ids[i + 1]) in pairs]
    heapq.heapify(heap)
    while heap:
        _, i, key = heapq.heappop(heap)
        j = after[i]
        if ids[i] < 0 or j < 0 or ids[i] << 32 | ids[j] != key:
            continue
        ids[i], ids[j] = pairs[key][1], -1
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b >= 0 and (k := ids[a] << 32 | ids[b]) in pairs:
                heapq.heappush(heap, (pairs[k][0], a, k))
    return np.array([i for i in ids if i >= 0], "<u4").tobytes()


def merge_words(vocab: dict, words: list[str]) -> dict[str, bytes]:
    """Packed ids of distinct words."""
    coded = [(w, w.encode("utf-8", "surrogatepass")) for w in words]
    out = {}
    for low, high in ((0, 8), (8, 16), (16, SCANNED_BYTES)):
        some = [(w, b) for w, b in coded if low < len(b) <= high]
        for start in range(0, len(some), 8192):
            block = some[start:start + 8192]
            out |= zip((w for w, _ in block), merge_short(vocab, [b for _, b in block]), strict=True)
    out |= {w: merge_long(vocab, b) for w, b in coded if len(b) > SCANNED_BYTES}
    return out


def _segments(vocab: dict, text: str) -> list[tuple[str, bool]]:
    """The text cut at special tokens: (piece, is special)."""
    if not any(s in text for s in vocab["special"]):
        return [(text, False)]
    cutter = re.compile("(" + "|".join(sorted(map(re.escape, vocab["special"]), key=len, reverse=True)) + ")")
    return [(p, bool(i % 2)) for i, p in enumerate(cutter.split(text)) if p]


def encode_texts(vocab: dict, texts: list[str | None]) -> list[bytes]:
    """Little-endian unsigned 32-bit ids of each text; a null is an empty text."""
    split = vocab.setdefault("split", regex.compile(WORDS).findall)
    pieces, words = vocab.setdefault("pieces", {}), vocab.setdefault("words", {})
    if len(pieces) > CACHED:
        pieces.clear()
    if len(words) > CACHED:
        words.clear()
    plans: list[list] = []
    wanted: set[str] = set()
    loose: dict[str, list[str]] = {}
    for text in texts:
        plan: list = []
        for part, special in _segments(vocab, text or ""):
            if special:
                plan.append(vocab["special"][part].to_bytes(4, "little"))
            elif part and LOOSE_SPACE.search(part):
                plan.append((None, split(part)))
            elif part:
                first, *rest = part.split(" ")
                plan.append((split(first), rest))
                wanted.update(rest)
        plans.append(plan)
    fresh = [p for p in wanted if p not in pieces]
    for p in fresh:
        loose[p] = split(" " + p)
    need = {w for ws in loose.values() for w in ws}
    for plan in plans:
        for step in plan:
            if isinstance(step, tuple):
                need.update(step[1] if step[0] is None else step[0])
    got = {w: words[w] for w in need if w in words}
    new = merge_words(vocab, [w for w in need if w not in got])
    words |= new
    got |= new
    pieces |= {p: b"".join(got[w] for w in ws) for p, ws in loose.items()}
    out = []
    for plan in plans:
        done = []
        for step in plan:
            if not isinstance(step, tuple):
                done.append(step)
            elif step[0] is None:
                done.append(b"".join(map(got.__getitem__, step[1])))
            else:
                done.append(b"".join(map(got.__getitem__, step[0])))
                done.append(b"".join(map(pieces.__getitem__, step[1])))
        out.append(b"".join(done))
    return out


def decode_ids(vocab: dict, ids: bytes) -> str:
    """The text of packed ids; special tokens come out as their text."""
    tokens = vocab["tokens"]
    return b"".join(map(tokens.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def _bytes(column: pa.Array) -> list[int]:
    return pc.fill_null(pc.binary_length(column), 0).to_pylist()


def _blocks(sizes: list[int], most: int = 4_000_000) -> Iterator[slice]:
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield slice(start, len(sizes))


def share_vocabulary(spark: SparkSession, path: str):
    """Broadcast the tables of a vocabulary file (a few MB, whatever the data).

    A worker keeps the broadcast value between tasks, and with it the bounded
    caches that encoding adds to it.
    """
    return spark.sparkContext.broadcast(load_vocabulary(path))


def bpe_encode(docs: DataFrame, vocabulary, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (default: all) with ``n_tokens`` (long) and ``ids`` (packed little-endian unsigned 32-bit).

    Equal to what the format's own encoder gives without added special tokens;
    a special token's text in a document is that token.  A null text has no
    tokens.  Columns named ``n_tokens`` or ``ids`` are replaced.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("n_tokens", "ids")]
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary.value
        for batch in batches:
            for some in _blocks(_bytes(batch.column("__text"))):
                part = batch.slice(some.start, some.stop - some.start)
                coded = encode_texts(vocab, part.column("__text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in keep), pa.array([len(b) // 4 for b in coded], pa.int64()), pa.array(coded, pa.binary())],
                    [*keep, "n_tokens", "ids"])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(run, ", ".join(filter(None, [kinds, "n_tokens long, ids binary"])))


def bpe_decode(coded: DataFrame, vocabulary, ids: str = "ids") -> DataFrame:
    """All columns with ``decoded`` (string) added; null ids give null."""
    keep = [c for c in coded.columns if c != "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary.value
        for batch in batches:
            for some in _blocks(_bytes(batch.column(ids))):
                part = batch.slice(some.start, some.stop - some.start)
                texts = [None if b is None else decode_ids(vocab, b) for b in part.column(ids).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(texts, pa.string())], [*keep, "decoded"])

    kinds = ", ".join(f"`{c}` {coded.schema[c].dataType.simpleString()}" for c in keep)
    return coded.select(*[F.col(f"`{c}`") for c in keep]).mapInArrow(run, f"{kinds}, decoded string")
