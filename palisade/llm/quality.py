"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages.  Every passage is encoded from its form:
shares of kinds of bytes, word lengths, repeated words.  Gated attention
weighs the passages, the weighted sum of their codes gives the score, and
weights and codes are learnt together from labels of whole documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from palisade.llm.common import small_batches

PASSAGE_WORDS = 48
#: Labelled documents that the model is fitted on at most: those with the smallest hashed ids.
SAMPLE_DOCS = 5_000
HIDDEN, GATE = 16, 8
ROUNDS, RATE = 300, 0.02
BLOCK_BYTES = 2_000_000
#: Kinds of bytes; 0 is white space, 1 new lines.
KINDS = (b" \t\v\f\r", b"\n", bytes(range(97, 123)), bytes(range(65, 91)), b"0123456789", b".", b",", b"!?", b"|", b"\"'()[]{}:;-", bytes(range(128, 256)))
N_KINDS = len(KINDS) + 1
N_FEATURES = N_KINDS + 8


def _kind_table() -> np.ndarray:
    table = np.full(256, N_KINDS - 1, np.uint8)
    for i, kind in enumerate(KINDS):
        table[list(kind)] = i
    return table


def _distinct(groups: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Distinct values per group."""
    with np.errstate(over="ignore"):
        mixed = values ^ (groups.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    _, first = np.unique(mixed, return_index=True)
    return np.bincount(groups[first], minlength=n)


def encode_passages(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage of the texts, and the text of each passage.  A text without words is one passage."""
    raw = [(t or "").encode("utf-8", "surrogatepass") + b"\n" for t in texts]
    flat = np.frombuffer(b"".join(raw), np.uint8)
    sizes = np.array([len(r) for r in raw])
    begins = np.cumsum(sizes) - sizes
    kinds = _kind_table()[flat]
    inside = kinds > 1
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    at = np.flatnonzero(starts)
    text_of = np.searchsorted(begins, at, "right") - 1
    words = np.bincount(text_of, minlength=len(raw))
    nth = np.arange(len(at)) - np.repeat(np.cumsum(words) - words, words)
    passages = np.maximum(1, -(-words // PASSAGE_WORDS))
    base = np.cumsum(passages) - passages
    n = int(passages.sum())
    word_passage = base[text_of] + nth // PASSAGE_WORDS
    # a passage begins with its first word, the first one with the text
    edges = np.zeros(n, np.int64)
    edges[base] = begins
    later = (nth > 0) & (nth % PASSAGE_WORDS == 0)
    edges[word_passage[later]] = at[later]
    lengths = np.diff(np.append(edges, len(flat)))
    owner = np.repeat(np.arange(n), lengths)
    shares = np.bincount(owner * N_KINDS + kinds, minlength=n * N_KINDS).reshape(n, N_KINDS) / lengths[:, None]
    out = np.zeros((n, N_FEATURES), np.float32)
    out[:, :N_KINDS] = shares
    many = np.bincount(word_passage, minlength=n)
    some = np.maximum(many, 1)
    if len(at):
        place = np.arange(len(flat)) - at[np.maximum(np.cumsum(starts) - 1, 0)]
        mult = np.random.default_rng(3).integers(1, 1 << 62, 4096, dtype=np.uint64) | np.uint64(1)
        with np.errstate(over="ignore"):
            terms = np.where(inside, (flat.astype(np.uint64) | np.uint64(32)) * mult[place & 4095], np.uint64(0))
            hashes = np.add.reduceat(terms, at)
        size = np.add.reduceat(inside.astype(np.int64), at)
        first = kinds[at]
        out[:, N_KINDS] = np.bincount(word_passage, size, n) / some / 10
        out[:, N_KINDS + 1] = (many - _distinct(word_passage, hashes, n)) / some
        doc_words = np.maximum(words, 1)
        out[:, N_KINDS + 2] = ((words - _distinct(text_of, hashes, len(raw))) / doc_words)[np.repeat(np.arange(len(raw)), passages)]
        same = np.zeros(len(at), bool)
        same[1:] = (hashes[1:] == hashes[:-1]) & (text_of[1:] == text_of[:-1])
        out[:, N_KINDS + 3] = np.bincount(word_passage, same, n) / some
        out[:, N_KINDS + 4] = np.bincount(word_passage, size <= 2, n) / some
        out[:, N_KINDS + 5] = np.bincount(word_passage, first == 3, n) / some
        out[:, N_KINDS + 6] = np.bincount(word_passage, size > 20, n) / some
    out[:, N_KINDS + 7] = np.log1p(many) / 4
    return out, np.repeat(np.arange(len(raw)), passages)


@dataclass
class Attention:
    """Weights of the model; ``forward`` gives a score per bag."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, bags: np.ndarray) -> dict[str, np.ndarray]:
        """``bags`` begins each bag; all steps that training needs are returned."""
        w = self.weights
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        code = np.tanh(x @ w["W"] + w["b"])
        value, gate = np.tanh(code @ w["V"]), 1 / (1 + np.exp(-(code @ w["U"])))
        raw = (value * gate) @ w["a"]
        of = np.repeat(np.arange(len(bags)), np.diff(np.append(bags, len(x))))
        weight = np.exp(raw - np.maximum.reduceat(raw, bags)[of])
        weight /= np.add.reduceat(weight, bags)[of]
        pooled = np.add.reduceat(code * weight[:, None], bags, axis=0)
        score = 1 / (1 + np.exp(-(pooled @ w["c"] + w["d"][0])))
        return {"x": x, "code": code, "value": value, "gate": gate, "of": of, "weight": weight, "pooled": pooled, "score": score}

    def gradients(self, s: dict[str, np.ndarray], bags: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        w, out = self.weights, {}
        error = (s["score"] - labels) / len(labels)
        out["c"], out["d"] = s["pooled"].T @ error, np.array([error.sum()])
        pooled = error[:, None] * w["c"]
        per = pooled[s["of"]]
        attention = (s["code"] * per).sum(axis=1)
        centre = np.add.reduceat(attention * s["weight"], bags)[s["of"]]
        raw = s["weight"] * (attention - centre)
        out["a"] = (s["value"] * s["gate"]).T @ raw
        value = raw[:, None] * w["a"] * s["gate"] * (1 - s["value"] ** 2)
        gate = raw[:, None] * w["a"] * s["value"] * s["gate"] * (1 - s["gate"])
        out["V"], out["U"] = s["code"].T @ value, s["code"].T @ gate
        code = (per * s["weight"][:, None] + value @ w["V"].T + gate @ w["U"].T) * (1 - s["code"] ** 2)
        out["W"], out["b"] = s["x"].T @ code, code.sum(axis=0)
        return out


def fit_attention(x: np.ndarray, bags: np.ndarray, labels: np.ndarray, rounds: int = ROUNDS, seed: int = 1) -> Attention:
    """Fit by Adam over the whole sample.  With no bags the score is one half."""
    rng = np.random.default_rng(seed)
    n = x.shape[1]
    weights = {"W": rng.normal(0, n**-0.5, (n, HIDDEN)), "b": np.zeros(HIDDEN), "V": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)),
               "U": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), "a": np.zeros(GATE), "c": np.zeros(HIDDEN), "d": np.zeros(1)}
    if not len(labels):
        return Attention(np.zeros(n), np.ones(n), weights)
    model = Attention(x.mean(axis=0).astype(np.float64), x.std(axis=0).astype(np.float64) + 0.01, weights)
    weights["c"] = rng.normal(0, HIDDEN**-0.5, HIDDEN)
    weights["a"] = rng.normal(0, GATE**-0.5, GATE)
    first = {k: np.zeros_like(v) for k, v in weights.items()}
    second = {k: np.zeros_like(v) for k, v in weights.items()}
    for t in range(1, rounds + 1):
        grads = model.gradients(model.forward(x, bags), bags, labels)
        for k, g in grads.items():
            g = g + 1e-4 * weights[k]
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            weights[k] -= RATE * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    return model


def training_rows(doc_id: Column, folds: int = 4, held: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds != held, F.lit(False))


def _blocks(texts: list[str | None]) -> Iterator[slice]:
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t or "") > BLOCK_BYTES:
            yield slice(start, i)
            start, size = i, 0
        size += len(t or "") + 1
    if start < len(texts):
        yield slice(start, len(texts))


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches):
        texts = batch.column("text").to_pylist()
        for some in _blocks(texts):
            x, of = encode_passages(texts[some])
            bags = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            ends = np.append(bags[1:], len(x))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").slice(some.start, some.stop - some.start), batch.column("label").slice(some.start, some.stop - some.start),
                pa.array([x[a:b].tobytes() for a, b in zip(bags, ends, strict=True)], pa.binary())], ["doc_id", "label", "x"])


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", learn: Column | None = None, sample_docs: int = SAMPLE_DOCS) -> Attention:
    """Fit on the labelled documents with the smallest hashed ids, ``sample_docs`` at most; all their passages count."""
    learn = training_rows(F.col("doc_id")) if learn is None else learn
    known = labels.where(learn & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).cast("int").alias("label"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").mapInArrow(_encode, "doc_id long, label int, x binary")
    found = texts.dropDuplicates(["doc_id"]).toArrow().sort_by("doc_id")
    rows = list(zip(*(found.column(c).to_pylist() for c in ("doc_id", "label", "x")), strict=True))
    bags = [np.frombuffer(r[2], np.float32).reshape(-1, N_FEATURES) for r in rows]
    begins = np.cumsum([len(b) for b in bags]) - [len(b) for b in bags]
    x = np.concatenate(bags) if bags else np.zeros((0, N_FEATURES), np.float32)
    return fit_attention(x, begins, np.array([r[1] for r in rows], np.float64))


def score_quality(docs: DataFrame, model: Attention, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (default: all) with ``score`` (0 to 1) and ``passages``.

    Only the text is looked at, all of it.  A null or empty text is one passage
    without words.  Columns of these names are replaced.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("score", "passages")]
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias("__text"))
    shared = docs.sparkSession.sparkContext.broadcast((model.mean, model.scale, model.weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Attention(*shared.value)
        for batch in small_batches(batches):
            texts = batch.column("__text").to_pylist()
            for some in _blocks(texts):
                x, of = encode_passages(texts[some])
                bags = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
                part = batch.slice(some.start, some.stop - some.start)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in keep), pa.array(own.forward(x, bags)["score"], pa.float64()), pa.array(np.diff(np.append(bags, len(x))), pa.int64())],
                    [*keep, "score", "passages"])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(run, ", ".join(filter(None, [kinds, "score double, passages long"])))
