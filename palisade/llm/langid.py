"""Language identification by compression.

Every language has a zstandard raw-content dictionary, cut from a bounded
sample of labelled documents.  A text is compressed with each of them; the
language whose dictionary gives the smallest result wins, and a narrow margin
over the second is marked as rejected.  Texts are cut into pieces, because a
long text soon is its own dictionary and would hide the difference.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window, functions as F

from palisade.llm.common import small_batches

#: The sample: documents per language, characters of each (in windows spread over its whole text), and bytes of a dictionary.
SAMPLE_DOCS = 96
SAMPLE_CHARS = 2_000
SAMPLE_WINDOWS = 8
DICTIONARY_BYTES = 64_000
#: More labels than this are no languages.
MAX_LANGUAGES = 200
#: Bytes of a piece that is compressed alone.
PIECE_BYTES = 1_500
#: A text is rejected if the second best is larger by less than this share.
MIN_MARGIN = 0.002
#: Goes before every piece: it compresses alike for all, and keeps the encoder from storing a short piece as it is.
LEAD = b"\0" * 64 + b" "
UNKNOWN = "und"
_NO_LETTERS = re.compile(r"[\W\d_]+")


def letters_of(text: str | None) -> bytes:
    """Lower-case letters with single spaces between runs of them; empty if there is none."""
    plain = _NO_LETTERS.sub(" ", text.lower()).strip() if text else ""
    return plain.encode("utf-8", "surrogatepass") if any(map(str.isalpha, plain)) else b""


def _windows(text: str) -> Column:
    """The whole text, or so many characters of a longer one in windows from its start to its end."""
    size, n = SAMPLE_CHARS // SAMPLE_WINDOWS, F.length(text)
    starts = [F.floor((n - size) * k / (SAMPLE_WINDOWS - 1)).cast("int") + 1 for k in range(SAMPLE_WINDOWS)]
    return F.when(n <= SAMPLE_CHARS, F.array(F.col(text))).otherwise(F.array(*[F.substr(text, at, F.lit(size)) for at in starts]))


def fill(documents: list[list[bytes]], room: int) -> bytes:
    """Equal shares of all documents, taken evenly from their windows; what short ones leave goes to the others."""
    sizes = sorted(sum(map(len, d)) for d in documents)
    share, left = 0, room - sum(map(len, documents))  # a space behind every window
    for k, size in enumerate(sizes):
        share = max(0, left) // (len(sizes) - k)
        if size > share:
            break
        share, left = size, left - size
    return b"".join(w[:len(w) * share // max(1, share, sum(map(len, d)))] + b" " for d in documents for w in d)[:room]


def fit_dictionaries(docs: DataFrame, lang: str = "lang", docs_per_language: int = SAMPLE_DOCS) -> dict[str, bytes]:
    """Dictionary content per language, the most common language first.

    The sample holds the ``docs_per_language`` distinct documents with the
    smallest hashed ids of each language, so it depends on no order of rows,
    and equal shares of each, spread over its whole text.  Rows without an id,
    a language or a text don't count; of rows with equal ids and languages the
    text that sorts first does.  The first pass reads ids and labels only.
    """
    known = docs.where(F.col(lang).isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    sizes = known.groupBy(F.col(lang).alias("lang")).count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"{lang} has more than {MAX_LANGUAGES} values")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = known.select("doc_id", F.col(lang).alias("lang")).distinct().withColumn("n", F.row_number().over(order))
    picked = ids.where(F.col("n") <= docs_per_language).select("doc_id", "lang")
    texts = known.select("doc_id", F.col(lang).alias("lang"), "text").join(F.broadcast(picked), ["doc_id", "lang"], "left_semi").select(
        "doc_id", "lang", _windows("text").alias("t")).groupBy("doc_id", "lang").agg(F.min("t").alias("t"))
    sample: dict[str, list[tuple]] = {r["lang"]: [] for r in sizes}
    for row in texts.collect():  # a row per picked document
        sample[row["lang"]].append((row["doc_id"], [letters_of(w) for w in row["t"]]))
    return {k: fill([w for _, w in sorted(v)], DICTIONARY_BYTES) for k, v in sample.items()}


def compressors(dictionaries: dict[str, bytes]) -> list[zstandard.ZstdCompressor]:
    out = []
    for content in dictionaries.values():
        params = zstandard.ZstdCompressionParameters(
            compression_level=5, window_log=17, chain_log=16, hash_log=16, search_log=4, min_match=4, strategy=zstandard.STRATEGY_LAZY,
            format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0)
        if len(content) < 8:
            out.append(zstandard.ZstdCompressor(compression_params=params))
            continue
        content = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        content.precompute_compress(compression_params=params)
        out.append(zstandard.ZstdCompressor(dict_data=content, compression_params=params))
    return out


def sizes_with(text: bytes, coders: list[zstandard.ZstdCompressor]) -> np.ndarray:
    """Bytes of the whole text under each dictionary, piece by piece (cut at spaces where there are any)."""
    total = np.zeros(len(coders), np.int64)
    start = 0
    while start < len(text):
        end = len(text) if len(text) - start <= PIECE_BYTES else text.rfind(b" ", start + 1, start + PIECE_BYTES)
        end = end if end > start else start + PIECE_BYTES
        piece = LEAD + text[start:end] + b" "
        total += [len(c.compress(piece)) for c in coders]
        start = end
    return total


def decide(sizes: np.ndarray, names: list[str], min_margin: float) -> tuple[str, float, float, bool]:
    """(language, score, margin, rejected).  The score is the share of the best if a byte more halves a language's weight."""
    order = np.argsort(sizes, kind="stable")
    best = sizes[order[0]]
    score = 1 / float(np.exp2(-np.minimum(sizes - best, 1000)).sum())
    margin = float(sizes[order[1]] - best) / max(int(best), 1) if len(sizes) > 1 else 1.0
    return names[order[0]], score, margin, margin < min_margin


def identify_language(docs: DataFrame, dictionaries: dict[str, bytes], min_margin: float = MIN_MARGIN, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (default: all) with ``lang_pred``, ``score`` (0 to 1), ``margin`` and ``rejected``.

    ``und``, score 0 and rejected: no text, no letter in it, or no language
    known.  Only the text is looked at, all of it.  Columns of these names are
    replaced.  Ties go to the language with more labelled documents.
    """
    added = ["lang_pred", "score", "margin", "rejected"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in added]
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias("__text"))
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, coders = list(shared.value), compressors(shared.value)
        for batch in small_batches(batches):
            made = []
            for text in batch.column("__text").to_pylist():
                plain = letters_of(text)
                made.append(decide(sizes_with(plain, coders), names, min_margin) if plain and names else (UNKNOWN, 0.0, 0.0, True))
            lang, score, margin, rejected = zip(*made, strict=True) if made else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(lang, pa.string()), pa.array(score, pa.float64()),
                 pa.array(margin, pa.float64()), pa.array(rejected, pa.bool_())], [*keep, *added])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(run, ", ".join(filter(None, [kinds, "lang_pred string, score double, margin double, rejected boolean"])))


def training_rows(docs: DataFrame, folds: int = 5, held: int = 0) -> Column:
    """True for rows a model may learn from; a missing id counts as held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds != held, F.lit(False))
