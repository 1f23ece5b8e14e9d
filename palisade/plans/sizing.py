"""Matching texts with word lists and rule sets of any length, without all pairs in one key."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window, functions as F

from palisade.functions.text import grams
from palisade.session import truncate_lineage

#: Bytes of words that travel with the tasks at a time, and rules in one projection.
CHUNK_BYTES = 16_000_000
CHUNK_RULES = 64
#: Words of a chunk, and bytes of them, that are looked for one after the other: fewer tests than a text has pieces.
FEW_WORDS, FEW_BYTES = 64, 65_536


def _numbered(df: DataFrame, value: str, room: int, size: Column) -> DataFrame:
    """The distinct, non-null values of ``value`` as ``v``, with chunks whose ``size`` adds up to about ``room``.

    The numbering sorts the list itself, never the texts.
    """
    values = df.select(F.col(value).alias("v")).where("v IS NOT NULL").distinct()
    so_far = F.sum(size).over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, -1))
    return values.withColumn("chunk", F.floor(F.coalesce(so_far, F.lit(0)) / room).cast("long"))


def _chunks(df: DataFrame, value: str, room: int, size: Column) -> Iterator[list]:
    """The values of one chunk after the other; one list at a time is on the driver."""
    numbered = _numbered(df, value, room, size).persist()
    try:
        for row in numbered.select("chunk").distinct().orderBy("chunk").toLocalIterator():
            yield [r["v"] for r in numbered.where(F.col("chunk") == row["chunk"]).select("v").collect()]
    finally:
        numbered.unpersist()


def _anchored(words: DataFrame) -> DataFrame:
    """(chunk, v, size, gram): one piece of every word, the one that the fewest words share, by which texts are searched.

    Pieces have 8 characters, of shorter words 4, and of words below that all.
    """
    n = F.length("v")
    pieces = words.select("chunk", "v", F.when(n >= 8, 8).when(n >= 4, 4).otherwise(n).alias("size"))
    pieces = pieces.select("chunk", "v", "size", F.explode(F.array_distinct(grams(F.col("v"), F.col("size")))).alias("gram"))
    shared = pieces.groupBy("size", "gram").agg(F.count("*").alias("words"))
    return pieces.join(shared, ["size", "gram"]).groupBy("chunk", "v", "size").agg(F.min_by("gram", F.struct("words", "gram")).alias("gram"))


def _is_short(words: DataFrame, word: str, room: int) -> bool:
    """Whether the distinct words are so few, and of so few bytes, that one projection takes them all."""
    n, size = words.select(word).distinct().agg(F.count("*"), F.coalesce(F.sum(F.octet_length(word)), F.lit(0))).first()
    return n <= FEW_WORDS and size <= room


def substring_join(df: DataFrame, text: str, words: DataFrame, word: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Rows whose ``text`` contains a word, once per word, with ``word`` added.

    The few words of a short list are literals that each text is tested for, in
    one pass.  A word of a longer list is looked for by one piece of it: a text's pieces of that size
    meet those of a broadcast chunk of the words by equality, and what meets is
    confirmed.  All of it is one generated loop over the texts per chunk; no
    text is shuffled or copied for a piece that meets nothing.  Empty and null
    words match nothing.
    """
    words = words.where(F.length(word) > 0)
    if _is_short(words, word, min(FEW_BYTES, chunk_bytes)):
        short = sorted(r[0] for r in words.select(word).distinct().collect())
        tried = [F.when(F.contains(F.col(text), F.lit(w)), F.lit(w)) for w in short]
        return df.withColumn(word, F.explode(F.array_compact(F.array(F.lit(None).cast("string"), *tried))))
    wanted = _numbered(words, word, chunk_bytes, F.octet_length("v"))
    anchors = truncate_lineage(_anchored(wanted))
    out = None
    for row in anchors.select("chunk", "size").distinct().orderBy("chunk", "size").collect():
        few = anchors.where((F.col("chunk") == row["chunk"]) & (F.col("size") == row["size"])).select(F.col("gram").alias("_gram"), F.col("v").alias(word))
        each = df.withColumn("_gram", F.explode(F.array_distinct(grams(F.col(text), F.lit(row["size"])))))
        hit = each.join(F.broadcast(few), "_gram").where(F.contains(F.col(text), F.col(word))).drop("_gram")
        out = hit if out is None else out.unionByName(hit)
    return out if out is not None else df.withColumn(word, F.lit(None).cast("string")).where(F.lit(False))


def pattern_join(df: DataFrame, text: str, rules: DataFrame, pattern: str, chunk_rules: int = CHUNK_RULES) -> DataFrame:
    """Rows whose ``text`` matches a rule's regular expression, once per rule, with the rule's columns.

    The distinct patterns of a chunk are literals of one projection, so each is
    compiled once per task and not once per row; rules meet their pattern's
    hits by equality.  Null patterns match nothing.
    """
    out = None
    for chunk in _chunks(rules, pattern, max(1, chunk_rules), F.lit(1)):
        tried = [F.when(F.col(text).rlike(p), F.lit(p)) for p in chunk]
        hit = df.withColumn(pattern, F.explode(F.array_compact(F.array(*tried))))
        out = hit if out is None else out.unionByName(hit)
    if out is None:
        out = df.withColumn(pattern, F.lit(None).cast("string")).where(F.lit(False))
    return out.join(rules, pattern)
