"""A training corpus from raw documents: five stages, each one operator on all that its predecessor kept.

The driver of a run hands ``documents`` to the first stage, writes its result
as Parquet and gives it, read again, to the next.  All stages but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from palisade.llm.bpe import bpe_encode, share_vocabulary
from palisade.llm.langid import fit_dictionaries, identify_language, training_rows
from palisade.llm.mixing import mix_documents
from palisade.llm.pii import find_pii, redact
from palisade.llm.queries import default_vocabulary
from palisade.llm.simhash import simhash_dedup
from palisade.llm.stages import run_stages


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language the compression classifier rejects: no letters, or a narrow margin."""
    named = identify_language(docs, fit_dictionaries(docs.where(training_rows(docs))))
    return named.where(~F.col("rejected")).select(*docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document of every group of SimHash fingerprints (three words) linked at three or fewer differing bits."""
    return simhash_dedup(docs).select(*docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in every text; ``n_chars`` follows the new text."""
    clean = redact(find_pii(docs))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        clean = clean.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(kind))
    return clean.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out whole documents so that each source has its target of words."""
    return mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text beside its id and source."""
    vocabulary = share_vocabulary(spark, default_vocabulary())
    coded = bpe_encode(docs, vocabulary, keep=["doc_id", "source"])
    return coded.select("doc_id", "source", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", keep_known_language),
    ("simhash_dedup", keep_one_of_near_copies),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: The stages fit models, walk graphs and draw from seeded permutations, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, with Parquet between them in the folder that executors share."""
    return run_stages(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir, STAGES)
