"""The registered queries of this package and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from palisade.llm.ann import nearest
from palisade.llm.bpe import bpe_decode, bpe_encode, share_vocabulary
from palisade.llm.common import table
from palisade.llm.embed_dedup import near_vectors
from palisade.llm.langid import fit_dictionaries, identify_language, training_rows
from palisade.llm.lm import held_out, score_texts
from palisade.llm.mixing import mix_blocks, mixed_sizes
from palisade.llm.negatives import hard_negatives
from palisade.llm.pii import KINDS, find_pii, span_text
from palisade.llm.quality import fit_quality, score_quality, training_rows as quality_rows
from palisade.llm.repair import audit_conversations, damage
from palisade.llm.simhash import simhash_groups
from palisade.llm.urls import RULES, build_list, judge_urls, oracle_sql as url_sql, toxic_addresses
from palisade.llm.warc import read_archive, write_archive
from palisade.session import scratch_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def default_vocabulary() -> str:
    """The vocabulary file that the queries and the pipeline use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op1_pii")
def op1(spark, sf_dir):
    found = find_pii(table(spark, sf_dir, "documents"))
    def many(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(many, KINDS), F.sha2(span_text(F.col("base")), 256).alias("base_sha256"),
                        span_text(F.concat("base", "added")).alias("spans"))


@query("op2_ann")
def op2(spark, sf_dir):
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op3_suffix_tree")
def op3(spark, sf_dir):
    scored = score_texts(table(spark, sf_dir, "documents"))
    return scored.withColumn("held_out", held_out(F.col("doc_id")))


@query("op4_quality")
def op4(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    scored = score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])
    return scored.select("doc_id", (~quality_rows(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query("op5_mixing")
def op5(spark, sf_dir):
    rows, blocks = mix_blocks(table(spark, sf_dir, "documents"))
    return mixed_sizes(rows, blocks).select(
        "doc_id", "size", "source_size", "target", "taken", "draws", "first_shard", "last_shard", "first_position")


@query("op6_url_filter", url_sql())
def op6(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    entries = build_list(spark, RULES, toxic_addresses(pages, table(spark, sf_dir, "labels")))
    return judge_urls(pages, entries, RULES).select("page_id", "host", "path", "rule", "verdict")


@query("op7_bpe")
def op7(spark, sf_dir):
    vocabulary = share_vocabulary(spark, default_vocabulary())
    coded = bpe_encode(table(spark, sf_dir, "documents"), vocabulary, keep=["doc_id"])
    return bpe_decode(coded, vocabulary).select(
        "doc_id", "n_tokens", F.sha2(F.col("ids"), 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


@query("op8_language_id")
def op8(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    named = identify_language(docs, fit_dictionaries(docs.where(training_rows(docs))), keep=["doc_id"])
    return named.select("doc_id", (~training_rows(named)).alias("held_out"), "lang_pred", "score", "margin", "rejected")


@query("op9_simhash_dedup")
def op9(spark, sf_dir):
    groups = simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


_NEAR = """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
   able AS (SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
   links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM able a JOIN able b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
   reach(n, r) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.n, links.b FROM reach JOIN links ON reach.r = links.a),
   comp AS (SELECT n, min(r) AS component_id FROM reach GROUP BY n)
   SELECT v.vec_id, (SELECT count(*) FROM links WHERE a = v.vec_id) AS n_links, component_id, v.vec_id = component_id AS kept FROM v JOIN comp ON comp.n = v.vec_id"""


@query("op10_embedding_dedup", _NEAR)
def op10(spark, sf_dir):
    return near_vectors(table(spark, sf_dir, "embeddings"))


_HARD = """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
     FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
   s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, list_inner_product(a.v, b.v)::BIGINT AS score
     FROM e a JOIN e b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 50 = 0),
   p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
     QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
   n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
       row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
     FROM p JOIN s ON p.anchor_id = s.anchor_id WHERE NOT same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
   SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3"""


@query("op11_hard_negatives", _HARD)
def op11(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return hard_negatives(rows, F.col("vec_id") % 50 == 0)


_WARC = """WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
   g AS (SELECT html, max(page_id) AS last FROM p GROUP BY html),
   d AS (SELECT page_id, strlen(p.html) AS payload_bytes, last, array_to_string(list_transform(string_split(sha1(p.html), ''),
     lambda h: substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * strpos('0123456789abcdef', h) - 3, 4)), '') AS bits
     FROM p JOIN g ON p.html = g.html)
   SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
       1 + 16 * substr(bits, 5 * i + 1, 1)::INTEGER + 8 * substr(bits, 5 * i + 2, 1)::INTEGER + 4 * substr(bits, 5 * i + 3, 1)::INTEGER
       + 2 * substr(bits, 5 * i + 4, 1)::INTEGER + substr(bits, 5 * i + 5, 1)::INTEGER, 1)), '') AS payload_digest,
     CASE WHEN last IS NULL OR page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
     CASE WHEN last IS NULL OR page_id = last THEN NULL ELSE last END AS refers_to FROM d"""


@query("op12_warc", _WARC)
def op12(spark, sf_dir):
    folder = scratch_folder(spark, "warc")
    write_archive(table(spark, sf_dir, "pages"), folder)
    return read_archive(spark, folder, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op13_turn_repair")
def op13(spark, sf_dir):
    return audit_conversations(damage(table(spark, sf_dir, "conversations")), copies="copies")


@query("pipeline")
def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
