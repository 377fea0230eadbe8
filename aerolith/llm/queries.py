"""Registered queries of the training-data operators and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.llm import decontaminate, filter_audit, html_extract, langid, ngram_lm, periodic_runs, pq_dedup, sentencepiece, simhash, token_cache, toxicity, tree_search, warc_zip
from aerolith.llm.common import WORD_BREAK, fresh_path, is_held_out, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


@register("op1_warc_zip", warc_zip.ORACLE)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to ZIP-packaged archives and read back by ranges."""
    packages = warc_zip.write_pages(table(spark, sf_dir, "pages"), fresh_path(spark, "warc"))
    back = warc_zip.read_records(packages.select("path", "length"))
    return back.select("page_id", F.coalesce(F.octet_length("payload").cast("long"), "payload_bytes").alias("payload_bytes"),
                       F.coalesce(F.sha1("payload"), "declared_digest").alias("payload_digest"), "record_type",
                       F.regexp_extract("refers_to_id", "<urn:page:([0-9-]+):", 1).try_cast("long").alias("refers_to"))


@register("op2_benchmark_decontamination", decontaminate.ORACLE)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, benchmark item) pair with at least 0.8 of the item's 5-word shingles."""
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op3_sentencepiece")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every whole text and the text decoded from them, as digests."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    both = sentencepiece.decode_documents(sentencepiece.encode_documents(docs, path), path)
    return both.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"),
                       F.sha1(F.array_join("token_ids", " ")).alias("ids_digest"),
                       F.sha1("decoded").alias("decoded_digest"), (F.col("decoded") == F.col("text")).alias("round_trip"))


@register("op4_simhash_near_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash classes of all documents: 3-word shingles, links at 3 or fewer differing bits."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, max_bits=3)


@register("op5_html_extraction")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.main_text(table(spark, sf_dir, "pages"))


@register("op6_embedding_near_dedup", pq_dedup.ORACLE)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links at a cosine of 0.93 or more among all embeddings of equal label."""
    return pq_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), least=0.93)


@register("op7_toxicity")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned outside the fold crc32(doc_id) mod 3 = 1."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), modulus=3, remainder=1)
    scored = toxicity.predict(docs, model, threshold=0.7, score="score", label="predicted", evidence="evidence")
    return scored.select("doc_id", is_held_out("doc_id", 3, 1).alias("held_out"), "score", "predicted", "evidence")


@register("op8_token_counts")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document through a digest cache (a new one each call: all distinct texts are encoded)."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    counted = token_cache.token_counts(table(spark, sf_dir, "documents"), path, fresh_path(spark, "token-cache"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


@register("op9_lm_scoring")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probability of every document, learned outside the fold crc32(doc_id) mod 7 = 2."""
    return ngram_lm.score_documents(table(spark, sf_dir, "documents"), modulus=7, remainder=2)


@register("op10_language_id")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned outside the fold crc32(doc_id) mod 3 = 1."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    scored = langid.predict(docs, langid.train(docs, modulus=3, remainder=1), score="score")
    return scored.select("doc_id", is_held_out("doc_id", 3, 1).alias("held_out"), "lang_pred", "score")


@register("op11_filter_audit", filter_audit.ORACLE)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five text filters over all documents in all 120 orders, per language."""
    masks = filter_audit.document_masks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return filter_audit.audit(masks, weights=("good", "toxic"))


def with_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: where h = crc32(decimal doc_id) is divisible by 10, words from number a on repeat with
    period p; a = g % n, p = 1 + (n - a) div (3 + g % 8), g = h div 10, n words.  Other texts stay as they are."""
    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), WORD_BREAK), "")
    rows = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    rows = rows.withColumn("g", F.expr("h div 10")).withColumn("words", F.when(F.col("h") % 10 == 0, words).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("n", F.size("words")).withColumn("a", F.expr("CAST(CASE WHEN n > 0 THEN g % n ELSE 0 END AS INT)"))
    rows = rows.withColumn("p", F.expr("CAST(1 + (n - a) div (3 + g % 8) AS INT)"))
    planted = F.expr("array_join(transform(words, (w, i) -> IF(i < a, w, words[a + (i - a) % p])), ' ')")
    return rows.select("doc_id", F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias("text"))


@register("op12_periodic_runs")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of every whole document, repeats planted in a tenth of them."""
    found = periodic_runs.periodic_runs(with_repeats(table(spark, sf_dir, "documents")))
    return found.select("doc_id", *periodic_runs.run_report(F.col("periodic")))


@register("op13_nearest_neighbours")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest embeddings found for every vec_id divisible by 100, among all rows."""
    vectors = table(spark, sf_dir, "embeddings")
    return tree_search.nearest(vectors, vectors.where("vec_id % 100 = 0"), k=10)


@register("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language ID, toxicity, near-duplicates, decontamination and encoding over all documents."""
    return corpus_pipeline.run(spark, sf_dir)
