"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.llm import decontaminate, langid, sentencepiece, simhash, toxicity
from aerolith.llm.common import materialize, table, unused


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents with a language: those rejected are null or have no letter (``und``, which is decided before the
    classifier is asked; any language it names is kept, so it rejects nothing of its own).  Without any label to
    learn from there is no model, and documents with a letter stay.  Repeated rows and columns of any name stay."""
    model = langid.train(docs)
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    lang, score = unused(docs, "__lang"), unused(docs, "__lang_score")
    scored = langid.predict(docs, model, label=lang, score=score)
    return scored.where(F.col(lang) != langid.UNKNOWN).drop(lang, score)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that score below 0.7 for toxicity; empty texts have the base rate of texts without a term.  Rows
    are judged one by one, columns of any name stay."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    names = [unused(docs, c) for c in ("__score", "__label", "__evidence")]
    scored = toxicity.predict(docs, model, score=names[0], label=names[1], evidence=names[2])
    return scored.where(F.col(names[1]) == 0).drop(*names)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each SimHash group, that with the smallest doc_id (ties: one row).  Null and empty texts are
    one group, a null doc_id comes last, columns of any name stay."""
    return simhash.first_of_each(docs, width=3, max_bits=3)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that contain no benchmark item, by row: null and shared doc_ids are rows of their own.  Null and
    empty texts contain nothing; columns of any name stay."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, and whether they decode to its text (null for a null text).  Columns ``token_ids``,
    ``n_tokens`` and ``round_trip`` of the input are replaced, others stay; every row gets its own answer."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    decoded = unused(docs, "__decoded")
    both = sentencepiece.decode_documents(sentencepiece.encode_documents(docs, path), path, text=decoded)
    return (both.withColumn("n_tokens", F.size("token_ids").cast("long"))
            .withColumn("round_trip", F.col(decoded) == F.col("text")).drop(decoded))


STAGES = [("language_id", language), ("toxicity", toxic), ("simhash_near_dedup", near_duplicates),
          ("benchmark_decontamination", benchmark), ("sentencepiece", encode)]

#: The classifiers and the encoder cannot be expressed in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
