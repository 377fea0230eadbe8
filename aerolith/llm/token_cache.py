"""Token counts with a digest cache.

Counts are stored by (content digest, tokenizer digest).  A run joins its documents to the stored
counts, encodes each distinct text that has none once, appends those counts to the cache and
returns every document's count from the join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.llm.common import materialize

CACHE_SCHEMA = "tokenizer string, content string, n_tokens long"
#: Texts given to the tokenizer at a time.
BATCH_CHARS = 1 << 20


def tokenizer_digest(model_path: str) -> str:
    """SHA-256 of the tokenizer's file: another version of it is another key."""
    with open(model_path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def content_digest(text):
    """SHA-256 of the normalised content.  Normalisation may not change a count, so it is only
    null to empty; texts that differ in any byte are different content."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def read_cache(spark: SparkSession, cache_path: str) -> DataFrame:
    """The stored counts, one row a key (a batch appended twice after a failure counts once)."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(cache_path)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(cache_path).groupBy("tokenizer", "content").agg(F.max("n_tokens").alias("n_tokens"))


def _counter(model_path: str, model: bytes):
    """A function from texts to token counts: sentencepiece for .model, tokenizers for .json files."""
    if model_path.endswith(".model"):
        import sentencepiece
        own = sentencepiece.SentencePieceProcessor(model_proto=model)
        return lambda texts: [len(ids) for ids in own.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer
    own = Tokenizer.from_str(model.decode())
    own.no_truncation()
    own.no_padding()
    return lambda texts: [len(e.ids) for e in own.encode_batch(texts, add_special_tokens=False)]


def _encode(model_path: str, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(model_path, shared.value)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            out: list[int] = []
            start = chars = 0
            for i, t in enumerate(texts):
                chars += len(t)
                if chars >= BATCH_CHARS or i + 1 == len(texts):
                    out.extend(count(texts[start:i + 1]))
                    start, chars = i + 1, 0
            yield pa.RecordBatch.from_arrays([batch.column("content"), pa.array(out, pa.int64())], ["content", "n_tokens"])
    return run


def token_counts(docs: DataFrame, model_path: str, cache_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_tokens)`` for every row, through the cache at ``cache_path``.

    Whole texts are encoded without begin, end or added special tokens.  Null texts count as
    empty; an empty text has the tokens that the library gives it.  Repeated texts are encoded
    once.  Every input row is returned (null ids too); an empty table returns none and appends
    nothing.  Only the named columns are read, so others cannot clash.  The tokenizer's file is
    read on the driver and broadcast (checked to be below 64 MB).
    """
    spark = docs.sparkSession
    version = tokenizer_digest(model_path)
    with open(model_path, "rb") as f:
        model = f.read((64 << 20) + 1)
    if len(model) > 64 << 20:
        raise ValueError("the tokenizer's file is above 64 MB")
    text = F.coalesce(F.col(text_col), F.lit(""))
    stored = read_cache(spark, cache_path).where(F.col("tokenizer") == version).select("content", "n_tokens")
    own = materialize(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"),
                                  content_digest(F.col(text_col)).alias("content")), "digests")
    missing = materialize(own.select("content").distinct().join(stored, "content", "left_anti"), "misses")
    # one text for each missing digest: copies are combined before the shuffle
    texts = docs.select(content_digest(F.col(text_col)).alias("content"), text.alias("text"))
    if missing.count() < own.select("content").distinct().count():
        texts = texts.join(missing, "content", "left_semi")
    once = texts.groupBy("content").agg(F.first("text").alias("text"))
    shared = spark.sparkContext.broadcast(model)
    counted = once.mapInArrow(_encode(model_path, shared), "content string, n_tokens long")
    counted.select(F.lit(version).alias("tokenizer"), "content", "n_tokens").write.mode("append").parquet(cache_path)
    known = read_cache(spark, cache_path).where(F.col("tokenizer") == version).select("content", "n_tokens")
    return own.join(known, "content").select("doc_id", "n_bytes", "n_tokens")
