"""Benchmark decontamination: size-partitioned MinHash containment search, DataFrame functions only.

A test item Q with q distinct shingles is contained in a document when the document has at least
``t * q`` of them.  Any ``q - ceil(t * q) + 1`` shingles of Q then include one of the document's,
so Q's bottom-k MinHash sketch of that many shingles (the smallest hashes) meets every document
that contains Q: the search has no false negatives.  Items are partitioned by q, which fixes the
sketch size and the sketch's largest hash in each partition; a document probes with its shingle
hashes that are not above the largest of those bounds.  Candidates are verified on the shingles
themselves.

Banded signatures of whole documents would be useless here: 40 shared shingles of a document of
20,000 are a Jaccard similarity of 0.002.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolith.llm.common import materialize, small, with_row_key

NOT_WORD = r"[^\p{L}\p{N}]+"
#: Sketch rows (about 60 bytes each) and candidate ids that may be broadcast; more are joined by shuffle.
BROADCAST_ROWS = 500_000


def item_words(text: Column) -> Column:
    """Lower-cased runs of letters and digits: case, punctuation and white space do not count."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def _at(name: str, i: Column, width: int) -> list[Column]:
    return [F.get(F.col(name), i + F.lit(k)) for k in range(width)]


def _windows(name: str, width: int, make) -> Column:
    """``make(list of columns)`` for every window of ``width`` elements of an array column; a shorter
    array is one window, an empty one has none."""
    n = F.size(name)
    many = F.transform(F.sequence(F.lit(0), n - F.lit(width)), lambda i: make(_at(name, i, width)))
    one = F.transform(F.sequence(F.lit(0), F.lit(0)), lambda i: make(_at(name, i, width)))
    return F.when(n >= width, many).when(n > 0, one)


def shingle_hashes(words: str, width: int) -> Column:
    return _windows(words, width, lambda c: F.xxhash64(*c))


def shingles(words: str, width: int) -> Column:
    return _windows(words, width, lambda c: F.concat_ws(" ", *c))


def item_sketches(items: DataFrame, id_col: str, text_col: str, width: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """``(item_id, shingles, n)`` per item, and its sketch rows ``(size_class, item_id, h)``."""
    w = items.select(F.col(id_col).cast("long").alias("item_id"), item_words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    full = (w.select("item_id", F.array_distinct(shingles("w", width)).alias("shingles"),
                     F.array_sort(F.array_distinct(shingle_hashes("w", width))).alias("hashes"))
            .withColumn("n", F.size("shingles")))
    need = F.ceil(F.col("n") * F.lit(threshold) - F.lit(1e-9)).cast("int")
    sketch = (full.withColumn("size_class", F.floor(F.log2("n")).cast("int"))
              .select("size_class", "item_id", F.explode(F.slice("hashes", F.lit(1), F.col("n") - need + 1)).alias("h")))
    return full.select("item_id", "shingles", "n"), sketch


def contained_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    item_id_col: str = "item_id", item_text_col: str = "text", width: int = 5,
                    threshold: float = 0.8) -> DataFrame:
    """``(doc_id, item_id, n_shingles, n_shared, containment)`` for every item of which a document has
    at least ``threshold`` of the distinct ``width``-word shingles.

    Words are lower-cased runs of letters and digits.  An item or document of fewer words has its
    whole sequence as its only shingle; without words it has none and matches nothing (null and
    empty texts).  Repeated rows of a document or item give one pair, with the best containment.
    Null ids are kept as an id of their own.  Empty tables give no rows.  Only the named columns
    are read, so others cannot clash.
    """
    item_rows, sketch = item_sketches(items, item_id_col, item_text_col, width, threshold)
    sketch = materialize(sketch.distinct(), "sketch")
    is_small = small(sketch, BROADCAST_ROWS)
    highest = sketch.agg(F.max("h").alias("h")).first().h
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    words = own.select("doc_id", item_words(F.col("text")).alias("w"))
    hashes = words.select("doc_id", F.explode(shingle_hashes("w", width)).alias("h"))
    probes = hashes.where(F.col("h") <= F.lit(highest)) if highest is not None else hashes.where(F.lit(False))
    side = sketch.select("item_id", "h")
    if is_small:
        found = probes.join(F.broadcast(side), "h")
    else:
        found = probes.distinct().join(side, "h")
    candidates = materialize(found.select("doc_id", "item_id").distinct(), "candidates")

    ids = candidates.select(F.col("doc_id").alias("__id")).distinct()
    ids = F.broadcast(ids) if small(ids, BROADCAST_ROWS) else ids
    texts = (own.join(ids, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
             .select("doc_id", item_words(F.col("text")).alias("w"))
             .select("doc_id", F.array_distinct(shingles("w", width)).alias("have")))
    pairs = candidates.select(F.col("doc_id").alias("__id"), F.col("item_id").alias("__item"))
    pairs = F.broadcast(pairs) if small(pairs, BROADCAST_ROWS) else pairs
    met = texts.join(pairs, F.col("doc_id").eqNullSafe(F.col("__id"))).drop("__id")
    one_each = item_rows.groupBy("item_id", "shingles").agg(F.max("n").alias("n"))  # repeated items count once
    one_each = F.broadcast(one_each) if small(one_each, BROADCAST_ROWS // 100) else one_each
    both = met.join(one_each, F.col("__item").eqNullSafe(F.col("item_id"))).drop("__item")
    shared = F.size(F.array_intersect("shingles", "have"))
    return (both.select("doc_id", "item_id", F.col("n").cast("long").alias("n_shingles"), shared.cast("long").alias("n_shared"))
            .withColumn("containment", F.col("n_shared") / F.col("n_shingles"))
            .where(F.col("containment") >= F.lit(threshold))
            .groupBy("doc_id", "item_id")
            .agg(F.max(F.struct("containment", "n_shingles", "n_shared")).alias("best"))
            .select("doc_id", "item_id", "best.n_shingles", "best.n_shared", "best.containment"))


def remove_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents that contain no item; all columns stay.

    Rows are told apart by a written key, so one with an item does not take along others of its
    (null or repeated) id.
    """
    rows, key = with_row_key(docs)
    found = contained_items(rows, items, key, text_col, **options)
    leaks = materialize(found.select(F.col("doc_id").alias(key)).distinct(), "leaks")
    leaks = F.broadcast(leaks) if small(leaks, BROADCAST_ROWS) else leaks
    return rows.join(leaks, key, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


ORACLE = r"""
WITH i AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
si AS (SELECT DISTINCT item_id, unnest([array_to_string(w[j:j+4], ' ') FOR j IN range(1, greatest(len(w) - 4, 1) + 1)]) AS s FROM i WHERE len(w) > 0),
sd AS (SELECT DISTINCT doc_id, unnest([array_to_string(w[j:j+4], ' ') FOR j IN range(1, greatest(len(w) - 4, 1) + 1)]) AS s FROM d WHERE len(w) > 0),
n AS (SELECT item_id, count(*) AS n_shingles FROM si GROUP BY 1),
c AS (SELECT doc_id, item_id, count(*) AS n_shared FROM si JOIN sd USING (s) GROUP BY 1, 2)
SELECT doc_id, item_id, n_shingles, n_shared, n_shared / n_shingles AS containment
FROM c JOIN n USING (item_id) WHERE n_shared / n_shingles >= 0.8
"""
