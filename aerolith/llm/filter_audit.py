"""Interaction of row filters under every order of application, by difference arrays over Lehmer ranks.

A document is known by its mask, the set of filters that it fails.  Sorted lexicographically, all
permutations that begin with the same letters have consecutive (Lehmer) ranks; a mask is removed at
step s by the permutations whose first s - 1 letters it passes and whose s-th letter it fails, which
is one rank interval for each such beginning.  So a mask's count is added at the two ends of these
intervals, and one prefix sum over the ranks gives what every permutation removes at every step.
Documents are counted by mask first; no document is replayed for any order.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerolith.llm.common import WORD_BREAK

LETTERS = "ABCDE"


def rank_intervals(mask: int, n: int) -> list[tuple[int, int, int]]:
    """``(step, low, high)``: permutations of n filters with ranks in [low, high) remove ``mask`` at ``step``.

    Bit i of the mask stands for filter i.  The empty mask has no interval.
    """
    found = []

    def extend(left: tuple[int, ...], low: int):
        size = factorial(len(left) - 1)
        for place, i in enumerate(left):
            start = low + place * size
            if mask >> i & 1:
                found.append((n - len(left) + 1, start, start + size))
            elif len(left) > 1:
                extend(left[:place] + left[place + 1:], start)

    extend(tuple(range(n)), 0)
    return found


def interval_ends(n: int) -> list[tuple[int, int, int, int]]:
    """``(mask, step, rank, sign)`` of all 2^n masks; step 0 holds every mask for all ranks (the part's total)."""
    rows = []
    for mask in range(1 << n):
        rows.append((mask, 0, 0, 1))
        for step, low, high in rank_intervals(mask, n):
            rows.append((mask, step, low, 1))
            if high < factorial(n):
                rows.append((mask, step, high, -1))
    return rows


def audit(counts: DataFrame, letters: str = LETTERS, part: str = "part", weights: tuple[str, ...] = ()) -> DataFrame:
    """Effect of each filter at each step of every order, per part.

    ``counts`` holds ``part``, ``mask`` (int; bit i set: fails ``letters[i]``), ``n`` and the ``weights``
    columns (longs, summed like ``n``); repeated (part, mask) rows add up.  Returns per part, order and
    step: ``filter_order``, ``step``, ``filter``, ``kept``, ``removed``, ``redundant`` (failing the filter,
    removed earlier), ``unique_fails`` (failing this filter only), ``<weight>_lost`` for each weight and
    ``shapley`` (the filter's removals over all orders).  A null part is a part of its own; no rows give
    no rows.  The letters (at most seven: the interval table grows with their factorial) are distinct and sorted.
    """
    if len(letters) > 7 or list(letters) != sorted(set(letters)):
        raise ValueError("up to seven distinct letters in order")
    n, spark = len(letters), counts.sparkSession
    orders = F.array(*[F.lit("".join(p)) for p in permutations(letters)])
    ends = F.broadcast(spark.createDataFrame(interval_ends(n), "mask int, step int, rank int, sign int"))  # fixed by the number of letters
    sums = ("n", *weights)
    by_mask = counts.groupBy(F.col(part).alias("part"), F.col("mask").cast("int").alias("mask")).agg(*[F.sum(c).alias(c) for c in sums])
    at_ends = (by_mask.join(ends, "mask").groupBy("part", "step", "rank").agg(*[F.sum(F.col("sign") * F.col(c)).alias(c) for c in sums]))
    zeros = (by_mask.select("part").distinct().withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(n))))
             .withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(factorial(n) - 1)))).select("part", "step", "rank", *[F.lit(0).cast("long").alias(c) for c in sums]))
    marks = at_ends.unionByName(zeros).groupBy("part", "step", "rank").agg(*[F.sum(c).alias(c) for c in sums])
    along = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    cells = marks.select("part", "step", "rank", *[F.sum(c).over(along).alias(c) for c in sums])
    steps = Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    signed = F.when(F.col("step") == 0, F.col("n")).otherwise(-F.col("n"))
    order = F.element_at(orders, F.col("rank") + 1)
    cells = (cells.withColumn("kept", F.sum(signed).over(steps)).where("step > 0")
             .withColumn("filter_order", order).withColumn("filter", F.substring(F.col("filter_order"), F.col("step"), 1))
             .withColumn("shapley", F.sum("n").over(Window.partitionBy("part", "filter"))))

    def of_filters(holds) -> Column:
        return F.array(*[F.sum(F.when(holds(i), F.col("n")).otherwise(0)) for i in range(n)])
    alone = by_mask.groupBy("part").agg(of_filters(lambda i: F.col("mask").bitwiseAND(1 << i) != 0).alias("fails"),
                                        of_filters(lambda i: F.col("mask") == 1 << i).alias("only")).withColumnRenamed("part", "of_part")
    at = F.instr(F.lit(letters), F.col("filter"))
    return (cells.join(alone, F.col("part").eqNullSafe(F.col("of_part")))
            .select("part", "filter_order", F.col("step").cast("int").alias("step"), "filter", "kept", F.col("n").alias("removed"),
                    (F.element_at("fails", at) - F.col("n")).alias("redundant"), F.element_at("only", at).alias("unique_fails"),
                    *[F.col(w).alias(f"{w}_lost") for w in weights], "shapley"))


def text_failures(text: Column) -> Column:
    """Bits 0 to 3 (filters A to D) of one whole text; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, WORD_BREAK), "")
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    fails = [F.size(words) < 100, 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
             100 * capitals.cast("long") > 10 * F.length(text).cast("long"), text.rlike("[#$%&*|]")]
    return reduce(lambda a, b: a + b, [F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)])


def document_masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``part, mask, n, good, toxic``: documents by the filters A to E that they fail.

    E fails when the same text has a smaller id anywhere in the table.  Every row counts (repeated rows each
    for themselves); a row without an id has no smaller one and no label, and never fails E.  A null text is
    the empty one, a null part the empty string.  A document is good (toxic) if any label row of its id says
    quality (toxic) = 1; null labels say nothing.  Only the columns named are read.

    Texts are digested (SHA-256) at the scan, so no text is shuffled.  Rows are counted by id, then by digest,
    with the first id and its count combined before the shuffle: a text held by a third of all rows reaches
    its task as one row for each task, part and label.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.when(F.col(id_col).isNull(), F.monotonically_increasing_id()).otherwise(0).alias("salt"),
                       F.coalesce(F.col(part_col), F.lit("")).alias("part"), text_failures(F.col(text_col)).alias("bits"),
                       F.unhex(F.sha2(text, 256)).alias("digest"))
    named = (labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
             .agg(F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("good"),
                  F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("toxic")).withColumn("salt", F.lit(0).cast("long")))
    rows = rows.join(named, ["id", "salt"], "left").fillna(0, ["good", "toxic"])
    key = ["digest", "bits", "part", "good", "toxic"]
    by_id = rows.groupBy("id", "salt", *key).agg(F.count(F.lit(1)).alias("n"))
    by_text = by_id.groupBy(*key).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("nameless"),
                                      F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("least"))
    first = F.min("least.id").over(Window.partitionBy("digest"))
    spared = F.col("nameless") + F.when(F.col("least.id") == F.col("first"), F.col("least.n")).otherwise(0)
    split = (by_text.withColumn("first", first).withColumn("spared", spared)
             .select("part", "good", "toxic", F.inline(F.array(F.struct(F.col("bits").alias("mask"), F.col("spared").alias("n")),
                                                               F.struct((F.col("bits") + 16).alias("mask"), (F.col("n") - F.col("spared")).alias("n"))))))
    return (split.where("n > 0").groupBy("part", "mask")
            .agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic")))


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
f AS (SELECT t.doc_id, part, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY text) AS first FROM t),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
m AS (SELECT part, len(w) < 100 AS a, 100 * len(list_distinct(w)) < 80 * len(w) AS b,
        100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) AS c,
        regexp_matches(text, '[#$%&*|]') AS d, coalesce(f.doc_id > first, false) AS e, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
      FROM f LEFT JOIN l USING (doc_id)),
k AS (SELECT part, (CASE WHEN a THEN 'A' ELSE '' END || CASE WHEN b THEN 'B' ELSE '' END || CASE WHEN c THEN 'C' ELSE '' END
        || CASE WHEN d THEN 'D' ELSE '' END || CASE WHEN e THEN 'E' ELSE '' END) AS fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic
      FROM m GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
p AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM x a, x b, x c, x d, x e
      WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
s AS (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM p),
z AS (SELECT part, filter_order, step, filter_order[step] AS filter, n, good, toxic, contains(fails, filter_order[step]) AS here, fails = filter_order[step] AS sole,
        translate(fails, filter_order[1:step - 1], '') <> fails AS before FROM k, s),
r AS (SELECT part, filter_order, step, filter, sum(CASE WHEN NOT before AND NOT here THEN n ELSE 0 END) AS kept,
        sum(CASE WHEN NOT before AND here THEN n ELSE 0 END) AS removed, sum(CASE WHEN before AND here THEN n ELSE 0 END) AS redundant,
        sum(CASE WHEN sole THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN NOT before AND here THEN good ELSE 0 END) AS good_lost,
        sum(CASE WHEN NOT before AND here THEN toxic ELSE 0 END) AS toxic_lost FROM z GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, filter, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM r
"""
