"""Exact quantiles (linear interpolation) by radix selection; no group is ever gathered in one task.

``percentile`` keeps every distinct value of a group in one aggregation buffer; with a hot group that
buffer is a third of the data.  Here the order statistic of a rank is located digit by digit on a
64-bit number that sorts like the double (``with_sortable_bits``):

1. rows are counted by (group, first 22 bits), combined before the shuffle; running counts over a
   group's bins, at most 2^22 of them, say which bins hold a needed rank;
2. the rows of those bins are counted by their next 21 bits, and so for the last 21.

A bin of the last pass is one value, so the result is exact (it equals ``percentile`` /
``quantile_cont``) and every task's share is bounded whatever the values are: one far value, a
million copies of a value or a group with a third of all rows change nothing.  The plan is fixed and
lazy.  The same rows are scanned once per pass; a shuffle carries counts, and in the last two passes
the narrow (group, value) rows where the wanted bins are too many to broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerolith.functions.util import attach

SHIFTS = (42, 21, 0)  # bits below the digit of each pass: 22, 21 and 21 bits of the key


def with_sortable_bits(df: DataFrame, value: str, into: str) -> DataFrame:
    """Adds a long that orders doubles (no null, no NaN) as the doubles do: the IEEE bits of |v|, negated for v < 0.

    Exponent and fraction are taken apart by exact arithmetic: ``log2`` proposes the exponent, dividing by a
    power of two loses nothing, and the fraction shows where the exponent is off by one.  One column a step,
    so that each is computed once for a row.
    """
    a, e, m = F.col("__a"), F.col("__e"), F.col("__m")
    step = (df.withColumn("__a", F.abs(value)).withColumn("__e", F.greatest(F.lit(-1022.0), F.least(F.lit(1023.0), F.floor(F.log2(a)).cast("double"))))
            .withColumn("__m", a / F.pow(F.lit(2.0), e)))

    def joined(shift, scale):
        return (e.cast("long") + shift) * (1 << 52) + (m * float(scale)).cast("long")
    bits = (F.when(a == 0, F.lit(0).cast("long")).when(a == float("inf"), F.lit(2047 << 52)).when(m >= 2, joined(1023, 1 << 51))
            .when((m < 1) & (e > -1022), joined(1021, 1 << 53)).otherwise(joined(1022, 1 << 52)))
    return step.withColumn("__b", bits).withColumn(into, F.when(F.col(value) < 0, -F.col("__b")).otherwise(F.col("__b"))).drop("__a", "__e", "__m", "__b")


def _ranks(n: Column, probs: Sequence[float]) -> list[tuple[Column, Column, Column]]:
    """Per probability: position, lower and upper rank (from 0) among ``n`` values."""
    out = []
    for p in probs:
        pos = (n - 1).cast("double") * float(p)
        out.append((pos, F.floor(pos).cast("long"), F.ceil(pos).cast("long")))
    return out


def quantile_columns(df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float], names: Sequence[str]) -> DataFrame:
    """``by...`` and one column per probability; null and NaN values are left out, groups without values absent.

    Null keys are a group.  Without ``by`` there is one row, or none for no values.
    """
    if not by:
        return quantile_columns(df.withColumn("__all", F.lit(0)), ["__all"], value, probs, names).drop("__all")
    by, digits = list(by), []
    rows = df.select(*by, (F.col(value).cast("double") + 0.0).alias("__v")).where(F.col("__v").isNotNull() & ~F.isnan("__v"))
    rows = with_sortable_bits(rows, "__v", "__k")
    first, n = F.col("__first"), F.col("__n")
    for shift in SHIFTS:
        digit = f"__d{shift}"
        at = rows.withColumn(digit, F.shiftright("__k", shift) if shift else F.col("__k"))
        if digits:  # only rows of the bins that the last pass kept, with the bin's first rank and the group's size
            at = attach(at.withColumn(digits[-1], F.shiftright("__k", SHIFTS[len(digits) - 1])), kept, [*by, digits[-1]], measure=False)
        outer = [*by, *digits[-1:]]
        carried = [F.max("__first").alias("__first"), F.max("__n").alias("__n")] if digits else []
        bins = at.groupBy(*outer, digit).agg(F.count(F.lit(1)).alias("__c"), *carried, *([] if shift else [F.max("__v").alias("__x")]))
        ordered = Window.partitionBy(*outer).orderBy(digit).rowsBetween(Window.unboundedPreceding, -1)
        before = F.coalesce(F.sum("__c").over(ordered), F.lit(0).cast("long"))
        if digits:
            bins = bins.withColumn("__first", first + before)
        else:
            bins = bins.withColumns({"__first": before, "__n": F.sum("__c").over(Window.partitionBy(*outer))})
        hit = F.lit(False)
        for _, low, high in _ranks(n, probs):
            hit = hit | ((low >= first) & (low < first + F.col("__c"))) | ((high >= first) & (high < first + F.col("__c")))
        kept = bins.where(hit)
        if shift:
            kept = kept.select(*by, digit, "__first", "__n")
        digits.append(digit)
    here = [(pos, *(F.max(F.when((r >= first) & (r < first + F.col("__c")), F.col("__x"))) for r in (low, high))) for pos, low, high in _ranks(n, probs)]
    found = kept.groupBy(*by, "__n").agg(*[c.alias(f"__{s}{i}") for i, (_, low, high) in enumerate(here) for s, c in (("l", low), ("h", high))])

    def between(i: int) -> Column:
        pos, low, _ = _ranks(n, probs)[i]
        a, b = F.col(f"__l{i}"), F.col(f"__h{i}")
        return F.when(a == b, a).otherwise(a + (b - a) * (pos - low))
    return found.select(*by, *[between(i).alias(name) for i, name in enumerate(names)])


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """Long form of :func:`quantile_columns`: ``by..., qi`` (index into probs), ``p, q``."""
    wide = quantile_columns(df, by, value, probs, [f"__q{i}" for i in range(len(probs))])
    return wide.select(*by, F.inline(F.array(*[F.struct(F.lit(i).alias("qi"), F.lit(float(p)).alias("p"), F.col(f"__q{i}").alias("q")) for i, p in enumerate(probs)])))
