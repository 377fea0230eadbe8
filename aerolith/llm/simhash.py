"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints are split into parts of correlated bits.  Two fingerprints that differ in at most
``max_bits`` bits agree up to ``T[i]`` bits on at least one part i whenever
``sum(T) = max_bits - parts + 1`` (a threshold of -1 skips its part).  The thresholds come from a
dynamic programme over estimated candidate counts and probe rows; probes meet index rows in
buckets, and every candidate is verified on all 64 bits.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from aerolith.llm.common import forest, group_starts, materialize, small, whole_groups, with_row_key
from aerolith.llm.components import connected_components

BITS = 64
#: Relative cost of shuffling one probe row and of comparing one candidate (a vectorised xor).
ROW_COST, PAIR_COST = 3e-6, 2e-8
#: Rows of one bucket compared in one group; a larger bucket is cut into blocks that meet pairwise.
BLOCK_ROWS = 4096
#: Links held before they are contracted to a forest.
FLUSH_LINKS = 2_000_000
BROADCAST_ROWS = 100_000


def text_bits(text: bytes, width: int) -> int:
    """Fingerprint of one UTF-8 text.  ASCII lower-casing and splitting of bytes touch exactly A-Z and
    the white space 0x20, 0x09-0x0D."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - width + 1)
    first = [0, *(ends[: n - 1] + 1).tolist()]
    last = ends[len(words) - n:].tolist()
    ones = np.zeros(BITS, np.int64)
    for s in range(0, n, 1 << 14):  # a very long text is folded piece by piece
        h = np.array([xxh64_intdigest(line[a:b], 42) for a, b in zip(first[s:s + (1 << 14)], last[s:s + (1 << 14)])], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits((2 * ones > n).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, row_col: str | None = None) -> DataFrame:
    """``(doc_id, fp)``, one row per input row; ``fp`` holds the 64 bits as a long.  With ``row_col``, a
    long, it follows as ``row``.

    Shingles are ``width`` words, repeats included (fewer words: the whole sequence), hashed by XXH64
    with seed 42.  Bit j is set when more than half of the hashes have it set.  Null, empty and blank
    texts get fingerprint zero.
    """
    def fold(batches):
        for batch in batches:
            out = np.array([text_bits(t, width) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64)), *batch.columns[2:]], ["doc_id", "fp", "row"][:batch.num_columns])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"),
                        *([F.col(row_col).alias("row")] if row_col else []))
    return texts.mapInArrow(fold, "doc_id long, fp long" + (", row long" if row_col else ""))


# --- the plan: parts and thresholds ----------------------------------------------------------------------------

@dataclass(frozen=True)
class Plan:
    masks: tuple[int, ...]
    thresholds: tuple[int, ...]
    cost: float


def _bit_counts(batches):
    """Per partition: how often bits i and j are both set (i <= j), and the number of rows at (-1, -1)."""
    both, n = np.zeros((BITS, BITS)), 0
    for batch in batches:
        v = np.ascontiguousarray(batch.column(0).to_numpy().view(np.uint64).astype("<u8"))
        if len(v):
            x = np.unpackbits(v.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            both += x.T @ x
            n += len(v)
    i, j = np.triu_indices(BITS)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(i, -1), pa.int32()), pa.array(np.append(j, -1), pa.int32()),
                                      pa.array(np.append(both[i, j], n).astype(np.int64))], ["i", "j", "n"])


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and the 64 x 64 matrix of joint bit counts, over all of them (2,081 numbers)."""
    rows = fps.select("fp").mapInArrow(_bit_counts, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    both, total = np.zeros((BITS, BITS)), 0
    for r in rows:
        if r.i < 0:
            total = int(r.n)
        else:
            both[r.i, r.j] = both[r.j, r.i] = r.n
    return total, both


def correlation(total: int, both: np.ndarray) -> np.ndarray:
    f = np.diag(both) / max(total, 1)
    sd = np.sqrt(np.maximum(f * (1 - f), 1e-12))
    r = (both / max(total, 1) - np.outer(f, f)) / np.outer(sd, sd)
    r[sd <= 1e-6, :] = 0  # a constant bit tells nothing about others
    r[:, sd <= 1e-6] = 0
    np.fill_diagonal(r, 1.0)
    return np.clip(np.abs(r), 0, 1)


def group_bits(corr: np.ndarray, parts: int) -> list[list[int]]:
    """Greedy parts of nearly equal width: each grows by the bit most correlated with what it holds."""
    left = set(range(BITS))
    out = []
    for k in range(parts):
        want = len(left) // (parts - k)
        rest = sorted(left)
        first = max(rest, key=lambda b: (corr[b, rest].sum(), -b))
        part = [first]
        left.discard(first)
        while len(part) < want:
            nxt = max(sorted(left), key=lambda b: (corr[b, part].sum(), -b))
            part.append(nxt)
            left.discard(nxt)
        out.append(sorted(part))
    return out


def _distance_share(p: np.ndarray, corr: np.ndarray, upto: int) -> np.ndarray:
    """Estimated share of random pairs within 0..upto bits on a part.

    Poisson binomial over the bits' chances to differ, with the part's width shrunk to its
    effective number of independent bits.
    """
    effective = max(1.0, len(p) ** 2 / (corr ** 2).sum())
    dist = np.zeros(len(p) + 1)
    dist[0] = 1.0
    for x in p:
        dist[1:] = dist[1:] * (1 - x) + dist[:-1] * x
        dist[0] *= 1 - x
    share = np.minimum(1.0, np.cumsum(dist[: upto + 1]))
    return share ** (effective / len(p))


def allocate(total: int, both: np.ndarray, max_bits: int, part_counts=(2, 3, 4, 5, 6)) -> Plan:
    """Cheapest parts and thresholds: for each number of parts a dynamic programme over thresholds
    -1..max_bits whose sum is ``max_bits - parts + 1``."""
    corr = correlation(total, both)
    f = np.diag(both) / max(total, 1)
    differ = 2 * f * (1 - f)
    best = None
    for m in part_counts:
        parts = group_bits(corr, m)
        costs = []
        for part in parts:
            share = _distance_share(differ[part], corr[np.ix_(part, part)], max_bits)
            row = {-1: 0.0}
            for t in range(max_bits + 1):
                variants = sum(comb(len(part), k) for k in range(t + 1))
                row[t] = (variants + (t > 0)) * total * ROW_COST + float(total) * total * share[t] * PAIR_COST
            costs.append(row)
        table = {0: (0.0, ())}  # sum of (threshold + 1) so far -> (cost, thresholds)
        for row in costs:
            new: dict[int, tuple[float, tuple[int, ...]]] = {}
            for s, (c, ts) in table.items():
                for t, x in row.items():
                    k = s + t + 1
                    if k <= max_bits + 1 and (k not in new or (c + x, ts + (t,)) < new[k]):
                        new[k] = (c + x, ts + (t,))
            table = new
        cost, ts = table[max_bits + 1]
        if best is None or cost < best.cost:
            best = Plan(tuple(sum(1 << b for b in p) for p in parts), ts, cost)
    return best


# --- candidates and links --------------------------------------------------------------------------------------

def _probe_rows(plan: Plan):
    """Index rows (role 1), probe rows (role 2), or rows that are both (role 3, threshold 0)."""
    masks = []
    for mask, t in zip(plan.masks, plan.thresholds):
        bits = [b for b in range(BITS) if mask >> b & 1]
        flips = [sum(1 << b for b in c) for k in range(t + 1) for c in combinations(bits, k)] if t > 0 else []
        masks.append((np.uint64(mask), t, np.array(flips, np.uint64)))

    def emit(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            for i, (mask, t, flips) in enumerate(masks):
                if t < 0:
                    continue
                groups = [(fps & mask, fps, 3)] if t == 0 else [(fps & mask, fps, 1)] + [((fps & mask) ^ x, fps, 2) for x in flips]
                for value, fp, role in groups:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(fp), i, np.int32)), pa.array(value.view(np.int64)), pa.array(fp.view(np.int64)),
                         pa.array(np.full(len(fp), role, np.int32))], ["part", "val", "fp", "role"])
    return emit


def _bucket_links(max_bits: int):
    def links_of(fp, role, blk, cross, starts):
        """Forest of the links inside each group: (larger position, smallest position it reaches)."""
        n = len(fp)
        group = np.zeros(n, np.int64)
        group[starts[1:]] = 1
        group = np.cumsum(group)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        label, count, d = None, 0, 1
        at = np.arange(n - 1)
        while True:
            at = at[at + d < n]
            at = at[group[at] == group[at + d]]
            if not len(at):
                break
            to = at + d
            near = np.bitwise_count(fp[at] ^ fp[to]) <= max_bits
            near &= ((role[at] | role[to]) == 3) & (~cross[at] | (blk[at] != blk[to]))
            if near.any():
                held.append((at[near], to[near]))
                count += int(near.sum())
                if count > FLUSH_LINKS:
                    label = forest(n, np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))
                    up = np.flatnonzero(label != np.arange(n))
                    held, count = [(up, label[up])], len(up)
            d += 1
        if not held:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        label = forest(n, np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))
        up = np.flatnonzero(label != np.arange(n))
        return up, label[up]

    def run(batches):
        keys = ["part", "val", "bx", "by"]
        for t in whole_groups(batches, keys):
            starts = group_starts(t, keys)
            fp = t.column("fp").to_numpy()
            bx, by = t.column("bx").to_numpy(), t.column("by").to_numpy()
            a, b = links_of(fp.view(np.uint64), t.column("role").to_numpy(), t.column("blk").to_numpy(), bx != by, starts)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(fp[a]), pa.array(fp[b])], ["a", "b"])
    return run


def bucket_blocks(rows: DataFrame, key: list[str], member: str, block_rows: int) -> DataFrame:
    """Add ``blk, bx, by``: a bucket of more than ``block_rows`` rows is cut into blocks, and each
    pair of its blocks becomes a group of its own, so no group is larger than two blocks."""
    heavy = materialize(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block_rows), "heavy")
    side = heavy.select(*key, F.ceil(F.col("n") / F.lit(block_rows)).cast("int").alias("nb"))
    side = F.broadcast(side) if small(side, BROADCAST_ROWS) else side
    cut = (rows.join(side, key, "left")
           .withColumn("nb", F.coalesce("nb", F.lit(1)))
           .withColumn("blk", F.pmod(F.xxhash64(F.col(member), F.lit(7)), F.col("nb").cast("long")).cast("int")))
    return (cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
            .withColumn("bx", F.least("blk", "other")).withColumn("by", F.greatest("blk", "other")).drop("nb", "other"))


def fingerprint_links(fps: DataFrame, max_bits: int = 3, block_rows: int = BLOCK_ROWS, plan: Plan | None = None) -> DataFrame:
    """Edges ``(a, b)`` between distinct fingerprints with the connectivity of all links at
    ``max_bits`` or fewer differing bits: each bucket gives a forest of its links, not all pairs."""
    if plan is None:
        total, both = bit_statistics(fps)
        plan = allocate(total, both, max_bits)
    rows = fps.select("fp").mapInArrow(_probe_rows(plan), "part int, val long, fp long, role int")
    cut = bucket_blocks(rows, ["part", "val"], "fp", block_rows)
    keys = ["part", "val", "bx", "by"]
    met = cut.select(*keys, "blk", "fp", "role").repartition(*keys).sortWithinPartitions(*keys)
    return met.mapInArrow(_bucket_links(max_bits), "a long, b long")


def components(classes: DataFrame, max_bits: int, block_rows: int) -> DataFrame:
    """``classes`` (one row per fingerprint ``fp``) with the smallest fingerprint that each reaches."""
    classes = materialize(classes, "classes")
    parts = connected_components(fingerprint_links(classes, max_bits, block_rows))
    return classes.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, max_bits: int = 3,
                    block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per input row: ``doc_id, fingerprint`` (16 hex digits), ``component_id``.

    Rows link when their fingerprints differ in at most ``max_bits`` bits (equal ones included);
    component_id is the smallest doc_id reachable.  Null texts and texts without words have
    fingerprint zero and link like any other.  A null doc_id is returned as it is and never
    becomes a component id unless nothing else is reachable (then component_id is null).  Repeated
    rows are each returned.  Only ``id_col`` and ``text_col`` are read, so other columns cannot
    clash.  An empty table gives no rows.
    """
    own = materialize(fingerprints(docs, id_col, text_col, width), "fingerprints")
    labelled = components(own.groupBy("fp").agg(F.min("doc_id").alias("low")), max_bits, block_rows)
    lowest = labelled.groupBy("component").agg(F.min("low").alias("component_id"))
    by_fp = labelled.join(lowest, "component").select("fp", "component_id")
    return (own.join(by_fp, "fp")
            .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, max_bits: int = 3,
                  block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row of each group of near-duplicates, that with the smallest id (null ids last); all columns stay.

    Rows are told apart by a written key, so a null or repeated id neither joins nor loses rows.
    """
    rows, key = with_row_key(docs)
    own = materialize(fingerprints(rows, id_col, text_col, width, key), "fingerprints")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    labelled = components(own.groupBy("fp").agg(F.min(first).alias("low")), max_bits, block_rows)
    kept = labelled.groupBy("component").agg(F.min("low").alias("low")).select(F.col("low.row").alias(key))
    return rows.join(kept, key, "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))


def keep_one(docs: DataFrame, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents whose id names their group (one row each); all columns stay.  For ids that
    are unique; ``first_of_each`` tells rows apart."""
    ids = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__keep")).distinct()
    return docs.join(ids, F.col(id_col).eqNullSafe(F.col("__keep")), "left_semi").dropDuplicates([id_col])
