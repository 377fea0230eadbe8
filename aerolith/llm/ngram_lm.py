"""Language-model scoring by a weighted backoff automaton of smoothed n-grams.

States are the root (no context), the beginning of a text and one per word as context.
A context state has an arc for each word seen behind it in training; every other word takes the
state's failure arc to the root, whose arcs are all words.  Dirichlet smoothing gives the weights

    P(w)     = (c(w) + 1) / (N + V + 1)
    P(w | u) = (c(u w) + K P(w)) / (c(u) + K),   failure weight  K / (c(u) + K)

so each state's probabilities sum to one with one share for all unknown words.

Texts are dealt into blocks.  Arcs are known by a 64-bit hash of state and word.  A block sends out
its distinct arcs with its counts, packed by ranges of the hash; a range adds them up over the corpus
and sends back to each block what the others have of the block's arcs; then each text is read once
from left to right.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from aerolith.llm.common import is_held_out

#: The end of a text as a token (no word is empty), and the states that are no words.
END, ROOT, BEGIN = b"", b" ", b"\n"
#: A word is a context from this share of all training tokens on: every word.
CONTEXT_SHARE = 0.0
#: Strength of the root's distribution in a context's.
PRIOR = 1000.0
#: Bytes of text in a block, and distinct entries that a task holds before it sends them on.
BLOCK_BYTES, HELD = 24 << 20, 1_000_000
#: Texts of a block scored at once.
SCORED = 256


def tokens(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text with A-Z lower-cased, then the end."""
    return [*text.lower().split(), END]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def out():
        batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["w", "n"])
        held.clear()
        return batch

    for batch in batches:
        for text in batch.column(0).to_pylist():
            held.update(tokens(text))
            if len(held) > HELD:
                yield out()
    if held:
        yield out()


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxh64_intdigest(word)
        return h


def _mix(state: np.ndarray, word: np.ndarray) -> np.ndarray:
    h = (state ^ (state >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + word * np.uint64(0xC2B2AE3D27D4EB4F)
    return (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def arcs_of(texts: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of each text, and the arcs from the root and from the word before at every token."""
    hashes = Hashes()
    words = []
    for text in texts:
        read = tokens(text)
        words.append(np.fromiter(map(hashes.__getitem__, read), np.uint64, len(read)))
    n = np.array([len(w) for w in words], np.int64)
    w = np.concatenate(words) if words else np.zeros(0, np.uint64)
    state = np.roll(w, 1)
    state[np.cumsum(n) - n] = hashes[BEGIN]
    return n, _mix(np.full(len(w), hashes[ROOT], np.uint64), w), _mix(state, w)


def count_arcs(texts: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of each text, the block's distinct arcs (ascending), their counts in its training texts,
    and the arcs' numbers (a row from the root, a row from the words before)."""
    n, *rows = arcs_of(t.as_py() for t in texts.column("text"))
    learned = np.repeat(~texts.column("held_out").to_numpy().astype(bool), n)
    found, counted, number = [], [], np.zeros((2, len(learned)), np.int32)
    for i in range(2):  # one row of arcs at a time: sorting is what takes the memory
        arcs, at = np.unique(rows[i], return_inverse=True)
        rows[i] = None
        number[i] = at
        del at
        found.append(arcs)
        counted.append(np.bincount(number[i][learned], minlength=len(arcs)))
    arcs, count = np.concatenate(found), np.concatenate(counted)
    order = np.argsort(arcs, kind="stable")
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    number[1] += len(found[0])
    for row in number:
        row[:] = place[row]
    return n, arcs[order], count[order], number


def pack(x: np.ndarray) -> bytes:
    """Bytes of equal place side by side: those that hardly change compress well."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def _packed(rows: list[tuple[int, int, np.ndarray, np.ndarray]]) -> pa.Table:
    return pa.table([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()),
                     pa.array([pack(r[2]) for r in rows], pa.binary()), pa.array([pack(r[3]) for r in rows], pa.binary())],
                    names=["range", "block", "arcs", "n"])


def _sent(ranges: int):
    """The block's arcs and counts, by range of the hash."""
    def run(texts: pa.Table) -> pa.Table:
        _, arcs, count, _ = count_arcs(texts)
        at = ((arcs >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
        cut = [0, *(np.flatnonzero(np.diff(at)) + 1), len(at)]
        block = texts.column("block")[0].as_py()
        return _packed([(int(at[a]), block, arcs[a:b], count[a:b]) for a, b in zip(cut, cut[1:]) if a < b])
    return run


def _added(rows: pa.Table) -> pa.Table:
    """For each block, its arcs of one range that other blocks have learned, with the others' counts."""
    arcs = [unpack(x.as_py()) for x in rows.column("arcs")]
    own = np.concatenate([unpack(x.as_py()) for x in rows.column("n")]).astype(np.int64)
    _, number = np.unique(np.concatenate(arcs), return_inverse=True)
    more = np.bincount(number, own).astype(np.int64)[number] - own
    out, start = [], 0
    for of, block, x in zip(rows.column("range").to_pylist(), rows.column("block").to_pylist(), arcs):
        n = more[start:start + len(x)]
        start += len(x)
        if n.any():
            out.append((of, block, x[n > 0], n[n > 0]))
    return _packed(out)


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 7, remainder: int = 2,
                    block_bytes: int = BLOCK_BYTES, prior: float = PRIOR, context_share: float = CONTEXT_SHARE) -> DataFrame:
    """One row per input row: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    All texts outside the held-out fold are learned from, all texts are scored; null texts count
    as empty and have the end as their only token.  Rows without an id are scored and not learned
    from.  Repeated rows are counted and returned each.  With nothing to learn from every
    probability of the root is one.  An empty table gives no rows.  Only the named columns are
    read, so others cannot clash.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"),
                      is_held_out(id_col, modulus, remainder).alias("held_out"))
    size = own.agg(F.sum(F.octet_length("text").cast("long")).alias("bytes"),
                   F.count(F.when(~F.col("held_out"), 1)).alias("texts")).first()
    counts = own.where(~F.col("held_out")).select("text").mapInArrow(_count_words, "w binary, n long")
    sums = counts.groupBy("w").agg(F.sum("n").alias("c")).agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    total, words, n_texts = int(sums.n), int(sums.v), int(size.texts)

    blocks = max(1, -(-int(size.bytes or 0) // block_bytes))
    dealt = own.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")).repartition(blocks, "block")
    # The texts are shuffled once: both readers take all of their columns, so Spark reuses the
    # exchange.  An arc comes once from a block that has it, so no range holds more of it than there
    # are blocks, and there are as many ranges as blocks.
    packed = "range int, block int, arcs binary, n binary"
    sent = dealt.groupBy("block").applyInArrow(_sent(blocks), packed)
    added = sent.groupBy("range").applyInArrow(_added, packed)

    def read(texts: pa.Table, others: pa.Table) -> pa.Table:
        n, arcs, count, number = count_arcs(texts)
        for x, more in zip(others.column("arcs"), others.column("n")):
            count[np.searchsorted(arcs, unpack(x.as_py()))] += unpack(more.as_py()).astype(np.int64)
        del arcs
        end = np.cumsum(n)
        sums = np.zeros((3, len(n)))
        for i in range(0, len(n), SCORED):
            own = slice(i, i + SCORED)
            first = end[own] - n[own] - (end[i] - n[i])
            c, c_pair = count[number[:, end[i] - n[i]:end[own][-1]]]
            c_state = np.roll(c, 1)
            c_state[first] = n_texts
            root = (c + 1) / (total + words + 1)
            whole = (c_pair + prior * root) / (c_state + prior)  # an arc, or failure arc and root's arc where the pair was not seen
            is_context = c_state >= context_share * total
            is_context[first] = True
            text = np.repeat(np.arange(len(first)), n[own])
            for row, x in zip(sums, (c > 0, np.log10(root), np.log10(np.where(is_context, whole, root)))):
                row[own] = np.bincount(text, x, minlength=len(first))
        return pa.table([texts.column("doc_id"), texts.column("held_out"), pa.array(n), pa.array(sums[0].astype(np.int64)),
                         pa.array(np.full(len(n), total, np.int64)), pa.array(sums[1]), pa.array(sums[2])],
                        names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return dealt.groupBy("block").cogroup(added.groupBy("block")).applyInArrow(
        read, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
