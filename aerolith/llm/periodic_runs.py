"""Periodic runs of words in whole texts: seeds from repeated k-grams, extended along diagonals.

A run with smallest period q and length at least max(least, 2 q) matches itself at lag q over at least
max(least - q, q) words.  Periods are searched in classes [k, 2k), the first one [1, 2k) with 2k >= least:
there this overlap is at least k, so a run of the class shows as two equal k-grams q words apart.  The
k-grams of a text are indexed by a hash, pairs of occurrences in the class's lags are the seeds, and a
seed is extended along its diagonal (its lag) by comparing words.  A table holds, per lag, how far
extension has come; seeds inside are skipped.

A k-gram of small period (k/2 or less) would have far too many occurrences.  It lies in a run that an
earlier class found, and only the first k-gram of such a run is a seed, paired with occurrences outside
it: if all k-grams of a longer run are of this kind, it starts where one of its two copies starts such a
run.  Other k-grams are more than k/2 words apart, so a text of n words has O(n) seeds a class.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RUNS_TYPE = "struct<runs:array<struct<start:bigint,length:bigint,period:bigint>>,collapsed:string,n_words:bigint>"
_ARROW_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)


def _first_difference(w: np.ndarray, at: int, lag: int) -> int:
    """First x >= at with w[x] != w[x + lag], or where x + lag ends."""
    end, block = len(w) - lag, 64
    while at < end:
        to = min(end, at + block)
        differs = w[at:to] != w[at + lag:to + lag]
        first = int(differs.argmax())
        if differs[first]:
            return at + first
        at, block = to, block * 2
    return end


def _last_difference(w: np.ndarray, at: int, lag: int) -> int:
    """Last x < at with w[x] != w[x + lag], or -1."""
    block = 64
    while at > 0:
        low = max(0, at - block)
        differs = (w[low:at] != w[low + lag:at + lag])[::-1]
        first = int(differs.argmax())
        if differs[first]:
            return at - 1 - first
        at, block = low, block * 2
    return -1


def _seeds(code: np.ndarray, pos: np.ndarray, k: int, least_lag: int, runs: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(lag, position) of the seeds, sorted; ``code`` is sorted, ``pos`` ascends within equal codes."""
    lags, starts = [], []
    use = np.ones(len(pos), bool)
    small = [(start, length) for start, length, period in runs if 2 * period <= k <= length] if least_lag > 1 else []
    if small:
        inside = np.zeros(int(pos.max()) + 2, np.int32)
        for start, length in small:
            if start < len(inside):
                inside[start] += 1
                inside[min(start + length - k + 1, len(inside) - 1)] -= 1
        use = np.cumsum(inside)[pos] == 0
        by_pos = np.argsort(pos)
        for start, length in small:
            found = np.searchsorted(pos, start, sorter=by_pos)
            if found == len(pos) or pos[by_pos[found]] != start:
                continue
            own = code[by_pos[found]]
            same = pos[np.searchsorted(code, own, "left"):np.searchsorted(code, own, "right")]
            lag = np.abs(same - start)
            same = same[(lag >= least_lag) & (lag < 2 * k) & ((same < start) | (same > start + length - k))]
            lags.append(np.abs(same - start))
            starts.append(np.minimum(same, start))
    code, pos = code[use], pos[use]
    for step in range(1, len(pos)):
        lag = pos[step:] - pos[:-step]
        near = (code[step:] == code[:-step]) & (lag < 2 * k)
        if not near.any():
            break
        near &= lag >= least_lag
        lags.append(lag[near])
        starts.append(pos[:-step][near])
    if not lags:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    lag, start = np.concatenate(lags), np.concatenate(starts)
    order = np.lexsort((start, lag))
    lag, start = lag[order], start[order]
    if len(lag):  # the next seed of a diagonal, one word on, is on the same stretch
        new = np.ones(len(lag), bool)
        new[1:] = (lag[1:] != lag[:-1]) | (start[1:] > start[:-1] + 1)
        lag, start = lag[new], start[new]
    return lag, start


def find_runs(w: np.ndarray, least: int = 12) -> list[tuple[int, int, int]]:
    """All (start, length, period) of the word numbers ``w``, by start, then period.

    A run has its smallest period, at least max(least, 2 * period) words, and no neighbouring word
    extends it keeping that period.
    """
    n, k = len(w), (least + 1) // 2
    runs: list[tuple[int, int, int]] = []
    if n < max(least, 2):
        return runs
    one = _mixed(w.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    gram = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        gram = gram * np.uint64(0xD6E8FEB86659FD93) + one[i:n - k + 1 + i]
    alive, least_lag, spans, covered = np.arange(len(gram)), 1, set(), {}
    while True:
        order = np.argsort(gram[alive], kind="stable")
        pos = alive[order]
        code = gram[pos]
        again = np.zeros(len(pos) + 1, bool)
        again[1:-1] = code[1:] == code[:-1]
        twice = again[1:] | again[:-1]
        if not twice.any():
            break
        code, pos = code[twice], pos[twice]
        for q, at in zip(*(x.tolist() for x in _seeds(code, pos, k, least_lag, runs))):
            if at <= covered.get(q, -1):
                continue
            end = _first_difference(w, at, q)
            start = _last_difference(w, at, q) + 1
            covered[q] = max(end, at)
            if end - start >= max(least - q, q) and (start, end + q) not in spans:
                spans.add((start, end + q))
                runs.append((start, end + q - start, q))
        if 4 * k > n or least_lag > 1 and 2 * k > n // 2:
            break
        gram = _mixed(gram[:-k]) + gram[k:]
        alive = np.sort(pos)
        alive = alive[alive < len(gram)]
        k, least_lag = 2 * k, 2 * k
    return sorted(runs, key=lambda r: (r[0], r[2]))


def runs_and_rest(text: bytes, least: int = 12) -> tuple[list[tuple[int, int, int]], bytes, int]:
    """Runs of a UTF-8 text, its words outside the repeats (joined by one space) and the number of words."""
    words = text.split()  # ASCII white space: \x20, \x09 to \x0D
    numbers: dict[bytes, int] = {}
    w = np.fromiter((numbers.setdefault(x, len(numbers)) for x in words), np.int64, len(words))
    runs = find_runs(w, least)
    if runs:
        ends = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            ends[start + period] += 1
            ends[start + length] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(ends)[:-1] == 0)]
    return runs, b" ".join(words), len(w)


def periodic_runs(docs: DataFrame, text_col: str = "text", least: int = 12, into: str = "periodic") -> DataFrame:
    """``docs`` with the struct ``into``: ``runs`` (start, length, period; by start, then period),
    ``collapsed`` (the text's words that no run contains after its first period, joined by one space)
    and ``n_words``.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text, compared exactly.  Null and empty texts have no
    words and no runs; repeated rows each get their own answer; all other columns stay untouched, and a
    column named like ``into`` (in any case) is refused.  A text is worked on by itself in memory linear
    in its length, so neither long texts nor copies of a text need a shuffle.
    """
    if into.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"column {into} is there already")

    @F.arrow_udf(RUNS_TYPE)
    def found(texts: pa.Array) -> pa.Array:
        ends, parts, rest, sizes = [0], [], [], []
        for text in texts:
            runs, kept, n = runs_and_rest(text.as_buffer().to_pybytes() if text.is_valid else b"", least)
            parts.extend(runs)
            ends.append(len(parts))
            rest.append(kept)
            sizes.append(n)
        flat = np.array(parts, np.int64).reshape(-1, 3)
        run = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], fields=list(_ARROW_RUN))
        return pa.StructArray.from_arrays(
            [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), run), pa.array(rest, pa.binary()).cast(pa.string()), pa.array(sizes, pa.int64())],
            names=["runs", "collapsed", "n_words"])

    return docs.withColumn(into, found(F.col(text_col).cast("binary")))


def run_report(periodic: Column) -> list[Column]:
    """Digest columns of the struct of :func:`periodic_runs`; the longest run is the earliest of that length."""
    runs = periodic["runs"]
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform(runs, lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    text = F.concat(F.array_join(lines, "\n"), F.when(F.size(runs) > 0, F.lit("\n")).otherwise(F.lit("")))
    return [F.size(runs).cast("long").alias("n_runs"), (-best["start"]).alias("start"), best["length"].alias("length"), (-best["period"]).alias("period"),
            F.floor(1000 * best["length"] / -best["period"]).cast("long").alias("exponent_milli"),
            F.sha2(text, 256).alias("runs_sha256"), F.sha2(periodic["collapsed"], 256).alias("collapsed_sha256")]
