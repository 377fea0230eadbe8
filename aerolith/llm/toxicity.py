"""Toxicity by the nearest labelled examples: exact TF-IDF cosine through an inverted index in pieces of like examples.

Terms are all words and six-character word beginnings of the training examples.  A term weighs its
IDF times one plus the root of its chi-squared with the label (in either direction), so no term is
left out and those that tell the labels apart count more.  Examples of one kind (a language, say) are a
piece of the index: terms that many of them hold are kept by example, with the piece's largest weight,
all others are added up from their postings.  A piece is completed only if its postings and its bound can
reach the k nearest.  Tasks count the terms, make the vectors and the pieces and find the examples' own
neighbours; the driver passes the pieces on one by one and holds none.  The nearest examples vote with
weights that fall with their distance, the votes are calibrated to the share of label 1 by isotonic
regression on the examples themselves (each scored without itself), and the nearest are returned
as evidence.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, replace
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aerolith.llm.common import is_held_out, materialize, remove, unused, without

WORD = re.compile(r"[^\W_]+")
STEM = 6
#: Bound of the fit: labelled training rows (those with the lowest id hashes).
MAX_EXAMPLES = 20_000
#: A term is common from this share of the examples (for their kind) or of a piece's examples (in it) on.
COMMON_SHARE, PIECE_SHARE = 0.05, 0.1
#: Texts searched at once, texts from which those alike are put together, and kinds of examples.
BATCH, POOL, KINDS = 64, 1024, 16
#: Examples of a piece of the index, texts of a training file, rows that the kinds are made of, and texts made vectors at once.
PIECE, TASK, SAMPLE, FEW = 2048, 1024, 4096, 256
NEAREST, BLOCK, EVIDENCE, DISTANCE_FLOOR = 25, 64, 3, 0.05


def term_counts(text: str | None) -> Counter:
    """Counts of words and of the beginnings of longer words (marked by a leading ``^``)."""
    words = Counter(WORD.findall(text.lower())) if text else Counter()
    out = Counter(words)
    for w, n in words.items():
        if len(w) > STEM:
            out["^" + w[:STEM]] += n
    return out


def spread(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Positions of all runs, one after the other."""
    return np.repeat(start - (np.cumsum(length) - length), length) + np.arange(length.sum())


@dataclass
class Vocabulary:
    """Ascending terms and their weights; a term's number is its place."""
    names: pa.Array
    weight: np.ndarray

    def numbers(self, asked: pa.Array) -> np.ndarray:
        """Numbers of different terms, -1 for unknown ones."""
        out = np.full(len(asked), -1, np.int32)
        place = pc.index_in(self.names, value_set=asked)
        known = np.flatnonzero(place.is_valid().to_numpy(zero_copy_only=False))
        out[place.drop_null().to_numpy()] = known
        return out

    def counts(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Known :func:`term_counts` of texts: start of each text's run; in runs, ascending: term numbers and counts."""
        words, n, size, parts = [], [], [], []
        for text in texts:
            own = Counter(WORD.findall(text.lower())) if text else {}
            words += own
            n += own.values()
            size.append(len(own))
            if len(words) > 1 << 16:  # few Python strings at a time
                parts.append(pa.array(words, pa.string()))
                words = []
        coded = pa.chunked_array([*parts, pa.array(words, pa.string())]).combine_chunks().dictionary_encode()
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.combine_chunks()
        code, own = coded.indices.to_numpy(), coded.dictionary
        longer = np.flatnonzero(pc.utf8_length(own).to_numpy() > STEM)
        stem = pc.binary_join_element_wise("^", pc.utf8_slice_codeunits(own.take(pa.array(longer)), 0, STEM), "").dictionary_encode()
        begins = np.full(len(own), -1, np.int32)
        begins[longer] = self.numbers(stem.dictionary)[stem.indices.to_numpy()]
        at, begin = self.numbers(own)[code], begins[code]
        row, n, width = np.repeat(np.arange(len(size)), size), np.array(n, np.int64), max(1, len(self.weight))
        key = np.concatenate([(row * width + at)[at >= 0], (row * width + begin)[begin >= 0]])
        n = np.concatenate([n[at >= 0], n[begin >= 0]])
        order = np.argsort(key, kind="stable")
        key, n = key[order], n[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        n = np.add.reduceat(n, first) if len(first) else n
        row, at = np.divmod(key[first], width)
        return np.append(0, np.cumsum(np.bincount(row, minlength=len(size)))), at, n

    def vectors(self, texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Term numbers and normalised weights (1 + ln tf) * weight of each text."""
        start, at, n = self.counts(texts)
        for s, e in zip(start, start[1:]):
            yield self.weighted(at[s:e], n[s:e])

    def weighted(self, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = (1 + np.log(n)) * self.weight[at]
        norm = np.sqrt((w * w).sum())
        return at, (w / norm if norm else w).astype(np.float32).astype(float)


@dataclass
class NearestExamples:
    """Labelled examples by number, their vocabulary, and the index of those that have a term (on the driver without pieces)."""
    vocabulary: Vocabulary | None
    example_ids: np.ndarray
    labels: np.ndarray
    base_rate: float                     # share of label 1 among examples without any term
    kinds: Kinds
    k: int = NEAREST
    steps: tuple[np.ndarray, np.ndarray] = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))  # calibration: vote -> probability
    index: Index | None = None
    layout: Layout | None = None
    shared: tuple[Broadcast, Broadcast | None, list[Broadcast]] | None = None  # sent to the tasks: these examples, vocabulary, pieces

    @property
    def terms(self) -> list[str]:
        return self.vocabulary.names.to_pylist()

    @property
    def weight(self) -> np.ndarray:
        return self.vocabulary.weight

    def indexed(self, pieces: Iterable[Piece]) -> NearestExamples:
        self.index = Index(pieces, self.layout.sizes, self.layout.names(), self.layout.postings, len(self.labels))
        return self

    def vector(self, counts: Counter) -> tuple[np.ndarray, np.ndarray]:
        """Term numbers and normalised weights of a text's :func:`term_counts`."""
        at = self.vocabulary.numbers(pa.array(list(counts), pa.string()))
        order = np.argsort(at)[np.count_nonzero(at < 0):]
        return self.vocabulary.weighted(at[order], np.fromiter(counts.values(), np.int64, len(counts))[order])

    def nearest(self, at: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest examples with a cosine above 0 and their cosines, exactly; ties go to the
        earlier example."""
        return self.nearest_of([(at, w)])[0]

    def nearest_of(self, queries: list[tuple[np.ndarray, np.ndarray]], without: Sequence[int] = ()) -> list[tuple[np.ndarray, np.ndarray]]:
        """``nearest`` of each query, each ``without`` the example of that number."""
        if not self.index.n:
            return [(np.zeros(0, np.int64), np.zeros(0))] * len(queries)
        return self.index.nearest_of(queries, self.k, without)

    def searched(self, queries: Iterable[tuple[np.ndarray, np.ndarray]], without: Iterable[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``nearest_of`` of many queries in their order, those alike searched together."""
        queries, without = iter(queries), iter(without) if without is not None else None
        while pool := list(islice(queries, POOL)):
            out: list = [None] * len(pool)
            leave = list(islice(without, POOL)) if without is not None else []
            kind = self.kinds.of(pool)
            for rows in (np.flatnonzero(kind == x) for x in np.unique(kind)):
                for s in range(0, len(rows), BATCH):
                    own = rows[s:s + BATCH].tolist()
                    for i, found in zip(own, self.nearest_of([pool[i] for i in own], [leave[i] for i in own] if leave else ())):
                        out[i] = found
            yield from out

    def vote(self, ids: np.ndarray, cos: np.ndarray) -> float:
        weight = 1.0 / (1.0 - np.minimum(cos, 1.0) + DISTANCE_FLOOR)
        return float((weight * self.labels[ids]).sum() / weight.sum())

    def calibrated(self, vote: float) -> float:
        return float(np.interp(vote, *self.steps))

    def score(self, texts: Iterable[str | None]) -> Iterator[tuple[float, list[dict]]]:
        """Score and evidence of each text."""
        texts = iter(texts)
        pools = iter(lambda: list(islice(texts, POOL)), [])
        for ids, cos in self.searched(v for pool in pools for v in self.vocabulary.vectors(pool)):
            evidence = [{"example_id": int(self.example_ids[i]), "cosine": float(c), "label": int(self.labels[i])}
                        for i, c in zip(ids[:EVIDENCE], cos)]
            yield (self.calibrated(self.vote(ids, cos)) if len(ids) else self.base_rate), evidence


@dataclass
class Kinds:
    """Groups of like texts, by the terms that are common among all examples."""
    common: np.ndarray                   # per term: its number among the common ones, or -1
    centres: np.ndarray

    @classmethod
    def among(cls, runs: list[tuple[np.ndarray, np.ndarray]], held_by: np.ndarray, n: int) -> Kinds:
        """Kinds of a sample of runs, for ``n`` examples; ``held_by``: examples of each term."""
        kinds = cls(_numbered(np.flatnonzero(held_by >= max(BLOCK, COMMON_SHARE * n)), len(held_by)), np.zeros((0, 0)))
        return replace(kinds, centres=_centres(_rows(runs, kinds.common)))

    def of(self, runs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        return (_rows(runs, self.common) @ self.centres.T).argmax(1) if len(self.centres) else np.zeros(len(runs), np.int64)


def _numbered(names: np.ndarray, n_terms: int) -> np.ndarray:
    """Per term: its place among ``names``, or -1."""
    out = np.full(n_terms, -1, np.int32)
    out[names] = np.arange(len(names), dtype=np.int32)
    return out


def _rows(runs: Sequence[tuple[np.ndarray, np.ndarray]], number: np.ndarray) -> np.ndarray:
    """Runs as rows over the numbered terms."""
    out = np.zeros((len(runs), int(number.max(initial=-1)) + 1), np.float32)
    for i, (at, w) in enumerate(runs):
        own = number[at]
        out[i, own[own >= 0]] = w[own >= 0]
    return out


@dataclass
class Piece:
    """Some examples of one kind as postings by term."""
    numbers: np.ndarray                  # of the examples, ascending
    names: np.ndarray                    # common terms of the piece, ascending
    terms: np.ndarray                    # all terms, ascending, and the start of each one's postings
    start: np.ndarray
    at: np.ndarray                       # in postings: example's place in the piece, weight
    w: np.ndarray

    def rare(self) -> np.ndarray:
        """Which terms are not common in the piece."""
        return ~np.isin(self.terms, self.names, assume_unique=True)


def piece_of(numbers: np.ndarray, start: np.ndarray, terms: np.ndarray, w: np.ndarray) -> Piece:
    """A piece of examples given as runs of ascending terms with normalised weights in the order of their numbers."""
    order = np.argsort(terms, kind="stable")
    held, n_held = np.unique(terms, return_counts=True)
    at = np.repeat(np.arange(len(numbers), dtype=np.uint16), np.diff(start))
    return Piece(numbers.astype(np.int32), held[n_held >= max(16, PIECE_SHARE * len(numbers))], held,
                 np.append(0, np.cumsum(n_held)).astype(np.int32), at[order], w[order])


def piece_numbers(kind: np.ndarray) -> np.ndarray:
    """The piece of each example (-1 for kind -1): examples of one kind, at most PIECE of them."""
    out = np.full(len(kind), -1, np.int32)
    for x in np.unique(kind[kind >= 0]):
        own = np.flatnonzero(kind == x)
        out[own] = out.max() + 1 + np.arange(len(own)) // PIECE
    return out


class Layout:
    """What an index needs to know of its pieces beforehand, added up piece by piece."""

    def __init__(self, n_terms: int):
        self.sizes, self.is_common, self.postings = [], np.zeros(n_terms, bool), np.zeros(n_terms, np.int32)

    def add(self, p: Piece) -> None:
        self.sizes.append(len(p.numbers))
        self.is_common[p.names] = True
        rare = p.rare()
        self.postings[p.terms[rare]] += np.diff(p.start)[rare]

    def names(self) -> np.ndarray:
        return np.flatnonzero(self.is_common)


class Index:
    """Inverted index of pieces of like examples: each piece's common terms by example, with the largest weight in the piece,
    and postings of all other terms.  Examples have places in the order of the pieces; results carry their numbers."""

    def __init__(self, pieces: Iterable[Piece], sizes: list[int], names: np.ndarray, postings: np.ndarray, n_examples: int):
        """Of pieces taken one at a time.  sizes: their examples; names: terms common in some piece; postings: of each term, where it is not."""
        self.n = sum(sizes)
        self.begin = np.append(0, np.cumsum(np.array(sizes, np.int64)))
        self.numbers = np.empty(self.n, np.int32)  # example of each place
        self.common = _numbered(names, len(postings))  # per term: its number among those common in some piece, or -1
        self.start = np.append(0, np.cumsum(postings)).astype(np.int32)  # per term: start of its postings
        self.at, self.w = np.empty(self.start[-1], np.uint16 if self.n < 1 << 16 else np.int32), np.empty(self.start[-1], np.float32)
        self.pieces, free = [], self.start[:-1].copy()
        for p, low in zip(pieces, self.begin):
            self.numbers[low:low + len(p.numbers)] = p.numbers
            rare, length = p.rare(), np.diff(p.start)
            run, to = spread(p.start[:-1][rare], length[rare]), spread(free[p.terms[rare]], length[rare])
            self.at[to], self.w[to] = p.at[run] + self.at.dtype.type(low), p.w[run]
            free[p.terms[rare]] += length[rare]
            dense, run = np.zeros((len(p.names), len(p.numbers)), np.float32), spread(p.start[:-1][~rare], length[~rare])
            dense[np.repeat(np.arange(len(p.names)), length[~rare]), p.at[run]] = p.w[run]
            self.pieces.append((self.common[p.names], dense, dense.max(1, initial=0)))
            p.terms = p.start = p.at = p.w = None  # they are here now
        self.place = _numbered(self.numbers, n_examples)
        self.needed, self.seen = 0, 0  # pairs of text and piece that were completed, and all

    def nearest_of(self, queries, k: int, without: Sequence[int] = ()) -> list[tuple[np.ndarray, np.ndarray]]:
        rows, n_blocks = len(queries), -(-self.n // BLOCK)
        part = np.zeros((rows, n_blocks * BLOCK))
        for i, (at, w) in enumerate(queries):
            length = self.start[at + 1] - self.start[at]
            run = spread(self.start[at], length)
            part[i, :self.n] = np.bincount(self.at[run], self.w[run] * np.repeat(w, length), minlength=self.n)
        if len(without):
            part[np.arange(rows), self.place[np.asarray(without)]] = -np.inf
        about, common = part.astype(np.float32), _rows(queries, self.common)
        # each text's piece of the best bound is completed first, then those whose bound can still reach the k-th best
        # block of some text; a piece without any term in common never is
        used = [np.flatnonzero(common[:, names].any(0)) for names, _, _ in self.pieces]
        bound = np.maximum.reduceat(about[:, :self.n], self.begin[:-1], axis=1)
        bound = bound + np.stack([common[:, names[u]] @ top[u] for (names, _, top), u in zip(self.pieces, used)], 1) * np.float32(1 + 1e-5)
        done, wanted = np.zeros(len(self.pieces), bool), bound > 0
        best = np.zeros((rows, 0))
        for first in (True, False):
            if not first:
                best = about.reshape(rows, n_blocks, BLOCK).max(2)
                if n_blocks >= k:
                    wanted &= bound >= np.partition(best, -k, 1)[:, -k, None] - 1e-5
            ask = wanted if not first else wanted & (bound >= bound.max(1)[:, None])
            for j in np.flatnonzero(ask.any(0) & ~done):
                done[j] = True
                names, dense, _ = self.pieces[j]
                if len(used[j]):
                    about[:, self.begin[j]:self.begin[j + 1]] += common[:, names[used[j]]] @ dense[used[j]]
        self.needed, self.seen = self.needed + int(done.sum()) * rows, self.seen + bound.size
        out = []
        best = about.reshape(rows, n_blocks, BLOCK).max(2)
        for i in range(rows):
            kth = np.partition(best[i], -k)[-k] if n_blocks >= k else 0.0
            blocks = np.flatnonzero(best[i] > max(0.0, kth - 1e-5))  # single precision: completed again below
            own = about[i].reshape(n_blocks, BLOCK)[blocks]
            if own.size > k:
                kth = max(kth, np.partition(own, -k, None)[-k])
            block, place = np.nonzero(own > max(0.0, kth - 1e-5))
            at = blocks[block] * BLOCK + place
            cos = part[i, at]
            piece = np.searchsorted(self.begin, at, "right") - 1
            for j in np.unique(piece):
                names, dense, _ = self.pieces[j]
                terms, own = used[j][common[i, names[used[j]]] != 0], piece == j
                cos[own] += (common[i, names[terms], None].astype(float) * dense[np.ix_(terms, at[own] - self.begin[j])]).sum(0)
            ids = self.numbers[at]
            top = np.lexsort((ids, -np.round(cos, 12)))[:k]  # equal examples of two pieces differ by rounding
            out.append((ids[top].astype(np.int64), cos[top]))
        return out


def _centres(common: np.ndarray) -> np.ndarray:
    """Directions of at most KINDS groups of rows: k-means by cosine from rows far apart."""
    rows = common[np.linspace(0, len(common) - 1, min(len(common), 4096)).astype(int)] if len(common) and common.shape[1] else common[:0]
    norm = np.sqrt((rows * rows).sum(1))
    rows = rows[norm > 0] / norm[norm > 0, None]
    if not len(rows):
        return rows
    chosen = [0]  # each next one is the least like those before
    near = rows @ rows[0]
    while len(chosen) < min(KINDS, len(rows)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, rows @ rows[chosen[-1]])
    centres = rows[chosen]
    for _ in range(5):
        own = (rows @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        size = np.sqrt((sums * sums).sum(1))
        centres = np.where(size[:, None] > 0, sums / np.where(size > 0, size, 1)[:, None], centres)
    return centres


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators fit of y on x, as points to interpolate between."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # mean, weight, first x, last x
    for v, t in zip(x[order], y[order].astype(float)):
        pools.append([t, 1.0, v, v])
        while len(pools) > 1 and (pools[-2][0] >= pools[-1][0] or pools[-2][3] == pools[-1][2]):
            m, n, _, last = pools.pop()
            p = pools[-1]
            p[0], p[1], p[3] = (p[0] * p[1] + m * n) / (p[1] + n), p[1] + n, last
    # one positive and one negative are added to a pool, so that few rows give no certainty
    points = [(v, (p[0] * p[1] + 0.5) / (p[1] + 1.0)) for p in pools for v in ((p[2], p[3]) if p[2] < p[3] else (p[2],))]
    return np.array([v for v, _ in points]), np.maximum.accumulate(np.array([p for _, p in points]))


def unit(start: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of weights scaled to length 1 (in single precision), and which runs are not empty or zero."""
    row = np.repeat(np.arange(len(start) - 1), np.diff(start))
    norm = np.sqrt(np.bincount(row, w * w, minlength=len(start) - 1))
    return (w / np.where(norm > 0, norm, 1.0)[row]).astype(np.float32), norm > 0


def base_rate(bare: np.ndarray, labels: np.ndarray) -> float:
    """Share of label 1 among the examples without a term (of all, if there are none at all)."""
    return float((bare.sum() + 0.5) / (len(bare) + 1.0) if len(bare) or not len(labels) else labels.mean())


def left_out_votes(model: NearestExamples, numbers: Sequence[int], runs: Iterable[tuple[np.ndarray, np.ndarray]]) -> Iterator[float]:
    """Vote on the examples of these numbers and vectors by all others (NaN: no neighbour)."""
    for ids, cos in model.searched(runs, numbers):
        yield model.vote(ids, cos) if len(ids) else float("nan")


def calibrate(model: NearestExamples, numbers: np.ndarray, votes: np.ndarray) -> None:
    seen = ~np.isnan(votes)
    if seen.any():
        model.steps = isotonic(votes[seen], model.labels[numbers[seen]])


def build(examples: list[tuple[int, int, Counter]], terms: dict[str, float], k: int = NEAREST) -> NearestExamples:
    """Model of a few ``examples`` (id, label, counts); ``terms`` gives the terms' weights.  Those without a term have no number."""
    names = {t: i for i, t in enumerate(sorted(terms))}
    weight = np.array([terms[t] for t in names])
    rows = [sorted((names[t], n) for t, n in c.items() if t in names) for _, _, c in examples]
    ids, labels = (np.array([e[i] for e, r in zip(examples, rows) if r], np.int64) for i in (0, 1))
    bare = np.array([e[1] for e, r in zip(examples, rows) if not r], np.int64)
    flat = np.array([x for r in rows for x in r], np.int64).reshape(-1, 2)
    start = np.append(0, np.cumsum([len(r) for r in rows if r], dtype=np.int64))
    at, (w, _) = flat[:, 0].astype(np.int32), unit(start, (1 + np.log(flat[:, 1])) * weight[flat[:, 0]])
    runs = [(at[s:e], w[s:e].astype(float)) for s, e in zip(start, start[1:])]
    kinds = Kinds.among(runs[::max(1, -(-len(runs) // SAMPLE))], np.bincount(at, minlength=len(weight)), len(runs))
    piece, pieces, layout = piece_numbers(kinds.of(runs)), [], Layout(len(weight))
    for own in (np.flatnonzero(piece == x) for x in np.unique(piece)):
        flat_at = spread(start[own], np.diff(start)[own])
        pieces.append(piece_of(own, np.append(0, np.cumsum(np.diff(start)[own])), at[flat_at], w[flat_at]))
        layout.add(pieces[-1])
    model = NearestExamples(Vocabulary(pa.array(names, pa.string()), weight), ids, labels, base_rate(bare, labels), kinds, k, layout=layout).indexed(pieces)
    calibrate(model, np.arange(len(ids)), np.array(list(left_out_votes(model, range(len(ids)), runs)), float))
    return model


def _flat(runs: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Start of each run, and the values of all."""
    return runs.offsets.to_numpy() - runs.offsets[0].as_py(), runs.flatten().to_numpy()


def _few(batches: Iterable[pa.RecordBatch], rows: int = POOL) -> Iterator[pa.RecordBatch]:
    return (b.slice(s, rows) for b in batches for s in range(0, b.num_rows, rows))


def _runs(batch: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray]]:
    if not batch.num_rows:
        return []
    (start, at), (_, w) = _flat(batch.column("terms")), _flat(batch.column("w"))
    return [(at[s:e], w[s:e].astype(float)) for s, e in zip(start, start[1:])]


def in_task(shared: tuple[Broadcast, Broadcast | None, list[Broadcast]], texts: bool = True) -> NearestExamples:
    """The examples with their index, which a worker makes once; with the vocabulary, if they are to meet ``texts``."""
    model, vocabulary, pieces = shared
    if model.value.index is None:
        model.value.indexed(p.value for p in pieces)
    if vocabulary and texts:
        model.value.vocabulary = vocabulary.value
    return model.value


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          modulus: int = 3, remainder: int = 1, max_examples: int = MAX_EXAMPLES) -> NearestExamples | None:
    """Fit on at most ``max_examples`` different labelled rows outside the held-out fold (lowest hashes of the id, then
    the text, where ids are shared); None without any.

    A document with several labels counts as 1 if any is 1.  Null labels, ids and texts give no
    example.
    """
    own = labels.where(F.col(label_col).isNotNull() & ~is_held_out(id_col, modulus, remainder))
    own = (own.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.when(F.col(label_col) == 1, 1).otherwise(0)).alias("label"))
           .orderBy(F.xxhash64("id"), "id").limit(max_examples))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    joined = texts.join(F.broadcast(own), "id").dropDuplicates()  # own: at most max_examples ids; rows repeated are one example
    first = joined.orderBy(F.xxhash64("id"), "id", F.xxhash64("text")).limit(max_examples)
    # numbers in the order of the ids, by a sort of at most max_examples rows
    first = first.withColumn("number", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("id", "label", F.xxhash64("text"), "text")) - 1)
    examples = materialize(first, "examples", maxRecordsPerFile=TASK)  # one task writes them, many read them
    totals = {r.label: r.n for r in examples.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n, n1 = sum(totals.values()), totals.get(1, 0)
    if not n:
        return None

    def terms_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in (b[s:s + TASK] for b in batches for s in range(0, len(b), TASK)):
            with0, with1 = Counter(), Counter()
            for text, label in zip(rows["text"], rows["label"]):
                (with1 if label else with0).update(term_counts(text).keys())
            every = list(with0.keys() | with1.keys())
            yield pd.DataFrame({"term": every, "n0": [with0[t] for t in every], "n1": [with1[t] for t in every]})

    # the vocabulary of at most max_examples texts
    found = examples.select("text", "label").mapInPandas(terms_of, "term string, n0 long, n1 long").groupBy("term").agg(
        F.sum("n0").alias("b"), F.sum("n1").alias("a")).toArrow().sort_by("term")
    names = found.column("term").combine_chunks()
    a, b = (found.column(c).to_numpy().astype(float) for c in "ab")
    del found
    c, d = n1 - a, n - n1 - b
    chi2 = n * (a * d - b * c) ** 2 / np.maximum(1.0, (a + b) * (c + d) * (a + c) * (b + d))
    weight = np.log((n + 1) / (a + b + 0.5)) * (1 + np.sqrt(chi2))
    sc = docs.sparkSession.sparkContext
    vocabulary = Vocabulary(names, weight)
    shared = sc.broadcast(vocabulary)

    def vectors_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _few(batches, FEW):
            start, at, n = shared.value.counts(rows.column("text").to_pylist())
            w, _ = unit(start, (1 + np.log(n)) * shared.value.weight[at])
            runs = [pa.ListArray.from_arrays(pa.array(start, pa.int32()), pa.array(x)) for x in (at.astype(np.int32), w)]
            yield pa.RecordBatch.from_arrays([rows.column("number"), *runs], ["number", "terms", "w"])
        pa.default_memory_pool().release_unused()  # a worker that waits keeps no more than it needs

    vectors = materialize(examples.select("number", "text").mapInArrow(vectors_of, "number int, terms array<int>, w array<float>"), "vectors")
    known = examples.select("number", "id", "label").toArrow().sort_by("number")
    ids, labels = (known.column(c).to_numpy().astype(np.int64) for c in ("id", "label"))
    bare = vectors.where(F.size("terms") == 0).select("number").toArrow().column("number").to_numpy()
    remove(examples)
    vectors = vectors.where(F.size("terms") > 0)
    sample = vectors.where(F.col("number") % max(1, -(-n // SAMPLE)) == 0).toArrow().sort_by("number")
    kinds = Kinds.among([r for batch in sample.to_batches() for r in _runs(batch)], a + b, n - len(bare))
    del sample, known

    def kind_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            yield pa.RecordBatch.from_arrays([batch.column("number"), pa.array(kinds.of(_runs(batch)), pa.int32())], ["number", "kind"])

    kind = np.full(n, -1, np.int32)
    found = vectors.mapInArrow(kind_of, "number int, kind int").toArrow()
    kind[found.column("number").to_numpy()] = found.column("kind").to_numpy()
    piece = piece_numbers(kind)

    def with_piece(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(piece[batch.column("number").to_numpy()], pa.int32()), *batch.columns], ["piece", *batch.schema.names])

    def made(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("number").combine_chunks()
        (start, at), (_, w) = (_flat(rows.column(c).chunk(0)) for c in ("terms", "w"))
        return pa.table({"made": pa.array([pickle.dumps(piece_of(rows.column("number").to_numpy(), start, at, w), 5)], pa.binary())})

    # the driver passes on one piece at a time
    pieces = vectors.mapInArrow(with_piece, "piece int, number int, terms array<int>, w array<float>").groupBy("piece").applyInArrow(made, "made binary")
    sent, layout = [], Layout(len(weight))
    for row in pieces.toLocalIterator():
        one = pickle.loads(row.made)
        layout.add(one)
        sent.append(sc.broadcast(one))
    model = NearestExamples(vocabulary, ids, labels, base_rate(labels[bare], labels), kinds, layout=layout)
    model.shared = everything = sc.broadcast(replace(model, vocabulary=None)), shared, sent

    def votes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            votes = left_out_votes(in_task(everything, texts=False), batch.column("number").to_pylist(), _runs(batch))
            yield pa.RecordBatch.from_arrays([batch.column("number"), pa.array(votes, pa.float64())], ["number", "vote"])
        pa.default_memory_pool().release_unused()

    votes = vectors.mapInArrow(votes_of, "number int, vote double").toArrow().sort_by("number")
    calibrate(model, votes.column("number").to_numpy(), votes.column("vote").to_numpy())
    remove(vectors)
    return model


def predict(docs: DataFrame, model: NearestExamples | None, text_col: str = "text", threshold: float = 0.7,
            score: str = "toxic_score", label: str = "toxic_pred", evidence: str = "toxic_evidence") -> DataFrame:
    """Add score (0 to 1), label (1 from ``threshold`` on) and the nearest examples to every row.

    All other columns stay; columns of the added names are replaced.  Null and empty texts, and
    texts without any term, get the share of label 1 among training examples without any term (0
    when there was nothing to learn from) and no evidence.  Rows are scored one by one: repeated
    rows get equal results and an empty table stays empty.
    """
    sc, steps = docs.sparkSession.sparkContext, model.steps if model else None
    shared = model and (model.shared or (sc.broadcast(model), None, []))  # of at most MAX_EXAMPLES texts
    answer = pa.struct([("score", pa.float64()), ("evidence", pa.list_(pa.struct([("example_id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())])))])

    @F.arrow_udf("struct<score:double,evidence:array<struct<example_id:long,cosine:double,label:int>>>")
    def near(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = in_task(shared) if shared else None
        if m:
            m.steps = steps
        for texts in batches:
            few = (t for s in range(0, len(texts), BATCH) for t in texts.slice(s, BATCH).to_pylist())
            found = m.score(few) if m else ((0.0, []) for _ in few)
            yield pa.array(({"score": s, "evidence": e} for s, e in found), answer)

    keep, found = without(docs, score, label, evidence), unused(docs, "__toxic")
    scored = docs.select(*keep, near(F.col(text_col)).alias(found))
    return scored.select(*keep, F.col(found)["score"].alias(score),
                         F.when(F.col(found)["score"] >= threshold, 1).otherwise(0).alias(label), F.col(found)["evidence"].alias(evidence))
