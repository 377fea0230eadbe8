"""Near-duplicate embeddings: inverted lists, product-quantised residuals, exact cosine rerank.

Distinct vectors are written once, into blocks of one label and length (small labels share a block), a file each; a
block's vectors lie by their nearest coarse centroid (inverted lists), with their residuals as sub-space codes and the
size of the quantisation error.  Pairs of blocks are dealt to tasks, which read the two files: vectors are not sent
to the lists they probe, so the disk holds each one a fixed number of times however many lists a link can reach.

Two lists meet with those vectors that lie near enough to the boundary for a link to cross it.  Members' distances come
from their codes (asymmetric: the other vector is not quantised), in one matrix product with what the codes stand for;
pairs that the quantisation error cannot rule out are reranked by the exact cosine in double precision.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.llm.common import forest, fresh_path, group_starts, materialize, remove_folder, shuffles_end, whole_groups
from aerolith.llm.components import connected_components

#: Bounds of the fit: vectors sampled (lowest hashes of the vectors), lists, sub-spaces, codes a sub-space.
SAMPLE, MAX_LISTS, SUBSPACES, CODES, ROUNDS = 20_000, 256, 8, 64, 8
#: Share of a link's length that may point straight across a list boundary.  1 loses nothing; noise
#: spread over the dimensions has a share of about 1 / sqrt(dimensions), 0.125 at 64.
REACH = 0.6
#: A block has at most so many vectors and numbers; up to these, the table is cut into about so many blocks of at
#: least so many vectors.  A list has about so many vectors of a full block.
BLOCK_ROWS, BLOCK_NUMBERS, BLOCKS, LEAST_ROWS, LIST_ROWS = 1 << 16, 1 << 22, 24, 256, 512
#: Vectors that meet in one matrix product, vectors looked at together elsewhere, and links kept before they become a forest.
TILE, SLICE_ROWS, HELD_LINKS = (1024, 4096), 8192, 1 << 20
#: Tasks that the pairs of blocks are dealt to.
MOST_TASKS = 4096


@dataclass(frozen=True)
class Quantiser:
    dim: int
    centroids: np.ndarray            # lists x dim
    cuts: tuple[int, ...]            # sub-space borders
    codebooks: tuple[np.ndarray, ...]  # codes x sub-space dim

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Squared distances of unit rows to all centroids."""
        c = self.centroids
        return np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * x @ c.T, 0)

    def encode(self, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of residuals and the norm of what the codes leave out."""
        codes = np.zeros((len(residual), len(self.codebooks)), np.uint8)
        left = np.zeros(len(residual))
        for s, book in enumerate(self.codebooks):
            part = residual[:, self.cuts[s]:self.cuts[s + 1]]
            d = (part * part).sum(1)[:, None] + (book * book).sum(1)[None, :] - 2 * part @ book.T
            codes[:, s] = d.argmin(1)
            left += ((part - book[codes[:, s]]) ** 2).sum(1)
        return codes, np.sqrt(left)

    def decode(self, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """What the codes of members stand for: the distance to it is the sum of the sub-spaces' table distances."""
        out = self.centroids[lists]
        for s, book in enumerate(self.codebooks):
            out[:, self.cuts[s]:self.cuts[s + 1]] += book[codes[:, s]]
        return out

    def reaches(self, x: np.ndarray, lists: np.ndarray, across: float) -> np.ndarray:
        """Which lists are within ``across`` of unit rows, measured straight to their boundary with the row's own list."""
        c, at = self.centroids, np.arange(len(x))
        apart = np.stack([np.sqrt(((c - own) ** 2).sum(1)) for own in c])
        d = self.distances(x)
        out = d - d[at, lists][:, None] <= 2 * across * apart[lists] + 1e-9
        out[at, lists] = True
        return out


def k_means(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Plain k-means from evenly spaced rows (the sample is in hash order)."""
    c = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        home = ((c * c).sum(1)[None, :] - 2 * x @ c.T).argmin(1)
        n = np.bincount(home, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, home, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def fit(x: np.ndarray, block_rows: int) -> Quantiser:
    """Lists (of about LIST_ROWS vectors of a block, at most MAX_LISTS) and codebooks."""
    dim = x.shape[1]
    lists = max(1, min(MAX_LISTS, block_rows // LIST_ROWS, len(x) // 4))
    centroids = k_means(x, lists)
    home = ((centroids * centroids).sum(1)[None, :] - 2 * x @ centroids.T).argmin(1)
    residual = x - centroids[home]
    cuts = tuple(np.linspace(0, dim, min(SUBSPACES, dim) + 1).astype(int).tolist())
    return Quantiser(dim, centroids, cuts, tuple(k_means(residual[:, a:b], CODES) for a, b in zip(cuts, cuts[1:])))


def unit(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.float64)
    return x / np.sqrt((x * x).sum(1))[:, None]


# --- vectors to blocks -----------------------------------------------------------------------------------------

def _usable(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of a batch that can link, by vector length: their places, vectors (-0 as 0) and 128-bit digests."""
    column = batch.column("x")
    lengths = np.diff(column.offsets.to_numpy()) * column.is_valid().to_numpy(zero_copy_only=False)
    flat = column.flatten()
    hole = np.zeros(len(column), bool)
    hole[np.repeat(np.arange(len(column)), lengths)[flat.is_null().to_numpy(zero_copy_only=False)]] = True
    fit_for = (lengths > 0) & ~hole & batch.column("grp").is_valid().to_numpy(zero_copy_only=False)
    for dim in np.unique(lengths[fit_for]):
        at = np.flatnonzero(fit_for & (lengths == dim))
        x = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), dim) + 0.0
        keep = np.isfinite(x).all(1) & (x != 0).any(1)
        at, x = at[keep], np.ascontiguousarray(x[keep])
        if len(at):
            yield at, x, np.frombuffer(b"".join(hashlib.md5(r).digest() for r in x), np.int64).reshape(-1, 2)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every row without its vector; no length for rows that cannot link."""
    for batch in batches:
        dim, digest = np.zeros(batch.num_rows, np.int32), np.zeros((batch.num_rows, 2), np.int64)
        for at, x, found in _usable(batch):
            dim[at], digest[at] = x.shape[1], found
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("grp"), pa.array(dim, mask=dim == 0), pa.array(digest[:, 0]), pa.array(digest[:, 1])],
                                         ["vec_id", "grp", "dim", "h1", "h2"])


def _sampled(batches: Iterator[pa.RecordBatch], shares: dict[int, float]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, x, digest in _usable(batch):
            share = shares.get(x.shape[1], 0.0)
            low = digest[:, 0] <= share * 2.0 ** 64 - 2.0 ** 63
            yield pa.RecordBatch.from_arrays([pa.array(np.full(int(low.sum()), x.shape[1], np.int32)), pa.array(digest[low, 0]), pa.array(digest[low, 1]), _lists(x[low])], ["dim", "h1", "h2", "x"])


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))


def _lowest(vec_id: pa.Array, starts: np.ndarray) -> pa.Array:
    """Smallest id of each run of rows, null where it has none."""
    known = vec_id.is_valid().to_numpy(zero_copy_only=False)
    low = np.minimum.reduceat(np.where(known, vec_id.fill_null(0).to_numpy(), np.iinfo(np.int64).max), starts)
    return pa.array(low, mask=~np.logical_or.reduceat(known, starts))


@dataclass(frozen=True)
class Layout:
    """Blocks of labels too large for one (first block, number), and how many blocks the other labels share."""
    cut: dict[tuple[int, int], tuple[int, int]]
    first_shared: int
    shared: int

    def block(self, grp: int, dim: int, digest: np.ndarray) -> np.ndarray:
        first, n = self.cut.get((grp, dim), (self.first_shared + (grp ^ dim) % max(1, self.shared), 1))
        return (first + (digest[:, 1].view(np.uint64) % np.uint64(n)).astype(np.int64)).astype(np.int32)

    def meetings(self) -> Iterator[tuple[int, int]]:
        for first, n in self.cut.values():
            yield from ((first + i, first + j) for i in range(n) for j in range(i, n))
        yield from ((b, b) for b in range(self.first_shared, self.first_shared + self.shared))


def _dealt(layout: Layout):
    """Vectors with their block; copies inside a batch are combined, so that a common vector is sent a few times."""
    def run(batches):
        for batch in batches:
            for at, x, digest in _usable(batch):
                grp = batch.column("grp").take(pa.array(at)).to_numpy()
                order = np.lexsort((digest[:, 1], digest[:, 0], grp))
                at, x, digest, grp = at[order], x[order], digest[order], grp[order]
                starts = _changes(grp, digest[:, 0], digest[:, 1])
                low = _lowest(batch.column("vec_id").take(pa.array(at)), starts)
                copies = np.diff([*starts, len(at)])
                x, digest, grp = x[starts], digest[starts], grp[starts]
                block = np.zeros(len(grp), np.int32)
                bounds = _changes(grp)
                for s, e in zip(bounds, [*bounds[1:], len(grp)]):
                    block[s:e] = layout.block(int(grp[s]), x.shape[1], digest[s:e])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block), pa.array(grp), pa.array(np.full(len(grp), x.shape[1], np.int32)), pa.array(digest[:, 0]), pa.array(digest[:, 1]), low, pa.array(copies), _lists(x)],
                    ["block", "grp", "dim", "h1", "h2", "low", "copies", "x"])
    return run


def _changes(*columns: np.ndarray) -> np.ndarray:
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


CLASSES = "cid long, grp long, dim int, h1 long, h2 long, low long, copies long, file string"


def _written(quantisers: dict[int, Quantiser], folder: str):
    """Blocks written to files below ``folder``, one Arrow batch a vector length, rows by label and list; returns the
    classes without their vectors, the block's file with the first of them."""
    def block_of(t: pa.Table):
        block, name = t.column("block")[0].as_py(), uuid.uuid4().hex  # a retried task writes other names
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, writer, n = [], None, 0
        # one length after another: a schema for each, as the vectors have a fixed size
        starts = group_starts(t, ["dim"])
        with store.open_output_stream(f"{root}/{name}") as f:
            for s, e in zip(starts, [*starts[1:], t.num_rows]):
                part = t.slice(s, e - s).combine_chunks()
                own = _changes(*(part.column(k).to_numpy() for k in ("grp", "h1", "h2")))
                low, copies = _lowest(part.column("low").combine_chunks(), own), np.add.reduceat(part.column("copies").to_numpy(), own)
                part = part.take(pa.array(own))
                dim, x = part.column("dim")[0].as_py(), _rows_of(part.column("x"))
                q, lists = quantisers.get(dim), np.zeros(len(x), np.int32)
                codes, left = np.zeros((len(x), len(q.codebooks) if q else 0), np.uint8), np.zeros(len(x))
                for a in range(0, len(x) if q else 0, SLICE_ROWS):
                    u = unit(x[a:a + SLICE_ROWS])
                    lists[a:a + SLICE_ROWS] = home = q.distances(u).argmin(1)
                    codes[a:a + SLICE_ROWS], left[a:a + SLICE_ROWS] = q.encode(u - q.centroids[home])
                grp = part.column("grp").to_numpy()
                order = np.lexsort((lists, grp))
                cid = (np.int64(block) << 32) + n + np.arange(len(x))
                n += len(x)
                rows = pa.RecordBatch.from_arrays(
                    [pa.array(grp[order]), pa.array(lists[order]), pa.array(cid), pa.array(copies[order]), pa.array(left[order].astype(np.float32)),
                     pa.FixedSizeListArray.from_arrays(pa.array(codes[order].ravel()), codes.shape[1]), pa.FixedSizeListArray.from_arrays(pa.array(x[order].ravel()), dim)],
                    ["grp", "list", "cid", "copies", "left", "codes", "x"])
                with pa.ipc.new_stream(f, rows.schema) as writer:
                    writer.write_batch(rows)
                at = pa.array(order)
                file = pa.array([None if out or i else name for i in range(len(x))], pa.string())
                out.append(pa.RecordBatch.from_arrays([pa.array(cid), pa.array(grp[order]), pa.array(np.full(len(x), dim, np.int32)), part.column("h1").combine_chunks().take(at),
                                                       part.column("h2").combine_chunks().take(at), low.take(at), pa.array(copies[order]), file],
                                                      ["cid", "grp", "dim", "h1", "h2", "low", "copies", "file"]))
        return out

    def run(batches):
        for t in whole_groups(batches, ["block"]):
            starts = group_starts(t, ["block"])
            for s, e in zip(starts, [*starts[1:], t.num_rows]):
                yield from block_of(t.slice(s, e - s))
    return run


def _rows_of(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


# --- links of blocks -------------------------------------------------------------------------------------------

class Members:
    """Vectors of one label and length, by list, as they are compared: exact, by their codes, by the lists they reach."""

    def __init__(self, q: Quantiser | None, lists: np.ndarray, codes: np.ndarray, left: np.ndarray, x: np.ndarray, least: float, reach: float):
        n = len(x)
        self.x, self.norm = x, np.concatenate([np.sqrt((x[s:s + SLICE_ROWS].astype(np.float64) ** 2).sum(1)) for s in range(0, n, SLICE_ROWS)])
        #: A vector at the link's angle from a member is nearest to opposite of what the codes stand for in the plane of
        #: both: its product with the latter is no smaller than with that one (less 1e-3, for single precision), else no
        #: link.  The last column is the difference; one row beyond the last meets nothing.
        self.exact, self.coded = np.ones((n, x.shape[1] + 1), np.float32), np.zeros((n + 1, x.shape[1] + 1), np.float32)
        near = []
        for s in range(0, n, SLICE_ROWS):
            at = slice(s, min(n, s + SLICE_ROWS))
            u = self.unit(np.arange(at.start, at.stop))
            stands = u if q is None else q.decode(lists[at], codes[at])
            self.exact[at, :-1], self.coded[at, :-1] = u, stands
            square = (stands * stands).sum(1)
            along = (1 + square - left[at] ** 2) / 2  # of what the codes stand for, in the member's direction
            across = np.sqrt(np.maximum(square - along ** 2, 0))
            lowest = np.where(along >= -least * np.sqrt(square), least * along - sqrt(1 - least * least) * across, -np.sqrt(square))
            self.coded[at, -1] = 1e-3 - lowest
            if q is not None and n >= len(q.centroids) * LIST_ROWS // 4:
                near.append(q.reaches(u, lists[at], sqrt(2 - 2 * least) * reach))
        self.coded[n, -1] = -np.inf
        #: list -> (its rows, which of them reach each list); few vectors are one list
        self.lists: dict[int, tuple[np.ndarray, np.ndarray | None]] = {0: (np.arange(n), None)}
        if near:
            near = np.concatenate(near)
            self.lists = {k: (at, np.ascontiguousarray(near[at].T)) for k in np.unique(lists).tolist() for at in [np.flatnonzero(lists == k)]}

    def __len__(self) -> int:
        return len(self.x)

    def unit(self, rows: np.ndarray) -> np.ndarray:
        return self.x[rows].astype(np.float64) / self.norm[rows][:, None]


def meeting(a: Members, b: Members) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Rows of ``a`` and of ``b`` that lists with a common boundary compare, and whether they are of one list of one block:
    a link that points across the boundary with at most the given share of its length has both ends that near to it."""
    for i, (at_a, near_a) in a.lists.items():
        for j, (at_b, near_b) in b.lists.items():
            if a is b and j < i:
                continue
            rows = at_a if near_a is None or near_b is None else at_a[near_a[j]]
            others = at_b if near_a is None or near_b is None else at_b[near_b[i]]
            for s in range(0, len(rows), TILE[0]):
                for e in range(0, len(others), TILE[1]):
                    yield rows[s:s + TILE[0]], others[e:e + TILE[1]], a is b and i == j


def tile_links(a: Members, b: Members, rows: np.ndarray, others: np.ndarray, same: bool, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``a`` and of ``b`` (in order, if they are of the same list) at a cosine of ``least`` or more in double precision."""
    wide = np.full(-(-len(others) // 8) * 8, len(b), np.int64)
    wide[:len(others)] = others
    maybe = a.exact.take(rows, 0) @ b.coded.take(wide, 0).T >= 0
    word = np.flatnonzero(maybe.view(np.uint64) != 0)  # eight at a time: few are set
    at, inner = np.nonzero(maybe.reshape(-1, 8)[word])
    place = word[at] * 8 + inner
    i, j = rows[place // len(wide)], wide[place % len(wide)]
    if same:
        once = i < j
        i, j = i[once], j[once]
    if 16 * len(i) > maybe.size:
        ok = (a.unit(rows) @ b.unit(others).T)[np.searchsorted(rows, i), np.searchsorted(others, j)] >= least
    else:
        # in single precision first, 1 above the cosine
        ok = np.concatenate([np.einsum("ij,ij->i", a.exact.take(i[k:k + 65536], 0), b.exact.take(j[k:k + 65536], 0)) for k in range(0, len(i), 65536)] or [np.zeros(0)]) >= 1 + least - 1e-5
        i, j = i[ok], j[ok]
        ok = np.concatenate([np.einsum("ij,ij->i", a.unit(i[k:k + 65536]), b.unit(j[k:k + 65536])) for k in range(0, len(i), 65536)] or [np.zeros(0)]) >= least
    return i[ok], j[ok]


def links(a: Members, b: Members, copies_a: np.ndarray, copies_b: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Copies linked to each row of ``a`` and then of ``b`` (none twice, if they are one) and a forest of the links."""
    shift = 0 if a is b else len(a)
    linked = np.zeros(shift + len(b), np.int64)
    left, right, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0

    def as_forest():
        label = forest(len(linked), np.concatenate(left), np.concatenate(right))
        up = np.flatnonzero(label != np.arange(len(label)))
        return [up], [label[up]]
    for rows, others, same in meeting(a, b):
        i, j = tile_links(a, b, rows, others, same, least)
        if not len(i):
            continue
        np.add.at(linked, i, copies_b[j])
        np.add.at(linked, j + shift, copies_a[i])
        left.append(i)
        right.append(j + shift)
        held += len(i)
        if held > HELD_LINKS:
            left, right = as_forest()
            held = 0
    (up,), (down,) = as_forest()
    return linked, up, down


def _block_links(quantisers: dict[int, Quantiser], folder: str, least: float, reach: float):
    """Per vector the copies linked to it, as (cid, cid, n), and a forest of the links, as (a, b, 0)."""
    def batches_of(name: str) -> list[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        out = []
        with store.open_input_file(f"{root}/{name}") as f:
            end = f.size()
            while f.tell() < end:
                with pa.ipc.open_stream(f) as r:
                    out += list(r)
        return out

    def members(batch: pa.RecordBatch) -> Iterator[tuple[Members, np.ndarray, np.ndarray]]:
        dim = batch.column("x").type.list_size
        starts = _changes(batch.column("grp").to_numpy())
        for s, e in zip(starts, [*starts[1:], batch.num_rows]):
            part = batch.slice(s, e - s)
            codes = part.column("codes").flatten().to_numpy().reshape(e - s, part.column("codes").type.list_size)
            yield (Members(quantisers.get(dim), part.column("list").to_numpy(), codes, part.column("left").to_numpy().astype(np.float64), part.column("x").flatten().to_numpy().reshape(e - s, dim), least, reach),
                   part.column("cid").to_numpy(), part.column("copies").to_numpy())

    def found(a, b):
        (ma, cid_a, copies_a), (mb, cid_b, copies_b) = a, b
        linked, up, down = links(ma, mb, copies_a, copies_b, least)
        cid = cid_a if ma is mb else np.concatenate([cid_a, cid_b])
        some = np.flatnonzero(linked)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([cid[some], cid[up]])), pa.array(np.concatenate([cid[some], cid[down]])),
                                           pa.array(np.concatenate([linked[some], np.zeros(len(up), np.int64)]))], ["a", "b", "n"])

    def run(batches):
        name, held = None, []
        for batch in batches:
            for one, other in zip(batch.column("one").to_pylist(), batch.column("other").to_pylist()):
                if one == other:
                    for part in batches_of(one):
                        for own in members(part):
                            if len(own[0]) > 1:
                                yield found(own, own)
                    continue
                if one != name:  # blocks of one label and length
                    name, held = one, [m for part in batches_of(one) for m in members(part)]
                for a, b in zip(held, (m for part in batches_of(other) for m in members(part))):
                    yield found(a, b)
    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                    least: float = 0.93, reach: float = REACH, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per input row: ``vec_id, n_links, component_id, kept``.

    Vectors of equal length and equal non-null label link at a cosine of ``least`` or more (in
    double precision).  ``n_links`` counts the other vectors linked directly (copies too),
    ``component_id`` is the smallest vec_id reachable, ``kept`` whether that is the vector itself.
    Null and zero vectors, those with null or non-finite components and those with a null label
    link with nothing.  A null vec_id is never a component id unless nothing else is reachable.
    Repeated rows are each returned and count as vectors of their own.  Empty tables give no rows;
    only the named columns are read.

    Distinct vectors (by a 128-bit digest) are compared, copies are counted.  ``reach`` 1 finds every link; below
    it a link may be missed when it points nearly straight across the boundary of two lists.
    """
    spark = vectors.sparkSession
    kind = "float" if dict(vectors.dtypes).get(vector_col) == "array<float>" else "double"
    label = F.col(label_col)
    if vectors.select(label).dtypes[0][1] in ("float", "double"):
        label = label + F.lit(0.0)  # -0.0 and 0.0 are one value
    raw = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(label.isNotNull(), F.xxhash64(label.cast("string"))).alias("grp"),
                         F.col(vector_col).cast(f"array<{kind}>").alias("x"))
    keys = materialize(raw.mapInArrow(_keys, "vec_id long, grp long, dim int, h1 long, h2 long"), "keys")
    sizes = keys.where("dim IS NOT NULL").groupBy("grp", "dim").agg(F.count(F.lit(1)).alias("n"))
    totals = {r.dim: r.n for r in sizes.groupBy("dim").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "dim").limit(16).collect()}
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    even = max(LEAST_ROWS, ceil(total / BLOCKS))

    def rows_of(dim: int) -> int:
        return max(1, min(block_rows, BLOCK_NUMBERS // dim, even))
    quantisers = _quantisers(raw, kind, totals, rows_of)
    layout = _layout(sizes, block_rows, even)

    folder = fresh_path(spark, "blocks")
    dealt = raw.mapInArrow(_dealt(layout), f"block int, grp long, dim int, h1 long, h2 long, low long, copies long, x array<{kind}>")
    whole = dealt.repartition("block").sortWithinPartitions("block", "dim", "grp", "h1", "h2")
    with shuffles_end(spark):
        classes = materialize(whole.mapInArrow(_written(quantisers, folder), CLASSES), "vectors")
    files = {r.block: r.file for r in classes.where("file IS NOT NULL").select(F.shiftright("cid", 32).alias("block"), "file").collect()}
    pairs = [(files[i], files[j]) for i, j in layout.meetings() if i in files and j in files]
    met = spark.createDataFrame(pairs, "one string, other string").repartition(max(1, min(len(pairs), MOST_TASKS)))
    found = materialize(met.mapInArrow(_block_links(quantisers, folder, least, reach), "a long, b long, n long"), "links")
    remove_folder(spark, folder)

    direct = found.where("a = b").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("linked"))
    with shuffles_end(spark):
        parts = connected_components(found.where("a <> b").select("a", "b")).withColumnRenamed("node", "cid")
    labelled = (classes.drop("file").join(parts, "cid", "left").join(direct, "cid", "left")
                .withColumn("component", F.coalesce("component", "cid")))
    lowest = labelled.groupBy("component").agg(F.min("low").alias("component_id"))
    same = ["grp", "dim", "h1", "h2"]
    by_vector = labelled.join(lowest, "component").select(*same, (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    linked = keys.where("dim IS NOT NULL").join(by_vector, same).select("vec_id", "n_links", "component_id")
    alone = keys.where("dim IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _quantisers(raw: DataFrame, kind: str, totals: dict[int, int], rows_of) -> dict[int, Quantiser]:
    """Fits on the distinct vectors of lowest digests, about SAMPLE of each common length."""
    shares = {dim: min(1.0, SAMPLE / n) for dim, n in totals.items()}
    drawn = raw.mapInArrow(lambda batches: _sampled(batches, shares), f"dim int, h1 long, h2 long, x array<{kind}>").dropDuplicates(["dim", "h1", "h2"])
    out = {}
    for dim in totals:
        sample = drawn.where(F.col("dim") == dim).limit(2 * SAMPLE).toArrow().sort_by([("h1", "ascending"), ("h2", "ascending")])
        if sample.num_rows:
            out[dim] = fit(unit(_rows_of(sample.column("x"))), rows_of(dim))
    return out


def _layout(sizes: DataFrame, block_rows: int, even: int) -> Layout:
    most = F.greatest(F.lit(1), F.least(F.lit(block_rows), F.floor(F.lit(BLOCK_NUMBERS) / F.col("dim")), F.lit(even)))
    sized = sizes.select("grp", "dim", F.ceil(F.col("n") / most).alias("blocks"), (F.col("n") / most).alias("share"))
    cut, first = {}, 0
    for r in sized.where("blocks > 1").orderBy("grp", "dim").collect():  # fewer than twice the blocks
        cut[r.grp, r.dim] = first, r.blocks
        first += r.blocks
    # a label in one block: with twice as many blocks as they fill, chance seldom overfills one
    share = sized.where("blocks = 1").agg(F.coalesce(F.sum("share"), F.lit(0.0))).first()[0]
    return Layout(cut, first, ceil(2 * share))


ORACLE = """
WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
u AS (SELECT vec_id, label, x, sqrt(list_dot_product(x, x)) AS norm FROM v
      WHERE label IS NOT NULL AND x IS NOT NULL AND len(list_filter(x, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND list_dot_product(x, x) > 0),
e AS (SELECT a.vec_id AS s, b.vec_id AS t FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
      WHERE list_dot_product(a.x, b.x) / (a.norm * b.norm) >= 0.93),
n AS (SELECT s, count(*) AS n_links FROM e GROUP BY s),
c AS (WITH RECURSIVE r(node, reached) AS (SELECT s, s FROM e UNION SELECT r.node, e.t FROM r JOIN e ON r.reached = e.s) SELECT node, min(reached) AS low FROM r GROUP BY node)
SELECT v.vec_id, coalesce(n_links, 0) AS n_links, coalesce(low, v.vec_id) AS component_id, coalesce(low, v.vec_id) = v.vec_id AS kept
FROM v LEFT JOIN n ON n.s = v.vec_id LEFT JOIN c ON c.node = v.vec_id
"""
