"""Approximate nearest neighbours: a hierarchical k-means tree searched best bin first.

A tree of k-means splits is fitted on a bounded sample and sent to the tasks.  Every distinct vector is
put into the leaf that it reaches; leaves are packed, in tree order, into groups of bounded size, and a
leaf larger than a group is cut over several.  A query walks the tree with a priority queue of nodes by
the distance of their centroids, and visits leaves in that order.  How many it visits is calibrated:
for a sample of the queries the exact neighbours are found against all vectors, and the number of visits
is widened until the wanted share of them lies in visited leaves.  A task holds the vectors of one group
and streams the queries that visit it, so no group of queries is ever held whole.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field
from heapq import heappop, heappush
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerolith.llm.common import materialize

#: Bounds of the fit: numbers in the sample (65,536 vectors of 64), branches of a node, rounds of k-means,
#: sampled vectors a leaf holds at least, and queries that calibrate.
SAMPLE_NUMBERS, BRANCHES, ROUNDS, LEAF_SAMPLE, CALIBRATION = 1 << 22, 16, 8, 4, 256
#: Groups of vectors: about this many, of at least and at most so many rows and at most so many numbers.
GROUPS, LEAST_ROWS, MOST_ROWS, MOST_NUMBERS = 48, 512, 1 << 16, 1 << 22


@dataclass
class Tree:
    """Nodes by number; the root is 0.  ``leaf[i]`` is the leaf's number, -1 for an inner node."""
    centroids: np.ndarray
    children: list[np.ndarray]
    leaf: np.ndarray
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # vectors in each leaf

    @property
    def n_leaves(self) -> int:
        return int(self.leaf.max()) + 1

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row: down the tree by the nearest child."""
        at, out, open_ = np.zeros(len(x), np.int64), np.empty(len(x), np.int32), [(0, np.arange(len(x)))]
        while open_:
            node, rows = open_.pop()
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
                continue
            kids = self.children[node]
            at[rows] = kids[_squares(x[rows], self.centroids[kids]).argmin(1)]
            open_.extend((int(k), rows[at[rows] == k]) for k in np.unique(at[rows]))
        return out

    def visits(self, q: np.ndarray, n: int | None, least: int) -> list[int]:
        """Leaves in best-bin-first order: at least ``n`` (None: all), and ``least`` vectors as far as there are."""
        far = _squares(q[None], self.centroids)[0].tolist()
        heap, order, held = [(far[0], 0)], [], 0
        while heap and (n is None or len(order) < n or held < least):
            _, node = heappop(heap)
            leaf = int(self.leaf[node])
            if leaf >= 0:
                order.append(leaf)
                held += int(self.sizes[leaf]) if len(self.sizes) else 0
            else:
                for kid in self.children[node].tolist():
                    heappush(heap, (far[kid], kid))
        return order


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * (x @ c.T), 0)


def _split(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """k-means from evenly spaced rows (the sample is in hash order): centroids and each row's."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(ROUNDS):
        home = _squares(x, c).argmin(1)
        n = np.bincount(home, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, home, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c, _squares(x, c).argmin(1)


def fit(x: np.ndarray, total: int) -> Tree:
    """Tree with about twice the square root of ``total`` leaves, as far as the sample ``x`` carries them."""
    most = max(LEAF_SAMPLE, len(x) / max(1.0, 2 * sqrt(total)))
    centroids, children, leaf, leaves = [x.mean(0)], [np.empty(0, np.int64)], [-1], 0
    open_ = [(0, np.arange(len(x)))]
    while open_:
        node, rows = open_.pop()
        parts = []
        if len(rows) > most:
            c, home = _split(x[rows], min(BRANCHES, ceil(len(rows) / most)))
            parts = [(c[i], rows[home == i]) for i in range(len(c)) if (home == i).any()]
        if len(parts) < 2:
            leaf[node], leaves = leaves, leaves + 1
            continue
        first = len(centroids)
        children[node] = np.arange(first, first + len(parts))
        for c, own in parts:
            centroids.append(c)
            children.append(np.empty(0, np.int64))
            leaf.append(-1)
        open_.extend((first + i, own) for i, (_, own) in reversed(list(enumerate(parts))))
    return Tree(np.array(centroids), children, np.array(leaf))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _prepared(df: DataFrame, id_col: str, x_col: str, kind: str) -> DataFrame:
    """``id, dim, x, digest`` of the vectors that take part, ``x`` as arrays of ``kind`` (float or double)."""
    def run(batches):
        for batch in batches:
            x = batch.column("x")
            nulls = np.bincount(np.repeat(np.arange(len(x)), _lengths(x)), weights=x.flatten().is_null().to_numpy(zero_copy_only=False), minlength=len(x)) > 0
            whole = batch.filter(pa.array((_lengths(x) > 0) & ~nulls))
            dims = _lengths(whole.column("x"))
            for dim in np.unique(dims):
                part = whole.filter(pa.array(dims == dim))
                m = _matrix(part.column("x")) + 0.0  # -0 is 0
                keep = np.isfinite(m).all(1) & (m != 0).any(1)
                m, own = m[keep], part.column("id").filter(pa.array(keep))
                digests = [hashlib.md5(r.tobytes()).digest() for r in m]
                yield pa.RecordBatch.from_arrays([own, pa.array(np.full(len(m), dim, np.int32)), _lists(m, kind), pa.array(digests, pa.binary())], ["id", "dim", "x", "digest"])
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(x_col).cast(f"array<{kind}>").alias("x")).where("id IS NOT NULL AND x IS NOT NULL")
    return rows.mapInArrow(run, f"id long, dim int, x array<{kind}>, digest binary")


def _lengths(column: pa.Array) -> np.ndarray:
    return np.diff(column.offsets.to_numpy())


def _lists(m: np.ndarray, kind: str) -> pa.Array:
    flat = m.ravel().astype(np.float32 if kind == "float" else np.float64)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1]), pa.int32()), pa.array(flat))


def _sampled(digest: str, wanted: int, total: int) -> Column:
    """About ``wanted`` of ``total`` rows, the lowest hashes of a column."""
    share = min(1.0, wanted / max(1, total))
    return F.lit(True) if share == 1.0 else F.xxhash64(digest) < F.lit(int(-(1 << 63) + share * (1 << 64)))


def _by_dim(batch, names: tuple[str, ...]):
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims):
        part = batch.filter(pa.array(dims == dim)) if len(dims) else batch
        yield int(dim), _matrix(part.column("x")), [part.column(n) for n in names]


def _nearest(queries: np.ndarray, x: np.ndarray, visited: np.ndarray | None, k: int):
    """(query, row, distance) of at least the k + 1 nearest visited rows of each query; ties are all there.

    Distances come from one matrix product; rows within its error of the last one are measured exactly.
    """
    size = (queries * queries).sum(1)[:, None] + (x * x).sum(1)[None]
    d = size - 2 * (queries @ x.T)
    slack = 1e-9 * size
    if visited is not None:
        d[~visited] = np.inf
    last = np.partition(d, k, axis=1)[:, k:k + 1] if x.shape[0] > k + 1 else np.full((len(d), 1), np.inf)
    which, rows = np.nonzero((d <= last + slack) & np.isfinite(d))
    apart = x[rows] - queries[which]
    return which, rows, np.sqrt((apart * apart).sum(1))


FOUND = "query_id long, query binary, vec_id long, score double, leaf int"


def _found(query_ids, query_keys, which, rows, score, ids: pa.Array, keys: pa.Array, leaves: np.ndarray) -> pa.RecordBatch:
    """One row per id of the rows found, without the query itself."""
    n = _lengths(ids)
    starts = ids.offsets.to_numpy()[:-1] - ids.offsets.to_numpy()[0]
    flat = ids.flatten().to_numpy()
    again = np.repeat(np.arange(len(rows)), n[rows])
    within = np.arange(len(again)) - np.repeat(np.cumsum(n[rows]) - n[rows], n[rows])
    vec = flat[starts[rows][again] + within]
    own = np.array([a == b for a, b in zip(query_keys.take(pa.array(which)).to_pylist(), keys.take(pa.array(rows)).to_pylist())], bool)
    qid = query_ids.to_numpy()[which]
    keep = ~(own[again] & (vec == qid[again]))
    again, vec = again[keep], vec[keep]
    return pa.RecordBatch.from_arrays(
        [pa.array(qid[again]), query_keys.take(pa.array(which[again])), pa.array(vec), pa.array(score[again]), pa.array(leaves[rows][again].astype(np.int32))],
        ["query_id", "query", "vec_id", "score", "leaf"])


def _best(found: DataFrame, k: int) -> DataFrame:
    near = Window.partitionBy("query_id", "query").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= k)


def _exact(members: DataFrame, trees: dict[int, Tree], probe: pa.Table, k: int) -> DataFrame:
    """The k nearest of a bounded table of queries against all vectors, with their leaves."""
    def run(batches):
        by_dim = {d: (q, c) for d, q, c in _by_dim(probe.combine_chunks().to_batches()[0], ("id", "digest"))}
        for batch in batches:
            for dim, x, (ids, keys) in _by_dim(batch, ("ids", "digest")):
                if dim in by_dim:
                    q, (qid, qkey) = by_dim[dim]
                    leaves = trees[dim].assign(x) if dim in trees else np.zeros(len(x), np.int32)
                    yield _found(qid, qkey, *_nearest(q, x, None, k), ids, keys, leaves)
    return _best(members.mapInArrow(run, FOUND), k)


def calibrate(members: DataFrame, trees: dict[int, Tree], probe: pa.Table, k: int, recall: float) -> dict[int, int]:
    """Leaf visits per vector length that reach ``recall`` for the probe's exact neighbours (see module)."""
    truth: dict[tuple[int, bytes], list[int]] = {}
    for r in _exact(members, trees, probe, k).select("query_id", "query", "leaf").collect():
        truth.setdefault((r.query_id, bytes(r.query)), []).append(r.leaf)
    out: dict[int, int] = {}
    ranks: dict[int, list[int]] = {}
    for r in probe.to_pylist():
        if r["dim"] in trees:
            order = {leaf: i for i, leaf in enumerate(trees[r["dim"]].visits(np.array(r["x"]), None, 0))}
            ranks.setdefault(r["dim"], []).extend(order[leaf] for leaf in truth.get((r["id"], r["digest"]), ()))
    for dim, seen in ranks.items():
        visits = 1
        while sum(x < visits for x in seen) < recall * len(seen):
            visits += 1
        out[dim] = visits
    return out


def _groups(counts: dict[tuple[int, int], int], rows_of: dict[int, int]) -> dict[tuple[int, int], tuple[int, int]]:
    """(first group, number of groups) of each (dim, leaf): leaves in tree order share a group up to its size."""
    out, group, held, last = {}, -1, 0, None
    for (dim, leaf), n in sorted(counts.items()):
        most = rows_of[dim]
        if n > most:
            out[dim, leaf] = (group + 1, ceil(n / most))
            group, held, last = group + ceil(n / most), most, dim
            continue
        if last != dim or held + n > most:
            group, held, last = group + 1, 0, dim
        out[dim, leaf] = (group, 1)
        held += n
    return out


ROWS = "grp int, role int, dim int, leaf int, id long, key binary, ids array<long>, x array<{}>, leaves array<int>"


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", x_col: str = "embedding", recall: float = 0.97) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest vectors found for each query by Euclidean distance.

    Nearest first, ties by the smaller id; ``score`` is the distance in double precision.  ``recall`` is the share of
    exact neighbours that the calibration asks for; fewer than k candidates are all returned.  Null ids and vectors
    that are null, empty, zero or hold null or non-finite numbers take no part; vectors of other lengths than
    the query's are no candidates (each length has its own tree).  A row repeated with the same id and vector counts
    once and is the query's own; rows that share an id but not the vector are different.  Empty tables
    give no rows; other columns are not read.

    Copies of a vector are one row with their k + 1 smallest ids (no later one can be among the k nearest), cut
    before the shuffle.  Only bounded data reach the driver: the fit's sample, the calibration's queries and
    their neighbours, and one count per leaf.
    """
    if k < 1 or not 0 < recall <= 1:
        raise ValueError("k must be positive and recall in (0, 1]")
    spark = vectors.sparkSession
    kind = "float" if all(t[x_col] == "array<float>" for t in (dict(vectors.dtypes), dict(queries.dtypes))) else "double"
    rows = _prepared(vectors, id_col, x_col, kind)
    ids = rows.select("digest", "id").distinct()
    first = ids.withColumn("n", F.row_number().over(Window.partitionBy("digest").orderBy("id"))).where(F.col("n") <= k + 1)
    first = first.groupBy("digest").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    members = materialize(rows.groupBy("digest").agg(F.first("dim").alias("dim"), F.first("x").alias("x")).join(first, "digest"), "vectors")
    asked = materialize(_prepared(queries, id_col, x_col, kind).dropDuplicates(["id", "digest"]), "queries")

    totals = {r.dim: r.n for r in members.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not totals:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    wanted = max(1024, SAMPLE_NUMBERS // max(totals))
    sample = members.where(_sampled("digest", wanted, sum(totals.values()))).select("digest", "dim", "x").limit(2 * wanted).toArrow().sort_by("digest")
    dims = sample.column("dim").to_numpy()
    trees = {int(d): fit(_matrix(sample.filter(pa.array(dims == d)).column("x").combine_chunks()), totals[d]) for d in np.unique(dims)}
    shipped = spark.sparkContext.broadcast(trees)

    def leaves_of(batches):
        for batch in batches:
            for dim, x, _ in _by_dim(batch, ()):
                tree = shipped.value.get(dim)
                leaf = tree.assign(x) if tree else np.zeros(len(x), np.int32)
                at, n = np.unique(leaf, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), dim, np.int32)), pa.array(at.astype(np.int32)), pa.array(n)], ["dim", "leaf", "n"])
    counted = members.select("dim", "x").mapInArrow(leaves_of, "dim int, leaf int, n long").groupBy("dim", "leaf").agg(F.sum("n").alias("n"))
    counts = {(r.dim, r.leaf): r.n for r in counted.collect()}
    for dim, tree in trees.items():
        tree.sizes = np.array([counts.get((dim, leaf), 0) for leaf in range(tree.n_leaves)])

    n_asked = asked.count()
    probe = asked.where(_sampled("digest", CALIBRATION, n_asked)).limit(2 * CALIBRATION).toArrow()
    visits = calibrate(members, trees, probe, k, recall) if probe.num_rows else {}
    share = ceil(sum(totals.values()) / GROUPS)
    where = _groups(counts, {d: min(max(share, LEAST_ROWS), MOST_ROWS, max(1, MOST_NUMBERS // d)) for d in totals})
    plan = spark.sparkContext.broadcast((trees, visits, where))

    def dealt(batches):
        """Members with their leaf and group."""
        trees, _, where = plan.value
        for batch in batches:
            for dim, x, (ids, keys) in _by_dim(batch, ("ids", "digest")):
                leaf = trees[dim].assign(x) if dim in trees else np.zeros(len(x), np.int32)
                grp = np.array([where[dim, int(a)] for a in leaf], np.int64).reshape(-1, 2)
                salt = np.array([int.from_bytes(b[:4], "little") for b in keys.to_pylist()], np.int64)
                grp = (grp[:, 0] + salt % np.maximum(grp[:, 1], 1)).astype(np.int32)
                n = len(x)
                yield _row_batch(grp, 0, dim, leaf, pa.nulls(n, pa.int64()), keys, ids, _lists(x, kind), pa.nulls(n, pa.list_(pa.int32())))

    def sent(batches):
        """Queries, once per group that holds leaves they visit."""
        trees, visits, where = plan.value
        for batch in batches:
            for dim, x, (own, keys) in _by_dim(batch, ("id", "digest")):
                tree, to, grp, leaves = trees.get(dim), [], [], []
                for i in range(len(x)):
                    by_group: dict[int, list[int]] = {}
                    for leaf in tree.visits(x[i], visits.get(dim), k + 1) if tree else [0]:
                        start, n = where.get((dim, leaf), (0, 0))
                        for g in range(start, start + n):
                            by_group.setdefault(g, []).append(leaf)
                    to.extend([i] * len(by_group))
                    grp.extend(by_group)
                    leaves.extend(by_group.values())
                for s in range(0, len(to), 4096):
                    at = pa.array(to[s:s + 4096], pa.int64())
                    yield _row_batch(np.array(grp[s:s + 4096], np.int32), 1, dim, np.full(len(at), -1, np.int32), own.take(at), keys.take(at),
                                     pa.nulls(len(at), pa.list_(pa.int64())), _lists(x[to[s:s + 4096]], kind), pa.array(leaves[s:s + 4096], pa.list_(pa.int32())))

    def search(batches):
        """Each group's members come first and are held; its queries follow and are streamed."""
        group, parts, held = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            grp, role = batch.column("grp").to_numpy(), batch.column("role").to_numpy()
            cuts = np.flatnonzero((grp[1:] != grp[:-1]) | (role[1:] != role[:-1])) + 1
            for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(grp)]):
                if grp[low] != group:
                    group, parts, held = grp[low], [], None
                piece = batch.slice(low, high - low)
                if role[low] == 0:
                    parts.append(piece)
                    continue
                if held is None and parts:
                    held, parts = _held(parts), []
                if held is not None:
                    yield from _answer(held, piece, k)

    n_groups = max((g + n for g, n in where.values()), default=1)
    dealt_rows = members.select("digest", "dim", "x", "ids").mapInArrow(dealt, ROWS.format(kind)).unionByName(asked.mapInArrow(sent, ROWS.format(kind)))
    found = dealt_rows.repartitionById(n_groups, F.col("grp")).sortWithinPartitions("grp", "role").mapInArrow(search, FOUND)
    return _best(found, k).select("query_id", "rank", "vec_id", "score")


def _row_batch(grp, role, dim, leaf, own, keys, ids, x, leaves) -> pa.RecordBatch:
    n = len(grp)
    return pa.RecordBatch.from_arrays([pa.array(grp), pa.array(np.full(n, role, np.int32)), pa.array(np.full(n, dim, np.int32)), pa.array(leaf), own, keys, ids, x, leaves],
                                      ["grp", "role", "dim", "leaf", "id", "key", "ids", "x", "leaves"])


def _held(parts: list[pa.RecordBatch]):
    t = pa.Table.from_batches(parts).combine_chunks()
    t = t.take(pa.array(np.argsort(t.column("leaf").to_numpy(), kind="stable"))).combine_chunks()
    return _matrix(t.column("x").combine_chunks()), t.column("leaf").to_numpy(), t.column("ids").combine_chunks(), t.column("key").combine_chunks()


def _answer(held, asked: pa.RecordBatch, k: int):
    x, leaf, ids, keys = held
    step = max(16, (1 << 22) // len(x))  # distances of a block of queries to the group: at most 32 MB
    for s in range(0, asked.num_rows, step):
        part = asked.slice(s, step)
        wanted = part.column("leaves")
        owner = np.repeat(np.arange(part.num_rows), _lengths(wanted))
        flat = wanted.flatten().to_numpy()
        some = np.unique(flat)
        cols = np.flatnonzero(np.isin(leaf, some))
        if not len(cols):
            continue
        seen = np.zeros((part.num_rows, len(some)), bool)
        seen[owner, np.searchsorted(some, flat)] = True
        which, rows, score = _nearest(_matrix(part.column("x")), x[cols], seen[:, np.searchsorted(some, leaf[cols])], k)
        yield _found(part.column("id"), part.column("key"), which, cols[rows], score, ids, keys, leaf)
