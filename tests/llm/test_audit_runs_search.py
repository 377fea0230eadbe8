import hashlib
import random
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from aerolith.llm import filter_audit, periodic_runs, tree_search
from aerolith.llm.common import table
from aerolith.llm.queries import QUERIES
from tests.conftest import SF001, SF01
from tests.llm.test_pages_vectors import same_as_sql

DOCS = "doc_id long, text string, lang string, mask int, part string, n string"


# --- filter interaction audit ----------------------------------------------------------------------------------

def test_audit_equals_its_sql(spark, duck):
    same_as_sql(spark, duck, "op11_filter_audit")


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_rank_intervals_are_the_orders_that_remove_at_the_step(n):
    for mask in range(1 << n):
        step_of = {}
        for step, low, high in filter_audit.rank_intervals(mask, n):
            for rank in range(low, high):
                assert step_of.setdefault(rank, step) == step
        for rank, order in enumerate(permutations(range(n))):
            assert step_of.get(rank) == next((s for s, i in enumerate(order, 1) if mask >> i & 1), None)


def plain_masks(rows, labels):
    good = {i for i, q, t in labels if q == 1 and i is not None}
    toxic = {i for i, q, t in labels if t == 1 and i is not None}
    out = []
    for i, text, lang in rows:
        text = text or ""
        w = text.encode().split()
        first = min((j for j, t, _ in rows if (t or "") == text and j is not None), default=None)
        fails = [len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text),
                 any(c in "#$%&*|" for c in text), i is not None and i > first]
        out.append((lang or "", frozenset(x for x, f in zip("ABCDE", fails) if f), int(i in good), int(i in toxic)))
    return out


def plain_audit(masks):
    out = {}
    for part in {m[0] for m in masks}:
        own = [m for m in masks if m[0] == part]
        total = Counter()
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                here = [m for m in left if f in m[1]]
                left = [m for m in left if f not in m[1]]
                total[f] += len(here)
                out[part, "".join(order), step] = (len(left), len(here), sum(f in m[1] for m in own) - len(here), sum(m[1] == {f} for m in own),
                                                   sum(m[2] for m in here), sum(m[3] for m in here))
        for (p, order, step), v in list(out.items()):
            if p == part:
                out[p, order, step] = (*v, total[order[step - 1]])
    return out


def test_audit_of_odd_rows_equals_a_replay_of_every_order(spark):
    many = " ".join(f"w{i}" for i in range(120))
    rows = [(None, many, "en"), (None, many, None), (3, many, ""), (3, many, "en"), (3, many, "en"), (1, many, "en"), (2, None, "en"), (7, "", "de"), (9, "", None),
            (4, "A B C", "en"), (5, "a | b", "de"), (6, "é" * 11 + "\U0001F600\xa0" + "A", "en"), (8, "long word " * 60_000, "en"), (10, many.upper(), "xx"), (11, many + " $", "xx")]
    labels = [(1, 1, 1), (1, 0, 0), (2, None, 1), (3, 1, None), (None, 1, 1), (4, 0, 1), (99, 1, 1)]
    docs = spark.createDataFrame([(*r, 1, "p", "n") for r in rows], DOCS)
    named = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(filter_audit.document_masks(docs, named), weights=("good", "toxic")).collect()
    want = plain_audit(plain_masks(rows, labels))
    assert {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got} == want
    assert len(got) == len(want) == 600 * 4
    assert filter_audit.audit(filter_audit.document_masks(docs.limit(0), named.limit(0)), weights=("good",)).count() == 0
    assert filter_audit.document_masks(docs, named.limit(0)).agg({"good": "sum"}).first()[0] == 0


def test_audit_of_three_filters_and_a_null_part(spark):
    counts = spark.createDataFrame([(None, 0, 4), (None, 5, 2), (None, 5, 1), ("x", 2, 1)], "lang string, mask int, n long")
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant) for r in filter_audit.audit(counts, "PQR", "lang").collect()}
    assert len(got) == 2 * 6 * 3
    assert got[None, "PQR", 1] == (4, 3, 0) and got[None, "PQR", 3] == (4, 0, 3) and got["x", "RPQ", 3] == (0, 1, 0)
    with pytest.raises(ValueError):
        filter_audit.audit(counts, "QP", "lang")


# --- periodic runs ---------------------------------------------------------------------------------------------

def plain_runs(w, least=12):
    found, n = {}, len(w)
    w = np.asarray(w)
    for q in range(1, n // 2 + 1):
        same = np.concatenate([[False], w[:-q] == w[q:], [False]])
        edge = np.flatnonzero(same[1:] != same[:-1])
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if b - a >= max(least - q, q):
                found.setdefault((a, b + q), q)
    return sorted((a, b - a, q) for (a, b), q in found.items())


def test_runs_equal_brute_force():
    rng = random.Random(5)
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 400:
        fib.append(fib[-1] + fib[-2])
    for round_ in range(2500):
        n, letters = rng.randrange(150), rng.choice([1, 2, 2, 3, 6])
        base = [rng.randrange(letters) for _ in range(rng.randrange(1, 40))]
        short = [0, 1, 2, 3, 4, 5] * 5
        u = short[:rng.randrange(7, 30)]
        w = rng.choice([[rng.randrange(letters) for _ in range(n)], (base * 60)[:n], base + u + u + [7] + u, [9] + base[:5] * 9 + base * 2 + base[:5] * 4, fib[-1][:n]])
        if w and rng.random() < 0.5:
            w[rng.randrange(len(w))] = 3
        least = rng.choice([12, 12, 3, 7])
        assert periodic_runs.find_runs(np.array(w, np.int64), least) == plain_runs(w, least), (w, least)


def plain_report(text):
    words = (text or "").encode().split()
    numbers = {x: i for i, x in enumerate(dict.fromkeys(words))}
    runs = plain_runs([numbers[x] for x in words]) if words else []
    runs = sorted(runs, key=lambda r: (r[0], r[2]))
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    rest = b" ".join(x for i, x in enumerate(words) if i not in drop)
    return (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(rest).hexdigest())


def planted(doc_id, text):
    h, words = zlib.crc32(str(doc_id).encode()), (text or "").encode().split()
    n, g = len(words), h // 10
    if h % 10 or not n:
        return text
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return b" ".join(words[:a] + [words[a + (i - a) % p] for i in range(a, n)]).decode()


def test_run_query_equals_brute_force_on_all_documents(spark):
    rows = QUERIES["op12_periodic_runs"](spark, SF001).collect()
    texts = {r.doc_id: r.text for r in table(spark, SF001, "documents").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r)[1:] == plain_report(planted(r.doc_id, texts[r.doc_id])), r.doc_id
    assert sum(r.n_runs > 0 for r in rows) >= 15


def test_runs_of_odd_rows(spark):
    texts = [None, "", " \t\n", "a", "é\xa0x " * 12, "é\xa0x " * 12, "ab cd\x0bef\x1c " * 50_000, "w " * 300_000, " ".join(str(i % 4999) for i in range(30_000))]
    df = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(texts)], "doc_id long, text string, runs string")
    got = periodic_runs.periodic_runs(df, into="found").collect()
    assert [(r.doc_id, r.text, r.runs) for r in got] == [(i, t, "kept") for i, t in enumerate(texts)]
    found = [[tuple(x) for x in r.found.runs] for r in got]
    assert found == [[], [], [], [], [(0, 12, 1)], [(0, 12, 1)], [(0, 150_000, 3)], [(0, 300_000, 1)], [(0, 30_000, 4999)]]
    assert got[4].found.collapsed == "é\xa0x" and got[7].found.n_words == 300_000 and got[2].found.collapsed == ""
    assert periodic_runs.periodic_runs(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(df, into="RUNS")


# --- nearest neighbours ----------------------------------------------------------------------------------------

def plain_nearest(vectors, queries, k):
    """{(query id, vector): [(distance, id)...]} over distinct (id, vector) rows."""
    out = {}
    distinct = sorted({(i, tuple(x)) for i, x in vectors})
    for qid, q in {(i, tuple(x)) for i, x in queries}:
        near = [(float(np.sqrt(((np.array(x) - np.array(q)) ** 2).sum())), i) for i, x in distinct if len(x) == len(q) and (i, x) != (qid, q)]
        out[qid, q] = sorted(near)[:k]
    return out


def test_recall_on_the_given_vectors(spark):
    rows = table(spark, SF01, "embeddings").collect()
    x, ids = np.array([r.embedding for r in rows]), np.array([r.vec_id for r in rows])
    got = {}
    for r in QUERIES["op13_nearest_neighbours"](spark, SF01).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == {i for i in ids.tolist() if i % 100 == 0}
    hit = 0
    for q, found in got.items():
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        order = [i for i in np.lexsort((ids, d)) if ids[i] != q][:10]
        hit += len({ids[i] for i in order} & {v for _, v, _ in found})
        found.sort()
        assert [f[0] for f in found] == list(range(1, 11)) and [f[1:] for f in found] == sorted((f[1:] for f in found), key=lambda f: (f[1], f[0]))
        assert all(abs(d[ids == v][0] - s) < 1e-12 for _, v, s in found)
    assert hit >= 0.9 * 10 * len(got)


@pytest.mark.parametrize("rows_of_a_group", [(2, 8), (512, 1 << 16)])
def test_copies_lengths_and_odd_vectors(spark, monkeypatch, rows_of_a_group):
    monkeypatch.setattr(tree_search, "LEAST_ROWS", rows_of_a_group[0])
    monkeypatch.setattr(tree_search, "MOST_ROWS", rows_of_a_group[1])
    rng = np.random.default_rng(3)
    vectors = [(i, [0.5, 0.25, 1.0]) for i in range(40)]                                   # copies: more than k ids
    vectors += [(100 + i, (rng.integers(-4, 5, 3) + [0, 0, 9]).astype(float).tolist()) for i in range(200)]  # many ties
    vectors += [(7, [1.0, 2.0, 3.0]), (7, [1.0, 2.0, 3.0]), (400, [1.0, 2.0]), (401, [2.0, 2.0]), (402, [-0.0, 1.0]), (403, [0.0, 1.0]), (500, [1.0] * 5)]
    odd = [(600, None), (601, []), (602, [0.0, 0.0, -0.0]), (603, [1.0, None, 2.0]), (604, [float("nan"), 1.0, 1.0]), (605, [float("inf"), 1.0, 1.0]), (None, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame([(i, x, i, "s") for i, x in vectors + odd], "vec_id long, embedding array<double>, id long, digest string").repartition(7)
    asked = df.where("vec_id % 5 = 0 or vec_id in (7, 402, 403, 603)")
    got = {}
    for r in tree_search.nearest(df, asked, k=6, recall=1.0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = {}
    for (qid, q), near in plain_nearest(vectors, [v for v in vectors if v[0] % 5 == 0 or v[0] in (7, 402, 403)], 6).items():
        want.setdefault(qid, []).extend((i, v, d) for i, (d, v) in enumerate(near, 1))
    assert {q: [(a, b) for a, b, _ in sorted(v)] for q, v in got.items()} == {q: [(a, b) for a, b, _ in sorted(v)] for q, v in want.items() if v}
    assert tree_search.nearest(df.limit(0), asked, k=3).count() == 0 and tree_search.nearest(df, asked.limit(0), k=3).count() == 0


def test_widening_reaches_the_wanted_recall(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 12))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    asked = df.where("vec_id % 30 = 0")
    exact = plain_nearest([(i, v) for i, v in enumerate(x.tolist())], [(i, v) for i, v in enumerate(x.tolist()) if i % 30 == 0], 5)
    shares = []
    for recall in (0.3, 0.95):
        got = {(r.query_id, r.vec_id) for r in tree_search.nearest(df, asked, k=5, recall=recall).collect()}
        shares.append(sum((q, i) in got for (q, _), near in exact.items() for _, i in near) / (5 * len(exact)))
    assert 0.3 <= shares[0] < shares[1] and shares[1] >= 0.95


def test_leaves_larger_than_a_group_are_cut_and_others_packed():
    got = tree_search._groups({(3, 0): 4, (3, 1): 25, (3, 2): 5, (3, 3): 5, (3, 4): 1, (8, 0): 2}, {3: 10, 8: 10})
    assert got == {(3, 0): (0, 1), (3, 1): (1, 3), (3, 2): (4, 1), (3, 3): (4, 1), (3, 4): (5, 1), (8, 0): (6, 1)}
