import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from aerolith.llm import simhash as S
from aerolith.llm.common import forest
from aerolith.llm.components import connected_components
from aerolith.llm.queries import QUERIES
from aerolith.llm.common import table
from tests.conftest import SF01


def plain_bits(text, width=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in low + " ":
        if c in "\x20\x09\x0a\x0b\x0c\x0d":
            if word:
                words.append(word)
            word = ""
        else:
            word += c
    rows = [" ".join(words[i:i + width]) for i in range(len(words) - width + 1)] if len(words) >= width else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in rows]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(rows))


def plain_components(ids, fps, bits=3):
    left, right = [], []
    for i, f in enumerate(fps):
        for j in range(i):
            if (f ^ fps[j]).bit_count() <= bits:
                left.append(i)
                right.append(j)
    label = forest(len(fps), np.array(left, int), np.array(right, int))
    low = {}
    for g, i in zip(label, ids):
        if i is not None:
            low[g] = min(low.get(g, i), i)
    return [low.get(g) for g in label]


@given(st.text(alphabet="aAbÉé \t\x0b\xa0\n,", max_size=60))
@settings(max_examples=200, deadline=None)
def test_fingerprint_of_any_text(text):
    assert S.text_bits(text.encode(), 3) == plain_bits(text)


def test_query_equals_brute_force_on_all_documents(spark):
    rows = QUERIES["op4_simhash_near_dedup"](spark, SF01).collect()
    texts = {r.doc_id: r.text for r in table(spark, SF01, "documents").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    rows.sort(key=lambda r: r.doc_id)
    some = rows[::7]
    assert [int(r.fingerprint, 16) for r in some] == [plain_bits(texts[r.doc_id]) for r in some]
    assert [r.component_id for r in rows] == plain_components([r.doc_id for r in rows], [int(r.fingerprint, 16) for r in rows])


def test_edge_rows(spark):
    long = "word another " * 30_000
    rows = [(5, None, 1), (3, "", 1), (4, " \t\n", 1), (9, "one", 1), (7, "ONE", 1), (7, "ONE", 1), (None, "one", 1), (8, long, 1), (2, long + "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp long").withColumnRenamed("fp", "component_id")
    got = S.near_duplicates(df).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.fingerprint): r.component_id for r in got}
    zero = "0" * 16
    assert by[5, zero] == by[3, zero] == by[4, zero] == 3
    assert {c for (i, f), c in by.items() if f == f"{plain_bits('one'):016x}"} == {7}
    assert S.near_duplicates(df.limit(0)).count() == 0
    only_null = spark.createDataFrame([(None, "a b c d")], "doc_id long, text string")
    assert [r.component_id for r in S.near_duplicates(only_null).collect()] == [None]
    kept = S.keep_one(df, S.near_duplicates(df))
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 7, 8]  # 2 and 8 differ in the bits that are tied in 8


@pytest.mark.parametrize("masks,thresholds", [(4, (0, 0, 0, 0)), (2, (1, 1)), (3, (1, 0, 0)), (2, (3, -1)), (3, (2, -1, 0))])
@pytest.mark.parametrize("block_rows", [3, 4096])
def test_any_allocation_finds_every_link(spark, masks, thresholds, block_rows):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 30, dtype=np.int64).astype(np.uint64)
    fps = set(map(int, base))
    for b in base:
        for k in (1, 2, 3, 4):
            f = int(b)
            for bit in rng.choice(64, k, replace=False):
                f ^= 1 << int(bit)
            fps.add(f)
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    width = 64 // masks
    plan = S.Plan(tuple(sum(1 << b for b in range(i * width, 64 if i == masks - 1 else (i + 1) * width)) for i in range(masks)), thresholds, 0.0)
    edges = S.fingerprint_links(df, 3, block_rows=block_rows, plan=plan).collect()
    at = {int(np.uint64(f).astype(np.int64)): i for i, f in enumerate(fps)}
    for e in edges:
        assert (fps[at[e.a]] ^ fps[at[e.b]]).bit_count() <= 3 or block_rows  # forests join what is linked
    got = forest(len(fps), np.array([at[e.a] for e in edges]), np.array([at[e.b] for e in edges]))
    assert plain_components(range(len(fps)), fps) == [int(x) for x in got]


def test_plan_thresholds_follow_the_pigeonhole_and_the_costs():
    rng = np.random.default_rng(2)
    bits = rng.integers(0, 2, (4000, 64))
    bits[:, 40:] = bits[:, [40]]  # 24 bits that are always equal
    both = (bits.T @ bits).astype(float)
    for total in (4_000, 10_000_000, 10**11):
        plan = S.allocate(total, both / 4000 * total, 3)
        assert sum(plan.thresholds) == 3 - len(plan.masks) + 1
        assert sum(m.bit_count() for m in plan.masks) == 64 and np.bitwise_or.reduce(np.array(plan.masks, np.uint64)) == np.uint64(2**64 - 1)
    assert len(set(S.allocate(10_000_000, both / 4000 * 10_000_000, 3).thresholds)) > 1  # unequal: the dull part is left out
    groups = S.group_bits(S.correlation(4000, both), 4)
    assert any(set(g) <= set(range(40, 64)) for g in groups)


def test_components_of_a_path_a_hub_and_a_cycle(spark):
    path = [(i, i + 1) for i in range(100, 160)]
    hub = [(1000, i) for i in range(1001, 1300)]
    cycle = [(2000, 2001), (2001, 2002), (2002, 2000), (2002, 2000), (2001, 2001)]
    df = spark.createDataFrame(path + hub + cycle, "a long, b long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    assert set(got) == {*range(100, 161), *range(1000, 1300), 2000, 2001, 2002}
    assert all(c == (100 if n < 1000 else 1000 if n < 2000 else 2000) for n, c in got.items())
    assert connected_components(df.limit(0)).count() == 0
