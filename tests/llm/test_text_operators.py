import pickle
import random
import tracemalloc
import zlib
from collections import Counter
from math import log10

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from aerolith.llm import decontaminate, langid, ngram_lm, token_cache, toxicity
from aerolith.llm.common import fresh_path, table
from aerolith.llm.queries import QUERIES
from aerolith.llm.sentencepiece import PieceModel, _fields, decode_documents, encode_documents
from tests.conftest import SF01

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  a  b ", "\n\n x1,2 é日本 😀 don't 3.14 l'eau", "   ", "x" * 5000, "\x00\x07tab\tend ", "ﬁ ﷺ é"]


def crc(i, m):
    return zlib.crc32(str(i).encode()) % m


# --- SentencePiece ---------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def model():
    with open(MODEL, "rb") as f:
        return PieceModel(f.read())


def plain_viterbi(m, text):
    at = {p: i for i, p in enumerate(m.pieces) if m.types[i] in (1, 4, 5)}
    longest = max(map(len, at))
    best, came = [0.0] + [-1e300] * len(text), [None] * (len(text) + 1)
    for e in range(1, len(text) + 1):
        for s in range(max(0, e - longest), e):
            i = at.get(text[s:e])
            score = m.scores[i] if i is not None else m.unknown_score if e - s == 1 else None
            if score is not None and best[s] + score > best[e]:
                best[e], came[e] = best[s] + score, (s, i)
    ids, e = [], len(text)
    while e:
        s, i = came[e]
        ids[:0] = [i] if i is not None else [m.bytes[b] for b in text[s:e].encode()]
        e = s
    return ids


def test_viterbi_equals_brute_force(spark, model):
    texts = [r.text[:1500] for r in table(spark, SF01, "documents").limit(60).collect() if r.text] + ODD
    rng = random.Random(3)
    texts += ["".join(rng.choice("aehnt ▁.,'\n日é") for _ in range(200)) for _ in range(20)]
    for t in texts:
        assert model.encode(t) == (plain_viterbi(model, "▁" + t.replace(" ", "▁")) if t else []), t[:80]
        assert model.decode(model.encode(t)) == t.replace("▁", " ")


def test_never_worse_than_the_library_on_the_same_scores(model):
    """The library reads the file as a unigram model; its single-precision path scores no better."""
    with open(MODEL, "rb") as f:
        raw = f.read()

    def number(n):
        out = bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes(out) + bytes([n])
    out = b""
    for field, value in _fields(raw):
        if field == 2:  # trainer: model type 2 (BPE) -> 1 (unigram)
            value = value.replace(b"\x18\x02", b"\x18\x01", 1)
        out += number(field << 3 | 2) + number(len(value)) + value
    library = sentencepiece.SentencePieceProcessor(model_proto=out)
    total = lambda ids: sum(model.scores[i] for i in ids)
    for t in ["and", "a be and", "the rest of it", "hello world, this is", "By be in tothedouou and, oninly."]:
        assert total(model.encode(t)) >= total(library.encode(t))


def test_encode_keeps_columns_nulls_and_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (2, "", "y"), (None, "a b", "z")], "doc_id long, text string, token_ids string")
    got = decode_documents(encode_documents(df, MODEL), MODEL).collect()
    assert sorted((str(r.doc_id), r.text is None, r.decoded == r.text) for r in got) == sorted(
        [("1", True, True), ("2", False, True), ("2", False, True), ("None", False, True)])
    assert [r.token_ids for r in got if r.text is None] == [None] and [r.token_ids for r in got if r.text == ""] == [[], []]
    assert encode_documents(df.limit(0), MODEL).count() == 0
    assert all(r.round_trip for r in QUERIES["op3_sentencepiece"](spark, SF01).collect())


# --- decontamination -------------------------------------------------------------------------------------------

def test_contained_items_edges(spark):
    item = " ".join(f"w{i}" for i in range(24))  # 20 shingles
    most = item.rsplit(" ", 4)[0]                # 16 of them
    docs = spark.createDataFrame([(1, f"before it, {item.upper()}! and after", 0.0), (2, most, 0.0), (3, most.rsplit(" ", 1)[0], 0.0), (4, None, 0.0),
                                  (5, "", 0.0), (None, item, 0.0), (2, item, 0.0), (6, "Short one", 0.0), (7, "a short one", 0.0)],
                                 "doc_id long, text string, h double")
    items = spark.createDataFrame([(10, item), (10, item), (11, "short ONE."), (12, None), (13, " .. "), (None, item)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_shared, r.containment) for r in decontaminate.contained_items(docs, items).collect()}
    assert got == {(1, 10): (20, 1.0), (2, 10): (20, 1.0), (None, 10): (20, 1.0), (1, None): (20, 1.0), (2, None): (20, 1.0), (None, None): (20, 1.0),
                   (6, 11): (1, 1.0)}
    one = decontaminate.contained_items(docs.where("doc_id = 2 AND NOT text LIKE '%w23%'"), items).collect()
    assert {(r.item_id, r.containment) for r in one} == {(10, 0.8), (None, 0.8)}
    assert decontaminate.contained_items(docs.limit(0), items).count() == 0 == decontaminate.contained_items(docs, items.limit(0)).count()
    left = decontaminate.remove_contaminated(docs, items)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [3, 4, 5, 7]


def test_shuffled_search_equals_broadcast(spark, monkeypatch):
    run = lambda: sorted(map(tuple, QUERIES["op2_benchmark_decontamination"](spark, SF01).collect()))
    small = run()
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    assert run() == small and small


def test_no_python_on_the_main_path(spark):
    plan = QUERIES["op2_benchmark_decontamination"](spark, SF01)._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))


# --- language, toxicity ----------------------------------------------------------------------------------------

def test_language_of_held_out_documents(spark):
    rows = QUERIES["op10_language_id"](spark, SF01).collect()
    lang = {r.doc_id: r.lang for r in table(spark, SF01, "documents").collect()}
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(lang) and all(r.held_out == (crc(r.doc_id, 3) == 1) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.98


def test_language_edges(spark):
    docs = spark.createDataFrame([(i, t, la, "q") for i, (t, la) in enumerate([("the cat and the dog are here", "en"), ("der Hund und die Katze sind hier", "de")] * 10)]
                                 + [(100, None, "en", "q"), (101, "", "en", "q"), (102, "123 ... !", None, "q"), (None, "the dog", "en", "q")],
                                 "doc_id long, text string, lang string, lang_pred string")
    model = langid.train(docs)
    got = langid.predict(docs, model).collect()
    assert [r.lang_pred for r in got if r.doc_id in (100, 101, 102)] == ["und"] * 3
    assert [r.lang_pred for r in got if r.doc_id is None] == ["en"]
    assert langid.predict(docs, model).columns == ["doc_id", "text", "lang", "lang_pred", "lang_score"]
    assert langid.train(docs.limit(0)) is None and langid.predict(docs.limit(0), None).count() == 0
    assert {r.lang_pred for r in langid.predict(docs, None).collect()} == {"und"}


def test_kernel_scores_equal_plain_kernel_ridge():
    texts, langs = ["aa bb ab", "abab aa", "xy yx xx", "yy xyx", "ba ab a"], ["p", "p", "q", "q", "p"]
    m = langid.fit(texts, langs, per_lang=5)
    grams = lambda t: {t[i:i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}
    kernel = lambda a, b: len(grams(a) & grams(b)) / (len(grams(a)) * len(grams(b))) ** 0.5
    k = np.array([[kernel(a, b) for b in texts] for a in texts])
    look = m.lookup()
    x = np.stack([m.presence(t, look) for t in texts])
    own = x / np.sqrt(x.sum(1, keepdims=True)) @ m.landmarks.T
    order = [texts.index(t) for t in [texts[i] for i in range(5)]]
    assert np.allclose(own, k[:, order], atol=1e-6)
    assert (m.scores(x).argmax(1) == [0 if v == "p" else 1 for v in langs]).all()


def test_nearest_examples_equal_brute_force():
    rng = np.random.default_rng(5)
    names = [f"t{i}" for i in range(40)]
    examples = [(i, int(rng.random() < 0.4), Counter({n: int(c) for n, c in zip(names, rng.poisson(0.3, 40)) if c})) for i in range(700)]
    m = toxicity.build(examples, {n: 1.0 + i / 10 for i, n in enumerate(names)}, k=10)
    vec = lambda c: np.bincount(m.vector(c)[0], m.vector(c)[1], minlength=40)
    full = np.stack([vec(c) for _, _, c in examples if c])
    for _ in range(50):
        q = Counter({n: int(c) for n, c in zip(names, rng.poisson(0.3, 40)) if c})
        ids, cos = m.nearest(*m.vector(q))
        want = np.sort(full @ vec(q))[::-1]
        want = want[want > 0][:10]
        assert np.allclose(cos, want) and np.allclose(full[ids] @ vec(q), cos)


def test_toxicity_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in QUERIES["op7_toxicity"](spark, sf).collect()}
    labels = {r.doc_id: r.toxic for r in table(spark, sf, "labels").collect()}
    held = [(labels[i], r) for i, r in rows.items() if i in labels and r.held_out and labels[i] is not None]
    assert all(r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in rows.values())
    caught = np.mean([r.predicted for y, r in held if y == 1])
    wrong = np.mean([r.predicted for y, r in held if y == 0])
    assert caught > 0.75 and wrong < 0.02
    means = [np.mean([y for y, r in held if lo <= r.score < hi]) for lo, hi in ((0, 0.2), (0.8, 1.01))]
    assert means[0] < 0.1 and means[1] > 0.75  # calibrated


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(i, "you idiot scum go" if i % 4 == 0 else "a fine day here", 0.5) for i in range(400)] + [(900, None, 0.5), (901, "", 0.5), (None, "idiot scum", 0.5)],
                                 "doc_id long, text string, toxic_score double")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(900, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.predict(docs, model).collect()}
    assert got[None].toxic_pred == 1 and got[0].toxic_pred == 1 and got[1].toxic_pred == 0 and got[900].toxic_pred == 0 == got[901].toxic_pred
    assert got[0].toxic_evidence and got[0].toxic_evidence[0].label == 1
    assert toxicity.train(docs, labels.limit(0)) is None
    assert {r.toxic_pred for r in toxicity.predict(docs, None).collect()} == {0} and toxicity.predict(docs.limit(0), model).count() == 0


def test_every_word_of_a_text_counts(spark):
    """Ordinary words and those of label 0 stay in the vectors: such a text has neighbours of its own kind."""
    rng = random.Random(7)
    words = [f"{a}{b}" for a in ("bread", "river", "stone", "cloud") for b in "abcdefgh"]
    docs = spark.createDataFrame([(i, " ".join(rng.sample(words[8 * (i % 4):8 * (i % 4) + 8], 5)) + (" idiot" if i % 10 == 0 else "")) for i in range(600)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(600)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert {*words, "idiot"} <= set(model.terms) and (model.weight > 0).all()
    for r in toxicity.predict(docs, model).collect():
        assert len(r.toxic_evidence) == 3
        if r.doc_id % 10:
            assert r.toxic_pred == 0 and all(e.label == 0 and e.example_id % 4 == r.doc_id % 4 for e in r.toxic_evidence)


def test_blocks_left_out_hold_no_neighbour():
    rng = np.random.default_rng(8)
    names = [f"t{i}" for i in range(300)]
    share = np.where(np.arange(300) < 20, 0.5, 0.02)
    examples = [(i, int(rng.random() < 0.3), Counter({names[t]: 1 + int(rng.integers(3)) for t in np.flatnonzero(rng.random(300) < share)})) for i in range(3000)]
    m = toxicity.build(examples, {n: 0.1 if i < 20 else 3.0 for i, n in enumerate(names)}, k=5)
    full = np.stack([np.bincount(*m.vector(c), minlength=300) for _, _, c in examples if c])
    for (ids, cos), q in zip(m.nearest_of([m.vector(c) for _, _, c in examples[:70]]), full):
        want = np.lexsort((np.arange(len(full)), -np.round(full @ q, 9)))[:5]
        assert np.allclose(cos, (full @ q)[want]) and np.allclose(cos, full[ids] @ q)


# --- token cache -----------------------------------------------------------------------------------------------

def test_token_counts_equal_the_library(spark):
    own = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = {r.doc_id: r.text or "" for r in table(spark, SF01, "documents").collect()}
    rows = QUERIES["op8_token_counts"](spark, SF01).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in rows} == {
        i: (len(t.encode()), n := len(own.encode(t)), n > 4096) for i, t in texts.items()}


def test_cache_encodes_only_what_is_missing(spark):
    path = fresh_path(spark, "cache-test")
    docs = spark.createDataFrame([(1, "a b", 7), (2, "a b", 7), (2, "a b", 7), (3, None, 7), (4, "", 7), (None, "c " * 3000, 7)], "doc_id long, text string, n_tokens int")
    first = sorted(map(tuple, token_cache.token_counts(docs, MODEL, path).collect()), key=str)
    assert len(first) == 6 and spark.read.parquet(path).count() == 3
    # a stored count is taken as it is: the text is not encoded again
    key = spark.createDataFrame([("zzz",)], "text string").select(token_cache.content_digest("text").alias("content"))
    key.selectExpr(f"'{token_cache.tokenizer_digest(MODEL)}' AS tokenizer", "content", "CAST(77 AS long) AS n_tokens").write.mode("append").parquet(path)
    more = docs.unionByName(spark.createDataFrame([(9, "zzz", 7), (10, "new", 7)], docs.schema))
    second = token_cache.token_counts(more, MODEL, path).collect()
    assert [r.n_tokens for r in second if r.doc_id == 9] == [77] and spark.read.parquet(path).count() == 5
    assert sorted(map(tuple, [r for r in second if r.doc_id not in (9, 10)]), key=str) == first
    other = public_tokenizers.path("byte_bpe_50k.json")  # another tokenizer is another key
    assert len(token_cache.token_counts(docs, other, path).collect()) == 6 and spark.read.parquet(path).count() == 8
    assert token_cache.token_counts(docs.limit(0), MODEL, path).count() == 0


# --- language model --------------------------------------------------------------------------------------------

def test_scores_equal_a_plain_model(spark):
    rows = {r.doc_id: r for r in QUERIES["op9_lm_scoring"](spark, SF01).collect()}
    texts = {r.doc_id: ngram_lm.tokens((r.text or "").encode()) for r in table(spark, SF01, "documents").collect()}
    train = [t for i, t in texts.items() if crc(i, 7) != 2]
    c = Counter(w for t in train for w in t)
    n, v = sum(c.values()), len(c)
    contexts = {w for w, k in c.items() if k >= ngram_lm.CONTEXT_SHARE * n and w}
    pairs = Counter((u, w) for t in train for u, w in zip([None, *t], t) if u is None or u in contexts)
    of = {**{w: c[w] for w in contexts}, None: len(train)}
    p = lambda w: (c[w] + 1) / (n + v + 1)
    k = ngram_lm.PRIOR
    for i, t in texts.items():
        r = rows[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (crc(i, 7) == 2, len(t), sum(c[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(log10(p(w)) for w in t), abs=1e-6)
        plain = sum(log10((pairs[u, w] + k * p(w)) / (of[u] + k)) if u in of else log10(p(w)) for u, w in zip([None, *t], t))
        assert r.score == pytest.approx(plain, abs=1e-6)
    held = [r for r in rows.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_language_model_edges(spark):
    docs = spark.createDataFrame([(1, "a b a", 0), (2, None, 0), (3, "", 0), (None, "a z", 0), (1, "a b a", 0), (4, "q " * 20_000, 0)], "doc_id long, text string, score int")
    got = ngram_lm.score_documents(docs, block_bytes=8).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == [("1", 4), ("1", 4), ("2", 1), ("3", 1), ("4", 20_001), ("None", 3)]
    assert len({(r.base_score, r.score) for r in got if r.doc_id in (2, 3)}) == 1
    assert [r.held_out for r in got if r.doc_id is None] == [True]
    assert ngram_lm.score_documents(docs.limit(0)).count() == 0
    nothing = ngram_lm.score_documents(docs.where("doc_id IS NULL")).collect()
    assert [(r.train_tokens, r.base_score) for r in nothing] == [(0, 0.0)]


def test_rare_words_are_contexts(spark):
    """A word seen three times among thousands is a context, also when its texts are dealt into many blocks."""
    rare = [(i, "zeta omega") for i in range(1000, 1004) if crc(i, 7) != 2]
    rows = rare + [(i, "alpha beta gamma delta " * 60) for i in range(60)] + [(2000, "zeta omega zeta"), (None, "zeta omega")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    train = [ngram_lm.tokens(t.encode()) for i, t in rows if i is not None and crc(i, 7) != 2]
    c = Counter(w for t in train for w in t)
    pairs = Counter(p for t in train for p in zip([None, *t], t))
    n, v, k = sum(c.values()), len(c), 50.0
    assert c[b"zeta"] < n / 1000
    p = lambda w: (c[w] + 1) / (n + v + 1)
    plain = lambda t: sum(log10((pairs[u, w] + k * p(w)) / ((c[u] if u else len(train)) + k)) for u, w in zip([None, *t], t))
    for size in (200, 1 << 20):
        got = ngram_lm.score_documents(docs, block_bytes=size, prior=k).collect()
        text = dict(rows)
        assert len(got) == len(rows) and all(r.score == pytest.approx(plain(ngram_lm.tokens(text[r.doc_id].encode())), abs=1e-9) for r in got)


def test_blocks_of_like_examples_are_left_out():
    """Four kinds of texts with common terms of their own: a text completes blocks of its kind only."""
    rng = np.random.default_rng(9)
    kinds = [[f"{k}{i}" for i in range(60)] for k in "abcd"]
    examples = [(i, int(rng.random() < 0.3), Counter({kinds[i % 4][t]: 1 + int(rng.integers(3)) for t in np.flatnonzero(rng.random(60) < 0.4)})) for i in range(3000)]
    m = toxicity.build(examples, {n: 0.5 + i % 7 / 4 for i, n in enumerate(x for k in kinds for x in k)}, k=5)
    m.index.needed = m.index.seen = 0
    found = list(m.searched(m.vector(c) for _, _, c in examples[:1024]))
    assert 0 < m.index.needed < 0.5 * m.index.seen
    full = np.stack([np.bincount(*m.vector(c), minlength=240) for _, _, c in examples if c])
    for (ids, cos), q in zip(found, full):
        assert np.allclose(cos, np.sort(full @ q)[::-1][:5]) and np.allclose(cos, full[ids] @ q)


def test_examples_are_bounded_by_rows(spark):
    docs = spark.createDataFrame([(1, f"text {i % 60}") for i in range(500)] + [(2, "other")], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int"), modulus=1, remainder=2, max_examples=7)
    assert len(model.labels) == 7
    every = toxicity.train(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int"), modulus=1, remainder=2)
    assert len(every.labels) == 61


def test_copies_take_one_place_in_the_language_sample(spark):
    docs = spark.createDataFrame([(i, "the same words again" if i % 50 else f"other words {i}", "en") for i in range(2000)], "doc_id long, text string, lang string")
    rows = langid.training_sample(docs, "text", "lang", F.lit(False), 400).collect()
    assert len({r.text for r in rows}) == len(rows) == 41


def test_counts_by_number_equal_term_counts():
    texts = [None, "", *ODD, "Running runner runs RUNNING straße İstanbul naïveté_x ^caret", "unknownword unknown", "running " * 9]
    names = sorted({t for x in texts[:-2] for t in toxicity.term_counts(x)})
    vocabulary = toxicity.Vocabulary(pa.array(names), np.ones(len(names)))
    start, at, n = vocabulary.counts(texts)
    for i, text in enumerate(texts):
        own = slice(start[i], start[i + 1])
        assert list(zip([names[t] for t in at[own]], n[own])) == sorted((t, c) for t, c in toxicity.term_counts(text).items() if t in set(names))
    assert [len(x) for x in toxicity.Vocabulary(pa.array([], pa.string()), np.zeros(0)).counts(texts)[1:]] == [0, 0]


def test_driver_holds_no_example(spark):
    """The examples' vectors and index are pieces that tasks make and hold; the driver's model has none of them."""
    rng = random.Random(4)
    docs = spark.createDataFrame([(i, " ".join(f"word{rng.randrange(9000)}" for _ in range(60))) for i in range(3000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(3000)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, modulus=1, remainder=2)
    shared, model.shared = model.shared, None
    assert model.index is None and len(shared[2]) > 1 and sum(len(p.value.w) for p in shared[2]) > 3000 * 60
    assert len(pickle.dumps(model)) < 3000 * 60 * 8  # below one copy of the vectors
    model.shared = shared
    top = {r.doc_id: r.toxic_evidence[0] for r in toxicity.predict(docs, model).collect()}
    assert all(e.example_id == i and e.cosine == pytest.approx(1) for i, e in top.items())


def test_index_of_pieces_needs_little_more_than_its_postings():
    """Making the index of 6,000 examples peaks below 2.5 times their terms and weights (4.1 before)."""
    rng = np.random.default_rng(3)
    runs = [np.sort(rng.choice(50_000, 200, replace=False)) for _ in range(6000)]
    w = np.full(6000 * 200, 200 ** -0.5, np.float32)
    layout, pieces = toxicity.Layout(50_000), []
    for s in range(0, 6000, 2000):
        pieces.append(toxicity.piece_of(np.arange(s, s + 2000), np.arange(2001) * 200, np.concatenate(runs[s:s + 2000]).astype(np.int32), w[:400_000]))
        layout.add(pieces[-1])
    tracemalloc.start()
    index = toxicity.Index(pieces, layout.sizes, layout.names(), layout.postings, 6000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert index.start[-1] == len(w) and peak < 2.5 * 8 * len(w)
    queries = [(r, np.full(200, 200 ** -0.5)) for r in runs[::100]]
    for (ids, cos), (at, _), i in zip(index.nearest_of(queries, 5), queries, range(0, 6000, 100)):
        want = np.sort([len(np.intersect1d(at, r)) / 200 for r in runs])[::-1][:5]
        assert ids[0] == i and np.allclose(cos, want)
