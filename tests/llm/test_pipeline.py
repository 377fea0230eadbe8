import corpus_pipeline as P
import public_tokenizers
import regex
import sentencepiece
from pyspark.sql import functions as F

from aerolith.llm import decontaminate, langid, simhash, toxicity
from aerolith.llm.common import materialize, table
from tests.conftest import SF01


def test_stages_follow_one_another(spark):
    documents = table(spark, SF01, "documents")
    docs, kept = documents, [documents]
    for name, stage in P.STAGES:
        docs = materialize(stage(spark, docs, SF01), name)
        kept.append(docs)
    assert all(d.columns == documents.columns for d in kept[:-1])
    rows = [{r.doc_id: r.text for r in d.select("doc_id", "text").collect()} for d in kept]
    assert all(set(b) <= set(a) for a, b in zip(rows, rows[1:])) and rows[-1].keys() == rows[-2].keys()
    # each decision against the operator's own result or a plainer one
    assert {i for i, t in rows[0].items() if any(c.isalpha() for c in t or "")} == set(rows[1])
    scored = {r.doc_id: r.toxic_score for r in toxicity.predict(kept[1], toxicity.train(kept[1], table(spark, SF01, "labels"))).collect()}
    assert {i for i, s in scored.items() if s < 0.7} == set(rows[2]) and len(rows[2]) < len(rows[1])
    groups = {r.doc_id: r.component_id for r in simhash.near_duplicates(kept[2]).collect()}
    assert {i for i, c in groups.items() if i == c} == set(rows[3]) and len(rows[3]) < len(rows[2])
    items = [" ".join(plain_words(r.text)) for r in table(spark, SF01, "benchmark").collect()]
    whole = {i for i, t in rows[3].items() if any(x and x in " ".join(plain_words(t)) for x in items)}
    assert whole and not whole & set(rows[4])
    own = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in kept[5].collect():
        assert r.round_trip and r.n_tokens == len(r.token_ids)
        assert "".join(own.id_to_piece(i) for i in r.token_ids if not own.is_byte(i)).replace("▁", "") != "" or not r.text.strip()


def plain_words(text):
    return regex.findall(r"[\p{L}\p{N}]+", (text or "").lower())


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "one two three", None, None, None), (3, "one two three", None, None, None),
                                  (None, "four five six seven", "en", "s", 4)], table(spark, SF01, "documents").schema)
    for name, stage in P.STAGES:
        docs = materialize(stage(spark, docs, SF01), name)
    assert sorted((str(r.doc_id), r.round_trip) for r in docs.collect()) == [("3", True), ("None", True)]
    empty = table(spark, SF01, "documents").limit(0)
    for name, stage in P.STAGES:
        empty = stage(spark, empty, SF01)
    assert empty.count() == 0


def test_null_and_repeated_ids_are_rows_of_their_own(spark):
    text = {k: " ".join(f"{k}{i}" for i in range(30)) for k in "abcdef"}
    docs = spark.createDataFrame([(None, text["a"], "n1"), (None, text["b"], "n2"), (5, text["c"], "own"), (5, text["d"], "copy"), (3, text["d"], "first"),
                                  (None, text["d"], "copy"), (7, text["e"], "x"), (7, text["f"], "y")], "doc_id long, text string, source string")
    left = P.near_duplicates(spark, docs, SF01)
    assert left.columns == docs.columns
    assert sorted((str(r.doc_id), r.source) for r in left.collect()) == [("3", "first"), ("5", "own"), ("7", "x"), ("7", "y"), ("None", "n1"), ("None", "n2")]
    items = spark.createDataFrame([(1, text["a"]), (2, text["e"])], "item_id long, text string")
    clean = decontaminate.remove_contaminated(left, items)
    assert clean.columns == docs.columns
    assert sorted((str(r.doc_id), r.source) for r in clean.collect()) == [("3", "first"), ("5", "own"), ("7", "y"), ("None", "n2")]


CLASHES = ["__lang", "__LANG_SCORE", "__score", "__toxic", "__evidence", "__label", "__ROW", "__decoded", "__langid", "__keep", "__id"]


def test_columns_with_the_names_of_the_stages_own_stay(spark):
    base = table(spark, SF01, "documents").limit(30)
    docs = materialize(base.select("*", *[F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in CLASHES]))
    rows = {r.doc_id: r for r in docs.collect()}
    for name, stage in P.STAGES:
        docs = stage(spark, docs, SF01)
        assert docs.columns[:len(base.columns) + len(CLASHES)] == [*base.columns, *CLASHES], name
        docs = materialize(docs, name)
    left = docs.collect()
    assert left and all(r[c] == rows[r.doc_id][c] for r in left for c in CLASHES)


def test_added_columns_replace_those_of_another_case(spark):
    docs = table(spark, SF01, "documents").limit(5).select("doc_id", "text", F.lit(1).alias("LANG_PRED"), F.lit(2).alias("Toxic_Score"))
    assert langid.predict(docs, None).columns == ["doc_id", "text", "Toxic_Score", "lang_pred", "lang_score"]
    assert toxicity.predict(docs, None).columns == ["doc_id", "text", "LANG_PRED", "toxic_score", "toxic_pred", "toxic_evidence"]
