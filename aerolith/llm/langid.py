"""Language identification with a blended-spectrum string kernel.

The kernel counts the character n-grams (1 to 3) that two texts share, present or absent, divided
by the texts' norms.  Nyström landmarks (training texts) turn it into features, one-versus-rest
kernel ridge regression fits one weight vector a language, and whole texts are scored by batched
matrix products.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aerolith.llm.common import is_held_out, unused, without

UNKNOWN = "und"
#: Bounds of the fit: labelled rows a language (those with the lowest text hashes) and in all, and
#: landmarks a language among them.
SAMPLE_PER_LANG, SAMPLE_ROWS, LANDMARKS_PER_LANG = 400, 8000, 40
RIDGE = 1e-2
OTHER = 0  # the symbol of characters outside the landmarks' alphabet
PIECE = 1 << 18  # characters of a text handled at a time
MAX_SYMBOLS = 255
ROWS = 64  # texts scored by one matrix product


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


@dataclass
class SpectrumModel:
    languages: list[str]
    symbols: np.ndarray      # code point -> symbol (0: other), up to the largest code point known
    grams: np.ndarray        # sorted codes of the landmarks' n-grams
    landmarks: np.ndarray    # landmarks x n-grams, normalised presence
    weights: np.ndarray      # landmarks x languages, Nyström map and ridge weights in one

    def presence(self, text: str, lookup: np.ndarray) -> np.ndarray:
        """0/1 vector over the landmarks' n-grams; the whole text is read, piece by piece."""
        out = np.zeros(len(self.grams) + 1, np.float32)
        p = _points(text)
        for s in range(0, len(p), PIECE):
            for codes in _codes(self.symbols, p[s:s + PIECE + 2]):
                out[lookup[codes]] = 1
        return out[:-1]

    def lookup(self) -> np.ndarray:
        """n-gram code -> position in ``grams`` (the position behind the last: unknown)."""
        kind = np.uint16 if len(self.grams) < 1 << 16 else np.int32
        table = np.full(1 << 24, len(self.grams), kind)
        table[self.grams] = np.arange(len(self.grams), dtype=kind)
        return table

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Softmax of the ridge outputs of a batch of presence vectors."""
        norm = np.sqrt(x.sum(1, keepdims=True))
        z = ((x / np.maximum(norm, 1)) @ self.landmarks.T).astype(np.float64) @ self.weights
        e = np.exp(6.0 * (z - z.max(1, keepdims=True)))
        return e / e.sum(1, keepdims=True)


def _codes(symbols: np.ndarray, points: np.ndarray) -> list[np.ndarray]:
    """Codes of the 1-, 2- and 3-grams of a text (three bytes, one a symbol)."""
    s = symbols[np.minimum(points, len(symbols) - 1)].astype(np.int32)
    if not len(s):
        return []
    out = [s]
    if len(s) > 1:
        out.append(s[:-1] + (s[1:] << 8))
    if len(s) > 2:
        out.append(s[:-2] + (s[1:-1] << 8) + (s[2:] << 16))
    return out


def fit(texts: list[str], langs: list[str], per_lang: int = LANDMARKS_PER_LANG) -> SpectrumModel:
    """Fit on a bounded list of labelled texts."""
    languages = sorted(set(langs))
    seen: dict[str, int] = {}
    for t in texts:
        for ch in set(t):
            seen[ch] = seen.get(ch, 0) + 1
    alphabet = sorted(seen, key=lambda c: (-seen[c], c))[:MAX_SYMBOLS]
    symbols = np.zeros(max((ord(c) for c in alphabet), default=0) + 2, np.uint8)
    for k, c in enumerate(alphabet):
        symbols[ord(c)] = k + 1
    chosen, count = [], dict.fromkeys(languages, 0)
    for k, lang in enumerate(langs):
        if count[lang] < per_lang:
            chosen.append(k)
            count[lang] += 1
    grams = np.unique(np.concatenate([c for k in chosen for c in _codes(symbols, _points(texts[k]))] or [np.zeros(0, np.int32)]))
    grams = grams[grams > 0]
    model = SpectrumModel(languages, symbols, grams, np.zeros((0, len(grams)), np.float32), np.zeros((0, len(languages))))
    lookup = model.lookup()
    x = np.stack([model.presence(t, lookup) for t in texts])
    x /= np.maximum(np.sqrt(x.sum(1, keepdims=True)), 1)
    model.landmarks = np.ascontiguousarray(x[chosen])
    k_nm = (x @ model.landmarks.T).astype(np.float64)
    k_mm = k_nm[chosen]
    values, vectors = np.linalg.eigh(k_mm)
    keep = values > 1e-6 * max(values.max(), 1e-12)
    nystroem = vectors[:, keep] / np.sqrt(values[keep])  # K_mm^(-1/2) on the kept directions
    phi = k_nm @ nystroem
    y = np.where(np.array(langs)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    # a language counts as much as all others together, however few rows it has
    w = np.ones(len(langs))
    for lang in languages:
        of = np.array([v == lang for v in langs])
        w[of] = 1.0 / of.sum()
    a = phi.T @ (phi * w[:, None]) + RIDGE * w.sum() / len(w) * np.eye(phi.shape[1])
    model.weights = nystroem @ np.linalg.solve(a, phi.T @ (y * w[:, None]))
    return model


def training_sample(docs: DataFrame, text_col: str, lang_col: str, held_out, per_lang: int) -> DataFrame:
    """At most ``per_lang`` labelled texts of each language outside the held-out fold (fewer where the
    languages together would pass SAMPLE_ROWS): those with the lowest text hashes, in whole, copies once."""
    rows = docs.where(~held_out & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    # thin each language by hash first, so that the ranking below meets a bounded number of rows a language
    counts = rows.select("lang", "h").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(SAMPLE_ROWS)
    per_lang = max(1, min(per_lang, SAMPLE_ROWS // max(1, counts.count())))
    some = rows.join(F.broadcast(counts), "lang").where(
        F.pmod("h", F.lit(1 << 30)) <= F.lit(float(1 << 30)) * F.least(F.lit(1.0), F.lit(4.0 * per_lang) / F.col("n"))).dropDuplicates(["lang", "h"])
    ranked = some.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).where(F.col("r") <= per_lang)
    return ranked.select("lang", "text", "r").orderBy("lang", "r")


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          modulus: int = 3, remainder: int = 1, per_lang: int = SAMPLE_PER_LANG) -> SpectrumModel | None:
    """Fit on the bounded sample; None when there is no labelled text."""
    rows = training_sample(docs, text_col, lang_col, is_held_out(id_col, modulus, remainder), per_lang).collect()
    return fit([r.text for r in rows], [r.lang for r in rows]) if rows else None


def predict(docs: DataFrame, model: SpectrumModel | None, text_col: str = "text", label: str = "lang_pred", score: str = "lang_score") -> DataFrame:
    """Add the predicted language and its score (0 to 1) to every row; all other columns stay.

    A null text, one without a letter, and every text when no model could be fitted get ``und``
    with score 0.  Columns of the added names are replaced.  Rows are scored one by one, so
    repeated rows get equal results, and an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # landmarks x n-grams: bounded by the fit's bounds

    @F.pandas_udf("struct<lang:string,score:double>")
    def classify(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        lookup = m.lookup() if m else None
        for texts in batches:
            lang, best = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
            known = [i for i, t in enumerate(texts) if m and t is not None and any(map(str.isalpha, t))]
            for s in range(0, len(known), ROWS):
                at = known[s:s + ROWS]
                p = m.scores(np.stack([m.presence(texts.iloc[i], lookup) for i in at]))
                top = p.argmax(1)
                lang[at] = [m.languages[k] for k in top]
                best[at] = p[np.arange(len(at)), top]
            yield pd.DataFrame({"lang": lang, "score": best})

    keep, found = without(docs, label, score), unused(docs, "__langid")
    scored = docs.select(*keep, classify(F.col(text_col)).alias(found))
    return scored.select(*keep, F.col(found)["lang"].alias(label), F.col(found)["score"].alias(score))
