"""Hierarchical language identification.

Features are hashed character n-grams (1 to 3 bytes of the lower-cased letters and blanks) and hashed words, as relative
frequencies under a square root. A first stage of linear support vector machines, one against the rest, names the
family; within a family, one-versus-one linear support vector machines vote on the language. The families are found
from the sample: languages whose mean features are near are put together.

The fit uses a sample of rows drawn by hash: MAX_PER_LANG documents of a language, fewer where there are so many languages
that MAX_ROWS would be passed, but one of each at least. Ids are drawn first, from the id and language columns alone; the
features of the drawn texts, whole ones, are taken in tasks and come to the driver as sparse vectors. Prediction reads
whole texts in one pass without a shuffle. The score is the logistic of the smallest margin on the way, scaled on the
sample.

Defined results: `und` with score 0 for a text that is null or has no letter. Repeated rows give repeated rows. If only
one language is known, it is predicted with score 1; if none is, `und` with score 0.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1 << 12
MAX_ROWS, MAX_PER_LANG = 4000, 500
EPOCHS, LAMBDA = 12, 1e-4
UNKNOWN = "und"
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_MUL = np.uint64(0x9E3779B97F4A7C15)


class Words(dict):
    """The bucket of a word, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 300_000:
            self.clear()
        h = self[word] = BUCKETS + xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) % BUCKETS
        return h


def features(text: str, words: Words) -> np.ndarray | None:
    """A vector of 2 * BUCKETS of length 1; None if the text has no letter."""
    plain = _NOT_LETTERS.sub(" ", text.lower()).strip()
    if not any(map(str.isalpha, plain)):
        return None
    found = plain.split(" ")
    counts = np.bincount(np.fromiter(map(words.__getitem__, found), np.int64, len(found)), minlength=2 * BUCKETS).astype(np.float32)
    grams = np.zeros(BUCKETS, np.float32)
    data = np.frombuffer(f" {plain} ".encode("utf-8", "surrogatepass"), np.uint8)
    for lo in range(0, len(data), 1 << 20):
        part = data[lo : lo + (1 << 20) + 2].astype(np.uint64)
        h = part + np.uint64(1)
        for n in (1, 2, 3):
            if n > 1:
                if len(part) < n:
                    break
                h = h[:-1] * np.uint64(257) + part[n - 1 :] + np.uint64(1)
            grams += np.bincount((((h + np.uint64(n << 40)) * _MUL) >> np.uint64(52)).astype(np.int64), minlength=BUCKETS)
    counts[:BUCKETS] = np.sqrt(grams)
    counts[BUCKETS:] = np.sqrt(counts[BUCKETS:])
    for half in (slice(0, BUCKETS), slice(BUCKETS, None)):
        counts[half] /= max(float(np.linalg.norm(counts[half])), 1e-9) * np.sqrt(2)
    return counts


def svm(x: np.ndarray, y: np.ndarray, seed: int = 0) -> np.ndarray:
    """Weights (with a bias at the end) of a linear support vector machine, by averaged sub-gradient steps; y is -1 or 1."""
    rng = np.random.default_rng(seed)
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    w, mean, step, taken = np.zeros(x.shape[1], np.float32), np.zeros(x.shape[1], np.float64), 0, 0
    balance = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * len(y)
    for epoch in range(EPOCHS):
        order = rng.permutation(len(x))
        for lo in range(0, len(x), 32):
            at = order[lo : lo + 32]
            step += 1
            rate = 1.0 / (1 + 0.02 * step)
            wrong = y[at] * (x[at] @ w) < 1
            w *= 1 - rate * LAMBDA
            if wrong.any():
                w += rate * ((balance[at] * y[at])[wrong] @ x[at][wrong]).astype(np.float32) / np.float32(len(at) ** 0.5)
            if epoch >= EPOCHS // 2:
                mean += w
                taken += 1
    return (mean / max(1, taken)).astype(np.float32)


def families_of(names: list[str], means: np.ndarray) -> list[list[str]]:
    """About as many groups as the root of the number of languages: the two groups whose nearest means are nearest are joined."""
    groups = [[i] for i in range(len(names))]
    near = means @ means.T
    while len(groups) > max(1, int(np.ceil(len(names) ** 0.5))):
        pairs = [(-min(near[i, j] for i in a for j in b), p, q) for p, a in enumerate(groups) for q, b in enumerate(groups) if p < q]
        _, p, q = min(pairs)
        groups[p] += groups.pop(q)
    return sorted(sorted(names[i] for i in g) for g in groups)


class Model:
    def __init__(self, families: list[list[str]], family_weights: np.ndarray | None, pairs: dict[tuple[str, str], np.ndarray]):
        self.families, self.family_weights, self.pairs = families, family_weights, pairs

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        margin = np.inf
        family = self.families[0]
        if self.family_weights is not None:
            said = self.family_weights[:, :-1] @ x + self.family_weights[:, -1]
            order = np.argsort(-said, kind="stable")
            family, margin = self.families[order[0]], float(said[order[0]] - said[order[1]])
        if len(family) > 1:
            votes, sums = dict.fromkeys(family, 0), dict.fromkeys(family, np.inf)
            for i, a in enumerate(family):
                for b in family[i + 1 :]:
                    w = self.pairs[a, b]
                    m = float(w[:-1] @ x + w[-1])
                    votes[a if m > 0 else b] += 1
                    sums[a], sums[b] = min(sums[a], m), min(sums[b], -m)
            best = max(family, key=lambda k: (votes[k], sums[k]))
            return best, float(1 / (1 + np.exp(-np.clip(2 * min(margin, sums[best]), -30, 30))))
        return family[0], 1.0 if margin == np.inf else float(1 / (1 + np.exp(-np.clip(2 * margin, -30, 30))))


def _sparse(frames):
    words = Words()
    for frame in frames:
        found = [(lang, features(text, words)) for lang, text in zip(frame["lang"], frame["txt"])]
        found = [(lang, np.flatnonzero(v), v) for lang, v in found if v is not None]
        yield pd.DataFrame({"lang": [f[0] for f in found], "at": [f[1] for f in found], "value": [f[2][f[1]] for f in found]})


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Fits on the documents of `docs` whose language is known. Rows that share an id and a language count once, with the largest text."""
    known = docs.select(F.col(id_col).cast("string").alias("did"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("txt")).filter("lang IS NOT NULL AND txt IS NOT NULL AND did IS NOT NULL")
    n_langs = known.agg(F.count_distinct("lang")).first()[0]
    if not n_langs:
        return None
    # Ids only; a window with a limit keeps the first rows of each language in every task before the shuffle.
    most = max(1, min(MAX_PER_LANG, MAX_ROWS // n_langs))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("did"), "did"))
    drawn = known.select("did", "lang").withColumn("place", place).filter(F.col("place") <= most).select("did", "lang").distinct()
    # At most MAX_ROWS ids, or one for each language.
    texts = known.join(F.broadcast(drawn), ["did", "lang"]).groupBy("did", "lang").agg(F.max("txt").alias("txt"))
    rows = texts.select("lang", "txt").mapInPandas(_sparse, "lang string, at array<int>, value array<float>")
    found = sorted(((r["lang"], np.array(r["at"], np.int64).tobytes(), np.array(r["value"], np.float32).tobytes()) for r in rows.toLocalIterator()))
    vectors = []
    for lang, at, value in found:
        v = np.zeros(2 * BUCKETS, np.float32)
        v[np.frombuffer(at, np.int64)] = np.frombuffer(value, np.float32)
        vectors.append((lang, v))
    names = sorted({lang for lang, _ in vectors})
    if not names:
        return None
    x, lang = np.stack([v for _, v in vectors]), np.array([k for k, _ in vectors])
    means = np.stack([x[lang == k].mean(axis=0) for k in names])
    means /= np.linalg.norm(means, axis=1, keepdims=True)
    families = families_of(names, means)
    family = np.array([next(i for i, f in enumerate(families) if k in f) for k in lang])
    weights = np.stack([svm(x, np.where(family == i, 1, -1)) for i in range(len(families))]) if len(families) > 1 else None
    pairs = {}
    for f in families:
        for i, a in enumerate(f):
            for b in f[i + 1 :]:
                own = (lang == a) | (lang == b)
                pairs[a, b] = svm(x[own], np.where(lang[own] == a, 1, -1))
    return Model(families, weights, pairs)


def _predicted(model: Model | None):
    def run(frames):
        words = Words()
        for frame in frames:
            said = []
            for text in frame["txt"]:
                x = features(text, words) if text and model else None
                said.append((UNKNOWN, 0.0) if x is None else model.predict(x))
            yield pd.DataFrame({"doc_id": frame["doc_id"].array, "lang_pred": [s[0] for s in said], "score": [s[1] for s in said]})

    return run


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, lang_pred, score."""
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("txt"))
    done = rows.mapInPandas(_predicted(model), "doc_id string, lang_pred string, score double")
    return done.withColumn("doc_id", F.col("doc_id").cast("long"))


def op6_hierarchical_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = train(docs.select("doc_id", "text", "lang").filter(~out))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(out, F.lit(False)).alias("held_out"), "lang_pred", "score")
