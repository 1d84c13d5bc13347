import numpy as np
import pytest

from grainmill.llm import toxicity as tx


def table(spark, n=600):
    rng = np.random.default_rng(2)
    words = [f"w{i}x" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        text = [words[k] for k in rng.integers(0, 300, rng.integers(5, 60))]
        toxic = i % 4 == 0
        if toxic:
            for bad in rng.choice(["vileness", "scumbag", "rotten"], 3):
                text.insert(int(rng.integers(0, len(text))), bad)
        rows.append((i, " ".join(text), "en" if i % 2 else "xx", i))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score long"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_learns_and_holds_out(spark):
    docs, labels = table(spark)
    model, thresholds = tx.train(docs, labels.filter("doc_id % 3 <> 1"))
    rows = tx.score_toxicity(docs, model, thresholds).collect()
    assert rows[0].asDict().keys() == {"doc_id", "text", "lang", "score", "__score", "__threshold", "__flagged"}
    held = [r for r in rows if r.doc_id % 3 == 1]
    right = sum((r["__score"] >= 0.7) == (r.doc_id % 4 == 0) for r in held)
    assert right / len(held) > 0.95
    again, _ = tx.train(docs, labels.filter("doc_id % 3 <> 1"))
    assert again.score(tx.WordBuckets().of("a scumbag")) == model.score(tx.WordBuckets().of("a scumbag"))


def test_odd_rows(spark):
    docs, labels = table(spark, 200)
    model, thresholds = tx.train(docs, labels.union(spark.createDataFrame([(None, 1), (3, None), (0, 1)], "doc_id long, toxic int")))
    odd = spark.createDataFrame([(1, None, None), (1, None, None), (None, "", "en"), (2, "scumbag " * 30_000, "zz"), (3, " \n", None)], "doc_id long, text string, lang string")
    got = tx.score_toxicity(odd, model, thresholds).collect()
    assert len(got) == 5 and all(0 <= r["__score"] <= 1 for r in got)
    assert len({r["__score"] for r in got if not (r.text or "").strip()}) == 1
    assert tx.score_toxicity(odd.limit(0), model, {}).count() == 0
    none, empty = tx.train(docs, labels.filter("toxic = 0"))
    assert none is None and {r["__score"] for r in tx.score_toxicity(odd, none, empty).collect()} == {0.0}


def test_fit_reads_whole_texts_and_each_id_once(spark):
    """What makes a text toxic stands behind 6,000 other words; rows that repeat an id add nothing to the sample."""
    rng = np.random.default_rng(6)
    rows = [(i, " ".join([f"w{k}" for k in rng.integers(0, 40, 6000)] + (["scumbag vileness"] if i % 3 == 0 else ["good day"])), "en") for i in range(60)]
    docs = spark.createDataFrame(rows + [rows[1]] * 40, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int")
    model, _ = tx.train(docs, labels)
    score = lambda t: model.score(tx.WordBuckets().of(t))
    assert score("w1 w2 scumbag vileness") > 0.7 > score("w1 w2 good day")


def test_wider_filters_matter(spark):
    """The order of two words is the label: single words say nothing of it, and the trained model tells it on held-out rows."""
    rng = np.random.default_rng(7)
    rows, labels = [], []
    for i in range(1600):
        toxic = i % 2
        text = [f"w{k}" for k in rng.integers(0, 30, 12)]
        at = int(rng.integers(0, 12))
        text[at:at] = ["blasted", "creature"] if toxic else ["creature", "blasted"]
        rows.append((i, " ".join(text), "en"))
        labels.append((i, toxic))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model, _ = tx.train(docs, known.filter("doc_id < 1200"))
    logits = np.array([model.logit(tx.WordBuckets().of(t)) for _, t, _ in rows[1200:]])
    truth = np.array([y for _, y in labels[1200:]])
    assert ((logits >= model.shift) == truth).mean() > 0.9


def test_blocks_give_the_whole_text(monkeypatch):
    model = tx.Model(1)
    model.freeze()
    text = np.random.default_rng(0).integers(0, 2**45, 50_003)
    ids = tx.unpack(text)
    best, _ = tx.pooled(model.table[ids].sum(axis=1), len(ids))
    assert model.logit(text) == pytest.approx(float(np.maximum(best + model.bias, 0) @ model.out + model.base), rel=1e-4)


def test_every_labelled_row_is_learned_from(spark):
    """A word that only rows behind the first 2,500 of their class by hash have is learned as well; several parts are averaged."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(8)
    order = [r.i for r in spark.range(5200).select(F.col("id").alias("i")).orderBy(F.xxhash64("i"), "i").collect()]
    late = set(order[2500::9])
    rows = []
    for i in range(8200):
        text = [f"w{k}" for k in rng.integers(0, 50, 6)]
        if i < 5200:
            text.insert(3, "rotter" if i in late else "scumbag")
        rows.append((i, " ".join(text), "en"))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame([(i, int(i < 5200)) for i in range(8200)], "doc_id long, toxic int")
    model, _ = tx.train(docs, labels)
    score = lambda t: model.score(tx.WordBuckets().of(t))
    assert score("w1 w2 rotter w3") > 0.7 and score("w1 w2 scumbag w3") > 0.7 > score("w1 w2 w4 w3")


def test_best_cut_counts_every_row():
    rng = np.random.default_rng(9)
    bins = rng.integers(-900, 900, 4000)
    labels = (rng.random(4000) < 1 / (1 + np.exp(-bins / 150))).astype(int)
    at, back = np.unique(bins, return_inverse=True)
    found = tx.best_cut((at + 0.5) / tx.STEPS, np.bincount(back), np.bincount(back, labels))
    f1 = lambda c: 2 * labels[bins / tx.STEPS >= c].sum() / ((bins / tx.STEPS >= c).sum() + labels.sum())
    assert f1(found) == pytest.approx(max(f1(b / tx.STEPS) for b in at))


def test_rows_hold_the_whole_model():
    model, other = tx.Model(1), tx.Model(2)
    model.base = np.float32(0.5)
    other.take(model.rows())
    assert other.base == model.base and all((getattr(other, n) == getattr(model, n)).all() and (other.seen[n] == model.seen[n]).all() for n in model.seen)
