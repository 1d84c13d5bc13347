import numpy as np

from grainmill.llm import language_id as li

SYLLABLES = {"aa": "ka ki ku ko", "ab": "ka ki ku ke", "ba": "ño ñe ñu ñi", "bb": "ño ñe ñu ña"}


def make(lang, rng, n):
    s = SYLLABLES[lang].split()
    return " ".join("".join(rng.choice(s, 3)) for _ in range(n))


def table(spark, n=200):
    rng = np.random.default_rng(1)
    rows = [(i, make(lang := list(SYLLABLES)[i % 4], rng, int(rng.integers(4, 60))), lang, "s") for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")


def test_families_and_accuracy(spark):
    docs = table(spark)
    model = li.train(docs.filter("doc_id % 5 <> 0"))
    assert model.families == [["aa", "ab"], ["ba", "bb"]] and set(model.pairs) == {("aa", "ab"), ("ba", "bb")}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = [r for r in li.identify(docs, model).collect() if r.doc_id % 5 == 0]
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in rows]) > 0.9 and all(0 <= r.score <= 1 for r in rows)


def test_odd_rows(spark):
    docs = table(spark)
    model = li.train(docs)
    odd = spark.createDataFrame([(1, None, None), (1, None, "aa"), (2, "", "aa"), (3, "12 34 _ ! ½ ²", "aa"), (None, "ka ki", None), (4, "kaki " * 400_000, "aa"), (5, "k", "aa")], "doc_id long, text string, lang string")
    got = {(r.doc_id, r.lang_pred) for r in li.identify(odd, model).collect()}
    assert {(1, "und"), (2, "und"), (3, "und")} <= got and {(d, p) for d, p in got if d == 4} <= {(4, "aa"), (4, "ab")}
    assert sum(1 for r in li.identify(odd, model).collect()) == 7
    assert li.identify(odd.limit(0), model).count() == 0
    assert li.train(docs.limit(0)) is None
    assert {r.lang_pred for r in li.identify(odd, None).collect()} == {"und"}
    one = li.train(docs.filter("lang = 'aa'"))
    assert li.identify(odd.filter("doc_id = 5"), one).first().lang_pred == "aa"


def test_every_language_is_learned_from_whole_texts(spark, monkeypatch):
    """A language of one document, and one that shows only behind 8,000 characters; ids that repeat don't make the sample larger."""
    rng = np.random.default_rng(3)
    rows = [(i, make("aa", rng, 30), "aa") for i in range(20)] + [(100, make("ba", rng, 30), "ba"), (101, "- " * 5000 + make("bb", rng, 300), "bb")]
    rows += [(5, rows[5][1], "aa")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(li, "MAX_ROWS", 6)
    model = li.train(docs)
    assert sorted(k for f in model.families for k in f) == ["aa", "ba", "bb"]
    asked = spark.createDataFrame([(1, make("aa", rng, 40), 1, "x"), (2, make("ba", rng, 40), 2, "y")], "doc_id long, text string, lang_pred int, txt string")
    assert {(r.doc_id, r.lang_pred) for r in li.identify(asked, model).collect()} == {(1, "aa"), (2, "ba")}
