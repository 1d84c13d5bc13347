import re

import numpy as np

from grainmill.llm import decontaminate as dc


def sets(text, width=5):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def brute(docs, items):
    out = set()
    for d, t in docs:
        own = sets(t)
        for i, u in items:
            s = sets(u)
            if d is not None and i is not None and s and 100 * len(s & own) >= 80 * len(s):
                out.add((d, i, len(s), len(s & own)))
    return out


def data():
    rng = np.random.default_rng(9)
    words = [f"wort{i}" for i in range(80)]
    text = lambda n: " ".join(rng.choice(words, n))
    items = [(i, text(int(n))) for i, n in enumerate(rng.integers(1, 90, 40))] + [(100, None), (101, " . "), (102, "Only Four words here"), (None, text(30)), (0, text(30))]
    items.append((103, items[5][1]))
    docs = [(i, text(int(rng.integers(0, 40))) + " " + (items[int(rng.integers(0, 40))][1]) + ". " + text(int(rng.integers(0, 4000) if i % 9 == 0 else 20))) for i in range(120)]
    for i in range(60):
        w = items[i % 40][1].split()
        for _ in range(int(rng.integers(1, 4))):
            w[int(rng.integers(0, len(w)))] = "CHANGED"
        docs.append((1000 + i, text(30) + " — " + ", ".join(w).upper() + "\n" + text(10)))
    return docs + [(5000, None), (5001, ""), (5002, "only four WORDS here!"), (None, items[3][1]), docs[0]], items


def test_both_ways_are_brute_force(spark):
    docs, items = data()
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, item_id string")
    i = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert len(want) > 150
    for limit in (dc.SKETCH_BYTES, 0):
        got = [tuple(r) for r in dc.contained_items(d, i, sketch_bytes=limit).collect()]
        if limit:
            assert len(got) == len(set(got)) and set(got) == want
        else:
            assert set(got) == want
    kept = dc.drop_contaminated(d, i).collect()
    hit = {w[0] for w in want}
    assert sorted(str(r.doc_id) for r in kept) == sorted(str(r[0]) for r in docs if r[0] not in hit) and kept[0].item_id == "x"


def test_empty_tables(spark):
    docs, items = data()
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for limit in (dc.SKETCH_BYTES, 0):
        assert dc.contained_items(d.limit(0), i, sketch_bytes=limit).count() == 0
    assert dc.contained_items(d, i.limit(0)).count() == 0
    assert dc.drop_contaminated(d, i.limit(0)).count() == len(docs)
