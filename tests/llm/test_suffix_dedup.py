import hashlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from grainmill.llm import suffix_dedup as sd


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        cover = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                cover[i : i + length] = True
        cover = cover[: len(d)]
        spans = int((np.diff(np.r_[0, cover.astype(int)]) == 1).sum())
        kept = bytes(np.frombuffer(d, np.uint8)[~cover])
        out.append((len(d), int(cover.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def texts():
    rng = np.random.default_rng(5)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(300)] + ["é", "ß"]
    make = lambda n: " ".join(words[i] for i in rng.integers(0, len(words), n))
    shared, long_shared = make(75), make(300)
    rows = [None, "", "x" * 399, "x" * 400, "y" * 401, "abc" * 400, make(20), make(900)]
    rows += [make(40) + shared[: 380 + 10 * i] + make(30) for i in range(8)]
    rows += [make(5) + long_shared + make(50) + long_shared[300:1100] for _ in range(4)]
    rows += [long_shared, long_shared, rows[7], rows[7][:1000] + "Q" + rows[7][1000:]]
    return rows


@pytest.mark.parametrize("chunk", [50_000, 2])
def test_same_as_brute_force(spark, chunk):
    rows = texts()
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(rows)], "doc_id long, text string, pos string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.remove_repeats(df, chunk=chunk).collect()}
    assert [got[i] for i in range(len(rows))] == brute(rows, 400)


def random_text(rng, n):
    return "".join(chr(97 + c) for c in rng.integers(0, 26, n))


@pytest.mark.parametrize("chunk", [50_000, 2])
def test_lone_context_beside_repeated_ones(spark, chunk):
    """A quotes what only two near copies hold: all of A's contexts are met once, theirs twice."""
    rng = np.random.default_rng(8)
    rows = []
    for n in (400, 405, 450, 500, 599, 900):
        region = random_text(rng, 3000)
        rows += [random_text(rng, 500) + region + random_text(rng, 500), random_text(rng, 700) + region + random_text(rng, 300)]
        rows.append(random_text(rng, 600) + region[1000 : 1000 + n] + random_text(rng, 600))
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.remove_repeats(df, chunk=chunk).collect()}
    assert [got[i] for i in range(len(rows))] == brute(rows, 400)


def test_window_twice_in_one_chunk_and_once_in_another():
    rng = np.random.default_rng(10)
    passage = random_text(rng, 400).encode()
    before = [random_text(rng, 200).encode() for _ in range(4)]
    frame = pd.DataFrame({"gram": 7, "chunk": [0, 0, 1, 1], "chunks": 2, "lone": True, "did": [-1, 2, 3, 4], "d2": [5, 6, -7, 8], "pos": [200, 300, 400, 500], "before": before, "behind": [passage] * 3 + [passage[::-1]]})
    rows = pd.concat(sd._sorted_groups(400, 1)(iter([frame])), ignore_index=True)
    within, packs = rows[rows["part"].isna()], rows[rows["part"].notna()]
    across = pd.concat(sd._across_chunks(400)(iter([packs])), ignore_index=True)
    assert sorted(zip(within["did"], within["lo"], within["hi"])) == [(-1, 200, 600), (2, 300, 700)]
    assert list(zip(across["did"], across["d2"], across["lo"], across["hi"])) == [(3, -7, 400, 800)]


def test_passages_of_three_over_small_chunks(spark):
    rng = np.random.default_rng(11)
    rows = []
    for n in (400, 430, 480, 560, 700, 1200):
        passage = random_text(rng, n)
        rows += [random_text(rng, 250) + passage + random_text(rng, 250) for _ in range(3)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.remove_repeats(df, chunk=2).collect()}
    assert [got[i] for i in range(len(rows))] == brute(rows, 400)


def test_other_text_with_the_id_of_a_copy(spark):
    """Rows that share a doc_id are different documents: only the copy itself is left out."""
    rng = np.random.default_rng(9)
    copy, shared = random_text(rng, 900), random_text(rng, 450)
    rows = [copy, copy, random_text(rng, 100) + shared + random_text(rng, 100), random_text(rng, 50) + shared + random_text(rng, 70)]
    df = spark.createDataFrame(list(zip([1, 2, 1, 3], rows)), "doc_id long, text string")
    got = sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.remove_repeats(df).collect())
    assert got == sorted(brute(rows, 400))


def test_hot_texts_grams_and_contexts(spark, monkeypatch):
    """With low bounds for what is hot: one text in a third of the rows, one passage in another third, periodic texts."""
    from grainmill.llm import common

    monkeypatch.setattr(common, "LEAST_HOT", 3)
    rng = np.random.default_rng(12)
    copy, passage = random_text(rng, 900), random_text(rng, 600)
    rows = [copy] * 20 + [random_text(rng, 50 + 7 * i) + passage + random_text(rng, 100) for i in range(20)]
    rows += ["ab " * 300, "ab " * 250 + random_text(rng, 500), random_text(rng, 300) + copy[200:750], random_text(rng, 450), None]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.remove_repeats(df).collect()}
    assert [got[i] for i in range(len(rows))] == brute(rows, 400)


def test_clashing_columns_and_large_ids(spark):
    big = 2**62 + 1
    df = spark.createDataFrame([(big, "q7" * 300, 1, "a", 2), (None, "r" * 10, 1, "b", 2), (big + 2, "q7" * 250, 1, "c", 2)], "doc_id long, text string, did int, gram string, salt int")
    got = {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in sd.remove_repeats(df).collect()}
    assert got == {(big, 600, 600, 1), (None, 10, 0, 0), (big + 2, 500, 500, 1)}


def test_empty_table_and_repeated_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert sd.remove_repeats(none).count() == 0
    twice = spark.createDataFrame([(1, "z1" * 300), (1, "z1" * 300), (None, "k" * 10)], "doc_id long, text string")
    assert sorted((r.n_bytes, r.n_removed) for r in sd.remove_repeats(twice).collect()) == [(10, 0), (600, 600), (600, 600)]


def test_deep_shallow_orders_suffixes():
    rng = np.random.default_rng(1)
    base = bytes(rng.integers(97, 100, 400).astype(np.uint8))
    strings = [base[i:] for i in range(300)] + [base[:200], base[:200], b"", b"\0", base[:200] + b"\0"]
    groups = np.zeros(len(strings), np.int64)
    order, common = sd.deep_shallow(strings, groups)
    assert [strings[i] for i in order] == sorted(strings)
    assert common[0] == -1
    for i in range(1, len(strings)):
        a, b, k = strings[order[i - 1]], strings[order[i]], common[i]
        assert a[:k] == b[:k] and a[k : k + 1] != b[k : k + 1] or k == len(a) == len(b)
