import zlib
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pytest

from grainmill.llm import packing as pk

TEXTS = [
    None, "", " ", "One.", "a b\tc d  e\r\nf\x0b", "It's l’été; don't 'll x's 'S", "Grüße ΣΣ Σas İx éa Å 123abc45,6.7", "<|endoftext|>a <|startoftext|> b<|endoftext|>",
    "中文。文字 \U0001f600\U0001f468‍\U0001f469 กำ क्ष", "word. " * 3000, "x" * 9000, " ̈start", "no end of sentence " * 900, "...!?. |a|b| ,,; end!", "tail\n\n\nof lines.\nmore",
]


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def whole(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def test_word_by_word_is_the_whole_text(tokenizer):
    blanks = [f"a{chr(c)}b {chr(c)}. x" for c in (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF)]
    words = pk.word_ids("word_bpe_49k.json")
    texts = TEXTS + blanks
    ids, counts = words.encode_all(pa.array(texts))
    for text, found in zip(texts, np.split(ids, np.cumsum(counts)[:-1])):
        assert found.tolist() == whole(tokenizer, text), text
    assert [list(s) for s in pk.byte_slices(pa.array(["a" * 9_000_000, "b", None, "c" * 4_000_000, "d" * 400_000, "e"]))] == [[0, 1], [1, 3], [4, 2]]


def test_round_trip(spark, tokenizer):
    rows = [(i, t, 7) for i, t in enumerate(TEXTS * 3)] + [(None, "none", 1), (0, "again", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length long").repartition(3)
    got = pk.pack(df).collect()
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
        assert len(r.ids) == 4 * r.length > 0
    for i, text, _ in rows[:-2]:
        if i:
            pieces = sorted(by_doc[i], key=lambda r: r.start)
            assert [r.start for r in pieces] == list(np.cumsum([0, *(r.length for r in pieces)])[:-1])
            assert np.frombuffer(b"".join(r.ids for r in pieces), "<u4").tolist() == whole(tokenizer, text)
            assert {r.doc_tokens for r in pieces} == {sum(r.length for r in pieces)}
    for pieces in by_seq.values():
        pieces.sort(key=lambda r: r.offset)
        assert [r.offset for r in pieces] == list(np.cumsum([0, *(r.length for r in pieces)])[:-1])
        assert sum(r.length for r in pieces) <= 2048
    assert None in by_doc and zlib.crc32(by_doc[None][0].ids) >= 0
    assert pk.pack(df.limit(0)).count() == 0


def test_cuts_are_the_best():
    rng = np.random.default_rng(3)
    for _ in range(40):
        places = [0, *np.cumsum(rng.integers(1, 60, 40)).tolist()]
        cost = rng.integers(0, 50, len(places)).tolist()
        size = 256

        def price(cuts, places=places, cost=cost, size=size):
            at = dict(zip(places, cost))
            return sum((0 if (n := b - a) & (n - 1) == 0 else size - n) + pk.WINDOW + at[b] for a, b in pairwise(cuts))

        best = [0] + [None] * (len(places) - 1)
        for j in range(1, len(places)):
            best[j] = min(best[i] + price([places[i], places[j]]) for i in range(j) if places[j] - places[i] <= size)
        cuts = pk.best_cuts(places, cost, size)
        assert cuts[0] == 0 and cuts[-1] == places[-1] and price(cuts) == best[-1]
