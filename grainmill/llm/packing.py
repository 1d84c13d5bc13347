"""Order-preserving packing of tokenised documents into sequences, by dynamic programming.

Documents keep the order in which the table is read; nothing is shuffled and nothing passes the driver. Within a task
documents are gathered to blocks of about BLOCK tokens. In a block, window cuts are chosen among document ends, sentence
ends and, where a sentence is long, places inside it, so that the sum of padding, of a fixed cost per window and of
penalties for cuts inside documents is least. The padding of a window from i to j is (size - (S[j] - S[i])), so the best
i for a j is the least of D[i] + S[i] over those within `size` tokens: a sliding minimum, kept in a monotone queue. A
window whose length is a power of two needs no padding; those few lengths are looked up exactly.

Token ids are found word by word, with a bounded memory of words; a word is what stands between spaces and newlines,
which neither the normaliser nor the splitter of the vocabulary joins.

Defined results: a null text is empty; every document ends with the end id, so that an empty one is one token. Repeated
rows are packed as often as they are there. A null doc_id stays null in its pieces.
"""

from __future__ import annotations

import os
from unicodedata import is_normalized

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE = 2048
BLOCK = 1 << 20
END_ID = 1
#: In tokens: cost of a window, of a cut at a sentence's end, of a cut inside a sentence.
WINDOW, SENTENCE, INSIDE = 8, 3, 48
STRIDE = 256
#: Stems that a Python worker remembers.
STEMS = 150_000


class WordIds:
    """Ids of words by a vocabulary; stems (words without the signs behind them, in lower case) are remembered up to a bound."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # Stems are normalised already; they skip the normaliser and the splitter but for white space.
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.stems: dict[str, bytes] = {"": b""}
        self.tails: dict[int, bytes] = {0: b""}
        vocabulary = self.tokenizer.get_vocab()
        self.sentence_end = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.sentence_end[[i for t, i in vocabulary.items() if (w := t.removesuffix("</w>")) and any(c in ".!?" for c in w) and not any(c.isalnum() for c in w)]] = True
        self.word_end = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.word_end[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def stem_ids(self, stems: list[str]) -> list[bytes | None]:
        """The ids of each stem; None for those that aren't plain letters. Unknown ones are encoded at once."""
        if len(self.stems) > STEMS:
            self.stems = {"": b""}
        known = self.stems
        new = [s for s in stems if s not in known and s.isalpha() and "σ" not in s and "ς" not in s and is_normalized("NFC", s)]
        if new:
            ids = np.array(self.plain.encode_batch_fast([" ".join(new).encode().decode("latin-1").translate(BYTE_LETTERS)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.word_end[ids]) + 1
            if len(ends) == len(new):
                raw, at = ids.tobytes(), 0
                for stem, end in zip(new, (4 * ends).tolist()):
                    known[stem] = raw[at:end]
                    at = end
        return list(map(known.get, stems))

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with the end id behind it, and each text's count.

        Letters make one piece of a word and the signs behind them another, so that a word is its stem and its tail; both
        are looked up once for each that differs. Words of another make are encoded as they are, once each.
        """
        lists = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary
        core = pc.utf8_rtrim(words, characters=SIGNS)
        tail = pc.binary_length(words).to_numpy(zero_copy_only=False) - pc.binary_length(core).to_numpy(zero_copy_only=False)
        stem = pc.utf8_lower(core).dictionary_encode()
        of_stem = self.stem_ids(stem.dictionary.to_pylist())
        stem_at = stem.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        # The one letter whose lower case is two characters.
        odd = np.array([s is None for s in of_stem], bool)[stem_at] | (tail > 8) | pc.match_substring(words, "İ").to_numpy(zero_copy_only=False)
        codes = np.where(odd, 0, _tail_codes(words, tail))
        tails, tail_at = np.unique(codes, return_inverse=True)
        for code in tails.tolist():
            if code not in self.tails:
                self.tails[code] = self.encode(int(code).to_bytes(8, "little").rstrip(b"\0")[::-1].decode())
        strange = words.filter(pa.array(odd)).to_pylist()
        pieces = [s or b"" for s in of_stem] + [self.tails[c] for c in tails.tolist()] + [self.encode(w) for w in strange]
        size = np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4
        table, first = np.frombuffer(b"".join(pieces), "<u4"), np.cumsum(size) - size
        stem_at[odd] = len(of_stem) + len(tails) + np.arange(len(strange))
        both = np.stack([stem_at, len(of_stem) + tail_at], axis=1)[coded.indices.to_numpy(zero_copy_only=False)].ravel()
        count = size[both]
        done = np.r_[0, np.cumsum(count)]
        ids = table[np.repeat(first[both] - done[:-1], count) + np.arange(done[-1])]
        ends = done[2 * np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]
        return np.insert(ids, ends, END_ID).astype("<u4", copy=False), np.diff(np.r_[0, ends]) + 1


def _tail_codes(words: pa.Array, tail: np.ndarray) -> np.ndarray:
    """The last bytes of each word, up to eight, as one number: the last byte lowest."""
    _, offsets, data = words.buffers()
    ends = np.frombuffer(offsets, np.int32)[words.offset + 1 : words.offset + 1 + len(words)].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(1, np.uint8)
    codes = np.zeros(len(words), np.uint64)
    for k in range(8):
        on = tail > k
        codes[on] |= raw[ends[on] - 1 - k].astype(np.uint64) << np.uint64(8 * k)
    return codes


def byte_letters() -> dict[int, str]:
    """The letter for each byte but the space, as byte-level vocabularies write it: printable ones as they are, the others from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(sorted({*range(256)} - {*printable})) if b != 32}


BYTE_LETTERS = byte_letters()
SIGNS = '.,;:!?|*#$%&"()[]{}<>-_/+=~@^`'
SLICE_BYTES = 4 << 20


_KNOWN: dict[str, WordIds] = {}


def word_ids(name: str) -> WordIds:
    """One memory of words for each Python worker and vocabulary."""
    if name not in _KNOWN:
        if os.path.isabs(name):
            path = name
        else:
            import public_tokenizers

            path = public_tokenizers.path(name)
        _KNOWN[name] = WordIds(path)
    return _KNOWN[name]


def candidates(ids: np.ndarray, ends: np.ndarray, sentence_end: np.ndarray) -> tuple[list[int], list[int]]:
    """Places where a block can be cut, from 0 to its length, and what a cut there costs."""
    known = np.minimum(ids, len(sentence_end) - 1)
    at = np.union1d(np.flatnonzero(sentence_end[known]) + 1, np.r_[0, ends])
    gaps = np.flatnonzero(np.diff(at) > STRIDE)
    inside = [np.arange(at[g] + STRIDE, at[g + 1], STRIDE) for g in gaps]
    places = np.sort(np.concatenate([at, *inside]))
    cost = np.full(len(places), INSIDE)
    cost[np.searchsorted(places, at)] = SENTENCE
    cost[np.searchsorted(places, np.r_[0, ends])] = 0
    return places.tolist(), cost.tolist()


def best_cuts(places: list[int], cost: list[int], size: int = SIZE) -> list[int]:
    """The places to cut at, from the first to the last, of least total cost."""
    exact = [1 << k for k in range(size.bit_length()) if 1 << k < size]
    index = {p: i for i, p in enumerate(places)}
    n = len(places)
    total, before = [0] * n, [0] * n
    queue, values, head = [0], [places[0]], 0
    for j in range(1, n):
        p = places[j]
        while p - places[queue[head]] > size:
            head += 1
        i = queue[head]
        least = values[head] + size - p
        for length in exact:
            k = index.get(p - length)
            if k is not None and total[k] < least:
                least, i = total[k], k
        total[j] = least = least + WINDOW + cost[j]
        before[j] = i
        key = least + p
        while len(queue) > head and values[-1] >= key:
            queue.pop()
            values.pop()
        queue.append(j)
        values.append(key)
    cuts, j = [places[-1]], n - 1
    while j:
        j = before[j]
        cuts.append(places[j])
    return cuts[::-1]


def pack_block(doc_ids: list, tokens: list[np.ndarray], sentence_end: np.ndarray, first_sequence: int, size: int) -> tuple[pd.DataFrame, int]:
    """The pieces of a block's documents; the number of its sequences."""
    ids = np.concatenate(tokens)
    ends = np.cumsum([len(t) for t in tokens])
    cuts = np.array(best_cuts(*candidates(ids, ends, sentence_end), size))
    bounds = np.union1d(cuts, ends)
    lo, hi = np.r_[0, bounds[:-1]] if bounds[0] else bounds[:-1], bounds if bounds[0] else bounds[1:]
    doc = np.searchsorted(ends, lo, "right")
    window = np.searchsorted(cuts, lo, "right") - 1
    raw = memoryview(ids).cast("B")
    begin = ends - np.diff(np.r_[0, ends])
    out = pd.DataFrame(
        {
            "doc_id": pd.array([doc_ids[d] for d in doc], "Int64"),
            "start": lo - begin[doc],
            "length": hi - lo,
            "doc_tokens": (ends - begin)[doc],
            "sequence_id": first_sequence + window,
            "offset": lo - cuts[window],
            "ids": [bytes(raw[4 * a : 4 * b]) for a, b in zip(lo.tolist(), hi.tolist())],
        }
    )
    return out, len(cuts) - 1


def byte_slices(texts: pa.Array):
    """(start, rows) of slices of about SLICE_BYTES."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        to = int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE_BYTES, "right"))
        to = max(at + 1, to)
        yield at, to - at
        at = to


def _packed(tokenizer: str, size: int):
    def run(batches):
        words, first = word_ids(tokenizer), TaskContext.get().partitionId() << 32
        doc_ids: list = []
        tokens: list = []
        held = 0
        for batch in batches:
            for at, rows in byte_slices(batch.column(1)):
                ids, counts = words.encode_all(batch.column(1).slice(at, rows))
                for doc_id, found in zip(batch.column(0).slice(at, rows).to_pylist(), np.split(ids, np.cumsum(counts)[:-1])):
                    doc_ids.append(doc_id)
                    tokens.append(found)
                    held += len(found)
                    if held >= BLOCK:
                        pieces, n = pack_block(doc_ids, tokens, words.sentence_end, first, size)
                        yield from _batches(pieces)
                        first, doc_ids, tokens, held = first + n, [], [], 0
        if tokens:
            yield from _batches(pack_block(doc_ids, tokens, words.sentence_end, first, size)[0])
        pa.default_memory_pool().release_unused()

    return run


def _batches(frame: pd.DataFrame):
    yield pa.RecordBatch.from_pandas(frame, schema=pa.schema([*((c, pa.int64()) for c in frame.columns[:-1]), ("ids", pa.binary())]), preserve_index=False)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "word_bpe_49k.json", size: int = SIZE) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset (long), ids (binary: unsigned little-endian 32-bit)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("txt"))
    return rows.mapInArrow(_packed(tokenizer, size), "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def op5_dp_packing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
