"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

A test item is contained in a document when the document has at least `percent` of the item's distinct word shingles.
An item's sketch is the bottom of its shingle hashes under one permutation: a containment MinHash whose size depends on
the item's size partition. Items are partitioned by size (powers of two); within a partition the sketch has one hash
more than the largest item of the partition may miss, so that a document that contains an item holds at least one hash
of its sketch: no contained item is lost, however long the document is. Candidates are documents that hold a sketch
hash; they are verified on all shingles of the item.

The sketches of the test items are small, but nothing proves it: their bytes are counted first. Up to SKETCH_BYTES they
go to the tasks and documents are probed in one pass without a shuffle; beyond it documents' shingle hashes are
shuffled and joined with the sketches (aggregated by document and item). Both ways give the same rows.

Defined results: words are runs of letters and digits in lower case. With fewer words than the shingle's width the whole
sequence is one shingle, so a very short item is contained only in a document of just these words. A null or blank item
or text matches nothing. Repeated items or documents give repeated rows of the same ids only once.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.llm.common import WordHashes, as_long, checked_broadcast, cut, in_slices, mix, shingle_hashes

WIDTH, PERCENT = 5, 80
SKETCH_BYTES = 64 << 20
_WORD = re.compile(r"[^\W_]+")


def item_shingles(text: str | None, width: int, cache: WordHashes) -> np.ndarray:
    words = _WORD.findall((text or "").lower())
    return shingle_hashes(cache.of([w.encode("utf-8", "surrogatepass") for w in words]), width)


def sketch_size(n: int, percent: int) -> int:
    """One hash more than any item of n's size partition [2^k, 2^(k+1)) can miss, at most n."""
    largest = (1 << int(n).bit_length()) - 1
    return min(n, largest - -(-largest * percent // 100) + 1)


def _items(width: int, percent: int):
    def run(frames):
        cache = WordHashes()
        for frame in frames:
            rows = []
            for item, text in zip(frame["item_id"], frame["txt"]):
                s = item_shingles(text, width, cache)
                if len(s):
                    order = np.argsort(mix(s), kind="stable")
                    rows.append((item, len(s), as_long(s[order[: sketch_size(len(s), percent)]]), as_long(s)))
            yield pd.DataFrame(rows, columns=["item_id", "n", "sketch", "shingles"])

    return run


class Lookup:
    """Sorted hashes with their items, for probing a document's set at once."""

    def __init__(self, pairs: list[tuple[int, np.ndarray]]):
        hashes = np.concatenate([h for _, h in pairs]) if pairs else np.empty(0, np.int64)
        items = np.repeat(np.array([i for i, _ in pairs], np.int64), [len(h) for _, h in pairs])
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.items = hashes[order], items[order]
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self.hashes & ((1 << 20) - 1)] = True

    def items_of(self, hashes: np.ndarray) -> np.ndarray:
        """The items of each hash that is there, one entry for each (hash, item)."""
        hashes = hashes[self.seen[hashes & ((1 << 20) - 1)]]
        lo, hi = np.searchsorted(self.hashes, hashes, "left"), np.searchsorted(self.hashes, hashes, "right")
        held = hi > lo
        lo, hi = lo[held], hi[held]
        if not len(lo):
            return np.empty(0, np.int64)
        count = hi - lo
        return self.items[np.repeat(lo - np.cumsum(count) + count, count) + np.arange(count.sum())]


def _probed(sketches, width: int, percent: int):
    def make():
        cache, rows = WordHashes(), sketches.value
        probe = Lookup([(k, s) for k, (_, s, _) in enumerate(rows)])
        whole = [shingles for _, _, shingles in rows]

        def run(frame):
            out = []
            for doc_id, text in zip(frame["doc_id"], frame["txt"]):
                s = as_long(item_shingles(text, width, cache))
                for k in np.unique(probe.items_of(s)):
                    shared = int(np.isin(whole[k], s, assume_unique=True).sum())
                    if 100 * shared >= percent * len(whole[k]):
                        out.append((doc_id, rows[k][0], len(whole[k]), shared))
            return pd.DataFrame(out, columns=["doc_id", "item_id", "n_shingles", "n_shared"], dtype=np.int64)

        return run

    return in_slices(make)


def _exploded(width: int):
    def run(frames):
        cache = WordHashes()
        for frame in frames:
            for lo in range(0, len(frame), 512):
                part = frame.iloc[lo : lo + 512]
                sets = [as_long(item_shingles(t, width, cache)) for t in part["txt"]]
                yield pd.DataFrame({"doc_id": np.repeat(part["doc_id"].to_numpy(), [len(s) for s in sets]), "h": np.concatenate(sets) if sets else np.empty(0, np.int64)})

    return run


def contained_items(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    width: int = WIDTH, percent: int = PERCENT, sketch_bytes: int = SKETCH_BYTES,
) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared), all long: the items that a document contains."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("txt")).filter("doc_id IS NOT NULL AND txt IS NOT NULL")
    texts = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("txt")).filter("item_id IS NOT NULL AND txt IS NOT NULL")
    known = cut(texts.mapInPandas(_items(width, percent), "item_id long, n long, sketch array<long>, shingles array<long>"))
    size = known.agg(F.sum(8 * (F.size("sketch") + F.size("shingles")) + 32)).first()[0] or 0
    if size <= sketch_bytes:
        rows = [(r["item_id"], np.array(r["sketch"], np.int64), np.array(r["shingles"], np.int64)) for r in known.toLocalIterator()]
        found = base.mapInArrow(_probed(docs.sparkSession.sparkContext.broadcast(rows), width, percent), "doc_id long, item_id long, n_shingles long, n_shared long")
        return found.distinct()
    # Each distinct item text is named by its own hash; a hash is joined with the sketches, then with the candidates' items.
    known = known.withColumn("key", F.xxhash64("shingles"))
    held = base.mapInPandas(_exploded(width), "doc_id long, h long").distinct()
    sketch = known.select("key", F.explode("sketch").alias("h")).distinct()
    candidates = held.join(sketch, "h").select("doc_id", "key").distinct()
    needed = candidates.join(known.select("key", "n", F.explode("shingles").alias("h")).distinct(), "key").select("doc_id", "key", "n", "h")
    shared = needed.join(held, ["doc_id", "h"]).groupBy("doc_id", "key", "n").agg(F.count("*").alias("n_shared"))
    shared = shared.filter(100 * F.col("n_shared") >= percent * F.col("n"))
    return shared.join(known.select("key", "item_id").distinct(), "key").select("doc_id", "item_id", F.col("n").alias("n_shingles"), "n_shared")


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that contain no item, with all their columns."""
    hit = contained_items(docs, items, id_col, text_col, **options).select(F.col("doc_id").alias("__hit")).distinct()
    return docs.join(checked_broadcast(hit), F.col(id_col).cast("long") == F.col("__hit"), "left_anti")


def op4_containment_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return contained_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


SQL = r"""
WITH doc_words AS (
  SELECT doc_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL
), item_words AS (
  SELECT item_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark WHERE text IS NOT NULL
), doc_shingles AS (
  SELECT DISTINCT id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM doc_words
), item_shingles AS (
  SELECT DISTINCT id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM item_words
), sizes AS (
  SELECT id, count(*) AS n FROM item_shingles GROUP BY id
)
SELECT d.id AS doc_id, i.id AS item_id, z.n AS n_shingles, count(*) AS n_shared
FROM doc_shingles d JOIN item_shingles i ON d.s = i.s JOIN sizes z ON z.id = i.id
GROUP BY d.id, i.id, z.n HAVING 100 * count(*) >= 80 * z.n
"""
