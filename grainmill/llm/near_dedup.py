"""MinHash near-dedup with odd sketches.

1. Each task turns whole texts into the set of their word shingles and keeps of it: its size, a 128-bit signature,
   MinHash bands, and an odd sketch (each MinHash sample flips one bit of a bitmap). This small table is checkpointed.
2. Documents with equal sets are one node: only the smallest id of a signature goes on (aggregated before the shuffle).
3. In every band bucket each document is paired with the bucket's smallest id only, never with all others. The XOR of
   two odd sketches has a bit count from which their similarity is estimated; pairs clearly below the threshold go.
   The others are confirmed on full shingle sets, rebuilt from the texts of just the documents that share a bucket; an
   odd sketch of the full set, whose bit count can't exceed the sets' difference, spares most of these comparisons.
4. Buckets that still hold more than one component get the remaining pairs looked at: the rows outside the bucket's
   largest component (the few) meet all rows of the bucket in blocks of bounded size, compared by odd sketch inside the
   task. Twice only the nearest row of another component leaves the task and is confirmed as before, which joins nearly
   all that belongs together; then all likely links that are still open. No cap on partners or candidates.
5. Components by star contraction.

A pair at the threshold shares no band with probability (1 - 0.8**4)**24 = 3e-6; more similar pairs, less.

Defined results: A-Z are lower-cased, words are runs of other than space and U+0009 to U+000D. With fewer words than
the shingle's width the whole sequence is one shingle; a null or blank text has no shingle and no link, and is its own
component. Rows that share a doc_id are one node and carry all their links. A null doc_id has no component and is kept.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.llm.common import U64, WordHashes, as_long, checked_broadcast, cut, in_slices, mix, shingle_hashes, utf8
from grainmill.llm.graph import components

BANDS, ROWS, BITS, FULL_BITS = 24, 4, 512, 1024
SAMPLES = BANDS * ROWS
BLOCK = 512
GROUP = ["bucket", "part", "block"]
#: Stands for a null id inside the operator.
NO_ID = -(2**63)
_rng = np.random.default_rng(20240229)
_MUL = _rng.integers(1, 2**63, SAMPLES, dtype=np.uint64) * U64(2) + U64(1)
_ADD = _rng.integers(0, 2**63, SAMPLES, dtype=np.uint64)


def doc_shingles(text: str | None, width: int, cache: WordHashes) -> np.ndarray:
    return shingle_hashes(cache.of(utf8(text).lower().split()), width)


def min_hashes(shingles: np.ndarray) -> np.ndarray:
    """The MinHash samples of a set that isn't empty; long sets are taken in blocks."""
    least = np.full(SAMPLES, 2**64 - 1, np.uint64)
    for at in range(0, len(shingles), 2048):
        part = shingles[at : at + 2048]
        np.minimum(least, (part[None, :] * _MUL[:, None] + _ADD[:, None]).min(axis=1), out=least)
    return least


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """A bitmap of BITS bits as 64-bit words: each (sample number, value) flips one bit."""
    at = (mix(samples + np.arange(SAMPLES, dtype=np.uint64) * U64(0x9E3779B97F4A7C15)) % U64(BITS)).astype(np.int64)
    bits = np.bincount(at, minlength=BITS).astype(np.uint8) & 1
    return np.packbits(bits).view(np.uint64)


def most_odd_bits(threshold: float) -> int:
    """Pairs of the threshold's similarity or more differ in at most so many bits, but for six standard deviations.

    k samples of similarity J differ in about 2k(1-J) values, which flip n/2 (1 - exp(-2d/n)) bits of n.
    """
    low = max(0.0, threshold - 6 * (threshold * (1 - threshold) / SAMPLES) ** 0.5)
    return int(np.ceil(BITS / 2 * (1 - np.exp(-4 * SAMPLES * (1 - low) / BITS)) + 6))


def _sketches(width: int):
    def make():
        cache = WordHashes()

        def run(frame):
            n, s1, s2, bands, odd = [], [], [], [], []
            for text in frame["txt"]:
                s = doc_shingles(text, width, cache)
                n.append(len(s))
                s1.append(s.sum(dtype=np.uint64))
                s2.append(mix(s ^ U64(0xA5A5A5A5)).sum(dtype=np.uint64))
                if not len(s):
                    bands.append([]), odd.append([])
                    continue
                least = min_hashes(s)
                rows = least.reshape(BANDS, ROWS)
                key = np.arange(1, BANDS + 1, dtype=np.uint64)
                for r in range(ROWS):
                    key = mix(key * U64(0x9E3779B97F4A7C15) + rows[:, r])
                bands.append(as_long(key))
                odd.append(as_long(odd_sketch(least)))
            signs = {"s1": as_long(np.array(s1, np.uint64)), "s2": as_long(np.array(s2, np.uint64))}
            return pd.DataFrame({"doc_id": frame["doc_id"], "n": np.array(n, np.int64), **signs, "bands": long_lists(bands), "odd": long_lists(odd)})

        return run

    return in_slices(make)


def long_lists(rows: list) -> pd.Series:
    """Lists of long, empty ones too, as a column that Arrow takes for such."""
    return pd.Series(pa.array(rows, pa.list_(pa.int64())), dtype=pd.ArrowDtype(pa.list_(pa.int64())))


def parity(shingles: np.ndarray) -> np.ndarray:
    """The odd sketch of the whole set: two sets differ in at least as many shingles as their bitmaps differ in bits."""
    bits = np.bincount((mix(shingles + U64(11)) % U64(FULL_BITS)).astype(np.int64), minlength=FULL_BITS).astype(np.uint8) & 1
    return np.packbits(bits).view(np.uint64)


def _sets(width: int):
    def make():
        cache = WordHashes()

        def run(frame):
            sets = [doc_shingles(t, width, cache) for t in frame["txt"]]
            columns = {"full": long_lists([as_long(parity(s)) for s in sets]), "set": long_lists([as_long(s) for s in sets])}
            return pd.DataFrame({"doc_id": frame["doc_id"], "n": np.array([len(s) for s in sets], np.int64), **columns})

        return run

    return in_slices(make)


def _odd_distance(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("int")), F.lit(0), lambda s, x: s + x)


def _named(traits: DataFrame, end: str) -> DataFrame:
    return traits.select(F.col("doc_id").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in ("n", "odd", "full")])


def _confirmed(pairs: DataFrame, sets: DataFrame, traits: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose full shingle sets are similar enough; checkpointed."""
    near = (
        pairs.join(_named(traits, "a"), "a")
        .join(_named(traits, "b"), "b")
        .filter(_odd_distance("odd_a", "odd_b") <= most_odd_bits(percent / 100))
        .filter((100 + percent) * _odd_distance("full_a", "full_b") <= (100 - percent) * (F.col("n_a") + F.col("n_b")))
        .select("a", "b")
        .distinct()
    )
    full = near.join(sets.select(F.col("doc_id").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("set").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return cut(full.filter(100 * common >= percent * (F.size("sa") + F.size("sb") - common)).select("a", "b").distinct())


def _likely(percent: int, nearest: bool):
    """Rows of (bucket, probes' part, block) groups: each probe against the rows of other components, by odd sketches; all likely ones, or the nearest of them."""
    most = most_odd_bits(percent / 100)

    def pairs_of(keys, ids, comps, probes, odd, full, size, nodes):
        ends = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1), True])
        for lo, hi in zip(ends[:-1], ends[1:]):
            p, m = np.flatnonzero(probes[lo:hi]) + lo, np.flatnonzero(~probes[lo:hi]) + lo
            for i in p:
                far = m[comps[m] != comps[i]]
                bits = np.bitwise_count(odd[far] ^ odd[i]).sum(axis=1)
                far = far[bits <= most]
                # The sets differ in at least so many shingles; more than this none of the similarity can.
                apart = np.bitwise_count(full[far] ^ full[i]).sum(axis=1)
                near = (100 + percent) * apart <= (100 - percent) * (size[far] + size[i])
                hit, apart = far[near], apart[near]
                if nearest:
                    hit = hit[apart.argmin() : apart.argmin() + 1] if len(hit) else hit
                nodes.append(np.stack([np.minimum(ids[hit], ids[i]), np.maximum(ids[hit], ids[i])], axis=1))

    def run(frames):
        rest = None
        for frame in frames:
            frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            last = (frame[GROUP] == frame[GROUP].iloc[-1]).all(axis=1)
            rest, whole = frame[last], frame[~last]
            yield from found(whole)
        if rest is not None:
            yield from found(rest)

    def found(f):
        if not len(f):
            return
        nodes: list = []
        pairs_of(f[GROUP].to_numpy(), f["id"].to_numpy(), f["comp"].to_numpy(), f["probe"].to_numpy(bool), np.stack(f["odd"].to_list()).view(np.uint64), np.stack(f["full"].to_list()).view(np.uint64), f["n"].to_numpy(), nodes)
        both = np.unique(np.concatenate(nodes), axis=0) if nodes else np.empty((0, 2), np.int64)
        yield pd.DataFrame({"a": both[:, 0], "b": both[:, 1]})

    return run


def _left_over(members: DataFrame, comps: DataFrame, traits: DataFrame, percent: int, nearest: bool) -> DataFrame:
    """Likely pairs of a bucket that are in different components so far."""
    rows = members.join(comps.withColumnRenamed("node", "id"), "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("comp"))
    sizes = rows.groupBy("bucket", "comp").agg(F.count("*").alias("c"))
    mixed = sizes.groupBy("bucket").agg(F.sum("c").alias("m"), F.count("*").alias("kinds"), F.max(F.struct("c", "comp")).alias("top")).filter((F.col("kinds") > 1) & (F.col("m") > 2))
    # Rows and probes are both dealt, so that no task takes more than a block of each at a time.
    blocks, parts = F.ceil(F.col("m") / BLOCK).cast("int"), F.ceil((F.col("m") - F.col("top.c")) / BLOCK).cast("int")
    mixed = mixed.select("bucket", F.col("top.comp").alias("top"), blocks.alias("blocks"), parts.alias("parts"))
    rows = rows.join(mixed, "bucket").join(traits.withColumnRenamed("doc_id", "id"), "id")
    of = lambda count: F.pmod(F.xxhash64("id"), F.col(count)).cast("int")
    each = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    held = ("id", "comp"), ("odd", "full", "n")
    dealt = rows.select("bucket", each("parts").alias("part"), of("blocks").alias("block"), *held[0], F.lit(False).alias("probe"), *held[1]).union(
        rows.filter("comp <> top").select("bucket", of("parts").alias("part"), each("blocks").alias("block"), *held[0], F.lit(True).alias("probe"), *held[1])
    )
    return dealt.repartition(*GROUP).sortWithinPartitions(*GROUP).mapInPandas(_likely(percent, nearest), "a long, b long").distinct()


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles (long), component_id (long)."""
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("txt"))
    known = cut(base.mapInArrow(_sketches(width), "doc_id long, n long, s1 long, s2 long, bands array<long>, odd array<long>"))
    usable = known.filter((F.col("n") > 0) & (F.col("doc_id") != NO_ID))
    same = usable.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    reps = usable.join(same.select(F.col("rep").alias("doc_id"), "s1", "s2"), ["doc_id", "s1", "s2"], "left_semi").dropDuplicates(["doc_id", "s1", "s2"])
    odd = reps.select("doc_id", "odd")
    banded = reps.select(F.explode("bands").alias("bucket"), F.col("doc_id").alias("id"))
    leaders = banded.groupBy("bucket").agg(F.min("id").alias("leader"), F.count("*").alias("m")).filter("m > 1")
    members = banded.join(leaders, "bucket")
    members = cut(members.select("bucket", "id", "leader"))
    # Full sets of the documents that share a bucket with another; only if these are very many are the texts shuffled, once.
    sets = cut(base.join(checked_broadcast(members.select(F.col("id").alias("doc_id")).distinct()), "doc_id", "left_semi").select("doc_id", "txt").mapInArrow(_sets(width), "doc_id long, n long, full array<long>, set array<long>"))
    traits = cut(sets.join(odd, "doc_id").select("doc_id", "n", "odd", "full"))
    tested = members.filter("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
    comps = components(_confirmed(tested, sets, traits, percent), "a", "b")
    members = members.select("bucket", "id")
    for nearest in (True, True, False):
        more = cut(_left_over(members, comps, traits, percent, nearest).join(tested, ["a", "b"], "left_anti"))
        if more.isEmpty():
            continue
        found = _confirmed(more, sets, traits, percent)
        tested = tested.union(more)
        if not found.isEmpty():
            # What was joined before goes on as stars, so that few rounds are left.
            comps = components(comps.select(F.col("component").alias("a"), F.col("node").alias("b")).union(found), "a", "b")
    copies = usable.join(same.filter("copies > 1").select("s1", "s2", "rep"), ["s1", "s2"]).filter("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    comps = components(comps.select(F.col("component").alias("a"), F.col("node").alias("b")).union(copies), "a", "b")
    return (
        known.select("doc_id", F.col("n").alias("n_shingles"))
        .join(comps.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        .select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "n_shingles", F.nullif(F.coalesce("component", "doc_id"), F.lit(NO_ID)).alias("component_id"))
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The documents with the smallest id of their component, with all their columns; rows of one id, or of none, stay together."""
    gone = near_components(docs, id_col, text_col, width, percent).filter("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(checked_broadcast(gone), F.col(id_col).cast("long") == F.col("__gone"), "left_anti")


def op10_odd_sketch_near_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_components(docs, width=2, percent=80).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), shingles AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
         ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END) AS s
  FROM words
), sizes AS (
  SELECT doc_id, count(s) AS n FROM shingles GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * k >= 80 * (x.n + y.n - k)
), both_ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(doc_id, seen) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT e.b, r.seen FROM reach r JOIN both_ways e ON e.a = r.doc_id WHERE r.seen < e.b
)
SELECT d.doc_id, coalesce(max(z.n), 0) AS n_shingles, min(r.seen) AS component_id, min(r.seen) = d.doc_id AS kept
FROM documents d JOIN reach r USING (doc_id) LEFT JOIN sizes z USING (doc_id) GROUP BY d.doc_id
"""
