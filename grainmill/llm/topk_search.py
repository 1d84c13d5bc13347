"""Exact top-k search by inner product, term at a time.

Vectors are sparse rows of integer weights by component (the terms). The candidates are dealt to row blocks and the queries to
query blocks, both by the rows' places in a checkpointed table, so that no block grows with the input or with a common id. For
each pair of blocks a task inverts its candidates once: a posting list for each term, with row numbers and weights. Each query
then goes through its terms; each term scatters its weighted postings into a dense array of scores, one for each candidate. The
k highest are taken by partition selection; what all blocks have selected is merged by a ranked window, which Spark limits to
k rows of a query in each task before it shuffles. Every candidate is scored against every query; nothing is pruned.

Defined results: a vector that is null, or holds a null or a component that isn't finite, takes no part, neither as query nor
as candidate. A vector without components takes part and scores 0, as do components that one of two vectors lacks. Scores are
exact; one beyond the range of long is given as its nearest end. Rows that share a vec_id are candidates of each other, and each
such query row has its own answer. A null vec_id is no query; as a candidate it stands behind all ids of the same score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grainmill.llm.common import cut

SCALE = 256
ROW_BLOCK, QUERY_BLOCK = 16384, 16384
LONG = 2**63


def weights(vectors: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, weight) of the components that aren't 0 in the floor of SCALE times them, by row."""
    whole = np.floor(SCALE * vectors.values.to_numpy(zero_copy_only=False)[vectors.offsets[0].as_py() : vectors.offsets[-1].as_py()])
    size = np.diff(vectors.offsets.to_numpy())
    row = np.repeat(np.arange(len(size)), size)
    term = np.arange(len(whole)) - np.repeat(np.cumsum(size) - size, size)
    held = whole != 0
    return row[held], term[held], whole[held]


def most_score(*lists: np.ndarray) -> float:
    """A bound on the size of any score between rows of two lists of weights."""
    return float(np.abs(lists[0]).max(initial=0)) * float(np.abs(lists[1]).max(initial=0))


class Postings:
    """The inverted lists of one block of candidates, sorted by id."""

    def __init__(self, ids: np.ndarray, own: np.ndarray, vectors: pa.ListArray):
        row, term, weight = weights(vectors)
        by_term = np.argsort(term, kind="stable")
        self.ids, self.own, self.weight, self.terms = ids, own, weight[by_term], int(term.max(initial=-1)) + 1
        self.row = row[by_term]
        self.ends = np.searchsorted(term[by_term], np.arange(self.terms + 1))

    def typed(self, kind) -> list[tuple[np.ndarray, np.ndarray]]:
        values = np.array([int(w) for w in self.weight], object) if kind is object else self.weight.astype(kind)
        return [(self.row[a:b], values[a:b]) for a, b in zip(self.ends[:-1], self.ends[1:])]


def search(postings: Postings, vectors: pa.ListArray, own: np.ndarray, k: int):
    """For each query (its number, candidates' numbers, scores): the k highest scores of candidates other than itself, ties to smaller places."""
    row, term, weight = weights(vectors)
    terms = max(postings.terms, int(term.max(initial=-1)) + 1)
    bound = most_score(postings.weight, weight) * max(terms, 1)
    # Exact in the narrowest of the types; object stands for integers of any size.
    kind = np.int32 if bound < 2**31 else np.int64 if bound < 2**62 else object
    lists, ends = postings.typed(kind), np.searchsorted(row, np.arange(len(vectors) + 1))
    scores = np.zeros(len(postings.ids), kind)
    for q in range(len(vectors)):
        scores[:] = 0
        for t, w in zip(term[ends[q] : ends[q + 1]], weight[ends[q] : ends[q + 1]]):
            if t < len(lists):
                rows, held = lists[t]
                np.add.at(scores, rows, held * (int(w) if kind is object else kind(w)))
        others = np.flatnonzero(postings.own != own[q])
        found = others[select(scores[others], k)]
        yield q, found, [max(-LONG, min(LONG - 1, int(s))) for s in scores[found]]


def select(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores (all, if fewer), ties to smaller places; in no order."""
    if len(scores) <= k:
        return np.arange(len(scores))
    least = np.partition(scores, len(scores) - k)[len(scores) - k]
    above = np.flatnonzero(scores > least)
    return np.r_[above, np.flatnonzero(scores == least)[: k - len(above)]]


def _block(k: int):
    def run(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        empty = pa.table({c: pa.array([], pa.int64()) for c in ("own", "query_id", "vec_id", "score")})
        if not candidates.num_rows or not queries.num_rows:
            return empty
        candidates = candidates.sort_by([("vec_id", "ascending")]).combine_chunks()
        queries = queries.combine_chunks()
        one = lambda t, c: t.column(c).chunk(0)
        postings = Postings(np.arange(candidates.num_rows), one(candidates, "own").to_numpy(), one(candidates, "vector"))
        own, qid = one(queries, "own").to_numpy(), one(queries, "vec_id").to_numpy()
        rows, at, score = [], [], []
        for q, found, scores in search(postings, one(queries, "vector"), own, k):
            rows += [q] * len(found)
            at.append(found)
            score += scores
        at = np.concatenate(at) if at else np.empty(0, np.int64)
        return pa.table({"own": pa.array(own[rows], pa.int64()), "query_id": pa.array(qid[rows], pa.int64()), "vec_id": one(candidates, "vec_id").take(pa.array(at, pa.int64())), "score": pa.array(score, pa.int64())})

    return run


def top_k(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", row_block: int = ROW_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank (int, from 1), vec_id, score (long): for each row where `is_query` (a condition on vec_id) holds, its k highest."""
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    sound = F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = cut(base.filter(sound)).withColumn("own", F.monotonically_increasing_id())
    queries = rows.filter(F.col("vec_id").isNotNull() & is_query)
    n_rows, n_queries = -(-rows.count() // row_block) or 1, -(-queries.count() // query_block) or 1
    place = lambda n: F.pmod(F.xxhash64("own"), F.lit(n)).cast("int")
    copied = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = rows.withColumn("row_block", place(n_rows)).withColumn("query_block", copied(n_queries))
    b = queries.withColumn("query_block", place(n_queries)).withColumn("row_block", copied(n_rows))
    on = ["row_block", "query_block"]
    found = a.groupBy(*on).cogroup(b.groupBy(*on)).applyInArrow(_block(k), "own long, query_id long, vec_id long, score long")
    best = Window.partitionBy("own").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op11_term_at_a_time_topk(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(vectors, F.col("vec_id") % 50 == 0)


SQL = """
WITH terms AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM terms q JOIN terms c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
