import math

from pyspark.sql import functions as F

from grainmill.llm import topk_search as ts

SCHEMA = "vec_id long, embedding array<float>, own string, rank string"


def brute(rows, k=5, every=50):
    """(query_id, rank, vec_id, score) of every query row, in no order."""
    sound = [(v, [math.floor(256 * x) for x in e]) for v, e in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for i, (q, w) in enumerate(sound):
        if q is not None and q % every == 0:
            scored = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(w, u)))), v is None, v or 0) for j, (v, u) in enumerate(sound) if j != i)
            out += [(q, r, None if none else v, -s) for r, (s, none, v) in enumerate(scored[:k], 1)]
    return sorted(out, key=str)


def same(spark, rows, every=50, **options):
    df = spark.createDataFrame([(v, e, "x", "y") for v, e in rows], SCHEMA)
    got = ts.top_k(df, F.col("vec_id") % every == 0, **options)
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, options.get("k", 5), every)


def drawn(n, dims, seed=1, step=1):
    state, out = seed, []
    for i in range(n):
        e = []
        for _ in range(dims):
            state = (state * 6364136223846793005 + 1442695040888963407) % 2**64
            e.append(((state >> 40) % 257 - 128) / 512)
        out.append((i * step, e))
    return out


def test_same_as_brute_force_over_many_blocks(spark):
    rows = drawn(160, 7)
    same(spark, rows, every=10, row_block=20, query_block=5)
    same(spark, rows, every=10)
    same(spark, rows, every=10, k=1, row_block=64)


def test_ties_repeated_rows_and_few_candidates(spark):
    same(spark, [(i, [0.5, 0.25]) for i in range(120)], row_block=7)
    same(spark, [(50, [0.1, 0.2])] * 4 + [(7, [0.1, 0.2])] * 9 + [(None, [0.1, 0.2])] * 2, row_block=3)
    same(spark, [(0, [1.0])])
    same(spark, [(0, [1.0]), (3, [2.0])])


def test_nulls_lengths_and_odd_numbers(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, None), (50, []), (100, [1.0, None]), (150, [nan]), (200, [inf, 1.0]), (250, [1.0, -2.0, 3.0]), (300, [0.0, -0.001]), (None, [4.0]), (1, [-inf]), (2, [0.001, 5.0]), (3, [])]
    same(spark, rows, every=50)
    same(spark, rows, every=50, row_block=1, query_block=1)


def test_scores_beyond_32_and_64_bits(spark):
    same(spark, [(0, [3e4, 7.0]), (1, [2e4, -1.0]), (2, [-3e4, 2.0])], every=1)
    same(spark, [(0, [1e14, 1e12]), (1, [1e14, -1e12]), (2, [3e38, 1.0]), (3, [-3e38, 1.0])], every=1)


def test_long_vectors_and_empty_table(spark):
    same(spark, drawn(6, 30_000, seed=5), every=2)
    same(spark, [])


def test_query_reads_the_table(spark, tmp_path):
    rows = drawn(120, 8, seed=3)
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert sorted((tuple(r) for r in ts.op11_term_at_a_time_topk(spark, str(tmp_path)).collect()), key=str) == brute(rows)
