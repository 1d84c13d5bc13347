import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from grainmill.llm import prefix_trie as pt

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
SCHEMA = "conv_id long, turn long, role string, text string, depth string, p1 string"


def brute(rows):
    """The nodes of all rebuilt conversations. rows: (conv_id, turn, role, text), no two of a conversation with one turn but different contents."""
    own = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own.setdefault(c, []).append((role or "", text or ""))
    members = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        first = c - (c % 5 if c >= 0 else -(-c % 5))
        path = (*own.get(first, [])[:h], *turns[h:])
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append((c, len(path) == d))
    out = {}
    for path in sorted(members, key=len, reverse=True):
        ids = [c for c, _ in members[path]]
        kids = [p for p in members if len(p) == len(path) + 1 and p[: len(path)] == path]
        ends = ",".join(map(str, sorted(c for c, end in members[path] if end)))
        saved = (len(ids) - 1) * len(path[-1][1].encode()) if path else 0
        parent = min(c for c, _ in members[path[:-1]]) if path else None
        leaves = sum(out[k][5] for k in kids) if kids else 1
        out[path] = (min(ids), len(path), parent, len(ids), len(kids), leaves, saved + sum(out[k][6] for k in kids), hashlib.sha256(ends.encode()).hexdigest())
    return sorted(out.values(), key=str)


def same(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    got = pt.trie(df, **options)
    assert tuple(got.columns) == COLUMNS and {t for _, t in got.dtypes} == {"bigint", "string"}
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def drawn(n=60, most=12):
    """Conversations with common beginnings, some of them copies."""
    return [(c, t, "user" if t % 2 == 0 else "assistant", f"turn {t} of {c // (1 + 7 * (t < 4)) if c % 3 else 'all'} é") for c in range(n) for t in range((c * 7) % most + 1)]


@pytest.mark.parametrize("limit", [2, 30])
def test_same_as_brute_force_at_every_limit(spark, limit):
    same(spark, drawn(), limit=limit)


def test_many_copies_and_a_long_conversation(spark):
    rows = [(c, t, "user", f"the same {t}") for c in range(150) for t in range(3)] + [(1001, t, "user", f"long {t % 3}") for t in range(90)]
    same(spark, rows, limit=20)
    same(spark, rows)


def test_nulls_gaps_empty_and_very_long_texts(spark):
    rows = [(None, 1, "user", "no conversation"), (3, None, "user", "first"), (3, 5, None, None), (3, 9, "", ""), (4, 7, "a", "b" * 300_000), (4, 8, "ab", ""), (6, 8, "a", "b"), (-7, 0, "user", "below"), (-5, 0, "user", "base")]
    rows += [(c, t, "user", f"{t}") for c in (5, 20, 21, 22, 23, 24) for t in range(10)]
    same(spark, rows)
    same(spark, rows, limit=3)
    same(spark, [(7, 0, "user", "gone")])


def test_repeated_rows_are_turns_and_ties_have_an_order(spark):
    same(spark, [(0, 1, "user", "again")] * 5 + [(1, 1, "user", "again")] * 7)
    a, b = ((0, 1, "user", "one"), (0, 1, "user", "two"))
    one, two = (sorted(map(tuple, pt.trie(spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA)).collect()), key=str) for rows in ([a, b], [b, a]))
    assert one == two and len(one) >= 1


def test_empty_tables(spark):
    same(spark, [])
    same(spark, [(None, 1, "user", "x")])


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(-6, 11), st.lists(st.sampled_from(["a", "b", None]), max_size=11)), max_size=14, unique_by=lambda x: x[0]), st.integers(1, 9))
def test_any_rows(spark, convs, limit):
    rows = [(c, t, "user", x) for c, texts in convs for t, x in enumerate(texts)]
    if rows:
        same(spark, rows, limit=limit)


def test_bits_of_a_known_trie():
    # Two tops; the first has three children, of which the second has one.
    level = np.array([0, 0, 1, 1, 1, 2])
    node, parent = np.array([[i, 0] for i in range(6)]), np.array([[9, 9], [9, 9], [0, 0], [0, 0], [0, 0], [3, 0]])
    order, bits, bounds = pt.louds(level, node, parent)
    assert order.tolist() == [0, 1, 2, 3, 4, 5] and bounds.tolist() == [0, 2, 5, 6]
    assert "".join(map(str, bits.astype(int))) == "110" + "1110" + "0" + "0" + "10" + "0" + "0"
    assert pt.parents(bits).tolist() == [0, 0, 1, 1, 1, 4]


def test_query_reads_the_table(spark, tmp_path):
    rows = drawn(30)
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = pt.op12_louds_prefix_trie(spark, str(tmp_path))
    assert sorted((tuple(r) for r in got.select(*map(F.col, COLUMNS)).collect()), key=str) == brute(rows)
