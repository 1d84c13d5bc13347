import hashlib
from collections import defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from grainmill.llm import line_dedup as ld


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def brute(rows, min_chars=20, min_docs=3):
    """(lines, dropped, kept) of each row; a null id stands below all others."""
    rank = lambda d: float("-inf") if d is None else d
    holders = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(rank(d))
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if len(h := holders.get(key(x), ())) < min_docs or rank(d) == max(h)]
        out.append((d, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return out


COMMON = ["a shared line of enough characters", "  A Shared LINE of enough characters\t", "ééééééééééééééééééé1", "ééééééééééééééééééé", "short", "", "nineteen characters", "exactly twenty chars", " line with a no-break space at its end "]


def same(spark, rows, **options):
    df = spark.createDataFrame([(d, t, "n") for d, t in rows], "doc_id long, text string, pos string")
    got = sorted((str(r.doc_id), r["__n_lines"], r["__n_dropped"], r.text) for r in ld.dedup_lines(df, **options).collect())
    assert got == sorted((str(d), n, k, t) for d, n, k, t in brute(rows, **{"min_chars": 20, "min_docs": 3} | options))


def test_same_as_brute_force(spark):
    rows = [(1, None), (2, ""), (3, "\n\n"), (None, COMMON[0]), (4, COMMON[1]), (5, COMMON[0] + "\n" + COMMON[0]), (5, COMMON[0] + "\nother"), (5, COMMON[0] + "\nother"), (6, "\n".join(COMMON))]
    rows += [(10 + i, "\n".join([*COMMON[i % 4 :], f"an own line of document number {i}", *COMMON])) for i in range(20)]
    rows += [(100, "\n".join(f"line {i % 700} of a very long document" for i in range(5000)))] + [(101 + k, "\n".join(f"line {i} of a very long document" for i in range(0, 700, 3))) for k in range(3)]
    same(spark, rows)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(-3, 5)), st.one_of(st.none(), st.lists(st.sampled_from(["aB", " ab ", "abc", "x", ""]), max_size=6).map("\n".join))), max_size=12))
def test_any_rows(spark, rows):
    if rows:
        same(spark, rows, min_chars=2, min_docs=2)


def test_query_digest_and_empty_table(spark, tmp_path):
    rows = [(i, f"own {i}\n" + COMMON[0]) for i in range(5)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in ld.op2_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {d: (n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in brute(rows)}
    assert ld.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
