"""Operators on small inputs with known answers, and properties on drawn ones."""

from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from grainmill.functions import scalars as S
from grainmill.operators import baseline, dependencies, graphs, report, scoring, windows

QUIET = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def test_declared_rules(spark):
    registry = spark.createDataFrame(
        [("pypi", f"p{k}", *v) for k, v in enumerate([(True, 400, None, "weekly", False, False, None), (False, None, None, "weekly", False, False, None), (None, None, None, "weekly", False, False, "timeout"), (True, 10, 3, "weekly", False, False, None), (True, 10, 9000, "weekly", False, False, None), (True, 400, 1, "weekly", True, True, None), (True, 400, 1, "weekly", False, True, None), (True, 10, None, "weekly", False, False, None), (True, 10, 1499, "total", False, False, None), (True, 90, 1, "weekly", False, False, None)])],
        "ecosystem string, name string, is_there boolean, age_days int, downloads int, downloads_period string, quarantined boolean, archived boolean, error string",
    )
    names = [f"p{k}" for k in range(11)]
    declared = spark.createDataFrame([("r", k, n, "pypi", "f", 1, False, "", "possible" if n == "x" else "definite") for k, n in enumerate([*names, "P1"])], "project_root string, seq int, name string, ecosystem string, source_file string, line int, skip_registry boolean, registry_name string, presence string")
    got = {r.name: r.rule_id for r in dependencies.judge_declared(declared, registry).collect()}
    assert got == {"p1": "H001", "p2": "H004", "p3": "H005", "p4": "H006", "p5": "H009", "p6": "H012", "p7": "H006", "p8": "H005", "p10": "H004"}
    conditional = declared.filter("name = 'p1'").withColumn("presence", F.lit("possible"))
    assert [r.rule_id for r in dependencies.judge_declared(conditional, registry).collect()] == ["H007"]
    assert [r.rule_id for r in dependencies.judge_declared(conditional, registry, "private").collect()] == ["H010"]


@QUIET
@given(st.lists(st.sampled_from("abc"), max_size=12), st.lists(st.sampled_from("abcd"), max_size=12))
def test_baseline_is_a_multiset_difference(spark, now, had):
    cur = spark.createDataFrame([(f, k) for k, f in enumerate(now)], "fp string, seq int")
    prior = spark.createDataFrame([(f, k) for k, f in enumerate(had)], "fp string, seq int")
    left, states = Counter(had), []
    for f in now:
        states.append("unchanged" if left[f] > 0 else "new")
        left[f] -= left[f] > 0
    assert [r.state for r in baseline.match(cur, prior).orderBy("seq").collect()] == states
    row = baseline.summary(cur, prior).first()
    assert (row.new or 0, row.unchanged or 0, row.resolved or 0) == (states.count("new"), states.count("unchanged"), sum(left.values()))


@QUIET
@given(st.lists(st.tuples(st.integers(1, 30), st.integers(0, 8)), min_size=1, max_size=10))
def test_spans_merge_as_sets_of_lines(spark, spans):
    rows = spark.createDataFrame([("k", a, a + n) for a, n in spans], "k string, a int, b int")
    got = [(r.a, r.b) for r in windows.merge_spans(rows, ["k"], "a", "b").orderBy("a").collect()]
    assert {x for a, b in got for x in range(a, b + 1)} == {x for a, n in spans for x in range(a, a + n + 1)}
    assert all(y[0] > x[1] + 1 for x, y in zip(got, got[1:]))


@QUIET
@given(st.text(alphabet="token=: \"'https://a@b.c;&xY1", max_size=40))
def test_redaction_is_idempotent(spark, text):
    once = spark.createDataFrame([(text,)], "t string").select(S.redact(F.col("t")).alias("t"))
    assert once.first().t == once.select(S.redact(F.col("t")).alias("t")).first().t


def test_redaction(spark):
    texts = {"https://user:pw@host/x": "https://***@host/x", "Authorization: Bearer abc def": "Authorization: ***", '"token": "a b"': '"token": "***"', "password=abc&x=1": "password=***&x=1", "see ghp_" + "a1" * 12: "see ***"}
    df = spark.createDataFrame([(k,) for k in texts], "t string").select("t", S.redact(F.col("t")).alias("r"))
    assert {r.t: r.r for r in df.collect()} == texts


def test_fingerprint_is_canonical_json(spark):
    import hashlib
    import json

    row = {"project_root": "p", "file": 'a "b"\\c.py', "rule_id": "R", "engine": "builtin", "anchor": "x\ty é"}
    want = hashlib.sha256(json.dumps(row, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    df = spark.createDataFrame([row])
    got = df.select(S.fingerprint(*[F.col(c) for c in ("project_root", "file", "rule_id", "engine", "anchor")], quote=S.ascii_json).alias("f")).first().f
    assert got == want


def test_graphs(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "c"), ("c", "d"), ("b", "d"), ("x", "c")], "src string, dst string")
    got = {(r.node, r.context) for r in graphs.two_contexts(spark.createDataFrame([("a",), ("x",)], "node string"), edges, spark.createDataFrame([("c",)], "node string")).collect()}
    assert got == {("a", "server"), ("b", "server"), ("c", "client"), ("d", "client"), ("d", "server"), ("x", "server")}
    ranked = edges.withColumn("rank", F.when(F.col("src") == "c", 1).otherwise(2))
    best = {r.node: r["rank"] for r in graphs.best_kind(spark.createDataFrame([("a", "a", 2)], "root string, node string, rank int"), ranked).collect()}
    assert best == {"a": 2, "b": 2, "c": 2, "d": 2}


@pytest.mark.parametrize(("errors", "warnings", "score"), [(2, 3, 55), (10, 0, 0), (0, 0, 100)])
def test_health(spark, errors, warnings, score):
    assert spark.range(1).select(F.lit(errors).alias("n_error"), F.lit(warnings).alias("n_warning")).select(scoring.health().alias("h")).first().h == score


def test_report_round_trip(spark, tmp_path):
    findings = spark.createDataFrame([(1, "p", "R1", "error", "token=abcdef x", "a.py", 3), (2, "p", "R0", None, "t", "a.py", 3)], "seq int, project_root string, rule_id string, level string, title string, file string, line int")
    projects = spark.createDataFrame([("p", "python", 2, 85), ("q", "java", 0, 100)], "project_root string, language string, file_count int, score int")
    report.write_json(findings, projects, str(tmp_path / "r"))
    back = spark.read.json(str(tmp_path / "r"))
    rows = {r.root: [f.rule_id for f in (r.findings or [])] for r in back.collect()}
    assert rows == {"p": ["R0", "R1"], "q": []}
    assert back.filter("root = 'p'").first().findings[1].title == "token=*** x"
    (tmp_path / "doc.json").write_text('{"tool": "t", "projects": [{"root": "p", "findings": [{"rule_id": "R", "line": 4}]}]}')
    assert [(r.project_root, r.rule_id, r.line) for r in report.read_report(spark, str(tmp_path / "doc.json")).collect()] == [("p", "R", 4)]
    (tmp_path / "bad.json").write_text("{")
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        report.read_report(spark, str(tmp_path / "bad.json")).collect()


@pytest.mark.parametrize("key", ["jn06_registry", "h001_declared", "jn08_providers", "h010_private"])
def test_declarations_of_equal_number_give_what_the_sql_gives(spark, tmp_path, key):
    """Each declaration comes three times under one number, with other registry names; which one counted was left to chance."""
    import duckdb

    from grainmill.plans import registry

    db = duckdb.connect()
    base = "/root/testdata/sf0.001"
    db.execute(f"COPY (SELECT l.* REPLACE (l_partkey + i * 2000 AS l_partkey) FROM range(3) r(i), '{base}/lineitem.parquet' l ORDER BY hash(l_suppkey, i)) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    db.execute(f"COPY (SELECT p.* REPLACE (p_partkey + i * 200 AS p_partkey) FROM range(5) r(i), '{base}/part.parquet' p) TO '{tmp_path}/part.parquet' (FORMAT parquet)")
    for t in ("lineitem", "part"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    df = registry.queries()[key](spark, str(tmp_path))
    theirs = db.execute(f"SELECT {', '.join(df.columns)} FROM ({registry.oracle_sql()[key]})").fetchall()
    assert Counter(map(tuple, df.collect())) == Counter(theirs)
