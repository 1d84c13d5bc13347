"""Reports read back, accounting, totals, roll-ups and packs of single findings, over small inputs."""

import pytest
from pyspark.sql import functions as F

from grainmill.functions import scalars as S
from grainmill.operators import evidence, report, stats


def test_a_report_is_read_back_and_a_broken_one_fails(spark, tmp_path):
    finding = "project_root string, file string, line int, rule_id string, engine string, snippet string, title string, fingerprint string"
    rows = spark.createDataFrame([("p", "a.py", 1, "R", "own", "x = 1", "t", "given"), ("p", "a.py", 2, "R", "own", "x = 1", "t", None), ("p", "a.py", 3, "R", "own", "x = 1", "t", None)], finding)
    projects = spark.createDataFrame([("p", "python", 1, 90), ("q", "java", 0, 100)], "project_root string, language string, file_count int, score int")
    report.write_json(rows, projects, f"{tmp_path}/r")
    back = report.read_lines(spark, f"{tmp_path}/r")
    assert {(r.project_root, r.line, r.rule_id) for r in back.collect()} == {("p", 1, "R"), ("p", 2, "R"), ("p", 3, "R")}
    made = rows.select(S.fingerprint(*[F.col(c) for c in ("project_root", "file", "rule_id", "engine")], S.anchor(F.col("snippet"), F.col("title"))).alias("fp")).first().fp
    assert {(r.fp, r.n) for r in report.baseline_counts(back).collect()} == {("given", 1), (made, 2)}
    (tmp_path / "bad.json").write_text('{"root": "p", "findings": [')
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        report.read_lines(spark, f"{tmp_path}/bad.json").collect()


def test_accounting_says_why_files_were_left_out(spark):
    files = spark.createDataFrame([("p", f"f{i}", "java" if i < 5 else "go") for i in range(7)] + [("q", "g", "java")], "project string, file string, language string")
    queries = spark.createDataFrame([("a", ["java"]), ("b", ["go", "c"])], "query string, languages array<string>")
    ranked = spark.createDataFrame([("p", "a", k) for k in range(1, 5)], "project string, query string, rank int")
    got = {(r.project, r.query): (r.eligible, r.candidates, r.skipped) for r in evidence.accounting(files, queries, ranked, 3).collect()}
    assert got == {("p", "a"): (5, 3, {"language": 2, "below the limit": 1}), ("p", "b"): (2, 0, {"language": 5}), ("q", "a"): (1, 0, {}), ("q", "b"): (0, 0, {"language": 1})}


def test_hints_beyond_a_catalog_are_refused_and_none_find_nothing(spark):
    lines = spark.createDataFrame([("f", 1, "Password = x"), ("f", 2, None), ("g", 1, "token, PASSWORD")], "file string, line int, text string")
    hints = spark.createDataFrame([("s", "password"), ("s", "TOKEN"), ("s", "token"), ("t", "none")], "query string, hint string")
    assert [(r.query, r.file, r.hints, r["rank"]) for r in evidence.retrieve(lines, hints, ["file"], 5).orderBy("rank").collect()] == [("s", "g", 3, 1), ("s", "f", 1, 2)]
    assert evidence.retrieve(lines, hints.limit(0), ["file"], 5).count() == 0
    with pytest.raises(ValueError):
        evidence.retrieve(lines, spark.range(501).select(F.lit("s").alias("query"), F.col("id").cast("string").alias("hint")), ["file"], 5)


def test_packs_of_single_findings_keep_their_budget(spark):
    lines = spark.createDataFrame([("f", i, "x" * 9) for i in range(1, 11)] + [("g", 1, "y")], "file string, line long, text string")
    findings = spark.createDataFrame([(1, "f", 2), (2, "f", 9), (3, "g", 1), (4, "none", 1)], "seq long, file string, line long")
    got = {}
    for r in evidence.finding_pack(findings, lines, 2, 30).collect():
        got.setdefault(r.seq, []).append(r.line)
    assert {k: sorted(v) for k, v in got.items()} == {1: [1, 2, 3], 2: [7, 8, 9], 3: [1]}


def test_totals_over_axes_and_the_summary(spark):
    labels = spark.createDataFrame([("r", "x", "confirmed"), ("r", None, "false_positive"), ("s", "x", "uncertain"), ("s", "x", "confirmed")], "rule string, who string, label string")
    got = {(r.axis, r.value): (r.n, r.confirmed, r.false_positive, r.uncertain, r.false_rate, r.decided_rate) for r in stats.label_totals(labels, ["rule", "who"]).collect()}
    assert got == {("all", "all"): (4, 2, 1, 1, 0.3333, 0.75), ("rule", "r"): (2, 1, 1, 0, 0.5, 1.0), ("rule", "s"): (2, 1, 0, 1, 0.0, 0.5), ("who", "x"): (3, 2, 0, 1, 0.0, 0.6667), ("who", None): (1, 0, 1, 0, 1.0, 1.0)}
    answers = spark.createDataFrame([("q", "positive", "positive"), ("q", "negative", "positive"), ("r", "negative", "negative"), ("r", "positive", "abstain")], "query string, expected string, said string")
    row = stats.confusion_summary(stats.confusion(answers)).first()
    assert (row.tp, row.fp, row.tn, row.fn, row.abstained, row.precision, row.recall, row.verdicts) == (1, 1, 1, 0, 1, 0.5, 1.0, {"review": 1, "accept": 1})
    none = stats.confusion_summary(stats.confusion(answers.limit(0))).first()
    assert (none.tp, none.precision, none.verdicts) == (0, None, {})
