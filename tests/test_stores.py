"""The store, the coverage report, settings, rule files, the module graph and the rescan over small inputs, broken ones above all."""

import json

import pytest
from pyspark.sql import functions as F

from grainmill.operators import coverage, modules, store
from grainmill.sources import config, facts
from grainmill.streaming import incremental

REVIEW = "key string, version long, decision string, note string, updated_at string"


def reviews(spark, *rows):
    return spark.createDataFrame([(k, v, d, n, "now") for k, v, d, n in rows], REVIEW)


def test_a_write_is_seen_whole_or_not_at_all(spark, tmp_path):
    path = f"{tmp_path}/s"
    store.create(spark, path)
    assert store.latest(spark, path, "review").count() == 0
    store.append(reviews(spark, ("a", 1, "confirmed", "first"), ("b", 1, "uncertain", "")), path, "review", "one")
    # Broken off before the commit: nobody sees it, and writing it again replaces it.
    store.stage(reviews(spark, ("a", 2, "false_positive", "half")), path, "review", "two")
    assert {(r.key, r.version) for r in store.latest(spark, path, "review").collect()} == {("a", 1), ("b", 1)}
    store.append(reviews(spark, ("b", 3, "confirmed", "whole")), path, "review", "two")
    assert {(r.key, r.version, r.note) for r in store.latest(spark, path, "review").collect()} == {("a", 1, "first"), ("b", 3, "whole")}
    with pytest.raises(ValueError):
        store.append(reviews(spark, ("b", 4, "confirmed", "again")), path, "review", "two")
    store.create(spark, path)
    assert store.history(spark, path, "review").count() == 3


def test_rows_that_break_rules_are_kept_apart(spark, tmp_path):
    path = f"{tmp_path}/s"
    store.create(spark, path)
    bad = [("a", 2, "maybe", "x"), ("a", 3, "confirmed", "x" * 2001), (None, 1, "confirmed", "x"), ("c", None, "confirmed", "x"), ("d", -1, "confirmed", "x"), ("e", 1, "confirmed", "bell \x07"), ("", 1, "confirmed", "x"), ("f", 1, None, None)]
    store.append(reviews(spark, ("a", 1, "confirmed", "tab\tand\nline"), *bad), path, "review", "one")
    assert [(r.key, r.version) for r in store.latest(spark, path, "review").collect()] == [("a", 1)]
    got = sorted((r.key or "", r.version or 0, *r.problems) for r in store.rejected(spark, path, "review").collect())
    assert got == sorted([("a", 2, "decision"), ("a", 3, "note"), ("", 1, "key"), ("c", 0, "version"), ("d", -1, "version"), ("e", 1, "note"), ("", 1, "key"), ("f", 1, "decision", "note")])
    seen = store.committed(spark, path, "review").collect()
    assert [(r.batch, r.n_rows, r.n_rejected) for r in seen] == [("one", 1, 8)]


def test_other_kinds_columns_and_interrupted_states(spark, tmp_path):
    path = f"{tmp_path}/s"
    store.create(spark, path)
    audits = spark.createDataFrame([("x", 1, "running", "p", "m"), ("y", 1, "completed", "p", "m"), ("z", 1, "odd", "p", "")], "key string, version long, state string, provider string, model string")
    store.append(audits, path, "audit", "a")
    assert {(r.key, r.state) for r in store.interrupted(spark, path, "audit").collect()} == {("x", "interrupted"), ("y", "completed")}
    store.append(spark.createDataFrame([("b", 1, "running", 2, 3), ("c", 1, "running", 4, 3)], "key string, version long, state string, done long, total long"), path, "batch", "a")
    assert [r.key for r in store.latest(spark, path, "batch").collect()] == ["b"]
    store.append(spark.createDataFrame([("b", 1, "0" * 64, True), ("c", 1, "G" * 64, True), ("d", 1, "0" * 64, None)], "key string, version long, digest string, granted boolean"), path, "consent", "a")
    assert [r.key for r in store.latest(spark, path, "consent").collect()] == ["b"]
    for rows, batch in ((audits.withColumn("prompt", F.lit("secret")), "b"), (audits.drop("model"), "b"), (audits, "../b")):
        with pytest.raises(ValueError):
            store.append(rows, path, "audit", batch)


def stage_of(spark, report) -> dict:
    body = report if isinstance(report, str) or report is None else json.dumps(report)
    rows = coverage.stages(spark.createDataFrame([("r", body)], "report_id string, body string")).select(F.explode("stages").alias("s")).select("s.*").collect()
    return {r.stage: r for r in rows}


def test_nothing_is_complete_without_evidence(spark):
    for odd in (None, "", "[]", "7", '{"projects": ', {}, {"projects": {}, "diagnostics": []}, {"projects": [1, None], "diagnostics": None}):
        assert {s.status for s in stage_of(spark, odd).values()} == {"not_recorded"}, odd
    counters = {"rule_attempted": 3, "rule_failures": 0, "rule_errors": []}
    assert stage_of(spark, {"diagnostics": counters})["rules"].status == "complete"
    for change in ({"rule_failures": None}, {"rule_attempted": True}, {"rule_attempted": "3"}, {"rule_attempted": 3.5}, {"rule_attempted": -1}, {"rule_failures": 4}, {"rule_attempted": 0}, {"rule_errors": "none"}):
        assert stage_of(spark, {"diagnostics": counters | change})["rules"].status == "not_recorded", change
    assert stage_of(spark, {"diagnostics": counters | {"rule_failures": 1, "rule_errors": ["a", 7]}})["rules"].issues == ["a"]


def test_ledgers_and_the_document(spark):
    report = {
        "tool": "t", "limitations": ["l", 3], "projects": [{"root": "a", "language": "java", "file_count": 2, "findings": [{"rule_id": "B"}, {"rule_id": "A", "level": "error"}, {"rule_id": "A", "severity": "yellow"}, {"rule_id": 7}, 8]}, "odd"],
        "diagnostics": {"manifest_files": ["m", "m", "n"], "manifest_errors": ["m: x: y"], "manifest_incomplete": ["n"], "include_gaps": [], "parse_error_files": ["p"], "skipped_files": []},
    }
    got = stage_of(spark, report)
    assert (got["manifests"].status, got["manifests"].issues) == ("partial", ["m: x: y", "incomplete: n"]) and got["parsing"].status == "partial" and got["discovery"].status == "complete"
    assert stage_of(spark, {**report, "diagnostics": {**report["diagnostics"], "manifest_files": ["m"]}})["manifests"].status == "failed"
    whole = json.loads(coverage.document(spark.createDataFrame([("r", json.dumps(report)), ("s", "{")], "report_id string, body string")).filter("report_id = 'r'").first().document)
    assert whole["limitations"] == ["l"] and [p["findings"] for p in whole["projects"]] == [5] and whole["provenance"]["version"] is None
    assert [(r["rule_id"], r["n"], r["levels"]) for r in whole["rules"]] == [("A", 2, ["error", "warning"]), ("B", 1, ["unclassified(?)"])]


def settings_of(spark, texts, folders=()):
    found = config.entries(spark.createDataFrame([(f"{k}/settings.toml", t) for k, t in texts.items()], "rel string, text string"))
    problems = config.setting_problems(found, spark.createDataFrame(list(folders), "root string, folder string"))
    return {(r.rel.split("/")[0], r.field, r.reason) for r in problems.collect()}, [(r.rel.split("/")[0], r.key, r["sub"], r["at"], r.text) for r in config.settings(found, problems).collect()]


def test_settings_are_strict_and_never_echoed(spark):
    secret = "hunter2-token"
    texts = {
        "a": 'schema_version = 2\nexclude_paths = ["gen/", " gen ", "out"]\n[rule_levels]\nR001 = "note"\n', "b": f'schema_version = 1\n{secret} = 1\n[policy]\nheuristic_errors = "block"\n', "c": f'schema_version = 2\n[policy]\nheuristic_errors = "{secret}"\n',
        "d": f'schema_version = 2\nexclude_paths = ["/{secret}", "ok"]\n', "e": f"schema_version = = {secret}", "f": None, "g": "schema_version = true", "h": 'schema_version = 1\nnpm_roots = ["web", "gone"]', "i": 'schema_version = 1\n[runtime_builtins]\nnpm = "fs"\n[internal_packages]\nnpm = [1]\n',
        "j": "schema_version = 1\ncomplexity_threshold = 99999999999999999999\n",
    }
    problems, kept = settings_of(spark, texts, [("h", "web")])
    assert problems == {
        ("b", "", "2 unknown keys"), ("c", "policy", "must be review or block"), ("d", "exclude_paths", "an absolute path"), ("e", "", "syntax"), ("f", "schema_version", "must be 1 or 2"), ("g", "schema_version", "must be 1 or 2"), ("h", "npm_roots", "no such directory"),
        ("i", "runtime_builtins", "must be lists of texts"), ("i", "internal_packages", "must be lists of texts"), ("j", "complexity_threshold", "must be a whole number from 1 to 100"),
    }
    assert secret not in str(problems)
    assert sorted(kept, key=str) == sorted([("a", "exclude_paths", "", 0, "gen"), ("a", "exclude_paths", "", 1, "out"), ("a", "rule_levels", "R001", None, "note")], key=str)


def test_one_bad_rule_closes_its_file(spark):
    rule = {"id": "r", "message": "m", "severity": "ERROR", "languages": ["javascript", "typescript", "java"], "metadata": {"x-precision": "exact"}}
    bad = [{"id": " "}, {"message": None}, {"severity": ["ERROR"]}, {"severity": "FATAL"}, {"languages": []}, {"languages": ["cobol"]}, {"languages": ["java", 7]}, {"languages": "java"}, {"metadata": {}}, {"metadata": {"x-precision": "maybe"}}]
    texts = {"good": {"rules": [rule, rule | {"id": "s"}]}, "twice": {"rules": [rule, rule]}, "list": [rule], "empty": {}, "odd": {"rules": [rule, 7]}} | {f"bad{k}": {"rules": [rule, rule | {"id": "t"} | change]} for k, change in enumerate(bad)}
    rows = [(k, json.dumps(v)) for k, v in texts.items()] + [("broken", "rules: ["), ("null", None)]
    found = config.rules(spark.createDataFrame(rows, "rel string, text string"))
    problems = config.rule_problems(found)
    assert {r.rel for r in problems.collect()} == {k for k, _ in rows} - {"good"}
    got = config.descriptors(found, problems).collect()
    assert {(r.rule_id, r.level, r.precision, tuple(r.languages)) for r in got} == {("S:r", "error", "exact", ("java", "typescript")), ("S:s", "error", "exact", ("java", "typescript"))}


def test_module_graph_of_a_tree(spark):
    page = 'import a from "@/lib/a"\nimport b from "../lib/b"\nimport c from "@own/lib/a"\nimport d from "../../../up"\n'
    own = {
        "p/app/page.tsx": page, "p/lib/a.ts": "import x from './deep'\nconst [s] = useState(0)\n", "p/lib/b.tsx": "'use client'\nimport y from './c'\nconst [s] = useState(0)\n", "p/lib/deep/index.ts": "import z from './../a'\nwindow.x\n",
        "p/lib/c.ts": "const e = process.env.DB_PASS\nimport fs from 'fs'\nconst [s] = useState(0)\n", "p/lib/alone.ts": "useState(0)\n", "q/lib/a.ts": "useState(0)\n",
    }
    rows = spark.createDataFrame([(rel, rel[0], "tsx" if rel.endswith("x") else "typescript", t.encode(), None) for rel, t in own.items()], "rel string, root string, language string, content binary, skipped string")
    aliases = spark.createDataFrame([("p", "@/", "./"), ("p", "@/lib/", "src/")], "root string, prefix string, target string")
    edges = modules.module_edges(facts.extract(rows).filter("kind = 'edge'").selectExpr("rel", "name AS spec").join(rows.select("rel", "root"), "rel"), rows, aliases.filter("target = './'"))
    assert {(r.src, r.dst) for r in edges.collect()} == {("p/app/page.tsx", "p/lib/a.ts"), ("p/app/page.tsx", "p/lib/b.tsx"), ("p/lib/a.ts", "p/lib/deep/index.ts"), ("p/lib/deep/index.ts", "p/lib/a.ts"), ("p/lib/b.tsx", "p/lib/c.ts")}
    got = {(r.rel, r.kind, r.line) for r in modules.context_findings(facts.extract(rows), rows.select("rel", "root"), aliases.filter("target = './'")).collect()}
    assert got == {("p/lib/a.ts", "N006", 2), ("p/lib/deep/index.ts", "N006", 2), ("p/lib/c.ts", "N002", 1), ("p/lib/c.ts", "N004", 2)}
    # The longest alias decides, and what it names isn't there.
    assert ("p/app/page.tsx", "p/lib/a.ts") not in {(r.src, r.dst) for r in modules.module_edges(spark.createDataFrame([("p/app/page.tsx", "p", "@/lib/a")], "rel string, root string, spec string"), rows, aliases).collect()}


def test_rescan_goes_on_after_a_crash_and_gives_each_finding_once(spark, tmp_path):
    path, schema = str(tmp_path), "fp string, seq long"
    prior = spark.createDataFrame([("a",)] * 3 + [("b",)], "fp string")
    arrive = lambda n, rows: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/arrived/{n}")
    arrive(0, [("a", 1), ("a", 2), ("c", 3)])
    incremental.rescan_into(spark, f"{path}/arrived", schema, prior, path)
    arrive(1, [("a", 4), ("a", 5), ("b", 6)])
    # A try that broke off after it had written: its batch comes again and replaces what is there.
    spark.createDataFrame([("a", 99)], "fp string, n long").write.parquet(f"{path}/seen/batch=1")
    incremental.rescan_into(spark, f"{path}/arrived", schema, prior, path)
    incremental.rescan_into(spark, f"{path}/arrived", schema, prior, path)
    got = spark.read.schema(f"{schema}, state string, batch long").parquet(f"{path}/results").collect()
    assert sorted((r.seq, r.state) for r in got) == [(1, "unchanged"), (2, "unchanged"), (3, "new"), (4, "unchanged"), (5, "new"), (6, "unchanged")]
