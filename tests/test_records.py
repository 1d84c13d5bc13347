"""Engine logs, proofs of literals and sanitizers behind imports, on small cases."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from grainmill.functions import scalars as S
from grainmill.operators import graphs as G
from grainmill.sources import engine_logs as L
from grainmill.sources import labels as B


def test_proofs_of_literals(spark):
    cases = [
        ("quoted_kv", "hunter2!", "", True),
        ("quoted_kv", " *** ", "", False),
        ("quoted_kv", None, "", False),
        ("quoted_kv", "Process.Env.KEY", "", False),
        ("credential_url", "u:${PASS}", "", False),
        ("auth_header", "abcd1234", "", True),
        ("token_kv", "abcd1234", 'x = "Password=', True),
        ("token_kv", "abcd1234", 'x = "a\\"" + Password=', False),
        ("token_kv", "abcd1234", None, False),
        ("token_kv", "dbToken", "auth: ", False),
        ("known_token", "***", "", True),
    ]
    rows = spark.createDataFrame(cases, "kind string, value string, before string, want boolean")
    got = rows.withColumn("got", S.proves_literal(F.col("kind"), F.col("value"), F.col("before"))).filter("got IS DISTINCT FROM want").collect()
    assert not got


def test_sanitizers_behind_imports(spark):
    safe = spark.createDataFrame([("src/lib/clean.ts", "clean"), ("a.tsx", "own"), ("x.y/z.ts", "dotted"), ("a.tsx", "self")], "rel string, name string")
    imports = spark.createDataFrame(
        [("a.tsx", "clean", "@/lib/clean"), ("b.tsx", "clean", "../../clean"), ("c.tsx", "clean", "ib/clean"), ("d.tsx", "clean", "@lib/clean"), ("e.tsx", "clean", ".."), ("f.tsx", "dotted", "./x.y/z"), ("g.tsx", "self", None)],
        "rel string, name string, spec string",
    )
    uses = [("a.tsx", "clean"), ("a.tsx", "clean"), ("a.tsx", "own"), ("b.tsx", "own"), ("b.tsx", "clean"), ("c.tsx", "clean"), ("d.tsx", "clean"), ("e.tsx", "clean"), ("f.tsx", "dotted"), ("g.tsx", "self"), (None, "clean")]
    got = sorted(tuple(r) for r in G.proven_names(spark.createDataFrame(uses, "rel string, name string"), safe, imports).collect())
    assert got == [("a.tsx", "clean"), ("a.tsx", "clean"), ("a.tsx", "own"), ("b.tsx", "clean"), ("f.tsx", "dotted")]


def test_engine_logs(spark):
    result = {"check_id": "k", "path": "a.py", "start": {"line": 3}, "extra": {"severity": "ERROR", "message": "m\nmore", "metadata": {"precision": "exact"}}}
    bodies = {
        "/w/good": {"results": [result], "paths": {"scanned": ["a.py", "/w/good/b.py"]}},
        "/w/silent": {"results": []},
        "/w/less": {"results": [], "paths": {"scanned": ["a.py"], "skipped": [{"path": "b.py"}]}},
        "/w/odd": {"results": [dict(result, path="/w/goodbye/a.py"), dict(result, check_id=None), {"check_id": "k", "path": "a.py"}], "errors": [{"path": "a.py"}, {}], "paths": {"scanned": ["a.py", "b.py"]}},
        "/w/none": {"paths": {"scanned": ["a.py"]}},
    }
    rows = [(root, json.dumps(body)) for root, body in bodies.items()] + [("/w/broken", "{"), ("/w/null", None)]
    logs = L.parsed(spark.createDataFrame(rows, "root string, body string"))
    expected = spark.createDataFrame([(root, path) for root, _ in rows for path in ("a.py", "b.py", "b.py")], "root string, path string")
    assert [tuple(r) for r in L.findings(logs).collect()] == [("/w/good", "S:k", "error", "m", "a.py", 3, "exact")]
    got = {r.root: tuple(r)[1:] for r in L.completeness(logs, expected).collect()}
    nothing = (0, 0, 0, 0, 0)
    assert got == {
        "/w/good": (*nothing, "success"),
        "/w/silent": (*nothing, "partial"),
        "/w/less": (1, 0, 1, 0, 0, "partial"),
        "/w/odd": (0, 2, 0, 1, 2, "partial"),
        "/w/none": (*nothing, "invalid"),
        "/w/broken": (*nothing, "invalid"),
        "/w/null": (*nothing, "invalid"),
    }


def test_labels(spark):
    good = {"alias": "repo-a", "project": "p", "file": 'f"é.py', "line": 3, "rule": "P001", "fingerprint": "x"}
    rows, want = [], []

    def add(problem, **changed):
        row = good | {"fingerprint": f"x{len(rows)}"} | changed
        digest = hashlib.sha256(json.dumps([row[k] for k in good], ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
        rows.append({"sample_id": digest, "population": 4, "review_id": None, "evidence": "e", **dict.fromkeys(B.AXES), **row})
        want.append(problem)

    add(None)
    add(None, validity="uncertain", review_id="r")
    add("sample_id", sample_id="AB")
    add("sample_id", sample_id=None)
    add("duplicate", fingerprint="same")
    add("duplicate", fingerprint="same")
    add("alias", alias="repo-ab")
    add("unknown alias", alias="repo-z")
    add("population", population=None)
    add("line", line=-1)
    add("identity", sample_id="0" * 64)
    add("actionability", actionability="no")
    schema = "sample_id string, alias string, rule string, population int, project string, file string, line int, fingerprint string, review_id string, evidence string, validity string, level_assessment string, gate_assessment string, actionability string, at int"
    columns = [c.split()[0] for c in schema.split(", ")]
    labels = spark.createDataFrame([tuple((r | {"at": k})[c] for c in columns) for k, r in enumerate(rows)], schema)
    corpus = spark.createDataFrame([("repo-a", 3), ("repo-z", 0)], "alias string, n int")
    got = {r.at: r.problem for r in B.problems(labels, corpus).collect()}
    assert [got[k] for k in range(len(rows))] == want
    assert B.strict(labels.filter("at < 2"), corpus).count() == 2 and B.strict(labels.limit(0), corpus).count() == 0
    with pytest.raises(Exception, match="invalid population"):
        B.strict(labels.filter("at = 8"), corpus).collect()
