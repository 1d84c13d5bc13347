"""Queries of reports read back, accounting, totals over axes, roll-ups and packs of single findings."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from grainmill.operators import evidence as V
from grainmill.operators import report as P
from grainmill.operators import stats as T
from grainmill.operators.baseline import match
from grainmill.operators.graphs import shared_folder
from grainmill.plans.queries_scalars import with_print
from grainmill.plans.queries_scores import FP, PACKED, packed, scores
from grainmill.plans.relations import duck, relation

QUERIES, SQL = {}, {}


def add(key, sql=None):
    def keep(f):
        QUERIES[key] = f
        if sql:
            SQL[key] = duck(sql)
        return f

    return keep


@add("src18_baseline", f"SELECT {FP} AS fp, count(*) AS n FROM {PACKED} WHERE project_root IN (SELECT project_root FROM {{packages}}) GROUP BY 1")
def baseline_of_a_report(spark, sf):
    """A report is written and read back; half of its findings have no fingerprint."""
    path = f"{shared_folder(spark)}/report-{uuid.uuid4()}"
    rows = with_print(packed(spark, sf)).withColumn("fingerprint", F.when(F.col("seq") % 2 == 0, F.col("fp")))
    P.write_json(rows, scores(spark, sf), path)
    return P.baseline_counts(P.read_lines(spark, path))


FORMS = ["NULL", "'{\"summary\": {}, \"projects\": [1]}'", "'{\"summary\": {}, \"projects\": {}}'", "'{\"summary\": 7, \"projects\": []}'", "'[1]'", "'{\"summary\": '", "concat('{\"summary\": {}, \"projects\": [], \"x\": \"', repeat('y', 300), '\"}')", "'{\"projects\": []}'"]


@add("src19_reports", "SELECT o_orderkey AS report_id, CASE o_orderkey % 8 WHEN 0 THEN 'nothing' WHEN 2 THEN 'no projects' WHEN 3 THEN 'no summary' WHEN 4 THEN 'no object' WHEN 5 THEN 'no JSON' WHEN 6 THEN 'too large' WHEN 7 THEN 'no summary' END AS problem FROM orders")
def report_shapes(spark, sf):
    body = "CASE o_orderkey % 8 " + " ".join(f"WHEN {k} THEN {form}" for k, form in enumerate(FORMS)) + " END"
    return P.report_problems(relation(spark, sf, "orders").select(F.col("o_orderkey").alias("report_id"), F.expr(body).alias("body")), 200)


@add("snk03_sarif_states", f"""WITH a AS (SELECT *, {FP} AS fp, row_number() OVER (PARTITION BY {FP} ORDER BY seq) AS k FROM {{findings}}), h AS (SELECT {FP} AS fp, count(*) AS n FROM {{prior}} GROUP BY 1)
SELECT seq, fp AS fingerprint, CASE WHEN k <= coalesce(n, 0) THEN 'unchanged' ELSE 'new' END AS state FROM a LEFT JOIN h USING (fp)""")
def sarif_states(spark, sf):
    """Fingerprints and states as the results carry them."""
    rows = match(with_print(relation(spark, sf, "findings")), with_print(relation(spark, sf, "prior")).select("fp"))
    found = P.sarif_results(rows, spark.createDataFrame([("H001", "a"), ("P002", "b")], "rule_id string, title string"))
    return found.select("seq", F.get_json_object("result", "$.partialFingerprints.primary").alias("fingerprint"), F.get_json_object("result", "$.baselineState").alias("state"))


@add("ag13_accounting", """WITH f AS (SELECT concat('p', p_partkey % 9) AS project, p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN 'java' WHEN 1 THEN 'python' ELSE 'csharp' END AS language FROM part),
q AS (SELECT * FROM (VALUES ('a', 'java', 'python'), ('b', 'csharp', 'csharp')) v(query, l1, l2)),
s AS (SELECT project, query, count(*) FILTER (language IN (l1, l2)) AS eligible, count(*) FILTER (language NOT IN (l1, l2)) AS other, least(10, count(*) FILTER (language IN (l1, l2) AND k % 5 = 0)) AS candidates, greatest(0, count(*) FILTER (language IN (l1, l2) AND k % 5 = 0) - 10) AS below FROM f, q GROUP BY project, query)
SELECT project, query, eligible, candidates, concat_ws(', ', CASE WHEN below > 0 THEN concat('below the limit=', below) END, CASE WHEN other > 0 THEN concat('language=', other) END) AS skipped FROM s""")
def accounting(spark, sf):
    files = relation(spark, sf, "part").select(F.expr("concat('p', p_partkey % 9)").alias("project"), F.col("p_partkey").alias("file"), F.expr("CASE p_partkey % 4 WHEN 0 THEN 'java' WHEN 1 THEN 'python' ELSE 'csharp' END").alias("language"))
    queries = spark.createDataFrame([("a", ["java", "python"]), ("b", ["csharp"])], "query string, languages array<string>")
    hit = files.filter("file % 5 = 0").join(F.broadcast(queries), F.expr("array_contains(languages, language)"))
    ranked = hit.selectExpr("project", "query", "row_number() OVER (PARTITION BY project, query ORDER BY file) AS rank")
    rows = V.accounting(files, queries, ranked, 10)
    said = F.array_join(F.array_sort(F.transform(F.map_entries("skipped"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))), ", ")
    return rows.select("project", "query", "eligible", "candidates", said.alias("skipped"))


_AXES = ("rule_id", "reviewer", "month", "parity", "bucket")
_AXED = '(SELECT *, CAST(month("at") AS VARCHAR) AS month, CAST(length(sample_id) % 2 AS VARCHAR) AS parity, substr(sample_id, 2, 1) AS bucket FROM {answers})'
_COUNTED = "count(*) AS n, count(*) FILTER (label = 'confirmed') AS confirmed, count(*) FILTER (label = 'false_positive') AS false_positive, count(*) FILTER (label = 'uncertain') AS uncertain"


@add("ag15_totals", "SELECT *, round_even(false_positive / nullif(confirmed + false_positive, 0), 4) AS false_rate, round_even((confirmed + false_positive) / nullif(n, 0), 4) AS decided_rate FROM (" + " UNION ALL ".join(f"SELECT '{axis}' AS axis, {axis if axis != 'all' else chr(39) + 'all' + chr(39)} AS value, {_COUNTED} FROM {_AXED} GROUP BY ALL" for axis in ("all", *_AXES)) + ")")
def totals(spark, sf):
    rows = relation(spark, sf, "answers").withColumns({"month": F.month("at"), "parity": F.length("sample_id") % 2, "bucket": F.substring("sample_id", 2, 1)})
    return T.label_totals(rows, list(_AXES))


_ANSWERS = "SELECT o_custkey % 40 AS query, CASE o_orderkey % 3 WHEN 0 THEN 'positive' ELSE 'negative' END AS expected, CASE (o_orderkey * 7 + o_custkey) % 5 WHEN 0 THEN 'abstain' WHEN 1 THEN 'negative' WHEN 2 THEN 'negative' ELSE 'positive' END AS said FROM {orders}"


@add("ag22_summary", f"""WITH a AS ({_ANSWERS}), q AS (SELECT query, count(*) FILTER (expected = 'positive' AND said = 'positive') AS tp, count(*) FILTER (expected = 'negative' AND said = 'positive') AS fp, count(*) FILTER (expected = 'negative' AND said = 'negative') AS tn,
count(*) FILTER (expected = 'positive' AND said = 'negative') AS fn, count(*) FILTER (said = 'abstain') AS abstained FROM a GROUP BY query), s AS (SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(tn) AS BIGINT) AS tn, CAST(sum(fn) AS BIGINT) AS fn, CAST(sum(abstained) AS BIGINT) AS abstained,
count(*) FILTER (fp > tp) AS reject, count(*) FILTER (fp <= tp AND tp + tn > 2 * (fp + fn)) AS accept, count(*) FILTER (fp <= tp AND tp + tn <= 2 * (fp + fn)) AS review FROM q)
SELECT tp, fp, tn, fn, abstained, round_even(tp / (tp + fp), 4) AS precision, round_even(tp / (tp + fn), 4) AS recall, accept, review, reject FROM s""")
def confusion_summary(spark, sf):
    rows = T.confusion_summary(T.confusion(spark.sql(_ANSWERS, orders=relation(spark, sf, "orders"))))
    return rows.select("tp", "fp", "tn", "fn", "abstained", "precision", "recall", *[F.coalesce(F.col("verdicts")[v], F.lit(0)).alias(v) for v in ("accept", "review", "reject")])


@add("ai04_finding_pack", """WITH l AS (SELECT doc_id, line, text FROM {lines}), f AS (SELECT doc_id * 10000 + line AS seq, doc_id, line FROM l WHERE line % 7 = 3), n AS (SELECT f.seq, l.doc_id, l.line, l.text, sum(strlen(l.text) + 1) OVER (PARTITION BY f.seq ORDER BY l.line) AS spent FROM f JOIN l ON l.doc_id = f.doc_id AND l.line BETWEEN f.line - 2 AND f.line + 2)
SELECT seq, line, text FROM n WHERE spent <= 600""")
def finding_pack(spark, sf):
    lines = relation(spark, sf, "lines").select(F.col("doc_id").alias("file"), "line", "text")
    findings = lines.filter("line % 7 = 3").select((F.col("file") * 10000 + F.col("line")).alias("seq"), "file", "line")
    return V.finding_pack(findings, lines, 2, 600).select("seq", "line", "text")
