"""Queries of counts, scores, ledger, baseline, windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainmill.functions import scalars as S
from grainmill.operators import baseline as B
from grainmill.operators import scoring as R
from grainmill.operators import windows as W
from grainmill.plans.queries_scalars import LEVEL, PRINT, with_print
from grainmill.plans.relations import duck, relation

QUERIES, SQL = {}, {}


def add(key, sql=None):
    def keep(f):
        QUERIES[key] = f
        if sql:
            SQL[key] = duck(sql)
        return f

    return keep


FP = PRINT.replace("{{", "{").replace("}}", "}")


def findings(spark, sf):
    return relation(spark, sf, "findings").withColumn("level", S.level_of(F.col("level"), F.col("severity")))


LEVELLED = f"(SELECT * REPLACE ({LEVEL} AS level) FROM {{findings}})"
COUNTS = "count(*) FILTER (level = 'error') AS n_error, count(*) FILTER (level = 'warning') AS n_warning, count(*) FILTER (level = 'note') AS n_note, count(*) AS n"
PACKED = f"(SELECT * REPLACE (concat('k', CAST(floor(seq / 8) AS BIGINT)) AS project_root) FROM {LEVELLED})"
SCORES = f"""(SELECT p.*, coalesce(n_error, 0) AS n_error, coalesce(n_warning, 0) AS n_warning, coalesce(n_note, 0) AS n_note, coalesce(n, 0) AS n, greatest(0, 100 - 15 * coalesce(n_error, 0) - 5 * coalesce(n_warning, 0)) AS score
FROM {{packages}} p LEFT JOIN (SELECT project_root, {COUNTS} FROM {PACKED} GROUP BY 1) f USING (project_root))"""


@add("ag01_level_rollup", f"SELECT project_root, {COUNTS} FROM {LEVELLED} GROUP BY ROLLUP (project_root)")
def level_rollup(spark, sf):
    return R.level_counts(findings(spark, sf))


def packed(spark, sf):
    """Findings with small projects, so that scores differ."""
    return findings(spark, sf).withColumn("project_root", F.expr("concat('k', CAST(floor(seq / 8) AS BIGINT))"))


def scores(spark, sf):
    return R.project_scores(relation(spark, sf, "packages"), packed(spark, sf))


@add("ag02_health", f"SELECT project_root, n_error, n_warning, n_note, n, score FROM {SCORES}")
def health(spark, sf):
    return scores(spark, sf).select("project_root", "n_error", "n_warning", "n_note", "n", "score")


@add("ag03_overall", f"SELECT CAST(round_even(sum(score * greatest(1, file_count)) / sum(greatest(1, file_count)), 0) AS BIGINT) AS overall, min_by(language, score * 1000000000000 + seq) AS lowest FROM {SCORES}")
def overall(spark, sf):
    return R.overall(scores(spark, sf))


@add("ag05_confidence", """SELECT c_custkey, CAST(round_even(100 * coalesce(a / nullif(a + b, 0), 1.0) * (1 - d / greatest(1, c, d)) * (1 - coalesce(e / nullif(f, 0), 0.0)) * (1 - least(1.0, g / greatest(1, a)))
  * CASE WHEN ends_with(h, 'success') THEN 1.0 WHEN contains(h, 'partial') THEN 0.97 ELSE 0.95 END, 0) AS BIGINT) AS confidence
FROM (SELECT c_custkey, c_custkey % 50 AS a, c_custkey % 7 AS b, c_custkey % 11 AS c, c_custkey % 3 AS d, c_custkey % 4 AS e, c_custkey % 9 + 4 AS f, c_custkey % 5 AS g, CASE c_custkey % 3 WHEN 0 THEN 'engine: success' WHEN 1 THEN 'partial' ELSE 'not available' END AS h FROM customer)""")
def confidence(spark, sf):
    k = F.col("c_custkey")
    ran = F.when(k % 3 == 0, "engine: success").when(k % 3 == 1, "partial").otherwise("not available")
    return relation(spark, sf, "customer").select(k, R.coverage_confidence(k % 50, k % 7, k % 11, k % 3, k % 4, k % 9 + 4, k % 5, ran).alias("confidence"))


@add("ag06_registry_axis", """SELECT c_custkey, s AS status, CASE WHEN s IN ('complete', 'partial') AND a > 0 THEN CAST(round_even(100 * (1 - b / a), 0) AS BIGINT) END AS confidence
FROM (SELECT c_custkey, a, b, CASE WHEN c_custkey % 5 = 0 THEN 'unavailable' WHEN a <= 0 THEN 'not_applicable' WHEN b > 0 THEN 'partial' ELSE 'complete' END AS s FROM (SELECT c_custkey, c_custkey % 13 AS a, least(c_custkey % 13, c_custkey % 4) AS b FROM customer))""")
def registry_axis(spark, sf):
    k = F.col("c_custkey")
    a, b = k % 13, F.least(k % 13, k % 4)
    status = R.registry_status(k % 5 == 0, a, b)
    return relation(spark, sf, "customer").select(k, status.alias("status"), R.registry_confidence(status, a, b).alias("confidence"))


ACTION = "CASE WHEN level = 'error' AND precision = 'heuristic' THEN 'review' WHEN level = 'error' THEN 'block' WHEN level = 'warning' THEN 'review' WHEN level = 'note' THEN 'informational' ELSE 'review' END"
STATES = f"""(SELECT f.*, CASE WHEN k <= coalesce(had, 0) THEN 'unchanged' ELSE 'new' END AS state FROM (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY seq) AS k FROM (SELECT *, {FP} AS fp FROM {LEVELLED})) f
LEFT JOIN (SELECT fp, count(*) AS had FROM (SELECT {FP} AS fp FROM {{prior}}) GROUP BY 1) p USING (fp))"""


def states(spark, sf):
    return B.match(with_print(findings(spark, sf)), with_print(relation(spark, sf, "prior")))


@add("ag07_gate_counts", f"SELECT count(*) FILTER (a = 'block') AS block, count(*) FILTER (a = 'review') AS review, count(*) FILTER (a = 'informational') AS informational FROM (SELECT {ACTION} AS a FROM {STATES} WHERE state = 'new')")
def gate_counts(spark, sf):
    return R.gate_counts(states(spark, sf).withColumn("action", S.gate_action(F.col("level"), F.col("precision"))), "new")


@add("ag08_verdict", """SELECT c_custkey, v AS verdict, CASE WHEN v = 'block' OR (c_custkey % 2 = 0 AND v = 'review') THEN 1 ELSE 0 END AS exit_code FROM (SELECT c_custkey, CASE WHEN a > 0 OR c < 40 OR (d > 0 AND e >= d) THEN 'block' WHEN b > 0 OR c < 70 OR e > 0 OR g OR r = 'partial' THEN 'review' ELSE 'pass' END AS v
FROM (SELECT c_custkey, (c_custkey % 4 = 0)::INT AS a, (c_custkey % 3 = 0)::INT AS b, 30 + c_custkey % 71 AS c, c_custkey % 6 AS d, (c_custkey % 7 = 0)::INT AS e, c_custkey % 17 = 0 AS g, CASE WHEN c_custkey % 23 = 0 THEN 'partial' ELSE 'complete' END AS r FROM customer))""")
def verdicts(spark, sf):
    k = F.col("c_custkey")
    flag = lambda n: (k % n == 0).cast("int")
    v = R.verdict(flag(4), flag(3), 30 + k % 71, k % 6, flag(7), k % 17 == 0, F.when(k % 23 == 0, "partial").otherwise("complete"))
    return relation(spark, sf, "customer").select(k, v.alias("verdict"), R.exit_code(v, k % 2 == 0).alias("exit_code"))


LEDGER = "(SELECT project_root, rule_id, " + ", ".join(f"CAST(sum(CASE WHEN event = '{k}' THEN n ELSE 0 END) AS BIGINT) AS {k}" for k in ("eligible", "attempted", "failed", "blocked", "skipped")) + " FROM {ledger} GROUP BY 1, 2)"


@add("ag09_ledger", f"SELECT * FROM {LEDGER}")
def ledger(spark, sf):
    return R.ledger_counts(relation(spark, sf, "ledger"))


@add("ag10_execution_status", f"""SELECT project_root, rule_id, CASE WHEN failed > attempted OR attempted > eligible THEN 'inconsistent' WHEN eligible = 0 THEN 'not_applicable' WHEN attempted > 0 AND failed = attempted THEN 'failed'
WHEN failed > 0 OR (attempted > 0 AND blocked + skipped > 0) THEN 'partial' WHEN blocked > 0 THEN 'blocked' WHEN skipped > 0 THEN 'skipped' WHEN attempted = 0 THEN 'not_recorded' ELSE 'complete' END AS status FROM {LEDGER}""")
def execution_status(spark, sf):
    return R.ledger_counts(relation(spark, sf, "ledger")).select("project_root", "rule_id", R.execution_status().alias("status"))


@add("ag11_observed", f"SELECT rule_id, count(*) AS n, list_sort(list_distinct(list(language))) AS languages, list_sort(list_distinct(list(precision))) AS precisions, list_sort(list_distinct(list(level) FILTER (level IS NOT NULL))) AS levels FROM {LEVELLED} GROUP BY rule_id")
def observed(spark, sf):
    return R.observed_rules(findings(spark, sf))


@add("ag12_stages", """SELECT project_root AS stage, CASE WHEN bool_or(rule_id = 'rule3') IS NOT TRUE THEN 'not_recorded' WHEN e = 0 THEN 'unavailable' WHEN f >= e THEN 'failed' WHEN f > 0 OR d < e THEN 'partial' ELSE 'complete' END AS status FROM
(SELECT *, sum(n) FILTER (event = 'eligible') OVER (PARTITION BY project_root) AS e, sum(n) FILTER (event = 'attempted') OVER (PARTITION BY project_root) AS d, sum(n) FILTER (event = 'failed') OVER (PARTITION BY project_root) AS f FROM {ledger}) GROUP BY project_root, e, d, f""")
def stages(spark, sf):
    total = lambda k: F.sum(F.when(F.col("event") == k, F.col("n")).otherwise(0))
    facts = relation(spark, sf, "ledger").groupBy(F.col("project_root").alias("stage")).agg(total("eligible").alias("expected"), total("attempted").alias("done"), total("failed").alias("failed"), F.bool_or(F.col("rule_id") == "rule3").alias("recorded"))
    return R.coverage_stages(facts)


@add("jn23_external_run", """WITH files AS (SELECT concat('p', p_partkey % 5) AS project_root, p_name || p_partkey AS rel, CASE p_partkey % 3 WHEN 0 THEN 'tsx' WHEN 1 THEN 'python' ELSE 'java' END AS language, p_partkey AS k FROM part)
SELECT project_root, rule_id, count(*) AS eligible, count(*) FILTER (k % 4 = 0) AS scanned, count(*) FILTER (k % 4 = 1) AS errors, count(*) FILTER (k % 4 = 2) AS skipped, count(*) FILTER (k % 4 = 3) AS missing
FROM files JOIN (VALUES ('S:a', 'typescript'), ('S:a', 'python'), ('S:b', 'java')) r(rule_id, lang) ON lang = CASE language WHEN 'tsx' THEN 'typescript' ELSE language END GROUP BY ALL""")
def external_run(spark, sf):
    files = relation(spark, sf, "part").select(F.expr("concat('p', p_partkey % 5)").alias("project_root"), F.expr("concat(p_name, p_partkey)").alias("rel"), F.expr("CASE p_partkey % 3 WHEN 0 THEN 'tsx' WHEN 1 THEN 'python' ELSE 'java' END").alias("language"), "p_partkey")
    run = files.filter("p_partkey % 4 < 3").select("rel", F.expr("CASE p_partkey % 4 WHEN 0 THEN 'scanned' WHEN 1 THEN 'error' ELSE 'skipped' END").alias("outcome"))
    rules = spark.createDataFrame([("S:a", "typescript"), ("S:a", "python"), ("S:b", "java")], "rule_id string, language string")
    return R.path_outcomes(F.broadcast(rules), files.drop("p_partkey"), run)


@add("wn01_baseline_states", f"SELECT seq, state FROM {STATES}")
def baseline_states(spark, sf):
    return states(spark, sf).select("seq", "state")


@add("wn01_baseline_summary", f"""SELECT CAST(sum(greatest(n - h, 0)) AS BIGINT) AS new, CAST(sum(least(n, h)) AS BIGINT) AS unchanged, CAST(sum(greatest(h - n, 0)) AS BIGINT) AS resolved FROM (
SELECT coalesce(a.n, 0) AS n, coalesce(b.n, 0) AS h FROM (SELECT {FP} AS fp, count(*) AS n FROM {{findings}} GROUP BY 1) a FULL JOIN (SELECT {FP} AS fp, count(*) AS n FROM {{prior}} GROUP BY 1) b USING (fp))""")
def baseline_summary(spark, sf):
    return B.summary(with_print(relation(spark, sf, "findings")), with_print(relation(spark, sf, "prior")))


@add("wn02_context_spans", """WITH hits AS (SELECT DISTINCT file, CAST(line AS BIGINT) AS line, CAST(90 AS BIGINT) AS total FROM {findings}), s AS (SELECT file, greatest(1, line - 5) AS a, least(total, line + 5) AS b FROM hits),
m AS (SELECT *, CASE WHEN a > max(b) OVER (PARTITION BY file ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 1 ELSE 0 END AS isnew FROM (SELECT DISTINCT * FROM s)),
i AS (SELECT *, sum(isnew) OVER (PARTITION BY file ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM m) SELECT file, min(a) AS a, max(b) AS b FROM i GROUP BY file, island""")
def spans(spark, sf):
    hits = relation(spark, sf, "findings").select("file", F.col("line").cast("long").alias("line"), F.lit(90).cast("long").alias("total"))
    return W.context_spans(hits, 5, ["file"])


@add("wn04_budget", "SELECT doc_id, line, CAST(spent AS BIGINT) AS spent FROM (SELECT doc_id, line, sum(strlen(text) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS spent FROM {lines}) WHERE spent <= 1000")
def budget(spark, sf):
    return W.within_budget(relation(spark, sf, "lines"), ["doc_id"], ["line"], F.octet_length("text") + 1, 1000).select("doc_id", "line", "spent")


@add("wn05_top", "SELECT stratum, sample_id, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY stratum ORDER BY bytes DESC, sample_id) AS INT) AS rank FROM {units}) WHERE rank <= 12")
def top(spark, sf):
    return W.top_per(relation(spark, sf, "units"), ["stratum"], [F.desc("bytes"), F.col("sample_id")], 12).select("stratum", "sample_id", "rank")


@add("wn07_key_blocks", """SELECT o_orderkey AS grp, CASE o_orderkey % 7 WHEN 5 THEN 2 ELSE 1 END AS line FROM orders WHERE o_orderkey % 7 IN (1, 2, 5)""")
def key_blocks(spark, sf):
    """Each order is a text of one of seven kinds; three of them hold a key block."""
    body, begin = "A" * 44, "-----BEGIN RSA PRIVATE KEY-----"
    texts = {1: [begin, body, "-----END"], 2: [f'k = "{begin}\\n{body}\\n-----END"'], 3: [begin, "MIIBROKEN", "-----END RSA PRIVATE KEY-----", body], 4: [begin, "", "", "", body], 5: ["x", begin, "short", body], 6: [body]}
    kinds = spark.createDataFrame([(g, n + 1, t) for g, ls in texts.items() for n, t in enumerate(ls)], "kind long, line int, text string")
    rows = relation(spark, sf, "orders").select(F.col("o_orderkey").alias("grp"), (F.col("o_orderkey") % 7).alias("kind")).join(F.broadcast(kinds), "kind").select("grp", "line", "text")
    return W.key_blocks(rows, ["grp"]).select("grp", "line")


@add("wn11_stratified", """WITH u AS (SELECT stratum, repo_id AS project, sample_id AS key, bytes % 9973 = 0 AS mandatory FROM {units}), r AS (SELECT *, row_number() OVER (PARTITION BY stratum, project ORDER BY mandatory DESC, key) AS turn FROM u),
n AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY turn, project, key) AS k, (SELECT count(*) FROM u x WHERE x.stratum = r.stratum AND x.mandatory) AS must FROM r WHERE NOT mandatory)
SELECT stratum, project, key FROM u WHERE mandatory UNION ALL SELECT stratum, project, key FROM n WHERE k <= 40 - must""")
def stratified(spark, sf):
    rows = relation(spark, sf, "units").select("stratum", F.col("repo_id").alias("project"), F.col("sample_id").alias("key"), (F.col("bytes") % 9973 == 0).alias("mandatory"))
    return W.stratified_round_robin(rows, 40)


@add("wn12_quota", """WITH s AS (SELECT stratum, count(*) AS n FROM {units} GROUP BY 1), h AS (SELECT *, n / (SELECT sum(n) FROM s) * 100 AS share FROM s), q AS (SELECT *, least(floor(share), floor(n * 0.9)) AS q0 FROM h),
o AS (SELECT *, row_number() OVER (ORDER BY share - floor(share) DESC, stratum) AS k, 100 - (SELECT sum(q0) FROM q) AS room FROM q) SELECT stratum, n, CAST(q0 + CASE WHEN k <= room AND q0 < floor(n * 0.9) THEN 1 ELSE 0 END AS BIGINT) AS quota FROM o""")
def quota(spark, sf):
    return W.proportional_quota(relation(spark, sf, "units").groupBy("stratum").agg(F.count("*").alias("n")), 100, 0.9)


@add("wn13_bottom_k", "SELECT repo_id, sample_id FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY sha256(sample_id)) AS k FROM {units}) WHERE k <= 25")
def bottom_k(spark, sf):
    return W.top_per(relation(spark, sf, "units"), ["repo_id"], [F.sha2("sample_id", 256)], 25).select("repo_id", "sample_id")


@add("wn14_retention", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS k FROM orders) WHERE k <= 10")
def retention(spark, sf):
    return W.top_per(relation(spark, sf, "orders"), ["o_custkey"], [F.desc("o_orderkey")], 10).select("o_custkey", "o_orderkey")


@add("wn15_last_write", "SELECT finding_seq, arg_max(status, updated_at) AS status, max(updated_at) AS updated_at, arg_max(note, updated_at) AS note FROM {reviews} GROUP BY 1")
def last_write(spark, sf):
    return W.last_write(relation(spark, sf, "reviews"), ["finding_seq"], "updated_at")


@add("src12_fold_items", """WITH RECURSIVE e AS (SELECT o_custkey AS item, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k, CASE o_orderkey % 4 WHEN 0 THEN 'Remove' WHEN 3 THEN 'Update' ELSE 'Include' END AS op, o_orderkey % 3 > 0 AS definite FROM orders),
f AS (SELECT item, CAST(0 AS BIGINT) AS k, 0 AS state FROM (SELECT DISTINCT item FROM e) UNION ALL
SELECT f.item, e.k, CASE WHEN op = 'Include' THEN greatest(state, CASE WHEN definite THEN 2 ELSE 1 END) WHEN op = 'Remove' AND definite THEN 0 WHEN op = 'Remove' THEN least(state, 1) ELSE state END FROM f JOIN e ON e.item = f.item AND e.k = f.k + 1)
SELECT item, CASE arg_max(state, k) WHEN 2 THEN 'definite' ELSE 'possible' END AS presence FROM f GROUP BY item HAVING arg_max(state, k) > 0""")
def fold_items(spark, sf):
    events = relation(spark, sf, "orders").select(F.col("o_custkey").alias("item"), F.col("o_orderkey").alias("seq"), F.expr("CASE o_orderkey % 4 WHEN 0 THEN 'Remove' WHEN 3 THEN 'Update' ELSE 'Include' END").alias("op"), (F.col("o_orderkey") % 3 > 0).alias("definite"))
    return W.fold_items(events, ["item"])


@add("st01_dedupe", "SELECT DISTINCT project_root, file, rule_id, title, engine, snippet FROM (SELECT * FROM {findings} UNION ALL SELECT * FROM {findings} WHERE seq % 3 = 0)")
def dedupe(spark, sf):
    f = relation(spark, sf, "findings")
    return B.dedupe(f.unionByName(f.filter("seq % 3 = 0")), ["project_root", "file", "rule_id", "title", "engine", "snippet"])


@add("st02_except_all", "SELECT rule_id, file FROM {findings} EXCEPT ALL SELECT rule_id, file FROM {prior}")
def except_all(spark, sf):
    return relation(spark, sf, "findings").select("rule_id", "file").exceptAll(relation(spark, sf, "prior").select("rule_id", "file"))


@add("st03_missing", "SELECT DISTINCT file FROM {findings} EXCEPT SELECT file FROM {findings} WHERE line > 93")
def missing(spark, sf):
    f = relation(spark, sf, "findings")
    return f.select("file").subtract(f.filter("line > 93").select("file"))


@add("st04_affected", "SELECT file FROM {findings} WHERE line = 3 UNION SELECT file FROM {findings} WHERE line = 5")
def affected(spark, sf):
    f = relation(spark, sf, "findings")
    return f.filter("line = 3").select("file").union(f.filter("line = 5").select("file")).distinct()


@add("st05_symmetric", "(SELECT sample_id FROM {answers} WHERE reviewer = 'a' EXCEPT SELECT sample_id FROM {answers} WHERE reviewer = 'b') UNION (SELECT sample_id FROM {answers} WHERE reviewer = 'b' EXCEPT SELECT sample_id FROM {answers} WHERE reviewer = 'a')")
def symmetric(spark, sf):
    a = relation(spark, sf, "answers")
    x, y = a.filter("reviewer = 'a'").select("sample_id"), a.filter("reviewer = 'b'").select("sample_id")
    return x.subtract(y).union(y.subtract(x))


@add("st07_selection", "SELECT seq FROM {findings} WHERE line < 50 AND seq NOT IN (SELECT finding_seq FROM {reviews})")
def selection(spark, sf):
    picked = relation(spark, sf, "reviews").select(F.col("finding_seq").alias("seq"))
    return B.selected(relation(spark, sf, "findings").filter("line < 50").select("seq"), picked, True, "seq")


@add("st08_catalog", f"SELECT rule_id, list_sort(list_distinct(list(language))) AS languages, count(DISTINCT concat(engine, precision)) > 1 AS conflict FROM {{findings}} GROUP BY rule_id")
def catalog(spark, sf):
    rows = relation(spark, sf, "findings").select("rule_id", F.array("language").alias("languages"), "engine", "precision")
    return B.merge_catalogs(rows)
