"""Queries of graphs, statistics and the query surface."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainmill.functions import scalars as S
from grainmill.operators import explore as E
from grainmill.operators import graphs as G
from grainmill.operators import stats as T
from grainmill.operators import windows as W
from grainmill.plans.queries_scores import LEVELLED, STATES, findings, states
from grainmill.plans.relations import duck, relation

QUERIES, SQL = {}, {}


def add(key, sql=None):
    def keep(f):
        QUERIES[key] = f
        if sql:
            SQL[key] = duck(sql)
        return f

    return keep


@add("gr01_two_contexts", """WITH RECURSIVE c(node) AS (SELECT DISTINCT concat('f', n_nationkey * 3) FROM nation WHERE n_nationkey % 5 = 0), r(node, context) AS (
SELECT e, CASE WHEN e IN (SELECT node FROM c) THEN 'client' ELSE 'server' END FROM (VALUES ('f1'), ('f7'), ('f30')) v(e)
UNION SELECT dst, CASE WHEN dst IN (SELECT node FROM c) THEN 'client' ELSE context END FROM r JOIN {edges} ON src = node) SELECT node, context FROM r""")
def two_contexts(spark, sf):
    client = relation(spark, sf, "nation").filter("n_nationkey % 5 = 0").select(F.expr("concat('f', n_nationkey * 3)").alias("node"))
    entries = spark.createDataFrame([("f1",), ("f7",), ("f30",)], "node string")
    return G.two_contexts(entries, relation(spark, sf, "edges"), client)


@add("gr02_best_kind", """WITH RECURSIVE e AS (SELECT src, dst, CASE WHEN length(src) + length(dst) > 5 THEN 2 ELSE 1 END AS rank FROM {edges}), r(root, node, rank) AS (
SELECT n, n, 2 FROM (VALUES ('f1'), ('f7')) v(n) UNION SELECT root, dst, least(r.rank, e.rank) FROM r JOIN e ON e.src = r.node) SELECT root, node, max(rank) AS rank FROM r GROUP BY root, node""")
def best_kind(spark, sf):
    edges = relation(spark, sf, "edges").withColumn("rank", F.when(F.length("src") + F.length("dst") > 5, 2).otherwise(1))
    return G.best_kind(spark.createDataFrame([("f1", "f1", 2), ("f7", "f7", 2)], "root string, node string, rank int"), edges)


@add("gr03_includes", """WITH RECURSIVE r(root, node, depth) AS (SELECT n, n, 0 FROM (VALUES ('f2'), ('f9')) v(n) UNION SELECT root, dst, depth + 1 FROM r JOIN {edges} ON src = node WHERE depth < 10)
SELECT root, node, min(depth) AS depth FROM r GROUP BY root, node""")
def includes(spark, sf):
    return G.reachable(spark.createDataFrame([("f2", "f2"), ("f9", "f9")], "root string, node string"), relation(spark, sf, "edges"), 10)


@add("gr04_subclasses", """WITH RECURSIVE r(node) AS (SELECT 'f5' UNION SELECT dst FROM r JOIN {edges} ON src = node) SELECT node FROM r""")
def subclasses(spark, sf):
    return G.reachable(spark.createDataFrame([("f5", "f5")], "root string, node string"), relation(spark, sf, "edges")).select("node")


@add("gr07_expand", """WITH h AS (SELECT DISTINCT s.root, e.dst, e.kind FROM (SELECT DISTINCT src AS root FROM {edges}) s JOIN (SELECT src, dst, length(dst) % 2 AS kind FROM {edges}) e ON e.src = s.root AND e.dst <> s.root)
SELECT root, dst, kind, CAST(k AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY kind, dst) AS k FROM h) WHERE k <= 4""")
def expand(spark, sf):
    links = relation(spark, sf, "edges").withColumn("kind", (F.length("dst") % 2).cast("long"))
    return G.expand_once(links.select(F.col("src").alias("root"), F.col("src").alias("node")).distinct(), links, 4)


@add("ag14_label_axes", """SELECT rule_id, n, confirmed, false_positive, uncertain, round_even(confirmed / n, 4) AS rate, CASE WHEN n < 5 THEN 'insufficient' WHEN false_positive / n >= 0.34 AND false_positive > 0 THEN 'needs_hardening' WHEN uncertain * 2 > n THEN 'unclear' ELSE 'supported' END AS class FROM
(SELECT rule_id, count(*) AS n, count(*) FILTER (label = 'confirmed') AS confirmed, count(*) FILTER (label = 'false_positive') AS false_positive, count(*) FILTER (label = 'uncertain') AS uncertain FROM {answers} GROUP BY 1)""")
def label_axes(spark, sf):
    return T.label_axes(relation(spark, sf, "answers")).withColumn("class", T.evidence_class())


PAIRS = "(SELECT x.label AS a, y.label AS b FROM {answers} x JOIN {answers} y ON x.sample_id = y.sample_id AND x.reviewer = 'a' AND y.reviewer = 'b')"


@add("ag17_kappa", f"""WITH p AS {PAIRS}, o AS (SELECT count(*) AS n, count(*) FILTER (a = b) AS same FROM p), c AS (SELECT coalesce(sum(na * nb), 0) AS chance FROM (SELECT a, count(*) AS na FROM p GROUP BY 1) JOIN (SELECT b, count(*) AS nb FROM p GROUP BY 1) ON a = b)
SELECT n, round(same / nullif(n, 0), 6) AS observed, round(chance / nullif(n * n, 0), 6) AS expected, CASE WHEN chance / nullif(n * n, 0) < 1 THEN round((same / n - chance / (n * n)) / (1 - chance / (n * n)), 6) END AS kappa FROM o, c""")
def kappa(spark, sf):
    a = relation(spark, sf, "answers")
    x, y = a.filter("reviewer = 'a'").select("sample_id", F.col("label").alias("a")), a.filter("reviewer = 'b'").select("sample_id", F.col("label").alias("b"))
    return T.kappa(x.join(y, "sample_id").select("a", "b"))


@add("jn22_raters", f"SELECT a, b, count(*) AS n FROM {PAIRS} GROUP BY a, b")
def raters(spark, sf):
    a = relation(spark, sf, "answers")
    x, y = a.filter("reviewer = 'a'").select("sample_id", F.col("label").alias("a")), a.filter("reviewer = 'b'").select("sample_id", F.col("label").alias("b"))
    return x.join(y, "sample_id").groupBy("a", "b").agg(F.count("*").alias("n"))


@add("ag18_jaccard", """SELECT file, count(*) FILTER (s = 2) AS common, count(*) AS every, round(count(*) FILTER (s = 2) / count(*), 6) AS jaccard FROM (SELECT file, rule_id, line, count(DISTINCT side) AS s FROM (
SELECT file, rule_id, line, 1 AS side FROM {findings} WHERE seq % 2 = 0 UNION ALL SELECT file, rule_id, line, 2 FROM {findings} WHERE seq % 3 = 0) GROUP BY 1, 2, 3) GROUP BY file""")
def jaccard(spark, sf):
    f = relation(spark, sf, "findings")
    return T.jaccard(f.filter("seq % 2 = 0"), f.filter("seq % 3 = 0"), ["file"], ["rule_id", "line"])


@add("ag19_inclusion", "SELECT stratum, n, k, round(k / n, 6) AS probability, round(n / sum(n) OVER (), 6) AS share FROM (SELECT stratum, count(*) AS n, count(*) FILTER (bytes % 11 = 0) AS k FROM {units} GROUP BY 1)")
def inclusion(spark, sf):
    u = relation(spark, sf, "units")
    return T.inclusion(u, u.filter("bytes % 11 = 0"), ["stratum"])


@add("ag20_distribution", "SELECT repo_id, n, s[1] AS least, s[n // 2 + 1] AS median, s[least(CAST(floor(n * 0.95) AS BIGINT), n - 1) + 1] AS p95, s[n] AS greatest FROM (SELECT repo_id, count(*) AS n, list_sort(list(bytes)) AS s FROM {units} GROUP BY 1)")
def distribution(spark, sf):
    return T.distribution(relation(spark, sf, "units"), ["repo_id"], "bytes")


SAID = "(SELECT rule_id AS query, CASE WHEN label = 'confirmed' THEN 'positive' ELSE 'negative' END AS expected, CASE hash % 3 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' ELSE 'abstain' END AS said FROM (SELECT *, CAST(substr(sample_id, 2) AS BIGINT) AS hash FROM {answers}))"


@add("ag21_confusion", f"""SELECT *, CASE WHEN fp > tp THEN 'reject' WHEN tp + tn > 2 * (fp + fn) THEN 'accept' ELSE 'review' END AS verdict FROM (SELECT query, {", ".join(f"count(*) FILTER (expected = '{e}' AND said = '{s}') AS {k}" for k, e, s in (("tp", "positive", "positive"), ("fp", "negative", "positive"), ("tn", "negative", "negative"), ("fn", "positive", "negative")))},
count(*) FILTER (said = 'abstain') AS abstained FROM {SAID} GROUP BY query)""")
def confusion(spark, sf):
    rows = relation(spark, sf, "answers").withColumn("h", F.expr("CAST(substr(sample_id, 2) AS BIGINT) % 3"))
    return T.confusion(rows.select(F.col("rule_id").alias("query"), F.expr("CASE WHEN label = 'confirmed' THEN 'positive' ELSE 'negative' END").alias("expected"), F.expr("CASE h WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' ELSE 'abstain' END").alias("said")))


@add("ag23_evaluation", """SELECT concat('q', o_custkey % 8) AS query, count(*) AS n, round(count(*) FILTER (o_orderkey % 3 > 0) / count(*), 4) AS decided, count(*) - count(DISTINCT o_orderkey % 100) AS duplicates, min(o_orderkey % 977) AS latency_min, max(o_orderkey % 977) AS latency_max, round(sum(o_orderkey % 977) / count(*), 4) AS latency_mean FROM orders GROUP BY 1""")
def evaluation(spark, sf):
    return T.evaluation(relation(spark, sf, "orders").select(F.expr("concat('q', o_custkey % 8)").alias("query"), F.expr("o_orderkey % 100").alias("candidate"), F.expr("o_orderkey % 3 > 0").alias("decided"), F.expr("o_orderkey % 977").alias("latency")))


@add("ag24_estimate", "SELECT repo_id AS pack, CAST(sum(ceil(bytes / 4)) AS BIGINT) AS tokens, CAST(sum(bytes % 3) AS BIGINT) AS redacted, sha256(string_agg(sample_id, chr(10) ORDER BY start_line, sample_id)) AS digest FROM {units} GROUP BY 1")
def estimate(spark, sf):
    return T.estimate(relation(spark, sf, "units").select(F.col("repo_id").alias("pack"), F.col("start_line").alias("seq"), F.col("sample_id").alias("id"), "bytes", (F.col("bytes") % 3).alias("redacted")))


@add("ag26_accepted", "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 OR c_custkey % 7 = 0 THEN NULL ELSE c_custkey % 11 >= c_custkey % 3 END AS accepted FROM customer")
def accepted(spark, sf):
    rows = relation(spark, sf, "customer").select("c_custkey", F.expr("CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_custkey % 11 END").alias("earned"), F.expr("CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_custkey % 3 END").alias("needed"))
    return rows.select("c_custkey", T.accepted().alias("accepted"))


@add("ag27_matrix", f"SELECT human, model, coalesce(n, 0) AS n FROM (SELECT a.k AS human, b.k AS model FROM (VALUES ('confirmed'), ('false_positive'), ('uncertain')) a(k), (VALUES ('confirmed'), ('false_positive'), ('uncertain')) b(k)) LEFT JOIN (SELECT a, b, count(*) AS n FROM {PAIRS} GROUP BY 1, 2) ON a = human AND b = model")
def matrix(spark, sf):
    a = relation(spark, sf, "answers")
    x, y = a.filter("reviewer = 'a'").select("sample_id", F.col("label").alias("human")), a.filter("reviewer = 'b'").select("sample_id", F.col("label").alias("model"))
    return T.outcome_matrix(x.join(y, "sample_id"), ["confirmed", "false_positive", "uncertain"])


SPEC = E.FilterSpec(text="VALUE  =", values={"rule_id": ("H001", "P002", "P007"), "language": ("python", "typescript"), "engine": ()}, baseline="new", sort="line", descending=True, page=3, size=20)
FOUND = f"SELECT * FROM {STATES} WHERE contains(lower(concat_ws(chr(10), title, file, rule_id, snippet, project_root, language, engine)), 'value  =') AND rule_id IN ('H001', 'P002', 'P007') AND language IN ('python', 'typescript') AND state = 'new'"


@add("qs03_filter", f"SELECT seq FROM ({FOUND})")
def explored(spark, sf):
    return E.filtered(states(spark, sf), SPEC).select("seq")


@add("qs01_page", f"SELECT seq FROM ({FOUND}) ORDER BY line DESC, project_root, file, rule_id, seq LIMIT 20 OFFSET 40")
def one_page(spark, sf):
    return E.page(E.filtered(states(spark, sf), SPEC), SPEC).select("seq")


@add("qs04_rules", f"SELECT rule_id, n FROM (SELECT rule_id, count(*) AS n, list(language) AS l FROM {LEVELLED} WHERE level = 'error' GROUP BY 1) WHERE list_contains(l, 'java')")
def rule_table(spark, sf):
    rows = findings(spark, sf).filter("level = 'error'").groupBy("rule_id").agg(F.count("*").alias("n"), F.collect_set("language").alias("languages"))
    return rows.filter(F.array_contains("languages", "java")).select("rule_id", "n")


@add("qs06_paths", "SELECT DISTINCT p AS path FROM (SELECT 'src' AS p FROM {findings} UNION ALL SELECT regexp_extract(file, '^(src/m\\d+)/', 1) FROM {findings})")
def paths(spark, sf):
    return E.path_suggestions(relation(spark, sf, "findings"))


@add("qs07_source_window", "SELECT doc_id, line, text FROM {lines} WHERE line BETWEEN 2 AND 4")
def source_window(spark, sf):
    spans = W.context_spans(relation(spark, sf, "documents").select("doc_id", F.lit(3).cast("long").alias("line"), F.lit(10**6).cast("long").alias("total")), 1, ["doc_id"])
    return relation(spark, sf, "lines").join(spans, "doc_id").filter("line BETWEEN a AND b").select("doc_id", "line", "text")


@add("qs08_batch", """WITH b AS (SELECT finding_seq AS seq, status, updated_at % 2 = 0 AS confirmed FROM {reviews}), k AS (SELECT seq, level FROM {findings} WHERE seq % 3 > 0)
SELECT n, unknown, CASE WHEN n > 5000 THEN 'too_many' WHEN d < n THEN 'duplicate' WHEN unknown > 0 THEN 'unknown' WHEN e > 0 THEN 'unconfirmed_error' END AS reason FROM (SELECT count(*) AS n, count(DISTINCT seq) AS d FROM b),
(SELECT count(*) AS unknown FROM b WHERE seq NOT IN (SELECT seq FROM k)), (SELECT count(*) AS e FROM b JOIN k USING (seq) WHERE level = 'error' AND status = 'dismissed' AND NOT confirmed)""")
def batch(spark, sf):
    b = relation(spark, sf, "reviews").select(F.col("finding_seq").alias("seq"), "status", (F.col("updated_at") % 2 == 0).alias("confirmed"))
    return E.check_batch(b, relation(spark, sf, "findings").filter("seq % 3 > 0").select("seq", "level"), 5000)


@add("qs09_search", "SELECT doc_id, line FROM {lines} WHERE contains(text, 'token =') ORDER BY doc_id, line LIMIT 20")
def search(spark, sf):
    return E.search(relation(spark, sf, "lines"), "token =").select("doc_id", "line")


@add("qs09_symbol", r"SELECT doc_id, line FROM {lines} WHERE regexp_matches(text, '(^|[^0-9A-Za-z_À-ÿ])idiot($|[^0-9A-Za-z_À-ÿ])') ORDER BY doc_id, line LIMIT 20")
def symbol(spark, sf):
    return E.search(relation(spark, sf, "lines"), "idiot", symbol=True).select("doc_id", "line")


@add("snk04_upsert", "SELECT finding_seq, status FROM (SELECT finding_seq, arg_max(coalesce(status, '-'), seq) AS status FROM (SELECT finding_seq, status, updated_at AS seq FROM {reviews} UNION ALL SELECT finding_seq, CASE WHEN finding_seq % 3 = 0 THEN NULL ELSE 'confirmed' END, updated_at + 1000000 FROM {reviews} WHERE finding_seq % 2 = 0) GROUP BY 1) WHERE status <> '-'")
def upserted(spark, sf):
    r = relation(spark, sf, "reviews").select("finding_seq", "status", F.col("updated_at").alias("seq"))
    changes = r.filter("finding_seq % 2 = 0").select("finding_seq", F.expr("CASE WHEN finding_seq % 3 = 0 THEN NULL ELSE 'confirmed' END").alias("status"), (F.col("seq") + 1_000_000).alias("seq"))
    return E.upsert(r, changes, "finding_seq", "seq").select("finding_seq", "status")


@add("src16_registry_cache", "SELECT k AS key, arg_max(v, w) AS value FROM (SELECT c_custkey % 500 AS k, c_name AS v, c_custkey AS w, c_custkey * 7 % 1000 AS expires FROM customer) WHERE expires > 400 GROUP BY k")
def registry_cache(spark, sf):
    rows = relation(spark, sf, "customer").select((F.col("c_custkey") % 500).alias("key"), F.col("c_name").alias("value"), F.col("c_custkey").alias("written"), (F.col("c_custkey") * 7 % 1000).alias("expires"))
    return W.last_write(rows.filter("expires > 400"), ["key"], "written").select("key", "value")


@add("ai02_hints", """SELECT doc_id, hints, evidence, rank FROM (SELECT *, CAST(row_number() OVER (ORDER BY hints DESC, evidence DESC, doc_id) AS INT) AS rank FROM (SELECT doc_id, count(DISTINCT hint) AS hints, count(DISTINCT line) AS evidence
FROM {lines} JOIN (VALUES ('token'), ('idiot'), ('http'), ('the and')) h(hint) ON contains(lower(text), hint) GROUP BY doc_id)) WHERE rank <= 12""")
def hints(spark, sf):
    hits = F.filter(F.array(*[F.lit(h) for h in ("token", "idiot", "http", "the and")]), lambda h: F.contains(F.lower("text"), h))
    rows = relation(spark, sf, "lines").select("doc_id", "line", F.explode(hits).alias("hint"))
    counted = rows.groupBy("doc_id").agg(F.count_distinct("hint").alias("hints"), F.count_distinct("line").alias("evidence"))
    top = counted.orderBy(F.desc("hints"), F.desc("evidence"), "doc_id").limit(12)
    # Twelve rows at most are numbered.
    return top.withColumn("rank", F.row_number().over(W.Window.partitionBy(F.lit(1)).orderBy(F.desc("hints"), F.desc("evidence"), "doc_id")))


@add("ai06_evidence", r"""SELECT doc_id, CASE WHEN n = 0 THEN 'insufficient' WHEN regexp_matches(t, 'token\s*=\s*"[0-9a-f]{32,}"') THEN 'supported' WHEN regexp_matches(t, '(changeme|example\.com)') THEN 'unsupported' ELSE 'insufficient' END AS verdict
FROM (SELECT doc_id, count(*) AS n, string_agg(text, chr(10) ORDER BY line) AS t FROM {lines} GROUP BY doc_id)""")
def evidence(spark, sf):
    cited = relation(spark, sf, "lines")
    flag = lambda p: F.bool_or(F.col("text").rlike(p))
    rows = cited.groupBy("doc_id").agg(flag(r'token\s*=\s*"[0-9a-f]{32,}"').alias("yes"), flag(r"(changeme|example\.com)").alias("no"))
    return rows.select("doc_id", F.when(F.col("yes"), "supported").when(F.col("no"), "unsupported").otherwise("insufficient").alias("verdict"))


@add("ai08_candidates", "SELECT rule_id, file, line, min(seq) AS seq, count(*) AS seen FROM {findings} GROUP BY 1, 2, 3")
def candidates(spark, sf):
    return relation(spark, sf, "findings").groupBy("rule_id", "file", "line").agg(F.min("seq").alias("seq"), F.count("*").alias("seen"))


@add("ai05_redaction_runs", """WITH f AS (SELECT DISTINCT doc_id, line FROM {lines} WHERE contains(text, 'e')), g AS (SELECT *, line - row_number() OVER (PARTITION BY doc_id ORDER BY line) AS island FROM f)
SELECT doc_id, min(line) AS a, max(line) AS b FROM g GROUP BY doc_id, island""")
def redaction_runs(spark, sf):
    hit = relation(spark, sf, "lines").filter(F.contains("text", F.lit("e"))).select("doc_id", F.col("line").alias("a"), F.col("line").alias("b")).distinct()
    return W.merge_spans(hit, ["doc_id"], "a", "b")


@add("ss03_job_state", "SELECT user_id, arg_max(event_type, row(ts, event_id)) AS state FROM events GROUP BY user_id")
def job_state(spark, sf):
    rows = relation(spark, sf, "events").select("user_id", F.struct("ts", "event_id").alias("at"), "event_type")
    return rows.groupBy("user_id").agg(F.max_by("event_type", "at").alias("state"))


@add("sc21_internal", "SELECT DISTINCT top_level, top_level IN ('pkg1', 'pkg10') AS internal FROM {imports}")
def internal(spark, sf):
    return relation(spark, sf, "imports").select("top_level", S.internal_name(F.col("top_level"), ["pkg1", "pkg10"]).alias("internal")).distinct()
