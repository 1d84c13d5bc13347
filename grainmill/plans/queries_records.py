"""Queries of saved engine logs, of proofs that a redacted value was a literal, and of sanitizers behind imports, and of labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainmill.functions import scalars as S
from grainmill.operators import graphs as G
from grainmill.plans.relations import duck, relation
from grainmill.sources import engine_logs as L
from grainmill.sources import labels as B

QUERIES, SQL = {}, {}


def add(key, sql):
    def keep(f):
        QUERIES[key], SQL[key] = f, duck(sql)
        return f

    return keep


KINDS = ("credential_url", "auth_header", "quoted_kv", "token_kv", "known_token")
KIND = "CASE line % 5 " + " ".join(f"WHEN {k} THEN '{name}'" for k, name in enumerate(KINDS)) + " END"
CUT = """^([^=:]*)[=:] ?["\']?([^\\x20"\']{4,})"""
CUT_SQL = CUT.replace("'", "''")


@add("sc03_literal_proof", f"""WITH r AS (SELECT doc_id, line, {KIND} AS kind, regexp_extract(text, '{CUT_SQL}', 1) AS before, regexp_extract(text, '{CUT_SQL}', 2) AS value FROM {{lines}} WHERE regexp_matches(text, '{CUT_SQL}')),
b AS (SELECT *, regexp_replace(value, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g') AS bare FROM r)
SELECT doc_id, line, kind, CASE WHEN kind = 'known_token' THEN true WHEN replace(bare, '*', '') = '' OR regexp_matches(bare, '{S.REFERENCE}') THEN false
WHEN kind = 'token_kv' THEN (length(q) - length(replace(replace(q, chr(34), ''), chr(39), ''))) % 2 = 1 ELSE true END AS literal FROM (SELECT *, regexp_replace(before, '\\\\.', '', 'g') AS q FROM b)""")
def literal_proof(spark, sf):
    rows = relation(spark, sf, "lines").filter(F.regexp_like("text", F.lit(CUT))).select("doc_id", "line", F.expr(KIND).alias("kind"), F.regexp_extract("text", CUT, 1).alias("before"), F.regexp_extract("text", CUT, 2).alias("value"))
    return rows.select("doc_id", "line", "kind", S.proves_literal(F.col("kind"), F.col("value"), F.col("before")).alias("literal"))


USES = "SELECT event_id AS seq, concat('src/m', user_id % 13, '/f', event_id % 17, '.tsx') AS rel, concat('clean', event_id % 23) AS name FROM {events}"
SAFE = "SELECT concat('src/m', p_partkey % 13, '/f', p_partkey % 17, '.tsx') AS rel, concat('clean', p_partkey % 29) AS name FROM {part}"
IMPORTS = """SELECT concat('src/m', l_orderkey % 13, '/f', l_partkey % 17, '.tsx') AS rel, concat('clean', l_suppkey % 23) AS name,
  min(CASE l_orderkey % 4 WHEN 0 THEN concat('@/m', l_suppkey % 11, '/f', l_partkey % 7) WHEN 1 THEN concat('../m', l_suppkey % 11, '/f', l_partkey % 7) WHEN 2 THEN concat('./f', l_partkey % 7) ELSE concat('@scope/f', l_partkey % 7) END) AS spec
  FROM {lineitem} GROUP BY 1, 2"""


@add("gr05_sanitizer", f"""WITH u AS ({USES}), s AS (SELECT DISTINCT * FROM ({SAFE})), i AS (SELECT * FROM ({IMPORTS}) WHERE NOT starts_with(spec, '@scope')), t AS (SELECT rel, name, regexp_replace(spec, '^(@|[.]+)/', '') AS tail FROM i)
SELECT seq, rel, name FROM u WHERE EXISTS (SELECT 1 FROM s WHERE s.rel = u.rel AND s.name = u.name)
OR EXISTS (SELECT 1 FROM t JOIN s ON s.name = t.name AND s.rel <> t.rel AND ends_with(s.rel, '/' || t.tail || '.tsx') WHERE t.rel = u.rel AND t.name = u.name)""")
def sanitizer(spark, sf):
    of = lambda sql, name: spark.sql(sql, **{name: relation(spark, sf, name)})
    return G.proven_names(of(USES, "events"), of(SAFE, "part"), of(IMPORTS, "lineitem")).select("seq", "rel", "name")


# One log for each user: its events are results and files. Every 13th log says nothing of what was scanned, every 17th is broken.
RUN = "concat('/w/r', user_id)"
FILE = "concat('a/f', event_id % 5, '.py')"
RESULTS = f"""SELECT {RUN} AS root, user_id, event_id, {FILE} AS file, CASE event_id % 10 WHEN 0 THEN concat({RUN}, '/', {FILE}) WHEN 1 THEN '/w/other.py' WHEN 2 THEN '../up.py' WHEN 3 THEN concat('./', {FILE}) ELSE {FILE} END AS path,
  CASE WHEN event_id % 41 = 0 THEN '  ' ELSE concat(' k', event_id % 7) END AS check_id, CASE event_id % 4 WHEN 0 THEN 'ERROR' WHEN 1 THEN 'WARNING' WHEN 2 THEN 'INFO' ELSE 'ODD' END AS severity,
  CASE WHEN event_id % 3 = 0 THEN 'exact' ELSE 'other' END AS said, CAST(event_id % 300 AS INT) AS line, CASE WHEN event_id % 6 = 0 THEN '' ELSE concat(event_type, ' seen', chr(10), 'more') END AS message, event_type FROM {{events}}"""
ESCAPED, BROKEN = "(event_id % 10 IN (1, 2))", "(event_id % 41 = 0)"


def logs(spark, sf):
    """(root, body): a user's events are few."""
    rows = spark.sql(RESULTS, events=relation(spark, sf, "events"))
    result = F.struct("check_id", "path", F.struct("line").alias("start"), F.struct("severity", "message", F.create_map(F.lit("precision"), F.col("said")).alias("metadata")).alias("extra"))
    scanned = F.collect_set(F.when(F.col("event_id") % 4 != 0, F.col("file")))
    by_user = rows.groupBy("root", "user_id").agg(F.collect_list(result).alias("results"), scanned.alias("scanned"), F.collect_list(F.when(F.col("event_type") == "error", F.struct(F.col("file").alias("path")))).alias("errors"))
    paths = F.struct(F.when(F.col("user_id") % 13 != 0, F.col("scanned")).alias("scanned"))
    return by_user.select("root", F.when(F.col("user_id") % 17 == 0, "{\"results\": 7").otherwise(F.to_json(F.struct("results", "errors", paths.alias("paths")))).alias("body"))


@add("src21_log_findings", f"""SELECT root, 'S:' || trim(check_id) AS rule_id, CASE severity WHEN 'ERROR' THEN 'error' WHEN 'INFO' THEN 'note' ELSE 'warning' END AS level, CASE WHEN message = '' THEN 'engine finding' ELSE event_type || ' seen' END AS title, file, line,
CASE said WHEN 'exact' THEN 'exact' ELSE 'heuristic' END AS precision FROM ({RESULTS}) WHERE user_id % 17 <> 0 AND NOT {ESCAPED} AND NOT {BROKEN}""")
def log_findings(spark, sf):
    return L.findings(L.parsed(logs(spark, sf)))


@add("src21_completeness", f"""WITH r AS ({RESULTS}), f AS (SELECT root, file, max(event_id % 4) > 0 AS seen FROM r WHERE user_id % 13 <> 0 AND user_id % 17 <> 0 GROUP BY ALL), m AS (SELECT root, count(*) AS n FROM f WHERE NOT seen GROUP BY ALL),
c AS (SELECT root, user_id, coalesce(any_value(m.n), 0) AS n_missing, count(*) FILTER (WHERE event_type = 'error') AS e, count(*) FILTER (WHERE {ESCAPED}) AS x, count(*) FILTER (WHERE {BROKEN} AND NOT {ESCAPED}) AS b FROM r LEFT JOIN m USING (root) GROUP BY ALL),
v AS (SELECT root, user_id, n_missing, CASE WHEN user_id % 17 = 0 THEN 0 ELSE e END AS n_errors, CAST(0 AS BIGINT) AS n_skipped, CASE WHEN user_id % 17 = 0 THEN 0 ELSE x END AS n_escaped, CASE WHEN user_id % 17 = 0 THEN 0 ELSE b END AS n_malformed FROM c)
SELECT * EXCLUDE (user_id), CASE WHEN user_id % 17 = 0 THEN 'invalid' WHEN user_id % 13 = 0 OR n_missing + n_errors + n_escaped + n_malformed > 0 THEN 'partial' ELSE 'success' END AS state FROM v""")
def log_completeness(spark, sf):
    expected = spark.sql(RESULTS, events=relation(spark, sf, "events")).select("root", F.col("file").alias("path"))
    return L.completeness(L.parsed(logs(spark, sf)), expected)


# Labels of orders; each fault hits the orders that a prime divides, and every 59th row is there twice.
NAMED = """SELECT o_orderkey, CASE WHEN o_orderkey % 29 = 0 THEN 'Repo 1' ELSE concat('repo-', chr(97 + CAST(o_custkey % 5 AS INT))) END AS alias, CASE WHEN o_orderkey % 37 = 0 THEN 'p1' ELSE concat('P', 100 + o_orderkey % 20) END AS rule,
  o_orderkey % 101 AS population, concat('p', o_custkey % 9) AS project, CASE WHEN o_orderkey % 31 = 0 THEN '' ELSE concat('src/f', o_orderkey % 70, '.py') END AS file, CAST(o_orderkey % 211 AS INT) - 1 AS line, concat('fp', o_orderkey) AS fingerprint,
  CASE o_orderkey % 61 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE 'r' END AS review_id, CASE WHEN o_orderkey % 41 = 0 THEN '  ' ELSE 'seen' END AS evidence, CASE WHEN o_orderkey % 53 = 0 THEN 'maybe' WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'confirmed' END AS validity FROM {orders}"""
SIGNED = f"""SELECT *, CASE WHEN o_orderkey % 47 = 0 THEN 'none' ELSE HASH(concat('["', alias, '","', project, '","', file, '",', line, ',"', rule, '","', fingerprint, CASE WHEN o_orderkey % 43 = 0 THEN '"' ELSE '"]' END)) END AS sample_id FROM ({NAMED})"""
LABELS = f"SELECT * FROM ({SIGNED}) UNION ALL SELECT * FROM ({SIGNED}) WHERE o_orderkey % 59 = 0"


@add("src23_label_problems", f"""WITH r AS ({LABELS.replace("HASH", "sha256")}) SELECT o_orderkey, CASE WHEN sample_id = 'none' THEN 'sample_id' WHEN o_orderkey % 59 = 0 THEN 'duplicate' WHEN alias = 'Repo 1' THEN 'alias' WHEN alias = 'repo-e' THEN 'unknown alias'
WHEN rule = 'p1' THEN 'rule' WHEN population = 0 THEN 'population' WHEN file = '' THEN 'file' WHEN line < 0 THEN 'line' WHEN review_id = '' THEN 'review_id' WHEN evidence = '  ' THEN 'evidence' WHEN o_orderkey % 43 = 0 THEN 'identity' WHEN validity = 'maybe' THEN 'validity' END AS problem FROM r""")
def label_problems(spark, sf):
    rows = spark.sql(LABELS.replace("HASH", "sha2").replace("'\"]' END))", "'\"]' END), 256)"), orders=relation(spark, sf, "orders"))
    rows = rows.withColumns({axis: F.lit(None).cast("string") for axis in B.AXES if axis != "validity"})
    corpus = spark.createDataFrame([(f"repo-{x}", 5) for x in "abcd"] + [("repo-e", 0)], "alias string, n int")
    return B.problems(rows, corpus).select("o_orderkey", "problem")
