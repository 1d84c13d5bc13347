"""Queries of the column functions (SC…) over documents, findings and declarations."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainmill.functions import scalars as S
from grainmill.plans.relations import duck, relation

QUERIES, SQL = {}, {}


def add(key, sql=None):
    def keep(f):
        QUERIES[key] = f
        if sql:
            SQL[key] = duck(sql)
        return f

    return keep


@add("sc01_redact", r"""
SELECT doc_id, line, regexp_replace(regexp_replace(text, '\b([a-zA-Z]*token|secret|password)(\s*[=:]\s*)"([^"\\]{1,512})"', '\1\2"***"', 'gi'),
       '\b(token|secret|password)(\s*[=:]\s*)([^&\s''";,]{1,512})', '\1\2***', 'gi') AS text
FROM {lines} WHERE regexp_matches(text, '(token|secret|password)\s*[=:]', 'i')""")
def redacted_lines(spark, sf):
    rows = relation(spark, sf, "lines").filter(F.col("text").rlike(r"(?i)(token|secret|password)\s*[=:]"))
    return rows.select("doc_id", "line", S.redact(F.col("text")).alias("text"))


@add("sc02_redact_counts", r"""
SELECT source, count(*) AS n_lines, CAST(sum(len(regexp_extract_all(text, '(?i)token\s*[=:]\s*"[^"\\]{1,512}"'))) AS BIGINT) AS n_quoted
FROM {lines} WHERE regexp_matches(text, '(?i)token\s*[=:]\s*"') GROUP BY source""")
def redaction_counts(spark, sf):
    rows = relation(spark, sf, "lines").filter(F.col("text").rlike(r'(?i)token\s*[=:]\s*"')).select("source", S.redact_counts(F.col("text")).alias("r"))
    return rows.groupBy("source").agg(F.count("*").alias("n_lines"), F.sum("r.quoted").alias("n_quoted"))


@add("sc04_mask", r"""
SELECT doc_id, line, replace(text, v, substr(v, 1, 2) || '***') AS masked FROM (
  SELECT *, regexp_extract(text, '(?i)\b(?:api_?key|secret|token|passwd|password)\b\s*[:=]\s*["'']([^"'']{8,})["'']', 1) AS v FROM {lines}) WHERE v <> ''""")
def masked_credentials(spark, sf):
    value = F.regexp_extract("text", r"""(?i)\b(?:api_?key|secret|token|passwd|password)\b\s*[:=]\s*["']([^"']{8,})["']""", 1)
    rows = relation(spark, sf, "lines").withColumn("v", value).filter("v <> ''")
    return rows.select("doc_id", "line", S.masked(F.col("text"), F.col("v"), 2).alias("masked"))


ANCHOR = r"coalesce(nullif(trim(regexp_replace(snippet, '\s+', ' ', 'g')), ''), trim(regexp_replace(title, '\s+', ' ', 'g')))"
PRINT = f"""sha256('{{{{"anchor":"' || {ANCHOR} || '","engine":"' || engine || '","file":"' || file || '","project_root":"' || project_root || '","rule_id":"' || rule_id || '"}}}}')"""


@add("sc06_anchor", f"SELECT seq, {ANCHOR} AS anchor FROM {{findings}}")
def anchors(spark, sf):
    return relation(spark, sf, "findings").select("seq", S.anchor(F.col("snippet"), F.col("title")).alias("anchor"))


def with_print(rows):
    return rows.withColumn("fp", S.fingerprint(*[F.col(c) for c in ("project_root", "file", "rule_id", "engine")], S.anchor(F.col("snippet"), F.col("title"))))


@add("sc07_fingerprint", f"SELECT seq, {PRINT.replace('{{', '{').replace('}}', '}')} AS fp FROM {{findings}}")
def fingerprints(spark, sf):
    return with_print(relation(spark, sf, "findings")).select("seq", "fp")


@add("sc08_review_id", """SELECT seq, sha256('["' || project_root || '","' || file || '",' || line || ',"' || rule_id || '","' || title || '","' || engine || '"]') AS review_id FROM {findings}""")
def review_ids(spark, sf):
    return relation(spark, sf, "findings").select("seq", S.review_id(*[F.col(c) for c in ("project_root", "file", "line", "rule_id", "title", "engine")]).alias("review_id"))


@add("sc09_ids", """SELECT sample_id, substr(sha256(sample_id || chr(31) || file || chr(31) || start_line), 1, 16) AS unit_id, lower(trim(regexp_replace('  The ' || stratum || '   Claim ', '\\s+', ' ', 'g'))) AS claim FROM {units}""")
def digest_ids(spark, sf):
    return relation(spark, sf, "units").select("sample_id", S.digest_id(F.col("sample_id"), F.col("file"), F.col("start_line")).alias("unit_id"), S.claim(F.concat(F.lit("  The "), "stratum", F.lit("   Claim "))).alias("claim"))


@add("sc10_canonical_name", "SELECT DISTINCT name, lower(regexp_replace(name, '[-_.]+', '-', 'g')) AS canonical FROM {declared}")
def canonical_names(spark, sf):
    return relation(spark, sf, "declared").select("name", S.canonical_name(F.col("ecosystem"), F.col("name")).alias("canonical")).distinct()


@add("sc12_prefix", "SELECT seq, module, module = 'pkg1' OR starts_with(module, 'pkg1.') OR module = 'pkg2.sub2' OR starts_with(module, 'pkg2.sub2.') AS internal FROM {imports}")
def prefixes(spark, sf):
    return relation(spark, sf, "imports").select("seq", "module", S.internal_name(F.col("module"), ["pkg1", "pkg2.sub2"]).alias("internal"))


@add("sc13_path_match", "SELECT seq, regexp_matches(file, '^src/m1[^/]*(/.*)?$') OR regexp_matches(file, '^.*/f3\\.py(/.*)?$') AS excluded FROM {findings}")
def path_matches(spark, sf):
    return relation(spark, sf, "findings").select("seq", S.path_matches(F.col("file"), ["src/m1", "src/m10", "src/m11", "src/m12", "*/f3.py"]).alias("excluded"))


@add("sc14_vendored", "SELECT url, list_has_any(string_split(url, '/'), ['vendor', 'vendored', 'fr']) AS vendored FROM {pages}")
def vendored(spark, sf):
    url = F.regexp_replace("url", "/fr/", "/vendor/")
    return relation(spark, sf, "pages").select("url", S.vendored(url).alias("vendored"))


@add("sc15_unsafe_path", r"""SELECT seq, CASE WHEN p = '' THEN 'empty' WHEN contains(p, '\') THEN 'backslash' WHEN starts_with(p, '/') THEN 'absolute' WHEN regexp_matches(p, '^[A-Za-z]:') THEN 'drive'
  WHEN list_contains(string_split(p, '/'), '..') THEN 'parent' WHEN regexp_matches(lower(p), '(^|/)(con|prn|aux|nul|com[1-9]|lpt[1-9])([./]|$)') THEN 'device' END AS reason
FROM (SELECT seq, CASE seq % 8 WHEN 0 THEN '' WHEN 1 THEN file WHEN 2 THEN '/' || file WHEN 3 THEN 'C:/' || file WHEN 4 THEN '../' || file WHEN 5 THEN 'a/NUL.txt' WHEN 6 THEN 'a\b' ELSE 'x/..y/com' END AS p FROM {findings})""")
def unsafe_paths(spark, sf):
    made = F.expr(r"CASE seq % 8 WHEN 0 THEN '' WHEN 1 THEN file WHEN 2 THEN concat('/', file) WHEN 3 THEN concat('C:/', file) WHEN 4 THEN concat('../', file) WHEN 5 THEN 'a/NUL.txt' WHEN 6 THEN 'a\\b' ELSE 'x/..y/com' END")
    return relation(spark, sf, "findings").select("seq", S.unsafe_path(made).alias("reason"))


@add("sc16_joined_path", "SELECT seq, CASE WHEN project_root IN ('p0', 'p1') THEN file ELSE project_root || '/' || file END AS path FROM {findings}")
def joined_paths(spark, sf):
    root = F.expr("CASE project_root WHEN 'p0' THEN '' WHEN 'p1' THEN '.' ELSE project_root END")
    return relation(spark, sf, "findings").select("seq", S.joined_path(root, F.col("file")).alias("path"))


LEVEL = "CASE WHEN level IS NOT NULL THEN CASE WHEN level IN ('error', 'warning', 'note') THEN level END ELSE CASE severity WHEN 'red' THEN 'error' WHEN 'yellow' THEN 'warning' WHEN 'blue' THEN 'note' END END"


@add("sc17_level", f"SELECT seq, {LEVEL} AS level FROM {{findings}}")
def levels(spark, sf):
    return relation(spark, sf, "findings").select("seq", S.level_of(F.col("level"), F.col("severity")).alias("level"))


@add("sc18_gate_action", f"""SELECT seq, lv AS level, CASE WHEN lv = 'error' AND precision = 'heuristic' THEN 'review' WHEN lv = 'error' THEN 'block' WHEN lv = 'warning' THEN 'review' WHEN lv = 'note' THEN 'informational' ELSE 'review' END AS action
FROM (SELECT *, CASE rule_id WHEN 'P007' THEN 'warning' WHEN 'H001' THEN 'note' ELSE {LEVEL} END AS lv FROM {{findings}})""")
def gate_actions(spark, sf):
    lv = S.effective_level(F.col("rule_id"), S.level_of(F.col("level"), F.col("severity")), {"P007": "warning", "H001": "note"})
    rows = relation(spark, sf, "findings").withColumn("level", lv)
    return rows.select("seq", "level", S.gate_action(F.col("level"), F.col("precision")).alias("action"))


@add("sc19_age_days", "SELECT o_orderkey, CAST(floor((epoch(TIMESTAMP '2000-01-01 12:00:00') - epoch(o_orderdate)) / 86400) AS BIGINT) AS age FROM orders")
def ages(spark, sf):
    return relation(spark, sf, "orders").select("o_orderkey", S.age_days(F.col("o_orderdate"), F.lit("2000-01-01 12:00:00").cast("timestamp")).cast("long").alias("age"))


@add("sc20_minors", "SELECT spec, minors FROM (VALUES ('>=3.9', [9, 10, 11, 12, 13]), ('>=3.9,<3.12', [9, 10, 11]), ('==3.10.*', [10]), ('~=3.11', [11, 12, 13]), ('<3', CAST([] AS INT[])), ('nonsense', NULL)) t(spec, minors)")
def minors(spark, sf):
    specs = spark.createDataFrame([(s,) for s in (">=3.9", ">=3.9,<3.12", "==3.10.*", "~=3.11", "<3", "nonsense")], "spec string")
    return specs.select("spec", S.allowed_minors(9, 13)("spec").alias("minors"))


@add("sc22_size_bucket", "SELECT sample_id, CASE WHEN bytes < 10000 THEN 'small' WHEN bytes < 40000 THEN 'medium' ELSE 'large' END AS bucket FROM {units}")
def buckets(spark, sf):
    return relation(spark, sf, "units").select("sample_id", S.size_bucket(F.col("bytes"), [10000, 40000], ["small", "medium", "large"]).alias("bucket"))


@add("sc23_ratio", "SELECT stratum, count(*) FILTER (bytes < 20000) AS numerator, count(*) FILTER (bytes > 90000) AS denominator, round_even(count(*) FILTER (bytes < 20000) / nullif(count(*) FILTER (bytes > 90000), 0), 4) AS value FROM {units} GROUP BY stratum")
def ratios(spark, sf):
    r = S.ratio(F.count_if(F.col("bytes") < 20000), F.count_if(F.col("bytes") > 90000)).alias("r")
    return relation(spark, sf, "units").groupBy("stratum").agg(r).select("stratum", "r.*")


@add("sc24_utf8_cut", "SELECT doc_id, CASE WHEN text IS NOT NULL THEN substr(text, 1, list_max(list_filter(range(0, 102), lambda k: strlen(substr(text, 1, k)) <= 101))) END AS cut FROM documents")
def utf8_cuts(spark, sf):
    return relation(spark, sf, "documents").select("doc_id", S.utf8_cut(F.col("text"), F.lit(101)).alias("cut"))


@add("sc25_display", """SELECT doc_id, line, CASE WHEN length(text) > 40 THEN rtrim(substr(text, 1, 39), ' ') || '…' ELSE text END AS shown, replace(replace(text, '\\', '\\\\'), '|', '\\|') AS cell FROM {lines}""")
def display(spark, sf):
    return relation(spark, sf, "lines").select("doc_id", "line", S.shown(F.col("text"), 40).alias("shown"), S.markdown_cell(F.col("text")).alias("cell"))
