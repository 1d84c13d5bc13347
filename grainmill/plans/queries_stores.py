"""Queries of the store, the coverage report, settings, rule files, the module graph and the rescan in batches.

Documents are put together from rows of the tables, sound and broken parts alike; the SQL judges the same rows without the documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.operators import coverage, modules, store
from grainmill.operators.graphs import shared_folder
from grainmill.plans.queries_scalars import with_print
from grainmill.plans.queries_scores import FP
from grainmill.plans.relations import duck, relation
from grainmill.sources import config, facts, files, manifests
from grainmill.streaming import incremental

QUERIES, SQL = {}, {}


def add(key, sql=None):
    def keep(f):
        QUERIES[key] = f
        if sql:
            SQL[key] = duck(sql)
        return f

    return keep


def scratch(spark, name: str) -> str:
    """A new folder below the shared one."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4()}"


# --- SNK05: reviews in five batches; the last is written but not committed, the third is broken off once and written again -------

REVIEWS = """SELECT concat('r', c_custkey % 300) AS key, CAST(c_custkey AS BIGINT) AS version, CASE c_custkey % 4 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'false_positive' WHEN 2 THEN 'uncertain' ELSE 'maybe' END AS decision,
  CASE WHEN c_custkey % 17 = 0 THEN concat(c_name, chr(7)) ELSE c_name END AS note, c_mktsegment AS updated_at, c_custkey % 5 AS part FROM {customer}"""
VALID = "decision <> 'maybe' AND version % 17 <> 0"


def stored(spark, sf) -> str:
    path = scratch(spark, "reviews")
    rows = spark.sql(REVIEWS, customer=relation(spark, sf, "customer"))
    part = lambda n: rows.filter(F.col("part") == n).drop("part")
    store.create(spark, path)
    for n in range(4):
        if n == 2:  # broken off before its end
            store.stage(part(n).filter("version % 2 = 0"), path, "review", f"b{n}")
        store.append(part(n), path, "review", f"b{n}")
    store.stage(part(4), path, "review", "b4")
    return path


@add("snk05_latest", f"SELECT key, max(version) AS version, arg_max(decision, version) AS decision, arg_max(note, version) AS note FROM ({REVIEWS}) WHERE part < 4 AND {VALID} GROUP BY key")
def latest(spark, sf):
    return store.latest(spark, stored(spark, sf), "review").select("key", "version", "decision", "note")


@add("snk05_rejected", f"SELECT key, version, part, decision = 'maybe' AS bad_decision, version % 17 = 0 AS bad_note FROM ({REVIEWS}) WHERE part < 4 AND NOT ({VALID})")
def refused(spark, sf):
    rows = store.rejected(spark, stored(spark, sf), "review")
    return rows.select("key", "version", F.substring("batch", 2, 9).cast("long").alias("part"), F.array_contains("problems", "decision").alias("bad_decision"), F.array_contains("problems", "note").alias("bad_note"))


# --- QS10: a report for each order ------------------------------------------------------------------------------------------------

SAID = "CASE k % 8 WHEN 0 THEN 'opengrep 1.2: success' WHEN 1 THEN 'x: partial (2 file errors)' WHEN 2 THEN 'failed (exit 2)' WHEN 3 THEN 'x 1: timed_out' WHEN 4 THEN 'not available' WHEN 5 THEN 'not attempted' WHEN 6 THEN 'a success story' ELSE '' END"
BASE = f"SELECT o_orderkey AS k, o_custkey AS c, o_custkey % 3 - 1 AS n1, o_orderkey % 2 AS n2, o_custkey % 4 AS tried, o_orderkey % 5 AS failed, o_custkey % 3 AS r_tried, (o_orderkey + o_custkey) % 3 AS r_failed, o_orderkey % 4 AS n_files, o_custkey % 3 AS n_errors, (o_orderkey + o_custkey) % 2 AS n_gaps, {SAID.replace('k %', 'o_orderkey %')} AS said FROM {{orders}}"
LISTED = "concat('[', array_join(transform(sequence(0, CAST({n} AS INT)), i -> CASE WHEN i = {n} THEN '7' ELSE concat('\"m', i, {more}, '\"') END), ', '), ']')"


def reports(spark, sf) -> DataFrame:
    """report_id, body: lists hold a 7 besides their texts, which doesn't count."""
    listed = lambda n, more="''": LISTED.replace("{n}", n).replace("{more}", more)
    projects = "CASE k % 6 WHEN 0 THEN '7' WHEN 1 THEN '[]' ELSE concat('[5, {\"language\": \"python\", \"file_count\": ', n1, '}, {\"language\": \"java\", \"findings\": [{\"rule_id\": \"R', c % 3, '\"}], \"file_count\": ', CASE WHEN k % 9 = 0 THEN '\"4\"' ELSE CAST(n2 AS STRING) END, '}]') END"
    rules = "concat('\"rule_attempted\": ', CASE k % 7 WHEN 0 THEN 'true' ELSE CAST(tried AS STRING) END, CASE k % 7 WHEN 1 THEN '' ELSE concat(', \"rule_failures\": ', failed) END, CASE k % 3 WHEN 0 THEN '' ELSE ', \"rule_errors\": [\"e\"]' END)"
    manifests = f"concat('\"manifest_files\": ', {listed('n_files')}, ', \"manifest_incomplete\": [], \"manifest_errors\": ', {listed('n_errors', chr(39) + ': odd' + chr(39))}, CASE WHEN k % 10 = 0 THEN '' ELSE concat(', \"include_gaps\": ', {listed('n_gaps')}) END)"
    parsing = f"concat('\"parse_error_files\": ', {listed('n_gaps')}, CASE WHEN k % 4 = 0 THEN ', \"skipped_files\": 0' ELSE ', \"skipped_files\": []' END)"
    body = f"concat('{{\"tool\": \"x\", \"projects\": ', {projects}, ', \"diagnostics\": ', CASE WHEN k % 13 = 0 THEN '[]' ELSE concat('{{', {rules}, ', \"registry_attempted\": ', r_tried, ', \"registry_failures\": ', r_failed, ', ', {manifests}, ', ', {parsing}, ', \"semgrep_status\": \"', said, '\"}}') END, CASE WHEN k % 11 = 0 THEN '' ELSE '}}' END)"
    # A report is many times its order: few bytes of orders are dealt to all tasks before reports are made of them.
    rows = spark.sql(BASE, orders=relation(spark, sf, "orders")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return rows.select(F.col("k").alias("report_id"), F.expr(body.replace("{{", "{").replace("}}", "}")).alias("body"))


OPEN, LOST = "k % 11 <> 0", "(k % 11 = 0 OR k % 13 = 0)"
TOTAL = "(CASE WHEN n1 > 0 THEN n1 ELSE 0 END + CASE WHEN k % 9 = 0 THEN 0 ELSE n2 END)"


@add("qs10_stages", f"""WITH b AS ({BASE}) SELECT k AS report_id, 'discovery' AS stage, CASE WHEN {OPEN} AND k % 6 > 1 THEN 'complete' ELSE 'not_recorded' END AS status, 0 AS n_issues FROM b
UNION ALL SELECT k, 'rules', s, CASE WHEN s = 'not_recorded' OR k % 3 = 0 THEN 0 ELSE 1 END FROM (SELECT *, CASE WHEN {LOST} OR k % 7 < 2 OR failed > tried OR tried = 0 THEN 'not_recorded' WHEN failed = tried THEN 'failed' WHEN failed > 0 THEN 'partial' WHEN k % 3 = 0 THEN 'not_recorded' ELSE 'complete' END AS s FROM b)
UNION ALL SELECT k, 'registry', CASE WHEN {LOST} OR r_failed > r_tried OR r_tried = 0 THEN 'not_recorded' WHEN r_failed = r_tried THEN 'failed' WHEN r_failed > 0 THEN 'partial' ELSE 'complete' END, 0 FROM b
UNION ALL SELECT k, 'manifests', s, CASE WHEN s = 'not_recorded' THEN 0 ELSE n_errors + n_gaps END FROM (SELECT *, CASE WHEN {LOST} OR k % 10 = 0 OR n_files = 0 THEN 'not_recorded' WHEN n_errors > 0 AND n_errors >= n_files THEN 'failed' WHEN n_errors + n_gaps > 0 THEN 'partial' ELSE 'complete' END AS s FROM b)
UNION ALL SELECT k, 'parsing', s, CASE WHEN s = 'not_recorded' THEN 0 ELSE n_gaps END FROM (SELECT *, CASE WHEN {LOST} OR k % 4 = 0 OR k % 6 < 2 OR {TOTAL} = 0 THEN 'not_recorded' WHEN n_gaps > 0 AND n_gaps >= {TOTAL} THEN 'failed' WHEN n_gaps > 0 THEN 'partial' ELSE 'complete' END AS s FROM b)
UNION ALL SELECT k, 'engine', CASE WHEN {LOST} OR k % 8 > 4 THEN 'not_recorded' WHEN k % 8 = 0 THEN 'complete' WHEN k % 8 = 1 THEN 'partial' WHEN k % 8 = 4 THEN 'unavailable' ELSE 'failed' END, 0 FROM b""")
def coverage_stages(spark, sf):
    return coverage.by_stage(reports(spark, sf)).select("report_id", "stage", "status", F.size("issues").cast("long").alias("n_issues"))


@add("qs10_document", f"""WITH b AS ({BASE}) SELECT k AS report_id, CASE WHEN {OPEN} THEN 'x' END AS tool, CASE WHEN {OPEN} AND k % 6 > 1 THEN 2 ELSE 0 END AS n_projects, CASE WHEN {LOST} OR k % 8 > 4 THEN 'not_recorded' WHEN k % 8 = 0 THEN 'complete' WHEN k % 8 = 1 THEN 'partial' WHEN k % 8 = 4 THEN 'unavailable' ELSE 'failed' END AS engine,
CASE WHEN {OPEN} AND k % 6 > 1 THEN concat('R', c % 3) END AS rule FROM b""")
def coverage_document(spark, sf):
    """The document read back."""
    at = lambda path: F.get_json_object("document", path)
    return coverage.document(reports(spark, sf)).select("report_id", at("$.provenance.tool").alias("tool"), F.json_array_length(at("$.projects")).cast("long").alias("n_projects"), at("$.stages[5].status").alias("engine"), at("$.rules[0].rule_id").alias("rule"))


# --- SRC17: a file of settings for each part ---------------------------------------------------------------------------------------

LINES = {
    "schema_version": ("p % 5", {0: "schema_version = 1", 1: "schema_version = 2", 2: "schema_version = 2", 3: "schema_version = 3"}),
    "complexity_threshold": ("p % 4", {1: "complexity_threshold = 15", 2: "complexity_threshold = 0", 3: "complexity_threshold = true"}),
    "exclude_paths": ("p % 3", {1: 'exclude_paths = ["gen/", "gen", " out "]', 2: 'exclude_paths = ["../x", "a//b", "/abs", 3]'}),
    "npm_roots": ("p % 7", {1: 'npm_roots = ["web"]', 2: 'npm_roots = ["w*b"]', 3: 'npm_roots = "web"'}),
    "odd": ("p % 19", {1: "secret_key = 1"}),
    "syntax": ("p % 17", {1: "odd = = 1"}),
    "internal_packages": ("p % 8", {1: '[internal_packages]\nnpm = ["@own/x", "@own/x"]', 2: '[internal_packages]\ncargo = ["x"]', 3: '[internal_packages]\nnpm = [" "]'}),
    "policy": ("p % 9", {1: '[policy]\nheuristic_errors = "block"', 2: '[policy]\nother = "x"', 3: '[policy]\nheuristic_errors = "s3cret"'}),
    "rule_levels": ("p % 6", {1: '[rule_levels]\nR001 = "note"', 2: '[rule_levels]\n"bad id" = "note"', 3: '[rule_levels]\nR001 = "fatal"'}),
}
SETTINGS = "SELECT p_partkey AS p, concat('proj', p_partkey, '/settings.toml') AS rel FROM {part}"
#: field, whether it is in the second version only, and the reasons by remainder.
WRONG = [
    ("complexity_threshold", "p % 4 > 1", "must be a whole number from 1 to 100"), ("exclude_paths", "p % 3 = 2", "a step upwards"), ("exclude_paths", "p % 3 = 2", "an empty step"), ("exclude_paths", "p % 3 = 2", "an absolute path"), ("exclude_paths", "p % 3 = 2", "must be a list of texts"),
    ("npm_roots", "p % 7 = 1 AND p % 2 = 1", "no such directory"), ("npm_roots", "p % 7 = 2", "a pattern"), ("npm_roots", "p % 7 = 3", "must be a list of texts"), ("internal_packages", "p % 8 = 2", "unknown ecosystem"), ("internal_packages", "p % 8 = 3", "must be lists of texts"),
    ("policy", "p % 5 > 0 AND p % 9 = 2", "unknown key"), ("policy", "p % 5 > 0 AND p % 9 = 3", "must be review or block"), ("rule_levels", "p % 5 > 0 AND p % 6 = 2", "invalid rule id"), ("rule_levels", "p % 5 > 0 AND p % 6 = 3", "must be error, warning or note"),
]
N_UNKNOWN = "(CASE WHEN p % 19 = 1 THEN 1 ELSE 0 END + CASE WHEN p % 5 = 0 AND p % 9 BETWEEN 1 AND 3 THEN 1 ELSE 0 END + CASE WHEN p % 5 = 0 AND p % 6 BETWEEN 1 AND 3 THEN 1 ELSE 0 END)"
PROBLEMS = "SELECT rel, '' AS field, 'syntax' AS reason FROM ({S}) WHERE p % 17 = 1 UNION ALL SELECT rel, 'schema_version', 'must be 1 or 2' FROM ({S}) WHERE p % 17 <> 1 AND p % 5 > 2 UNION ALL SELECT rel, '', concat({U}, ' unknown keys') FROM ({S}) WHERE p % 17 <> 1 AND p % 5 < 3 AND {U} > 0" + "".join(
    f" UNION ALL SELECT rel, '{field}', '{reason}' FROM ({{S}}) WHERE p % 17 <> 1 AND p % 5 < 3 AND {when}" for field, when, reason in WRONG
)
PROBLEMS = PROBLEMS.replace("{S}", SETTINGS).replace("{U}", N_UNKNOWN)


def setting_files(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Entries of the files, and the directories of their repositories."""
    rows = spark.sql(SETTINGS, part=relation(spark, sf, "part"))
    lines = [F.expr("CASE " + " ".join(f"WHEN {by} = {k} THEN '{text}'" for k, text in texts.items()) + " END") for by, texts in LINES.values()]
    texts = rows.select("rel", F.array_join(F.filter(F.array(*lines), lambda x: x.isNotNull()), "\n").alias("text"))
    folders = rows.filter("p % 2 = 0").select(F.expr("concat('proj', p)").alias("root"), F.lit("web").alias("folder"))
    return config.entries(texts), folders


@add("src17_problems", PROBLEMS)
def setting_problems(spark, sf):
    return config.setting_problems(*setting_files(spark, sf))


@add("src17_settings", f"""WITH s AS (SELECT * FROM ({SETTINGS}) WHERE rel NOT IN (SELECT rel FROM ({PROBLEMS})))
SELECT rel, 'complexity_threshold' AS key, NULL AS sub, NULL AS at, '15' AS text FROM s WHERE p % 4 = 1 UNION ALL SELECT rel, 'exclude_paths', '', v, t FROM s, (VALUES (0, 'gen'), (1, 'out')) x(v, t) WHERE p % 3 = 1 UNION ALL SELECT rel, 'npm_roots', '', 0, 'web' FROM s WHERE p % 7 = 1
UNION ALL SELECT rel, 'internal_packages', 'npm', 0, '@own/x' FROM s WHERE p % 8 = 1 UNION ALL SELECT rel, 'policy', 'heuristic_errors', NULL, 'block' FROM s WHERE p % 9 = 1 UNION ALL SELECT rel, 'rule_levels', 'R001', NULL, 'note' FROM s WHERE p % 6 = 1""")
def settings(spark, sf):
    found, folders = setting_files(spark, sf)
    return config.settings(found, config.setting_problems(found, folders))


# --- SRC20: five parts are the rules of a file -----------------------------------------------------------------------------------------

RULES = """SELECT p_partkey AS p, concat('rules', CAST(floor(p_partkey / 5) AS BIGINT), '.json') AS rel, CAST(p_partkey % 5 AS INT) AS pos, CASE WHEN p_partkey % 23 = 3 THEN 'same' ELSE concat('r', p_partkey) END AS id, CASE WHEN p_partkey % 31 = 1 THEN ' ' ELSE p_name END AS message,
  CASE WHEN p_partkey % 37 = 1 THEN 'FATAL' WHEN p_partkey % 2 = 0 THEN 'ERROR' ELSE 'INFO' END AS severity, CASE WHEN p_partkey % 41 = 1 THEN 'cobol' WHEN p_partkey % 3 = 0 THEN 'javascript' ELSE 'java' END AS lang, CASE WHEN p_partkey % 43 = 1 THEN 'maybe' ELSE 'exact' END AS prec,
  CASE WHEN p_partkey % 23 IN (2, 3) THEN 'same' ELSE concat('r', p_partkey) END AS named FROM {part}"""
FAULTS = """SELECT rel, pos, 'message' AS reason FROM ({R}) WHERE trim(message) = '' UNION ALL SELECT rel, pos, 'severity' FROM ({R}) WHERE severity = 'FATAL' UNION ALL SELECT rel, pos, 'languages' FROM ({R}) WHERE lang = 'cobol' UNION ALL SELECT rel, pos, 'precision' FROM ({R}) WHERE prec = 'maybe'
UNION ALL SELECT rel, max(pos), 'repeated id' FROM ({R}) GROUP BY rel, named HAVING count(*) > 1""".replace("{R}", RULES)


def rule_files(spark, sf) -> DataFrame:
    rows = spark.sql(RULES, part=relation(spark, sf, "part"))
    # Java comes twice, since languages count once.
    languages = F.when(F.col("lang") == "javascript", F.array(F.lit("typescript"), F.col("lang"))).otherwise(F.array("lang", F.lit("java")))
    rule = F.struct(F.col("named").alias("id"), "message", "severity", languages.alias("languages"), F.struct(F.col("prec").alias("own-precision")).alias("metadata"))
    # A file is the five rules of its number.
    whole = rows.groupBy("rel").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", rule.alias("rule")))), lambda x: x["rule"]).alias("rules"))
    return config.rules(whole.select("rel", F.to_json(F.struct("rules")).alias("text")))


@add("src20_problems", f'SELECT rel, CAST(pos AS INT) AS "at", reason FROM ({FAULTS})')
def rule_problems(spark, sf):
    return config.rule_problems(rule_files(spark, sf))


@add("src20_descriptors", f"""SELECT 'S:' || named AS rule_id, trim(message) AS title, CASE severity WHEN 'ERROR' THEN 'error' ELSE 'note' END AS level, prec AS precision, CASE lang WHEN 'javascript' THEN 'typescript' ELSE lang END AS language, rel FROM ({RULES}) WHERE rel NOT IN (SELECT rel FROM ({FAULTS}))""")
def descriptors(spark, sf):
    found = rule_files(spark, sf)
    return config.descriptors(found, config.rule_problems(found)).select("rule_id", "title", "level", "precision", F.array_join("languages", ",").alias("language"), "rel")


# --- SRC08: a setup.py for each part ---------------------------------------------------------------------------------------------------------

CALL = "setup(install_requires=['su_{n}>=1'])"
#: Texts, what they declare (name), and what they leave open.
SETUPS = [
    ("from setuptools import setup\nsetup(install_requires=['su_{n}>=1', *more()], extras_require={'x': ['sv.{n}']})\n", ["su-{n}", "sv-{n}"], ["install_requires is not literal"]),
    ("try:\n    from setuptools import setup\nexcept ImportError:\n    from distutils.core import setup\nresult = " + CALL + "\n", ["su-{n}"], []),
    ("if cond():\n    from setuptools import setup\nelse:\n    setup = print\n" + CALL + "\n", [], ["a call that may be setup or not"]),
    ("from setuptools import setup\ndef later():\n    " + CALL + "\nrun = lambda: " + CALL + "\n", [], ["no call of setup that can be told"]),
    ("from own import setup\n" + CALL + "\n", [], []),
    ("from setuptools import setup\nif not True:\n    setup(install_requires=['no_{n}'])\nelse:\n    " + CALL + "\n", ["su-{n}"], []),
    ("from setuptools import setup\nsetup = wrap(setup)\n" + CALL + "\n", [], ["no call of setup that can be told"]),
    ("import setuptools as st\nfor x in y:\n    pass\nst.setup(install_requires=('su_{n}',), tests_require=REQ, **more)\nHelper().setup(install_requires=['no_{n}'])\n", ["su-{n}"], ["tests_require is not literal", "arguments out of a table"]),
]
TOLD = ", ".join(f"({k}, '{name}', NULL)" for k, (_, names, _) in enumerate(SETUPS) for name in names) + ", " + ", ".join(f"({k}, NULL, 'incomplete: {what}')" for k, (_, _, odd) in enumerate(SETUPS) for what in odd)


@add("src08_setup_files", f"SELECT concat('proj', p_partkey, '/setup.py') AS rel, replace(name, 'KEY', CAST(p_partkey AS VARCHAR)) AS name, problem FROM part JOIN (VALUES {TOLD.replace('{n}', 'KEY')}) v(k, name, problem) ON k = p_partkey % {len(SETUPS)}")
def setup_files(spark, sf):
    variants = spark.createDataFrame([(k, text) for k, (text, _, _) in enumerate(SETUPS)], "k int, text string")
    rows = relation(spark, sf, "part").select("p_partkey", (F.col("p_partkey") % len(SETUPS)).cast("int").alias("k")).join(F.broadcast(variants), "k")
    texts = rows.select(F.concat(F.lit("proj"), "p_partkey", F.lit("/setup.py")).alias("rel"), F.replace("text", F.lit("{n}"), F.col("p_partkey").cast("string")).alias("text"))
    return manifests.declared_dependencies(texts).select("rel", "name", "problem")


# --- SRC06: requirements that take in others, half as far along; some as constraints, some themselves -------------------------------------

TAKEN = "SELECT c_custkey AS c, CAST(floor(c_custkey / 2) AS BIGINT) AS t, 'requirement' AS role FROM {customer} WHERE c_custkey % 3 < 2 UNION ALL SELECT c_custkey, CAST(floor(c_custkey / 3) AS BIGINT), 'constraint' FROM {customer} WHERE c_custkey % 4 = 0 UNION ALL SELECT c_custkey, c_custkey + 1, 'requirement' FROM {customer} WHERE c_custkey % 8 = 1"


@add("src06_closure", f"""WITH RECURSIVE e AS ({TAKEN}), r(root, node, role) AS (SELECT c_custkey, c_custkey, 'requirement' FROM {{customer}} UNION SELECT root, t, CASE WHEN r.role = 'constraint' THEN r.role ELSE e.role END FROM r JOIN e ON c = node)
SELECT concat('req', root, '.txt') AS root, concat('req', node, '.txt') AS rel, role FROM r""")
def requirement_closure(spark, sf):
    lines = F.when(F.col("role") == "constraint", F.concat(F.lit("--constraint=req"), "t", F.lit(".txt"))).otherwise(F.concat(F.lit("-rreq"), "t", F.lit(".txt")))
    taken = spark.sql(TAKEN, customer=relation(spark, sf, "customer")).groupBy("c").agg(F.array_join(F.collect_list(lines), "\n").alias("text"))
    own = relation(spark, sf, "customer").select(F.concat(F.lit("req"), "c_custkey", F.lit(".txt")).alias("rel"))
    includes = manifests.requirement_includes(taken.select(F.concat(F.lit("req"), "c", F.lit(".txt")).alias("rel"), "text"))
    return manifests.requirement_closure(own, includes).select("root", "rel", "role")


# --- N006: a module for each customer, in seven projects --------------------------------------------------------------------------------

FOLDER = "CASE c_custkey % 4 WHEN 0 THEN concat('app/r', c_custkey, '/page') WHEN 1 THEN concat('lib/m', c_custkey) WHEN 2 THEN concat('lib/c', c_custkey) ELSE concat('lib/d', c_custkey, '/index') END"
MODULES = f"SELECT c_custkey AS c, concat('proj', c_custkey % 7) AS root, {FOLDER} AS name, c_custkey % 4 = 2 AS marked FROM {{customer}}"
# Each names two others of its project, by alias or relatively; what is called m in lib may not be there.
NAMED = "CASE {t} % 4 WHEN 0 THEN concat('app/r', {t}, '/page') WHEN 3 THEN concat('lib/d', {t}) WHEN 2 THEN concat('lib/c', {t}) ELSE concat('lib/m', {t}) END"
FIRST, SECOND = "(c + 7 * (1 + c % 5))", "(c + 7 * (3 + c % 11))"


def module_tree(spark, sf) -> tuple[DataFrame, DataFrame]:
    rows = spark.sql(MODULES, customer=relation(spark, sf, "customer"))
    up = "CASE c % 4 WHEN 0 THEN '../../' WHEN 3 THEN '../../' ELSE '../' END"
    spec = lambda t: f"concat(CASE WHEN c % 3 = 0 THEN '@/' ELSE {up} END, {NAMED.replace('{t}', t)})"
    text = f"""concat(CASE WHEN marked THEN '"use client"' ELSE '// server' END, '\\nimport a from "', {spec(FIRST)}, '"\\nimport b from "', {spec(SECOND)}, '"\\nimport fs from "fs"\\nconst e = process.env.DB_PASS\\nexport default async function F() {{ return null }}\\nconst [s] = useState(0)\\nimport type T from "../x"\\n')"""
    found = rows.select(F.concat("root", F.lit("/"), "name", F.lit(".tsx")).alias("rel"), "root", F.expr(text.replace("{{", "{").replace("}}", "}")).alias("text"))
    aliases = rows.select("root").distinct().select("root", F.lit("@/").alias("prefix"), F.lit("./").alias("target"))
    return found, aliases


@add("n006_module_graph", f"""WITH RECURSIVE m AS (SELECT *, concat(root, '/', name, '.tsx') AS rel FROM ({MODULES})), links AS (SELECT a.rel AS src, b.rel AS dst, b.marked FROM m a JOIN m b ON b.c IN ({FIRST.replace('c', 'a.c')}, {SECOND.replace('c', 'a.c')})),
r(node, context) AS (SELECT rel, 'server' FROM m WHERE starts_with(name, 'app/') UNION SELECT dst, CASE WHEN marked THEN 'client' ELSE context END FROM r JOIN links ON src = node)
SELECT rel, kind, CAST(line AS INT) AS line FROM r JOIN m ON rel = node, (VALUES ('server', 'N006', 7), ('client', 'N004', 4), ('client', 'N002', 5), ('client', 'N005', 6)) h(ctx, kind, line) WHERE ctx = context AND NOT marked""")
def module_graph(spark, sf):
    found, aliases = module_tree(spark, sf)
    tree = found.select("rel", F.octet_length("text").cast("long").alias("length"), F.col("text").cast("binary").alias("content"))
    kinds = ["edge", "client", "N003", *(f"if-client {rule}" for rule in ("N002", "N004", "N005"))]
    return modules.context_findings(facts.extract(files.source_files(tree), kinds), found.select("rel", "root"), aliases).select("rel", "kind", "line")


# --- SS01: findings that arrive in six files, the run is broken off after three ------------------------------------------------------------

@add("ss01_rescan", f"""WITH a AS (SELECT {FP} AS fp, count(*) AS n FROM {{findings}} GROUP BY 1), b AS (SELECT {FP} AS fp, count(*) AS h FROM {{prior}} GROUP BY 1), s AS (SELECT fp, least(n, coalesce(h, 0)) AS kept, n FROM a LEFT JOIN b USING (fp))
SELECT fp, 'unchanged' AS state, kept AS n FROM s WHERE kept > 0 UNION ALL SELECT fp, 'new', n - kept FROM s WHERE n > kept""")
def rescan(spark, sf):
    """Counts of what is new and unchanged, over all batches; the second run goes on where the first one ended."""
    path = scratch(spark, "rescan")
    now = with_print(relation(spark, sf, "findings")).select("fp", "seq")
    prior = with_print(relation(spark, sf, "prior")).select("fp")
    for part in range(6):
        now.filter(F.col("seq") % 6 == part).coalesce(1).write.parquet(f"{path}/arrived/{part}")
        if part == 2:
            incremental.rescan_into(spark, f"{path}/arrived", "fp string, seq long", prior, path)
    incremental.rescan_into(spark, f"{path}/arrived", "fp string, seq long", prior, path)
    results = spark.read.schema("fp string, seq long, state string, batch long").parquet(f"{path}/results")
    return results.groupBy("fp", "state").agg(F.count("*").alias("n"))
