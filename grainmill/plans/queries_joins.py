"""Queries of the dependency audit (H…, JN…) and of ownership."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainmill.functions import scalars as S
from grainmill.operators import dependencies as D
from grainmill.operators import ownership as O
from grainmill.plans.relations import duck, relation

QUERIES, SQL = {}, {}


def add(key, sql=None):
    def keep(f):
        QUERIES[key] = f
        if sql:
            SQL[key] = duck(sql)
        return f

    return keep


CANON = "lower(regexp_replace({0}, '[-_.]+', '-', 'g'))"
CHECKABLE = f"""SELECT *, {CANON.format("coalesce(nullif(registry_name, ''), name)")} AS lookup_name
  FROM (SELECT *, row_number() OVER (PARTITION BY project_root, lower(name) ORDER BY seq, name, coalesce(registry_name, ''), coalesce(presence, 'definite'), ecosystem) AS k FROM {{declared}} WHERE NOT skip_registry) WHERE k = 1"""
STATUS = "CASE WHEN quarantined THEN 'H009' WHEN archived THEN 'H012' WHEN age_days < 90 AND downloads < CASE downloads_period WHEN 'total' THEN 1500 ELSE 500 END THEN 'H005' WHEN age_days < 90 THEN 'H006' END"
MATCHED = f"""SELECT k.project_root, k.seq, min(d.seq) AS dep_seq FROM (SELECT DISTINCT project_root, seq, {CANON.format("p")} AS k FROM (SELECT project_root, seq, array_to_string(string_split(module, '.')[1:n], '.') AS p
  FROM {{imports}} AS spelled, range(1, 9) r(n) WHERE n <= len(string_split(module, '.')) UNION ALL SELECT project_root, seq, top_level FROM {{imports}} AS named)) k
  JOIN (SELECT project_root, {CANON.format("name")} AS k, min(seq) AS seq FROM {{declared}} GROUP BY 1, 2) d ON d.project_root = k.project_root AND d.k = k.k GROUP BY ALL"""
EXTERNAL = f"""SELECT * FROM (SELECT i.*, row_number() OVER (PARTITION BY i.project_root, lower(top_level) ORDER BY i.seq) AS k FROM {{imports}} i
  WHERE NOT (module = 'pkg3' OR starts_with(module, 'pkg3.')) AND (i.project_root, i.seq) NOT IN (SELECT (m.project_root, m.seq) FROM ({MATCHED}) m)) WHERE k = 1"""


def imports_of(spark, sf):
    """Top levels by which some declarations are met: pkg7 is declared as Pkg_7 or pkg.7, canonically pkg-7."""
    return relation(spark, sf, "imports").withColumn("top_level", F.regexp_replace("top_level", "^pkg", "pkg-")).withColumn("module", F.regexp_replace("module", "^pkg", "pkg-"))


def q(text):
    """The same renaming in SQL."""
    return text.replace("{imports}", "(SELECT * REPLACE (replace(top_level, 'pkg', 'pkg-') AS top_level, regexp_replace(module, '^pkg', 'pkg-') AS module) FROM {imports})").replace("'pkg3", "'pkg-3")


@add("jn06_registry", f"""SELECT project_root, seq, lookup_name, CASE WHEN r.name IS NULL THEN 'not in the snapshot' ELSE r.error END AS error, r.is_there
FROM ({CHECKABLE}) c LEFT JOIN {{registry}} r ON r.name = c.lookup_name""")
def registry_facts(spark, sf):
    return D.with_registry(D.checkable(relation(spark, sf, "declared")), relation(spark, sf, "registry")).select("project_root", "seq", "lookup_name", "error", "is_there")


@add("h001_declared", f"""SELECT project_root, seq, name, rule_id FROM (SELECT c.project_root, c.seq, c.name, CASE WHEN r.name IS NULL OR error IS NOT NULL THEN 'H004'
  WHEN NOT is_there AND presence <> 'definite' THEN 'H007' WHEN NOT is_there THEN 'H001' ELSE {STATUS} END AS rule_id
FROM ({CHECKABLE}) c LEFT JOIN {{registry}} r ON r.name = c.lookup_name) WHERE rule_id IS NOT NULL""")
def declared_findings(spark, sf):
    return D.judge_declared(relation(spark, sf, "declared"), relation(spark, sf, "registry"))


@add("h010_private", f"""SELECT rule_id, count(*) AS n FROM (SELECT CASE WHEN r.name IS NULL OR error IS NOT NULL THEN 'H004' WHEN NOT is_there THEN 'H010' ELSE {STATUS} END AS rule_id
FROM ({CHECKABLE}) c LEFT JOIN {{registry}} r ON r.name = c.lookup_name) WHERE rule_id IS NOT NULL GROUP BY rule_id""")
def private_source(spark, sf):
    return D.judge_declared(relation(spark, sf, "declared"), relation(spark, sf, "registry"), "a private index is configured").groupBy("rule_id").agg(F.count("*").alias("n"))


@add("jn02_match_imports", q(MATCHED))
def matched(spark, sf):
    return D.match_imports(imports_of(spark, sf), relation(spark, sf, "declared"))


def externals(spark, sf):
    return D.externals(imports_of(spark, sf), relation(spark, sf, "declared"), S.under(F.col("module"), F.lit("pkg-3")))


@add("jn05_externals", q(f"SELECT project_root, seq, module, top_level FROM ({EXTERNAL})"))
def external_imports(spark, sf):
    return externals(spark, sf).select("project_root", "seq", "module", "top_level")


@add("jn07_judge_imports", q(f"""
WITH ext AS ({EXTERNAL}), cand AS (
  SELECT project_root, seq, 0 AS pos, top_level AS cand FROM ext WHERE seq % 4 <> 0 UNION ALL SELECT project_root, seq, 1, top_level || '0' FROM ext WHERE seq % 4 <> 0
), looked AS (SELECT c.*, r.*, CASE WHEN r.name IS NULL THEN 'x' ELSE r.error END AS err, {STATUS} AS status FROM cand c LEFT JOIN {{registry}} r ON r.name = c.cand),
best AS (SELECT project_root, seq, min(pos) FILTER (is_there AND err IS NULL) AS hit, bool_or(err IS NOT NULL) AS failed FROM looked GROUP BY ALL),
judged AS (SELECT e.project_root, e.seq, l.cand AS found_as, l.status, CASE WHEN e.seq % 4 = 0 THEN 'H007' WHEN hit IS NOT NULL THEN 'H002' WHEN failed THEN 'H004' WHEN e.seq % 3 = 0 THEN 'H008' ELSE 'H007' END AS rule_id
  FROM ext e LEFT JOIN best b USING (project_root, seq) LEFT JOIN looked l ON l.project_root = e.project_root AND l.seq = e.seq AND l.pos = b.hit)
SELECT project_root, seq, found_as, rule_id FROM judged UNION ALL SELECT project_root, seq, found_as, status FROM judged WHERE status IS NOT NULL"""))
def import_findings(spark, sf):
    cands = F.when(F.col("seq") % 4 != 0, F.array(F.col("top_level"), F.concat("top_level", F.lit("0")))).otherwise(F.array().cast("array<string>"))
    trust = F.when(F.col("seq") % 3 == 0, "exact").otherwise("heuristic")
    return D.judge_imports(externals(spark, sf), relation(spark, sf, "registry"), cands, trust)


@add("h003_offline", q(f"SELECT project_root, seq, 'H003' AS rule_id FROM ({CHECKABLE}) UNION ALL SELECT project_root, seq, 'H007' FROM ({EXTERNAL})"))
def offline(spark, sf):
    return D.offline(relation(spark, sf, "declared"), externals(spark, sf))


@add("jn08_providers", f"""SELECT DISTINCT project_root, name FROM {{declared}} d WHERE NOT EXISTS (SELECT 1 FROM ({CHECKABLE}) c JOIN {{registry}} r ON r.name = c.lookup_name
WHERE c.project_root = d.project_root AND c.name = d.name AND error IS NULL AND NOT is_there)""")
def providers(spark, sf):
    return D.providers(relation(spark, sf, "declared"), relation(spark, sf, "registry"))


@add("jn21_local_sources", f"""SELECT project_root, seq FROM {{declared}} d WHERE NOT EXISTS (SELECT 1 FROM {{declared}} l WHERE l.seq % 9 = 0 AND l.project_root = d.project_root AND {CANON.format("l.name")} = {CANON.format("d.name")})""")
def local_sources(spark, sf):
    declared = relation(spark, sf, "declared")
    local = declared.filter("seq % 9 = 0").select("project_root", S.canonical_name(F.col("ecosystem"), F.col("name")).alias("name"))
    return D.without_local_sources(declared, local).select("project_root", "seq")


@add("jn03_longest_prefix", """SELECT seq, i.module, c.prefix, c.coords FROM {imports} i LEFT JOIN LATERAL (
  SELECT * FROM (VALUES ('pkg1', 'g:one'), ('pkg1.sub1', 'g:one-one'), ('pkg2', 'g:two'), ('pkg1.sub1.Leaf', 'g:leaf'), ('pkg2.sub', 'g:none')) v(prefix, coords)
  WHERE i.module = prefix OR starts_with(i.module, prefix || '.') ORDER BY length(prefix) DESC LIMIT 1) c ON true""")
def longest(spark, sf):
    curated = spark.createDataFrame([("pkg1", "g:one"), ("pkg1.sub1", "g:one-one"), ("pkg2", "g:two"), ("pkg1.sub1.Leaf", "g:leaf"), ("pkg2.sub", "g:none")], "prefix string, coords string")
    return D.longest_prefix(relation(spark, sf, "imports").select("seq", "module"), F.broadcast(curated)).select("seq", "module", "prefix", "coords")


ROOTS = "SELECT 'src' AS root UNION ALL SELECT 'src/m1' UNION ALL SELECT 'src/m2' UNION ALL SELECT 'src/m12'"


@add("jn09_ownership", f"""SELECT seq, file, coalesce(CASE WHEN file = 'src/m3/f4.py' THEN 'exact' END, (SELECT max_by(root, length(root)) FROM ({ROOTS}) WHERE starts_with(file, root || '/')), 'repository') AS owner FROM {{findings}}""")
def ownership(spark, sf):
    roots = spark.createDataFrame([(r,) for r in ("src", "src/m1", "src/m2", "src/m12")], "root string")
    owned = spark.createDataFrame([("src/m3/f4.py", "exact")], "file string, root string")
    return O.assign(relation(spark, sf, "findings"), F.broadcast(owned), F.broadcast(roots)).select("seq", "file", "owner")


@add("jn10_range", """SELECT f.seq, u.sample_id FROM {findings} f JOIN {spans} u ON concat('f', f.seq) = u.file AND f.line BETWEEN u.start_line AND u.end_line""")
def ranges(spark, sf):
    f = relation(spark, sf, "findings").select("seq", "line", F.concat(F.lit("f"), F.col("seq")).alias("file"))
    return O.in_range(f, relation(spark, sf, "spans"), ["file"], "line", "start_line", "end_line").select("p.seq", "r.sample_id")


@add("jn12_overlap", """SELECT a.sample_id AS a, b.sample_id AS b FROM {spans} AS a JOIN {spans} AS b ON a.file = b.file AND a.start_line <= b.end_line AND b.start_line <= a.end_line AND a.side = 0 AND b.side = 1""")
def overlaps(spark, sf):
    u = relation(spark, sf, "spans")
    return O.overlapping(u.filter("side = 0"), u.filter("side = 1"), ["file"]).select(F.col("a.sample_id").alias("a"), F.col("b.sample_id").alias("b"))


@add("jn13_one_to_one", """SELECT sample_id, CASE WHEN nb IS NULL THEN 'missing' WHEN na IS NULL THEN 'stray' ELSE 'duplicate' END AS violation FROM
(SELECT sample_id, count(*) AS na FROM {answers} WHERE reviewer = 'a' OR label = 'uncertain' GROUP BY 1) FULL JOIN (SELECT sample_id, count(*) AS nb FROM {answers} WHERE reviewer = 'b' GROUP BY 1) USING (sample_id)
WHERE na IS NULL OR nb IS NULL OR na > 1 OR nb > 1""")
def one_to_one(spark, sf):
    a = relation(spark, sf, "answers")
    return O.one_to_one(a.filter("reviewer = 'a' OR label = 'uncertain'"), a.filter("reviewer = 'b'"), "sample_id")


@add("jn15_reviews", "SELECT f.seq, coalesce(r.status, 'unreviewed') AS status FROM {findings} f LEFT JOIN (SELECT finding_seq, arg_max(status, updated_at) AS status FROM {reviews} GROUP BY 1) r ON r.finding_seq = f.seq")
def reviewed(spark, sf):
    latest = relation(spark, sf, "reviews").groupBy(F.col("finding_seq").alias("seq")).agg(F.max_by("status", "updated_at").alias("status"))
    return relation(spark, sf, "findings").join(latest, "seq", "left").select("seq", F.coalesce("status", F.lit("unreviewed")).alias("status"))


@add("jn16_resolve", """WITH files AS (SELECT DISTINCT concat('m/', s_suppkey % 50, CASE s_suppkey % 3 WHEN 0 THEN '.ts' WHEN 1 THEN '.tsx' ELSE '/index.js' END) AS file FROM supplier),
specs AS (SELECT DISTINCT concat('s', c_custkey % 90) AS src, concat('m/', c_custkey % 70) AS spec FROM customer)
SELECT src, spec, dst FROM (SELECT src, spec, file AS dst, row_number() OVER (PARTITION BY src, spec ORDER BY rank) AS k FROM specs, (VALUES ('', 0), ('.ts', 1), ('.tsx', 2), ('/index.ts', 3), ('/index.js', 4)) e(ending, rank), files WHERE file = spec || ending) WHERE k = 1""")
def resolved(spark, sf):
    files = relation(spark, sf, "supplier").select(F.expr("concat('m/', s_suppkey % 50, CASE s_suppkey % 3 WHEN 0 THEN '.ts' WHEN 1 THEN '.tsx' ELSE '/index.js' END)").alias("file"))
    specs = relation(spark, sf, "customer").select(F.expr("concat('s', c_custkey % 90)").alias("src"), F.expr("concat('m/', c_custkey % 70)").alias("spec")).distinct()
    return O.resolve(specs, files, ["", ".ts", ".tsx", "/index.ts", "/index.js"])


@add("jn18_routes", """WITH r AS (SELECT concat('http:/', n_nationkey % 3, '/', n_name) AS route, concat('f', n_nationkey) AS rel FROM nation), l AS (SELECT DISTINCT concat('http:/', c_custkey % 3, '/', n_name, CASE WHEN c_custkey % 2 = 0 THEN '/x/y' ELSE 'z' END) AS literal FROM customer JOIN nation ON n_nationkey = c_nationkey)
SELECT literal, min(rel) AS rel FROM l JOIN r ON literal = route OR starts_with(literal, route || '/') GROUP BY literal""")
def routes(spark, sf):
    n = relation(spark, sf, "nation")
    r = n.select(F.expr("concat('http:/', n_nationkey % 3, '/', n_name)").alias("route"), F.expr("concat('f', n_nationkey)").alias("rel"))
    some = relation(spark, sf, "customer").join(n.select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey")
    lit = some.select(F.expr("concat('http:/', c_custkey % 3, '/', n_name, CASE WHEN c_custkey % 2 = 0 THEN '/x/y' ELSE 'z' END)").alias("literal")).distinct()
    return O.route_target(lit, r)


@add("jn19_legal_pairs", "SELECT p.project_root, q.id AS query_id FROM {projects} p JOIN (VALUES ('Q1', ['python', 'java']), ('Q2', ['typescript']), ('Q3', ['csharp'])) q(id, languages) ON list_contains(q.languages, p.language)")
def legal_pairs(spark, sf):
    queries = spark.createDataFrame([("Q1", ["python", "java"]), ("Q2", ["typescript"]), ("Q3", ["csharp"])], "id string, languages array<string>")
    exploded = queries.select(F.col("id").alias("query_id"), F.explode("languages").alias("language"))
    return relation(spark, sf, "projects").join(F.broadcast(exploded), "language").select("project_root", "query_id")


@add("jn20_project_of", f"SELECT DISTINCT file, (SELECT max_by(root, length(root)) FROM ({ROOTS}) WHERE starts_with(file, root || '/')) AS root FROM {{findings}}")
def project_of(spark, sf):
    roots = spark.createDataFrame([(r,) for r in ("src", "src/m1", "src/m2", "src/m12")], "root string")
    return O.deepest_root(relation(spark, sf, "findings"), F.broadcast(roots))


@add("jn14_coverage", """SELECT coalesce(l.rule_id, f.rule_id) AS rule_id, coalesce(l.n, 0) AS attempted, coalesce(f.n, 0) AS findings FROM (SELECT replace(rule_id, 'rule', 'R00') AS rule_id, CAST(sum(n) AS BIGINT) AS n FROM {ledger} WHERE event = 'attempted' GROUP BY 1) l
FULL JOIN (SELECT rule_id, count(*) AS n FROM {findings} GROUP BY 1) f ON f.rule_id = l.rule_id""")
def coverage(spark, sf):
    ledger = relation(spark, sf, "ledger").filter("event = 'attempted'").groupBy(F.regexp_replace("rule_id", "rule", "R00").alias("rule_id")).agg(F.sum("n").alias("attempted"))
    seen = relation(spark, sf, "findings").groupBy("rule_id").agg(F.count("*").alias("findings"))
    return ledger.join(seen, "rule_id", "full_outer").select("rule_id", F.coalesce("attempted", F.lit(0)).alias("attempted"), F.coalesce("findings", F.lit(0)).alias("findings"))
