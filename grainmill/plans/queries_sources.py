"""Queries of source trees, manifests, syntax facts and rules, over trees whose files are put together from the tables.

A file is a sequence of pieces, one for each row of `events` (sources) or `part` (manifests), in the order of their ids;
which piece, depends on the row. Spark builds the files and parses them. The SQL never sees a parser: it places each
piece by the lines before it and says what the piece holds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.functions import scalars as S
from grainmill.operators import dependencies as D
from grainmill.operators import graphs as G
from grainmill.plans.relations import duck, relation
from grainmill.sources import facts, files, manifests

QUERIES, SQL = {}, {}
#: What is put into the SQL when the relations' names are resolved: fixture texts have braces of their own.
LATE = {"<<N>>": "'{n}'", "<<E>>": "'{e}'"}


def add(key, sql=None):
    def keep(f):
        QUERIES[key] = f
        if sql:
            SQL[key] = reduce(lambda text, part: text.replace(*part), LATE.items(), duck(sql))
        return f

    return keep


# Fixture: for each language the file's head and its pieces; a piece's text, then what is in it as (kind, line in the piece, name, detail).
# {n} is the row's id. An {e} in a detail is the piece's first line in the file plus the number behind it.
SOURCES = {
    "python": (".py", "", [
        ("import requests\nfrom yaml.loader import Loader as L{n}\n", [("import", 0, "requests", "requests"), ("import", 1, "yaml.loader", "yaml")]),
        ("def f{n}(a):\n    try:\n        return int(a)\n    except ValueError:\n        pass\n\n", [("P001", 3, "", ""), ("complexity", 0, "f{n}", "2"), ("unit", 0, "f{n}", "{e}4")]),
        ("# TODO: later {n}\nv{n} = 1  # fine\n", [("P007", 0, "", ""), ("comment", 0, "", "# TODO: later {n}"), ("comment", 1, "", "# fine")]),
        ("def q{n}(cur, t):\n    cur.execute('select a from ' + t)\n\n", [("complexity", 0, "q{n}", "1"), ("unit", 0, "q{n}", "{e}1")]),
        ("def g{n}(say, t):\n    say(f'delete from {t}')\n\n", [("complexity", 0, "g{n}", "1"), ("unit", 0, "g{n}", "{e}1")]),
        ("def h{n}(a):\n" + "".join(f"    if a == {i}:\n        a += 1\n" for i in range(11)) + "\n", [("complexity", 0, "h{n}", "12"), ("unit", 0, "h{n}", "{e}22")]),
        ("w{n} = md5(b'x')\n", [("S:weak-hash", 0, "", "")]),
        ("e{n} = eval(input())\nk{n} = pickle.loads(e{n})\n", [("S:python-eval-input", 0, "eval", ""), ("S:python-pickle-load", 1, "loads", "")]),
        ("def j{n}(cur):\n    cur.execute('select a from b')\n    '# TODO not a comment'\n\n", [("complexity", 0, "j{n}", "1"), ("unit", 0, "j{n}", "{e}2")]),
    ]),
    "java": (".java", "package own.app;\n", [
        ("import java.util.List;\nimport com.google.gson.Gson;\n", [("import", 0, "java.util.List", "java.util"), ("import", 1, "com.google.gson.Gson", "com.google.gson")]),
        ("public void a{n}(String s) {\n  if (s == \"x\") { go(); }\n}\n", [("J001", 1, "", ""), ("complexity", 0, "a{n}", "2"), ("unit", 0, "a{n}", "{e}2")]),
        ("public void b{n}() {\n  Scanner s = new Scanner(in);\n  try (Scanner t = new Scanner(in)) { go(t); }\n}\n", [("J002", 1, "Scanner", ""), ("complexity", 0, "b{n}", "1"), ("unit", 0, "b{n}", "{e}3")]),
        ("public void c{n}() {\n  try { go(); } catch (Exception e) { }\n}\n", [("P001", 1, "", ""), ("complexity", 0, "c{n}", "2"), ("unit", 0, "c{n}", "{e}2")]),
        ("public void e{n}(String t) {\n  Runtime.getRuntime().exec(\"rm \" + t);\n  Runtime.getRuntime().exec(\"ls\");\n}\n", [("S:java-runtime-exec-concat", 1, "", ""), ("complexity", 0, "e{n}", "1"), ("unit", 0, "e{n}", "{e}3")]),
        ("public void d{n}(String t) {\n  run(\"delete from t where a = \" + t);\n  // FIXME {n}\n}\n", [("P007", 2, "", ""), ("comment", 2, "", "// FIXME {n}"), ("complexity", 0, "d{n}", "1"), ("unit", 0, "d{n}", "{e}3")]),
    ]),
    "csharp": (".cs", "", [
        ("using System.Text;\nusing Newtonsoft.Json;\n", [("import", 0, "System.Text", "System.Text"), ("import", 1, "Newtonsoft.Json", "Newtonsoft.Json")]),
        ("public async void A{n}(int x) {\n  Go();\n}\n", [("D001", 0, "A{n}", ""), ("complexity", 0, "A{n}", "1"), ("unit", 0, "A{n}", "{e}2")]),
        ("public int B{n}() {\n  return LoadAsync(1).Result;\n}\n", [("D002", 1, "", ""), ("complexity", 0, "B{n}", "1"), ("unit", 0, "B{n}", "{e}2")]),
        ("public void C{n}(string t) {\n  db.FromSqlRaw($\"select a from {t}\");\n}\n", [("complexity", 0, "C{n}", "1"), ("unit", 0, "C{n}", "{e}2")]),
        ("public void E{n}(string t) {\n  cmd.Execute(\"delete from t where a = \" + t);\n  app.MapGet(\"/x/{n}\", go);\n}\n", [("endpoint", 2, "GET", "/x/{n}"), ("complexity", 0, "E{n}", "1"), ("unit", 0, "E{n}", "{e}3")]),
        ("public int G{n}() {\n  return LoadAsync(f(1), g(h(2))).Result + s.Result;\n}\n", [("D002", 1, "", ""), ("complexity", 0, "G{n}", "1"), ("unit", 0, "G{n}", "{e}2")]),
        ("public async void F{n}(object sender, EventArgs e) {\n  Go();\n}\n", [("complexity", 0, "F{n}", "1"), ("unit", 0, "F{n}", "{e}2")]),
    ]),
    "client": (".tsx", "'use client'\n", [
        ("import a{n} from './a'\nimport fs from 'fs'\n", [("edge", 0, "./a", ""), ("edge", 1, "fs", ""), ("import", 1, "fs", "fs"), ("N004", 1, "fs", "")]),
        ("const b{n} = process.env.DB_PASS;\n", [("N002", 0, "DB_PASS", "")]),
        ("const c{n} = process.env.NEXT_PUBLIC_API_KEY;\n", [("N001", 0, "NEXT_PUBLIC_API_KEY", "")]),
        ("export default async function D{n}() {\n  return null;\n}\n", [("N005", 0, "D{n}", ""), ("complexity", 0, "D{n}", "1"), ("unit", 0, "D{n}", "{e}2")]),
        ("function E{n}(p) {\n  if (p.a) {\n    useState(0);\n  }\n}\n", [("complexity", 0, "E{n}", "2"), ("unit", 0, "E{n}", "{e}4")]),
        ("const f{n} = xs.map((x, i) => <li key={i}>{x}</li>);\n", [("R006", 0, "i", "")]),
        ("function lower{n}() {\n  const [a] = useState(0);\n}\n", [("complexity", 0, "lower{n}", "1"), ("unit", 0, "lower{n}", "{e}2")]),
    ]),
    "server": (".tsx", "", [
        ("import b{n} from '@/lib/b'\nimport pg from '@x/pg/lib'\nimport type T{n} from './types'\n", [("edge", 0, "@/lib/b", ""), ("edge", 1, "@x/pg/lib", ""), ("import", 1, "@x/pg/lib", "@x/pg")]),
        ("const [s{n}] = useState(0);\n", [("N003", 0, "useState", "")]),
        ("const t{n} = process.env.DB_PASS;\n", []),
        ("const v{n} = child.exec(`rm ${x}`);\n", [("S:js-child-process-concat", 0, "", "")]),
    ]),
}
PICK = " ".join(f"WHEN {k} THEN '{name}'" for k, name in enumerate(SOURCES))
COUNTS = " ".join(f"WHEN {k} THEN event_id % {len(pieces)}" for k, (_, _, pieces) in enumerate(SOURCES.values()))
ENDINGS = " ".join(f"WHEN {k} THEN '{ending}'" for k, (ending, _, _) in enumerate(SOURCES.values()))
ROWS = f"""SELECT event_id, CASE user_id % 5 {PICK} END AS lang, CAST(CASE user_id % 5 {COUNTS} END AS INT) AS k,
  concat('proj', user_id % 7, '/', CASE WHEN user_id % 3 = 0 THEN 'src/' ELSE '' END, 'f', user_id, CASE user_id % 5 {ENDINGS} END) AS rel FROM {{events}}"""


def quoted(value) -> str:
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value).lower()


def values(rows) -> str:
    return ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows)


LATE["<<PIECES>>"] = values((lang, k, text, text.count("\n")) for lang, (_, _, pieces) in SOURCES.items() for k, (text, _) in enumerate(pieces))
LATE["<<HITS>>"] = values((lang, k, *hit) for lang, (_, _, pieces) in SOURCES.items() for k, (_, hits) in enumerate(pieces) for hit in hits)
LATE["<<HEADS>>"] = values((lang, head, head.count("\n")) for lang, (_, head, _) in SOURCES.items())
PLACED = f"""SELECT s.*, text, n_lines, head, head_lines + 1 + coalesce(sum(n_lines) OVER (PARTITION BY rel ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first
  FROM ({ROWS}) s JOIN (VALUES <<PIECES>>) p(lang, k, text, n_lines) USING (lang, k) JOIN (VALUES <<HEADS>>) h(lang, head, head_lines) USING (lang)"""
FOUND = f"""SELECT rel, lang, kind, CAST(first + off AS INT) AS line, replace(name, <<N>>, CAST(event_id AS VARCHAR)) AS name,
  CASE WHEN starts_with(detail, <<E>>) THEN CAST(first + CAST(substr(detail, 4) AS INT) AS VARCHAR) ELSE replace(detail, <<N>>, CAST(event_id AS VARCHAR)) END AS detail
  FROM ({PLACED}) JOIN (VALUES <<HITS>>) v(lang, k, kind, off, name, detail) USING (lang, k)"""
FILES = f"""SELECT rel, lang, any_value(head) || string_agg(replace(text, <<N>>, CAST(event_id AS VARCHAR)), '' ORDER BY event_id) AS content FROM ({PLACED}) GROUP BY rel, lang"""


def add_found(key, where, columns):
    """A query of facts beside its SQL over the fixture's placed pieces."""
    return add(key, f"SELECT {columns} FROM ({FOUND}) WHERE {where}")


def joined(rows: DataFrame, pieces: DataFrame, by: str) -> DataFrame:
    """(rel, lang, body): the pieces of each file, in order. A file's pieces are few: one user's events, one project's parts.

    Only ids and numbers of pieces are shuffled, to the session's number of partitions, since texts come in behind.
    """
    dealt = rows.select("rel", "lang", F.col(by).alias("id"), "k").repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "rel")
    found = dealt.groupBy("rel", "lang").agg(F.array_sort(F.collect_list(F.struct("id", "k"))).alias("own"))
    texts = pieces.groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("k", "text"))).alias("texts"))
    body = F.transform("own", lambda p: F.replace(F.col("texts")[p["k"]], F.lit("{n}"), p["id"].cast("string")))
    return found.join(F.broadcast(texts), "lang").select("rel", "lang", body.alias("parts"))


def source_tree(spark, sf) -> DataFrame:
    """rel, length, content of the sources; files too large to be read have no content here."""
    rows = spark.sql(ROWS, events=relation(spark, sf, "events"))
    pieces = spark.createDataFrame([(lang, k, text) for lang, (_, _, own) in SOURCES.items() for k, (text, _) in enumerate(own)], "lang string, k int, text string")
    heads = spark.createDataFrame([(lang, head) for lang, (_, head, _) in SOURCES.items()], "lang string, head string")
    body = joined(rows, pieces, "event_id").join(F.broadcast(heads), "lang").select("rel", F.concat("head", F.array_join("parts", "")).alias("content"))
    large = relation(spark, sf, "supplier").select(F.concat(F.lit("proj1/large"), "s_suppkey", F.lit(".py")).alias("rel"), (1_499_998 + F.col("s_suppkey") % 5).alias("length"), F.lit(None).cast("binary").alias("content"))
    return body.select("rel", F.octet_length("content").cast("long").alias("length"), F.col("content").cast("binary").alias("content")).union(large)


def all_facts(spark, sf, kinds=None) -> DataFrame:
    tree = source_tree(spark, sf).filter("content IS NOT NULL")
    return facts.extract(files.source_files(tree), kinds)


def of_kind(key, kinds, columns, where=None, langs=None, extra=None):
    """Registers a query of the facts of some kinds; columns: names."""
    names = ", ".join(columns)
    kind_list = ", ".join(quoted(k) for k in kinds)
    lang_list = f" AND lang IN ({', '.join(quoted(x) for x in langs)})" if langs else ""
    endings = sorted({SOURCES[x][0] for x in langs}) if langs else None

    @add_found(key, f"kind IN ({kind_list}){lang_list}" + (f" AND {where}" if where else ""), names)
    def query(spark, sf):
        found = all_facts(spark, sf, kinds)
        if endings:
            found = found.filter(reduce(lambda a, b: a | b, [F.endswith("rel", F.lit(e)) for e in endings]))
        return (extra(found) if extra else found).select(*columns)

    return query


of_kind("ext01_comments", ["comment"], ["rel", "line", "detail"])
of_kind("ext03_python_imports", ["import"], ["rel", "line", "name", "detail"], langs=["python"])
of_kind("ext04_java_imports", ["import"], ["rel", "line", "name", "detail"], langs=["java"])
of_kind("ext05_csharp_usings", ["import"], ["rel", "line", "name", "detail"], langs=["csharp"])
of_kind("ext06_typescript_imports", ["import"], ["rel", "line", "name", "detail"], langs=["client", "server"])
of_kind("ext09_units", ["unit"], ["rel", "line", "name", "detail"])
of_kind("ext10_complexity", ["complexity"], ["rel", "line", "name", "detail"])
of_kind("ext11_module_edges", ["edge"], ["rel", "line", "name"])
of_kind("ext12_endpoints", ["endpoint"], ["rel", "line", "name", "detail"])
of_kind("p001_empty_catch", ["P001"], ["rel", "line"])
of_kind("p006_too_complex", ["complexity"], ["rel", "line", "name", "detail"], where="CAST(detail AS INT) > 10", extra=facts.too_complex)
of_kind("p007_incomplete", ["P007"], ["rel", "line"])
for _rule in ("R006", "N002", "N003", "N004", "N005", "J001", "J002", "D001", "D002"):
    of_kind(f"{_rule.lower()}_hits", [_rule], ["rel", "line", "name"])
of_kind("n001_in_code", ["N001"], ["rel", "line", "name"])
of_kind("s_rules", ["S:weak-hash", "S:python-eval-input", "S:python-pickle-load", "S:js-child-process-concat", "S:java-runtime-exec-concat"], ["rel", "kind", "line", "name"])


@add("ext02_lines", f"SELECT rel, CAST(any_value(l) + sum(n) AS BIGINT) AS n_lines FROM (SELECT rel, length(head) - length(replace(head, chr(10), '')) AS l, n_lines AS n FROM ({PLACED})) GROUP BY rel")
def line_counts(spark, sf):
    return facts.source_lines(files.source_files(source_tree(spark, sf)).filter("content IS NOT NULL")).groupBy("rel").agg(F.count("*").alias("n_lines"))


@add("n006_server_path", f"""WITH RECURSIVE e AS (SELECT DISTINCT concat('proj', user_id % 7, '/f', user_id, '.tsx') AS rel, user_id FROM {{events}} WHERE user_id % 5 > 2 AND user_id % 3 <> 0),
links AS (SELECT a.rel AS src, b.rel AS dst FROM e a JOIN e b ON b.user_id IN (a.user_id * 2 + 1, a.user_id * 3 + 1)),
r(node, context) AS (SELECT rel, CASE WHEN user_id % 5 = 3 THEN 'client' ELSE 'server' END FROM e WHERE user_id < 40
  UNION SELECT dst, CASE WHEN user_id % 5 = 3 THEN 'client' ELSE context END FROM r JOIN links ON src = node JOIN e ON e.rel = dst)
SELECT f.rel, line, name FROM ({FOUND}) f WHERE kind = 'N003' AND rel IN (SELECT node FROM r WHERE context = 'server')""")
def server_path(spark, sf):
    """N003's hits in files that a server entry reaches as server code; boundaries are the files marked as client code."""
    own = relation(spark, sf, "events").select("user_id").distinct().filter("user_id % 5 > 2 AND user_id % 3 <> 0").select("user_id", F.expr("concat('proj', user_id % 7, '/f', user_id, '.tsx')").alias("rel"))
    steps = own.select(F.col("rel").alias("src"), F.explode(F.array(F.col("user_id") * 2 + 1, F.col("user_id") * 3 + 1)).alias("user_id"))
    edges = steps.join(own.withColumnRenamed("rel", "dst"), "user_id").select("src", "dst").distinct()
    found = all_facts(spark, sf, ["client", "N003"])
    return D.server_violations(found, own.filter("user_id < 40").select(F.col("rel").alias("node")), edges).select("rel", "line", "name")


# --- trees ---------------------------------------------------------------------------------------------------------------

# Fixture: for each manifest its name, head, separator and tail, and its pieces with what they declare: (name, ecosystem, skipped, looked up as, presence).
MANIFESTS = {
    "req": ("requirements.txt", "", "\n", "\n", [
        ("Pkg_{n}>=1.0 ; python_version > '3.8'  # why", [("pkg-{n}", "pypi", False, "", "definite")]),
        ("-e git+https://x.example/r#egg=Egg.{n}", [("egg-{n}", "pypi", True, "", "definite")]),
        ("# only a comment {n}", []),
        ("lib.{n} @ https://x.example/l{n}.whl", [("lib-{n}", "pypi", True, "", "definite")]),
        ("-r other{n}.txt", []),
    ]),
    "npm": ("package.json", '{"dependencies": {', ", ", '}, "devDependencies": {"lib-dev": "1"}}', [
        ('"lib-{n}": "^1.0"', [("lib-{n}", "npm", False, "", "definite")]),
        ('"@s/x{n}": "workspace:*"', [("@s/x{n}", "npm", True, "", "definite")]),
        ('"al{n}": "npm:real{n}@2.0"', [("al{n}", "npm", False, "real{n}", "definite")]),
    ]),
    "pom": ("pom.xml", "<project><dependencies>", "", "</dependencies></project>", [
        ("<dependency><groupId>g.{n}</groupId><artifactId>a</artifactId></dependency>", [("g.{n}:a", "maven", False, "", "definite")]),
        ("<dependency><groupId>h{n}</groupId><artifactId>${v}</artifactId></dependency>", [("h{n}:${v}", "maven", True, "", "definite")]),
    ]),
    "gradle": ("build.gradle", "dependencies {\n", "\n", "\n}\n", [("implementation 'g:a{n}:1.0'", [("g:a{n}", "maven", False, "", "definite")]), ("// nothing {n}", [])]),
    "toml": ("pyproject.toml", '[project]\nname = "x"\ndependencies = [', ", ", "]\n", [('"Tool_{n}>=2"', [("tool-{n}", "pypi", False, "", "definite")]), ('"t.{n}[x]"', [("t-{n}", "pypi", False, "", "definite")])]),
    "pipfile": ("Pipfile", "[packages]\n", "\n", "\n", [('flask{n} = "*"', [("flask{n}", "pypi", False, "", "definite")]), ('loc{n} = {path = "."}', [("loc{n}", "pypi", True, "", "definite")])]),
    "setup": ("setup.py", "from setuptools import setup\nsetup(install_requires=[", ", ", "])\n", [("'su_{n}>=1'", [("su-{n}", "pypi", False, "", "definite")])]),
    "msbuild": ("App.csproj", "<Project><ItemGroup>", "", "</ItemGroup></Project>", [
        ('<PackageReference Include="N.{n}" />', [("N.{n}", "nuget", False, "", "definite")]),
        ('<PackageReference Include="M.{n}" Condition="true" />', [("M.{n}", "nuget", False, "", "possible")]),
        ('<PackageReference Include="R.{n}" /><PackageReference Remove="R.{n}" />', []),
    ]),
    "packages": ("packages.config", "<packages>", "", "</packages>", [('<package id="P.{n}" version="1" />', [("P.{n}", "nuget", False, "", "definite")])]),
    "tsconfig": ("tsconfig.json", '{ // "note"\n"compilerOptions": {"paths": {', ", ", "}}}", [('"@a{n}/*": ["src/a{n}/*"]', [])]),
    "env": (".env.local", "", "\n", "\n", [("NEXT_PUBLIC_A{n}=x=y", []), ("no assignment {n}", [])]),
}
MANIFEST_ROWS = "SELECT p_partkey, p_partkey // 50 AS proj, m.lang, CAST(p_partkey % m.n AS INT) AS k, concat('proj', p_partkey // 50, '/', m.file) AS rel FROM part, (VALUES {0}) m(lang, file, n)".replace("{0}", values((name, own[0], len(own[4])) for name, own in MANIFESTS.items()))
LATE["<<DECLARED>>"] = values((lang, k, *d) for lang, own in MANIFESTS.items() for k, (_, found) in enumerate(own[4]) for d in found)


def manifest_texts(spark, sf) -> DataFrame:
    """rel, lang, text: one manifest of each kind in each project of fifty parts, so that projects grow with the table and files don't."""
    kinds = spark.createDataFrame([(name, own[0], len(own[4]), *own[1:4]) for name, own in MANIFESTS.items()], "lang string, file string, n int, head string, sep string, tail string")
    parts = relation(spark, sf, "part").select("p_partkey")
    # Eleven kinds of manifest: each part is a line in one of each.
    rows = parts.crossJoin(F.broadcast(kinds.select("lang", "file", "n"))).select("p_partkey", "lang", (F.col("p_partkey") % F.col("n")).cast("int").alias("k"), F.concat(F.lit("proj"), F.floor(F.col("p_partkey") / 50), F.lit("/"), "file").alias("rel"))
    pieces = spark.createDataFrame([(name, k, text) for name, own in MANIFESTS.items() for k, (text, _) in enumerate(own[4])], "lang string, k int, text string")
    whole = joined(rows, pieces, "p_partkey").join(F.broadcast(kinds.select("lang", "head", "sep", "tail")), "lang")
    return whole.select("rel", "lang", F.concat("head", F.expr("array_join(parts, sep)"), "tail").alias("text"))


DEPENDENCIES = f"""SELECT rel, replace(name, <<N>>, CAST(p_partkey AS VARCHAR)) AS name, ecosystem, skip_registry, replace(registry_name, <<N>>, CAST(p_partkey AS VARCHAR)) AS registry_name, presence
FROM ({MANIFEST_ROWS}) JOIN (VALUES <<DECLARED>>) v(lang, k, name, ecosystem, skip_registry, registry_name, presence) USING (lang, k) WHERE lang IN ({{langs}})
UNION ALL SELECT DISTINCT rel, 'lib-dev', 'npm', false, '', 'definite' FROM ({MANIFEST_ROWS}) WHERE lang = 'npm' AND lang IN ({{langs}})"""


def add_dependencies(key, *langs):
    @add(key, DEPENDENCIES.replace("{langs}", ", ".join(map(quoted, langs))))
    def query(spark, sf):
        texts = manifest_texts(spark, sf).filter(F.col("lang").isin(*langs)).select("rel", "text")
        return manifests.declared_dependencies(texts).select("rel", "name", "ecosystem", "skip_registry", "registry_name", "presence")

    return query


add_dependencies("src06_requirements", "req")
add_dependencies("src07_pyproject", "toml")
add_dependencies("src08_pipfile_setup", "pipfile", "setup")
add_dependencies("src09_package_json", "npm")
add_dependencies("src11_maven_gradle", "pom", "gradle")
add_dependencies("src12_msbuild", "msbuild")
add_dependencies("src13_packages_config", "packages")


@add("src06_includes", f"SELECT rel AS src, concat('proj', proj, '/other', p_partkey, '.txt') AS dst, 'requirement' AS role FROM ({MANIFEST_ROWS}) WHERE lang = 'req' AND k = 4")
def requirement_includes(spark, sf):
    return manifests.requirement_includes(manifest_texts(spark, sf).filter("lang = 'req'").select("rel", "text"))


@add("src10_aliases", f"SELECT rel, concat('@a', p_partkey, '/') AS prefix, concat('src/a', p_partkey, '/') AS target FROM ({MANIFEST_ROWS}) WHERE lang = 'tsconfig'")
def aliases(spark, sf):
    return manifests.tsconfig_aliases(manifest_texts(spark, sf).filter("lang = 'tsconfig'").select("rel", "text"))


@add("src14_env", f"SELECT rel, CAST(row_number() OVER (PARTITION BY rel ORDER BY p_partkey) AS INT) AS line, concat('NEXT_PUBLIC_A', p_partkey) AS name, 'x=y' AS value, k FROM ({MANIFEST_ROWS}) WHERE lang = 'env' QUALIFY k = 0")
def env(spark, sf):
    return manifests.env_lines(manifest_texts(spark, sf).filter("lang = 'env'").select("rel", "text")).withColumn("k", F.lit(0))


def tree(spark, sf) -> DataFrame:
    """rel, length, content of sources and manifests."""
    texts = manifest_texts(spark, sf).select("rel", F.octet_length("text").cast("long").alias("length"), F.col("text").cast("binary").alias("content"))
    return source_tree(spark, sf).union(texts)


LARGE = "SELECT concat('proj1/large', s_suppkey, '.py') AS rel, 1499998 + s_suppkey % 5 AS length FROM supplier"
LANGUAGE = "CASE WHEN lang IN ('client', 'server') THEN 'tsx' ELSE lang END"


@add("src02_sources", f"""SELECT rel, language, length, CASE WHEN length > 1500000 THEN 'exceeds byte cap' END AS skipped FROM (
SELECT rel, {LANGUAGE} AS language, octet_length(encode(content)) AS length FROM ({FILES}) UNION ALL SELECT rel, 'python', length FROM ({LARGE}) UNION ALL
SELECT rel, 'python', length(any_value(head)) + sum(length(text)) + 2 * (count(*) - 1) + length(any_value(tail)) FROM (SELECT rel, 'from setuptools import setup' || chr(10) || 'setup(install_requires=[' AS head, concat('''su_', p_partkey, '>=1''') AS text, '])' || chr(10) AS tail FROM ({MANIFEST_ROWS}) WHERE lang = 'setup') GROUP BY rel)""")
def sources(spark, sf):
    return files.source_files(tree(spark, sf)).select("rel", "language", "length", "skipped")


KIND_OF = "CASE WHEN lang IN ('req', 'toml', 'pipfile', 'setup') THEN 'python' WHEN lang = 'npm' THEN 'typescript' WHEN lang IN ('pom', 'gradle') THEN 'java' WHEN lang = 'msbuild' THEN 'csharp' END"
MANIFEST_FILES = f"SELECT rel, {KIND_OF} AS language FROM ({MANIFEST_ROWS}) WHERE {KIND_OF} IS NOT NULL GROUP BY ALL"


@add("src03_manifests", MANIFEST_FILES)
def manifest_files(spark, sf):
    return files.manifests(tree(spark, sf)).filter("skipped IS NULL").select("rel", "language")


FAMILY = "CASE WHEN lang IN ('client', 'server') THEN 'typescript' ELSE lang END"
SOME = "CAST(substr(rel, 5, strpos(rel, '/') - 5) AS INT) % 2 = 0"
SOURCE_ROOTS = f"SELECT DISTINCT {FAMILY} AS language, rel FROM ({ROWS}) UNION SELECT 'python', rel FROM ({LARGE}) UNION SELECT 'python', rel FROM ({MANIFEST_ROWS}) WHERE lang = 'setup' AND {SOME}"
ROOTS = f"SELECT DISTINCT language, split_part(rel, '/', 1) AS root FROM ({MANIFEST_FILES}) WHERE {SOME}"


def half_tree(spark, sf) -> DataFrame:
    """Manifests in the even projects only, so that the others fall to the repository's root."""
    return tree(spark, sf).filter(~F.regexp_replace("rel", "^.*/", "").isin(*[own[0] for own in MANIFESTS.values()]) | (F.regexp_extract("rel", r"^proj(\d+)/", 1).cast("int") % 2 == 0))


@add("src04_projects", f"SELECT * FROM ({ROOTS}) UNION SELECT language, '.' FROM ({SOURCE_ROOTS}) s WHERE NOT EXISTS (SELECT 1 FROM ({ROOTS}) r WHERE r.language = s.language AND starts_with(s.rel, r.root || '/'))")
def projects(spark, sf):
    return files.projects(half_tree(spark, sf)).select("language", "root")


@add("src05_project_files", f"SELECT s.rel, coalesce(r.root, '.') AS root FROM ({SOURCE_ROOTS}) s LEFT JOIN ({ROOTS}) r ON r.language = s.language AND starts_with(s.rel, r.root || '/')")
def project_files(spark, sf):
    whole = half_tree(spark, sf)
    return files.project_files(whole, files.projects(whole)).select("rel", "root")


@add("src22_audit_index", f"""SELECT rel, language, skipped FROM (SELECT DISTINCT rel, {FAMILY} AS language, NULL AS skipped FROM ({ROWS}) UNION ALL SELECT rel, 'python', CASE WHEN length > 1500000 THEN 'exceeds byte cap' END FROM ({LARGE})
UNION ALL SELECT DISTINCT rel, CASE lang WHEN 'setup' THEN 'python' ELSE 'manifest' END, NULL FROM ({MANIFEST_ROWS}) WHERE lang IN ('req', 'npm', 'pom', 'gradle', 'toml', 'setup'))""")
def audit_index(spark, sf):
    return files.audit_index(tree(spark, sf)).select("rel", "language", "skipped")


@add("ext07_local_names", f"""SELECT DISTINCT split_part(rel, '/', 1) AS root, CASE WHEN strpos(inner_rel, '/') > 0 THEN split_part(inner_rel, '/', 1) ELSE regexp_replace(inner_rel, '\\.py$', '') END AS name, 'module' AS kind
FROM (SELECT rel, regexp_replace(substr(rel, strpos(rel, '/') + 1), '^src/', '') AS inner_rel FROM (SELECT rel FROM ({ROWS}) WHERE lang = 'python' UNION SELECT rel FROM ({LARGE})))""")
def local_names(spark, sf):
    own = files.source_files(source_tree(spark, sf)).select("language", F.substring_index("rel", "/", 1).alias("root"), F.regexp_replace("rel", "^[^/]*/", "").alias("rel"))
    return files.local_names(own)


@add("ext08_frameworks", """WITH d AS (SELECT DISTINCT concat('p', p_partkey % 50) AS project_root, CASE p_partkey % 4 WHEN 0 THEN 'react' WHEN 1 THEN 'next' ELSE 'left-pad' END AS name FROM part), f AS (SELECT DISTINCT concat('p', s_suppkey % 50) AS project_root FROM supplier WHERE s_suppkey % 3 = 0)
SELECT project_root, name AS framework FROM d WHERE name = 'react' OR (name = 'next' AND project_root IN (SELECT project_root FROM f))""")
def framework_rows(spark, sf):
    declared = relation(spark, sf, "part").select(F.expr("concat('p', p_partkey % 50)").alias("project_root"), F.expr("CASE p_partkey % 4 WHEN 0 THEN 'react' WHEN 1 THEN 'next' ELSE 'left-pad' END").alias("name"))
    own = relation(spark, sf, "supplier").select(F.expr("concat('p', s_suppkey % 50)").alias("root"), F.expr("CASE s_suppkey % 3 WHEN 0 THEN 'src/app/x.tsx' ELSE 'src/lib/x.tsx' END").alias("rel"))
    return files.frameworks(declared, own)


# --- imports by ecosystem ------------------------------------------------------------------------------------------------

ECOSYSTEMS = """SELECT l_orderkey * 8 + l_linenumber AS seq, concat('p', l_orderkey % 60) AS project_root, CASE l_partkey % 4 WHEN 0 THEN 'pypi' WHEN 1 THEN 'npm' WHEN 2 THEN 'nuget' ELSE 'maven' END AS ecosystem,
  concat(CASE l_partkey % 4 WHEN 0 THEN 'Py_Mod.' WHEN 1 THEN 'lodash.' WHEN 2 THEN 'Newtonsoft.Json' ELSE 'org.lib' END, l_partkey % 90) AS name FROM {lineitem}"""
USED = """SELECT o_orderkey AS seq, concat('p', o_custkey % 60) AS project_root, concat(CASE o_orderkey % 4 WHEN 0 THEN 'py.mod.' WHEN 1 THEN 'lodash.' WHEN 2 THEN 'newtonsoft.json' ELSE 'org.lib' END, o_orderkey % 90, CASE o_orderkey % 3 WHEN 0 THEN '' ELSE '.Sub' END) AS module,
  concat(CASE o_orderkey % 4 WHEN 0 THEN 'py' WHEN 1 THEN 'lodash.' WHEN 2 THEN 'newtonsoft.json' ELSE 'org' END, o_orderkey % 90) AS top_level FROM {orders}"""


@add("jn01_ecosystems", f"""WITH d AS ({ECOSYSTEMS}), i AS ({USED}), k AS (SELECT i.project_root, i.seq, e AS ecosystem, array_to_string(string_split(module, '.')[1:n], '.') AS p FROM i, (VALUES ('pypi'), ('npm'), ('nuget'), ('maven')) v(e), range(1, 6) r(n) WHERE n <= len(string_split(module, '.')) UNION SELECT project_root, seq, e, top_level FROM i, (VALUES ('pypi'), ('npm'), ('nuget'), ('maven')) v(e)),
c AS (SELECT project_root, seq, ecosystem, CASE ecosystem WHEN 'pypi' THEN lower(regexp_replace(p, '[-_.]+', '-', 'g')) WHEN 'nuget' THEN lower(p) ELSE p END AS name FROM k)
SELECT c.project_root, c.seq, min(d.seq) AS dep_seq FROM c JOIN d ON d.project_root = c.project_root AND d.ecosystem = c.ecosystem AND CASE d.ecosystem WHEN 'pypi' THEN lower(regexp_replace(d.name, '[-_.]+', '-', 'g')) WHEN 'nuget' THEN lower(d.name) ELSE d.name END = c.name GROUP BY ALL""")
def by_ecosystem(spark, sf):
    """JN01, JN04: each import beside the declarations of its project, under the naming of their ecosystem."""
    return D.match_imports(spark.sql(USED, orders=relation(spark, sf, "orders")), spark.sql(ECOSYSTEMS, lineitem=relation(spark, sf, "lineitem")))
