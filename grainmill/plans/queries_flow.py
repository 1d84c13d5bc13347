"""Queries of the rules that follow scopes and names, over files put together from `orders`: a customer's orders are the pieces of a file.

Each rule has pieces with hits and pieces without; which piece an order is, depends on its key. The SQL never sees a parser: it
places each piece by the lines before it and says what the piece holds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.operators import flow
from grainmill.plans.queries_sources import joined, values
from grainmill.plans.relations import duck, relation
from grainmill.sources import files

QUERIES, SQL = {}, {}

# Fixture: for each language the ending, the head and the pieces; a piece's text, and what is in it as (rule, line in the piece, name, detail).
# {n} is the order's key.
FLOW = {
    "python": (".py", 'TABLE = "t"\n', [
        ("def a{n}(cur, x):\n    q = 'where a = ' + x\n    cur.execute('select a from t ' + q)\n", [("P005", 2, "cur.execute", "")]),
        ("def b{n}(cur, x):\n    cur.execute(f'select a from {TABLE}')\n    cur.execute('select a from b where c = %s', (x,))\n", []),
        ("def c{n}(say, x):\n    say('delete from t where a = %s' % x)\n    say('delete from {}'.format(x))\n", [("P004", 1, "", ""), ("P004", 2, "", "")]),
        ("def d{n}(cur):\n    for t in ('a', 'b'):\n        cur.execute('delete from ' + t)\n", []),
        ("def e{n}(cur, x):\n    u = 'a'\n    cur.execute('delete from ' + u)\n    u = x\n", [("P005", 2, "cur.execute", "")]),
    ]),
    "java": (".java", "class A {\nprivate static final String TABLE = \"t\";\n", [
        ("void a{n}(Statement st) {\n  st.executeQuery(\"select a from \" + TABLE);\n  String q = \"select a from t\" + \" where b = 1\";\n}\n", []),
        ("void b{n}(Statement st, String x) {\n  String q = \"where b = \" + x;\n  st.executeQuery(\"select a from t \"\n    + q);\n}\n", [("P005", 2, "st.executeQuery", "")]),
        ("void c{n}(String x) {\n  if (x == null) { say(\"delete from t where a = \" + x); }\n}\n", [("P004", 1, "", "")]),
        ("void d{n}(List<String> xs) {\n  xs.forEach(x -> say(\"update t set a = \" + x));\n  say(\"update your \" + xs);\n}\n", [("P004", 1, "", "")]),
    ]),
    "csharp": (".cs", "class A {\n", [
        ("async Task A{n}(IDbConnection c, string t) {\n  await c.ExecuteAsync(new CommandDefinition(\n    \"SELECT a FROM b WHERE t = @T \" +\n    \"AND d = 1\", new { T = t }));\n}\n", []),
        ("async Task B{n}(IDbConnection c, string x) {\n  await c.ExecuteAsync(\n    \"SELECT * FROM users WHERE name = '\" + x + \"'\");\n}\n", [("P005", 2, "c.ExecuteAsync", "")]),
        ("void C{n}(DbContext db, string t, int k) {\n  db.Users.FromSqlInterpolated($\"SELECT * FROM users WHERE id = {k}\");\n  db.Database.ExecuteSqlRaw($\"DELETE FROM {t}\");\n}\n", [("P005", 2, "db.Database.ExecuteSqlRaw", ""), ("D003", 2, "ExecuteSqlRaw", "")]),
        ("async Task D{n}(DbContext db) {\n  foreach (var e in db.Model.GetEntityTypes()) {\n    var s = e.GetSchema() ?? \"public\"; var t = e.GetTableName();\n    var q = $\"{s}.{t}\";\n    await db.Database.ExecuteSqlRawAsync($\"SELECT 1 FROM {q} WHERE 1=0;\");\n  }\n}\n", []),
        ("async Task E{n}(IDbConnection c, string[] z) {\n  string S(string col) => z is null ? \"TRUE\" : $\"{col} = ANY(@c)\";\n  var k = await c.ExecuteScalarAsync<long>($\"SELECT COUNT(*) FROM t WHERE {S(\"Code\")};\");\n}\n", []),
        ("async Task F{n}(IDbConnection c, string u) {\n  string S(string col) => $\"{col} = ANY(@c)\";\n  var k = await c.ExecuteScalarAsync<long>($\"SELECT COUNT(*) FROM t WHERE {S(u)};\");\n}\n", [("P005", 2, "c.ExecuteScalarAsync", "")]),
        ("void G{n}(WebApplication app) {\n  app.MapExecuteGet(\"/x\", async (string v) => {\n    var sql = \"SELECT * FROM t WHERE a = '\" + v + \"'\";\n    await Helper.Send(sql);\n  });\n}\n", [("P004", 2, "", "")]),
        ("void H{n}(DbContext db, string user, object p) {\n  var sql = GetSql(user);\n  db.Database.ExecuteSqlRaw(sql);\n  var own = \"SELECT 1\" + \" FROM t WHERE x = @p\";\n  db.Database.ExecuteSqlRaw(own, (object?)p ?? DBNull.Value);\n}\n", [("D003", 2, "ExecuteSqlRaw", "")]),
    ]),
    "tsx": (".tsx", "import DOMPurify from \"dompurify\";\nimport { renderHook } from '@testing-library/react';\nfunction clean(x: string) { if (!x) return \"\"; return DOMPurify.sanitize(x); }\n", [
        ("export function A{n}({f}: {f: boolean}) {\n  if (f) { const [a] = useState(1); }\n  for (let i = 0; i < 2; i++) { useEffect(() => {}, []); }\n  const v = f ? useMemo(() => 1, []) : 0;\n  return <p>{v}</p>;\n}\n", [("R001", 1, "useState", "under a condition"), ("R001", 2, "useEffect", "under a condition"), ("R001", 3, "useMemo", "under a condition")]),
        ("export function B{n}({x}) {\n  if (x) return null\n  const [v] = React.useState<string>('a')\n  return <p>{v}</p>\n}\n", [("R001", 2, "useState", "after an early return")]),
        ("export function C{n}({x}) {\n  if (x) { run(() => { return 1; }); }\n  const items = list.filter(i => { return i > 1; });\n  const [v] = useState(0);\n  api.useState();\n  return <p>{v}</p>;\n}\n", []),
        ("export function D{n}() {\n  useEffect(() => { const [x] = useState(0); }, []);\n  return null;\n}\n", [("R002", 1, "useState", "")]),
        ("export function E{n}() {\n  return <button onClick={() => { const [v] = useState(0); }}>don't</button>;\n}\n", [("R003", 1, "", "")]),
        ("const F{n} = memo(() => { const [v] = useState(0); return <b>{v}</b>; });\nit('x', () => { renderHook(() => useThing()); });\n", []),
        ("function load{n}() {\n  const [d] = useState(null);\n  return d;\n}\n", [("R003", 1, "load{n}", "")]),
        ("export function G{n}({q}) {\n  const [v, setV] = useState(0);\n  useEffect(() => { console.log(q, v); }, [q]);\n  useEffect(() => { console.log(q, v); }, [q, v]);\n  useEffect(() => { setV(1); });\n  return null;\n}\n", [("R005", 2, "v", ""), ("R004", 4, "useEffect", "")]),
        ("export function H{n}({c, d}) {\n  useEffect(() => { go(c.cost.x); }, [c.cost]);\n  useEffect(() => { go(c.cost, d[0]); }, [c.other]);\n  useEffect(() => { [1].map(c => c.x); }, []);\n  return null;\n}\n", [("R005", 2, "c, d", "")]),
        ("export function I{n}({html}) {\n  return <div dangerouslySetInnerHTML={{__html: html}} />;\n}\n", [("R007", 1, "", "")]),
        ("const html{n} = '<b>x</b>';\nexport function J{n}({h}) {\n  const c = React.useMemo(() => clean(h), [h]);\n  return <p><i dangerouslySetInnerHTML={{__html: html{n}}} /><i dangerouslySetInnerHTML={{ __html: c }} /><i dangerouslySetInnerHTML={{ __html: DOMPurify.sanitize(h) }} /></p>;\n}\n", []),
        ("function K{n}({h}) {\n  const DOMPurify = { sanitize: (x) => x };\n  return <div dangerouslySetInnerHTML={{ __html: DOMPurify.sanitize(h) }} />;\n}\n", [("R007", 2, "", "")]),
        ("async function l{n}(db, x) {\n  await db.query(`select a from t where b = ${x}`);\n}\n", [("P005", 1, "db.query", "")]),
    ]),
}
_CASE = lambda f: " ".join(f"WHEN {k} THEN {f(name, own)}" for k, (name, own) in enumerate(FLOW.items()))
ROWS = f"""SELECT o_orderkey, CASE o_custkey % 4 {_CASE(lambda name, own: f"'{name}'")} END AS lang, CAST(CASE o_custkey % 4 {_CASE(lambda name, own: f"o_orderkey % {len(own[2])}")} END AS INT) AS k,
  concat('proj', o_custkey % 7, '/f', o_custkey, CASE o_custkey % 4 {_CASE(lambda name, own: f"'{own[0]}'")} END) AS rel FROM {{orders}}"""
FOUND = f"""SELECT rel, rule, CAST(first + off AS INT) AS line, replace(name, <<N>>, CAST(o_orderkey AS VARCHAR)) AS name, detail FROM (
  SELECT s.*, head_lines + 1 + coalesce(sum(n_lines) OVER (PARTITION BY rel ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first
  FROM ({ROWS}) s JOIN (VALUES <<PIECES>>) p(lang, k, n_lines) USING (lang, k) JOIN (VALUES <<HEADS>>) h(lang, head_lines) USING (lang)) JOIN (VALUES <<HITS>>) v(lang, k, rule, off, name, detail) USING (lang, k)"""
LATE = {
    "<<N>>": "'{n}'",
    "<<PIECES>>": values((lang, k, text.count("\n")) for lang, (_, _, pieces) in FLOW.items() for k, (text, _) in enumerate(pieces)),
    "<<HEADS>>": values((lang, head.count("\n")) for lang, (_, head, _) in FLOW.items()),
    "<<HITS>>": values((lang, k, *hit) for lang, (_, _, pieces) in FLOW.items() for k, (_, hits) in enumerate(pieces) for hit in hits),
}


def flow_tree(spark, sf) -> DataFrame:
    """rel, length, content of the files."""
    rows = spark.sql(ROWS, orders=relation(spark, sf, "orders"))
    pieces = spark.createDataFrame([(lang, k, text) for lang, (_, _, own) in FLOW.items() for k, (text, _) in enumerate(own)], "lang string, k int, text string")
    heads = spark.createDataFrame([(lang, head) for lang, (_, head, _) in FLOW.items()], "lang string, head string")
    body = joined(rows, pieces, "o_orderkey").join(F.broadcast(heads), "lang").select("rel", F.concat("head", F.array_join("parts", "")).alias("content"))
    return body.select("rel", F.octet_length("content").cast("long").alias("length"), F.col("content").cast("binary").alias("content"))


def add(key, rule, columns):
    """A rule's hits: `columns` names them in SQL."""
    QUERIES[key] = lambda spark, sf: flow.of_files(files.source_files(flow_tree(spark, sf)), rule)
    SQL[key] = reduce(lambda text, part: text.replace(*part), LATE.items(), duck(f"SELECT {columns} FROM ({FOUND}) WHERE rule = '{rule}'"))


def add_sql(key, rule):
    """P004 or P005, which are told apart when all compositions of a line are known."""
    add(key, rule, "rel, line, name AS sink")
    QUERIES[key] = lambda spark, sf: flow.of_files(files.source_files(flow_tree(spark, sf)), "SQL").filter(F.col("rule") == rule).drop("rule")


add_sql("p004_composed_sql", "P004")
add_sql("p005_sql_sink", "P005")
add("r001_hits", "R001", "rel, line, name, detail")
add("r002_hits", "R002", "rel, line, name")
add("r003_hits", "R003", "rel, line, name")
add("r004_hits", "R004", "rel, line, name")
add("r005_hits", "R005", "rel, line, name")
add("r007_hits", "R007", "rel, line")
add("d003_hits", "D003", "rel, line, name")
