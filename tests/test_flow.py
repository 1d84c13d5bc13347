"""Rules of flow over small files: hits and clean pieces by language."""

import pytest

from grainmill.operators import flow
from grainmill.sources import syntax

ENDINGS = {"tsx": "tsx", "csharp": "cs", "java": "java", "python": "py"}
HEAD = 'import DOMPurify from "dompurify";\n'
CLEANER = 'export function clean(x: string) { if (!x) return ""; return DOMPurify.sanitize(x, {A: 1}); }\n'

#: Of each piece: rule, language, text, and the lines with hits.
PIECES = [
    # hooks under conditions
    ("R001", "tsx", "export function A({f}) {\n if (f) { const [a] = useState(1); }\n for (let i = 0; i < 2; i++) { useEffect(() => {}); }\n const v = f ? useMemo(() => 1, []) : 0;\n return <p>{v}</p>;\n}\n", [2, 3, 4]),
    ("R001", "tsx", "export function A({x}) {\n if (x) { run(() => { return 1; }); }\n const items = list.filter(i => { return i > 1; });\n const [v] = useState(0);\n return <p>{v}</p>;\n}\n", []),
    ("R001", "tsx", "export function A({f}) {\n const v = f && useMemo(() => 1, []);\n return <p>it's {v}</p>;\n}\n", [2]),
    ("R001", "tsx", "export function A({x}) {\n if (x) return null\n const [v] = React.useState<string>('a')\n return <p>{v}</p>\n}\n", [3]),
    ("R001", "tsx", "export function A({x}) {\n for (const y of x) { if (y) return null; }\n const [v] = useState(0);\n return v;\n}\n", []),
    ("R001", "tsx", "export function A() {\n try { useThing(); } catch (e) { go(e); }\n while (b) useThing();\n api.useState(); r.useState(); Hooks.useThing();\n return null;\n}\n", [2, 3]),
    ("R001", "tsx", "export function A() {\n const a = useA(); const s = '}'; // if (\n const t = `${s}{`;\n const b = useB();\n return a ?? b;\n}\n", []),
    # hooks in other functions
    ("R002", "tsx", "export function A() {\n useEffect(() => { const [x] = useState(0); }, []);\n return null;\n}\n", [2]),
    ("R002", "tsx", "export function A() {\n const [v, setV] = useState(0);\n useEffect(() => { setV(1); }, []);\n return null;\n}\n", []),
    ("R003", "tsx", "function load() {\n const [d] = useState(null);\n return d;\n}\nconst go = () => {\n useA();\n};\n", [2, 6]),
    ("R003", "tsx", "export function A() {\n return <button onClick={() => { const [v] = useState(0); }}>x, y</button>;\n}\n", [2]),
    ("R003", "tsx", "const A = memo(() => { const [v] = useState(0); return <b>{v}</b>; });\nconst B = React.forwardRef((p, r) => { const [v] = useState(0); return <input/>; });\nfunction useC() { return useState(1); }\n", []),
    ("R003", "tsx", "import { renderHook } from '@testing-library/react';\nit('x', () => { renderHook(() => useThing()); });\n", []),
    ("R003", "tsx", "import { other as renderHook } from '@testing-library/react';\nit('x', () => { renderHook(() => useThing()); });\n", [2]),
    ("R003", "tsx", "import { renderHook } from '@testing-library/react';\nfunction t(renderHook) { renderHook(() => useThing()); }\n", [2]),
    # dependency lists
    ("R004", "tsx", "export function A() {\n useEffect(() => { go(1, 2); });\n useEffect(() => { go(); }, []);\n return null;\n}\n", [2]),
    ("R005", "tsx", "export function A({q}: {q: string}) {\n const [n, setN] = useState(0);\n useEffect(() => { console.log(q, n); }, [q]);\n useEffect(() => { console.log(q, n); }, [q, n]);\n useEffect(() => { const [x] = useState(0); go(x); }, []);\n return null;\n}\n", [3]),
    ("R005", "tsx", "export function A({c}) {\n useEffect(() => { go(c.cost.x); }, [c.cost]);\n useEffect(() => { go(c?.cost); }, [c.cost]);\n useEffect(() => { go(c.cost); }, [c.other]);\n useEffect(() => { go(c[k]); }, [c.cost]);\n return null;\n}\n", [4, 5]),
    ("R005", "tsx", "export function A({c}) {\n useEffect(() => { [1].map(c => c.x); const d = {c: 1}; }, []);\n return null;\n}\n", []),
    # raw HTML
    ("R007", "tsx", "export function A({html}) {\n return <div dangerouslySetInnerHTML={{__html: html}} />;\n}\n", [2]),
    ("R007", "tsx", "const html = '<b>' + \"x\" + `y`;\nexport function A() {\n return <div><p dangerouslySetInnerHTML={{__html: \"<b>hi</b>\"}} /><p dangerouslySetInnerHTML={{__html: html}} /></div>;\n}\n", []),
    ("R007", "tsx", HEAD + "export function A({h}) {\n return <div dangerouslySetInnerHTML={{ __html: DOMPurify.sanitize(h) }} />;\n}\n", []),
    ("R007", "tsx", "const DOMPurify = { sanitize: (x) => x };\nexport function A({h}) {\n return <div dangerouslySetInnerHTML={{ __html: DOMPurify.sanitize(h) }} />;\n}\n", [3]),
    ("R007", "tsx", HEAD + CLEANER + "export function A({h}) {\n const c = React.useMemo(() => clean(h), [h]);\n return <div dangerouslySetInnerHTML={{ __html: c }} />;\n}\n", []),
    ("R007", "tsx", "function clean(x) { return x; }\nexport function A({h}) {\n const c = clean(h);\n return <div dangerouslySetInnerHTML={{ __html: c }} />;\n}\n", [4]),
    ("R007", "tsx", HEAD + "function clean(x) {\n if (x.length < 10) return x;\n return DOMPurify.sanitize(x);\n}\nconst A = ({h}) => <div dangerouslySetInnerHTML={{ __html: clean(h) }} />;\n", [6]),
    ("R007", "tsx", HEAD + "function A({h}) {\n let c = DOMPurify.sanitize(h);\n c = h;\n return <div dangerouslySetInnerHTML={{ __html: c }} />;\n}\n", [5]),
    # composed SQL
    ("SQL", "csharp", 'class A { async Task F(IDbConnection c, string t) {\n await c.ExecuteAsync(new CommandDefinition(\n  "SELECT a FROM b WHERE t = @T " +\n  "AND d = 1", new { T = t }));\n} }\n', []),
    ("SQL", "csharp", 'class A { async Task F(IDbConnection c, string n) {\n await c.ExecuteAsync(\n  "SELECT * FROM users WHERE name = \'" + n + "\'");\n var s = "delete from t where a = " + n;\n} }\n', [(3, "P005"), (4, "P004")]),
    ("SQL", "csharp", 'class A { const string T = "t"; static readonly string U = "select a from " + T;\n void F(IDbConnection c) { c.Execute("select a from b" + T + U); }\n}\n', []),
    ("SQL", "csharp", 'class A { void F(DbContext db, string t, int k) {\n db.Users.FromSqlInterpolated($"SELECT * FROM users WHERE id = {k}");\n db.Database.ExecuteSqlRaw($"DELETE FROM {t}");\n} }\n', [(3, "P005")]),
    ("SQL", "csharp", 'class A { async Task F(DbContext db) {\n foreach (var e in db.Model.GetEntityTypes()) {\n  var s = e.GetSchema() ?? "public"; var t = e.GetTableName();\n  var q = $"{s}.{t}";\n  await db.Database.ExecuteSqlRawAsync($"SELECT 1 FROM {q} WHERE 1=0;");\n } } }\n', []),
    ("SQL", "csharp", 'class A { async Task F(IDbConnection c, string[] z) {\n string S(string col) => z is null ? "TRUE" : $"{col} = ANY(@c)";\n var n = await c.ExecuteScalarAsync<long>($"SELECT COUNT(*) FROM t WHERE {S("Code")};");\n} }\n', []),
    ("SQL", "csharp", 'class A { async Task F(IDbConnection c, string u) {\n string S(string col) => $"{col} = ANY(@c)";\n var n = await c.ExecuteScalarAsync<long>($"SELECT COUNT(*) FROM t WHERE {S(u)};");\n} }\n', [(3, "P005")]),
    ("SQL", "csharp", 'class A { void F(DbContext db, string user) {\n string B(string u, object m) { return u; }\n db.Database.ExecuteSqlRaw($"DELETE FROM {B(user, db.Model)}");\n} }\n', [(3, "P005")]),
    ("SQL", "csharp", 'class A { void F(WebApplication app) {\n app.MapExecuteGet("/x", async (string v) => {\n  var sql = "SELECT * FROM t WHERE a = \'" + v + "\'";\n  await Helper.Send(sql);\n });\n} }\n', [(3, "P004")]),
    ("SQL", "java", 'class A {\n private static final String T = "t";\n void f(Statement st, String x) {\n  st.executeQuery("select a from " + T);\n  String q = "where b = " + x;\n  st.executeQuery("select a from t "\n    + q);\n  String done = "select a from t" + " where b = 1";\n }\n}\n', [(6, "P005")]),
    ("SQL", "python", 'T = "t"\ndef f(cur, x):\n    q = "where a = " + x\n    cur.execute("select a from t " + q)\n    cur.execute(f"select a from {T}")\n    cur.execute("select a from b where c = %s", (x,))\n    say("delete from t where a = %s" % x)\n    cur.execute("select a from {} where b".format(x))\n', [(4, "P005"), (7, "P004"), (8, "P005")]),
    ("SQL", "python", 'def f(cur, x):\n    for t in ("a", "b"):\n        cur.execute("delete from " + t)\n    u = "a" if x else "b"\n    cur.execute("delete from " + u)\n    u = x\n', [(5, "P005")]),
    ("SQL", "tsx", "const T = 't';\nasync function f(db, x) {\n await db.query(`select a from ${T}`);\n await db.query(`select a from t where b = ${x}`);\n say(`update your ${x} set`);\n}\n", [(4, "P005"), (5, "P004")]),
    # raw SQL of the model
    ("D003", "csharp", 'class A { void F(DbContext db, string user, object p) {\n var sql = GetSql(user);\n db.Database.ExecuteSqlRaw(sql);\n var own = "SELECT 1" + " FROM t WHERE x = @p";\n db.Database.ExecuteSqlRaw(own, (object?)p ?? DBNull.Value);\n db.Database.SqlQueryRaw<long>($"SELECT 1 FROM {user}").FirstOrDefaultAsync(ct);\n db.Database.SqlQueryRaw<Row>("""\n  SELECT a FROM "b" WHERE c = {0}\n  """, p).FirstOrDefaultAsync(ct);\n} }\n', [3, 6]),
]
RULES = {"R001": flow.conditional_hooks, "R002": flow.nested_hooks, "R003": flow.misplaced_hooks, "R004": flow.effects_without_list, "R005": flow.missing_dependencies, "R007": flow.raw_html, "D003": flow.raw_sql}


@pytest.fixture(scope="module")
def scanned(spark):
    rows = [(f"{rule}/f{k}.{ENDINGS[lang]}", lang, text.encode()) for k, (rule, lang, text, _) in enumerate(PIECES)]
    files = spark.createDataFrame([(*r, None) for r in rows], "rel string, language string, content binary, skipped string")
    return syntax.scan(files).cache()


@pytest.mark.parametrize("rule", [*RULES, "SQL"])
def test_hits_and_clean_pieces(scanned, rule):
    expected = {(f"{r}/f{k}.{ENDINGS[lang]}", hit) for k, (r, lang, _, hits) in enumerate(PIECES) for hit in hits if r == rule}
    if rule == "SQL":
        got = {(r.rel, (r.line, r.rule)) for r in flow.composed_sql(scanned).collect()}
    else:
        got = {(r.rel, r.line) for r in RULES[rule](scanned).collect()}
    assert {x for x in got if x[0].startswith(f"{rule}/")} == expected


def test_proofs_through_imports_belong_to_their_file(spark):
    use = "export function V({h}) {\n return <i dangerouslySetInnerHTML={{ __html: clean(h) }} />;\n}\n"
    rows = {
        "lib/safe.tsx": HEAD + CLEANER, "lib/evil.tsx": "export function clean(x) { return x; }\n",
        "app/a.tsx": "import { clean } from '@/lib/safe';\n" + use, "app/b.tsx": "import { clean } from '../lib/evil';\n" + use, "app/c.tsx": "import { clean as other } from '../lib/safe';\nimport { x as clean } from '../lib/safe';\n" + use,
        "app/d.tsx": "import { clean as c } from '../lib/safe';\n" + use.replace("clean(", "c("), "app/e.tsx": "import { clean } from 'safe-lib';\n" + use, "app/f.tsx": "import { clean } from '@/lib/safe';\nfunction V({h, clean}) {\n return <i dangerouslySetInnerHTML={{ __html: clean(h) }} />;\n}\n",
    }
    files = spark.createDataFrame([(rel, "tsx", text.encode(), None) for rel, text in rows.items()], "rel string, language string, content binary, skipped string")
    assert {r.rel for r in flow.raw_html(syntax.scan(files)).collect()} == {f"app/{x}.tsx" for x in "bcef"}


def test_odd_files(spark):
    rows = [("a.tsx", "tsx", b""), ("b.tsx", "tsx", None), ("c.tsx", "tsx", b"}}} ((( <a {b"), ("d.py", "python", b"def ("), ("e.cs", "csharp", b"\xff\xfe class {"), ("f.tsx", "tsx", b"(" * 20_000), ("g.java", "java", b"class A { void f() { x = a ? b : ; } }")]
    files = spark.createDataFrame([(*r, None) for r in rows], "rel string, language string, content binary, skipped string")
    assert flow.composed_sql(syntax.scan(files)).count() == 0 and flow.raw_html(syntax.scan(files)).count() == 0


def test_time_is_linear_in_the_file():
    import time

    def seconds(n):
        text = "".join(f"export function A{i}({{q}}) {{\n  const [n] = useState({i});\n  useEffect(() => {{ go(q, n, 'x' + q); }}, [q]);\n  return <p a={{q}}>{{n}}</p>;\n}}\n" for i in range(n))
        began = time.process_time()
        assert len(syntax.file_rows("a.tsx", "tsx", text.encode())) > 10 * n
        return time.process_time() - began

    seconds(100)
    assert seconds(4000) < 20 * max(seconds(400), 0.02)
