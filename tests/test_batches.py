"""What a task holds and how long it takes, when files are many or long."""

import time

import pyarrow as pa
import pytest

from grainmill.operators import flow
from grainmill.sources import batches, facts, syntax

FILES = "rel string, language string, content binary, skipped string"
TSX = "export function A{i}({{q}}) {{\n  const [n] = useState({i});\n  useEffect(() => {{ go(q, n, 'x' + q); }}, [q]);\n  if (q) {{ const [m] = useState(0); }}\n  return <i dangerouslySetInnerHTML={{{{__html: q}}}} />;\n}}\n"
CS = "async Task A{i}(IDbConnection c, string t) {{\n  var q = \"a = '\" + t + \"'\";\n  await c.ExecuteAsync(\"SELECT a FROM b WHERE \" + q);\n  db.ExecuteSqlRaw(q);\n}}\n"


def largest_batch(df):
    return max(r.n for r in df.mapInArrow(lambda got: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in got), "n long").collect())


@pytest.mark.parametrize("make, text, language", [(facts.extract, "# TODO: x\n" * 50, "python"), (syntax.scan, "f('a' + b)\n" * 50, "python")])
def test_rows_of_many_files_leave_python_in_small_batches(spark, make, text, language):
    """Before, one frame held what all files of a batch gave."""
    files = spark.range(1000, numPartitions=1).selectExpr("concat('f', id, '.py') AS rel", f"'{language}' AS language", f"CAST('{text.replace(chr(39), chr(92) + chr(39))}' AS BINARY) AS content", "CAST(NULL AS STRING) AS skipped")
    assert make(files).count() > 2 * batches.ROWS
    sizes = []
    for b in batches.in_batches(((i,) for i in range(2 * batches.ROWS + 5)), pa.schema([("i", pa.int64())])):
        sizes.append(b.num_rows)
    assert sizes == [batches.ROWS, batches.ROWS, 5]
    assert largest_batch(make(files)) <= batches.ROWS


def test_only_the_kinds_that_are_asked_for_leave_python(spark):
    files = spark.createDataFrame([("a.py", "python", b"# TODO: x\nimport y\ntry:\n    f()\nexcept E:\n    pass\n", None)], FILES)
    assert {r.kind for r in facts.extract(files, ["P001"]).collect()} == {"P001"}
    assert {r.kind for r in facts.extract(files).collect()} == {"comment", "P007", "import", "P001"}


def hits(rule, language, text):
    return list(flow.RULES[rule].judge(flow.File(row[1:] for row in syntax.file_rows("a", language, text.encode()))))


@pytest.mark.parametrize("rule, language, piece", [(r, "tsx", TSX) for r in ("R001", "R002", "R003", "R004", "R005", "R007")] + [("SQL", "csharp", CS), ("D003", "csharp", CS)])
def test_a_rule_is_linear_in_the_file(rule, language, piece):
    """Names that come again in each function met all their bindings in the file before."""

    def seconds(n):
        rows = [row[1:] for row in syntax.file_rows("a", language, "".join(piece.format(i=i) for i in range(n)).encode())]
        began = time.process_time()
        found = list(flow.RULES[rule].judge(flow.File(rows)))
        assert rule in ("R002", "R003", "R004") or len(found) == n
        return time.process_time() - began

    seconds(100)
    assert seconds(2000) < 10 * max(seconds(500), 0.02)


def test_files_and_rows_give_the_same_hits(spark):
    texts = {f"p/a{i}.tsx": ("tsx", TSX.format(i=i) * 2) for i in range(20)} | {f"p/b{i}.cs": ("csharp", CS.format(i=i)) for i in range(20)} | {"p/c.py": ("python", "def f(cur, x):\n    cur.execute('select a from ' + x)\n"), "p/d.java": ("java", "class A { }")}
    files = spark.createDataFrame([(rel, lang, text.encode(), None) for rel, (lang, text) in texts.items()], FILES).repartition(4)
    rows = syntax.scan(files).orderBy("id", "rel")
    for rule in flow.RULES:
        a, b = (sorted(map(tuple, df.collect())) for df in (flow.of_files(files, rule), flow.of_rows(rows, rule)))
        assert a == b and (a or rule in ("R002", "R003", "R004"))


def test_a_hook_called_in_python_is_no_error(spark):
    """Its call has no count of arguments; a cast of the empty text failed the task."""
    files = spark.createDataFrame([("a.py", "python", b"useEffect(f)\n", None)], FILES)
    assert flow.effects_without_list(syntax.scan(files)).count() == 0


@pytest.mark.parametrize("text, said", [("select a from b", True), ("selected from", False), ("select from", False), ("SELECT\na\nFROM\nb", True), ("x from select y", False), ("update t set a", True), ("update  set", False), ("insert  into", True), ("delete from", True), ("undelete from", False), ("select " * 50_000, False)])
def test_words_of_a_statement(text, said):
    assert flow._says_sql(text) is said


@pytest.mark.parametrize("rounds", [3, 9])
def test_files_are_parsed_once_however_long_the_graph(spark, rounds):
    """Before, each round of the graph parsed all files again."""
    from grainmill.operators import dependencies, modules

    counted = spark.sparkContext.accumulator(0)

    def once(got):
        for b in got:
            counted.add(b.num_rows)
            yield b

    kinds = [(f"p/f{k}.ts", "N003", 1, "useState", "") for k in range(rounds)] + [(f"p/f{k}.ts", "edge", 1, f"./f{k + 1}", "") for k in range(rounds - 1)]
    found = spark.createDataFrame(kinds, facts.SCHEMA).mapInArrow(once, facts.SCHEMA)
    steps = spark.createDataFrame([(f"p/f{k}.ts", f"p/f{k + 1}.ts") for k in range(rounds - 1)], "src string, dst string")
    assert dependencies.server_violations(found, spark.createDataFrame([("p/f0.ts",)], "node string"), steps).count() == rounds
    assert counted.value == len(kinds)
    files = spark.createDataFrame([(f"p/f{k}.ts", "p") for k in range(rounds)] + [("p/app/page.ts", "p")], "rel string, root string")
    more = spark.createDataFrame([*kinds, ("p/app/page.ts", "edge", 1, "../f0", "")], facts.SCHEMA).mapInArrow(once, facts.SCHEMA)
    counted.value = 0
    assert modules.context_findings(more, files, spark.createDataFrame([], "root string, prefix string, target string")).count() == rounds
    assert counted.value == len(kinds) + 1
