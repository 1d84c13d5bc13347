"""Queries of packs, replies and what is left of the inventory."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainmill.functions import scalars as S
from grainmill.operators import evidence as V
from grainmill.operators import explore as E
from grainmill.operators import ownership as O
from grainmill.operators import windows as W
from grainmill.plans.queries_scores import STATES, findings, states
from grainmill.plans.relations import duck, relation

QUERIES, SQL = {}, {}


def add(key, sql=None):
    def keep(f):
        QUERIES[key] = f
        if sql:
            SQL[key] = duck(sql)
        return f

    return keep


PIECES = "(SELECT source AS pack, doc_id AS rank, 'd' || doc_id AS file, line, text FROM {lines})"
KEPT = f"""kept AS (SELECT * FROM (SELECT *, sum(strlen(text) + 1) OVER (PARTITION BY pack, rank, file ORDER BY line ROWS UNBOUNDED PRECEDING) AS s FROM {PIECES}) WHERE s <= 2000),
fit AS (SELECT pack, rank, file FROM (SELECT *, sum(b) OVER (PARTITION BY pack ORDER BY rank, file ROWS UNBOUNDED PRECEDING) AS t FROM (SELECT pack, rank, file, sum(strlen(text) + 1) AS b FROM kept GROUP BY ALL)) WHERE t <= 12000)"""


def packs(spark, sf):
    pieces = relation(spark, sf, "lines").select(F.col("source").alias("pack"), F.col("doc_id").alias("rank"), F.concat(F.lit("d"), "doc_id").alias("file"), "line", "text")
    return V.assemble(pieces, 2000, 12000)


@add("ai03_pack", f"WITH {KEPT} SELECT pack, file, line FROM kept JOIN fit USING (pack, rank, file)")
def pack_lines(spark, sf):
    return packs(spark, sf).select("pack", "file", "line")


@add("ag25_digest", f"WITH {KEPT}, h AS (SELECT pack, rank, file, sha256(string_agg(text, chr(10) ORDER BY line)) AS h FROM kept JOIN fit USING (pack, rank, file) GROUP BY ALL) SELECT pack, sha256(string_agg(h, chr(10) ORDER BY rank)) AS digest FROM h GROUP BY pack")
def pack_digests(spark, sf):
    return V.digests(packs(spark, sf))


HINTS = "(VALUES ('Q1', 'token'), ('Q1', 'idiot'), ('Q2', 'the and'), ('Q2', 'http'), ('Q3', 'zzzz')) h(query, hint)"


@add("ai01_retrieve", f"SELECT query, doc_id, hints, evidence, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY hints DESC, evidence DESC, doc_id) AS rank FROM (SELECT query, doc_id, count(DISTINCT hint) AS hints, count(DISTINCT line) AS evidence FROM {{lines}} JOIN {HINTS} ON contains(lower(text), hint) GROUP BY ALL)) WHERE rank <= 12")
def retrieved(spark, sf):
    hints = spark.createDataFrame([("Q1", "token"), ("Q1", "idiot"), ("Q2", "the and"), ("Q2", "http"), ("Q3", "zzzz")], "query string, hint string")
    return V.retrieve(relation(spark, sf, "lines").select("doc_id", "line", "text"), hints, ["doc_id"], 12).select("query", "doc_id", "hints", "evidence", "rank")


# Each customer is a pack with a reply of two issues; every eleventh reply can't be read.
REPLIES = """SELECT c_custkey AS pack, CASE c_custkey % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'high' WHEN 2 THEN 'sure' ELSE 'medium' END AS said, c_custkey % 3 AS n, c_custkey % 5 + 1 AS a, c_custkey % 5 + 1 + c_custkey % 3 AS b, 8 + c_custkey % 4 AS c, 11 + c_custkey % 2 AS d,
  c_custkey % 11 = 0 AS broken, 3 + c_custkey % 4 AS first_end, 10 + c_custkey % 3 AS second_end FROM {customer}"""


@add("ai09_replies", f"""WITH r AS ({REPLIES}) SELECT pack, NULL AS issue, 'unreadable' AS problem FROM r WHERE broken
UNION ALL SELECT pack, 'i1', CASE WHEN said = 'sure' THEN 'confidence' WHEN n = 0 THEN 'no citation' WHEN b > first_end OR (n = 2 AND d > second_end) THEN 'citation outside' END FROM r WHERE NOT broken
UNION ALL SELECT pack, 'i2', CASE WHEN d > second_end THEN 'citation outside' END FROM r WHERE NOT broken""")
def replies(spark, sf):
    rows = spark.sql(REPLIES, customer=relation(spark, sf, "customer"))
    cite = lambda file, a, b: F.struct(F.lit(file).alias("file"), F.col(a).alias("a"), F.col(b).alias("b"))
    issue = lambda name, said, cited: F.struct(F.lit(name).alias("id"), F.lit("secret").alias("category"), said.alias("confidence"), cited.alias("citations"))
    body = F.to_json(F.struct(F.array(issue("i1", F.col("said"), F.slice(F.array(cite("f", "a", "b"), cite("g", "c", "d")), 1, F.col("n").cast("int"))), issue("i2", F.lit("high"), F.array(cite("g", "c", "d")))).alias("issues")))
    sent = rows.select("pack", F.explode(F.array(F.struct(F.lit("f").alias("file"), F.lit(1).alias("a"), F.col("first_end").alias("b")), F.struct(F.lit("g").alias("file"), F.lit(8).alias("a"), F.col("second_end").alias("b")))).alias("s")).select("pack", "s.*")
    return V.check_replies(rows.select("pack", F.when(F.col("broken"), F.substring(body, 1, 20)).otherwise(body).alias("body")), sent)


@add("ai07_verdicts", """SELECT c_custkey AS issue, CASE WHEN c_custkey % 4 = 0 THEN 'insufficient' WHEN c_custkey % 3 > 0 AND c_custkey % 5 = 0 THEN 'unsupported' WHEN c_custkey % 3 > 0 AND c_custkey % 2 = 0 THEN 'supported' ELSE 'insufficient' END AS verdict,
CASE WHEN c_custkey % 4 = 0 THEN 'no_evidence' WHEN c_custkey % 3 > 0 AND c_custkey % 5 = 0 THEN 'placeholder' WHEN c_custkey % 3 > 0 AND c_custkey % 2 = 0 THEN 'literal' ELSE 'unverified' END AS reason FROM customer""")
def verdicts(spark, sf):
    k = F.col("c_custkey")
    rows = relation(spark, sf, "customer").select(k.alias("issue"), F.when(k % 3 > 0, "secret").otherwise("route").alias("category"), (k % 4).alias("cites"), (k % 2 == 0).alias("literal"), (k % 5 == 0).alias("placeholder"))
    return V.verdicts(rows)


@add("ai10_limits", "SELECT o_custkey AS batch, CASE WHEN count(*) > 20 THEN 'too many units' WHEN sum(o_orderkey % 1000) > 9000 THEN 'too many tokens' WHEN o_custkey % 3 = 0 THEN 'no consent' END AS refused FROM orders GROUP BY o_custkey")
def limits(spark, sf):
    rows = relation(spark, sf, "orders").groupBy(F.col("o_custkey").alias("batch")).agg(F.count("*").alias("units"), F.sum(F.col("o_orderkey") % 1000).alias("tokens")).withColumn("consented", F.col("batch") % 3 != 0)
    return V.within_limits(rows, 20, 9000)


@add("gr06_trace", "SELECT seq FROM {imports} i WHERE seq % 4 = 0 OR concat(file, top_level) IN (SELECT concat(file, top_level) FROM {imports} WHERE seq % 97 = 0)")
def trace(spark, sf):
    i = relation(spark, sf, "imports")
    reads = i.select("seq", "file", F.col("top_level").alias("symbol"), F.lit("x").alias("home"), F.when(F.col("seq") % 4 == 0, "x").otherwise("y").alias("away"))
    return V.trace(reads, i.filter("seq % 97 = 0").select("file", F.col("top_level").alias("symbol")))


@add("jn11_candidates", "SELECT f.seq, list_sort(list_distinct(list(u.sample_id))) AS units FROM {findings} f JOIN {spans} u ON concat('f', f.seq) = u.file AND f.line BETWEEN u.start_line AND u.end_line GROUP BY f.seq")
def candidate_units(spark, sf):
    f = relation(spark, sf, "findings").select("seq", "line", F.concat(F.lit("f"), F.col("seq")).alias("file"))
    met = O.in_range(f, relation(spark, sf, "spans"), ["file"], "line", "start_line", "end_line")
    return met.groupBy(F.col("p.seq").alias("seq")).agg(F.sort_array(F.collect_set("r.sample_id")).alias("units"))


@add("wn06_first_per_name", "SELECT project_root, lower(name) AS k, min(seq) AS seq FROM {declared} GROUP BY 1, 2")
def first_per_name(spark, sf):
    from grainmill.operators.dependencies import first_per

    return first_per(relation(spark, sf, "declared").withColumn("k", F.lower("name")), ["project_root", "k"], ["seq"]).select("project_root", "k", "seq")


@add("wn08_order", "SELECT seq, row_number() OVER (ORDER BY file, line, rule_id, engine, seq) AS place FROM {findings}")
def canonical_order(spark, sf):
    return W.places(relation(spark, sf, "findings"), "file", ["line", "rule_id", "engine", "seq"]).select("seq", "place")


@add("wn09_sorted_page", f"SELECT seq FROM {STATES} ORDER BY rule_id DESC, project_root, file, line, seq LIMIT 15 OFFSET 30")
def sorted_page(spark, sf):
    spec = E.FilterSpec(sort="rule_id", descending=True, page=3, size=15)
    return E.page(states(spark, sf), spec).select("seq")


@add("wn10_page_clamp", "SELECT seq FROM {findings} WHERE line = 7 ORDER BY file, project_root, line, rule_id, seq LIMIT 25 OFFSET (SELECT 25 * ((count(*) - 1) // 25) FROM {findings} WHERE line = 7)")
def page_clamp(spark, sf):
    return E.page(relation(spark, sf, "findings").filter("line = 7"), E.FilterSpec(page=10**6, size=25)).select("seq")


@add("qs02_text", "SELECT seq FROM {findings} WHERE contains(lower(concat_ws(chr(10), title, file, rule_id, snippet, project_root, language, engine)), 'm1/f')")
def text_search(spark, sf):
    return E.filtered(relation(spark, sf, "findings"), E.FilterSpec(text="M1/F")).select("seq")


@add("qs05_baseline_filter", f"SELECT seq FROM {STATES} WHERE state = 'unchanged' AND line < 20")
def baseline_filter(spark, sf):
    return E.filtered(states(spark, sf), E.FilterSpec(baseline="existing")).filter("line < 20").select("seq")


@add("st06_union", "SELECT rule_id, count(*) AS n FROM (SELECT DISTINCT rule_id, file, line, title FROM (SELECT * FROM {findings} WHERE engine = 'builtin' UNION ALL SELECT * FROM {findings} WHERE seq % 2 = 0)) GROUP BY 1")
def union_engines(spark, sf):
    f = relation(spark, sf, "findings")
    both = f.filter("engine = 'builtin'").unionByName(f.filter("seq % 2 = 0")).select("rule_id", "file", "line", "title").dropDuplicates()
    return both.groupBy("rule_id").agg(F.count("*").alias("n"))


@add("sc11_registry_key", "SELECT seq, CASE seq % 3 WHEN 0 THEN lower(regexp_replace(name, '[-_.]+', '-', 'g')) WHEN 1 THEN lower(name) ELSE name END AS k FROM {declared}")
def registry_key(spark, sf):
    eco = F.expr("CASE seq % 3 WHEN 0 THEN 'pypi' WHEN 1 THEN 'nuget' ELSE 'npm' END")
    return relation(spark, sf, "declared").select("seq", S.canonical_name(eco, F.col("name")).alias("k"))


@add("snk06_library", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS k FROM orders WHERE o_orderstatus <> 'P') WHERE k <= 10")
def library(spark, sf):
    return W.top_per(relation(spark, sf, "orders").filter("o_orderstatus <> 'P'"), ["o_custkey"], [F.desc("o_orderkey")], 10).select("o_custkey", "o_orderkey")


@add("sc05_tree_redaction", r"""SELECT seq, concat('see token=***&line=', line, ' of ', file) AS title,
CASE seq % 3 WHEN 0 THEN concat('password: "***" # ', rule_id) WHEN 1 THEN concat('https://***@host', line, '/x') ELSE snippet END AS snippet FROM {findings}""")
def tree_redaction(spark, sf):
    """Values behind words, in quotes and in addresses go; what stands around them stays."""
    rows = findings(spark, sf).withColumn("title", F.expr("concat('see token=s', seq, '&line=', line, ' of ', file)"))
    rows = rows.withColumn("snippet", F.expr("""CASE seq % 3 WHEN 0 THEN concat('password: "p', seq, '" # ', rule_id) WHEN 1 THEN concat('https://u', seq, ':p@host', line, '/x') ELSE snippet END"""))
    return rows.select("seq", *S.redact_struct(["title", "snippet"]))
