"""Relations of the analysis, derived from the test tables by one SQL text for Spark and DuckDB.

The test tables hold no source code; each relation keeps the shape that an operator needs (duplicates, ties, nulls, empty
groups) and grows with the table it comes from. `{name}` stands for a table or another relation.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from grainmill.session import table

TABLES = frozenset("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split())

SQL = {
    "findings": """
        SELECT event_id AS seq, concat('p', user_id % 9) AS project_root, concat('src/m', user_id % 13, '/f', event_id % 17, '.py') AS file,
               CAST(event_id % 97 AS INT) AS line,
               CASE event_id % 8 WHEN 0 THEN 'H001' WHEN 1 THEN 'H002' WHEN 2 THEN 'P002' WHEN 3 THEN 'P003' WHEN 4 THEN 'P004' WHEN 5 THEN 'P007'
                    WHEN 6 THEN 'R001' ELSE 'S:weak-hash' END AS rule_id,
               CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warning' WHEN 'signup' THEN 'Warning' WHEN 'view' THEN 'note' ELSE NULL END AS level,
               CASE event_type WHEN 'error' THEN 'red' WHEN 'purchase' THEN 'yellow' WHEN 'signup' THEN 'yellow' ELSE 'blue' END AS severity,
               CASE WHEN event_id % 3 = 0 THEN 'heuristic' ELSE 'exact' END AS precision,
               CASE WHEN event_id % 11 = 0 THEN 'external' ELSE 'builtin' END AS engine,
               concat('Rule  ', event_id % 8, ' hit') AS title,
               CASE WHEN event_id % 19 = 0 THEN '   ' ELSE concat('  value', ' ', ' = ', user_id % 23, ' ') END AS snippet,
               CASE WHEN event_id % 4 = 0 THEN 'python' WHEN event_id % 4 = 1 THEN 'java' ELSE 'typescript' END AS language
        FROM {events}""",
    "prior": """
        SELECT seq, project_root, file, rule_id, engine, title, snippet FROM {findings} WHERE seq % 5 <> 0
        UNION ALL SELECT seq + 1000000, project_root, file, rule_id, engine, title, concat(snippet, '.') FROM {findings} WHERE seq % 50 = 0""",
    "projects": """
        SELECT concat('p', n_nationkey) AS project_root, CASE n_nationkey % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'java' ELSE 'typescript' END AS language,
               CAST(n_nationkey % 7 AS INT) AS file_count, n_nationkey AS seq
        FROM {nation}""",
    "packages": """
        SELECT concat('k', CAST(floor(event_id / 8) AS BIGINT)) AS project_root, min(CASE user_id % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'java' ELSE 'typescript' END) AS language,
               CAST(min(user_id % 7) AS INT) AS file_count, CAST(floor(event_id / 8) AS BIGINT) AS seq
        FROM {events} WHERE event_type <> 'view' GROUP BY 1, 4""",
    "spans": """
        SELECT concat('u', l_orderkey, '-', l_linenumber) AS sample_id, concat('f', l_orderkey) AS file, l_linenumber * 10 AS start_line,
               l_linenumber * 10 + CAST(floor(l_quantity) AS INT) AS end_line, l_partkey % 2 AS side
        FROM {lineitem}""",
    "registry": """
        SELECT 'pypi' AS ecosystem, concat('pkg-', p_partkey) AS name, p_partkey % 7 <> 0 AS is_there,
               CAST(p_partkey % 120 AS INT) AS age_days, CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE p_partkey * 13 % 3000 END AS downloads,
               CASE WHEN p_partkey % 2 = 0 THEN 'weekly' ELSE 'total' END AS downloads_period,
               p_partkey % 23 = 0 AS quarantined, p_partkey % 19 = 0 AS archived,
               CASE WHEN p_partkey % 29 = 0 THEN 'timeout' ELSE NULL END AS error
        FROM {part}""",
    "declared": """
        SELECT concat('p', l_orderkey % 40) AS project_root, l_orderkey * 8 + l_linenumber AS seq,
               CASE WHEN l_partkey % 2 = 0 THEN concat('Pkg_', l_partkey % 1000 + 1) ELSE concat('pkg.', l_partkey % 1000 + 1) END AS name,
               'pypi' AS ecosystem, 'requirements.txt' AS source_file, l_linenumber AS line,
               l_partkey % 31 = 0 AS skip_registry, CASE WHEN l_partkey % 37 = 0 THEN concat('pkg-', l_partkey % 100 + 1) ELSE '' END AS registry_name,
               CASE WHEN l_orderkey % 6 = 0 THEN 'possible' ELSE 'definite' END AS presence
        FROM {lineitem}""",
    "imports": """
        SELECT concat('p', o_custkey % 40) AS project_root, o_orderkey AS seq, concat('pkg', o_orderkey % 90, '.sub', o_orderkey % 5, '.Leaf') AS module,
               concat('src/f', o_orderkey % 20, '.py') AS file, CAST(o_orderkey % 200 AS INT) AS line, concat('pkg', o_orderkey % 90) AS top_level
        FROM {orders}""",
    "reviews": """
        SELECT c_custkey % 400 AS finding_seq, CASE c_custkey % 3 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'dismissed' ELSE 'uncertain' END AS status,
               c_custkey AS updated_at, c_name AS note FROM {customer}""",
    "edges": """
        SELECT concat('f', s_suppkey % 60) AS src, concat('f', (s_suppkey * 7 + 3) % 60) AS dst FROM {supplier}
        UNION SELECT concat('f', p_partkey % 60), concat('f', (p_partkey * 11 + 1) % 97) FROM {part}""",
    "answers": """
        SELECT concat('s', o_orderkey % 1500) AS sample_id, CASE WHEN o_custkey % 2 = 0 THEN 'a' ELSE 'b' END AS reviewer,
               min(CASE o_orderkey % 7 WHEN 0 THEN 'false_positive' WHEN 1 THEN 'uncertain' ELSE 'confirmed' END) AS label,
               min(concat('rule', o_custkey % 5)) AS rule_id, min(o_orderdate) AS at
        FROM {orders} GROUP BY 1, 2""",
    "units": """
        SELECT concat('u', l_orderkey, '-', l_linenumber) AS sample_id, concat('r', l_suppkey % 6) AS repo_id, l_shipdate AS at,
               concat('rule', l_partkey % 9) AS stratum, concat('f', l_partkey % 15) AS file, l_linenumber * 10 AS start_line,
               l_linenumber * 10 + CAST(floor(l_quantity) AS INT) AS end_line, CAST(floor(l_extendedprice) AS BIGINT) AS bytes
        FROM {lineitem}""",
    "ledger": """
        SELECT concat('p', o_custkey % 9) AS project_root, concat('rule', o_orderkey % 12) AS rule_id,
               CASE o_orderkey % 5 WHEN 0 THEN 'eligible' WHEN 1 THEN 'attempted' WHEN 2 THEN 'failed' WHEN 3 THEN 'blocked' ELSE 'skipped' END AS event,
               CAST(o_orderkey % 3 AS BIGINT) AS n
        FROM {orders} WHERE o_orderkey % 12 < 10 OR o_orderkey % 5 = 0""",
}

# The relation of lines is said in each engine's own words.
DUCK = {
    "lines": """
        SELECT doc_id, source, lang, line, text FROM (
          SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM {documents})""",
}
SPARK = {
    "lines": """
        SELECT doc_id, source, lang, CAST(pos + 1 AS BIGINT) AS line, text FROM (
          SELECT doc_id, source, lang, posexplode(split(text, '\\n', -1)) AS (pos, text) FROM {documents})""",
}
_NAME = re.compile(r"\{([a-z]\w*)\}")


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table or a relation; nothing is registered in the catalog."""
    if name in TABLES:
        return table(spark, sf_dir, name)
    text = SPARK.get(name) or SQL[name]
    return spark.sql(text, **{n: relation(spark, sf_dir, n) for n in dict.fromkeys(_NAME.findall(text))})


def duck(query: str) -> str:
    """The query for DuckDB: `{name}` of a relation becomes a WITH entry."""
    found: dict[str, str] = {}

    def need(text: str) -> str:
        for name in dict.fromkeys(_NAME.findall(text)):
            if name not in TABLES and name not in found:
                body = need(DUCK.get(name) or SQL[name])
                found[name] = body
        return _NAME.sub(lambda m: m.group(1) if m.group(1) in TABLES else f"r_{m.group(1)}", text)

    text = need(query).strip()
    ctes = [f"r_{name} AS ({body})" for name, body in found.items()]
    if not ctes:
        return text
    if text[:4].upper() == "WITH":
        rest = text[4:].lstrip()
        if rest[:9].upper() == "RECURSIVE":
            return "WITH RECURSIVE " + ", ".join([*ctes, rest[9:].lstrip()])
        return "WITH " + ", ".join([*ctes, rest])
    return "WITH " + ", ".join(ctes) + " " + text
