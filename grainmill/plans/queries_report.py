"""Queries of reports and of the incremental forms."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from grainmill.operators import report as P
from grainmill.operators.graphs import shared_folder
from grainmill.plans.queries_scores import LEVELLED, PACKED, findings, packed, scores
from grainmill.plans.relations import duck, relation
from grainmill.streaming import incremental as N

QUERIES, SQL = {}, {}


def add(key, sql=None):
    def keep(f):
        QUERIES[key] = f
        if sql:
            SQL[key] = duck(sql)
        return f

    return keep


@add("snk01_report_json", f"SELECT p.project_root AS root, count(f.seq) AS n, coalesce(min(f.line), -1) AS first_line, coalesce(string_agg(concat_ws(':', f.file, f.line, f.rule_id, f.level), ' ' ORDER BY f.file, f.line, f.rule_id, f.level), '') AS listed FROM {{packages}} p LEFT JOIN {PACKED} f USING (project_root) GROUP BY 1")
def report_json(spark, sf):
    """Nested by project and taken apart again."""
    rows = P.nested(packed(spark, sf), scores(spark, sf))
    own = F.array_sort(F.transform("findings", lambda f: F.struct(f["file"].alias("a"), f["line"].alias("b"), f["rule_id"].alias("c"), f["level"].alias("d"))))
    listed = F.array_join(F.transform(own, lambda x: F.concat_ws(":", x["a"], x["b"].cast("string"), x["c"], x["d"])), " ")
    return rows.select("root", F.size("findings").cast("long").alias("n"), F.coalesce(F.array_min(F.transform("findings", lambda f: f["line"])), F.lit(-1)).alias("first_line"), listed.alias("listed"))


@add("snk03_sarif", f"""WITH c AS (SELECT 'H001' AS r UNION ALL SELECT 'P002' UNION ALL SELECT 'Z999'), k AS (SELECT r, 0 AS known FROM c UNION ALL SELECT DISTINCT rule_id, 1 FROM {{findings}} WHERE rule_id NOT IN (SELECT r FROM c)), i AS (SELECT r, CAST(row_number() OVER (ORDER BY known, r) - 1 AS INT) AS rule_index FROM k)
SELECT seq, rule_index, CASE WHEN level IN ('error', 'warning', 'note') THEN level ELSE 'warning' END AS level, project_root || '/' || file AS uri FROM {LEVELLED} JOIN i ON r = rule_id""")
def sarif(spark, sf):
    catalog = spark.createDataFrame([("H001", "a"), ("P002", "b"), ("Z999", "c")], "rule_id string, title string")
    rows = P.sarif_results(findings(spark, sf), catalog)
    return rows.select("seq", "rule_index", "level", F.get_json_object("result", "$.locations[0].physicalLocation.artifactLocation.uri").alias("uri"))


@add("snk02_markdown", f"SELECT seq, '| ' || concat_ws(' | ', coalesce(level, 'unclassified'), rule_id || CASE WHEN precision = 'heuristic' THEN '*' ELSE '' END, CASE WHEN line > 0 THEN file || ':' || line ELSE file END, trim(snippet)) || ' |' AS row FROM {LEVELLED}")
def markdown(spark, sf):
    return P.markdown_rows(findings(spark, sf)).select("seq", "row")


@add("ss02_windowed_counts", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def windowed(spark, sf):
    """The streaming expression over the whole table at once."""
    return N.windowed_counts(relation(spark, sf, "events").select("ts", "event_type"))


@add("ss01_stream_totals", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_totals(spark, sf):
    """A stream over the files of the table, run until all is read; its result table is the answer."""
    source = relation(spark, sf, "events")
    stream = spark.readStream.schema(source.schema).parquet(f"{sf}/events.parquet*").groupBy("event_type").agg(F.count("*").alias("n"))
    name = f"stream_totals_{uuid.uuid4().hex}"
    writer = stream.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True)
    writer.option("checkpointLocation", f"{shared_folder(spark)}/{name}").start().awaitTermination()
    return spark.table(name)
