"""Report documents: nested JSON, SARIF, Markdown; reading them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grainmill.functions.scalars import anchor, fingerprint, joined_path, markdown_cell, redact_struct, shown

FINDING = ("rule_id", "level", "title", "file", "line", "snippet", "detail", "language", "engine", "precision", "fingerprint", "gate_action", "baseline_state")
SCHEMA = (
    "tool STRING, version STRING, generated_at STRING, target STRING, projects ARRAY<STRUCT<language STRING, root STRING, file_count INT, score INT, "
    "findings ARRAY<STRUCT<" + ", ".join(f"{c} {'INT' if c == 'line' else 'STRING'}" for c in FINDING) + ">>>>"
)
SARIF_LEVELS = ("error", "warning", "note")


def nested(findings: DataFrame, projects: DataFrame) -> DataFrame:
    """SNK01: one row per project with its findings in order, every string redacted. Projects are the unit of the document; none is gathered with others."""
    strings = [c for c in FINDING if c != "line" and c in findings.columns]
    rows = findings.select("project_root", F.col("line").cast("int").alias("line"), *redact_struct(strings))
    have = [F.col(c).alias(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in FINDING]
    listed = rows.groupBy("project_root").agg(F.sort_array(F.collect_list(F.struct(F.struct("file", "line", "rule_id").alias("k"), F.struct(*have).alias("f")))).alias("fs"))
    return projects.join(listed, "project_root", "left").select(
        "language", F.col("project_root").alias("root"), F.col("file_count").cast("int").alias("file_count"), F.col("score").cast("int").alias("score"), F.transform(F.coalesce("fs", F.array().cast(listed.schema["fs"].dataType)), lambda x: x["f"]).alias("findings")
    )


def write_json(findings: DataFrame, projects: DataFrame, path: str) -> None:
    """SNK01: JSON lines, one project a line; written by tasks to a store that Spark reaches."""
    nested(findings, projects).write.mode("overwrite").json(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """SRC18, SRC19, QS01: the findings of a report (a document or JSON lines), flat with their project. A malformed document fails."""
    rows = spark.read.schema(SCHEMA).option("mode", "FAILFAST").option("multiLine", "true").json(path)
    return flatten(rows.select(F.explode("projects").alias("p")))


PROJECT = SCHEMA.split("projects ARRAY<STRUCT<", 1)[1].removesuffix(">>")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """What write_json has written: findings with their project. A malformed line fails."""
    rows = spark.read.schema(PROJECT).option("mode", "FAILFAST").json(path)
    return flatten(rows.select(F.struct(*rows.columns).alias("p")))


def baseline_counts(findings: DataFrame) -> DataFrame:
    """SRC18: (fp, n): the fingerprints of a report that was read, as a multiset; one that the report lacks is made anew."""
    made = fingerprint(*[F.coalesce(c, F.lit("")) for c in ("project_root", "file", "rule_id", "engine")], anchor(F.col("snippet"), F.col("title")))
    return findings.groupBy(F.coalesce("fingerprint", made).alias("fp")).agg(F.count("*").alias("n"))


def report_problems(reports: DataFrame, most_bytes: int = 25_000_000) -> DataFrame:
    """SRC19: (report_id, problem): why a report (body) isn't taken, or null. Only its shape is looked at: an object with a summary and a list of projects."""
    v = F.try_parse_json("body")
    kind = lambda path: F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")), F.lit(""))
    why = (
        F.when(F.col("body").isNull(), "nothing").when(F.octet_length("body") > most_bytes, "too large").when(v.isNull(), "no JSON").when(~F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), "no object")
        .when(~F.startswith(kind("$.summary"), F.lit("OBJECT")), "no summary").when(~F.startswith(kind("$.projects"), F.lit("ARRAY")), "no projects")
    )
    return reports.select("report_id", why.alias("problem"))


def flatten(rows: DataFrame) -> DataFrame:
    """QS01: project rows `p` to findings."""
    return rows.select(F.col("p.root").alias("project_root"), F.explode("p.findings").alias("f")).select("project_root", "f.*")


def sarif_results(findings: DataFrame, catalog: DataFrame) -> DataFrame:
    """SNK03: one row per finding: its SARIF result as JSON, with the index of its rule; unknown rules come behind the catalog in order of their id."""
    known = catalog.select("rule_id").distinct().withColumn("known", F.lit(0)).union(findings.select("rule_id").distinct().join(catalog.select("rule_id").distinct(), "rule_id", "left_anti").withColumn("known", F.lit(1)))
    # Rules are few: a catalog and what findings name besides it.
    ranked = known.withColumn("rule_index", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("known", "rule_id")) - 1)
    rows = findings.join(F.broadcast(ranked), "rule_id")
    level = F.when(F.col("level").isin(*SARIF_LEVELS), F.col("level")).otherwise("warning")
    region = F.when(F.col("line") > 0, F.struct(F.col("line").alias("startLine")))
    place = F.struct(F.struct(F.struct(joined_path(F.col("project_root"), F.col("file")).alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    result = F.struct(F.col("rule_id").alias("ruleId"), F.col("rule_index").alias("ruleIndex"), level.alias("level"), F.struct(F.col("title").alias("text")).alias("message"), F.array(place).alias("locations"))
    # What a baseline comparison has found goes along, where it is there.
    more = {"fp": F.struct(F.col("fp").alias("primary")).alias("partialFingerprints"), "state": F.col("state").alias("baselineState")} if "fp" in rows.columns else {}
    result = F.struct(*[result[f].alias(f) for f in ("ruleId", "ruleIndex", "level", "message", "locations")], *[c for name, c in more.items() if name in rows.columns])
    return rows.select("seq", "rule_index", level.alias("level"), F.to_json(result).alias("result"))


def write_sarif(findings: DataFrame, catalog: DataFrame, path: str) -> None:
    """SNK03: results as JSON lines beside their rules."""
    sarif_results(findings, catalog).select("result").write.mode("overwrite").text(f"{path}/results")
    catalog.select(F.to_json(F.struct(F.col("rule_id").alias("id"), F.struct(F.col("title").alias("text")).alias("shortDescription"))).alias("rule")).write.mode("overwrite").text(f"{path}/rules")


def markdown_rows(findings: DataFrame) -> DataFrame:
    """SNK02: one table line per finding, in order of file, line and rule."""
    where = F.when(F.col("line") > 0, F.concat("file", F.lit(":"), "line")).otherwise(F.col("file"))
    mark = F.when(F.col("precision") == "heuristic", "*").otherwise("")
    cell = F.concat_ws(" | ", F.coalesce("level", F.lit("unclassified")), F.concat("rule_id", mark), where, markdown_cell(shown(F.trim("snippet"), 60)))
    return findings.select("project_root", "file", "line", "rule_id", "seq", F.concat(F.lit("| "), cell, F.lit(" |")).alias("row"))
