"""Saved logs of an external rule engine: findings, and what the engine left out of the files that it should have read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESULT = "STRUCT<check_id: STRING, path: STRING, start: STRUCT<line: INT>, extra: STRUCT<severity: STRING, message: STRING, metadata: MAP<STRING, STRING>>>"
LOG = f"STRUCT<results: ARRAY<{RESULT}>, errors: ARRAY<STRUCT<path: STRING>>, paths: STRUCT<scanned: ARRAY<STRING>, skipped: ARRAY<STRUCT<path: STRING>>>>"
#: An engine's severities as levels; any other one is a warning.
SEVERITIES = {"ERROR": "error", "WARNING": "warning", "INFO": "note"}


def parsed(logs: DataFrame) -> DataFrame:
    """(root, log) of `logs` (root, body); log is null if the body is no log or holds no list of results."""
    return logs.select("root", F.from_json("body", LOG).alias("log")).withColumn("log", F.when(F.col("log.results").isNotNull(), F.col("log")))


def within(root: Column, path: Column) -> Column:
    """The path relative to the root; null for one outside of it, and for one that climbs."""
    below = F.when(F.startswith(path, F.lit("/")), F.when(F.startswith(path, F.concat(root, F.lit("/"))), F.substr(path, F.length(root) + 2))).otherwise(path)
    plain = F.regexp_replace(below, r"^(\./)+", "")
    return F.when(~F.array_contains(F.split(plain, "/"), ".."), plain)


def _results(logs: DataFrame) -> DataFrame:
    """Each result with `why` it gives no finding (malformed, escaped) or null."""
    rows = logs.filter("log IS NOT NULL").select("root", F.explode("log.results").alias("r")).select("root", "r", within(F.col("root"), F.col("r.path")).alias("file"))
    known = F.col("r.path").isNotNull() & F.col("r.extra").isNotNull() & (F.trim(F.coalesce("r.check_id", F.lit(""))) != "")
    return rows.withColumn("why", F.when(F.col("r.path").isNotNull() & F.col("file").isNull(), "escaped").when(~known, "malformed"))


def findings(logs: DataFrame, precision_key: str = "precision") -> DataFrame:
    """SRC21: (root, rule_id, level, title, file, line, precision) of the usable results of `parsed` logs. Precision is heuristic unless the rule's metadata say exact."""
    c = F.col
    level = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in SEVERITIES.items() for x in pair]), c("r.extra.severity")), F.lit("warning"))
    title = F.coalesce(F.nullif(F.substring(F.substring_index("r.extra.message", "\n", 1), 1, 100), F.lit("")), F.lit("engine finding"))
    exact = F.coalesce(F.element_at("r.extra.metadata", F.lit(precision_key)) == "exact", F.lit(False))
    return _results(logs).filter("why IS NULL").select(
        "root", F.concat(F.lit("S:"), F.trim("r.check_id")).alias("rule_id"), level.alias("level"), title.alias("title"), "file", F.coalesce("r.start.line", F.lit(0)).alias("line"), F.when(exact, "exact").otherwise("heuristic").alias("precision")
    )


def completeness(logs: DataFrame, expected: DataFrame) -> DataFrame:
    """SRC21: per root: n_missing (expected paths, less those scanned), n_errors, n_skipped, n_escaped, n_malformed, state.

    `expected`: (root, path), both relative to the root. The state is invalid without a log, partial if anything was left out
    or the log doesn't say what was scanned (then nothing counts as missing), else success.
    """
    c = F.col
    size = lambda name: F.greatest(F.coalesce(F.size(name), F.lit(0)), F.lit(0)).cast("long")
    runs = logs.select("root", (c("log").isNotNull()).alias("valid"), c("log.paths.scanned").isNotNull().alias("told"), size("log.errors").alias("n_errors"), size("log.paths.skipped").alias("n_skipped"))
    scanned = logs.select("root", F.explode("log.paths.scanned").alias("p")).select("root", within(c("root"), c("p")).alias("path"))
    left_out = expected.select("root", "path").distinct().join(runs.filter("told").select("root"), "root", "left_semi").join(scanned.distinct(), ["root", "path"], "left_anti")
    counts = left_out.select("root", F.lit("missing").alias("why")).union(_results(logs).filter("why IS NOT NULL").select("root", "why"))
    counted = counts.groupBy("root").agg(*(F.count_if(c("why") == k).alias(f"n_{k}") for k in ("missing", "escaped", "malformed")))
    names = ("n_missing", "n_errors", "n_skipped", "n_escaped", "n_malformed")
    rows = runs.join(counted, "root", "left").select("root", "valid", "told", *(F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in names))
    clean = c("told") & (sum(map(c, names)) == 0)
    return rows.select("root", *names, F.when(~c("valid"), "invalid").when(clean, "success").otherwise("partial").alias("state"))
