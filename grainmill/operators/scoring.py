"""Counts, scores, confidence, verdict, execution ledger. Rounding is half to even, as bround does."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WEIGHTS = {"error": 15, "warning": 5}
STATUSES = ("inconsistent", "failed", "partial", "blocked", "unavailable", "skipped", "complete", "not_applicable", "not_recorded")


def level_counts(findings: DataFrame) -> DataFrame:
    """AG01: errors, warnings and notes of each project, and of all where project_root is null."""
    counts = [F.count_if(F.col("level") == k).alias(f"n_{k}") for k in ("error", "warning", "note")]
    return findings.rollup("project_root").agg(*counts, F.count("*").alias("n"))


def health() -> Column:
    """AG02: from counted errors and warnings."""
    return F.greatest(F.lit(0), 100 - WEIGHTS["error"] * F.col("n_error") - WEIGHTS["warning"] * F.col("n_warning"))


def project_scores(projects: DataFrame, findings: DataFrame) -> DataFrame:
    """AG02: every project with its counts and score, those without findings too."""
    counted = level_counts(findings).filter("project_root IS NOT NULL")
    rows = projects.join(counted, "project_root", "left").na.fill(0, ["n_error", "n_warning", "n_note", "n"])
    return rows.withColumn("score", health())


def overall(scores: DataFrame) -> DataFrame:
    """AG03, AG04: one row: the mean score weighted by files (one at least), and the language of the lowest score (first project on ties)."""
    files = F.greatest(F.lit(1), F.col("file_count"))
    mean = F.bround(F.try_divide(F.sum(F.col("score") * files), F.sum(files)))
    return scores.agg(mean.cast("long").alias("overall"), F.min_by("language", F.struct("score", "seq")).alias("lowest"))


def coverage_confidence(read: Column, skipped: Column, manifests: Column, affected: Column, failures: Column, attempted: Column, parse_errors: Column, external: Column) -> Column:
    """AG05: the product of five ratios as a percentage; a dimension without denominator is whole."""
    whole = lambda n, d: F.coalesce(F.try_divide(n.cast("double"), d.cast("double")), F.lit(1.0))
    files = whole(read, read + skipped)
    manifest = 1 - affected / F.greatest(F.lit(1), manifests, affected)
    rules = 1 - F.coalesce(F.try_divide(failures.cast("double"), attempted.cast("double")), F.lit(0.0))
    parse = 1 - F.least(F.lit(1.0), parse_errors / F.greatest(F.lit(1), read))
    engine = F.when(F.endswith(external, F.lit("success")), 1.0).when(F.contains(external, F.lit("partial")), 0.97).otherwise(0.95)
    return F.bround(100 * files * manifest * rules * parse * engine).cast("long")


def registry_status(offline: Column, attempted: Column, failures: Column) -> Column:
    """AG06."""
    return F.when(offline, "unavailable").when(attempted <= 0, "not_applicable").when(failures > 0, "partial").otherwise("complete")


def registry_confidence(status: Column, attempted: Column, failures: Column) -> Column:
    """AG06: a number only where lookups ran."""
    return F.when(status.isin("complete", "partial") & (attempted > 0), F.bround(100 * (1 - failures / attempted)).cast("long"))


def gate_counts(findings: DataFrame, scope: str = "all") -> DataFrame:
    """AG07: counts of gate actions; scope `new` looks at new findings only. `findings`: action, state."""
    rows = findings if scope == "all" else findings.filter("state = 'new'")
    return rows.agg(*[F.count_if(F.col("action") == a).alias(a) for a in ("block", "review", "informational")])


def verdict(block: Column, review: Column, confidence: Column, attempted: Column, failures: Column, gaps: Column, registry: Column) -> Column:
    """AG08: the first rule that holds; `gaps`: whether anything was left out of the analysis."""
    return (
        F.when((block > 0) | (confidence < 40) | ((attempted > 0) & (failures >= attempted)), "block")
        .when((review > 0) | (confidence < 70) | (failures > 0) | gaps | (registry == "partial"), "review")
        .otherwise("pass")
    )


def exit_code(verdict_col: Column, strict: Column) -> Column:
    """SNK07."""
    return F.when((verdict_col == "block") | (strict & (verdict_col == "review")), 1).otherwise(0)


def ledger_counts(events: DataFrame) -> DataFrame:
    """AG09: counters of each project and rule."""
    kinds = ("eligible", "attempted", "failed", "blocked", "skipped")
    return events.groupBy("project_root", "rule_id").agg(*[F.sum(F.when(F.col("event") == k, F.col("n")).otherwise(0)).alias(k) for k in kinds])


def execution_status() -> Column:
    """AG10: the first rung that fits the counters."""
    c = F.col
    return (
        F.when((c("failed") > c("attempted")) | (c("attempted") > c("eligible")), "inconsistent")
        .when((c("eligible") == 0), "not_applicable")
        .when((c("attempted") > 0) & (c("failed") == c("attempted")), "failed")
        .when((c("failed") > 0) | ((c("attempted") > 0) & (c("blocked") + c("skipped") > 0)), "partial")
        .when(c("blocked") > 0, "blocked")
        .when(c("skipped") > 0, "skipped")
        .when(c("attempted") == 0, "not_recorded")
        .otherwise("complete")
    )


def observed_rules(findings: DataFrame) -> DataFrame:
    """AG11: how often each rule was seen, and in what."""
    return findings.groupBy("rule_id").agg(
        F.count("*").alias("n"), *[F.sort_array(F.collect_set(c)).alias(f"{c}s") for c in ("language", "precision", "level")]
    )


def coverage_stages(facts: DataFrame) -> DataFrame:
    """AG12: one row per stage of `facts` (stage, expected, done, failed, recorded)."""
    c = F.col
    status = (
        F.when(~c("recorded"), "not_recorded").when(c("expected") == 0, "unavailable").when(c("failed") >= c("expected"), "failed").when((c("failed") > 0) | (c("done") < c("expected")), "partial").otherwise("complete")
    )
    return facts.select("stage", status.alias("status"))


def path_outcomes(rules: DataFrame, files: DataFrame, run: DataFrame) -> DataFrame:
    """JN23: what an external run did to the files that each rule is for: eligible, scanned, errors, skipped by project and rule.

    `rules`: rule_id, language. `files`: project_root, rel, language. `run`: rel, outcome (scanned, error, skipped).
    """
    lang = F.when(F.col("language") == "tsx", "typescript").otherwise(F.col("language"))
    due = files.withColumn("language", lang).join(rules, "language").join(run, "rel", "left")
    return due.groupBy("project_root", "rule_id").agg(
        F.count("*").alias("eligible"), F.count_if(F.col("outcome") == "scanned").alias("scanned"), F.count_if(F.col("outcome") == "error").alias("errors"),
        F.count_if(F.col("outcome") == "skipped").alias("skipped"), F.count_if(F.col("outcome").isNull()).alias("missing"),
    )
