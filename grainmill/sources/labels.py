"""Labels given by people to sampled findings: every row is checked, and a reader that refuses bad ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.functions.scalars import json_text

# Forms of names and the words of each axis.
ALIAS, RULE, DIGEST = "^repo-[a-z]$", "^[A-Z][A-Z0-9]{1,9}$", "^[0-9a-f]{64}$"
AXES = {
    "validity": ("confirmed", "false_positive", "uncertain"),
    "level_assessment": ("correct", "too_high", "too_low", "uncertain"),
    "gate_assessment": ("correct", "too_strict", "too_lenient", "uncertain"),
    "actionability": ("actionable", "needs_context", "non_actionable"),
}


def sample_id(alias: Column, project: Column, file: Column, line: Column, rule: Column, fingerprint: Column) -> Column:
    """The digest that a sample's identity has: SHA-256 of its parts as one JSON list."""
    parts = [json_text(alias), json_text(project), json_text(file), line.cast("string"), json_text(rule), json_text(fingerprint)]
    return F.sha2(F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]")), 256)


def problems(labels: DataFrame, corpus: DataFrame) -> DataFrame:
    """SRC23: the rows of `labels` with `problem`: the first rule that a row breaks, or null.

    `corpus`: (alias, n). All rows of a repeated sample_id are duplicates. An axis may be null (not judged yet), no other
    column but review_id may.
    """
    c = F.col
    holds = lambda found: F.coalesce(found, F.lit(False))
    filled = lambda name: holds(F.length(F.trim(c(name))) > 0)
    repeated = labels.groupBy("sample_id").agg(F.count("*").alias("__n")).filter("__n > 1").select("sample_id", F.lit(True).alias("__again"))
    known = corpus.filter("n > 0").select("alias").distinct().withColumn("__known", F.lit(True))
    rows = labels.join(repeated, "sample_id", "left").join(known, "alias", "left")
    identity = sample_id(*map(c, ("alias", "project", "file", "line", "rule", "fingerprint")))
    checks = [
        ("sample_id", holds(F.regexp_like("sample_id", F.lit(DIGEST)))),
        ("duplicate", c("__again").isNull()),
        ("alias", holds(F.regexp_like("alias", F.lit(ALIAS)))),
        ("unknown alias", holds(c("__known"))),
        ("rule", holds(F.regexp_like("rule", F.lit(RULE)))),
        ("population", holds(c("population") > 0)),
        *((name, holds(F.length(name) > 0)) for name in ("project", "file")),
        ("line", holds(c("line") >= 0)),
        ("fingerprint", holds(F.length("fingerprint") > 0)),
        ("review_id", F.coalesce(F.length("review_id") > 0, F.lit(True))),
        ("evidence", filled("evidence")),
        ("identity", holds(c("sample_id") == identity)),
        *((axis, c(axis).isNull() | c(axis).isin(*words)) for axis, words in AXES.items()),
    ]
    broken = F.coalesce(*(F.when(~good, F.lit(name)) for name, good in checks))
    return rows.select(*labels.columns, broken.alias("problem"))


def strict(labels: DataFrame, corpus: DataFrame) -> DataFrame:
    """SRC23: the labels; a row with a problem fails the job, with the problem's name and no value."""
    rows = problems(labels, corpus)
    fails = F.raise_error(F.concat(F.lit("label with an invalid "), "problem")).cast("boolean")
    return rows.filter(F.when(F.col("problem").isNull(), True).otherwise(fails)).select(*labels.columns)
