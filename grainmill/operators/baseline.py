"""Baseline comparison and other set operations on multisets of findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def match(current: DataFrame, prior: DataFrame) -> DataFrame:
    """WN01: current findings (fp, seq, …) with `state`: the k-th copy of a fingerprint is unchanged if the baseline has k copies.

    Counts settle the fingerprints that the baseline lacks or has often enough; only the copies of the others are numbered.
    """
    had = prior.groupBy("fp").agg(F.count("*").alias("__had"))
    counts = current.groupBy("fp").agg(F.count("*").alias("__now")).join(had, "fp")
    rows = current.join(counts, "fp", "left")
    settled = rows.filter("__had IS NULL OR __had >= __now").withColumn("state", F.when(F.col("__had").isNull(), "new").otherwise("unchanged"))
    k = F.row_number().over(Window.partitionBy("fp").orderBy("seq"))
    others = rows.filter("__had < __now").withColumn("state", F.when(k <= F.col("__had"), "unchanged").otherwise("new"))
    return settled.unionByName(others).drop("__had", "__now")


def summary(current: DataFrame, prior: DataFrame) -> DataFrame:
    """WN01: new, unchanged and resolved, by counts alone (no window, so a fingerprint of very many copies is no hot group)."""
    a = current.groupBy("fp").agg(F.count("*").alias("now"))
    b = prior.groupBy("fp").agg(F.count("*").alias("had"))
    both = a.join(b, "fp", "full_outer").select(F.coalesce("now", F.lit(0)).alias("now"), F.coalesce("had", F.lit(0)).alias("had"))
    return both.agg(
        F.sum(F.greatest(F.col("now") - F.col("had"), F.lit(0))).alias("new"), F.sum(F.least("now", "had")).alias("unchanged"), F.sum(F.greatest(F.col("had") - F.col("now"), F.lit(0))).alias("resolved")
    )


def dedupe(findings: DataFrame, columns: list[str]) -> DataFrame:
    """ST01: full-row duplicates go, never rows that agree on a part."""
    return findings.select(*columns).dropDuplicates()


def merge_catalogs(entries: DataFrame) -> DataFrame:
    """ST08: one row per rule: languages united; `conflict` if anything else differs. `entries`: rule_id, languages, others."""
    rest = [c for c in entries.columns if c not in ("rule_id", "languages")]
    same = F.count_distinct(F.struct(*rest)) > 1
    return entries.groupBy("rule_id").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("languages")))).alias("languages"), same.alias("conflict"))


def selected(visible: DataFrame, picked: DataFrame, everything: bool, key: str) -> DataFrame:
    """ST07: all visible rows but the excluded ones, or the picked ones that are visible."""
    return visible.join(picked.select(key).distinct(), key, "left_anti" if everything else "left_semi")
