"""Agreement, evaluation and distribution statistics as aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grainmill.functions.scalars import ratio


def label_axes(labels: DataFrame) -> DataFrame:
    """AG14, AG15: counts and rates of each rule's labels: confirmed, false positives, uncertain."""
    kinds = ("confirmed", "false_positive", "uncertain")
    counted = labels.groupBy("rule_id").agg(F.count("*").alias("n"), *[F.count_if(F.col("label") == k).alias(k) for k in kinds])
    return counted.withColumn("rate", ratio(F.col("confirmed"), F.col("n"))["value"])


def label_totals(labels: DataFrame, axes: list[str]) -> DataFrame:
    """AG15: axis, value, n, counts and the rates of false positives and of what was decided; the axis `all` has one value. Null values are a value of their own."""
    pairs = F.array(F.struct(F.lit("all").alias("axis"), F.lit("all").alias("value")), *[F.struct(F.lit(a).alias("axis"), F.col(a).cast("string").alias("value")) for a in axes])
    per = labels.groupBy(*axes, "label").agg(F.count("*").alias("c"))
    rows = per.withColumn("p", F.explode(pairs))
    of = lambda kind: F.sum(F.when(F.col("label") == kind, F.col("c")).otherwise(0)).alias(kind)
    counted = rows.groupBy("p.axis", "p.value").agg(F.sum("c").alias("n"), *[of(k) for k in ("confirmed", "false_positive", "uncertain")])
    decided = F.col("confirmed") + F.col("false_positive")
    return counted.withColumn("false_rate", ratio(F.col("false_positive"), decided)["value"]).withColumn("decided_rate", ratio(decided, F.col("n"))["value"])


def evidence_class(needs: float = 0.34, least: int = 5):
    """AG16: what the labels of a rule say of it."""
    c = F.col
    share = c("false_positive") / c("n")
    return F.when(c("n") < least, "insufficient").when((share >= needs) & (c("false_positive") > 0), "needs_hardening").when(c("uncertain") * 2 > c("n"), "unclear").otherwise("supported")


def kappa(pairs: DataFrame) -> DataFrame:
    """AG17: one row: n, observed and expected agreement, kappa (null where chance explains all). `pairs`: a, b (labels of both raters)."""
    n = pairs.agg(F.count("*").alias("n"), F.count_if(F.col("a") == F.col("b")).alias("same"))
    left = pairs.groupBy(F.col("a").alias("label")).agg(F.count("*").alias("na"))
    right = pairs.groupBy(F.col("b").alias("label")).agg(F.count("*").alias("nb"))
    chance = left.join(right, "label").agg(F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0)).alias("both"))
    row = n.crossJoin(chance)
    observed, expected = F.try_divide(F.col("same").cast("double"), F.col("n").cast("double")), F.try_divide(F.col("both").cast("double"), (F.col("n") * F.col("n")).cast("double"))
    return row.select("n", F.round(observed, 6).alias("observed"), F.round(expected, 6).alias("expected"), F.when(expected < 1, F.round((observed - expected) / (1 - expected), 6)).alias("kappa"))


def jaccard(a: DataFrame, b: DataFrame, keys: list[str], items: list[str]) -> DataFrame:
    """AG18: per key, the share of common items among all; no pair of rows is made."""
    both = a.select(*keys, *items).distinct().withColumn("side", F.lit(1)).union(b.select(*keys, *items).distinct().withColumn("side", F.lit(2)))
    sides = both.groupBy(*keys, *items).agg(F.count("*").alias("sides"))
    return sides.groupBy(*keys).agg(F.count_if(F.col("sides") == 2).alias("common"), F.count("*").alias("every")).withColumn("jaccard", F.round(F.col("common") / F.col("every"), 6))


def inclusion(population: DataFrame, sample: DataFrame, keys: list[str]) -> DataFrame:
    """AG19: per stratum the chance of being sampled, and the stratum's share of the population."""
    n, k = population.groupBy(*keys).agg(F.count("*").alias("n")), sample.groupBy(*keys).agg(F.count("*").alias("k"))
    every = Window.partitionBy(F.lit(1))
    rows = n.join(k, keys, "left").withColumn("k", F.coalesce("k", F.lit(0)))
    return rows.withColumn("probability", F.round(F.col("k") / F.col("n"), 6)).withColumn("share", F.round(F.col("n") / F.sum("n").over(every), 6))


def distribution(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """AG20: n, least, upper median s[n//2], p95 s[int(.95 n)], greatest. Values are counted first, so that places are running sums over distinct values."""
    counted = rows.groupBy(*keys, value).agg(F.count("*").alias("__c"))
    upto = F.sum("__c").over(Window.partitionBy(*keys).orderBy(F.col(value).asc_nulls_last()))
    total = counted.groupBy(*keys).agg(F.sum("__c").alias("__n"))
    placed = counted.withColumn("__to", upto).join(total, keys)
    # The value whose copies cover a place.
    at = lambda k: F.min(F.when(F.col("__to") > k, F.col(value)))
    return placed.groupBy(*keys).agg(
        F.max("__n").alias("n"), F.min(value).alias("least"), at(F.floor(F.col("__n") / 2)).alias("median"), at(F.least(F.floor(F.col("__n") * 0.95), F.col("__n") - 1)).alias("p95"), F.max(value).alias("greatest")
    )


def confusion(answers: DataFrame) -> DataFrame:
    """AG21, AG22: per query counts of answers against the truth, with a verdict; `answers`: query, expected, said (positive, negative, abstain)."""
    c = F.col
    count = lambda e, s: F.count_if((c("expected") == e) & (c("said") == s))
    rows = answers.groupBy("query").agg(count("positive", "positive").alias("tp"), count("negative", "positive").alias("fp"), count("negative", "negative").alias("tn"), count("positive", "negative").alias("fn"), F.count_if(c("said") == "abstain").alias("abstained"))
    return rows.withColumn("verdict", F.when(c("fp") > c("tp"), "reject").when(c("tp") + c("tn") > 2 * (c("fp") + c("fn")), "accept").otherwise("review"))


def confusion_summary(rows: DataFrame) -> DataFrame:
    """AG22: one row over all queries of `confusion`: sums, precision, recall, and how many queries have each verdict (a map)."""
    sums = rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "tn", "fn", "abstained")], *[F.count_if(F.col("verdict") == v).alias(v) for v in ("accept", "review", "reject")])
    found = F.map_filter(F.create_map(*[x for v in ("accept", "review", "reject") for x in (F.lit(v), F.col(v))]), lambda k, n: n > 0)
    return sums.select("tp", "fp", "tn", "fn", "abstained", ratio(F.col("tp"), F.col("tp") + F.col("fp"))["value"].alias("precision"), ratio(F.col("tp"), F.col("tp") + F.col("fn"))["value"].alias("recall"), found.alias("verdicts"))


def evaluation(runs: DataFrame) -> DataFrame:
    """AG23: per query: decided share, duplicates beyond the first of each candidate, latency."""
    per = runs.groupBy("query", "candidate").agg(F.count("*").alias("c"), F.count_if(F.col("decided")).alias("d"), F.min("latency").alias("lo"), F.max("latency").alias("hi"), F.sum("latency").alias("total"))
    return per.groupBy("query").agg(
        F.sum("c").alias("n"), F.round(F.sum("d") / F.sum("c"), 4).alias("decided"), F.sum(F.col("c") - 1).alias("duplicates"), F.min("lo").alias("latency_min"), F.max("hi").alias("latency_max"), F.round(F.sum("total") / F.sum("c"), 4).alias("latency_mean")
    )


def estimate(pieces: DataFrame, bytes_per_token: int = 4) -> DataFrame:
    """AG24, AG25: per pack: tokens, redactions, a digest over its pieces in order. `pieces`: pack, seq, id, bytes, redacted."""
    ordered = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "id"))), lambda s: s["id"]), "\n")
    return pieces.groupBy("pack").agg(F.sum(F.ceil(F.col("bytes") / bytes_per_token)).alias("tokens"), F.sum("redacted").alias("redacted"), F.sha2(ordered, 256).alias("digest"))


def accepted(earned: str = "earned", needed: str = "needed"):
    """AG26: yes, no, or null while nothing is known."""
    return F.when(F.col(needed).isNull() | F.col(earned).isNull(), F.lit(None).cast("boolean")).otherwise(F.col(earned) >= F.col(needed))


def outcome_matrix(pairs: DataFrame, kinds: list[str]) -> DataFrame:
    """AG27: counts of every pair of outcomes, zeros too."""
    some = pairs.groupBy("human", "model").agg(F.count("*").alias("n"))
    spark = pairs.sparkSession
    full = spark.createDataFrame([(h, m) for h in kinds for m in kinds], "human string, model string")
    return full.join(some, ["human", "model"], "left").select("human", "model", F.coalesce("n", F.lit(0)).alias("n"))
