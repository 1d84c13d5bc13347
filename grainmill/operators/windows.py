"""Windows, spans, budgets, ordered picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def context_spans(hits: DataFrame, around: int, keys: list[str]) -> DataFrame:
    """WN02, WN03: merged spans of lines around hits. `hits`: keys, line, total. Spans that overlap or touch become one."""
    spans = hits.select(*keys, F.greatest(F.lit(1), F.col("line") - around).alias("a"), F.least(F.col("total"), F.col("line") + around).alias("b")).distinct()
    return merge_spans(spans, keys, "a", "b")


def merge_spans(spans: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """WN03: gaps and islands: a span begins an island if it starts beyond every earlier end and its next line."""
    w = Window.partitionBy(*keys).orderBy(a, b)
    before = F.max(b).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("__new", F.when(before.isNull() | (F.col(a) > before + 1), 1).otherwise(0))
    marked = marked.withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "__island").agg(F.min(a).alias(a), F.max(b).alias(b)).drop("__island")


def within_budget(rows: DataFrame, keys: list[str], order: list[str], cost: Column, budget: int) -> DataFrame:
    """WN04, SS04: whole rows in order until the first that would pass the budget."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("spent", F.sum(cost).over(w)).filter(F.col("spent") <= budget)


def top_per(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """WN05, WN13, WN14: the first k rows of each group (Spark keeps k per task before the shuffle)."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)


def key_blocks(lines: DataFrame, keys: list[str]) -> DataFrame:
    """WN07: lines that begin a private key whose body follows: 40 base64 characters on the line or the next three, before the end line."""
    w = Window.partitionBy(*keys).orderBy("line")
    begin, body, end = r"-----BEGIN [A-Z ]*PRIVATE KEY-----", r"[A-Za-z0-9+/=]{40,}", "-----END"
    has = lambda c: F.coalesce(F.substring_index(c, end, 1).rlike(body), F.lit(False))
    ends = lambda c: F.coalesce(F.contains(c, F.lit(end)), F.lit(False))
    rest = F.regexp_replace("text", rf"^.*?{begin}", "")
    n1, n2, n3 = (F.lead("text", k).over(w) for k in (1, 2, 3))
    any_body = lambda c: F.coalesce(c.rlike(body), F.lit(False))
    found = has(rest)
    stop = F.lit(False)
    for nxt in (n1, n2, n3):
        stop = stop | (ends(nxt) & ~has(nxt))
        found = found | (~stop & any_body(nxt))
    return lines.withColumn("__found", found).filter(F.col("text").rlike(begin) & F.col("__found")).drop("__found")


def stratified_round_robin(rows: DataFrame, cap: int) -> DataFrame:
    """WN11: of each stratum at most `cap` rows: the mandatory ones, then the projects in turn. `rows`: stratum, project, key, mandatory."""
    turn = F.row_number().over(Window.partitionBy("stratum", "project").orderBy(F.desc("mandatory"), "key"))
    ranked = rows.withColumn("__turn", turn)
    must = rows.filter("mandatory").groupBy("stratum").agg(F.count("*").alias("__must"))
    rest = ranked.filter("NOT mandatory").join(must, "stratum", "left").withColumn("__n", F.row_number().over(Window.partitionBy("stratum").orderBy("__turn", "project", "key")))
    picked = rest.filter(F.col("__n") <= F.lit(cap) - F.coalesce("__must", F.lit(0)))
    return rows.filter("mandatory").select("stratum", "project", "key").union(picked.select("stratum", "project", "key"))


def proportional_quota(sizes: DataFrame, total: int, ceiling: float) -> DataFrame:
    """WN12: a stratum's quota by largest remainders, none above its ceiling's share; `sizes`: stratum, n. One row per stratum."""
    every = Window.partitionBy(F.lit(1))
    share = F.col("n") / F.sum("n").over(every) * total
    base = sizes.withColumn("__share", share).withColumn("quota", F.least(F.floor("__share"), F.floor(F.col("n") * ceiling)))
    left = F.lit(total) - F.sum("quota").over(every)
    order = F.row_number().over(every.orderBy(F.desc(F.col("__share") - F.floor("__share")), "stratum"))
    more = (order <= left) & (F.col("quota") < F.floor(F.col("n") * ceiling))
    return base.withColumn("quota", F.col("quota") + F.when(more, 1).otherwise(0)).select("stratum", "n", F.col("quota").cast("long").alias("quota"))


def last_write(events: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """WN15, SNK04, SS03: the last event of each key, all its columns, aggregated before the shuffle."""
    rest = [c for c in events.columns if c not in keys]
    return events.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("__last")).select(*keys, "__last.*")


def places(rows: DataFrame, first: str, rest: list[str]) -> DataFrame:
    """WN08: rows with their place in the order of `first` and `rest` (long, from 1). Only the counts by `first` are summed in one task; rows are numbered by group."""
    counts = rows.groupBy(first).agg(F.count("*").alias("__n"))
    before = counts.select(first, (F.sum("__n").over(Window.partitionBy(F.lit(1)).orderBy(first)) - F.col("__n")).alias("__before"))
    own = F.row_number().over(Window.partitionBy(first).orderBy(*rest))
    return rows.withColumn("__own", own).join(before, first).withColumn("place", (F.col("__before") + F.col("__own")).cast("long")).drop("__own", "__before")


def fold_items(events: DataFrame, keys: list[str]) -> DataFrame:
    """SRC12, WN15: Include, Remove and Update events in order, folded to a presence: definite stays definite under a conditional Include.

    `events`: keys, seq, op, definite. A key's events are few (one manifest); they are folded by an aggregate expression.
    """
    ordered = F.sort_array(F.collect_list(F.struct("seq", "op", "definite")))
    folded = F.aggregate(
        ordered,
        F.lit(0),
        lambda state, e: F.when(e["op"] == "Include", F.greatest(state, F.when(e["definite"], 2).otherwise(1))).when((e["op"] == "Remove") & e["definite"], 0).when(e["op"] == "Remove", F.least(state, F.lit(1))).otherwise(state),
    )
    rows = events.groupBy(*keys).agg(folded.alias("__state")).filter("__state > 0")
    return rows.select(*keys, F.when(F.col("__state") == 2, "definite").otherwise("possible").alias("presence"))
