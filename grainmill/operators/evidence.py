"""Audit packs and their replies: retrieval, budgets, citations, verdicts; all but the model."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grainmill.operators.ownership import in_range
from grainmill.operators.windows import within_budget

REPLY = "STRUCT<issues: ARRAY<STRUCT<id: STRING, category: STRING, confidence: STRING, citations: ARRAY<STRUCT<file: STRING, a: INT, b: INT>>>>>"
CONFIDENCES = ("low", "medium", "high")
MOST_HINTS = 500


def retrieve(lines: DataFrame, hints: DataFrame, keys: list[str], most: int) -> DataFrame:
    """AI02, WN05, AG13: per query the files with the most distinct hints, then the most hit lines, then by path.

    `lines`: keys, text, line. `hints`: query, hint; a fixed list of the program, of which each line keeps those that it holds, so there is no join of lines with hints.
    """
    listed = hints.select("query", "hint").distinct().collect()
    if len(listed) > MOST_HINTS:
        raise ValueError(f"{len(listed)} hints; a catalog has at most {MOST_HINTS}")
    held = F.array(*[F.when(F.contains(F.lower("text"), F.lit(h.hint.lower())), F.struct(F.lit(h.query).alias("query"), F.lit(h.hint).alias("hint"))) for h in listed])
    hit = lines.withColumn("h", F.explode(F.filter(held, lambda x: x.isNotNull()))).select(*lines.columns, "h.*") if listed else lines.limit(0).select("*", F.lit("").alias("query"), F.lit("").alias("hint"))
    counted = hit.groupBy("query", *keys).agg(F.count_distinct("hint").alias("hints"), F.count_distinct("line").alias("evidence"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("hints"), F.desc("evidence"), *keys))
    return counted.withColumn("rank", rank).filter(F.col("rank") <= most)


def accounting(files: DataFrame, queries: DataFrame, ranked: DataFrame, most: int) -> DataFrame:
    """AG13: per project and query: eligible files, candidates, and what was left out by reason (a map).

    files: project, file, language (one row a file); queries: query, languages; ranked: project, query, rank of the files with
    evidence. A file without evidence is eligible but nobody's candidate; ranks beyond `most` are below the limit.
    """
    per = files.groupBy("project", "language").agg(F.count("*").alias("n")).crossJoin(F.broadcast(queries))
    seen = F.array_contains("languages", F.col("language"))
    counted = per.groupBy("project", "query").agg(F.sum(F.when(seen, F.col("n")).otherwise(0)).alias("eligible"), F.sum(F.when(seen, 0).otherwise(F.col("n"))).alias("other"))
    taken = ranked.groupBy("project", "query").agg(F.count_if(F.col("rank") <= most).alias("candidates"), F.count_if(F.col("rank") > most).alias("below"))
    rows = counted.join(taken, ["project", "query"], "left").fillna(0, ["candidates", "below"])
    reasons = F.map_filter(F.create_map(F.lit("language"), F.col("other"), F.lit("below the limit"), F.col("below")), lambda k, n: n > 0)
    return rows.select("project", "query", "eligible", "candidates", reasons.alias("skipped"))


def finding_pack(findings: DataFrame, lines: DataFrame, around: int, most_bytes: int) -> DataFrame:
    """AI04: (seq, file, line, text): the lines around each finding (seq, file, line), from the first on as many as fit in the budget."""
    spans = findings.select("seq", "file", (F.col("line") - around).alias("first"), (F.col("line") + around).alias("last"))
    near = in_range(lines, spans, ["file"], "line", "first", "last").select("seq", "p.file", "line", "text")
    return within_budget(near, ["seq"], ["line"], F.octet_length("text") + 1, most_bytes).select("seq", "file", "line", "text")


def assemble(pieces: DataFrame, per_file: int, total: int) -> DataFrame:
    """AI03, AI04, WN04: whole lines of each file up to `per_file` bytes, then whole files in rank order up to `total` bytes.

    `pieces`: pack, rank, file, line, text. Both budgets are running sums; the first line or file that would pass ends it.
    """
    cost = F.octet_length("text") + 1
    kept = within_budget(pieces, ["pack", "rank", "file"], ["line"], cost, per_file).drop("spent")
    sizes = kept.groupBy("pack", "rank", "file").agg(F.sum(cost).alias("bytes"))
    fit = within_budget(sizes, ["pack"], ["rank", "file"], F.col("bytes"), total).select("pack", "rank", "file")
    return kept.join(fit, ["pack", "rank", "file"])


def digests(pack_lines: DataFrame) -> DataFrame:
    """AG25: a digest of each pack that consent can be bound to; a file's lines are hashed first, then the files of the pack."""
    files = pack_lines.groupBy("pack", "rank", "file").agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n"), 256).alias("h"))
    return files.groupBy("pack").agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "file", "h"))), lambda x: x["h"]), "\n"), 256).alias("digest"))


def check_replies(replies: DataFrame, sent: DataFrame) -> DataFrame:
    """AI09, JN12, AI07: (pack, issue, problem): what is wrong with each issue of a reply, or null. `replies`: pack, body. `sent`: pack, file, a, b.

    A reply that can't be read gives one row with issue null. Every citation must lie within one span that was sent.
    """
    parsed = replies.withColumn("r", F.from_json("body", REPLY))
    broken = parsed.filter("r IS NULL OR r.issues IS NULL").select("pack", F.lit(None).cast("string").alias("issue"), F.lit("unreadable").alias("problem"))
    issues = parsed.select("pack", F.explode("r.issues").alias("i")).select("pack", F.col("i.id").alias("issue"), "i.confidence", "i.citations")
    cited = issues.select("pack", "issue", F.posexplode_outer("citations").alias("k", "c")).select("pack", "issue", "k", F.col("c.file").alias("file"), F.col("c.a").alias("ca"), F.col("c.b").alias("cb"))
    inside = cited.join(sent, ["pack", "file"]).filter("ca >= a AND cb <= b AND ca <= cb").select("pack", "issue", "k").distinct().groupBy("pack", "issue").agg(F.count("*").alias("inside"))
    rows = issues.join(inside, ["pack", "issue"], "left")
    n = F.coalesce(F.size("citations"), F.lit(0))
    problem = F.when(~F.coalesce(F.col("confidence").isin(*CONFIDENCES), F.lit(False)), "confidence").when(n <= 0, "no citation").when(F.coalesce("inside", F.lit(0)) < n, "citation outside")
    return rows.select("pack", "issue", problem.alias("problem")).union(broken)


def verdicts(issues: DataFrame) -> DataFrame:
    """AI06, AI07: the first rung that holds; anything unknown is insufficient. `issues`: issue, category, cites, literal, placeholder (flags of the cited text)."""
    c = F.col
    found = (
        F.when(c("cites") <= 0, F.struct(F.lit("insufficient").alias("verdict"), F.lit("no_evidence").alias("reason")))
        .when((c("category") == "secret") & c("placeholder"), F.struct(F.lit("unsupported").alias("verdict"), F.lit("placeholder").alias("reason")))
        .when((c("category") == "secret") & c("literal"), F.struct(F.lit("supported").alias("verdict"), F.lit("literal").alias("reason")))
        .otherwise(F.struct(F.lit("insufficient").alias("verdict"), F.lit("unverified").alias("reason")))
    )
    return issues.withColumn("v", found).select("issue", "v.verdict", "v.reason")


def within_limits(batches: DataFrame, most_units: int, most_tokens: int) -> DataFrame:
    """AI10, SS04: why a batch may not be sent, or null. `batches`: batch, units, tokens, consented."""
    why = F.when(F.col("units") > most_units, "too many units").when(F.col("tokens") > most_tokens, "too many tokens").when(~F.coalesce("consented", F.lit(False)), "no consent")
    return batches.select("batch", why.alias("refused"))


def trace(reads: DataFrame, declared: DataFrame) -> DataFrame:
    """GR06: reads of a symbol in another project count only if the symbol is declared in the file that is read. `reads`: seq, file, symbol, home, away."""
    same = reads.filter("home = away").select("seq")
    proven = reads.filter("home <> away").join(declared.select("file", "symbol").distinct(), ["file", "symbol"], "left_semi").select("seq")
    return same.union(proven)
