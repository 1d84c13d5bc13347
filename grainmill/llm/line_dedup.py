"""Line dedup, in DataFrame functions only.

Lines are exploded with their position, normalised and hashed; a hash that enough distinct documents hold
loses its lines everywhere but in the largest document id that holds it; what stays is put together by position.

Only hashes, ids and positions are shuffled by hash; the text itself moves once, for the final join by document.
A hash is 128 bits wide. Counting is aggregated before each shuffle, and the join back to the lines is a plain
equi-join, so a line that a third of all documents hold is split by AQE's skew join.

Defined results: a null text counts as empty, which is one empty line. Rows that share a doc_id count as one document
when documents are counted, and each keeps its own lines. A null doc_id counts as one document below all others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.llm.common import BLANKS, lower_ascii

LEAST_ID = -(2**63)


def line_key(line):
    """The line without blanks at its ends and with A-Z in lower case."""
    return lower_ascii(F.btrim(line, F.lit(BLANKS)))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """All columns of `docs`, the text replaced by the lines that stay, plus __n_lines and __n_dropped (long)."""
    base = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST_ID)).alias("did"),
        F.coalesce(F.col(text_col), F.lit("")).alias("txt"),
    ).withColumn("th", F.xxhash64("txt"))
    lines = (
        base.select("did", "th", F.posexplode(F.split("txt", "\n", -1)).alias("pos", "line"))
        .withColumn("key", line_key(F.col("line")))
        .filter(F.char_length("key") >= min_chars)
        .select("did", "th", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"))
    )
    common = (
        lines.groupBy("h1", "h2")
        .agg(F.count_distinct("did").alias("n"), F.max("did").alias("keeper"))
        .filter(F.col("n") >= min_docs)
        .select("h1", "h2", "keeper")
    )
    drops = (
        lines.join(common, ["h1", "h2"])
        .filter(F.col("did") < F.col("keeper"))
        .groupBy("did", "th")
        .agg(F.array_distinct(F.collect_list("pos")).alias("drop"))
    )
    joined = base.join(drops, ["did", "th"], "left").withColumn("lines", F.split("txt", "\n", -1))
    n = F.size("lines")
    stay = F.when(F.col("drop").isNull(), F.sequence(F.lit(0), n - 1)).otherwise(F.array_except(F.sequence(F.lit(0), n - 1), "drop"))
    text = F.when(F.col("drop").isNull(), F.col("txt")).otherwise(F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n"))
    return joined.select(
        *[F.col("row").getField(c).alias(c) if c != text_col else text.alias(c) for c in docs.columns],
        n.cast("long").alias("__n_lines"),
        F.coalesce(F.size("drop").cast("long"), F.lit(0).cast("long")).alias("__n_dropped"),
    )


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select(
        "doc_id",
        F.col("__n_lines").alias("n_lines"),
        F.col("__n_dropped").alias("n_dropped"),
        F.sha2("text", 256).alias("kept_sha256"),
    )


SQL = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(s, 1) AS pos, unnest(s) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), common AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT k.*, c.key IS NOT NULL AND k.doc_id < c.keeper AS dropped FROM keyed k LEFT JOIN common c USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
