"""SNK05: an append-only store of reviews, audits, batches and consents.

A write is a batch with an id. Its rows are checked by the kind's rules and written as Parquet below `batch=<id>`, those that
fail apart, and a commit is written last; readers see the batches that have one, so a write that was broken off is never
seen, and writing it again replaces it. A committed batch can't be written again. The state of a key is its row of the highest
version (ties: the larger batch id); nothing is changed in place. All paths are any that Spark writes to.

Defined results: a null in a column that a rule looks at breaks the rule. Columns that the kind doesn't have are refused for
the whole write, as are missing ones. A store is made by `create`; without commits it reads as no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# States, decisions and the longest texts.
DECISIONS = ("confirmed", "false_positive", "uncertain")
STATES = ("pending", "running", "completed", "failed", "canceled", "interrupted")
NOTE, STAMP, NAME = 2000, 64, 128
COMMIT = "batch string, n_rows long, n_rejected long"


def _one_of(column: str, values: tuple[str, ...]) -> str:
    return f"{column} IN ({', '.join(repr(v) for v in values)})"


def _text(column: str, most: int, empty: bool = False) -> str:
    """Not too long, without control characters but for tab and newline."""
    sound = f"char_length({column}) <= {most} AND NOT {column} RLIKE r'[\\x00-\\x08\\x0B-\\x1F]'"
    return sound if empty else f"{sound} AND {column} <> ''"


#: By kind: columns, and the rules that rows must keep, by name.
KINDS: dict[str, tuple[str, dict[str, str]]] = {
    "review": ("key string, version long, decision string, note string, updated_at string", {"decision": _one_of("decision", DECISIONS), "note": _text("note", NOTE, True), "updated_at": _text("updated_at", STAMP)}),
    "audit": ("key string, version long, state string, provider string, model string", {"state": _one_of("state", STATES), "provider": _text("provider", NAME), "model": _text("model", NAME)}),
    "batch": ("key string, version long, state string, done long, total long", {"state": _one_of("state", STATES), "counts": "done >= 0 AND done <= total"}),
    "consent": ("key string, version long, digest string, granted boolean", {"digest": "digest RLIKE '^[0-9a-f]{64}$'", "granted": "granted IS NOT NULL"}),
}


def _fields(kind: str) -> list[tuple[str, str]]:
    return [tuple(c.split()) for c in KINDS[kind][0].split(", ")]


def problems(kind: str) -> Column:
    """The names of the rules that a row breaks."""
    rules = {"key": _text("key", NAME), "version": "version >= 0"} | KINDS[kind][1]
    return F.filter(F.array(*[F.when(~F.coalesce(F.expr(rule), F.lit(False)), F.lit(name)) for name, rule in rules.items()]), lambda x: x.isNotNull())


def create(spark: SparkSession, path: str) -> None:
    """An empty store; one that is there stays as it is."""
    for kind in KINDS:
        for part, schema in (("rows", _schema(kind, False)), ("rejected", _schema(kind, True))):
            spark.createDataFrame([], schema).coalesce(1).write.mode("ignore").parquet(f"{path}/{part}/{kind}/batch=none")
        spark.createDataFrame([], COMMIT).coalesce(1).write.mode("ignore").parquet(f"{path}/commits/{kind}/none")


def stage(rows: DataFrame, path: str, kind: str, batch: str) -> None:
    """Writes a batch's rows, without the commit: nobody sees them yet."""
    if not re.fullmatch(r"[A-Za-z0-9-]{1,64}", batch):
        raise ValueError("a batch id is 1 to 64 letters, digits and hyphens")
    fields = _fields(kind)
    if sorted(rows.columns) != sorted(c for c, _ in fields):
        raise ValueError(f"a {kind} has the columns {', '.join(c for c, _ in fields)}")
    checked = rows.select(*[F.col(c).try_cast(t).alias(c) for c, t in fields]).withColumn("problems", problems(kind))
    checked.filter(F.size("problems") == 0).drop("problems").write.mode("overwrite").parquet(f"{path}/rows/{kind}/batch={batch}")
    checked.filter(F.size("problems") > 0).write.mode("overwrite").parquet(f"{path}/rejected/{kind}/batch={batch}")


def commit(spark: SparkSession, path: str, kind: str, batch: str) -> None:
    """Makes a staged batch seen. Writing the same commit again changes nothing."""
    n, bad = (spark.read.schema(_schema(kind, rejected)).parquet(f"{path}/{part}/{kind}/batch={batch}").count() for part, rejected in (("rows", False), ("rejected", True)))
    spark.createDataFrame([(batch, n, bad)], COMMIT).coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/{kind}/{batch}")


def append(rows: DataFrame, path: str, kind: str, batch: str) -> None:
    """One whole write. A batch that is committed is refused, so a retry after success is an error and one after a failure is not."""
    spark = rows.sparkSession
    if not committed(spark, path, kind).filter(F.col("batch") == batch).isEmpty():
        raise ValueError("this batch is committed")
    stage(rows, path, kind, batch)
    commit(spark, path, kind, batch)


def committed(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """batch, n_rows, n_rejected of the batches of a kind that readers see."""
    return spark.read.schema(COMMIT).option("recursiveFileLookup", "true").parquet(f"{path}/commits/{kind}")


def _schema(kind: str, rejected: bool) -> str:
    return KINDS[kind][0] + (", problems array<string>" if rejected else "")


def _read(spark: SparkSession, path: str, kind: str, part: str) -> DataFrame:
    rows = spark.read.schema(_schema(kind, part == "rejected") + ", batch string").parquet(f"{path}/{part}/{kind}")
    return rows.join(committed(spark, path, kind).select("batch"), "batch", "left_semi")


def history(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """All valid rows of committed batches, with their batch."""
    return _read(spark, path, kind, "rows")


def rejected(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The rows of committed batches that broke a rule, with the rules' names."""
    return _read(spark, path, kind, "rejected")


def latest(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The state of each key. Pre-aggregated, so that a key of very many versions is no hot group."""
    rows = history(spark, path, kind)
    rest = F.struct(*[c for c in rows.columns if c != "key"])
    return rows.groupBy("key").agg(F.max_by(rest, F.struct("version", "batch")).alias("r")).select("key", "r.*")


def interrupted(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The states as a new session takes them up: what was under way when the last one ended is interrupted."""
    return latest(spark, path, kind).withColumn("state", F.when(F.col("state").isin("pending", "running"), "interrupted").otherwise(F.col("state")))
