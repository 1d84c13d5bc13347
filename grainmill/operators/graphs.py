"""Fixpoints over edge tables: each round is one join of the frontier, what is new is kept, until nothing is new.

Only a count comes to the driver in a round. Lineage is cut by checkpoint() in the folder of spark.checkpoint.dir.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and tables between jobs: the cluster's, or one of our own where there is no cluster; on a cluster without one this is an error."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def _cut(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def reachable(seeds: DataFrame, edges: DataFrame, most_depth: int | None = None) -> DataFrame:
    """GR03, GR04, GR06: (root, node, depth): everything that a root reaches, itself included, at its least depth. Cycles end by themselves."""
    seen = _cut(seeds.select("root", "node").distinct().withColumn("depth", F.lit(0)))
    frontier, depth = seen, 0
    while most_depth is None or depth < most_depth:
        depth += 1
        step = frontier.join(edges, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node")).distinct()
        frontier = _cut(step.join(seen, ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = _cut(seen.union(frontier))
    return seen


def two_contexts(entries: DataFrame, edges: DataFrame, client: DataFrame) -> DataFrame:
    """GR01: (node, context): files reached as server or client; a client file turns what it imports to client, for good.

    `entries`: node. `client`: node (files marked as client code). Both tables of the graph are checkpointed, since each round
    reads them and what they come from may be a parse of all files.
    """
    marked = _cut(client.select("node").distinct().withColumn("marked", F.lit(True)))
    edges = _cut(edges.select("src", "dst").distinct())

    def entered(rows):
        return rows.join(marked, "node", "left").select("node", F.when(F.coalesce("marked", F.lit(False)), "client").otherwise(F.col("context")).alias("context")).distinct()

    seen = _cut(entered(entries.select("node", F.lit("server").alias("context"))))
    frontier = seen
    while True:
        step = entered(frontier.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), "context"))
        frontier = _cut(step.join(seen, ["node", "context"], "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = _cut(seen.union(frontier))


def best_kind(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """GR02: (root, node, rank): the best way to a node, where a way is as good as its worst edge. `edges`: src, dst, rank (higher is better).

    A node goes on again only when its rank got better, so a diamond keeps its definite path and cycles end.
    """
    seen = _cut(seeds.groupBy("root", "node").agg(F.max("rank").alias("rank")))
    frontier = seen
    while True:
        step = frontier.withColumnRenamed("rank", "r").join(edges, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node"), F.least("r", "rank").alias("rank"))
        step = step.groupBy("root", "node").agg(F.max("rank").alias("rank"))
        frontier = _cut(step.join(seen.withColumnRenamed("rank", "had"), ["root", "node"], "left").filter("had IS NULL OR rank > had").drop("had"))
        if frontier.isEmpty():
            return seen
        seen = _cut(seen.union(frontier).groupBy("root", "node").agg(F.max("rank").alias("rank")))


def expand_once(seeds: DataFrame, links: DataFrame, most: int) -> DataFrame:
    """GR07: up to `most` linked files of each seed, in the order of kind and path; `links`: src, kind, dst."""
    from grainmill.operators.windows import top_per

    hop = seeds.select("root", F.col("node").alias("src")).join(links, "src").filter("src <> dst").groupBy("root", "dst").agg(F.min("kind").alias("kind"))
    return top_per(hop, ["root"], [F.col("kind"), F.col("dst")], most)


def _module_tail(spec):
    """What of an import specifier must be the end of a file's path; null if it can't name a file of the project."""
    parts = F.filter(F.split(spec, "/"), lambda p: ~p.isin("", ".", "..") & ~F.startswith(p, F.lit("@")))
    scoped = F.startswith(spec, F.lit("@")) & F.contains(spec, F.lit("/")) & ~F.startswith(spec, F.lit("@/"))
    return F.when(~scoped & (F.size(parts) > 0), F.array_join(parts, "/"))


def imported_proofs(safe: DataFrame, imports: DataFrame) -> DataFrame:
    """Those of the `imports` (rel, name, spec) whose specifier names another file that proves the name; `safe`: (rel, name).

    A path ends in few tails, so each is a row and the search is an equi-join.
    """
    stem = F.split(F.regexp_replace("rel", r"\.[^./]*$", ""), "/")
    tails = safe.select("rel", "name", F.posexplode(stem).alias("at", "part"), stem.alias("stem")).select(
        F.col("rel").alias("other"), "name", F.array_join(F.slice("stem", F.col("at") + 1, F.size("stem") - F.col("at")), "/").alias("tail")
    )
    return imports.select("rel", "name", "spec", _module_tail(F.col("spec")).alias("tail")).join(tails, ["name", "tail"]).filter("other <> rel").select("rel", "name", "spec")


def proven_names(uses: DataFrame, safe: DataFrame, imports: DataFrame) -> DataFrame:
    """GR05: the `uses` (rel, name and others) whose name is a proven sanitizer: of the file itself, or of another file that the import's specifier names.

    `safe`: (rel, name). `imports`: (rel, name, spec). Nulls prove nothing; repeated uses stay, repeated proofs count once.
    """
    return uses.join(safe.select("rel", "name").union(imported_proofs(safe, imports).select("rel", "name")).distinct(), ["rel", "name"], "left_semi")
