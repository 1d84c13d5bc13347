"""Connected components of an edge table, by rounds of large-star and small-star steps.

Each round only groups edges by a node and takes a minimum, which is aggregated before the shuffle, so a hub with very
many neighbours is no hot group; the join back to the hub's edges is an equi-join that AQE splits (dealing hubs by hand costs
the driver a broadcast a step, which passed its memory in the check). Every round is
checkpointed in the shared folder; nothing but two numbers per round comes to the driver. Up to EDGES_PER_TASK counted
edges are one partition, where a round needs no shuffle: edges are turned by explosion, since a union would need one, and the
minimum comes from a window, since a join would; beyond, a window would hold a hub's edges in one task, and the join is taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grainmill.llm.common import cut


#: Edges that a task takes in at the beginning of a round, so that few edges don't pass through very many tasks; 1.6 MB of ids.
EDGES_PER_TASK = 100_000


def _each(df: DataFrame, *rows: tuple[str, str]) -> DataFrame:
    """For each row of `df` the given (u, v), named by their columns, without a change of partitions."""
    return df.select(F.explode(F.array(*[F.struct(F.col(u).alias("u"), F.col(v).alias("v")) for u, v in rows])).alias("e")).select("e.u", "e.v")


def _star(edges: DataFrame, large: bool, one: bool) -> DataFrame:
    """One step on edges (u, v) with u > v: neighbours are hung on the smallest node around u. An edge may come out more than once. one: they are one partition."""
    around = _each(edges, ("u", "v"), ("v", "u")) if large else edges
    if one:
        hung = around.withColumn("m", F.min("v").over(Window.partitionBy("u")))
    else:
        hung = around.join(around.groupBy("u").agg(F.min("v").alias("m")), "u")
    if large:
        out = hung.filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
    else:
        # The edge to the smallest neighbour itself stays, as u comes with it.
        out = hung.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
    return out.filter("u <> v")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node that each node of `edges` reaches; checkpointed. Self-loops and null ends are ignored; no edges, no rows."""
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct()
    now, before = cut(now), None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == before or not seen[0]:
            break
        before = seen
        now, one = now.coalesce(1 + seen[0] // EDGES_PER_TASK), seen[0] < EDGES_PER_TASK
        now = cut(_star(_star(now, True, one), False, one).distinct())
    # Stars by now: every u hangs on one v, and no v hangs on another.
    now = now.coalesce(1 + 2 * (seen[0] or 0) // EDGES_PER_TASK)
    done = cut(_each(now, ("u", "v"), ("v", "v")).distinct().select(F.col("u").alias("node"), F.col("v").alias("component")))
    # Spark frees the shuffle files of finished rounds when the driver collects its garbage, which small rounds give it no cause to do.
    edges.sparkSession.sparkContext._jvm.System.gc()
    return done
