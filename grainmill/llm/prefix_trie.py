"""Prefix trie of conversations: which beginnings conversations share, and what sharing them saves.

1. A turn is two 64-bit hashes of role and text and its length; texts don't leave the scan. Turns get their places, and rebuilt
   conversations their prefix hashes (128 bits: running sums of hashes of turn and depth), by places.py, so that a conversation
   with very many turns lies in many tasks.
2. The rows of equal prefixes become one node by an aggregate, so that many copies of a conversation are no hot group.
3. Every node has a bound on the nodes below it, the turns that its members still have. Where this is at most LIMIT, a node is
   light. A light node below a heavy one is the top of a prefix shard; shards are dealt to parts of about LIMIT nodes. In a part
   numpy puts the nodes in level order, writes the LOUDS bits (a 1 for each child, then a 0) and label arrays, reads the parents
   from the bits, and adds children to parents from the last level up.
4. The heavy upper levels merge separately: what the tops of shards hold is summed by their parents, and the heavy nodes are a
   trie themselves, treated likewise, until at most LIMIT nodes are left, which are one part. A path that is longer than LIMIT
   takes a round for each LIMIT of it.
5. The ids of conversations that end in one node are hashed as they stream by in order, in memory that doesn't grow with them.

Defined results: a row without conv_id belongs to no conversation and is ignored; without any other row there are no nodes. Turns
of one number stand in the order of their hashes; equal rows are turns of their own. A null turn comes first, a null role or text
is empty. A conversation whose turns all go is a member of the root only. Other columns are ignored.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.llm.common import CRC32_SQL, checked_broadcast, cut, written
from grainmill.llm.places import placed

#: Nodes of a part, about, and the bound from which on a node is heavy.
LIMIT = 32768
NO_ENDS = sha256(b"").hexdigest()
FULL = 2**62
NODE = "p1 long, p2 long, q1 long, q2 long, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, top boolean"


def rebuilt(turns: DataFrame, group: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth from 1, h1, h2, n_bytes, total) of the turns of rebuilt conversations, and (conv_id, total) of all of these; both checkpointed."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    base = turns.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.xxhash64(F.lit(1), role, text).alias("h1"), F.xxhash64(F.lit(2), role, text).alias("h2"), F.octet_length(text).cast("long").alias("n_bytes")
    )
    own = placed(cut(base), ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("h1"), F.col("h2")])
    counts = own.groupBy("conv_id").agg(F.max("at").alias("last"))
    counts = cut(counts.select("conv_id", (F.col("last") + 1).alias("n"), (F.crc32(F.col("conv_id").cast("string")) % most).alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("first")))
    heads = counts.join(counts.select(F.col("conv_id").alias("first"), F.col("n").alias("there")), "first", "left")
    heads = heads.withColumn("taken", F.least("h", F.coalesce("there", F.lit(0))))
    heads = cut(heads.withColumn("total", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).select("conv_id", "first", "h", "taken", "total"))
    kept = own.join(heads, "conv_id").filter("at >= h").select("conv_id", (F.col("at") - F.col("h") + F.col("taken") + 1).alias("depth"), "h1", "h2", "n_bytes", "total")
    given = own.filter(F.col("at") < most - 1).withColumnRenamed("conv_id", "first").join(heads, "first").filter("at < h").select("conv_id", (F.col("at") + 1).alias("depth"), "h1", "h2", "n_bytes", "total")
    return cut(kept.unionByName(given)), heads.select("conv_id", "total")


def louds(level: np.ndarray, node: np.ndarray, parent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the nodes of a forest in breadth first search, its LOUDS bits, and the bounds of its levels in that order.

    level: from 0, for the tops, whose parents aren't in the forest; node, parent: distinct keys of two columns. A super-root holds the tops.
    """
    both = np.ascontiguousarray(np.concatenate([node, parent])).view([("a", np.int64), ("b", np.int64)]).ravel()
    names, name = np.unique(both, return_inverse=True)
    row_of = np.full(len(names), -1)
    row_of[name[: len(node)]] = np.arange(len(node))
    above = np.where(level > 0, row_of[name[len(node) :]], -1)
    by_level = np.argsort(level, kind="stable")
    bounds = np.searchsorted(level[by_level], np.arange(int(level.max(initial=-1)) + 2))
    rank, order = np.zeros(len(node) + 1, np.int64), np.empty(len(node), np.int64)
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        rows = by_level[lo:hi]
        # Siblings are in the order of their labels; rank[-1] is the super-root's.
        rows = rows[np.lexsort((name[rows], rank[above[rows]]))]
        order[lo:hi], rank[rows] = rows, np.arange(lo, hi)
    degree = np.bincount(np.where(above[order] < 0, 0, rank[above[order]] + 1), minlength=len(node) + 1)
    bits = np.ones(2 * len(node) + 1, bool)
    bits[np.cumsum(degree + 1) - 1] = False
    return order, bits, bounds


def parents(bits: np.ndarray) -> np.ndarray:
    """Of each node in level order its parent's number, where 0 is the super-root and 1 the first node: the zeros before its 1."""
    ones = np.flatnonzero(bits)
    return ones - np.arange(len(ones))


def _part(f: pd.DataFrame) -> pd.DataFrame:
    """The rollups of one part; children, leaves and savings that came from below count too."""
    order, bits, bounds = louds(f["level"].to_numpy(), f[["p1", "p2"]].to_numpy(), f[["q1", "q2"]].to_numpy())
    f, parent = f.iloc[order].reset_index(drop=True), parents(bits)
    pad = lambda x: np.r_[0, x].astype(np.int64)
    children = pad(f["more_children"]) + np.diff(np.r_[-1, np.flatnonzero(~bits)]) - 1
    leaves = pad(f["more_leaves"]) + (children == 0)
    saved = pad(f["more_saved"]) + pad((f["n_convs"] - 1) * f["n_bytes"])
    for lo, hi in zip(bounds[-2::-1], bounds[:0:-1]):
        np.add.at(leaves, parent[lo:hi], leaves[lo + 1 : hi + 1])
        np.add.at(saved, parent[lo:hi], saved[lo + 1 : hi + 1])
    top = parent == 0
    above = pd.array(pad(f["conv_id"])[parent], "Int64")
    above[top] = pd.NA
    rolled = {"parent_conv_id": above, "n_children": children[1:], "n_leaves": leaves[1:], "saved_tokens": saved[1:], "top": top}
    return f.assign(**rolled)[[x.split()[0] for x in NODE.split(", ")]]


def _ends(frames):
    """p1, p2 and the digest of the ids of each run of equal (p1, p2)."""
    node, hashed = None, None
    for f in frames:
        keys, ids, out = f[["p1", "p2"]].to_numpy(), f["conv_id"].to_numpy(), []
        starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)]) if len(f) else []
        for lo, hi in zip(starts, [*starts[1:], len(f)]):
            text = ",".join(map(str, ids[lo:hi].tolist())).encode()
            if node == tuple(keys[lo]):
                hashed.update(b"," + text)
                continue
            if node:
                out.append((*node, hashed.hexdigest()))
            node, hashed = tuple(keys[lo]), sha256(text)
        yield pd.DataFrame(out, columns=["p1", "p2", "ends_sha256"])
    if node:
        yield pd.DataFrame([(*node, hashed.hexdigest())], columns=["p1", "p2", "ends_sha256"])


def trie(turns: DataFrame, limit: int = LIMIT) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (long), ends_sha256."""
    rows, convs = rebuilt(turns)
    tagged = rows.withColumns({f"x{i}": F.xxhash64(f"h{i}", "depth") for i in (1, 2)})
    rows = placed(tagged, ["conv_id"], [F.col("depth")], ["x1", "x2"])
    rows = cut(rows.select("conv_id", "depth", "n_bytes", "total", F.col("x1_sum").alias("p1"), F.col("x2_sum").alias("p2"), F.col("x1_before").alias("q1"), F.col("x2_before").alias("q2")))
    same = [F.any_value(c).alias(c) for c in ("q1", "q2", "depth", "n_bytes")]
    nodes = rows.groupBy("p1", "p2").agg(*same, F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"))
    none = F.lit(None).cast("long")
    root = convs.agg(none.alias("q1"), none.alias("q2"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("n_bytes"), F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).filter("n_convs > 0")
    zero = F.lit(0).cast("long")
    nodes = nodes.unionByName(root.select(zero.alias("p1"), zero.alias("p2"), "*"))
    ends = rows.filter("depth = total").select("p1", "p2", "conv_id").union(convs.filter("total = 0").select(zero, zero, "conv_id"))
    ends = ends.repartition("p1", "p2").sortWithinPartitions("p1", "p2", "conv_id").mapInPandas(_ends, "p1 long, p2 long, ends_sha256 string")
    nodes = nodes.join(ends, ["p1", "p2"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS)))
    tree = cut(nodes.withColumns({c: zero for c in ("more_children", "more_leaves", "more_saved")}))
    done = None
    while True:
        n = tree.count()
        if n <= limit:
            part = tree.withColumns({"part": F.lit(0), "level": F.col("depth")})
            out, heavy = cut(part.groupBy("part").applyInPandas(_part, NODE)), None
        else:
            out, heavy, rows = _shards(tree, rows, n, limit)
        finished = out.drop("top") if heavy is None else _with_parents(out, heavy)
        done = finished if done is None else done.unionByName(finished)
        if heavy is None:
            return done.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
        tree = heavy


def _shards(tree: DataFrame, rows: DataFrame, n: int, limit: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The light nodes' rollups; the heavy nodes with what comes from below; the rows that lead through these, one conversation for each way.

    rows: for every node of `tree` but the root at least one conversation with its depths and prefixes, and `total`, its last depth.
    """
    bound = rows.groupBy("p1", "p2").agg(F.sum(F.col("total") - F.col("depth") + 1).alias("below"), F.min("conv_id").alias("via"))
    marked = cut(tree.join(bound, ["p1", "p2"], "left").withColumn("heavy", (F.col("depth") == 0) | (F.col("below") > limit)))
    heavy = marked.filter("heavy")
    # Each conversation's first light prefix is the top of its shard.
    ways = rows.join(checked_broadcast(heavy.select("p1", "p2", "heavy"), row_bytes=24), ["p1", "p2"], "left")
    ways = cut(ways.withColumn("heavy", F.col("heavy").isNotNull()))
    tops = ways.filter("NOT heavy").groupBy("conv_id").agg(F.min(F.struct("depth", "p1", "p2")).alias("top"))
    part = F.pmod(F.xxhash64("top.p1", "top.p2"), F.lit(-(-n // limit))).cast("int")
    light = marked.filter("NOT heavy").join(tops.withColumnRenamed("conv_id", "via"), "via")
    light = light.withColumns({"part": part, "level": F.col("depth") - F.col("top.depth")}).drop("via", "below", "heavy", "top")
    out = cut(light.groupBy("part").applyInPandas(_part, NODE))
    below = out.filter("top").groupBy(F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.count("*").alias("c"), F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
    sums = {m: F.col(m) + F.coalesce(F.col(c), F.lit(0)) for m, c in (("more_children", "c"), ("more_leaves", "l"), ("more_saved", "s"))}
    heavy = written(heavy.drop("via", "below", "heavy").join(below, ["p1", "p2"], "left").withColumns(sums).drop("c", "l", "s"))
    ways = ways.filter("heavy").drop("heavy", "total")
    last = ways.groupBy("conv_id").agg(F.max(F.struct("depth", "p1", "p2")).alias("end"))
    chosen = last.groupBy("end").agg(F.min("conv_id").alias("conv_id")).select("conv_id", F.col("end.depth").alias("total"))
    return out, heavy, written(ways.join(chosen, "conv_id"))


def _with_parents(out: DataFrame, heavy: DataFrame) -> DataFrame:
    """Tops of shards get their parents' conversations from the heavy nodes."""
    over = checked_broadcast(heavy.select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("over"), F.lit(True).alias("top")), row_bytes=32)
    return out.join(over, ["q1", "q2", "top"], "left").withColumn("parent_conv_id", F.coalesce("over", "parent_conv_id")).drop("over", "top")


def op12_louds_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))


SQL = (
    """
WITH own AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i,
         {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS t
  FROM conversations WHERE conv_id IS NOT NULL
), lists AS (
  SELECT conv_id, list(t ORDER BY i) AS ts FROM own GROUP BY conv_id
), heads AS (
  SELECT conv_id, ts, (conv_id - conv_id % 5) AS first, """
    + CRC32_SQL % {"s": "(conv_id::VARCHAR)"}
    + """ % 9 AS h FROM lists
), rebuilt AS (
  SELECT a.conv_id, list_concat(coalesce(b.ts[1 : a.h], []), a.ts[a.h + 1 :]) AS ts FROM heads a LEFT JOIN lists b ON b.conv_id = a.first
), prefixes AS (
  SELECT conv_id, unnest(range(0, len(ts) + 1)) AS depth, ts FROM rebuilt
), nodes AS (
  SELECT depth, ts[1 : depth] AS path, min(conv_id) AS conv_id, count(*) AS n_convs,
         coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(ts) = depth), '') AS ends
  FROM prefixes GROUP BY 1, 2
), valued AS (
  SELECT n.*, p.conv_id AS parent_conv_id, CASE WHEN n.depth = 0 THEN 0 ELSE (n.n_convs - 1) * strlen(n.path[n.depth].text) END AS own
  FROM nodes n LEFT JOIN nodes p ON n.depth = p.depth + 1 AND n.path[1 : n.depth - 1] = p.path
), counted AS (
  SELECT v.*, (SELECT count(*) FROM valued c WHERE c.parent_conv_id = v.conv_id AND c.depth = v.depth + 1) AS n_children FROM valued v
), over AS (
  SELECT path[1 : d] AS path, own, n_children FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM counted)
), rolled AS (
  SELECT path, count(*) FILTER (n_children = 0) AS n_leaves, sum(own)::BIGINT AS saved_tokens FROM over GROUP BY path
)
SELECT c.conv_id, c.depth, c.parent_conv_id, c.n_convs, c.n_children, r.n_leaves, r.saved_tokens, sha256(c.ends) AS ends_sha256
FROM counted c JOIN rolled r ON r.path = c.path
"""
)
