"""Merkle manifest of a dataset: ternary hash trees by source, a tree over the sources, and a proof for every row.

1. Leaves are digests made by SQL functions, so texts don't leave the scan; a small table of ids and digests is checkpointed.
2. Each leaf gets its place in its source (see places.py), and runs of 3**HEIGHT leaves from a multiple of that on
   are one block, a whole subtree: a source with very many rows is very many blocks.
3. A treehash over each block gives its root. Block roots are the leaves of the next level, again in blocks, until each
   source has one root; these are numbered and climbed likewise to the root of all.
4. Downwards, each block gets the path above it, which all its leaves share, and a Merkle traversal goes through the block
   leaf by leaf: for each height it holds the run of nodes that the leaf's ancestor is in, and a treehash stack that takes in
   one leaf a step and so has the next run ready when the traversal gets there. Memory is logarithmic in the block.

Defined results: a null in a column counts as `-`. A null doc_id stands before all others and is never tampered with. Rows
of one source and doc_id stand in the order of their leaves. A table without rows gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.llm.common import CRC32_SQL, checked_broadcast, cut
from grainmill.llm.places import placed

ARITY, HEIGHT = 3, 7
NODES, PATHS = "tree string, at long, digest binary", "tree string, at long, note string, path binary"


def digest(nodes: list[bytes]) -> bytes:
    """The parent of nodes, all as lower-case hexadecimal text."""
    return sha256(b"".join(nodes)).hexdigest().encode()


class Treehash:
    """Takes in leaves one by one; holds at most two nodes of each height below `height`, and the nodes of that height in `done`."""

    def __init__(self, height: int):
        self.pending: list[list[bytes]] = [[] for _ in range(height)]
        self.done: list[bytes] = []

    def push(self, node: bytes, at: int = 0) -> None:
        while at < len(self.pending):
            run = self.pending[at]
            run.append(node)
            if len(run) < ARITY:
                return
            node = digest(run)
            run.clear()
            at += 1
        self.done.append(node)

    def end(self) -> None:
        """No more leaves: what is pending becomes shorter runs."""
        for at, run in enumerate(self.pending):
            if run:
                node = digest(run)
                run.clear()
                self.push(node, at + 1)


def block_height(block: int, n: int, most: int) -> int:
    """Only a first block that isn't full is a whole tree, which ends where one node remains; all others are `most` high."""
    height = 0
    while block == 0 and n > ARITY**height:
        height += 1
    return height if block == 0 else most


def tree_root(leaves: list[bytes], height: int) -> bytes:
    hashed = Treehash(height)
    for leaf in leaves:
        hashed.push(leaf)
    hashed.end()
    return hashed.done[0]


def traverse(leaves: list[bytes], height: int):
    """For each leaf in turn its authentication path: from each height the place in the run and the run's other nodes."""
    n = len(leaves)
    runs, ahead, fed = [], [], []
    for h in range(height):
        first = Treehash(h)
        width = ARITY ** (h + 1)
        for leaf in leaves[:width]:
            first.push(leaf)
        first.end() if n <= width else None
        runs.append(first.done)
        ahead.append(Treehash(h))
        fed.append(width)
    for i in range(n):
        path = []
        for h in range(height):
            place = i // ARITY**h % ARITY
            path.append((place, runs[h][:place] + runs[h][place + 1 :]))
        yield path
        for h in range(height):
            if fed[h] < n:
                ahead[h].push(leaves[fed[h]])
                fed[h] += 1
                if fed[h] == n:
                    ahead[h].end()
            if (i + 1) % ARITY ** (h + 1) == 0:
                runs[h], ahead[h] = ahead[h].done, Treehash(h)


def packed(path: list[tuple[int, list[bytes]]]) -> bytes:
    """A path as bytes: the place, the number of other nodes, and these."""
    return b"".join(bytes([place, len(others)]) + bytes.fromhex(b"".join(others).decode()) for place, others in path)


def unpacked(path: bytes) -> list[tuple[int, list[bytes]]]:
    at, out = 0, []
    while at < len(path):
        place, n = path[at], path[at + 1]
        out.append((place, [path[at + 2 + 32 * i : at + 34 + 32 * i].hex().encode() for i in range(n)]))
        at += 2 + 32 * n
    return out


def fold(node: bytes, path: list[tuple[int, list[bytes]]]) -> bytes:
    """The root that a node and its path lead to."""
    for place, others in path:
        node = digest([*others[:place], node, *others[place:]])
    return node


def _hex(items: pa.Array, name: str) -> list[bytes]:
    return [x.hex().encode() for x in items.field(name).to_pylist()]


def _roots(height: int):
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                block = batch.column("block")[i].as_py()
                leaves = _hex(batch.column("items")[i].values, "digest")
                root = bytes.fromhex(tree_root(leaves, block_height(block, len(leaves), height)).decode())
                yield pa.RecordBatch.from_pydict({"tree": [batch.column("tree")[i].as_py()], "at": [block], "digest": [root]}, pa.schema([("tree", pa.string()), ("at", pa.int64()), ("digest", pa.binary())]))

    return run


def _paths(height: int):
    """The packed path of every node of a block, in the block and above it."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("tree", "block", "path")}
                items = batch.column("items")[i].values
                leaves = _hex(items, "digest")
                paths = [packed(p) + row["path"] for p in traverse(leaves, block_height(row["block"], len(leaves), height))]
                yield pa.RecordBatch.from_arrays([pa.array([row["tree"]] * len(paths)), items.field("at"), items.field("note"), pa.array(paths, pa.binary())], ["tree", "at", "note", "path"])

    return run


def _proofs(height: int):
    """What is said of every row: its proof, and the root that its tampered leaf leads to."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                block, above, subroot, root = (batch.column(c)[i].as_py() for c in ("block", "path", "subroot", "root"))
                items = batch.column("items")[i].values
                leaves, given = _hex(items, "digest"), _hex(items, "tampered")
                above = unpacked(above)
                shared, known, proofs, folded = b"".join(x for _, others in above for x in others), {}, [], []
                for path, leaf in zip(traverse(leaves, block_height(block, len(leaves), height)), given):
                    proofs.append(sha256(b"".join(x for _, others in path for x in others) + shared).hexdigest())
                    top = fold(leaf, path)
                    if top not in known:
                        known = {top: fold(top, above).decode()} | (known if len(known) < 64 else {})
                    folded.append(known[top])
                n, root = len(leaves), root.hex()
                yield pa.RecordBatch.from_pandas(
                    pd.DataFrame({"doc_id": items.field("doc_id").to_pandas(types_mapper=pd.ArrowDtype), "leaf": [x.decode() for x in leaves], "subroot": [subroot.hex()] * n, "root": [root] * n, "proof_sha256": proofs, "folded_root": folded, "verified": np.array([f == root for f in folded])}),
                    preserve_index=False,
                )

    return run


def _blocks(nodes: DataFrame, height: int, *more: str) -> DataFrame:
    """(tree, block, items): the nodes of each block in order, at most 3**height of them in a row; checkpointed."""
    items = F.sort_array(F.collect_list(F.struct("at", "digest", *more)))
    return cut(nodes.groupBy("tree", F.expr(f"at div {ARITY**height}").alias("block")).agg(items.alias("items")))


def _climb(nodes: DataFrame, height: int, *more: str) -> tuple[list[DataFrame], DataFrame]:
    """Nodes (tree, at, digest) up to the root of each tree: the blocks of all levels, and (tree, digest)."""
    levels = [_blocks(nodes, height, *more)]
    while True:
        up = cut(levels[-1].mapInArrow(_roots(height), NODES))
        if not up.agg(F.max("at")).first()[0]:
            return levels, up.select("tree", "digest")
        levels.append(_blocks(up.withColumn("note", F.lit(None).cast("string")), height, "note"))


def _above(levels: list[DataFrame], tops: DataFrame, height: int) -> DataFrame:
    """The lowest blocks with the paths above them; tops: (tree, path) above the trees, and more columns that go down with it."""
    carried = [c for c in tops.columns if c not in ("tree", "path")]
    tops = tops.withColumn("block", F.lit(0).cast("long"))
    for blocks in levels[:0:-1]:
        paths = blocks.join(checked_broadcast(tops, row_bytes=2048), ["tree", "block"])
        lower = paths.mapInArrow(_paths(height), PATHS).select("tree", F.col("at").alias("block"), "path")
        tops = lower.join(checked_broadcast(tops.select("tree", *carried).distinct(), row_bytes=256), "tree") if carried else lower
    return levels[0].join(checked_broadcast(tops, row_bytes=2048), ["tree", "block"])


def _field(name: str, value=None):
    value = F.col(name).cast("string") if value is None else value
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def manifest(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """One row per row of `docs` (doc_id, source, lang, n_chars, text): doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    height: of a block; it changes how the work is dealt, not the result.
    """
    head = [_field(c) for c in ("doc_id", "source", "lang", "n_chars")]
    text = F.col("text").cast("string")
    leaf = F.sha2(F.concat(*head, _field("text", text)), 256)
    stripped = F.sha2(F.concat(*head, _field("text", F.replace(text, F.lit("\n"), F.lit("")))), 256)
    tampered = (F.crc32(F.col("doc_id").cast("string")) % 2 == 0) & F.contains(text, F.lit("\n"))
    # A null source stands before all others, which are in the order of their bytes.
    tree = F.coalesce(F.concat(F.lit("1"), F.col("source")), F.lit("0"))
    leaves = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), tree.alias("tree"), F.unhex(leaf).alias("digest"), F.unhex(F.when(tampered, stripped).otherwise(leaf)).alias("tampered")))
    levels, subroots = _climb(placed(leaves, ["tree"], [F.col("doc_id").asc_nulls_first(), F.col("digest")]), height, "doc_id", "tampered")
    subroots = cut(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("note"), "digest"))
    over, root = _climb(placed(subroots, ["tree"], [F.col("note")]), height, "note")
    paths = _above(over, root.select("tree", F.lit(b"").alias("path")), height).mapInArrow(_paths(height), PATHS)
    known = paths.join(F.broadcast(root.select("tree", F.col("digest").alias("root"))), "tree").select(F.col("note").alias("tree"), "path", "root")
    tops = cut(known.join(subroots.select(F.col("note").alias("tree"), F.col("digest").alias("subroot")), "tree"))
    return _above(levels, tops, height).mapInArrow(_proofs(height), "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def op13_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    return manifest(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text"))


SQL = (
    r"""
WITH RECURSIVE texts AS (
  SELECT *, CASE WHEN """
    + CRC32_SQL % {"s": "(doc_id::VARCHAR)"}
    + r""" % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS other FROM documents
), heads AS (
  SELECT doc_id, source, other, text, concat(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
         coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head FROM texts
), leaves AS (
  SELECT doc_id, coalesce('1' || source, '0') AS tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         sha256(head || coalesce(strlen(other) || ':' || other, '-')) AS given FROM heads
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves
), nodes AS (
  SELECT tree, 0 AS level, pos, leaf AS digest, count(*) OVER (PARTITION BY tree) AS n FROM placed
  UNION ALL
  SELECT tree, level + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(n) + 2) // 3 FROM nodes WHERE n > 1 GROUP BY tree, level, pos // 3
), subroots AS (
  SELECT tree, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos FROM nodes WHERE n = 1
), upper AS (
  SELECT 0 AS level, pos, subroot AS digest, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT level + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(n) + 2) // 3 FROM upper WHERE n > 1 GROUP BY level, pos // 3
), sides AS (
  SELECT p.tree, p.pos, 0 AS half, s.level, s.digest, s.pos AS other, p.pos // pow(3, s.level)::BIGINT AS own
  FROM placed p JOIN nodes s ON s.tree = p.tree AND s.n > 1 AND s.pos // 3 = p.pos // pow(3, s.level + 1)::BIGINT
  UNION ALL
  SELECT p.tree, p.pos, 1, s.level, s.digest, s.pos, t.pos // pow(3, s.level)::BIGINT
  FROM placed p JOIN subroots t ON t.tree = p.tree JOIN upper s ON s.n > 1 AND s.pos // 3 = t.pos // pow(3, s.level + 1)::BIGINT
), steps AS (
  SELECT tree, pos, half, level, coalesce(string_agg(digest, '' ORDER BY other) FILTER (other < own), '') AS before,
         coalesce(string_agg(digest, '' ORDER BY other) FILTER (other > own), '') AS after
  FROM sides GROUP BY tree, pos, half, level
), paths AS (
  SELECT tree, pos, list({'b': before, 'a': after} ORDER BY half, level) AS path FROM steps GROUP BY tree, pos
), folded AS (
  SELECT p.doc_id, p.leaf, t.subroot, (SELECT digest FROM upper WHERE n = 1) AS root,
         sha256(coalesce(array_to_string(list_transform(q.path, lambda x: x.b || x.a), ''), '')) AS proof_sha256,
         list_reduce(list_prepend({'b': p.given, 'a': ''}, coalesce(q.path, [])), lambda v, x: {'b': sha256(x.b || v.b || x.a), 'a': ''}).b AS folded_root
  FROM placed p JOIN subroots t USING (tree) LEFT JOIN paths q ON q.tree = p.tree AND q.pos = p.pos
)
SELECT *, folded_root = root AS verified FROM folded
"""
)
