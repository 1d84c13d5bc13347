"""Who owns a path: exact file, else deepest root, else the repository; ranges that meet; candidates in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_ancestors(rows: DataFrame, path: str, out: str = "ancestor") -> DataFrame:
    """One row for each directory above a path, the root as '.', with its depth."""
    steps = F.split(path, "/")
    depth = F.explode(F.sequence(F.lit(0), F.size(steps) - 1))
    return rows.withColumn("depth", depth).withColumn(out, F.when(F.col("depth") == 0, ".").otherwise(F.array_join(F.slice(steps, 1, F.col("depth")), "/")))


def deepest_root(rows: DataFrame, roots: DataFrame, path: str = "file", keys: list[str] | None = None) -> DataFrame:
    """JN09, JN20, SC05, WN16: (path, root): the deepest of `roots` (root) above each path. Equi-joins on ancestors, no nested loop."""
    keys = keys or []
    paths = rows.select(*keys, path).distinct()
    hits = with_ancestors(paths, path).join(roots.select(*keys, F.col("root").alias("ancestor")).distinct(), [*keys, "ancestor"])
    return hits.groupBy(*keys, path).agg(F.max_by("ancestor", "depth").alias("root"))


def assign(findings: DataFrame, owned: DataFrame, roots: DataFrame) -> DataFrame:
    """JN09: findings with `owner`: by exact file of `owned` (file, root), by deepest root, else 'repository'. Paths that leave the tree go."""
    safe = findings.filter(~F.array_contains(F.split("file", "/"), ".."))
    exact = owned.groupBy("file").agg(F.min("root").alias("own"))
    return safe.join(exact, "file", "left").join(deepest_root(safe, roots), "file", "left").withColumn("owner", F.coalesce("own", "root", F.lit("repository"))).drop("own", "root")


#: Lines in a block of range joins.
BUCKET = 64


def in_range(points: DataFrame, ranges: DataFrame, keys: list[str], at: str, first: str, last: str) -> DataFrame:
    """JN10, JN11: points within ranges of the same file. Files and blocks of BUCKET lines are equi-keys; the range is a residual within a block.

    Points are in one block and ranges in each that they touch, so that a match is met once.
    """
    blocks = F.explode(F.sequence(F.floor(F.col(first) / BUCKET), F.floor(F.col(last) / BUCKET)))
    p = points.withColumn("__block", F.floor(F.col(at) / BUCKET)).alias("p")
    r = ranges.filter(F.col(first) <= F.col(last)).withColumn("__block", blocks).alias("r")
    same = [F.col(f"p.{k}") == F.col(f"r.{k}") for k in [*keys, "__block"]]
    cond = F.col(f"p.{at}").between(F.col(f"r.{first}"), F.col(f"r.{last}"))
    for c in same:
        cond = c & cond
    return p.join(r, cond)


def overlapping(a: DataFrame, b: DataFrame, keys: list[str], first: str = "start_line", last: str = "end_line") -> DataFrame:
    """JN12: pairs of ranges of the same file that share a line. Both are in each block of BUCKET lines that they touch; a pair counts in its first common one."""
    block = lambda line: F.floor(line / BUCKET)
    in_blocks = lambda rows: rows.filter(F.col(first) <= F.col(last)).withColumn("__block", F.explode(F.sequence(block(F.col(first)), block(F.col(last)))))
    x, y = in_blocks(a).alias("a"), in_blocks(b).alias("b")
    cond = (F.col(f"a.{first}") <= F.col(f"b.{last}")) & (F.col(f"b.{first}") <= F.col(f"a.{last}"))
    cond = (F.col("a.__block") == F.greatest(block(F.col(f"a.{first}")), block(F.col(f"b.{first}")))) & cond
    for k in [*keys, "__block"]:
        cond = (F.col(f"a.{k}") == F.col(f"b.{k}")) & cond
    return x.join(y, cond)


def resolve(specs: DataFrame, files: DataFrame, endings: list[str]) -> DataFrame:
    """JN16, JN17: (src, spec, dst): the first existing of spec + ending, in the order of the endings."""
    tried = specs.select("src", "spec", F.posexplode(F.array(*[F.concat("spec", F.lit(e)) for e in endings])).alias("rank", "file"))
    return tried.join(files.select("file").distinct(), "file").groupBy("src", "spec").agg(F.min_by("file", "rank").alias("dst"))


def route_target(literals: DataFrame, routes: DataFrame) -> DataFrame:
    """JN18: (literal, rel): the first file by name among routes that equal a literal or begin it at a slash. Prefixes are equi-joined."""
    steps = F.split("literal", "/")
    prefixes = literals.select("literal").distinct().withColumn("route", F.explode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.array_join(F.slice(steps, 1, k), "/"))))
    return prefixes.join(routes, "route").groupBy("literal").agg(F.min("rel").alias("rel"))


def one_to_one(samples: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """JN13, JN22: the violations between two sides that should match one to one: (key, violation)."""
    a, b = samples.groupBy(key).agg(F.count("*").alias("na")), labels.groupBy(key).agg(F.count("*").alias("nb"))
    both = a.join(b, key, "full_outer")
    kind = F.when(F.col("nb").isNull(), "missing").when(F.col("na").isNull(), "stray").when((F.col("na") > 1) | (F.col("nb") > 1), "duplicate")
    return both.select(key, kind.alias("violation")).filter("violation IS NOT NULL")
