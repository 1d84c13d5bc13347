"""N006: the graph of modules of a tree, from its own files: import facts, aliases, endings and route files.

Specifiers become paths by array functions, aliases by an equi-join on the specifier's prefixes, and paths become files by
ownership.resolve, so everything is keyed by project and path. What names no file of the project has no edge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.operators.graphs import _cut, two_contexts
from grainmill.operators.ownership import resolve

# Endings of modules in the order in which they are tried, and names of files that the router enters.
ENDINGS = ["", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js", "/index.jsx"]
ROUTE = r"(?:^|/)app/(?:.*/)?(?:page|layout|template|loading|error|not-found|default|route)\.(?:tsx|ts|jsx|js)$"


def _folded(steps):
    """A path's steps without `.`, with `..` taken back; null if it leaves the root."""
    start = F.array().cast("array<string>")
    gone = F.array(F.lit(None).cast("string"))
    step = lambda done, s: (
        F.when(s.isin("", "."), done).when(s != "..", F.concat(done, F.array(s))).when((F.size(done) > 0) & F.element_at(done, -1).isNotNull(), F.slice(done, 1, F.size(done) - 1)).otherwise(gone)
    )
    # Slicing to no element needs a length, which is never negative here.
    folded = F.aggregate(steps, start, step)
    return F.when(~F.exists(folded, lambda s: s.isNull()), F.array_join(folded, "/"))


def module_edges(imports: DataFrame, files: DataFrame, aliases: DataFrame) -> DataFrame:
    """(src, dst): imports (rel, root, spec) of files (rel, root) that name a file of the same project.

    aliases: root, prefix, target; of more than one that fits, the longest counts. Paths are from the repository; `root` is a file's project.
    """
    inside = F.when(F.col("root") == ".", F.col("rel")).otherwise(F.substring("rel", F.length("root") + 2, 1_000_000))
    rows = imports.select("rel", "root", "spec", F.slice(F.split(inside, "/"), 1, F.size(F.split(inside, "/")) - 1).alias("folder")).distinct()
    near = rows.filter(F.startswith("spec", F.lit("."))).select("rel", "root", "spec", _folded(F.concat("folder", F.split("spec", "/"))).alias("base"))
    # A prefix stands for itself and for what follows it at a slash.
    steps = F.split("spec", "/")
    prefixes = rows.filter(~F.startswith("spec", F.lit("."))).withColumn("prefix", F.explode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.array_join(F.slice(steps, 1, k), "/"))))
    known = aliases.select("root", F.rtrim("prefix", F.lit("/")).alias("prefix"), "target")
    fit = prefixes.join(known, ["root", "prefix"]).groupBy("rel", "root", "spec").agg(F.max_by(F.struct("prefix", "target"), F.struct(F.length("prefix"), "target")).alias("a"))
    rest = F.expr("substring(spec, length(a.prefix) + 1)")
    far = fit.select("rel", "root", "spec", _folded(F.split(F.concat("a.target", F.lit("/"), rest), "/")).alias("base"))
    bases = near.union(far).filter("base IS NOT NULL").withColumn("at", F.when(F.col("root") == ".", F.col("base")).otherwise(F.concat("root", F.lit("/"), "base")))
    found = resolve(bases.select(F.col("rel").alias("src"), F.col("at").alias("spec")), files.select(F.col("rel").alias("file")), ENDINGS)
    return found.select("src", "dst").distinct()


def route_files(files: DataFrame) -> DataFrame:
    """(node): files that the router enters."""
    return files.filter(F.col("rel").rlike(ROUTE)).select(F.col("rel").alias("node"))


def context_findings(facts: DataFrame, files: DataFrame, aliases: DataFrame) -> DataFrame:
    """rel, kind, line, name: N006 of files that a route reaches as server code; N002, N004 and N005 of files that are client code only through who imports them.

    facts: rel, kind, line, name as the extraction gives them; files: rel, root; aliases: root, prefix, target.
    """
    # Four questions are asked of the facts; files are parsed for the first alone.
    facts = _cut(facts.filter(F.col("kind").isin("edge", "client", "N003") | F.startswith("kind", F.lit("if-client "))))
    edges = module_edges(facts.filter("kind = 'edge'").select("rel", F.col("name").alias("spec")).join(files, "rel"), files, aliases)
    marked = facts.filter("kind = 'client'").select(F.col("rel").alias("node"))
    reached = two_contexts(route_files(files), edges, marked)
    of = lambda context: reached.filter(F.col("context") == context).select(F.col("node").alias("rel"))
    server = facts.filter("kind = 'N003'").join(of("server"), "rel", "left_semi").withColumn("kind", F.lit("N006"))
    inherited = of("client").join(marked.withColumnRenamed("node", "rel"), "rel", "left_anti")
    # The facts of such files are marked by what they would be in client code.
    client = facts.filter("kind LIKE 'if-client %'").join(inherited, "rel", "left_semi").withColumn("kind", F.substring_index("kind", " ", -1))
    return server.unionByName(client).select("rel", "kind", "line", "name")
