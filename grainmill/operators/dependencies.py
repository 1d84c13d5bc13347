"""Dependency audit: declarations and imports against a registry snapshot, as joins.

Inputs are tables. `declared`: project_root, seq, name, ecosystem, source_file, line, skip_registry, registry_name,
presence. `imports`: project_root, seq, module, file, line, top_level. `registry`: ecosystem, name, is_there, age_days,
downloads, downloads_period, quarantined, archived, error. Missing registry rows count as failed lookups, never as absent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainmill.functions.scalars import canonical_name

# Days below which a package is new; downloads below which a new one is rare, by what they count.
FRESH_DAYS = 90
RARE = {"weekly": 500, "total": 1500}
# Which declaration of a name is the first. A snapshot may number several alike; what a finding depends on decides then, so that only equal ones are left to chance.
FIRST_DECLARED = ["seq", "name", "__as", "__presence", "ecosystem"]


def first_per(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """WN06: the first row of each group; the order must be total but for rows that are alike."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def checkable(declared: DataFrame) -> DataFrame:
    """Declarations to look up: the first of each name in a project that isn't skipped, with its canonical lookup name. Of equal seq: by name, registry name, presence, ecosystem."""
    keyed = declared.filter("NOT skip_registry").withColumns({"__k": F.lower("name"), "__as": F.coalesce("registry_name", F.lit("")), "__presence": F.coalesce("presence", F.lit("definite"))})
    rows = first_per(keyed, ["project_root", "__k"], FIRST_DECLARED).drop("__k", "__as", "__presence")
    named = F.coalesce(F.nullif(F.col("registry_name"), F.lit("")), F.col("name"))
    return rows.withColumn("lookup_name", canonical_name(F.col("ecosystem"), named))


def with_registry(rows: DataFrame, registry: DataFrame, name: str = "lookup_name") -> DataFrame:
    """JN06: each row with what the registry says of its name. Names are looked up once each; a snapshot without the name is an error."""
    names = rows.select("ecosystem", name).distinct()
    facts = names.join(registry.withColumnRenamed("name", name), ["ecosystem", name], "left")
    facts = facts.withColumn("error", F.when(F.col("is_there").isNull() & F.col("error").isNull(), "not in the snapshot").otherwise(F.col("error")))
    return rows.join(facts, ["ecosystem", name])


def status_rule() -> Column:
    """H009, H012, H005, H006 of a package that exists; null if there is nothing to say."""
    rare = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in RARE.items() for x in kv]), F.col("downloads_period")), F.lit(500))
    return (
        F.when(F.coalesce(F.col("quarantined"), F.lit(False)), "H009")
        .when(F.coalesce(F.col("archived"), F.lit(False)), "H012")
        .when((F.col("age_days") < FRESH_DAYS) & (F.col("downloads") < rare), "H005")
        .when(F.col("age_days") < FRESH_DAYS, "H006")
    )


def judge_declared(declared: DataFrame, registry: DataFrame, private_reason: str | None = None) -> DataFrame:
    """(project_root, seq, name, rule_id) of the declarations that give a finding."""
    rows = with_registry(checkable(declared), registry)
    scoped = (F.col("ecosystem") == "npm") & F.startswith(F.col("lookup_name"), F.lit("@"))
    rule = (
        F.when(F.col("error").isNotNull(), "H004")
        .when(~F.col("is_there") & (F.lit(private_reason is not None) | scoped), "H010")
        .when(~F.col("is_there") & (F.coalesce(F.col("presence"), F.lit("definite")) != "definite"), "H007")
        .when(~F.col("is_there"), "H001")
        .otherwise(status_rule())
    )
    return rows.select("project_root", "seq", "name", rule.alias("rule_id")).filter("rule_id IS NOT NULL")


def match_imports(imports: DataFrame, declared: DataFrame) -> DataFrame:
    """JN01, JN02, JN04: (project_root, seq, dep_seq): each import's first declaration that names its top level or a dotted prefix of its module.

    Both sides are named as the declaration's ecosystem names packages. The prefix test is an equi-join on the exploded
    prefixes of the module, not a nested loop; a prefix is named only in the ecosystems that its project declares.
    """
    steps = F.split("module", r"\.")
    prefix = F.explode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.array_join(F.slice(steps, 1, k), ".")))
    keys = imports.select("project_root", "seq", prefix.alias("p")).union(imports.select("project_root", "seq", F.col("top_level")))
    keys = keys.join(declared.select("project_root", "ecosystem").distinct(), "project_root")
    keys = keys.select("project_root", "seq", "ecosystem", canonical_name(F.col("ecosystem"), F.col("p")).alias("key")).distinct()
    deps = declared.select("project_root", "ecosystem", canonical_name(F.col("ecosystem"), F.col("name")).alias("key"), F.col("seq").alias("dep_seq"))
    deps = deps.groupBy("project_root", "ecosystem", "key").agg(F.min("dep_seq").alias("dep_seq"))
    return keys.join(deps, ["project_root", "ecosystem", "key"]).groupBy("project_root", "seq").agg(F.min("dep_seq").alias("dep_seq"))


def externals(imports: DataFrame, declared: DataFrame, internal: Column) -> DataFrame:
    """JN05: imports that are neither internal nor declared, the first of each top level in a project."""
    rows = imports.filter(~internal).join(match_imports(imports, declared), ["project_root", "seq"], "left_anti")
    return first_per(rows.withColumn("__k", F.lower("top_level")), ["project_root", "__k"], ["seq"]).drop("__k")


def judge_imports(external: DataFrame, registry: DataFrame, candidates: Column, trust: Column, private_reason: str | None = None) -> DataFrame:
    """JN07: (project_root, seq, rule_id, found_as) of external imports; `candidates`: ordered registry names, maybe none.

    The first candidate that exists counts; else any error; else what the trust of the mapping allows.
    """
    keyed = external.withColumn("cands", candidates).withColumn("trust", trust).withColumn("ecosystem", F.lit("pypi"))
    looked = with_registry(keyed.select("project_root", "seq", "ecosystem", F.posexplode("cands").alias("pos", "cand")), registry, "cand")
    fact = F.struct("pos", "cand", status_rule().alias("status"))
    best = looked.groupBy("project_root", "seq").agg(
        F.min(F.when(F.col("is_there") & F.col("error").isNull(), fact)).alias("hit"), F.max(F.col("error").isNotNull()).alias("failed")
    )
    rows = keyed.join(best, ["project_root", "seq"], "left")
    rule = (
        F.when(F.size("cands") == 0, "H007")
        .when(F.col("hit").isNotNull(), "H002")
        .when(F.coalesce(F.col("failed"), F.lit(False)), "H004")
        .when(F.lit(private_reason is not None), "H010")
        .when(F.col("trust") == "exact", "H008")
        .otherwise("H007")
    )
    both = F.filter(F.array(rule, F.col("hit.status")), lambda r: r.isNotNull())
    return rows.select("project_root", "seq", F.col("hit.cand").alias("found_as"), F.explode(both).alias("rule_id"))


def offline(declared: DataFrame, external: DataFrame) -> DataFrame:
    """H003 and H007 where no registry is asked."""
    return checkable(declared).select("project_root", "seq", F.lit("H003").alias("rule_id")).union(external.select("project_root", "seq", F.lit("H007").alias("rule_id")))


def providers(declared: DataFrame, registry: DataFrame) -> DataFrame:
    """JN08: (project_root, name) of declarations that may provide a module: all but those that the registry is sure not to have."""
    dead = with_registry(checkable(declared), registry).filter("error IS NULL AND NOT is_there").select("project_root", "name").distinct()
    return declared.select("project_root", "name").distinct().join(dead, ["project_root", "name"], "left_anti")


def without_local_sources(declared: DataFrame, local: DataFrame) -> DataFrame:
    """JN21: declarations whose canonical name has no local, vcs or workspace source in the project."""
    key = canonical_name(F.col("ecosystem"), F.col("name"))
    return declared.withColumn("__k", key).join(local.select("project_root", F.col("name").alias("__k")).distinct(), ["project_root", "__k"], "left_anti").drop("__k")


def longest_prefix(modules: DataFrame, curated: DataFrame) -> DataFrame:
    """JN03, JN04: `modules` (module) with the coordinates of the longest curated prefix (prefix, coords); prefixes are equi-joined."""
    steps = F.split("module", r"\.")
    rows = modules.select("module").distinct().withColumn("k", F.explode(F.sequence(F.lit(1), F.size(steps)))).withColumn("prefix", F.array_join(F.slice(steps, 1, F.col("k")), "."))
    best = rows.join(curated, "prefix").groupBy("module").agg(F.max_by("coords", "k").alias("coords"), F.max_by("prefix", "k").alias("prefix"))
    return modules.join(best, "module", "left")


def server_violations(found: DataFrame, entries: DataFrame, edges: DataFrame) -> DataFrame:
    """N006: client-only use (the per-file hits of N003) in files that an entry reaches as server code.

    `found`: facts with their kind; `entries`: node; `edges`: src, dst, resolved. Files marked as client code are the boundary.
    """
    from grainmill.operators.graphs import _cut, two_contexts

    # Files are parsed for the marks alone, not for the hits once more.
    found = _cut(found.filter("kind IN ('client', 'N003')"))
    reached = two_contexts(entries, edges, found.filter("kind = 'client'").select(F.col("rel").alias("node")))
    server = reached.filter("context = 'server'").select(F.col("node").alias("rel"))
    return found.filter("kind = 'N003'").join(server, "rel", "left_semi").withColumn("kind", F.lit("N006"))
