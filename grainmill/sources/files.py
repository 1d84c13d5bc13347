"""Source trees as tables: one binaryFile scan, then projections and joins."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grainmill.functions.scalars import path_matches, vendored
from grainmill.operators.ownership import with_ancestors

# Directories that are never source, sizes beyond which files aren't read, languages by suffix, manifests.
IGNORED = tuple(
    ".git node_modules .venv venv env .tox __pycache__ dist build target bin obj .next out .output coverage .idea .vs .vscode site-packages "
    ".mypy_cache .pytest_cache .gradle .dart_tool .terraform".split()
)
MAX_SOURCE, MAX_MANIFEST = 1_500_000, 2_000_000
LANGUAGES = {"py": "python", "ts": "typescript", "tsx": "tsx", "cs": "csharp", "java": "java"}
MANIFESTS = {
    "python": ("pyproject.toml", "setup.py", "Pipfile", "requirements.txt"),
    "typescript": ("package.json",),
    "java": ("pom.xml", "build.gradle", "build.gradle.kts"),
    "csharp": (),
}
AUDIT_MANIFESTS = ("package.json", "pyproject.toml", "requirements.txt", "pom.xml", "build.gradle", "build.gradle.kts", "Directory.Packages.props", "Directory.Build.props", "NuGet.config")


def _unlisted(spark: SparkSession, root: str) -> tuple[list[str], list[str]]:
    """Files that Spark's own listing leaves out: those with a hidden name or directory, and empty ones. Names only, by the file system's listing."""
    sc = spark.sparkContext
    top = sc._jvm.org.apache.hadoop.fs.Path(root)
    found = top.getFileSystem(sc._jsc.hadoopConfiguration()).listFiles(top, True)
    hidden, empty = [], []
    base = top.toUri().getPath().rstrip("/")
    while found.hasNext():
        status = found.next()
        path = status.getPath()
        steps = path.toUri().getPath()[len(base) + 1 :].split("/")
        if set(steps[:-1]) & set(IGNORED):
            continue
        if not status.getLen():
            empty.append("/".join(steps))
        elif any(s.startswith(("_", ".")) for s in steps):
            hidden.append(path.toString())
    return hidden, empty


def _read_hidden(frames):
    """Spark's readers leave out names that begin with a dot or an underscore even if they are given; Arrow's file systems read them in tasks."""
    from pyarrow import fs

    for frame in frames:
        rows = []
        for path in frame["path"]:
            system, inner = fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
            with system.open_input_stream(inner) as f:
                content = f.read()
            rows.append((path, len(content), content))
        yield pd.DataFrame(rows, columns=["path", "length", "content"])


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """SRC02: rel, length, content of every file below a root that isn't in an ignored directory. Size filters reach the scan."""
    base = root.rstrip("/")
    hidden, empty = _unlisted(spark, base)
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base).select("path", "length", "content")
    if hidden:
        names = spark.createDataFrame([(h,) for h in hidden], "path string").repartition(min(len(hidden), spark.sparkContext.defaultParallelism))
        rows = rows.union(names.mapInPandas(_read_hidden, "path string, length long, content binary"))
    plain = F.regexp_replace("path", r"^[a-z]+:/+", "/")
    head = base.split(":", 1)[-1].replace("//", "/") if ":" in base else base
    rel = F.substring(plain, F.lit(len(head.rstrip("/")) + 2), F.length(plain))
    rows = rows.select(rel.alias("rel"), "length", "content")
    if empty:
        rows = rows.union(spark.createDataFrame([(e, 0, b"") for e in empty], "rel string, length long, content binary"))
    return rows.filter(~F.arrays_overlap(F.split("rel", "/"), F.array(*[F.lit(d) for d in IGNORED])))


def name_of(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def directory_of(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise(".")


def language_of(path: Column) -> Column:
    suffix = F.lower(F.substring_index(path, ".", -1))
    return F.element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), suffix)


def source_files(tree: DataFrame) -> DataFrame:
    """SRC02: rel, language, length, content, and `skipped` for files that are too large."""
    rows = tree.withColumn("language", language_of(F.col("rel"))).filter("language IS NOT NULL")
    return rows.withColumn("skipped", F.when(F.col("length") > MAX_SOURCE, "exceeds byte cap"))


def manifests(tree: DataFrame) -> DataFrame:
    """SRC03: rel, kind of project, text (malformed bytes become U+FFFD), and `skipped`."""
    name = name_of(F.col("rel"))
    kind = F.when(name.rlike(r"^requirements.*\.txt$"), "python").when(F.endswith(name, F.lit(".csproj")), "csharp")
    for language, names in MANIFESTS.items():
        if names:
            kind = kind.when(name.isin(*names), language)
    rows = tree.withColumn("language", kind).filter("language IS NOT NULL")
    return rows.select("rel", "language", F.when(F.col("length") <= MAX_MANIFEST, F.col("content").cast("string")).alias("text"), F.when(F.col("length") > MAX_MANIFEST, "exceeds byte cap").alias("skipped"))


def projects(tree: DataFrame) -> DataFrame:
    """SRC04: (language, root): directories with a manifest; the repository's root for languages with sources outside of all of these."""
    found = manifests(tree).select("language", directory_of(F.col("rel")).alias("root")).distinct()
    files = source_files(tree).select(F.when(F.col("language") == "tsx", "typescript").otherwise(F.col("language")).alias("language"), "rel")
    covered = with_ancestors(files, "rel").join(found.select("language", F.col("root").alias("ancestor")), ["language", "ancestor"]).select("language", "rel").distinct()
    rest = files.join(covered, ["language", "rel"], "left_anti").select("language", F.lit(".").alias("root")).distinct()
    return found.union(rest).distinct()


def project_files(tree: DataFrame, found: DataFrame) -> DataFrame:
    """SRC05: each source file with the deepest project of its language."""
    family = F.when(F.col("language") == "tsx", "typescript").otherwise(F.col("language"))
    files = source_files(tree).withColumn("family", family)
    roots = found.select(F.col("language").alias("family"), F.col("root").alias("ancestor"))
    owner = with_ancestors(files.select("family", "rel"), "rel").join(roots, ["family", "ancestor"]).groupBy("family", "rel").agg(F.max_by("ancestor", "depth").alias("root"))
    return files.join(owner, ["family", "rel"], "left").drop("family")


def audit_index(tree: DataFrame, excluded: list[str] | None = None) -> DataFrame:
    """SRC22: rel, language, length, text, and the first reason for which a file is left out."""
    name = name_of(F.col("rel"))
    language = F.coalesce(F.when(language_of(F.col("rel")) == "tsx", "typescript").otherwise(language_of(F.col("rel"))), F.when(name.isin(*AUDIT_MANIFESTS), "manifest"))
    reason = (
        F.when(name.isin("report.json", "report.md", "report.sarif") | name.rlike(r"\.(reviews|ai-reviews|ai-consent|ai-batches|ai-audit)\.json$"), "output of the analysis")
        .when(path_matches(F.col("rel"), excluded or []), "excluded")
        .when(vendored(F.col("rel")), "vendored")
        .when(F.col("length") > MAX_SOURCE, "exceeds byte cap")
        .when(F.contains(F.col("content").cast("string"), F.lit("\x00")), "binary")
    )
    rows = tree.withColumn("language", language).withColumn("skipped", reason).filter("language IS NOT NULL OR skipped = 'output of the analysis'")
    return rows.select("rel", "language", "length", F.when(F.col("skipped").isNull(), F.col("content").cast("string")).alias("text"), "skipped")


def local_names(files: DataFrame) -> DataFrame:
    """EXT07: (root, name, kind): packages, modules and namespace directories that a Python project has itself."""
    inner = F.regexp_replace("rel", r"^(src|lib)/", "")
    rows = files.filter("language = 'python'").select("root", inner.alias("p"))
    steps = F.split("p", "/")
    package = rows.filter(F.endswith("p", F.lit("/__init__.py"))).select("root", F.regexp_replace(F.regexp_replace("p", r"/__init__\.py$", ""), "/", ".").alias("name"), F.lit("package").alias("kind"))
    module = rows.filter(~F.endswith("p", F.lit("__init__.py")) & (F.size(steps) <= 6)).select("root", F.regexp_replace(F.regexp_replace("p", r"\.py$", ""), "/", ".").alias("name"), F.lit("module").alias("kind"))
    space = rows.filter((F.size(steps) > 1) & (F.size(steps) <= 6)).select("root", steps[0].alias("name"), F.lit("namespace").alias("kind"))
    first = F.row_number().over(Window.partitionBy("root", "name").orderBy(F.when(F.col("kind") == "package", 0).when(F.col("kind") == "module", 1).otherwise(2)))
    return package.union(module).union(space).distinct().withColumn("__k", first).filter("__k = 1").drop("__k")


def frameworks(declared: DataFrame, files: DataFrame) -> DataFrame:
    """EXT08: (project_root, framework): react if declared; next if declared and there is an app or pages directory."""
    names = declared.groupBy("project_root").agg(F.bool_or(F.col("name") == "react").alias("react"), F.bool_or(F.col("name") == "next").alias("next"))
    routed = files.groupBy(F.col("root").alias("project_root")).agg(F.bool_or(F.col("rel").rlike(r"(^|/)(app|pages)/")).alias("routed"))
    rows = names.join(routed, "project_root", "left")
    both = F.filter(F.array(F.when(F.col("react"), "react"), F.when(F.col("next") & F.coalesce("routed", F.lit(False)), "next")), lambda x: x.isNotNull())
    return rows.select("project_root", F.explode(both).alias("framework"))
