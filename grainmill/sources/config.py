"""SRC17, SRC20: settings of a repository and files of rule descriptors, read strictly.

Each file is parsed in a task into entries: one row for every key, list item and table entry, with its type. What may stand where
is a table of keys; problems are what entries and that table don't agree on. A problem names the field and the reason, never a
value or an unknown key, which may hold a secret. A file with a problem gives no settings and no descriptors at all.

Defined results: a null or missing file is an empty one, which has no version and so a problem. Repeated items count once, in the
order of their first. Files that can't be parsed have the one problem `syntax`.
"""

from __future__ import annotations

import json
import tomllib

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ENTRY = "rel string, key string, sub string, at int, kind string, text string"

# Keys and what they hold, the first version that knows them, ecosystems, levels.
KEYS = [
    ("schema_version", "integer", 1), ("exclude_paths", "paths", 1), ("dependency_exclude_paths", "paths", 1), ("npm_roots", "roots", 1),
    ("runtime_builtins", "names", 1), ("internal_packages", "names", 1), ("complexity_threshold", "integer", 1), ("policy", "policy", 2), ("rule_levels", "levels", 2),
]
ECOSYSTEMS = ("npm", "pypi", "nuget", "maven", "python")
LEVELS = ("error", "warning", "note")
LANGUAGES = [("python", "python"), ("typescript", "typescript"), ("javascript", "typescript"), ("java", "java"), ("csharp", "csharp")]
SEVERITIES = [("ERROR", "error"), ("WARNING", "warning"), ("INFO", "note")]
RULE_ID = "^[A-Za-z][A-Za-z0-9:._-]{0,63}$"


def _kind(value) -> str:
    return {bool: "boolean", int: "integer", str: "string", list: "list", dict: "table"}.get(type(value), "other")


def _entries(rel: str, key: str, value):
    """A key, and below it the items of a list, the entries of a table and the items of lists in these."""
    yield rel, key, None, None, _kind(value), None if isinstance(value, (list, dict)) else str(value)
    for sub, inner in value.items() if isinstance(value, dict) else [("", value)] if isinstance(value, list) else []:
        if isinstance(value, dict):
            yield rel, key, str(sub), None, _kind(inner), None if isinstance(inner, (list, dict)) else str(inner)
        for at, item in enumerate(inner) if isinstance(inner, list) else []:
            yield rel, key, str(sub), at, _kind(item), None if isinstance(item, (list, dict)) else str(item)


def _toml(frames):
    for frame in frames:
        rows = []
        for rel, text in zip(frame["rel"], frame["text"]):
            try:
                rows += [e for key, value in tomllib.loads(text or "").items() for e in _entries(rel, key, value)]
                rows.append((rel, "", None, None, "file", None))
            except (tomllib.TOMLDecodeError, RecursionError):
                rows.append((rel, "", None, None, "broken", None))
        yield pd.DataFrame(rows, columns=["rel", "key", "sub", "at", "kind", "text"]).astype({"at": "Int32"})


def entries(texts: DataFrame) -> DataFrame:
    """ENTRY rows of TOML files (rel, text); one row of kind `file` or `broken` for each."""
    return texts.select("rel", "text").mapInPandas(_toml, ENTRY)


def _bad_path(text):
    """Why a path can't be one of the repository; null if it can."""
    path = F.rtrim(F.trim(text), F.lit("/"))
    parts = F.split(path, "/")
    return (
        F.when(path == "", "an empty path").when(F.contains(path, F.lit("\\")), "a backslash").when(F.contains(path, F.lit(":")), "a colon").when(F.startswith(path, F.lit("/")), "an absolute path")
        .when(F.array_contains(parts, ".."), "a step upwards").when(F.array_contains(parts, ""), "an empty step")
    )


def setting_problems(found: DataFrame, folders: DataFrame) -> DataFrame:
    """rel, field, reason: what is wrong with settings. found: entries; folders: (root, folder), the directories of each file's repository, where `root` is the file's directory."""
    spark = found.sparkSession
    known = F.broadcast(spark.createDataFrame(KEYS, "key string, holds string, since int"))
    version = found.filter("key = 'schema_version' AND sub IS NULL").select("rel", F.when((F.col("kind") == "integer") & F.col("text").isin("1", "2"), F.col("text").cast("int")).alias("version"))
    whole = found.filter("kind = 'file'").select("rel").join(version, "rel", "left")
    out = [
        found.filter("kind = 'broken'").select("rel", F.lit("").alias("field"), F.lit("syntax").alias("reason")),
        whole.filter("version IS NULL").select("rel", F.lit("schema_version"), F.lit("must be 1 or 2")),
    ]
    rows = found.filter("kind NOT IN ('file', 'broken')").join(version.filter("version IS NOT NULL"), "rel").join(known, "key", "left")
    strange = F.col("holds").isNull() | (F.col("since") > F.col("version"))
    unknown = rows.filter(strange & F.col("sub").isNull()).groupBy("rel").agg(F.count("*").alias("n"))
    out.append(unknown.select("rel", F.lit("").alias("field"), F.concat(F.col("n").cast("string"), F.lit(" unknown keys"))))
    rows = rows.filter(~strange)
    top, below, items = F.col("sub").isNull(), F.col("sub").isNotNull() & F.col("at").isNull(), F.col("at").isNotNull()
    holds, kind, text = F.col("holds"), F.col("kind"), F.col("text")
    n = text.try_cast("bigint")
    bad_path = _bad_path(text)
    reason = (
        F.when(top & (F.col("key") == "complexity_threshold") & ((kind != "integer") | ~F.coalesce(n.between(1, 100), F.lit(False))), "must be a whole number from 1 to 100")
        .when(top & holds.isin("paths", "roots") & (kind != "list"), "must be a list of texts").when(top & holds.isin("names", "policy", "levels") & (kind != "table"), "must be a table")
        .when(items & holds.isin("paths", "roots") & (kind != "string"), "must be a list of texts").when(items & holds.isin("paths", "roots"), bad_path)
        .when(below & (holds == "names") & ~F.col("sub").isin(*ECOSYSTEMS), "unknown ecosystem").when(below & (holds == "names") & (kind != "list"), "must be lists of texts")
        .when(items & (holds == "names") & ((kind != "string") | (F.trim(text) == "")), "must be lists of texts")
        .when(below & (holds == "policy") & (F.col("sub") != "heuristic_errors"), "unknown key").when(below & (holds == "policy") & ~((kind == "string") & text.isin("review", "block")), "must be review or block")
        .when(below & (holds == "levels") & ~F.col("sub").rlike(RULE_ID), "invalid rule id").when(below & (holds == "levels") & ~((kind == "string") & text.isin(*LEVELS)), "must be error, warning or note")
    )
    out.append(rows.select("rel", F.col("key").alias("field"), reason.alias("reason")).filter("reason IS NOT NULL"))
    roots = rows.filter(items & (holds == "roots") & (kind == "string") & bad_path.isNull()).select("rel", "key", text.alias("text"), F.rtrim(F.trim(text), F.lit("/")).alias("folder"), F.regexp_replace("rel", "/?[^/]*$", "").alias("root"))
    globs = roots.filter(F.col("text").rlike(r"[*?\[]"))
    out.append(globs.select("rel", "key", F.lit("a pattern")))
    out.append(roots.filter(~F.col("text").rlike(r"[*?\[]")).join(folders.select("root", "folder").distinct(), ["root", "folder"], "left_anti").select("rel", "key", F.lit("no such directory")))
    whole = out[0]
    for more in out[1:]:
        whole = whole.union(more)
    return whole.distinct()


def settings(found: DataFrame, problems: DataFrame) -> DataFrame:
    """rel, key, sub, at, text of the files without problems; lists without repeats, numbered anew."""
    rows = found.filter("kind IN ('string', 'integer') AND key <> 'schema_version'").join(problems.select("rel").distinct(), "rel", "left_anti")
    path = F.col("key").isin("exclude_paths", "dependency_exclude_paths", "npm_roots")
    rows = rows.withColumn("text", F.when(path, F.rtrim(F.trim("text"), F.lit("/"))).otherwise(F.trim("text")))
    once = rows.groupBy("rel", "key", "sub", "text").agg(F.min("at").alias("at"))
    # One list of one file is a few lines.
    return once.withColumn("at", F.when(F.col("at").isNotNull(), F.row_number().over(Window.partitionBy("rel", "key", "sub").orderBy("at")) - 1)).select("rel", "key", "sub", "at", "text")


# -- rule files ---------------------------------------------------------------------------------------------------------------

RULE = "rel string, at int, fields map<string, string>, languages array<string>, n_languages int, odd string"


def _rules(frames):
    try:
        import yaml

        read, errors = yaml.safe_load, (yaml.YAMLError, RecursionError, ValueError)
    except ImportError:  # JSON is a part of YAML
        read, errors = json.loads, (ValueError, RecursionError)
    for frame in frames:
        rows = []
        for rel, text in zip(frame["rel"], frame["text"]):
            try:
                data = read(text or "")
            except errors:
                data = None
            found = data.get("rules") if isinstance(data, dict) else None
            if not isinstance(found, list):
                rows.append((rel, -1, {}, [], 0, "no list of rules"))
                continue
            rows.append((rel, -1, {}, [], 0, None))
            for at, rule in enumerate(found):
                if not isinstance(rule, dict):
                    rows.append((rel, at, {}, [], 0, "no table"))
                    continue
                meta = rule.get("metadata")
                fields = {k: v for k, v in [*((k, rule.get(k)) for k in ("id", "message", "severity")), ("precision", next((v for k, v in meta.items() if str(k).endswith("-precision")), None) if isinstance(meta, dict) else None)] if isinstance(v, str)}
                languages = rule.get("languages") if isinstance(rule.get("languages"), list) else []
                rows.append((rel, at, fields, [x for x in languages if isinstance(x, str)], len(languages), None))
        yield pd.DataFrame(rows, columns=["rel", "at", "fields", "languages", "n_languages", "odd"]).astype({"at": "int32", "n_languages": "int32"})


def rules(texts: DataFrame) -> DataFrame:
    """RULE rows of YAML or JSON files (rel, text), and one with `at` -1 for each file."""
    return texts.select("rel", "text").mapInPandas(_rules, RULE)


def rule_problems(found: DataFrame) -> DataFrame:
    """rel, at, reason: why a file's rules can't be taken; `at` is the rule's place, -1 the file."""
    field = lambda name: F.trim(F.coalesce(F.col("fields")[name], F.lit("")))
    known = F.array(*[F.lit(name) for name, _ in LANGUAGES])
    checks = {
        "id": field("id") == "", "message": field("message") == "", "severity": ~F.coalesce(F.col("fields")["severity"], F.lit("")).isin(*[s for s, _ in SEVERITIES]), "precision": ~F.coalesce(F.col("fields")["precision"], F.lit("")).isin("exact", "heuristic"),
        "languages": (F.col("n_languages") == 0) | (F.size("languages") < F.col("n_languages")) | (F.size(F.array_except("languages", known)) > 0),
    }
    sound = found.filter("at >= 0 AND odd IS NULL")
    broken = sound.select("rel", "at", F.explode(F.filter(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks.items()]), lambda x: x.isNotNull())).alias("reason"))
    again = sound.filter(field("id") != "").groupBy("rel", field("id").alias("id")).agg(F.count("*").alias("n"), F.max("at").alias("at")).filter("n > 1")
    return found.filter("odd IS NOT NULL").select("rel", "at", F.col("odd").alias("reason")).union(broken).union(again.select("rel", "at", F.lit("repeated id")))


def descriptors(found: DataFrame, problems: DataFrame) -> DataFrame:
    """rule_id, title, level, precision, languages (sorted), rel: of files in which every rule is sound; one bad rule closes its file."""
    named = F.create_map(*[F.lit(x) for pair in LANGUAGES for x in pair])
    level = F.create_map(*[F.lit(x) for pair in SEVERITIES for x in pair])
    rows = found.filter("at >= 0").join(problems.select("rel").distinct(), "rel", "left_anti")
    f = F.col("fields")
    return rows.select(F.concat(F.lit("S:"), F.trim(f["id"])).alias("rule_id"), F.trim(f["message"]).alias("title"), level[f["severity"]].alias("level"), f["precision"].alias("precision"), F.array_sort(F.array_distinct(F.transform("languages", lambda x: named[x]))).alias("languages"), "rel")
