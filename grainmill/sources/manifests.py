"""Declared dependencies from manifests: rows of text in, rows of declarations out.

Line formats and package.json are plain Spark expressions. TOML, XML and setup.py need a parser; each file is parsed once
in a Python worker (mapInPandas) and gives rows; a file that cannot be read gives one row with `problem`, never a failed
task. Output: rel, seq, name, ecosystem, line, raw, skip_registry, registry_name, presence, problem.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.functions.scalars import canonical_name
from grainmill.sources.files import directory_of, name_of
from grainmill.sources.setup_files import SetupFile

SCHEMA = "rel string, seq long, name string, ecosystem string, line int, raw string, skip_registry boolean, registry_name string, presence string, problem string"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
# Groups of package.json in order; beginnings of specifications that no registry serves.
NPM_GROUPS = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")
NPM_LOCAL = r"^(workspace:|file:|link:|portal:|git\+|git:|github:|http://|https://)"
GRADLE = r"""(?:implementation|api|compileOnly|runtimeOnly|testImplementation|testRuntimeOnly|annotationProcessor|kapt|classpath)\s*[\(\s]\s*["']([\w.\-]+:[\w.\-]+)(?::[^"']+)?["']"""
_NAME = re.compile(r"^\s*([A-Za-z0-9][A-Za-z0-9._-]*)")


def _text_lines(texts: DataFrame) -> DataFrame:
    return texts.select("rel", F.posexplode(F.split("text", r"\r?\n")).alias("pos", "raw")).withColumn("line", F.col("pos") + 1)


def _finished(rows: DataFrame) -> DataFrame:
    have = set(rows.columns)
    blank = {"skip_registry": F.lit(False), "registry_name": F.lit(""), "presence": F.lit("definite"), "problem": F.lit(None).cast("string"), "line": F.lit(0)}
    return rows.select(*[F.col(c).cast(t) if c in have else blank[c].cast(t).alias(c) for c, t in (x.split() for x in SCHEMA.split(", "))])


def requirement_lines(texts: DataFrame) -> DataFrame:
    """SRC06: dependencies of requirements files, line by line; a URL or VCS line counts by its #egg only."""
    clean = F.trim(F.regexp_replace("raw", r"(^|\s)#(?!egg=).*$", ""))
    rows = _text_lines(texts).withColumn("t", F.regexp_replace(clean, r"^(-e|--editable)\s+", "")).filter("t <> '' AND NOT startswith(t, '-')")
    head = F.trim(F.substring_index("t", ";", 1))
    url = head.rlike(r"^(git\+|hg\+|svn\+|bzr\+|https?://|file:|ssh://|\.{0,2}/)")
    name = F.when(url, F.regexp_extract("t", r"#egg=([A-Za-z0-9._-]+)", 1)).otherwise(F.regexp_extract(head, r"^([A-Za-z0-9][A-Za-z0-9._-]*)", 1))
    out = rows.withColumn("name", canonical_name(F.lit("pypi"), name)).filter("name <> ''")
    return _finished(out.select("rel", F.col("pos").alias("seq"), "name", F.lit("pypi").alias("ecosystem"), "line", "raw", (url | F.contains(head, F.lit("@"))).alias("skip_registry")))


def requirement_includes(texts: DataFrame) -> DataFrame:
    """SRC06: (src, dst, role) of -r and -c lines, the target relative to the including file; the closure is graphs.reachable."""
    hit = r"^\s*(-r|-c|--requirement(?=[ =])|--constraint(?=[ =]))[ =]*['\"]?([^'\"\s]+)"
    rows = _text_lines(texts).filter(F.col("raw").rlike(hit))
    role = F.when(F.regexp_extract("raw", hit, 1).isin("-c", "--constraint"), "constraint").otherwise("requirement")
    base = directory_of(F.col("rel"))
    target = F.regexp_extract("raw", hit, 2)
    joined = F.when(base == ".", target).otherwise(F.concat(base, F.lit("/"), target))
    for _ in range(4):
        joined = F.regexp_replace(F.regexp_replace(joined, r"(^|/)\./", "$1"), r"(^|/)(?!\.\.)[^/]+/\.\./", "$1")
    return rows.select(F.col("rel").alias("src"), joined.alias("dst"), role.alias("role"))


def requirement_closure(files: DataFrame, includes: DataFrame) -> DataFrame:
    """SRC06: (root, rel, role, depth): what each file (rel) takes in, with the role in which it comes, at its least depth.

    What comes through a constraint is a constraint, so a file is met once in each role, and a cycle ends in each.
    """
    from grainmill.operators.graphs import reachable

    node = lambda rel, role: F.concat_ws("\0", rel, role)
    plain = includes.select(node(F.col("src"), F.lit("requirement")).alias("src"), node(F.col("dst"), F.col("role")).alias("dst"))
    bound = includes.select(node(F.col("src"), F.lit("constraint")).alias("src"), node(F.col("dst"), F.lit("constraint")).alias("dst"))
    found = reachable(files.select(F.col("rel").alias("root"), node(F.col("rel"), F.lit("requirement")).alias("node")), plain.union(bound).distinct())
    return found.select("root", F.substring_index("node", "\0", 1).alias("rel"), F.substring_index("node", "\0", -1).alias("role"), "depth")


def npm_dependencies(texts: DataFrame) -> DataFrame:
    """SRC09: the four groups of package.json in order, the first of a name wins; npm: aliases name what the registry knows."""
    groups = F.from_json("text", ", ".join(f"{g} MAP<STRING, STRING>" for g in NPM_GROUPS), {"mode": "PERMISSIVE"})
    rows = texts.withColumn("g", groups)
    none = F.array().cast("array<struct<k:int,grp:string,name:string,spec:string>>")

    def entries(k: int, group: str):
        return F.coalesce(F.transform(F.map_entries(F.col("g")[group]), lambda e: F.struct(F.lit(k).alias("k"), F.lit(group).alias("grp"), e["key"].alias("name"), e["value"].alias("spec"))), none)

    parts = F.flatten(F.array(*[entries(k, g) for k, g in enumerate(NPM_GROUPS)]))
    flat = rows.select("rel", F.posexplode(parts).alias("seq", "d")).select("rel", "seq", "d.*")
    first = flat.groupBy("rel", "name").agg(F.min(F.struct("k", "seq", "grp", "spec")).alias("d")).select("rel", "name", "d.*")
    alias = F.when(F.startswith("spec", F.lit("npm:")), F.regexp_replace(F.regexp_replace("spec", "^npm:", ""), r"(?<=.)@[^@]*$", "")).otherwise("")
    out = first.select("rel", "seq", "name", F.lit("npm").alias("ecosystem"), F.concat("grp", F.lit(": "), "name", F.lit("@"), "spec").alias("raw"), F.col("spec").rlike(NPM_LOCAL).alias("skip_registry"), alias.alias("registry_name"))
    return _finished(out)


def gradle_dependencies(texts: DataFrame) -> DataFrame:
    """SRC11: coordinates in Gradle scripts."""
    found = F.posexplode(F.regexp_extract_all("text", F.lit(GRADLE), F.lit(1))).alias("seq", "name")
    return _finished(texts.select("rel", found).select("rel", "seq", "name", F.lit("maven").alias("ecosystem"), F.col("name").alias("raw")))


def _row(rel, seq, name, ecosystem, raw, line=0, skip=False, presence="definite", problem=None):
    return (rel, seq, name, ecosystem, line, raw, skip, "", presence, problem)


def _pep508(text: str) -> tuple[str, bool] | None:
    m = _NAME.match(text)
    return (re.sub(r"[-_.]+", "-", m.group(1)).lower(), "@" in text.split(";")[0]) if m else None


def _toml_names(text: str):
    """SRC07, SRC08: (raw, skip) of PEP 621, dependency groups, Poetry and Pipfile tables."""
    import tomllib

    data = tomllib.loads(text)
    project = data.get("project", {}) if isinstance(data.get("project"), dict) else {}
    lists = [project.get("dependencies"), *(project.get("optional-dependencies") or {}).values(), *(data.get("dependency-groups") or {}).values()]
    for entries in lists:
        for e in entries if isinstance(entries, list) else []:
            if isinstance(e, str):
                yield e, False
    poetry = data.get("tool", {}).get("poetry", {}) if isinstance(data.get("tool"), dict) else {}
    tables = [poetry.get("dependencies"), poetry.get("dev-dependencies"), *(g.get("dependencies") for g in (poetry.get("group") or {}).values() if isinstance(g, dict)), data.get("packages"), data.get("dev-packages")]
    for table in tables:
        for name, spec in table.items() if isinstance(table, dict) else ():
            if name.lower() != "python":
                yield name, isinstance(spec, dict) and any(k in spec for k in ("path", "git", "url", "file"))


def _xml(text: str):
    """The root of an XML document without DTD or entities."""
    from xml.etree import ElementTree

    if re.search(r"<!(DOCTYPE|ENTITY)", text, re.IGNORECASE):
        raise ValueError("a DTD or entity is not read")
    return ElementTree.fromstring(text)


def _local(tag) -> str:
    return tag.rsplit("}", 1)[-1] if isinstance(tag, str) else ""


def _xml_names(name: str, text: str):
    """SRC11, SRC12, SRC13: (name, ecosystem, op, definite, skip) of POM, MSBuild and packages.config files."""
    root = _xml(text)
    if name == "pom.xml":
        for dep in (e for e in root.iter() if _local(e.tag) == "dependency"):
            parts = {_local(c.tag): (c.text or "").strip() for c in dep}
            full = f"{parts.get('groupId', '')}:{parts.get('artifactId', '')}"
            yield full, "maven", "Include", True, "${" in full
    elif name.lower() == "packages.config":
        for e in root.iter():
            if _local(e.tag) == "package" and e.get("id"):
                yield e.get("id"), "nuget", "Include", True, False
    else:

        def walk(node, sure):
            for child in node:
                own = sure and not child.get("Condition") and _local(child.tag) not in ("When", "Otherwise")
                if _local(child.tag) == "PackageReference":
                    for op in ("Include", "Remove", "Update"):
                        for part in (child.get(op) or "").split(";"):
                            if part.strip():
                                yield part.strip(), "nuget", op, own and "$(" not in part, "$(" in part
                else:
                    yield from walk(child, own)

        yield from walk(root, not root.get("Condition"))


def _parsed(frames):
    for frame in frames:
        rows = []
        for rel, text in zip(frame["rel"], frame["text"]):
            name = rel.rsplit("/", 1)[-1]
            own = []
            try:
                if name in ("pyproject.toml", "Pipfile"):
                    for k, (raw, skip) in enumerate(_toml_names(text)):
                        if dep := _pep508(raw):
                            own.append(_row(rel, k, dep[0], "pypi", raw, skip=skip or dep[1]))
                elif name == "setup.py":
                    setup = SetupFile(text)
                    for k, (raw, line) in enumerate(setup.found):
                        if dep := _pep508(raw):
                            own.append(_row(rel, k, dep[0], "pypi", raw, skip=dep[1], line=line))
                    own += [_row(rel, len(setup.found) + k, None, None, None, problem=f"incomplete: {what}") for k, what in enumerate(setup.incomplete)]
                elif name.endswith((".xml", ".csproj", ".props", ".config")):
                    for k, (dep, eco, op, sure, skip) in enumerate(_xml_names(name, text)):
                        own.append(_row(rel, k, dep, eco, op, skip=skip, presence="definite" if sure else "possible"))
            except Exception as e:  # a broken manifest is a row, not a failed task
                own = [_row(rel, 0, None, None, None, problem=f"{type(e).__name__}: {str(e)[:120]}")]
            rows += own
        yield pd.DataFrame(rows, columns=COLUMNS).astype({"line": "int32", "seq": "int64"})


def parsed_manifests(texts: DataFrame) -> DataFrame:
    """SRC07, SRC08, SRC11, SRC12, SRC13: rows of the formats that need a parser. MSBuild events keep their operation in `raw`."""
    return texts.filter("text IS NOT NULL").select("rel", "text").mapInPandas(_parsed, SCHEMA)


def declared_dependencies(manifests: DataFrame) -> DataFrame:
    """All declarations of `manifests` (rel, text), MSBuild events folded to what is declared in the end."""
    from grainmill.operators.windows import fold_items

    texts = manifests.filter("text IS NOT NULL")
    name = name_of(F.col("rel"))
    lines = requirement_lines(texts.filter(name.rlike(r"^requirements.*\.txt$")))
    npm = npm_dependencies(texts.filter(name == "package.json"))
    gradle = gradle_dependencies(texts.filter(name.isin("build.gradle", "build.gradle.kts")))
    parsed = parsed_manifests(texts.filter(name.isin("pyproject.toml", "Pipfile", "setup.py", "pom.xml", "packages.config") | F.endswith(name, F.lit(".csproj")) | F.endswith(name, F.lit(".props"))))
    msbuild = parsed.filter((F.col("ecosystem") == "nuget") & F.col("raw").isin("Include", "Remove", "Update"))
    events = msbuild.select("rel", "name", "seq", F.col("raw").alias("op"), (F.col("presence") == "definite").alias("definite"))
    folded = fold_items(events, ["rel", "name"]).join(msbuild.groupBy("rel", "name").agg(F.min("seq").alias("seq"), F.bool_or("skip_registry").alias("skip_registry")), ["rel", "name"])
    folded = _finished(folded.select("rel", "seq", "name", F.lit("nuget").alias("ecosystem"), F.col("name").alias("raw"), "skip_registry", "presence"))
    rest = parsed.filter("ecosystem IS NULL OR ecosystem <> 'nuget' OR raw NOT IN ('Include', 'Remove', 'Update')")
    return lines.unionByName(npm).unionByName(gradle).unionByName(rest).unionByName(folded)


def env_lines(texts: DataFrame) -> DataFrame:
    """SRC14: (rel, line, name, value) of .env files."""
    rows = _text_lines(texts).filter(F.contains("raw", F.lit("=")))
    return rows.select("rel", "line", F.trim(F.substring_index("raw", "=", 1)).alias("name"), F.regexp_replace("raw", "^[^=]*=", "").alias("value"))


def tsconfig_aliases(texts: DataFrame) -> DataFrame:
    """SRC10: (rel, prefix, target) of `paths`; comments go outside of strings only."""
    plain = F.regexp_replace(F.regexp_replace("text", r'("(?:[^"\\]|\\.)*")|//[^\n]*|(?s:/\*.*?\*/)', "$1"), r",(\s*[}\]])", "$1")
    parsed = F.from_json(plain, "compilerOptions STRUCT<baseUrl: STRING, paths: MAP<STRING, ARRAY<STRING>>>")
    rows = texts.select("rel", parsed.alias("c")).select("rel", F.explode("c.compilerOptions.paths").alias("prefix", "targets"))
    return rows.select("rel", F.regexp_replace("prefix", r"\*$", "").alias("prefix"), F.regexp_replace(F.col("targets")[0], r"\*$", "").alias("target"))
