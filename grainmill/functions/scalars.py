"""Column functions of the analysis: names, paths, levels, redaction, identities. All stay in the JVM but where said."""

from __future__ import annotations

import fnmatch
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words after which a value is secret, in the order in which they are tried.
SENSITIVE = (
    "api[-_]?key|access[-_]?key|private[-_]?token|auth[-_]?token|session[-_]?token|access[-_]?token|refresh[-_]?token|id[-_]?token|"
    "_auth(?:token)?|_password|token|password|passwd|pwd|secret|authorization|credentials?|auth"
)
# The five rewrites, in order, as (class, Java pattern, replacement).
REDACTIONS = (
    ("url", r"(\b[a-z][a-z0-9+.\-]*://)([^/\s@'\"]{1,384})@", "$1***@"),
    ("header", r"(?im)\b((?:proxy-)?authorization|x-api-key|api-key|x-auth-token|www-authenticate)(\s*[:=]\s*)([^\r\n]+)", "$1$2***"),
    ("quoted", rf"(?i)([\"']?(?:{SENSITIVE})[\"']?\s*[=:]\s*)([\"'])((?:[^\"'\\]|\\.){{1,512}})\2", "$1$2***$2"),
    ("pair", rf"(?i)\b({SENSITIVE})(\s*[=:]\s*)([^&\s'\";,]{{1,512}})", "$1$2***"),
    (
        "token",
        r"\b(?:gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{22,}|xox[baprs]-[A-Za-z0-9-]{10,}|[sr]k_live_[A-Za-z0-9]{20,}"
        r"|AIza[0-9A-Za-z_\-]{35}|(?:A3T[A-Z0-9]|AKIA|ASIA|ABIA|ACCA)[0-9A-Z]{16}|sk-(?:ant-|proj-|svcacct-)?[A-Za-z0-9_\-]{20,})\b",
        "***",
    ),
)
LEVELS = {"red": "error", "yellow": "warning", "blue": "note"}
DEVICES = tuple("con prn aux nul".split()) + tuple(f"{d}{n}" for d in ("com", "lpt") for n in range(1, 10))


def redact(text: Column) -> Column:
    """SC01: the ordered rewrites; applied again they change nothing."""
    for _, pattern, to in REDACTIONS:
        text = F.regexp_replace(text, pattern, to)
    return text


def redact_counts(text: Column) -> Column:
    """SC02: the redacted text and how often each class was rewritten, as a struct."""
    counts = []
    for name, pattern, to in REDACTIONS:
        counts.append(F.regexp_count(text, F.lit(pattern)).alias(name))
        text = F.regexp_replace(text, pattern, to)
    return F.struct(text.alias("text"), *counts)


def redact_struct(columns: list[str]) -> list[Column]:
    """SC05: redaction of every named string column."""
    return [redact(F.col(c)).alias(c) for c in columns]


def masked(line: Column, value: Column, shown: int) -> Column:
    """SC04: every occurrence of the value in the line, cut to its first characters."""
    return F.replace(line, value, F.concat(F.substring(value, 1, shown), F.lit("***")))


def anchor(snippet: Column, title: Column) -> Column:
    """SC06: white space collapsed; an empty snippet gives way to the title."""
    squeeze = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))
    return F.coalesce(F.nullif(squeeze(snippet), F.lit("")), squeeze(title))


def json_text(value: Column) -> Column:
    """A JSON string of text whose characters are ASCII; others are left as they are (ascii_json escapes them, in Python)."""
    quoted = F.regexp_replace(value, r'(["\\])', r"\\$1")
    for raw, escaped in (("\n", "\\\\n"), ("\r", "\\\\r"), ("\t", "\\\\t"), ("\b", "\\\\b"), ("\f", "\\\\f")):
        quoted = F.regexp_replace(quoted, raw if raw != "\b" else "\\x08", escaped)
    return F.concat(F.lit('"'), quoted, F.lit('"'))


@F.pandas_udf(T.StringType())
def ascii_json(value: pd.Series) -> pd.Series:
    """A JSON string with everything but ASCII escaped."""
    return value.map(lambda v: None if v is None else json.dumps(v))


def _canonical(value: Column) -> Column:
    # Python is needed only for text that isn't plain ASCII.
    return json_text(value)


def fingerprint(project_root: Column, file: Column, rule_id: Column, engine: Column, anchor_text: Column, quote=_canonical) -> Column:
    """SC07: SHA-256 of canonical JSON of what names a finding but its line."""
    parts = (("anchor", anchor_text), ("engine", engine), ("file", file), ("project_root", project_root), ("rule_id", rule_id))
    body = []
    for k, (name, col) in enumerate(parts):
        body += [F.lit(("{" if not k else ",") + f'"{name}":'), quote(F.coalesce(col, F.lit("")))]
    return F.sha2(F.concat(*body, F.lit("}")), 256)


def review_id(project: Column, file: Column, line: Column, rule_id: Column, title: Column, engine: Column, quote=_canonical) -> Column:
    """SC08: SHA-256 of a JSON array that names a finding with its line."""
    parts = [quote(project), quote(file), line.cast("string"), quote(rule_id), quote(title), quote(engine)]
    return F.sha2(F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]")), 256)


def digest_id(*parts: Column, size: int = 16) -> Column:
    """SC09: the beginning of the SHA-256 of the parts, joined by a separator that no part holds."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, size)


def claim(text: Column) -> Column:
    """SC09: a claim in lower case with single spaces."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def canonical_name(ecosystem: Column, name: Column) -> Column:
    """SC10, SC11: the name that a registry knows."""
    return F.when(ecosystem == "pypi", F.lower(F.regexp_replace(name, "[-_.]+", "-"))).when(ecosystem == "nuget", F.lower(name)).otherwise(name)


def under(value: Column, prefix: Column, sep: str = ".") -> Column:
    """SC12: equal, or continued at a component's boundary."""
    return (value == prefix) | F.startswith(value, F.concat(prefix, F.lit(sep)))


def glob_regex(pattern: str) -> str:
    """SC13: a glob as a Java pattern that also takes what lies below."""
    plain = pattern.strip("/")
    body = fnmatch.translate(plain).removeprefix("(?s:").removesuffix(r")\Z").removesuffix(r")\z")
    return rf"(?s)^(?:{body}|{re.escape(plain)})(?:/.*)?$"


def path_matches(path: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | path.rlike(glob_regex(p))
    return out


def vendored(path: Column) -> Column:
    """SC14: below a directory of foreign code."""
    return F.arrays_overlap(F.split(path, "/"), F.array(F.lit("vendor"), F.lit("vendored")))


def unsafe_path(path: Column) -> Column:
    """SC15: why a path must not be followed; null if it may."""
    steps = F.split(path, "/")
    return (
        F.when(F.coalesce(path, F.lit("")) == "", "empty")
        .when(F.instr(path, "\x00") > 0, "nul")
        .when(F.instr(path, "\\") > 0, "backslash")
        .when(F.startswith(path, F.lit("/")), "absolute")
        .when(path.rlike("^[A-Za-z]:"), "drive")
        .when(F.array_contains(steps, ".."), "parent")
        .when(F.exists(steps, lambda s: F.lower(F.substring_index(s, ".", 1)).isin(*DEVICES)), "device")
    )


def joined_path(root: Column, path: Column) -> Column:
    """SC16: a path below the repository's root."""
    return F.when(F.coalesce(root, F.lit("")).isin("", "."), path).otherwise(F.concat_ws("/", root, path))


def level_of(level: Column, severity: Column) -> Column:
    """SC17: a level that is there counts only if it is known; severity speaks where none is."""
    return F.when(level.isNotNull(), F.when(level.isin("error", "warning", "note"), level)).otherwise(
        F.when(severity == "red", "error").when(severity == "yellow", "warning").when(severity == "blue", "note")
    )


def gate_action(level: Column, precision: Column, heuristic_errors: str = "review") -> Column:
    """SC18: what a finding does to the verdict."""
    return (
        F.when((level == "error") & (precision == "heuristic"), F.lit(heuristic_errors)).when(level == "error", "block").when(level == "warning", "review").when(level == "note", "informational").otherwise("review")
    )


def effective_level(rule_id: Column, level: Column, overrides: dict[str, str]) -> Column:
    """SC18: the level after the project's policy."""
    out = level
    for rule, to in sorted(overrides.items()):
        out = F.when(rule_id == rule, F.lit(to)).otherwise(out)
    return out


def age_days(at: Column, now: Column) -> Column:
    """SC19: whole days, by elapsed seconds."""
    return F.floor((F.unix_timestamp(now) - F.unix_timestamp(at)) / 86400)


def allowed_minors(first: int, last: int):
    """SC20: the minor versions 3.x that a specifier allows; null for one that can't be read. A pandas UDF."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def run(spec: pd.Series) -> pd.Series:
        from packaging.specifiers import InvalidSpecifier, SpecifierSet

        def one(text):
            try:
                allowed = SpecifierSet(text or "")
            except InvalidSpecifier:
                return None
            return [m for m in range(first, last + 1) if any(allowed.contains(f"3.{m}.{p}") for p in (0, 99))]

        return spec.map(one)

    return run


def size_bucket(value: Column, bounds: list[int], names: list[str]) -> Column:
    """SC22: the first bucket whose bound is above; the last is open."""
    out = F.lit(names[-1])
    for bound, name in reversed(list(zip(bounds, names))):
        out = F.when(value < bound, F.lit(name)).otherwise(out)
    return F.when(value.isNotNull(), out)


def ratio(n: Column, d: Column) -> Column:
    """SC23: numerator, denominator and the value to four places, null over nothing."""
    return F.struct(n.alias("numerator"), d.alias("denominator"), F.bround(F.try_divide(n.cast("double"), d.cast("double")), 4).alias("value"))


@F.pandas_udf(T.StringType())
def utf8_cut(text: pd.Series, most: pd.Series) -> pd.Series:
    """SC24: the longest beginning of at most so many bytes that ends between characters."""
    return pd.Series([None if t is None else t.encode("utf-8", "surrogatepass")[: int(m)].decode("utf-8", "ignore") for t, m in zip(text, most)])


def shown(text: Column, most: int) -> Column:
    """SC25: cut for display, with three dots if something is left out."""
    return F.when(F.char_length(text) > most, F.concat(F.rtrim(F.substring(text, 1, most - 1)), F.lit("…"))).otherwise(text)


def markdown_cell(text: Column) -> Column:
    """SC25: text for a cell of a Markdown table."""
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def internal_name(name: Column, names: list[str], sep: str = ".") -> Column:
    """SC21, SC26: one of the names, or below one of them; the list is a constant of the plan."""
    return F.exists(F.array(*[F.lit(n) for n in names]), lambda p: under(name, p, sep)) if names else F.lit(False)


# What marks a value as a reference to a setting or a store of secrets, rather than a secret itself.
REFERENCE = r"(?i)process\.env|os\.environ|getenv|Environment\.GetEnvironmentVariable|Configuration\s*\[|\.Value\b|SecretClient|GetSecret|key[_-]?vault|\bvault\b|Registry\.Get|Secrets?Manager|\$\{|\$\("


def in_quotes(before: Column) -> Column:
    """Whether what follows `before` on its line is inside a quoted string: an odd number of quotes that no backslash escapes."""
    return F.length(F.regexp_replace(F.regexp_replace(before, r"\\.", ""), "[^\"']", "")) % 2 == 1


def proves_literal(kind: Column, value: Column, before: Column) -> Column:
    """SC03: whether a redacted value was a literal secret. Blank or masked values and references prove nothing; a bare `token_kv` only inside quotes; a null value proves nothing."""
    bare = F.regexp_replace(value, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    nothing = value.isNull() | F.regexp_like(bare, F.lit(r"^\**$")) | F.regexp_like(bare, F.lit(REFERENCE))
    return F.when(kind == "known_token", True).when(nothing, False).when(kind == "token_kv", F.coalesce(in_quotes(before), F.lit(False))).otherwise(True)
