"""Facts and rule hits of source files: each file is parsed once in a Python worker and gives rows.

Python files go through `ast` and `tokenize`. Java, C#, TypeScript and TSX go through a small lexer that blanks comments and
strings (keeping places), and patterns over what is left. A file that cannot be parsed gives one `parse_error` row and
still its line facts; no file fails a task. Output: rel, kind, line, name, detail.

Kinds: import (name: module, detail: top level), complexity (name: function, detail: number), comment, unit (name: function,
detail: last line), edge (module specifier of TS), endpoint, client (file is marked as client code), `if-client N…` (a hit
if the file is client code by who imports it, see operators/modules.py), and rule hits
P001 P007 R006 N001 N002 N003 N004 N005 J001 J002 D001 D002 and S:…. Rules that follow scopes and names are in operators/flow.py.
"""

from __future__ import annotations

import ast
import io
import re
import tokenize
from bisect import bisect_right
from collections.abc import Collection
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.sources.batches import map_rows

SCHEMA = "rel string, kind string, line int, name string, detail string"

# Patterns of the rules.
MARKERS = re.compile(
    r"(?i)(in a real (?:app|application|project|system)|TODO\b:?|FIXME\b:?|HACK\b:?|\bXXX\b|not implemented|for demo purposes|"
    r"in production,? you (?:would|should)|placeholder (?:implementation|logic|value|code|for now)|"
    r"(?:temporary|temp) (?:stub|placeholder|implementation|hack)|stubbed? out|just a (?:stub|placeholder)|"
    r"simplified (?:for|version)|replace (?:this )?with (?:your|actual|real)|left as an exercise|mock implementation)"
)
SERVER_ONLY = frozenset("fs node:fs fs/promises child_process node:child_process net node:net server-only next/headers".split())
RESOURCES = "FileInputStream|FileOutputStream|FileReader|FileWriter|BufferedReader|BufferedWriter|Scanner|PrintWriter|Socket|ServerSocket|RandomAccessFile"
HOOKS = r"use(?:State|Effect|Memo|Callback|Ref|Reducer|Context|LayoutEffect)"
PUBLIC_NAME = re.compile(r"NEXT_PUBLIC_\w*(?:SECRET|TOKEN|PASSWORD|PRIVATE|API_?KEY)\w*")
PUBLIC_SAFE = re.compile(r"PUBLISHABLE|PUBLIC_KEY|ANON")
BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.Assert, ast.comprehension)


def blanked(text: Code) -> tuple[Code, list[tuple[int, str]]]:
    """Text with comments and string bodies as blanks, and the comments with their line."""
    comments: list[tuple[int, str]] = []

    def blank(m: re.Match) -> str:
        s = m.group(0)
        if s.startswith(("//", "/*")):
            first = text.line(m.start())
            comments.extend((first + k, part) for k, part in enumerate(s.split("\n")))
            return re.sub(r"[^\n]", " ", s)
        return s[0] + re.sub(r"[^\n]", " ", s[1:-1]) + s[-1] if len(s) > 1 else s

    return Code(re.sub(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`", blank, text, flags=re.DOTALL)), comments


def _python(text: str):
    try:
        for token in tokenize.generate_tokens(io.StringIO(text).readline):
            if token.type == tokenize.COMMENT:
                yield "comment", token.start[0], "", token.string
                if MARKERS.search(token.string):
                    yield "P007", token.start[0], "", token.string[:120]
    except (tokenize.TokenError, IndentationError, SyntaxError):
        pass
    tree = ast.parse(text)
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            for a in node.names:
                yield "import", node.lineno, a.name, a.name.split(".")[0]
        elif isinstance(node, ast.ImportFrom) and node.module and not node.level:
            yield "import", node.lineno, node.module, node.module.split(".")[0]
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            own = 1
            todo = list(ast.iter_child_nodes(node))
            while todo:
                n = todo.pop()
                if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                    continue
                own += isinstance(n, BRANCHES) + (len(n.values) - 1 if isinstance(n, ast.BoolOp) else 0) + (len(n.cases) if isinstance(n, ast.Match) else 0)
                todo += ast.iter_child_nodes(n)
            yield "complexity", node.lineno, node.name, str(own)
            yield "unit", node.lineno, node.name, str(node.end_lineno)
        elif isinstance(node, ast.ExceptHandler):
            if all(isinstance(s, ast.Pass) or (isinstance(s, ast.Expr) and isinstance(s.value, ast.Constant) and s.value.value is ...) for s in node.body):
                yield "P001", node.lineno, "", "the exception is swallowed"
        elif isinstance(node, ast.Call):
            name = getattr(node.func, "attr", None) or getattr(node.func, "id", "")
            base = getattr(getattr(node.func, "value", None), "id", "")
            if name in ("eval", "exec") and not base and node.args and not isinstance(node.args[0], ast.Constant):
                yield "S:python-eval-input", node.lineno, name, "dynamic code"
            if base == "pickle" and name in ("load", "loads"):
                yield "S:python-pickle-load", node.lineno, name, "untrusted pickle"


class Code(str):
    """Text that knows its lines and braces; both are found once."""

    @cached_property
    def ends(self) -> list[int]:
        return [m.start() for m in re.finditer("\n", self)]

    @cached_property
    def closing(self) -> dict[int, int]:
        """Where the brace that opens at a place closes."""
        out, stack = {}, []
        for m in re.finditer("[{}]", self):
            if m.group() == "{":
                stack.append(m.start())
            elif stack:
                out[stack.pop()] = m.start()
        return out

    def line(self, at: int) -> int:
        return bisect_right(self.ends, at - 1) + 1


def _lines(pattern: str, code: Code, flags: int = 0):
    for m in re.finditer(pattern, code, flags):
        yield code.line(m.start()), m


def _curly(text: Code, language: str):
    code, comments = blanked(text)
    for line, part in comments:
        yield "comment", line, "", part
        if MARKERS.search(part):
            yield "P007", line, "", part.strip()[:120]
    for line, _ in _lines(r"\bcatch\s*(?:\([^)]*\))?\s*\{\s*\}", code):
        yield "P001", line, "", "the exception is swallowed"
    heads = {"java": r"(?m)^\s*(?:public|private|protected|static|final|synchronized|\s)+[\w<>\[\], ]+\s+(\w+)\s*\([^;{]*\)[^;{]*\{", "csharp": r"(?m)^\s*(?:public|private|protected|internal|static|async|virtual|override|\s)+[\w<>\[\], ?]+\s+(\w+)\s*\([^;{]*\)[^;{]*\{"}
    for line, m in _lines(heads.get(language, r"\bfunction\s+(\w+)\s*\([^)]*\)[^{;]*\{|(?:const|let)\s+(\w+)\s*=\s*(?:async\s*)?\([^)]*\)[^={;]*=>\s*\{"), code):
        at = code.closing.get(m.end() - 1, len(code) - 1) + 1
        body = code[m.end() : at]
        name = next(g for g in m.groups() if g)
        yield "complexity", line, name, str(1 + len(re.findall(r"\b(?:if|for|while|case|catch)\b|&&|\|\||\?(?![.?:])", body)))
        yield "unit", line, name, str(code.line(at))
    if language == "java":
        for line, m in _lines(r"\bimport\s+(?:static\s+)?([\w.]+)(?:\.\*)?\s*;", code):
            steps = m.group(1).split(".")
            keep = steps[: next((k for k, s in enumerate(steps) if s[:1].isupper()), len(steps))]
            yield "import", line, m.group(1), ".".join(keep) or m.group(1)
        for line, _ in _lines(r"[!=]=\s*\"|\"\s*[!=]=", code):
            yield "J001", line, "", "identity of strings"
        for line, m in _lines(rf"(try\s*\([^)]*)?\bnew\s+({RESOURCES})\b", code):
            if not m.group(1):
                yield "J002", line, m.group(2), "opened outside try-with-resources"
        for line, _ in _lines(r"getRuntime\(\)\s*\.exec\([^)]*\+", code):
            yield "S:java-runtime-exec-concat", line, "", "command is composed"
    elif language == "csharp":
        for line, m in _lines(r"\busing\s+(?:static\s+)?(?:\w+\s*=\s*)?([A-Za-z_][\w.]*)\s*;", code):
            yield "import", line, m.group(1), ".".join(m.group(1).split(".")[:2])
        for line, m in _lines(r"\basync\s+void\s+(\w+)\s*\(([^)]*)\)", code):
            if not ("sender" in m.group(2) and "EventArgs" in m.group(2)):
                yield "D001", line, m.group(1), "cannot be awaited"
        for line, _ in _lines(r"\w*Async\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)\s*\.(?:Result\b|Wait\()|GetAwaiter\(\)\s*\.GetResult\(", code):
            yield "D002", line, "", "blocks on a task"
        for line, m in _lines(r"\.Map(Get|Post|Put|Delete|Patch)\(\s*\"([^\"]*)\"|\[Http(Get|Post|Put|Delete|Patch)(?:\(\"([^\"]*)\"\))?\]", text):
            yield "endpoint", line, (m.group(1) or m.group(3)).upper(), m.group(2) or m.group(4) or ""
    else:
        yield from _typescript(text, code)
    for line, _ in _lines(r"(?i)\b(md5|sha-?1)\s*[(.]", text):
        yield "S:weak-hash", line, "", "weak hash"


def _typescript(text: Code, code: Code):
    client = re.match(r"\s*(?:(?:'[^'\n]*'|\"[^\"\n]*\")\s*;?\s*)*?(?:'use client'|\"use client\")", re.sub(r"//[^\n]*|/\*.*?\*/", "", text, flags=re.DOTALL)) is not None
    if client:
        yield "client", 1, "", ""
    for line, m in _lines(r"(import|export)\s+(type\s+)?[^'\";]*?from\s*['\"]([^'\"]+)['\"]|import\s*['\"]([^'\"]+)['\"]|(?:require|import)\(\s*['\"]([^'\"]+)['\"]\s*\)", text):
        spec = m.group(3) or m.group(4) or m.group(5)
        if not m.group(2):
            yield "edge", line, spec, ""
        if not spec.startswith((".", "@/", "~/", "#", "/")):
            steps = spec.split("/")
            yield "import", line, spec, "/".join(steps[:2]) if spec.startswith("@") else steps[0]
            if spec in SERVER_ONLY:
                yield "N004" if client else "if-client N004", line, spec, "server module in client code"
    for line, m in _lines(r"process\.env\.(\w+)", code):
        name = m.group(1)
        if PUBLIC_NAME.fullmatch(name) and not PUBLIC_SAFE.search(name):
            yield "N001", line, name, "secret-like name in the public bundle"
        elif not name.startswith("NEXT_PUBLIC_") and name not in ("NODE_ENV", "NEXT_RUNTIME"):
            yield "N002" if client else "if-client N002", line, name, "private variable in client code"
    for line, m in _lines(rf"\b({HOOKS})\b\s*[<(]|\bon[A-Z]\w+=\{{|\b(?:window|document|localStorage)\.", code):
        if not client:
            yield "N003", line, m.group(1) or m.group(0)[:20], "client API in a file that isn't marked"
    for line, m in _lines(r"export\s+default\s+async\s+function\s+(\w*)", code):
        yield "N005" if client else "if-client N005", line, m.group(1), "async client component"
    for line, m in _lines(r"\.map\(\s*\(?\s*\w+\s*,\s*(\w+)[^=]*=>", code):
        key = re.search(rf"key=\{{\s*{m.group(1)}\s*\}}", code[m.end() : m.end() + 400])
        if key:
            yield "R006", code.line(m.end() + key.start()), m.group(1), "index as key"
    for line, m in _lines(r"\bexec(?:Sync)?\(\s*`[^`]*\$\{", text):
        yield "S:js-child-process-concat", line, "", "command is composed"


def file_facts(rel: str, language: str, content: bytes | None) -> list[tuple]:
    text = Code((content or b"").decode("utf-8", "replace"))
    rows: list[tuple] = []
    try:
        for kind, line, name, detail in _python(text) if language == "python" else _curly(text, language):
            rows.append((rel, kind, line, name, detail))
    except (SyntaxError, ValueError, RecursionError) as e:
        rows.append((rel, "parse_error", 0, type(e).__name__, ""))
    if language == "python":
        rows += [(rel, "S:weak-hash", k, "", "weak hash") for k, _ in _lines(r"(?i)\b(md5|sha-?1)\s*[(.]", text)]
    return rows


def extract(files: DataFrame, kinds: Collection[str] | None = None) -> DataFrame:
    """EXT01-EXT12 and the syntax rules: all facts of `files` (rel, language, content, skipped), one parse of each file; kinds: only these leave Python."""
    kept = None if kinds is None else frozenset(kinds)
    found = lambda files: (row for file in files for row in file_facts(*file) if kept is None or row[1] in kept)
    return map_rows(files.filter("skipped IS NULL").select("rel", "language", "content"), found, SCHEMA)


def source_lines(files: DataFrame) -> DataFrame:
    """EXT02: (rel, line, text), without an empty line after a last newline."""
    text = F.col("content").cast("string")
    lines = F.split(F.regexp_replace(text, r"(\r\n|\n|\r)\z", ""), r"\r\n|\n|\r")
    return files.filter("skipped IS NULL AND length > 0").select("rel", F.posexplode(lines).alias("pos", "text")).select("rel", (F.col("pos") + 1).alias("line"), "text")


def too_complex(facts: DataFrame, most: int = 10) -> DataFrame:
    """P006."""
    return facts.filter((F.col("kind") == "complexity") & (F.col("detail").cast("int") > most))
