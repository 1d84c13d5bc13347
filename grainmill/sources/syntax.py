"""Scopes, names and values of source files as rows, for rules that are joins (see operators/flow.py).

The tokens of a file (Java, C#, TypeScript, TSX) are read once, brackets are matched by a stack, and statements and
expressions are walked down their brackets; Python files are walked by `ast`. Rows, by kind (lo and hi are places in the
file, fn is the function around, an id names a row in its file):

- function: name; base: the call that it is a direct argument of. Function 0 is the file.
- branch: a condition, loop or try as an interval; name: what it is.
- leave: from a return to the end of a block in which it skips what follows.
- call: name; base: the object before the dot, `?` if that is no single name.
- bind: a name and the interval in which it holds; base: assign, param, pattern (taken out of something), state (first of
  useState), loop, import or function; detail: a function's id, a parameter's function and place, an import's specifier and
  original name.
- value: what is assigned, returned, passed, composed or set as HTML (base); name: the name that is assigned, the function or
  call that it belongs to, the sink; detail: the place among the arguments, or the composed text.
- part: what a value (fn) is made of: name, member, call, fn (the result of a function), other; name: the path.
- read, dep: paths read by an effect's callback and in its list of dependencies; fn: the call's id.

A token is looked at a bounded number of times on the level of its bracket, so the time is linear in the file (but for chains
of conditional expressions, which are quadratic in their own length). A file that can't be walked gives no rows. Types are read as tokens; what is odd is a part of kind other.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from typing import NamedTuple

from pyspark.sql import DataFrame

from grainmill.sources.batches import map_rows

SCHEMA = "rel string, kind string, id int, fn int, lo int, hi int, line int, name string, base string, detail string"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
#: A token and the blanks behind it; the group says what it is.
TOKEN = re.compile(
    r"(?:([^\W\d][\w$]*)|(\s+|//[^\n]*|/\*.*?(?:\*/|\Z))|([$@]*\"{3}.*?\"{3}|(?:\$@?|@\$)\"(?:[^\"\\\n{]|\\.|\{\{|\{(?:[^{}\"\n]|\"(?:[^\"\\\n]|\\.)*\")*\})*\"|@?\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'"
    r"|`(?:[^`\\$]|\\.|\$(?!\{)|\$\{(?:[^{}`]|\{[^{}]*\}|`[^`]*`)*\})*`)"
    r"|(\$[\w$]*)|(\d[\w.]*)|(=>|->|\?\.(?!\d)|\?\?=?|&&=?|\|\|=?|\.\.\.|[=!]==?|[<>]=|[-+*/%]=|\+\+|--|::|.))[ \t]*",
    re.DOTALL,
)
KINDS = ["", "word", "gap", "string", "word", "number", "mark"]
GAP, MARK = KINDS.index("gap"), KINDS.index("mark")
REGEX = re.compile(r"/(?![*/ ])(?:[^\\/\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
BEFORE_REGEX = frozenset("( , = : [ ! & | ; => return && || ?".split())
#: A line that ends or begins with one of these goes on.
ENDS_OPEN = frozenset(". ?. , ( [ { : ? + - * / % = == === != !== < > <= >= && || ?? => -> & | ^ += -= in of instanceof as extends implements return".split())
BEGINS_OPEN = frozenset(". ?. , ) ] : ? + - * / % = == === != !== > <= >= && || ?? => -> & | ^ += -= in of instanceof as satisfies extends implements is".split())
ASSIGNS = frozenset("= += -= ??=".split())
#: From the weakest on; a word isn't found among marks.
OPERATORS = (("||", "??", "&&"), ("==", "===", "!=", "!==", "<=", ">=", "instanceof", "|", "&", "^"), ("-", "*", "/", "%"))
TYPES = frozenset("class interface struct enum record namespace".split())
NOT_NAMES = frozenset("if for foreach while switch do try catch else finally return new await async function const let var final throw typeof yield case default in of import export from as void delete instanceof using lock this super".split()) | TYPES
EFFECTS = frozenset(("useEffect", "useLayoutEffect"))


class Around(NamedTuple):
    """What is around a place: the function, the block's interval, calls up to the function's border, blocks that a return skips the rest of, the effect."""

    fn: int = 0
    lo: int = 0
    hi: int = 0
    calls: tuple = ()
    skips: tuple = ()
    effect: int = -1


class Value:
    """What an expression is made of."""

    def __init__(self, *parts: tuple, lits: bool = False, plus: bool = False, holes: bool = False):
        self.parts, self.lits, self.plus, self.holes = list(parts), lits, plus, holes

    def __iadd__(self, other: Value) -> Value:
        self.parts += other.parts
        self.lits |= other.lits
        self.plus |= other.plus
        self.holes |= other.holes
        return self


class Rows:
    def __init__(self, text: str, whole: Rows | None = None):
        """whole: the rows that these are a part of."""
        self.text, self.rows, self.ends = (text, [], [m.start() for m in re.finditer("\n", text)]) if whole is None else (text, whole.rows, whole.ends)

    def line(self, at: int) -> int:
        return bisect_right(self.ends, at - 1) + 1

    def add(self, kind: str, fn: int, lo: int, hi: int, name: str = "", base: str = "", detail: str = "") -> int:
        self.rows.append([kind, len(self.rows), fn, lo, hi, self.line(lo), name, base, detail])
        return len(self.rows) - 1

    def value(self, base: str, fn: int, lo: int, hi: int, v: Value, name: str = "", detail: str = "") -> None:
        owner = self.add("value", fn, lo, hi, name, base, detail)
        for role, path, at in v.parts:
            self.add("part", owner, at, at + 1, path, role)


class Curly(Rows):
    def __init__(self, text: str, language: str, at: int = 0, end: int | None = None, whole: Rows | None = None):
        super().__init__(text, whole)
        self.language, self.typed, self.jsx = language, language in ("java", "csharp"), language in ("tsx", "jsx", "javascript")
        self.kind, self.tok, self.at, self.fresh, self.last_fn = kinds, toks, places, news, _ = [], [], [], [], 0
        self.match, stack = {}, []
        end, fresh, match = len(text) if end is None else end, False, TOKEN.match
        while at < end:
            m = match(text, at, end)
            index = m.lastindex
            token = m[index]
            if index == GAP:
                fresh = fresh or "\n" in token
                at = m.end()
                continue
            if token == "/" and (not toks or toks[-1] in BEFORE_REGEX) and (r := REGEX.match(text, at)):
                m, token, index = r, r.group(), 3
            elif index == MARK:
                if token in "([{":
                    stack.append(len(toks))
                elif token in ")]}" and stack:
                    self.match[stack.pop()] = len(toks)
            kinds.append(KINDS[index]), toks.append(token), places.append(at), news.append(fresh)
            fresh, at = False, m.end()
        self.size = len(toks)
        places.append(end)
        self.match.update((k, self.size) for k in stack)
        kinds.append("end"), toks.append(""), news.append(True)
        #: The token behind each, over a bracket.
        self.behind = [*range(1, self.size + 3)]
        for k, close in self.match.items():
            self.behind[k] = close + 1

    def run(self) -> list[list]:
        self.add("function", -1, 0, len(self.text))
        self.statements(0, self.size, Around(0, 0, len(self.text)))
        return self.rows

    # -- ranges of tokens ------------------------------------------------------------------------------------------------

    def skip(self, k: int) -> int:
        """The token behind this one, over a bracket."""
        return self.behind[k]

    def find(self, i: int, j: int, *tokens: str) -> int:
        """The first of these tokens outside of brackets, or j."""
        toks, behind = self.tok, self.behind
        while i < j:
            if toks[i] in tokens and self.kind[i] == "mark":
                return i
            i = behind[i]
        return min(i, j)

    def marks(self, i: int, j: int) -> set[str]:
        """Marks outside of brackets, and those of a bracket at the beginning."""
        toks, kinds, behind, out = self.tok, self.kind, self.behind, set()
        if i in self.match:
            out.add(toks[i])
            i += 1
            while i < j and i < self.size:
                if kinds[i] == "mark":
                    out.add(toks[i])
                i = behind[i]
            return out
        while i < j:
            if kinds[i] == "mark":
                out.add(toks[i])
            i = behind[i]
        return out

    def split(self, i: int, j: int, token: str = ",") -> list[tuple[int, int]]:
        out = []
        while i < j:
            k = self.find(i, j, token)
            if k > i:
                out.append((i, k))
            i = k + 1
        return out

    def end(self, i: int, j: int) -> int:
        """Where the statement that begins at i ends: at a semicolon, or at a line's end if neither side goes on."""
        k = i
        while k < j:
            if self.tok[k] == ";" and self.kind[k] == "mark":
                return k
            k = self.skip(k)
            if not self.typed and k < j and self.fresh[k] and self.tok[k - 1] not in ENDS_OPEN and self.tok[k] not in BEGINS_OPEN:
                return k
        return min(k, j)

    def word(self, k: int) -> bool:
        return self.kind[k] == "word" and self.tok[k] not in NOT_NAMES

    # -- statements ------------------------------------------------------------------------------------------------------

    def statements(self, i: int, j: int, around: Around) -> None:
        while i < j:
            i = max(self.statement(i, j, around), i + 1)

    def block(self, k: int, around: Around, **changed) -> None:
        lo, hi = self.at[k], self.at[min(self.match[k], self.size)]
        self.statements(k + 1, self.match[k], around._replace(lo=lo, hi=hi, **{"skips": ((lo, hi),)} | changed))

    def statement(self, i: int, j: int, around: Around) -> int:
        """Walks one statement, gives the token behind it."""
        token, word = self.tok[i], self.kind[i] == "word"
        if token == ";":
            return i + 1
        if token == "{" and i in self.match:
            self.block(i, around)
            return self.match[i] + 1
        if word and token in ("if", "for", "foreach", "while", "switch", "do", "try", "await") and (token != "await" or self.tok[i + 1] == "foreach"):
            return self.control(i, j, around)
        if word and token == "function" or token == "async" and self.tok[i + 1] == "function":
            return self.function_word(i, j, around, "", True)
        if word and token in TYPES and self.kind[i + 1] == "word":
            k = self.find(i, j, "{", ";")
            if k < j and self.tok[k] == "{":
                self.members(k + 1, self.match[k], around._replace(lo=self.at[k], hi=self.at[self.match[k]]))
                return self.match[k] + 1
            return k + 1
        if word and token == "import" and self.tok[i + 1] not in ("(", "."):
            self.imports(i)
            return self.end(i, j) + (self.tok[self.end(i, j)] == ";")
        if word and token in ("export", "default", "abstract", "declare", "public", "private", "protected", "internal", "static", "sealed", "partial", "readonly", "final", "override", "virtual", "unsafe", "extern", "synchronized") and (token != "default" or self.tok[i + 1] != ":"):
            if token != "final" or not self.typed:
                return self.statement(i + 1, j, around) if i + 1 < j else j
        if word and token in ("else", "finally", "catch"):
            return i + 1
        if word and token in ("case", "default"):
            return self.find(i, j, ":") + 1
        if self.typed and (done := self.typed_function(i, j, around)):
            return done
        k = self.end(i, j)
        if word and token == "return":
            for lo, hi in around.skips:
                self.add("leave", around.fn, self.at[i], hi)
            self.value("return", around.fn, self.at[i], self.at[k], self.expression(i + 1, k, around) if k > i + 1 else Value(), str(around.fn))
        elif word and token in ("const", "let", "var", "final") or self.typed and self.declares(i, k):
            for a, b in self.split(i + (token in ("const", "let", "var", "final")), k):
                self.declaration(a, b, around)
        else:
            self.commas(i, k, around)
        return k + (k < j and self.tok[k] == ";")

    def control(self, i: int, j: int, around: Around) -> int:
        name, k = self.tok[i], i + 1
        if name == "await":
            name, k = "foreach", i + 2
        at, slot = self.at[i], self.add("branch", around.fn, self.at[i], self.at[i], name)
        skips = around.skips if name == "if" else ()
        inner = around._replace(skips=skips)
        if self.tok[k] == "await":
            k += 1
        if self.tok[k] == "(" and name not in ("do", "try"):
            self.header(k, inner, name)
            inner = inner._replace(lo=self.at[k], hi=self.at[j]) if name in ("for", "foreach") else inner
            k = self.match[k] + 1
        elif name == "try" and self.tok[k] == "(":
            for a, b in self.split(k + 1, self.match[k], ";"):
                self.declaration(a, b, around) if self.find(a, b, "=") < b else None
            k = self.match[k] + 1
        k = self.body(k, j, inner)
        while k < j and self.tok[k] in ("else", "catch", "finally") and name in ("if", "try") or k < j and name == "do" and self.tok[k] == "while":
            word, k = self.tok[k], k + 1
            if word in ("catch", "while") and self.tok[k] == "(":
                self.header(k, inner, word)
                k = self.match[k] + 1
            if word != "while":
                k = self.body(k, j, inner)
        self.rows[slot][4] = self.at[min(k, self.size)]
        return k

    def body(self, k: int, j: int, around: Around) -> int:
        if k < j and self.tok[k] == "{" and k in self.match:
            lo, hi = self.at[k], self.at[self.match[k]]
            self.block(k, around, skips=(*around.skips, (lo, hi)))
            return self.match[k] + 1
        return self.statement(k, j, around) if k < j else j

    def header(self, k: int, around: Around, name: str) -> None:
        i, j = k + 1, self.match[k]
        if name in ("for", "foreach"):
            over = next((m for m in range(i, j) if self.tok[m] in ("of", "in", ":") and self.kind[m] != "string" and self.find(i, j, ";") == j), None)
            if over is not None and over > i:
                self.add("bind", around.fn, self.at[k], self.at[self.after(j)], self.tok[over - 1], "loop")
                self.value("assign", around.fn, self.at[over - 1], self.at[j], self.expression(over + 1, j, around), self.tok[over - 1])
                return
            for a, b in self.split(i, j, ";"):
                self.declaration(a + 1, b, around) if self.tok[a] in ("let", "var", "const") or self.typed and self.declares(a, b) else self.commas(a, b, around)
        elif name != "catch":
            self.commas(i, j, around)

    def after(self, j: int) -> int:
        """The end of the statement behind a header that closes at j."""
        return self.match[j + 1] if self.tok[j + 1] == "{" and j + 1 in self.match else self.end(j + 1, self.size)

    def declares(self, i: int, k: int) -> bool:
        """In Java and C#: a type and a name, then = or the end."""
        m = self.find(i, k, "=")
        return m - i >= 2 and self.word(m - 1) and (self.kind[m - 2] == "word" and self.tok[m - 2] not in ("return", "throw", "new", "await", "goto") or self.tok[m - 2] in (">", "]", "?"))

    def declaration(self, i: int, k: int, around: Around) -> None:
        m = self.find(i, k, "=")
        if self.typed:
            names = [(m - 1, "assign", "")] if m > i and self.word(m - 1) else []
        else:
            names = self.pattern(i, m)
        v = self.expression(m + 1, k, around, self.tok[names[0][0]] if len(names) == 1 else "") if m < k else None
        call = v.parts[0][1].rpartition(".")[2] if v and len(v.parts) == 1 and v.parts[0][0] == "call" else ""
        for n, (at, base, place) in enumerate(names):
            base = "state" if base == "pattern" and n == 0 and self.tok[i] == "[" and call == "useState" else base
            fn = next((p[1] for p in v.parts if p[0] == "own"), "") if v else ""
            self.add("bind", around.fn, around.lo, around.hi, self.tok[at], "function" if fn else base, fn or place)
            if v and base == "assign" and not fn:
                self.value("assign", around.fn, self.at[at], self.at[k], v, self.tok[at])

    def pattern(self, i: int, j: int) -> list[tuple[int, str, str]]:
        """The names (tokens) that a declared or passed thing gives."""
        while i < j and self.tok[i] in ("...", "@", "readonly", "public", "private", "protected"):
            i += 1
        if i >= j:
            return []
        if self.tok[i] not in ("{", "["):
            return [(i, "assign", "")] if self.kind[i] == "word" else []
        out = []
        for a, b in self.split(i + 1, self.match[i]):
            colon = self.find(a, b, ":")
            inner = self.pattern(colon + 1, b) if colon < b and self.tok[i] == "{" else self.pattern(a, b)
            out += [(at, "pattern", "") for at, _, _ in inner]
        return out

    def imports(self, i: int) -> None:
        m = re.compile(r"import\s+(?:type\s+)?([^'\";]*?)\s*from\s*['\"]([^'\"]+)['\"]").match(self.text, self.at[i])
        if m:
            head, spec = m.groups()
            for n in re.finditer(r"([\w$]+)(?:\s+as\s+([\w$]+))?", " ".join(re.findall(r"\{([^}]*)\}", head))):
                self.add("bind", 0, 0, len(self.text), n.group(2) or n.group(1), "import", f"{spec} {n.group(1)}")
            for n in re.finditer(r"(\*\s*as\s+)?([\w$]+)", re.sub(r"\{[^}]*\}", "", head)):
                self.add("bind", 0, 0, len(self.text), n.group(2), "import", f"{spec} {'*' if n.group(1) else 'default'}")

    # -- functions -------------------------------------------------------------------------------------------------------

    def function(self, name: str, lo: int, params: tuple[int, int], body: int, j: int, around: Around, wrapper: str = "", effect: int = -1) -> tuple[int, int]:
        """A function whose parameters and body are ranges of tokens; gives its id and the token behind it."""
        braced = self.tok[body] == "{" and body in self.match
        last = self.match[body] if braced else j
        fn = self.add("function", around.fn, self.at[lo], self.at[min(last, self.size)], name, wrapper)
        inner = Around(fn, self.at[lo], self.at[min(last, self.size)], (), (), effect if effect >= 0 else around.effect)
        single = params[1] - params[0] == 1
        for place, (a, b) in enumerate(self.split(*params)):
            while self.tok[a] == "@" and a < b:
                a = self.skip(a + 1) if self.tok[a + 2] != "(" else self.skip(a + 2)
            if self.typed and not single:
                k = min(self.find(a, b, "="), b) - 1
                names = [(k, "assign", "")] if k > a or self.word(k) else []
            else:
                names = self.pattern(a, b)
            for at, base, _ in names:
                self.add("bind", fn, inner.lo, inner.hi, self.tok[at], "param" if base == "assign" else "pattern", f"{fn}:{place}")
        if braced:
            block = (self.at[body], self.at[last])
            self.statements(body + 1, last, inner._replace(skips=(block,)))
        elif body < j:
            self.value("return", fn, self.at[body], self.at[j], self.expression(body, j, inner), str(fn))
        return fn, (last + 1 if braced else j)

    def function_word(self, i: int, j: int, around: Around, name: str, declared: bool, wrapper: str = "", effect: int = -1) -> int:
        """`function name(…): type {…}`."""
        k = self.find(i, j, "(")
        if k >= j:
            return j
        named = self.word(k - 1) and self.tok[k - 1] or next((self.tok[m] for m in range(i, k) if self.word(m)), "")
        body = self.brace(self.match[k] + 1, j)
        if body is None:
            return self.end(k, j) + 1
        slot = self.add("bind", around.fn, around.lo, around.hi, named, "function") if declared and named else None
        fn, behind = self.function(named or name, i, (k + 1, self.match[k]), body, j, around, wrapper, effect)
        if slot is not None:
            self.rows[slot][8] = str(fn)
        self.last_fn = fn
        return behind

    def brace(self, k: int, j: int) -> int | None:
        """The body's brace behind a parameter list, over a type; none if the function has no body."""
        while k < j and self.tok[k] != ";":
            if self.tok[k] == "{" and self.tok[k - 1] not in (":", "|", "&", "<", ",") and k in self.match:
                return k
            if self.tok[k] in ("=>", "->", "="):
                return None
            k = self.skip(k)
        return None

    def typed_function(self, i: int, j: int, around: Around, member: bool = False) -> int:
        """A method, or a local function, of Java and C#: a type, a name, parameters and a body; 0 if it is none."""
        k = self.find(i, j, "(", "=", ";", "{", "=>", "?", "+")
        if k >= j or self.tok[k] != "(":
            return 0
        n = k - 1
        if self.tok[n] == ">":
            n = next((m for m in range(n, i, -1) if self.tok[m] == "<"), i) - 1
        if n < i + (not member) or not self.word(n) or n > i and self.tok[n - 1] in (".", "new", "await", "return", "throw", "else"):
            return 0
        close = self.match[k]
        arrow = close + 1 < j and self.tok[close + 1] == "=>"
        body = close + 2 if arrow else self.brace(close + 1, j)
        if body is None:
            return self.end(close, j) + 1 if member else 0
        last = self.end(body, j) if arrow else j
        shown = any(self.tok[m] in ("public", "protected", "internal") for m in range(i, n))
        slot = self.add("bind", around.fn, around.lo, around.hi, self.tok[n], "method" if shown else "function")
        fn, behind = self.function(self.tok[n], n, (k + 1, close), body, last, around)
        self.rows[slot][8] = str(fn)
        return behind

    def members(self, i: int, j: int, around: Around) -> None:
        """The body of a class."""
        while i < j:
            while i < j and self.tok[i] in ("@", "[", ";", ","):
                i = self.skip(i) if self.tok[i] != "@" else (self.skip(i + 2) if self.tok[i + 2] == "(" else i + 2)
            if i >= j:
                return
            k = self.find(i, j, "(", "=", "{", ";", "=>")
            if k >= j:
                return
            nested = next((m for m in range(i, k) if self.tok[m] in TYPES and self.kind[m] == "word"), None)
            if nested is not None and self.tok[k] != "=":
                i = max(self.statement(nested, j, around), k + 1)
            elif self.tok[k] == "(":
                behind = self.typed_function(i, j, around, True) if self.typed else 0
                if not behind:
                    body = self.brace(self.match[k] + 1, j)
                    behind = self.function(self.tok[k - 1] if self.word(k - 1) else "", max(k - 1, i), (k + 1, self.match[k]), body, j, around)[1] if body is not None else self.end(k, j)
                i = max(behind, k + 1)
            elif self.tok[k] == "=":
                e = self.end(k, j)
                if self.word(k - 1):
                    v = self.expression(k + 1, e, around)
                    self.add("bind", around.fn, around.lo, around.hi, self.tok[k - 1], "assign")
                    self.value("assign", around.fn, self.at[k - 1], self.at[e], v, self.tok[k - 1])
                else:
                    self.expression(k + 1, e, around)
                i = e + 1
            elif self.tok[k] == "{":
                self.block(k, around)
                i = self.match[k] + 1
            else:
                e = self.end(k, j)
                self.expression(k + 1, e, around) if self.tok[k] == "=>" else None
                i = e + 1

    # -- expressions -----------------------------------------------------------------------------------------------------

    def commas(self, i: int, j: int, around: Around) -> None:
        for a, b in self.split(i, j) if not self.tag(i, j) else [(i, j)]:
            self.expression(a, b, around)

    def tag(self, i: int, j: int) -> bool:
        return self.jsx and i + 1 < j and self.tok[i] == "<" and (self.kind[i + 1] == "word" or self.tok[i + 1] == ">")

    def expression(self, i: int, j: int, around: Around, name: str = "", wrapper: str = "", effect: int = -1) -> Value:
        """What one expression is made of; name: what a function here is called, wrapper: the call that it is a direct argument of."""
        while i < j and self.tok[i] in ("await", "...", "!", "throw", "yield", "ref", "out") and self.tok[i + 1] not in ("=>", "("):
            i += 1
        if i >= j:
            return Value()
        if self.tag(i, j):
            return self.markup(i, j, around)
        if j == i + 1 and self.tok[i] not in ("function", "async"):
            return self.operand(i, j, around, False, name, wrapper, effect)
        marks = self.marks(i, j)
        arrow = self.find(i, j, "=>", "->") if "=>" in marks or "->" in marks else j
        if arrow < j and arrow > i and self.tok[arrow - 1] != "]":
            k = i + (self.tok[i] == "async")
            p = self.find(k, arrow, "(")
            params = (p + 1, self.match[p]) if p < arrow else (arrow - 1, arrow)
            if p == k or p >= arrow or self.tok[k] == "<":
                fn, _ = self.function(name, i, params, arrow + 1, j, around, wrapper, effect)
                return Value(("own", str(fn), self.at[i]))
        if self.tok[i] == "function" or self.tok[i] == "async" and self.tok[i + 1] == "function":
            self.function_word(i, j, around, name, False, wrapper, effect)
            return Value(("own", str(self.last_fn), self.at[i]))
        k = self.find(i, j, "=", "+=", "-=", "??=") if not marks.isdisjoint(ASSIGNS) else j
        if k < j and k > i:
            target = self.tok[k - 1] if k - i == 1 and self.word(i) else ""
            v = self.expression(k + 1, j, around, target)
            if target:
                self.value("assign", around.fn, self.at[i], self.at[j], v, target)
            else:
                self.expression(i, k, around)
            return v
        k = self.find(i, j, "?") if "?" in marks else j
        if k < j and k > i:
            colon = self.find(k + 1, j, ":")
            nested = self.find(k + 1, j, "?")
            while nested < colon < j:
                nested, colon = self.find(nested + 1, j, "?"), self.find(colon + 1, j, ":")
            if colon < j:
                self.add("branch", around.fn, self.at[i], self.at[j], "ternary")
                self.expression(i, k, around)
                v = self.expression(k + 1, colon, around)
                v += self.expression(colon + 1, j, around)
                v.plus = False
                return v
        for level in OPERATORS:
            if marks.isdisjoint(level):
                continue
            k = self.find(i + 1, j, *level)
            if k < j and self.tok[k - 1] not in ("(", ",", "="):
                if level[0] == "||":
                    self.add("branch", around.fn, self.at[i], self.at[j], self.tok[k])
                v, a = Value(), i
                while True:
                    v += self.expression(a, k, around)
                    if k >= j:
                        break
                    a, k = k + 1, self.find(k + 1, j, *level)
                if level[0] != "||":
                    v = Value(("other", self.tok[i], self.at[i]))
                v.plus = False
                return v
        k = self.find(i + 1, j, "+") if "+" in marks else j
        if k < j:
            v, a, inner = Value(plus=True), i, around
            while True:
                v += self.operand(a, k, inner, True)
                if k >= j:
                    break
                a, k = k + 1, self.find(k + 1, j, "+")
            if v.lits and v.parts:
                self.composed(i, j, v, around)
            return v
        return self.operand(i, j, around, False, name, wrapper, effect)

    def composed(self, i: int, j: int, v: Value, around: Around) -> None:
        sink = next((c for c in around.calls if SINK.search(c)), "")
        self.value("composed", around.fn, self.at[i], self.at[j], v, f"{around.calls[0] if around.calls else ''} {sink}", self.text[self.at[i] : self.at[j]])

    def markup(self, i: int, j: int, around: Around) -> Value:
        k, element = i, ""
        while k < j:
            if self.tok[k] == "<" and self.kind[k] == "mark":
                element = self.tok[k + 1]
            if self.tok[k] == "{" and k in self.match:
                a, b = k + 1, self.match[k]
                if self.tok[k - 2] == "dangerouslySetInnerHTML" and self.tok[k - 1] == "=":
                    v = Value(("other", "", self.at[a]))
                    if self.tok[a] == "{" and self.match.get(a) == b - 1:
                        for x, y in self.split(a + 1, b - 1):
                            colon = self.find(x, y, ":")
                            if self.tok[x].strip("'\"") == "__html" and colon < y:
                                v = self.expression(colon + 1, y, around)
                    else:
                        self.expression(a, b, around)
                    self.value("html", around.fn, self.at[k - 2], self.at[b], v, element)
                else:
                    self.expression(a, b, around)
            k = self.skip(k)
        return Value(("other", "<", self.at[i]))

    def operand(self, i: int, j: int, around: Around, composed: bool, name: str = "", wrapper: str = "", effect: int = -1) -> Value:
        """A literal, a bracket, an object, or a path with calls."""
        if i >= j:
            return Value()
        token, kind = self.tok[i], self.kind[i]
        while token in ("new", "await", "!", "-") and i + 1 < j:
            i += 1
            token, kind = self.tok[i], self.kind[i]
        if kind == "string" and (j == i + 1 or self.tok[i + 1] not in (".", "?.")):
            v = self.string(i, around)
            if v.holes and v.parts and not composed:
                self.composed(i, i + 1, v, around)
            return v
        if kind == "number" or token in ("null", "true", "false", "undefined"):
            return Value(lits=True)
        if token == "(" and i in self.match:
            close = self.match[i]
            if close == j - 1:
                parts = self.split(i + 1, close)
                return self.expression(i + 1, close, around, name, wrapper) if len(parts) == 1 or self.tag(i + 1, close) else (self.commas(i + 1, close, around) or Value(("other", "(", self.at[i])))
            if self.typed and close + 1 < j and self.tok[close + 1] not in (".", "?.", "[", "("):
                return self.operand(close + 1, j, around, composed)
        if token == "{" and i in self.match:
            self.object(i, around)
            return Value(("other", "{", self.at[i]))
        if token == "[" and i in self.match:
            for a, b in self.split(i + 1, self.match[i]):
                self.expression(a, b, around)
            return Value(("other", "[", self.at[i]))
        if token == "<":  # a cast, or markup that isn't known as such
            for k in range(i, j):
                if k in self.match and self.tok[k] == "{":
                    self.expression(k + 1, self.match[k], around)
            return Value(("other", "<", self.at[i]))
        return self.path(i, j, around)

    def string(self, i: int, around: Around) -> Value:
        token, at = self.tok[i], self.at[i]
        v = Value(lits=True)
        if token[0] == "`":
            holes = re.finditer(r"\$\{((?:[^{}`]|\{[^{}]*\}|`[^`]*`)*)\}", token)
        elif "$" in token[:2] and '"' in token[:3]:
            holes = re.finditer(r"(?<!\{)\{((?:[^{}\"]|\"(?:[^\"\\]|\\.)*\")+)\}", token)
        else:
            return v
        for m in holes:
            # A format may follow an expression of C#.
            inner = Curly(self.text, self.language, at + m.start(1), at + m.end(1), self)
            end = inner.find(0, inner.size, ":", ",") if self.typed and inner.find(0, inner.size, "?") == inner.size else inner.size
            v += Value(*inner.expression(0, end, around).parts, holes=True)
        return v

    def object(self, i: int, around: Around) -> None:
        for a, b in self.split(i + 1, self.match[i]):
            colon = self.find(a, b, ":")
            paren = self.find(a, b, "(")
            if colon < b and colon < paren:
                self.expression(colon + 1, b, around, self.tok[colon - 1].strip("'\""))
            elif paren < b and (body := self.brace(self.match[paren] + 1, b)) is not None and self.word(paren - 1):
                self.function(self.tok[paren - 1], a, (paren + 1, self.match[paren]), body, b, around)
            else:
                self.expression(a, b, around)

    def path(self, i: int, j: int, around: Around) -> Value:
        """Names, dots, indexes and calls, from left to right."""
        start, names, plain, k = i, [], True, i
        v = Value(("other", self.tok[i], self.at[i]))
        while k < j:
            token = self.tok[k]
            if self.kind[k] == "word" and token not in ("as", "satisfies", "is", "in", "of", "instanceof"):
                if k > start and self.tok[k - 1] not in (".", "?.", "::"):
                    names, plain, start = [], True, k
                names.append(token)
                if plain:
                    v = Value(("name" if len(names) == 1 else "member", ".".join(names), self.at[start]))
                    if k + 1 >= j or self.tok[k + 1] not in (".", "?."):
                        self.read(names, start, k, j, around)
                k += 1
            elif token in (".", "?.", "::", "!"):
                k += 1
            elif token == "(" and k in self.match:
                if plain:
                    self.read(names[:-1], start, k - 2, j, around) if len(names) > 1 else None
                v = self.call(start, k, names if plain else ["?", *names[-1:]], around)
                plain, k = False, self.match[k] + 1
            elif token == "<" and (close := self.type_end(k, j)):
                k = close + 1
            elif token == "[" and k in self.match:
                self.read(names, start, k - 1, j, around) if plain else None
                for a, b in self.split(k + 1, self.match[k]):
                    self.expression(a, b, around)
                v, plain, k = Value(("other", "[", self.at[start])), False, self.match[k] + 1
            elif token == "{" and k in self.match:
                self.object(k, around) if self.tok[start - 1] != "switch" else self.block(k, around)
                v, k = Value(("other", "{", self.at[start])), self.match[k] + 1
            elif token in ("as", "satisfies"):
                break
            elif token in ("<", ">"):
                v, names, plain, k, start = Value(("other", token, self.at[start])), [], True, k + 1, k + 1
            elif self.kind[k] == "string":
                self.string(k, around)
                k += 1
            else:
                k += 1
        return v

    def read(self, names: list[str], start: int, k: int, j: int, around: Around) -> None:
        if around.effect >= 0 and names and self.word(start):
            self.add("read", around.effect, self.at[start], self.at[k], names[0], "", ".".join(names))

    def type_end(self, k: int, j: int) -> int:
        """The end of type arguments before a call, or 0."""
        depth = 0
        for m in range(k, min(j, k + 60)):
            if self.tok[m] == "<":
                depth += 1
            elif self.tok[m] == ">":
                depth -= 1
                if depth == 0:
                    return m if m + 1 < j and self.tok[m + 1] == "(" else 0
            elif self.kind[m] not in ("word", "string") and self.tok[m] not in (",", ".", "[", "]", "|", "&", "?", "{", "}", ":", ";"):
                return 0
        return 0

    def call(self, start: int, k: int, names: list[str], around: Around) -> Value:
        close, path = self.match[k], ".".join(names)
        base = "" if len(names) == 1 else names[0] if len(names) == 2 else "?"
        call = self.add("call", around.fn, self.at[start], self.at[min(close, self.size)], names[-1] if names else "", base)
        inner = around._replace(calls=(path, *around.calls))
        v, args = Value(("call", path, self.at[start])), [(k + 1, close)] if self.tag(k + 1, close) else self.split(k + 1, close)
        for place, (a, b) in enumerate(args):
            named = self.tok[a + 1] == ":" and self.kind[a] == "word" and self.typed
            first = place == 0 and names and names[-1] in EFFECTS and len(names) <= 2
            w = self.expression(a + 2 * named, b, inner, "", path, call if first else -1)
            own = next((p[1] for p in w.parts if p[0] == "own"), None)
            if own and place == 0 and names[-1] == "useMemo":
                v = Value(("fn", own, self.at[start]))
            self.value("arg", around.fn, self.at[a], self.at[b], w, str(call), str(place))
            if place == 1 and names and names[-1] in EFFECTS and self.tok[a] == "[" and self.match.get(a) == b - 1:
                self.add("dep", call, self.at[a], self.at[b], "", "list")
                for x, y in self.split(a + 1, b - 1):
                    text = re.sub(r"\s|[()!]", "", self.text[self.at[x] : self.at[y]]).replace("?.", ".")
                    if re.fullmatch(r"[^\W\d][\w$]*(\.[\w$]+)*", text):
                        self.add("dep", call, self.at[x], self.at[y], text)
        self.rows[call][8] = str(len(args))
        return v


# Words of calls that execute SQL.
SINK = re.compile(r"(?i)(execute|query|raw|command|sql)")


class Python(Rows, ast.NodeVisitor):
    """The rows of a Python file that composed SQL needs: functions, names, values."""

    def __init__(self, text: str):
        super().__init__(text)
        self.starts, self.stack, self.around = [0, *(e + 1 for e in self.ends)], [], ()

    def place(self, node: ast.AST) -> tuple[int, int]:
        return self.starts[node.lineno - 1] + node.col_offset, self.starts[node.end_lineno - 1] + node.end_col_offset

    def run(self) -> list[list]:
        self.add("function", -1, 0, len(self.text))
        self.stack = [(0, 0, len(self.text) + 1)]
        self.generic_visit(ast.parse(self.text))
        return self.rows

    def visit_FunctionDef(self, node) -> None:
        lo, hi = self.place(node)
        name = getattr(node, "name", "")
        slot = self.add("bind", self.stack[-1][0], *self.stack[-1][1:], name, "function") if name else None
        fn = self.add("function", self.stack[-1][0], lo, hi, name)
        if slot is not None:
            self.rows[slot][8] = str(fn)
        a = node.args
        for place, p in enumerate([*a.posonlyargs, *a.args]):
            self.add("bind", fn, lo, hi, p.arg, "param", f"{fn}:{place}")
        for p in [*a.kwonlyargs, a.vararg, a.kwarg]:
            if p:
                self.add("bind", fn, lo, hi, p.arg, "pattern")
        calls, self.around = self.around, ()
        self.stack.append((fn, lo, hi))
        if isinstance(node, ast.Lambda):
            self.value("return", fn, *self.place(node.body), self.made(node.body), str(fn))
        self.generic_visit(node)
        self.stack.pop()
        self.around = calls

    visit_AsyncFunctionDef = visit_Lambda = visit_FunctionDef

    def made(self, node: ast.AST) -> Value:
        """What an expression is made of."""
        at = self.place(node)[0] if hasattr(node, "lineno") else 0
        if isinstance(node, ast.Constant):
            return Value(lits=True)
        if isinstance(node, ast.JoinedStr):
            v = Value(lits=True, holes=True)
            for part in node.values:
                if isinstance(part, ast.FormattedValue):
                    v += self.made(part.value)
            return v
        if isinstance(node, ast.BinOp) and isinstance(node.op, (ast.Add, ast.Mod)):
            v = self.made(node.left)
            v += self.made(node.right)
            v.plus = True
            return v
        if isinstance(node, (ast.IfExp, ast.BoolOp)):
            v = Value()
            for x in (node.body, node.orelse) if isinstance(node, ast.IfExp) else node.values:
                v += self.made(x)
            v.plus = False
            return v
        if isinstance(node, (ast.Tuple, ast.List)):
            v = Value()
            for x in node.elts:
                v += self.made(x)
            return v
        if isinstance(node, ast.Name):
            return Value(("name", node.id, at))
        if isinstance(node, ast.Call):
            if isinstance(node.func, ast.Attribute) and node.func.attr == "format" and isinstance(node.func.value, ast.Constant):
                v = Value(lits=True, holes=True)
                for x in [*node.args, *(k.value for k in node.keywords)]:
                    v += self.made(x)
                return v
            return Value(("call", ast.unparse(node.func) if isinstance(node.func, (ast.Name, ast.Attribute)) else "?", at))
        return Value(("other", type(node).__name__, at))

    def held(self, base: str, target: ast.AST, node: ast.AST) -> None:
        if isinstance(target, ast.Name):
            lo = self.place(target)[0]
            self.add("bind", self.stack[-1][0], *self.stack[-1][1:], target.id, "assign")
            self.value("assign", self.stack[-1][0], lo, self.place(node)[1], self.made(node) if base == "assign" else Value(("other", base, lo)), target.id)
        elif isinstance(target, (ast.Tuple, ast.List)):
            for x in target.elts:
                self.held("pattern", x, node)

    def visit_Assign(self, node) -> None:
        for target in node.targets:
            self.held("assign", target, node.value)
        self.generic_visit(node)

    def visit_AnnAssign(self, node) -> None:
        if node.value:
            self.held("assign", node.target, node.value)
        self.generic_visit(node)

    visit_AugAssign = visit_NamedExpr = visit_AnnAssign

    def visit_For(self, node) -> None:
        self.held("assign" if isinstance(node.iter, (ast.Tuple, ast.List)) else "loop", node.target, node.iter)
        self.generic_visit(node)

    visit_AsyncFor = visit_comprehension = visit_For

    def visit_Return(self, node) -> None:
        self.value("return", self.stack[-1][0], *self.place(node), self.made(node.value) if node.value else Value(), str(self.stack[-1][0]))
        self.generic_visit(node)

    def visit_Call(self, node) -> None:
        path = ast.unparse(node.func) if isinstance(node.func, (ast.Name, ast.Attribute)) else "?"
        lo, hi = self.place(node)
        call = self.add("call", self.stack[-1][0], lo, hi, path.rpartition(".")[2], path.rpartition(".")[0])
        for place, x in enumerate(node.args):
            self.value("arg", self.stack[-1][0], *self.place(x), self.made(x), str(call), str(place))
        if isinstance(node.func, ast.Attribute) and node.func.attr == "format":
            self.composed(node)
        calls, self.around = self.around, (path, *self.around)
        self.generic_visit(node)
        self.around = calls

    def composed(self, node: ast.AST) -> None:
        """A composition that isn't inside another one."""
        v = self.made(node)
        if v.parts and (v.plus and v.lits or v.holes):
            lo, hi = self.place(node)
            sink = next((c for c in self.around if SINK.search(c)), "")
            self.value("composed", self.stack[-1][0], lo, hi, v, f"{self.around[0] if self.around else ''} {sink}", self.text[lo:hi])

    def visit_BinOp(self, node) -> None:
        if not getattr(self, "inside", False):
            self.composed(node)
            self.inside = isinstance(node.op, (ast.Add, ast.Mod))
            self.generic_visit(node)
            self.inside = False
        else:
            self.generic_visit(node)

    def visit_JoinedStr(self, node) -> None:
        if not getattr(self, "inside", False):
            self.composed(node)
        self.generic_visit(node)


def file_rows(rel: str, language: str, content: bytes | None) -> list[list]:
    text = (content or b"").decode("utf-8", "replace")
    try:
        rows = (Python(text) if language == "python" else Curly(text, language)).run()
    except (SyntaxError, ValueError, RecursionError, IndexError):
        return []
    return [[rel, *row] for row in rows]


def scan(files: DataFrame) -> DataFrame:
    """The rows of `files` (rel, language, content, skipped); files that were skipped give none."""
    return map_rows(files.filter("skipped IS NULL").select("rel", "language", "content"), lambda files: (row for file in files for row in file_rows(*file)), SCHEMA)
