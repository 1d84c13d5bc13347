"""Rules over the rows of sources/syntax.py: intervals for what is around a place, names for what a value is made of.

All that a rule asks lies in one file (at most 1.5 MB), but for proofs of HTML that imports name. So each file is judged where
it was read, in one task, and only hits leave Python: `of_files` parses and judges, `of_rows` judges rows of the scanner.
Proofs through imports are what a file leaves open, and an equi-join closes it.

Whether a place is under a condition is a search among the intervals of its function. Where a name comes from is the innermost
of its bindings around a place, found in one sweep over both. Whether a value can be trusted is a fixpoint: values that hold
something unknown are the seeds, and what is made of an untrusted value is reached along edges from values to names, results,
arguments and values. Each step is linear in the file but for sorting.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from heapq import heappop, heappush
from itertools import groupby
from operator import itemgetter
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.operators import graphs
from grainmill.sources.batches import map_rows
from grainmill.sources.syntax import NAMES, file_rows

# Names and patterns of the rules.
HOOK = re.compile("use[A-Z]")
COMPONENT = re.compile("[A-Z]")
EFFECTS = ("useEffect", "useLayoutEffect")
WRAPPERS = ("memo", "forwardRef", "React.memo", "React.forwardRef")
PURIFIERS = ("dompurify", "isomorphic-dompurify")
SQL_WORDS = re.compile(r"\b(?:insert\s+into|delete\s+from)\b", re.ASCII | re.IGNORECASE)
SQL_PAIRS = [tuple(re.compile(p, re.ASCII | re.IGNORECASE) for p in pair) for pair in ((r"\bselect\s", r"\sfrom\b"), (r"\bupdate\s", r"\sset\b"))]
PARAMETERS = re.compile(r"(?i)(FromSqlInterpolated|ExecuteSqlInterpolated)(Async)?$")
MODEL = re.compile(r"\.(GetSchema|GetTableName|GetColumnName|GetDefaultSchema|GetSchemaQualifiedTableName)$")
RAW_SQL = re.compile(r"(FromSqlRaw|ExecuteSqlRaw|ExecuteSqlRawAsync|SqlQueryRaw)$")


def _says_sql(text: str) -> bool:
    """Whether a text has the words of a statement, something between them; linear, since only the first of one and the last of the other count."""
    if SQL_WORDS.search(text):
        return True
    for first, last in SQL_PAIRS:
        head = first.search(text)
        if head and any(m.start() > head.end() for m in last.finditer(text, head.end())):
            return True
    return False


class File:
    """A file's rows by kind, as the scanner gives them: kind, id, fn, lo, hi, line, name, base, detail."""

    def __init__(self, rows: Iterable):
        self.rows = defaultdict(list)
        for row in rows:
            self.rows[row[0]].append(row)
        self.binds = defaultdict(list)
        for row in self.rows["bind"]:
            self.binds[row[6]].append(row)

    def of(self, kind: str, base: str) -> list:
        return [row for row in self.rows[kind] if row[7] == base]

    def innermost(self, uses: Iterable[tuple[object, int, str]]) -> dict:
        """For each use (key, place, name) the binding that the name has there; names without one have no entry.

        Of the bindings around a place the last to begin counts, which is on top of a heap from which ended ones are taken.
        """
        named = defaultdict(list)
        for key, at, name in uses:
            if name in self.binds:
                named[name].append((at, key))
        found = {}
        for name, places in named.items():
            own, k, heap = sorted(self.binds[name], key=itemgetter(3)), 0, []
            for at, key in sorted(places, key=itemgetter(0)):
                while k < len(own) and own[k][3] <= at:
                    heappush(heap, (-own[k][3], -own[k][1], own[k]))
                    k += 1
                while heap and heap[0][2][4] <= at:
                    heappop(heap)
                if heap:
                    found[key] = heap[0][2]
        return found

    def hooks(self) -> list:
        """Calls of hooks. Of objects only React and those with a capital count."""
        return [row for row in self.rows["call"] if HOOK.match(row[6]) and (row[7] in ("", "React") or COMPONENT.match(row[7]))]


class Around:
    """Whether intervals are around a place: the furthest end among those that begin up to it."""

    def __init__(self, intervals: list[tuple[int, int]]):
        self.starts, self.ends, most = [], [], -1
        for start, stop in sorted(intervals):
            most = max(most, stop)
            self.starts.append(start)
            self.ends.append(most)

    def holds(self, at: int, begun: int) -> bool:
        """begun: the last place at which an interval may begin."""
        k = bisect_right(self.starts, begun)
        return k > 0 and self.ends[k - 1] > at


def _conditional_hooks(file: File) -> Iterator[tuple]:
    hooks, branches, leaves = file.hooks(), defaultdict(list), defaultdict(list)
    for _, _, fn, lo, hi, *_ in file.rows["branch"] if hooks else ():
        branches[fn].append((lo, hi))
    for _, _, fn, lo, hi, *_ in file.rows["leave"] if hooks else ():
        if fn:
            leaves[fn].append((lo, hi))
    under, behind = ({fn: Around(own) for fn, own in rows.items()} for rows in (branches, leaves))
    for _, _, fn, lo, _, line, name, _, _ in hooks:
        if fn in under and under[fn].holds(lo, lo):
            yield line, name, "under a condition"
        elif fn in behind and behind[fn].holds(lo, lo - 1):
            yield line, name, "after an early return"


def _nested_hooks(file: File) -> Iterator[tuple]:
    inner = {row[1] for row in file.rows["function"] if HOOK.match(row[7]) and "." not in row[7]}
    return ((row[5], row[6], "") for row in file.hooks() if row[2] in inner)


def _misplaced_hooks(file: File) -> Iterator[tuple]:
    hooks = file.hooks()
    called = {row[2] for row in hooks}
    plain = {}
    for _, fn, _, lo, _, _, name, wrapper, _ in file.rows["function"]:
        if fn and fn in called and not (COMPONENT.match(name) or HOOK.match(name) or HOOK.match(wrapper) or wrapper in WRAPPERS):
            plain[fn] = (lo, name, wrapper)
    wrapped = file.innermost((fn, lo, wrapper) for fn, (lo, _, wrapper) in plain.items())
    tests = {fn for fn, b in wrapped.items() if b[7] == "import" and b[8].startswith("@testing-library/") and b[8].endswith(" renderHook")}
    return ((row[5], plain[row[2]][1], "") for row in hooks if row[2] in plain and row[2] not in tests)


def _effects_without_list(file: File) -> Iterator[tuple]:
    return ((row[5], row[6], "") for row in file.hooks() if row[6] in EFFECTS and row[8] == "1")


def _missing_dependencies(file: File) -> Iterator[tuple]:
    with_list = {row[2] for row in file.of("dep", "list")}
    called = {row[1]: row for row in file.hooks() if row[6] in EFFECTS and row[1] in with_list}
    listed = {(row[2], row[6]) for row in file.of("dep", "")}
    reads = {row[1]: row for row in file.rows["read"] if row[2] in called}
    outer = {row[1] for row in file.rows["function"] if row[2] == 0}
    missing = defaultdict(set)
    for use, bound in file.innermost((use, row[3], row[6]) for use, row in reads.items()).items():
        _, _, call, _, _, _, name, _, path = reads[use]
        # Parameters of outermost functions; state from outside of the callback.
        owner = bound[8].split(":")[0]
        if bound[7] == "state" and bound[3] < called[call][3] or bound[7] == "pattern" and owner.isdecimal() and int(owner) in outer:
            steps = path.split(".")
            if not any((call, ".".join(steps[:k])) in listed for k in range(1, len(steps) + 1)):
                missing[call].add(name)
    return ((called[call][5], ", ".join(sorted(names)), "") for call, names in missing.items())


class Trust:
    """The fixpoint over a file's values: `seeds` hold what isn't proven constant, `edges` lead from values to what is made of them.

    purified: the proofs of HTML: results of a purifier and of functions that return nothing else count, parameters never do.
    Otherwise the proofs of SQL: names of the model, and parameters of local functions whose calls all pass proven values.
    `imported`: calls of imported functions by name and specifier, with what they make; a proof of another file may clear them.
    """

    def __init__(self, file: File, purified: bool = False):
        self.edges, self.seeds, self.imported = defaultdict(list), set(), defaultdict(set)
        edges, seeds = self.edges, self.seeds
        parts = file.rows["part"]
        origin = file.innermost((row[1], row[3], row[6].split(".")[0]) for row in parts if row[7] in ("name", "call", "member"))
        results = defaultdict(list)
        for row in file.of("value", "return"):
            results[row[6]].append(row[1])
        self.results = results

        def made(owner: int, function: str) -> None:
            """The owner is made of a function's results."""
            for value in results.get(function, ()):
                edges[value].append(owner)
            if function not in results:
                seeds.add(owner)

        for _, use, owner, _, _, _, path, role, _ in parts:
            bound = origin.get(use)
            base, detail = (bound[7], bound[8]) if bound else ("", "")
            if role in ("other", "own", "member"):
                seeds.add(owner)
            elif role == "fn":
                made(owner, path)
            elif role == "name":
                if bound:
                    edges[bound[1]].append(owner)
                else:
                    seeds.add(owner)
            elif role == "call":
                if purified:
                    proven, through = path.endswith(".sanitize") and base == "import" and _imported(detail)[0] in PURIFIERS and _imported(detail)[1] in ("default", "*"), False
                else:
                    proven, through = path.endswith(".Model.GetEntityTypes"), base == "loop" and MODEL.search(path) is not None
                if proven:
                    continue
                if through:
                    edges[bound[1]].append(owner)
                elif "." not in path and base in ("function", "method"):
                    made(owner, detail)
                elif purified and "." not in path and base == "import":
                    spec, name = _imported(detail)
                    self.imported[name, spec].add(owner)
                else:
                    seeds.add(owner)
        # What is assigned to a name.
        given = set()
        assigned = file.of("value", "assign")
        for value, bound in file.innermost((row[1], row[3], row[6]) for row in assigned).items():
            edges[value].append(bound[1])
            given.add(bound[1])
        passed = set() if purified else self._pass(file)
        for _, bound, _, _, _, _, _, base, _ in file.rows["bind"]:
            if base in ("assign", "loop"):
                if bound not in given:
                    seeds.add(bound)
            elif base != "param" or bound not in passed:
                seeds.add(bound)

    def _pass(self, file: File) -> set[int]:
        """Edges from arguments of local functions to parameters; the parameters that have some."""
        calls = file.innermost((row[1], row[3], row[6]) for row in file.of("call", ""))
        local = {row[8] for row in file.of("bind", "function") if row[2]}
        calls = {call: bound[8] for call, bound in calls.items() if bound[7] == "function" and bound[8] in local}
        params, passed = defaultdict(list), set()
        for row in file.of("bind", "param"):
            params[tuple(row[8].split(":")[:2])].append(row[1])
        for row in file.of("value", "arg") if calls else ():
            function = calls.get(int(row[6])) if row[6].isdecimal() else None
            for bound in params.get((function, row[8]), ()) if function is not None else ():
                self.edges[row[1]].append(bound)
                passed.add(bound)
        return passed

    def reached(self, seeds: Iterable[int], seen: set[int] | None = None) -> set[int]:
        """What the seeds reach, themselves included; not beyond what was `seen` before."""
        seen = seen or set()
        todo = [node for node in set(seeds) if node not in seen]
        found = set(todo)
        while todo:
            for node in self.edges.get(todo.pop(), ()):
                if node not in found and node not in seen:
                    found.add(node)
                    todo.append(node)
        return found


def _imported(detail: str) -> tuple[str, str]:
    """Specifier and original name of an import."""
    spec, name = detail.split(" ")[:2]
    return spec, name


def _composed_sql(file: File) -> Iterator[tuple]:
    found = [row for row in file.of("value", "composed") if not PARAMETERS.search(row[6].split(" ")[0]) and _says_sql(row[8])]
    if not found:
        return
    trust = Trust(file)
    bad, lines = trust.reached(trust.seeds), {}
    for _, value, _, lo, hi, line, name, _, _ in found:
        if value in bad:
            sink = name.split(" ")[1]
            lines[line] = min(lines.get(line, (lo, -hi, sink)), (lo, -hi, sink))
    for line, (_, _, sink) in lines.items():
        yield line, sink, "P005" if sink else "P004"


def _raw_sql(file: File) -> Iterator[tuple]:
    calls = {str(row[1]): row for row in file.rows["call"] if RAW_SQL.search(row[6])}
    texts = [row for row in file.of("value", "arg") if row[8] == "0" and row[6] in calls]
    if not texts:
        return
    trust = Trust(file)
    bad = trust.reached(trust.seeds)
    for row in texts:
        if row[1] in bad:
            yield calls[row[6]][5], calls[row[6]][6], ""


def _raw_html(file: File) -> Iterator[tuple]:
    """Of a file by itself, with a word before the name: `hit`; `safe name` of functions that are proven; `open name` of calls of imported functions that a value is made of (the value's id before the specifier)."""
    found = file.of("value", "html")
    proving = any(_imported(row[8])[0] in PURIFIERS for row in file.of("bind", "import"))
    if not found and not proving:
        return
    trust = Trust(file, True)
    bad = trust.reached(trust.seeds)
    for row in found:
        if row[1] in bad:
            yield row[5], "hit", ""
    still, own = [row for row in found if row[1] not in bad], defaultdict(list)
    reach = {use: trust.reached(owners, bad) for use, owners in trust.imported.items()}
    for row in still:
        for (name, spec), nodes in reach.items():
            if row[1] in nodes:
                yield row[5], f"open {name}", f"{row[1]} {spec}"
    alone = bad.union(*reach.values())
    for row in file.of("bind", "function"):
        if row[2] == 0 and row[8] in trust.results:
            own[row[6]] += trust.results[row[8]]
    for name, values in own.items():
        if not alone.intersection(values):
            yield 0, f"safe {name}", ""


class Rule(NamedTuple):
    judge: Callable[[File], Iterable[tuple]]
    #: What a file's text has if it has a hit; files without it need no parse.
    needs: Callable[[Column], Column]


_hooked = lambda text: text.rlike("use[A-Z]")
_effects = lambda text: F.contains(text, F.lit("useEffect")) | F.contains(text, F.lit("useLayoutEffect"))
RULES = {
    "R001": Rule(_conditional_hooks, _hooked),
    "R002": Rule(_nested_hooks, _hooked),
    "R003": Rule(_misplaced_hooks, _hooked),
    "R004": Rule(_effects_without_list, _effects),
    "R005": Rule(_missing_dependencies, _effects),
    "R007": Rule(_raw_html, lambda text: F.contains(text, F.lit("dangerouslySetInnerHTML")) | F.contains(text, F.lit("dompurify"))),
    "SQL": Rule(_composed_sql, lambda text: text.rlike(r"(?i)\b(select|insert|update|delete)\s")),
    "D003": Rule(_raw_sql, lambda text: text.rlike("SqlRaw|SqlQueryRaw")),
}
FOUND = "rel string, line int, name string, detail string"


def _closed(rule: str, found: DataFrame) -> DataFrame:
    """Hits under the columns of their rule."""
    if rule == "R007":
        return _with_proofs(found)
    if rule == "SQL":
        return found.select("rel", "line", F.col("detail").alias("rule"), F.col("name").alias("sink"))
    return found if rule == "R001" else found.drop("detail")


def of_files(files: DataFrame, rule: str) -> DataFrame:
    """A rule's hits in `files` (rel, language, content, skipped)."""
    judge, needs = RULES[rule]
    own = files.filter("skipped IS NULL").filter(needs(F.col("content").cast("string"))).select("rel", "language", "content")

    def judged(files: Iterator[tuple]) -> Iterator[tuple]:
        for rel, language, content in files:
            for hit in judge(File(row[1:] for row in file_rows(rel, language, content))):
                yield rel, *hit

    return _closed(rule, map_rows(own, judged, FOUND))


def of_rows(syntax: DataFrame, rule: str) -> DataFrame:
    """The same from rows of the scanner, which are brought together by file."""
    judge = RULES[rule].judge
    own = syntax.select(*NAMES).repartition("rel").sortWithinPartitions("rel", "id")

    def judged(rows: Iterator[tuple]) -> Iterator[tuple]:
        for rel, held in groupby(rows, itemgetter(0)):
            for hit in judge(File(row[1:] for row in held)):
                yield rel, *hit

    return _closed(rule, map_rows(own, judged, FOUND))


def _with_proofs(found: DataFrame) -> DataFrame:
    """What files left open is a hit unless another file proves each call that the value is made of. A file's rows are read three times, so they are checkpointed."""
    found = graphs._cut(found)
    word, name = F.substring_index("name", " ", 1), F.substring_index("name", " ", -1)
    safe = found.filter(word == "safe").select("rel", name.alias("name"))
    left = found.filter(word == "open").select("rel", "line", name.alias("name"), F.substring_index("detail", " ", 1).alias("id"), F.substring_index("detail", " ", -1).alias("spec"))
    proofs = graphs.imported_proofs(safe, left.select("rel", "name", "spec").distinct())
    unproven = left.join(proofs, ["rel", "name", "spec"], "left_anti").select("rel", "line", "id").distinct()
    return found.filter("name = 'hit'").select("rel", "line").union(unproven.select("rel", "line"))


def conditional_hooks(syntax: DataFrame) -> DataFrame:
    """R001: rel, line, name, detail; hooks inside of a condition, loop or try of their function, or behind a return that may have left it."""
    return of_rows(syntax, "R001")


def nested_hooks(syntax: DataFrame) -> DataFrame:
    """R002: rel, line, name; hooks in a function that is itself an argument of a hook."""
    return of_rows(syntax, "R002")


def misplaced_hooks(syntax: DataFrame) -> DataFrame:
    """R003: rel, line, name (the function's); hooks in a function that is no component, no hook, and not wrapped as one."""
    return of_rows(syntax, "R003")


def effects_without_list(syntax: DataFrame) -> DataFrame:
    """R004: rel, line, name."""
    return of_rows(syntax, "R004")


def missing_dependencies(syntax: DataFrame) -> DataFrame:
    """R005: rel, line, name (what is missing, by name, joined); what an effect reads of its component's taken-apart parameters and state, but doesn't list.

    A listed path covers itself and all that begins with it.
    """
    return of_rows(syntax, "R005")


def composed_sql(syntax: DataFrame) -> DataFrame:
    """P004, P005: rel, line, rule, sink; SQL put together from what isn't proven constant, P005 where it is passed to what executes SQL.

    Calls that make parameters of what is put in are clean. A line counts once.
    """
    return of_rows(syntax, "SQL")


def raw_sql(syntax: DataFrame) -> DataFrame:
    """D003: rel, line, name; raw SQL of the model whose text isn't proven constant."""
    return of_rows(syntax, "D003")


def raw_html(syntax: DataFrame) -> DataFrame:
    """R007: rel, line; HTML that is neither proven constant nor a purifier's result."""
    return of_rows(syntax, "R007")
