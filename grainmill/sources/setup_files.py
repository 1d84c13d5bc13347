"""SRC08: what a setup.py declares, by an abstract run of its module code; the file is never executed.

Each name has the set of what it may stand for at a place: the packaging function, a packaging module, or something else.
Alternatives run on copies and are united, with the state before if none of them need run. A call of a name that can only be
the packaging function declares its literal lists; one that may be it, or what isn't literal, makes the file incomplete. Bodies
that don't run on import (functions, lambdas, classes, generators) call nothing.
"""

from __future__ import annotations

import ast

FUNCTION, MODULE, OTHER = "function", "module", "other"
#: Modules whose `setup` declares a package, and the arguments that list what it needs.
PACKAGERS = ("setuptools", "distutils")
LISTS = ("install_requires", "setup_requires", "tests_require")
DEFERRED = (ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda, ast.ClassDef, ast.GeneratorExp)
Names = dict[str, frozenset[str]]


def _truth(test: ast.expr) -> bool | None:
    """The value of a constant condition; None if it isn't constant."""
    if isinstance(test, ast.UnaryOp) and isinstance(test.op, ast.Not):
        inner = _truth(test.operand)
        return None if inner is None else not inner
    return bool(test.value) if isinstance(test, ast.Constant) else None


class SetupFile:
    """found: (requirement, line) of what is declared for sure. incomplete: what couldn't be told. packages: whether a packaging module is imported."""

    def __init__(self, text: str):
        self.found: list[tuple[str, int]] = []
        self.incomplete: dict[str, None] = {}
        self.packages = self.called = False
        self.run(ast.parse(text).body, {})
        if self.packages and not self.called:
            self.incomplete["no call of setup that can be told"] = None

    def run(self, body: list[ast.stmt], names: Names) -> Names:
        for statement in body:
            names = self.step(statement, names)
        return names

    def step(self, s: ast.stmt, names: Names) -> Names:
        if isinstance(s, ast.Import):
            for a in s.names:
                if a.name.split(".")[0] in PACKAGERS:
                    self.packages = True
                    names = names | {a.asname or a.name.split(".")[0]: frozenset([MODULE])}
                else:
                    names = names | {a.asname or a.name.split(".")[0]: frozenset([OTHER])}
        elif isinstance(s, ast.ImportFrom):
            ours = (s.module or "").split(".")[0] in PACKAGERS
            self.packages |= ours
            names = names | {a.asname or a.name: frozenset([FUNCTION if ours and a.name == "setup" else OTHER]) for a in s.names}
        elif isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            for decorator in s.decorator_list:
                self.calls(decorator, names)
            names = names | {s.name: frozenset([OTHER])}
        elif isinstance(s, (ast.Assign, ast.AnnAssign, ast.AugAssign)):
            if s.value is not None:
                self.calls(s.value, names)
            targets = s.targets if isinstance(s, ast.Assign) else [s.target]
            names = names | {n.id: frozenset([OTHER]) for t in targets for n in ast.walk(t) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store)}
        elif isinstance(s, ast.If):
            self.calls(s.test, names)
            truth = _truth(s.test)
            names = self.either([s.body, s.orelse] if truth is None else [s.body if truth else s.orelse], names)
        elif isinstance(s, (ast.While, ast.For, ast.AsyncFor)):
            self.calls(s.test if isinstance(s, ast.While) else s.iter, names)
            if isinstance(s, ast.While) and _truth(s.test) is False:
                return self.run(s.orelse, names)
            names = self.either([s.body, s.orelse, []], names)
        elif isinstance(s, (ast.With, ast.AsyncWith)):
            for item in s.items:
                self.calls(item.context_expr, names)
            names = self.run(s.body, names)
        elif isinstance(s, (ast.Try, ast.TryStar)):
            names = self.run(s.finalbody, self.either([[*s.body, *s.orelse], *(h.body for h in s.handlers)], names))
        elif isinstance(s, ast.Match):
            self.calls(s.subject, names)
            names = self.either([*(c.body for c in s.cases), []], names)
        else:
            self.calls(s, names)
        return names

    def either(self, bodies: list[list[ast.stmt]], names: Names) -> Names:
        """What names may stand for after one of the bodies; an empty one leaves them as they are."""
        ends = [self.run(body, names) for body in bodies]
        # A name that an alternative doesn't know stands for something else there.
        return {n: frozenset().union(*(end.get(n, frozenset([OTHER])) for end in ends)) for n in {n for end in ends for n in end}}

    def calls(self, node: ast.AST, names: Names) -> None:
        todo = [node]
        while todo:
            n = todo.pop()
            if isinstance(n, DEFERRED):
                continue
            if isinstance(n, ast.Call) and (may := self.meaning(n.func, names)):
                self.called = True
                if len(may) == 1:
                    self.declared(n)
                else:
                    self.incomplete["a call that may be setup or not"] = None
            todo += list(ast.iter_child_nodes(n))[::-1]

    @staticmethod
    def meaning(callee: ast.expr, names: Names) -> frozenset[str]:
        """What the callee may stand for, if that may be the packaging function; else nothing."""
        if isinstance(callee, ast.Name):
            may = names.get(callee.id, frozenset())
            return may if FUNCTION in may else frozenset()
        if isinstance(callee, ast.Attribute) and callee.attr == "setup" and isinstance(callee.value, ast.Name):
            may = names.get(callee.value.id, frozenset())
            return may if MODULE in may else frozenset()
        return frozenset()

    def declared(self, call: ast.Call) -> None:
        for k in call.keywords:
            if k.arg is None:
                self.incomplete["arguments out of a table"] = None
            elif k.arg in LISTS:
                self.listed(k.value, k.arg)
            elif k.arg == "extras_require" and isinstance(k.value, ast.Dict):
                for value in k.value.values:
                    self.listed(value, k.arg)
            elif k.arg == "extras_require":
                self.incomplete[f"{k.arg} is not literal"] = None

    def listed(self, node: ast.expr, name: str) -> None:
        items = node.elts if isinstance(node, (ast.List, ast.Tuple)) else [node]
        for item in items:
            if item is not node and isinstance(item, ast.Constant) and isinstance(item.value, str):
                self.found.append((item.value, item.lineno))
            else:
                self.incomplete[f"{name} is not literal"] = None
