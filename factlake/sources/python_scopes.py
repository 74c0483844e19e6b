"""What a Python module declares and refers to, by the language's rules of scope.

A module is read into scopes: each has the names that are bound in it and where it stands.  A name means what the innermost
scope says that binds it; the bodies of classes are seen by themselves alone, ``global`` and ``nonlocal`` pass scopes over, and
comprehensions and lambdas have scopes of their own.  So a parameter or a local value hides a function of the module, an import
within a function is known there alone, and the first parameter of a method stands for its class.

One file is read on its own; what its names mean in other files is for joins (:mod:`factlake.sources.source_code`).
"""

from __future__ import annotations

import ast
import builtins
import re
from dataclasses import dataclass, field
from typing import NamedTuple

_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
_COMPREHENSIONS = (ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp)
_BUILTINS = frozenset(dir(builtins))


class Symbol(NamedTuple):
    name: str
    qualified_name: str
    kind: str
    start_line: int
    end_line: int


class Reference(NamedTuple):
    """``via``: name (a dotted one), self or super (``requested`` is the class and the member), value (it can't be told)."""

    source: str
    kind: str
    requested: str
    via: str
    line: int
    place: int


@dataclass
class Scope:
    kind: str  # module, class, function or inner (a comprehension or a lambda)
    qualified: str
    parent: Scope | None = None
    #: What names are bound to: (import, dotted), (declared, qualified), (self, class) or (value, name).
    names: dict[str, tuple[str, str]] = field(default_factory=dict)
    elsewhere: dict[str, str] = field(default_factory=dict)  # global or nonlocal
    #: The class that a method, and what is in it, belongs to.
    of_class: str | None = None

    def bind(self, name: str, what: str, to: str) -> None:
        """The first declaration or import of a name stands, but in a function any value makes it a value."""
        if name not in self.elsewhere:
            if self.kind in ("function", "inner") and what == "value":
                self.names[name] = (what, to)
            else:
                self.names.setdefault(name, (what, to))

    def meaning(self, name: str) -> tuple[str, str] | None:
        scope, here = self, True
        while scope is not None:
            if scope.elsewhere.get(name) == "global":
                while scope.parent is not None:
                    scope = scope.parent
            elif name in scope.names and (here or scope.kind != "class"):
                return scope.names[name]
            scope, here = scope.parent, False
        return None


def module_of(path: str) -> str:
    """The dotted name of a module: its path without the suffix; a package is named by its folder."""
    parts = re.sub(r"\.pyi?$", "", path).strip("/").split("/")
    return ".".join(parts[:-1] if parts[-1] == "__init__" and len(parts) > 1 else parts)


class Module:
    """One parsed file.  Raises what the parser raises."""

    def __init__(self, path: str, text: str) -> None:
        tree = ast.parse(text)
        self.name = module_of(path)
        self.package = path.rsplit("/", 1)[-1].startswith("__init__.")
        last = text.count("\n") + 1
        self.declared = [Symbol(self.name.rsplit(".", 1)[-1], self.name, "module", 1, last)]
        self.references: list[Reference] = []
        #: Names that other modules can ask this one for, and what they stand for: (name, dotted).
        self.aliases: list[tuple[str, str]] = []
        top = Scope("module", self.name)
        #: Bodies that are still to be read: their scope, their statements, and whose they are.
        self._todo: list[tuple[Scope, list[ast.AST], str]] = [(top, tree.body, self.name)]
        while self._todo:
            self._read(*self._todo.pop())
        self.aliases = [(f"{self.name}.{n}", to) for n, (what, to) in top.names.items() if what == "import"]

    def symbols(self) -> list[Symbol]:
        """Of several declarations of one name the first counts."""
        first: dict[str, Symbol] = {}
        for s in sorted(self.declared, key=lambda s: s.start_line):
            first.setdefault(s.qualified_name, s)
        return list(first.values())

    def _base(self, node: ast.ImportFrom) -> str:
        up = self.name.split(".")
        kept = up[: len(up) - node.level + self.package] if node.level else []
        return ".".join([*kept, *([node.module] if node.module else [])])

    def _read(self, scope: Scope, body: list[ast.AST], owner: str) -> None:
        """All of a scope is bound before anything in it is looked up: a name means the same in its whole scope."""
        mine: list[ast.AST] = []
        todo = list(reversed(body))
        while todo:  # a stack: code may be nested deeply
            node = todo.pop()
            mine.append(node)
            if isinstance(node, (*_FUNCTIONS, ast.ClassDef)):
                outer = [*node.decorator_list]
                if isinstance(node, ast.ClassDef):
                    outer += [*node.bases, *(k.value for k in node.keywords)]
                else:
                    outer += [*node.args.defaults, *filter(None, node.args.kw_defaults)]
                todo += reversed(outer)
            elif isinstance(node, ast.Lambda):
                todo += reversed([*node.args.defaults, *filter(None, node.args.kw_defaults)])
            elif isinstance(node, _COMPREHENSIONS):
                todo.append(node.generators[0].iter)
                # a walrus in a comprehension binds around it
                for inner in ast.walk(node):
                    if isinstance(inner, ast.NamedExpr):
                        scope.bind(inner.target.id, "value", inner.target.id)
            else:
                todo += reversed(list(ast.iter_child_nodes(node)))
        for node in mine:
            if isinstance(node, (ast.Global, ast.Nonlocal)) and scope.kind != "module":
                scope.elsewhere |= dict.fromkeys(node.names, "global" if isinstance(node, ast.Global) else "nonlocal")
        for node in mine:
            self._bind(scope, node)
        for node in mine:
            self._use(scope, node, owner)

    def _bind(self, scope: Scope, node: ast.AST) -> None:
        own = lambda name: f"{scope.qualified}.{name}"
        if isinstance(node, (*_FUNCTIONS, ast.ClassDef)):
            scope.bind(node.name, "declared", own(node.name))
        elif isinstance(node, ast.Import):
            for a in node.names:
                short = a.name.split(".")[0]
                scope.bind(a.asname or short, "import", a.name if a.asname else short)
        elif isinstance(node, ast.ImportFrom):
            for a in node.names:
                scope.bind(a.asname or a.name, "import", f"{self._base(node)}.{a.name}")
        else:
            bound = []
            if isinstance(node, ast.Name) and isinstance(node.ctx, (ast.Store, ast.Del)):
                bound = [node.id]
            elif isinstance(node, (ast.ExceptHandler, ast.MatchAs, ast.MatchStar)) and node.name:
                bound = [node.name]
            elif isinstance(node, ast.MatchMapping) and node.rest:
                bound = [node.rest]
            for name in bound:
                # a variable of a module is a declaration that others can name
                scope.bind(name, *(("declared", own(name)) if scope.kind == "module" else ("value", name)))

    def _use(self, scope: Scope, node: ast.AST, owner: str) -> None:
        if isinstance(node, ast.Import):
            for a in node.names:
                self._refer(owner, "IMPORTS_SYMBOL", (a.name, "name"), node)
        elif isinstance(node, ast.ImportFrom):
            for a in node.names:
                self._refer(owner, "IMPORTS_SYMBOL", (f"{self._base(node)}.{a.name}", "name"), node)
        elif isinstance(node, ast.Call):
            self._refer(owner, "CALLS_DIRECT", self._asked(scope, node.func), node)
        elif isinstance(node, (ast.Assign, ast.AnnAssign)) and scope.kind == "module":
            for target in node.targets if isinstance(node, ast.Assign) else [node.target]:
                for part in target.elts if isinstance(target, (ast.Tuple, ast.List)) else [target]:
                    if isinstance(part, ast.Name):
                        self.declared.append(Symbol(part.id, f"{self.name}.{part.id}", "variable", node.lineno, node.end_lineno))
        elif isinstance(node, ast.ClassDef):
            qualified = f"{scope.qualified}.{node.name}"
            self.declared.append(Symbol(node.name, qualified, "class", node.lineno, node.end_lineno))
            for place, base in enumerate(node.bases):
                self._refer(qualified, "EXTENDS", self._asked(scope, base), base, place)
            self._todo.append((Scope("class", qualified, scope), node.body, qualified))
        elif isinstance(node, _FUNCTIONS):
            qualified = f"{scope.qualified}.{node.name}"
            method = scope.kind == "class"
            self.declared.append(Symbol(node.name, qualified, "method" if method else "function", node.lineno, node.end_lineno))
            inner = Scope("function", qualified, scope, of_class=scope.qualified if method else scope.of_class)
            plain = any(isinstance(d, ast.Name) and d.id == "staticmethod" for d in node.decorator_list)
            self._parameters(inner, node.args, scope.qualified if method and not plain else None)
            self._todo.append((inner, node.body, qualified))
        elif isinstance(node, (ast.Lambda, *_COMPREHENSIONS)):
            inner = Scope("inner", scope.qualified, scope, of_class=scope.of_class)
            if isinstance(node, ast.Lambda):
                self._parameters(inner, node.args, None)
                self._todo.append((inner, [node.body], owner))
            else:
                parts = [node.key, node.value] if isinstance(node, ast.DictComp) else [node.elt]
                for k, g in enumerate(node.generators):
                    parts += [g.target, *g.ifs, *([g.iter] if k else [])]
                self._todo.append((inner, parts, owner))

    @staticmethod
    def _parameters(scope: Scope, args: ast.arguments, of_class: str | None) -> None:
        every = [*args.posonlyargs, *args.args, *filter(None, [args.vararg]), *args.kwonlyargs, *filter(None, [args.kwarg])]
        for k, a in enumerate(every):
            first = k == 0 and of_class is not None and (args.posonlyargs or args.args)
            scope.names[a.arg] = ("self", of_class) if first else ("value", a.arg)

    def _refer(self, source: str, kind: str, asked: tuple[str, str] | None, node: ast.AST, place: int = 0) -> None:
        if asked:
            self.references.append(Reference(source, kind, *asked, node.lineno, place))

    def _asked(self, scope: Scope, node: ast.expr) -> tuple[str, str] | None:
        """What an expression names, and how."""
        attributes: list[str] = []
        while isinstance(node, ast.Attribute):
            attributes.append(node.attr)
            node = node.value
        if isinstance(node, ast.Subscript) and not attributes:  # a generic base class
            return self._asked(scope, node.value)
        attributes.reverse()
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id == "super" and scope.of_class:
            return (f"{scope.of_class}.{attributes[0]}", "super") if len(attributes) == 1 else None
        if not isinstance(node, ast.Name):
            return None
        what, to = scope.meaning(node.id) or (None, None)
        if what is None:
            home = "builtins" if node.id in _BUILTINS else self.name
            what, to = "name", f"{home}.{node.id}"
        if what == "self":
            return (f"{to}.{attributes[0]}", "self") if len(attributes) == 1 else (".".join([node.id, *attributes]), "value")
        return ".".join([to, *attributes]), "value" if what == "value" else "name"
