"""Scopes, own and inherited members, and names that stand for others, in Python sources."""

import itertools
import random

from factlake.sources import source_code
from factlake.sources.python_scopes import Module

SHADOWS = '''
import helper
from other import run as far
limit = 3

def run(): pass
def takes(run, *rest, key=run()):
    run(); rest(); key()
def local():
    run = far
    run()
def inner():
    import helper as h
    def deep():
        h.go(); run()
    return deep
def uses(): h.go()
def changes():
    global run
    run = far
    run()
class A:
    def run(self): pass
    def calls(self):
        run(); self.run(); self.x.run(); limit()
        [run() for run in self]; [f() for run in self for f in run()]
        return lambda run: run()
    @staticmethod
    def free(self): self.run()
    run()
print(len(run()))
try: pass
except E as err: err()
'''


def test_names_mean_what_the_innermost_scope_says():
    m = Module("m.py", SHADOWS)
    got = sorted((r.source, r.requested, r.via) for r in m.references if r.kind == "CALLS_DIRECT")
    assert got == sorted([
        ("m", "m.run", "name"), ("m.takes", "run", "value"), ("m.takes", "rest", "value"), ("m.takes", "key", "value"), ("m.local", "run", "value"),
        ("m.inner.deep", "helper.go", "name"), ("m.inner.deep", "m.run", "name"), ("m.uses", "m.h.go", "name"), ("m.changes", "m.run", "name"),
        ("m.A.calls", "m.run", "name"), ("m.A.calls", "m.A.run", "self"), ("m.A.calls", "self.x.run", "value"), ("m.A.calls", "m.limit", "name"),
        ("m.A.calls", "run", "value"), ("m.A.calls", "f", "value"), ("m.A.calls", "run", "value"), ("m.A.calls", "run", "value"), ("m.A.free", "self.run", "value"),
        ("m.A", "m.A.run", "name"), ("m", "builtins.print", "name"), ("m", "builtins.len", "name"), ("m", "m.run", "name"), ("m", "m.err", "name"),
    ])


def test_deep_code_is_read():
    m = Module("d.py", "x = " + "+".join(["f(1)"] * 300) + "\n" + "".join("    " * k + f"if f({k}):\n" for k in range(90)) + "    " * 90 + "pass\n")
    assert sum(r.kind == "CALLS_DIRECT" for r in m.references) == 390


def edges_of(spark, files):
    df = spark.createDataFrame(files, "path string, text string")
    edges, unresolved = source_code.python_edges(source_code.python_symbols(df), source_code.python_references(df), source_code.python_aliases(df))
    return {(r.source_key, r.kind, r.target_key) for r in edges.collect()}, {(r.source, r.requested_symbol, r.reason) for r in unresolved.collect()}


def test_inherited_members_across_files(spark):
    files = [
        ("base.py", "class Top:\n    def name(self): pass\n    def twice(self): self.name()\n"),
        ("left.py", "from base import Top\nclass Left(Top):\n    def name(self): super().name()\n"),
        ("right.py", "import base\nclass Right(base.Top):\n    def only(self): pass\n    def name(self): pass\n"),
        ("kit/__init__.py", "from left import Left as L\nfrom right import Right\n"),
        ("both.py", "import kit\nfrom kit import L\nclass Both(L, kit.Right):\n    def go(self):\n        self.name(); self.only(); self.twice(); self.none(); super().name(); kit.Right.twice(self)\n"),
        ("round.py", "class A(B): pass\nclass B(A):\n    def f(self): self.g()\n"),
        ("open.py", "from elsewhere import Base\nclass C(Base):\n    def f(self): self.g()\n"),
    ]
    edges, unresolved = edges_of(spark, files)
    calls = {(s, t) for s, k, t in edges if k == "CALLS_DIRECT"}
    assert calls == {
        ("base.Top.twice", "base.Top.name"), ("left.Left.name", "base.Top.name"), ("both.Both.go", "left.Left.name"), ("both.Both.go", "right.Right.only"),
        ("both.Both.go", "base.Top.twice"),
    }
    assert {(s, t) for s, k, t in edges if k == "EXTENDS"} == {("left.Left", "base.Top"), ("right.Right", "base.Top"), ("both.Both", "left.Left"), ("both.Both", "right.Right"), ("round.A", "round.B"), ("round.B", "round.A")}
    assert {u for u in unresolved if u[0] != "open"} >= {("both.Both.go", "both.Both.none", "SYMBOL_NOT_FOUND"), ("round.B.f", "round.B.g", "SYMBOL_NOT_FOUND"), ("open.C.f", "open.C.g", "SYMBOL_NOT_FOUND")}


def test_orders_are_those_of_the_language(spark):
    rng = random.Random(4)
    for _ in range(3):
        made, bases = {}, {}
        for i in range(25):
            for _ in range(20):
                mine = rng.sample(sorted(made), min(len(made), rng.randrange(4)))
                try:
                    made[f"K{i:02d}"] = type(f"K{i:02d}", tuple(made[b] for b in mine), {})
                except TypeError:
                    continue
                bases[f"K{i:02d}"] = mine
                break
        rows = [(c, b, k) for c, bs in bases.items() for k, b in enumerate(bs)]
        got = source_code.class_orders(spark.createDataFrame([(c,) for c in bases], "class string"), spark.createDataFrame(rows, "class string, base string, place int"))
        assert {r["class"]: r.line for r in got.collect()} == {c: [k.__name__ for k in made[c].__mro__[:-1]] for c in bases}
        assert max(len(list(itertools.chain(b))) for b in bases.values()) > 1
