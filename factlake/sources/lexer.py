"""Tokens of source files and what they may be: syntactic candidates of eight kinds, never symbols.

A file is read once from left to right by a machine whose states are code, comments (which may nest), strings of each
language's kinds, and templates, which hold code again.  What stands in comments and strings gives nothing.  Candidates are
told from the tokens beside them, with the brackets around: a name behind ``class`` is a class, a name before a parenthesis is
a call, or a method where a class's body holds it and a body of its own follows.

Texts that end within anything are read as far as they go.  Time is linear in the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

KINDS = ("DECLARATION", "IMPORT", "EXPORT", "CALL", "IDENTIFIER", "CLASS", "INTERFACE", "METHOD")
#: Languages by the suffixes of their files.
SUFFIXES = {
    "go": "go", "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript", "js": "typescript", "jsx": "typescript", "mjs": "typescript", "cjs": "typescript",
    "py": "python", "pyi": "python", "rs": "rust", "dart": "dart",
}
#: Words that declare the name behind them, and words that are no names.
DECLARING = {
    "go": "func type const var", "typescript": "function class interface enum type const let var namespace", "python": "def class",
    "rust": "fn struct enum trait type const static mod union", "dart": "class enum mixin extension typedef const final var",
}
RESERVED = {
    "go": "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var",
    "typescript": "as async await break case catch class const continue debugger default delete do else enum export extends finally for from function get if implements import in instanceof interface let "
    "namespace new of private protected public readonly return set static super switch this throw try type typeof var void while with yield abstract declare",
    "python": "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield",
    "rust": "as async await break const continue crate dyn else enum extern fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait type union unsafe use where while",
    "dart": "abstract as assert async await break case catch class const continue default do else enum export extends extension factory final finally for get if implements import in is late library mixin "
    "new on part required rethrow return set show static super switch sync this throw try typedef var void while with yield",
}
_DECLARING = {k: frozenset(v.split()) for k, v in DECLARING.items()}
_RESERVED = {k: frozenset(v.split()) for k, v in RESERVED.items()}
_CLOSES = {")": "(", "]": "[", "}": "{"}

_LINE = r"(?P<comment>//[^\n]*)|(?P<block>/\*)"
_NAME = r"(?P<name>[^\W\d]\w*)|(?P<number>\d[\w.]*)|(?P<space>\s+)|(?P<sign>=>|::|->|.)"
_QUOTED = r"\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?"
_START = {
    "go": rf"{_LINE}|(?P<string>\"(?:\\.|[^\"\\\n])*\"?|`[^`]*`?|'(?:\\.|[^'\\\n])*'?)|{_NAME}",
    "typescript": rf"{_LINE}|(?P<string>{_QUOTED})|(?P<template>`)|{_NAME}",
    "python": rf"(?P<comment>\#[^\n]*)|(?P<string>(?i:[rbuft]{{0,2}})(?:\"\"\"(?:\\.|[^\\])*?(?:\"\"\"|\Z)|'''(?:\\.|[^\\])*?(?:'''|\Z)|{_QUOTED}))|{_NAME}",
    "rust": rf"{_LINE}|(?P<string>b?r(?P<hashes>\#*)\".*?(?:\"(?P=hashes)|\Z)|b?\"(?:\\.|[^\"\\])*\"?|b?'(?:\\[^\n]*?|[^'\\\n])')|(?P<life>'\w*)|{_NAME}",
    "dart": rf"{_LINE}|(?P<string>r?(?:\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z))|r\"[^\"\n]*\"?|r'[^'\n]*'?|{_QUOTED})|{_NAME}",
}
_LEXERS = {k: re.compile(v, re.DOTALL) for k, v in _START.items()}
_BLOCK = re.compile(r"/\*|\*/")
_TEMPLATE = re.compile(r"(?:\\.|[^`\\$]|\$(?!\{)|\\\Z)*+(`|\$\{|\Z)", re.DOTALL)
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/\w*")
#: Behind these a slash begins a pattern.
_BEFORE_REGEX = frozenset("( , = : [ ! & | ? { } ; + - * % ~ ^ < > =>".split()) | {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "await", "yield"}


class Token(NamedTuple):
    kind: str  # name, string, sign or number
    text: str
    start: int
    end: int


class Candidate(NamedTuple):
    kind: str
    name: str
    line: int
    start_byte: int
    end_byte: int


def language_of(path: str) -> str | None:
    return SUFFIXES.get(path.rsplit("/", 1)[-1].rpartition(".")[2]) if "." in path.rsplit("/", 1)[-1] else None


def tokens(text: str, language: str) -> Iterator[Token]:
    """The tokens of code; comments and space are left out, strings are whole."""
    lexer, at, n = _LEXERS[language], 0, len(text)
    last = ""
    #: Of each template that is open, how many braces are open in its code.
    inside: list[int] = []
    while at < n:
        m = lexer.match(text, at)
        kind, at = m.lastgroup if m.lastgroup != "hashes" else "string", m.end()
        if kind == "block":
            depth = 1
            while depth and (e := _BLOCK.search(text, at)):
                depth += (1 if language in ("rust", "dart") else 0) if e[0] == "/*" else -1
                at = e.end()
            at = n if depth else at
            continue
        if kind in ("comment", "space", "life"):
            continue
        if kind == "template" or (kind == "sign" and m[0] == "}" and inside and inside[-1] == 0):
            if kind == "sign":
                inside.pop()
            e = _TEMPLATE.match(text, at)
            at = e.end()
            if e[1] == "${":
                inside.append(0)
            yield Token("string", text[m.start() : at], m.start(), at)
            last = "`" if e[1] != "${" else "{"
            continue
        if kind == "sign" and m[0] == "/" and language == "typescript" and (not last or last in _BEFORE_REGEX) and (r := _REGEX.match(text, m.start())):
            at, last = r.end(), "/"
            yield Token("string", r[0], r.start(), at)
            continue
        if inside and kind == "sign" and m[0] in "{}":
            inside[-1] += 1 if m[0] == "{" else -1
        last = m[0]
        yield Token(kind, m[0], m.start(), at)


def _brackets(ts: list[Token]) -> dict[int, int]:
    """For each opening bracket that is closed, where."""
    open_at: list[int] = []
    out = {}
    for i, t in enumerate(ts):
        if t.kind == "sign" and t.text in "([{":
            open_at.append(i)
        elif t.kind == "sign" and t.text in _CLOSES:
            while open_at and ts[open_at[-1]].text != _CLOSES[t.text]:
                open_at.pop()
            if open_at:
                out[open_at.pop()] = i
    return out


def _bodies(ts: list[Token], word: str) -> list[bool]:
    """Of each token, whether the innermost brace around it is the body of what ``word`` declares."""
    out, stack, coming = [], [], False
    for i, t in enumerate(ts):
        out.append(bool(stack and stack[-1][1]))
        if t.kind == "name" and t.text == word and (not i or ts[i - 1].text != "."):
            coming = True
        elif t.text == "{" and t.kind == "sign":
            stack.append((i, coming))
            coming = False
        elif t.text == "}" and t.kind == "sign" and stack:
            stack.pop()
        elif t.text == ";" and t.kind == "sign":
            coming = False
    return out


def _plain(string: str) -> str:
    return re.sub(r"^[rbuftRBUFT]*", "", string).strip("\"'`")


def candidates(text: str, language: str, kinds: frozenset[str] = frozenset(KINDS)) -> list[Candidate]:
    """All candidates of a file in the order of its bytes."""
    ts = list(tokens(text, language))
    ends = _brackets(ts)
    opens = {b: a for a, b in ends.items()}
    reserved, declaring = _RESERVED[language], _DECLARING[language]
    in_class = _bodies(ts, "class") if language in ("typescript", "dart") else [False] * len(ts)
    found: list[tuple[str, str, int, int]] = []
    word = lambda i: ts[i].text if 0 <= i < len(ts) and ts[i].kind == "name" else ""
    sign = lambda i: ts[i].text if 0 <= i < len(ts) and ts[i].kind == "sign" else ""
    add = lambda kind, i, name=None: found.append((kind, name if name is not None else ts[i].text, ts[i].start, ts[i].end))

    def has_body(i: int) -> bool:
        """Whether behind the parenthesis at i, and a type, a body follows."""
        j = ends.get(i, len(ts)) + 1
        if sign(j) == ":":
            j += 1
            while j < len(ts) and (ts[j].kind in ("name", "string") or sign(j) in (".", "|", "&", "<", ">", "[", "]", ",")):
                j += 1
        return sign(j) == "{" or sign(j) == "=>"

    def dotted(i: int, dot: str) -> tuple[str, int]:
        parts = []
        while word(i) and (word(i) not in reserved or word(i) in ("self", "super", "crate")):
            parts.append(word(i))
            if sign(i + 1) != dot:
                return dot.join(parts), i + 1
            i += 2
        return dot.join(parts), i

    grouped, grouped_end = "", -1  # within the parenthesis of Go's import, const, var or type
    first = ""  # what the line begins with
    for i, t in enumerate(ts):
        begins = not i or "\n" in text[ts[i - 1].end : t.start]
        if begins:
            first = t.text
        if t.kind != "name":
            if t.kind == "string" and language == "go" and grouped == "import":
                add("IMPORT", i, _plain(t.text))
            elif i == grouped_end:
                grouped = ""
            continue
        before, after = word(i - 1), sign(i + 1)
        if t.text not in reserved or before in declaring and t.text in ("get", "set", "of", "from", "type", "as"):
            add("IDENTIFIER", i)
            method = False
            if language == "go" and sign(i - 1) == ")" and after in ("(", "["):
                receiver = opens.get(i - 1)
                method = receiver is not None and word(receiver - 1) == "func"
            elif in_class[i] and after in ("(", "<") and sign(i - 1) != ".":
                at = i + 1
                while at < len(ts) and sign(at) != "(" and at - i < 64:
                    at += 1
                method = has_body(at)
            if method:
                add("METHOD", i)
                add("DECLARATION", i)
            elif before in declaring or (language == "go" and grouped in ("const", "var", "type") and begins):
                add("DECLARATION", i)
                if before == "class":
                    add("CLASS", i)
                elif before == "interface":
                    add("INTERFACE", i)
            elif after == "(" or (after == "!" and language == "rust" and sign(i + 2) in ("(", "[", "{")):
                add("CALL", i)
            if language == "go" and before == "type" and word(i + 1) == "interface":
                add("INTERFACE", i)
            if language == "typescript" and t.text == "require" and after == "(" and i + 2 < len(ts) and ts[i + 2].kind == "string":
                add("IMPORT", i + 2, _plain(ts[i + 2].text))
            continue
        if language == "go" and t.text in ("import", "const", "var", "type") and after == "(":
            grouped, grouped_end = t.text, ends.get(i + 1, -1)
        elif t.text == "import" and language in ("go", "dart", "typescript"):
            j = next((j for j in range(i + 1, min(len(ts), i + 400)) if ts[j].kind == "string" or sign(j) == ";"), None)
            if j is not None and ts[j].kind == "string" and sign(i + 1) != ".":
                add("IMPORT", j, _plain(ts[j].text))
        elif t.text == "import" and language == "python" and first != "from":
            j = i + 1
            while word(j):
                name, end = dotted(j, ".")
                if not name:
                    break
                add("IMPORT", j, name)
                end += 2 if word(end) == "as" else 0
                if sign(end) != ",":
                    break
                j = end + 1
        elif t.text == "from" and language == "python" and begins:
            j, dots = i + 1, ""
            while sign(j) == ".":
                dots, j = dots + ".", j + 1
            name = dotted(j, ".")[0] if word(j) != "import" else ""
            if dots or name:
                add("IMPORT", min(j, len(ts) - 1), dots + name)
        elif t.text == "use" and language == "rust":
            name, _ = dotted(i + 1, "::")
            if name:
                add("IMPORT", i + 1, name)
        elif t.text == "export" and language in ("typescript", "dart"):
            j = i + 1
            if sign(j) == "{":
                for k in range(j + 1, ends.get(j, len(ts))):
                    if word(k) and sign(k + 1) in (",", "}") and k:
                        add("EXPORT", k)
            elif language == "dart":
                if j < len(ts) and ts[j].kind == "string":
                    add("EXPORT", j, _plain(ts[j].text))
            else:
                while word(j) in reserved and word(j):
                    j += 1
                if word(j):
                    add("EXPORT", j)
    found = sorted((f for f in found if f[0] in kinds), key=lambda f: (f[2], f[3], f[0]))
    return _placed(text, found)


def _placed(text: str, found: list[tuple[str, str, int, int]]) -> list[Candidate]:
    """Lines and bytes of what is found, in one pass over the text."""
    out, at, byte, line = [], 0, 0, 1
    for kind, name, start, end in found:
        part = text[at:start]
        byte, line, at = byte + len(part.encode()), line + part.count("\n"), start
        out.append(Candidate(kind, name, line, byte, byte + len(text[start:end].encode())))
    return out
