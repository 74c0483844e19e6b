"""Facts from source text: Python modules by their syntax tree, lines of any language by patterns, and package manifests.

Files come as rows (path, text).  Nothing here is type-checked: relations are candidates, and what can't be told stays
unresolved.  Each file is parsed on its own; names meet across files in joins, and
inherited members in a fixpoint over base classes.
"""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlake.operators.traverse import cut, kept
from factlake.sources import lexer
from factlake.sources.python_scopes import Module

SYMBOLS = "path string, name string, qualified_name string, kind string, exported boolean, start_line long, end_line long"
REFERENCES = "path string, module string, source string, kind string, requested string, via string, line long, place long"
MANIFESTS = "path string, language string, name string, version string, dependency string, wanted string, problem string"


def _parse(path: str, text: str | None) -> tuple[list[tuple], list[tuple], list[tuple]] | str:
    """The symbols, references and aliases of one module, or why it can't be read."""
    try:
        m = Module(path, text or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return f"{type(e).__name__}: {e}"
    symbols = [(path, s.name, s.qualified_name, s.kind, s.kind == "module" or not s.name.startswith("_"), s.start_line, s.end_line) for s in m.symbols()]
    return symbols, [(path, m.name, *r) for r in m.references], [(path, *a) for a in m.aliases]


def _table(files: DataFrame, schema: str, rows_of) -> DataFrame:
    names, kinds = zip(*(c.split() for c in schema.split(", ")))
    types = [{"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}[k] for k in kinds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                rows = [r for path, text in zip(*(c.to_pylist() for c in part.columns)) for r in rows_of(path, text)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=list(names))

    return files.select("path", "text").filter("path is not null").mapInArrow(run, schema)


def _python(files: DataFrame) -> DataFrame:
    return files.filter(F.col("path").rlike(r"\.pyi?$"))


def python_symbols(files: DataFrame) -> DataFrame:
    """(path, name, qualified_name, kind, exported, start_line, end_line) of modules, classes, functions, methods, variables.

    A module that can't be read declares nothing; see :func:`python_unresolved`.
    """
    return _table(_python(files), SYMBOLS, lambda p, t: [] if isinstance(got := _parse(p, t), str) else got[0])


def python_references(files: DataFrame) -> DataFrame:
    """(path, module, source, kind, requested, via, line, place): imports, calls and base classes by what they ask for.

    ``via``: name (a dotted one), self or super (a class of this module and a member), value (a parameter or a local value).
    """
    return _table(_python(files), REFERENCES, lambda p, t: [] if isinstance(got := _parse(p, t), str) else got[1])


def python_aliases(files: DataFrame) -> DataFrame:
    """(path, name, stands_for): names that a module imports, which others can ask it for."""
    return _table(_python(files), "path string, name string, stands_for string", lambda p, t: [] if isinstance(got := _parse(p, t), str) else got[2])


def _followed(asked: DataFrame, aliases: DataFrame, rounds: int = 8) -> DataFrame:
    """``asked`` (requested, ...) with names that stand for others replaced, or the class before the last dot; a circle ends."""
    one = aliases.groupBy("name").agg(F.min("stands_for").alias("stands_for"), F.count_distinct("stands_for").alias("n")).filter("n = 1 and name <> stands_for")
    whole = one.select(F.col("name").alias("requested"), F.col("stands_for").alias("w"))
    owner = one.select(F.col("name").alias("owner"), F.col("stands_for").alias("o"))
    for _ in range(rounds):
        met = asked.withColumn("owner", F.regexp_replace("requested", r"\.[^.]*$", "")).join(whole, "requested", "left").join(owner, "owner", "left")
        member = F.concat_ws(".", "o", F.element_at(F.split("requested", r"\."), -1))
        new = cut(met.withColumn("moved", F.col("w").isNotNull() | F.col("o").isNotNull()).withColumn("requested", F.coalesce("w", F.when(F.col("o").isNotNull(), member), "requested")).drop("owner", "w", "o"))
        asked = new.drop("moved")
        if new.filter("moved").isEmpty():
            break
    return asked


def _linear(name: str, lines: list[list[str]], bases: list[str]) -> list[str]:
    """The order in which a class looks for its members: itself, then the orders of its bases merged so that each keeps its own.

    Where that can't be, what stands first is taken, as the class has no order at run time either.
    """
    rest = [list(x) for x in (*lines, bases) if x]
    out = [name]
    while rest:
        heads = [x[0] for x in rest]
        head = next((h for h in heads if not any(h in x[1:] for x in rest)), heads[0])
        out.append(head)
        rest = [x for x in ([c for c in line if c != head] for line in rest) if x]
    return out


def class_orders(classes: DataFrame, extends: DataFrame) -> DataFrame:
    """(class, line): each class with the classes that it has members of, in the order of search.

    ``extends`` (class, base, place).  A fixpoint over levels of inheritance: a class is done when its bases are; bases that
    nobody declares stand for themselves, and classes of a circle have none but themselves.
    """
    bases = extends.select("class", "base", "place").dropDuplicates(["class", "base"])
    known = bases.select(F.col("base").alias("class")).distinct().join(classes.select("class"), "class", "left_anti")
    plain = classes.select("class").distinct().join(bases.select("class").distinct(), "class", "left_anti")
    done = cut(known.union(plain).select("class", F.array("class").alias("line")))
    left = cut(bases.join(classes.select("class").distinct(), "class", "left_semi"))
    out = done
    schema = f"class {dict(classes.dtypes)['class']}, line array<string>"

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [_linear(c, [x["line"] for x in parts], [x["base"] for x in parts]) for c, parts in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.string()))], names=["class", "line"])

    while True:
        met = left.join(out.select(F.col("class").alias("base"), "line"), "base", "left").groupBy("class").agg(
            F.count_if(F.col("line").isNull()).alias("open"), F.array_sort(F.collect_list(F.struct("place", "base", "line"))).alias("parts")
        )
        new = cut(met.filter("open = 0").select("class", "parts").mapInArrow(merged, schema))
        if new.isEmpty():
            return out.union(left.select("class").distinct().select("class", F.array("class").alias("line")))
        out = out.union(new)
        left = cut(left.join(new.select("class"), "class", "left_anti"))


def python_edges(symbols: DataFrame, references: DataFrame, aliases: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges, unresolved): references whose name just one symbol declares, as candidates; the rest with the reason.

    Members that are asked of the own class, of what is above it, or of any class, are those of the first class in its order of
    search that declares them.  Names that a module has imported stand for what they were imported as.
    """
    asked = references.select("path", "source", "kind", "requested", "via", "line", "place")
    if aliases is not None:
        asked = _followed(asked, aliases)
    declared = cut(symbols.groupBy(F.col("qualified_name").alias("requested")).agg(F.count("*").alias("n"), F.min("kind").alias("is")))
    classes = declared.filter(F.col("is") == "class").select(F.col("requested").alias("class"))
    extends = asked.filter("kind = 'EXTENDS' and via <> 'value'").select(F.col("source").alias("class"), F.col("requested").alias("base"), "place")
    orders = cut(class_orders(classes, extends)).join(classes, "class", "left_semi")
    found = cut(asked.join(declared, "requested", "left"))
    # what isn't declared under its own name, or is asked of what is above, is looked for along the order
    member = found.filter("via <> 'value' and kind <> 'EXTENDS' and (n is null or via = 'super')")
    split = member.select("requested", "via").distinct().select(
        "requested", "via", F.regexp_replace("requested", r"\.[^.]*$", "").alias("class"), F.element_at(F.split("requested", r"\."), -1).alias("name")
    )
    above = split.join(orders, "class").select("requested", "via", "name", F.posexplode("line").alias("at", "owner")).filter("via <> 'super' or at > 0")
    named = above.select("requested", "via", "at", F.concat_ws(".", "owner", "name").alias("member"))
    first = named.join(declared.filter("n = 1").select(F.col("requested").alias("member")), "member").groupBy("requested", "via").agg(F.min_by("member", "at").alias("member"))
    all_asked = found.join(first, ["requested", "via"], "left")
    target = F.when(F.col("member").isNotNull(), F.col("member")).when((F.col("n") == 1) & ~F.col("via").isin("super", "value"), F.col("requested"))
    told = all_asked.withColumn("target", target)
    edges = told.filter("target is not null and source <> target").select(
        F.col("source").alias("source_key"), F.col("target").alias("target_key"), "kind", F.lit("CANDIDATE").alias("confidence"), F.lit("PYTHON_AST").alias("provenance")
    ).distinct()
    reason = F.when(F.col("via") == "value", "LOCAL_VALUE").when(F.col("n") > 1, "AMBIGUOUS_SYMBOL").otherwise("SYMBOL_NOT_FOUND")
    return edges, told.filter("target is null").select("path", "source", "kind", F.col("requested").alias("requested_symbol"), reason.alias("reason"), "line")


def python_unresolved(files: DataFrame) -> DataFrame:
    """(path, reason) of modules that can't be read."""
    return _table(_python(files), "path string, reason string", lambda p, t: [(p, got)] if isinstance(got := _parse(p, t), str) else [])


#: Where a word starts; engines differ in what a word boundary is beside letters with accents.
_START = r"(?:^|[^A-Za-z0-9_])"
#: The kinds of syntactic candidates, each with the patterns of a line that hold its name in group 1.
INVENTORY: dict[str, tuple[str, ...]] = {
    "DECLARATION": (_START + r"(?:func|def|fn|function|class|interface|struct|trait|enum|type|const|var|let)\s+([A-Za-z_]\w*)",),
    "IMPORT": (r"^\s*(?:import|from|use|require)\s+[\"'(]?([\w./@:-]+)",),
    "EXPORT": (r"^\s*(?:export|pub)\s+(?:default\s+)?(?:\w+\s+)*?(?:func|fn|function|class|interface|struct|trait|enum|type|const|let|var)\s+([A-Za-z_]\w*)",),
    "CALL": (_START + r"([A-Za-z_]\w*)\s*\(",),
    "IDENTIFIER": (_START + r"([A-Za-z_]\w*)",),
    "CLASS": (_START + r"(?:class|struct)\s+([A-Za-z_]\w*)",),
    "INTERFACE": (_START + r"(?:interface|trait|protocol)\s+([A-Za-z_]\w*)",),
    "METHOD": (r"^\s*func\s*\([^)]*\)\s*([A-Za-z_]\w*)",),
}


def syntax_candidates(files: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """(path, kind, name, line, start_byte, end_byte) of files in languages that are known by their suffix, from their tokens: what
    stands in comments and strings gives nothing."""
    wanted = frozenset(kinds or lexer.KINDS)

    def rows_of(path: str, text: str | None) -> list[tuple]:
        return [(path, *c) for c in lexer.candidates(text or "", lexer.language_of(path), wanted)]

    suffixes = "|".join(sorted(lexer.SUFFIXES))
    return _table(files.filter(F.col("path").rlike(rf"\.({suffixes})$")), "path string, kind string, name string, line long, start_byte long, end_byte long", rows_of)


def syntax_inventory(files: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """(path, kind, name, line, n): what stands in the lines of files, as candidates and never as symbols.

    Files of a known language by their tokens (:func:`syntax_candidates`), others by patterns of their lines, in built-ins.  Names
    are counted where their line is; only those of files that are tokenized, or whose path stands in several rows, are dealt out.
    """
    known = F.col("path").rlike(rf"\.({'|'.join(sorted(lexer.SUFFIXES))})$")
    twice = kept(files.filter(~known).groupBy(F.col("path").alias("again")).agg(F.count("*").alias("n")).filter("n > 1").select("again"))
    again = F.col("path") == F.col("again")
    one: Column = F.array(*(
        F.struct(F.lit(k).alias("kind"), F.flatten(F.array(*(F.regexp_extract_all("text", F.lit(p), F.lit(1)) for p in INVENTORY[k]))).alias("names"))
        for k in kinds or INVENTORY
    ))

    def names(some: DataFrame) -> DataFrame:
        lines = some.select("path", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
        return lines.select("path", (F.col("pos") + 1).cast("long").alias("line"), F.explode(one).alias("c")).select("path", "c.kind", "line", F.sort_array("c.names").alias("names"))

    # equal names of a line stand together: where each begins
    s = F.col("names")
    begins = names(files.filter(~known).join(twice, again, "left_anti")).withColumn("at", F.filter(F.transform(s, lambda x, i: i), lambda i: (i == 0) | (s[i] != s[i - 1])))
    runs = F.transform("at", lambda i, k: F.struct(s[i].alias("name"), (F.coalesce(F.get("at", k + 1), F.size(s)) - i).cast("long").alias("n")))
    alone = begins.select("path", "kind", "line", F.explode(runs).alias("r")).select("path", "kind", "r.name", "line", "r.n")
    each = names(files.filter(~known).join(twice, again, "left_semi")).select("path", "line", "kind", F.explode("names").alias("name"))
    lexed = syntax_candidates(files, kinds).select("path", "line", "kind", "name")
    return alone.union(each.union(lexed).groupBy("path", "kind", "name", "line").agg(F.count("*").alias("n")))


def _manifest(path: str, text: str | None) -> list[tuple]:
    """A row for each dependency of a manifest, or one without; a problem where it can't be read."""
    leaf = path.rsplit("/", 1)[-1]
    try:
        if leaf == "package.json":
            doc = json.loads(text or "")
            wanted = {**doc.get("devDependencies", {}), **doc.get("dependencies", {})}
            language, name, version = "typescript", doc.get("name"), doc.get("version")
        elif leaf == "Cargo.toml":
            doc = tomllib.loads(text or "")
            own = doc.get("package", {})
            wanted = {k: v if isinstance(v, str) else v.get("version") for k, v in doc.get("dependencies", {}).items()}
            language, name, version = "rust", own.get("name"), own.get("version")
        elif leaf == "pyproject.toml":
            own = tomllib.loads(text or "").get("project", {})
            wanted = {m[1]: m[2].strip() or None for m in (re.match(r"\s*([\w.-]+)\s*(?:\[[^]]*\])?(.*)", d) for d in own.get("dependencies", [])) if m}
            language, name, version = "python", own.get("name"), own.get("version")
        elif leaf == "go.mod":
            plain = re.sub(r"//[^\n]*", "", text or "")
            name = (re.search(r"^\s*module\s+(\S+)", plain, re.MULTILINE) or [None, None])[1]
            blocks = " \n".join(re.findall(r"^\s*require\s*\(([^)]*)\)", plain, re.MULTILINE)) + "\n" + "\n".join(re.findall(r"^\s*require\s+([^(\s]\S*\s+\S+)", plain, re.MULTILINE))
            wanted = dict(re.findall(r"(\S+)\s+(v\S+)", blocks))
            language, version = "go", None
        else:
            return []
        if not name:
            return [(path, language, None, None, None, None, "the manifest names no package")]
        text_of = lambda v: None if v is None else v if isinstance(v, str) else json.dumps(v)
        rows = [(path, language, str(name), text_of(version), str(k), text_of(v), None) for k, v in sorted(wanted.items())]
        return rows or [(path, language, str(name), text_of(version), None, None, None)]
    except (ValueError, AttributeError, TypeError) as e:
        return [(path, None, None, None, None, None, f"{type(e).__name__}: {e}")]


def manifests(files: DataFrame) -> DataFrame:
    """(path, language, name, version, dependency, wanted, problem) of package.json, Cargo.toml, pyproject.toml and go.mod."""
    return _table(files.filter(F.col("path").rlike(r"(^|/)(package\.json|Cargo\.toml|pyproject\.toml|go\.mod)$")), MANIFESTS, _manifest)


def discovered(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(packages, file owners) of a workspace's files: (root, language, name, version), and (path, root) with the nearest
    package above each file; files outside of any have a null root."""
    m = manifests(files).filter("problem is null")
    root = F.regexp_replace(F.col("path"), r"(^|/)[^/]*$", "")
    packages = m.select(root.alias("root"), "language", "name", "version").distinct()
    above = F.transform(F.sequence(F.lit(0), F.size(F.split("path", "/")) - 1), lambda n: F.array_join(F.slice(F.split("path", "/"), 1, n), "/"))
    each = files.select("path").distinct().select("path", F.explode(above).alias("root"))
    owner = each.join(packages.select("root").distinct(), "root").groupBy("path").agg(F.max_by("root", F.length("root")).alias("root"))
    return packages, files.select("path").distinct().join(owner, "path", "left")
