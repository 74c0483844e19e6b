"""Symbol search, selector and name resolution, filters, local signatures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlake.schema import DERIVED_PREFIX, MAX_PAGE, Graph

MODES = ("exact", "qualified_exact", "prefix", "substring")


def located(graph: Graph, symbols: DataFrame | None = None) -> DataFrame:
    """Symbols with the path, language, package and repository of the file that holds them, whatever columns of the kind they
    have themselves.

    Files, packages and repositories are joined on their keys and left to Catalyst to broadcast by their measured size.
    """
    s = (graph.symbols if symbols is None else symbols).drop("path", "language", "package_key", "package_name", "repository_key", "repository")
    files = graph.files.select(F.col("stable_key").alias("file_key"), "path", "package_key", F.col("repository_key"), F.col("language").alias("language"))
    packages = graph.packages.select(F.col("stable_key").alias("package_key"), F.col("name").alias("package_name"))
    repositories = graph.repositories.select(F.col("stable_key").alias("repository_key"), F.col("name").alias("repository"))
    return s.join(files, "file_key").join(packages, "package_key").join(repositories, "repository_key")


def keeps_derived(repository: Column, include_derived: bool = False, named: str | None = None) -> Column:
    """Rows of derived repositories go unless they are asked for or the repository is named."""
    if include_derived or (named or "").startswith(DERIVED_PREFIX):
        return F.lit(True)
    return ~repository.startswith(DERIVED_PREFIX)


def find_symbols(
    graph: Graph, name: str, mode: str = "exact", kind: str | None = None, repository: str | None = None,
    path_prefix: str | None = None, include_derived: bool = False,
) -> DataFrame:
    """Symbols by name; byte-exact and case-sensitive.  Only the tables that a filter needs are joined."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    test = {
        "exact": F.col("name") == name, "qualified_exact": F.col("qualified_name") == name,
        "prefix": F.col("name").startswith(name), "substring": F.col("name").contains(name),
    }[mode]
    out = graph.symbols.filter(test)
    if kind:
        out = out.filter(F.col("kind") == kind)
    needs_repository = bool(repository) or not include_derived
    if path_prefix or needs_repository:
        out = out.join(
            graph.files.select(F.col("stable_key").alias("file_key"), "path", "repository_key"), "file_key"
        )
    if path_prefix:
        # a plain prefix: no separator is required behind it
        out = out.filter(F.col("path").startswith(path_prefix))
    if needs_repository:
        names = graph.repositories.select(F.col("stable_key").alias("repository_key"), F.col("name").alias("repository"))
        out = out.join(names, "repository_key").filter(keeps_derived(F.col("repository"), include_derived, repository))
        if repository:
            out = out.filter(F.col("repository") == repository)
    return out.select("stable_key", "name", "qualified_name", "kind", "file_key", "start_line", "end_line")


class AmbiguousSymbol(ValueError):
    """More than one symbol fits; none is picked."""


class SymbolNotFound(LookupError):
    """No symbol fits."""


def resolve(
    graph: Graph, stable_key: str | None = None, qualified_name: str | None = None,
    repository: str | None = None, path: str | None = None,
) -> str:
    """The one symbol's key that the selector names; ambiguity is an error that lists the candidates."""
    if bool(stable_key) == bool(qualified_name):
        raise ValueError("give a key or a qualified name, and not both")
    if stable_key and (repository or path):
        raise ValueError("repository and path narrow a qualified name only")
    s = graph.symbols.filter(F.col("stable_key") == stable_key if stable_key else F.col("qualified_name") == qualified_name)
    if repository or path:
        s = located(graph, s)
        if repository:
            s = s.filter(F.col("repository") == repository)
        if path:
            s = s.filter(F.col("path").startswith(path))
    found = [r["stable_key"] for r in s.select("stable_key").orderBy("stable_key").limit(MAX_PAGE + 1).collect()]
    return _only(found, stable_key or qualified_name)


#: The kinds that declare a name; others only mention it.
DECLARATION_KINDS = (
    "function", "func", "method", "class", "interface", "struct", "enum", "type", "trait", "const", "variable", "field", "module",
    "namespace",
)


def resolve_name(graph: Graph, name: str) -> str:
    """The one declaration of an unqualified name; a name that is only mentioned is told apart from an unknown one."""
    s = graph.symbols.filter(F.col("name") == name)
    found = s.filter(F.col("kind").isin(*DECLARATION_KINDS)).select("stable_key").orderBy("stable_key").limit(MAX_PAGE + 1).collect()
    if not found and not s.isEmpty():
        raise SymbolNotFound(f"{name} is mentioned but not declared")
    return _only([r["stable_key"] for r in found], name)


def resolve_all(graph: Graph, wanted: DataFrame, column: str = "qualified_name", kinds: tuple[str, ...] | None = None) -> DataFrame:
    """Many selectors at once: for each value its number of symbols and, if there is just one, its key.

    With ``kinds``, others only mention a value; one that is mentioned but not declared is MENTIONED_ONLY.
    """
    counts = F.lit(True) if kinds is None else F.col("kind").isin(*kinds)
    s = graph.symbols.select(F.col(column).alias("wanted"), "stable_key", counts.alias("declares"))
    n = F.count_if(F.col("stable_key").isNotNull() & F.col("declares"))
    return wanted.select(F.col(column).alias("wanted")).distinct().join(s, "wanted", "left").groupBy("wanted").agg(
        n.alias("candidates"), F.when(n == 1, F.min(F.when(F.col("declares"), F.col("stable_key")))).alias("stable_key"),
        F.when((n == 0) & (F.count("stable_key") > 0), "MENTIONED_ONLY").when(n == 0, "SYMBOL_NOT_FOUND").when(n > 1, "AMBIGUOUS_SYMBOL")
        .otherwise("RESOLVED").alias("status"),
    )


def _only(found: list[str], wanted: str) -> str:
    if not found:
        raise SymbolNotFound(str(wanted))
    if len(found) > 1:
        raise AmbiguousSymbol(f"{wanted}: {', '.join(found[:20])}")
    return found[0]


def local_signature(signature: Column, package: Column) -> Column:
    """A signature without the prefix of the package inside which it is shown."""
    return F.replace(signature, F.concat(package, F.lit(".")), F.lit(""))
