"""From the files of a project to a published generation: discover, read facts, resolve, validate, publish."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlake.functions import keys
from factlake.schema import EVIDENCE, Graph
from factlake.sources import source_code
from factlake.sources.tables import Generations

LANGUAGE = "python"


def python_graph(files: DataFrame, repository: str, commit: str | None = None) -> Graph:
    """The graph of the Python modules among files (path, text): each package is the nearest manifest's folder, or the repository.

    Symbols are keyed by their qualified names; where several files declare one, the file that is first by path counts.
    """
    spark = files.sparkSession
    repo, language = F.lit(f"repository:{repository}"), F.lit(LANGUAGE)
    text = lambda v: F.lit(v).cast("string")
    found, owners = source_code.discovered(files)
    own = owners.filter(F.col("path").rlike(r"\.pyi?$")).select("path", F.coalesce("root", F.lit("")).alias("root"))
    named = found.filter("language = 'python'").groupBy("root").agg(F.min(F.struct("name", "version")).alias("m")).select("root", "m.name", "m.version")
    packages = own.select("root").distinct().join(named, "root", "left").withColumn(
        "name", F.coalesce("name", F.when(F.col("root") == "", F.lit(repository)).otherwise(F.col("root")))
    )
    package_key = keys.package_key(language, F.lit(repository), F.col("root"))
    symbol_key = lambda name: F.concat_ws(":", F.lit("symbol"), F.lit(repository), name)
    file_key = keys.file_key(F.lit(repository), F.col("path"))
    each = source_code.python_symbols(files)
    symbols = each.groupBy("qualified_name").agg(F.min(F.struct("path", "start_line", "end_line", "name", "kind", "exported")).alias("s")).select("qualified_name", "s.*")
    edges, unresolved = source_code.python_edges(symbols, source_code.python_references(files), source_code.python_aliases(files))
    place = F.concat_ws(":", F.lit("unresolved"), F.lit(repository), "path", "source", "kind", "requested_symbol", "line")
    broken = source_code.python_unresolved(files).select(
        F.concat_ws(":", F.lit("unresolved"), F.lit(repository), "path").alias("stable_key"), repo.alias("repository_key"), file_key.alias("file_key"), language.alias("language"),
        F.lit(repository).alias("requested_package"), text(None).alias("requested_symbol"), F.lit("SYNTAX_ERROR").alias("reason"), F.col("reason").alias("detail"), F.lit(0).cast("long").alias("start_line"),
    )
    return Graph(
        repositories=spark.range(1).select(repo.alias("stable_key"), F.lit(repository).alias("name"), language.alias("language"), F.lit(False).alias("dirty"), text(commit).alias("commit")),
        packages=packages.select(package_key.alias("stable_key"), repo.alias("repository_key"), language.alias("language"), "name", "version", F.col("root").alias("root_path")),
        files=files.join(own, "path").select(file_key.alias("stable_key"), repo.alias("repository_key"), package_key.alias("package_key"), "path", language.alias("language"), F.sha2("text", 256).alias("content_hash")),
        symbols=symbols.select(
            symbol_key(F.col("qualified_name")).alias("stable_key"), file_key.alias("file_key"), "name", "qualified_name", "kind", "exported", "start_line", "end_line", language.alias("language"),
        ),
        edges=edges.select(symbol_key(F.col("source_key")).alias("source_key"), symbol_key(F.col("target_key")).alias("target_key"), "kind", "confidence", "provenance", text(None).alias("evidence_key")),
        unresolved=unresolved.select(
            place.alias("stable_key"), repo.alias("repository_key"), file_key.alias("file_key"), language.alias("language"), F.substring_index("requested_symbol", ".", 1).alias("requested_package"),
            "requested_symbol", "reason", text(None).alias("detail"), F.col("line").alias("start_line"),
        ).dropDuplicates(["stable_key"]).union(broken),
        evidence=spark.createDataFrame([], EVIDENCE),
    )


def beside(old: Graph, new: Graph, repository: str) -> Graph:
    """The graph of all other repositories of ``old`` with ``new``, which is all that is known of its own.

    Relations from elsewhere to a symbol or package of the repository stay if it is still there.
    """
    repo = f"repository:{repository}"
    mine = lambda t: F.col("repository_key").eqNullSafe(repo) if "repository_key" in t.columns else F.lit(False)
    others = lambda t: t.filter(~mine(t))
    files = others(old.files)
    gone_files = old.files.filter(mine(old.files)).select(F.col("stable_key").alias("file_key"))
    symbols = old.symbols.join(gone_files, "file_key", "left_anti")
    gone = old.symbols.join(gone_files, "file_key", "left_semi").select("stable_key").union(old.packages.filter(mine(old.packages)).select("stable_key"))
    there = new.symbols.select("stable_key").union(new.packages.select("stable_key"))
    lost = gone.join(there, "stable_key", "left_anti")
    edges = old.edges.join(gone.withColumnRenamed("stable_key", "source_key"), "source_key", "left_anti").join(lost.withColumnRenamed("stable_key", "target_key"), "target_key", "left_anti")
    both = lambda a, b: a.select(*a.columns).unionByName(b, allowMissingColumns=True)
    evidence = new.evidence if old.evidence is None else both(others(old.evidence), new.evidence) if new.evidence is not None else others(old.evidence)
    return Graph(
        repositories=both(old.repositories.filter(F.col("stable_key") != repo), new.repositories), packages=both(others(old.packages), new.packages), files=both(files, new.files),
        symbols=both(symbols, new.symbols), edges=both(edges, new.edges), unresolved=both(others(old.unresolved), new.unresolved), evidence=evidence,
    )


def index_project(store: Generations, files: DataFrame, repository: str, commit: str | None = None) -> int | None:
    """Index the files and publish the graph, beside the other repositories of the published one, as a new generation; None if
    that holds the same files already.

    Whoever calls it has the consent to do so: there is no question to a user here.
    """
    graph = python_graph(files, repository, commit)
    if store.current() is None:
        return store.publish(graph)
    before = store.load()
    state = ("stable_key", "content_hash")
    known = before.files if "content_hash" in before.files.columns else before.files.withColumn("content_hash", F.lit(None).cast("string"))
    old, new = known.filter(F.col("repository_key") == f"repository:{repository}").select(*state), graph.files.select(*state)
    if old.exceptAll(new).isEmpty() and new.exceptAll(old).isEmpty():
        return None
    return store.publish(beside(before, graph, repository))
