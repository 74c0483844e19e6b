"""Status, repositories, unresolved references, and how complete an answer is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factlake.schema import DERIVED_PREFIX, MAX_SAMPLES, Graph


def table_counts(graph: Graph) -> DataFrame:
    """(name, n): rows of each table, and edges of each kind."""
    out = None
    for name, table in graph.tables().items():
        if name == "edges":
            n = table.groupBy(F.concat(F.lit("edges:"), "kind").alias("name")).agg(F.count("*").alias("n"))
        else:
            n = table.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = n if out is None else out.union(n)
    return out


def unresolved_by_reason(graph: Graph) -> DataFrame:
    return graph.unresolved.groupBy("reason").agg(F.count("*").alias("n"))


def graph_status(graph: Graph, schema_version: int, schema_expected: int, heads: DataFrame | None = None) -> DataFrame:
    """(section, name, n): all of a graph's status in one table.

    Sections: ``rows`` and ``edges`` by kind, ``unresolved`` by reason, ``derived`` (repository:measure), ``freshness``
    (repositories that are current, moved or unknown; with ``heads`` (name, head) only), ``schema`` (version, expected, and
    outdated as 0 or 1).
    """
    counts = table_counts(graph)
    edge = F.col("name").startswith("edges:")
    out = counts.select(F.when(edge, "edges").otherwise("rows").alias("section"), F.replace("name", F.lit("edges:"), F.lit("")).alias("name"), "n")
    out = out.union(unresolved_by_reason(graph).select(F.lit("unresolved"), "reason", "n"))
    derived = derived_breakdown(graph)
    measures = [c for c in derived.columns if c != "derived"]
    each = F.explode(F.array(*(F.struct(F.concat_ws(":", "derived", F.lit(c)).alias("name"), F.col(c).alias("n")) for c in measures)))
    out = out.union(derived.select(each.alias("m")).select(F.lit("derived"), "m.name", "m.n"))
    if heads is not None:
        fresh = list_repositories(graph, heads).groupBy("freshness").agg(F.count("*").alias("n"))
        out = out.union(fresh.select(F.lit("freshness"), "freshness", "n"))
    said = (("version", schema_version), ("expected", schema_expected), ("outdated", int(schema_version < schema_expected)))
    schema = F.explode(F.array(*(F.struct(F.lit(k).alias("name"), F.lit(v).cast("long").alias("n")) for k, v in said)))
    return out.union(out.sparkSession.range(1).select(schema.alias("m")).select(F.lit("schema"), "m.name", "m.n"))


def unresolved_by_repository(graph: Graph) -> DataFrame:
    return graph.unresolved.groupBy("repository_key").agg(F.count("*").alias("n"))


def derived_breakdown(graph: Graph) -> DataFrame:
    """(derived, packages, files, symbols, edges_within, edges_inbound, unresolved) of each derived repository."""
    d = graph.repositories.filter(F.col("name").startswith(DERIVED_PREFIX)).select(F.col("stable_key").alias("repository_key"), F.col("name").alias("derived"))
    of_file = graph.files.select(F.col("stable_key").alias("file_key"), "repository_key")
    owner = graph.symbols.select("stable_key", "file_key").join(of_file, "file_key").join(d, "repository_key").select("stable_key", "derived")
    source, target = owner.toDF("source_key", "from_derived"), owner.toDF("target_key", "to_derived")
    e = graph.edges.select("source_key", "target_key").join(source, "source_key", "left").join(target, "target_key", "left")
    # edges are read once, and counted by the owners of both ends before they are told apart
    n = e.groupBy("from_derived", "to_derived").agg(F.count("*").alias("n")).withColumn("derived", F.coalesce("from_derived", "to_derived")).filter("derived is not null")
    inside = F.col("from_derived").isNotNull()
    edges = n.groupBy("derived").agg(F.sum(F.when(inside, F.col("n"))).alias("edges_within"), F.sum(F.when(~inside, F.col("n"))).alias("edges_inbound"))
    count = lambda t, n: t.join(d, "repository_key").groupBy("derived").agg(F.count("*").alias(n))
    out = d.select("derived")
    symbols = owner.groupBy("derived").agg(F.count("*").alias("symbols"))
    for part in (count(graph.packages, "packages"), count(graph.files, "files"), symbols, edges, count(graph.unresolved, "unresolved")):
        out = out.join(part, "derived", "left")
    return out.select("derived", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("packages", "files", "symbols", "edges_within", "edges_inbound", "unresolved")))


def list_repositories(graph: Graph, heads: DataFrame | None = None) -> DataFrame:
    """Repositories with their package counts; with ``heads`` (name, head) also whether the index is behind."""
    n = graph.packages.groupBy("repository_key").agg(F.count("*").alias("packages"))
    out = graph.repositories.join(n.withColumnRenamed("repository_key", "stable_key"), "stable_key", "left").withColumn(
        "packages", F.coalesce("packages", F.lit(0))
    )
    if heads is None:
        return out
    fresh = F.when(F.col("head").isNull(), "unknown").when(F.col("head") == F.col("commit"), "current").otherwise("moved")
    return out.join(heads, "name", "left").withColumn("freshness", fresh)


def unresolved_references(
    graph: Graph, repository_key: str | None = None, package_key: str | None = None, requested_package: str | None = None,
    requested_symbol: str | None = None, reason: str | None = None, language: str | None = None,
) -> DataFrame:
    """Unresolved references by equality on any of the columns; the repository is a key here and not a name."""
    out = graph.unresolved
    for column, value in (
        ("repository_key", repository_key), ("requested_package", requested_package), ("requested_symbol", requested_symbol),
        ("reason", reason), ("language", language),
    ):
        if value is not None:
            out = out.filter(F.col(column) == value)
    if package_key is not None:
        files = graph.files.filter(F.col("package_key") == package_key).select(F.col("stable_key").alias("file_key"))
        out = out.join(files, "file_key", "left_semi")
    return out


def requested_name(requested: Column, name: Column) -> Column:
    """The name itself, or one that ends in ``.name``; a longer name that ends alike isn't it."""
    return F.coalesce((requested == name) | F.endswith(requested, F.concat(F.lit("."), name)), F.lit(False))


def quote_word(name: Column) -> Column:
    """A name as a regular expression for itself."""
    return F.regexp_replace(name, r"([\\.+*?()|\[\]{}^$])", r"\\$1")


def scope_directory(detail: Column) -> Column:
    """What stands behind the last " in ", the only place where a failure names its scope."""
    return F.when(F.contains(detail, F.lit(" in ")), F.trim(F.substring_index(detail, " in ", -1)))


#: What is told of a place that couldn't be followed.
_SPOT = ("reason", "repository", "path", "start_line", "requested_symbol", "requested_package", "detail")


def _bounded(rows: DataFrame, key: str, count: str, spots: str) -> DataFrame:
    """(key, count, spots) of rows (key, stable_key, spot columns): exact counts, and the first places by key.

    The rank is bounded by a constant, so each task keeps no more rows of a key than that before they are dealt out.
    """
    first = Window.partitionBy(key).orderBy("stable_key")
    some = rows.withColumn("k", F.row_number().over(first)).filter(F.col("k") <= MAX_SAMPLES).groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("k", F.struct(*_SPOT).alias("spot")))), lambda x: x["spot"]).alias(spots)
    )
    return rows.groupBy(key).agg(F.count("*").alias(count)).join(some, key)


def completeness(graph: Graph, subjects: DataFrame) -> DataFrame:
    """(root, verdict, naming, scopes, blind_spots, more_blind_spots, invisible_scopes, more_invisible_scopes, pattern, paths) for
    subjects (root, name, repository_key).

    COMPLETE if no unresolved reference with a file names the symbol and its repository has no failure without a file; else
    LOWER_BOUND, with up to ``MAX_SAMPLES`` places of either kind and how many more there are, and one search that covers
    what couldn't be followed: a pattern, and the files and directories of the places.
    """
    u = graph.unresolved
    known = graph.repositories.select(F.col("stable_key").alias("repository_key"), F.col("name").alias("repository"))
    files = graph.files.select(F.col("stable_key").alias("file_key"), "path")
    spots = u.join(known, "repository_key", "left").join(files, "file_key", "left").select("stable_key", "file_key", "repository_key", *_SPOT)
    tail = lambda c: F.substring_index(c, ".", -1).alias("tail")
    mine = subjects.select("root", "name", tail("name"))
    naming = spots.filter("file_key is not null and requested_symbol is not null").select("*", tail("requested_symbol")).join(mine, "tail").filter(
        requested_name(F.col("requested_symbol"), F.col("name"))
    )
    # a repository's failures are looked at once, however many subjects it has
    of_name = _bounded(naming, "root", "naming", "blind_spots")
    of_scope = _bounded(spots.filter("file_key is null"), "repository_key", "scopes", "invisible_scopes")
    n, s = F.coalesce("naming", F.lit(0)), F.coalesce("scopes", F.lit(0))
    more = lambda total, held: total - F.coalesce(F.size(held), F.lit(0))
    whole = (n == 0) & (s == 0)
    none = F.array().cast("array<string>")
    there = lambda c: F.filter(c, lambda x: F.coalesce(x != "", F.lit(False)))
    paths = F.array_union(
        there(F.coalesce(F.transform("blind_spots", lambda x: x["path"]), none)), there(F.coalesce(F.transform("invisible_scopes", lambda x: scope_directory(x["detail"])), none))
    )
    return subjects.join(of_name, "root", "left").join(of_scope, "repository_key", "left").select(
        "root", F.when(whole, "COMPLETE").otherwise("LOWER_BOUND").alias("verdict"), n.alias("naming"), s.alias("scopes"),
        "blind_spots", more(n, "blind_spots").alias("more_blind_spots"), "invisible_scopes", more(s, "invisible_scopes").alias("more_invisible_scopes"),
        F.when(~whole, F.concat(F.lit(r"\b"), quote_word(F.col("name")), F.lit(r"\b"))).alias("pattern"), F.when(~whole, F.array_sort(paths)).alias("paths"),
    )
