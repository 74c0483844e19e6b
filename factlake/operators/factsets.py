"""Fact sets: merging, validating, closing edges between repositories, resolving providers, digests, precision."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlake.operators.traverse import cut
from factlake.operators.traverse import kept as written
from factlake.schema import CONFIDENCES, EDGE_KINDS, EXACT_CONFIDENCES, INEXACT_PROVENANCE, Graph

#: What makes two rows of a collection the same fact.
IDENTITY = {
    "repositories": ["stable_key"], "packages": ["stable_key"], "files": ["stable_key"], "symbols": ["stable_key"],
    "evidence": ["stable_key"], "edges": ["kind", "source_key", "target_key", "evidence_key"],
    "unresolved": ["repository_key", "file_key", "reason", "requested_package", "requested_symbol", "start_offset"],
}


def merge_first(rows: DataFrame, identity: list[str], order: list[str]) -> DataFrame:
    """One row of each identity, the first by ``order``; an aggregation, so duplicates meet before the shuffle."""
    rest = [c for c in rows.columns if c not in identity]
    first = F.min(F.struct(*order, *(c for c in rest if c not in order))).alias("first")
    return rows.groupBy(*identity).agg(first).select(*(F.col(c) if c in identity else F.col(f"first.{c}").alias(c) for c in rows.columns))


def union_languages(repositories: DataFrame) -> DataFrame:
    """(stable_key, languages): the distinct languages of all rows of a repository, sorted."""
    return repositories.groupBy("stable_key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("languages")))).alias("languages"))


def validate(graph: Graph) -> DataFrame:
    """(problem, key): what makes a set of facts unfit to be loaded."""
    e, key = graph.edges, F.concat_ws("|", "source_key", "kind", "target_key")
    keys = graph.symbols.select("stable_key").union(graph.packages.select("stable_key"))
    say = lambda df, problem, k: df.select(F.lit(problem).alias("problem"), k.alias("key"))
    stable = F.col("stable_key")
    miss = lambda child, column, parent: child.filter(F.col(column).isNotNull()).join(
        parent.select(F.col("stable_key").alias(column)), column, "left_anti"
    )
    twice = lambda t: t.groupBy("stable_key").agg(F.count("*").alias("n")).filter("n > 1")
    exact = F.col("confidence").isin(*EXACT_CONFIDENCES)
    parts = [
        say(miss(graph.packages, "repository_key", graph.repositories), "package_without_repository", stable),
        say(miss(graph.files, "package_key", graph.packages), "file_without_package", stable),
        say(miss(graph.symbols, "file_key", graph.files), "symbol_without_file", stable),
        say(miss(e, "source_key", keys), "edge_without_source", key),
        say(miss(e, "target_key", keys), "edge_without_target", key),
        say(e.filter(~F.col("kind").isin(*EDGE_KINDS) | F.col("kind").isNull()), "unknown_kind", key),
        say(e.filter(~F.col("confidence").isin(*CONFIDENCES) | F.col("confidence").isNull()), "unknown_confidence", key),
        say(e.filter(exact & (F.col("provenance") == INEXACT_PROVENANCE)), "exact_from_inexact", key),
        say(graph.unresolved.filter("reason is null or requested_package is null"), "unresolved_without_reason", stable),
        say(graph.symbols.filter("name is null or name = '' or kind is null"), "symbol_without_name", stable),
    ]
    parts += [say(twice(t), f"duplicate_{name}", stable) for name, t in graph.tables().items() if name not in ("edges",)]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def close_edges(edges: DataFrame, published: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges whose target is published, unresolved rows for the rest): (requested_symbol, sources) one for each target."""
    known = published.select(F.col("stable_key").alias("target_key"))
    kept = edges.join(known, "target_key", "left_semi").select(edges.columns)
    open_ = edges.join(known, "target_key", "left_anti")
    rows = open_.groupBy(F.col("target_key").alias("requested_symbol")).agg(
        F.count("*").alias("edges"), F.min("source_key").alias("first_source")
    ).withColumn("reason", F.lit("PROVIDER_DEFINITION_NOT_INDEXED"))
    return kept, rows


def normal_package(language: Column, requested: Column) -> Column:
    """A requested import as a package's name: the first part of a path or dotted name, scopes kept, case as it is."""
    scoped = requested.startswith("@")
    path = F.when(scoped, F.regexp_extract(requested, r"^(@[^/]+/[^/]+)", 1)).otherwise(F.substring_index(requested, "/", 1))
    dotted = F.regexp_replace(F.substring_index(requested, ".", 1), "-", "_")
    return F.when(language == "python", dotted).when(language.isin("typescript", "javascript"), path).otherwise(requested)


def provider_status(requests: DataFrame, providers: DataFrame) -> DataFrame:
    """(name, status, provider) for requested names: NOT_FOUND, AMBIGUOUS, VERSION_MISMATCH, REPLACE_CONFLICT or RESOLVED.

    ``requests`` (name, version, may be null), ``providers`` (name, provider, version, replacement).
    """
    p = providers.groupBy("name").agg(
        F.count("*").alias("n"), F.count_distinct("replacement").alias("replacements"), F.min("provider").alias("only"), F.min("version").alias("offered")
    )
    n = F.coalesce("n", F.lit(0))
    status = (
        F.when(F.coalesce("replacements", F.lit(0)) > 1, "REPLACE_CONFLICT").when(n == 0, "NOT_FOUND").when(n > 1, "AMBIGUOUS")
        .when(F.col("version") != F.col("offered"), "VERSION_MISMATCH").otherwise("RESOLVED")
    )
    out = requests.select("name", "version").distinct().join(p, "name", "left").withColumn("status", status)
    return out.select("name", "version", "status", F.when(F.col("status") == "RESOLVED", F.col("only")).alias("provider"))


def provider_conflicts(providers: DataFrame) -> DataFrame:
    """(name, providers, versions, conflict) of names that several provide, or in several versions."""
    c = providers.groupBy("name").agg(F.count_distinct("provider").alias("providers"), F.count_distinct("version").alias("versions"))
    return c.filter("providers > 1 or versions > 1").withColumn(
        "conflict", F.when(F.col("versions") > 1, "VERSION_MISMATCH").otherwise("AMBIGUOUS_PROVIDER")
    )


#: How a reference says that it comes from the standard library, and what stands for a version that isn't known.
LANG_ORIGIN, UNKNOWN_VERSION = "https://github.com/rust-lang/rust/library/", "."


def resolve_providers(requests: DataFrame, providers: DataFrame) -> DataFrame:
    """(name, version, status, provider) for requests (name, version): the version is part of the question.

    ``providers`` (name, provider, version, lang): ``lang`` are those of the standard library.  NOT_FOUND, VERSION_UNKNOWN
    (null, empty or "."), VERSION_MISMATCH, AMBIGUOUS or RESOLVED, which is just one with the version.  A version that
    begins with ``LANG_ORIGIN`` asks for the standard library's, ambiguous where anyone else has the name too.
    """
    trim = lambda c: F.coalesce(F.regexp_replace(c, r"^\s+|\s+$", ""), F.lit(""))
    p = providers.select(trim("name").alias("_name"), "provider", F.col("version").alias("_version"), F.coalesce("lang", F.lit(False)).alias("lang"))
    names = p.groupBy("_name").agg(F.count_if("lang").alias("_lang"), F.count_if(~F.col("lang")).alias("_others"), F.min(F.when(F.col("lang"), F.col("provider"))).alias("_core"))
    matching = p.filter(~F.col("lang")).groupBy("_name", "_version").agg(F.count("*").alias("_n"), F.min("provider").alias("_only"))
    asked = requests.select("name", "version").distinct().withColumn("_name", trim("name")).withColumn("_version", trim("version"))
    core, n = F.startswith("_version", F.lit(LANG_ORIGIN)), F.coalesce("_n", F.lit(0))
    status = (
        F.when(F.col("_lang").isNull() | core & (F.col("_lang") == 0), "NOT_FOUND")
        .when(core, F.when((F.col("_lang") > 1) | (F.col("_others") > 0), "AMBIGUOUS").otherwise("RESOLVED"))
        .when(F.col("_version").isin("", UNKNOWN_VERSION), "VERSION_UNKNOWN").when(n == 0, "VERSION_MISMATCH").when(n > 1, "AMBIGUOUS").otherwise("RESOLVED")
    )
    out = asked.join(names, "_name", "left").join(matching, ["_name", "_version"], "left").withColumn("status", status)
    return out.select("name", "version", "status", F.when(F.col("status") == "RESOLVED", F.when(core, F.col("_core")).otherwise(F.col("_only"))).alias("provider"))


def classify_conflicts(packages: DataFrame, modules: DataFrame) -> DataFrame:
    """(conflict, name, repositories, versions, manifests), a row for each kind of conflict, lists sorted.

    ``packages`` (name, repository, version, manifest): two entries of a name are ambiguous, whatever they hold, and besides
    in conflict if their versions differ.  ``modules`` (name, repository, manifest, replacements: array of (old_path,
    old_version, new_path, new_version, new_local)): ambiguous likewise, and besides in conflict if the sets of replacements
    differ; so is a path and version that modules of different names replace by different targets.
    """
    text = lambda c: F.coalesce(c, F.lit(""))
    seen = lambda c: F.array_sort(F.collect_set(text(c)))
    one = lambda df, conflict: df.select(F.lit(conflict).alias("conflict"), "name", "repositories", "versions", "manifests")
    p = packages.groupBy("name").agg(F.count("*").alias("n"), seen("repository").alias("repositories"), seen("version").alias("versions"), seen("manifest").alias("manifests")).filter("n > 1")
    parts = ("old_path", "old_version", "new_path", "new_version", "new_local")
    listed = F.transform(F.coalesce("replacements", F.array()), lambda x: F.struct(*(text(x[c]).alias(c) for c in parts)))
    m = modules.withColumn("replacements", F.array_sort(F.array_distinct(listed)))
    none = F.array().cast("array<string>").alias("versions")
    both = [seen("repository").alias("repositories"), seen("manifest").alias("manifests")]
    alike = m.groupBy("name").agg(F.count("*").alias("n"), F.count_distinct("replacements").alias("sets"), *both).filter("n > 1").withColumn("versions", none)
    source = ["old_path", "old_version"]
    across = m.select(F.col("name").alias("module"), "repository", "manifest", F.explode("replacements").alias("r")).select("module", "repository", "manifest", "r.*")
    across = across.groupBy(*source).agg(
        F.count_distinct("module").alias("modules"), F.count_distinct("new_path", "new_version", "new_local").alias("targets"), *both
    ).filter("modules > 1 and targets > 1").withColumn("versions", none).withColumn("name", F.col("old_path"))
    replaced = one(alike.filter("sets > 1"), "REPLACE_CONFLICT")
    # one row a path: the first version's
    first = across.groupBy("name").agg(F.min(F.struct("old_version", "repositories", "versions", "manifests")).alias("f")).select("name", "f.*")
    return (
        one(p, "AMBIGUOUS_PACKAGE").unionByName(one(p.filter("size(versions) > 1"), "VERSION_MISMATCH"))
        .unionByName(one(alike, "AMBIGUOUS_MODULE")).unionByName(replaced)
        .unionByName(one(first, "REPLACE_CONFLICT").join(replaced.select("name"), "name", "left_anti"))
    )


def infer_package_edges(unresolved: DataFrame, packages: DataFrame) -> DataFrame:
    """PACKAGE_DEPENDS_ON (source_key, target_key) where just one other package has the requested (language, name).

    ``unresolved`` (package_key, language, requested_package).
    """
    sole = packages.groupBy("language", F.col("name").alias("wanted")).agg(F.count("*").alias("n"), F.min("stable_key").alias("target_key")).filter("n = 1")
    asked = unresolved.withColumn("wanted", normal_package(F.col("language"), F.col("requested_package")))
    return asked.join(sole, ["language", "wanted"]).filter(F.col("target_key") != F.col("package_key")).select(
        F.col("package_key").alias("source_key"), "target_key"
    ).distinct()


def digest_sums(columns: list[str]) -> list[Column]:
    """The aggregates n, a and b that a digest of rows with these columns is made of."""
    told = [x for c in columns for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]
    total = lambda seed: F.coalesce(F.sum(F.xxhash64(F.lit(seed), *told).cast("decimal(20,0)")), F.lit(0)).cast("string")
    return [F.count(F.lit(1)).alias("n"), total("a").alias("a"), total("b").alias("b")]


def digest_text(n: int, a: str, b: str) -> str:
    """The digest that the aggregates make, as :func:`digest` says it."""
    return hashlib.sha256(f"{n}:{a}:{b}".encode()).hexdigest()


def digest(rows: DataFrame) -> DataFrame:
    """(n, digest): a digest of a table's content whatever its order: the sums of two 64-bit hashes, of different seeds, of
    each row.  Which values are null is hashed with them, so a value that moves to another column changes the digest."""
    return rows.agg(*digest_sums(rows.columns)).select("n", F.sha2(F.concat_ws(":", "n", "a", "b"), 256).alias("digest"))


def precision(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """(expected, observed, missing, unexpected, precision, recall) of two multisets of rows."""
    # one aggregation of both: how often each row stands on either side
    side = lambda df, n: df.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)), F.lit(n).alias("by"))
    both = side(expected, 1).union(side(observed, -1))
    each = both.groupBy(*both.columns[:-1]).agg(F.count_if(F.col("by") > 0).alias("e"), F.count_if(F.col("by") < 0).alias("o"))
    total = lambda c, n: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(n)
    none = F.lit(0)
    out = each.agg(
        total(F.col("e"), "expected"), total(F.col("o"), "observed"), total(F.greatest(F.col("e") - F.col("o"), none), "missing"), total(F.greatest(F.col("o") - F.col("e"), none), "unexpected")
    )
    share = lambda a, b: F.when(F.col(b) > 0, (F.col(b) - F.col(a)) / F.col(b))
    return out.withColumn("precision", share("unexpected", "observed")).withColumn("recall", share("missing", "expected"))


def snapshot_tables(graph: Graph) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(symbol edges, package edges, counts of what is left out): how a graph's relations go into a snapshot.

    Structural relations are left out and counted by kind; so are relations with an end that no symbol (or, between
    packages, no package) declares, as ``dangling:`` and the kind.  A symbol edge names the files of its ends.
    """
    from factlake.schema import PACKAGE_KINDS, STRUCTURAL_KINDS

    e = graph.edges
    structural = e.filter(F.col("kind").isin(*STRUCTURAL_KINDS)).groupBy("kind").agg(F.count("*").alias("n"))
    rest = e.filter(~F.col("kind").isin(*STRUCTURAL_KINDS))
    end = lambda t, side, *more: t.select(F.col("stable_key").alias(f"{side}_key"), F.lit(True).alias(f"{side}_there"), *more)
    file = lambda side: F.col("file_key").alias(f"{side}_file")
    both = lambda df, of: df.join(of("source"), "source_key", "left").join(of("target"), "target_key", "left")
    there = F.col("source_there").isNotNull() & F.col("target_there").isNotNull()
    # written once, as what is left out is counted of the same rows
    symbols = written(both(rest.filter(~F.col("kind").isin(*PACKAGE_KINDS)), lambda s: end(graph.symbols, s, file(s))))
    packages = written(both(rest.filter(F.col("kind").isin(*PACKAGE_KINDS)), lambda s: end(graph.packages, s)))
    loose = symbols.filter(~there).select("kind").union(packages.filter(~there).select("kind"))
    dangling = loose.groupBy(F.concat(F.lit("dangling:"), "kind").alias("kind")).agg(F.count("*").alias("n"))
    kept = lambda df, *more: df.filter(there).select(*e.columns, *more)
    return kept(symbols, "source_file", "target_file"), kept(packages), structural.union(dangling)


def peeled(nodes: DataFrame, needs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(order, cycles) of units (node) and what each needs (node, needed).

    ``order`` (node, level): a level's units need those of lower levels only, so by level and name each comes after what it needs.
    What never gets free of needs stands on a circle or behind one.  ``cycles`` (cycle, node) are the circles: units that need
    each other, or themselves, under the name of the least of them.  A level is one join, and so is a step along a circle.
    """
    need = cut(needs.select("node", "needed").distinct())
    unknown = need.join(nodes.select(F.col("node").alias("needed")), "needed", "left_anti").orderBy("node", "needed").first()
    if unknown is not None:
        raise ValueError(f"{unknown['node']} needs {unknown['needed']}, which isn't there")
    left, order, level = cut(nodes.select("node").distinct()), None, 0
    while True:
        waits = need.join(left.select(F.col("node").alias("needed")), "needed", "left_semi").select("node").distinct()
        free = cut(left.join(waits, "node", "left_anti").withColumn("level", F.lit(level)))
        order = free if order is None else order.union(free)
        if free.isEmpty():
            return order, circles(left, need)
        left, level = cut(left.join(free.select("node"), "node", "left_anti")), level + 1


def circles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(cycle, node): the strongly connected sets of more than one node, or of one with an edge to itself.

    Each node gets the least name that reaches it, forward; the set of that name is what reaches it, backward, within its own.
    Found sets go, and the rest gets names anew.
    """
    left = cut(nodes.select("node").distinct())
    e = cut(edges.toDF("a", "b").join(left.withColumnRenamed("node", "a"), "a", "left_semi").join(left.withColumnRenamed("node", "b"), "b", "left_semi").select("a", "b"))
    own = e.filter("a = b").select(F.col("a").alias("node"))
    out = None
    while not left.isEmpty():
        name = cut(left.withColumn("name", F.col("node")))
        while True:
            met = e.join(name.withColumnRenamed("node", "a"), "a").groupBy(F.col("b").alias("node")).agg(F.min("name").alias("met"))
            new = cut(name.join(met, "node", "left").select("node", F.least("name", "met").alias("name"), (F.col("met") < F.col("name")).alias("moved")))
            name = new.select("node", "name")
            if new.filter("moved").isEmpty():
                break
        inside = cut(name.filter("node = name"))
        back = e.join(name.toDF("a", "na"), "a").join(name.toDF("b", "nb"), "b").filter("na = nb").select("a", "b", F.col("na").alias("name"))
        step = inside
        while True:
            step = cut(back.join(step.withColumnRenamed("node", "b"), ["b", "name"]).select(F.col("a").alias("node"), "name").distinct().join(inside, ["node", "name"], "left_anti"))
            if step.isEmpty():
                break
            inside = inside.union(step)
        inside = cut(inside)
        big = inside.join(inside.groupBy("name").agg(F.count("*").alias("n")), "name")
        found = big.join(own.withColumn("own", F.lit(True)), "node", "left").filter("n > 1 or own").select(F.col("name").alias("cycle"), "node")
        out = found if out is None else out.union(found)
        left = cut(left.join(inside.select("node"), "node", "left_anti"))
        e = cut(e.join(left.withColumnRenamed("node", "a"), "a", "left_semi").join(left.withColumnRenamed("node", "b"), "b", "left_semi"))
    return out if out is not None else left.select(F.col("node").alias("cycle"), "node")


class Diverged(RuntimeError):
    """Facts that were kept aren't those that their inputs give."""


def with_cache(
    mode: str, units: DataFrame, stored: DataFrame, recorded: DataFrame, current: DataFrame, analyse: Callable[[DataFrame], DataFrame]
) -> tuple[DataFrame, DataFrame]:
    """(facts, report) of units (unit): facts (unit, ...) from what is stored or analysed anew; report (unit, outcome).

    An entry is valid while all its recorded inputs (unit, input, fingerprint) are as they are now (``current``, likewise); a unit
    without any is not.  ``analyse`` gives the facts of units (unit).  ``off`` analyses all; ``on`` takes valid entries (``hit``) and
    analyses the others (``miss``); ``verify`` analyses all and compares valid entries by a digest of each unit's facts:
    ``verified`` or ``diverged``; see :func:`sound`.
    """
    if mode not in ("off", "on", "verify"):
        raise ValueError(f"no mode: {mode}")
    mine = units.select("unit").distinct()
    if mode == "off":
        return analyse(mine), mine.withColumn("outcome", F.lit("off"))
    known = recorded.select("unit").distinct().join(stale_units(recorded, current), "unit", "left_anti").withColumn("valid", F.lit(True))
    judged = cut(mine.join(known, "unit", "left").select("unit", F.coalesce("valid", F.lit(False)).alias("valid")))
    valid, miss = judged.filter("valid").select("unit"), judged.filter("not valid").select("unit")
    missed = miss.withColumn("outcome", F.lit("miss"))
    kept = stored.join(valid, "unit", "left_semi")
    if mode == "on":
        new = analyse(miss)
        return kept.unionByName(new.select(*kept.columns)), valid.withColumn("outcome", F.lit("hit")).union(missed)
    facts = cut(analyse(mine))
    columns = sorted(stored.columns)
    of = lambda df, name: df.groupBy("unit").agg(*digest_sums(columns)).select("unit", F.concat_ws(":", "n", "a", "b").alias(name))
    both = valid.join(of(kept, "was"), "unit", "left").join(of(facts, "is"), "unit", "left")
    outcome = F.when(F.col("was").eqNullSafe(F.col("is")), "verified").otherwise("diverged")
    return facts, both.select("unit", outcome.alias("outcome")).union(missed)


def sound(report: DataFrame) -> DataFrame:
    """The report of :func:`with_cache`, or an error that names the first unit that diverged."""
    first = report.filter("outcome = 'diverged'").orderBy("unit").first()
    if first is not None:
        raise Diverged(first["unit"])
    return report


def stale_units(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """Units (unit) whose recorded input fingerprints (unit, input, fingerprint) aren't all still current."""
    now = current.select("unit", "input", F.col("fingerprint").alias("now"))
    both = recorded.join(now, ["unit", "input"], "full_outer")
    return both.filter(~F.col("fingerprint").eqNullSafe(F.col("now"))).select("unit").distinct()
