"""References to and from symbols: one hop over the edges, many subjects at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlake.functions.parts import parts
from factlake.operators.search import keeps_derived, located
from factlake.schema import EXACT_CONFIDENCES, QUIET_KINDS, REFERENCE_KINDS, Graph


def allowed_kinds(kinds: list[str] | None) -> list[str]:
    """The kinds that are asked for; all but the quiet ones if none is; all if the one is ``*``."""
    if kinds == ["*"]:
        return list(REFERENCE_KINDS)
    if not kinds:
        return [k for k in REFERENCE_KINDS if k not in QUIET_KINDS]
    wrong = sorted(set(kinds) - set(REFERENCE_KINDS))
    if wrong:
        raise ValueError(f"unknown edge kinds: {', '.join(wrong)}")
    return list(kinds)


def find_references(
    graph: Graph, subjects: DataFrame, direction: str = "incoming", kinds: list[str] | None = None,
    confidences: list[str] | None = None, repository: str | None = None, language: str | None = None,
    include_derived: bool = True, bridge: bool = True,
) -> DataFrame:
    """(root, other, kind, confidence, provenance, evidence_key, via, location of the other end) for subjects (root).

    Incoming answers about the only implementation of something also hold the references to that (``via`` its name).
    """
    if direction not in ("incoming", "outgoing"):
        raise ValueError("direction must be incoming or outgoing")
    here, there = ("target_key", "source_key") if direction == "incoming" else ("source_key", "target_key")
    e = graph.edges.filter(F.col("kind").isin(*allowed_kinds(kinds)))
    if confidences:
        e = e.filter(F.col("confidence").isin(*confidences))
    places = located(graph).select(
        F.col("stable_key").alias("other"), "name", "qualified_name", F.col("kind").alias("symbol_kind"), "repository",
        "package_name", "path", "language", "start_line",
    )
    n = parts(e, places)
    # the edges follow, in as many parts; a few roots are sent everywhere as before
    roots = subjects.select("root").repartition(n, "root").distinct()
    found = roots.join(e, F.col("root") == F.col(here)).withColumn("via", F.lit(None).cast("string"))
    if direction == "incoming" and bridge:
        found = found.unionByName(_bridged(graph, roots, e))
    out = found.select("root", F.col(there).alias("other"), "kind", "confidence", "provenance", "evidence_key", "via")
    # a part's places are held and what refers passes by: nothing is sorted, and a hub's references are one task's only to read
    out = out.join(places.repartition(n, "other").hint("shuffle_hash"), "other").filter(keeps_derived(F.col("repository"), include_derived, repository))
    if repository:
        out = out.filter(F.col("repository") == repository)
    if language:
        out = out.filter(F.col("language") == language)
    return out


def _bridged(graph: Graph, roots: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges into what a root is the sole implementation of."""
    implements = graph.edges.filter(F.col("kind") == "IMPLEMENTS")
    sole = implements.groupBy("target_key").agg(F.count("*").alias("n"), F.min("source_key").alias("root")).filter("n = 1")
    names = graph.symbols.select(F.col("stable_key").alias("target_key"), F.col("qualified_name").alias("via"))
    mine = roots.join(sole.select("root", "target_key"), "root").join(names, "target_key")
    return mine.join(edges.filter(F.col("kind") != "IMPLEMENTS"), "target_key").select("root", *edges.columns, "via")


def reference_order() -> list[Column]:
    """The total order of references: direct ones first, then the other end's key, then the edge's own columns."""
    return [F.col("via").isNotNull(), F.col("via"), F.col("other"), F.col("kind"), F.col("confidence"), F.col("provenance"), F.col("evidence_key")]


def reference_files(references: DataFrame) -> DataFrame:
    """The files view: how many references each file holds.

    They are dealt out once by what is counted: hardly two in a part of the join are of one root and file.
    """
    by = ("root", "repository", "path")
    return references.select(*by).repartition(parts(references), *by).groupBy(*by).agg(F.count("*").alias("n"))


def coverage(rows: DataFrame, *by: str) -> DataFrame:
    """How many rows are exact, candidates, or unresolved: disjoint."""
    c = F.col("confidence")
    count = lambda test: F.coalesce(F.sum(F.when(test, 1).otherwise(0)), F.lit(0)).cast("long")
    return rows.groupBy(*by).agg(
        count(c.isin(*EXACT_CONFIDENCES)).alias("exact"), count(c == "CANDIDATE").alias("candidate"), count(c == "UNRESOLVED").alias("unresolved_related")
    )
