"""Integrity rules: what a graph must hold to be published; each finding names its rule and the key that breaks it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlake.schema import CONFIDENCES, EXACT_CONFIDENCES, INEXACT_PROVENANCE, MAX_SAMPLES, PACKAGE_KINDS, REFERENCE_KINDS, Graph


def _rule(df: DataFrame, rule: str, key) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), key.alias("key"))


def _edge_key():
    return F.concat_ws("|", "source_key", "kind", "target_key")


def declared_ends(graph: Graph, side: str) -> DataFrame:
    """Exact edges whose source (or target) nothing declares."""
    exact = graph.edges.filter(F.col("confidence").isin(*EXACT_CONFIDENCES))
    key = f"{side}_key"
    symbols = graph.symbols.join(graph.files.select(F.col("stable_key").alias("file_key")), "file_key", "left_semi").select(F.col("stable_key").alias(key))
    packages = graph.packages.join(graph.repositories.select(F.col("stable_key").alias("repository_key")), "repository_key", "left_semi").select(F.col("stable_key").alias(key))
    of_symbols = exact.filter(F.col("kind").isin(*REFERENCE_KINDS)).join(symbols, key, "left_anti")
    of_packages = exact.filter(F.col("kind").isin(*PACKAGE_KINDS)).join(packages, key, "left_anti")
    return _rule(of_symbols.unionByName(of_packages), f"exact_edge_without_{side}", _edge_key())


def missing_evidence(graph: Graph) -> DataFrame:
    """Edges that name evidence which isn't there or whose file isn't."""
    used = graph.edges.filter("evidence_key is not null and evidence_key <> ''")
    if graph.evidence is None:
        there = used.select("evidence_key").limit(0)
    else:
        there = graph.evidence.join(graph.files.select(F.col("stable_key").alias("file_key")), "file_key", "left_semi").select(F.col("stable_key").alias("evidence_key"))
    return _rule(used.join(there, "evidence_key", "left_anti"), "missing_evidence_file", _edge_key())


def duplicate_keys(graph: Graph) -> DataFrame:
    """Keys that stand in two tables, or twice in one."""
    keys = None
    for name, table in graph.tables().items():
        if name != "edges":
            k = table.select("stable_key", F.lit(name).alias("table"))
            keys = k if keys is None else keys.union(k)
    return _rule(keys.groupBy("stable_key").agg(F.count("*").alias("n")).filter("n > 1"), "duplicate_stable_key", F.col("stable_key"))


def unknown_confidence(graph: Graph) -> DataFrame:
    """A confidence outside the vocabulary, or an exact one from a provenance that can't support it."""
    c = F.col("confidence")
    bad = ~c.isin(*CONFIDENCES) | c.isNull() | (c.isin(*EXACT_CONFIDENCES) & (F.col("provenance") == INEXACT_PROVENANCE))
    return _rule(graph.edges.filter(bad), "unknown_confidence", _edge_key())


def broken_ownership(graph: Graph) -> DataFrame:
    """Files whose repository isn't the one that their package is in, and symbols whose chain of owners is broken."""
    p = graph.packages.select(F.col("stable_key").alias("package_key"), F.col("repository_key").alias("through"))
    files = graph.files.join(p, "package_key", "left").filter(~F.col("repository_key").eqNullSafe(F.col("through")))
    f = graph.files.join(p, "package_key").select(F.col("stable_key").alias("file_key"))
    symbols = graph.symbols.join(f, "file_key", "left_anti")
    r = graph.repositories.select(F.col("stable_key").alias("repository_key"))
    packages = graph.packages.join(r, "repository_key", "left_anti")
    key, rule = F.col("stable_key"), "invalid_repository_ownership"
    return _rule(files, rule, key).union(_rule(symbols, rule, key)).union(_rule(packages, rule, key))


def audit(graph: Graph) -> DataFrame:
    """(rule, key) of all findings."""
    parts = [declared_ends(graph, "source"), declared_ends(graph, "target"), missing_evidence(graph), duplicate_keys(graph), unknown_confidence(graph), broken_ownership(graph)]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def report(findings: DataFrame) -> DataFrame:
    """(rule, n, samples): each rule's count and its first keys, up to 20."""
    # a bounded sample without gathering a rule's keys: the least ones of each, by rank
    from pyspark.sql import Window

    from factlake.operators.traverse import kept

    findings = kept(findings.select("rule", "key"))  # counted and ranked, but found once
    ranked = findings.withColumn("r", F.row_number().over(Window.partitionBy("rule").orderBy("key")))
    samples = ranked.filter(F.col("r") <= MAX_SAMPLES).groupBy("rule").agg(F.array_sort(F.collect_list("key")).alias("samples"))
    return findings.groupBy("rule").agg(F.count("*").alias("n")).join(samples, "rule")


def container_counts(graph: Graph) -> DataFrame:
    """(table, key, containers): nodes that don't have just one container."""
    def count(child: DataFrame, parent: DataFrame, column: str, name: str) -> DataFrame:
        n = child.select("stable_key", F.col(column).alias("p")).join(parent.select(F.col("stable_key").alias("p"), F.lit(1).alias("one")), "p", "left")
        return n.groupBy("stable_key").agg(F.count("one").alias("containers")).filter("containers <> 1").select(F.lit(name).alias("table"), F.col("stable_key").alias("key"), "containers")

    return (
        count(graph.packages, graph.repositories, "repository_key", "packages")
        .union(count(graph.files, graph.packages, "package_key", "files"))
        .union(count(graph.symbols, graph.files, "file_key", "symbols"))
    )


def golden_probes(graph: Graph) -> DataFrame:
    """(probe, key, n): the first symbol, the busiest (source, kind), the first edge; what a new generation must answer."""
    # the least and the most as aggregates of one row, so no task holds more
    one = F.lit(1).cast("long").alias("n")
    symbol = graph.symbols.agg(F.min("stable_key").alias("key")).filter("key is not null").select(F.lit("symbol").alias("probe"), "key", one)
    busiest = (
        graph.edges.groupBy("source_key", "kind").agg(F.count("*").alias("n"))
        .agg(F.min(F.struct((-F.col("n")).alias("less"), "source_key", "kind")).alias("e")).filter("e is not null")
        .select(F.lit("outgoing").alias("probe"), F.concat_ws("|", "e.source_key", "e.kind").alias("key"), (-F.col("e.less")).alias("n"))
    )
    edge = graph.edges.agg(F.min(F.struct("source_key", "target_key", "kind")).alias("e")).filter("e is not null").select(
        F.lit("edge").alias("probe"), F.concat_ws("|", "e.source_key", "e.kind", "e.target_key").alias("key"), one
    )
    return symbol.union(busiest).union(edge)
