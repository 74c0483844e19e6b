"""Walks by lists: a row a root and level, the same whether lists are gathered or taken row by row."""

import random

import pytest
from pyspark.sql import functions as F

from factlake.operators import traverse

EDGE = "source_key string, target_key string, kind string, confidence string, provenance string, evidence_key string"


@pytest.fixture(scope="module")
def edges(spark):
    rng = random.Random(3)
    kinds = ["CALLS_DIRECT", "REFERENCES", "TYPE_USES"]
    rows = [(f"n{rng.randrange(30)}", f"n{rng.randrange(40)}", rng.choice(kinds), rng.choice(["EXACT_TYPECHECKED", "CANDIDATE"]), "GO_TYPES", None) for _ in range(120)]
    return spark.createDataFrame(rows, EDGE).cache()


def seeds(spark):
    return spark.createDataFrame([("a", "n1"), ("a", "n2"), ("b", "n3")], "root string, id string")


def test_a_level_is_one_row_a_root(spark, edges):
    levels = traverse.walk(edges, seeds(spark), "outgoing", 3, 100)
    assert [[r.depth for r in v.collect()] for v in levels] == [[0, 0], [1, 1], [2, 2], [3, 3]]
    got = {(v.root, x.id) for level in levels for v in level.collect() for x in v.fresh}
    assert got == {(r.root, r.id) for r in traverse.traverse(edges, seeds(spark), "outgoing", 3, 100).collect()}


@pytest.mark.parametrize("most", [100, 9])
def test_rows_give_what_lists_give(spark, edges, monkeypatch, most):
    notes = spark.createDataFrame([(f"n{i}", i) for i in range(0, 40, 3)], "id string, note int")
    for told in ((), ("parent", "kind", "confidence")):
        walk = lambda: sorted(map(tuple, traverse.traverse(edges, seeds(spark), "outgoing", 3, most, told=told, notes=notes).collect()))  # noqa: B023, E731
        lists = walk()
        monkeypatch.setattr(traverse, "GATHERED", 0)
        assert walk() == lists and len(lists) > 12
        monkeypatch.undo()
    plain = traverse.traverse(edges, seeds(spark), "outgoing", 3, most).collect()
    assert {(r[0], r[1]) for r in lists} == {(r.root, r.id) for r in plain}


def test_a_report_meets_places_and_not_all_symbols(spark, sf):
    from factlake.sources.project import project

    g = project(spark, sf)
    roots = g.symbols.filter("kind = 'interface'").select(F.col("stable_key").alias("root"))
    rows, _ = traverse.blast_radius(g, roots, 2, told=())
    lean = rows.select("root", "id", "depth", "repository", "package_key")._jdf.queryExecution().optimizedPlan().toString()
    assert "orders.parquet" not in lean and "LeftOuter" not in lean
    named = {(r.id, r.name, r.repository) for r in rows.select("id", "name", "repository").distinct().collect()}
    places = {r.stable_key: r.name for r in g.symbols.collect()}
    assert len(named) > 50 and all(places[i] == n for i, n, _ in named)


def test_axes_count_equal_rows_once(spark):
    rows = spark.createDataFrame([("r", "a", "p", 1), ("r", "a", "p", 1), ("r", "a", "q", 2)], "root string, repository string, package_key string, depth int")
    axes = traverse.impact_axes(rows)
    assert {(x.axis, x.key, x.n) for x in axes.collect()} == {("repository", "a", 3), ("package", "p", 2), ("package", "q", 1), ("depth", "1", 2), ("depth", "2", 1)}
    plan = axes._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan.split("Generate")[1]  # rows are counted before they are made three


def test_induced_walk_is_induced(spark, edges):
    from factlake.schema import Graph

    g = Graph(edges, edges, edges, edges, edges.union(edges.limit(7)), edges)
    n = traverse.traverse(g.edges, seeds(spark), "outgoing", 2, 12).select("root", "id")
    want = sorted(map(tuple, traverse.induced(g.edges, n).select("root", "source_key", "target_key", "kind").collect()))
    assert sorted(map(tuple, traverse.induced_walk(g, seeds(spark), "outgoing", 2, 12).collect())) == want and len(want) > 10
    both = {(r.root, r.id) for r in traverse.neighborhood(g.edges, n.select("root").distinct(), 1, 5).collect()}
    assert len(both) <= 10


def test_impact_by_kind_by_lists_and_by_rows(spark, sf, monkeypatch):
    from factlake.sources.project import project

    g = project(spark, sf)
    roots = g.symbols.filter("kind = 'interface'").select(F.col("stable_key").alias("root")).limit(5)
    by_lists = sorted(map(tuple, traverse.impact_by_kind(g, roots, 2, 25_000).collect()))
    monkeypatch.setattr(traverse, "GATHERED", -25_001)
    assert sorted(map(tuple, traverse.impact_by_kind(g, roots, 2, 25_000).collect())) == by_lists and len(by_lists) > 5
