"""Edges are read once for what one pass can tell."""

from pyspark.sql import functions as F

from factlake.functions import paging
from factlake.operators import factsets, integrity, status
from factlake.schema import Graph
from factlake.sources import source_code
from factlake.sources.project import project



def test_a_report_finds_once(spark, sf):
    out = integrity.report(integrity.unknown_confidence(project(spark, sf)).union(spark.createDataFrame([("r", "k2"), ("r", "k1")], "rule string, key string")))
    assert [tuple(r) for r in out.collect()] == [("r", 2, ["k1", "k2"])]
    assert "l_orderkey" not in out._jdf.queryExecution().optimizedPlan().toString()  # what was found is read again, not found again


def test_derived_edges_are_counted_in_one_pass(spark):
    t = lambda rows, schema: spark.createDataFrame(rows, schema)
    edges = t([("a", "b"), ("x", "a"), ("a", "x"), ("x", "x"), ("b", "a")], "source_key string, target_key string").withColumn("kind", F.lit("CALLS_DIRECT"))
    g = Graph(
        t([("r1", "derived:d"), ("r2", "plain"), ("r3", "derived:none")], "stable_key string, name string"), t([("k", "r1")], "stable_key string, repository_key string"),
        t([("f1", "r1"), ("f2", "r2")], "stable_key string, repository_key string"), t([("a", "f1"), ("b", "f1"), ("x", "f2")], "stable_key string, file_key string"), edges,
        t([("u", "r1")], "stable_key string, repository_key string"),
    )
    out = status.derived_breakdown(g)
    assert {r.derived: (r.edges_within, r.edges_inbound, r.symbols) for r in out.collect()} == {"derived:d": (3, 1, 2), "derived:none": (0, 0, 0)}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("source_key") < 12


def test_pages_are_made_from_rows_dealt_out_once(spark):
    rows = spark.createDataFrame([("p", 2, 'b"', "k", None), ("p", 1, "a", "k", "x"), ("p", 3, "c", "k", "x"), ("o", 1, "d", "", "y")], "page string, at int, name string, kind string, more string")
    out = paging.compact_pages(rows, "name", ["kind", "more"])
    assert sorted(map(tuple, out.collect())) == [("o", '{"more":"y"}', "rows", '["d"]'), ("p", '{"kind":"k"}', "rows", r'[["a","x"],"b\"",["c","x"]]')]
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_names_are_counted_where_their_line_is(spark):
    files = spark.createDataFrame([("a", "x f(x) y\nx"), ("b", "x x"), ("b", "y x\nz"), ("c", None), ("d", "")], "path string, text string")
    out = source_code.syntax_inventory(files, ["CALL", "IDENTIFIER"])
    assert sorted((r.path, r.kind, r.name, r.line, r.n) for r in out.collect()) == [
        ("a", "CALL", "f", 1, 1), ("a", "IDENTIFIER", "f", 1, 1), ("a", "IDENTIFIER", "x", 1, 2), ("a", "IDENTIFIER", "x", 2, 1), ("a", "IDENTIFIER", "y", 1, 1),
        ("b", "IDENTIFIER", "x", 1, 3), ("b", "IDENTIFIER", "y", 1, 1), ("b", "IDENTIFIER", "z", 2, 1),
    ]
    one = files.filter("path <> 'b'")
    assert out.schema == source_code.syntax_inventory(one).schema
    top = source_code.syntax_inventory(one)._jdf.queryExecution().optimizedPlan().toString().splitlines()[0]
    assert top.startswith("Union")  # not an aggregation of all names


def test_a_snapshot_finds_the_ends_of_edges_once(spark, sf):
    g = project(spark, sf)
    for t in factsets.snapshot_tables(g)[:2]:
        plan = t._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "l_orderkey" not in plan
    left = {r.kind: r.n for r in factsets.snapshot_tables(Graph(g.repositories, g.packages, g.files, g.symbols.filter("kind <> 'struct'"), g.edges, g.unresolved))[2].collect()}
    assert left == {"dangling:REFERENCES": g.edges.filter("kind = 'REFERENCES'").count()}
