"""What one task reads or holds doesn't grow with the table."""

import re

from pyspark.sql import functions as F

from factlake.functions import parts
from factlake.operators import factsets, integrity
from factlake.plans.queries import OF_GRAPH
from factlake.sources.project import project
from factlake.sources.tables import scan


def test_no_fixed_number_of_parts(spark, sf):
    plan = OF_GRAPH["f13_content_digest"](project(spark, sf))._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [target_key" in plan and "], 3" not in plan


def test_precision_counts_both_sides_in_one_aggregation(spark):
    a = spark.createDataFrame([("x", None), ("x", None), ("y", "1")], "a string, b string")
    b = spark.createDataFrame([("x", None), ("z", "1")], "a string, b string")
    p = factsets.precision(a, b)
    assert tuple(p.first())[:4] == (3, 2, 2, 1) and "Join" not in p._jdf.queryExecution().optimizedPlan().toString()
    assert tuple(factsets.precision(a.limit(0), b.limit(0)).first()) == (0, 0, 0, 0, None, None)


def test_probes_sort_nothing(spark, sf):
    g = project(spark, sf)
    probes = integrity.golden_probes(g)
    assert "Sort" not in probes._jdf.queryExecution().optimizedPlan().toString()
    g.edges = g.edges.filter(F.lit(False))
    assert [r.probe for r in integrity.golden_probes(g).collect()] == ["symbol"]


def test_a_scan_deals_out_no_texts(spark, sf):
    out = scan(project(spark, sf))
    plan = out._jdf.queryExecution().analyzed().toString()
    assert plan.index("to_json") < plan.index("RepartitionByExpression") and "to_json" not in plan[plan.index("RepartitionByExpression") :]
    rows = [tuple(r) for r in out.collect()]
    assert rows == sorted(rows) and {r[0] for r in rows} == {"repositories", "packages", "files", "symbols", "edges", "unresolved"}
    assert {r["table"] for r in scan(project(spark, sf), with_edges=False).select("table").distinct().collect()} == {r[0] for r in rows} - {"edges"}


def test_parts_follow_the_files(spark, sf, tmp_path, monkeypatch):
    folder, own = f"{tmp_path}/a b%20c", int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.range(1000).repartition(2).write.parquet(folder)
    df = spark.read.parquet(folder)
    assert parts.parts(df) == own and parts.parts(spark.range(10)) == own
    size = sum(f.stat().st_size for f in (tmp_path / "a b%20c").glob("*.parquet"))
    monkeypatch.setattr(parts, "BYTES_OF_PART", 100)
    assert parts.parts(df) == parts.parts(df, df.union(df)) == -(-size // 100) > own


def _dealt(df):
    """The keys and numbers of parts that are asked for, and the whole plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return {(re.sub(r"#\d+", "", k), int(n)) for k, n in re.findall(r"hashpartitioning\(([^()]*), (\d+)\), REPARTITION_BY_NUM", plan)}, plan


def test_reference_files_are_dealt_out_by_size(spark, sf, monkeypatch):
    want = sorted(map(tuple, OF_GRAPH["q11_reference_files"](project(spark, sf)).collect()))
    monkeypatch.setattr(parts, "BYTES_OF_PART", 5_000)
    g = project(spark, sf)
    out = OF_GRAPH["q11_reference_files"](g)
    dealt, plan = _dealt(out)
    n = parts.parts(g.edges, g.symbols, g.files, g.packages, g.repositories)
    assert n > 4 and {("root", n), ("root, repository, path", n)} <= dealt
    assert not re.search(r"Sort \[other", plan) and sorted(map(tuple, out.collect())) == want


def test_consumers_are_dealt_out_by_size_and_pairs_arent_sorted(spark, sf, monkeypatch):
    want = sorted(map(str, OF_GRAPH["q17_cross_repository_consumers"](project(spark, sf)).collect()))
    monkeypatch.setattr(parts, "BYTES_OF_PART", 5_000)
    g = project(spark, sf)
    out = OF_GRAPH["q17_cross_repository_consumers"](g)
    dealt, plan = _dealt(out)
    n = parts.parts(g.edges, g.symbols, g.files, g.packages, g.repositories)
    assert n > 4 and {("root", n), ("source_key", n)} <= dealt
    assert plan.count("ShuffledHashJoin") == 2 and not re.search(r"Sort \[root#\d+ ASC NULLS FIRST, stable_key", plan)
    assert sorted(map(str, out.collect())) == want


def test_unresolved_facts_pair_as_in_sql(spark, sf):
    """Each row that names a target is one row, also if a fact is there twice, as edges are; a name in several forms is one."""
    g = project(spark, sf)
    named = lambda: OF_GRAPH["q17_cross_repository_consumers"](g).filter("category = 'unresolved'").groupBy("root", "unresolved_key").count()
    once = {tuple(r) for r in named().collect()}
    g.unresolved = g.unresolved.union(g.unresolved)
    assert once and {n for *_, n in once} == {1} and {tuple(r) for r in named().collect()} == {(a, b, 2) for a, b, _ in once}
