"""Far ends without edges of their own lead nowhere: no work is counted for them, and no level is made of them."""

from pyspark.sql import functions as F

from factlake.operators import traverse
from factlake.operators.adjacency import hops

EDGE = "source_key string, target_key string, kind string, confidence string, provenance string, evidence_key string"


def chain(spark):
    rows = [("a", "b"), ("a", "x"), ("b", "c"), ("b", "y")]
    return spark.createDataFrame([(*r, "CALLS_DIRECT", "EXACT_TYPECHECKED", "GO_TYPES", None) for r in rows], EDGE)


def test_a_far_end_without_edges_leads_nowhere(spark):
    lists = {r.near: (r.fars, r.leads, r.work) for r in hops(chain(spark), "outgoing", 25_000).collect()}
    assert lists == {"a": (["b", "x"], ["b"], 2), "b": (["c", "y"], None, 0)}


def test_no_root_goes_row_by_row_for_what_its_ends_do_not_have(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(traverse, "GATHERED", 100)
    rows = traverse._by_rows
    monkeypatch.setattr(traverse, "_by_rows", lambda *a: asked.append(1) or rows(*a))
    got = traverse.traverse(chain(spark), spark.createDataFrame([("a", "a")], "root string, id string"), "outgoing", 5, 25_000).orderBy("pos")
    assert [(r.id, r.depth) for r in got.collect()] == [("a", 0), ("b", 1), ("x", 1), ("c", 2), ("y", 2)] and not asked


def test_paths_to_targets_deal_out_no_visits(spark):
    sources = spark.createDataFrame([("a",), ("b",), ("y",)], "source string")
    targets = spark.createDataFrame([("y",), ("y",), ("c",), ("a",), (None,)], "target string")
    found = traverse.shortest_paths(chain(spark), sources, targets=targets)
    assert {(r.source, r.target): (r.length, r.path) for r in found.collect()} == {
        ("a", "a"): (0, ["a"]), ("a", "c"): (2, ["a", "b", "c"]), ("a", "y"): (2, ["a", "b", "y"]), ("b", "c"): (1, ["b", "c"]), ("b", "y"): (1, ["b", "y"]), ("y", "y"): (0, ["y"]),
    }
    assert "LeftSemi" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_a_level_that_cannot_lead_on_is_not_written(spark):
    levels = traverse.walk(chain(spark), spark.createDataFrame([("a", "a")], "root string, id string"), "outgoing", 5, 100)
    assert len(levels) == 3 and "front" not in levels[-1].columns
    assert [[x.id for r in v.collect() for x in r.fresh] for v in levels] == [["a"], ["b", "x"], ["c", "y"]]


def test_lists_lie_in_buckets_of_their_near_ends(spark, monkeypatch):
    held, by = [], traverse._by_lists
    monkeypatch.setattr(traverse, "_by_lists", lambda state, lists, *a: held.append(lists) or by(state, lists, *a))
    traverse.walk(chain(spark), spark.createDataFrame([("a", "a")], "root string, id string"), "outgoing", 2, 100)
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = traverse.met(spark.range(9).select(F.col("id").cast("string").alias("near")), held[0])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert plan.count("Exchange hashpartitioning") == 1  # the frontier's


def test_a_neighborhood_joins_levels_as_they_lie(spark):
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = traverse.neighborhood(chain(spark), spark.createDataFrame([("a",), ("b",)], "root string"), 2, 100)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert sorted((r.root, r.pos, r.id) for r in got.collect()) == [("a", 1, "a"), ("a", 2, "b"), ("a", 3, "x"), ("a", 4, "c"), ("a", 5, "y"), ("b", 1, "b"), ("b", 2, "c"), ("b", 3, "y"), ("b", 4, "a")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert "Exchange" not in plan
