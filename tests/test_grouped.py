"""Lists go to groups of roots once, however many of the roots ask for them."""

import pyarrow as pa
from pyspark.sql import functions as F

from factlake.operators import grouped, traverse


def test_a_list_goes_to_a_group_once(spark):
    lists = spark.createDataFrame([("n1", ["a", "b"], ["a"], 3), ("n2", ["b", "c"], None, 0)], "near string, fars array<string>, leads array<string>, work bigint")
    state = spark.createDataFrame([(f"r{i}", ["n1", "n2"], ["x", "c"], 2, 4) for i in range(40)], "root string, front array<string>, seen array<string>, total bigint, work bigint")
    out = traverse._by_lists(state, lists, 10, (), False, False)
    assert {(r.total, tuple(x.id for x in r.fresh), r.more, tuple(r.front), r.work) for r in out.collect()} == {(2, ("a", "b"), False, ("a",), 3)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "collect_list" not in plan  # no root gathers lists of its own


def test_groups_are_neighbours_and_bounded(spark, monkeypatch):
    monkeypatch.setattr(grouped, "GROUP", 100)
    g = grouped.grouped(spark.range(300).select(F.format_string("r%03d", "id").alias("root"), (F.col("id") % 7 * 5).alias("work")))
    rows = sorted(map(tuple, g.collect()))
    assert len(rows) == 300 and [x for _, x in rows] == sorted(x for _, x in rows) and len({x for _, x in rows}) > 40
    assert max(sum(int(r[1:]) % 7 * 5 for r, x in rows if x == y) for y in {x for _, x in rows}) <= 140


def test_parts_of_a_group_give_what_the_group_gives(monkeypatch):
    roots = pa.table({"root": ["r", "s", "t"], "front": [["n", "m"], ["m"], ["k"]], "seen": [["n"], ["b", "m"], []], "total": [1, 2, 0]})
    lists = pa.table({"near": ["m", "n"], "fars": [["a", "b", "n"], ["b", "d"]], "leads": pa.array([["b"], None], pa.list_(pa.string())), "work": [4, 0]})
    level = grouped.next_level(3, ("parent",), 0, False)
    whole = level(roots, lists).to_pylist()
    monkeypatch.setattr(grouped, "PART", 1)
    assert level(roots, lists).to_pylist() == whole
    assert [(r["root"], [(x["id"], x["parent"]) for x in r["fresh"]], r["more"], r["front"], r["work"]) for r in whole] == [
        ("r", [("b", "n"), ("d", "n")], True, ["b"], 4), ("s", [("a", "m")], True, [], 4),
    ]
