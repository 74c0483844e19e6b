"""Traversal against a queue, rule by rule; members, paths, bridges."""

from collections import deque

import pytest
from pyspark.sql import functions as F

from factlake.operators.traverse import induced, members, neighborhood, shortest_paths, traverse
from factlake.schema import CONFIDENCES, EDGE_KINDS, Graph

EDGES = [
    ("a", "b", "CALLS_DIRECT", "EXACT_TYPECHECKED"), ("a", "c", "CALLS_DIRECT", "CANDIDATE"), ("a", "b", "TYPE_USES", "EXACT_TYPECHECKED"),
    ("b", "d", "REFERENCES", "EXACT_TYPECHECKED"), ("c", "d", "CALLS_DIRECT", "EXACT_TYPECHECKED"), ("d", "a", "CALLS_DIRECT", "EXACT_TYPECHECKED"),
    ("d", "e", "CALLS_DIRECT", "EXACT_TYPECHECKED"), ("e", "e", "CALLS_DIRECT", "EXACT_TYPECHECKED"), ("c", "f", "EXPORTS", "CANDIDATE"), ("x", "y", "CALLS_DIRECT", "CANDIDATE"),
]


@pytest.fixture(scope="module")
def edges(spark):
    rows = [(*e, "GO_TYPES", None) for e in EDGES]
    return spark.createDataFrame(rows, "source_key string, target_key string, kind string, confidence string, provenance string, evidence_key string").cache()


def queue_walk(roots, incoming, depth, most, kinds=None):
    near, far = (1, 0) if incoming else (0, 1)
    adj = {}
    for e in EDGES:
        if kinds is None or e[2] in kinds:
            adj.setdefault(e[near], []).append((e[far], EDGE_KINDS.index(e[2]), CONFIDENCES.index(e[3]), e[2]))
    seen, out, cut = dict.fromkeys(sorted(roots), 0), [], False
    queue = deque((r, 0, None, None) for r in sorted(roots))
    while queue:
        node, d, parent, kind = queue.popleft()
        out.append((node, d, parent, kind))
        if d == depth:
            continue
        for to, _, _, k in sorted(adj.get(node, [])):
            if to in seen:
                continue
            if len(seen) >= most:
                cut = True
                continue
            seen[to] = d + 1
            queue.append((to, d + 1, node, k))
    return out, cut


@pytest.mark.parametrize("incoming", [False, True])
@pytest.mark.parametrize(("depth", "most"), [(0, 5), (1, 2), (2, 3), (3, 100), (5, 4)])
def test_order_parents_and_truncation(spark, edges, incoming, depth, most):
    seeds = spark.createDataFrame([("r1", "a"), ("r2", "d"), ("r2", "x")], "root string, id string")
    got = traverse(edges, seeds, "incoming" if incoming else "outgoing", depth, most).orderBy("root", "pos").collect()
    for root, starts in (("r1", ["a"]), ("r2", ["d", "x"])):
        want, cut = queue_walk(starts, incoming, depth, most)
        mine = [r for r in got if r.root == root]
        assert [(r.id, r.depth, r.parent, r.kind) for r in mine] == want
        assert {r.truncated for r in mine} == {cut}


def test_kinds_bound_the_walk(spark, edges):
    seeds = spark.createDataFrame([("a", "a")], "root string, id string")
    got = {r.id for r in traverse(edges, seeds, "outgoing", 5, 100, kinds=["CALLS_DIRECT"], confidences=["EXACT_TYPECHECKED"]).collect()}
    assert got == {"a", "b"}
    with pytest.raises(ValueError):
        traverse(edges, seeds, "sideways")
    with pytest.raises(ValueError):
        traverse(edges, seeds, "outgoing", 6)


def test_shortest_path(spark, edges):
    pairs = spark.createDataFrame([("a", "e"), ("a", "y"), ("d", "d")], "source string, target string")
    got = {(r.source, r.target): (r.length, r.path) for r in shortest_paths(edges, pairs).collect()}
    assert got == {("a", "e"): (3, ["a", "b", "d", "e"]), ("d", "d"): (0, ["d"])}


def test_neighborhood_and_induced(spark, edges):
    roots = spark.createDataFrame([("b",)], "root string")
    n = neighborhood(edges, roots, 1, 10)
    assert [r.id for r in n.orderBy("pos").collect()] == ["b", "d", "a"]
    assert {(r.source_key, r.target_key) for r in induced(edges, n).collect()} == {("a", "b"), ("b", "d"), ("d", "a")}


def test_members_are_the_outermost(spark, edges):
    s = spark.createDataFrame(
        [("class", "f", 1, 10), ("method", "f", 2, 6), ("param", "f", 3, 3), ("field", "f", 8, 8), ("other", "g", 2, 3), ("far", "h", 50, 60), ("line", "f", 20, 20)],
        "stable_key string, file_key string, start_line long, end_line long",
    )
    owned = edges.sparkSession.createDataFrame([("far", "class", "METHOD_OF", "EXACT_TYPECHECKED", "GO_TYPES", None), ("far", "line", "METHOD_OF", "EXACT_TYPECHECKED", "GO_TYPES", None)], edges.schema)
    g = Graph(s, s, s, s, owned, s)
    roots = spark.createDataFrame([("class",), ("line",)], "root string")
    got = {(r.root, r.id) for r in members(g, roots).collect()}
    assert got == {("class", "class"), ("class", "method"), ("class", "field"), ("class", "far"), ("line", "line"), ("line", "far")}


def test_empty_edges(spark, edges):
    seeds = spark.createDataFrame([("a", "a")], "root string, id string")
    got = traverse(edges.filter(F.lit(False)), seeds, "outgoing", 3, 10).collect()
    assert [(r.id, r.depth, r.truncated) for r in got] == [("a", 0, False)]
