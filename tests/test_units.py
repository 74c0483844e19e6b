"""Orders and circles of units, kept facts in three modes, and compact pages, against plain Python."""

import json
import random

import pytest

from factlake.functions.paging import compact_pages
from factlake.operators import factsets


def closure(nodes, edges):
    reach = {n: {b for a, b in edges if a == n} for n in nodes}
    for _ in nodes:
        for n in nodes:
            reach[n] |= set().union(*(reach[m] for m in reach[n])) if reach[n] else set()
    return reach


@pytest.mark.parametrize("seed", range(2))
def test_orders_and_circles(spark, seed):
    rng = random.Random(seed)
    nodes = [f"u{i:02d}" for i in range(24)]
    edges = [(a, b) for a, b in ((rng.choice(nodes), rng.choice(nodes)) for _ in range(26)) if a > b or rng.random() < 0.25] + [("u03", "u03"), ("u07", "u03")]
    order, cycles = factsets.peeled(spark.createDataFrame([(n,) for n in nodes], "node string"), spark.createDataFrame([*edges, edges[0]], "node string, needed string"))
    reach = closure(nodes, edges)
    on = {n: min(m for m in reach[n] if n in reach[m]) for n in nodes if n in reach[n]}
    rows = cycles.collect()
    assert {r.node: r.cycle for r in rows} == on and len(rows) == len(on) and on
    free = {n for n in nodes if not (reach[n] | {n}) & set(on)}
    level = {r.node: r.level for r in order.collect()}
    assert set(level) == free and all(level[a] > level[b] for a, b in edges if a in free) and all(v == 0 or any(level[b] == v - 1 for a, b in edges if a == n) for n, v in level.items())


def test_what_isnt_there_is_named(spark):
    with pytest.raises(ValueError, match="a needs gone"):
        factsets.peeled(spark.createDataFrame([("a",)], "node string"), spark.createDataFrame([("a", "gone")], "node string, needed string"))
    order, cycles = factsets.peeled(spark.createDataFrame([("a",), ("b",)], "node string"), spark.createDataFrame([("a", "b")], "node string, needed string"))
    assert sorted(map(tuple, order.collect())) == [("a", 1), ("b", 0)] and cycles.collect() == []


def test_kept_facts(spark):
    units = spark.createDataFrame([(u,) for u in "abcd"], "unit string")
    stored = spark.createDataFrame([("a", 1), ("a", 2), ("b", 9), ("c", 5)], "unit string, fact int")
    recorded = spark.createDataFrame([("a", "x", "1"), ("b", "y", "1"), ("c", "z", "1")], "unit string, input string, fingerprint string")
    current = spark.createDataFrame([("a", "x", "1"), ("b", "y", "1"), ("c", "z", "2")], "unit string, input string, fingerprint string")
    truth = {"a": [2, 1], "b": [3], "c": [6], "d": [7]}
    asked = []

    def analyse(df):
        mine = sorted(r.unit for r in df.collect())
        asked.append(mine)
        return spark.createDataFrame([(u, f) for u in mine for f in truth[u]] or [], "unit string, fact int")

    for mode, analysed, facts, report in (
        ("on", "cd", {("a", 1), ("a", 2), ("b", 9), ("c", 6), ("d", 7)}, {"a": "hit", "b": "hit", "c": "miss", "d": "miss"}),
        ("verify", "abcd", {("a", 1), ("a", 2), ("b", 3), ("c", 6), ("d", 7)}, {"a": "verified", "b": "diverged", "c": "miss", "d": "miss"}),
        ("off", "abcd", {("a", 1), ("a", 2), ("b", 3), ("c", 6), ("d", 7)}, dict.fromkeys("abcd", "off")),
    ):
        asked.clear()
        got, said = factsets.with_cache(mode, units, stored, recorded, current, analyse)
        assert {tuple(r) for r in got.collect()} == facts and {r.unit: r.outcome for r in said.collect()} == report and asked[0] == list(analysed)
        if mode == "verify":
            with pytest.raises(factsets.Diverged, match="b"):
                factsets.sound(said)
        else:
            factsets.sound(said)
    with pytest.raises(ValueError):
        factsets.with_cache("perhaps", units, stored, recorded, current, analyse)


def test_compact_pages(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for page in range(30):
        mine = [(page, i, rng.choice(['a"b', "s\\t", "ü", "plain"]) + str(i), rng.choice(["call", "call", "call", "uses"][: rng.randrange(1, 5)]), "exact", rng.choice([None, "", "go"])) for i in range(rng.randrange(1, 40))]
        rows += mine
        columns = [[r[k] or "" for r in mine] for k in (3, 4, 5)]
        names = ["kind", "confidence", "origin"]
        header = {n: c[0] for n, c, raw in zip(names, columns, zip(*(r[3:] for r in mine))) if len(set(raw)) == 1 and c[0]}
        rest = [[c[i] if n not in header else "" for n, c in zip(names, columns)] for i in range(len(mine))]
        plain = [r[2] if not any(t) else [r[2], *filter(None, t)] for r, t in zip(mine, rest)]
        groups = {}
        for r, t in zip(mine, rest):
            groups.setdefault(tuple(t), []).append(r[2])
        grouped = [{**{n: v for n, v in zip(names, t) if v}, "rows": labels} for t, labels in groups.items()]
        dump = lambda x: json.dumps(x, ensure_ascii=False, separators=(",", ":"))
        form = len(dump(grouped).encode()) < len(dump(plain).encode())
        want[page] = (dump(header), "groups" if form else "rows", dump(grouped if form else plain))
    df = spark.createDataFrame(rows, "page int, at int, label string, kind string, confidence string, origin string")
    got = {r.page: (r.header, r.form, r.body) for r in compact_pages(df, "label", ["kind", "confidence", "origin"]).collect()}
    assert got == want and {f for _, f, _ in got.values()} == {"groups", "rows"}
