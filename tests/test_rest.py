"""Cursors, generations, selectors, events, changes, debouncing, facts, synthetic graphs."""

import json
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from factlake.functions import keys, paging
from factlake.operators import changes, events, factsets, integrity, outline, search
from factlake.sources import tables
from factlake.sources.project import project
from factlake.streaming.debounce import debounce


def test_cursor_is_bound():
    q = {"tool": "refs", "root": "p:1"}
    token = paging.encode_cursor(3, q, "v1", 40)
    assert paging.decode_cursor(token, 3, {"root": "p:1", "tool": "refs"}, "v1") == 40
    for args, why in (((4, q, "v1"), "EXPIRED"), ((3, {"tool": "x"}, "v1"), "MISMATCH"), ((3, q, "v2"), "MISMATCH")):
        with pytest.raises(paging.CursorError, match=why):
            paging.decode_cursor(token, *args)
    with pytest.raises(paging.CursorError, match="INVALID"):
        paging.decode_cursor(token[:-3] + "AAA", 3, q, "v1")


def test_selectors_never_guess(spark, sf):
    g = project(spark, sf)
    assert search.resolve(g, stable_key="c:7") == "c:7"
    with pytest.raises(search.SymbolNotFound):
        search.resolve(g, qualified_name="nothing")
    with pytest.raises(ValueError):
        search.resolve(g)
    twin = g.symbols.filter("stable_key = 'c:7'").withColumn("stable_key", F.lit("c:7b"))
    name = twin.first()["qualified_name"]
    g.symbols = g.symbols.union(twin)
    with pytest.raises(search.AmbiguousSymbol):
        search.resolve(g, qualified_name=name)


def test_generations(spark, sf, tmp_path):
    g = project(spark, sf)
    store = tables.Generations(spark, str(tmp_path / "store"))
    assert store.current() is None and store.follow(None) is None
    assert store.publish(g) == 1 and store.follow(None) == 1 and store.follow(1) is None
    assert store.load().symbols.count() == g.symbols.count() and store.verify()
    with pytest.raises(ValueError):
        store.publish(g, validate=lambda w: w.symbols.limit(1))
    assert store.current() == 1
    g.symbols = g.symbols.limit(10)
    with pytest.raises(ValueError, match="edge_without"):
        store.publish(g)
    assert store.publish(g, validate=None) == 2 and store.publish(g, validate=None) == 3
    assert store.rollback() == 2 and store.load().symbols.count() == 10
    assert 1 in store.prune()


def test_digest_ignores_order(spark):
    a = spark.createDataFrame([(i, str(i)) for i in range(50)], "x int, y string")
    assert factsets.digest(a).first() == factsets.digest(a.orderBy(F.desc("x"))).first()
    assert factsets.digest(a).first() != factsets.digest(a.filter("x > 0")).first()
    assert factsets.digest(a.limit(0)).first()["n"] == 0


def test_percentile_rank_rounds_half_up(spark):
    rows = [(float(i + 1), "t", "ok", i) for i in range(11)]
    e = spark.createDataFrame(rows, "duration_ms double, tool string, status string, ts int")
    got = events.summarize(e).first()
    assert (got["p95"], got["median"], got["calls"], got["success_rate"]) == (10.0, 6.0, 11, 1.0)


def test_renames_are_one_to_one(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "2"), ("d", "3")], "path string, hash string")
    new = spark.createDataFrame([("a2", "1"), ("b2", "2"), ("d", "4")], "path string, hash string")
    c = changes.reconcile(old, new)
    assert {r["path"]: r["status"] for r in c.collect()} == {"a": "removed", "b": "removed", "c": "removed", "d": "modified", "a2": "added", "b2": "added"}
    assert [tuple(r) for r in changes.renames(c).collect()] == [("1", "a", "a2")]
    p = spark.createDataFrame([("x/node_modules/y.ts",), ("src/a.go",), ("src/gen/b.go",)], "path string")
    assert [r[0] for r in p.select(changes.ignored(F.col("path"), ["node_modules", "src/gen/*.go"])).collect()] == [True, False, True]


def test_debounce_quiet_and_longest(spark):
    rows = [("r", "a", 1, t) for t in range(0, 1200, 100)] + [("r", "b", 2, 50), ("r", "a", 4, 60), ("s", "z", 1, 10), ("s", "z", 8, 400)]
    e = spark.createDataFrame(rows, "repository string, path string, operations int, ms long")
    got = sorted((r.repository, r.path, r.operations, r.opened, r.closed) for r in debounce(e).collect())
    assert got == [("r", "a", 1, 500, 1000), ("r", "a", 1, 1000, 1250), ("r", "a", 5, 0, 500), ("r", "b", 2, 0, 500), ("s", "z", 1, 10, 160), ("s", "z", 8, 400, 550)]


def test_debounce_stream(spark, tmp_path):
    from factlake.streaming.debounce import debounce_stream

    (tmp_path / "in").mkdir()
    pd.DataFrame({"repository": ["r", "r", "s"], "path": ["a", "a", "b"], "operations": [1, 4, 2]}).to_json(tmp_path / "in" / "1.json", orient="records", lines=True)
    stream = spark.readStream.schema("repository string, path string, operations int").json(str(tmp_path / "in"))
    q = debounce_stream(stream).writeStream.format("memory").queryName("batches").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        for _ in range(60):
            got = sorted((r.repository, r.path, r.operations) for r in spark.table("batches").collect())
            if len(got) == 2:
                break
            # timers keep the stream busy: it never counts as having processed all
            time.sleep(1)
    finally:
        q.stop()
    assert got == [("r", "a", 5), ("s", "b", 2)]


def test_fact_json(spark, tmp_path):
    (tmp_path / "f.json").write_text(json.dumps({"repositories": [{"stable_key": "repository:x", "name": "x", "languages": ["go"]}], "symbols": [], "edges": [{"source_key": "a", "target_key": "b", "kind": "CALLS_DIRECT"}]}))
    facts = tables.read_fact_json(spark, str(tmp_path / "f.json"))
    assert facts["repositories"].first()["languages"] == ["go"] and facts["edges"].count() == 1 and facts["symbols"].count() == 0


def test_merge_keeps_the_first(spark):
    rows = spark.createDataFrame([("k", 2, "late"), ("k", 1, "first"), ("j", 5, None)], "id string, at int, v string")
    got = {r["id"]: r["v"] for r in factsets.merge_first(rows, ["id"], ["at"]).collect()}
    assert got == {"k": "first", "j": None}


def test_reanchor_refuses_ties(spark):
    text = "x\nfunc Go() {\n// Go here\ny\nGo again"
    rows = [("near", "Go", 2, 2, text), ("tie", "Go", 3, 3, "Go\nq\nz\nq\nGo"), ("none", "Gone", 1, 1, text), ("end", "again", 1, 3, text)]
    got = {r["key"]: (r["line"], r["status"]) for r in outline.reanchor(spark.createDataFrame(rows, "key string, name string, start_line long, end_line long, text string")).collect()}
    assert got == {"near": (2, "FOUND"), "tie": (None, "AMBIGUOUS"), "none": (None, "NOT_FOUND"), "end": (None, "OUT_OF_RANGE")}


def test_paths():
    assert outline.normal_path("a/b/") == "a/b"
    for bad in ("/a", "a/../b", ""):
        with pytest.raises(ValueError):
            outline.normal_path(bad)


def test_keys(spark):
    df = spark.createDataFrame([("go", "x", "1.10.2", "1.9", "pkg.Name")], "a string, b string, v string, w string, q string")
    r = df.select(
        keys.symbol_key(F.col("a"), F.col("b")).alias("k"), keys.symbol_key(F.col("a"), F.lit("")).alias("none"),
        (keys.version_parts(F.col("v")) > keys.version_parts(F.col("w"))).alias("later"), keys.split_list(F.lit(" a, ,b")).alias("l"),
        keys.ends_qualified(F.col("q"), F.lit("Name")).alias("yes"), keys.ends_qualified(F.col("q"), F.lit("ame")).alias("no"),
    ).first()
    assert len(r["k"]) == 64 and r["none"] is None and r["later"] and r["l"] == ["a", "b"] and r["yes"] and not r["no"]


def test_synthetic(spark):
    s, e = tables.synthetic(spark, 1000, 5000)
    assert s.filter("isolated").count() == 10
    ends = e.select("source_key").union(e.select("target_key")).distinct()
    assert s.filter("isolated").join(ends, s["stable_key"] == ends["source_key"], "left_semi").isEmpty()


def test_audit_of_a_sound_graph(spark, sf):
    g = project(spark, sf)
    g.edges = g.edges.withColumn("evidence_key", F.lit(None).cast("string"))
    assert integrity.audit(g).isEmpty() and integrity.container_counts(g).isEmpty() and factsets.validate(g).isEmpty()


def test_entry_imports():
    import __spark_entry__

    assert len(__spark_entry__.queries()) >= 60 and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_every_part_is_a_provider(spark, sf):
    from collections import Counter

    from factlake.plans.queries import QUERIES

    parts = spark.read.parquet(f"{sf}/part.parquet").collect()
    n = Counter(f"{r.p_brand}/{r.p_type}/{r.p_size}" for r in parts)
    status = {r.name: r.status for r in QUERIES["f6_f7_provider_status"](spark, sf).collect()}
    assert {k for k, v in status.items() if v != "NOT_FOUND"} == set(n)
    assert {k for k, v in status.items() if v == "AMBIGUOUS"} == {k for k, v in n.items() if v > 1}
    assert {"NOT_FOUND", "AMBIGUOUS", "VERSION_MISMATCH", "RESOLVED"} == set(status.values())
    conflicts = {r.name: r.providers for r in QUERIES["f8_provider_conflicts"](spark, sf).collect()}
    assert conflicts == {k: v for k, v in n.items() if v > 1}


def test_every_urgent_order_stays_unresolved(spark, sf):
    from collections import Counter

    from factlake.plans.queries import QUERIES

    read = lambda t: spark.read.parquet(f"{sf}/{t}.parquet").collect()
    region, nation = {r.r_regionkey: r.r_name for r in read("region")}, {r.n_nationkey: r for r in read("nation")}
    customer = {r.c_custkey: r for r in read("customer")}
    urgent = [r for r in read("orders") if r.o_orderpriority == "1-URGENT" and r.o_custkey in customer]
    asked = {f"unresolved:order:{r.o_orderkey}": customer[r.o_custkey] for r in urgent}
    home = {k: region[nation[c.c_nationkey].n_regionkey] for k, c in asked.items()}
    same = {(k, f"c:{c.c_custkey}") for k, a in asked.items() for c in customer.values() if c.c_name == a.c_name and c.c_nationkey == a.c_nationkey}
    assert len(asked) > 100 and {tuple(r) for r in QUERIES["q19_unresolved_matches_target"](spark, sf).collect()} == same
    found = QUERIES["q17_cross_repository_consumers"](spark, sf).filter("category = 'unresolved'").select("unresolved_key", "root").collect()
    assert {tuple(r) for r in found} == same
    naming = Counter(c.c_name for c in asked.values())
    got = {r.root: (r.naming, r.verdict) for r in QUERIES["q27_completeness"](spark, sf).collect()}
    assert all(got[f"c:{c.c_custkey}"][0] == naming[c.c_name] for c in customer.values())
    assert all(v == "LOWER_BOUND" for n, v in got.values() if n)
    labelled = {r.doc_id for r in read("labels")}
    want = Counter(region[r.doc_id % 5] for r in read("documents") if r.doc_id not in labelled)
    want += Counter("EUROPE" if home[k] == "ASIA" else "ASIA" for k in asked)
    assert {r.repository_key.removeprefix("repository:"): r.n for r in QUERIES["q28_unresolved_by_repository"](spark, sf).collect()} == dict(want)
    own = {f"package:sql:{region[n.n_regionkey]}:{n.n_name}": (region[n.n_regionkey], n.n_name) for n in nation.values()}
    edges = {(p, q) for k, c in asked.items() for p, (r, _) in own.items() for q, (_, n) in own.items() if r == ("EUROPE" if home[k] == "ASIA" else "ASIA") and n == nation[c.c_nationkey].n_name and p != q}
    assert {tuple(r) for r in QUERIES["f5_infer_package_edges"](spark, sf).collect()} == edges


def test_provider_rules(spark):
    core = factsets.LANG_ORIGIN + "core"
    have = [("a", "r1", "1", False), ("a", "r2", "2", False), ("b", "r1", "1", False), ("b", "r2", "1", False), ("core", "std", "x", True), ("mix", "std", "1", True), ("mix", "r1", "1", False)]
    ask = [("a", "1"), ("a", "3"), ("a", None), ("a", "."), ("a", core), ("b", "1"), ("core", core), ("core", "x"), ("mix", core), ("mix", "1"), ("no", "1"), ("no", None), (" a ", " 2 ")]
    got = factsets.resolve_providers(spark.createDataFrame(ask, "name string, version string"), spark.createDataFrame(have, "name string, provider string, version string, lang boolean"))
    assert {(r.name, r.version): (r.status, r.provider) for r in got.collect()} == {
        ("a", "1"): ("RESOLVED", "r1"), ("a", "3"): ("VERSION_MISMATCH", None), ("a", None): ("VERSION_UNKNOWN", None), ("a", "."): ("VERSION_UNKNOWN", None),
        ("a", core): ("NOT_FOUND", None), ("b", "1"): ("AMBIGUOUS", None), ("core", core): ("RESOLVED", "std"), ("core", "x"): ("VERSION_MISMATCH", None),
        ("mix", core): ("AMBIGUOUS", None), ("mix", "1"): ("RESOLVED", "r1"), ("no", "1"): ("NOT_FOUND", None), ("no", None): ("NOT_FOUND", None), (" a ", " 2 "): ("RESOLVED", "r2"),
    }


def test_conflict_rules(spark):
    packages = [("same", "r1", "1", "m1"), ("same", "r1", "1", "m1"), ("two", "r2", "1", "m2"), ("two", "r1", "2", "m1"), ("sole", "r1", "1", "m1")]
    swap = lambda *x: (*x, "")
    modules = [
        ("equal", "r1", "m1", [swap("o", "", "n", "1"), swap("q", "", "n", "")]), ("equal", "r2", "m2", [swap("q", "", "n", ""), swap("o", "", "n", "1")]),
        ("differ", "r1", "m3", [swap("d", "", "n", "")]), ("differ", "r2", "m4", None), ("x", "r1", "m5", [swap("lib", "1", "n", "")]), ("y", "r2", "m6", [swap("lib", "1", "other", "")]),
        ("z", "r3", "m7", [swap("lib", "2", "n", "")]),
    ]
    item = "array<struct<old_path:string,old_version:string,new_path:string,new_version:string,new_local:string>>"
    got = factsets.classify_conflicts(
        spark.createDataFrame(packages, "name string, repository string, version string, manifest string"),
        spark.createDataFrame(modules, f"name string, repository string, manifest string, replacements {item}"),
    )
    assert sorted((r.conflict, r.name, ",".join(r.repositories), ",".join(r.versions), ",".join(r.manifests)) for r in got.collect()) == [
        ("AMBIGUOUS_MODULE", "differ", "r1,r2", "", "m3,m4"), ("AMBIGUOUS_MODULE", "equal", "r1,r2", "", "m1,m2"), ("AMBIGUOUS_PACKAGE", "same", "r1", "1", "m1"),
        ("AMBIGUOUS_PACKAGE", "two", "r1,r2", "1,2", "m1,m2"), ("REPLACE_CONFLICT", "differ", "r1,r2", "", "m3,m4"), ("REPLACE_CONFLICT", "lib", "r1,r2", "", "m5,m6"),
        ("VERSION_MISMATCH", "two", "r1,r2", "1,2", "m1,m2"),
    ]


def test_digest_is_computed(spark, sf):
    import hashlib

    from factlake.plans.queries import QUERIES

    edges = project(spark, sf).edges
    told = [x for c in edges.columns for x in (F.col(c).isNull(), F.col(c))]
    rows = edges.select(F.xxhash64(F.lit("a"), *told), F.xxhash64(F.lit("b"), *told)).collect()
    (got,) = QUERIES["f13_digest"](spark, sf).collect()
    assert (got.n, got.digest) == (len(rows), hashlib.sha256(f"{len(rows)}:{sum(r[0] for r in rows)}:{sum(r[1] for r in rows)}".encode()).hexdigest())
    assert factsets.digest(edges.orderBy(F.desc("source_key"))).first() == got
    pair = lambda *rows: factsets.digest(spark.createDataFrame(list(rows), "x string, y string")).first().digest
    assert len({pair((None, "a")), pair(("a", None)), pair(("a", "a")), pair((None, None)), pair((None, "a"), (None, "a"))}) == 5


def test_two_publishers_and_a_crash(spark, sf, tmp_path):
    g = project(spark, sf)
    store, other = (tables.Generations(spark, str(tmp_path / "store")) for _ in range(2))
    assert store.publish(g) == 1
    small = project(spark, sf)
    small.symbols = small.symbols.filter("false")
    small.edges = small.edges.filter("kind = 'PACKAGE_DEPENDS_ON'")

    def meanwhile(graph):  # the other publishes while the first validates
        assert other.publish(small) == 2 and store.load().symbols.count() == 0
        return graph.symbols.limit(0)

    assert store.publish(g, validate=meanwhile) == 3
    assert store.load(1).symbols.count() == store.load().symbols.count() == g.symbols.count() and store.load(2).symbols.count() == 0

    def crash(*_):
        raise RuntimeError

    point, other._point = other._point, crash
    with pytest.raises(RuntimeError):
        other.publish(small)
    assert store.current() == 3 and store.verify()
    other._point = point
    assert other.publish(small) == 4 and store.follow(3) == 4 and store.rollback() == 3
    assert store.load().symbols.count() == g.symbols.count() and other.publish(small) == 5
    broken = project(spark, sf)
    broken.symbols = broken.symbols.limit(3)  # edges point to symbols that are gone
    with pytest.raises(ValueError, match="edge_without"):
        store.publish(broken)
    assert store.current() == 5 and sorted(store.prune(abandoned_after=-1)) == [1, 2, 4] and store.load().symbols.count() == 0 and store.rollback() == 3
    left = [p.name for p in (tmp_path / "store").iterdir() if p.name.startswith("gen")]
    assert len(left) == 2


def test_graph_delta(spark):
    symbols = spark.createDataFrame([(k, k) for k in "abcd"], "stable_key string, name string")
    edge = "source_key string, target_key string, kind string"
    edges = spark.createDataFrame([("a", "b", "R"), ("a", "c", "R"), ("b", "c", "R"), ("c", "d", "R"), ("d", "a", "R")], edge)
    sym = lambda *k: spark.createDataFrame([(x, x * 2) for x in k], "stable_key string, name string")
    refs = lambda *e: spark.createDataFrame(list(e), edge)
    s, e = tables.apply_graph_delta(symbols, edges, sym("e"), sym("b"), sym("d"), refs(("b", "e", "R")), refs(("b", "c", "R")), refs(("a", "e", "X"), ("c", None, None)))
    assert {tuple(r) for r in s.collect()} == {("a", "a"), ("b", "bb"), ("c", "c"), ("e", "ee")}
    assert {tuple(r) for r in e.select("source_key", "target_key", "kind").collect()} == {("a", "e", "X"), ("b", "e", "R")}
    none = refs(("x", "y", "z")).limit(0)
    for args, why in (
        ((sym("a"), sym(), sym(), none, none, none), "added_symbol_exists"), ((sym(), sym("z"), sym(), none, none, none), "unknown_symbol"),
        ((sym(), sym("a"), sym("a"), none, none, none), "symbol_in_two_actions"), ((sym(), sym(), sym("a"), refs(("a", "b", "N")), none, none), "edge_without_source"),
        ((sym(), sym(), sym(), refs(("a", "d", "N")), none, refs(("a", "b", "M"))), "replaced_source_has_added_edges"),
    ):
        empty = symbols.limit(0)
        args = [a if a.columns[0] != "stable_key" or not a.isEmpty() else empty for a in args]
        assert why in {r.problem for r in tables.check_delta(symbols, *args).collect()}


def test_source_is_cut_between_characters(spark):
    text = "aé🎉" * 4
    for most in range(1, 30):
        got = spark.createDataFrame([(text,)], "t string").select(outline.first_bytes(F.col("t"), most)).first()[0]
        assert got == text.encode()[:most].decode("utf-8", "ignore")


def test_python_sources(spark):
    from factlake.sources import source_code

    text = "import os.path as p, sys\nfrom . import util\nfrom .util import Base as B\nX: int = 1\nX = 2\n\nclass C(B):\n    async def m(self):\n        p.join('a'); util.go(); self.x()\n\n        def inner(): return C()\n\ndef _f():\n    sys.exit(_f())\n"
    util = "class Base: pass\ndef go(): pass\n"
    rows = [("a/b.py", text), ("a/util.py", util), ("a/__init__.py", "from .b import C\n"), ("bad.py", "def ("), ("none.py", None), ("x.txt", "def f(): pass"), (None, "x = 1")]
    files = spark.createDataFrame(rows, "path string, text string")
    symbols = source_code.python_symbols(files)
    got = {r.qualified_name: (r.kind, r.exported, r.start_line) for r in symbols.filter("path = 'a/b.py'").collect()}
    assert got == {
        "a.b": ("module", True, 1), "a.b.X": ("variable", True, 4), "a.b.C": ("class", True, 7), "a.b.C.m": ("method", True, 8), "a.b.C.m.inner": ("function", True, 11), "a.b._f": ("function", False, 13),
    }
    edges, unresolved = source_code.python_edges(symbols, source_code.python_references(files))
    assert {(r.source_key, r.kind, r.target_key) for r in edges.collect()} == {
        ("a.b", "IMPORTS_SYMBOL", "a.util"), ("a.b", "IMPORTS_SYMBOL", "a.util.Base"), ("a.b.C", "EXTENDS", "a.util.Base"), ("a.b.C.m", "CALLS_DIRECT", "a.util.go"),
        ("a.b.C.m.inner", "CALLS_DIRECT", "a.b.C"), ("a", "IMPORTS_SYMBOL", "a.b.C"),
    }
    assert {r.requested_symbol for r in unresolved.collect()} == {"os.path", "sys", "os.path.join", "a.b.C.x", "sys.exit"}
    assert [r.path for r in source_code.python_unresolved(files).collect()] == ["bad.py"]


def test_manifests(spark):
    from factlake.sources import source_code

    rows = [
        ("w/go.mod", "module example.com/w\n\nrequire (\n\texample.com/a v1.2.0 // indirect\n)\nrequire example.com/b v0.1.0\n"), ("w/r/Cargo.toml", '[package]\nname = "r"\nversion = "0.3.0"\n[dependencies]\nserde = "1"\nlocal = { path = "../l" }\n'),
        ("w/p/pyproject.toml", '[project]\nname = "p"\ndependencies = ["numpy>=2", "x[y]"]\n'), ("w/e/package.json", "[]"), ("w/n/package.json", "{}"), ("w/r/src/main.rs", ""), ("top.txt", ""),
    ]
    files = spark.createDataFrame(rows, "path string, text string")
    got = {(r.path, r.name, r.version, r.dependency, r.wanted) for r in source_code.manifests(files).filter("problem is null").collect()}
    assert got == {
        ("w/go.mod", "example.com/w", None, "example.com/a", "v1.2.0"), ("w/go.mod", "example.com/w", None, "example.com/b", "v0.1.0"), ("w/r/Cargo.toml", "r", "0.3.0", "local", None),
        ("w/r/Cargo.toml", "r", "0.3.0", "serde", "1"), ("w/p/pyproject.toml", "p", None, "numpy", ">=2"), ("w/p/pyproject.toml", "p", None, "x", None),
    }
    assert source_code.manifests(files).filter("problem is not null").count() == 2
    assert {r.path: r.root for r in source_code.discovered(files)[1].collect()} | {} == {
        "w/go.mod": "w", "w/r/Cargo.toml": "w/r", "w/p/pyproject.toml": "w/p", "w/e/package.json": "w", "w/n/package.json": "w", "w/r/src/main.rs": "w/r", "top.txt": None,
    }


def test_syntax_inventory(spark):
    from factlake.sources import source_code

    files = spark.createDataFrame([("a.go", "import \"fmt\"\nfunc (t *T) Run(x int) {\n\tfmt.Print(x)\n}\ntype T struct{}\n"), ("b.ts", "export class A {}\nexport default function go() {}\ninterface I {}"), ("c", None)], "path string, text string")
    got = {(r.path, r.kind, r.name, r.line) for r in source_code.syntax_inventory(files).filter("kind <> 'IDENTIFIER'").collect()}
    assert got >= {
        ("a.go", "IMPORT", "fmt", 1), ("a.go", "METHOD", "Run", 2), ("a.go", "CALL", "Print", 3), ("a.go", "DECLARATION", "T", 5), ("b.ts", "EXPORT", "A", 1), ("b.ts", "CLASS", "A", 1),
        ("b.ts", "EXPORT", "go", 2), ("b.ts", "INTERFACE", "I", 3),
    }


def test_workload(spark):
    assert tables.allocate(10_000) == {"find_symbol": 4000, "get_symbol": 2500, "find_references": 2000, "find_cross_repo_consumers": 1000, "get_blast_radius": 500}
    assert sum(tables.allocate(7).values()) == 7 and tables.allocate(3) == {"find_symbol": 1, "get_symbol": 1, "find_references": 1, "find_cross_repo_consumers": 0, "get_blast_radius": 0}
    probes = spark.createDataFrame([(f"s:{i}",) for i in range(30)], "probe string")
    first, again, other = (tables.workload(probes, 200, seed).orderBy("seq").collect() for seed in (1, 1, 2))
    assert first == again != other and [r.seq for r in first] == list(range(1, 201)) and len({r.probe for r in first}) > 20
    assert tables.workload(probes.limit(0), 5).count() == 5


def test_index_project(spark, tmp_path):
    from factlake.operators import references
    from factlake.sources import indexing

    rows = [("p/pyproject.toml", '[project]\nname = "pkg"\nversion = "2"\n'), ("p/a.py", "from p.b import go\n\ndef run():\n    return go()\n"), ("p/b.py", "def go(): pass\n"), ("x.py", "import nowhere\n"), ("bad.py", "(")]
    files = spark.createDataFrame(rows, "path string, text string")
    store = tables.Generations(spark, str(tmp_path / "store"))
    assert indexing.index_project(store, files, "demo", "c1") == 1 and indexing.index_project(store, files, "demo", "c2") is None
    g = store.load()
    assert {(r.name, r.version) for r in g.packages.collect()} == {("pkg", "2"), ("demo", None)} and store.verify()
    assert {r.qualified_name for r in g.symbols.collect()} == {"p.a", "p.a.run", "p.b", "p.b.go", "x"}
    root = g.symbols.filter("qualified_name = 'p.b.go'").select(F.col("stable_key").alias("root"))
    assert {(r.kind, r.path) for r in references.find_references(g, root).collect()} == {("CALLS_DIRECT", "p/a.py"), ("IMPORTS_SYMBOL", "p/a.py")}
    assert {(r.requested_symbol, r.reason) for r in g.unresolved.collect()} == {("nowhere", "SYMBOL_NOT_FOUND"), (None, "SYNTAX_ERROR")}
    changed = files.withColumn("text", F.when(F.col("path") == "bad.py", "y = 1").otherwise(F.col("text")))
    assert indexing.index_project(store, changed, "demo") == 2 and store.load().unresolved.count() == 1


def test_a_slow_publisher_takes_its_pointer_back(spark, sf, tmp_path, monkeypatch):
    from factlake.sources.project import project

    g = project(spark, sf)
    g = type(g)(**{n: t.limit(3) for n, t in g.tables().items()})
    root = str(tmp_path / "store")
    fast = tables.Generations(spark, root)
    assert fast.publish(g, validate=None) == 1
    done = []

    class Slow(tables.Generations):
        def _write_pointer(self, name):
            if not done:  # it sleeps between its mark and its pointer, for longer than anybody waits
                monkeypatch.setattr(tables, "PATIENCE", 0)
                done.append(fast.publish(g, validate=None))
                monkeypatch.setattr(tables, "PATIENCE", 60)
                assert fast.current() == 2
            super()._write_pointer(name)

    assert Slow(spark, root).publish(g, validate=None) == 3 and done == [2]
    log = fast._log()
    assert [x[1] for x in log] == [1, 2, 3] and len({x[0] for x in log}) == 3 and len({x[3] for x in log}) == 3
    assert fast.rollback() == 2


def test_index_beside_other_repositories(spark, tmp_path):
    from factlake.sources import indexing

    store = tables.Generations(spark, str(tmp_path / "store"))
    files = lambda rows: spark.createDataFrame(rows, "path string, text string")
    one = files([("p/a.py", "def go(): pass\n"), ("p/b.py", "from p.a import go\ngo()\n")])
    two = files([("q/c.py", "import nowhere\ndef run(): run2()\ndef run2(): pass\n")])
    assert indexing.index_project(store, one, "one") == 1 and indexing.index_project(store, two, "two") == 2
    g = store.load()
    assert {r.name for r in g.repositories.collect()} == {"one", "two"} and g.files.count() == 3 and store.verify()
    assert indexing.index_project(store, one, "one") is None
    changed = files([("p/a.py", "def other(): pass\n")])
    assert indexing.index_project(store, changed, "one") == 3
    g = store.load()
    assert {r.qualified_name for r in g.symbols.collect()} == {"p.a", "p.a.other", "q.c", "q.c.run", "q.c.run2"}
    assert {r.source_key.split(":")[1] for r in g.edges.collect()} == {"two"} and g.unresolved.count() > 0
