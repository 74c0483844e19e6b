"""Streams with state and micro-batches against their batch forms, over restarts, failures and replays."""

import hashlib
import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from factlake.operators import changes
from factlake.sources.tables import Generations
from factlake.streaming.contents import content_stream
from factlake.streaming.resync import MOVE, Follower, Resync

OBSERVED = "repository string, path string, hash string, operations int"
digest = lambda s: hashlib.sha256(s.encode()).hexdigest()


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(key)


def batches_of(seed, n=5):
    rng = random.Random(seed)
    one = lambda: (f"r{rng.randrange(2)}", f"p{rng.randrange(12)}", rng.choice([None, *(digest(c) for c in "abc")]), rng.choice([1, 2, 4]))
    return [[one() for _ in range(rng.randrange(1, 25))] for _ in range(n)]


def write(folder, number, rows):
    with open(folder / f"{number:03d}.json", "w") as f:
        f.writelines(json.dumps(dict(zip(("repository", "path", "hash", "operations"), r))) + "\n" for r in rows)
    in_order(folder / f"{number:03d}.json", number)


def in_order(path, number):
    """Files are read in the order of their times."""
    os.utime(path, (time.time() - 1000 + number,) * 2)


def run(spark, tmp_path, known):
    got = tmp_path / "got"

    def keep(df, number):
        df.write.mode("overwrite").parquet(str(got / f"batch={number}"))

    events = spark.readStream.schema(OBSERVED).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = content_stream(events, known, shards=3).writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    try:
        q.awaitTermination(240)
    finally:
        q.stop()


def test_contents_over_a_restart_and_a_failure(spark, rocks, tmp_path):
    (tmp_path / "in").mkdir()
    seed = [("r0", "p1", digest("a")), ("r1", "p2", digest("b").upper()), ("r1", "elsewhere", digest("c"))]
    known = spark.createDataFrame(seed, "repository string, path string, hash string")
    batches = batches_of(1)
    for i in (0, 1):
        write(tmp_path / "in", i, batches[i])
    run(spark, tmp_path, known)
    # a batch with one row that can't be right changes nothing, whatever else it holds
    write(tmp_path / "in", 2, [*batches[2], ("r0", "p3", "not a hash", 1)])
    with pytest.raises(Exception, match="not an observation"):
        run(spark, tmp_path, known)
    assert not (tmp_path / "got" / "batch=2" / "_SUCCESS").exists()
    write(tmp_path / "in", 2, batches[2])
    for i in (3, 4):
        write(tmp_path / "in", i, batches[i])
    run(spark, tmp_path, known)
    rows = spark.read.parquet(str(tmp_path / "got")).collect()
    state = known.withColumn("hash", F.lower("hash"))
    for i, batch in enumerate(batches):
        said = spark.createDataFrame(changes.content_filter(state, spark.createDataFrame(batch, OBSERVED)).collect(), "repository string, path string, status string, hash string")
        want = {(r.repository, r.path, r.status, r.hash) for r in said.collect() if r.status}
        mine = [(r.repository, r.path, r.status, r.hash) for r in rows if r.batch == i]
        assert len(mine) == len(set(mine)) and set(mine) == want
        ops = {}
        for r, p, _, o in batch:
            ops[r, p] = ops.get((r, p), 0) | o
        assert {(r.repository, r.path): r.operations for r in rows if r.batch == i} == ops
        state = said.filter("hash is not null").select("repository", "path", "hash")
    assert {r.status for r in rows} == {"changed", "unchanged", "removed", "skipped"}


def test_reconcile_tells_skipped_paths_and_manifests(spark):
    known = spark.createDataFrame([("a/go.mod", "1"), ("b", "1"), ("c", "1"), ("d/package.json", "1"), ("e", "1")], "path string, hash string")
    scanned = spark.createDataFrame([("a/go.mod", "2"), ("b", "1"), ("c", None), ("f", None), ("g/go.mod", "3")], "path string, hash string")
    got = {(r.path, r.status, r.manifest) for r in changes.reconcile(known, scanned, ["go.mod", "package.json"]).collect()}
    assert got == {
        ("a/go.mod", "modified", True), ("b", "unchanged", False), ("c", "removed", False), ("d/package.json", "removed", True), ("e", "removed", False), ("f", "skipped", False),
        ("g/go.mod", "added", True),
    }


def moves_of(spark, rows):
    return spark.createDataFrame(rows, MOVE)


def move_rows(seed, n=60):
    rng, t, rows = random.Random(seed), 0, []
    for i in range(n):
        t += rng.choice([0, 1, 2, 5, 12])
        rows.append((f"w{rng.randrange(2)}", t, i, f"r{rng.randrange(3)}", f"c{i}", f"c{i + 1}", rng.random() < 0.2))
    return rows


FIELDS = ["workspace", "repository", "from_commit", "to_commit", "n", "closed"]


def test_resync_equals_its_batch_form_and_replays_change_nothing(spark, tmp_path):
    rows = move_rows(3)
    seen = []
    step = Resync(spark, str(tmp_path / "s"), lambda df, number: seen.append((number, sorted(map(tuple, df.select(*FIELDS).collect())))), 6)
    parts = [rows[i : i + 15] for i in range(0, 60, 15)] + [[(None, rows[-1][1] + 100, 0, None, None, None, False)]]
    for number, part in enumerate(parts):
        step(moves_of(spark, part), number)
        before = list(seen)
        step(moves_of(spark, part), number)  # the same number again
        Resync(spark, str(tmp_path / "s"), step.rebuild, 6)(moves_of(spark, part), number)  # and by a driver that was started anew
        assert seen == before
    assert len({n for n, _ in seen}) > 2 and step._states() == [3, 4]
    got = sorted(r for _, part in seen for r in part)
    batch = changes.resync_batches(moves_of(spark, rows).withColumn("failed", F.lit(False)), 6)
    assert got == sorted(map(tuple, batch.select(*FIELDS).collect()))


def test_what_fails_goes_back_and_keeps_where_it_began(spark, tmp_path):
    seen, fail = [], [True]

    def rebuild(df, number):
        seen.append((number, sorted(map(tuple, df.select("repository", "from_commit", "to_commit", "n").collect()))))
        return spark.createDataFrame([("w",)], "workspace string") if fail.pop() else None

    step = Resync(spark, str(tmp_path / "s"), rebuild, 10)
    row = lambda t, i, r="r": ("w", t, i, r, f"c{i}", f"c{i + 1}", False)
    tick = lambda t: (None, t, 0, None, None, None, False)
    step(moves_of(spark, [row(0, 1), row(3, 2), row(3, 3, "q")]), 0)
    assert not seen
    fail[:] = [False, True]
    step(moves_of(spark, [tick(13)]), 1)  # quiet since 3: is due, and fails
    step(moves_of(spark, [tick(20)]), 2)  # waits as long again
    assert [n for n, _ in seen] == [1]
    step(moves_of(spark, [row(21, 4)]), 3)
    step(moves_of(spark, [tick(31)]), 4)
    assert seen == [(1, [("q", "c3", "c4", 1), ("r", "c1", "c3", 2)]), (4, [("q", "c3", "c4", 1), ("r", "c1", "c5", 3)])]
    step(moves_of(spark, [tick(99)]), 5)
    assert len(seen) == 2


def test_a_crash_before_the_state_is_done_again(spark, tmp_path):
    seen = []

    def rebuild(df, number):
        seen.append((number, sorted(map(tuple, df.select(*FIELDS).collect()))))
        if len(seen) == 1:
            raise RuntimeError("lost")

    rows = [("w", 0, 1, "r", "a", "b", False), (None, 50, 0, None, None, None, False)]
    with pytest.raises(RuntimeError):
        Resync(spark, str(tmp_path / "s"), rebuild, 5)(moves_of(spark, rows), 0)
    Resync(spark, str(tmp_path / "s"), rebuild, 5)(moves_of(spark, rows), 0)
    assert seen[0] == seen[1] == (0, [("w", "r", "a", "b", 1, 5)])


def test_resync_as_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows, seen = move_rows(5, 30), []
    names = [c.split()[0] for c in MOVE.split(", ")]

    def put(number, part):
        (tmp_path / "in" / f"{number}.json").write_text("".join(json.dumps(dict(zip(names, r))) + "\n" for r in part))
        in_order(tmp_path / "in" / f"{number}.json", number)

    def go():
        step = Resync(spark, str(tmp_path / "s"), lambda df, number: seen.extend(map(tuple, df.select(*FIELDS).collect())), 6)
        moves = spark.readStream.schema(MOVE).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        q = step.start(moves, str(tmp_path / "cp"), availableNow=True)
        q.awaitTermination(240)

    put(0, rows[:10])
    put(1, rows[10:20])
    go()
    put(2, rows[20:])
    put(3, [(None, rows[-1][1] + 100, 0, None, None, None, False)])
    go()
    batch = changes.resync_batches(moves_of(spark, rows).withColumn("failed", F.lit(False)), 6)
    assert sorted(seen) == sorted(map(tuple, batch.select(*FIELDS).collect()))


def test_a_follower_installs_what_is_newer_and_tells_of_a_rewind_once(spark, sf, tmp_path):
    from factlake.sources.project import project

    store = Generations(spark, str(tmp_path / "g"))
    installed, told = [], []
    f = Follower(store, lambda graph, n: installed.append((n, graph.symbols.count() > 0)), told.append)
    assert f.tick() is None and not told
    graph = project(spark, sf)
    store.publish(graph, validate=None)
    assert f.tick() == 1 and f.tick() is None
    store.publish(graph, validate=None)
    assert f.tick() == 2
    store.rollback()
    assert f.tick() is None and f.tick() is None and len(told) == 1 and f.served == 2
    store.publish(graph, validate=None)
    assert f.tick() == 3 and installed == [(1, True), (2, True), (3, True)]
    broken = Follower(store, lambda graph, n: 1 / 0, told.append)
    assert broken.tick() is None and broken.served is None and "ZeroDivisionError" in told[-1]
