"""A log that rotates: read in a stable order, in any partitions, and followed over restarts without loss or repeats."""

import random

import pytest

from factlake.sources import eventlog


def event(i, ts=None):
    return {"ts": ts or f"2024-01-01T00:00:{i % 3:02d}Z", "kind": "tool", "tool": f"t{i}é" + "x" * (i % 50), "results": i}


def test_append_rotate_read(spark, tmp_path):
    path = str(tmp_path / "log")
    log = eventlog.EventLog(path, limit=900)
    for i in range(40):
        log.append([event(i), event(100 + i)])
    (tmp_path / "log" / "note.txt").write_text("no log")
    assert len(list((tmp_path / "log").glob("*.jsonl"))) > 3
    want = sorted(((f"2024-01-01T00:00:{i % 3:02d}Z", k, i) for k, i in enumerate(x for n in range(40) for x in (n, 100 + n))))
    got = eventlog.read_log(spark, path)
    assert [r.results for r in got.collect()] == [i for _, _, i in want]
    eventlog.register(spark)
    lines = [sorted(map(tuple, spark.read.format("factlake_log").option("path", path).option("part", part).load().collect())) for part in (1, 7, 100, 1 << 20)]
    assert lines[0] == lines[1] == lines[2] == lines[3] and len(lines[0]) == 80
    data = b"".join(p.read_bytes() for p in sorted((tmp_path / "log").glob("*.jsonl")))
    assert all(data[at : at + len(v.encode())].decode() == v for at, v in lines[0])


def test_parts_of_lines_and_what_is_no_event(spark, tmp_path):
    path = str(tmp_path / "log")
    assert eventlog.read_log(spark, path).count() == 0
    log = eventlog.EventLog(path)
    log.append([event(1)])
    (file,) = (tmp_path / "log").glob("*.jsonl")
    with open(file, "ab") as f:
        f.write(b'{"ts": "2024-01-01T00:00:09Z", "res')  # a writer that dies
    assert [r.results for r in eventlog.read_log(spark, path).collect()] == [1]
    eventlog.EventLog(path).append([event(2), {"kind": "no time"}])
    assert [r.results for r in eventlog.read_log(spark, path).collect()] == [1, 2]


def test_followed_over_restarts_and_rotations(spark, tmp_path):
    path, log = str(tmp_path / "log"), eventlog.EventLog(str(tmp_path / "log"), limit=500)
    rng, wrote, i = random.Random(1), [], 0
    for _ in range(4):
        for _ in range(rng.randrange(5, 15)):
            log.append([event(i)])
            wrote.append(i)
            i += 1
        q = eventlog.follow_log(spark, path).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
        q = q.trigger(processingTime="0 seconds").start()
        q.processAllAvailable()
        q.stop()
        got = [r.results for r in spark.read.parquet(str(tmp_path / "out")).orderBy("at").collect()]
        assert got == wrote
    assert len(list((tmp_path / "log").glob("*.jsonl"))) > 2


def test_what_is_gone_is_told(spark, tmp_path):
    path, log = str(tmp_path / "log"), eventlog.EventLog(str(tmp_path / "log"), limit=100, keep=2)
    for i in range(10):
        log.append([event(i)])
    assert len(list((tmp_path / "log").glob("*.jsonl"))) == 2 and 0 < eventlog.read_log(spark, path).count() < 10
    with pytest.raises(ValueError, match="gone"):
        eventlog._Log(path, 100).parts(5, 10_000)
