"""An event log of JSON lines that rotates, and a data source that reads it in a stable order, in batches and as a stream.

A log is a folder of files, each named by the place in the whole log of its first byte, so a place is told by one number that
no rotation changes: it is the offset of the stream.  The last file is being written; a line counts when its line feed is
there.  Files are reached by Arrow's file systems, so a folder may be local, shared or in a store.

``EventLog`` appends and rotates; one writer a log.  ``register`` makes ``spark.read.format("factlake_log")`` and ``readStream`` known, with
rows (at, value); ``read_log`` gives events, sorted by time, those of one time in the order of the log.

Defined cases: lines that aren't events are left out of events; an empty folder has no rows; a line of any length is one row; files
that were removed from the beginning (``keep``) are passed over, and a stream that needs them fails, as it lost events.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from factlake.schema import EVENT

#: Bytes from which a file is followed by the next.
LIMIT = 8 << 20
#: Bytes of a partition, and of a look for a line's end.
PART, LOOK = 32 << 20, 1 << 16


def _place(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _files(fs: pafs.FileSystem, top: str) -> list[tuple[int, int, str]]:
    """(place of the first byte, place behind the last, path) of a log's files, in order."""
    found = fs.get_file_info(pafs.FileSelector(top, allow_not_found=True))
    named = [(f.base_name[: -len(".jsonl")], f) for f in found if f.type == pafs.FileType.File and f.base_name.endswith(".jsonl")]
    return sorted((int(n), int(n) + f.size, f.path) for n, f in named if n.isdigit())


class EventLog:
    """Appends to a log; events go as a whole into one file, and a file that has ``limit`` bytes is followed by the next.

    With ``keep``, only so many files stay.
    """

    def __init__(self, path: str, limit: int = LIMIT, keep: int | None = None) -> None:
        self._fs, self._top = _place(path)
        self._fs.create_dir(self._top)
        self._limit, self._keep = limit, keep

    def append(self, events: list[dict]) -> None:
        data = b"".join(json.dumps(e, ensure_ascii=False).encode() + b"\n" for e in events)
        files = _files(self._fs, self._top)
        first, end, path = files[-1] if files else (0, 0, f"{self._top}/{0:020d}.jsonl")
        if end - first >= self._limit:
            path = f"{self._top}/{end:020d}.jsonl"
            first = end
        elif files and not self._whole(path, end - first):
            data = b"\n" + data  # a writer that died left a part of a line: it is a line of its own, and no event
        if end > first:
            with self._fs.open_append_stream(path) as f:
                f.write(data)
        else:
            with self._fs.open_output_stream(path) as f:
                f.write(data)
        for _, _, old in _files(self._fs, self._top)[: -self._keep] if self._keep else []:
            self._fs.delete_file(old)

    def _whole(self, path: str, size: int) -> bool:
        if not size:
            return True
        with self._fs.open_input_file(path) as f:
            return f.read_at(1, size - 1) == b"\n"


class _Part(InputPartition):
    """Bytes [start, end) of the log, in a file that begins at ``first``; ``aligned``: a line begins at ``start``."""

    def __init__(self, path: str, first: int, start: int, end: int, aligned: bool) -> None:
        self.path, self.first, self.start, self.end, self.aligned = path, first, start, end, aligned


class _Log:
    def __init__(self, path: str, part: int) -> None:
        self.path, self.part = path, part

    def end(self) -> int:
        """Behind the last whole line."""
        fs, top = _place(self.path)
        for first, end, path in reversed(_files(fs, top)):
            with fs.open_input_file(path) as f:
                at = end - first
                while at > 0:
                    low = max(0, at - LOOK)
                    found = f.read_at(at - low, low).rfind(b"\n")
                    if found >= 0:
                        return first + low + found + 1
                    at = low
        return 0

    def parts(self, start: int, end: int) -> list[_Part]:
        fs, top = _place(self.path)
        files = _files(fs, top)
        if start < end and files and files[0][0] > start and start > 0:
            raise ValueError(f"the log begins at {files[0][0]}: what stood from {start} on is gone")
        out = []
        for first, last, path in files:
            low, high = max(first, start), min(last, end)
            cuts = [*range(low, high, self.part), high] if low < high else []
            out += [_Part(path, first, a, b, k == 0) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        return out

    def rows(self, part: _Part | None) -> Iterator[tuple[int, str]]:
        """The lines that begin within a part; None is what Spark reads where there are no parts."""
        if part is None:
            return
        fs, _ = _place(self.path)
        with fs.open_input_file(part.path) as raw, io.BufferedReader(raw, 1 << 20) as f:
            at = part.start
            if not part.aligned:
                f.seek(at - 1 - part.first)
                at += len(f.readline()) - 1  # to the line feed before the first line of our own
            f.seek(at - part.first)
            while at < part.end:
                line = f.readline()
                if not line.endswith(b"\n"):
                    return
                yield at, line[:-1].decode("utf-8", "replace")
                at += len(line)


class _Reader(DataSourceReader):
    def __init__(self, log: _Log) -> None:
        self._log = log

    def partitions(self) -> list[_Part]:
        return self._log.parts(0, self._log.end())

    def read(self, partition: _Part) -> Iterator[tuple[int, str]]:
        return self._log.rows(partition)


class _Stream(DataSourceStreamReader):
    def __init__(self, log: _Log, begin: int) -> None:
        self._log, self._begin = log, begin

    def initialOffset(self) -> dict:
        return {"at": self._begin}

    def latestOffset(self) -> dict:
        return {"at": max(self._begin, self._log.end())}

    def partitions(self, start: dict, end: dict) -> list[_Part]:
        return self._log.parts(start["at"], end["at"])

    def read(self, partition: _Part) -> Iterator[tuple[int, str]]:
        return self._log.rows(partition)


class LogSource(DataSource):
    """Options: ``path``; ``part`` (bytes of a partition); ``begin`` (where a new stream begins, by default at the beginning)."""

    @classmethod
    def name(cls) -> str:
        return "factlake_log"

    def schema(self) -> str:
        return "at bigint, value string"

    def _log(self) -> _Log:
        return _Log(self.options["path"], int(self.options.get("part", PART)))

    def reader(self, schema) -> _Reader:
        return _Reader(self._log())

    def streamReader(self, schema) -> _Stream:
        return _Stream(self._log(), int(self.options.get("begin", 0)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LogSource)


def events_of(lines: DataFrame) -> DataFrame:
    """Events with their places (at) from rows (at, value), of a table or a stream; what is no event is left out."""
    bad = lines.withColumn("e", F.from_json("value", EVENT, {"mode": "PERMISSIVE"}))
    return bad.filter("e.ts is not null").select("at", "e.*")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """All events of a log by time, those of one time in the order in which they were written."""
    register(spark)
    return events_of(spark.read.format("factlake_log").option("path", path).load()).orderBy("ts", "at")


def follow_log(spark: SparkSession, path: str, begin: int = 0) -> DataFrame:
    """The events of a log as a stream, each once, over restarts and rotations."""
    register(spark)
    return events_of(spark.readStream.format("factlake_log").option("path", path).option("begin", str(begin)).load())
