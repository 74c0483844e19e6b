"""What events of files say about their content, as a stream with state.

``content_stream`` is :func:`factlake.operators.changes.content_filter` over the micro-batches of a stream: what is known of each file's
content is kept as a map in the state, from path to hash, for each repository and shard of its paths, so a repository of any
size is spread over tasks and no task reads more of the state than the paths it is asked for.

A batch is applied wholly or not at all: a row that can't be right (no repository, no path, a hash that isn't 64 hexadecimal digits)
fails the micro-batch, and neither the state nor what was put out changes; a restart from the checkpoint goes on where the
last whole batch ended.  Several events of a path in a batch are one: their operations are or-ed, the greatest hash stands.

The session must keep its state in RocksDB (``spark.sql.streaming.stateStore.providerClass``), as Spark asks of this operator.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Parts that the paths of a repository are spread over; fixed for the life of a checkpoint.
SHARDS = 64
_OUT = "repository string, path string, status string, hash string, operations int"
_HASH = re.compile(r"[0-9a-fA-F]{64}")


class _Contents(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self._known = handle.getMapState("known", "path string", "hash string")

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:
        for path, h in zip(initialState["path"], initialState["hash"]):
            self._known.updateValue((path,), (_checked(key[0], path, h),))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen: dict[str, tuple[str | None, int]] = {}
        for pdf in rows:
            for path, h, operations in zip(pdf["path"], pdf["hash"], pdf["operations"]):
                h = None if h is None or pd.isna(h) else _checked(key[0], path, h)
                _checked(key[0], path, h or "0" * 64)
                was, ops = seen.get(path, (None, 0))
                seen[path] = (max(filter(None, (was, h)), default=None), ops | int(operations))
        out = []
        for path, (h, operations) in seen.items():
            old = self._known.getValue((path,))
            old = old[0] if old else None
            if h is None:
                status = "skipped" if old is None else "removed"
                if old is not None:
                    self._known.removeKey((path,))
            else:
                status = "unchanged" if h == old else "changed"
                if h != old:
                    self._known.updateValue((path,), (h,))
            out.append((key[0], path, status, h, operations))
        yield pd.DataFrame(out, columns=["repository", "path", "status", "hash", "operations"])

    def close(self) -> None:
        pass


def _checked(repository: str | None, path: str | None, h: str) -> str:
    if not repository or not path or not _HASH.fullmatch(h):
        raise ValueError(f"not an observation of a file: {repository!r}, {path!r}, {h!r}")
    return h.lower()


def content_stream(events: DataFrame, known: DataFrame | None = None, shards: int = SHARDS) -> DataFrame:
    """(repository, path, status, hash, operations) for a stream of (repository, path, hash, operations); append.

    ``hash`` is null where there is no regular file.  ``known`` (repository, path, hash) is what is known when the stream begins: each
    file once.  ``status`` is changed, unchanged, removed (it was known) or skipped (it wasn't).
    """
    shard = F.pmod(F.xxhash64("path"), F.lit(shards)).cast("int").alias("shard")
    keyed = events.select(F.coalesce("repository", F.lit("")).alias("repository"), shard, "path", "hash", "operations").groupBy("repository", "shard")
    start = None if known is None else known.select("repository", shard, "path", "hash").groupBy("repository", "shard")
    return keyed.transformWithStateInPandas(_Contents(), outputStructType=_OUT, outputMode="append", timeMode="None", initialState=start)
