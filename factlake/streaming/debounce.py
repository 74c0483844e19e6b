"""Debounced batches of file events: quiet for a while, or open for too long, closes a batch.

``debounce`` is the batch form over events with times; ``debounce_stream`` keeps each repository's open batch in the
state of a stream and closes it by timers, in processing time as events arrive.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

QUIET_MS, LONGEST_MS = 150, 500

_SCHEMA = "repository string, batch long, path string, operations int, opened long, closed long"
_STATE = "batch long, opened long, last long, paths array<string>, ops array<int>"


def debounce(events: DataFrame, quiet_ms: int = QUIET_MS, longest_ms: int = LONGEST_MS) -> DataFrame:
    """(repository, batch, path, operations, opened, closed) from (repository, path, operations, ms).

    Quiet gaps split a repository's events into runs by windows.  A run that stays open too long is cut at times that
    depend on each other, so runs, and nothing larger, are walked one by one.
    """
    by = Window.partitionBy("repository").orderBy("ms", "path")
    gap = F.col("ms") - F.lag("ms").over(by)
    runs = events.withColumn("run", F.sum(F.when(gap > quiet_ms, 1).otherwise(0)).over(by.rowsBetween(Window.unboundedPreceding, 0)))

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, no, opened, held = [], 0, None, {}
        last = 0

        def close(at: int) -> None:
            for path, ops in held.items():
                rows.append((repository, run * 1_000_000 + no, path, ops, opened, at))

        repository, run = pdf["repository"].iloc[0], int(pdf["run"].iloc[0])
        for e in pdf.sort_values(["ms", "path"], kind="stable").itertuples():
            if opened is not None and e.ms >= opened + longest_ms:
                close(opened + longest_ms)
                no, opened, held = no + 1, None, {}
            if opened is None:
                opened = int(e.ms)
            held[e.path] = held.get(e.path, 0) | int(e.operations)
            last = int(e.ms)
        close(min(last + quiet_ms, opened + longest_ms))
        return pd.DataFrame(rows, columns=["repository", "batch", "path", "operations", "opened", "closed"])

    return runs.groupBy("repository", "run").applyInPandas(walk, _SCHEMA)


def _advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    now = state.getCurrentProcessingTimeMs()
    batch, opened, last, paths, ops = state.get if state.exists else (0, -1, -1, [], [])
    held = dict(zip(list(paths), list(ops)))
    out = None
    if state.hasTimedOut:
        out = [(key[0], batch, p, int(o), opened, now) for p, o in held.items()]
        batch, opened, held = batch + 1, -1, {}
    else:
        for pdf in frames:
            for e in pdf.itertuples():
                if opened < 0:
                    opened = now
                held[e.path] = int(held.get(e.path, 0)) | int(e.operations)
        last = now
        if now >= opened + LONGEST_MS:
            out = [(key[0], batch, p, int(o), opened, now) for p, o in held.items()]
            batch, opened, held = batch + 1, -1, {}
    state.update((batch, opened, last, list(held), [int(o) for o in held.values()]))
    if held:
        state.setTimeoutDuration(max(1, min(QUIET_MS, opened + LONGEST_MS - now)))
    if out:
        yield pd.DataFrame(out, columns=["repository", "batch", "path", "operations", "opened", "closed"])


def debounce_stream(events: DataFrame) -> DataFrame:
    """The same over a stream of (repository, path, operations): append, processing time."""
    return events.groupBy("repository").applyInPandasWithState(_advance, _SCHEMA, _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
