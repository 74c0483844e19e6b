"""Following heads and generations by micro-batches.

``Resync`` takes a stream of head moves and has what moved rebuilt, workspace by workspace, when it has been quiet: the batch form is
:func:`factlake.operators.changes.resync_batches`.  A micro-batch reads the state of the one before it, and writes its results and its
own state under its number; a number whose state is there has been applied, and coming again it changes nothing.

``Follower`` asks for the current generation at each tick and installs one only if it is newer than what is served.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factlake.operators.changes import resync_batches
from factlake.sources.tables import Generations

MOVE = "workspace string, ts long, seq long, repository string, from_commit string, to_commit string, busy boolean"
_PENDING = MOVE + ", failed boolean"
Rebuild = Callable[[DataFrame, int], "DataFrame | None"]


class Resync:
    """Moves (``MOVE``) are held until their workspace has been quiet for ``debounce``; then ``rebuild`` is given
    (workspace, batch, repository, from_commit, to_commit, n, closed) and the number of the micro-batch, and may return the
    workspaces (workspace) that couldn't be rebuilt.  Their moves go back and wait as long again: the next rebuild has the commits
    that the first one started from.  A ``busy`` row defers its workspace.  The clock is the latest time of any row, so a row
    without a workspace, of a time alone, is a tick.

    What is given to a rebuild is written to ``<folder>/rebuilt/<number>`` first.  A micro-batch that is stopped anywhere is done
    again from the state before it and finds the same batches, so ``rebuild`` may see a number twice, with equal rows.
    """

    def __init__(self, spark: SparkSession, folder: str, rebuild: Rebuild, debounce: int) -> None:
        self.spark, self.folder, self.rebuild, self.debounce = spark, folder.rstrip("/"), rebuild, debounce
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _states(self) -> list[int]:
        """Numbers of the micro-batches whose state is whole, oldest first."""
        top = self._path(f"{self.folder}/state")
        if not self._fs.exists(top):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(top)]
        return sorted(int(n) for n in names if n.isdigit() and self._fs.exists(self._path(f"{self.folder}/state/{n}/_SUCCESS")))

    def __call__(self, moves: DataFrame, number: int) -> None:
        """One micro-batch, for ``foreachBatch``."""
        done = self._states()
        if number in done:
            return
        before = max((n for n in done if n < number), default=None)
        new = moves.select("workspace", "ts", "seq", "repository", "from_commit", "to_commit", F.coalesce("busy", F.lit(False)).alias("busy"), F.lit(False).alias("failed"))
        if before is not None:
            new = self.spark.read.schema(_PENDING).parquet(f"{self.folder}/state/{before}").unionByName(new)
        held = new.filter("workspace is not null")
        now = new.agg(F.max("ts")).first()[0]
        if now is not None:
            found = resync_batches(held, self.debounce)
            due = found.filter(F.col("closed") <= now)
            out = f"{self.folder}/rebuilt/{number}"
            due.write.mode("overwrite").parquet(out)
            due = self.spark.read.schema(due.schema).parquet(out)
            back = self.rebuild(due, number) if not due.isEmpty() else None
            closed = due.groupBy("workspace").agg(F.max("closed").alias("closed"))
            if back is not None:
                back = back.select("workspace", F.lit(True).alias("back")).distinct()
                closed = closed.join(back, "workspace", "left")
            else:
                closed = closed.withColumn("back", F.lit(None).cast("boolean"))
            # of a workspace that was rebuilt, what stands before its last batch's end is done; of one that wasn't, it waits from now on
            over = F.col("closed").isNotNull() & (F.col("ts") + self.debounce <= F.col("closed"))
            waits = over & F.coalesce("back", F.lit(False))
            kept = held.join(closed, "workspace", "left").filter(~over | F.coalesce("back", F.lit(False)))
            ts = F.when(waits, F.lit(now)).otherwise(F.col("ts")).alias("ts")
            # several moves that go back get one time and keep their order
            seq = F.when(waits, F.col("seq") - (F.lit(now) - F.col("ts")) * (1 << 36)).otherwise(F.col("seq")).alias("seq")
            new = kept.filter(~(waits & F.col("busy"))).select("workspace", ts, seq, "repository", "from_commit", "to_commit", "busy", "failed")
            none = F.lit(None)
            clock = self.spark.range(1).select(none.cast("string").alias("workspace"), F.lit(now).cast("long").alias("ts"), F.lit(0).cast("long").alias("seq"), *(none.cast("string").alias(c) for c in ("repository", "from_commit", "to_commit")), F.lit(False).alias("busy"), F.lit(False).alias("failed"))
            new = new.unionByName(clock)
        new.write.mode("overwrite").parquet(f"{self.folder}/state/{number}")
        for n in done[:-1]:
            self._fs.delete(self._path(f"{self.folder}/state/{n}"), True)

    def start(self, moves: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Run over a stream of moves."""
        writer = moves.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint)
        return (writer.trigger(**trigger) if trigger else writer).start()


class Follower:
    """Serves the newest generation of a store: ``install`` is given the graph and its number.

    Only a strictly newer generation is installed.  An older one than what is served means that the store was rewound: ``report`` is
    told once for each such generation.  A failure is reported and the next tick tries again; what is served stays.
    """

    def __init__(self, store: Generations, install: Callable, report: Callable[[str], None] | None = None) -> None:
        self.store, self.install, self.report = store, install, report or (lambda message: None)
        self.served: int | None = None
        self._rewound: int | None = None

    def tick(self) -> int | None:
        """The generation that was installed, if any."""
        try:
            now = self.store.current()
            if now is None:
                return None
            if self.served is not None and now <= self.served:
                if now < self.served and now != self._rewound:
                    self._rewound = now
                    self.report(f"the store was rewound to {now} while {self.served} is served")
                return None
            self.install(self.store.load(now), now)
        except Exception as e:  # a follower never stops: the next tick tries again
            self.report(f"{type(e).__name__}: {e}")
            return None
        self.served = now
        return now

    def start(self, spark: SparkSession, interval: str = "2 seconds") -> StreamingQuery:
        """A tick at each trigger of a stream of its own."""
        ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        return ticks.writeStream.foreachBatch(lambda df, n: (self.tick(), None)[1]).trigger(processingTime=interval).start()
