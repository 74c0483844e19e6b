"""Change detection between two states of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reconcile(known: DataFrame, scanned: DataFrame, manifests: list[str] | None = None) -> DataFrame:
    """(path, status, old_hash, new_hash, manifest) from two states (path, hash): added, modified, unchanged, removed, skipped.

    A path that was scanned without a hash is no regular file: it is removed if it was known, else skipped.  ``manifest``
    says of a path that was added, modified or removed whether its last part is one of ``manifests``.
    """
    old, new = known.select("path", F.col("hash").alias("old_hash")), scanned.select("path", F.col("hash").alias("new_hash"))
    old = old.filter("old_hash is not null")
    status = (
        F.when(F.col("old_hash").isNull() & F.col("new_hash").isNull(), "skipped")
        .when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "removed")
        .when(F.col("old_hash") == F.col("new_hash"), "unchanged").otherwise("modified")
    )
    leaf = F.element_at(F.split("path", "/"), -1)
    moved = F.col("status").isin("added", "modified", "removed")
    both = old.join(new, "path", "full_outer").select("path", status.alias("status"), "old_hash", "new_hash")
    return both.withColumn("manifest", moved & leaf.isin(*manifests) if manifests else F.lit(False))


def content_filter(known: DataFrame, observed: DataFrame) -> DataFrame:
    """(repository, path, status, hash): what a batch of file events says about content, and the hash to be known next.

    ``known`` (repository, path, hash) is the state, ``observed`` (repository, path, hash) the batch, with a null hash where
    there is no regular file; several events of a path are one, the last state (rows must agree; the greatest hash stands).
    ``changed`` is a new or different hash, ``unchanged`` an equal one, ``removed`` a known file that is gone, ``skipped`` an
    unknown one.  Files without an event have no status and keep their hash.
    """
    key = ["repository", "path"]
    old = known.select(*key, F.col("hash").alias("old"))
    new = observed.groupBy(*key).agg(F.max("hash").alias("new"), F.lit(True).alias("seen"))
    status = (
        F.when(F.col("seen").isNull(), F.lit(None)).when(F.col("new").isNull(), F.when(F.col("old").isNull(), "skipped").otherwise("removed"))
        .when(F.col("new").eqNullSafe(F.col("old")), "unchanged").otherwise("changed")
    )
    return old.join(new, key, "full_outer").select(*key, status.alias("status"), F.when(F.col("seen").isNull(), F.col("old")).otherwise(F.col("new")).alias("hash"))


def renames(changes: DataFrame) -> DataFrame:
    """(hash, old_path, new_path): a removed and an added file of equal content, if each is the only one of it."""
    one = lambda status, h, name: (
        changes.filter(F.col("status") == status).groupBy(F.col(h).alias("hash"))
        .agg(F.count("*").alias("n"), F.min("path").alias(name)).filter("n = 1").drop("n")
    )
    return one("removed", "old_hash", "old_path").join(one("added", "new_hash", "new_path"), "hash")


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def ignored(path: Column, globs: list[str]) -> Column:
    """Whether a path matches one of the globs: ``*`` within a part, ``**`` across parts, ``?`` one character; a glob
    without a slash matches a part anywhere, and what matches a directory matches all below it."""
    import re

    out = F.lit(False)
    for g in globs:
        body = re.escape(g.strip("/")).replace(r"\*\*/", "(?:.*/)?").replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
        head = "^" if "/" in g.strip("/") else "(?:^|.*/)"
        out = out | path.rlike(f"{head}{body}(?:/.*)?$")
    return out


def coalesce_moves(moves: DataFrame) -> DataFrame:
    """(repository, from_commit, to_commit, n): the head moves of a repository as one, from the earliest to the latest."""
    return moves.groupBy("repository").agg(
        F.min_by("from_commit", F.struct("ts", "seq")).alias("from_commit"), F.max_by("to_commit", F.struct("ts", "seq")).alias("to_commit"), F.count("*").alias("n")
    )


def resync_batches(moves: DataFrame, debounce: int) -> DataFrame:
    """(workspace, batch, repository, from_commit, to_commit, n, closed) of head moves that are rebuilt together.

    ``moves`` (workspace, ts, seq, repository, from_commit, to_commit, busy, failed): a batch closes when its workspace has been
    quiet for ``debounce``.  A row that is ``busy`` (the repository is still inside an operation) moves nothing but starts the
    quiet time anew, if a batch is open.  A batch that holds a ``failed`` move isn't rebuilt: its moves go back and are part
    of the next, with the commit they started from; ``closed`` is null if there is no next.
    """
    by = Window.partitionBy("workspace").orderBy("ts", "seq")
    busy = F.coalesce("busy", F.lit(False))
    quiet = F.col("ts") - F.lag("ts").over(by) >= debounce
    m = moves.withColumn("run", F.sum(F.when(quiet, 1).otherwise(0)).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    # a busy row before a run's first move opens nothing
    so_far = Window.partitionBy("workspace", "run").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    m = m.withColumn("open", F.max(~busy).over(so_far)).filter("open")
    runs = m.groupBy("workspace", "run").agg((F.max("ts") + debounce).alias("closed"), F.max(F.coalesce("failed", F.lit(False)) & ~busy).alias("back"))
    before = Window.partitionBy("workspace").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("batch", F.coalesce(F.sum(F.when(F.col("back"), 0).otherwise(1)).over(before), F.lit(0)))
    runs = runs.withColumn("closed", F.max(F.when(~F.col("back"), F.col("closed"))).over(Window.partitionBy("workspace", "batch")))
    at = F.struct("ts", "seq")
    return m.filter(~busy).join(runs.select("workspace", "run", "batch", "closed"), ["workspace", "run"]).groupBy("workspace", "batch", "repository").agg(
        F.min_by("from_commit", at).alias("from_commit"), F.max_by("to_commit", at).alias("to_commit"), F.count("*").alias("n"), F.first("closed").alias("closed")
    )
