"""Reading and writing facts, graphs in generations, and event logs."""

from __future__ import annotations

import json
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from factlake.operators import factsets
from factlake.operators.adjacency import cluster, opened
from factlake.schema import EVENT, FACT_SET, Graph

#: Seconds after which a publisher that holds an entry counts as dead.
PATIENCE = 60
#: Buckets of a generation's adjacency have about so many edges, or fewer.
EDGES_OF_BUCKET = 2_000_000
COLLECTIONS = ("repositories", "packages", "files", "symbols", "evidence", "edges", "unresolved")


def read_fact_json(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The seven collections of JSON fact documents, with the schema stated and not inferred."""
    facts = spark.read.schema(FACT_SET).option("multiLine", True).json(path)
    return {c: facts.select(F.explode(c).alias("row")).select("row.*") for c in COLLECTIONS}


def read_events(spark: SparkSession, paths: list[str]) -> DataFrame:
    """An event log, rotated files first; lines that can't be parsed are left out."""
    return spark.read.schema(EVENT).option("mode", "DROPMALFORMED").json(paths)


def discover(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, content_hash, size, modified) of the files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return files.select("path", F.sha2("content", 256).alias("content_hash"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


class Conflict(RuntimeError):
    """Another publisher was faster every time."""


class Generations:
    """Graphs in folders of their own below ``root``; readers follow the newest entry of a log of pointers.

    A generation holds its edges also clustered by either end, for walks.

    A generation is written beside the others, validated, and only then pointed to.  A pointer is an empty file whose name says
    all, ``CURRENT.<entry>.<generation>.<backup>.<folder>``; it is created if absent, so readers see the old or the new one at
    any time, a crash before leaves the old one, and of two publishers one creates an entry and the other tries the next.
    Folders are reached by Hadoop's file systems alone, so ``root`` may be in any store that Spark reaches and in which of two that
    create one file, one fails.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self) -> list[str]:
        top = self._path(self.root)
        return [s.getPath().getName() for s in self._fs.listStatus(top)] if self._fs.exists(top) else []

    def _log(self) -> list[tuple[int, int, int, str]]:
        """(entry, generation, backup or 0, folder) of all pointers, oldest first."""
        said = [n.split(".", 4) for n in self._names() if n.startswith("CURRENT.")]
        return sorted((int(e), int(g), int(b), folder) for _, e, g, b, folder in said)

    def _point(self, choose, tries: int = 1500) -> int:
        """Append what ``choose`` makes of the log: (generation, backup, folder).

        An entry belongs to whoever creates its mark, and to nobody else ever.  A mark without a pointer is a publisher at work; after
        ``PATIENCE`` seconds it counts as dead and is passed by.  If it was only slow, it finds a later entry beside its own
        pointer, takes that back and asks for another entry, so no generation has one number twice.
        """
        for _ in range(tries):
            log = self._log()
            last = log[-1][0] if log else 0
            marks = [int(n[len(".entry-"):]) for n in self._names() if n.startswith(".entry-")]
            open_mark = max((m for m in marks if m > last), default=None)
            if open_mark is not None and self._age(f".entry-{open_mark:012d}") < PATIENCE:
                time.sleep(0.05)
                continue
            generation, backup, folder = choose(log)
            entry = max([last, *marks]) + 1
            try:
                self._fs.create(self._path(f"{self.root}/.entry-{entry:012d}"), False).close()
            except Py4JJavaError as e:
                if "Exist" not in str(e.java_exception.getClass().getName()):
                    raise
                continue
            name = f"CURRENT.{entry:012d}.{generation}.{backup}.{folder}"
            self._write_pointer(name)
            if self._log()[-1][0] == entry:
                return generation
            self._fs.delete(self._path(f"{self.root}/{name}"), False)
        raise Conflict(f"{self.root}: no entry could be made in {tries} tries")

    def _write_pointer(self, name: str) -> None:
        self._fs.create(self._path(f"{self.root}/{name}"), False).close()

    def _age(self, name: str) -> float:
        """Seconds since a file was written; a file that is gone is as old as can be."""
        try:
            return time.time() - self._fs.getFileStatus(self._path(f"{self.root}/{name}")).getModificationTime() / 1000
        except Py4JJavaError as e:
            if "NotFound" not in str(e.java_exception.getClass().getName()):
                raise
            return float("inf")

    def _read(self, folder: str) -> dict:
        stream = self._fs.open(self._path(f"{self.root}/{folder}/said.json"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def current(self) -> int | None:
        log = self._log()
        return log[-1][1] if log else None

    def publish(self, graph: Graph, validate=factsets.validate) -> int:
        """Write, validate and publish; on any failure the current generation stays.  ``validate`` returns what is wrong, by
        default the referential and vocabulary rules of fact sets; None checks nothing."""
        # a folder of its own for each attempt: no reader can hold a list of files that are replaced
        folder = f"gen-{uuid.uuid4().hex}"
        top = f"{self.root}/{folder}"
        digests = {}
        for name, table in graph.tables().items():
            # what is written is summed up on its way: the rows of a task that failed don't count
            sums = Observation()
            writer = table.observe(sums, *factsets.digest_sums(sorted(table.columns))).write.mode("overwrite")
            if name == "edges":
                writer = writer.partitionBy("kind")
            writer.parquet(f"{top}/{name}")
            digests[name] = {"n": sums.get["n"], "digest": factsets.digest_text(**sums.get), "columns": table.columns}
        said = {"folder": folder, "tables": digests}
        edges = self._graph(said).edges
        buckets = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-digests["edges"]["n"] // EDGES_OF_BUCKET))
        cluster(edges, f"{top}/adjacency", buckets)
        problem = validate(self._graph(said)).first() if validate is not None else None
        if problem is not None:
            self._fs.delete(self._path(top), True)
            raise ValueError(f"not fit to be published: {problem}")
        stream = self._fs.create(self._path(f"{top}/said.json"), True)
        stream.write(json.dumps(said, sort_keys=True).encode())
        stream.close()
        return self._point(lambda log: (max((g for _, g, _, _ in log), default=0) + 1, log[-1][1] if log else 0, folder))

    def _graph(self, said: dict) -> Graph:
        read = lambda n: self.spark.read.parquet(f"{self.root}/{said['folder']}/{n}")
        return Graph(**{n: read(n).select(*d["columns"]) for n, d in said["tables"].items()})

    def _walkable(self, said: dict) -> Graph:
        graph = self._graph(said)
        graph.clustered = opened(self.spark, f"{self.root}/{said['folder']}/adjacency")
        return graph

    def _said(self, generation: int | None) -> dict:
        log = self._log()
        g = generation if generation is not None else (log[-1][1] if log else None)
        folders = {number: folder for _, number, _, folder in log}
        if g not in folders:
            raise LookupError("INDEX_NOT_READY")
        return self._read(folders[g])

    def load(self, generation: int | None = None) -> Graph:
        """The graph of a generation, the current one unless told otherwise."""
        return self._walkable(self._said(generation))

    def verify(self, generation: int | None = None) -> bool:
        """Whether the tables still have the content that was published."""
        said = self._said(generation)
        graph = self._graph(said)
        return all(factsets.digest(t.select(*sorted(t.columns))).first()["digest"] == said["tables"][n]["digest"] for n, t in graph.tables().items())

    def rollback(self) -> int:
        """Point back to the backup, if its content is what was published."""
        log = self._log()
        backup = log[-1][2] if log else 0
        if not backup or not self.verify(backup):
            raise LookupError("there is no backup that can be restored")
        folder = {number: folder for _, number, _, folder in log}[backup]
        return self._point(lambda log: (backup, 0, folder))

    def prune(self, abandoned_after: float = 86_400) -> list[int]:
        """Delete all generations but the current one and its backup, and what publishers that died have left behind."""
        log = self._log()
        keep = {log[-1][1], log[-1][2]} if log else set()
        numbers = {folder: number for _, number, _, folder in log}
        entries = {f"CURRENT.{e:012d}.{g}.{b}.{folder}": (e, g) for e, g, b, folder in log}
        gone, last = [], log[-1][0] if log else 0
        backup_entry = max((e for e, g, _, _ in log if log and g == log[-1][2]), default=last)
        # pointers first, so that none points to a folder that is gone
        for name in self._names():
            path = self._path(f"{self.root}/{name}")
            if name in entries and entries[name][0] not in (last, backup_entry):
                self._fs.delete(path, False)
            elif name.startswith(".entry-") and int(name[7:]) < last:
                self._fs.delete(path, False)
        for name in self._names():
            path = self._path(f"{self.root}/{name}")
            if name.startswith("gen-"):
                number = numbers.get(name)
                old = self._fs.getFileStatus(path).getModificationTime() < (time.time() - abandoned_after) * 1000
                if number not in keep if number is not None else old:
                    self._fs.delete(path, True)
                    gone += [number] if number is not None else []
        return sorted(gone)

    def follow(self, seen: int | None) -> int | None:
        """A generation that is strictly newer than the one seen, or None; going back is not news."""
        now = self.current()
        return now if now is not None and (seen is None or now > seen) else None


def scan(graph: Graph, with_edges: bool = True) -> DataFrame:
    """(table, key, row) of all tables in the order of table and key, values that are null as empty strings: a full scan.

    The order is a range partitioning by table and key, so no task sees a whole table; rows are written as text behind it.
    """
    tables = {name: table for name, table in sorted(graph.tables().items()) if name != "edges" or with_edges}
    columns = sorted({c for table in tables.values() for c in table.columns})
    out = None
    for name, table in tables.items():
        part = table.select(F.lit(name).alias("table"), *((F.col(c) if c in table.columns else F.lit(None)).cast("string").alias(c) for c in columns))
        out = part if out is None else out.union(part)
    key, row = F.col("stable_key"), None
    if "edges" in tables:
        key = F.when(F.col("table") == "edges", F.concat_ws("|", "source_key", "kind", "target_key")).otherwise(key)
    for name, table in tables.items():
        text, here = F.to_json(F.struct(*(F.coalesce(c, F.lit("")).alias(c) for c in sorted(table.columns)))), F.col("table") == name
        row = F.when(here, text) if row is None else row.when(here, text)
    return out.repartitionByRange("table", key).select("table", key.alias("key"), row.alias("row")).sortWithinPartitions("table", "key", "row")


def full_scan(edges: DataFrame) -> DataFrame:
    """All edges in the order of source, target, kind and the rest, nulls as empty strings."""
    columns = ["source_key", "target_key", "kind", "confidence", "provenance", "evidence_key"]
    return edges.select(*(F.coalesce(c, F.lit("")).alias(c) for c in columns)).orderBy(*columns)


def apply_delta(rows: DataFrame, upserts: DataFrame, deletes: DataFrame, key: list[str]) -> DataFrame:
    """A table's next state: rows but those deleted or replaced, and the new ones."""
    gone = upserts.select(*key).union(deletes.select(*key)).distinct()
    return rows.join(gone, key, "left_anti").unionByName(upserts.select(*rows.columns))


def check_delta(symbols: DataFrame, add: DataFrame, update: DataFrame, delete: DataFrame, add_edges: DataFrame, delete_edges: DataFrame, replace: DataFrame) -> DataFrame:
    """(problem, key): why a delta can't be applied; see :func:`apply_graph_delta`.

    A symbol in two of add, update and delete, or twice in one; one added that is there, or updated or deleted that isn't; an edge
    that is added or deleted twice, or whose end is deleted or unknown; a source that is replaced and deleted, or that has
    both added edges and a replacement.
    """
    say = lambda df, problem, key: df.select(F.lit(problem).alias("problem"), key.alias("key"))
    key, edge = F.col("stable_key"), F.concat_ws("|", "source_key", "kind", "target_key")
    acts = add.select("stable_key").union(update.select("stable_key")).union(delete.select("stable_key"))
    there, gone = symbols.select("stable_key"), delete.select("stable_key")
    after = there.union(add.select("stable_key")).distinct().join(gone, "stable_key", "left_anti")
    new = add_edges.select("source_key", "kind", "target_key").unionByName(replace.filter("target_key is not null").select("source_key", "kind", "target_key"))
    twice = lambda df: df.groupBy("source_key", "kind", "target_key").agg(F.count("*").alias("n")).filter("n > 1")
    sources = replace.select(F.col("source_key").alias("stable_key")).distinct()
    end = lambda c: new.join(after.select(F.col("stable_key").alias(c)), c, "left_anti")
    parts = [
        say(acts.groupBy("stable_key").agg(F.count("*").alias("n")).filter("n > 1"), "symbol_in_two_actions", key),
        say(add.join(there, "stable_key", "left_semi"), "added_symbol_exists", key),
        say(update.select("stable_key").union(gone).join(there, "stable_key", "left_anti"), "unknown_symbol", key),
        say(twice(new), "edge_added_twice", edge), say(twice(delete_edges), "edge_deleted_twice", edge),
        say(end("source_key"), "edge_without_source", edge), say(end("target_key"), "edge_without_target", edge),
        say(sources.join(gone, "stable_key", "left_semi"), "replaced_source_is_deleted", key),
        say(sources.join(add_edges.select(F.col("source_key").alias("stable_key")), "stable_key", "left_semi"), "replaced_source_has_added_edges", key),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.distinct()


def apply_graph_delta(symbols: DataFrame, edges: DataFrame, add: DataFrame, update: DataFrame, delete: DataFrame, add_edges: DataFrame, delete_edges: DataFrame, replace: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The next (symbols, edges): one state to the next, published as a generation of its own.

    ``replace`` has the new outgoing edges of its sources; a source that is to have none stands there with a null target.
    A deleted symbol's edges go with it; an edge that is added again is replaced.  A delta with problems is refused.
    """
    problem = check_delta(symbols, add, update, delete, add_edges, delete_edges, replace).first()
    if problem is not None:
        raise ValueError(f"{problem['problem']}: {problem['key']}")
    gone, columns = delete.select("stable_key"), edges.columns
    end = lambda c: gone.select(F.col("stable_key").alias(c))
    left = edges.join(end("source_key"), "source_key", "left_anti").join(end("target_key"), "target_key", "left_anti")
    left = left.join(replace.select("source_key").distinct(), "source_key", "left_anti").select(*columns)
    new = add_edges.select(*columns).unionByName(replace.filter("target_key is not null").select(*columns))
    return apply_delta(symbols, add.unionByName(update), delete, ["stable_key"]), apply_delta(left, new, delete_edges, ["source_key", "target_key", "kind"])


def synthetic(spark: SparkSession, symbols: int = 100_000, edges: int = 1_000_000, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(symbols, edges): a chain of depth five, a cycle of three, two hubs, one percent without edges; the rest by hash."""
    active = symbols - max(1, symbols // 100)
    name = lambda c: F.concat(F.lit("s:"), F.lpad(c.cast("string"), 9, "0"))
    ids = spark.range(symbols)
    s = ids.select(name(F.col("id")).alias("stable_key"), (F.col("id") % 40).alias("repository"), (F.col("id") >= active).alias("isolated"))
    draw = lambda k: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(active))
    n = F.col("id")
    fixed = 5 + 3
    chain, cycle = n < 5, (n >= 5) & (n < fixed)
    source = F.when(chain, n).when(cycle, active - 3 + (n - 5)).when(n % 50 == 0, n % 2).otherwise(draw(1))
    target = F.when(chain, n + 1).when(cycle, active - 3 + (n - 4) % 3).when(n % 50 == 25, n % 2).otherwise(draw(2))
    kind = F.when(n % 3 == 0, "CALLS_DIRECT").when(n % 3 == 1, "REFERENCES").otherwise("TYPE_USES")
    e = spark.range(edges).select(name(source).alias("source_key"), name(target).alias("target_key"), kind.alias("kind"))
    return s, e.distinct()


#: The operations of a workload and their weights in percent.
WEIGHTS = {"find_symbol": 40, "get_symbol": 25, "find_references": 20, "find_cross_repo_consumers": 10, "get_blast_radius": 5}


def allocate(calls: int, weights: dict[str, int] = WEIGHTS) -> dict[str, int]:
    """How many calls go to each operation: the whole parts of the shares, and what is left to the largest remainders."""
    total = sum(weights.values())
    out = {k: calls * w // total for k, w in weights.items()}
    order = sorted(weights, key=lambda k: -(calls * weights[k] % total))  # stable: of equals the first
    for k in order[: calls - sum(out.values())]:
        out[k] += 1
    return out


def workload(probes: DataFrame, calls: int = 10_000, seed: int = 42) -> DataFrame:
    """(seq, operation, probe): calls in an order and with probes (probe) that the seed decides.

    Of any number of probes at most as many as there are calls are drawn from, so what one task numbers is bounded by ``calls``.
    """
    spark = probes.sparkSession
    counts, bound, operation = allocate(calls), 0, F.lit(None).cast("string")
    for name, n in counts.items():
        bound += n
        operation = F.when(operation.isNotNull(), operation).when(F.col("id") < bound, name)
    some = probes.select("probe").distinct().orderBy(F.xxhash64(F.lit(seed), "probe"), "probe").limit(calls)
    numbered = some.withColumn("no", F.row_number().over(Window.orderBy("probe")).cast("long") - 1)
    n = numbered.count()
    draw = lambda k: F.xxhash64(F.lit(seed), F.lit(k), "id")
    drawn = spark.range(calls).select(draw("order").alias("h"), "id", operation.alias("operation"), F.pmod(draw("probe"), F.lit(max(n, 1))).alias("no"))
    drawn = drawn.withColumn("seq", F.row_number().over(Window.orderBy("h", "id")).cast("long"))
    return drawn.join(numbered, "no", "left").select("seq", "operation", "probe")
