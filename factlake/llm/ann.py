"""Approximate nearest neighbours by inner product: a hierarchical k-means tree, best bin first.

The tree is fitted on a bounded sample (``SAMPLE`` vectors, the least hashes of their ids), and a node is split, into as many
parts as it takes up to ``FAN``, while it stands for more than ``LEAF`` rows of the table and holds enough of the sample: the
number of leaves grows with the table up to about ``SAMPLE`` / 16, and so does what a query can pass by.  Every vector is
indexed: it goes down to the nearest centre at each level and so to one leaf.  A query visits leaves in the order in which a
priority queue hands them out: a node's key is the query's inner product with its centre plus the query's norm times the
node's radius over the sample, scaled by ``SLACK`` (a bound at 1, the centre's own score at 0).  How many leaves are
visited is calibrated: ``CALIBRATION`` queries are answered exactly, by scanning all vectors in blocks, and visits are
widened until the tree's answers reach ``RECALL`` of the exact ones.

Neighbouring leaves are packed into bins of about ``PIECE`` rows, and a leaf of more is split into pieces, so a vector that is a
third of all rows fills many bins.  A query goes once to each bin that holds a leaf of its visits, is held there against the
rows of these leaves and no others, and keeps its ``k`` best; the last step ranks those.  The broadcast tree is bounded by
the sample.  What is left of the work is what the visits leave: on vectors without structure (any direction as likely as any
other) a query has to visit some half of all leaves for such a recall, so work is then quadratic if queries grow with rows.

Scores are inner products of the original vectors in double precision, summed in the same order for each row, so equal
vectors score equally and ties go to the smaller id.

Defined cases: vectors that are null, zero, of another length than most (ties: the shorter), or that hold a null or a
non-finite component take no part, nor do null ids.  Repeated rows count once: of an id with several vectors the first,
by its components, is taken.  Fewer than k candidates: all of them.  An empty table gives an empty table.  Other columns
don't clash.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, cut

SAMPLE = 50_000
FAN = 8
#: Rows of the table that a leaf should hold, and rows of the sample that a leaf holds on average at least.
LEAF, LEAST = 64, 16
CALIBRATION = 200
RECALL = 0.97
SLACK = 0.25
#: Rows that one bin holds at most.
PIECE = 4_000
#: Queries that one bin meets in one go at most (about); more are dealt into slices.
SLICE = 8_000


class Tree:
    """Nodes with centre, radius and children; leaves are numbered so that those of a node are neighbours."""

    def __init__(self, sample: np.ndarray, rows: int | None = None, seed: int = 7) -> None:
        each = (rows or len(sample)) / max(1, len(sample))  # rows of the table for one of the sample
        centres, radii, self.children = [], [], []
        rng = np.random.default_rng(seed)
        self.leaves: list[int] = []
        todo = [(sample, None)]
        while todo:
            part, parent = todo.pop()
            node = len(centres)
            if parent is not None:
                self.children[parent].append(node)
            self.children.append([])
            centre = part.mean(0) if len(part) else np.zeros(sample.shape[1])
            centres.append(centre)
            radii.append(float(np.sqrt(((part - centre) ** 2).sum(1).max())) if len(part) else 0.0)
            fan = int(min(FAN, np.ceil(len(part) * each / LEAF), len(part) // LEAST))
            parts = self._split(part, fan, rng) if fan > 1 else []
            if len(parts) > 1:
                todo += [(p, node) for p in parts]
            else:
                self.leaves.append(node)
        self.centres, self.radii = np.array(centres), np.array(radii)
        self.number = {n: i for i, n in enumerate(self.leaves)}

    @staticmethod
    def _split(rows: np.ndarray, fan: int, rng: np.random.Generator) -> list[np.ndarray]:
        distinct = np.unique(rows, axis=0)
        centres = distinct[rng.choice(len(distinct), min(fan, len(distinct)), replace=False)]
        for _ in range(8):
            near = Tree._nearest(rows, centres)
            centres = np.array([rows[near == j].mean(0) if (near == j).any() else c for j, c in enumerate(centres)])
        near = Tree._nearest(rows, centres)
        return [rows[near == j] for j in range(len(centres)) if (near == j).any()]

    @staticmethod
    def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
        return ((centres**2).sum(1) - 2 * rows @ centres.T).argmin(1)

    def place(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        out = np.zeros(len(rows), dtype=np.int64)
        todo = [(0, np.arange(len(rows)))]
        while todo:
            node, at = todo.pop()
            kids = self.children[node]
            if not kids:
                out[at] = self.number[node]
            elif len(at):
                near = self._nearest(rows[at], self.centres[kids])
                todo += [(c, at[near == j]) for j, c in enumerate(kids)]
        return out

    def best_first(self, query: np.ndarray, slack: float = SLACK) -> Iterator[int]:
        """Leaves in the order in which the queue hands them out."""
        key = (-(self.centres @ query + slack * float(np.sqrt(query @ query)) * self.radii)).tolist()
        queue = [(key[0], 0)]
        while queue:
            _, node = heapq.heappop(queue)
            kids = self.children[node]
            if not kids:
                yield self.number[node]
            for c in kids:
                heapq.heappush(queue, (key[c], c))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _tops(ids: np.ndarray, rows: np.ndarray, qids: np.ndarray, qs: np.ndarray, k: int, open_: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each query the indices of its k best rows, exactly scored, and the scores; its own row is no candidate.

    ``open_``: for each query, which rows it may meet.
    """
    for at in range(0, len(qids), 256):
        q, of = qs[at : at + 256], qids[at : at + 256]
        rough = q @ rows.T
        rough[of[:, None] == ids] = -np.inf
        if open_ is not None:
            rough[~open_[at : at + 256]] = -np.inf
        if len(ids) > 4 * k:
            edge = np.partition(rough, len(ids) - k, axis=1)[:, len(ids) - k]
            # rounding of the product differs from the exact score by far less than the margin
            near = (rough >= (edge - 1e-9 * np.maximum(1.0, np.abs(edge)))[:, None]) & np.isfinite(rough)
        else:
            near = np.isfinite(rough)
        for j in range(len(q)):
            there = np.flatnonzero(near[j])
            score = (rows[there] * q[j]).sum(1)
            best = np.lexsort((ids[there], -score))[:k]
            yield there[best], score[best]


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and v (double array) of the rows that take part, one for each id."""
    v = columns(vectors, vec_id=id_col, v=vector_col).select("vec_id", F.col("v").cast("array<double>").alias("v"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    v = v.filter(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
        & F.forall("v", finite) & F.exists("v", lambda x: x != 0)
    )
    return v.groupBy("vec_id").agg(F.min("v").alias("v"))


def _bins(sizes: list[int]) -> tuple[list[int], list[int]]:
    """Per leaf its first bin and in how many pieces it is dealt: neighbours share a bin while they fit."""
    first, pieces, now, held = [], [], 0, 0
    for n in sizes:
        if held and held + n > PIECE:
            now, held = now + 1, 0
        first.append(now)
        pieces.append(max(1, -(-n // PIECE)))
        held += n
        if pieces[-1] > 1:  # bins of its own
            now, held = now + pieces[-1], 0
    return first, pieces


def search(
    vectors: DataFrame, every: int = 20, k: int = 20, recall: float = RECALL,
    id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE, calibration: int = CALIBRATION,
) -> DataFrame:
    """For each usable row whose id is divisible by ``every``: query_id, rank, vec_id, score of its k nearest found."""
    spark = vectors.sparkSession
    empty = "query_id long, rank int, vec_id long, score double"
    v = cut(usable(vectors, id_col, vector_col))
    lengths = v.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], empty)
    dim = lengths[0]["dim"]
    v = v.filter(F.size("v") == dim).select(F.col("vec_id").cast("long").alias("vec_id"), "v")
    fit = v.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow()
    rows = _matrix(fit.column("v").combine_chunks(), dim)
    tree = spark.sparkContext.broadcast(Tree(rows, sum(r["count"] for r in lengths if r["dim"] == dim)))
    queries = v.filter(F.col("vec_id") % every == 0)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf = tree.value.place(_matrix(b.column(1), dim))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(leaf, pa.int64())], names=["vec_id", "v", "leaf"])

    placed = cut(v.mapInArrow(place, "vec_id long, v array<double>, leaf long"))
    visits = _calibrate(placed, queries, tree.value, dim, k, recall, calibration)
    # a row a leaf: the bin in which its rows stand, or the first of several, and over how many they are dealt
    size = dict(placed.groupBy("leaf").agg(F.count("*")).collect())
    first_bin, pieces = _bins([size.get(i, 0) for i in range(len(tree.value.leaves))])
    table = spark.sparkContext.broadcast((first_bin, pieces))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, dealt = table.value
        for b in batches:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                ids, bins, leaves, row = [], [], [], []
                for n, (qid, q) in enumerate(zip(part.column(0).to_pylist(), _matrix(part.column(1), dim))):
                    wanted: dict[int, list[int]] = {}
                    for leaf in itertools.islice(tree.value.best_first(q), visits):
                        for j in range(dealt[leaf]):
                            wanted.setdefault(first[leaf] + j, []).append(leaf)
                    ids += [qid] * len(wanted)
                    row += [n] * len(wanted)
                    bins += wanted
                    leaves += wanted.values()
                at = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), part.column(1).take(at), pa.array(bins, pa.int64()), pa.array(leaves, pa.list_(pa.int64()))],
                    names=["query_id", "q", "bin", "leaves"],
                )

    asked = queries.select("vec_id", "v").mapInArrow(visit, "query_id long, q array<double>, bin long, leaves array<long>")
    # a bin's queries are dealt into slices by a hash; its rows go to each slice
    slices = max(1, -(-queries.count() // SLICE))
    asked = asked.withColumn("slice", F.pmod(F.xxhash64("query_id"), F.lit(slices)))
    parts = spark.createDataFrame([(i, f, n) for i, (f, n) in enumerate(zip(first_bin, pieces))], "leaf long, first long, pieces long")
    dealt = (
        placed.join(F.broadcast(parts), "leaf")
        .withColumn("bin", F.col("first") + F.pmod(F.xxhash64("vec_id"), "pieces"))
        .withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))))
    )

    def meet(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if left.num_rows and right.num_rows:
            ids, mine = left.column("vec_id").to_numpy(), _matrix(left.column("v").combine_chunks(), dim)
            leaf, which = np.unique(left.column("leaf").to_numpy(), return_inverse=True)
            qids, qs = right.column("query_id").to_numpy(), _matrix(right.column("q").combine_chunks(), dim)
            wanted = right.column("leaves").combine_chunks()
            for at in range(0, len(qids), 256):
                open_ = np.zeros((len(qids[at : at + 256]), len(leaf)), dtype=bool)
                for j in range(len(open_)):
                    open_[j, np.searchsorted(leaf, np.intersect1d(leaf, wanted[at + j].values.to_numpy()))] = True
                met = _tops(ids, mine, qids[at : at + 256], qs[at : at + 256], k, None if open_.all() else open_[:, which])
                for qid, (found, score) in zip(qids[at : at + 256], met):
                    out[0].append(np.full(len(found), qid))
                    out[1].append(ids[found])
                    out[2].append(score)
        join = lambda xs, kind: pa.array(np.concatenate(xs) if xs else np.empty(0), kind)
        return pa.table({"query_id": join(out[0], pa.int64()), "vec_id": join(out[1], pa.int64()), "score": join(out[2], pa.float64())})

    met = (
        dealt.select("bin", "slice", "vec_id", "v", "leaf").groupBy("bin", "slice")
        .cogroup(asked.select("bin", "slice", "query_id", "q", "leaves").groupBy("bin", "slice"))
        .applyInArrow(meet, "query_id long, vec_id long, score double")
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def exact(vectors: DataFrame, queries: list[tuple[int, list[float]]], dim: int, k: int) -> DataFrame:
    """The k nearest of a bounded list of queries among all rows (vec_id, v, leaf), scanned in blocks."""
    qs = vectors.sparkSession.sparkContext.broadcast(queries)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for b in batches:
            if not b.num_rows:
                continue
            ids, rows, leaf = b.column(0).to_numpy(), _matrix(b.column(1), dim), b.column(2).to_numpy()
            names = np.array([qid for qid, _ in qs.value], dtype=np.int64)
            for qid, (at, score) in zip(names.tolist(), _tops(ids, rows, names, np.array([q for _, q in qs.value]), k)):
                found, where = ids[at], leaf[at]
                if qid in kept:
                    found, score, where = (np.concatenate(x) for x in zip(kept[qid], (found, score, where)))
                    best = np.lexsort((found, -score))[:k]
                    found, score, where = found[best], score[best], where[best]
                kept[qid] = (found, score, where)
        for qid, (found, score, where) in kept.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(found), qid), pa.int64()), pa.array(found, pa.int64()), pa.array(score, pa.float64()), pa.array(where, pa.int64())],
                names=["query_id", "vec_id", "score", "leaf"],
            )

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        vectors.mapInArrow(scan, "query_id long, vec_id long, score double, leaf long")
        .withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    )


def _calibrate(placed: DataFrame, queries: DataFrame, tree: Tree, dim: int, k: int, recall: float, n: int) -> int:
    """How many leaves a query must visit: widened until ``recall`` of the exact answers of n queries are found."""
    asked = [(r["vec_id"], list(r["v"])) for r in queries.orderBy(F.xxhash64("vec_id", F.lit(1)), "vec_id").limit(n).collect()]
    if not asked:
        return 1
    place: dict[int, dict[int, int]] = {qid: {leaf: i for i, leaf in enumerate(tree.best_first(np.array(q)))} for qid, q in asked}
    truth = exact(placed, asked, dim, k).select("query_id", "leaf").collect()
    needed = np.array([place[r["query_id"]][r["leaf"]] for r in truth])
    visits = 1
    while visits < len(tree.leaves) and (needed < visits).mean() < recall:
        visits += 1
    return visits
