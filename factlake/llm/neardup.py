"""Near-duplicates by bottom-k sketches of one hash function, exact at the end.

1. Each text gives the set of its distinct 5-word shingles as 64-bit hashes and, sorted, the ``k`` least of them: its
   sketch.  Texts with equal sets are one class; the class's smallest id stands for it from here on.
2. Two sets with similarity of ``s`` or more share, of the k least values of their union, about s * k, and those are in
   both sketches.  So linked sketches share ``least_shared(n)`` values or more: the exact bound where the sketches are
   the whole sets, else a bound that a linked pair misses with a probability below 1e-9.  Of two sketches that share
   c values, the |sketch| - c + 1 rarest of each, in one order, have one in common: only these go to inverted lists,
   so words and passages that many texts hold make no lists unless they make up most of a text.
3. A list of more than ``CROWD`` sketches says little: its members, and only they, are indexed again by their whole sets,
   whose bound is exact and tight.  A text a quarter of which no other of them has makes no list at all there.
4. In each list, every member is held against one, the list's head.  Confirmed links give components.  While members
   outside the largest components could make many pairs, they are held against another head, a member of the list's
   largest component, as long as that brings them down; then what is left is held against all members of other components.  No list emits all its
   pairs, and none is capped.
5. A pair goes on if its sizes allow the similarity and if the union sketch's estimate reaches the bound of step 2;
   then the exact similarity of the full sets decides; a worker makes a hub's set once for the pairs that follow each other.
6. Links are closed to components by passing least labels along and doubling; nothing is collected.

``CROWD``, ``MEETINGS`` and the rate at which further heads stop decide which pairs are tried first and by which index; the
links that are found don't depend on them, and tests run with other values.  Where rows meet under a key that may be hot
(a class, a head, a list, a component), one side of the join is a written table with a row a key, so that adaptive execution
can split the other; all aggregations start before their shuffle.

Defined cases: a null or empty text, or one without words, has the empty set and is linked with nothing.  A null id
can't be linked: its component is null and it is kept.  Repeated rows are returned each; if one id has several texts,
they are linked.  Rows of one id are one document; ``keep_first`` keeps one
of them.  An empty
table gives an empty table.  Other columns don't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns, cut, forget, fresh, shingle_hashes, stored, word_hashes

#: Similarity from which two documents are linked: NUM / DEN.
NUM, DEN = 75, 100
#: Values of a sketch.
K = 64
#: Of K values of a union with 0.75 or more of them shared, fewer are in both sketches with probability < 1e-9.
SURE = 25
#: Longer lists of sketches are replaced by lists of whole sets.
CROWD = 64
#: Further heads are tried while a list entry would meet more than so many others on average.
MEETINGS = 2


def _set(text: str | None, k: int) -> np.ndarray:
    return (shingle_hashes(word_hashes((text or "").encode()), k) >> np.uint64(1)).astype(np.int64)


def sketches(docs: DataFrame, shingle: int = 5, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, sig (128 bits of the whole set, null if empty), sketch (ascending)."""
    df = columns(docs, doc_id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, sigs, least = [], [], []
            for text in b.column(1):
                s = np.unique(_set(text.as_py(), shingle))
                sizes.append(len(s))
                sigs.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                least.append(s[:k])
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in least])]).astype(np.int32)
            values = pa.array(np.concatenate(least) if least else np.empty(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)],
                names=["doc_id", "n_shingles", "sig", "sketch"],
            )

    kind = dict(df.dtypes)["doc_id"]
    return df.mapInArrow(run, f"doc_id {kind}, n_shingles bigint, sig binary, sketch array<bigint>")


def _least_shared(n: Column) -> Column:
    """How many sketch values a set of n shingles has in common with any it is linked to."""
    exact = F.ceil(n * NUM / DEN)
    return F.when(n * DEN <= K * NUM, exact).otherwise(F.lit(SURE)).cast("int")


def _indexed(sets: DataFrame, size: Column, least: Column) -> DataFrame:
    """Inverted lists (v, rep, n, place) of sets (rep, key, n, sketch): of each the values, rarest first, that a linked set,
    which shares at least so many of the size, can't all miss."""
    values = sets.select("rep", "key", "n", F.explode("sketch").alias("v"))
    common = values.groupBy("v").agg(F.count("*").alias("df")).filter("df > 1")
    mine = (
        values.join(common, "v")
        .groupBy("rep", "key", "n")
        .agg(F.array_sort(F.collect_list(F.struct("df", "v"))).alias("vs"))
    )
    # values that no other set has come first in the order and make no lists
    room = size - least + 1 - (size - F.size("vs"))
    return (
        mine.filter(room > 0)
        .select("rep", "n", (size - F.size("vs")).alias("alone"), F.posexplode(F.slice("vs", 1, F.greatest(room, F.lit(1)))).alias("at", "x"))
        .select(F.col("x.v").alias("v"), "rep", "n", (F.col("alone") + F.col("at")).alias("place"))
    )


def _lists(reps: DataFrame, docs: DataFrame, shingle: int) -> tuple[DataFrame, DataFrame]:
    """All inverted lists (v, rep, n, place), and the texts (rep, text) of those in them.

    The place is that of the value among all values of a whole set, from 0; it is null in lists of sketches.
    """
    by_sketch = cut(_indexed(reps, F.least(F.col("n"), F.lit(K)).cast("int"), _least_shared(F.col("n"))))
    texts = cut(docs.join(by_sketch.select("rep").distinct(), "rep", "left_semi"))
    sizes = by_sketch.groupBy("v").agg(F.count("*").alias("size")).filter("size > 1")
    listed = by_sketch.join(sizes, "v")
    crowd = listed.filter(F.col("size") > CROWD).select("rep").distinct()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(_set(t.as_py(), shingle)) for t in b.column(1)]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
            values = pa.array(np.concatenate(sets) if sets else np.empty(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)], names=["rep", "sketch"])

    kind = dict(docs.dtypes)["rep"]
    sets = (
        texts.join(crowd, "rep", "left_semi")
        .select("rep", "text")
        .mapInArrow(whole, f"rep {kind}, sketch array<bigint>")
        .select("rep", F.xxhash64("sketch").alias("key"), F.size("sketch").cast("long").alias("n"), "sketch")
        .filter("n > 0")
    )
    exact = F.ceil(F.col("n") * NUM / DEN).cast("int")
    by_set = _indexed(sets, F.col("n").cast("int"), exact)
    plain = listed.filter(F.col("size") <= CROWD)
    return cut(
        plain.select(F.struct(F.lit(0).alias("by"), "v").alias("v"), "rep", "n", F.lit(None).cast("int").alias("place")).union(
            by_set.select(F.struct(F.lit(1).alias("by"), "v").alias("v"), "rep", "n", "place")
        )
    ), texts


def _could_link(n_a: Column, n_b: Column) -> Column:
    return DEN * F.least(n_a, n_b) >= NUM * F.greatest(n_a, n_b)


def _confirm(pairs: DataFrame, reps: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough: first by the sketches of their unions, then exactly."""
    one = lambda p: reps.select(F.col("rep").alias(p), F.col("sketch").alias(f"s{p}"), F.col("n").alias(f"n{p}"))
    union = F.array_sort(F.array_union("sa", "sb"))
    likely = (
        pairs.join(one("a"), "a")
        .join(one("b"), "b")
        .filter(_could_link(F.col("na"), F.col("nb")))
        .withColumn("u", F.slice(union, 1, K))
        .withColumn("shared", F.size(F.array_intersect(F.array_intersect("sa", "sb"), F.col("u"))))
        .filter(
            F.when((F.col("na") <= K) & (F.col("nb") <= K) & (F.size(F.array_union("sa", "sb")) <= K), DEN * F.col("shared") >= NUM * F.size("u"))
            .otherwise(F.col("shared") >= SURE)
        )
        .select("a", "b")
        .distinct()
    )
    # a hub is the lesser end of its pairs, nearly always: its text joins last, so it isn't dealt out again with each member
    both = likely.join(texts.select(F.col("rep").alias("b"), F.col("text").alias("tb")), "b").join(
        texts.select(F.col("rep").alias("a"), F.col("text").alias("ta")), "a"
    )
    kind = dict(pairs.dtypes)["a"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, np.empty(0, np.int64)  # of a, whose pairs come one after the other
        for batch in batches:
            ok = []
            for a, x, y in zip(batch.column(0), batch.column(2), batch.column(3)):
                if a != last:
                    last, held = a, np.unique(_set(x.as_py(), shingle))
                s = np.unique(_set(y.as_py(), shingle))
                shared = len(np.intersect1d(held, s, assume_unique=True))
                ok.append(DEN * shared >= NUM * (len(held) + len(s) - shared))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return both.select("a", "b", "ta", "tb").mapInArrow(run, f"a {kind}, b {kind}").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label): label the least node that is reachable along edges (a, b); for every node of an edge."""
    e = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    new = stored(e.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
    while True:
        was, labels = new, new.select("node", "label")
        near = (
            e.join(labels.select(F.col("node").alias("b"), "label"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        low = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        ahead = labels.select(F.col("node").alias("label"), F.col("label").alias("ahead"))
        new = stored(
            low.join(ahead, "label").select("node", "was", F.least("label", "ahead").alias("label"))
        )
        forget(was)
        if new.filter("label < was").isEmpty():
            forget(e)
            return new.select("node", "label")


def _heads(lists: DataFrame) -> DataFrame:
    """Each member of a list with the list's head, its least id."""
    head = stored(lists.groupBy("v").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).filter("a < z").select("v", "a"))
    return lists.join(head, "v").filter("a < rep").select("a", F.col("rep").alias("b")).distinct()


def _apart(lists: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the lists with several components: their entries (v, rep, n, label), and per list its largest component,
    how many entries are outside it, and how many there are."""
    own = lists.join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left").withColumn(
        "label", F.coalesce("label", "rep")
    )
    parts = own.groupBy("v", "label").agg(F.count("*").alias("m"))
    tops = stored(
        parts.groupBy("v")
        .agg(F.max(F.struct("m", "label")).alias("top"), F.sum("m").alias("size"), F.count("*").alias("parts"))
        .filter("parts > 1")
        .select("v", F.col("top.label").alias("top"), (F.col("size") - F.col("top.m")).alias("outside"), "size")
    )
    return own.join(tops.select("v", "top"), "v"), tops


def _across(entries: DataFrame) -> DataFrame:
    """Members of a list that are in different components, but for pairs within the list's largest.

    Where whole sets have their first common value, they share one value and at most as many as follow in either; that
    must be enough for their sizes.  A pair that could be linked passes at that value, whatever it does at others.
    """
    rest = entries.filter("label <> top").select(
        "v", F.col("rep").alias("x"), F.col("label").alias("lx"), F.col("n").alias("nx"), F.col("place").alias("px")
    )
    left = F.least(F.col("nx") - F.col("px"), F.col("n") - F.col("place"))
    enough = F.coalesce((NUM + DEN) * left >= NUM * (F.col("nx") + F.col("n")), F.lit(True))
    met = rest.join(entries.select("v", "rep", "label", "n", "place"), "v").filter(
        (F.col("lx") != F.col("label")) & _could_link(F.col("nx"), F.col("n")) & enough
    )
    return met.select(F.least("x", "rep").alias("a"), F.greatest("x", "rep").alias("b")).distinct()


def _next_heads(entries: DataFrame, turn: int) -> DataFrame:
    """Each member outside its list's largest component with a member of that component, another one each turn."""
    draw = F.struct(F.xxhash64("rep", F.lit(turn)).alias("h"), F.col("rep"))
    heads = stored(entries.filter("label = top").groupBy("v").agg(F.min(draw)["rep"].alias("head")))
    met = entries.filter("label <> top").join(heads, "v")
    return met.select(F.least("rep", "head").alias("a"), F.greatest("rep", "head").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (the least linked id) and kept (it is that id)."""
    base = cut(sketches(docs, shingle, id_col=id_col, text_col=text_col))
    sets = base.filter("doc_id is not null and sig is not null")
    # members of a class have equal sets, so any of them has its sketch
    reps = cut(
        sets.groupBy("sig")
        .agg(F.min("doc_id").alias("rep"), F.any_value("n_shingles").alias("n"), F.any_value("sketch").alias("sketch"))
        .select("sig", "rep", F.xxhash64("sig").alias("key"), "n", "sketch")
    )
    lists, texts = _lists(reps, columns(docs, rep=id_col, text=text_col), shingle)
    tried = cut(_heads(lists))
    links = cut(_confirm(tried, reps, texts, shingle))
    labels = components(links)
    before = None
    while True:
        entries, tops = _apart(lists, labels)
        entries = cut(entries)
        load = tops.agg(F.sum("size").alias("rows"), F.sum(F.col("outside") * F.col("size")).alias("pairs")).first()
        if not load["rows"]:
            break
        # another head is worth its round while heads bring the rest down
        last = load["pairs"] <= MEETINGS * load["rows"] or (before is not None and 10 * load["pairs"] > 7 * before)
        pairs = cut((_across(entries) if last else _next_heads(entries, load["pairs"])).join(tried, ["a", "b"], "left_anti"))
        links = links.union(cut(_confirm(pairs, reps, texts, shingle)))
        if last:
            break
        tried, before = tried.union(pairs), load["pairs"]
        labels = components(links)
    # one id with several sets
    of_id = sets.select("doc_id", "sig").distinct()
    several = stored(of_id.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"))
    if not several.isEmpty():
        mine = stored(of_id.join(several, "doc_id").join(reps.select("sig", "rep"), "sig").select("doc_id", "rep"))
        least = stored(mine.groupBy("doc_id").agg(F.min("rep").alias("a")))
        links = links.union(mine.join(least, "doc_id").filter("a < rep").select("a", F.col("rep").alias("b")))
    labels = components(links)
    label_of_class = stored(
        reps.select("sig", "rep").join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left").select("sig", F.coalesce("label", "rep").alias("label"))
    )
    of_doc = stored(sets.select("doc_id", "sig").join(label_of_class, "sig").groupBy("doc_id").agg(F.min("label").alias("component")))
    component = F.coalesce("component", "doc_id")
    return base.select("doc_id", "n_shingles").join(of_doc, "doc_id", "left").select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def keep_first(docs: DataFrame, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near-duplicates, all columns as they are; of several rows of its id any one.

    Rows with a null id can't be told to be one document and all stay.
    """
    no, rows = fresh(docs, "_no", "_rows")
    found = near_duplicates(docs, shingle, id_col, text_col).filter("doc_id is not null")
    said = stored(found.groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("n")).filter("not kept or n > 1").toDF(no, "kept", rows).withColumn(rows, F.when(F.col("kept"), F.col(rows))).select(no, rows))
    own = F.col(f"`{id_col}`")
    once = docs.join(said, own == F.col(no), "left_anti")
    several = said.filter(F.col(rows).isNotNull())
    if several.isEmpty():
        return once
    # an id that many rows have: any one row of each, by an aggregation that starts before the shuffle
    row = F.any_value(F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns))))
    again = docs.join(several.select(no), own == F.col(no), "left_semi").groupBy(own.alias(no)).agg(row.alias("row"))
    return once.union(again.select(*(F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns))))
