"""Mixing sources to target weights by systematic sampling (DataFrame operations only).

Sources in the order of their code points, null last, weigh 1, 2, 3, 1, 2, 3, ... and share the size of the whole
corpus by weight; no target exceeds ``MOST`` times its source's size, and what is above goes to the others by weight
(in closed form: the one level at which all min(cap, weight * level) sum to the whole).

A source's documents, smallest first, each expect target / source_size copies.  The expected copies are summed up
along the source, one random offset is added, and a document is taken once for each integer between the sum before it
and the sum behind it.  All documents of a source expect equally many, so the sum before a document is its rank times
that rate; smallest first, the words taken differ from the target by less than about the largest document.

Ranks come without a task that sees a whole source: the table is sorted once by source, size and a hash, over as many
partitions as it takes (equal keys are told apart by where they were read, so no key is too hot), and written; each
partition's rows of a source are counted, and the counts are summed up over partitions.  The offset is a hash of seed and
source, so reruns agree.  With ``offsets`` above 1 (off by default: it is no longer one random offset), a source uses the one
of so many at equal distances that brings its words nearest to its target, which helps sources of a few documents.

The sources themselves, a row of three numbers each, are ranked and weighed in one task.

Defined cases: a null text has size 0; documents of size 0 take part and take no words; null is a source of its own
(the last); repeated rows are documents of their own; null ids are ids like others; an empty table gives an empty
table.  Other columns don't clash, and ``mix`` returns all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, columns, cut, fresh, stored

#: No target is above so many times its source's size, and no document is taken more often.
MOST = 3
#: Up to so many (partition, source) pairs, a row of some 60 bytes each, are broadcast; beyond, they are joined by a shuffle.
FEW = 50_000
#: Rows of a sorted partition are numbered from its number times this on.
_WIDE = 1 << 33


def targets(cells: DataFrame) -> DataFrame:
    """Per source (no, src): source_size and target, from counts n of (no, src, size)."""
    by_name, every = Window.orderBy("no", "src"), Window.partitionBy()
    by_level = Window.orderBy("level", "no", "src").rowsBetween(Window.unboundedPreceding, -1)
    s = (
        cells.groupBy("no", "src")
        .agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
        .withColumn("weight", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("double"))
        .withColumn("cap", (MOST * F.col("source_size")).cast("double"))
        .withColumn("level", F.col("cap") / F.col("weight"))
        .withColumn("all_size", F.sum("source_size").over(every).cast("double"))
        .withColumn("all_weight", F.sum("weight").over(every))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(by_level), F.lit(0.0)))
        .withColumn("weight_before", F.coalesce(F.sum("weight").over(by_level), F.lit(0.0)))
        .withColumn("share", (F.col("all_size") - F.col("cap_before")) / (F.col("all_weight") - F.col("weight_before")))
        # the first source, by level, that its share leaves below its cap sets the share of all behind it
        .withColumn("free", F.when(F.col("share") <= F.col("level"), F.col("share")))
        .withColumn("share", F.min(F.struct(F.col("free").isNull(), F.col("level"), F.col("free"))).over(every)["free"])
    )
    return s.select(
        "no", "src", "source_size",
        F.least(F.col("cap"), F.coalesce(F.col("weight") * F.col("share"), F.col("cap"))).alias("target"),
    )


def _copies(offset: Column) -> Column:
    """How many integers lie between the sums before and behind a row."""
    behind, before = (F.floor(r * F.col("rate") + offset) for r in (F.col("rank") + 1, F.col("rank")))
    return F.least(behind - before, F.lit(MOST)).cast("long")


def _drawn(df: DataFrame, words: Column, text_hash: Column, seed: int, offsets: int, id_col: str, source_col: str) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with a source's size and target, how often a row is taken, and the names of these columns."""
    no, src, size, h, at, part = fresh(df, "_no", "_src", "_size", "_h", "_at", "_part")
    q = lambda c: F.col(f"`{c}`")
    first_key = [F.col(no), F.col(src), F.col(size), F.col(h)]
    rows = stored(
        df.withColumns({
            no: F.when(q(source_col).isNull(), 1).otherwise(0),
            src: F.coalesce(q(source_col).cast("string"), F.lit("")),
            size: F.coalesce(words, F.lit(0)).cast("long"),
            h: F.xxhash64(q(id_col), text_hash),
            at: F.monotonically_increasing_id(),
        })
        .orderBy(*first_key, F.col(at))
        .withColumn(at, F.monotonically_increasing_id())
    ).withColumn(part, F.floor(F.col(at) / _WIDE))
    each = rows.groupBy(F.col(part).alias("part"), F.col(no).alias("no"), F.col(src).alias("src")).agg(
        F.count("*").alias("n"), F.min(at).alias("first"), F.sum(size).alias("words")
    )
    before = Window.partitionBy("no", "src").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    each = cut(each.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = F.pmod(F.xxhash64(F.lit(seed), "no", "src"), F.lit(1 << 52)) / F.lit(float(1 << 52))
    sources = targets(each.select("no", "src", F.col("words").alias("size"), F.lit(1).alias("n"))).withColumn("rate", rate).withColumn("offset", offset)
    names = dict(zip(("part", "no", "src", "before", "source_size", "target", "rate", "offset"), fresh(rows, "_p", "_n", "_s", "_before", "_source_size", "_target", "_rate", "_offset")))
    table = cut(each.join(sources, ["no", "src"]).select(*names))
    if table.count() <= FEW:
        table = F.broadcast(table)
    table = table.toDF(*names.values())
    here = [F.col(a) == F.col(names[b]) for a, b in ((part, "part"), (no, "no"), (src, "src"))]
    placed = rows.join(table, here[0] & here[1] & here[2])
    rank = F.col(at) + F.col(names["before"])

    def copies(u):
        behind, start = (F.floor(r * F.col(names["rate"]) + u) for r in (rank + 1, rank))
        return F.least(behind - start, F.lit(MOST)).cast("long")

    u = F.col(names["offset"])
    if offsets > 1:
        tried = [F.pmod(F.col(names["offset"]) + k / offsets, F.lit(1.0)) for k in range(offsets)]
        words = placed.groupBy(no, src).agg(
            F.first(names["target"]).alias("t"), F.first(names["offset"]).alias(names["offset"]),
            *(F.sum(copies(x) * F.col(size)).alias(f"w{k}") for k, x in enumerate(tried)),
        )
        best = F.array_min(F.array(*(F.struct(F.abs(F.col(f"w{k}") - F.col("t")), x) for k, x in enumerate(tried))))["col2"]
        best = cut(words.select(F.col(no).alias("_o"), F.col(src).alias("_c"), best.alias("_best")))
        best_name, o, c = fresh(placed, "_best", "_o", "_c")
        placed = placed.join(best.toDF(o, c, best_name), (F.col(no) == F.col(o)) & (F.col(src) == F.col(c)))
        u = F.col(best_name)
    (taken,) = fresh(placed, "_copies")
    return placed.withColumn(taken, copies(u)), names | {"size": size, "copies": taken, "no": no, "src": src}


def mix_plan(
    docs: DataFrame, seed: int = 17, offsets: int = 1, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """Per row of ``docs``: doc_id, source, size, source_size, target, copies (how often it is taken), taken (words)."""
    df = columns(docs, doc_id=id_col, text=text_col, source=source_col)
    # the texts are only counted and hashed: they don't go through the sort
    slim = df.select(
        "doc_id", "source", F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"), F.xxhash64("text").alias("text_hash"),
    )
    drawn, of = _drawn(slim, F.col("words"), F.col("text_hash"), seed, offsets, "doc_id", "source")
    copies = F.col(of["copies"])
    return drawn.select(
        "doc_id", F.when(F.col(of["no"]) == 0, F.col(of["src"])).alias("source"), F.col(of["size"]).alias("size"),
        F.col(of["source_size"]).alias("source_size"), F.col(of["target"]).alias("target"), copies.alias("copies"),
        (copies * F.col(of["size"])).alias("taken"),
    )


def mix(
    docs: DataFrame, seed: int = 17, offsets: int = 1, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """The mix itself: each row of ``docs``, all columns as they are, as often as it is taken."""
    text = F.col(f"`{text_col}`")
    drawn, of = _drawn(docs, F.regexp_count(text, F.lit(WORD)), F.xxhash64(text), seed, offsets, id_col, source_col)
    (one,) = fresh(drawn, "_one")
    return drawn.filter(F.col(of["copies"]) > 0).withColumn(one, F.explode(F.array_repeat(F.lit(1), F.col(of["copies"]).cast("int")))).select(
        *(F.col(f"`{c}`") for c in docs.columns)
    )
