"""Target-distribution importance resampling by hashed n-gram features (DataFrame operations only).

1. A text's words are put into a table of positions (posexplode).  For orders above 1, window functions within a document
   put the words that follow beside each word, so a row holds the n-grams of all orders that begin there.
2. Each feature is hashed to a bucket.  Buckets are counted over the whole corpus and over the whole target; a bucket's
   gain is the logarithm of how much likelier it is in the target, smoothed by one of each bucket.
3. The gains, at most a row a bucket, are joined to the table of positions; a document's weight is their sum.  Both
   aggregations start before their shuffle, so what is shuffled is a row a bucket and task, and a row a document.
4. Scores are weights plus Gumbel noise that a hash of the id decides: the highest scores are a draw without replacement
   by weight.  Ranks come from one sort over as many partitions as it takes: rows within a partition are numbered, and
   the numbers of rows in the partitions before are added.

The positions of a document are cut to blocks of ``BLOCK`` words, each followed by the words that its last n-grams need,
so no window sees more, however long a text is.

Defined cases: a null or empty text, or one without words, has no features, weight 0 and can't be drawn; a null id is
hashed as an empty one and comes last among ties; repeated rows are documents of their own; an empty target gives each
bucket of the corpus the gain of a bucket that the target lacks; an empty table gives an empty table.  Only the id and
the text are read; other columns don't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, cut, stored

#: What separates words: ASCII but digits and letters.  A-Z are made small first.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000
#: Documents with fewer words aren't drawn; of the others so many of a hundred are.
LEAST_WORDS, PERCENT = 20, 10
SEED = "2024"
#: Words of a block of positions.
BLOCK = 4096
#: Up to so many buckets (16 bytes each) the gains are broadcast; up to so many partitions their offsets are.
FEW_GAINS, FEW_PARTS = 1_000_000, 50_000
#: Rows of a sorted partition are numbered from its number times this on.
_WIDE = 1 << 33
_UPPER = "".join(map(chr, range(65, 91)))


def words_of(text: Column) -> Column:
    """The words of a text, A-Z in lower case."""
    plain = F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower())
    return F.filter(F.split(plain, SEPARATORS), lambda w: w != "")


def features(texts: DataFrame, orders: int, buckets: int, *keep: str) -> DataFrame:
    """(keep..., bucket): a row for each n-gram of up to ``orders`` words of ``texts`` (row, text, keep...).

    A text without words has one row whose bucket is null.  ``row`` tells texts apart.
    """
    at = texts.withColumn("words", words_of(F.col("text")))
    if orders == 1:
        each = at.select(*keep, F.posexplode_outer("words").alias("pos", "w0"))
        grams = [F.col("w0")]
        return each.select(*keep, F.pmod(F.crc32(F.encode(grams[0], "UTF-8")), F.lit(buckets)).alias("bucket"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)), F.lit(BLOCK))
    blocks = F.transform(starts, lambda i: F.slice("words", i + 1, BLOCK + orders - 1))
    each = (
        at.select("row", *(k for k in keep if k != "row"), F.posexplode(blocks).alias("block", "part"))
        .select("row", *(k for k in keep if k != "row"), "block", F.posexplode_outer("part").alias("pos", "w0"))
    )
    following = Window.partitionBy("row", "block").orderBy("pos")
    each = each.withColumns({f"w{k}": F.lead("w0", k).over(following) for k in range(1, orders)}).filter(
        F.col("pos").isNull() | (F.col("pos") < BLOCK)
    )
    grams = [
        F.when(F.col(f"w{n}").isNotNull(), F.concat_ws(" ", *(f"w{k}" for k in range(n + 1)))) for n in range(orders)
    ]
    listed = F.filter(F.array(*grams), lambda g: g.isNotNull())
    return each.select(*keep, F.explode_outer(listed).alias("gram")).select(
        *keep, F.pmod(F.crc32(F.encode("gram", "UTF-8")), F.lit(buckets)).alias("bucket")
    )


def _counts(texts: DataFrame, orders: int, buckets: int, name: str) -> DataFrame:
    return features(texts, orders, buckets).filter("bucket is not null").groupBy("bucket").agg(F.count("*").alias(name))


def gains(docs: DataFrame, target: DataFrame, orders: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of all buckets that ``docs`` (row, text) has, given the texts of ``target`` (row, text)."""
    have, want = cut(_counts(docs, orders, buckets, "s")), cut(_counts(target, orders, buckets, "t"))
    real = lambda c: F.col(c).cast("double")
    both = have.join(want, "bucket", "left").fillna(0, ["t"])
    sizes = have.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("all_s")).crossJoin(
        want.agg(F.coalesce(F.sum("t"), F.lit(0)).alias("all_t"))
    )
    ratio = (real("t") + 1) * (real("all_s") + buckets) / ((real("s") + 1) * (real("all_t") + buckets))
    # one row of sums beside at most a row a bucket
    return both.crossJoin(F.broadcast(sizes)).select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def noise(id_col: Column, seed: str = SEED) -> Column:
    """A Gumbel draw in thousandths, decided by the id."""
    told = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(told, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def weights(
    docs: DataFrame, target: DataFrame, orders: int = 1, buckets: int = BUCKETS, seed: str = SEED,
    id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text",
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_features, weight, score."""
    df = columns(docs, doc_id=id_col, text=text_col).withColumn("row", F.monotonically_increasing_id())
    wanted = columns(target, text=target_text_col).withColumn("row", F.monotonically_increasing_id())
    table = gains(df, wanted, orders, buckets)
    if buckets <= FEW_GAINS:
        table = F.broadcast(table)
    n_words = F.count("bucket") if orders == 1 else F.max("n_words")
    texts = df if orders == 1 else df.withColumn("n_words", F.size(words_of(F.col("text"))).cast("long"))
    keep = ("row", "doc_id") if orders == 1 else ("row", "doc_id", "n_words")
    summed = (
        features(texts, orders, buckets, *keep)
        .join(table, "bucket", "left")
        .groupBy("row")
        .agg(
            F.any_value("doc_id").alias("doc_id"), n_words.alias("n_words"), F.count("bucket").alias("n_features"),
            F.coalesce(F.sum("gain"), F.lit(0)).alias("weight"),
        )
    )
    return summed.select("doc_id", "n_words", "n_features", "weight", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score"))


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` with rank 1, 2, 3... in that order, without a task that sees them all; equal rows in the order they are read."""
    df = stored(
        rows.withColumn("_at", F.monotonically_increasing_id()).orderBy(*order, "_at").withColumn("_at", F.monotonically_increasing_id())
    ).withColumn("_part", F.floor(F.col("_at") / _WIDE))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    each = cut(
        df.groupBy("_part").agg(F.count("*").alias("n"), F.min("_at").alias("first"))
        .select("_part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first") + 1).alias("_before"))
    )
    if each.count() <= FEW_PARTS:
        each = F.broadcast(each)
    return df.join(each, "_part").withColumn("rank", F.col("_at") + F.col("_before")).drop("_at", "_part", "_before")


def resample(
    docs: DataFrame, target: DataFrame, orders: int = 1, buckets: int = BUCKETS, percent: int = PERCENT,
    least_words: int = LEAST_WORDS, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text",
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_features, weight, score, and rank among the rows drawn (null: not drawn).

    Of the N rows with ``least_words`` words or more, floor(percent * N / 100) are drawn: the highest scores, ties to
    the smaller id.
    """
    scored = stored(weights(docs, target, orders, buckets, seed, id_col, text_col, target_text_col))
    long_enough = F.col("n_words") >= least_words
    drawn = percent * scored.filter(long_enough).count() // 100
    placed = ranked(scored.filter(long_enough), F.desc("score"), F.asc_nulls_last("doc_id"))
    rank = F.when(F.col("rank") <= drawn, F.col("rank"))
    names = ["doc_id", "n_words", "n_features", "weight", "score"]
    return placed.select(*names, rank.alias("rank")).union(
        scored.filter(~long_enough).select(*names, F.lit(None).cast("long").alias("rank"))
    )
