"""Spelling variants: words one edit apart, grouped under the commonest.

1. All runs of letters are counted; some are misspelt on purpose by a rule (``typo_one_in``), one code point left out.
2. Even-partition pigeonhole join.  A word is cut into two even parts.  One edit touches one of them, so a word of equal
   length, or one longer, that is one edit away holds the other at the same place: the first part at the start, the last
   at the end (which is shifted by one in a longer word).  Words are indexed by length and part, and probed by the parts
   that words of equal and of one less length would have.
3. A part that more than ``CROWD`` words hold says little: what is left of those words is cut evenly again, and again one
   of the two parts is untouched, so the key grows by it.  This goes on until lists are short or what is left is one
   letter, of which there are few.  No list is capped.
4. Candidates are verified by one edit within the join, and pairs that several keys found are made one.
5. A word's form is its commonest near word, if that is ``RATIO`` times as common; forms are followed to the root by
   doubling, in as many rounds as the logarithm of the longest way.

Defined cases: a null or empty text has no words; a null id is hashed as an empty one; repeated rows count each; a very
long run is one word; ties between forms go to the smaller word by code points; an empty table gives an empty table.
Only the id and the text are read; other columns don't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns, stored

RUN = r"[A-Za-zÀ-ÿ]+"
#: Words have so many code points and occurrences at least.
LEAST_LENGTH, LEAST_COUNT = 6, 5
#: One of so many runs loses a code point, by a hash.
TYPO_ONE_IN = 199
#: A form is so many times as common as its variant.
RATIO = 5
#: Longer lists are split by further parts.
CROWD = 48
_UPPER = "".join(map(chr, range(65, 91)))


def word_counts(
    docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, typo_one_in: int = TYPO_ONE_IN,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(word, n) of the words that are long and common enough; ``typo_one_in`` 0 leaves all runs as they are."""
    df = columns(docs, doc_id=id_col, text=text_col)
    small = F.translate("text", _UPPER, _UPPER.lower())
    runs = df.select("doc_id", F.explode(F.regexp_extract_all(small, F.lit(RUN), F.lit(0))).alias("run")).filter(
        F.char_length("run") >= least_length
    )
    word = F.col("run")
    if typo_one_in:
        told = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run"))
        runs = runs.withColumn("h", F.crc32(F.encode(told, "UTF-8")))
        at = (F.col("h") % F.char_length("run")).cast("int")
        short = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
        word = F.when(F.col("h") % typo_one_in == 0, short).otherwise(word)
    return (
        runs.select(word.alias("word")).filter(F.char_length("word") >= least_length)
        .groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)
    )


def _cut_evenly(rows: DataFrame, longer: Column) -> DataFrame:
    """Rows (key, role, longer, word, rest) with each of the two parts of ``rest`` added to the key and taken from it.

    ``longer`` is 1 where the words that are probed have one code point more; only they have it.
    """
    size = F.char_length("rest")
    short = size - F.when(F.col("role") == 1, longer).otherwise(F.lit(0))
    first, last = F.floor(short / 2).cast("int"), (short - F.floor(short / 2)).cast("int")
    part = lambda side, at, n, rest_at, rest_n: F.struct(
        F.concat_ws("\x00", "key", F.lit(side), short.cast("string"), F.substr("rest", at, n)).alias("key"),
        F.substr("rest", rest_at, rest_n).alias("rest"),
    )
    one = F.lit(1)
    parts = F.array(part("<", one, first, first + 1, size - first), part(">", size - last + 1, last, one, size - last))
    return rows.filter(short > 0).select("role", "longer", "word", F.explode(parts).alias("x")).select(
        F.col("x.key").alias("key"), "role", "longer", "word", F.col("x.rest").alias("rest")
    )


def near_pairs(words: DataFrame, crowd: int = CROWD) -> DataFrame:
    """The pairs (a, b) of ``words`` (word) that differ by one inserted, deleted or replaced code point, once each.

    Role 0 is indexed and role 1 probes; ``longer`` 0 pairs words of equal length, 1 those with one more.
    """
    sides = F.array(*(F.struct(F.lit(r).alias("role"), F.lit(d).alias("longer")) for r in (0, 1) for d in (0, 1)))
    rows = words.select(F.lit("").alias("key"), F.explode(sides).alias("s"), "word").select(
        F.concat("key", F.col("s.longer").cast("string")).alias("key"), F.col("s.role").alias("role"),
        F.col("s.longer").alias("longer"), "word", F.col("word").alias("rest"),
    )
    found = []
    while True:
        rows = stored(_cut_evenly(rows, F.col("longer")))
        # lists of both roles, and how long the longer of them is
        sizes = stored(
            rows.groupBy("key").agg(F.count_if(F.col("role") == 0).alias("a"), F.count_if(F.col("role") == 1).alias("b"), F.max(F.char_length("rest") - F.col("longer")).alias("left"))
            .filter("a > 0 and b > 0").select("key", ((F.greatest("a", "b") > crowd) & (F.col("left") > 1)).alias("hot"))
        )
        plain = rows.join(sizes.filter("not hot"), "key", "left_semi")
        index = plain.filter("role = 0").select("key", F.col("word").alias("a"))
        probe = plain.filter("role = 1").select("key", "longer", F.col("word").alias("b"))
        near = (F.levenshtein("a", "b", 1) == 1) & ((F.col("longer") == 1) | (F.col("a") < F.col("b")))
        found.append(index.join(probe, "key").filter(near).select("a", "b"))
        hot = sizes.filter("hot")
        if hot.isEmpty():
            break
        rows = rows.join(hot, "key", "left_semi")
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out.distinct()


def roots(links: DataFrame) -> DataFrame:
    """(word, root): where the links (word, form), one a word at most and without circles, end."""
    now = stored(links.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        new = stored(now.join(ahead, "root", "left").select("word", F.coalesce("ahead", "root").alias("root"), F.col("ahead").isNotNull().alias("moved")))
        now = new.select("word", "root")
        if new.filter("moved").isEmpty():
            return now


def spelling_variants(
    docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, typo_one_in: int = TYPO_ONE_IN, ratio: int = RATIO,
    crowd: int = CROWD, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Per word: word, n (occurrences), n_near (near words), form and form_n (null: none), root (itself, if it has no form)."""
    words = stored(word_counts(docs, least_length, least_count, typo_one_in, id_col, text_col))
    pairs = stored(near_pairs(words.select("word"), crowd))
    both = pairs.union(pairs.select("b", "a")).toDF("word", "near")
    best = F.min(F.struct((-F.col("m")).alias("m"), "near"))
    beside = stored(
        both.join(words.select(F.col("word").alias("near"), F.col("n").alias("m")), "near")
        .groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    )
    common = -F.col("best.m") >= ratio * F.col("n")
    judged = stored(
        words.join(beside, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(common, F.col("best.near")).alias("form"),
            F.when(common, -F.col("best.m")).alias("form_n"),
        )
    )
    ends = roots(judged.filter("form is not null").select("word", "form"))
    return judged.join(ends, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
