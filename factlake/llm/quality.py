"""Quality rules: a table of thresholds compiled into one Spark projection (no user functions).

The table's rows are ``Rule(metric, least, most)``.  ``compile_rules`` turns them into one boolean column;
``quality`` adds it to the measures of each text.  Everything is built-in expressions over one row, so there is no
shuffle, and a text of any length is handled where it is read.

Defined cases: a null text has no words (every measure 0, base_failed true, kept false); so has an empty text or one
of separators only.  Repeated rows are judged one by one.  An empty table gives an empty table.  Other columns of the
input, whatever their names, have no influence (``quality`` drops them, ``keep_good`` returns them untouched).
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, columns, fresh


class Rule(NamedTuple):
    """A text passes if least <= metric <= most (None: no bound)."""

    metric: str
    least: float | None
    most: float | None


#: Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the be to of and that have with is are was for in on it this a an by as at from or "
    "de la le les et des un une que en est dans du pour qui sur pas par au avec "
    "der die und das von mit zu den ist ein eine nicht im auf für sich dem als "
    "el los y del se las con para su"
).split()

STOP_CAPITALIZED = [w.capitalize() for w in STOP_WORDS]

#: The production thresholds.
RULES = (
    Rule("n_words", 50, None),
    Rule("mean_word_length", 1.5, 20.0),
    Rule("symbol_ratio", None, 0.05),
    Rule("stop_word_ratio", 0.06, None),
    Rule("dup_line_ratio", None, 0.5),
    Rule("upper_ratio", None, 0.5),
)

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def compile_rules(rules: tuple[Rule, ...], metric: dict[str, Column]) -> Column:
    """One boolean column: all rules hold; a metric that is null fails its rule."""
    out = F.lit(True)
    for name, least, most in rules:
        if least is not None:
            out = out & F.coalesce(metric[name] >= F.lit(least), F.lit(False))
        if most is not None:
            out = out & F.coalesce(metric[name] <= F.lit(most), F.lit(False))
    return out


#: Up to so many distinct repeated windows are looked up one by one; beyond, all windows are sorted.  Same result.
FEW = 32


def _windows(hashes: Column) -> Column:
    """A number for each 3-word window; equal windows have equal numbers (the converse is checked later)."""
    n = F.size(hashes)
    pairs = F.zip_with(hashes, F.slice(hashes, 2, n), lambda a, b: a.bitwiseXOR(F.shiftleft(b, 1)))
    triples = F.zip_with(pairs, F.slice(hashes, 3, n), lambda a, b: a.bitwiseXOR(F.shiftleft(b, 2)))
    return F.slice(triples, 1, F.greatest(n - 2, F.lit(0)))


def _repeated(ordered: Column) -> Column:
    """The numbers that stand in the sorted array twice or more.

    A lambda evaluates what it holds for each element, so ``ordered`` must be a column and no expression.
    """
    return F.array_distinct(F.filter(ordered, lambda x, i: x == F.get(ordered, i - 1)))


def _placed(words: Column, numbers: Column, repeated: Column) -> Column:
    """The windows whose number is repeated, as words, each with its place behind it, sorted.

    A word holds no space, so equal windows are neighbours: n log n at any length.
    """
    place = lambda x, i: F.when((F.size(repeated) > FEW) | F.array_contains(repeated, x), i)
    at = F.filter(F.transform(numbers, place), lambda i: i.isNotNull())
    window = lambda i: F.concat_ws(
        " ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2), i.cast("string")
    )
    return F.array_sort(F.transform(at, window))


def _covered(placed: Column) -> Column:
    """How many words lie in windows that are equal to a neighbour, which is to say occur twice or more."""
    window = lambda c: F.substring_index(c, " ", 3)
    equal = lambda x, i: (window(F.get(placed, i - 1)) == window(x)) | (window(F.get(placed, i + 1)) == window(x))
    place = F.transform(placed, lambda x, i: F.when(equal(x, i), F.substring_index(x, " ", -1).cast("int")))
    marked = F.filter(place, lambda x: x.isNotNull())
    return F.size(F.array_distinct(F.flatten(F.transform(marked, lambda p: F.array(p, p + 1, p + 2)))))


def _measured(df: DataFrame, text: str) -> tuple[DataFrame, dict[str, Column]]:
    """``df`` with working columns, and the metrics over them."""
    t, w, x, o, d, s, lines, base = fresh(df, "_t", "_w", "_x", "_o", "_d", "_s", "_lines", "_base")
    words, numbers, repeated = F.col(w), F.col(x), F.col(d)
    made = (
        df.withColumn(t, F.coalesce(F.col(f"`{text}`"), F.lit("")))
        .withColumn(w, F.regexp_extract_all(F.col(t), F.lit(WORD), F.lit(0)))
        .withColumn(lines, F.filter(F.split(F.col(t), "\n", -1), lambda c: c.rlike(WORD)))
        .withColumn(x, F.transform(words, lambda c: F.xxhash64(c)))
        .withColumn(x, _windows(numbers))
        .withColumn(o, F.when(F.size(F.array_distinct(numbers)) < F.size(numbers), F.sort_array(numbers)))
        .withColumn(d, F.when(F.col(o).isNotNull(), _repeated(F.col(o))))
        .withColumn(s, F.when(repeated.isNotNull(), _placed(words, numbers, repeated)))
    )
    # a filter on any measure would be pushed below the working columns, each of which would then be computed anew wherever
    # it is used; it isn't pushed below a column that isn't deterministic
    made = made.withColumn(
        base,
        F.when(F.monotonically_increasing_id() >= 0, F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.regexp_count(F.col(t), F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
            (F.size(F.col(lines)) - F.size(F.array_distinct(F.col(lines)))).cast("long").alias("n_dup_lines"),
            F.when(F.col(s).isNull(), F.lit(0)).otherwise(_covered(F.col(s))).cast("long").alias("n_repeat_words"),
            F.size(F.col(lines)).cast("long").alias("n_lines"),
            F.length(F.regexp_replace(F.col(t), r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
            F.size(F.filter(words, lambda c: c.isin(*STOP_WORDS, *STOP_CAPITALIZED))).cast("long").alias("n_stop_words"),
        )),
    )
    b = F.col(base)
    per = lambda c: F.nullif(b[c].cast("double"), F.lit(0.0))
    metric = {k: b[k] for k in (*MEASURES, "n_lines", "n_stop_words")}
    metric |= {
        "mean_word_length": b["word_chars"] / per("n_words"),
        "symbol_ratio": b["n_symbols"] / per("word_chars"),
        "stop_word_ratio": b["n_stop_words"] / per("n_words"),
        "dup_line_ratio": b["n_dup_lines"] / per("n_lines"),
        "upper_ratio": b["n_upper"] / per("word_chars"),
        "base_failed": (b["n_words"] < 50) | (100 * b["n_repeat_words"] > 50 * b["n_words"]),
    }
    return made, metric


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, the measures, base_failed, and kept (the base and all ``rules`` hold)."""
    made, metric = _measured(columns(docs, doc_id=id_col, text=text_col), "text")
    return made.select(
        "doc_id",
        *(metric[k].alias(k) for k in MEASURES),
        metric["base_failed"].alias("base_failed"),
        (~metric["base_failed"] & compile_rules(rules, metric)).alias("kept"),
    )


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text passes the base and all ``rules``."""
    made, metric = _measured(docs, text_col)
    return made.filter(~metric["base_failed"] & compile_rules(rules, metric)).select(
        *(F.col(f"`{c}`") for c in docs.columns)
    )
