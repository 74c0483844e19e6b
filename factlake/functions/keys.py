"""Keys, labels and small scalar functions, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def repository_key(name: Column) -> Column:
    return F.concat(F.lit("repository:"), name)


def repository_name(key: Column) -> Column:
    return F.regexp_replace(key, "^repository:", "")


def package_key(language: Column, repository: Column, name: Column) -> Column:
    return F.concat_ws(":", F.lit("package"), language, repository, name)


def file_key(repository: Column, path: Column) -> Column:
    return F.concat_ws(":", F.lit("file"), repository, path)


def evidence_key(file: Column, start: Column, end: Column) -> Column:
    return F.concat_ws(":", F.lit("evidence"), file, start.cast("string"), end.cast("string"))


def symbol_key(*identity: Column) -> Column:
    """A key of the length-prefixed parts of an identity: positions aren't among them, so it survives edits elsewhere.

    Keys are opaque; this one is SHA-256, which Spark has built in.  A null or empty part makes the key null.
    """
    parts = [F.concat(F.octet_length(p).cast("string"), F.lit(":"), p) for p in identity]
    empty = F.lit(False)
    for p in identity:
        empty = empty | p.isNull() | (p == "")
    return F.when(~empty, F.sha2(F.concat(*parts), 256))


def location(repository: Column, path: Column, line: Column) -> Column:
    return F.concat_ws(":", repository, path, line.cast("string"))


def split_list(text: Column) -> Column:
    """A comma-joined list as an array, trimmed, without empty items."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def short_commit(commit: Column) -> Column:
    return F.substring(commit, 1, 7)


def age_ms(published: Column, now: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), F.unix_millis(now) - F.unix_millis(published))


def version_parts(version: Column) -> Column:
    """A dotted version as numbers, so that arrays compare as versions do; suffixes are left out."""
    return F.transform(F.split(F.regexp_extract(version, r"^v?(\d+(?:\.\d+)*)", 1), r"\."), lambda x: x.cast("int"))


def ends_qualified(qualified: Column, name: Column) -> Column:
    """Whether a qualified name ends in the name at a boundary."""
    boundary = ~F.substring(qualified, -1 - F.length(name), F.lit(1)).rlike("[A-Za-z0-9_]")
    return (qualified == name) | (F.endswith(qualified, name) & boundary)


def hoisted(column: Column) -> Column:
    """A column's value if all rows share it (an aggregate), for the header of a compact view."""
    return F.when((F.count_distinct(column) == 1) & (F.count(column) == F.count(F.lit(1))), F.min(column))


def guidance(total: int, truncated: bool, verdict: str | None = None) -> str | None:
    """What an empty or cut answer means."""
    if truncated:
        return "The answer is cut: follow the cursor or narrow the query."
    if total == 0:
        return "Nothing was found, and nothing was missed." if verdict == "COMPLETE" else "Nothing was found; unresolved references may hide answers."
    return None
