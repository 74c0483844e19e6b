"""File outlines, source bodies, and finding a declaration again after its file has changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlake.schema import MEMBER_KINDS, Graph

MAX_CONTEXT, MAX_SELECTORS, MAX_BYTES = 100, 20, 256 * 1024


def normal_path(path: str) -> str:
    """A relative path without a slash at its end; absolute paths and ``..`` are refused."""
    if not path or path.startswith("/") or ".." in path.split("/"):
        raise ValueError(f"not a path inside a repository: {path!r}")
    return path.removesuffix("/")


def under(path: Column, wanted: str) -> Column:
    """The file itself, or one under the directory: a separator is required, unlike in a prefix search."""
    return (path == wanted) | path.startswith(f"{wanted}/")


def file_outline(graph: Graph, path: str, kinds: list[str] | None = None, with_members: bool = False) -> DataFrame:
    """(path, file_key, n, declarations): the declarations at a file or under a directory, in the order of their lines."""
    files = graph.files.filter(under(F.col("path"), normal_path(path))).select(F.col("stable_key").alias("file_key"), "path")
    s = graph.symbols
    if kinds:
        s = s.filter(F.col("kind").isin(*kinds))
    elif not with_members:
        s = s.filter(~F.col("kind").isin(*MEMBER_KINDS))
    item = F.struct("start_line", "end_line", F.col("stable_key").alias("key"), "name", "kind")
    return s.join(files, "file_key").groupBy("path", "file_key").agg(
        F.count("*").alias("n"), F.array_sort(F.collect_list(item)).alias("declarations")
    )


def declares(line: Column, name: Column) -> Column:
    """Whether a line holds the name as a whole identifier and isn't a comment's."""
    quoted = F.regexp_replace(name, r"([\\.+*?()|\[\]{}^$])", r"\\$1")
    start = F.ltrim(line)
    return ~(start.startswith("//") | start.startswith("*")) & F.rlike(
        line, F.concat(F.lit("(^|[^A-Za-z0-9_])"), quoted, F.lit("([^A-Za-z0-9_]|$)"))
    )


def reanchor(wanted: DataFrame) -> DataFrame:
    """(key, line, status) from (key, name, start_line, end_line, text): the nearest line that declares the name.

    Two lines equally near are refused (AMBIGUOUS), and so is a place where the span no longer fits (OUT_OF_RANGE).
    """
    lines = wanted.select("key", "name", "start_line", "end_line", F.split("text", "\n").alias("lines"))
    lines = lines.select("*", F.size("lines").alias("n_lines"))
    at = lines.select("key", "name", "start_line", "end_line", "n_lines", F.posexplode("lines").alias("pos", "line"))
    hits = at.filter(declares(F.col("line"), F.col("name"))).select(
        "key", (F.col("pos") + 1).cast("long").alias("line"), F.abs(F.col("pos") + 1 - F.col("start_line")).alias("far")
    )
    nearest = hits.groupBy("key").agg(F.min(F.struct("far", "line")).alias("best"), F.collect_list("far").alias("fars"))
    found = nearest.select(
        "key", F.col("best.line").alias("line"), F.size(F.filter("fars", lambda x: x == F.col("best.far"))).alias("ties")
    )
    last = F.col("line") + F.col("end_line") - F.col("start_line")
    return lines.join(found, "key", "left").select(
        "key",
        F.when((F.col("ties") == 1) & (last <= F.col("n_lines")), F.col("line")).alias("line"),
        F.when(F.col("ties").isNull(), "NOT_FOUND").when(F.col("ties") > 1, "AMBIGUOUS").when(last > F.col("n_lines"), "OUT_OF_RANGE")
        .otherwise("FOUND").alias("status"),
    )


def first_bytes(text: Column, most: int) -> Column:
    """The longest prefix of whole characters that takes at most so many bytes."""
    data = F.encode(text, "UTF-8")
    # a byte that continues a character is 10......: a cut before one goes back, by three bytes at most, to the character's first
    continues = lambda at: F.coalesce(F.conv(F.hex(F.substring(data, at + 1, 1)), 16, 10).cast("int").bitwiseAND(F.lit(0xC0)) == 0x80, F.lit(False))
    end = F.when(~continues(most), most)
    for back in (1, 2, 3):
        end = end.when(~continues(most - back), most - back)
    return F.when(F.octet_length(text) <= most, text).otherwise(F.decode(F.substring(data, 1, end.otherwise(most)), "UTF-8"))


def source_bodies(wanted: DataFrame, context: int = 0, most: int = MAX_BYTES) -> DataFrame:
    """(key, body, verified, truncated) from (key, start_line, end_line, text, content_hash): the lines of a span."""
    if not 0 <= context <= MAX_CONTEXT:
        raise ValueError(f"context must be 0 to {MAX_CONTEXT} lines")
    lines = F.split("text", "\n")
    first = F.greatest(F.lit(1), F.col("start_line") - context).cast("int")
    last = F.least(F.size(lines), F.col("end_line") + context).cast("int")
    body = F.array_join(F.slice(lines, first, F.greatest(F.lit(0), last - first + 1)), "\n")
    return wanted.select("key", body.alias("body"), (F.sha2("text", 256) == F.col("content_hash")).alias("verified")).select(
        "key", first_bytes(F.col("body"), most).alias("body"), "verified", (F.octet_length("body") > most).alias("truncated")
    )


def get_source(wanted: DataFrame, context: int = 0, most: int = MAX_BYTES) -> DataFrame:
    """(key, body, start_line, status, truncated) from (key, name, start_line, end_line, text, content_hash).

    Where the text is what was indexed, the recorded span is given (CURRENT); else the declaration is looked for again and
    the span moved to it (FOUND), or refused with the reason of :func:`reanchor` and no body.
    """
    fresh = wanted.withColumn("_same", F.coalesce(F.sha2("text", 256) == F.col("content_hash"), F.lit(False)))
    moved = reanchor(fresh.filter(~F.col("_same"))).select("key", F.col("line").alias("_line"), F.col("status").alias("_status"))
    at = F.when(F.col("_same"), F.col("start_line")).otherwise(F.col("_line"))
    placed = fresh.join(moved, "key", "left").select(
        "key", "text", "content_hash", at.alias("start_line"), (at + F.col("end_line") - F.col("start_line")).alias("end_line"),
        F.when(F.col("_same"), "CURRENT").otherwise(F.col("_status")).alias("status"),
    )
    bodies = source_bodies(placed.filter("start_line is not null"), context, most).drop("verified")
    return placed.select("key", "start_line", "status").join(bodies, "key", "left").select("key", "body", "start_line", "status", "truncated")
