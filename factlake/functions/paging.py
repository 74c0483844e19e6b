"""Pages of a total order, and cursors that are bound to a generation and a query."""

from __future__ import annotations

import base64
import hashlib
import json
import struct

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlake.schema import MAX_PAGE


class CursorError(ValueError):
    """A cursor that is malformed, or of another query, order or generation."""


def page(rows: DataFrame, order: list[Column | str], offset: int = 0, limit: int = 50) -> DataFrame:
    """The rows from ``offset`` on in a total order: a top-k, no sort of everything; past the end there are none."""
    if offset < 0 or not 1 <= limit <= MAX_PAGE:
        raise ValueError(f"offset must not be negative and limit be 1 to {MAX_PAGE}")
    return rows.orderBy(*order).offset(offset).limit(limit)


def page_info(rows: DataFrame, offset: int, limit: int) -> DataFrame:
    """(total, returned, has_more) of a page."""
    total = F.count("*").alias("total")
    end = F.least(F.col("total"), F.lit(offset + limit))
    return rows.agg(total).select("total", F.greatest(F.lit(0), end - offset).cast("long").alias("returned"), (end < F.col("total")).alias("has_more"))


def query_hash(query: dict) -> bytes:
    """Eight bytes that tell logical queries apart: of their canonical JSON, without paging and presentation."""
    text = json.dumps(query, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return hashlib.sha256(text.encode()).digest()[:8]


def encode_cursor(generation: int, query: dict, order: str, offset: int) -> str:
    body = struct.pack(">BQ8s4sQ", 1, generation, query_hash(query), hashlib.sha256(order.encode()).digest()[:4], offset)
    return base64.urlsafe_b64encode(body + hashlib.sha256(body).digest()[:8]).rstrip(b"=").decode()


def decode_cursor(token: str, generation: int, query: dict, order: str) -> int:
    """The offset, if the cursor belongs to this generation, query and order."""
    try:
        raw = base64.urlsafe_b64decode(token + "=" * (-len(token) % 4))
        body, check = raw[:-8], raw[-8:]
        version, of, asked, sorted_by, offset = struct.unpack(">BQ8s4sQ", body)
    except (ValueError, struct.error) as e:
        raise CursorError("CURSOR_INVALID") from e
    if version != 1 or hashlib.sha256(body).digest()[:8] != check:
        raise CursorError("CURSOR_INVALID")
    if of != generation:
        raise CursorError("CURSOR_SNAPSHOT_EXPIRED")
    if asked != query_hash(query) or sorted_by != hashlib.sha256(order.encode()).digest()[:4]:
        raise CursorError("CURSOR_QUERY_MISMATCH")
    return offset


def compact_pages(rows: DataFrame, label: str, columns: list[str], page: str = "page", at: str = "at") -> DataFrame:
    """(page, header, form, body) of pages of at most ``MAX_PAGE`` rows (page, at, label, columns...).

    A column that all rows of a page share, and that isn't empty, moves to its header.  The rest are rows: the label alone, or a list
    with what varies; or groups of what they have in common, in the order in which each was seen first, with their labels.
    Grouping is kept only if it is the shorter of the two when it is written.
    """
    q = lambda c: F.concat(F.lit('"'), F.regexp_replace(c, r'(["\\])', r"\\$1"), F.lit('"'))
    base = rows.select(F.col(page).alias("page"), F.col(at).alias("at"), F.col(label).alias("label"), *(F.coalesce(c, F.lit("")).alias(c) for c in columns))
    # a column that all rows share doesn't divide groups, so these are made before it is known which do; dealt out by pages, once
    groups = base.repartition("page").groupBy("page", *columns).agg(F.min("at").alias("first"), F.collect_list(F.struct("at", q(F.col("label")).alias("name"))).alias("rows"))
    pages = groups.groupBy("page").agg(
        *(F.when((F.min(c) == F.max(c)) & (F.min(c) != ""), F.min(c)).alias(f"h_{c}") for c in columns), F.collect_list(F.struct("first", "rows", *columns)).alias("groups")
    )
    varied = lambda g: [F.when(F.col(f"h_{c}").isNull(), g[c]).otherwise(F.lit("")) for c in columns]
    listed = lambda rows: F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(rows), lambda x: x["text"]), ","), F.lit("]"))
    # what is behind a row's label is written once a group
    end = lambda g: F.concat_ws(",", F.transform(F.filter(F.array(*varied(g)), lambda v: v != ""), q))
    row = lambda r, e: F.when(e == "", r["name"]).otherwise(F.concat(F.lit("["), r["name"], F.lit(","), e, F.lit("]")))
    ended = F.transform("groups", lambda g: F.struct(g["rows"].alias("rows"), end(g).alias("end")))
    plain = listed(F.flatten(F.transform(ended, lambda g: F.transform(g["rows"], lambda r: F.struct(r["at"].alias("at"), row(r, g["end"]).alias("text"))))))
    names = lambda g: listed(F.transform(g["rows"], lambda r: F.struct(r["at"].alias("at"), r["name"].alias("text"))))
    said = lambda g: F.filter(F.array(*(F.when(v != "", F.concat(F.lit(f'"{c}":'), q(v))) for c, v in zip(columns, varied(g)))), lambda v: v.isNotNull())
    group = lambda g: F.concat(F.lit("{"), F.concat_ws(",", said(g), F.array(F.concat(F.lit('"rows":'), names(g)))), F.lit("}"))
    grouped = listed(F.transform("groups", lambda g: F.struct(g["first"].alias("first"), group(g).alias("text"))))
    header = F.filter(F.array(*(F.when(F.col(f"h_{c}").isNotNull(), F.concat(F.lit(f'"{c}":'), q(F.col(f"h_{c}")))) for c in columns)), lambda v: v.isNotNull())
    shorter = F.octet_length("grouped") < F.octet_length("plain")
    return pages.select("*", plain.alias("plain"), grouped.alias("grouped")).select(
        "page", F.concat(F.lit("{"), F.array_join(header, ","), F.lit("}")).alias("header"), F.when(shorter, "groups").otherwise("rows").alias("form"),
        F.when(shorter, F.col("grouped")).otherwise(F.col("plain")).alias("body"),
    )
