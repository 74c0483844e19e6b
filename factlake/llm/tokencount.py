"""Token counts of sections or fields, attributed by the places of the tokens of whole documents.

A document is encoded once, whole, since tokens depend on what stands around them.  Each token covers an interval of
the text, as does each part (a section, which is a line with its line feed, or a field); both lists are ordered and
disjoint, so the interval join is a merge by binary search within the document.  A token that crosses a boundary goes

* ``start``: to the part that holds its first byte,
* ``most``: to the part that holds most of its bytes, the earlier of equals,
* ``share``: to each part that it covers, by its share of the token's bytes (counts are then fractions),

so the counts of a document's parts always sum to its tokens.

Defined cases: a null or empty text has one empty part without tokens; a null field is an empty one, and empty parts get
no tokens; texts of any length are encoded whole; repeated rows are counted one by one; an empty table gives an empty
table.  Other columns don't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder, load_vocabulary
from .common import columns

RULES = ("start", "most", "share")


def attribute(token_bytes: np.ndarray, part_bytes: np.ndarray, rule: str = "start") -> np.ndarray:
    """How many of the tokens, of so many bytes each, go to each part."""
    n = len(part_bytes)
    ends = np.cumsum(token_bytes)
    starts = ends - token_bytes
    bounds = np.cumsum(part_bytes)
    first = np.searchsorted(bounds, starts, side="right")
    if rule == "start":
        return np.bincount(first, minlength=n).astype(float)
    last = np.searchsorted(bounds, ends - 1, side="right")
    out = np.bincount(first[first == last], minlength=n).astype(float)
    begins = bounds - part_bytes
    for t in np.flatnonzero(first != last):
        parts = np.arange(first[t], last[t] + 1)
        held = np.minimum(ends[t], bounds[parts]) - np.maximum(starts[t], begins[parts])
        if rule == "most":
            out[parts[held.argmax()]] += 1
        else:
            out[parts] += held / token_bytes[t]
    return out


def sections(text: str) -> list[str]:
    """The lines of a text, each with the line feed that ends it; one empty section if the text is empty."""
    parts = text.split("\n")
    out = [p + "\n" for p in parts[:-1]] + ([parts[-1]] if parts[-1] else [])
    return out or [""]


def _count(df: DataFrame, parts_of, names: list[str] | None, rule: str, vocabulary: bytes | None) -> DataFrame:
    if rule not in RULES:
        raise ValueError(f"rule must be one of {', '.join(RULES)}")
    sent = df.sparkSession.sparkContext.broadcast(vocabulary or load_vocabulary())
    kind = dict(df.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(sent.value)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                parts = [parts_of(row) for row in zip(*(c.to_pylist() for c in part.columns[1:]))]
                rows, no, size, tokens, chars = [], [], [], [], []
                for i, (ids, ps) in enumerate(zip(enc.encode(["".join(p) for p in parts]), parts)):
                    lengths = enc.lengths[np.frombuffer(ids, dtype="<u4")]
                    counts = attribute(lengths, np.array([len(p.encode()) for p in ps]), rule)
                    rows += [i] * len(ps)
                    no += range(len(ps))
                    chars += [len(p) for p in ps]
                    tokens.append(counts)
                    size += [len(lengths)] * len(ps)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(rows, pa.int64())), pa.array(no, pa.int32()), pa.array(chars, pa.int64()),
                     pa.array(np.concatenate(tokens) if tokens else [], pa.float64()), pa.array(size, pa.int64())],
                    names=["doc_id", "part", "n_chars", "n_tokens", "doc_tokens"],
                )

    out = df.mapInArrow(run, f"doc_id {kind}, part int, n_chars bigint, n_tokens double, doc_tokens bigint")
    if rule != "share":
        out = out.withColumn("n_tokens", F.col("n_tokens").cast("long"))
    if names is not None:
        out = out.withColumn("part", F.element_at(F.array(*map(F.lit, names)), F.col("part") + 1))
    return out


def section_tokens(docs: DataFrame, rule: str = "start", vocabulary: bytes | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per section: doc_id, part (its number from 0), n_chars, n_tokens, doc_tokens (of the whole document)."""
    df = columns(docs, doc_id=id_col, text=text_col)
    return _count(df, lambda row: sections(row[0] or ""), None, rule, vocabulary)


def field_tokens(rows: DataFrame, fields: list[str], between: str = "\n", rule: str = "start", vocabulary: bytes | None = None, id_col: str = "doc_id") -> DataFrame:
    """Per field of each row: doc_id, part (the field's name), ...; the row is encoded as one text.

    The separator stands at the end of the field before it and is counted there.
    """
    df = rows.select(F.col(f"`{id_col}`").alias("doc_id"), *(F.col(f"`{c}`").cast("string").alias(f"f{i}") for i, c in enumerate(fields)))
    last = len(fields) - 1
    return _count(df, lambda row: [(v or "") + (between if i < last else "") for i, v in enumerate(row)], fields, rule, vocabulary)
