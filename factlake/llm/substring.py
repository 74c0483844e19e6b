"""Exact removal of repeated substrings by the common-prefix interval tree of an enhanced suffix array.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier: in a document with a smaller id, or
earlier in the same one.  Texts are UTF-8 bytes and matches never cross documents.

1. Every window of ``LENGTH`` bytes has an anchor, the ``GRAM``-gram in it with the least hash (the leftmost of equals).
   Equal windows have equal anchors at equal places, so occurrences of a window meet under their anchor's hash.  A
   record is an anchor with all the windows it serves: one piece of text, some 35 windows.  Records that repeat
   within their text, byte by byte, are marked at once.  Anchors are counted before the shuffle; only records whose anchor
   occurs several times go on.
2. Of one anchor, records of equal bytes are one class.  Across texts they are told by 144 bits of three hashes and not compared
   (a record has some hundred bytes, while sums of powers modulo 2**64 need a thousand to be equal by construction).  Its first record stands for
   it: all bytes of the others also start earlier, so they are marked whole, and only the first is fetched from its text,
   if its anchor has other classes.
3. The classes of one anchor go to one task.  There, windows that occur once, and windows all of whose occurrences are
   continued to the left by the same byte, can't begin a maximal repeat and are passed over; the suffixes that start at
   the others are sorted, with the lengths of common prefixes between neighbours: the enhanced suffix array.  A stack
   scan yields its intervals of equal prefixes; those with different left extensions (the start of a record counts as
   different) are the maximal repeats, each with all its occurrences.  All but the first occurrence are marked.
   A window's class is contained in a maximal repeat with as many occurrences, so the marks are just the bytes sought.
   An anchor of one class has one maximal repeat, the record, whose occurrences are the class: step 2 is its interval.
4. An anchor with more than ``HOT`` records is gathered by no task: it is salted, the first of each class and salt go on, and an
   aggregation finds the first of those.  If it has more than ``HOT`` classes, each is split by where in the windows the anchor stands; the windows of
   a part have more bytes in common, and those are its new, longer anchor.  Parts go through steps 2 to 4 again, until
   an anchor is a whole window, which has one class.  So at any size the interval tree decides, of bounded groups.
5. Marks are merged per document and cut out.

Defined cases: a null text is empty; texts shorter than ``LENGTH`` lose nothing; long texts are worked on in overlapping
parts.  Ids are integers; documents with null ids come last.  Of several texts of one id, or of null, the order is that
of a 128-bit hash, which also tells them apart (texts with ids of their own need none); repeated rows (equal id and text)
are one document, and each row gets its result.  An empty table gives an empty table.  Other columns don't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, mix, rolling, span_hash, stored

LENGTH, GRAM = 100, 32
#: Records, and classes, of one anchor that one task holds at most (some 8 MB).
HOT = 60_000
#: Bytes of records that are worked on at a time.
CHUNK = 1_500_000
#: Windows of a text that are hashed at a time.
PART = 1 << 19
#: Up to so many anchors with more than ``HOT`` records, 12 bytes each, are broadcast; beyond, they are joined by a shuffle.
FEW = 500_000


# within one text -----------------------------------------------------------------------------------------------------


def _leftmost_least(h: np.ndarray, w: int) -> np.ndarray:
    """For each window of w values the place of its least, the leftmost of equals (van Herk: two running minima)."""
    n = len(h)
    pad = (-n) % w
    # value and place in one number; the place breaks ties
    key = (h & ~np.uint64(0xFFFFFFFF)) | np.arange(n, dtype=np.uint64)
    full = np.concatenate([key, np.full(pad, np.iinfo(np.uint64).max, dtype=np.uint64)]).reshape(-1, w)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    back = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(back[: n - w + 1], ahead[w - 1 : n]) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def records(text: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Of each record: anchor's hash, first byte, number of windows, distance from first byte to anchor, and two hashes."""
    out = [_records_of_part(text[at : at + PART + length - 1], at, length, gram) for at in range(0, len(text) - length + 1, PART)]
    kinds = (np.uint64, np.int64, np.int64, np.int64, np.uint64, np.uint64)
    return tuple(np.concatenate([o[k] for o in out]) if out else np.empty(0, kind) for k, kind in enumerate(kinds))


def _records_of_part(text: bytes, begin: int, length: int, gram: int) -> tuple[np.ndarray, ...]:
    data = np.frombuffer(text, dtype=np.uint8)
    s = rolling(data)
    at = np.arange(len(text) - gram + 1)
    h = span_hash(s, at, at + gram)
    least = _leftmost_least(h, length - gram + 1)  # by the upper half of the hashes
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    windows = np.diff(np.append(first, len(least)))
    anchor = least[first]
    return (h[anchor], first + begin, windows, anchor - first, *_whole(s, rolling(data, 1), first, first + windows + length - 1))


def _whole(s: np.ndarray, s2: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of spans; of the second, 16 bits are used."""
    return span_hash(s2, start, end, 1), span_hash(s, start, end)


def _repeated(text: bytes, h: np.ndarray, first: np.ndarray, windows: np.ndarray, f: np.ndarray, length: int) -> np.ndarray:
    """Which records of a text have the bytes of an earlier one: hashes find them, the bytes decide."""
    _, earliest, which = np.unique(f ^ mix(h + windows.astype(np.uint64)), return_index=True, return_inverse=True)
    earliest = earliest[which]
    again = earliest != np.arange(len(h))
    for i in np.flatnonzero(again).tolist():
        a, b, n = int(first[i]), int(first[earliest[i]]), int(windows[i]) + length - 1
        again[i] = text[a : a + n] == text[b : b + n]
    return again


def _block(level: int, length: int, gram: int) -> int:
    """How many distances from window to anchor go together at a level of splitting; all of them at the first."""
    most = length - gram + 1
    return -(-most // (1 << level))


def split_records(text: bytes, place: np.ndarray, windows: np.ndarray, off: np.ndarray, level: int, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """The records of a level from those of the one before, as in :func:`records`, and whose part each is.

    Windows whose anchor stands ``low`` to ``high`` bytes behind their start have the bytes from ``anchor - low`` to
    ``anchor - high + length`` in common: these are the anchor from here on.
    """
    step, last = _block(level, length, gram), length - gram
    begin = int(place.min())
    data = np.frombuffer(text[begin : int((place + windows).max()) + length - 1], dtype=np.uint8)
    s, s2 = rolling(data), rolling(data, 1)
    lowest = off - windows + 1
    count = off // step - lowest // step + 1
    of = np.repeat(np.arange(len(place)), count)
    block = lowest[of] // step + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    low, high = block * step, np.minimum(block * step + step - 1, last)
    near, far = np.maximum(low, lowest[of]), np.minimum(high, off[of])
    anchor = (place + off)[of] - begin
    key = mix(span_hash(s, anchor - low, anchor - high + length) + (block + (level << 16)).astype(np.uint64))
    first, n = anchor - far, far - near + 1
    return (key, first + begin, n, far, *_whole(s, s2, first, first + n + length - 1), of)


def merge(marks: np.ndarray) -> np.ndarray:
    """The union of spans [start, end) as maximal runs."""
    if not len(marks):
        return marks.reshape(0, 2)
    marks = marks[np.argsort(marks[:, 0], kind="stable")]
    reach = np.maximum.accumulate(marks[:, 1])
    new = np.concatenate([[True], marks[1:, 0] > reach[:-1]])
    at = np.flatnonzero(new)
    return np.stack([marks[at, 0], reach[np.append(at[1:] - 1, len(marks) - 1)]], axis=1)


# within one task's records -------------------------------------------------------------------------------------------


def maximal_repeats(pieces: list[bytes], length: int = LENGTH) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each repeat of ``length`` bytes or more: its length, and piece and offset of all its occurrences.

    A repeat is reported if its occurrences differ in the byte to the left (or one is the start of a piece) and in
    the byte to the right (or end there); from the enhanced suffix array of the starts where that can be.
    """
    sizes = np.array([len(p) for p in pieces], dtype=np.int64)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    if data.max(initial=0) == 255:
        raise ValueError("pieces of UTF-8 hold no byte 255")
    windows = np.maximum(sizes - length + 1, 0)
    total = int(windows.sum())
    if not total:
        return
    piece = np.repeat(np.arange(len(pieces)), windows)
    start = np.arange(total) - np.repeat(np.cumsum(windows) - windows, windows) + begins[piece]
    h = span_hash(rolling(data), start, start + length)
    order = np.argsort(h, kind="stable")
    group = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]]))
    count = np.diff(np.append(group, total))
    # the byte to the left; a number of its own at the start of a piece
    left = np.where(start > begins[piece], data[start - 1].astype(np.int64), 256 + piece)
    ordered_left = left[order]
    diverse = np.minimum.reduceat(ordered_left, group) != np.maximum.reduceat(ordered_left, group)
    kept = np.sort(order[np.repeat((count > 1) & diverse, count)])
    if not len(kept):
        return
    start, piece, left = start[kept], piece[kept], left[kept]
    suffix_size = ends[piece] - start
    # the suffixes, each to the end of its piece, as rows of equal width; bytes are one more than they are, so what fills
    # a row up is below all of them, and a suffix stands before those that it begins
    width = int(suffix_size.max())
    padded = np.concatenate([data + np.uint8(1), np.zeros(width, dtype=np.uint8)])
    rows = np.lib.stride_tricks.sliding_window_view(padded, width)[start]
    rows[np.arange(width) >= suffix_size[:, None]] = 0
    sa = np.argsort(rows.view(f"S{width}").ravel(), kind="stable")
    rows, size_sorted = rows[sa], suffix_size[sa]
    differs = rows[1:] != rows[:-1]
    lcp = np.where(differs.any(axis=1), differs.argmax(axis=1), width)
    lcp = np.minimum(lcp, np.minimum(size_sorted[1:], size_sorted[:-1]))
    lcp = np.where(lcp >= length, lcp, 0)
    left, where, offset = left[sa], piece[sa], start[sa] - begins[piece[sa]]
    # stack scan: intervals (common prefix, first suffix); a value of 0 closes all
    stack: list[tuple[int, int]] = []
    for i, value in enumerate(np.append(lcp, 0).tolist()):
        low = i
        while stack and stack[-1][0] > value:
            prefix, low = stack.pop()
            inside = left[low : i + 1]
            if (inside != inside[0]).any():
                yield prefix, where[low : i + 1], offset[low : i + 1]
        if value and (not stack or stack[-1][0] < value):
            stack.append((value, low))


def _mark(docs: list[tuple], starts: np.ndarray, pieces: list[bytes], length: int) -> list[tuple[int, int, int]]:
    """Marks (record, start, end) of all occurrences of maximal repeats but the first by (document, place)."""
    rank_of = {d: i for i, d in enumerate(sorted(set(docs)))}
    ranks = np.array([rank_of[d] for d in docs], dtype=np.int64)
    marks = []
    wide = np.int64(1 << 32)
    for prefix, where, offset in maximal_repeats(pieces, length):
        rank, place = ranks[where], starts[where] + offset
        first = np.lexsort((place, rank))[0]
        # a repeated row holds the first occurrence too
        later = (rank != rank[first]) | (place != place[first])
        at = where[later] * wide + offset[later]
        marks.append(np.stack([at, at + prefix], axis=1))
    if not marks:
        return []
    runs = merge(np.concatenate(marks))
    w = runs[:, 0] // wide
    return list(zip(w.tolist(), (starts[w] + runs[:, 0] % wide).tolist(), (starts[w] + runs[:, 1] - w * wide).tolist()))


# over documents ------------------------------------------------------------------------------------------------------

_LAST = (1 << 63) - 1
_RECORD = "h long, id long, x binary, f long, p long"


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, x, text): the id, last if null; what tells texts of one id apart; the text as bytes.

    ``x`` is empty where every row has an id of its own, which a count tells; else 128 bits of a hash and a mark for null ids.
    """
    text = F.coalesce(F.encode(F.col("text").cast("string"), "UTF-8"), F.lit(b""))
    df = columns(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("id"), text.alias("text"))
    shared = df.groupBy("id").agg(F.count("*").alias("n")).filter("id is null or n > 1")
    x = F.lit(b"") if shared.isEmpty() else F.concat(F.when(F.col("id").isNull(), F.lit(b"\1")).otherwise(F.lit(b"\0")), F.unhex(F.md5("text")))
    return df.select(F.coalesce("id", F.lit(_LAST)).alias("id"), x.alias("x"), "text")


def _pack(first: np.ndarray, windows: np.ndarray, off: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Place, number of windows, distance to the anchor (both less than 256) and 16 bits of the second hash in one number."""
    rest = windows.astype(np.uint64) << np.uint64(24) | off.astype(np.uint64) << np.uint64(16) | second >> np.uint64(48)
    return first.astype(np.int64) << 32 | rest.view(np.int64)


def _class_bits(p: Column) -> Column:
    return F.col(p).bitwiseAND(F.lit(0xFFFFFFFF))


def _first(p: Column) -> Column:
    return F.shiftright(p, 32)


def _windows(p: Column) -> Column:
    return F.shiftright(p, 24).bitwiseAND(F.lit(255))


def _records(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """(h, id, x, f, p) of each record; a run of bytes that repeat within the text is a row without windows, with its end
    as f, under an anchor that only the text has, twice or more."""
    if not 0 <= length - gram < 255:
        raise ValueError("a record must have fewer than 256 windows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                out: list[list[np.ndarray]] = [[], [], []]
                sizes = []
                for i, x, text in zip(*(c.to_pylist() for c in part.columns)):
                    h, first, windows, off, f, second = records(text, length, gram)
                    again = _repeated(text, h, first, windows, f, length)
                    p = _pack(first, windows, off, second)
                    if again.any():
                        runs = merge(np.stack([first[again], first[again] + windows[again] + length - 1], axis=1))
                        runs = np.concatenate([runs, runs[:1]]) if len(runs) == 1 else runs
                        own = np.full(len(runs), xxhash.xxh3_64_intdigest(b"%d:%s" % (i, x)), dtype=np.uint64)
                        h, f = np.concatenate([h[~again], own]), np.concatenate([f[~again], runs[:, 1].astype(np.uint64)])
                        p = np.concatenate([p[~again], runs[:, 0] << 32])
                    for z, v in zip(out, (h, f, p)):
                        z.append(v.view(np.int64))
                    sizes.append(len(h))
                h, f, p = (pa.array(np.concatenate(z) if z else np.empty(0, np.int64), pa.int64()) for z in out)
                of = pa.array(np.repeat(np.arange(len(sizes)), sizes), pa.int64())
                yield pa.RecordBatch.from_arrays([h, part.column(0).take(of), part.column(1).take(of), f, p], names=["h", "id", "x", "f", "p"])

    return texts.select("id", "x", "text").mapInArrow(run, _RECORD)


def _with_records(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, x, text, records) of the texts that hold wanted records."""
    of_text = wanted.groupBy("id", "x").agg(F.collect_list(F.struct("h", "p")).alias("records"))
    return texts.join(of_text, ["id", "x"]).select("id", "x", "text", "records")


def _pieces(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(h, id, x, s, piece): the wanted records with their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                out: list[tuple] = []
                for i, x, text, rs in zip(*(c.to_pylist() for c in part.columns)):
                    places = [(r["h"], r["p"] >> 32, r["p"] >> 24 & 255) for r in rs]
                    out += [(h, i, x, s, text[s : s + n + length - 1]) for h, s, n in places]
                kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary()]
                cols = zip(*out) if out else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=["h", "id", "x", "s", "piece"])

    return _with_records(texts, wanted).mapInArrow(run, "h long, id long, x binary, s long, piece binary")


def _split(texts: DataFrame, wanted: DataFrame, level: int, length: int, gram: int) -> DataFrame:
    """(h, id, x, f, p): the parts of the wanted records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(b.num_rows):
                i, x, text, rs = (c[at] for c in b.columns)
                p = np.array(sorted(r["p"] for r in rs.as_py()), dtype=np.int64)
                made = split_records(text.as_py(), p >> 32, p >> 24 & 255, p >> 16 & 255, level, length, gram)
                h, first, windows, off, f, second, _ = made
                cols = [pa.array(h.view(np.int64)), pa.array([i.as_py()] * len(h), pa.int64()), pa.array([x.as_py()] * len(h), pa.binary())]
                cols += [pa.array(f.view(np.int64)), pa.array(_pack(first, windows, off, second))]
                yield pa.RecordBatch.from_arrays(cols, names=["h", "id", "x", "f", "p"])

    return _with_records(texts, wanted).mapInArrow(run, _RECORD)


def _marks(pieces: DataFrame, length: int) -> DataFrame:
    """(id, x, s, e) from pieces whose equal h stand together in their partition."""

    def work(rows: list[tuple]) -> pa.RecordBatch:
        made = _mark([r[1:3] for r in rows], np.array([r[3] for r in rows], dtype=np.int64), [r[4] for r in rows], length)
        out = [(*rows[w][1:3], s, e) for w, s, e in made]
        kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out) if out else [[]] * 4, kinds)], names=["id", "x", "s", "e"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if size >= CHUNK and row[0] != held[-1][0]:
                    yield work(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4]) + 64
        if held:
            yield work(held)

    return pieces.repartition("h").sortWithinPartitions("h").mapInArrow(run, "id long, x binary, s long, e long")


def _classes(found: DataFrame, hot: int) -> tuple[DataFrame, DataFrame]:
    """(h, id, x, p, classes): the first record of each class of anchors with several; and (id, x, s, p, e): all others.

    Of the others, e is null unless the row is a run of bytes that repeat within their text.
    """
    common = stored(found.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1"))
    salts = F.ceil(F.col("n") / hot).cast("int")
    crowded = common.filter(F.col("n") > hot).select("h", salts.alias("salts"))
    many = crowded.count()
    if many:
        found = found.join(F.broadcast(crowded) if many <= FEW else crowded, "h", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
        found = found.withColumn("salt", F.when(F.col("salts") > 1, F.pmod(F.xxhash64("id", "x", "p"), "salts")).otherwise(0))
        keys = common.select("h", F.explode(F.sequence(F.lit(0).cast("long"), salts.cast("long") - 1)).alias("salt"))
        here = ["h", "salt"]
    else:
        found, keys, here = found.withColumn("salts", F.lit(1)), common.select("h"), ["h"]
    runs, bits, place = _windows(F.col("p")) == 0, _class_bits("p"), F.struct("id", "x", "p")
    one = Window.partitionBy(*here, "f", "bits").orderBy("id", "x", "p")
    own = F.col("first").cast("long")
    # what is needed no more is null, which takes no room
    known = stored(
        found.join(keys, here).withColumn("bits", bits)
        .withColumn("first", (F.row_number().over(one) == 1) & ~runs)
        .withColumn("classes", F.sum(own).over(Window.partitionBy(*here)))
        .filter("not first or classes > 1 or salts > 1")
        .select(F.when(F.col("first"), F.col("h")).alias("h"), "id", "x", F.when(runs | F.col("first") & (F.col("salts") > 1), F.col("f")).alias("f"), "p", "first", "classes", "salts")
    )
    end = F.when(runs, F.col("f")).alias("e")
    firsts = known.filter("first and salts = 1").select("h", "id", "x", "p", "classes")
    others = known.filter("not first").select("id", "x", "p", end)
    if many:
        by = ["h", "f", "bits"]
        of_salts = known.filter("first and salts > 1").select("h", "f", bits.alias("bits"), "id", "x", "p")
        heads = stored(of_salts.groupBy(*by).agg(F.min(place).alias("head")))
        counts = heads.groupBy("h").agg(F.count("*").alias("classes"))
        firsts = firsts.union(heads.join(counts, "h").filter("classes > 1").select("h", "head.id", "head.x", "head.p", "classes"))
        later = of_salts.join(heads, by).filter(place != F.col("head"))
        others = others.union(later.select("id", "x", "p", F.lit(None).cast("long")))
    return firsts, others


def repeated_spans(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(id, x, s, e): the marks of each text; their union is what goes.  Equal (id, x) stand for equal texts."""
    texts = texts if not texts.filter("length(x) > 0").limit(1).count() else texts.dropDuplicates(["id", "x"])
    found, level, marks = _records(texts, length, gram), 0, None
    while True:
        firsts, others = _classes(found, hot)
        s = _first(F.col("p"))
        again = others.select("id", "x", s.alias("s"), F.coalesce("e", s + _windows(F.col("p")) + (length - 1)).alias("e"))
        made = again.union(_marks(_pieces(texts, firsts.filter(F.col("classes") <= hot), length), length))
        marks = made if marks is None else marks.union(made)
        large = firsts.filter(F.col("classes") > hot)
        if large.isEmpty():
            return marks
        if _block(level, length, gram) == 1:
            raise AssertionError("an anchor that is a whole window has one class")
        level += 1
        found = _split(texts, large, level, length, gram)


def dedup_substrings(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, spans (maximal removed runs in bytes, end exclusive), kept (binary)."""
    texts = _texts(docs, id_col, text_col)
    marks = stored(repeated_spans(texts, length, gram, hot)).groupBy("id", "x").agg(F.collect_set(F.struct("s", "e")).alias("marks"))
    joined = texts.join(marks, ["id", "x"], "left").select(F.when(F.substring("x", 1, 1) != F.lit(b"\1"), F.col("id")).alias("id"), "text", "marks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
        for b in batches:
            rows = []
            for i, text, marks in zip(*(c.to_pylist() for c in b.columns)):
                runs = merge(np.array([(m["s"], m["e"]) for m in marks or []], dtype=np.int64).reshape(-1, 2)).tolist()
                kept, done = [], 0
                for s, e in runs:
                    kept.append(text[done:s])
                    done = e
                kept.append(text[done:])
                rows.append((i, len(text), sum(e - s for s, e in runs), [{"s": s, "e": e} for s, e in runs], b"".join(kept)))
            kinds = [pa.int64(), pa.int64(), pa.int64(), span, pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(zip(*rows) if rows else [[]] * 5, kinds)], names=["doc_id", "n_bytes", "n_removed", "spans", "kept"]
            )

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, spans array<struct<s:long,e:long>>, kept binary")
