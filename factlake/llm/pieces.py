"""SentencePiece encoding and decoding of merge-type models, exactly, by backtracking.

A sequence of pieces is the one that the merges make if each piece and each two neighbours are: merging the characters of
the two anew gives just the two.  So a text is read from left to right: an Aho-Corasick automaton over the reversed
pieces tells the longest piece that begins at each place in one pass; the longest that may follow the last piece is
taken, else the longest piece that it begins with, and so on; where none fits, the place is marked in a field of bits,
the last piece is taken back and a shorter one is tried.  What a prefix is encoded as doesn't depend on what follows, so
a marked place is never tried again, and the work grows with the text and not with the ways to cut it.

Texts are split where no piece can reach across: before a run of blanks that follows anything else, and around
characters that no piece has, which become the ids of their bytes.  Encodings of what is between are kept for the next
texts, as is what has been found about neighbours; both are bounded, and results don't depend on them.

Models are read from the file's own format; a model of another type, with a normalizer, without the fallback to bytes, or
with pieces of its own kind (user-defined, unused) is refused.

Defined cases: a null text is encoded as an empty one (the end id alone); texts of any length are encoded whole, and a
long one is split in blocks at such places; pieces of control in a text are ordinary characters; repeated rows are encoded
one by one; an empty table gives an empty table.  Only the id and the text are read; other columns don't clash.
"""

from __future__ import annotations

import codecs
import re
import struct
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import columns

#: Units (a word with its blanks) of one of two generations, and pairs of neighbours that a worker keeps, some 150 MB in all,
#: and the longest unit kept.
KEPT_UNITS, KEPT_PAIRS, KEPT_LENGTH = 250_000, 400_000, 64
#: Characters of a text that are split into units at a time.
BLOCK = 1_000_000
BLANK = "▁"
#: Fixed values of the model's format: kinds of pieces, and the type of models that merge.
NORMAL, UNKNOWN, CONTROL, BYTE, MERGES = 1, 2, 3, 6, 2


def default_model() -> str:
    """The path of the 32k model with merges among the public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def load_model(path: str | None = None) -> bytes:
    """The bytes of a model file (0.5 MB): read on the driver and sent along with the tasks."""
    with open(path or default_model(), "rb") as f:
        return f.read()


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol-buffer message; numbers of fixed width stay bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        n = shift = 0
        while True:
            b = data[at]
            at += 1
            n |= (b & 127) << shift
            shift += 7
            if b < 128:
                return n

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield tag >> 3, data[at : at + size]
            at += size


class Pieces:
    """One model, and what has been encoded so far."""

    def __init__(self, model: bytes) -> None:
        import ahocorasick

        pieces: list[tuple[str, float, int]] = []
        trainer: dict = {}
        normalizer: dict = {}
        for number, value in _fields(model):
            if number == 1:
                piece = dict(_fields(value))
                pieces.append((piece[1].decode(), struct.unpack("<f", piece.get(2, bytes(4)))[0], piece.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
        if trainer.get(3) != MERGES or not trainer.get(35) or trainer.get(24):
            raise ValueError("the model must be one of merges, with the fallback to bytes and blanks before words")
        if normalizer.get(2) or not normalizer.get(3, 1) or normalizer.get(4, 1) or not normalizer.get(5, 1):
            raise ValueError("the model must leave texts as they are but for blanks, with one in front")
        if {kind for _, _, kind in pieces} - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("pieces that are user-defined or unused aren't supported")
        self.end = next(i for i, p in enumerate(pieces) if p[0] == (trainer[47].decode() if 47 in trainer else "</s>"))
        self.text = [p[0] for p in pieces]
        self.score = {t: score for t, score, kind in pieces if kind == NORMAL}
        self.id = {t: i for i, (t, _, kind) in enumerate(pieces) if kind == NORMAL}
        self.byte = {int(t[3:5], 16): i for i, (t, _, kind) in enumerate(pieces) if kind == BYTE}
        self.size = [len(t) for t in self.text]
        #: What a piece is decoded as; unknown and control ones as nothing.
        self.raw = [
            t.replace(BLANK, " ").encode() if kind == NORMAL else bytes([int(t[3:5], 16)]) if kind == BYTE else " ⁇ ".encode() if kind == UNKNOWN else b""
            for t, _, kind in pieces
        ]
        #: The longest other piece that a piece begins with, or -1.
        self.shorter = [-1] * len(pieces)
        self.ends = ahocorasick.Automaton()
        for t, i in self.id.items():
            self.ends.add_word(t[::-1], i)
            self.shorter[i] = next((self.id[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.id), -1)
        self.ends.make_automaton()
        self.letters = set("".join(self.id))
        if any(c not in self.id for c in self.letters):
            raise ValueError("each character of a piece must be a piece")
        crossing = any(BLANK in t.lstrip(BLANK) for t in self.id)
        #: Characters that often stand between words and are no pieces.
        loose = re.escape("".join(chr(c) for c in (*range(32), 127, 0x2028, 0x2029) if chr(c) not in self.letters))
        self.units = re.compile(f"[^{loose}]+|[{loose}]" if crossing else f"{BLANK}*[^{BLANK}{loose}]+|{BLANK}+|[{loose}]")
        self.border = re.compile(f"[{loose}]" if crossing else f"[^{BLANK}](?={BLANK})")
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        #: For two ids in one number, what :meth:`_first` says.
        self.next: dict[int, int] = {}

    def _merged(self, chars: str) -> list[str]:
        """What the merges make of characters: always the pair of the best score, leftmost first."""
        score = self.score
        parts = list(chars)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _first(self, last: int, piece: int) -> int:
        """Of a piece and those that it begins with, the longest that may follow ``last`` (-1: nothing), or -1.

        Two neighbours are right if their characters are merged to just these.
        """
        if len(self.next) > KEPT_PAIRS:
            self.next.clear()
        before = [self.text[last]] if last >= 0 else []
        tried = piece
        while tried >= 0:
            both = [*before, self.text[tried]]
            if self._merged("".join(both)) == both:
                break
            tried = self.shorter[tried]
        self.next[last << 24 | piece] = tried
        return tried

    def _encode(self, unit: str) -> list[int]:
        """Ids of a string of which each character is a piece."""
        n = len(unit)
        longest = [-1] * n
        before = -1
        for end, piece in self.ends.iter(unit[::-1]):  # of those that end at one place the longest comes first
            if end != before:
                longest[~end] = piece
                before = end
        failed, top = bytearray((n >> 3) + 1), -1
        known, size, shorter = self.next.get, self.size, self.shorter
        out: list[int] = []
        at, last, piece = 0, -1 << 24, longest[0]
        while True:
            while piece >= 0:
                first = known(last | piece)
                if first is None:
                    first = self._first(last >> 24, piece)
                piece = first
                if piece < 0:
                    break
                end = at + size[piece]
                if end > top or not failed[end >> 3] >> (end & 7) & 1:
                    break
                piece = shorter[piece]
            if piece >= 0:
                out.append(piece)
                if end == n:
                    return out
                at, last, piece = end, piece << 24, longest[end]
                continue
            failed[at >> 3] |= 1 << (at & 7)
            top = max(top, at)
            taken = out.pop()
            at -= size[taken]
            last = (out[-1] if out else -1) << 24
            piece = shorter[taken]

    def unit(self, unit: str) -> tuple[int, ...]:
        """Ids of a unit; characters that no piece has become bytes."""
        letters = self.letters
        if letters.issuperset(unit):
            return tuple(self._encode(unit))
        out: list[int] = []
        start = 0
        for at, c in enumerate(unit):
            if c not in letters:
                if start < at:
                    out += self._encode(unit[start:at])
                out += [self.byte[b] for b in c.encode()]
                start = at + 1
        if start < len(unit):
            out += self._encode(unit[start:])
        return tuple(out)

    def _known(self, units: list[str]) -> dict[str, tuple[int, ...]]:
        """Encodings of all units; those that two generations of texts haven't had are forgotten."""
        if len(self.known) > KEPT_UNITS:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        here: dict[str, tuple[int, ...]] = {}
        for u in set(units).difference(known):
            ids = older.get(u) or self.unit(u)
            (known if len(u) <= KEPT_LENGTH else here)[u] = ids
        return known | here if here else known

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text and the end id."""
        out = array("i")
        if text:
            text = BLANK + text.replace(" ", BLANK)
            start, n = 0, len(text)
            while start < n:
                stop = n
                if n - start > BLOCK:
                    border = self.border.search(text, start + BLOCK)
                    stop = border.end() if border else n
                units = self.units.findall(text, start, stop)
                out.extend(chain.from_iterable(map(self._known(units).__getitem__, units)))
                start = stop
        out.append(self.end)
        return np.frombuffer(out, dtype=np.int32)

    def decode(self, ids: list[int]) -> str:
        """The text of ids: blanks are spaces, the one in front goes, and bytes that are no character become U+FFFD each."""
        raw = self.raw
        data = b"".join([raw[i] for i in ids])
        first = next((i for i in ids if raw[i]), -1)
        return (data[1:] if first >= 0 and self.text[first][0] == BLANK else data).decode("utf-8", "each-byte")


codecs.register_error("each-byte", lambda e: ("�", e.start + 1))
_models: dict[int, Pieces] = {}


def pieces(model: bytes) -> Pieces:
    """The encoder of a model, one for each worker process."""
    key = hash(model)
    if key not in _models:
        _models.clear()
        _models[key] = Pieces(model)
    return _models[key]


def _by_batch(df: DataFrame, model: bytes, kind: str, schema: str) -> DataFrame:
    sent = df.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", *(["ids"] if kind != "decode" else []), *(["decoded"] if kind != "encode" else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(sent.value)
        for b in batches:
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                if kind == "decode":
                    ids = [x or [] for x in part.column(1).to_pylist()]
                    coded = []
                else:
                    arrays = [p.encode(x.as_py() or "") for x in part.column(1)]
                    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
                    coded = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays)))]
                    ids = (x.tolist() for x in arrays)
                decoded = [pa.array([p.decode(x) for x in ids], pa.string())] if kind != "encode" else []
                yield pa.RecordBatch.from_arrays([part.column(0), *coded, *decoded], names=names)

    return df.mapInArrow(run, schema)


def encode(docs: DataFrame, model: bytes | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id and ids (array of int), the end id last."""
    df = columns(docs, doc_id=id_col, text=text_col)
    return _by_batch(df, model or load_model(), "encode", f"doc_id {dict(df.dtypes)['doc_id']}, ids array<int>")


def decode(encoded: DataFrame, model: bytes | None = None) -> DataFrame:
    """Per row of :func:`encode`'s result: doc_id and decoded (string)."""
    df = columns(encoded, doc_id="doc_id", ids="ids")
    return _by_batch(df, model or load_model(), "decode", f"doc_id {dict(df.dtypes)['doc_id']}, decoded string")


def round_trip(docs: DataFrame, model: bytes | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, ids, and decoded, which is made from the ids; both in one pass of one worker."""
    df = columns(docs, doc_id=id_col, text=text_col)
    return _by_batch(df, model or load_model(), "both", f"doc_id {dict(df.dtypes)['doc_id']}, ids array<int>, decoded string")
