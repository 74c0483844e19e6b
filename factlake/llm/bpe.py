"""BPE encoding and decoding of whole texts with a public byte-level vocabulary.

Encoding walks a trie of distinct words.  The state of a trie node, which is a prefix of some words, is the last token
of that prefix's encoding: the one vocabulary entry t that ends the prefix and may follow the last token u of the
prefix before it, which holds when the merges turn the bytes of u and t into just u and t.  A node's state follows
from its ancestors' states alone, so a depth-first walk finds the encoding of every shared prefix once.  The trie is
held as the sorted words and the path to the current node as a stack.  Encodings of words are kept for the next texts.

Defined cases: a null text is encoded as an empty one (no tokens).  Texts of any length are encoded whole: a text is
split by the vocabulary's pattern, and a piece of any length takes one stack entry per byte.  Strings of special
tokens in a text become those tokens, as the tokenizers library does.  Repeated rows are encoded one by one; an empty
table gives an empty table.  Only the id and the text of the input are read; other columns don't clash.
"""

from __future__ import annotations

import json
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import columns

#: Words of one of the two generations whose encodings a worker keeps, and pairs of tokens (some 70 MB in all); the words
#: that no text has held for a generation are forgotten (results don't depend on it).
KEPT_WORDS = 120_000
KEPT_PAIRS = 300_000
#: Characters of text whose distinct words make one trie.
TRIE_CHARS = 2_000_000


def default_vocabulary() -> str:
    """The path of the 50k byte-level vocabulary among the public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def load_vocabulary(path: str | None = None) -> bytes:
    """The bytes of a tokenizer file (1.5 MB): read on the driver and sent along with the tasks."""
    with open(path or default_vocabulary(), "rb") as f:
        return f.read()


def _byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """One vocabulary with its pattern, and what has been encoded so far."""

    def __init__(self, vocabulary: bytes) -> None:
        import regex

        spec = json.loads(vocabulary)
        byte_of = _byte_alphabet()
        raw = lambda s: bytes(byte_of[c] for c in s)
        ids = {raw(s): i for s, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pieces: list[bytes] = [b""] * (1 + max([*ids.values(), *self.special.values()]))
        for b, i in ids.items():
            self.pieces[i] = b
        for s, i in self.special.items():
            self.pieces[i] = s.encode()
        #: For a pair of ids, when it is merged; for an id, when it was made (-1: a byte) and from what.
        self.rank: dict[int, int] = {}
        self.made, self.left, self.right = ([-1] * len(self.pieces) for _ in range(3))
        for n, merge in enumerate(spec["model"]["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            u, t, both = ids[raw(a)], ids[raw(b)], ids[raw(a) + raw(b)]
            self.rank[u << 32 | t] = n
            self.made[both], self.left[both], self.right[both] = n, u, t
        sound = [self.made[i] < 0 and len(b) == 1 for i, b in enumerate(self.pieces)]
        for i in sorted((i for i, n in enumerate(self.made) if n >= 0), key=self.made.__getitem__):
            u, t = self.left[i], self.right[i]
            sound[i] = sound[u] and sound[t] and self._apart(u, t, self.made[i])
        #: Entries that the merges make from their own bytes, and so may end a prefix.
        self.ids = {b: i for b, i in ids.items() if sound[i]}
        #: What some entry begins with: a suffix of a prefix that isn't in here begins no token that ends farther on.
        self.begins = {b[:n] for b in self.ids for n in range(1, len(b) + 1)}
        self.sizes = [len(b) for b in self.pieces]
        self.lengths = np.array(self.sizes, dtype=np.int64)
        self.follows: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pattern = regex.compile(
            r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        )
        self.specials = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None

    def _apart(self, u: int, t: int, until: int) -> bool:
        """Whether the merges before number ``until`` leave u and t, side by side, as they are.

        A token's parts are made before it is, so merges happen in the order of their numbers.  Going back in time,
        the tokens at either side of the boundary are taken apart, the later made one first; the two that meet there
        would be merged if their merge comes before either is used up (at the left by an equal number: leftmost first).
        """
        rank, made = self.rank, self.made
        end_u = end_t = until
        while True:
            n = rank.get(u << 32 | t)
            if n is not None and n < end_u and n <= end_t and n < until:
                return False
            if made[u] > made[t]:
                end_u, u = made[u], self.right[u]
            elif made[t] >= 0:
                end_t, t = made[t], self.left[t]
            else:
                return True

    def _may_follow(self, u: int, t: int) -> bool:
        known = self.follows[u << 32 | t] = self._apart(u, t, 1 << 62)
        return known

    def learn(self, words: set[str]) -> None:
        """Encode the words that aren't known, in one walk of their trie."""
        if len(self.follows) > KEPT_PAIRS:
            self.follows.clear()
        ids, follows, begins, sizes = self.ids, self.follows, self.begins, self.sizes
        known = self.known
        path = b""
        #: For each prefix of the path its last token, and where the longest suffix starts that an entry begins with.
        last: list[int] = [-1]
        low: list[int] = [0]
        for data, word in sorted((w.encode(), w) for w in words):
            n, shared, end = len(data), 0, min(len(data), len(path))
            if data[:end] == path[:end]:
                shared = end
            else:
                while data[shared] == path[shared]:
                    shared += 1
            del last[shared + 1 :]
            del low[shared + 1 :]
            first = low[shared]
            for stop in range(shared + 1, n + 1):
                while data[first:stop] not in begins:
                    first += 1
                low.append(first)
                for start in range(first, stop):
                    t = ids.get(data[start:stop])
                    if t is not None:
                        u = last[start]
                        if u < 0:
                            break
                        ok = follows.get(u << 32 | t)
                        if ok or (ok is None and self._may_follow(u, t)):
                            break
                else:
                    raise AssertionError("every prefix ends in one token")
                last.append(t)
            path = data
            out, stop = [], n
            while stop:
                t = last[stop]
                out.append(t)
                stop -= sizes[t]
            out.reverse()
            known[word] = array("I", out).tobytes()

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        at = 0
        while at < len(texts):
            group: list[list[str | bytes]] = []
            chars, words = 0, set()
            while at < len(texts) and (not group or chars < TRIE_CHARS):
                text = texts[at]
                pieces = self._split(text)
                group.append(pieces)
                words.update(pieces)
                chars += len(text)
                at += 1
            if len(self.known) > KEPT_WORDS:
                self.known, self.older = {}, self.known
            known, older = self.known, self.older
            missing = set()
            for w in words:
                if w not in known:
                    ids = older.get(w)
                    if ids is not None:
                        known[w] = ids
                    elif isinstance(w, str):
                        missing.add(w)
            if missing:
                self.learn(missing)
            del words, missing
            for pieces in group:
                try:
                    yield b"".join([known[w] for w in pieces])
                except KeyError:
                    yield b"".join([w if isinstance(w, bytes) else known[w] for w in pieces])

    def _split(self, text: str) -> list[str | bytes]:
        if self.specials is None or not self.specials.search(text):
            return self.pattern.findall(text)
        out: list[str | bytes] = []
        start = 0
        for m in self.specials.finditer(text):
            out += self.pattern.findall(text[start : m.start()])
            out.append(struct.pack("<I", self.special[m[0]]))
            start = m.end()
        return out + self.pattern.findall(text[start:])

    def decode(self, ids: bytes) -> str:
        """The text of ids: the bytes of all tokens in a row, read as UTF-8."""
        pieces = self.pieces
        return b"".join([pieces[i] for i in np.frombuffer(ids, dtype="<u4").tolist()]).decode("utf-8", "replace")


_encoders: dict[int, Encoder] = {}


def encoder(vocabulary: bytes) -> Encoder:
    """The encoder of a vocabulary, one for each worker process."""
    key = hash(vocabulary)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(vocabulary)
    return _encoders[key]


def _by_batch(df: DataFrame, vocabulary: bytes, kind: str, schema: str) -> DataFrame:
    sent = df.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(sent.value)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                cols = [part.column(0)]
                if kind == "decode":
                    ids = [x or b"" for x in part.column(1).to_pylist()]
                else:
                    ids = list(enc.encode([x or "" for x in part.column(1).to_pylist()]))
                    cols.append(pa.array(ids, pa.binary()))
                if kind != "encode":
                    cols.append(pa.array([enc.decode(x) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "ids", "decoded"][: len(cols)] if kind != "decode" else ["doc_id", "decoded"])

    return df.mapInArrow(run, schema)


def encode(docs: DataFrame, vocabulary: bytes | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id and ids (binary, little-endian unsigned 32-bit)."""
    df = columns(docs, doc_id=id_col, text=text_col)
    kind = dict(df.dtypes)["doc_id"]
    return _by_batch(df, vocabulary or load_vocabulary(), "encode", f"doc_id {kind}, ids binary")


def decode(encoded: DataFrame, vocabulary: bytes | None = None) -> DataFrame:
    """Per row of :func:`encode`'s result: doc_id and decoded (string)."""
    df = columns(encoded, doc_id="doc_id", ids="ids")
    kind = dict(df.dtypes)["doc_id"]
    return _by_batch(df, vocabulary or load_vocabulary(), "decode", f"doc_id {kind}, decoded string")


def round_trip(docs: DataFrame, vocabulary: bytes | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, ids, and decoded, which is made from the ids; both in one pass of one worker."""
    df = columns(docs, doc_id=id_col, text=text_col)
    kind = dict(df.dtypes)["doc_id"]
    return _by_batch(df, vocabulary or load_vocabulary(), "both", f"doc_id {kind}, ids binary, decoded string")
