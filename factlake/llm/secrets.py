"""Secret scans: fixed patterns, and a character convolutional network over every candidate and its context.

The patterns find assignments (``assign``), access keys (``access``) and long hexadecimal strings (``hex``); their
findings always stay.  Every candidate, which is each of them and each string of 16 or more letters, digits and signs, is scored
by the network, which sees all of it, in overlapping windows of ``INSIDE`` characters, and ``AROUND`` on either side, some at a time;
candidates that no pattern found and that score above the threshold are added as ``model``.

The network is embedding, one convolution, maximum over the candidate and over its context apart, one hidden layer and
a logit, in numpy.  It is trained on labelled findings that a seeded rule makes (the corpus has no such labels),
``EXAMPLES`` of them; a logistic curve fitted to held-out findings calibrates its scores, and the threshold is the
largest that keeps ``RECALL`` of the held-out secrets.  The same seed gives the same network.

Shorter strings that no pattern finds aren't candidates: they have too few characters to tell a secret from a word, and in prose
nearly all strings are shorter.  What touches a pattern's finding is a part of it and isn't scored again.

Defined cases: a null or empty text has no findings.  Texts are scanned whole at any length.  Overlapping findings of
different kinds are all reported; of one kind, the leftmost stay.  Repeated rows are scanned one by one; an empty
table gives an empty table.  Positions are code points, end exclusive.  Other columns don't clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns

KINDS = ("assign", "access", "hex", "model")
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_LONG = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_ALNUM = re.compile(r"[A-Za-z0-9]")
_WORDS = ("passw", "secret", "token", "api")
_HEX_ONLY = bytes(120 if c in b"0123456789abcdef" else 32 for c in range(256))
INSIDE, AROUND = 48, 24
EXAMPLES, RECALL, SEED = 6000, 0.98, 29
#: Windows that go through the network at a time.
WINDOWS = 512
#: Rows whose texts a worker holds at a time.
SLICE = 256
_WIDTH = INSIDE + 2 * AROUND
_DIM, _SPAN, _FILTERS, _HIDDEN = 12, 5, 24, 16


class Finding(NamedTuple):
    kind: str
    start: int
    end: int


def base_findings(text: str) -> list[Finding]:
    """What the patterns find, in the order of start, then kind."""
    out = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        out += [Finding("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [Finding("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    if b"x" * 24 in text.encode().translate(_HEX_ONLY):
        out += [Finding("hex", *m.span()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda f: (f.start, KINDS.index(f.kind), f.end))


def more_candidates(text: str, found: list[Finding]) -> list[Finding]:
    """Long strings of letters, digits and signs that touch no finding (``found``, by start)."""
    out, next_at, reach = [], 0, 0
    for m in _LONG.finditer(text):
        while next_at < len(found) and found[next_at].start < m.end():
            reach = max(reach, found[next_at].end)
            next_at += 1
        if reach <= m.start() and _ALNUM.search(text, m.start(), m.end()):
            out.append(Finding("model", *m.span()))
    return out


# the network ---------------------------------------------------------------------------------------------------------

_CODE = np.full(128, 5, dtype=np.uint8)
for _i, _c in enumerate("\n\t \"'=:;,.-_/+@#<>()[]{}|&%$*!?"):
    _CODE[ord(_c)] = 6 + _i
_CODE[ord("0") : ord("9") + 1] = 40 + np.arange(10)
_CODE[ord("a") : ord("z") + 1] = 50 + np.arange(26)
_CODE[ord("A") : ord("Z") + 1] = 76 + np.arange(26)
_SYMBOLS = 104


def _codes_of(s: str) -> np.ndarray:
    at = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where(at < 128, _CODE[np.minimum(at, 127)], 4).astype(np.uint8)


def window_blocks(text: str, start: int, end: int) -> Iterator[np.ndarray]:
    """A row for each window of the candidate, which is in the middle, with its context on either side; windows overlap by what
    a convolution spans, the last ends with the candidate.  0 where there is nothing, 4 for other scripts.  ``WINDOWS`` at a time."""
    before, after = _codes_of(text[max(0, start - AROUND) : start]), _codes_of(text[end : end + AROUND])
    step, last = INSIDE - _SPAN + 1, max(start, end - INSIDE)
    regular = max(1, -(-(last - start) // step))  # windows that begin at start, start + step, ... before the last
    every = regular + (end - (start + (regular - 1) * step) > INSIDE)
    for low in range(0, every, WINDOWS):
        firsts = np.minimum(start + np.arange(low, min(every, low + WINDOWS)) * step, last)
        part = _codes_of(text[firsts[0] : min(end, firsts[-1] + INSIDE)])
        inside = np.zeros(firsts[-1] - firsts[0] + INSIDE, dtype=np.uint8)
        inside[: len(part)] = part
        out = np.zeros((len(firsts), _WIDTH), dtype=np.uint8)
        out[:, AROUND - len(before) : AROUND] = before
        out[:, AROUND : AROUND + INSIDE] = np.lib.stride_tricks.sliding_window_view(inside, INSIDE)[firsts - firsts[0]]
        out[:, AROUND + INSIDE : AROUND + INSIDE + len(after)] = after
        yield out


def codes(text: str, start: int, end: int) -> np.ndarray:
    """All windows of a candidate."""
    return np.concatenate(list(window_blocks(text, start, end)))


def stack(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The windows of several candidates in one array, and where each candidate's begin."""
    sizes = [len(r) for r in rows]
    return np.concatenate(rows), np.concatenate([[0], np.cumsum(sizes[:-1], dtype=np.int64)]).astype(np.int64)


def _examples(n: int, seed: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Labelled findings by rule: secrets of several shapes in prose or code, and long strings that are none."""
    rng = np.random.default_rng(seed)
    pick = lambda s: s[rng.integers(len(s))]
    chars = lambda alphabet, n: "".join(alphabet[i] for i in rng.integers(len(alphabet), size=n))
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    parts = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()
    word = lambda: "".join(pick(parts) for _ in range(rng.integers(1, 6)))
    prose = lambda: " ".join(word() for _ in range(rng.integers(1, 8)))
    mixed = lower + upper + digits
    vowels, consonants = "a e i o u ai au ei eau ie io oi ou".split(), "b c ch d f g h l m n nd ng nt p qu r rt s sch st t th tr v z".split()
    german = "ab an auf aus be ber ch ein ent er es ge heit in isch keit lich los mit nach nicht pf sam sch schaft schen st tz und ung ver von vor zer zu".split()
    romance = "ado al an ar ción ci con des e en es ie ion la le men ment o os ou par que re si so ta te ti tion tra un ve".replace("ó", "o").split()
    x, y = [], []
    for _ in range(n):
        secret = bool(rng.integers(2))
        if secret:
            key = pick(["key", "token", "secret", "auth", "bearer", "pwd", "credential", "access", "private"])
            body = [
                lambda: chars("0123456789abcdef", int(rng.integers(24, 65))),
                lambda: chars(mixed, int(rng.integers(20, 48))),
                lambda: chars(mixed + "+/", int(rng.integers(24, 64))) + pick(["", "=", "=="]),
                lambda: "AKIA" + chars(upper + digits, 16),
                lambda: pick(["ghp_", "sk-", "xoxb-", "pk_live_", "glpat-"]) + chars(mixed, int(rng.integers(20, 40))),
                lambda: chars(lower + upper, int(rng.integers(20, 120))),
                lambda: chars(mixed + "+/", int(rng.integers(64, 300))),
            ][rng.integers(7)]()
            before = prose() + pick([" ", "\n", ", "]) + pick(["", key + pick([" = \"", ": ", "=", " '", "\": \""])])
            after = pick(["\"", "'", " ", "\n", ";"]) + prose()
        else:
            body = [
                lambda: "-".join(word() for _ in range(4)) + "-" + chars(digits, 2),
                lambda: word() + "/" + word() + "/" + chars(digits, int(rng.integers(2, 5))) + "/" + word() + "-" + word(),
                lambda: "20" + chars(digits, 2) + "-" + chars("01", 2) + "-" + chars("012", 2) + "T" + chars(digits, 6),
                lambda: word() + word() + word() + chars(digits, int(rng.integers(2, 4))),
                lambda: "_".join([word(), word(), word(), chars(digits, 2)]),
                lambda: chars(digits, int(rng.integers(14, 24))) + pick(lower),
                lambda: word().capitalize() + word().capitalize() + word().capitalize() + chars(digits, 2),
                lambda: pick([str.lower, str.capitalize, str.upper])("".join(pick(vowels) + pick(consonants) for _ in range(rng.integers(8, 16)))),
                lambda: pick([str.lower, str.capitalize, str.upper])("".join(word() for _ in range(rng.integers(3, 9)))),
                lambda: pick([str.lower, str.capitalize])("".join(pick(german) for _ in range(rng.integers(3, 9)))),
                lambda: pick([str.lower, str.capitalize])("".join(pick(romance) for _ in range(rng.integers(4, 10)))),
                lambda: "/".join(word() for _ in range(rng.integers(3, 40))),
                lambda: "".join(word().capitalize() for _ in range(rng.integers(2, 6))),
                lambda: pick("-=_") * int(rng.integers(16, 80)),
            ][rng.integers(14)]
            hexadecimal, base64 = "0123456789abcdef", mixed + "+/"
            before = prose() + pick([" ", "\n", " (", "/", ": "])
            if rng.integers(4) == 0:
                # payloads, checksums and identifiers, which what stands before them tells
                told, body = [
                    (pick(["sha256:", "sha1 ", "md5: ", "checksum ", "SHA-256 = ", "commit ", "digest: ", "blob "]), lambda: chars(hexadecimal, int(pick([32, 40, 64])))),
                    (pick(['integrity="sha512-', "integrity: sha384-", "sha256-"]), lambda: chars(base64, int(pick([43, 64, 86]))) + pick(["", "=", "=="])),
                    (pick(["data:image/png;base64,", "data:font/woff2;base64,", "src=data:image/gif;base64,"]), lambda: pick(["iVBORw0KGgo", "R0lGODlh", "d09GMg", ""]) + chars(base64, int(rng.integers(40, 300)))),
                    (pick(["id ", "uuid: ", "request ", "urn:uuid:"]), lambda: "-".join(chars(hexadecimal, n) for n in (8, 4, 4, 4, 12))),
                    (pick(["", "alphabet ", "digits: "]), lambda: pick([upper + lower + digits, lower + digits, digits + lower, upper + lower + digits + "+/", digits * 3, lower * 2])),
                ][rng.integers(5)]
                before += told
            after = pick([" ", ".", ", ", "\n", ")"]) + prose()
            body = body()
        text = before + body + after
        x.append(codes(text, len(before), len(before) + len(body)))
        y.append(secret)
    return x, np.array(y, dtype=float)


class Network:
    """Weights, forward pass, training step; the same for the same seed."""

    def __init__(self, seed: int) -> None:
        rng = np.random.default_rng(seed)
        draw = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32)
        self.w = [
            rng.normal(0, 0.5, (_SYMBOLS, _DIM)).astype(np.float32),
            draw(_SPAN * _DIM, _FILTERS), np.zeros(_FILTERS, np.float32),
            draw(2 * _FILTERS, _HIDDEN), np.zeros(_HIDDEN, np.float32),
            draw(_HIDDEN, 1), np.zeros(1, np.float32),
        ]
        self.curve, self.threshold = (1.0, 0.0), 0.5

    def tops(self, x: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Of each window the maxima of all filters within the candidate and around it."""
        emb, conv, conv_b = self.w[:3]
        e = emb[x]
        windows = np.lib.stride_tricks.sliding_window_view(e, _SPAN, axis=1).transpose(0, 1, 3, 2)
        flat = np.ascontiguousarray(windows).reshape(len(x), _WIDTH - _SPAN + 1, _SPAN * _DIM)
        h = np.maximum(flat @ conv + conv_b, 0)
        inside = slice(AROUND, AROUND + INSIDE - _SPAN + 1)
        outside = np.r_[0:AROUND, AROUND + INSIDE - _SPAN + 1 : h.shape[1]]
        if keep is not None:
            keep.update(flat=flat, at=np.concatenate([h[:, inside].argmax(1) + AROUND, outside[h[:, outside].argmax(1)]], axis=1))
        return np.concatenate([h[:, inside].max(1), h[:, outside].max(1)], axis=1)

    def head(self, pooled: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """A logit from the maxima over all windows of a candidate."""
        w1, b1, w2, b2 = self.w[3:]
        z = np.maximum(pooled @ w1 + b1, 0)
        if keep is not None:
            keep.update(pooled=pooled, z=z)
        return (z @ w2 + b2)[:, 0]

    def logits(self, x: np.ndarray, starts: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Of each candidate, whose windows begin at ``starts``: maxima go over all of its windows, so over any length."""
        tops = self.tops(x, keep)
        if keep is not None:
            of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(x))))
            # of each candidate and filter the window with the maximum, the first of equals
            rows = np.stack([np.lexsort((-tops[:, j], of))[starts] for j in range(tops.shape[1])], axis=1)
            keep.update(rows=rows, at=np.take_along_axis(keep["at"], rows, axis=0))
        return self.head(np.maximum.reduceat(tops, starts, axis=0), keep)

    def gradients(self, x: np.ndarray, starts: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        k: dict = {}
        p = 1 / (1 + np.exp(-self.logits(x, starts, k)))
        emb, conv, _, w1, _, w2, _ = self.w
        d = ((p - y) / len(y)).astype(np.float32)[:, None]
        gz = (d @ w2.T) * (k["z"] > 0)
        gp = (gz @ w1.T) * (k["pooled"] > 0)
        g_emb, g_conv, g_b = np.zeros_like(emb), np.zeros_like(conv), np.zeros(_FILTERS, np.float32)
        for j in range(2 * _FILTERS):
            f, at, g, rows = j % _FILTERS, k["at"][:, j], gp[:, j], k["rows"][:, j]
            g_conv[:, f] += g @ k["flat"][rows, at]
            g_b[f] += g.sum()
            back = g[:, None] * conv[:, f]
            for s in range(_SPAN):
                np.add.at(g_emb, x[rows, at + s], back[:, s * _DIM : (s + 1) * _DIM])
        return [g_emb, g_conv, g_b, k["pooled"].T @ gz, gz.sum(0), k["z"].T @ d, d.sum(0)]

    def scores(self, n: int, blocks: Iterable[tuple[int, np.ndarray]]) -> np.ndarray:
        """Calibrated probabilities of n candidates, given (candidate, some of its windows) in any number of parts.

        Maxima of parts have the same maximum as the whole, so a candidate of any length takes the room of ``WINDOWS`` windows.
        Scores are rounded, so that they don't depend on what stands in the same batch.
        """
        pooled = np.zeros((n, 2 * _FILTERS), dtype=np.float32)  # nothing is below 0
        part: list[tuple[int, np.ndarray]] = []
        held = 0

        def work() -> None:
            if part:
                tops = self.tops(np.concatenate([x for _, x in part]))
                np.maximum.at(pooled, np.repeat([i for i, _ in part], [len(x) for _, x in part]), tops)

        for i, x in blocks:
            part.append((i, x))
            held += len(x)
            if held >= WINDOWS:
                work()
                part, held = [], 0
        work()
        a, b = self.curve
        return np.round(1 / (1 + np.exp(-(a * self.head(pooled).astype(float) + b))), 4)


def train(n: int = EXAMPLES, seed: int = SEED, epochs: int = 4, recall: float = RECALL) -> Network:
    """Train on three quarters of the labelled findings, calibrate and set the threshold on the rest."""
    x, y = _examples(n, seed)
    cut = n * 3 // 4
    net = Network(seed)
    m = [np.zeros_like(w) for w in net.w]
    v = [np.zeros_like(w) for w in net.w]
    rng, step = np.random.default_rng(seed + 1), 0
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(cut), max(1, cut // 64)):
            step += 1
            for i, g in enumerate(net.gradients(*stack([x[r] for r in rows]), y[rows])):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                net.w[i] -= (0.005 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    z, t = net.logits(*stack(x[cut:])).astype(float), y[cut:]
    a, b = 1.0, 0.0
    for _ in range(300):
        p = 1 / (1 + np.exp(-(a * z + b)))
        a, b = a - 0.1 * np.mean((p - t) * z) - 1e-3 * a, b - 0.1 * np.mean(p - t)
    net.curve = (float(a), float(b))
    kept = np.sort(net.scores(n - cut, enumerate(x[cut:]))[t > 0])
    net.threshold = float(kept[int((1 - recall) * len(kept))])
    return net


_network: dict[tuple, Network] = {}


def network(**parameters: float) -> Network:
    """The network of these parameters, trained once in a process."""
    key = tuple(sorted(parameters.items()))
    if key not in _network:
        _network[key] = train(**parameters)
    return _network[key]


# over documents ------------------------------------------------------------------------------------------------------


def find(texts: list[str], net: Network) -> list[tuple[list[Finding], list[float]]]:
    """All findings of each text and the network's score of each; candidates of all texts are scored together."""
    found = [base_findings(t) for t in texts]
    every = [f + more_candidates(t, f) for t, f in zip(texts, found)]
    placed = [(t, c) for t, cs in zip(texts, every) for c in cs]
    scores = net.scores(len(placed), ((i, x) for i, (t, c) in enumerate(placed) for x in window_blocks(t, c.start, c.end)))
    out, at = [], 0
    for cs in every:
        kept = [(c, float(s)) for c, s in zip(cs, scores[at : at + len(cs)]) if c.kind != "model" or s >= net.threshold]
        kept.sort(key=lambda z: (z[0].start, KINDS.index(z[0].kind), z[0].end))
        out.append(([c for c, _ in kept], [s for _, s in kept]))
        at += len(cs)
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters: float) -> DataFrame:
    """Per row: doc_id and findings, an array of (kind, start, end, score)."""
    df = columns(docs, doc_id=id_col, text=text_col)
    sent = df.sparkSession.sparkContext.broadcast(network(**parameters))
    item = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                part = b.slice(at, SLICE)
                rows = find([t or "" for t in part.column(1).to_pylist()], sent.value)
                made = [[{"kind": f.kind, "start": f.start, "end": f.end, "score": s} for f, s in zip(*r)] for r in rows]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.list_(item))], names=["doc_id", "findings"])

    kind = dict(df.dtypes)["doc_id"]
    return df.mapInArrow(run, f"doc_id {kind}, findings array<struct<kind:string,start:int,end:int,score:double>>")


def redact(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars", mark: str = "[secret]", **parameters: float) -> DataFrame:
    """``docs`` with each run of findings in the text replaced by ``mark``, and the length column, if any, renewed."""
    sent = docs.sparkSession.sparkContext.broadcast(network(**parameters))
    at = docs.columns.index(text_col)

    def clean(text: str, found: list[Finding]) -> str:
        out, done = [], 0
        for f in found:
            if f.start >= done:
                out += [text[done : f.start], mark]
            done = max(done, f.end)
        return "".join(out) + text[done:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, SLICE):
                part = b.slice(i, SLICE)
                texts = part.column(at).to_pylist()
                found = find([t or "" for t in texts], sent.value)
                made = [t if t is None else clean(t, f) for t, (f, _) in zip(texts, found)]
                cols = list(part.columns)
                cols[at] = pa.array(made, pa.string())
                yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)

    out = docs.mapInArrow(run, docs.schema)
    if length_col in docs.columns:
        out = out.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType))
    return out

