"""Importance resampling, SentencePiece coding and spelling variants against brute force and the library."""

import collections
import hashlib
import math
import random
import re
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from factlake.llm import pieces, resample, spelling

small = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
DOCS = "doc_id long, text string"


def brute_resample(docs, target, orders, buckets):
    def grams(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", small(t))
        return w, [crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, orders + 1) for i in range(len(w) - n + 1)]

    s, t = collections.Counter(), collections.Counter()
    for _, text in docs:
        s.update(grams(text)[1])
    for text in target:
        t.update(grams(text)[1])
    all_s, all_t = float(sum(s.values())), float(sum(t.values()))
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (all_s + buckets) / ((s[b] + 1.0) * (all_t + buckets)))) for b in s}
    rows = []
    for i, text in docs:
        words, found = grams(text)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        rows.append((i, len(words), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    drawn = 10 * sum(r[1] >= 20 for r in rows) // 100
    order = sorted((k for k, r in enumerate(rows) if r[1] >= 20), key=lambda k: (-rows[k][4], rows[k][0] is None, rows[k][0] or 0))
    rank = {k: n + 1 for n, k in enumerate(order[:drawn])}
    return collections.Counter((*r, rank.get(k)) for k, r in enumerate(rows))


@pytest.mark.parametrize("orders", [1, 2, 3])
def test_resample(spark, orders, monkeypatch):
    monkeypatch.setattr(resample, "BLOCK", 16)
    rng = random.Random(orders)
    word = lambda: rng.choice(["the", "The", "Ünder", "a1", "x", "日本", "mix", "day", "İ", "ÀB"])
    texts = [rng.choice([" ", "-", "\n", "; "]).join(word() for _ in range(rng.choice([0, 1, 15, 16, 17, 18, 33, 40, 200]))) for _ in range(150)]
    docs = [*enumerate(texts), (3, texts[3]), (3, texts[3]), (None, "day mix " * 12), (None, "day mix " * 12), (900, None), (901, " .-\t"), (902, "one")]
    target = ["the day the x day", None, "", "Mix mix_mix"]
    made = spark.createDataFrame([(*d, "c", 1) for d in docs], DOCS + ", words string, row int").repartition(5)
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    got = resample.resample(made, wanted, orders, 500)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert collections.Counter(map(tuple, got.collect())) == brute_resample(docs, target, orders, 500)
    if orders == 1:
        empty = resample.resample(made, wanted.limit(0), 1, 500).collect()
        assert collections.Counter(map(tuple, empty)) == brute_resample(docs, [], 1, 500)
    else:
        assert resample.resample(made.limit(0), wanted, orders, 500).collect() == []


def test_ranked_is_one_order_over_partitions(spark):
    rows = spark.range(1000).select((F.col("id") % 7).alias("a"), "id")
    got = sorted((r["rank"], -r.a, r.id) for r in resample.ranked(rows, F.desc("a"), F.asc("id")).collect())
    assert [g[0] for g in got] == list(range(1, 1001)) and got == sorted(got, key=lambda g: (g[1], g[2]))


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())


def test_pieces_agree_with_the_library(library):
    p = pieces.Pieces(pieces.load_model())
    rng = random.Random(2)
    parts = ["a", "b", " ", "▁", "e", "\n", "the", "in", "1", "é", "\U0001f600", " ", "ß", "日", "本語", "—", ".", "ing", "  ", "\x00", "<s>", "</s>", "<0x0A>", "\r"]
    some = list(p.id)
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(4000)]
    texts += ["".join(rng.choice(some) for _ in range(rng.randrange(8))).replace("▁", rng.choice(" ▁")) for _ in range(4000)]
    texts += ["".join(chr(rng.randrange(1, 0x3000)) for _ in range(rng.randrange(20))) for _ in range(2000)]
    texts += ["", " ", " " * 50, "x" * 30_000, "".join(rng.choice("abcdefgh") for _ in range(30_000)), "\x00" * 70]
    for t in texts:
        ids = p.encode(t).tolist()
        assert ids == library.encode(t, add_eos=True), repr(t)
        assert p.decode(ids) == library.decode(ids), repr(t)
    for _ in range(2000):
        ids = [rng.choice([rng.randrange(259), rng.randrange(32000), 28705, rng.randrange(195, 258)]) for _ in range(rng.randrange(6))]
        assert p.decode(ids) == library.decode(ids), ids


def test_pieces_bounds_change_nothing(library, monkeypatch):
    for name, n in (("BLOCK", 7), ("KEPT_UNITS", 3), ("KEPT_PAIRS", 3), ("KEPT_LENGTH", 4)):
        monkeypatch.setattr(pieces, name, n)
    p = pieces.Pieces(pieces.load_model())
    rng = random.Random(3)
    for _ in range(300):
        t = "".join(rng.choice(["word", " ", "   ", "\n", "é", " ", "long" * 5]) for _ in range(40))
        assert p.encode(t).tolist() == library.encode(t, add_eos=True)


def test_pieces_of_tables(spark, library):
    rows = [(1, "One text, and more.", "c"), (1, "One text, and more.", "c"), (2, None, "c"), (3, "", None), (None, "no id", "c"), (4, "x y " * 40_000, "c")]
    docs = spark.createDataFrame(rows, DOCS + ", ids string")
    got = pieces.round_trip(docs)
    want = collections.Counter((i, tuple(library.encode(t or "", add_eos=True)), library.decode(library.encode(t or ""))) for i, t, _ in rows)
    assert collections.Counter((r.doc_id, tuple(r.ids), r.decoded) for r in got.collect()) == want
    apart = pieces.decode(pieces.encode(docs))
    assert collections.Counter(map(tuple, apart.collect())) == collections.Counter((i, t) for i, _, t in want.elements())
    assert pieces.round_trip(docs.limit(0)).collect() == []


def test_other_models_are_refused():
    model = pieces.load_model()
    # a second trainer message says that the model is a unigram one
    with pytest.raises(ValueError):
        pieces.Pieces(model + bytes([0x12, 2, 3 << 3, 1]))


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_spelling(docs, length, count, typos, ratio):
    n = collections.Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = small(run)
            h = crc32(f"{'' if i is None else i}:{run}".encode())
            if typos and h % typos == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= length:
                n[run] += 1
    n = {w: c for w, c in n.items() if c >= count}
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, n[w], len(near[w]), form[w], n[form[w]] if form[w] is not None else None, root))
    return out


@pytest.mark.parametrize("crowd,alphabet,length", [(48, "abé", 3), (1, "ab", 2), (2, "abÿÀ", 4)])
def test_spelling(spark, crowd, alphabet, length):
    rng = random.Random(crowd)
    # few letters: nearly all words of a length meet, lists are long, and chains of forms arise
    words = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 8))) for _ in range(120)]
    docs = [(i, " ".join(w if rng.random() < 0.8 else w.title() for w in rng.choices(words, [3.0 ** (k % 7) for k in range(120)], k=60))) for i in range(60)]
    docs += [(None, "abab abab-abab" * 3), (7, None), (8, ""), (9, "1234 _ ×÷"), (5, docs[5][1]), (10, "ab" * 3000 + " " + "ab" * 3000 + "a " + "ab" * 3000)]
    made = spark.createDataFrame([(*d, "x", "y") for d in docs], DOCS + ", word string, key string")
    got = spelling.spelling_variants(made, length, 2, 5, 3, crowd)
    rows = [tuple(r) for r in got.collect()]
    assert got.columns == ["word", "n", "n_near", "form", "form_n", "root"]
    want = brute_spelling(docs, length, 2, 5, 3)
    assert len(rows) == len(set(rows)) and set(rows) == want
    assert any(r[3] and r[5] != r[3] for r in want) and any(r[3] is None and r[2] for r in want)


def test_spelling_of_nothing(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "short words only")], DOCS)
    assert spelling.spelling_variants(docs).collect() == [] and spelling.spelling_variants(docs.limit(0)).collect() == []
