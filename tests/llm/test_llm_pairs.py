"""Near-duplicates, repeated substrings and nearest neighbours against brute force; the pipeline."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest

from factlake.llm import ann, neardup, substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def components(docs):
    sets = {i: shingles(t) for i, t in docs}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    inverted = collections.defaultdict(list)
    for i in ids:
        for s in sets[i]:
            inverted[s].append(i)
    shared = collections.Counter()
    for members in inverted.values():
        for n, b in enumerate(members):
            for a in members[:n]:
                shared[a, b] += 1
    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {i: find(i) for i in ids}, {i: len(s) for i, s in sets.items()}


def near_corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(60)]
    base = [word() for _ in range(150)]
    docs = []
    for i in range(140):  # a group of near copies, some farther away than others
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 6, 9])):
            w[rng.randrange(len(w))] = word()
        docs.append(" ".join(w))
    docs += [" ".join(passage + [word() for _ in range(rng.randrange(8, 90))]) for _ in range(90)]
    docs += [" ".join(word() for _ in range(rng.randrange(1, 300))) for _ in range(60)]
    docs += [docs[3], docs[3].upper(), "a b c", "A  b\nc", "a b", "", None, "   "]
    order = list(range(len(docs)))
    rng.shuffle(order)
    return list(zip(order, docs))


@pytest.mark.parametrize(("crowd", "meetings"), [(64, 2), (8, 0)])
def test_near_duplicates(spark, monkeypatch, crowd, meetings):
    monkeypatch.setattr(neardup, "CROWD", crowd)
    monkeypatch.setattr(neardup, "MEETINGS", meetings)
    docs = near_corpus(crowd)
    want, sizes = components(docs)
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, sig string")
    got = neardup.near_duplicates(df).collect()
    assert len(got) == len(docs)
    for r in got:
        assert (r.component_id, r.n_shingles, r.kept) == (want[r.doc_id], sizes[r.doc_id], r.doc_id == want[r.doc_id])


def test_near_duplicates_edges(spark):
    schema = "doc_id long, text string"
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (None, "a b c d e f g"), (2, "A B C D E F G"), (3, None)]
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == sorted([(1, 1, True), (1, 1, True), (None, None, True), (2, 1, False), (3, 3, True)], key=str)
    assert sorted(str(r.doc_id) for r in neardup.keep_first(spark.createDataFrame(rows, schema)).collect()) == ["1", "3", "None"]
    assert neardup.near_duplicates(spark.createDataFrame([], schema)).count() == 0


def test_half_of_all_rows_in_one_component(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    base = [word() for _ in range(120)]
    docs = []
    for i in range(120):  # a chain of texts, each near the one before, a ring around one of them, and many exact copies
        base[rng.randrange(120)] = word()
        docs.append(" ".join(base))
    hub = docs[60].split()
    docs += [" ".join([*hub[:k], word(), *hub[k + 1 :]]) for k in range(60)] + [docs[7]] * 40
    docs += [" ".join(word() for _ in range(rng.randrange(3, 80))) for _ in range(180)]
    ids = list(range(len(docs)))
    rng.shuffle(ids)
    want, _ = components(list(zip(ids, docs)))
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(list(zip(ids, docs)), "doc_id long, text string")).collect()}
    assert got == want and collections.Counter(want.values()).most_common(1)[0][1] >= 200


def repeats(docs, n):
    seen, out = set(), {}
    for i, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - n + 1):
            w = b[p : p + n]
            if w in seen:
                gone[p : p + n] = b"\1" * n
            seen.add(w)
        runs = [(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(gone))]
        out[i] = (len(b), sum(e - s for s, e in runs), runs, bytes(c for c, g in zip(b, gone) if not g))
    return out


def repeat_corpus(seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdé 🎉") for _ in range(n))
    common, passage = text(40), text(180)
    docs = [text(rng.randrange(0, 400)) for _ in range(30)]
    docs += [text(50) + passage[rng.randrange(60) : rng.randrange(120, 180)] + text(30) for _ in range(12)]
    docs += [text(60) + common + text(60) for _ in range(15)] + [docs[2]] * 4 + [docs[31] + docs[31], "x" * 700, "ab" * 300, "x" * 99, "", None]
    return list(enumerate(docs))


@pytest.mark.parametrize(("length", "gram", "hot"), [(100, 32, 60_000), (40, 8, 60_000), (40, 8, 3), (60, 59, 2)])
def test_repeated_substrings(spark, length, gram, hot):
    docs = repeat_corpus(length + hot)
    want = repeats(docs, length)
    df = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, h int")
    for r in substring.dedup_substrings(df, length, gram, hot).collect():
        assert (r.n_bytes, r.n_removed, [(s.s, s.e) for s in r.spans], bytes(r.kept)) == want[r.doc_id]


def test_maximal_repeats_have_all_occurrences():
    pieces = [b"xxABCDEFGHyy", b"zABCDEFGHw", b"qABCDEFv", b"ABCDE"]
    found = {pieces[w[0]][o[0] : o[0] + n]: sorted(zip(w.tolist(), o.tolist())) for n, w, o in substring.maximal_repeats(pieces, 5)}
    assert found[b"ABCDEFGH"] == [(0, 2), (1, 1)] and found[b"ABCDEF"] == [(0, 2), (1, 1), (2, 1)]
    assert found[b"ABCDE"] == [(0, 2), (1, 1), (2, 1), (3, 0)] and b"BCDEF" not in found


def test_repeated_rows_and_nulls(spark):
    t = "".join(chr(97 + i * i % 23) for i in range(300))
    df = spark.createDataFrame([(5, t), (5, t), (None, t), (7, t[:150])], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_removed) for r in substring.dedup_substrings(df).collect()), key=str)
    own = repeats([(5, t)], 100)[5][1]
    assert got == sorted([(5, own), (5, own), (None, 300), (7, 150)], key=str)
    assert substring.dedup_substrings(df.limit(0)).count() == 0


def test_texts_of_one_id_and_of_null(spark):
    docs = [t for _, t in repeat_corpus(5)] + [t for _, t in repeat_corpus(6)][:30]
    ids = [None if i % 3 else i % 4 for i in range(len(docs))]
    mark = lambda i, t: (i is None, i or 0, hashlib.md5((t or "").encode()).hexdigest())
    order = sorted({mark(i, t): (t or "") for i, t in zip(ids, docs)}.items())
    want = repeats([(k, t) for k, t in order], 40)
    df = spark.createDataFrame([(i, t) for i, t in zip(ids, docs)], "doc_id long, text string")
    for hot in (60_000, 2):
        got = collections.Counter((r.doc_id, r.n_removed, bytes(r.kept)) for r in substring.dedup_substrings(df, 40, 8, hot).collect())
        assert got == collections.Counter((i, want[mark(i, t)][1], want[mark(i, t)][3]) for i, t in zip(ids, docs))


def test_records_hold_each_window_once(monkeypatch):
    rng = random.Random(4)
    text = bytes(rng.choice(b"abc") for _ in range(3000)) * 2
    length, gram, seen = 60, 12, {}
    monkeypatch.setattr(substring, "PART", 257)
    h, first, windows, off, f, second = substring.records(text, length, gram)
    assert [w for a, n in zip(first, windows) for w in range(a, a + n)] == list(range(len(text) - length + 1))
    for level in range(7):
        for k, a, n, o, whole in zip(h.tolist(), first.tolist(), windows.tolist(), off.tolist(), f.tolist()):
            for w in range(a, a + n):  # equal windows have equal anchors at equal places, and equal records equal hashes
                assert seen.setdefault((level, text[w : w + length]), (k, a + o - w)) == (k, a + o - w)
            assert seen.setdefault((level, text[a : a + n + length - 1], "f"), whole) == whole
        h, first, windows, off, f, second, _ = substring.split_records(text, first, windows, off, level + 1, length, gram)
        assert sorted(w for a, n in zip(first, windows) for w in range(a, a + n)) == list(range(len(text) - length + 1))
    assert (windows == 1).all()


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    m = (centres[rng.integers(12, size=3000)] + 0.4 * rng.normal(size=(3000, 16))).astype(np.float32)
    m[100:900] = m[100]  # one vector is more than a quarter of all
    rows = [(i, v.tolist()) for i, v in enumerate(m)]
    bad = [(4000, None), (4020, [0.0] * 16), (4040, [float("nan")] + [1.0] * 15), (4060, [1.0] * 3), (None, [1.0] * 16), (4080, [None] + [1.0] * 15)]
    df = spark.createDataFrame(rows + bad + rows[:40], "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for r in ann.search(df, sample=1500, calibration=60).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    ids, d = np.arange(3000), m.astype(float)
    hit = total = 0
    for q in range(0, 3000, 20):
        s = (d * d[q]).sum(1)
        best = [i for i in np.lexsort((ids, -s)) if i != q][:20]
        assert len(got[q]) == 20 and all(s[i] == pytest.approx(x, abs=1e-9) for i, x in got[q])
        assert got[q] == sorted(got[q], key=lambda z: (-z[1], z[0]))
        hit += len({i for i, _ in got[q]} & set(best))
        total += 20
    assert set(got) == set(range(0, 3000, 20)) and hit / total >= 0.9
    few = spark.createDataFrame(rows[:5], "vec_id long, embedding array<float>")
    assert [r.vec_id for r in ann.search(few).orderBy("rank").collect()] == [i for i in np.lexsort((ids[:5], -(d[:5] * d[0]).sum(1))) if i != 0]
    assert ann.search(df.limit(0)).count() == 0


def test_recall_on_the_test_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = ann.usable(df).collect()
    ids, m = np.array([r.vec_id for r in rows]), np.array([r.v for r in rows])
    got = collections.defaultdict(list)
    for r in ann.search(df).collect():
        got[r.query_id].append(r.vec_id)
    hit = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        score = m @ m[q]
        score[q] = -np.inf
        hit += len(set(ids[np.lexsort((ids, -score))[:20]].tolist()) & set(got[ids[q]]))
        total += 20
    assert hit / total >= 0.9


def test_a_larger_table_has_more_leaves_and_queries_scan_less_of_it():
    rng = np.random.default_rng(5)
    share, leaves = [], []
    plane = rng.normal(size=(5, 24))
    for n in (2_000, 32_000):  # unit vectors of few degrees of freedom, whatever their dimension
        m = rng.normal(size=(n, 5)) @ plane
        m /= np.linalg.norm(m, axis=1)[:, None]
        tree = ann.Tree(m[rng.choice(n, min(n, 16_000), replace=False)], n)
        leaf = tree.place(m)
        size, needed = np.bincount(leaf, minlength=len(tree.leaves)), []
        for q in rng.choice(n, 60, replace=False):
            score = m @ m[q]
            score[q] = -np.inf
            order = list(tree.best_first(m[q]))
            at = {x: i for i, x in enumerate(order)}
            scanned = np.cumsum(size[order]) / n
            needed += [scanned[at[x]] for x in leaf[np.argpartition(-score, 20)[:20]]]
        share.append(np.quantile(needed, 0.95))
        leaves.append(len(tree.leaves))
    assert leaves[1] > 4 * leaves[0] and share[1] < 0.7 * share[0]


def test_bins_hold_neighbouring_leaves():
    first, pieces = ann._bins([10, 3_000, 900, 200, 9_000, 5])
    assert first == [0, 0, 0, 1, 2, 5] and pieces == [1, 1, 1, 1, 3, 1]


def test_pipeline(spark, sf):
    import corpus_pipeline

    from factlake.llm.mixing import mix_plan
    from factlake.llm.quality import quality

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id for r in quality(docs).filter("kept").collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in kept]
    component, _ = components(rows)
    first = {i for i in kept if component[i] == i}
    out = collections.Counter((r.doc_id, r.decoded_sha256) for r in corpus_pipeline.run(spark, sf).collect())
    assert {i for i, _ in out} <= first
    from factlake.llm.secrets import redact

    left = redact(docs.filter(docs.doc_id.isin(*first)))
    copies = {r.doc_id: r.copies for r in mix_plan(left).collect()}
    digest = {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in left.collect()}
    assert out == collections.Counter({(i, digest[i]): c for i, c in copies.items() if c})


def thue_morse(n):
    return ["".join("ab"[(bin(i).count("1") + k) & 1] for i in range(n)) for k in (0, 1)]


def test_neardup_of_words_whose_sums_of_powers_are_equal(spark):
    from factlake.llm.neardup import near_duplicates

    a, b = thue_morse(1024)
    long = thue_morse(8192)
    docs = [(1, a), (2, b), (3, f"x {a} y"), (4, f"x {b} y"), (5, long[0]), (6, long[1]), (7, long[0]), (8, "w" * 5000), (9, "w" * 5001)]
    got = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6, 7: 5, 8: 8, 9: 9}


def test_words_are_hashed_alike_in_slices(monkeypatch):
    from factlake.llm import common

    text = " \tOne two\x0b\x0cTHREE\x85four\xa0five \x1cx\n".encode() * 50
    whole = common.word_hashes(text)
    monkeypatch.setattr(common, "_SLICE", 5)
    assert (common.word_hashes(text) == whole).all() and len(whole) == 50 * 4


def test_substrings_with_nul_bytes(spark):
    from factlake.llm.substring import dedup_substrings

    p = "".join(random.Random(4).choice("ab") for _ in range(100))
    docs = [(1, p + "\0"), (2, p), (3, p + "\0\0"), (4, "\0" * 150), (5, "\0" * 120 + p), (6, p + "\0" * 130)]
    got = {r.doc_id: r.n_removed for r in dedup_substrings(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    seen, want = set(), {}
    for i, t in docs:
        gone = set()
        for at in range(len(t) - 99):
            if t[at : at + 100] in seen:
                gone.update(range(at, at + 100))
            seen.add(t[at : at + 100])
        want[i] = len(gone)
    assert got == want


def test_maximal_repeats_order_suffixes_with_their_lengths():
    from factlake.llm.substring import _mark

    rng = random.Random(8)
    for _ in range(300):
        pieces = ["".join(rng.choice("\0\0a") for _ in range(rng.randrange(3, 9))).encode() for _ in range(6)]
        covered = {(r, k) for r, a, b in _mark([(i,) for i in range(6)], np.zeros(6, dtype=np.int64), pieces, 3) for k in range(a, b)}
        seen, want = set(), set()
        for i, t in enumerate(pieces):
            for at in range(len(t) - 2):
                if t[at : at + 3] in seen:
                    want.update((i, k) for k in range(at, at + 3))
                seen.add(t[at : at + 3])
        assert covered == want
