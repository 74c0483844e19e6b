"""Quality rules and mixing against plain Python; edge cases."""

import collections
import re

import pytest

from factlake.llm.mixing import mix, mix_plan
from factlake.llm.quality import Rule, keep_good, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGE = [
    None, "", " \n\t", "one", "a b c", "a b c a b c", "a a a a a a", "x\ny\nx\n\nx ", "Ärger & <b> \x00   # 🎉 #", "the of and " * 40, "word " * 30_000,
    "\x0bsplit\x0cme\rhere", "A-B|C $5 100%",
]


def measures(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    g = list(zip(w, w[1:], w[2:]))
    n = collections.Counter(g)
    covered = {p for i, x in enumerate(g) if n[x] > 1 for p in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_measures(spark, sf):
    texts = EDGE + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(120).collect()]
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], "doc_id long, text string, n_words string, _w int")
    got = {r.doc_id: r for r in quality(docs).collect()}
    for i, t in enumerate(texts):
        r, want = got[i], measures(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, (i, t and t[:50])
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.kept and r.base_failed)
    kept = keep_good(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, r in got.items() if r.kept)
    assert quality(docs.limit(0)).count() == 0


def test_quality_agrees_with_labels(spark, sf):
    d = sf.replace("sf0.001", "sf0.01")
    q = quality(spark.read.parquet(f"{d}/documents.parquet")).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    rows = q.filter("not base_failed").collect()
    assert all(r.kept for r in rows if r.quality == 1)
    assert sum(r.kept for r in rows if r.quality == 0) <= 0.05 * sum(r.quality == 0 for r in rows)


def test_rules_are_a_table(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog of it " * 20)], "doc_id long, text string")
    # repeated windows fail the base whatever the rules say
    assert not quality(docs, ()).first().kept
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(60)))], "doc_id long, text string")
    assert quality(docs, ()).first().kept and not quality(docs, (Rule("stop_word_ratio", 0.01, None),)).first().kept


def by_hand(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        level = (total - sum(3 * sizes[s] for s in capped)) / sum(weight[s] for s in free) if free else 0
        new = {s for s in free if level * weight[s] > 3 * sizes[s]}
        if not new:
            return {s: 3 * sizes[s] if s in capped else level * weight[s] for s in names}
        capped |= new


@pytest.mark.parametrize("offsets", [1, 32])
def test_mixing(spark, monkeypatch, offsets):
    rows = []
    for i in range(900):
        source = [None, "a", "a", "a", "b", "Z", "ä", ""][i % 8]
        words = 7 if source == "a" else (i * 7919) % 40 + (0 if source != "b" else 1)
        rows.append((i, " ".join(["w"] * words) if words else [None, ""][i % 2], source if i != 5 else "tiny", "extra"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    plan = mix_plan(docs, offsets=offsets).collect()
    monkeypatch.setattr("factlake.llm.mixing.FEW", 0)
    again = mix_plan(docs.repartition(7), offsets=offsets).collect()
    assert sorted(map(tuple, plan), key=str) == sorted(map(tuple, again), key=str) and len(plan) == len(rows)
    sizes = collections.Counter()
    for i, t, s, _ in rows:
        sizes[s] += len(WORD.findall(t or ""))
    want = by_hand(dict(sizes))
    taken, largest = collections.Counter(), collections.Counter()
    for r in plan:
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
        assert r.source_size == sizes[r.source] and r.taken <= 3 * r.size and r.target == pytest.approx(want[r.source])
    assert all(abs(taken[s] - want[s]) <= max(1, largest[s]) for s in want)
    out = mix(docs)
    assert out.columns == docs.columns
    n = collections.Counter(r.doc_id for r in out.collect())
    copies = {r.doc_id: r.copies for r in mix_plan(docs).collect()}
    assert all(n[i] == c for i, c in copies.items())


def test_mixing_is_systematic_sampling(spark):
    docs = spark.createDataFrame([(i, " ".join(["w"] * (i % 9 + 1)), "ab"[i % 5 == 0]) for i in range(400)], "doc_id long, text string, source string")
    by_source = collections.defaultdict(list)
    for r in mix_plan(docs.repartition(5)).collect():
        by_source[r.source].append(r)
    for rows in by_source.values():  # smallest first, any n documents in a row are taken n times the rate, up to one
        rate = rows[0].target / rows[0].source_size
        sizes = collections.defaultdict(list)
        for r in rows:
            sizes[r.size].append(r.copies)
        seen = copies = 0
        for size in sorted(sizes):
            seen, copies = seen + len(sizes[size]), copies + sum(sizes[size])
            assert abs(copies - seen * rate) <= 1 + 1e-9 and max(sizes[size]) - min(sizes[size]) <= 1


def test_mixing_of_one_repeated_row(spark):
    rows = [(None, "a b c", "s")] * 300 + [(1, "a b c", "s")] * 200 + [(i, "x y", "t") for i in range(1000, 1100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    plan = mix_plan(docs).groupBy("doc_id").sum("taken").collect()
    taken = {r[0]: r[1] for r in plan}
    assert len(taken) == 102 and abs(taken[None] + taken[1] - mix_plan(docs).filter("source = 's'").first().target) <= 3
    assert mix(docs).filter("source = 's'").count() * 3 == taken[None] + taken[1]


def test_mixing_repeated_rows_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b", "s"), (1, "a b", "s"), (None, "c d e", "s"), (2, "x", "t")], "doc_id long, text string, source string")
    copies = collections.Counter()
    for r in mix_plan(docs).collect():
        copies[r.doc_id] += r.copies
    assert collections.Counter(r.doc_id for r in mix(docs).collect()) == +copies
    assert mix_plan(docs.limit(0)).count() == 0 and mix(docs.limit(0)).count() == 0
