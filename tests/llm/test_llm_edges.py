"""Every operator on nulls, empty and very long texts, repeated rows, empty tables and columns with clashing names."""

import collections
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from factlake.llm import ann, bpe, html, licenses, mixing, neardup, quality, secrets, substring, tokencount

CLASH = (
    "h id x f p e s n sig sketch rep v place label kept findings spans licenses n_blocks part n_tokens doc_tokens ids decoded size copies taken target "
    "words text_hash _no _src _size _h _at _part _rate _offset base_failed n_words host path inner salt bin slice leaf query_id rank score"
).split()


def long_text():
    rng = random.Random(6)
    return " ".join("".join(rng.choice("abcdefghijklmno") for _ in range(rng.randrange(1, 9))) for _ in range(60_000)) + "\npassword = hunter2hunter2 " + "ab1" * 20_000


LONG = long_text()
ROWS = [
    (1, "Released under the MIT License.\ntoken: abcdef123456", "en", "a"), (2, None, None, None), (3, "", "en", "a"), (4, " \n\t ", "en", "b"), (None, "no id here", "en", "b"),
    (5, LONG, "en", "a"), (6, "the same line " * 30, "en", "a"), (6, "the same line " * 30, "en", "a"), (7, "the same line " * 30, None, None), (8, "x" * 700, "de", "b"),
]
OPERATORS = {
    "op1": tokencount.section_tokens, "op2": quality.quality, "op3": substring.dedup_substrings, "op5": secrets.scan, "op6": licenses.scan, "op7": mixing.mix_plan,
    "op8": bpe.round_trip, "op10": neardup.near_duplicates,
}


def docs_of(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")


def rows_of(df):
    return collections.Counter(hashlib.md5(str(r).encode()).hexdigest() for r in df.collect())


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_edges(spark, name):
    run, docs = OPERATORS[name], docs_of(spark)
    out = run(docs)
    plain = rows_of(out)
    clash = docs.select("*", *(F.lit("clash").alias(c) for c in CLASH if c not in docs.columns))
    assert rows_of(run(clash)) == plain
    assert run(docs.limit(0)).count() == 0 and run(docs.limit(0)).columns == out.columns
    per_id = collections.Counter(r.doc_id for r in out.collect())
    if name != "op1":
        assert per_id == collections.Counter(r[0] for r in ROWS)
    else:
        lines = lambda t: max(1, (t or "").count("\n") + (not (t or "\n").endswith("\n")))
        want = collections.Counter()
        for i, t, *_ in ROWS:
            want[i] += lines(t)
        assert per_id == want
    # a row's result doesn't depend on its being repeated, but where rows are counted or compared
    if name in ("op1", "op2", "op5", "op6", "op8"):
        once = docs.dropDuplicates()
        assert set(plain) == set(rows_of(run(once))) and rows_of(run(once.union(once))) == collections.Counter({k: 2 * n for k, n in rows_of(run(once)).items()})


def test_long_texts_are_worked_on_whole(spark):
    docs = docs_of(spark).filter("doc_id = 5")
    (found,) = secrets.scan(docs).collect()
    assert ("assign", LONG.index("password"), LONG.index("password") + len("password = hunter2hunter2")) in {(f.kind, f.start, f.end) for f in found.findings}
    assert sum(r.n_tokens for r in tokencount.section_tokens(docs).collect()) == tokencount.section_tokens(docs).first().doc_tokens
    assert quality.quality(docs).first().n_words == len(LONG.split())
    twice = docs.union(docs.withColumn("doc_id", F.lit(50).cast("long")))
    assert {r.doc_id: r.n_removed for r in substring.dedup_substrings(twice).collect()}[50] == len(LONG)
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(twice).collect()} == {5: 5, 50: 5}
    (notice,) = licenses.scan(docs.withColumn("text", F.concat("text", F.lit(" Released under the MIT License. "), "text"))).collect()
    assert [x.name for x in notice.licenses] == ["MIT"]


def test_secrets_are_scored_whole(spark):
    net = secrets.network()
    x, y = secrets._examples(2000, 123)
    score = net.scores(len(x), enumerate(x))
    assert (score[y > 0] >= net.threshold).mean() >= 0.95 and (score[y == 0] >= net.threshold).mean() <= 0.02
    # a window in the middle of a long candidate is seen, and letters alone are a candidate
    plain = "/".join(["thereand"] * 12)
    assert len(secrets.codes(plain, 0, len(plain))) == 3
    hidden = plain[:50] + "xK9vQz7LmW2pRt8YbN4cJd6F" + plain[50:]
    scores = net.scores(2, ((i, secrets.codes(t, 0, len(t))) for i, t in enumerate((plain, hidden))))
    assert scores[1] > scores[0]
    text = "key = zQxWvBnMkLpHgFdSaTrEwQyUiOpLkJhG and internationalisation of incomprehensibilities"
    (row,) = secrets.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [text[f.start : f.end] for f in row.findings] == ["zQxWvBnMkLpHgFdSaTrEwQyUiOpLkJhG"]


def test_license_ties_go_to_the_first_name():
    same = {"b": ("This is under the licence of Nowhere.", ("nowhere",)), "a": ("This is under the licence of Nowhere.", ("nowhere",))}
    assert [x.name for x in licenses.Scanner(same).scan("This is under the licence of Nowhere.")] == ["a"]


def test_pages_with_clashing_columns_ties_and_long_html(spark):
    body = "<p>" + "words of a page " * 20_000 + "</p>"
    rows = [(1, "http://h.example.com/1", "<body><div class=b><p>same length</p></div></body>"), (2, "http://l.example.com/1", f"<body><article>{body}</article></body>"), (3, None, None), (3, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    clash = pages.select("*", *(F.lit("clash").alias(c) for c in ("text", "host", "path", "inner", "votes", "without", "salt", "named")))
    for df in (pages, clash):
        got = sorted((r.page_id, r.text) for r in html.extract(df).collect())
        assert got == [(1, "same length"), (2, ("words of a page " * 20_000).strip()), (3, ""), (3, "")]
    vote = [("h", f"/body/div.{c}", None, 5, None, None, None, None, None) for c in "cab"]
    (won,) = html.winning_paths(spark.createDataFrame(vote, html._VOTE)).collect()
    assert (won.path, won.without) == ("/body/div.a", None)


def test_vectors_with_clashing_columns(spark):
    rows = [(i, [float(i % 7 + 1), float(i % 5), 1.0]) for i in range(200)] + [(None, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    clash = df.select("*", *(F.lit("clash").alias(c) for c in ("v", "leaf", "bin", "slice", "query_id", "q", "score", "rank", "dim", "count")))
    assert rows_of(ann.search(clash)) == rows_of(ann.search(df))


def test_pipeline_edges(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(1)
    good = " ".join(f"the {''.join(rng.choice('aeioulrnst') for _ in range(6))} of {''.join(rng.choice('aeioulrnst') for _ in range(5))}" for _ in range(40))
    rows = [*ROWS, (20, good, "en", "a"), (20, good, "en", "a"), (21, good.upper(), "en", "b"), (22, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    docs.select("*", F.lit("x").alias("kept"), F.lit(1).alias("_no"), F.lit("y").alias("size")).write.parquet(str(tmp_path / "a" / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path / "a")).collect()
    assert {r.doc_id for r in out} <= {5, 20} and 20 in {r.doc_id for r in out} and len({(r.doc_id, r.decoded_sha256) for r in out}) == len({r.doc_id for r in out})
    docs.limit(0).write.parquet(str(tmp_path / "b" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "b")).count() == 0
