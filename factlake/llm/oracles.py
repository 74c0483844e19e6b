"""DuckDB SQL for the queries that SQL can express; the others are held against brute force in ``tests/llm``."""

from __future__ import annotations

from .neardup import DEN, NUM
from .quality import RULES, STOP_CAPITALIZED, STOP_WORDS

_WORD = r"[^\x20\x09-\x0D]+"

_METRICS = {
    "n_words": "n_words", "mean_word_length": "word_chars / nullif(n_words, 0)::double", "symbol_ratio": "n_symbols / nullif(word_chars, 0)::double",
    "stop_word_ratio": "n_stop / nullif(n_words, 0)::double", "dup_line_ratio": "n_dup_lines / nullif(n_lines, 0)::double",
    "upper_ratio": "n_upper / nullif(word_chars, 0)::double",
}


def _rules() -> str:
    out = []
    for name, least, most in RULES:
        out += [f"coalesce({_METRICS[name]} >= {least}, false)"] if least is not None else []
        out += [f"coalesce({_METRICS[name]} <= {most}, false)"] if most is not None else []
    return " and ".join(out)


_STOPS = ", ".join(f"'{w}'" for w in (*STOP_WORDS, *STOP_CAPITALIZED))

QUALITY = f"""
with t as (select doc_id, coalesce(text, '') as text from documents),
w as (
    select doc_id, text, regexp_extract_all(text, '{_WORD}') as words,
           list_filter(string_split(text, chr(10)), lambda c: regexp_matches(c, '{_WORD}')) as lines
    from t),
g as (
    select doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] as g
    from (select doc_id, words, unnest(range(1, len(words) - 1)) as i from w)),
c as (select doc_id, i, count(*) over (partition by doc_id, g) as n from g),
r as (select doc_id, count(distinct p) as n_repeat_words from (select doc_id, unnest([i, i + 1, i + 2]) as p from c where n > 1) group by doc_id),
m as (
    select w.doc_id, len(words)::bigint as n_words, length(array_to_string(words, ''))::bigint as word_chars,
           length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
           (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
           len(lines) as n_lines, length(regexp_replace(text, '[^\\p{{Lu}}]', '', 'g')) as n_upper,
           len(list_filter(words, lambda c: c in ({_STOPS}))) as n_stop
    from w left join r on w.doc_id = r.doc_id),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and {_rules()} as kept from b
"""

_UPPER = "".join(map(chr, range(65, 91)))

NEAR_DUPLICATES = f"""
with recursive w as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{_WORD}') as words from documents),
s as (
    select distinct doc_id, array_to_string(list_slice(words, i, i + k - 1), ' ') as shingle
    from (select doc_id, words, k, unnest(range(1, len(words) - k + 2)) as i
          from (select doc_id, words, least(5, len(words)) as k from w where len(words) > 0))),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.shingle = b.shingle and a.doc_id <> b.doc_id group by all),
e as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where {DEN} * c >= {NUM} * (a.n + b.n - c)),
r as (select doc_id as node, doc_id as reach from documents union select r.node, e.y from r join e on e.x = r.reach)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, min(r.reach) as component_id, d.doc_id = min(r.reach) as kept
from documents d join r on r.node = d.doc_id left join n on n.doc_id = d.doc_id group by d.doc_id, n.n
"""


def _crc32(texts: str, text: str) -> str:
    """Queries of SQL that give (text, crc): the checksum of each distinct ``text`` of ``texts``, byte by byte."""
    return f"""
bit_step as (
    select list(list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) as step
    from (select unnest(range(256)) as i)),
coded as (select distinct {text} as text, hex(encode({text})) as h from {texts}),
crc as (
    select text, xor(list_reduce(
        list_prepend(4294967295, list_transform(range(1, length(h), 2), lambda i: ('0x' || substring(h, i, 2))::bigint)),
        lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1])), 4294967295) as crc
    from coded, bit_step)"""


RESAMPLE = f"""
with small as (
    select doc_id, 0 as part, translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}') as text from documents
    union all select item_id, 1, translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}') from benchmark),
grams as (
    select doc_id, part, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as gram from small), {_crc32("grams", "gram")},
found as (select doc_id, part, crc % 10000 as bucket, count(*) as n from grams join crc on gram = text group by all),
counts as (select bucket, sum(n) filter (part = 0) as s, coalesce(sum(n) filter (part = 1), 0) as t from found group by bucket),
sums as (select sum(s)::double as all_s, sum(t)::double as all_t from counts),
gains as (
    select bucket, floor(1000 * ln((t::double + 1) * (all_s + 10000) / ((s::double + 1) * (all_t + 10000))))::bigint as gain
    from counts, sums where s is not null),
summed as (select doc_id, sum(n)::bigint as n_features, sum(n * gain)::bigint as weight from found join gains using (bucket) where part = 0 group by doc_id),
noisy as (
    select d.doc_id, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
           coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substring(sha256('2024:' || d.doc_id), 1, 8))::bigint + 0.5::double) / 4294967296::double)))::bigint as score
    from documents d left join summed s on s.doc_id = d.doc_id),
placed as (select *, row_number() over (partition by n_features >= 20 order by score desc, doc_id) as place, count(*) filter (n_features >= 20) over () as n from noisy)
select doc_id, n_features, weight, score, case when n_features >= 20 and place <= 10 * n // 100 then place end as rank from placed
"""

SPELLING = f"""
with recursive runs as (
    select doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) as run from documents),
told as (select doc_id || ':' || run as name, run, count(*) as times from runs where length(run) >= 6 group by all), {_crc32("told", "name")},
heard as (
    select case when crc % 199 = 0 then substring(run, 1, crc % length(run)) || substring(run, crc % length(run) + 2) else run end as word, times
    from told join crc on name = text),
words as (select word, sum(times)::bigint as n from heard where length(word) >= 6 group by word having sum(times) >= 5),
less as (select word, i, substring(word, 1, i) || substring(word, i + 2) as rest from (select word, unnest(range(length(word))) as i from words)),
near as (
    select a.word as a, b.word as b from less a join less b on a.rest = b.rest and a.i = b.i and a.word <> b.word
    union select l.word, w.word from less l join words w on l.rest = w.word
    union select w.word, l.word from less l join words w on l.rest = w.word),
best as (select a as word, count(*) as n_near, max(n) as m, arg_min(b, (-n, b)) as near from near join words on b = word group by a),
judged as (
    select w.word, w.n, coalesce(n_near, 0) as n_near, case when m >= 5 * w.n then near end as form, case when m >= 5 * w.n then m end as form_n
    from words w left join best b on b.word = w.word),
way as (
    select word, word as root, form as next from judged
    union all select way.word, way.next, judged.form from way join judged on judged.word = way.next)
select judged.word, n, n_near, form, form_n, root from judged join way on way.word = judged.word where way.next is null
"""

ORACLES: dict[str, str] = {"op2_quality_rules": QUALITY, "op10_neardup": NEAR_DUPLICATES, "op11_resample": RESAMPLE, "op13_spelling": SPELLING}
