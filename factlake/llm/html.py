"""Main text of pages by consensus host paths.

Pass 1 parses each page and scores its containers: the characters of their own blocks' prose, less what stands in links,
divided among a container and its ancestors by closeness.  The best is widened to the outermost ancestor below the body, or
up to its article or main element, that has prose of its own, such as a headline or a lead.  A container's path is the tag-class path from the body with
digits in class names generalised.  Each page votes for its best container's path with a weight that grows with the
logarithm of the score, Spark sums the votes per (host, path), and a host's winning path is the one with the most.
Pass 2 parses each page again and takes the text of the containers on its host's winning path; where a page has no such
container, or one without text, its own best container is taken.

Containers inside the best one are voted on too.  What speaks against one: a class or id made of words like ``advert`` or
``comments`` (which also makes its score small), text in links, and the same text on different pages of the host; what
speaks for it is its share of the prose.  The evidence is averaged over the host's pages and decides for all of them, so
names alone decide only where nothing else is known, and never about paragraphs, headings and the like.  Without a name, a
container is left out only if nearly all its text stands in links and it is the same on most pages: neither links nor
repetition decide alone, so an article's sources, series titles and notes stay.  Elements that HTML
itself makes for menus, headers, footers, sidebars, dialogs, forms, scripts and styles, or a role of the kind, hold no main text.

Text: character references are decoded, white space within a block is one space, blocks are trimmed, and non-empty
blocks are joined by one line feed in page order.  Nothing is capped.

Defined cases: null or empty html has an empty text; html cut off anywhere is read as far as it goes; a null url is a
host of its own (null), a url that has no host likewise; repeated rows are extracted one by one; ties between paths go
to the least path; an empty table gives an empty table.  Other columns don't clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, cut, stored

#: Elements that hold no main text, elements that end a block, elements without an end tag.
SKIPPED = set("script style noscript template svg iframe object head nav header footer aside form button select textarea dialog menu".split())
BLOCKS = set(
    "address article blockquote body br caption center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hr html "
    "li main ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
FOREIGN = {"svg", "math"}
RAW = set("script style textarea title noscript iframe xmp template".split())
CONTAINERS = set("article main section div body td blockquote".split())
#: Elements that are containers where they have a class or an id.
LISTS = set("ul ol dl table".split())
#: Words of a class or id that speak against a container, if others of the name are of the neutral kind.
BOILERPLATE = set(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu "
    "breadcrumb breadcrumbs header masthead footer sidebar widget cookie cookies consent gdpr notice popup modal newsletter "
    "subscribe subscription signup share sharing social related recommended recommendations comment comments disqus "
    "pagination pager toolbar copyright legal".split()
)
NEUTRAL = set("left right top bottom box container wrapper wrap bar list area block panel inner outer item items links reader user site page main x".split())
#: A container is left out where the evidence against it is above this.
AGAINST = 0.5
_ROLES = set("navigation banner contentinfo complementary search dialog alert form menu menubar".split())
#: An element of the first kind closes an open one of these, unless one of the others stands between.
_SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_AROUND_SIBLINGS = set("ul ol dl table div article section select".split())
#: p and these close an open p.
_CLOSES_P = BLOCKS - {"br", "caption", "dd", "dt", "html", "body", "summary", "figcaption", "li", "tbody", "td", "tfoot", "th", "thead", "tr"}

#: A quote opens a value only behind an equals sign.  Nothing is read twice, so the time is linear in the page.
_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(?:!|\?)[^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(>|\Z)",
    re.DOTALL,
)
_ATTR = re.compile(r"""([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]++))?+""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_END_OF_RAW = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.IGNORECASE) for tag in RAW}
_SPACE = re.compile(r"\s+")
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)")


#: Up to so many bytes of hosts with their paths are broadcast; beyond, pages and paths are shuffled.  Same result.
FEW_BYTES = 16 << 20
SALTS = 32


def host_of(url: str | None) -> str | None:
    m = _HOST.match(url or "")
    return m[1].lower() if m else None


#: Longer paths are told by a hash.
_LONG_PATH = 400


class _Container:
    """A tag-class path of a page, as its last label and the path above; what stands below it is summed up over it."""

    __slots__ = ("tag", "path", "parent", "named", "own", "below", "size", "linked", "text")

    def __init__(self, tag: str, path: str, parent: "_Container | None", named: bool) -> None:
        self.tag, self.path, self.parent, self.named = tag, path, parent, named
        self.own = self.below = 0.0
        self.size = self.linked = self.text = 0


class _Element:
    __slots__ = ("tag", "inside", "skip", "parent", "foreign")

    def __init__(self, tag: str, inside: _Container, skip: bool, parent: "_Element | None", foreign: bool) -> None:
        self.tag, self.inside, self.skip, self.parent, self.foreign = tag, inside, skip, parent, foreign


def speaks_against(name: str) -> bool:
    """Whether a class or id is made of words for what isn't main text, and of neutral ones."""
    words = [w.lower() for w in _NAME.findall(name)]
    return any(w in BOILERPLATE for w in words) and all(w in BOILERPLATE or w in NEUTRAL for w in words)


class Page:
    """The blocks of a page: for each, its text, how much of it stands in links, and its innermost container.

    Time and memory are linear in the page, whatever its tags and however deep they are.
    """

    def __init__(self, html: str) -> None:
        self.blocks: list[tuple[str, int, _Container]] = []
        top = _Container("", "", None, False)
        #: Containers, each behind the one that it stands in.
        self.containers: list[_Container] = [top]
        self._made: dict[tuple[int, str], _Container] = {}
        self._open: dict[str, int] = {}
        self._parts: list[str] = []
        self._linked = 0
        self._parse(html, _Element("", top, False, None, False))
        self._sum()

    def _end_block(self, at: _Element) -> None:
        if self._parts:
            text = _SPACE.sub(" ", unescape("".join(self._parts))).strip()
            if text:
                self.blocks.append((text, min(self._linked, len(text)), at.inside))
            self._parts, self._linked = [], 0

    def _parse(self, html: str, root: _Element) -> None:
        at, links, done, end = root, 0, 0, len(html)
        while done < end:
            m = _TOKEN.search(html, done)
            stop = m.start() if m else end
            if stop > done and not at.skip:
                self._text(html[done:stop], links)
            if not m:
                break
            done = m.end()
            tag = (m[2] or "").lower()
            if not tag or not m[4]:  # a comment, a declaration, or a tag that the page's end cuts off
                continue
            if m[1]:
                if tag in BLOCKS:
                    self._end_block(at)
                if tag == "a":
                    links = max(0, links - 1)
                up = self._up(at, (tag,), () if tag in BLOCKS else BLOCKS)
                if up is not None:
                    if up.skip and not up.parent.skip:
                        self._end_block(up.parent)
                    at = self._leave(at, up)
                continue
            if tag in BLOCKS or tag in SKIPPED:
                self._end_block(at)
            if tag in _CLOSES_P:
                p = self._up(at, ("p",), CONTAINERS)
                if p is not None:
                    at = self._leave(at, p)
            # outside of SVG and MathML a slash closes nothing
            if tag in VOID or m[3].endswith("/") and (at.foreign or tag in FOREIGN):
                continue
            if tag in _SIBLINGS:
                sibling = self._up(at, _SIBLINGS[tag], _AROUND_SIBLINGS)
                if sibling is not None:
                    at = self._leave(at, sibling)
            at = self._enter(tag, m[3], at)
            if tag == "a":
                links += 1
            if tag in RAW:
                close = _END_OF_RAW[tag].search(html, done)
                if not close:
                    break
                done = close.start()
        self._end_block(at)

    def _up(self, at: _Element, tags: tuple[str, ...], until) -> _Element | None:
        """The innermost open element of the tags, unless one of the others is around what is nearer."""
        if not any(self._open.get(t) for t in tags):
            return None
        while at.tag not in tags:
            if at.parent is None or at.tag in until:
                return None
            at = at.parent
        return at

    def _leave(self, at: _Element, up: _Element) -> _Element:
        """What ``up`` stands in, when it and all within it are closed."""
        while True:
            self._open[at.tag] -= 1
            if at is up:
                return at.parent
            at = at.parent

    def _enter(self, tag: str, attributes: str, at: _Element) -> _Element:
        skip, label, named, container = at.skip or tag in SKIPPED or tag == "title", tag, False, tag in CONTAINERS
        if attributes.strip():
            a = {}
            for name, value in _ATTR.findall(attributes):
                a.setdefault(name.lower(), unescape(value[1:-1] if value[:1] in "\"'" and value[-1:] == value[:1] else value))
            if a.get("role", "").lower() in _ROLES:
                skip = True
            classes = sorted(set(re.sub(r"\d+", "0", a.get("class", "")).split()))
            container = container or tag in LISTS and bool(classes or a.get("id"))
            if tag in LISTS or tag in ("div", "section"):
                named = any(map(speaks_against, classes)) or speaks_against(a.get("id", ""))
                if speaks_against(a.get("id", "")):
                    classes.append("#" + re.sub(r"\d+", "0", a["id"]))
            label = ".".join([tag, *classes])
        inside = at.inside
        if container:
            inside = self._made.get((id(at.inside), label))
            if inside is None:
                path = f"{at.inside.path}/{label}"
                if len(path) > _LONG_PATH:
                    path = f"...{xxhash.xxh3_128_hexdigest(path)}/{tag}"
                inside = self._made[id(at.inside), label] = _Container(tag, path, at.inside, named or at.inside.named)
                self.containers.append(inside)
        self._open[tag] = self._open.get(tag, 0) + 1
        return _Element(tag, inside, skip, at, at.foreign or tag in FOREIGN)

    def _text(self, s: str, links: int) -> None:
        self._parts.append(s)
        if links:
            self._linked += len(s.strip())

    def _sum(self) -> None:
        """Prose of each container's own blocks and of what is below it, which counts less at each level; sizes, and a sum of
        hashes of the texts, whose order it doesn't tell."""
        for text, linked, c in self.blocks:
            c.own += max(0, len(text) - 2 * linked) * (0.1 if c.named else 1.0)
            c.size += len(text)
            c.linked += linked
            c.text += xxhash.xxh3_64_intdigest(text)
        for c in reversed(self.containers):
            up = c.parent
            if up is not None:
                up.below += 0.9 * (c.own + c.below)
                up.size += c.size
                up.linked += c.linked
                up.text += c.text

    def best(self) -> tuple[str, float] | None:
        """The path of the container with the highest score, and the score."""
        score = lambda c: (c.own + c.below) * (1.25 if c.tag in ("article", "main") else 1.0)
        scored = [c for c in self.containers[1:] if c.own + c.below > 0]
        if not scored:
            return None
        best = outer = min(scored, key=lambda c: (-score(c), c.path))
        while outer.tag not in ("article", "main"):
            outer = outer.parent
            if outer.tag in ("", "body"):  # the body's own text stands beside everything on the page
                break
            if outer.own:
                best = outer
        return best.path, score(best)

    def _below(self, path: str | None) -> set[int]:
        """The containers on a path or below (all of them if it is None)."""
        inside: set[int] = set()
        for c in self.containers:
            if path is None or c.path == path or id(c.parent) in inside:
                inside.add(id(c))
        return inside

    def text(self, path: str | None, without: frozenset[str] = frozenset()) -> str:
        """The blocks in containers on the path or below, but for containers to be left out; of the whole page if it is None."""
        inside = self._below(path)
        if without:
            out: set[int] = set()
            for c in self.containers:
                if c.path in without or id(c.parent) in out:
                    out.add(id(c))
            inside -= out
        return "\n".join(t for t, _, c in self.blocks if id(c) in inside)

    def digest(self, path: str) -> int:
        """The hash of all text on a path or below."""
        inside = self._below(path)
        return sum(c.text for c in self.containers if c.path == path and id(c.parent) not in inside)

    def inner(self, path: str) -> Iterator[tuple[str, int, float, float, bool]]:
        """Of each container below one on the path that holds text: its path, a hash of its text, share of the prose, share of
        its text in links, name."""
        inside = self._below(path)
        total = sum(c.size for c in self.containers if c.path == path and id(c.parent) not in inside)
        for c in self.containers:
            if c.size and id(c) in inside and c.path != path:
                yield c.path, c.text, c.size / total, c.linked / c.size, c.named


_VOTE = "host string, path string, inner string, votes bigint, text long, page long, share double, linked double, named boolean"


def votes(pages: DataFrame, html_col: str = "html", url_col: str = "url") -> DataFrame:
    """(host, path, inner, votes, text, page, share, linked, named): per page its vote for a path, with a null inner, and a row
    for each container inside, with hashes of its text and of the page's; votes of a batch are summed."""
    df = columns(pages, url=url_col, html=html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import math

        names = [c.split()[0] for c in _VOTE.split(", ")]
        kinds = [pa.string()] * 3 + [pa.int64()] * 3 + [pa.float64()] * 2 + [pa.bool_()]
        signed = lambda h: (h & (1 << 64) - 1) - (1 << 63)
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                total: dict[tuple[str, str], int] = {}
                rows: list[tuple] = []
                for url, html in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    page = Page(html or "")
                    best = page.best()
                    if best:
                        key = (host_of(url) or "", best[0])
                        total[key] = total.get(key, 0) + max(1, round(1000 * math.log1p(best[1])))
                        whole = signed(page.digest(best[0]))
                        rows += [
                            (*key, own, 0, signed(t), whole, share, linked, named) for own, t, share, linked, named in page.inner(best[0])
                        ]
                rows += [(host, path, None, n, None, None, None, None, None) for (host, path), n in total.items()]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

    return df.mapInArrow(run, _VOTE)


def winning_paths(voted: DataFrame) -> DataFrame:
    """Per host its path, and the containers inside that are left out: the most votes, ties to the least path."""
    paths = voted.filter("inner is null").groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    best = F.min(F.struct(-F.col("votes"), F.col("path")))
    won = paths.groupBy("host").agg(best.alias("b")).select("host", F.col("b.path").alias("path"))
    # equal containers of equal pages count once, so copies of a page don't make its text look repeated
    once = voted.filter("inner is not null").groupBy("host", "path", "inner", "text", "page").agg(
        F.first("share").alias("share"), F.first("linked").alias("linked"), F.max("named").alias("named")
    )
    of_text = once.groupBy("host", "path", "inner", "text").agg(
        F.count("*").alias("n"), F.sum("share").alias("share"), F.sum("linked").alias("linked"), F.sum(F.col("named").cast("double")).alias("named")
    )
    seen = of_text.groupBy("host", "path", "inner").agg(
        F.sum("n").alias("n"), F.count("*").alias("texts"), *((F.sum(c) / F.sum("n")).alias(c) for c in ("share", "linked", "named"))
    )
    repeated = F.when(F.col("n") >= 3, 1 - F.col("texts") / F.col("n")).otherwise(0.0)
    against = F.col("named") + 2 * F.greatest(F.lit(0.0), F.col("linked") - 0.25) + repeated - 2 * F.col("share")
    # a name must speak against it on most pages; without one, links and repetition together, neither of them alone
    told = (F.col("named") > 0.5) | ((F.col("linked") > 0.8) & (repeated > 0.5))
    out = seen.filter(told & (against > AGAINST)).groupBy("host", "path").agg(F.array_sort(F.collect_list("inner")).alias("without"))
    return won.join(out, ["host", "path"], "left")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row of ``pages``: page_id, url, text."""
    df = columns(pages, page_id=id_col, url=url_col, html=html_col)
    paths = winning_paths(stored(votes(pages, html_col, url_col)))
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    paths, placed = cut(paths), df.withColumn("host", host)
    size = paths.agg(F.sum(F.octet_length("host") + F.octet_length("path") + F.coalesce(F.octet_length(F.array_join("without", ",")), F.lit(0)) + 64)).first()[0]
    if (size or 0) <= FEW_BYTES:
        joined = placed.join(F.broadcast(paths), "host", "left")
    else:
        # a host with many pages goes to SALTS tasks
        placed = placed.withColumn("salt", F.pmod(F.xxhash64("page_id", F.length("html")), F.lit(SALTS)))
        salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
        joined = placed.join(paths.withColumn("salt", salts), ["host", "salt"], "left")
    joined = joined.select("page_id", "url", "html", "path", "without")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                out = []
                for html, path, without in zip(*(part.column(k).to_pylist() for k in (2, 3, 4))):
                    page, left_out = Page(html or ""), frozenset(without or ())
                    text = page.text(path, left_out) if path is not None else ""
                    if not text:
                        best = page.best()
                        text = page.text(best[0] if best else None, left_out)
                    out.append(text)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.string())], names=["page_id", "url", "text"])

    kinds = dict(df.dtypes)
    return joined.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
