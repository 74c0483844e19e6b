"""One query for each operator of the inventory, over the graph that the driver's tables are projected to.

Names begin with the operator's number in the inventory (``q9_...``).  ``ORACLES`` has the same in DuckDB's SQL.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factlake.functions import keys, paging
from factlake.operators import changes, consumers, events, factsets, integrity, methodsets, outline, references, search, spatial, status, traverse
from factlake.operators.adjacency import cluster
from factlake.schema import EXACT_CONFIDENCES
from factlake.sources import source_code
from factlake.sources.project import VIEWS, ctes, project
from factlake.sources.tables import apply_delta, full_scan, scan
from factlake.streaming.debounce import debounce

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: The queries over a graph, as functions of the graph: for one that is published.
OF_GRAPH: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, graph: bool = True):
    """Register a query under its function's name, with its SQL; the graph's tables come first in it."""

    def add(f: Callable) -> Callable:
        if graph:
            OF_GRAPH[f.__name__] = f
        QUERIES[f.__name__] = (lambda spark, d: f(project(spark, d))) if graph else f
        if sql is not None:
            ORACLES[f.__name__] = f"{ctes(VIEWS)} {sql}" if graph else sql
        return f

    return add


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


LOCATED = """, located as (
    select s.stable_key, s.name, s.qualified_name, s.kind as symbol_kind, r.name as repository, p.name as package_name,
           p.stable_key as package_key, r.stable_key as repository_key, f.path, f.language, s.start_line, s.end_line
    from symbols s join files f on s.file_key = f.stable_key join packages p on f.package_key = p.stable_key
         join repositories r on f.repository_key = r.stable_key) """
REFERENCE_LIST = ", ".join(f"'{k}'" for k in references.allowed_kinds(None))
EXACT_LIST = ", ".join(f"'{c}'" for c in EXACT_CONFIDENCES)

# search --------------------------------------------------------------------------------------------------------------


@query("select stable_key, name, qualified_name, kind, file_key, start_line, end_line from symbols where name = 'Customer#000000042'")
def q1_find_symbol_exact(g):
    return search.find_symbols(g, "Customer#000000042")


@query("select stable_key, name, qualified_name, kind, file_key, start_line, end_line from symbols where qualified_name = 'NATION_2.Customer#000000000'")
def q2_find_symbol_qualified(g):
    return search.find_symbols(g, "NATION_2.Customer#000000000", "qualified_exact")


@query("select stable_key, name, qualified_name, kind, file_key, start_line, end_line from symbols where starts_with(name, 'Supplier#')")
def q3_find_symbol_prefix(g):
    return search.find_symbols(g, "Supplier#", "prefix")


@query("select stable_key, name, qualified_name, kind, file_key, start_line, end_line from symbols where contains(name, '00007')")
def q4_find_symbol_substring(g):
    return search.find_symbols(g, "00007", "substring", include_derived=True)


@query(
    "select s.stable_key, s.name, s.qualified_name, s.kind, s.file_key, s.start_line, s.end_line from symbols s join files f on s.file_key = f.stable_key "
    "join repositories r on f.repository_key = r.stable_key where s.kind = 'struct' and r.name = 'ASIA' and starts_with(f.path, 'NATION_1') and starts_with(s.name, 'Customer')"
)
def q5_symbol_filter(g):
    return search.find_symbols(g, "Customer", "prefix", kind="struct", repository="ASIA", path_prefix="NATION_1")


@query(LOCATED + "select stable_key, name, qualified_name, symbol_kind, repository, package_name, path, start_line, end_line from located where stable_key in ('c:7', 'o:21', 'p:3', 's:1')")
def q6_get_symbol(g):
    s = g.symbols.filter(F.col("stable_key").isin("c:7", "o:21", "p:3", "s:1"))
    return search.located(g, s).select("stable_key", "name", "qualified_name", F.col("kind").alias("symbol_kind"), "repository", "package_name", "path", "start_line", "end_line")


_STATUS = "case when count(stable_key) = 0 then 'SYMBOL_NOT_FOUND' when count(stable_key) > 1 then 'AMBIGUOUS_SYMBOL' else 'RESOLVED' end as status"


@query(
    "select w.wanted, count(stable_key) as candidates, case when count(stable_key) = 1 then min(stable_key) end as stable_key, " + _STATUS
    + " from (select distinct qualified_name as wanted from symbols where kind = 'function' union all select 'No.Such') w left join symbols s on s.qualified_name = w.wanted group by w.wanted"
)
def q7_resolve_selectors(g):
    wanted = g.symbols.filter("kind = 'function'").select("qualified_name")
    wanted = wanted.union(wanted.sparkSession.sql("select 'No.Such' as qualified_name"))
    return search.resolve_all(g, wanted)


_DECLARING = ", ".join(f"'{k}'" for k in search.DECLARATION_KINDS)


@query(
    ", t as (select stable_key, name, case when stable_key like 'p:%5' then 'import' when stable_key like 'p:%6' then 'constant' else kind end as kind from symbols), "
    f"d as (select *, kind in ({_DECLARING}) as declares from t) "
    "select w.wanted, count(stable_key) filter (declares) as candidates, case when count(stable_key) filter (declares) = 1 then min(stable_key) filter (declares) end as stable_key, "
    "case when count(stable_key) filter (declares) = 0 and count(stable_key) > 0 then 'MENTIONED_ONLY' when count(stable_key) filter (declares) = 0 then 'SYMBOL_NOT_FOUND' "
    "when count(stable_key) filter (declares) > 1 then 'AMBIGUOUS_SYMBOL' else 'RESOLVED' end as status "
    "from (select distinct name as wanted from symbols union all select 'No Such') w left join d on d.name = w.wanted group by w.wanted"
)
def q8_resolve_names(g):
    """Some parts are made to mention their names only, so that each status occurs."""
    wanted = g.symbols.select("name")
    wanted = wanted.union(wanted.sparkSession.sql("select 'No Such' as name"))
    kind = F.when(F.col("stable_key").like("p:%5"), "import").when(F.col("stable_key").like("p:%6"), "constant").otherwise(F.col("kind"))
    g.symbols = g.symbols.withColumn("kind", kind)
    return search.resolve_all(g, wanted, "name", search.DECLARATION_KINDS)


# references ----------------------------------------------------------------------------------------------------------

_PARTS = "select stable_key as root from symbols where starts_with(stable_key, 'p:')"
_REFS = LOCATED + f"""
    , refs as (
        select e.target_key as root, e.source_key as other, e.kind, e.confidence, e.provenance, e.evidence_key, cast(null as varchar) as via
        from edges e where e.kind in ({REFERENCE_LIST}) and starts_with(e.target_key, 'p:'))
    , seen as (select r.*, l.name, l.qualified_name, l.symbol_kind, l.repository, l.package_name, l.path, l.language, l.start_line from refs r join located l on r.other = l.stable_key) """


def _parts(g):
    return g.symbols.filter(F.col("stable_key").startswith("p:")).select(F.col("stable_key").alias("root"))


@query(_REFS + "select root, other, kind, confidence, via, repository, path, start_line from seen")
def q9_references_incoming(g):
    return references.find_references(g, _parts(g)).select("root", "other", "kind", "confidence", "via", "repository", "path", "start_line")


@query(
    LOCATED + f"select e.source_key as root, e.target_key as other, e.kind, e.confidence, l.repository, l.path from edges e join located l on e.target_key = l.stable_key "
    f"where e.kind in ({REFERENCE_LIST}) and e.confidence in ({EXACT_LIST}) and starts_with(e.source_key, 'o:')"
)
def q9_references_outgoing(g):
    roots = g.symbols.filter("kind = 'function'").select(F.col("stable_key").alias("root"))
    out = references.find_references(g, roots, "outgoing", confidences=list(references.EXACT_CONFIDENCES))
    return out.select("root", "other", "kind", "confidence", "repository", "path")


@query(
    f", sole as (select target_key, min(source_key) as root from edges where kind = 'IMPLEMENTS' group by 1 having count(*) = 1) "
    f"select s.root, e.source_key as other, e.kind, y.qualified_name as via from sole s join edges e on e.target_key = s.target_key join symbols y on y.stable_key = s.target_key "
    f"join symbols z on z.stable_key = e.source_key where e.kind in ({REFERENCE_LIST}) and e.kind <> 'IMPLEMENTS'"
)
def q10_sole_implementation_bridge(g):
    roots = g.symbols.filter("kind = 'function'").select(F.col("stable_key").alias("root"))
    return references.find_references(g, roots).filter("via is not null").select("root", "other", "kind", "via")


@query(_REFS + "select root, repository, path, count(*) as n from seen group by all")
def q11_reference_files(g):
    return references.reference_files(references.find_references(g, _parts(g)))


@query(_REFS + f"select root, sum(case when confidence in ({EXACT_LIST}) then 1 else 0 end)::bigint as exact, sum(case when confidence = 'CANDIDATE' then 1 else 0 end)::bigint as candidate, sum(case when confidence = 'UNRESOLVED' then 1 else 0 end)::bigint as unresolved_related from seen group by root")
def q29_coverage(g):
    return references.coverage(references.find_references(g, _parts(g)), "root")


@query(_REFS + "select root, other, kind, via, path from seen order by via is not null, via, other, kind, confidence, provenance, evidence_key, root limit 100 offset 40")
def q31_reference_page(g):
    rows = references.find_references(g, _parts(g))
    return paging.page(rows, [*references.reference_order(), F.col("root")], 40, 100).select("root", "other", "kind", "via", "path")


@query("select count(*) as total, least(greatest(count(*) - 40, 0), 100)::bigint as returned, count(*) > 140 as has_more from symbols where kind = 'interface'")
def q32_page_info(g):
    return paging.page_info(g.symbols.filter("kind = 'interface'"), 40, 100)


@query("select case when count(distinct kind) = 1 and count(kind) = count(*) then min(kind) end as kind, case when count(distinct file_key) = 1 then min(file_key) end as file_key, count(*) as n from symbols where starts_with(name, 'Supplier')")
def q33_hoisted_columns(g):
    return search.find_symbols(g, "Supplier", "prefix").agg(keys.hoisted(F.col("kind")).alias("kind"), keys.hoisted(F.col("file_key")).alias("file_key"), F.count("*").alias("n"))


@query(
    """, e as (select * from (select target_key as page, source_key as label, kind, confidence, provenance, row_number() over (partition by target_key order by source_key, kind) as at_ from edges
        where kind in ('CALLS_DIRECT', 'IMPLEMENTS')) where at_ <= 50),
    h as (select page, case when count(distinct kind) = 1 then min(kind) end as hk, case when count(distinct confidence) = 1 then min(confidence) end as hc, case when count(distinct provenance) = 1 then min(provenance) end as hp from e group by page),
    r as (select e.page, at_, '"' || label || '"' as label, case when hk is null then kind else '' end as k, case when hc is null then confidence else '' end as c, case when hp is null then provenance else '' end as p from e join h on e.page = h.page),
    plain as (select page, '[' || string_agg(case when k || c || p = '' then label else '[' || label || case when k <> '' then ',"' || k || '"' else '' end || case when c <> '' then ',"' || c || '"' else '' end
        || case when p <> '' then ',"' || p || '"' else '' end || ']' end, ',' order by at_) || ']' as plain from r group by page),
    g as (select page, min(at_) as first, '{' || case when k <> '' then '"kind":"' || k || '",' else '' end || case when c <> '' then '"confidence":"' || c || '",' else '' end || case when p <> '' then '"provenance":"' || p || '",' else '' end
        || '"rows":[' || string_agg(label, ',' order by at_) || ']}' as one from r group by page, k, c, p),
    grouped as (select page, '[' || string_agg(one, ',' order by first) || ']' as grouped from g group by page)
    select h.page, '{' || concat_ws(',', '"kind":"' || hk || '"', '"confidence":"' || hc || '"', '"provenance":"' || hp || '"') || '}' as header, case when strlen(grouped) < strlen(plain) then 'groups' else 'rows' end as form,
        case when strlen(grouped) < strlen(plain) then grouped else plain end as body from h join plain on h.page = plain.page join grouped on h.page = grouped.page"""
)
def q33_compact_pages(g):
    """The first fifty calls of each part as a page: what all rows share, and the rest as rows or as groups."""
    by = Window.partitionBy("target_key").orderBy("source_key", "kind")
    rows = g.edges.filter(F.col("kind").isin("CALLS_DIRECT", "IMPLEMENTS")).withColumn("at", F.row_number().over(by)).filter("at <= 50")
    return paging.compact_pages(rows.withColumnRenamed("target_key", "page"), "source_key", ["kind", "confidence", "provenance"])


@query(LOCATED + "select stable_key, replace(qualified_name, package_name || '.', '') as signature from located where symbol_kind = 'struct'")
def q34_local_signature(g):
    s = search.located(g, g.symbols.filter("kind = 'struct'"))
    return s.select("stable_key", search.local_signature(F.col("qualified_name"), F.col("package_name")).alias("signature"))


# traversal -----------------------------------------------------------------------------------------------------------

#: Roots of traversals: every symbol of a kind.
_SUPPLIERS, _ORDERS = "interface", "function"


def _walkable(g, *directions):
    """The graph with its edges clustered for walks in these directions, unless it was published with both."""
    if g.clustered is None:
        spark = g.edges.sparkSession
        path = f"{traverse.checkpoints(spark)}/adjacency-{uuid.uuid4().hex}"
        g.clustered = cluster(g.edges, path, int(spark.conf.get("spark.sql.shuffle.partitions")), directions)
    return g


def _roots(g, kind):
    return g.symbols.filter(F.col("kind") == kind).select(F.col("stable_key").alias("root"))


def _some(g, kind, n):
    """All roots of a kind, or n of them."""
    roots = _roots(g, kind)
    return roots if n is None else roots.orderBy(F.xxhash64("root"), "root").limit(n)


def _walk(near: str, far: str, kind: str, depth: int) -> str:
    kinds = ", ".join(f"'{k}'" for k in traverse.REFERENCE_KINDS)
    return f""", walk as (
        select stable_key as root, stable_key as id, 0 as depth from symbols where kind = '{kind}'
        union select w.root, e.{far}, w.depth + 1 from walk w join edges e on e.{near} = w.id where w.depth < {depth} and e.kind in ({kinds}))
        , visits as (select root, id, min(depth) as depth from walk group by root, id) """


@query(_walk("source_key", "target_key", _ORDERS, 3) + "select root, id, depth from visits where depth > 0")
def q12_trace_dependencies(g, roots=None):
    return traverse.trace_dependencies(_walkable(g, "outgoing"), _some(g, _ORDERS, roots), 3, 25_000, seed_members=False, told=()).select("root", "id", "depth")


_CONV = """
    select conv_id, 'v:' || conv_id as stable_key, 1 as start_line, max(turn) + 2 as end_line from conversations group by conv_id
    union all select conv_id, 'v:' || conv_id || ':' || turn, turn + 1, turn + 1 from conversations"""


@query(
    f"with s as (select distinct * from ({_CONV})) select a.stable_key as root, b.stable_key as id from s a join s b on a.conv_id = b.conv_id "
    "and b.start_line >= a.start_line and b.end_line <= a.end_line and a.stable_key <> b.stable_key where a.end_line > a.start_line "
    "union all select stable_key, stable_key from s where end_line > start_line",
    graph=False,
)
def q13_container_members(spark, d):
    t = _table(spark, d, "conversations")
    key = F.concat(F.lit("v:"), F.col("conv_id").cast("string"))
    tops = t.groupBy("conv_id").agg(F.max("turn").alias("m")).select(key.alias("stable_key"), F.col("conv_id").cast("string").alias("file_key"), F.lit(1).alias("start_line"), (F.col("m") + 2).alias("end_line"))
    turns = t.select(F.concat(key, F.lit(":"), F.col("turn").cast("string")).alias("stable_key"), F.col("conv_id").cast("string").alias("file_key"), (F.col("turn") + 1).alias("start_line"), (F.col("turn") + 1).alias("end_line")).distinct()
    g = project(spark, d)
    g.symbols = tops.union(turns)
    return traverse.members(g, tops.select(F.col("stable_key").alias("root")))


@query(
    LOCATED + _walk("target_key", "source_key", _SUPPLIERS, 2)
    + "select v.root, v.id, v.depth, l.repository, l.package_key from visits v join located l on v.id = l.stable_key where v.depth > 0 and l.symbol_kind not in ('field', 'variable')"
)
def q14_blast_radius(g, roots=None):
    rows, _ = traverse.blast_radius(_walkable(g, "incoming"), _some(g, _SUPPLIERS, roots), 2, 25_000, told=())
    return rows.select("root", "id", "depth", "repository", "package_key")


@query(
    LOCATED + _walk("target_key", "source_key", _SUPPLIERS, 2)
    + ", reported as (select v.root, v.depth, l.repository, l.package_key from visits v join located l on v.id = l.stable_key where v.depth > 0 and l.symbol_kind not in ('field', 'variable')) "
    "select root, 'repository' as axis, repository as key, count(*) as n from reported group by all union all select root, 'package', package_key, count(*) from reported group by all "
    "union all select root, 'depth', cast(depth as varchar), count(*) from reported group by all"
)
def q15_impact_axes(g, roots=None):
    rows, _ = traverse.blast_radius(_walkable(g, "incoming"), _some(g, _SUPPLIERS, roots), 2, 25_000, told=())
    return traverse.impact_axes(rows)


@query(
    LOCATED + _walk("target_key", "source_key", _SUPPLIERS, 2)
    + ", reported as (select v.root, v.id from visits v join located l on v.id = l.stable_key where v.depth > 0 and l.symbol_kind not in ('field', 'variable')) "
    "select x.root, e.kind, count(distinct x.id) as n from reported x join edges e on e.source_key = x.id join visits v on v.root = x.root and v.id = e.target_key "
    "where e.kind in (" + ", ".join(f"'{k}'" for k in traverse.REFERENCE_KINDS) + ") group by all"
)
def q16_impact_by_kind(g):
    return traverse.impact_by_kind(_walkable(g, "incoming"), _roots(g, _SUPPLIERS), 2, 25_000)


@query(
    LOCATED + """, t as (select stable_key as root, name, qualified_name, repository_key, package_key, package_name from located where symbol_kind in ('struct', 'type'))
    select t.root, case when e.confidence in (""" + EXACT_LIST + """) then 'exact_symbol' else 'candidate' end as category, l.repository, l.package_key, e.source_key as consumer, e.kind, cast(null as varchar) as unresolved_key
    from t join edges e on e.target_key = t.root join located l on l.stable_key = e.source_key where l.repository_key <> t.repository_key
    union all
    select t.root, 'package', r.name, p.stable_key, null, e.kind, null from t join edges e on e.target_key = t.package_key and e.kind in ('PACKAGE_DEPENDS_ON', 'MODULE_DEPENDS_ON')
    join packages p on p.stable_key = e.source_key join repositories r on r.stable_key = p.repository_key where p.repository_key <> t.repository_key
    union all
    select t.root, 'unresolved', r.name, null, null, null, u.stable_key from t join unresolved u on u.requested_package in (t.package_key, t.package_name)
    and (u.requested_symbol in (t.root, t.name, t.qualified_name) or ends_with(u.requested_symbol, '.' || t.name) or ends_with(u.requested_symbol, '::' || t.name))
    join repositories r on r.stable_key = u.repository_key where u.repository_key <> t.repository_key"""
)
def q17_cross_repository_consumers(g):
    t = g.symbols.filter(F.col("kind").isin("struct", "type")).select(F.col("stable_key").alias("root"))
    return consumers.cross_repository_consumers(g, t).select("root", "category", "repository", "package_key", "consumer", "kind", "unresolved_key")


@query(
    "select p.name as package, count(*) as consumers from edges e join packages p on e.target_key = p.stable_key join packages q on e.source_key = q.stable_key "
    "where e.kind = 'PACKAGE_DEPENDS_ON' and p.repository_key <> q.repository_key group by p.name"
)
def q18_package_consumers(g):
    one = g.symbols.join(g.files.select(F.col("stable_key").alias("file_key"), "package_key"), "file_key")
    one = one.groupBy("package_key").agg(F.min("stable_key").alias("root"))
    found = consumers.cross_repository_consumers(g, one).filter("category = 'package'").groupBy("root").agg(F.count("*").alias("consumers"))
    names = g.packages.select(F.col("stable_key").alias("package_key"), F.col("name").alias("package"))
    return found.join(one, "root").join(names, "package_key").select("package", "consumers")


@query(
    LOCATED + "select u.stable_key as unresolved_key, l.stable_key as root from unresolved u join located l on u.requested_package in (l.package_key, l.package_name) "
    "and (u.requested_symbol in (l.stable_key, l.name, l.qualified_name) or ends_with(u.requested_symbol, '.' || l.name) or ends_with(u.requested_symbol, '::' || l.name)) "
    "where l.symbol_kind = 'struct' and u.repository_key <> l.repository_key"
)
def q19_unresolved_matches_target(g):
    t = g.symbols.filter("kind = 'struct'").select(F.col("stable_key").alias("root"))
    return consumers.cross_repository_consumers(g, t).filter("category = 'unresolved'").select("unresolved_key", "root")


# outlines, sources, status -------------------------------------------------------------------------------------------


@query("select f.path, f.stable_key as file_key, count(*) as n, min(s.start_line) as first_line, string_agg(s.stable_key, ',' order by s.start_line, s.end_line, s.stable_key) as declared from symbols s join files f on s.file_key = f.stable_key where f.path = 'NATION_3' or starts_with(f.path, 'NATION_3/') group by all")
def q20_file_outline(g):
    out = outline.file_outline(g, "NATION_3/")
    return out.select("path", "file_key", "n", F.element_at("declarations", 1)["start_line"].alias("first_line"), F.array_join(F.transform("declarations", lambda x: x["key"]), ",").alias("declared"))


_SOURCES = """with w as (select doc_id as key, string_split(text, chr(10)) as lines, regexp_extract(text, '([A-Za-z]+)', 1) as name, doc_id % 3 <> 0 as fresh from documents),
    lined as (select key, name, unnest(lines) as line, generate_subscripts(lines, 1) as no from w where not fresh),
    hits as (select key, no as line, abs(no - 2) as far from lined where not starts_with(ltrim(line), '//') and not starts_with(ltrim(line), '*')
             and name <> '' and regexp_matches(line, '(^|[^A-Za-z0-9_])' || name || '([^A-Za-z0-9_]|$)')),
    best as (select key, min(far) as far from hits group by key),
    one as (select h.key, min(h.line) as line, count(*) as ties from hits h join best b on h.key = b.key and h.far = b.far group by h.key),
    placed as (select w.*, case when fresh then 'CURRENT' when ties is null then 'NOT_FOUND' when ties > 1 then 'AMBIGUOUS' when line + 1 > len(lines) then 'OUT_OF_RANGE' else 'FOUND' end as status, line from w left join one on w.key = one.key),
    shown as (select *, case status when 'CURRENT' then 2 when 'FOUND' then line end as start_line from placed) """


@query(
    _SOURCES + "select key, start_line, status, case when start_line is not null then array_to_string(list_slice(lines, start_line, start_line + 1), chr(10)) end as body from shown",
    graph=False,
)
def q21_source_bodies(spark, d):
    """Two lines of each document; a third of the documents has changed since, and the line is looked for again."""
    text = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("old"))).otherwise(F.col("text"))
    w = _table(spark, d, "documents").select(
        F.col("doc_id").alias("key"), F.nullif(F.regexp_extract("text", "([A-Za-z]+)", 1), F.lit("")).alias("name"), F.lit(2).cast("long").alias("start_line"), F.lit(3).cast("long").alias("end_line"),
        "text", F.sha2(text, 256).alias("content_hash"),
    )
    return outline.get_source(w).select("key", "start_line", "status", "body")


@query(
    """with w as (select doc_id as key, string_split(text, chr(10)) as lines, regexp_extract(text, '([A-Za-z]+)', 1) as name from documents),
    lined as (select key, name, len(lines) as n_lines, unnest(lines) as line, generate_subscripts(lines, 1) as no from w),
    hits as (select key, no as line, abs(no - 2) as far from lined where name <> '' and not starts_with(ltrim(line), '//') and not starts_with(ltrim(line), '*')
             and name <> '' and regexp_matches(line, '(^|[^A-Za-z0-9_])' || name || '([^A-Za-z0-9_]|$)')),
    best as (select key, min(far) as far from hits group by key),
    one as (select h.key, min(h.line) as line, count(*) as ties from hits h join best b on h.key = b.key and h.far = b.far group by h.key)
    select w.key, case when ties = 1 then line end as line, case when ties is null then 'NOT_FOUND' when ties > 1 then 'AMBIGUOUS' else 'FOUND' end as status from w left join one on w.key = one.key""",
    graph=False,
)
def q22_reanchor(spark, d):
    name = F.regexp_extract("text", "([A-Za-z]+)", 1)
    w = _table(spark, d, "documents").select(F.col("doc_id").alias("key"), name.alias("name"), F.lit(2).cast("long").alias("start_line"), F.lit(2).cast("long").alias("end_line"), "text")
    return outline.reanchor(w)


@query("select r.stable_key, r.name, r.dirty, count(p.stable_key) as packages from repositories r left join packages p on p.repository_key = r.stable_key group by all")
def q23_list_repositories(g):
    return status.list_repositories(g).select("stable_key", "name", "dirty", "packages")


_COUNTS = " union all ".join(f"select 'rows' as section, '{t}' as name, count(*) as n from {t}" for t in ("repositories", "packages", "files", "symbols", "unresolved"))


@query(
    LOCATED + ", derived as (select r.name as derived, (select count(*) from packages p where p.repository_key = r.stable_key) as packages, (select count(*) from files f where f.repository_key = r.stable_key) as files, "
    "(select count(*) from located l where l.repository = r.name) as symbols, (select count(*) from edges e join located l on e.source_key = l.stable_key where l.repository = r.name) as edges_within, "
    "(select count(*) from edges e join located t on e.target_key = t.stable_key left join located s on e.source_key = s.stable_key where t.repository = r.name and coalesce(s.repository, '') not like 'derived:%') as edges_inbound, "
    "(select count(*) from unresolved u where u.repository_key = r.stable_key) as unresolved from repositories r where r.name like 'derived:%') "
    + _COUNTS + " union all select 'edges', kind, count(*) from edges group by kind union all select 'unresolved', reason, count(*) from unresolved group by reason "
    + "".join(f" union all select 'derived', derived || ':{c}', {c} from derived" for c in ("packages", "files", "symbols", "edges_within", "edges_inbound", "unresolved"))
    + " union all select 'freshness', case when r_name = 'AFRICA' then 'unknown' when r_name in ('ASIA', 'EUROPE') then 'moved' else 'current' end, count(*) from (select r_name from region union all select 'AFRICA') group by 2"
    " union all select 'schema', * from (values ('version', 3::bigint), ('expected', 4), ('outdated', 1)) v"
)
def q24_graph_status(g):
    """Two repositories have moved since; the heads of one and of the derived one can't be read."""
    g.repositories = g.repositories.withColumn("commit", F.concat(F.lit("c-"), "name"))
    heads = g.repositories.filter("name not in ('AFRICA', 'derived:catalog')").select(
        "name", F.when(F.col("name").isin("ASIA", "EUROPE"), "later").otherwise(F.col("commit")).alias("head")
    )
    return status.graph_status(g, 3, 4, heads)


@query("select kind as name, count(*) as n from edges group by kind")
def g6_table_counts(g):
    return status.table_counts(g).filter(F.col("name").startswith("edges:")).select(F.replace("name", F.lit("edges:"), F.lit("")).alias("name"), "n")


@query(
    LOCATED + """select 'derived:catalog' as derived, (select count(*) from packages where repository_key = 'repository:derived:catalog') as packages,
    (select count(*) from files where repository_key = 'repository:derived:catalog') as files, (select count(*) from located where repository = 'derived:catalog') as symbols,
    (select count(*) from edges e join located l on e.source_key = l.stable_key where l.repository = 'derived:catalog') as edges_within,
    (select count(*) from edges e join located t on e.target_key = t.stable_key left join located s on e.source_key = s.stable_key where t.repository = 'derived:catalog' and coalesce(s.repository, '') <> 'derived:catalog') as edges_inbound,
    (select count(*) from unresolved where repository_key = 'repository:derived:catalog') as unresolved"""
)
def q25_derived_breakdown(g):
    return status.derived_breakdown(g)


@query("select stable_key, requested_package, reason from unresolved where reason = 'UNLABELLED' and language = 'en' and repository_key = 'repository:ASIA'")
def q26_unresolved_references(g):
    return status.unresolved_references(g, repository_key="repository:ASIA", reason="UNLABELLED", language="en").select("stable_key", "requested_package", "reason")


_SPOT = "coalesce(reason, '') || ':' || repository || ':' || coalesce(path, '') || ':' || coalesce(start_line, 0) || ':' || coalesce(requested_symbol, '') || ':' || coalesce(requested_package, '') || ':' || coalesce(detail, '')"


@query(
    LOCATED + f""", spots as (select u.*, r.name as repository, f.path from unresolved u join repositories r on r.stable_key = u.repository_key left join files f on f.stable_key = u.file_key),
    named as (select l.stable_key as root, s.*, row_number() over (partition by l.stable_key order by s.stable_key) as k from located l join spots s on s.file_key is not null and (s.requested_symbol = l.name or ends_with(s.requested_symbol, '.' || l.name)) where l.symbol_kind in ('struct', 'type')),
    scoped as (select *, row_number() over (partition by repository_key order by stable_key) as k from spots where file_key is null),
    naming as (select root, count(*) as n, string_agg({_SPOT}, chr(10) order by k) filter (k <= 20) as told, list(path) filter (k <= 20 and path is not null) as paths from named group by root),
    scopes as (select repository_key, count(*) as n, string_agg({_SPOT}, chr(10) order by k) filter (k <= 20) as told, list(trim(list_last(string_split(detail, ' in ')))) filter (k <= 20 and contains(detail, ' in ')) as paths from scoped group by repository_key)
    select l.stable_key as root, case when n.n is null and s.n is null then 'COMPLETE' else 'LOWER_BOUND' end as verdict, coalesce(n.n, 0) as naming, coalesce(s.n, 0) as scopes,
        greatest(coalesce(n.n, 0) - 20, 0) as more_blind_spots, greatest(coalesce(s.n, 0) - 20, 0) as more_invisible_scopes, n.told as spots, s.told as invisible,
        case when n.n is not null or s.n is not null then '\\b' || regexp_replace(l.name, '([\\\\.+*?()|\\[\\]{{}}^$])', '\\\\\\1', 'g') || '\\b' end as pattern,
        case when n.n is not null or s.n is not null then array_to_string(list_sort(list_distinct(list_concat(coalesce(n.paths, []), coalesce(s.paths, [])))), ',') end as paths
    from located l left join naming n on n.root = l.stable_key left join scopes s on s.repository_key = l.repository_key where l.symbol_kind in ('struct', 'type')"""
)
def q27_completeness(g):
    s = search.located(g, g.symbols.filter(F.col("kind").isin("struct", "type"))).select(F.col("stable_key").alias("root"), "name", "repository_key")
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    one = lambda x: F.concat_ws(":", text(x["reason"]), x["repository"], text(x["path"]), F.coalesce(x["start_line"], F.lit(0)).cast("string"), text(x["requested_symbol"]), text(x["requested_package"]), text(x["detail"]))
    told = lambda c: F.array_join(F.transform(c, one), "\n")
    return status.completeness(g, s).select(
        "root", "verdict", "naming", "scopes", F.col("more_blind_spots").cast("long").alias("more_blind_spots"), F.col("more_invisible_scopes").cast("long").alias("more_invisible_scopes"),
        told("blind_spots").alias("spots"), told("invisible_scopes").alias("invisible"), "pattern", F.array_join("paths", ",").alias("paths"),
    )


@query("select repository_key, count(*) as n from unresolved group by 1")
def q28_unresolved_by_repository(g):
    return status.unresolved_by_repository(g)


@query("select r.name as repository, count(*) as n from symbols s join files f on s.file_key = f.stable_key join repositories r on f.repository_key = r.stable_key where not starts_with(r.name, 'derived:') group by 1")
def q30_derived_filter(g):
    rows = search.located(g)
    return rows.filter(search.keeps_derived(F.col("repository"))).groupBy("repository").agg(F.count("*").alias("n"))


# database reads and integrity ----------------------------------------------------------------------------------------


@query("select stable_key, name, kind from symbols where stable_key = 'o:5'")
def g1_get_symbol(g):
    return g.symbols.filter("stable_key = 'o:5'").select("stable_key", "name", "kind")


@query("select source_key, target_key, kind from edges where target_key in ('p:1', 'p:2') and kind <> 'PACKAGE_DEPENDS_ON' order by source_key, kind, target_key limit 500")
def g2_references_page(g):
    e = g.edges.filter(F.col("target_key").isin("p:1", "p:2") & (F.col("kind") != "PACKAGE_DEPENDS_ON"))
    return paging.page(e.select("source_key", "target_key", "kind"), ["source_key", "kind", "target_key"], 0, 500)


@query(_walk("source_key", "target_key", _ORDERS, 5) + "select root, id, depth from visits where depth > 0")
def g3_traverse_outgoing(g, roots=None):
    seeds = _some(g, _ORDERS, roots).select("root", F.col("root").alias("id"))
    return traverse.traverse(_walkable(g, "outgoing").clustered, seeds, "outgoing", 5, 25_000, told=()).filter("depth > 0").select("root", "id", "depth")


@query(
    ", kinds as (select unnest([" + ", ".join(f"'{k}'" for k in traverse.REFERENCE_KINDS) + "]) as kind), "
    "walk as (select stable_key as source, stable_key as target, 0 as length, [stable_key] as path from symbols where kind = 'function' "
    "union select w.source, e.target_key, w.length + 1, list_append(w.path, e.target_key) from walk w join edges e on e.source_key = w.target where w.length < 5 and e.kind in (select kind from kinds)), "
    "near as (select source, target, min(length) as length from walk where starts_with(target, 's:') group by 1, 2) "
    "select w.source, w.target, w.length, array_to_string(min(w.path), '>') as path from walk w join near n on n.source = w.source and n.target = w.target and n.length = w.length group by 1, 2, 3"
)
def g4_shortest_path(g):
    """Every order to every supplier that it reaches; of several shortest paths the least, node by node."""
    pairs = g.symbols.filter("kind = 'function'").select(F.col("stable_key").alias("source"))
    found = traverse.shortest_paths(_walkable(g, "outgoing").clustered, pairs, targets=g.symbols.filter("kind = 'interface'").select(F.col("stable_key").alias("target")))
    return found.select("source", "target", "length", F.array_join("path", ">").alias("path"))


@query(LOCATED + "select e.target_key as root, l.repository, count(*) as n from edges e join located l on e.source_key = l.stable_key where starts_with(e.target_key, 'p:') group by all")
def g5_incoming_by_repository(g):
    return references.find_references(g, _parts(g), kinds=["*"], bridge=False).groupBy("root", "repository").agg(F.count("*").alias("n"))


@query(
    "select 'symbol' as probe, min(stable_key) as key, 1::bigint as n from symbols union all select * from (select 'outgoing', source_key || '|' || kind, count(*) as n from edges group by source_key, kind order by n desc, source_key, kind limit 1) "
    "union all select * from (select 'edge', source_key || '|' || kind || '|' || target_key, 1 from edges order by source_key, target_key, kind limit 1)"
)
def g7_golden_probes(g):
    return integrity.golden_probes(g)


@query(
    ", found as (select 'missing_evidence_file' as rule, source_key || '|' || kind || '|' || target_key as key from edges where evidence_key is not null union all "
    "select 'exact_edge_without_source', source_key || '|' || kind || '|' || target_key from edges e where e.confidence in (" + EXACT_LIST + ") and e.kind <> 'PACKAGE_DEPENDS_ON' and not exists (select 1 from symbols s where s.stable_key = e.source_key)), "
    "ranked as (select *, row_number() over (partition by rule order by key) as r from found) "
    "select rule, count(*) as n, string_agg(key, ',' order by key) filter (r <= 20) as samples from ranked group by rule"
)
def i1_integrity_report(g):
    return integrity.report(integrity.audit(g)).select("rule", "n", F.array_join("samples", ",").alias("samples"))


def _broken(g):
    """The graph without some symbols, packages and repositories, so that each rule has something to find."""
    g.symbols = g.symbols.filter("stable_key not in ('o:1', 'o:2', 'p:5', 'p:6')")
    g.packages = g.packages.filter("name not in ('NATION_3')")
    return g


_BROKEN = ", kept as (select * from symbols where stable_key not in ('o:1', 'o:2', 'p:5', 'p:6')), left_packages as (select * from packages where name <> 'NATION_3') "


@query(_BROKEN + f"select 'exact_edge_without_source' as rule, source_key || '|' || kind || '|' || target_key as key from edges where confidence in ({EXACT_LIST}) and ((kind <> 'PACKAGE_DEPENDS_ON' and source_key not in (select stable_key from kept)) or (kind = 'PACKAGE_DEPENDS_ON' and source_key not in (select stable_key from left_packages)))")
def i1_edge_without_source(g):
    return integrity.declared_ends(_broken(g), "source")


@query(_BROKEN + f"select 'exact_edge_without_target' as rule, source_key || '|' || kind || '|' || target_key as key from edges where confidence in ({EXACT_LIST}) and ((kind <> 'PACKAGE_DEPENDS_ON' and target_key not in (select stable_key from kept)) or (kind = 'PACKAGE_DEPENDS_ON' and target_key not in (select stable_key from left_packages)))")
def i2_edge_without_target(g):
    return integrity.declared_ends(_broken(g), "target")


@query("select 'missing_evidence_file' as rule, source_key || '|' || kind || '|' || target_key as key from edges where evidence_key is not null")
def i3_missing_evidence(g):
    return integrity.missing_evidence(g)


@query("select 'duplicate_stable_key' as rule, stable_key as key from symbols where kind = 'interface'")
def i4_duplicate_keys(g):
    g.evidence = g.symbols.filter("kind = 'interface'").select("stable_key")
    return integrity.duplicate_keys(g)


@query("select 'unknown_confidence' as rule, source_key || '|' || kind || '|' || target_key as key from edges where kind = 'REFERENCES'")
def i5_unknown_confidence(g):
    g.edges = g.edges.withColumn("provenance", F.when(F.col("kind") == "REFERENCES", "TREE_SITTER_SYNTAX").otherwise(F.col("provenance")))
    return integrity.unknown_confidence(g)


@query(
    _BROKEN + "select 'invalid_repository_ownership' as rule, f.stable_key as key from files f left join left_packages p on f.package_key = p.stable_key where p.repository_key is distinct from f.repository_key "
    "union all select 'invalid_repository_ownership', s.stable_key from kept s join files f on s.file_key = f.stable_key where f.package_key not in (select stable_key from left_packages)"
)
def i6_ownership(g):
    return integrity.broken_ownership(_broken(g))


@query(_BROKEN + "select 'files' as \"table\", stable_key as key, 0::bigint as containers from files where package_key not in (select stable_key from left_packages)")
def i7_container_counts(g):
    return integrity.container_counts(_broken(g))


# fact sets -----------------------------------------------------------------------------------------------------------


@query("select l_orderkey, l_linenumber, l_partkey, l_quantity from (select *, row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_quantity, l_extendedprice) as n from lineitem) where n = 1", graph=False)
def f1_merge_first(spark, d):
    rows = _table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return factsets.merge_first(rows, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query(
    _BROKEN + "select 'file_without_package' as problem, count(*) as n from files where package_key not in (select stable_key from left_packages) union all "
    "select 'edge_without_source', count(*) from edges where source_key not in (select stable_key from kept union all select stable_key from left_packages) union all "
    "select 'edge_without_target', count(*) from edges where target_key not in (select stable_key from kept union all select stable_key from left_packages)"
)
def f2_validate(g):
    return factsets.validate(_broken(g)).groupBy("problem").agg(F.count("*").alias("n"))


@query("select source as stable_key, string_agg(distinct lang, ',' order by lang) as languages from documents group by source", graph=False)
def f3_union_languages(spark, d):
    r = _table(spark, d, "documents").select(F.col("source").alias("stable_key"), F.array("lang").alias("languages"))
    return factsets.union_languages(r).select("stable_key", F.array_join("languages", ",").alias("languages"))


@query("select target_key as requested_symbol, count(*) as edges, min(source_key) as first_source from edges where kind <> 'PACKAGE_DEPENDS_ON' and target_key not in (select stable_key from symbols where kind <> 'variable') group by 1")
def f4_close_edges(g):
    kept, rows = factsets.close_edges(g.edges.filter("kind <> 'PACKAGE_DEPENDS_ON'"), g.symbols.filter("kind <> 'variable'"))
    return rows.select("requested_symbol", "edges", "first_source")


@query("select distinct f.package_key as source_key, p.stable_key as target_key from unresolved u join files f on f.repository_key = u.repository_key join packages p on p.name = u.requested_package and p.language = u.language where p.stable_key <> f.package_key")
def f5_infer_package_edges(g):
    """Requests of a repository count for each of its packages."""
    owners = g.files.select("package_key", "repository_key").distinct()
    asked = g.unresolved.select("repository_key", "language", "requested_package").distinct()
    return factsets.infer_package_edges(asked.join(owners, "repository_key"), g.packages)


# all parts, under names fine enough that some have one provider, some several and some none
_NAMES = "p_brand || '/' || p_type || '/' || cast(p_size as varchar)"
_ALL_PROVIDERS = f"(select {_NAMES} as name, 'p:' || cast(p_partkey as varchar) as provider, cast(p_partkey % 3 as varchar) as version from part)"


def _all_providers(spark, d):
    name = F.concat_ws("/", "p_brand", "p_type", F.col("p_size").cast("string"))
    return _table(spark, d, "part").select(
        name.alias("name"), F.concat(F.lit("p:"), F.col("p_partkey").cast("string")).alias("provider"),
        (F.col("p_partkey") % 3).cast("string").alias("version"), F.lit(None).cast("string").alias("replacement"),
    )


_ALL_REQUESTS = "(select distinct b || '/' || t || '/' || cast(p_size as varchar) as name from (select distinct p_brand as b from part) cross join (select distinct p_type as t from part) cross join (select distinct p_size from part))"


def _all_requests(spark, d):
    part = _table(spark, d, "part")
    each = lambda c: part.select(c).distinct()
    names = each("p_brand").crossJoin(each("p_type")).crossJoin(each("p_size"))  # brands, types and sizes are a fixed few
    return names.select(F.concat_ws("/", "p_brand", "p_type", F.col("p_size").cast("string")).alias("name"), F.lit("1").alias("version"))


@query(
    f"with p as (select name, count(*) as n, min(provider) as only_one, min(version) as offered from {_ALL_PROVIDERS} group by name) select r.name, case when n is null then 'NOT_FOUND' when n > 1 then 'AMBIGUOUS' when offered <> '1' then 'VERSION_MISMATCH' else 'RESOLVED' end as status, "
    f"case when n = 1 and offered = '1' then only_one end as provider from {_ALL_REQUESTS} r left join p on p.name = r.name",
    graph=False,
)
def f6_f7_provider_status(spark, d):
    return factsets.provider_status(_all_requests(spark, d), _all_providers(spark, d)).select("name", "status", "provider")


@query(f"select name, count(distinct provider) as providers, count(distinct version) as versions, case when count(distinct version) > 1 then 'VERSION_MISMATCH' else 'AMBIGUOUS_PROVIDER' end as conflict from {_ALL_PROVIDERS} group by name having count(distinct provider) > 1 or count(distinct version) > 1", graph=False)
def f8_provider_conflicts(spark, d):
    return factsets.provider_conflicts(_all_providers(spark, d))


_CRATES = f"(select {_NAMES} as name, 'p:' || cast(p_partkey as varchar) as provider, cast(p_partkey % 3 as varchar) as version, p_type = 'STANDARD' as lang from part)"
_CORE = factsets.LANG_ORIGIN + "core"


@query(
    f"with c as {_CRATES}, q as (select name, version from {_ALL_REQUESTS} cross join (values ('1'), ('7'), ('.'), ('{_CORE}'), (null)) v(version)), "
    "h as (select q.name, q.version, count(c.name) as n, count(*) filter (c.lang) as core, min(c.provider) filter (c.lang) as first_core, count(*) filter (not c.lang) as others, "
    "count(*) filter (not c.lang and c.version = q.version) as hits, min(c.provider) filter (not c.lang and c.version = q.version) as hit from q left join c on c.name = q.name group by q.name, q.version), "
    f"s as (select *, case when n = 0 or (version = '{_CORE}' and core = 0) then 'NOT_FOUND' when version = '{_CORE}' then case when core > 1 or others > 0 then 'AMBIGUOUS' else 'RESOLVED' end "
    "when version is null or version = '.' then 'VERSION_UNKNOWN' when hits = 0 then 'VERSION_MISMATCH' when hits > 1 then 'AMBIGUOUS' else 'RESOLVED' end as status from h) "
    f"select name, version, status, case when status = 'RESOLVED' then case when version = '{_CORE}' then first_core else hit end end as provider from s",
    graph=False,
)
def f7_resolve_all(spark, d):
    asked = F.explode(F.array(*(F.lit(v).cast("string") for v in ("1", "7", factsets.UNKNOWN_VERSION, _CORE, None))))
    p = _table(spark, d, "part")
    lang = F.concat(F.lit("p:"), F.col("p_partkey").cast("string")).alias("provider"), (F.col("p_type") == "STANDARD").alias("lang")
    return factsets.resolve_providers(_all_requests(spark, d).select("name", asked.alias("version")), _all_providers(spark, d).join(p.select(*lang), "provider"))


_MANIFESTS = f"(select {_NAMES} as name, p_name as repository, cast(p_partkey % 3 as varchar) as version, 'p:' || cast(p_partkey as varchar) as manifest, p_type in ('ECONOMY', 'PROMO', 'LARGE') as package, p_brand as old_path, p_name as new_path from part)"


@query(
    f"with m as {_MANIFESTS}, g as (select name, package, count(*) as n, count(distinct repository) as repositories, count(distinct version) as versions, count(distinct manifest) as manifests, count(distinct new_path) as targets from m group by name, package) "
    "select 'AMBIGUOUS_PACKAGE' as conflict, name, repositories, versions, manifests from g where package and n > 1 union all select 'VERSION_MISMATCH', name, repositories, versions, manifests from g where package and n > 1 and versions > 1 "
    "union all select 'AMBIGUOUS_MODULE', name, repositories, 0, manifests from g where not package and n > 1 union all select 'REPLACE_CONFLICT', name, repositories, 0, manifests from g where not package and n > 1 and targets > 1 "
    "union all select 'REPLACE_CONFLICT', old_path, count(distinct repository), 0, count(distinct manifest) from m where not package group by old_path having count(distinct name) > 1 and count(distinct new_path) > 1",
    graph=False,
)
def f8_classify_conflicts_all(spark, d):
    t = _table(spark, d, "part")
    text = lambda v: F.lit(v).cast("string")
    swap = F.struct(F.col("p_brand").alias("old_path"), text("").alias("old_version"), F.col("p_name").alias("new_path"), text("").alias("new_version"), text("").alias("new_local"))
    m = t.select(
        F.concat_ws("/", "p_brand", "p_type", F.col("p_size").cast("string")).alias("name"), F.col("p_name").alias("repository"), (F.col("p_partkey") % 3).cast("string").alias("version"),
        F.concat(F.lit("p:"), F.col("p_partkey").cast("string")).alias("manifest"), F.col("p_type").isin("ECONOMY", "PROMO", "LARGE").alias("package"), F.array(swap).alias("replacements"),
    )
    found = factsets.classify_conflicts(m.filter("package"), m.filter("not package"))
    return found.select("conflict", "name", *(F.size(c).cast("long").alias(c) for c in ("repositories", "versions", "manifests")))


@query(
    ", e as (select source_key, target_key, kind from edges union all select repository_key, stable_key, 'CONTAINS_PACKAGE' from packages union all select package_key, stable_key, 'CONTAINS_FILE' from files "
    "union all select 'o:gone', stable_key, 'CALLS_DIRECT' from symbols where kind = 'interface'), "
    "sym as (select e.*, a.file_key as source_file, b.file_key as target_file, a.stable_key is not null and b.stable_key is not null as there from e left join symbols a on a.stable_key = e.source_key left join symbols b on b.stable_key = e.target_key where e.kind not in ('CONTAINS_PACKAGE', 'CONTAINS_FILE', 'PACKAGE_DEPENDS_ON')) "
    "select 'symbol' as output, kind, source_key, target_key, source_file, target_file, null::bigint as n from sym where there "
    "union all select 'package', kind, source_key, target_key, null, null, null from e where kind = 'PACKAGE_DEPENDS_ON' "
    "union all select 'left out', kind, null, null, null, null, count(*) from e where kind like 'CONTAINS%' group by kind "
    "union all select 'left out', 'dangling:' || kind, null, null, null, null, count(*) from sym where not there group by kind"
)
def f11_snapshot_edges(g):
    """With the structural relations of packages and files, and some calls from a symbol that isn't there."""
    row = lambda t, source, target, kind: t.select(F.col(source).alias("source_key") if source else F.lit("o:gone").alias("source_key"), F.col(target).alias("target_key"), F.lit(kind).alias("kind"))
    more = row(g.packages, "repository_key", "stable_key", "CONTAINS_PACKAGE").union(row(g.files, "package_key", "stable_key", "CONTAINS_FILE"))
    g.edges = g.edges.select("source_key", "target_key", "kind").union(more).union(row(g.symbols.filter("kind = 'interface'"), None, "stable_key", "CALLS_DIRECT"))
    symbols, packages, left_out = factsets.snapshot_tables(g)
    none, n = F.lit(None).cast("string"), F.lit(None).cast("long").alias("n")
    edge = lambda df, name, *files: df.select(F.lit(name).alias("output"), "kind", "source_key", "target_key", *files, n)
    return edge(symbols, "symbol", "source_file", "target_file").union(edge(packages, "package", none.alias("source_file"), none.alias("target_file"))).union(
        left_out.select(F.lit("left out"), "kind", none, none, none, none, "n")
    )


@query("select count(*) as n, true as same_in_other_order, false as same_without_a_row, false as same_with_a_changed_value, false as same_with_a_moved_value from edges")
def f13_content_digest(g):
    """The digest of the edges against those of the same edges in another order and of three other contents."""
    e = g.edges
    first = F.col("source_key") == "o:1"
    moved = e.withColumn("provenance", F.when(F.col("evidence_key") == "evidence:o1", F.col("evidence_key")).otherwise(F.col("provenance")))
    moved = moved.withColumn("evidence_key", F.when(F.col("evidence_key") != "evidence:o1", F.col("evidence_key")))
    others = {
        "same_in_other_order": e.repartition("target_key").sortWithinPartitions(F.desc("source_key")), "same_without_a_row": e.filter(~(first & (F.col("kind") == "REFERENCES"))),
        "same_with_a_changed_value": e.withColumn("kind", F.when(first, "EXTENDS").otherwise(F.col("kind"))), "same_with_a_moved_value": moved,
    }
    out = factsets.digest(e)
    for name, other in others.items():
        out = out.crossJoin(factsets.digest(other).select(F.col("digest").alias(name)))  # one row each
    return out.select("n", *((F.col(c) == F.col("digest")).alias(c) for c in others))


@query()
def f13_digest(g):
    """Spark's hash has no equal in DuckDB: no SQL; a test holds it against a plain recomputation."""
    return factsets.digest(g.edges)


@query("select count(*) as expected, count(*) filter (confidence <> 'CANDIDATE') as observed, count(*) filter (confidence = 'CANDIDATE') as missing, 0::bigint as unexpected, 1.0::double as precision, count(*) filter (confidence <> 'CANDIDATE')::double / count(*) as recall from edges")
def f14_precision(g):
    e = g.edges.select("source_key", "target_key", "kind", "confidence")
    return factsets.precision(e, e.filter("confidence <> 'CANDIDATE'")).select("expected", "observed", "missing", "unexpected", "precision", "recall")


@query("select unit from (select source as unit, doc_id, sha256(text) as a, case when doc_id % 50 = 0 then '' else sha256(text) end as b from documents) where a <> b group by unit", graph=False)
def f15_stale_units(spark, d):
    t = _table(spark, d, "documents").select(F.col("source").alias("unit"), F.col("doc_id").alias("input"), F.sha2("text", 256).alias("fingerprint"))
    now = t.withColumn("fingerprint", F.when(F.col("input") % 50 == 0, "").otherwise(F.col("fingerprint")))
    return factsets.stale_units(t, now)


@query(
    """with f as (select doc_id // 20 as unit, count(*) as n, sum(coalesce(n_chars, 0))::bigint as size, bool_or(doc_id % 50 = 0 and text is distinct from '') as stale from documents group by 1)
    select 'on' as mode, unit, case when stale then 'miss' else 'hit' end as outcome, n, case when not stale and unit % 7 = 0 then size + 1 else size end as size from f
    union all select 'verify', unit, case when stale then 'miss' when unit % 7 = 0 then 'diverged' else 'verified' end, n, size from f union all select 'off', unit, 'off', n, size from f""",
    graph=False,
)
def f15_fact_cache(spark, d):
    """Twenty documents are a unit; one input in fifty has changed, and what is kept of some units was spoilt."""
    t = _table(spark, d, "documents").withColumn("unit", F.floor(F.col("doc_id") / 20))
    analyse = lambda units: t.join(units, "unit").groupBy("unit").agg(F.count("*").alias("n"), F.sum(F.coalesce("n_chars", F.lit(0))).cast("long").alias("size"))
    recorded = t.select("unit", F.col("doc_id").alias("input"), F.sha2("text", 256).alias("fingerprint"))
    current = recorded.withColumn("fingerprint", F.when(F.col("input") % 50 == 0, F.sha2(F.lit(""), 256)).otherwise(F.col("fingerprint")))
    units = t.select("unit").distinct()
    stored = analyse(units).withColumn("size", F.col("size") + F.when(F.col("unit") % 7 == 0, 1).otherwise(0))
    out = None
    for mode in ("on", "verify", "off"):
        facts, report = factsets.with_cache(mode, units, stored, recorded, current, analyse)
        rows = report.join(facts, "unit").select(F.lit(mode).alias("mode"), "unit", "outcome", "n", "size")
        out = rows if out is None else out.union(rows)
    return out


@query(
    """, p as (select p.stable_key as node, p.name, r.name as region from packages p join repositories r on p.repository_key = r.stable_key),
    d as (select distinct a.node, b.node as needed from edges e join p a on a.node = e.source_key join p b on b.node = e.target_key where e.kind = 'PACKAGE_DEPENDS_ON' and (a.name < b.name and a.region <> b.region or a.region = b.region and a.region in ('ASIA', 'EUROPE'))),
    reach as (select node, needed from d union select r.node, d.needed from reach r join d on d.node = r.needed),
    circle as (select a.node, min(b.node) as cycle from reach a join reach b on a.needed = b.node and b.needed = a.node group by a.node),
    free as (select node from p where node not in (select node from circle) and node not in (select r.node from reach r join circle c on r.needed = c.node)),
    walk as (select node, 0 as level from free union select d.node, w.level + 1 from walk w join d on d.needed = w.node join free f on f.node = d.node)
    select 'order' as part, node, max(level)::varchar as said from walk group by node union all select 'cycle', node, cycle from circle"""
)
def f10_order_and_cycles(g):
    """Packages by their dependencies: those on packages of other regions that are later by name, and within two regions all."""
    p = g.packages.join(g.repositories.select(F.col("stable_key").alias("repository_key"), F.col("name").alias("region")), "repository_key").select(F.col("stable_key").alias("node"), "name", "region")
    a, b = (p.toDF(*(f"{x}_{c}" for c in p.columns)) for x in "ab")
    e = g.edges.filter("kind = 'PACKAGE_DEPENDS_ON'").join(a, F.col("a_node") == F.col("source_key")).join(b, F.col("b_node") == F.col("target_key"))
    later, near = (F.col("a_name") < F.col("b_name")) & (F.col("a_region") != F.col("b_region")), (F.col("a_region") == F.col("b_region")) & F.col("a_region").isin("ASIA", "EUROPE")
    order, cycles = factsets.peeled(p.select("node"), e.filter(later | near).select(F.col("a_node").alias("node"), F.col("b_node").alias("needed")))
    said = lambda df, part, c: df.select(F.lit(part).alias("part"), "node", F.col(c).cast("string").alias("said"))
    return said(order, "order", "level").union(said(cycles, "cycle", "cycle"))


@query("select source_key, target_key, kind, confidence, provenance, coalesce(evidence_key, '') as evidence_key from edges order by all")
def s9_full_scan(g):
    return full_scan(g.edges)


#: The columns of each table of the projected graph, for the rows of a scan.
_SCANNED = {
    "repositories": "dirty language name stable_key", "packages": "language name repository_key stable_key", "files": "language package_key path repository_key stable_key",
    "symbols": "end_line file_key kind name qualified_name stable_key start_line", "edges": "confidence evidence_key kind provenance source_key target_key",
    "unresolved": "detail file_key language reason repository_key requested_package requested_symbol stable_key start_line",
}


def _scanned(name: str) -> str:
    key = "source_key || '|' || kind || '|' || target_key" if name == "edges" else "stable_key"
    row = ", ".join(f"'{c}': coalesce({c}::varchar, '')" for c in _SCANNED[name].split())
    return f"""select '{name}' as "table", {key} as key, to_json({{{row}}})::varchar as row from {name}"""


@query(" union all ".join(map(_scanned, _SCANNED)))
def s10_canonical_scan(g):
    return scan(g)


@query("select source_key, target_key, case when kind = 'REFERENCES' then 'CALLS_DIRECT' else kind end as kind from edges where not (kind = 'TYPE_USES' and target_key = 's:1')")
def s13_delta(g):
    e = g.edges.select("source_key", "target_key", "kind")
    changed = e.filter("kind = 'REFERENCES'").withColumn("kind", F.lit("CALLS_DIRECT"))
    return apply_delta(e, changed, e.filter("kind = 'TYPE_USES' and target_key = 's:1'"), ["source_key", "target_key"])


# source text ---------------------------------------------------------------------------------------------------------


def _modules(spark, d):
    """A Python module for each supplier: it imports a function of another one, and one in nine is broken."""
    n = F.col("s_suppkey").cast("string")
    other = (F.col("s_suppkey") % 7 + 1).cast("string")
    lines = [F.concat(F.lit("from pkg.s"), other, F.lit(" import run as other")), F.lit(""), F.concat(F.lit("class Supplier"), n, F.lit(":")), F.lit("    def go(self):"), F.lit("        return other(missing())"),
             F.lit(""), F.when(F.col("s_suppkey") % 9 == 0, "def run(x:").otherwise("def run(x):"), F.lit("    return x")]
    return _table(spark, d, "supplier").select(F.concat(F.lit("pkg/s"), n, F.lit(".py")).alias("path"), F.concat_ws("\n", *lines).alias("text"))


_MODULES = "with m as (select s_suppkey as n, 'pkg.s' || s_suppkey as module, 'pkg.s' || (s_suppkey % 7 + 1) || '.run' as other, 'pkg/s' || s_suppkey || '.py' as path from supplier where s_suppkey % 9 <> 0) "


@query(
    _MODULES + "select path, 's' || n as name, module as qualified_name, 'module' as kind, 1::bigint as start_line, 8::bigint as end_line from m union all "
    "select path, 'Supplier' || n, module || '.Supplier' || n, 'class', 3, 5 from m union all select path, 'go', module || '.Supplier' || n || '.go', 'method', 4, 5 from m union all "
    "select path, 'run', module || '.run', 'function', 7, 8 from m",
    graph=False,
)
def s5_python_symbols(spark, d):
    return source_code.python_symbols(_modules(spark, d)).drop("exported")


@query(
    _MODULES + ", known as (select module || '.run' as k from m), refs as (select module as source, 'IMPORTS_SYMBOL' as kind, other as requested from m union all "
    "select module || '.Supplier' || n || '.go', 'CALLS_DIRECT', other from m union all select module || '.Supplier' || n || '.go', 'CALLS_DIRECT', module || '.missing' from m) "
    "select source, kind, requested, case when requested in (select k from known) then 'CANDIDATE' else 'SYMBOL_NOT_FOUND' end as said from refs union all "
    "select 'pkg/s' || s_suppkey || '.py', null, null, 'SyntaxError' from supplier where s_suppkey % 9 = 0",
    graph=False,
)
def s5_python_relations(spark, d):
    files = _modules(spark, d)
    edges, unresolved = source_code.python_edges(source_code.python_symbols(files), source_code.python_references(files), source_code.python_aliases(files))
    out = edges.select(F.col("source_key").alias("source"), "kind", F.col("target_key").alias("requested"), F.col("confidence").alias("said"))
    out = out.union(unresolved.select("source", "kind", "requested_symbol", "reason"))
    none = F.lit(None).cast("string")
    return out.union(source_code.python_unresolved(files).select("path", none, none, F.substring_index("reason", ":", 1)))


@query(
    "with l as (select doc_id, unnest(string_split(text, chr(10))) as t, generate_subscripts(string_split(text, chr(10)), 1) as line from documents), "
    "c as (select doc_id, line, 'CALL' as kind, unnest(regexp_extract_all(t, '(?:^|[^A-Za-z0-9_])([A-Za-z_]\\w*)\\s*\\(', 1)) as name from l union all "
    "select doc_id, line, 'IDENTIFIER', unnest(regexp_extract_all(t, '(?:^|[^A-Za-z0-9_])([A-Za-z_]\\w*)', 1)) from l) "
    "select doc_id::varchar as path, kind, name, line, count(*) as n from c group by all",
    graph=False,
)
def s7_syntax_inventory(spark, d):
    t = _table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")
    return source_code.syntax_inventory(t, ["CALL", "IDENTIFIER"])


@query(
    """with r as (select 'pkg.r' || r_regionkey || '.R' || r_regionkey as c from region),
    n as (select 'pkg.n' || n_nationkey as m, 'pkg.n' || n_nationkey || '.N' || n_nationkey as c, n_nationkey as k, 'pkg.r' || n_regionkey || '.R' || n_regionkey as above, n_regionkey as rk from nation),
    s as (select 'pkg.t' || s_suppkey as m, 'pkg.t' || s_suppkey || '.T' || s_suppkey as c, n.c as above, n.above as top, rk from supplier join n on s_nationkey = k)
    select m as source, 'IMPORTS_SYMBOL' as kind, above as requested, 'CANDIDATE' as said from n union all select c, 'EXTENDS', above, 'CANDIDATE' from n
    union all select c || '.label', 'CALLS_DIRECT', above || '.label', 'CANDIDATE' from n
    union all select m, 'IMPORTS_SYMBOL', above, 'CANDIDATE' from s union all select c, 'EXTENDS', above, 'CANDIDATE' from s
    union all select c || '.go', 'CALLS_DIRECT', above || '.label', 'CANDIDATE' from s union all select c || '.go', 'CALLS_DIRECT', top || '.only' || rk, 'CANDIDATE' from s
    union all select c || '.stay', 'CALLS_DIRECT', m || '.run', 'CANDIDATE' from s
    union all select c || '.go', 'CALLS_DIRECT', 'run', 'LOCAL_VALUE' from s union all select c || '.stay', 'CALLS_DIRECT', c || '.none', 'SYMBOL_NOT_FOUND' from s
    union all select c || '.label', 'CALLS_DIRECT', 'builtins.super', 'SYMBOL_NOT_FOUND' from n""",
    graph=False,
)
def s5_scopes_and_inheritance(spark, d):
    """A class for each supplier, that inherits from its nation's, which inherits from its region's; names are shadowed."""
    t = {x: _table(spark, d, x) for x in ("region", "nation", "supplier")}
    fill = lambda text, **of: F.format_string(re.sub(r"\{(\w+)\}", "%s", text), *(of[k].cast("string") for k in re.findall(r"\{(\w+)\}", text)))
    r, n, s = F.col("r_regionkey"), F.col("n_nationkey"), F.col("s_suppkey")
    files = t["region"].select(fill("pkg/r{r}.py", r=r).alias("path"), fill("class R{r}:\n    def label(self): pass\n    def only{r}(self): pass\n", r=r).alias("text"))
    nation = "from pkg.r{r} import R{r} as Above\n\nclass N{n}(Above):\n    def label(self):\n        super().label()\n"
    files = files.union(t["nation"].select(fill("pkg/n{n}.py", n=n), fill(nation, n=n, r=F.col("n_regionkey"))))
    supplier = (
        "from pkg.n{n} import N{n}\n\ndef run(x): return x\n\nclass T{s}(N{n}):\n    def go(self, run):\n        run(self); self.label(); self.only{r}()\n"
        "    def stay(self):\n        return run(self.none())  # run(self.label())\n"
    )
    placed = t["supplier"].join(t["nation"], F.col("s_nationkey") == n)
    files = files.union(placed.select(fill("pkg/t{s}.py", s=s), fill(supplier, s=s, n=n, r=F.col("n_regionkey"))))
    edges, unresolved = source_code.python_edges(source_code.python_symbols(files), source_code.python_references(files), source_code.python_aliases(files))
    out = edges.select(F.col("source_key").alias("source"), "kind", F.col("target_key").alias("requested"), F.col("confidence").alias("said"))
    return out.union(unresolved.select("source", "kind", "requested_symbol", "reason"))


@query(
    """with d as (select doc_id::varchar as n, regexp_replace(coalesce(text, ''), '[^A-Za-z0-9 \n().:;,]', ' ', 'g') as safe from documents),
    p as (select n, 2 + length(safe) - length(replace(safe, chr(10), '')) as l, 4 + 2 * (length(safe) - length(replace(safe, chr(10), ''))) as m from d),
    c as (select n, unnest([('IMPORT', './m' || n, l, 2), ('IDENTIFIER', 'a', l, 0), ('EXPORT', 'K' || n, l + 1, 0), ('CLASS', 'K' || n, l + 1, 0), ('DECLARATION', 'K' || n, l + 1, 0), ('IDENTIFIER', 'K' || n, l + 1, 0),
        ('METHOD', 'run' || n, l + 2, 0), ('DECLARATION', 'run' || n, l + 2, 0), ('IDENTIFIER', 'run' || n, l + 2, 0), ('IDENTIFIER', 'x', l + 2, 0), ('CALL', 'call' || n, m, 0), ('IDENTIFIER', 'call' || n, m, 0), ('IDENTIFIER', 'x', m, 0),
        ('EXPORT', 'I' || n, m + 2, 0), ('INTERFACE', 'I' || n, m + 2, 0), ('DECLARATION', 'I' || n, m + 2, 0), ('IDENTIFIER', 'I' || n, m + 2, 0),
        ('EXPORT', 'f' || n, m + 3, 0), ('DECLARATION', 'f' || n, m + 3, 0), ('IDENTIFIER', 'f' || n, m + 3, 0)]) as c from p)
    select 'd' || n || '.ts' as path, c[1] as kind, c[2] as name, c[3]::bigint as line, (length(c[2]) + c[4])::bigint as bytes from c""",
    graph=False,
)
def s7_candidates(spark, d):
    """A file for each document, whose text stands in a comment, a string and a template of it: only the code around counts."""
    n, safe = F.col("doc_id").cast("string"), F.regexp_replace(F.coalesce("text", F.lit("")), r"[^A-Za-z0-9 \n().:;,]", " ")
    text = F.concat(
        F.lit("/*"), safe, F.lit("*/\nimport { a } from \"./m"), n, F.lit("\";\nexport class K"), n, F.lit(" {\n  run"), n, F.lit("(x) { return `"), safe, F.lit("${call"), n, F.lit("(x)}`; }\n}\nexport interface I"), n,
        F.lit(" {}\nexport function f"), n, F.lit("() { return \""), F.translate(safe, "\n", " "), F.lit("\"; }\n"),
    )
    files = _table(spark, d, "documents").select(F.concat(F.lit("d"), n, F.lit(".ts")).alias("path"), text.alias("text"))
    return source_code.syntax_candidates(files).select("path", "kind", "name", "line", (F.col("end_byte") - F.col("start_byte")).alias("bytes"))


def _workspace(spark, d):
    """A manifest and two files for each nation, and one broken manifest for each region."""
    n = _table(spark, d, "nation").join(_table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    at = lambda leaf: F.concat_ws("/", "r_name", "n_name", F.lit(leaf))
    manifest = F.concat(F.lit('{"name": "@x/'), F.col("n_name"), F.lit('", "version": "1.'), F.col("n_nationkey").cast("string"), F.lit('.0", "dependencies": {"@x/'), F.col("r_name"), F.lit('": "^2"}}'))
    files = n.select(at("package.json").alias("path"), manifest.alias("text"))
    for leaf in ("index.ts", "lib/deep/a.ts"):
        files = files.union(n.select(at(leaf), F.lit("")))
    return files.union(_table(spark, d, "region").select(F.concat_ws("/", "r_name", F.lit("package.json")), F.lit("{")))


@query(
    "select r_name || '/' || n_name || '/package.json' as path, 'typescript' as language, '@x/' || n_name as name, '1.' || n_nationkey || '.0' as version, '@x/' || r_name as dependency, '^2' as wanted, false as broken "
    "from nation join region on n_regionkey = r_regionkey union all select r_name || '/package.json', null, null, null, null, null, true from region",
    graph=False,
)
def s8_manifests(spark, d):
    found = source_code.manifests(_workspace(spark, d))
    return found.withColumn("broken", F.col("problem").isNotNull()).drop("problem")


@query(
    "with f as (select r_name || '/' || n_name as root, unnest(['package.json', 'index.ts', 'lib/deep/a.ts']) as leaf from nation join region on n_regionkey = r_regionkey) "
    "select root || '/' || leaf as path, root from f union all select r_name || '/package.json', null from region",
    graph=False,
)
def s8_file_owners(spark, d):
    return source_code.discovered(_workspace(spark, d))[1]


_METHODS = """with recursive owned as (select distinct l_suppkey as s, p_brand, p_type, p_size from lineitem join part on l_partkey = p_partkey),
    methods as (
        select distinct 's:' || s as owner, p_brand || '/' || p_type as name, false as pointer from owned
        union select 's:' || s, 'size' || p_size, false from owned where p_size > 10
        union select 'n:' || n_nationkey, 'size' || (n_nationkey % 10), false from nation
        union select 'n:' || n_nationkey, n_name, false from nation
        union select 'r:' || r_regionkey, 'size' || (5 + r_regionkey), true from region
        union select 'r:' || r_regionkey, r_name, true from region union select 'c:' || c_mktsegment, r_name, false from customer, region
        union select 'c:' || c_mktsegment, 'size' || length(c_mktsegment), false from customer),
    embeds as (
        select 's:' || s_suppkey as owner, 'n:' || s_nationkey as embedded, s_acctbal < 0 as pointer from supplier
        union all select distinct 's:' || s_suppkey, 'c:' || c_mktsegment, false from supplier join customer on c_custkey = s_suppkey
        union all select 'n:' || n_nationkey, 'r:' || n_regionkey, false from nation),
    wanted as (  -- a part embeds the interface of its size
        select 'p:' || p_partkey as interface, p_brand || '/' || p_type as name, 'p:' || p_partkey as owner from part
        union all select 'p:' || p_partkey, 'size' || p_size, 'z:' || p_size from part union select 'z:' || p_size, 'size' || p_size, 'z:' || p_size from part
        union select 'q:' || r_name, r_name, 'q:' || r_name from region),
    types as (select distinct owner as type from methods union select owner from embeds),
    ways as (
        select type, type as inner_type, 0 as depth, false as indirect from types
        union all select w.type, e.embedded, w.depth + 1, w.indirect or e.pointer from ways w join embeds e on e.owner = w.inner_type),
    met as (select type, inner_type, depth, count(*) > 1 as several, bool_or(indirect) as indirect from ways w
        where depth = (select min(depth) from ways x where x.type = w.type and x.inner_type = w.inner_type) group by all),
    found as (select m.type, d.name, d.owner, m.depth, several, d.pointer and not indirect as needs, min(m.depth) over (partition by m.type, d.name) as least from met m join methods d on d.owner = m.inner_type),
    own as (select type, name, min(owner) as owner, min(depth) as depth, bool_or(needs) as needs from found where depth = least group by type, name having count(*) = 1 and not bool_or(several)),
    whole as (
        select o.type, w.interface, bool_or(o.needs) as by_pointer from own o join wanted w on w.name = o.name
        join (select interface, count(*) as size from wanted group by interface) z on z.interface = w.interface
        where o.type like 's:%' group by o.type, w.interface, size having count(*) = size) """


@query(
    _METHODS + """select 'IMPLEMENTS' as kind, 'type' as level, type as source_key, interface as target_key, by_pointer as pointer, cast(null as int) as depth from whole
    union all select distinct 'IMPLEMENTS', 'method', o.owner || '.' || o.name, w.owner || '.' || w.name, by_pointer, null from whole h join wanted w on w.interface = h.interface join own o on o.type = h.type and o.name = w.name
    union all select 'EMBEDS', 'type', owner, embedded, pointer, null from embeds
    union all select distinct 'EMBEDS', 'type', 'p:' || p_partkey, 'z:' || p_size, false, null from part
    union all select distinct 'OVERRIDES', 'method', m.owner || '.' || m.name, o.owner || '.' || o.name, false, o.depth + 1
        from embeds e join methods m on m.owner = e.owner join own o on o.type = e.embedded and o.name = m.name""",
    graph=False,
)
def f9_type_relations(spark, d):
    """Parts as interfaces that embed the one of their size, regions' interfaces; suppliers with the methods of the parts that they
    deliver embed a nation, by pointer if they owe, and a market segment; nations embed regions, with methods of pointers."""
    t = {name: _table(spark, d, name) for name in ("part", "lineitem", "nation", "region", "supplier", "customer")}
    key = lambda letter, c: F.concat(F.lit(f"{letter}:"), F.col(c).cast("string"))
    size = lambda c: F.concat(F.lit("size"), c.cast("string"))
    yes, no = F.lit(True), F.lit(False)
    held = t["lineitem"].select("l_suppkey", F.col("l_partkey").alias("p_partkey")).distinct().join(t["part"], "p_partkey")
    product, segment = F.concat_ws("/", "p_brand", "p_type"), t["customer"].select("c_mktsegment").distinct()
    rows = [
        held.select(key("s", "l_suppkey").alias("owner"), product.alias("name"), no.alias("pointer")), held.filter("p_size > 10").select(key("s", "l_suppkey"), size(F.col("p_size")), no),
        t["nation"].select(key("n", "n_nationkey"), size(F.col("n_nationkey") % 10), no), t["nation"].select(key("n", "n_nationkey"), "n_name", no),
        t["region"].select(key("r", "r_regionkey"), size(F.col("r_regionkey") + 5), yes), t["region"].select(key("r", "r_regionkey"), "r_name", yes),
        segment.crossJoin(t["region"].select("r_name")).select(key("c", "c_mktsegment"), "r_name", no), segment.select(key("c", "c_mktsegment"), size(F.length("c_mktsegment")), no),
        t["part"].select(key("p", "p_partkey"), product, no), t["part"].select(key("z", "p_size"), size(F.col("p_size")), no), t["region"].select(key("q", "r_name"), "r_name", no),
    ]
    methods = rows[0]
    for more in rows[1:]:
        methods = methods.union(more)
    embeds = t["supplier"].select(key("s", "s_suppkey").alias("owner"), key("n", "s_nationkey").alias("embedded"), (F.col("s_acctbal") < 0).alias("pointer"))
    embeds = embeds.union(t["supplier"].join(t["customer"], F.col("c_custkey") == F.col("s_suppkey")).select(key("s", "s_suppkey"), key("c", "c_mktsegment"), no))
    embeds = embeds.union(t["nation"].select(key("n", "n_nationkey"), key("r", "n_regionkey"), no)).union(t["part"].select(key("p", "p_partkey"), key("z", "p_size"), no))
    of = lambda name, letter, c, interface: t[name].select(key(letter, c).alias("type"), F.lit(interface).alias("interface"))
    types = of("part", "p", "p_partkey", True).union(of("part", "z", "p_size", True)).union(of("region", "q", "r_name", True)).union(of("supplier", "s", "s_suppkey", False))
    return methodsets.type_relations(types, methods.withColumn("signature", F.lit(None).cast("string")), embeds)


# events --------------------------------------------------------------------------------------------------------------


def _events(spark, d):
    return _table(spark, d, "events").select("ts", F.col("event_id").alias("seq"), F.lit("tool").alias("kind"), F.col("event_type").alias("tool"), F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"), F.col("value").alias("duration_ms"))


@query("select event_id as seq, event_type as tool, value as duration_ms from events where event_type = 'error' order by ts desc, event_id desc limit 200", graph=False)
def e1_read_events(spark, d):
    return events.read_events(_events(spark, d), failures_only=True, newest=200).select("seq", "tool", "duration_ms")


@query(
    """with r as (select event_type as tool, value, row_number() over (partition by event_type order by value) as k, count(*) over (partition by event_type) as n from events where value is not null)
    select c.tool, c.calls, c.ok, c.failed, p.median, p.p95, c.max from
    (select event_type as tool, count(*) as calls, count(*) filter (event_type <> 'error') as ok, count(*) filter (event_type = 'error') as failed, max(value) as max from events group by 1) c left join
    (select tool, max(case when k = greatest(1, least(n, floor(n * 0.5 + 0.5))) then value end) as median, max(case when k = greatest(1, least(n, floor(n * 0.95 + 0.5))) then value end) as p95 from r group by 1) p on c.tool = p.tool""",
    graph=False,
)
def e2_e3_tool_summary(spark, d):
    return events.summarize(_events(spark, d)).select("tool", "calls", "ok", "failed", "median", "p95", "max")


@query("select event_type as tool, count(*) filter (event_type <> 'error')::double / count(*) as success_rate from events group by 1", graph=False)
def e4_success_rate(spark, d):
    return events.summarize(_events(spark, d)).select("tool", "success_rate")


@query("select event_type as tool, count(*) as calls, count(*) filter (event_type = 'error') as failures, count(value) as latency_count, max(value) as latency_max from events group by 1", graph=False)
def e5_metrics(spark, d):
    return events.metrics(_events(spark, d)).select("tool", "calls", "failures", "latency_count", "latency_max")


# changes -------------------------------------------------------------------------------------------------------------

_STATES = "with a as (select cast(doc_id // 2 as varchar) as path, sha256(text) as h from documents where doc_id % 2 = 0), b as (select cast(doc_id // 2 as varchar) || case when doc_id % 3 = 0 then 'x' else '' end as path, sha256(text) as h from documents where doc_id % 2 = 1) "


def _states(spark, d):
    t = _table(spark, d, "documents")
    path = F.floor(F.col("doc_id") / 2).cast("string")
    h = changes.content_hash(F.col("text")).alias("hash")
    new = F.concat(path, F.when(F.col("doc_id") % 3 == 0, "x").otherwise(""))
    return t.filter("doc_id % 2 = 0").select(path.alias("path"), h), t.filter("doc_id % 2 = 1").select(new.alias("path"), h)


@query(_STATES + "select coalesce(a.path, b.path) as path, case when a.path is null then 'added' when b.path is null then 'removed' when a.h = b.h then 'unchanged' else 'modified' end as status from a full join b on a.path = b.path", graph=False)
def c4_reconcile(spark, d):
    return changes.reconcile(*_states(spark, d)).select("path", "status")


@query(
    "with k as (select source as repository, doc_id::varchar as path, sha256(coalesce(text, '')) as hash from documents where doc_id % 4 <> 0), "
    "o as (select source as repository, doc_id::varchar as path, case when doc_id % 5 = 0 then null when doc_id % 3 = 0 then sha256(coalesce(text, '') || '!') else sha256(coalesce(text, '')) end as hash from documents where doc_id % 2 = 0 or doc_id % 3 = 0) "
    "select coalesce(k.repository, o.repository) as repository, coalesce(k.path, o.path) as path, "
    "case when o.path is null then null when o.hash is null then case when k.hash is null then 'skipped' else 'removed' end when o.hash = k.hash then 'unchanged' else 'changed' end as status, "
    "case when o.path is null then k.hash else o.hash end as hash from k full join o on k.path = o.path and k.repository is not distinct from o.repository",
    graph=False,
)
def c3_content_filter(spark, d):
    """The state holds three documents in four; the batch tells of some, changed, gone, or unknown."""
    t = _table(spark, d, "documents").select(F.col("source").alias("repository"), F.col("doc_id").cast("string").alias("path"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    known = t.filter("doc_id % 4 <> 0").select("repository", "path", changes.content_hash(F.col("text")).alias("hash"))
    now = F.when(F.col("doc_id") % 5 == 0, None).when(F.col("doc_id") % 3 == 0, changes.content_hash(F.concat("text", F.lit("!")))).otherwise(changes.content_hash(F.col("text")))
    return changes.content_filter(known, t.filter("doc_id % 2 = 0 or doc_id % 3 = 0").select("repository", "path", now.alias("hash")))


@query(
    "with a as (select doc_id::varchar as path, sha256(text) as h from documents where text is not null), "
    "b as (select doc_id::varchar || case when doc_id % 3 = 0 then 'x' else '' end as path, sha256(text || case when doc_id % 5 = 0 then '!' else '' end) as h from documents where doc_id % 7 <> 0 and text is not null), "
    "c as (select coalesce(a.path, b.path) as path, a.h as oh, b.h as nh, a.path is null as added, b.path is null as removed from a full join b on a.path = b.path) "
    "select o.h as hash, o.path as old_path, n.path as new_path from (select oh as h, min(path) as path from c where removed group by 1 having count(*) = 1) o join (select nh as h, min(path) as path from c where added group by 1 having count(*) = 1) n on o.h = n.h",
    graph=False,
)
def c5_renames(spark, d):
    """Of all documents a third is moved, a fifth changed, a seventh gone."""
    t = _table(spark, d, "documents").filter("text is not null").select(F.col("doc_id").cast("string").alias("path"), "doc_id", "text")
    old = t.select("path", changes.content_hash(F.col("text")).alias("hash"))
    path = F.concat("path", F.when(F.col("doc_id") % 3 == 0, "x").otherwise(""))
    text = F.concat("text", F.when(F.col("doc_id") % 5 == 0, "!").otherwise(""))
    new = t.filter("doc_id % 7 <> 0").select(path.alias("path"), changes.content_hash(text).alias("hash"))
    return changes.renames(changes.reconcile(old, new))


@query(graph=False)
def c2_debounce(spark, d):
    """The cap on a batch makes its bounds depend on each other: no SQL; a test holds it against a walk."""
    e = _table(spark, d, "events").select(
        F.concat(F.lit("r"), (F.col("user_id") % 7).cast("string")).alias("repository"), F.concat(F.lit("f"), (F.col("event_id") % 11).cast("string")).alias("path"),
        F.when(F.col("event_type") == "error", 4).otherwise(1).alias("operations"), F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / 300).alias("ms"),
    )
    return debounce(e)


_MOVES = """with e as (select 'w' || user_id % 3 as workspace, epoch_us(ts) // 1000000 as t, event_id as seq, 'r' || user_id % 7 as repository, event_type = 'error' as busy, event_type = 'purchase' and event_id % 4 = 0 as failed from events),
    g as (select *, case when t - lag(t) over (partition by workspace order by t, seq) >= 60 then 1 else 0 end as gap from e),
    r as (select *, sum(gap) over (partition by workspace order by t, seq rows unbounded preceding) as run from g),
    o as (select * from (select *, max(case when busy then 0 else 1 end) over (partition by workspace, run order by t, seq rows unbounded preceding) as open from r) where open = 1),
    u as (select workspace, run, max(t) + 60 as closed, max(case when failed and not busy then 1 else 0 end) as back from o group by 1, 2),
    n as (select *, coalesce(sum(1 - back) over (partition by workspace order by run rows between unbounded preceding and 1 preceding), 0) as batch from u),
    c as (select *, max(case when back = 0 then closed end) over (partition by workspace, batch) as done from n) """


@query(
    _MOVES + "select o.workspace, c.batch::bigint as batch, o.repository, arg_min(o.seq, (o.t, o.seq)) as from_commit, arg_max(o.seq + 1, (o.t, o.seq)) as to_commit, count(*) as n, max(c.done) as closed "
    "from o join c on c.workspace = o.workspace and c.run = o.run where not o.busy group by o.workspace, c.batch, o.repository",
    graph=False,
)
def c6_resync_batches(spark, d):
    """All events as head moves: errors keep a repository busy, some purchases fail and are taken up by the next batch."""
    return changes.resync_batches(_moves(spark, d), 60).withColumn("batch", F.col("batch").cast("long"))


def _moves(spark, d):
    e, of = _table(spark, d, "events"), lambda letter, n: F.concat(F.lit(letter), (F.col("user_id") % n).cast("string"))
    return e.select(
        of("w", 3).alias("workspace"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).alias("ts"), F.col("event_id").alias("seq"), of("r", 7).alias("repository"),
        F.col("event_id").alias("from_commit"), (F.col("event_id") + 1).alias("to_commit"), (F.col("event_type") == "error").alias("busy"),
        ((F.col("event_type") == "purchase") & (F.col("event_id") % 4 == 0)).alias("failed"),
    )


@query("select 'r' || user_id % 7 as repository, arg_min(event_id, (epoch_us(ts) // 1000000, event_id)) as from_commit, arg_max(event_id + 1, (epoch_us(ts) // 1000000, event_id)) as to_commit, count(*) as n from events group by 1", graph=False)
def c6_coalesce_moves(spark, d):
    return changes.coalesce_moves(_moves(spark, d))


# viewer --------------------------------------------------------------------------------------------------------------

_BOXES = "(select 'p:' || p_partkey as id, p_size % 4 as level, (p_partkey * 37 % 5000)::double as x, p_size * 40.0::double as y, (20 + p_size)::double as w, 16.0::double as h from part)"


def _boxes(spark, d):
    t = _table(spark, d, "part")
    return t.select(
        F.concat(F.lit("p:"), F.col("p_partkey").cast("string")).alias("id"), (F.col("p_size") % 4).alias("level"), (F.col("p_partkey") * 37 % 5000).cast("double").alias("x"),
        (F.col("p_size") * 40).cast("double").alias("y"), (F.col("p_size") + 20).cast("double").alias("w"), F.lit(16.0).alias("h"),
    )


@query(f"select id, level, x, y, count(*) over () > 100 as truncated from {_BOXES} where level <= 2 and x <= 1500 and x + w >= 300 and y <= 900 and y + h >= 200 order by id limit 100", graph=False)
def v6_viewport(spark, d):
    return spatial.viewport(spatial.cells(_boxes(spark, d)), 300, 200, 1500, 900, 2, 100).select("id", "level", "x", "y", "truncated")


@query(f"select cx, cy, count(*) as n from (select id, unnest(range(floor(x / 256)::bigint, floor((x + w) / 256)::bigint + 1)) as cx, y, h from {_BOXES}) t, lateral (select unnest(range(floor(y / 256)::bigint, floor((y + h) / 256)::bigint + 1)) as cy) u group by all", graph=False)
def v5_grid_index(spark, d):
    return spatial.cells(_boxes(spark, d)).groupBy("cx", "cy").agg(F.count("*").alias("n"))


@query(
    "with b as (select n_name as parent, c_custkey as id, (10 + c_custkey % 7)::double as w, (8 + c_custkey % 5)::double as h from customer join nation on c_nationkey = n_nationkey), "
    "p as (select *, row_number() over (partition by parent order by id) - 1 as no, greatest(1, round(sqrt(count(*) over (partition by parent) * avg(h) over (partition by parent) / avg(w) over (partition by parent))))::bigint as cols from b), "
    "q as (select *, no // cols as row, no % cols as col from p), "
    "cw as (select parent, col, coalesce(sum(max(w) + 8) over (partition by parent order by col rows between unbounded preceding and 1 preceding), 0)::double as x from q group by parent, col), "
    "rh as (select parent, row, coalesce(sum(max(h) + 8) over (partition by parent order by row rows between unbounded preceding and 1 preceding), 0)::double as y from q group by parent, row) "
    "select q.parent, q.id, cw.x, rh.y, q.w, q.h from q join cw on cw.parent = q.parent and cw.col = q.col join rh on rh.parent = q.parent and rh.row = q.row",
    graph=False,
)
def v4_layout(spark, d):
    c = _table(spark, d, "customer").join(_table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    b = c.select(F.col("n_name").alias("parent"), F.col("c_custkey").alias("id"), (F.col("c_custkey") % 7 + 10).cast("double").alias("w"), (F.col("c_custkey") % 5 + 8).cast("double").alias("h"))
    return spatial.pack(b)


def _packed(name: str, source: str) -> str:
    """CTEs that pack the boxes (parent, id, w, h) of a source."""
    of = "over (partition by parent)"
    before = "rows between unbounded preceding and 1 preceding"
    return (
        f"{name}_p as (select *, row_number() over (partition by parent order by id) - 1 as no, greatest(1, round(sqrt(count(*) {of} * avg(h) {of} / avg(w) {of})))::bigint as cols from {source}), "
        f"{name}_q as (select *, no // cols as r, no % cols as c from {name}_p), "
        f"{name}_x as (select parent, c, coalesce(sum(max(w) + 8) over (partition by parent order by c {before}), 0)::double as x from {name}_q group by parent, c), "
        f"{name}_y as (select parent, r, coalesce(sum(max(h) + 8) over (partition by parent order by r {before}), 0)::double as y from {name}_q group by parent, r), "
        f"{name} as (select q.parent, q.id, x, y, w, h from {name}_q q join {name}_x a on a.parent = q.parent and a.c = q.c join {name}_y b on b.parent = q.parent and b.r = q.r)"
    )


_AROUND = "max(x + w) + 16 as w, max(y + h) + 16 as h"


@query(
    "with c as (select 'n:' || c_nationkey as parent, 'c:' || c_custkey as id, (10 + c_custkey % 7)::double as w, (8 + c_custkey % 5)::double as h from customer), " + _packed("l2", "c")
    + f", n as (select 'r:' || n_regionkey as parent, 'n:' || n_nationkey as id, greatest(30, coalesce(a.w, 0))::double as w, greatest(20, coalesce(a.h, 0))::double as h from nation left join (select parent, {_AROUND} from l2 group by parent) a on a.parent = 'n:' || n_nationkey), " + _packed("l1", "n")
    + f", r as (select '' as parent, 'r:' || r_regionkey as id, greatest(40, coalesce(a.w, 0))::double as w, greatest(20, coalesce(a.h, 0))::double as h from region left join (select parent, {_AROUND} from l1 group by parent) a on a.parent = 'r:' || r_regionkey), " + _packed("l0", "r")
    + ", d1 as (select l1.id, l1.parent, l1.x + l0.x + 8 as x, l1.y + l0.y + 8 as y, l1.w, l1.h from l1 join l0 on l0.id = l1.parent) "
    "select id, null as parent, 0 as level, x, y, w, h from l0 union all select id, parent, 1, x, y, w, h from d1 union all "
    "select l2.id, l2.parent, 2, l2.x + d1.x + 8, l2.y + d1.y + 8, l2.w, l2.h from l2 join d1 on d1.id = l2.parent",
    graph=False,
)
def v4_nested_layout(spark, d):
    """Customers in nations in regions."""
    key = lambda letter, c: F.concat(F.lit(f"{letter}:"), F.col(c).cast("string"))
    size = lambda w, h: (w.cast("double").alias("w"), h.cast("double").alias("h"))
    r = _table(spark, d, "region").select(key("r", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"), *size(F.lit(40), F.lit(20)))
    n = _table(spark, d, "nation").select(key("n", "n_nationkey"), key("r", "n_regionkey"), *size(F.lit(30), F.lit(20)))
    c = _table(spark, d, "customer").select(key("c", "c_custkey"), key("n", "c_nationkey"), *size(F.col("c_custkey") % 7 + 10, F.col("c_custkey") % 5 + 8))
    return spatial.layout(r.union(n).union(c))


@query(
    _walk("source_key", "target_key", _ORDERS, 2) + ", back as (select stable_key as root, stable_key as id, 0 as depth from symbols where kind = 'function' union "
    "select w.root, e.source_key, w.depth + 1 from back w join edges e on e.target_key = w.id where w.depth < 2 and e.kind <> 'PACKAGE_DEPENDS_ON') "
    "select root, id from visits union select root, id from back"
)
def v2_neighborhood(g):
    return traverse.neighborhood(_walkable(g, "outgoing", "incoming").clustered, _roots(g, _ORDERS), 2, 25_000).select("root", "id")


@query(_walk("source_key", "target_key", _ORDERS, 2) + "select v.root, e.source_key, e.target_key, e.kind from edges e join visits v on e.source_key = v.id join visits w on w.root = v.root and w.id = e.target_key")
def v3_induced_subgraph(g):
    seeds = _roots(g, _ORDERS).select("root", F.col("root").alias("id"))
    return traverse.induced_walk(_walkable(g, "outgoing"), seeds, "outgoing", 2, 25_000)


@query("select e.source_key, e.target_key from edges e join packages a on e.source_key = a.stable_key join packages b on e.target_key = b.stable_key where a.repository_key in ('repository:ASIA', 'repository:EUROPE') and b.repository_key in ('repository:ASIA', 'repository:EUROPE')")
def v7_package_edges(g):
    visible = g.packages.filter(F.col("repository_key").isin("repository:ASIA", "repository:EUROPE")).select(F.col("stable_key").alias("id"))
    return spatial.visible_edges(g.edges.filter("kind = 'PACKAGE_DEPENDS_ON'").select("source_key", "target_key"), visible)


@query(LOCATED + "select stable_key, name, repository, path from located where name = 'Supplier#000000007' or qualified_name = 'NATION_1.Order40'")
def v1_viewer_search(g):
    hits = search.find_symbols(g, "Supplier#000000007").union(search.find_symbols(g, "NATION_1.Order40", "qualified_exact"))
    return search.located(g, hits.select("stable_key", "name", "file_key")).select("stable_key", "name", "repository", "path")


# scalar helpers ------------------------------------------------------------------------------------------------------


@query(
    "select o_orderkey, regexp_replace(o_orderpriority, '([.])', '\\\\\\1', 'g') as quoted, 'ASIA:' || o_orderpriority || ':' || o_orderkey as location, substr(sha256(cast(o_orderkey as varchar)), 1, 7) as short, "
    "case when contains('x in ' || o_orderstatus, ' in ') then o_orderstatus end as scope from orders",
    graph=False,
)
def x_scalar_functions(spark, d):
    o = _table(spark, d, "orders")
    return o.select(
        "o_orderkey", status.quote_word(F.col("o_orderpriority")).alias("quoted"), keys.location(F.lit("ASIA"), F.col("o_orderpriority"), F.col("o_orderkey")).alias("location"),
        keys.short_commit(F.sha2(F.col("o_orderkey").cast("string"), 256)).alias("short"), status.scope_directory(F.concat(F.lit("x in "), "o_orderstatus")).alias("scope"),
    )
