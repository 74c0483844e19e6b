"""The star-schema and corpus tables of the driver as a graph, so that every operator has data of any size to run on.

Regions are repositories, nations packages, customers, suppliers, orders and parts symbols; parts live in a derived
repository.  Orders refer to customers and call parts, parts use suppliers, and an order of exactly 50 pieces of a part
implements it.  The projection is plain SQL that DuckDB reads too, so an oracle starts from the same graph.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from factlake.schema import Graph

NATIONS = """
    select n.n_nationkey as nk, n.n_name as nation, r.r_name as region from nation n join region r on n.n_regionkey = r.r_regionkey
"""

VIEWS: dict[str, str] = {
    "repositories": """
        select 'repository:' || r_name as stable_key, r_name as name, 'sql' as language, r_regionkey % 2 = 1 as dirty from region
        union all select 'repository:derived:catalog', 'derived:catalog', 'sql', false
    """,
    "packages": f"""
        select 'package:sql:' || region || ':' || nation as stable_key, 'repository:' || region as repository_key,
               'sql' as language, nation as name from ({NATIONS}) x
        union all
        select distinct 'package:sql:derived:catalog:' || p_brand, 'repository:derived:catalog', 'sql', p_brand from part
    """,
    "files": f"""
        select 'file:' || region || ':' || nation || '/' || leaf as stable_key, 'repository:' || region as repository_key,
               'package:sql:' || region || ':' || nation as package_key, nation || '/' || leaf as path, 'sql' as language
        from ({NATIONS}) x cross join (
            select distinct c_mktsegment as leaf from customer union all select 'orders' union all select 'suppliers') y
        union all
        select distinct 'file:derived:catalog:' || p_brand || '/' || p_type, 'repository:derived:catalog',
               'package:sql:derived:catalog:' || p_brand, p_brand || '/' || p_type, 'sql' from part
    """,
    "symbols": f"""
        select 'c:' || cast(c_custkey as string) as stable_key, 'file:' || region || ':' || nation || '/' || c_mktsegment as file_key,
               c_name as name, nation || '.' || c_name as qualified_name, 'struct' as kind,
               cast(c_custkey * 10 as bigint) as start_line, cast(c_custkey * 10 + 9 as bigint) as end_line
        from customer join ({NATIONS}) x on c_nationkey = nk
        union all
        select 's:' || cast(s_suppkey as string), 'file:' || region || ':' || nation || '/suppliers', s_name,
               nation || '.' || s_name, 'interface', cast(s_suppkey * 4 as bigint), cast(s_suppkey * 4 + 3 as bigint)
        from supplier join ({NATIONS}) x on s_nationkey = nk
        union all
        select 'o:' || cast(o_orderkey as string), 'file:' || region || ':' || nation || '/orders',
               'Order' || cast(o_orderkey as string), nation || '.Order' || cast(o_orderkey as string), 'function',
               cast(o_orderkey as bigint), cast(o_orderkey + 1 as bigint)
        from orders join customer on o_custkey = c_custkey join ({NATIONS}) x on c_nationkey = nk
        union all
        select 'p:' || cast(p_partkey as string), 'file:derived:catalog:' || p_brand || '/' || p_type, p_name,
               p_brand || '.' || p_name, case when p_size % 5 = 0 then 'variable' else 'type' end,
               cast(p_partkey * 2 as bigint), cast(p_partkey * 2 + p_size as bigint)
        from part
    """,
    "edges": f"""
        select 'o:' || cast(o_orderkey as string) as source_key, 'c:' || cast(o_custkey as string) as target_key,
               'REFERENCES' as kind, 'EXACT_TYPECHECKED' as confidence, 'GO_TYPES' as provenance,
               'evidence:o' || cast(o_orderkey as string) as evidence_key
        from orders
        union all
        select 'o:' || cast(l_orderkey as string), 'p:' || cast(l_partkey as string), 'CALLS_DIRECT',
               case min(l_returnflag) when 'A' then 'EXACT_TYPECHECKED' when 'R' then 'EXACT_PACKAGE_MAPPED' else 'CANDIDATE' end,
               'GO_TYPES', cast(null as string)
        from lineitem group by l_orderkey, l_partkey
        union all
        select 'p:' || cast(l_partkey as string), 's:' || cast(l_suppkey as string), 'TYPE_USES',
               case min(l_returnflag) when 'A' then 'EXACT_TYPECHECKED' when 'R' then 'EXACT_PACKAGE_MAPPED' else 'CANDIDATE' end,
               'GO_TYPES', cast(null as string)
        from lineitem group by l_partkey, l_suppkey
        union all
        select distinct 'o:' || cast(l_orderkey as string), 'p:' || cast(l_partkey as string), 'IMPLEMENTS',
               'EXACT_TYPECHECKED', 'GO_TYPES', cast(null as string)
        from lineitem where l_quantity = 50
        union all
        select distinct 'package:sql:' || a.region || ':' || a.nation, 'package:sql:' || b.region || ':' || b.nation,
               'PACKAGE_DEPENDS_ON', 'EXACT_PACKAGE_MAPPED', 'GO_MODULES', cast(null as string)
        from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
             join supplier on l_suppkey = s_suppkey join ({NATIONS}) a on c_nationkey = a.nk join ({NATIONS}) b on s_nationkey = b.nk
        where l_quantity >= 49 and c_nationkey <> s_nationkey
    """,
    "unresolved": f"""
        select 'unresolved:doc:' || cast(d.doc_id as string) as stable_key, 'repository:' || r_name as repository_key,
               cast(null as string) as file_key, d.lang as language, d.source as requested_package,
               cast(null as string) as requested_symbol, 'UNLABELLED' as reason, 'no label in ' || d.source as detail,
               cast(0 as bigint) as start_line
        from documents d join region on d.doc_id % 5 = r_regionkey left join labels l on d.doc_id = l.doc_id
        where l.doc_id is null
        union all
        select 'unresolved:order:' || cast(o_orderkey as string),
               'repository:' || (case when region = 'ASIA' then 'EUROPE' else 'ASIA' end),
               'file:' || (case when region = 'ASIA' then 'EUROPE' else 'ASIA' end) || ':desk/' || cast(o_orderkey % 7 as string), 'sql',
               nation, nation || '.' || c_name, 'SYMBOL_NOT_FOUND', 'named by an urgent order', cast(o_orderkey as bigint)
        from orders join customer on o_custkey = c_custkey join ({NATIONS}) x on c_nationkey = nk
        where o_orderpriority = '1-URGENT'
    """,
}

TABLES = "region nation customer supplier part orders lineitem documents labels".split()


def project(spark: SparkSession, sf_dir: str, views: dict[str, str] = VIEWS) -> Graph:
    """The graph of the tables in ``sf_dir``; nothing is read before an operator needs it."""
    tables: dict[str, DataFrame] = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}
    # names that no one else uses, in place of the tables' own
    return Graph(**{name: spark.sql(_with_tables(sql, tables), **tables) for name, sql in views.items()})


def _with_tables(sql: str, tables: dict[str, DataFrame]) -> str:
    """The tables' names as parameters, under an alias that is theirs unless one follows."""
    names = "|".join(tables)
    return re.sub(
        rf"\b(from|join) ({names})\b(?:\s+(?!join\b|left\b|where\b|group\b|on\b|union\b|cross\b)(\w+)\b)?",
        lambda m: f"{m[1]} {{{m[2]}}} {m[3] or m[2]}", sql,
    )


def ctes(views: dict[str, str] = VIEWS) -> str:
    """The same graph for DuckDB, as the head of a query; the tables are views there."""
    return "with recursive " + ", ".join(f"{k} as ({v})" for k, v in views.items())
