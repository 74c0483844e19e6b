"""Bounded breadth-first traversal from many roots at once, and what is counted over it.

A level is one join of the frontier with each node's list of far ends; a node belongs to whoever finds it first in the order of
the frontier and, there, of the edges (the other end's key, then kind, confidence, provenance, evidence).  Levels are kept as
columns in the shared folder.  Frontier and visited nodes are bounded by ``max_nodes`` for each root.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factlake.operators.adjacency import DIRECTIONS, NO_NOTE, NOTE, TOLD, Clustered, hops, met, noted_id, released, walkable
from factlake.operators.adjacency import coded as _coded
from factlake.operators.grouped import distinct_ends, grouped, level_schema, next_level
from factlake.operators.search import keeps_derived
from factlake.schema import MAX_DEPTH, MAX_NODES, QUIET_IMPACT_KINDS, REFERENCE_KINDS, Graph

#: A root gathers the lists of a level in one row if they hold so many far ends at most.
GATHERED = 1_000_000


def checkpoints(spark: SparkSession) -> str:
    """The session's checkpoint folder; one of our own only where none is set, in local mode."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path:
            if not sc.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            path = tempfile.mkdtemp(prefix="factlake-checkpoint-")
        sc.setCheckpointDir(path)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the session's checkpoint folder."""
    checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def kept(df: DataFrame, by: str | None = None) -> DataFrame:
    """``df`` written as compressed columns below the session's checkpoint folder, and read from there; in buckets of a column."""
    spark = df.sparkSession
    name = f"kept_{uuid.uuid4().hex}"
    path = f"{checkpoints(spark)}/{name}"
    if by is None:
        df.write.option("compression", "zstd").parquet(path)
        released(spark)
        return spark.read.schema(df.schema).parquet(path)
    df.write.format("parquet").option("compression", "zstd").bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), by).option("path", path).saveAsTable(name)
    released(spark)
    return spark.table(name)


def traverse(
    edges: DataFrame | Clustered, seeds: DataFrame, direction: str = "outgoing", depth: int = 3, max_nodes: int = 5_000,
    kinds: list[str] | None = None, confidences: list[str] | None = None, told: tuple[str, ...] = TOLD, notes: DataFrame | None = None,
) -> DataFrame:
    """(root, id, depth, pos, parent, kind, confidence, truncated) for seeds (root, id): all nodes in discovery order.

    Seeds have depth 0 and count; a root is ``truncated`` if a node was met that ``max_nodes`` had no room for.  ``told`` names which
    of parent, kind and confidence are wanted.  ``notes`` (id, note: 0 to 99,999,999) are carried along as a column ``note``, null
    where an id has none; they meet the edges, which are fewer than the visits.
    """
    if direction not in DIRECTIONS or not 0 <= depth <= MAX_DEPTH or not 1 <= max_nodes <= MAX_NODES:
        raise ValueError("direction, depth or max_nodes out of bounds")
    levels = walk(edges, seeds, direction, depth, max_nodes, kinds, confidences, told, notes)
    full = levels[0].select("root").limit(0)
    for v in levels[1:]:
        full = full.union(v.filter("more").select("root"))
    out = None
    for v in levels:
        each = v.select("root", "depth", "held", F.posexplode("fresh").alias("n", "x"))
        row = each.select("root", *_read("x.id", notes is not None), "depth", (F.col("held") + F.col("n") + 1).alias("pos"), *(F.col(f"x.{c}").alias(c) for c in told))
        out = row if out is None else out.union(row)
    # one row a root on this side: where nobody asks for the column, Catalyst leaves the join out
    full = full.groupBy("root").agg(F.lit(True).alias("truncated"))
    return out.join(full, "root", "left").withColumn("truncated", F.coalesce("truncated", F.lit(False)))


def _read(c: str, noted: bool) -> list:
    """The id, and the note that stands in front of it."""
    if not noted:
        return [F.col(c).alias("id")]
    note = F.substring(c, 1, NOTE)
    return [F.substr(F.col(c), F.lit(NOTE + 1)).alias("id"), F.when(note != NO_NOTE, note.cast("int")).alias("note")]


def walk(
    edges: DataFrame | Clustered, seeds: DataFrame, direction: str, depth: int, max_nodes: int, kinds: list[str] | None = None,
    confidences: list[str] | None = None, told: tuple[str, ...] = (), notes: DataFrame | None = None, ends: bool = False, keep_last: bool = True,
) -> list[DataFrame]:
    """The levels (root, depth, held, fresh, more) of a walk, a row a root: ``fresh`` are its new nodes in the order of discovery,
    ``held`` how many it had before, ``more`` whether there was no room for some.

    What is dealt out are lists: a frontier meets each node's list of far ends, which come together at the root; the lists
    in the order of the frontier, without what was seen, are the level.  A list and a level are bounded by ``max_nodes``, and a
    root that may meet more than ``GATHERED`` far ends at a level goes row by row instead (:func:`_by_rows`).  With ``ends`` each
    level says who of it leads on (front) and to how many at most (work), the last one too, which isn't written without ``keep_last``.
    Without, a level whose nodes can't lead on is the last, and isn't written either: it has no front.
    """
    noted = notes is not None
    lists = kept(hops(edges, direction, max_nodes, kinds, confidences, told, notes), "near")
    s = seeds.select("root", "id").distinct()
    none = [F.lit(None).cast("string").alias(c) for c in told]
    if noted:
        s = s.join(notes.groupBy("id").agg(F.min("note").alias("note")), "id", "left")
    here = noted_id(F.col("id"), F.col("note")) if noted else F.col("id")
    first = F.transform(F.sort_array(F.collect_list(F.struct("id", here.alias("here")))), lambda x: x["here"])
    s = s.join(lists.select(F.col("near").alias("id"), F.size("fars").alias("n")), "id", "left")
    state = kept(
        s.groupBy("root").agg(first.alias("seen"), F.coalesce(F.sum("n"), F.lit(0)).alias("work")).withColumn("fresh", F.transform("seen", lambda x: F.struct(x.alias("id"), *none)))
        .withColumn("total", F.size("seen").cast("long")).select(
            "root", F.lit(0).alias("depth"), F.lit(0).cast("long").alias("held"), "fresh", F.lit(False).alias("more"), "seen",
            F.col("seen").alias("front"), "work", "total",
        ),
        "root",
    )
    levels = [state]
    for level in range(1, depth + 1):
        last = not ends and (level == depth or not _leads_on(state, lists, noted))
        light = _by_lists(state.filter(F.col("work") <= GATHERED), lists, max_nodes, told, noted, last)
        heavy = state.filter(F.col("work") > GATHERED)
        found = light if heavy.isEmpty() else light.unionByName(_by_rows(heavy, lists, max_nodes, told, noted).select(*light.columns))
        going = F.size("front") > 0
        state = found.select(
            "root", F.lit(level).alias("depth"), F.col("total").alias("held"), "fresh", "more",
            *([] if last else [
                F.when(going, F.concat("seen", F.transform("fresh", lambda x: x["id"]))).alias("seen"), "front", "work",
                (F.col("total") + F.size("fresh")).alias("total"),
            ]),
        ).filter((F.size("fresh") > 0) | F.col("more"))
        if last or level == depth and not keep_last:  # nothing follows, so nothing is read twice
            levels.append(state)
            break
        state = kept(state, "root")
        levels.append(state)
        state = state.filter(F.size("front") > 0)
        if state.isEmpty():
            break
    return levels


def whole(levels: list[DataFrame]) -> DataFrame:
    """(root, ids): all nodes of each root in a row, in the order of discovery, with their notes in front if they have any.

    Levels are a row a root, so they are joined as they lie.
    """
    ids = F.transform("fresh", lambda x: x["id"])
    out = levels[0].select("root", ids.alias("ids"))
    none = F.array().cast("array<string>")
    for v in levels[1:]:
        out = out.join(v.select("root", ids.alias("more_ids")), "root", "left").select("root", F.concat("ids", F.coalesce("more_ids", none)).alias("ids"))
    return out


def _leads_on(state: DataFrame, lists: DataFrame, noted: bool) -> bool:
    """Whether some node that the next level meets has edges of its own: if none has, that level is the last."""
    asks = state.select(F.explode("front").alias("near")).select(_read("near", noted)[0].alias("near")).distinct()
    return not met(asks, lists.filter("leads is not null").select("near")).isEmpty()


def _met(state: DataFrame, lists: DataFrame, noted: bool) -> DataFrame:
    front = state.select("root", F.posexplode("front").alias("at", "near"))
    return met(front.select("root", "at", _read("near", noted)[0].alias("near")), lists)


def _by_lists(state: DataFrame, lists: DataFrame, max_nodes: int, told: tuple[str, ...], noted: bool, last: bool) -> DataFrame:
    """The next level of roots whose lists are gathered: (root, total, fresh, more), and what follows needs (seen, front, work).

    Lists are dealt out to groups of roots, once each, and not to the roots.
    """
    mine = state.select("root", "front", "seen", "total").join(grouped(state.select("root", "work")), "root")
    asks = mine.select("g", F.explode("front").alias("near")).select("g", _read("near", noted)[0].alias("near")).distinct()
    held = ["fars", "leads", "work", *(["codes"] if _coded(told) else [])]
    theirs = met(asks, lists).select(F.col("g").alias("of"), "near", *held)
    level = next_level(max_nodes, told, NOTE if noted else 0, last)
    return mine.groupBy("g").cogroup(theirs.groupBy("of")).applyInArrow(level, level_schema(told, last))


def _by_rows(state: DataFrame, lists: DataFrame, max_nodes: int, told: tuple[str, ...], noted: bool) -> DataFrame:
    """The same of roots that meet too much for a row: the first of each far end by aggregation, then by rank, which is bounded."""
    root = Window.partitionBy("root")
    codes = [F.expr("get(codes, i)").alias("code")] if _coded(told) else []
    rows = _met(state, lists, noted).select("*", F.posexplode("fars").alias("i", "id")).select("root", "at", "i", "id", "near", *codes)
    found = rows.groupBy("root", "id").agg(F.min(F.struct("at", "i", "near", *(["code"] if codes else []))).alias("e")).join(
        state.select("root", F.explode("seen").alias("id")), ["root", "id"], "left_anti"
    )
    first = found.withColumn("n", F.row_number().over(root.orderBy("e.at", "e.i"))).filter(F.col("n") <= max_nodes + 1)
    of = {"parent": F.col("e.near"), "kind": F.col("e.code.kind") if codes else None, "confidence": F.col("e.code.confidence") if codes else None}
    listed = first.groupBy("root").agg(F.array_sort(F.collect_list(F.struct("n", F.struct("id", *(of[c].alias(c) for c in told)).alias("x")))).alias("l"))
    room = F.greatest(F.lit(0), F.lit(max_nodes) - F.col("total")).cast("int")
    out = listed.join(state.select("root", "seen", "total"), "root").withColumn("fresh", F.transform(F.slice("l", 1, room), lambda x: x["x"]))
    # each of them may lead on, and to as much again
    return out.select(
        "root", "total", "seen", "fresh", (F.size("l") > room).alias("more"), F.transform("fresh", lambda x: x["id"]).alias("front"), F.lit(GATHERED + 1).cast("long").alias("work"),
    )


def members(graph: Graph, roots: DataFrame) -> DataFrame:
    """(root, id): each root and the outermost declarations that it contains, by span in its file or by METHOD_OF.

    The span join is an interval join within one file.  There is no cap on the symbols of a file.
    """
    s = graph.symbols.select("stable_key", "file_key", "start_line", "end_line")
    mine = roots.select("root").distinct().join(s, F.col("root") == F.col("stable_key")).drop("stable_key")
    inner = s.toDF("id", "file_key", "lo", "hi")
    by_span = mine.filter("end_line > start_line").join(inner, "file_key").filter(
        (F.col("id") != F.col("root")) & (F.col("lo") >= F.col("start_line")) & (F.col("hi") <= F.col("end_line"))
    ).select("root", "id", "file_key", "lo", "hi")
    owned = graph.edges.filter((F.col("kind") == "METHOD_OF") & (F.col("source_key") != F.col("target_key")))
    by_edge = roots.select("root").distinct().join(owned, F.col("root") == F.col("target_key")).select("root", F.col("source_key").alias("id")).join(inner, "id").select("root", "id", "file_key", "lo", "hi")
    found = by_span.union(by_edge).dropDuplicates(["root", "id"])
    # an equal span contains nothing; spans of different files are compared by their lines, as candidates of one root
    outer = found.select("root", F.col("id").alias("o"), F.col("lo").alias("olo"), F.col("hi").alias("ohi"))
    nested = (
        (found["root"] == outer["root"]) & (outer["o"] != found["id"]) & (outer["olo"] <= found["lo"]) & (outer["ohi"] >= found["hi"])
        & ~((outer["olo"] == found["lo"]) & (outer["ohi"] == found["hi"]))
    )
    outermost = found.join(outer, nested, "left_anti").select("root", "id")
    return roots.select("root", F.col("root").alias("id")).union(outermost).distinct()


def noted_places(graph: Graph, keeps: Column, kinds: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(notes, places): a number for each file and kind of symbol that is reported, as symbols' notes (id, note), and what it
    stands for: places (note, symbol_kind, repository, package_key, package_name, path).

    Places are as few as files, so visits meet a small table; numbers are dealt out in a thousand parts, none by one task.
    """
    f = graph.files.select(F.col("stable_key").alias("file_key"), "path", "package_key", "repository_key")
    f = f.join(graph.packages.select(F.col("stable_key").alias("package_key"), F.col("name").alias("package_name")), "package_key")
    f = f.join(graph.repositories.select(F.col("stable_key").alias("repository_key"), F.col("name").alias("repository")), "repository_key").filter(keeps)
    of = graph.symbols.select("file_key", F.col("kind").alias("symbol_kind"))
    pairs = of.distinct().filter(F.lit(True) if kinds is None else kinds).join(f, "file_key").withColumn("part", F.pmod(F.xxhash64("file_key", "symbol_kind"), F.lit(1000)))
    before = pairs.groupBy("part").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n"))
    number = F.row_number().over(Window.partitionBy("part").orderBy("file_key", "symbol_kind", "package_name", "repository"))
    places = kept(pairs.withColumn("no", number).join(before, "part").select((F.col("before") + F.col("no")).alias("note"), "file_key", "symbol_kind", "repository", "package_key", "package_name", "path"))
    s = graph.symbols.select(F.col("stable_key").alias("id"), "file_key", F.col("kind").alias("_kind"))
    notes = s.join(places.select("note", "file_key", "symbol_kind"), "file_key").filter(F.col("_kind").eqNullSafe(F.col("symbol_kind"))).select("id", "note")
    return notes, places.drop("file_key")


def _reported(graph: Graph, visits: DataFrame, places: DataFrame) -> DataFrame:
    """Visits but the seeds, with their places and names; names are joined only where they are asked for."""
    names = graph.symbols.groupBy(F.col("stable_key").alias("id")).agg(F.min("name").alias("name"))
    return visits.filter("depth > 0").join(places, "note").drop("note").join(names, "id", "left")


def trace_dependencies(
    graph: Graph, roots: DataFrame, depth: int = 3, max_nodes: int = 5_000, kinds: list[str] | None = None,
    confidences: list[str] | None = None, repository: str | None = None, include_derived: bool = True, seed_members: bool = True,
    told: tuple[str, ...] = TOLD,
) -> DataFrame:
    """What roots depend on.  Kinds and confidences bound the walk; repository and derived filter its rows afterwards."""
    seeds = members(graph, roots) if seed_members else roots.select("root", F.col("root").alias("id"))
    keeps = keeps_derived(F.col("repository"), include_derived, repository)
    notes, places = noted_places(graph, keeps & (F.col("repository") == repository) if repository else keeps)
    return _reported(graph, traverse(graph.walked(), seeds, "outgoing", depth, max_nodes, kinds, confidences, told, notes), places)


def _impact_places(graph: Graph, include_derived: bool, symbol_kinds: list[str] | None) -> tuple[DataFrame, DataFrame]:
    kind = F.col("symbol_kind")
    shown = ~kind.isin(*QUIET_IMPACT_KINDS) if symbol_kinds is None else None if symbol_kinds == ["*"] else kind.isin(*symbol_kinds)
    return noted_places(graph, keeps_derived(F.col("repository"), include_derived), shown)


def blast_radius(
    graph: Graph, roots: DataFrame, depth: int = 3, max_nodes: int = 5_000, kinds: list[str] | None = None,
    confidences: list[str] | None = None, include_derived: bool = True, symbol_kinds: list[str] | None = None, told: tuple[str, ...] = TOLD,
) -> tuple[DataFrame, DataFrame]:
    """Whom a change of each root reaches, without the root, and all visits.

    Fields and variables aren't reported unless asked for (``["*"]``: all), but the walk passes through them.
    """
    notes, places = _impact_places(graph, include_derived, symbol_kinds)
    visits = traverse(graph.walked(), roots.select("root", F.col("root").alias("id")), "incoming", depth, max_nodes, kinds, confidences, told, notes)
    return _reported(graph, visits, places), visits.drop("note")


def impact_axes(rows: DataFrame) -> DataFrame:
    """(root, axis, key, n): the reach by repository, by package and by depth; rows that are alike in all are counted first."""
    depth = F.col("depth").cast("string")
    r = rows.groupBy("root", "repository", "package_key", "depth").agg(F.count("*").alias("n")).select("root", "repository", "package_key", depth.alias("depth"), "n")
    axes = r.select(
        "root",
        F.explode(
            F.array(
                F.struct(F.lit("repository").alias("axis"), F.col("repository").alias("key")),
                F.struct(F.lit("package").alias("axis"), F.col("package_key").alias("key")),
                F.struct(F.lit("depth").alias("axis"), F.col("depth").alias("key")),
            )
        ).alias("a"), "n",
    )
    return axes.groupBy("root", "a.axis", "a.key").agg(F.sum("n").alias("n"))


def impact_by_kind(
    graph: Graph, roots: DataFrame, depth: int = 3, max_nodes: int = 5_000, kinds: list[str] | None = None, confidences: list[str] | None = None,
    include_derived: bool = True, symbol_kinds: list[str] | None = None,
) -> DataFrame:
    """(root, kind, n): what :func:`blast_radius` reports, by each distinct kind of its edges into the visited set, root included.

    Visits stay a row a root: those that have incoming edges ask for who has them, by kind, and a root's answers are cut to
    what it reports.
    """
    notes, _ = _impact_places(graph, include_derived, symbol_kinds)
    seeds = roots.select("root", F.col("root").alias("id"))
    levels = walk(graph.walked(), seeds, "incoming", depth, max_nodes, kinds, confidences, (), notes, ends=True, keep_last=False)
    adj = walkable(graph.walked(), "incoming", kinds, confidences).select("near", "far", "kind").distinct()
    shown = adj.join(notes.select(F.col("id").alias("far")), "far", "left_semi")
    part = F.floor(F.row_number().over(Window.partitionBy("near", "kind").orderBy("far")) / 10_000)
    lists = kept(shown.withColumn("part", part).groupBy("near", "kind", "part").agg(F.collect_list("far").alias("ends")).drop("part"))
    # where all was visited that is met, ends are visits but for the root itself; elsewhere they are cut to the visits
    partial = _partly_met(levels, depth, F.size("front") > 0)
    asks = _asks(levels[:depth])
    whole_ = asks.join(partial, "root", "left_anti")
    heavy = F.col("work") > GATHERED + max_nodes + 1
    one = whole_.filter(~heavy)
    plain = F.transform("seen", lambda x: F.substr(x, F.lit(NOTE + 1)))
    mine = one.join(levels[0].select("root", plain.alias("but")), "root").join(grouped(one), "root").select("root", "asks", "but", "g")
    near = mine.select("g", F.explode("asks").alias("x")).select(F.col("g").alias("of"), _read("x", True)[0].alias("near")).distinct()
    theirs = near.join(lists, "near").select("of", "near", "kind", "ends")
    out = mine.groupBy("g").cogroup(theirs.groupBy("of")).applyInArrow(distinct_ends(NOTE), "root string, kind string, n bigint")
    # what is too much for a group, or has to be cut, is counted row by row
    rest = whole_.filter(heavy).select("root").union(partial)
    if rest.isEmpty():
        return out
    on = _asks(levels).join(rest, "root", "left_semi").select("root", F.explode("asks").alias("x")).select("root", _read("x", True)[0].alias("near"))
    rows = on.join(lists, "near").select("root", "kind", F.explode("ends").alias("id")).distinct()
    if len(levels) == 1:
        return out
    visits = whole(levels[1:]).join(rest, "root", "left_semi").select("root", F.explode(F.filter("ids", lambda x: ~F.startswith(x, F.lit(NO_NOTE)))).alias("x"))
    rows = rows.join(visits.select("root", _read("x", True)[0].alias("id")), ["root", "id"], "left_semi")
    return out.union(rows.groupBy("root", "kind").agg(F.count("*").alias("n")))


def _asks(levels: list[DataFrame]) -> DataFrame:
    """(root, asks, work): all nodes of these levels that lead on, in a row, and to how many at most."""
    out, none = levels[0].select("root", F.col("front").alias("asks"), "work"), F.array().cast("array<string>")
    for v in levels[1:]:
        out = out.join(v.select("root", F.col("front").alias("more"), F.col("work").alias("further")), "root", "left").select(
            "root", F.concat("asks", F.coalesce("more", none)).alias("asks"), (F.col("work") + F.coalesce("further", F.lit(0))).alias("work")
        )
    return out


def _partly_met(levels: list[DataFrame], depth: int, on: Column, elsewhere: Column | None = None) -> DataFrame:
    """Roots of which a walk didn't visit all that its nodes lead to: there was no room, or nodes at its end lead ``on``; or those
    for which ``elsewhere`` holds at a level before."""
    out = None
    for d, v in enumerate(levels):
        also = on if d == depth else elsewhere
        each = v.filter(F.col("more") if also is None else F.col("more") | also).select("root")
        out = each if out is None else out.union(each)
    return kept(out.distinct())


def shortest_paths(
    edges: DataFrame | Clustered, pairs: DataFrame, depth: int = 5, max_nodes: int = MAX_NODES, kinds: list[str] | None = None, targets: DataFrame | None = None,
) -> DataFrame:
    """(source, target, length, path): one shortest path for each pair that has one of at most ``depth`` edges.

    With ``targets`` (target), ``pairs`` holds sources only and each is asked for all targets: no pair is made that isn't
    reached.  The walk's parents are followed back from the target; of several paths it is the one found first, which is the
    least one, node by node.
    """
    seeds = pairs.select(F.col("source").alias("root"), F.col("source").alias("id")).distinct()
    # a note tells targets, so no node that isn't one gets a row, and none is dealt out to be asked
    noted = targets is not None
    notes = targets.filter("target is not null").select(F.col("target").alias("id"), F.lit(1).alias("note")).distinct() if noted else None
    levels = walk(edges, seeds, "outgoing", depth, max_nodes, kinds, told=("parent",), notes=notes, ends=True)
    plain = lambda x: F.substr(x["id"], F.lit(NOTE + 1)) if noted else x["id"]
    wanted = lambda c: F.filter(c, lambda x: ~F.startswith(x["id"], F.lit(NO_NOTE))) if noted else F.col(c)
    on_of = lambda x: F.struct(plain(x).alias("id"), x["path"].alias("path"))
    # the paths of a root's nodes that lead on stand in its row and meet the next level there: no visit is dealt out for its parents
    first = lambda x: F.struct(x["id"].alias("id"), F.array(plain(x)).alias("path"))
    one = lambda x: F.struct(x["id"].alias("id"), F.concat(F.element_at("of", x["parent"]), F.array(plain(x))).alias("path"))
    at, found = levels[0].select("root", F.transform("fresh", first).alias("new")), []
    found.append(at.select("root", F.explode(wanted("new")).alias("x")))
    at = at.select("root", F.transform("new", on_of).alias("on"))
    for k, v in enumerate(levels[1:], 1):
        both = v.select("root", "fresh", "front").join(at, "root").withColumn("of", F.map_from_entries("on"))
        if k == len(levels) - 1:  # its nodes lead nowhere, or no further is asked
            found.append(both.select("root", F.explode(F.transform(wanted("fresh"), one)).alias("x")))
            break
        each = both.select("root", "front", F.transform("fresh", one).alias("new"))
        found.append(each.select("root", F.explode(wanted("new")).alias("x")))
        lead = F.filter("new", lambda x: F.array_contains("front", x["id"]))
        at = kept(each.filter(F.size("front") > 0).select("root", F.transform(lead, on_of).alias("on")), "root")
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    out = out.select(F.col("root").alias("source"), plain(F.col("x")).alias("target"), (F.size("x.path") - 1).alias("length"), F.col("x.path").alias("path"))
    if noted:
        return out
    return out.join(pairs.select("source", "target").distinct(), ["source", "target"], "left_semi")


def neighborhood(edges: DataFrame | Clustered, roots: DataFrame, depth: int = 3, max_nodes: int = 1_000) -> DataFrame:
    """(root, id, pos): outgoing nodes, then incoming ones that are new, up to ``max_nodes`` for each root."""
    seeds = roots.select("root", F.col("root").alias("id"))
    # the last level is written too, in buckets of roots like the others: a row a root with all its nodes isn't dealt out
    level = lambda d: (v := walk(edges, seeds, d, depth, max_nodes))[:-1] + [kept(v[-1], "root") if len(v) > 1 else v[-1]]
    out = whole(level("outgoing"))
    back = whole(level("incoming")).withColumnRenamed("ids", "back")
    both = out.join(back, "root").select("root", F.slice(F.array_distinct(F.concat("ids", "back")), 1, max_nodes).alias("ids"))
    return both.select("root", F.posexplode("ids").alias("n", "id")).select("root", "id", (F.col("n") + 1).alias("pos"))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(root, edge): the edges with both ends among a root's nodes."""
    n = nodes.select("root", "id")
    half = edges.join(n.withColumnRenamed("id", "source_key"), "source_key")
    return half.join(n.withColumnRenamed("id", "target_key"), ["root", "target_key"], "left_semi")


def induced_walk(
    graph: Graph, seeds: DataFrame, direction: str = "outgoing", depth: int = 3, max_nodes: int = 1_000, kinds: list[str] | None = None
) -> DataFrame:
    """(root, source_key, target_key, kind): what :func:`induced` gives for the nodes of a walk, without a row for each node.

    Of a root that was walked whole, every edge of a walk's kinds leads to a node of it, so nodes that were asked for their lists on
    the way are asked again, by kind and how often, and nothing is cut.  Roots that had no room for all, or that end in nodes with
    edges, or whose nodes have edges of other kinds, which notes tell, have their lists cut to their nodes, a row a root.
    """
    e = graph.edges.filter("source_key is not null and target_key is not null")
    followed = F.col("kind").isin(*(kinds or REFERENCE_KINDS))
    notes = e.groupBy(F.col("source_key").alias("id")).agg(F.max(F.when(followed, 1).otherwise(2)).alias("note"))
    levels = walk(graph.walked(), seeds, direction, depth, max_nodes, kinds, notes=notes)
    noted = lambda x: ~F.startswith(x["id"], F.lit(NO_NOTE))
    other = lambda x: F.startswith(x["id"], F.lit("2".zfill(NOTE)))
    forward = direction == "outgoing"
    partial = _partly_met(levels, depth, F.exists("fresh", noted), F.exists("fresh", other)) if forward else levels[0].select("root")
    often = e.groupBy("source_key", "target_key", "kind").agg(F.count("*").alias("n"))
    # a list holds so many ends at most: a node with very many has several
    part = Window.partitionBy("source_key", "kind", "n").orderBy("target_key")
    lists = kept(
        often.withColumn("part", F.floor(F.row_number().over(part) / 10_000)).groupBy("source_key", "kind", "n", "part").agg(F.collect_list("target_key").alias("ends")).drop("part")
    )
    found, again = None, F.explode(F.array_repeat(F.lit(0), F.col("n").cast("int")))
    if forward and depth:
        ask = _fronts(levels[:depth]).join(partial, "root", "left_anti").select("root", _read("x", True)[0].alias("source_key"))
        found = ask.join(lists.filter(followed), "source_key").select("root", "source_key", "kind", "n", F.explode("ends").alias("target_key"))
    if not forward or not depth or not partial.isEmpty():
        nodes = kept(whole(levels).join(partial, "root", "left_semi"), "root")
        plain = F.transform("ids", lambda x: F.substr(x, F.lit(NOTE + 1)))
        ask = nodes.select("root", F.explode(F.filter("ids", lambda x: ~F.startswith(x, F.lit(NO_NOTE)))).alias("x")).select("root", _read("x", True)[0].alias("source_key"))
        # of as many ends as an asker's nodes at most
        met_ = ask.join(lists, "source_key").join(nodes.select("root", plain.alias("ids")), "root")
        cut_ = met_.select("root", "source_key", "kind", "n", F.explode(F.array_intersect("ends", "ids")).alias("target_key"))
        found = cut_ if found is None else found.unionByName(cut_)
    return found.withColumn("_", again).select("root", "source_key", "target_key", "kind")


def _fronts(levels: list[DataFrame]) -> DataFrame:
    """(root, x): the nodes of these levels that lead on."""
    out = None
    for v in levels:
        if "front" not in v.columns:  # the last
            continue
        each = v.select("root", F.explode("front").alias("x"))
        out = each if out is None else out.union(each)
    return out
