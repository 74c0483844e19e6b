"""Roots that are worked on in groups: each task has a group's lists once, however many of its roots ask for them.

A list of far ends is asked for by many roots.  Dealt out to each root that asks, lists make up nearly all that a walk shuffles; dealt
out to groups of roots that lie next to each other in the order of their keys, a list goes to a group once, and is met by its roots
there.  Groups are bounded by what their roots may meet, and are worked on in parts of a million far ends.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: So many far ends may the roots of a group meet, or one root if it alone meets more; so many are met at once.
GROUP, PART = 16_000_000, 1_000_000


def grouped(roots: DataFrame) -> DataFrame:
    """(root, g) for roots (root, work): neighbours in the order of keys share a group, as far as ``GROUP`` goes.

    Small tables have more groups than that asks for, so that all cores have some.
    """
    work, parts = roots.agg(F.sum(F.col("work") + 1)).first()[0] or 1, int(roots.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(math.ceil(2 * work / GROUP), min(parts, math.ceil(work / 50_000)))
    if n == 1:
        return roots.select("root", F.lit(0).cast("long").alias("g"))
    ranges = min(n, 4 * parts)
    most = min(GROUP, 2 * math.ceil(work / n))  # few ranges have to be divided
    placed = roots.select("root", "work").repartitionByRange(ranges, "root").withColumn("p", F.spark_partition_id())
    before = F.sum(F.col("work") + 1).over(Window.partitionBy("p").orderBy("root").rowsBetween(Window.unboundedPreceding, -1))
    return placed.select("root", (F.col("p") * F.lit(1 << 32) + F.floor(F.coalesce(before, F.lit(0)) / most)).cast("long").alias("g"))


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """The offsets of a column of lists, and their values."""
    a = column.combine_chunks()
    a = a if isinstance(a, pa.Array) else pa.concat_arrays(a.chunks) if a.num_chunks else pa.array([], column.type)
    n = pc.fill_null(pc.list_value_length(a), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.concatenate([[0], np.cumsum(n)]), pc.list_flatten(a)


def _each(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of all values of lists that begin at ``starts``, one list after the other."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def _parts(work: np.ndarray, most: int):
    """(from, to) of roots that meet about ``most`` far ends together, one root at least."""
    at, total = 0, np.cumsum(work)
    while at < len(work):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, side="right")))
        yield at, to
        at = to


class _Group:
    """The asks of a group's roots, root by root in their order, and the list that each of them meets."""

    def __init__(self, asks: pa.ChunkedArray, near: pa.Array, skip: int):
        at, asked = _flat(asks)
        if skip:
            asked = pc.utf8_slice_codeunits(asked, skip)
        found = pc.index_in(asked, value_set=near)
        there = found.is_valid().to_numpy(zero_copy_only=False)
        self.list = found.drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
        self.root = np.repeat(np.arange(len(at) - 1), np.diff(at))[there]

    def slices(self, lengths: np.ndarray, roots: int):
        """(roots from, to, asks from, to) of each part."""
        work = np.bincount(self.root, weights=lengths[self.list], minlength=roots)
        for lo, hi in _parts(work, PART):
            yield lo, hi, *np.searchsorted(self.root, [lo, hi])


def next_level(max_nodes: int, told: tuple[str, ...], skip: int, last: bool):
    """The function of a group's roots (g, root, front, seen, total) and lists (g, near, fars, leads, work, codes): the next level."""

    def level(roots: pa.Table, lists: pa.Table) -> pa.Table:
        none = pa.string()
        code = [c for c in told if c != "parent"]
        item = pa.struct([("id", none), *((c, none) for c in told)])
        schema = pa.schema([("root", none), ("total", pa.int64()), ("fresh", pa.list_(item)), ("more", pa.bool_())] + ([] if last else [("seen", pa.list_(none)), ("front", pa.list_(none)), ("work", pa.int64())]))
        if not lists.num_rows or not roots.num_rows:
            return schema.empty_table()
        near = lists["near"].combine_chunks()
        group = _Group(roots["front"], near, skip)
        at, fars = _flat(lists["fars"])
        seen_at, seen = _flat(roots["seen"])
        names = pa.chunked_array([fars.cast(none), seen.cast(none)]).combine_chunks().dictionary_encode()
        ids, names = names.indices.to_numpy(zero_copy_only=False).astype(np.int64), names.dictionary
        of_fars, of_seen, lengths = ids[: len(fars)], ids[len(fars):], np.diff(at)
        leads = np.zeros(len(names), bool)
        leads[pc.index_in(pc.unique(_flat(lists["leads"])[1].cast(none)), value_set=names).to_numpy(zero_copy_only=False).astype(np.int64)] = True
        total, works = roots["total"].to_numpy(), lists["work"].to_numpy()
        codes = _flat(lists["codes"])[1] if code else None
        key, out, seen_in = len(names), [], roots["seen"].combine_chunks()
        root_names = roots["root"].combine_chunks()
        for lo, hi, a, b in group.slices(lengths, len(total)):
            if a == b:
                continue
            of, by = group.list[a:b], group.root[a:b] - lo
            n = lengths[of]
            places = _each(at[:-1][of], n)
            met = np.repeat(by, n) * key + of_fars[places]
            held = np.repeat(np.arange(hi - lo), np.diff(seen_at[lo : hi + 1])) * key + of_seen[seen_at[lo] : seen_at[hi]]
            new, first = np.unique(met, return_index=True)
            new_at = np.sort(first[~np.isin(new, held)])
            new = met[new_at]
            root, found = new // key, new % key
            count = np.bincount(root, minlength=hi - lo)
            room = np.maximum(max_nodes - total[lo:hi], 0)
            fits = np.arange(len(new)) - np.repeat(np.cumsum(count) - count, count) < room[root]
            new_at, root, found = new_at[fits], root[fits], found[fits]
            lists_of = lambda values, where: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(where, minlength=hi - lo))]), pa.int32()), values)  # noqa: B023, E731
            x = [names.take(pa.array(found))]
            for c in told:
                if c == "parent":
                    x.append(near.take(pa.array(np.repeat(of, n)[new_at])).cast(none))
                else:
                    x.append(pc.struct_field(codes.take(pa.array(places[new_at])), c).cast(none))
            meets = np.bincount(by, minlength=hi - lo) > 0
            row = [root_names.slice(lo, hi - lo).cast(none), pa.array(total[lo:hi]), lists_of(pa.StructArray.from_arrays(x, fields=list(item)), root), pa.array(count > room)]
            if not last:
                on = leads[found]
                ahead = np.bincount(by, weights=works[of], minlength=hi - lo).astype(np.int64)
                row += [seen_in.slice(lo, hi - lo).cast(pa.list_(none)), lists_of(names.take(pa.array(found[on])), root[on]), pa.array(ahead)]
            out.append(pa.RecordBatch.from_arrays(row, schema=schema).filter(pa.array(meets)))
        return pa.Table.from_batches(out, schema)

    return level


def level_schema(told: tuple[str, ...], last: bool) -> str:
    item = ", ".join(f"{c}: string" for c in ("id", *told))
    return f"root string, total bigint, fresh array<struct<{item}>>, more boolean" + ("" if last else ", seen array<string>, front array<string>, work bigint")


def distinct_ends(skip: int):
    """The function of a group's roots (g, root, asks, but) and lists (g, near, kind, ends): (root, kind, n), how many distinct ends but
    those in ``but`` a root's lists of each kind have."""

    def ends_of(roots: pa.Table, lists: pa.Table) -> pa.Table:
        none = pa.string()
        schema = pa.schema([("root", none), ("kind", none), ("n", pa.int64())])
        if not lists.num_rows or not roots.num_rows:
            return schema.empty_table()
        at, ends = _flat(lists["ends"])
        but_at, but = _flat(roots["but"])
        names = pa.chunked_array([ends.cast(none), but.cast(none)]).combine_chunks().dictionary_encode()
        ids, key = names.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(names.dictionary)
        of_ends, of_but = ids[: len(ends)], ids[len(ends):]
        root_of_but = np.repeat(np.arange(roots.num_rows), np.diff(but_at))
        out, all_kinds, lengths = [], lists["kind"].to_pylist(), np.diff(at)
        kind_of, root_names = np.array(all_kinds), roots["root"].combine_chunks()
        for kind in sorted(set(all_kinds)):
            # several lists of one node and kind are lists of their own
            mine = np.flatnonzero(kind_of == kind)
            near = lists["near"].take(pa.array(mine)).combine_chunks()
            again, order = np.zeros(len(mine), np.int64), near.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            by_near = np.argsort(order, kind="stable")
            starts = np.flatnonzero(np.concatenate([[True], order[by_near][1:] != order[by_near][:-1]]))
            again[by_near] = np.arange(len(mine)) - np.repeat(starts, np.diff(np.append(starts, len(mine))))
            found = [np.zeros(0, np.int64)] * 2
            layers = []
            for k in range(int(again.max()) + 1):
                some = mine[again == k]
                g = _Group(roots["asks"], lists["near"].take(pa.array(some)).combine_chunks(), skip)
                layers.append((g.root, some[g.list]))
            found = [np.concatenate([x[i] for x in layers]) for i in (0, 1)]
            by = np.argsort(found[0], kind="stable")
            root, of = found[0][by], found[1][by]
            work = np.bincount(root, weights=lengths[of], minlength=roots.num_rows)
            for lo, hi in _parts(work, PART):
                a, b = np.searchsorted(root, [lo, hi])
                n = lengths[of[a:b]]
                met = np.unique(np.repeat(root[a:b], n) * key + of_ends[_each(at[:-1][of[a:b]], n)])
                met = met[~np.isin(met, root_of_but * key + of_but)]
                who, count = np.unique(met // key, return_counts=True)
                out.append(pa.RecordBatch.from_arrays([root_names.take(pa.array(who)).cast(none), pa.array([kind] * len(who), none), pa.array(count, pa.int64())], schema=schema))
        return pa.Table.from_batches(out, schema)

    return ends_of
