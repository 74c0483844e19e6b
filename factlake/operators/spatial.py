"""Layout and viewport queries: packing boxes on a grid, a cell index, and what a rectangle shows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factlake.operators.traverse import cut as stored

CELL, MAX_CELLS, MAX_VISIBLE = 256, 128, 10_000


def pack(boxes: DataFrame, gap: float = 8.0) -> DataFrame:
    """(parent, id, x, y, w, h) from boxes (parent, id, w, h): each parent's boxes in rows, near a square in all.

    Columns are round(sqrt(n * mean height / mean width)); a column is as wide, and a row as high, as its largest box.
    """
    of = Window.partitionBy("parent")
    b = boxes.withColumn("no", F.row_number().over(of.orderBy("id")) - 1).withColumn("n", F.count("*").over(of))
    cols = F.greatest(F.lit(1), F.round(F.sqrt(F.col("n") * F.avg("h").over(of) / F.avg("w").over(of))))
    b = b.withColumn("cols", cols.cast("int")).withColumn("row", F.floor(F.col("no") / F.col("cols"))).withColumn("col", F.col("no") % F.col("cols"))
    widths = b.groupBy("parent", "col").agg(F.max("w").alias("cw"))
    heights = b.groupBy("parent", "row").agg(F.max("h").alias("rh"))
    before = lambda c, size: F.coalesce(F.sum(F.col(size) + gap).over(Window.partitionBy("parent").orderBy(c).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    x = widths.withColumn("x", before("col", "cw")).drop("cw")
    y = heights.withColumn("y", before("row", "rh")).drop("rh")
    return b.join(x, ["parent", "col"]).join(y, ["parent", "row"]).select("parent", "id", "x", "y", "w", "h")


def layout(nodes: DataFrame, gap: float = 8.0, padding: float = 8.0, levels: int = 16) -> DataFrame:
    """(id, parent, level, x, y, w, h) of boxes in boxes: nodes (id, parent, w, h), roots with a null parent.

    Sizes go up: a box holds its packed children and padding, and is as large as its own w and h at least.  Positions go down,
    absolute; the roots are packed side by side.  One pass over the nodes for each level up and down; what hangs deeper than
    ``levels``, or in a cycle, is left out.
    """
    at_level = [stored(nodes.filter("parent is null").select("id", "parent", "w", "h"))]
    while len(at_level) < levels:
        above = at_level[-1].select(F.col("id").alias("parent"))
        below = stored(nodes.join(above, "parent", "left_semi").select("id", "parent", "w", "h"))
        if below.isEmpty():
            break
        at_level.append(below)
    packed = []
    inside = None  # what the level below needs of its parents
    for level in reversed(at_level):
        if inside is not None:
            level = level.join(inside, level["id"] == inside["of"], "left").select(
                "id", "parent", F.greatest("w", F.coalesce("iw", F.lit(0.0))).alias("w"), F.greatest("h", F.coalesce("ih", F.lit(0.0))).alias("h")
            )
        at = stored(pack(level.select(F.coalesce("parent", F.lit("")).alias("parent"), "id", "w", "h"), gap))
        inside = at.groupBy(F.col("parent").alias("of")).agg((F.max(F.col("x") + F.col("w")) + 2 * padding).alias("iw"), (F.max(F.col("y") + F.col("h")) + 2 * padding).alias("ih"))
        packed.append(at)
    out, above = None, None
    for n, at in enumerate(reversed(packed)):
        here = at if above is None else at.join(above, "parent").select(
            "id", "parent", (F.col("x") + F.col("px") + padding).alias("x"), (F.col("y") + F.col("py") + padding).alias("y"), "w", "h"
        )
        here = stored(here.select("id", F.nullif("parent", F.lit("")).alias("parent"), F.lit(n).alias("level"), "x", "y", "w", "h"))
        above = here.select(F.col("id").alias("parent"), F.col("x").alias("px"), F.col("y").alias("py"))
        out = here if out is None else out.union(here)
    return out


def cells(boxes: DataFrame) -> DataFrame:
    """(cx, cy, id, ...): boxes (id, level, x, y, w, h) by the cells that they touch; very large ones in the cell null."""
    low = lambda a: F.floor(F.col(a) / CELL)
    high = lambda a, s: F.floor((F.col(a) + F.col(s)) / CELL)
    b = boxes.select("*", low("x").alias("x0"), high("x", "w").alias("x1"), low("y").alias("y0"), high("y", "h").alias("y1"))
    many = (F.col("x1") - F.col("x0") + 1) * (F.col("y1") - F.col("y0") + 1) > MAX_CELLS
    few = b.filter(~many).withColumn("cx", F.explode(F.sequence("x0", "x1"))).withColumn("cy", F.explode(F.sequence("y0", "y1")))
    none = F.lit(None).cast("long")
    return few.union(b.filter(many).withColumn("cx", none).withColumn("cy", none)).drop("x0", "x1", "y0", "y1")


def viewport(index: DataFrame, x0: float, y0: float, x1: float, y1: float, level: int, limit: int = MAX_VISIBLE) -> DataFrame:
    """Boxes on the level or above that meet the rectangle, in the order of their ids; ``limit`` is the page's size, and
    ``truncated`` whether there are more."""
    inside = F.col("cx").isNull() | (F.col("cx").between(int(x0 // CELL), int(x1 // CELL)) & F.col("cy").between(int(y0 // CELL), int(y1 // CELL)))
    meets = (F.col("x") <= x1) & (F.col("x") + F.col("w") >= x0) & (F.col("y") <= y1) & (F.col("y") + F.col("h") >= y0)
    found = index.filter(inside & meets & (F.col("level") <= level)).select("id", "level", "x", "y", "w", "h").dropDuplicates(["id"])
    page = found.orderBy("id").limit(limit + 1)  # one more tells whether the page is full
    return page.withColumn("truncated", F.count("*").over(Window.partitionBy()) > limit).orderBy("id").limit(limit)


def visible_edges(edges: DataFrame, visible: DataFrame) -> DataFrame:
    """Edges (source_key, target_key) with both ends visible."""
    v = visible.select("id")
    return edges.join(v.withColumnRenamed("id", "source_key"), "source_key", "left_semi").join(v.withColumnRenamed("id", "target_key"), "target_key", "left_semi")
