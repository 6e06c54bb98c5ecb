"""Skew-safe meetings of points and boxes: grid cells that hold too many points are split into four, again and again.

The directory of split cells is built from counts. As only a cell with more than one in SHARE of all points is split, it has at
most SHARE rows a level and is broadcast; each point stands in one leaf, each box in the leaves that it touches. Points that
coincide cannot be split apart: a crowded cell of the last level is dealt to salts, and boxes stand in each.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwatch.functions.storage import stored

DEPTH = 8
SHARE = 4096
LEAST = 5_000  # points that a cell may hold in any case


def place(v: Column, size: float, level: int) -> Column:
    return F.floor(v * (2**level) / F.lit(float(size)))


def directory(points: DataFrame, size: float, share: int = SHARE, least: int = LEAST, depth: int = DEPTH) -> tuple[DataFrame, dict[int, int], int]:
    """The split cells (level, cx, cy, parts) of points (_x, _y), how many there are a level, and the number of points."""
    finest = points.groupBy(place(F.col("_x"), size, depth).alias("cx"), place(F.col("_y"), size, depth).alias("cy")).agg(F.count("*").alias("n"))
    up = finest.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(depth))))
    above = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), depth - F.col("level")))
    counts = up.groupBy("level", above("cx").alias("cx"), above("cy").alias("cy")).agg(F.sum("n").alias("n"))
    seen = counts.groupBy("level").agg(F.sum("n").alias("n"), F.count_if(F.col("n") > least).alias("many")).collect()
    total = max((r.n for r in seen), default=0)
    bound = max(least, total // share)
    split = counts.where(F.col("n") > bound).select("level", "cx", "cy", F.ceil(F.col("n") / bound).alias("parts"))
    if not any(r.many for r in seen):
        return split, {}, total
    split = stored(split, "cells")
    return split, {r.level: r["count"] for r in split.groupBy("level").count().collect()}, total


def quarter(i: int, j: int) -> Column:
    return F.struct((F.col("_level") + 1).alias("l"), (F.col("_cx") * 2 + i).alias("x"), (F.col("_cy") * 2 + j).alias("y"))


def touched(size: float, level: int):
    """Whether a cell of that level meets the row's box."""
    between = lambda c, lo, hi: (c >= place(F.col(lo), size, level)) & (c <= place(F.col(hi), size, level))
    return lambda q: between(q["x"], "_x0", "_x1") & between(q["y"], "_y0", "_y1")


def meet(
    points: DataFrame, boxes: DataFrame, size: float, share: int = SHARE, least: int = LEAST, depth: int = DEPTH,
) -> DataFrame:
    """points (_x, _y, ...) with the boxes (_x0, _x1, _y0, _y1, ...) that hold them, ends included, in cells of `size` or less."""
    split, levels, total = directory(points, size, share, least, depth)
    at = lambda k: F.broadcast(split.where(F.col("level") == k).select(F.col("cx").alias("_sx"), F.col("cy").alias("_sy"), "parts"))
    p = points.withColumns({"_level": F.lit(0), "_salt": F.lit(0).cast("long")})
    span = lambda lo, hi: F.explode(F.sequence(place(F.col(lo), size, 0), place(F.col(hi), size, 0)))
    b = boxes.withColumn("_cx", span("_x0", "_x1")).withColumn("_cy", span("_y0", "_y1")).withColumns({
        "_level": F.lit(0), "_salt": F.lit(0).cast("long"),
    })
    for k in sorted(levels):
        p = p.join(at(k), (place(F.col("_x"), size, k) == F.col("_sx")) & (place(F.col("_y"), size, k) == F.col("_sy")), "left")
        b = b.join(at(k), (F.col("_level") == k) & (F.col("_cx") == F.col("_sx")) & (F.col("_cy") == F.col("_sy")), "left")
        crowded = F.col("parts").isNotNull()
        if k < depth:
            p = p.withColumn("_level", F.when(crowded, k + 1).otherwise(F.col("_level")))
            quarters = F.filter(F.array(*[quarter(i, j) for i in (0, 1) for j in (0, 1)]), touched(size, k + 1))
            same = F.array(F.struct(F.col("_level").alias("l"), F.col("_cx").alias("x"), F.col("_cy").alias("y")))
            b = b.withColumn("_q", F.explode(F.when(crowded, quarters).otherwise(same)))
            b = b.withColumns({"_level": F.col("_q.l"), "_cx": F.col("_q.x"), "_cy": F.col("_q.y")}).drop("_q")
        else:
            p = p.withColumn("_salt", F.when(crowded, F.pmod(F.monotonically_increasing_id(), F.col("parts"))).otherwise(F.col("_salt")))
            b = b.withColumn("_salt", F.explode(F.when(crowded, F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).otherwise(F.array("_salt"))))
        p, b = p.drop("_sx", "_sy", "parts"), b.drop("_sx", "_sy", "parts")
    scale = F.pow(F.lit(2.0), F.col("_level"))
    own = lambda c: F.floor(F.col(c) * scale / F.lit(float(size)))
    key = lambda x, y: F.struct("_level", x.alias("x"), y.alias("y"), "_salt")
    p = p.withColumn("_cell", key(own("_x"), own("_y"))).drop("_level", "_salt")
    b = b.withColumn("_cell", key(F.col("_cx"), F.col("_cy"))).drop("_level", "_salt", "_cx", "_cy")
    tasks = max(points.sparkSession.sparkContext.defaultParallelism, total // 100_000) if total > 1000 else 1
    met = p.repartition(tasks, "_cell").join(b.hint("merge"), "_cell")  # a broadcast of either side would undo the deal by cells
    holds = (F.col("_x") >= F.col("_x0")) & (F.col("_x") <= F.col("_x1")) & (F.col("_y") >= F.col("_y0")) & (F.col("_y") <= F.col("_y1"))
    return met.where(holds).drop("_cell", "_x0", "_x1", "_y0", "_y1")


def sides(polygon: Column) -> Column:
    """A polygon's sides (x0, y0, x1, y1, and whether its ring has three points), to explode."""
    at = lambda r, i: F.get(r, i % F.size(r))
    side = lambda r, i: F.struct(
        at(r, i)["x"].alias("x0"), at(r, i)["y"].alias("y0"), at(r, i + 1)["x"].alias("x1"), at(r, i + 1)["y"].alias("y1"), (F.size(r) >= 3).alias("ring"),
    )
    filled = F.filter(polygon, lambda r: F.size(r) > 0)
    return F.flatten(F.transform(filled, lambda r: F.transform(F.sequence(F.lit(0), F.size(r) - 1), lambda i: side(r, i))))


def crosses(s: Column, x: Column, y: Column) -> Column:
    """Whether a side is met by the ray from a point to the right: a point is inside if an odd number of sides is."""
    left = x < (s["x1"] - s["x0"]) * F.try_divide(y - s["y0"], s["y1"] - s["y0"]) + s["x0"]
    return s["ring"] & ((s["y0"] > y) != (s["y1"] > y)) & F.coalesce(left, F.lit(False))


def squared(s: Column, x: Column, y: Column) -> Column:
    """A point's squared distance to a side."""
    dx, dy = s["x1"] - s["x0"], s["y1"] - s["y0"]
    along = F.try_divide((x - s["x0"]) * dx + (y - s["y0"]) * dy, dx * dx + dy * dy)
    t = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), along)), F.lit(0.0))
    ex, ey = x - (s["x0"] + t * dx), y - (s["y0"] + t * dy)
    return ex * ex + ey * ey
