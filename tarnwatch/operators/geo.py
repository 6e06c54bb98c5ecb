"""Spatial predicates and bucketed spatial joins.

A polygon is array<array<struct<x,y>>> (rings, the first the shell). Joins go through grid cells, so candidates come from
an equi-join; exact predicates then decide.
"""

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnwatch.functions.ranges import numbered
from tarnwatch.functions.scalars import col, haversine_km, mercator_x, mercator_y, zfill
from tarnwatch.functions.storage import stored

RINGS = "array<array<struct<x:double,y:double>>>"


def ring_area(ring: Column) -> Column:
    """Signed area by the shoelace formula."""
    n = F.size(ring)
    at = F.sequence(F.lit(0), n - 1)
    cross = lambda i: F.get(ring, i)["x"] * F.get(ring, (i + 1) % n)["y"] - F.get(ring, (i + 1) % n)["x"] * F.get(ring, i)["y"]
    return F.when(n >= 3, F.aggregate(at, F.lit(0.0), lambda s, i: s + cross(i)) / 2).otherwise(0.0)


def area(polygon) -> Column:
    """Shell minus holes."""
    p = col(polygon)
    return F.abs(ring_area(F.get(p, F.lit(0)))) - F.aggregate(
        F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), F.lit(0.0), lambda s, r: s + F.abs(ring_area(r)),
    )


def centroid(polygon) -> tuple[Column, Column]:
    """Centroid of the shell; the mean of its points where it has no area."""
    ring = F.get(col(polygon), F.lit(0))
    n = F.size(ring)
    at = F.sequence(F.lit(0), n - 1)

    def part(axis):
        def term(i):
            a, b = F.get(ring, i), F.get(ring, (i + 1) % n)
            return (a[axis] + b[axis]) * (a["x"] * b["y"] - b["x"] * a["y"])

        mean = F.aggregate(ring, F.lit(0.0), lambda s, p: s + p[axis]) / n
        return F.when(
            F.abs(ring_area(ring)) > 1e-15, F.aggregate(at, F.lit(0.0), lambda s, i: s + term(i)) / (6 * ring_area(ring)),
        ).otherwise(mean)

    return part("x"), part("y")


def contains(polygon: str, x: str, y: str) -> Column:
    """Whether a point is in a polygon, by crossings of all rings (so holes count as outside)."""
    a, b = "get(r, i)", "get(r, (i + 1) % size(r))"
    above = f"({a}.y > {y}) <> ({b}.y > {y})"
    left = f"{x} < ({b}.x - {a}.x) * ({y} - {a}.y) / nullif({b}.y - {a}.y, 0) + {a}.x"
    crossings = f"if(size(r) >= 3, aggregate(sequence(0, size(r) - 1), 0, (n, i) -> n + int({above} and coalesce({left}, false))), 0)"
    return F.expr(f"coalesce(aggregate({polygon}, 0, (m, r) -> m + {crossings}) % 2 = 1, false)")


def distance(polygon: str, x: str, y: str) -> Column:
    """0 inside, else the distance to the nearest side."""
    a, b = "get(r, i)", "get(r, (i + 1) % size(r))"
    dx, dy = f"({b}.x - {a}.x)", f"({b}.y - {a}.y)"
    t = f"coalesce(greatest(0D, least(1D, (({x} - {a}.x) * {dx} + ({y} - {a}.y) * {dy}) / nullif({dx} * {dx} + {dy} * {dy}, 0))), 0D)"
    side = f"sqrt(pow({x} - ({a}.x + {t} * {dx}), 2) + pow({y} - ({a}.y + {t} * {dy}), 2))"
    nearest = F.expr(f"array_min(flatten(transform({polygon}, r -> transform(sequence(0, size(r) - 1), i -> {side}))))")
    return F.when(contains(polygon, x, y), 0.0).otherwise(nearest)


def bounds(polygon) -> dict[str, Column]:
    ring = F.get(col(polygon), F.lit(0))
    x, y = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return {"min_x": F.array_min(x), "max_x": F.array_max(x), "min_y": F.array_min(y), "max_y": F.array_max(y)}


def valid(polygon) -> Column:
    """A usable polygon: a shell of at least three different points, with area."""
    ring = F.get(col(polygon), F.lit(0))
    return F.coalesce((F.size(F.array_distinct(ring)) >= 3) & (F.abs(ring_area(ring)) > 0), F.lit(False))


def boundary_status(ratio="overlap_ratio") -> Column:
    return F.when(col(ratio) >= 0.5, "inside").when(col(ratio) > 0, "boundary").otherwise("outside")


def cells(x, y, size: float, reach: int = 0) -> Column:
    """Grid cells of a point, with its neighbours within `reach`, to explode."""
    cx, cy = F.floor(col(x) / size), F.floor(col(y) / size)
    offsets = range(-reach, reach + 1)
    return F.array(*[F.struct((cx + i).alias("cx"), (cy + j).alias("cy")) for i in offsets for j in offsets])


def near_places(a: DataFrame, b: DataFrame, metres: float, metric: str = "mercator") -> DataFrame:
    """(a_lat, a_lon, b_lat, b_lon, distance_m): the different places of a and of b at most `metres` apart, each pair once.

    Each place of b stands in its own cell, each of a looks in nine. However many points share a place, it is met once.
    """
    xy = lambda p: {"_x": mercator_x(f"{p}_lon"), "_y": mercator_y(f"{p}_lat")}
    # a true distance spans at most metres / cos(lat); both ends' stretch is bounded by the point's own cell size
    size = metres if metric == "mercator" else metres * 12
    left = a.select("a_lat", "a_lon").distinct().withColumns(xy("a")).withColumn("_cell", F.explode(cells("_x", "_y", size, 1)))
    right = b.select("b_lat", "b_lon").distinct().withColumns(xy("b")).withColumnsRenamed({"_x": "_bx", "_y": "_by"}).withColumn(
        "_cell", F.get(cells("_bx", "_by", size), F.lit(0)),
    )
    met = left.join(right, "_cell")
    flat = F.sqrt(F.pow(F.col("_x") - F.col("_bx"), 2) + F.pow(F.col("_y") - F.col("_by"), 2))
    d = flat if metric == "mercator" else 1000 * haversine_km("a_lat", "a_lon", "b_lat", "b_lon")
    return met.withColumn("distance_m", d).where(F.col("distance_m") <= metres).drop("_cell", "_x", "_y", "_bx", "_by")


PACK = 1024  # rows of one key that packed() puts into an array


def packed(rows: DataFrame, by: list[str]) -> DataFrame:
    """`by` and _pack, arrays of at most PACK of a key's rows with all other columns."""
    rest = [c for c in rows.columns if c not in by]
    at = F.floor((F.row_number().over(W.partitionBy(*by).orderBy(F.lit(0))) - 1) / PACK)
    return rows.withColumn("_at", at).groupBy(*by, "_at").agg(F.collect_list(F.struct(*rest)).alias("_pack")).drop("_at")


def dealt(rows: DataFrame, found: DataFrame, on: list[str]) -> DataFrame:
    """rows with what was found at their places (packs are unpacked), dealt by place to many tasks: the result is larger than both
    sides, so neither their sizes nor a broadcast may set the number of tasks.

    They are dealt by a hash and then compared by ends: equal doubles as a join's keys would be shuffled once more, to as few
    tasks as their bytes fill.
    """
    spark = rows.sparkSession
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    known = reduce(and_, [F.col(c).isNotNull() for c in on])
    deal = lambda df: df.where(known).withColumn("_deal", F.xxhash64(*on)).repartition(tasks, "_deal")
    other = deal(found).withColumnsRenamed({c: f"_found_{c}" for c in on})
    same = reduce(and_, [F.col(c).between(F.col(f"_found_{c}"), F.col(f"_found_{c}")) for c in on])
    met = deal(rows).join(other.hint("merge"), "_deal").where(same).drop("_deal", *[f"_found_{c}" for c in on])
    return met.select(*[c for c in met.columns if c != "_pack"], F.inline("_pack")) if "_pack" in met.columns else met


def within_distance(
    a: DataFrame, b: DataFrame, metres: float, metric: str = "mercator", given: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """(a columns, b columns, distance_m) of points (lat, lon) at most `metres` apart, inclusive.

    a holds a_id, a_lat, a_lon; b holds b_id, b_lat, b_lon. Places meet, then their points are listed: only the result grows with
    the number of pairs. `given` (such as rounding) makes distance_m of a distance, once for two places. Mercator distances are
    inflated by 1 / cos(lat); metric 'haversine' gives true ones. Its cells are Mercator too, of a size that covers the distance
    up to 85 degrees.
    """
    met = near_places(a, b, metres, metric)
    met = met.withColumn("distance_m", given(F.col("distance_m"))) if given else met
    met = met.join(packed(b, ["b_lat", "b_lon"]), ["b_lat", "b_lon"])
    return dealt(a, met, ["a_lat", "a_lon"]).select(*a.columns, *b.columns, "distance_m")


def near_duplicates(points: DataFrame, metres: float = 50.0, order: str = "idx", metric: str = "mercator") -> DataFrame:
    """points (id, idx, lat, lon) plus duplicate_of: the earliest row at most `metres` away, for later rows.

    The earliest row of a place stands for it: what is the earliest row near a place is so for each of its rows that is later.
    """
    side = lambda p: points.select(F.col("lat").alias(f"{p}_lat"), F.col("lon").alias(f"{p}_lon"))
    earliest = points.where(F.col(order).isNotNull()).groupBy(F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon")).agg(
        F.min(F.struct(F.col(order).alias("at"), F.col("id").alias("of"))).alias("_m"),
    )
    met = near_places(side("a"), side("b"), metres, metric).join(earliest, ["b_lat", "b_lon"])
    first = met.groupBy(F.col("a_lat").alias("lat"), F.col("a_lon").alias("lon")).agg(F.min("_m").alias("_m"))
    later = F.when(F.col("_m.at") < F.col(order), F.col("_m.of"))
    return points.join(first, ["lat", "lon"], "left").select(*points.columns, later.alias("duplicate_of"))


def nearest(a: DataFrame, b: DataFrame, metres: float, metric: str = "mercator") -> DataFrame:
    """Each a with its nearest b at most `metres` away (ties by b_id); NULLs where there is none.

    The least b_id of a place stands for it, and all points of a place have one nearest.
    """
    least = b.groupBy("b_lat", "b_lon").agg(F.min("b_id").alias("b_id"))
    met = near_places(a, b, metres, metric).join(least, ["b_lat", "b_lon"])
    best = met.groupBy("a_lat", "a_lon").agg(F.min(F.struct("distance_m", "b_id")).alias("_m")).select(
        "a_lat", "a_lon", F.col("_m.b_id").alias("b_id"), F.col("_m.distance_m").alias("distance_m"),
    )
    return a.join(best, ["a_lat", "a_lon"], "left").select(*a.columns, "b_id", "distance_m")


def listed(df: DataFrame, polygon: str, size: float, reach: float = 0.0) -> DataFrame:
    """df with a row for each grid cell (_cell) that a polygon's bounding box, widened by `reach`, touches."""
    b = bounds(polygon)
    span = lambda lo, hi: F.sequence(F.floor((b[lo] - reach) / size), F.floor((b[hi] + reach) / size))
    d = df.withColumn("_cx", F.explode(span("min_x", "max_x"))).withColumn("_cy", F.explode(span("min_y", "max_y")))
    return d.withColumn("_cell", F.struct(F.col("_cx").alias("cx"), F.col("_cy").alias("cy"))).drop("_cx", "_cy")


def places_in_shapes(points: DataFrame, shapes: DataFrame, size: float = 0.25) -> DataFrame:
    """(x, y, shape) of the different places of points (x, y) in shapes (shape, polygon).

    Places and bounding boxes meet in adaptive cells (quadtree); sides are rows, of which an odd number is crossed inside.
    """
    from tarnwatch.operators import quadtree

    p = points.where("x is not null and y is not null").select("x", "y").distinct()
    p = p.withColumns({"_x": F.col("x").cast("double"), "_y": F.col("y").cast("double")})
    box = bounds("polygon")
    b = shapes.select(
        "shape", quadtree.sides(F.col("polygon")).alias("_sides"), box["min_x"].alias("_x0"), box["max_x"].alias("_x1"),
        box["min_y"].alias("_y0"), box["max_y"].alias("_y1"),
    )
    met = quadtree.meet(p, b, size).withColumn("_side", F.explode("_sides"))
    odd = F.count_if(quadtree.crosses(F.col("_side"), F.col("_x"), F.col("_y"))) % 2 == 1
    return met.groupBy("x", "y", "shape").agg(odd.alias("inside")).where("inside").select("x", "y", "shape")


def shapes_of(polygons: DataFrame, polygon: str = "polygon") -> tuple[DataFrame, DataFrame]:
    """(shape, polygon) of the different polygons, numbered and written, and polygons with their shape instead of the corners."""
    s = polygons.where(F.col(polygon).isNotNull()).select(polygon).distinct()
    s = stored(s.select(F.monotonically_increasing_id().alias("shape"), polygon), "shapes")
    return s, polygons.join(s, polygon).drop(polygon)


def point_in_polygon(points: DataFrame, polygons: DataFrame, size: float = 0.25) -> DataFrame:
    """(point_id, polygon_id) of points (point_id, x, y) in polygons (polygon_id, polygon).

    Different places meet different polygons; then the ids of both are listed, so that only the result grows with the number of pairs.
    """
    shapes, named = shapes_of(polygons.select("polygon_id", "polygon"))
    held = places_in_shapes(points, shapes, size).join(packed(named, ["shape"]), "shape").drop("shape")
    return dealt(points.select("point_id", "x", "y"), held, ["x", "y"]).select("point_id", "polygon_id")


def first_region(points: DataFrame, polygons: DataFrame) -> DataFrame:
    """Every point with the first polygon (by id) that holds it, or NULL."""
    shapes, named = shapes_of(polygons.select("polygon_id", "polygon"))
    first = named.groupBy("shape").agg(F.min("polygon_id").alias("polygon_id"))
    hit = places_in_shapes(points, shapes).join(first, "shape").groupBy("x", "y").agg(F.min("polygon_id").alias("region"))
    return points.join(hit, ["x", "y"], "left").select(*points.columns, "region")


def link_epochs(old: DataFrame, new: DataFrame, metres: float = 200.0, prefix: str = "TARN_") -> DataFrame:
    """old (id, lat, lon) -> uid: the nearest new uid within reach (several may share one), else a number of its own
    after the largest, in order of id."""
    a = old.select(F.col("id").alias("a_id"), F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"))
    b = new.select(F.col("uid").alias("b_id"), F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon"))
    m = nearest(a, b, metres)
    top = new.agg(F.coalesce(F.max(F.regexp_extract("uid", r"(\d+)$", 1).cast("long")), F.lit(0)).alias("_top"))
    rest = numbered(m.where("b_id is null").select("a_id"), ["a_id"], "_n")
    fresh = rest.join(F.broadcast(top), how="cross").select(
        "a_id", F.concat(F.lit(prefix), zfill(F.col("_n") + F.col("_top"), 6)).alias("uid"), F.lit(None).cast("double").alias("distance_m"),
    )
    return m.where("b_id is not null").select(
        "a_id", F.col("b_id").alias("uid"), "distance_m",
    ).unionByName(fresh).withColumnRenamed("a_id", "id")


def dem_tiles(boxes: DataFrame, margin: float = 0.0) -> DataFrame:
    """The 1-degree tiles that boxes (min_x, max_x, min_y, max_y) touch, each once, with its name."""
    span = lambda lo, hi: F.explode(F.sequence(
        F.floor(F.col(lo) - margin), F.greatest(F.ceil(F.col(hi) + margin) - 1, F.floor(F.col(lo) - margin)),
    ))
    t = boxes.select(span("min_y", "max_y").alias("lat"), "min_x", "max_x").select("lat", span("min_x", "max_x").alias("lon")).distinct()
    name = F.format_string(
        "SRTMGL1_%s%02d%s%03d", F.when(F.col("lat") >= 0, "N").otherwise("S"), F.abs("lat"), F.when(F.col("lon") >= 0, "E").otherwise("W"),
        F.abs("lon"),
    )
    return t.withColumn("tile", name)


def nearest_cell(points: DataFrame, axis: list[float], value: str, out: str) -> DataFrame:
    """The grid coordinate nearest to a value, the first of equals, over a small axis."""
    a = F.array(*[F.lit(float(x)) for x in axis])
    best = F.aggregate(
        a, F.lit(None).cast("double"), lambda s, x: F.when(
            s.isNull() | (F.abs(x - F.col(value)) < F.abs(s - F.col(value))), x,
        ).otherwise(s),
    )
    return points.withColumn(out, best)
