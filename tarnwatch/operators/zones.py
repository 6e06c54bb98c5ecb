"""Statistics of a raster under polygons: scanline runs from edge rows, joined to tiles.

A pixel counts if its centre is inside. On each pixel row the sides that cross it, in order, open and close runs of columns; runs
are cut at tile borders and joined to the tiles by their numbers. Runs are shuffled, pixels are not: each tile's pixels are summed
up where the tile is.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwatch.operators.edges import edge_rows


def runs(polygons: DataFrame, west: float, north: float, cell: float, key: str = "id", polygon: str = "polygon") -> DataFrame:
    """(id, row, first, last): the pixels of a raster, whose corner is (west, north) and whose rows run south, with their centres
    in a polygon; what an odd number of rings covers is inside."""
    e = edge_rows(polygons, key, polygon)
    place = lambda y: (F.lit(float(north)) - y) / cell - 0.5
    rows = F.sequence(F.floor(place(F.greatest("y0", "y1"))) + 1, F.floor(place(F.least("y0", "y1"))))
    any_row = F.floor(place(F.greatest("y0", "y1"))) + 1 <= F.floor(place(F.least("y0", "y1")))
    c = e.where((F.col("y0") != F.col("y1")) & any_row).withColumn("row", F.explode(rows))
    y = F.lit(float(north)) - (F.col("row") + 0.5) * cell
    x = F.col("x0") + (y - F.col("y0")) / (F.col("y1") - F.col("y0")) * (F.col("x1") - F.col("x0"))
    g = c.groupBy("id", "row").agg(F.array_sort(F.collect_list(F.ceil((x - west) / cell - 0.5))).alias("_c"))
    pairs = F.transform(
        F.sequence(F.lit(0), F.floor(F.size("_c") / 2).cast("int") - 1),
        lambda k: F.struct(F.get("_c", 2 * k).alias("first"), (F.get("_c", 2 * k + 1) - 1).alias("last")),
    )
    return g.select("id", "row", F.inline(pairs)).where("first <= last")


def zone_stats(
    tiles: DataFrame, polygons: DataFrame, west: float, north: float, cell: float, value: str = "value", key: str = "id",
    polygon: str = "polygon",
) -> DataFrame:
    """(id, pixels, valid, mean, low, high, median) of the pixels in each polygon, NULL for polygons without one that has a value.

    tiles (tile_row, tile_col, height, width, value array in row order), all tiles of one size, numbered from the corner.
    Polygons that lie outside of all tiles have no row; NULL pixels count in `pixels` only.
    """
    size = tiles.select("height", "width").first()
    height, width = (size.height, size.width) if size else (1, 1)
    r = runs(polygons, west, north, cell, key, polygon)
    r = r.withColumn("tile_row", F.floor(F.col("row") / height)).withColumn(
        "tile_col", F.explode(F.sequence(F.floor(F.col("first") / width), F.floor(F.col("last") / width))),
    )
    start = F.greatest("first", F.col("tile_col") * width)
    r = r.select(
        "id", "tile_row", "tile_col", ((F.col("row") - F.col("tile_row") * height) * width + start - F.col("tile_col") * width).alias("_at"),
        (F.least("last", F.col("tile_col") * width + width - 1) - start + 1).alias("_n"),
    )
    t = tiles.select(F.col("tile_row").cast("long").alias("tile_row"), F.col("tile_col").cast("long").alias("tile_col"), F.col(value).alias("_v"))
    met = r.join(t, ["tile_row", "tile_col"]).select("id", F.explode(F.slice("_v", F.col("_at").cast("int") + 1, F.col("_n").cast("int"))).alias("v"))
    return met.groupBy("id").agg(
        F.count("*").alias("pixels"), F.count("v").alias("valid"), F.avg("v").alias("mean"), F.min("v").alias("low"), F.max("v").alias("high"),
        F.percentile("v", F.lit(0.5)).alias("median"),
    )
