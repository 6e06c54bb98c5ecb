"""Mosaics of raster tiles seen through another projection, interpolated bilinearly across tile borders.

Tiles are numbered from one corner and never put together: each gets a halo, the first row, column and pixel of its neighbours, and
blocks of the target look up the tiles that they meet by an equi-join of tile numbers.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RADIUS = 6378137.0


def from_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    """Web Mercator metres -> (lon, lat)."""
    return F.degrees(x / RADIUS), F.degrees(2 * F.atan(F.exp(y / RADIUS)) - F.pi() / 2)


def with_halo(tiles: DataFrame, height: int, width: int, value: str = "value") -> DataFrame:
    """(tile_row, tile_col, own, east, south, corner): each tile's pixels, and those just beyond its east and south border; also rows
    of places without a tile of their own beside one that has."""
    i, j, v = F.col("tile_row").cast("long"), F.col("tile_col").cast("long"), F.col(value)
    part = lambda k, a, b, x: F.struct(F.lit(k).alias("kind"), a.alias("i"), b.alias("j"), x.alias("x"))
    parts = F.array(
        part(0, i, j, v), part(1, i, j - 1, F.transform(F.sequence(F.lit(0), F.lit(height - 1)), lambda r: F.get(v, r * width))),
        part(2, i - 1, j, F.slice(v, 1, width)), part(3, i - 1, j - 1, F.slice(v, 1, 1)),
    )
    p = tiles.select(F.explode(parts).alias("p")).select("p.*")
    of = lambda k: F.max(F.when(F.col("kind") == k, F.col("x")))
    return p.groupBy(F.col("i").alias("tile_row"), F.col("j").alias("tile_col")).agg(
        of(0).alias("own"), of(1).alias("east"), of(2).alias("south"), of(3).alias("corner"),
    )


def reproject(
    tiles: DataFrame, source: tuple[float, float, float], target: tuple[float, float, float], rows: int, columns: int,
    inverse: Callable[[Column, Column], tuple[Column, Column]] = from_mercator, block: int = 64, value: str = "value",
) -> DataFrame:
    """(row, col, value) of the target's pixels that see a value.

    tiles (tile_row, tile_col, height, width, value array in row order), all of one size; source and target are (west, north,
    cell) in their own coordinates, rows run south. inverse maps the target's x, y to the source's. A pixel is the mean of the
    four source pixels round its centre by their nearness; NULL ones and those outside count for nothing. Each axis of
    `inverse` must run one way within a block, as projections do.
    """
    spark = tiles.sparkSession
    size = tiles.select("height", "width").first()
    height, width = (size.height, size.width) if size else (1, 1)
    west, north, cell = source
    to_x = lambda c: F.lit(float(target[0])) + (c + 0.5) * target[2]
    to_y = lambda r: F.lit(float(target[1])) - (r + 0.5) * target[2]

    def at(r, c):
        """Place (down, across) in source pixels of a target pixel's centre."""
        x, y = inverse(to_x(c), to_y(r))
        return (F.lit(float(north)) - y) / cell - 0.5, (x - west) / cell - 0.5

    across = -(-columns // block)
    b = spark.range(-(-rows // block) * across).select(F.floor(F.col("id") / across).alias("br"), (F.col("id") % across).alias("bc"))
    corners = [at(F.col("br") * block + i, F.col("bc") * block + j) for i in (0, block - 1) for j in (0, block - 1)]
    span = lambda k, size: F.sequence(
        F.floor((F.floor(F.least(*[c[k] for c in corners])) - 1) / size), F.floor((F.floor(F.greatest(*[c[k] for c in corners])) + 1) / size),
    )
    b = b.withColumn("tile_row", F.explode(span(0, height))).withColumn("tile_col", F.explode(span(1, width)))
    met = b.join(with_halo(tiles, height, width, value), ["tile_row", "tile_col"])
    p = met.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(block * block - 1))))
    p = p.withColumns({"row": F.col("br") * block + F.floor(F.col("_k") / block), "col": F.col("bc") * block + F.col("_k") % block}).where(
        (F.col("row") < rows) & (F.col("col") < columns),
    )
    v, u = at(F.col("row"), F.col("col"))
    p = p.withColumns({"_v": v, "_u": u}).withColumns({
        "_r": F.floor("_v") - F.col("tile_row") * height, "_c": F.floor("_u") - F.col("tile_col") * width,
    })
    p = p.where(F.col("_r").between(0, height - 1) & F.col("_c").between(0, width - 1))
    r, c = F.col("_r").cast("int"), F.col("_c").cast("int")
    last_r, last_c = r == height - 1, c == width - 1
    own = lambda i, j: F.get("own", (r + i) * width + c + j)
    near = [
        own(0, 0), F.when(last_c, F.get("east", r)).otherwise(own(0, 1)), F.when(last_r, F.get("south", c)).otherwise(own(1, 0)),
        F.when(
            last_r & last_c, F.get("corner", F.lit(0)),
        ).when(last_r, F.get("south", c + 1)).when(last_c, F.get("east", r + 1)).otherwise(own(1, 1)),
    ]
    fv, fu = F.col("_v") - F.floor("_v"), F.col("_u") - F.floor("_u")
    p = p.select("row", "col", *[n.alias(f"n{k}") for k, n in enumerate(near)], fv.alias("fv"), fu.alias("fu"))
    weights = [(1 - F.col("fv")) * (1 - F.col("fu")), (1 - F.col("fv")) * F.col("fu"), F.col("fv") * (1 - F.col("fu")), F.col("fv") * F.col("fu")]
    known = sum((F.when(F.col(f"n{k}").isNotNull(), w).otherwise(0.0) for k, w in enumerate(weights)), F.lit(0.0))
    total = sum((F.coalesce(F.col(f"n{k}") * w, F.lit(0.0)) for k, w in enumerate(weights)), F.lit(0.0))
    return p.select("row", "col", F.when(known > 0, total / known).alias("value")).where("value is not null")
