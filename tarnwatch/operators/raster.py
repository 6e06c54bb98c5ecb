"""Pixel algebra on tile tables: a row a tile, bands as arrays in row order."""

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwatch.functions.scalars import circular_mean, col, fraction

#: Scene classes that hold no surface: no data, shadow, clouds, cirrus.
MASKED = (0, 3, 8, 9, 10)


def mndwi(green, swir) -> Column:
    """(g - s) / (g + s) a pixel, NULL where the sum is 0."""
    return F.zip_with(col(green), col(swir), lambda g, s: F.try_divide((g - s).cast("double"), (g + s).cast("double")))


def water_stats(
    tiles: DataFrame, keys: list[str], green: str = "green", swir: str = "swir", scl: str = "scl", pixel_m2: float = 100.0,
) -> DataFrame:
    """Counts, fractions, index statistics (population deviation) and water area of each tile's clear pixels."""
    p = tiles.select(
        *keys, F.explode(F.arrays_zip(mndwi(green, swir).alias("index"), F.col(scl).alias("scl"))).alias("p"),
    ).select(*keys, F.col("p.index").alias("index"), F.col("p.scl").alias("scl"))
    clear = ~F.col("scl").isin(*MASKED)
    x = F.when(clear, F.col("index"))
    g = p.groupBy(*keys).agg(
        F.count("*").alias("pixels"), F.count_if(clear).alias("valid_pixels"),
        F.count_if(F.col("scl").isin(8, 9, 10)).alias("cloud_pixels"), F.count_if(clear & (F.col("index") > 0)).alias("water_pixels"),
        F.avg(x).alias("ndwi_mean"), F.percentile(x, F.lit(0.5)).alias("ndwi_median"), F.stddev_pop(x).alias("ndwi_std"),
    )
    return g.withColumns(
        {
            "cloud_fraction": fraction(F.col("cloud_pixels"), F.col("pixels")),
            "valid_pixel_fraction": fraction(F.col("valid_pixels"), F.col("pixels")),
            "water_pixel_fraction": fraction(F.col("water_pixels"), F.col("valid_pixels")),
            "lake_area_km2": F.col("water_pixels") * pixel_m2 / 1e6,
        }
    )


def snow_fraction(raw="raw") -> Column:
    """Of an array's values 0 to 100 the share above 0, NULL where there is none."""
    ok = F.filter(col(raw), lambda v: (v >= 0) & (v <= 100))
    return fraction(F.size(F.filter(ok, lambda v: v > 0)), F.size(ok))


def slope_aspect(z, dx: float, dy: float, downslope: bool = False):
    """Slope and aspect in degrees by central differences (one-sided at the rim); NaN where a neighbour lacks a value.

    Aspect is the bearing of steepest ascent with rows running south, or with downslope of steepest descent.
    """
    gy, gx = np.gradient(np.asarray(z, float), dy, dx)
    slope = np.degrees(np.arctan(np.hypot(gx, gy)))
    aspect = (90 - np.degrees(np.arctan2(-gy, gx))) % 360
    return slope, (aspect + 180) % 360 if downslope else aspect


def terrain(tiles: DataFrame, keys: list[str], cell_m: float = 30.0, downslope: bool = False) -> DataFrame:
    """tiles (keys, height, width, elevation array, NULL for no data) -> mean elevation, mean and largest slope and
    circular mean aspect of the pixels whose neighbours all have values."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("array<struct<z:double,slope:double,aspect:double>>")
    def pixels(height, width, values):
        import pandas as pd

        out = []
        for h, w, v in zip(height, width, values, strict=True):
            z = np.array([np.nan if x is None else x for x in v], float).reshape(h, w)
            s, a = slope_aspect(z, cell_m, cell_m, downslope) if min(h, w) > 1 else (np.full_like(z, np.nan),) * 2
            out.append(
                [
                    {"z": x, "slope": y, "aspect": t} for x, y, t in zip(
                        *(np.where(np.isnan(k), None, k).ravel().tolist() for k in (z, s, a)), strict=True,
                    )
                ]
            )
        return pd.Series(out)

    p = tiles.select(*keys, F.explode(pixels("height", "width", "elevation")).alias("p")).select(*keys, "p.*")
    return p.groupBy(*keys).agg(
        F.avg("z").alias("elevation_m"), F.avg("slope").alias("mean_slope_deg"), F.max("slope").alias("max_slope_deg"),
        circular_mean("aspect").alias("mean_aspect_deg"),
    )


def sinusoidal_index(lat, lon, tile_h: int, tile_v: int, size: int = 2400) -> tuple[Column, Column]:
    """(row, column) of a point in a tile of the sinusoidal grid, clamped to it."""
    radius, span = 6371007.181, 1111950.5196666666
    x = F.radians(col(lon)) * F.cos(F.radians(col(lat))) * radius
    y = F.radians(col(lat)) * radius
    clamp = lambda v: F.least(F.greatest(F.floor(v), F.lit(0)), F.lit(size - 1)).cast("int")
    return clamp((9 * span - y - tile_v * span) / (span / size)), clamp((x + 18 * span - tile_h * span) / (span / size))
