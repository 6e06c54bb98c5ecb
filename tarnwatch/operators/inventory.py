"""Site inventories: canonical columns, units, numbering, duplicate flags."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnwatch.functions.ranges import numbered, percentiles
from tarnwatch.functions.scalars import number, resolve, utm_xy, zfill
from tarnwatch.operators.geo import area, near_duplicates

# The columns of a canonical inventory, in order.
CANONICAL = [
    "lake_uid", "source_lake_id", "source_dataset", "source_version", "observation_epoch", "country", "state_or_region", "latitude",
    "longitude", "geometry",
    "elevation_m", "lake_area_km2", "lake_type", "glacier_id", "river_basin", "geometry_repair_status", "duplicate_status",
    "boundary_status", "india_overlap_ratio",
    "coordinate_flag", "source_url", "license", "access_date",
]
# The names that sources use, first match wins, case does not count.
CANDIDATES = {
    "source_lake_id": ["GLIMS_ID", "Lake_ID", "ID", "FID", "OBJECTID", "GL_ID"],
    "elevation_m": ["Lake_Elev", "elevation", "elev", "DEM", "altitude", "Alt", "Z_mean", "Z_med"],
    "lake_area_km2": ["Area_km2", "Area", "Lake_Area", "AREA_SQKM"],
    "lake_type": ["lake_type", "type", "GL_Type"],
    "glacier_id": ["glacier_id", "RGI_ID"],
    "river_basin": ["river_basin", "basin", "Sub_Basin"],
}


def canonical(df: DataFrame, extras: bool = True) -> DataFrame:
    """Canonical columns that are there, in order, then the others."""
    first = [c for c in CANONICAL if c in df.columns]
    return df.select(*first, *[c for c in df.columns if extras and c not in first])


def resolve_columns(df: DataFrame, candidates: dict | None = None) -> DataFrame:
    """Every canonical name from the first candidate there is, whatever its case, else NULL."""
    found = {n: resolve(df, c) for n, c in (candidates or CANDIDATES).items()}
    return df.select("*", *[(F.col(c) if c else F.lit(None)).alias(n) for n, c in found.items() if n not in df.columns])


def to_km2(df: DataFrame, area: str = "lake_area_km2", limit: float = 100.0) -> DataFrame:
    """Areas over 1e6 if their median says that they are square metres."""
    m = percentiles(df.select(number(area).alias("_a")), [], "_a", [0.5]).select(F.col("q")[0].alias("_median"))
    a = number(area)
    return df.join(F.broadcast(m), how="cross").withColumn(area, F.when(F.col("_median") > limit, a / 1e6).otherwise(a)).drop("_median")


def standardised(df: DataFrame, order: list, polygon: str | None = "polygon", zone: int = 44) -> DataFrame:
    """Canonical id, elevation and area with their fallbacks: without an id column rows are ROW_0, ROW_1, ... in the
    given order, and without an area column the polygon's own area in UTM metres counts. Areas are km2 to 6 places."""
    have = {n: resolve(df, CANDIDATES[n]) for n in ("source_lake_id", "elevation_m", "lake_area_km2")}
    d = df
    if have["source_lake_id"]:
        d = d.withColumn("source_lake_id", F.col(have["source_lake_id"]).cast("string"))
    else:
        d = numbered(d, order, "_n").withColumn("source_lake_id", F.concat(F.lit("ROW_"), (F.col("_n") - 1).cast("string"))).drop("_n")
    d = d.withColumn("elevation_m", number(have["elevation_m"]) if have["elevation_m"] else F.lit(None).cast("double"))
    if have["lake_area_km2"]:
        d = to_km2(d.withColumn("lake_area_km2", number(have["lake_area_km2"])))
    elif polygon:
        flat = F.transform(
            polygon,
            lambda r: F.transform(r, lambda p: F.struct(*[c.alias(n) for c, n in zip(utm_xy(p["y"], p["x"], zone), "xy", strict=True)])),
        )
        d = d.withColumn("_flat", flat).withColumn("lake_area_km2", area("_flat") / 1e6).drop("_flat")
    return d.withColumn("lake_area_km2", F.round("lake_area_km2", 6))


def kelvin_to_celsius(c):
    return F.col(c) - 273.15


def metres_to_mm(c):
    return F.col(c) * 1000.0


def surrogate_ids(df: DataFrame, order: list, prefix: str, out: str = "lake_uid", width: int = 6) -> DataFrame:
    """prefix and a number in a declared order, which is total if the ids are to be stable."""
    return numbered(df, order, "_n").withColumn(out, F.concat(F.lit(prefix), zfill("_n", width))).drop("_n")


def registry(tables: dict[str, tuple[DataFrame, str]], constants: dict[str, dict]) -> DataFrame:
    """Countries' inventories in one schema: uid = prefix and zero-padded source id."""
    out = None
    for country, (df, prefix) in tables.items():
        t = df.select(
            F.concat(F.lit(prefix), zfill("source_lake_id", 6)).alias("lake_uid"), F.lit(country).alias("country"),
            F.col("source_lake_id").cast("string"), *[F.lit(v).alias(k) for k, v in constants[country].items()],
        )
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    return out


def duplicate_flags(df: DataFrame, metres: float = 50.0) -> DataFrame:
    """df (id, idx, wkt, lat, lon) plus duplicate_status: of equal geometries all but the first, then rows at most
    `metres` from an earlier one of the rest. Rows are flagged, never removed."""
    w = W.partitionBy(F.sha2("wkt", 256)).orderBy("idx")
    d = df.withColumn("_exact", F.row_number().over(w) > 1)
    near = near_duplicates(d.where("not _exact"), metres).select("id", "duplicate_of")
    d = d.join(near, "id", "left")
    return d.withColumn(
        "duplicate_status",
        F.when(F.col("_exact"), "exact_duplicate").when(F.col("duplicate_of").isNotNull(), "near_duplicate_candidate").otherwise("unique"),
    ).drop("_exact")


def id_quality(df: DataFrame, candidates=("id", "lake_id", "objectid", "fid")) -> DataFrame:
    """Null ids, and rows beyond the first of an id, in the first id column there is."""
    c = resolve(df, list(candidates))
    g = df.groupBy(c).count()
    return g.agg(
        F.lit(c).alias("id_column"), F.coalesce(F.sum(F.when(F.col(c).isNull(), F.col("count"))), F.lit(0)).alias("null_ids"),
        F.coalesce(F.sum(F.when(F.col(c).isNotNull(), F.col("count") - 1)), F.lit(0)).alias("duplicate_ids"),
    )


def stage_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, rows): histograms of several columns in one pass."""
    return df.select(
        *[F.coalesce(F.col(c).cast("string"), F.lit("NULL")).alias(c) for c in columns]
    ).unpivot([], columns, "column", "value").groupBy("column", "value").agg(F.count("*").alias("rows"))
