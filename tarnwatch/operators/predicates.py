"""Classifications as Column expressions; the order of their branches counts."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnwatch.functions.scalars import col

# The words and limits below are part of the results.
RELIABLE = r"doi|journal|university|survey"
POPULAR = r"news|blog|times"
INDIA_REGIONS = ("himachal", "uttarakhand", "sikkim", "arunachal", "jammu", "kashmir", "ladakh", "india")
COUNTRIES = {"NP": "Nepal", "BT": "Bhutan"}
BOX = (6.0, 37.5, 68.0, 98.0)


def weather_quality(temperature="temperature_2m_c", precipitation="precipitation_mm") -> tuple[Column, Column]:
    """(flag, reason)"""
    bad = col(temperature).isNull() | col(precipitation).isNull()
    return F.when(bad, "rejected").otherwise("good"), F.when(bad, "missing_values").otherwise("ok")


def scene_quality(valid_fraction="valid_pixel_fraction") -> Column:
    return F.when(col(valid_fraction) > 0.8, "good").otherwise("acceptable")


def in_dates(ts, start: str, end: str) -> Column:
    """From the start of the first day to the last second of the last."""
    first = F.lit(start).cast("timestamp_ntz")
    last = F.timestamp_add("SECOND", F.lit(-1), F.timestamp_add("DAY", F.lit(1), F.lit(end).cast("timestamp_ntz")))
    return col(ts).between(first, last)


def usable_scene(cloud="cloud_cover", valid_pixels="valid_pixels", most_cloud: float = 0.5) -> Column:
    return (col(cloud) <= most_cloud * 100) & (col(valid_pixels) >= 20)


def usable_precipitation(p="precipitation_mm") -> Column:
    return F.coalesce(~F.isnan(col(p)) & (col(p) >= 0), F.lit(False))


def grid_longitude(lon, grid_max) -> Column:
    """A longitude in a grid's own range: 0 to 360 where the grid passes 180."""
    return F.when((col(grid_max) > 180) & (col(lon) < 0), col(lon) + 360).otherwise(col(lon))


def coordinate_flag(lat="latitude", lon="longitude", box=BOX) -> Column:
    inside = col(lat).between(box[0], box[1]) & col(lon).between(box[2], box[3])
    return F.when(F.coalesce(inside, F.lit(False)), "normal").otherwise("outside_expected_range")


def mentions(columns: list, words=INDIA_REGIONS) -> Column:
    """Whether any of the columns' text holds one of the words, whatever the case."""
    return F.lower(F.concat_ws(" ", *[col(c).cast("string") for c in columns])).rlike("|".join(words))


def in_country(country, region, name: str = "india", words=INDIA_REGIONS) -> Column:
    return F.coalesce(F.lower(col(country)).contains(name), F.lit(False)) | F.coalesce(
        F.lower(col(region)).rlike("|".join(words)), F.lit(False),
    )


def reliability(reference) -> Column:
    r = F.lower(F.trim(col(reference)))
    return F.when(
        r.isNull() | (r == "") | (r == "nan"), "UNVERIFIED",
    ).when(r.rlike(RELIABLE), "HIGH").when(r.rlike(POPULAR), "LOW").otherwise("MEDIUM")


def scientific(reference) -> Column:
    return F.when(col(reference).isNotNull(), "HIGH").otherwise("MEDIUM")


def country_name(code) -> Column:
    m = F.create_map(*[F.lit(x) for kv in COUNTRIES.items() for x in kv])
    return F.coalesce(m[col(code)], col(code))


def temporal_status(match_status, confidence, date, precision) -> Column:
    """Ordered: no confident match, weak event, no date, inexact date, labelable."""
    return (
        F.when(F.coalesce(col(match_status), F.lit("UNMATCHED")) != "HIGH_CONFIDENCE_MATCH", "TEMPORALLY_UNLABELABLE")
        .when(~F.coalesce(col(confidence).isin("HIGH", "MEDIUM"), F.lit(False)), "TEMPORALLY_UNLABELABLE")
        .when(col(date).isNull(), "INVALID_DATE")
        .when(~F.coalesce(col(precision).isin("DATE", "DATETIME"), F.lit(False)), "TEMPORALLY_UNLABELABLE")
        .otherwise("LABELABLE")
    )


def null_when_stale(columns: list[str], stale: str) -> dict[str, Column]:
    return {c: F.when(~F.coalesce(F.col(stale), F.lit(False)), F.col(c)) for c in columns}


def taxonomy(method="match_method") -> Column:
    m = col(method)
    return F.when(m == "polygon_intersection", "confirmed").when(m.contains("distance"), "manual_review").otherwise("unresolved")


def cross_validation_rows(horizon: int) -> Column:
    return (F.col("horizon_days") == horizon) & F.col("label_status").isin("POSITIVE", "NEGATIVE_ELIGIBLE")


def family(feature="feature") -> Column:
    f = col(feature)
    return F.when(f.rlike(r"_(3|7|14|30)d$"), "temporal").when(f.rlike("available|coverage"), "availability").otherwise("static")


def model_settings(name="model_name") -> dict[str, Column]:
    """Hyper-parameters from names such as xgb_d3_lr0.05_n200_balanced."""
    n = F.lower(col(name))
    return {
        "depth": F.expr(f"try_cast(regexp_extract(lower({name}), '_d([0-9]+)', 1) as int)"),
        "rate": F.expr(f"try_cast(regexp_extract(lower({name}), '_lr([0-9.]+)', 1) as double)"),
        "trees": F.expr(f"try_cast(regexp_extract(lower({name}), '_n([0-9]+)', 1) as int)"), "balanced": n.contains("balanced"),
    }


def heuristic(precipitation="precip_sum_7d", most: float = 50.0) -> Column:
    return F.when(F.coalesce(col(precipitation), F.lit(0.0)) > most, 1).otherwise(0)


def soft_heuristic(precipitation="precip_sum_7d", scale: float = 100.0) -> Column:
    return F.least(F.greatest(F.coalesce(col(precipitation), F.lit(0.0)) / scale, F.lit(0.0)), F.lit(1.0))
