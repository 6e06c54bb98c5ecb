"""Invariants and audits; each returns rows, so a report is a table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicate_grain(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).count().where("count > 1")


def null_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, null_rate, rows)"""
    m = df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in columns])
    return m.unpivot([], columns, "column", "null_rate")


def forbidden(df: DataFrame, names: list[str]) -> list[str]:
    return sorted(set(df.columns) & set(names))


def quality_report(aligned: DataFrame, sources: list[str], run_id: str | None = None) -> DataFrame:
    """(source, valid, current, cached, stale) rows, in one aggregate."""
    f = {}
    for s in sources:
        there = F.col(f"{s}_timestamp").isNotNull()
        f[f"{s}_valid"] = F.count_if(there)
        f[f"{s}_stale"] = F.count_if(F.col(f"{s}_stale"))
        if run_id is not None and f"{s}_run_id" in aligned.columns:
            f[f"{s}_current"] = F.count_if(F.col(f"{s}_run_id") == run_id)
            f[f"{s}_cached"] = F.count_if(there & (F.coalesce(F.col(f"{s}_run_id"), F.lit("")) != run_id))
    return aligned.agg(*[e.alias(n) for n, e in f.items()]).unpivot([], list(f), "metric", "value")


def value_ranges(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, lo, hi, infinite, negative, nulls)"""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "column", "value")
    v = F.col("value")
    return long.groupBy("column").agg(
        F.min("value").alias("lo"), F.max("value").alias("hi"), F.count_if(F.abs(v) == float("inf")).alias("infinite"),
        F.count_if(v < 0).alias("negative"), F.count_if(v.isNull()).alias("nulls"),
    )


def flag_sets(df: DataFrame, by: str, flags: list[str]) -> DataFrame:
    """(by, flag, values, trues, falses, nulls)"""
    long = df.select(by, *flags).unpivot([by], flags, "flag", "value")
    return long.groupBy(by, "flag").agg(
        F.array_sort(F.collect_set("value")).alias("values"), F.count_if(F.col("value")).alias("trues"),
        F.count_if(~F.col("value")).alias("falses"), F.count_if(F.col("value").isNull()).alias("nulls"),
    )


def coverage(entities: DataFrame, sources: dict[str, DataFrame], key: str = "lake_uid") -> DataFrame:
    """Rows a source and the list of sources that have any."""
    out = entities.select(key).distinct()
    for n, df in sources.items():
        out = out.join(df.groupBy(key).agg(F.count("*").alias(n)), key, "left")
    out = out.withColumns({n: F.coalesce(n, F.lit(0)) for n in sources})
    return out.withColumn("modalities", F.array_compact(F.array(*[F.when(F.col(n) > 0, F.lit(n)) for n in sources])))


def accounting(df: DataFrame, status: str, key: str) -> DataFrame:
    """Rows, distinct keys, and whether ids are unique and statuses add up."""
    return df.agg(
        F.count("*").alias("rows"), F.countDistinct(key).alias("ids"), F.count(status).alias("with_status"),
    ).withColumns({"ids_unique": F.col("rows") == F.col("ids"), "adds_up": F.col("rows") == F.col("with_status")})


def singletons(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of groups of one."""
    return df.join(df.groupBy(*keys).count().where("count = 1").drop("count"), keys, "left_semi")


def run_status(log: DataFrame, stage: str = "stage", line: str = "line", n: str = "n") -> DataFrame:
    """(stage, status) of a run's log (stage, n, line): what follows [STATUS] in the last such line, UNKNOWN without one."""
    said = F.when(F.col(line).startswith("[STATUS]"), F.struct(F.col(n), F.trim(F.substring(line, 9, 1000)).alias("s")))
    return log.groupBy(stage).agg(F.coalesce(F.max(said)["s"], F.lit("UNKNOWN")).alias("status"))


def completion(statuses: DataFrame, by: list[str], stage: str = "stage", status: str = "status") -> DataFrame:
    """(by, complete): whether DEM, any time source, quality control and the leakage test came out well."""
    well = F.col(status).isin("SUCCESS", "PARTIAL")
    has = lambda *names: F.coalesce(F.bool_or(well & F.col(stage).isin(*names)), F.lit(False))
    return statuses.groupBy(*by).agg(
        (has("dem") & has("era5", "sentinel2", "modis", "gpm") & has("quality_control") & has("leakage_test")).alias("complete")
    )


def stage_result(statuses: list[str]) -> str:
    """Of a stage's reported statuses the last; UNKNOWN without any."""
    return statuses[-1] if statuses else "UNKNOWN"


def run_complete(status: dict[str, str]) -> bool:
    """DEM, any time source, quality control and the leakage test succeeded."""
    ok = {s for s, v in status.items() if v in ("SUCCESS", "PARTIAL")}
    return "dem" in ok and bool(ok & {"era5", "sentinel2", "modis", "gpm"}) and {"quality_control", "leakage_test"} <= ok
