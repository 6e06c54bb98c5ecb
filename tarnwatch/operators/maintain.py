"""Derived tables kept current after late rows and corrections, without computing them anew.

Observations, features and baselines are bucketed tables (`buckets`), placed by entity. Two versions of the observations tell
what a batch changed; only those entities' buckets are read, and of them only the rows that a changed row's windows reach.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwatch.functions.storage import stored
from tarnwatch.operators import buckets
from tarnwatch.operators.upsert import first_by_key


def changed(keys: DataFrame, path: str, version: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows that these keys had in the version before, rows that they have in this one, all rows of their buckets)."""
    spark, m = keys.sparkSession, buckets.manifest(keys.sparkSession, path, version)
    on, only = m["keys"], buckets.placed_in(m, keys)
    now = buckets.read(spark, path, version, only)
    own = keys.select(*on).distinct()
    before = buckets.read(spark, path, version - 1, only) if version > 1 else now.where("false")
    return before.join(own, on, "left_semi"), now.join(own, on, "left_semi"), now


def spans(rows: DataFrame, observations: DataFrame, days: float, key: str = "lake_uid", ts: str = "observation_timestamp") -> DataFrame:
    """(key, _from, _to, _floor): where features may differ after `rows` came, went or changed, and from where on they read.

    A window of up to `days` ends within them of a changed row. A change over up to `days` refers to the last row before, so a row
    also serves until as long after the next one, and the first row that is read is the last one at or before _from - days.
    """
    width = F.lit(int(days * 86400))
    c = rows.groupBy(key).agg(F.min(ts).alias("_from"), F.max(ts).alias("_last"))
    at = F.col(ts)
    near = observations.join(c, key).groupBy(key, "_from", "_last").agg(
        F.max(F.when(at <= F.timestamp_add("SECOND", -width, F.col("_from")), at)).alias("_before"), F.min(F.when(at > F.col("_last"), at)).alias("_next"),
    )
    return near.select(
        key, "_from", F.timestamp_add("SECOND", width, F.coalesce("_next", "_last")).alias("_to"),
        F.coalesce("_before", F.timestamp_add("SECOND", -width, F.col("_from"))).alias("_floor"),
    )


def reach(observations: DataFrame, where: DataFrame, key: str = "lake_uid", ts: str = "observation_timestamp") -> DataFrame:
    """The rows from which features within the spans are computed, with their spans."""
    return observations.join(where, key).where(F.col(ts).between(F.col("_floor"), F.col("_to")))


def refreshed(
    observations: DataFrame, where: DataFrame, compute: Callable[[DataFrame], DataFrame], key: str = "lake_uid", ts: str = "observation_timestamp",
) -> DataFrame:
    """compute() over what the spans reach; rows within the spans. compute adds columns and keeps all rows."""
    made = compute(reach(observations, where, key, ts))
    return made.where(F.col(ts).between(F.col("_from"), F.col("_to"))).drop("_from", "_to", "_floor")


def moments(df: DataFrame, value: str, key: str = "lake_uid") -> DataFrame:
    """(key, n, mean, m2) of the values that are there; m2 is the sum of squared deviations."""
    v = F.col(value).cast("double")
    return df.groupBy(key).agg(F.count(v).alias("n"), F.coalesce(F.avg(v), F.lit(0.0)).alias("mean"), F.coalesce(F.var_pop(v) * F.count(v), F.lit(0.0)).alias("m2"))


def merged(a: Column, b: Column, sign: int) -> Column:
    """Moments of a with b's rows added (1) or taken out (-1)."""
    n = a["n"] + sign * b["n"]
    some_n = F.nullif(n, F.lit(0))  # a division by 0 is an error even in a branch not taken
    mean = (a["n"] * a["mean"] + sign * b["n"] * b["mean"]) / some_n
    gap = b["mean"] - a["mean"]
    m2 = a["m2"] + sign * b["m2"] + sign * gap * gap * a["n"] * b["n"] / some_n
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
    some = F.struct(n.alias("n"), mean.alias("mean"), F.greatest(m2, F.lit(0.0)).alias("m2"))
    return F.when(n > 0, some).otherwise(none)


def moved(state: DataFrame, before: DataFrame, now: DataFrame, value: str, key: str = "lake_uid") -> DataFrame:
    """state (key, n, mean, m2) of the entities in `now` or `before`: first with `now` added, then with `before` taken out."""
    rows = None
    for side, df in (("_state", state), ("_now", moments(now, value, key)), ("_before", moments(before, value, key))):
        d = df.select(key, F.struct("n", "mean", "m2").alias(side))
        rows = d if rows is None else rows.join(d, key, "full")
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
    have = {c: F.coalesce(c, none) for c in ("_state", "_now", "_before")}
    rows = rows.where(F.col("_now").isNotNull() | F.col("_before").isNotNull()).withColumns(have)
    rows = rows.withColumn("_x", merged(F.col("_state"), F.col("_now"), 1))
    return rows.withColumn("_x", merged(F.col("_x"), F.col("_before"), -1)).select(key, "_x.*")


def absorb(
    batch: DataFrame, path: str, label: str, compute: Callable[[DataFrame], DataFrame], days: float, value: str, order: list[Column],
    count: int = buckets.BUCKETS, key: str = "lake_uid", id: str = "observation_id", ts: str = "observation_timestamp",
) -> dict[str, int]:
    """Take new, late and corrected observations into path/observations, path/features and path/moments; the versions made.

    Of rows with one (key, id) the last batch counts, within a batch the first by `order`. Rows without key, id or time are left
    out. A batch with the label that the last one had may have stopped half way: what it changed is read from the last two versions of the observations,
    which is why the version before the last must be kept. Moments lose digits where what is taken out is far larger than what
    stays. Late rows of an entity far apart make one long span.
    """
    spark = batch.sparkSession
    rows = batch.where(F.col(key).isNotNull() & F.col(id).isNotNull() & F.col(ts).isNotNull())
    rows = stored(first_by_key(rows, [key, id], order), "absorbed")
    at = {x: f"{path}/{x}" for x in ("observations", "features", "moments")}
    if rows.isEmpty():
        return {}
    made = {"observations": buckets.upsert(rows, at["observations"], [key, id], order, count, label, [key])}
    before, now, all_rows = changed(rows, at["observations"], made["observations"])
    where = stored(spans(before.select(key, ts).union(now.select(key, ts)), all_rows, days, key, ts), "spans")
    made["features"] = buckets.upsert(refreshed(all_rows, where, compute, key, ts), at["features"], [key, id], None, count, None, [key])
    m = buckets.manifest(spark, at["moments"])
    have = None if m is None else buckets.read(spark, at["moments"], only=buckets.placed_in(m, rows.select(key)))
    if m is None:
        have = spark.createDataFrame([], moments(now, value, key).schema)
    made["moments"] = buckets.upsert(moved(have, before, now, value, key), at["moments"], [key], None, count, label)
    return made
