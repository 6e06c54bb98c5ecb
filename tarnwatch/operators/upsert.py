"""Keyed ingestion: upserts that can run twice, and digests that show it."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """existing and new by key, the last row of a key kept: new before existing, then the last of `order`."""
    both = existing.withColumn("_gen", F.lit(0)).unionByName(new.withColumn("_gen", F.lit(1)), allowMissingColumns=True)
    w = W.partitionBy(*keys).orderBy(F.col("_gen").desc(), *(order or []))
    return both.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank", "_gen")


def replace_keys(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """existing without the keys that new has, plus new."""
    return existing.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def union_ragged(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def first_by_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")


def overwrite(df: DataFrame, path: str) -> None:
    """Replace the table at `path`; `df` may read it. There is always a whole table: the new one is written beside the old, the old
    one steps aside and is deleted only when the new one has its place. recover() settles what a crash between these steps leaves.
    """
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{path}.tmp")
    fs, (at, tmp, old) = places(spark, path)
    recover(spark, path)
    if fs.exists(at):
        moved(fs, at, old)
    try:
        moved(fs, tmp, at)
    except OSError:
        if fs.exists(old):
            moved(fs, old, at)
        raise
    fs.delete(old, True)


def recover(spark: SparkSession, path: str) -> None:
    """After a crash of overwrite(): the old table comes back where none is in its place, else it goes."""
    fs, (at, _, old) = places(spark, path)
    if fs.exists(old):
        if fs.exists(at):
            fs.delete(old, True)
        else:
            moved(fs, old, at)


def places(spark: SparkSession, path: str) -> tuple:
    """The file system, and the paths of the table, of the new one while it is written, and of the old one while it is replaced."""
    own = [spark._jvm.org.apache.hadoop.fs.Path(f"{path}{x}") for x in ("", ".tmp", ".old")]
    return own[0].getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), own


def moved(fs, a, b) -> None:
    if not fs.rename(a, b):
        raise OSError(f"{a} could not be renamed to {b}")


def table_digest(df: DataFrame) -> DataFrame:
    """One row (rows, digest) that no order of rows changes; equal rows do not cancel."""
    h = F.xxhash64(*[F.col(c) for c in sorted(df.columns)])
    return df.agg(F.count("*").alias("rows"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("digest"))
