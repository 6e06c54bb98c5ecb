"""Keyed tables in buckets: an upsert rewrites only the buckets that its keys fall in.

A table is a folder: data files under data/, a folder a write and bucket, and manifests that say which folders make up a
version. A version comes to be by one rename of its manifest, so a crash before it changes nothing, a reader never sees half a
write, and a version stays readable until vacuum() drops it. Two writers of one version cannot both have the rename.
"""

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwatch.functions.storage import stored
from tarnwatch.operators.upsert import upsert as merged

BUCKETS = 64


def file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions that can be read, oldest first."""
    fs, at = file_system(spark, path)
    if not fs.exists(at):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(at)]
    return sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json"))


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict | None:
    """A version's manifest, the last one's by default; None where there is no table."""
    found = versions(spark, path)
    if not found or version is not None and version not in found:
        if version is None:
            return None
        raise ValueError(f"{path} has no version {version}")
    fs, at = file_system(spark, f"{path}/manifest-{found[-1] if version is None else version}.json")
    stream = fs.open(at)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def commit(spark: SparkSession, path: str, new: dict) -> None:
    """Make `new` the version after the last. A version that another writer has made in the meantime stays, and this one fails."""
    text, name = json.dumps(new).encode(), f"{path}/manifest-{new['version']}.json"
    fs, at = file_system(spark, name)
    tmp = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/.{uuid.uuid4().hex}.tmp")
    out = fs.create(tmp, False)
    out.write(bytearray(text))
    out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark._jsparkSession.sessionState().newHadoopConf())
    none = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    context.rename(fs.makeQualified(tmp), fs.makeQualified(at), none)  # fails where the name is taken


def bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def read(spark: SparkSession, path: str, version: int | None = None, only: list[int] | None = None, schema: T.StructType | None = None) -> DataFrame:
    """The table, or its buckets `only`; no rows of `schema` where there is no table yet."""
    m = manifest(spark, path, version)
    if m is None:
        if schema is None:
            raise ValueError(f"no table in {path}")
        return spark.createDataFrame([], schema)
    folders = [f"{path}/{x}" for b, x in m["folders"].items() if only is None or int(b) in only]
    own = T.StructType.fromJson(m["schema"])
    return spark.read.schema(own).parquet(*folders) if folders else spark.createDataFrame([], own)


def placed_in(m: dict, rows: DataFrame) -> list[int]:
    """The buckets of a table that hold the keys of `rows`: at most as many as it has."""
    return [r.b for r in rows.select(bucket(m.get("by") or m["keys"], m["buckets"]).alias("b")).distinct().collect()]


def write(df: DataFrame, path: str, into: dict, label: str | None) -> dict:
    """Write df's buckets beside the old ones and commit the version that has them."""
    spark, name = df.sparkSession, f"data/{uuid.uuid4().hex}"
    placed = df.withColumn("_bucket", bucket(into.get("by") or into["keys"], into["buckets"]))
    placed.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{path}/{name}")
    fs, at = file_system(spark, f"{path}/{name}")
    made = {f.getPath().getName().removeprefix("_bucket="): f"{name}/{f.getPath().getName()}" for f in fs.listStatus(at) if f.isDirectory()}
    labels = into["labels"] | ({} if label is None else {label.rpartition(":")[0]: label})
    new = into | {"version": into["version"] + 1, "folders": into["folders"] | made, "labels": labels}
    commit(spark, path, new)
    return new


def upsert(
    new: DataFrame, path: str, keys: list[str], order: list[Column] | None = None, buckets: int = BUCKETS, label: str | None = None, by: list[str] | None = None,
) -> int:
    """Rows of `new` by key into the table at `path`, the last row of a key kept: new before old, then the first of `order`.

    Only buckets that hold one of new's keys are read and rewritten; `buckets` and `by`, the keys that choose a bucket
    (all by default), count when the table is made. Null keys are keys.
    A write with the label (stream:number) that the stream's last write had changes nothing. Columns that the table does not
    have are refused, missing ones are null. Returns the version.
    """
    spark = new.sparkSession
    m = manifest(spark, path)
    if m is None:
        m = {"version": 0, "buckets": buckets, "keys": keys, "by": by or keys, "schema": json.loads(new.schema.json()), "folders": {}, "labels": {}}
    if m["keys"] != keys:
        raise ValueError(f"the table's keys are {m['keys']}")
    if label is not None and m["labels"].get(label.rpartition(":")[0]) == label:
        return m["version"]
    own = T.StructType.fromJson(m["schema"])
    if set(new.columns) - set(own.names):
        raise ValueError(f"the table has no {sorted(set(new.columns) - set(own.names))}")
    n = stored(new, "upsert")
    touched = placed_in(m, n)
    if not touched and m["version"]:
        return m["version"]
    old = read(spark, path, m["version"] or None, touched, own)
    rows = merged(old, n, keys, order).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in own.fields])
    return write(rows, path, m, label)["version"]


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Drop all versions but the last `keep`, and the folders that none of those has; the number of folders dropped.

    Not while a write is under way: its folder has no manifest yet.
    """
    found = versions(spark, path)
    kept = {x for v in found[-keep:] for x in manifest(spark, path, v)["folders"].values()}
    fs, at = file_system(spark, f"{path}/data")
    for v in found[:-keep]:
        fs.delete(file_system(spark, f"{path}/manifest-{v}.json")[1], False)
    gone = 0
    for w in fs.listStatus(at) if fs.exists(at) else []:
        parts = [f"data/{w.getPath().getName()}/{b.getPath().getName()}" for b in fs.listStatus(w.getPath()) if b.isDirectory()]
        for x in parts:
            if x not in kept:
                fs.delete(file_system(spark, f"{path}/{x}")[1], True)
                gone += 1
        if not any(x in kept for x in parts):
            fs.delete(w.getPath(), True)
    return gone
