"""Bucketed tables: what an upsert rewrites, what a crash leaves, old versions, writers that meet."""

import os

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.sql import functions as F

from tarnwatch.operators import buckets


def files(top):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(top) for f in names if f.endswith(".parquet")}


def table(spark, path, n=4000):
    rows = spark.range(n).select("id", (F.col("id") * 2).alias("v"), F.lit("old").alias("w"))
    buckets.upsert(rows, path, ["id"], buckets=16)
    return rows


def test_an_upsert_rewrites_the_buckets_of_its_keys(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    rows = table(spark, path)
    before = files(tmp_path)
    one = rows.where(buckets.bucket(["id"], 16) == 3).limit(40).withColumn("w", F.lit("new"))
    assert buckets.upsert(one, path, ["id"]) == 2
    after = files(tmp_path)
    assert all(after[f] == t for f, t in before.items())
    assert {f.split("_bucket=")[1].split("/")[0] for f in after.keys() - before.keys()} == {"3"}
    out = buckets.read(spark, path)
    assert out.count() == 4000 and out.where("w = 'new'").count() == 40
    assert buckets.read(spark, path, 1).where("w = 'new'").isEmpty()
    read = {r.f for r in buckets.read(spark, path, only=[3]).select(F.input_file_name().alias("f")).distinct().collect()}
    assert all("_bucket=3" in f for f in read)


@pytest.mark.parametrize("step", ["stored", "commit"])
def test_a_crash_between_steps_leaves_the_old_version(spark, tmp_path, monkeypatch, step):
    path = f"file://{tmp_path}/t"
    rows = table(spark, path, 300)

    def crash(*a, **b):
        raise RuntimeError("crash")

    with monkeypatch.context() as m:
        m.setattr(buckets, step, crash)
        with pytest.raises(RuntimeError):
            buckets.upsert(rows.withColumn("w", F.lit("new")), path, ["id"])
    assert buckets.versions(spark, path) == [1] and buckets.read(spark, path).where("w = 'new'").isEmpty()
    assert buckets.upsert(rows.withColumn("w", F.lit("new")), path, ["id"]) == 2
    assert buckets.read(spark, path).where("w = 'new'").count() == 300
    assert buckets.vacuum(spark, path) >= 16 and buckets.versions(spark, path) == [2]
    assert buckets.read(spark, path).count() == 300


def test_two_writers_of_one_version(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    table(spark, path, 100)
    m = buckets.manifest(spark, path)
    buckets.commit(spark, path, m | {"version": 2})
    with pytest.raises(Py4JJavaError, match="exist"):
        buckets.commit(spark, path, m | {"version": 2, "folders": {}})
    assert buckets.read(spark, path).count() == 100


def test_repeats_nulls_and_odd_columns(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    rows = [(1, "a", 1), (1, "b", 2), (None, "c", 3), (None, "d", 4), (2, None, None)]
    df = spark.createDataFrame(rows, "k long, v string, n long")
    buckets.upsert(df, path, ["k"], [F.col("n").desc_nulls_last()], 4, "s:0")
    assert buckets.upsert(df.withColumn("v", F.lit("again")), path, ["k"], None, 4, "s:0") == 1
    assert sorted(((r.k, r.v) for r in buckets.read(spark, path).collect()), key=str) == sorted([(1, "b"), (None, "d"), (2, None)], key=str)
    assert buckets.upsert(df.select("k").where("k = 2"), path, ["k"]) == 2
    assert buckets.upsert(df.where("false"), path, ["k"]) == 2
    with pytest.raises(ValueError, match="no"):
        buckets.upsert(df.withColumn("x", F.lit(1)), path, ["k"])
    with pytest.raises(ValueError, match="keys"):
        buckets.upsert(df, path, ["v"])
    empty = f"file://{tmp_path}/e"
    assert buckets.read(spark, empty, schema=df.schema).count() == 0
    assert buckets.upsert(df.where("false"), empty, ["k"]) == 1 and buckets.read(spark, empty).count() == 0
