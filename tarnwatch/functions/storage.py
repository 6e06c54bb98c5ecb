"""Written tables in the folder that driver and executors share, to cut lineage."""

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []


def folder(spark: SparkSession, name: str) -> str:
    """A path under spark.checkpoint.dir. Where none is set a local session makes one; a cluster, whose machines would
    each write to their own disk, is refused."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = tempfile.mkdtemp(prefix="tarnwatch-")
        atexit.register(shutil.rmtree, top, True)
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{(top if '://' in top else 'file://' + top).rstrip('/')}/{name}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as a written table, until release()."""
    path = folder(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def release(spark: SparkSession) -> int:
    """Delete all tables that stored() has written so far; for when no result is left that reads them."""
    n = len(_written)
    while _written:
        remove(spark, _written.pop())
    return n
