"""What the operators share: files in the cluster's shared folder, bounded broadcasts, connected components."""

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

_stored: list[str] = []
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none a local session makes one; a cluster, whose
    machines would each write to their own disk, is refused."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="tarnwatch-")
        atexit.register(shutil.rmtree, path, True)
        spark.conf.set("spark.checkpoint.dir", path)
    return path if "://" in path else f"file://{path}"


def fresh(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as a written table: a lost executor then costs a reread, not the lineage."""
    spark = df.sparkSession
    path = fresh(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    _stored.append(path)
    return out


def release(spark: SparkSession) -> int:
    """Delete all that stored() has written and drop() has not; for when no result is left that reads it."""
    n = len(_stored)
    while _stored:
        remove(spark, _stored[-1])
    return n


def drop(df: DataFrame) -> None:
    """Delete a stored() table that no later plan reads."""
    remove(df.sparkSession, df._stored_at)


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
    if path in _stored:
        _stored.remove(path)


#: Bytes that a broadcast may hold, as rows in memory.
BROADCAST = 32 << 20
FIXED = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def small(df: DataFrame, most: int = BROADCAST) -> DataFrame:
    """A stored table with a broadcast hint if its rows take at most so many bytes; else as it is, for a shuffled join.

    A row counts 16 bytes and 8 a column, and the columns of no fixed size what they hold.
    """
    loose = [f.name for f in df.schema.fields if not isinstance(f.dataType, FIXED)]
    held = F.sum(F.octet_length(F.to_json(F.struct(*loose)))) if loose else F.lit(0)
    r = df.agg(F.count("*").alias("rows"), F.coalesce(held, F.lit(0)).alias("bytes")).first()
    return F.broadcast(df) if r.rows * (16 + 8 * len(df.columns)) + r.bytes <= most else df


def tasks_for(spark: SparkSession, size: int, least: int = 4 << 20, most: int = 128 << 20) -> int:
    """How many tasks for so many bytes: up to three for each core as long as they hold `least`, and no more than `most` a task."""
    waves = 3 * spark.sparkContext.defaultParallelism
    return max(1, min(-(-size // least), waves), -(-size // most))


def held_out(doc_id: str = "doc_id"):
    """The rows whose labels no model may see."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def connected_components(edges: DataFrame) -> DataFrame:
    """(src, dst) -> (id, root): the smallest id that links reach, for ids with at least one link.

    Alternates large-star and small-star steps, each written to the shared folder, until a round changes
    nothing. A hub's links are joined, not gathered, so adaptive execution can split them. Self-links and nulls
    count for nothing.
    """
    e = stored(
        edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(),
        "cc",
    )
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        near = large.join(low, "u")
        star = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        after = stored(star.where("u <> v").distinct(), "cc")
        same = digest(after) == digest(e)
        drop(e)
        e = after
        if same:
            break
    return e.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()
    )


def digest(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


#: Rows whose texts a worker holds as Python objects at a time.
SLICE = 1024


def slices(batches):
    for b in batches:
        for at in range(0, b.num_rows, SLICE):
            yield b.slice(at, SLICE)
    give_back()


def give_back() -> None:
    """Give freed memory back to the system: a Python worker outlives its task."""
    import ctypes

    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def with_columns(df: DataFrame, column: str, fn, ddl: str, keep_column: bool = False) -> DataFrame:
    """Add fn(values of `column`) -> one list or array for each field of ddl; other columns pass as they are."""
    new = T.StructType.fromDDL(ddl)
    rest = [f for f in df.schema.fields if keep_column or f.name != column]
    types = [to_arrow_type(f.dataType) for f in new.fields]

    def run(batches):
        import pyarrow as pa

        for b in slices(batches):
            made = fn(b.column(b.schema.get_field_index(column)).to_pylist())
            own = [b.column(b.schema.get_field_index(f.name)) for f in rest]
            yield pa.RecordBatch.from_arrays(
                [*own, *(pa.array(x, t) for x, t in zip(made, types, strict=True))],
                names=[f.name for f in rest] + [f.name for f in new.fields],
            )

    return df.mapInArrow(run, T.StructType([*rest, *new.fields]))


def where_values(df: DataFrame, column: str, fn) -> DataFrame:
    """The rows for which fn(values of `column`) is true, all columns kept."""

    def run(batches):
        import pyarrow as pa

        for b in slices(batches):
            yield b.filter(pa.array(fn(b.column(b.schema.get_field_index(column)).to_pylist()), pa.bool_()))

    return df.mapInArrow(run, df.schema)
