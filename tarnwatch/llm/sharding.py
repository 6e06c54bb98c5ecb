"""Shards by extendible hashing.

A directory is indexed by the leading bits of a hash of doc_id. A bucket over its byte limit splits on the next bit
and no other does, until each fits. Spark sums bytes by prefix a window of bits at a time; only the rows of buckets
that are still too large at a window's end go on to the next window.
"""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnwatch.llm.common import small, stored

WINDOW, DEPTH = 12, 60


def hash_bits(doc_id: str = "doc_id"):
    """60 bits of MD5; a null doc_id hashes as the text 'null'."""
    text = F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))
    return F.conv(F.substring(F.md5(text), 1, DEPTH // 4), 16, 10).cast("long")


def directory(rows: DataFrame, limit: int) -> DataFrame:
    """rows (h, bytes) -> (depth, prefix, bytes): the leaves; one over the limit holds a single value of h.

    A window's sums come from its finest prefixes, at most 2**WINDOW for each bucket that is split in it. A
    bucket's ancestors are all over the limit, so a leaf is the shallowest prefix that fits.
    """
    leaves, rest, at = None, rows, 0
    while True:
        low = 0 if at == 0 else at + 1
        top = min(at + WINDOW, DEPTH)
        fine = rest.groupBy(F.shiftright("h", DEPTH - top).alias("fine")).agg(
            F.sum("bytes").alias("bytes"), F.min("h").alias("lo"), F.max("h").alias("hi"),
        )
        levels = fine.select("*", F.explode(F.sequence(F.lit(low), F.lit(top))).alias("depth"))
        sums = levels.groupBy("depth", F.expr(f"shiftright(fine, {top} - depth)").alias("prefix")).agg(
            F.sum("bytes").alias("bytes"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        )
        sums = stored(sums.withColumn("ends", (F.col("bytes") <= limit) | (F.col("lo") == F.col("hi"))), "shard-sums")
        # a prefix is a leaf if it fits (or no bit splits it) and its parent, where this window has it, does not
        parent = sums.select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("up"), F.col("ends").alias("parent_ends"))
        fits = sums.withColumn("up", F.shiftright("prefix", 1)).join(parent, ["depth", "up"], "left")
        leaf = fits.where(F.col("ends") & ~F.coalesce("parent_ends", F.lit(False))).select("depth", "prefix", "bytes")
        leaves = leaf if leaves is None else leaves.unionByName(leaf)
        over = sums.where((F.col("depth") == top) & ~F.col("ends")).select("prefix")
        if top == DEPTH or over.isEmpty():
            return stored(leaves, "shard-directory")
        rest = rest.join(small(over), F.shiftright("h", DEPTH - top) == F.col("prefix"), "left_semi")
        at = top


def shard(docs: DataFrame, limit: int = 1 << 20) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_bytes, depth, shard, shard_bytes.

    `shard` is the bucket's bits as text ('' for one bucket of all), with '+k' for the k-th overflow page. n_bytes
    is the text's UTF-8 size (null: 0). Rows of one doc_id share all bits; a bucket of them over the limit
    is cut into overflow pages in order of n_bytes, each of at most `limit` bytes where rows of a page allow; a
    row alone over the limit is a page of its own. An empty table gives none.
    """
    d = stored(
        docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), hash_bits().alias("h")),
        "shard-docs",
    )
    by_hash = d.groupBy("h").agg(F.sum("n_bytes").alias("bytes"))
    leaves = directory(by_hash, limit)
    leaves = leaves.withColumn("overflow", F.col("bytes") > limit)
    # a row looks into one slot of the directory: its first `top` bits. Deeper leaves lie in one slot, shallower in several,
    # at most 2**8; hashes are even, so a slot holds few leaves
    r = leaves.agg(F.min("depth").alias("least"), F.percentile_approx("depth", 0.5).alias("middle")).first()
    top = 0 if r.least is None else max(r.least, r.middle - 8)
    first = F.expr(f"if(depth <= {top}, shiftleft(prefix, {top} - depth), shiftright(prefix, depth - {top}))")
    last = F.expr(f"if(depth <= {top}, shiftleft(prefix + 1, {top} - depth) - 1, shiftright(prefix, depth - {top}))")
    slots = stored(leaves.withColumn("slot", F.explode(F.sequence(first, last))), "shard-slots")
    own = F.expr(f"shiftright(h, {DEPTH} - depth) = prefix")
    rows = d.withColumn("slot", F.shiftright("h", DEPTH - top)).join(
        small(slots).withColumnRenamed("slot", "at"), (F.col("slot") == F.col("at")) & own,
    )
    bits = F.when(F.col("depth") == 0, "").otherwise(F.expr("right(lpad(bin(prefix), 60, '0'), depth)"))
    rows = rows.select("doc_id", "n_bytes", "depth", bits.alias("shard"), F.col("bytes").alias("shard_bytes"), "overflow")
    return rows.where("not overflow").drop("overflow").unionByName(pages(rows.where("overflow").drop("overflow"), limit))


def pages(rows: DataFrame, limit: int) -> DataFrame:
    """Overflow pages of buckets that no bit splits: rows of equal size fill pages of floor(limit / size) rows.

    A page holds rows of one size, so its number needs ranks within (bucket, size) only, which are dealt by salt.
    """
    salted = rows.withColumn("salt", (F.monotonically_increasing_id() % 64).cast("int"))
    salted = stored(salted, "shard-over")
    counts = salted.groupBy("shard", "n_bytes", "salt").count()
    offsets = counts.withColumn(
        "offset",
        F.coalesce(F.sum("count").over(W.partitionBy("shard", "n_bytes").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
    ).drop("count")
    rank = F.row_number().over(W.partitionBy("shard", "n_bytes", "salt").orderBy("doc_id")) - 1
    ranked = salted.withColumn("rank", rank).join(offsets, ["shard", "n_bytes", "salt"])
    per = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.col("n_bytes"), F.lit(1)))).cast("long")
    page = F.floor((F.col("rank") + F.col("offset")) / per)
    named = ranked.withColumn("shard", F.concat("shard", F.lit("+"), F.col("n_bytes").cast("string"), F.lit("."), page.cast("string")))
    sizes = named.groupBy("shard").agg(F.sum("n_bytes").alias("own"))
    return named.join(sizes, "shard").select("doc_id", "n_bytes", "depth", "shard", F.col("own").alias("shard_bytes"))
