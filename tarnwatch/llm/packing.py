"""Packing into length buckets that are optimal for the corpus.

Spark counts a global histogram of lengths; dynamic programming over it picks the bucket boundaries of least padding;
inside a bucket, batches are runs of documents whose padded size fits the token budget.
"""

from array import array
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnwatch.llm.common import drop, stored
from tarnwatch.llm.mixing import n_words

#: Ranges of a bucket's order, by the leading bits of its hash: no task sorts a bucket.
CHUNK_BITS = 11


def boundaries(edges, counts, buckets: int) -> list[int]:
    """At most `buckets` of the sorted edges, the last included, that minimise sum(count * (boundary - edge))."""
    edges = [int(e) for e in edges]
    n, total = len(edges), [0, *accumulate(int(c) for c in counts)]
    if not n:
        return []
    best, froms = [e * t for e, t in zip(edges, total[1:], strict=True)], [array("q", [0]) * n]
    for _ in range(min(buckets, n) - 1):
        # best[j]: cost of bins 0..j; a last bucket i..j pads its rows to edges[j]. Row sums of lengths are constant.
        # The least of cost[i] + edges[j] * (total[j + 1] - total[i]) is on the lower hull of lines in edges[j].
        cost, hull, at, now, where = [0, *best], [], 0, [], array("q")
        for j, e in enumerate(edges):
            while len(hull) > 1 and (cost[j] - cost[hull[-2]]) * (total[hull[-1]] - total[hull[-2]]) <= (cost[hull[-1]] - cost[hull[-2]]) * (total[j] - total[hull[-2]]):
                hull.pop()
            hull.append(j)
            at = min(at, len(hull) - 1)
            while at + 1 < len(hull) and cost[hull[at + 1]] - e * total[hull[at + 1]] <= cost[hull[at]] - e * total[hull[at]]:
                at += 1
            where.append(hull[at])
            now.append(cost[hull[at]] + e * (total[j + 1] - total[hull[at]]))
        best, froms = now, [*froms, where]
    out, j = [], n - 1
    for i in reversed(froms):
        out.append(edges[j])
        j = i[j] - 1
        if j < 0:
            break
    return out[::-1]


def histogram(d: DataFrame) -> tuple:
    """(lengths, rows of each), in order of length. A corpus of t tokens has at most sqrt(2 t) different lengths, 100 TB of
    text about 6 million: two arrays of numbers on the driver."""
    t = d.groupBy("n_tokens").count().toArrow()
    order = t.column("n_tokens").to_numpy().argsort()
    return t.column("n_tokens").to_numpy()[order], t.column("count").to_numpy()[order]


def pack(docs: DataFrame, length: Column | None = None, buckets: int = 16, token_budget: int = 16384) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_tokens, bucket, padded, batch, slot.

    `bucket` is the padded length; a batch holds floor(token_budget / bucket) documents, at least 1, so only a
    document longer than the budget makes a batch beyond it. Documents of no tokens are in bucket 0 and in batches
    of token_budget rows. Inside a bucket the order is a hash of doc_id, then doc_id and length; repeated rows are
    rows of their own. An empty table gives none. Rows of equal doc_id and length are counted first and dealt their slots
    from the count, so that a doc_id that many rows share is no task's sort.
    """
    n = n_words() if length is None else F.coalesce(length.cast("long"), F.lit(0))
    every = d = stored(docs.select("doc_id", n.alias("n_tokens")), "pack-docs")
    lengths, counts = histogram(d)
    some = lengths > 0
    bounds = [0] * bool((~some).any()) + boundaries(lengths[some].tolist(), counts[some].tolist(), buckets)
    if not bounds:
        bounds = [0]
    pick = F.lit(bounds[-1])
    for b in reversed(bounds[:-1]):
        pick = F.when(F.col("n_tokens") <= b, b).otherwise(pick)
    h = F.xxhash64("doc_id")
    d = d.groupBy("doc_id", "n_tokens").agg(F.count("*").alias("rows"))
    d = d.withColumns({"bucket": pick.cast("long"), "h": h, "chunk": F.shiftright(h, 64 - CHUNK_BITS).cast("int")})
    d = stored(d, "pack-rows")
    drop(every)
    sizes = d.groupBy("bucket", "chunk").agg(F.sum("rows").alias("rows"))
    offsets = sizes.select(
        "bucket", "chunk",
        F.coalesce(
            F.sum("rows").over(W.partitionBy("bucket").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0),
        ).alias("offset"),
    )
    before = F.sum("rows").over(
        W.partitionBy("bucket", "chunk").orderBy("h", "doc_id", "n_tokens").rowsBetween(W.unboundedPreceding, 0)
    ) - F.col("rows")
    d = d.withColumn("before", before).join(offsets, ["bucket", "chunk"]).withColumn("first", F.col("offset") + F.col("before"))
    d = d.select("doc_id", "n_tokens", "bucket", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("rows") - 1)).alias("rank"))
    per = F.greatest(F.lit(1), F.floor(token_budget / F.greatest(F.col("bucket"), F.lit(1)))).cast("long")
    return d.select(
        "doc_id", "n_tokens", "bucket", (F.col("bucket") - F.col("n_tokens")).alias("padded"), F.floor(F.col("rank") / per).alias("batch"),
        (F.col("rank") % per).alias("slot"),
    )
