"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

A source's target decides how many complete epochs it gives; the rest of the target is a sample without replacement:
each document draws an exponential key, divided by its quality weight, and the smallest keys are taken until their
sizes reach the budget. The key comes from a hash of doc_id, so reruns agree.

A source's sorted order is never made whole: sizes are summed by narrow key ranges, the running sum shows the one range in
which the budget ends, and only that range's rows are sorted. The row found there is the source's edge, and every row
compares its own place in the order with it.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnwatch.llm.common import WORD, small, stored

REPEATS = 3
#: Key ranges to a doubling of the key. An exponential key of any rate falls in a given one with a probability of at most
#: log(2) / e / RANGES, so that whatever the weights are no range holds more than about 1 in 4,000 of a source's rows.
RANGES = 1024


def n_words(text="text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text="text") -> Column:
    """Words over words and ASCII punctuation marks: prose about 0.85, symbol junk about 0.25; 1 without words."""
    marks = F.coalesce(F.regexp_count(F.col(text), F.lit(r"[!-/:-@\[-`{-~]")), F.lit(0))
    return F.when(n_words(text) > 0, n_words(text) / (n_words(text) + marks)).otherwise(F.lit(1.0))


def uniform(doc_id="doc_id") -> Column:
    """In (0, 1), from 52 bits of MD5; a null doc_id draws as the text 'null'."""
    text = F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size) -> + target.

    Sources by code point, null last, weigh 1, 2, 3, repeating. Sharing the excess of capped sources by weight again
    and again ends at min(cap, level x weight); with sources in order of cap per weight the level is closed-form.
    The rows are one a source, so the windows over all of them hold sources, never documents.
    """
    by_name = W.orderBy(F.col("source").isNull(), F.col("source"))
    all_rows = W.partitionBy(F.lit(1))
    s = sizes.withColumn("w", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("long")).withColumn("cap", REPEATS * F.col("source_size"))
    order = W.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source"))
    before = order.rowsBetween(W.unboundedPreceding, -1)
    s = s.withColumns(
        {
            "total": F.sum("source_size").over(all_rows), "done": F.coalesce(F.sum("cap").over(before), F.lit(0)),
            "left": F.sum("w").over(order.rowsBetween(0, W.unboundedFollowing)),
        }
    )
    # capped: its cap is at most its share of what the sources before it leave
    s = s.withColumn("capped", F.col("cap") / F.col("w") <= (F.col("total") - F.col("done")) / F.col("left"))
    s = s.withColumns(
        {
            "spent": F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(all_rows), F.lit(0)),
            "open": F.sum(F.when(~F.col("capped"), F.col("w"))).over(all_rows),
        }
    )
    share = ((F.col("total") - F.col("spent")) * F.col("w")).cast("double") / F.col("open").cast("double")
    return s.select("source", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def keyed(docs: DataFrame, weight: Column | None, **more: Column) -> DataFrame:
    """source, doc_id, size, key, cut (the key's range) and h (a hash that tells rows of one doc_id apart)."""
    weight = quality_weight() if weight is None else weight
    key = -F.log(uniform()) / F.greatest(weight, F.lit(1e-6))
    cut = F.floor(F.log2("_key") * RANGES).cast("int")
    d = docs.select(
        F.col("source").alias("_source"), F.col("doc_id").alias("_doc_id"), n_words().alias("_size"), key.alias("_key"),
        F.xxhash64("text").alias("_h"), *[c.alias(n) for n, c in more.items()],
    )
    return d.withColumn("_cut", cut)


PLACE = ("_key", "_doc_id", "_size", "_h")


def edges(d: DataFrame) -> DataFrame:
    """keyed rows -> a row a source: source_size, target, epochs, and the sample's edge: the range (edge_cut) in which the
    budget ends, and the last row of it that is taken (edge, NULL if none is; of its equal rows edge_rows, and edge_split says whether that leaves some out).

    What comes before the range is taken, what comes after is not. The row at which the running size passes the budget is
    taken if that ends nearer the budget. Equal rows are summed before they are sorted.
    """
    s = stored(targets(d.groupBy(F.col("_source").alias("source")).agg(F.sum("_size").alias("source_size"))), "mix-sources")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    s = s.withColumn("epochs", epochs).withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size"))
    sums = d.where("_size > 0").groupBy("_source", "_cut").agg(F.sum("_size").alias("n"))
    upto = F.sum("n").over(W.partitionBy("_source").orderBy("_cut").rowsBetween(W.unboundedPreceding, 0))
    found = sums.withColumn("upto", upto).join(s, F.col("_source").eqNullSafe(F.col("source")))
    found = found.withColumn("before", F.col("upto") - F.col("n")).where(
        (F.col("before") < F.col("budget")) & (F.col("budget") <= F.col("upto"))
    )
    found = stored(found.select("_source", "_cut", "before", "budget"), "mix-edge-ranges")
    at = found.select(F.col("_source").alias("s2"), F.col("_cut").alias("c2"), "before", "budget")
    rows = d.where("_size > 0").join(small(at), F.col("_source").eqNullSafe(F.col("s2")) & (F.col("_cut") == F.col("c2")))
    rows = rows.groupBy("_source", "before", "budget", *PLACE).agg(F.count("*").alias("n"))
    run = W.partitionBy("_source").orderBy(*PLACE).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("first", F.col("before") + F.sum(F.col("n") * F.col("_size")).over(run) - F.col("n") * F.col("_size"))
    # of n equal rows the whole ones that fit, and one more if it ends nearer
    left = F.col("budget") - F.col("first")
    fit = F.floor(left / F.col("_size"))
    taken = F.least(F.col("n"), fit + F.when(left - fit * F.col("_size") > (fit + 1) * F.col("_size") - left, 1).otherwise(0)).cast("long")
    last = rows.withColumn("taken", F.when(left > 0, taken).otherwise(0)).where("taken > 0")
    last = last.groupBy("_source").agg(F.max(F.struct(F.struct(*PLACE).alias("place"), "taken", (F.col("taken") < F.col("n")).alias("split"))).alias("last"))
    edge = found.select(F.col("_source").alias("s2"), F.col("_cut").alias("edge_cut")).join(
        last.select(F.col("_source").alias("s3"), "last"), F.col("s2").eqNullSafe(F.col("s3")), "left",
    )
    out = s.join(edge, F.col("source").eqNullSafe(F.col("s2")), "left")
    # a budget that no range reaches for the last bits of its sum takes all
    cut = F.coalesce("edge_cut", F.when(F.col("budget") > 0, F.lit(2**31 - 1)))
    return stored(
        out.select(
            F.col("source").alias("_of"), "source_size", "target", "epochs", cut.alias("edge_cut"), F.col("last.place").alias("edge"),
            F.coalesce("last.taken", F.lit(0)).alias("edge_rows"), F.coalesce("last.split", F.lit(False)).alias("edge_split"),
        ),
        "mix-edges",
    )


def placed(d: DataFrame, ends: DataFrame) -> DataFrame:
    """keyed rows with their source's edges(), taken (0 or 1 of the sample; NULL for rows equal to an edge of which only some
    are taken)."""
    d = d.join(small(ends), F.col("_source").eqNullSafe(F.col("_of")))
    place = F.struct(*PLACE)
    inside = (F.col("_cut") < F.col("edge_cut")) | ((F.col("_cut") == F.col("edge_cut")) & F.coalesce(place <= F.col("edge"), F.lit(False)))
    at = (F.col("_size") > 0) & F.col("edge_split") & place.eqNullSafe(F.col("edge"))
    return d.withColumn("_taken", F.when(~at, F.when((F.col("_size") > 0) & F.coalesce(inside, F.lit(False)), 1).otherwise(0)))


def mix(docs: DataFrame, weight: Column | None = None) -> DataFrame:
    """docs (doc_id, text, source, ...) -> doc_id, size, source, source_size, target, copies, taken.

    `copies` complete epochs plus 0 or 1 for the sample; taken = copies x size. Documents of no words are taken as often as
    the epochs say and count nothing. Equal keys go by doc_id, then size and text; repeated rows are rows of their own.
    A null doc_id draws as the text 'null', a null source is a source. An empty table gives none.
    """
    d = stored(keyed(docs, weight), "mix-docs")
    d = placed(d, edges(d))
    kept = ["_doc_id", "_size", "_source", "source_size", "target", "epochs"]
    most = d.where("_taken is not null").select(*kept, "_taken")
    # of the rows equal to an edge the first edge_rows are taken; being equal, any are the first
    few = d.where("_taken is null").groupBy(*kept, "edge_rows").agg(F.count("*").alias("n"))
    few = few.select(
        *kept, "edge_rows", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("i"),
    ).select(*kept, (F.col("i") <= F.col("edge_rows")).cast("int").alias("_taken"))
    out = most.unionByName(few).withColumn("copies", (F.col("epochs") + F.col("_taken")).cast("long"))
    return out.select(
        F.col("_doc_id").alias("doc_id"), F.col("_size").alias("size"), F.col("_source").alias("source"), "source_size", "target", "copies",
        (F.col("copies") * F.col("_size")).alias("taken"),
    )


def mixed(docs: DataFrame, weight: Column | None = None) -> DataFrame:
    """docs with all their columns, each row as often as mix() takes it (0 or more times).

    Only sums and edges are shuffled; texts are not, but for rows that equal an edge and repeat.
    """
    ends = edges(stored(keyed(docs, weight), "mix-docs"))
    d = placed(keyed(docs, weight, _row=F.struct("*")), ends)
    times = lambda n: F.explode(F.sequence(F.lit(1).cast("long"), n)).alias("_i")
    out = d.withColumn("_n", F.col("epochs") + F.coalesce("_taken", F.lit(0))).where("_n > 0").select("_row", times(F.col("_n")))
    if not ends.where("edge_split").isEmpty():
        # of rows that equal a split edge edge_rows come once more, in order of all they hold
        at = d.where("_taken is null").withColumn("_c", F.xxhash64(F.to_json("_row")))
        one = at.groupBy("_source", "edge_rows", "_c").agg(F.first("_row").alias("_row"), F.count("*").alias("_n"))
        before = F.coalesce(F.sum("_n").over(W.partitionBy("_source").orderBy("_c").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        one = one.withColumn("_n", F.least(F.col("_n"), F.col("edge_rows") - before)).where("_n > 0")
        out = out.unionByName(one.select("_row", times(F.col("_n"))))
    return out.select("_row.*")
