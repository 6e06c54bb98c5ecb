"""The training-data pipeline: documents to packed batches, one operator a stage.

Every stage but the last returns the columns that it gets, whatever they are called; an empty table gives an empty one.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwatch.llm.common import small, stored, table
from tarnwatch.llm.mixing import mixed
from tarnwatch.llm.ngram_join import ngram_join
from tarnwatch.llm.packing import pack
from tarnwatch.llm.quality import keep_good
from tarnwatch.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.3. Null and empty texts hold no sentence and stay; of repeated rows all go or stay; without
    labels of both classes all stay."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more. Null and empty texts score by the model's bias alone; of repeated rows all go or
    stay; without labels of both classes all stay."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def own_ids(docs: DataFrame) -> DataFrame:
    """docs as (_row, _rid): an id for each doc_id and text: doc_id itself where only one text has it, else (and for null
    doc_ids) a number after the largest doc_id, in order of doc_id and text."""
    from pyspark.sql import Window as W

    own = docs.select("doc_id", F.md5(F.col("text").cast("binary")).alias("m"))
    d = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_id"), F.md5(F.col("text").cast("binary")).alias("_m"))
    texts = own.distinct()
    several = texts.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").select(F.col("doc_id").alias("of"))
    some = stored(
        texts.join(small(stored(several, "pipeline-several")), F.col("doc_id").eqNullSafe(F.col("of"))).select("doc_id", "m"),
        "pipeline-unlike",
    )
    if some.isEmpty():
        return d.select("_row", F.col("_id").alias("_rid"))
    top = docs.agg(F.coalesce(F.max("doc_id"), F.lit(0)).alias("top")).first().top
    # numbers by ranges of the text's hash, so that no task orders them all
    part = F.substring(F.coalesce("m", F.lit("000")), 1, 3)
    some = some.withColumn("part", part)
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = some.groupBy("part").agg(F.count("*").alias("n")).select("part", before.alias("before"))
    some = some.withColumn("k", F.row_number().over(W.partitionBy("part").orderBy("m", "doc_id"))).join(offsets, "part")
    ids = stored(
        some.select(F.col("doc_id").alias("i2"), F.col("m").alias("m2"), (F.lit(top) + F.col("before") + F.col("k")).alias("rid")),
        "pipeline-ids",
    )
    met = d.join(small(ids), F.col("_id").eqNullSafe(F.col("i2")) & F.col("_m").eqNullSafe(F.col("m2")), "left")
    return met.select("_row", F.coalesce("rid", "_id").alias("_rid"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one document: that of least doc_id.

    Rows of one doc_id and equal text are one document, of which one row stays (the least by a hash of all its columns).
    Rows of one doc_id, or of none, with unlike texts are documents of their own, after all others in a group. Null and
    empty texts are like no other text.
    """
    d = own_ids(docs)
    groups = stored(
        ngram_join(d.select(F.col("_rid").alias("doc_id"), F.col("_row.text").alias("text"))).select("doc_id", "component_id"),
        "pipeline-groups",
    )
    others = small(stored(groups.where("doc_id <> component_id").select(F.col("doc_id").alias("_rid")).distinct(), "pipeline-others"))
    again = small(
        stored(
            groups.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_rid")),
            "pipeline-again",
        )
    )
    kept = d.join(others, "_rid", "left_anti")
    once = kept.join(again, "_rid", "left_anti")
    first = kept.join(again, "_rid", "left_semi").groupBy("_rid").agg(F.min_by("_row", F.xxhash64(F.to_json("_row"))).alias("_row"))
    return once.select("_row").unionByName(first.select("_row")).select("_row.*")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, 0 to 3 times. Rows without words come as often as their source's epochs; null
    sources and doc_ids are values like others; repeated rows are rows of their own."""
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's bucket, batch and slot; null and empty texts are in bucket 0, repeated rows have slots of their own."""
    return pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mixing),
    ("packing", packing),
]

#: Two stages are trained models, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
