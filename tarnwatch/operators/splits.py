"""Cross-validation splits as columns, and the guards that groups do not leak."""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def group_folds(df: DataFrame, group: str = "lake_uid", y: str = "event_within_horizon", event: str = "matched_event_id") -> DataFrame:
    """(fold, split_name): a fold a group with a positive; the name is the group's first event."""
    return df.where((F.col(y) == 1) & F.col(group).isNotNull()).groupBy(F.col(group).alias("fold")).agg(F.min(event).alias("split_name"))


def fold(df: DataFrame, name, group: str = "lake_uid") -> DataFrame:
    """df plus is_test for one fold: its rows are tested, all others train. A row without a group trains."""
    return df.withColumn("is_test", F.coalesce(F.col(group) == F.lit(name), F.lit(False)))


def fold_sizes(df: DataFrame, folds: DataFrame, group: str = "lake_uid") -> DataFrame:
    """(fold, split_name, is_test, rows) of all folds, from one count a group: rows are never repeated once a fold."""
    sizes = df.groupBy(F.col(group).alias("fold")).agg(F.count("*").alias("own"))
    every = sizes.agg(F.sum("own").alias("every"))
    both = folds.join(sizes, "fold").join(F.broadcast(every), how="cross")
    rest = F.struct(F.lit(False).alias("is_test"), (F.col("every") - F.col("own")).alias("rows"))
    out = both.select("fold", "split_name", F.inline(F.array(F.struct(F.lit(True).alias("is_test"), F.col("own").alias("rows")), rest)))
    return out.where("rows > 0")


def chronological(df: DataFrame, ts: str = "reference_timestamp", last_train_year: int = 2005) -> DataFrame:
    """(is_test) by year; no rows if a side is empty."""
    d = df.where(F.col(ts).isNotNull()).withColumn("is_test", F.year(ts) > last_train_year)
    sides = d.agg(F.min("is_test").alias("lo"), F.max("is_test").alias("hi"))
    return d.join(sides.where("lo <> hi"), how="cross").drop("lo", "hi")


def regions(df: DataFrame, region: str) -> DataFrame:
    """Leave one region out."""
    folds = df.select(F.col(region).alias("fold")).where("fold is not null").distinct()
    return df.join(folds, how="cross").withColumn("is_test", F.col(region) == F.col("fold"))


def assign_groups(groups: list[tuple], folds: int) -> dict:
    """group -> fold: groups in falling spread of their class counts, each to the fold that keeps the share of every
    class in the folds most even, then to the fold of fewer rows."""
    total = np.sum([c for _, c in groups], axis=0, dtype=float)
    state, out = np.zeros((folds, len(total))), {}
    for name, counts in sorted(groups, key=lambda g: (-np.std(g[1]), str(g[0]))):
        def cost(f, counts=counts):
            s = state.copy()
            s[f] += counts
            return round(float(np.mean(np.std(s / np.maximum(total, 1), axis=0))), 12), s[f].sum()

        f = min(range(folds), key=cost)
        state[f] += counts
        out[name] = f
    return out


def stratified_groups(
    df: DataFrame, group: str = "lake_uid", y: str = "event_within_horizon", folds: int = 3, most_groups: int = 1_000_000,
) -> DataFrame | None:
    """fold for each row; 2 folds for two positive groups, None for fewer. Only a count a group reaches the driver."""
    counts = df.groupBy(group).agg(F.count_if(F.col(y) != 1).alias("neg"), F.count_if(F.col(y) == 1).alias("pos"))
    rows = counts.limit(most_groups + 1).collect()
    if len(rows) > most_groups:
        raise ValueError(f"more than {most_groups} groups: split by hash instead")
    positive = sum(r.pos > 0 for r in rows)
    if positive < 2:
        return None
    of = assign_groups([(r[group], (r.neg, r.pos)) for r in rows], min(folds, positive) if positive < folds else folds)
    table = df.sparkSession.createDataFrame(
        [(g, f) for g, f in of.items()], T.StructType([*df.select(group).schema.fields, T.StructField("fold", T.IntegerType())]),
    )
    return df.join(table, group)


def group_integrity(df: DataFrame, group: str = "lake_uid", y: str = "event_within_horizon") -> DataFrame:
    """Groups, those with a positive, those without, and rows without a group."""
    g = df.groupBy(group).agg(F.count("*").alias("n"), F.count_if(F.col(y) == 1).alias("pos"))
    known = F.col(group).isNotNull()
    return g.agg(
        F.count_if(known).alias("groups"), F.count_if(known & (F.col("pos") > 0)).alias("positive_groups"),
        F.count_if(known & (F.col("pos") == 0)).alias("negative_only_groups"),
        F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("null_group_rows"),
    )


def disjoint(a: DataFrame, b: DataFrame, group: str) -> bool:
    return a.select(group).intersect(b.select(group)).isEmpty()


def sample_weights(df: DataFrame, group: str = "lake_uid", y: str = "true_label") -> DataFrame:
    """Every group weighs the same, then every class does; the mean weight is 1."""
    w = 1.0 / F.count("*").over(W.partitionBy(group))
    d = df.withColumn("_w", w)
    sums = d.groupBy(y).agg(F.sum("_w").alias("_of_class"))
    totals = d.agg(F.count("*").alias("_n"), F.countDistinct(y).alias("_k"))
    return d.join(F.broadcast(sums), y).join(F.broadcast(totals), how="cross").withColumn(
        "weight", F.col("_w") * F.col("_n") / (F.col("_k") * F.col("_of_class")),
    ).drop("_w", "_of_class", "_n", "_k")
