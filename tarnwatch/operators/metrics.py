"""Exact classification and ranking metrics as aggregates, at any grouping."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnwatch.functions.ranges import running
from tarnwatch.functions.scalars import fraction, hours_between


def confusion(df: DataFrame, by: list[str], y: str = "true_label", p: str = "predicted_probability", threshold="threshold") -> DataFrame:
    """tp, fp, fn, tn a group; the threshold is a number or a column of its own for each row."""
    t = F.lit(threshold) if isinstance(threshold, float) else F.col(threshold)
    hit, real = F.col(p) >= t, F.col(y) == 1
    return df.groupBy(*by).agg(
        F.count_if(hit & real).alias("tp"), F.count_if(hit & ~real).alias("fp"), F.count_if(~hit & real).alias("fn"),
        F.count_if(~hit & ~real).alias("tn"),
    )


def rates(counts: DataFrame, null_if_one_class: bool = False) -> DataFrame:
    """precision, recall, F1, specificity, FPR and balanced accuracy; an empty denominator gives 0, or all NULL where
    only one class is there and null_if_one_class."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    zero = lambda a, b: F.coalesce(fraction(a, b), F.lit(0.0))
    precision, recall, specificity = zero(tp, tp + fp), zero(tp, tp + fn), zero(tn, tn + fp)
    made = {
        "precision": precision, "recall": recall, "f1": zero(2 * tp, 2 * tp + fp + fn), "specificity": specificity,
        "fpr": zero(fp, fp + tn), "balanced_accuracy": (recall + specificity) / 2,
    }
    both = (tp + fn > 0) & (fp + tn > 0) if null_if_one_class else F.lit(True)
    return counts.withColumns({n: F.when(both, c) for n, c in made.items()})


def ranking(
    df: DataFrame, by: list[str], y: str = "true_label", p: str = "predicted_probability", rows: str | None = None,
) -> DataFrame:
    """roc_auc (ties count half) and pr_auc (average precision, tied scores one step); NULL without both classes, or
    without a positive. Rows are summed by score first; running counts then go over ranges of distinct scores. rows: a column of
    how many rows each stands for."""
    n = F.col(rows) if rows else F.lit(1)
    s = df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(*by, F.col(p).alias("_s")).agg(
        F.sum(F.when(F.col(y) == 1, n).otherwise(0)).cast("long").alias("_pos"),
        F.sum(F.when(F.col(y) != 1, n).otherwise(0)).cast("long").alias("_neg"),
    )
    s = running(s, by, [F.col("_s").desc()], {"_tp": "_pos", "_fp": "_neg"})
    # pairs of a positive with a negative of lower score, ties half; all in whole halves
    won = F.sum(F.col("_neg") * (2 * (F.col("_tp") - F.col("_pos")) + F.col("_pos")))
    steps = F.sum(F.col("_pos") * fraction(F.col("_tp"), F.col("_tp") + F.col("_fp")))
    pos, neg = F.sum("_pos"), F.sum("_neg")
    return s.groupBy(*by).agg(
        F.when((pos > 0) & (neg > 0), won / (2.0 * pos * neg)).alias("roc_auc"), F.when(pos > 0, steps / pos).alias("pr_auc"),
        pos.alias("positives"), neg.alias("negatives"),
    )


def event_recall(
    df: DataFrame, by: list[str], event: str = "matched_event_id", y: str = "true_label", hit: str = "predicted_class",
) -> DataFrame:
    """Share of events with at least one alarm among their positive rows."""
    e = df.where((F.col(y) == 1) & F.col(event).isNotNull()).groupBy(*by, event).agg(F.bool_or(F.col(hit) == 1).alias("_found"))
    return e.groupBy(*by).agg(
        F.count("*").alias("events"), F.count_if("_found").alias("detected"), F.avg(F.col("_found").cast("int")).alias("event_recall"),
    )


def alerts(
    df: DataFrame, event: str = "matched_event_id", at: str = "event_ts", ts: str = "reference_timestamp", y: str = "true_label",
    hit: str = "predicted_class",
) -> DataFrame:
    """Per event its first alarm, whole days of lead, and YES, NO or NO_USABLE_POSITIVE_ROWS."""
    alarm = (F.col(y) == 1) & (F.col(hit) == 1)
    e = df.where(F.col(event).isNotNull()).groupBy(event).agg(
        F.min(F.when(alarm, F.col(ts))).alias("first_alert"), F.max(at).alias("at"), F.count_if(F.col(y) == 1).alias("positive_rows"),
        F.count_if((F.col(y) == 0) & (F.col(hit) == 1)).alias("false_alerts"),
    )
    status = F.when(F.col("positive_rows") == 0, "NO_USABLE_POSITIVE_ROWS").when(F.col("first_alert").isNotNull(), "YES").otherwise("NO")
    return e.select(
        event, "first_alert", F.floor(hours_between("at", "first_alert") / 24).cast("long").alias("lead_time_days"),
        status.alias("detected"), "positive_rows", "false_alerts",
    )


def threshold_sweep(
    df: DataFrame, by: list[str], thresholds=(0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8), y: str = "true_label",
    p: str = "predicted_probability",
) -> DataFrame:
    """The threshold of the largest F1, the lowest of equals. One scan counts for all thresholds."""
    t = df.withColumn("threshold", F.explode(F.array(*[F.lit(x) for x in thresholds])))
    f = rates(confusion(t, [*by, "threshold"], y, p))
    w = W.partitionBy(*by).orderBy(F.round("f1", 12).desc(), "threshold")
    return f.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(*by, "threshold", "f1")


def best(df: DataFrame, by: list[str], order: list) -> DataFrame:
    """The whole row that comes first in the order, a group."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where("_r = 1").drop("_r")


def best_configuration(
    results: DataFrame, by: str = "horizon_days", config: str = "model_name", pr: float = 0.15, f1: float = 0.1,
) -> DataFrame:
    """Per horizon the configuration of the largest pr_auc (ties by name) and whether it passes both gates."""
    return best(results, [by], [F.col("pr_auc").desc_nulls_last(), F.col(config)]).withColumn(
        "accepted", F.coalesce((F.col("pr_auc") > pr) & (F.col("f1") > f1), F.lit(False)),
    )


def fold_and_pooled(df: DataFrame, keys: list[str], fold: str, y: str = "true_label", hit: str = "predicted_class") -> DataFrame:
    """Counts for each fold and pooled (fold NULL), in one pass."""
    real, said = F.col(y) == 1, F.col(hit) == 1
    g = df.groupingSets([[*[F.col(k) for k in keys], F.col(fold)], [F.col(k) for k in keys]], *keys, fold)
    return g.agg(
        F.count("*").alias("n"), F.count_if(said & real).alias("tp"), F.count_if(said & ~real).alias("fp"),
        F.count_if(~said & real).alias("fn"), F.count_if(~said & ~real).alias("tn"),
    )


def balanced_mean(df: DataFrame, by: list[str], unit: str, p: str = "predicted_probability", y: str = "true_label") -> DataFrame:
    """One mean score a unit, so that units with many rows weigh no more."""
    return df.groupBy(*by, unit).agg(F.avg(p).alias(p), F.max(y).alias(y))
