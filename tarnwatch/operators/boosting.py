"""Histogram gradient boosting for 0/1 labels: second-order gains, an L2 penalty, and a side for missing values that each split learns.

A level of a tree is one aggregation: rows sum their gradient and curvature by (node, feature, bin), which tasks combine before the
shuffle, so what is shuffled is at most nodes x features x bins numbers a task. Only splits and leaves come to the driver, at most
2^depth a level. NULL and NaN are missing.
"""

import math
from dataclasses import dataclass, field

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnwatch.functions.scalars import nan_to_null
from tarnwatch.functions.storage import stored


@dataclass
class Tree:
    """Nodes by number, the root 0, children 2k + 1 (left) and 2k + 2: splits (feature, edge, missing goes left, gain), leaf values."""

    splits: dict[int, tuple[str, float, bool, float]] = field(default_factory=dict)
    leaves: dict[int, float] = field(default_factory=dict)

    def walk(self, leaf, k: int = 0) -> Column:
        """A column of leaf(node) for the node that a row ends in."""
        if k not in self.splits:
            return leaf(k)
        name, edge, missing_left, _ = self.splits[k]
        x, left, right = nan_to_null(F.col(name).cast("double")), self.walk(leaf, 2 * k + 1), self.walk(leaf, 2 * k + 2)
        return F.when(x.isNull(), left if missing_left else right).when(x < edge, left).otherwise(right)


@dataclass
class Model:
    base: float
    trees: list[Tree]

    def margin(self) -> Column:
        parts = [t.walk(lambda k, t=t: F.lit(t.leaves[k])) for t in self.trees]
        return sum(parts, F.lit(self.base))

    def predict(self, df: DataFrame, name: str = "predicted_probability") -> DataFrame:
        return df.withColumn(name, 1 / (1 + F.exp(-self.margin())))


def edges(df: DataFrame, features: list[str], bins: int) -> dict[str, list[float]]:
    """At most bins + 1 values of each feature that cut it into bins of like counts, by a quantile sketch; all values where few."""
    at = F.array(*[F.lit(k / bins) for k in range(bins + 1)])
    row = df.agg(*[F.percentile_approx(nan_to_null(F.col(f).cast("double")), at, F.lit(10_000)).alias(f) for f in features]).first()
    return {f: sorted({v for v in row[f] or () if math.isfinite(v)}) for f in features}


def binned(df: DataFrame, cuts: dict[str, list[float]]) -> DataFrame:
    """df with _bin_<k> of the k-th feature of cuts: the number of edges at or below the value, one more than all if missing."""
    values = df.withColumns({f"_x_{k}": F.coalesce(F.col(f).cast("double"), F.lit(math.nan)) for k, f in enumerate(cuts)})
    n = range(len(cuts))
    b = Bucketizer(
        inputCols=[f"_x_{k}" for k in n], outputCols=[f"_bin_{k}" for k in n], handleInvalid="keep",
        splitsArray=[[-math.inf, *c, math.inf] for c in cuts.values()],
    )
    return b.transform(values).drop(*[f"_x_{k}" for k in n])


def histogram(df: DataFrame, features: int, node: Column) -> DataFrame:
    """(node, feature, bin, g, h) of rows with _g, _h and bins."""
    each = F.array(*[F.struct(F.lit(k).alias("feature"), F.col(f"_bin_{k}").cast("int").alias("bin")) for k in range(features)])
    rows = df.select(node.alias("node"), "_g", "_h", F.explode(each).alias("_e")).where("node is not null")
    return rows.groupBy("node", "_e.feature", "_e.bin").agg(F.sum("_g").alias("g"), F.sum("_h").alias("h"))


def best_splits(hist: DataFrame, missing: list[int], l2: float, least: float) -> DataFrame:
    """(node, feature, bin, missing_left, gain): each node's best split into bins below and from `bin` on.

    Children have a curvature of at least `least`. Gains equal to six places go to the first feature, the lowest bin, missing left.
    """
    w = W.partitionBy("node", "feature")
    lost = F.col("bin") == F.element_at(F.array(*[F.lit(m) for m in missing]), F.col("feature") + 1)
    none = F.lit(0.0)
    t = hist.withColumns({"_lost": lost}).withColumns(
        {f"{c}_{n}": v for c in "gh" for n, v in (
            ("all", F.sum(c).over(w)), ("lost", F.coalesce(F.sum(F.when(F.col("_lost"), F.col(c))).over(w), none)),
            ("low", F.coalesce(F.sum(F.when(~F.col("_lost"), F.col(c))).over(w.orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), none)),
        )}
    ).where("not _lost").withColumn("missing_left", F.explode(F.array(F.lit(True), F.lit(False))))
    part = lambda c: F.col(f"{c}_low") + F.when(F.col("missing_left"), F.col(f"{c}_lost")).otherwise(none)
    t = t.withColumns({"gl": part("g"), "hl": part("h")}).withColumns({"gr": F.col("g_all") - F.col("gl"), "hr": F.col("h_all") - F.col("hl")})
    t = t.where((F.col("hl") >= least) & (F.col("hr") >= least))
    score = lambda g, h: F.col(g) * F.col(g) / (F.col(h) + l2)
    t = t.withColumn("gain", score("gl", "hl") + score("gr", "hr") - score("g_all", "h_all"))
    first = W.partitionBy("node").orderBy(F.round("gain", 6).desc(), "feature", "bin", F.col("missing_left").desc())
    t = t.where("gain > 1e-6").withColumn("_r", F.row_number().over(first)).where("_r = 1")
    return t.select("node", "feature", "bin", "missing_left", "gain")


def fit(
    df: DataFrame, features: list[str], y: str = "true_label", trees: int = 100, depth: int = 3, rate: float = 0.1, l2: float = 1.0,
    bins: int = 255, least: float = 1.0, keep: int = 8,
) -> Model:
    """A model of y from features. Rows without a label are left out; a feature without values is never split on.

    Margins of the rows are written once in `keep` trees; between two writes a row's margin is an expression over its features.
    A table without labelled rows gives a model of 0.5 for everything.
    """
    rows = df.where(F.col(y).isNotNull()).select(*features, F.col(y).cast("double").alias("_y"))
    cuts = {f: c for f, c in edges(rows, features, bins).items() if c}
    mean = rows.agg(F.avg("_y").alias("m")).first().m
    if mean is None:
        return Model(0.0, [])
    p = min(max(mean, 1e-6), 1 - 1e-6)
    model = Model(math.log(p / (1 - p)), [])
    if not cuts:
        return model
    names, missing = list(cuts), [len(c) + 1 for c in cuts.values()]
    rows, fresh = stored(binned(rows, cuts).withColumn("_m", F.lit(model.base)), "boosting"), []
    for _ in range(trees):
        if len(fresh) == keep:
            rows, fresh = stored(rows.withColumn("_m", F.col("_m") + Model(0.0, fresh).margin()), "boosting"), []
        p = 1 / (1 + F.exp(-(F.col("_m") + Model(0.0, fresh).margin())))
        now = rows.withColumn("_p", p).withColumns({"_g": F.col("_p") - F.col("_y"), "_h": F.col("_p") * (1 - F.col("_p"))})
        tree = Tree()
        for level in range(depth):
            node = tree.walk(lambda k, lo=2**level - 1: F.lit(k if k >= lo else None).cast("int"))
            found = best_splits(histogram(now, len(names), node), missing, l2, least).collect()  # at most 2^level rows
            for r in found:
                f = names[r.feature]
                tree.splits[r.node] = (f, cuts[f][r.bin - 1] if r.bin else -math.inf, r.missing_left, r.gain)
            if not found:
                break
        node = tree.walk(lambda k: F.lit(k))
        sums = now.groupBy(node.alias("node")).agg(F.sum("_g").alias("g"), F.sum("_h").alias("h")).collect()  # at most 2^depth rows
        reached = {r.node: -rate * r.g / (r.h + l2) for r in sums}
        ends = {c for k in tree.splits for c in (2 * k + 1, 2 * k + 2) if c not in tree.splits} or {0}
        tree.leaves = {k: reached.get(k, 0.0) for k in ends}
        model.trees.append(tree)
        fresh.append(tree)
    return model
