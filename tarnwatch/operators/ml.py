"""A thin learning layer over pyspark.ml: imputation, scaling, models, oversampling, importance, domain classifiers."""

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnwatch.functions.ranges import percentiles
from tarnwatch.functions.storage import stored
from tarnwatch.operators.metrics import balanced_mean, ranking
from tarnwatch.operators.shift import long, present_columns


ROWS = "_rows"  # of counted(): how many rows are equal
MANY = 1_000_000  # rows from which counted() looks whether they differ
SHARE = 64  # one row in so many gives Newton's steps a start; they end on all rows
RANGES = 256  # of a model's scores, each ranked by a task


def counted(df: DataFrame, by: list[str], features: list[str], y: str = "true_label") -> DataFrame:
    """(by, y, features, _rows): rows that a model cannot tell apart, counted once, as a written table.

    A fit over counts as weights is the fit over the rows, and each of its passes reads different rows only. Where nearly all of many
    rows differ, by estimate, counting would shuffle all to save little: each is then written with a count of 1.
    """
    df = df.select(*by, y, *[F.col(c).cast("double").alias(c) for c in features])
    some = df.select(F.xxhash64(*df.columns).alias("h")).where("h % 16 = 0")  # all copies of a row or none
    n = some.agg(F.count("*").alias("rows"), F.approx_count_distinct("h", 0.01).alias("different")).first()
    if 16 * n.rows > MANY and n.different > 0.85 * n.rows:
        return stored(df.withColumn(ROWS, F.lit(1).cast("long")), "counted")
    return stored(df.groupBy(*df.columns).agg(F.count("*").alias(ROWS)), "counted")


def impute_values(train: DataFrame, features: list[str], how: str = "median", rows: str | None = None) -> dict[str, float]:
    """Exact medians (or means) of the training rows; 0 for a feature without a value. rows: as in percentiles(), for medians."""
    if how == "median":
        middle = percentiles(long(train, [rows] if rows else [], features), ["feature"], "value", [0.5], rows)
        found = {r.feature: r.q[0] for r in middle.collect()}
    else:
        found = train.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in features]).first().asDict()
    return {c: found[c] if found.get(c) is not None else 0.0 for c in features}


def impute(df: DataFrame, values: dict[str, float]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(v)) for c, v in values.items()})


def weighted_means(df: DataFrame, values: dict, rows: str) -> dict[str, float | None]:
    """Means of columns by name, each row counted `rows` times."""
    there = lambda c: F.sum(F.when(c.isNotNull(), F.col(rows)))
    return df.agg(*[(F.sum(c * F.col(rows)) / there(c)).alias(n) for n, c in values.items()]).first().asDict()


def scale_values(train: DataFrame, features: list[str], rows: str | None = None) -> dict[str, tuple[float, float]]:
    """(mean, population deviation) of the training rows; a constant feature keeps its scale."""
    if rows:
        m = weighted_means(train, {c: F.col(c) for c in features}, rows)
        v = weighted_means(train, {c: F.pow(F.col(c) - F.lit(m[c]), 2) for c in features}, rows)
        return {c: (m[c] or 0.0, (v[c] or 0.0) ** 0.5 or 1.0) for c in features}
    row = train.agg(*[F.avg(c).alias(f"m_{c}") for c in features], *[F.stddev_pop(c).alias(f"s_{c}") for c in features]).first()
    return {c: (row[f"m_{c}"] or 0.0, row[f"s_{c}"] or 1.0) for c in features}


def standardise(df: DataFrame, values: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - m) / s for c, (m, s) in values.items()})


def class_weights(df: DataFrame, y: str, rows: str | None = None) -> DataFrame:
    """balanced weights: rows / (classes * rows of the class)."""
    g = df.groupBy(y).agg((F.sum(rows) if rows else F.count("*")).alias("_n"))
    t = g.agg(F.sum("_n").alias("_all"), F.count("*").alias("_k"))
    return df.join(F.broadcast(g), y).join(F.broadcast(t), how="cross").withColumn(
        "weight", F.col("_all") / (F.col("_k") * F.col("_n")),
    ).drop("_n", "_all", "_k")


def positive_weight(df: DataFrame, y: str) -> float:
    """Negatives over positives; 1 without a positive."""
    r = df.agg(F.count_if(F.col(y) == 1).alias("p"), F.count_if(F.col(y) != 1).alias("n")).first()
    return r.n / r.p if r.p else 1.0


def assemble(df: DataFrame, features: list[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=features, outputCol="features").transform(df)


def estimator(kind: str, weighted: bool, **settings):
    from pyspark.ml.classification import GBTClassifier, LogisticRegression

    w = {"weightCol": "weight"} if weighted else {}
    if kind == "logistic":
        return LogisticRegression(standardization=False, maxIter=settings.get("iterations", 100), regParam=settings.get("reg", 1e-3), **w)
    return GBTClassifier(
        maxDepth=settings.get("depth", 3), stepSize=settings.get("rate", 0.1), maxIter=settings.get("trees", 20), seed=42, **w
    )


def fit_predict(
    train: DataFrame, test: DataFrame, features: list[str], y: str = "true_label", kind: str = "logistic", balanced: bool = False,
    rows: str | None = None, **settings
) -> tuple[DataFrame, object]:
    """Imputation and scaling fitted on train only -> (test with predicted_probability, model).

    Equal training rows are counted first; rows names their number where train is counted() already.
    """
    train, rows = (train, rows) if rows else (counted(train, [], features, y), ROWS)
    values = impute_values(train, features, rows=rows)
    a, b = impute(train, values), impute(test, values)
    if kind == "logistic":
        s = scale_values(a, features, rows)
        a, b = standardise(a, s), standardise(b, s)
    a = class_weights(a, y, rows) if balanced else a.withColumn("weight", F.lit(1.0))
    a = a.withColumn("weight", F.col("weight") * F.col(rows))
    model = estimator(kind, True, **settings).fit(assemble(a.withColumn("label", F.col(y).cast("double")), features))
    out = model.transform(assemble(b, features))
    from pyspark.ml.functions import vector_to_array

    return out.withColumn(
        "predicted_probability", F.get(vector_to_array("probability"), F.lit(1)),
    ).drop("features", "rawPrediction", "probability", "prediction"), model


def coefficient_importance(model, features: list[str]) -> list[tuple[str, float]]:
    """|standardised coefficient|, or a tree ensemble's own importances."""
    v = np.abs(model.coefficients.toArray()) if hasattr(model, "coefficients") else model.featureImportances.toArray()
    return sorted(zip(features, map(float, v), strict=True), key=lambda x: (-x[1], x[0]))


def nodes_of(tree) -> list:
    """A fitted tree's leaves: (value, {feature: (low, high, share)}), the path's bounds low < x <= high of a feature and the
    share of rows that its splits pass on."""
    out, todo = [], [(tree._call_java("rootNode"), {})]
    while todo:
        node, path = todo.pop()
        if "LeafNode" in node.getClass().getName():
            out.append((float(node.prediction()), path))
            continue
        f, at, n = int(node.split().featureIndex()), float(node.split().threshold()), float(node.impurityStats().count())
        low, high, share = path.get(f, (-np.inf, np.inf, 1.0))
        for child, own in ((node.leftChild(), (low, min(high, at))), (node.rightChild(), (max(low, at), high))):
            todo.append((child, path | {f: (*own, share * float(child.impurityStats().count()) / n)}))
    return out


def ensemble(model) -> tuple[list, list]:
    """(weight and leaves of each tree) of a boosted model."""
    return list(map(float, model.treeWeights)), [nodes_of(t) for t in model.trees]


def shap_of(x, weights: list, trees: list):
    """(values, base): exact Shapley values of a tree ensemble's sum, path-dependent, for each row and feature.

    A leaf's game is a product over the few features of its path: with a feature known, whether the row passes its splits;
    unknown, the share of rows that do. So a leaf needs the subsets of its path's features only.
    """
    from itertools import combinations
    from math import factorial

    out, base = np.zeros(x.shape), 0.0
    for weight, leaves_ in zip(weights, trees, strict=True):
        for value, path in leaves_:
            fs = list(path)
            passes = {f: ((x[:, f] > path[f][0]) & (x[:, f] <= path[f][1])).astype(float) for f in fs}
            base += weight * value * float(np.prod([path[f][2] for f in fs]))
            for f in fs:
                rest, total = [g for g in fs if g != f], np.zeros(len(x))
                for n in range(len(rest) + 1):
                    share = factorial(n) * factorial(len(rest) - n) / factorial(len(fs))
                    for known in combinations(rest, n):
                        term = np.full(len(x), share)
                        for g in rest:
                            term *= passes[g] if g in known else path[g][2]
                        total += term
                out[:, f] += weight * value * total * (passes[f] - path[f][2])
    return out, base


def shap(df: DataFrame, model, features: list[str], rows: str | None = None) -> DataFrame:
    """df (features without NULLs) plus shap, an array of each feature's value, and margin, base plus their sum.

    Boosted trees: exact and path-dependent. Linear models: coefficient times distance from the mean of df. rows: a column of how
    many rows each stands for.
    """
    if hasattr(model, "coefficients"):
        means = weighted_means(df.withColumn("_one", F.col(rows) if rows else F.lit(1)), {f: F.col(f) for f in features}, "_one")
        parts = [F.lit(float(c)) * (F.col(f) - F.lit(means[f])) for f, c in zip(features, model.coefficients, strict=True)]
        base = float(model.intercept) + sum(float(c) * means[f] for f, c in zip(features, model.coefficients, strict=True))
        return df.withColumn("shap", F.array(*parts)).withColumn("margin", F.aggregate("shap", F.lit(base), lambda s, v: s + v))
    weights, trees = ensemble(model)
    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + ", shap array<double>, margin double"

    def run(batches):
        for t in batches:
            values, base = shap_of(t[features].to_numpy(float), weights, trees)
            yield t.assign(shap=list(values), margin=base + values.sum(1))

    return df.mapInPandas(run, schema)


def mean_abs_shap(df: DataFrame, model, features: list[str]) -> DataFrame:
    """(feature, mean_abs_shap)"""
    s = shap(df.select(*features), model, features)
    return s.agg(
        *[F.avg(F.abs(F.col("shap")[i])).alias(f) for i, f in enumerate(features)]
    ).unpivot([], features, "feature", "mean_abs_shap")


def configurations(depths=(2, 3, 4), rates=(0.03, 0.05, 0.1), trees=(100, 200, 400)) -> list[dict]:
    """The models of a search, in the order in which ties are settled: two linear ones, two boosted with defaults, and a
    boosted one for each depth, rate and number of trees."""
    out = [
        dict(
            model_name=f"LogisticRegression{b}", kind="logistic", balanced=bool(b), complexity=1, settings={"reg": 1e-3},
        ) for b in ("", "_Balanced")
    ]
    out += [
        dict(
            model_name=f"HistGB{b}", kind="boosted", balanced=bool(b), complexity=2, settings={"trees": 100, "depth": 5, "rate": 0.1},
        ) for b in ("", "_Balanced")
    ]
    return out + [
        dict(
            model_name=f"XGB_d{d}_lr{r}_n{n}", kind="boosted", balanced=False, complexity=3, settings={"depth": d, "rate": r, "trees": n},
        ) for d in depths for r in rates for n in trees
    ]


def fitted(train: DataFrame, test: DataFrame, features: list[str], y: str, config: dict, oversample: bool) -> DataFrame | None:
    """test scored by one configuration, imputed and scaled by train alone; no balanced model on oversampled rows."""
    if oversample and config["balanced"]:
        return None
    own = present_columns(train, features)
    if not own:
        return None
    values = impute_values(train, own, "mean")
    scales = scale_values(impute(train, values), own)
    ready = lambda t: standardise(impute(t, values), scales)
    a, b = ready(train), ready(test)
    a = smote(a, own, y) if oversample else a
    return fit_predict(a, b, own, y, config["kind"], config["balanced"], **config["settings"])[0]


def search(
    df: DataFrame, features: list[str], configs: list[dict], group: str = "cv_group_id", y: str = "true_label", oversample: bool = False,
    folds: int = 3, thresholds=(0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8), workers: int = 4,
) -> tuple[DataFrame, list[dict]]:
    """(out-of-fold predictions, the choice of each fold): nested cross-validation over groups.

    Each group with a positive is held out once. On the others, inner folds of whole groups score every configuration; the
    best by choose() is fitted again and scores the group held out. Fits of one fold run side by side; the training rows are
    a written table, and only metrics reach the driver.
    """
    from concurrent.futures import ThreadPoolExecutor

    from tarnwatch.operators import metrics, splits

    df = stored(df, "search")
    out, chosen = None, []
    for held in splits.group_folds(df, group, y, group).orderBy("fold").collect():
        train, test = df.where(F.col(group) != F.lit(held.fold)), df.where(F.col(group) == F.lit(held.fold))
        inner = splits.stratified_groups(train, group, y, folds)
        if inner is None:
            continue
        inner = stored(inner.withColumnRenamed("fold", "_inner"), "search-inner")
        names = [r[0] for r in inner.select("_inner").distinct().orderBy("_inner").collect()]

        def score(config, inner=inner, names=names):
            parts = [
                fitted(inner.where(F.col("_inner") != k), inner.where(F.col("_inner") == k), features, y, config, oversample) for k in names
            ]
            if any(p is None for p in parts):
                return None
            p = stored(reduce(DataFrame.unionByName, [x.select(y, "predicted_probability") for x in parts]), "search-scores")
            best, r = metrics.threshold_sweep(p, [], thresholds, y).first(), metrics.ranking(p, [], y).first()
            m = metrics.rates(metrics.confusion(p, [], y, threshold=best.threshold)).first()
            return config | {"threshold": best.threshold, "pr_auc": r.pr_auc or 0.0, "f1": m.f1, "recall": m.recall}

        with ThreadPoolExecutor(workers) as pool:
            scored = [s for s in pool.map(score, configs) if s is not None]
        best = choose(scored)
        if best is None:
            continue
        chosen.append({"fold": held.fold} | best)
        p = fitted(train, test, features, y, best, oversample).select(
            F.col(group).alias("fold"), F.lit(best["model_name"]).alias("model_name"), y, "predicted_probability",
            F.lit(float(best["threshold"])).alias("threshold"),
        )
        p = stored(p, "search-out")
        out = p if out is None else out.unionByName(p)
    return out, chosen


def holdout_gate(
    df: DataFrame, region: str, home: list[str], away: list[str], unit: str = "lake_uid", y: str = "true_label", least: int = 5,
) -> DataFrame:
    """(direction, train_units, test_units, eligible): units with a positive on either side; a transfer needs `least` on both."""
    positive = F.col(y) == 1
    n = df.agg(
        *[
            F.countDistinct(
                F.when(positive & F.col(region).isin(*side), F.col(unit))
            ).alias(k) for k, side in (("home", home), ("away", away))
        ]
    )
    ok = (F.col("home") >= least) & (F.col("away") >= least)
    rows = F.array(
        F.struct(
            F.lit("forward").alias("direction"), F.col("home").alias("train_units"), F.col("away").alias("test_units"),
            ok.alias("eligible"),
        ),
        F.struct(
            F.lit("reverse").alias("direction"), F.col("away").alias("train_units"), F.col("home").alias("test_units"),
            ok.alias("eligible"),
        ),
    )
    return n.select(F.inline(rows))


def transfer(
    df: DataFrame, features: list[str], region: str, home: list[str], away: list[str], unit: str = "lake_uid", y: str = "true_label",
    least: int = 5,
) -> DataFrame | None:
    """(direction, fold counts and rankings) of a balanced linear model trained at home and tested away, and the reverse;
    None where holdout_gate() closes."""
    from tarnwatch.operators import metrics

    if not holdout_gate(df, region, home, away, unit, y, least).first().eligible:
        return None
    out = None
    for name, a, b in (("forward", home, away), ("reverse", away, home)):
        scored = fitted(df.where(F.col(region).isin(*a)), df.where(F.col(region).isin(*b)), features, y, configurations()[1], False)
        p = scored.select(F.lit(name).alias("direction"), y, "predicted_probability")
        out = p if out is None else out.unionByName(p)
    out = stored(out, "transfer")
    return metrics.confusion(out, ["direction"], y, threshold=0.5).join(metrics.ranking(out, ["direction"], y), "direction")


def permutation_importance(predict, df: DataFrame, features: list[str], y: str = "true_label", seed: int = 42) -> list[tuple[str, float]]:
    """Fall of the ROC-AUC when a feature's values change rows. Ranks join shuffled to sorted rows within hash groups."""
    base = ranking(predict(df), [], y).first().roc_auc
    out = []
    numbered = df.withColumn("_g", F.pmod(F.xxhash64(*df.columns), F.lit(64)))
    for f in features:
        a = numbered.withColumn("_r", F.row_number().over(W.partitionBy("_g").orderBy(F.xxhash64(*df.columns))))
        b = a.select(
            "_g", F.col(f).alias("_v"), F.row_number().over(W.partitionBy("_g").orderBy(F.xxhash64(F.lit(seed), *df.columns))).alias("_r"),
        )
        moved = a.join(b, ["_g", "_r"]).withColumn(f, F.col("_v")).drop("_g", "_r", "_v")
        out.append((f, float(base - ranking(predict(moved), [], y).first().roc_auc)))
    return sorted(out, key=lambda x: -x[1])


def splits_of(x, parts: int) -> list:
    """Row numbers of x in about `parts` parts by median splits of the widest column; equal rows stay together."""
    todo, out = [(np.arange(len(x)), parts)], []
    while todo:
        i, n = todo.pop()
        side = split(x[i]) if n > 1 else None
        if side is None:
            out.append(i)
        else:
            left = x[i, side[0]] <= side[1]
            todo += [(i[~left], n - n // 2), (i[left], n // 2)]
    return out


def split(x):
    """(column, largest value of the lower side), None where all rows are equal."""
    if not len(x):
        return None
    c = int(np.argmax(x.max(0) - x.min(0)))
    v = np.sort(x[:, c])
    at = v[(len(v) - 1) // 2]
    if at == v[-1]:
        lower = v[v < at]
        if not len(lower):
            return None
        at = lower[-1]
    return c, at


def tree_of(x, parts: int):
    """Nested (column, value, lower, upper) of about `parts` leaves, None for a leaf."""
    side = split(x) if parts > 1 else None
    if side is None:
        return None
    left = x[:, side[0]] <= side[1]
    return (*side, tree_of(x[left], parts // 2), tree_of(x[~left], parts - parts // 2))


def leaves(tree, x):
    """Each row's leaf number."""
    out, n, todo = np.zeros(len(x), np.int32), 0, [(tree, np.arange(len(x)))]
    while todo:
        node, i = todo.pop()
        if node is None:
            out[i] = n
            n += 1
        else:
            left = x[i, node[0]] <= node[1]
            todo += [(node[3], i[~left]), (node[2], i[left])]
    return out


def gaps(lo, hi, low, high):
    """Squared least distance of a box to each of several boxes."""
    return (np.maximum(0, np.maximum(low - hi, lo - high)) ** 2).sum(1)


def nearest(q, x, k: int, part: int = 256):
    """(squared distances, rows of x) of the k nearest rows of x at a distance to each q, inf and -1 where there are fewer.

    Exact: parts of x are left out only where their boxes are farther than all k found.
    """
    far, near = np.full((len(q), k), np.inf), np.full((len(q), k), -1)
    if not len(q) or not len(x):
        return far, near
    parts = splits_of(x, -(-len(x) // part))
    low, high = np.array([x[i].min(0) for i in parts]), np.array([x[i].max(0) for i in parts])
    for i in splits_of(q, -(-len(q) // part)):
        for at in range(0, len(i), part):
            own = i[at : at + part]
            bound = gaps(q[own].min(0), q[own].max(0), low, high)
            for b in np.argsort(bound, kind="stable"):
                if bound[b] > far[own, -1].max():
                    break
                d = ((q[own][:, None] - x[parts[b]][None]) ** 2).sum(2)
                d[d == 0] = np.inf
                d = np.hstack([far[own], d])
                rows = np.hstack([near[own], np.broadcast_to(parts[b], (len(own), len(parts[b])))])
                best = np.argsort(d, axis=1, kind="stable")[:, :k]
                far[own], near[own] = np.take_along_axis(d, best, 1), np.take_along_axis(rows, best, 1)
    near[np.isinf(far)] = -1
    return far, near


def by_leaf(df: DataFrame, leaf: str) -> DataFrame:
    """Leaves dealt to many tasks: the work of one is large for its few bytes, by which tasks would be joined."""
    spark = df.sparkSession
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(tasks, leaf)


def neighbours(points: DataFrame, features: list[str], k: int = 5, block: int = 2000) -> tuple[DataFrame, list]:
    """(rows (features, _home, _d, _n, near_...), leaves' (number, rows)): of each distinct point its own other copies
    (_d 0, _n of them), and candidates with their copies, among which are its k nearest.

    Points are dealt to leaves of a k-d tree, laid out by a sample. Each leaf finds its own k nearest; a point then asks
    every other leaf whose box is not farther than the k-th of these, so the leaves do not change what is found.
    """
    made, nears = ", ".join(f"{f} double" for f in features), ", ".join(f"`near_{f}` double" for f in features)
    named = [f"near_{f}" for f in features]
    distinct = stored(points.groupBy(*features).agg(F.count("*").alias("_m")), "smote-points")
    n = distinct.count()
    parts = min(1024, max(1, -(-n // block)))
    sample = distinct.where(
        F.pmod(F.xxhash64(*features), F.lit(max(1, n // (100 * parts)))) == 0
    ).select(*features).toPandas().to_numpy(float)
    tree = tree_of(sample[np.lexsort(sample.T[::-1])], parts)

    def deal(batches):
        for t in batches:
            yield t.assign(_home=leaves(tree, t[features].to_numpy(float)))

    dealt = stored(distinct.mapInPandas(deal, f"{made}, _m long, _home int"), "smote-leaves")
    boxes = dealt.groupBy("_home").agg(
        F.sum("_m").alias("rows"), *[F.min(f).alias(f"low_{f}") for f in features], *[F.max(f).alias(f"high_{f}") for f in features],
    ).orderBy("_home").collect()
    names = np.array([b._home for b in boxes], np.int32)
    low, high = (np.array([[b[f"{s}_{f}"] for f in features] for b in boxes], float).reshape(len(boxes), -1) for s in ("low", "high"))

    def found(q, x, t, others, far, near):
        """A row for each of the neighbours near[i] of q[i]."""
        i, j = np.nonzero(near >= 0)
        to = near[i, j]
        return dict(zip(features, q[i].T, strict=True)) | {
            "_home": t[i], "_d": far[i, j], "_n": others[to],
        } | dict(zip(named, x[to].T, strict=True))

    def own(t):
        import pandas as pd

        t = t.sort_values(features, ignore_index=True)
        x, m = t[features].to_numpy(float), t._m.to_numpy()
        far, near = nearest(x, x, k)
        # copies count too: with k of them nothing else is near
        reach = np.where(m > k, -1.0, far[:, -1] * (1 + 1e-9))
        asks = [
            [
                int(names[b]) for b in np.flatnonzero(gaps(p, p, low, high) <= r) if names[b] != t._home.iloc[0]
            ] for p, r in zip(x, reach, strict=True)
        ]
        selves = pd.DataFrame(
            dict(zip(features, x.T, strict=True)) | {
                "_home": t._home, "_d": 0.0, "_n": m - 1,
            } | dict(zip(named, x.T, strict=True)) | {"_asks": asks}
        )
        return pd.concat([selves, pd.DataFrame(found(x, x, t._home.to_numpy(), m, far, near)).assign(_asks=None)], ignore_index=True)

    schema = f"{made}, _home int, _d double, _n long, {nears}"
    first = stored(by_leaf(dealt, "_home").groupBy("_home").applyInPandas(own, f"{schema}, _asks array<int>"), "smote-own")

    def other(asked, held):
        import pandas as pd

        held = held.sort_values(features, ignore_index=True)
        q, x = asked[features].to_numpy(float), held[features].to_numpy(float)
        return pd.DataFrame(
            found(q, x, asked._home.to_numpy(), held._m.to_numpy(), *nearest(q, x, k)), columns=[*features, "_home", "_d", "_n", *named],
        )

    asked = first.select(*features, "_home", F.explode("_asks").alias("_leaf"))
    held = by_leaf(dealt.withColumnRenamed("_home", "_leaf"), "_leaf")
    more = by_leaf(asked, "_leaf").groupBy("_leaf").cogroup(held.groupBy("_leaf")).applyInPandas(other, schema)
    return first.drop("_asks").unionByName(more), [(b._home, b.rows) for b in boxes]


def smote(df: DataFrame, features: list[str], y: str = "true_label", k: int = 5, seed: int = 42, block: int = 2000) -> DataFrame:
    """df plus synthetic positives up to the negatives' count, each between a positive and one of its k nearest.

    The nearest are sought among all positives; `block` is about the rows of a task's part and changes no neighbour. A
    single positive is repeated.
    """
    n = df.agg(F.count_if(F.col(y) == 1).alias("p"), F.count_if(F.col(y) != 1).alias("n")).first()
    if not n.p or n.p >= n.n:
        return df
    positives = df.where(F.col(y) == 1).select(*[F.col(f).cast("double").alias(f) for f in features]).dropna()
    near, sizes = neighbours(positives, features, k, block)
    ends = np.cumsum([0, *(s for _, s in sizes)])
    shares = np.diff(np.rint(ends / max(ends[-1], 1) * (n.n - n.p)).astype(int))
    counts = {home: int(c) for (home, _), c in zip(sizes, shares, strict=True)}
    named = [f"near_{f}" for f in features]

    def make(t):
        import pandas as pd

        t = t.sort_values([*features, "_d", *named], ignore_index=True)
        first = (t._d == 0).to_numpy()
        point = np.cumsum(first) - 1
        copies = t._n.to_numpy()
        before = np.cumsum(copies) - copies
        before = before - before[first][point]
        take = np.clip(k - before, 0, copies)
        starts = np.flatnonzero(first)
        total, upto = np.add.reduceat(take, starts), np.cumsum(take)
        base = upto[starts] - take[starts]
        rng = np.random.default_rng(seed + int(t._home.iloc[0]))
        count, m = counts[int(t._home.iloc[0])], copies[starts] + 1
        i = np.searchsorted(np.cumsum(m), rng.integers(0, m.sum(), count), side="right")
        j = np.searchsorted(upto, base[i] + rng.integers(0, np.maximum(total[i], 1)), side="right")
        j = np.where(total[i] > 0, np.minimum(j, len(t) - 1), starts[i])
        a, b = t[features].to_numpy(float)[starts[i]], t[named].to_numpy(float)[j]
        return pd.DataFrame(a + rng.random((count, 1)) * (b - a), columns=features)

    made = by_leaf(near, "_home").groupBy("_home").applyInPandas(make, ", ".join(f"{f} double" for f in features))
    return df.unionByName(made.withColumn(y, F.lit(1)), allowMissingColumns=True)


def domain_classifier(df: DataFrame, features: list[str], domain: str, unit: str, folds: int = 3) -> DataFrame:
    """Out-of-fold scores of which domain a row is from (units never split), as one row of unit-balanced ROC-AUC."""
    d = df.withColumn("true_label", F.col(domain).cast("int")).withColumn("_fold", F.pmod(F.xxhash64(unit), F.lit(folds)))
    out, c = None, counted(d, ["_fold"], features)
    for f in range(folds):
        scored, _ = fit_predict(c.where(F.col("_fold") != f), d.where(F.col("_fold") == f), features, rows=ROWS)
        out = scored if out is None else out.unionByName(scored)
    return ranking(balanced_mean(out, [], unit), [])


def choose(candidates: list[dict], tolerance: float = 0.005) -> dict | None:
    """Scan in order: a candidate wins by pr_auc, else f1, else recall beyond the tolerance, else by being simpler. The
    rule is not transitive, so the order of the candidates counts."""
    best = None
    for c in candidates:
        if best is None:
            best = c
            continue
        gaps = [c[m] - best[m] for m in ("pr_auc", "f1", "recall")]
        beyond = next((g for g in gaps if abs(g) > tolerance), None)
        if beyond is not None and beyond > 0 or beyond is None and c["complexity"] < best["complexity"]:
            best = c
    return best


def choose_rounded(results: DataFrame) -> DataFrame:
    """pr_auc, f1 and recall to three places, then the simpler model, then its name."""
    return results.orderBy(*[F.round(m, 3).desc() for m in ("pr_auc", "f1", "recall")], "complexity", "model_name").limit(1)


def frame(df: DataFrame, features: list[str], region: str, y: str, regions: list, prepares: dict, picked: dict) -> tuple[DataFrame, dict]:
    """(region, true_label, _rows, _region, _x0, ...; {strategy: {feature: its column}}): what strategies pick, side by side; columns of one
    name and the same values in every row once.

    `_region` is the region's place in `regions`. A NaN counts as missing.
    """
    own = [c for c in df.columns if c in (region, y, ROWS, *features)]
    t, made = df.withColumns({f"_own_{c}": F.col(c) for c in own}), {}
    for name, prepare in prepares.items():
        wanted = sorted({f for (n, _), fs in picked.items() if n == name for f in fs})
        made[name] = {f: f"_x{sum(map(len, made.values())) + k}" for k, f in enumerate(wanted)}
        kept = [c for c in t.columns if c.startswith(("_own_", "_x"))]
        t = prepare(t).withColumns({x: F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double")) for f, x in made[name].items()})
        t = t.select(*[F.col(f"_own_{c}").alias(c) for c in own], *kept, *made[name].values())
    places, first = F.array_position(F.lit(regions), F.col(region)).cast("int") - 1, {}
    twins = {x: first[f] for m in made.values() for f, x in m.items() if first.setdefault(f, x) != x}
    if twins:
        differ = t.agg(*[F.count_if(~F.col(x).eqNullSafe(F.col(o))).alias(x) for x, o in twins.items()]).first()
        made = {name: {f: x if differ.asDict().get(x, 1) else twins[x] for f, x in m.items()} for name, m in made.items()}
    xs = sorted({x for m in made.values() for x in m.values()})
    return t.select(region, F.col(y).alias("true_label"), ROWS, places.alias("_region"), *xs), made


def left_out_medians(t: DataFrame, columns: list[str], regions: int) -> dict[tuple[str, int], float]:
    """{(column, region): exact median of the rows outside of the region}."""
    v = long(t, ["_region", ROWS], columns).where(F.col("value").isNotNull()).groupBy("_region", "feature", "value").agg(F.sum(ROWS).alias(ROWS))
    others = F.explode(F.array_except(F.sequence(F.lit(0), F.lit(regions - 1)), F.array("_region")))
    found = percentiles(v.withColumn("_out", others), ["feature", "_out"], "value", [0.5], ROWS)
    return {(r.feature, r._out): r.q[0] for r in found.collect()}


def summed(t: DataFrame, columns: list[str], of) -> dict[int, np.ndarray]:
    """{number: sum over all rows} of what of(regions, labels, weights, columns' values) gives for a batch: {number: array}."""
    import pyarrow as pa

    def run(batches):
        total = {}
        for b in batches:
            region, y, w, *x = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            for k, v in of(region, y, w, np.array(x).reshape(len(x), len(w))).items():
                total[k] = total[k] + v if k in total else v
        for k, v in total.items():
            yield pa.RecordBatch.from_pydict({
                "_k": pa.array(np.full(v.size, k), pa.int32()), "_at": pa.array(np.arange(v.size), pa.int32()), "_v": pa.array(v.ravel(), pa.float64()),
            })

    read = t.select("_region", F.col("true_label").cast("double"), F.col(ROWS).cast("double"), *columns)
    sums = read.mapInArrow(run, "_k int, _at int, _v double").groupBy("_k", "_at").agg(F.sum("_v").alias("_v")).orderBy("_k", "_at").collect()
    out = {}
    for r in sums:
        out.setdefault(r._k, []).append(r._v)
    return {k: np.array(v) for k, v in out.items()}


def left_out_fits(
    t: DataFrame, regions: int, models: list[tuple[int, list[str]]], reg: float = 1e-3, iterations: int = 100, close: float = 1e-12,
) -> list[tuple[float, dict, dict] | None]:
    """(intercept, {column: coefficient}, {column: value for a missing one}) of logistic models, each fitted on the rows of t outside
    of one region: models are (that region's place, columns). None where no row is left.

    Each model's columns are imputed by their medians and standardised on its own rows; the penalty is on standardised
    coefficients. All models are fitted together by Newton's steps, of which each reads the rows once: a model's design is a linear
    map of the same columns 1, x and 1 where x is missing, so sums over these serve every model. In a large table the steps start where those over one
    row in SHARE ended, which saves passes and does not move the end.
    """
    t = t.where(F.col("_region").isNotNull() & F.col("true_label").isNotNull())
    columns = sorted({c for _, cs in models for c in cs})
    stats = t.agg(
        F.count("*").alias("rows"), *[f(c).alias(f"{n}{c}") for c in columns for n, f in (("n", F.count), ("m", F.avg), ("s", F.stddev_pop), ("lo", F.min))]
    ).first()
    gaps = [c for c in columns if stats[f"n{c}"] < stats.rows]
    fills = left_out_medians(t, gaps, regions) if gaps else {}
    scale = {c: stats[f"s{c}"] or 1.0 for c in columns}
    centre = {c: (stats[f"m{c}"] if stats[f"s{c}"] else stats[f"lo{c}"]) or 0.0 for c in columns}
    missing = [columns.index(c) for c in gaps]
    wide = 1 + len(columns) + len(gaps)
    pairs = np.triu_indices(wide)
    c0, s0 = np.array([[centre[c]] for c in columns]).reshape(-1, 1), np.array([[scale[c]] for c in columns]).reshape(-1, 1)

    def design(x):
        """Rows 1, x centred and scaled (0 where missing), and 1 where missing."""
        z = np.nan_to_num((x - c0) / s0, nan=0.0, posinf=np.inf, neginf=-np.inf)
        return np.vstack([np.ones((1, x.shape[1])), z, np.isnan(x[missing])])

    def moments(region, y, w, x):
        z = design(x)
        z = np.vstack([z[pairs[0]] * z[pairs[1]], y == 1])
        return {int(r): z[:, region == r] @ w[region == r] for r in np.unique(region)}

    found = summed(t, columns, moments)
    within = [found.get(r, np.zeros(len(pairs[0]) + 1)) for r in range(regions)]
    fits = []
    for out, cs in models:
        total = sum((m for r, m in enumerate(within) if r != out), np.zeros(len(pairs[0]) + 1))
        m, positives = square(total[:-1], pairs), total[-1]
        if not m[0, 0]:
            fits.append(None)
            continue
        to = np.zeros((wide, 1 + len(cs)))
        to[0, 0] = 1
        values = {c: fills.get((c, out)) or 0.0 for c in cs}
        for k, c in enumerate(cs, 1):
            u = np.zeros(wide)
            u[0], u[1 + columns.index(c)] = centre[c], scale[c]
            if c in gaps:
                u[1 + len(columns) + gaps.index(c)] = values[c] - centre[c]
            u[0] -= u @ m[0] / m[0, 0]
            spread = u @ m @ u / m[0, 0]
            to[:, k] = u / (spread**0.5 if spread > 1e-20 * scale[c] ** 2 else 1.0)
        share = positives / m[0, 0]
        b, none = np.zeros(1 + len(cs)), 0.0
        b[0] = np.log(share) - np.log1p(-share) if 0 < share < 1 else np.inf if share else -np.inf
        if 0 < share < 1:
            none = -share * np.log(share) - (1 - share) * np.log1p(-share)
        fits.append({"out": out, "columns": cs, "values": values, "to": to, "begin": b, "b": b, "none": none + 1e-9})
    first = t.where(F.pmod(F.xxhash64(*columns), F.lit(SHARE)) == 0)
    for part in (first, t) if stats.rows > 1000 * SHARE else (t,):
        newton(part, columns, [f for f in fits if f], design, pairs, reg, iterations, close)
    return [f and (*plain(f, columns, centre, scale), f["values"]) for f in fits]


def newton(t: DataFrame, columns: list[str], fits: list[dict], design, pairs, reg: float, iterations: int, close: float) -> None:
    """Newton's steps of left_out_fits() over t, from where its fits are; a step that raises the loss is halved."""
    wide = int(pairs[0].max()) + 1
    for f in fits:
        f["loss"], f["done"] = np.inf, not np.isfinite(f["b"][0])
    for _ in range(iterations):
        live = [f for f in fits if not f["done"]]
        if not live:
            break
        maps = np.array([f["to"] @ f["b"] for f in live])
        outs = np.array([f["out"] for f in live])

        def slopes(region, y, w, x, maps=maps, outs=outs):
            """A row a model: weight, loss, slopes and bends, over what is not of its region."""
            z, sign, total = design(x), np.where(y == 1, -1.0, 1.0), np.zeros((len(outs), 2 + wide + len(pairs[0])))
            for r in np.unique(region):
                at, own = outs != r, region == r
                u, side, weight = z[:, own], sign[own], w[own]
                away = (maps[at] @ u) * side  # how far on the wrong side
                e = np.exp(-np.abs(away))
                d = 1 / (1 + e)
                lost = np.log1p(e) + np.maximum(away, 0)
                total[at] += np.hstack([
                    np.full((at.sum(), 1), weight.sum()), (lost @ weight)[:, None], (np.where(away >= 0, d, e * d) * (weight * side)) @ u.T, (e * d * d * weight) @ (u[pairs[0]] * u[pairs[1]]).T,
                ])
            return {0: total}

        sums = summed(t, columns, slopes).get(0, np.zeros(len(live) * (2 + wide + len(pairs[0])))).reshape(len(live), -1)
        for f, v in zip(live, sums, strict=True):
            weight, lost, first, second = v[0], v[1], v[2 : 2 + wide], square(v[2 + wide :], pairs)
            penalty = reg * np.r_[0.0, np.ones(len(f["b"]) - 1)]
            loss = lost / weight + (penalty * f["b"] ** 2).sum() / 2 if weight else 0.0
            if not weight or f["loss"] == np.inf and loss > f["none"]:  # what a share of the rows gave is no start: begin anew
                f["b"], f["done"], f["loss"] = f["begin"], not weight, f["none"] + 1
                continue
            if not loss <= f["loss"] + 1e-9 * abs(f["loss"]):  # too far: half the step
                f["step"] = f["step"] / 2
                f["b"] = f["b"] - f["step"]
                continue
            slope = f["to"].T @ first / weight + penalty * f["b"]
            bend = f["to"].T @ second @ f["to"] / weight + np.diag(penalty)
            f["step"] = -np.linalg.lstsq(bend, slope, rcond=None)[0]
            f["loss"], f["done"] = loss, not slope @ -f["step"] > close
            f["b"] = f["b"] + f["step"]


def square(v, pairs):
    """The symmetric matrix whose upper half is v."""
    m = np.zeros([int(pairs[0].max()) + 1] * 2)
    m[pairs] = v
    return m + np.triu(m, 1).T


def plain(fit: dict, columns: list[str], centre: dict, scale: dict) -> tuple[float, dict]:
    """(intercept, {column: coefficient}) of the columns as they were before they were centred and scaled."""
    at = fit["to"] @ fit["b"] if np.isfinite(fit["b"][0]) else np.r_[fit["b"][0], np.zeros(len(fit["to"]) - 1)]
    b = {c: float(at[1 + columns.index(c)] / scale[c]) for c in fit["columns"]}
    return float(at[0] - sum(b[c] * centre[c] for c in b)), b


def region_fits(df: DataFrame, features: list[str], region: str, y: str, strategies: dict) -> tuple[DataFrame, list[str], list[tuple]] | None:
    """(frame(), its columns, models) of region_strategies(); a model is (region's place, strategy, intercept, coefficients, fills)."""
    from concurrent.futures import ThreadPoolExecutor

    df = counted(df, [region], features, y)
    regions = sorted(x[0] for x in df.select(region).where(F.col(region).isNotNull()).distinct().collect())
    todo = [(name, k) for k in range(len(regions)) for name in strategies]
    with ThreadPoolExecutor(4) as pool:
        own = pool.map(lambda x: strategies[x[0]][0](df.where(F.col(region) != regions[x[1]]), features), todo)
        picked = {x: fs for x, fs in zip(todo, own, strict=True) if fs}
    if not picked:
        return None
    t, columns = frame(df, features, region, y, regions, {name: prepare for name, (_, prepare) in strategies.items()}, picked)
    fits = left_out_fits(t, len(regions), [(k, [columns[name][f] for f in fs]) for (name, k), fs in picked.items()])
    xs = sorted({c for m in columns.values() for c in m.values()})
    return t, xs, [
        (k, name, fit[0], [fit[1].get(x, 0.0) for x in xs], [fit[2].get(x, 0.0) for x in xs]) for (name, k), fit in zip(picked, fits, strict=True) if fit
    ]


def region_scores(t: DataFrame, xs: list[str], models: list[tuple], region: str) -> DataFrame:
    """(strategy, fold, true_label, predicted_probability, _rows) of region_fits()."""
    models = t.sparkSession.createDataFrame(models, "_region int, strategy string, _b0 double, _b array<double>, _fill array<double>")
    margin = sum((F.col("_b")[k] * F.coalesce(x, F.col("_fill")[k]) for k, x in enumerate(xs)), F.col("_b0"))
    return t.join(F.broadcast(models), "_region").select(
        "strategy", F.col(region).alias("fold"), "true_label", (1 / (1 + F.exp(-margin))).alias("predicted_probability"), ROWS,
    )


def region_strategies(df: DataFrame, features: list[str], region: str, y: str, strategies: dict) -> DataFrame | None:
    """(strategy, fold, true_label, predicted_probability, _rows): leave-one-region-out predictions of several feature strategies;
    `_rows` is how many rows are equal, as counted(), here and in what the strategies are given.

    A strategy is (pick, prepare): pick chooses features by the training rows, prepare adds columns row by row. The models
    are those of fit_predict(), fitted together.
    """
    found = region_fits(df, features, region, y, strategies)
    return found and region_scores(*found, region)


def region_rankings(df: DataFrame, features: list[str], region: str, y: str, strategies: dict) -> DataFrame | None:
    """(strategy, fold, roc_auc, pr_auc, positives, negatives): ranking() of region_strategies().

    Tasks score rows and pack equal scores once, by ranges of each model's scores; a range is then ranked by one task, which knows how many
    are above it. A sample of the scores lays out the ranges and changes no result. Rows are not shuffled one by one.
    """
    import pyarrow as pa

    found = region_fits(df, features, region, y, strategies)
    if not found or not found[2]:
        return None
    t, xs, models = found
    t = t.where(F.col("true_label").isNotNull() & F.col("_region").isNotNull())
    spark, names = t.sparkSession, {(k, name): i for i, (k, name, *_) in enumerate(models)}
    scores = region_scores(t.withColumn("_place", F.col("_region")), xs, models, "_place")
    some = scores.sample(min(1.0, 1000 * RANGES * len(models) / max(1, t.count() * len({name for _, name, *_ in models}))), 1)
    cuts = [k / RANGES for k in range(1, RANGES)]
    bounds = {
        names[r.fold, r.strategy]: np.unique(r.at)
        for r in some.groupBy("fold", "strategy").agg(F.percentile_approx("predicted_probability", cuts).alias("at")).collect()
    }
    of = [(k, np.array([b0]), np.array(b), np.array(fill)) for k, _, b0, b, fill in models]

    def packed(parts):
        """Rows of a model's range: its different scores, how many positives and negatives have each."""
        region, hit, w, x = (np.concatenate(p, -1) for p in zip(*parts, strict=True))
        out = []
        for i, (k, b0, b, fill) in enumerate(of):
            own = region == k
            if not own.any():
                continue
            v = x[:, own]
            with np.errstate(over="ignore"):
                s, at = np.unique(1 / (1 + np.exp(-(b0 + b @ np.where(np.isnan(v), fill[:, None], v)))), return_inverse=True)
            pos, neg = (np.bincount(at, w[own] * side, len(s)).astype("int64") for side in (hit[own], ~hit[own]))
            ends = [0, *np.searchsorted(s, bounds.get(i, np.zeros(0)), "right"), len(s)]
            out += [
                (i, r, s[a:z].tobytes(), pos[a:z].tobytes(), neg[a:z].tobytes(), int(pos[a:z].sum()), int(neg[a:z].sum()))
                for r, (a, z) in enumerate(zip(ends, ends[1:])) if a < z
            ]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, kind) for c, kind in zip(zip(*out), (pa.int32(), pa.int32(), *[pa.binary()] * 3, pa.int64(), pa.int64()))], ["_fit", "_range", "s", "pos", "neg", "positives", "negatives"],
        )

    def pack(batches):
        parts, n = [], 0
        for b in batches:
            region, y, w, *x = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            parts.append((region, y == 1, w, np.array(x).reshape(len(x), len(w))))
            n += len(w)
            if n >= 500_000:
                yield packed(parts)
                parts, n = [], 0
        if n:
            yield packed(parts)

    read = t.select("_region", F.col("true_label").cast("double"), F.col(ROWS).cast("double"), *xs)
    p = stored(read.mapInArrow(pack, "_fit int, _range int, s binary, pos binary, neg binary, positives long, negatives long"), "packed")
    sums = p.groupBy("_fit", "_range").agg(F.sum("positives").alias("positives"), F.sum("negatives").alias("negatives"))
    up = W.partitionBy("_fit").orderBy(F.col("_range").desc()).rowsBetween(W.unboundedPreceding, -1)
    above = sums.select("_fit", "_range", *[F.coalesce(F.sum(c).over(up), F.lit(0)).alias(n) for c, n in (("positives", "tp"), ("negatives", "fp"))])

    def rank(table):
        s, pos, neg = (np.concatenate([np.frombuffer(v, kind) for v in table[c].to_pylist()]) for c, kind in (("s", "f8"), ("pos", "i8"), ("neg", "i8")))
        s, at = np.unique(-s, return_inverse=True)
        pos, neg = (np.bincount(at, n, len(s)).astype("int64") for n in (pos, neg))
        tp, fp = table["tp"][0].as_py() + np.cumsum(pos), table["fp"][0].as_py() + np.cumsum(neg)
        return pa.table({
            "_fit": table["_fit"][:1], "won": [int((neg * (2 * (tp - pos) + pos)).sum())], "steps": [float((pos * (tp / (tp + fp))).sum())],
            "positives": [int(pos.sum())], "negatives": [int(neg.sum())],
        })

    ranked = p.select("_fit", "_range", "s", "pos", "neg").join(F.broadcast(above), ["_fit", "_range"]).groupBy("_fit", "_range").applyInArrow(
        rank, "_fit int, won long, steps double, positives long, negatives long",
    ).groupBy("_fit").agg(*[F.sum(c).alias(c) for c in ("won", "steps", "positives", "negatives")])
    folds = {r._region: r.fold for r in t.select("_region", F.col(region).alias("fold")).distinct().collect()}
    named = spark.createDataFrame([(i, name, k) for (k, name), i in names.items()], "_fit int, strategy string, _region int")
    regions = spark.createDataFrame(list(folds.items()), t.select("_region", F.col(region).alias("fold")).schema)
    pos, neg = F.col("positives"), F.col("negatives")
    return ranked.join(F.broadcast(named), "_fit").join(F.broadcast(regions), "_region").select(
        "strategy", "fold", F.when((pos > 0) & (neg > 0), F.col("won") / (2.0 * pos * neg)).alias("roc_auc"),
        F.when(pos > 0, F.col("steps") / pos).alias("pr_auc"), "positives", "negatives",
    )
