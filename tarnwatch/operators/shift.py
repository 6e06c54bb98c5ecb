"""Distribution shift between domains, and the features that are common to all."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwatch.functions import ranges
from tarnwatch.functions.ranges import running


def long(df: DataFrame, ids: list[str], features: list[str]) -> DataFrame:
    """(ids, feature, value), a row a feature, in one scan."""
    return df.select(*ids, *[F.col(f).cast("double").alias(f) for f in features]).unpivot(ids, features, "feature", "value")


def smd(df: DataFrame, features: list[str], domain: str, a: str, b: str) -> DataFrame:
    """|mean a - mean b| / sqrt of the mean population variance; 0 if that is 0, NULL if a side has no value."""
    x = lambda d: F.when(F.col(domain) == d, F.col("value"))
    g = long(df, [domain], features).groupBy("feature").agg(
        F.avg(x(a)).alias("ma"), F.avg(x(b)).alias("mb"), F.var_pop(x(a)).alias("va"), F.var_pop(x(b)).alias("vb"),
    )
    pooled = F.sqrt((F.col("va") + F.col("vb")) / 2)
    return g.select("feature", F.when(pooled == 0, 0.0).when(pooled > 0, F.abs(F.col("ma") - F.col("mb")) / pooled).alias("smd"))


def wasserstein(df: DataFrame, features: list[str], domain: str, a: str, b: str) -> DataFrame:
    """Exact 1-D distance: the area between the two distribution functions, over distinct values."""
    x = long(df, [domain], features).where(F.col("value").isNotNull() & F.col(domain).isin(a, b))
    x = x.groupBy("feature", "value").agg(F.count_if(F.col(domain) == a).alias("na"), F.count_if(F.col(domain) == b).alias("nb"))
    whole = x.groupBy("feature").agg(F.sum("na").alias("all_a"), F.sum("nb").alias("all_b"))
    x = running(x, ["feature"], ["value"], {"upto_a": "na", "upto_b": "nb"}, following="value").join(whole, "feature")
    share = lambda n: F.try_divide(F.col(f"upto_{n}").cast("double"), F.col(f"all_{n}").cast("double"))
    x = x.select("feature", F.abs(share("a") - share("b")).alias("gap"), (F.col("_next") - F.col("value")).alias("width"))
    return x.groupBy("feature").agg(F.sum(F.col("gap") * F.coalesce("width", F.lit(0.0))).alias("wasserstein"))


def percentiles(df: DataFrame, by: list[str], c: str, at=(0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)) -> DataFrame:
    """Exact, linear between neighbours."""
    return ranges.percentiles(df, by, c, at).select(*by, *[F.col("q")[i].alias(f"p{round(100 * p):02d}") for i, p in enumerate(at)])


def availability(df: DataFrame, by: list[str], features: list[str], rows: str | None = None) -> DataFrame:
    """Share of non-null values a group and feature; rows: a column of how many rows each stands for."""
    n = F.sum(rows) if rows else F.count("*")
    there = lambda f: F.sum(F.when(F.col(f).isNotNull(), F.col(rows)).otherwise(0)) if rows else F.count(f)
    return df.groupBy(*by).agg(*[(there(f) / n).alias(f) for f in features]).unpivot(by, features, "feature", "availability")


def common_core(df: DataFrame, features: list[str], region: str, least: float = 0.8, spread: float = 0.2, rows: str | None = None) -> DataFrame:
    """Features whose least regional availability is at least `least` and whose regions differ by at most `spread`."""
    a = availability(df, [region], features, rows).groupBy("feature").agg(F.min("availability").alias("lo"), F.max("availability").alias("hi"))
    return a.select("feature", "lo", "hi", ((F.col("lo") >= least) & (F.round(F.col("hi") - F.col("lo"), 12) <= spread)).alias("included"))


def add_missing_flags(df: DataFrame, features: list[str]) -> DataFrame:
    return df.withColumns({f"{f}_missing": F.col(f).isNull().cast("int") for f in features})


def present_columns(df: DataFrame, features: list[str]) -> list[str]:
    """The features with a value in these rows (one aggregate row comes to the driver)."""
    n = df.agg(*[F.count(f).alias(f) for f in features]).first()
    return [f for f in features if n[f]]


def columns_like(columns: list[str], prefixes: tuple = (), parts: tuple = ()) -> list[str]:
    """The columns that begin with one of the prefixes or hold one of the parts, in their order."""
    return [c for c in columns if c.startswith(tuple(prefixes)) or any(p in c for p in parts)]


def domain_profile(df: DataFrame, domains: dict[str, list[str]], region: str, unit: str, y: str, features: list[str]) -> DataFrame:
    """Rows, units, positives, controls and mean missingness; a row counts in every domain that has its region."""
    member = F.explode(F.array_compact(F.array(*[F.when(F.col(region).isin(*m), F.lit(d)) for d, m in domains.items()])))
    missing = sum((F.col(f).isNull().cast("int") for f in features), F.lit(0)) / len(features)
    return df.withColumn("domain", member).groupBy("domain").agg(
        F.count("*").alias("rows"), F.countDistinct(unit).alias("units"), F.count_if(F.col(y) == 1).alias("positives"),
        F.count_if(F.col(y) == 0).alias("controls"), F.avg(missing).alias("missingness"),
    )


def score_profile(df: DataFrame, by: list[str], p: str = "predicted_probability", threshold: float = 0.5) -> DataFrame:
    q = percentiles(df, by, p)
    return df.groupBy(*by).agg(
        F.min(p).alias("lo"), F.avg(p).alias("mean"), F.max(p).alias("hi"), F.avg((F.col(p) >= threshold).cast("int")).alias("above"),
    ).join(q, by)


def importance_shift(importance: DataFrame, shift: DataFrame, missing: DataFrame) -> DataFrame:
    """Features by importance with their shift and the change in availability."""
    return importance.join(shift, "feature").join(missing, "feature", "left").orderBy(F.col("importance").desc(), "feature")
