"""Running sums, numbers and exact percentiles over whole tables, by ranges of the order instead of one task."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnwatch.functions.storage import stored


def same(a: DataFrame, b: DataFrame, columns: list[str]) -> Column:
    """Equal columns, NULL equal to NULL."""
    return reduce(lambda x, c: x & a[c].eqNullSafe(b[c]), columns, F.lit(True))


def running(df: DataFrame, by: list[str], order: list, sums: dict[str, str | Column], following: str | None = None) -> DataFrame:
    """df plus, for each name of sums (which replaces a column of that name), the sum of its column over the group's rows up to this one, in order; and, with
    `following`, _next: that column's value in the row after.

    Rows are dealt by ranges of (by, order), so a group is as many tasks as it needs; each range sums its own rows and
    adds what the group's ranges before it hold. The written table keeps the ranges if a task runs again.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    r = df.withColumns({f"_s_{n}": F.col(c) if isinstance(c, str) else c for n, c in sums.items()})
    r = stored(r.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    firsts = [F.min_by(following, F.struct(*[F.col(f"_o{k}") for k in range(len(order))])).alias("_first")] if following else []
    parts = r.withColumns({f"_o{k}": c for k, c in enumerate(plain(order))} if following else {})
    parts = parts.groupBy(*by, "_part").agg(*[F.sum(f"_s_{n}").alias(f"_b_{n}") for n in sums], *firsts)
    up = W.partitionBy(*by).orderBy("_part")
    before = up.rowsBetween(W.unboundedPreceding, -1)
    offsets = parts.select(
        *[F.col(c).alias(f"_by_{c}") for c in by], F.col("_part").alias("_of"),
        *[F.coalesce(F.sum(f"_b_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums],
        *([F.lead("_first").over(up).alias("_after")] if following else []),
    )
    own = W.partitionBy(*by, "_part").orderBy(*order)
    r = r.withColumns(
        {
            f"_s_{n}": F.sum(f"_s_{n}").over(own.rowsBetween(W.unboundedPreceding, 0)) for n in sums
        } | ({"_next": F.lead(following).over(own)} if following else {})
    )
    on = reduce(lambda x, c: x & F.col(c).eqNullSafe(F.col(f"_by_{c}")), by, F.col("_part") == F.col("_of"))
    out = r.join(offsets, on)
    return out.select(
        *[c for c in df.columns if c not in sums], *[(F.col(f"_s_{n}") + F.col(f"_b_{n}")).alias(n) for n in sums],
        *([F.coalesce("_next", "_after").alias("_next")] if following else []),
    )


def plain(order: list[Column]) -> list[Column]:
    """Ascending columns only have a least row by themselves."""
    if any("DESC" in str(c).upper() for c in order):
        raise ValueError("following needs an ascending order")
    return order


def numbered(df: DataFrame, order: list, out: str) -> DataFrame:
    """df plus its rows' numbers from 1 in a total order."""
    return running(df, [], order, {out: F.lit(1)}).withColumn(out, F.col(out).cast("long"))


def percentiles(df: DataFrame, by: list[str], c: str, at, rows: str | None = None) -> DataFrame:
    """(by, q: array) of the exact percentiles of c, linear between neighbours; NULLs where a group has no value.

    Values are counted first and ranked by ranges; a group's rows never meet in one task. rows: a column of how many rows each
    stands for.
    """
    counts = df.where(F.col(c).isNotNull()).groupBy(*by, F.col(c).cast("double").alias("_v")).agg((F.sum(rows) if rows else F.count("*")).alias("_n"))
    ranked = running(counts, by, ["_v"], {"_upto": "_n"}, following="_v")
    size = F.coalesce(F.sum(F.when(F.col(c).isNotNull(), F.col(rows))), F.lit(0)) if rows else F.count(c)
    sizes = df.groupBy(*by).agg(size.alias("_all")).select(*[F.col(b).alias(f"_g_{b}") for b in by], "_all")
    on = reduce(lambda x, b: x & F.col(b).eqNullSafe(F.col(f"_g_{b}")), by, F.lit(True))
    met = ranked.join(sizes, on) if by else ranked.join(F.broadcast(sizes), how="cross")

    def value(p):
        place = F.lit(float(p)) * (F.col("_all") - 1)
        low = F.floor(place)
        here = (F.col("_upto") - F.col("_n") <= low) & (low < F.col("_upto"))
        above = F.when(low + 1 < F.col("_upto"), F.col("_v")).otherwise(F.coalesce("_next", "_v"))
        return F.max(F.when(here, F.col("_v") + (place - low) * (above - F.col("_v"))))

    found = met.groupBy(*[f"_g_{b}" for b in by]).agg(*[value(p).alias(f"_q{k}") for k, p in enumerate(at)])
    found = found.select(*[F.col(f"_g_{b}").alias(f"_h_{b}") for b in by], F.array(*[f"_q{k}" for k in range(len(at))]).alias("q"))
    none = F.array_repeat(F.lit(None).cast("double"), len(at))
    if not by:
        return found.select(F.coalesce("q", none).alias("q"))
    groups = sizes.join(found, reduce(lambda x, b: x & F.col(f"_g_{b}").eqNullSafe(F.col(f"_h_{b}")), by, F.lit(True)), "left")
    return groups.select(*[F.col(f"_g_{b}").alias(b) for b in by], F.coalesce("q", none).alias("q"))
