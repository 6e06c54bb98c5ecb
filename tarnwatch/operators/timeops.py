"""Point-in-time operators: grids, backward as-of joins, time-range windows, greedy spacing.

Every operator shuffles on the entity once. As-of joins are a union and a running last(), not a range join.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnwatch.functions.scalars import DAY_US, HOUR_US, from_us, us

#: Hours after which a source's last observation is stale.
MAX_AGE_H = {"weather": 48.0, "satellite": 720.0, "snow": 240.0, "gpm": 48.0}


def daily(start: Column, end: Column) -> Column:
    """All midnights from start to end, both included, as one array."""
    return F.when(start <= end, F.sequence(start.cast("timestamp_ntz"), end.cast("timestamp_ntz"), F.expr("interval 1 day")))


def reference_grid(entities: DataFrame, start: Column, end: Column, key: str = "lake_uid", ts: str = "reference_timestamp") -> DataFrame:
    """A row an entity and day. start and end are literals or columns of `entities`; spans of one entity are joined."""
    return days_of(entities.select(key, start.alias("_from"), end.alias("_to")), key, ts)


def days_of(spans: DataFrame, key: str, ts: str) -> DataFrame:
    """(key, ts): the days of any of a key's spans (key, _from, _to), each once. Spans are shuffled, not days."""
    own = spans.where("_from <= _to").groupBy(key).agg(F.collect_set(F.struct("_from", "_to")).alias("_spans"))
    days = F.array_distinct(F.flatten(F.transform("_spans", lambda s: daily(s["_from"], s["_to"]))))
    return own.select(key, F.explode(days).alias(ts))


def event_grid(
    events: DataFrame, before: int = 45, after: int = 45, key: str = "lake_uid", at: str = "event_ts", ts: str = "reference_timestamp",
) -> DataFrame:
    """The union of all days from `before` days before to `after` days after each event of an entity."""
    d = F.to_date(at)
    return days_of(
        events.where(F.col(at).isNotNull()).select(key, F.date_sub(d, before).alias("_from"), F.date_add(d, after).alias("_to")), key, ts,
    )


def asof(
    left: DataFrame, sources: dict[str, DataFrame], key: str = "lake_uid", left_ts: str = "reference_timestamp",
    ts: str = "observation_timestamp", tie: str = "observation_id",
) -> DataFrame:
    """left plus, for each source, a struct `name` of its latest row at or before the row's time (NULL if none).

    The row is picked, not its values: a NULL value of the latest row stays NULL. Equal times go by `tie` in its own
    type (numbers as numbers, text by code point), largest last. All sources share one union, one shuffle and one sort.
    """
    left_columns = left.columns
    # only rows of one source are compared, so sources whose ties have one type share a column
    types = {n: dict(df.dtypes)[tie] for n, df in sources.items()}
    ties = {t: f"_tie{k}" for k, t in enumerate(sorted(set(types.values())))}
    both = left.select(
        F.col(key).alias("_k"), us(left_ts).alias("_t"), F.lit(1).alias("_side"), *[F.lit(None).cast(t).alias(n) for t, n in ties.items()],
        F.struct(*left_columns).alias("_left"),
    )
    for name, df in sources.items():
        row = F.struct(*[c for c in df.columns if c != key])
        both = both.unionByName(
            df.select(
                F.col(key).alias("_k"), us(ts).alias("_t"), F.lit(0).alias("_side"), F.col(tie).alias(ties[types[name]]), row.alias(name),
            ),
            allowMissingColumns=True,
        )
    w = W.partitionBy("_k").orderBy("_t", "_side", *ties.values()).rowsBetween(W.unboundedPreceding, 0)
    seen = both.withColumns({n: F.last(n, ignorenulls=True).over(w) for n in sources})
    return seen.where("_side = 1").select("_left.*", *sources)


def align(
    grid: DataFrame, sources: dict[str, DataFrame], max_age_h: dict | None = None, key: str = "lake_uid", ref: str = "reference_timestamp",
    ts: str = "observation_timestamp", tie: str = "observation_id",
) -> DataFrame:
    """Backward alignment with staleness: per source its time, age, flags and payload (NULL when stale).

    actual: age <= 24 h; stale: age beyond the source's limit; both false where the source has no row.
    """
    ages = MAX_AGE_H | (max_age_h or {})
    out = asof(grid, sources, key, ref, ts, tie)
    columns = list(grid.columns)
    picked = [F.col(c) for c in columns]
    for name, df in sources.items():
        at = F.col(name)[ts]
        age = (us(ref) - us(at)) / float(HOUR_US)
        stale = F.coalesce(age > ages.get(name, 48.0), F.lit(False))
        picked += [
            at.alias(f"{name}_timestamp"), age.alias(f"{name}_observation_age_hours"),
            F.coalesce(age <= 24, F.lit(False)).alias(f"actual_{name}_observation"), stale.alias(f"{name}_stale"),
            F.col(name)[tie].alias(f"{name}_observation_id"),
        ]
        picked += [F.when(~stale, F.col(name)[c]).alias(f"{name}_{c}") for c in df.columns if c not in (key, ts, tie)]
    return out.select(*picked)


def window(key: str, ts: str, days: float, closed_left: bool = False) -> W:
    """(t - days, t] of an entity, or [t - days, t]."""
    width = int(days * DAY_US)
    return W.partitionBy(key).orderBy(us(ts)).rangeBetween(-width if closed_left else 1 - width, 0)


def rolling(df: DataFrame, specs: dict[str, tuple[str, str, float]], key: str = "lake_uid", ts: str = "observation_timestamp") -> DataFrame:
    """Adds name = (function, column, days) over (t - days, t]; NULL where the frame holds no value."""
    f = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count}
    return df.withColumns({n: f[kind](c).over(window(key, ts, days)) for n, (kind, c, days) in specs.items()})


def change(
    df: DataFrame, specs: dict[str, tuple[str, float]], key: str = "lake_uid", ts: str = "observation_timestamp",
    tie: str = "observation_id",
) -> DataFrame:
    """Adds name = value - value of the latest row at or before t - days, as a RANGE frame (no self-join)."""
    def before(c, days):
        # of rows of one time the largest tie is the latest
        w = W.partitionBy(key).orderBy(us(ts)).rangeBetween(W.unboundedPreceding, -int(days * DAY_US))
        return F.max(F.struct(us(ts).alias("t"), F.col(tie).alias("tie"), F.col(c).alias("v"))).over(w)["v"]

    return df.withColumns({n: F.col(c) - before(c, days) for n, (c, days) in specs.items()})


def trend(
    df: DataFrame, specs: dict[str, tuple[str, float]], key: str = "lake_uid", ts: str = "observation_timestamp", least: int = 3,
) -> DataFrame:
    """Adds name = least-squares slope a day over [t - days, t], NULL for fewer than `least` values."""
    x = us(ts) / float(DAY_US)
    out = {}
    for n, (c, days) in specs.items():
        w = window(key, ts, days, True)
        out[n] = F.when(F.count(c).over(w) >= least, F.regr_slope(F.col(c), x).over(w))
    return df.withColumns(out)


def greedy_spacing(df: DataFrame, hours: float = 24, key: str = "lake_uid", ts: str = "reference_timestamp") -> DataFrame:
    """(key, ts): per entity the times at least `hours` after the last kept one, the first kept. NULL times are none.

    Each choice depends on the last, so no lag() does it. Entities' times are sorted within partitions and read in
    batches that carry only the last entity and time kept, so an entity's history is never held.
    """
    gap = int(hours * HOUR_US)
    times = df.select(F.col(key).alias("_k"), us(ts).alias("_t")).where("_t is not null")
    sorted_ = times.repartition("_k").sortWithinPartitions("_k", "_t")

    def keep(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        now, last = object(), None
        for b in batches:
            k, t = b.column(0), b.column(1).to_numpy()
            if not len(t):
                continue
            change = pc.fill_null(pc.not_equal(k[1:], k[:-1]), False).to_numpy(zero_copy_only=False) if len(t) > 1 else np.zeros(0, bool)
            nulls = pc.is_null(k).to_numpy(zero_copy_only=False)
            starts = np.concatenate(([0], np.flatnonzero(change | (nulls[1:] != nulls[:-1])) + 1, [len(t)]))
            kept = []
            for i, j in zip(starts[:-1], starts[1:], strict=True):
                name = k[int(i)].as_py()
                last = last if name == now else None
                now, at = name, int(i)
                while True:
                    at = at if last is None else int(i) + int(np.searchsorted(t[i:j], last + gap))
                    if at >= j:
                        break
                    kept.append(at)
                    last = int(t[at])
            yield b.take(pa.array(kept, pa.int64()))

    kept = sorted_.mapInArrow(keep, sorted_.schema)
    return kept.select(F.col("_k").alias(key), from_us("_t").alias(ts))


def first_rows(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n whole rows of each group in a declared order."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")
