"""Exact trailing features of a stream: each row's windows end at the row itself, as in the batch features, not at a bucket's edge.

A row is given out once the watermark has passed it, for until then an earlier row may still come. An entity's state is its
rows by day: those that wait, and those of the widest window before the watermark; of older ones only the last is kept.
"""

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tarnwatch.functions.scalars import DAY_US

KINDS = ("mean", "sum", "min", "max", "count")
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks(spark: SparkSession):
    """The state store that transformWithState needs, for queries started within."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def extremes(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, f) -> np.ndarray:
    """f over x[lo:hi] for each pair (none empty): two spans of the largest power of two that fits cover a pair's own."""
    out, level = np.empty(len(lo)), x
    size = np.frexp((hi - lo).astype(float))[1] - 1
    for b in range(int(size.max()) + 1 if len(size) else 0):
        m = size == b
        out[m] = f(level[lo[m]], level[hi[m] - (1 << b)])
        level = f(level[: -(1 << b)], level[1 << b :])
    return out


def total(x: np.ndarray, null: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Sums over x[lo:hi] without nulls, by running sums; what is not finite counts only in the windows that hold it."""

    def running(v):
        c = np.concatenate([[0], np.cumsum(v)])
        return c[hi] - c[lo]

    out = running(np.where(np.isfinite(x) & ~null, x, 0.0))
    for odd, v in ((np.isnan(x) & ~null, np.nan), (x == np.inf, np.inf), (x == -np.inf, -np.inf)):
        if odd.any():
            out = out + np.where(running(odd.astype(np.int64)) > 0, v, 0.0)
    return out


def window(kind: str, x: np.ndarray, null: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, whether there is one) of one feature; NaN is larger than all numbers, as in Spark."""
    n = np.concatenate([[0], np.cumsum(~null)])
    n = n[hi] - n[lo]
    if kind == "count":
        return n.astype(float), np.ones(len(n), bool)
    if kind == "min":
        return extremes(np.where(null, np.nan, x), lo, hi, np.fmin), n > 0
    if kind == "max":
        return extremes(np.where(null, -np.inf, x), lo, hi, np.maximum), n > 0
    s = total(x, null, lo, hi)
    return (s if kind == "sum" else s / np.maximum(n, 1)), n > 0


def rank(row: tuple) -> tuple:
    """Order of an entity's rows: time, id, values; null before all, NaN after all."""
    return row[0], *((v is not None, v != v, 0 if v is None or v != v else v) for v in row[1:])


class Trailing(StatefulProcessor):
    """State: `days`, an entity's rows, an element a day and batch; `mark`, up to where rows were given out, when the timer rings,
    the last row dropped. A batch appends what it has in one call, whatever its days: each call crosses to the JVM and back."""

    def __init__(self, columns: list[str], windows: dict, changes: dict, row: str) -> None:
        self.columns, self.windows, self.changes, self.row = columns, windows, changes, row
        self.span = max([d for _, _, d in windows.values()] + [d for _, d in changes.values()]) * DAY_US

    def init(self, handle) -> None:
        self.handle = handle
        self.days = handle.getListState("days", f"day long, rows array<{self.row}>")
        self.mark = handle.getValueState("mark", f"closed long, timer long, last {self.row}")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        closed, timer, last = self.marked()
        new: dict[int, list] = {}
        for r in rows:
            if closed is None or r["_t"] > closed:
                new.setdefault(r["_t"] // DAY_US, []).append((r["_t"], r["_id"], *[r[c] for c in self.columns]))
        if new:
            self.days.appendList(list(new.items()))
            at = self.ring(timer, min(t for d in new.values() for t, *_ in d))
            if at != timer:
                self.mark.update((closed, at, last))
        return iter(())

    def marked(self) -> tuple:
        closed, timer, last = self.mark.get() or (None, None, None)
        return closed, timer, None if last is None else tuple(last)

    def ring(self, timer: int | None, t: int) -> int:
        """One timer an entity, at its earliest row that waits."""
        at = -(-t // 1000)
        if timer is not None and timer <= at:
            return timer
        if timer is not None:
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(at)
        return at

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        closed, timer, last = self.marked()
        now = timerValues.getCurrentWatermarkInMs() * 1000
        days: dict[int, list] = {}
        for day, held in self.days.get():
            days.setdefault(day, []).extend(tuple(r) for r in held)
        rows = sorted((r for held in days.values() for r in held), key=rank)
        if last is not None:
            rows.insert(0, last)
        due = [k for k, r in enumerate(rows) if (closed is None or r[0] > closed) and r[0] <= now]
        if due:
            yield from self.given(key[0], rows, np.array(due))
        gone = [d for d in days if (d + 1) * DAY_US <= now - self.span]
        for d in gone:
            last = max(days[d] if last is None else [last, *days[d]], key=rank)
            del days[d]
        if gone and days:
            self.days.put(list(days.items()))
        elif gone:
            self.days.clear()
        later = next((r[0] for r in rows if r[0] > now), None)
        self.mark.update((now, None if later is None else self.ring(None, later), last))

    def given(self, entity, rows: list[tuple], due: np.ndarray) -> Iterator[Row]:
        t = np.array([r[0] for r in rows], np.int64)
        null = {c: np.array([r[2 + k] is None for r in rows]) for k, c in enumerate(self.columns)}
        x = {c: np.array([np.nan if r[2 + k] is None else r[2 + k] for r in rows], float) for k, c in enumerate(self.columns)}
        hi = np.searchsorted(t, t[due], "right")
        out = {}
        for name, (kind, c, days) in self.windows.items():
            lo = np.searchsorted(t, t[due] - int(days * DAY_US), "right")
            out[name] = window(kind, x[c], null[c], lo, hi)
        for name, (c, days) in self.changes.items():
            at = np.searchsorted(t, t[due] - int(days * DAY_US), "right") - 1
            out[name] = x[c][due] - x[c][at], (at >= 0) & ~null[c][at] & ~null[c][due]
        values = {n: [v if ok else None for v, ok in zip(v.tolist(), ok.tolist())] for n, (v, ok) in out.items()}
        for j, k in enumerate(due.tolist()):
            yield Row(_k=entity, _id=rows[k][1], _t=rows[k][0], **{n: v[j] for n, v in values.items()})


def trailing(
    stream: DataFrame, windows: dict[str, tuple[str, str, float]], changes: dict[str, tuple[str, float]] | None = None, late: str = "2 days",
    key: str = "lake_uid", ts: str = "observation_timestamp", id: str = "observation_id",
) -> DataFrame:
    """key, id, ts and a double a feature of every row: windows name = (mean, sum, min, max or count; column; days) over
    (t - days, t], changes name = (column, days) against the last row at or before t - days, as `timeops.rolling` and `change`.

    Rows come out in append mode when the watermark passes them. Rows behind the watermark that the batch
    before the last one left are dropped, as are those without a time; a null key is an entity. Rows of one time see each other, repeated rows count twice (`deduplicated` first).
    No value in a window gives NULL. One entity's days are in one task: those of its widest window and those not yet passed.
    Start the query within `rocks()`.
    """
    changes = changes or {}
    if bad := {k for k, _, _ in windows.values()} - set(KINDS):
        raise ValueError(f"unknown features {sorted(bad)}")
    columns = sorted({c for _, c, _ in windows.values()} | {c for c, _ in changes.values()})
    slots = [f"_v{k}" for k in range(len(columns))]
    slot = dict(zip(columns, slots))
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}
    rows = stream.where(F.col(ts).isNotNull()).withWatermark(ts, late).select(
        F.col(key).alias("_k"), F.col(id).alias("_id"), F.col(ts).alias("_ts"), F.unix_micros(ts).alias("_t"),
        *[F.col(c).cast("double").alias(slot[c]) for c in columns],
    )
    row = f"struct<t:bigint,id:{kinds[id]}," + ",".join(f"{s}:double" for s in slots) + ">"
    names = {n: f"_f{k}" for k, n in enumerate([*windows, *changes])}
    made = Trailing(
        slots, {names[n]: (k, slot[c], d) for n, (k, c, d) in windows.items()}, {names[n]: (slot[c], d) for n, (c, d) in changes.items()}, row,
    )
    result = f"_k {kinds[key]}, _id {kinds[id]}, _t bigint, " + ", ".join(f"{n} double" for n in names.values())
    out = rows.groupBy("_k").transformWithState(made, result, "Append", "EventTime")
    return out.select(
        F.col("_k").alias(key), F.col("_id").alias(id), F.timestamp_micros("_t").alias(ts), *[F.col(s).alias(n) for n, s in names.items()],
    )
