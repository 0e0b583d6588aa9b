"""Streaming forms of the request and reward aggregates.

Event time columns are ``ts`` (timestamp).  Rows later than the watermark are
dropped by Spark's rule; state is bounded by the watermark or by a fixed
number of rows per key.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from scorewright.functions.keys import valid_response
from scorewright.operators.rollouts import saturated


def tail_responses(stream: DataFrame, watermark: str = "10 minutes", key: str = "cache_key") -> DataFrame:
    """Valid responses, the first of each cache key within the watermark."""
    rows = stream.where(valid_response("kind", "text", "ll"))
    return rows.withWatermark("ts", watermark).dropDuplicatesWithinWatermark([key])


def request_windows(stream: DataFrame, size: str = "5 minutes", slide: str | None = None, watermark: str = "10 minutes") -> DataFrame:
    """Per window: requests, failure and rate-limit rates, p95 latency."""
    frame = F.window("ts", size, slide) if slide else F.window("ts", size)
    grouped = stream.withWatermark("ts", watermark).groupBy(frame.alias("w"))
    out = grouped.agg(
        F.count("*").alias("n"), F.avg(F.col("failed").cast("double")).alias("failure_rate"),
        F.avg(F.col("limited").cast("double")).alias("limit_rate"), F.percentile_approx("latency", 0.95, 10_000).alias("p95"),
    )
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "failure_rate", "limit_rate", "p95")


def running_scores(stream: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """Running mean and count for each group (update mode)."""
    return stream.groupBy(*by).agg(F.avg(score).alias("mean"), F.count(score).alias("n"))


def rollout_sessions(stream: DataFrame, gap: str = "10 minutes", watermark: str = "10 minutes", key: str = "conv_id") -> DataFrame:
    """Turns of a conversation in sessions closed by inactivity."""
    grouped = stream.withWatermark("ts", watermark).groupBy(F.session_window("ts", gap).alias("w"), key)
    out = grouped.agg(F.count("*").alias("n_turns"), F.sort_array(F.collect_list(F.struct("ts", "role", "text"))).alias("turns"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_turns", "turns")


#: The state store that keyed lists and timers need.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB; the session's
    setting comes back afterwards (a started query keeps its own)."""
    before = spark.conf.get(STORE[0], None)
    spark.conf.set(*STORE)
    try:
        yield
    finally:
        spark.conf.set(STORE[0], before) if before else spark.conf.unset(STORE[0])


def _figures(past: np.ndarray, new: np.ndarray, n: int) -> np.ndarray:
    """Rolling mean, deviation, saturation, slope and count of each new row
    (mean, std, flag) over the last ``n`` rows; NaN values do not count."""
    rows = np.concatenate([np.full((n - 1, 3), np.nan), past, new])
    windows = np.lib.stride_tricks.sliding_window_view(rows, n, axis=0)[-len(new) :] if len(new) else np.zeros((0, 3, n))
    held = ~np.isnan(windows)
    many = held.sum(axis=2)
    means = np.divide(np.where(held, windows, 0).sum(axis=2), many, out=np.full(many.shape, np.nan), where=many > 0)
    x = np.where(held[:, 0], np.arange(n, dtype=float), 0)
    y = np.where(held[:, 0], windows[:, 0], 0)
    k = many[:, 0]
    over = k * (x * x).sum(axis=1) - x.sum(axis=1) ** 2
    slope = np.divide(k * (x * y).sum(axis=1) - x.sum(axis=1) * y.sum(axis=1), over, out=np.zeros(len(k)), where=(k >= 5) & (over > 0))
    return np.column_stack([means, slope, k])


#: A waiting step, packed; microseconds of a bucket of them; rows whose figures are made at once, about.
STEP = np.dtype([("ts", "<i8"), ("step", "<i8"), ("mean", "<f8"), ("std", "<f8"), ("flag", "<f8")])
BUCKET, AT_ONCE = 3_600_000_000, 10_000


class RewardFigures(StatefulProcessor):
    """State of a reward: steps that the watermark has not passed, and the last
    ``n - 1`` that it has.  A timer at the earliest waiting step wakes the key
    when the watermark passes it; what is behind the watermark then is taken in
    the order of event time and step, whatever batch it came in.

    Waiting steps lie packed in buckets of event time, and a few buckets at a
    time are read and come out, so a worker never holds all that waits.
    """

    def __init__(self, key: str, n: int) -> None:
        self.key, self.n = key, n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "bucket bigint, part bigint", "steps binary")
        self.parts = handle.getValueState("parts", "n bigint")
        self.past = handle.getListState("past", "mean double, std double, flag double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first, part = None, self.parts.get()[0] if self.parts.exists() else 0
        for pdf in rows:
            if not len(pdf):
                continue
            found = np.zeros(len(pdf), STEP)
            found["ts"] = pdf["ts"].astype("datetime64[us]").astype("int64")
            for c in STEP.names[1:]:
                found[c] = pdf[c].astype(STEP[c])
            bucket = found["ts"] // BUCKET
            order = np.argsort(bucket, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
                self.waiting.updateValue((int(bucket[own[0]]), part), (found[own].tobytes(),))
                part += 1
            first = min(int(found["ts"].min()), first if first is not None else int(found["ts"].min()))
        if first is not None:
            self.parts.update((part,))
            self.handle.registerTimer(first // 1000 + 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        keys = sorted((int(k[0]), int(k[1])) for k in self.waiting.keys())
        past = np.array(list(self.past.get()), float).reshape(-1, 3)
        held: list[np.ndarray] = []
        later = next((b * BUCKET for b, _ in keys if b * BUCKET > passed), None)
        for bucket, own in groupby((k for k in keys if k[0] * BUCKET <= passed), key=lambda k: k[0]):
            own = list(own)
            steps = np.concatenate([np.frombuffer(self.waiting.getValue(k)[0], STEP) for k in own])
            for k in own:
                self.waiting.removeKey(k)
            rest = steps[steps["ts"] > passed]
            if len(rest):  # only in the bucket that the watermark is in
                self.waiting.updateValue(own[0], (rest.tobytes(),))
                later = int(rest["ts"].min())
            ready = steps[steps["ts"] <= passed]
            held.append(ready[np.lexsort((ready["step"], ready["ts"]))])
            if sum(map(len, held)) >= AT_ONCE:
                made, past = self._made(key[0], past, np.concatenate(held))
                held = []
                yield made
        made, past = self._made(key[0], past, np.concatenate([*held, np.zeros(0, STEP)]))
        yield made
        if len(past):
            self.past.put([tuple(map(float, r)) for r in past])
        if later is not None:
            self.handle.registerTimer(later // 1000 + 1)

    def _made(self, name, past: np.ndarray, steps: np.ndarray) -> tuple[pd.DataFrame, np.ndarray]:
        """Figures of steps in order, and what comes before the next ones."""
        frames = []
        for at in range(0, max(len(steps), 1), AT_ONCE):
            some = steps[at : at + AT_ONCE]
            new = np.column_stack([some["mean"], some["std"], some["flag"]])
            made = _figures(past, new, self.n)
            past = np.concatenate([past, new])[-(self.n - 1) :] if self.n > 1 else past[:0]
            columns = [pd.Series([name] * len(some), dtype=object), some["step"], *new[:, :2].T, *made[:, :4].T, made[:, 4].astype("int64")]
            frames.append(pd.DataFrame(dict(zip(("reward", "step", "mean", "std", "rolling_mean", "rolling_std", "saturation", "slope", "n"), columns, strict=True))))
        return pd.concat(frames, ignore_index=True), past

    def close(self) -> None:
        pass


def rolling_rewards(stream: DataFrame, n: int = 50, watermark: str = "10 minutes", key: str = "reward") -> DataFrame:
    """Figures of the last ``n`` steps of each reward, as ``rolling_stats`` has
    them, one row for each step that the watermark has passed.

    ``stream`` has key, step, mean, std and ``ts``.  Steps count in the order
    of event time, then step, also where they come out of order over several
    batches; those that come after the watermark are dropped.  Start the query
    within ``keyed_state``.  A null mean or deviation does not count.
    """
    flag = saturated("mean", "std", F.when(F.col(key) == "tool", 1.0).otherwise(0.0))
    rows = stream.select(F.col(key).alias("reward"), "step", "mean", "std", flag.alias("flag"), "ts").withWatermark("ts", watermark)
    found = rows.groupBy("reward").transformWithStateInPandas(
        statefulProcessor=RewardFigures(key, n),
        outputStructType="reward string, step bigint, mean double, std double, rolling_mean double, rolling_std double, saturation double, slope double, n bigint",
        outputMode="Append",
        timeMode="EventTime",
    )
    return found.withColumnRenamed("reward", key)
