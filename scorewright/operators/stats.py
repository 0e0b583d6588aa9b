"""Standard errors, bootstrap, paired tests and power of score tables.

Moments are Spark aggregates; only one-row results meet the distribution
functions, which run on the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def clustered_stderr(df: DataFrame, by: list[str], value: str, cluster: str) -> DataFrame:
    """Mean with plain and clustered standard error for each group.

    Returns ``by..., n, mean, stderr, stderr_clustered``.  The clustered
    error is sqrt(s^2/n + sum over clusters of ((sum d)^2 - sum d^2) / n^2)
    with d the deviation from the group's mean: two aggregations, no self
    join.  Null values are left out; a null cluster is a cluster of its own
    kind; one value alone has null errors.
    """
    x = F.col(value).cast("double")
    per = (
        df.where(x.isNotNull())
        .groupBy(*by, cluster)
        .agg(F.count("*").alias("_n"), F.sum(x).alias("_s"), F.sum(x * x).alias("_q"))
    )
    n, s, q = F.sum("_n"), F.sum("_s"), F.sum("_q")
    mean = s / n
    # sum over clusters of (S_c - n_c m)^2, expanded
    squares = F.sum(F.col("_s") * F.col("_s")) - 2 * mean * F.sum(F.col("_s") * F.col("_n")) + mean * mean * F.sum(F.col("_n") * F.col("_n"))
    dev = q - n * mean * mean
    var = F.when(n > 1, F.greatest(dev, F.lit(0.0)) / (n - 1))
    return per.groupBy(*by).agg(
        n.alias("n"),
        mean.alias("mean"),
        F.sqrt(var / n).alias("stderr"),
        F.sqrt(F.greatest(var / n + (squares - dev) / (n * n), F.lit(0.0))).alias("stderr_clustered"),
    )


# --- distribution functions of one-row results -----------------------------------


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, from its tail."""
    value = 0.0
    for m in reversed(range(1, 400)):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        value = even / (1 + odd / (1 + value))
    first = -(a + b) * x / (a + 1)
    return 1 / (1 + first / (1 + value))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_cdf(t: float, df: float) -> float:
    """Distribution function of Student's t."""
    tail = 0.5 * incomplete_beta(df / 2, 0.5, df / (df + t * t))
    return 1 - tail if t > 0 else tail


def t_ppf(p: float, df: float) -> float:
    """Quantile of Student's t by bisection."""
    lo, hi = -1.0, 1.0
    while t_cdf(lo, df) > p:
        lo *= 2
    while t_cdf(hi, df) < p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_cdf(mid, df) < p else (lo, mid)
    return (lo + hi) / 2


# --- standard errors ---------------------------------------------------------------


def spread(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean, sample and population deviation, standard error, n."""
    v = F.col(value)
    return df.groupBy(*by).agg(
        F.avg(v).alias("mean"), F.stddev_samp(v).alias("stddev"), F.stddev_pop(v).alias("stddev_pop"),
        (F.stddev_samp(v) / F.sqrt(F.count(v))).alias("stderr"), F.count(v).alias("n"),
    )


def pooled_stderr(results: DataFrame, by: list[str], stderr: str = "stderr", n: str = "n") -> DataFrame:
    """Standard error of subtasks taken as one sample."""
    size = F.col(n)
    variance = F.sum((size - 1) * F.pow(stderr, 2) * size) / (F.sum(n) - F.count("*"))
    return results.groupBy(*by).agg(F.sqrt(variance / F.sum(n)).alias("pooled_stderr"), F.sum(n).alias("n"))


def combined_stderr(results: DataFrame, by: list[str], order: str, mean: str = "mean", stderr: str = "stderr", n: str = "n") -> DataFrame:
    """Standard error with the spread between subtasks, folded in ``order``.

    The fold depends on the order; it runs over the array of a group's
    subtasks (one row per subtask, not per sample).
    """
    item = F.struct(order, F.col(mean).cast("double").alias("m"), F.pow(stderr, 2).alias("v"), F.col(n).cast("double").alias("n"))
    rows = results.groupBy(*by).agg(F.sort_array(F.collect_list(item)).alias("_xs"))
    start = F.struct(F.get("_xs", 0)["m"].alias("m"), F.get("_xs", 0)["v"].alias("v"), F.get("_xs", 0)["n"].alias("n"))

    def step(a: Column, x: Column) -> Column:
        total = a["n"] + x["n"]
        within = ((a["n"] - 1) * a["v"] + (x["n"] - 1) * x["v"]) / (total - 1)
        between = a["n"] * x["n"] / (total * (total - 1)) * F.pow(a["m"] - x["m"], 2)
        return F.struct(((a["m"] * a["n"] + x["m"] * x["n"]) / total).alias("m"), (within + between).alias("v"), total.alias("n"))

    rest = F.slice("_xs", F.lit(2), F.greatest(F.size("_xs") - 1, F.lit(0)))
    return rows.select(*by, F.sqrt(F.aggregate(rest, start, step)["v"]).alias("combined_stderr"))


# --- bootstrap ---------------------------------------------------------------------


def poisson_weights(df: DataFrame, keys: list[str], iters: int, seed: int) -> DataFrame:
    """``df`` once for each replicate, with ``replicate`` and a Poisson(1)
    weight drawn from a hash of the keys; rows of weight 0 are left out.

    The draw belongs to the row, not to its place, so it is the same however
    the table is partitioned and after a lost executor.
    """
    steps = _poisson_steps()
    rows = df.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(iters - 1))))
    u = F.pmod(F.xxhash64(F.lit(seed), *keys, "replicate"), F.lit(1 << 40)) / float(1 << 40)
    weight = sum(((u >= s).cast("int") for s in steps), F.lit(0))
    return rows.withColumn("weight", weight).where("weight > 0")


# fixed values: the primes of the 64-bit hash that Spark's xxhash64 is
_PRIMES = tuple(np.uint64(p) for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
#: Rows weighed at once, and groups that a task holds before it hands them on.
_ROWS, _GROUPS = 2048, 256


def replicate_weights(state: np.ndarray, iters: int) -> np.ndarray:
    """Weights (rows x replicates) of ``poisson_weights`` for rows whose keys
    hash to ``state``: the hash goes on with the replicate's number."""
    turn = lambda h, n: h << np.uint64(n) | h >> np.uint64(64 - n)
    one, two, three, _, five = _PRIMES
    number = np.arange(iters, dtype=np.uint64) * one
    h = (state.view(np.uint64) + five + np.uint64(4))[:, None] ^ number[None]
    h = turn(h, 23) * two + three
    h = (h ^ h >> np.uint64(33)) * two
    h = (h ^ h >> np.uint64(29)) * three
    low = (h ^ h >> np.uint64(32)) & np.uint64((1 << 40) - 1)
    return np.searchsorted(np.array(_poisson_steps()) * float(1 << 40), low.astype(np.float64), side="right")


def _poisson_steps() -> list[float]:
    """Distribution function of Poisson(1)."""
    steps, p, total = [], math.exp(-1.0), 0.0
    for k in range(12):
        total += p
        steps.append(total)
        p /= k + 1
    return steps


def replicate_sums(df: DataFrame, by: list[str], keys: list[str], counters: dict[str, Column], iters: int, seed: int = 7) -> DataFrame:
    """``by..., replicate, weight, counters...``: sums of the counters over the
    rows, each as often as its weight in the replicate.

    No row is copied for a replicate.  A task keeps a table replicates x
    counters for each group it meets, which is a product of matrices for a
    batch of rows, and hands on one row for each group; so what is shuffled
    depends on tasks and groups, not on rows.  Weights are those of
    ``poisson_weights``.  Null counters count as 0.
    """
    names, wide = ["weight", *counters], len(counters) + 1
    each = _partial_sums(df, by, keys, counters, iters, seed).select("by", F.explode(F.sequence(F.lit(0), F.lit(iters - 1))).alias("replicate"), "sums")
    sums = each.select(*(F.col("by")[c].alias(c) for c in by), "replicate", *(F.get("sums", F.col("replicate") * wide + k).alias(n) for k, n in enumerate(names)))
    return sums.groupBy(*by, "replicate").agg(*(F.sum(n).alias(n) for n in names))


def _partial_sums(df: DataFrame, by: list[str], keys: list[str], counters: dict[str, Column], iters: int, seed: int) -> DataFrame:
    """``by, sums``: a row for each group that a task has seen, with its table
    replicates x (weight, counters)."""
    wide = len(counters) + 1
    state = F.xxhash64(F.lit(seed), *keys)
    values = [F.coalesce(c.cast("double"), F.lit(0.0)).alias(f"x{k}") for k, c in enumerate(counters.values())]
    rows = df.select(F.struct(*(F.col(c) for c in by), F.lit(0).alias("_one")).alias("by"), state.alias("state"), *values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[dict, np.ndarray]] = {}

        def done() -> pa.RecordBatch:
            groups = pa.array([g for g, _ in held.values()], kind)
            sums = pa.array([s.ravel() for _, s in held.values()], pa.list_(pa.float64()))
            return pa.RecordBatch.from_arrays([groups, sums], names=["by", "sums"])

        for whole in batches:
            kind = whole.schema.field(0).type
            for at in range(0, len(whole), _ROWS):
                batch = whole.slice(at, _ROWS)
                weights = replicate_weights(batch.column(1).to_numpy(), iters).astype(np.float64)
                given = np.stack([np.ones(len(batch)), *(batch.column(k).to_numpy() for k in range(2, wide + 1))], axis=1)
                places: dict[tuple, list[int]] = {}
                groups = batch.column(0).to_pylist()
                for k, g in enumerate(groups):
                    places.setdefault(tuple(g.values()), []).append(k)
                for g, own in places.items():
                    sums = weights[own].T @ given[own]
                    if g in held:
                        held[g][1][:] += sums
                    else:
                        held[g] = (groups[own[0]], sums)
                if len(held) > _GROUPS:
                    yield done()
                    held.clear()
        if held:
            yield done()

    schema = T.StructType([rows.schema["by"], T.StructField("sums", T.ArrayType(T.DoubleType()))])
    return rows.mapInArrow(run, schema)


def bootstrap_sums(df: DataFrame, by: list[str], keys: list[str], counters: dict[str, Column], statistic: Column, iters: int = 200, seed: int = 7, share: float = 0.95) -> DataFrame:
    """Bootstrap of a metric of summed counters: ``by..., boot_mean,
    boot_stderr, low, high``.  ``statistic`` is an expression over the sums of
    the counters and ``weight``, the rows of a replicate; replicates where it
    is null are left out."""
    sums = replicate_sums(df, by, keys, counters, iters, seed)
    return _summed_up(sums.select(*by, "replicate", statistic.alias("_m")), by, share)


def bootstrap(df: DataFrame, by: list[str], value: str, keys: list[str], iters: int = 200, seed: int = 7, share: float = 0.95) -> DataFrame:
    """Bootstrap of the mean: ``by..., boot_mean, boot_stderr, low, high``."""
    return bootstrap_sums(df, by, keys, {"_v": F.col(value)}, F.col("_v") / F.nullif(F.col("weight"), F.lit(0.0)), iters, seed, share)


def bootstrap_aggregate(df: DataFrame, by: list[str], keys: list[str], aggregate: Callable[[DataFrame, list[str]], DataFrame], name: str, iters: int = 100, seed: int = 7, share: float = 0.95, weighted: bool = False) -> DataFrame:
    """Bootstrap of any aggregate: ``aggregate(rows, by)`` gives column
    ``name``; a row of weight w stands w times or, with ``weighted``, once
    with the column ``weight``."""
    drawn = poisson_weights(df, keys, iters, seed)
    rows = drawn if weighted else drawn.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("weight")))).drop("_copy", "weight")
    return _summed_up(aggregate(rows, [*by, "replicate"]).withColumnRenamed(name, "_m"), by, share)


def _summed_up(per: DataFrame, by: list[str], share: float) -> DataFrame:
    tail = (1 - share) / 2
    return per.groupBy(*by).agg(
        F.avg("_m").alias("boot_mean"), F.stddev_samp("_m").alias("boot_stderr"),
        F.percentile("_m", tail).alias("low"), F.percentile("_m", 1 - tail).alias("high"),
    )


# --- two runs -----------------------------------------------------------------------


def paired_moments(cur: DataFrame, base: DataFrame, on: str, by: list[str], value: str = "score") -> DataFrame:
    """n, mean and standard error of the differences of matched rows, and the
    moments of both sides."""
    rows = cur.select(*by, on, F.col(value).cast("double").alias("_a")).join(base.select(on, F.col(value).cast("double").alias("_b")), on)
    d = F.col("_a") - F.col("_b")
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(d).alias("diff"), (F.stddev_samp(d) / F.sqrt(F.count("*"))).alias("stderr"),
        F.stddev_samp("_a").alias("std_a"), F.stddev_samp("_b").alias("std_b"), F.corr("_a", "_b").alias("corr"),
    )


def paired_ttest(cur: DataFrame, base: DataFrame, on: str, by: list[str], value: str = "score", share: float = 0.95) -> DataFrame:
    """Paired t-test by group: ``by..., n, diff, stderr, t, p, low, high``.

    Rows without a partner are left out.  A standard error of 0 gives p = 1
    for no difference and p = 0 for one.  One row per group meets the
    distribution functions, in Arrow batches.
    """
    moments = paired_moments(cur, base, on, by, value)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for n, diff, err in zip(pdf["n"], pdf["diff"], pdf["stderr"], strict=True):
                if n < 2 or err != err:
                    out.append((None, None, None, None))
                elif err == 0:
                    out.append((0.0 if diff == 0 else math.copysign(math.inf, diff), 1.0 if diff == 0 else 0.0, diff, diff))
                else:
                    t = diff / err
                    far = t_ppf(0.5 + share / 2, n - 1) * err
                    out.append((t, 2 * (1 - t_cdf(abs(t), n - 1)), diff - far, diff + far))
            yield pd.concat([pdf.reset_index(drop=True), pd.DataFrame(out, columns=["t", "p", "low", "high"], dtype="float64")], axis=1)

    kept = moments.select(*by, "n", "diff", "stderr")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", t double, p double, low double, high double"
    return kept.mapInPandas(run, schema)


def power(cur: DataFrame, base: DataFrame, on: str, effect: float, alpha: float = 0.05, target: float = 0.8, value: str = "score") -> DataFrame:
    """One row: required n for the effect, achieved power at the present n,
    smallest effect found at ``target`` power; spread and correlation come
    from the two score tables."""
    m = paired_moments(cur, base, on, [], value).first()
    z = NormalDist().inv_cdf
    a, b, c = m["std_a"] or 0.0, m["std_b"] or 0.0, m["corr"] if m["corr"] is not None else 0.0
    spread_ = math.sqrt(max(a * a + b * b - 2 * c * a * b, 0.0))
    both = z(1 - alpha / 2) + z(target)
    need = math.ceil((both * spread_ / effect) ** 2)
    err = spread_ / math.sqrt(m["n"]) if m["n"] else math.inf
    reach = 1.0 if err == 0 else NormalDist().cdf(abs(effect) / err - z(1 - alpha / 2))
    return cur.sparkSession.createDataFrame([(m["n"], spread_, need, reach, both * err)], "n long, std_diff double, required_n long, power double, detectable double")


def run_differences(a: DataFrame, b: DataFrame, on: list[str], value: str = "value") -> DataFrame:
    """Both values and their difference for each task; tasks of one run only
    have nulls on the other side."""
    both = a.select(*on, F.col(value).alias("value_a")).join(b.select(*on, F.col(value).alias("value_b")), on, "full_outer")
    return both.withColumn("difference", F.col("value_a") - F.col("value_b"))
