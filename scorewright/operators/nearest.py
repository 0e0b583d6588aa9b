"""Mean distances to the k nearest, and the dense core of clusters."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorewright.operators.aggregate import at_rank
from scorewright.sources.staging import staged

#: Places of one cell that meet those of another at once (about, by hash); rows of a batch of candidates.
PIECE, ROWS = 256, 1 << 17
#: What a distance of numpy may differ from one of the JVM, and more.
SLACK = 1 + 1e-9


def _same(a: DataFrame, b: DataFrame, by: list[str]) -> Column:
    return reduce(and_, (a[c].eqNullSafe(b[c]) for c in by))


def _meet(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Rows of ``a`` with the other columns of ``b``; keys may be null."""
    b = b.withColumnsRenamed({c: f"_{c}_" for c in keys})
    return a.join(b, reduce(and_, (F.col(c).eqNullSafe(F.col(f"_{c}_")) for c in keys)), how).drop(*(f"_{c}_" for c in keys))


def _dealt(rows: DataFrame) -> DataFrame:
    """A staged table for work that costs more than reading it, dealt to as many tasks as run at once."""
    tasks = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= tasks else rows.repartition(tasks)


def _listed(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``keys..., {name}x, {name}y, {name}c`` as arrays and the box of the places: one row for each piece."""
    ends = [f(c).alias(f"{name}{e}{c}") for c in "xy" for e, f in (("lo", F.min), ("hi", F.max))]
    lists = rows.groupBy(*keys).agg(F.collect_list(F.struct("x", "y", "c")).alias("_l"), *ends)  # a piece
    return lists.select(*keys, *(F.col(f"_l.{c}").alias(f"{name}{c}") for c in "xyc"), *(f"{name}{e}{c}" for c in "xy" for e in ("lo", "hi")))


def _cut(lists: pa.Array) -> list[np.ndarray]:
    ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    return np.split(lists.flatten().to_numpy(zero_copy_only=False), ends[:-1])


def _reaches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The k-th distance from each place of ``a`` to those of ``o``, infinite if ``o`` has fewer points."""
    for batch in batches:
        if not batch.num_rows:
            continue
        found = []
        for k, ax, ay, ox, oy, oc in zip(batch.column("k").to_pylist(), *(_cut(batch.column(c)) for c in ("ax", "ay", "ox", "oy", "oc")), strict=True):
            if oc.sum() < k:
                found.append(np.full(len(ax), np.inf))
                continue
            with np.errstate(invalid="ignore"):
                d = np.hypot(ax[:, None] - ox, ay[:, None] - oy)
            order = np.argsort(d, axis=1)
            at = (np.cumsum(oc[order], axis=1) >= k).argmax(axis=1)
            found.append(d[np.arange(len(ax)), order[np.arange(len(ax)), at]])
        reach = pa.ListArray.from_arrays(np.cumsum([0, *map(len, found)]).astype(np.int32), np.concatenate(found))
        names = [c for c in batch.schema.names if c not in ("ox", "oy", "oc")]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), reach], names=[*names, "reach"])


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places of ``a`` beside those of ``o`` within reach, the k nearest at most but for equal distances."""
    for batch in batches:
        if not batch.num_rows:
            continue
        own = [c for c in batch.schema.names if c not in ("ax", "ay", "ac", "reach", "ox", "oy", "oc")]
        names, found, held = [*own, "x", "y", "own", "ox", "oy", "oc"], [], 0

        def packed(found: list) -> pa.RecordBatch:
            at, *columns = (np.concatenate(c) for c in zip(*found, strict=True))
            return pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(at)) for c in own), *map(pa.array, columns)], names=names)

        lists = (_cut(batch.column(c)) for c in ("ax", "ay", "ac", "reach", "ox", "oy", "oc"))
        for row, (k, ax, ay, ac, reach, ox, oy, oc) in enumerate(zip(batch.column("k").to_pylist(), *lists, strict=True)):
            with np.errstate(invalid="ignore"):
                d = np.hypot(ax[:, None] - ox, ay[:, None] - oy)
            if len(ox) > k:
                reach = np.minimum(reach, np.partition(d, k - 1, axis=1)[:, k - 1])
            a, o = np.nonzero(~(d > (reach * SLACK)[:, None]))
            found.append((np.full(len(a), row), ax[a], ay[a], ac[a], ox[o], oy[o], oc[o]))
            held += len(a)
            if held >= ROWS:
                yield packed(found)
                found, held = [], 0
        if held:
            yield packed(found)


def nearest_mean(points: DataFrame, by: list[str], k: Column, axes: tuple[str, str] = ("x", "y")) -> DataFrame:
    """``by..., x, y, n, far``: for every place of a group the mean distance to
    the ``k`` - 1 nearest other points, its own doubles among them.

    ``k`` is an expression over ``n``, the points of the group; groups of
    fewer points are left out.  Equal points are one place with a count.  The
    square around a group is halved level by level; a place belongs to the
    finest cell that still holds k points.  The k-th of them is no farther than
    the cell's diagonal, so the 25 cells around hold the k nearest.  Sparse
    places look in wide cells and dense ones in narrow cells.  The places of a
    cell meet those around in pieces of bounded length (Arrow batches), and
    only what lies within the k-th distance of the own cell is ranked, exactly.
    No task holds a group.
    """
    x, y = axes
    spots = points.select(*by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x is not null and y is not null")
    spots = staged(spots.groupBy(*by, "x", "y").agg(F.count("*").alias("c")), "spots")
    sizes = spots.groupBy(*by).agg(F.sum("c").alias("n"), F.min("x").alias("_x"), F.min("y").alias("_y"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("_s"))
    sizes = staged(sizes.withColumn("k", k.cast("long")).where("k > 1 and n >= k"), "sizes")
    most = sizes.agg(F.max("n")).first()[0] or 1
    finest = min(40, 6 + math.ceil(math.log2(most) / 2))
    part = lambda c: F.when(F.col("_s") > 0, F.least(F.floor((F.col(c) - F.col(f"_{c}")) / F.col("_s") * (1 << finest)), F.lit((1 << finest) - 1))).otherwise(F.lit(0)).cast("long")
    rows = spots.join(sizes, _same(spots, sizes, by)).select(*(spots[c] for c in by), "x", "y", "c", "n", "k", part("x").alias("cx"), part("y").alias("cy"))
    rows = _dealt(staged(rows, "cells"))

    # the finest level whose cell has k points, for each finest cell
    place = [*by, "j", "ux", "uy"]
    up = lambda c, j: F.expr(f"shiftright({c}, {finest} - {j})")
    cells = rows.groupBy(*by, "cx", "cy", "k").agg(F.sum("c").alias("c"), F.count("*").alias("places"))
    every = cells.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(finest)))).withColumns({"ux": up("cx", "j"), "uy": up("cy", "j")})
    held = staged(every.groupBy(*place).agg(F.sum("c").alias("held"), F.any_value("k").alias("k"), F.sum("places").alias("there")), "held")
    full = held.where("held >= k")
    level = _meet(every, full, place, "left_semi").groupBy(*by, "cx", "cy").agg(F.max("j").alias("j"), F.any_value("places").alias("places"))
    level = staged(level.withColumns({"ux": up("cx", "j"), "uy": up("cy", "j")}), "levels")
    crowd = level.groupBy(*place).agg(F.sum("places").alias("asking"))

    # the places of a cell that look at its level, in pieces
    piece = lambda n: F.pmod(F.xxhash64("x", "y"), F.ceil(F.col(n) / PIECE)).alias("piece")
    low = _meet(level, crowd, place).drop("places")
    asking = _meet(rows, low, [*by, "cx", "cy"]).select(*place, "x", "y", "c", "k", piece("asking"))
    asks = _dealt(staged(_listed(asking, [*place, "piece", "k"], "a"), "asking"))

    # what lies in the 25 cells around, in pieces
    around = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-2, 3) for b in range(-2, 3)))
    looked = crowd.withColumn("o", F.explode(around)).select(*by, "j", (F.col("ux") + F.col("o.a")).alias("ux"), (F.col("uy") + F.col("o.b")).alias("uy")).distinct()
    looked = _meet(held, looked, place, "left_semi").select(*place, "there")
    levels = sorted(r[0] for r in level.select("j").distinct().collect()) or [0]
    lying = rows.withColumn("j", F.explode(F.array(*map(F.lit, levels)))).withColumns({"ux": up("cx", "j"), "uy": up("cy", "j")})
    lying = _meet(lying, looked, place).select(*place, "x", "y", "c", piece("there"))
    there = staged(_listed(lying, [*place, "piece"], "o"), "there")

    # the k-th distance in a place's own cell, then all that may be nearer
    asks = _meet(asks.drop("piece"), there.where("piece = 0").select(*place, "ox", "oy", "oc"), place, "left")
    kept = [f for f in asks.schema if f.name not in ("ox", "oy", "oc")]
    asks = asks.mapInArrow(_reaches, T.StructType([*kept, T.StructField("reach", T.ArrayType(T.DoubleType()))])).withColumn("most", F.array_max("reach"))
    asks = asks.withColumn("o", F.explode(around)).withColumns({"ux": F.col("ux") + F.col("o.a"), "uy": F.col("uy") + F.col("o.b")})
    gap = lambda x: F.nanvl(F.greatest(F.col(f"alo{x}") - F.col(f"ohi{x}"), F.col(f"olo{x}") - F.col(f"ahi{x}"), F.lit(0.0)), F.lit(0.0))
    met = _meet(asks, there, place).where(F.greatest(gap("x"), gap("y")) <= F.col("most") * SLACK)
    met = met.select(*by, "k", "ax", "ay", "ac", "reach", "ox", "oy", "oc")
    fields = [f for f in met.schema if f.name in by or f.name == "k"]
    fields += [T.StructField(c, T.LongType() if c in ("own", "oc") else T.DoubleType()) for c in ("x", "y", "own", "ox", "oy", "oc")]
    both = met.mapInArrow(_candidates, T.StructType(fields))
    both = both.select(*by, "x", "y", "own", "k", F.hypot(F.col("ox") - F.col("x"), F.col("oy") - F.col("y")).alias("d"), "oc")
    order = Window.partitionBy(*by, "x", "y").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)  # k of each piece at most, but for equal distances
    ranked = both.withColumn("upto", F.sum("oc").over(order)).where("upto - oc < k")
    weight = F.least(F.col("oc"), F.col("k") - (F.col("upto") - F.col("oc")))
    return ranked.groupBy(*by, "x", "y").agg(F.any_value("own").alias("n"), (F.sum(weight * F.col("d")) / (F.any_value("k") - 1)).alias("far"))


def _percentile(df: DataFrame, by: list[str], value: str, share: float, name: str) -> DataFrame:
    """The share's quantile of a group, between two ranks in proportion."""
    at = lambda n: (n - 1) * share
    low = at_rank(df, by, value, lambda n: F.floor(at(n)) + 1, "_a")
    high = at_rank(df, by, value, lambda n: F.ceil(at(n)) + 1, "_b").withColumnsRenamed({c: f"_h{c}" for c in by})
    n = df.groupBy(*by).agg(F.count(value).alias("_n")).withColumnsRenamed({c: f"_n{c}" for c in by})
    both = low.join(high, reduce(and_, (F.col(c).eqNullSafe(F.col(f"_h{c}")) for c in by))).join(n, reduce(and_, (F.col(c).eqNullSafe(F.col(f"_n{c}")) for c in by)))
    t, gap = at(F.col("_n")) - F.floor(at(F.col("_n"))), F.col("_b") - F.col("_a")
    return both.select(*by, F.when(t < 0.5, F.col("_a") + gap * t).otherwise(F.col("_b") - gap * (1 - t)).alias(name))


def core_region(points: DataFrame, percentile: float = 75.0, by: tuple[str, ...] = ("scene_id", "cluster")) -> DataFrame:
    """The points of each cluster that lie densely.

    Density is the inverse of the mean distance to the k - 1 nearest others,
    k a twentieth of the cluster within 5 and 30; the densest ``percentile``
    per cent of the points stay.  Where that leaves fewer than 10, the denser
    half stays instead (only clusters of 10 to 13 points come to that).
    Clusters of fewer than 10 points stay whole.  Points without a place go.
    """
    keys = list(by)
    k = F.least(F.greatest(F.lit(5), F.floor(F.col("n") / 20)), F.lit(30))
    found = nearest_mean(points, keys, F.when(F.col("n") >= 10, k).otherwise(0))
    near = found.select(*(F.col(c).alias(f"_b{c}") for c in keys), F.col("x").alias("_px"), F.col("y").alias("_py"), (1.0 / (F.col("far") + 1e-6)).alias("_density"))
    own = reduce(and_, (F.col(c).eqNullSafe(F.col(f"_b{c}")) for c in keys))
    placed = points.where("x is not null and y is not null")
    rows = staged(placed.join(near, own & (F.col("x").cast("double") == F.col("_px")) & (F.col("y").cast("double") == F.col("_py")), "left").select(*points.columns, "_density"), "dense")
    dense = rows.where("_density is not null")
    least = _percentile(dense, keys, "_density", 1 - percentile / 100, "_least")
    least = least.withColumnsRenamed({c: f"_b{c}" for c in keys})
    small = dense.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n < 40").withColumnsRenamed({c: f"_s{c}" for c in keys})
    few = dense.join(small, reduce(and_, (F.col(c).eqNullSafe(F.col(f"_s{c}")) for c in keys))).join(least, own)
    half = few.groupBy(*keys).agg(F.count_if(F.col("_density") >= F.col("_least")).alias("_kept"), F.percentile("_density", 0.5).alias("_half"))  # at most 39 points
    half = half.where("_kept < 10").select(*(F.col(c).alias(f"_f{c}") for c in keys), "_half")
    out = dense.join(least, own).join(half, reduce(and_, (F.col(c).eqNullSafe(F.col(f"_f{c}")) for c in keys)), "left")
    kept = out.where(F.col("_density") >= F.coalesce("_half", "_least")).select(*points.columns)
    return kept.union(rows.where("_density is null").select(*points.columns))
