"""Boxes of any size and the k nearest, against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorewright.operators import boxes, nearest, spatial


def random_boxes(n, seed):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        x, y, w, h = rng.uniform(-20, 20), rng.uniform(-20, 20), rng.choice([0, 0.01, 0.3, 2, 30]), rng.choice([0, 0.02, 0.3, 2, 25])
        out.append((k, rng.choice("ab"), x, x + w, y, y + h))
    return out


def table(spark, rows):
    df = spark.createDataFrame(rows, "k long, g string, x0 double, x1 double, y0 double, y1 double")
    return df.select("g", F.struct(*boxes.SIDES).alias("box"), F.struct("k").alias("item"))


def test_meeting_boxes(spark):
    rows = random_boxes(150, 1) + [(900, "a", 0.0, 0.05, 0.0, 0.05), (901, "a", 0.05, 0.1, 0.05, 0.05), (902, "a", None, 1.0, 0.0, 1.0), (903, "a", -float("inf"), 1.0, 0.0, 1.0), (904, "a", 1.0, 0.0, 0.0, 1.0)]
    df = table(spark, rows)
    got = [(r["a"]["k"], r["b"]["k"]) for r in boxes.meeting(df, df, ["g"]).collect()]
    good = [r for r in rows if r[0] < 902]
    want = {(a[0], b[0]) for a in good for b in good if a[1] == b[1] and a[2] <= b[3] and b[2] <= a[3] and a[4] <= b[5] and b[4] <= a[5]}
    assert len(got) == len(set(got)) and {tuple(sorted(p)) for p in got} == {tuple(sorted(p)) for p in want} and set(got) <= want
    assert boxes.meeting(df.limit(0), df, ["g"]).collect() == []


def test_a_large_box_is_a_few_rows(spark):
    df = table(spark, [(0, "a", 0.0, 20.0, 0.0, 20.0), (1, "a", 3.0, 3.01, 3.0, 3.01), (2, "a", -1e6, 1e6, -3.0, 9.0)])
    own = df.withColumn("_own", boxes._level(F.col("box"), 0.05))
    listed = boxes._listed(own, F.col("_own"), 0.05).groupBy("item.k").count().collect()
    assert all(r["count"] <= 4 for r in listed) and len(listed) == 3


def instances_of(rows):
    return [(r[0], (r[2] + r[3]) / 2, (r[4] + r[5]) / 2, *r[2:]) for r in rows]


def test_near_instances_and_parents(spark):
    rows = random_boxes(120, 2)
    rng = random.Random(3)
    inst = [("s", r[1], r[0], (r[2] + r[3]) / 2, (r[4] + r[5]) / 2, *r[2:], z := rng.choice([0.0, 0.2, 1.0]), z + rng.choice([0.1, 0.9]), (r[3] - r[2]) * (r[5] - r[4])) for r in rows]
    df = spark.createDataFrame(inst, "scene_id string, label string, cluster long, cx double, cy double, x0 double, x1 double, y0 double, y1 double, z0 double, z1 double, area double")
    d = 0.8
    want = set()
    for a in inst:
        for b in inst:
            gap = max(a[5] - b[6], b[5] - a[6], a[7] - b[8], b[7] - a[8])
            if a[2] < b[2] and a[1] == b[1] and (np.hypot(a[3] - b[3], a[4] - b[4]) < d or gap < 0.3 * d):
                want.add((a[2], b[2]))
    assert {tuple(r) for r in spatial.proximity_pairs(df, d).collect()} == want and want
    parents = {}
    for c in inst:
        options = []
        for p in inst:
            if p[2] != c[2] and p[11] > c[11] and p[5] - 0.15 <= c[3] <= p[6] + 0.15 and p[7] - 0.15 <= c[4] <= p[8] + 0.15:
                gap = c[9] - p[10]
                if -0.15 <= gap <= 0.35:
                    options.append((abs(gap), p[11], p[2], "On_Top_Of"))
                elif c[9] >= p[9] - 0.1 and c[10] <= p[10] + 0.1:
                    options.append((0.0, p[11], p[2], "Inside"))
        if options:
            parents[c[2]] = min(options)[2:]
    assert {r["cluster"]: (r["parent"], r["relation"]) for r in spatial.hierarchy(df).collect()} == parents and len(parents) > 20


def test_merging_goes_on_until_nothing_is_near(spark):
    """A chain that takes more than ten rounds: each merge brings the next into reach."""
    rows, x = [], 0.0
    for k in range(14):
        width = 2.0**k
        rows += [("s", "c", k, x, 0.0, 0.0), ("s", "c", k, x + width, 0.0, 0.0)]
        x += width + 0.05
    points = spark.createDataFrame(rows, "scene_id string, label string, cluster long, x double, y double, z double")
    assert spatial.merge_near(points, 0.5).select("cluster").distinct().count() == 1
    far = points.withColumn("x", F.col("x") + F.col("cluster") * 5)
    assert spatial.merge_near(far, 0.5).select("cluster").distinct().count() == 14


def plain_core(xy, percentile=75):
    n = len(xy)
    if n < 10:
        return np.ones(n, bool)
    k = min(max(5, n // 20), 30)
    far = np.sort(np.hypot(*(xy[:, None] - xy[None]).transpose(2, 0, 1)), axis=1)[:, 1:k].mean(axis=1)
    density = 1 / (far + 1e-6)
    keep = density >= np.percentile(density, 100 - percentile) * (1 - 1e-12)
    if keep.sum() < 10:
        keep = density >= np.percentile(density, 50) * (1 - 1e-12)
    return keep if keep.sum() >= 5 else np.ones(n, bool)


@pytest.mark.parametrize("n", [1, 5, 9, 10, 13, 14, 60, 700])
def test_core_region(spark, n):
    rng = np.random.default_rng(n)
    sets = {0: rng.normal(0, 1, (n, 2)), 1: np.concatenate([rng.normal(0, 0.01, (n, 2)), [[1e4, 1e4], [5.0, 5.0]]]), 2: np.repeat(rng.normal(0, 1, (max(1, n // 6), 2)), 6, axis=0), 3: np.ones((n, 2))}
    rows = [("s", c, k, float(x), float(y)) for c, xy in sets.items() for k, (x, y) in enumerate(xy)] + [("s", 0, 10**6, None, 1.0)]
    df = spark.createDataFrame(rows, "scene_id string, cluster long, k long, x double, y double").repartition(5)
    got = {(r["cluster"], r["k"]) for r in nearest.core_region(df).collect()}
    want = {(c, k) for c, xy in sets.items() for k in np.flatnonzero(plain_core(xy)).tolist()}
    assert got == want
