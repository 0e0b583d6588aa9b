"""Density clusters by cells against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorewright.operators import spatial


def brute(xy, eps, least):
    near = (((xy[:, None] - xy[None]) ** 2).sum(-1)) <= eps * eps
    core = near.sum(1) >= least
    label = np.where(core, np.arange(len(xy)), -1)
    while True:
        new = np.array([min([label[j] for j in np.flatnonzero(near[k] & core)]) if core[k] else -1 for k in range(len(xy))])
        if (new == label).all():
            break
        label = new
    return {k: (label[k] if core[k] else min(label[j] for j in np.flatnonzero(near[k] & core))) for k in range(len(xy)) if core[k] or (near[k] & core).any()}


@pytest.mark.parametrize(("seed", "n", "spread", "least", "dims"), [(0, 300, 3.0, 4, 2), (1, 300, 1.2, 6, 2), (2, 250, 6.0, 1, 2), (3, 200, 1.5, 5, 3), (4, 400, 0.8, 40, 2)])
def test_clusters(spark, seed, n, spread, least, dims):
    rng = np.random.default_rng(seed)
    xy = np.concatenate([rng.normal(rng.uniform(-spread, spread, dims), 0.35, (n // 4, dims)) for _ in range(4)])
    xy[:20] = xy[20:40]  # equal points
    rows = [("s", int(k), *map(float, p)) for k, p in enumerate(xy)]
    names = ["x", "y", "z"][:dims]
    df = spark.createDataFrame(rows, "scene_id string, point_id long, " + ", ".join(f"{c} double" for c in names))
    got = {r["point_id"]: r["cluster"] for r in spatial.dbscan(df, 0.5, least, by=("scene_id",), axes=tuple(names)).collect()}
    assert got == brute(xy, 0.5, least)


def test_full_cells_with_a_gap_between_them(spark):
    rng = np.random.default_rng(7)
    left, right = rng.uniform((0.0, 0.0), (0.1, 0.3), (80, 2)), rng.uniform((0.62, 0.0), (0.7, 0.3), (80, 2))
    bent = np.stack([np.linspace(0, 0.3, 40), np.where(np.arange(40) % 2, 0.9, 1.0)], 1)  # two rows of points in cells of their own
    for xy in (np.concatenate([left, right]), np.concatenate([left, right, bent])):
        df = spark.createDataFrame([("s", int(k), *map(float, p)) for k, p in enumerate(xy)], "scene_id string, point_id long, x double, y double")
        got = {r["point_id"]: r["cluster"] for r in spatial.dbscan(df, 0.5, 5, by=("scene_id",)).collect()}
        assert got == brute(xy, 0.5, 5)


def test_a_dense_cell_makes_no_pairs(spark):
    df = spark.range(20_000).select(F.lit("s").alias("scene_id"), F.col("id").alias("point_id"), (F.col("id") % 7 / 100).alias("x"), (F.col("id") % 5 / 100).alias("y"))
    rows = spatial.dbscan(df, 0.5, 5, by=("scene_id",))
    assert rows.count() == 20_000 and [r["cluster"] for r in rows.select("cluster").distinct().collect()] == [0]
    assert spatial.dbscan(df.limit(0), 0.5, 5, by=("scene_id",)).collect() == []
