"""Labelled points and poses: voxels, clusters, instances, maps.

Tables carry ``scene_id``; every operator handles all scenes at once.
Neighbour searches are equi joins on grid cells, so no scene is held by one
task as a whole.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from scorewright.operators.boxes import SIDES, meeting
from scorewright.operators.graph import connected_components
from scorewright.operators.requests import with_parameters
from scorewright.sources.staging import staged

# --- points ------------------------------------------------------------------------


def back_project(frames: DataFrame, stride: int = 1, least: float = 0.1, most: float = 10.0, confidence: float = 0.0) -> DataFrame:
    """World points of depth frames: ``scene_id, frame, pixel, x, y, z, label``.

    ``frames`` has h, w, depth, conf and mask (first class of a pixel, -1 for
    none) as arrays by pixel, k (3 x 3) and c2w (4 x 4) as flat arrays.  Each
    frame is one vectorised step of an Arrow batch; pixels outside the depth
    or confidence bounds are left out.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                depth, conf, label = (np.asarray(v, float) for v in (row.depth, row.conf, row.mask))
                pixel = np.flatnonzero((depth > least) & (depth < most) & (conf >= confidence))[::stride]
                k, pose = np.asarray(row.k, float).reshape(3, 3), np.asarray(row.c2w, float).reshape(4, 4)
                d, u, v = depth[pixel], pixel % row.w, pixel // row.w
                local = np.stack([(u - k[0, 2]) * d / k[0, 0], (v - k[1, 2]) * d / k[1, 1], d])
                world = pose[:3, :3] @ local + pose[:3, 3:]
                yield pd.DataFrame({"scene_id": row.scene_id, "frame": row.frame, "pixel": pixel, "x": world[0], "y": world[1], "z": world[2], "label": label[pixel].astype(int)})

    kept = frames.select("scene_id", "frame", "h", "w", "depth", "conf", "mask", "k", "c2w")
    return kept.mapInPandas(run, "scene_id string, frame string, pixel long, x double, y double, z double, label int")


def confident_frames(frames: DataFrame, frame_least: float, scene_least: float) -> DataFrame:
    """Frames with enough mean confidence, of scenes with enough overall."""
    mean = F.aggregate("conf", F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size("conf"), F.lit(1))
    rows = frames.withColumn("_c", mean)
    scenes = rows.groupBy("scene_id").agg(F.avg("_c").alias("_s")).where(F.col("_s") >= scene_least)
    return rows.join(scenes, "scene_id").where(F.col("_c") >= frame_least).drop("_c", "_s")


def height_band(points: DataFrame, poses: DataFrame, low: float, offset: float) -> DataFrame:
    """Points between ``low`` and the scene's mean camera height plus offset."""
    ceiling = poses.groupBy("scene_id").agg((F.avg("y") + offset).alias("_top"))
    return points.join(ceiling, "scene_id").where(F.col("y").between(F.lit(low), F.col("_top"))).drop("_top")


def dynamic_ratio(frames: DataFrame, moving: str = "moving", pixels: str = "pixels") -> DataFrame:
    """Mean share of moving pixels over the frames that have pixels."""
    return frames.groupBy("scene_id").agg(F.avg(F.when(F.col(pixels) > 0, F.col(moving) / F.col(pixels))).alias("dynamic_ratio"))


def scene_bounds(points: DataFrame) -> DataFrame:
    return points.groupBy("scene_id").agg(*(f(c).alias(f"{c}_{n}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))))


def cell(value: Column, size: float, truncate: bool = False) -> Column:
    """Grid cell of a coordinate: floor, or toward zero."""
    return (value / size).cast("long") if truncate else F.floor(value / size)


def voxelize(points: DataFrame, size: float) -> DataFrame:
    """Sparse counts ``scene_id, label, ix, iy, iz, n`` from the scene's corner."""
    low = points.groupBy("scene_id").agg(*(F.min(c).alias(f"_{c}") for c in "xyz"))
    rows = points.join(low, "scene_id")
    cells = [F.floor((F.col(c) - F.col(f"_{c}")) / size).alias(f"i{c}") for c in "xyz"]
    return rows.select("scene_id", "label", *cells).groupBy("scene_id", "label", "ix", "iy", "iz").agg(F.count("*").alias("n"))


def downsample(points: DataFrame, size: float, order: str, by: tuple[str, ...] = ("scene_id", "label")) -> DataFrame:
    """The first point, by ``order``, of each cell."""
    cells = [F.floor(F.col(c) / size).alias(f"_{c}") for c in "xyz"]
    columns = points.columns
    rows = points.select(*columns, *cells)
    first = rows.groupBy(*by, "_x", "_y", "_z").agg(F.min_by(F.struct(*columns), order).alias("_row"))
    return first.select("_row.*")


# --- neighbours and components --------------------------------------------------------


def _offsets(dims: int, reach: int = 1, most: int | None = None) -> Column:
    """Array of all steps to neighbour cells (and the cell itself)."""
    grid = np.stack(np.meshgrid(*[range(-reach, reach + 1)] * dims, indexing="ij"), -1).reshape(-1, dims)
    kept = [g for g in grid.tolist() if most is None or sum(map(abs, g)) <= most]
    return F.array(*(F.array(*map(F.lit, g)) for g in kept))


def near_pairs(points: DataFrame, eps: float, key: str = "point_id", by: tuple[str, ...] = ("scene_id", "label"), axes: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """Ordered pairs ``a, b`` (a != b) within ``eps`` in one group.

    One side is listed under the 3 x 3 cells around it; both meet by an equi
    join on group and cell, then the distance is tested.
    """
    cells = [F.floor(F.col(c) / eps).alias(f"_c{k}") for k, c in enumerate(axes)]
    left = points.select(*by, F.col(key).alias("a"), *(F.col(c).alias(f"_a{k}") for k, c in enumerate(axes)), *cells)
    right = points.select(*by, F.col(key).alias("b"), *(F.col(c).alias(f"_b{k}") for k, c in enumerate(axes)), *cells)
    right = right.withColumn("_o", F.explode(_offsets(len(axes))))
    for k in range(len(axes)):
        right = right.withColumn(f"_c{k}", F.col(f"_c{k}") + F.col("_o")[k])
    both = left.join(right.drop("_o"), [*by, *(f"_c{k}" for k in range(len(axes)))])
    far = sum((F.pow(F.col(f"_a{k}") - F.col(f"_b{k}"), 2) for k in range(1, len(axes))), F.pow(F.col("_a0") - F.col("_b0"), 2))
    return both.where((F.col("a") != F.col("b")) & (far <= eps * eps)).select("a", "b")


def dbscan(points: DataFrame, eps: float, min_samples: int, key: str = "point_id", by: tuple[str, ...] = ("scene_id", "label"), axes: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """``key, cluster``: density clusters inside each group; noise is left out.

    A point with ``min_samples`` points in reach, itself included, is a core
    point; clusters are components of core points, named by their smallest
    key; a border point joins the cluster with the smallest name in reach.

    Points lie in cells whose diagonal is ``eps``.  A cell of ``min_samples``
    points or more has core points only, which are one cluster: they are linked
    to one of them, without pairs.  Only points of smaller cells look for their
    neighbours, so pairs are at most ``min_samples`` for each point and cell
    around it.  Whether two full cells touch is decided by ``_touching``.
    """
    dims = len(axes)
    side = eps / math.sqrt(dims) * (1 - 1e-9)
    cs, xs = [f"_c{k}" for k in range(dims)], [f"_x{k}" for k in range(dims)]
    place = [*by, *cs]
    rows = points.select(*by, F.col(key).alias("_p"), *(F.col(c).cast("double").alias(x) for c, x in zip(axes, xs, strict=True)))
    rows = rows.select("*", *(F.floor(F.col(x) / side).alias(c) for c, x in zip(cs, xs, strict=True)))
    rows = staged(rows.join(rows.groupBy(*place).agg((F.count("*") >= min_samples).alias("_full")), place), "points")
    full, sparse = rows.where("_full"), rows.where("not _full")

    listed = sparse.withColumn("_o", F.explode(_offsets(dims, 2)))
    listed = listed.select(*by, *((F.col(c) + F.col("_o")[k]).alias(c) for k, c in enumerate(cs)), F.col("_p").alias("a"), *(F.col(x).alias(f"_a{x}") for x in xs))
    both = listed.join(rows.select(*place, F.col("_p").alias("b"), *xs, "_full"), place)
    pairs = staged(both.where(_square([(F.col(f"_a{x}"), F.col(x)) for x in xs]) <= eps * eps).select("a", "b", "_full"), "pairs")

    some = pairs.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") >= min_samples).select("a")
    heads = staged(full.groupBy(*place).agg(F.min("_p").alias("_r"), *(f(x).alias(f"{n}{x}") for x in xs for n, f in (("lo", F.min), ("hi", F.max), ("mid", F.avg)))), "cells")
    inside = full.join(heads.select(*place, "_r"), place).select(F.col("_p").alias("src"), F.col("_r").alias("dst"))
    mine = pairs.join(some, "a", "left_semi")
    reached = mine.where("_full").union(mine.where("not _full").join(some.withColumnRenamed("a", "b"), "b", "left_semi").select("a", "b", "_full"))
    edges = inside.union(reached.select("a", "b")).union(_touching(full, heads, eps, place, cs, xs))
    linked = connected_components(edges).select(F.col("node").alias("a"), "component")
    core = full.select(F.col("_p").alias("a")).union(some)
    cores = staged(core.join(linked, "a", "left").select(F.col("a").alias(key), F.coalesce("component", "a").alias("cluster")), "cores")
    named = cores.select(F.col(key).alias("b"), "cluster")
    borders = pairs.join(some, "a", "left_anti").join(named, "b").groupBy("a").agg(F.min("cluster").alias("cluster"))
    return cores.union(borders.select(F.col("a").alias(key), "cluster"))


def _square(pairs: list[tuple[Column, Column]]) -> Column:
    return reduce(lambda total, x: total + x, ((a - b) * (a - b) for a, b in pairs))


def _touching(full: DataFrame, heads: DataFrame, eps: float, place: list[str], cs: list[str], xs: list[str]) -> DataFrame:
    """``src, dst``: heads of neighbouring full cells that have points within ``eps``.

    Cells whose boxes of points are farther apart do not touch.  Of the others
    the point of one that is nearest to the middle of the other, and the point
    of the other nearest to that, decide nearly all; what they leave open is
    settled by the pairs of points that lie within ``eps`` of the other's box.
    """
    by, limit = [c for c in place if c not in cs], eps * eps
    forward = [g for g in itertools.product(range(-2, 3), repeat=len(cs)) if g > (0,) * len(cs)]
    stats = [f"{n}{x}" for x in xs for n in ("lo", "hi", "mid")]
    one = heads.select(*place, "_r", *stats).withColumn("_o", F.explode(F.array(*(F.array(*map(F.lit, g)) for g in forward))))
    one = one.select(*by, *((F.col(c) + F.col("_o")[k]).alias(c) for k, c in enumerate(cs)), F.col("_r").alias("src"), *(F.col(c).alias(f"a{c}") for c in stats))
    two = heads.select(*place, F.col("_r").alias("dst"), *(F.col(c).alias(f"b{c}") for c in stats))
    gap = lambda x: F.greatest(F.col(f"alo{x}") - F.col(f"bhi{x}"), F.col(f"blo{x}") - F.col(f"ahi{x}"), F.lit(0.0))
    cells = staged(one.join(two, place).where(reduce(lambda t, x: t + x, (gap(x) * gap(x) for x in xs)) <= limit).drop(*place), "near_cells")

    points = full.join(heads.select(*place, "_r"), place).select("_r", *xs)
    at = lambda side: points.withColumnRenamed("_r", side).join(cells, side)
    nearest = lambda to: F.min_by(F.struct(*xs), _square([(F.col(x), to(x)) for x in xs]))
    a = at("src").groupBy("src", "dst").agg(nearest(lambda x: F.col(f"bmid{x}")).alias("a"))
    b = points.withColumnRenamed("_r", "dst").join(a, "dst").groupBy("src", "dst", "a").agg(nearest(lambda x: F.col(f"a.{x}")).alias("b"))
    met = staged(b.select("src", "dst", (_square([(F.col(f"a.{x}"), F.col(f"b.{x}")) for x in xs]) <= limit).alias("met")), "met")
    done, left = met.where("met").select("src", "dst"), met.where("not met").select("src", "dst")

    off = lambda x, side: F.greatest(F.col(f"{side}lo{x}") - F.col(x), F.col(x) - F.col(f"{side}hi{x}"), F.lit(0.0))
    near = lambda mine, other: at(mine).join(left, ["src", "dst"], "left_semi").where(reduce(lambda t, x: t + x, (off(x, other) * off(x, other) for x in xs)) <= limit)
    u = near("src", "b").select("src", "dst", *(F.col(x).alias(f"u{x}") for x in xs))
    v = near("dst", "a").select("src", "dst", *(F.col(x).alias(f"v{x}") for x in xs))
    rest = u.join(v, ["src", "dst"]).where(_square([(F.col(f"u{x}"), F.col(f"v{x}")) for x in xs]) <= limit)
    return done.union(rest.select("src", "dst").distinct())


def relaxed_min_samples(min_samples: int) -> int:
    """``min_samples`` of a category that was thinned because it was large."""
    return max(3, min_samples // 5)


def category_clusters(points: DataFrame, radii: DataFrame, default: float = 0.15, min_samples: int = 10, least: int = 30, size: float = 0.05, most: int = 10_000, key: str = "point_id") -> DataFrame:
    """``key, cluster``: density clusters of each scene and category with the
    category's own radius (``radii``: category, eps; else the default).

    Categories of fewer than ``least`` points have none.  Those of more than
    ``most`` are thinned to the first point of each (x, y) cell of ``size`` and
    take ``relaxed_min_samples``.  Places are divided by their category's
    radius, so that all categories are one search with radius 1.
    """
    sizes = points.groupBy("scene_id", "label").agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    rows = points.join(sizes, ["scene_id", "label"]).withColumn("category", F.col("label").cast("string"))
    rows = with_parameters(rows, radii, "category", "eps", default).select("scene_id", "label", key, "x", "y", "eps", "_n")
    cells = [F.floor(F.col(c) / size).alias(f"_{c}") for c in "xy"]
    thin = rows.where(F.col("_n") > most).groupBy("scene_id", "label", "eps", *cells).agg(F.min_by(F.struct(key, "x", "y"), key).alias("_p"))
    thin = thin.select("scene_id", "label", f"_p.{key}", "_p.x", "_p.y", "eps")
    scaled = lambda df: df.select("scene_id", "label", key, (F.col("x") / F.col("eps")).alias("x"), (F.col("y") / F.col("eps")).alias("y"))
    few = dbscan(scaled(rows.where(F.col("_n") <= most)), 1.0, min_samples, key)
    return few.union(dbscan(scaled(thin), 1.0, relaxed_min_samples(min_samples), key))


def voxel_components(voxels: DataFrame, dilate: bool = False) -> DataFrame:
    """``voxels`` with ``component``: cells that touch by a face.

    With ``dilate`` the cells first grow into the 18 neighbours by face and
    edge, so cells up to that far apart meet; only given cells come back.
    """
    place = ["scene_id", "label", "ix", "iy", "iz"]
    name = F.xxhash64(*place)
    cells = voxels.select(*place).distinct()
    grown = cells
    if dilate:
        grown = cells.withColumn("_o", F.explode(_offsets(3, most=2)))
        for k, c in enumerate(("ix", "iy", "iz")):
            grown = grown.withColumn(c, F.col(c) + F.col("_o")[k])
        grown = grown.drop("_o").distinct()
    nodes = grown.select(*place, name.alias("node"))
    pairs = None
    for c in ("ix", "iy", "iz"):
        step = nodes.withColumn(c, F.col(c) + 1).withColumnRenamed("node", "other")
        some = nodes.join(step, place).select(F.col("node").alias("src"), F.col("other").alias("dst"))
        pairs = some if pairs is None else pairs.union(some)
    found = connected_components(pairs)
    rows = voxels.withColumn("_node", name).join(found, F.col("_node") == found["node"], "left")
    return rows.select(*voxels.columns, F.coalesce("component", "_node").alias("component"))


def denoise(voxels: DataFrame, least_points: int, least_cells: int) -> DataFrame:
    """Cells with enough points, in components with enough cells."""
    rows = voxel_components(voxels.where(F.col("n") >= least_points))
    sizes = rows.groupBy("component").agg(F.count("*").alias("_k")).where(F.col("_k") >= least_cells)
    return rows.join(sizes, "component").select(*voxels.columns)


# --- instances --------------------------------------------------------------------------


def instances(points: DataFrame, by: tuple[str, ...] = ("scene_id", "label", "cluster")) -> DataFrame:
    """One row per cluster: centroid, box, height range, count, and number in
    its category by falling box area."""
    rows = points.groupBy(*by).agg(
        F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"),
        F.max("y").alias("y1"), F.min("z").alias("z0"), F.max("z").alias("z1"), F.count("*").alias("n"),
    )
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    number = F.row_number().over(Window.partitionBy("scene_id", "label").orderBy(F.desc("area"), "cluster"))
    return rows.withColumn("area", area).withColumn("number", number)


def _hull(p: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, in order (monotone chains)."""
    p = np.unique(p, axis=0)
    if len(p) < 3:
        return p
    cross = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
    chains = []
    for order in (p, p[::-1]):
        chain: list = []
        for q in order:
            while len(chain) > 1 and cross(chain[-2], chain[-1], q) <= 0:
                chain.pop()
            chain.append(q)
        chains += chain[:-1]
    return np.array(chains)


def hull_geometry(points: DataFrame, by: tuple[str, ...] = ("scene_id", "cluster")) -> DataFrame:
    """``by..., hull_area, major, minor, angle``: convex hull and least
    rectangle of a cluster's (x, y).

    Each batch of a task is cut to the hulls of its clusters first, so what
    meets for a cluster are the corners of its parts, not its points.
    """
    kinds = T.StructType(points.select(*by).schema.fields)

    def corners(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, part in pdf.groupby(list(by), dropna=False, sort=False):
                h = _hull(part[["x", "y"]].to_numpy(float))
                first = part.iloc[np.zeros(len(h), int)].reset_index(drop=True)
                yield first.assign(x=h[:, 0], y=h[:, 1])

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        h = _hull(pdf[["x", "y"]].to_numpy(float))
        nxt = np.roll(h, -1, axis=0)
        area = abs(np.sum(h[:, 0] * nxt[:, 1] - nxt[:, 0] * h[:, 1])) / 2
        best = (np.inf, 0.0, 0.0, 0.0)
        for t in np.arctan2(*(nxt - h).T[::-1]) if len(h) > 1 else [0.0]:
            turn = np.array([[np.cos(t), np.sin(t)], [-np.sin(t), np.cos(t)]])
            w, d = np.ptp(h @ turn.T, axis=0)
            best = min(best, (w * d, max(w, d), min(w, d), float(np.degrees(t if w >= d else t + np.pi / 2) % 180)))
        return pd.DataFrame([(*key, area, *best[1:])])

    double = T.DoubleType()
    some = T.StructType([*kinds.fields, T.StructField("x", double), T.StructField("y", double)])
    out = T.StructType([*kinds.fields, *(T.StructField(c, double) for c in ("hull_area", "major", "minor", "angle"))])
    rows = points.select(*by, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where("x is not null and y is not null")
    return rows.mapInPandas(corners, some).groupBy(*by).applyInPandas(run, out)


def _boxed(inst: DataFrame, key: str, pad: float) -> DataFrame:
    """Instances with their boxes grown by ``pad`` on each side."""
    box = F.struct(*((F.col(c) + F.lit(pad if c[1] == "1" else -pad)).alias(c) for c in SIDES))
    return inst.select("scene_id", "label", box.alias("box"), F.struct(F.col(key).alias("key"), "cx", "cy", *SIDES).alias("item"))


def proximity_pairs(inst: DataFrame, distance: float, key: str = "cluster", gap_share: float = 0.3) -> DataFrame:
    """Pairs ``src < dst`` of one scene and category whose centroids are nearer
    than ``distance`` or whose boxes are nearer than ``gap_share`` of it, by the
    larger of the gaps along the axes."""
    grown = _boxed(inst, key, distance / 2 * (1 + 1e-9))
    both = meeting(grown, grown, ["scene_id", "label"], max(distance, 1e-9))
    near = F.hypot(F.col("a.cx") - F.col("b.cx"), F.col("a.cy") - F.col("b.cy")) < distance
    gap = lambda c: F.greatest(F.col(f"a.{c}0") - F.col(f"b.{c}1"), F.col(f"b.{c}0") - F.col(f"a.{c}1"))
    both = both.where((F.col("a.key") != F.col("b.key")) & (near | (F.greatest(gap("x"), gap("y")) < gap_share * distance)))
    return both.select(F.least("a.key", "b.key").alias("src"), F.greatest("a.key", "b.key").alias("dst")).distinct()


def merge_near(points: DataFrame, distance: float) -> DataFrame:
    """``points`` with near clusters of a category merged until none are near.

    Each round merges whole components of near instances, so chains of them
    merge at once (not one by one in list order); a round that merges leaves
    fewer clusters, so the rounds end.
    """
    while True:
        found = connected_components(proximity_pairs(instances(points), distance))
        if found.isEmpty():
            return points
        moved = points.join(found, points["cluster"] == found["node"], "left")
        points = staged(moved.select(*(F.coalesce("component", "cluster").alias("cluster") if c == "cluster" else points[c] for c in points.columns)), "merged")


def hierarchy(inst: DataFrame, pad: float = 0.15, low: float = -0.15, high: float = 0.35, inside: float = 0.1, key: str = "cluster") -> DataFrame:
    """``scene_id, key, parent, relation, gap``: the best parent of each
    instance that has one.

    A parent's box, grown by ``pad``, holds the child's centroid and is larger;
    the child lies On_Top_Of it (gap from the parent's top within low..high)
    or Inside (its height range within the parent's, with a margin; gap 0).
    The least gap wins, then the smaller area, then the key.
    """
    item = F.struct(key, "z0", "z1", "area").alias("item")
    grown = F.struct(*((F.col(c) + F.lit(pad if c[1] == "1" else -pad)).alias(c) for c in SIDES)).alias("box")
    spot = F.struct(F.col("cx").alias("x0"), F.col("cx").alias("x1"), F.col("cy").alias("y0"), F.col("cy").alias("y1")).alias("box")
    both = meeting(inst.select("scene_id", grown, item), inst.select("scene_id", spot, item), ["scene_id"])
    both = both.where((F.col(f"a.{key}") != F.col(f"b.{key}")) & (F.col("a.area") > F.col("b.area")))
    gap = F.col("b.z0") - F.col("a.z1")
    within = (F.col("b.z0") >= F.col("a.z0") - inside) & (F.col("b.z1") <= F.col("a.z1") + inside)
    relation = F.when(gap.between(low, high), "On_Top_Of").when(within, "Inside")
    both = both.select("scene_id", F.col(f"b.{key}").alias(key), F.col(f"a.{key}").alias("parent"), relation.alias("relation"), F.when(relation == "Inside", 0.0).otherwise(F.abs(gap)).alias("gap"), F.col("a.area").alias("_area"))
    rank = F.row_number().over(Window.partitionBy("scene_id", key).orderBy("gap", "_area", "parent"))
    return both.where("relation is not null").withColumn("_k", rank).where("_k = 1").drop("_k", "_area")


def hierarchy_document(inst: DataFrame, tree: DataFrame, key: str = "cluster") -> DataFrame:
    """``scene_id, document``: JSON of the top instances with their children
    nested two levels deep, numbers rounded to 3 digits."""
    place = [F.round(c, 3).alias(c) for c in ("cx", "cy", "z0", "z1")]
    rows = inst.select("scene_id", key, "label", *place).join(tree.select("scene_id", key, "parent", "relation"), ["scene_id", key], "left")
    body = ("label", "cx", "cy", "z0", "z1", "relation")

    def nested(level: DataFrame, *more: str) -> DataFrame:
        item = F.struct(key, *body, *more)
        return level.where("parent is not null").groupBy("scene_id", F.col("parent").alias(key)).agg(F.sort_array(F.collect_list(item)).alias("children"))

    middle = rows.join(nested(rows), ["scene_id", key], "left")
    top = rows.join(nested(middle, "children"), ["scene_id", key], "left").where("parent is null")
    item = F.struct(key, "label", "cx", "cy", "z0", "z1", "children")
    return top.groupBy("scene_id").agg(F.to_json(F.sort_array(F.collect_list(item))).alias("document"))


# --- maps --------------------------------------------------------------------------------


def grid_map(inst: DataFrame, bounds: DataFrame, n: int = 10) -> DataFrame:
    """``scene_id, row, col, categories``: labels whose boxes touch each cell
    of an n x n grid over the scene's bounds."""
    rows = inst.join(bounds, "scene_id")

    def cells(lo: str, hi: str, axis: str) -> Column:
        span = F.greatest(F.col(f"{axis}_max") - F.col(f"{axis}_min"), F.lit(1e-9))
        at = lambda v: F.least(F.greatest(F.floor((F.col(v) - F.col(f"{axis}_min")) / span * n), F.lit(0)), F.lit(n - 1)).cast("int")
        return F.sequence(at(lo), at(hi))

    listed = rows.select("scene_id", "label", F.explode(cells("y0", "y1", "y")).alias("row"), cells("x0", "x1", "x").alias("_cols"))
    listed = listed.select("scene_id", "label", "row", F.explode("_cols").alias("col"))
    return listed.groupBy("scene_id", "row", "col").agg(F.sort_array(F.collect_set("label")).alias("categories"))


def occupied_area(cells: DataFrame, bounds: DataFrame, n: int = 10) -> DataFrame:
    """``scene_id, occupied_cells, occupied_area`` of a ``grid_map``."""
    side = lambda axis: (F.col(f"{axis}_max") - F.col(f"{axis}_min")) / n
    counts = cells.groupBy("scene_id").agg(F.count("*").alias("occupied_cells"))
    return counts.join(bounds, "scene_id").select("scene_id", "occupied_cells", (F.col("occupied_cells") * side("x") * side("y")).alias("occupied_area"))


def floor_area(cells: DataFrame, grid: float) -> DataFrame:
    """``scene_id, floor_area`` of the traversable cells of ``route_cells``."""
    return cells.groupBy("scene_id").agg((F.count("*") * grid * grid).alias("floor_area"))


def route_cells(points: DataFrame, voxel: float, grid: float, least: int, truncate: bool = False) -> DataFrame:
    """``scene_id, row, col, n``: grid cells with at least ``least`` distinct
    floor voxels."""
    vox = points.select("scene_id", cell(F.col("x"), voxel, truncate).alias("vx"), cell(F.col("y"), voxel, truncate).alias("vy")).distinct()
    ratio = grid / voxel
    cells = vox.select("scene_id", F.floor(F.col("vy") / ratio).alias("row"), F.floor(F.col("vx") / ratio).alias("col"))
    return cells.groupBy("scene_id", "row", "col").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def trajectory(poses: DataFrame, grid: float, order: list) -> DataFrame:
    """``scene_id, path``: cells in order without repeats, as text."""
    rows = poses.withColumns({"_r": F.floor(F.col("y") / grid), "_c": F.floor(F.col("x") / grid)})
    w = Window.partitionBy("scene_id").orderBy(*order)
    new = ~(F.lag("_r").over(w).eqNullSafe(F.col("_r")) & F.lag("_c").over(w).eqNullSafe(F.col("_c"))) | (F.row_number().over(w) == 1)
    rows = rows.withColumns({"_new": new, "_k": F.row_number().over(w)}).where("_new")
    text = F.concat(F.lit("("), F.col("_r").cast("string"), F.lit(","), F.col("_c").cast("string"), F.lit(")"))
    lists = rows.groupBy("scene_id").agg(F.sort_array(F.collect_list(F.struct("_k", text.alias("t")))).alias("_p"))
    return lists.select("scene_id", F.array_join(F.transform("_p", lambda p: p["t"]), " -> ").alias("path"))


def heading(pose: Column) -> Column:
    """Struct x, y, z, degrees of a flat 4 x 4 camera-to-world pose: position,
    and direction of the camera's z axis in the ground plane."""
    return F.struct(pose[3].alias("x"), pose[7].alias("y"), pose[11].alias("z"), F.pmod(F.degrees(F.atan2(pose[2], pose[10])), F.lit(360.0)).alias("degrees"))


# fixed values: directions in the order of a quarter turn, and other names for them
FACINGS = ("up", "right", "down", "left")
FACING_NAMES = {
    "top": "up", "bottom": "down", "north": "up", "south": "down", "east": "right", "west": "left", "front": "inner", "back": "outer", "into": "inner",
    "out": "outer", "inside": "inner", "outside": "outer", "forward": "inner", "backward": "outer",
}


def facing(name: Column) -> Column:
    """A direction by its usual name; blank is null."""
    low = F.lower(F.trim(name))
    names = F.create_map(*(F.lit(x) for pair in FACING_NAMES.items() for x in pair))
    return F.when(low != "", F.coalesce(F.try_element_at(names, low), low))


def turned(name: Column, degrees: Column) -> Column:
    """A direction after quarter turns; inner, outer and unknown ones stay."""
    order = F.array(*map(F.lit, FACINGS))
    at = F.array_position(order, name) - 1
    return F.when(at >= 0, F.get(order, (at + degrees / 90).cast("int") % 4)).otherwise(name)


def map_similarity(pred: DataFrame, gold: DataFrame, key: str = "map_id") -> DataFrame:
    """``key, direction, facing, overall, rotation, coverage`` under the best of
    the four quarter turns of the predicted map.

    ``direction`` is the agreement of the pairwise directions of shared objects,
    ``facing`` the share of shared objects with a gold facing whose turned
    facing is the same (1 if none has one), ``overall`` 0.7 and 0.3 of them; the
    largest overall wins, then the smaller turn.  Both tables have key, name,
    x, y and may have ``facing``.  Pairs are formed inside one map, whose
    objects are few; the turns are a fixed array of four.
    """
    face = lambda df: (facing(F.col("facing")) if "facing" in df.columns else F.lit(None).cast("string"))
    own = gold.select(key, "name", F.col("x").alias("gx"), F.col("y").alias("gy"), face(gold).alias("gf"))
    shared = own.join(pred.select(key, "name", "x", "y", face(pred).alias("f")), [key, "name"])
    counts = gold.groupBy(key).agg(F.count("*").alias("_n")).join(shared.groupBy(key).agg(F.count("*").alias("_m")), key, "left")
    turns = F.array(*(F.struct(F.lit(90 * k).alias("r"), F.lit(c).alias("c"), F.lit(s).alias("s")) for k, (c, s) in enumerate([(1, 0), (0, 1), (-1, 0), (0, -1)])))
    each = shared.withColumn("t", F.explode(turns))
    has, right = F.count("gf"), F.count_if(turned(F.col("f"), F.col("t.r")) == F.col("gf"))
    faces = each.groupBy(key, F.col("t.r").alias("r")).agg(F.when(has > 0, right / has).otherwise(1.0).alias("f"))

    other = shared.select(key, *(F.col(c).alias(f"o_{c}") for c in ("name", "gx", "gy", "x", "y")))
    rows = shared.join(other, key).where(F.col("name") < F.col("o_name")).withColumn("t", F.explode(turns))
    dx, dy = F.col("x") - F.col("o_x"), F.col("y") - F.col("o_y")
    tx, ty = F.col("t.c") * dx - F.col("t.s") * dy, F.col("t.s") * dx + F.col("t.c") * dy
    same = lambda a, b: (F.signum(a) == F.signum(b)).cast("double")
    agree = (same(tx, F.col("gx") - F.col("o_gx")) + same(ty, F.col("gy") - F.col("o_gy"))) / 2
    per = rows.groupBy(key, F.col("t.r").alias("r")).agg(F.avg(agree).alias("d"))
    both = faces.join(per, [key, "r"], "left").withColumn("d", F.coalesce("d", F.lit(0.0))).withColumn("o", 0.7 * F.col("d") + 0.3 * F.col("f"))
    best = both.groupBy(key).agg(F.max_by(F.struct("d", "f", "o", "r"), F.struct(F.round("o", 12), -F.col("r"))).alias("b"))
    found = counts.join(best, key, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return found.select(key, zero("b.d").alias("direction"), zero("b.f").alias("facing"), zero("b.o").alias("overall"), F.col("b.r").alias("rotation"), (F.coalesce("_m", F.lit(0)) / F.col("_n")).alias("coverage"))


def merged_masks(masks: DataFrame) -> DataFrame:
    """Union of the masks of one class in a frame: ``frame, class, pixel``."""
    return masks.groupBy("frame", "class", "pixel").agg(F.max("value").alias("value"))
