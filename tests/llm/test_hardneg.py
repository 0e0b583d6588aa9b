import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorewright.llm import hardneg

SCHEMA = "vec_id long, embedding array<double>, label int, block int, rid string, `a.b` int"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)


def brute(rows):
    used = [(i, [math.floor(256 * x) for x in v], g) for i, v, g in rows if g is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for at, (i, q, g) in enumerate(used):
        if i is None or i % 100:
            continue
        scored = sorted((-dot(q, v), j is None, j or 0, h) for k, (j, v, h) in enumerate(used) if k != at)
        same = [x for x in scored if x[3] == g][:5]
        for s, none, j, _ in same:
            fit = [x for x in scored if x[3] != g and 30 * -s <= 100 * -x[0] <= 90 * -s][:10]
            out += [(i, None if none else j, r + 1, None if x[1] else x[2], -s, -x[0]) for r, x in enumerate(fit)]
    return sorted(out, key=repr)


def result(df, **options):
    found = hardneg.hard_negatives(df, F.col("vec_id") % 100 == 0, **options).collect()
    return sorted((tuple(r) for r in found), key=repr)


def clustered(n, seed, dim=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, dim))
    return [(int(k * 10), (centres[k % 8] + 0.2 * rng.normal(size=dim)).tolist(), int(rng.integers(0, 4))) for k in range(n)]


@pytest.mark.parametrize("options", [{}, {"block_rows": 90, "cells": 20}])
def test_matches_brute_force(spark, options):
    rows = clustered(400, 1)
    rows += [(7, None, 1), (8, [1.0, None], 1), (9, [float("nan"), 1.0], 2), (11, [float("inf")], 2), (12, [1.0] * 6, None), (None, [0.5] * 6, 1), (None, [0.5] * 6, 2)]
    rows += [(100, [0.25] * 6, 9), (13, [], 3), (100, [], 2), (14, [1.0, 2.0], 0), (15, [0.5] * 9, 1)]
    rows += [rows[10]] * 3 + [(20_000 + k, rows[10][1], 3) for k in range(30)]
    assert result(table(spark, rows), **options) == brute(rows)


def test_windows_of_zero_and_below(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [-0.5, 0.0], 1), (2, [0.0, 3.0], 1), (3, [0.0, -2.0], 2), (4, [-0.2, 0.0], 2), (5, [0.3, 0.0], 2)]
    assert result(table(spark, rows)) == brute(rows) == [(0, 2, 1, 3, 0, 0)]


def test_large_components_are_exact(spark):
    rng = random.Random(3)
    rows = [(k * 50, [rng.uniform(-5e6, 5e6) for _ in range(4)], k % 3) for k in range(60)]
    got = result(table(spark, rows))
    assert got == brute(rows) and max(r[4] for r in got) > 1 << 53


def test_empty(spark):
    assert result(table(spark, [])) == []
    assert result(table(spark, [(100, [1.0], 1)])) == []
    assert result(table(spark, [(101, [1.0], 1), (102, [1.0], 2)])) == []


def test_the_descent_skips_nodes_and_loses_nothing(monkeypatch):
    """On clustered vectors most points are never scored."""
    import pyarrow as pa

    rows = clustered(6000, 5, 8)
    held = pa.table({"rid": range(6000), "label": pa.array([r[2] for r in rows], pa.int64()), "vec_id": [r[0] for r in rows], "vec": pa.array([r[1] for r in rows], pa.list_(pa.float64()))})
    block, scored = hardneg.Block(held, 0), []
    plain = hardneg.dots
    monkeypatch.setattr(hardneg, "dots", lambda v, q, m: scored.append(len(v)) or plain(v, q, m))
    for at in range(0, 6000, 500):
        query = block.vectors[at]
        found = block.search(query, at, rows[at][2], True, [(-(1 << 200), 1 << 200)], 5)[0]
        every = sorted((-int(block.vectors[k] @ query), rows[k][0]) for k in range(6000) if k != at and rows[k][2] == rows[at][2])[:5]
        assert [(-s, i) for _, s, i in found] == every
    assert sum(scored) < 12 * 1500 / 3

    def check(node, space):
        gap = np.linalg.norm(space[node.points] - space[node.centre], axis=1)
        assert (gap <= node.radius + 1e-6).all()
        for n in node.below:
            assert n.radius <= node.radius / 2 + 1e-6
            check(n, space)

    for _, tree in block.trees:
        size = np.einsum("ij,ij->i", block.vectors, block.vectors)
        check(tree.root, np.c_[block.vectors, np.sqrt(np.maximum(tree.norm**2 - size, 0))])
