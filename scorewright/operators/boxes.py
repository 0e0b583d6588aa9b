"""Joins of boxes of any size, by a grid of several levels."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIDES = ("x0", "x1", "y0", "y1")


def _level(box: Column, base: float) -> Column:
    """The lowest level whose cells, ``base`` times a power of two, are as
    large as the box."""
    size = F.greatest(box["x1"] - box["x0"], box["y1"] - box["y0"], F.lit(base))
    return F.greatest(F.lit(0), F.ceil(F.log2(size / base))).cast("int")


def _listed(rows: DataFrame, level: Column, base: float) -> DataFrame:
    """A row for each cell of a level that the box meets, at most two a side."""
    side = base * F.pow(F.lit(2.0), F.col("_level"))
    cells = lambda axis: F.sequence(F.floor(F.col(f"box.{axis}0") / side), F.floor(F.col(f"box.{axis}1") / side))
    rows = rows.withColumn("_level", level).withColumn("_side", side)
    return rows.withColumn("_x", F.explode(cells("x"))).withColumn("_y", F.explode(cells("y")))


def meeting(large: DataFrame, small: DataFrame, by: list[str], base: float = 0.05) -> DataFrame:
    """``by..., a, b``: rows of ``large`` and ``small`` whose boxes meet, edges
    included, where the level of the small one's box is not above the other's.

    Both have ``by...``, ``box`` (struct of x0, x1, y0, y1) and ``item``.  A box
    of ``large`` is listed at the level of its size, under at most four cells
    of it; one of ``small`` probes the levels of ``large`` (read by the driver,
    a few) from its own upwards, at most four cells each.  So the rows of a box
    do not depend on its size.  A pair comes once: from the cell with the lower
    corner of what the boxes share.  Boxes with a null or infinite side meet
    nothing.
    """
    finite = lambda rows: rows.where(reduce(and_, (F.abs(F.col(f"box.{s}")) < float("inf") for s in SIDES)) & (F.col("box.x0") <= F.col("box.x1")) & (F.col("box.y0") <= F.col("box.y1")))
    own = finite(large).withColumn("_own", _level(F.col("box"), base))
    levels = sorted(r[0] for r in own.select("_own").distinct().collect()) or [0]
    above = F.filter(F.array(*(F.lit(k) for k in levels)), lambda k: k >= _level(F.col("box"), base))
    a = _listed(own, F.col("_own"), base).select(*by, "_level", "_x", "_y", "_side", F.col("box").alias("_a"), F.col("item").alias("a"))
    b = _listed(finite(small), F.explode(above), base).select(*by, "_level", "_x", "_y", F.col("box").alias("_b"), F.col("item").alias("b"))
    both = a.join(b, [*by, "_level", "_x", "_y"])
    corner = lambda axis: F.greatest(F.col(f"_a.{axis}0"), F.col(f"_b.{axis}0"))
    meets = reduce(and_, ((corner(c) <= F.least(F.col(f"_a.{c}1"), F.col(f"_b.{c}1"))) & (F.floor(corner(c) / F.col("_side")) == F.col(f"_{c}")) for c in "xy"))
    return both.where(meets).select(*by, "a", "b")
