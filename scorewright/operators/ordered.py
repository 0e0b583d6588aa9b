"""Places in an order, without one task seeing all rows of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorewright.sources.staging import staged

#: Rows of a key that one window partition holds, beside those copied in.
WIDTH = 100_000


def placed(df: DataFrame, by: list[str], order: list[str], name: str = "pos") -> DataFrame:
    """``df`` with each row's place from 0 among the rows of its ``by``.

    Rows are sorted by range over ``by`` and ``order`` (ascending, nulls
    first) and staged; every range counts what it holds of a key, and a row's
    place is the count of the ranges before plus its own in its range.  So the
    rows of a hot key lie in many ranges, and what a window sees is a row for
    each range.  Rows that tie in ``order`` stand in any order.  An empty table
    gives an empty result.
    """
    rows = df.withColumn("_tie", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(*by, *order, "_tie").sortWithinPartitions(*by, *order, "_tie").drop("_tie")
    found = staged(rows.withColumn("_seq", F.monotonically_increasing_id()), "placed").withColumn("_part", F.shiftright("_seq", 33))
    own = {c: f"_by{k}" for k, c in enumerate(by)}
    parts = found.groupBy(*by, "_part").agg(F.min("_seq").alias("_low"), F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(*(F.col(c).alias(n) for c, n in own.items()), F.col("_part").alias("_p"), "_low", F.coalesce(upto, F.lit(0)).alias("_before"))
    same = F.col("_part") == F.col("_p")
    for c, n in own.items():
        same = same & F.col(c).eqNullSafe(F.col(n))
    both = found.join(parts, same)
    return both.withColumn(name, F.col("_before") + F.col("_seq") - F.col("_low")).drop("_seq", "_part", "_p", "_low", "_before", *own.values())


def rolling(df: DataFrame, by: list[str], order: list[str], last: int, columns, width: int = WIDTH) -> DataFrame:
    """``df`` with ``columns(window)`` of the last ``last`` rows of a key, the
    row itself included, and its place ``pos``.

    ``columns`` takes a window and gives a dict of columns.  A window partition
    is a range of ``width`` places, in which the last rows of the range before
    are copied, so no partition grows with its key.
    """
    rows = placed(df, by, order)
    here = F.floor(F.col("pos") / width)
    follows = F.col("pos") % width >= width - (last - 1)
    ranges = F.when(follows, F.array(here, here + 1)).otherwise(F.array(here))
    rows = rows.withColumn("_range", F.explode(ranges))
    window = Window.partitionBy(*by, "_range").orderBy("pos").rowsBetween(-(last - 1), 0)
    made: dict[str, Column] = columns(window)
    return rows.withColumns(made).where(F.floor(F.col("pos") / width) == F.col("_range")).drop("_range")
