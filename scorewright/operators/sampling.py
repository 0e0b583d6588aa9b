"""Limits, samples and shuffles that do not depend on partitioning.

Random choices are orders of a seeded hash of the row's key: the same rows are
chosen on any cluster and after any retry.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorewright.operators.ordered import placed


def _draw(seed: int, *keys: str) -> Column:
    return F.xxhash64(F.lit(seed), *keys)


#: Rows that one task ranks, about, and ranges of a key at most.
RANKED, RANGES = 250_000, 8192


def _range_of(value: Column, cuts: list) -> Column:
    """How many of the sorted cuts are at most the value, by binary search."""
    if not cuts:
        return F.lit(0)
    array = F.array(*map(F.lit, cuts))
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(array, at + step - 1) <= value, at + step).otherwise(at))


def numbered(df: DataFrame, key: str, name: str = "rn") -> DataFrame:
    """``df`` with its rank (from 0) by a unique key, without one task seeing
    all rows: ranges of the key, more of them the more rows there are, are
    counted, then ranked apart.  Keys must be comparable and not null."""
    many = min(RANGES, df.count() // RANKED)
    cuts = []
    if many:
        found = df.agg(F.percentile_approx(key, [k / (many + 1) for k in range(1, many + 1)], max(10_000, 10 * many)).alias("q")).first()["q"]
        cuts = sorted(set(found or []))
    rows = df.withColumn("_part", _range_of(F.col(key), cuts))
    counts = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each range
    starts = counts.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(key)) - 1
    return rows.withColumn("_k", within).join(starts, "_part").withColumn(name, F.col("_before") + F.col("_k")).drop("_part", "_k", "_before")


def window_of(df: DataFrame, key: str, offset: int = 0, limit: float | None = None, rank: int = 0, ranks: int = 1) -> DataFrame:
    """Rows offset..offset+limit in the order of ``key``, every ``ranks``-th of
    them from ``rank`` on.  A limit between 0 and 1 is that share of all rows,
    rounded up; -1 or None is no limit."""
    if limit is not None and 0 < limit < 1:
        limit = math.ceil(df.count() * limit)
    rows = numbered(df, key).where(F.col("rn") >= offset)
    if limit is not None and limit >= 0:
        rows = rows.where(F.col("rn") < offset + int(limit))
    return rows.where((F.col("rn") - offset) % ranks == rank).drop("rn")


def choose_split(df: DataFrame, split: str = "split") -> DataFrame:
    """The test rows, or the validation rows if there are none."""
    found = {r[0] for r in df.select(split).where(F.col(split).isin("test", "validation")).distinct().collect()}
    name = "test" if "test" in found else "validation"
    return df.where(F.col(split) == name)


def first_n(df: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    """The first ``n`` rows of each group; each task keeps at most n of a group
    before the shuffle."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")


def every_kth(df: DataFrame, by: list[str], order: list[str], k: int) -> DataFrame:
    """Every k-th row of each group, the first included, by the rows' places
    (``placed``), so no task holds a group."""
    return placed(df, by, order, "_pos").where(F.col("_pos") % k == 0).drop("_pos")


def changes(df: DataFrame, by: list[str], order: list, cells: list[str]) -> DataFrame:
    """Rows whose cell differs from that of the row before in their group."""
    w = Window.partitionBy(*by).orderBy(*order)
    same = F.lit(True)
    for c in cells:
        same = same & F.lag(c).over(w).eqNullSafe(F.col(c))
    return df.withColumn("_same", same & (F.row_number().over(w) > 1)).where(~F.col("_same")).drop("_same")


def quotas(df: DataFrame, kind: str, source: str, targets: dict[str, int]) -> DataFrame:
    """Rows to take per (kind, source): the target of the kind in proportion to
    the source's size, rounded down but at least one, trimmed from the largest
    sources (then names) to the target.  Kinds without a target take none."""
    table = F.create_map(*(F.lit(v) for pair in targets.items() for v in pair))
    counts = df.groupBy(kind, source).agg(F.count("*").alias("size")).withColumn("target", F.try_element_at(table, F.col(kind)))
    counts = counts.where("target is not null")
    total = F.sum("size").over(Window.partitionBy(kind))
    share = F.when(total <= F.col("target"), F.col("size")).otherwise(F.greatest(F.lit(1), F.floor(F.col("target") * F.col("size") / total)))
    counts = counts.withColumn("quota", share.cast("long"))
    upto = F.sum("quota").over(Window.partitionBy(kind).orderBy(F.desc("size"), source).rowsBetween(Window.unboundedPreceding, 0))
    room = F.col("target") - (upto - F.col("quota"))
    return counts.withColumn("quota", F.greatest(F.lit(0), F.least(F.col("quota"), room))).select(kind, source, "size", "quota")


def quota_sample(df: DataFrame, by: list[str], limits: DataFrame, draw: Column, key: str) -> DataFrame:
    """The first ``quota`` rows of each stratum in the order of ``draw`` (a
    long), then ``key``; ``limits`` has ``by..., quota``.

    No stratum is sorted.  The draw's first bits are cells, about the square
    root of the largest stratum in number; their counts say in which cell the
    quota of a stratum ends.  Cells before it stay whole, only the rows of that
    cell are ranked.  Strata are compared null-safe; those without a limit take
    none.
    """
    largest = df.groupBy(*by).agg(F.count("*").alias("_n")).agg(F.max("_n")).first()[0] or 0
    bits = max(1, largest.bit_length() // 2)
    drawn = df.withColumn("_draw", draw)
    drawn = drawn.withColumn("_cell", F.shiftright("_draw", 64 - bits))
    cells = drawn.groupBy(*by, "_cell").agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1))
    cells = cells.select(*(F.col(c).alias(f"_by{k}") for k, c in enumerate(by)), "_cell", F.coalesce(upto, F.lit(0)).alias("_before"))

    def same(frame: DataFrame) -> Column:
        return reduce(and_, (frame[c].eqNullSafe(F.col(f"_by{k}")) for k, c in enumerate(by)))

    ends = cells.join(limits, same(limits)).where(F.col("_before") < F.col("quota"))
    cuts = ends.groupBy(*(f"_by{k}" for k in range(len(by)))).agg(F.max(F.struct("_cell", (F.col("quota") - F.col("_before")).alias("rest"))).alias("_cut"))
    both = drawn.join(cuts, same(drawn))
    whole = both.where(F.col("_cell") < F.col("_cut._cell")).select(*df.columns)
    last = both.where(F.col("_cell") == F.col("_cut._cell"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("_draw", key))  # rows of one cell for each stratum
    return whole.union(last.withColumn("_rn", rank).where(F.col("_rn") <= F.col("_cut.rest")).select(*df.columns))


def stratified(df: DataFrame, targets: dict[str, int], kind: str, source: str, key: str, seed: int = 42, draw: Column | None = None) -> DataFrame:
    """Two-level sample: ``quotas`` rows of each (kind, source) in hash order,
    or in that of another ``draw``."""
    limits = quotas(df, kind, source, targets).select(kind, source, "quota")
    return quota_sample(df, [kind, source], limits, _draw(seed, key) if draw is None else draw, key)


def cap_stratified(df: DataFrame, by: str, target: int, key: str, seed: int = 42, draw: Column | None = None) -> DataFrame:
    """``target`` rows over the strata in proportion, rounded; the last stratum
    by name takes what is left.  Fewer rows than the target all stay."""
    counts = df.groupBy(by).agg(F.count("*").alias("_size"))
    whole = Window.partitionBy(F.lit(0))  # one row for each stratum
    total, last = F.sum("_size").over(whole), F.max(by).over(whole)
    share = F.round(target * F.col("_size") / total).cast("long")
    counts = counts.withColumns({"_share": share, "_last": F.col(by).eqNullSafe(last), "_total": total})
    others = F.sum(F.when(~F.col("_last"), F.col("_share"))).over(whole)
    quota = F.when(F.col("_total") <= target, F.col("_size")).when(F.col("_last"), F.greatest(F.lit(0), target - F.coalesce(others, F.lit(0)))).otherwise(F.col("_share"))
    return quota_sample(df, [by], counts.select(by, quota.alias("quota")), _draw(seed, key) if draw is None else draw, key)


def scaled_targets(targets: dict[str, int], total: int) -> dict[str, int]:
    """Targets scaled to a total, each at least one."""
    whole = sum(targets.values())
    return {k: max(1, round(v * total / whole)) for k, v in targets.items()}


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Rows in the order of a seeded hash of their key."""
    return df.orderBy(_draw(seed, key), key)


def drawn_ranks(key: Column, total: int, n: int, seed: int) -> Column:
    """``n`` different numbers below ``total`` (all of them if there are
    fewer), in the order drawn; every choice is equally likely.

    The j-th draw is a number below total - j, moved past those drawn before.
    """

    def draw(chosen: Column, j: Column) -> Column:
        raw = F.pmod(F.xxhash64(F.lit(seed), key, j), (F.lit(total) - j).cast("bigint"))
        return F.aggregate(F.array_sort(chosen), raw, lambda v, c: v + F.when(c <= v, F.lit(1)).otherwise(F.lit(0)).cast("bigint"))

    many = min(n, total)
    if not many:
        return F.array().cast("array<bigint>")
    return F.aggregate(F.sequence(F.lit(0), F.lit(many - 1)), F.array().cast("array<bigint>"), lambda chosen, j: F.concat(chosen, F.array(draw(chosen, j))))


def fewshot(docs: DataFrame, pool: DataFrame, n: int, key: str = "doc_id", mode: str = "random", seed: int = 1234) -> DataFrame:
    """``key, shots``: for each document an array of ``n`` pool rows, never
    the document itself; fewer only where the pool has not as many others.

    "random" draws ranks of the whole pool from a hash of the document and
    joins them to the numbered pool; "first" takes the first rows by key.  One
    more is drawn so that the document's own row can go.  Keys are unique and
    not null.  An empty pool gives empty arrays.
    """
    shown = F.struct(*(F.col(c) for c in pool.columns))
    if mode == "first":
        few = pool.orderBy(key).limit(n + 1)
        rows = few.agg(F.sort_array(F.collect_list(F.struct(F.col(key).alias("r"), shown.alias("c")))).alias("_drawn"))
        both = docs.select(key).crossJoin(F.broadcast(rows))  # one row of n + 1 elements
    else:
        ranked = numbered(pool, key, "_rank").select("_rank", shown.alias("_c"))
        asked = docs.select(key, F.posexplode_outer(drawn_ranks(F.col(key), pool.count(), n + 1, seed)).alias("_at", "_rank"))
        found = asked.join(ranked, "_rank", "left").groupBy(key)
        both = found.agg(F.sort_array(F.collect_list(F.when(F.col("_c").isNotNull(), F.struct(F.col("_at").alias("r"), F.col("_c").alias("c"))))).alias("_drawn"))
    others = F.filter("_drawn", lambda s: s["c"][key] != F.col(key))
    return both.select(key, F.transform(F.slice(others, 1, n), lambda s: s["c"]).alias("shots"))


def uniform_positions(total: Column, k: int) -> Column:
    """``k`` positions spread evenly from 0 to total - 1."""
    step = (total - 1) / float(max(k - 1, 1))
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * step).cast("int"))


def shuffle_options(df: DataFrame, options: str, answer: str, key: str, seed: int = 42) -> DataFrame:
    """Options in an order drawn from the key, and the answer's new letter."""
    drawn = F.array_sort(F.transform(F.col(options), lambda o, k: F.struct(F.xxhash64(F.lit(seed), F.col(key), k, o).alias("h"), k.alias("k"), o.alias("o"))))
    old = F.ascii(answer) - 65
    place = F.array_position(F.transform(drawn, lambda s: s["k"]), old)
    return df.withColumns({options: F.transform(drawn, lambda s: s["o"]), answer: F.when(place > 0, F.chr((place + 64).cast("int")))})


def numbered_options(options: Column) -> Column:
    """Options as ``1. text``, ``2. text``."""
    return F.transform(options, lambda o, k: F.concat((k + 1).cast("string"), F.lit(". "), o))


def none_of_the_above(options: Column, answer: Column, text: str = "None of the above") -> Column:
    """Options with the answer's text replaced."""
    return F.transform(options, lambda o, k: F.when(k == F.ascii(answer) - 65, F.lit(text)).otherwise(o))


def repeated(df: DataFrame, repeats: int, name: str = "repeat") -> DataFrame:
    """Each row ``repeats`` times, numbered from 0."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
