"""Minimax contiguous partition of ordered atomic groups into shards.

Rows with equal texts form a group that no cut may divide.  Groups stand in
the order of a 60-bit hash of their text.  The smallest capacity for which a
greedy left-to-right filling needs no more than the given number of shards is
found by binary search; the cuts are then made at that capacity.

The search never sees all groups.  The hash space is a tree of cells; the
driver holds the sums of one frontier of cells, at first ``FAN`` of them.  A
greedy filling over cells gives two bounds of the optimum: with every cell
atomic (feasible), and with cells of several groups divisible (a lower bound).
Only cells in which a cut may lie are opened, by one aggregation over their
groups, until every such cell is one group and the bounds meet.  At most a few
cells for each cut are open at a time, so the driver's state is bounded by
``FAN`` times the number of cuts, whatever the number of groups.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorewright.llm.rows import named
from scorewright.sources.staging import staged

HASH_BITS = 60
LEVEL_BITS = 12
FAN = 1 << LEVEL_BITS
#: Rows of a shard that are numbered in one task, about.
NUMBERED = 250_000


@dataclass(frozen=True)
class Cell:
    """The groups whose hash starts with the bits of ``low`` above ``bits``."""

    low: int
    bits: int  # bits of the hash that the cell leaves open
    size: int
    groups: int

    @property
    def divisible(self) -> bool:
        return self.groups > 1 and self.bits > 0


def filled(cells: list[Cell], shards: int, capacity: int, divide: bool) -> list[tuple[int, int]] | None:
    """Greedy filling: for each shard but the last, the cell in which the next
    shard starts and how much of it is taken before; None if it needs more
    shards.  With ``divide``, cells of several groups are cut at will."""
    cuts, room = [], capacity
    for k, cell in enumerate(cells):
        left = cell.size
        while left > room:
            if divide and cell.divisible:
                left -= room
                cuts.append((k, cell.size - left))
            elif left == cell.size and left <= capacity:
                cuts.append((k, 0))
            else:
                return None
            if len(cuts) >= shards:
                return None
            room = capacity
        room -= left
    return cuts + [(len(cells), 0)] * (shards - 1 - len(cuts))


def least_capacity(cells: list[Cell], shards: int, divide: bool) -> int:
    """The smallest capacity for which the filling succeeds."""
    lo, hi = 0, sum(c.size for c in cells)
    while lo < hi:
        mid = (lo + hi) // 2
        if filled(cells, shards, mid, divide) is None:
            lo = mid + 1
        else:
            hi = mid
    return lo


def _to_open(cells: list[Cell], shards: int, low: int, high: int) -> set[int]:
    """Cells that a cut may fall into for some capacity between the bounds."""
    near = filled(cells, shards, low, True)
    far = filled(cells, shards, high, True)
    first = _lowest_reach(cells, shards, low)
    found: set[int] = set()
    for (a, _), (b, _), (c, _) in zip(first, near, far, strict=True):
        found.update(k for k in range(min(a, b), min(max(b, c) + 1, len(cells))) if cells[k].divisible)
    return found


def _lowest_reach(cells: list[Cell], shards: int, capacity: int) -> list[tuple[int, int]]:
    """Greedy cuts with atomic cells, a cell larger than the capacity taken
    alone: no true cut lies before these."""
    cuts, room = [], capacity
    for k, cell in enumerate(cells):
        if cell.size > room and len(cuts) < shards - 1:
            cuts.append((k, 0))
            room = capacity
        room -= cell.size
    return cuts + [(len(cells), 0)] * (shards - 1 - len(cuts))


def _sums(groups: DataFrame, wanted: list[Cell] | None) -> list[Cell]:
    """Cells one level below ``wanted`` (the first level if None)."""
    bits = HASH_BITS - LEVEL_BITS if wanted is None else None
    if wanted is None:
        parts = [(groups, bits)]
    else:
        parts = []
        for level in sorted({c.bits for c in wanted}):
            lows = [c.low for c in wanted if c.bits == level]
            parts.append((groups.where((F.col("h") - F.pmod("h", F.lit(1 << level))).isin(lows)), max(0, level - LEVEL_BITS)))
    out = []
    for rows, left in parts:
        low = F.col("h") - F.pmod("h", F.lit(1 << left))
        found = rows.groupBy(low.alias("low")).agg(F.sum("bytes").alias("size"), F.count("*").alias("groups")).collect()
        out += [Cell(r["low"], left, r["size"], r["groups"]) for r in found]
    return out


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[list[int], int]:
    """Hashes at which shards 1, 2, ... start, and the largest shard's size.

    ``groups`` has ``h`` (distinct longs below 2^60) and ``bytes`` (positive).
    A cut beyond the last group is 2^60.
    """
    cells = sorted(_sums(groups, None), key=lambda c: c.low)
    while True:
        high = least_capacity(cells, shards, divide=False)
        low = least_capacity(cells, shards, divide=True)
        opened = _to_open(cells, shards, low, high) if low < high else set()
        if not opened:
            break
        cells = sorted([c for k, c in enumerate(cells) if k not in opened] + _sums(groups, [cells[k] for k in opened]), key=lambda c: c.low)
    cuts = filled(cells, shards, high, divide=False)
    return [cells[k].low if k < len(cells) else 1 << HASH_BITS for k, _ in cuts], high


def text_hash(text: Column) -> Column:
    """The order of the groups: 60 bits of the text's hash.  Texts that share
    it by chance share a group, which is safe."""
    return F.shiftrightunsigned(F.xxhash64(text), 64 - HASH_BITS)


def shard_by_bytes(
    docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """Every row with ``shard`` and ``slot`` (and the columns in ``keep``).

    Columns: ``doc_id, size, text_crc32, shard, slot``.  Size is the UTF-8
    bytes of the text plus 1; a null text counts as empty and groups with
    empty ones.  Slots of a shard run from 0 without gaps, over the rows in
    buckets of a hash of the id.  Repeated rows get slots of their own.  Fewer
    groups than shards leave shards empty, and so does an empty table.

    The texts are read once, into a staged table of hashes and sizes.  A
    group's bytes are pre-aggregated in each task.  Shards follow from the hash by comparison with
    the cuts, so no join brings them back.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    text = F.coalesce(named(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        *(named(c).alias(f"k{k}") for k, c in enumerate(keep or ())),
        named(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        text_hash(text).alias("h"),
    )
    rows = staged(rows, "sizes")  # the texts are read once
    groups = staged(rows.groupBy("h").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "groups")
    cuts, _ = minimax_cuts(groups, shards)
    n = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    shard = sum(((F.col("h") >= F.lit(c)).cast("int") for c in cuts), F.lit(0))
    buckets = max(256, n // NUMBERED)
    rows = rows.withColumns({"shard": shard, "bucket": F.pmod(F.xxhash64("doc_id"), F.lit(buckets))})
    counts = rows.groupBy("shard", "bucket").count()
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "h")
    placed = rows.withColumn("at", F.row_number().over(within).cast("long") - 1).join(offsets, ["shard", "bucket"])
    kept = [F.col(f"k{k}").alias(c) for k, c in enumerate(keep or ())]
    return placed.select(*kept, "doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("at")).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 8, text_col: str = "text", shard_col: str = "shard") -> None:
    """Write the rows as Parquet in one folder for each shard.

    The shard is in the folder's name, ``shard_col``, which no column may have
    (an error, as two columns of one name cannot be read back).  Null texts
    are empty ones; repeated rows share a shard; an empty table writes no rows.
    """
    if shard_col in docs.columns:
        raise ValueError(f"the table has a column {shard_col}; name another for the folders")
    text = F.coalesce(named(text_col).cast("string"), F.lit(""))
    groups = docs.select(text_hash(text).alias("h"), F.octet_length(text).alias("n")).groupBy("h").agg(F.sum(F.col("n") + 1).alias("bytes"))
    cuts, _ = minimax_cuts(staged(groups, "groups"), shards)
    shard = sum(((text_hash(text) >= F.lit(c)).cast("int") for c in cuts), F.lit(0))
    docs.withColumn(shard_col, shard).write.partitionBy(shard_col).parquet(path)
