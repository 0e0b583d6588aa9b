"""Hard negatives by largest inner product within a window, over cover trees.

The score of a row is its inner product with the anchor.  Inner products are
not a metric, so every candidate x gets one more component, sqrt(M^2 - |x|^2)
with M the largest norm of its tree, and the anchor a zero: then all
candidates have one norm, and |q.x - q.c| <= |q| |x' - c'| for any two of
them.  A node of a cover tree knows its centre and the radius that covers all
below it, so its inner products lie within q.c +- |q| radius.  The descent
takes the node with the largest bound first, skips nodes that no window meets
or that cannot reach the k-th best, and scores the points of a leaf exactly.

Candidates are dealt to blocks of about ``block_rows`` rows by a hash of the
row, so a hot label is as evenly spread as any other; a block has a tree for
each label of its own and one for all labels with few rows.  Anchors are the
stated query set: they go to the blocks in chunks of a bounded number of
vector components, one pass over the blocks for each.  Every block returns its
best for each anchor, and the best of all blocks are kept.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorewright.llm.rows import named
from scorewright.sources.staging import staged

#: Points of a node that is not split further, and of a label that gets no tree of its own.
LEAF = 24
BLOCK_ROWS = 8192
#: Vector components of the anchors that are broadcast at once: 8 MB.
CHUNK_CELLS = 1 << 20
_LONG = 1 << 63


class Node:
    """Points below a centre: those scored here, and smaller nodes."""

    __slots__ = ("centre", "radius", "points", "below", "centres", "radii")

    def __init__(self, space: np.ndarray, members: np.ndarray, centre: int, radius: float) -> None:
        self.centre, self.radius, self.points, self.below = centre, radius, members, []
        if len(members) <= LEAF or not radius > 0:
            return
        # a net of half the radius: farthest points become centres until all are covered
        centres, owner = [centre], np.zeros(len(members), np.int64)
        near = np.linalg.norm(space[members] - space[centre], axis=1)
        while near.max() > radius / 2:
            far = members[near.argmax()]
            gap = np.linalg.norm(space[members] - space[far], axis=1)
            closer = gap < near
            owner[closer], near = len(centres), np.minimum(near, gap)
            centres.append(far)
        alone = []
        for k, c in enumerate(centres):
            own = owner == k
            if own.sum() == 1:
                alone.append(members[own])
            else:
                self.below.append(Node(space, members[own], c, float(near[own].max())))
        self.points = np.concatenate(alone) if alone else members[:0]
        self.centres = np.array([n.centre for n in self.below], np.int64)
        self.radii = np.array([n.radius for n in self.below])


class CoverTree:
    """A tree over the rows of ``vectors`` named by ``members``."""

    def __init__(self, vectors: np.ndarray, members: np.ndarray) -> None:
        own = vectors[members]
        size = np.einsum("ij,ij->i", own, own)
        self.norm = float(np.sqrt(size.max()))
        space = np.zeros((len(vectors), vectors.shape[1] + 1))
        space[members, :-1] = own
        space[members, -1] = np.sqrt(np.maximum(size.max() - size, 0))
        gap = np.linalg.norm(space[members] - space[members[0]], axis=1)
        self.root = Node(space, members, members[0], float(gap.max()))


def dots(vectors: np.ndarray, query: np.ndarray, largest: float) -> np.ndarray:
    """Inner products of whole numbers, exactly; beyond 53 bits by Python's integers."""
    if len(query) * largest * float(np.abs(query).max(initial=0)) < 1 << 53:
        return vectors @ query
    wide = [int(x) for x in query]
    return np.array([sum(int(a) * b for a, b in zip(row, wide, strict=True)) for row in vectors], dtype=object)


def matrix(vectors: pa.ChunkedArray | pa.Array, width: int = 0) -> np.ndarray:
    """Rows of whole numbers floor(256 x); shorter ones end with zeros."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    sizes = np.diff(vectors.offsets.to_numpy())
    out = np.zeros((len(sizes), max([width, *sizes.tolist()])))
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.floor(256 * flat)
    return out


class Block:
    """Rows of a block with their trees."""

    def __init__(self, rows: pa.Table, width: int) -> None:
        self.rid, self.label = rows["rid"].to_numpy(), rows["label"].to_numpy()
        self.ids = rows["vec_id"].to_pylist()
        self.vectors = matrix(rows["vec"], width)
        self.largest = float(np.abs(self.vectors).max(initial=0))
        self.trees: list[tuple[int | None, CoverTree]] = []
        few = []
        for label in np.unique(self.label):
            members = np.flatnonzero(self.label == label)
            if len(members) > LEAF:
                self.trees.append((int(label), CoverTree(self.vectors, members)))
            else:
                few.append(members)
        if few:
            self.trees.append((None, CoverTree(self.vectors, np.concatenate(few))))

    def search(self, query: np.ndarray, rid: int, label: int, same: bool, windows: list[tuple[int, int]], k: int) -> list[list[tuple]]:
        """The first k rows of each window (lowest and highest score) among
        the rows of the same label or of the others; the row itself is none."""
        best: list[list[tuple]] = [[] for _ in windows]
        length = float(np.sqrt(query @ query))

        def wanted(low: float, high: float) -> bool:
            """Whether scores from low to high can change a window's rows."""
            return any(not (high < lo or low > hi) and not (len(b) == k and high < b[-1][1]) for (lo, hi), b in zip(windows, best, strict=True))

        def score(points: np.ndarray) -> None:
            points = points[((self.label[points] == label) == same) & (self.rid[points] != rid)]
            if not len(points):
                return
            found = dots(self.vectors[points], query, self.largest)
            for (lo, hi), b in zip(windows, best, strict=True):
                fit = (found >= lo) & (found <= hi)
                if len(b) == k:
                    fit &= found >= b[-1][1]
                if fit.any():
                    for p, s in zip(points[fit].tolist(), found[fit].tolist(), strict=True):
                        i = self.ids[p]
                        b.append(((-int(s), i is None, i or 0, int(self.rid[p])), int(s), i))
                    b.sort()
                    del b[k:]

        queue: list[tuple] = []
        for at, (name, tree) in enumerate(self.trees):
            if name is None or (name == label) == same:
                reach = length * tree.root.radius
                slack = 1e-9 * length * (tree.norm + tree.root.radius)
                middle = float(self.vectors[tree.root.centre] @ query)
                heapq.heappush(queue, (-(middle + reach + slack), middle - reach - slack, at, 0, tree.root, slack))
        count = 0
        while queue:
            high, low, at, _, node, slack = heapq.heappop(queue)
            if not wanted(low, -high):
                continue
            score(node.points)
            if node.below:
                middle = self.vectors[node.centres] @ query
                reach = length * node.radii + slack
                for n, m, r in zip(node.below, middle.tolist(), reach.tolist(), strict=True):
                    if wanted(m - r, m + r):
                        count += 1
                        heapq.heappush(queue, (-(m + r), m - r, at, count, n, slack))
        return best


def _chunks(asked: DataFrame, most: int) -> Iterator[list]:
    """Rows of ``asked`` in chunks of about ``most`` components; the driver holds one."""
    chunk, held = [], 0
    for row in asked.toLocalIterator():
        if chunk and held + len(row["vec"]) > most:
            yield chunk
            chunk, held = [], 0
        chunk.append(row)
        held += max(1, len(row["vec"]))
    if chunk:
        yield chunk


_FOUND = "arid long, positive int, score long, vec_id long, rid long"
_ARROW = pa.schema([("arid", pa.int64()), ("positive", pa.int32()), ("score", pa.int64()), ("vec_id", pa.int64()), ("rid", pa.int64())])


def _searcher(given, same: bool, k: int) -> Callable:
    """The search of one block for a chunk of anchors and their windows."""

    def run(block: pa.Table) -> pa.Table:
        queries = matrix(pa.array([q[2] for q in given.value], pa.list_(pa.float64())))
        held = Block(block, queries.shape[1])
        queries = np.pad(queries, ((0, 0), (0, held.vectors.shape[1] - queries.shape[1])))
        out: list[list] = [[] for _ in _ARROW]
        for (rid, label, _, windows), query in zip(given.value, queries, strict=True):
            for n, best in enumerate(held.search(query, rid, label, same, windows, k)):
                for key, s, i in best:
                    for column, value in zip(out, (rid, n, min(max(s, -_LONG), _LONG - 1), i, key[-1]), strict=True):
                        column.append(value)
        return pa.table([pa.array(c, f.type) for c, f in zip(out, _ARROW, strict=True)], schema=_ARROW)

    return run


def _searched(rows: DataFrame, asked: DataFrame, same: bool, windows: Callable, k: int, cells: int, name: str) -> DataFrame:
    """Best k of every block for each anchor and window, staged, then of all."""
    spark, tables = rows.sparkSession, []
    for chunk in _chunks(asked, cells):
        given = spark.sparkContext.broadcast([(r["rid"], r["label"], r["vec"], windows(r)) for r in chunk])
        tables.append(staged(rows.groupBy("block").applyInArrow(_searcher(given, same, k), _FOUND), name))
        given.unpersist()
    found = tables[0] if tables else spark.createDataFrame([], _FOUND)
    for t in tables[1:]:
        found = found.union(t)
    order = [F.desc("score"), F.asc_nulls_last("vec_id"), "rid"]
    first = Window.partitionBy("arid", "positive").orderBy(*order)  # k rows of a block each
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)


def _above(share: int, score: int) -> int:
    return -(-share * score // 100)


def hard_negatives(
    rows: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | str = "label", n_positives: int = 5,
    n_negatives: int = 10, least: int = 30, most: int = 90, block_rows: int = BLOCK_ROWS, cells: int = CHUNK_CELLS,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Components are taken as floor(256 x).  For each row where ``anchor`` holds
    and each of its first ``n_positives`` other rows of the same label, the
    first ``n_negatives`` rows of other labels whose score is from ``least``
    to ``most`` hundredths of the positive's.  Higher scores come first, ties
    by smaller id, null ids last.  ``label`` is a long.

    Rows with a null label or vector, or with a component that is null or not
    finite (or whose 256-fold is not) take no part.  Shorter vectors end with
    zeros, an empty one scores 0.  Repeated rows are rows of their own, also as
    anchors.  A null id is an anchor only if ``anchor`` holds for it.  Scores
    are exact; beyond a long they are cut to it.  Anchors without positives or
    negatives give no rows, nor does an empty table.
    """
    label = named(label) if isinstance(label, str) else label
    vec = named(vector_col).cast("array<double>")
    used = F.coalesce(F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * 256.0) < float("inf"))), F.lit(False))
    kept = rows.select(named(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), vec.alias("vec"), F.coalesce(anchor, F.lit(False)).alias("asked"), used.alias("used"))
    kept = kept.where("used and label is not null").select("vec_id", "label", "vec", "asked")
    kept = staged(kept.withColumn("rid", F.monotonically_increasing_id()), "vectors")
    blocks = max(1, -(-kept.count() // block_rows))
    dealt = kept.select(F.pmod(F.xxhash64("rid"), F.lit(blocks)).alias("block"), "rid", "vec_id", "label", "vec")

    anchors = kept.where("asked").select("rid", "vec_id", "label", "vec")
    positives = staged(_searched(dealt, anchors, True, lambda r: [(-(1 << 200), 1 << 200)], n_positives, cells, "positives"), "positives")
    each = positives.groupBy("arid").agg(F.array_sort(F.collect_list(F.struct("rank", "score"))).alias("scores"))
    asked = anchors.join(each.withColumnRenamed("arid", "rid"), "rid")
    windows = lambda r: [(_above(least, s["score"]), most * s["score"] // 100) for s in r["scores"]]
    negatives = _searched(dealt, asked, False, windows, n_negatives, cells, "negatives")

    named_ = anchors.select(F.col("rid").alias("arid"), F.col("vec_id").alias("anchor_id"))
    found = positives.select("arid", (F.col("rank") - 1).alias("positive"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = negatives.select("arid", "positive", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = out.join(found, ["arid", "positive"]).join(named_, "arid")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
