"""Near copies by the Jaccard similarity of five-word shingles.

This is the near-duplicate operator at the setting of corpus stages: five
words and a similarity of 0.8 or more.  Candidates come from the classes of
SimHash (``simhash.near_links``) and from minimum hashes, since SimHash alone
loses most pairs there: a similarity of 0.8 is an expected distance of 10 of
64 bits with a deviation of 3 (measured: 27 % of the pairs at 0.80 to 0.85 lie
within 7 bits), and chains of segments with budgets for 17 bits leave no exact
segment to look up.

1. Equal texts are one node (MD5 of the text), sorted by its smallest id.
2. A node gets the fingerprint of its five-word shingles; the class that
   fingerprints of ``BITS`` differing bits or fewer connect is its first key.
   ``BANDS`` keys of ``ROWS`` minimum hashes each follow.  Two texts of
   similarity s share one of those with probability 1 - (1 - s^ROWS)^BANDS:
   0.997 at 0.8, more above, 0.12 at 0.5.
3. Nodes of one key are compared by their exact similarity.  In each round the
   smallest nodes of a key, its hubs (1, 2, 4, ... of them), are compared with
   all others of the key; a node that reaches the threshold with a smaller one
   leaves, and so do the hubs once compared with all.  Rounds go on until no
   key has two nodes left, so of all nodes that stay no two with a common key
   reach the threshold, yet a group of copies costs pairs in proportion to its
   size.
4. Confirmed pairs are linked; components are the classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorewright.llm.rows import named, pieces
from scorewright.llm.simhash import SEED, fingerprint, near_links, shingle_bounds
from scorewright.operators.graph import connected_components
from scorewright.sources.staging import staged

WIDTH = 5
#: Least similarity of near copies, in hundredths.
LEAST = 80
BANDS, ROWS = 32, 8
#: Differing bits at which fingerprints are linked.
BITS = 3
#: Shingles that are hashed at once.
CHUNK = 4096

_RANDOM = np.random.default_rng(SEED)
_FLIP = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_TIMES = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) << np.uint64(1) | np.uint64(1)


def shingles(text: str | None, width: int = WIDTH) -> set[bytes]:
    """Distinct shingles: A-Z in lower case, words between ASCII white space.

    A text of fewer words is one shingle; without words (or null), an empty one.
    """
    joined, bounds = shingle_bounds((text or "").encode("utf-8", "surrogatepass").lower().split(), width)
    return {joined[a:b] for a, b in bounds}


def band_keys(text: str | None, width: int = WIDTH) -> np.ndarray:
    """One key for each band, as signed longs."""
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, SEED) for s in shingles(text, width)], dtype=np.uint64)
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), CHUNK):
        np.minimum(low, ((hashes[at : at + CHUNK, None] ^ _FLIP) * _TIMES).min(axis=0), out=low)
    bands = low.reshape(BANDS, ROWS)
    return np.array([digest(bands[k].tobytes(), k) for k in range(BANDS)], dtype=np.uint64).view(np.int64)


def alike(a: set[bytes], b: set[bytes], least: int = LEAST) -> bool:
    """Whether the Jaccard similarity is ``least`` hundredths or more, exactly."""
    common = len(a & b)
    return 100 * common >= least * (len(a) + len(b) - common)


def _node(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")))


def _place(none: Column, number: Column, node: Column) -> Column:
    """Sixteen bytes that sort by id (null ids last), then by node."""
    digits = F.lpad(F.hex(number.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return F.unhex(F.concat(F.when(none, "F" * 16).otherwise(digits), F.left(F.hex(node), F.lit(16))))


def with_keys(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """``node, none, id, fp, keys`` for every row; none marks a null id, fp is the fingerprint."""
    long_id = named(id_col).cast("long")
    rows = docs.select(
        _node(named(text_col)).alias("node"),
        long_id.isNull().alias("none"),
        F.coalesce(long_id, F.lit(0)).cast("long").alias("id"),
        named(text_col).cast("string").alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in pieces(whole)):
            texts = batch.column(3).to_pylist()
            made = [band_keys(t, width) for t in texts]
            fps = np.array([fingerprint(t, width) for t in texts], dtype=np.uint64)
            flat = pa.array(np.concatenate(made) if made else np.array([], np.int64))
            keys = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, BANDS), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(fps.view(np.int64)), keys], names=["node", "none", "id", "fp", "keys"])

    return rows.mapInArrow(run, "node binary, none boolean, id long, fp long, keys array<long>")


def simhash_keys(nodes: DataFrame) -> DataFrame:
    """``place, key`` of the nodes (``place, fp``) whose SimHash class has others."""
    prints = staged(nodes.groupBy("fp").agg(F.count("*").alias("n")), "fingerprints")
    classes = connected_components(near_links(prints.select("fp"), BITS)).withColumnRenamed("node", "fp")
    shared = prints.join(classes, "fp", "left").where("n > 1 or component is not null").select("fp", F.coalesce("component", "fp").alias("key"))
    return nodes.select("place", "fp").join(shared, "fp").select("place", "key")


def confirmed(pairs: DataFrame, texts: DataFrame, least: int, width: int) -> DataFrame:
    """Those ``src, dst`` whose texts (``node, text``) reach the similarity."""
    left = texts.select(F.col("node").alias("src"), F.col("text").alias("a"))
    right = texts.select(F.col("node").alias("dst"), F.col("text").alias("b"))
    both = pairs.join(left, "src").join(right, "dst").select("src", "dst", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, known = None, set()
        for batch in batches:
            keep = []
            for dst, a, b in zip(batch.column(1), batch.column(2), batch.column(3), strict=True):
                if dst.as_py() != hub:
                    hub, known = dst.as_py(), shingles(b.as_py(), width)
                keep.append(alike(shingles(a.as_py(), width), known, least))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "src binary, dst binary")


def _links(live: DataFrame, texts: DataFrame, least: int, width: int) -> DataFrame:
    """Confirmed pairs ``src, dst`` among the rows ``key, node`` of common keys."""
    found, hubs_of = None, 1
    while True:
        order = Window.partitionBy("key").orderBy("node")
        hubs = staged(live.withColumn("n", F.row_number().over(order)).where(F.col("n") <= hubs_of).drop("n"), "hubs")
        hub = hubs.select("key", F.col("node").alias("dst"))
        pairs = live.join(hub, "key").where(F.col("node") > F.col("dst")).select(F.col("node").alias("src"), "dst").distinct()
        links = staged(confirmed(pairs, texts, least, width), "links")
        found = links if found is None else found.union(links)
        gone = links.select(F.col("src").alias("node")).distinct()
        left = staged(live.join(hubs, ["key", "node"], "left_anti").join(gone, "node", "left_anti"), "live")
        several = left.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
        live = staged(left.join(several, "key", "left_semi"), "live")
        if live.isEmpty():
            return found
        hubs_of *= 2


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, least: int = LEAST) -> DataFrame:
    """The rows of ``docs`` that stand for their class, with their own columns.

    A class is what confirmed pairs of texts with a Jaccard similarity of
    ``least`` hundredths or more connect, and no two rows that stay make such
    a pair (see above); null and texts without words are alike.  One
    row of each class stays, that with the smallest id, a row without an id
    only where its class has none.  Different texts under one id are rows of
    their own.  An empty table gives an empty result.
    """
    prints = staged(with_keys(docs, id_col, text_col, width), "prints")
    first = F.min(F.struct("none", "id")).alias("first")
    nodes = prints.groupBy("node").agg(first, F.any_value("fp").alias("fp"), F.any_value("keys").alias("keys")).select("node", "first.none", "first.id", "fp", "keys")
    nodes = staged(nodes.withColumn("place", _place(F.col("none"), F.col("id"), F.col("node"))), "nodes")
    keyed = simhash_keys(nodes).union(nodes.select("place", F.explode("keys").alias("key")))
    several = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    live = staged(keyed.join(several, "key", "left_semi").select("key", F.col("place").alias("node")), "live")
    shared = live.select(F.col("node").alias("place"), F.lit(True).alias("shared")).distinct()
    chosen = nodes.select("node", "none", "id", "place").join(shared, "place", "left")

    # texts are shuffled once: one row of each node, with its own columns
    long_id = named(id_col).cast("long")
    kept = [named(c).alias(f"c{k}") for k, c in enumerate(docs.columns)]
    rows = docs.select(
        *kept, _node(named(text_col)).alias("node"), long_id.isNull().alias("none"), F.coalesce(long_id, F.lit(0)).cast("long").alias("id")
    )
    key = ["node", "none", "id"]
    rows = staged(rows.join(chosen, key).dropDuplicates(key), "rows")
    back = [F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)]
    near = rows.where("shared")
    texts = near.select(F.col("place").alias("node"), F.col(f"c{docs.columns.index(text_col)}").cast("string").alias("text"))

    # the smallest place of a class never left, so no two that stay are alike
    found = connected_components(_links(live, texts, least, width))
    gone = found.where(F.col("node") != F.col("component")).select(F.col("node").alias("place"))
    stay = near.join(gone, "place", "left_anti")
    return rows.where("shared is null").select(*back).union(stay.select(*back))
