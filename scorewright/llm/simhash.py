"""SimHash near-duplicates, with a pigeonring filter before the Hamming check.

A fingerprint has 64 bits.  Texts become candidates in three steps:

1. equal fingerprints are folded into one row (pre-aggregated, so a group of
   copies of any size travels as one row per task);
2. the 64 bits are a ring of eight segments of eight bits.  If two
   fingerprints differ in at most t bits, then from some segment on every
   chain of l consecutive segments differs in at most floor(l * t / 8) bits.
   For t = 3 the budgets along the chain are 0 0 1 1 1 2 2 3.  Each
   fingerprint is sent to eight keys, one per start of a chain, made of the
   segments whose budget is zero;
3. inside a key the segments with the next budget (at most one differing bit)
   are looked up by probing every allowed change in a sorted array, the rest
   of the chain is checked, then the full distance.

Each task returns one edge per fingerprint to the smallest it is linked with
there, never all pairs; components of these edges are the classes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewright.llm.rows import named, with_arrow_columns
from scorewright.operators.graph import connected_components
from scorewright.sources.staging import staged

BITS = 64
SEGMENT = 8
SEGMENTS = BITS // SEGMENT
SEED = 42
#: Pairs that are compared at once inside a task.
BLOCK = 1 << 20
#: Shingles whose bits are unpacked at once.
CHUNK = 1 << 16
#: Rows of whole keys that a task gathers before it compares them, and rows of a partition, about.
GATHERED, PARTITION = 500_000, 4_000_000


def shingle_bounds(words: list[bytes], width: int) -> tuple[bytes, Iterator[tuple[int, int]]]:
    """The words joined by spaces, and start and end of each shingle in it."""
    joined = b" ".join(words)
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[:-1])]
    if len(words) <= width:
        return joined, iter([(0, len(joined))])
    return joined, zip(starts[: len(words) - width + 1], ends[width - 1 :], strict=True)


def fingerprint(text: str | None, width: int = 3) -> int:
    """SimHash of a text: A-Z in lower case, words between ASCII white space.

    Shingles of ``width`` words count as often as they occur; a text of fewer
    words is one shingle; a text without words (or null) gets zero.  A bit is
    set if more than half of the shingle hashes (XXH64, seed 42) have it.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, bounds = shingle_bounds(words, width)
    digest = xxhash.xxh64_intdigest
    ones, n = np.zeros(BITS, np.int64), 0
    while some := [digest(joined[a:b], SEED) for a, b in islice(bounds, CHUNK)]:
        bits = np.unpackbits(np.array(some, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
        n += len(some)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``doc_id, fp`` for every row; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, width) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    rows = docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def chain_budgets(limit: int) -> list[int]:
    """Allowed differing bits of the first 1, 2, ... segments of a chain."""
    return [(n + 1) * limit // SEGMENTS for n in range(SEGMENTS)]


def _rotated(fps: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Fingerprints with segment ``start`` (from the top) moved to the top."""
    by = (start.astype(np.uint64) * np.uint64(SEGMENT)) & np.uint64(BITS - 1)
    back = (np.uint64(BITS) - by) & np.uint64(BITS - 1)
    return (fps << by) | (fps >> back)


def _fold(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give both ends of each link the smaller label until nothing changes."""
    while len(a):
        la, lb = label[a], label[b]
        differ = la != lb
        if not differ.any():
            return
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        low = np.minimum(la, lb)
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        while (label[label] != label).any():
            label[:] = label[label]


def linked(start: np.ndarray, fps: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (fingerprint, smallest linked one) among the rows of whole keys.

    ``start`` and ``fps`` hold every row of the keys present.  Exact: every
    pair of rows of one key that differs in at most ``limit`` bits ends up
    with one label.
    """
    budgets = chain_budgets(limit)
    exact = sum(b == 0 for b in budgets)
    near = sum(b <= 1 for b in budgets)  # segments whose chain may differ in one bit at most
    unique, back = np.unique(fps, return_inverse=True)
    label = np.arange(len(unique))
    turned = _rotated(fps, start)
    prefix = turned >> np.uint64(BITS - SEGMENT * near) if near else np.zeros(len(fps), np.uint64)
    # numpy has no 128-bit ints: rows of one start are handled together
    for s in np.unique(start):
        rows = np.flatnonzero(start == s)
        rows = rows[np.argsort(prefix[rows], kind="stable")]
        sorted_prefix, ring, ident = prefix[rows], turned[rows], back[rows]
        free = SEGMENT * (near - exact)
        for flip in [0, *(1 << b for b in range(free))]:
            wanted = sorted_prefix ^ np.uint64(flip)
            lo = np.searchsorted(sorted_prefix, wanted, "left")
            hi = np.searchsorted(sorted_prefix, wanted, "right")
            if flip == 0:
                lo = np.maximum(lo, np.arange(len(rows)) + 1)  # each pair once
            else:
                lo = np.where(wanted > sorted_prefix, lo, hi)
            n = hi - lo
            if not n.any():
                continue
            ends = np.cumsum(n)
            done = 0
            while done < ends[-1]:  # blocks of pairs, never all of them at once
                to = min(done + BLOCK, int(ends[-1]))
                at = np.arange(done, to)
                left = np.searchsorted(ends, at, "right")
                right = lo[left] + (at - (ends[left] - n[left]))
                diff = ring[left] ^ ring[right]
                ok = np.bitwise_count(diff) <= limit
                for length in range(near + 1, SEGMENTS):
                    ok &= np.bitwise_count(diff >> np.uint64(BITS - SEGMENT * length)) <= budgets[length - 1]
                _fold(label, ident[left[ok]], ident[right[ok]])
                done = to
    moved = np.flatnonzero(label != np.arange(len(unique)))
    return unique[moved], unique[label[moved]]


def near_links(prints: DataFrame, limit: int = 3) -> DataFrame:
    """Edges ``src, dst`` that connect all distinct fingerprints within ``limit`` bits.

    ``prints`` has distinct ``fp`` (signed long).  The edges span the same
    components as all pairs within the limit would.
    """
    if not 0 <= limit < SEGMENTS:
        raise ValueError(f"limit must be from 0 to {SEGMENTS - 1}: a chain needs a segment without differences")
    exact = SEGMENT * sum(b == 0 for b in chain_budgets(limit))
    starts = prints.select("fp", F.explode(F.sequence(F.lit(0), F.lit(SEGMENTS - 1))).alias("start"))
    turned = F.expr(f"shiftleft(fp, start * {SEGMENT}) | shiftrightunsigned(fp, ({BITS} - start * {SEGMENT}) % {BITS})")
    keyed = starts.select("fp", F.col("start").cast("long").alias("start"), F.shiftrightunsigned(turned, BITS - exact).alias("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for start, fps in _whole_keys(batches):
            a, b = linked(start, fps, limit)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["src", "dst"])

    spark = prints.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), SEGMENTS * prints.count() // PARTITION)
    placed = keyed.repartition(parts, "start", "key").sortWithinPartitions("start", "key")
    return placed.mapInArrow(run, "src long, dst long")


def _whole_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``start`` and ``fp`` of rows sorted by start and key, in pieces of
    whole keys and about ``GATHERED`` rows, or one larger key."""
    held: list[np.ndarray] = []  # rows x (fp, start, key)
    many = 0
    for batch in batches:
        rows = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(3)], axis=1)
        if not len(rows):
            continue
        held.append(rows)
        many += len(rows)
        if many < GATHERED:
            continue
        every = np.concatenate(held)
        ends = np.flatnonzero((np.diff(every[:, 1:], axis=0) != 0).any(axis=1))
        cut = int(ends[-1]) + 1 if len(ends) else 0  # the last key may go on
        if cut:
            yield every[:cut, 1], np.ascontiguousarray(every[:cut, 0]).view(np.uint64)
        held, many = [every[cut:]], len(every) - cut
    if many:
        every = np.concatenate(held)
        yield every[:, 1], np.ascontiguousarray(every[:, 0]).view(np.uint64)


def components(prints: DataFrame, limit: int = 3) -> DataFrame:
    """``doc_id, fp, component_id`` for every row of ``doc_id, fp``.

    Rows whose fingerprints differ in at most ``limit`` bits, directly or
    through others, share the smallest doc_id of their component.  Null ids
    are never chosen while another exists; a component of null ids only has a
    null component_id.  Repeated rows all come back.
    """
    prints = staged(prints, "simhash")
    distinct = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "fingerprints")
    found = connected_components(near_links(distinct.select("fp"), limit))
    member = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first_id", F.coalesce("component", "fp").alias("component")
    )
    lowest = member.groupBy("component").agg(F.min("first_id").alias("component_id"))
    classes = member.join(lowest, "component").select("fp", "component_id")
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, limit: int = 3) -> DataFrame:
    """SimHash classes of whole texts: ``doc_id, fingerprint, component_id``.

    Null and empty texts have no words and share the fingerprint zero, which
    links like any other.  Other columns of ``docs`` are not read.  An empty
    table gives an empty result.
    """
    found = components(with_fingerprints(docs, id_col, text_col, width), limit)
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, limit: int = 3) -> DataFrame:
    """The rows of ``docs`` that stand for their class, with their own columns.

    The smallest id of each class stays, once even if its row is repeated.  A
    row without an id goes if its class has one, and stays once for each
    fingerprint if not.  Texts are shuffled once, by id.
    """
    found = staged(near_duplicates(docs, id_col, text_col, width, limit), "classes")
    own = named(id_col).cast("long")
    chosen = found.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("_chosen")).distinct()
    back = [F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)]
    rows = docs.select(*(named(c).alias(f"c{k}") for k, c in enumerate(docs.columns)), own.alias("_chosen"))
    kept = rows.join(chosen, "_chosen", "left_semi").dropDuplicates(["_chosen"]).select(*back)

    def start():
        def make(texts: list) -> list[pa.Array]:
            fps = np.array([fingerprint(t, width) for t in texts], dtype=np.uint64)
            return [pa.array([f"{x:016x}" for x in fps.tolist()], pa.string())]

        return make

    rows, back = with_arrow_columns(docs.where(own.isNull()), [named(text_col).cast("string")], start, "fingerprint string")
    alone = found.where("doc_id is null and component_id is null").select("fingerprint").distinct()
    return kept.union(rows.join(alone, "fingerprint", "left_semi").dropDuplicates(["fingerprint"]).select(*back))
