"""Hierarchical best-fit packing of token sequences.

Level 0 runs where the documents are read: each task tokenizes, cuts long
documents, and packs its pieces best-fit, largest first within a batch.  Bins
that are nearly full are final.  The bins that stay underfull are the items of
the next level: they are dealt to nodes of at most about ``NODE_BINS`` bins,
and each node packs its bins best-fit again.  Rounds go on, over ever fewer
nodes, as long as a round merges a good share of the bins; the last node packs
what is left.

Bins that do not merge (of 600 tokens each, say) would reach the last node in
any number.  When a round stalls, the rest is packed by counts: best fit,
largest first, over the number of bins of each fill (at most ``capacity``
rows, whatever the data) says which ranks of which fills share a bin, and a
join on fill and rank puts them there.  So no task holds more than a node.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorewright.llm.rows import named, pieces
from scorewright.sources.staging import staged

CAPACITY = 1024
END_ID = 2
#: Free tokens up to which a bin is final before the last level.
SLACK = 8
#: Bins of a node of the merge tree, about.
NODE_BINS = 50_000
#: Share of the bins that a round must leave merged for another one to follow.
LEAST_MERGED = 0.1
#: Parts of a fill whose bins are ranked apart.
RANK_PARTS = 64
#: The vocabulary's added token, one id wherever it stands in a text.
ADDED, ADDED_ID = "<|endoftext|>", 50256
#: Words that a task keeps the ids of.
CACHE = 1 << 17


class _Words(dict):
    """Ids of the words of a text, packed; a word is what a space precedes.

    The vocabulary's pattern starts a new piece at a space between two other
    characters, so such words are encoded alone.  Words that begin or end with
    white space, or are empty, are not kept: their text is encoded whole.
    """

    def __init__(self, encode) -> None:
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        if not word or word[0].isspace() or word[-1].isspace():
            raise LookupError(word)
        if len(self) >= CACHE:
            self.clear()
        self[word] = ids = np.asarray(self.encode(" " + word), "<u4").tobytes()
        return ids


@lru_cache(maxsize=2)
def _vocabulary(path: str | None, pattern: str | None) -> _Words:
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    made = tiktoken.Encoding(
        "ranks", pat_str=pattern or public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )
    return _Words(made.encode_ordinary)


def token_ids(text: str | None, path: str | None = None, pattern: str | None = None) -> bytes:
    """Ids of a text as little-endian unsigned 32-bit numbers; null is empty.

    The ids are those of the tokenizers library for the same vocabulary
    (``byte_bpe_50k.json``, no special tokens added; tested), read from its
    rank file because that encoder needs a third of the time.  The added token
    cuts a text into parts that are encoded alone.
    """
    if not text:
        return b""
    words = _vocabulary(path, pattern)
    if ADDED in text:
        return np.asarray([ADDED_ID], "<u4").tobytes().join(_plain_ids(x, words) for x in text.split(ADDED))
    return _plain_ids(text, words)


def _plain_ids(text: str, words: _Words) -> bytes:
    if not text:
        return b""
    first, *rest = text.split(" ")
    try:
        if not first or first[-1].isspace() or any(c.isspace() for c in (rest[-1][-1:] if rest else "")):
            raise LookupError(first)
        tail = b"".join(map(words.__getitem__, rest))
    except LookupError:
        return np.asarray(words.encode(text), "<u4").tobytes()
    return np.asarray(words.encode(first), "<u4").tobytes() + tail


def pieces_of(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """Start and length of the pieces of a document of ``n`` ids: whole if it
    fits, else full pieces after a first one that takes the remainder."""
    head = n % capacity or capacity
    return [(0, head), *((at, capacity) for at in range(head, n, capacity))]


class BestFit:
    """Open bins by free space; the tightest bin that fits takes an item."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.open: list[list[list]] = [[] for _ in range(capacity + 1)]
        self.free = 0  # bit f is set if a bin with f free tokens is open
        self.bins = 0

    def put(self, item, length: int) -> None:
        fits = self.free >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            bins = self.open[space]
            held = bins.pop()
            if not bins:
                self.free ^= 1 << space
            held.append(item)
        else:
            space, held = self.capacity, [item]
            self.bins += 1
        space -= length
        if not self.open[space]:
            self.free |= 1 << space
        self.open[space].append(held)

    def take(self, slack: int) -> Iterator[tuple[int, list]]:
        """Remove and return the bins with at most ``slack`` free tokens."""
        for space in range(min(slack, self.capacity) + 1):
            bins, self.open[space] = self.open[space], []
            if bins:
                self.free ^= 1 << space
                self.bins -= len(bins)
            for held in bins:
                yield self.capacity - space, held


_ITEM = "struct<doc_id:bigint,piece:int,start:bigint,length:bigint,ids_crc32:bigint>"
_BIN = f"seq bigint, fill int, final boolean, items array<{_ITEM}>"
_ITEM_TYPE = pa.list_(
    pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
)
_NAMES = [f.name for f in _ITEM_TYPE.value_type]


def _number(level: int, node: int, k: int) -> int:
    """A sequence number of its own: six bits of level, 29 of node, 28 of bin."""
    return level << 57 | node << 28 | k


#: Level of the numbers that the plan by counts gives.
PLANNED = 63


def _batch(level: int, node: int, bins: list[tuple[int, list, bool]], first: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array([_number(level, node, first + k) for k in range(len(bins))], pa.int64()),
            pa.array([fill for fill, _, _ in bins], pa.int32()),
            pa.array([final for _, _, final in bins], pa.bool_()),
            pa.array([[dict(zip(_NAMES, x, strict=True)) for x in held] for _, held, _ in bins], _ITEM_TYPE),
        ],
        names=["seq", "fill", "final", "items"],
    )


def _first_level(docs: DataFrame, id_col: str, text_col: str, capacity: int, slack: int, end_id: int, path: str | None) -> DataFrame:
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, fit, number = TaskContext.get().partitionId(), BestFit(capacity), 0
        for batch in batches:
            items = []
            for doc_id, text in (row for piece in pieces(batch) for row in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True)):
                ids = memoryview(token_ids(text, path) + end)
                for k, (at, n) in enumerate(pieces_of(len(ids) // 4, capacity)):
                    items.append((doc_id, k, at, n, zlib.crc32(ids[4 * at : 4 * (at + n)])))
            items.sort(key=lambda x: -x[3])
            for x in items:
                fit.put(x, x[3])
            done = [(fill, held, True) for fill, held in fit.take(slack)]
            # what a task keeps open is bounded too
            if fit.bins > NODE_BINS:
                done += [(fill, held, False) for fill, held in fit.take(capacity)]
            if done:
                yield _batch(0, node, done, number)
                number += len(done)
        left = [(fill, held, False) for fill, held in fit.take(capacity)]
        if left:
            yield _batch(0, node, left, number)

    rows = docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, _BIN)


def _next_level(bins: DataFrame, level: int, nodes: int, capacity: int, slack: int) -> DataFrame:
    """The bins dealt to ``nodes`` nodes, each packed best-fit; with one node
    all bins that come out are final."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        node, fit = int(key[0]), BestFit(capacity)
        for row in pdf.sort_values(["fill", "seq"], ascending=[False, True]).itertuples():
            fit.put(row.items, int(row.fill))
        made = list(fit.take(capacity))
        return pd.DataFrame(
            {
                "seq": [_number(level, node, k) for k in range(len(made))],
                "fill": [fill for fill, _ in made],
                "final": [nodes == 1 or capacity - fill <= slack for fill, _ in made],
                "items": [[x for part in held for x in part] for _, held in made],
            }
        )

    node = F.pmod(F.xxhash64("seq"), F.lit(nodes))
    return bins.withColumn("node", node).groupBy("node").applyInPandas(run, _BIN)


def planned(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best fit, largest first, over counts of bins by fill.

    Returns ``fill, first, last, bin, times``: the bins of this fill with rank
    first up to last (exclusive) go, ``times`` in each, to the bins from
    number ``bin`` on.  Bins that are packed alike are one class, so the work
    depends on the number of fills only.
    """
    out: list[tuple[int, int, int, int, int]] = []
    classes: dict[int, list[list[int]]] = {}  # free space: [first bin, number of bins]
    free, bins = 0, 0  # bit s of free is set if bins with s free tokens are open
    for fill in sorted(counts, reverse=True):
        rank, left = 0, counts[fill]
        while left:
            fits = free >> fill
            # an open bin that takes one of these is the tightest for the next one too
            space = fill + (fits & -fits).bit_length() - 1 if fits else capacity
            times = min(left, space // fill)
            if fits:
                first, many = classes[space].pop()
                if many > left // times:
                    classes[space].append([first + left // times, many - left // times])
                    many = left // times
                if not classes[space]:
                    free ^= 1 << space
            else:
                first, many = bins, left // times
                bins += many
            out.append((fill, rank, rank + many * times, first, times))
            space -= times * fill
            free |= 1 << space
            classes.setdefault(space, []).append([first, many])
            rank, left = rank + many * times, left - many * times
    return out


def _by_counts(bins: DataFrame, capacity: int) -> DataFrame:
    """All bins packed by the plan over their counts; the driver holds at most
    ``capacity`` counts, and the plan, which is broadcast, a few times as many rows."""
    spark = bins.sparkSession
    rows = bins.withColumn("part", F.pmod(F.xxhash64("seq"), F.lit(RANK_PARTS)))
    sizes = rows.groupBy("fill", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("fill").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("fill", "part", F.coalesce(before, F.lit(0)).alias("before"))
    counts = {r["fill"]: r["n"] for r in bins.groupBy("fill").agg(F.count("*").alias("n")).collect()}
    plan = spark.createDataFrame(planned(counts, capacity), "fill int, first bigint, last bigint, bin bigint, times int")
    within = F.row_number().over(Window.partitionBy("fill", "part").orderBy("seq")) - 1
    ranked = rows.withColumn("at", within).join(F.broadcast(starts), ["fill", "part"])  # capacity x RANK_PARTS rows at most
    ranked = ranked.withColumn("rank", F.col("before") + F.col("at"))
    placed = ranked.join(F.broadcast(plan), "fill").where((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last")))
    placed = placed.select(
        (F.lit(PLANNED << 57) + F.col("bin") + F.floor((F.col("rank") - F.col("first")) / F.col("times"))).alias("new"), "seq", "fill", "items"
    )
    made = placed.groupBy("new").agg(
        F.sum("fill").cast("int").alias("fill"), F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("seq", "items"))), lambda x: x["items"])).alias("items")
    )
    return made.select(F.col("new").alias("seq"), "fill", F.lit(True).alias("final"), "items")


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    slack: int = SLACK,
    end_id: int = END_ID,
    path: str | None = None,
    node_bins: int = NODE_BINS,
) -> DataFrame:
    """Place every piece of every document in sequences of ``capacity`` ids.

    Returns per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id,
    offset``.  A document's ids end with ``end_id``, so null and empty texts
    are one id long.  Repeated rows are packed each; an empty table gives an
    empty result.  ``path`` names the rank file of the vocabulary.
    """
    bins = staged(_first_level(docs, id_col, text_col, capacity, slack, end_id, path), "bins")
    done, left = bins.where("final"), bins.where("not final")
    many, merged, level = left.count(), 1.0, 0
    while many:
        nodes, level = -(-many // node_bins), level + 1
        if nodes > 1 and merged < LEAST_MERGED:
            done = done.union(_by_counts(left, capacity))
            break
        bins = staged(_next_level(left, level, nodes, capacity, slack), "bins")
        done = done.union(bins.where("final"))
        left = bins.where("not final")
        before, many = many, left.count()
        merged = 1 - many / before
    placed = done.select("seq", F.inline(_with_offsets()))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("seq").alias("sequence_id"), "offset")


def _with_offsets():
    """The items of a bin, each with the lengths before it."""
    return F.transform(
        "items",
        lambda x, k: F.struct(
            *(x[n].alias(n) for n in _NAMES),
            F.aggregate(F.slice("items", F.lit(1), k), F.lit(0).cast("long"), lambda acc, y: acc + y["length"]).alias("offset"),
        ),
    )
