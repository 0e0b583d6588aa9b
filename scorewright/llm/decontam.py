"""Benchmark decontamination by Wu-Manber search over words.

The test strings are windows of ``width`` consecutive words of the benchmark
items (an item of fewer words is one window).  Windows of one length form a
search table: a shift table over blocks of two words says how far the search
may jump when a block cannot end a window; where the shift is zero, a window
may end, and the hash of its last words (``SUFFIX`` of them) leads to the bucket
of benchmark windows that end so, which are compared with the text word by word.
"""

from __future__ import annotations

import uuid
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewright.llm.rows import named, with_arrow_columns
from scorewright.sources.staging import staged

WIDTH = 10
#: Words at a window's end whose hash is its bucket.
SUFFIX = 5
#: Words of the benchmark that one task searches for at a time: about 300 MB of tables.
BLOCK_WORDS = 1_000_000

_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Words of a text, A-Z in lower case: runs of ASCII letters and digits
    and of characters beyond ASCII.  Null has none."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


class WindowTable:
    """Windows of one length, ready for searching.

    The words of all items stand in one list, equal ones as one object, and a
    window is the place of its first word there, so a word costs a reference,
    one entry of the shift table and one of the suffix table at most.
    """

    def __init__(self, length: int) -> None:
        self.length = length
        self.block, self.tail = min(2, length), min(SUFFIX, length)
        self.words: list[bytes] = []
        self.first: list[int] = []  # places where items begin
        self.items: list[str] = []
        self.shift: dict[int, int] = {}
        self.suffix: dict[int, int | list[int]] = {}

    def add(self, item: str, words: list[bytes]) -> None:
        """All windows of an item of at least ``length`` words."""
        m, b, at = self.length, self.block, len(self.words)
        self.first.append(at)
        self.items.append(item)
        self.words += words
        shift, suffix = self.shift, self.suffix
        for end in range(b, len(words) + 1):
            # the block ends a window if m words lead up to it, else it is m - end short of one
            key, far = hash(tuple(words[end - b : end])), max(0, m - end)
            if far < shift.get(key, m):
                shift[key] = far
        for start in range(len(words) - m + 1):
            key = hash(tuple(words[start + m - self.tail : start + m]))
            had = suffix.get(key)
            if had is None:
                suffix[key] = at + start
            elif isinstance(had, list):
                had.append(at + start)
            else:
                suffix[key] = [had, at + start]

    def search(self, words: list[bytes]) -> Iterator[tuple[int, set[str]]]:
        """Start and items of each occurrence."""
        m, b, t, n = self.length, self.block, self.tail, len(words)
        jump, shift, suffix, known = m - b + 1, self.shift.get, self.suffix.get, self.words
        end = m
        while end <= n:
            far = shift(hash(tuple(words[end - b : end])), jump)
            if far:
                end += far
                continue
            places = suffix(hash(tuple(words[end - t : end])))
            if places is not None:
                window = words[end - m : end]
                places = places if isinstance(places, list) else [places]
                found = {self.items[bisect_right(self.first, p) - 1] for p in places if known[p : p + m] == window}
                if found:
                    yield end - m, found
            end += 1


def window_tables(items: list[tuple[str, list[bytes]]], width: int) -> list[WindowTable]:
    """One search table for each window length that occurs."""
    tables: dict[int, WindowTable] = {}
    same: dict[bytes, bytes] = {}
    for item, words in items:
        length = min(width, len(words))
        if length:
            tables.setdefault(length, WindowTable(length)).add(item, [same.setdefault(w, w) for w in words])
    return list(tables.values())


#: Search tables of this worker's last block; a worker runs many tasks of one block.
_KEPT: dict[tuple, list[WindowTable]] = {}


def _tables_of(shared, width: int) -> list[WindowTable]:
    key = (shared.value["name"], width)
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = window_tables([(item, text.split()) for item, text in shared.value["items"]], width)
    return _KEPT[key]


def _blocks(benchmark: DataFrame, most: int) -> Iterator[list[tuple[str, bytes]]]:
    """Items, their words joined by spaces, in blocks of about ``most`` words
    (an item is not cut); the driver holds one block."""
    block, held = [], 0
    for row in benchmark.toLocalIterator():
        words = words_of(row["text"])
        if block and held + len(words) > most:
            yield block
            block, held = [], 0
        block.append((row["item"], b" ".join(words)))
        held += len(words)
    yield block


_HITS = "array<struct<start:bigint,end:bigint>>"


def find_windows(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = WIDTH,
    block_words: int = BLOCK_WORDS,
    keep: list[str] | None = None,
) -> tuple[DataFrame, list[Column]]:
    """Every row of ``docs`` with what occurs in it.

    Columns made: ``n_words`` (long), ``hits`` (array of struct<start, end> of
    word positions covered, merged, end exclusive), ``items`` (array of item
    ids as strings, distinct, sorted as strings).  The second result selects
    the columns of ``docs`` (those in ``keep``, if given) back, whatever their
    names.  Null texts have no
    words.  A null item id counts as the item ``null``; repeated ids share
    their windows.  The benchmark is the query set: it goes to the tasks in
    blocks of at most ``block_words`` words, one pass over the documents for
    each, staged in between, so memory is bounded whatever its size.
    """
    asked = benchmark.select(
        F.coalesce(named(item_col).cast("string"), F.lit("null")).alias("item"), named(item_text_col).cast("string").alias("text")
    )
    context = docs.sparkSession.sparkContext
    shown = [c for c in docs.columns if keep is None or c in keep]
    hits, items, text = F.lit(None).cast(_HITS), F.lit(None).cast("array<string>"), F.col("_text")
    rows = docs.select(*(named(c).alias(f"c{k}") for k, c in enumerate(shown)), named(text_col).cast("string").alias("_text"))
    blocks = _blocks(asked, block_words)
    block = next(blocks)
    while True:
        after = next(blocks, None)
        shared = context.broadcast({"name": uuid.uuid4().hex, "items": block})

        def start(shared=shared):
            tables = _tables_of(shared, width)

            def make(texts: list, had: list, known: list) -> list[pa.Array]:
                found = [_search(tables, *x) for x in zip(texts, had, known, strict=True)]
                spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                kinds = (pa.int64(), spans, pa.list_(pa.string()))
                return [pa.array([x[k] for x in found], kind) for k, kind in enumerate(kinds)]

            return make

        held = [c for c in rows.columns if c[0] == "c" or after and c == "_text"]
        fields = f"n_words long, hits {_HITS}, items array<string>"
        rows, back = with_arrow_columns(rows, [text, hits, items], start, fields, held)
        rows = rows.select(*back, "n_words", "hits", "items")
        if after is None:
            return rows, [F.col(f"c{k}").alias(c) for k, c in enumerate(shown)]
        rows, block = staged(rows, "decontam"), after
        hits, items = F.col("hits"), F.col("items")


def _search(tables: list[WindowTable], text: str | None, had: list | None, known: list | None) -> tuple:
    words = words_of(text)
    spans = [(x["start"], x["end"]) for x in had or ()]
    names = set(known or ())
    for table in tables:
        for at, found in table.search(words):
            spans.append((at, at + table.length))
            names |= found
    return len(words), merged(spans), sorted(names)


def merged(spans: list[tuple[int, int]]) -> list[dict]:
    """Overlapping or touching spans as one, in order."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [{"start": a, "end": b} for a, b in out]


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per row: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``.

    A word inside any occurrence of a window is hit.  ``items_sha256`` is over
    the comma-joined item ids in string order (of the empty string if none).
    Repeated rows all come back.  An empty benchmark leaves every document
    clean; an empty document table gives an empty result.
    """
    found, (doc_id,) = find_windows(docs, benchmark, text_col, keep=[id_col], **options)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    return found.select(
        doc_id.alias("doc_id"),
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without a hit, with their own columns.

    Null and empty texts stay; repeated rows stay or go alike; an empty
    benchmark leaves every row, an empty table gives an empty result.
    """
    found, back = find_windows(docs, benchmark, text_col, **options)
    return found.where(F.size("hits") == 0).select(*back)
