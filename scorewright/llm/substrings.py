"""Removal of passages that an earlier document has, by level-wise doubling.

A window is ``width`` consecutive words of a document.  Windows of one length
that stand in more than one document are alone extended to twice that length
(less one where the width is odd), until the width is reached or none are
left; longer windows need no look, as the windows of the width cover them.
For a width of 13 the lengths are 7 and 13.

* The first length is looked at by samples that lose nothing: of the short
  windows inside a window of the next length only that with the smallest hash
  is asked about, a quarter of all.  Where it stands in one document only, no
  longer window around it repeats.
* A look is one exchange of rows (hash, document).  A task first compares what
  it holds: of documents that share a hash there, only the smallest asks
  further, so no hash has more rows than there are batches, however often a
  passage occurs.
* Documents whose whole text an earlier one has lose every word without any
  look (they are found by MD5).

All looks and the result read the same exchange of the texts by document id,
so texts are shuffled once.  The first hashes have 64 bits and only choose;
windows of the width are compared by 96 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorewright.llm.rows import named

WIDTH = 13
#: The first length is at most this.
SHORT = 7
#: Bytes of text that are hashed at once (a longer text is taken whole), and rows compared in a task.
SLICE, BATCH = 4 << 20, 1 << 19
#: Rows of a record batch that leaves a task.
SENT = 1 << 16
#: Keys that the rows of one text are dealt to.
SALTS = 32
_LAST_ID = (1 << 63) - 1

_U = np.uint64
_TIMES = (_U(0xFF51AFD7ED558CCD), _U(0xC4CEB9FE1A85EC53))
_BASES = (_U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=_U)
#: Words of more bytes are hashed one by one.
_LONG_WORD = 256


def _mixed(h: np.ndarray) -> np.ndarray:
    """A mixing of 64 bits that maps different values to different ones."""
    h = (h ^ (h >> _U(32))) * _TIMES[0]
    h = (h ^ (h >> _U(29))) * _TIMES[1]
    return h ^ (h >> _U(32))


class Words:
    """Hashes of the words of some texts, and the text of each word."""

    def __init__(self, texts: pa.Array) -> None:
        texts = texts.cast(pa.large_string())
        at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        low, high = int(at[0]), int(at[-1])
        held = np.zeros(high - low + 8, np.uint8)
        if high > low:
            held[:-8] = np.frombuffer(data, np.uint8)[low:high]
        at = at - low
        word = ~_SPACE[held[:-8]]
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        edges = at[:-1][at[1:] > at[:-1]]  # a text's first byte begins a word even after a word
        first[edges] |= word[edges]
        last[edges[1:] - 1] |= word[edges[1:] - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.text = np.searchsorted(at, starts, side="right") - 1
        self.hash = _hashed(held, starts, ends)
        self.bounds = np.searchsorted(self.text, np.arange(len(texts) + 1))

    def windows(self, length: int, base: int = 0) -> np.ndarray:
        """Hash of the words from each place on; all ones where they leave the text."""
        n = len(self.hash) - length + 1
        if n <= 0:
            return np.zeros(0, _U)
        h = self.hash[:n].copy()
        for k in range(1, length):
            h = h * _BASES[base] + self.hash[k : k + n]
        h = _mixed(h)
        h[self.text[:n] != self.text[length - 1 :]] = ~_U(0)
        return h

    def smallest(self, short: int, length: int) -> np.ndarray:
        """The smallest hash of the short windows in each window of ``length``."""
        h, n = self.windows(short), len(self.hash) - length + 1
        low = h[: max(n, 0)].copy()
        for k in range(1, length - short + 1 if n > 0 else 0):
            np.minimum(low, h[k : k + n], out=low)
        return low

    def whole(self, length: int) -> np.ndarray:
        """Places from where ``length`` words are of one text."""
        n = max(len(self.hash) - length + 1, 0)
        return self.text[:n] == self.text[len(self.text) - n :]

    def among(self, values: np.ndarray, lists: list[np.ndarray]) -> np.ndarray:
        """Whether each value, by place, is in the list of the text there."""
        found = np.zeros(len(values), bool)
        for k, known in enumerate(lists):
            a, b = self.bounds[k], min(self.bounds[k + 1], len(values))
            if len(known) and b > a:
                found[a:b] = np.isin(values[a:b], known)
        return found


def _hashed(held: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits for each word, eight bytes at a time."""
    eights = np.lib.stride_tricks.as_strided(held, (len(held) - 7, 8), (1, 1))
    sizes = ends - starts
    out = sizes.astype(_U) * _BASES[0]
    left, at = np.flatnonzero(sizes <= _LONG_WORD), 0
    while len(left):
        part = eights[starts[left] + at].view("<u8")[:, 0] & _KEEP[np.minimum(sizes[left] - at, 8)]
        out[left] = _mixed(out[left] ^ part)
        at += 8
        left = left[sizes[left] > at]
    for k in np.flatnonzero(sizes > _LONG_WORD):
        out[k] = xxhash.xxh64_intdigest(held[starts[k] : ends[k]].tobytes())
    return out


def lengths_of(width: int, short: int = SHORT) -> list[int]:
    """Lengths from the first look to the width, each at most twice the one before."""
    found = [width]
    while found[0] > short:
        found.insert(0, -(-found[0] // 2))
    return found


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of about ``SLICE`` bytes of text (the third column)."""
    sizes = _sizes(batch.column(2))
    upto, at = np.cumsum(sizes), 0
    while at < len(batch):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + SLICE, side="right")))
        yield batch.slice(at, end - at)
        at = end


def _sizes(texts: pa.Array) -> np.ndarray:
    texts = texts.cast(pa.large_string())
    return np.diff(np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1])


def _lists(column: pa.Array) -> list[np.ndarray]:
    """Hashes of each row; a null list is empty."""
    flat, at = column.flatten().to_numpy(), 0
    out = []
    for n in column.value_lengths().fill_null(0).to_pylist():
        out.append(flat[at : at + n].view(_U))
        at += n
    return out


def _asked(words: Words, known: list[np.ndarray] | None, lengths: list[int], level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, check and text of what this level asks about."""
    length, last = lengths[level], level == len(lengths) - 1
    if last or level:
        h, fit = words.windows(length), words.whole(length)
        if level == 1:
            fit &= words.among(words.smallest(lengths[0], length), known)
        elif level:
            half = words.windows(lengths[level - 1])
            held, n = words.among(half, known), len(fit)
            fit &= held[:n] & held[len(held) - n :] if n else fit
        check = words.windows(length, 1)[fit] >> _U(32) if last else np.zeros(int(fit.sum()), _U)
        return h[fit], check, words.text[: len(fit)][fit]
    fit = words.whole(lengths[1])
    h = words.smallest(length, lengths[1])[fit]
    return h, np.zeros(len(h), _U), words.text[: len(fit)][fit]


def _compared(parts: list[tuple], last: bool) -> Iterator[pa.RecordBatch]:
    """Rows that leave a task: of what several of its documents share, one
    question by the smallest, and what is known already."""
    h, check, ids = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((ids, check, h))
    h, check, ids = h[order], check[order], ids[order]
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (check[1:] == check[:-1])
    again = same.copy()
    again[1:] &= ids[1:] == ids[:-1]
    h, check, ids, same = h[~again], check[~again], ids[~again], same[~again]
    shared = same.copy() if last else same | np.append(same[1:], False)
    known = np.repeat([False, True], [int((~same).sum()), int(shared.sum())])
    h, ids = np.concatenate([h[~same], h[shared]]), np.concatenate([ids[~same], ids[shared]])
    check = np.concatenate([check[~same], _mixed(ids[len(ids) - int(shared.sum()) :].astype(_U)) >> _U(32)])
    for at in range(0, len(h), SENT):
        cut = slice(at, at + SENT)
        yield pa.RecordBatch.from_arrays([pa.array(h[cut].view(np.int64)), pa.array(check[cut].astype(np.uint32).view(np.int32)), pa.array(ids[cut]), pa.array(known[cut])], names=["key", "check", "id", "known"])


def _look(rows: DataFrame, lengths: list[int], level: int) -> DataFrame:
    """``id, found``: hashes of a document that this level found elsewhere,
    at the last level in a document with a smaller id."""
    last = level == len(lengths) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for part in _slices(batch):
                words = Words(part.column(2))
                known = _lists(part.column(3)) if level else None
                h, check, text = _asked(words, known, lengths, level)
                parts.append((h, check, part.column(0).to_numpy()[text]))
                held += len(h)
                if held >= BATCH:
                    yield from _compared(parts, last)
                    parts, held = [], 0
        if held:
            yield from _compared(parts, last)

    asked = rows.mapInArrow(run, "key long, check int, id long, known boolean")
    one = Window.partitionBy("key", "check", "known")  # a row for each batch of a task at most
    asked = asked.withColumn("low", F.min("id").over(one))
    asked = asked if last else asked.withColumn("high", F.max("id").over(one))
    found = asked.where(F.col("known") | (F.col("id") > F.col("low") if last else F.col("high") > F.col("low")))
    return found.groupBy("id").agg(F.collect_list("key").alias("found"))


def _kept(rows: DataFrame, width: int) -> DataFrame:
    """Rows ``id, doc_id, text, found`` without the words of what was found;
    a null list takes every word of a text of ``width`` words or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                whole = part.column(3).is_null().to_pylist()
                lists, words = _lists(part.column(3)), Words(part.column(2))
                covered = np.zeros(len(words.hash) + width, np.int32)
                hit = np.flatnonzero(words.among(words.windows(width), lists) & words.whole(width))
                covered[hit] += 1
                covered[hit + width] -= 1
                gone, made = np.cumsum(covered) > 0, []
                for k, text in enumerate(part.column(2).to_pylist()):
                    tokens, (a, b) = (text or "").encode().split(), words.bounds[k : k + 2]
                    out = gone[a:b] if not whole[k] else np.full(b - a, b - a >= width)
                    n = int(out.sum())
                    made.append((b - a, n, b" ".join(tokens if not n else [tokens[i] for i in np.flatnonzero(~out)]).decode()))
                columns = zip(*made, strict=True) if made else [[], [], []]
                kinds = (pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([part.column(1), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=["doc_id", "n_words", "n_removed", "kept"])

    return rows.select("id", "doc_id", "text", "found").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, short: int = SHORT) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` of every row of ``docs``.

    Words are runs of anything but ASCII white space.  Every word is removed
    that a window covers whose words also stand in a document with a smaller
    id; windows are judged on the input.  ``kept`` is what stays, joined by
    one space.  A null or empty text has no words.  A null id counts as the
    largest number.  Rows of one id, equal or not, do not remove each other's
    words.  A document that repeats its own words keeps them.  An empty table
    gives an empty result.
    """
    ident = named(id_col).cast("long")
    text = F.coalesce(named(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(ident, F.lit(_LAST_ID)).alias("id"), ident.alias("doc_id"), text.alias("text"), F.unhex(F.md5(text.cast("binary"))).alias("md5"))
    prints = rows.select("id", "md5")
    firsts = prints.groupBy("md5").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    firsts = firsts.select("md5", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    dealt = prints.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))  # a text of very many rows is several keys
    later = dealt.join(firsts, ["md5", "salt"]).where(F.col("id") > F.col("first")).select("id", "md5")
    copies = later.groupBy("id").agg(F.collect_set("md5").alias("copies"))
    marked = rows.join(copies, "id", "left").withColumn("copy", F.coalesce(F.array_contains("copies", F.col("md5")), F.lit(False)))
    kept = marked.where("not copy").select("id", "doc_id", "text")
    lengths, found = lengths_of(width, short), None
    for level in range(len(lengths)):
        found = _look(kept.join(found, "id") if level else kept, lengths, level)
    none = F.array().cast("array<long>")
    own = kept.join(found, "id", "left").withColumn("found", F.coalesce("found", none))
    copied = marked.where("copy").withColumn("found", F.lit(None).cast("array<long>"))
    return _kept(own, width).union(_kept(copied, width))
