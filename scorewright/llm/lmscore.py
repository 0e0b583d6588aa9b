"""Stupid-backoff scores of documents against the whole corpus.

The work is a join of exploded n-grams with count tables that are partitioned
by hash, done on packed arrays:

1. each task numbers the words of its documents in batches of about
   ``BATCH_WORDS`` words, shuffled once as compact columns (the same exchange
   feeds steps 2 and 4);
2. each batch explodes into the distinct n-grams of each order with their
   counts in the batch (pre-aggregated, so the most frequent n-gram is one
   entry per batch), sent by hash range as sorted, difference-coded hashes;
3. each hash range sums the counts of its n-grams over all batches (this is
   its part of the count table, which ``count_table`` gives as rows), joins
   them to the batches' n-grams and answers each batch with the entries whose
   total is not the batch's own;
4. each batch joins the answers to its n-grams and sums the scores of each
   document.

Steps 2 to 4 are two exchanges.  As rows of one n-gram each, the same join
would shuffle several times the bytes of the texts (by estimate: 16 bytes for
each word and order).  The number of ranges follows the bytes of the corpus,
so a task holds about ``RANGE_BYTES`` of text in n-grams of one order.  A
request costs about 65 bytes beside its n-grams, so it must not become small:
every batch asks every range, and beyond a corpus of about 50 billion words
batches and ranges grow with its square root, which keeps ``LEAST_REQUEST``
n-grams in a request and the requests in proportion to the corpus (30 million
words for a batch or a range at 20 trillion).  The number of words of the
corpus is one number, read by the driver with its bytes.

N-grams stand for their 56-bit hashes.  Two of a corpus of n distinct ones
share a hash with probability n / 2^56 for each: 1e-7 at ten billion, so about
one count in ten million may be too high there.

A document is scored against the other documents: its own counts are taken
off, so copies and common phrases score high and a lone text does not vouch
for itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewright.llm.rows import named

ORDER = 3
ALPHA = 0.4
#: Count of a word that no other document has.
UNSEEN = 0.5
BATCH_WORDS = 1_500_000
#: Bytes of text whose n-grams of one order a hash range holds, about.
RANGE_BYTES = 32 << 20
#: N-grams that a request has at least, about.
LEAST_REQUEST = 50
#: Bytes of text whose batches one task reads, about.
TASK_BYTES = 16 << 20
#: Bits of an n-gram's hash, and bytes of a difference between sorted ones.
HASH_BITS, STEP_BYTES = 56, 5
_U = np.uint64


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case; null has none."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def pack(values: np.ndarray, width: int) -> bytes:
    """Unsigned integers of ``width`` bytes, each byte plane compressed alone
    (the high ones are far from random)."""
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    press = zstandard.ZstdCompressor(level=1)
    parts = [press.compress(np.ascontiguousarray(p).tobytes()) for p in planes]
    return np.array([len(p) for p in parts], "<u4").tobytes() + b"".join(parts)


def unpack(data: bytes, width: int) -> np.ndarray:
    ends = np.cumsum(np.frombuffer(data, "<u4", width)) + 4 * width
    open_ = zstandard.ZstdDecompressor()
    planes = [np.frombuffer(open_.decompress(data[a:b]), np.uint8) for a, b in zip([4 * width, *ends[:-1]], ends, strict=True)]
    out = np.zeros((len(planes[0]), 8), np.uint8)
    for k, p in enumerate(planes):
        out[:, k] = p
    return out.view("<u8").ravel()


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a * _U(0x9E3779B97F4A7C15)) ^ (b + _U(0x7F4A7C159E3779B9) + (a << _U(6)) + (a >> _U(2)))
    x = (x ^ (x >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(29))


def grams(words: np.ndarray, lengths: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order from 1: hash of the n-gram that ends at each position,
    and whether it lies within one document.  ``words`` has hashes of
    ``HASH_BITS`` bits."""
    starts = np.repeat(np.cumsum(lengths) - lengths, lengths)
    place, now = np.arange(len(words)) - starts, words
    yield words, place >= 0
    for n in range(2, order + 1):
        longer = np.zeros_like(words)
        longer[1:] = _mix(now[:-1], words[1:])
        now = longer
        yield now >> _U(64 - HASH_BITS), place >= n - 1


_BATCH = "batch string, n_words bigint, doc_ids array<bigint>, lengths array<bigint>, ids binary, vocabulary binary"


def numbered(docs: DataFrame, id_col: str, text_col: str, batch_words: int) -> DataFrame:
    """Documents in batches, words as numbers of the batch's vocabulary."""

    def rows(doc_ids: list, lengths: list, ids: list, vocabulary: dict, name: str) -> pa.RecordBatch:
        hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in vocabulary), _U, len(vocabulary)) >> _U(64 - HASH_BITS)
        number = np.array(ids, np.int64)  # frequent words get small numbers, which compress
        order = np.argsort(-np.bincount(number, minlength=len(hashes)), kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        packed = pack(rank[number], 4), pack(hashes[order], HASH_BITS // 8)
        values = [[name], [len(ids)], [doc_ids], [lengths], [packed[0]], [packed[1]]]
        kinds = [pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
        names = [x.split()[0] for x in _BATCH.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        doc_ids, lengths, ids, vocabulary = [], [], [], {}
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                doc_ids.append(doc_id)
                lengths.append(len(words))
                ids += [vocabulary.setdefault(w, len(vocabulary)) for w in words]
                if len(ids) >= batch_words:
                    yield rows(doc_ids, lengths, ids, vocabulary, f"{part}.{made}")
                    made += 1
                    doc_ids, lengths, ids, vocabulary = [], [], [], {}
        if doc_ids:
            yield rows(doc_ids, lengths, ids, vocabulary, f"{part}.{made}")

    found = docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).cast("string").alias("text"))
    return found.mapInArrow(run, _BATCH)


def _corpus(docs: DataFrame, text_col: str) -> tuple[int, int]:
    """Bytes and words of all texts."""
    text = named(text_col).cast("string")
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    row = docs.agg(F.sum(F.octet_length(text).cast("long")).alias("b"), F.sum(words.cast("long")).alias("w")).first()
    return row["b"] or 0, row["w"] or 0


def _layout(size: int, words: int, batch_words: int | None, ranges: int | None) -> tuple[int, int]:
    """Words of a batch and number of ranges for a corpus."""
    least = math.isqrt(LEAST_REQUEST * words)
    per_range = max(RANGE_BYTES, least * size // max(words, 1))
    return batch_words or max(BATCH_WORDS, least), ranges or max(1, -(-size // per_range))


def _exploded(ids: bytes, vocabulary: bytes, lengths: list[int], order: int) -> Iterator[tuple]:
    """For each order in turn: distinct hashes, their counts in the batch, the number
    of the distinct hash at each position, and which positions have one."""
    words = unpack(vocabulary, HASH_BITS // 8)[unpack(ids, 4).astype(np.int64)]
    for hashes, whole in grams(words, np.asarray(lengths, np.int64), order):
        distinct, back, counts = np.unique(hashes[whole], return_inverse=True, return_counts=True)
        at = np.full(len(hashes), -1, np.int32)
        at[whole] = back
        yield distinct, counts, at


def _edges(parts: int) -> np.ndarray:
    """First hash of each range, and of the one after the last."""
    return np.array([(k << HASH_BITS) // parts for k in range(parts + 1)], _U)


_ASKED = "batch string, n int, part int, first bigint, width int, steps binary, more binary"


def _requests(batches: DataFrame, order: int, parts: int) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        edges = _edges(parts)
        names = [x.split()[0] for x in _ASKED.split(", ")]
        for frame in frames:
            for row in frame.itertuples():
                for n, (distinct, counts, _) in enumerate(_exploded(row.ids, row.vocabulary, row.lengths, order), 1):
                    cut = np.searchsorted(distinct, edges)
                    rows = []
                    for part in np.flatnonzero(np.diff(cut)).tolist():
                        some, count = distinct[cut[part] : cut[part + 1]], counts[cut[part] : cut[part + 1]]
                        steps = np.diff(some)
                        width = STEP_BYTES if not len(steps) or int(steps.max()) >> (8 * STEP_BYTES) == 0 else 8
                        often = np.flatnonzero(count > 1)
                        more = pack(np.concatenate([np.diff(often, prepend=0), count[often]]), 5)
                        rows.append((row.batch, n, part, int(some[0]), width, pack(steps, width), more))
                    yield pd.DataFrame(rows, columns=names)

    return batches.mapInPandas(run, _ASKED)  # all columns, so that the exchange below is the join's too


def _asked(row) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of a request."""
    hashes = np.concatenate([np.array([row.first], _U), unpack(row.steps, row.width)])
    hashes = np.cumsum(hashes, dtype=_U)
    counts = np.ones(len(hashes), np.int64)
    at, often = np.split(unpack(row.more, 5).astype(np.int64), 2)
    counts[np.cumsum(at)] = often
    return hashes, counts


_ANSWER = "batch string, n int, part int, places binary, totals binary"


def _summed(pdf: pd.DataFrame) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """A range's part of the count table (distinct hashes, totals), the
    requests it comes from, and the place of each of their hashes in it."""
    parts = [_asked(row) for row in pdf.itertuples()]
    distinct, back = np.unique(np.concatenate([h for h, _ in parts]), return_inverse=True)
    totals = np.zeros(len(distinct), np.int64)
    np.add.at(totals, back, np.concatenate([c for _, c in parts]))
    return parts, distinct, totals, back


def _by_range(asked: DataFrame, parts: int, order: int) -> DataFrame:
    """Requests where their order and range are summed."""
    least = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return asked.repartition(max(least, parts * order), "n", "part")


def _answers(asked: DataFrame) -> DataFrame:
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        parts, _, totals, back = _summed(pdf)
        rows, done = [], 0
        for row, (hashes, counts) in zip(pdf.itertuples(), parts, strict=True):
            total = totals[back[done : done + len(hashes)]]
            done += len(hashes)
            other = np.flatnonzero(total != counts)
            if len(other):
                rows.append((row.batch, row.n, row.part, pack(np.diff(other, prepend=0), 4), pack(total[other], 8)))
        return pd.DataFrame(rows, columns=[x.split()[0] for x in _ANSWER.split(", ")])

    return asked.groupBy("n", "part").applyInPandas(run, _ANSWER)


def count_table(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, batch_words: int | None = None, ranges: int | None = None
) -> DataFrame:
    """``n, hash, count`` of every n-gram up to ``order``, partitioned by hash.

    The counts are those that ``score_documents`` joins.  Null and empty texts
    have none; repeated rows count each; an empty table gives an empty result.
    """
    batch_words, parts = _layout(*_corpus(docs, text_col), batch_words, ranges)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        _, distinct, totals, _ = _summed(pdf)
        return pd.DataFrame({"n": key[0], "hash": distinct.astype(np.int64), "count": totals})

    asked = _by_range(_requests(numbered(docs, id_col, text_col, batch_words), order, parts), parts, order)
    return asked.groupBy("n", "part").applyInPandas(run, "n int, hash bigint, count bigint")


def _own_counts(at: np.ndarray, counts: np.ndarray, document: np.ndarray) -> np.ndarray:
    """How often the n-gram at each position occurs in its document; those
    that are once in the batch need no counting."""
    whole = at >= 0
    own = whole.astype(np.int64)
    often = np.flatnonzero(whole & (np.append(counts, 0)[at] > 1))
    pair = document[often] * (int(at.max(initial=0)) + 1) + at[often]
    _, back, times = np.unique(pair, return_inverse=True, return_counts=True)
    own[often] = times[back]
    return own


def backoff(counts: Iterator[np.ndarray], total: np.ndarray, place: np.ndarray, order: int, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Log score and order used at each position.

    ``counts`` gives, for each order from 1, the counts of the n-grams that
    end at the positions in the other documents, ``total`` their number of
    words, ``place`` the position in its document.  The longest n-gram that
    occurs is taken over its context; each order given up costs log alpha; a
    word that does not occur counts as ``UNSEEN`` with order 0.
    """
    longest = np.minimum(place + 1, order).astype(np.int8)
    now = next(counts)
    score = np.log(np.maximum(now, UNSEEN) / np.maximum(total, 1.0)) + (longest - 1) * math.log(alpha)
    used = (now > 0).astype(np.int8)
    for n, longer in enumerate(counts, 2):
        here = np.flatnonzero((longer > 0) & (place >= n - 1))
        score[here] = np.log(longer[here] / now[here - 1]) + (longest[here] - n) * math.log(alpha)
        used[here] = n
        now = longer
    return score, used


def score_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    order: int = ORDER,
    alpha: float = ALPHA,
    batch_words: int | None = None,
    ranges: int | None = None,
) -> DataFrame:
    """Per row: ``doc_id, n_words, n_seen, n_full, log_score``.

    ``log_score`` sums the natural logs of stupid-backoff scores with counts
    of all other rows; ``n_seen`` counts the words scored by an n-gram of the
    full ``order``, ``n_full`` those scored by the longest n-gram that their
    place in the document allows (all words of a text that occurs twice).
    Null and empty texts have no words and score 0.  Repeated rows count as
    other documents of each other.  An empty table gives an empty result.  A
    batch is as large as its largest document at least.

    ``docs`` must read the same rows in the same order when a task is run
    again, as files do; stage anything else first.  ``ranges`` is the number
    of hash ranges, by default one for each ``RANGE_BYTES`` of text (see above).
    """
    size, corpus = _corpus(docs, text_col)
    batch_words, parts = _layout(size, corpus, batch_words, ranges)
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
    batches = numbered(docs, id_col, text_col, batch_words).repartition(tasks, "batch")
    answers = _answers(_by_range(_requests(batches, order, parts), parts, order)).repartition(tasks, "batch")

    def others(row, answered: pd.DataFrame, document: np.ndarray) -> Iterator[np.ndarray]:
        """Counts in the other documents at each position, order by order."""
        edges = _edges(parts)
        for n, (distinct, counts, at) in enumerate(_exploded(row.ids, row.vocabulary, row.lengths, order), 1):
            totals, cut = np.append(counts.astype(np.int64), 0), np.searchsorted(distinct, edges)
            for answer in answered[answered["n"] == n].itertuples():
                totals[cut[answer.part] + np.cumsum(unpack(answer.places, 4).astype(np.int64))] = unpack(answer.totals, 8)
            yield totals[at] - _own_counts(at, counts, document)

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in left.itertuples():
            lengths = np.asarray(row.lengths, np.int64)
            document = np.repeat(np.arange(len(lengths)), lengths)
            place = np.arange(len(document)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            score, used = backoff(others(row, right, document), (corpus - lengths)[document], place, order, alpha)
            longest = np.minimum(place + 1, order)
            frame = {
                "doc_id": pd.array([None if x is None or x != x else int(x) for x in row.doc_ids], "Int64"),
                "n_words": lengths,
                "n_seen": np.bincount(document[used == order], minlength=len(lengths)),
                "n_full": np.bincount(document[used == longest], minlength=len(lengths)),
                "log_score": np.bincount(document, weights=score, minlength=len(lengths)),
            }
            out.append(pd.DataFrame(frame))
        return pd.concat(out) if out else pd.DataFrame(columns=["doc_id", "n_words", "n_seen", "n_full", "log_score"])

    both = batches.groupBy("batch").cogroup(answers.groupBy("batch"))
    return both.applyInPandas(run, "doc_id bigint, n_words bigint, n_seen bigint, n_full bigint, log_score double")
