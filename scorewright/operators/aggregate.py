"""Aggregations of per-sample scores: DataFrames to DataFrames.

Every aggregate is one or two hash aggregations with partial sums on the map
side; nothing is collected.  ``by`` may be empty for one overall row.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from scorewright.functions.extract import _c
from scorewright.functions.metrics import _sum
from scorewright.operators import grams
from scorewright.sources.staging import staged

# --- one-column aggregates (AGG1-AGG5) ----------------------------------------

#: Aggregates by name: value and weight to a Column.
AGGREGATES: dict[str, Callable[[Column, Column], Column]] = {
    "mean": lambda v, w: F.avg(v),
    "sum": lambda v, w: F.sum(v),
    "perplexity": lambda v, w: F.exp(-F.avg(v)),
    "weighted_mean": lambda v, w: F.sum(v) / F.sum(w),
    "weighted_perplexity": lambda v, w: F.exp(-F.sum(v) / F.sum(w)),
    "bits_per_byte": lambda v, w: -F.sum(v) / F.sum(w) / F.log(F.lit(2.0)),
    "stddev": lambda v, w: F.stddev_samp(v),
    "stderr": lambda v, w: F.stddev_samp(v) / F.sqrt(F.count(v)),
}


def score(df: DataFrame, by: list[str], value: str, agg: str, weight: str | None = None) -> DataFrame:
    """``by..., value`` under a registered aggregate; "median" is the upper
    median of the sorted values."""
    if agg == "median":
        return upper_median(df, by, value)
    return df.groupBy(*by).agg(AGGREGATES[agg](F.col(value), F.col(weight) if weight else F.lit(1.0)).alias(value))


def upper_median(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Element floor(n / 2) + 1 of the sorted values of a group; nulls do not
    count, and a group without values has no row."""
    return at_rank(df.where(F.col(value).isNotNull()), by, value, lambda n: F.floor(n / 2) + 1, value)


def weighted_median(df: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """The upper median of rows that stand ``weight`` (whole) times each;
    weights of equal values are summed before they are ranked."""
    counts = df.where(F.col(value).isNotNull() & (F.col(weight) > 0)).groupBy(*by, value).agg(F.sum(weight).alias("_n"))
    order = Window.partitionBy(*by).orderBy(value)
    upto, total = F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0)), F.sum("_n").over(Window.partitionBy(*by))
    ranked = counts.withColumns({"_upto": upto, "_at": F.floor(total / 2) + 1})
    return ranked.where("_upto >= _at and _upto - _n < _at").select(*by, value)


#: Cells of a group's values that a rank is looked for in, and rows of a cell that one task sorts.
CELLS, SORTED = 4096, 1_000_000


def at_rank(df: DataFrame, by: list[str], value: str, rank: Callable[[Column], Column], name: str) -> DataFrame:
    """``by..., name``: the value at a rank (from 1) of each group's sorted values.

    Null values do not count, and a group without values has no row.  Where a
    group has more than ``SORTED`` rows, the range of its values is cut into
    ``CELLS`` cells that are counted with partial sums, and the cell that holds
    the rank is cut again until it is small or has one value.  So no task sorts
    a large group; what is joined to the rows is a row for each group.
    """
    keys = [f"_by{k}" for k in range(len(by))]
    rows = df.select(*(F.col(b).alias(k) for b, k in zip(by, keys, strict=True)), F.col(value).cast("double").alias("_v"), F.col(value).alias("_own")).where("_v is not null")
    state = staged(rows.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("_n")), "ranks")
    state = state.where("_n > 0").withColumn("_rank", rank(F.col("_n")).cast("long"))
    on = functools.reduce(lambda x, k: x & F.col(k).eqNullSafe(F.col(f"{k}s")), keys, F.lit(True))

    def inside(cells: DataFrame) -> DataFrame:
        """The rows of the given cells, with the cell's ``_lo, _hi, _rank``."""
        found = rows.join(cells.drop("_n").withColumnsRenamed({k: f"{k}s" for k in keys}), on & F.col("_v").between(F.col("_lo"), F.col("_hi")))
        return found.drop(*(f"{k}s" for k in keys))

    large = f"_lo < _hi and _n > {SORTED}"
    while not state.where(large).isEmpty():
        width = F.col("_hi") / CELLS - F.col("_lo") / CELLS
        cell = F.when(width > 0, F.least(F.floor((F.col("_v") - F.col("_lo")) / width), F.lit(CELLS - 1))).otherwise((F.col("_v") > F.col("_lo")).cast("long"))
        cells = inside(state.where(large)).groupBy(*keys, "_rank", cell.alias("_cell")).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("_n"))
        upto = F.sum("_n").over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0))  # CELLS rows of a group
        found = cells.withColumn("_upto", upto).where("_upto >= _rank and _upto - _n < _rank").withColumn("_rank", F.expr("_rank - _upto + _n"))
        state = staged(state.where(f"not ({large})").unionByName(found.select(*state.columns)), "ranks")
    kind = df.schema[value].dataType
    one = state.where("_lo = _hi").select(*keys, F.col("_lo").cast(kind).alias("_own"))
    order = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_v")
    few = inside(state.where("_lo < _hi")).withColumn("_at", F.row_number().over(order)).where("_at = _rank").select(*keys, "_own")
    return one.union(few).select(*(F.col(k).alias(b) for b, k in zip(by, keys, strict=True)), F.col("_own").alias(name))


# --- labels (AGG6, AGG7, AGG15) -------------------------------------------------


def confusion_metrics(df: DataFrame, by: list[str], gold: str, pred: str, positive=1) -> DataFrame:
    """Binary accuracy, precision, recall, F1, share of positive golds
    (``gold_ratio``) and of positive predictions (``pred_ratio``)."""
    g, p = F.col(gold) == positive, F.col(pred) == positive
    tp, fp, fn, n = F.count_if(g & p), F.count_if(~g & p), F.count_if(g & ~p), F.count("*")
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return df.where(g.isNotNull() & p.isNotNull()).groupBy(*by).agg(
        n.alias("n"),
        safe(F.count_if(g == p), n).alias("accuracy"),
        safe(tp, tp + fp).alias("precision"),
        safe(tp, tp + fn).alias("recall"),
        safe(2 * tp, 2 * tp + fp + fn).alias("f1"),
        safe(F.count_if(g), n).alias("gold_ratio"),
        safe(F.count_if(p), n).alias("pred_ratio"),
    )


def matthews(df: DataFrame, by: list[str], gold: str, pred: str) -> DataFrame:
    """Matthews correlation for any number of classes, from confusion counts;
    0 where one side has one class only."""
    cells = df.groupBy(*by, gold, pred).agg(F.count("*").alias("_n"))
    side = lambda c: cells.groupBy(*by, c).agg(F.sum("_n").alias("_k")).groupBy(*by).agg(F.sum(F.col("_k") * F.col("_k")).alias(f"_{c}2"))
    marg = cells.groupBy(*by, gold).agg(F.sum("_n").alias("_g")).withColumnRenamed(gold, "_class")
    marp = cells.groupBy(*by, pred).agg(F.sum("_n").alias("_p")).withColumnRenamed(pred, "_class")
    cross = marg.join(marp, [*by, "_class"]).groupBy(*by).agg(F.sum(F.col("_g") * F.col("_p")).alias("_gp"))
    whole = cells.groupBy(*by).agg(F.sum("_n").alias("_s"), F.sum(F.when(F.col(gold) == F.col(pred), F.col("_n")).otherwise(0)).alias("_c"))
    join = (lambda a, b: a.join(b, by, "left")) if by else (lambda a, b: a.crossJoin(b))
    rows = join(join(join(whole, cross), side(gold)), side(pred))
    s, c, gp = F.col("_s"), F.col("_c"), F.coalesce("_gp", F.lit(0))
    below = F.sqrt((s * s - F.col(f"_{gold}2")).cast("double")) * F.sqrt((s * s - F.col(f"_{pred}2")).cast("double"))
    return rows.select(*by, F.when(below > 0, (c * s - gp) / below).otherwise(0.0).alias("mcc"))


def brier(df: DataFrame, by: list[str], probabilities: str, gold: str) -> DataFrame:
    """Mean over rows of the summed squared differences to the one-hot gold."""
    p = F.col(probabilities)
    hot = lambda k: (k == F.col(gold)).cast("double")
    part = _sum(F.transform(p, lambda x, k: F.pow(x - hot(k), 2)))
    return df.groupBy(*by).agg(F.avg(part).alias("brier"))


# --- texts (AGG9-AGG13) ---------------------------------------------------------


def gram_counts(tokens: Column, n: int, sep: str = " ") -> Column:
    """Array of a row's n-grams."""
    last = F.size(tokens) - n
    return F.when(last < 0, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(0)) + 1), lambda k: F.array_join(F.slice(tokens, k, n), sep))
    )


def _clipped(pred: Column, refs: Column, most: int) -> Column:
    """Array of the matches of the predicted n-grams of order 1 to ``most``,
    each at most as often as in the reference that has it most often (Arrow
    batches: bags of n-grams as expressions cost a string for each n-gram).

    ``pred`` is a token array or a text (of characters), ``refs`` an array of such.
    """

    @F.pandas_udf("array<bigint>")
    def run(p: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else _matches(x, [z for z in y if z is not None], most) for x, y in zip(p, r, strict=True)])

    return run(pred, refs)


def _matches(x, refs: list, most: int) -> list[int]:
    """Matches of each order.  Tokens are numbered, so that an n-gram is one
    integer of 64 bits; where the numbers are too many for that, it is the
    number of its first words and the last word, numbered again."""
    sizes = np.array([len(y) for y in (x, *refs)])
    if isinstance(x, str):
        flat = np.frombuffer("".join((x, *refs)).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    else:
        known: dict = {}
        flat = np.array([known.setdefault(t, len(known)) for y in (x, *refs) for t in y], np.uint64)
    width = int(flat.max()).bit_length() if len(flat) else 1
    if width * most > 64:
        flat = np.unique(flat, return_inverse=True)[1].astype(np.uint64)
        width = int(flat.max()).bit_length()
    ends = np.cumsum(sizes)
    starts, now, out = ends - sizes, flat, []
    for n in range(1, most + 1):
        if n > 1:
            if width * n > 64:
                now = np.unique(now, return_inverse=True)[1].astype(np.uint64)
            if int(now.max(initial=0)).bit_length() + width > 64:
                raise ValueError("too many different n-grams in one row")
            now = now[:-1] << np.uint64(width) | flat[n - 1 :]
        if sizes[0] < n:
            return out + [0] * (most + 1 - n)
        own, many = np.unique(now[: ends[0] - n + 1], return_counts=True)
        best = np.zeros(len(own), np.int64)
        for a, b in zip(starts[1:].tolist(), ends[1:].tolist(), strict=True):
            if b - a < n:
                continue
            theirs, have = np.unique(now[a : b - n + 1], return_counts=True)
            at = np.minimum(np.searchsorted(theirs, own), len(theirs) - 1)
            np.maximum(best, np.where(theirs[at] == own, have[at], 0), out=best)
        out.append(int(np.minimum(best, many).sum()))
    return out


def bleu_tokens(text: str | Column) -> Column:
    """Tokens for BLEU: punctuation and symbols stand alone, case is kept."""
    return F.filter(F.split(F.regexp_replace(_c(text), r"([\p{P}\p{S}])", " $1 "), r"\s+"), lambda t: t != "")


def bleu_counters(pred: str, refs: str, most: int = 4) -> dict[str, Column]:
    """Counters of one sample, to be summed over the corpus: clipped matches
    and n-grams of each order, length, and the nearest reference length."""
    p, r = F.col(pred), F.col(refs)
    near = F.array_min(F.transform(r, lambda x: F.struct(F.abs(F.size(x) - F.size(p)).alias("far"), F.size(x).alias("n"))))["n"]
    clipped = _clipped(p, r, most)
    total = lambda n: F.greatest(F.size(p) - n + 1, F.lit(0))
    orders = range(1, most + 1)
    return {"_len": F.size(p), "_ref": near} | {f"_m{n}": clipped[n - 1] for n in orders} | {f"_t{n}": total(n) for n in orders}


def bleu_score(n: int) -> Column:
    """BLEU of order n (0 to 100) from the sums of ``bleu_counters``."""
    brevity = F.when(F.col("_len") >= F.col("_ref"), 1.0).when(F.col("_len") == 0, 0.0).otherwise(F.exp(1 - F.col("_ref") / F.col("_len")))
    logs = sum((F.log(F.col(f"_m{k}") / F.col(f"_t{k}")) for k in range(2, n + 1)), F.log(F.col("_m1") / F.col("_t1")))
    whole = F.least(*(F.col(f"_m{k}") for k in range(1, n + 1)), F.lit(1)) > 0
    return F.when(whole, 100 * brevity * F.exp(logs / n)).otherwise(0.0)


def corpus_bleu(df: DataFrame, by: list[str], pred: str, refs: str, most: int = 4) -> DataFrame:
    """``bleu_1`` to ``bleu_<most>`` (0 to 100) of token arrays ``pred`` against
    arrays of token arrays ``refs``: clipped counts summed over the corpus,
    geometric mean, brevity penalty with the nearest reference length."""
    counters = bleu_counters(pred, refs, most)
    rows = df.select(*by, *(c.alias(n) for n, c in counters.items()))
    sums = rows.groupBy(*by).agg(*(F.sum(n).alias(n) for n in counters))
    return sums.select(*by, *(bleu_score(n).alias(f"bleu_{n}") for n in range(1, most + 1)))


def binary_counters(gold: str, pred: str) -> dict[str, Column]:
    """Cells of a two-class confusion table of boolean columns."""
    g, p = F.coalesce(F.col(gold), F.lit(False)), F.coalesce(F.col(pred), F.lit(False))
    cell = lambda x: x.cast("int")
    return {"_tp": cell(g & p), "_fp": cell(~g & p), "_fn": cell(g & ~p), "_tn": cell(~g & ~p)}


def f1_score() -> Column:
    """F1 from the sums of ``binary_counters``; 0 without a positive."""
    below = 2 * F.col("_tp") + F.col("_fp") + F.col("_fn")
    return F.when(below > 0, 2 * F.col("_tp") / below).otherwise(0.0)


def matthews_score() -> Column:
    """Matthews correlation from the sums of ``binary_counters``; 0 where a side has one class."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("_tp", "_fp", "_fn", "_tn"))
    below = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    return F.when(below > 0, (tp * tn - fp * fn) / below).otherwise(0.0)


def corpus_chrf(df: DataFrame, by: list[str], pred: str, ref: str, most: int = 6, beta: float = 2.0) -> DataFrame:
    """Character F-score (0 to 100) of texts without white space: precision
    and recall of each n-gram order from corpus sums, averaged over orders."""
    chars = lambda c: F.regexp_replace(F.col(c), r"\s+", "")
    rows = df.select(*by, chars(pred).alias("p"), chars(ref).alias("r")).withColumn("m", _clipped(F.col("p"), F.array("r"), most))
    rows = rows.select(
        *by,
        *(F.col("m")[n - 1].alias(f"_m{n}") for n in range(1, most + 1)),
        *(F.greatest(F.length("p") - n + 1, F.lit(0)).alias(f"_p{n}") for n in range(1, most + 1)),
        *(F.greatest(F.length("r") - n + 1, F.lit(0)).alias(f"_r{n}") for n in range(1, most + 1)),
    )
    sums = rows.groupBy(*by).agg(*(F.sum(c).alias(c) for c in rows.columns if c.startswith("_")))
    safe = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    used = sum((F.col(f"_p{n}") > 0).cast("int") * (F.col(f"_r{n}") > 0).cast("int") for n in range(1, most + 1))
    p = sum((safe(f"_m{n}", f"_p{n}") for n in range(2, most + 1)), safe("_m1", "_p1")) / used
    r = sum((safe(f"_m{n}", f"_r{n}") for n in range(2, most + 1)), safe("_m1", "_r1")) / used
    b = beta * beta
    return sums.select(*by, F.when((used > 0) & (b * p + r > 0), 100 * (1 + b) * p * r / (b * p + r)).otherwise(0.0).alias("chrf"))


def error_rate(df: DataFrame, by: list[str], distance: str, length: str) -> DataFrame:
    """Summed distances over summed reference lengths (word error rate, and
    the edit rate without block moves)."""
    total = F.sum(length)
    return df.groupBy(*by).agg(F.when(total > 0, F.sum(distance) / total).alias("error_rate"))


#: Tokens of the items that one task weighs at once, about.
CIDER_TOKENS = 1_500_000
#: Bytes of a text for a token, about.
TOKEN_BYTES = 6
#: So many low bits of whole-number ids differ within a run of rows that stay together.
RUN_BITS = 5


class _Lists(NamedTuple):
    """Token lists that lie one after the other in ``words``; items by their
    id and the list of their prediction, references by item and list."""

    words: pa.Array
    lengths: np.ndarray
    ids: pa.Array
    pred: np.ndarray
    item: np.ndarray
    ref: np.ndarray


def _item_lists(rows: pa.Table) -> _Lists:
    """Of items with tokens ``p`` and arrays of tokens ``r``."""
    pred, refs = rows.column("p").combine_chunks(), rows.column("r").combine_chunks()
    each, n = refs.flatten(), len(rows)
    size = lambda x: x.value_lengths().fill_null(0).to_numpy().astype(np.int64)
    words, lengths = pa.concat_arrays([pred.flatten(), each.flatten()]), np.concatenate([size(pred), size(each)])
    return _Lists(words, lengths, rows.column("_id").combine_chunks(), np.arange(n), np.repeat(np.arange(n), size(refs)), n + np.arange(len(each)))


def _packed_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each group ``_g`` in a batch as one compressed piece: texts take half the disk when they move."""
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=9))
    for batch in batches:
        g = batch.column("_g").to_numpy()
        order = np.argsort(g, kind="stable")
        table = pa.table({c: batch.column(c).take(pa.array(order)) for c in ("_id", "_text", "_run", "_own")})
        starts = np.flatnonzero(np.diff(g[order], prepend=-1))
        data = []
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(g)], strict=True) if len(g) else ():
            with pa.ipc.new_stream(sink := pa.BufferOutputStream(), table.schema, options=options) as out:
                out.write_table(table.slice(a, b - a).combine_chunks())
            data.append(sink.getvalue().to_pybytes())
        yield pa.record_batch([pa.array(g[order][starts]), pa.array(data, pa.binary())], ["_g", "data"])


def _next_lists(rows: pa.Table) -> _Lists:
    """Of packed texts in runs of ids, each (of those with ``_own``) an item
    against those with the next id, or against an empty list; a text is one list for both."""
    rows = pa.concat_tables([pa.ipc.open_stream(x).read_all() for x in rows.column("data").to_pylist()])
    ids, run = rows.column("_id").combine_chunks(), rows.column("_run").to_numpy()
    split = pc.ascii_split_whitespace(rows.column("_text").combine_chunks())
    words = split.flatten()
    filled = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    upto = np.concatenate([[0], np.cumsum(filled)])
    ends = np.cumsum(split.value_lengths().to_numpy().astype(np.int64))
    lengths = np.diff(upto[np.concatenate([[0], ends])])
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    place = ids.fill_null(0).to_numpy().astype(np.int64) + run  # with one step between runs
    listed = np.flatnonzero(known)
    listed = listed[np.argsort(place[listed], kind="stable")]
    own = np.flatnonzero(rows.column("_own").to_numpy())
    low, high = (np.searchsorted(place[listed], place[own] + 1, side) for side in ("left", "right"))
    many = np.where(known[own], high - low, 0)
    pairs = np.maximum(many, 1)
    pred, at = np.repeat(own, pairs), np.arange(pairs.sum()) - np.repeat(np.cumsum(pairs) - pairs, pairs) + np.repeat(low, pairs)
    ref = np.append(listed, len(rows))[np.where(np.repeat(many > 0, pairs), at, len(listed))]
    return _Lists(words.filter(pa.array(filled)), np.append(lengths, 0), ids.take(pa.array(pred)), pred, np.arange(len(pred)), ref)


class _Order(NamedTuple):
    """N-grams of one order: the different ones, those that are asked for, and
    which (``gram``) each list (``bag``, ascending) has how often."""

    different: np.ndarray
    asked: np.ndarray
    bag: np.ndarray
    gram: np.ndarray
    times: np.ndarray


def _counted(lists: _Lists, most: int, least: int = 1, pair_totals: np.ndarray | None = None, only: bool = False) -> Iterator[_Order]:
    """Orders ``least`` to ``most``.  With totals of the words and pairs of
    words (in order), longer n-grams are asked for if all their pairs are in
    two items or more: an n-gram is in no more items than its parts.  ``only``
    leaves out those that are not asked for."""
    bag = np.repeat(np.arange(len(lists.lengths)), lists.lengths)
    pairs, words = None, np.zeros(0, np.uint64)
    for n, (grams_at, own) in enumerate(grams.by_order(lists.words, lists.lengths, most), 1):
        known = pair_totals is not None and n > 2 and len(own) > 0
        whole = np.logical_and.reduce([pairs[k : k + len(own)] for k in range(n - 1)]) if known else own
        held = own & whole if only else own
        if n == 1 < least:
            words = np.unique(grams_at)
            continue
        different, at = np.unique(grams_at[held], return_inverse=True)
        if n == 1:
            words = different
        if n == 2 and pair_totals is not None:
            pairs = np.zeros(len(own), bool)
            pairs[own] = (pair_totals[np.searchsorted(np.sort(np.concatenate([words, different])), different)] > 1)[at]
        if n < least:
            continue
        asked = np.ones(len(different), bool)
        if known:
            asked[at] = whole[held]
        wide = max(len(different), 1)
        key, times = np.unique(bag[: len(held)][held] * wide + at, return_counts=True)
        lists_of = np.repeat(np.arange(len(lists.lengths)), np.diff(np.searchsorted(key, np.arange(len(lists.lengths) + 1) * wide)))
        yield _Order(different, asked, lists_of, key - lists_of * wide, times)


def _of_references(lists: _Lists, bag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each reference in turn the places that its list has in ``bag``, and whose they are."""
    starts, ends = np.searchsorted(bag, lists.ref, "left"), np.searchsorted(bag, lists.ref, "right")
    many = ends - starts
    owner = np.repeat(np.arange(len(many)), many)
    return np.arange(len(owner)) + np.repeat(starts - (np.cumsum(many) - many), many), owner


def _totals(answers: pa.Table, part: int) -> np.ndarray:
    """Numbers of items in the order of the sorted n-grams that were asked for."""
    rows = sorted((x for x in answers.to_pylist() if x["_part"] == part), key=lambda x: x["_range"])
    return np.concatenate([np.zeros(0, np.uint32), *(grams.unpacked_counts(x["counts"], x["many"]) for x in rows)])


def _document_frequencies(rows: DataFrame, most: int, ranges: int, lists: Callable[[pa.Table], _Lists] = _item_lists, pairs: DataFrame | None = None) -> DataFrame:
    """``_g, _part, _range, many, counts``: for each group of items, in order
    of the n-grams that it asked for, the number of items that have them in a reference.

    A group hands its different n-grams, packed and sorted, to ranges of the
    hashes; a range sums them and answers each group.  With the answers for
    ``pairs`` of words only longer n-grams are asked for, and only those whose
    pairs of words are all in two items or more: others are in one at most.
    """

    part_of = int(pairs is not None)

    def hand(group: pa.Table, answers: pa.Table | None) -> pa.Table:
        own = lists(group)
        several = len(own.item) > len(np.unique(own.item))
        asked, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for x in _counted(own, most) if answers is None else _counted(own, most, 3, _totals(answers, 0), True):
            at, owner = _of_references(own, x.bag)
            gram = x.gram[at]
            if several:
                gram = np.unique(own.item[owner] * max(len(x.different), 1) + gram) % max(len(x.different), 1)
            asked.append(x.different)
            counts.append(np.bincount(gram, minlength=len(x.different)))
        order = np.argsort(found := np.concatenate(asked))
        parts = grams.packed(found[order], np.concatenate(counts)[order], ranges)
        g = group.column("_g")[0].as_py() if len(group) else 0
        return pa.table({"_range": [k for k, _, _ in parts], "_g": [g] * len(parts), "hashes": [h for _, h, _ in parts], "counts": [c for _, _, c in parts]}, pa.schema([("_range", pa.int32()), ("_g", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary())]))

    def answer(part: pa.Table) -> pa.Table:
        hashes, counts, sizes = grams.unpacked(part.column("hashes"), part.column("counts"))
        found, at = np.unique(hashes, return_inverse=True)
        total = np.bincount(at, weights=counts, minlength=len(found)).astype(np.uint32)[at]
        ends = np.cumsum(sizes)
        packed = [grams.packed_counts(total[a:b]) for a, b in zip(ends - sizes, ends, strict=True)]
        return pa.table({"_g": part.column("_g"), "_part": pa.array([part_of] * len(sizes), pa.int32()), "_range": part.column("_range"), "many": sizes, "counts": pa.array(packed, pa.binary())})

    handing = "_range int, _g long, hashes binary, counts binary"
    groups = rows.groupBy("_g")
    handed = groups.applyInArrow(lambda group: hand(group, None), handing) if pairs is None else groups.cogroup(pairs.groupBy("_g")).applyInArrow(hand, handing)
    return handed.groupBy("_range").applyInArrow(answer, "_g long, _part int, _range int, many long, counts binary")


def _cider(rows: DataFrame, kind: T.DataType, items: int, groups: int, lists: Callable[[pa.Table], _Lists], most: int, sigma: float) -> DataFrame:
    """``_id, cider`` of rows in groups ``_g`` that ``lists`` reads; ``items`` in all."""

    def cosine(own: _Lists, x: _Order, known: np.ndarray, total: np.ndarray) -> np.ndarray:
        frequency = np.ones(len(x.different))
        frequency[x.asked] = np.maximum(total[np.searchsorted(known, x.different[x.asked])], 1)
        weight = x.times * (math.log(max(items, 1)) - np.log(frequency))[x.gram]
        norm = np.sqrt(np.bincount(x.bag, weights=weight * weight, minlength=len(own.lengths)))
        at, owner = _of_references(own, x.bag)
        wide = max(len(x.different), 1)
        pairs, key = x.bag * wide + x.gram, own.pred[own.item][owner] * wide + x.gram[at]
        place = np.minimum(np.searchsorted(pairs, key), max(len(pairs) - 1, 0))
        both = pairs[place] == key if len(pairs) else np.zeros(len(key), bool)
        dot = np.bincount(owner[both], weights=np.minimum(weight[place[both]], weight[at[both]]) * weight[at[both]], minlength=len(own.ref))
        below = norm[own.ref] * norm[own.pred[own.item]]
        return np.divide(dot, below, out=np.zeros_like(below), where=below > 0)

    def weigh(group: pa.Table, answers: pa.Table) -> pa.Table:
        own = lists(group)
        totals = [_totals(answers, k) for k in range(2)]
        gap = own.lengths[own.pred[own.item]] - own.lengths[own.ref]
        value, counted = np.zeros(len(own.ref)), _counted(own, most, 1, totals[0])
        for total, orders in zip(totals, (2, None), strict=True):
            part = list(itertools.islice(counted, orders))
            known = np.sort(np.concatenate([np.zeros(0, np.uint64), *(x.different[x.asked] for x in part)]))
            for x in part:
                value += cosine(own, x, known, total)
        value *= np.exp(-(gap**2) / (2 * sigma * sigma))
        many = np.bincount(own.item, minlength=len(own.pred))
        mean = np.divide(10 * np.bincount(own.item, weights=value, minlength=len(own.pred)), most * many, out=np.full(len(own.pred), np.nan), where=many > 0)
        return pa.table({"_id": own.ids, "cider": pa.array(mean, from_pandas=True)})

    ranges = (groups + 1) // 2
    totals = _document_frequencies(rows, min(most, 2), ranges, lists).repartition("_g")  # read twice, moved once
    if most > 2:
        totals = totals.unionAll(_document_frequencies(rows, most, ranges, lists, totals).repartition("_g"))
    schema = T.StructType([T.StructField("_id", kind), T.StructField("cider", T.DoubleType())])
    return rows.groupBy("_g").cogroup(totals.groupBy("_g")).applyInArrow(weigh, schema)


def cider(df: DataFrame, id_col: str, pred: str, refs: str, most: int = 4, sigma: float = 6.0) -> DataFrame:
    """``id, cider``: mean over references and orders of TF-IDF cosines, with
    clipped predicted weights and a length penalty, times 10.

    The document frequency of an n-gram counts the items (rows) with it in any
    reference.  Items lie in groups of about ``CIDER_TOKENS`` tokens by a hash
    of their id; n-grams travel as packed hashes (``operators/grams.py``), once
    to the range that counts them, and only counts come back.  A null
    prediction or reference has no n-grams; an item without references has a
    null value.
    """
    length = F.coalesce(F.size(pred), F.lit(0)) + F.coalesce(F.aggregate(refs, F.lit(0), lambda n, r: n + F.coalesce(F.size(r), F.lit(0))), F.lit(0))
    given = staged(df.select(F.col(id_col).alias("_id"), F.col(pred).cast("array<string>").alias("p"), F.col(refs).cast("array<array<string>>").alias("r"), length.cast("long").alias("_tokens")), "items")
    items, tokens = given.agg(F.count("*"), F.coalesce(F.sum("_tokens"), F.lit(0))).first()
    groups = tokens // CIDER_TOKENS + 1
    rows = given.drop("_tokens").withColumn("_g", F.pmod(F.xxhash64("_id"), F.lit(groups)))
    return _cider(rows, df.schema[id_col].dataType, items, groups, _item_lists, most, sigma).withColumnRenamed("_id", id_col)


def cider_of_next(df: DataFrame, id_col: str, text: str, most: int = 4, sigma: float = 6.0) -> DataFrame:
    """``cider`` of the lower-cased words of each text (between white space)
    against the text with the next whole-number id as its only reference; the
    last has an empty one.

    Runs of 2^``RUN_BITS`` ids stay together, with the text after them, so a
    text is moved once and its n-grams are counted once for both of its sides.
    """
    ids = df.select(F.col(id_col).cast("long").alias("_id"))
    items = ids.join(ids.select((F.col("_id") - 1).alias("_id")), "_id", "left").count()
    size = df.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    groups = size // (TOKEN_BYTES * CIDER_TOKENS) + 1
    run = lambda c: F.shiftright(c, RUN_BITS)
    key, at = F.col(id_col).cast("long"), F.coalesce("_run", F.xxhash64("_text"))
    rows = df.select(F.col(id_col).alias("_id"), F.lower(F.coalesce(text, F.lit(""))).alias("_text"), F.explode(F.array_distinct(F.array(run(key), run(key - 1)))).alias("_run"), run(key).alias("_of"))
    rows = rows.select("_id", "_text", F.coalesce("_run", F.lit(0)).alias("_run"), F.col("_run").eqNullSafe(F.col("_of")).alias("_own"), F.pmod(F.xxhash64(at), F.lit(groups)).alias("_g"))
    packed = rows.mapInArrow(_packed_texts, "_g long, data binary")
    return _cider(packed, df.schema[id_col].dataType, items, groups, _next_lists, most, sigma).withColumnRenamed("_id", id_col)


# --- groups that must be right as a whole (AGG14, AGG16-AGG21, AGG43) -------------


def all_correct(df: DataFrame, by: list[str], group: list[str], ok: str) -> DataFrame:
    """Share of groups (``group`` columns) in which every row is right."""
    per = df.groupBy(*by, *(g for g in group if g not in by)).agg(F.min(F.col(ok).cast("double")).alias("_ok"))
    return per.groupBy(*by).agg(F.avg("_ok").alias("all_correct"), F.count("*").alias("n_groups"))


def paired_score(df: DataFrame, category: str, pair: str, ok: str) -> DataFrame:
    """Per category: accuracy, share of fully right pairs, and their sum, all
    in percent."""
    per = df.groupBy(category, pair).agg(F.sum(F.col(ok).cast("double")).alias("_s"), F.count("*").alias("_n"))
    full = F.avg((F.col("_s") == F.col("_n")).cast("double"))
    acc = F.sum("_s") / F.sum("_n")
    return per.groupBy(category).agg((100 * acc).alias("acc"), (100 * full).alias("acc_plus"), (100 * (acc + full)).alias("score"))


def circular(df: DataFrame, key: Column, by: list[str], ok: str) -> DataFrame:
    """Accuracy where all variants of a question, rows with one ``key``, must
    be right."""
    return all_correct(df.withColumn("_key", key), by, ["_key"], ok)


def variant_key(qid: str, circular_of: bool = True, flips: bool = False) -> Column:
    """Question of a variant id such as ``AB12-flip-1``: without the number
    (circular), without the flip mark (flip), or both."""
    out = F.col(qid)
    out = F.regexp_replace(out, r"-\d+$", "") if circular_of else out
    return F.regexp_replace(out, r"-flip", "") if flips else out


def modulo_key(index: str, base: int = 1_000_000) -> Column:
    return F.col(index).cast("long") % base


def nested_accuracy(df: DataFrame, keys: dict[str, list[str]], ok: str) -> DataFrame:
    """One row: for each name the share of right groups of its key columns,
    and the plain accuracy."""
    out = df.agg(F.avg(F.col(ok).cast("double")).alias("accuracy"))
    for name, key in keys.items():
        out = out.crossJoin(all_correct(df, [], key, ok).select(F.col("all_correct").alias(name)))  # one row each
    return out


def two_by_two(df: DataFrame, group: str, question: str, image: str, ok: str) -> DataFrame:
    """Accuracy of questions (right on both images), images (both questions
    right) and groups (all four right) of 2 x 2 designs."""
    cell = lambda q, i: F.max(F.when((F.col(question) == q) & (F.col(image) == i), F.col(ok).cast("int")))
    per = df.groupBy(group).agg(*(cell(q, i).alias(f"_{q}{i}") for q in (0, 1) for i in (0, 1)))
    both = lambda a, b: (F.col(a) + F.col(b) == 2).cast("double")
    every = F.col("_00") + F.col("_01") + F.col("_10") + F.col("_11")
    return per.agg(
        F.avg((F.col("_00") + F.col("_01") + F.col("_10") + F.col("_11")) / 4.0).alias("accuracy"),
        F.avg((both("_00", "_01") + both("_10", "_11")) / 2).alias("question_acc"),
        F.avg((both("_00", "_10") + both("_01", "_11")) / 2).alias("image_acc"),
        F.avg((every == 4).cast("double")).alias("group_acc"),
    )


def dual_accuracy(a: DataFrame, b: DataFrame, key: str, category: str, ok: str) -> DataFrame:
    """Share right in both versions of a question, by category and overall
    (null category); ``a`` gives the category."""
    other = b.select(F.col(key), F.col(ok).alias("_b"))
    both = a.join(other, key).withColumn("_ok", F.least(F.col(ok).cast("int"), F.col("_b").cast("int")))
    return both.rollup(category).agg(F.avg("_ok").alias("dual_acc"), F.count("*").alias("n"))


# --- repeated samples (AGG22, AGG23) ----------------------------------------------


def at_k(df: DataFrame, doc: str, repeat: str, answer: str, correct: str, ks: list[int]) -> DataFrame:
    """``k, coverage, majority, average`` over documents.

    Of a document's first k repeats: any right, the most frequent answer right
    (the first seen of equals), share right.
    """
    rows = df.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).where(F.col(repeat) < F.col("k"))
    votes = rows.groupBy("k", doc, answer).agg(
        F.count("*").alias("_n"), F.min(repeat).alias("_first"), F.max(F.col(correct).cast("int")).alias("_ok"), F.sum(F.col(correct).cast("int")).alias("_right")
    )
    per = votes.groupBy("k", doc).agg(
        F.max("_ok").alias("_any"),
        F.max_by("_ok", F.struct(F.col("_n"), -F.col("_first"))).alias("_major"),
        (F.sum("_right") / F.sum("_n")).alias("_avg"),
    )
    return per.groupBy("k").agg(F.avg("_any").alias("coverage"), F.avg("_major").alias("majority"), F.avg("_avg").alias("average"))


def stability(df: DataFrame, by: list[str], doc: str, value: str) -> DataFrame:
    """Expected accuracy (mean of all repeats), consensus accuracy (more
    than half right), internal variance (over documents with two repeats or
    more) and consistency (all repeats alike)."""
    v = F.col(value).cast("double")
    per = df.groupBy(*by, doc).agg(
        F.sum(v).alias("_s"), F.count(v).alias("_n"), F.var_samp(v).alias("_var"), F.min(v).alias("_lo"), F.max(v).alias("_hi")
    )
    return per.groupBy(*by).agg(
        (F.sum("_s") / F.when(F.sum("_n") > 0, F.sum("_n"))).alias("expected_acc"),
        F.avg(F.coalesce((F.col("_s") * 2 > F.col("_n")).cast("double"), F.lit(0.0))).alias("consensus_acc"),
        F.avg(F.when(F.col("_n") > 1, F.col("_var"))).alias("internal_variance"),
        F.avg(F.coalesce((F.col("_lo") == F.col("_hi")).cast("double"), F.lit(0.0))).alias("consistency"),
    )


# --- categories (AGG24-AGG32, AGG39, AGG46-AGG52) ---------------------------------


def rollup_scores(df: DataFrame, dims: list[str], value: str) -> DataFrame:
    """Mean and count by each dimension alone and overall (null elsewhere)."""
    sets = [*([d] for d in dims), []]
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *dims).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


def mapped_rollup(df: DataFrame, key: str, mapping: DataFrame, parent: str, value: str) -> DataFrame:
    """Mean by key, by its parent in a mapping table, and overall; every level
    weighs rows, not groups."""
    rows = df.join(mapping, key, "left")
    return rows.rollup(parent, key).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


def macro_micro(df: DataFrame, by: list[str], category: str, value: str) -> DataFrame:
    """Mean of the category means, and the plain mean."""
    per = df.groupBy(*by, category).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    return per.groupBy(*by).agg(F.avg(F.col("_s") / F.col("_n")).alias("macro"), (F.sum("_s") / F.sum("_n")).alias("micro"))


def merged_types(df: DataFrame, kind: Column, merged: dict[str, str], value: str) -> DataFrame:
    """Mean per type after sub-types are merged: a merged type is the mean of
    its sub-types' means; ``type`` null is the unweighted mean over types."""
    table = F.create_map(*(F.lit(v) for pair in merged.items() for v in pair)) if merged else None
    target = F.coalesce(F.try_element_at(table, F.col("_kind")), F.col("_kind")) if table is not None else F.col("_kind")
    per = df.withColumn("_kind", kind).groupBy("_kind").agg(F.avg(value).alias("_m"))
    types = per.groupBy(target.alias("type")).agg(F.avg("_m").alias("mean"))
    return types.union(types.agg(F.lit(None).cast("string").alias("type"), F.avg("mean").alias("mean")))


def keyword_scores(df: DataFrame, keywords: str, value: str) -> DataFrame:
    """Count and mean of valid scores (not -1) for each keyword of an array."""
    rows = df.where(F.col(value) != -1).select(F.explode(keywords).alias("keyword"), value)
    return rows.groupBy("keyword").agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def split_macro(df: DataFrame, split: str, task: str, value: str) -> DataFrame:
    """Per split the mean of task means and number of tasks; split null weighs
    the splits by their tasks."""
    tasks = df.groupBy(split, task).agg(F.avg(value).alias("_m"))
    return tasks.rollup(split).agg(F.avg("_m").alias("mean"), F.count("*").alias("n_tasks"))


def field_scores(df: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """Weighted mean over valid fields (scores of 0 and more), and the least."""
    valid = F.col(value) >= 0
    w = F.when(valid, F.col(weight))
    return df.groupBy(*by).agg((F.sum(w * F.col(value)) / F.sum(w)).alias("weighted_mean"), F.min(F.when(valid, F.col(value))).alias("least"))


def outcome_shares(df: DataFrame, by: list[str], outcome: str, first: str = "detected", second: str = "corrected") -> DataFrame:
    """Shares of outcomes with conditional denominators: ``first`` or later of
    all, ``second`` of those; their product and mean."""
    late = F.count_if(F.col(outcome).isin(first, second))
    done, n = F.count_if(F.col(outcome) == second), F.count("*")
    per = df.groupBy(*by).agg(late.alias("_late"), done.alias("_done"), n.alias("n"))
    a = F.col("_late") / F.col("n")
    b = F.when(F.col("_late") > 0, F.col("_done") / F.col("_late")).otherwise(0.0)
    return per.select(*by, "n", a.alias(f"{first}_share"), b.alias(f"{second}_share"), (a * b).alias("ref_score"), ((a + b) / 2).alias("m_recall"))


def label_shares(df: DataFrame, by: list[str], label: str, labels: list[str]) -> DataFrame:
    """Percentage of each label."""
    return df.groupBy(*by).agg(*((100.0 * F.count_if(F.col(label) == x) / F.count("*")).alias(f"pct_{x}") for x in labels))


def win_rates(battles: DataFrame, a: str = "model_a", b: str = "model_b", winner: str = "winner") -> DataFrame:
    """Share of battles that each model won, a tie as half."""
    half = F.when(F.col(winner) == "tie", 0.5)
    one = battles.select(F.col(a).alias("model"), F.coalesce(half, (F.col(winner) == "A").cast("double")).alias("w"))
    two = battles.select(F.col(b).alias("model"), F.coalesce(half, (F.col(winner) == "B").cast("double")).alias("w"))
    return one.union(two).groupBy("model").agg(F.avg("w").alias("win_rate"), F.count("*").alias("n"))


def elo(battles: DataFrame, anchor: str | None = None, anchor_rating: float = 1000.0, a: str = "model_a", b: str = "model_b", winner: str = "winner", scale: float = 400.0, base: float = 10.0) -> DataFrame:
    """``model, rating`` of greatest likelihood, a tie as half a win for each.

    Spark reduces the battles to one row for each ordered pair of models; the
    maximum is then found by Newton's method over those sums, whose number is
    the square of the models', not of the battles.  Ratings have a finite
    maximum only among models of which each can be reached from each other
    along wins; the largest such group (that of the anchor, if given) is
    rated from the battles inside it, other models have a null rating.
    Without an anchor the mean rating is ``anchor_rating``.
    """
    half = F.when(F.col(winner) == "tie", 0.5)
    rows = battles.select(F.col(a).alias("i"), F.col(b).alias("j"), F.coalesce(half, (F.col(winner) == "A").cast("double")).alias("w"))
    both = rows.union(rows.select("j", "i", 1 - F.col("w"))).where("i is not null and j is not null and i <> j and w is not null")
    sums = both.groupBy("i", "j").agg(F.sum("w").alias("w"), F.count("*").alias("n")).collect()
    wins, games = {(r["i"], r["j"]): r["w"] for r in sums}, {(r["i"], r["j"]): r["n"] for r in sums}
    models = sorted({i for i, _ in wins})
    rated = _connected_by_wins(models, wins, anchor)
    rating = _most_likely(rated, wins, games)
    shift = anchor_rating - scale * (rating[anchor] if anchor in rating else 0.0) / math.log(base)
    found = [(m, scale * rating[m] / math.log(base) + shift if m in rating else None) for m in models]
    return battles.sparkSession.createDataFrame(found, "model string, rating double")


def _connected_by_wins(models: list[str], wins: dict, anchor: str | None) -> list[str]:
    """The models that reach, and are reached by, the anchor along wins; without
    an anchor the largest such group."""
    beats: dict[str, set] = {m: set() for m in models}
    loses: dict[str, set] = {m: set() for m in models}
    for (i, j), w in wins.items():
        if w > 0:
            beats[i].add(j)
            loses[j].add(i)

    def reached(start: str, along: dict[str, set]) -> set[str]:
        seen, todo = {start}, [start]
        while todo:
            for m in along[todo.pop()] - seen:
                seen.add(m)
                todo.append(m)
        return seen

    groups, left = [], set(models)
    while left:
        start = anchor if anchor in left else min(left)
        groups.append(reached(start, beats) & reached(start, loses))
        left -= groups[-1]
        if anchor in groups[-1]:
            return sorted(groups[-1])
    return sorted(max(groups, key=len, default=set()))


def _most_likely(models: list[str], wins: dict, games: dict, rounds: int = 100) -> dict[str, float]:
    """Log strengths, zero on average, at which every model's expected wins
    are its wins.  Newton steps with halving; raises if they do not settle."""
    at = {m: k for k, m in enumerate(models)}
    pairs = [(at[i], at[j], w, games[i, j]) for (i, j), w in wins.items() if i in at and j in at]
    if not pairs:
        return dict.fromkeys(models, 0.0)
    i, j, w, n = (np.array(x) for x in zip(*pairs, strict=True))
    many = len(models)
    won = np.bincount(i, weights=w, minlength=many)
    now = np.zeros(many)
    value = lambda s: float((won * s).sum() - 0.5 * (n * np.logaddexp(s[i], s[j])).sum())
    for _ in range(rounds):
        p = 1 / (1 + np.exp(now[j] - now[i]))
        slope = won - np.bincount(i, weights=n * p, minlength=many)
        if np.abs(slope).max() <= 1e-9 * max(1.0, n.max()):
            return dict(zip(models, (now - now.mean()).tolist(), strict=True))
        bend = np.zeros((many, many))
        np.add.at(bend, (i, j), -n * p * (1 - p))
        bend[np.arange(many), np.arange(many)] = -bend.sum(axis=1)
        step = np.linalg.solve(bend + 1.0 / many, slope)  # the shift that changes nothing is fixed at zero
        size, was = 1.0, value(now)
        while value(now + size * step) < was - 1e-12 * abs(was) and size > 1e-10:
            size /= 2
        now = now + size * step
    raise RuntimeError("the ratings did not settle")


def hallucination(df: DataFrame, by: list[str], pred: str, gold: str) -> DataFrame:
    """Of captions as arrays of mentioned objects: share of mentions whose
    object is not there (every mention counts, repeats too), share of captions
    with one, recall of the different gold objects.  A null array is empty;
    shares of nothing are null."""
    none = F.array().cast(df.schema[pred].dataType)
    said, there = F.coalesce(pred, none), F.array_distinct(F.coalesce(gold, none))
    wrong = F.size(F.filter(said, lambda x: ~F.array_contains(there, x)))
    share = lambda a, b: F.sum(a) / F.nullif(F.sum(b), F.lit(0))
    return df.groupBy(*by).agg(
        share(wrong, F.size(said)).alias("object_rate"),
        (F.count_if(wrong > 0) / F.count("*")).alias("caption_rate"),
        share(F.size(F.array_intersect(said, there)), F.size(there)).alias("recall"),
    )


def recall_at(df: DataFrame, by: list[str], iou: str, thresholds: tuple[float, ...] = (0.3, 0.5, 0.7)) -> DataFrame:
    """Mean overlap and share of rows at or above each threshold."""
    return df.groupBy(*by).agg(F.avg(iou).alias("miou"), *(F.avg((F.col(iou) >= t).cast("double")).alias(f"r_at_{int(t * 100)}") for t in thresholds))


def detection(pairs: DataFrame, gold_counts: DataFrame, pred_counts: DataFrame, iou: str, thresholds: list[float], group: str = "video") -> DataFrame:
    """Precision and recall at each threshold, averaged over groups.

    ``pairs`` has group, gold_id, pred_id and overlap of the gold x predicted
    segments of a group; the counts have group and n.  A segment counts as
    covered if its best overlap reaches the threshold.
    """
    steps = F.explode(F.array(*map(F.lit, thresholds))).alias("threshold")

    def covered(side: str, counts: DataFrame) -> DataFrame:
        best = pairs.groupBy(group, side).agg(F.max(iou).alias("_best"))
        hits = best.select(group, steps, "_best").groupBy(group, "threshold").agg(F.count_if(F.col("_best") >= F.col("threshold")).alias("_hit"))
        full = counts.select(group, "n", steps).join(hits, [group, "threshold"], "left")
        return full.groupBy("threshold").agg(F.avg(F.coalesce("_hit", F.lit(0)) / F.col("n")).alias(side))

    both = covered("pred_id", pred_counts).join(covered("gold_id", gold_counts), "threshold")
    return both.select("threshold", F.col("pred_id").alias("precision"), F.col("gold_id").alias("recall"))


def flattened_accuracy(df: DataFrame, by: list[str], flags: str) -> DataFrame:
    """Mean over all elements of boolean arrays."""
    return df.select(*by, F.explode(flags).alias("_f")).groupBy(*by).agg(F.avg(F.col("_f").cast("double")).alias("accuracy"))


def flatten_groups(edges: DataFrame) -> DataFrame:
    """``root, leaf`` of a group tree with ``parent, child`` edges, of any
    depth: one join for each level, staged, until no level is left.

    Repeated edges count once; an empty table gives an empty result.  A group
    inside itself is an error: on a cycle the levels would not end.
    """
    edges = staged(edges.select("parent", "child").where("parent is not null and child is not null").distinct(), "edges")
    parents = edges.select(F.col("parent").alias("leaf")).distinct()
    nodes = edges.select("parent").union(edges.select("child")).distinct().count()
    now, out, level = edges.select(F.col("parent").alias("root"), F.col("child").alias("leaf")), None, 0
    while True:
        leaves = now.join(parents, "leaf", "left_anti").select("root", "leaf")
        out = leaves if out is None else out.union(leaves)
        now = staged(now.join(edges, now["leaf"] == edges["parent"]).select("root", F.col("child").alias("leaf")).distinct(), "level")
        level += 1
        if now.isEmpty():
            return out.distinct()
        if level > nodes or not now.where(F.col("root") == F.col("leaf")).isEmpty():
            raise ValueError("a group contains itself")


def group_scores(results: DataFrame, groups: DataFrame, weight_by_size: bool = True, keys: tuple[str, ...] = ("metric", "filter")) -> DataFrame:
    """Scores of groups from ``results`` (task, keys..., value, n) and
    ``groups`` (root, leaf)."""
    rows = results.join(groups, results["task"] == groups["leaf"])
    w = F.col("n") if weight_by_size else F.lit(1)
    return rows.groupBy("root", *keys).agg((F.sum(F.col("value") * w) / F.sum(w)).alias("value"), F.sum("n").alias("n"))


def throughput(df: DataFrame, by: list[str], tokens: str, seconds: str) -> DataFrame:
    """Total tokens and time, tokens per second, mean latency."""
    t, s = F.sum(tokens), F.sum(seconds)
    return df.groupBy(*by).agg(t.alias("total_tokens"), s.alias("total_seconds"), F.when(s > 0, t / s).alias("tokens_per_second"), F.avg(seconds).alias("mean_latency"))


def request_health(df: DataFrame, by: list[str], latency: str, failed: Column, limited: Column, share: float = 0.95) -> DataFrame:
    """Latency at the lower nearest rank of ``share`` (of the rows that have
    one), failure and rate-limit rates."""
    rows = df.select(*by, F.col(latency).alias("_l"), failed.cast("int").alias("_f"), limited.cast("int").alias("_m"))
    rates = rows.groupBy(*by).agg(F.avg("_f").alias("failure_rate"), F.avg("_m").alias("limit_rate"), F.count("*").alias("n"))
    tail = at_rank(rows.where("_l is not null"), by, "_l", lambda n: F.floor(F.lit(share) * (n - 1)) + 1, "p95")
    if not by:
        return rates.join(tail, F.lit(True), "left").select("p95", "failure_rate", "limit_rate", "n")
    tail = tail.withColumnsRenamed({b: f"_k{k}" for k, b in enumerate(by)})
    on = functools.reduce(lambda x, y: x & y, (F.col(b).eqNullSafe(F.col(f"_k{k}")) for k, b in enumerate(by)))
    return rates.join(tail, on, "left").select(*by, "p95", "failure_rate", "limit_rate", "n")


def common_direction(df: DataFrame, by: list[str], direction: str) -> DataFrame:
    """Direction of improvement of a metric; null where the parts disagree."""
    d = F.col(direction)
    return df.groupBy(*by).agg(F.when(F.min(d) == F.max(d), F.min(d)).alias("direction"))


def relative_score(df: DataFrame, by: list[str], model: str, reference: str, missing: float = -999) -> DataFrame:
    """100 x mean model score over mean reference score, missing ones dropped."""
    good = (F.col(model) != missing) & (F.col(reference) != missing)
    return df.where(good).groupBy(*by).agg((100 * F.avg(model) / F.avg(reference)).alias("relative"))


def presence_metrics(df: DataFrame, gold: str, pred: str, tp: str, fp: str, fn: str, f1: str) -> DataFrame:
    """Dataset-level presence and location: image-level Matthews correlation,
    positive micro F1 (mean over the thresholds of element-wise summed counts)
    and their gated product x 100, and the macro F1: mean of the samples' own
    ``f1`` where it is valid (0 or more).  tp, fp, fn are arrays by threshold."""
    g, p = F.col(gold), F.col(pred)
    whole = df.agg(F.count_if(g & p).alias("a"), F.count_if(~g & ~p).alias("b"), F.count_if(~g & p).alias("c"), F.count_if(g & ~p).alias("d"), F.coalesce(F.avg(F.when(F.col(f1) >= 0, F.col(f1))), F.lit(0.0)).alias("macro_f1"))
    below = F.sqrt(((F.col("a") + F.col("c")) * (F.col("a") + F.col("d"))).cast("double")) * F.sqrt(((F.col("b") + F.col("c")) * (F.col("b") + F.col("d"))).cast("double"))
    whole = whole.select("a", "b", "c", "d", F.when(below > 0, (F.col("a") * F.col("b") - F.col("c") * F.col("d")) / below).otherwise(0.0).alias("mcc"), "macro_f1")
    steps = df.where(g).select(F.posexplode(F.arrays_zip(F.col(tp).alias("tp"), F.col(fp).alias("fp"), F.col(fn).alias("fn"))).alias("k", "x"))
    sums = steps.groupBy("k").agg(*(F.sum(f"x.{c}").alias(c) for c in ("tp", "fp", "fn")))
    two = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    micro = sums.agg(F.avg(F.when(two > 0, 2 * F.col("tp") / two).otherwise(0.0)).alias("pmf1"))
    return whole.crossJoin(micro).select("a", "b", "c", "d", "mcc", "macro_f1", "pmf1", (100 * F.col("mcc") * F.col("pmf1")).alias("gated_f1"))


def subset_means(df: DataFrame, language: str, subset: str, value: str) -> DataFrame:
    """Mean for each language, subset, both and neither."""
    return df.cube(language, subset).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


def fixed_total(df: DataFrame, kind: str, groups: DataFrame, value: str) -> DataFrame:
    """Summed scores by type, by the type's group and in total."""
    return df.join(groups, kind, "left").rollup("group", kind).agg(F.sum(value).alias("total"))


def binomial_accuracy(df: DataFrame, keys: list[str], ok: str, error: Column | None = None) -> DataFrame:
    """Accuracy with sqrt(p (1 - p) / n) by each key alone and overall, rows
    with an error removed."""
    rows = df.where(~F.coalesce(error, F.lit(False))) if error is not None else df
    sets = [[F.col(k)] for k in keys] + [[]]
    p, n = F.avg(F.col(ok).cast("double")), F.count("*")
    return rows.groupingSets(sets, *keys).agg(p.alias("accuracy"), F.sqrt(p * (1 - p) / n).alias("stderr"), n.alias("n"))


def tier_means(df: DataFrame, task: str, tiers: DataFrame, value: str) -> DataFrame:
    """Mean of task means by tier (table task, tier), and over all tasks."""
    tasks = df.groupBy(task).agg(F.avg(value).alias("_m")).join(tiers, task)
    return tasks.rollup("tier").agg(F.avg("_m").alias("mean"), F.count("*").alias("n_tasks"))


def selection_score(df: DataFrame, by: list[str], chosen: str, valid: str, unsure: str) -> DataFrame:
    """1 for a choice among the valid ones, 0.5 among the unsure, else 0."""
    value = F.when(F.array_contains(F.col(valid), F.col(chosen)), 1.0).when(F.array_contains(F.col(unsure), F.col(chosen)), 0.5).otherwise(0.0)
    return df.groupBy(*by).agg(F.avg(value).alias("selection"))


def judge_means(df: DataFrame, category: str, value: str, least: float = 1.0, most: float = 5.0) -> DataFrame:
    """Mean of valid judge scores (0 and more), rescaled to 0-100, by category
    and overall."""
    rows = df.where(F.col(value) >= 0)
    return rows.rollup(category).agg((100 * (F.avg(value) - least) / (most - least)).alias("mean"), F.count("*").alias("n"))
