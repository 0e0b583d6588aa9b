"""Scores of one sample: Columns to Columns.

Arithmetic metrics give null for null inputs unless they say otherwise.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from scorewright.functions.extract import _c, let, nullif_empty, qa_form

Text = Column | str


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def _mean(xs: Column) -> Column:
    return F.when(F.size(xs) > 0, _sum(xs) / F.size(xs))


def option_match(pred: Text, gold: Text) -> Column:
    """1 if the options agree whatever their case; null pred is wrong."""
    return F.coalesce((F.lower(_c(pred)) == F.lower(_c(gold))).cast("double"), F.lit(0.0))


#: Confidence thresholds of the mean relative accuracy: 0.50 to 0.95.
MRA_STEPS = [0.5 + k * (0.95 - 0.5) / 9 for k in range(10)]


def mra(pred: Text, gold: Text, zero: str = "zero", signed: bool = False) -> Column:
    """Mean relative accuracy over ten thresholds.

    ``zero`` says what a target of 0 does: "zero" scores 0, "exact" 1 if the
    prediction is within 1e-6, "absolute" takes the absolute error for the
    relative one, "null" gives null.  ``signed`` divides by the target, not
    its magnitude.  A null prediction scores 0.
    """
    p, g = _c(pred).cast("double"), _c(gold).cast("double")
    share = lambda rel: _mean(F.transform(F.array(*map(F.lit, MRA_STEPS)), lambda t: (rel <= 1 - t).cast("double")))
    at_zero = {
        "zero": F.lit(0.0),
        "exact": (F.abs(p) < 1e-6).cast("double"),
        "absolute": share(F.abs(p - g)),
        "null": F.lit(None).cast("double"),
    }[zero]
    rel = F.abs(p - g) / F.when(g != 0, g if signed else F.abs(g))
    return F.when(g == 0, at_zero).when(p.isNull(), 0.0).otherwise(share(rel))


def edit_distance(a: Text, b: Text, wide: bool = False) -> Column:
    """Edit distance of characters.  ``wide`` is for whole texts: 64
    rows of the table in one integer (Arrow batches), where the built-in
    distance takes a step for each pair of characters."""
    if not wide:
        return F.levenshtein(_c(a), _c(b))

    @F.pandas_udf("int")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return _edits_column(a, b)

    return run(_c(a), _c(b))


def anls(pred: Text, refs: Text | list[Column], threshold: float = 0.5, wide: bool = False) -> Column:
    """Normalised edit similarity to the nearest reference, 0 under the
    threshold.  Distances are of trimmed lower-case texts with single spaces,
    lengths of the texts as they are.  Whole texts (``wide``) take their
    references as a list of columns."""
    form = lambda t: F.trim(F.regexp_replace(F.lower(t), r"\s+", " "))
    if wide:
        longer = lambda t: F.greatest(F.length(t), F.length(_c(pred)))
        each = [F.when(longer(t) == 0, 0.0).otherwise(edit_distance(form(t), form(_c(pred)), True) / longer(t)) for t in refs]
        far = F.array_min(F.array(*each))
        return F.when(1 - far >= threshold, 1 - far).otherwise(F.when(far.isNotNull(), 0.0))
    size = lambda t: F.greatest(F.length(t), F.length(_c(pred)))
    far = F.array_min(
        F.transform(_c(refs), lambda t: F.when(size(t) == 0, 0.0).otherwise(F.levenshtein(form(t), form(_c(pred))) / size(t)))
    )
    return F.when(1 - far >= threshold, 1 - far).otherwise(F.when(far.isNotNull(), 0.0))


def relaxed(pred: Text, gold: Text, tolerance: float = 0.05) -> Column:
    """1 if two numbers differ by at most the tolerance relative to the gold
    (percent signs read as hundredths), else if the texts agree in lower case."""

    def number(t: Column) -> Column:
        bare = F.trim(t)
        share = F.regexp_extract(bare, r"^(.*)%$", 1).try_cast("double") / 100
        return F.when(bare.endswith("%"), share).otherwise(bare.try_cast("double"))

    p, g = number(_c(pred)), number(_c(gold))
    near = F.abs(p - g) / F.when(g != 0, F.abs(g)) <= tolerance
    return F.when(p.isNotNull() & g.isNotNull() & (g != 0), near).otherwise(F.lower(_c(pred)) == F.lower(_c(gold))).cast("double")


def vqa_consensus(pred: Text, answers: Text) -> Column:
    """Mean over the annotators of min(1, matches among the others / 3)."""
    a = _c(answers)
    hits = F.size(F.filter(a, lambda x: x == _c(pred)))
    return _mean(F.transform(a, lambda x: F.least(F.lit(1.0), (hits - (x == _c(pred)).cast("int")) / 3.0)))


def _common_tokens(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Common tokens of the bags of each row; null tokens count once, as in sets."""
    named = pa.concat_arrays([a.flatten(), b.flatten()]).dictionary_encode()
    codes = named.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1  # zero is null
    kinds, done, sides = len(named.dictionary) + 1, 0, []
    for x in (a, b):
        many = x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        end = done + int(many.sum())
        sides.append(np.unique(np.repeat(np.arange(len(x)), many) * kinds + codes[done:end], return_counts=True))
        done = end
    (left, m), (right, n) = sides
    keys, i, j = np.intersect1d(left, right, assume_unique=True, return_indices=True)
    least = np.where(keys % kinds == 0, 1, np.minimum(m[i], n[j]))
    return np.bincount(keys // kinds, least, len(a)).astype(np.int64)


def _none(a: pa.Array, b: pa.Array) -> np.ndarray:
    return a.is_null().to_numpy(zero_copy_only=False) | b.is_null().to_numpy(zero_copy_only=False)


def token_overlap(a: Column, b: Column) -> Column:
    """Common tokens of two bags (Arrow batches: tokens of a batch are numbered
    and counted together, where expressions sort each bag and name its tokens)."""

    @F.arrow_udf("int")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(_common_tokens(a, b), pa.int32(), mask=_none(a, b))

    return run(a, b)


def _tokens(x: Column) -> Column:
    return F.filter(F.split(x, " "), lambda t: t != "")


def token_f1(pred: Text, gold: Text) -> Column:
    """F1 of the token bags of the question-answering forms."""

    @F.arrow_udf("double")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        both = sum(x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (a, b))
        return pa.array(2.0 * _common_tokens(a, b) / np.maximum(both, 1), pa.float64(), mask=_none(a, b))

    return run(_tokens(qa_form(pred)), _tokens(qa_form(gold)))


def _ratio(a: Column, b: Column) -> Column:
    """a / b; an empty denominator counts as fully right."""
    return F.when(b == 0, 1.0).otherwise(a / b)


def jaccard(a: Text, b: Text) -> Column:
    return _ratio(F.size(F.array_intersect(_c(a), _c(b))), F.size(F.array_union(_c(a), _c(b))))


def set_precision(pred: Text, gold: Text) -> Column:
    return _ratio(F.size(F.array_intersect(_c(pred), _c(gold))), F.size(F.array_distinct(_c(pred))))


def set_recall(pred: Text, gold: Text) -> Column:
    return set_precision(gold, pred)


def set_equality(a: Text, b: Text) -> Column:
    return (jaccard(a, b) == 1.0).cast("double")


def prefix_ratio(a: Text, b: Text) -> Column:
    """Length of the longest common prefix over the longer sequence."""
    same = F.zip_with(_c(a), _c(b), lambda x, y: F.coalesce(x == y, F.lit(False)))

    def share(s: Column) -> Column:
        return let(F.array_position(s, False), lambda at: _ratio(F.when(at == 0, F.size(s)).otherwise(at - 1).cast("double"), F.size(s)))

    return let(same, share)


def sequence_equality(a: Text, b: Text) -> Column:
    return (_c(a) == _c(b)).cast("double")


def sequence_accuracy(pred: Text, gold: Text) -> Column:
    """Share of positions that agree; 0 if the lengths differ."""
    same = F.zip_with(_c(pred), _c(gold), lambda x, y: F.coalesce((x == y).cast("double"), F.lit(0.0)))
    return F.when(F.size(_c(pred)) != F.size(_c(gold)), 0.0).otherwise(let(same, lambda s: F.coalesce(_mean(s), F.lit(1.0))))


def json_map(x: Text) -> Column:
    """A JSON object as a map of strings; null if it is not one."""
    return F.from_json(_c(x), "map<string,string>")


def map_key_precision(pred: Text, gold: Text) -> Column:
    return set_precision(F.map_keys(_c(pred)), F.map_keys(_c(gold)))


def map_recall(pred: Text, gold: Text) -> Column:
    """Share of the gold pairs that the prediction has."""
    p, g = _c(pred), _c(gold)
    right = F.filter(F.map_entries(g), lambda e: F.try_element_at(p, e["key"]).eqNullSafe(e["value"]))
    return _ratio(F.size(right), F.size(F.map_entries(g)))


def map_equality(pred: Text, gold: Text) -> Column:
    same = F.size(F.map_entries(_c(pred))) == F.size(F.map_entries(_c(gold)))
    return ((map_recall(pred, gold) == 1.0) & same).cast("double")


def map_jaccard(pred: Text, gold: Text) -> Column:
    """Mean over the gold keys of the token Jaccard of the values."""
    p = _c(pred)
    part = lambda e: jaccard(F.split(F.coalesce(F.try_element_at(p, e["key"]), F.lit("")), r"\s+"), F.split(F.coalesce(e["value"], F.lit("")), r"\s+"))
    return F.coalesce(_mean(F.transform(F.map_entries(_c(gold)), part)), F.lit(1.0))


def relative_difference(pred: Text, gold: Text) -> Column:
    """1 - |difference| / |gold|, at least 0; a gold of 0 needs equality."""
    p, g = _c(pred).cast("double"), _c(gold).cast("double")
    return F.when(g == 0, (p == 0).cast("double")).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(p - g) / F.when(g != 0, F.abs(g))))


def mse(pred: Text, gold: Text) -> Column:
    return _mean(F.zip_with(_c(pred), _c(gold), lambda x, y: (x - y) * (x - y)))


def normalised_rmse(pred: Text, gold: Text, low: float, high: float) -> Column:
    return F.greatest(F.lit(0.0), 1 - F.sqrt(mse(pred, gold)) / (high - low))


def angle_rmse(pred: Text, gold: Text) -> Column:
    """1 - root mean square of the angle differences (degrees, the short way) / 180."""
    turn = lambda x, y: F.pmod(x - y + 180.0, F.lit(360.0)) - 180.0
    return 1 - F.sqrt(_mean(F.zip_with(_c(pred), _c(gold), lambda x, y: turn(x, y) * turn(x, y)))) / 180


def edit_similarity(a: Text, b: Text, wide: bool = False) -> Column:
    n = F.greatest(F.length(_c(a)), F.length(_c(b)))
    return F.when(n == 0, 1.0).otherwise(1 - edit_distance(a, b, wide) / n)


def near_match(a: Text, b: Text, threshold: float = 0.9, wide: bool = False) -> Column:
    form = lambda t: F.lower(F.trim(_c(t)))
    return (edit_similarity(form(a), form(b), wide) >= threshold).cast("double")


def _edits(a, b, swaps: bool = False) -> int:
    """Edit distance of two sequences, with ``swaps`` of neighbours or without
    (optimal alignment).  A column of the table is one integer whose bits are
    the steps down the column, so a column costs a few integer operations; the
    last column's steps lead from its first cell to the distance.  Bits beyond
    the length may be set in between: they reach no bit below."""
    if not len(a) or not len(b):
        return len(a) + len(b)
    if len(a) < len(b):  # fewer and wider columns: the distance is the same either way
        a, b = b, a
    asked, where = set(b), {}
    for k, x in enumerate(a):
        if x in asked:
            where[x] = where.get(x, 0) | 1 << k
    full = (1 << len(a)) - 1
    up, down, same, before = full, 0, 0, 0
    for y in b:
        match = where.get(y, 0)
        if match:
            swap = (((same ^ full) & match) << 1) & before if swaps else 0
            same = (((match & up) + up) ^ up) | match | down | swap
            more = (down | ((same | up) ^ full)) << 1 | 1
            up = ((same & up) << 1 | ((same | more) ^ full)) & full
            down = more & same
        else:  # what the other does not have
            same = down
            more = (down | ((down | up) ^ full)) << 1 | 1
            up = ((down | more) ^ full) & full
            down &= more
        before = match
    return len(b) + up.bit_count() - (down & full).bit_count()


#: Blocks of 64 rows that are stepped together; cells of the table of places of one pair, beyond which it is taken alone.
LANES, PLACES = 8192, 1 << 26


def _numbered(x, known: dict) -> np.ndarray:
    if isinstance(x, str):
        return np.frombuffer(x.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    return np.array([known.setdefault(t, len(known)) for t in x], np.int64)


def _edits_many(pairs: list[tuple], swaps: bool = False) -> list[int]:
    """Edit distances of many pairs of texts or token lists, with ``swaps`` of
    neighbours or without.

    A column of a pair's table is blocks of 64 rows.  A block needs the one
    above it in the same column and itself in the column before, so block k
    works on column t - k in step t, and the blocks of all pairs of a group are
    stepped together as arrays.  Pairs of about the same number of steps are a group.
    """
    out, work, known = [0] * len(pairs), [], {}
    for at, (a, b) in enumerate(pairs):
        a, b = _numbered(a, known), _numbered(b, known)
        if len(a) < len(b):
            a, b = b, a
        if not len(b):
            out[at] = len(a)
        elif len(a) != len(b) or (a != b).any():
            kinds = np.unique(a)
            if len(kinds) * len(a) > PLACES:
                out[at] = _edits(a.tolist(), b.tolist(), swaps)
            else:
                work.append((len(b) + -(-len(a) // 64), at, a, b, kinds))
    work.sort(key=lambda w: (-w[0], w[1]))
    group, lanes = [], 0
    for w in work:
        blocks = -(-len(w[2]) // 64)
        if group and (lanes + blocks > LANES or 4 * w[0] < 3 * group[0][0]):
            _step_group(group, out, swaps)
            group, lanes = [], 0
        group.append(w)
        lanes += blocks
    if group:
        _step_group(group, out, swaps)
    return out


def _step_group(group: list[tuple], out: list[int], swaps: bool) -> None:
    """Distances of the pairs of a group into ``out``."""
    steps = group[0][0]
    tables, columns, place, row, first, last, top = [np.zeros(1, np.uint64)], [], [], [], [], [], []
    filled, listed, lanes = 1, 0, 0
    for _, _, a, b, kinds in group:
        blocks = -(-len(a) // 64)
        padded = np.full(blocks * 64, -1, np.int64)
        padded[: len(a)] = a
        tables.append(np.packbits(padded == kinds[:, None], axis=1, bitorder="little").view(np.uint64).ravel())
        tables.append(np.zeros(blocks, np.uint64))  # of what the first text does not have
        code = np.minimum(np.searchsorted(kinds, b), len(kinds) - 1)
        code = np.where(kinds[code] == b, code, len(kinds))
        none = filled + len(kinds) * blocks
        columns += [np.full(blocks, none), filled + code * blocks, np.full(steps - len(b), none)]
        row.append(np.arange(blocks))
        place.append(listed + blocks - np.arange(blocks))
        first.append(lanes)
        last.append(lanes + blocks - 1)
        top.append((len(a) - 1) % 64)
        filled, listed, lanes = filled + (len(kinds) + 1) * blocks, listed + blocks + steps, lanes + blocks
    table, columns = np.concatenate(tables), np.concatenate(columns)
    place, row, first, last = np.concatenate(place), np.concatenate(row), np.array(first), np.array(last)
    top, long, begin = np.array(top, np.uint64), np.array([len(b) for _, _, _, b, _ in group]), row[last]
    one, end = np.uint64(1), np.uint64(63)
    up, down = np.full(lanes, ~np.uint64(0)), np.zeros(lanes, np.uint64)
    more_in, less_in, swap_in = (np.zeros(lanes, np.uint64) for _ in range(3))
    match, same, more, less, high = (np.empty(lanes, np.uint64) for _ in range(5))
    before, apart, swap = np.zeros(lanes, np.uint64), np.zeros(lanes, np.uint64), np.empty(lanes, np.uint64)
    at = np.empty(lanes, np.int64)
    # the last rows' steps along the row, for each column
    rose, fell = (np.empty((steps, len(group)), np.uint64) for _ in range(2))
    for t in range(steps):
        more_in[first], less_in[first] = one, 0
        columns.take(place, out=at, mode="clip")
        place += 1
        at += row
        table.take(at, out=match, mode="clip")
        if swaps:  # of this column's letter and the one before it
            np.bitwise_and(apart, match, out=apart)
            np.left_shift(apart, one, out=swap)
            swap_in[first] = 0
            swap |= swap_in
            swap &= before
            np.right_shift(apart[:-1], end, out=swap_in[1:])
            before[:] = match
        np.bitwise_or(match, down, out=high)
        match |= less_in
        np.bitwise_and(match, up, out=same)
        same += up
        same ^= up
        same |= match
        if swaps:
            same |= swap
            high |= same
            np.invert(high, out=apart)
        np.bitwise_or(same, up, out=more)
        np.invert(more, out=more)
        more |= down
        np.bitwise_and(up, same, out=less)
        more.take(last, out=rose[t], mode="clip")
        less.take(last, out=fell[t], mode="clip")
        np.left_shift(more, one, out=same)
        same |= more_in
        np.left_shift(less, one, out=match)
        match |= less_in
        np.right_shift(more[:-1], end, out=more_in[1:])
        np.right_shift(less[:-1], end, out=less_in[1:])
        np.bitwise_or(high, same, out=up)
        np.invert(up, out=up)
        up |= match
        np.bitwise_and(same, high, out=down)
    for k, (_, where, a, _, _) in enumerate(group):
        seen = slice(begin[k], begin[k] + long[k])
        out[where] = len(a) + int((rose[seen, k] >> top[k] & one).sum()) - int((fell[seen, k] >> top[k] & one).sum())


def _edits_column(a: pd.Series, b: pd.Series) -> pd.Series:
    held = [k for k, (x, y) in enumerate(zip(a, b, strict=True)) if x is not None and y is not None]
    out: list = [None] * len(a)
    for k, d in zip(held, _edits_many([(a.iloc[k], b.iloc[k]) for k in held]), strict=True):
        out[k] = d
    return pd.Series(out, dtype="Int32")


def _common(x: list, y: list) -> int:
    """Length of the longest common subsequence, a column of the table in one
    integer: its zero bits are the steps."""
    where: dict = {}
    for k, u in enumerate(x):
        where[u] = where.get(u, 0) | 1 << k
    full = (1 << len(x)) - 1
    row = full
    for v in y:
        hit = row & where.get(v, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(x) - row.bit_count()


def damerau_similarity(a: Text, b: Text) -> Column:
    """1 - distance with swaps / longer length (Arrow batches: no expression
    has swaps)."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        held = [k for k, (x, y) in enumerate(zip(a, b, strict=True)) if x is not None and y is not None]
        pairs, out = [(a.iloc[k], b.iloc[k]) for k in held], [None] * len(a)
        for k, (x, y), d in zip(held, pairs, _edits_many(pairs, swaps=True), strict=True):
            out[k] = 1 - d / max(len(x), len(y)) if len(x) or len(y) else 1.0
        return pd.Series(out, dtype="float64")

    return run(_c(a), _c(b))


def ratcliff_similarity(a: Text, b: Text) -> Column:
    """Matching-blocks similarity of two texts or two token arrays (Arrow
    batches: a recursive search)."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        import difflib

        lists = lambda x: x if isinstance(x, str) else x.tolist()
        ratio = lambda x, y: difflib.SequenceMatcher(None, lists(x), lists(y), autojunk=False).ratio()
        return pd.Series([None if x is None or y is None else ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return run(_c(a), _c(b))


# --- boxes, points, intervals -------------------------------------------------


def _area(b: Column) -> Column:
    return F.greatest(b[2] - b[0], F.lit(0.0)) * F.greatest(b[3] - b[1], F.lit(0.0))


def box_iou(a: Text, b: Text) -> Column:
    """Intersection over union of [x0, y0, x1, y1] boxes; 0 for empty unions."""
    x, y = _c(a), _c(b)
    both = F.greatest(F.least(x[2], y[2]) - F.greatest(x[0], y[0]), F.lit(0.0)) * F.greatest(
        F.least(x[3], y[3]) - F.greatest(x[1], y[1]), F.lit(0.0)
    )
    union = _area(x) + _area(y) - both
    return F.when(union > 0, both / union).otherwise(F.when(union.isNotNull(), 0.0))


def centre_hit(pred: Text, gold: Text) -> Column:
    """1 if the centre of the predicted box lies in the gold box."""
    p = _c(pred)
    return point_in_box(F.array((p[0] + p[2]) / 2, (p[1] + p[3]) / 2), gold)


def point_in_box(point: Text, box: Text) -> Column:
    p, b = _c(point), _c(box)
    return (p[0].between(b[0], b[2]) & p[1].between(b[1], b[3])).cast("double")


def point_distance(a: Text, b: Text) -> Column:
    """1 - distance of two points of the unit square, at least 0."""
    x, y = _c(a), _c(b)
    return F.greatest(F.lit(0.0), 1 - F.hypot(x[0] - y[0], x[1] - y[1]))


def many_box_iou(pred: Text, gold: Text) -> Column:
    """Mean over the gold boxes of the best overlap with a predicted box."""
    best = lambda g: F.coalesce(F.array_max(F.transform(_c(pred), lambda p: box_iou(p, g))), F.lit(0.0))
    return F.coalesce(_mean(F.transform(_c(gold), best)), F.lit(1.0))


def keypoint_match(pred: Text, gold: Text) -> Column:
    """Mean of exp(-10 d / sqrt 2) over paired points; 0 if the counts differ."""
    near = lambda p, g: F.exp(-10 * F.hypot(p[0] - g[0], p[1] - g[1]) / math.sqrt(2))
    return F.when(F.size(_c(pred)) != F.size(_c(gold)), 0.0).otherwise(_mean(F.zip_with(_c(pred), _c(gold), near)))


EARTH_KM = 6371.0088


def geo_km(lat_a: Text, lon_a: Text, lat_b: Text, lon_b: Text) -> Column:
    """Great-circle distance in kilometres."""
    a, b = F.radians(_c(lat_a)), F.radians(_c(lat_b))
    half = lambda x: F.pow(F.sin(x / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(half(b - a) + F.cos(a) * F.cos(b) * half(F.radians(_c(lon_b) - _c(lon_a)))))


def geo_proximity(lat_a: Text, lon_a: Text, lat_b: Text, lon_b: Text) -> Column:
    return F.exp(-geo_km(lat_a, lon_a, lat_b, lon_b) / 100)


def span_iou(a0: Text, a1: Text, b0: Text, b1: Text, hull: bool = True) -> Column:
    """Overlap of two intervals over their hull; with ``hull`` off over the
    smaller of hull and summed lengths.  Disjoint intervals score 0."""
    lo, hi = F.greatest(_c(a0), _c(b0)), F.least(_c(a1), _c(b1))
    outer = F.greatest(_c(a1), _c(b1)) - F.least(_c(a0), _c(b0))
    if not hull:
        outer = F.least(outer, _c(a1) - _c(a0) + _c(b1) - _c(b0))
    return F.when(outer > 0, F.greatest(hi - lo, F.lit(0.0)) / outer).otherwise(F.when(outer.isNotNull(), 0.0))


# --- words --------------------------------------------------------------------


def token_edit(a: Text, b: Text) -> Column:
    """Edit distance of two token arrays of any length (Arrow batches: the
    built-in distance is of characters, and a step for each pair of tokens)."""

    @F.pandas_udf("int")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        pairs = zip(a, b, strict=True)
        return pd.Series([None if x is None or y is None else _edits(x.tolist(), y.tolist()) for x, y in pairs], dtype="Int32")

    return run(_c(a), _c(b))


#: Letters stay, all else is a space: every byte of a character beyond ASCII is too.
_LETTERS = bytes(c if 97 <= c <= 122 else 32 for c in range(256))


def word_edit(a: Text, b: Text) -> Column:
    """``distance, a, b``: edit distance of the words of two texts (runs of the
    letters a to z once lowered) and the numbers of words; null for null texts.
    Arrow batches: the texts go over, since arrays of their words cost more
    than the distances."""

    @F.arrow_udf("distance int, a int, b int")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        found = []
        for x, y in zip(a.cast(pa.large_binary()), b.cast(pa.large_binary()), strict=True):
            if x.is_valid and y.is_valid:
                x, y = (t.as_py().translate(_LETTERS).split() for t in (x, y))
                found.append((_edits(x, y), len(x), len(y)))
            else:
                found.append((None, None, None))
        names = ["distance", "a", "b"]
        return pa.StructArray.from_arrays([pa.array([f[k] for f in found], pa.int32()) for k in range(3)], names)

    return run(F.lower(_c(a)), F.lower(_c(b)))


def mixed_error_rate(edit: Text) -> Column:
    """Distance of ``word_edit`` over the longer text's words."""
    n = F.greatest(_c(edit)["a"], _c(edit)["b"])
    return F.when(n == 0, 0.0).otherwise(_c(edit)["distance"] / n)


def ngrams(tokens: Text, n: Column | int) -> Column:
    """Array of all runs of ``n`` tokens, each joined by spaces."""
    t, n = _c(tokens), n if isinstance(n, Column) else F.lit(n)
    last = F.size(t) - n
    empty = F.array().cast("array<string>")
    return F.when((last < 0) | (n < 1), empty).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(0)) + 1), lambda k: F.array_join(F.slice(t, k, n), " "))
    )


# fixed values: what marks a refusal, the third in any case
REFUSALS = ("I can't", "I cannot", "sorry", "无法", "抱歉")


#: Places where a text and its hidden text have four characters in common that are looked at at once, about.
SPAN_CELLS = 1 << 22
#: Characters in runs of words that are stepped at once, about.
SPAN_LETTERS = 1 << 21
#: Common runs from this length on are listed; shorter ones are met in passing.
LISTED_FROM = 4
#: Hidden texts from this length on are left to difflib.
LONG_FROM = 1 << 11
#: From this length on difflib takes frequent characters for junk.
JUNK_FROM = 200


def _runs_table(text: np.ndarray, hidden: np.ndarray) -> np.ndarray:
    """Length of the longest common run that ends at each pair of places (of fewer than 256)."""
    out = np.zeros((len(hidden), len(text)), np.uint8)
    for j, c in enumerate(hidden):
        if j:
            np.add(out[j - 1, :-1], 1, out=out[j, 1:])
        out[j, 0] = 1
        if not j:
            out[j] = 1
        out[j] *= text == c
    return np.ascontiguousarray(out.T)


_STEPS = np.arange(1, 256, dtype=np.uint8)


def _blocks(table: np.ndarray, text: np.ndarray, hidden: np.ndarray, least) -> int | None:
    """Characters of the matching blocks that difflib finds in a table of
    common runs: the longest run, the first of equal ones, then the same on
    both sides of it.  ``text`` and ``hidden`` count their letters up to each
    place.  ``least(most)`` says if so many characters would be too few; None
    as soon as all that can still match are too few.  The plain form of
    ``_matched``, for one pair."""
    most = lambda a, b, c, d: int(np.minimum(text[b] - text[a], hidden[d] - hidden[c]).sum())
    whole = (0, table.shape[0], 0, table.shape[1])
    todo, matched, open_ = [(most(*whole), *whole)], 0, most(*whole)
    while todo:
        held, a, b, c, d = todo.pop(todo.index(max(todo)))
        part = table[a:b, c:d]
        if a:
            upto = min(b - a, len(_STEPS))
            part = np.concatenate([np.minimum(part[:upto], _STEPS[:upto, None]), part[upto:]]) if upto < b - a else np.minimum(part, _STEPS[:upto, None])
        if c:
            part = np.minimum(part, _STEPS[: d - c])
        i, j = divmod(int(part.argmax()), d - c)
        size = int(part[i, j])
        open_ -= held
        matched += size
        i, j = a + i + 1, c + j + 1
        for side in ((a, i - size, c, j - size), (i, b, j, d)) if size else ():
            if side[0] < side[1] and side[2] < side[3] and (can := most(*side)):
                open_ += can
                todo.append((can, *side))
        if least(matched + open_):
            return None
    return matched


def _codes(t: str) -> np.ndarray:
    return np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4")


def _grams_of(text: np.ndarray, hidden: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For 1 to ``LISTED_FROM`` characters: which different run of so many of
    the hidden text begins at each place of it, and at each place of the text
    (if none, one more than there are)."""
    kinds, kind = np.unique(hidden, return_inverse=True)
    number = np.full(int(max(text.max(), hidden.max())) + 1, len(kinds), np.uint16)
    number[kinds] = np.arange(len(kinds))
    own, of_text = [kind], [number[text].astype(np.int64)]
    for k in range(2, LISTED_FROM + 1):
        if len(hidden) < k or len(text) < k:
            break
        wide, known = len(kinds) + 1, int(own[-1].max()) + 1
        code = own[-1][: len(hidden) - k + 1] * wide + kind[k - 1 :]
        different, at = np.unique(code, return_inverse=True)
        found = np.full((known + 1) * wide, len(different), np.int64)
        found[different] = np.arange(len(different))
        own.append(at)
        of_text.append(found[of_text[-1][: len(text) - k + 1] * wide + of_text[0][k - 1 :]])
    return own, of_text


def _common_runs(text: np.ndarray, hidden: np.ndarray, of_text: np.ndarray, own: np.ndarray, k: int, junk: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place in the text, place in the hidden text and length of each common
    run of ``k`` characters or more, none of them ``junk``, that no longer one
    holds, from the runs of k that begin at each place of both."""
    n, order, many = len(text), np.argsort(own, kind="stable"), np.append(np.bincount(own), 0)
    starts = np.cumsum(many) - many
    if k == 1:
        many = np.where(junk, 0, many)
    rows = np.flatnonzero(many[of_text])
    times = many[of_text[rows]]
    outer, inner = np.concatenate([[-1], np.where(junk[text], -1, text), [-1]]), np.concatenate([[-2], np.where(junk[hidden], -2, hidden), [-2]])
    found: tuple[list, list] = ([], [])
    pieces = np.cumsum(times) // SPAN_CELLS if SPAN_CELLS else np.arange(len(rows))
    edges = [0, *(np.flatnonzero(np.diff(pieces)) + 1).tolist(), len(rows)]
    for low, high in zip(edges, edges[1:], strict=False):
        some, at = times[low:high], rows[low:high]
        i = np.repeat(at, some)
        j = order[np.arange(len(i)) + np.repeat(starts[of_text[at]] - (np.cumsum(some) - some), some)]
        for out, edge in zip(found, (outer[i] != inner[j], outer[i + k + 1] != inner[j + k + 1]), strict=True):
            out.append(((j - i + n) * (n + 1) + i)[edge])  # by diagonal, then by row
    first, last = (np.sort(np.concatenate(x)) for x in found)
    i = first % (n + 1)
    return i, first // (n + 1) - n + i, last - first + k


class _Tried(NamedTuple):
    """Runs of words of one text (``at``: which) that are held against its
    hidden text of ``width``, their characters, the long common runs in them,
    and the rows of ``ahead``, of 1, 2, ... characters, for each character of
    the text: where in the hidden text what begins there comes next."""

    at: np.ndarray
    low: np.ndarray
    high: np.ndarray
    of: np.ndarray
    row: np.ndarray
    column: np.ndarray
    length: np.ndarray
    table: np.ndarray
    ahead: np.ndarray
    width: int


def _matched(batch: list[_Tried], junk: bool) -> np.ndarray:
    """Characters of the matching blocks that difflib finds for each run of
    words of ``batch``, all runs in steps: of each part of each run the longest
    common run, the first of equal ones, then the same on both sides of it.

    Long common runs are listed.  In a part without one of more than k
    characters those of k are taken in order of the text, each at its next
    place: what lies before it has none of k.  With ``junk`` all runs without
    junk are listed; the longest one, or none at the beginning of the part,
    grows on both sides by whatever is equal there.
    """
    least = 1 if junk else LISTED_FROM
    shift = lambda x: np.cumsum([0, *x])[:-1]
    rows_of, runs_of, tables_of = (shift([f(x) for x in batch]) for f in (lambda x: x.table.shape[1], lambda x: len(x.at), lambda x: len(x.ahead)))
    join = lambda f: np.concatenate([f(k, x) for k, x in enumerate(batch)], axis=-1)
    low, high, width = join(lambda k, x: x.low + rows_of[k]), join(lambda k, x: x.high + rows_of[k]), np.repeat([x.width for x in batch], [len(x.at) for x in batch])
    ahead, table = join(lambda k, x: x.ahead), join(lambda k, x: tables_of[k] + x.table)
    part, row, column, length = join(lambda k, x: x.of + runs_of[k]), join(lambda k, x: x.row + rows_of[k]), join(lambda k, x: x.column), join(lambda k, x: x.length)
    whose, a, b, c, d = np.arange(len(low)), low, high, np.zeros(len(low), np.int64), width
    matched, left, last = np.zeros(len(low), np.int64), [], (1 << 36) - 1
    while len(whose):
        best = np.zeros(len(whose), np.int64)
        np.maximum.at(best, part, (length << 48) + ((last - (row - low[whose[part]])) << 12) + 4095 - column)
        size, i, j = best >> 48, last - (best >> 12 & last) + low[whose], 4095 - (best & 4095)
        if junk:
            i, j = np.where(size, i, a), np.where(size, j, c)
            for side in (-1, 1):
                more = np.arange(len(whose))
                while len(more):
                    y, x = (i[more] - 1, j[more] - 1) if side < 0 else (i[more] + size[more], j[more] + size[more])
                    can = (y >= a[more]) & (y < b[more]) & (x >= c[more]) & (x < d[more])
                    more, y, x = more[can], y[can], x[can]
                    more = more[ahead[table[0, y] + x] == x]
                    size[more] += 1
                    if side < 0:
                        i[more] -= 1
                        j[more] -= 1
        else:
            left.append([x[size == 0] for x in (whose, a, b, c, d)])
        split = np.flatnonzero(size)
        size, i, j = size[split], i[split], j[split]
        np.add.at(matched, whose[split], size)
        new = np.zeros(len(whose), np.int64)
        new[split] = np.arange(len(split))
        part = new[part]  # a part with a listed run has been split
        fit = np.minimum(length, np.minimum(i[part] - row, j[part] - column))
        gone = np.maximum(np.maximum(i[part] + size[part] - row, j[part] + size[part] - column), 0)
        before, after = np.flatnonzero(fit >= least), np.flatnonzero(length - gone >= least)
        part, row, column, length = (np.concatenate(x) for x in ((part[before], part[after] + len(split)), (row[before], (row + gone)[after]), (column[before], (column + gone)[after]), (fit[before], (length - gone)[after])))
        whose, a, b, c, d = (np.concatenate(x) for x in ((whose[split],) * 2, (a[split], i + size), (i, b[split]), (c[split], j + size), (j, d[split])))
    for k in () if junk else range(LISTED_FROM - 1, 0, -1):
        whose, a, b, c, d = (np.concatenate(x) for x in zip(*left, strict=True)) if left else np.zeros((5, 0), np.int64)
        at, left = a, []
        while len(whose):
            open_ = (at + k <= b) & (c + k <= d)
            shut = ~open_ & (a < b) & (c < d)
            left.append([x[shut] for x in (whose, a, b, c, d)])
            whose, a, b, c, d, at = (x[open_] for x in (whose, a, b, c, d, at))
            next_ = ahead[table[k - 1, at] + c]
            hit = next_ + k <= d
            np.add.at(matched, whose[hit], k)
            if k > 1:
                left.append([whose[hit], a[hit], at[hit], c[hit], next_[hit]])
            at = at + np.where(hit, k, 1)
            a, c = np.where(hit, at, a), np.where(hit, next_ + k, c)
    return matched


def _tried(words: list[str], gold: list[str], hidden: str) -> Iterator[_Tried]:
    """The runs of words with a word of the hidden text, in order, in pieces of about ``SPAN_LETTERS`` characters."""
    n, runs, known = len(gold), len(words) - len(gold) + 1, set(gold)
    hits = np.concatenate([[0], np.cumsum(np.fromiter(map(known.__contains__, words), np.int64, len(words)))])
    at = np.flatnonzero(hits[n:] > hits[:runs])
    starts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)])
    low, high = starts[at], starts[at + n] - 1
    letters, sought = _codes(" ".join(words)), _codes(hidden)
    width = len(sought)
    own, of_text = _grams_of(letters, sought)
    times = np.append(np.bincount(own[0]), 0)
    junk = times > (width // 100 + 1 if width >= JUNK_FROM else width)  # as difflib has it
    least = 1 if width >= JUNK_FROM else LISTED_FROM
    table, tables, filled = np.zeros((LISTED_FROM - 1, len(letters)), np.int64), [], 0
    for k in range(LISTED_FROM - 1):
        here, rows = (own[k], of_text[k]) if k < len(own) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        none = int(here.max(initial=-1)) + 1
        ahead = np.full((none + 1, width + 1), width)
        ahead[here, np.arange(len(here))] = np.arange(len(here))
        tables.append(np.minimum.accumulate(ahead[:, ::-1], axis=1)[:, ::-1].ravel())
        table[k] = filled + none * (width + 1)
        table[k, : len(rows)] = filled + rows * (width + 1)
        filled += len(tables[-1])
    ahead, none = np.concatenate(tables), np.zeros(0, np.int64)
    i, j, length = _common_runs(of_text[0], own[0], of_text[least - 1], own[least - 1], least, junk) if len(own) >= least else (none, none, none)
    first, last = np.searchsorted(high, i + least), np.searchsorted(low, i + length - least, "right")
    many = np.cumsum(np.bincount(first, minlength=len(at) + 1) - np.bincount(np.maximum(last, first), minlength=len(at) + 1))[:-1]
    edges = [0, *(np.flatnonzero(np.diff(np.cumsum(high - low + many) // SPAN_LETTERS)) + 1).tolist(), len(at)]
    for p, q in zip(edges, edges[1:], strict=False):
        one, end = np.clip(first, p, q), np.clip(last, p, q)
        times = np.maximum(end - one, 0)
        run = np.repeat(np.arange(len(i)), times)
        of = np.arange(len(run)) + np.repeat(one - (np.cumsum(times) - times), times)
        gone = np.maximum(low[of] - i[run], 0)
        size = np.minimum(i[run] + length[run], high[of]) - i[run] - gone
        base, upto = int(low[p]), int(high[q - 1])
        yield _Tried(at[p:q], low[p:q] - base, high[p:q] - base, of - p, i[run] + gone - base, j[run] + gone, size, table[:, base:upto], ahead, width)


def _long_span(words: list[str], gold: list[str], hidden: str) -> tuple[float, int]:
    """Largest ratio and its place for very long hidden texts, run by run."""
    import difflib

    n, known, letters = len(gold), set(gold), Counter(hidden)
    matcher, best, first = difflib.SequenceMatcher(None, "", hidden), 0.0, -1
    tried = []
    for at in range(len(words) - n + 1):
        run = words[at : at + n]
        if known.intersection(run):
            text = " ".join(run)
            tried.append((-2.0 * sum((Counter(text) & letters).values()) / (len(text) + len(hidden)), at, text))
    for bound, at, text in sorted(tried):
        if -bound < best:
            break
        matcher.set_seq1(text)
        ratio = matcher.ratio()
        if ratio > best or (ratio == best > 0 and at < first):
            best, first = ratio, at
    return best, first


def _spans(pairs: list[tuple[str, str]]) -> list[tuple[float, list[str]]]:
    """Similarity and words of the run of predicted words, as many as the
    hidden text has, whose matching-blocks ratio to that text is largest, the
    first of equal ones; only runs with a word of the text are looked at.

    Runs of many texts are held against their hidden texts together; their
    common runs of characters are looked up once for each text.
    """
    out: list[tuple[float, list[str]]] = [(0.0, [])] * len(pairs)
    waiting: dict[bool, list[tuple[int, _Tried]]] = {False: [], True: []}
    held = {False: 0, True: 0}
    best: dict[int, tuple[float, int]] = {}

    def step(junk: bool) -> None:
        found, at = _matched([x for _, x in waiting[junk]], junk), 0
        for k, x in waiting[junk]:
            ratios = 2.0 * found[at : at + len(x.at)] / (x.high - x.low + x.width)
            at += len(x.at)
            top = int(ratios.argmax())
            if ratios[top] > best.get(k, (0.0, -1))[0]:
                best[k] = float(ratios[top]), int(x.at[top])
        waiting[junk].clear()
        held[junk] = 0

    for k, (pred, hidden) in enumerate(pairs):
        words, gold = pred.split(), hidden.split()
        if not gold or len(words) < len(gold) or set(gold).isdisjoint(words):
            continue
        if len(hidden) >= LONG_FROM:
            best[k] = _long_span(words, gold, hidden)
            continue
        for x in _tried(words, gold, hidden):
            junk = len(hidden) >= JUNK_FROM
            waiting[junk].append((k, x))
            held[junk] += int((x.high - x.low).sum()) + len(x.of) + len(x.ahead) + x.table.shape[1]
            if held[junk] >= SPAN_LETTERS:
                step(junk)
    for junk in waiting:
        if waiting[junk]:
            step(junk)
    for k, (ratio, at) in best.items():
        if ratio > 0:
            words = pairs[k][0].split()
            out[k] = ratio, words[at : at + len(pairs[k][1].split())]
    return out


def _span(pred: str, hidden: str) -> tuple[float, list[str]]:
    return _spans([(pred, hidden)])[0]


def hidden_span(pred: Text, hidden: Text) -> Column:
    """Struct similarity, span, precision, recall, f1, jaccard, rouge1, exact
    of the run of predicted words nearest to the hidden text (Arrow batches).

    Precision, recall and the rest are of the sets of words, ``rouge1`` of the
    bags, ``exact`` compares the run with the hidden words.  A refusal, a
    prediction of fewer words than the text and one without a common word score
    0.  Null if either is null.
    """
    fields = "similarity double, span string, precision double, recall double, f1 double, jaccard double, rouge1 double, exact double"

    refused = lambda p: any(x in p for x in REFUSALS) or "sorry" in p.lower()

    def score(p: str | None, h: str | None, ratio: float, run: list[str]) -> tuple:
        if p is None or h is None:
            return (None,) * 8
        if not run:
            return (0.0, "", 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)
        gold = h.split()
        a, b = set(run), set(gold)
        n, bag = len(a & b), sum((Counter(run) & Counter(gold)).values())
        return (ratio, " ".join(run), n / len(a), n / len(b), 2 * n / (len(a) + len(b)), n / len(a | b), bag / len(gold), float(run == gold))

    @F.pandas_udf(fields)
    def run(p: pd.Series, h: pd.Series) -> pd.DataFrame:
        spans = _spans([("", "") if x is None or y is None or refused(x) else (x, y) for x, y in zip(p, h, strict=True)])
        return pd.DataFrame([score(x, y, *z) for x, y, z in zip(p, h, spans, strict=True)], columns=[f.split()[0] for f in fields.split(", ")])

    return run(_c(pred), _c(hidden))


def cosine(a: Text, b: Text) -> Column:
    """Cosine similarity of two vectors; null for a zero vector."""
    dot = lambda x, y: _sum(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")))
    size = F.sqrt(dot(_c(a), _c(a))) * F.sqrt(dot(_c(b), _c(b)))
    return dot(_c(a), _c(b)) / F.when(size > 0, size)


def any_target(pred: Text, targets: Text) -> Column:
    return F.exists(_c(targets), lambda t: t == _c(pred)).cast("double")


def best_of(references: Text, metric) -> Column:
    """Largest value of ``metric(reference)``."""
    return F.array_max(F.transform(_c(references), metric))


def count_answer(pred: Text, gold: Text) -> Column:
    """1 if the first whole number of the response is the gold count."""
    return F.coalesce((nullif_empty(F.regexp_extract(_c(pred), r"\d+", 0)).try_cast("long") == _c(gold)).cast("double"), F.lit(0.0))


def contains_answer(pred: Text, gold: Text) -> Column:
    return F.lower(_c(pred)).contains(F.lower(_c(gold))).cast("double")


# --- instructions, captions, formats -------------------------------------------

def _part(argument: Column, k: int) -> Column:
    return F.split_part(argument, F.lit("|"), F.lit(k))


def _relation(count: Column, argument: Column) -> Column:
    """Whether a count is less than, or at least, the number that ends the argument."""
    parts = F.split(argument, r"\|")
    n, name = F.element_at(parts, -1).cast("int"), F.element_at(parts, -2)
    return F.when(name == "less than", count < n).otherwise(count >= n)


def _blank(x: Column) -> Column:
    return F.trim(x, F.lit(" \n\t\r")) == ""


def _parted(parts: Column, n: Column) -> Column:
    """As many parts as wanted; only the first and the last may be blank."""
    inner = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0)))
    return ~F.exists(inner, _blank) & (F.size(F.filter(parts, lambda p: ~_blank(p))) == n)


def _two(parts: Column) -> Column:
    """Two different answers; only the first and the last part may be blank."""
    full = F.transform(F.filter(parts, lambda p: ~_blank(p)), lambda p: F.trim(p, F.lit(" \n\t\r")))
    return _parted(parts, F.lit(2)) & (F.get(full, F.lit(0)) != F.get(full, F.lit(1)))


def _first_word(paragraphs: Column, argument: Column) -> Column:
    """``n|k|word``: n paragraphs, the k-th of which begins with the word."""
    own = F.trim(F.get(paragraphs, _part(argument, 2).cast("int") - 1), F.lit(" \n\t\r"))
    word = F.lower(F.regexp_extract(own, r"""^['"]*([^\s.,?!'"]*)""", 1))
    return (F.size(paragraphs) == _part(argument, 1).cast("int")) & F.coalesce(word == F.lower(_part(argument, 3)), F.lit(False))


#: Checks of instructions: name to a function of the response and an argument.
CHECKS = {
    "min_words": lambda r, a: F.size(F.filter(F.split(r, r"\s+"), lambda w: w != "")) >= a.cast("int"),
    "max_words": lambda r, a: F.size(F.filter(F.split(r, r"\s+"), lambda w: w != "")) <= a.cast("int"),
    "has_word": lambda r, a: F.lower(r).contains(F.lower(a)),
    "no_word": lambda r, a: ~F.lower(r).contains(F.lower(a)),
    "lower_case": lambda r, a: r == F.lower(r),
    "upper_case": lambda r, a: r == F.upper(r),
    "no_comma": lambda r, a: ~r.contains(","),
    "ends_with": lambda r, a: F.trim(r).endswith(a),
    "quoted": lambda r, a: F.trim(r).rlike(r'(?s)^".*"$'),
    "bullets": lambda r, a: F.regexp_count(r, F.lit(r"(?m)^\s*[*-]\s")) == a.cast("int"),
    "json": lambda r, a: F.try_parse_json(F.regexp_replace(F.trim(r), r"(?i)^```(json)?|```$", "")).isNotNull(),
    # arguments of several parts are joined by |; a relation is "less than" or "at least"
    "keywords": lambda r, a: F.forall(F.split(a, r"\|"), lambda w: F.lower(r).contains(F.lower(w))),
    "keyword_count": lambda r, a: _relation(F.regexp_count(r, F.concat(F.lit("(?i)"), _part(a, 1))), a),
    "forbidden": lambda r, a: ~F.exists(F.split(a, r"\|"), lambda w: F.regexp(r, F.concat(F.lit(r"(?i)(?U)\b"), w, F.lit(r"\b")))),
    "letter_count": lambda r, a: _relation(F.regexp_count(F.lower(r), F.lower(_part(a, 1))), a),
    "sentences": lambda r, a: _relation(F.regexp_count(F.trim(r), F.lit(r"[.!?]+(?=\s|$)|[^.!?\s]\s*$")), a),
    "words": lambda r, a: _relation(F.regexp_count(r, F.lit(r"(?U)\w+")), a),
    "paragraphs": lambda r, a: _parted(F.split(r, r"\s?\*\*\*\s?", -1), a.cast("int")),
    "paragraph_start": lambda r, a: _first_word(F.filter(F.split(r, r"\n\n", -1), lambda p: F.trim(p, F.lit(" \n\t\r")) != ""), a),
    "placeholders": lambda r, a: F.regexp_count(r, F.lit(r"\[.*?\]")) >= a.cast("int"),
    "postscript": lambda r, a: F.lower(r).rlike(r"p\.\s?s\."),
    "second_postscript": lambda r, a: F.lower(r).rlike(r"p\.\s?p\.\s?s"),
    "bullet_lines": lambda r, a: F.regexp_count(r, F.lit(r"(?m)^\s*\*[^\*].*$")) + F.regexp_count(r, F.lit(r"(?m)^\s*-.*$")) == a.cast("int"),
    "options": lambda r, a: F.exists(F.split(a, r"\|"), lambda w: F.trim(r).contains(w)),
    "highlights": lambda r, a: F.regexp_count(r, F.lit(r"\*[^\n\*]*[^\n\*\s][^\n\*]*\*")) >= a.cast("int"),
    "sections": lambda r, a: F.regexp_count(r, F.concat(_part(a, 1), F.lit(r"\s?\d+"))) >= _part(a, 2).cast("int"),
    "title": lambda r, a: F.exists(F.regexp_extract_all(r, F.lit(r"<<[^\n]+>>"), 0), lambda t: F.trim(F.trim(t, F.lit("<>"))) != ""),
    "two_responses": lambda r, a: _two(F.split(r, r"\*{6}", -1)),
    "repeats_prompt": lambda r, a: F.startswith(F.lower(F.trim(r)), F.lower(F.trim(a))),
    "ends_phrase": lambda r, a: F.endswith(F.lower(F.trim(F.trim(r), F.lit('"'))), F.lower(F.trim(a))),
    "capital_words": lambda r, a: _relation(F.regexp_count(r, F.lit(r"(?U)(?<!\S)[^\p{Ll}\s]*\p{Lu}[^\p{Ll}\s]*(?!\S)")), a),
}


def follows(check: Text, response: Text, argument: Text) -> Column:
    """Whether a response passes the named check; null for an unknown name."""
    r, a = _c(response), _c(argument)
    out = F.lit(None).cast("boolean")
    for name, test in CHECKS.items():
        out = F.when(_c(check) == name, F.coalesce(test(r, a), F.lit(False))).otherwise(out)
    return out


def loose_variants(response: Text) -> Column:
    """The response with and without its first line, last line and asterisks."""
    r = _c(response)
    lines = F.split(r, "\n")
    n = F.size(lines)
    cut = lambda a, b: F.trim(F.array_join(F.slice(lines, F.lit(1 + a), F.greatest(n - a - b, F.lit(0))), "\n"))
    forms = [r, cut(1, 0), cut(0, 1), cut(1, 1)]
    return F.array(*forms, *(F.replace(f, F.lit("*"), F.lit("")) for f in forms))


def follows_loosely(check: Text, response: Text, argument: Text) -> Column:
    """Whether any variant of the response passes."""
    return F.exists(loose_variants(response), lambda v: (F.length(v) > 0) & F.coalesce(follows(check, v, argument), F.lit(False)))


def format_score(x: Text) -> Column:
    """1 for think and answer tags or a boxed answer, 0.8 for a formula and
    the word answer, else 0."""
    tags = _c(x).rlike(r"(?s)<think>.*</think>\s*<answer>.*</answer>")
    return (
        F.when(tags, 1.0).when(_c(x).rlike(r"\\boxed\{"), 1.0).when(_c(x).rlike(r"\$[^$]+\$") & F.lower(_c(x)).contains("answer"), 0.8).otherwise(0.0)
    )


def loose_text(pred: Text, gold: Text) -> Column:
    """1 if the texts are equal, one holds the other, or the first letters agree."""
    p, g = F.lower(F.trim(_c(pred))), F.lower(F.trim(_c(gold)))
    return ((p == g) | ((g != "") & p.contains(g)) | ((p != "") & (F.left(p, F.lit(1)) == F.left(g, F.lit(1))))).cast("double")


def view_change_error(pred: Text, gold: Text) -> Column:
    """Distance of two (x, y, depth) arrays."""
    square = lambda k: F.pow(_c(pred)[k] - _c(gold)[k], 2)
    return F.sqrt(square(0) + square(1) + square(2))


def rouge_l(pred: Text, refs: Text, beta: float = 1.2) -> Column:
    """ROUGE-L of a token array against an array of references: the largest
    precision and the largest recall over them (Arrow batches); 0 without a
    common token, null without a prediction or references."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        def score(x, refs) -> float | None:
            if x is None or refs is None:
                return None
            found = [(_common(list(x), list(y)), len(y)) for y in refs if y is not None]
            if not found:
                return None
            p, r = max(n for n, _ in found) / max(len(x), 1), max(n / max(m, 1) for n, m in found)
            return (1 + beta**2) * p * r / (r + beta**2 * p) if p and r else 0.0

        return pd.Series([score(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return run(_c(pred), _c(refs))


def lcs_f(pred: Text, gold: Text, beta: float = 1.2) -> Column:
    """ROUGE-L of two token arrays (Arrow batches: one integer per row of the table)."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        def score(x, y) -> float | None:
            if x is None or y is None:
                return None
            n = _common(list(x), list(y))
            if not n:
                return 0.0
            p, r = n / len(x), n / len(y)
            return (1 + beta**2) * p * r / (r + beta**2 * p)

        return pd.Series([score(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return run(_c(pred), _c(gold))
