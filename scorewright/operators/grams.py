"""N-grams of token arrays as hashes, counted over a table in packed rows.

An n-gram is a 64-bit hash of its words' hashes.  Of n distinct n-grams in a
table, each shares its hash with another with a probability of n / 2^64.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash

_TIMES = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(29)
#: Masks for the first bytes of eight.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_LONG = 64


def _mixed(now: np.ndarray) -> np.ndarray:
    """A different number for each (steps of MurmurHash3's end)."""
    now ^= now >> np.uint64(33)
    now *= np.uint64(0xFF51AFD7ED558CCD)
    now ^= now >> np.uint64(33)
    now *= np.uint64(0xC4CEB9FE1A85EC53)
    now ^= now >> np.uint64(33)
    return now


def word_hashes(words: pa.Array) -> np.ndarray:
    """A hash of each word: eight of its bytes at a time, of all words at
    once; of one of more than ``_LONG`` bytes, XXH64."""
    n, data = len(words), words.cast(pa.large_binary())
    if not n or not data.buffers()[2]:
        lengths, starts, flat = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(8, np.uint8)
    else:
        edges = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + n + 1]
        lengths, starts = np.diff(edges), edges[:-1]
        flat = np.concatenate([np.frombuffer(data.buffers()[2], np.uint8), np.zeros(8, np.uint8)])
    eight = np.ndarray((len(flat) - 7,), "<u8", flat, strides=(1,))
    now = lengths.astype(np.uint64) * _TIMES
    todo = np.arange(n)
    for at in range(0, _LONG, 8):
        todo = todo[lengths[todo] > at] if at else todo
        now[todo] = _mixed(now[todo] ^ (eight[starts[todo] + at if n else starts] & _FIRST[np.minimum(lengths[todo] - at, 8)]))
        if not len(todo):
            break
    for k in np.flatnonzero(lengths > _LONG).tolist():
        now[k] = xxhash.xxh64_intdigest(flat[starts[k] : starts[k] + lengths[k]].tobytes(), 42)
    if words.null_count:
        now[words.is_null().to_numpy(zero_copy_only=False)] = xxhash.xxh64_intdigest(b"\xff", 42)
    return now


def by_order(words: pa.Array, lengths: np.ndarray, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For orders 1 to ``most`` of lists that lie one after the other in
    ``words``: the n-gram from each place on, and which places have one in their list."""
    first = word_hashes(words)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(first))
    out, now = [(first, np.ones(len(first), bool))], first
    for n in range(2, most + 1):
        now = now[:-1] * _TIMES
        now ^= now >> _SHIFT
        now += first[n - 1 : n - 1 + len(now)]
        now *= _TIMES
        now ^= now >> _SHIFT
        out.append((now, left[: len(now)] >= n))
    return out


def _packed_hashes(hashes: np.ndarray) -> bytes:
    """Sorted hashes in about two bits more each than the logarithm of their
    mean distance: low bits as they are, high ones as steps in a bitmap."""
    n = len(hashes)
    low = max(int(hashes[-1] - hashes[0]) // n, 1).bit_length() - 1
    high = (hashes >> np.uint64(low)) - (base := hashes[0] >> np.uint64(low))
    steps = np.zeros(int(high[-1]) + n, np.uint8)
    steps[high.astype(np.int64) + np.arange(n)] = 1
    whole, bits = divmod(low, 8)
    parts = np.ascontiguousarray(hashes).view(np.uint8).reshape(n, 8)
    odd = (parts[:, whole : whole + 1] >> np.arange(bits, dtype=np.uint8)) & np.uint8(1) if bits else parts[:, :0]
    return b"".join((np.array([n, low, base], np.uint64).tobytes(), parts[:, :whole].tobytes(), np.packbits(odd).tobytes(), np.packbits(steps).tobytes()))


def _unpacked_hashes(data: bytes) -> np.ndarray:
    n, low, base = np.frombuffer(data, np.uint64, 3)
    n, (whole, bits), at = int(n), divmod(int(low), 8), 24
    out = np.zeros((n, 8), np.uint8)
    out[:, :whole] = np.frombuffer(data, np.uint8, n * whole, at).reshape(n, whole)
    at += n * whole
    if bits:
        odd = np.unpackbits(np.frombuffer(data, np.uint8, (n * bits + 7) // 8, at), count=n * bits).reshape(n, bits)
        out[:, whole] = odd @ (np.uint8(1) << np.arange(bits, dtype=np.uint8))
        at += (n * bits + 7) // 8
    high = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, -1, at)))[:n] - np.arange(n)
    return out.view("<u8")[:, 0] | (high.astype(np.uint64) + base) << low


def packed_counts(counts: np.ndarray) -> bytes:
    """A byte for each count, four more for those of 255 on."""
    return zlib.compress(np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype(np.uint32).tobytes(), 1)


def unpacked_counts(data: bytes, n: int) -> np.ndarray:
    data = zlib.decompress(data)
    out = np.frombuffer(data, np.uint8, n).astype(np.uint32)
    out[out == 255] = np.frombuffer(data, np.uint32, -1, n)
    return out


def packed(hashes: np.ndarray, counts: np.ndarray, ranges: int) -> list[tuple[int, bytes, bytes]]:
    """Sorted hashes and their counts, cut into equal ranges of the hashes."""
    edges = np.searchsorted(hashes, np.array([(k << 64) // ranges for k in range(ranges)], np.uint64)).tolist() + [len(hashes)]
    return [(k, _packed_hashes(hashes[a:b]), packed_counts(counts[a:b])) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if b > a]


def unpacked(hashes: pa.ChunkedArray, counts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and counts of many packed rows, and how many each row has."""
    h = [_unpacked_hashes(x) for x in hashes.to_pylist()]
    c = [unpacked_counts(x, len(y)) for x, y in zip(counts.to_pylist(), h, strict=True)]
    return np.concatenate(h), np.concatenate(c), np.array([len(x) for x in h], np.int64)
