"""Static binary-fuse filters (8-bit fingerprints, three places a key), built and probed with whole-array operations.

A filter is immutable: it is built once from the distinct 64-bit keys of a snapshot
and takes about 9 bits a key; it never denies a key that it was built from and wrongly
admits about one other key in 256.
"""

from __future__ import annotations

import math
import struct

import numpy as np

_HEAD = struct.Struct("<QIII")
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    h = keys + np.uint64(seed)
    h ^= h >> np.uint64(33)
    h *= _M1
    h ^= h >> np.uint64(33)
    h *= _M2
    h ^= h >> np.uint64(33)
    return h


def _shape(n: int) -> tuple[int, int]:
    """Segment length (a power of two) and number of start segments for ``n`` keys."""
    seg = 4 if n < 2 else 1 << int(math.floor(math.log(n) / math.log(3.33) + 2.25))
    seg = min(seg, 1 << 18)
    factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))
    size = max(n * factor, 1)
    return seg, max(1, math.ceil(size / seg) - 2)


def _places(h: np.ndarray, seg: int, count: int) -> np.ndarray:
    """Three places a key, in neighbouring segments."""
    start = ((h >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)
    mask = np.uint64(seg - 1)
    out = np.empty((3, len(h)), np.int64)
    for j, shift in enumerate((0, 18, 36)):
        out[j] = ((start + np.uint64(j)) * np.uint64(seg) + ((h >> np.uint64(shift)) & mask)).astype(np.int64)
    return out


def _print(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> np.uint64(32))) & np.uint64(0xFF)).astype(np.uint8)


def build(keys: np.ndarray) -> bytes:
    """A filter over ``keys`` (any 64-bit integers; repeats count once)."""
    keys = np.unique(np.asarray(keys).astype(np.int64).view(np.uint64))
    n = len(keys)
    seg, count = _shape(n)
    for attempt in range(1, 200):
        if attempt % 20 == 0:
            count += max(1, count // 10)
        seed = (attempt * 0x9E3779B97F4A7C15) & (2**64 - 1)
        h = _mix(keys, seed)
        places, size = _places(h, seg, count), (count + 2) * seg
        order = _peel(places, size, n)
        if order is not None:
            break
    else:
        raise RuntimeError("no binary-fuse filter found")
    table, fp = np.zeros(size, np.uint8), _print(h)
    for ks, own in reversed(order):  # no key of a round touches the place of another, so a round is one assignment
        p = places[:, ks]
        rest = table[p[0]] ^ table[p[1]] ^ table[p[2]] ^ table[own]
        table[own] = fp[ks] ^ rest
    return _HEAD.pack(seed, seg, count, n) + table.tobytes()


def _peel(places: np.ndarray, size: int, n: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """Rounds of (keys, place that only this key still has); None if some keys stay."""
    deg = np.bincount(places.ravel(), minlength=size)
    keysum = np.zeros(size, np.int64)
    ids = np.arange(n, dtype=np.int64)
    for row in places:
        np.bitwise_xor.at(keysum, row, ids)
    order, done = [], 0
    cand = np.flatnonzero(deg == 1)
    while len(cand):
        ks, first = np.unique(keysum[cand], return_index=True)
        own = cand[first]
        order.append((ks, own))
        done += len(ks)
        touched = places[:, ks].ravel()
        np.subtract.at(deg, touched, 1)
        np.bitwise_xor.at(keysum, touched, np.tile(ks, 3))
        touched = np.unique(touched)
        cand = touched[deg[touched] == 1]
    return order if done == n else None


def contains(blob: bytes, keys: np.ndarray) -> np.ndarray:
    """Which ``keys`` the filter admits."""
    seed, seg, count, n = _HEAD.unpack_from(blob)
    if not n:
        return np.zeros(len(keys), bool)
    table = np.frombuffer(blob, np.uint8, offset=_HEAD.size)
    h = _mix(np.asarray(keys).astype(np.int64).view(np.uint64), seed)
    p = _places(h, seg, count)
    return (table[p[0]] ^ table[p[1]] ^ table[p[2]]) == _print(h)
