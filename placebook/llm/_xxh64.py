"""XXH64 of many byte ranges at once, by its published specification."""

from __future__ import annotations

import numpy as np
import xxhash

# fixed values of the specification
P1, P2, P3, P4, P5 = (np.uint64(p) for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
LONG = 512  # longer ranges are hashed one by one


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def xxh64(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """Unsigned 64-bit hashes of ``data[start:end]`` (bytes) for each pair of bounds."""
    size = end - start
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    four = np.ndarray((len(padded) - 3,), "<u4", padded, strides=(1,))
    begin = [np.uint64((seed + x) % (1 << 64)) for x in (int(P1) + int(P2), int(P2), 0, -int(P1))]
    h = np.full(len(size), (seed + int(P5)) % (1 << 64), np.uint64)
    at = start.copy()

    striped = np.flatnonzero((size >= 32) & (size < LONG))
    if len(striped):
        lanes = np.tile(np.array(begin, np.uint64)[:, None], len(striped))
        stripes = size[striped] // 32
        for k in range(int(stripes.max())):
            on = np.flatnonzero(stripes > k)
            base = start[striped[on]] + 32 * k
            for lane in range(4):
                lanes[lane, on] = _turn(lanes[lane, on] + eight[base + 8 * lane] * P2, 31) * P1
        out = _turn(lanes[0], 1) + _turn(lanes[1], 7) + _turn(lanes[2], 12) + _turn(lanes[3], 18)
        for lane in range(4):
            out = (out ^ (_turn(lanes[lane] * P2, 31) * P1)) * P1 + P4
        h[striped] = out
        at[striped] += 32 * stripes

    h += size.astype(np.uint64)
    for _ in range(3):
        on = np.flatnonzero(end - at >= 8)
        if len(on):
            h[on] = _turn(h[on] ^ (_turn(eight[at[on]] * P2, 31) * P1), 27) * P1 + P4
            at[on] += 8
    on = np.flatnonzero(end - at >= 4)
    h[on] = _turn(h[on] ^ (four[at[on]].astype(np.uint64) * P1), 23) * P2 + P3
    at[on] += 4
    for _ in range(3):
        on = np.flatnonzero(end > at)
        if len(on):
            h[on] = _turn(h[on] ^ (padded[at[on]].astype(np.uint64) * P5), 11) * P1
            at[on] += 1
    h ^= h >> np.uint64(33)
    h *= P2
    h ^= h >> np.uint64(29)
    h *= P3
    h ^= h >> np.uint64(32)
    for k in np.flatnonzero(size >= LONG):
        h[k] = xxhash.xxh64_intdigest(memoryview(padded)[start[k] : end[k]], seed)
    return h
