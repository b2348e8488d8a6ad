"""Finding where a text may repeat another: anchors and the runs of windows they own.

Of the K-byte grams in a window of 200 bytes the one with the least hash is the
window's anchor. Equal windows have equal anchors, so only windows whose anchor
occurs twice or more can repeat; adjacent windows with one anchor form a run.
"""

from __future__ import annotations

import functools

import numpy as np

#: Bytes of a repeat, of an anchor, and of a stretch that is worked on at once.
WINDOW, GRAM, STRETCH = 200, 50, 1 << 22

_BASE, _MIX = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64((1 << 24) - 1)
_BYTES = np.random.default_rng(3).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    return tuple(np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, b, np.uint64)])) for b in (_BASE, inverse))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, by doubling."""
    done = 1
    while 2 * done <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (width - done)], x[width - done :]) if done < width else x


def runs(raw: bytes) -> tuple[np.ndarray, ...]:
    """anchor hash, run hash, first window start, number of starts and anchor's place in the run, of each run."""
    found = [_stretch(np.frombuffer(raw[at : at + STRETCH + WINDOW - 1], np.uint8), at) for at in range(0, max(0, len(raw) - WINDOW + 1), STRETCH)]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int32)
    return tuple(map(np.concatenate, zip(*found, strict=True)))


def _stretch(b: np.ndarray, at: int) -> tuple[np.ndarray, ...]:
    n = len(b)
    size = 1 << max(12, n.bit_length())
    power, inverse = _powers(size)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTES[b] * power[:n], dtype=np.uint64)])
    gram = _mixed((sums[GRAM:] - sums[:-GRAM]) * inverse[: n - GRAM + 1])
    owner = (_sliding_least(gram & ~_LOW | np.arange(len(gram), dtype=np.uint64), WINDOW - GRAM + 1) & _LOW).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1])
    count = np.diff(np.append(first, len(owner)))
    place = owner[first] - first
    text = _mixed((sums[first + count - 1 + WINDOW] - sums[first]) * inverse[first])
    run = _mixed(text ^ _mixed((place.astype(np.uint64) << np.uint64(32)) + count.astype(np.uint64)))
    return gram[owner[first]].view(np.int64), run.view(np.int64), (first + at).astype(np.int32), count.astype(np.int32), place.astype(np.int32)
