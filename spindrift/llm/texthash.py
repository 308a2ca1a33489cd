"""64-bit hashes of the words of many texts at once, with numpy.

Words are runs of bytes other than space and \\t-\\r, A-Z lower-cased.  A word's hash
is a polynomial over a table of random values, taken from running sums, so the cost
is a few passes over the bytes, whatever the number of words; equal words have
equal hashes wherever they stand.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BLOCK = 1 << 18
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def byte_table(seed: int = 7) -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed)) | U(1)
    values[65:91] = values[97:123]
    return values


TABLE = byte_table()
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
BASE = 0xD1342543DE82EF95


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse modulo 2**64."""
    out = []
    for b in (BASE, pow(BASE, -1, 1 << 64)):
        step = np.full(n, U(b))
        step[0] = 1
        out.append(np.multiply.accumulate(step))
    return out[0], out[1]


def words(data: np.ndarray, bounds: np.ndarray, up: np.ndarray, down: np.ndarray, head: int = 0, tail: int = 0, longer: int = 0):
    """(hashes, words a text, head hashes, tail hashes, lengths, longer head hashes) of the texts data[bounds[i]:bounds[i + 1]].

    up and down: as many powers as there are bytes and one more.  head, longer and tail: also hash each word's first and last so many bytes (whole words if shorter).
    """
    n = len(data)
    space = SPACE[data]
    first = np.ones(n + 1, bool)
    first[1:] = space[:]
    first[bounds] = True
    starts = np.flatnonzero(first[:-1] & ~space)
    last = np.ones(n + 1, bool)
    last[:-1] = space
    last[bounds] = True
    ends = np.flatnonzero(last[1:] & ~space) + 1
    sums = np.zeros(n + 1, U)
    np.cumsum(TABLE[data] * up[:n], out=sums[1:])

    def spans(a, b):
        return mix((sums[b] - sums[a]) * down[a] + (b - a).astype(U))

    counts = np.diff(np.searchsorted(starts, bounds))
    return (
        spans(starts, ends),
        counts,
        spans(starts, np.minimum(starts + head, ends)) if head else None,
        spans(np.maximum(ends - tail, starts), ends) if tail else None,
        ends - starts,
        spans(starts, np.minimum(starts + longer, ends)) if longer else None,
    )


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string array (null: empty) and the offsets of its texts."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[bounds[0] : bounds[-1]], bounds - bounds[0]


def blocks(texts: pa.Array, head: int = 0, tail: int = 0, longer: int = 0):
    """(index of the first text, what ``words`` gives) for blocks of texts of about BLOCK bytes.

    A text longer than a block is hashed in parts that end at spaces, so memory
    doesn't follow the longest text's bytes.
    """
    data, bounds = buffers(texts)
    n, i = len(bounds) - 1, 0
    up, down = powers(min(len(data), 2 * BLOCK) + 1)
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + BLOCK, side="right")) - 1)
        own = data[bounds[i] : bounds[j]]
        if len(own) <= 2 * BLOCK:
            yield i, words(own, bounds[i : j + 1] - bounds[i], up, down, head, tail, longer)
        else:
            parts, at = [], 0
            while at < len(own):
                stop = min(at + BLOCK, len(own))
                while stop < len(own) and not SPACE[own[stop]]:
                    gap = np.flatnonzero(SPACE[own[stop : stop + BLOCK]])
                    stop = stop + int(gap[0]) if len(gap) else min(stop + BLOCK, len(own))
                if stop - at >= len(up):
                    up, down = powers(stop - at + 1)
                parts.append(words(own[at:stop], np.array([0, stop - at]), up, down, head, tail, longer))
                at = stop
            joined = [np.concatenate(p) if p[0] is not None else None for p in zip(*parts)]
            joined[1] = np.array([joined[1].sum()])
            yield i, tuple(joined)
        i = j
