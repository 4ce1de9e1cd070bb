"""Word and shingle hashes of many texts at once, in numpy on Arrow's own buffers.

Words are runs of bytes other than space and 0x09-0x0D, with A-Z lower-cased; their hash is a polynomial over a random
table of bytes. A text's shingles are all runs of `size` words, or its whole sequence if it has fewer; their hashes have
64 bits. Work goes in parts of about PART bytes; a longer text is a part of its own, at some 40 bytes of memory a byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PART = 2 << 20
_FOLD = np.arange(256)
_FOLD[65:91] += 32
_TABLE = np.random.default_rng(20150917).integers(1, 1 << 63, 256, dtype=np.uint64)[_FOLD]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    up = down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            n = 1 << (n - 1).bit_length()
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(cls, name, np.multiply.accumulate(steps))
        return cls.up, cls.down


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than texts) and bytes of an array of strings; nulls count as empty."""
    texts = texts.fill_null("") if texts.null_count else texts
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    if not len(texts):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return at - at[0], raw


def parts(texts: pa.Array, most: int = PART) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, offsets, bytes) of runs of texts of about `most` bytes."""
    offsets, raw = buffers(texts)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, offsets[first : last + 1] - offsets[first], raw[offsets[first] : offsets[last]]
        first = last


def words(offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and the number of words of every text."""
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    solid = ~_SPACE[raw]
    breaks = np.zeros(len(raw) + 1, bool)
    breaks[offsets] = True
    starts = np.flatnonzero(solid & np.concatenate(([True], ~solid[:-1] | breaks[1:-1])))
    ends = np.flatnonzero(solid & np.concatenate((~solid[1:] | breaks[1:-1], [True]))) + 1
    up, down = Powers.upto(len(raw))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_TABLE[raw] * up[: len(raw)], out=total[1:])
    hashes = mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.diff(np.searchsorted(starts, offsets))


def sets(texts: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(index of the text, its distinct shingles in ascending order)."""
    weights = mixed(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)
    for first, offsets, raw in parts(texts):
        hashes, counts = words(offsets, raw)
        ends = np.cumsum(counts)
        joint = np.zeros(max(len(hashes) - size + 1, 0), np.uint64)
        for k in range(size):
            joint += hashes[k : k + len(joint)] * weights[k]
        joint = mixed(joint)
        for i, (n, end) in enumerate(zip(counts.tolist(), ends.tolist(), strict=True)):
            if n >= size:
                yield first + i, np.unique(joint[end - n : end - size + 1])
            elif n:
                whole = (hashes[end - n : end] * weights[:n]).sum(dtype=np.uint64) + np.uint64(n)
                yield first + i, mixed(np.array([whole]))
            else:
                yield first + i, np.zeros(0, np.uint64)
