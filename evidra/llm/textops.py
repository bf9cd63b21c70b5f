"""Vectorised word and byte hashing over Arrow text columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Odd base of the polynomial word hash; its powers and their inverses modulo 2**64 are kept as tables.
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.int64).view(np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.ones(256, bool)
_IN_WORD[[32, 9, 10, 11, 12, 13]] = False
_tables: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables.get("up", ())) < n:
        size = 1 << max(20, (n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _tables[name] = np.multiply.accumulate(steps)
    return _tables["up"], _tables["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xA0761D6478BD642F)
    x ^= x >> np.uint64(32)
    return x


def text_blocks(column: pa.Array, target: int = 1 << 17, most: int = 1024) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Splits a text column into runs of at most `most` rows and about `target` bytes: (first row, offsets of n + 1, UTF-8 bytes).

    Nulls are empty. A single longer row makes a block of its own.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + target, "right")) - 1)
        last = min(last, len(column), first + most)
        own = offsets[first : last + 1]
        yield first, own - own[0], data[own[0] : own[-1]]
        first = last


def word_spans(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words `[^\\x20\\x09-\\x0D]+`, and for each row the number of words before it (n + 1)."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _IN_WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, the same wherever the word stands.

    Words of up to 32 bytes are folded eight bytes at a time, each step through the finaliser; longer ones by xxh3.
    """
    size = ends - starts
    found = mix(size.astype(np.uint64) * _BASE)
    lanes = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    rows = np.flatnonzero(size <= 32)
    for at in range(0, 32, 8):
        rows = rows[size[rows] > at]
        if not len(rows):
            break
        lane, rest = lanes[starts[rows] + at], size[rows] - at
        part = rest < 8
        lane[part] &= (np.uint64(1) << (rest[part] * 8).astype(np.uint64)) - np.uint64(1)
        found[rows] = mix(found[rows] ^ lane)
    memory = memoryview(np.ascontiguousarray(data))
    for i in np.flatnonzero(size > 32).tolist():
        found[i] = xxhash.xxh3_64_intdigest(memory[starts[i] : ends[i]])
    return found


def byte_gram_hashes(data: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive bytes, from one running sum; none, if there are fewer."""
    if len(data) < n:
        return np.zeros(0, np.uint64)
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * up[: len(data)], out=total[1:])
    own = total[n:] - total[:-n]
    own *= down[: len(own)]
    own ^= own >> np.uint64(32)
    own *= np.uint64(0xD6E8FEB86659FD93)
    return own


def gram_hashes(tokens: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive tokens, by doubling; len(tokens) - n + 1 values (none, if there are fewer)."""
    if len(tokens) < n:
        return np.zeros(0, np.uint64)
    made, size, whole, done = tokens, 1, None, 0
    while True:
        if n & size:
            if whole is None:
                whole, done = made, size
            else:
                count = min(len(whole), len(made) - done)
                whole = mix((whole[:count] * np.uint64(0x8EBC6AF09C88C6E3)) + made[done : done + count] * np.uint64(0x589965CC75374CC3) + np.uint64(done))
                done += size
        if done == n:
            return whole[: len(tokens) - n + 1]
        made = mix((made[:-size] * np.uint64(0x9E6C63D0676A9A99)) + made[size:] * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(size))
        size <<= 1


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive values, by doubling."""
    least, size = values, 1
    while size * 2 <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    rest = width - size
    return np.minimum(least[: len(values) - width + 1], least[rest : rest + len(values) - width + 1])
