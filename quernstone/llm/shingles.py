"""Word-shingle sets of texts as 64-bit hashes, computed over whole Arrow buffers with numpy.

Words are runs of bytes other than space and 0x09-0x0D after lower-casing A-Z; UTF-8 keeps other characters
apart. A word's hash is a polynomial over random byte values, mixed; a shingle's is a mixed combination of
its words' hashes, so two different shingles share a hash with probability about 2^-63.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
for _c in range(65, 91):
    _BYTE[_c] = _BYTE[_c + 32]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PLACE = _RNG.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C17
CHUNK = 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([np.ones(1, dtype=np.uint64), np.full(n - 1, base, dtype=np.uint64)]).cumprod(dtype=np.uint64)


_UP, _DOWN = _powers(_BASE, CHUNK), _powers(pow(_BASE, -1, 2**64), CHUNK)


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of the texts data[cuts[i]:cuts[i+1]], and how many words each has."""
    gap = _SPACE[data]
    first = np.zeros(len(data) + 1, dtype=bool)
    first[cuts] = True
    start = np.flatnonzero(~gap & (np.concatenate([[True], gap[:-1]]) | first[:-1]))
    stop = np.flatnonzero(~gap & (np.concatenate([gap[1:], [True]]) | first[1:])) + 1
    out = np.zeros(len(start), dtype=np.uint64)
    values = _BYTE[data]
    with np.errstate(over="ignore"):
        for lo in range(0, len(start), CHUNK // 8):  # words of one stretch share a running sum
            a, b = start[lo : lo + CHUNK // 8], stop[lo : lo + CHUNK // 8]
            while len(a):
                fit = int(np.searchsorted(b, a[0] + CHUNK, "right"))
                if not fit:  # one word longer than the power table: its own sum
                    piece = values[a[0] : b[0]]
                    h = np.uint64(0)
                    for k in range(0, len(piece), CHUNK):
                        q = piece[k : k + CHUNK]
                        h = mix(h[None] if isinstance(h, np.ndarray) else np.array([h]))[0] + (q * _UP[: len(q)]).sum(dtype=np.uint64)
                    out[lo + len(start[lo : lo + CHUNK // 8]) - len(a)] = h
                    a, b = a[1:], b[1:]
                    continue
                base, end = a[0], b[fit - 1]
                run = np.concatenate([np.zeros(1, dtype=np.uint64), (values[base:end] * _UP[: end - base]).cumsum(dtype=np.uint64)])
                at = lo + len(start[lo : lo + CHUNK // 8]) - len(a)
                out[at : at + fit] = (run[b[:fit] - base] - run[a[:fit] - base]) * _DOWN[a[:fit] - base]
                a, b = a[fit:], b[fit:]
    counts = np.diff(np.searchsorted(start, cuts))
    return mix(out + np.uint64(1)), counts


def text_chunks(texts: pa.Array, most: int = 2 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, cuts) for stretches of rows of about ``most`` bytes; null counts as empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] is not None else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        end = min(end, len(texts))
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def shingle_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its n-word shingles; with fewer words the whole
    sequence is one shingle, without words the set is empty."""
    for _, data, cuts in text_chunks(texts):
        words, counts = word_hashes(data, cuts)
        ends = counts.cumsum()
        with np.errstate(over="ignore"):
            k = max(0, len(words) - n + 1)
            rolled = sum((words[i : i + k] * _PLACE[i] for i in range(1, n)), words[:k] * _PLACE[0]) if k else words[:0]
            rolled = mix(rolled)
            for end, count in zip(ends.tolist(), counts.tolist(), strict=True):
                if count >= n:
                    yield np.unique(rolled[end - count : end - n + 1])
                elif count:
                    part = words[end - count : end] * _PLACE[32 : 32 + count]
                    yield mix(np.array([part.sum(dtype=np.uint64) + np.uint64(count)]))
                else:
                    yield np.zeros(0, dtype=np.uint64)
