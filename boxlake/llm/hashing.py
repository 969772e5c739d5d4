"""Hashes of words, shingles and byte strings over whole buffers of text at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_M = np.uint64(0xFFFFFFFFFFFFFFFF)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: A-Z to a-z; the six white-space bytes.
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64 bits (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base, and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, b in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def prefix_hashes(buf: np.ndarray) -> np.ndarray:
    """h with h[i] the hash of the first i bytes; spans of equal bytes have equal span_hashes."""
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_CODES[buf] * powers(len(buf))[0], out=out[1:])
    return out


def span_hashes(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((h[ends] - h[starts]) * powers(len(h))[1][starts])


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words ``[^\\x20\\x09-\\x0D]+`` of the texts, A-Z lower-cased, and each one's text number."""
    buf = LOWERED[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    space = IS_SPACE[buf]
    edge = np.diff(space.astype(np.int8), prepend=np.int8(1))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    where = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return span_hashes(prefix_hashes(buf), starts, ends), np.searchsorted(where, starts, "right") - 1


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """For each text its sorted distinct shingles of so many words; with fewer words, all of them as one."""
    hashes, owner = word_hashes(texts)
    first = np.searchsorted(owner, np.arange(len(texts) + 1))
    rolled = np.zeros(len(hashes), np.uint64)
    n = len(hashes) - words + 1
    if n > 0:
        r = np.zeros(n, np.uint64)
        for k in range(words):
            r = r * np.uint64(_INVERSE) + hashes[k : k + n]
        rolled[:n] = mix(r)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= words:
            out.append(np.unique(rolled[a : b - words + 1]))
        elif b > a:
            r = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for x in hashes[a:b]:
                    r = r * np.uint64(_INVERSE) + x
            out.append(mix(np.array([r], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def slices_of(batch: pa.RecordBatch, text: int, most: int) -> Iterator[pa.RecordBatch]:
    """Runs of the batch's rows whose texts (a column's number) hold at most so many bytes together, or one row:
    only such a run is ever turned into Python values."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    for start, end in slices_by_bytes(sizes, most):
        yield batch.slice(start, end - start)


def slices_by_bytes(sizes: list[int], most: int):
    """(start, end) of runs that hold at most so many bytes, or one item."""
    start = held = 0
    for i, n in enumerate(sizes):
        if i > start and held + n > most:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)
