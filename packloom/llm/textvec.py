"""Word arithmetic on Arrow text columns inside tasks: whole columns of bytes at a time, no per-word Python.

Words are runs without ASCII white space.  Hashes are 64-bit: two different words or
shingles share one with a chance of about 2**-60.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
CHUNK = 2 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit words (in a new array)."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


BYTE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
STEP = U(0x5851F42D4C957F2D)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_pow = np.ones(1, U)


def powers(n: int) -> np.ndarray:
    global _pow
    if len(_pow) < n:
        _pow = np.concatenate([[U(1)], np.cumprod(np.full(max(n, 4096) - 1, STEP, U))])
    return _pow[:n]


def slices(texts: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes of text; a longer text has a range of its own."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    first, held = 0, 0
    for i, n in enumerate(sizes):
        if i > first and held + n > limit:
            yield first, i
            first, held = i, 0
        held += n
    if first < len(sizes):
        yield first, len(sizes)


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def sums(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``mask`` in each range between consecutive offsets."""
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def spans_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Hash of each byte span; ``inside`` marks the bytes that lie in some span.  Spans aren't empty."""
    if not len(starts):
        return np.zeros(0, U)
    lens = ends - starts
    first = np.cumsum(lens) - lens
    place = np.arange(int(lens.sum())) - np.repeat(first, lens)
    values = BYTE[data[inside]] * powers(int(lens.max()))[place]
    return mix(np.add.reduceat(values, first) + lens.astype(U))


@dataclass
class Words:
    """Words of a chunk of texts: hash and text number of each, and the number of the first word of each text."""

    hash: np.ndarray
    text: np.ndarray
    first: np.ndarray
    inside: np.ndarray
    start: np.ndarray
    end: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> Words:
    if lower:
        data = LOWER[data]
    inside = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:-1]
    finish = inside.copy()
    finish[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    first = np.searchsorted(start, offsets)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(spans_hash(data, start, end, inside), text, first, inside, start, end)


ODD = mix(np.arange(11, 75, dtype=U)) | U(1)


def shingles(w: Words, size: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of every window of ``size`` words, in order; with ``short``, a text with fewer
    words, but at least one, has its whole sequence as its only window."""
    n = len(w.hash)
    total = np.zeros(n, U)
    for j in range(size):
        total[: n - j] += w.hash[j:] * ODD[j] if j < n else U(0)
    index = np.arange(n)
    left = w.first[1:][w.text] - index
    full = left >= size
    out, text = total[full] + U(size), w.text[full]
    if short:
        few = np.flatnonzero((w.counts > 0) & (w.counts < size))
        if len(few):
            own = np.zeros(len(few), U)
            for j in range(size - 1):
                has = w.counts[few] > j
                own[has] += w.hash[w.first[:-1][few[has]] + j] * ODD[j]
            out = np.concatenate([out, own + w.counts[few].astype(U)])
            text = np.concatenate([text, few])
            order = np.argsort(text, kind="stable")
            out, text = out[order], text[order]
    return mix(out), text


def distinct(values: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each text, one after another, and their offsets; ``text`` ascends."""
    bounds = np.searchsorted(text, np.arange(n + 1))
    parts = [np.unique(values[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    offsets = np.zeros(n + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    return (np.concatenate(parts) if parts else np.zeros(0, U)), offsets


def word_hash(word: str) -> int:
    """The hash that ``words`` gives this word."""
    data = np.frombuffer(word.encode(), np.uint8)
    return int(spans_hash(data, np.array([0]), np.array([len(data)]), np.ones(len(data), bool))[0])


def with_columns(batch: pa.RecordBatch, names: list[str], new: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch's columns ``names`` and then the new ones."""
    arrays = [batch.column(batch.schema.get_field_index(n)) for n in names] + list(new.values())
    return pa.RecordBatch.from_arrays(arrays, names=[*names, *new])
