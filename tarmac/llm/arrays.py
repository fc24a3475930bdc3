"""Texts of an Arrow batch as byte arrays: words, hashes, and hashes of word runs.

Everything here works on a batch at a time with numpy; nothing loops over words.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))

#: The bytes of `[\x20\x09-\x0D]`.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Bytes with A-Z in lower case.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

#: What is not a letter: ASCII letters and every byte of a longer UTF-8 character are letters.
NO_LETTER = np.ones(256, dtype=bool)
NO_LETTER[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1), *range(0x80, 0x100)]] = False

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse modulo 2**64."""
    if "base" not in _powers or len(_powers["base"]) < n:
        size = max(n, 1 << 16)
        for key, base in (("base", BASE), ("inverse", BASE_INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[key] = np.multiply.accumulate(steps)
    return _powers["base"][:n], _powers["inverse"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, one after the other, and where each begins and the last ends."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    first, last = int(offsets[0]), int(offsets[-1])
    buf = np.frombuffer(data, dtype=np.uint8)[first:last] if last > first else np.zeros(0, np.uint8)
    return buf, offsets - first


def portions(batch: pa.RecordBatch, column: str, limit: int = 2 << 20):
    """Slices of a batch with about `limit` bytes of text each; a longer text is a slice of its own."""
    lengths = np.zeros(batch.num_rows, np.int64)
    if batch.num_rows:
        _, offsets = buffer_of(batch.column(batch.schema.get_field_index(column)))
        lengths = np.diff(offsets)
    start, size = 0, 0
    for i, n in enumerate(lengths):
        if size and size + n > limit:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += int(n)
    if batch.num_rows > start:
        yield batch.slice(start)


def words(buf: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = SPACE, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every maximal run of bytes outside `gaps`; none crosses texts.

    `cuts` are places before which a run ends as well.
    """
    n = len(buf)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~gaps[buf]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    if cuts is not None:
        edge[cuts] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def prefix_hashes(buf: np.ndarray) -> np.ndarray:
    """Sums from which `span_hashes` takes the hash of any span."""
    base, _ = powers(len(buf) + 1)
    sums = np.empty(len(buf) + 1, dtype=np.uint64)
    sums[0] = 0
    np.add(buf, np.uint64(1), out=sums[1:])
    sums[1:] *= base[: len(buf)]
    np.cumsum(sums[1:], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, equal for equal bytes anywhere."""
    _, inverse = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def word_hashes(buf: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every word, A-Z taken as lower case."""
    lowered = LOWER[buf]
    starts, ends, owner = words(lowered, offsets, gaps)
    return span_hashes(prefix_hashes(lowered), starts, ends), owner


def counts_by(owner: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner, minlength=n).astype(np.int64)


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    if len(sorted_values) == 0:
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]]))


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values in ascending order, a place of each, and which one each value is.

    Unlike numpy's own, it sorts without keeping equal values in order, which takes a
    quarter of the time; so the place is any.
    """
    order = np.argsort(values)
    first = runs(values[order])
    inverse = np.empty(len(values), np.int64)
    inverse[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(values))))
    return values[order[first]], order[first], inverse


def expand(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range after the other."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total, dtype=np.int64)


def binaries(parts: list[np.ndarray | bytes]) -> pa.Array:
    return pa.array([p if isinstance(p, bytes) else p.tobytes() for p in parts], type=pa.binary())


def longs(values) -> pa.Array:
    return pa.array(np.asarray(values, dtype=np.int64), type=pa.int64())


def give_back() -> None:
    """Hand memory that a task has freed back to the system, of which the worker's next task may run beside others."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        # Another C library keeps it.
        return
