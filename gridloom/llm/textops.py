"""Vectorised byte-level text kernels shared by the operators: words, hashes, shingles.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D; only A-Z are lower-cased. Both
rules look at ASCII bytes only, so they hold for UTF-8 as it stands.
"""

from __future__ import annotations

import ctypes
import ctypes.util
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE**i and its inverse for i up to n, modulo 2**64."""
    size = _BLOCK + 4096
    while size < n + 1:
        size *= 2
    if size in _POWERS:
        return _POWERS[size]
    out = []
    for base in (_BASE, _BASE_INVERSE):
        x = np.full(size, base, np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    if size == _BLOCK + 4096:  # those of a rare longer span are not kept
        _POWERS[size] = tuple(out)
    return tuple(out)


def crc_of_id(value) -> int:
    return zlib.crc32(str(value).encode())


def join_documents(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One buffer in which every text is followed by a newline, and where each text starts."""
    ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64) if texts else np.zeros(0, np.int64)
    buffer = np.frombuffer(b"\n".join(texts) + b"\n" if texts else b"", np.uint8)
    return buffer, np.concatenate([np.zeros(1, np.int64), ends])


def words_of(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of all words of a buffer that ends in white space."""
    space = _SPACE[buffer]
    edges = np.flatnonzero(np.diff(space.view(np.int8), prepend=np.int8(1)))
    starts, ends = edges[0::2], edges[1::2]
    return starts, ends, hash_spans(buffer, starts, ends)


def hash_spans(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans of a buffer, which come in order and do not overlap."""
    hashes = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        base = starts[at]
        upto = max(at + 1, int(np.searchsorted(ends, base + _BLOCK, "right")))
        stop = ends[upto - 1]
        power, inverse = _powers(int(stop - base))
        part = _BYTE[buffer[base:stop]]
        part *= power[: len(part)]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part, out=total[1:])
        s, e = starts[at:upto] - base, ends[at:upto] - base
        hashes[at:upto] = mix64((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64))
        at = upto
    return hashes


def words_by_document(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in order, and the offsets at which each text's words begin."""
    buffer, bounds = join_documents(texts)
    starts, _, hashes = words_of(buffer)
    return hashes, np.searchsorted(starts, bounds)


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its runs of ``size`` words; of a shorter text
    one hash of all its words; of a text without words nothing."""
    words, bounds = words_by_document(texts)
    multiplier = np.uint64(0x2545F4914F6CDD1D)
    runs = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for k in range(size):
        runs = runs * multiplier + words[k : k + len(runs)]
    runs = mix64(runs + np.uint64(size))
    out = []
    for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if e - s >= size:
            part = np.sort(runs[s : e - size + 1])
            if len(part) > 1:
                part = part[np.concatenate([[True], part[1:] != part[:-1]])]
            out.append(part)
        elif e > s:
            whole = np.uint64(0)
            with np.errstate(over="ignore"):
                for w in words[s:e]:
                    whole = whole * multiplier + w
                out.append(mix64(np.array([whole + np.uint64(e - s)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sorted_common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays of distinct values."""
    if not len(a) or not len(b):
        return 0
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))


#: What a worker holds of vocabularies, by functions that forget it.
VOCABULARIES: list[Callable[[], None]] = []


def slices_by_bytes(batches: Iterable[pa.RecordBatch], column: str, limit: int, rows: int = 4096, vocabulary: bool = False) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about ``limit`` bytes of ``column`` (one row at least) and at most ``rows`` rows.

    Spark keeps workers for later tasks: one that goes on to a task without a ``vocabulary`` forgets those it has, and
    every worker gives back the memory that it has freed at the end of its task."""
    if not vocabulary:
        while VOCABULARIES:
            VOCABULARIES.pop()()
    try:
        for batch in batches:
            array = batch.column(batch.schema.get_field_index(column))
            if not batch.num_rows:
                continue
            lengths = pc.binary_length(array).fill_null(0).to_numpy(zero_copy_only=False)
            marks = np.cumsum(lengths, dtype=np.int64) // limit
            cuts = [0, *(np.flatnonzero(np.diff(marks)) + 1).tolist(), batch.num_rows]
            for s, e in zip(cuts, cuts[1:]):
                for k in range(s, e, rows):
                    yield batch.slice(k, min(rows, e - k))
    finally:
        give_back()


def give_back() -> None:
    """Return freed memory to the system: the C library and Arrow keep it otherwise."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def _libc():
    library = ctypes.util.find_library("c")
    found = ctypes.CDLL(library) if library else None
    return found if hasattr(found, "malloc_trim") else None  # only GNU's has it


_LIBC = _libc()


def byte_texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """Values of a binary column, null as empty."""
    return [x or b"" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]
