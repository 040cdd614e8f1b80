"""Bloom filters over 64-bit keys, built by executors in segments and bounded in size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.textops import mix64

#: Never more bits than this (16 MB), whatever the number of keys: then more keys pass, none is lost.
MOST_BITS = 1 << 27
_SEGMENT = 1 << 19
_PROBES = 5


def _positions(keys: np.ndarray, bits: int) -> np.ndarray:
    first, second = mix64(keys), mix64(keys ^ np.uint64(0xA5A5A5A5A5A5A5A5)) | np.uint64(1)
    return np.stack([(first + np.uint64(i) * second) & np.uint64(bits - 1) for i in range(_PROBES)])


class Bloom:
    """Membership with false positives and no false negatives."""

    def __init__(self, keys_expected: int, most_bits: int = MOST_BITS):
        self.bits = 1 << 13
        while self.bits < min(most_bits, 12 * keys_expected):
            self.bits *= 2
        self.data = np.zeros(self.bits // 8, np.uint8)

    def add(self, keys: np.ndarray) -> None:
        at = _positions(keys, self.bits).ravel()
        np.bitwise_or.at(self.data, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = _positions(np.asarray(keys, np.uint64), self.bits)
        return ((self.data[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0)


def digest_keys(digests: list[bytes]) -> np.ndarray:
    """The first eight bytes of each digest (shorter ones zero-padded)."""
    return np.frombuffer(b"".join(d[:8].ljust(8, b"\0") for d in digests), np.uint64)


def bloom_of_digests(digests: DataFrame, column: str, count: int) -> Bloom:
    """A filter of a binary column. Executors set bits by segment; the driver gets each segment once,
    in all at most MOST_BITS / 8 bytes."""
    out = Bloom(count)
    bits, segment = out.bits, min(_SEGMENT, out.bits)

    def partial(batches):
        local = Bloom(count)
        for batch in batches:
            if batch.num_rows:
                local.add(digest_keys(batch.column(0).to_pylist()))
        parts = local.data.reshape(-1, segment // 8)
        used = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_pydict({"segment": pa.array(used, pa.int32()), "bits": pa.array([parts[i].tobytes() for i in used], pa.binary())})

    def merge(table: pa.Table) -> pa.Table:
        total = np.zeros(segment // 8, np.uint8)
        for x in table.column("bits"):
            total |= np.frombuffer(x.as_py(), np.uint8)
        return pa.table({"segment": table.column("segment").slice(0, 1), "bits": pa.array([total.tobytes()], pa.binary())})

    assert bits == Bloom(count).bits
    schema = "segment int, bits binary"
    rows = digests.select(F.col(column)).mapInArrow(partial, schema).groupBy("segment").applyInArrow(merge, schema).collect()
    for row in rows:
        out.data.reshape(-1, segment // 8)[row["segment"]] |= np.frombuffer(bytes(row["bits"]), np.uint8)
    return out
