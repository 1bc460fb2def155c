"""A bounded Bloom filter over 64-bit keys, built by tasks and tested in Python workers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import mix

BITS_PER_KEY, PROBES, MAX_BITS, SEGMENT = 10, 4, 1 << 29, 1 << 16


def _bits(keys: np.ndarray, size: int) -> np.ndarray:
    a = mix(keys.view(np.uint64))
    b = mix(a) | np.uint64(1)
    return ((a[:, None] + np.arange(PROBES, dtype=np.uint64) * b[:, None]) % np.uint64(size)).astype(np.int64)


class Bloom:
    """Never wrongly says that a key is absent; `size` bits whatever the number of keys."""

    def __init__(self, size: int, data: bytes):
        self.size, self.data = size, data

    def __contains__(self, keys: np.ndarray) -> np.ndarray:
        return self.test(keys)

    def test(self, keys: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.empty(0, bool)
        bits, held = _bits(np.ascontiguousarray(keys), self.size), np.frombuffer(self.data, np.uint8)
        return ((held[bits >> 3] >> (bits & 7).astype(np.uint8)) & 1).astype(bool).all(axis=1)


def build(keys: DataFrame, rows: int, max_bits: int = MAX_BITS) -> Bloom:
    """The filter of the one column of 64-bit integers in `keys`."""
    size = max(1 << 12, min(max_bits, rows * BITS_PER_KEY))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(-(-size // 8), np.uint8)
        for batch in batches:
            bits = np.unique(_bits(np.asarray(batch.column(0)), size)) if batch.num_rows else np.empty(0, np.int64)
            np.bitwise_or.at(own, bits >> 3, np.left_shift(1, bits & 7).astype(np.uint8))
        for k in range(0, len(own), SEGMENT):
            if own[k : k + SEGMENT].any():
                yield pa.RecordBatch.from_arrays([pa.array([k // SEGMENT], pa.int64()), pa.array([own[k : k + SEGMENT].tobytes()], pa.binary())], ["segment", "bits"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                part = np.frombuffer(data, np.uint8)
                held[k] = held[k] | part if k in held else part
        for k, part in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([part.tobytes()], pa.binary())], ["segment", "bits"])

    out = bytearray(-(-size // 8))
    segments = -(-len(out) // SEGMENT)
    # a task for every few million keys: more tasks fill faster, but each sends its own segments
    parts = keys.coalesce(min(512, max(32, rows // 2_000_000))).mapInArrow(fill, "segment long, bits binary")
    for row in parts.repartition(min(segments, 32), "segment").mapInArrow(merge, "segment long, bits binary").toLocalIterator():
        out[row.segment * SEGMENT : row.segment * SEGMENT + len(row.bits)] = row.bits
    return Bloom(size, bytes(out))
