"""Content-defined chunking by the published FastCDC scheme: a gear hash, a strict mask below the average size and a lax one above it."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SIZES = (16 << 10, 64 << 10, 256 << 10)  # least, average and largest chunk
CHUNKS = "object_id string, pos int, offset long, length long, hash string, data binary"


def _gear() -> np.ndarray:
    """256 pseudo-random words, by splitmix64."""
    with np.errstate(over="ignore"):
        x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_GEAR = _gear()


def boundaries(data: bytes, least: int = SIZES[0], average: int = SIZES[1], largest: int = SIZES[2]) -> list[int]:
    """Chunk ends. A cut depends on the 64 bytes before it and the last cut only, so an edit moves the cuts near it alone."""
    n = len(data)
    if n <= least:
        return [n] if n else []
    rolling = _GEAR[np.frombuffer(data, dtype=np.uint8)]
    width = 1
    while width < 64:  # after each step, the gear hash of the last 2 * width bytes
        more = rolling.copy()
        more[width:] += rolling[:-width] << np.uint64(width)
        rolling, width = more, 2 * width
    bits = average.bit_length() - 1
    strict = np.flatnonzero(rolling >> np.uint64(64 - bits - 1) == 0) + 1
    lax = np.flatnonzero(rolling >> np.uint64(64 - bits + 1) == 0) + 1
    ends, at = [], 0
    while n - at > least:
        middle, stop = min(at + average, n), min(at + largest, n)
        k = int(np.searchsorted(strict, at + least))
        cut = int(strict[k]) if k < len(strict) and strict[k] <= middle else 0
        if not cut:
            k = int(np.searchsorted(lax, middle))
            cut = int(lax[k]) if k < len(lax) and lax[k] <= stop else stop
        ends.append(cut)
        at = cut
    if at < n:
        ends.append(n)
    return ends


def chunk(objects: DataFrame, least: int = SIZES[0], average: int = SIZES[1], largest: int = SIZES[2], keep_data: bool = True) -> DataFrame:
    """Chunks of (object_id, data): see CHUNKS. Empty and null data have none. Objects stay in their tasks."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in CHUNKS.split(", ")]
        types = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        for frame in frames:
            out = []
            for object_id, data in zip(frame.column("object_id").to_pylist(), frame.column("data").to_pylist()):
                low = 0
                for pos, high in enumerate(boundaries(data or b"", least, average, largest)):
                    body = data[low:high]
                    out.append((object_id, pos, low, high - low, "sha256:" + sha256(body).hexdigest(), body if keep_data else None))
                    low = high
            columns = list(zip(*out)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    rows = objects.select(objects["object_id"].cast("string").alias("object_id"), objects["data"].cast("binary").alias("data"))
    return rows.mapInArrow(run, CHUNKS)
