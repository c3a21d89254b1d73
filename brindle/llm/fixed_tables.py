"""Tables of a fixed size that all tasks fill: counters and bit sets.

Every task fills its own copy and emits it in compressed blocks; the blocks are
merged by Spark. What the driver gets and broadcasts has the fixed size, however
large the input is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

BLOCKS = 64


def emitted(table: np.ndarray) -> list[tuple[int, bytes]]:
    pack = zstandard.ZstdCompressor(level=1)
    return [(i, pack.compress(block.tobytes())) for i, block in enumerate(np.split(table, BLOCKS))]


def merged(parts: DataFrame, kind: str, merge: Callable[[np.ndarray, np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The merged table of rows (block int, packed binary)."""

    def fold(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = None
        for batch in batches:
            for packed in batch.column("packed").to_pylist():
                block = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), dtype=kind)
                whole = block.copy() if whole is None else merge(whole, block)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([zstandard.ZstdCompressor(level=1).compress(whole.tobytes())])], ["block", "packed"])

    out = np.zeros(size, dtype=kind)
    blocks = out.reshape(BLOCKS, -1)
    for row in parts.select("block", "packed").groupBy("block").applyInArrow(fold, "block int, packed binary").collect():
        blocks[row["block"]] = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(row["packed"])), dtype=kind)
    return out
