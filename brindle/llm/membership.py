"""A bit set of fixed size that says which keys may be in a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fixed_tables import emitted, merged
from .textkit import U64, mix64, stream64, tidy

BITS = 1 << 26
_SALTS = stream64(61, 2)


def _places(keys: np.ndarray) -> list[np.ndarray]:
    return [(mix64(keys.astype(np.int64).view(U64) ^ salt) >> U64(38)).astype(np.int64) for salt in _SALTS]


def membership(keys: DataFrame, key: str) -> Callable[[np.ndarray], np.ndarray]:
    """A function from an array of keys to a mask: False only for keys that aren't in the table.

    The set has 8 MB whatever the table holds, so a larger table lets more other
    keys through and a join must follow; nothing is lost.
    """

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(BITS // 8, dtype=np.uint8)
        for batch in tidy(batches):
            for place in _places(batch.column(0).to_numpy()):
                np.bitwise_or.at(bits, place >> 3, np.uint8(128) >> (place & 7).astype(np.uint8))
        if bits.any():
            parts = emitted(bits)
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in parts], pa.int32()), pa.array([b for _, b in parts], pa.binary())], ["block", "packed"])

    rows = keys.where(F.col(key).isNotNull()).select(F.col(key).cast("long"))
    table = merged(rows.mapInArrow(fill, "block int, packed binary"), "u1", np.bitwise_or, BITS // 8)
    spread = keys.sparkSession.sparkContext.broadcast(table)

    def may_have(values: np.ndarray) -> np.ndarray:
        keep = np.ones(len(values), dtype=bool)
        for place in _places(values):
            keep &= (spread.value[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 == 1
        return keep

    return may_have
