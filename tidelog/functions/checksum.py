"""CRC-32C (Castagnoli) of binary columns. Spark's own crc32 is the IEEE polynomial."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

POLYNOMIAL = 0x82F63B78


def _table() -> np.ndarray:
    rows = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        rows = np.where(rows & 1, (rows >> 1) ^ np.uint32(POLYNOMIAL), rows >> 1)
    return rows


TABLE = _table()
ENTRIES = TABLE.tolist()


def crc32c(data: bytes, seed: int = 0) -> int:
    crc = seed ^ 0xFFFFFFFF
    for byte in data:
        crc = (crc >> 8) ^ ENTRIES[(crc ^ byte) & 0xFF]
    return crc ^ 0xFFFFFFFF


def _many(values: list[bytes]) -> np.ndarray:
    """The checksums of many values at once, byte place by byte place, longest values first."""
    order = sorted(range(len(values)), key=lambda i: -len(values[i]))
    sizes = np.array([len(values[i]) for i in order], dtype=np.int64)
    crc = np.full(len(values), 0xFFFFFFFF, dtype=np.uint32)
    if len(values):
        flat = np.frombuffer(b"".join(values[i] for i in order), dtype=np.uint8)
        starts = np.cumsum(sizes) - sizes
        for place in range(int(sizes.max())):
            live = int(np.searchsorted(-sizes, -place, side="left"))
            byte = flat[starts[:live] + place]
            crc[:live] = (crc[:live] >> np.uint32(8)) ^ TABLE[(crc[:live] ^ byte) & np.uint32(0xFF)]
    out = np.empty(len(values), dtype=np.int64)
    out[order] = crc ^ np.uint32(0xFFFFFFFF)
    return out


@F.pandas_udf(T.LongType())
def crc32c_of(values: pd.Series) -> pd.Series:
    """The unsigned CRC-32C of each value; null for null."""
    known = values.notna()
    out = pd.Series([None] * len(values), dtype="Int64", index=values.index)
    out[known] = _many([bytes(v) for v in values[known]])
    return out
