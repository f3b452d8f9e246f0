"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.checkpoints import Stored, shared_dir

__all__ = ["Rolling", "Stored", "arrow", "as_text", "ints", "mix64", "packed", "raw", "shared_dir", "slices", "with_row"]

BATCH_BYTES = 2 << 20


def packed(df: DataFrame, **extra: Column) -> DataFrame:
    """All columns of ``df``, whatever their names, as one struct ``row`` beside ``extra``: no name of theirs can clash."""
    return df.select(F.struct("*").alias("row"), *[c.alias(k) for k, c in extra.items()])


def with_row(source: DataFrame, rest: str) -> T.StructType:
    """The field ``row`` of ``source`` and those of ``rest``, a DDL string."""
    return T.StructType([source.schema["row"], *T.StructType.fromDDL(rest).fields])


def as_text(df: DataFrame, name: str) -> Column:
    """The column as a string, null as empty."""
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def raw(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array end to end, and its n + 1 offsets into them (nulls are empty)."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null(b"" if pa.types.is_binary(array.type) or pa.types.is_large_binary(array.type) else "")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    if not len(array):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    flat = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return flat, at - at[0]


def slices(batches: Iterable[pa.RecordBatch], column: str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about ``most`` bytes of ``column``; a longer row comes alone and whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = raw(batch.column(batch.schema.get_field_index(column)))
        begin = 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(at, at[begin] + most, "right")) - 1)
            yield batch.slice(begin, end - begin)
            begin = end


def arrow(df: DataFrame, kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    return df.mapInArrow(kernel, schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    out = np.full(max(n, 1), np.uint64(base))
    out[0] = 1
    return np.multiply.accumulate(out)[:n]


class Rolling:
    """Hashes of any byte range in constant time, vectorised: prefix sums of byte codes times powers of an odd base."""

    def __init__(self, base: int, seed: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.codes = np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
        self.up = self.down = np.empty(0, np.uint64)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        n = len(data) + 1
        if len(self.up) < n:
            self.up, self.down = powers(self.base, n), powers(self.inverse, n)
        out = np.zeros(n, np.uint64)
        np.cumsum(self.codes[data] * self.up[: n - 1], out=out[1:])
        return out

    def ranges(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (prefix[end] - prefix[start]) * self.down[start]


def ints(flat: np.ndarray, at: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list array of the runs of ``flat`` that ``at`` (n + 1 offsets) marks."""
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat, kind))
