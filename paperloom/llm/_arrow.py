"""Helpers for Arrow batches inside tasks: pieces of bounded size and word spans as numpy arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Bytes of text that one vectorized pass holds, with a few dozen arrays of eight times as much; a single longer text is a
#: pass of its own.
PIECE_BYTES = 1 << 18

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def text_of(array: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The column as large strings (bytes as large binary), null as the empty string."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if pa.types.is_binary(array.type) or pa.types.is_large_binary(array.type):
        return pc.fill_null(array.cast(pa.large_binary()), b"")
    return pc.fill_null(array.cast(pa.large_string()), "")


def bytes_of(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(data, offsets) of a column of text; offsets start at 0."""
    array = text_of(array)
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    data = array.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batch: pa.RecordBatch | pa.Table, column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch | pa.Table]:
    """Slices of whole rows, each with at most `limit` bytes of `column` or one row."""
    at = batch.schema.get_field_index(column)
    sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False) if batch.num_rows else np.empty(0, np.int64)
    ends = np.cumsum(sizes.astype(np.int64))
    lo = 0
    while lo < batch.num_rows:
        done = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, done + limit, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Each run of rows with equal `keys` (numbers) as one table, from batches that are sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        if held and last != tuple(c[0] for c in columns):
            yield pa.Table.from_batches(held)
            held = []
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if lo:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held)


def append(df: DataFrame, text: str, func: Callable[[pa.RecordBatch], list], fields: str, keep: list[str] | None = None) -> DataFrame:
    """`keep` (all columns if None) followed by `fields`, which `func` computes for each piece of a batch.

    A kept column that has the name of a new one is replaced by it.
    """
    new = T._parse_datatype_string(fields)
    kept = [f for f in df.schema.fields if (keep is None or f.name in keep) and f.name not in new.names]
    names = [f.name for f in kept]
    read = [*names, *([] if text in names else [text])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, text):
                yield pa.RecordBatch.from_arrays([*(piece.column(n) for n in names), *func(piece)], names=[*names, *new.names])

    return df.select(*(f"`{c}`" for c in read)).mapInArrow(run, T.StructType([*kept, *new.fields]))


def spans(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every maximal run of bytes that are not in `space`; runs never cross rows."""
    solid = ~space[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    edge = solid[:-1] != solid[1:]
    begin = solid.copy()
    begin[1:] &= edge | first[1:-1]
    end = solid
    end[:-1] &= edge | first[1:-1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(offsets, starts, "right") - 1


_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse to the powers 0..n-1, modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, PIECE_BYTES + 1)
        made = []
        for base in (BASE, BASE_INVERSE):
            column = np.full(size, base, np.uint64)
            column[0] = 1
            made.append(np.multiply.accumulate(column))
        if size > PIECE_BYTES + 1:  # not kept: a worker outlives its longest text
            return made[0][:n], made[1][:n]
        _powers[:] = made
    return _powers[0][:n], _powers[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums of the polynomial in BASE whose coefficients are the bytes plus one."""
    forward, _ = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * forward[:-1], out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, from the prefix sums."""
    _, back = powers(len(sums))
    return mixed((sums[ends] - sums[starts]) * back[starts])
