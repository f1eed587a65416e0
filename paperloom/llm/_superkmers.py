"""Super-k-mers: consecutive windows that share a minimiser travel as one packed string to the minimiser's bucket."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from paperloom.llm._arrow import bytes_of, mixed, powers, prefix_hash

#: So many of the most frequent minimisers at most are hot: their windows travel one by one, to buckets of their own.
#: Eight bytes each go to every task. Larger buckets that remain are solved in several passes, see `maximal_groups`.
HOT_MOST = 100_000
#: One document in so many is looked at to find those that occur so often in this sample. What is found decides where
#: windows meet, never the result.
HOT_SAMPLE = 32
HOT_LEAST = 64


def sliding(values: np.ndarray, width: int, pick=np.minimum) -> np.ndarray:
    """Minimum of each `width` consecutive values."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = pick(out[: len(out) - step], out[step:])
        have += step
    return out


def gathered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans' bytes one after another, and their offsets."""
    sizes = ends - starts
    offsets = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    index = np.arange(offsets[-1])
    index += np.repeat(starts - offsets[:-1], sizes)
    return data[index], offsets


def binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def second_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums of another polynomial than `prefix_hash`: bytes pass through a table of random numbers."""
    forward, _ = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * forward[:-1], out=sums[1:])
    return sums


_TABLE = np.random.default_rng(7_340_033).integers(1, 1 << 63, 256, np.uint64)


def groups(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal pairs together, and where each group of them begins."""
    order = np.argsort(first, kind="stable")
    a, b = first[order], second[order]
    new = np.ones(len(a), bool)
    new[1:] = a[1:] != a[:-1]
    differs = ~new
    differs[1:] &= b[1:] != b[:-1]
    if differs.any():  # equal first hashes of unequal strings
        order = np.lexsort((second, first))
        a, b = first[order], second[order]
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order, np.flatnonzero(new)


def runs(minimum: np.ndarray, valid: np.ndarray, owner: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last window of each run of valid windows of one owner and minimiser; whether the minimiser is hot.

    Windows of hot minimisers are runs of their own.
    """
    at = np.flatnonzero(valid)
    if not len(at):
        return at, at, np.zeros(0, bool)
    value, whose = minimum[at], owner[at]
    burning = np.isin(value, hot) if len(hot) else np.zeros(len(at), bool)
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (value[1:] != value[:-1]) | (whose[1:] != whose[:-1]) | burning[1:]
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(at)) - 1
    return at[begin], at[end], burning[begin]


def split(begin: np.ndarray, end: np.ndarray, hot: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of at most `most` windows each: longer ones, as in repeated characters, are split."""
    parts = (end - begin) // most + 1
    inner = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    start = np.repeat(begin, parts) + inner * most
    return start, np.minimum(np.repeat(end, parts), start + most - 1), np.repeat(hot, parts)


def string_hashes(sums: tuple[np.ndarray, ...], starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """A hash of each string data[start:end] from each of the prefix sums."""
    _, back = powers(len(sums[0]))
    return [mixed((s[ends] - s[starts]) * back[starts]) + (ends - starts).astype(np.uint64) for s in sums]


def collapsed(key: np.ndarray, data: np.ndarray, sums: tuple[np.ndarray, np.ndarray], starts: np.ndarray, ends: np.ndarray, **values: tuple[np.ndarray, np.ufunc]) -> dict[str, pa.Array]:
    """One row for each distinct string data[start:end] with its key, and the values of its occurrences put together."""
    order, begin = groups(*string_hashes(sums, starts, ends))
    chosen = order[begin]
    packed, offsets = gathered(data, starts[chosen], ends[chosen])
    return {"bucket": pa.array(key[chosen].view(np.int64)), "packed": binary(packed, offsets)} | {n: pa.array(put.reduceat(v[order], begin)) for n, (v, put) in values.items()}


@dataclass
class Strings:
    """Distinct packed strings in order of bucket and bytes, what is known of each (`values`), and the chunks that have
    it: chunk[first[i]:first[i + 1]]."""

    bucket: np.ndarray
    data: np.ndarray
    offsets: np.ndarray
    values: dict[str, np.ndarray]
    first: np.ndarray
    chunk: np.ndarray

    @classmethod
    def of(cls, batch: pa.RecordBatch, put: dict[str, np.ufunc]) -> Strings:
        """From rows (bucket, packed, chunk and values) that are sorted by bucket and packed."""
        bucket = batch.column("bucket").to_numpy()
        data, offsets = bytes_of(batch.column("packed"))
        one, two = string_hashes((prefix_hash(data), second_hash(data)), offsets[:-1], offsets[1:])
        new = np.ones(len(bucket), bool)
        new[1:] = (bucket[1:] != bucket[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        begin = np.flatnonzero(new)
        values = {n: f.reduceat(batch.column(n).to_numpy(), begin) for n, f in put.items()}
        return cls(bucket[begin], *gathered(data, offsets[begin], offsets[begin + 1]), values, np.append(begin, len(bucket)), batch.column("chunk").to_numpy())

    def cut(self, lo: int, hi: int) -> Strings:
        a, z = self.offsets[[lo, hi]]
        b, e = self.first[[lo, hi]]
        return Strings(self.bucket[lo:hi], self.data[a:z], self.offsets[lo : hi + 1] - a, {n: v[lo:hi] for n, v in self.values.items()}, self.first[lo : hi + 1] - b, self.chunk[b:e])

    @classmethod
    def joined(cls, parts: list[Strings], put: dict[str, np.ufunc]) -> Strings:
        """One after another; a string that ends one part and begins the next is one."""
        if len(parts) == 1:
            return parts[0]
        count = np.cumsum([0, *(len(p.bucket) for p in parts)])
        new = np.ones(count[-1], bool)
        for before, after, at in zip(parts[:-1], parts[1:], count[1:-1], strict=True):
            same = before.bucket[-1] == after.bucket[0] and np.array_equal(before.data[before.offsets[-2] :], after.data[: after.offsets[1]])
            new[at] = not same
        begin = np.flatnonzero(new)
        put_end = lambda arrays, ends: np.concatenate([a[:-1] + e for a, e in zip(arrays, ends, strict=True)])
        starts = put_end([p.offsets for p in parts], np.cumsum([0, *(len(p.data) for p in parts[:-1])]))
        sizes = np.concatenate([np.diff(p.offsets) for p in parts])
        first = put_end([p.first for p in parts], np.cumsum([0, *(len(p.chunk) for p in parts[:-1])]))
        chunk = np.concatenate([p.chunk for p in parts])
        values = {n: f.reduceat(np.concatenate([p.values[n] for p in parts]), begin) for n, f in put.items()}
        data = gathered(np.concatenate([p.data for p in parts]), starts[begin], (starts + sizes)[begin])
        return cls(np.concatenate([p.bucket for p in parts])[begin], *data, values, np.append(first[begin], len(chunk)), chunk)


def distinct_strings(batches: Iterator[pa.RecordBatch], put: dict[str, np.ufunc], limit: int = 1 << 20) -> Iterator[Strings]:
    """Whole buckets, of about `limit` bytes of distinct strings or one bucket, from batches sorted by bucket and packed.

    A string that many chunks have is held once, with eight bytes for each of them.
    """
    held: list[Strings] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        now, begin = Strings.of(batch, put), 0
        edges = np.flatnonzero(np.append(not held or held[-1].bucket[-1] != now.bucket[0], now.bucket[1:] != now.bucket[:-1]))
        while len(edges):
            k = int(np.searchsorted(now.offsets[edges], now.offsets[begin] + limit - size))
            if k == len(edges):
                break
            edge, edges = int(edges[k]), edges[k + 1 :]
            if edge > begin:
                held.append(now.cut(begin, edge))
            if held:
                yield Strings.joined(held, put)
            held, size, begin = [], 0, edge
        if begin < len(now.bucket):
            held.append(now.cut(begin, len(now.bucket)))
            size += len(held[-1].data)
    if held:
        yield Strings.joined(held, put)
