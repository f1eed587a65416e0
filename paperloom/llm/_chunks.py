"""Chunks of documents that ask buckets about hashes, and what they are told.

Documents are dealt to chunks by a hash. A chunk sends its hashes to buckets as packed numbers, each once; a bucket
answers every chunk with those that occur elsewhere too. Strings travel to buckets with the chunk that has them, once for a
chunk's many occurrences; what a bucket finds goes back to these chunks by the string's hash, and the chunk, which works out
its strings anew, knows where they are. So no task holds all occurrences of a string. All side tables have the columns SIDE.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm._superkmers import Strings, binary

#: Bytes of text in a chunk.
CHUNK_BYTES = 4 << 20
#: Buckets that chunks ask are as many as the chunks up to this number.
LEAST_BUCKETS = 64

SIDE = "chunk long, kind int, id long, mark long, low long, blob binary"
COPY, SHARED, COVER = 0, 1, 2


def side_rows(rows: dict[str, object], n: int) -> pa.RecordBatch:
    zero = pa.array(np.zeros(n, np.int64))
    return pa.RecordBatch.from_arrays(
        [rows.get("chunk", zero), pa.array(np.full(n, rows["kind"], np.int32)), rows.get("id", zero), rows.get("mark", zero), rows.get("low", zero), rows.get("blob", pa.nulls(n, pa.binary()))],
        names=["chunk", "kind", "id", "mark", "low", "blob"],
    )


def of_kind(side: pa.Table, kind: int) -> pa.Table:
    return side.filter(pc.equal(side.column("kind"), kind))


def empty_side() -> pa.Table:
    return pa.Table.from_batches([side_rows({"kind": SHARED}, 0)])


def chunk_of(chunks: int) -> Column:
    """The chunk of a row with id and mark (a hash of its text)."""
    return F.pmod(F.col("mark").bitwiseXOR(F.shiftleft("id", 17)).bitwiseXOR(F.col("id")), F.lit(chunks)).cast("long")


def chunks_for(sizes: DataFrame) -> int:
    """So many chunks that each has about CHUNK_BYTES of text (column n)."""
    return max(1, -(-(sizes.agg(F.sum("n")).first()[0] or 0) // CHUNK_BYTES))


def buckets_for(chunks: int, each: int) -> int:
    """Buckets that answer `chunks`: one for `each` chunks where there are many, so that a chunk asks few buckets for much."""
    return min(chunks, max(LEAST_BUCKETS, chunks // each))


def row_of(offsets: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def _places(f: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    return ((f >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64), (f & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def counted_side(f: np.ndarray, owner: np.ndarray, chunk: int, buckets: int) -> pa.Table:
    """A chunk's hashes `f` for each bucket: first those of one owner, `low` in number, then those of more."""
    order = np.lexsort((owner, f)) if len(owner) and np.any(owner[1:] < owner[:-1]) else np.argsort(f, kind="stable")
    f, owner = f[order], owner[order]
    new = np.append(True, f[1:] != f[:-1])
    more = np.zeros(len(f), bool)
    more[1:] = ~new[1:] & (owner[1:] != owner[:-1])
    begin = np.flatnonzero(new)
    many = np.logical_or.reduceat(more, begin)
    bucket, rest = _places(f[begin], buckets)
    order = np.lexsort((many, bucket))
    bucket, rest, many = bucket[order], rest[order], many[order]
    cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    single = np.add.reduceat((~many).astype(np.int64), cut)
    blob = binary(rest.view(np.uint8), np.append(cut, len(rest)) * 4)
    return pa.Table.from_batches([side_rows({"kind": SHARED, "chunk": pa.array(np.full(len(cut), chunk)), "id": pa.array(bucket[cut]), "low": pa.array(single), "blob": blob}, len(cut))])


def answered(table: pa.Table) -> pa.Table:
    """For each chunk of a bucket, those of its hashes that two owners have."""
    bucket = table.column("id")[0].as_py()
    blobs = [np.frombuffer(b, np.uint32) for b in table.column("blob").to_pylist()]
    sizes = np.array([len(b) for b in blobs])
    values = np.concatenate(blobs)
    at = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    weight = 1 + (at >= np.repeat(table.column("low").to_numpy(), sizes))
    order = np.argsort(values, kind="stable")
    cut = np.flatnonzero(np.append(True, values[order][1:] != values[order][:-1]))
    total = np.add.reduceat(weight[order], cut)
    keep = np.zeros(len(values), bool)
    keep[order] = np.repeat(total > 1, np.diff(np.append(cut, len(values))))
    kept = np.add.reduceat(keep.astype(np.int64), np.cumsum(sizes) - sizes)
    blob = binary(values[keep].view(np.uint8), np.append(0, np.cumsum(kept)) * 4)
    n = table.num_rows
    return pa.Table.from_batches([side_rows({"kind": SHARED, "chunk": table.column("chunk").combine_chunks(), "id": pa.array(np.full(n, bucket)), "blob": blob}, n)])


def shared_of(side: pa.Table) -> np.ndarray:
    """All hashes of a chunk that occur elsewhere, as `is_shared` looks them up."""
    answers = of_kind(side, SHARED)
    shared = [np.frombuffer(b, np.uint32).astype(np.uint64) | np.uint64(k << 32) for k, b in zip(answers.column("id").to_pylist(), answers.column("blob").to_pylist(), strict=True)]
    return np.sort(np.concatenate(shared)) if shared else np.zeros(0, np.uint64)


def is_shared(f: np.ndarray, shared: np.ndarray, buckets: int) -> np.ndarray:
    bucket, rest = _places(f, buckets)
    key = rest.astype(np.uint64) | (bucket.astype(np.uint64) << np.uint64(32))
    return shared[np.minimum(np.searchsorted(shared, key), len(shared) - 1)] == key


def merged(doc: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of `doc` (any number), in order and without overlaps."""
    order = np.lexsort((low, doc))
    doc, low, high = doc[order], low[order], high[order]
    shift = np.cumsum(np.append(0, doc[1:] != doc[:-1])) << 33 if len(doc) else doc
    reach = np.maximum.accumulate(high + shift)
    first = np.flatnonzero(np.append(True, low[1:] + shift[1:] > reach[:-1])) if len(doc) else doc
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], low[first], (reach[last] - shift[last]) if len(doc) else high


#: What a bucket says of a string: its hash, and that the range [low, high) of its items goes from documents above `id`.
ANSWER = np.dtype([("key", "<u8"), ("id", "<i8"), ("low", "<u4"), ("high", "<u4")])


def answer_sides(strings: Strings, string: np.ndarray, records: np.ndarray) -> Iterator[pa.RecordBatch]:
    """`records` (ANSWER) of the strings with the numbers `string`, for each chunk that has the string, packed."""
    order = np.argsort(string, kind="stable")
    records, begin = records[order], np.searchsorted(string[order], np.arange(len(strings.bucket) + 1))
    of = np.repeat(np.arange(len(strings.bucket)), np.diff(strings.first))
    asked = np.flatnonzero(np.diff(begin)[of])
    for i in range(0, len(asked), 1 << 15):
        part = asked[i : i + (1 << 15)]
        part = part[np.argsort(strings.chunk[part], kind="stable")]
        times = np.diff(begin)[of[part]]
        entry = np.repeat(begin[of[part]] - np.cumsum(times) + times, times) + np.arange(times.sum())
        chunk = strings.chunk[part]
        cut = np.flatnonzero(np.append(True, chunk[1:] != chunk[:-1]))
        ends = np.append((np.cumsum(times) - times)[cut], len(entry)) * ANSWER.itemsize
        yield side_rows({"kind": COVER, "chunk": pa.array(chunk[cut]), "blob": binary(records[entry].view(np.uint8), ends)}, len(cut))


def answers_of(side: pa.Table) -> np.ndarray:
    """All that buckets have said to a chunk, by hash."""
    blobs = [np.frombuffer(b, ANSWER) for b in of_kind(side, COVER).column("blob").to_pylist()]
    all = np.concatenate(blobs) if blobs else np.zeros(0, ANSWER)
    return all[np.argsort(all["key"], kind="stable")]


def covered(answers: np.ndarray, key: np.ndarray, id: np.ndarray, begin: np.ndarray, n: int) -> np.ndarray:
    """Which of `n` items go, given the hash, document and first item of each string."""
    lo, hi = (np.searchsorted(answers["key"], key, s) for s in ("left", "right"))
    times = hi - lo
    entry = np.repeat(lo - np.cumsum(times) + times, times) + np.arange(times.sum())
    base, mine = np.repeat(begin, times), np.repeat(id, times) > answers["id"][entry]
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, (base + answers["low"][entry])[mine], 1)
    np.add.at(cover, (base + answers["high"][entry])[mine], -1)
    return np.cumsum(cover[:-1]) > 0
