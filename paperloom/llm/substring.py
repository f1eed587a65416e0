"""Substring deduplication by super-k-mer partitioning.

Every window of 35 words has a minimiser, the smallest hash of its word triples. Consecutive windows that share it travel
as one packed string to the minimiser's bucket, where sorting the windows counts them exactly: equal windows always meet,
each in one bucket. Longer minimisers, of 16 words, are counted beforehand, as packed numbers, and windows whose own is at
a single place stay at home: they can't repeat. Equal packed strings of a piece of input travel once, with their number;
the bucket's answer goes to the chunk, which applies it to all their places. The windows of hot minimisers travel one by
one to buckets of their own hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm._arrow import bytes_of, pieces, prefix_hash, span_hash, spans
from paperloom.llm._chunks import ANSWER, SIDE, answer_sides, answered, answers_of, buckets_for, chunk_of, chunks_for, counted_side, covered, empty_side, is_shared, shared_of
from paperloom.llm._superkmers import HOT_LEAST, HOT_MOST, HOT_SAMPLE, Strings, binary, collapsed, distinct_strings, gathered, groups, runs, second_hash, sliding, split, string_hashes

WINDOW = 35
#: Words of the minimisers that are counted first, which little but a repeated passage shares, and of those that choose a
#: bucket.
COUNTED, ANCHOR = 16, 3
#: Windows in a packed string at most.
RUN = 64
#: Chunks whose minimisers meet in one bucket, where there are many.
COUNTED_CHUNKS = 32
#: Bytes of distinct strings that are solved at once, in whole buckets.
TABLE_BYTES = 2 << 20
#: Below every document's number: what is found holds for all of them.
ALL = -1


def _canonical(column: pa.Array):
    """Words with one space after each: bytes, start and end of each word in them, its row."""
    data, offsets = bytes_of(column)
    starts, ends, row = spans(data, offsets)
    joined, cuts = gathered(np.append(data, np.uint8(0x20)), starts, ends + 1)
    if len(cuts) > 1:
        joined[cuts[1:] - 1] = 0x20
    return joined, cuts[:-1], cuts[1:] - 1, row


class _Words:
    """The words of a piece of documents and the minimisers of their windows."""

    def __init__(self, column: pa.Array, window: int):
        self.data, self.starts, self.ends, self.row = _canonical(column)
        self.window, self.sums = window, prefix_hash(self.data)
        self.n = max(0, len(self.starts) - window + 1)
        self.valid = self.row[: self.n] == self.row[window - 1 :]

    def grams(self, anchor: int) -> np.ndarray:
        """A hash of each `anchor` consecutive words, or of the whole window if it is shorter."""
        anchor = min(anchor, self.window)
        return span_hash(self.sums, self.starts[: len(self.starts) - anchor + 1], self.ends[anchor - 1 :])

    def minimum(self, anchor: int) -> np.ndarray:
        return sliding(self.grams(anchor), self.window - min(anchor, self.window) + 1)

    def chosen(self, anchor: int) -> np.ndarray:
        """The grams that are the minimiser of some window, one for each place."""
        gram, width = self.grams(anchor), self.window - min(anchor, self.window) + 1
        edge = np.zeros(width - 1, np.uint64)
        most = sliding(np.concatenate([edge, np.where(self.valid, sliding(gram, width), np.uint64(0)), edge]), width, np.maximum)
        return gram[(gram == most) & (most > 0)]

    def strings(self, shared: np.ndarray, buckets: int, hot: np.ndarray):
        """Of each packed string of windows whose minimiser is shared its first word, first and last byte, row and
        bucket's hash; None without such windows."""
        if not self.n or not len(shared):
            return None
        minimum, owner = self.minimum(COUNTED), self.row[: self.n]
        begin, end, _ = runs(minimum, self.valid, owner, np.zeros(0, np.uint64))
        has = is_shared(minimum[begin], shared, buckets)
        if not has.any():
            return None
        cover = np.zeros(self.n + 1, np.int64)
        cover[begin[has]] += 1
        np.add.at(cover, end[has] + 1, -1)
        minimum = self.minimum(ANCHOR)
        begin, end, burning = split(*runs(minimum, np.cumsum(cover[:-1]) > 0, owner, hot), RUN)
        a, z = self.starts[begin], self.ends[end + self.window - 1]
        value = minimum[begin].copy()
        value[burning] = span_hash(self.sums, a[burning], z[burning])
        return begin, a, z, self.row[begin], value


def _counted(docs: pa.Table, window: int, buckets: int) -> pa.Table:
    """The chunk's minimisers for each bucket; each place is an owner of its own."""
    found = []
    for batch in docs.combine_chunks().to_batches():
        for piece in pieces(batch, "text"):
            words = _Words(piece.column("text"), window)
            if words.n:
                found.append(words.chosen(COUNTED))
    f = np.concatenate(found) if found else np.zeros(0, np.uint64)
    return counted_side(f, np.arange(len(f)), docs.column("chunk")[0].as_py(), buckets) if len(f) else empty_side()


PACKED = "bucket long, packed binary, chunk long, times long"
#: How often a string occurs.
PUT = {"times": np.add}


def _packed(docs: pa.Table, side: pa.Table, window: int, buckets: int, hot: np.ndarray) -> pa.Table:
    """Windows whose minimiser occurs elsewhere, as packed strings, each once for a piece of the chunk."""
    shared, out = shared_of(side), []
    for batch in docs.combine_chunks().to_batches() if len(shared) else ():
        for piece in pieces(batch, "text"):
            words = _Words(piece.column("text"), window)
            found = words.strings(shared, buckets, hot)
            if found:
                _, a, z, _, value = found
                made = collapsed(value, words.data, (words.sums, second_hash(words.data)), a, z, times=(np.ones(len(a), np.int64), np.add))
                chunk = pa.array(np.full(len(made["times"]), piece.column("chunk")[0].as_py()))
                out.append(pa.RecordBatch.from_arrays([made["bucket"], made["packed"], chunk, made["times"]], names=["bucket", "packed", "chunk", "times"]))
    return pa.Table.from_batches(out, pa.schema([("bucket", pa.int64()), ("packed", pa.binary()), ("chunk", pa.int64()), ("times", pa.int64())]))


def _solved(strings: Strings, window: int):
    """What to tell the chunks of a bucket's strings: their words in windows that occur more than once."""
    data, starts, ends, row = _canonical(pa.Array.from_buffers(pa.large_binary(), len(strings.bucket), [None, pa.py_buffer(strings.offsets), pa.py_buffer(strings.data)]))
    first = np.searchsorted(row, np.arange(len(strings.bucket)))
    n = len(starts) - window + 1
    begin = np.flatnonzero(row[:n] == row[window - 1 :])
    sums = prefix_hash(data), second_hash(data)
    a, z = starts[begin], ends[begin + window - 1]
    order, cut = groups(span_hash(sums[0], a, z), span_hash(sums[1], a, z))
    total = np.add.reduceat(strings.values["times"][row[begin]][order], cut)
    twice = np.zeros(len(begin), bool)
    twice[order] = np.repeat(total > 1, np.diff(np.append(cut, len(order))))
    # Runs of repeated windows within a string.
    at, string = begin[twice], row[begin[twice]]
    if not len(at):
        return
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (string[1:] != string[:-1])
    lo = np.flatnonzero(new)
    hi, string = np.append(lo[1:], len(at)) - 1, string[lo]
    records = np.zeros(len(lo), ANSWER)
    records["key"] = string_hashes((prefix_hash(strings.data),), strings.offsets[:-1], strings.offsets[1:])[0][string]
    records["id"], records["low"], records["high"] = ALL, at[lo] - first[string], at[hi] - first[string] + window
    yield from answer_sides(strings, string, records)


def _kept(docs: pa.Table, side: pa.Table, window: int, buckets: int, hot: np.ndarray) -> pa.Table:
    names, types = ["id", "n_words", "n_removed", "kept"], [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    answers, shared, out = answers_of(side), shared_of(side), []
    shared = shared if len(answers) else shared[:0]
    for batch in docs.combine_chunks().to_batches():
        for piece in pieces(batch, "text"):
            words = _Words(piece.column("text"), window)
            stays = np.ones(len(words.starts), bool)
            found = words.strings(shared, buckets, hot)
            if found:
                begin, a, z, _, _ = found
                stays = ~covered(answers, string_hashes((words.sums,), a, z)[0], np.zeros(len(a), np.int64), begin, len(stays))
            count = np.bincount(words.row, minlength=piece.num_rows)
            kept_count = np.bincount(words.row[stays], minlength=piece.num_rows)
            joined, cuts = gathered(words.data, words.starts[stays], words.ends[stays] + 1)
            # Each document's words with a space after each, without the last space.
            edge = np.append(0, np.cumsum(kept_count))
            text, offsets = gathered(joined, cuts[edge[:-1]], cuts[edge[1:]] - (kept_count > 0))
            out.append(pa.RecordBatch.from_arrays([piece.column("id"), pa.array(count), pa.array(count - kept_count), binary(text, offsets).cast(pa.string())], names=names))
    return pa.Table.from_batches(out, pa.schema(list(zip(names, types, strict=True))))


def remove_repeats(documents: DataFrame, id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """id, n_words, n_removed and kept (the words that stay, joined by one space), a row a document.

    A word goes if a window of `window` consecutive words of its document covers it whose word sequence starts anywhere
    else too, in the same document or another; all windows are judged on the input. Null texts have no words. Rows that
    repeat an id, or whose id is null, are documents of their own (an id is only carried along). Other columns are
    ignored. Words are runs of other than the six white-space bytes 0x20 and 0x09-0x0D, unchanged.
    """
    null = F.lit(-(1 << 62))
    docs = documents.select(F.coalesce(F.col(id).cast("long"), null).alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    docs = docs.withColumn("mark", F.xxhash64("text"))
    chunks = chunks_for(docs.select(F.octet_length("text").alias("n")))
    hot = _hot(docs, window)
    buckets = buckets_for(chunks, COUNTED_CHUNKS)
    by_chunk = docs.withColumn("chunk", chunk_of(chunks)).repartition("chunk").groupBy("chunk")
    counted = by_chunk.applyInArrow(lambda d: _counted(d, window, buckets), SIDE)
    answers = counted.groupBy("id").applyInArrow(answered, SIDE)
    packed = by_chunk.cogroup(answers.groupBy("chunk")).applyInArrow(lambda d, s: _packed(d, s, window, buckets, hot), PACKED)

    def solving(batches):
        for strings in distinct_strings(batches, PUT, TABLE_BYTES):
            yield from _solved(strings, window)

    found = packed.repartition("bucket").sortWithinPartitions("bucket", "packed").mapInArrow(solving, SIDE)
    sides = answers.unionByName(found)
    kept = by_chunk.cogroup(sides.groupBy("chunk")).applyInArrow(lambda d, s: _kept(d, s, window, buckets, hot), "id long, n_words long, n_removed long, kept string")
    return kept.select(F.nullif("id", null).alias(id), "n_words", "n_removed", "kept")


def _hot(docs: DataFrame, window: int) -> np.ndarray:
    """The most frequent minimisers of a sample of the documents; HOT_MOST of them at most."""

    def found(batches):
        for batch in batches:
            for piece in pieces(batch, "text"):
                words = _Words(piece.column("text"), window)
                if words.n:
                    yield pa.RecordBatch.from_arrays([pa.array(words.chosen(ANCHOR).view(np.int64))], names=["bucket"])

    sample = docs.where(F.pmod(F.xxhash64("id", "mark"), F.lit(HOT_SAMPLE)) == 0).select("text")
    counts = sample.mapInArrow(found, "bucket long").groupBy("bucket").count().where(f"count >= {HOT_LEAST}")
    rows = counts.orderBy(F.desc("count"), "bucket").limit(HOT_MOST).collect()
    return np.array([r["bucket"] for r in rows], np.int64).view(np.uint64)
