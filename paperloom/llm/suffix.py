"""Suffix-array deduplication: maximal repeats from the interval tree of an enhanced suffix array.

1. Documents are dealt to chunks by a hash. Of each chunk's texts the minimisers (winnowed hashes of 28 bytes) go to
   buckets as packed numbers, once a chunk; the bucket answers which of them other documents have too. A 50-byte string
   of two documents has the same minimiser in both, so only windows with a shared one can repeat.
2. Those windows travel as packed strings (super-k-mers of a shorter minimiser), equal ones of a piece once, with the
   smallest and largest id that has them, so that all suffixes with equal 50-byte prefixes meet. Hot minimisers are split
   by window.
3. Each bucket holds every distinct string once, sorts its suffixes, scans the common-prefix lengths with a stack for the
   interval tree, and keeps intervals whose suffixes differ in the byte to the left: the maximal repeat groups. Groups are
   maximal within the packed strings of their bucket, at most RUN bytes beyond the window; together they cover just the
   bytes that repeat.
4. What a bucket finds goes back to the chunks that have the string, which apply it to all its occurrences.

Equal texts are settled beforehand: all but the one with the smallest id repeat it as a whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.llm._arrow import bytes_of, mixed, pieces, powers, prefix_hash
from paperloom.llm._chunks import ANSWER, COPY, SIDE, answer_sides, answered, answers_of, buckets_for, chunk_of, chunks_for, counted_side, covered, empty_side, is_shared, merged, of_kind, row_of, shared_of
from paperloom.llm._superkmers import HOT_LEAST, HOT_MOST, HOT_SAMPLE, Strings, binary, collapsed, distinct_strings, groups, runs, second_hash, sliding, split, string_hashes
from paperloom.llm._tables import stored

LENGTH = 50
#: Bytes of the minimisers that are counted first, and of those that choose a bucket.
LONG_ANCHOR, SHORT_ANCHOR = 28, 16
#: Windows in a packed string at most.
RUN = 40
#: Chunks whose minimisers meet in one bucket, where there are many.
COUNTED_CHUNKS = 6
#: Bytes of distinct strings that are solved at once, in whole buckets.
TABLE_BYTES = 1 << 20


def _copies(docs: pa.Table, side: pa.Table) -> np.ndarray:
    """Which rows are copies of a text with a smaller id."""
    known = of_kind(side, COPY)
    pair = lambda t: list(zip(t.column("id").to_pylist(), t.column("mark").to_pylist(), strict=True))
    copies = set(pair(known))
    return np.array([p in copies for p in pair(docs)], bool)


def _texts(docs: pa.Table, copies: np.ndarray):
    rest = docs.filter(pa.array(~copies)).combine_chunks()
    for batch in rest.to_batches():
        yield from pieces(batch, "text")


def _grams(sums: np.ndarray, n: int) -> np.ndarray:
    _, back = powers(len(sums))
    return mixed((sums[n:] - sums[:-n]) * back[: len(sums) - n])


def _minimum(sums: np.ndarray, anchor: int, length: int) -> np.ndarray:
    return sliding(_grams(sums, anchor), length - anchor + 1)


def _changes(minimum: np.ndarray, row: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last window of each run of valid windows with one minimiser, unbroken within a row."""
    n = len(minimum)
    return runs(minimum, row[:n] == row[length - 1 : length - 1 + n], row[:n], np.zeros(0, np.uint64))


def _counted(docs: pa.Table, side: pa.Table, length: int, buckets: int) -> pa.Table:
    """The chunk's minimisers for each bucket: first those of one of its documents, `low` in number, then those of more."""
    chunk = (docs.column("chunk")[0] if docs.num_rows else side.column("chunk")[0]).as_py()
    found, owner, before = [], [], 0
    for piece in _texts(docs, _copies(docs, side)):
        data, offsets = bytes_of(piece.column("text"))
        if len(data) >= length:
            row = row_of(offsets)
            minimum = _minimum(prefix_hash(data), min(LONG_ANCHOR, length), length)
            begin, _, _ = _changes(minimum, row, length)
            found.append(minimum[begin])
            owner.append(row[begin] + before)
        before += piece.num_rows
    f = np.concatenate(found) if found else np.zeros(0, np.uint64)
    return counted_side(f, np.concatenate(owner), chunk, buckets) if len(f) else empty_side()


PACKED = "bucket long, packed binary, chunk long, low long, high long"
#: The smallest and the largest id of the documents that have a string.
PUT = {"low": np.minimum, "high": np.maximum}


def _strings(piece, skipped: np.ndarray, shared: np.ndarray, length: int, buckets: int, hot: np.ndarray):
    """Of the texts of a piece that aren't `skipped`: bytes, offsets, prefix sums, and of each packed string of windows
    whose minimiser is shared its first and last window, row and bucket's hash; None if there is no such window."""
    data, offsets = bytes_of(piece.column("text"))
    if len(data) < length or not len(shared):
        return None
    row, sums = row_of(offsets), (prefix_hash(data), second_hash(data))
    minimum = _minimum(sums[0], min(LONG_ANCHOR, length), length)
    begin, end, _ = _changes(minimum, row, length)
    has = is_shared(minimum[begin], shared, buckets) & ~skipped[row[begin]]
    cover = np.zeros(len(minimum) + 1, np.int64)
    cover[begin[has]] += 1
    np.add.at(cover, end[has] + 1, -1)
    valid = np.cumsum(cover[:-1]) > 0
    if not valid.any():
        return None
    minimum = _minimum(sums[0], min(SHORT_ANCHOR, length), length)
    begin, end, burning = split(*runs(minimum, valid, row[: len(minimum)], hot), RUN)
    value = minimum[begin].copy()
    if burning.any():
        value[burning] = _grams(sums[0], length)[begin[burning]]
    return data, offsets, sums, begin, end, row[begin], value


def _packed(docs: pa.Table, side: pa.Table, length: int, buckets: int, hot: np.ndarray) -> pa.Table:
    """The windows whose minimiser is shared, as packed strings, each once for a piece of the chunk."""
    shared, out = shared_of(side), []
    for piece in _texts(docs, _copies(docs, side)) if len(shared) and docs.num_rows else ():
        found = _strings(piece, np.zeros(piece.num_rows, bool), shared, length, buckets, hot)
        if found:
            data, _, sums, begin, end, of, value = found
            ids = piece.column("id").to_numpy(zero_copy_only=False)[of]
            made = collapsed(value, data, sums, begin, end + length, low=(ids, np.minimum), high=(ids, np.maximum))
            chunk = pa.array(np.full(len(made["low"]), piece.column("chunk")[0].as_py()))
            out.append(pa.RecordBatch.from_arrays([made["bucket"], made["packed"], chunk, made["low"], made["high"]], names=["bucket", "packed", "chunk", "low", "high"]))
    return pa.Table.from_batches(out, pa.schema([("bucket", pa.int64()), ("packed", pa.binary()), ("chunk", pa.int64()), ("low", pa.int64()), ("high", pa.int64())]))


def maximal_groups(data: np.ndarray, offsets: np.ndarray, least: np.ndarray, often: np.ndarray, length: int, passes: int = 1) -> tuple[np.ndarray, ...]:
    """Maximal repeats among distinct strings: string, place, length and the smallest id of the group, an entry for each
    string and place of each group. `least` has each string's smallest id; `often` says which occur in several documents.

    A string of several documents is a leaf of the tree that several suffixes share, and so a group of its own: whole, as
    what is left of it differs only at its first place. The other groups are inner nodes. Windows are dealt to `passes`
    by their hash, equal ones to the same, and each pass is solved alone, so that its arrays stay small.
    """
    leaves = np.flatnonzero(often)
    out = [(leaves, np.zeros(len(leaves), np.int64), np.diff(offsets)[leaves], least[leaves])]
    sums = prefix_hash(data), second_hash(data)
    out += [_inner_groups(data, offsets, sums, least, length, k, passes) for k in range(passes)]
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _inner_groups(data: np.ndarray, offsets: np.ndarray, sums: tuple[np.ndarray, ...], least: np.ndarray, length: int, turn: int, passes: int) -> tuple[np.ndarray, ...]:
    """Groups of the inner nodes of the interval tree.

    Only windows that occur more than once are suffixes worth sorting. Their order is that of the suffix array within
    each set of equal windows, which is all that the interval tree above `length` needs.
    """
    sizes = np.maximum(np.diff(offsets) - length + 1, 0)
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(row)) - (np.cumsum(sizes) - sizes)[row]
    at = offsets[row] + place
    _, back = powers(len(data) + 1)
    one, two = (mixed((s[at + length] - s[at]) * back[at]) for s in sums)
    if passes > 1:
        mine = one % np.uint64(passes) == turn
        row, place, at, one, two = row[mine], place[mine], at[mine], one[mine], two[mine]
    order, cut = groups(one, two)
    size = np.diff(np.append(cut, len(order)))
    group = np.repeat(np.arange(len(cut)), size)
    often = np.repeat(size > 1, size)
    suffix, group = order[often], group[often]
    none = np.zeros(0, np.int64)
    if not len(suffix):
        return none, none, none, none
    # What follows the window, in words of eight bytes whose order as numbers is that of the bytes.
    rest = offsets[row[suffix] + 1] - at[suffix] - length
    width = (RUN + 7) // 8 * 8
    column = np.arange(width)
    tail = np.zeros((len(suffix), width), np.uint8)
    for i in range(0, len(suffix), 1 << 16):
        part = slice(i, i + (1 << 16))
        index = (at[suffix[part]] + length)[:, None] + column
        tail[part] = np.where(column < rest[part, None], data[np.minimum(index, len(data) - 1)], 0)
    words = tail.view(">u8")
    order = np.lexsort((rest, *(words[:, k] for k in reversed(range(words.shape[1]))), group))
    suffix, group, tail, rest = suffix[order], group[order], tail[order], rest[order]
    common = np.zeros(len(suffix), np.int64)  # with the suffix before, beyond `length`; -1 where another window begins
    for i in range(1, len(suffix), 1 << 16):
        part, last = slice(i, min(i + (1 << 16), len(suffix))), slice(i - 1, min(i + (1 << 16), len(suffix)) - 1)
        differs = tail[part] != tail[last]
        common[part] = np.minimum(np.where(differs.any(1), differs.argmax(1), width), np.minimum(rest[part], rest[last]))
    begin = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    finish = np.append(begin[1:], len(suffix))
    common[begin] = -1
    # The byte to the left; at the start of a packed string the window before is in another bucket, so none are equal.
    left = np.where(place[suffix] > 0, data[np.maximum(at[suffix] - 1, 0)].astype(np.int64), -1 - np.arange(len(suffix)))
    diverse = np.minimum.reduceat(left, begin) != np.maximum.reduceat(left, begin)
    low = least[row[suffix]]
    inner = np.where(common < 0, 1 << 40, common)
    smallest, largest = np.minimum.reduceat(inner, begin), np.maximum.reduceat(common, begin)
    flat = diverse & (smallest == largest)
    lo, hi, deep = [begin[flat]], [finish[flat]], [smallest[flat]]
    for b, e in zip(begin[diverse & ~flat], finish[diverse & ~flat], strict=True):
        stack = []  # (common prefix, first suffix)
        heights = [*common[b + 1 : e].tolist(), -1]
        nodes = []
        for i, height in enumerate(heights, b):
            start = i
            while stack and stack[-1][0] > height:
                h, start = stack.pop()
                nodes.append((start, i + 1, h))
            if height >= 0 and (not stack or stack[-1][0] < height):
                stack.append((height, start))
        nodes = [n for n in nodes if left[n[0] : n[1]].min() != left[n[0] : n[1]].max()]
        lo.append(np.array([n[0] for n in nodes], np.int64)), hi.append(np.array([n[1] for n in nodes], np.int64)), deep.append(np.array([n[2] for n in nodes], np.int64))
    lo, hi, deep = (np.concatenate(x).astype(np.int64) for x in (lo, hi, deep))
    if not len(lo):
        return none, none, none, none
    sizes = hi - lo
    member = np.repeat(lo - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
    smallest = np.minimum.reduceat(low[member], np.cumsum(sizes) - sizes)
    return row[suffix[member]], place[suffix[member]], np.repeat(deep, sizes) + length, np.repeat(smallest, sizes)


def _solved(strings: Strings, length: int, limit: int):
    """What to tell the chunks of a bucket's strings: ranges that repeat a string of a document with a smaller id."""
    low, high = strings.values["low"], strings.values["high"]
    string, place, size, least = maximal_groups(strings.data, strings.offsets, low, high > low, length, -(-len(strings.data) // limit))
    use = least < high[string]
    string, place, size, least = string[use], place[use], size[use], least[use]
    if not len(string):
        return
    order = np.lexsort((least, string))
    string, place, size, least = string[order], place[order], size[order], least[order]
    same = np.cumsum(np.append(0, (string[1:] != string[:-1]) | (least[1:] != least[:-1])))
    first = np.flatnonzero(np.append(True, same[1:] != same[:-1]))
    of, begin, end = merged(same, place, place + size)
    records = np.zeros(len(of), ANSWER)
    records["key"] = string_hashes((prefix_hash(strings.data),), strings.offsets[:-1], strings.offsets[1:])[0][string[first[of]]]
    records["id"], records["low"], records["high"] = least[first[of]], begin, end
    yield from answer_sides(strings, string[first[of]], records)


def _kept(docs: pa.Table, side: pa.Table, length: int, buckets: int, hot: np.ndarray, whole: bool, carried: list[str]) -> pa.Table:
    names, types = ["id", "mark", "n_bytes", "n_removed", "n_spans", "kept", *carried], [*[pa.int64()] * 5, pa.binary(), *(docs.schema.field(c).type for c in carried)]
    answers, shared = answers_of(side), shared_of(side)
    copies, out, done = _copies(docs, side), [], 0
    shared = shared if len(answers) else shared[:0]
    for batch in docs.to_batches():
        for piece in pieces(batch, "text"):
            data, offsets = bytes_of(piece.column("text"))
            gone = np.zeros(len(data), bool)
            copied = copies[done : done + piece.num_rows]
            found = _strings(piece, copied, shared, length, buckets, hot)
            if found:
                _, _, sums, begin, end, of, _ = found
                ids = piece.column("id").to_numpy(zero_copy_only=False)[of]
                gone = covered(answers, string_hashes(sums[:1], begin, end + length)[0], ids, begin, len(data))
            gone |= np.repeat(copied & (np.diff(offsets) >= length), np.diff(offsets))
            if whole and gone.any():
                # A character of several bytes goes only if all of them are covered.
                head = np.flatnonzero((data & 0xC0) != 0x80)
                gone = np.repeat(np.logical_and.reduceat(gone, head), np.diff(np.append(head, len(data))))
            row, n = row_of(offsets), piece.num_rows
            start = gone.copy()
            start[1:] &= ~gone[:-1] | (row[1:] != row[:-1])
            removed = np.bincount(row[gone], minlength=n)
            size = np.diff(offsets)
            kept = binary(data[~gone], np.append(0, np.cumsum(size - removed)))
            out.append(pa.RecordBatch.from_arrays([piece.column("id"), piece.column("mark"), *(pa.array(x.astype(np.int64)) for x in (size, removed, np.bincount(row[start], minlength=n))), kept, *(piece.column(c) for c in carried)], names=names))
            done += n
    return pa.Table.from_batches(out, pa.schema(list(zip(names, types, strict=True))))


def _hot(docs: DataFrame, length: int) -> np.ndarray:
    """The most frequent minimisers, by documents, of a sample of the documents; HOT_MOST of them at most."""

    def found(batches):
        for batch in batches:
            for piece in pieces(batch, "text"):
                data, offsets = bytes_of(piece.column("text"))
                if len(data) >= length:
                    row = row_of(offsets)
                    minimum = _minimum(prefix_hash(data), min(SHORT_ANCHOR, length), length)
                    begin, _, _ = _changes(minimum, row, length)
                    pair = np.unique(np.column_stack([minimum[begin], row[begin].astype(np.uint64)]), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pair[:, 0]).view(np.int64))], names=["bucket"])

    sample = docs.where(F.pmod(F.xxhash64("id", "mark"), F.lit(HOT_SAMPLE)) == 0).select("text")
    counts = sample.mapInArrow(found, "bucket long").groupBy("bucket").count().where(f"count >= {HOT_LEAST}")
    rows = counts.orderBy(F.desc("count"), "bucket").limit(HOT_MOST).collect()
    return np.array([r["bucket"] for r in rows], np.int64).view(np.uint64)


def remove_repeats(documents: DataFrame, id: str = "doc_id", text: str = "text", length: int = LENGTH, whole_characters: bool = False, keep: list[str] = ()) -> DataFrame:
    """id, mark (a hash of the text), n_bytes, n_removed, n_spans (maximal removed runs) and kept (binary), a row a document.

    A byte of a text, as UTF-8, goes if a string of `length` bytes covers it that also starts in a document with a smaller
    id; strings are judged on the input. With `whole_characters` a character stays unless all its bytes go. Null texts
    are empty. Rows that repeat an id are documents of their own, none smaller than another. Rows with a null id count as
    one smaller than all others. The columns `keep` are carried along; other columns are ignored.
    """
    null = F.lit(-(1 << 62))
    docs = documents.select(F.coalesce(F.col(id).cast("long"), null).alias("id"), F.coalesce(text, F.lit("")).alias("text"), *(F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)))
    docs = docs.withColumn("mark", F.xxhash64("text"))
    carried = [f"keep_{i}" for i in range(len(keep))]
    light = stored(docs.select("id", "mark", F.unhex(F.sha2("text", 256)).alias("digest"), F.octet_length("text").alias("n")), "digests")
    chunks = chunks_for(light)
    chunk = chunk_of(chunks)
    hot = _hot(docs, length)
    docs = docs.withColumn("chunk", chunk).repartition("chunk")
    lows = light.groupBy("digest").agg(F.min("id").alias("low"))
    copies = light.join(lows, "digest").where("id > low").select(chunk.alias("chunk"), F.lit(COPY).alias("kind"), "id", "mark", F.lit(0).cast("long").alias("low"), F.lit(None).cast("binary").alias("blob")).distinct()

    buckets = buckets_for(chunks, COUNTED_CHUNKS)
    by_chunk = docs.groupBy("chunk")
    counted = by_chunk.cogroup(copies.groupBy("chunk")).applyInArrow(lambda d, s: _counted(d, s, length, buckets), SIDE)
    answers = counted.groupBy("id").applyInArrow(answered, SIDE)
    sides = copies.unionByName(answers)
    packed = by_chunk.cogroup(sides.groupBy("chunk")).applyInArrow(lambda d, s: _packed(d, s, length, buckets, hot), PACKED)

    def solving(batches):
        for strings in distinct_strings(batches, PUT, TABLE_BYTES):
            yield from _solved(strings, length, 2 * TABLE_BYTES)

    found = packed.repartition("bucket").sortWithinPartitions("bucket", "packed").mapInArrow(solving, SIDE)
    schema = T._parse_datatype_string("id long, mark long, n_bytes long, n_removed long, n_spans long, kept binary")
    schema = T.StructType([*schema.fields, *(T.StructField(c, docs.schema[c].dataType) for c in carried)])
    kept = by_chunk.cogroup(sides.unionByName(found).groupBy("chunk")).applyInArrow(lambda d, s: _kept(d, s, length, buckets, hot, whole_characters, carried), schema)
    return kept.select(F.nullif("id", null).alias(id), "mark", "n_bytes", "n_removed", "n_spans", "kept", *(F.col(c).alias(n) for c, n in zip(carried, keep, strict=True)))
