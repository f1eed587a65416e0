"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

Texts are cut into words (the matches of a pattern), each with its position. Tasks gather documents to chunks; a chunk keeps
the numbers of its words in the order of their positions and sends each distinct word once, packed with others, to the
bucket of the word's hash. A bucket encodes each distinct word that any chunk has once and answers every chunk with the ids
of its words. The chunk, put together again by position, has the ids of its documents. Numbers by position and packed words
cross the network once each; a word that all documents have is one entry a chunk in one bucket, as any other.
Decoding joins ids with the table of tokens' bytes, which is as large as the vocabulary and goes to all tasks.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.llm._arrow import bytes_of, pieces, prefix_hash, span_hash, text_of
from paperloom.llm._chunks import buckets_for
from paperloom.llm._superkmers import binary

#: Bytes of text in a chunk; a longer text is a chunk of its own.
CHUNK_BYTES = 16 << 20
#: Chunks for each bucket where there are many.
BUCKET_CHUNKS = 8
#: Words of this many characters and more are found one by one, so that their list is never whole in memory.
LONG_TEXT = 1 << 20
#: Word positions, or bytes of ids, that one vectorized pass holds.
PASS = 1 << 20
#: The table of tokens' bytes must not be larger, since every task holds it.
TABLE_BYTES = 64 << 20

ROW = "place long, at int, n long, chunk long, low long, blob binary"


def ranks(path: str) -> dict[bytes, int]:
    """The tokens of a rank file: a token in base 64 and its rank, which is its id, on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Words:
    """Cuts texts into words as the tiktoken library does, and encodes words."""

    #: Stand-ins for letters, digits, and what is neither, in texts with code points that the two libraries class differently.
    STAND_INS = {r"\p{L}": "a", r"\p{N}": "0"}

    def __init__(self, path: str, pattern: str):
        table = ranks(path)
        coder = lambda p: tiktoken.Encoding("words", pat_str=p, mergeable_ranks=table, special_tokens={})
        self.piece = coder(pattern)._encode_single_piece
        # Python's \s has four separators that the Unicode property hasn't.
        own = pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
        self.pattern = regex.compile(own, regex.V0)
        # Code points whose class in tiktoken's tables differs from that here: their texts are cut with stand-ins.
        every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
        there, here = {}, {}
        for cls, stand_in in self.STAND_INS.items():
            judge = coder(cls)
            there |= dict.fromkeys(judge.decode_bytes(judge.encode_ordinary(every)).decode(), stand_in)
            here |= dict.fromkeys(regex.findall(cls, every), stand_in)
        self.swap = {ord(c): there.get(c, "!") for c in there.keys() | here.keys() if there.get(c) != here.get(c)}
        self.odd = np.zeros(0x110000, bool)
        self.odd[list(self.swap)] = True

    def of(self, text: str) -> Iterator[str] | list[str]:
        """The words of a text in order."""
        if not text.isascii() and self.odd[np.frombuffer(text.encode("utf-32-le"), "<u4")].any():
            spans = (m.span() for m in self.pattern.finditer(text.translate(self.swap)))
            return (text[a:b] for a, b in spans)
        return self.pattern.findall(text) if len(text) < LONG_TEXT else (m[0] for m in self.pattern.finditer(text))


@functools.lru_cache(2)
def words_of(path: str, pattern: str) -> Words:
    return Words(path, pattern)


class _Numbers(dict):
    """Numbers words by first occurrence."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of bytes or unsigned 32-bit integers, compressed; integers byte plane by byte plane."""
    head = np.array([len(a) * (1 if a.dtype == np.uint8 else -1) for a in arrays], "<i8")
    planes = [a if a.dtype == np.uint8 else a.astype("<u4").view(np.uint8).reshape(-1, 4).T.ravel() for a in arrays]
    data = np.concatenate([head.view(np.uint8), *planes]).tobytes()
    return len(data).to_bytes(8, "little") + bytes([len(arrays)]) + pa.compress(data, codec="zstd", asbytes=True)


def unpacked(blob: bytes) -> list[np.ndarray]:
    size, n = int.from_bytes(blob[:8], "little"), blob[8]
    data = np.frombuffer(pa.decompress(blob[9:], size, codec="zstd"), np.uint8)
    at, out = 8 * n, []
    for k in data[:at].view("<i8").tolist():
        if k > 0:
            out.append(data[at : at + k])
            at += k
        else:
            out.append(np.ascontiguousarray(data[at : at - 4 * k].reshape(4, -k).T).reshape(-1).view("<u4") if k else np.zeros(0, "<u4"))
            at -= 4 * k
    return out


def _flat(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of each run."""
    ends = np.cumsum(counts)
    return np.repeat(starts - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)


def encode(df: DataFrame, path: str, pattern: str | None = None, text: str = "text", ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """`keep` (all columns if None) and `ids`, binary: the ids of the whole text as little-endian unsigned 32-bit integers.

    `path` names a rank file, `pattern` cuts texts into words (public_tokenizers.PATTERN if None); special tokens are not
    looked for. A null text counts as empty; an empty text has no ids (empty binary). Repeated rows are encoded alike, each a
    row of its own. A kept column named `ids` is replaced. An empty table gives an empty one.
    """
    if pattern is None:
        from public_tokenizers import PATTERN as pattern
    kept = [f for f in df.schema.fields if (keep is None or f.name in keep) and f.name != ids]
    own = [T.StructField(f"k{i}", f.dataType, True) for i, f in enumerate(kept)]
    schema = T.StructType([*T._parse_datatype_string(ROW).fields, *own])
    total = df.agg(F.sum(F.octet_length(F.col(f"`{text}`")))).first()[0] or 0
    chunks = max(1, -(-total // CHUNK_BYTES))
    buckets = buckets_for(2 * chunks, BUCKET_CHUNKS)
    source = df.select(F.col(f"`{text}`").alias("t"), *(F.col(f"`{f.name}`").alias(k.name) for f, k in zip(kept, own, strict=True)))
    names = [k.name for k in own]

    def rows(count: int, place, **columns) -> pa.RecordBatch:
        out = {f.name: columns.get(f.name) for f in schema.fields} | {"place": pa.array(np.full(count, place) if np.isscalar(place) else place)}
        types = {"at": pa.int32(), "n": pa.int64(), "chunk": pa.int64(), "low": pa.int64(), "blob": pa.binary()} | {k: kinds[k] for k in names}
        return pa.RecordBatch.from_arrays([pa.nulls(count, types[c]) if a is None else a for c, a in out.items()], names=list(out))

    kinds: dict[str, pa.DataType] = {}

    def chunk_rows(held: list[pa.RecordBatch], chunk: int) -> Iterator[pa.RecordBatch]:
        cutter, numbers, found, counts = words_of(path, pattern), _Numbers(), [], []
        for piece in held:
            for t in text_of(piece.column("t")).to_pylist():
                words = cutter.of(t)
                found.append(np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words) if isinstance(words, list) else -1))
                counts.append(len(found[-1]))
        stream = np.concatenate(found)
        del found
        # Words in order of their buckets, and sorted there, are numbered anew: a bucket has a range of numbers.
        words = pa.array(numbers.keys(), pa.large_string())
        del numbers
        order = pc.sort_indices(words).to_numpy()
        data, ends = bytes_of(words)
        bucket = (span_hash(prefix_hash(data), ends[:-1], ends[1:]) % np.uint64(buckets)).astype(np.int64)
        order = order[np.argsort(bucket[order], kind="stable")]
        new = np.empty(len(order), np.uint32)
        new[order] = np.arange(len(order), dtype=np.uint32)
        blob = packed(new[stream])
        at = 0
        for piece in held:
            n = piece.num_rows
            yield rows(n, chunk, at=pa.array(np.arange(at, at + n, dtype=np.int32)), n=pa.array(np.array(counts[at : at + n], np.int64)), blob=pa.array([None if at or i else blob for i in range(n)], pa.binary()), **{k: piece.column(k) for k in names})
            at += n
        words, bucket = words.take(pa.array(order)), bucket[order]
        cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
        blobs = []
        for lo, hi in zip(cut, np.append(cut[1:], len(bucket)), strict=True):
            data, ends = bytes_of(words.slice(lo, hi - lo))
            blobs.append(packed(np.diff(ends).astype(np.uint32), data))
        if blobs:
            yield rows(len(cut), -1 - bucket[cut], chunk=pa.array(np.full(len(cut), chunk)), low=pa.array(cut.astype(np.int64)), blob=pa.array(blobs, pa.binary()))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            kinds.update({k: batch.schema.field(k).type for k in names})
            for piece in pieces(batch, "t", CHUNK_BYTES // 8):
                n = pc.sum(pc.binary_length(piece.column("t"))).as_py() or 0
                if held and size + n > CHUNK_BYTES:
                    yield from chunk_rows(held, chunk)
                    chunk, held, size = chunk + 1, [], 0
                held.append(piece)
                size += n
        if held:
            yield from chunk_rows(held, chunk)

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: dict[int, list] = {}
        for batch in batches:
            for place, *row in zip(*(batch.column(c).to_pylist() for c in ("place", "chunk", "low", "blob")), strict=True):
                if place < 0:
                    asked.setdefault(place, []).append(row)
        piece = words_of(path, pattern).piece
        for place in list(asked):
            sent = asked.pop(place)
            parts = [unpacked(blob) for _, _, blob in sent]
            ends = np.cumsum(np.concatenate([[0], *(p[0] for p in parts)], dtype=np.int64))
            bytes_ = binary(np.concatenate([p[1] for p in parts]), ends)
            each = bytes_.dictionary_encode()
            coded = [piece(w) for w in each.dictionary.to_pylist()]
            counts = np.fromiter(map(len, coded), np.int64, len(coded))
            flat = np.fromiter(chain.from_iterable(coded), np.uint32, int(counts.sum()))
            starts, index = np.cumsum(counts) - counts, each.indices.to_numpy()
            at, blobs = 0, []
            for p in parts:
                mine = index[at : at + len(p[0])]
                at += len(mine)
                blobs.append(packed(counts[mine].astype(np.uint32), flat[_flat(starts[mine], counts[mine])]))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in sent], pa.int64()), pa.array([r[1] for r in sent], pa.int64()), pa.array(blobs, pa.binary())], names=["place", "low", "blob"])

    result = T.StructType([*own, T.StructField("ids", T.BinaryType())])

    def assembled(mine: pa.Table, told: pa.Table) -> pa.Table:
        if not mine.num_rows or mine.column("place")[0].as_py() < 0:
            types = [mine.schema.field(k).type if k in mine.schema.names else pa.null() for k in names]
            return pa.table([pa.nulls(0, t) for t in [*types, pa.binary()]], names=[*names, "ids"])
        mine = mine.take(np.argsort(mine.column("at").to_numpy(), kind="stable"))
        (stream,) = unpacked(mine.column("blob")[0].as_py())
        parts = [unpacked(b) for b in told.sort_by("low").column("blob").to_pylist()]
        counts = np.concatenate([np.zeros(0, np.int64), *(p[0] for p in parts)]).astype(np.int64)
        flat = np.concatenate([np.zeros(0, "<u4"), *(p[1] for p in parts)]).astype("<u4")
        starts = np.cumsum(counts) - counts
        tokens = np.append(0, np.cumsum(counts[stream]))  # ids before each position
        out = np.empty(int(tokens[-1]), "<u4")
        for i in range(0, len(stream), PASS):
            s = stream[i : i + PASS]
            out[tokens[i] : tokens[min(i + PASS, len(stream))]] = flat[_flat(starts[s], counts[s])]
        ends = tokens[np.append(0, np.cumsum(mine.column("n").to_numpy()))] * 4
        return pa.table([*(mine.column(k) for k in names), binary(out.view(np.uint8), ends)], names=[*names, "ids"])

    # One shuffle holds both what chunks keep and what they send; it is written once and read by buckets and by chunks.
    dealt = source.mapInArrow(cut, schema).repartition(max(8, 2 * chunks), "place")
    told = dealt.mapInArrow(answers, "place long, low long, blob binary")
    done = dealt.groupBy("place").cogroup(told.groupBy("place")).applyInArrow(assembled, result)
    return done.select(*(F.col(k).alias(f.name) for k, f in zip(names, kept, strict=True)), F.col("ids").alias(ids))


def decode(df: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """`keep` (all columns if None) and `decoded`, binary: the bytes of the tokens, by a join with the table of tokens' bytes
    in every task. Null ids decode to no bytes; an id that no token has is an error. A kept column named `decoded` is replaced.
    """
    table = ranks(path)
    if (size := sum(map(len, table)) + 8 * len(table)) > TABLE_BYTES:
        raise ValueError(f"{size} bytes of tokens are too many to hold in every task")
    by_id = [b""] * (max(table.values(), default=-1) + 1)
    missing = np.ones(len(by_id), bool)
    for token, i in table.items():
        by_id[i], missing[i] = token, False
    shared = df.sparkSession.sparkContext.broadcast((by_id, missing))
    kept = [f for f in df.schema.fields if (keep is None or f.name in keep) and f.name != decoded]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, absent = shared.value
        tokens = pa.array(tokens, pa.large_binary())
        for batch in batches:
            for piece in pieces(batch, ids, PASS):
                data, ends = bytes_of(piece.column(ids))
                numbers = np.frombuffer(data.tobytes(), "<u4")
                if len(numbers) and (numbers.max() >= len(absent) or absent[numbers].any()):
                    raise ValueError("an id that no token has")
                found = tokens.take(pa.array(numbers))
                offsets = np.frombuffer(found.buffers()[1], np.int64)[: len(numbers) + 1] if len(numbers) else np.zeros(1, np.int64)
                out = np.frombuffer(found.buffers()[2] or b"", np.uint8) if len(numbers) else np.zeros(0, np.uint8)
                yield pa.RecordBatch.from_arrays([*(piece.column(n) for n in names), binary(out, offsets[ends // 4])], names=[*names, decoded])

    read = names if ids in names else [*names, ids]
    return df.select(*(f"`{c}`" for c in read)).mapInArrow(run, T.StructType([*kept, T.StructField(decoded, T.BinaryType())]))
