"""WARC archives: a writer with one gzip member a record, and a sequential reader with incremental decompression,
Content-Length framing and digest verification.

Equal payloads are stored once: of the records that share one, that with the largest page_id is the response, the others
are revisit records that name it.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm._arrow import bytes_of, pieces
from paperloom.llm._tables import new_folder, stored

#: Compressed bytes after which a task begins another archive.
ARCHIVE_BYTES = 64 << 20
READ_BYTES = 1 << 16
LEVEL = 4
DATE = "2024-01-01T00:00:00Z"

RECORD = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary, verified boolean"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}').urn}>"


def member(headers: dict[str, object], block: bytes) -> bytes:
    """One record as one gzip member."""
    head = "".join(f"{k}: {v}\r\n" for k, v in headers.items() if v is not None)
    press = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return press.compress(f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n") + press.flush()


def assigned(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0) -> DataFrame:
    """page_id, url, html and the page_id that a record of an equal payload refers to (null: a response).

    Null html is empty. Payloads of fewer than `least_bytes` are all responses. Rows that repeat the largest page_id of
    a payload are all responses; a null page_id counts as smaller than any other, and if a payload has no other, its
    records are all responses.
    """
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(html, F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("html", 256)))
    largest = rows.groupBy("digest").agg(F.max("page_id").alias("largest"))
    rows = rows.join(largest, "digest", "left")
    other = (F.octet_length("html") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("largest"))
    return rows.select("page_id", "url", "html", F.when(other, F.col("largest")).alias("refers_to"))


def write(rows: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes archives and returns their manifest (path, records), itself stored.

    A task names its files by its attempt and the manifest lists those of the attempts that ended well, so repeated or
    speculative attempts leave nothing that is read twice. The folder is made in the shared one if none is given.
    """
    folder = folder or new_folder(rows.sparkSession, "warc")

    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        task, out, path, size, count, done = TaskContext.get(), None, "", 0, 0, 0
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root)
        for batch in batches:
            for piece in pieces(batch, "html"):
                data, offsets = bytes_of(piece.column("html"))
                for i, (page, url, refers) in enumerate(zip(*(piece.column(c).to_pylist() for c in ("page_id", "url", "refers_to")), strict=True)):
                    if out is None:
                        name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{done:03d}.warc.gz"
                        path, out, size, count = f"{folder}/{name}", store.open_output_stream(f"{root}/{name}", compression=None), 0, 0
                    payload = data[offsets[i] : offsets[i + 1]].tobytes()
                    digest = base32(hashlib.sha1(payload).digest())
                    block = b"" if refers is not None else b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n%b" % (len(payload), payload)
                    headers = {
                        "WARC-Type": "response" if refers is None else "revisit",
                        "WARC-Record-ID": record_id(page, digest),
                        "WARC-Date": DATE,
                        "WARC-Target-URI": " ".join((url or "").split()) or None,
                        "WARC-Payload-Digest": f"sha1:{digest}",
                        "WARC-Block-Digest": f"sha1:{base32(hashlib.sha1(block).digest())}",
                        "Content-Type": "application/http; msgtype=response" if refers is None else None,
                        "WARC-Profile": None if refers is None else "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                        "WARC-Refers-To": None if refers is None else record_id(refers, digest),
                        "X-Page-ID": page,
                        "X-Refers-To-Page-ID": refers,
                        "X-Payload-Length": len(payload),
                    }
                    made = member(headers, block)
                    out.write(made)
                    size, count = size + len(made), count + 1
                    if size >= ARCHIVE_BYTES:
                        out.close()
                        yield pa.RecordBatch.from_pydict({"path": [path], "records": [count]})
                        out, done = None, done + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "records": [count]})

    return stored(rows.select("page_id", "url", "html", "refers_to").mapInArrow(archives, "path string, records long"), "manifest")


class Member:
    """One gzip member of an archive, inflated as its bytes are asked for."""

    def __init__(self, stream, held: bytes):
        self.stream, self.held, self.ready = stream, held, bytearray()
        self.inflate = zlib.decompressobj(31)

    def more(self) -> bool:
        """Inflates another piece; False at the end of the member."""
        while not self.inflate.eof:
            self.held = self.held or self.stream.read(READ_BYTES)
            if not self.held:
                raise ValueError("the archive ends within a record")
            out = self.inflate.decompress(self.held, READ_BYTES)
            self.held = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
            if out:
                self.ready += out
                return True
        return False

    def until(self, mark: bytes) -> bytes:
        """Bytes up to a mark, which is passed over."""
        begin = 0
        while (at := self.ready.find(mark, begin)) < 0:
            begin = max(0, len(self.ready) - len(mark) + 1)
            if not self.more():
                raise ValueError("a member without a record")
        out = bytes(self.ready[:at])
        del self.ready[: at + len(mark)]
        return out

    def exactly(self, n: int) -> bytes:
        while len(self.ready) < n:
            if not self.more():
                raise ValueError("a record is shorter than its Content-Length")
        out = bytes(self.ready[:n])
        del self.ready[:n]
        return out


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names; the last of a name counts) and block of each record of an archive, in order.

    A record begins with its member; Content-Length says where its block ends, and two line ends follow. One record is held
    at a time, with READ_BYTES of what follows.
    """
    held = stream.read(READ_BYTES)
    while held:
        member = Member(stream, held)
        lines = member.until(b"\r\n\r\n").decode("utf-8", "replace").split("\r\n")
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        if not lines[0].startswith("WARC/") or not headers.get("content-length", "").isdigit():
            raise ValueError("a member without a record")
        block = member.exactly(int(headers["content-length"]))
        if member.exactly(4) != b"\r\n\r\n" or member.ready or member.more():
            raise ValueError("a record is longer than its Content-Length")
        yield headers, block
        held = member.held or stream.read(READ_BYTES)


def parsed(headers: dict[str, str], block: bytes) -> tuple:
    """A row of RECORD. Digests in other than SHA-1 are not verified (null), nor is a record without digests."""
    digest = lambda data: f"sha1:{base32(hashlib.sha1(data).digest())}"
    number = lambda x: int(x) if x and x.lstrip("-").isdigit() else None
    kind, http = headers.get("warc-type", ""), headers.get("content-type", "").startswith("application/http")
    payload = None if kind == "revisit" else block.partition(b"\r\n\r\n")[2] if http else block
    said = [(headers.get("warc-block-digest"), block), (headers.get("warc-payload-digest"), payload)]
    tests = [(d, x) for d, x in said if d and d.startswith("sha1:") and x is not None]
    right = all(d == digest(x) for d, x in tests) if tests else None
    named = headers.get("warc-payload-digest") or (digest(payload) if payload is not None else None)
    size = number(headers.get("x-payload-length")) if payload is None else len(payload)
    return number(headers.get("x-page-id")), headers.get("warc-target-uri"), kind, number(headers.get("x-refers-to-page-id")), named and named.removeprefix("sha1:"), size, payload, right


def read(manifest: DataFrame) -> DataFrame:
    """One row a record of the archives (column path; others are ignored): see RECORD.

    `payload` is null for revisits, and for records that are no HTTP message it is the whole block; a payload without a
    digest header gets one. `verified` says whether the block's digest, and that of a payload, are those of the headers;
    null if there are none. A revisit's payload is verified by `checked`. Damaged framing raises an error.
    """

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        names = [c.split()[0] for c in RECORD.split(", ")]
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.bool_()]
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, name = fs.FileSystem.from_uri(path)
                rows, held = [], 0
                with store.open_input_stream(name, compression=None) as stream:
                    for headers, block in records(stream):
                        rows.append(parsed(headers, block))
                        held += len(block) + 200
                        if held > 4 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path").repartition(parts).mapInArrow(rows_of, RECORD)


def checked(records: DataFrame) -> DataFrame:
    """Records without their payloads. A revisit is verified if its own digests are, and if a verified response of the page
    that it refers to has the payload digest and length that it states."""
    rows = stored(records.drop("payload"), "records")
    responses = rows.where("record_type = 'response' AND verified").select(F.col("page_id").alias("refers_to"), "payload_digest", "payload_bytes", F.lit(True).alias("known")).distinct()
    joined = rows.join(responses, ["refers_to", "payload_digest", "payload_bytes"], "left")
    sure = F.when(F.col("record_type") == "revisit", F.col("verified") & F.coalesce("known", F.lit(False))).otherwise(F.col("verified"))
    return joined.withColumn("verified", sure).select(*rows.columns)
