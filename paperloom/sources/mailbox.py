"""A mailbox as a data source: messages after a cursor, a partition a page, in batch or as a stream whose offset is the cursor.

    spark.dataSource.register(MailboxSource)
    spark.read.format("mailbox").option("path", folder).option("since", 7).load()

A mailbox here is a folder of pages, JSON-lines files with cursor (rising), message_id and text; `history.json` may say from
which `oldest` cursor on the changes are still known. A reader whose cursor lies before that starts over with all pages.
The driver looks at both ends of each page only, to plan; tasks read the pages. Another service plugs in as a `Pages`.

A line that can't be read doesn't end a sync: it comes as a row with a `problem` and the cursor of the message before it
(the next one's at the top of a page). Within a page a message comes once, where it is first; across pages `streaming.intake.synced`
sees to that. A page without any readable cursor takes no part. An empty or absent folder gives no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

TAIL = 1 << 16
SUFFIXES = ("jsonl", "json", "txt")
Row = tuple[int | None, str | None, str | None, str | None]


def _message(line: bytes) -> tuple[dict | None, str | None]:
    """A message, or what is wrong with it."""
    try:
        m = json.loads(line)
    except ValueError:
        return None, "not JSON"
    if not isinstance(m, dict):
        return None, "not an object"
    if not isinstance(m.get("cursor"), int) or isinstance(m["cursor"], bool):
        return None, "no cursor"
    if not isinstance(m.get("message_id"), str):
        return None, "no message_id"
    if not isinstance(m.get("text"), str | None):
        return None, "text is no string"
    return m, None


def _cursor(lines: Iterable[bytes]) -> int | None:
    """The first cursor that can be read."""
    return next((m["cursor"] for m, _ in map(_message, lines) if m), None)


@dataclass(frozen=True)
class Page(InputPartition):
    """A page and the cursors of its first and last message; those of them after `after` and up to `upto` are asked for."""

    name: str
    first: int
    last: int
    after: int = -1
    upto: int | None = None


class Pages:
    """The pages of a folder."""

    def __init__(self, folder: str):
        uri = "://" in folder or folder.startswith("file:")
        self.fs, self.folder = fs.FileSystem.from_uri(folder) if uri else (fs.LocalFileSystem(), folder)
        self.ends: dict[tuple, tuple[int, int] | None] = {}

    def oldest(self) -> int:
        """The cursor from which on changes are known."""
        path = f"{self.folder}/history.json"
        if self.fs.get_file_info(path).type == fs.FileType.NotFound:
            return 0
        with self.fs.open_input_stream(path) as f:
            return int(json.loads(f.read())["oldest"])

    def listed(self) -> list[Page]:
        """All pages with a readable cursor, by their first one; a page that hasn't changed isn't opened again."""
        pages = []
        for info in self.fs.get_file_info(fs.FileSelector(self.folder, allow_not_found=True)):
            if info.is_file and info.base_name != "history.json" and info.extension in SUFFIXES:
                key = (info.path, info.size, info.mtime_ns)
                if key not in self.ends:
                    self.ends[key] = self._ends(info.path, info.size)
                if ends := self.ends[key]:
                    pages.append(Page(info.path, *ends))
        return sorted(pages, key=lambda p: (p.first, p.name))

    def _ends(self, path: str, size: int) -> tuple[int, int] | None:
        first = _cursor(self._lines(path))
        if first is None:
            return None
        take = TAIL
        with self.fs.open_input_file(path) as f:
            while True:
                start = max(0, size - take)
                f.seek(start)
                lines = f.read(take).split(b"\n")
                last = _cursor(reversed(lines if start == 0 else lines[1:]))
                if last is not None or start == 0:
                    return first, last
                take *= 4

    def _lines(self, path: str) -> Iterator[bytes]:
        with self.fs.open_input_stream(path) as f:
            parts: list[bytes] = []
            while block := f.read(TAIL):
                first, *lines = block.split(b"\n")
                parts.append(first)
                if lines:
                    yield b"".join(parts)
                    yield from lines[:-1]
                    parts = lines[-1:]
        yield b"".join(parts)

    def read(self, page: Page) -> Iterator[Row]:
        seen, at = set(), page.first
        for line in self._lines(page.name):
            if not line.strip():
                continue
            m, problem = _message(line)
            at = m["cursor"] if m else at
            if at <= page.after or (page.upto is not None and at > page.upto):
                continue
            if problem:
                yield at, None, None, problem
            elif m["message_id"] not in seen:
                seen.add(m["message_id"])
                yield at, m["message_id"], m.get("text"), None


def planned(pages: Pages, after: int, upto: int | None = None) -> list[Page]:
    """The pages with changes after a cursor, or all where the changes since then aren't known any more."""
    expired = after >= 0 and after + 1 < pages.oldest()
    after = -1 if expired else after
    return [Page(p.name, p.first, p.last, after, upto) for p in pages.listed() if p.last > after and (upto is None or p.first <= upto)]


class MailboxReader(DataSourceReader):
    def __init__(self, options):
        self.folder, self.cursor = options["path"], int(options.get("since", -1))

    def partitions(self):
        # Spark takes an empty list for one partition of no kind.
        return planned(Pages(self.folder), self.cursor) or [InputPartition(None)]

    def read(self, partition):
        return Pages(self.folder).read(partition) if isinstance(partition, Page) else iter(())


class MailboxStream(DataSourceStreamReader):
    """Offsets are cursors. The end of a batch is the last cursor of the mailbox, whatever could be read before it, so that a
    damaged message holds up none behind it."""

    def __init__(self, options):
        self.folder, self.cursor = options["path"], int(options.get("since", -1))
        self.pages = None

    def _pages(self) -> Pages:
        if self.pages is None:
            self.pages = Pages(self.folder)
        return self.pages

    def initialOffset(self):
        return {"cursor": self.cursor}

    def latestOffset(self):
        return {"cursor": max([self.cursor, *(p.last for p in self._pages().listed())])}

    def partitions(self, start, end):
        return planned(self._pages(), start["cursor"], end["cursor"]) if start["cursor"] < end["cursor"] else []

    def read(self, partition):
        return Pages(self.folder).read(partition)


class MailboxSource(DataSource):
    @classmethod
    def name(cls):
        return "mailbox"

    def schema(self):
        return "cursor long, message_id string, text string, problem string"

    def reader(self, schema):
        return MailboxReader(self.options)

    def streamReader(self, schema):
        return MailboxStream(self.options)
