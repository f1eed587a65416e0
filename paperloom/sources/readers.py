"""Files to elements: `read` loads files with Spark and hands each to the reader of its type.

Readers are small functions bytes -> list of (kind, depth, page, text); `register` adds one for an extension. A file that
none takes, or that one fails on, stays as a row with its problem.
"""

from __future__ import annotations

import csv
import email
import email.policy
import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

Element = tuple[str, int, int | None, str]
SCHEMA = "path string, position int, kind string, depth int, page int, text string, problem string"
ROWS = 500

_readers: dict[str, Callable[[bytes], list[Element]]] = {}


def register(*extensions: str):
    def add(f: Callable[[bytes], list[Element]]):
        _readers.update({e: f for e in extensions})
        return f

    return add


def decoded(data: bytes) -> str:
    """UTF-8, UTF-16 if a mark says so, else Latin-1."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return data.decode("utf-16")
    try:
        return data.decode("utf-8-sig")
    except UnicodeDecodeError:
        return data.decode("latin-1")


def markdown_table(rows: list[list[str]]) -> str:
    """Rows as a table, padded to the widest; empty cells are a blank."""
    width = max(map(len, rows), default=0)
    line = lambda cells: "| " + " | ".join([*(c.strip().replace("\n", " ") or " " for c in cells), *[" "] * (width - len(cells))]) + " |"
    return "\n".join([line(rows[0]), "| " + " | ".join(["---"] * width) + " |", *map(line, rows[1:])]) if rows else ""


def tables(rows: list[list[str]], page: int | None = None) -> list[Element]:
    """Rows as tables of ROWS rows each; further ones repeat the first row, their heading."""
    blocks = [rows[i : i + ROWS] for i in range(0, len(rows), ROWS)]
    return [("table", 0, page, markdown_table(b if i == 0 else [rows[0], *b])) for i, b in enumerate(blocks)]


@register("txt", "md", "markdown")
def plain_text(data: bytes) -> list[Element]:
    out: list[Element] = []
    for block in decoded(data).replace("\r\n", "\n").split("\n\n"):
        block = block.strip()
        if m := re.match(r"(#+) (.*)", block, re.S):
            out.append(("title", len(m[1]) - 1, None, m[2].strip()))
        elif block[:2] in ("- ", "* ", "• "):
            out.append(("listItem", 0, None, block[2:]))
        elif block:
            out.append(("code" if block.startswith("```") else "text", 0, None, block))
    return out


@register("csv", "tsv")
def table(data: bytes) -> list[Element]:
    text = decoded(data)
    return tables(list(csv.reader(text.splitlines(), delimiter="\t" if "\t" in text.partition("\n")[0] else ",")))


class _Html(HTMLParser):
    BLOCKS = {"p", "div", "tr", "li", "br", "h1", "h2", "h3", "h4", "h5", "h6"}

    def __init__(self):
        super().__init__()
        self.out: list[Element] = []
        self.kind, self.depth, self.text, self.hidden = "text", 0, "", 0

    def close_block(self):
        if text := " ".join(self.text.split()):
            self.out.append((self.kind, self.depth, None, text))
        self.kind, self.depth, self.text = "text", 0, ""

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")
        if tag in self.BLOCKS:
            self.close_block()
            if tag[0] == "h":
                self.kind, self.depth = "title", int(tag[1]) - 1
            elif tag == "li":
                self.kind = "listItem"

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style")
        if tag in self.BLOCKS:
            self.close_block()

    def handle_data(self, data):
        self.text += "" if self.hidden else data


@register("html", "htm")
def html(data: bytes) -> list[Element]:
    parser = _Html()
    parser.feed(decoded(data))
    parser.close_block()
    return parser.out


@register("eml", "emlx")
def mail(data: bytes) -> list[Element]:
    """Subject, header lines and body; quoted replies go, attachments are named."""
    if re.match(rb"\d+\s*\n", data):  # the wrapper of a saved message: its length first
        data = data.partition(b"\n")[2]
    message = email.message_from_bytes(data, policy=email.policy.default)
    out: list[Element] = [("title", 0, None, message["subject"] or "Untitled")]
    out += [("text", 0, None, f"{h}: {message[h]}") for h in ("From", "To", "Cc", "Date") if message[h]]
    body = message.get_body(("plain", "html"))
    if body is not None:
        text = body.get_content()
        if body.get_content_subtype() == "html":
            text = "\n\n".join(t for _, _, _, t in html(text.encode()))
        for block in text.replace("\r\n", "\n").split("\n\n"):
            lines = block.strip().split("\n")
            quoted = sum(x.lstrip().startswith(">") for x in lines)
            if block.strip() and quoted / len(lines) <= 0.6:
                out.append(("text", 0, None, "\n".join(x for x in lines if not x.lstrip().startswith(">"))))
    names = sorted({a.get_filename() for a in message.iter_attachments() if a.get_filename()})
    return out + [("text", 0, None, "Attachment: " + n) for n in names]


def _parts(data: bytes) -> zipfile.ZipFile:
    return zipfile.ZipFile(io.BytesIO(data))


def _named(node: ET.Element, name: str):
    return (x for x in node.iter() if x.tag.rpartition("}")[2] == name)


def _text(node: ET.Element, name: str = "t") -> str:
    return "".join(x.text or "" for x in _named(node, name))


@register("xlsx")
def workbook(data: bytes) -> list[Element]:
    """A title and tables for each sheet; gaps between cells are kept, blank rows at the end aren't."""
    files = _parts(data)
    shared = [_text(s) for s in _named(ET.fromstring(files.read("xl/sharedStrings.xml")), "si")] if "xl/sharedStrings.xml" in files.namelist() else []
    sheets = sorted((int(m[1]), n) for n in files.namelist() if (m := re.fullmatch(r"xl/worksheets/sheet(\d+)\.xml", n)))
    out: list[Element] = []
    for number, name in sheets:
        rows: list[list[str]] = []
        for row in _named(ET.fromstring(files.read(name)), "row"):
            cells: list[str] = []
            for cell in _named(row, "c"):
                column = 0
                for letter in re.match(r"[A-Z]*", cell.get("r", ""))[0]:
                    column = column * 26 + ord(letter) - 64
                value = next((v.text or "" for v in _named(cell, "v")), _text(cell))
                cells += [""] * (column - 1 - len(cells))
                cells.append(shared[int(value)] if cell.get("t") == "s" else value)
            rows.append(cells)
        while rows and not any(c.strip() for c in rows[-1]):
            rows.pop()
        if rows:
            out += [("title", 0, number, f"Sheet {number}"), *tables(rows, number)]
    return out


@register("pptx")
def deck(data: bytes) -> list[Element]:
    files = _parts(data)
    slides = sorted((int(m[1]), n) for n in files.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
    out: list[Element] = []
    for number, name in slides:
        texts = [t for p in _named(ET.fromstring(files.read(name)), "p") if (t := _text(p).strip())]
        out += [("title" if i == 0 else "listItem", 1 if i == 0 else 0, number, t) for i, t in enumerate(texts)]
    return out


@register("docx")
def word(data: bytes) -> list[Element]:
    out: list[Element] = []
    for p in _named(ET.fromstring(_parts(data).read("word/document.xml")), "p"):
        style = next((v for s in _named(p, "pStyle") for k, v in s.attrib.items() if k.endswith("val")), "")
        if text := _text(p).strip():
            level = re.search(r"(\d+)$", style)
            kind = "title" if style.startswith(("Heading", "Title")) else "listItem" if style.startswith("List") else "text"
            out.append((kind, int(level[1]) - 1 if kind == "title" and level else 0, None, text))
    return out


def read(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """Elements of all files under `path`; a row with `problem` for a file that can't be read. Hidden and empty files are
    left out, as Spark lists neither."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path).select("path", "length", "content")
    readers = dict(_readers)

    def elements(batches):
        for batch in batches:
            rows = []
            for path, length, content in zip(*(batch.column(c).to_pylist() for c in ("path", "length", "content")), strict=True):
                reader = readers.get(path.rpartition(".")[2].lower())
                try:
                    if not length:
                        raise ValueError("the file is empty")
                    if reader is None:
                        raise ValueError("no reader for this type")
                    rows += [(path, i, *e, None) for i, e in enumerate(reader(content))]
                except Exception as e:  # one file never stops the rest: its row says what is wrong
                    rows.append((path, None, None, None, None, None, f"{type(e).__name__}: {e}"))
            types = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return files.mapInArrow(elements, SCHEMA)
