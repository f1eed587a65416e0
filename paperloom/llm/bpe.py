"""BPE encoding and decoding by forced-boundary splitting.

A byte pair that occurs inside no vocabulary token can never be joined by a merge, so a text may be cut between such
bytes. Every fragment is encoded independently, and the ids are concatenated. The vocabulary
file is a parameter; two kinds are read: byte-level BPE with its usual pattern, and a split pattern followed by
byte-level BPE with a suffix at word ends.
"""

from __future__ import annotations

import functools
import json
import unicodedata
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from paperloom.llm._arrow import append, text_of

#: The pattern that byte-level pre-tokenizers use if they bring none. A fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Stands for the end of a word in the table of fragments; texts that have it go another way.
END = b"\x00"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Bpe:
    """One vocabulary in a worker. Splits, encodes and decodes as the tokenizers library does.

    Fragments are merged by tiktoken, which takes any table of byte strings with their ranks. For vocabularies with word
    ends, END stands for the end: a byte followed by END is the first merge of all, as such vocabularies have it.
    """

    def __init__(self, path: str):
        self.path = path
        spec = json.load(open(path, encoding="utf-8"))
        model, split = spec["model"], spec["pre_tokenizer"]
        self.lower = any(x["type"] == "Lowercase" for x in (spec["normalizer"] or {"normalizers": []})["normalizers"])
        self.compose = any(x["type"] == "NFC" for x in (spec["normalizer"] or {"normalizers": []})["normalizers"])
        if split["type"] == "ByteLevel" and not split["add_prefix_space"]:
            pattern = PATTERN
        elif split["type"] == "Sequence" and split["pretokenizers"][0]["behavior"] == "Removed" and split["pretokenizers"][0]["invert"]:
            pattern = split["pretokenizers"][0]["pattern"]["Regex"]
        else:
            raise ValueError(f"pre-tokenizer not supported: {split}")
        self.end = model["end_of_word_suffix"] or ""
        # White space is what the Unicode property says, without the four separators that Python counts too.
        self.find = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"), regex.V1).findall
        vocabulary: dict[str, int] = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.tokens = {i: t for t, i in chain(vocabulary.items(), self.special.items())}
        to_byte = {c: b for b, c in enumerate(byte_letters())}
        self.to_byte = to_byte

        def raw(token: str) -> bytes:
            word = bool(self.end) and token.endswith(self.end)
            return bytes(to_byte[c] for c in (token[: -len(self.end)] if word else token)) + (END if word else b"")

        letters = byte_letters()
        ranked = [bytes([b]) for b in range(256)]
        ranked += [bytes([b]) + END for b in range(256) if letters[b] + self.end in vocabulary] if self.end else []
        ids = [vocabulary.get(letters[b], 0) for b in range(256)] + [vocabulary[letters[b] + self.end] for b in range(256) if letters[b] + self.end in vocabulary] * bool(self.end)
        known = set(ranked)
        for merge in model["merges"]:
            token = "".join(merge if isinstance(merge, list) else merge.split(" "))
            if (r := raw(token)) not in known:
                known.add(r)
                ranked.append(r)
                ids.append(vocabulary[token])
        self.ids = np.array(ids, "<u4")
        self.rank = {(r[:-1], True) if len(r) > 1 and r.endswith(END) else (r, False): i for i, r in enumerate(ranked)} if self.end else {}
        self.coder = tiktoken.Encoding("fragments", pat_str=r"[^\x00\x01]+\x00?" if self.end else pattern, mergeable_ranks={r: i for i, r in enumerate(ranked)}, special_tokens={})
        self.joined = bool(spec["decoder"])
        self.bytes = {i: bytes(to_byte[c] for c in t) for i, t in self.tokens.items() if self.joined and t not in self.special}
        self.bytes |= {i: t.encode() for t, i in self.special.items()}
        #: Pairs of bytes that occur inside a token.
        self.inside = np.zeros((256, 256), bool)
        for token in vocabulary:
            token = np.frombuffer(raw(token).removesuffix(END), np.uint8)
            self.inside[token[:-1], token[1:]] = True
        self.inside[END[0], :] = self.inside[:, END[0]] = True
        # Cuts are made before whole characters only.
        self.inside[:, 0x80:0xC0] = True

    @functools.cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.cut is None or not any(s in text for s in self.special):
            return self.part(text)
        return b"".join(self.special[p].to_bytes(4, "little") if i % 2 else self.part(p) for i, p in enumerate(self.cut.split(text)))

    def part(self, text: str) -> bytes:
        """Ids of a text without special tokens."""
        if not text:
            return b""
        if not text.isascii() and any(unicodedata.category(c) == "Cn" for c in set(text)):
            return b"".join(self.known(t) if known else self.unknown(t) for known, t in self.parted(text))
        return self.known(text)

    def parted(self, text: str):
        """Pieces of a text by turns without and with code points that this Python doesn't know yet, cut at white space,
        which no token spans in vocabularies with word ends; whole for others."""
        has = lambda t: any(unicodedata.category(c) == "Cn" for c in set(t))
        if not self.end:
            return [(False, text)]
        words = regex.split(r"\p{White_Space}+", text)
        return [(known, " ".join(group)) for known, group in groupby(words, lambda w: not has(w))]

    def unknown(self, text: str) -> bytes:
        """By the library, which classes new code points by its own tables."""
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def known(self, text: str) -> bytes:
        if not self.end:
            return self.ids[self.coder.encode_to_numpy(text, disallowed_special=())].tobytes()
        if self.compose and not text.isascii():
            text = unicodedata.normalize("NFC", text)
        if self.lower:
            text = text.replace("Σ", "σ").lower()
        words = self.find(text)
        if "\x00" in text or "\x01" in text:
            # Words that have the marks used below are merged one by one.
            return b"".join(self.merged(w.encode()) if "\x00" in w or "\x01" in w else self.marked([w]) for w in words)
        return self.marked(words)

    def marked(self, words: list[str]) -> bytes:
        return self.ids[self.coder.encode_to_numpy(self.fragments("\0".join([*words, ""])), disallowed_special=())].tobytes()

    def merged(self, word: bytes) -> bytes:
        """Ids of one word with its end: the merge of least rank first, the leftmost of equal ones."""
        parts = [word[i : i + 1] for i in range(len(word))]
        end = [False] * (len(parts) - 1) + [True]
        table = self.rank
        while len(parts) > 1:
            ranks = [table.get((parts[i] + parts[i + 1], end[i + 1]), len(table)) for i in range(len(parts) - 1)]
            i = min(range(len(ranks)), key=ranks.__getitem__)
            if ranks[i] == len(table):
                break
            parts[i : i + 2], end[i : i + 2] = [parts[i] + parts[i + 1]], [end[i + 1]]
        return self.ids[[table[p, e] for p, e in zip(parts, end, strict=True)]].tobytes()

    def fragments(self, words: str) -> str:
        """Puts a mark between bytes that no token has side by side."""
        data = np.frombuffer(words.encode(), np.uint8)
        cuts = np.flatnonzero(~self.inside[data[:-1], data[1:]]) + 1
        return np.insert(data, cuts, 1).tobytes().decode() if len(cuts) else words

    def decode(self, ids: bytes) -> str:
        """Tokens joined by one space if the file has no decoder, else their bytes with invalid UTF-8 replaced."""
        numbers = np.frombuffer(ids, "<u4").tolist()
        if self.joined:
            return b"".join(map(self.bytes.__getitem__, numbers)).decode("utf-8", "replace")
        return " ".join(map(self.tokens.__getitem__, numbers))


def named(name: str) -> str:
    """The path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(2)
def vocabulary(path: str) -> Bpe:
    return Bpe(path)


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """Adds `ids`, binary: the ids of the whole text as little-endian unsigned 32-bit integers.

    A null text counts as empty; an empty text has no ids (empty binary). Repeated rows are
    encoded alike, each a row of its own. A column named `ids` is replaced.
    """
    return append(df, text, lambda piece: [pa.array(map(vocabulary(path).encode, text_of(piece.column(text)).to_pylist()), pa.binary())], f"`{ids}` binary", keep)


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """Adds `text`, the decoding of `ids`; null ids decode to the empty string. Repeated rows are decoded
    alike. A column named `text` is replaced."""
    return append(df, ids, lambda piece: [pa.array([vocabulary(path).decode(x or b"") for x in piece.column(ids).to_pylist()], pa.string())], f"`{text}` string", keep)
