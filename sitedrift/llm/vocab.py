"""Reading the JSON vocabularies of public tokenizers, and splitting text as their pre-tokenizers do.

The driver reads the file once; tasks get its text as a broadcast of a fixed size (under 2 MB) and parse it once per
Python worker.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import regex
from pyspark import Broadcast
from pyspark.sql import SparkSession

_PARSED: dict[bytes, Vocabulary] = {}
_JOIN = 1 << 17

BYTE_LEVEL = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: The same splits by the standard library, which is faster, for texts of the Latin blocks without the few characters
#: on which the two differ (other numerals, separators below the space).
PLAIN = re.compile(r"[\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-\u017f]*")
PLAIN_BYTE_LEVEL = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\w\s]|_)+|\s+(?!\S)|\s+")
PLAIN_LOWER_WORDS = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
LOWER_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


def byte_chars() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, spare = [""] * 256, 0x100
    for b in range(256):
        if b in shown:
            out[b] = chr(b)
        else:
            out[b], spare = chr(spare), spare + 1
    return out


@dataclass
class Vocabulary:
    """merges: (left id << 17 | right id) to (rank, merged id). first: id of each byte; last: of a word's final byte."""

    first: list[int]
    last: list[int]
    merges: dict[int, tuple[int, int]]
    token_bytes: list[bytes]
    specials: dict[str, int]
    splitter: regex.Pattern
    plain: re.Pattern
    special_splitter: regex.Pattern | None
    lower: bool

    def segments(self, text: str) -> Iterator[tuple[int, list[str]]]:
        """Stretches of a text: (id of a special token, no pieces) or (-1, pieces)."""
        parts = self.special_splitter.split(text) if self.special_splitter else [text]
        for k, part in enumerate(parts):
            if k % 2:
                yield self.specials[part], []
            elif part:
                part = self._lowered(part) if self.lower else part
                yield -1, (self.plain if PLAIN.fullmatch(part) else self.splitter).findall(part)

    @staticmethod
    def _lowered(text: str) -> str:
        """NFC, then each character's own lower case: a final sigma is no special case."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def symbols(self, piece: str) -> list[int]:
        raw = piece.encode()
        out = [self.first[b] for b in raw]
        out[-1] = self.last[raw[-1]]
        return out


def ship(spark: SparkSession, path: str) -> Broadcast:
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def parsed(raw: str) -> Vocabulary:
    """The vocabulary of a file's text, parsed once per Python worker."""
    key = hashlib.blake2b(raw.encode(), digest_size=16).digest()
    if key not in _PARSED:
        _PARSED[key] = parse(raw)
    return _PARSED[key]


def parse(raw: str) -> Vocabulary:
    spec = json.loads(raw)
    ids, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"] or ""
    chars = byte_chars()
    to_byte = {c: b for b, c in enumerate(chars)}
    merges = {}
    for rank, (a, b) in enumerate(spec["model"]["merges"]):
        merges[ids[a] * _JOIN + ids[b]] = (rank, ids[a + b])
    specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
    token_bytes = [b""] * (1 + max([*ids.values(), *specials.values()]))
    for token, i in ids.items():
        token_bytes[i] = bytes(to_byte[c] for c in token.removesuffix(suffix))
    for token, i in specials.items():
        token_bytes[i] = token.encode()
    any_special = "|".join(regex.escape(x) for x in sorted(specials, key=len, reverse=True))
    lower = bool(spec["normalizer"])
    return Vocabulary(
        first=[ids[c] for c in chars],
        last=[ids[c + suffix] for c in chars],
        merges=merges,
        token_bytes=token_bytes,
        specials=specials,
        splitter=LOWER_WORDS if lower else BYTE_LEVEL,
        plain=PLAIN_LOWER_WORDS if lower else PLAIN_BYTE_LEVEL,
        special_splitter=regex.compile(f"({any_special})") if specials else None,
        lower=lower,
    )
