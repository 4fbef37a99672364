"""A ZIP package of stored members: a small writer that always adds ZIP64 records, and a range reader.

The reader never extracts: it reads the end records and the central directory by position, and serves byte ranges of
stored members.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass
from typing import BinaryIO, Protocol

#: Fixed values of the ZIP format: record signatures, "version needed" for ZIP64, and the 32-bit "see ZIP64" marks.
LOCAL, CENTRAL, END, END64, LOCATOR64 = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50
VERSION64, MARK32, MARK16, EXTRA64 = 45, 0xFFFFFFFF, 0xFFFF, 1
#: 1980-01-01, the format's earliest day: archives of equal content are equal files.
DAY = 0x21


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    header_at: int


class Source(Protocol):
    def size(self) -> int: ...

    def read_at(self, n: int, at: int) -> bytes: ...


class Package:
    """Writes stored members one after the other into an open binary file."""

    def __init__(self, out: BinaryIO):
        self.out, self.at, self.entries = out, 0, []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, name: str, data: bytes) -> int:
        """Adds a whole member; returns where its data begins."""
        raw, crc, header_at = name.encode(), zlib.crc32(data), self.at
        extra = struct.pack("<HHQQ", EXTRA64, 16, len(data), len(data))
        head = struct.pack(
            "<IHHHHHIIIHH", LOCAL, VERSION64, 0x800, 0, 0, DAY, crc, MARK32, MARK32, len(raw), len(extra)
        )
        self._put(head + raw + extra)
        begin = self.at
        self._put(data)
        self.entries.append((raw, crc, len(data), header_at))
        return begin

    def close(self) -> None:
        start = self.at
        for raw, crc, size, header_at in self.entries:
            extra = struct.pack("<HHQQQ", EXTRA64, 24, size, size, header_at)
            self._put(
                struct.pack(
                    "<IHHHHHHIIIHHHHHII", CENTRAL, VERSION64, VERSION64, 0x800, 0, 0, DAY, crc, MARK32, MARK32,
                    len(raw), len(extra), 0, 0, 0, 0, MARK32,
                )
                + raw
                + extra
            )
        length, end64 = self.at - start, self.at
        n = len(self.entries)
        self._put(struct.pack("<IQHHIIQQQQ", END64, 44, VERSION64, VERSION64, 0, 0, n, n, length, start))
        self._put(struct.pack("<IIQI", LOCATOR64, 0, end64, 1))
        self._put(struct.pack("<IHHHHIIH", END, 0, 0, min(n, MARK16), min(n, MARK16), MARK32, MARK32, 0))


def directory(source: Source) -> list[Member]:
    """Members of the central directory; follows the ZIP64 end record where there is one."""
    total = source.size()
    tail_at = max(0, total - 22 - MARK16 - 20)
    tail = source.read_at(total - tail_at, tail_at)
    k = tail.rfind(struct.pack("<I", END))
    if k < 0:
        raise ValueError("not a ZIP archive: no end record")
    n, length, start = struct.unpack_from("<HII", tail, k + 10)
    if k >= 20 and struct.unpack_from("<I", tail, k - 20)[0] == LOCATOR64:
        at = struct.unpack_from("<Q", tail, k - 12)[0]
        record = source.read_at(56, at)
        if struct.unpack_from("<I", record)[0] != END64:
            raise ValueError("broken ZIP64 end record")
        n, length, start = struct.unpack_from("<QQQ", record, 32)
    entries, members, p = source.read_at(length, start), [], 0
    for _ in range(n):
        if struct.unpack_from("<I", entries, p)[0] != CENTRAL:
            raise ValueError("broken central directory")
        method, packed, size, n_name, n_extra, n_comment, header_at = (
            *struct.unpack_from("<H", entries, p + 10),
            *struct.unpack_from("<IIHHH", entries, p + 20),
            *struct.unpack_from("<I", entries, p + 42),
        )
        name = entries[p + 46 : p + 46 + n_name].decode("utf-8", "replace")
        q, stop = p + 46 + n_name, p + 46 + n_name + n_extra
        while q + 4 <= stop:
            kind, width = struct.unpack_from("<HH", entries, q)
            if kind == EXTRA64:
                wide = iter(struct.unpack_from(f"<{width // 8}Q", entries, q + 4))
                size = next(wide) if size == MARK32 else size
                packed = next(wide) if packed == MARK32 else packed
                header_at = next(wide) if header_at == MARK32 else header_at
            q += 4 + width
        members.append(Member(name, method, size, header_at))
        p = stop + n_comment
    return members


def data_at(source: Source, m: Member) -> int:
    """Where a stored member's bytes begin: its local header has name and extra fields of its own length."""
    if m.method:
        raise ValueError(f"{m.name} is compressed by the archive; only stored members can be read by range")
    head = source.read_at(30, m.header_at)
    if struct.unpack_from("<I", head)[0] != LOCAL:
        raise ValueError("broken local header")
    n_name, n_extra = struct.unpack_from("<HH", head, 26)
    return m.header_at + 30 + n_name + n_extra
