"""ZIP containers read by ranges: central and ZIP64 directories, stored members, nothing extracted."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass
from typing import Protocol

LOCAL, CENTRAL, END, END64, LOCATOR = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
MAX16, MAX32 = 0xFFFF, 0xFFFFFFFF
#: Bytes of a directory read at once.
PIECE = 1 << 20


class Source(Protocol):
    size: int

    def read(self, offset: int, length: int) -> bytes: ...


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    crc: int
    packed: int
    size: int
    header: int


def write_zip(members: list[tuple[str, list[bytes]]], zip64: bool = False) -> list[bytes]:
    """The parts of a ZIP file with stored ``members`` (name, parts). ``zip64`` forces ZIP64 fields; else as needed."""
    out: list[bytes] = []
    at, central = 0, []
    for name, parts in members:
        raw, size, crc = name.encode(), sum(map(len, parts)), 0
        for p in parts:
            crc = zlib.crc32(p, crc)
        big = zip64 or size >= MAX32 or at >= MAX32
        extra = struct.pack("<HHQQ", 1, 16, size, size) if big else b""
        shown = MAX32 if big else size
        head = LOCAL + struct.pack("<5H3I2H", 45, 0x800, 0, 0, 0x21, crc, shown, shown, len(raw), len(extra)) + raw + extra
        extra = struct.pack("<HHQQQ", 1, 24, size, size, at) if big else b""
        central.append(CENTRAL + struct.pack("<6H3I5H2I", 45, 45, 0x800, 0, 0, 0x21, crc, shown, shown, len(raw), len(extra), 0, 0, 0, 0, MAX32 if big else at) + raw + extra)
        out += [head, *parts]
        at += len(head) + size
    length, n = sum(map(len, central)), len(central)
    out += central
    if zip64 or at >= MAX32 or n >= MAX16 or length >= MAX32:
        out.append(END64 + struct.pack("<Q2H2I4Q", 44, 45, 45, 0, 0, n, n, length, at))
        out.append(LOCATOR + struct.pack("<IQI", 0, at + length, 1))
        out.append(END + struct.pack("<4H2IH", 0, 0, MAX16, MAX16, MAX32, MAX32, 0))
    else:
        out.append(END + struct.pack("<4H2IH", 0, 0, n, n, length, at, 0))
    return out


def directory(src: Source) -> list[Member]:
    """Members listed in the central directory, ZIP64 fields resolved. Bytes before the archive are allowed."""
    tail_at = max(0, src.size - 22 - MAX16)
    tail = src.read(tail_at, src.size - tail_at)
    i = tail.rfind(END)
    while i >= 0 and (len(tail) - i < 22 or i + 22 + struct.unpack_from("<H", tail, i + 20)[0] != len(tail)):
        i = tail.rfind(END, 0, i)
    if i < 0:
        raise ValueError("no end of central directory")
    end_at = tail_at + i
    n, length, offset = struct.unpack_from("<HII", tail, i + 10)
    if end_at >= 20 and (loc := src.read(end_at - 20, 20))[:4] == LOCATOR:
        end64_at = struct.unpack_from("<Q", loc, 8)[0]
        end64 = src.read(end64_at, 56)
        if end64[:4] != END64:
            raise ValueError("the locator names no ZIP64 end of central directory")
        n, length, offset = struct.unpack_from("<QQQ", end64, 32)
        shift = 0
    else:
        shift = end_at - length - offset
    if offset + shift < 0:
        raise ValueError("the central directory lies before the file")
    out: list[Member] = []
    buf, base, i = b"", offset + shift, 0
    stop = base + length
    while len(out) < n:
        if i + 46 > len(buf) or i + 46 + sum(struct.unpack_from("<3H", buf, i + 28)) > len(buf):
            base, i = base + i, 0
            buf = src.read(base, min(PIECE, stop - base))
            if len(buf) < 46:
                raise ValueError("the central directory ends early")
        if buf[i : i + 4] != CENTRAL:
            raise ValueError("a central directory entry is expected")
        flags, method = struct.unpack_from("<2H", buf, i + 8)
        crc, packed, size, n_name, n_extra, n_note = struct.unpack_from("<3I3H", buf, i + 16)
        header = struct.unpack_from("<I", buf, i + 42)[0]
        name = buf[i + 46 : i + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra, j = buf[i + 46 + n_name : i + 46 + n_name + n_extra], 0
        while j + 4 <= len(extra):
            kind, k = struct.unpack_from("<2H", extra, j)
            if kind == 1:
                wide = list(struct.unpack_from(f"<{k // 8}Q", extra, j + 4))
                size = wide.pop(0) if size == MAX32 else size
                packed = wide.pop(0) if packed == MAX32 else packed
                header = wide.pop(0) if header == MAX32 else header
            j += 4 + k
        out.append(Member(name, method, crc, packed, size, header + shift))
        i += 46 + n_name + n_extra + n_note
    return out


def data_offset(src: Source, member: Member) -> int:
    """Where the bytes of a stored member begin, by its local header."""
    if member.method != 0:
        raise ValueError(f"{member.name} is compressed in the container; only stored members can be read by ranges")
    head = src.read(member.header, 30)
    if head[:4] != LOCAL:
        raise ValueError(f"{member.name} has no local header")
    return member.header + 30 + sum(struct.unpack_from("<2H", head, 26))
