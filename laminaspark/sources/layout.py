"""Binary layout of the layered container: header, composite frames, index. All little-endian."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

# Fixed values of the format.
MAGIC_FILE, MAGIC_CAU, MAGIC_INDEX, VERSION = b"LVF1", b"CAUF", b"IDX1", 1
EMPTY, FRAME, HOLD, RAP, KEY = 0, 1, 2, 1, 1
HEADER, CAU, ENTRY, PACKET, INDEX, INDEX_ROW = (struct.Struct(f) for f in ("<4sHHQIIQQQ16s", "<4sIIBBHHH", "<HBBII", "<qII", "<4sI", "<IB3xQ"))
EXTENSION = "lvd"


class FormatError(ValueError):
    """Bytes that aren't what the layout says."""


@dataclass
class Header:
    meta_offset: int = HEADER.size
    meta_length: int = 0
    resources_offset: int = 0
    cau_offset: int = 0
    index_offset: int = 0
    version: int = VERSION
    flags: int = 0
    reserved: int = 0
    magic: bytes = MAGIC_FILE
    tail: bytes = bytes(16)

    def pack(self) -> bytes:
        return HEADER.pack(self.magic, self.version, self.flags, self.meta_offset, self.meta_length, self.reserved, self.resources_offset, self.cau_offset, self.index_offset, self.tail)

    @classmethod
    def unpack(cls, data: bytes) -> Header:
        if len(data) < HEADER.size:
            raise FormatError("file is shorter than its header")
        magic, version, flags, meta, length, reserved, resources, cau, index, tail = HEADER.unpack_from(data)
        return cls(meta, length, resources, cau, index, version, flags, reserved, magic, tail)


@dataclass
class Entry:
    layer_index: int
    kind: int = EMPTY
    frame_flags: int = 0
    color: bytes = b""
    alpha: bytes = b""

    def row(self) -> tuple:
        return (self.layer_index, self.kind, self.frame_flags, self.color, self.alpha)


@dataclass
class Packet:
    pts_us: int
    duration_us: int
    data: bytes

    def row(self) -> tuple:
        return (self.pts_us, self.duration_us, self.data)


@dataclass
class Frame:
    """A composite frame: one entry for each video layer at an instant, and the instant's audio."""

    frame_index: int
    flags: int = 0
    entries: list[Entry] = field(default_factory=list)
    audio: list[Packet] = field(default_factory=list)
    reserved_13: int = 0
    reserved_18: int = 0

    def pack(self) -> bytes:
        """Numbers that don't fit raise before a byte is made."""
        try:
            body = b"".join([*(ENTRY.pack(e.layer_index, e.kind, e.frame_flags, len(e.color), len(e.alpha)) + e.color + e.alpha for e in self.entries), *(PACKET.pack(p.pts_us, p.duration_us, len(p.data)) + p.data for p in self.audio)])
            head = CAU.pack(MAGIC_CAU, CAU.size - 8 + len(body), self.frame_index, self.flags, self.reserved_13, len(self.entries), len(self.audio), self.reserved_18)
        except struct.error as e:
            raise FormatError(str(e)) from e
        return head + body

    @classmethod
    def unpack(cls, data: bytes, wanted: set[int] | None = None) -> Frame:
        """From the bytes of one composite frame; payloads of other layers than the wanted ones are passed over."""
        if len(data) < CAU.size:
            raise FormatError("composite frame is cut off")
        magic, size, index, flags, r13, n, m, r18 = CAU.unpack_from(data)
        if magic != MAGIC_CAU:
            raise FormatError("bad composite frame magic")
        end = 8 + size
        if end < CAU.size or end > len(data):
            raise FormatError("composite frame overruns its region")
        out, at = cls(index, flags, [], [], r13, r18), CAU.size
        for _ in range(n):
            if at + ENTRY.size > end:
                raise FormatError("video entry overruns its frame")
            layer, kind, ff, c, a = ENTRY.unpack_from(data, at)
            at += ENTRY.size
            if at + c + a > end:
                raise FormatError("video entry overruns its frame")
            if wanted is None or layer in wanted:
                out.entries.append(Entry(layer, kind, ff, bytes(data[at : at + c]), bytes(data[at + c : at + c + a])))
            at += c + a
        for _ in range(m):
            if at + PACKET.size > end:
                raise FormatError("audio packet overruns its frame")
            pts, duration, length = PACKET.unpack_from(data, at)
            at += PACKET.size
            if at + length > end:
                raise FormatError("audio packet overruns its frame")
            out.audio.append(Packet(pts, duration, bytes(data[at : at + length])))
            at += length
        if at != end:
            raise FormatError("bytes are left over in a composite frame")
        return out

    @property
    def is_rap(self) -> bool:
        return bool(self.flags & RAP)


def peek(data: bytes) -> int:
    """Size of the composite frame that starts here."""
    if len(data) < 8 or data[:4] != MAGIC_CAU:
        raise FormatError("bad composite frame magic")
    return 8 + struct.unpack_from("<I", data, 4)[0]


def pack_index(rows: list[tuple[int, int, int]]) -> bytes:
    """Rows (frame_index, flags, cau_offset)."""
    return INDEX.pack(MAGIC_INDEX, len(rows)) + b"".join(INDEX_ROW.pack(*r) for r in rows)


def unpack_index(data: bytes) -> tuple[bytes, int, list[tuple[int, int, int]], int]:
    """(magic, count, rows that are there, bytes left over)."""
    if len(data) < INDEX.size:
        raise FormatError("index is cut off")
    magic, count = INDEX.unpack_from(data)
    there = min(count, (len(data) - INDEX.size) // INDEX_ROW.size)
    rows = [INDEX_ROW.unpack_from(data, INDEX.size + k * INDEX_ROW.size) for k in range(there)]
    return magic, count, rows, len(data) - INDEX.size - count * INDEX_ROW.size


def walk(f: BinaryIO, start: int, end: int, wanted: set[int] | None = None) -> Iterator[tuple[int, int, Frame]]:
    """Composite frames in file order (offset, size, frame), one in memory at a time; the index isn't consulted."""
    at = start
    while at < end:
        f.seek(at)
        head = f.read(min(8, end - at))
        size = peek(head)
        if at + size > end:
            raise FormatError("composite frame overruns its region")
        f.seek(at)
        yield at, size, Frame.unpack(f.read(size), wanted)
        at += size
