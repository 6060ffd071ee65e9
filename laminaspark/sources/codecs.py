"""Packet codecs by name: raw and zlib here; others can be registered."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

import numpy as np

_CODECS: dict[str, tuple[Callable[[bytes], bytes], Callable[[bytes], bytes]]] = {"raw": (bytes, bytes), "zlib": (lambda b: zlib.compress(b, 6), zlib.decompress)}


def register(name: str, encode: Callable[[bytes], bytes], decode: Callable[[bytes], bytes]) -> None:
    _CODECS[name] = encode, decode


def encode(name: str, picture: bytes) -> bytes:
    return _CODECS[name][0](picture)


def decode(name: str, packet: bytes) -> bytes:
    return _CODECS[name][1](packet)


PNG = b"\x89PNG\r\n\x1a\n"


def png_encode(image: np.ndarray) -> bytes:
    """H x W (x 1, 3 or 4) of bytes as PNG."""
    image = image[..., None] if image.ndim == 2 else image
    h, w, c = image.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = np.concatenate([np.zeros((h, 1), np.uint8), image.reshape(h, w * c)], axis=1).tobytes()
    return PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[c], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def png_decode(data: bytes) -> np.ndarray:
    """8-bit gray, RGB and RGBA without interlacing, as H x W x C."""
    if not data.startswith(PNG):
        raise ValueError("no PNG signature")
    at, body, head = 8, b"", None
    while at < len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        part = data[at + 8 : at + 8 + n]
        head, body = (struct.unpack(">IIBBBBB", part) if kind == b"IHDR" else head), body + (part if kind == b"IDAT" else b"")
        at += 12 + n
    w, h, depth, color, _, _, interlace = head
    if depth != 8 or color not in (0, 2, 6) or interlace:
        raise ValueError("unsupported PNG form")
    c = {0: 1, 2: 3, 6: 4}[color]
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * c)
    out = np.zeros((h + 1, w * c + c), np.int64)  # a zero row above and a zero pixel to the left
    for y in range(h):
        kind, line, up = raw[y, 0], raw[y, 1:].astype(np.int64), out[y]
        now = out[y + 1]
        if kind in (0, 2):
            now[c:] = (line + (up[c:] if kind == 2 else 0)) & 255
            continue
        for x in range(w * c):
            a, b, d = now[x], up[x + c], up[x]
            if kind == 1:
                guess = a
            elif kind == 3:
                guess = (a + b) // 2
            else:
                p = a + b - d
                guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - d), 2, d))[2]
            now[x + c] = (line[x] + guess) & 255
    return out[1:, c:].astype(np.uint8).reshape(h, w, c)
