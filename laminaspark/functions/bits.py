"""Bytes and bit fields: little-endian integers, VP9 headers, superframes, Opus packets, base64, PNG sizes, barcodes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def byte_at(data: Column, position: int | Column) -> Column:
    """The byte at a position from 1 (from the end if negative) as 0..255; null past the end."""
    one = F.substring(data, position, 1) if isinstance(position, int) else F.substr(data, position, F.lit(1))
    return F.conv(F.nullif(F.hex(one), F.lit("")), 16, 10).cast("int")


def little_endian(data: Column, position: int, width: int) -> Column:
    """An unsigned little-endian integer of up to 7 bytes."""
    return sum((F.shiftleft(byte_at(data, position + k).cast("long"), 8 * k) for k in range(1, width)), byte_at(data, position).cast("long"))


def bit_text(data: Column, first: int, n: int) -> Column:
    """Bits of `n` bytes from a position, as a text of 0 and 1; bytes past the end as zeros."""
    return F.concat(*(F.coalesce(F.lpad(F.bin(byte_at(data, first + k)), 8, "0"), F.lit("0" * 8)) for k in range(n)))


def bits(data: Column, first: int, n: int) -> Column:
    """`n` bits from bit `first` (most significant first) as a number."""
    lo, hi = first // 8, (first + n - 1) // 8
    return F.when(F.octet_length(data) > hi, F.conv(F.substring(bit_text(data, lo + 1, hi - lo + 1), first - 8 * lo + 1, n), 2, 10).cast("int"))


def vp9_header(data: Column) -> Column:
    """Struct of an uncompressed VP9 header (profiles 0 and 1): marker_ok, profile, show_existing, key, shown, sync_ok,
    color_space, color_range, width, height; sizes and colour for key frames only."""
    marker = bits(data, 0, 2) == 2
    profile = bits(data, 3, 1) * 2 + bits(data, 2, 1)
    existing = bits(data, 4, 1) == 1
    key = (bits(data, 5, 1) == 0) & ~existing
    sync = F.hex(F.substring(data, 2, 3)) == "498342"
    space = bits(data, 32, 3)
    # After the colour space: RGB has a reserved bit in profile 1; others a range bit and, in profile 1, three more bits.
    at = F.when(space == 7, F.when(profile == 1, 36).otherwise(35)).otherwise(F.when(profile == 1, 39).otherwise(36))
    tail = bit_text(data, 5, 6)
    number = lambda skip: F.when(F.octet_length(data) * 8 >= at + skip + 16, F.conv(F.substr(tail, at - 32 + 1 + skip, F.lit(16)), 2, 10).cast("int") + 1)
    good = key & sync & marker
    return F.struct(
        marker.alias("marker_ok"), profile.alias("profile"), existing.alias("show_existing"), (key & marker).alias("key"), (existing | (bits(data, 6, 1) == 1)).alias("shown"), F.when(key, sync).alias("sync_ok"),
        F.when(good, space).alias("color_space"), F.when(good, F.when(space == 7, 1).otherwise(bits(data, 35, 1))).alias("color_range"), F.when(good, number(0)).alias("width"), F.when(good, number(16)).alias("height"),
    )


def superframe(data: Column) -> Column:
    """Struct (is_superframe, frames, sizes) from the index at a packet's end; a packet without one is one frame."""
    marker = byte_at(data, -1)
    frames, width = marker.bitwiseAND(F.lit(7)) + 1, F.shiftright(marker, 3).bitwiseAND(F.lit(3)) + 1
    index = frames * width + 2
    start = F.octet_length(data) - index + 1
    there = (marker.bitwiseAND(F.lit(0xE0)) == 0xC0) & (start >= 1) & (byte_at(data, start) == marker)
    part = lambda k, j: byte_at(data, start + 1 + k * width + j).cast("long") * F.element_at(F.array(*(F.lit(1 << 8 * i).cast("long") for i in range(4))), j + 1)
    size = lambda k: F.aggregate(F.sequence(F.lit(0), width - 1), F.lit(0).cast("long"), lambda s, j: s + part(k, j))
    return F.struct(F.coalesce(there, F.lit(False)).alias("is_superframe"), F.when(there, frames).otherwise(F.lit(1)).alias("frames"), F.when(there, F.transform(F.sequence(F.lit(0), frames - 1), size)).otherwise(F.array(F.octet_length(data).cast("long"))).alias("sizes"))


def describe_vp9(data: Column) -> Column:
    return describe_header(vp9_header(data))


def describe_header(h: Column) -> Column:
    """The struct of `vp9_header` in words."""
    size = F.concat(h["width"].cast("string"), F.lit("x"), h["height"].cast("string"))
    rest = F.concat(F.lit("cs="), h["color_space"].cast("string"), F.lit(" range="), F.when(h["color_range"] == 1, "full").otherwise("limited"))
    return F.when(~F.coalesce(h["marker_ok"], F.lit(False)), "unparseable").otherwise(F.concat_ws(", ", F.when(h["key"], "key").otherwise("inter"), size, F.when(h["width"].isNotNull(), rest)))


def opus_samples(toc: Column, second: Column) -> Column:
    """48 kHz samples of an Opus packet from its first byte and, for code 3, its second (RFC 6716, section 3.1)."""
    config, code = F.shiftright(toc, 3), toc.bitwiseAND(F.lit(3))
    pick = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (k + 1).cast("int"))
    frame = F.when(config < 12, pick((480, 960, 1920, 2880), config % 4)).when(config < 16, pick((480, 960), config % 2)).otherwise(pick((120, 240, 480, 960), config % 4))
    frames = F.when(code == 0, 1).when(code < 3, 2).otherwise(second.bitwiseAND(F.lit(63)))
    return (frame * frames).cast("long")


def valid_base64(c: Column) -> Column:
    """Strict: four characters at a time, padding only at the end, nothing else."""
    return c.rlike(r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$")


def to_base64(c: Column) -> Column:
    return F.regexp_replace(F.base64(c), r"[\r\n]", "")


def png_size(data: Column) -> Column:
    """(width, height) of a PNG's header; null if the signature isn't there."""
    big = lambda at: F.conv(F.hex(F.substring(data, at, 4)), 16, 10).cast("long")
    return F.when(F.hex(F.substring(data, 1, 8)) == "89504E470D0A1A0A", F.struct(big(17).alias("width"), big(21).alias("height")))


def barcode(n: Column, width: int = 16) -> Column:
    """Cells of a frame's barcode: a start cell, the bits (most significant first) and their even parity."""
    low = F.pmod(n, F.lit(1 << width))
    return F.concat(F.lit("1"), F.lpad(F.bin(low), width, "0"), (F.bit_count(low) % 2).cast("string"))


def barcode_number(cells: Column, width: int = 16) -> Column:
    """The number of a barcode; null if start cell or parity is wrong."""
    n = F.conv(F.substring(cells, 2, width), 2, 10).cast("long")
    good = (F.substring(cells, 1, 1) == "1") & (F.substring(cells, width + 2, 1) == (F.bit_count(n) % 2).cast("string"))
    return F.when(good, n)

