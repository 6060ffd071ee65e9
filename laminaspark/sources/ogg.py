"""Ogg files with Opus as tables of timed packets (RFC 3533, RFC 7845)."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from laminaspark.functions.bits import byte_at, opus_samples
from laminaspark.functions.timegrid import samples_to_us
from laminaspark.operators.grid import opus_pts

_PAGE = struct.Struct("<4sBBqIIIB")
_END = 4


class OggError(ValueError):
    pass


def packets(data: bytes) -> tuple[list[bytes], int | None]:
    """Packets of the first logical stream, and the granule position of its last page if it is marked as the end."""
    view, at, serial, end = memoryview(data), 0, None, None
    out, open_parts = [], []
    while at < len(view):
        if len(view) - at < _PAGE.size or view[at : at + 4] != b"OggS":
            raise OggError(f"no page at byte {at}")
        _, _, flags, granule, stream, _, _, n = _PAGE.unpack_from(view, at)
        sizes = bytes(view[at + _PAGE.size : at + _PAGE.size + n])
        body = at + _PAGE.size + n
        if len(sizes) < n or body + sum(sizes) > len(view):
            raise OggError("page is cut off")
        serial = stream if serial is None else serial
        if stream == serial:
            end = granule if flags & _END else end
            for size in sizes:
                open_parts.append(view[body : body + size])
                body += size
                if size < 255:
                    out.append(b"".join(open_parts))
                    open_parts = []
        at += _PAGE.size + n + sum(sizes)
    return out, end


def pages(parts: list[bytes], granule: int, serial: int = 1) -> bytes:
    """An Ogg stream of these packets, a page each (checksums left zero); the last page ends the stream at the granule."""
    out = []
    for k, p in enumerate(parts):
        sizes = [255] * (len(p) // 255) + [len(p) % 255]
        flags = (2 if k == 0 else 0) | (_END if k == len(parts) - 1 else 0)
        out.append(_PAGE.pack(b"OggS", 0, flags, granule if k == len(parts) - 1 else 0, serial, k, 0, len(sizes)) + bytes(sizes) + p)
    return b"".join(out)


def head(first: bytes) -> dict:
    """Channels and pre-skip of an OpusHead packet."""
    if len(first) < 19 or first[:8] != b"OpusHead":
        raise OggError("no OpusHead")
    return {"channels": first[9], "pre_skip": int.from_bytes(first[10:12], "little")}


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, seq, pts_us, duration_us, data, channels, pre_skip) of Ogg-Opus files: running times from the packets' own
    lengths; the end granule cuts the last packet."""

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                found, end = packets(content)
                if not found:
                    raise OggError(f"{name}: empty stream")
                about = head(found[0])
                if len(found) < 2 or found[1][:8] != b"OpusTags":
                    raise OggError(f"{name}: no OpusTags")
                rows = [{"path": name, "seq": k, "data": p, "end": end, **about} for k, p in enumerate(p for p in found[2:] if p)]
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("path", pa.string()), ("seq", pa.int64()), ("data", pa.binary()), ("end", pa.int64()), ("channels", pa.int32()), ("pre_skip", pa.int32())]))

    raw = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, seq bigint, data binary, end bigint, channels int, pre_skip int")
    sized = raw.withColumn("samples", opus_samples(byte_at(F.col("data"), 1), byte_at(F.col("data"), 2)))
    timed = opus_pts(sized, "path", "seq", "samples").withColumnRenamed("start", "pts_us")
    w = Window.partitionBy("path").orderBy("seq")
    before = F.coalesce(F.sum("samples").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    last = F.lead("seq").over(w).isNull()
    cut = last & (F.col("end") > before) & (F.col("end") < before + F.col("samples"))
    full = samples_to_us(F.col("samples"))
    return timed.withColumn("duration_us", F.when(F.coalesce(cut, F.lit(False)), samples_to_us(F.col("end") - before)).otherwise(full)).select("path", "seq", "pts_us", "duration_us", "data", "channels", "pre_skip")
