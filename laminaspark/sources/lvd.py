"""The container as a Spark data source (format "lvd"), partitioned by groups of frames from access point to access point."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from laminaspark.sources.layout import FRAME, HEADER, RAP, Entry, FormatError, Frame, Header, Packet, pack_index, unpack_index, walk
from laminaspark.sources.shared import local, shared_dir

ENTRIES = "array<struct<layer_index:int,kind:int,frame_flags:int,color:binary,alpha:binary>>"
AUDIO = "array<struct<pts_us:bigint,duration_us:bigint,data:binary>>"
CAUS = f"path string, k bigint, offset bigint, size bigint, frame_index bigint, flags int, reserved_13 int, reserved_18 int, entries {ENTRIES}, audio {AUDIO}, fault string"
INDEX = "path string, i bigint, frame_index bigint, flags int, cau_offset bigint"


@dataclass
class Opened:
    """What the driver knows of a file: header, metadata, index."""

    path: str
    header: Header
    meta: dict
    index: list[tuple[int, int, int]]
    size: int


def open_file(path: str) -> Opened:
    with open(local(path), "rb") as f:
        size = os.fstat(f.fileno()).st_size
        header = Header.unpack(f.read(HEADER.size))
        if header.magic != b"LVF1":
            raise FormatError(f"{path}: not a container")
        f.seek(header.meta_offset)
        meta = json.loads(f.read(header.meta_length))
        f.seek(header.index_offset)
        magic, count, rows, left = unpack_index(f.read())
    if magic != b"IDX1" or len(rows) != count or left != 0:
        raise FormatError(f"{path}: bad index")
    return Opened(path, header, meta, rows, size)


def check_index(file: Opened) -> None:
    """Refuses an index that can't lead a scan: frames and offsets must rise from row to row, offsets lie among the composite
    frames, and the first frame be an access point."""
    h, rows = file.header, file.index
    for (frame, _, at), (after, _, next_at) in zip(rows, rows[1:], strict=False):
        if after <= frame or next_at <= at:
            raise FormatError(f"{file.path}: index doesn't rise after frame {frame}")
    if rows and not (h.cau_offset <= rows[0][2] and rows[-1][2] < h.index_offset):
        raise FormatError(f"{file.path}: index points outside the composite frames")
    if rows and not rows[0][1] & RAP:
        raise FormatError(f"{file.path}: the first frame is no access point")


def check_frame(c: Frame, meta: dict) -> None:
    """Refuses a composite frame that its metadata contradicts: one entry a video layer in order, a picture where the layer is
    active and only there, and an alpha plane where the layer has one."""
    video = [(k, x) for k, x in enumerate(meta["layers"]) if x["kind"] == "video"]
    if [e.layer_index for e in c.entries] != [k for k, _ in video]:
        raise FormatError(f"frame {c.frame_index}: entries aren't the video layers in order")
    for e, (k, x) in zip(c.entries, video, strict=True):
        active = x["start_frame"] <= c.frame_index < x["end_frame"]
        if active != (e.kind == FRAME) or (active and not e.color) or bool(e.alpha) != (active and bool(x.get("has_alpha"))):
            raise FormatError(f"frame {c.frame_index}: layer {k} and its entry differ")


def read_at(path: str, offset: int, layers: Sequence[int] | None = None) -> Frame:
    """The one composite frame that starts at a byte offset."""
    with open(local(path), "rb") as f:
        end = Header.unpack(f.read(HEADER.size)).index_offset
        if not HEADER.size <= offset < end:
            raise FormatError(f"{path}: no composite frame at {offset}")
        return next(walk(f, offset, end, None if layers is None else set(layers)))[2]


def resource(path: str, meta: dict, layer: int) -> bytes:
    """A still layer's image."""
    at = meta["layers"][layer]["resource"]
    with open(local(path), "rb") as f:
        f.seek(Header.unpack(f.read(HEADER.size)).resources_offset + at["offset"])
        return f.read(at["length"])


@dataclass
class Span(InputPartition):
    """Composite frames first..last of a file's index, which lie from byte start to end."""

    path: str
    first: int
    start: int
    end: int
    index: tuple = ()

    def __post_init__(self):
        super().__init__(self.path)


class LvdReader(DataSourceReader):
    """Options: path (a file, or a folder of *.lvd), table (caus, index, walk), layers (indices to keep), spans (bytes a
    partition aims at), from and to (frames, of which reading starts at the access point before the first, so that codecs
    which need earlier frames find them), strict (holds frames to the metadata too). `caus` follows the index, starts
    partitions at access points and checks each frame against its row of the index; `walk` ignores the index and gives a
    last row with `fault` where the structure breaks."""

    def __init__(self, options):
        self.table = options.get("table", "caus")
        at = local(options["path"])
        self.paths = sorted(os.path.join(at, n) for n in os.listdir(at) if n.endswith(".lvd")) if os.path.isdir(at) else [at]
        self.layers = {int(x) for x in options["layers"].split(",")} if options.get("layers") else None
        self.aim = int(options.get("spans", 32 << 20))
        self.low, self.high = 0, 1 << 62
        self.start, self.stop = int(options.get("from", 0)), int(options.get("to", 1 << 62))
        self.strict = str(options.get("strict", "false")).lower() == "true"

    def pushFilters(self, filters: list[Filter]):
        """Bounds on frame_index choose spans by the index; rows outside are dropped while reading."""
        for f in filters:
            if self.table == "caus" and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute == ("frame_index",):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.high = min(self.high, f.value - isinstance(f, LessThan))
            else:
                yield f

    def partitions(self) -> list[Span]:
        if self.table != "caus":
            return [Span(p, 0, 0, 0) for p in self.paths]
        out = []
        for path in self.paths:
            file = open_file(path)
            check_index(file)
            ends = [r[2] for r in file.index[1:]] + [file.header.index_offset]
            before = [r[0] for r in file.index if r[1] & RAP and r[0] <= self.start]
            low = max(self.low, before[-1] if before else self.start)
            inside = [k for k, r in enumerate(file.index) if low <= r[0] <= self.high and r[0] < self.stop]
            held: list[int] = []
            for k in [*inside, None]:
                if held and (k is None or (file.index[k][1] & RAP and ends[held[-1]] - file.index[held[0]][2] >= self.aim)):
                    out.append(Span(path, held[0], file.index[held[0]][2], ends[held[-1]], tuple(file.index[j] for j in held)))
                    held = []
                if k is not None:
                    held.append(k)
        return out

    def read(self, partition: Span) -> Iterator[tuple]:
        if self.table == "index":
            for i, (frame, flags, offset) in enumerate(open_file(partition.path).index):
                yield partition.path, i, frame, flags, offset
            return
        with open(partition.path, "rb") as f:
            start, end = partition.start, partition.end
            if self.table == "walk":
                header = Header.unpack(f.read(HEADER.size))
                start, end = header.cau_offset, header.index_offset
            k = partition.first
            at = start
            meta = open_file(partition.path).meta if self.strict and self.layers is None else None
            try:
                for at, size, c in walk(f, start, end, self.layers):
                    if partition.index and (c.frame_index, c.flags & RAP, at) != (partition.index[k - partition.first][0], partition.index[k - partition.first][1] & RAP, partition.index[k - partition.first][2]):
                        raise FormatError(f"{partition.path}: frame {c.frame_index} at {at} isn't what the index says")
                    if meta and self.table == "caus":
                        check_frame(c, meta)
                    at += size
                    if self.table == "walk" or self.low <= c.frame_index <= self.high:
                        yield partition.path, k, at - size, size, c.frame_index, c.flags, c.reserved_13, c.reserved_18, [e.row() for e in c.entries], [p.row() for p in c.audio], None
                    k += 1
            except FormatError as e:
                if self.table != "walk":
                    raise
                yield partition.path, k, at, 0, None, 0, 0, 0, [], [], str(e)


class LvdSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lvd"

    def schema(self) -> str:
        return INDEX if self.options.get("table") == "index" else CAUS

    def reader(self, schema) -> LvdReader:
        return LvdReader(self.options)


def read(spark: SparkSession, path: str, table: str = "caus", layers: Sequence[int] | None = None, **options) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LvdSource)
    reader = spark.read.format("lvd").option("table", table).options(**options)
    return (reader.option("layers", ",".join(map(str, layers))) if layers is not None else reader).load(path)


def scan_binary(spark: SparkSession, path: str) -> DataFrame:
    """`walk` of whole files through Spark's own readers, for stores that Python can't open; a row a file, up to 2 GB."""

    def run(batches):
        import io

        for batch in batches:
            for path_, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                header = Header.unpack(content)
                rows = [(path_, k, at, size, c.frame_index, c.flags) for k, (at, size, c) in enumerate(walk(io.BytesIO(content), header.cau_offset, header.index_offset))]
                names = ("path", "k", "offset", "size", "frame_index", "flags")
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=pa.schema([("path", pa.string()), *((n, pa.int64()) for n in names[1:])]))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, k bigint, offset bigint, size bigint, frame_index bigint, flags bigint")


def meta_capacity(n: int) -> int:
    return max(4096, -(-2 * n // 4096) * 4096)


def encode_meta(meta: dict) -> bytes:
    """Readable JSON; numbers that aren't finite are refused."""
    return json.dumps(meta, indent=2, ensure_ascii=False, allow_nan=False).encode()


def write_file(path: str, meta: dict, resources: Sequence[bytes], frames: Iterator[Frame], index: Callable[[list[tuple[int, int, int]]], bytes] = pack_index) -> int:
    """Writes frames in their order, one in memory at a time; the header comes last. Returns how many there were. index: packs
    the index from its rows."""
    body = encode_meta(meta)
    with open(local(path), "wb") as f:
        f.write(bytes(HEADER.size) + body + bytes(meta_capacity(len(body)) - len(body)))
        at_resources = f.tell()
        for r in resources:
            f.write(r)
        at_caus, rows = f.tell(), []
        for c in frames:
            rows.append((c.frame_index, c.flags & RAP, f.tell()))
            f.write(c.pack())
        at_index = f.tell()
        f.write(index(rows))
        f.seek(0)
        f.write(Header(HEADER.size, len(body), at_resources, at_caus, at_index).pack())
        f.flush()
        os.fsync(f.fileno())
    return len(rows)


def publish(tmp: str, dst: str, check: Callable[[str], Sequence[str]]) -> None:
    """Write, audit, publish: the new file replaces the old one only if the check finds nothing; else it is removed."""
    faults = list(check(tmp))
    if faults:
        os.unlink(local(tmp))
        raise FormatError(f"not published, {len(faults)} fault(s): {'; '.join(faults[:5])}")
    os.replace(local(tmp), local(dst))


def write(caus: DataFrame, path: str, meta: dict, resources: Sequence[bytes] = (), check: Callable[[str], Sequence[str]] | None = None) -> int:
    """One container from a table of composite frames (frame_index, flags, entries, audio). A container is one ordered byte
    stream, so its frames pass the driver partition by partition; nothing is gathered."""
    tmp = f"{local(path)}.tmp"
    rows = caus.select("frame_index", "flags", "entries", "audio").orderBy("frame_index").toLocalIterator(prefetchPartitions=True)
    made = (Frame(r["frame_index"], r["flags"], [Entry(e["layer_index"], e["kind"], e["frame_flags"], bytes(e["color"] or b""), bytes(e["alpha"] or b"")) for e in r["entries"]], [Packet(p["pts_us"], p["duration_us"], bytes(p["data"])) for p in r["audio"]]) for r in rows)
    n = write_file(tmp, meta, resources, made)
    publish(tmp, path, check or (lambda _: ()))
    return n


__all__ = ["LvdSource", "check_frame", "check_index", "open_file", "publish", "read", "read_at", "resource", "scan_binary", "shared_dir", "write", "write_file"]
