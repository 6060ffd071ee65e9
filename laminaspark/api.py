"""Containers of images as tables: pack, read, composite, edit, render. Pictures go through a registered codec (raw, zlib)."""

from __future__ import annotations

import copy
import fcntl
import os
import struct
from collections.abc import Callable, Iterable, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laminaspark.functions import pixels
from laminaspark.functions.scalars import BLENDS, resolve_layer
from laminaspark.functions.timegrid import Fps, frame_at_us, pts_us
from laminaspark.operators import grid
from laminaspark.sources import codecs, lvd
from laminaspark.sources.lvd import AUDIO, ENTRIES
from laminaspark.sources.shared import local
from laminaspark.sources.validate import faults

#: Images: one row a given picture of a layer; layers repeat their last one.
IMAGES = "layer_index int, frame bigint, width int, height int, channels int, data binary"
_DECODED = "frame bigint, layer_index int, width int, height int, data binary"


def _publishable(spark: SparkSession, meta: dict):
    return faults(spark, {x["codec"] for x in meta["layers"] if x["kind"] == "video"})


def video_layer(id: str, index: int, size: tuple[int, int], start: int, end: int, *, rect: Sequence[int] | None = None, z: float | None = None, blend: str = "normal", opacity: float = 1.0, visible: bool = True, has_alpha: bool = True, codec: str = "raw") -> dict:  # noqa: A002
    w, h = size
    return {"id": id, "name": id, "kind": "video", "z": index if z is None else z, "rect": dict(zip("xywh", rect or (0, 0, w, h), strict=True)), "start_frame": start, "end_frame": end, "codec": codec, "coded_width": w, "coded_height": h, "has_alpha": has_alpha, "alpha_codec": codec if has_alpha else None, "lossless": True, "blend": blend, "opacity": opacity, "visible": visible}


def still_layer(id: str, index: int, image: np.ndarray, at: tuple[int, int], start: int, end: int, offset: int, png: bytes, **more) -> dict:  # noqa: A002
    return {"id": id, "name": id, "kind": "still", "z": index, "rect": {"x": at[0], "y": at[1], "w": image.shape[1], "h": image.shape[0]}, "start_frame": start, "end_frame": end, "resource": {"offset": offset, "length": len(png), "mime": "image/png"}, "blend": "normal", "opacity": 1.0, "visible": True} | more


def document(size: tuple[int, int], fps: Fps, frames: int, layers: list[dict], *, gop: int | None = None, background: str = "#000000", audio: bool = False) -> dict:
    return {"format": "LVF", "version": 1, "canvas": {"width": size[0], "height": size[1], "background": background}, "fps": {"num": fps.num, "den": fps.den}, "frame_count": frames, "max_rap_interval": gop or max(1, round(2 * fps.num / fps.den)), "layers": layers, "audio": {"codec": "opus", "sample_rate": 48000, "channels": 2, "description_b64": None} if audio else None}


def entries_of(images: DataFrame, layers: list[dict], frames: int, gop: int, indices: Mapping[str, int]) -> DataFrame:
    """(frame, entry) of every layer and frame: which picture a frame shows is settled on numbers alone, then each picture
    meets its frames and is encoded once a batch of them."""
    spark = images.sparkSession
    table = spark.createDataFrame([(indices[x["id"]], x["start_frame"], x["end_frame"], x["codec"], x["has_alpha"]) for x in layers], "layer_index int, start_frame long, end_frame long, codec string, has_alpha boolean")
    dense = grid.layer_grid(spark, table, frames)
    given = images.select("layer_index", "frame", F.col("frame").alias("given"))
    shown = grid.sticky(dense.join(given, ["layer_index", "frame"], "left"), ["layer_index"], "given", "source")
    pictures = images.select("layer_index", F.col("frame").alias("source"), "channels", F.col("data").alias("picture"))
    rows = shown.withColumn("is_key", (F.col("kind") == 1) & grid.key_frame(F.col("frame"), F.col("start_frame"), gop)).join(pictures, ["layer_index", "source"], "left")

    def encode(batches):
        for batch in batches:
            out = []
            for frame, layer, kind, key, codec, alpha, channels, data in zip(*(batch.column(c).to_pylist() for c in ("frame", "layer_index", "kind", "is_key", "codec", "has_alpha", "channels", "picture")), strict=True):
                color = opacity = b""
                if kind:
                    if data is None:
                        raise ValueError(f"layer {layer} has no image at its frame {frame}")
                    rgba = pixels.to_rgba(np.frombuffer(data, np.uint8).reshape(-1, 1, channels))
                    color = codecs.encode(codec, rgba[..., :3].tobytes())
                    opacity = codecs.encode(codec, rgba[..., 3].tobytes()) if alpha else b""
                out.append({"frame": frame, "entry": {"layer_index": layer, "kind": kind, "frame_flags": int(key), "color": color, "alpha": opacity}})
            kinds = pa.struct([("layer_index", pa.int32()), ("kind", pa.int32()), ("frame_flags", pa.int32()), ("color", pa.binary()), ("alpha", pa.binary())])
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("frame", pa.int64()), ("entry", kinds)]))

    return rows.select("frame", "layer_index", "kind", "is_key", "codec", "has_alpha", "channels", "picture").mapInArrow(encode, f"frame bigint, entry {ENTRIES[6:-1]}")


def frames_of(entries: DataFrame, packets: DataFrame | None, fps: Fps, frames: int) -> DataFrame:
    """Composite frames from entries (one a layer) and audio packets (pts_us, duration_us, data), with access points."""
    caus = entries.groupBy(F.col("frame").alias("frame_index")).agg(F.array_sort(F.collect_list("entry"), lambda a, b: a["layer_index"] - b["layer_index"]).alias("entries"))
    key = lambda e: (e["kind"] == 0) | (e["frame_flags"].bitwiseAND(F.lit(1)) == 1)
    caus = caus.withColumn("flags", F.forall("entries", key).cast("int"))
    if packets is None:
        return caus.withColumn("audio", F.array().cast(AUDIO))
    inside = packets.where(F.col("pts_us") < pts_us(F.lit(frames).cast("long"), fps)).withColumn("frame_index", frame_at_us(F.col("pts_us"), fps))
    sound = inside.groupBy("frame_index").agg(F.array_sort(F.collect_list(F.struct("pts_us", "duration_us", "data"))).alias("audio"))
    return caus.join(sound, "frame_index", "left").withColumn("audio", F.coalesce("audio", F.array().cast(AUDIO)))


def pack(spark: SparkSession, path: str, meta: dict, images: DataFrame, stills: Sequence[bytes] = (), packets: DataFrame | None = None) -> int:
    """Writes, audits and publishes a container from a table of images."""
    video = [x for x in meta["layers"] if x["kind"] == "video"]
    indices = {x["id"]: k for k, x in enumerate(meta["layers"])}
    fps = Fps(meta["fps"]["num"], meta["fps"]["den"])
    entries = entries_of(images, video, meta["frame_count"], meta["max_rap_interval"], indices)
    caus = frames_of(entries, packets, fps, meta["frame_count"])
    return lvd.write(caus, path, meta, stills, _publishable(spark, meta))


class RangeError(ValueError):
    """Frames outside the container."""


class WriterError(RuntimeError):
    """A writer that failed, or was closed, is used again."""


def _bytes_of(x: np.ndarray) -> np.ndarray:
    """Samples as bytes: truths as 0 and 255, floating ones from 0 to 1, whole numbers as they are."""
    if x.dtype == bool:
        return x.astype(np.uint8) * 255
    if np.issubdtype(x.dtype, np.floating):
        return np.clip(np.floor(np.nan_to_num(x) * 255 + 0.5), 0, 255).astype(np.uint8)
    if x.size and not 0 <= x.min() <= x.max() <= 255:
        raise ValueError("samples outside 0 to 255")
    return x.astype(np.uint8)


def images(spark: SparkSession, layer: int, source, start: int, end: int) -> DataFrame:
    """Pictures of a layer from its frame `start` on, as a table: of a table of images as it is (its layer set), an array of
    N x H x W x C bytes, a function of the frame number (called on the executors; None: no new picture), or any iterable of
    pictures. Arrays and iterables pass from the driver a picture at a time."""
    if isinstance(source, DataFrame):
        return source.withColumn("layer_index", F.lit(layer)).select("layer_index", "frame", "width", "height", "channels", "data")
    kinds = pa.schema([("layer_index", pa.int32()), ("frame", pa.int64()), ("width", pa.int32()), ("height", pa.int32()), ("channels", pa.int32()), ("data", pa.binary())])

    def row(frame: int, image: np.ndarray) -> dict:
        x = _bytes_of(np.asarray(image))
        x = x[..., None] if x.ndim == 2 else x
        return {"layer_index": layer, "frame": frame, "width": x.shape[1], "height": x.shape[0], "channels": x.shape[2], "data": np.ascontiguousarray(x).tobytes()}

    if callable(source):

        def call(batches):
            for batch in batches:
                for frame in batch.column(0).to_pylist():
                    if (image := source(frame)) is not None:
                        yield pa.RecordBatch.from_pylist([row(frame, image)], schema=kinds)

        return spark.range(start, end).mapInArrow(call, IMAGES)
    given = [row(start + k, image) for k, image in zip(range(end - start), source, strict=False)]
    return spark.createDataFrame(pa.Table.from_pylist(given, schema=kinds)) if given else spark.createDataFrame([], IMAGES)


class Writer:
    """A container from layers that are added one by one; it is written, audited and published when the `with` block ends well.
    A block that fails, or a layer that is refused, leaves no file and a writer that can't be used again."""

    def __init__(self, spark: SparkSession, path: str, size: tuple[int, int], fps: Fps, frames: int, *, gop: int | None = None, background: str = "#000000", codec: str = "zlib"):
        self.spark, self.path, self.codec, self.closed = spark, path, codec, False
        self.meta = document(size, fps, frames, [], gop=gop, background=background)
        self.pictures: DataFrame | None = None
        self.stills: list[bytes] = []
        self.packets: DataFrame | None = None
        self.written = 0

    def __enter__(self) -> Writer:
        return self

    def __exit__(self, kind, value, trace) -> None:
        if kind is None:
            self.close()
        self.closed = True

    def _add(self, layer: dict) -> None:
        if self.closed:
            raise WriterError("this writer is closed")
        if layer["id"] in {x["id"] for x in self.meta["layers"]} or not 0 <= layer["start_frame"] < layer["end_frame"] <= self.meta["frame_count"]:
            self.closed = True
            raise RangeError(f"layer {layer['id']!r}: its id is taken or its frames lie outside the file")
        self.meta["layers"].append(layer)

    def video(self, id: str, source, size: tuple[int, int], start: int = 0, end: int | None = None, **more) -> None:  # noqa: A002
        """A video layer of a table, an array, a function or an iterable (see `images`); it repeats its last picture."""
        end, k = self.meta["frame_count"] if end is None else end, len(self.meta["layers"])
        self._add(video_layer(id, k, size, start, end, codec=self.codec, **more))
        mine = images(self.spark, k, source, start, end)
        self.pictures = mine if self.pictures is None else self.pictures.unionByName(mine)

    def still(self, id: str, image: np.ndarray, at: tuple[int, int] = (0, 0), start: int = 0, end: int | None = None, **more) -> None:  # noqa: A002
        png = codecs.png_encode(image)
        self._add(still_layer(id, len(self.meta["layers"]), image, at, start, self.meta["frame_count"] if end is None else end, sum(map(len, self.stills)), png, **more))
        self.stills.append(png)

    def audio(self, packets: DataFrame) -> None:
        """Packets (pts_us, duration_us, data)."""
        if self.closed:
            raise WriterError("this writer is closed")
        self.packets = packets
        self.meta["audio"] = document((1, 1), Fps(1), 1, [], audio=True)["audio"]

    def close(self) -> int:
        if self.closed:
            raise WriterError("this writer is closed")
        self.closed = True
        if self.pictures is None:
            raise WriterError("a container needs a video layer")
        self.written = pack(self.spark, self.path, self.meta, self.pictures, self.stills, self.packets)
        return self.written


class Reader:
    """A container as tables."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.seen = self._state()
        self.stills: dict[int, np.ndarray] = {}
        self.file = lvd.open_file(path)
        self.meta = self.file.meta
        self.fps = Fps(self.meta["fps"]["num"], self.meta["fps"]["den"])
        self.frame_count = self.meta["frame_count"]
        if len(self.file.index) != self.frame_count:
            raise ValueError("index and frame count differ")
        self.raps = [f for f, flags, _ in self.file.index if flags & 1]

    def _state(self) -> tuple[int, int]:
        found = os.stat(local(self.path))
        return found.st_size, found.st_mtime_ns

    def changed(self) -> bool:
        """Whether the file isn't the one that was opened any more."""
        return self._state() != self.seen

    def reload(self, overrides: Mapping[str, Mapping] | None = None) -> Reader:
        """The file as it is now. overrides: fields by layer id that a viewer has set; those of layers that are still there go
        over what the file says."""
        r = Reader(self.spark, self.path)
        for x in r.layers:
            x |= (overrides or {}).get(x["id"], {})
        return r

    @property
    def layers(self) -> list[dict]:
        return self.meta["layers"]

    def layer(self, key: str | int) -> dict:
        return self.layers[self._resolve([key])[0]]

    def _resolve(self, keys: Iterable) -> list[int]:
        return resolve_layer(list(map(str, keys)), [(k, x["id"]) for k, x in enumerate(self.layers)])

    def select(self, layers: Sequence | None = None, hide: Sequence = ()) -> list[int]:
        """The layers to draw, bottom first; a list's repeats stay, and it shows invisible ones too."""
        gone = set(self._resolve(hide))
        wanted = [k for k, x in enumerate(self.layers) if x["visible"]] if layers is None else self._resolve(layers)
        return sorted((k for k in wanted if k not in gone), key=lambda k: (self.layers[k]["z"], k))

    def rap_at_or_before(self, frame: int) -> int:
        before = [r for r in self.raps if r <= frame]
        return before[-1] if before else (self.raps[0] if self.raps else 0)

    def pts_us(self, frame: int) -> int:
        return (2 * frame * 1_000_000 * self.fps.den + self.fps.num) // (2 * self.fps.num)

    def _check(self, start: int, end: int | None) -> tuple[int, int]:
        end = self.frame_count if end is None else end
        if not 0 <= start < end <= self.frame_count:
            raise RangeError(f"frames [{start}, {end}) are outside [0, {self.frame_count})")
        return start, end

    def caus(self, start: int = 0, end: int | None = None, layers: Sequence[int] | None = None, preroll: bool = False) -> DataFrame:
        """Composite frames [start, end); with preroll from the access point before start on, as codecs with references need."""
        start, end = self._check(start, end)
        if preroll:
            return lvd.read(self.spark, self.path, layers=layers, **{"from": start, "to": end})
        return lvd.read(self.spark, self.path, layers=layers).where((F.col("frame_index") >= start) & (F.col("frame_index") < end))

    def decode(self, start: int = 0, end: int | None = None, layers: Sequence | None = None) -> DataFrame:
        """(frame, layer_index, width, height, data) with RGBA pictures; both codecs here need no other frames."""
        video = [k for k in set(self.select(layers)) if self.layers[k]["kind"] == "video"]
        sizes = {k: (x["coded_width"], x["coded_height"], x["codec"]) for k, x in enumerate(self.layers) if x["kind"] == "video"}

        def run(batches):
            for batch in batches:
                out = []
                for frame, layer, color, alpha in zip(*(batch.column(c).to_pylist() for c in ("frame", "layer_index", "color", "alpha")), strict=True):
                    w, h, codec = sizes[layer]
                    rgb = np.frombuffer(codecs.decode(codec, color), np.uint8).reshape(h, w, 3)
                    a = np.frombuffer(codecs.decode(codec, alpha), np.uint8).reshape(h, w, 1) if alpha else np.full((h, w, 1), 255, np.uint8)
                    out.append({"frame": frame, "layer_index": layer, "width": w, "height": h, "data": np.concatenate([rgb, a], axis=2).tobytes()})
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("frame", pa.int64()), ("layer_index", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("data", pa.binary())]))

        each = self.caus(start, end, sorted(video)).select(F.col("frame_index").alias("frame"), F.explode("entries").alias("e")).where("e.kind = 1")
        return each.select("frame", "e.layer_index", "e.color", "e.alpha").mapInArrow(run, _DECODED)

    def layer_frames(self, key: str | int, start: int = 0, end: int | None = None) -> DataFrame:
        """A layer's own pictures within its range; none outside."""
        start, end = self._check(start, end)
        return self.decode(start, end, [key])

    def still(self, key: str | int) -> np.ndarray:
        """A still layer's picture, decoded once and not to be written to."""
        k = self._resolve([key])[0]
        if k not in self.stills:
            self.stills[k] = codecs.png_decode(lvd.resource(self.path, self.meta, k))
            self.stills[k].setflags(write=False)
        return self.stills[k]

    def frames(self, start: int = 0, end: int | None = None, layers: Sequence | None = None, hide: Sequence = (), transparent: bool = False) -> DataFrame:
        """(frame, width, height, channels, data): the layers composited in z order. Frames without a picture show the
        background. One group is one frame: as many pictures as there are layers."""
        start, end = self._check(start, end)
        order, canvas = self.select(layers, hide), self.meta["canvas"]
        size = (canvas["width"], canvas["height"])
        color = tuple(int(canvas["background"][k : k + 2], 16) / 255 for k in (1, 3, 5))
        about = [(k, self.layers[k]) for k in order]
        stills = {k: self.still(k) for k, x in about if x["kind"] == "still"}

        def draw(key, pdf: pd.DataFrame) -> pd.DataFrame:
            (frame,) = key
            pictures = {int(k): np.frombuffer(d, np.uint8).reshape(h, w, 4) for k, w, h, d in zip(pdf["layer_index"], pdf["width"], pdf["height"], pdf["data"], strict=True) if d is not None}
            drawn = [(stills.get(k, pictures.get(k)), tuple(x["rect"][c] for c in "xywh"), x["blend"], x["opacity"]) for k, x in about if x["start_frame"] <= frame < x["end_frame"] and (k in stills or k in pictures)]
            image = pixels.composite(size, None if transparent else color, drawn)
            return pd.DataFrame({"frame": [frame], "width": [size[0]], "height": [size[1]], "channels": [image.shape[2]], "data": [image.tobytes()]})

        every = self.spark.range(start, end).withColumnRenamed("id", "frame")
        pictures = self.decode(start, end, layers) if any(x["kind"] == "video" for _, x in about) else self.spark.createDataFrame([], _DECODED)
        return every.join(pictures, "frame", "left").groupBy("frame").applyInPandas(draw, "frame bigint, width int, height int, channels int, data binary")

    def frame(self, index: int, **how) -> np.ndarray:
        r = self.frames(index, index + 1, **how).first()
        return np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], r["channels"])

    def audio(self) -> DataFrame:
        return self.caus().select(F.explode("audio").alias("a")).select("a.*")


# Edits: a new file beside the old one, audited and put in its place ------------------------------------------------------


def _resources(r: Reader, kept: list[dict]) -> list[bytes]:
    at = 0
    out = []
    for x in kept:
        if x["kind"] == "still":
            out.append(lvd.resource(r.path, r.meta, next(k for k, y in enumerate(r.layers) if y["id"] == x["id"])))
            x["resource"] = x["resource"] | {"offset": at, "length": len(out[-1])}
            at += len(out[-1])
    return out


def _rewrite(r: Reader, out: str, meta: dict, removed: set[int], added: DataFrame | None = None, new_stills: Sequence[bytes] = (), packets: DataFrame | None = None, audio: str = "keep") -> int:
    """Copies packets without encoding: layers leave, indices close up, access points are set anew, audio stays, goes or comes."""
    kept = [k for k in range(len(r.layers)) if k not in removed]
    index = F.create_map(*(F.lit(x) for k, old in enumerate(kept) for x in (old, k))) if kept else None
    each = r.caus().select(F.col("frame_index").alias("frame"), F.explode("entries").alias("e")).where(~F.col("e.layer_index").isin(*(removed or {-1})))
    entries = each.select("frame", F.struct(index[F.col("e.layer_index")].alias("layer_index"), "e.kind", "e.frame_flags", "e.color", "e.alpha").alias("entry"))
    entries = entries if added is None else entries.unionByName(added)
    sound = packets if audio == "replace" else (r.audio() if audio == "keep" and r.meta["audio"] else None)
    caus = frames_of(entries, sound, r.fps, r.frame_count)
    stills = [*_resources(r, [x for x in meta["layers"] if x["id"] in {y["id"] for y in r.layers}]), *new_stills]
    return lvd.write(caus, out, meta, stills, _publishable(r.spark, meta))


def remove_layers(spark: SparkSession, path: str, keys: Sequence, out: str | None = None) -> int:
    r = Reader(spark, path)
    gone = set(r._resolve(keys))
    meta = copy.deepcopy(r.meta)
    meta["layers"] = [x for k, x in enumerate(meta["layers"]) if k not in gone]
    if not any(x["kind"] == "video" for x in meta["layers"]):
        raise ValueError("a container keeps one video layer at least")
    return _rewrite(r, out or path, meta, gone)


def add_layer(spark: SparkSession, path: str, images: DataFrame, layer: dict, out: str | None = None) -> int:
    """Appends a video layer of images (frame, width, height, channels, data); keys at its start and on the file's access points."""
    r = Reader(spark, path)
    if layer["id"] in {x["id"] for x in r.layers}:
        raise ValueError(f"layer {layer['id']!r} is already there")
    meta = copy.deepcopy(r.meta)
    at = len(meta["layers"])
    meta["layers"].append(layer)
    own = entries_of(images.withColumn("layer_index", F.lit(at)), [layer], r.frame_count, r.meta["max_rap_interval"], {layer["id"]: at})
    raps = lvd.read(spark, r.path, table="index").where(F.col("flags").bitwiseAND(F.lit(1)) == 1).select(F.col("frame_index").alias("frame"), F.lit(True).alias("rap"))
    flagged = own.join(raps, "frame", "left").withColumn("rap", F.col("rap").isNotNull() | (F.col("frame") == layer["start_frame"]))
    keyed = flagged.select("frame", F.col("entry").withField("frame_flags", ((F.col("entry.kind") == 1) & F.col("rap")).cast("int")).alias("entry"))
    return _rewrite(r, out or path, meta, set(), keyed)


def add_still(spark: SparkSession, path: str, id: str, image: np.ndarray, at: tuple[int, int] = (0, 0), start: int = 0, end: int | None = None, out: str | None = None) -> int:  # noqa: A002
    r = Reader(spark, path)
    meta, png = copy.deepcopy(r.meta), codecs.png_encode(image)
    room = sum(x["resource"]["length"] for x in meta["layers"] if x["kind"] == "still")
    meta["layers"].append(still_layer(id, len(meta["layers"]), image, at, start, r.frame_count if end is None else end, room, png))
    return _rewrite(r, out or path, meta, set(), new_stills=[png])


def set_audio(spark: SparkSession, path: str, packets: DataFrame | None, out: str | None = None) -> int:
    """Replaces the audio by packets (pts_us, duration_us, data), cut at the file's end; None removes it."""
    r = Reader(spark, path)
    meta = copy.deepcopy(r.meta)
    meta["audio"] = document((1, 1), r.fps, 1, [], audio=packets is not None)["audio"]
    return _rewrite(r, out or path, meta, set(), packets=packets, audio="remove" if packets is None else "replace")


def set_layer(path: str, key: str | int, **fields) -> None:
    """Edits name, z, rect, blend, opacity or visible in place if the new metadata fits beside the old: it is written to the
    free part of the region first and the header switched to it, so that a reader finds one or the other whole."""
    allowed = {"name", "z", "rect", "blend", "opacity", "visible", "id"}
    if set(fields) - allowed or fields.get("blend", "normal") not in BLENDS or not 0 <= fields.get("opacity", 1) <= 1:
        raise ValueError(f"can't set {fields}")
    with open(local(path), "r+b") as f:
        fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)  # one edit at a time; a second one fails at once, the lock ends with the file
        file = lvd.open_file(path)
        meta = file.meta
        k = resolve_layer([str(key)], [(i, x["id"]) for i, x in enumerate(meta["layers"])])[0]
        meta["layers"][k] |= fields
        body, h = lvd.encode_meta(meta), file.header
        lo, end = 64, h.resources_offset
        right = (end - len(body)) // 8 * 8
        at = lo if h.meta_offset - lo >= len(body) else right if right >= max(h.meta_offset + h.meta_length, lo) else None
        if at is None:
            raise ValueError("no room for the new metadata; rewrite the file")
        f.seek(at)
        f.write(body)
        f.flush()
        os.fsync(f.fileno())
        h.meta_offset, h.meta_length = at, len(body)
        f.seek(0)
        f.write(h.pack())
        f.flush()
        os.fsync(f.fileno())


# Sinks ------------------------------------------------------------------------------------------------------------------


def render_png(frames: DataFrame, folder: str, pattern: str = "%05d.png") -> None:
    """PNG files named by frame, written by the executors into a shared folder; each appears whole or not at all."""
    target = local(folder)
    os.makedirs(target, exist_ok=True)
    pattern % 1  # a bad pattern fails here

    def put(rows):
        for r in rows:
            image = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], r["channels"])
            at = os.path.join(target, pattern % r["frame"])
            with open(f"{at}.{os.getpid()}", "wb") as f:
                f.write(codecs.png_encode(image))
            os.replace(f"{at}.{os.getpid()}", at)

    frames.foreachPartition(put)


def render_npy(frames: DataFrame, path: str, progress: Callable[[int], None] | None = None) -> int:
    """One array of N x H x W x C bytes in frame order; the header is written again when the count is known. progress is called
    with the number of frames so far; an exception from it ends the work and takes the file away."""
    n, shape = 0, None

    def header() -> bytes:
        text = f"{{'descr': '|u1', 'fortran_order': False, 'shape': ({n}, {', '.join(map(str, shape))}), }}"
        return b"\x93NUMPY\x01\x00" + struct.pack("<H", 118) + text.ljust(117).encode() + b"\n"

    with open(local(path), "wb") as f:
        for r in frames.orderBy("frame").toLocalIterator():
            if shape is None:
                shape = (r["height"], r["width"], r["channels"])
                f.write(header())
            f.write(r["data"])
            n += 1
            if progress:
                try:
                    progress(n)
                except BaseException:
                    os.unlink(local(path))
                    raise
        if shape is None:
            raise ValueError("no frames")
        f.seek(0)
        f.write(header())
    return n
