"""Projects: a JSON description of layers and their sources, packed into a container."""

from __future__ import annotations

import json
import math
import os
import re
from collections import Counter
from dataclasses import dataclass, field
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laminaspark import api
from laminaspark.functions.scalars import BLENDS
from laminaspark.functions.timegrid import Fps, parse_decimal
from laminaspark.sources import codecs, ogg
from laminaspark.sources.shared import local


class ProjectError(ValueError):
    pass


@dataclass
class Layer:
    id: str
    kind: str
    src: str
    z: float
    rect: list[int] | None
    start: int
    end: int
    alpha: bool
    blend: str
    opacity: float
    visible: bool


@dataclass
class Project:
    output: str
    size: tuple[int, int]
    background: str
    fps: Fps
    frames: int
    gop: int
    layers: list[Layer] = field(default_factory=list)
    audio: str | None = None


def frame_near(seconds: str, fps: Fps) -> int:
    """The frame nearest to a decimal number of seconds, halves up."""
    exact = parse_decimal(seconds)
    if exact is None:
        raise ProjectError(f"{seconds!r} is no number of seconds")
    return (exact * Fraction(fps.num, fps.den) + Fraction(1, 2)).__floor__()


#: What a project file may say. Every value is read as its text, so that decimals stay exact and the table below decides.
SCHEMA = """canvas struct<width: string, height: string, background: string>, fps string, duration string, gop string, output string,
  audio struct<src: string>, layers array<struct<id: string, kind: string, src: string, z: string, rect: string, start: string, end: string,
  start_frame: string, end_frame: string, alpha: string, blend: string, opacity: string, visible: string>>"""


def _rect(text: str) -> list[int]:
    """Four whole numbers: a list, an object with x, y, w and h, or a text that parts them by commas, colons, x or spaces."""
    found = json.loads(text) if text[:1] in "[{" else re.split(r"[,:x\s]+", text.strip())
    found = [found[c] for c in "xywh"] if isinstance(found, dict) else found
    if len(found) != 4:
        raise ValueError(text)
    return [int(v) for v in found]


def _truth(text: str) -> bool:
    return {"true": True, "false": False}[text.lower()]


def _any(_) -> bool:
    return True


#: Field: (how its text is read, what the value must meet, the same in words, value if it isn't there; ... if it must be).
TOP = {
    "width": (int, lambda v: v > 0, "a whole number above 0", ...),
    "height": (int, lambda v: v > 0, "a whole number above 0", ...),
    "background": (str, re.compile("#[0-9A-Fa-f]{6}").fullmatch, "a colour like #102030", "#000000"),
    "fps": (Fps.of, _any, "a frame rate like 30 or 30000/1001", Fps(30, 1)),
    "duration": (str, _any, "seconds", ...),
    "gop": (int, lambda v: v > 0, "a whole number of frames above 0", None),
}
LAYER = {
    "id": (str, lambda v: re.fullmatch("[A-Za-z0-9_][A-Za-z0-9_.-]*", v) and not v.isdigit(), "letters, digits, _ . - and not digits alone", ...),
    "kind": (str, {"video", "still"}.__contains__, "video or still", "video"),
    "src": (str, bool, "a path", ...),
    "z": (float, math.isfinite, "a finite number", None),
    "rect": (_rect, lambda v: min(v[2:]) > 0, "x, y, w, h with a width and a height", None),
    "start_frame": (int, lambda v: v >= 0, "a frame", None),
    "end_frame": (int, lambda v: v > 0, "a frame", None),
    "start": (str, _any, "seconds", None),
    "end": (str, _any, "seconds", None),
    "alpha": (_truth, _any, "true or false", False),
    "blend": (str, BLENDS.__contains__, f"one of {', '.join(BLENDS)}", "normal"),
    "opacity": (float, lambda v: 0 <= v <= 1, "a number from 0 to 1", 1.0),
    "visible": (_truth, _any, "true or false", True),
}


def _read_fields(given: dict, fields: dict[str, tuple], where: str, faults: list[str]) -> dict:
    """Values of all fields; a field that can't be read or doesn't fit adds a fault and takes its default."""
    out = {}
    for name, (parse, fits, wants, default) in fields.items():
        text, out[name] = given.get(name), None if default is ... else default
        try:
            if text is None and default is ...:
                raise ValueError
            if text is not None:
                value = parse(text)
                if not fits(value):
                    raise ValueError
                out[name] = value
        except (ValueError, KeyError, TypeError):
            faults.append(f"{where}{name}: {'missing' if text is None else repr(text)}, should be {wants}")
    return out


def load(path: str, output: str | None = None, spark: SparkSession | None = None) -> Project:
    """Reads a project and tells all its faults at once. Times are seconds, or frames under `<name>_frame`, which win; an end
    past the file's is cut; paths are relative to the project."""
    spark = spark or SparkSession.active()
    at = local(path)
    base, faults = os.path.dirname(os.path.abspath(at)), []
    row = spark.read.schema(SCHEMA).option("multiLine", True).json(f"file://{os.path.abspath(at)}").first()
    given = row.asDict(recursive=True) if row else {}
    top = _read_fields({**given, **(given.get("canvas") or {})}, TOP, "", faults)
    if faults:
        raise ProjectError("; ".join(faults))
    fps = top["fps"]
    frames = frame_near(top["duration"], fps)
    if frames < 1:
        faults.append(f"duration: {top['duration']!r} is shorter than a frame")

    def source(name: str | None, where: str) -> str:
        found = os.path.join(base, name or "")
        if name and not os.path.exists(found):
            faults.append(f"{where}: nothing at {found}")
        return found

    layers = []
    for k, record in enumerate(given.get("layers") or []):
        where = f"layer {k} {record.get('id')!r}, "
        x = _read_fields(record, LAYER, where, faults)
        try:
            start, end = ((frame_near(x[n], fps) if x[n] is not None else d) if x[f"{n}_frame"] is None else x[f"{n}_frame"] for n, d in (("start", 0), ("end", frames)))
        except ProjectError as e:
            faults.append(f"{where}{e}")
            continue
        end = min(end, frames)
        if not 0 <= start < end:
            faults.append(f"{where}no frame from {start} to {end}")
        layers.append(Layer(x["id"], x["kind"], source(x["src"], f"{where}src"), float(k) if x["z"] is None else x["z"], x["rect"], start, end, x["alpha"], x["blend"], x["opacity"], x["visible"]))
    repeated = sorted(i for i, n in Counter(x.id for x in layers if x.id).items() if n > 1)
    if repeated or not layers:
        faults.append(f"layers: {', '.join(repeated) + ' more than once' if repeated else 'none'}")
    audio = source((given.get("audio") or {}).get("src"), "audio.src") if given.get("audio") else None
    if faults:
        raise ProjectError("; ".join(faults))
    name = output or given.get("output") or f"{os.path.splitext(os.path.basename(at))[0]}.lvd"
    return Project(os.path.join(base, name), (top["width"], top["height"]), top["background"], fps, frames, top["gop"] or max(1, round(2 * fps.num / fps.den)), layers, audio)


def _images(spark: SparkSession, index: int, layer: Layer) -> tuple[DataFrame, tuple[int, int], int]:
    """A folder of numbered PNG files, or an .npy array of N x H x W x C: one picture a frame from the layer's start on."""
    if layer.src.endswith(".npy"):
        array = np.load(layer.src, mmap_mode="r")
        n, h, w, c = array.shape
        src = layer.src

        def rows(batches):
            import pyarrow as pa

            data = np.load(src, mmap_mode="r")
            kinds = pa.schema([("layer_index", pa.int32()), ("frame", pa.int64()), ("width", pa.int32()), ("height", pa.int32()), ("channels", pa.int32()), ("data", pa.binary())])
            for batch in batches:
                yield pa.RecordBatch.from_pylist([{"layer_index": index, "frame": layer.start + k, "width": w, "height": h, "channels": c, "data": np.ascontiguousarray(data[k]).tobytes()} for k in batch.column(0).to_pylist()], schema=kinds)

        return spark.range(min(n, layer.end - layer.start)).mapInArrow(rows, api.IMAGES), (w, h), c
    names = sorted(x for x in os.listdir(layer.src) if x.endswith(".png"))[: layer.end - layer.start]
    if not names:
        raise ProjectError(f"no PNG files in {layer.src}")
    with open(os.path.join(layer.src, names[0]), "rb") as f:
        h, w, c = codecs.png_decode(f.read()).shape
    order = spark.createDataFrame([(x, layer.start + k) for k, x in enumerate(names)], "name string, frame long")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(layer.src).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")

    def decode(batches):
        import pyarrow as pa

        kinds = pa.schema([("layer_index", pa.int32()), ("frame", pa.int64()), ("width", pa.int32()), ("height", pa.int32()), ("channels", pa.int32()), ("data", pa.binary())])
        for batch in batches:
            out = []
            for frame, content in zip(batch.column("frame").to_pylist(), batch.column("content").to_pylist(), strict=True):
                image = codecs.png_decode(content)
                if image.shape != (h, w, c):
                    raise ProjectError("images of a layer differ in size")
                out.append({"layer_index": index, "frame": frame, "width": w, "height": h, "channels": c, "data": image.tobytes()})
            yield pa.RecordBatch.from_pylist(out, schema=kinds)

    return files.join(order, "name").select("frame", "content").mapInArrow(decode, api.IMAGES), (w, h), c


def pack(spark: SparkSession, project: Project, codec: str = "zlib") -> int:
    """Packs a project; a layer shorter than its range repeats its last picture."""
    layers, images, stills, at = [], None, [], 0
    for k, x in enumerate(project.layers):
        if x.kind == "still":
            with open(x.src, "rb") as f:
                png = f.read()
            image = codecs.png_decode(png)
            made = api.still_layer(x.id, k, image, (0, 0), x.start, x.end, at, png, z=x.z, blend=x.blend, opacity=x.opacity, visible=x.visible)
            made["rect"] = dict(zip("xywh", x.rect, strict=True)) if x.rect else made["rect"]
            stills.append(png)
            at += len(png)
        else:
            table, size, channels = _images(spark, k, x)
            images = table if images is None else images.unionByName(table)
            made = api.video_layer(x.id, k, size, x.start, x.end, rect=x.rect or (0, 0, *project.size), z=x.z, blend=x.blend, opacity=x.opacity, visible=x.visible, has_alpha=x.alpha or channels == 4, codec=codec)
        layers.append(made)
    if images is None:
        raise ProjectError("project has no video layer")
    sound = ogg.read(spark, project.audio).select("pts_us", "duration_us", "data") if project.audio else None
    return api.pack(spark, project.output, api.document(project.size, project.fps, project.frames, layers, gop=project.gop, background=project.background, audio=sound is not None), images, stills, sound)
