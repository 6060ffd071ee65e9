"""Validation of a container: header and metadata on the driver (one small document), frames and index as queries."""

from __future__ import annotations

import json
import math
import os
import re
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laminaspark.functions.scalars import ALPHA_RANGES, BLENDS
from laminaspark.functions.timegrid import U32, Fps
from laminaspark.operators import issues as report
from laminaspark.operators import rules
from laminaspark.sources.codecs import PNG
from laminaspark.sources.layout import HEADER, MAGIC_FILE, MAGIC_INDEX, VERSION, FormatError, Header, unpack_index
from laminaspark.sources.lvd import INDEX, read
from laminaspark.sources.shared import local, shared_dir

ISSUE = "code string, message string, frame bigint, severity string"
LAYERS = "layer_index int, id string, kind_name string, start_frame bigint, end_frame bigint, codec string, coded_width bigint, coded_height bigint, has_alpha boolean, alpha_range string"
Found = tuple[str, str, None, str]


class Fatal(Exception):
    """Nothing after this can be judged."""


def _int(x, least: int | None = None) -> bool:
    return isinstance(x, int) and not isinstance(x, bool) and (least is None or x >= least)


def header_issues(h: Header, size: int) -> Iterator[Found]:
    error = lambda text: ("HDR", text, None, "error")
    if h.magic != MAGIC_FILE:
        raise Fatal("HDR", "bad magic")
    if h.version != VERSION:
        yield error(f"version {h.version}")
    if h.flags:
        yield error("flags aren't zero")
    if h.reserved or any(h.tail):
        yield ("HDR", "reserved bytes aren't zero", None, "warning")
    if h.meta_offset < HEADER.size or h.meta_offset + h.meta_length > h.resources_offset or not h.meta_offset <= h.resources_offset <= h.cau_offset <= h.index_offset <= size:
        raise Fatal("HDR", "offsets are out of order or outside the file")


def parse_meta(raw: bytes) -> dict:
    """Strict JSON: UTF-8 without a mark, an object, finite numbers."""

    def refuse(x):
        raise ValueError(f"number {x}")

    def number(x):
        v = float(x)
        return v if math.isfinite(v) else refuse(x)

    if raw.startswith(b"\xef\xbb\xbf"):
        raise Fatal("META", "metadata starts with a byte order mark")
    try:
        doc = json.loads(raw.decode("utf-8"), parse_constant=refuse, parse_float=number)
    except (ValueError, RecursionError) as e:
        raise Fatal("META", f"metadata isn't JSON: {e}") from e
    if not isinstance(doc, dict):
        raise Fatal("META", "metadata isn't an object")
    return doc


def meta_issues(m: dict, resource, room: int, codecs: frozenset[str] = frozenset()) -> Iterator[Found]:
    """The rules of the metadata; those without which frames can't be judged are fatal."""
    error = lambda text, code="META": (code, text, None, "error")

    def need(ok: bool, text: str) -> None:
        if not ok:
            raise Fatal("META", text)

    canvas, fps = m.get("canvas"), m.get("fps")
    if m.get("format") != "LVF":
        yield error("format isn't LVF")
    if not _int(m.get("version")) or m["version"] != 1:
        yield error("version isn't 1")
    if not isinstance(canvas, dict) or not all(_int(canvas.get(k), 1) for k in ("width", "height")):
        yield error("canvas size isn't positive")
    if not isinstance(canvas, dict) or not re.fullmatch("#[0-9A-Fa-f]{6}", str(canvas.get("background"))):
        yield error("background isn't #RRGGBB")
    need(isinstance(fps, dict) and all(_int(fps.get(k), 1) for k in ("num", "den")), "fps")
    for k in ("frame_count", "max_rap_interval"):
        need(_int(m.get(k), 1), k)
    need(isinstance(m.get("layers"), list), "layers aren't a list")
    seen: set = set()
    for i, x in enumerate(m["layers"]):
        need(isinstance(x, dict), f"layer {i} isn't an object")
        name = lambda text, i=i: f"layer {i}: {text}"
        if not isinstance(x.get("id"), str) or not x["id"] or x["id"] in seen:
            yield error(name("id is missing or not unique"))
        seen.add(x.get("id"))
        if not isinstance(x.get("name", ""), str):
            yield error(name("name isn't text"))
        if not isinstance(x.get("z"), (int, float)) or isinstance(x.get("z"), bool):
            yield error(name("z isn't a number"))
        rect = x.get("rect")
        if not isinstance(rect, dict) or not all(_int(rect.get(k)) for k in "xywh") or min(rect["w"], rect["h"]) <= 0:
            yield error(name("rect"))
        need(x.get("kind") in ("video", "still"), name("kind"))
        need(_int(x.get("start_frame"), 0) and _int(x.get("end_frame")) and x["start_frame"] < x["end_frame"] <= m["frame_count"], name("frame range"))
        if x.get("blend") not in BLENDS:
            yield error(name("blend"))
        opacity = x.get("opacity")
        if isinstance(opacity, bool) or not isinstance(opacity, (int, float)) or not 0 <= opacity <= 1:
            yield error(name("opacity"))
        if not isinstance(x.get("visible"), bool):
            yield error(name("visible"))
        if x["kind"] == "video":
            yield from (error(name(t)) for t in _video_faults(x, codecs))
            need(isinstance(x.get("has_alpha"), bool), name("has_alpha"))
        else:
            yield from (error(name(t), "RES") for t in _still_faults(x.get("resource"), resource, room))
    if "audio" not in m:
        yield error("audio is missing")
    elif m["audio"] is not None:
        a = m["audio"]
        if not isinstance(a, dict):
            yield error("audio isn't an object", "AUD")
        else:
            yield from (error(f"audio {k}", "AUD") for k, ok in (("codec", a.get("codec") == "opus"), ("rate", a.get("sample_rate") == 48000), ("channels", a.get("channels") in (1, 2)), ("description", _description(a.get("description_b64")))) if not ok)
            need(a.get("pre_skip") is None or _int(a["pre_skip"], 0), "audio pre_skip")
    fits = [*(fps[k] for k in ("num", "den")), m["frame_count"], m["max_rap_interval"], *((canvas or {}).get(k, 0) for k in ("width", "height"))]
    need(all(not _int(v) or v <= U32 for v in fits), "a number is too large")
    need(isinstance(m.get("generator", ""), str), "generator isn't text")
    need(all(abs(v) <= 2**31 for x in m["layers"] for v in (x.get("rect") or {}).values() if _int(v)), "a rect is too large")


def _video_faults(x: dict, codecs: frozenset[str]) -> Iterator[str]:
    own = x.get("codec") in codecs
    codec = re.fullmatch(r"vp09\.(\d\d)\.\d\d\.\d\d(?:\.\d\d)*", str(x.get("codec")))
    if not own and (not codec or int(codec[1]) > 1):
        yield "codec"
    if not isinstance(x.get("lossless", False), bool):
        yield "lossless"
    sides = [x.get("coded_width"), x.get("coded_height")]
    if not all(_int(v, 1) for v in sides):
        yield "coded size"
    content = x.get("content_size")
    if content is not None and not (isinstance(content, list) and len(content) == 2 and all(_int(v, 1) for v in content) and all(_int(s) and v <= s for v, s in zip(content, sides, strict=True))):
        yield "content size"
    if x.get("alpha_range") not in (None, *ALPHA_RANGES):
        yield "alpha range"
    alpha = x.get("alpha_codec")
    if x.get("has_alpha") is True and not own and not str(alpha).startswith("vp09."):
        yield "alpha codec is missing"
    if x.get("has_alpha") is False and alpha is not None:
        yield "alpha codec without alpha"


def _still_faults(r, resource, room: int) -> Iterator[str]:
    if not isinstance(r, dict) or not _int(r.get("offset"), 0) or not _int(r.get("length"), 1) or r["offset"] + r["length"] > room:
        yield "resource is outside the region"
        return
    if r.get("mime") != "image/png":
        yield "mime"
    if resource(r["offset"], 8) != PNG:
        yield "no PNG signature"


def _description(text) -> bool:
    import base64
    import binascii

    if text is None:
        return True
    try:
        return isinstance(text, str) and len(text) % 4 == 0 and base64.b64decode(text, validate=True).startswith(b"OpusHead")
    except (ValueError, binascii.Error):
        return False


def layer_table(spark: SparkSession, meta: dict) -> DataFrame:
    rows = [(i, x["id"], x["kind"], x["start_frame"], x["end_frame"], x.get("codec"), x.get("coded_width"), x.get("coded_height"), x.get("has_alpha"), x.get("alpha_range") if x["kind"] == "video" else None) for i, x in enumerate(meta["layers"])]
    return spark.createDataFrame(rows, LAYERS)


def heads(spark: SparkSession, path: str) -> DataFrame:
    """One pass over a container's frames, kept in the shared folder without payloads."""
    entries = F.transform("entries", rules.entry_head)
    audio = F.transform("audio", lambda a: F.struct(a["pts_us"].alias("pts_us"), a["duration_us"].alias("duration_us"), F.substring(a["data"], 1, 1).alias("data")))
    at = shared_dir(spark, "heads")
    rows = read(spark, path, "walk").withColumns({"entries": entries, "audio": audio})
    rows.write.parquet(at)
    return spark.read.schema(rows.schema).parquet(at)


def validate(spark: SparkSession, path: str, codecs: Iterable[str] = ()) -> DataFrame:
    """Issues of one container: code, message, frame, severity, uncapped (see `operators.issues` for the cap). codecs: names
    that layers may have beside VP9; their packets are opaque and count as what their flags claim."""
    small: list[Found] = []
    try:
        with open(local(path), "rb") as f:
            size = os.fstat(f.fileno()).st_size
            try:
                header = Header.unpack(f.read(HEADER.size))
            except FormatError as e:
                raise Fatal("HDR", str(e)) from e
            small += header_issues(header, size)

            def resource(at: int, n: int) -> bytes:
                f.seek(header.resources_offset + at)
                return f.read(n)

            f.seek(header.meta_offset)
            meta = parse_meta(f.read(header.meta_length))
            for x in meta_issues(meta, resource, header.cau_offset - header.resources_offset, frozenset(codecs)):
                small.append(x)
            f.seek(header.index_offset)
            rows: list[tuple[int, int, int]] = []
            try:
                magic, count, rows, left = unpack_index(f.read())
                small += [("I10", text, None, "error") for text, bad in (("bad index magic", magic != MAGIC_INDEX), ("index count isn't the frame count", count != meta["frame_count"]), ("index is cut off", len(rows) < count), ("bytes follow the index", left > 0)) if bad]
            except FormatError as e:
                small.append(("I10", str(e), None, "error"))
    except Fatal as e:
        return spark.createDataFrame([*small, (e.args[0], e.args[1], None, "error")], ISSUE)
    walked = heads(spark, path)
    caus = walked.where("fault IS NULL")
    inside = caus.where(F.col("frame_index") < meta["frame_count"])
    layers, fps = layer_table(spark, meta), Fps(meta["fps"]["num"], meta["fps"]["den"])
    n, most = meta["frame_count"], meta["max_rap_interval"]
    found = [rules.issue(walked.where("fault IS NOT NULL"), "CAU", F.col("fault"), None), *rules.numbering(caus, n), *rules.entries(inside, layers), *rules.access_points(inside, layers, n, most), *rules.audio(inside, fps, meta.get("audio") is not None), *rules.index_rows(caus, spark.createDataFrame([(path, i, *r) for i, r in enumerate(rows)], INDEX))]
    out = rules.union(found).orderBy("seq").select("code", "message", "frame", "severity")
    return spark.createDataFrame(small, ISSUE).unionByName(out) if small else out


def faults(spark: SparkSession, codecs: Iterable[str] = ()):
    """A check for `publish`: the texts of the first errors."""

    def check(path: str) -> list[str]:
        return [f"{r['code']}: {r['message']}" for r in validate(spark, path, codecs).where("severity = 'error'").limit(report.MOST).collect()]

    return check


def stats(spark: SparkSession, path: str, meta: dict) -> DataFrame:
    """Frames, key frames (by the packets' headers) and bytes of each video layer."""
    layers = layer_table(spark, meta)
    e = rules.entry_table(heads(spark, path).where("fault IS NULL"), layers)
    keyed = e.withColumn("is_key", F.col("color_key") & (~F.col("has_alpha_data") | F.col("alpha_key")))
    return report.layer_stats(keyed, layers.where("kind_name = 'video'"))
