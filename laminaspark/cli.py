"""Command line: info, check, pack, add, rm, set, render, extract, testsrc, corrupt. Exit code 0: fine, 1: faults found, 2: it failed."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from laminaspark import api
from laminaspark.functions import scalars
from laminaspark.functions.scalars import positions, thousands
from laminaspark.operators import issues
from laminaspark.sources import codecs, layout, lvd, project, testsrc, validate


def info(spark: SparkSession, path: str) -> dict:
    """What a container holds: counts, access points, bytes and bit rates of its layers, audio."""
    file = lvd.open_file(path)
    m = file.meta
    seconds = m["frame_count"] * m["fps"]["den"] / m["fps"]["num"]
    raps = [f for f, flags, _ in file.index if flags & 1]
    heads = validate.heads(spark, path)
    audio = heads.select(F.explode("audio").alias("a")).agg(F.count(F.lit(1)).alias("n")).first()["n"]
    words = spark.range(1).select(positions(F.array(*map(F.lit, raps)) if raps else F.array().cast("array<int>"), 12).alias("raps"), thousands(F.lit(file.size)).alias("size")).first()
    rate = lambda n, frames: round(n * 8 / (frames * m["fps"]["den"] / m["fps"]["num"]) / 1000, 1) if frames else 0.0
    layers = [{"index": r.layer_index, "id": m["layers"][r.layer_index]["id"], "frames": r.frames, "keyframes": r.keyframes, "color_kbps": rate(r.color_bytes, r.frames), "alpha_kbps": rate(r.alpha_bytes, r.frames)} for r in validate.stats(spark, path, m).orderBy("layer_index").collect()]
    return {"size": file.size, "size_text": words["size"], "frames": len(file.index), "frame_count": m["frame_count"], "seconds": seconds, "raps": words["raps"], "layers": layers, "audio_packets": audio, "meta": m}


def frame_range(spark: SparkSession, spec: str | None, r: api.Reader) -> tuple[int, int]:
    """N, A:B, A: or :B, in frames or with an s in seconds."""
    start, end, valid = spark.range(1).select(*scalars.frame_range(F.lit(spec or ""), r.fps, r.frame_count)).first()
    if not valid:
        raise api.RangeError(f"{spec!r} names no frames of {r.frame_count}")
    return start, end


def shortened(value):
    """Metadata for the eye: long texts are cut."""
    if isinstance(value, dict):
        return {k: shortened(v) for k, v in value.items()}
    if isinstance(value, list):
        return [shortened(v) for v in value]
    return f"{value[:40]}…" if isinstance(value, str) and len(value) > 40 else value


def _add(spark: SparkSession, args) -> int:
    """A still from a PNG file, or a video layer from a folder of them or an .npy array."""
    r = api.Reader(spark, args.path)
    start = int(args.start or 0)
    at = [int(v) for v in args.rect.split(",")] if args.rect else None
    if args.source.endswith(".png"):
        with open(args.source, "rb") as f:
            return api.add_still(spark, args.path, args.id, codecs.png_decode(f.read()), tuple(at[:2]) if at else (0, 0), start, None, args.output)
    given = project.Layer(args.id, "video", args.source, 0, at, start, r.frame_count, False, "normal", 1.0, True)
    table, size, channels = project._images(spark, 0, given)
    layer = api.video_layer(args.id, len(r.layers), size, start, r.frame_count, rect=at, has_alpha=channels == 4, codec="zlib")
    return api.add_layer(spark, args.path, table.drop("layer_index"), layer, args.output)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="laminaspark")
    sub = parser.add_subparsers(dest="command", required=True)
    for name, more in {"info": ("--json", "--frames"), "check": (), "pack": ("--output",), "add": ("id", "source", "--start", "--rect", "--output"), "rm": ("layers", "--output"), "set": ("layer", "fields"), "render": ("output", "--range", "--layers", "--hide", "--transparent"), "extract": ("layer", "output", "--range"), "testsrc": (), "corrupt": ("fault",)}.items():
        p = sub.add_parser(name)
        p.add_argument("path")
        for a in more:
            p.add_argument(a, **({"action": "store_true"} if a in ("--json", "--transparent", "--frames") else {}), **({"nargs": "+"} if a in ("layers", "fields") else {}))
    args = parser.parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    try:
        if args.command == "info" and args.frames:
            print(json.dumps(shortened(lvd.open_file(args.path).meta), indent=1, ensure_ascii=False))
            for r in validate.heads(spark, args.path).orderBy("k").toLocalIterator():
                print(f"frame {r.frame_index} at {r.offset}, {r.size} bytes{', access point' if r.flags & 1 else ''}: {len(r.entries)} entries, {len(r.audio)} audio packets")
        elif args.command == "info":
            found = info(spark, args.path)
            print(json.dumps(found) if args.json else "\n".join([f"size {found['size_text']} bytes", f"frames {found['frames']} ({found['seconds']:.3f} s)", f"access points {found['raps']}", *(f"layer {x['index']} {x['id']}: {x['frames']} frames, {x['keyframes']} key, {x['color_kbps']} + {x['alpha_kbps']} kbit/s" for x in found["layers"]), f"audio {found['audio_packets']} packets"]))
        elif args.command == "check":
            own = {x["codec"] for x in lvd.open_file(args.path).meta["layers"] if x["kind"] == "video" and not x["codec"].startswith("vp09")} if _opens(args.path) else ()
            found = validate.validate(spark, args.path, own).withColumn("seq", F.monotonically_increasing_id()).cache()
            for r in issues.capped(found, ["seq"]).orderBy("seq").collect():
                print(f"{r.severity} {r.code} {'' if r.frame is None else f'frame {r.frame} '}{r.message}")
            for r in issues.suppressed(found).where("suppressed > 0").collect():
                print(f"... and {r.suppressed} more {r.what}")
            return int(found.where("severity = 'error'").count() > 0)
        elif args.command == "pack":
            print(project.pack(spark, project.load(args.path, args.output, spark)), "frames")
        elif args.command == "rm":
            print(api.remove_layers(spark, args.path, args.layers, args.output), "frames")
        elif args.command == "set":
            api.set_layer(args.path, args.layer, **{k: _value(v) for k, v in (x.split("=", 1) for x in args.fields)})
        elif args.command == "add":
            print(_add(spark, args), "frames")
        elif args.command == "testsrc":
            print(lvd.write_file(args.path, testsrc.meta(), testsrc.resources(), iter(testsrc.frames())), "frames")
        elif args.command == "corrupt":
            frames, change = testsrc.MUTATIONS[args.fault][0]()
            lvd.write_file(args.path, testsrc.meta(), testsrc.resources(), iter(frames), lambda rows: layout.pack_index(change(rows)))
            print(f"{args.path}: {', '.join(sorted(testsrc.MUTATIONS[args.fault][1]))}")
        else:
            r = api.Reader(spark, args.path)
            start, end = frame_range(spark, args.range, r)
            if args.command == "extract":
                frames = r.layer_frames(args.layer, start, end).withColumn("channels", F.lit(4))
            else:
                frames = r.frames(start, end, args.layers.split(",") if args.layers else None, args.hide.split(",") if args.hide else (), args.transparent)
            if args.output.endswith(".npy"):
                api.render_npy(frames, args.output)
            else:
                folder, _, name = args.output.rpartition("/")
                api.render_png(frames, *((folder, name) if "%" in name else (args.output,)))
    except Exception as e:  # noqa: BLE001  the exit code says that it failed
        print(f"error: {e}", file=sys.stderr)
        return 2
    return 0


def _opens(path: str) -> bool:
    try:
        return bool(lvd.open_file(path).meta["layers"])
    except (ValueError, KeyError, OSError):
        return False


def _value(text: str):
    try:
        return json.loads(text)
    except ValueError:
        return text


if __name__ == "__main__":
    sys.exit(main())
