"""Synthetic containers with hand-made packets, and the faults that validation must find."""

from __future__ import annotations

import copy
from collections.abc import Callable

from laminaspark.sources.layout import EMPTY, FRAME, HOLD, KEY, RAP, Entry, Frame, Packet

COUNT, GOP = 40, 10
_STILL = b"\x89PNG\r\n\x1a\n" + bytes(8)


def packet(key: bool, width: int, height: int, rgb: bool = False, full: bool = False) -> bytes:
    """An uncompressed VP9 header alone: enough for everything that validation reads."""
    profile = 1 if rgb else 0
    bits = f"10{profile & 1}{profile >> 1}0{0 if key else 1}10"
    if key:
        bits += f"{0x498342:024b}" + ("1110" if rgb else f"010{int(full)}") + f"{width - 1:016b}{height - 1:016b}"
    bits += "0000"
    bits += "0" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big")


def _layer(id_: str, z: int, rect: tuple, start: int, end: int, **more) -> dict:
    return {"id": id_, "name": id_, "z": z, "rect": dict(zip("xywh", rect, strict=True)), "start_frame": start, "end_frame": end, "blend": "normal", "opacity": 1.0, "visible": True} | more


def meta() -> dict:
    video = {"kind": "video", "lossless": False}
    return {
        "format": "LVF", "version": 1, "canvas": {"width": 64, "height": 32, "background": "#000000"}, "fps": {"num": 30, "den": 1}, "frame_count": COUNT, "max_rap_interval": GOP,
        "layers": [
            _layer("bg", 0, (0, 0, 64, 32), 0, 40, **video, codec="vp09.00.10.08", coded_width=64, coded_height=32, has_alpha=False, alpha_codec=None),
            _layer("ov", 1, (4, 4, 16, 16), 0, 40, **video, codec="vp09.00.10.08", coded_width=16, coded_height=16, has_alpha=True, alpha_codec="vp09.00.10.08", alpha_range="limited"),
            _layer("late", 2, (30, 2, 21, 13), 15, 35, **(video | {"lossless": True}), codec="vp09.01.10.08.03.01.13.00.01", coded_width=22, coded_height=14, content_size=[21, 13], has_alpha=True, alpha_codec="vp09.00.10.08", alpha_range="full"),
            _layer("s", 3, (0, 0, 8, 8), 5, 25, kind="still", resource={"offset": 0, "length": len(_STILL), "mime": "image/png"}),
        ],
        "audio": {"codec": "opus", "sample_rate": 48000, "channels": 2, "description_b64": None},
    }


def resources() -> list[bytes]:
    return [_STILL]


def frames() -> list[Frame]:
    """40 frames at 30 fps, keys at each layer's start and every tenth frame, audio every 20 ms."""
    out, pts = [], 0
    for f in range(COUNT):
        entries = []
        for k, layer in enumerate(x for x in meta()["layers"] if x["kind"] == "video"):
            if not layer["start_frame"] <= f < layer["end_frame"]:
                entries.append(Entry(k))
                continue
            key = f == layer["start_frame"] or f % GOP == 0
            w, h = layer["coded_width"], layer["coded_height"]
            alpha = packet(key, w, h, full=layer.get("alpha_range") == "full") if layer["has_alpha"] else b""
            entries.append(Entry(k, FRAME, KEY * key, packet(key, w, h, rgb=layer["lossless"]), alpha))
        audio = []
        while pts < (2 * (f + 1) * 1_000_000 + 30) // 60:
            audio.append(Packet(pts, 20_000, b"\xfc\x01\x02"))
            pts += 20_000
        rap = all(e.frame_flags & KEY for e in entries if e.kind == FRAME)
        out.append(Frame(f, RAP * rap, entries, audio))
    return out


def _set(f: Callable[[list[Frame]], None]) -> Callable[[], tuple[list[Frame], Callable]]:
    def made():
        x = frames()
        f(x)
        return x, lambda index: index

    return made


def _index(change: Callable[[list[tuple]], list[tuple]]):
    return lambda: (frames(), change)


def _alpha_mismatch(x):
    x[10].entries[1].alpha = x[11].entries[1].alpha


def _not_key(x):
    x[15].entries[2] = copy.deepcopy(x[16].entries[2])


def _swap(x):
    e = x[31].entries
    e[0], e[1] = e[1], e[0]


def _moved_audio(x):
    x[11].audio.insert(0, x[10].audio.pop())


def _at(k: int, name: str, value):
    return lambda x: setattr(x[k], name, value)


def _entry(k: int, layer: int, e: Entry):
    return lambda x: x[k].entries.__setitem__(layer, e)


#: Name: (maker of frames and of the index's change, codes that must be found, frame).
MUTATIONS: dict[str, tuple] = {
    "missing_entry": (_set(lambda x: x[30].entries.pop(2)), {"I2"}, 30),
    "entry_order": (_set(_swap), {"I2"}, 31),
    "active_entry_empty": (_set(_entry(32, 0, Entry(0))), {"I3"}, 32),
    "alpha_key_mismatch": (_set(_alpha_mismatch), {"I5", "I6"}, 10),
    "layer_start_not_key": (_set(_not_key), {"I4"}, 15),
    "rap_flag_cleared": (_set(_at(10, "flags", 0)), {"I6", "I8"}, 10),
    "frame0_not_rap": (_set(_at(0, "flags", 0)), {"I6", "I7"}, 0),
    "frame_index_gap": (_set(_at(20, "frame_index", 21)), {"I1"}, 20),
    "dropped_cau": (_set(lambda x: x.pop(20)), {"I1"}, 20),
    "audio_wrong_frame": (_set(_moved_audio), {"I9"}, 11),
    "hold_entry": (_set(_entry(33, 0, Entry(0, HOLD))), {"CAU"}, 33),
    "index_wrong_offset": (_index(lambda rows: [(f, g, o + 4 * (k == 25)) for k, (f, g, o) in enumerate(rows)]), {"I10"}, 25),
    "index_wrong_rap": (_index(lambda rows: [(f, 0 if k == 10 else g, o) for k, (f, g, o) in enumerate(rows)]), {"I10"}, 10),
}

__all__ = ["COUNT", "EMPTY", "GOP", "MUTATIONS", "frames", "meta", "packet", "resources"]
