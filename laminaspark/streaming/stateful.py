"""Stateful streaming operators: sticky layers and in-order assembly."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STICKY = "layer_index int, frame bigint, us bigint, image double"


def sticky_stream(images: DataFrame, frames: int, late: int | None = None) -> DataFrame:
    """A stream of images (layer_index, frame, us, event_id, image) as frames that repeat the last image. A batch gives the
    frames up to the layer's newest one, and once more those that an image of an earlier frame changes; of a frame's rows the
    one of the greatest us counts. State: the images of the last `late` frames (all frames if not given) and the one before
    them; an image that comes later than that is left out."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, times, values, newest = (list(x) if isinstance(x, (list, tuple)) else x for x in state.get) if state.exists else ([], [], [], -1)
        rows = pd.concat(batches).sort_values(["us", "event_id"]).groupby("frame", as_index=False).last()
        given = sorted((int(f), int(u), float(v)) for f, u, v in zip(rows["frame"], rows["us"], rows["image"], strict=True) if f < frames)
        changed: set[int] = set()
        for f, us, value in given:
            k = bisect_left(at, f)
            if k < len(at) and at[k] == f:
                if us < times[k]:
                    continue
                times[k], values[k] = us, value
            elif at and k == 0 and late is not None and f < newest - late:
                continue
            else:
                at.insert(k, f)
                times.insert(k, us)
                values.insert(k, value)
            changed.add(f)
        before, newest = newest, max([newest, *changed])
        out = []
        for k, f in enumerate(at):
            end = at[k + 1] if k + 1 < len(at) else newest + 1
            out += [(key[0], g, times[k], values[k]) for g in range(f if f in changed else max(f, before + 1), end)]
        if late is not None:
            first = max(0, bisect_right(at, newest - late) - 1)
            at, times, values = at[first:], times[first:], values[first:]
        state.update((at, times, values, newest))
        yield pd.DataFrame(out, columns=["layer_index", "frame", "us", "image"])

    return images.groupBy("layer_index").applyInPandasWithState(step, STICKY, "at array<bigint>, times array<bigint>, images array<double>, newest bigint", "append", GroupStateTimeout.NoTimeout)


def assemble_stream(planes: DataFrame, parts: Sequence[int], span: int, patience: int | None = None) -> DataFrame:
    """A stream of planes (file, frame, layer_index, us) as frames in order, `span` of them a file: (file, frame, lost). A frame
    goes out when all parts are there and every frame before it in its file went out or was lost. With `patience`, a frame is
    lost, whole, when a plane of a frame as many frames later arrives before it is complete; then its planes are thrown away,
    those that come later too, and the frames behind it go on. Without, it is waited for. State: the next frame and the
    planes that wait, those of `span` frames at most."""
    need = frozenset(parts)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        file = int(key[0])
        at, held = state.get if state.exists else (file * span, [])
        waiting: dict[int, set[int]] = {}
        for text in held:
            f, layers = text.split(":")
            waiting[int(f)] = set(map(int, layers.split(",")))
        rows, out = pd.concat(batches).sort_values(["us", "frame", "layer_index"]), []
        for f, layer in zip(rows["frame"], rows["layer_index"], strict=True):
            if f < at:
                continue  # a plane of a frame that went out, or was lost
            waiting.setdefault(int(f), set()).add(int(layer))
            while True:
                whole = need <= waiting.get(at, set())
                if not whole and (patience is None or f < at + patience):
                    break
                waiting.pop(at, None)
                out.append((file, at, not whole))
                at += 1
        state.update((at, [f"{f}:{','.join(map(str, sorted(x)))}" for f, x in sorted(waiting.items())]))
        yield pd.DataFrame(out, columns=["file", "frame", "lost"])

    return planes.groupBy("file").applyInPandasWithState(step, "file bigint, frame bigint, lost boolean", "next bigint, waiting array<string>", "append", GroupStateTimeout.NoTimeout)
