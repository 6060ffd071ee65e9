"""Pixel kernels and blending as Column expressions, and numpy forms of the plane kernels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from laminaspark.functions.scalars import quantise
from laminaspark.functions.timegrid import div

KR, KB = 0.2126, 0.0722
# BT.709 limited range in 16-bit fixed point.
LUMA = [round(k * 219 / 255 * 65536) for k in (KR, 1 - KR - KB, KB)]
CB = [round(k * 224 / 255 * 65536) for k in (-KR / (2 * (1 - KB)), -(1 - KR - KB) / (2 * (1 - KB)), 0.5)]
CR = [round(k * 224 / 255 * 65536) for k in (0.5, -(1 - KR - KB) / (2 * (1 - KR)), -KB / (2 * (1 - KR)))]
#: Kr and Kb by VP9 colour space; 709 for the others.
SPACES = {1: (0.299, 0.114), 3: (0.299, 0.114), 4: (0.212, 0.087), 5: (0.2627, 0.0593)}


def luma(r: Column, g: Column, b: Column) -> Column:
    return F.shiftright(sum((c * k for c, k in zip((r, g, b), LUMA, strict=True)), F.lit((16 << 16) + (1 << 15))), 16)


def chroma(r4: Column, g4: Column, b4: Column, weights: list[int]) -> Column:
    """Cb or Cr from sums of four pixels, clamped to 0..255."""
    v = F.shiftright(sum((c * k for c, k in zip((r4, g4, b4), weights, strict=True)), F.lit((128 << 18) + (1 << 17))), 18)
    return F.greatest(F.least(v, F.lit(255)), F.lit(0))


def alpha_limited(a: Column) -> Column:
    return div(a * 219 + 127, 255).cast("int") + 16


def alpha_full(y: Column) -> Column:
    v = F.shiftright(F.floor((y - 16) * F.lit(510.0) / 219).cast("int") + 1, 1)
    return F.greatest(F.least(v, F.lit(255)), F.lit(0))


def yuv_to_rgb(y: Column, u: Column, v: Column, space: int = 2, full: bool = False) -> list[Column]:
    """R, G and B as 0..255, halves up."""
    kr, kb = SPACES.get(space, (KR, KB))
    kg = 1 - kr - kb
    c = 1.0 if full else 255 / 224
    base = y.cast("double") if full else (y - 16) * F.lit(255.0) / 219
    u0, v0 = (u - 128).cast("double"), (v - 128).cast("double")
    out = (base + v0 * (2 * (1 - kr) * c), base - (u0 * (2 * kb * (1 - kb) / kg * c) + v0 * (2 * kr * (1 - kr) / kg * c)), base + u0 * (2 * (1 - kb) * c))
    return [F.least(F.greatest(F.floor(x + 0.5), F.lit(0).cast("long")), F.lit(255).cast("long")).cast("int") for x in out]


def bilinear(values: Column, src: int, dst: int) -> Column:
    """Resamples an array of `src` samples to `dst`, linearly between clamped centres; the same size is the identity."""
    if src == dst:
        return values

    def tap(k: Column) -> Column:
        s = F.least(F.greatest((k + 0.5) * src / dst - 0.5, F.lit(0.0)), F.lit(float(src - 1)))
        i = F.floor(s).cast("int")
        a, b = F.get(values, i).cast("double"), F.get(values, F.least(i + 1, F.lit(src - 1))).cast("double")
        return a + (b - a) * (s - i)

    return F.transform(F.sequence(F.lit(0), F.lit(dst - 1)), tap)


def pad_even(values: Column) -> Column:
    """Repeats the last element of an array of odd length."""
    return F.when(F.size(values) % 2 == 1, F.concat(values, F.slice(values, -1, 1))).otherwise(values)


def blend(layers: Column, backdrop: float = 0.0, opaque: bool = True) -> Column:
    """Ordered fold over array<struct<z, layer_index, s, a, mode>> (sample and alpha 0..1): sorted by z then index, each
    layer drawn over what lies below. Returns struct<p, a>, p premultiplied by a."""
    start = F.struct(F.lit(backdrop).alias("p"), F.lit(1.0 if opaque else 0.0).alias("a"))

    def draw(acc: Column, x: Column) -> Column:
        p, big, a, s = acc["p"], acc["a"], x["a"], x["s"]
        cb = p / F.greatest(big, F.lit(1e-6))
        over = a * s + p * (1 - a)
        mixed = lambda b: a * ((1 - big) * s + big * b) + p * (1 - a)
        out = F.when(x["mode"] == "add", F.least(p + a * s, F.lit(1.0))).when(x["mode"] == "multiply", mixed(cb * s)).when(x["mode"] == "screen", mixed(cb + s - cb * s)).otherwise(over)
        return F.struct(out.alias("p"), (a + big * (1 - a)).alias("a"))

    return F.aggregate(F.array_sort(layers), start, draw)


def blended_sample(layers: Column, backdrop: float = 0.0, opaque: bool = True) -> Column:
    """The folded sample as 0..255; on a transparent canvas divided by its alpha first."""
    out = blend(layers, backdrop, opaque)
    return quantise(out["p"] if opaque else out["p"] / F.greatest(out["a"], F.lit(1e-6)))


def is_opaque(alpha: Column) -> Column:
    return F.forall(alpha, lambda a: a == 255)


def block_mean(c: list[Column], a: list[Column]) -> Column:
    """Four times the alpha-weighted mean of four samples, halves up; their sum where all are transparent."""
    weighted, alpha = sum((x * y for x, y in zip(c[1:], a[1:], strict=True)), c[0] * a[0]), sum(a[1:], a[0])
    return F.when(alpha > 0, div(weighted * 4 + div(alpha, 2), F.greatest(alpha, F.lit(1)))).otherwise(sum(c[1:], c[0])).cast("long")


# Planes, for Arrow functions --------------------------------------------------------------------------------------------


def to_rgba(image: np.ndarray) -> np.ndarray:
    """H x W, H x W x 1, 3 or 4 as RGBA."""
    image = image[..., None] if image.ndim == 2 else image
    rgb = np.repeat(image, 3, axis=2) if image.shape[2] == 1 else image[..., :3]
    alpha = image[..., 3:] if image.shape[2] == 4 else np.full((*image.shape[:2], 1), 255, np.uint8)
    return np.concatenate([rgb, alpha], axis=2)


def color_i420(rgba: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Y, Cb and Cr planes, chroma weighted by alpha; odd sides repeat their last row or column."""
    h, w = rgba.shape[:2]
    x = np.pad(rgba, ((0, h & 1), (0, w & 1), (0, 0)), mode="edge").astype(np.int64)
    y = ((16 << 16) + (1 << 15) + x[..., :3] @ np.array(LUMA)) >> 16
    quad = lambda v: v[0::2, 0::2] + v[0::2, 1::2] + v[1::2, 0::2] + v[1::2, 1::2]
    alpha = quad(x[..., 3])[..., None]
    weighted = quad(x[..., :3] * x[..., 3:])
    four = np.where(alpha > 0, (4 * weighted + alpha // 2) // np.maximum(alpha, 1), quad(x[..., :3]))
    planes = [np.clip(((128 << 18) + (1 << 17) + four @ np.array(k)) >> 18, 0, 255) for k in (CB, CR)]
    return y.astype(np.uint8), planes[0].astype(np.uint8), planes[1].astype(np.uint8)


def _even(plane: np.ndarray) -> np.ndarray:
    return np.pad(plane, ((0, plane.shape[0] & 1), (0, plane.shape[1] & 1)), mode="edge")


def color_gbr(rgba: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """G, B and R planes as they are; odd sides repeat their last row or column."""
    return tuple(_even(rgba[..., k]) for k in (1, 2, 0))


def alpha_i420(rgba: np.ndarray, limited: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Alpha as the luma of a gray picture, from 16 to 235 if limited, halves up."""
    y = _even(rgba[..., 3]).astype(np.int64)
    y = ((16 * 255 + y * 219) * 2 + 255) // 510 if limited else y
    gray = np.full((y.shape[0] // 2, y.shape[1] // 2), 128, np.uint8)
    return y.astype(np.uint8), gray, gray.copy()


def float_i420(rgba: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Y, Cb and Cr by BT.709 in floating point, limited range; chroma from the mean of two by two samples."""
    rgb = np.stack([_even(rgba[..., k]) for k in range(3)], axis=2).astype(np.float64)
    y = rgb @ np.array([KR, 1 - KR - KB, KB])
    mean = lambda v: (v[0::2, 0::2] + v[0::2, 1::2] + v[1::2, 0::2] + v[1::2, 1::2]) / 4
    chroma = [128 + mean(rgb[..., k] - y) / (2 * (1 - own)) * 224 / 255 for k, own in ((2, KB), (0, KR))]
    return tuple(np.clip(np.floor(p + 0.5), 0, 255).astype(np.uint8) for p in (16 + y * 219 / 255, *chroma))


def i420_to_rgb(y: np.ndarray, u: np.ndarray, v: np.ndarray, width: int, height: int, space: int = 2, full: bool = False) -> np.ndarray:
    """H x W x 3, nearest chroma, cropped to the content size."""
    kr, kb = SPACES.get(space, (KR, KB))
    kg = 1 - kr - kb
    rows, cols = np.arange(height), np.arange(width)
    base = y[:height, :width].astype(float) if full else (y[:height, :width].astype(float) - 16) * 255 / 219
    c = 1.0 if full else 255 / 224
    u0, v0 = (p.astype(float)[rows[:, None] // 2, cols // 2] - 128 for p in (u, v))
    out = np.stack([base + 2 * (1 - kr) * c * v0, base - (2 * kb * (1 - kb) / kg * u0 + 2 * kr * (1 - kr) / kg * v0) * c, base + 2 * (1 - kb) * c * u0], axis=2)
    return np.clip(np.floor(out + 0.5), 0, 255).astype(np.uint8)


def composite(canvas: tuple[int, int], background: tuple[float, float, float] | None, layers: list[tuple[np.ndarray, tuple[int, int, int, int], str, float]]) -> np.ndarray:
    """Draws RGBA images (image, rect, blend, opacity) in order; background None leaves the canvas transparent.
    Returns H x W x 3, or x 4 if transparent."""
    width, height = canvas
    p = np.zeros((height, width, 3), np.float32)
    big = np.zeros((height, width, 1), np.float32)
    if background is not None:
        p[:], big[:] = background, 1
    for image, (x, y, w, h), mode, opacity in layers:
        x0, y0, x1, y1 = max(0, x), max(0, y), min(width, x + w), min(height, y + h)
        if x0 >= x1 or y0 >= y1:
            continue
        drawn = _resample(_resample(to_rgba(image).astype(np.float32) / 255, w, 1), h, 0)[y0 - y : y1 - y, x0 - x : x1 - x]
        s, a = drawn[..., :3], drawn[..., 3:] * np.float32(min(1, max(0, opacity)))
        under, below = p[y0:y1, x0:x1], big[y0:y1, x0:x1]
        cb = under / np.maximum(below, 1e-6)
        if mode == "add":
            out = np.minimum(1, under + a * s)
        elif mode == "normal":
            out = a * s + under * (1 - a)
        else:
            out = a * ((1 - below) * s + below * (cb * s if mode == "multiply" else cb + s - cb * s)) + under * (1 - a)
        p[y0:y1, x0:x1], big[y0:y1, x0:x1] = out, a + below * (1 - a)
    if background is not None:
        return np.clip(np.floor(p * 255 + 0.5), 0, 255).astype(np.uint8)
    return np.clip(np.floor(np.concatenate([p / np.maximum(big, 1e-6), big], axis=2) * 255 + 0.5), 0, 255).astype(np.uint8)


def _resample(image: np.ndarray, size: int, axis: int) -> np.ndarray:
    n = image.shape[axis]
    if n == size:
        return image
    s = np.clip((np.arange(size) + 0.5) * n / size - 0.5, 0, n - 1)
    i = np.floor(s).astype(int)
    f = (s - i).astype(np.float32).reshape([-1 if k == axis else 1 for k in range(image.ndim)])
    a, b = np.take(image, i, axis), np.take(image, np.minimum(i + 1, n - 1), axis)
    return a + (b - a) * f
