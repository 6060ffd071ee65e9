"""Scalar functions of layers, metadata and reports, as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from laminaspark.functions.timegrid import Fps, div, seconds_to_frame

# Blend modes, alpha ranges, format names with alpha, content types.
BLENDS = ("normal", "add", "multiply", "screen")
ALPHA_RANGES = ("limited", "full")
ALPHA_FORMATS = ("rgba", "bgra", "argb", "abgr", "yuva", "gbrap", "ya8", "ya16", "ayuv", "vuya", "pal8")
CONTENT_TYPES = {"html": "text/html; charset=utf-8", "js": "text/javascript; charset=utf-8", "mjs": "text/javascript; charset=utf-8", "css": "text/css; charset=utf-8", "json": "application/json", "map": "application/json", "svg": "image/svg+xml", "png": "image/png", "ico": "image/x-icon", "wasm": "application/wasm"}
# VP9 levels as (level, largest luma picture, largest luma sample rate), from webmproject.org/vp9/levels.
VP9_LEVELS = ((10, 36864, 829440), (11, 73728, 2764800), (20, 122880, 4608000), (21, 245760, 9216000), (30, 552960, 20736000), (31, 983040, 36864000), (40, 2228224, 83558400), (41, 2228224, 160432128), (50, 8912896, 311951360), (51, 8912896, 588251136), (52, 8912896, 1176502272), (60, 35651584, 1176502272), (61, 35651584, 2353004544), (62, 35651584, 4706009088))
MAX_SIDE = 16384


# Checks -------------------------------------------------------------------------------------------------------------


def valid_id(c: Column) -> Column:
    """A layer id: letters, digits, _, . and -, not starting with . or -, not of digits alone (that is an index)."""
    return c.rlike(r"^[A-Za-z0-9_][A-Za-z0-9_.-]*$") & ~c.rlike(r"^[0-9]+$")


def finite(c: Column) -> Column:
    """A number, or a text of one, that is neither NaN nor infinite; else null."""
    v = c.try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def valid_opacity(c: Column) -> Column:
    return F.coalesce(finite(c).between(0, 1), F.lit(False))


def valid_blend(c: Column) -> Column:
    return c.isin(*BLENDS)


def valid_background(c: Column) -> Column:
    return c.rlike(r"^#[0-9A-Fa-f]{6}$")


def parse_bool(c: Column) -> Column:
    v = F.lower(F.trim(c))
    return F.when(v.isin("1", "true", "yes", "on"), True).when(v.isin("0", "false", "no", "off"), False)


def parse_rect(c: Column) -> Column:
    """x, y, w, h from four integers between commas, colons, spaces or x; null unless all are there and w, h are positive."""
    parts = F.split(F.trim(c), r"[,:x\s]+")
    n = [F.try_element_at(parts, F.lit(k)).try_cast("long") for k in (1, 2, 3, 4)]
    whole = (F.size(parts) == 4) & n[0].isNotNull() & n[1].isNotNull() & (n[2] > 0) & (n[3] > 0)
    return F.when(whole, F.struct(*(v.alias(k) for v, k in zip(n, "xywh", strict=True))))


def valid_sides(width: Column, height: Column, content_width: Column | None = None, content_height: Column | None = None) -> Column:
    """Sides from 1 to 16384, contents within them."""
    ok = width.between(1, MAX_SIDE) & height.between(1, MAX_SIDE)
    return ok if content_width is None else ok & content_width.between(1, width) & content_height.between(1, height)


# Numbers ------------------------------------------------------------------------------------------------------------


def even(c: Column) -> Column:
    return c + F.pmod(c, F.lit(2))


def as_uint8(c: Column) -> Column:
    """A sample from 0 to 1 as 0 to 255, halves up, saturating; NaN and null give 0."""
    v = F.coalesce(F.nanvl(c.cast("double"), F.lit(0.0)), F.lit(0.0))
    return F.least(F.greatest(F.floor(v * 255 + 0.5), F.lit(0).cast("long")), F.lit(255).cast("long")).cast("int")


def quantise(c: Column) -> Column:
    """0..1 as 0..255: floor(255 v + 1/2), saturating."""
    return F.least(F.greatest(F.floor(c * 255 + 0.5), F.lit(0).cast("long")), F.lit(255).cast("long")).cast("int")


def meta_capacity(length: Column) -> Column:
    """Room kept for metadata: twice its length in steps of 4096 bytes, 4096 at least."""
    return F.greatest(F.lit(4096).cast("long"), div(length * 2 + 4095, 4096) * 4096)


def free_slot(lo: Column, start: Column, end: Column, limit: Column, size: Column) -> Column:
    """Where a new copy of the metadata fits beside the current one at [start, end): before it, else at the right end on a
    multiple of 8; null if neither has room."""
    right = limit - size
    right = right - F.pmod(right, F.lit(8))
    return F.when(start - lo >= size, lo).when(right >= F.greatest(end, lo), right)


def thousands(c: Column) -> Column:
    return F.format_number(c, 0)


def vp9_level(width: Column, height: Column, fps: Column) -> Column:
    """The first level whose limits hold the picture and its sample rate; 62 if none does."""
    size = width.cast("long") * height.cast("long")
    rate = size.cast("double") * fps
    fits = [F.when((size <= s) & (rate <= float(r)), F.lit(level)) for level, s, r in VP9_LEVELS]
    return F.coalesce(*fits, F.lit(62))


def codec_string(width: Column, height: Column, fps: Column, lossless: Column) -> Column:
    level = F.lpad(vp9_level(width, height, fps).cast("string"), 2, "0")
    return F.when(lossless, F.concat(F.lit("vp09.01."), level, F.lit(".08.03.01.13.00.01"))).otherwise(F.concat(F.lit("vp09.00."), level, F.lit(".08")))


def codec_profile(c: Column) -> Column:
    parts = F.split(c, r"\.")
    return F.when((F.size(parts) >= 4) & (parts[0] == "vp09"), parts[1].try_cast("int"))


# Texts --------------------------------------------------------------------------------------------------------------


def shorten(c: Column, most: int = 40) -> Column:
    return F.when(F.char_length(c) > most, F.concat(F.substring(c, 1, most), F.lit("…"))).otherwise(c)


def parse_color(c: Column) -> list[Column]:
    """[r, g, b] of #RRGGBB."""
    return [F.conv(F.substring(c, k, 2), 16, 10).cast("int") for k in (2, 4, 6)]


def frame_name(pattern: str, index: Column) -> Column:
    """A printf pattern of %d, %5d, %05d and %% as an expression; anything else is refused."""
    parts = re.findall(r"%%|%\d*d|[^%]+|%", pattern)
    out = []
    for p in parts:
        if p == "%%":
            out.append(F.lit("%"))
        elif p == "%" or (p[0] == "%" and p[-1] != "d"):
            raise ValueError(f"unsupported pattern {pattern!r}")
        elif p[0] == "%":
            width = int(p[1:-1] or 0)
            text = index.cast("string")
            out.append(F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0" if p[1] == "0" else " ")) if width else text)
        else:
            out.append(F.lit(p))
    return F.concat(*out)


def positions(values: Column, limit: int = 3) -> Column:
    """A list of positions in words: a regular series by its step, else the first ones and how many more."""
    n, text = F.size(values), F.transform(values, lambda v: v.cast("string"))
    step = values[1] - values[0]
    regular = (n > 2) & (step > 0) & F.forall(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda k: F.coalesce(F.get(values, k) - F.get(values, k - 1) == step, F.lit(False)))
    series = F.concat(text[0], F.lit(", "), text[1], F.lit(", … "), F.element_at(text, -1), F.lit(" (every "), step.cast("string"), F.lit(")"))
    first = F.array_join(F.slice(text, 1, limit), ", ")
    more = F.when(n > limit, F.concat(F.lit(", … (+"), (n - limit).cast("string"), F.lit(" more)"))).otherwise(F.lit(""))
    return F.when(n == 0, "none").when(regular, series).otherwise(F.concat(first, more))


def content_type(path: Column) -> Column:
    ext = F.regexp_extract(path, r"([^.]*)$", 1)
    out = F.lit("application/octet-stream")
    for k, v in CONTENT_TYPES.items():
        out = F.when(ext == k, F.lit(v)).otherwise(out)
    return out


def percent_encode(c: Column) -> Column:
    """Every byte but unreserved ones as %XX."""
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):  # where form encoding differs
        c = F.replace(F.url_encode(c) if a == "+" else c, F.lit(a), F.lit(b))
    return c


def host_name(c: Column) -> Column:
    """The host of a Host header without its port; an address in brackets is kept whole."""
    v = F.trim(c)
    return F.when(v.startswith("["), F.coalesce(F.nullif(F.regexp_extract(v, r"^(\[[^\]]*\])", 1), F.lit("")), v)).otherwise(F.split_part(v, F.lit(":"), F.lit(1)))


def is_loopback(host: Column) -> Column:
    v = F.regexp_replace(host, r"^\[+|\]+$", "")
    return (host == "localhost") | v.rlike(r"^127\.\d{1,3}\.\d{1,3}\.\d{1,3}$") | (v == "::1")


def byte_range(value: Column, size: Column) -> Column:
    """(kind, from, to) of an HTTP Range header over a file of `size` bytes: `part` with [from, to), `unsatisfiable`, or
    `whole` where the header is malformed or names several ranges."""
    v = F.trim(value)
    a, b = (F.regexp_extract(v, r"^bytes=(\d*)-(\d*)$", k) for k in (1, 2))
    x, y = a.try_cast("long"), b.try_cast("long")
    good = v.rlike(r"^bytes=(\d*)-(\d*)$") & ((a != "") | (b != "")) & ~F.coalesce(y < x, F.lit(False))
    start = F.when(a != "", x).otherwise(F.greatest(size - y, F.lit(0).cast("long")))
    end = F.when(a == "", size).when(b == "", size).otherwise(F.least(y + 1, size))
    fits = (start < size) & (start < end)
    nothing = F.lit(None).cast("long")
    return F.when(~good, F.struct(F.lit("whole").alias("kind"), nothing.alias("from"), nothing.alias("to"))).when(fits, F.struct(F.lit("part").alias("kind"), start.alias("from"), end.alias("to"))).otherwise(F.struct(F.lit("unsatisfiable").alias("kind"), nothing.alias("from"), nothing.alias("to")))


def etag(inode: Column, size: Column, mtime_ns: Column) -> Column:
    return F.concat(F.lit('"'), F.concat_ws("-", *(F.lower(F.hex(c.cast("long"))) for c in (inode, size, mtime_ns))), F.lit('"'))


def has_alpha_name(c: Column) -> Column:
    return c.rlike("^(" + "|".join(ALPHA_FORMATS) + ")")


def frame_range(spec: Column, fps: Fps, frames: int) -> tuple[Column, Column, Column]:
    """N, A:B, A: and :B in frames, or in seconds with an s, as (start, end, valid)."""

    def point(c: Column) -> Column:
        v = F.trim(c)
        seconds = F.regexp_extract(v, r"^([0-9]+(?:\.[0-9]+)?|\.[0-9]+)s$", 1)
        return F.when(v.rlike(r"^[0-9]+$"), v.try_cast("long")).when(seconds != "", seconds_to_frame(seconds.try_cast("decimal(24,6)"), fps))

    whole, pair = F.coalesce(spec, F.lit("")) == "", F.contains(spec, F.lit(":"))
    left, right = F.split_part(spec, F.lit(":"), F.lit(1)), F.regexp_extract(spec, r"^[^:]*:(.*)$", 1)
    start = F.when(whole, 0).when(~pair, point(spec)).when(F.trim(left) == "", 0).otherwise(point(left)).cast("long")
    end = F.when(whole, frames).when(~pair, point(spec) + 1).when(F.trim(right) == "", frames).otherwise(point(right)).cast("long")
    return start, end, whole | F.coalesce((start < end) & (end <= frames), F.lit(False))


def resolve_layer(keys: Sequence[str], layers: Sequence[tuple[int, str]]) -> list[int]:
    """Indices of layers named by id or, if all digits, by index; repeats stay. Raises on a name that isn't there."""
    by_id, indices = {i: k for k, i in layers}, {k for k, _ in layers}
    out = []
    for key in map(str, keys):
        k = int(key) if re.fullmatch(r"[0-9]+", key) else by_id.get(key)
        if k not in indices:
            raise KeyError(f"no layer {key!r}")
        out.append(k)
    return out
