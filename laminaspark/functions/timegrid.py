"""Exact time on a rational frame grid: everything in integers, halves rounded up towards positive infinity."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS, LONG_MAX, U32 = 1_000_000, (1 << 63) - 1, (1 << 32) - 1


@dataclass(frozen=True)
class Fps:
    """Frames a second as a reduced fraction of unsigned 32-bit numbers."""

    num: int
    den: int = 1

    def __post_init__(self):
        if self.num <= 0 or self.den <= 0:
            raise ValueError(f"fps {self.num}/{self.den} must be positive")
        g = math.gcd(self.num, self.den)
        object.__setattr__(self, "num", self.num // g)
        object.__setattr__(self, "den", self.den // g)
        if max(self.num, self.den) > U32:
            raise ValueError("fps out of range")

    @classmethod
    def of(cls, value: str | float | Fraction | tuple[int, int] | Fps) -> Fps:
        """"30", "30000/1001", "29.97", a number, a fraction or a pair."""
        if isinstance(value, Fps):
            return value
        if isinstance(value, tuple):
            return cls(*value)
        text = str(value).strip()
        if re.fullmatch(r"\d+/\d+", text):
            return cls(*map(int, text.split("/")))
        exact = parse_decimal(text)
        if exact is None:
            raise ValueError(f"bad fps {value!r}")
        return cls(exact.numerator, exact.denominator)

    def __str__(self) -> str:
        return str(self.num) if self.den == 1 else f"{self.num}/{self.den}"


def parse_decimal(text: str) -> Fraction | None:
    """The exact value of a decimal text; None if it isn't one or its exponent exceeds 64."""
    m = re.fullmatch(r"([+-]?)(\d+\.?\d*|\.\d+)(?:[eE]([+-]?\d+))?", text.strip())
    if not m or abs(int(m[3] or 0)) > 64:
        return None
    return Fraction(f"{m[1]}{m[2]}") * Fraction(10) ** int(m[3] or 0)


def _wide(c) -> Column:
    return (c if isinstance(c, Column) else F.lit(c)).cast("decimal(38,0)")


def floor_div_wide(n: Column, d: Column) -> Column:
    """Floor division in 38 digits, saturating at the largest long."""
    exact = (n - F.pmod(n, d)) / d
    return F.least(exact, F.lit(LONG_MAX).cast("decimal(38,0)")).cast("long")


def round_half_up(num: Column, den: int | Column) -> Column:
    """floor(num / den + 1/2) of longs, den > 0."""
    d = den if isinstance(den, Column) else F.lit(den).cast("long")
    return _floor_div(num.cast("long") * 2 + d, d * 2)


def div(n: Column, d: int | Column) -> Column:
    """Integer division that truncates."""
    return F.call_function("div", n.cast("long"), (d if isinstance(d, Column) else F.lit(d)).cast("long"))


def _floor_div(n: Column, d: Column) -> Column:
    return div(n - F.pmod(n, d), d)


def pts_us(frame: Column, fps: Fps) -> Column:
    """Microseconds at which a frame starts."""
    f = frame.cast("long")
    if 2 * MICROS * fps.den * U32 + fps.num < LONG_MAX:  # every 32-bit frame number fits a long
        return div(f * F.lit(2 * MICROS * fps.den).cast("long") + F.lit(fps.num).cast("long"), 2 * fps.num)
    return floor_div_wide(_wide(f) * _wide(2 * MICROS * fps.den) + _wide(fps.num), _wide(2 * fps.num))


def frame_at_us(us: Column, fps: Fps) -> Column:
    """The last frame that starts at or before a time; 0 before the first. A closed form, so that a join of times with
    frame windows becomes an equality."""
    t = us.cast("long")
    short = div(F.lit(fps.num).cast("long") * (t * 2 + 1) - 1, 2 * MICROS * fps.den)
    wide = floor_div_wide(_wide(fps.num) * (_wide(t) * 2 + 1) - 1, _wide(2 * MICROS * fps.den))
    return F.when(t <= 0, F.lit(0).cast("long")).when(t < LONG_MAX // (4 * fps.num), short).otherwise(wide)


def seconds_to_frame(seconds: Column, fps: Fps) -> Column:
    """The frame nearest to an exact decimal (or its text without exponent), halves up."""
    exact = seconds.cast("decimal(24,6)") * F.lit(MICROS)
    micro = exact.cast("decimal(38,0)")
    return floor_div_wide(micro * _wide(2 * fps.num) + _wide(MICROS * fps.den), _wide(2 * MICROS * fps.den))


def samples_to_us(samples: Column, rate: int = 48_000) -> Column:
    """Microseconds of a number of audio samples, halves up."""
    return round_half_up(samples.cast("long") * MICROS, rate)


def format_time(us: Column) -> Column:
    """mm:ss.mmm, with hours if there are any."""
    ms = div(us, 1000)
    s, m, h = div(ms, 1000), div(ms, 60_000), div(ms, 3_600_000)
    tail = F.format_string("%02d:%02d.%03d", m % 60, s % 60, ms % 1000)
    return F.when(h > 0, F.concat(h.cast("string"), F.lit(":"), tail)).otherwise(tail)
