"""Vectors of the pure functions."""

from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from laminaspark.functions import bits, pixels, scalars
from laminaspark.functions.timegrid import Fps, format_time, frame_at_us, parse_decimal, pts_us, round_half_up, samples_to_us, seconds_to_frame


def one(spark, *columns):
    return list(spark.range(1).select(*(c.alias(f"c{k}") for k, c in enumerate(columns))).first())


def n(x):
    return F.lit(x).cast("long")


def test_pts(spark):
    assert one(spark, *(pts_us(n(f), Fps(30)) for f in (0, 1, 2, 3, 3600))) == [0, 33333, 66667, 100000, 120000000]
    assert one(spark, *(pts_us(n(f), Fps(30000, 1001)) for f in (1, 2, 30000))) == [33367, 66733, 1001000000]
    assert one(spark, *(pts_us(n(f), Fps(128)) for f in (1, 3))) == [7813, 23438]
    assert one(spark, pts_us(n(4294967295), Fps(1, 4294967295))) == [(1 << 63) - 1]


def test_frame_at(spark):
    assert one(spark, *(frame_at_us(n(t), Fps(30)) for t in (0, 33332, 33333, 66666, 66667, -5))) == [0, 0, 1, 1, 2, 0]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(0, 10**12), min_size=1, max_size=30), st.sampled_from([(30, 1), (30000, 1001), (1, 3600), (24000, 1001), (128, 1), (997, 13)]))
def test_frame_at_is_the_last_that_started(spark, times, rate):
    fps = Fps(*rate)
    df = spark.createDataFrame([(t,) for t in times], "t long").withColumn("f", frame_at_us(F.col("t"), fps))
    bad = df.where((pts_us(F.col("f"), fps) > F.col("t")) | (pts_us(F.col("f") + 1, fps) <= F.col("t")))
    assert bad.count() == 0


def test_rounding(spark):
    assert one(spark, round_half_up(n(5), 2), round_half_up(n(7), 2), round_half_up(n(-1), 2), round_half_up(n(-3), 2)) == [3, 4, 0, -1]
    assert one(spark, *(samples_to_us(n(k)) for k in (960, 1, 3))) == [20000, 21, 63]
    dec = lambda s: F.lit(s).cast("decimal(24,6)")
    assert one(spark, *(seconds_to_frame(dec(s), Fps(30)) for s in ("3.0", "1.5", "0.1")), seconds_to_frame(dec("120"), Fps(30000, 1001))) == [90, 45, 3, 3596]


def test_decimals_and_rates():
    assert parse_decimal("0e2147483647") is None and parse_decimal("1e65") is None and parse_decimal("0.0e40") == 0
    assert parse_decimal("2.5E-1") == Fraction(1, 4) and parse_decimal("1e-50") == Fraction(1, 10**50)
    assert str(Fps.of("30/1")) == "30" and Fps.of("29.97") == Fps(2997, 100) and Fps.of("60/2") == Fps(30)
    for bad in ("0/1", "abc", "18446744073709551617"):
        with pytest.raises(ValueError):
            Fps.of(bad)


def test_texts(spark):
    assert one(spark, format_time(n(61234000)), format_time(n(3600000000))) == ["01:01.234", "1:00:00.000"]
    arr = lambda *x: F.array(*map(F.lit, x))
    assert one(spark, scalars.positions(arr(0, 60, 120, 180)), scalars.positions(arr(0, 5, 7), 2), scalars.positions(F.array().cast("array<int>"))) == ["0, 60, … 180 (every 60)", "0, 5, … (+1 more)", "none"]
    assert one(spark, scalars.frame_name("f/%05d.png", n(42)), scalars.frame_name("%d_%%.png", n(7)), scalars.frame_name("%3d.png", n(7)), scalars.frame_name("%2d", n(1234))) == ["f/00042.png", "7_%.png", "  7.png", "1234"]
    with pytest.raises(ValueError):
        scalars.frame_name("%x", n(1))


def test_codec_strings(spark):
    want = {(1920, 1080, 30, False): "vp09.00.40.08", (1920, 1080, 60, False): "vp09.00.41.08", (1280, 720, 30, False): "vp09.00.31.08", (640, 360, 30, False): "vp09.00.21.08", (3840, 2160, 30, False): "vp09.00.50.08", (64, 64, 30, False): "vp09.00.10.08", (1280, 720, 30, True): "vp09.01.31.08.03.01.13.00.01"}
    assert one(spark, *(scalars.codec_string(F.lit(w), F.lit(h), F.lit(float(f)), F.lit(x)) for w, h, f, x in want)) == list(want.values())


def test_checks(spark):
    assert one(spark, *(scalars.valid_id(F.lit(x)) for x in ("bg", "0a", "12", "-a", "a.b", ""))) == [True, True, False, False, True, False]
    assert one(spark, *(scalars.finite(F.lit(x)) for x in ("1.5", "NaN", "1e999", "x"))) == [1.5, None, None, None]
    assert [tuple(r) if r else None for r in one(spark, *(scalars.parse_rect(F.lit(x)) for x in ("1,2,3,4", "1:2 3x4", "1,2,0,4", "1,2,3")))] == [(1, 2, 3, 4), (1, 2, 3, 4), None, None]
    assert one(spark, *(scalars.as_uint8(F.lit(x)) for x in (0.5, 1.0, -1.0, 9.0, float("nan")))) == [128, 255, 0, 255, 0]
    assert scalars.resolve_layer(["a", "1", "a"], [(0, "a"), (1, "b")]) == [0, 1, 0]
    with pytest.raises(KeyError):
        scalars.resolve_layer(["c"], [(0, "a")])


def test_opus_and_superframes(spark):
    assert one(spark, *(bits.opus_samples(F.lit(a), F.lit(b)) for a, b in ((0xFC, 0), (0xF9, 0), (0x03, 3), (0x78, 0)))) == [960, 1920, 1440, 960]
    a, b = bytes.fromhex("820102"), bytes.fromhex("8605")
    r = one(spark, bits.superframe(F.lit(a + b + bytes.fromhex("C10302C1"))), bits.superframe(F.lit(a)))
    assert (r[0].is_superframe, r[0].frames, r[0].sizes) == (True, 2, [3, 2]) and (r[1].is_superframe, r[1].frames) == (False, 1)


def test_vp9_header(spark):
    from laminaspark.sources.testsrc import packet

    k, i, rgb = one(spark, *(bits.vp9_header(F.lit(x)) for x in (packet(True, 64, 32), packet(False, 64, 32), packet(True, 22, 14, rgb=True))))
    assert (k.key, k.width, k.height, k.color_space, k.color_range, k.profile) == (True, 64, 32, 2, 0, 0)
    assert (i.key, i.shown, i.width) == (False, True, None)
    assert (rgb.key, rgb.width, rgb.height, rgb.color_space, rgb.color_range, rgb.profile) == (True, 22, 14, 7, 1, 1)
    assert one(spark, bits.describe_vp9(F.lit(packet(True, 16, 16)))) == ["key, 16x16, cs=2 range=limited"]


def test_pixels(spark):
    assert one(spark, *(pixels.luma(*map(F.lit, x)) for x in ((0, 0, 0), (255, 255, 255)))) == [16, 235]
    assert one(spark, pixels.chroma(F.lit(0), F.lit(0), F.lit(1020), pixels.CB), pixels.chroma(F.lit(1020), F.lit(0), F.lit(0), pixels.CR)) == [240, 240]
    assert one(spark, pixels.alpha_limited(F.lit(0)), pixels.alpha_limited(F.lit(255))) == [16, 235]
    taps = one(spark, F.transform(pixels.bilinear(F.array(F.lit(0), F.lit(255)), 2, 4), lambda v: F.floor(v + 0.5)))[0]
    assert taps == [0, 64, 191, 255]


@pytest.mark.parametrize(("mode", "want"), [("normal", 200), ("add", 255), ("multiply", 78), ("screen", 222)])
def test_blend(spark, mode, want):
    layers = F.array(*(F.struct(F.lit(z).alias("z"), F.lit(0).alias("layer_index"), F.lit(s / 255).alias("s"), F.lit(1.0).alias("a"), F.lit(m).alias("mode")) for z, s, m in ((1, 200, mode), (0, 100, "normal"))))
    assert one(spark, pixels.blended_sample(layers)) == [want]
    image = lambda v: np.full((2, 2, 3), v, np.uint8)
    assert pixels.composite((2, 2), (0, 0, 0), [(image(100), (0, 0, 2, 2), "normal", 1.0), (image(200), (0, 0, 2, 2), mode, 1.0)])[0, 0].tolist() == [want] * 3


def test_composite_planes():
    over = np.zeros((1, 1, 4), np.uint8)
    over[:] = (255, 0, 0, 128)
    assert pixels.composite((1, 1), (0, 0, 1), [(over, (0, 0, 1, 1), "normal", 1.0)])[0, 0].tolist() == [128, 0, 127]
    clear = np.array([[[200, 100, 50, 64]]], np.uint8)
    assert pixels.composite((1, 1), None, [(clear, (0, 0, 1, 1), "normal", 1.0)])[0, 0].tolist() == [200, 100, 50, 64]
    flat = np.full((5, 7, 4), 255, np.uint8)
    y, u, v = pixels.color_i420(flat)
    assert y.shape == (6, 8) and u.shape == (3, 4) and (y == 235).all() and (u == 128).all() and (v == 128).all()
    assert (pixels.i420_to_rgb(y, u, v, 7, 5) == 255).all()


def test_png():
    from laminaspark.sources.codecs import decode, encode, png_decode, png_encode

    for c in (1, 3, 4):
        image = np.random.default_rng(1).integers(0, 256, (9, 5, c), dtype=np.uint8)
        assert (png_decode(png_encode(image)) == image).all()
    assert decode("zlib", encode("zlib", b"abc" * 99)) == b"abc" * 99


def test_planes():
    rng = np.random.default_rng(0)
    rgba = rng.integers(0, 256, (5, 7, 4)).astype(np.uint8)
    g, b, r = pixels.color_gbr(rgba)
    assert g.shape == (6, 8) and (g[:5, :7] == rgba[..., 1]).all() and (b[5, :7] == rgba[4, :, 2]).all() and (r[:5, 7] == rgba[:, 6, 0]).all()
    y, u, v = pixels.alpha_i420(np.array([[[0, 0, 0, 0], [0, 0, 0, 255]]], np.uint8))
    assert y[0].tolist() == [16, 235] and u.tolist() == v.tolist() == [[128]]
    exact, near = pixels.color_i420(rgba[:4, :6] | np.array([0, 0, 0, 255], np.uint8)), pixels.float_i420(rgba[:4, :6])
    assert all(np.abs(p.astype(int) - q.astype(int)).max() <= 1 for p, q in zip(exact, near, strict=True))
