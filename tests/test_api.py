"""Packing, reading, compositing, editing and rendering of small files."""

import numpy as np
import pytest

from laminaspark import api
from laminaspark.functions.timegrid import Fps
from laminaspark.sources.codecs import png_decode, png_encode
from laminaspark.sources.validate import validate


def image(v, w, h, c=3):
    return np.full((h, w, c), v, np.uint8)


def table(spark, rows):
    return spark.createDataFrame([(k, f, x.shape[1], x.shape[0], x.shape[2], x.tobytes()) for k, f, x in rows], api.IMAGES)


@pytest.fixture()
def path(spark, tmp_path):
    """bg: a value a frame; mask: given at 5 only, ended at 10; a hidden layer; a still."""
    png = png_encode(image(200, 4, 2))
    layers = [api.video_layer("bg", 0, (16, 8), 0, 12, has_alpha=False), api.video_layer("mask", 1, (4, 4), 5, 10, rect=(2, 2, 4, 4), codec="zlib", blend="add"), api.video_layer("hidden", 2, (2, 2), 0, 12, visible=False), api.still_layer("s", 3, image(200, 4, 2), (12, 0), 2, 9, 0, png)]
    images = table(spark, [(0, f, image(10 * f, 16, 8)) for f in range(12)] + [(1, 5, image(50, 4, 4, 4) * 0 + np.array([50, 60, 70, 255], np.uint8)), (2, 0, image(9, 2, 2, 4))])
    audio = spark.createDataFrame([(20_000 * k, 20_000, b"\xfc\x01") for k in range(40)], "pts_us long, duration_us long, data binary")
    out = str(tmp_path / "a.lvd")
    assert api.pack(spark, out, api.document((16, 8), Fps(30), 12, layers, gop=4, audio=True), images, [png], audio) == 12
    return out


def test_pack_and_read(spark, path):
    r = api.Reader(spark, path)
    assert r.raps == [0, 4, 8] and r.rap_at_or_before(7) == 4 and r.pts_us(1) == 33333
    assert r.select() == [0, 1, 3] and r.select(["hidden", "bg"], ["bg"]) == [2] and r.layer("mask")["start_frame"] == 5
    assert sorted(x.frame for x in r.layer_frames("mask").collect()) == [5, 6, 7, 8, 9]
    assert r.audio().count() == 20 and (r.still("s") == 200).all()
    six = r.frame(6)
    assert six[0, 0].tolist() == [60] * 3 and six[3, 3].tolist() == [110, 120, 130] and six[0, 13].tolist() == [200] * 3
    assert r.frame(11)[3, 3].tolist() == [110] * 3
    assert r.frame(6, layers=["mask"], transparent=True)[0, 0].tolist() == [0, 0, 0, 0]
    every = {x.frame: x.data for x in r.frames().collect()}
    assert len(every) == 12 and all(np.array_equal(np.frombuffer(every[f], np.uint8).reshape(8, 16, 3), r.frame(f)) for f in (0, 5, 9))
    with pytest.raises(ValueError):
        r.frames(5, 5)
    with pytest.raises(KeyError):
        r.layer("nobody")


def test_edits(spark, path, tmp_path):
    before = {(x.frame, x.layer_index): x.data for x in api.Reader(spark, path).decode(layers=["bg", "hidden"]).collect()}
    api.remove_layers(spark, path, ["mask"])
    r = api.Reader(spark, path)
    assert [x["id"] for x in r.layers] == ["bg", "hidden", "s"] and r.raps == [0, 4, 8] and (r.still("s") == 200).all()
    after = {(x.frame, {0: 0, 1: 2}[x.layer_index]): x.data for x in r.decode(layers=["bg", "hidden"]).collect()}
    assert after == before and r.audio().count() == 20
    api.add_layer(spark, path, table(spark, [(0, 6, image(7, 2, 2))]), api.video_layer("new", 3, (2, 2), 6, 12, rect=(0, 0, 2, 2), has_alpha=False))
    api.add_still(spark, path, "logo", image(33, 1, 1), (15, 7))
    r = api.Reader(spark, path)
    assert r.raps == [0, 4, 8] and r.frame(6)[0, 0].tolist() == [7] * 3 and r.frame(6)[7, 15].tolist() == [33] * 3
    api.set_audio(spark, path, None)
    assert api.Reader(spark, path).audio().count() == 0
    for name in ("one", "two", "three"):  # in place, several times
        api.set_layer(path, "bg", name=name, opacity=0.5)
        assert api.Reader(spark, path).layer("bg")["name"] == name
    assert api.Reader(spark, path).frame(10)[5, 5].tolist() == [50] * 3
    assert validate(spark, path, ["raw", "zlib"]).count() == 0
    with pytest.raises(ValueError):
        api.set_layer(path, "bg", blend="dodge")
    with pytest.raises(ValueError):
        api.add_layer(spark, path, table(spark, []), api.video_layer("bg", 9, (2, 2), 0, 1))


def test_sinks(spark, path, tmp_path):
    frames = api.Reader(spark, path).frames(3, 7)
    api.render_png(frames, str(tmp_path / "png"))
    assert sorted(p.name for p in (tmp_path / "png").iterdir()) == [f"{k:05d}.png" for k in range(3, 7)]
    assert api.render_npy(frames, str(tmp_path / "x.npy")) == 4
    array = np.load(tmp_path / "x.npy")
    assert array.shape == (4, 8, 16, 3) and (array[2] == png_decode((tmp_path / "png/00005.png").read_bytes())).all()


def test_missing_image(spark, tmp_path):
    meta = api.document((4, 4), Fps(30), 3, [api.video_layer("a", 0, (4, 4), 0, 3)])
    with pytest.raises(Exception, match="no image"):
        api.pack(spark, str(tmp_path / "b.lvd"), meta, table(spark, [(0, 1, image(1, 4, 4))]))


def test_writer(spark, tmp_path):
    """Layers from an array, a function, an iterable; a failed block leaves nothing and closes the writer."""
    out = str(tmp_path / "w.lvd")
    with api.Writer(spark, out, (16, 8), Fps(30), 6, gop=3) as w:
        w.video("bg", np.stack([image(10 * f, 16, 8) for f in range(6)]), (16, 8), has_alpha=False)
        w.video("fn", lambda f: image(f, 2, 2, 4) if f % 2 else None, (2, 2), 1)
        w.video("it", (image(200 + k, 1, 1) for k in range(2)), (1, 1), 4, rect=(15, 7, 1, 1), has_alpha=False)
        w.still("s", image(9, 1, 1), (0, 7))
    assert w.written == 6 and validate(spark, out, ["zlib"]).count() == 0
    r = api.Reader(spark, out)
    assert r.frame(5)[7, 15].tolist() == [201] * 3 and r.frame(5)[7, 0].tolist() == [9] * 3 and r.frame(3)[4, 4].tolist() == [30] * 3
    assert sorted(x.frame for x in r.layer_frames("fn").collect()) == [1, 2, 3, 4, 5]
    with pytest.raises(api.WriterError):
        w.still("t", image(1, 1, 1))
    bad = api.Writer(spark, str(tmp_path / "x.lvd"), (4, 4), Fps(30), 3)
    with pytest.raises(api.RangeError):
        bad.video("a", image(1, 4, 4)[None], (4, 4), 2, 9)
    with pytest.raises(api.WriterError):
        bad.close()
    with pytest.raises(ZeroDivisionError), api.Writer(spark, str(tmp_path / "x.lvd"), (4, 4), Fps(30), 3) as bad:
        1 / 0  # noqa: B018
    assert not (tmp_path / "x.lvd").exists()


def test_reload_progress_and_lock(spark, path, tmp_path):
    r = api.Reader(spark, path)
    assert not r.changed()
    api.set_layer(path, "bg", name="other")
    assert r.changed() and r.reload({"bg": {"opacity": 0.5}, "gone": {"z": 1}}).layer("bg") | {"opacity": 0.5, "name": "other"} == r.reload({"bg": {"opacity": 0.5}}).layer("bg")
    seen = []

    def stop(n):
        seen.append(n)
        if n == 2:
            raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        api.render_npy(r.frames(0, 5), str(tmp_path / "p.npy"), stop)
    assert seen == [1, 2] and not (tmp_path / "p.npy").exists()
    import fcntl

    with open(path, "r+b") as f:
        fcntl.flock(f, fcntl.LOCK_EX)
        with pytest.raises(BlockingIOError):
            api.set_layer(path, "bg", name="late")
