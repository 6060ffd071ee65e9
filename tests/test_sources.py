"""Ogg, projects, the command line."""

import json

import numpy as np
import pytest

from laminaspark import api
from laminaspark.cli import main
from laminaspark.sources import ogg, project
from laminaspark.sources.codecs import png_encode

HEAD = b"OpusHead" + bytes([1, 2]) + (312).to_bytes(2, "little") + bytes(7)


def stream(parts, granule):
    return ogg.pages([HEAD, b"OpusTags" + bytes(8), *parts], granule)


def test_ogg_pages():
    parts = [b"\xfc" + bytes(700), b"\xfc" + bytes(254), b"", b"\xfc"]
    assert ogg.packets(ogg.pages(parts, 5)) == (parts, 5)
    assert ogg.packets(ogg.pages([b"a"], 1, 7) + ogg.pages([b"b"], 2, 8)) == ([b"a"], 1)
    for bad in (b"junk", ogg.pages(parts, 5)[:-1], ogg.pages(parts, 5)[:20]):
        with pytest.raises(ogg.OggError):
            ogg.packets(bad)
    with pytest.raises(ogg.OggError):
        ogg.head(b"OpusHea")


def test_opus_times(spark, tmp_path):
    (tmp_path / "a.opus").write_bytes(stream([b"\xfc\x01", b"\xf9\x01", b"\x78\x01"], 960 + 1920 + 100))
    (tmp_path / "b.opus").write_bytes(stream([b"\xfc\x01"] * 3, 99_999))
    rows = ogg.read(spark, str(tmp_path)).orderBy("path", "seq").collect()
    assert [(r.pts_us, r.duration_us) for r in rows] == [(0, 20000), (20000, 40000), (60000, 2083), (0, 20000), (20000, 20000), (40000, 20000)]
    assert {(r.channels, r.pre_skip) for r in rows} == {(2, 312)}


@pytest.fixture()
def described(tmp_path):
    (tmp_path / "bg").mkdir()
    for k in range(3):
        (tmp_path / f"bg/{k}.png").write_bytes(png_encode(np.full((8, 16, 3), 50 * k, np.uint8)))
    np.save(tmp_path / "m.npy", np.full((2, 4, 4, 4), 255, np.uint8))
    (tmp_path / "s.png").write_bytes(png_encode(np.full((2, 2, 3), 9, np.uint8)))
    (tmp_path / "a.opus").write_bytes(stream([b"\xfc\x01"] * 30, 10**6))
    doc = {"canvas": {"width": 16, "height": 8}, "fps": "30", "duration": 0.2, "gop": 2, "audio": {"src": "a.opus"}, "layers": [{"id": "bg", "src": "bg"}, {"id": "m", "src": "m.npy", "start": 0.1, "rect": "0,0,4,4", "opacity": 0.5}, {"id": "s", "kind": "still", "src": "s.png", "rect": [14, 6, 2, 2], "end_frame": 99}]}
    (tmp_path / "p.json").write_text(json.dumps(doc))
    return tmp_path, doc


def test_project(spark, described):
    folder, doc = described
    p = project.load(str(folder / "p.json"))
    assert (p.frames, p.gop, p.layers[1].start, p.layers[2].end) == (6, 2, 3, 6)
    assert project.pack(spark, p) == 6
    r = api.Reader(spark, str(folder / "p.lvd"))
    assert r.raps == [0, 2, 4] and r.audio().count() == 10
    assert r.frame(5)[7, 0].tolist() == [100] * 3 and r.frame(5)[0, 0].tolist() == [178] * 3 and r.frame(5)[7, 15].tolist() == [9] * 3
    for change in ({"duration": 0}, {"layers": []}, {"fps": "0/1"}, {"layers": [{"id": "1", "src": "bg"}]}, {"layers": [{"id": "a", "src": "gone"}]}, {"layers": [{"id": "a", "src": "bg", "start": 9}]}):
        (folder / "q.json").write_text(json.dumps(doc | change))
        with pytest.raises(ValueError):
            project.load(str(folder / "q.json"))


def test_project_tells_all_faults(spark, described):
    folder, doc = described
    wrong = doc | {"layers": [{"id": "7", "src": "bg", "opacity": 3}, {"id": "a", "src": "gone", "rect": "1,2"}, {"id": "a", "src": "bg", "blend": "dodge", "start": "soon"}]}
    (folder / "q.json").write_text(json.dumps(wrong))
    with pytest.raises(project.ProjectError) as e:
        project.load(str(folder / "q.json"))
    assert all(x in str(e.value) for x in ("'7'", "opacity", "gone", "rect", "blend", "soon"))


def test_more_commands(spark, described, capsys):
    folder, _ = described
    at = str(folder / "p.lvd")
    assert main(["pack", str(folder / "p.json")], spark) == 0
    assert main(["add", at, "logo", str(folder / "s.png"), "--rect", "1,1,2,2"], spark) == 0 and main(["add", at, "again", str(folder / "bg"), "--start", "2"], spark) == 0
    assert [x["id"] for x in api.Reader(spark, at).layers] == ["bg", "m", "s", "logo", "again"] and main(["check", at], spark) == 0
    assert main(["extract", at, "m", str(folder / "m_out.npy"), "--range", "0.1s:"], spark) == 0 and np.load(folder / "m_out.npy").shape == (3, 4, 4, 4)
    assert main(["render", at, str(folder / "o.npy"), "--range", "0.1s:5"], spark) == 0 and np.load(folder / "o.npy").shape[0] == 2
    assert main(["render", at, str(folder / "o.npy"), "--range", "5:99"], spark) == 2
    capsys.readouterr()
    assert main(["info", at, "--frames"], spark) == 0 and "frame 2 at " in capsys.readouterr().out
    assert main(["testsrc", str(folder / "t.lvd")], spark) == 0 and main(["check", str(folder / "t.lvd")], spark) == 0
    assert main(["corrupt", str(folder / "t.lvd"), "frame_index_gap"], spark) == 0 and main(["check", str(folder / "t.lvd")], spark) == 1


def test_commands(spark, described, capsys):
    folder, _ = described
    at = str(folder / "p.lvd")
    assert main(["pack", str(folder / "p.json")], spark) == 0 and main(["check", at], spark) == 0
    capsys.readouterr()
    assert main(["info", at, "--json"], spark) == 0
    found = json.loads(capsys.readouterr().out)
    assert (found["frames"], found["raps"], found["audio_packets"]) == (6, "0, 2, … 4 (every 2)", 10)
    assert main(["set", at, "m", "opacity=0.25", "name=Mask"], spark) == 0 and api.Reader(spark, at).layer("m")["name"] == "Mask"
    assert main(["render", at, str(folder / "out.npy"), "--range", "1:4", "--hide", "m"], spark) == 0 and np.load(folder / "out.npy").shape == (3, 8, 16, 3)
    assert main(["render", at, str(folder / "out/%03d.png"), "--layers", "bg"], spark) == 0 and (folder / "out/005.png").exists()
    assert main(["rm", at, "m"], spark) == 0 and [x["id"] for x in api.Reader(spark, at).layers] == ["bg", "s"]
    (folder / "bad.lvd").write_bytes(b"x" * 80)
    assert main(["check", str(folder / "bad.lvd")], spark) == 1 and main(["info", str(folder / "bad.lvd")], spark) == 2
