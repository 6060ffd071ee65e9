"""The container: layout, scans, validation, writing, publishing."""

import pytest
from pyspark.sql import functions as F

from laminaspark.plans.file_queries import _made
from laminaspark.sources import lvd, testsrc
from laminaspark.sources.layout import Entry, FormatError, Frame, Packet
from laminaspark.sources.validate import Fatal, faults, parse_meta, stats, validate


@pytest.fixture(scope="module")
def path(spark):
    return _made(spark, "valid", testsrc.frames())


def test_layout():
    c = Frame(7, 1, [Entry(0, 1, 1, b"abc", b"de"), Entry(2)], [Packet(-5, 20000, b"xyz")])
    assert len(c.pack()) == 68 and Frame.unpack(c.pack()) == c
    with pytest.raises(FormatError):
        Frame.unpack(c.pack()[:-1])
    with pytest.raises(FormatError):
        Frame(1 << 32).pack()


def test_valid(spark, path):
    assert validate(spark, path).count() == 0
    rows = {r.layer_index: (r.frames, r.keyframes) for r in stats(spark, path, testsrc.meta()).collect()}
    assert rows[2] == (20, 3) and rows[0] == (40, 4)
    caus = lvd.read(spark, path)
    assert [r[0] for r in caus.where(F.col("flags") == 1).select("frame_index").orderBy("frame_index").collect()] == [0, 10, 20, 30]


def test_pruned_scan(spark, path):
    some = lvd.read(spark, path, layers=[1], spans=1).where("frame_index >= 12 AND frame_index < 15")
    assert [(r.frame_index, [e.layer_index for e in r.entries]) for r in some.orderBy("frame_index").collect()] == [(12, [1]), (13, [1]), (14, [1])]
    assert lvd.read(spark, path, spans=1).rdd.getNumPartitions() == 4  # one a group of frames
    assert lvd.scan_binary(spark, path).count() == 40


@pytest.mark.parametrize("name", list(testsrc.MUTATIONS))
def test_mutations(spark, name):
    make, codes, frame = testsrc.MUTATIONS[name]
    frames, change = make()
    found = validate(spark, _made(spark, name, frames, change)).where("severity = 'error'").collect()
    assert codes <= {r.code for r in found}
    assert frame in {r.frame for r in found}
    if name == "dropped_cau":
        assert sum(r.code == "I1" for r in found) == 2


def test_hostile_metadata():
    for raw in (b"\xef\xbb\xbf{}", b'{"a": NaN}', b'{"a": 1e999}', b"[]", b"\xff"):
        with pytest.raises(Fatal):
            parse_meta(raw)


def test_garbage(spark, tmp_path):
    for k, data in enumerate((b"", b"x" * 100, b"LVF1" + bytes(60))):
        p = tmp_path / f"{k}.lvd"
        p.write_bytes(data)
        assert validate(spark, str(p)).where("severity = 'error'").count() > 0


def test_roundtrip_and_publish(spark, path, tmp_path):
    out = str(tmp_path / "copy.lvd")
    assert lvd.write(lvd.read(spark, path), out, testsrc.meta(), testsrc.resources(), faults(spark)) == 40
    assert open(out, "rb").read() == open(path, "rb").read()
    broken = lvd.read(spark, path).withColumn("flags", F.lit(0))
    with pytest.raises(FormatError):
        lvd.write(broken, out, testsrc.meta(), testsrc.resources(), faults(spark))
    assert open(out, "rb").read() == open(path, "rb").read() and not (tmp_path / "copy.lvd.tmp").exists()


def test_scan_from_the_access_point(spark, path):
    some = lvd.read(spark, path, **{"from": 13, "to": 15})
    assert [r[0] for r in some.select("frame_index").orderBy("frame_index").collect()] == [10, 11, 12, 13, 14]
    file = lvd.open_file(path)
    assert lvd.read_at(path, file.index[7][2], [1]).frame_index == 7 and [e.layer_index for e in lvd.read_at(path, file.index[7][2], [1]).entries] == [1]
    with pytest.raises(FormatError):
        lvd.read_at(path, 5)


def test_strict_reads(spark):
    """An index that doesn't rise, starts without an access point or names another place, and frames against the metadata."""
    falling = _made(spark, "falling", testsrc.frames(), lambda rows: [*rows[:5], rows[4], *rows[6:]])
    no_start = _made(spark, "no_start", testsrc.frames(), lambda rows: [(0, 0, rows[0][2]), *rows[1:]])
    elsewhere = _made(spark, "elsewhere", testsrc.frames(), lambda rows: [(f, 0 if f == 10 else g, o) for f, g, o in rows])
    for bad in (falling, no_start, elsewhere):
        with pytest.raises(Exception, match="index|access point"):
            lvd.read(spark, bad).count()
    for name in ("missing_entry", "entry_order", "active_entry_empty", "hold_entry"):
        broken = _made(spark, name, testsrc.MUTATIONS[name][0]()[0])
        assert lvd.read(spark, broken).count() == 40
        with pytest.raises(Exception, match="entries|differ"):
            lvd.read(spark, broken, strict="true").count()
    assert lvd.read(spark, _made(spark, "fine", testsrc.frames()), strict="true").count() == 40
