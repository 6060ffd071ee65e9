"""Streams over several files, each a micro-batch: late images, lost and late planes."""

import pytest
from pyspark.sql import functions as F

from laminaspark.streaming.reading import files
from laminaspark.streaming.stateful import assemble_stream, sticky_stream


def run(spark, tmp_path, batches, schema, make):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = make(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(str(tmp_path / "out"))


IMAGES = "layer_index int, frame bigint, us bigint, event_id bigint, image double"


@pytest.mark.parametrize("late", [None, 100])
def test_late_images(spark, tmp_path, late):
    """An image of an earlier frame, in a later batch, changes the frames up to the next image."""
    batches = [[(0, 4, 40, 1, 1.0), (0, 9, 90, 2, 2.0)], [(0, 5, 50, 3, 9.0), (0, 12, 120, 4, 3.0)], [(0, 9, 91, 5, 7.0), (1, 3, 30, 6, 5.0)]]
    out = run(spark, tmp_path, batches, IMAGES, lambda s: sticky_stream(s, 14, late))
    got = {(r.layer_index, r.frame): r.image for r in out.groupBy("layer_index", "frame").agg(F.max_by("image", "us").alias("image")).collect()}
    assert [got.get((0, f)) for f in range(3, 14)] == [None, 1, 9, 9, 9, 9, 7, 7, 7, 3, None] and got[1, 3] == 5


def test_images_behind_the_horizon(spark, tmp_path):
    batches = [[(0, 2, 20, 1, 1.0), (0, 10, 100, 2, 2.0)], [(0, 1, 10, 3, 8.0), (0, 9, 90, 4, 9.0)]]
    out = run(spark, tmp_path, batches, IMAGES, lambda s: sticky_stream(s, 14, 3))
    got = {r.frame: r.image for r in out.groupBy("frame").agg(F.max_by("image", "us").alias("image")).collect()}
    assert got == {**{f: 1.0 for f in range(2, 9)}, 9: 9.0, 10: 2.0}  # frame 1 came too late


PLANES = "file bigint, frame bigint, layer_index int, us bigint"


def test_lost_planes(spark, tmp_path):
    """Frame 1 never gets its second plane: it is given up when frame 4 shows; a plane of it that comes later changes nothing."""
    batches = [[(0, 0, 0, 0), (0, 0, 1, 1), (0, 1, 0, 10)], [(0, 2, 0, 20), (0, 2, 1, 21), (0, 3, 1, 30)], [(0, 4, 0, 40), (0, 3, 0, 41)], [(0, 1, 1, 50), (0, 4, 1, 51)]]
    got = [(r.frame, r.lost) for r in run(spark, tmp_path, batches, PLANES, lambda s: assemble_stream(s, (0, 1), 24, 3)).orderBy("frame").collect()]
    assert got == [(0, False), (1, True), (2, False), (3, False), (4, False)]
    waits = [(r.frame, r.lost) for r in run(spark, tmp_path / "w", batches[:3], PLANES, lambda s: assemble_stream(s, (0, 1), 24)).collect()]
    assert waits == [(0, False)]


@pytest.mark.parametrize(("limit", "sizes"), [({"most_files": 4}, [4, 4, 1]), ({"most_bytes": 1}, [1] * 9)])
def test_bounded_micro_batches(spark, tmp_path, limit, sizes):
    for k in range(9):
        spark.createDataFrame([(k,)], "k int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = files(spark, str(tmp_path / "in"), "k int", **limit).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [p["numInputRows"] for p in q.recentProgress if p["numInputRows"]] == sizes
