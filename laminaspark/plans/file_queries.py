"""Queries of streams and of containers."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from laminaspark.functions.timegrid import frame_at_us
from laminaspark.plans.base import EV, FPS, FRAMES, KINDS, query, table
from laminaspark.plans.grid_queries import _STICKY
from laminaspark.sources import lvd, testsrc
from laminaspark.sources.layout import pack_index
from laminaspark.sources.shared import local, shared_dir
from laminaspark.sources.validate import faults, validate
from laminaspark.streaming.reading import files
from laminaspark.streaming.stateful import assemble_stream, sticky_stream


def _event_stream(spark, sf):
    """The events table as a stream of files."""
    schema = table(spark, sf, "events").schema
    e = files(spark, f"{sf}/events.parque[t]", schema, 4)
    us = F.timestamp_diff("MICROSECOND", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz"))
    layer = F.coalesce(*(F.when(F.col("event_type") == k, i) for i, k in enumerate(KINDS)))
    return e.withColumn("us", us).withColumn("frame", frame_at_us(F.col("us"), FPS)).withColumn("layer_index", layer.cast("int"))


def _drain(spark, stream, name):
    """Runs a stream over all that is there and gives what it wrote."""
    at = shared_dir(spark, name)
    stream.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")


@query(f"WITH {EV}, {_STICKY} SELECT s.frame, s.layer_index, s.image FROM sticky s JOIN (SELECT layer_index, max(frame) AS last FROM cells GROUP BY 1) USING (layer_index) WHERE image IS NOT NULL AND frame <= last")
def q57_stream_sticky(spark, sf):
    images = _event_stream(spark, sf).select("layer_index", "frame", "us", "event_id", F.col("value").alias("image"))
    rows = _drain(spark, sticky_stream(images, FRAMES), "sticky")
    return rows.groupBy("frame", "layer_index").agg(F.max_by("image", "us").alias("image"))


@query(f"WITH {EV}, done AS (SELECT f AS frame, count(c.frame) = 5 AS complete FROM generate_series(0, 719) t(f) LEFT JOIN cells c ON c.frame = f GROUP BY f) SELECT file, frame FROM (SELECT frame // 24 AS file, frame, bool_and(complete) OVER (PARTITION BY frame // 24 ORDER BY frame) AS released FROM done) WHERE released")
def q58_stream_assemble(spark, sf):
    planes = _event_stream(spark, sf).select(F.expr("frame div 24").alias("file"), "frame", "layer_index", "us")
    return _drain(spark, assemble_stream(planes, range(len(KINDS)), 24), "assemble").select("file", "frame")


@query(f"""WITH {EV}, done AS (SELECT frame // 24 AS file, frame, count(*) = 5 AS complete FROM cells GROUP BY 1, 2), ends AS (SELECT file, max(frame) AS last FROM done GROUP BY 1),
every AS (SELECT f // 24 AS file, f AS frame, coalesce(complete, false) AS complete, last FROM generate_series(0, 719) t(f) JOIN ends ON ends.file = f // 24 LEFT JOIN done ON done.frame = f)
SELECT file, frame, NOT complete AS lost FROM (SELECT *, bool_and(complete OR frame <= last - 3) OVER (PARTITION BY file ORDER BY frame) AS went FROM every) WHERE went""")
def q77_stream_lost(spark, sf):
    """Frames in order, where one that lacks a plane three frames later is given up as a whole."""
    planes = _event_stream(spark, sf).select(F.expr("frame div 24").alias("file"), "frame", "layer_index", "us")
    return _drain(spark, assemble_stream(planes, range(len(KINDS)), 24, patience=3), "lost")


def _made(spark, name, frames, change=None):
    """A synthetic container in the shared folder."""
    folder = local(shared_dir(spark, "lvd"))
    os.makedirs(folder, exist_ok=True)
    path = f"{folder}/{name}.lvd"
    lvd.write_file(path, testsrc.meta(), testsrc.resources(), iter(frames), (lambda rows: pack_index(change(rows))) if change else pack_index)
    return path


#: Packets of the synthetic file: key and other pictures of layer 0, colour and alpha of layer 2, which begins at frame 15.
Q59_SQL = """SELECT f AS frame_index, (f % 10 = 0)::INT AS flags, l::INT AS layer_index, active::INT AS kind, (active AND key)::INT AS frame_flags,
  CASE WHEN NOT active THEN '' WHEN l = 0 AND key THEN '824983424003f001f0' WHEN l = 0 THEN '8600' WHEN key THEN 'a2498342e0015000d0' ELSE 'a600' END AS color,
  CASE WHEN NOT active OR l = 0 THEN '' WHEN key THEN '8249834250015000d0' ELSE '8600' END AS alpha
FROM (SELECT f, l, l = 0 OR f >= 15 AS active, f % 10 = 0 OR (l = 2 AND f = 15) AS key FROM generate_series(12, 30) t(f), (VALUES (0), (2)) u(l))"""


@query(Q59_SQL)
def q59_lvd_roundtrip(spark, sf):
    """A container read by frame range and layer, written anew from its table, audited, published and read again."""
    first = _made(spark, "first", testsrc.frames())
    second = first.replace("first.lvd", "second.lvd")
    lvd.write(lvd.read(spark, first), second, testsrc.meta(), testsrc.resources(), faults(spark))
    some = lvd.read(spark, second, layers=[0, 2]).where("frame_index >= 12 AND frame_index < 31")
    each = some.select("frame_index", "flags", F.explode("entries").alias("e"))
    return each.select("frame_index", "flags", "e.layer_index", "e.kind", "e.frame_flags", F.lower(F.hex("e.color")).alias("color"), F.lower(F.hex("e.alpha")).alias("alpha"))


#: What each broken file must give, and nothing else; the valid one gives nothing. A dropped or misnumbered access point also
#: widens the distance of its neighbours (I8), misses in the index (I10) and the count (no frame), and takes audio along (I9).
Q60_SQL = """SELECT mutation, code, frame::BIGINT AS frame, 'error' AS severity FROM (VALUES
  ('missing_entry', 'I2', 30), ('entry_order', 'I2', 31), ('active_entry_empty', 'I3', 32), ('layer_start_not_key', 'I4', 15), ('hold_entry', 'CAU', 33),
  ('alpha_key_mismatch', 'I5', 10), ('alpha_key_mismatch', 'I6', 10), ('alpha_key_mismatch', 'VP9', 10), ('audio_wrong_frame', 'I9', 11),
  ('rap_flag_cleared', 'I6', 10), ('rap_flag_cleared', 'I8', 0), ('frame0_not_rap', 'I6', 0), ('frame0_not_rap', 'I7', 0),
  ('frame_index_gap', 'I1', 20), ('frame_index_gap', 'I1', 21), ('frame_index_gap', 'I8', 10), ('frame_index_gap', 'I9', 21), ('frame_index_gap', 'I10', 20),
  ('dropped_cau', 'I1', 20), ('dropped_cau', 'I1', NULL), ('dropped_cau', 'I8', 10), ('dropped_cau', 'I10', 20), ('dropped_cau', 'I10', NULL),
  ('index_wrong_offset', 'I10', 25), ('index_wrong_rap', 'I10', 10)) v(mutation, code, frame)"""


@query(Q60_SQL)
def q60_lvd_mutations(spark, sf):
    """The valid file and 13 broken ones with the codes and the frames that validation gives."""
    out = None
    for name, (make, _, _) in {"valid": (lambda: (testsrc.frames(), None), (), None), **testsrc.MUTATIONS}.items():
        frames, change = make()
        found = validate(spark, _made(spark, name, frames, change)).select(F.lit(name).alias("mutation"), "code", "frame", "severity").distinct()
        out = found if out is None else out.unionByName(found)
    return out
