"""The common dataset of the queries: events on an hourly frame grid with five layers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laminaspark.functions.timegrid import Fps, frame_at_us

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

FPS, FRAMES, GOP = Fps(1, 3600), 720, 24
T0 = 1_704_067_200_000_000  # 2024-01-01 00:00:00 UTC
KINDS = ("click", "error", "purchase", "signup", "view")
MODES = ("normal", "add", "multiply", "screen", "normal")


def query(sql: str | None = None):
    """Registers a function as the query of its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(c):
    return F.unix_micros(c.cast("timestamp"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with us since T0, frame and layer_index; the session's time zone doesn't matter for zone-less times."""
    e = table(spark, sf_dir, "events")
    us = F.timestamp_diff("MICROSECOND", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz"))
    layer = F.coalesce(*(F.when(F.col("event_type") == k, i) for i, k in enumerate(KINDS)))
    return e.withColumn("us", us).withColumn("frame", frame_at_us(F.col("us"), FPS)).withColumn("layer_index", layer.cast("int"))


#: The same in SQL.
EV = f"""
ev AS (SELECT event_id, user_id, event_type, value, props, epoch_us(ts) - {T0} AS us,
              CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 WHEN 'view' THEN 4 END AS layer_index,
              CASE WHEN epoch_us(ts) - {T0} <= 0 THEN 0 ELSE (2 * (epoch_us(ts) - {T0})) // 7200000000 END AS frame FROM events),
cells AS (SELECT frame, layer_index, arg_max(value, (us, event_id)) AS image, count(*) AS n, sum(length(props)) AS bytes FROM ev GROUP BY ALL),
grid AS (SELECT f AS frame, l::INT AS layer_index FROM generate_series(0, 719) t(f), generate_series(0, 4) u(l)),
ranges AS (SELECT layer_index, min(frame) AS start_frame, 720 AS end_frame FROM cells GROUP BY 1)
"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The image of each (frame, layer): the last value by time."""
    last = F.max_by("value", F.struct("us", "event_id"))
    return events(spark, sf_dir).groupBy("frame", "layer_index").agg(last.alias("image"), F.count(F.lit(1)).alias("n"), F.sum(F.char_length("props")).alias("bytes"))


def ranges(images: DataFrame) -> DataFrame:
    return images.groupBy("layer_index").agg(F.min("frame").alias("start_frame"), F.lit(FRAMES).cast("long").alias("end_frame"))


def grid(spark: SparkSession) -> DataFrame:
    layers = F.explode(F.array(*(F.lit(i) for i in range(len(KINDS)))))
    return spark.range(FRAMES).select(F.col("id").alias("frame"), layers.alias("layer_index"))


def cau_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense grid with images, activity, kind and key flags."""
    images = cells(spark, sf_dir)
    dense = grid(spark).join(images, ["frame", "layer_index"], "left").join(F.broadcast(ranges(images)), "layer_index", "left")  # five rows at most
    kind = F.coalesce((F.col("start_frame") <= F.col("frame")) & (F.col("frame") < F.col("end_frame")), F.lit(False)).cast("int")
    return dense.withColumn("kind", kind).withColumn("is_key", (F.col("frame") == F.col("start_frame")) | (F.col("frame") % GOP == 0))


CAUS = """
caus AS (SELECT g.frame, g.layer_index, c.image, c.n, c.bytes, r.start_frame, r.end_frame,
                CASE WHEN r.start_frame <= g.frame AND g.frame < r.end_frame THEN 1 ELSE 0 END AS kind,
                (g.frame = r.start_frame OR g.frame % 24 = 0) AS is_key
         FROM grid g LEFT JOIN cells c USING (frame, layer_index) LEFT JOIN ranges r USING (layer_index))
"""


def faulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cau_grid with some key flags cleared by a rule, as a fault to find."""
    cleared = (F.col("frame") % 72 == 48) & (F.col("layer_index") == 2)
    return cau_grid(spark, sf_dir).withColumn("is_key", F.col("is_key") & ~cleared)


RAPS = """
raps AS (SELECT frame, coalesce(bool_and(is_key AND NOT (frame % 72 = 48 AND layer_index = 2)) FILTER (kind = 1), true) AS rap FROM caus GROUP BY frame)
"""
