"""Issue tables: caps, codes, counts; statistics and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOST = 25


def capped(issues: DataFrame, seq: Sequence[str], most: int = MOST) -> DataFrame:
    """At most `most` issues of a code and severity, the first by seq; Spark limits each group before its shuffle."""
    w = Window.partitionBy("code", "severity").orderBy(*seq)
    return issues.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)


def suppressed(issues: DataFrame, most: int = MOST) -> DataFrame:
    """How many issues the cap hides, by CODE/severity."""
    n = issues.groupBy("code", "severity").agg(F.count(F.lit(1)).alias("total"))
    return n.select(F.concat_ws("/", "code", "severity").alias("what"), "total", F.greatest(F.col("total") - most, F.lit(0).cast("long")).alias("suppressed"))


def codes(issues: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return issues.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set("code")), ",").alias("codes"), F.count(F.lit(1)).alias("errors"))


def layer_stats(entries: DataFrame, layers: DataFrame) -> DataFrame:
    """Frames, key frames and bytes of each layer; layers without an entry have zeros."""
    sums = entries.where("kind = 1").groupBy("layer_index").agg(F.count(F.lit(1)).alias("frames"), F.count_if("is_key").alias("keyframes"), F.sum("color_bytes").alias("color_bytes"), F.sum("alpha_bytes").alias("alpha_bytes"))
    zero = F.lit(0).cast("long")
    return layers.select("layer_index").join(sums, "layer_index", "left").select("layer_index", *(F.coalesce(c, zero).alias(c) for c in ("frames", "keyframes", "color_bytes", "alpha_bytes")))
