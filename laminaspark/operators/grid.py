"""Frame-grid operators: grids, sticky fill, as-of lookups, access points, windows over frames. DataFrame in, DataFrame out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from laminaspark.functions.timegrid import Fps, div, frame_at_us, pts_us

#: Layers are a file's metadata and fit any task; a table of more rows isn't broadcast.
BROADCAST_LAYERS = 65_536


def few(layers: DataFrame) -> DataFrame:
    """Marks a table of layers for broadcast if it has at most BROADCAST_LAYERS rows; a larger one is left to the planner."""
    return F.broadcast(layers) if layers.limit(BROADCAST_LAYERS + 1).count() <= BROADCAST_LAYERS else layers


def frames(spark: SparkSession, count: int) -> DataFrame:
    return spark.range(count).withColumnRenamed("id", "frame")


def active(frame: Column, start: Column, end: Column) -> Column:
    return (start <= frame) & (frame < end)


def layer_grid(spark: SparkSession, layers: DataFrame, count: int) -> DataFrame:
    """Every frame of every layer with kind 1 (frame) where the layer is active, else 0 (empty). Each layer row makes its own
    frames, so no join is needed."""
    each = layers.withColumn("frame", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))))
    return each.withColumn("kind", active(F.col("frame"), F.col("start_frame"), F.col("end_frame")).cast("int"))


def active_frames(layers: DataFrame) -> DataFrame:
    """The active frames alone; layers of an empty range give none."""
    return layers.where("start_frame < end_frame").withColumn("frame", F.explode(F.sequence(F.col("start_frame"), F.col("end_frame") - 1)))


def active_ranges(images: DataFrame, keys: Sequence[str], count: int, end: str | None = None) -> DataFrame:
    """A layer starts with its first image and ends where it was ended, else with the file."""
    last = F.coalesce(F.max(end), F.lit(count).cast("long")) if end else F.lit(count).cast("long")
    return images.groupBy(*keys).agg(F.min("frame").alias("start_frame"), last.alias("end_frame"))


def sticky(grid: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """The last value at or before each frame of a layer."""
    before = Window.partitionBy(*keys).orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    return grid.withColumn(out, F.last(value, ignorenulls=True).over(before))


def key_frame(frame: Column, start: Column, gop: int) -> Column:
    return (frame == start) | (frame % gop == 0)


def rap_flags(entries: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A frame is an access point if all of its FRAME entries are keys; one without any is, too."""
    return entries.groupBy(*keys).agg(F.coalesce(F.every(F.when(F.col("kind") == 1, F.col("is_key"))), F.lit(True)).alias("rap"))


def access_point(table: DataFrame, keys: Sequence[str], rap: str, frame: str = "frame") -> DataFrame:
    """Adds the nearest access point at or before each frame, on a dense grid; before the first: the first, else 0."""
    w = Window.partitionBy(*keys).orderBy(frame)
    before = F.max(F.when(F.col(rap), F.col(frame))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    first = F.min(F.when(F.col(rap), F.col(frame))).over(Window.partitionBy(*keys))
    return table.withColumn("rap_frame", F.coalesce(before, first, F.lit(0).cast("long")))


def asof_backward(left: DataFrame, right: DataFrame, keys: Sequence[str], on: str, values: Sequence[str]) -> DataFrame:
    """Each left row with the values of the last right row at or before it: one sort of both sides' union by key, no join."""
    nothing = [F.lit(None).cast(right.schema[v].dataType).alias(f"_{v}") for v in values]
    mine = left.withColumn("_row", F.struct(*left.columns)).select(*keys, on, F.lit(1).alias("_side"), "_row", *nothing, F.lit(None).cast("boolean").alias("_there"))
    other = right.select(*keys, on, F.lit(0).alias("_side"), F.lit(None).cast(mine.schema["_row"].dataType).alias("_row"), *(F.col(v).alias(f"_{v}") for v in values), F.lit(True).alias("_there"))
    w = Window.partitionBy(*keys).orderBy(on, "_side").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("_there"), F.struct(*(F.col(f"_{v}") for v in values))), ignorenulls=True).over(w)
    return mine.unionByName(other).withColumn("_found", last).where("_side = 1").select("_row.*", *(F.col(f"_found._{v}").alias(v) for v in values))


def rap_gaps(raps: DataFrame, keys: Sequence[str], count: int, most: int) -> DataFrame:
    """Access points further apart than `most` (error), and a tail longer than that after the last (warning)."""
    w = Window.partitionBy(*keys).orderBy("frame")
    after = F.lead("frame").over(w)
    gap = F.greatest(F.coalesce(after, F.lit(count).cast("long")) - F.col("frame"), F.lit(0).cast("long"))
    return raps.withColumn("gap", gap).withColumn("severity", F.when(after.isNull(), "warning").otherwise("error")).where(F.col("gap") > most)


def continuity(caus: DataFrame, key: str, ordinal: Sequence[str], frame: str) -> DataFrame:
    """Breaks of a file's frame numbers against its order: `gap` misses one, `gaps` several, `backwards` repeats or returns.
    After a break counting goes on from the number found, so that one fault is one row."""
    w = Window.partitionBy(key).orderBy(*ordinal)
    expected = F.coalesce(F.lag(frame).over(w) + 1, F.lit(0)).cast("long")
    found = caus.select(key, (F.row_number().over(w) - 1).cast("long").alias("k"), F.col(frame).cast("long").alias("frame"), expected.alias("expected"))
    kind = F.when(F.col("frame") < F.col("expected"), "backwards").when(F.col("frame") == F.col("expected") + 1, "gap").otherwise("gaps")
    return found.where("frame <> expected").withColumn("kind", kind)


def running_offset(table: DataFrame, keys: Sequence[str], order: Sequence[str], size: str, out: str, base: int = 0) -> DataFrame:
    """Bytes before each row of its file: an exclusive running sum."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return table.withColumn(out, F.coalesce(F.sum(size).over(w), F.lit(0)).cast("long") + base)


def global_offset(table: DataFrame, order: str, size: str, out: str, base: int, parts: int = 256) -> DataFrame:
    """`running_offset` over one whole table without a single task for it: rows are dealt by ranges of the order column
    (equal widths), each range is summed, and the sums before it (at most `parts` of them) are added."""
    low, high = table.agg(F.min(order), F.max(order)).first()
    if low is None:
        return table.withColumn(out, F.lit(base).cast("long"))
    width = max(1, -(-(high - low + 1) // parts))
    dealt = table.withColumn("_part", div(F.col(order) - low, width))
    sums = dealt.groupBy("_part").agg(F.sum(size).alias("_n"))
    first = sums.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long").alias("_first"))
    inside = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return dealt.withColumn("_in", F.coalesce(F.sum(size).over(inside), F.lit(0)).cast("long")).join(F.broadcast(first), "_part").withColumn(out, F.col("_first") + F.col("_in") + base).drop("_part", "_first", "_in")


def audio_windows(packets: DataFrame, fps: Fps, pts: str = "pts_us") -> DataFrame:
    """Packets with the frame whose window holds their time: the closed form instead of a range join."""
    return packets.withColumn("frame", frame_at_us(F.col(pts), fps))


def outside_window(packets: DataFrame, fps: Fps, frame: str = "frame", pts: str = "pts_us") -> DataFrame:
    """Packets that don't belong to the frame that carries them."""
    f = F.col(frame)
    return packets.where((F.col(pts) < pts_us(f, fps)) | (F.col(pts) >= pts_us(f + 1, fps)))


def not_increasing(packets: DataFrame, key: str, order: Sequence[str], time: str) -> DataFrame:
    """Rows whose time doesn't exceed the one before them in the file."""
    w = Window.partitionBy(key).orderBy(*order)
    return packets.withColumn("previous", F.lag(time).over(w)).where(F.col(time) <= F.col("previous"))


def playback(ticks: DataFrame, fps: Fps, count: int, late_us: int = 2_000_000) -> DataFrame:
    """Clock ticks (tick, t_us) with the frame shown, the frames dropped since the last one, and whether the player jumps."""
    shown = ticks.withColumn("shown", F.least(frame_at_us(F.col("t_us"), fps), F.lit(count - 1).cast("long")))
    before = F.lag("shown").over(Window.orderBy("tick"))
    jump = F.col("t_us") - pts_us(F.least(F.coalesce(before, F.lit(-1).cast("long")) + 1, F.lit(count - 1).cast("long")), fps) > late_us
    return shown.withColumn("dropped", F.greatest(F.col("shown") - F.coalesce(before, F.lit(-1).cast("long")) - 1, F.lit(0).cast("long"))).withColumn("late_jump", jump)


def playback_counters(ticks: DataFrame, keys: Sequence[str], time: str, fps: Fps, count: int, late_us: int = 2_000_000) -> DataFrame:
    """What `playback` does over all ticks of a key, counted: frames shown, ticks that hold the frame shown already, frames
    dropped, and late jumps. Ticks are summed up by frame first, so a key has `count` rows in the window at most."""
    last = F.lit(count - 1).cast("long")
    late = lambda t, before: (t - pts_us(F.least(before + 1, last), fps) > late_us).cast("long")
    by_frame = ticks.withColumn("f", F.least(frame_at_us(F.col(time), fps), last)).groupBy(*keys, "f").agg(F.count(F.lit(1)).alias("n"), F.min(time).alias("first"), F.sum(late(F.col(time), F.col("f"))).alias("late"))
    before = F.coalesce(F.lag("f").over(Window.partitionBy(*keys).orderBy("f")), F.lit(-1).cast("long"))
    # Only a frame's first tick follows another frame; of the others those after the last frame's time are late.
    jumps = F.col("late") - late(F.col("first"), F.col("f")) + late(F.col("first"), F.col("before"))
    sums = {"shown": F.lit(1), "held": F.col("n") - 1, "dropped": F.col("f") - F.col("before") - 1, "late_jumps": jumps}
    return by_frame.withColumn("before", before).groupBy(*keys).agg(*(F.sum(c).cast("long").alias(n) for n, c in sums.items()))


def released(state: DataFrame, key: Sequence[str] = ()) -> DataFrame:
    """Frames in order up to the first incomplete one (column complete): a running `every`."""
    w = Window.partitionBy(*key).orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    return state.withColumn("released", F.every("complete").over(w))


def onsets(times: DataFrame, key: str, time: str, quiet: int) -> DataFrame:
    """Rows that follow at least `quiet` units without any; a key's first row is one."""
    before = F.lag(time).over(Window.partitionBy(key).orderBy(time))
    return times.withColumn("silence", F.col(time) - before).where(F.col("silence").isNull() | (F.col("silence") >= quiet))


def draw_order(table: DataFrame, z: str, index: str, out: str, explicit: Sequence[int] = (), keys: Sequence[str] = ()) -> DataFrame:
    """Rank in the stack: by z, then index; with an explicit order, its layers first and the others on top."""
    place = F.coalesce(F.nullif(F.array_position(F.array(*(F.lit(x).cast("long") for x in explicit)), F.col(index).cast("long")), F.lit(0).cast("long")), F.lit(1 << 62).cast("long")) if explicit else F.lit(0)
    return table.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(place, z, index)) - 1)


def opus_pts(packets: DataFrame, key: str, order: str, samples: str, rate: int = 48_000) -> DataFrame:
    """Each packet's start and length in microseconds from the samples before it."""
    from laminaspark.functions.timegrid import samples_to_us

    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(samples).over(w), F.lit(0)).cast("long")
    return packets.withColumn("start", samples_to_us(before, rate)).withColumn("duration_us", samples_to_us(before + F.col(samples), rate) - F.col("start"))
