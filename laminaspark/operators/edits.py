"""Edits of layered files as plans: remove, append, re-index, retime, set fields, merge orders, overrides."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from laminaspark.functions.timegrid import Fps, frame_at_us, pts_us
from laminaspark.operators.grid import few


def remap(layers: DataFrame, removed: DataFrame, on: str, index: str, out: str = "new_index") -> DataFrame:
    """Layers without the removed ones, numbered anew in their order."""
    kept = layers.join(few(removed), on, "left_anti")
    return kept.withColumn(out, F.row_number().over(Window.orderBy(index)) - 1)


def append(parts: Sequence[DataFrame]) -> DataFrame:
    """Kept layers, then new ones, in the order of the parts; each part has `position` of its own."""
    all_parts = [p.withColumn("part", F.lit(k)) for k, p in enumerate(parts)]
    out = all_parts[0]
    for p in all_parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("layer_index", F.row_number().over(Window.orderBy("part", "position")) - 1)


def resource_offsets(stills: DataFrame, order: str, length: str, keys: Sequence[str] = ()) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return stills.withColumn("offset", F.coalesce(F.sum(length).over(w), F.lit(0)).cast("long"))


def set_layer(layers: DataFrame, which: Column, values: Mapping[str, Column]) -> DataFrame:
    """Sets fields of the layers that a condition names."""
    return layers.withColumns({k: F.when(which, v).otherwise(F.col(k)) for k, v in values.items()})


def retime_audio(packets: DataFrame, fps: Fps, frames: int) -> DataFrame:
    """Packets before the file's end with the frame that now carries them."""
    end = pts_us(F.lit(frames).cast("long"), fps)
    return packets.where(F.col("pts_us") < end).withColumn("frame", frame_at_us(F.col("pts_us"), fps))


def merge_order(layers: DataFrame, kept: DataFrame, id_: str, place: str) -> DataFrame:
    """The order after a reload: layers of the kept order (columns id_, rank) share out the places that they hold among
    all; new layers stay where the file puts them. Adds `merged`, the place of each layer."""
    both = layers.join(few(kept), id_, "left")
    known = Window.partitionBy(F.col("rank").isNotNull())
    slot = F.row_number().over(known.orderBy(place))
    turn = F.row_number().over(known.orderBy("rank"))
    ranked = both.withColumn("_slot", slot).withColumn("_turn", turn)
    slots = ranked.where("rank IS NOT NULL").select(F.col("_slot").alias("_turn"), F.col(place).alias("_place"))
    return ranked.join(few(slots), "_turn", "left").withColumn("merged", F.when(F.col("rank").isNotNull(), F.col("_place")).otherwise(F.col(place))).drop("_slot", "_turn", "_place", "rank")


def move_to(order: Column, item: Column, to: Column) -> Column:
    """A list with one element taken out and put at a position from 0, clamped."""
    rest = F.filter(order, lambda x: x != item)
    return F.array_insert(rest, F.least(F.greatest(to, F.lit(0)), F.size(rest)) + 1, item)


def is_permutation(order: Column) -> Column:
    return F.array_sort(order) == F.sequence(F.lit(0), F.size(order) - 1)


def overrides(layers: DataFrame, user: DataFrame, on: str, fields: Sequence[str]) -> DataFrame:
    """A viewer's own settings (columns o_<field>) over the file's defaults."""
    both = layers.join(few(user), on, "left")
    return both.withColumns({k: F.coalesce(f"o_{k}", k) for k in fields}).drop(*(f"o_{k}" for k in fields))


def select_layers(layers: DataFrame, hide: DataFrame, on: str, wanted: DataFrame | None = None) -> DataFrame:
    """Visible layers, or those of a list (whose repeats stay), without hidden ones."""
    chosen = layers.where("visible") if wanted is None else layers.join(few(wanted), on)
    return chosen.join(few(hide), on, "left_anti")


def positional_match(actual: DataFrame, expected: DataFrame, on: Sequence[str]) -> DataFrame:
    """Both sides by position: rows that only one side has, or that differ (columns _a, _e prefixed value)."""
    return actual.join(expected, list(on), "full_outer")


def can_soft_seek(current: Column, target: Column, rap_of_target: Column, failed: Column) -> Column:
    """Whether playing on reaches the target sooner than starting over: ahead, in the same span or within 8 frames."""
    return F.coalesce(current.isNotNull() & ~failed & (target > current) & ((rap_of_target <= current) | (target - current <= 8)), F.lit(False))
