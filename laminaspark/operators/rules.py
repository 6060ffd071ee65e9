"""Validation as queries: tables of frames, layers and index rows in, one issues table (seq, code, message, frame, severity) out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from laminaspark.functions.bits import vp9_header
from laminaspark.functions.scalars import codec_profile
from laminaspark.functions.timegrid import Fps, pts_us
from laminaspark.operators.grid import few

RAP = KEY = 1


def issue(rows: DataFrame, code: str, message: Column | str, frame: Column | str | None, severity: str = "error", rule: int = 0) -> DataFrame:
    text = F.lit(message) if isinstance(message, str) else message
    at = F.lit(None).cast("long") if frame is None else (F.col(frame) if isinstance(frame, str) else frame).cast("long")
    k = F.col("k") if "k" in rows.columns else F.lit(-1).cast("long")
    return rows.select(F.struct(k.cast("long").alias("k"), F.lit(rule).alias("rule")).alias("seq"), F.lit(code).alias("code"), text.alias("message"), at.alias("frame"), F.lit(severity).alias("severity"))


def several(rows: DataFrame, checks: list[tuple], frame: str = "frame_index") -> DataFrame:
    """One pass for many rules: (code, message, condition, rule, severity="error"); a row gives an issue for each that holds."""

    def one(code, message, condition, rule, severity="error"):
        text = F.lit(message) if isinstance(message, str) else message
        return F.when(F.coalesce(condition, F.lit(False)), F.struct(F.struct(F.col("k").cast("long").alias("k"), F.lit(rule).alias("rule")).alias("seq"), F.lit(code).alias("code"), text.alias("message"), F.col(frame).cast("long").alias("frame"), F.lit(severity).alias("severity")))

    return rows.select(F.explode(F.array_compact(F.array(*(one(*c) for c in checks)))).alias("_i")).select("_i.*")


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def numbering(caus: DataFrame, frames: int) -> list[DataFrame]:
    """I1: numbers in order from 0, none beyond the count, as many as the count. Counting goes on from what was found."""
    w = Window.partitionBy("path").orderBy("k")
    found = caus.withColumn("expected", F.coalesce(F.lag("frame_index").over(w) + 1, F.lit(0)))
    off = found.where("frame_index <> expected")
    text = F.when(F.col("frame_index") < F.col("expected"), F.concat(F.lit("frame index goes back to "), "frame_index")).when(F.col("frame_index") == F.col("expected") + 1, F.concat(F.lit("frame "), "expected", F.lit(" is missing"))).otherwise(F.concat(F.lit("frames "), "expected", F.lit(" to "), F.col("frame_index") - 1, F.lit(" are missing")))
    beyond = caus.where(F.col("frame_index") >= frames)
    count = caus.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") != frames)
    return [issue(off, "I1", text, "k", rule=1), issue(beyond, "I1", F.concat(F.lit("frame index "), "frame_index", F.lit(" is beyond the frame count")), "k", rule=2), issue(count, "I1", F.concat(F.col("n"), F.lit(f" composite frames instead of {frames}")), None, rule=90)]


def entry_head(e: Column) -> Column:
    """What the rules need of an entry: no payload, but its packets' lengths and headers."""
    size = lambda c: F.coalesce(F.octet_length(c), F.lit(0)).cast("long")
    header = lambda c: F.when(size(c) > 0, vp9_header(F.substring(c, 1, 16)))
    return F.struct(e["layer_index"].alias("layer_index"), e["kind"].alias("kind"), e["frame_flags"].alias("frame_flags"), size(e["color"]).alias("color_bytes"), size(e["alpha"]).alias("alpha_bytes"), header(e["color"]).alias("c"), header(e["alpha"]).alias("a"))


def entry_table(caus: DataFrame, layers: DataFrame) -> DataFrame:
    """One row an entry (of `entry_head`s) with its layer's attributes. Of a layer named twice in a frame the first counts."""
    each = caus.select("k", "frame_index", F.posexplode("entries").alias("pos", "e")).select("k", "frame_index", "pos", "e.*")
    first = each.withColumn("_n", F.row_number().over(Window.partitionBy("k", "layer_index").orderBy("pos"))).where("_n = 1").drop("_n")
    known = first.join(few(layers.where("kind_name = 'video'")), "layer_index")
    flag = F.col("frame_flags").bitwiseAND(F.lit(KEY)) == KEY
    # A packet that can't be read, or is another codec's, counts as having the key-ness that its flag claims.
    vp9 = F.col("codec").startswith("vp09")
    real = lambda p: F.when(vp9 & F.coalesce(F.col(f"{p}.marker_ok"), F.lit(False)), F.col(f"{p}.key")).otherwise(flag)
    return known.withColumns({"has_color": F.col("color_bytes") > 0, "has_alpha_data": F.col("alpha_bytes") > 0, "active": (F.col("start_frame") <= F.col("frame_index")) & (F.col("frame_index") < F.col("end_frame")), "flag_key": flag, "color_key": real("c"), "alpha_key": real("a")})


def entries(caus: DataFrame, layers: DataFrame) -> list[DataFrame]:
    """I2 to I5, and the packets against the metadata."""
    want = layers.where("kind_name = 'video'").agg(F.array_sort(F.collect_list("layer_index")).alias("want"))
    listed = caus.select("k", "frame_index", F.transform("entries", lambda e: e["layer_index"]).alias("have")).join(F.broadcast(want))  # want has one row
    missing, extra = F.array_except("want", "have"), F.array_except("have", "want")
    words = lambda name, a: F.when(F.size(a) > 0, F.concat(F.lit(f"{name} "), F.array_join(F.transform(a, lambda x: x.cast("string")), ",")))
    detail = F.concat_ws("; ", words("missing", missing), words("extra", extra))
    out = [issue(listed.where("have <> want"), "I2", F.concat(F.lit("entries don't match the video layers: "), F.coalesce(F.nullif(detail, F.lit("")), F.lit("order"))), "frame_index", rule=10)]
    frame, c_there, a_there = F.col("kind") == 1, F.col("has_color"), F.col("has_alpha_data")
    named = lambda text: F.concat(F.lit("layer "), F.col("layer_index"), F.lit(f": {text}"))
    checks: list[tuple] = [
        ("CAU", named("unknown entry type"), ~F.col("kind").isin(0, 1), 11),
        ("I3", named("entry type contradicts the active range"), F.col("kind").isin(0, 1) & (frame != F.col("active")), 12),
        ("CAU", named("empty entry with data or flags"), (F.col("kind") == 0) & (c_there | a_there | (F.col("frame_flags") != 0)), 13),
        ("CAU", named("undefined frame flags"), frame & (F.col("frame_flags").bitwiseAND(F.lit(254)) != 0), 14),
        ("CAU", named("frame without colour"), frame & ~c_there, 15),
        ("CAU", named("alpha missing or unexpected"), frame & (a_there != F.col("has_alpha")), 16),
        ("I5", named("colour and alpha differ in key-ness"), frame & c_there & a_there & (F.col("color_key") != F.col("alpha_key")), 17),
        ("I4", named("doesn't start with a key frame"), frame & (F.col("frame_index") == F.col("start_frame")) & ~(F.col("flag_key") & F.col("color_key") & (~a_there | F.col("alpha_key"))), 18),
    ]
    profile = codec_profile(F.col("codec"))
    for plane, has, wanted in (("c", c_there, F.coalesce(profile, F.lit(0))), ("a", a_there, F.lit(0))):
        p = lambda name, plane=plane: F.col(f"{plane}.{name}")
        there = frame & has & F.col("codec").startswith("vp09")
        ok = there & F.coalesce(p("marker_ok"), F.lit(False)) & F.coalesce(p("sync_ok"), F.lit(True))
        key = ok & p("key")
        faults = {"unreadable packet": there & ~ok, "key-ness contradicts the flag": ok & (p("key") != F.col("flag_key")), "shows no frame": ok & ~p("shown"), "key frame has another size": key & ((p("width") != F.col("coded_width")) | (p("height") != F.col("coded_height"))), "profile contradicts the codec": ok & (p("profile") != wanted)}
        if plane == "a":
            faults["alpha range contradicts the metadata"] = key & F.col("alpha_range").isNotNull() & ((p("color_range") == 1) != (F.col("alpha_range") == "full"))
        else:
            faults["lossless colour isn't RGB"] = key & (profile == 1) & (p("color_space") != 7)
        checks += [("VP9", named(text), cond, 20 + k) for k, (text, cond) in enumerate(faults.items())]
    return [*out, several(entry_table(caus, layers), checks)]


def access_points(caus: DataFrame, layers: DataFrame, frames: int, most: int) -> list[DataFrame]:
    """I6 to I8, undefined flags."""
    e = entry_table(caus, layers)
    fine = F.when(F.col("kind") == 0, True).when((F.col("kind") == 1) & F.col("has_color"), F.col("flag_key") & F.col("color_key") & (~F.col("has_alpha_data") | F.col("alpha_key"))).otherwise(False)
    computed = e.groupBy("k").agg(F.every(fine).alias("want"))
    flags = caus.select("k", "path", "frame_index", "flags", "reserved_13", "reserved_18", (F.col("flags").bitwiseAND(F.lit(RAP)) == RAP).alias("rap")).join(computed, "k", "left").withColumn("want", F.coalesce("want", F.lit(True)))
    w = Window.partitionBy("path").orderBy("k")
    raps = flags.where("rap").withColumn("next", F.lead("frame_index").over(w))
    at = F.col("frame_index")
    mine = [
        ("I6", F.when(F.col("rap"), "flagged as access point, but not all frames are keys").otherwise("all frames are keys, but not flagged as access point"), F.col("rap") != F.col("want"), 30),
        ("I7", "frame 0 is no access point", (at == 0) & ~F.col("rap"), 31),
        ("CAU", "undefined flags", F.col("flags").bitwiseAND(F.lit(254)) != 0, 3),
        ("CAU", "reserved bytes aren't zero", (F.col("reserved_13") != 0) | (F.col("reserved_18") != 0), 4, "warning"),
    ]
    gaps = [
        ("I8", F.concat(F.lit("access points "), at, F.lit(" and "), "next", F.lit(" are too far apart")), F.col("next") - at > most, 40),
        ("I8", "no access point near the end", F.col("next").isNull() & (frames - at > most), 41, "warning"),
    ]
    return [several(flags, mine), several(raps, gaps)]


def audio(caus: DataFrame, fps: Fps, expected: bool) -> list[DataFrame]:
    """AUD and I9."""
    p = caus.select("path", "k", "frame_index", F.posexplode("audio").alias("pos", "a")).select("path", "k", "frame_index", "pos", "a.*")
    w = Window.partitionBy("path").orderBy("k", "pos")
    f = F.col("frame_index")
    checks = [
        ("AUD", "empty audio packet", F.octet_length("data") == 0, 50),
        ("AUD", "audio packet without duration", F.col("duration_us") == 0, 51, "warning"),
        ("AUD", "audio time doesn't increase", F.col("pts_us") <= F.col("before"), 52),
        ("I9", F.concat(F.lit("audio at "), "pts_us", F.lit(" us is outside the frame's window")), (F.col("pts_us") < pts_us(f, fps)) | (F.col("pts_us") >= pts_us(f + 1, fps)), 53),
    ]
    if not expected:
        checks.append(("AUD", "audio packets in a file without audio", F.col("pos") == 0, 54))
    return [several(p.withColumn("before", F.lag("pts_us").over(w)), checks)]


def index_rows(caus: DataFrame, index: DataFrame) -> list[DataFrame]:
    """I10: index row i against the i-th composite frame; a step in the sequence is reported once."""
    w = Window.partitionBy("path").orderBy("i")
    found = index.withColumn("before", F.lag("frame_index").over(w))
    both = found.select(F.col("i").alias("k"), F.col("frame_index").alias("i_frame"), F.col("flags").alias("i_flags"), "before", "cau_offset").join(caus.select("k", "offset", "flags"), "k", "full_outer")
    rap = lambda c: F.col(c).bitwiseAND(F.lit(RAP))
    checks = [
        ("I10", "index frames are out of sequence", (F.col("i_frame") != F.col("k")) & (F.col("i_frame") != F.coalesce(F.col("before") + 1, F.lit(-1))), 60),
        ("I10", "undefined index flags", F.col("i_flags").bitwiseAND(F.lit(254)) != 0, 61),
        ("I10", "index and composite frames differ in number", F.col("cau_offset").isNull() | F.col("offset").isNull(), 62),
        ("I10", "index offset isn't the frame's", F.col("cau_offset") != F.col("offset"), 63),
        ("I10", "index and frame differ in the access point flag", rap("i_flags") != rap("flags"), 64),
    ]
    return [several(both, checks, "k")]
