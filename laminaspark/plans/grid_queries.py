"""Queries of time arithmetic, grids, joins, windows and aggregates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from laminaspark.functions import pixels
from laminaspark.functions.timegrid import Fps, frame_at_us, pts_us, round_half_up, seconds_to_frame
from laminaspark.operators import edits, grid, issues
from laminaspark.plans.base import CAUS, EV, FPS, FRAMES, GOP, KINDS, MODES, RAPS, cau_grid, cells, events, faulty, query, ranges, table
from laminaspark.plans.base import grid as dense

NTSC = Fps(30000, 1001)


@query(f"WITH {EV} SELECT event_id, CAST(CASE WHEN us <= 0 THEN 0 ELSE (30000::HUGEINT * (2 * us + 1) - 1) // (2000000::HUGEINT * 1001) END AS BIGINT) AS frame FROM ev")
def q01_frame_at_us(spark, sf):
    return events(spark, sf).select("event_id", frame_at_us(F.col("us"), NTSC).alias("frame"))


@query("SELECT o_orderkey, CAST((2::HUGEINT * o_orderkey * 1000000 * 1001 + 30000) // 60000 AS BIGINT) AS pts_us FROM orders")
def q02_pts_us(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", pts_us(F.col("o_orderkey"), NTSC).alias("pts_us"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CAST((CAST(round(l_extendedprice * 100) AS HUGEINT) * 10000 * 2 * 30000 + 1000000::HUGEINT * 1001) // (2000000::HUGEINT * 1001) AS BIGINT) AS frame FROM lineitem")
def q03_seconds_to_frame(spark, sf):
    price = F.round(F.col("l_extendedprice").cast("decimal(20,6)"), 2)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", seconds_to_frame(price, NTSC).alias("frame"))


@query("SELECT c_custkey, CAST(floor((2 * CAST(round(c_acctbal * 100) AS BIGINT) + 7) / 14.0) AS BIGINT) AS rounded FROM customer")
def q04_round_half_up(spark, sf):
    cents = F.round(F.col("c_acctbal") * 100).cast("long")
    return table(spark, sf, "customer").select("c_custkey", round_half_up(cents, 7).alias("rounded"))


@query(f"WITH {EV}, {CAUS} SELECT frame, layer_index, kind FROM caus")
def q05_layer_grid(spark, sf):
    layers = ranges(cells(spark, sf))
    return grid.layer_grid(spark, layers, FRAMES).select("frame", "layer_index", "kind")


@query(f"WITH {EV} SELECT user_id % 10 AS file, layer_index, min(frame) AS start_frame, 720::BIGINT AS end_frame FROM ev GROUP BY ALL")
def q06_active_ranges(spark, sf):
    images = events(spark, sf).withColumn("file", F.col("user_id") % 10)
    return grid.active_ranges(images, ["file", "layer_index"], FRAMES)


@query(f"WITH {EV} SELECT g.frame, g.layer_index, last_value(image IGNORE NULLS) OVER (PARTITION BY g.layer_index ORDER BY g.frame ROWS UNBOUNDED PRECEDING) AS image FROM grid g LEFT JOIN cells USING (frame, layer_index)")
def q07_sticky(spark, sf):
    both = dense(spark).join(cells(spark, sf).select("frame", "layer_index", F.col("image").alias("given")), ["frame", "layer_index"], "left")
    return grid.sticky(both, ["layer_index"], "given", "image").select("frame", "layer_index", "image")


@query(f"WITH {EV}, {CAUS} SELECT frame, layer_index FROM caus WHERE kind = 1 AND is_key")
def q08_key_frames(spark, sf):
    layers = ranges(cells(spark, sf))
    return grid.active_frames(layers).where(grid.key_frame(F.col("frame"), F.col("start_frame"), GOP)).select("frame", "layer_index")


@query(f"WITH {EV}, {CAUS}, {RAPS} SELECT frame, rap FROM raps")
def q09_rap_flag(spark, sf):
    return grid.rap_flags(faulty(spark, sf), ["frame"])


@query(f"WITH {EV}, {CAUS}, {RAPS} SELECT a.frame, coalesce(b.frame, (SELECT min(frame) FROM raps WHERE rap), 0) AS rap_frame FROM raps a ASOF LEFT JOIN (SELECT frame FROM raps WHERE rap) b ON a.frame >= b.frame")
def q10_rap_asof(spark, sf):
    flags = grid.rap_flags(faulty(spark, sf), ["frame"]).withColumn("file", F.lit(0))
    return grid.access_point(flags, ["file"], "rap").select("frame", "rap_frame")


@query(f"""WITH {EV}, {CAUS}, {RAPS}, w AS (SELECT frame, lead(frame) OVER (ORDER BY frame) AS nf FROM raps WHERE rap)
SELECT frame, CAST(coalesce(nf, 720) - frame AS BIGINT) AS gap, CASE WHEN nf IS NULL THEN 'warning' ELSE 'error' END AS severity FROM w WHERE coalesce(nf, 720) - frame > 24""")
def q11_rap_gaps_i8(spark, sf):
    raps = grid.rap_flags(faulty(spark, sf), ["frame"]).where("rap").withColumn("file", F.lit(0))
    return grid.rap_gaps(raps, ["file"], FRAMES, GOP).select("frame", "gap", "severity")


_BREAKS = """breaks AS (SELECT file, k, frame, expected, CASE WHEN frame < expected THEN 'backwards' WHEN frame = expected + 1 THEN 'gap' ELSE 'gaps' END AS kind FROM (
  SELECT l_orderkey AS file, row_number() OVER w - 1 AS k, l_linenumber::BIGINT AS frame, coalesce(lag(l_linenumber) OVER w + 1, 0)::BIGINT AS expected
  FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate)) WHERE frame <> expected)"""


def _breaks(spark, sf):
    return grid.continuity(table(spark, sf, "lineitem"), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"], "l_linenumber").withColumnRenamed("l_orderkey", "file")


@query(f"WITH {_BREAKS} SELECT * FROM breaks")
def q12_continuity_i1(spark, sf):
    return _breaks(spark, sf)


@query(f"WITH {EV} SELECT f AS frame, coalesce(string_agg(l::VARCHAR, ',' ORDER BY l) FILTER (c.frame IS NULL), '') AS missing FROM (SELECT frame AS f, layer_index AS l FROM grid) LEFT JOIN cells c ON c.frame = f AND c.layer_index = l GROUP BY f")
def q13_completeness_i2(spark, sf):
    have = events(spark, sf).groupBy("frame").agg(F.collect_set("layer_index").alias("have"))
    want = F.array(*(F.lit(i) for i in range(len(KINDS))))
    missing = F.array_sort(F.array_except(want, F.coalesce("have", F.array().cast("array<int>"))))
    return grid.frames(spark, FRAMES).join(have, "frame", "left").select("frame", F.array_join(missing, ",").alias("missing"))


@query(f"WITH {EV}, {CAUS} SELECT frame, layer_index, CASE WHEN kind = 1 THEN 'empty but active' ELSE 'frame but inactive' END AS fault FROM caus WHERE (kind = 1) <> (image IS NOT NULL OR start_frame <= frame AND frame % 5 <> 0)")
def q14_activity_i3(spark, sf):
    shown = F.col("image").isNotNull() | ((F.col("start_frame") <= F.col("frame")) & (F.col("frame") % 5 != 0))
    fault = F.when(F.col("kind") == 1, "empty but active").otherwise("frame but inactive")
    return cau_grid(spark, sf).where((F.col("kind") == 1) != shown).select("frame", "layer_index", fault.alias("fault"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS times FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def q15_duplicate_ids(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("times")).where("times > 1")


_STATS = "stats AS (SELECT layer_index, count(*) AS frames, count_if(frame % 24 = 0)::BIGINT AS keyframes, sum(bytes)::BIGINT AS color_bytes, sum(n)::BIGINT AS alpha_bytes FROM cells GROUP BY 1)"


def _stats(spark, sf):
    entries = cells(spark, sf).select("layer_index", F.lit(1).alias("kind"), (F.col("frame") % GOP == 0).alias("is_key"), F.col("bytes").alias("color_bytes"), F.col("n").alias("alpha_bytes"))
    return issues.layer_stats(entries, spark.range(len(KINDS)).select(F.col("id").cast("int").alias("layer_index")))


@query(f"WITH {EV}, {_STATS} SELECT * FROM stats")
def q16_layer_stats(spark, sf):
    return _stats(spark, sf)


@query(f"WITH {EV}, {_STATS} SELECT layer_index, CAST(round((color_bytes * 8) / (720 * 3600::DOUBLE) / 1000 * 1e9) AS BIGINT) AS nano_kbps, 720 * 3600::BIGINT AS duration_s FROM stats")
def q17_bitrate(spark, sf):
    seconds = FRAMES * FPS.den / FPS.num
    rate = F.try_divide(F.col("color_bytes") * 8, F.lit(float(seconds))) / 1000
    return _stats(spark, sf).select("layer_index", F.round(rate * 1e9).cast("long").alias("nano_kbps"), F.lit(int(seconds)).cast("long").alias("duration_s"))


_ISSUES = "issues AS (SELECT CASE kind WHEN 'gap' THEN 'I1' WHEN 'gaps' THEN 'CAU' ELSE 'I10' END AS code, CASE WHEN k % 2 = 0 THEN 'error' ELSE 'warning' END AS severity, file, k FROM breaks)"


def _issues(spark, sf):
    code = F.when(F.col("kind") == "gap", "I1").when(F.col("kind") == "gaps", "CAU").otherwise("I10")
    return _breaks(spark, sf).select(code.alias("code"), F.when(F.col("k") % 2 == 0, "error").otherwise("warning").alias("severity"), "file", "k")


@query(f"WITH {_BREAKS}, {_ISSUES} SELECT code, severity, file, k, row_number() OVER w AS n, count(*) OVER (PARTITION BY code, severity) AS total, greatest(count(*) OVER (PARTITION BY code, severity) - 25, 0) AS suppressed FROM issues WINDOW w AS (PARTITION BY code, severity ORDER BY file, k) QUALIFY row_number() OVER w <= 25")
def q18_issue_cap(spark, sf):
    found = _issues(spark, sf)
    shown = issues.capped(found, ["file", "k"]).withColumn("what", F.concat_ws("/", "code", "severity"))
    return shown.withColumn("n", F.col("n").cast("long")).join(F.broadcast(issues.suppressed(found)), "what").drop("what")  # a row a code and severity


@query(f"WITH {_BREAKS}, {_ISSUES} SELECT severity, string_agg(DISTINCT code, ',' ORDER BY code) AS codes, count(*) AS errors FROM issues GROUP BY 1")
def q19_error_codes(spark, sf):
    return issues.codes(_issues(spark, sf), ["severity"])


@query("SELECT n_nationkey, n_name, n_regionkey, row_number() OVER (ORDER BY n_nationkey) - 1 AS new_index FROM nation WHERE n_regionkey <> 2")
def q20_remap_layers(spark, sf):
    out = edits.remap(table(spark, sf, "nation"), table(spark, sf, "region").where("r_regionkey = 2").select(F.col("r_regionkey").alias("n_regionkey")), "n_regionkey", "n_nationkey")
    return out.select("n_nationkey", "n_name", "n_regionkey", F.col("new_index").cast("long").alias("new_index"))


@query("SELECT doc_id, 64 + coalesce(sum(n_chars + 20) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS cau_offset FROM documents")
def q21_cau_offsets(spark, sf):
    sized = table(spark, sf, "documents").select("doc_id", (F.col("n_chars") + 20).alias("size"))
    return grid.global_offset(sized, "doc_id", "size", "cau_offset", 64).select("doc_id", "cau_offset")


@query("SELECT page_id, coalesce(sum(strlen(html)) OVER (PARTITION BY page_id % 16 ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM pages")
def q22_resource_offsets(spark, sf):
    stills = table(spark, sf, "pages").select("page_id", (F.col("page_id") % 16).alias("file"), F.octet_length("html").alias("length"))
    return edits.resource_offsets(stills, "page_id", "length", ["file"]).select("page_id", "offset")


@query(f"WITH {EV} SELECT event_id, f AS frame FROM ev JOIN generate_series(0, 43199) t(f) ON us >= f * 60000000 AND us < (f + 1) * 60000000 WHERE us < 43200 * 60000000::BIGINT")
def q23_audio_window(spark, sf):
    packets = events(spark, sf).select("event_id", F.col("us").alias("pts_us")).where(F.col("pts_us") < 43200 * 60000000)
    return grid.audio_windows(packets, Fps(1, 60)).select("event_id", "frame")


@query("SELECT l_orderkey, l_linenumber, l_partkey, epoch_us(l_shipdate) AS us, epoch_us(p) AS previous_us FROM (SELECT *, lag(l_shipdate) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS p FROM lineitem) WHERE l_shipdate <= p")
def q24_audio_monotone(spark, sf):
    us = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("l_shipdate").cast("timestamp_ntz"))
    items = table(spark, sf, "lineitem").withColumn("us", us)
    found = grid.not_increasing(items, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "us")
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "us", F.col("previous").alias("previous_us"))


_SAMPLES = """(CASE WHEN toc >> 3 < 12 THEN [480, 960, 1920, 2880][(toc >> 3) % 4 + 1] WHEN toc >> 3 < 16 THEN [480, 960][(toc >> 3) % 2 + 1] ELSE [120, 240, 480, 960][(toc >> 3) % 4 + 1] END
  * CASE toc & 3 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 2 ELSE p_partkey % 7 + 1 END)::BIGINT"""
_PACKETS = f"packets AS (SELECT p_partkey, p_brand, {_SAMPLES} AS samples FROM (SELECT *, (p_size * 5) % 256 AS toc FROM part))"


def _packets(spark, sf):
    from laminaspark.functions.bits import opus_samples

    part = table(spark, sf, "part").withColumn("toc", (F.col("p_size") * 5 % 256).cast("int"))
    return part.select("p_partkey", "p_brand", opus_samples(F.col("toc"), (F.col("p_partkey") % 7 + 1).cast("int")).alias("samples"))


@query(f"""WITH {_PACKETS}, run AS (SELECT *, coalesce(sum(samples) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM packets)
SELECT p_partkey, samples, (2 * before * 1000000 + 48000) // 96000 AS "start", (2 * (before + samples) * 1000000 + 48000) // 96000 - (2 * before * 1000000 + 48000) // 96000 AS duration_us FROM run""")
def q25_opus_pts(spark, sf):
    return grid.opus_pts(_packets(spark, sf), "p_brand", "p_partkey", "samples").select("p_partkey", "samples", "start", "duration_us")


@query("""WITH t AS (SELECT k AS tick, k * 2700000000::BIGINT AS t_us, least((2 * (k * 2700000000::BIGINT)) // 7200000000, 719) AS shown FROM generate_series(0, 959) u(k)),
p AS (SELECT *, coalesce(lag(shown) OVER (ORDER BY tick), -1) AS before FROM t)
SELECT tick, t_us, shown, greatest(shown - before - 1, 0) AS dropped, t_us - least(before + 1, 719) * 3600000000 > 2000000 AS late_jump FROM p""")
def q26_playback_asof(spark, sf):
    ticks = spark.range(960).select(F.col("id").alias("tick"), (F.col("id") * 2_700_000_000).alias("t_us"))
    return grid.playback(ticks, FPS, FRAMES)


@query("SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY coalesce(list_position([40, 30, 20, 10]::BIGINT[], p_partkey % 50), 4611686018427387904), p_size, p_partkey) - 1 AS place FROM part")
def q27_draw_order(spark, sf):
    part = table(spark, sf, "part").withColumn("slot", F.col("p_partkey") % 50)
    explicit = F.coalesce(F.nullif(F.array_position(F.array(*(F.lit(x).cast("long") for x in (40, 30, 20, 10))), F.col("slot")), F.lit(0).cast("long")), F.lit(1 << 62).cast("long"))
    w = Window.partitionBy("p_brand").orderBy(explicit, "p_size", "p_partkey")
    return part.select("p_partkey", (F.row_number().over(w) - 1).cast("long").alias("place"))


@query("""WITH k AS (SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey DESC) AS rank FROM nation WHERE n_nationkey % 3 = 0),
b AS (SELECT n.n_nationkey, rank, row_number() OVER (PARTITION BY rank IS NOT NULL ORDER BY n.n_nationkey) AS slot, row_number() OVER (PARTITION BY rank IS NOT NULL ORDER BY rank) AS turn FROM nation n LEFT JOIN k USING (n_nationkey))
SELECT b.n_nationkey, CASE WHEN b.rank IS NULL THEN b.n_nationkey ELSE s.n_nationkey END AS merged FROM b LEFT JOIN (SELECT * FROM b WHERE rank IS NOT NULL) s ON b.turn = s.slot""")
def q28_merge_order(spark, sf):
    nation = table(spark, sf, "nation").select("n_nationkey")
    kept = nation.where("n_nationkey % 3 = 0").withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n_nationkey"))))
    return edits.merge_order(nation.withColumn("place", F.col("n_nationkey")), kept, "n_nationkey", "place").select("n_nationkey", "merged")


@query("SELECT s_suppkey, s_name, CASE WHEN n_nationkey % 4 = 0 THEN 0.25::DOUBLE ELSE 1::DOUBLE END AS opacity, CASE WHEN n_nationkey % 4 = 0 THEN n_nationkey % 8 = 0 ELSE s_acctbal > 0 END AS visible FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def q29_overrides(spark, sf):
    layers = table(spark, sf, "supplier").select("s_suppkey", "s_name", F.col("s_nationkey").alias("id"), F.lit(1.0).alias("opacity"), (F.col("s_acctbal") > 0).alias("visible"))
    user = table(spark, sf, "nation").where("n_nationkey % 4 = 0").select(F.col("n_nationkey").alias("id"), F.lit(0.25).alias("o_opacity"), (F.col("n_nationkey") % 8 == 0).alias("o_visible"))
    return edits.overrides(layers, user, "id", ["opacity", "visible"]).drop("id")


@query(f"WITH {EV} SELECT frame, layer_index, image FROM cells WHERE layer_index IN (0, 2, 3, 4) AND layer_index <> 3")
def q30_select_hide(spark, sf):
    from laminaspark.functions.scalars import resolve_layer

    named = resolve_layer(["click", "2", "view", "signup"], list(enumerate(KINDS)))
    wanted = spark.createDataFrame([(i,) for i in named], "layer_index int")
    hide = spark.createDataFrame([(resolve_layer(["signup"], list(enumerate(KINDS)))[0],)], "layer_index int")
    return edits.select_layers(cells(spark, sf), hide, "layer_index", wanted).select("frame", "layer_index", "image")


_STICKY = "sticky AS (SELECT g.frame, g.layer_index, last_value(image IGNORE NULLS) OVER (PARTITION BY g.layer_index ORDER BY g.frame ROWS UNBOUNDED PRECEDING) AS image FROM grid g LEFT JOIN cells USING (frame, layer_index))"
FOLD = """list_reduce(list({'z': layer_index, 's': s, 'a': a, 'mode': mode, 'p': 0::DOUBLE, 'b': 0::DOUBLE} ORDER BY layer_index),
  lambda x, y: {'z': y.z, 's': y.s, 'a': y.a, 'mode': y.mode,
    'p': CASE y.mode WHEN 'add' THEN least(x.p + y.a * y.s, 1::DOUBLE)
         WHEN 'multiply' THEN y.a * ((1 - x.b) * y.s + x.b * (x.p / greatest(x.b, 1e-6::DOUBLE) * y.s)) + x.p * (1 - y.a)
         WHEN 'screen' THEN y.a * ((1 - x.b) * y.s + x.b * (x.p / greatest(x.b, 1e-6::DOUBLE) + y.s - x.p / greatest(x.b, 1e-6::DOUBLE) * y.s)) + x.p * (1 - y.a)
         ELSE y.a * y.s + x.p * (1 - y.a) END,
    'b': y.a + x.b * (1 - y.a)}, {'z': -1, 's': 0::DOUBLE, 'a': 0::DOUBLE, 'mode': '', 'p': 0::DOUBLE, 'b': 1::DOUBLE})"""


@query(f"""WITH {EV}, {_STICKY}, drawn AS (SELECT frame, layer_index, least(greatest(floor(image / 2 + 0.5), 0), 255) / 255::DOUBLE AS s, 0.6::DOUBLE AS a,
  ['normal', 'add', 'multiply', 'screen', 'normal'][layer_index + 1] AS mode FROM sticky WHERE image IS NOT NULL)
SELECT frame, CAST(least(greatest(floor((f).p * 255 + 0.5), 0), 255) AS INT) AS sample FROM (SELECT frame, {FOLD} AS f FROM drawn GROUP BY frame)""")
def q31_composite_fold(spark, sf):
    """The flagship: events to frames, sticky layers, an ordered blend a frame."""
    both = dense(spark).join(cells(spark, sf).select("frame", "layer_index", F.col("image").alias("given")), ["frame", "layer_index"], "left")
    shown = grid.sticky(both, ["layer_index"], "given", "image").where("image IS NOT NULL")
    sample = F.least(F.greatest(F.floor(F.col("image") / 2 + 0.5), F.lit(0)), F.lit(255)) / F.lit(255.0)
    mode = F.element_at(F.array(*map(F.lit, MODES)), F.col("layer_index") + 1)
    layer = F.struct(F.col("layer_index").alias("z"), F.col("layer_index"), sample.alias("s"), F.lit(0.6).alias("a"), mode.alias("mode"))
    return shown.groupBy("frame").agg(F.collect_list(layer).alias("layers")).select("frame", pixels.blended_sample(F.col("layers")).alias("sample"))


@query(f"WITH {EV}, {CAUS}, {RAPS}, span AS (SELECT max(frame) AS lo FROM raps WHERE rap AND frame <= 310) SELECT c.frame, c.layer_index, c.image, c.frame >= 310 AS shown FROM caus c, span WHERE c.frame BETWEEN span.lo AND 330 AND kind = 1")
def q51_preroll(spark, sf):
    """Decode from the access point before the target, show from the target on."""
    flags = grid.rap_flags(faulty(spark, sf), ["frame"])
    lo = flags.where(F.col("rap") & (F.col("frame") <= 310)).agg(F.max("frame").alias("lo"))
    span = faulty(spark, sf).where("frame <= 330 AND kind = 1").join(F.broadcast(lo), F.col("frame") >= F.col("lo"))  # lo has one row
    return span.select("frame", "layer_index", "image", (F.col("frame") >= 310).alias("shown"))


@query(f"WITH {EV} SELECT event_id, frame, CAST(CASE WHEN event_id % 50 = 7 THEN us + 3600000000 WHEN event_id % 50 = 8 THEN us - 3600000000 ELSE us END AS BIGINT) AS us FROM ev WHERE event_id % 50 IN (7, 8)")
def q52_sync_assert(spark, sf):
    """Packets whose time contradicts the frame that carries them: those that a rule has put an hour off, and no others."""
    n, us = F.col("event_id") % 50, F.col("us")
    planted = events(spark, sf).withColumn("us", F.when(n == 7, us + 3_600_000_000).when(n == 8, us - 3_600_000_000).otherwise(us))
    return grid.outside_window(planted, FPS, "frame", "us").select("event_id", "frame", "us")


@query(f"WITH {EV} SELECT (2 * us) // 1800000000 AS frame, count(*) AS packets, min(us) AS first_us, max(us) AS last_us FROM ev WHERE us < 500 * 900000000::BIGINT GROUP BY 1")
def q53_retime_audio(spark, sf):
    packets = events(spark, sf).select(F.col("us").alias("pts_us"))
    return edits.retime_audio(packets, Fps(1, 900), 500).groupBy("frame").agg(F.count(F.lit(1)).alias("packets"), F.min("pts_us").alias("first_us"), F.max("pts_us").alias("last_us"))


@query("SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN n_name || ' (edited)' ELSE n_name END AS name, CASE WHEN n_regionkey = 1 THEN 0.5::DOUBLE ELSE 1::DOUBLE END AS opacity, CASE WHEN n_regionkey = 1 THEN 'screen' ELSE 'normal' END AS blend FROM nation")
def q54_set_layer(spark, sf):
    layers = table(spark, sf, "nation").select("n_nationkey", "n_regionkey", F.col("n_name").alias("name"), F.lit(1.0).alias("opacity"), F.lit("normal").alias("blend"))
    return edits.set_layer(layers, F.col("n_regionkey") == 1, {"name": F.concat("name", F.lit(" (edited)")), "opacity": F.lit(0.5), "blend": F.lit("screen")}).drop("n_regionkey")


@query("SELECT p.*, row_number() OVER (ORDER BY part, position) - 1 AS layer_index FROM (SELECT 0 AS part, n_nationkey AS position, n_name AS name FROM nation UNION ALL SELECT 1, r_regionkey, r_name FROM region) p")
def q49_append_layers(spark, sf):
    a = table(spark, sf, "nation").select(F.col("n_nationkey").alias("position"), F.col("n_name").alias("name"))
    b = table(spark, sf, "region").select(F.col("r_regionkey").alias("position"), F.col("r_name").alias("name"))
    out = edits.append([a, b])
    return out.select("part", "position", "name", F.col("layer_index").cast("long").alias("layer_index"))


@query(f"WITH {EV} SELECT user_id, event_id, us - p AS silence FROM (SELECT *, lag(us) OVER (PARTITION BY user_id ORDER BY us) AS p FROM ev) WHERE p IS NULL OR us - p >= 21600000000")
def q50_onsets(spark, sf):
    return grid.onsets(events(spark, sf), "user_id", "us", 21_600_000_000).select("user_id", "event_id", "silence")


@query(f"""WITH {EV}, {CAUS}, {RAPS}, actual AS (SELECT frame, CASE WHEN frame = 200 THEN 201 ELSE frame END AS claimed, rap FROM raps WHERE frame <> 400),
i1 AS (SELECT 'I1' AS code, k AS frame FROM (SELECT row_number() OVER (ORDER BY frame) - 1 AS k, claimed, coalesce(lag(claimed) OVER (ORDER BY frame) + 1, 0) AS e FROM actual) WHERE claimed <> e),
want AS (SELECT frame, frame % 24 = 0 AS rap FROM raps)
SELECT code, frame FROM i1 UNION ALL SELECT 'I1', NULL FROM (SELECT count(*) AS n FROM actual) WHERE n <> 720
UNION ALL SELECT 'I3', frame FROM caus WHERE kind = 1 AND image IS NULL
UNION ALL SELECT 'I6', r.frame FROM raps r JOIN want w USING (frame) WHERE r.rap <> w.rap
UNION ALL SELECT 'I7', frame FROM raps WHERE frame = 0 AND NOT rap
UNION ALL SELECT 'I8', frame FROM (SELECT frame, lead(frame) OVER (ORDER BY frame) AS nf FROM raps WHERE rap) WHERE nf - frame > 24
UNION ALL SELECT 'I10', frame FROM (SELECT frame, place, CASE WHEN frame % 100 = 50 THEN place + 4 WHEN frame % 240 = 7 THEN place - least(place, 64) ELSE place END AS claimed
  FROM (SELECT frame, 64 + coalesce(sum(20 + coalesce(bytes, 0)) OVER (ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM (SELECT frame, sum(bytes) AS bytes FROM caus GROUP BY 1))) WHERE claimed <> place""")
def q56_validate_all(spark, sf):
    """The grid's rules over a table with deterministic faults, as one issues table."""
    caus, flags = faulty(spark, sf), grid.rap_flags(faulty(spark, sf), ["frame"])
    actual = flags.where("frame <> 400").withColumn("claimed", F.when(F.col("frame") == 200, 201).otherwise(F.col("frame"))).withColumn("file", F.lit(0))
    i1 = grid.continuity(actual, "file", ["frame"], "claimed").select(F.lit("I1").alias("code"), F.col("k").alias("frame"))
    count = actual.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") != FRAMES).select(F.lit("I1").alias("code"), F.lit(None).cast("long").alias("frame"))
    i3 = caus.where("kind = 1 AND image IS NULL").select(F.lit("I3").alias("code"), "frame")
    i6 = flags.where(F.col("rap") != (F.col("frame") % GOP == 0)).select(F.lit("I6").alias("code"), "frame")
    i7 = flags.where("frame = 0 AND NOT rap").select(F.lit("I7").alias("code"), "frame")
    i8 = grid.rap_gaps(flags.where("rap").withColumn("file", F.lit(0)), ["file"], FRAMES, GOP).where("severity = 'error'").select(F.lit("I8").alias("code"), "frame")
    sized = caus.groupBy("frame").agg((F.coalesce(F.sum("bytes"), F.lit(0)) + 20).alias("size"))
    placed = grid.global_offset(sized, "frame", "size", "at", 64).select("frame", "at")
    claimed = placed.select("frame", F.when(F.col("frame") % 100 == 50, F.col("at") + 4).when(F.col("frame") % 240 == 7, F.col("at") - F.least("at", F.lit(64))).otherwise(F.col("at")).alias("claimed"))
    i10 = edits.positional_match(placed, claimed, ["frame"]).where(~F.col("at").eqNullSafe(F.col("claimed"))).select(F.lit("I10").alias("code"), "frame")
    out = i1
    for part in (count, i3, i6, i7, i8, i10):
        out = out.unionByName(part)
    return out


@query(f"WITH {EV}, {CAUS} SELECT frame, layer_index, kind = 1 AS is_frame, is_key AND kind = 1 AS is_key, coalesce(image, 0) AS image, (64 + layer_index) + (64 + layer_index) % 2 AS coded_width FROM caus WHERE layer_index <> 4")
def q61_layer_predicates(spark, sf):
    width = F.lit(64) + F.col("layer_index")
    video = cau_grid(spark, sf).where("layer_index <> 4")
    return video.select("frame", "layer_index", (F.col("kind") == 1).alias("is_frame"), (F.col("is_key") & (F.col("kind") == 1)).alias("is_key"), F.coalesce("image", F.lit(0.0)).alias("image"), (width + width % 2).alias("coded_width"))


@query(f"WITH {EV}, c AS (SELECT c.* FROM cells c JOIN ranges r USING (layer_index) WHERE c.frame >= greatest(100, r.start_frame) AND c.frame < least(260, r.end_frame)) SELECT frame, string_agg(layer_index || ':' || CAST(floor(image * 100 + 0.5) AS BIGINT), ',' ORDER BY layer_index) AS planes FROM c GROUP BY 1")
def q62_layer_frames(spark, sf):
    images = cells(spark, sf)
    inside = images.join(F.broadcast(ranges(images)), "layer_index").where((F.col("frame") >= F.greatest(F.lit(100), "start_frame")) & (F.col("frame") < F.least(F.lit(260), "end_frame")))
    plane = F.struct("layer_index", F.floor(F.col("image") * 100 + 0.5).alias("v"))
    texts = F.transform(F.array_sort(F.collect_list(plane)), lambda x: F.concat_ws(":", x["layer_index"], x["v"]))
    return inside.groupBy("frame").agg(F.array_join(texts, ",").alias("planes"))


@query(f"WITH {EV} SELECT frame, layer_index, image, ['click', 'error', 'purchase', 'signup', 'view'][layer_index + 1] AS id, layer_index * 100 AS resource_offset FROM cells")
def q64_entry_layer_join(spark, sf):
    layers = spark.createDataFrame([(i, k, i * 100) for i, k in enumerate(KINDS)], "layer_index int, id string, resource_offset int")
    return cells(spark, sf).join(F.broadcast(layers), "layer_index").select("frame", "layer_index", "image", "id", "resource_offset")


@query("""WITH a AS (SELECT l_orderkey AS file, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos, l_linenumber AS found FROM lineitem),
e AS (SELECT o_orderkey AS file, k AS pos, k::INT AS wanted FROM orders, generate_series(1, 4) t(k))
SELECT coalesce(a.file, e.file) AS file, coalesce(a.pos, e.pos) AS pos, found, wanted FROM a FULL JOIN e ON a.file = e.file AND a.pos = e.pos WHERE found IS DISTINCT FROM wanted""")
def q65_index_vs_actual(spark, sf):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    actual = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("file"), F.row_number().over(w).cast("long").alias("pos"), F.col("l_linenumber").alias("found"))
    index = table(spark, sf, "orders").select(F.col("o_orderkey").alias("file"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(4).cast("long"))).alias("pos")).withColumn("wanted", F.col("pos").cast("int"))
    return edits.positional_match(actual, index, ["file", "pos"]).where(~F.col("found").eqNullSafe(F.col("wanted")))


@query(f"WITH {EV}, {CAUS}, {RAPS} SELECT (SELECT count(*) FROM ev) AS packets, (SELECT sum(length(props)) FROM ev)::BIGINT AS bytes, (SELECT count(*) FROM raps) AS caus, (SELECT string_agg(frame::VARCHAR, ',' ORDER BY frame) FROM raps WHERE rap) AS rap_frames, (SELECT greatest(-1, max(layer_index)) FROM cells)::INT AS top_z")
def q66_report_totals(spark, sf):
    audio = events(spark, sf).agg(F.count(F.lit(1)).alias("packets"), F.sum(F.char_length("props")).alias("bytes"), F.greatest(F.lit(-1), F.max("layer_index")).alias("top_z"))
    flags = grid.rap_flags(faulty(spark, sf), ["frame"])
    raps = F.array_sort(F.collect_list(F.when(F.col("rap"), F.col("frame"))))
    totals = flags.agg(F.count(F.lit(1)).alias("caus"), F.array_join(F.transform(raps, lambda x: x.cast("string")), ",").alias("rap_frames"))
    return audio.crossJoin(totals).select("packets", "bytes", "caus", "rap_frames", "top_z")  # one row each


@query(f"WITH {_PACKETS} SELECT p_partkey, CASE WHEN lead(p_partkey) OVER w IS NULL THEN greatest(samples - 312, 0) ELSE samples END AS samples FROM packets WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey)")
def q68_trim_last_packet(spark, sf):
    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    last = F.lead("p_partkey").over(w).isNull()
    return _packets(spark, sf).select("p_partkey", F.when(last, F.greatest(F.col("samples") - 312, F.lit(0).cast("long"))).otherwise(F.col("samples")).alias("samples"))


@query(f"WITH {EV}, done AS (SELECT f AS frame, count(c.frame) = 5 AS complete FROM generate_series(0, 719) t(f) LEFT JOIN cells c ON c.frame = f GROUP BY f) SELECT frame // 24 AS day, frame, bool_and(complete) OVER (PARTITION BY frame // 24 ORDER BY frame) AS released FROM done")
def q69_release_in_order(spark, sf):
    have = cells(spark, sf).groupBy("frame").agg(F.count(F.lit(1)).alias("n"))
    state = grid.frames(spark, FRAMES).join(have, "frame", "left").select(F.expr("frame div 24").alias("day"), "frame", (F.coalesce("n", F.lit(0)) == len(KINDS)).alias("complete"))
    return grid.released(state, ["day"]).select("day", "frame", "released")


@query("""WITH o AS (SELECT n_regionkey, list(n_nationkey ORDER BY n_nationkey) AS ks FROM nation GROUP BY 1), m AS (SELECT n_regionkey, ks, ks[1] AS item, list_filter(ks, lambda x: x <> ks[1]) AS rest FROM o)
SELECT n_regionkey, array_to_string(list_concat(list_concat(rest[:2], [item]), rest[3:]), ',') AS moved, array_to_string(list_sort(list_distinct(list_transform(ks, lambda x: x % 3))), ',') AS wanted, array_to_string(ks[:3], ',') || CASE WHEN len(ks) > 3 THEN ' (+' || (len(ks) - 3) || ' more)' ELSE '' END AS first_ones,
  list_sort(list_transform(ks, lambda x: (x // 5))) = range(0, len(ks)) AS permutation FROM m""")
def q70_order_utils(spark, sf):
    lists = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_nationkey")).alias("ks"))
    text = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ",")
    ks = F.col("ks")
    more = F.when(F.size(ks) > 3, F.concat(F.lit(" (+"), (F.size(ks) - 3).cast("string"), F.lit(" more)"))).otherwise(F.lit(""))
    places = F.transform(ks, lambda x: F.floor(x / 5).cast("int"))
    return lists.select("n_regionkey", text(edits.move_to(ks, ks[0], F.lit(2))).alias("moved"), text(F.array_sort(F.array_distinct(F.transform(ks, lambda x: x % 3)))).alias("wanted"), F.concat(text(F.slice(ks, 1, 3)), more).alias("first_ones"), edits.is_permutation(places).alias("permutation"))


@query(f"""WITH {EV}, {CAUS}, {RAPS}, t AS (SELECT event_id, user_id % 5 AS epoch, frame AS target, (frame * 7 + event_id) % 720 AS current, us FROM ev),
r AS (SELECT a.frame, coalesce(b.frame, 0) AS rap_frame FROM raps a ASOF LEFT JOIN (SELECT frame FROM raps WHERE rap) b ON a.frame >= b.frame)
SELECT event_id, target > current AND (rap_frame <= current OR target - current <= 8) AS soft, us + 20000 >= 1296000000000 - 1000000 AS kept, us - (2 * 312 * 1000000 + 48000) // 96000 AS pts_us FROM t JOIN r ON r.frame = t.target WHERE epoch = 3""")
def q75_seek_rules(spark, sf):
    """Outputs of the current epoch: soft or hard seek, audio before the horizon, and the pre-skip taken off."""
    flags = grid.access_point(grid.rap_flags(faulty(spark, sf), ["frame"]).withColumn("file", F.lit(0)), ["file"], "rap").select(F.col("frame").alias("target"), "rap_frame")
    out = events(spark, sf).where(F.col("user_id") % 5 == 3).select("event_id", F.col("frame").alias("target"), ((F.col("frame") * 7 + F.col("event_id")) % FRAMES).alias("current"), "us")
    soft = edits.can_soft_seek(F.col("current"), F.col("target"), F.col("rap_frame"), F.lit(False))
    skip = round_half_up(F.lit(312 * 1_000_000).cast("long"), 48_000)
    return out.join(F.broadcast(flags), "target").select("event_id", soft.alias("soft"), (F.col("us") + 20_000 >= 1_296_000_000_000 - 1_000_000).alias("kept"), (F.col("us") - skip).alias("pts_us"))  # flags: a row a frame


@query(f"""WITH {EV}, {CAUS}, kept AS (SELECT frame, layer_index, kind, is_key FROM caus WHERE layer_index <> 1 UNION ALL
  SELECT f, 5, CASE WHEN f >= 30 AND f < 600 THEN 1 ELSE 0 END, f = 30 OR f % 24 = 0 FROM generate_series(0, 719) t(f)),
n AS (SELECT *, dense_rank() OVER (ORDER BY layer_index) - 1 AS new_index FROM kept)
SELECT frame, coalesce(bool_and(is_key) FILTER (kind = 1), true) AS rap, string_agg(new_index || ':' || kind, ',' ORDER BY new_index) AS entries FROM n GROUP BY frame""")
def q76_remux(spark, sf):
    """A layer removed, one appended with keys at its start and on the file's access points, indices and flags anew."""
    caus = cau_grid(spark, sf).select("frame", "layer_index", "kind", "is_key")
    layers = spark.range(len(KINDS)).select(F.col("id").cast("int").alias("layer_index"))
    gone = spark.createDataFrame([(1,)], "layer_index int")
    added = grid.frames(spark, FRAMES).select("frame", F.lit(5).alias("layer_index"), grid.active(F.col("frame"), F.lit(30), F.lit(600)).cast("int").alias("kind"), grid.key_frame(F.col("frame"), F.lit(30), GOP).alias("is_key"))
    names = edits.remap(layers.unionByName(added.select("layer_index").limit(1)), gone, "layer_index", "layer_index")
    entries = caus.unionByName(added).join(F.broadcast(names), "layer_index")  # a row a layer
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("new_index", "kind"))), lambda x: F.concat_ws(":", x["new_index"], x["kind"])), ",")
    flag = F.coalesce(F.every(F.when(F.col("kind") == 1, F.col("is_key"))), F.lit(True))
    return entries.groupBy("frame").agg(flag.alias("rap"), listed.alias("entries"))


@query(f"""WITH {EV}, t AS (SELECT user_id, us, least(frame, 599) AS f, coalesce(lag(least(frame, 599)) OVER (PARTITION BY user_id ORDER BY us, event_id), -1) AS before FROM ev)
SELECT user_id, count(*) FILTER (f <> before) AS shown, count(*) FILTER (f = before) AS held, CAST(sum(greatest(f - before - 1, 0)) AS BIGINT) AS dropped, count(*) FILTER (us - least(before + 1, 599) * 3600000000 > 2000000) AS late_jumps
FROM t GROUP BY user_id""")
def q78_playback_counters(spark, sf):
    """Each user's events as clock ticks over a file that ends before the last of them."""
    return grid.playback_counters(events(spark, sf), ["user_id"], "us", FPS, 600)
