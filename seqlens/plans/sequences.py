"""Queries: sequence shaping, tracking, tubes from boxes, frame differences (A12, E, F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import change, filters, shape, smoothing, tracking, tubes
from . import adapters as A
from .boxes import iou_sql
from .greedy_sql import confident, hits_sql, steps_sql
from .registry import query, rounded


def days(spark, d):
    """Days with events as frames, indexed from 0."""
    return shape.index_frames(A.events(spark, d).groupBy("sequence_id", F.col("frame_idx").alias("day")).agg(F.min("ts").alias("ts")), "ts", "day")


DAYS = "(SELECT sequence_id, frame_idx AS day, CAST(row_number() OVER (PARTITION BY sequence_id ORDER BY min(ts), frame_idx) - 1 AS INT) AS frame_idx FROM v_event GROUP BY 1, 2)"


@query(f"SELECT sequence_id, day FROM {DAYS} WHERE frame_idx < 10")
def a12_truncated_frames(spark, d):
    rows = A.events(spark, d).select("sequence_id", "frame_idx").distinct().select("sequence_id", F.lpad(F.col("frame_idx").cast("string"), 3, "0").alias("frame_id"), F.col("frame_idx").alias("day"))
    return shape.truncate_by_name(rows, 10).select("sequence_id", "day")


@query(f"SELECT sequence_id, day, frame_idx FROM {DAYS}")
def e1_index_frames(spark, d):
    return days(spark, d).select("sequence_id", "day", "frame_idx")


@query(f"""SELECT f.sequence_id, CAST(s.slot AS INT) AS slot, f.day, s.slot - pre <> f.frame_idx AS is_padded FROM (SELECT sequence_id, n, unnest(range(greatest(n, 29))) AS slot, CASE WHEN n < 29 THEN CAST(ceil((29 - n) / 2) AS INT) ELSE 0 END AS pre FROM (SELECT sequence_id, count(*) AS n FROM {DAYS} GROUP BY 1)) s JOIN {DAYS} f ON f.sequence_id = s.sequence_id AND f.frame_idx = greatest(0, least(s.n - 1, s.slot - s.pre))""")
def e2_pad_symmetric(spark, d):
    return shape.pad_symmetric(days(spark, d), 29).select("sequence_id", "slot", "day", "is_padded")


@query(f"""SELECT sequence_id, CAST(slot AS INT) AS slot, day, row_number() OVER (PARTITION BY sequence_id, frame_idx ORDER BY slot) > 1 AS is_padded FROM (SELECT s.sequence_id, s.slot, f.day, f.frame_idx FROM (SELECT sequence_id, n, unnest(range(greatest(n, 29))) AS slot FROM (SELECT sequence_id, count(*) AS n FROM {DAYS} GROUP BY 1)) s JOIN {DAYS} f ON f.sequence_id = s.sequence_id AND f.frame_idx = CAST(floor(s.slot * s.n / greatest(s.n, 29)) AS INT))""")
def e3_pad_uniform(spark, d):
    return shape.pad_uniform(days(spark, d), 29).select("sequence_id", "slot", "day", "is_padded")


@query(f"SELECT sequence_id, least(count(*), 26) AS n_kept, greatest(count(*) - 26, 0) AS n_truncated FROM {DAYS} GROUP BY 1")
def e4_truncation(spark, d):
    return shape.truncation_counts(days(spark, d), 26)


def tracked(spark, d):
    return tracking.track(A.frames(spark, d, 0.3), 0.1, 1, 2, 0.4, 0.9)


HITS = hits_sql(confident("0.3e0"), "0.1e0", "1")
TRACKED = f"""SELECT sequence_id, track_id, n_hits, mean_confidence, first_frame, last_frame, CASE WHEN first_area > 0 THEN last_area / first_area ELSE 0e0 END AS area_ratio, reached FROM (
SELECT sequence_id, track_id, count(*) AS n_hits, avg(confidence) AS mean_confidence, min(frame_idx) AS first_frame, max(frame_idx) AS last_frame, arg_min(area, frame_idx) AS first_area, arg_max(area, frame_idx) AS last_area, min(frame_idx) FILTER (streak >= 2) AS reached FROM ({HITS}) GROUP BY 1, 2)"""


@query(f"""SELECT sequence_id, track_id, n_hits, round(mean_confidence, 6) AS mean_confidence, first_frame, last_frame, round(area_ratio, 6) AS area_ratio, coalesce(reached IS NOT NULL AND mean_confidence >= 0.4e0 AND area_ratio >= 0.9e0, false) AS confirmed,
CASE WHEN mean_confidence >= 0.4e0 AND area_ratio >= 0.9e0 THEN reached END AS confirmed_at FROM ({TRACKED})""")
def e5_tracker(spark, d):
    return rounded(tracked(spark, d).drop("filters"))


BEST = "SELECT * FROM v_det WHERE confidence >= 0.3e0 QUALIFY row_number() OVER (PARTITION BY sequence_id, frame_idx ORDER BY confidence DESC, det_idx) = 1"
RUNS = f"""SELECT *, CAST(row_number() OVER (PARTITION BY sequence_id, run_id ORDER BY frame_idx) AS INT) AS streak FROM (SELECT *, CAST(sum(starts) OVER (PARTITION BY sequence_id ORDER BY frame_idx) - 1 AS INT) AS run_id FROM (
SELECT a.*, CASE WHEN b.sequence_id IS NOT NULL AND {iou_sql('b', 'a')} >= 0.1e0 THEN 0 ELSE 1 END AS starts FROM ({BEST}) a LEFT JOIN ({BEST}) b ON a.sequence_id = b.sequence_id AND a.frame_idx = b.frame_idx + 1))"""


@query(f"SELECT sequence_id, frame_idx, det_idx, run_id, streak FROM ({RUNS})")
def e6_single_object_runs(spark, d):
    return tracking.single_object_runs(A.frames(spark, d, 0.3), 0.1).select("sequence_id", "frame_idx", "det_idx", "run_id", "streak")


@query(f"SELECT s.sequence_id, min(r.frame_idx) IS NOT NULL AS is_positive, min(r.frame_idx) AS trigger_frame_index FROM v_seq s LEFT JOIN (SELECT * FROM ({RUNS}) WHERE streak >= 3) r USING (sequence_id) GROUP BY 1")
def e6_single_object_alarms(spark, d):
    return tracking.single_object_alarms(A.frames(spark, d, 0.3), 0.1, 3, A.sequences(spark, d)).select("sequence_id", "is_positive", "trigger_frame_index")


def runs_as_hits(spark, d):
    return tracking.single_object_runs(A.frames(spark, d, 0.3), 0.1).select("sequence_id", F.col("run_id").alias("track_id"), "frame_idx", "det_idx", "streak")


FEATURES = f"SELECT sequence_id, run_id AS track_id, count(*) AS n_hits, avg(confidence) AS mean_confidence, min(frame_idx) AS first_frame, max(frame_idx) AS last_frame, arg_max(w * h, frame_idx) / arg_min(w * h, frame_idx) AS area_ratio, min(frame_idx) FILTER (streak >= 2) AS confirmed_at FROM ({RUNS}) GROUP BY 1, 2"


@query(f"SELECT sequence_id, track_id, n_hits, round(mean_confidence, 6) AS mean_confidence, first_frame, last_frame, round(area_ratio, 6) AS area_ratio FROM ({FEATURES})")
def e7_track_features(spark, d):
    return rounded(tracking.track_features(runs_as_hits(spark, d), A.detections(spark, d)))


@query(f"""SELECT sequence_id, track_id, confirmed_at IS NOT NULL AND mean_confidence >= 0.6e0 AND area_ratio >= 0.9e0 AS confirmed, CASE WHEN mean_confidence >= 0.6e0 AND area_ratio >= 0.9e0 THEN confirmed_at END AS confirmed_at, CAST(CASE WHEN confirmed_at IS NULL THEN 0 WHEN mean_confidence >= 0.6e0 THEN 2 ELSE 1 END AS INT) AS n_filters FROM ({FEATURES})""")
def e8_post_filters(spark, d):
    hits = runs_as_hits(spark, d)
    rows = tracking.track_features(hits, A.detections(spark, d)).join(tracking.confirmations(hits, 2), ["sequence_id", "track_id"], "left")
    return tracking.post_filter(rows, 0.6, 0.9).select("sequence_id", "track_id", "confirmed", "confirmed_at", F.size("filters").alias("n_filters"))


STEPS = steps_sql(confident("0.3e0"), "0.1e0", "1")
MATCHED = "list_filter(hits, lambda t: t.iou IS NOT NULL)"


@query(f"""SELECT s.sequence_id, s.frame_idx, CAST(len(hits) AS INT) AS n_detections, array_to_string(list_transform({MATCHED}, lambda t: t.id || ':' || t.det), ',') AS matches, round(coalesce(list_sum(list_transform({MATCHED}, lambda t: t.iou)), 0e0), 6) AS sum_iou,
array_to_string(fresh, ',') AS new_ids, array_to_string(missed, ',') AS missed_ids, array_to_string(list_transform(list_filter(hits, lambda t: list_contains(coalesce(ids, []), t.id)), lambda t: t.id), ',') AS confirmed_ids, array_to_string(pruned, ',') AS pruned_ids
FROM ({STEPS}) s LEFT JOIN (SELECT sequence_id, reached AS frame_idx, list(track_id) AS ids FROM ({TRACKED}) WHERE reached IS NOT NULL GROUP BY 1, 2) c ON c.sequence_id = s.sequence_id AND c.frame_idx = s.frame_idx""")
def e9_tracker_trace(spark, d):
    rows = tracking.trace(A.frames(spark, d, 0.3), 0.1, 1, 2)
    matches = F.array_join(F.transform("matches", lambda m: F.concat_ws(":", m["track_id"], m["det_idx"])), ",").alias("matches")
    overlap = F.aggregate("matches", F.lit(0.0), lambda a, m: a + m["iou"]).alias("sum_iou")
    ids = [F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("new_ids", "missed_ids", "confirmed_ids", "pruned_ids")]
    return rounded(rows.select("sequence_id", "frame_idx", "n_detections", matches, overlap, *ids))


TUBE_HITS = hits_sql(confident("0.3e0"), "0.2e0", "2")


@query(f"""SELECT c.sequence_id, c.track_id AS tube_id, CAST(c.frame_idx AS INT) AS frame_idx, t.det_idx, t.det_idx IS NULL AS is_gap, round(t.confidence, 6) AS confidence
FROM (SELECT sequence_id, track_id, unnest(range(min(frame_idx), max(frame_idx) + 1)) AS frame_idx FROM ({TUBE_HITS}) GROUP BY 1, 2) c LEFT JOIN ({TUBE_HITS}) t ON t.sequence_id = c.sequence_id AND t.track_id = c.track_id AND t.frame_idx = c.frame_idx""")
def e10_build_tubes(spark, d):
    return rounded(tubes.build(A.frames(spark, d, 0.3)).select("sequence_id", "tube_id", "frame_idx", "det_idx", "is_gap", "confidence"))


FILLED = """SELECT e.*, last_value(CASE WHEN NOT is_gap THEN frame_idx END IGNORE NULLS) OVER b AS fb, last_value(CASE WHEN NOT is_gap THEN cx END IGNORE NULLS) OVER b AS cxb, last_value(CASE WHEN NOT is_gap THEN h END IGNORE NULLS) OVER b AS hb, first_value(CASE WHEN NOT is_gap THEN frame_idx END IGNORE NULLS) OVER a AS fa, first_value(CASE WHEN NOT is_gap THEN cx END IGNORE NULLS) OVER a AS cxa, first_value(CASE WHEN NOT is_gap THEN h END IGNORE NULLS) OVER a AS ha FROM v_entry e WINDOW b AS (PARTITION BY sequence_id, tube_id ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY sequence_id, tube_id ORDER BY frame_idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"""


@query(f"""SELECT sequence_id, tube_id, frame_idx, is_gap, round(CASE WHEN is_gap THEN cxb + (frame_idx - fb) / (fa - fb) * (cxa - cxb) ELSE cx END, 6) AS cx, round(CASE WHEN is_gap THEN hb + (frame_idx - fb) / (fa - fb) * (ha - hb) ELSE h END, 6) AS h, round(CASE WHEN is_gap THEN 0e0 ELSE confidence END, 6) AS confidence FROM ({FILLED})""")
def e11_interpolate(spark, d):
    return rounded(tubes.interpolate(A.tube_entries(spark, d)).select("sequence_id", "tube_id", "frame_idx", "is_gap", "cx", "h", "confidence"))


@query("SELECT sequence_id, tube_id, start_frame, end_frame, n_observed FROM v_tube QUALIFY row_number() OVER (PARTITION BY sequence_id ORDER BY end_frame - start_frame DESC, n_observed DESC, tube_id) = 1")
def e12_longest_tube(spark, d):
    return tubes.longest(A.tubes(spark, d)).select("sequence_id", "tube_id", "start_frame", "end_frame", "n_observed")


SEEN = f"""SELECT sequence_id, track_id, frame_idx, cx, lead(frame_idx) OVER t AS next_idx, lead(cx) OVER t AS next_cx FROM ({TUBE_HITS}) WINDOW t AS (PARTITION BY sequence_id, track_id ORDER BY frame_idx)"""
# a gap's boxes lie evenly between those before and behind, so they add up to their number times the mean of both
SPANS = f"""SELECT sequence_id, track_id, max(frame_idx) - min(frame_idx) + 1 AS length, count(*) AS n_observed, sum(cx) + coalesce(sum((next_idx - frame_idx - 1) * (cx + next_cx) / 2e0), 0e0) AS sum_cx FROM ({SEEN}) GROUP BY 1, 2"""


@query(f"""SELECT sequence_id, n_frames, n_detections, n_tubes, tube_id, length, n_observed, reason, CASE WHEN reason IS NULL THEN length END AS n_entries, round(CASE WHEN reason IS NULL THEN sum_cx END, 6) AS sum_cx FROM (
SELECT f.*, n_tubes, CAST(t.track_id AS INT) AS tube_id, CAST(t.length AS INT) AS length, CAST(t.n_observed AS INT) AS n_observed, sum_cx, CASE WHEN n_detections < 2 THEN 'no_detections' WHEN n_tubes IS NULL THEN 'no_tubes' WHEN length < 4 THEN 'too_short' WHEN n_observed < 2 THEN 'too_few_observed' END AS reason
FROM (SELECT s.sequence_id, count(DISTINCT s.frame_idx) AS n_frames, count(d.det_idx) AS n_detections FROM v_slot s LEFT JOIN {confident('0.3e0')} d ON d.sequence_id = s.sequence_id AND d.frame_idx = s.frame_idx GROUP BY 1) f
LEFT JOIN (SELECT *, count(*) OVER (PARTITION BY sequence_id) AS n_tubes FROM ({SPANS}) QUALIFY row_number() OVER (PARTITION BY sequence_id ORDER BY length DESC, n_observed DESC, track_id) = 1) t ON t.sequence_id = f.sequence_id)""")
def e13_tube_dataset(spark, d):
    entries, judged = tubes.tube_dataset(A.frames(spark, d, 0.3))
    kept = entries.groupBy("sequence_id").agg(F.count("*").alias("n_entries"), F.sum("cx").alias("sum_cx"))
    return rounded(judged.join(kept, "sequence_id", "left"))


@query("""SELECT sequence_id, tube_id, frame_idx, is_gap, CAST(greatest(0, least(640, round_even(cx * 640 - side, 0))) AS INT) AS x0, CAST(greatest(0, least(480, round_even(cy * 480 - side, 0))) AS INT) AS y0, CAST(greatest(0, least(640, round_even(cx * 640 + side, 0))) AS INT) AS x1, CAST(greatest(0, least(480, round_even(cy * 480 + side, 0))) AS INT) AS y1 FROM (SELECT *, greatest(w * 1.5e0 * 640, h * 1.5e0 * 480) / 2 AS side FROM v_entry WHERE NOT is_gap)""")
def e14_model_input(spark, d):
    return shape.model_input(A.tube_entries(spark, d).where("not is_gap"), 640, 480)


@query("""SELECT t.sequence_id, t.tube_id, CAST(s AS INT) AS slot, e.frame_idx, e.frame_idx IS NOT NULL AS mask FROM v_tube t CROSS JOIN range(26) r(s) LEFT JOIN (SELECT sequence_id, tube_id, frame_idx, row_number() OVER (PARTITION BY sequence_id, tube_id ORDER BY frame_idx) - 1 AS slot FROM v_entry) e ON e.sequence_id = t.sequence_id AND e.tube_id = t.tube_id AND e.slot = s""")
def e15_slots(spark, d):
    return shape.slot_entries(A.tube_entries(spark, d), 26).select("sequence_id", "tube_id", "slot", "frame_idx", "mask")


def prefixes(spark, d):
    """Entries as prefixes; the logit of a prefix is the running mean of k, centred."""
    from pyspark.sql.window import Window

    by = Window.partitionBy("sequence_id", "tube_id").orderBy("frame_idx")
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    return A.tube_entries(spark, d).select("sequence_id", "tube_id", "frame_idx", F.row_number().over(by).alias("prefix"), ((F.sum("k").over(upto) / F.count("k").over(upto) - 50) / 5).alias("logit"))


PREFIX = "SELECT sequence_id, tube_id, frame_idx, row_number() OVER w AS prefix, (sum(k) OVER w / CAST(count(k) OVER w AS DOUBLE) - 50) / 5 AS logit FROM v_entry WINDOW w AS (PARTITION BY sequence_id, tube_id ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
CROSSED = f"SELECT sequence_id, tube_id, arg_min(frame_idx, prefix) AS crossing_frame, CAST(min(prefix) AS INT) AS prefix_length FROM ({PREFIX}) p SEMI JOIN (SELECT sequence_id, tube_id FROM ({PREFIX}) GROUP BY 1, 2 HAVING arg_max(logit, prefix) >= 0.2e0) q USING (sequence_id, tube_id) WHERE prefix >= 4 AND logit >= 0.2e0 GROUP BY 1, 2"


@query(CROSSED)
def e16_first_crossing(spark, d):
    return tubes.first_crossing(prefixes(spark, d), 4, F.col("logit") >= 0.2)[0]


@query(f"SELECT sequence_id, min(crossing_frame) AS trigger_frame_index, arg_min(tube_id, crossing_frame * 100 + tube_id) AS trigger_tube_id FROM ({CROSSED}) GROUP BY 1")
def e16_triggers(spark, d):
    return tubes.first_crossing(prefixes(spark, d), 4, F.col("logit") >= 0.2)[1]


def draw_sql(*parts: str) -> str:
    return f"(CAST('0x' || left(md5(concat_ws(':', {', '.join(parts)})), 8) AS BIGINT) / 4294967296e0)"


def chance_sql(name: str, *more: str) -> str:
    return draw_sql("7", "0", f"'{name}'", "sequence_id", "tube_id", *more)


TUBE_ORDER = "(PARTITION BY sequence_id, tube_id ORDER BY frame_idx)"
AUGMENTED = f"""WITH a AS (SELECT *, row_number() OVER {TUBE_ORDER} - 1 AS i, count(*) OVER (PARTITION BY sequence_id, tube_id) AS n FROM v_entry),
b AS (SELECT *, CAST(floor({chance_sql('start')} * (n - size + 1)) AS BIGINT) AS start FROM (SELECT *, 4 + CAST(floor({chance_sql('size')} * (n - 4 + 1)) AS BIGINT) AS size FROM a)),
c AS (SELECT sequence_id, tube_id, frame_idx, is_gap, row_number() OVER {TUBE_ORDER} - 1 AS i, count(*) OVER (PARTITION BY sequence_id, tube_id) AS n FROM b WHERE NOT ({chance_sql('sub')} < 0.5e0 AND n > 4) OR (i >= start AND i < start + size)),
d AS (SELECT sequence_id, tube_id, frame_idx, is_gap, count(*) OVER (PARTITION BY sequence_id, tube_id) AS n FROM c WHERE NOT ({chance_sql('stride')} < 0.3e0 AND n > 2) OR i % 2 = 0),
e AS (SELECT *, {chance_sql('drop', 'frame_idx')} >= 0.4e0 OR n <= 4 AS kept FROM d),
f AS (SELECT *, count(*) FILTER (kept) OVER (PARTITION BY sequence_id, tube_id) AS n_kept, row_number() OVER (PARTITION BY sequence_id, tube_id, kept ORDER BY {chance_sql('restore', 'frame_idx')}, frame_idx) AS back FROM e)
SELECT sequence_id, tube_id, frame_idx, is_gap, CAST(row_number() OVER {TUBE_ORDER} - 1 AS INT) AS slot FROM f WHERE kept OR back <= 4 - n_kept"""


@query(AUGMENTED)
def e17_augment(spark, d):
    return shape.augment(A.tube_entries(spark, d), seed=7, p_drop=0.4).select("sequence_id", "tube_id", "slot", "frame_idx", "is_gap")


@query("""SELECT label, dim, round(avg(v), 6) AS v FROM (SELECT label, generate_subscripts(embedding, 1) - 1 AS dim, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings WHERE vec_id % 3 <> 0) GROUP BY 1, 2""")
def e18_mean_pool(spark, d):
    rows = A.table(spark, d, "embeddings").withColumn("seen", F.col("vec_id") % 3 != 0).withColumn("embedding", F.col("embedding").cast("array<double>"))
    return rounded(shape.mean_pool(rows, ["label"], "embedding", "seen").select("label", F.posexplode("pooled").alias("dim", "v")))


@query("""SELECT sequence_id, frame_idx, len(list_filter(list_zip(px, p), lambda z: abs(z[1] - z[2]) > 19)) AS n_changed FROM (SELECT *, lag(px) OVER (PARTITION BY sequence_id ORDER BY frame_idx) AS p FROM v_raster) WHERE p IS NOT NULL""")
def f1_change_mask(spark, d):
    from pyspark.sql.window import Window

    rows = A.rasters(spark, d).withColumn("p", F.lag("px").over(Window.partitionBy("sequence_id").orderBy("frame_idx"))).where("p is not null")
    return rows.select("sequence_id", "frame_idx", F.size(F.filter(change.change_mask("p", "px"), lambda x: x)).cast("long").alias("n_changed"))


def ratio_sql(thresholds: list[int]) -> str:
    """Change ratios of all boxes at each pixel threshold."""
    return f"""SELECT r.sequence_id, r.frame_idx, b.cx, b.cy, b.w, b.h, b.confidence, t.threshold AS pixel_threshold,
    CASE WHEN p IS NULL THEN NULL WHEN (x1 - x0) <= 0 OR (y1 - y0) <= 0 THEN 0e0
        ELSE len(list_filter(range(64), lambda i: i % 8 >= x0 AND i % 8 < x1 AND i // 8 >= y0 AND i // 8 < y1 AND abs(px[i + 1] - p[i + 1]) > t.threshold)) / CAST((x1 - x0) * (y1 - y0) AS DOUBLE) END AS change_ratio
FROM (SELECT *, lag(px) OVER (PARTITION BY sequence_id ORDER BY frame_idx) AS p FROM v_raster) r
JOIN (SELECT *, CAST(greatest(0, trunc((cx - w / 2) * 8)) AS INT) AS x0, CAST(greatest(0, trunc((cy - h / 2) * 8)) AS INT) AS y0,
        CAST(least(8, trunc((cx + w / 2) * 8)) AS INT) AS x1, CAST(least(8, trunc((cy + h / 2) * 8)) AS INT) AS y1 FROM v_rbox) b USING (sequence_id, frame_idx)
CROSS JOIN (SELECT unnest({thresholds}) AS threshold) t"""


RATIO = ratio_sql([10, 19, 30])


@query(f"SELECT sequence_id, frame_idx, round(change_ratio, 6) AS change_ratio FROM ({RATIO}) WHERE pixel_threshold = 19")
def f2_change_ratio(spark, d):
    return rounded(change.change_ratios(A.rasters(spark, d), A.raster_boxes(spark, d), [19]).select("sequence_id", "frame_idx", "change_ratio"))


@query(f"SELECT sequence_id, frame_idx, round(change_ratio, 6) AS change_ratio FROM ({RATIO}) WHERE pixel_threshold = 19 AND change_ratio >= 0.4e0")
def f3_change_validation(spark, d):
    return rounded(change.validate(A.rasters(spark, d), A.raster_boxes(spark, d), 19, 0.4).select("sequence_id", "frame_idx", "change_ratio"))


@query(f"SELECT sequence_id, frame_idx, pixel_threshold, round(change_ratio, 6) AS change_ratio FROM ({RATIO})")
def f4_change_ratios(spark, d):
    return rounded(change.change_ratios(A.rasters(spark, d), A.raster_boxes(spark, d), [10, 19, 30]).select("sequence_id", "frame_idx", "pixel_threshold", "change_ratio"))


CHANGED = f"(SELECT b.sequence_id, b.frame_idx, 0 AS det_idx, b.cx, b.cy, b.w, b.h, b.confidence FROM v_rbox b JOIN ({RATIO}) r ON r.sequence_id = b.sequence_id AND r.frame_idx = b.frame_idx AND r.pixel_threshold = 19 WHERE r.change_ratio >= 0.3e0 AND b.confidence >= 0.1e0)"


@query(f"""SELECT s.sequence_id, s.n_before, coalesce(a.n, 0) AS n_after, coalesce(t.n_tracks, 0) AS n_tracks, t.first IS NOT NULL AS is_positive, t.first AS trigger_frame_index
FROM (SELECT sequence_id, count(*) FILTER (confidence >= 0.1e0) AS n_before FROM v_rbox GROUP BY 1) s LEFT JOIN (SELECT sequence_id, count(*) AS n FROM {CHANGED} GROUP BY 1) a USING (sequence_id)
LEFT JOIN (SELECT sequence_id, count(DISTINCT track_id) AS n_tracks, min(frame_idx) FILTER (streak >= 2) AS first FROM ({hits_sql(CHANGED, '0.1e0', '1', '(SELECT sequence_id, frame_idx FROM v_raster)')}) GROUP BY 1) t USING (sequence_id)""")
def f5_change_tracking(spark, d):
    tracks, counted = change.validated_track(A.rasters(spark, d), A.raster_boxes(spark, d), 19, 0.3, 0.1, min_iou=0.1, max_misses=1, min_consecutive=2)
    return tracking.alarms(tracks, counted).select("sequence_id", "n_before", "n_after", "n_tracks", "is_positive", "trigger_frame_index")


def smooth_sql(window: int, boxes: str = "v_det") -> str:
    return f"""SELECT sequence_id, frame_idx, max(s) AS smoothed FROM (SELECT a.sequence_id, a.frame_idx, a.det_idx, sum(b.confidence) / {window + 1}e0 AS s FROM {boxes} a JOIN {boxes} b ON a.sequence_id = b.sequence_id AND b.frame_idx BETWEEN a.frame_idx - {window - 1} AND a.frame_idx AND {iou_sql('a', 'b')} > 0 GROUP BY 1, 2, 3) GROUP BY 1, 2"""


SMOOTH = smooth_sql(4)


@query(f"SELECT sequence_id, frame_idx, round(smoothed, 6) AS smoothed FROM ({SMOOTH})")
def h2_smoothed(spark, d):
    return rounded(smoothing.smoothed(A.detections(spark, d), 4))


@query(f"SELECT s.sequence_id, min(f.frame_idx) AS trigger_frame_index, min(f.frame_idx) IS NOT NULL AS is_positive FROM v_seq s LEFT JOIN (SELECT * FROM ({SMOOTH}) WHERE smoothed > 2.5e0) f USING (sequence_id) GROUP BY 1")
def h2_smoothed_alarms(spark, d):
    return smoothing.smoothed_alarms(A.detections(spark, d), A.sequences(spark, d), 4, 2.5)


@query("SELECT s.sequence_id, s.frame_idx, count(x.det_idx) AS n FROM v_slot s LEFT JOIN (SELECT * FROM v_det WHERE confidence >= 0.5e0) x ON x.sequence_id = s.sequence_id AND x.frame_idx = s.frame_idx GROUP BY 1, 2")
def c1_filter_nested_frames(spark, d):
    rows = A.frames(spark, d).groupBy("sequence_id", "frame_idx").agg(F.collect_list(F.when(F.col("det_idx").isNotNull(), F.struct("cx", "cy", "w", "h", "confidence"))).alias("detections"))
    return filters.filter_frames(rows, 0.5).select("sequence_id", "frame_idx", F.size("detections").cast("long").alias("n"))
