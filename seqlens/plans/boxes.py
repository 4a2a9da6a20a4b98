"""Queries: projections, filters, label text, joins of boxes (A4-A5, B, C, D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry, scalar
from ..operators import filters, joins
from ..sources import files
from . import adapters as A
from .greedy_sql import greedy_sql, iou_sql, judged_sql
from .registry import query, rounded

@query("""SELECT event_id, class_id, round(cx, 6) AS cx, round(cy, 6) AS cy, round(w, 6) AS w, round(h, 6) AS h, round(confidence, 6) AS confidence FROM (
SELECT event_id, TRY_CAST(p[1] AS INT) AS class_id, TRY_CAST(p[2] AS DOUBLE) AS cx, TRY_CAST(p[3] AS DOUBLE) AS cy, TRY_CAST(p[4] AS DOUBLE) AS w, TRY_CAST(p[5] AS DOUBLE) AS h, CASE WHEN len(p) = 6 THEN TRY_CAST(p[6] AS DOUBLE) ELSE 1e0 END AS confidence, p
FROM (SELECT event_id, string_split(line, ' ') AS p FROM v_line)) WHERE len(p) IN (5, 6) AND regexp_matches(p[1], '^[0-9]+$') AND cx IS NOT NULL AND cy IS NOT NULL AND w IS NOT NULL AND h IS NOT NULL AND confidence IS NOT NULL""")
def a4_parse_labels(spark, d):
    return rounded(files.parse_labels(A.lines(spark, d)).select("event_id", "class_id", "cx", "cy", "w", "h", "confidence"))


@query("""SELECT event_id, CAST(TRY_CAST(p[1] AS DOUBLE) AS INT) AS class_id, round(TRY_CAST(p[2] AS DOUBLE), 6) AS cx, round(TRY_CAST(p[5] AS DOUBLE), 6) AS h FROM (SELECT event_id, string_split(line, ' ') AS p FROM v_line) WHERE len(p) >= 5 AND TRY_CAST(p[1] AS DOUBLE) IS NOT NULL""")
def a4_parse_labels_lenient(spark, d):
    return rounded(files.parse_labels(A.lines(spark, d), "lenient").select("event_id", "class_id", "cx", "h"))


@query("""SELECT sequence_id, stem, bool_and(len(string_split(line, ' ')) = 5) AS is_human, count(*) AS n_lines FROM v_line GROUP BY 1, 2""")
def a5_provenance(spark, d):
    return files.provenance(A.lines(spark, d), ["sequence_id", "stem"])


@query("""SELECT sequence_id, coalesce(CASE WHEN sequence_id % 3 = 0 THEN sequence_id % 2 = 0 END, arg_min(is_human, stem), false) AS is_positive_gt FROM (SELECT sequence_id, stem, bool_and(len(string_split(line, ' ')) = 5) AS is_human FROM v_line GROUP BY 1, 2) GROUP BY 1""")
def a5_sequence_truth(spark, d):
    known = A.sequences(spark, d).withColumn("label", F.when(F.col("sequence_id") % 3 == 0, F.col("sequence_id") % 2 == 0))
    return files.sequence_truth(known, files.provenance(A.lines(spark, d), ["sequence_id", "stem"]))


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS parsed FROM v_event""")
def b1_frame_time(spark, d):
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH-mm-ss")
    frame = F.concat(F.lit("cam_"), stamp, F.when(F.col("event_id") % 5 == 0, "_x").otherwise(""))
    return A.events(spark, d).select("event_id", F.date_format(scalar.frame_time(frame), "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@query(f"""SELECT a.sequence_id, a.frame_idx, a.det_idx AS i, b.det_idx AS j, round({iou_sql('a', 'b')}, 6) AS iou FROM v_det a JOIN v_det b ON a.sequence_id = b.sequence_id AND a.frame_idx = b.frame_idx AND a.det_idx < b.det_idx""")
def b2_iou(spark, d):
    one = A.detections(spark, d).select("sequence_id", "frame_idx", F.col("det_idx").alias("i"), "cx", "cy", "w", "h")
    two = one.select("sequence_id", "frame_idx", F.col("i").alias("j"), *[F.col(c).alias(f"o_{c}") for c in ("cx", "cy", "w", "h")])
    return rounded(one.join(two, ["sequence_id", "frame_idx"]).where("i < j").select("sequence_id", "frame_idx", "i", "j", geometry.iou(geometry.box(), geometry.box("o_")).alias("iou")))


@query("""SELECT sequence_id, frame_idx, det_idx, round(cx - w / 2, 6) AS x1, round(cy - h / 2, 6) AS y1, round(cx + w / 2, 6) AS x2, round(cy + h / 2, 6) AS y2 FROM v_det""")
def b3_box_corners(spark, d):
    return rounded(A.detections(spark, d).select("sequence_id", "frame_idx", "det_idx", *[c.alias(n) for c, n in zip(geometry.corners(*geometry.box()), ("x1", "y1", "x2", "y2"))]))


@query("""SELECT sequence_id, round(arg_min(w * h, frame_idx * 100 + det_idx), 6) AS first_area, round(arg_max(w * h, frame_idx * 100 + det_idx) / arg_min(w * h, frame_idx * 100 + det_idx), 6) AS area_ratio FROM v_det GROUP BY 1""")
def b4_area_ratio(spark, d):
    at = F.col("frame_idx") * 100 + F.col("det_idx")
    found = A.detections(spark, d).groupBy("sequence_id").agg(F.min_by(geometry.area("w", "h"), at).alias("first_area"), F.max_by(geometry.area("w", "h"), at).alias("last"))
    return rounded(found.select("sequence_id", "first_area", geometry.area_ratio("first_area", "last").alias("area_ratio")))


@query("""SELECT sequence_id, frame_idx, det_idx, round(w * 1.5e0, 6) AS w, round(h * 1.5e0, 6) AS h FROM v_det""")
def b5_expand(spark, d):
    w, h = geometry.expand("w", "h", 1.5)
    return rounded(A.detections(spark, d).select("sequence_id", "frame_idx", "det_idx", w.alias("w"), h.alias("h")))


@query("""SELECT sequence_id, frame_idx, det_idx, CAST(greatest(0, least(640, round_even(cx * 640 - side, 0))) AS INT) AS x0, CAST(greatest(0, least(480, round_even(cy * 480 - side, 0))) AS INT) AS y0, CAST(greatest(0, least(640, round_even(cx * 640 + side, 0))) AS INT) AS x1, CAST(greatest(0, least(480, round_even(cy * 480 + side, 0))) AS INT) AS y1 FROM (SELECT *, greatest(w * 640, h * 480) / 2 AS side FROM v_det)""")
def b6_pixel_square(spark, d):
    return A.detections(spark, d).select("sequence_id", "frame_idx", "det_idx", *[c.alias(n) for c, n in zip(geometry.pixel_square("cx", "cy", "w", "h", 640, 480), ("x0", "y0", "x1", "y1"))])


@query("""SELECT sequence_id, frame_idx, det_idx, CAST(greatest(0, least(64, trunc((cx - w / 2) * 64))) AS INT) AS x0, CAST(greatest(0, least(48, trunc((cy - h / 2) * 48))) AS INT) AS y0, CAST(greatest(0, least(64, trunc((cx + w / 2) * 64))) AS INT) AS x1, CAST(greatest(0, least(48, trunc((cy + h / 2) * 48))) AS INT) AS y1 FROM v_det""")
def b7_pixel_rectangle(spark, d):
    return A.detections(spark, d).select("sequence_id", "frame_idx", "det_idx", *[c.alias(n) for c, n in zip(geometry.pixel_rectangle("cx", "cy", "w", "h", 64, 48), ("x0", "y0", "x1", "y1"))])


@query("""SELECT variant, sample_id, round(ln(prob / (1 - prob)), 6) AS logit, round(1 / (1 + exp(-(prob * 4 - 2))), 6) AS p FROM v_scored WHERE prob > 0""")
def b8_logit(spark, d):
    return rounded(A.scored(spark, d).where("prob > 0").select("variant", "sample_id", scalar.logit("prob").alias("logit"), scalar.sigmoid(F.col("prob") * 4 - 2).alias("p")))


@query("""SELECT sequence_id, tube_id, round(1 / (1 + exp(-(-3e0 + 0.7e0 * logit + 1.2e0 * ln(1 + end_frame - start_frame + 1) + 0.05e0 * n_observed))), 6) AS p FROM v_tube""")
def b9_calibrated(spark, d):
    features = [F.col("logit"), F.log1p(F.col("end_frame") - F.col("start_frame") + 1), F.col("n_observed")]
    return rounded(A.tubes(spark, d).select("sequence_id", "tube_id", scalar.calibrated(features, [0.7, 1.2, 0.05], -3.0).alias("p")))


@query("""SELECT model_name, sequence_id, CASE WHEN is_positive_gt AND is_positive THEN 'TP' WHEN is_positive THEN 'FP' WHEN is_positive_gt THEN 'FN' ELSE 'TN' END AS outcome, CASE WHEN is_positive AND NOT is_positive_gt THEN 'false_positive' WHEN is_positive_gt AND NOT is_positive THEN 'false_negative' END AS error FROM v_result""")
def b10_outcome(spark, d):
    return A.results(spark, d).select("model_name", "sequence_id", scalar.outcome("is_positive_gt", "is_positive").alias("outcome"), scalar.error_kind("is_positive_gt", "is_positive").alias("error"))


@query("""SELECT s.sequence_id, round(coalesce(max(t.logit), -1e9), 6) AS score FROM v_seq s LEFT JOIN v_tube t USING (sequence_id) GROUP BY 1""")
def b11_sequence_score(spark, d):
    lists = A.tubes(spark, d).groupBy("sequence_id").agg(F.collect_list("logit").alias("logits"))
    return rounded(A.sequences(spark, d).join(lists, "sequence_id", "left").select("sequence_id", scalar.sequence_score("logits", -1e9).alias("score")))


@query("""SELECT model_name, sequence_id, CASE WHEN is_positive_gt AND is_positive THEN trigger_frame_index END AS ttd FROM v_result""")
def b12_ttd(spark, d):
    return A.results(spark, d).select("model_name", "sequence_id", scalar.ttd("is_positive_gt", "is_positive", "trigger_frame_index").alias("ttd"))


@query("""SELECT model_name, round_even(coalesce(count(*) FILTER (is_positive) * 100e0 / nullif(count(*), 0), 0), 2) AS positive_pct FROM v_result GROUP BY 1""")
def b13_rates(spark, d):
    found = A.results(spark, d).groupBy("model_name").agg(F.count_if("is_positive").alias("p"), F.count("*").alias("n"))
    return found.select("model_name", scalar.percent("p", "n").alias("positive_pct"))


@query("""SELECT s.sequence_id, s.frame_idx, count(x.det_idx) AS n FROM v_slot s LEFT JOIN (SELECT * FROM v_det WHERE confidence >= 0.3e0 AND w * h <= 0.02e0) x ON x.sequence_id = s.sequence_id AND x.frame_idx = s.frame_idx GROUP BY 1, 2""")
def c1_filter_detections(spark, d):
    kept = filters.filter_detections(A.detections(spark, d), 0.3, 0.02)
    return A.slots(spark, d).join(kept, ["sequence_id", "frame_idx"], "left").groupBy("sequence_id", "frame_idx").agg(F.count("det_idx").alias("n"))


@query("""SELECT sequence_id, count(*) AS n FROM v_event WHERE starts_with(event_type, 'p') GROUP BY 1""")
def c2_prefix(spark, d):
    return filters.with_prefix(A.events(spark, d), "p", "event_type").groupBy("sequence_id").agg(F.count("*").alias("n"))


@query("""SELECT sequence_id, tube_id FROM v_tube WHERE end_frame - start_frame + 1 >= 25 AND n_observed >= 13""")
def c3_tube_filter(spark, d):
    return filters.long_tubes(A.tubes(spark, d), 25, 13).select("sequence_id", "tube_id")


@query("""SELECT sequence_id, CASE WHEN sequence_id % 11 = 0 THEN 'no_labels_dir' WHEN n_frames = 0 THEN 'no_frames' WHEN n_detections < 12 THEN 'no_detections' WHEN n_tubes = 0 THEN 'no_tubes' WHEN length < 28 THEN 'too_short' WHEN n_observed < 12 THEN 'too_few_observed' END AS reason FROM (
SELECT e.sequence_id, count(DISTINCT e.frame_idx) AS n_frames, count(*) AS n_detections, any_value(coalesce(t.n_tubes, 0)) AS n_tubes, any_value(t.length) AS length, any_value(t.n_observed) AS n_observed FROM v_event e LEFT JOIN (SELECT sequence_id, count(*) AS n_tubes, arg_max(end_frame - start_frame + 1, (end_frame - start_frame) * 10000 + n_observed * 10 - tube_id) AS length, arg_max(n_observed, (end_frame - start_frame) * 10000 + n_observed * 10 - tube_id) AS n_observed FROM v_tube GROUP BY 1) t USING (sequence_id) GROUP BY 1)""")
def c4_drop_reason(spark, d):
    from ..operators import tubes

    stats = A.events(spark, d).groupBy("sequence_id").agg(F.count_distinct("frame_idx").alias("n_frames"), F.count("*").alias("n_detections"))
    all_tubes = A.tubes(spark, d)
    chosen = tubes.longest(all_tubes).withColumn("length", F.col("end_frame") - F.col("start_frame") + 1)
    rows = stats.join(all_tubes.groupBy("sequence_id").agg(F.count("*").alias("n_tubes")), "sequence_id", "left").join(chosen, "sequence_id", "left")
    return rows.select("sequence_id", filters.drop_reason(F.col("sequence_id") % 11 != 0, "n_frames", "n_detections", "n_tubes", "length", "n_observed", 28, 12).alias("reason"))


@query("""SELECT model_name, sequence_id, kind, nth FROM (SELECT *, CAST(row_number() OVER (PARTITION BY kind ORDER BY model_name, sequence_id) AS INT) AS nth FROM (SELECT model_name, sequence_id, CASE WHEN is_positive THEN 'false_positive' ELSE 'false_negative' END AS kind FROM v_result WHERE is_positive <> is_positive_gt)) WHERE nth <= 40""")
def c7_first_errors(spark, d):
    return filters.first_errors(A.results(spark, d), 40, ["model_name", "sequence_id"]).select("model_name", "sequence_id", "kind", "nth")


@query("""SELECT p.model_name, p.sequence_id, p.is_positive, coalesce(g.is_positive_gt, false) AS is_positive_gt FROM v_pred p LEFT JOIN (SELECT * FROM v_gt WHERE sequence_id % 7 <> 0) g USING (sequence_id)""")
def d1_truth_left(spark, d):
    known = A.truth(spark, d).where("sequence_id % 7 <> 0")
    return joins.attach_truth(A.predictions(spark, d), known).select("model_name", "sequence_id", "is_positive", "is_positive_gt")


@query("""SELECT sequence_id, 'kept' AS fate, count(*) AS n FROM v_pred WHERE sequence_id % 7 <> 0 GROUP BY 1 UNION ALL SELECT DISTINCT sequence_id, 'skipped', 1 FROM v_pred WHERE sequence_id % 7 = 0""")
def d2_truth_inner(spark, d):
    kept, skipped = joins.attach_known_truth(A.predictions(spark, d), A.truth(spark, d).where("sequence_id % 7 <> 0"))
    counted = kept.groupBy("sequence_id").agg(F.count("*").alias("n")).select("sequence_id", F.lit("kept").alias("fate"), "n")
    return counted.unionByName(skipped.select("sequence_id", F.lit("skipped").alias("fate"), F.lit(1).cast("long").alias("n")))


PAIRS = f"SELECT a.sequence_id, b.frame_idx, a.det_idx AS prev_idx, b.det_idx, {iou_sql('a', 'b')} AS iou FROM v_det a JOIN v_det b ON a.sequence_id = b.sequence_id AND b.frame_idx = a.frame_idx + 1 AND a.confidence >= 0.3e0 AND b.confidence >= 0.3e0"


@query(f"""SELECT sequence_id, frame_idx, prev_idx, det_idx, round(iou, 6) AS iou FROM ({PAIRS}) WHERE iou >= 0.1e0""")
def d3_consecutive_pairs(spark, d):
    return rounded(joins.consecutive_pairs(filters.filter_detections(A.detections(spark, d), 0.3), 0.1))


MATCHES = f"SELECT sequence_id, frame_idx, unnest(CASE WHEN true THEN {greedy_sql('pairs')} END) AS m FROM (SELECT sequence_id, frame_idx, list({{'minus': -iou, 'i': prev_idx, 'j': det_idx}}) AS pairs FROM ({PAIRS}) WHERE iou >= 0.1e0 GROUP BY 1, 2)"


@query(f"SELECT sequence_id, frame_idx, m.i AS prev_idx, m.j AS det_idx, round(-m.minus, 6) AS iou FROM ({MATCHES})")
def d4_greedy_matches(spark, d):
    pairs = joins.consecutive_pairs(filters.filter_detections(A.detections(spark, d), 0.3), 0.1)
    return rounded(joins.greedy_matches(pairs, ["sequence_id", "frame_idx"]))


def judged_boxes(spark, d):
    """Boxes with an even index stand for truth, moved a little; all confident ones for predictions."""
    boxes = A.detections(spark, d).withColumn("stem", F.concat_ws("_", "sequence_id", "frame_idx"))
    gt = boxes.where("det_idx % 2 = 0").select("stem", F.col("det_idx").alias("gt_idx"), (F.col("cx") + 0.01).alias("cx"), "cy", "w", "h")
    pred = boxes.where("confidence >= 0.2").select("stem", F.col("det_idx").alias("pred_idx"), "cx", "cy", "w", "h", "confidence")
    return joins.evaluate_boxes(pred, gt, 0.3)


STEMS = "(SELECT *, concat_ws('_', sequence_id, frame_idx) AS stem FROM v_det)"
JUDGED = judged_sql(f"SELECT stem, det_idx AS pred_idx, cx, cy, w, h, confidence FROM {STEMS} WHERE confidence >= 0.2e0", f"SELECT stem, det_idx AS gt_idx, cx + 0.01e0 AS cx, cy, w, h FROM {STEMS} WHERE det_idx % 2 = 0", "0.3e0")


@query(f"SELECT stem, pred_idx, gt_idx, round(confidence, 6) AS confidence, round(area, 6) AS area, round(iou, 6) AS iou, verdict FROM ({JUDGED})")
def d5_evaluate_boxes(spark, d):
    return rounded(judged_boxes(spark, d))


SAMPLES = "SELECT concat_ws('_', sequence_id, frame_idx) AS stem FROM v_slot"
COUNTED = "count(*) FILTER (verdict = 'tp') AS tp, count(*) FILTER (verdict = 'fp') AS fp, count(*) FILTER (verdict = 'fn') AS fn"


def samples(spark, d):
    return A.slots(spark, d).select(F.concat_ws("_", "sequence_id", "frame_idx").alias("stem"))


@query(f"SELECT s.stem, coalesce(tp, 0) AS eval_tp, coalesce(fp, 0) AS eval_fp, coalesce(fn, 0) AS eval_fn FROM ({SAMPLES}) s LEFT JOIN (SELECT stem, {COUNTED} FROM ({JUDGED}) GROUP BY 1) j ON j.stem = s.stem")
def d5_sample_counts(spark, d):
    return joins.sample_counts(judged_boxes(spark, d), samples(spark, d))


@query(f"""SELECT (SELECT count(*) FROM ({SAMPLES})) AS num_samples, tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, fp_review_samples, fn_review_samples
FROM (SELECT {COUNTED}, count(DISTINCT stem) FILTER (verdict = 'fp' AND confidence >= 0.5e0) AS fp_review_samples, count(DISTINCT stem) FILTER (verdict = 'fn') AS fn_review_samples FROM ({JUDGED}))""")
def d5_summary(spark, d):
    return rounded(joins.evaluation_summary(judged_boxes(spark, d), samples(spark, d), 0.5))


@query("""SELECT model_name, sequence_id, CASE WHEN is_positive THEN 'fp' ELSE 'fn' END AS kind, trigger_frame_index FROM v_result WHERE is_positive <> is_positive_gt AND model_name = 'click' AND sequence_id % 13 <> 0""")
def d6_review_sets(spark, d):
    one = A.predictions(spark, d).where("model_name = 'click' and sequence_id % 13 <> 0")
    errors, _ = joins.review_sets(A.truth(spark, d), one)
    return errors.select(F.lit("click").alias("model_name"), "sequence_id", "kind", "trigger_frame_index")


@query("""SELECT g.sequence_id FROM v_gt g WHERE NOT EXISTS (SELECT 1 FROM v_pred p WHERE p.sequence_id = g.sequence_id AND p.model_name = 'click' AND p.sequence_id % 13 <> 0)""")
def d6_missing_predictions(spark, d):
    one = A.predictions(spark, d).where("model_name = 'click' and sequence_id % 13 <> 0")
    return joins.review_sets(A.truth(spark, d), one)[1].select("sequence_id")


@query("""SELECT e.event_id, coalesce(f.frame_idx, l.last) AS frame_idx FROM v_event e LEFT JOIN (SELECT DISTINCT sequence_id, frame_idx FROM v_event WHERE frame_idx % 4 <> 0) f USING (sequence_id, frame_idx) LEFT JOIN (SELECT sequence_id, max(frame_idx) AS last FROM v_event WHERE frame_idx % 4 <> 0 GROUP BY 1) l USING (sequence_id)""")
def d7_source_frame(spark, d):
    wanted = A.events(spark, d).select("event_id", "sequence_id", F.col("frame_idx").cast("string").alias("frame_id"))
    known = A.events(spark, d).where("frame_idx % 4 <> 0").select("sequence_id", F.col("frame_idx").cast("string").alias("frame_id"), "frame_idx").distinct()
    return joins.source_frame(wanted, known).select("event_id", "frame_idx")


@query("""SELECT sequence_id, tube_id, frame_idx, CASE WHEN is_gap THEN 'gap' ELSE 'det' END AS cell FROM v_entry""")
def d8_tube_timeline(spark, d):
    entries = A.tube_entries(spark, d).where("not is_gap").select("sequence_id", "tube_id", "frame_idx", "confidence")
    return joins.tube_timeline(A.tubes(spark, d), entries).select("sequence_id", "tube_id", "frame_idx", "cell")


@query("""SELECT s.sequence_id, s.frame_idx, e.kind, count(x.det_idx) AS n_boxes, coalesce(s.frame_idx = e.trigger_frame_index, false) AS is_trigger FROM (SELECT sequence_id, trigger_frame_index, CASE WHEN is_positive THEN 'fp' ELSE 'fn' END AS kind FROM v_result WHERE model_name = 'click' AND is_positive <> is_positive_gt) e JOIN v_slot s USING (sequence_id) LEFT JOIN v_det x ON x.sequence_id = s.sequence_id AND x.frame_idx = s.frame_idx GROUP BY 1, 2, 3, 5""")
def d9_review_frames(spark, d):
    errors, _ = joins.review_sets(A.truth(spark, d), A.predictions(spark, d).where("model_name = 'click'"))
    rows = joins.review_frames(errors, A.slots(spark, d), A.detections(spark, d))
    return rows.select("sequence_id", "frame_idx", "kind", F.size("boxes").cast("long").alias("n_boxes"), "is_trigger")

