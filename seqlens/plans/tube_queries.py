"""Queries: tube scores, simulations, calibrator, the tube-decision pipeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import calibrated
from ..operators import decisions, models, sweep, tube_scores, tubes
from . import adapters as A
from .curves import R6, RATES, counted
from .greedy_sql import hits_sql
from .registry import query, rounded, twin

#: A calibrator for tests of its use: coefficients of tube_scores.FEATURES, intercept.
COEFFICIENTS, INTERCEPT = [0.7, 1.2, 0.5, 0.1], -4.0
PROBABILITY = f"1 / (1 + exp(-({INTERCEPT}e0 + {COEFFICIENTS[0]}e0 * logit + {COEFFICIENTS[1]}e0 * log_len + {COEFFICIENTS[2]}e0 * mean_conf + {COEFFICIENTS[3]}e0 * n_tubes)))"


def full_tubes(spark, d):
    """Tubes with mean_conf and max_conf of their interpolated entries."""
    stats = tube_scores.statistics(tubes.interpolate(A.tube_entries(spark, d)))
    return A.tubes(spark, d).join(stats.select("sequence_id", "tube_id", "mean_conf", "max_conf"), ["sequence_id", "tube_id"])


STATS = "SELECT sequence_id, tube_id, max(frame_idx) - min(frame_idx) + 1 AS length, avg(CASE WHEN is_gap THEN 0e0 ELSE confidence END) AS mean_conf, max(CASE WHEN is_gap THEN 0e0 ELSE confidence END) AS max_conf FROM v_entry GROUP BY 1, 2"
SCORES = """SELECT s.sequence_id, l.label, r.rule, r.k, CASE r.rule WHEN 'max' THEN coalesce(max_l, '-inf'::DOUBLE) WHEN 'mean' THEN coalesce(avg_l, '-inf'::DOUBLE) WHEN 'length_weighted_mean' THEN coalesce(lwm, '-inf'::DOUBLE) ELSE CASE WHEN n >= r.k THEN list_sum(top[1:r.k]) / r.k ELSE '-inf'::DOUBLE END END AS score
FROM v_seq s JOIN v_label l USING (sequence_id) LEFT JOIN (SELECT sequence_id, max(logit) AS max_l, avg(logit) AS avg_l, sum(logit * (end_frame - start_frame + 1)) / sum(end_frame - start_frame + 1) AS lwm, count(*) AS n, list_reverse_sort(list(logit)) AS top FROM v_tube GROUP BY 1) t USING (sequence_id)
CROSS JOIN (VALUES ('max', 1), ('top_k_mean', 2), ('top_k_mean', 3), ('mean', 1), ('length_weighted_mean', 1)) r(rule, k)"""
GRID = [("max", 1), ("top_k_mean", 2), ("top_k_mean", 3), ("mean", 1), ("length_weighted_mean", 1)]


@query(f"SELECT sequence_id, rule, k, round(greatest(score, -1e9), 6) AS score FROM ({SCORES})")
def g13_aggregation_rules(spark, d):
    scores = tube_scores.sequence_scores(A.tubes(spark, d), A.labelled_sequences(spark, d), GRID)
    return rounded(scores.select("sequence_id", "rule", "k", F.greatest("score", F.lit(-1e9)).alias("score")))


LIMIT = f"SELECT rule, k, list_sort(list(score))[CAST(floor(count(*) * (1e0 - 0.8e0)) AS INT) + 1] AS threshold FROM ({SCORES}) WHERE label = 'smoke' GROUP BY 1, 2"


@query(f"SELECT rule, k, round(greatest(threshold, -1e9), 6) AS threshold, tp, fp, fn, tn, {R6} FROM (SELECT *, {RATES} FROM ({counted('rule, k, threshold', f'({SCORES}) JOIN ({LIMIT}) USING (rule, k)', '''label = 'smoke' ''', 'score >= threshold')}))")
def g14_rule_summary(spark, d):
    scores = tube_scores.sequence_scores(A.tubes(spark, d), A.labelled_sequences(spark, d), GRID)
    return rounded(tube_scores.rule_summary(scores, 0.8, []).withColumn("threshold", F.greatest("threshold", F.lit(-1e9))))


@query(f"SELECT sequence_id, tube_id, CAST(length AS INT) AS length, round(mean_conf, 6) AS mean_conf, round(max_conf, 6) AS max_conf FROM ({STATS})")
def g15_tube_statistics(spark, d):
    return rounded(tube_scores.statistics(tubes.interpolate(A.tube_entries(spark, d))))


@query(f"""SELECT tau, label, count(*) AS n_total, count(*) FILTER (n IS NULL) AS n_no_tubes, count(*) FILTER (n IS NOT NULL AND best IS NULL) AS n_all_drop, count(*) FILTER (label = 'smoke' AND coalesce(best >= 0.2e0, false)) AS tp, count(*) FILTER (label = 'fp' AND coalesce(best >= 0.2e0, false)) AS fp, count(*) FILTER (label = 'smoke' AND NOT coalesce(best >= 0.2e0, false)) AS fn, count(*) FILTER (label = 'fp' AND NOT coalesce(best >= 0.2e0, false)) AS tn
FROM (SELECT l.sequence_id, l.label, g.tau, count(t.logit) AS c, nullif(count(t.logit), 0) AS n, max(t.logit) FILTER (t.max_conf >= g.tau) AS best FROM v_label l CROSS JOIN (SELECT unnest([0.3e0, 0.9e0, 0.99e0]) AS tau) g LEFT JOIN (SELECT t.*, s.max_conf FROM v_tube t JOIN ({STATS}) s USING (sequence_id, tube_id)) t USING (sequence_id) GROUP BY 1, 2, 3) GROUP BY 1, 2""")
def g16_confidence_filter(spark, d):
    return tube_scores.confidence_filter(full_tubes(spark, d), A.labelled_sequences(spark, d), [0.3, 0.9, 0.99], 0.2)


BEST_OF_2 = "SELECT l.label, coalesce(max(t.logit) >= 0.2e0, false) AS positive FROM v_label l LEFT JOIN (SELECT * FROM v_tube QUALIFY row_number() OVER (PARTITION BY sequence_id ORDER BY end_frame - start_frame DESC, tube_id) <= 2) t USING (sequence_id) GROUP BY l.sequence_id, l.label"


@query(f"SELECT CAST(2 AS INT) AS n, tp, fp, fn, tn, {R6} FROM (SELECT *, {RATES} FROM ({counted('', f'({BEST_OF_2})', '''label = 'smoke' ''', 'positive')}))")
def g17_tube_selection(spark, d):
    return rounded(tube_scores.tube_selection(A.tubes(spark, d), A.labelled_sequences(spark, d), 2, 0.2))


@query("SELECT count(*) AS n_detections, round(min(confidence), 6) AS min, round(list_sort(list(confidence))[count(*) // 100 + 1], 6) AS p01, round(list_sort(list(confidence))[count(*) // 2 + 1], 6) AS median FROM v_det")
def g18_confidence_floor(spark, d):
    return rounded(tube_scores.confidence_floor(A.detections(spark, d)))


FEATURE = f"SELECT l.sequence_id, l.label, coalesce(b.logit, 0) AS logit, coalesce(ln(1e0 + b.length), 0) AS log_len, coalesce(b.mean_conf, 0) AS mean_conf, CAST(coalesce(b.n, 0) AS DOUBLE) AS n_tubes FROM v_label l LEFT JOIN (SELECT t.sequence_id, t.logit, s.length, s.mean_conf, count(*) OVER (PARTITION BY t.sequence_id) AS n FROM v_tube t JOIN ({STATS}) s USING (sequence_id, tube_id) QUALIFY row_number() OVER (PARTITION BY t.sequence_id ORDER BY t.logit DESC, t.tube_id) = 1) b USING (sequence_id)"


@query(f"SELECT sequence_id, label, round(logit, 6) AS logit, round(log_len, 6) AS log_len, round(mean_conf, 6) AS mean_conf, n_tubes FROM ({FEATURE})")
def g19_calibrator_features(spark, d):
    return rounded(tube_scores.calibrator_features(full_tubes(spark, d), A.labelled_sequences(spark, d)))


PROB = f"SELECT label, 1 / (1 + exp(-({INTERCEPT}e0 + {COEFFICIENTS[0]}e0 * logit + {COEFFICIENTS[1]}e0 * log_len + {COEFFICIENTS[2]}e0 * mean_conf + {COEFFICIENTS[3]}e0 * n_tubes))) AS prob, threshold FROM ({FEATURE}) CROSS JOIN (SELECT unnest([0.4e0, 0.5e0, 0.6e0, 0.7e0]) AS threshold)"


@query(f"SELECT threshold, tp, fp, fn, tn, {R6} FROM (SELECT *, {RATES} FROM ({counted('threshold', f'({PROB})', '''label = 'smoke' ''', 'prob >= threshold')}))")
def g20_calibrator_metrics(spark, d):
    features = tube_scores.calibrator_features(full_tubes(spark, d), A.labelled_sequences(spark, d))
    return rounded(tube_scores.calibrator_metrics(features, COEFFICIENTS, INTERCEPT, [0.4, 0.5, 0.6, 0.7]))


@query("""SELECT l.label, CASE WHEN n IS NULL THEN 'no_tubes' WHEN length < 28 THEN 'too_short' ELSE 'kept' END AS reason, count(*) AS n FROM v_label l LEFT JOIN (SELECT sequence_id, count(*) AS n, max(end_frame - start_frame + 1) AS length FROM v_tube GROUP BY 1) USING (sequence_id) GROUP BY 1, 2""")
def g21_drop_summary(spark, d):
    longest = tubes.longest(A.tubes(spark, d)).select("sequence_id", (F.col("end_frame") - F.col("start_frame") + 1).alias("length"))
    rows = A.labelled_sequences(spark, d).join(longest, "sequence_id", "left")
    judged = rows.withColumn("reason", F.when(F.col("length").isNull(), "no_tubes").when(F.col("length") < 28, "too_short"))
    return tube_scores.drop_summary(judged)


REPORT = f"""SELECT 'confidence filter' AS analysis, CAST(tau AS VARCHAR) AS setting, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(tn) AS tn FROM ({twin('g16_confidence_filter')}) GROUP BY tau
UNION ALL SELECT 'tube selection', 'top 2', tp, fp, fn, tn FROM ({twin('g17_tube_selection')})
UNION ALL SELECT 'calibrator', CAST(threshold AS VARCHAR), tp, fp, fn, tn FROM ({twin('g20_calibrator_metrics')})
UNION ALL SELECT 'rules', rule || ' ' || k, tp, fp, fn, tn FROM ({twin('g14_rule_summary')})"""


@query(f"""SELECT analysis, setting, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn, {R6}, CAST(rank AS INT) AS rank, rank = 1 AS is_recommended
FROM (SELECT *, row_number() OVER (ORDER BY f1 DESC, precision DESC, analysis, setting) AS rank FROM (SELECT *, {RATES} FROM ({REPORT})))""")
def i5_variant_report(spark, d):
    some, known = full_tubes(spark, d), A.labelled_sequences(spark, d)
    taus = tube_scores.confidence_filter(some, known, [0.3, 0.9, 0.99], 0.2).groupBy("tau").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")]).withColumn("setting", F.col("tau").cast("string"))
    picks = tube_scores.tube_selection(some, known, 2, 0.2).withColumn("setting", F.lit("top 2"))
    calibrated = tube_scores.calibrator_metrics(tube_scores.calibrator_features(some, known), COEFFICIENTS, INTERCEPT, [0.4, 0.5, 0.6, 0.7]).withColumn("setting", F.col("threshold").cast("string"))
    rules = tube_scores.rule_summary(tube_scores.sequence_scores(some, known, GRID), 0.8, []).withColumn("setting", F.concat_ws(" ", "rule", "k"))
    return rounded(sweep.variant_report({"confidence filter": taus, "tube selection": picks, "calibrator": calibrated, "rules": rules}))


def training_rows(spark, d):
    return tube_scores.calibrator_features(full_tubes(spark, d), A.labelled_sequences(spark, d)).withColumn("truth", (F.col("label") == "smoke").cast("int"))


@query()
def l4_calibrator_fit(spark, d):
    rows = training_rows(spark, d)
    coefficients, intercept = models.fit_calibrator(rows)
    return rounded(tube_scores.calibrator_metrics(rows, coefficients, intercept, [0.4, 0.5, 0.6, 0.7]), 4)


@query("SELECT unnest(['logit', 'log_len', 'mean_conf', 'n_tubes', 'intercept']) AS feature, 0e0 AS slope")
def l4_calibrator_optimum(spark, d):
    """The slope of the loss at the fitted coefficients: none."""
    rows = training_rows(spark, d)
    coefficients, intercept = models.fit_calibrator(rows)
    return models.loss_slope(rows, coefficients, intercept).select("feature", (F.round("slope", 3) + 0.0).alias("slope"))


SANITY = f"WITH p AS (SELECT *, {PROBABILITY} AS prob FROM ({FEATURE})), q AS (SELECT prob, min({{'logit': logit, 'log_len': log_len, 'mean_conf': mean_conf, 'n_tubes': n_tubes}}) AS x FROM p GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY prob) AS nth, count(*) OVER () AS n FROM q)"


@query(f"{SANITY} SELECT round(x.logit, 6) AS logit, round(x.log_len, 6) AS log_len, round(x.mean_conf, 6) AS mean_conf, x.n_tubes AS n_tubes, round(prob, 6) AS prob FROM r WHERE nth IN (1, CAST(ceil(n * 0.5) AS BIGINT), n)")
def l5_sanity_rows(spark, d):
    rows = models.sanity_rows(training_rows(spark, d), COEFFICIENTS, INTERCEPT)
    models.verify(rows, COEFFICIENTS, INTERCEPT)
    return rounded(rows)


#: The two ways of deciding that the queries go: (aggregation, threshold, padding, interpolation).
LOGISTIC, MAX_LOGIT = ("logistic", 0.6, "uniform", True), ("max_logit", 0.2, "symmetric", False)


def decided(spark, d, way):
    """Tube decisions over the first 20 frames, padded to 24; a prefix's logit is a function of its tube and length."""
    aggregation, threshold, pad, interpolate = way
    frames = A.frames(spark, d, 0.3)
    found = decisions.candidate_tubes(frames, 20, 24, pad, 0.2, 2, 4, 2, interpolate)
    logit = lambda p: F.pmod(F.col("sequence_id") * 7 + F.col("tube_id") * 13, F.lit(100)) / 25.0 - 3 + p / 5.0
    scored = found.withColumn("scores", F.map_from_entries(F.transform(F.sequence(F.lit(1), F.size("entries")), lambda p: F.struct(p, logit(p)))))
    return decisions.decide(decisions.preprocessing(frames, 20, 24, pad), scored, aggregation, threshold, COEFFICIENTS, INTERCEPT)


def decided_sql(way) -> str:
    """The twin: kept tubes (sequence_id, tube_id, start_frame, end_frame, logit, prob, crossing, n, conf) in `kept`, candidates in `tube`, padded slots in `slot`."""
    aggregation, threshold, pad, interpolate = way
    source = "CAST(floor(s * 20 / 24) AS INT)" if pad == "uniform" else "greatest(0, least(19, s - 2))"
    slots = f"(SELECT sequence_id, CAST(s AS INT) AS frame_idx, {source} AS source FROM v_seq, range(24) t(s))"
    boxes = f"(SELECT x.sequence_id, x.frame_idx, d.det_idx, d.cx, d.cy, d.w, d.h, d.confidence FROM {slots} x JOIN v_det d ON d.sequence_id = x.sequence_id AND d.frame_idx = x.source WHERE d.confidence >= 0.3e0)"
    positive = f"prob >= {threshold}e0" if aggregation == "logistic" else f"logit >= {threshold}e0"
    prob = " + ".join(f"{c}e0 * {f}" for c, f in zip(COEFFICIENTS, ("logit", "log_len", "mean_conf", "n_tubes")))
    return f"""WITH hit AS MATERIALIZED ({hits_sql(boxes, '0.2e0', '2', slots)}),
    tube AS (SELECT sequence_id, track_id AS tube_id, min(frame_idx) AS start_frame, max(frame_idx) AS end_frame, count(*) AS seen FROM hit GROUP BY 1, 2),
    long AS (SELECT *, count(*) OVER (PARTITION BY sequence_id) AS n_tubes FROM tube WHERE end_frame - start_frame + 1 >= 4 AND seen >= 2),
    entry AS (SELECT l.sequence_id, l.tube_id, l.start_frame, l.n_tubes, l.frame_idx, {'coalesce(h.confidence, 0e0)' if interpolate else 'h.confidence'} AS confidence
        FROM (SELECT *, unnest(range(start_frame, end_frame + 1)) AS frame_idx FROM long) l LEFT JOIN hit h ON h.sequence_id = l.sequence_id AND h.track_id = l.tube_id AND h.frame_idx = l.frame_idx),
    prefix AS (SELECT *, row_number() OVER w AS p, count(*) OVER (PARTITION BY sequence_id, tube_id) AS n, coalesce(avg(confidence) OVER w, 0e0) AS mean_conf, ln(2e0 + frame_idx - start_frame) AS log_len FROM entry WINDOW w AS (PARTITION BY sequence_id, tube_id ORDER BY frame_idx ROWS UNBOUNDED PRECEDING)),
    scored AS (SELECT *, ((sequence_id * 7 + tube_id * 13) % 100) / 25e0 - 3e0 + p / 5e0 AS logit FROM prefix),
    judged AS (SELECT *, {positive} AS positive FROM (SELECT *, 1 / (1 + exp(-({INTERCEPT}e0 + {prob}))) AS prob FROM scored)),
    kept AS (SELECT sequence_id, tube_id, start_frame, max(frame_idx) AS end_frame, max(n) AS n, arg_max(logit, p) AS logit, arg_max(prob, p) AS prob, avg(confidence) AS conf,
        CASE WHEN arg_max(positive, p) THEN min(frame_idx) FILTER (p >= 4 AND positive) END AS crossing FROM judged GROUP BY 1, 2, 3),
    slot AS (SELECT sequence_id, list(frame_idx ORDER BY frame_idx) FILTER (nth > 1) AS padded FROM (SELECT *, {'row_number() OVER (PARTITION BY sequence_id, source ORDER BY frame_idx)' if pad == 'uniform' else 'CASE WHEN source = frame_idx - 2 THEN 1 ELSE 2 END'} AS nth FROM {slots}) GROUP BY 1)"""


def sequences_sql(way) -> str:
    return f"""{decided_sql(way)} SELECT s.sequence_id, k.trigger IS NOT NULL AS is_positive, k.trigger.frame AS trigger_frame_index, k.trigger.tube_id AS trigger_tube_id, 30 AS num_frames_input, 10 AS num_truncated,
    array_to_string(s.padded, ',') AS padded, coalesce(c.n, 0) AS num_candidates, coalesce(k.kept, '') AS kept, round(coalesce(k.logits, 0), 5) AS logits, round(coalesce(k.probs, 0), 5) AS probs
    FROM slot s LEFT JOIN (SELECT sequence_id, CAST(count(*) AS INT) AS n FROM tube GROUP BY 1) c USING (sequence_id)
    LEFT JOIN (SELECT sequence_id, min({{'frame': crossing, 'tube_id': tube_id}}) FILTER (crossing IS NOT NULL) AS trigger, sum(logit) AS logits, sum(prob) AS probs,
        string_agg(tube_id || ':' || start_frame || '-' || end_frame || ':' || n || ':' || coalesce(CAST(crossing AS VARCHAR), ''), ',' ORDER BY tube_id) AS kept FROM kept GROUP BY 1) k USING (sequence_id)"""


def sequence_rows(found):
    text = lambda t: F.concat(t["tube_id"].cast("string"), F.lit(":"), t["start_frame"].cast("string"), F.lit("-"), t["end_frame"].cast("string"), F.lit(":"), F.size(t["entries"]).cast("string"), F.lit(":"), F.coalesce(t["first_crossing_frame"].cast("string"), F.lit("")))
    total = lambda c: F.round(F.aggregate(F.col(f"details.tubes.kept.{c}"), F.lit(0.0), lambda a, x: a + x), 5).alias(f"{c[:4] if c[0] == 'p' else c}s")
    return found.select("sequence_id", "is_positive", "trigger_frame_index", "details.decision.trigger_tube_id", "details.preprocessing.num_frames_input", "details.preprocessing.num_truncated", F.array_join(F.col("details.preprocessing.padded_frame_indices").cast("array<string>"), ",").alias("padded"), "details.tubes.num_candidates", F.array_join(F.transform("details.tubes.kept", text), ",").alias("kept"), total("logit"), total("probability"))


@query(sequences_sql(LOGISTIC))
def l6_tube_decisions(spark, d):
    return sequence_rows(decided(spark, d, LOGISTIC))


@query(sequences_sql(MAX_LOGIT))
def l6_tube_decisions_max_logit(spark, d):
    return sequence_rows(decided(spark, d, MAX_LOGIT))


BEST = f"""SELECT g.sequence_id, CASE WHEN g.is_positive_gt THEN 'smoke' ELSE 'fp' END AS label, b.trigger IS NOT NULL AS is_positive, b.trigger AS trigger,
    coalesce(b.best.logit, 0) AS logit, coalesce(ln(1e0 + b.best.length), 0) AS log_len, coalesce(b.best.conf, 0) AS mean_conf, CAST(coalesce(b.n, 0) AS DOUBLE) AS n_tubes
    FROM v_gt g LEFT JOIN (SELECT sequence_id, min(crossing) AS trigger, count(*) AS n, first({{'logit': logit, 'length': end_frame - start_frame + 1, 'conf': conf}} ORDER BY logit DESC, tube_id) AS best FROM kept GROUP BY 1) b USING (sequence_id)"""
RECORDS = f"{decided_sql(LOGISTIC)} SELECT sequence_id, label, is_positive, trigger, round(logit, 5) AS logit, round(log_len, 5) AS log_len, n_tubes, round({PROBABILITY}, 5) AS prob FROM ({BEST})"


@query(RECORDS)
def l7_pipeline_records(spark, d):
    records = decisions.pipeline_records(decided(spark, d, LOGISTIC), A.truth(spark, d))
    features = decisions.record_features(records).withColumn("prob", calibrated(tube_scores.FEATURES, COEFFICIENTS, INTERCEPT)).select("sequence_id", "logit", "log_len", "n_tubes", "prob")
    return rounded(records.select("sequence_id", "label", "is_positive", "trigger").join(features, "sequence_id"), 5)
