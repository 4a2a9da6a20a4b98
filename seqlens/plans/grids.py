"""Queries: parameter grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import change, sweep
from . import adapters as A
from .greedy_sql import counted_sql, sweep_sql
from .registry import query, rounded
from .sequences import SMOOTH, ratio_sql, smooth_sql


@query(sweep_sql(sweep.EACH))
def i1_tracker_sweep(spark, d):
    return rounded(sweep.tracker_sweep(A.frames(spark, d), A.truth(spark, d), sweep.EACH))


@query(sweep_sql(sweep.WHOLE))
def i1_whole_grid(spark, d):
    """All 28,800 settings."""
    return rounded(sweep.tracker_sweep(A.frames(spark, d), A.truth(spark, d), sweep.WHOLE))


#: The published grid, with two further ratios.
CHANGE = sweep.CHANGE | {"min_ratio": [*sweep.CHANGE["min_ratio"], 0.2, 0.4]}


@query(sweep_sql(CHANGE, f"(SELECT *, 0 AS det_idx FROM ({ratio_sql(CHANGE['pixel_threshold'])}))", "v_raster", "(SELECT sequence_id, count(*) % 2 = 0 AS is_positive_gt FROM v_raster GROUP BY 1)"))
def i2_change_sweep(spark, d):
    ratios = change.change_ratios(A.rasters(spark, d), A.raster_boxes(spark, d), CHANGE["pixel_threshold"])
    truth = A.rasters(spark, d).groupBy("sequence_id").agg((F.count("*") % 2 == 0).alias("is_positive_gt"))
    return rounded(sweep.change_sweep(ratios, A.rasters(spark, d), truth, CHANGE))


@query(f"""SELECT CAST(4 AS INT) AS window, threshold, tp, fp, pos - tp AS fn, neg - fp AS tn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(pos, 0), 0), 6) AS recall, round(coalesce(2e0 * tp / nullif(2 * tp + fp + pos - tp, 0), 0), 6) AS f1, round(coalesce(fp / nullif(neg, 0), 0), 6) AS fpr, round(mean_ttd, 6) AS mean_ttd, round(median_ttd, 6) AS median_ttd
FROM (SELECT t.threshold, count(*) FILTER (f.first IS NOT NULL AND g.is_positive_gt) AS tp, count(*) FILTER (f.first IS NOT NULL AND NOT g.is_positive_gt) AS fp, count(*) FILTER (g.is_positive_gt) AS pos, count(*) FILTER (NOT g.is_positive_gt) AS neg, avg(f.first) FILTER (g.is_positive_gt) AS mean_ttd, median(f.first) FILTER (g.is_positive_gt) AS median_ttd FROM v_gt g CROSS JOIN (SELECT unnest([1e0, 1.5e0, 2e0, 2.5e0]) AS threshold) t LEFT JOIN (SELECT sequence_id, threshold, min(frame_idx) AS first FROM ({SMOOTH}) CROSS JOIN (SELECT unnest([1e0, 1.5e0, 2e0, 2.5e0]) AS threshold) WHERE smoothed > threshold GROUP BY 1, 2) f ON f.sequence_id = g.sequence_id AND f.threshold = t.threshold GROUP BY 1)""")
def i3_smoothing_sweep(spark, d):
    return rounded(sweep.smoothing_sweep(A.detections(spark, d), A.truth(spark, d), [4], [1.0, 1.5, 2.0, 2.5]))


WINDOWS, LIMITS = [2, 3, 4, 5, 6, 7, 8, 9, 10], [0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.5, 0.8, 1.0, 1.5, 2.0]
THRESHOLDS = f"(SELECT unnest([{', '.join(f'{x}e0' for x in LIMITS)}]) AS threshold)"
EVERY = " UNION ALL ".join(f"SELECT CAST({n} AS INT) AS window, * FROM ({smooth_sql(n)})" for n in WINDOWS)


@query(counted_sql(f"SELECT sequence_id, threshold, a.window, min(frame_idx) AS first FROM ({EVERY}) a CROSS JOIN {THRESHOLDS} WHERE smoothed > threshold GROUP BY ALL", f'SELECT * FROM {THRESHOLDS} CROSS JOIN (SELECT CAST(unnest({WINDOWS}) AS INT) AS "window")', ["threshold", '"window"']))
def i3_smoothing_grid(spark, d):
    return rounded(sweep.smoothing_sweep(A.detections(spark, d), A.truth(spark, d), WINDOWS, LIMITS))


RULES = {"confidence": [0.3], "iou": [0.1], "max_misses": [0, 1], "min_consecutive": [2], "min_mean_confidence": [None, 0.4], "min_area_change": [None, 1.1]}


@query(f"SELECT *, coalesce(nullif(concat_ws('+', CASE WHEN max_misses > 0 THEN 'gap' END, CASE WHEN min_mean_confidence IS NOT NULL THEN 'confidence' END, CASE WHEN min_area_change IS NOT NULL THEN 'area' END), ''), 'none') AS rules FROM ({sweep_sql(RULES)})")
def i4_ablation(spark, d):
    return rounded(sweep.ablation(A.frames(spark, d), A.truth(spark, d), min_consecutive=2))
