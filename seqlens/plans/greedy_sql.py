"""SQL of greedy matching, box verdicts and the tracker, for the twins of queries that rest on them."""

from __future__ import annotations

IOU = "(CASE WHEN {u} > 0 THEN {i} / {u} ELSE 0e0 END)"


def iou_sql(a: str, b: str) -> str:
    """IoU of the boxes of two aliases in SQL."""
    across = f"greatest(0e0, least({a}.cx + {a}.w / 2, {b}.cx + {b}.w / 2) - greatest({a}.cx - {a}.w / 2, {b}.cx - {b}.w / 2))"
    down = f"greatest(0e0, least({a}.cy + {a}.h / 2, {b}.cy + {b}.h / 2) - greatest({a}.cy - {a}.h / 2, {b}.cy - {b}.h / 2))"
    both = f"({across} * {down})"
    return IOU.format(i=both, u=f"({a}.w * {a}.h + {b}.w * {b}.h - {both})")


#: A track as the twin of the tracker carries it; det and iou are of the last frame, null after a miss.
TRACK = "STRUCT(id INT, cx DOUBLE, cy DOUBLE, w DOUBLE, h DOUBLE, streak INT, misses INT, det INT, iou DOUBLE)"


def greedy_sql(pairs: str) -> str:
    """The pairs (minus, i, j) that a greedy one-to-one matching takes, in order; minus is the negative overlap."""
    return f"""CASE WHEN len({pairs}) > 0 THEN list_reduce(list_transform(list_sort({pairs}), lambda p: [p]), lambda held, p:
        CASE WHEN len(list_filter(held, lambda q: q.i = p[1].i OR q.j = p[1].j)) = 0 THEN list_concat(held, p) ELSE held END) ELSE {pairs} END"""


def judged_sql(predictions: str, truth: str, min_iou: str) -> str:
    """Verdicts of predictions (stem, pred_idx, box, confidence) that in order of confidence take the free truth box (stem, gt_idx, box) they overlap most, and the boxes missed."""
    return f"""WITH p AS ({predictions}), t AS ({truth}),
    near AS (SELECT p.stem, p.pred_idx, list({{'minus': -{iou_sql('p', 't')}, 'g': t.gt_idx}} ORDER BY -{iou_sql('p', 't')}, t.gt_idx) AS near
        FROM p JOIN t ON p.stem = t.stem AND {iou_sql('p', 't')} >= {min_iou} GROUP BY 1, 2),
    queue AS (SELECT stem, list([{{'pred_idx': pred_idx, 'near': near, 'hit': near[1]}}] ORDER BY confidence DESC, pred_idx) AS queue FROM p JOIN near USING (stem, pred_idx) GROUP BY 1),
    taken AS (SELECT stem, unnest(list_reduce(queue, lambda held, x: list_concat(held, [{{'pred_idx': x[1].pred_idx, 'near': x[1].near,
        'hit': list_filter(x[1].near, lambda c: len(list_filter(held, lambda a: a.hit.g = c.g)) = 0)[1]}}]))) AS m FROM queue),
    hits AS (SELECT stem, m.pred_idx AS pred_idx, m.hit.g AS gt_idx, -m.hit.minus AS iou FROM taken WHERE m.hit.g IS NOT NULL)
    SELECT p.stem, p.pred_idx, gt_idx, confidence, CAST(NULL AS DOUBLE) AS area, iou, CASE WHEN gt_idx IS NULL THEN 'fp' ELSE 'tp' END AS verdict FROM p LEFT JOIN hits USING (stem, pred_idx)
    UNION ALL SELECT t.stem, NULL, t.gt_idx, NULL, t.w * t.h, NULL, 'fn' FROM t LEFT JOIN hits ON hits.stem = t.stem AND hits.gt_idx = t.gt_idx WHERE hits.stem IS NULL"""


def confident(least: str) -> str:
    return f"(SELECT * FROM v_det WHERE confidence >= {least})"


def steps_sql(boxes: str, min_iou: str, max_misses: str, slots: str = "v_slot") -> str:
    """The tracker, a row for each frame of a sequence: hits, missed, fresh (ids born) and pruned, as lists. slots: the frames of each sequence."""
    return f"""WITH RECURSIVE f AS (SELECT s.sequence_id, s.frame_idx, row_number() OVER (PARTITION BY s.sequence_id ORDER BY s.frame_idx) AS n,
        coalesce(list({{'det': d.det_idx, 'cx': d.cx, 'cy': d.cy, 'w': d.w, 'h': d.h}} ORDER BY d.det_idx) FILTER (d.det_idx IS NOT NULL), []) AS dets
        FROM {slots} s LEFT JOIN {boxes} d ON d.sequence_id = s.sequence_id AND d.frame_idx = s.frame_idx GROUP BY 1, 2),
    g AS (SELECT DISTINCT sequence_id, CAST(0 AS BIGINT) AS n, CAST(-1 AS BIGINT) AS frame_idx, CAST(0 AS BIGINT) AS born, CAST(0 AS BIGINT) AS before, CAST([] AS {TRACK}[]) AS now FROM f
    UNION ALL SELECT sequence_id, n, frame_idx, born + len(fresh), born, CAST(list_concat(
            list_transform(met, lambda x: CASE WHEN x.m.i IS NOT NULL
                THEN {{'id': x.t.id, 'cx': dets[x.m.j].cx, 'cy': dets[x.m.j].cy, 'w': dets[x.m.j].w, 'h': dets[x.m.j].h, 'streak': x.t.streak + 1, 'misses': 0, 'det': dets[x.m.j].det, 'iou': -x.m.minus}}
                ELSE {{'id': x.t.id, 'cx': x.t.cx, 'cy': x.t.cy, 'w': x.t.w, 'h': x.t.h, 'streak': 0, 'misses': x.t.misses + 1, 'det': NULL, 'iou': NULL}} END),
            list_transform(fresh, lambda d, k: {{'id': born + k - 1, 'cx': d.cx, 'cy': d.cy, 'w': d.w, 'h': d.h, 'streak': 1, 'misses': 0, 'det': d.det, 'iou': NULL}})) AS {TRACK}[])
        FROM (SELECT *, list_transform(live, lambda t, i: {{'t': t, 'm': list_filter(found, lambda m: m.i = i)[1]}}) AS met,
                list_filter(dets, lambda d, j: len(list_filter(found, lambda m: m.j = j)) = 0) AS fresh
            FROM (SELECT *, {greedy_sql('pairs')} AS found
                FROM (SELECT *, list_filter(flatten(list_transform(live, lambda t, i: list_transform(dets, lambda d, j: {{'minus': -{iou_sql('t', 'd')}, 'i': i, 'j': j}}))), lambda p: p.minus <= -{min_iou}) AS pairs
                    FROM (SELECT f.sequence_id, f.n, f.frame_idx, f.dets, g.born, list_filter(g.now, lambda t: t.misses <= {max_misses.replace('sequence_id', 'f.sequence_id')}) AS live FROM g JOIN f ON f.sequence_id = g.sequence_id AND f.n = g.n + 1)))))
    SELECT sequence_id, frame_idx, list_filter(now, lambda t: t.det IS NOT NULL) AS hits, list_transform(list_filter(now, lambda t: t.det IS NULL), lambda t: t.id) AS missed,
        list_transform(list_filter(now, lambda t: t.id >= before), lambda t: t.id) AS fresh, list_transform(list_filter(now, lambda t: t.misses > {max_misses}), lambda t: t.id) AS pruned FROM g WHERE n > 0"""


def hits_sql(boxes: str, min_iou: str, max_misses: str, slots: str = "v_slot") -> str:
    """Hits of all tracks with the confidence and area of their boxes."""
    return f"""SELECT x.sequence_id, x.h.id AS track_id, x.frame_idx, x.h.det AS det_idx, x.h.streak AS streak, x.h.iou AS iou, d.confidence, d.cx, d.w * d.h AS area
    FROM (SELECT sequence_id, frame_idx, unnest(hits) AS h FROM ({steps_sql(boxes, min_iou, max_misses, slots)})) x JOIN {boxes} d ON d.sequence_id = x.sequence_id AND d.frame_idx = x.frame_idx AND d.det_idx = x.h.det"""


RATES = """round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
round(coalesce(2e0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round(coalesce(fp / nullif(fp + tn, 0), 0), 6) AS fpr"""


def counted_sql(alarms: str, settings: str, by: list[str], truth: str = "v_gt") -> str:
    """Metrics under each setting from the alarms (sequence_id, by, first)."""
    same = " AND ".join(f"f.{c} IS NOT DISTINCT FROM s.{c}" for c in by)
    names = ", ".join(by)
    return f"""SELECT {names}, tp, fp, fn, tn, {RATES}, round(mean_ttd, 6) AS mean_ttd, median_ttd FROM (SELECT {', '.join(f's.{c}' for c in by)}, count(*) FILTER (f.first IS NOT NULL AND g.is_positive_gt) AS tp,
    count(*) FILTER (f.first IS NOT NULL AND NOT g.is_positive_gt) AS fp, count(*) FILTER (f.first IS NULL AND g.is_positive_gt) AS fn, count(*) FILTER (f.first IS NULL AND NOT g.is_positive_gt) AS tn,
    avg(f.first) FILTER (g.is_positive_gt) AS mean_ttd, median(f.first) FILTER (g.is_positive_gt) AS median_ttd
    FROM {truth} g CROSS JOIN ({settings}) s LEFT JOIN ({alarms}) f ON f.sequence_id = g.sequence_id AND {same} GROUP BY ALL)"""


def _listed(values: list) -> str:
    return "[" + ", ".join("CAST(NULL AS DOUBLE)" if v is None else f"{v}e0" if isinstance(v, float) else f"CAST({v} AS INT)" for v in values) + "]"


def sweep_sql(grid: dict, boxes: str = "v_det", slots: str = "v_slot", truth: str = "v_gt") -> str:
    """The tracker sweep over a grid. A sequence under a matching setting is a sequence of its own. With change parameters in the grid, boxes has pixel_threshold and change_ratio."""
    grid = {"max_area": [None]} | grid
    changed = "min_ratio" in grid
    matching = [*(["pixel_threshold", "min_ratio"] if changed else []), "confidence", "max_area", "iou", "max_misses"]
    after = ["min_consecutive", "min_mean_confidence", "min_area_change"]
    each = lambda *names: "SELECT " + ", ".join(names) + " FROM " + ", ".join(f"(SELECT unnest({_listed(grid[n])}) AS {n})" for n in names)
    key = "{'seq': x.sequence_id, " + ", ".join(f"'{n}': s.{n}" for n in matching) + "} AS sequence_id"
    settings = each(*matching)
    all_slots = f"(SELECT {key}, x.frame_idx FROM {slots} x CROSS JOIN ({settings}) s)"
    enough = "AND x.pixel_threshold = s.pixel_threshold AND x.change_ratio >= s.min_ratio" if changed else ""
    kept = f"""(SELECT {key}, x.frame_idx, x.det_idx, x.cx, x.cy, x.w, x.h, x.confidence
    FROM {boxes} x JOIN ({settings}) s ON x.confidence >= s.confidence AND (s.max_area IS NULL OR x.w * x.h <= s.max_area) {enough})"""
    named = ", ".join(f"sequence_id.{n} AS {n}" for n in matching)
    tracks = f"""SELECT sequence_id.seq AS sequence_id, {named}, mean_confidence, CASE WHEN a > 0 THEN b / a ELSE 0e0 END AS area_ratio, min_consecutive, reached
    FROM (SELECT sequence_id, track_id, avg(confidence) OVER t AS mean_confidence, first_value(area) OVER t AS a, last_value(area) OVER t AS b, streak AS min_consecutive, frame_idx AS reached
        FROM ({hits_sql(kept, 'sequence_id.iou', 'sequence_id.max_misses', all_slots)})
        WINDOW t AS (PARTITION BY sequence_id, track_id ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""
    alarms = f"""SELECT t.sequence_id, {', '.join(f't.{n}' for n in matching)}, t.min_consecutive, s.min_mean_confidence, s.min_area_change, min(t.reached) AS first
    FROM ({tracks}) t CROSS JOIN ({each('min_mean_confidence', 'min_area_change')}) s
    WHERE (s.min_mean_confidence IS NULL OR t.mean_confidence >= s.min_mean_confidence) AND (s.min_area_change IS NULL OR t.area_ratio >= s.min_area_change) GROUP BY ALL"""
    return counted_sql(alarms, each(*matching, *after), [*matching, *after], truth)
