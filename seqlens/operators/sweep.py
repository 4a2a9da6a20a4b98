"""Parameter grids.

Which boxes pass, and how they are linked, depends on confidence, box size, change, overlap and misses only; confirmation and post-filters come after it. A matching setting is a bit of a whole number (a lane), and a sequence is gone through once for all of them: tracks that some settings share up to a box are one node with the bits of these settings, a pair of boxes is compared once, and the greedy choice among pairs is taken for all lanes by a few bit operations. Nodes part where settings choose otherwise.
Of the tracks only the earliest frame at which a streak reached each length is kept for each combination of post-filter limits passed; alarms are counted by setting inside the task that links, so tracks never leave it and what is shuffled are the boxes and partial counts, one list over all settings for each frame and combination of later parameters. The grid is what is broadcast, never the data.

`classes`, `_run` and `_Sequence` are the plainer way, a run of the linker for each class of settings that must link alike; tests hold the bits against it."""

from __future__ import annotations

import os
import tempfile
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator
from itertools import product
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import metrics, smoothing
from .tracking import Linker, box_iou, by_sequence

#: The published grids of the tracker: base (150 settings), and whole (28,800). EACH has the base's with misses and post-filters, so every setting of the base too.
WHOLE = {"confidence": [0.1, 0.2, 0.25, 0.3, 0.4, 0.5], "max_area": [None, 0.05, 0.1, 0.15], "iou": [0.1, 0.2, 0.3, 0.4, 0.5], "max_misses": [0, 1, 2], "min_consecutive": [1, 2, 3, 4, 5], "min_mean_confidence": [None, 0.3, 0.4, 0.5], "min_area_change": [None, 1.0, 1.1, 1.2]}
BASE = WHOLE | {"max_area": [None], "max_misses": [0], "min_mean_confidence": [None], "min_area_change": [None]}
EACH = BASE | {"max_misses": [0, 1], "min_mean_confidence": [None, 0.4], "min_area_change": [None, 1.1]}
#: What tracker_sweep takes if no grid is given; not a published one.
SMALL = {"confidence": [0.3], "max_area": [None], "iou": [0.1, 0.2], "max_misses": [0, 1], "min_consecutive": [1, 2, 3, 4, 5], "min_mean_confidence": [None, 0.4], "min_area_change": [None, 1.1]}
MATCHING = ["confidence", "max_area", "iou", "max_misses"]
#: The published grid of change validation and tracker.
CHANGE = {"pixel_threshold": [3, 5, 7, 10, 15, 19, 25, 30, 40], "min_ratio": [0.001, 0.005, 0.01, 0.02, 0.05, 0.1], "confidence": [0.01, 0.1, 0.2, 0.3], "max_area": [None, 0.05, 0.1], "iou": [0.1, 0.2, 0.3], "max_misses": [0, 1], "min_consecutive": [1, 2, 3, 4, 5], "min_mean_confidence": [None], "min_area_change": [None]}
CHANGED = ["pixel_threshold", "min_ratio"]
AFTER = ["min_consecutive", "min_mean_confidence", "min_area_change"]
#: A frame for no alarm; how many lists of counts a kernel holds before it gives them up; and from how many ends of tracks on those that decide nothing are dropped.
NEVER, PENDING, ENDS = 2**31 - 1, 20_000, 20_000
#: A box as kernels hold it, or a frame without one; how many are read at once; and the bytes of a sequence that stay in memory, what is longer goes to a file of the task.
ROW = np.dtype([("at", "i8"), ("is_box", "?"), ("box", "f8", 5), ("ratio", "f8")])
TOGETHER, HELD = 4096, 4_000_000


def grid_rows(spark, grid: dict, names: list[str]) -> DataFrame:
    """All combinations of some parameters as rows; null means that a rule is off."""
    kinds = {"max_misses": "int", "min_consecutive": "int", "pixel_threshold": "int", "window": "int"}
    return spark.createDataFrame(list(product(*[grid[n] for n in names])), ", ".join(f"{n} {kinds.get(n, 'double')}" for n in names))


def filters_of(grid: dict) -> list[str]:
    """The parameters that say which boxes pass."""
    return [*(CHANGED if "min_ratio" in grid else []), "confidence", "max_area"]


def matching_of(grid: dict) -> list[str]:
    """The parameters of a matching setting; its number is its place among their combinations."""
    return [*filters_of(grid), "iou", "max_misses"]


def _run(frames: Iterable[tuple[int, list[tuple], list[float]]], iou: float, misses: int, longest: int, limits: dict[str, list[float]] | None = None) -> tuple[dict, float, int]:
    """One run of the linker: the least overlap it matched at, the longest gap it bridged, and before them of its tracks, by how many limits of mean confidence and area change they pass, the earliest frame at which a streak reached each length. A track is folded into these when it ends, so only live ones are held."""
    linker, tracks, least, gap = Linker(iou, misses), {}, float("inf"), 0
    limits, best = limits or {"min_mean_confidence": [], "min_area_change": []}, {}

    def end(x: dict) -> None:
        before, after = x["first"][2] * x["first"][3], x["last"][2] * x["last"][3]
        mean, grown = x["sum"] / x["n"], after / before if before > 0 else 0.0
        at = (sum(mean >= v for v in limits["min_mean_confidence"]), sum(grown >= v for v in limits["min_area_change"]))
        held = best.setdefault(at, [NEVER] * longest)
        for i, frame in enumerate(x["reached"]):
            if frame is None:
                break
            held[i] = min(held[i], frame)

    for step, (at, boxes, sure) in enumerate(frames):
        done = linker.step(boxes)
        for t, j, streak, overlap in done["hits"]:
            x = tracks.setdefault(t, {"sum": 0.0, "n": 0, "first": boxes[j], "step": step, "reached": [None] * longest})
            if overlap is not None:
                least, gap = min(least, overlap), max(gap, step - x["step"] - 1)
            x["sum"] += sure[j]
            x["n"] += 1
            x["last"], x["step"] = boxes[j], step
            if streak <= longest and x["reached"][streak - 1] is None:
                x["reached"][streak - 1] = at
        for t in done["pruned"]:
            end(tracks.pop(t))
    for x in tracks.values():
        end(x)
    return best, least, gap


def classes(limits: list[tuple[int, float, int]], run) -> list[tuple[list[int], dict]]:
    """Settings (number, iou, max_misses) that link alike, with what `_run` gives of the tracks they share. run: of iou and max_misses, as `_run` gives it."""
    left, out = sorted(limits, key=lambda x: (-x[2], x[1])), []
    while left:
        _, iou, misses = left[0]
        best, least, gap = run(iou, misses)
        same = [s for s in left if iou <= s[1] <= max(iou, least) and gap <= s[2] <= misses]
        out.append(([s[0] for s in same], best))
        left = [s for s in left if s not in same]
    return out


class _Lanes:
    """The matching settings of a grid (at one pixel threshold) as bits of a whole number, in the order of their numbers: which of them a box, an overlap and a gap pass in. Nothing that isn't a number passes a limit."""

    def __init__(self, grid: dict):
        self.names = [n for n in matching_of(grid) if n != "pixel_threshold"]
        self.settings = list(product(*[grid[n] for n in self.names]))
        self.n = len(self.settings)
        self.at_least = {c: self._steps(c) for c in ("min_ratio", "confidence", "iou") if c in self.names}
        self.least_iou, self.most_misses = min(grid["iou"]), max(grid["max_misses"])
        self.areas = sorted(v for v in set(grid["max_area"]) if v is not None)
        self.within = [self._where("max_area", lambda v: v is None or v in self.areas[k:]) for k in range(len(self.areas) + 1)]  # noqa: B023
        self.gaps = [self._where("max_misses", lambda v: v >= gap) for gap in range(self.most_misses + 1)]  # noqa: B023

    def _where(self, name: str, holds: Callable) -> int:
        place = self.names.index(name)
        return sum(1 << i for i, s in enumerate(self.settings) if holds(s[place]))

    def _steps(self, name: str) -> tuple[list[float], list[int]]:
        """Limits in order, and for each k the settings with one of the first k."""
        limits = sorted({s[self.names.index(name)] for s in self.settings})
        return limits, [self._where(name, lambda v: v in limits[:k]) for k in range(len(limits) + 1)]  # noqa: B023

    def reached(self, name: str, value: float) -> int:
        limits, masks = self.at_least[name]
        return masks[bisect_right(limits, value)] if value == value else 0

    def of_box(self, area: float, confidence: float, ratio: float) -> int:
        lanes = self.reached("confidence", confidence) & self.within[bisect_left(self.areas, area) if area == area else -1]
        return lanes & self.reached("min_ratio", ratio) if "min_ratio" in self.at_least else lanes


class _After:
    """Parameters that come after linking: their limits, and the combinations (by number) that a track passes with a streak of some length and so many limits of each kind."""

    def __init__(self, grid: dict):
        self.longest = max(grid["min_consecutive"])
        self.sure, self.grown = (sorted(v for v in set(grid[c]) if v is not None) for c in AFTER[1:])
        rank = lambda limits, v: 0 if v is None else limits.index(v) + 1
        needs = [(n, rank(self.sure, sure), rank(self.grown, grown)) for n, sure, grown in product(*[grid[c] for c in AFTER])]
        ranks = product(range(1, self.longest + 1), range(len(self.sure) + 1), range(len(self.grown) + 1))
        self.passed = {(n, a, b): [k for k, need in enumerate(needs) if need[0] == n and need[1] <= a and need[2] <= b] for n, a, b in ranks}


#: Places of a node, a track up to a box as some settings share it: those in which it ends here, its rank among births, streak, confidences added, boxes, area of the first and last, and the frames at which its streak reached 1, 2, ...
LANES, BORN, STREAK, SUM, COUNT, FIRST, LAST, REACHED = range(8)


class _Tracks:
    """The tracks of one sequence under all settings, frame by frame; holds the nodes that can still go on, and of those that ended what can still decide."""

    def __init__(self, lanes: _Lanes, after: _After):
        self.lanes, self.after, self.now, self.born = lanes, after, 0, 0
        self.live: list[tuple[int, tuple, list[list]]] = []
        self.ends: dict[tuple, int] = {}
        self.room = ENDS

    def step(self, at: int, boxes: list[tuple]) -> None:
        """One frame: boxes are (cx, cy, w, h, confidence, settings that keep it)."""
        lanes, longest, pairs = self.lanes, self.after.longest, []
        for step, box, nodes in self.live:
            alive = lanes.gaps[self.now - step - 1]
            for j, new in enumerate(boxes):
                if (overlap := box_iou(box, new)) >= lanes.least_iou and (may := alive & new[5] & lanes.reached("iou", overlap)):
                    pairs += [(-overlap, x[BORN], j, x, may, self.now - step) for x in nodes if x[LANES] & may]
        # as for one setting: best overlap first, then the older track, then the first box; nodes of one track share no setting
        pairs.sort(key=itemgetter(0, 1, 2))
        free, nodes = [b[5] for b in boxes], [[] for _ in boxes]
        for _, born, j, x, may, since in pairs:
            if taken := x[LANES] & free[j] & may:
                x[LANES] ^= taken
                free[j] ^= taken
                streak = x[STREAK] + 1 if since == 1 else 1
                reached = (*x[REACHED], at) if len(x[REACHED]) < streak <= longest else x[REACHED]
                nodes[j].append([taken, born, streak, x[SUM] + boxes[j][4], x[COUNT] + 1, x[FIRST], boxes[j][2] * boxes[j][3], reached])
        for j, new in enumerate(boxes):
            if free[j]:
                area = new[2] * new[3]
                nodes[j].append([free[j], self.born + j, 1, new[4], 1, area, area, (at,)])
        self.born += len(boxes)
        going = []
        for step, box, held in self.live:
            if self.now - step > lanes.most_misses:
                self._end(held)
            elif held := [x for x in held if x[LANES]]:
                going.append((step, box, held))
        self.live = going + [(self.now, new[:4], held) for new, held in zip(boxes, nodes) if held]
        self.now += 1

    def _end(self, nodes: list[list]) -> None:
        after, ends = self.after, self.ends
        for some, _, _, total, n, first, last, reached in nodes:
            if some:
                grown = last / first if first > 0 else 0.0
                sure, grown = sum(total / n >= v for v in after.sure), sum(grown >= v for v in after.grown)
                for streak, at in enumerate(reached, 1):
                    key = (at, streak, sure, grown)
                    ends[key] = ends.get(key, 0) | some
        if len(ends) > self.room:
            for _ in self._first():
                pass
            self.room = 2 * len(self.ends) + ENDS

    def _first(self) -> Iterator[tuple[int, int, int]]:
        """Combination of later parameters, frame and the settings that raise the alarm there first. Ends that come first for none are dropped."""
        covered: dict[int, int] = {}
        kept = {}
        for key in sorted(self.ends):
            some, first = self.ends[key], 0
            for later in self.after.passed[key[1:]]:
                before = covered.get(later, 0)
                if new := some & ~before:
                    covered[later] = before | new
                    first |= new
                    yield later, key[0], new
            if first:
                kept[key] = first
        self.ends = kept

    def alarms(self) -> Iterator[tuple[int, int, int]]:
        """After the last frame: combination of later parameters, frame, settings."""
        for _, _, nodes in self.live:
            self._end(nodes)
        self.live = []
        yield from self._first()


class _Counts:
    """Alarms counted by key and setting, as sums of a part of the data: the binary digits of all settings' counts are one whole number a place. Given up as batches, so that memory is bounded."""

    def __init__(self, n: int):
        self.n, self.digits = n, {}

    def add(self, key: tuple, lanes: int) -> None:
        digits = self.digits.setdefault(key, [])
        for i, digit in enumerate(digits):
            digits[i], lanes = digit ^ lanes, digit & lanes
            if not lanes:
                return
        digits.append(lanes)

    def batches(self) -> Iterator[pa.RecordBatch]:
        keys, size = list(self.digits), -(-self.n // 8)
        for at in range(0, len(keys), 1000):
            some, rows = keys[at : at + 1000], []
            for digits in map(self.digits.get, some):
                bits = np.frombuffer(b"".join(d.to_bytes(size, "little") for d in digits), np.uint8).reshape(-1, size)
                rows.append((1 << np.arange(len(digits))) @ np.unpackbits(bits, axis=1, count=self.n, bitorder="little"))
            counts = pa.ListArray.from_arrays(pa.array(np.arange(0, len(some) * self.n + 1, self.n), pa.int32()), pa.array(np.concatenate(rows), pa.int64()))
            yield pa.RecordBatch.from_arrays([*[pa.array(c, k) for c, k in zip(zip(*some), (pa.int32(), pa.int32(), pa.bool_(), pa.int32()))], counts], [*KEY, "counts"])
        self.digits = {}


#: What partial counts are summed by; part is the place of the pixel threshold, 0 without.
KEY = ["part", "later", "is_positive_gt", "trigger_frame_index"]


def _summed(n: int) -> Callable:
    """Lists of counts, sorted by key, added up: a row for each setting (of n a part) that has any."""

    def rows(keys: list[tuple], counts: list[np.ndarray]) -> pa.RecordBatch:
        which, lane = np.nonzero(np.stack(counts))
        part, later, positive, at = (np.array(c)[which] for c in zip(*keys))
        arrays = [pa.array(part * n + lane, pa.int32()), pa.array(later, pa.int32()), pa.array(positive), pa.array(at, pa.int32()), pa.array(np.stack(counts)[which, lane], pa.int64())]
        return pa.RecordBatch.from_arrays(arrays, ["setting", "later", "is_positive_gt", "trigger_frame_index", "n"])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = [], []
        for batch in batches:
            values = batch.column(4).flatten().to_numpy().reshape(-1, n)
            for key, some in zip(zip(*(batch.column(c).to_pylist() for c in range(4))), values):
                if keys and key == keys[-1]:
                    counts[-1] += some
                    continue
                if len(keys) * n > 200_000:
                    yield rows(keys, counts)
                    keys, counts = [], []
                keys.append(key)
                counts.append(some.copy())
        if keys:
            yield rows(keys, counts)

    return kernel


class _Sequence:
    """The rows of one sequence, written once and read through as often as settings need it, TOGETHER at a time."""

    def __init__(self):
        self.file = tempfile.SpooledTemporaryFile(HELD, dir=(os.environ.get("SPARK_LOCAL_DIRS") or tempfile.gettempdir()).split(",")[0])

    def add(self, rows: np.ndarray) -> None:
        self.file.write(rows.tobytes())

    def close(self) -> None:
        self.file.close()

    def blocks(self) -> Iterator[np.ndarray]:
        at = 0
        while True:
            self.file.seek(at)
            read = self.file.read(TOGETHER * ROW.itemsize)
            if not read:
                return
            at += len(read)
            yield np.frombuffer(read, ROW)

    def frames(self, passing: Callable[[np.ndarray], np.ndarray]) -> Iterator[tuple[int, list[tuple], list[float]]]:
        """All frames in order with the boxes that pass, and their confidence."""
        now, boxes, sure = None, [], []
        for rows in self.blocks():
            for at, passes, box in zip(rows["at"].tolist(), passing(rows).tolist(), rows["box"].tolist()):
                if at != now:
                    if now is not None:
                        yield now, boxes, sure
                    now, boxes, sure = at, [], []
                if passes:
                    boxes.append(tuple(box[:4]))
                    sure.append(box[4])
        if now is not None:
            yield now, boxes, sure


def setting_counts(frames: DataFrame, truth: DataFrame, grid: dict) -> DataFrame:
    """Alarms of every matching setting and combination of later parameters: setting, later (their numbers), is_positive_gt, trigger_frame_index (0 for false alarms), n.

    Sequences pass one at a time in sorted order, however long: a kernel holds one frame and the tracks that can go on. What leaves it are sums over a partition's sequences, a list over the settings for each key, not tracks; lists of a key are added up in a second step. With change parameters in the grid frames has `ratios` too, of each box, in the order of the grid's pixel thresholds, and a sequence is dealt once for each of these."""
    changed = "min_ratio" in filters_of(grid)
    lanes, after = _Lanes(grid), _After(grid)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, now, tracks, frame, boxes = _Counts(lanes.n), None, None, None, []

        def close() -> None:
            tracks.step(frame, boxes)
            _, part, positive = now
            for later, at, some in tracks.alarms():
                # the frame counts for true alarms only
                counts.add((part or 0, later, positive, at if positive else 0), some)

        for batch in batches:
            plain = lambda c: batch.column(c).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            keys = zip(*(batch.column(c).to_pylist() for c in range(3)))
            seen = batch.column(4).is_valid().to_pylist()
            numbers = zip(*(plain(c).astype(float).tolist() for c in range(5, 11)))
            for key, at, is_box, (cx, cy, w, h, confidence, ratio) in zip(keys, plain(3).tolist(), seen, numbers):
                if key != now:
                    if tracks:
                        close()
                        if len(counts.digits) > PENDING:
                            yield from counts.batches()
                    now, tracks, frame, boxes = key, _Tracks(lanes, after), at, []
                elif at != frame:
                    tracks.step(frame, boxes)
                    frame, boxes = at, []
                if is_box and (kept := lanes.of_box(w * h, confidence, ratio)):
                    boxes.append((cx, cy, w, h, confidence, kept))
        if tracks:
            close()
        yield from counts.batches()

    boxes = ["cx", "cy", "w", "h", "confidence"]
    known = frames.select("sequence_id", "frame_idx", "det_idx", *[F.col(c).cast("double").alias(c) for c in boxes], *(["ratios"] if changed else [])).join(truth.select("sequence_id", "is_positive_gt"), "sequence_id")
    if changed:
        unknown = F.array_repeat(F.lit(None).cast("double"), len(grid["pixel_threshold"]))
        known = known.select("*", F.posexplode(F.coalesce("ratios", unknown)).alias("part", "ratio"))
    else:
        known = known.withColumns({"part": F.lit(None).cast("int"), "ratio": F.lit(None).cast("double")})
    keys = ["sequence_id", "part", "is_positive_gt"]
    dealt = by_sequence(known.select(*keys, "frame_idx", "det_idx", *boxes, "ratio"), more=["part"] if changed else [])
    lists = dealt.sortWithinPartitions("sequence_id", "part", "frame_idx", "det_idx").mapInArrow(kernel, "part int, later int, is_positive_gt boolean, trigger_frame_index int, counts array<long>")
    return lists.repartition(*KEY).sortWithinPartitions(*KEY).mapInArrow(_summed(lanes.n), "setting int, later int, is_positive_gt boolean, trigger_frame_index int, n long")


def alarm_counts(found: DataFrame, truth: DataFrame, by: list[str]) -> DataFrame:
    """Alarms (sequence_id, by, trigger_frame_index) counted: by, is_positive_gt, trigger_frame_index, n."""
    return found.join(truth, "sequence_id").groupBy(*by, "is_positive_gt", "trigger_frame_index").agg(F.count("*").alias("n"))


def grid_metrics(alarms: DataFrame, truth: DataFrame, grid: DataFrame, by: list[str]) -> DataFrame:
    """Metrics of every setting from its alarms alone: sequences without an alarm are the truth's totals less those with one.

    alarms: as `alarm_counts` gives them; grid: the settings, so that one without any alarm has its row too."""
    totals = truth.agg(F.count_if("is_positive_gt").alias("pos"), F.count_if(~F.col("is_positive_gt")).alias("neg"))
    late = F.when(F.col("is_positive_gt"), F.col("trigger_frame_index"))
    held = lambda positive: F.sum(F.when(F.col("is_positive_gt") == positive, F.col("n")).otherwise(0))
    hit = alarms.groupBy(*by).agg(held(True).alias("tp"), held(False).alias("fp"), F.try_divide(F.sum(late * F.col("n")), held(True)).alias("mean_ttd"), F.percentile(late, 0.5, F.col("n")).alias("median_ttd"))
    conditions = [F.col(f"g.{c}").eqNullSafe(F.col(f"h.{c}")) for c in by]
    joined = grid.alias("g").join(hit.alias("h"), conditions, "left").select(*[F.col(f"g.{c}") for c in by], F.coalesce("h.tp", F.lit(0)).alias("tp"), F.coalesce("h.fp", F.lit(0)).alias("fp"), "h.mean_ttd", "h.median_ttd")
    counted = joined.crossJoin(F.broadcast(totals)).withColumn("fn", F.col("pos") - F.col("tp")).withColumn("tn", F.col("neg") - F.col("fp")).drop("pos", "neg")
    return metrics.with_rates(counted)


def _swept(frames: DataFrame, truth: DataFrame, grid: dict) -> DataFrame:
    names = matching_of(grid)
    counts = setting_counts(frames, truth, grid)
    spark = frames.sparkSession

    def numbered(number: str, of: list[str]) -> DataFrame:
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in grid_rows(spark, grid, of).schema)
        return F.broadcast(spark.createDataFrame([(i, *p) for i, p in enumerate(product(*[grid[n] for n in of]))], f"{number} int, {kinds}"))

    named = counts.join(numbered("setting", names), "setting").join(numbered("later", AFTER), "later")
    return grid_metrics(named, truth, grid_rows(spark, grid, [*names, *AFTER]), [*names, *AFTER])


def tracker_sweep(frames: DataFrame, truth: DataFrame, grid: dict | None = None) -> DataFrame:
    """Metrics of every combination of the tracker's parameters."""
    return _swept(frames, truth, grid or SMALL)


def change_sweep(ratios: DataFrame, slots: DataFrame, truth: DataFrame, grid: dict = CHANGE) -> DataFrame:
    """Tracker sweep over change-validated detections at each pixel threshold (those of ratios hold the grid's) and minimum ratio. slots: all frames of each sequence."""
    keys = ["sequence_id", "frame_idx", "det_idx"]
    boxes = ["cx", "cy", "w", "h", "confidence"]
    at = lambda t: F.max(F.when(F.col("pixel_threshold") == t, F.col("change_ratio")))
    each = ratios.groupBy(*keys).agg(*[F.any_value(c).alias(c) for c in boxes], F.array(*[at(t) for t in grid["pixel_threshold"]]).alias("ratios"))
    return _swept(slots.select(*keys[:2]).join(each, keys[:2], "left"), truth, grid)


def smoothing_sweep(detections: DataFrame, truth: DataFrame, windows: list[int], thresholds: list[float]) -> DataFrame:
    """Sliding-window metrics of each window and threshold: one join for all windows, thresholds on its result."""
    spark = detections.sparkSession
    smooth = smoothing.smoothed_windows(detections, windows)
    limits = F.broadcast(spark.createDataFrame([(t,) for t in thresholds], "threshold double"))
    found = smooth.crossJoin(limits).where(F.col("smoothed") > F.col("threshold")).groupBy("sequence_id", "window", "threshold").agg(F.min("frame_idx").alias("trigger_frame_index"))
    return grid_metrics(alarm_counts(found, truth, ["window", "threshold"]), truth, grid_rows(spark, {"window": windows, "threshold": thresholds}, ["window", "threshold"]), ["window", "threshold"])


def ablation(frames: DataFrame, truth: DataFrame, confidence: float = 0.3, iou: float = 0.1, min_consecutive: int = 3, max_misses: int = 1, min_mean_confidence: float = 0.4, min_area_change: float = 1.1) -> DataFrame:
    """Metrics of the eight on and off combinations of the gap, confidence and area rules, with a label."""
    grid = {"confidence": [confidence], "max_area": [None], "iou": [iou], "max_misses": [0, max_misses], "min_consecutive": [min_consecutive], "min_mean_confidence": [None, min_mean_confidence], "min_area_change": [None, min_area_change]}
    rules = F.concat_ws("+", F.when(F.col("max_misses") > 0, "gap"), F.when(F.col("min_mean_confidence").isNotNull(), "confidence"), F.when(F.col("min_area_change").isNotNull(), "area"))
    return tracker_sweep(frames, truth, grid).withColumn("rules", F.when(rules == "", "none").otherwise(rules))


def variant_report(tables: dict[str, DataFrame]) -> DataFrame:
    """Result tables of several simulations (each with a `setting` text and tp, fp, fn, tn) as one, ranked by f1 within each and over all."""
    from pyspark.sql.window import Window

    united = None
    for name, df in tables.items():
        one = metrics.with_rates(df.select("setting", "tp", "fp", "fn", "tn")).withColumn("analysis", F.lit(name))
        united = one if united is None else united.unionByName(one)
    best = Window.orderBy(F.desc("f1"), F.desc("precision"), "analysis", "setting")
    return united.withColumn("rank", F.row_number().over(best)).withColumn("is_recommended", F.col("rank") == 1)
