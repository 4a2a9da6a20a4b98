"""Queries: camera streams and models (H1, H3, H4, L1, L3)."""

from __future__ import annotations

import math
import tempfile
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import models
from ..streaming import cameras
from . import adapters as A
from .curves import RETURNED, metrics_sql
from .greedy_sql import confident, hits_sql
from .registry import query, rounded
from .sequences import smooth_sql


CAMERAS = 32
#: Cameras that share a state value in the replays below.
TOGETHER = 64


def camera_frames(spark: SparkSession, d: str) -> DataFrame:
    """Each day's boxes of a user as a camera frame."""
    rows = A.detections(spark, d).groupBy(F.col("sequence_id").alias("camera"), "frame_idx")
    return rows.agg(F.min("ts").cast("timestamp").alias("ts"), F.array_sort(F.collect_list(F.struct("det_idx", "cx", "cy", "w", "h", "confidence"))).alias("detections")).select("camera", F.concat_ws("_", "camera", F.lpad(F.col("frame_idx").cast("string"), 3, "0")).alias("frame_id"), "ts", "detections")


def groups(spark: SparkSession, d: str) -> int:
    """So many that TOGETHER cameras share one."""
    return max(1, A.sequences(spark, d).count() // TOGETHER)


def streamed(spark: SparkSession, frames: DataFrame, make, arrival: str = "arrival") -> DataFrame:
    """Replay frames through a streaming operator, those of one arrival (0, 1, ...) after another; the rows it appended. Every arrival is a run of its own that starts from the checkpoint of the one before."""
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    frames.write.partitionBy(arrival).parquet(f"{base}/all")
    rows = spark.read.parquet(f"{base}/all")
    # a state partition for each CAMERAS cameras: state is small, its workers are not
    before = spark.conf.get("spark.sql.shuffle.partitions")
    wanted = rows.select("camera").distinct().count() // CAMERAS
    spark.conf.set("spark.sql.shuffle.partitions", str(max(1, min(int(before), wanted))))
    try:
        _arrivals(spark, rows, frames, make, arrival, base)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    return spark.read.parquet(f"{base}/out")


def _arrivals(spark: SparkSession, rows: DataFrame, frames: DataFrame, make, arrival: str, base: str) -> None:
    for (at,) in rows.select(arrival).distinct().orderBy(arrival).collect():
        rows.where(F.col(arrival) == at).drop(arrival).write.mode("append").parquet(f"{base}/in")
        source = spark.readStream.schema(frames.drop(arrival).schema).parquet(f"{base}/in")
        sink = make(source).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode("append")
        sink.trigger(availableNow=True).start().awaitTermination()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset and all runs on one machine (tests) a new local one."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def arriving(spark: SparkSession, d: str, repeats: bool = False) -> DataFrame:
    """Camera frames in four arrivals: ten days each, one frame in 11 ten days late; with repeats, one in 3 again ten days later."""
    day = F.substring_index("frame_id", "_", -1).cast("int")
    late = ((F.col("camera") + day) % 11 == 0).cast("int")
    rows = camera_frames(spark, d).withColumn("arrival", F.least(F.lit(3), (F.floor(day / 10) + late).cast("int")))
    again = rows.where((F.col("camera") + day) % 3 == 0).withColumn("arrival", F.least(F.lit(3), F.col("arrival") + 1))
    return rows.unionByName(again) if repeats else rows


FRAME = "SELECT sequence_id AS camera, frame_idx AS day, sequence_id || '_' || lpad(CAST(frame_idx AS VARCHAR), 3, '0') AS frame_id, min(ts) AS ts, least(3, frame_idx // 10 + CASE WHEN (sequence_id + frame_idx) % 11 = 0 THEN 1 ELSE 0 END) AS arrival FROM v_det GROUP BY 1, 2"


def late_sql(frames: str, least: str) -> str:
    """Frames with is_late: older by more than `least` microseconds than the newest of their camera that arrived before."""
    return f"""SELECT f.*, coalesce(epoch_us(f.ts) < e.newest - {least}, false) AS is_late FROM ({frames}) f
    LEFT JOIN (SELECT a.camera, a.arrival, max(epoch_us(b.ts)) AS newest FROM (SELECT DISTINCT camera, arrival FROM ({frames})) a JOIN ({frames}) b ON b.camera = a.camera AND b.arrival < a.arrival GROUP BY 1, 2) e
    ON e.camera = f.camera AND e.arrival = f.arrival"""


LATE = late_sql(FRAME, "0")
ON_TIME = f"(SELECT camera AS sequence_id, CAST(day AS INT) AS frame_idx FROM ({LATE}) WHERE NOT is_late)"
CAMERA_HITS = hits_sql(f"(SELECT d.* FROM {confident('0.3e0')} d JOIN {ON_TIME} o ON o.sequence_id = d.sequence_id AND o.frame_idx = d.frame_idx)", '0.1e0', '1', ON_TIME)


@query(f"""SELECT sequence_id AS camera, 'confirmed' AS kind, track_id, sequence_id || '_' || lpad(CAST(min(frame_idx) AS VARCHAR), 3, '0') AS frame_id FROM ({CAMERA_HITS}) WHERE streak >= 2 GROUP BY 1, 3
UNION ALL SELECT camera, 'late', NULL, frame_id FROM ({LATE}) WHERE is_late""")
def h1_stream_tracker(spark, d):
    n = groups(spark, d)
    found = streamed(spark, arriving(spark, d), lambda s: cameras.track_stream(s, 0.1, 1, 2, 0.3, idle="40 days", groups=n))
    return found.select("camera", "kind", "track_id", "frame_id")


SESSIONS = "SELECT camera, ts, day, frame_id, sum(cut) OVER (PARTITION BY camera ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session_id FROM (SELECT camera, ts, day, frame_id, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY camera ORDER BY ts)) >= 172800000000 THEN 1 ELSE 0 END AS cut FROM ({frames}))"
ALL_FRAMES = SESSIONS.format(frames=FRAME)


@query(f"SELECT camera, CAST(day AS INT) AS day, CAST(session_id AS INT) AS session_id FROM ({ALL_FRAMES})")
def h3_sessions_batch(spark, d):
    found = cameras.sessions_batch(camera_frames(spark, d), 172_800)
    return found.select("camera", F.substring_index("frame_id", "_", -1).cast("int").alias("day"), "session_id")


@query(f"SELECT camera, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, count(*) AS n_frames FROM ({ALL_FRAMES}) GROUP BY camera, session_id")
def h3_session_window(spark, d):
    found = cameras.sessions(camera_frames(spark, d), "2 days")
    return found.select("camera", F.date_format("started", "yyyy-MM-dd HH:mm:ss").alias("started"), "n_frames")


@query(f"SELECT camera, frame_id, CAST(session_id AS INT) AS session_id FROM ({SESSIONS.format(frames=f'SELECT * FROM ({LATE}) WHERE NOT is_late')}) UNION ALL SELECT camera, frame_id, NULL FROM ({LATE}) WHERE is_late")
def h3_session_stream(spark, d):
    n = groups(spark, d)
    found = streamed(spark, arriving(spark, d), lambda s: cameras.session_stream(s, "2 days", idle="40 days", groups=n))
    return found.select("camera", "frame_id", "session_id")


TWICE = f"SELECT * FROM ({FRAME}) UNION ALL SELECT camera, day, frame_id, ts, least(3, arrival + 1) FROM ({FRAME}) WHERE (camera + day) % 3 = 0"


@query(f"""SELECT camera, CAST(sum(least(on_time, 1)) AS BIGINT) AS n_kept, CAST(sum(greatest(on_time - 1, 0)) AS BIGINT) AS n_repeated, CAST(sum(late) AS BIGINT) AS n_late
FROM (SELECT camera, frame_id, count(*) FILTER (NOT is_late) AS on_time, count(*) FILTER (is_late) AS late FROM ({late_sql(TWICE, '172800000000')}) GROUP BY 1, 2) GROUP BY 1""")
def h4_late_and_repeated(spark, d):
    n = groups(spark, d)
    found = streamed(spark, arriving(spark, d, repeats=True), lambda s: cameras.judged_stream(s, "2 days", idle="40 days", groups=n))
    return found.groupBy("camera").agg(*[F.count_if(F.col("verdict") == v).alias(f"n_{v}") for v in ("kept", "repeated", "late")])


SURE = confident("0.3e0")
MODELS = f"""SELECT 'tracker' AS model_name, sequence_id, min(frame_idx) FILTER (streak >= 3) AS first FROM ({hits_sql(SURE, '0.1e0', '1')}) GROUP BY 2
UNION ALL SELECT 'sliding-window', sequence_id, min(frame_idx) FROM ({smooth_sql(8, SURE)}) WHERE smoothed > 0.3e0 GROUP BY 2
UNION ALL SELECT 'any-box', sequence_id, min(frame_idx) FROM {SURE} GROUP BY 2"""
JUDGED = f"""(SELECT m.model_name, g.sequence_id, g.is_positive_gt, p.first IS NOT NULL AS is_positive, p.first AS trigger_frame_index FROM v_gt g CROSS JOIN (SELECT unnest(['tracker', 'sliding-window', 'any-box']) AS model_name) m
LEFT JOIN ({MODELS}) p ON p.sequence_id = g.sequence_id AND p.model_name = m.model_name)"""


@query(f"SELECT {RETURNED} FROM ({metrics_sql(JUDGED)})")
def l1_evaluate_models(spark, d):
    def any_box(rows: pd.DataFrame) -> tuple[bool, int | None, str]:
        seen = rows[rows["det_idx"].notna()]
        return bool(len(seen)), int(seen["frame_idx"].min()) if len(seen) else None, "{}"

    registry = models.Registry()
    registry.makers |= models.REGISTRY.makers
    registry.register("any-box", lambda: models.PythonModel(any_box))
    return rounded(registry.evaluate(A.frames(spark, d, 0.3), A.truth(spark, d), ["tracker", "sliding-window", "any-box"])[1])


@query("SELECT sequence_id, frame_idx, round(1 / (1 + exp(-sum(confidence * w * h))), 6) AS score FROM v_det GROUP BY 1, 2")
def l3_score_frames(spark, d):
    rows = A.detections(spark, d).groupBy("sequence_id", "frame_idx").agg(F.array_sort(F.collect_list(F.struct("det_idx", (F.col("confidence") * F.col("w") * F.col("h")).alias("part")))).getField("part").alias("parts"))

    def in_order(parts) -> float:
        total = 0.0
        for x in parts:
            total += float(x)
        return 1 / (1 + math.exp(-total))

    def load():
        return lambda batch: pd.DataFrame({"sequence_id": batch["sequence_id"], "frame_idx": batch["frame_idx"], "score": [in_order(x) for x in batch["parts"]]})

    return rounded(models.score_frames(rows, load, "sequence_id long, frame_idx int, score double"))
