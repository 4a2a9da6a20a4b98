"""The test tables in the roles of the data model: views for queries, and the same as SQL for the twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

N_FRAMES = 30


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events")
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("int")
    return rows.select("event_id", F.col("user_id").alias("sequence_id"), day.alias("frame_idx"), "ts", "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))


def detections(spark: SparkSession, d: str) -> DataFrame:
    """One box for each event; the number of a box in its frame follows event_id."""
    from pyspark.sql.window import Window

    by = Window.partitionBy("sequence_id", "frame_idx").orderBy("event_id")
    rows = events(spark, d).withColumn("det_idx", (F.row_number().over(by) - 1).cast("int"))
    num = lambda c: F.col(c).cast("double")
    return rows.select("sequence_id", "frame_idx", "det_idx", "ts", F.lit(0).alias("class_id"), ((20 + num("k") * 0.6) / 100).alias("cx"), ((40 + num("event_id") % 21) / 100).alias("cy"), ((10 + num("event_id") % 11) / 100).alias("w"), ((10 + num("event_id") % 7) / 100).alias("h"), (F.least("value", F.lit(100.0)) / 100).alias("confidence"))


def sequences(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").alias("sequence_id")).distinct()


def slots(spark: SparkSession, d: str) -> DataFrame:
    """All frames of each sequence, empty ones too."""
    return sequences(spark, d).withColumn("frame_idx", F.explode(F.sequence(F.lit(0), F.lit(N_FRAMES - 1))))


def frames(spark: SparkSession, d: str, min_confidence: float = 0.0, max_area: float | None = None) -> DataFrame:
    """Long form: detections that pass, and a row of nulls for a frame without any."""
    kept = detections(spark, d).where(F.col("confidence") >= min_confidence)
    if max_area is not None:
        kept = kept.where(F.col("w") * F.col("h") <= max_area)
    return slots(spark, d).join(kept, ["sequence_id", "frame_idx"], "left")


def truth(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).groupBy("sequence_id").agg((F.count_if(F.col("event_type") == "error") >= 13).alias("is_positive_gt"))


def predictions(spark: SparkSession, d: str) -> DataFrame:
    n = F.count_if(F.col("value") >= 60)
    rows = events(spark, d).groupBy(F.col("event_type").alias("model_name"), "sequence_id")
    return rows.agg((n >= 4).alias("is_positive"), F.when(n >= 4, F.min(F.when(F.col("value") >= 60, F.col("frame_idx")))).alias("trigger_frame_index"), F.count_if(F.col("value") >= 5).alias("num_detections_total"))


def results(spark: SparkSession, d: str) -> DataFrame:
    return predictions(spark, d).join(truth(spark, d), "sequence_id")


def scored(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", "lang", "n_chars").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    return rows.select(F.col("lang").alias("variant"), F.col("doc_id").alias("sample_id"), F.col("quality").cast("int").alias("truth"), ((F.col("n_chars") % 997) / 997.0).alias("prob"))


def tubes(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", 0).when(F.col("event_type") == "error", 1).when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "signup", 3).otherwise(4)
    rows = events(spark, d).groupBy("sequence_id", kind.alias("tube_id"))
    return rows.agg(F.count("*").alias("n"), F.min("frame_idx").alias("start_frame"), F.max("frame_idx").alias("end_frame"), F.count_distinct("frame_idx").cast("int").alias("n_observed"), ((F.sum("k") / F.count("*").cast("double") - 50) / 5).alias("logit")).where("n >= 14").drop("n")


def tube_entries(spark: SparkSession, d: str) -> DataFrame:
    """Entries of those tubes: the first event of a day, and gaps for the days between."""
    kind = F.when(F.col("event_type") == "click", 0).when(F.col("event_type") == "error", 1).when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "signup", 3).otherwise(4)
    num = lambda c: F.col(c).cast("double")
    seen = events(spark, d).withColumn("tube_id", kind).groupBy("sequence_id", "tube_id", "frame_idx").agg(F.min_by(F.struct("event_id", "k", "value"), "event_id").alias("e")).select("sequence_id", "tube_id", "frame_idx", "e.*")
    seen = seen.select("sequence_id", "tube_id", "frame_idx", F.lit(0).alias("class_id"), ((20 + num("k") * 0.6) / 100).alias("cx"), ((40 + num("event_id") % 21) / 100).alias("cy"), ((10 + num("event_id") % 11) / 100).alias("w"), ((10 + num("event_id") % 7) / 100).alias("h"), (F.least("value", F.lit(100.0)) / 100).alias("confidence"), "k")
    cells = tubes(spark, d).select("sequence_id", "tube_id", F.explode(F.sequence("start_frame", "end_frame")).alias("frame_idx"))
    return cells.join(seen, ["sequence_id", "tube_id", "frame_idx"], "left").withColumn("is_gap", F.col("cx").isNull())


def labelled_sequences(spark: SparkSession, d: str) -> DataFrame:
    return truth(spark, d).select("sequence_id", F.when(F.col("is_positive_gt"), "smoke").otherwise("fp").alias("label"))


def tags(spark: SparkSession, d: str) -> DataFrame:
    """Review tags of documents: dataset, stem, tags, by the id; some misspelt, some empty, one row in 97 a seed."""
    pool = F.array(*map(F.lit, ["label:add-smoke", "label:ok", "lable:ok", "status:unclear", "reviewer:ana", "label:fix-bbox", "label:fix_bbox", "reviewer:bo"]))
    one = lambda m, a: F.get(pool, ((F.col("doc_id") * m + a) % 8).cast("int"))
    chosen = F.when(F.col("doc_id") % 5 == 0, F.array().cast("array<string>")).when(F.col("doc_id") % 97 == 1, F.array(F.lit("system:vocab-seed"), one(1, 0))).when(F.col("doc_id") % 3 == 0, F.array(one(1, 0), one(3, 1), one(1, 0))).otherwise(F.array(one(1, 0)))
    split = F.when(F.col("doc_id") % 4 == 0, "val").otherwise("train")
    return table(spark, d, "documents").select("doc_id", F.concat(F.lit("dq-frame_"), "lang", F.lit("_"), split).alias("dataset"), F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("stem"), chosen.alias("tags"))


def lines(spark: SparkSession, d: str) -> DataFrame:
    """Label lines printed from events: sequence_id, stem (day), line of 5, 6 or 4 columns, or not numeric."""
    rows = events(spark, d)
    sixth = F.format_string(" 0.%02d", F.floor(F.least("value", F.lit(99.0))).cast("int"))
    text = F.concat(F.lit("0 0."), F.lpad(F.col("k").cast("string"), 2, "0"), F.lit(" 0."), (F.col("event_id") % 21 + 40).cast("string"), F.lit(" 0.1 0."), (F.col("event_id") % 7 + 10).cast("string"))
    line = F.when(F.col("event_id") % 7 == 0, F.concat(text, sixth)).when(F.col("event_id") % 7 == 1, F.concat(F.lit("x"), text)).when(F.col("event_id") % 7 == 2, F.substring_index(text, " ", 4)).when(F.col("event_id") % 7 == 3, F.concat(F.lit("1.0"), F.substring(text, 2, 100), sixth)).otherwise(text)
    return rows.select("event_id", "sequence_id", F.col("frame_idx").alias("stem"), line.alias("line"))


def rasters(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as grey frames of 8 x 8; those of one label are a sequence."""
    from pyspark.sql.window import Window

    px = F.transform("embedding", lambda v: F.floor((F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v.cast("double"))) + 1) * 127.5).cast("int"))
    rows = table(spark, d, "embeddings").select(F.col("label").alias("sequence_id"), "vec_id", px.alias("px"), F.lit(8).alias("height"), F.lit(8).alias("width"))
    return rows.withColumn("frame_idx", (F.row_number().over(Window.partitionBy("sequence_id").orderBy("vec_id")) - 1).cast("int"))


def raster_boxes(spark: SparkSession, d: str) -> DataFrame:
    """One box for each raster frame, by its vec_id."""
    v = F.col("vec_id").cast("double")
    return rasters(spark, d).select("sequence_id", "frame_idx", F.lit(0).alias("det_idx"), F.lit(0).alias("class_id"), ((25 + v % 50) / 100).alias("cx"), ((30 + v % 37) / 100).alias("cy"), ((20 + v % 31) / 100).alias("w"), ((20 + v % 29) / 100).alias("h"), ((v % 100) / 100).alias("confidence"))


KIND = "CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END"
BOX = "(20 + k * 6e-1) / 100e0 AS cx, (40 + event_id % 21) / 100e0 AS cy, (10 + event_id % 11) / 100e0 AS w, (10 + event_id % 7) / 100e0 AS h, least(value, 100e0) / 100e0 AS confidence"
#: The views above for DuckDB, each after those it needs.
SQL = {
    "v_event": "SELECT event_id, user_id AS sequence_id, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INT) AS frame_idx, ts, event_type, value, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events",
    "v_det": f"SELECT sequence_id, frame_idx, CAST(row_number() OVER (PARTITION BY sequence_id, frame_idx ORDER BY event_id) - 1 AS INT) AS det_idx, ts, 0 AS class_id, {BOX} FROM v_event",
    "v_seq": "SELECT DISTINCT sequence_id FROM v_event",
    "v_slot": f"SELECT sequence_id, CAST(f AS INT) AS frame_idx FROM v_seq, range({N_FRAMES}) t(f)",
    "v_gt": "SELECT sequence_id, count(*) FILTER (event_type = 'error') >= 13 AS is_positive_gt FROM v_event GROUP BY 1",
    "v_pred": "SELECT event_type AS model_name, sequence_id, count(*) FILTER (value >= 60) >= 4 AS is_positive, CASE WHEN count(*) FILTER (value >= 60) >= 4 THEN min(frame_idx) FILTER (value >= 60) END AS trigger_frame_index, count(*) FILTER (value >= 5) AS num_detections_total FROM v_event GROUP BY 1, 2",
    "v_result": "SELECT p.*, g.is_positive_gt FROM v_pred p JOIN v_gt g USING (sequence_id)",
    "v_scored": "SELECT d.lang AS variant, d.doc_id AS sample_id, CAST(l.quality AS INT) AS truth, (d.n_chars % 997) / 997e0 AS prob FROM documents d JOIN labels l ON d.doc_id = l.doc_id",
    "v_tube": f"SELECT sequence_id, CAST({KIND} AS INT) AS tube_id, min(frame_idx) AS start_frame, max(frame_idx) AS end_frame, CAST(count(DISTINCT frame_idx) AS INT) AS n_observed, (sum(k) / CAST(count(*) AS DOUBLE) - 50e0) / 5e0 AS logit FROM v_event GROUP BY sequence_id, event_type HAVING count(*) >= 14",
    "v_entry": f"SELECT c.sequence_id, c.tube_id, c.frame_idx, 0 AS class_id, s.cx, s.cy, s.w, s.h, s.confidence, s.k, s.cx IS NULL AS is_gap FROM (SELECT sequence_id, tube_id, CAST(unnest(range(start_frame, end_frame + 1)) AS INT) AS frame_idx FROM v_tube) c LEFT JOIN (SELECT sequence_id, CAST({KIND} AS INT) AS tube_id, frame_idx, {BOX}, k FROM v_event QUALIFY row_number() OVER (PARTITION BY sequence_id, event_type, frame_idx ORDER BY event_id) = 1) s USING (sequence_id, tube_id, frame_idx)",
    "v_label": "SELECT sequence_id, CASE WHEN is_positive_gt THEN 'smoke' ELSE 'fp' END AS label FROM v_gt",
    "v_tag": "SELECT doc_id, 'dq-frame_' || lang || '_' || CASE WHEN doc_id % 4 = 0 THEN 'val' ELSE 'train' END AS dataset, 's' || doc_id AS stem, CASE WHEN doc_id % 5 = 0 THEN CAST([] AS VARCHAR[]) WHEN doc_id % 97 = 1 THEN ['system:vocab-seed', pool[doc_id % 8 + 1]] WHEN doc_id % 3 = 0 THEN [pool[doc_id % 8 + 1], pool[(doc_id * 3 + 1) % 8 + 1], pool[doc_id % 8 + 1]] ELSE [pool[doc_id % 8 + 1]] END AS tags FROM documents, (SELECT ['label:add-smoke', 'label:ok', 'lable:ok', 'status:unclear', 'reviewer:ana', 'label:fix-bbox', 'label:fix_bbox', 'reviewer:bo'] AS pool)",
    "v_text": "SELECT event_id, sequence_id, frame_idx AS stem, '0 0.' || lpad(CAST(k AS VARCHAR), 2, '0') || ' 0.' || (event_id % 21 + 40) || ' 0.1 0.' || (event_id % 7 + 10) AS text, ' 0.' || lpad(CAST(CAST(floor(least(value, 99e0)) AS INT) AS VARCHAR), 2, '0') AS sixth FROM v_event",
    "v_line": "SELECT event_id, sequence_id, stem, CASE event_id % 7 WHEN 0 THEN text || sixth WHEN 1 THEN 'x' || text WHEN 2 THEN array_to_string(string_split(text, ' ')[1:4], ' ') WHEN 3 THEN '1.0' || text[2:] || sixth ELSE text END AS line FROM v_text",
    "v_raster": "SELECT label AS sequence_id, vec_id, list_transform(embedding, lambda v: CAST(floor((greatest(-1e0, least(1e0, CAST(v AS DOUBLE))) + 1e0) * 127.5e0) AS INT)) AS px, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INT) AS frame_idx FROM embeddings",
    "v_rbox": "SELECT sequence_id, frame_idx, (25 + vec_id % 50) / 100e0 AS cx, (30 + vec_id % 37) / 100e0 AS cy, (20 + vec_id % 31) / 100e0 AS w, (20 + vec_id % 29) / 100e0 AS h, (vec_id % 100) / 100e0 AS confidence FROM v_raster",
}


def sql(body: str) -> str:
    """body with the views that it names, and those that they need, in front."""
    import re

    wanted: set[str] = set()
    queue = [body]
    while queue:
        for name in set(re.findall(r"\bv_\w+", queue.pop())) & SQL.keys() - wanted:
            wanted.add(name)
            queue.append(SQL[name])
    views = ", ".join(f"{k} AS ({v})" for k, v in SQL.items() if k in wanted)
    if not views:
        return body
    return f"WITH {views}, {body[5:]}" if body.startswith("WITH ") else f"WITH {views} {body}"
