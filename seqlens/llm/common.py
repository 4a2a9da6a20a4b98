"""What the operators share: reading tables, cutting lineage, carrying decisions back to rows."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, wherever a word is counted or hashed: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


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


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as a Parquet table in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def without_ids(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of docs, all columns kept, but for those whose key is in ids (one column). Null keys stay."""
    mine, other = docs.alias("kept_rows"), ids.toDF("__dropped_key").distinct()
    return mine.join(other, F.col(f"kept_rows.{key}") == F.col("__dropped_key"), "left_anti")


def slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 21):
    """Cut a batch into parts of at most `limit` bytes of text, a longer text alone; null text is empty."""
    texts = pc.fill_null(batch.column(column).cast(pa.large_string()), "")
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    begin, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield batch.slice(begin, i - begin), texts.slice(begin, i - begin)
            begin, held = i, 0
        held += n
    if begin < len(sizes):
        yield batch.slice(begin), texts.slice(begin)
