"""Mixing sources to target weights by weighted fair queueing (operator 2). DataFrame operations only.

Documents of a source stand in shuffled order (a hash of seed and id); each has as virtual finish time its source's words so far divided by the source's target. All finish times are range-sorted and the mix is cut where the budget is used up.
A source whose target is above its size is gone through again, at most three times. Sources in code point order (null last) weigh 5, 2, 1, repeating; a target stops at three times its source's size and the excess is shared again by weight.
Null text has size 0. Rows that repeat an id (or null) are documents of their own: their hash takes in source, size, text and, of equal rows, the copy's number, so that they spread over the queue; all that the mix takes is counted by row. Ties in the hash go by id, size and row. An empty table gives an empty mix.

Plan. Texts are read once, for their sizes. Cumulative sums never put a source into one task: the hash is cut into buckets, bucket sums give offsets, and a window runs inside a source's bucket. The cut is found in three steps of the same kind: sums by bucket of finish time, then by finer bucket, then row by row in the one bucket that the budget ends in.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, written

WEIGHTS = (5, 2, 1)
MOST = 3
#: Buckets of the finish time, and of each of these.
STEPS = 4096
_SO_FAR = (Window.unboundedPreceding, Window.currentRow)


def targets(sizes: dict, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, share: float = 1.0) -> dict:
    """Target of each source: shares of the budget by weight, none above `most` times its size, the excess shared again by weight."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    budget, full, out = share * sum(sizes.values()), {}, {}
    while True:
        free = [s for s in order if s not in full]
        rest, total = budget - sum(full.values()), sum(weight[s] for s in free)
        out = full | {s: rest * weight[s] / total for s in free}
        over = {s: float(most * sizes[s]) for s in free if out[s] > most * sizes[s]}
        if not over:
            return out
        full |= over


def sized(docs: DataFrame, row: F.Column | None = None) -> DataFrame:
    """row (a number of its own), doc_id, source, size and same (a hash of these three and the text) of each row."""
    row = F.monotonically_increasing_id() if row is None else row
    source, size = F.col("source").cast("string"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(row.alias("row"), "doc_id", source.alias("source"), size.alias("size"), F.xxhash64("doc_id", source, size, "text").alias("same"))


def shuffled(rows: DataFrame, seed: int) -> DataFrame:
    """rows with h, the hash they are shuffled by: of the id where no other row has it, else of all of the row and the number of the copy.

    Copies are numbered without one task for a group: within a partition of the table (the upper bits of row), from where its count in the partitions before ends. Which copy has which number makes no difference, so h doesn't depend on how the table is split."""
    again = rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("of"))
    same_id = F.col("doc_id").eqNullSafe(F.col("of"))
    alone = rows.join(again, same_id, "left_anti").withColumn("h", F.xxhash64(F.lit(seed), "doc_id"))
    more = rows.join(again, same_id, "left_semi").withColumn("part", F.shiftright("row", 33))
    held = more.groupBy("same", "part").agg(F.count("*").alias("n"))
    before = held.withColumn("before", F.sum("n").over(Window.partitionBy("same").orderBy("part").rowsBetween(*_SO_FAR)) - F.col("n")).drop("n")
    numbered = more.withColumn("nth", F.row_number().over(Window.partitionBy("same", "part").orderBy("row"))).join(before, ["same", "part"])
    return alone.drop("same").unionByName(numbered.withColumn("h", F.xxhash64(F.lit(seed), "same", F.col("before") + F.col("nth"))).select("row", "doc_id", "source", "size", "h"))


def _cut(ahead: DataFrame, budget: float) -> tuple[float, float]:
    """Of rows (step, size): the step in which the running sum passes the budget, and the sum before it; the last step if none does."""
    sums = ahead.groupBy("step").agg(F.sum("size").alias("size"))
    run = sums.withColumn("upto", F.sum("size").over(Window.orderBy("step").rowsBetween(*_SO_FAR)))
    row = run.where(F.col("upto") > budget).orderBy("step").select("step", F.col("upto") - F.col("size")).first()
    return (row[0], row[1]) if row else (None, 0)


def mixed(documents: DataFrame, share: float = 1.0, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """Of documents as `sized` gives them, (sizes, mix): sizes has row, doc_id, source, size, source_size, target of each; mix has a row for each time a document is taken, range-sorted by finish time: finish, row, doc_id, source, size, pass (0, 1, 2)."""
    spark = documents.sparkSession
    rows = written(shuffled(written(documents, "sizes"), seed), "shuffled")
    per_source = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()  # a row for each source
    sizes = {r["source"]: r["size"] for r in per_source}
    goal = targets(sizes, share=share) if sizes else {}
    buckets = {r["source"]: math.isqrt(r["n"]) + 1 for r in per_source}  # as many buckets as rows in each
    plan = spark.createDataFrame([(s, n, float(goal[s]), buckets[s]) for s, n in sizes.items()], "of string, source_size long, target double, buckets int")
    known = rows.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    # the hash's top 31 bits, spread over the source's buckets in the order of the hash
    known = known.withColumn("bucket", F.floor((F.shiftright("h", 33) + (1 << 30)) * F.col("buckets") / (1 << 31)).cast("int"))
    before = known.groupBy("source", "bucket").agg(F.sum("size").alias("held"))
    offsets = before.withColumn("offset", F.sum("held").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(*_SO_FAR)) - F.col("held")).select(F.col("source").alias("of"), F.col("bucket").alias("at"), "offset")
    inside = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "size", "row").rowsBetween(*_SO_FAR)
    queued = known.withColumn("so_far", F.sum("size").over(inside)).join(offsets, F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("at")))
    queued = queued.withColumn("so_far", F.col("so_far") + F.col("offset"))
    # finish times of every pass that can end before twice the budget's own time
    passes = F.explode(F.sequence(F.lit(0), F.lit(MOST - 1))).alias("pass")
    finish = F.when(F.col("target") > 0, (F.col("so_far") + F.col("pass") * F.col("source_size")) / F.col("target")).otherwise(0.0)
    queue = queued.select("row", "doc_id", "source", "size", "h", "so_far", "source_size", "target", passes).withColumn("finish", finish)
    queue = written(queue.where("pass = 0 or finish <= 2").select("finish", "h", "row", "doc_id", "source", "size", "pass"), "queue")

    budget = share * sum(sizes.values())
    coarse, held = _cut(queue.select(F.floor(F.col("finish") * STEPS).alias("step"), "size"), budget)
    if coarse is None:
        taken = queue
    else:
        ours = queue.where(F.floor(F.col("finish") * STEPS) == coarse)
        fine = F.floor((F.col("finish") * STEPS - coarse) * STEPS)
        finer, more = _cut(ours.select(fine.alias("step"), "size"), budget - held)
        edge = ours.where(fine == finer)
        order = Window.orderBy("finish", "h", "doc_id", "pass", "source", "row").rowsBetween(*_SO_FAR)
        last = edge.withColumn("upto", F.sum("size").over(order) + held + more).where(F.col("upto") <= budget).drop("upto")
        taken = queue.where(F.floor(F.col("finish") * STEPS) < coarse).unionByName(ours.where(fine < finer)).unionByName(last)
    mix = taken.orderBy("finish", "h", "doc_id", "pass", "source", "row").select("finish", "row", "doc_id", "source", "size", "pass")
    return known.select("row", "doc_id", "source", "size", "source_size", "target"), mix


def _times(mix: DataFrame) -> DataFrame:
    return mix.groupBy("row").agg(F.count("*").alias("times"))


def taken_words(docs: DataFrame) -> DataFrame:
    """Of each row of docs: doc_id, size, source_size, target and taken, its words in the mix, repeats counted."""
    known, mix = mixed(sized(docs))
    found = known.join(_times(mix), "row", "left")
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.coalesce("times", F.lit(0))).cast("long").alias("taken"))


def sampled(docs: DataFrame) -> DataFrame:
    """docs as the mix takes them, all columns: a document that is taken twice is there twice, one that isn't is gone. The rows are written once with their numbers, so that those of the mix are the same rows."""
    rows = written(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")), "numbered")
    _, mix = mixed(sized(rows.select("row", "doc.doc_id", "doc.source", "doc.text"), F.col("row")))
    taken = rows.join(_times(mix), "row").withColumn("pass", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return taken.select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns])
