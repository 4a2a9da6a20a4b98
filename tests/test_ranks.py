"""Running sums and places against plain versions, with ties, nulls, hot and null groups."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from seqlens.operators import metrics, ranks


def rows_of(seed):
    rng = random.Random(seed)
    groups = ["hot"] * 6 + ["a", "b", None]
    rows = [(rng.choice(groups), rng.choice([None, float("-inf"), 0.0, rng.random(), round(rng.random(), 1), 1e300]), rng.randint(0, 5)) for _ in range(600)]
    return rows + [("one", 0.5, 3), ("nulls", None, 1), ("nulls", None, 2)]


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("parts", [1, 5, 64])
def test_running_sums(spark, descending, parts):
    rows = [(i, *r) for i, r in enumerate(rows_of(1))]
    frame = spark.createDataFrame(rows, "id long, g string, v double, n long")
    got = {r.id: (r.upto, r.upto_all) for r in ranks.running(frame, ["g"], "v", {"upto": F.col("n")}, descending, ("id",), parts).collect()}
    want = {}
    for g in {r[1] for r in rows}:
        mine = [r for r in rows if r[1] == g]
        nulls, values = [r for r in mine if r[2] is None], [r for r in mine if r[2] is not None]
        values.sort(key=lambda r: (-r[2] if descending else r[2], r[0]))
        total = 0
        for r in values + nulls if descending else nulls + values:
            total += r[3]
            want[r[0]] = (total, sum(r[3] for r in mine))
    assert got == want


def test_places_and_percentiles(spark):
    rows = [(g, v if v != float("-inf") else -7.0) for g, v, _ in rows_of(2)]
    frame = spark.createDataFrame(rows, "g string, v double").where("v < 1e299 or v is null")
    got = {r.g: r for r in ranks.percentiles(frame, ["g"], "v", {"p50": 0.5, "p95": 0.95}, 7).collect()}
    for g in {r[0] for r in rows}:
        values = sorted(v for h, v in rows if h == g and v is not None and v < 1e299)
        if not values:
            assert g not in got
            continue
        assert got[g].n == len(values)
        assert got[g].p50 == pytest.approx(statistics.median(values))
        at = 0.95 * (len(values) - 1)
        low = values[int(at)]
        assert got[g].p95 == pytest.approx(low + (at - int(at)) * (values[min(int(at) + 1, len(values) - 1)] - low))


def test_no_rows(spark):
    empty = spark.createDataFrame([], "g string, v double, n long")
    assert ranks.running(empty, ["g"], "v", {"upto": F.col("n")}).count() == 0
    assert [tuple(r) for r in ranks.values_at(empty, [], "v", {"first": lambda n: F.lit(0)}).collect()] == [(0, None)]


def test_no_task_sees_a_hot_group(spark):
    """Rows of one group, dealt by group and range, land in many tasks."""
    frame = spark.range(20_000).select(F.lit("hot").alias("g"), (F.col("id") * 7919 % 20_011).cast("double").alias("v"))
    sizes = [r["count"] for r in ranks.with_ranges(frame, "v").groupBy("g", "part").count().collect()]
    assert len(sizes) == ranks.PARTS and max(sizes) < 3 * 20_000 / ranks.PARTS
    plan = ranks.running(frame.withColumn("n", F.lit(1)), ["g"], "v", {"upto": F.col("n")})._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert [("v#" in w, "__nth" in w) for w in windows].count((True, True)) == 1  # over rows: by group and range
    assert all("part#" in w for w in windows if "v#" in w)
    assert "PythonEvaluation" not in plan


def test_target_recall_has_limits(spark):
    frame = spark.createDataFrame([("a", 0.5, 1)], "g string, score double, truth int")
    for target in (0.0, -0.1, 1.1):
        with pytest.raises(ValueError):
            metrics.threshold_for_recall(frame, ["g"], target)
