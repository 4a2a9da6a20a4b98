"""Publication: a failure at any step leaves the old state, a repeated job the new one."""

import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from seqlens.operators import joins, metrics
from seqlens.sources import publish


def test_failures_between_the_steps(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "table")
    one, two = spark.range(5).withColumn("part", F.col("id") % 2), spark.range(9).withColumn("part", F.lit(7).cast("long"))
    with pytest.raises(FileNotFoundError):
        publish.published(spark, path)
    first = publish.publish(one, path, by=("part",))
    now = lambda: sorted(map(tuple, publish.published(spark, path).select("id", "part").collect()))
    old = now()
    assert first["rows"] == 5 and first["previous"] is None and old == [(i, i % 2) for i in range(5)]

    def refuse(written):
        assert written.count() == 9
        raise ValueError("no")

    with pytest.raises(ValueError):
        publish.publish(two, path, refuse)
    assert now() == old
    with pytest.raises(Exception, match="lost"):
        publish.publish(two.withColumn("id", F.raise_error(F.lit("lost")).cast("long")), path)
    assert now() == old

    def fail(*_):
        raise OSError("gone")

    class Failing:
        def __init__(self, store):
            self.store = store

        def __getattr__(self, name):
            return fail if name == "move" else getattr(self.store, name)

    real = fs.FileSystem.from_uri
    with monkeypatch.context() as m:
        m.setattr(publish.fs, "FileSystem", type("F", (), {"from_uri": staticmethod(lambda p: (Failing(real(p)[0]), real(p)[1]))}))
        with pytest.raises(OSError):
            publish.publish(two, path)
    assert now() == old
    second = publish.publish(two, path)
    assert second["previous"] == first["version"] and len(now()) == 9


def test_folder_is_replaced_as_a_whole(spark, tmp_path):
    path = str(tmp_path / "out")
    write = lambda n: lambda staged: spark.range(n).write.parquet(staged)
    publish.replace_folder(write(3), lambda staged: None, path)

    def refuse(staged):
        raise ValueError("no")

    with pytest.raises(ValueError):
        publish.replace_folder(write(4), refuse, path)
    assert spark.read.parquet(path).count() == 3
    publish.replace_folder(write(5), lambda staged: None, path)
    assert spark.read.parquet(path).count() == 5 and [p.name for p in tmp_path.iterdir()] == ["out"]


def test_evaluation_summary_and_union(spark):
    verdicts = spark.createDataFrame([("a", 0.9, "tp"), ("a", 0.2, "fp"), ("b", 0.8, "fp"), ("b", None, "fn")], "stem string, confidence double, verdict string")
    samples = spark.createDataFrame([("a",), ("b",), ("c",)], "stem string")
    assert sorted(map(tuple, joins.sample_counts(verdicts, samples).collect())) == [("a", 1, 1, 0), ("b", 0, 1, 1), ("c", 0, 0, 0)]
    row = joins.evaluation_summary(verdicts, samples, 0.5).head()
    assert (row.num_samples, row.tp, row.fp, row.fn, row.fp_review_samples, row.fn_review_samples) == (3, 1, 2, 1, 1, 1)
    assert (row.precision, row.recall) == (pytest.approx(1 / 3), 0.5)
    assert joins.evaluation_summary(verdicts.limit(0), samples, 0.5).head().asDict() == {"num_samples": 3, "tp": 0, "fp": 0, "fn": 0, "fp_review_samples": 0, "fn_review_samples": 0, "precision": 0.0, "recall": 0.0}
    both = metrics.union_results({"train": samples.withColumn("n", F.lit(1)), "val": samples})
    assert sorted(map(tuple, both.groupBy("split", "n").count().collect()), key=str) == sorted([("train", 1, 3), ("val", None, 3)], key=str)
