"""Review tags of frames: a closed vocabulary, merging, import, export, progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.publish import publish, replace_folder
from . import similar

# Prefixes, the closed vocabulary of review tags, and the mark of the row that only seeds it.
REVIEWER, DONE = "reviewer:", "label:"
VOCABULARY = ["label:add-smoke", "label:remove-gt", "label:fix-bbox", "label:ok", "status:unclear"]
SEED = "system:vocab-seed"


def valid_tag(tag: Column, vocabulary: list[str]) -> Column:
    return tag.isin(*vocabulary, SEED) | tag.startswith(REVIEWER)


def invalid_tags(tags, vocabulary: list[str]) -> Column:
    return F.filter(tags, lambda t: ~valid_tag(t, vocabulary))


def without_seeds(tagged: DataFrame, seed: str = SEED) -> DataFrame:
    """Rows that aren't the vocabulary's own seed rows."""
    return tagged.where(~F.array_contains("tags", seed))


def merged(one, two) -> Column:
    """Union of two tag arrays, each tag once, sorted; null counts as empty."""
    none = F.array().cast("array<string>")
    col = lambda x: F.coalesce(F.col(x) if isinstance(x, str) else x, none)
    return F.sort_array(F.array_union(col(one), col(two)))


def merge_tags(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Tags by stem of both tables together."""
    return existing.join(incoming.select("stem", F.col("tags").alias("__new")), "stem", "full").withColumn("tags", merged("tags", "__new")).drop("__new")


def payload(tagged: DataFrame, by: list[str]) -> DataFrame:
    """One map stem -> sorted distinct tags for each group (dataset), stems without tags left out. A group is one exported file."""
    tidy = tagged.select(*by, "stem", F.sort_array(F.array_distinct(F.filter("tags", lambda t: t.isNotNull()))).alias("tags")).where(F.size("tags") > 0)
    return tidy.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("stem", "tags")))).alias("tags_by_stem"))


def rows_of_payload(payloads: DataFrame, by: list[str]) -> DataFrame:
    return payloads.select(*by, F.explode("tags_by_stem").alias("stem", "tags"))


def import_tags(dataset: DataFrame, persisted: DataFrame, vocabulary: list[str]) -> DataFrame:
    """dataset (stem, tags) with the valid ones of the persisted tags merged in; touched marks rows that changed, n_stripped the tags refused."""
    stored = persisted.select("stem", F.filter("tags", lambda t: valid_tag(t, vocabulary)).alias("__good"), F.size(invalid_tags("tags", vocabulary)).alias("n_stripped"))
    joined = dataset.join(stored, "stem", "left")
    after = merged("tags", "__good")
    return joined.withColumn("after", after).withColumn("touched", F.size(F.array_except("after", F.coalesce("tags", F.array().cast("array<string>")))) > 0).select("stem", F.col("after").alias("tags"), "touched", F.coalesce("n_stripped", F.lit(0)).alias("n_stripped"))


def scan_invalid(tagged: DataFrame, vocabulary: list[str], by: list[str]) -> DataFrame:
    """Invalid tags with the number of rows that carry them."""
    return tagged.select(*by, "stem", F.explode(invalid_tags("tags", vocabulary)).alias("tag")).groupBy(*by, "tag").agg(F.count_distinct("stem").alias("n"))


def suggestions(tags: DataFrame, vocabulary: list[str], cutoff: float = 0.7) -> DataFrame:
    """Each distinct tag (none that is null) with the closest word of the vocabulary by sequence similarity, null below the cutoff. `similar.closest` takes a vocabulary that is a table."""
    words = tags.sparkSession.createDataFrame([(w,) for w in vocabulary], "word string")
    return similar.closest(tags, words, cutoff).select("tag", F.col("word").alias("suggestion"))


def report(invalid: DataFrame, by: list[str]) -> DataFrame:
    """Lines for people to read: group, tag, rows."""
    return invalid.select(*by, F.format_string("%s: %d", F.col("tag"), F.col("n")).alias("line"))


def dataset_parts(name) -> tuple[Column, Column]:
    """model and split of a name dq-frame_<model>_<split>; empty where it has another form."""
    col = F.col(name) if isinstance(name, str) else name
    pattern = r"^dq-frame_(.+)_([^_]+)$"
    return F.regexp_extract(col, pattern, 1), F.regexp_extract(col, pattern, 2)


def _refuse_invalid(payloads: DataFrame, vocabulary: list[str]) -> None:
    bad = scan_invalid(rows_of_payload(payloads, ["dataset"]), vocabulary, ["dataset"])
    if not bad.isEmpty():
        raise ValueError(f"invalid tags, for example: {[tuple(r) for r in bad.orderBy('dataset', 'tag').limit(5).collect()]}")


def _parted_payload(tagged: DataFrame) -> DataFrame:
    model, split = dataset_parts("dataset")
    return payload(tagged, ["dataset"]).withColumn("model", model).withColumn("split", split)


def export(tagged: DataFrame, vocabulary: list[str], path: str) -> None:
    """Write payloads as JSON by dataset, model and split; refuses all of it, and keeps what was there, if any dataset has an invalid tag. The tags judged are those that were written."""
    rows = _parted_payload(tagged)
    check = lambda staged: _refuse_invalid(rows.sparkSession.read.schema(rows.schema).json(staged), vocabulary)
    replace_folder(lambda staged: rows.write.partitionBy("model", "split").json(staged), check, path)


def publish_tags(tagged: DataFrame, vocabulary: list[str], path: str) -> dict:
    """The same as a published table, whose state before stays readable until the new one is whole."""
    return publish(_parted_payload(tagged), path, lambda written: _refuse_invalid(written, vocabulary), ("model", "split"))


def progress(tagged: DataFrame, by: list[str]) -> DataFrame:
    """Reviewed (any label: tag) and total rows of each group."""
    done = F.exists("tags", lambda t: t.startswith(DONE))
    return tagged.groupBy(*by).agg(F.count_if(done).alias("reviewed"), F.count("*").alias("total"))
