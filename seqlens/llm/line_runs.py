"""Line dedup by a suffix array over line IDs (operator 8). DataFrame operations only.

Documents are sequences of line IDs (blank lines left out, others trimmed of white space). Distributed prefix doubling ranks their suffixes: level k ranks suffixes by their first 2**k lines, a pair of level k-1 ranks sorted anew; suffixes of equal rank are an interval whose longest common prefix is 2**k at least.
A suffix that shares its rank with no other leaves the doubling, so levels shrink to what repeats and end at the longest repeat. Going down the levels again, each suffix takes a further 2**k lines where an earlier suffix has the same lines, which gives the longest prefix it shares with an earlier one.
Those prefixes that aren't part of one begun a line before are the maximal later copies; runs of at least MIN_WORDS words (1: every line that an earlier one equals) are deleted, blank lines inside them too, the first copy stays.

Documents are ordered by id (null first), then as they stand in the table; each row is a document of its own, so of equal rows the later lose their lines. Null, empty and blank texts have no lines and lose none. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, written

MIN_WORDS = 1


def _trimmed(line: F.Column) -> F.Column:
    """line without white space at its end and spaces at its start; a last character above the space needs no pattern."""
    return F.trim(F.when(F.substring(line, -1, 1) > " ", line).otherwise(F.regexp_replace(line, "\\s+$", "")))


def _words(line: F.Column) -> F.Column:
    """Words of a line that isn't blank and is trimmed: single spaces are counted as bytes, other white space by the pattern."""
    odd = line.contains("  ") | line.contains("\t") | line.contains("\r") | line.contains("\x0b") | line.contains("\x0c")
    return F.when(odd, F.regexp_count(line, F.lit(WORD))).otherwise(F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1)


def lines(docs: DataFrame) -> DataFrame:
    """row, doc_id, pos (among lines that aren't blank), line_no (from 0), h1, h2 (its ID), n_words."""
    split = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("line_no"), _trimmed(x).alias("line")))
    some = F.filter(split, lambda x: x["line"] != "")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    each = rows.select("row", "doc_id", F.posexplode(some).alias("pos", "x")).select("row", "doc_id", "pos", "x.*")
    return each.select("row", "doc_id", "pos", "line_no", F.xxhash64("line").alias("h1"), F.hash("line").alias("h2"), _words(F.col("line")).alias("n_words"))


def _ranked(groups: DataFrame, keys: list[str], name: str = "rank") -> DataFrame:
    """keys and their rank: ranks rise in the order of the keys, which are distinct."""
    return written(groups.select(*keys).orderBy(*keys).withColumn(name, F.monotonically_increasing_id()), "ranks")


def numbered(all_lines: DataFrame) -> DataFrame:
    """Of each row with lines, start: its lines are numbered start + pos, in the order of documents and with a free number after each document, so that no run reaches into the next one.

    Numbers are counted in each range of documents; a range has room for 2**40 lines."""
    order = [F.col("doc_id").asc_nulls_first(), F.col("row")]
    dealt = all_lines.groupBy("row").agg(F.max("doc_id").alias("doc_id"), (F.count("*") + 1).alias("size")).orderBy(*order)
    dealt = written(dealt.withColumn("range", F.spark_partition_id().cast("bigint")), "ranges")
    earlier = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return dealt.select("row", (F.shiftleft("range", 40) + F.coalesce(F.sum("size").over(earlier), F.lit(0))).alias("start"))


def doubling(all_lines: DataFrame, most: int = 40) -> list[DataFrame]:
    """Of each level k the suffixes whose first 2**k lines repeat: at (number of their first line), rank; of level 0 also row, doc_id, pos, line_no."""
    again = all_lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1")
    repeating = all_lines.join(_ranked(again, ["h1", "h2"]), ["h1", "h2"]).join(numbered(all_lines), "row")
    level = written(repeating.select((F.col("start") + F.col("pos")).alias("at"), "rank", "row", "doc_id", "pos", "line_no"), "level")
    levels = [level]
    for k in range(most):
        ahead = level.select((F.col("at") - (1 << k)).alias("at"), F.col("rank").alias("then"))
        pairs = level.select("at", "rank").join(ahead, "at")
        again = pairs.groupBy("rank", "then").agg(F.count("*").alias("n")).where("n > 1")
        level = written(pairs.join(_ranked(again, ["rank", "then"], "longer"), ["rank", "then"]).select("at", F.col("longer").alias("rank")), "level")
        if level.isEmpty():
            return levels
        levels.append(level)
    raise RuntimeError("doubling did not end")


def shared_with_earlier(levels: list[DataFrame]) -> DataFrame:
    """at, length, first: the longest prefix of each suffix that an earlier one has, if any, and the earliest that has it.

    A node is a prefix, named by the earliest suffix that begins with it and its length, and has all suffixes that do; each suffix asks at one node, the longest prefix found so far, at first the empty one. At level k the nodes that are asked at are split by the next 2**k lines.
    A suffix that isn't the first of its part goes on asking there, with that part's suffixes as members; one that is the first, or is alone, asks on where it is. Nodes that none asks at go."""
    held = left = None  # suffixes at nodes that are asked at, and those that have left the empty prefix, where all begin
    node = ["first", "length"]
    for k in range(len(levels) - 1, -1, -1):
        # at the empty prefix every suffix of the level is a member
        part = levels[k].select("at", F.lit(-1).cast("bigint").alias("first"), F.lit(0).alias("length"), "rank")
        if left is None:
            part = part.withColumn("asks", F.lit(True))
        else:
            part = part.join(left.withColumn("gone", F.lit(True)), "at", "left").select("at", *node, "rank", F.col("gone").isNull().alias("asks"))
            step = levels[k].select(F.col("at").alias("ahead"), "rank")
            deep = held.withColumn("ahead", F.col("at") + F.col("length")).join(step, "ahead", "left")
            part = part.unionByName(deep.select("at", *node, "rank", "asks"))
        firsts = part.where("rank is not null").groupBy(*node, "rank").agg(F.min("at").alias("found"), F.max(F.when(F.col("asks"), F.col("at"))).alias("last_asking"))
        firsts = firsts.where(F.col("last_asking") > F.col("found")).select(*node, "rank", "found")
        moved = part.join(firsts, [*node, "rank"], "left").where("length > 0 or found is not null")
        moved = written(moved.select("at", *node, "asks", "found", (F.col("asks") & F.coalesce(F.col("found") < F.col("at"), F.lit(False))).alias("goes")), "parts")
        below = moved.where("found is not null").select("at", F.col("found").alias("first"), (F.col("length") + (1 << k)).alias("length"), F.col("goes").alias("asks"))
        leaving = moved.where("goes and length = 0").select("at")
        if left is None:
            held, left = below, leaving
            continue
        stay = moved.where("length > 0").select("at", *node, (F.col("asks") & ~F.col("goes")).alias("asks"))
        held = written(stay.join(stay.where("asks").select(*node).distinct(), node, "left_semi").unionByName(below), "prefixes")
        left = left.unionByName(leaving)
    return held.where("asks").select("at", "length", "first")


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Later copies to delete: row, doc_id, first_line, last_line (from 0, blank lines counted), n_lines, n_words, kept_doc_id, kept_line."""
    all_lines = written(lines(docs), "lines")
    levels = doubling(all_lines)
    found = shared_with_earlier(levels)
    before = found.select((F.col("at") + 1).alias("at"), F.col("length").alias("before"))
    maximal = found.join(before, "at", "left").where("before is null or before <= length").drop("before")
    maximal = maximal.join(levels[0].select("at", "row", "doc_id", "pos"), "at")
    # words up to each line of the rows that have runs
    in_doc = Window.partitionBy("row").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    some = all_lines.join(maximal.select("row").distinct(), "row", "left_semi").withColumn("upto", F.sum("n_words").over(in_doc))
    begin = some.select("row", "pos", F.col("line_no").alias("first_line"), (F.col("upto") - F.col("n_words")).alias("words_before"))
    end = some.select("row", F.col("pos").alias("last_pos"), F.col("line_no").alias("last_line"), F.col("upto").alias("words_upto"))
    runs = maximal.withColumn("last_pos", F.col("pos") + F.col("length") - 1).join(begin, ["row", "pos"]).join(end, ["row", "last_pos"])
    runs = runs.withColumn("n_words", F.col("words_upto") - F.col("words_before")).where(F.col("n_words") >= min_words)
    kept = levels[0].select(F.col("at").alias("first"), F.col("doc_id").alias("kept_doc_id"), F.col("line_no").alias("kept_line"))
    return runs.join(kept, "first").select("row", "doc_id", "first_line", "last_line", F.col("length").alias("n_lines"), "n_words", "kept_doc_id", "kept_line")


def deduplicated(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs, all columns, texts without the deleted lines; docs must be a table that is read in the same order again (as a written one is)."""
    runs = repeated_runs(docs, min_words)
    cut = runs.select("row", F.explode(F.sequence("first_line", "last_line")).alias("line")).groupBy("row").agg(F.collect_set("line").alias("__cut")).withColumnRenamed("row", "__row")
    mine = docs.withColumn("__row", F.monotonically_increasing_id()).join(cut, "__row", "left")
    left = F.array_join(F.transform(F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("i"), x.alias("line"))), lambda x: ~F.array_contains("__cut", x["i"])), lambda x: x["line"]), "\n")
    return mine.withColumn("text", F.when(F.col("__cut").isNull(), F.col("text")).otherwise(left)).select(*[F.col(f"`{c}`") for c in docs.columns])
