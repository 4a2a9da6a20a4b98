"""Document fingerprints by one-permutation MinHash (operator 10). DataFrame operations only.

The words of the lower-cased text form shingles of five (fewer words are one shingle). Each shingle is hashed once; the hash's top bits name one of BINS bins, and a bin keeps its least hash.
An empty bin borrows from a filled one by optimal densification: it tries the bins that a hash of it and the number of the try name, until a filled one is met. Of each bin the low 8 bits are stored.
Likeness of two fingerprints is their share of equal bins, corrected for the 1 in 256 that agree by chance, from 0 to 1. A text without words has an empty fingerprint, like another such (1) and unlike all else (0).

The edited text of a document has its last half (floor(n_chars / 2) code points) replaced by the first as many of the next document's, which is the one with the next smaller id, and for the smallest id the largest. Null text is empty.
Null ids stand before all others; rows repeated under one id go by a hash of their texts, and equal rows are one document, each returning the same row. One document alone is its own next. An empty table gives an empty result.

Plan. The order of documents comes from ids and lengths alone, range-partitioned; windows run inside partitions, whose ends are sewn together by a table with one row a partition. Texts are shuffled once, the heads that edits need once more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, written

BINS = 128
SHINGLE = 5
#: Ends of the stages in which an empty bin's tries are looked at; beyond the last (1 in 10**13 for two filled bins) the first filled bin lends.
TRIES = (8, 32, 128, 512, 2048)


def let(value: Column, use) -> Column:
    """use(value), with value evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def shingle_hashes(text: Column, k: int = SHINGLE) -> Column:
    """Hashes of the k-word shingles of a text, in order, repeats and all."""
    words = F.transform(F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(1)), lambda w: F.xxhash64(w))

    def rolled(w: Column) -> Column:
        n = F.size(w)
        full = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))
        return F.when(n >= k, full).when(n > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))

    return let(words, rolled)


def bins_of(hashes: Column) -> Column:
    """The BINS values (low 8 bits) of a fingerprint; empty for no hashes."""
    shift = 64 - (BINS - 1).bit_length()
    place = lambda h: F.shiftright(h, shift) + BINS // 2  # noqa: E731  0 to BINS - 1, rising with the hash
    low = lambda h: h.bitwiseAND(F.lit(255)).cast("int")
    least = let(F.sort_array(hashes), lambda s: F.filter(s, lambda h, i: (i == 0) | (F.shiftright(h, shift) != F.shiftright(F.get(s, i - 1), shift))))

    def dense(found: Column) -> Column:
        at = F.transform(found, lambda h: place(h).cast("int"))
        whole = F.transform(found, low)

        def fill(p: Column) -> Column:
            filled = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.array_position(p, b).cast("int"))

            def borrow(spots: Column) -> Column:
                tried = lambda b, low, high: F.get(F.filter(F.transform(F.sequence(F.lit(low), F.lit(high)), lambda t: F.get(spots, F.pmod(F.xxhash64(b, t), F.lit(BINS)).cast("int"))), lambda s: s > 0), F.lit(0))
                stages = list(zip((0, *TRIES[:-1]), TRIES))
                return F.transform(spots, lambda s, b: F.when(s > 0, s).when(F.size(p) == 1, 1).otherwise(F.coalesce(*[tried(b, low + 1, high) for low, high in stages], F.lit(1))))

            return let(filled, borrow)

        spread = let(at, lambda p: F.transform(fill(p), lambda s: low(F.get(found, s - 1))))
        return F.when(F.size(found) == BINS, whole).when(F.size(found) == 0, F.array().cast("array<int>")).otherwise(spread)

    return let(least, dense)


def packed(bins: Column) -> Column:
    """A fingerprint as text: two hexadecimal digits a bin."""
    return F.lower(F.array_join(F.transform(bins, lambda b: F.lpad(F.hex(b), 2, "0")), ""))


def likeness(one: Column, two: Column) -> Column:
    """Likeness of two fingerprints (arrays of bins), corrected for chance agreement."""
    equal = F.aggregate(F.zip_with(one, two, lambda x, y: (x == y).cast("int")), F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0))) / BINS
    found = F.greatest(F.lit(0.0), (equal - 1 / 256) / (1 - 1 / 256))
    return F.when((F.size(one) == 0) & (F.size(two) == 0), 1.0).when((F.size(one) == 0) | (F.size(two) == 0), 0.0).otherwise(found)


def neighbours(docs: DataFrame) -> DataFrame:
    """Of docs (id, h, text): id, h, n, next_id, next_h (the row before in ascending order, around the end), for_id, for_h, for_n (the row whose next this is)."""
    rows = docs.select("id", "h", F.char_length("text").cast("long").alias("n")).distinct()
    dealt = written(rows.repartitionByRange("id", "h").withColumn("part", F.spark_partition_id()), "order")
    me = F.struct("id", "h", "n")
    ends = dealt.groupBy("part").agg(F.min(me).alias("first"), F.max(me).alias("last"))  # a row for each partition
    seam, all_parts = Window.orderBy("part"), Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("part", F.coalesce(F.lag("last").over(seam), F.last("last").over(all_parts)).alias("below"), F.coalesce(F.lead("first").over(seam), F.first("first").over(all_parts)).alias("above"))
    inside = Window.partitionBy("part").orderBy("id", "h")
    near = dealt.select("part", "id", "h", "n", F.lag(me).over(inside).alias("down"), F.lead(me).over(inside).alias("up")).join(F.broadcast(ends), "part")
    near = near.withColumn("down", F.coalesce("down", "below")).withColumn("up", F.coalesce("up", "above"))
    return near.select("id", "h", "n", F.col("down.id").alias("next_id"), F.col("down.h").alias("next_h"), F.col("up.id").alias("for_id"), F.col("up.h").alias("for_h"), F.col("up.n").alias("for_n"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Of each row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    lowest = -(1 << 63)
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(lowest)).alias("id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    order = written(neighbours(docs), "neighbours")
    placed = docs.join(order, ["id", "h"])
    heads = placed.select(F.col("for_id").alias("id"), F.col("for_h").alias("h"), F.expr("substring(text, 1, cast(floor(for_n / 2) as int))").alias("head")).dropDuplicates(["id", "h"])
    edited = placed.select("id", "h", "n", "text", "next_id", "next_h").join(heads, ["id", "h"])
    edited = edited.withColumn("edited", F.concat(F.expr("substring(text, 1, cast(n - floor(n / 2) as int))"), "head"))
    marked = edited.select("id", "h", "n", "next_id", "next_h", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), bins_of(shingle_hashes(F.col("text"))).alias("bins"), bins_of(shingle_hashes(F.col("edited"))).alias("edited_bins"))
    found = written(marked, "fingerprints")
    nexts = found.select(F.col("id").alias("next_id"), F.col("h").alias("next_h"), F.col("bins").alias("next_bins")).dropDuplicates(["next_id", "next_h"])
    return found.join(nexts, ["next_id", "next_h"]).select(F.when(F.col("id") != lowest, F.col("id")).alias("doc_id"), F.col("n").alias("n_chars"), "edited_sha256", packed(F.col("bins")).alias("fingerprint"), packed(F.col("edited_bins")).alias("edited_fingerprint"), likeness(F.col("bins"), F.col("edited_bins")).alias("near_edited"), likeness(F.col("bins"), F.col("next_bins")).alias("near_next"))
