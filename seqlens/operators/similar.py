"""Approximate join of strings by sequence similarity (K5): 2 * matched characters / all characters, as difflib's SequenceMatcher counts them.

Matched characters are never more than the characters that two strings have in common, each as often as in both. So strings are sets of tokens (a character, and which of its occurrences it is), and the bound is on two sets' overlap:
tokens stand with those first that are rare among the words; a pair that reaches the cutoff shares one of the first few of both; the places of that token bound the overlap from above, the sets give it exactly; only pairs that pass all of this are aligned.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: A sum of shares that should be whole may end just above it.
_SLACK = 1e-9


@F.pandas_udf(DoubleType())
def ratio(word: pd.Series, tag: pd.Series) -> pd.Series:
    """Sequence similarity, 0 to 1. Which of the two is the second matters: its index is searched."""
    matcher, out = difflib.SequenceMatcher(), []
    for one, two in zip(word, tag):
        if matcher.b != two:
            matcher.set_seq2(two)
        matcher.set_seq1(one)
        out.append(matcher.ratio())
    return pd.Series(out, dtype="float64")


def _tokens(text: str) -> Column:
    """Characters with the number of their occurrence; of the empty string, one token of its own."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    counted = F.transform(chars, lambda c, i: F.concat(c, F.size(F.filter(F.slice(chars, F.lit(1), i + 1), lambda x: x == c)).cast("string")))
    return F.when(F.length(text) == 0, F.array(F.lit(""))).otherwise(counted)


def _first_tokens(strings: DataFrame, text: str, often: DataFrame, cutoff: float) -> DataFrame:
    """strings with size, tokens, and a row for each of the first tokens (token, at): as many as a string that is similar enough can't miss."""
    length = F.size("tokens")
    # a partner has at least this many characters, and shares at least `need` of them
    least = F.ceil(length * (cutoff / (2 - cutoff)) - _SLACK)
    need = F.greatest(F.ceil((length + least) * (cutoff / 2) - _SLACK), F.lit(1))
    cut = strings.withColumn("tokens", _tokens(text))
    each = cut.select(text, F.explode("tokens").alias("token")).join(often, "token", "left").groupBy(text).agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))).alias("ranked"))
    ranked = each.select(text, F.transform("ranked", lambda x: x["token"]).alias("tokens")).withColumn("size", length)
    return ranked.select(text, "size", "tokens", F.posexplode(F.slice("tokens", F.lit(1), (length - need + 1).cast("int"))).alias("at", "token"))


def candidate_pairs(tags: DataFrame, words: DataFrame, cutoff: float) -> DataFrame:
    """Pairs (tag, word) whose common characters allow a similarity of the cutoff or more, each once; no pair that has it is missing.

    tags (tag) and words (word) are distinct and not null."""
    often = words.select(F.explode(_tokens("word")).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    theirs = _first_tokens(words, "word", often, cutoff).select("word", "token", F.col("size").alias("word_size"), F.col("at").alias("word_at"), F.col("tokens").alias("word_tokens"))
    met = _first_tokens(tags, "tag", often, cutoff).join(theirs, "token")
    total = F.col("size") + F.col("word_size")
    enough = lambda shared: 2.0 * shared / total >= cutoff - _SLACK
    # of a pair's common tokens the first is met once; no more than what stands from there on can be common
    shared = F.array_intersect("tokens", "word_tokens")
    bounded = met.where(enough(F.least("size", "word_size")) & enough(F.least(F.col("size") - F.col("at"), F.col("word_size") - F.col("word_at"))))
    return bounded.where((F.get(shared, F.lit(0)) == F.col("token")) & enough(F.size(shared))).select("tag", "word")


def closest(tags: DataFrame, words: DataFrame, cutoff: float) -> DataFrame:
    """Each distinct tag that is not null with the closest word (ties: the last in code point order) and its similarity; both null below the cutoff, which is above 0 and at most 1."""
    if not 0 < cutoff <= 1:
        raise ValueError("the cutoff must be above 0 and at most 1")
    tags = tags.select("tag").where("tag is not null").distinct()
    words = words.select("word").where("word is not null").distinct()
    scored = candidate_pairs(tags, words, cutoff).withColumn("similarity", ratio("word", "tag")).where(F.col("similarity") >= cutoff)
    best = scored.groupBy("tag").agg(F.max(F.struct("similarity", "word")).alias("best"))
    return tags.join(best, "tag", "left").select("tag", F.col("best.word").alias("word"), F.col("best.similarity").alias("similarity"))
