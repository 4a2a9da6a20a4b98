"""Spelling variant grouping with variable-length grams (operator 12).

Words are the distinct results of `occurrences` (maximal runs of letters, A-Z lower-cased, of at least SHORTEST code points) that occur MIN_COUNT times or more. Two words are near if they differ by one inserted, deleted or replaced code point. A word's form is its near word of largest n, the first in code-point order on ties, if that n is FACTOR times its own or more; root follows forms to the last.

Near words are found by variable-length grams:
- The dictionary holds all grams of QMIN code points, and of a gram that occurs more than a limit the next longer ones, up to QMAX: frequent grams are worth splitting, the others are cut off. The limit is a share (1 / SPLIT) of all places, so the dictionary stays small at every size.
- A word is decomposed into the longest dictionary gram at each place, those inside another left out.
- An edit at a place of the word can change the grams over it; those left of it only where some dictionary gram goes on from the characters before it, those right of it only where one ends in the characters after it. The most grams that any one edit can change is the word's bound; t, the grams beyond the bound, are certainly kept.
- What an edit changes is a run of neighbouring grams. So a near word has, for some a, the same first a grams at the same places and the same last t - a grams at the same places from its end. The lists of these t grams are merged into one: a word asks t + 1 such merged lists (t up to MERGED) of words at most one code point longer or shorter, and what they hold is verified, by the parity of letters first, which is quick, then by the distance.
- Where the bound covers all grams of both words, lists say nothing; such words are joined by what is left when a code point is deleted, which one edit never changes, and verified in the same way.

Null texts have no words, a null id counts as an empty one in the hash of `occurrences`, repeated rows count each. Words of any length are handled. An empty table gives an empty result.

Plan. Words are counted before and after one shuffle; grams are decomposed in tasks with the dictionary (bounded by SPLIT, not by the data) at hand; lists are joined, which adaptive execution splits where one is hot, and only verified pairs are shuffled on. Roots double their way up; a step multiplies n by FACTOR, so few rounds are needed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .url_filter import lower_ascii

RUN = "[A-Za-zÀ-ÿ]+"
SHORTEST, MIN_COUNT, FACTOR = 7, 2, 10
#: One in so many runs has a code point deleted (the query's planted slips).
SLIP = 31
QMIN, QMAX = 2, 3
#: A gram at more than 1 / SPLIT of all places is split into longer ones: at most SPLIT grams of each length are.
SPLIT = 4_000
#: At most so many lists are merged into one; fewer only makes it longer.
MERGED = 4


def occurrences(docs: DataFrame) -> DataFrame:
    """The words of all texts, one row each: word. A run whose crc32 with the document's id is divisible by SLIP loses the code point that the crc32 points at."""
    runs = docs.select(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":")).alias("id"), F.explode(F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(f"({RUN})"), F.lit(1))).alias("run"))
    runs = runs.where(F.length("run") >= SHORTEST).withColumn("h", F.crc32(F.concat("id", "run").cast("binary")))
    at = F.pmod(F.col("h"), F.length("run")).cast("int")
    slipped = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    return runs.select(F.when(F.col("h") % SLIP == 0, slipped).otherwise(F.col("run")).alias("word")).where(F.length("word") >= SHORTEST)


def counted(occurring: DataFrame, least: int = MIN_COUNT) -> DataFrame:
    return occurring.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def dictionary(words: DataFrame) -> dict[str, int]:
    """The gram dictionary of words and how often each gram occurs. Bounded: at most SPLIT grams of a length are split."""
    at = F.explode(F.sequence(F.lit(1), F.length("word") - (QMIN - 1)))
    places = words.select("word", at.alias("at"))
    grams = places.select(F.substr("word", F.col("at"), F.lit(QMAX)).alias("gram")).groupBy("gram").count()
    grams = written(grams, "grams")
    limit = max(1, (grams.agg(F.sum("count")).head()[0] or 0) // SPLIT)
    kept: dict[str, int] = {}
    wanted = grams
    for q in range(QMIN, QMAX + 1):
        level = wanted.where(F.length("gram") >= q).groupBy(F.substr("gram", F.lit(1), F.lit(q)).alias("head")).agg(F.sum("count").alias("n"))
        level = written(level, "gram-level")
        kept |= {r["head"]: r["n"] for r in level.toLocalIterator()}
        # only what is frequent goes on: at most SPLIT heads
        split = level.where(F.col("n") > limit).select("head")
        wanted = wanted.join(F.broadcast(split), F.substr("gram", F.lit(1), F.lit(q)) == F.col("head"), "left_semi")
    return kept


class Grams:
    """Decomposes words by a dictionary."""

    def __init__(self, known: dict[str, int]):
        self.known, self.longest = known, max(map(len, known), default=QMIN)
        self.heads = {g[:i] for g in known for i in range(1, len(g))}
        self.tails = {g[i:] for g in known for i in range(1, len(g))}

    def of(self, word: str) -> list[tuple[int, int]]:
        """First and last place of each gram, in order: the longest at each place that no earlier one holds."""
        found, reach = [], -1
        for p in range(len(word) - QMIN + 1):
            q = next((q for q in range(min(self.longest, len(word) - p), QMIN, -1) if word[p : p + q] in self.known), QMIN)
            if p + q - 1 > reach:
                reach = p + q - 1
                found.append((p, reach))
        return found

    def bound(self, word: str, grams: list[tuple[int, int]]) -> int:
        """The most grams that one edit can change."""
        n, most, reach = len(word), 0, self.longest
        lefts = [next((j for j in range(max(0, i - reach + 1), i) if word[j:i] in self.heads), i) for i in range(n + 1)]
        rights = [next((e for e in range(min(n, i + reach - 1), i, -1) if word[i:e] in self.tails), i) for i in range(n + 1)]
        first = 0
        for i in range(n + 1):  # the edit replaces or deletes place i, or inserts before it
            while first < len(grams) and grams[first][1] < i - reach:
                first += 1
            changed = slipped = 0
            for p, q in grams[first:]:
                if p > i + reach:
                    break
                left = q < i and p >= lefts[i]
                changed += left or (p <= i <= q) or (p > i and q < rights[min(n, i + 1)])
                slipped += left or (p < i <= q) or (p >= i and q < rights[i])
            most = max(most, changed if i < n else 0, slipped)
        return most


def parity(word: str) -> int:
    """A bit for each of 63 classes of letters: whether the word has an odd number of them. One edit changes two bits at most."""
    bits = 0
    for letter in word:
        bits ^= 1 << ord(letter) % 63
    return bits


def merged_lists(word: str, grams: list[tuple[int, int]], t: int) -> list[str]:
    """Names of the lists that hold all words with the same first a and last t - a grams, for a from 0 to t."""
    first = [f"{p}{word[p : q + 1]}" for p, q in grams[:t]]
    last = [f"{len(word) - p}{word[p : q + 1]}" for p, q in grams[-t:]]
    return [f"{t}:{','.join(first[:a])}:{','.join(last[a:])}" for a in range(t + 1)]


def _decomposed(known: dict[str, int]):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(known)
        for batch in batches:
            lists, asked, letters = [], [], []
            for word in batch.column("word").to_pylist():
                found = grams.of(word)
                kept = min(MERGED, len(found) - grams.bound(word, found))
                letters.append(parity(word))
                lists.append([name for t in range(1, min(MERGED, len(found)) + 1) for name in merged_lists(word, found, t)])
                asked.append(merged_lists(word, found, kept) if kept > 0 else [])
            kind = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(letters, pa.int64()), pa.array(lists, kind), pa.array(asked, kind)], DEALT_NAMES)

    return task


DEALT = "word string, n long, letters long, lists array<string>, asked array<string>"
DEALT_NAMES = ["word", "n", "letters", "lists", "asked"]


def _near(one: Column, two: Column) -> Column:
    return (F.levenshtein(one, two, 1) == 1) & (one != two)


def near_pairs(words: DataFrame, known: dict[str, int]) -> DataFrame:
    """Each pair of near words once: a, b (a before b), n_a, n_b. words: (word, n), words distinct."""
    dealt = written(words.mapInArrow(_decomposed(known), DEALT), "decomposed")
    lists = dealt.select(F.col("word").alias("two"), F.col("n").alias("n_two"), F.col("letters").alias("letters_two"), F.explode("lists").alias("list"), F.length("word").alias("size"))
    asked = dealt.select(F.col("word").alias("one"), F.col("n").alias("n_one"), F.col("letters").alias("letters_one"), F.explode("asked").alias("list"))
    asked = asked.withColumn("size", F.explode(F.array(*[F.length("one") + by for by in (-1, 0, 1)])))
    alike = F.bit_count(F.col("letters_one").bitwiseXOR(F.col("letters_two"))) <= 2
    merged = asked.join(lists, ["list", "size"]).where(alike & _near(F.col("one"), F.col("two")))
    loose = dealt.where(F.size("asked") == 0).select("word", "n")
    cut = F.transform(F.sequence(F.lit(0), F.length("word")), lambda i: F.concat(F.substr("word", F.lit(1), i), F.substr("word", i + 2)))
    lacking = written(loose.select("word", "n", F.explode(F.array_distinct(cut)).alias("left_over")), "lacking")
    met = lacking.select(F.col("word").alias("one"), F.col("n").alias("n_one"), "left_over").join(lacking.select(F.col("word").alias("two"), F.col("n").alias("n_two"), "left_over"), "left_over").where((F.col("one") < F.col("two")) & _near(F.col("one"), F.col("two")))
    both = merged.select("one", "n_one", "two", "n_two").unionByName(met.select("one", "n_one", "two", "n_two"))
    first = F.col("one") < F.col("two")
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    return both.select(pick("one", "two").alias("a"), pick("two", "one").alias("b"), pick("n_one", "n_two").alias("n_a"), pick("n_two", "n_one").alias("n_b")).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """forms (word, form), form not null, without rings: word, root."""
    up = forms.select("word", F.col("form").alias("root"))
    while True:
        above = up.select(F.col("word").alias("root"), F.col("root").alias("higher"))
        step = written(up.join(above, "root", "left").select("word", F.coalesce("higher", "root").alias("root"), F.col("higher").isNotNull().alias("moved")), "roots")
        up = step.select("word", "root")
        if step.where("moved").isEmpty():
            return up


def grouped(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """words (word, n): word, form, root, n, n_near, form_n."""
    words = written(words, "words")
    pairs = written(near_pairs(words, dictionary(words)), "near-pairs")
    links = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("m")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("m")))
    best = links.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("minus"), F.col("other"))).alias("best"))
    found = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(-F.col("best.minus") >= factor * F.col("n"), F.col("best.other")).alias("form"), (-F.col("best.minus")).alias("m"))
    found = written(found, "forms")
    up = roots(found.where("form is not null").select("word", "form"))
    return found.join(up, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", F.when(F.col("form").isNotNull(), F.col("m")).alias("form_n"))
