"""Benchmark decontamination by spaced seeds (operator 5).

A seed hashes the words of a window at the places a fixed mask selects and ignores the rest, so a substituted word spoils only some seeds. Test and training seeds are joined; around each hit the item is laid against the text.
An item is found if, on one diagonal, the text covers at least half of the item, and at least 8 words and 60% of what it covers are equal. A part of an item is found too: from its hits a piece is extended on its diagonal while at least 60% of its words are equal and no 5 in a row differ; the equal words of pieces of 5 or more on neighbouring diagonals (10 words apart at most, as words put in or left out shift them) add up, each word of item and text once, and 13 of them are enough, or 8 that are 60% of the item. Items of fewer words than the longest mask are found by equality of all their words.
Null or wordless texts and items find nothing; rows repeated under one id are one document; rows with a null id find nothing and stay. An empty table gives an empty result.

Plan. The seeds of the benchmark fold into a bit map of fixed size (two probes each), whatever the size of the benchmark; only that is sent to tasks. Texts are hashed in place; where the bit map answers, the words around leave the task and meet the seeds in a join, which is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import slices, without_ids, written

#: 1: the word is hashed, 0: it is ignored.
MASKS = ("11111111", "1101100111", "1010111011")
SPAN = max(map(len, MASKS))
BITS = 25
MIN_EQUAL, MIN_SHARE, MIN_COVER = 8, 0.6, 0.5
#: Of parts of an item: equal words that are enough, equal words of a piece, and words that differ in a row where a piece ends.
MIN_OVERLAP, MIN_PIECE, MOST_APART = 13, 5, 4


def _seeds(hashes: np.ndarray, off: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each mask, places in the flat words and seeds there. A text shorter than SPAN has one seed, of all its words."""
    n, out = len(hashes), []
    end = np.repeat(off[1:], np.diff(off))
    padded = np.concatenate((hashes, np.zeros(SPAN, K.U)))
    for m, mask in enumerate(MASKS):
        rolled = np.zeros(n, K.U)
        for j, bit in enumerate(mask):
            if bit == "1":
                rolled += padded[j : j + n] * K.PLACES[j]
        at = np.flatnonzero(np.arange(n) + len(mask) <= end)
        out.append((at, K.mix(rolled[at] + K.PLACES[50 + m])))
    return out


def _whole(hashes: np.ndarray, sizes: set[int], off: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Seeds of all words of a window, for items shorter than SPAN."""
    n, out = len(hashes), []
    end = np.repeat(off[1:], np.diff(off))
    padded = np.concatenate((hashes, np.zeros(SPAN, K.U)))
    rolled = np.zeros(n, K.U)
    for size in range(1, SPAN):
        rolled = rolled + padded[size - 1 : size - 1 + n] * K.PLACES[size - 1]
        if size in sizes:
            at = np.flatnonzero(np.arange(n) + size <= end)
            out.append((at, K.mix(rolled[at] + K.PLACES[60] * K.U(size))))
    return out


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in slices(batch, "text"):
            hashes, off = K.words(texts)
            sizes, ids = np.diff(off), part.column("item_id").to_pylist()
            for d, item in enumerate(ids):
                own, span = hashes[off[d] : off[d + 1]], np.array([0, sizes[d]])
                if not sizes[d] or item is None:
                    continue
                found = _seeds(own, span) if sizes[d] >= SPAN else _whole(own, {int(sizes[d])}, span)
                for at, seed in found:
                    k = len(at)
                    yield pa.record_batch([pa.array([item] * k, pa.int64()), pa.array(at, pa.int32()), pa.array(seed.view(np.int64)), pa.array([int(sizes[d])] * k, pa.int32())], ["item_id", "item_at", "seed", "item_words"])


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in slices(batch, "text"):
            hashes, off = K.words(texts)
            yield pa.record_batch([part.column("item_id"), pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(hashes.view(np.int64)))], ["item_id", "item"])


def _hits(bits: np.ndarray, around: int, sizes: set[int]):
    """Each stretch of text with seeds that the bit map knows: its words, and the seeds with their places in it."""

    def known(seed: np.ndarray) -> np.ndarray:
        keep = np.ones(len(seed), bool)
        for shift in (0, 32):
            place = (seed >> K.U(shift)) & K.U((1 << BITS) - 1)
            keep &= (bits[(place >> K.U(6)).astype(np.int64)] >> (place & K.U(63))) & K.U(1) != 0
        return keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "text"):
                hashes, off = K.words(texts)
                found = [(at[keep], seed[keep]) for at, seed in _seeds(hashes, off) + _whole(hashes, sizes, off) if (keep := known(seed)).any()]
                if not found:
                    continue
                at, seed = (np.concatenate(x) for x in zip(*found))
                order = np.argsort(at, kind="stable")
                at, seed = at[order], seed[order]
                doc = np.searchsorted(off, at, "right") - 1
                # a new stretch where the text changes or the last hit is too far for one item
                cut = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (at[1:] - at[:-1] > 2 * around), [True])))
                ids = part.column("doc_id").to_pylist()
                rows = []
                for a, b in zip(cut[:-1], cut[1:]):
                    d = doc[a]
                    if ids[d] is None:
                        continue
                    low, high = max(off[d], at[a] - around), min(off[d + 1], at[b - 1] + around)
                    rows.append({"doc_id": ids[d], "low": int(low - off[d]), "words": hashes[low:high].view(np.int64), "ats": (at[a:b] - low).astype(np.int32), "seeds": seed[a:b].view(np.int64)})
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, pa.schema([("doc_id", pa.int64()), ("low", pa.int64()), ("words", pa.list_(pa.int64())), ("ats", pa.list_(pa.int32())), ("seeds", pa.list_(pa.int64()))]))

    return run


def _pieces(equal: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of a diagonal (first place, end) in which at least MIN_SHARE are equal from the first on, and no more than MOST_APART in a row differ."""
    at, out, i = np.flatnonzero(equal), [], 0
    if len(at) == len(equal):
        return [(0, len(equal))] if len(equal) >= MIN_PIECE else []
    step = np.diff(at)
    while i < len(at):
        j = i
        while j + 1 < len(at) and step[j] <= MOST_APART + 1 and j + 2 - i >= MIN_SHARE * (at[j + 1] + 1 - at[i]):
            j += 1
        if j + 1 - i >= MIN_PIECE:
            out.append((int(at[i]), int(at[j]) + 1))
        i = j + 1
    return out


def _place(item: np.ndarray, words: np.ndarray, starts: np.ndarray) -> tuple[int, int, int] | None:
    """The best place of an item in a text on these diagonals and their neighbours: equal words, words covered, minus the start."""
    size, best, chain = len(item), None, []

    def ended() -> tuple[int, int, int] | None:
        ours, theirs = np.zeros(size, bool), set()
        covered = np.zeros(size, bool)
        for start, a, b, equal in chain:
            ours[a:b] |= equal
            covered[a:b] = True
            theirs.update((np.flatnonzero(equal) + a + start).tolist())
        n = min(int(ours.sum()), len(theirs))
        if n >= MIN_OVERLAP or n >= max(MIN_EQUAL, MIN_SHARE * size):
            return n, int(covered.sum()), -min((a, start) for start, a, _, _ in chain)[1]
        return None

    for start in np.sort(starts).tolist():
        if chain and start - chain[-1][0] > SPAN:
            best, chain = max(filter(None, (best, ended())), default=None), []
        head, tail = max(0, -start), min(size, len(words) - start)
        if tail <= head:
            continue
        equal = item[head:tail] == words[head + start : tail + start]
        n = int(equal.sum())
        if n >= min(MIN_EQUAL, size) and n >= MIN_SHARE * (tail - head) and tail - head >= MIN_COVER * size:
            best = max(filter(None, (best, (n, tail - head, -start))))
        if n >= MIN_PIECE:
            chain += [(start, head + a, head + b, equal[a:b]) for a, b in _pieces(equal)]
    return max(filter(None, (best, ended() if chain else None)), default=None)


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        ids, items, lows = (batch.column(c).to_pylist() for c in ("doc_id", "item_id", "low"))
        for r, (doc, item_id, low) in enumerate(zip(ids, items, lows)):
            item, words, starts = (batch.column(c)[r].values.to_numpy(zero_copy_only=False) for c in ("item", "words", "starts"))
            if place := _place(item, words, starts):
                found.append((doc, item_id, place[0], place[1], place[2] - low, len(item)))
        if found:
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*found), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32()))], ["doc_id", "item_id", "n_equal", "n_covered", "minus_start", "item_words"])


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Where items stand in texts: doc_id, item_id, word_start (of the item, in words; negative if its head is cut off; with pieces on several diagonals, by the first of them), n_equal, n_covered, item_words. The best place for each document and item."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    seeds = written(items.mapInArrow(_item_seeds, "item_id long, item_at int, seed long, item_words int"), "seeds")
    # both probes of every seed, folded into 2 ** BITS bits: at most 2 ** (BITS - 6) rows whatever the benchmark holds
    place = seeds.select(F.explode(F.array(F.expr(f"seed & {(1 << BITS) - 1}L"), F.expr(f"shiftrightunsigned(seed, 32) & {(1 << BITS) - 1}L"))).alias("p"))
    folded = place.groupBy(F.shiftright("p", 6).alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63L as int))")).alias("v")).collect()
    bits = np.zeros(1 << BITS - 6, np.int64)
    for i, v in folded:
        bits[i] = v
    longest = seeds.agg(F.max("item_words")).first()[0] or 0
    sizes = {r[0] for r in seeds.where(F.col("item_words") < SPAN).select("item_words").distinct().collect()}
    sent = docs.sparkSession.sparkContext.broadcast(bits.view(np.uint64))

    def run(batches):
        yield from _hits(sent.value, longest, sizes)(batches)

    hits = written(docs.mapInArrow(run, "doc_id long, low long, words array<long>, ats array<int>, seeds array<long>").withColumn("stretch", F.monotonically_increasing_id()), "hits")
    each = hits.select("stretch", F.explode(F.arrays_zip("ats", "seeds")).alias("x")).select("stretch", F.col("x.ats").alias("at"), F.col("x.seeds").alias("seed"))
    diagonals = each.join(seeds, "seed").groupBy("stretch", "item_id").agg(F.collect_set(F.col("at") - F.col("item_at")).alias("starts"))
    laid = diagonals.join(hits.select("stretch", "doc_id", "low", "words"), "stretch").join(items.mapInArrow(_item_words, "item_id long, item array<long>"), "item_id")
    places = laid.select("doc_id", "item_id", "low", "words", "item", "starts").mapInArrow(_places, "doc_id long, item_id long, n_equal int, n_covered int, minus_start long, item_words int")
    best = places.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_equal", "n_covered", "minus_start", "item_words")).alias("best"))
    return best.select("doc_id", "item_id", (-F.col("best.minus_start")).alias("word_start"), "best.n_equal", "best.n_covered", "best.item_words")


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents in which an item is found, all columns."""
    return without_ids(docs, overlaps(docs, benchmark).select("doc_id"))
