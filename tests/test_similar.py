"""The approximate join against difflib over all pairs."""

import difflib
import random

import pytest

from seqlens.operators import similar


def strings(rng, n, letters, longest):
    return {"".join(rng.choice(letters) for _ in range(rng.randint(0, longest))) for _ in range(n)}


def edited(rng, text, letters):
    chars = list(text)
    for _ in range(rng.randint(0, 3)):
        at = rng.randint(0, len(chars))
        chars[at : at + rng.randint(0, 1)] = rng.sample(letters, rng.randint(0, 2))
    return "".join(chars)


@pytest.mark.parametrize("cutoff", [0.4, 0.7, 0.9, 1.0])
def test_like_difflib(spark, cutoff):
    rng = random.Random(int(cutoff * 10))
    letters = list("abcdefgh:-é😀")
    words = sorted(strings(rng, 60, letters, 14) | {"", "label:ok", "aab" * 80})
    tags = sorted(strings(rng, 40, letters, 14) | {edited(rng, rng.choice(words), letters) for _ in range(60)} | {"", "baa" * 80})
    tagged = spark.createDataFrame([(t,) for t in [*tags, tags[3], None]], "tag string")
    got = similar.closest(tagged, spark.createDataFrame([(w,) for w in [*words, words[5], None]], "word string"), cutoff).collect()
    want = {t: next(iter(difflib.get_close_matches(t, words, n=1, cutoff=cutoff)), None) for t in tags}
    assert len(got) == len(tags) and {r.tag: r.word for r in got} == want
    assert len(set(want.values())) > 10  # the cases are not vacuous
    assert all(r.similarity is None if r.word is None else r.similarity == difflib.SequenceMatcher(None, r.word, r.tag).ratio() for r in got)


def test_few_pairs_are_aligned(spark):
    """No pair is there twice, and most of all pairs are not looked at."""
    rng = random.Random(5)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    words = sorted(strings(rng, 200, letters, 16))
    tags = sorted({edited(rng, w, letters) for w in words})
    pairs = similar.candidate_pairs(spark.createDataFrame([(t,) for t in tags], "tag string"), spark.createDataFrame([(w,) for w in words], "word string"), 0.7).collect()
    near = {(t, w) for t in tags for w in words if difflib.SequenceMatcher(None, w, t).ratio() >= 0.7}
    assert len(pairs) == len({(p.tag, p.word) for p in pairs}) < 0.05 * len(tags) * len(words)
    assert near <= {(p.tag, p.word) for p in pairs}


def test_edges(spark):
    none = spark.createDataFrame([], "tag string")
    words = spark.createDataFrame([("ok",)], "word string")
    assert similar.closest(none, words, 0.7).count() == 0
    assert [tuple(r) for r in similar.closest(spark.createDataFrame([("ok",)], "tag string"), words.where("false"), 0.7).collect()] == [("ok", None, None)]
    with pytest.raises(ValueError, match="cutoff"):
        similar.closest(none, words, 0.0)
