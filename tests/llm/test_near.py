"""Near-duplicates against all pairs by brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from seqlens.llm import kernels, near

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def brute(rows, k):
    sets = [shingles(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            same_id = rows[i][0] is not None and rows[i][0] == rows[j][0]
            both = len(sets[i] & sets[j])
            linked = sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both) and rows[i][0] is not None and rows[j][0] is not None
            if linked or (same_id and sets[i] and sets[j]):
                parent[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    return sorted(((d, len(s), min(x for x in groups[find(i)] if x is not None) if d is not None else None) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


@pytest.mark.parametrize("k", [4, 5])
def test_like_brute_force(spark, corpus, k):
    rows = [(r.doc_id, r.text) for r in corpus.collect()]
    got = near.near_duplicates(corpus, k).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows, k)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_edges(spark, edge, empty):
    rows = [(r.doc_id, r.text) for r in edge.collect()]
    got = near.near_duplicates(edge, 4).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows, 4)
    assert near.near_duplicates(empty, 4).count() == 0
    kept = near.deduplicated(edge, 4)
    assert kept.columns == edge.columns
    assert {r.doc_id for r in kept.collect()} == {900, 901, 902, 903, 905, 906, 907, None}


def test_hub_whose_copies_are_no_pairs(spark):
    """Each copy differs from the hub by less than a fifth, from other copies by more."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(100)]
    rows = [(500, " ".join(base))]
    for i in range(60):
        words = list(base)
        for p in rng.sample(range(0, 97, 5), 2):
            words[p] = f"e{i}{p}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near.near_duplicates(docs, 4).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows, 4)


def thue_morse(letters, n=1024):
    return "".join(letters[i.bit_count() % 2] for i in range(n))


def test_words_of_one_polynomial_sum(spark):
    """A word over two letters and its complement, long enough for powers modulo 2**64 to cancel."""
    one, two = thue_morse("ab"), thue_morse("ba")
    hashes, _ = kernels.words(pa.array([f"{one} {two} {one.upper()}"], pa.large_string()))
    assert hashes[0] != hashes[1] and hashes[0] == hashes[2]
    rows = [(1, " ".join([one] * 9)), (2, " ".join([two] * 9)), (3, f"{one} x"), (4, f"{two} x"), (5, f"{one.upper()} X")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near.near_duplicates(docs, 4).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows, 4)


def test_word_hashes_at_the_limit():
    """Equal words have equal hashes on both sides of the limit, wherever they stand and in either case; all others differ."""
    words = [c * n for c in "aé" for n in range(1, 2 * kernels.LONG)] + ["b" * n + "a" * (40 - n) for n in range(40)]
    hashes, off = kernels.words(pa.array([" ".join(words), "\t".join(reversed(words)).replace("a", "A")], pa.large_string()))
    first, second = hashes[: off[1]], hashes[off[1] :]
    assert len(set(words)) == len(set(first.tolist())) and (first == second[::-1]).all()


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 200), (200, 300), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in near.components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 200: 100, 300: 100}


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 1500, dtype=np.uint64)
    for n in (3, 60, 1000):
        one, two = pool[:n], np.concatenate((pool[n // 3 : n], pool[1100 : 1100 + n // 3]))
        off = np.array([0, len(one), len(one) + len(two)])
        a, b = kernels.fast_sketches(np.concatenate((one, two)), off, 512)
        want = len(set(one.tolist()) & set(two.tolist())) / len(set(one.tolist()) | set(two.tolist()))
        assert not (a == kernels.EMPTY).any() and abs((a == b).mean() - want) < 0.12
