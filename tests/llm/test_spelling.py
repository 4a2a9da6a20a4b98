"""Spelling groups against all pairs of words, and the gram bound against all edits."""

import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from seqlens.llm import spelling


def words_of(rows):
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += len(run) >= 7
    return {w: n for w, n in found.items() if n >= 2}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain(words):
    rows, forms = [], {}
    for w, n in words.items():
        others = [o for o in words if near(w, o)]
        best = min(others, key=lambda o: (-words[o], o), default=None)
        forms[w] = best if best and words[best] >= 10 * n else None
        rows.append((w, n, len(others)))
    def root(w):
        return root(forms[w]) if forms[w] else w
    return sorted((w, forms[w], root(w), n, k, words[forms[w]] if forms[w] else None) for w, n, k in rows)


def found(frame):
    return sorted(tuple(r) for r in frame.select("word", "form", "root", "n", "n_near", "form_n").collect())


def text_rows(seed, n=150):
    rng = random.Random(seed)
    parts = ["tion", "ing", "str", "ab", "ÄÖ", "éa", "th", "er", "e", "an"]
    kinds = ["".join(rng.choice(parts) for _ in range(rng.randint(3, 5))) for _ in range(60)]
    kinds += [k[:2] + rng.choice("abcxyz") + k[3:] for k in kinds[:30]] + [k + "s" for k in kinds[:20]]
    weights = [rng.choice([1, 1, 5, 400]) for _ in kinds]
    return [(i, " ".join(rng.choices(kinds, weights, k=rng.randint(0, 80)))) for i in range(n)]


def test_same_as_all_pairs(spark):
    rows = text_rows(3) + [(600, " ".join(["ladders"] * 40)), (601, " ".join(["ladders"] * 400 + ["ladderz"] * 30 + ["xladderz"] * 2)), (None, "Nowhere nowhere"), (500, None), (501, ""), (502, "short ones"), (503, "y" * 3000 + " " + "y" * 3001)] + [(504, "y" * 3000 + " " + "y" * 3001)] * 2
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, word string, n int")
    counted = spelling.counted(spelling.occurrences(docs))
    words = words_of(rows)
    assert {r.word: r.n for r in counted.collect()} == words
    assert found(spelling.grouped(counted)) == plain(words)
    assert any(r[1] for r in plain(words)) and any(r[2] != r[1] and r[1] for r in plain(words))


def test_random_words_with_frequent_grams(spark, monkeypatch):
    monkeypatch.setattr(spelling, "SPLIT", 40)  # many grams are cut off, few are split
    rng = random.Random(9)
    for letters, limit in (("ab", 40), ("abc", 5), ("abcdé", 2000)):
        monkeypatch.setattr(spelling, "SPLIT", limit)
        words = {"".join(rng.choice(letters) for _ in range(rng.randint(7, 10))): rng.choice([2, 3, 30, 900]) for _ in range(250)}
        frame = spark.createDataFrame(list(words.items()), "word string, n long")
        assert found(spelling.grouped(frame)) == plain(words)


def test_no_words(spark, empty):
    assert found(spelling.grouped(spelling.counted(spelling.occurrences(empty)))) == []


def test_no_edit_changes_more_grams_than_the_bound():
    rng = random.Random(2)
    for letters in ("ab", "abcd"):
        words = ["".join(rng.choice(letters) for _ in range(rng.randint(7, 14))) for _ in range(40)]
        edits = {w: [w[:i] + c + w[i + k :] for i in range(len(w) + 1) for k in (0, 1) for c in (*letters, "") if i + k <= len(w)] for w in words}
        everything = [*words, *(e for es in edits.values() for e in es)]
        known = {w[i : i + 2] for w in everything for i in range(len(w) - 1)}
        known |= {w[i : i + q] for w in words for q in (3, 4) for i in range(len(w) - q + 1) if rng.random() < 0.5 or q == 3}
        grams = spelling.Grams(dict.fromkeys(known, 1))
        tight = 0
        for w in words:
            mine = Counter(w[p : q + 1] for p, q in grams.of(w))
            lost = max(sum((mine - Counter(e[p : q + 1] for p, q in grams.of(e))).values()) for e in edits[w])
            bound = grams.bound(w, grams.of(w))
            assert lost <= bound
            t = len(grams.of(w)) - bound
            for e in edits[w] if t > 0 else ():  # what is kept stands at both ends
                mine_too = grams.of(e)
                assert len(mine_too) >= t and set(spelling.merged_lists(w, grams.of(w), t)) & set(spelling.merged_lists(e, mine_too, t))
            tight += bound < len(grams.of(w))
        assert tight


def test_lists_serve_most_words(spark):
    rows = text_rows(4, 300)
    words = spelling.counted(spelling.occurrences(spark.createDataFrame(rows, "doc_id long, text string")))
    dealt = words.mapInArrow(spelling._decomposed(spelling.dictionary(words)), spelling.DEALT)
    assert dealt.agg(F.avg((F.size("asked") == 0).cast("int"))).head()[0] < 0.2
