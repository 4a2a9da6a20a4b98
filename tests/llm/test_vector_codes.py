"""Vector codes against a plain quantiser in Python integers."""

import hashlib
import random

import numpy as np
import pytest

from seqlens.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, parts=16, entries=64, rounds=2):
    kept = [r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    whole = [[int(np.floor(np.float64(np.float32(x)) * 256)) for x in r[1]] for r in kept]
    d = len(whole[0]) // parts
    cut = [[tuple(v[p * d : p * d + d]) for p in range(parts)] for v in whole]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    best = lambda p, c: min(range(len(books[p])), key=lambda e: (far(c, books[p][e]), e))
    for _ in range(rounds):
        mine = [[best(p, c[p]) for p in range(parts)] for c in cut]
        for p in range(parts):
            for e in range(len(books[p])):
                own = [c[p] for c, m in zip(cut, mine) if m[p] == e]
                if own:
                    books[p][e] = tuple(sum(x) // len(own) for x in zip(*own))
    mine = [[best(p, c[p]) for p in range(parts)] for c in cut]
    errors = [sum(far(c[p], books[p][m[p]]) for p in range(parts)) for c, m in zip(cut, mine)]
    totals = {}
    for r, e in zip(kept, errors):
        totals[r[2]] = totals.get(r[2], 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    key = lambda r: tuple((x is not None, x) for x in r)
    return sorted(((r[0], r[2], bytes(m).hex(), e, totals[r[2]], digest) for r, m, e in zip(kept, mine, errors)), key=key)


def found(spark, rows, **more):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    key = lambda r: tuple((x is not None, x) for x in r)
    return sorted(map(tuple, vector_codes.vector_codes(frame, **more).collect()), key=key)


def vectors(rng, n, dim, spread):
    return [[rng.gauss(0, spread) for _ in range(dim)] for _ in range(n)]


@pytest.mark.parametrize("spread", [0.002, 0.3])
def test_same_as_plain(spark, spread):
    rng = random.Random(5)
    rows = [(i, v, rng.choice([1, 2, None])) for i, v in enumerate(vectors(rng, 200, 32, spread))]
    rows += [(1000 + i, rows[7][1], 1) for i in range(120)]  # a hot vector
    rows += [(None, rows[8][1], None), (3, rows[9][1], 2), (3, rows[9][1], 2)]
    rows += [(-1, None, 1), (-2, [None] + [0.0] * 31, 1), (-3, [float("nan")] + [0.0] * 31, 1), (-4, [float("inf")] + [0.0] * 31, 1)]
    assert found(spark, rows) == plain(rows)


def test_numbers_beyond_64_bits(spark):
    rng = random.Random(6)
    rows = [(i, [x * 10.0 ** rng.choice([0, 9, 15]) for x in v], 1) for i, v in enumerate(vectors(rng, 80, 16, 1.0))]
    got, want = found(spark, rows), plain(rows)
    most = (1 << 63) - 1
    assert got == [(*r[:3], min(r[3], most), min(sum(min(w[3], most) for w in want), most), r[5]) for r in want]


def test_few_rows_and_no_rows(spark):
    rows = [(2, [0.5] * 16, None), (1, [0.25] * 16, None)]
    assert found(spark, rows) == plain(rows)
    assert found(spark, []) == []


def test_other_lengths_have_no_code(spark):
    rows = [(1, [0.5] * 16, 1), (2, [0.5] * 15, 1), (3, [], 2), (4, [1.0] * 16, 2)]
    got = found(spark, rows)
    assert [(r[0], r[2] is None, r[3] is None) for r in got] == [(1, False, False), (2, True, True), (3, True, True), (4, False, False)]
    assert [r[2] for r in found(spark, [(1, [0.5] * 15, 1)])] == [None]


def test_extra_columns_and_labels_of_another_kind(spark):
    frame = spark.createDataFrame([(1, [0.5] * 16, "a", "x", 1), (2, [0.75] * 16, None, "y", 2)], "vec_id long, embedding array<double>, label string, code string, error long")
    got = sorted(vector_codes.vector_codes(frame).collect())
    assert [(r.vec_id, r.label, r.error) for r in got] == [(1, "a", 0), (2, None, 0)]


def test_balls_own_what_brute_force_gives():
    rng = np.random.default_rng(0)
    asked = points_in_clumps = 0
    for trial in range(40):
        n, d, spread = int(rng.integers(1, 500)), int(rng.integers(1, 6)), int(rng.choice([2, 30, 1000]))
        points = rng.integers(-spread, spread + 1, (n, d))
        points += rng.integers(0, 9, (n, 1)) * 20 * spread * (trial % 2)  # every other time in clumps
        points = points.astype(object) * 10**20 if trial % 7 == 0 else points
        kept, _, counts = vector_codes._distinct(points)
        t = vector_codes.tree(kept, counts)
        entries = points[rng.integers(0, n, int(rng.integers(1, 17)))]  # with twins among them
        balls, owners, at, mine = vector_codes.settle(t, entries)
        got = np.full(len(kept), -1)
        for ball, owner in zip(balls, owners):
            got[slice(*t["spans"][ball])] = owner
        got[at] = mine
        want = ((t["points"][:, None] - entries[None]) ** 2).sum(2).argmin(1)
        assert (got == want).all()
        asked, points_in_clumps = asked + trial % 2 * len(at), points_in_clumps + trial % 2 * len(kept)
    assert asked < points_in_clumps / 2  # balls settle most points without a look at them
