"""Vector code compression: product quantisation over metric trees (operator 11).

Every component x becomes the integer floor(256 * x); vectors are cut into PARTS equal parts, each with a codebook of ENTRIES entries that starts as that part of the vectors of smallest id. A round assigns every part to its nearest entry (ties to the lower one) and moves entries to the floor of their parts' mean; entries without parts stay.
The assignment is exact and goes through anchors hierarchies: of each block of vectors and each part position one metric tree over the distinct parts, built middle-out (about sqrt(n) anchors, each new one at the point furthest from the widest anchor, taking over the points that lie nearer; anchors are then joined pairwise into balls upwards and built in the same way downwards). A ball keeps the sums and the count of its parts.
A ball inherits its parent's list of entries that may be nearest and drops those that lie behind the bisecting plane of a nearer one for every point within its radius. When one entry is left it owns the ball, whose cached sums count for it without a look at its points; only leaves with several entries left measure their parts, against those entries.

Components are single-precision numbers (doubles are rounded to them). Rows whose vector is null or holds a null or non-finite component are dropped. Ids that rows share count as rows, ordered by their vectors; null ids come last. The first kept vector gives the length; vectors of other lengths, and all if the parts can't be equal, stay out of the learning and have a null code and error. Fewer vectors than ENTRIES make smaller codebooks. An empty table gives an empty result.
Arithmetic is in whole numbers throughout: 64 bits where squares fit, Python's own beyond. An error beyond a long is the largest long.

Plan. Trees are built once, a block of BLOCK rows at a time, and written to the shared folder; each round reads them and sends one partial sum a task, part, entry and component. Only codebooks (ENTRIES vectors) and their sums pass the driver.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

PARTS, ENTRIES, ROUNDS = 16, 64, 2
BLOCK, LEAF = 4096, 16
#: Sums travel in limbs of so many bits, so that no sum overflows.
LIMB = 30
#: Relative margin of the pruning bound, far above the rounding of its square roots.
_MARGIN = 1 + 1e-9
_MOST = (1 << 63) - 1


def _fitting(values: np.ndarray) -> np.ndarray:
    """Whole numbers as 64-bit integers where squared distances fit in them, else as Python integers."""
    most = float(np.abs(values).max(initial=0))
    return values.astype(np.int64 if values.shape[-1] * (2 * most) ** 2 < 2.0**61 else object)


def whole(components: np.ndarray) -> np.ndarray:
    """floor(256 * x) of finite single-precision numbers."""
    scaled = np.floor(components.astype(np.float64) * 256)
    exact = np.array([int(x) for x in scaled.ravel()], object).reshape(scaled.shape) if np.abs(scaled).max(initial=0) >= 2.0**62 else scaled.astype(np.int64)
    return _fitting(exact)


def _far(points: np.ndarray, pivot: np.ndarray) -> np.ndarray:
    """Distances of points to a pivot, as doubles."""
    return np.sqrt(((points - pivot) ** 2).sum(axis=-1).astype(np.float64))


def anchors(points: np.ndarray, most: int) -> np.ndarray:
    """The anchor of each point, at most `most` anchors."""
    owner, pivots = np.zeros(len(points), np.int64), [points[0]]
    near = _far(points, pivots[0])
    while len(pivots) < most:
        spread = np.zeros(len(pivots))
        np.maximum.at(spread, owner, near)
        widest = int(spread.argmax())
        if spread[widest] == 0:
            break
        mine = np.flatnonzero(owner == widest)
        pivot = points[mine[near[mine].argmax()]]
        # a point nearer to its anchor than half the way to the new one can't change hands
        asked = np.flatnonzero(near * _MARGIN >= _far(np.array(pivots), pivot)[owner] / 2)
        found = _far(points[asked], pivot)
        won = found < near[asked]
        owner[asked[won]], near[asked[won]] = len(pivots), found[won]
        pivots.append(pivot)
    return owner


def tree(points: np.ndarray, weights: np.ndarray) -> dict:
    """The metric tree of distinct points: points and weights in tree order, their order, and of each node first and last point, children (-1 in leaves), pivot, radius, sums and count. Parents come before children."""
    order: list[np.ndarray] = []
    nodes: list[tuple] = []  # (left, right, points), children first

    def build(at: np.ndarray) -> int:
        owner = anchors(points[at], max(2, int(len(at) ** 0.5))) if len(at) > LEAF else np.zeros(len(at), np.int64)
        groups = [at[owner == a] for a in range(int(owner.max()) + 1)]
        if len(groups) == 1:
            nodes.append((-1, -1, at))
            return len(nodes) - 1
        made = [build(g) for g in groups if len(g)]
        middles = np.array([points[g].astype(np.float64).mean(axis=0) for g in groups if len(g)])
        sizes = np.array([float(len(g)) for g in groups if len(g)])
        radii = np.array([_far(points[g].astype(np.float64), m).max() for g, m in zip([g for g in groups if len(g)], middles)])
        joined = (np.sqrt(((middles[:, None] - middles[None]) ** 2).sum(2)) + radii[:, None] + radii[None]) / 2
        np.fill_diagonal(joined, np.inf)
        for _ in range(len(made) - 1):  # the two whose common ball is smallest
            i, j = divmod(int(joined.argmin()), len(joined))
            nodes.append((made[i], made[j], None))
            made[i] = len(nodes) - 1
            middles[i] = (middles[i] * sizes[i] + middles[j] * sizes[j]) / (sizes[i] + sizes[j])
            sizes[i], radii[i] = sizes[i] + sizes[j], joined[i, j]
            joined[j, :] = joined[:, j] = np.inf
            row = (np.sqrt(((middles - middles[i]) ** 2).sum(1)) + radii + radii[i]) / 2
            row[~np.isfinite(joined[i])] = np.inf
            joined[i, :] = joined[:, i] = row
        return made[i]

    root = build(np.arange(len(points)))
    # number nodes from the root down and lay their points out side by side
    spans, children, pending = [], [], [(root, -1, 0)]
    while pending:
        node, parent, side = pending.pop()
        left, right, at = nodes[node]
        me = len(spans)
        spans.append([0, 0])
        children.append([-1, -1])
        if parent >= 0:
            children[parent][side] = me
        if left < 0:
            order.append(at)
            spans[me] = [-1, len(order) - 1]
        else:
            pending += [(right, me, 1), (left, me, 0)]
    ends = np.cumsum([len(o) for o in order])
    for me in range(len(spans) - 1, -1, -1):
        if spans[me][0] == -1:
            leaf = spans[me][1]
            spans[me] = [int(ends[leaf]) - len(order[leaf]), int(ends[leaf])]
        else:
            spans[me] = [spans[children[me][0]][0], spans[children[me][1]][1]]
    flat = np.concatenate(order)
    points, weights = points[flat], weights[flat]
    sums = np.concatenate((np.zeros_like(points[:1]), np.cumsum(points * weights[:, None], axis=0)))
    counts = np.concatenate(([0], np.cumsum(weights)))
    spans = np.array(spans)
    a, b = spans.T
    pivots = (sums[b] - sums[a]) // (counts[b] - counts[a])[:, None]
    radii = np.array([_far(points[i:j], p).max() for (i, j), p in zip(spans, pivots)])
    return {"points": points, "weights": weights, "order": flat, "spans": spans, "children": np.array(children), "pivots": pivots, "radii": radii, "sums": sums[b] - sums[a], "counts": counts[b] - counts[a]}


def settle(t: dict, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Balls wholly owned and their entries, then the remaining points and theirs."""
    apart = np.sqrt(((entries[:, None] - entries[None]) ** 2).sum(2).astype(np.float64))
    twin = (apart == 0) & np.tri(len(entries), k=-1, dtype=bool)  # an entry like an earlier one never wins
    front, alive = np.zeros(1, np.int64), ~twin.any(axis=1)[None]
    balls, owners, leaves, lists = [], [], [], []
    while len(front):
        away = ((t["pivots"][front][:, None] - entries[None]) ** 2).sum(2)
        far = away.max() + 1
        best = np.where(alive, away, far).argmin(axis=1)
        gap = away - away[np.arange(len(front)), best][:, None]
        alive = alive & (gap.astype(np.float64) <= 2 * t["radii"][front][:, None] * apart[best] * _MARGIN)
        alone = alive.sum(axis=1) == 1
        balls.append(front[alone])
        owners.append(best[alone])
        down = t["children"][front, 0]
        leaf = ~alone & (down < 0)
        leaves.append(front[leaf])
        lists.append(alive[leaf])
        inner = ~alone & (down >= 0)
        front, alive = t["children"][front[inner]].ravel(), np.repeat(alive[inner], 2, axis=0)
    leaves, lists = np.concatenate(leaves), np.concatenate(lists)
    sizes = t["spans"][leaves, 1] - t["spans"][leaves, 0]
    at = np.concatenate([np.arange(*t["spans"][n]) for n in leaves]) if len(leaves) else np.zeros(0, np.int64)
    rows, columns = np.nonzero(lists[np.repeat(np.arange(len(leaves)), sizes)])
    if len(rows):
        away = ((t["points"][at[rows]] - entries[columns]) ** 2).sum(axis=1)
        least = np.minimum.reduceat(away, np.flatnonzero(np.diff(rows, prepend=-1)))
        hit = np.flatnonzero(away == least[rows])
        first = hit[np.flatnonzero(np.diff(rows[hit], prepend=-1))]  # the lowest of equally near entries
        columns = columns[first]
    return np.concatenate(balls), np.concatenate(owners), at, columns


def _distinct(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if points.dtype == object:
        seen: dict[tuple, int] = {}
        back = np.array([seen.setdefault(tuple(p), len(seen)) for p in points])
        return np.array(list(seen), object).reshape(len(seen), points.shape[1]), back, np.bincount(back)
    kept, back, counts = np.unique(points, axis=0, return_inverse=True, return_counts=True)
    return kept, back.ravel(), counts


def _trees(dim: int, parts: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, BLOCK):
                block = batch.slice(begin, BLOCK)
                flat = block.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                values = whole(flat)
                made = []
                for part in np.split(values, parts, axis=1):
                    kept, back, counts = _distinct(part)
                    t = tree(kept, counts)
                    place = np.empty(len(kept), np.int64)
                    place[t.pop("order")] = np.arange(len(kept))
                    made.append(t | {"back": place[back].astype(np.int32)})
                yield pa.RecordBatch.from_arrays([pa.array([block.column("vec_id").to_pylist()], pa.list_(block.column("vec_id").type)), pa.array([block.column("label").to_pylist()], pa.list_(block.column("label").type)), pa.array([pickle.dumps([_small(t) for t in made], 5)], pa.binary())], ["vec_id", "label", "trees"])

    return task


def _small(t: dict) -> dict:
    """64-bit integers in 32 bits where they fit."""
    limit = 1 << 31
    return {k: v.astype(np.int32) if v.dtype == np.int64 and len(v) and -limit < v.min() and v.max() < limit else v for k, v in t.items()}


def _wide(t: dict) -> dict:
    return {k: v.astype(np.int64) if v.dtype == np.int32 else v for k, v in t.items()}


def _limbs(x: int) -> Iterator[tuple[int, int]]:
    """x as limbs from the lowest; the last carries the sign."""
    at = 0
    while not -(1 << LIMB) < x < 1 << LIMB:
        yield at, x & ((1 << LIMB) - 1)
        x >>= LIMB
        at += 1
    yield at, x


def _partial_sums(books: list[np.ndarray]):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(b.shape, object) for b in books]
        counts = [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            for blob in batch.column("trees"):
                for p, t in enumerate(map(_wide, pickle.loads(blob.as_py()))):
                    balls, owners, at, mine = settle(t, books[p])
                    step = np.zeros(books[p].shape, np.int64 if t["points"].dtype == np.int64 else object)
                    np.add.at(step, owners, t["sums"][balls])
                    np.add.at(step, mine, t["points"][at] * t["weights"][at][:, None])
                    sums[p] += step
                    np.add.at(counts[p], owners, t["counts"][balls])
                    np.add.at(counts[p], mine, t["weights"][at])
        rows = [(p, e, -1, 0, int(n)) for p, c in enumerate(counts) for e, n in enumerate(c) if n]
        rows += [(p, e, i, limb, v) for p, e, _, _, _ in rows for i, x in enumerate(sums[p][e]) for limb, v in _limbs(int(x))]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int32() if k < 4 else pa.int64()) for k in range(5)], ["part", "entry", "place", "limb", "total"])

    return task


def _coded(books: list[np.ndarray]):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                found, error = [], 0
                for p, t in enumerate(map(_wide, pickle.loads(batch.column("trees")[row].as_py()))):
                    balls, owners, at, mine = settle(t, books[p])
                    entry = np.empty(len(t["points"]), np.int64)
                    for ball, owner in zip(balls, owners):
                        entry[slice(*t["spans"][ball])] = owner
                    entry[at] = mine
                    away = ((t["points"] - books[p][entry]) ** 2).sum(axis=1)
                    found.append(entry[t["back"]].astype(np.uint8))
                    error = error + away.astype(object)[t["back"]]
                codes = [bytes(c).hex() for c in np.stack(found, axis=1)]
                ids, labels = batch.column("vec_id")[row].values, batch.column("label")[row].values
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(codes, pa.string()), pa.array([min(int(e), _MOST) for e in error], pa.int64())], ["vec_id", "label", "code", "error"])

    return task


def learned(trees: DataFrame, books: list[np.ndarray], rounds: int) -> list[np.ndarray]:
    """The codebooks after so many rounds."""
    for _ in range(rounds):
        sums = trees.mapInArrow(_partial_sums(books), "part int, entry int, place int, limb int, total long")
        found: dict[tuple, int] = {}
        for r in sums.groupBy("part", "entry", "place", "limb").agg(F.sum("total").alias("total")).collect():  # ENTRIES vectors in limbs
            key = (r.part, r.entry, r.place)
            found[key] = found.get(key, 0) + (r.total << LIMB * r.limb)
        moved = [[[found[p, e, i] // n if (n := found.get((p, e, -1))) else int(x) for i, x in enumerate(entry)] for e, entry in enumerate(book)] for p, book in enumerate(books)]
        books = [_fitting(np.array(m, object).reshape(b.shape)) for m, b in zip(moved, books)]
    return books


def vector_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """Of each kept row: vec_id, label, code, error, label_error (over rows of the same label), codebooks_sha256."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    kept = vectors.select("vec_id", "label", F.col("embedding").cast("array<float>").alias("embedding")).where(F.col("embedding").isNotNull() & F.forall("embedding", finite))
    kinds = dict(kept.dtypes)
    first = [r.embedding for r in kept.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).collect()]
    dim = len(first[0]) if first else 0
    if not dim or dim % parts:
        digest = hashlib.sha256(b"").hexdigest()
        return kept.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"), F.lit(None).cast("long").alias("label_error"), F.lit(digest).alias("codebooks_sha256"))
    books = np.split(whole(np.array([v for v in first if len(v) == dim])), parts, axis=1)
    same = F.size("embedding") == dim
    trees = written(kept.where(same).mapInArrow(_trees(dim, parts), f"vec_id array<{kinds['vec_id']}>, label array<{kinds['label']}>, trees binary"), "metric-trees")
    books = learned(trees, books, rounds)
    digest = hashlib.sha256(",".join(str(int(x)) for book in books for x in book.ravel()).encode()).hexdigest()
    coded = written(trees.mapInArrow(_coded(books), f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"), "codes")
    rest = kept.where(~same).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    rows = coded.unionByName(rest)
    sums = coded.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_MOST)).cast("long").alias("label_error"))
    # one row a label: where they are few, adaptive execution sends them to the rows, and splits a hot label's rows otherwise
    rows = rows.alias("r").join(sums.withColumnRenamed("label", "sum_label"), F.col("r.label").eqNullSafe(F.col("sum_label")), "left")
    return rows.select("vec_id", "r.label", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
