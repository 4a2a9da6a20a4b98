"""MinHash near-dedup (operator 3): fast similarity sketches, banding, exact verification, components.

A document is its doc_id; rows repeated under one id are one document. Texts without words are linked with nothing, as are rows with a null id, which stay (component null). An empty table gives an empty result.

Plan. One pass sketches every text. Equal sets fold into one representative before banding, so copies make no pairs. In each bucket of a band every member is verified against one leader, chosen by hash (a star, not all pairs); links found that way are contracted to components.
Where a bucket still holds more than one component its members are compared across components, each pair once, and only pairs that bit maps of their sets allow to be similar leave the join. Verification is exact, on full sets, as a join of arrays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import slices, without_ids, written

#: 32 bands of 4 coordinates: of two sets that are 0.8 alike, 1 pair in 20 million shares no band.
BANDS, ROWS = 32, 4
SIMILAR = 80
#: Words of 64 bits in a set's bit map, which bounds intersections from above.
MAP = 16


def _sketch(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = K.mix(np.arange(1, BANDS + 1, dtype=K.U) * K.PLACES[40])
        for batch in batches:
            for part, texts in slices(batch, "text"):
                flat, off = K.shingles(*K.words(texts), k)
                keys = [hashlib.blake2b(flat[a:b].tobytes(), digest_size=16).digest() for a, b in zip(off[:-1], off[1:])]
                sketch = K.fast_sketches(flat, off, BANDS * ROWS).reshape(-1, BANDS, ROWS)
                bands = K.mix((sketch * K.PLACES[:ROWS]).sum(axis=2, dtype=K.U) + salt).view(np.int64)
                full = np.diff(off) > 0
                at = np.concatenate(([0], np.cumsum(full * BANDS))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(at), pa.array(bands[full].ravel()))
                owner = np.repeat(np.arange(len(off) - 1), np.diff(off))
                bits = np.zeros((len(off) - 1) * MAP, K.U)
                np.bitwise_or.at(bits, owner * MAP + (flat >> K.U(6)).astype(np.int64) % MAP, K.U(1) << (flat & K.U(63)))
                maps = pa.ListArray.from_arrays(pa.array(np.arange(len(off), dtype=np.int32) * MAP), pa.array(bits.view(np.int64)))
                yield pa.record_batch([part.column("doc_id"), pa.array(np.diff(off), pa.int64()), pa.array(keys, pa.binary()), lists, maps], ["doc_id", "n_shingles", "set_key", "bands", "bits"])

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "text"):
                flat, off = K.shingles(*K.words(texts), k)
                yield pa.record_batch([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(flat.view(np.int64)))], ["node", "shingles"])

    return run


def verified(pairs: DataFrame, sets: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= similar * union."""
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("one"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("two"))
    both = F.size(F.array_intersect("one", "two"))
    return pairs.join(one, "a").join(two, "b").where(100 * both >= similar * (F.size("one") + F.size("two") - both)).select("a", "b").distinct()


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """Connected components of edges (a, b): rows (node, component) for every node with an edge, component being the least node.

    Large-star and small-star steps alternate until nothing changes; each step aggregates before it shuffles and is written to the shared folder."""
    edges, mark = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges"), None
    for _ in range(limit):
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        # small star: each node's smaller neighbours, and itself, to the least of them
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(F.col("m").alias("p"), F.explode(F.array("a", "b")).alias("q")).where("p <> q").select(F.col("p").alias("a"), F.col("q").alias("b")).distinct()
        edges = written(small, "edges")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    stars = edges.groupBy("b").agg(F.min("a").alias("a"))
    return stars.select(F.col("b").alias("node"), F.col("a").alias("component")).unionAll(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())


def unsettled_pairs(unsettled: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """Pairs (a, b) of different components in a bucket that can be similar, each once; none that is gets lost.

    unsettled: band, node, component, major (the bucket's largest component), n, bands, bits. A pair is looked at in the first of its common bands. No intersection is larger than (|A| + |B| - differing bits of their maps) / 2, which the join itself checks."""
    theirs = unsettled.select("band", "node", "component", "major", "n", "bands", *[F.col("bits")[j].alias(f"b{j}") for j in range(MAP)])
    mine = unsettled.where("component <> major").select("band", F.col("node").alias("x"), F.col("component").alias("xc"), F.col("n").alias("xn"), F.col("bands").alias("xbands"), *[F.col("bits")[j].alias(f"x{j}") for j in range(MAP)])
    differing = sum((F.bit_count(F.col(f"b{j}").bitwiseXOR(F.col(f"x{j}"))) for j in range(1, MAP)), F.bit_count(F.col("b0").bitwiseXOR(F.col("x0"))))
    total = F.col("n") + F.col("xn")
    most = F.shiftright(total - differing, 1)
    apart = (F.col("xc") != F.col("component")) & ((F.col("component") == F.col("major")) | (F.col("x") < F.col("node")))
    first = F.array_position(F.zip_with("xbands", "bands", lambda a, b: a == b), F.lit(True)) == F.array_position("bands", F.col("band"))
    met = mine.join(theirs, "band").where(apart & (100 * F.least("n", "xn") >= similar * F.greatest("n", "xn")) & (100 * most >= similar * (total - most)) & first)
    return met.select(F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b"))


def near_duplicates(docs: DataFrame, k: int = 5, similar: int = SIMILAR) -> DataFrame:
    """Of each row of docs (doc_id, text): doc_id, n_shingles, component_id, kept."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = written(docs.mapInArrow(_sketch(k), "doc_id long, n_shingles long, set_key binary, bands array<long>, bits array<long>"), "sketches")
    live = rows.where("n_shingles > 0 and doc_id is not null")
    firsts = live.groupBy("set_key").agg(F.min_by(F.struct("doc_id", "n_shingles", "bands", "bits"), "doc_id").alias("one"))
    firsts = written(firsts.select(F.col("one.doc_id").alias("node"), F.col("one.n_shingles").alias("n"), "one.bands", "one.bits"), "firsts")
    reps = live.groupBy("set_key").agg(F.min("doc_id").alias("rep"))
    named = written(rows.select("doc_id", "n_shingles", "set_key").join(reps, "set_key", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("rep", "doc_id")).otherwise(F.col("doc_id")).alias("rep")), "named")

    banded = firsts.select("node", "n", F.explode("bands").alias("band"))
    leads = banded.groupBy("band").agg(F.count("*").alias("held"), F.min(F.struct(F.xxhash64("node", "band").alias("h"), "node", "n")).alias("lead")).where("held > 1")
    members = written(banded.join(leads, "band").select("band", "node", "n", "held", F.col("lead.node").alias("leader"), F.col("lead.n").alias("leader_n")), "members")

    sized = lambda x, y: 100 * F.least(x, y) >= similar * F.greatest(x, y)
    stars = members.where((F.col("node") != F.col("leader")) & sized(F.col("n"), F.col("leader_n"))).select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()
    wanted = members.select("node").distinct()
    sets = written(docs.join(wanted, docs.doc_id == wanted.node, "left_semi").mapInArrow(_sets(k), "node long, shingles array<long>"), "sets")
    # one document under one id: repeated rows of equal text give the same link again; of other text, further links
    repeated = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min("set_key").alias("x"), F.max("set_key").alias("y")).where("x <> y").select("doc_id")
    same_id = named.join(repeated, "doc_id", "left_semi").where("rep <> doc_id").select(F.least("rep", "doc_id").alias("a"), F.greatest("rep", "doc_id").alias("b")).distinct()
    links = written(verified(stars, sets, similar).unionAll(same_id), "links")
    found = written(components(links), "components")

    # buckets that still hold several components: pairs across them, but for those with the leader, which are verified
    placed = members.where("held > 2").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    counted = placed.groupBy("band", "component").agg(F.count("*").alias("n_in"))
    major = counted.groupBy("band").agg(F.count("*").alias("kinds"), F.max(F.struct("n_in", "component")).alias("most")).where("kinds > 1").select("band", F.col("most.component").alias("major"))
    unsettled = placed.where("node <> leader").select("band", "node", "n", "component").join(major, "band").join(firsts.select("node", "bands", "bits"), "node")
    pairs = written(unsettled_pairs(unsettled, similar), "pairs")
    more = written(verified(pairs, sets, similar), "links")
    if not more.isEmpty():
        found = written(components(links.unionAll(more)), "components")

    joined = named.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component_id", F.coalesce("component", "rep"))
    return joined.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, k: int = 5) -> DataFrame:
    """docs with one document of each component, all columns."""
    return without_ids(docs, near_duplicates(docs, k).where("not kept").select("doc_id"))
