"""Queries: review queues and tags (C6, G25, J3-J4, K)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ranking, review
from ..sources.publish import published
from . import adapters as A
from .boxes import JUDGED, judged_boxes
from .records import place
from .registry import query, rounded

BAD = "list_filter(tags, lambda t: NOT (t IN ('label:add-smoke', 'label:remove-gt', 'label:fix-bbox', 'label:ok', 'status:unclear', 'system:vocab-seed') OR starts_with(t, 'reviewer:')))"
UNSEEDED = "SELECT * FROM v_tag WHERE NOT list_contains(tags, 'system:vocab-seed')"


def text(column: str):
    return F.array_join(column, ",")


@query(f"SELECT stem, array_to_string({BAD}, ',') AS invalid FROM ({UNSEEDED})")
def c6_invalid_tags(spark, d):
    rows = review.without_seeds(A.tags(spark, d))
    return rows.select("stem", F.array_join(review.invalid_tags("tags", review.VOCABULARY), ",").alias("invalid"))


@query("SELECT dataset, count(*) FILTER (len(list_filter(tags, lambda t: starts_with(t, 'label:'))) > 0) AS reviewed, count(*) AS total FROM v_tag GROUP BY 1")
def g25_progress(spark, d):
    return review.progress(A.tags(spark, d), ["dataset"])


@query(f"SELECT stem, round(max(confidence), 6) AS max_confidence, count(*) AS n_fp FROM ({JUDGED}) WHERE verdict = 'fp' AND confidence >= 0.5e0 GROUP BY 1")
def j3_fp_queue(spark, d):
    return rounded(ranking.fp_queue(judged_boxes(spark, d), 0.5))


@query(f"SELECT stem, round(max(area), 6) AS max_area, count(*) AS n_fn FROM ({JUDGED}) WHERE verdict = 'fn' GROUP BY 1")
def j4_fn_queue(spark, d):
    return rounded(ranking.fn_queue(judged_boxes(spark, d)))


@query("SELECT stem, array_to_string(list_sort(list_distinct(list_concat(coalesce(a.tags, []), coalesce(b.tags, [])))), ',') AS tags FROM (SELECT stem, tags FROM v_tag WHERE doc_id % 2 = 0 OR doc_id % 3 = 0) a FULL JOIN (SELECT stem, ['label:ok', 'reviewer:zed'] AS tags FROM v_tag WHERE doc_id % 3 = 0 OR doc_id % 7 = 0) b USING (stem)")
def k1_merge_tags(spark, d):
    rows = A.tags(spark, d)
    existing = rows.where("doc_id % 2 = 0 or doc_id % 3 = 0").select("stem", "tags")
    incoming = rows.where("doc_id % 3 = 0 or doc_id % 7 = 0").select("stem", F.array(F.lit("label:ok"), F.lit("reviewer:zed")).alias("tags"))
    return review.merge_tags(existing, incoming).select("stem", text("tags").alias("tags"))


@query("SELECT dataset, stem, array_to_string(list_sort(list_distinct(tags)), ',') AS tags FROM v_tag WHERE len(tags) > 0")
def k2_payload_rows(spark, d):
    return review.rows_of_payload(review.payload(A.tags(spark, d), ["dataset"]), ["dataset"]).select("dataset", "stem", text("tags").alias("tags"))


GOOD = "list_filter(p.tags, lambda t: t IN ('label:add-smoke', 'label:remove-gt', 'label:fix-bbox', 'label:ok', 'status:unclear', 'system:vocab-seed') OR starts_with(t, 'reviewer:'))"


@query(f"""SELECT stem, array_to_string(list_sort(list_distinct(list_concat(have, good))), ',') AS tags, len(list_filter(good, lambda t: NOT list_contains(have, t))) > 0 AS touched, n_stripped FROM (SELECT d.stem, ['label:ok'] AS have, coalesce({GOOD}, []) AS good, CAST(coalesce(len(p.tags) - len({GOOD}), 0) AS INT) AS n_stripped FROM v_tag d LEFT JOIN (SELECT * FROM v_tag WHERE doc_id % 2 = 0) p USING (stem))""")
def k3_import_tags(spark, d):
    rows = A.tags(spark, d)
    dataset = rows.select("stem", F.array(F.lit("label:ok")).alias("tags"))
    return review.import_tags(dataset, rows.where("doc_id % 2 = 0").select("stem", "tags"), review.VOCABULARY).select("stem", text("tags").alias("tags"), "touched", "n_stripped")


SCAN = f"SELECT dataset, tag, count(DISTINCT stem) AS n FROM (SELECT dataset, stem, unnest({BAD}) AS tag FROM v_tag) GROUP BY 1, 2"


@query(SCAN)
def k4_scan_invalid(spark, d):
    return review.scan_invalid(A.tags(spark, d), review.VOCABULARY, ["dataset"])


@query(f"SELECT dataset, tag || ': ' || n AS line FROM ({SCAN})")
def k4_report(spark, d):
    return review.report(review.scan_invalid(A.tags(spark, d), review.VOCABULARY, ["dataset"]), ["dataset"])


#: Sequence similarity: the longest common stretch (first in the word, then in the tag), then the same to its left and right.
CLOSEST = f"""SELECT * FROM (
WITH RECURSIVE pairs AS (
    SELECT tag, word
    FROM (SELECT DISTINCT unnest({BAD}) AS tag FROM v_tag), (SELECT unnest(['label:add-smoke', 'label:remove-gt', 'label:fix-bbox', 'label:ok', 'status:unclear']) AS word)
), spots AS (
    SELECT tag, word, i, j, unnest(range(1, least(len(word) - i, len(tag) - j) + 1)) AS k
    FROM (SELECT tag, word, i, unnest(range(0, len(tag))) AS j FROM (SELECT tag, word, unnest(range(0, len(word))) AS i FROM pairs))
), common AS (
    SELECT tag, word, i, j, max(k) AS k FROM spots WHERE word[i + 1 : i + k] = tag[j + 1 : j + k] GROUP BY ALL
), parts AS (
    SELECT tag, word, CAST(0 AS BIGINT) AS a, len(word) AS b, CAST(0 AS BIGINT) AS c, len(tag) AS d, CAST(0 AS BIGINT) AS matched FROM pairs
    UNION ALL
    SELECT tag, word, side.a, side.b, side.c, side.d, side.matched FROM (
        SELECT tag, word, unnest([
            {{'a': a, 'b': i, 'c': c, 'd': j, 'matched': k}},
            {{'a': i + k, 'b': b, 'c': j + k, 'd': d, 'matched': 0}}]) AS side
        FROM (
            SELECT tag, word, a, b, c, d, i, j, least(k, b - i, d - j) AS k,
                row_number() OVER (PARTITION BY tag, word, a, b, c, d ORDER BY least(k, b - i, d - j) DESC, i, j) AS place
            FROM parts JOIN common USING (tag, word) WHERE i >= a AND i < b AND j >= c AND j < d)
        WHERE place = 1)
), scored AS (
    SELECT tag, word, 2.0e0 * sum(matched) / (len(tag) + len(word)) AS similarity FROM parts GROUP BY tag, word
)
SELECT tag, max({{'s': similarity, 'w': word}}) FILTER (similarity >= 0.7e0).w AS suggestion FROM scored GROUP BY tag)
"""


@query(CLOSEST)
def k5_suggestions(spark, d):
    return review.suggestions(review.scan_invalid(A.tags(spark, d), review.VOCABULARY, ["dataset"]), review.VOCABULARY)


@query("SELECT DISTINCT dataset, regexp_extract(dataset, '^dq-frame_(.+)_([^_]+)$', 1) AS model, regexp_extract(dataset, '^dq-frame_(.+)_([^_]+)$', 2) AS split FROM v_tag")
def k6_dataset_parts(spark, d):
    model, split = review.dataset_parts("dataset")
    return A.tags(spark, d).select("dataset", model.alias("model"), split.alias("split")).distinct()


@query(f"SELECT dataset, sum(n) = 0 AS may_export FROM (SELECT dataset, len({BAD}) AS n FROM v_tag) GROUP BY 1")
def k7_export_gate(spark, d):
    bad = F.size(review.invalid_tags("tags", review.VOCABULARY))
    return A.tags(spark, d).groupBy("dataset").agg((F.sum(bad) == 0).alias("may_export"))


GOOD = f"SELECT doc_id, dataset, stem, tags FROM v_tag WHERE len({BAD}) = 0"


@query(f"SELECT dataset, regexp_extract(dataset, '^dq-frame_(.+)_([^_]+)$', 1) AS model, regexp_extract(dataset, '^dq-frame_(.+)_([^_]+)$', 2) AS split, count(*) AS n_stems, CAST(sum(len(list_distinct(tags))) AS BIGINT) AS n_tags FROM ({GOOD}) WHERE len(tags) > 0 GROUP BY 1")
def k7_published_tags(spark, d):
    """Datasets' valid rows are published; all rows, invalid tags among them, are then refused and leave the state as it was."""
    path = place(spark, "tags")
    rows = A.tags(spark, d)
    review.publish_tags(rows.where(F.size(review.invalid_tags("tags", review.VOCABULARY)) == 0), review.VOCABULARY, path)
    try:
        review.publish_tags(rows, review.VOCABULARY, path)
    except ValueError:
        pass
    else:
        raise AssertionError("invalid tags were published")
    found = review.rows_of_payload(published(spark, path), ["dataset", "model", "split"])
    return found.groupBy("dataset", "model", "split").agg(F.count("*").alias("n_stems"), F.sum(F.size("tags")).alias("n_tags"))
