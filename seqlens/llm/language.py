"""Language identification by compression (operator 7).

Each language has a raw-content zstandard dictionary: texts of that language. A text is compressed once with each; the dictionary that makes it smallest names the language.
Text is lower-cased and all but letters become spaces before it is learned from or compressed. Nulls, empty texts and texts without a letter are `und`, score 0. Ties go to the language with more labelled rows, then to the first by code point, with score 0. Training rows without text or language are left out; with none at all every text is `und`.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import slices

#: Bounds of what is learned from: documents and bytes for each language.
SAMPLE_DOCS, SAMPLE_BYTES = 400, 100_000
#: A text is rejected if the best dictionary saves less than this share against the runner-up.
MARGIN = 0.002
_LETTER, _OTHER = re.compile(r"[^\W\d_]"), re.compile(r"[\W\d_]+")


def folded(text: str) -> bytes:
    return _OTHER.sub(" ", text.lower()).encode()


def held_out(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string")) % 3 == 1


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> dict[str, bytes]:
    """A dictionary for each language, from a bounded sample of labelled rows: of the sample_docs rows first by a hash of the id, whole texts up to sample_bytes, those of at most a twentieth of that first. An id counts once in a language, with the least of its texts.

    Only ids and languages are ranked; the texts of the chosen few are read afterwards."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("doc_id").alias("ids")).collect()  # a row for each language
    often = {r["lang"]: r["n"] for r in counts}
    # only ids that the hash puts early are ranked: more than twice as many as are wanted, however many there are
    parts = docs.sparkSession.createDataFrame([(r["lang"], math.ceil(r["ids"] / (3 * sample_docs + 100))) for r in counts], "of string, parts long")
    early = labelled.select("doc_id", "lang").join(F.broadcast(parts), F.col("lang") == F.col("of"))
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 1)
    early = early.where(place < F.expr("9223372036854775807 div parts")).select("doc_id", "lang").distinct()
    order = Window.partitionBy("lang").orderBy(place, "doc_id")
    chosen = early.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= sample_docs).select(F.col("doc_id").alias("chosen_id"), F.col("lang").alias("chosen_lang"), "nth")
    rows = labelled.select("doc_id", "lang", "text").join(F.broadcast(chosen), (F.col("doc_id") == F.col("chosen_id")) & (F.col("lang") == F.col("chosen_lang")))
    rows = rows.groupBy("lang", "nth").agg(F.min("text").alias("text"))
    rows = rows.withColumn("n", F.octet_length("text")).withColumn("long", F.col("n") > sample_bytes // 20)
    filling = Window.partitionBy("lang").orderBy("long", "nth", "text")
    rows = rows.withColumn("held", F.sum("n").over(filling.rowsBetween(Window.unboundedPreceding, 0))).where((F.col("held") <= sample_bytes) | (F.col("held") == F.col("n")))
    found: dict[str, list[bytes]] = {}
    for lang, _, _, text in sorted(rows.select("lang", "long", "nth", "text").collect()):
        found.setdefault(lang, []).append(folded(text))
    return {lang: b"\n".join(found[lang]) for lang in sorted(found, key=lambda x: (-often[x], x))}


def predict(docs: DataFrame, dictionaries: dict[str, bytes], level: int = 6) -> DataFrame:
    """dictionaries: by language, in the order that ties go by. Returns doc_id, lang_pred, score (0 to 1) and margin: the share of the runner-up's bytes that the best dictionary saves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard as zstd

        langs = list(dictionaries)
        coders = []
        for lang in langs:
            learned = zstd.ZstdCompressionDict(dictionaries[lang], dict_type=zstd.DICT_TYPE_RAWCONTENT)
            learned.precompute_compress(level=level)
            coders.append(zstd.ZstdCompressor(level=level, dict_data=learned, write_content_size=False, write_checksum=False, write_dict_id=False))
        for batch in batches:
            for part, texts in slices(batch, "text"):
                preds, scores, margins = [], [], []
                for text in texts.to_pylist():
                    if not langs or not _LETTER.search(text):
                        preds.append("und"), scores.append(0.0), margins.append(0.0)
                        continue
                    raw = folded(text)
                    sizes = sorted((len(coder.compress(raw)), k) for k, coder in enumerate(coders))
                    best, second = sizes[0], sizes[1] if len(sizes) > 1 else (len(raw) + 20, -1)
                    margin = max(0.0, 1 - best[0] / max(second[0], 1))
                    preds.append(langs[best[1]]), margins.append(margin), scores.append(min(1.0, margin * 4))
                yield pa.record_batch([part.column("doc_id"), pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(margins, pa.float64())], ["doc_id", "lang_pred", "score", "margin"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, margin double")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, margin and rejected, learned from the rows that aren't held out. A row with a null id is never held out."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    found = predict(docs, learn(docs))
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score", "margin", ((F.col("lang_pred") == "und") | (F.col("margin") < MARGIN)).alias("rejected"))
