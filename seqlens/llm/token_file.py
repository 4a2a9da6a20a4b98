"""Token-ID output in seekable zstandard files (operator 4).

A file is a run of independent zstandard frames, each with a checksum of its content, and ends with the seek table of the public seekable format: a skippable frame that lists every frame's compressed size, size and checksum.
A document's ids are little-endian unsigned 32-bit integers, the end id last. Beside each file stands an index (Parquet) of its documents: where each begins and its length, in ids. So a reader decompresses only the frames that hold what it asks for.
Documents stand in ascending doc_id order, within and across files; null ids come first, rows repeated under one id stand together, by a hash of the text and then as they stand in the table. Null text is empty: the end id alone. An empty table gives no documents.

The tokenizers library encodes. If nothing in the tokenizer's file reaches across ASCII white space (its parts are compared with those of BY_WORD when it is loaded), a text's ids are those of its words in turn, so each distinct word of a slice of texts is encoded once and remembered up to a bound; otherwise whole texts are encoded. Under the same condition, words of composed Latin letters, digits and signs are cut into pieces as that file's pattern does, and only new pieces meet the library's merges; all other words go to the library as they are.
Plan. Texts are encoded where they are read and the ids written; only ids are shuffled into ranges of documents.
Files go to a folder under the shared folder through pyarrow's file systems. A file is written under the name of its attempt and then renamed, and its contents depend on the range of documents alone, so an attempt that runs again, or twice, leaves the same file.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import shared_folder, slices, written
from .kernels import offsets_and_bytes

END = 1
FRAME_BYTES = 1 << 18
#: Bytes of text whose words are looked up together, words (and pieces) that a worker remembers, and words that go to the library as one text.
SLICE, REMEMBER, TOGETHER = 1 << 22, 150_000, 2000
# Fixed values of the public seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_CHECKSUMS = 1 << 7

# Normalisers and pre-tokenizers of a tokenizer file that keep ASCII white space apart and drop it.
BY_WORD = {
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: Stands between words that are encoded as one text.
MARK = "\x1e"
#: Characters that the rules of BY_WORD leave alone but for their case, and the pieces that its pattern finds in them, each word ending in a line feed.
_OTHER = re.compile("[^\x21-\x7e\xa1-įı-ɏ]")
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_²³¹¼½¾]+|[\d²³¹¼½¾]|(?:[^\w\s]|_)+|\n")
# The byte alphabet of byte-level models: printable Latin-1 bytes stand for themselves, the others for the characters from U+0100 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = str.maketrans({b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(_PRINTED)))})


def _parts(part: dict | None, name: str) -> list[dict]:
    return [] if part is None else part[name] if part["type"] == "Sequence" else [part]


class Encoder:
    """Texts to ids by the library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        rules = json.loads(self.tokenizer.to_str())
        # the same rules in the same order: with any other the whole text goes to the library
        plain = all(_parts(rules[one], n) == BY_WORD[n] for n, one in (("normalizers", "normalizer"), ("pretokenizers", "pre_tokenizer")))
        dropped = any(p["type"] == "Split" and p["behavior"] == "Removed" for p in _parts(rules["pre_tokenizer"], "pretokenizers"))
        whole = all(not (t["lstrip"] or t["rstrip"] or t["single_word"]) and t["content"].split() == [t["content"]] for t in rules["added_tokens"])
        mark = self.ids([MARK])[0]
        self.by_word, self.mark = plain and dropped and whole and rules["post_processor"] is None and len(mark) == 1, mark[0] if len(mark) else 0
        self.added = [t["content"] for t in rules["added_tokens"]]
        self.known: dict[str, int] = {}  # word to its place in the remembered ids
        self.kept, self.kept_at = np.zeros(0, np.uint32), np.zeros(1, np.int64)
        self.pieces: dict[str, bytes] = {}
        self.model = self.tokenizer.model

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, flat, and each word's offsets."""
        joined = "\n".join(words)
        if any(t in joined for t in self.added) or _OTHER.search(joined.replace("\n", "")):
            other = np.array([bool(_OTHER.search(w)) or any(t in w for t in self.added) for w in words], bool)
            some, far = self.plain([w for w, o in zip(words, other) if not o]), self.far([w for w, o in zip(words, other) if o])
            sizes, begin = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
            for mask, (flat, off), shift in ((~other, some, 0), (other, far, len(some[0]))):
                sizes[mask], begin[mask] = np.diff(off), off[:-1] + shift
            return _gathered(np.concatenate((some[0], far[0])), begin, sizes)
        return self.plain(words)

    def plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words without other characters or added tokens: by pieces."""
        found = pa.array(_PIECE.findall("\n".join([*words, ""]).lower()), pa.string()).dictionary_encode()
        raws = [self.piece(p) for p in found.dictionary.to_pylist()]
        size = np.array([len(r) // 4 for r in raws], np.int64)
        at = found.indices.to_numpy()
        flat, upto = _gathered(np.frombuffer(b"".join(raws), "<u4"), np.cumsum(size) - size, size, at)
        ends = np.flatnonzero(at == at[-1]) if len(words) else np.zeros(0, np.int64)  # the last is a line feed
        return flat, np.concatenate(([0], upto[ends + 1]))

    def piece(self, text: str) -> bytes:
        if (raw := self.pieces.get(text)) is None:
            known = text if text.isascii() else text.encode().decode("latin-1").translate(_BYTES)
            ids = [] if text == "\n" else [t.id for t in self.model.tokenize(known)]
            raw = struct.pack(f"<{len(ids)}I", *ids)
            if len(self.pieces) < REMEMBER and len(text) < 100:
                self.pieces[text] = raw
        return raw

    def far(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for any words: they go to the library together, with a mark between them whose id no other word has."""
        flat, sizes = [], []
        for i in range(0, len(words), TOGETHER):
            some = words[i : i + TOGETHER]
            joined = np.array(self.ids([f" {MARK} ".join(some)])[0], np.uint32)
            cuts = np.flatnonzero(joined == self.mark)
            if len(cuts) == len(some) - 1 and not any(MARK in w for w in some):
                flat.append(np.delete(joined, cuts))
                sizes.append(np.diff(np.concatenate(([-1], cuts, [len(joined)]))) - 1)
            else:  # a word holds the mark: one by one
                each = self.ids(some)
                flat.append(np.array([t for ids in each for t in ids], np.uint32))
                sizes.append(np.array([len(ids) for ids in each], np.int64))
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        return join(flat, np.uint32), np.concatenate(([0], np.cumsum(join(sizes, np.int64))))

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts (large_string, no nulls), flat, and each text's offsets."""
        if not self.by_word:
            each = self.ids(texts.to_pylist())
            return np.array([t for ids in each for t in ids], np.uint32), np.concatenate(([0], np.cumsum([len(ids) for ids in each], dtype=np.int64)))
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        n = len(coded.dictionary)
        off, data = offsets_and_bytes(coded.dictionary)
        distinct = np.insert(data, off[1:], ord("\n")).tobytes().decode().split("\n")[:-1]
        place = np.fromiter((self.known.get(w, -1) for w in distinct), np.int64, n)
        missing = np.flatnonzero(place < 0)
        fresh, fresh_at = self.words([distinct[i] for i in missing])
        # remembered and fresh ids side by side
        flat = np.concatenate((self.kept, fresh))
        begin = np.concatenate((self.kept_at[:-1], len(self.kept) + fresh_at[:-1]))
        size = np.concatenate((np.diff(self.kept_at), np.diff(fresh_at)))
        place[missing] = len(self.known) + np.arange(len(missing))
        more = [i for i in range(len(missing)) if len(distinct[missing[i]]) < 100][: max(0, REMEMBER - len(self.known))]
        if more:
            self.known.update(zip((distinct[missing[i]] for i in more), range(len(self.known), len(self.known) + len(more))))
            added, upto = _gathered(fresh, fresh_at[more], np.diff(fresh_at)[more])
            self.kept, self.kept_at = np.concatenate((self.kept, added)), np.concatenate((self.kept_at, len(self.kept) + upto[1:]))
        ids, upto = _gathered(flat, begin, size, place[coded.indices.to_numpy()])
        return ids, upto[split.offsets.to_numpy() - split.offsets[0].as_py()] if len(split) else np.zeros(1, np.int64)


def _gathered(flat: np.ndarray, begin: np.ndarray, size: np.ndarray, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Runs of flat one after another, flat, and their offsets: run i has size[i] from begin[i] on; at: which runs, all by default."""
    begin, size = (begin, size) if at is None else (begin[at], size[at])
    upto = np.concatenate(([0], np.cumsum(size)))
    return flat[np.repeat(begin - upto[:-1], size) + np.arange(upto[-1])], upto


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class FrameWriter:
    """Appends bytes to a stream as frames of about FRAME_BYTES and ends it with the seek table."""

    def __init__(self, stream, level: int = 3):
        import zstandard as zstd

        self.stream, self.coder = stream, zstd.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.held, self.size, self.table = [], 0, []

    def add(self, raw: bytes) -> None:
        self.held.append(raw)
        self.size += len(raw)
        if self.size >= FRAME_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.size:
            import xxhash

            raw = b"".join(self.held)
            frame = self.coder.compress(raw)
            self.stream.write(frame)
            self.table.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            self.held, self.size = [], 0

    def close(self) -> None:
        self.flush()
        body = b"".join(struct.pack("<III", *row) for row in self.table) + struct.pack("<IBI", len(self.table), _CHECKSUMS, SEEKABLE)
        self.stream.write(struct.pack("<II", SKIPPABLE, len(body)) + body)


class FrameReader:
    """Reads byte ranges of a file, decompressing the frames they touch and checking their checksums."""

    def __init__(self, stream, size: int):
        self.stream = stream
        stream.seek(size - 9)
        count, _, magic = struct.unpack("<IBI", stream.read(9))
        if magic != SEEKABLE:
            raise ValueError("no seek table")
        stream.seek(size - 9 - 12 * count)
        self.table = np.frombuffer(stream.read(12 * count), "<u4").reshape(-1, 3).astype(np.int64)
        self.at = np.concatenate(([0], np.cumsum(self.table[:, 0])))
        self.raw_at = np.concatenate(([0], np.cumsum(self.table[:, 1])))
        self.last = (-1, b"")

    def frame(self, k: int) -> bytes:
        if self.last[0] != k:
            import xxhash
            import zstandard as zstd

            self.stream.seek(int(self.at[k]))
            raw = zstd.ZstdDecompressor().decompress(self.stream.read(int(self.table[k, 0])))
            if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.table[k, 2]:
                raise ValueError(f"frame {k} fails its checksum")
            self.last = (k, raw)
        return self.last[1]

    def read(self, begin: int, size: int) -> bytes:
        out, k = [], int(np.searchsorted(self.raw_at, begin, "right")) - 1
        while size > 0:
            raw = self.frame(k)
            got = raw[begin - int(self.raw_at[k]) :][:size]
            out.append(got)
            begin, size, k = begin + len(got), size - len(got), k + 1
        return b"".join(out)


def _place(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def encoded(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Of each row of docs (doc_id, text): doc_id, h (a hash of the text), ids (binary, the end id last) and width, the bytes of an id in it: 2 where all ids of a slice fit, else 4."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = encoder(tokenizer)
        for batch in batches:
            for part, texts in slices(batch, "text", SLICE):
                ids, off = library.texts(texts)
                raw = np.insert(ids, off[1:], END).astype("<u4")
                width = 2 if raw.max() < 1 << 16 else 4
                off = width * (off + np.arange(len(off)))
                column = pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(raw.astype(f"<u{width}"))]).cast(pa.binary())
                yield pa.record_batch([part.column("doc_id"), part.column("h"), column, pa.array([width] * len(texts), pa.int32())], ["doc_id", "h", "ids", "width"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    return rows.mapInArrow(run, "doc_id long, h long, ids binary, width int")


def write(docs: DataFrame, tokenizer: str, folder: str, files: int | None = None) -> DataFrame:
    """Encode docs (doc_id, text) into files under folder. Returns the index: file, nth (in the file), doc_id, at and n_tokens (in ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        system, path = _place(folder)
        name = f"part-{task.partitionId():06d}.zst"
        mine = f"{path}/.{name}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        system.create_dir(path, recursive=True)
        at, nth, index = 0, 0, []
        with system.open_output_stream(mine) as stream:
            writer = FrameWriter(stream)
            for batch in batches:
                rows, widths = batch.column("ids"), batch.column("width").to_pylist()
                n, sizes = len(rows), np.zeros(len(rows), np.int64)
                for i, (raw, width) in enumerate(zip(rows, widths)):
                    ids = np.frombuffer(raw.as_buffer(), f"<u{width}").astype("<u4")
                    sizes[i] = len(ids)
                    writer.add(ids.tobytes())
                upto = at + np.cumsum(sizes)
                index.append(pa.record_batch([pa.array([name] * n, pa.string()), pa.array(range(nth, nth + n), pa.int64()), batch.column("doc_id"), pa.array(upto - sizes, pa.int64()), pa.array(sizes, pa.int64())], ["file", "nth", "doc_id", "at", "n_tokens"]))
                at, nth = int(upto[-1]) if n else at, nth + n
            writer.close()
        system.move(mine, f"{path}/{name}")
        yield from index

    rows = written(encoded(docs, tokenizer).withColumn("row", F.monotonically_increasing_id()), "token-ids")
    order = [F.col("doc_id").asc_nulls_first(), "h", "row"]
    dealt = rows.repartitionByRange(*([files] if files else []), *order).sortWithinPartitions(*order)
    return written(dealt.select("doc_id", "ids", "width").mapInArrow(run, "file string, nth long, doc_id long, at long, n_tokens long"), "token-index")


def read(index: DataFrame, folder: str) -> DataFrame:
    """The documents of the index (or of any part of it) from the files: file, nth, doc_id, ids (binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _place(folder)
        name, stream, reader = None, None, None
        for batch in batches:
            out, held = [], 0
            for row in batch.to_pylist():
                if row["file"] != name:
                    if stream:
                        stream.close()
                    name = row["file"]
                    stream = system.open_input_file(f"{path}/{name}")
                    reader = FrameReader(stream, stream.size())
                out.append((row["file"], row["nth"], row["doc_id"], reader.read(4 * row["at"], 4 * row["n_tokens"])))
                held += 4 * row["n_tokens"]
                if held > 1 << 22:
                    yield _rows(out)
                    out, held = [], 0
            if out:
                yield _rows(out)
        if stream:
            stream.close()

    return index.select("file", "nth", "doc_id", "at", "n_tokens").repartitionByRange("file", "nth").sortWithinPartitions("file", "nth").mapInArrow(run, "file string, nth long, doc_id long, ids binary")


def _rows(out: list) -> pa.RecordBatch:
    return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.binary()))], ["file", "nth", "doc_id", "ids"])


def digests(read_back: DataFrame) -> DataFrame:
    """file, nth, doc_id, n_tokens and ids_crc32 of documents as read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids").to_pylist()
            yield pa.record_batch([batch.column("file"), batch.column("nth"), batch.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64())], ["file", "nth", "doc_id", "n_tokens", "ids_crc32"])

    return read_back.mapInArrow(run, "file string, nth long, doc_id long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, files: int | None = None) -> DataFrame:
    """Write docs, read the files back and return of each document as read: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    folder = f"{shared_folder(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    index = write(docs, tokenizer, folder, files)
    found = written(digests(read(index, folder)), "token-digests")
    # a row for each file: files are as many as shuffle partitions, whatever the table holds
    totals = found.groupBy("file").agg(F.sum("n_tokens").alias("held"))
    offsets = totals.withColumn("before", F.sum("held").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, 0)) - F.col("held")).select("file", "before")
    inside = Window.partitionBy("file").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    upto = found.withColumn("upto", F.sum("n_tokens").over(inside))
    return upto.join(F.broadcast(offsets), "file").select("doc_id", (F.col("before") + F.col("upto") - F.col("n_tokens")).alias("start"), "n_tokens", "ids_crc32")
