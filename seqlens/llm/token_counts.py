"""Token counts by trie-shared dynamic programming (operator 1).

A pre-token is a word with a word-start mark. Its tokens are those of the likeliest segmentation under a unigram model over the pieces of a public vocabulary: forward scores, from left to right, of the best segmentation of each prefix.
The distinct pre-tokens of a slice of texts form a trie. They are sorted, so words with a common prefix stand side by side and a node is a stretch of them; level by level each node, that is each shared prefix, is scored once from the scores of the levels before it. Where a pre-token ends, its number of tokens is the count of that node.
A piece's log-probability follows its rank by Zipf's law. A character that no piece covers falls back to its UTF-8 bytes, each a token. Equal scores take fewer tokens.
Null and wordless texts have no tokens; every row of the table gives a row.

Plan. No shuffle: each slice of texts has a trie of its own, so memory is bounded by the slice. Levels are numpy arrays over words; where only a few long words are left, the rest of each is scored character by character, again once for each shared prefix.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .kernels import offsets_and_bytes

#: Bytes of text that share a trie, and the number of live words from which on a level isn't worth an array.
SLICE, FEW = 1 << 23, 48
START = "▁"
U = np.uint64


def unigram(pieces: list[str]) -> dict[str, float]:
    """Log-probabilities of pieces given by rank."""
    total = math.log(sum(1 / (r + 2) for r in range(len(pieces))))
    return {p: -math.log(r + 2) - total for r, p in enumerate(pieces)}


def vocabulary(path: str) -> list[str]:
    """The text pieces of a sentencepiece file, by rank."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(len(model)) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


class Pieces:
    """A unigram model that is read backwards: from the last character of a prefix, which pieces end there."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.longest = max(map(len, scores), default=0)
        self.byte = min(scores.values(), default=-10.0) - 5
        #: The end of a piece to its state; the empty end is state 0.
        self.tails = {t: i for i, t in enumerate(sorted({p[i:] for p in scores for i in range(len(p) + 1)} | {""}, key=lambda t: (len(t), t)))}
        self.score = np.full(len(self.tails), np.nan)
        for piece, score in scores.items():
            self.score[self.tails[piece]] = score
        # steps from a state to the one with a further character before it, as an open-addressed table
        self.bits = max(8, (4 * len(self.tails)).bit_length())
        self.keys, self.to = np.zeros(1 << self.bits, U), np.full(1 << self.bits, -1, np.int32)
        for tail, state in self.tails.items():
            if tail:
                key = self.tails[tail[1:]] << 21 | ord(tail[0])
                slot = (key * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 64 - self.bits
                while self.keys[slot]:
                    slot = slot + 1 & (1 << self.bits) - 1
                self.keys[slot], self.to[slot] = key, state

    def step(self, states: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """The states that the characters before lead to, -1 where no piece goes on."""
        key = states.astype(U) << U(21) | chars.astype(U)
        slot = (key * U(0x9E3779B97F4A7C15) >> U(64 - self.bits)).astype(np.int64)
        open_ = np.flatnonzero((self.keys[slot] != key) & (self.keys[slot] != 0))
        while len(open_):
            slot[open_] = slot[open_] + 1 & (1 << self.bits) - 1
            at = self.keys[slot[open_]]
            open_ = open_[(at != key[open_]) & (at != 0)]
        return np.where(self.keys[slot] == key, self.to[slot], -1)

    def count(self, words: pa.Array) -> np.ndarray:
        """Tokens of each of these distinct words (large_string, no nulls, none empty)."""
        n = len(words)
        if not n:
            return np.zeros(0, np.int64)
        order = pc.sort_indices(words).to_numpy()
        off, data = offsets_and_bytes(words)
        codes = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        begun = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[off]
        begin, size = begun[:-1][order], np.diff(begun)[order] + 1  # the mark counts
        mark, ring = ord(START), self.longest + 1
        best = np.zeros((ring, n))  # of each word's prefix at the last levels: score of the best segmentation, its tokens
        tokens = np.zeros((ring, n), np.int32)
        node, found = np.zeros(n, np.int32), np.zeros(n, np.int64)
        live, level = np.arange(n), 0
        while len(live) > FEW or level == 0:
            level += 1
            char = codes[begin[live] + level - 2] if level > 1 else np.full(n, mark, np.uint32)
            fresh = np.ones(len(live), bool)
            fresh[1:] = (char[1:] != char[:-1]) | (node[live[1:]] != node[live[:-1]])
            heads, inside = np.flatnonzero(fresh), np.cumsum(fresh) - 1
            score, held = self._level(level, live[heads], char[heads], codes, begin, best, tokens)
            node[live], best[level % ring, live], tokens[level % ring, live] = inside, score[inside], held[inside]
            over = size[live] == level
            found[live[over]] = tokens[level % ring, live[over]]
            live = live[~over]
        if len(live):
            self._rest(level, live, codes, begin, size, best, tokens, found)
        out = np.empty(n, np.int64)
        out[order] = found
        return out

    def _level(self, level: int, word: np.ndarray, char: np.ndarray, codes, begin, best, tokens) -> tuple[np.ndarray, np.ndarray]:
        """Scores and tokens of the nodes of a level, each given by a word that has it and its last character."""
        ring, m = len(best), len(word)
        score, held = np.full(m, -np.inf), np.full(m, 1 << 30, np.int32)
        at, state = np.arange(m), np.zeros(m, np.int32)
        alone = np.zeros(m, bool)  # whether the last character is a piece
        for back in range(1, min(level, self.longest) + 1):
            start = level - back  # the piece would begin after this level
            before = char[at] if back == 1 else codes[begin[word[at]] + start - 1] if start else np.full(len(at), ord(START), np.uint32)
            state = self.step(state, before)
            on = state >= 0
            at, state = at[on], state[on]
            if not len(at):
                break
            value = self.score[state]
            is_piece = ~np.isnan(value)
            p = at[is_piece]
            if back == 1:
                alone[p] = True
            got, n = best[start % ring, word[p]] + value[is_piece], tokens[start % ring, word[p]] + 1
            more = (got > score[p]) | ((got == score[p]) & (n < held[p]))
            score[p[more]], held[p[more]] = got[more], n[more]
        p = np.flatnonzero(~alone)
        c = char[p]
        n = 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)
        got, n = best[(level - 1) % ring, word[p]] + n * self.byte, tokens[(level - 1) % ring, word[p]] + n
        more = (got > score[p]) | ((got == score[p]) & (n < held[p]))
        score[p[more]], held[p[more]] = got[more], n[more]
        return score, held

    def _rest(self, level: int, live: np.ndarray, codes, begin, size, best, tokens, found: np.ndarray) -> None:
        """The levels beyond, of a few sorted words: each from where it parts from the one before."""
        ring, last = len(best), ""
        low = max(0, level - self.longest)
        score, held = array("d"), array("q")
        for w in live.tolist():
            text = START + codes[begin[w] : begin[w] + size[w] - 1].tobytes().decode("utf-32-le")
            same = len(commonprefix((last, text)))
            if same > level:
                del score[same + 1 - low :], held[same + 1 - low :]
            else:
                score = array("d", [best[i % ring, w] for i in range(low, level + 1)])
                held = array("q", [int(tokens[i % ring, w]) for i in range(low, level + 1)])
            for i in range(low + len(score), len(text) + 1):
                top = None
                for back in range(1, min(i, self.longest) + 1):
                    tail = text[i - back : i]
                    if tail not in self.tails:
                        break
                    if (value := self.scores.get(tail)) is not None:
                        got = (score[i - back - low] + value, -held[i - back - low] - 1)
                        top = got if top is None else max(top, got)
                if text[i - 1] not in self.scores:
                    n = len(text[i - 1].encode())
                    got = (score[i - 1 - low] + n * self.byte, -held[i - 1 - low] - n)
                    top = got if top is None else max(top, got)
                score.append(top[0]), held.append(-top[1])
            found[w], last = held[-1], text


_models: dict[str, Pieces] = {}


def model(path: str) -> Pieces:
    """One for each worker process and vocabulary."""
    if path not in _models:
        _models[path] = Pieces(unigram(vocabulary(path)))
    return _models[path]


def counts(texts: pa.Array, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Words and tokens of each text (large_string, no nulls)."""
    split = pc.ascii_split_whitespace(texts)
    each = split.flatten().dictionary_encode()
    words = each.dictionary
    size = np.zeros(len(words) + 1, np.int64)
    real = pc.greater(pc.binary_length(words), 0)  # white space at either end leaves empty words
    size[:-1][real.to_numpy(zero_copy_only=False)] = pieces.count(words.filter(real))
    at = each.indices.to_numpy()
    off = split.offsets.to_numpy() - split.offsets[0].as_py() if len(split) else np.zeros(1, np.int64)
    upto = lambda x: np.concatenate(([0], np.cumsum(x)))[off]
    return np.diff(upto(size[at] > 0)), np.diff(upto(size[at]))


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_words and n_tokens of each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(path)
        for batch in batches:
            for part, texts in slices(batch, "text", SLICE):
                n_words, n_tokens = counts(texts, pieces)
                yield pa.record_batch([part.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], ["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, n_tokens long")
