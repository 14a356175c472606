"""Token counts by dynamic programming over a trie of pre-tokens.

A unigram vocabulary gives every piece a log-probability; a pre-token is cut into the pieces of
the largest total. The best cut of a prefix does not depend on what follows, so the distinct
pre-tokens of a task are laid out as a trie and the forward score of every trie node is computed once,
level by level, from its ancestors: ``score[node] = max over pieces ending here of
score[ancestor] + log p(piece)``. The node where a pre-token ends holds its count, and documents add up
the counts of their pre-tokens. A task's trie is dropped once it has ``MAX_NODES`` nodes or ``MAX_BYTES`` bytes of
pre-tokens, so memory stays bounded; counts do not depend on that.

Vocabulary: the pieces of a public vocabulary file in order of rank; the log-probability of the piece
with rank r is the Zipf value ``-log((r + OFFSET) * H)``, H making them sum to 1. A character
without piece costs one token per UTF-8 byte, each at a score below that of every piece.

Defined results: pre-tokens are the runs of text between ASCII white space, with the word mark
``▁`` in front; a null or empty text has no pre-tokens and 0 tokens; of equal scores the cut with
fewer tokens counts; repeated rows get equal rows; an empty table gives an empty table. Only
``doc_id`` and ``text`` are read.
"""

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogspark.llm import common

MARK = "▁"
OFFSET = 10
MAX_NODES = 2_000_000
# Bytes of the pre-tokens whose counts a task's trie holds.
MAX_BYTES = 64 << 20
# Longer pre-tokens are cut one by one and not stored: a trie level for each of their characters would not pay.
LONG_WORD = 256
# Equal sums may differ in the last digits, depending on the order of additions.
TIE = 1e-9

_BASE = np.uint64(0x9E3779B97F4A7C15)


def piece_scores(pieces: list) -> dict:
    """Log-probability by piece, for pieces in order of rank."""
    ranks = np.arange(len(pieces)) + OFFSET
    total = np.log((1.0 / ranks).sum())
    return dict(zip(pieces, (-np.log(ranks) - total).tolist()))


def load_pieces(path: str) -> list:
    """Ordinary pieces of a sentencepiece model file, in order of id."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [
        model.id_to_piece(i) for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    ]


def _chars(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


class Vocabulary:
    """Pieces by length, as sorted hashes with scores."""

    def __init__(self, pieces: list):
        scores = piece_scores(pieces)
        self.byte_score = min(scores.values(), default=-1.0) - 1.0
        by_length = {}
        for piece, score in scores.items():
            by_length.setdefault(len(piece), []).append((piece, score))
        self.longest = max(by_length, default=1)
        self.tables = {}
        for length, rows in by_length.items():
            h = np.zeros(len(rows), np.uint64)
            chars = np.array([_chars(p) for p, _ in rows]).reshape(len(rows), length)
            for i in range(length):
                h = h * _BASE + common.mixed(chars[:, i] + np.uint64(1))
            order = np.argsort(h)
            self.tables[length] = h[order], np.array([s for _, s in rows])[order]

    def scores_of(self, length: int, hashes: np.ndarray) -> np.ndarray:
        """Scores of character runs of one length; -inf for those that are no pieces."""
        known, scores = self.tables.get(length, (np.zeros(0, np.uint64), np.zeros(0)))
        if not len(known):
            return np.full(len(hashes), -np.inf)
        at = np.searchsorted(known, hashes)
        at[at == len(known)] = 0
        return np.where(known[at] == hashes, scores[at], -np.inf)


def _bytes_of(chars: np.ndarray) -> np.ndarray:
    """UTF-8 length of code points."""
    return 1 + (chars >= 0x80).astype(int) + (chars >= 0x800) + (chars >= 0x10000)


def cut_directly(text: str, scores: dict, longest: int, byte_score: float) -> int:
    """Tokens of the best cut of one text, character by character."""
    # No piece reaches further back than ``longest`` characters, so that many scores are kept.
    best, count = deque([0.0], longest), deque([0], longest)
    for end in range(1, len(text) + 1):
        size = len(text[end - 1].encode("utf-8", "surrogatepass"))
        top, tokens = best[-1] + size * byte_score, count[-1] + size
        for at, first in enumerate(range(max(0, end - longest), end)):
            score = scores.get(text[first:end])
            if score is not None:
                score, n = best[at] + score, count[at] + 1
                if score > top + TIE or (abs(score - top) <= TIE and n < tokens):
                    top, tokens = score, n
        best.append(top)
        count.append(tokens)
    return count[-1]


class Trie:
    """Distinct pre-tokens of a task with the counts at their ends.

    Nodes are numbered; parent, character, forward score and token count are held per node. New words
    extend the trie level by level, all words of a batch at once.
    """

    def __init__(self, pieces: list):
        self.vocabulary = Vocabulary(pieces)
        self.scores = piece_scores(pieces)
        self.clear()

    def clear(self) -> None:
        self.ends: dict = {}
        self.size, self.bytes = 1, 0
        self.keys, self.found = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.parent, self.char = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.uint64)
        self.score, self.count = np.zeros(1 << 16), np.zeros(1 << 16, np.int64)

    def _known(self, keys: np.ndarray) -> np.ndarray:
        """Node numbers by key (parent, character); -1 for those that are not there."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == keys, self.found[at], -1)

    def _add(self, keys: np.ndarray) -> None:
        """Append nodes and compute their forward scores from their ancestors."""
        n, first = len(keys), self.size
        while first + n > len(self.parent):
            for name in ("parent", "char", "score", "count"):
                held = getattr(self, name)
                setattr(self, name, np.concatenate([held, np.zeros_like(held)]))
        parent = (keys >> np.uint64(21)).astype(np.int64)
        char = keys & np.uint64((1 << 21) - 1)
        # A character of its own bytes is always possible.
        bytes_ = _bytes_of(char)
        best = self.score[parent] + bytes_ * self.vocabulary.byte_score
        count = self.count[parent] + bytes_
        alive, ancestor, last = np.arange(n), parent.copy(), char.copy()
        run, power = np.zeros(n, np.uint64), 1
        for length in range(1, self.vocabulary.longest + 1):
            run[alive] += common.mixed(last[alive] + np.uint64(1)) * np.uint64(power)
            power = power * int(_BASE) % (1 << 64)
            if length in self.vocabulary.tables:
                score = self.score[ancestor[alive]] + self.vocabulary.scores_of(length, run[alive])
                tokens = self.count[ancestor[alive]] + 1
                better = (score > best[alive] + TIE) | ((np.abs(score - best[alive]) <= TIE) & (tokens < count[alive]))
                best[alive[better]], count[alive[better]] = score[better], tokens[better]
            alive = alive[ancestor[alive] > 0]
            if not len(alive):
                break
            last[alive] = self.char[ancestor[alive]]
            ancestor[alive] = self.parent[ancestor[alive]]
        at = slice(first, first + n)
        self.parent[at], self.char[at], self.score[at], self.count[at] = parent, char, best, count
        self.size += n

    def insert(self, words: list) -> None:
        """Add distinct words (bytes) of LONG_WORD bytes at most and store their counts."""
        short = list(words)
        texts = [_chars(MARK + word.decode()) for word in short]
        if not short:
            return
        self.bytes += sum(map(len, short))
        lengths = np.array([len(t) for t in texts])
        order = np.argsort(-lengths, kind="stable")
        flat = np.concatenate([texts[i] for i in order])
        lengths = lengths[order]
        starts = np.cumsum(lengths) - lengths
        node = np.zeros(len(short), np.int64)
        before, keys_made, numbers_made = self.size, [self.keys], [self.found]
        for depth in range(int(lengths[0])):
            n = int(np.searchsorted(-lengths, -depth, "left"))
            keys = (node[:n].astype(np.uint64) << np.uint64(21)) | flat[starts[:n] + depth]
            distinct, back = np.unique(keys, return_inverse=True)
            # Only nodes from earlier batches can have known children.
            numbers = np.full(len(distinct), -1)
            old = distinct < np.uint64(before << 21)
            numbers[old] = self._known(distinct[old])
            fresh = numbers < 0
            numbers[fresh] = self.size + np.arange(int(fresh.sum()))
            keys_made.append(distinct[fresh])
            numbers_made.append(numbers[fresh])
            self._add(distinct[fresh])
            node[:n] = numbers[back]
        keys, numbers = np.concatenate(keys_made), np.concatenate(numbers_made)
        in_order = np.argsort(keys, kind="stable")
        self.keys, self.found = keys[in_order], numbers[in_order]
        for i, tokens in zip(order.tolist(), self.count[node].tolist()):
            self.ends[short[i]] = tokens

    def counts(self, texts: list) -> tuple[list, list]:
        """Pre-tokens and tokens of each text (bytes)."""
        split = [t.split() for t in texts]
        distinct = {w for words in split for w in words}
        long = {w for w in distinct if len(w) > LONG_WORD}
        longest, byte_score = self.vocabulary.longest, self.vocabulary.byte_score
        # Held for this call only.
        own = {w: cut_directly(MARK + w.decode(), self.scores, longest, byte_score) for w in long}
        missing = distinct - long - self.ends.keys()
        if missing:
            if self.size > MAX_NODES or self.bytes > MAX_BYTES:
                self.clear()
                missing = distinct - long
            self.insert(list(missing))
        held = {**own, **{w: self.ends[w] for w in distinct - long}} if long else self.ends
        return [len(words) for words in split], [sum(map(held.__getitem__, words)) for words in split]


def token_counts(docs: DataFrame, pieces: list, max_bytes: int = 8 * common.PIECE_BYTES) -> DataFrame:
    """doc_id, n_pretokens, n_tokens of every row of ``docs`` over its whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(pieces)
    schema = pa.schema([("doc_id", pa.int64()), ("n_pretokens", pa.int64()), ("n_tokens", pa.int64())])

    def count(stream):
        trie = Trie(shared.value)
        for batch in stream:
            texts = common.filled(batch.column(1))
            _, offsets = common.buffers(texts)
            words, tokens, first = [], [], 0
            while first < len(texts):
                last = int(np.searchsorted(offsets, offsets[first] + max_bytes, "right")) - 1
                last = min(max(last, first + 1), len(texts))
                part = [t.as_py().encode() for t in texts[first:last]]
                more = trie.counts(part)
                words += more[0]
                tokens += more[1]
                first = last
            yield common.batch_of(schema, [batch.column(0), words, tokens])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(
        count, "doc_id bigint, n_pretokens bigint, n_tokens bigint"
    )
