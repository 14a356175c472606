"""Language-model scores: a hashed maximum-entropy model with a class-factored softmax.

A token is a lower-cased word, or the end of a text. Its probability has two factors: the class of
the word given the words before it, and the word given its class. Classes come from hashed word endings
(the end token is a class of its own). The first factor is a softmax over the classes, its logits
the sum of weights of hashed features: the last word, the last two words together, and, skipping one
or two words, the endings of those before. The second factor is the smoothed share of the word among
the training tokens of its class, with one place per class for words never seen in training.

Training: every training text has a turn in one of ``ROUNDS`` rounds. In a round each task starts from the
shared weights, walks the texts in turn in small batches with gradient steps, and hands back its weights with
the number of its tokens; the weighted mean is the start of the next round. All sums have a fixed size. Word counts of all training texts
are gathered by hash bucket. Scoring works on whole batches of tokens at once.

Rare words are counted where they meet: scoring sends every token that is not among the most frequent
ones (``COMMON``, a bounded table) to the bucket of its hash, which knows its count and sends back one
partial sum per document.

Defined results: a null or empty text is the end token alone; rows without ``doc_id`` have the fold of the
empty text; repeated rows count and score one by one; without training texts every class is equally
likely and nothing is known; an empty table gives an empty table. Only ``doc_id`` and ``text`` are read.
"""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogspark.llm import common
from catalogspark.session import freeze

CLASSES = 32
ROWS = 1 << 13
FEATURES = 4
ROUNDS = 2
BATCH = 1024
RATE = 0.1
# Tokens that are scored at once.
SCORED = 1 << 14
SMOOTHING = 0.1

COMMON = 1 << 16
FLUSH_TOKENS = 1 << 22
# Text bytes whose rare words meet in one bucket.
BUCKET_BYTES = 64 << 20
# Rows of weights that travel together, and tasks whose weights are added in one group.
SLICE_ROWS = 1024
TEAM = 64

_END = np.uint64(0x1E0D)
_START = 0x57A7


def tokens_of(data: np.ndarray, offsets: np.ndarray):
    """Tokens of a piece: hash, class, ending and row of each, ends included."""
    data = common.lowered(data)
    starts, ends, bounds = common.word_spans(data, offsets)
    words = common.span_hashes(data, starts, ends)
    rows = len(offsets) - 1
    lengths = ends - starts
    ending = np.zeros(len(words), np.uint64)
    two = np.zeros(len(words), np.uint64)
    for back in (1, 2, 3):
        byte = np.where(lengths >= back, data[np.maximum(ends - back, 0)] if len(data) else 0, 0).astype(np.uint64)
        ending |= byte << np.uint64(8 * back)
        if back == 2:
            two = ending.copy()
    counts = np.diff(bounds)
    # An end token after the words of every row.
    at = np.arange(len(words)) + np.repeat(np.arange(rows), counts)
    total = len(words) + rows
    token = np.full(total, _END)
    token[at] = words
    tail = np.zeros(total, np.uint64)
    tail[at] = common.mixed(ending)
    kind = np.zeros(total, np.uint8)
    kind[at] = 1 + (common.mixed(two) % np.uint64(CLASSES - 1)).astype(np.uint8)
    row = np.repeat(np.arange(rows), counts + 1)
    place = np.arange(total) - np.repeat(bounds[:-1] + np.arange(rows), counts + 1)
    return token, kind, tail, row, place


def features_of(token, tail, place) -> np.ndarray:
    """Weight rows of every token's context, one column per feature."""

    def before(values, steps):
        out = np.full(len(values), np.uint64(_START + steps))
        out[steps:] = np.where(place[steps:] >= steps, values[:-steps], out[steps:]) if len(values) > steps else out[steps:]
        return out

    last = before(token, 1)
    parts = [
        last, common.mixed(last * np.uint64(3) + before(token, 2)), before(tail, 2), common.mixed(before(tail, 3)),
    ]
    return np.stack([(p % np.uint64(ROWS)).astype(np.int32) + i * ROWS for i, p in enumerate(parts)], axis=1)


def log_softmax(weights: np.ndarray, level: np.ndarray, features: np.ndarray) -> np.ndarray:
    logits = level + weights[features[:, 0]]
    for i in range(1, FEATURES):
        logits += weights[features[:, i]]
    logits -= logits.max(axis=1, keepdims=True)
    logits -= np.log(np.exp(logits).sum(axis=1, keepdims=True))
    return logits


class Learner:
    """Gradient steps on one task's texts, each weight with its own step size."""

    def __init__(self, weights: np.ndarray, level: np.ndarray):
        self.weights, self.level = weights.copy(), level.copy()
        self.seen = np.full(len(weights), 1e-2, np.float32)
        self.level_seen = np.float32(1e-2)
        self.tokens = 0

    def learn(self, features: np.ndarray, kind: np.ndarray) -> None:
        for first in range(0, len(kind), BATCH):
            f, k = features[first:first + BATCH], kind[first:first + BATCH]
            grad = np.exp(log_softmax(self.weights, self.level, f))
            grad[np.arange(len(k)), k] -= 1
            self.tokens += len(k)
            total = grad.sum(axis=0)
            self.level_seen += float((total * total).mean())
            self.level -= RATE * total / np.sqrt(self.level_seen)
            for i in range(FEATURES):
                order = np.argsort(f[:, i], kind="stable")
                row = f[order, i]
                head = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                sums = np.add.reduceat(grad[order], head, axis=0)
                row = row[head]
                self.seen[row] += (sums * sums).mean(axis=1)
                self.weights[row] -= RATE * sums / np.sqrt(self.seen[row])[:, None]


def _rows(docs: DataFrame, held_out: Column) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint"), "text", (~held_out).alias("train"))


def _flags(column) -> np.ndarray:
    return np.asarray(column.to_numpy(zero_copy_only=False), bool)


def _bucket_bits(docs: DataFrame) -> int:
    total = docs.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    return min(20, max(3, int(total // BUCKET_BYTES).bit_length()))


def _slices(buckets: np.ndarray, count: int):
    edges = np.searchsorted(buckets, np.arange(count + 1))
    return [(b, edges[b], edges[b + 1]) for b in range(count) if edges[b] < edges[b + 1]]


def _packed(schema, tokens, columns, bits):
    """One row per bucket of (bucket, packed columns), tokens sorted by bucket first."""
    buckets = (tokens >> np.uint64(64 - bits)).astype(np.int64)
    order = np.argsort(buckets, kind="stable")
    cuts = _slices(buckets[order], 1 << bits)
    held = [c[order] for c in columns]
    return [[b for b, _, _ in cuts], *[[c[i:j].tobytes() for _, i, j in cuts] for c in held]]


def counts(rows: DataFrame, bits: int):
    """Training tokens and distinct tokens by class, and the most frequent tokens with their counts."""
    out = pa.schema([("bucket", pa.int32()), ("tokens", pa.binary()), ("counts", pa.binary()), ("kinds", pa.binary())])

    def count(stream):
        held, kinds, total = [], [], 0

        def flushed():
            tokens, first, n = np.unique(np.concatenate(held), return_index=True, return_counts=True)
            kind = np.concatenate(kinds)[first]
            return common.batch_of(out, _packed(out, tokens, [tokens, n.astype("<u4"), kind], bits))

        for batch in stream:
            train = _flags(batch.column(2))
            for first, last, data, offsets in common.pieces(common.filled(batch.column(1))):
                token, kind, _, row, _ = tokens_of(data, offsets)
                used = train[first:last][row]
                held.append(token[used])
                kinds.append(kind[used])
                total += len(held[-1])
                if total >= FLUSH_TOKENS:
                    yield flushed()
                    held, kinds, total = [], [], 0
        if total:
            yield flushed()

    sums = pa.schema([("n", pa.binary()), ("distinct", pa.binary()), ("tokens", pa.binary()), ("counts", pa.binary())])
    most = COMMON >> bits

    def gather(table: pa.Table) -> pa.Table:
        def column(name, kind):
            return np.frombuffer(b"".join(table[name].to_pylist()), kind)

        tokens, n, kinds = column("tokens", "<u8"), column("counts", "<u4").astype(np.int64), column("kinds", "u1")
        order = np.argsort(tokens, kind="stable")
        tokens, n, kinds = tokens[order], n[order], kinds[order]
        head = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        tokens, n, kinds = tokens[head], np.add.reduceat(n, head), kinds[head]
        by_class = np.bincount(kinds, n, CLASSES).astype(np.int64), np.bincount(kinds, minlength=CLASSES)
        top = np.lexsort((tokens, -n))[:most]
        return pa.Table.from_batches([common.batch_of(sums, [
            [by_class[0].astype("<i8").tobytes()], [by_class[1].astype("<i8").tobytes()],
            [tokens[top].tobytes()], [n[top].astype("<i8").tobytes()],
        ])])

    made = (
        rows.mapInArrow(count, "bucket int, tokens binary, counts binary, kinds binary")
        .groupBy("bucket").applyInArrow(gather, "n binary, distinct binary, tokens binary, counts binary")
        .collect()  # COMMON tokens in all
    )
    n, distinct = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for part in made:
        n += np.frombuffer(part["n"], "<i8")
        distinct += np.frombuffer(part["distinct"], "<i8")
    tokens = np.frombuffer(b"".join(part["tokens"] for part in made), "<u8")
    totals = np.frombuffer(b"".join(part["counts"] for part in made), "<i8")
    order = np.argsort(tokens)
    return n, distinct, tokens[order], totals[order]


def trained(rows: DataFrame, level: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and class levels after ``rounds`` rounds that take every training text once."""
    spark = rows.sparkSession
    weights = np.zeros((FEATURES * ROWS, CLASSES), np.float32)
    schema = pa.schema([("part", pa.int32()), ("team", pa.int32()), ("n", pa.int64()), ("weights", pa.binary())])
    types = "part int, team int, n bigint, weights binary"

    def task(stream, shared):
        learner = Learner(*shared.value)
        for batch in stream:
            for _, _, data, offsets in common.pieces(common.filled(batch.column(1))):
                token, kind, tail, _, place = tokens_of(data, offsets)
                learner.learn(features_of(token, tail, place), kind)
        if learner.tokens:
            # What changed, times the tokens behind it: sums of these give weighted means.
            change = (learner.weights - shared.value[0]) * np.float32(learner.tokens)
            parts = [change[i:i + SLICE_ROWS].tobytes() for i in range(0, len(change), SLICE_ROWS)]
            parts.append(((learner.level - shared.value[1]) * np.float32(learner.tokens)).tobytes())
            team = TaskContext.get().partitionId() // TEAM
            yield common.batch_of(schema, [
                list(range(len(parts))), [team] * len(parts), [learner.tokens] * len(parts), parts,
            ])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(w.as_buffer(), np.float32).astype(np.float64) for w in table["weights"])
        n = sum(table["n"].to_pylist())
        return pa.Table.from_batches([common.batch_of(schema, [
            [table["part"][0].as_py()], [0], [n], [total.astype(np.float32).tobytes()],
        ])])

    for number in range(rounds):
        shared = spark.sparkContext.broadcast((weights, level))
        turn = F.pmod(F.xxhash64("doc_id", F.lit("turn")), F.lit(rounds)) == number
        changes = rows.filter(F.col("train") & turn).mapInArrow(lambda stream, s=shared: task(stream, s), types)
        added = changes.groupBy("part", "team").applyInArrow(add, types).groupBy("part").applyInArrow(add, types)
        weights, level = weights.copy(), level.copy()
        for part in added.collect():  # as many bytes as the weights have
            change = np.frombuffer(part["weights"], np.float32) / np.float32(part["n"])
            if part["part"] * SLICE_ROWS < len(weights):
                at = part["part"] * SLICE_ROWS
                weights[at:at + SLICE_ROWS] += change.reshape(-1, CLASSES)
            else:
                level += change
    return weights, level


def language_model_scores(docs: DataFrame, held_out: Column, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs``."""
    spark = docs.sparkSession
    rows = _rows(docs, held_out)
    bits = _bucket_bits(docs)
    n, distinct, common_tokens, common_counts = counts(rows, bits)
    start = np.log((n + SMOOTHING) / (n.sum() + SMOOTHING * CLASSES)).astype(np.float32)
    weights, level = trained(rows, start, rounds)
    class_terms = np.log10(n + SMOOTHING * (distinct + 1))
    shared = spark.sparkContext.broadcast((weights, level, class_terms, common_tokens, common_counts))
    schema = pa.schema([
        ("row_key", pa.int64()), ("doc_id", pa.int64()), ("train", pa.bool_()), ("n_tokens", pa.int64()),
        ("n_known", pa.int64()), ("words", pa.float64()), ("classes", pa.float64()),
        ("bucket", pa.int32()), ("tokens", pa.binary()), ("rows", pa.binary()),
    ])

    def score(stream):
        weights, level, class_terms, known, known_counts = shared.value
        known_terms = np.log10(known_counts + SMOOTHING)
        task = TaskContext.get().partitionId() << 32
        done = 0
        for batch in stream:
            ids, train = batch.column(0), _flags(batch.column(2))
            rare, rare_rows, sums = [], [], []
            for first, last, data, offsets in common.pieces(common.filled(batch.column(1))):
                token, kind, tail, row, place = tokens_of(data, offsets)
                at = np.searchsorted(known, token)
                at[at == len(known)] = 0
                is_common = known[at] == token if len(known) else np.zeros(len(token), bool)
                size = last - first
                features = features_of(token, tail, place)
                chosen = np.empty(len(token))
                for i in range(0, len(token), SCORED):
                    part = slice(i, i + SCORED)
                    found = log_softmax(weights, level, features[part])
                    chosen[part] = found[np.arange(len(found)), kind[part]]
                terms = chosen / np.log(10) - class_terms[kind]
                sums.append((
                    np.bincount(row, minlength=size), np.bincount(row[is_common], minlength=size),
                    np.bincount(row[is_common], known_terms[at[is_common]], minlength=size) if len(known) else np.zeros(size),
                    np.bincount(row, terms, minlength=size),
                ))
                rare.append(token[~is_common])
                flagged = (done + first + row[~is_common]).astype(np.uint64) << np.uint64(1)
                rare_rows.append(flagged | train[first:last][row[~is_common]].astype(np.uint64))
            total = len(ids)
            columns = [np.concatenate(c) if c else np.zeros(0) for c in zip(*sums)] or [np.zeros(0)] * 4
            keys = task + done + np.arange(total)
            none = [None] * total
            yield common.batch_of(schema, [
                keys, ids, train, columns[0].astype(np.int64), columns[1].astype(np.int64), columns[2], columns[3],
                none, none, none,
            ])
            if rare and sum(map(len, rare)):
                packed = _packed(schema, np.concatenate(rare), [np.concatenate(rare), np.concatenate(rare_rows).astype("<u8")], bits)
                none = [None] * len(packed[0])
                yield common.batch_of(schema, [[task] * len(none), *[none] * 6, *packed])
            done += total

    types = ("row_key bigint, doc_id bigint, train boolean, n_tokens bigint, n_known bigint, words double, "
             "classes double, bucket int, tokens binary, rows binary")
    made = freeze(rows.mapInArrow(score, types))
    partial = pa.schema([("row_key", pa.int64()), ("more_known", pa.int64()), ("more_words", pa.float64())])

    def rare_terms(table: pa.Table) -> pa.Table:
        tokens = [np.frombuffer(t.as_buffer(), "<u8") for t in table["tokens"]]
        row = np.concatenate([
            np.frombuffer(r.as_buffer(), "<u8") for r in table["rows"]
        ])
        task = np.repeat(np.array(table["row_key"].to_pylist(), np.int64), [len(t) for t in tokens])
        tokens = np.concatenate(tokens)
        order = np.argsort(tokens, kind="stable")
        tokens, row, task = tokens[order], row[order], task[order]
        head = np.concatenate([[True], tokens[1:] != tokens[:-1]])
        count = np.add.reduceat((row & np.uint64(1)).astype(np.int64), np.flatnonzero(head))
        count = count[np.cumsum(head) - 1]
        keys, back = np.unique(task + (row >> np.uint64(1)).astype(np.int64), return_inverse=True)
        return pa.Table.from_batches([common.batch_of(partial, [
            keys, np.bincount(back, count > 0).astype(np.int64), np.bincount(back, np.log10(count + SMOOTHING)),
        ])])

    more = (
        made.filter(F.col("bucket").isNotNull()).select("row_key", "bucket", "tokens", "rows")
        .groupBy("bucket").applyInArrow(rare_terms, "row_key bigint, more_known bigint, more_words double")
        .groupBy(F.col("row_key").alias("of")).agg(F.sum("more_known").alias("more_known"), F.sum("more_words").alias("more_words"))
    )
    base_level = float(np.log10(n.sum() + SMOOTHING * (distinct.sum() + 1)))
    texts = made.filter(F.col("bucket").isNull()).join(more, F.col("row_key") == F.col("of"), "left")
    words = F.col("words") + F.coalesce("more_words", F.lit(0.0))
    return texts.select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(int(n.sum())).cast("bigint").alias("train_tokens"),
        (words - F.col("n_tokens") * base_level).alias("base_score"), (words + F.col("classes")).alias("score"),
    )
