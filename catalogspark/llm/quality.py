"""Quality rules: hashed n-gram log-likelihood ratios between trusted and raw text.

Words and word pairs are hashed into a fixed number of buckets. Two multinomials are counted over
whole texts: one over the trusted documents, one over all documents. A document's score is the mean
log ratio of its n-grams (so it does not depend on length), and every document whose score is at
least one threshold is kept. The threshold is fitted on the scores of the labelled documents, held
as a histogram of fixed size.

Defined results: a null text has no words; without words the score is 0 and the document fails the
base rule; without labelled documents the threshold is ``-SPAN`` and only the base rule decides;
repeated rows count one by one; conflicting labels of a document count as the lower quality;
documents without ``doc_id`` count as raw text only. Other columns pass through.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalogspark.llm import common
from catalogspark.session import freeze

BUCKETS = 1 << 16
# Scores lie within +-SPAN; the histogram that fits the threshold has 2 * SPAN * BINS bins.
SPAN = 8
BINS = 512
# Share of trusted documents that the threshold may cost at most.
MAX_LOST = 0.002
SMOOTHING = 1.0

MIN_WORDS = 20
WINDOW = 8
MAX_REPEAT_PERCENT = 30
_SYMBOLS = b"#*$%&|<>"

_BASE = [("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"),
         ("n_repeat_words", "long")]


def _grams(data, offsets):
    """Bucket numbers of all words and word pairs of a piece, with the row of each."""
    starts, ends, bounds = common.word_spans(data, offsets)
    words = common.span_hashes(data, starts, ends)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    pairs = common.chained(words, 2)
    inside = row[1:] == row[:-1]
    hashes = np.concatenate([words, pairs[inside]])
    rows = np.concatenate([row, row[1:][inside]])
    return (hashes >> np.uint64(48)).astype(np.int64) % BUCKETS, rows


def gram_counts(docs: DataFrame, trusted: str) -> DataFrame:
    """bucket, n_target, n_raw over whole texts; counted per task before the shuffle."""
    schema = pa.schema([("bucket", pa.int32()), ("n_target", pa.int64()), ("n_raw", pa.int64())])

    def count(stream):
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in stream:
            text = common.filled(batch.column(0))
            marked = np.asarray(batch.column(1).fill_null(False).to_numpy(zero_copy_only=False), bool)
            for first, last, data, offsets in common.pieces(text):
                buckets, rows = _grams(data, offsets)
                raw += np.bincount(buckets, minlength=BUCKETS)
                target += np.bincount(buckets[marked[first:last][rows]], minlength=BUCKETS)
        used = np.flatnonzero(raw)
        yield common.batch_of(schema, [used, target[used], raw[used]])

    rows = docs.select("text", F.col(trusted).cast("boolean").alias("trusted")).mapInArrow(
        count, "bucket int, n_target bigint, n_raw bigint"
    )
    return rows.groupBy("bucket").agg(F.sum("n_target").alias("n_target"), F.sum("n_raw").alias("n_raw"))


def log_ratios(counts: DataFrame) -> np.ndarray:
    """Log ratio per bucket of the two smoothed multinomials (BUCKETS numbers reach the driver)."""
    target, raw = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for bucket, n_target, n_raw in counts.collect():
        target[bucket], raw[bucket] = n_target, n_raw
    if not target.any():
        return np.zeros(BUCKETS, np.float64)
    # The raw multinomial, scaled to the target's mass, is the prior of the target.
    scale = target.sum() / raw.sum()
    prior = SMOOTHING * raw.sum() / BUCKETS
    return np.log((target + prior * scale) / scale) - np.log(raw + prior)


def _repeat_words(words, bounds):
    """Per row: words that lie in a run of WINDOW words found twice or more in the row."""
    n = len(words)
    covered = np.zeros(n, np.int64)
    if n >= WINDOW:
        row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        at = np.flatnonzero(row[:n - WINDOW + 1] == row[WINDOW - 1:])
        runs = common.chained(words, WINDOW)[at] ^ common.mixed(row[at].astype(np.uint64) + np.uint64(1))
        order = np.argsort(runs)
        same = runs[order][1:] == runs[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        change = np.zeros(n + 1, np.int64)
        np.add.at(change, at[twice], 1)
        np.add.at(change, at[twice] + WINDOW, -1)
        covered = (np.cumsum(change[:n]) > 0).astype(np.int64)
    return common.row_sums(covered, bounds)


def _dup_lines(text: bytes) -> int:
    lines = [line for line in text.split(b"\n") if line.split(None, 1)]
    return len(lines) - len(set(lines))


def _measures(data, offsets):
    """The base measures of the rows of a piece, in the order of _BASE."""
    starts, ends, bounds = common.word_spans(data, offsets)
    words = common.span_hashes(data, starts, ends)
    symbol = np.zeros(256, bool)
    symbol[list(_SYMBOLS)] = True
    letters = ~common.gaps(data) & ((data & 0xC0) != 0x80)
    whole = data.tobytes()
    return [
        np.diff(bounds), common.row_sums(letters, offsets), common.row_sums(symbol[data], offsets),
        [_dup_lines(whole[a:b]) for a, b in zip(offsets[:-1], offsets[1:])], _repeat_words(words, bounds),
    ]


def scored(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """``docs`` with the base measures and the mean log ratio ``llr``."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(ratios)
    at = docs.columns.index("text")
    fields = [*_BASE, ("llr", "double")]
    schema = T.StructType([
        *docs.schema.fields, *[T.StructField(common.unused(docs, n), T._parse_datatype_string(t)) for n, t in fields]
    ])
    names = schema.names

    def score(stream):
        ratio = shared.value
        for batch in stream:
            text = common.filled(batch.column(at))
            columns = [[] for _ in fields]
            for _, _, data, offsets in common.pieces(text):
                buckets, rows = _grams(data, offsets)
                n = len(offsets) - 1
                grams = np.bincount(rows, minlength=n)
                sums = np.bincount(rows, ratio[buckets], minlength=n)
                for column, part in zip(columns, [*_measures(data, offsets), sums / np.maximum(grams, 1)]):
                    column.append(np.asarray(part))
            made = [
                pa.array(np.concatenate(c) if c else [], pa.float64() if t == "double" else pa.int64())
                for c, (_, t) in zip(columns, fields)
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=names)

    return docs.mapInArrow(common.tidy(score), schema)


def fitted_threshold(scores: DataFrame, score: str, good: str) -> float:
    """The bin edge that parts labelled documents best, losing MAX_LOST of the trusted ones at most.

    ``good`` is 1, 0 or null. At most 2 * SPAN * BINS rows a label reach the driver.
    """
    edge = F.greatest(F.lit(0), F.least(F.floor((F.col(score) + SPAN) * BINS), F.lit(2 * SPAN * BINS - 1)))
    held = scores.filter(F.col(good).isNotNull()).groupBy(F.col(good).alias("good"), edge.alias("bin")).count()
    table = np.zeros((2, 2 * SPAN * BINS + 1))
    for label, at, n in held.collect():
        table[int(label), int(at)] = n
    below = np.concatenate([np.zeros((2, 1)), np.cumsum(table, axis=1)[:, :-1]], axis=1)
    bad_total, good_total = table[0].sum(), table[1].sum()
    if not bad_total or not good_total:
        return float(-SPAN)
    lost = below[1] / good_total
    gain = np.where(lost <= MAX_LOST, below[0] / bad_total - lost, -1.0)
    return float(np.argmax(gain) / BINS - SPAN)


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with base measures, ``llr``, ``threshold``, ``base_failed`` and ``kept``.

    New columns whose name ``docs`` already has get a longer name; the last eight are the new ones.
    """
    key, good = common.unused(docs, "label_doc"), common.unused(docs, "good")
    marks = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy(F.col("doc_id").cast("bigint").alias(key)).agg((F.min("quality") > 0).cast("int").alias(good))
    )
    # Stored, as both passes and the size check read it.
    marks = common.small_side(freeze(marks))
    docs = common.small_batches(docs)
    marked = docs.join(marks, F.col("doc_id").cast("bigint") == F.col(key), "left").drop(key)
    ratios = log_ratios(gram_counts(marked.withColumn(common.unused(marked, "trusted"), F.col(good) == 1),
                                    common.unused(marked, "trusted")))
    scores = scored(marked, ratios)
    made = dict(zip([n for n, _ in [*_BASE, ("llr", "")]], scores.columns[len(marked.columns):]))
    failed = (F.col(made["n_words"]) < MIN_WORDS) | (
        100 * F.col(made["n_repeat_words"]) > MAX_REPEAT_PERCENT * F.col(made["n_words"])
    )
    # Only documents that the base rule lets through need the method's verdict.
    threshold = fitted_threshold(
        scores.filter(~failed).select(good, made["llr"]), made["llr"], good
    )
    base_failed = common.unused(scores, "base_failed")
    return (
        scores.drop(good).withColumn(common.unused(scores, "threshold"), F.lit(threshold))
        .withColumn(base_failed, failed)
        .withColumn(common.unused(scores, "kept"), ~failed & (F.col(made["llr"]) >= threshold))
    )
