"""Toxicity scores: a bidirectional gated recurrent network with attention pooling, in numpy.

A word's input is the embedding of the hashed word plus the mean embedding of its hashed character trigrams.
Texts are cut into windows of ``WINDOW`` words, each ``STRIDE`` words after the last; every
window of every whole text is scored. Per window, two gated recurrent layers read in
both directions, attention pools their states, and a linear layer gives a logit. A document has the
logit of its worst window.

Training (one task, bounded data): at most ``TRAIN_DOCS`` labelled documents of each class, of ``TEXT_BYTES``
bytes at most each and ``TRAIN_BYTES`` together, taken in the order of a hash of their ids. A document's loss is on the soft
maximum of all its windows, as labels name documents and not passages; gradients are added up over parts of
``AT_ONCE`` windows. One in ``CUT_PART`` usable labelled documents is not learned from: the decision point is fitted on the scores of
all of those, of any length, by their histogram (on all usable ones where they are too few), and mapped to a score
of ``DECISION``. It takes ``MAX_FALSE`` of the clean ones for toxic at most; texts of more than ``LONG_TEXT`` windows have a point of their own.

Defined results: a null or empty text is one window without words; documents without label are scored
like all others; conflicting labels of a document count as toxic; repeated rows get equal rows; if
the training labels hold only one class, all scores are 0; an empty table gives an empty table. Only
``doc_id`` and ``text`` are read for scores.
"""

import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalogspark.llm import common
from catalogspark.session import freeze

WINDOW, STRIDE = 32, 16
TRAIN_DOCS, TEXT_BYTES, TRAIN_BYTES = 1500, 1 << 20, 64 << 20
# Windows whose states are held at once in training.
AT_ONCE = 4096
# Every fourth labelled document serves the decision point, if there are at least so many of each class.
CUT_PART, LEAST_CUT = 4, 20
# Share of clean documents that may be taken for toxic ones when the decision point is fitted.
MAX_FALSE = 0.01
# Texts of more windows have a decision point of their own: the worst of many windows is worse by chance.
LONG_TEXT = 48
# Histogram of logits: bins to a unit, and the largest logit that has a bin of its own.
BINS, LARGEST = 64, 32
STEPS, BATCH, RATE = 240, 16, 0.02
WORD_ROWS, GRAM_ROWS, WIDTH, HIDDEN = 1 << 13, 1 << 12, 8, 8
DECISION = 0.7


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


# --- inputs ------------------------------------------------------------------------


class Words:
    """Distinct lower-cased words of a piece, with rows of the two embedding tables."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        data = common.lowered(data)
        starts, ends, self.bounds = common.word_spans(data, offsets)
        hashes = common.span_hashes(data, starts, ends)
        distinct, first, self.number = np.unique(hashes, return_index=True, return_inverse=True)
        self.word_rows = (distinct % np.uint64(WORD_ROWS)).astype(np.int64)
        starts, lengths = starts[first], (ends - starts)[first]
        # Trigrams of a word with a mark on both sides: one per byte.
        self.gram_counts = np.maximum(lengths, 1)
        self.gram_word = np.repeat(np.arange(len(first)), lengths)
        self.gram_starts = np.cumsum(lengths) - lengths
        at = np.arange(lengths.sum()) - np.repeat(self.gram_starts - starts, lengths)
        padded = np.concatenate([[0], data, [0]]).astype(np.uint64)
        inside = np.arange(lengths.sum()) - np.repeat(self.gram_starts, lengths)
        left = np.where(inside == 0, 0, padded[at])
        right = np.where(inside == np.repeat(lengths, lengths) - 1, 0, padded[at + 2])
        code = (left << np.uint64(16)) | (padded[at + 1] << np.uint64(8)) | right
        self.gram_rows = (common.mixed(code.astype(np.uint64)) % np.uint64(GRAM_ROWS)).astype(np.int64)

    def vectors(self, model: dict) -> np.ndarray:
        if not len(self.word_rows):
            return np.zeros((1, WIDTH), np.float32)
        grams = np.add.reduceat(model["gram"][self.gram_rows], self.gram_starts, axis=0)
        return model["word"][self.word_rows] + grams / self.gram_counts[:, None].astype(np.float32)


def window_table(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of consecutive texts: text number, first word, number of words."""
    lengths = np.diff(bounds)
    counts = np.maximum(1, -(-np.maximum(lengths - WINDOW, 0) // STRIDE) + 1)
    text = np.repeat(np.arange(len(lengths)), counts)
    step = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    first = bounds[:-1][text] + step * STRIDE
    return text, first, np.clip(bounds[1:][text] - first, 0, WINDOW)


def window_words(numbers: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers and mask (window, place) of windows."""
    place = np.arange(WINDOW)
    mask = place[None] < size[:, None]
    at = np.where(mask, first[:, None] + place[None], 0)
    words = numbers[at] if len(numbers) else np.zeros(at.shape, np.int64)
    return np.where(mask, words, 0), mask.astype(np.float32)


# --- network -----------------------------------------------------------------------


def new_model(rng) -> dict:
    def draw(*shape, scale=0.3):
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    return {
        "word": draw(WORD_ROWS, WIDTH, scale=0.1), "gram": draw(GRAM_ROWS, WIDTH, scale=0.1),
        "inward": draw(2, WIDTH, 3 * HIDDEN), "bias": np.zeros((2, 1, 3 * HIDDEN), np.float32),
        "inner": draw(2, HIDDEN, 3 * HIDDEN), "heed": draw(2, HIDDEN), "out": draw(2, HIDDEN),
        "level": np.zeros(1, np.float32),
    }


def forward(model: dict, vectors: np.ndarray, words: np.ndarray, mask: np.ndarray, keep: bool = False):
    """Window logits (and what the backward pass needs)."""
    n, steps, h = len(words), words.shape[1], HIDDEN
    gates = vectors[None] @ model["inward"] + model["bias"]
    state = np.zeros((2, n, h), np.float32)
    states = np.zeros((2, steps, n, h), np.float32)
    tape = []
    for step in range(steps):
        back = steps - 1 - step
        given = np.stack([gates[0][words[:, step]], gates[1][words[:, back]]])
        here = np.stack([mask[:, step], mask[:, back]])[:, :, None]
        inner = state @ model["inner"]
        open_ = sigmoid(given[..., :2 * h] + inner[..., :2 * h])
        reset, update = open_[..., :h], open_[..., h:]
        new = np.tanh(given[..., 2 * h:] + reset * inner[..., 2 * h:])
        moved = new + update * (state - new)
        if keep:
            tape.append((state, inner[..., 2 * h:], reset, update, new, here))
        state = state + here * (moved - state)
        states[0, step], states[1, back] = state[0], state[1]
    heed = (states[0] @ model["heed"][0] + states[1] @ model["heed"][1]) - 1e9 * (1 - mask.T)
    heed = np.exp(heed - heed.max(axis=0))
    heed /= heed.sum(axis=0)
    pooled = (heed[None, :, :, None] * states).sum(axis=1)
    logits = (pooled * model["out"][:, None]).sum(axis=(0, 2)) + model["level"][0]
    return (logits, (gates, states, heed, pooled, tape)) if keep else logits


def backward(model: dict, vectors, words, mask, held, d_logits: np.ndarray) -> dict:
    """Gradients of all parameters but the embeddings, and of the word vectors (under "vectors")."""
    gates, states, heed, pooled, tape = held
    steps, h = words.shape[1], HIDDEN
    grad = {"out": (d_logits[None, :, None] * pooled).sum(axis=1), "level": d_logits.sum(keepdims=True)}
    d_pooled = d_logits[None, :, None] * model["out"][:, None]
    d_heed = (d_pooled[:, None] * states).sum(axis=(0, 3))
    d_heed = heed * (d_heed - (heed * d_heed).sum(axis=0))
    d_states = heed[None, :, :, None] * d_pooled[:, None] + d_heed[None, :, :, None] * model["heed"][:, None, None]
    grad["heed"] = (d_heed[None, :, :, None] * states).sum(axis=(1, 2))
    d_state = np.zeros_like(pooled)
    d_inner_weights = np.zeros_like(model["inner"])
    d_gates = np.zeros_like(gates)
    for step in reversed(range(steps)):
        back = steps - 1 - step
        before, inner_new, reset, update, new, here = tape[step]
        d_state = d_state + np.stack([d_states[0, step], d_states[1, back]])
        d_moved = here * d_state
        d_new = d_moved * (1 - update) * (1 - new * new)
        d_update = d_moved * (before - new) * update * (1 - update)
        d_reset = d_new * inner_new * reset * (1 - reset)
        d_given = np.concatenate([d_reset, d_update, d_new], axis=2)
        d_inner = np.concatenate([d_reset, d_update, d_new * reset], axis=2)
        d_inner_weights += before.transpose(0, 2, 1) @ d_inner
        d_state = (1 - here) * d_state + d_moved * update + d_inner @ model["inner"].transpose(0, 2, 1)
        np.add.at(d_gates[0], words[:, step], d_given[0])
        np.add.at(d_gates[1], words[:, back], d_given[1])
    grad["inner"] = d_inner_weights
    grad["bias"] = d_gates.sum(axis=1, keepdims=True)
    grad["inward"] = vectors.T[None] @ d_gates
    grad["vectors"] = (d_gates @ model["inward"].transpose(0, 2, 1)).sum(axis=0)
    return grad


class Adam:
    def __init__(self, model: dict, rate: float):
        self.model, self.rate, self.step = model, rate, 0
        self.mean = {k: np.zeros_like(v) for k, v in model.items()}
        self.square = {k: np.zeros_like(v) for k, v in model.items()}

    def update(self, grad: dict) -> None:
        self.step += 1
        for name, g in grad.items():
            m, s = self.mean[name], self.square[name]
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            scale = self.rate / (1 - 0.9 ** self.step)
            self.model[name] -= scale * m / (np.sqrt(s / (1 - 0.99 ** self.step)) + 1e-6)


def document_logits(model: dict, texts: pa.LargeStringArray, at_once: int = 16_384):
    """For every piece of a filled Arrow column: the logit of the worst window of each text, and which texts are long."""
    for _, _, data, offsets in common.pieces(texts):
        words = Words(data, offsets)
        vectors = words.vectors(model)
        text, first, size = window_table(words.bounds)
        logits = np.concatenate([
            forward(model, vectors, *window_words(words.number, first[i:i + at_once], size[i:i + at_once]))
            for i in range(0, len(text), at_once)
        ])
        starts = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
        yield np.maximum.reduceat(logits, starts), np.diff(np.append(starts, len(text))) > LONG_TEXT


def logits_of(model: dict, texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """Logits of all texts, and which of them are long."""
    found = list(document_logits(model, texts))
    logits, long = zip(*found) if found else ([np.zeros(0)], [np.zeros(0, bool)])
    return np.concatenate(logits), np.concatenate(long)


def train(texts: list, toxic: np.ndarray, steps: int = STEPS, seed: int = 4) -> dict | None:
    """Model from whole texts and labels; None without both classes."""
    toxic = np.asarray(toxic, bool)
    if toxic.all() or not toxic.any():
        return None
    rng = np.random.default_rng(seed)
    model = new_model(rng)
    adam = Adam(model, RATE)
    sides = [np.flatnonzero(toxic), np.flatnonzero(~toxic)]
    for step in range(steps):
        adam.rate = RATE * (1 - 0.9 * step / steps)
        chosen = np.concatenate([rng.choice(s, BATCH) for s in sides])
        column = pa.array([texts[i] for i in chosen], pa.large_string())
        data, offsets = common.buffers(column)
        words = Words(data[:offsets[-1]], offsets)
        vectors = words.vectors(model)
        text, first, size = window_table(words.bounds)
        parts = [slice(i, i + AT_ONCE) for i in range(0, len(text), AT_ONCE)]
        shown = [window_words(words.number, first[part], size[part]) for part in parts]
        passes = [forward(model, vectors, *given, keep=len(parts) == 1) for given in shown]
        logits = passes[0][0] if len(parts) == 1 else np.concatenate(passes)
        starts = np.searchsorted(text, np.arange(len(chosen)))
        top = np.maximum.reduceat(logits, starts)
        mass = np.exp(logits - top[text])
        total = np.add.reduceat(mass, starts)
        soft = top + np.log(total)
        d_soft = (sigmoid(soft) - toxic[chosen]) / len(chosen)
        d_logits = (d_soft[text] * mass / total[text]).astype(np.float32)
        grad = None
        for part, given, made in zip(parts, shown, passes):
            held = made[1] if len(parts) == 1 else forward(model, vectors, *given, keep=True)[1]
            more = backward(model, vectors, *given, held, d_logits[part])
            grad = more if grad is None else {name: grad[name] + more[name] for name in more}
        d_vectors = grad.pop("vectors")
        grad["word"], grad["gram"] = np.zeros_like(model["word"]), np.zeros_like(model["gram"])
        np.add.at(grad["word"], words.word_rows, d_vectors)
        share = d_vectors / words.gram_counts[:, None]
        np.add.at(grad["gram"], words.gram_rows, share[words.gram_word].astype(np.float32))
        adam.update(grad)
    return model


def best_cut(clean: np.ndarray, bad: np.ndarray) -> float:
    """The logit that finds most of the second histogram and MAX_FALSE of the first at most, in the middle of its gap."""
    # Shares above the cut, with the cut below bin i.
    false, found = (1 - np.concatenate([[0], np.cumsum(side)]) / max(side.sum(), 1) for side in (clean, bad))
    right = np.where(false <= MAX_FALSE + 1e-12, found - false, -1.0)
    best = np.flatnonzero(right >= right.max() - 1e-12)
    # Edges of equal worth on end are one gap.
    gap = np.split(best, np.flatnonzero(np.diff(best) > 1) + 1)[0]
    return float((gap[0] + gap[-1]) / 2 / BINS - LARGEST)


# --- Spark -------------------------------------------------------------------------


def marked_docs(labels: DataFrame, usable: Column) -> DataFrame:
    """mark_doc, toxic, for_cut of the usable labelled documents; the last are not learned from."""
    return (
        labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & usable)
        .groupBy(F.col("doc_id").cast("bigint").alias("mark_doc")).agg((F.max("toxic") > 0).alias("toxic"))
        .withColumn("for_cut", F.pmod(F.xxhash64("mark_doc", F.lit("cut")), F.lit(CUT_PART)) == 0)
    )


def _labelled(docs: DataFrame, marks: DataFrame) -> DataFrame:
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(common.small_side(marks), F.col("doc_id") == F.col("mark_doc")).drop("mark_doc")


def labelled_sample(docs: DataFrame, marks: DataFrame, each: int = TRAIN_DOCS) -> DataFrame:
    """text, toxic of the labelled documents to learn from: a bounded number of bounded texts of each class."""
    usable = _labelled(docs, marks).filter(F.octet_length("text") <= TEXT_BYTES)
    order = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"))
    # The constant bound drops rows before the shuffle, so a window task sees few rows of each class.
    first = usable.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= each)
    upto = F.sum(F.octet_length("text")).over(Window.partitionBy("toxic").orderBy("place"))
    return first.withColumn("upto", upto).filter(F.col("upto") <= TRAIN_BYTES).select("text", "toxic")


def with_cut(model: dict | None, docs: DataFrame, marks: DataFrame) -> dict | None:
    """The model with the decision point that fits all ``marks`` best."""
    if model is None:
        return None
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("toxic", pa.bool_()), ("long", pa.bool_()), ("bin", pa.int32())])

    def bins(stream):
        for batch in stream:
            logits, long = logits_of(shared.value, common.filled(batch.column(0)))
            at = np.clip((logits + LARGEST) * BINS, 0, 2 * LARGEST * BINS - 1).astype(np.int32)
            yield common.batch_of(schema, [batch.column(1), long, at])

    binned = _labelled(docs, marks).select("text", "toxic").mapInArrow(common.tidy(bins), "toxic boolean, long boolean, bin int")
    # At most 2 * LARGEST * BINS rows of each class and length.
    sides = np.zeros((2, 2, 2 * LARGEST * BINS))
    for toxic, long, at, n in binned.groupBy("toxic", "long", "bin").count().collect():
        sides[int(long), int(toxic), at] = n
    whole = best_cut(*sides.sum(axis=0))
    # A length with few clean documents takes the common point; long texts never take a lower one.
    cuts = [best_cut(*side) if side[0].sum() >= LEAST_CUT and side[1].sum() else whole for side in sides]
    return {**model, "cut": np.array([cuts[0], max(cuts)], np.float32)}


def fit(sample: DataFrame, steps: int = STEPS) -> dict | None:
    """Train in one task on a bounded sample; only the model comes back."""

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("text", ignore_index=True)
        return pd.DataFrame({"model": [pickle.dumps(train(rows["text"].tolist(), rows["toxic"].to_numpy(), steps))]})

    made = sample.groupBy().applyInPandas(learn, "model binary").collect()
    return pickle.loads(made[0]["model"]) if made else None


def scored(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, score of every row of ``docs`` over its whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
    shift = float(np.log(DECISION / (1 - DECISION)))

    def score(stream):
        model = shared.value
        for batch in stream:
            texts = common.filled(batch.column(1))
            if model is None:
                scores = np.zeros(len(texts))
            else:
                logits, long = logits_of(model, texts)
                scores = sigmoid(logits.astype(np.float64) - model["cut"].astype(np.float64)[long.astype(int)] + shift)
            yield common.batch_of(schema, [batch.column(0), scores])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(common.tidy(score), "doc_id bigint, score double")


def toxicity(docs: DataFrame, labels: DataFrame, usable: Column) -> DataFrame:
    """doc_id, score, predicted; labels are learned from label rows where ``usable`` holds."""
    marks = freeze(marked_docs(labels, usable))
    counts = {(r["toxic"], r["for_cut"]): r["count"] for r in marks.groupBy("toxic", "for_cut").count().collect()}
    apart = all(counts.get((toxic, True), 0) >= LEAST_CUT for toxic in (True, False))
    learned, judged = (marks.filter(~F.col("for_cut")), marks.filter("for_cut")) if apart else (marks, marks)
    model = fit(labelled_sample(docs, learned.drop("for_cut")))
    model = with_cut(model, docs, judged.drop("for_cut"))
    return scored(docs, model).withColumn("predicted", (F.col("score") >= DECISION).cast("int"))
