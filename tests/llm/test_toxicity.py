import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from catalogspark.llm import queries, toxicity
from tests.llm.conftest import words


def insulted(n, seed):
    rng = random.Random(seed)
    texts, toxic = [], []
    for i in range(n):
        split = words(seed * 1000 + i, rng.randrange(20, 120), 3000).split()
        bad = i % 2 == 0
        for _ in range(3 if bad else 0):
            split.insert(rng.randrange(len(split)), rng.choice(["Awful", "rotten", "VILE"]))
        texts.append(" ".join(split))
        toxic.append(bad)
    return texts, np.array(toxic)


@pytest.fixture(scope="module")
def model():
    """A trained network; the cut is fitted on other documents."""
    made = toxicity.train(*insulted(200, 1), steps=120)
    texts, toxic = insulted(100, 9)
    at = np.clip((logits(made, texts) + toxicity.LARGEST) * toxicity.BINS, 0, 2 * toxicity.LARGEST * toxicity.BINS - 1).astype(int)
    sides = [np.bincount(at[toxic == side], minlength=2 * toxicity.LARGEST * toxicity.BINS) for side in (False, True)]
    return {**made, "cut": np.full(2, toxicity.best_cut(*sides), np.float32)}


def logits(model, texts):
    return toxicity.logits_of(model, pa.array(texts, pa.large_string()))[0]


def test_held_out_accuracy(model):
    texts, toxic = insulted(200, 2)
    assert ((logits(model, texts) >= model["cut"][0]) == toxic).mean() >= 0.95


def test_windows_overlap_and_cover_whole_texts():
    bounds = np.array([0, 0, 5, 37, 37 + 200])
    text, first, size = toxicity.window_table(bounds)
    assert text.tolist()[:4] == [0, 1, 2, 3] and size.tolist()[:3] == [0, 5, 32]
    own = first[text == 3] - 37
    assert own.tolist() == list(range(0, 177, 16)) and (first + size)[-1] == 237


def test_document_logit_is_that_of_its_worst_window(model):
    text = words(5, 500, 3000).split()
    text[480] = "rotten"
    starts = range(0, 500 - 32 + 16, 16)
    parts = [" ".join(text[s:s + 32]) for s in starts]
    assert np.isclose(logits(model, [" ".join(text)])[0], logits(model, parts).max(), atol=1e-4)


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    model = {k: v.astype(np.float64) for k, v in toxicity.new_model(rng).items()}
    vectors = rng.standard_normal((9, toxicity.WIDTH))
    words_ = rng.integers(0, 9, (3, 5))
    mask = np.array([[1, 1, 1, 1, 1], [1, 1, 0, 0, 0], [0, 0, 0, 0, 0]], float)
    weight = rng.standard_normal(3)

    def loss():
        return float(weight @ toxicity.forward(model, vectors, words_, mask))

    _, held = toxicity.forward(model, vectors, words_, mask, keep=True)
    grad = toxicity.backward(model, vectors, words_, mask, held, weight)
    for name, value in [*[(k, model[k]) for k in ("inward", "bias", "inner", "heed", "out", "level")], ("vectors", vectors)]:
        for at in [tuple(rng.integers(0, s) for s in value.shape) for _ in range(4)]:
            old, step = value[at], 1e-4
            value[at] = old + step
            up = loss()
            value[at] = old - step
            down = loss()
            value[at] = old
            assert np.isclose((up - down) / (2 * step), grad[name][at], atol=2e-3), name


def test_best_cut_is_in_the_middle_of_the_gap():
    sides = np.zeros((2, 2 * toxicity.LARGEST * toxicity.BINS))
    zero = toxicity.LARGEST * toxicity.BINS
    sides[0, zero - 64], sides[0, zero - 32], sides[1, zero + 31], sides[1, zero + 64] = 5, 1, 1, 3
    assert abs(toxicity.best_cut(*sides)) < 0.02
    assert toxicity.best_cut(np.zeros_like(sides[0]), sides[1]) <= 0


def test_training_in_parts_gives_the_same_network(monkeypatch):
    texts, toxic = insulted(40, 3)
    texts[0] = words(77, 2000, 3000) + " rotten " + texts[0]
    whole = toxicity.train(texts, toxic, steps=3)
    monkeypatch.setattr(toxicity, "AT_ONCE", 16)
    parts = toxicity.train(texts, toxic, steps=3)
    assert all(np.allclose(whole[k], parts[k], atol=1e-3) for k in whole)


def test_the_sample_is_bounded_and_the_cut_sees_long_texts(spark, monkeypatch):
    rows = [(i, "word " * (10 if i % 10 else 400)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(200)], "doc_id bigint, quality int, toxic int")
    marks = toxicity.marked_docs(labels, F.lit(True))
    assert 20 <= marks.filter("for_cut").count() <= 80
    monkeypatch.setattr(toxicity, "TEXT_BYTES", 1000)
    sample = toxicity.labelled_sample(docs, marks, each=30).collect()
    assert len(sample) == 60 and sum(r.toxic for r in sample) == 30 and all(len(r.text) <= 1000 for r in sample)
    seen = []
    monkeypatch.setattr(toxicity, "best_cut", lambda clean, bad: seen.append((clean.sum(), bad.sum())) or 0.0)
    toxicity.with_cut(toxicity.new_model(np.random.default_rng(1)), docs, marks)
    # Once for all lengths and once for the short ones; long ones are too few of one class.
    assert seen[0] == (100, 100) and len(seen) == 2


def test_odd_rows(model, odd, clashing, no_docs, no_labels):
    rows = toxicity.scored(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert sorted(map(str, rows)) == sorted(map(str, toxicity.scored(clashing, model).collect()))
    assert toxicity.scored(no_docs, model).count() == 0
    # Without labels there is nothing to learn.
    assert {(r.score, r.predicted) for r in toxicity.toxicity(odd, no_labels, F.lit(True)).collect()} == {(0.0, 0)}


def test_query(spark, corpus):
    folder = corpus.replace("0.001", "0.01")
    rows = {r.doc_id: r for r in queries.op4(spark, folder).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in rows.items())
    assert all(r.predicted == int(r.score >= 0.7) for r in rows.values())
    labels = [r for r in spark.read.parquet(f"{folder}/labels.parquet").collect() if rows[r.doc_id].held_out]
    clean = [rows[r.doc_id].predicted for r in labels if not r.toxic]
    toxic = [rows[r.doc_id].predicted for r in labels if r.toxic]
    assert np.mean(clean) <= 0.05 and np.mean(toxic) >= 0.5


def test_held_out_figures_on_a_larger_table(spark, corpus):
    """Recall of held-out toxic documents, and clean ones left alone, long ones apart."""
    folder = corpus.replace("0.001", "0.1")
    rows = {r.doc_id: r for r in queries.op4(spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("doc_id", "size(split(text, ' ')) AS n")
    labels = spark.read.parquet(f"{folder}/labels.parquet").join(docs, "doc_id").collect()
    held = [r for r in labels if rows[r.doc_id].held_out]
    marked = [rows[r.doc_id].predicted for r in held if r.toxic]
    short, long = ([rows[r.doc_id].predicted for r in held if not r.toxic and (r.n > 784) == far] for far in (False, True))
    print("recall", np.mean(marked), len(marked), "false", np.mean(short), len(short), "false, long", np.mean(long), len(long))
    assert np.mean(marked) >= 0.8 and np.mean(short) <= 0.02 and np.mean(long) <= 0.03
