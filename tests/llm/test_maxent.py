import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from catalogspark.llm import common, maxent, queries
from catalogspark.llm.common import fold_of


def brute(rows, parts=10):
    """(doc_id, n_tokens, n_known, train_tokens, base_score) per row, straight from the contract."""
    tokens = [[*(t or "").encode().lower().split(), None] for _, t in rows]
    held = [zlib.crc32(b"" if d is None else str(d).encode()) % parts == 0 for d, _ in rows]
    counts = Counter(w for t, h in zip(tokens, held) if not h for w in t)
    total, distinct = sum(counts.values()), len(counts)
    level = np.log10(total + 0.1 * (distinct + 1))
    return [
        (d, len(t), sum(counts[w] > 0 for w in t), total, sum(np.log10(counts[w] + 0.1) - level for w in t))
        for (d, _), t in zip(rows, tokens)
    ]


def check(found, rows):
    key = lambda r: (str(r[0]), r[1], r[4])
    got = sorted([(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in found], key=key)
    for a, b in zip(got, sorted(brute(rows), key=key), strict=True):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4], rel=1e-9)


@pytest.mark.parametrize("most", [8, 1 << 16])
def test_odd_rows(odd, clashing, most, monkeypatch):
    monkeypatch.setattr(maxent, "COMMON", most)
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    for df in (odd, clashing):
        found = maxent.language_model_scores(df, fold_of("doc_id", 10) == 0, rounds=1).collect()
        check(found, rows)
        assert all(np.isfinite(r.score) and r.score < 0 for r in found)


def test_empty_table_and_no_training_texts(no_docs, odd):
    assert maxent.language_model_scores(no_docs, F.lit(False), rounds=1).count() == 0
    untaught = maxent.language_model_scores(odd, F.lit(True), rounds=1).collect()
    assert {r.n_known for r in untaught} == {0} and {r.train_tokens for r in untaught} == {0}


def test_class_probabilities_sum_to_one():
    data, offsets = common.buffers(pa.array(["the cat sat", "", "on the mat."], pa.large_string()))
    token, kind, tail, row, place = maxent.tokens_of(data, offsets)
    assert row.tolist() == [0, 0, 0, 0, 1, 2, 2, 2, 2] and place.tolist() == [0, 1, 2, 3, 0, 0, 1, 2, 3]
    assert kind.tolist().count(0) == 3 and kind.max() < maxent.CLASSES
    features = maxent.features_of(token, tail, place)
    rng = np.random.default_rng(1)
    weights = rng.standard_normal((maxent.FEATURES * maxent.ROWS, maxent.CLASSES)).astype(np.float32)
    logs = maxent.log_softmax(weights, np.zeros(maxent.CLASSES, np.float32), features)
    assert np.allclose(np.exp(logs).sum(axis=1), 1, atol=1e-5)
    # Contexts do not reach across texts: the first tokens of both texts with words agree.
    assert features[0].tolist() == features[5].tolist() == features[4].tolist()


def test_training_learns_what_follows(spark):
    """Words ending in x are followed by words ending in y: the model must find that, the base can't."""
    rng = np.random.default_rng(2)
    texts = [" ".join(f"p{rng.integers(50)}x q{rng.integers(50)}y" for _ in range(60)) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = maxent.language_model_scores(df, fold_of("doc_id", 10) == 0).filter("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows) + 0.2 * sum(r.n_tokens for r in rows)


def test_query(spark, corpus):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{corpus}/documents.parquet").collect()]
    found = queries.op5(spark, corpus).collect()
    check(found, rows)
    held = [r for r in found if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
