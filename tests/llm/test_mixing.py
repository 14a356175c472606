import numpy as np
import pytest

from catalogspark.llm import mixing, queries


def expected_targets(sizes: dict, weights=(1, 2, 3), cap=3) -> dict:
    """Water filling, source by source (null last)."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_ = {}, set(names)
    while open_:
        level = (sum(sizes.values()) - sum(target.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > cap * sizes[s]}
        if not over:
            target.update({s: level * weight[s] for s in open_})
            break
        target.update({s: cap * sizes[s] for s in over})
        open_ -= over
    return target


def check(rows, docs):
    sizes = {}
    for r in docs:
        sizes[r.source] = sizes.get(r.source, 0) + len((r.text or "").encode().split())
    targets = expected_targets(sizes)
    taken = {}
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source])
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    return taken, targets


def test_odd_rows_and_reruns(odd):
    docs = odd.collect()
    first, again = (sorted(map(tuple, mixing.mix(odd).collect()), key=str) for _ in range(2))
    assert first == again and len(first) == len(docs)
    rows = mixing.mix(odd).collect()
    taken, targets = check(rows, docs)
    largest = {s: max(r.size for r in rows if r.source == s) for s in taken}
    assert all(abs(taken[s] - targets[s]) <= largest[s] for s in taken)


def test_query_comes_near_its_targets(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    rows = mixing.mix(docs).collect()
    taken, targets = check(rows, docs.collect())
    assert all(abs(taken[s] / targets[s] - 1) < 0.05 for s in targets)
    assert {r.doc_id for r in queries.op3(spark, corpus).collect()} == {r.doc_id for r in rows}


def test_excess_of_capped_sources_is_shared_again(spark):
    sizes = {"a": 1, "b": 1000, "c": 2, "d": 500, None: 7, "e": 0}
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    found = {r.source: r.target for r in mixing.source_targets(rows).collect()}
    assert found == pytest.approx(expected_targets(sizes))


def test_newton_reaches_the_dual_optimum(spark):
    classes = spark.createDataFrame([("a", 10, 5), ("a", 20, 5), ("b", 7, 3), ("c", 5, 1)], "source string, size bigint, n bigint")
    targets = spark.createDataFrame([("a", 150, 37.5), ("b", 21, 63.0), ("c", 5, 0.0)], "source string, source_size bigint, target double")
    rates = {r.source: r.rate for r in mixing.tilts(classes, targets).collect()}
    assert rates == pytest.approx({"a": 0.25, "b": 3.0, "c": 0.0})


def test_a_large_source_is_cut_into_slices(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 9), "hot" if i % 3 else "cold") for i in range(3000)], "doc_id bigint, text string, source string")
    taken, targets = check(mixing.mix(docs, slice_rows=20).collect(), docs.collect())
    assert all(abs(taken[s] - targets[s]) <= 1 for s in targets)


def test_copies_and_clashing_columns(clashing, no_docs):
    mixed = mixing.mix(clashing)
    made = mixing.apply_copies(clashing, mixed)
    assert made.columns == clashing.columns
    assert made.count() == mixed.agg({"copies": "sum"}).first()[0]
    assert made.filter("copies <> 'own copies'").count() == 0
    assert mixing.apply_copies(no_docs, mixing.mix(no_docs)).count() == 0


def test_plan_has_no_python(spark, corpus):
    plan = queries.op3(spark, corpus)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert np.isfinite(len(plan))
