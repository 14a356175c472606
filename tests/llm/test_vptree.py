import numpy as np
from pyspark.sql import functions as F

from catalogspark.llm import queries, vptree

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, k=5, every=50):
    """query -> [(vec_id, score)] by a full scan."""
    valid = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            valid.setdefault(i, np.array(v, np.float32).astype(float))
    out = {}
    for q, a in valid.items():
        if q % every == 0:
            scores = [(float(a @ b) / (np.sqrt(a @ a) * np.sqrt(b @ b)), c) for c, b in valid.items() if c != q]
            out[q] = sorted(scores, key=lambda s: (-round(s[0], 12), s[1]))[:k]
    return out


def check(found, expected, exact=True):
    by_query = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        by_query.setdefault(r.query_id, []).append(r)
    assert set(by_query) == {q for q, s in expected.items() if s}
    hits = total = 0
    for q, rows in by_query.items():
        assert [r.rank for r in rows] == list(range(1, len(expected[q]) + 1))
        if exact:
            assert [r.vec_id for r in rows] == [c for _, c in expected[q]]
            assert np.allclose([r.score for r in rows], [s for s, _ in expected[q]], atol=1e-12)
        hits += len({r.vec_id for r in rows} & {c for _, c in expected[q]})
        total += len(expected[q])
    return hits / total


def odd_vectors():
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(4).tolist(), 0) for i in range(120)]
    hot = rng.standard_normal(4).tolist()
    rows += [(i, hot, 1) for i in range(120, 260)]  # more equal vectors than neighbours asked for
    rows += [(300, None, 0), (350, [0.0] * 4, 0), (400, [1.0, None, 0.0, 1.0], 0), (450, [float("nan")] * 4, 0),
             (500, [float("inf"), 0.0, 0.0, 1.0], 0), (None, hot, 0), rows[3], (550, [2 * x for x in hot], None)]
    return rows


def test_odd_vectors_and_ties(spark):
    rows = odd_vectors()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumn("reach", F.lit(1)).withColumn("ids", F.lit("x"))
    expected = brute([(i, v) for i, v, _ in rows])
    check(vptree.nearest(df, F.col("vec_id") % 50 == 0, factor=1.0).collect(), expected)


def test_factor_one_is_exact_over_many_cells_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(vptree, "SHARD_ROWS", 40)
    monkeypatch.setattr(vptree, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((6, 8))
    rows = [(i, (centres[i % 6] + 0.2 * rng.standard_normal(8)).tolist(), 0) for i in range(500)]
    df = spark.createDataFrame(rows, SCHEMA)
    expected = brute([(i, v) for i, v, _ in rows])
    check(vptree.nearest(df, F.col("vec_id") % 50 == 0, factor=1.0, pivots=6).collect(), expected)


def test_ties_of_many_different_vectors(spark):
    """Multiples of one vector are equally far but for rounding: exact score, then id decide, however many there are."""
    rng = np.random.default_rng(4)
    base = rng.integers(-500, 500, 24)
    rows = [(i, (base * (i * 7 % 41 + 1)).astype(float).tolist(), 0) for i in range(10, 51)]
    rows += [(0, (base + rng.integers(-200, 200, 24)).astype(float).tolist(), 0)]
    rows += [(i, rng.standard_normal(24).tolist(), 0) for i in range(60, 100)]
    vectors = {i: np.array(v, np.float32).astype(float) for i, v, _ in rows}
    dot = lambda a, b: np.cumsum(a * b)[-1]
    score = lambda a, b: dot(a, b) / (np.sqrt(dot(a, a)) * np.sqrt(dot(b, b)))
    expected = {
        q: sorted((-score(vectors[q], v), i) for i, v in vectors.items() if i != q)[:5] for q in (0, 50)
    }
    found = vptree.nearest(spark.createDataFrame(rows, SCHEMA).repartition(3), F.col("vec_id") % 50 == 0, factor=1.0).collect()
    for q, wanted in expected.items():
        got = sorted((r["rank"], -r.score, r.vec_id) for r in found if r.query_id == q)
        assert [g[1:] for g in got] == wanted


def test_few_candidates_and_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert vptree.nearest(none, F.col("vec_id") % 50 == 0).count() == 0
    two = spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [0.0, 1.0], 0)], SCHEMA)
    assert [(r.query_id, r["rank"], r.vec_id) for r in vptree.nearest(two, F.col("vec_id") % 50 == 0).collect()] == [(0, 1, 1)]
    one = two.filter("vec_id = 0")
    assert vptree.nearest(one, F.col("vec_id") % 50 == 0).count() == 0


def test_pruning_saves_work_and_keeps_recall():
    rng = np.random.default_rng(3)
    points = np.repeat(rng.standard_normal((40, 6)), 50, axis=0) + 0.05 * rng.standard_normal((2000, 6))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    queries_ = points[:60] + 0.01
    queries_ /= np.linalg.norm(queries_, axis=1, keepdims=True)
    tree = vptree.Tree(points, leaf=32)
    exact = np.sort(vptree._distances(queries_, points), axis=1)[:, :6]
    d, _ = tree.search(queries_, np.full(60, np.inf), 6, 6, 1.0)
    assert np.allclose(d, exact)
    d, _ = tree.search(queries_, np.full(60, np.inf), 6, 6, vptree.FACTOR)
    assert (d <= exact[:, -1:] + 1e-9).mean() >= 0.9


def test_query_recall(spark, corpus):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{corpus}/embeddings.parquet").collect()]
    assert check(queries.op7(spark, corpus).collect(), brute(rows), exact=False) >= 0.9
