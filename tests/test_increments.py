"""Generations by changes equal a full publish of the same records."""

import random

import pytest

from catalogspark.operators.catalog import with_record_id
from catalogspark.operators.facets import facet_cube
from catalogspark.operators.index import postings, vocabulary
from catalogspark.operators.tree import folder_counts
from catalogspark.plans import publish, search
from catalogspark.plans.increments import FIRST_LEVEL, Corpus
from catalogspark.schema import CATALOG

WORDS = ["red", "ring", "rod", "资本", "a1"]


def record(ord_, rng):
    folder = rng.sample(["x", "y"], rng.randint(0, 2))
    return (ord_, rng.choice(["o/a", "o/b"]), " ".join(rng.sample(WORDS, rng.randint(1, 2))), rng.choice(["pdf", "TXT", ""]),
            folder, rng.choice([None, 5]), rng.random() < 0.5)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def same_as_full(corpus, generation, catalog):
    full = with_record_id(catalog).drop("folder_path")
    columns = ["ord", "repo", "file", "ext", "folder", "size", "has_txt", "occurrence", "record_id"]
    assert rows_of(corpus.records(generation).select(columns)) == rows_of(full.select(columns))
    rows = postings(catalog)
    assert rows_of(corpus.postings(generation).select(rows.columns)) == rows_of(rows)
    words = vocabulary(rows)
    assert rows_of(corpus.vocabulary(generation).select(words.columns)) == rows_of(words)
    assert rows_of(corpus.cube(generation).select("repo", "ext", "count", "txt_count")) == rows_of(facet_cube(catalog))
    counts = folder_counts(catalog)
    assert rows_of(corpus.folder_counts(generation).select(counts.columns)) == rows_of(counts)


@pytest.mark.parametrize("fanout", [2, 3])
def test_changes_equal_a_full_publish(spark, tmp_path, fanout):
    rng = random.Random(fanout)
    live = {i: record(i, rng) for i in range(60)}
    corpus = Corpus(spark, str(tmp_path), fanout)
    generation = corpus.start(spark.createDataFrame(list(live.values()), CATALOG))
    top = 60
    for step in range(3):
        removed = rng.sample(sorted(live), 8) + [10**6]
        added = [record(top + i, rng) for i in range(rng.choice([0, 6]))]
        top += len(added)
        for i in removed:
            live.pop(i, None)
        live.update({r[0]: r for r in added})
        generation = corpus.change(
            spark.createDataFrame(added, CATALOG) if added else None, spark.createDataFrame([(i,) for i in removed], "ord bigint")
        )
    same_as_full(corpus, generation, spark.createDataFrame(list(live.values()), CATALOG))
    assert len(corpus.parts(generation)) < 4
    found = search.search(corpus.records(generation), corpus.index(generation), q="red ring")
    assert found.totals.first().total == sum({"red", "ring"} <= set((r[2] + " " + " ".join(r[4])).split()) for r in live.values())


def test_a_small_change_writes_little_and_keeps_the_past(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, "o/a", f"name{i} common", "pdf", [], 1, False) for i in range(2000)]
    corpus = Corpus(spark, str(tmp_path))
    first = corpus.start(spark.createDataFrame(rows, CATALOG))
    added = [(2000 + i, "o/a", f"name{2000 + i} common", "pdf", [], 1, False) for i in range(20)]
    second = corpus.change(spark.createDataFrame(added, CATALOG))
    part = max(p for p, _ in corpus.parts(second))
    assert spark.read.parquet(f"{tmp_path}/records/part={part}").count() == 20
    assert spark.read.parquet(f"{tmp_path}/postings/part={part}").count() == 80
    assert corpus.records(first).count() == 2000 and corpus.records(second).count() == 2020
    assert corpus.vocabulary(second).filter("scope = 'file' AND token = 'common'").first().df == 2020


def test_copies_are_numbered_again(spark, tmp_path):
    rows = [(i, "o/a", "same", "pdf", [], 1, False) for i in range(6)]
    corpus = Corpus(spark, str(tmp_path))
    corpus.start(spark.createDataFrame(rows, CATALOG))
    more = [(9, "o/a", "same", "pdf", [], 1, False)]
    generation = corpus.change(spark.createDataFrame(more, CATALOG), spark.createDataFrame([(1,), (3,)], "ord bigint"))
    got = {r.ord: r.occurrence for r in corpus.records(generation).collect()}
    assert got == {0: 0, 2: 1, 4: 2, 5: 3, 9: 4}


def test_everything_goes_and_comes_back(spark, tmp_path):
    rows = [(i, "o/a", f"n{i}", "pdf", ["x"], 1, True) for i in range(4)]
    corpus = Corpus(spark, str(tmp_path), 2)
    corpus.start(spark.createDataFrame(rows, CATALOG))
    empty = corpus.change(removed=spark.range(4).withColumnRenamed("id", "ord"))
    assert corpus.records(empty).count() == 0 and corpus.vocabulary(empty).count() == 0 and corpus.cube(empty).count() == 0
    new = [(7, "o/a", "n1", "pdf", ["x"], 1, True)]
    generation = corpus.change(spark.createDataFrame(new, CATALOG))
    same_as_full(corpus, generation, spark.createDataFrame(new, CATALOG))


def test_levels_bound_the_parts(spark, tmp_path):
    corpus = Corpus(spark, str(tmp_path), 2)
    corpus.start(spark.createDataFrame([(0, "o/a", "n", "pdf", [], 1, True)], CATALOG))
    sizes = []
    for i in range(1, 4):
        generation = corpus.change(spark.createDataFrame([(i, "o/a", f"n{i}", "pdf", [], 1, True)], CATALOG))
        sizes.append([level for _, level in corpus.parts(generation)])
    assert sizes == [[FIRST_LEVEL, 0], [FIRST_LEVEL, 1], [FIRST_LEVEL, 1, 0]]


def test_old_ords_are_refused(spark, tmp_path):
    rows = [(i, "o/a", f"n{i}", "pdf", [], 1, True) for i in range(3)]
    corpus = Corpus(spark, str(tmp_path))
    corpus.start(spark.createDataFrame(rows, CATALOG))
    with pytest.raises(ValueError):
        corpus.change(spark.createDataFrame(rows[2:], CATALOG))


def test_a_number_is_taken_once(spark, tmp_path):
    publish.claim(spark, str(tmp_path), 1)
    with pytest.raises(FileExistsError):
        publish.claim(spark, str(tmp_path), 1)
