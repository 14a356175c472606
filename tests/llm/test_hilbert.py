import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from catalogspark.llm import hilbert, queries


@pytest.mark.parametrize("dimensions, bits", [(2, 3), (3, 2), (3, 3)])
def test_curve_visits_every_cell_by_single_steps(spark, dimensions, bits):
    side = 1 << bits
    cells = spark.range(side ** dimensions)
    for d in range(dimensions):
        cells = cells.withColumn(f"x{d}", (F.floor(F.col("id") / side ** d) % side).cast("int"))
    levels = [f"x{d}" for d in range(dimensions)]
    rows = cells.withColumn("h", hilbert.hilbert_index([F.col(c) for c in levels], bits)).orderBy("h").collect()
    assert [r.h for r in rows] == list(range(side ** dimensions))
    for a, b in zip(rows, rows[1:]):
        assert sum(abs(a[c] - b[c]) for c in levels) == 1


def check(rows, docs, shards=24):
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == Counter(
        (d.doc_id, len((d.text or "").encode()) + 8, zlib.crc32((d.text or "").encode())) for d in docs
    )
    by_shard = {}
    for r in rows:
        by_shard.setdefault(r.shard, []).append(r.slot)
    counts = [len(by_shard.get(s, [])) for s in range(shards)]
    assert max(counts) - min(counts) <= 1 and set(by_shard) <= set(range(shards))
    assert all(sorted(slots) == list(range(len(slots))) for slots in by_shard.values())


def test_odd_rows(odd, clashing):
    check(hilbert.document_shards(odd).collect(), odd.collect())
    check(hilbert.document_shards(clashing, shards=5).collect(), odd.collect(), 5)


def test_clashing_names_of_the_general_operator(clashing):
    narrow = clashing.select("doc_id", "source", "n_chars", "shard", "place").cache()
    done = hilbert.hilbert_shards(narrow, "doc_id", ["source"], ["n_chars"], [], shards=3)
    assert done.columns[:5] == narrow.columns and done.filter("shard <> 'own shard'").count() == 0
    assert {r.shard_ for r in done.collect()} == {0, 1, 2}


def test_empty_table(no_docs):
    assert hilbert.document_shards(no_docs).count() == 0


def test_query_and_pruning(spark, corpus):
    docs = spark.read.parquet(f"{corpus.replace('0.001', '0.01')}/documents.parquet")
    rows = queries.op8(spark, corpus.replace("0.001", "0.01"))
    check(rows.collect(), docs.collect())
    assert {r.law for r in rows.collect()} == {"rows"}
    # A shard holds few of the 20 sources.
    spread = rows.join(docs, "doc_id").groupBy("shard").agg(F.countDistinct("source").alias("n")).agg(F.avg("n")).first()[0]
    assert spread < 10
    plan = rows._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_files_are_written_by_shard(odd, spark, tmp_path):
    own = odd.filter("doc_id is not null").dropDuplicates(["doc_id"])
    hilbert.write_shards(own, hilbert.document_shards(own, shards=4), str(tmp_path / "out"), shards=4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == own.count() and {r.shard for r in back.select("shard").distinct().collect()} == {0, 1, 2, 3}


def test_equal_texts_lie_together(spark):
    """Copies with other sources and languages lie where the smallest doc_id lies; a group spans a shard's end at most."""
    rows = []
    for g in range(30):
        for c in range(1 + g % 9):
            rows.append((len(rows), f"text {g} " * (g + 1), f"l{(g + c) % 4}", f"s{(g * c) % 7}", None))
    rows.append((None, "text 3 " * 4, None, None, None))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)
    placed = sorted((r.shard, r.slot, r.text_crc32) for r in hilbert.document_shards(docs, shards=6).collect())
    order = [crc for _, _, crc in placed]
    assert len(order) == len(rows)
    runs = [c for i, c in enumerate(order) if i == 0 or order[i - 1] != c]
    assert len(runs) == len(set(runs)) == 30
