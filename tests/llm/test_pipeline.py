"""The stages one after the other, each against the brute-force version of its rule."""

from collections import Counter

import corpus_pipeline
from tests.llm.test_jaccard_join import brute as near_brute
from tests.llm.test_line_runs import brute as line_brute
from tests.llm.test_mixing import expected_targets
from tests.llm.test_quality import measures


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_duplicates", "mix_sources", "pack"]


def test_stages_on_the_corpus(spark, corpus, tmp_path):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    held = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, corpus)
        if name != "pack":
            assert made.columns == docs.columns and made.dtypes == docs.dtypes
        made.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        held.append(docs.collect())
    read, judged, deduped, single, mixed, pieces = held

    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{corpus}/labels.parquet").collect()}
    stayed = {r.doc_id for r in judged}
    for r in read:
        n_words, _, _, _, repeated = measures(r.text)
        if n_words < 20 or 100 * repeated > 30 * n_words:
            assert r.doc_id not in stayed
    assert sum(labels.get(r.doc_id) == 0 for r in judged) == 0

    lines = dict(line_brute([(r.doc_id, r.text) for r in judged], 40, 5))
    assert {r.doc_id: r.text for r in deduped} == lines and all(r.n_chars == len(r.text) for r in deduped)

    groups = near_brute([(r.doc_id, r.text) for r in deduped])
    assert {r.doc_id for r in single} == {d for d, n, c in groups if d == c}

    sizes = {}
    for r in single:
        sizes[r.source] = sizes.get(r.source, 0) + len(r.text.split())
    taken = {}
    for r in mixed:
        taken[r.source] = taken.get(r.source, 0) + len(r.text.split())
    targets = expected_targets(sizes)
    largest = {s: max(len(r.text.split()) for r in single if r.source == s) for s in sizes}
    assert all(abs(taken.get(s, 0) - t) <= max(0.05 * t, largest[s]) for s, t in targets.items())
    assert max(Counter(r.doc_id for r in mixed).values()) <= 3

    copies = Counter(r.doc_id for r in mixed)
    lengths = {}
    for p in pieces:
        lengths[p.doc_id] = lengths.get(p.doc_id, 0) + p.length
    assert lengths == {d: n * next(p.doc_tokens for p in pieces if p.doc_id == d) for d, n in copies.items()}


def test_run_returns_the_last_stage(spark, corpus):
    made = corpus_pipeline.run(spark, corpus)
    assert "sequence_id" in made.columns and made.count() > 0


def test_stages_survive_odd_rows(spark, clashing, no_docs, tmp_path, corpus):
    for at, rows in (("odd", clashing), ("none", no_docs)):
        docs = rows
        for name, stage in corpus_pipeline.STAGES:
            made = stage(spark, docs, corpus)
            made.write.parquet(str(tmp_path / at / name))
            docs = spark.read.parquet(str(tmp_path / at / name))
        assert docs.count() > 0 if at == "odd" else docs.count() == 0
