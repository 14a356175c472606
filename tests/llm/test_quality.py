from collections import Counter

import numpy as np

from catalogspark.llm import quality, queries


def measures(text):
    text = text or ""
    split = [w for w in text.encode().split()]
    windows = Counter(tuple(split[i:i + 8]) for i in range(len(split) - 7))
    covered = {j for i in range(len(split) - 7) if windows[tuple(split[i:i + 8])] > 1 for j in range(i, i + 8)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if line.encode().split():
            dup += line in lines
            lines.add(line)
    return (
        len(split), sum(len(w.decode()) for w in split), sum(c in "#*$%&|<>" for c in text), dup, len(covered),
    )


def check(rows):
    for r in rows:
        expected = measures(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expected
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert r.kept == (not r.base_failed and r.llr >= r.threshold)


def test_base_measures_of_odd_rows(odd, no_labels):
    rows = quality.quality_rules(odd.select("doc_id", "text"), no_labels).collect()
    assert len(rows) == odd.count()
    check(rows)


def test_clashing_columns(clashing, no_labels):
    done = quality.quality_rules(clashing, no_labels)
    assert done.columns[:len(clashing.columns)] == clashing.columns
    assert done.columns[-1] == "kept_" and done.filter("kept <> 'own kept'").count() == 0


def test_empty_tables(no_docs, no_labels):
    assert quality.quality_rules(no_docs, no_labels).count() == 0


def test_ratio_is_that_of_the_two_multinomials(spark):
    docs = spark.createDataFrame([(1, "a b a", True), (2, "c d", False), (3, None, None)], "doc_id bigint, text string, good boolean")
    counts = {r.bucket: (r.n_target, r.n_raw) for r in quality.gram_counts(docs, "good").collect()}
    # Words a (twice) and b, pairs ab and ba; words c and d, pair cd.
    assert sorted(counts.values()) == sorted([(2, 2), (1, 1), (1, 1), (1, 1), (0, 1), (0, 1), (0, 1)])
    ratios = quality.log_ratios(quality.gram_counts(docs, "good"))
    seen = {b: ratios[b] for b in counts}
    assert min(seen[b] for b in counts if counts[b][0]) > 0 > max(seen[b] for b in counts if not counts[b][0])
    assert np.all(np.isfinite(ratios))


def test_junk_goes_and_clean_documents_stay(spark, corpus):
    rows = queries.op2(spark, corpus.replace("0.001", "0.01")).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{corpus.replace('0.001', '0.01')}/labels.parquet").collect()}
    passed = [r for r in rows if not r.base_failed and r.doc_id in labels]
    good = [r.kept for r in passed if labels[r.doc_id] == 1]
    bad = [r.kept for r in passed if labels[r.doc_id] == 0]
    assert np.mean(good) >= 0.99 and np.mean(bad) <= 0.05


def test_threshold_without_one_of_the_classes(spark):
    scores = spark.createDataFrame([(0.1, 1), (0.2, 1), (0.5, None)], "s double, good int")
    assert quality.fitted_threshold(scores, "s", "good") == -quality.SPAN
