import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from catalogspark.llm import line_runs, queries

GAPS = " \t\n\x0b\x0c\r"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(rows, min_chars, min_docs):
    """(doc_id, kept text) of every row, straight from the rule."""
    held = defaultdict(list)
    for n, (doc, text) in enumerate(rows):
        for key in {lower(line.strip(GAPS)) for line in (text or "").split("\n")}:
            if len(key) >= min_chars:
                held[key].append((doc, n))
    out = []
    for doc, text in rows:
        kept = []
        for line in (text or "").split("\n"):
            key = lower(line.strip(GAPS))
            docs = held.get(key, [])
            last = max((d for d, _ in docs if d is not None), default=None)
            if not (len(docs) >= min_docs and doc is not None and last is not None and doc < last):
                kept.append(line)
        out.append((doc, "\n".join(kept)))
    return out


def order(rows):
    return sorted(rows, key=str)


def test_whole_rule_on_odd_rows(odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    for min_docs in (2, 3):
        done = line_runs.dedup_lines(odd.select("doc_id", "text"), min_chars=10, min_docs=min_docs, batches=5, fanout=2)
        assert order((r.doc_id, r.kept_text) for r in done.collect()) == order(brute(rows, 10, min_docs))


def test_clashing_columns_pass_through(clashing, odd):
    done = line_runs.dedup_lines(clashing, min_chars=10, min_docs=2)
    assert done.columns[:len(clashing.columns)] == clashing.columns
    assert done.filter("h1 <> 'own h1' or n_lines <> 'own n_lines'").count() == 0
    plain = line_runs.dedup_lines(odd, min_chars=10, min_docs=2)
    assert order(r[-1] for r in done.collect()) == order(r[-1] for r in plain.collect())


def test_empty_table(no_docs):
    assert line_runs.dedup_lines(no_docs).count() == 0


def test_runs_are_compacted_and_merged(spark):
    runs = line_runs.LineRuns(spark, fanout=2)
    for batch in range(5):
        runs.add(spark.createDataFrame([(batch, 7, 7), (batch, batch, 0)], "doc_id bigint, h1 bigint, h2 bigint"))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    assert {(r.h1, r.n_docs, r.last_doc) for r in runs.all().collect()} == {
        (7, 5, 4), *[(b, 1, b) for b in range(5)]
    }
    # No key stands in two runs; the key of all batches is in the oldest, its repetitions are set aside.
    held = [r.h1 for level in runs.levels for run in level for r in run.collect()]
    assert sorted(held) == [0, 1, 2, 3, 4, 7] and len(runs.again) == 4


def test_batches_double_and_follow_the_bytes(spark):
    docs = spark.createDataFrame([(i, f"a line that is long enough to be a key of its own {i}") for i in range(2000)], "doc_id bigint, text string")
    assert line_runs.batch_count(docs, 1 << 30) == 1 and line_runs.batch_count(docs, 10_000) == 5
    sizes = {r.batch: r["count"] for r in line_runs.line_keys(docs, 4).groupBy("batch").count().collect()}
    assert sum(sizes.values()) == 2000 and set(sizes) == {0, 1, 2, 3}
    assert abs(sizes[3] - 1000) < 120 and abs(sizes[2] - 500) < 90


def test_batches_are_anti_joined_with_the_runs(spark, monkeypatch, capsys):
    """The query's own path: every batch after the first meets the runs in a merge anti-join."""
    plans, store = [], line_runs.LineRuns._store

    def watched(self, rows):
        rows.explain()
        plans.append(capsys.readouterr().out)
        return store(self, rows)

    monkeypatch.setattr(line_runs.LineRuns, "_store", watched)
    docs = spark.createDataFrame([(i, f"one of seven lines that are long enough to count {i % 7}") for i in range(70)], "doc_id bigint, text string")
    done = line_runs.dedup_lines(docs, batches=3)
    assert done.agg(F.sum("n_dropped")).first()[0] == 63
    assert sum("SortMergeJoin" in p and "LeftAnti" in p for p in plans) >= 4


def test_first_holders_anti_join_earlier_batches(spark):
    schema = "doc_id bigint, h1 bigint, h2 bigint"
    batches = [[(1, 5, 5), (2, 5, 5), (2, 6, 6)], [(3, 6, 6), (3, 8, 8)], [(4, 8, 8), (4, 9, 9)]]
    found = line_runs.first_holders(spark, [spark.createDataFrame(b, schema) for b in batches], fanout=2)
    assert [{(r.h1, r.doc_id) for r in part.collect()} for part in found] == [{(5, 1), (6, 2)}, {(8, 3)}, {(9, 4)}]


def test_query(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    expected = {d: hashlib.sha256(t.encode()).hexdigest() for d, t in brute(rows, 40, 5)}
    assert {r.doc_id: r.kept_sha256 for r in queries.op9(spark, corpus).collect()} == expected


def test_drop_is_visible_in_counts(spark):
    line = "the same line that stands in very many documents of this table"
    docs = spark.createDataFrame([(i, f"{line}\nown {i}") for i in range(6)], "doc_id bigint, text string")
    done = {r.doc_id: r for r in line_runs.dedup_lines(docs).collect()}
    assert [done[i].n_dropped for i in range(6)] == [1] * 5 + [0]
    assert done[0].kept_text == "own 0" and done[5].kept_text == f"{line}\nown 5"
    assert line_runs.dedup_lines(docs.withColumn("doc_id", F.lit(None).cast("bigint"))).agg(F.sum("n_dropped")).first()[0] == 0
