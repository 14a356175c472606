import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from catalogspark.llm import components, jaccard_join, queries
from tests.llm.conftest import words


def shingles(text):
    split = (text or "").encode().lower().split()
    return frozenset(tuple(split[i:i + 5]) for i in range(max(1, len(split) - 4))) if split else frozenset()


class Groups(dict):
    def top(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.top(a), self.top(b)
        self[max(a, b)] = min(a, b)


def brute(rows):
    """component by row number, over rows with an id and words."""
    sets = [shingles(t) for _, t in rows]
    groups = Groups()
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and rows[i][0] is not None and rows[j][0] is not None:
                same = len(sets[i] & sets[j])
                if 100 * same >= 75 * (len(sets[i]) + len(sets[j]) - same):
                    groups.join(i, j)
    lowest = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            top = groups.top(i)
            lowest[top] = min(lowest.get(top, doc), doc)
    return [(d, len(s), None if d is None else lowest[groups.top(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def found(df, **options):
    return sorted(map(tuple, jaccard_join.near_duplicates(df, **options).collect()), key=str)


def test_odd_rows(odd, clashing):
    # Rows that share a doc_id have the same text here, so one component per id is defined.
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    expected = sorted(brute(rows), key=str)
    assert found(odd) == expected
    assert found(clashing) == expected


def test_empty_table(no_docs):
    assert found(no_docs) == []


def near_group(n, edits, seed, length=120):
    rng = random.Random(seed)
    base = words(seed, length, 10_000).split()
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randrange(edits + 1)):
            copy[rng.randrange(len(copy))] = f"edit{rng.randrange(10 ** 6)}"
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("long_list", [2, 8, 32])
def test_large_groups_of_near_copies(spark, long_list, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_BYTES", 8192)
    passage = words(99, 60, 5000)
    texts = near_group(60, 8, 1) + near_group(40, 3, 2)
    texts += [f"{words(300 + i, 20, 9000)} {passage} {words(400 + i, i, 9000)}" for i in range(50)]
    rows = list(enumerate(texts))
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert found(df, long_list=long_list) == sorted(brute(rows), key=str)


@pytest.mark.parametrize("long_list", [3, 32])
def test_equal_prefixes_with_unlike_rests(spark, long_list, monkeypatch):
    """Sets of one size whose rarest shingles are the same: one group, whose members are verified one by one."""
    monkeypatch.setattr(jaccard_join, "VERIFY_BYTES", 4096)
    monkeypatch.setattr(jaccard_join, "prefix_of", lambda hashes, *_: hashes[:0] + hashes[:1] % 2 if len(hashes) else hashes)
    texts = near_group(30, 6, 21, 60) + near_group(25, 4, 22, 60) + [words(600 + i, 60, 10 ** 6) for i in range(20)]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert found(df, long_list=long_list) == sorted(brute(rows), key=str)


@pytest.mark.parametrize("verify_bytes", [256, 1 << 23])
def test_verification_in_blocks(spark, monkeypatch, verify_bytes):
    monkeypatch.setattr(jaccard_join, "VERIFY_BYTES", verify_bytes)
    rows = list(enumerate(near_group(25, 9, 31) + near_group(12, 3, 32) + [words(700 + i, 40, 10 ** 6) for i in range(10)]))
    assert found(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)) == sorted(brute(rows), key=str)


def test_groups_are_formed_on_the_path(spark):
    """Near copies that differ in common shingles only share prefix and size."""
    base = words(41, 80, 10 ** 6)
    hashes = [next(jaccard_join.shingle_sets(pa.array([t], pa.large_string()))) for t in (base, base + " tail")]
    none = np.zeros(0, np.uint64), np.zeros(0, np.uint8)
    prefixes = [jaccard_join.prefix_of(h, np.uint64(28), *none) for h in hashes]
    assert [len(p) for p in prefixes] == [jaccard_join.prefix_length(len(h)) for h in hashes]
    assert jaccard_join.group_of(prefixes[0], 76) != jaccard_join.group_of(prefixes[0], 77)
    docs = spark.createDataFrame([(i, f"{base} {i}") for i in range(6)], "doc_id bigint, text string")
    rows = jaccard_join._set_rows(docs, 4, none, 5).collect()
    assert len({r.node for r in rows}) == 6 and len({r.grp for r in rows}) < 6


def test_borders_of_the_threshold(spark):
    """Pairs at and around 75 of 100, with sets from 1 to 40 shingles."""
    texts = []
    for size in (1, 2, 3, 4, 5, 7, 8, 12, 16, 40):
        base = words(size, size + 4, 10 ** 6)
        texts += [base] + [base + " " + words(1000 + size * 50 + k, k, 10 ** 6) for k in range(1, size // 3 + 3)]
    rows = list(enumerate(texts))
    assert found(spark.createDataFrame(rows, "doc_id bigint, text string")) == sorted(brute(rows), key=str)


def test_one_row_of_each_group_stays(odd, spark):
    kept = jaccard_join.one_per_group(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    # 6, 7 and 8 are one group (and 6 stands there three times); of 1 both rows stay: no words.
    assert ids.count(6) == 1 and not {7, 8} & set(ids) and ids.count(1) == 2 and ids.count(None) == 2


def test_unlike_texts_under_one_id_are_decided_one_by_one(spark):
    a, b, c, d = (words(seed, 60, 10 ** 6) for seed in (501, 502, 503, 504))
    rows = [(1, a), (5, a + " more"), (5, b), (5, b.upper()), (6, b + " more"), (7, c), (7, d), (7, None), (8, a), (8, ""), (9, d)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    kept = sorted((r.doc_id, (r.text or "").lower()) for r in jaccard_join.one_per_group(df).collect())
    assert kept == sorted([(1, a), (5, b), (7, c), (7, d), (7, ""), (8, "")])


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_components(spark, links):
    groups = Groups()
    for a, b in links:
        groups.join(a, b)
    df = spark.createDataFrame(links, "a bigint, b bigint")
    expected = {n: groups.top(n) for a, b in links if a != b for n in (a, b)}
    assert {r.node: r.component for r in components.components(df).collect()} == expected


def test_long_chain(spark):
    df = spark.range(200).selectExpr("id as a", "id + 1 as b")
    assert {r.component for r in components.components(df).collect()} == {0}


def test_query(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet").collect()
    assert sorted(map(tuple, queries.op6(spark, corpus).collect())) == sorted(brute([(r.doc_id, r.text) for r in docs]))


def _bucket_table(entries):
    """A bucket's table of (token, group, size, place) entries, as one task posts it."""
    kinds = (("tokens", "<u4"), ("groups", "<i8"), ("sizes", "<u4"), ("places", "<u2"))
    columns = [[np.array([e[i] for e in entries], kind).tobytes()] for i, (_, kind) in enumerate(kinds)]
    return pa.table([pa.array([0], pa.int32()), *[pa.array(c, pa.binary()) for c in columns]], names=["bucket", *[n for n, _ in kinds]])


@pytest.mark.parametrize("buckets", [1, 16])
def test_rows_of_lists_follow_tokens_not_pairs_or_buckets(spark, buckets):
    """20 groups that share 16 tokens have 190 pairs: in every bucket, they were as many rows."""
    tables = [[(t, g, 100, t) for t in range(16) if t % buckets == b for g in range(20)] for b in range(buckets)]
    found = [row for t in tables for row in jaccard_join._token_lists(_bucket_table(t), 32).to_pylist()]
    assert len(found) == 16 and all(r["groups"] == list(range(20)) for r in found)
    pairs = jaccard_join._list_pairs(spark.createDataFrame(found, "kind int, token bigint, groups array<bigint>, sizes array<bigint>, places array<bigint>"))
    assert sorted((r.a, r.b, r.n, r.early) for r in pairs.collect()) == [(a, b, 16, 1) for a in range(20) for b in range(a + 1, 20)]


def test_pairs_of_lists_match_all_pairs(spark):
    rng = random.Random(4)
    size = {g: rng.choice([1, 20, 30, 40, 41, 90]) for g in range(-12, 12)}
    held = {g: sorted(rng.sample(range(30), rng.randint(1, 12))) for g in size}
    entries = [(t, g, size[g], held[g].index(t)) for g in size for t in held[g]] * 2
    rng.shuffle(entries)
    rows = jaccard_join._token_lists(_bucket_table(entries), 9).to_pylist()
    on = {t: sorted(g for g in size if t in held[g]) for t in range(30)}
    assert sorted((r["token"], r["groups"][0]) for r in rows if r["kind"]) == sorted((t, g) for t in on if len(on[t]) > 9 for g in on[t])
    wanted = set()
    for a in size:
        for b in size:
            common = [t for t in held[a] if t in held[b] and len(on[t]) <= 9]
            if a < b and common and 4 * min(size[a], size[b]) >= 3 * max(size[a], size[b]):
                least = -(-75 * (size[a] + size[b]) // 175)
                early = any(min(size[a] - held[a].index(t), size[b] - held[b].index(t)) + jaccard_join.SLACK >= least for t in common)
                wanted.add((a, b, size[a], size[b], len(common), int(early)))
    short = [r for r in rows if not r["kind"]]
    lists = spark.createDataFrame(short, "kind int, token bigint, groups array<bigint>, sizes array<bigint>, places array<bigint>")
    assert {tuple(r) for r in jaccard_join._list_pairs(lists).collect()} == wanted
