import random

import brute
import pytest
from pyspark.sql import functions as F

from catalogspark import session
from catalogspark.operators import fuzzy, index
from catalogspark.plans import search as plans
from catalogspark.schema import QUERY

WORDS = ["red", "ring", "rod", "bolt", "blue", "small", "widget", "gear", "10", "2020", "0", "a1", "资本", "论", "资料"]
EXTS = ["pdf", "PDF", "txt", "", "epub"]


def corpus(n=220, seed=7):
    pick = random.Random(seed)
    rows = []
    for _ in range(n):
        name = pick.choice([" ", "-", ""]).join(pick.sample(WORDS, pick.randint(1, 3)))
        folder = [pick.choice(["old", "new", "red", "论"]) for _ in range(pick.randint(0, 3))]
        size = pick.choice([None, 0, pick.randint(1, 5000)])
        rows.append((pick.choice(["o/a", "o/b", "red/c"]), name, pick.choice(EXTS), folder, size, pick.random() < 0.4))
    return rows


ROWS = corpus()

QUERIES = [
    dict(q=""),
    dict(q="", sort="size", page=2, page_size=50),
    dict(q="", repos=["o/b"], sort="size", page_size=7),
    dict(q="ring"),
    dict(q="Ring red"),
    dict(q="  red   rod ", search_folders=False),
    dict(q="rng"),
    dict(q="rng bolts"),
    dict(q="bolts red", sort="size"),
    dict(q="xx"),
    dict(q="x"),
    dict(q="a"),
    dict(q="qqqqqqqq"),
    dict(q="widgte gaer"),
    dict(q="资本"),
    dict(q="资本论"),
    dict(q="本资"),
    dict(q="料论"),
    dict(q="马"),
    dict(q="资 red"),
    dict(q="d r", exact=True),
    dict(q="red", exact=True, sort="size", page=2, page_size=10),
    dict(q="o/a", sort="relevance"),
    dict(q="r*g"),
    dict(q="r?d*"),
    dict(q="*"),
    dict(q="??", exact=True),
    dict(q="d-", search_folders=False),
    dict(q="old/new"),
    dict(q="OLD/NEW", search_folders=False),
    dict(q="red", extensions=["pdf"], min_size=100, max_size=4000),
    dict(q="red", folders=["old"], repos=["o/a", "red/c"]),
    dict(q="", folders=["/"], page_size=500),
    dict(q="", folders=["/old/new/", "red"], folder_match_mode="exact"),
    dict(q="e", exact=True, folder_match_mode="mixed", folder_selfs=["old"], folder_subtrees=["new/red", ""]),
    dict(q="red", page=99),
    dict(q="", page=0, page_size=0),
    dict(q="", page_size=9999),
    dict(q="", page_size=-3),
    dict(q="2020 0"),
    dict(q="11"),
    dict(q="2 020"),
    dict(q="redd", sort="unknown"),
    dict(q="*", repos=["o/a", "red/c", "o/a"], page_size=500),
    dict(q="", repos=["none"]),
]


@pytest.fixture(scope="module")
def catalog(make):
    return make(ROWS).cache()


@pytest.fixture(scope="module")
def built(catalog):
    made = plans.build_index(catalog)
    return plans.SearchIndex(made.postings.cache(), made.vocab.cache())


def expected():
    return {k: brute.search(ROWS, **q) for k, q in enumerate(QUERIES)}


def table(spark, queries):
    fields = [f.split()[0] for f in QUERY.split(", ")]
    return spark.createDataFrame(
        [tuple({"query_id": i, **q}.get(f) for f in fields) for i, q in enumerate(queries)], QUERY
    )


@pytest.mark.parametrize("limit", [-1, 1_000_000])
def test_batch_matches_brute_force(spark, catalog, built, limit):
    result = plans.search_batch(catalog, built, table(spark, QUERIES), candidate_limit=limit)
    got = {k: [] for k in range(len(QUERIES))}
    for row in result.rows.orderBy("query_id", "position").collect():
        got[row.query_id].append((row.ord, row.score))
    totals = {row.query_id: row.total for row in result.totals.collect()}
    for k, (total, page) in expected().items():
        assert totals[k] == total, QUERIES[k]
        assert got[k] == page, QUERIES[k]


def test_batch_too_large_to_broadcast(spark, catalog, built, monkeypatch):
    """Past the size limit the same joins shuffle, with the same answers."""
    monkeypatch.setattr(session, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(plans, "BROADCAST_BYTES", -1)
    asked = [q for q in QUERIES if q.get("sort") != "name"][:40]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = plans.search_batch(catalog, built, table(spark, asked)).rows.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for k, q in enumerate(asked):
        got = [(r.ord, r.score) for r in sorted(rows, key=lambda r: r.position) if r.query_id == k]
        assert got == brute.search(ROWS, **q)[1], q


@pytest.mark.parametrize("k", [0, 1, 2, 4, 6, 7, 8, 11, 17, 21, 23, 29, 30, 31, 34, 35, 41])
def test_single_matches_brute_force(catalog, built, k):
    result = plans.search(catalog, built, **QUERIES[k])
    rows = result.rows.orderBy("position").collect()
    total, page = expected()[k]
    assert [(r.ord, r.score) for r in rows] == page
    assert result.totals.first().total == total
    if rows:
        head = result.totals.first()
        assert rows[0].position == (head.page - 1) * head.page_size + 1


def test_deep_pages_use_the_distributed_rank(spark, catalog, built):
    deep = [dict(q="", page=21, page_size=10), dict(q="", page=3, page_size=500), dict(q="red", page=2, page_size=20)]
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "50")
    try:
        rows = plans.search_batch(catalog, built, table(spark, deep)).rows.collect()
    finally:
        spark.conf.unset("spark.sql.optimizer.windowGroupLimitThreshold")
    for k, q in enumerate(deep):
        got = [(r.ord, r.score) for r in sorted(rows, key=lambda r: r.position) if r.query_id == k]
        assert got == brute.search(ROWS, **q)[1]


def test_single_deep_page(catalog, built, monkeypatch):
    monkeypatch.setattr(plans, "DEEP_PAGE_ROWS", 20)
    q = dict(q="", sort="size", page=4, page_size=30)
    rows = plans.search(catalog, built, **q).rows.orderBy("position").collect()
    assert [r.ord for r in rows] == [i for i, _ in brute.search(ROWS, **q)[1]]
    assert rows[0].position == 91


def test_pages_join_up_to_the_whole_list(spark, catalog, built):
    """Consecutive pages neither overlap nor leave a gap."""
    pages = [dict(q="red", page=n, page_size=13, sort="size") for n in range(1, 12)]
    result = plans.search_batch(catalog, built, table(spark, pages))
    rows = result.rows.orderBy("query_id", "position").collect()
    assert len({r.ord for r in rows}) == len(rows) == result.totals.first().total
    assert [r.position for r in rows] == list(range(1, len(rows) + 1))
    assert all(r.score >= 0 for r in rows)


def test_empty_batches(spark, catalog, built):
    assert plans.search_batch(catalog, built, table(spark, [])).rows.count() == 0
    none = plans.search_batch(catalog, built, table(spark, [dict(q="zzzzzzzzzzz")]))
    assert none.rows.count() == 0 and none.totals.first().total == 0


@pytest.mark.parametrize("scope, deep", [("all", True), ("file", False)])
def test_index_and_vocabulary(catalog, built, scope, deep):
    wanted = brute.index_of(ROWS, deep)
    got = {}
    for r in built.postings.filter(F.col("scope") == scope).orderBy("ord").collect():
        got.setdefault(r.token, []).append(r.ord)
    assert got == wanted
    ranked = index.ranked_vocabulary(built.vocab).filter(F.col("scope") == scope)
    assert [r.token for r in ranked.orderBy("vocab_rank").collect()] == brute.vocab_of(wanted)


def test_cjk_bigram_crosses_into_folder(make):
    rows = index.postings(make([("r", "资本", "", ["论"], None, False)]))
    scopes = {(r.scope, r.token) for r in rows.collect()}
    assert ("all", "本论") in scopes and ("file", "本论") not in scopes


def test_scores(make):
    catalog = make([("o/abc", "xxabcx", "", ["abc"], None, False)])
    index_ = plans.build_index(catalog)
    assert plans.search(catalog, index_, q="abc*", exact=True).rows.first().score == 6
    rows = plans.search(catalog, index_, q="abc", exact=True, search_folders=False).rows
    assert rows.first().score == 4


def test_extension_is_never_searched(make):
    catalog = make([("o/r", "foo", "pdf", [], None, False), ("o/r", "foo.pdf x", "", [], None, False)])
    assert [r.ord for r in plans.search(catalog, None, q="foo.pdf").rows.collect()] == [1]


def test_name_sort_puts_han_by_pinyin_before_latin(make):
    names = ["b", "资", "A", "本", "a", "论"]
    catalog = make([("r", n, "", [], None, False) for n in names])
    rows = plans.search(catalog, None, q="", sort="name").rows.orderBy("position").collect()
    assert [r.file for r in rows] == ["本", "论", "资", "a", "A", "b"]


def test_near_terms_finds_every_pair(spark):
    """The join keys miss no pair within two edits, for all short and some long strings."""
    pick = random.Random(3)
    strings = {a + b + c for a in ["", *"abc"] for b in ["", *"ab"] for c in "abx"}
    strings |= {"".join(pick.choice("abc") for _ in range(pick.randint(3, 9))) for _ in range(150)}
    strings |= {"资", "资本", "本资", "论"}
    strings = sorted(strings)
    vocab = spark.createDataFrame(
        [("all", s, 1, i, 0) for i, s in enumerate(strings)],
        "scope string, token string, df bigint, first_ord bigint, first_pos int",
    )
    asked = [s for s in strings if len(s) > 2][:80] + ["a", "ab", "资", "zz", "abcabcabc"]
    tokens = spark.createDataFrame([("all", s) for s in set(asked)], "scope string, token string")
    got = {(r.token, r.term) for r in fuzzy.near_terms(tokens, vocab).collect()}
    wanted = {(t, s) for t in asked for s in strings if brute.distance(t, s) <= 2}
    assert got == wanted


def test_fuzzy_cap_keeps_the_crossing_term(spark):
    counts = {"rings": 150, "ringo": 49, "ringy": 1, "sring": 5, "bring": 4}
    vocab = spark.createDataFrame(
        [("all", t, n, i, 0) for i, (t, n) in enumerate(counts.items())],
        "scope string, token string, df bigint, first_ord bigint, first_pos int",
    )
    tokens = spark.createDataFrame([("all", "ring")], "scope string, token string")
    used = fuzzy.fuzzy_terms(tokens, vocab).orderBy("term_pos").collect()
    assert [(r.term, r.term_pos) for r in used] == [("rings", 0), ("ringo", 1), ("sring", 2)]


def test_batch_needs_unique_query_ids(spark, make):
    catalog = make([("o/a", "f", "pdf", [], 1, False)])
    fields = [f.split()[0] for f in QUERY.split(", ")]
    for ids in ((1, 1), (1, None)):
        rows = [tuple({"query_id": i, "q": "f"}.get(f) for f in fields) for i in ids]
        with pytest.raises(ValueError, match="unique"):
            plans.search_batch(catalog, plans.build_index(catalog), spark.createDataFrame(rows, QUERY))
