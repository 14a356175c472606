"""Blocked postings, bitmaps and folder intervals: same answers as scans, fewer rows read."""

import random

import brute
import pytest
from pyspark.sql import functions as F
from test_plans import PAIRWISE, plan
from test_search import QUERIES, ROWS

from catalogspark.operators import bitmaps, blocks, intervals
from catalogspark.plans import publish, search


@pytest.fixture(scope="module")
def catalog(make):
    return make(ROWS).cache()


@pytest.fixture(scope="module")
def built(catalog):
    return search.build_index(catalog, blocks=True)


def answer(result):
    rows = result.rows.orderBy("position").collect()
    return result.totals.first().total, [(r.ord, r.score) for r in rows]


@pytest.mark.parametrize("k", range(0, len(QUERIES), 2))
def test_search_by_blocks_matches_brute_force(catalog, built, k):
    assert answer(search.search(catalog, built, **QUERIES[k])) == brute.search(ROWS, **QUERIES[k]), QUERIES[k]


@pytest.mark.parametrize("limits", [(0, 0, 0), (1000, 0, 20), (1000, 10**6, 0)])
def test_every_way_of_reading_gives_the_same(catalog, built, monkeypatch, limits):
    """Too many blocks: scan; many ords: a join on block ranges."""
    monkeypatch.setattr(blocks, "LISTED_BLOCKS", limits[0])
    monkeypatch.setattr(search, "FETCHED_ORDS", limits[1])
    monkeypatch.setattr(search, "LISTED_ORDS", limits[2])
    for q in (dict(q="ring red"), dict(q="rng bolts"), dict(q="d r", exact=True), dict(q="wid*ear"), dict(q="qqq", exact=True)):
        assert answer(search.search(catalog, built, **q)) == brute.search(ROWS, **q), q


def test_dense_blocks_are_read_as_ranges(catalog, built, monkeypatch, capsys):
    monkeypatch.setattr(search, "LISTED_ORDS", 3)
    monkeypatch.setattr(search, "DENSE", 1 << 14)
    q = dict(q="d r", exact=True)
    result = search.search(catalog, built, **q)
    assert answer(result) == brute.search(ROWS, **q)
    assert "Join" not in plan(result.matched, capsys)


@pytest.mark.parametrize("span", [1, 7, 1 << 14])
def test_blocks_hold_all_postings(catalog, span):
    rows = blocks.blocked_postings(catalog, span=span).collect()
    got = {}
    for r in rows:
        assert r.ords == sorted(set(r.ords)) and (r.first_ord, r.last_ord, r.n) == (r.ords[0], r.ords[-1], len(r.ords))
        assert {o // span for o in r.ords} == {r.block}
        got.setdefault((r.scope, r.token), set()).update(r.ords)
    wanted = {}
    for deep, scope in ((True, "all"), (False, "file")):
        for token, ords in brute.index_of(ROWS, deep).items():
            wanted[scope, token] = set(ords)
    for i, (_, file, _, folder, _, _) in enumerate(ROWS):
        for text in (file.lower(), "/".join(folder).lower()):
            for at in range(len(text) - 2):
                wanted.setdefault(("gram", text[at:at + 3]), set()).add(i)
    assert got == wanted


def test_points_of_postings_are_those_of_a_search_in_the_fields(make, capsys):
    """Names hold their own tokens as they stand, except bigrams that jump; no name is searched once for each of its tokens."""
    rows = make([
        ("o/ring", "Ring 资x本论 ringed", "", ["ring ed", "资 本", "in"], 1, False), ("o/r", None, "", ["a b"], 1, False),
        ("in/本", "资 本", "", [], 1, False), ("q", "x", "", None, 1, False), ("k", "İx K2 ΑΣ", "", ["K2", "i"], 1, False),
    ])
    each = blocks.word_postings(rows)
    texts = {i: ((r.file or "").lower(), "/".join(r.folder or []).lower(), r.repo.lower()) for i, r in enumerate(rows.orderBy("ord").collect())}
    got = [tuple(r) for r in each.collect()]
    assert len(got) == len(set(got)) and {(s, t, o) for s, t, o, _ in got} == {
        (r.scope, r.token, r.ord) for r in search.build_index(rows).postings.collect()
    }
    for scope, token, ord_, points in got:
        file, folder, repo = texts[ord_]
        assert points == 3 * (token in file) + 2 * (scope == "all" and token in folder) + (token in repo), (scope, token, ord_)
    file_only = plan(blocks.word_postings(rows, ("file",)), capsys)
    assert "Contains(file_lc" not in file_only and "Contains(lower(file" not in file_only


def test_a_long_name_costs_no_more_than_its_length(make):
    """200,000 tokens in a name: one search of the name for each token would read 300 GB."""
    import time
    name = " ".join(f"t{i}" for i in range(200_000))
    rows = make([("o/r", name, "txt", ["f"], 1, False)])
    begun = time.time()
    assert blocks.word_postings(rows, ("file",)).agg(F.count("token"), F.min("points")).first() == (200_000, 3)
    assert time.time() - begun < 30


def test_frequent_tokens_with_few_common_records_read_few_blocks(make, spark, tmp_path, capsys):
    """Two tokens of 2,000 records each that share 3: their ranges meet in a few blocks, and no record is scanned."""
    rows = [("o/r", f"{'left' if i < 2000 else 'right'} n{i}" + (" right" if i in (77, 78, 1999) else ""), "pdf", [], 1, False) for i in range(4000)]
    stored = publish.blocked_postings(make(rows), span=16)
    path = str(tmp_path / "blocks")
    stored.repartitionByRange(8, "scope", "token", "block").sortWithinPartitions("scope", "token", "block").write.parquet(path)
    stored = spark.read.parquet(path)
    lists = [["left"], ["right"]]
    met = blocks.common_blocks(stored, "file", lists)
    assert sorted(r.block for r in met.collect()) == [77 // 16, 1999 // 16]
    text = plan(met, capsys)
    schemas = [line for line in text.splitlines() if "ReadSchema" in line]
    assert schemas and not any("ords" in line for line in schemas)
    assert any("PushedFilters" in line and "In(token" in line for line in text.splitlines())
    common = blocks.intersect(stored, "file", lists, [r.block for r in met.collect()])
    assert sorted(o for r in common.collect() for o in r.ords) == [77, 78, 1999]
    assert any("PushedFilters" in line and "block" in line for line in plan(common, capsys).splitlines())


@pytest.fixture(scope="module")
def published(make, spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("published"))
    rows = [(f"o/r{i % 3}", f"red ring {i} z{i * 7919 % 1000:03d}", "pdf", [f"a{i // 100}", f"b{i % 5}"], i, i % 2 == 0) for i in range(600)]
    # Small tables would be written as one file each.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        publish.publish(make(rows), root, 1)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    return rows, publish.read_published(spark, root, "catalog", 1), publish.read_index(spark, root, 1)


def scanned(text):
    return [line for line in text.splitlines() if "PushedFilters" in line]


@pytest.mark.parametrize("q", [dict(q="z23 ring", exact=True), dict(q="g 17 z", exact=True), dict(q="r?d*z613"), dict(q="red z613")])
def test_rare_pieces_become_ords_of_the_scan(published, capsys, q):
    rows, catalog, built = published
    result = search.search(catalog, built, **q)
    assert answer(result) == brute.search(rows, **q)
    text = plan(result.matched, capsys)
    if answer(result)[0]:
        assert all("ord" in line for line in scanned(text)) and not any(p in text for p in PAIRWISE)


def test_totals_of_tokens_read_no_records(published, capsys):
    _, catalog, built = published
    text = plan(search.search(catalog, built, q="red ring 17").totals, capsys)
    assert "FileScan" not in text and "Scan parquet" not in text


def test_text_of_a_repo_name_scans(published):
    rows, catalog, built = published
    q = dict(q="o/r1", exact=True, page_size=500)
    assert answer(search.search(catalog, built, **q)) == brute.search(rows, **q)


# --- bitmaps -----------------------------------------------------------------------


def plain_facets(rows, hits):
    counts = {}
    for i in hits:
        repo, _, ext, _, _, text = rows[i]
        for key in [("repo", repo), ("ext", ext.lower())] + [("text", "")] * text:
            counts[key] = counts.get(key, 0) + 1
    return counts


@pytest.mark.parametrize("q", [
    dict(q=""), dict(q="", repos=["o/a", "none"]), dict(q="", repos=["o/a", "red/c"], extensions=["pdf", "txt"], has_text=True),
    dict(q="red ring"), dict(q="rng", extensions=["epub"]), dict(q="qqqqqq"), dict(q="ring", has_text=True), dict(q="red", min_size=900),
    dict(q="d r", exact=True), dict(q="red", folders=["old"]),
])
def test_facets_of_hits(catalog, built, q):
    asked = {k: v for k, v in q.items() if k != "has_text"}
    wanted = [i for i in range(len(ROWS)) if not q.get("has_text") or ROWS[i][5]]
    hits = {i for page in range(1, 6) for i, _ in brute.search(ROWS, **asked, page=page, page_size=100)[1]}
    got = search.search_facets(catalog, built, **q).collect()
    assert {(r.facet, r["value"]): r["count"] for r in got} == plain_facets(ROWS, [i for i in wanted if i in hits])


def test_facets_of_a_filtered_search_read_no_records(published, capsys):
    _, catalog, built = published
    for q in (dict(q="", repos=["o/r1"]), dict(q="red 17", extensions=["pdf"])):
        text = plan(search.search_facets(catalog, built, **q), capsys)
        schemas = [line for line in text.splitlines() if "ReadSchema" in line]
        assert schemas and not any("file" in line or "size" in line for line in schemas)


def test_bitmaps_over_many_buckets(spark):
    """Ords around the borders of buckets, against sets."""
    rng = random.Random(4)
    ords = sorted({0, 1, 32767, 32768, 32769, 65535, 65536, 10**9} | {rng.randrange(200_000) for _ in range(500)})
    rows = [(o, rng.choice("ab"), rng.choice(["x", "Y", None]), rng.random() < 0.5) for o in ords]
    stored = bitmaps.facet_bitmaps(spark.createDataFrame(rows, "ord bigint, repo string, ext string, has_txt boolean")).cache()
    for repos, exts, text in ((None, None, False), (["a"], None, True), (["a", "b"], ["y"], False), (["b"], ["x", ""], True)):
        wanted = [
            o for o, r, e, t in rows
            if (not repos or r in repos) and (not exts or (e or "").lower() in exts) and (t or not text)
        ]
        matched = bitmaps.matching_bitmaps(stored, None, repos, exts, text)
        assert sorted(r.ord for r in bitmaps.matched_ords(matched).collect()) == wanted
        assert bitmaps.matched_count(matched).first()["count"] == len(wanted)


# --- intervals of folders ----------------------------------------------------------


def test_intervals_are_the_subtrees(make):
    folders = [["a"], ["a", "b"], ["a", "b", "c"], ["a b"], ["a-b", "x"], ["a", "z"], [], ["b"], ["A"], ["论", "a"], ["a", ""], ["a!"]]
    rows = [("o/r", f"f{i}", "", f, 1, False) for i, f in enumerate(folders)]
    numbers = {r.path: (r["first"], r["last"]) for r in intervals.folder_numbers(make(rows)).collect()}
    paths = set(numbers)
    assert sorted(n for n, _ in numbers.values()) == list(range(1, len(paths) + 1))
    for p, (first, last) in numbers.items():
        below = {o for o in paths if p == "" or o == p or o.startswith(p + "/")}
        assert {o for o, (n, _) in numbers.items() if first <= n <= last} == below


@pytest.mark.parametrize("q", [
    dict(folders=["old"]), dict(folders=["/"]), dict(folders=["old/new", "", "none"], folder_match_mode="exact"), dict(folders=["none"]),
    dict(folder_match_mode="mixed", folder_selfs=["old"], folder_subtrees=["new/red", ""]), dict(folder_match_mode="mixed", folder_selfs=[""]),
    dict(folders=["new", "red"], repos=["o/a"], min_size=10),
])
def test_folder_filters_by_range(catalog, built, q):
    assert answer(search.search(catalog, built, q="", page_size=500, **q)) == brute.search(ROWS, q="", page_size=500, **q)


def test_a_subtree_is_a_range_of_few_files(published, capsys):
    rows, catalog, built = published
    found = search.search(catalog, built, q="", folders=["a3"]).matched
    assert found.count() == 100
    assert any("folder_no" in line for line in scanned(plan(found, capsys)))
    first, last = built.folder_numbers.filter("path = 'a3'").select("first", "last").first()
    files = built.by_folder.select(F.col("_metadata.file_path").alias("f"), "folder_no")
    holding = files.filter(F.col("folder_no").between(first, last)).select("f").distinct().count()
    assert holding < files.select("f").distinct().count()


def test_folder_listing(make):
    from catalogspark.operators import tree

    rows = [("o/r", f"f{i}", "pdf", f, i, True) for i, f in enumerate([["a"], ["a", "b"], ["a", "c"], ["a", "c"], [], ["d"], ["a", "b", "e"]])]
    rows += [("o/s", "g", "pdf", ["a", "b"], 1, True)]
    catalog = make(rows)
    numbers = intervals.folder_numbers(catalog)
    for path in ("", "a", "a/b", "none"):
        for got, wanted in zip(intervals.folder_listing(intervals.with_folder_number(catalog, numbers), numbers, "o/r", path), tree.folder_contents(catalog, "o/r", path)):
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.collect()))


# --- rank and select ---------------------------------------------------------------


@pytest.mark.parametrize("q", [
    dict(repos=["o/a", "red/c"], page=2, page_size=30), dict(extensions=["pdf"], page=1, page_size=500), dict(repos=["o/b"], extensions=["txt", "epub"], page_size=7),
    dict(repos=["none"]), dict(extensions=["pdf"], page=99), dict(repos=["o/a"], sort="size", page=3, page_size=20),
])
def test_filtered_listings_by_rank(catalog, built, q):
    assert answer(search.search(catalog, built, q="", **q)) == brute.search(ROWS, q="", **q)


def test_a_deep_filtered_page_reads_its_ords(published, capsys):
    rows, catalog, built = published
    q = dict(q="", repos=["o/r0", "o/r2"], extensions=["pdf"], page=19, page_size=20)
    result = search.search(catalog, built, **q)
    assert answer(result) == brute.search(rows, **q)
    assert all("ord" in line for line in scanned(plan(result.rows, capsys)))
    schemas = [line for line in plan(result.totals, capsys).splitlines() if "ReadSchema" in line]
    assert schemas and not any("file" in line for line in schemas)


@pytest.mark.parametrize("sort", ["relevance", "name", "size"])
def test_browsing_a_repo_uses_its_prepared_order(published, capsys, sort):
    rows, catalog, built = published
    q = dict(q="", repos=["o/r1"], sort=sort, page=3, page_size=15)
    result = search.search(catalog, built, **q)
    assert answer(result) == brute.search(rows, **q)
    assert all("ord" in line for line in scanned(plan(result.rows, capsys)) if "file" in line)


def test_random_records_by_bits(spark):
    from catalogspark.operators import sampling

    rng = random.Random(9)
    rows = [(o, rng.choice("abc"), "x", rng.random() < 0.3) for o in sorted(rng.sample(range(300_000), 900))]
    catalog = spark.createDataFrame(rows, "ord bigint, repo string, ext string, has_txt boolean").cache()
    stored = bitmaps.facet_bitmaps(catalog).cache()
    for value in (0.0, 0.37, 0.999, 1.0):
        wanted = {r.repo: r.ord for r in sampling.random_record_per_repo(catalog, value).collect()}
        assert {r.repo: r.ord for r in bitmaps.random_ord_per_repo(stored, value).collect()} == wanted
        for repo, text in (("", True), ("b", False), ("c", True), ("", False), ("none", False)):
            one = sampling.random_record(catalog, repo, text, value).select("ord").collect()
            assert bitmaps.random_ord(stored, value, repo, text).collect() == one


# --- best pages by bounds ----------------------------------------------------------


def test_bounds_are_the_best_scores(catalog, built):
    """The bound of a block is no less than the score of any record in it, and reached by single tokens."""
    for q in ("red", "ring red", "a1"):
        words_ = brute.toks(q)
        met = {r.block: r.bound for r in blocks.common_blocks(built.blocks, "all", [[w] for w in words_]).collect()}
        scores = [s for page in range(1, 4) for _, s in brute.search(ROWS, q=q, page=page)[1]]
        assert met[0] >= max(scores) and (len(words_) > 1 or met[0] == max(scores))


@pytest.mark.parametrize("span", [8, 64])
@pytest.mark.parametrize("q", [
    dict(q="red ring", page_size=10), dict(q="ring", page=3, page_size=20), dict(q="red", page_size=500), dict(q="ring red", min_size=300, page_size=5),
    dict(q="ring", repos=["red/r1"], page_size=7), dict(q="red", page=40, page_size=50),
])
def test_best_pages_read_few_blocks(make, monkeypatch, span, q):
    """Same page as a scan; blocks that cannot reach it are not read."""
    monkeypatch.setattr(blocks, "BLOCK_SPAN", span)
    monkeypatch.setattr(search, "LISTED_ORDS", 5)
    rng = random.Random(2)
    rows = [
        (rng.choice(["o/r", "red/r1"] if i % 97 == 0 else ["o/r"]), f"ring {i}" + (" red" if i % 3 else ""), "pdf",
         ["red"] if i % 3 == 0 or i in (500, 501) else [], i + 1, False) for i in range(700)
    ]
    catalog = make(rows)
    index = search.SearchIndex(*[getattr(search.build_index(catalog), n).cache() for n in ("postings", "vocab")],
                               blocks=blocks.blocked_postings(catalog, span=span).cache())
    read = []
    of_blocks = search._of_blocks
    monkeypatch.setattr(search, "_of_blocks", lambda *a: read.append(len(a[-1])) or of_blocks(*a))
    monkeypatch.setattr(search, "_in_ranges", lambda numbers, make=search._in_ranges: make(numbers, span))
    assert answer(search.search(catalog, index, **q)) == brute.search(rows, **q)
    if q == dict(q="red ring", page_size=10):
        # The first entry is the whole match, for the total; the others are rounds of the page.
        assert len(read) > 1 and sum(read[1:]) < read[0]
