import datetime as dt
import glob
import gzip
import json
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F

from catalogspark.functions.links import direct_link
from catalogspark.operators.catalog import selected_links, with_record_id
from catalogspark.plans import publish, search
from catalogspark.sources.compact import SHARD_STRIDE, decode_compact, read_compact
from catalogspark.sources.snapshots import read_first_pages, read_repo_counts, read_root_listings
from catalogspark.streaming import recent

DOC = {
    "v": 2,
    "rp": ["o/a", "o/b"],
    "fd": [["x", "y"], [], ["", "z"], None],
    "rc": [
        [0, "f", "pdf", 0, 123, 1], [0, "f", "pdf", 0, 123, 1], [1, "g", "", 1, "", 0],
        [0, "short"], [9, "h", "TXT", 9, "77", ""], [None, None, None, None, 0, True],
        "not a record", [0, 5, 0, 2, None, "no"], ["0", "s", "x", -1, 7.0, [], "more"],
        [1, False, "e", 3, True, None],
    ],
}
BLANK = ("", "", "", [], None, False)
DECODED = [
    ("o/a", "f", "pdf", ["x", "y"], 123, True), ("o/a", "f", "pdf", ["x", "y"], 123, True),
    ("o/b", "g", "", [], None, False), BLANK, ("", "h", "TXT", [], None, False),
    ("", "", "", [], 0, True), BLANK, ("o/a", "5", "", ["z"], None, True),
    ("", "s", "x", [], 7, True), ("o/b", "", "e", [], None, False),
]


def store(path, doc):
    with gzip.open(path, "wt", encoding="utf8") as f:
        json.dump(doc, f, ensure_ascii=False)


def test_decode(spark, tmp_path):
    store(tmp_path / "c.json.gz", DOC)
    rows = decode_compact(read_compact(spark, str(tmp_path / "c.json.gz"))).orderBy("ord").collect()
    assert [r.ord for r in rows] == list(range(len(DECODED)))
    assert [(r.repo, r.file, r.ext, r.folder, r.size, r.has_txt) for r in rows] == DECODED


def test_shards_continue_the_order(spark, tmp_path):
    for i, name in enumerate(["p0", "p1"]):
        store(tmp_path / f"{name}.json.gz", {"v": 2, "rp": [f"r{i}"], "fd": [], "rc": [[0, "f", "", 0, 1, 0]] * 2})
    rows = decode_compact(read_compact(spark, str(tmp_path))).orderBy("ord").collect()
    assert [(r.ord, r.repo) for r in rows] == [
        (0, "r0"), (1, "r0"), (SHARD_STRIDE, "r1"), (SHARD_STRIDE + 1, "r1"),
    ]


@pytest.mark.parametrize(
    "body, code",
    [
        ('{"v":1,"rp":[],"fd":[],"rc":[[0,"f","",0,1,0]]}', "UNSUPPORTED_CORPUS"),
        ('{"v":2,"rp":[],"rc":[]}', "UNSUPPORTED_CORPUS"),
        ('{"v":2,"rp":[', "INVALID_CORPUS"),
        ('{"v":2,"rp":7,"fd":[],"rc":[]}', "CORPUS"),
    ],
)
def test_bad_corpora_fail(spark, tmp_path, body, code):
    (tmp_path / "c.json").write_text(body)
    with pytest.raises(Exception, match=code):
        decode_compact(read_compact(spark, str(tmp_path / "c.json"))).collect()


ROWS = [
    ("o/a", f"n{i % 7}", "pdf" if i % 2 else "", ["d", "e"][: i % 3], None if i % 5 == 0 else i, i % 4 == 0)
    for i in range(130)
] + [("o/b c", "x", "", [], 0, False), ("o/b c", "资", "txt", ["k"], 9, True)]


@pytest.fixture(scope="module")
def catalog(make):
    return make(ROWS).cache()


def test_first_page_round_trip(spark, catalog, tmp_path):
    publish.write_first_pages(catalog, str(tmp_path / "p"))
    rows = read_first_pages(spark, str(tmp_path / "p")).orderBy("row").collect()
    for mode, repo, mine in (
        ("global", None, ROWS), ("repo", "o/a", ROWS[:130]), ("repo", "o/b c", ROWS[130:]),
    ):
        got = [r for r in rows if (r.mode, r.page_repo) == (mode, repo)]
        assert [(r.repo, r.file, r.ext, r.folder, r.size, r.has_txt) for r in got] == mine[:100]
        assert {(r.total, r.page, r.page_size, r.sort) for r in got} == {(len(mine), 1, 100, "relevance")}
    files = glob.glob(str(tmp_path / "p/page_set=repo/*/*.json"))
    assert len(files) == 2 and json.load(open(files[0]))["version"] == 2


@pytest.mark.parametrize("entries", [10_000, 7])
def test_root_listing_round_trip(spark, catalog, tmp_path, entries, monkeypatch):
    docs = publish.root_listings(catalog, entries).orderBy("repo", "part").collect()
    mine = [d for d in docs if d.repo == "o/a"]
    assert [(f.n, f.c) for d in mine for f in d.folders] == [("d", 86)]
    direct = sorted((r[1], i) for i, r in enumerate(ROWS) if r[0] == "o/a" and not r[3])
    assert [f.n for d in mine for f in d.files] == [n for n, _ in direct]
    assert [f.s for d in mine for f in d.files] == [ROWS[i][4] for _, i in direct]
    assert max(len(d.folders) + len(d.files) for d in mine) <= entries
    if entries == 10_000:
        publish.write_root_listings(catalog, str(tmp_path / "l"))
        back = read_root_listings(spark, str(tmp_path / "l/repos")).filter("repo = 'o/b c'").first()
        assert [tuple(f) for f in back.folders] == [("k", "k", 1)]
        assert [tuple(f) for f in back.files] == [("x", "", False, 0)]
        counts = read_repo_counts(spark, str(tmp_path / "l/global")).collect()
        assert [(r.repo, r["count"]) for r in counts] == [("o/a", 130), ("o/b c", 2)]


def test_listing_normalisation(spark, tmp_path):
    (tmp_path / "l.json").write_text(json.dumps(
        {"repo": "o/r", "path": "", "folders": [{"n": "d"}], "files": [{"n": "f", "t": True}, {}]}
    ))
    row = read_root_listings(spark, str(tmp_path / "l.json"), "up").first()
    assert row.path == "up" and [tuple(f) for f in row.folders] == [("d", "up/d", 0)]
    assert [tuple(f) for f in row.files] == [("f", "", True, None), ("", "", False, None)]


def test_manifest_names_the_files_that_exist(spark, make, tmp_path):
    rows = [(repo, f"f{i}", "pdf", [], i, False) for i, repo in enumerate(["a/x", "b/x", "o/b c"] * 3)]
    pages = tmp_path / "pages"
    publish.write_first_pages(make(rows), str(pages))
    publish.write_manifest(spark, str(pages), "/data", str(tmp_path / "m"))
    urls = spark.read.json(str(tmp_path / "m")).first().urls
    # Equal short names are different documents.
    assert len(urls) == len(set(urls)) == 4
    for url in urls:
        assert url.startswith("/data/")
        assert (pages / unquote(url.removeprefix("/data/"))).is_file()
    parts = publish.manifest(spark, str(pages), "/data", 3).orderBy("part").collect()
    assert [len(p.urls) for p in parts] == [3, 1]


def test_manifest_of_listings_has_all_parts(spark, catalog, tmp_path):
    publish.write_root_listings(catalog, str(tmp_path / "l"))
    urls = [u for d in publish.manifest(spark, str(tmp_path / "l"), "/d").collect() for u in d.urls]
    written = [f for f in (tmp_path / "l").rglob("*.json")]
    assert len(urls) == len(written) and all((tmp_path / "l" / unquote(u.removeprefix("/d/"))).is_file() for u in urls)


def test_an_empty_corpus_is_a_generation(spark, catalog, tmp_path):
    root = str(tmp_path / "g")
    assert publish.replace_corpus(catalog, root) == 1
    assert publish.replace_corpus(catalog.filter("false"), root) == 2
    assert publish.latest_generation(spark, root) == 2
    facets = publish.read_published(spark, root, "facets", 2).collect()
    assert sorted((r.facet, r["count"]) for r in facets) == [("text", 0), ("total", 0)]
    # A claimed number is never written again, whether that attempt came to its end or not.
    publish._mark(spark, f"{root}/claimed/generation=3")
    assert publish.replace_corpus(catalog, root) == 4 and publish.latest_generation(spark, root) == 4
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        publish.publish(catalog, root, 4)


def test_pages_of_prepared_orders(spark, catalog, tmp_path):
    root = str(tmp_path / "g")
    publish.publish(catalog, root, 1)
    stored, entries = (publish.read_published(spark, root, t, 1) for t in ("catalog", "browse"))
    for sort in ("name", "size", "relevance"):
        for repo in ("", "o/a"):
            expected = [r.ord for r in publish.browse(stored, sort, repo, 2, 30).collect()]
            assert [r.ord for r in publish.browse_page(stored, entries, sort, repo, 2, 30).collect()] == expected


@pytest.mark.parametrize("sort", ["name", "size", "relevance"])
def test_unfiltered_search_reads_the_prepared_orders(spark, catalog, tmp_path, sort):
    publish.publish(catalog, str(tmp_path), 1)
    stored, index = publish.read_published(spark, str(tmp_path), "catalog", 1), publish.read_index(spark, str(tmp_path), 1)
    found = search.search(stored, index, q=" ", sort=sort, page=2, page_size=30)
    plain = search.search(catalog, None, q=" ", sort=sort, page=2, page_size=30)
    columns = ["position", "ord", "score", "repo", "file"]
    assert found.rows.select(*columns).orderBy("position").collect() == plain.rows.select(*columns).orderBy("position").collect()
    assert found.totals.collect() == plain.totals.collect()
    assert "Sort" not in found.rows._jdf.queryExecution().executedPlan().toString()


def test_stored_files_hold_disjoint_ranges(spark, make, tmp_path):
    """A page of a prepared order, and a list of ords, touch few files."""
    rows = [(f"o/{i % 7}", f"n{i * 37 % 1000}", "pdf", [], i * 13 % 997, False) for i in range(1000)]
    publish.publish(make(rows).repartition(4), str(tmp_path), 1)
    for table, column in (("catalog", "ord"), ("browse", "rank")):
        stored = publish.read_published(spark, str(tmp_path), table, 1)
        if table == "browse":
            stored = stored.filter("listing = 'name'")
        ranges = stored.groupBy(F.col("_metadata.file_path")).agg(F.min(column).alias("a"), F.max(column).alias("b"))
        spans = sorted((r.a, r.b) for r in ranges.collect())
        assert all(b < c for (_, b), (c, _) in zip(spans, spans[1:])), table


def test_selected_links(spark, catalog, tmp_path):
    known = with_record_id(catalog)
    ids = [r.record_id for r in known.filter("ord IN (131, 3)").collect()]
    chosen = spark.createDataFrame([(i,) for i in ids], "record_id string")
    link = direct_link(F.col("repo"), F.col("folder"), F.col("file"), F.col("ext"))
    export = selected_links(known, chosen, link)
    publish.write_links(export, str(tmp_path / "t"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "t")).collect()]
    assert sorted(lines) == sorted(r.link for r in export.collect()) and len(lines) == 2
    assert {r.filename for r in export.collect()} == {"n3.pdf", "资.txt"}


def test_generations(spark, catalog, tmp_path):
    root = str(tmp_path / "g")
    assert publish.latest_generation(spark, root) == 0
    assert publish.replace_corpus(catalog.filter("ord < 10"), root) == 1
    assert publish.replace_corpus(catalog, root) == 2
    assert publish.latest_generation(spark, root) == 2
    stored = publish.read_published(spark, root, "catalog", 2)
    assert {r.generation for r in stored.select("generation").distinct().collect()} == {2}
    index = publish.read_index(spark, root, 2)
    fresh = search.build_index(catalog)
    for q in ("n3", "n9", "d"):
        a = search.search(stored, index, q=q).rows.select("position", "ord", "score").collect()
        assert a == search.search(catalog, fresh, q=q).rows.select("position", "ord", "score").collect()
    assert publish.read_published(spark, root, "catalog", 1).count() == 10
    assert search.search(stored, index, q="n3").rows.first().generation == 2


@pytest.mark.parametrize("sort", ["name", "size", "relevance"])
@pytest.mark.parametrize("repo", ["", "o/a"])
def test_browse_equals_sorted_search(catalog, sort, repo):
    ranked = publish.with_browse_ranks(catalog).cache()
    for page in (1, 2, 5):
        a = [r.ord for r in publish.browse(ranked, sort, repo, page, 30).collect()]
        found = search.search(catalog, None, q="", sort=sort, repos=[repo] if repo else None, page=page, page_size=30)
        assert a == [r.ord for r in found.rows.orderBy("position").collect()]


def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=n)


EVENTS = [(u, day((i * 37) % 400), f"q{(i * u) % 31}" if i % 9 else "") for i in range(400) for u in (1, 2, 7)]


def move_to_front():
    lists = {}
    for user, ts, q in sorted(EVENTS, key=lambda e: e[1]):
        if q:
            mine = lists.setdefault(user, [])
            if q in mine:
                mine.remove(q)
            mine.insert(0, q)
            del mine[20:]
    return lists


def test_recent_queries(spark):
    events = spark.createDataFrame(EVENTS, "user_id long, ts timestamp, q string")
    got = {}
    for r in recent.recent_queries(events).orderBy("user_id", "rank").collect():
        got.setdefault(r.user_id, []).append(r.q)
    assert got == move_to_front()


def test_recent_queries_stream(spark, tmp_path):
    """Three late-arriving batches, a restart and a replayed batch equal the batch answer."""
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "user_id long, ts timestamp, q string"
    for n in (2, 0, 1):
        part = spark.createDataFrame(EVENTS[n::3], schema)
        part.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        query = recent.start_recent_queries(stream, out, state, availableNow=True)
        query.awaitTermination(120)
        assert query.exception() is None
    assert len(glob.glob(out + "/batch=*")) == 3
    wanted = recent.recent_queries(spark.createDataFrame(EVENTS, schema)).select("user_id", "rank", "q", "ts")
    key = lambda df: sorted(tuple(r) for r in df.select("user_id", "rank", "q", "ts").collect())
    assert key(recent.read_recent_queries(spark, out)) == key(wanted)
    small = str(tmp_path / "small")
    upto = recent.compact_recent_queries(spark, out, small)
    assert upto == 2
    assert key(recent.read_recent_queries(spark, out, compacted=small, upto=upto)) == key(wanted)
    late = [(1, day(900), "new"), (2, day(-5), "q3")]
    spark.createDataFrame(late, schema).coalesce(1).write.mode("append").parquet(source)
    again = recent.start_recent_queries(spark.readStream.schema(schema).parquet(source), out, state, availableNow=True)
    again.awaitTermination(120)
    more = recent.recent_queries(spark.createDataFrame(EVENTS + late, schema))
    assert key(recent.read_recent_queries(spark, out, compacted=small, upto=upto)) == key(more)
    assert recent.compact_recent_queries(spark, out, small + "2", compacted=small, upto=upto) == 3
