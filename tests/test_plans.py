"""Physical plans: what must, and must not, appear in them."""

import pytest
from pyspark.sql import functions as F

from catalogspark.operators import catalog as cat
from catalogspark.operators import fuzzy, index, tree
from catalogspark.plans import publish, search
from catalogspark.schema import QUERY
from catalogspark.streaming import recent

FIELDS = [f.split()[0] for f in QUERY.split(", ")]
PAIRWISE = ("CartesianProduct", "BroadcastNestedLoopJoin")


@pytest.fixture(scope="module")
def stored(make, spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("plans"))
    rows = [(f"o/r{i % 3}", f"red ring {i}", "pdf", ["a", f"b{i % 5}"], i, i % 2 == 0) for i in range(400)]
    publish.publish(make(rows), root, 1)
    return publish.read_published(spark, root, "catalog", 1), publish.read_index(spark, root, 1)


def plan(df, capsys):
    df.explain("formatted")
    return capsys.readouterr().out


def table(spark, *queries):
    return spark.createDataFrame([tuple({"query_id": i, **q}.get(f) for f in FIELDS) for i, q in enumerate(queries)], QUERY)


def test_single_query_filters_reach_the_scan(stored, capsys):
    catalog, _ = stored
    text = plan(search.search(catalog, q="ring", exact=True, repos=["o/r1"], min_size=5).rows, capsys)
    pushed = next(line for line in text.splitlines() if "PushedFilters" in line)
    assert "EqualTo(repo,o/r1)" in pushed and "GreaterThanOrEqual(size,5)" in pushed
    assert "TakeOrderedAndProject" in text and "Exchange" not in text
    assert not any(p in text for p in PAIRWISE)


def test_totals_read_only_what_they_test(stored, capsys):
    catalog, _ = stored
    text = plan(search.search(catalog, q="ring", exact=True, search_folders=False).totals, capsys)
    schema = next(line for line in text.splitlines() if "ReadSchema" in line)
    assert "size" not in schema and "record_id" not in schema


def test_rare_tokens_narrow_the_scan(stored, capsys):
    catalog, built = stored
    text = plan(search.search(catalog, built, q="red 17").matched, capsys)
    assert any("PushedFilters" in line and "ord" in line for line in text.splitlines())


@pytest.mark.parametrize("limit", [-1, 1_000_000])
def test_batches_join_by_equality_in_one_shuffle(spark, stored, capsys, limit):
    catalog, built = stored
    asked = table(spark, dict(q="red"), dict(q="rng 17"), dict(q="g 1", exact=True), dict(q="r*7"), dict(q=""))
    result = search.search_batch(catalog, built, asked, candidate_limit=limit)
    text = plan(result.rows, capsys)
    assert not any(p in text for p in PAIRWISE)
    # Rows past the page are dropped before and after the only shuffle of matches.
    assert text.count("WindowGroupLimit") >= 2
    assert "SortMergeJoin" not in text.split("(1)")[0]


def test_postings_need_no_shuffle(stored, capsys):
    catalog, _ = stored
    assert "Exchange" not in plan(index.postings(catalog), capsys)


def test_near_terms_join_by_equality(spark, stored, capsys):
    tokens = spark.createDataFrame([("all", "rng")], "scope string, token string")
    text = plan(fuzzy.near_terms(tokens, stored[1].vocab), capsys)
    assert not any(p in text for p in PAIRWISE)


def test_browse_is_a_range_read(stored, capsys):
    text = plan(publish.browse(stored[0], "name", page=2, page_size=10), capsys)
    assert "GreaterThanOrEqual(name_rank,11)" in text and "LessThanOrEqual(name_rank,20)" in text


def test_group_tops_are_cut_before_the_shuffle(spark, stored, capsys):
    assert "WindowGroupLimit" in plan(publish.first_pages(stored[0]), capsys)
    events = spark.createDataFrame([(1, "q")], "user_id long, q string").withColumn("ts", F.current_timestamp())
    assert "WindowGroupLimit" in plan(recent.recent_queries(events), capsys)


def test_copies_are_ranked_in_ord_ranges(stored, capsys):
    text = plan(cat.with_record_id(stored[0].drop("record_id", "occurrence")), capsys)
    windows = [line for line in text.splitlines() if "hashpartitioning(repo" in line]
    assert windows and any("_range" in line for line in windows)


def test_tree_aggregates_before_prefixes_multiply(stored, capsys):
    text = plan(tree.folder_tree(tree.folder_counts(stored[0])), capsys)
    tree_lines = [line.strip() for line in text.splitlines() if "Generate" in line or "HashAggregate" in line]
    first = next(i for i, line in enumerate(tree_lines) if "Generate" in line)
    assert sum("HashAggregate" in line for line in tree_lines[first:]) >= 2
