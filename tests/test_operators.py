import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from catalogspark.operators import catalog as cat
from catalogspark.operators import facets, ranking, sampling, tree

SEP = "\x1f"


def rows(n=300, seed=5):
    pick = random.Random(seed)
    out = []
    for _ in range(n):
        folder = [pick.choice("ab") for _ in range(pick.randint(0, 3))]
        out.append((
            pick.choice(["o/x", "o/x", "o/y"]), pick.choice(["f", "g", "h"]),
            pick.choice(["pdf", "PDF", "zip", "qqq", ""]), folder,
            pick.choice([None, 0, 7, 2000]), pick.random() < 0.3,
        ))
    return out


ROWS = rows()


@pytest.fixture(scope="module")
def catalog(make):
    return make(ROWS).cache()


@pytest.mark.parametrize("span", [1, 7, 1 << 20])
def test_record_ids_whatever_the_range_width(catalog, span):
    seen, wanted = Counter(), {}
    for i, (repo, file, ext, folder, _, _) in enumerate(ROWS):
        key = (repo, "/".join(folder), file, ext)
        wanted[i] = SEP.join([repo, "/".join([*folder, file, ext]), str(seen[key])])
        seen[key] += 1
    got = {r.ord: r.record_id for r in cat.with_record_id(catalog, span=span).collect()}
    assert got == wanted


def test_identical_records(make):
    ids = cat.with_record_id(make([("r", "f", "e", [], 1, False)] * 2)).orderBy("ord").collect()
    assert [r.record_id for r in ids] == [f"r{SEP}f/e{SEP}0", f"r{SEP}f/e{SEP}1"]


def test_sorted_positions(catalog):
    placed = ranking.sorted_position(catalog, [F.desc(F.coalesce("size", F.lit(0))), F.asc("ord")], "p")
    wanted = sorted(range(len(ROWS)), key=lambda i: (-(ROWS[i][4] or 0), i))
    assert [r.ord for r in placed.orderBy("p").collect()] == wanted
    assert sorted(r.p for r in placed.collect()) == list(range(1, len(ROWS) + 1))
    grouped = ranking.sorted_position_in_group(catalog, ["repo"], ["file", "ord"], "p")
    for repo in ("o/x", "o/y"):
        got = grouped.filter(F.col("repo") == repo).orderBy("p").collect()
        mine = [i for i, r in enumerate(ROWS) if r[0] == repo]
        assert [r.ord for r in got] == sorted(mine, key=lambda i: (ROWS[i][1], i))
        assert [r.p for r in got] == list(range(1, len(mine) + 1))


@pytest.mark.parametrize("value", [0.0, 0.31, 0.999, 1.0, -2.0])
@pytest.mark.parametrize("span", [4, 1 << 20])
def test_random_record(catalog, value, span):
    for repo, txt in (("", False), ("o/y", False), ("", True), ("o/x", True)):
        fits = [i for i, r in enumerate(ROWS) if (not repo or r[0] == repo) and (not txt or r[5])]
        wanted = fits[min(len(fits) - 1, int(max(0, value) * len(fits)))]
        got = sampling.random_record(catalog, repo, txt, value, span).collect()
        assert [r.ord for r in got] == [wanted]


def test_random_record_other_forms(catalog):
    assert sampling.random_record(catalog, "none", value=0.5).count() == 0
    assert sampling.random_record(catalog).count() == 1
    got = {r.repo: r.ord for r in sampling.random_record_per_repo(catalog, 1.0, span=16).collect()}
    assert got == {repo: max(i for i, r in enumerate(ROWS) if r[0] == repo) for repo in ("o/x", "o/y")}


def test_facets(catalog):
    cube = facets.facet_cube(catalog)
    assert {(r.repo, r["count"]) for r in facets.repo_facet(cube).collect()} == set(
        Counter(r[0] for r in ROWS).items()
    )
    exts = Counter(r[2].lower() for r in ROWS if r[2])
    assert [(r.ext, r["count"]) for r in facets.extension_facet(cube).collect()] == sorted(exts.items())
    both = Counter((r[0], r[2].lower()) for r in ROWS if r[2])
    got = {(r.repo, r.ext): r["count"] for r in facets.extension_by_repo_facet(cube).collect()}
    assert got == dict(both)
    texts = {r.repo: r["count"] for r in facets.text_facet(cube).collect()}
    assert texts == {None: sum(r[5] for r in ROWS), **Counter(r[0] for r in ROWS if r[5])}
    meta = {(r.facet, r.repo, r.name): r["count"] for r in facets.corpus_metadata(cube).collect()}
    assert meta.pop(("total", None, None)) == len(ROWS)
    assert {k[1]: n for k, n in meta.items() if k[0] == "text"} == texts
    assert {k[2]: n for k, n in meta.items() if k[0] == "extension"} == exts
    assert {k[1:]: n for k, n in meta.items() if k[0] == "extension_by_repo"} == both


def test_facets_of_nothing(catalog):
    cube = facets.facet_cube(catalog.filter("false"))
    text = facets.text_facet(cube).collect()
    assert [(r.repo, r["count"], r.available) for r in text] == [(None, 0, False)]
    zero = [(r.facet, r.repo, r.name, r["count"]) for r in facets.corpus_metadata(cube).collect()]
    assert sorted(zero) == [("text", None, None, 0), ("total", None, None, 0)]


def test_extension_panel(spark):
    counted = spark.createDataFrame([("zzz", 3), ("pdf", 5), ("aaa", 2), ("epub", 1)], "ext string, count bigint")
    chosen = spark.createDataFrame([("txt",), ("pdf",), ("bbb",), ("",)], "ext string")
    got = [(r.kind, r.ext, r.kinds, r["count"]) for r in facets.extension_panel(counted, chosen).collect()]
    assert got == [
        ("known", "pdf", 1, 5), ("known", "txt", 1, 0), ("known", "epub", 1, 1),
        ("other", None, 3, 5),
        ("other_child", "aaa", 1, 2), ("other_child", "bbb", 1, 0), ("other_child", "zzz", 1, 3),
    ]
    plain = facets.extension_panel(counted.filter("ext = 'pdf'"), chosen.filter("false"))
    assert [r.kind for r in plain.collect()] == ["known"]
    left = facets.facet_complement(counted, chosen, "ext").collect()
    assert {r.ext for r in left} == {"zzz", "aaa", "epub"}


def brute_tree(repo):
    nodes = {}
    for r, _, _, folder, _, _ in ROWS:
        if r != repo:
            continue
        for d in range(len(folder) + 1):
            node = nodes.setdefault("/".join(folder[:d]), [0, False, False])
            node[0] += 1
            node[1] |= d == len(folder)
            node[2] |= d < len(folder)
    return {p: tuple(n) for p, n in nodes.items()}


def test_folder_tree(catalog):
    nodes = tree.folder_tree(tree.folder_counts(catalog)).cache()
    for repo in ("o/x", "o/y"):
        got = {
            r.path: (r["count"], r.has_direct_files, r.has_children)
            for r in nodes.filter(F.col("repo") == repo).collect()
        }
        assert got == brute_tree(repo)
    root = nodes.filter("repo = 'o/y' AND is_root").first()
    assert (root.name, root.depth, root.parent_path, root.show_self_toggle) == ("y", 0, None, False)


def test_worked_tree(make):
    nodes = tree.folder_tree(tree.folder_counts(make([
        ("o/r", "f", "", [], None, False), ("o/r", "f", "", ["a"], None, False),
        ("o/r", "f", "", ["a", "b"], None, False),
    ])))
    got = {r.path: (r["count"], r.has_direct_files, r.has_children, r.show_self_toggle) for r in nodes.collect()}
    assert got == {"": (3, True, True, False), "a": (2, True, True, True), "a/b": (1, True, False, False)}


@pytest.mark.parametrize("path", ["", "/a/", "a/b", "none"])
def test_folder_contents(catalog, path):
    parts = [p for p in path.split("/") if p]
    n = len(parts)
    here = [(i, r) for i, r in enumerate(ROWS) if r[0] == "o/x" and r[3][:n] == parts]
    below = Counter(r[3][n] for _, r in here if len(r[3]) > n)
    folders, files = tree.folder_contents(catalog, "o/x", path)
    assert [(r.name, r.path, r["count"]) for r in folders.collect()] == [
        (name, "/".join([*parts, name]), below[name]) for name in sorted(below)
    ]
    direct = sorted((r[1], i) for i, r in here if len(r[3]) == n)
    assert [(r.name, r.ord) for r in files.collect()] == direct
    entries = tree.listing_entries(catalog).filter((F.col("repo") == "o/x") & (F.col("path") == "/".join(parts)))
    assert entries.count() == len(below) + len(direct)


def test_path_choices(catalog, spark):
    nodes = tree.folder_tree(tree.folder_counts(catalog))
    chosen = spark.createDataFrame([("o/x", "subtree", "a")], "repo string, kind string, path string")
    left = {(r.repo, r.kind, r.path) for r in tree.path_complement(nodes, chosen).collect()}
    wanted = set()
    for repo in ("o/x", "o/y"):
        for p, (_, direct, _) in brute_tree(repo).items():
            if p:
                wanted.add((repo, "subtree", p))
                if direct:
                    wanted.add((repo, "self", p))
    assert left == wanted - {("o/x", "subtree", "a")}
    merged = spark.range(1).select(
        tree.merge_selection(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c"))).alias("m")
    )
    assert merged.first().m == ["a", "b", "c"]


def test_mixed_filter_by_table(catalog, spark):
    from catalogspark.functions.predicates import folder_mixed

    derived = cat.with_derived(catalog)
    paths = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    for own, below in ((["a", "/"], ["b/a/"]), ([], ["b"]), (["a/b"], []), ([""], [])):
        joined = tree.filter_mixed_by_table(derived, paths(*own), paths(*below))
        plain = derived.filter(folder_mixed(F.col("folder"), F.col("folder_path"), own, below))
        assert {r.ord for r in joined.collect()} == {r.ord for r in plain.collect()}
