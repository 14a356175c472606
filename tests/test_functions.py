import pytest
from pyspark.sql import functions as F

from catalogspark.functions import categories, links, paths, predicates, sizes, text
from catalogspark.functions.links import LinkTargets


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def lits(*values):
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


@pytest.mark.parametrize(
    "value, expected",
    [
        ("Das Kapital 资a本论 v1", ["das", "kapital", "a", "v1", "资", "本", "论", "资本", "本论"]),
        ("", []),
        (None, []),
        ("a-b_a", ["a", "b"]),
        ("资资资", ["资", "资资"]),
        ("éa", ["a"]),
        ("本", ["本"]),
    ],
)
def test_tokens(spark, value, expected):
    assert one(spark, t=text.tokens(F.lit(value).cast("string"))).t == expected


@pytest.mark.parametrize(
    "q, exact, mode",
    [
        ("", True, "all"), ("foo.pdf", False, "literal"), ("a*b", False, "wildcard"),
        ("a b", False, "token"), ("a b", True, "literal"), ("Ring", False, "token"),
        ("资本", False, "token"), ("资　本", False, "token"), ("é", False, "literal"),
        ("what?", True, "wildcard"),
    ],
)
def test_search_mode(spark, q, exact, mode):
    assert one(spark, m=text.search_mode(F.lit(q), F.lit(exact))).m == mode


def test_trim_covers_unicode_space(spark):
    assert one(spark, t=text.trim_space(F.lit("　 a b\t﻿"))).t == "a b"


@pytest.mark.parametrize(
    "pattern, value, hit",
    [
        ("a*b", "xaabbx", True), ("a?c", "xabcx", True), ("a?c", "ac", False), ("a.c*", "abc", False),
        ("a.c*", "A.C", True), ("(x)*", "(x)", True), ("a*b", "a\nb", False),
        ("[?]", "[q]", True), ("$*", "a$", True),
        ("**a**b**", "xaxbx", True), ("*", "", True), ("*?", "", False), ("a*", "\nba", True),
    ],
)
def test_wildcards(spark, pattern, value, hit):
    assert one(spark, h=F.rlike(F.lit(value), text.wildcard_pattern(F.lit(pattern)))).h is hit


@pytest.mark.parametrize(
    "value, query, expected",
    [
        ("Red ring", "ring", "Red <mark>ring</mark>"),
        ("a<b", "<", "a<mark>&lt;</mark>b"),
        ("mark", "ar r", "m<mark>a<mark>r</mark></mark>k".replace("<mark>a", "<ma<mark>r</mark>k>a")
         .replace("</mark></mark>", "</mark></ma<mark>r</mark>k>")),
        ("abc", "", "abc"),
        ("x$1y", "$1", "x<mark>$1</mark>y"),
    ],
)
def test_highlight(spark, value, query, expected):
    assert one(spark, h=text.highlight(F.lit(value), F.lit(query))).h == expected


def test_paths(spark):
    row = one(
        spark,
        rel=paths.relative_path(lits("a", "b"), F.lit("f"), F.lit("pdf")),
        bare=paths.relative_path(lits(), F.lit("f"), F.lit("")),
        anc=paths.ancestors(lits("a", "b")),
        none=paths.ancestors(lits()),
        crumb=paths.breadcrumb(lits("a", "b")),
        clean=paths.clean_path(F.lit("//a/b/")),
        blank=paths.clean_path(F.lit(None).cast("string")),
    )
    assert (row.rel, row.bare) == ("a/b/f.pdf", "f")
    assert row.anc == ["a", "a/b"] and row.none == []
    assert [tuple(c) for c in row.crumb] == [("a", "a"), ("b", "a/b")]
    assert (row.clean, row.blank) == ("a/b", "")


def test_links(spark):
    targets = LinkTargets("https://h.org/d", "h.org", "m.org", "https://t.org/txt")
    folder, file, ext = lits("a b", "c#d"), F.lit("x+y~(1)!'"), F.lit("pdf")
    row = one(
        spark,
        direct=links.direct_link(F.lit("o/r"), folder, file, ext, targets=targets),
        browse=links.browse_link(F.lit("o/r"), folder, file, ext, targets=targets),
        explicit=links.direct_link(F.lit("o/r"), folder, file, ext, F.lit("http://e"), targets),
        text=links.text_link(lits("v1.2"), F.lit("a&b"), F.lit(""), F.lit(True), targets),
        dotted=links.text_link(lits("v1.2"), F.lit("a"), F.lit("pdf"), F.lit(True), targets),
        notext=links.text_link(folder, file, ext, F.lit(False), targets),
        mirror=links.mirror_link(F.lit("https://h.org/d/o"), targets),
        other=links.mirror_link(F.lit("https://xh.org/d/o"), targets),
        longer=links.mirror_link(F.lit("https://h.org.evil/d"), targets),
        n1=links.browser_file_name(F.lit("a.PDF"), F.lit("pdf")),
        n2=links.browser_file_name(F.lit("a"), F.lit("pdf")),
        n3=links.browser_file_name(F.lit("a"), F.lit("")),
    )
    path = "a%20b/c%23d/x%2By~(1)!'.pdf"
    assert row.direct == f"https://h.org/d/o/r/resolve/main/{path}"
    assert row.browse == f"https://h.org/d/o/r/blob/main/{path}"
    assert row.explicit == "http://e"
    assert row.text == "https://t.org/txt/v1.2/a&b.txt"
    assert row.dotted == "https://t.org/txt/v1.2/a.txt"
    assert row.notext is None
    assert row.mirror == "https://m.org/d/o"
    assert row.other == "https://xh.org/d/o" and row.longer == "https://h.org.evil/d"
    assert (row.n1, row.n2, row.n3) == ("a.PDF", "a.pdf", "a")


@pytest.mark.parametrize(
    "size, human, compact",
    [
        (None, "", ("", "MB")), (0, "", ("", "MB")), (5, "5 B", ("5", "B")),
        (1280, "1.3 KB", ("1.3", "KB")), (2048, "2.0 KB", ("2", "KB")),
        (1572864, "1.5 MB", ("1.5", "MB")), (10 * 2**30, "10.00 GB", ("10", "GB")),
        (1610612736, "1.50 GB", ("1.5", "GB")),
    ],
)
def test_size_text(spark, size, human, compact):
    column = F.lit(size).cast("bigint")
    row = one(spark, h=sizes.human_size(column), c=sizes.compact_size(column))
    assert row.h == human and tuple(row.c) == compact


@pytest.mark.parametrize(
    "value, expected",
    [
        ("1.5MB", 1572864), ("0", 0), ("abc", None), ("", None), (None, None), ("12 kb", 12288),
        ("7", 7), ("1.2.3", 1), ("-5x", -5), ("0x", None), ("3 apples", 3), ("2gb", 2147483648),
        (".", None), ("1.5", 2),
    ],
)
def test_parse_size(spark, value, expected):
    assert one(spark, p=sizes.parse_size(F.lit(value).cast("string"))).p == expected


def test_size_from_input(spark):
    row = one(
        spark,
        ok=sizes.size_from_input(F.lit("1.5"), F.lit("KB")),
        negative=sizes.size_from_input(F.lit("-1"), F.lit("KB")),
        text=sizes.size_from_input(F.lit("x"), F.lit("KB")),
        nan=sizes.size_from_input(F.lit("NaN"), F.lit("KB")),
    )
    assert (row.ok, row.negative, row.text, row.nan) == (1536, None, None, None)


def test_category(spark):
    row = one(
        spark, a=categories.file_category(F.lit("PDF")), b=categories.file_category(F.lit("zzz")),
        c=categories.file_category(F.lit("")), d=categories.file_category(F.lit("m4a")),
    )
    assert (row.a, row.b, row.c, row.d) == ("pdf", "file", "file", "audio")


FOLDER_CASES = [
    ("", ["/a/b/"], ["a/b", "a/b/c"]),
    ("", [""], [""]),
    ("exact", ["a/b/"], ["a/b"]),
    ("exact", ["/"], [""]),
    ("", [], ["", "a", "a/b", "a/b/c", "a/bc"]),
    ("", ["a/bc", "/"], ["", "a/bc"]),
]


@pytest.mark.parametrize("mode, folders, expected", FOLDER_CASES)
@pytest.mark.parametrize("as_column", [False, True])
def test_folder_filters(spark, mode, folders, expected, as_column):
    rows = spark.createDataFrame([("",), ("a",), ("a/b",), ("a/b/c",), ("a/bc",)], "p string")
    arg = lits(*folders) if as_column else folders
    kind = F.lit(mode) if as_column else mode
    none = F.lit(None).cast("array<string>") if as_column else None
    kept = rows.filter(
        predicates.folder_filter(paths.split_path(F.col("p")), F.col("p"), kind, arg, none, none)
    )
    assert sorted(r.p for r in kept.collect()) == sorted(expected)


@pytest.mark.parametrize(
    "selfs, subtrees, expected",
    [
        (["a"], [], ["a"]), ([], ["/a/b"], ["a/b", "a/b/c"]), (["", "/"], [], ["", "a", "a/b", "a/b/c", "a/bc"]),
        (["a/bc"], ["a/b/c"], ["a/b/c", "a/bc"]),
    ],
)
@pytest.mark.parametrize("as_column", [False, True])
def test_mixed_filter(spark, selfs, subtrees, expected, as_column):
    rows = spark.createDataFrame([("",), ("a",), ("a/b",), ("a/b/c",), ("a/bc",)], "p string")
    args = (lits(*selfs), lits(*subtrees)) if as_column else (selfs, subtrees)
    kept = rows.filter(predicates.folder_mixed(paths.split_path(F.col("p")), F.col("p"), *args))
    assert sorted(r.p for r in kept.collect()) == sorted(expected)


def test_repo_extension_size(spark):
    rows = spark.createDataFrame(
        [("o/a", "PDF", 5), ("o/a", "", None), ("o/b", "txt", 0), ("o/b", "pdf", 50)],
        "repo string, ext string, size bigint",
    )
    for lift in (lambda v: v, lambda v: lits(*v)):
        assert rows.filter(predicates.repo_in(F.col("repo"), lift(["o/a"]))).count() == 2
        assert rows.filter(predicates.extension_in(F.col("ext"), lift(["pdf"]))).count() == 2
        assert rows.filter(predicates.extension_in(F.col("ext"), lift(["PDF"]))).count() == 0
        assert rows.filter(predicates.extension_in(F.col("ext"), lift(["pdf", "txt"]))).count() == 3
    assert rows.filter(predicates.size_between(F.col("size"), 1, None)).count() == 4
    assert rows.filter(predicates.size_between(F.col("size"), 10, 49)).count() == 2
    assert rows.filter(predicates.size_between(F.col("size"), F.lit(10), F.lit(None).cast("bigint"))).count() == 3
    short = one(spark, r=predicates.qualify_repos(lits("x", "o/y"), "me"))
    assert short.r == ["me/x", "o/y"]
