"""Column functions against plain Python on random strings."""

import html
import random
import re
from urllib.parse import quote

import brute
import pytest
from pyspark.sql import functions as F

from catalogspark.functions import links, paths, sizes, text

ALPHABET = list("abAB01 .-_/\\*?+()[]{}^$|&<>\"'#%~!,;:@=éß资本论㐀　 \n") + ["ab", "red"]


@pytest.fixture(scope="module")
def strings(spark):
    pick = random.Random(11)
    rows = ["".join(pick.choice(ALPHABET) for _ in range(pick.randint(0, 12))) for _ in range(600)]
    pairs = [(i, s, pick.choice(rows)) for i, s in enumerate(rows)]
    return pairs, spark.createDataFrame(pairs, "i int, s string, other string").cache()


def results(df, column):
    return {r.i: r.v for r in df.select("i", column.alias("v")).collect()}


def test_tokens(strings):
    pairs, df = strings
    got = results(df, text.tokens(F.col("s")))
    assert got == {i: brute.toks(s) for i, s, _ in pairs}


def test_encoding(strings):
    pairs, df = strings
    got = results(df, links.encode_path(F.col("s")))
    assert got == {i: "/".join(quote(p, safe="!~*'()-_.") for p in s.split("/")) for i, s, _ in pairs}
    got = results(df, links.encode_uri(F.col("s")))
    assert got == {i: quote(s, safe="!~*'()-_.;,/?:@&=+$#") for i, s, _ in pairs}


def test_wildcards(strings):
    pairs, df = strings
    got = results(df, F.rlike(F.lower("other"), text.wildcard_pattern(F.col("s"))))
    for i, s, other in pairs:
        body = "".join({"*": "[^\n\r]*", "?": "[^\n\r]"}.get(c, re.escape(c)) for c in s)
        assert got[i] == bool(re.search(body, other.lower(), re.I)), (s, other)


def test_highlight(strings):
    pairs, df = strings
    got = results(df, text.highlight(F.col("s"), F.col("other")))
    escape = lambda t: html.escape(t).replace("&#x27;", "&#39;")
    for i, s, other in pairs:
        want = escape(s)
        for term in [t for t in re.split(r"[\s﻿]+", other) if t]:
            want = re.sub("(" + re.escape(escape(term)) + ")", r"<mark>\1</mark>", want, flags=re.I)
        assert got[i] == want, (s, other)


def test_paths(strings):
    pairs, df = strings
    assert results(df, paths.clean_path(F.col("s"))) == {i: s.strip("/") for i, s, _ in pairs}
    got = results(df, paths.ancestors(paths.split_path(F.col("s"))))
    for i, s, _ in pairs:
        parts = s.split("/") if s else []
        assert got[i] == ["/".join(parts[: d + 1]) for d in range(len(parts))]


def test_human_sizes(spark):
    pick = random.Random(2)
    values = [pick.randrange(2 ** pick.randint(1, 45)) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(values)), "i int, n bigint")
    got = results(df, sizes.human_size(F.col("n")))
    for i, n in enumerate(values):
        if n == 0:
            want = ""
        elif n < 1024:
            want = f"{n} B"
        else:
            unit, scale, digits = next(u for u in (("KB", 2**10, 1), ("MB", 2**20, 1), ("GB", 2**30, 2)) if n < u[1] * 1024 or u[0] == "GB")
            tens = (n * 10**digits * 2 + scale) // (2 * scale)  # half up, in integers
            want = f"{tens // 10**digits}.{tens % 10**digits:0{digits}d} {unit}"
        assert got[i] == want, n
