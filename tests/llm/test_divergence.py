import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from catalogspark.llm import divergence

SCALE = 10**9


def plain(rows, min_docs=3, top=200):
    """The contract, term by term, in Python whole numbers."""
    counts, docs, groups = {}, {}, set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        found = Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low))
        counts.setdefault((lang, source), Counter()).update(found)
        docs.setdefault(lang, Counter()).update(found.keys())
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs.get(lang, {}).items() if n >= min_docs]
        sources = sorted(s for of, s in groups if of == lang)

        def shares(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + SCALE * (count[t] + 1) // (total + len(kept)) for t in kept}

        own = {s: shares(counts[lang, s]) for s in sources}
        whole = shares(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(sum((own[s][t] - own[o][t]) ** 2 // own[o][t] for t in kept), o) for o in sources if o != s]
            terms = [
                ((own[s][t] - whole[t]) ** 2 // whole[t], t) for t in kept if counts[lang, s][t] and own[s][t] > whole[t]
            ]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i) for i, (value, item) in enumerate(found[:most], 1)]
    return sorted(out)


def asked(docs, **kw):
    return sorted(tuple(r) for r in divergence.divergence(docs, **kw).select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize("top", [200, 3])
def test_equals_the_contract(spark, corpus, top):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    rows = [tuple(r) for r in docs.select("text", "lang", "source").collect()]
    assert asked(docs, top=top) == plain(rows, top=top)


def test_odd_rows(odd, clashing):
    rows = [tuple(r) for r in odd.select("text", "lang", "source").collect()]
    wanted = plain(rows)
    assert asked(odd) == wanted and asked(clashing) == wanted
    assert any(r[0] == "" for r in wanted)


def test_ties_cut_at_the_last_rank(spark):
    """Many terms of one value: those that come first in UTF-8 order stay."""
    text = " ".join(f"t{a}{b}é" for a in "abcdefghij" for b in "klmnopqrst")
    rows = [(text, "x", "a"), (text.upper(), "x", "a"), (text, "x", "a"), ("other words", "x", "b"), (None, "x", "c")]
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    for top in (7, 99, 200):
        assert asked(docs, top=top) == plain(rows, top=top)


def test_language_without_kept_terms(spark):
    docs = spark.createDataFrame([("once", "x", "a"), (None, "x", "b"), ("", None, None)], "text string, lang string, source string")
    assert asked(docs) == [("x", "a", "pair", "b", 0, 1), ("x", "b", "pair", "a", 0, 1)]


def test_no_documents(no_docs):
    assert asked(no_docs) == []


def test_shares_of_large_counts_are_exact(spark):
    big = 1 << 40
    row = spark.createDataFrame([(big, 3 * big, 12345)], "n bigint, total bigint, v bigint")
    got = row.select(F.expr(divergence._share("n", "total", "v"))).first()[0]
    assert got == 1 + SCALE * (big + 1) // (3 * big + 12345)


def test_partitioning_does_not_matter(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    assert asked(docs.repartition(1)) == asked(docs.repartition(9))


def test_terms_are_split_not_matched_one_by_one(spark, capsys):
    """Same terms as the pattern of the contract, without a match object for each of them."""
    import random
    rng = random.Random(11)
    signs = [chr(i) for i in range(128)] + list("éÉßİΣ字😀\u00a0\u2028\x85")
    texts = ["", " ", "a", "A b", ".a.", "\x00É\x7fZ", None, *["".join(rng.choices(signs, k=rng.randint(1, 60))) for _ in range(300)]]
    counted = divergence.term_counts(spark.createDataFrame([("x", "s", t) for t in texts], "lang string, source string, text string"))
    n, n_docs = Counter(), Counter()
    for t in texts:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        n.update(found)
        n_docs.update(set(found))
    assert {r.term: (r.n, r.n_docs) for r in counted.collect()} == {t: (n[t], n_docs[t]) for t in n}
    counted.explain()
    assert "regexp_extract_all" not in capsys.readouterr().out
