import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from catalogspark.llm import spelling


def plain_counts(rows, every=97, min_chars=5, min_count=3):
    counts = Counter()
    for doc, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[a-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            if len(run) >= min_chars:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= min_count}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    a, b = sorted((a, b), key=len)
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)):] == b[i + 1:]


def plain(counts):
    words = sorted(counts)
    near = {w: [] for w in words}
    by_size = {}
    for w in words:
        by_size.setdefault(len(w), []).append(w)
    for w in words:
        for size in (len(w) - 1, len(w), len(w) + 1):
            near[w] += [o for o in by_size.get(size, ()) if one_edit(w, o)]
    form = {}
    for w in words:
        best = min(near[w], key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
    out = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(near[w]), counts.get(form[w])))
    return out


def asked(docs, **kw):
    got = spelling.spelling_variants(docs, **kw).select("word", "form", "root", "n", "n_near", "form_n")
    return sorted((tuple(r) for r in got.collect()), key=lambda r: r[0])


def test_equals_brute_force(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    wanted = plain(plain_counts([tuple(r) for r in docs.select("doc_id", "text").collect()]))
    assert len(wanted) > 500 and sum(r[4] for r in wanted) > 100
    assert asked(docs) == wanted


@pytest.mark.parametrize("least", [0, 1, 1000])
def test_any_dictionary_finds_all_pairs(spark, monkeypatch, least):
    """Words of few letters with many repetitions, under dictionaries from full to empty."""
    rng = random.Random(least)
    words = {"".join(rng.choice("abé") for _ in range(rng.randrange(5, 10))) for _ in range(700)}
    words |= {"aaaaa", "aaaaaa", "aaaaaaa", "ababab", "bababa", "ÿÿÿÿÿ", "×÷×÷×"}
    words = sorted(words)
    monkeypatch.setattr(spelling, "gram_dictionary", lambda w, make=spelling.gram_dictionary: make(w, least))
    rows = [(w, 1 + i % 9) for i, w in enumerate(words)]
    got = {(r["word"], r["other"]) for r in spelling.near_pairs(spark.createDataFrame(rows, "word string, n bigint").repartition(3)).collect()}
    assert got == {(a, b) for a in words for b in words if one_edit(a, b)}


def test_prefix_leaves_out_grams_of_long_words():
    words = ["understanding", "misunderstandings", "abcde"]
    empty = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    word, _, place, _ = spelling.decompose(words, empty)
    # Grams of two characters: one edit touches two of them, so three lists are read.
    assert np.bincount(word).tolist() == [3, 3, 3] and place.max() < 17


def test_chains_of_forms(spark):
    rows, doc = [], 0
    for word, n in (("chainaa", 3), ("chainab", 6), ("chainbb", 12), ("chainbbb", 24), ("chainbbbb", 50), ("otherword", 3)):
        for _ in range(n):
            doc += 1
            rows.append((doc, word))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    wanted = plain(plain_counts(rows, every=10**12))
    got = asked(docs, every=10**12)
    assert got == wanted
    assert {r[2] for r in got} == {"chainbbbb", "otherword"}


def test_ties_take_the_smallest_word(spark):
    rows = [(None, "wordz " * 3 + "worda " * 6 + "wordé " * 6 + "wordb " * 6)]
    got = {r[0]: r for r in asked(spark.createDataFrame(rows, "doc_id bigint, text string"), every=10**12)}
    assert got["wordz"][1] == "worda" and got["worda"][1] is None and got["worda"][4] == 3


def test_odd_rows(odd, clashing):
    wanted = plain(plain_counts([tuple(r) for r in odd.select("doc_id", "text").collect()], min_chars=5, min_count=1))
    assert asked(odd, min_count=1) == wanted and asked(clashing, min_count=1) == wanted


def test_long_words(spark):
    long = "ab" * 4_000
    rows = [(1, f"{long} {long}c {long[:-1]} " * 3)]
    got = asked(spark.createDataFrame(rows, "doc_id bigint, text string"), every=10**12)
    assert got == plain(plain_counts(rows, every=10**12)) and [r[4] for r in got] == [1, 2, 1]


def test_no_documents(no_docs):
    assert asked(no_docs) == []


def test_words_must_be_longer_than_grams(no_docs):
    with pytest.raises(ValueError):
        spelling.spelling_variants(no_docs, min_chars=4)
