import random
import re

import pytest

from catalogspark.llm import license_scan
from catalogspark.llm.license_scan import NOTICES, PHRASES

COLUMNS = "doc_id bigint, text string"


def split(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain(rows, notices=NOTICES, num=90, den=100):
    """Every block of every text against every notice, by sets."""
    out = []
    for doc, text in rows:
        words = split(text)
        places = []
        for phrase, label in PHRASES.items():
            p = phrase.split()
            places += [(i, label) for i in range(len(words)) if words[i:i + len(p)] == p]
        base, labels, best = {label for _, label in places}, set(), 0.0
        for label, notice in notices:
            size = len(notice.split())
            width = 4
            while width < size:
                width *= 2
            wanted = set(notice.split())
            for i in range(0, len(words), width):
                shared = len(wanted & set(words[i:i + 2 * width]))
                if den * shared >= num * len(wanted):
                    labels.add(label)
                    best = max(best, shared / len(wanted))
        at = [i for i, _ in places]
        out.append((
            doc, len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)),
            ",".join(sorted(base | labels)), 1.0 if at else best,
        ))
    return sorted(out, key=repr)


def asked(docs, **kw):
    return sorted((tuple(r) for r in license_scan.license_scan(docs, **kw).collect()), key=repr)


def test_equals_brute_force(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    assert asked(docs) == plain([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_planted_notices(spark):
    """Whole, wrapped, reordered and damaged notices between other words, at every offset."""
    rng = random.Random(5)
    rows = []
    for number, (_, notice) in enumerate(NOTICES):
        words = notice.split()
        for i in range(6):
            held = list(words)
            if i == 1:
                rng.shuffle(held)
            if i >= 2:
                for _ in range(i - 1):
                    held[rng.randrange(len(held))] = "other"
            around = [f"w{rng.randrange(50)}" for _ in range(rng.randrange(40))]
            cut = rng.randrange(len(around) + 1)
            text = " ".join(around[:cut]) + "\n" + "\n".join(w.upper() if rng.random() < 0.3 else w for w in held) + " -- " + " ".join(around[cut:])
            rows.append((10 * number + i, text))
    got = asked(spark.createDataFrame(rows, COLUMNS).repartition(3))
    assert got == plain(rows)
    whole = {r[0]: r for r in got if r[0] % 10 == 0}
    assert all(label in whole[10 * n][6].split(",") for n, (label, _) in enumerate(NOTICES))


def test_other_thresholds_and_notices(spark):
    rng = random.Random(6)
    notices = [("x", "a b c d e f g h i j"), ("y", "a b c a b c"), ("z", "k")]
    rows = [(i, " ".join(rng.choice("abcdefghijklm") for _ in range(rng.randrange(60)))) for i in range(80)]
    for num in (50, 80, 100):
        assert asked(spark.createDataFrame(rows, COLUMNS), notices=notices, num=num) == plain(rows, notices, num)


def test_odd_rows(odd, clashing):
    wanted = plain([tuple(r) for r in odd.select("doc_id", "text").collect()])
    assert asked(odd) == wanted and asked(clashing) == wanted


def test_no_documents(no_docs):
    assert asked(no_docs) == []


@pytest.mark.parametrize("text,n,first,last", [
    ("MIT license mit License", 2, 0, 2), ("apache license, cc-by; GNU  General/Public License", 3, 0, 4), ("mitlicense cc  b y", 0, None, None),
])
def test_places(spark, text, n, first, last):
    row = license_scan.license_scan(spark.createDataFrame([(1, text)], COLUMNS)).first()
    assert (row["n_base"], row["first_word"], row["last_word"]) == (n, first, last)


def test_blocks_report_where(spark):
    docs = spark.createDataFrame([(7, "x " * 21 + "all rights reserved")], COLUMNS)
    met = license_scan.license_blocks(docs).collect()
    assert {(r["doc_id"], r["label"], r["containment"]) for r in met} == {(7, "all-rights-reserved", 1.0)}
    assert {r["first_word"] for r in met} == {16, 20}


def test_plan_has_no_python(spark, corpus):
    plan = license_scan.license_scan(spark.read.parquet(f"{corpus}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
