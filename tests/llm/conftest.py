import random

import pytest

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# Names that the operators use inside.
CLASHES = ["kept", "node", "bucket", "size", "copies", "lost", "n_lines", "llr", "place", "shard", "h1", "label_doc", "batch"]


def words(seed: int, n: int, vocabulary: int = 400) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def odd_rows() -> list:
    """Nulls in every column, empty, blank and very long texts, repeated rows, ties and copies."""
    texts = [
        None, "", "   ", "\n\n", "one", "two words", words(1, 60), words(1, 60), words(1, 60).upper(),
        words(2, 300), words(2, 300) + " and a little more", words(3, 30_000), "x" * 5000, "é " * 40,
        "\n".join([words(4, 12)] * 3 + [words(5, 12)]), "\n".join([words(4, 12), words(6, 12)]),
        " ".join(f"{w}***" for w in words(7, 80).split()), "a\tb\x0bc\x0cd\re  f", words(8, 25),
    ]
    sources = ["src1", "src2", None, "Zeta", ""]
    rows = [(i, t, "en" if i % 3 else None, sources[i % 5], None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[6], rows[6], rows[1], (None, words(1, 60), None, None, None), (None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), COLUMNS).repartition(3).cache()


@pytest.fixture(scope="session")
def clashing(odd):
    """The same rows with further columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    return odd.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHES])


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="session")
def corpus():
    """Folder of the smallest shared tables."""
    return "/root/testdata/sf0.001"
