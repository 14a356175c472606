"""License scans: an exact set-similarity join of blocks of text with license notices.

1. A block is a run of words; for notices of up to ``w`` words (w a power of two) blocks have ``2 w`` words and start at
   every multiple of ``w``, so each place where a notice may stand lies whole in a block. A block meets a notice
   when it holds at least ``NUM / DEN`` of the notice's distinct tokens.
2. The tokens of all notices are counted over all documents and ordered by that frequency, rarest first. Any block that
   meets a notice holds one of its first ``size - needed + 1`` tokens (prefix filter), so only blocks around such words are
   formed. A block is reduced to its notice tokens in the same order.
3. Block and notice join on prefix tokens of both; pairs that are too short (length filter) or whose tokens
   from the shared one on cannot suffice (positional filter) go; the rest are verified on the whole token sets.

Whole texts are read twice, once to count and once to form blocks; only documents' narrow rows and the few
blocks are stored, and nothing else is shuffled. Only DataFrame functions are used. The notices are a
parameter of fixed size, so the tables made of them may be broadcast.

Defined results: a null or empty text has no words, places or labels and score 0; a row's result depends on its
text alone, so repeated rows get equal rows, also without ``doc_id``; an empty table gives an empty table. Only ``doc_id`` and
``text`` are read, whatever other columns there are.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogspark.llm.common import lower_ascii, small_side
from catalogspark.session import freeze

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# The phrases of the contract with their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Wording of public license notices (label, words in lower case).
NOTICES = (
    ("agpl", "gnu affero general public license"),
    ("all-rights-reserved", "all rights reserved"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that "
            "the following conditions are met"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
            "public license as published by the free software foundation"),
    ("lgpl", "gnu lesser general public license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
)

# A block meets a notice with 90 of 100 of its tokens.
NUM, DEN = 90, 100
LEAST_WIDTH = 4


@dataclass
class Notice:
    number: int
    label: str
    width: int
    tokens: list
    needed: int

    @property
    def prefix(self) -> list:
        return self.tokens[:len(self.tokens) - self.needed + 1]


def split_notices(notices=NOTICES, num: int = NUM, den: int = DEN) -> list:
    """Notices with their distinct tokens (in text order) and the number of them that a block needs."""
    out = []
    for number, (label, text) in enumerate(notices):
        words = text.split()
        tokens = list(dict.fromkeys(words))
        width = max(LEAST_WIDTH, 1 << (len(words) - 1).bit_length())
        out.append(Notice(number, label, width, tokens, -(-num * len(tokens) // den)))
    return out


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _array(values: list) -> Column:
    return F.array(*[F.lit(v) for v in values])


def by_frequency(docs: DataFrame, notices: list) -> list:
    """The tokens of all notices, rarest in the documents first."""
    tokens = sorted({t for notice in notices for t in notice.tokens})
    words = docs.select(F.explode(words_of(F.col("text"))).alias("token"))
    counted = words.filter(F.col("token").isin(tokens)).groupBy("token").count()
    # One row per token of the notices.
    counts = {r["token"]: r["count"] for r in counted.collect()}
    return sorted(tokens, key=lambda t: (counts.get(t, 0), t))


def _starts(words: Column, phrase: str) -> Column:
    """Word numbers at which a phrase stands; texts that lack one of its words are not searched."""
    first, *rest = phrase.split()
    held = F.lit(True)
    for word in {first, *rest}:
        held = held & F.array_contains(words, word)

    def at(word, i):
        same = word == first
        for k, next_ in enumerate(rest, 1):
            same = same & (F.get(words, i + k) == next_)
        return F.when(same, i.cast("bigint"))

    return F.when(held, F.array_compact(F.transform(words, at))).otherwise(F.array().cast("array<bigint>"))


def _blocks_of_width(words: Column, width: int, notices: list, order: list) -> Column:
    """Blocks (width, number, tokens in frequency order) around the prefix tokens of notices of one width."""
    prefix = sorted({t for n in notices for t in n.prefix})
    held = {t for n in notices for t in n.tokens}
    ranked = _array([t for t in order if t in held])
    least = min(n.needed for n in notices)

    def numbers(word, i):
        at = F.floor(i / width).cast("int")
        return F.when(word.isin(prefix), F.array(F.greatest(at - 1, F.lit(0)), at))

    def block(number):
        inside = F.slice(words, number * width + 1, F.lit(2 * width))
        return F.struct(F.lit(width).alias("width"), number.alias("number"), F.array_intersect(ranked, inside).alias("tokens"))

    near = F.array_distinct(F.flatten(F.array_compact(F.transform(words, numbers))))
    blocks = F.filter(F.transform(near, block), lambda b: F.size(b["tokens"]) >= least)
    # Most texts have no such word and are not walked through.
    return F.when(F.arrays_overlap(words, _array(prefix)), blocks)


def _blocks(words: Column, notices: list, order: list) -> Column:
    by_width = [
        _blocks_of_width(words, width, [n for n in notices if n.width == width], order) for width in sorted({n.width for n in notices})
    ]
    return F.flatten(F.array_compact(F.array(*by_width)))


def _notice_table(spark, notices: list) -> DataFrame:
    """One row per notice and prefix token; its size is that of the notices given."""
    rows = [
        F.struct(
            F.lit(n.number).alias("notice"), F.lit(n.label).alias("label"), F.lit(n.width).alias("of_width"),
            F.lit(n.needed).alias("needed"), _array(n.tokens).alias("wanted"),
            F.lit(t).alias("token"), F.lit(place).alias("place"),
        )
        for n in notices for place, t in enumerate(n.prefix, 1)
    ]
    return spark.range(1).select(F.inline(F.array(*rows)))


def _scanned(docs: DataFrame, notices, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """One narrow row per document, and the verified (row, label, first_word, containment) of its blocks."""
    notices = split_notices(notices, num, den)
    order = by_frequency(docs, notices)
    for notice in notices:
        notice.tokens.sort(key=order.index)
    words = F.col("words")
    labelled = [(F.lit(label), _starts(words, phrase)) for phrase, label in PHRASES.items()]
    split = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), words_of(F.col("text")).alias("words"))
    rows = freeze(split.select(
        "doc_id", F.size(words).cast("bigint").alias("n_words"), F.concat(*[s for _, s in labelled]).alias("places"),
        F.array_compact(F.array(*[F.when(F.size(s) > 0, label) for label, s in labelled])).alias("base"),
        _blocks(words, notices, order).alias("blocks"),
    ).withColumn("row", F.monotonically_increasing_id()))
    # Blocks by the tokens of their prefix; how long it is depends on the notice.
    posted = rows.select("row", F.inline("blocks")).select(
        "row", "width", "number", "tokens", F.posexplode("tokens").alias("before", "token")
    )
    left = F.size("tokens") - F.col("before")
    most = F.least(left, F.size("wanted") - F.col("place") + 1)
    met = posted.join(F.broadcast(_notice_table(docs.sparkSession, notices)), "token").filter(
        (F.col("width") == F.col("of_width")) & (F.size("tokens") >= F.col("needed")) & (most >= F.col("needed"))
    ).dropDuplicates(["row", "width", "number", "notice"])
    shared = F.size(F.array_intersect("wanted", "tokens"))
    return rows, met.withColumn("shared", shared).filter(F.col("shared") >= F.col("needed")).select(
        "row", "label", "notice", (F.col("number") * F.col("width")).cast("bigint").alias("first_word"),
        (F.col("shared") / F.size("wanted")).alias("containment"),
    )


def license_blocks(docs: DataFrame, notices=NOTICES, num: int = NUM, den: int = DEN) -> DataFrame:
    """doc_id, label, notice, first_word, containment of every block that meets a notice."""
    rows, met = _scanned(docs, notices, num, den)
    return met.join(rows.select("row", "doc_id"), "row").select("doc_id", "label", "notice", "first_word", "containment")


def license_scan(docs: DataFrame, notices=NOTICES, num: int = NUM, den: int = DEN) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row of ``docs``.

    The score is 1 where a phrase stands, else the best containment found (0 without any).
    """
    rows, met = _scanned(docs, notices, num, den)
    found = freeze(met.groupBy("row").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best")))
    joined = rows.drop("blocks").join(small_side(found.withColumnRenamed("row", "of")), F.col("row") == F.col("of"), "left")
    none = F.array().cast("array<string>")

    def text(labels):
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    return joined.select(
        "doc_id", "n_words", F.size("places").cast("bigint").alias("n_base"),
        F.array_min("places").alias("first_word"), F.array_max("places").alias("last_word"),
        text(F.col("base")).alias("base_labels"), text(F.concat("base", F.coalesce("more", none))).alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
