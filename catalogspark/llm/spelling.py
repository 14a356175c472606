"""Spelling variants: words within one edit of each other, found with an index of variable-length grams.

1. Words are counted over all texts. Every gram of ``SHORTEST`` to ``LONGEST`` code points of them is counted too, and those
   of more than a pruning threshold form the dictionary. It grows the threshold rather than its own size, so it
   has ``MAX_GRAMS`` entries at most at any size of the corpus.
2. A word, with an end mark, is decomposed: at every place stands the shortest gram that is not in the dictionary (or
   of the greatest length). So frequent beginnings get longer grams, and a gram depends on its own characters only.
3. One edit affects the grams over its place. The largest number of grams over one place is the word's bound; all other grams
   stand in any near word too, moved by one place at most. In a common order of grams, rare ones first, two near words share a
   gram within the first ``bound + 1`` of both. Only those lists are merged, per place and word length.
   Grams of four characters at most leave a word of five characters at least one gram, so no word needs another way.
4. Every pair that meets is verified by its edit distance. The best near word is the form, and roots are found by pointer
   doubling: counts at least double along forms, so paths are short.

The dictionary orders and shapes grams only; results do not depend on it.

Defined results: a null text has no words; rows without ``doc_id`` count with an empty id; repeated rows count again;
equal counts are decided by the words' code points; an empty table gives an empty table. Only ``doc_id`` and
``text`` are read, whatever other columns there are.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogspark.llm import common
from catalogspark.session import freeze
from catalogspark.sources.tables import scratch

RUN = r"[a-zÀ-ÿ]+"
EVERY = 97
MIN_CHARS = 5
MIN_COUNT = 3
SHORTEST, LONGEST = 2, 4
# Grams of this many words or fewer are never lengthened.
LEAST_LIST = 32
MAX_GRAMS = 1 << 18
FLUSH_GRAMS = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)


def word_counts(docs: DataFrame, every: int = EVERY, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n: runs of letters, some of them short of one letter as their hash says."""
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(common.lower_ascii(F.col("text")), F.lit(RUN), F.lit(0))).alias("run"),
    ).withColumn("chars", F.char_length("run")).filter(F.col("chars") >= min_chars)
    hash_ = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    gone = (F.col("hash") % F.col("chars")).cast("int")
    cut = F.concat(F.substr("run", F.lit(1), gone), F.substr("run", gone + 2))
    word = F.when(F.col("hash") % every == 0, cut).otherwise(F.col("run"))
    return (
        runs.withColumn("hash", hash_).select(word.alias("word")).filter(F.char_length("word") >= min_chars)
        .groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)
    )


class Grams:
    """All grams of a batch of words: flat characters, each word followed by an end mark (0)."""

    def __init__(self, words: list):
        self.chars = np.frombuffer("".join(w + "\0" for w in words).encode("utf-32-le"), "<u4").astype(np.uint64)
        marks = np.flatnonzero(self.chars == 0)
        self.sizes = np.diff(np.concatenate([[-1], marks])) - 1
        self.first = marks - self.sizes
        self.word = np.repeat(np.arange(len(words)), self.sizes + 1)
        # Characters from a place on, the mark included.
        self.room = marks[self.word] - np.arange(len(self.chars)) + 1
        self.hashes = {}
        code = common.mixed(self.chars + np.uint64(1))
        run = code.copy()
        for length in range(2, LONGEST + 1):
            run[:-(length - 1)] = run[:-(length - 1)] * _BASE + code[length - 1:]
            if length >= SHORTEST:
                self.hashes[length] = common.mixed(run)

    def all(self) -> np.ndarray:
        return np.concatenate([h[self.room >= length] for length, h in self.hashes.items()])


def _in_dictionary(grams: np.ndarray, known: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Counts of grams in the dictionary, 0 for others."""
    if not len(known):
        return np.zeros(len(grams), np.int64)
    at = np.searchsorted(known, grams)
    at[at == len(known)] = 0
    return np.where(known[at] == grams, counts[at], 0)


def gram_dictionary(words: DataFrame, least: int = LEAST_LIST, most: int = MAX_GRAMS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of frequent grams, sorted, with their counts."""
    schema = pa.schema([("gram", pa.int64()), ("n", pa.int64())])

    def count(stream):
        held, total = [], 0

        def rows():
            grams, n = np.unique(np.concatenate(held), return_counts=True)
            return common.batch_of(schema, [grams.view(np.int64), n])

        for batch in stream:
            held.append(Grams(batch.column(0).to_pylist()).all())
            total += len(held[-1])
            if total >= FLUSH_GRAMS:
                yield rows()
                held, total = [], 0
        if total:
            yield rows()

    counted = freeze(words.select("word").mapInArrow(count, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")))
    total = counted.agg(F.sum("n")).first()[0] or 0
    # No more than ``most`` grams can have more than this count.
    table = counted.filter(F.col("n") > max(least, total // most)).toArrow()
    grams, counts = table["gram"].to_numpy().astype(np.int64).view(np.uint64), table["n"].to_numpy()
    order = np.argsort(grams)
    return grams[order], counts[order]


def decompose(words: list, dictionary) -> tuple:
    """Word number, gram, place of the grams in each word's prefix."""
    grams = Grams(words)
    n = len(grams.chars)
    chosen, length = grams.hashes[SHORTEST].copy(), np.full(n, SHORTEST)
    longer = grams.room > SHORTEST
    for size in range(SHORTEST + 1, LONGEST + 1):
        longer &= (grams.room >= size) & (_in_dictionary(chosen, *dictionary) > 0)
        chosen[longer], length[longer] = grams.hashes[size][longer], size
    # Every character starts a gram; the mark does not.
    at = np.flatnonzero(grams.room >= SHORTEST)
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + length[at], -1)
    bound = np.maximum.reduceat(np.cumsum(steps)[:n], grams.first)
    word, place = grams.word[at], at - grams.first[grams.word[at]]
    order = np.lexsort((place, chosen[at], _in_dictionary(chosen[at], *dictionary), word))
    word, place, chosen = word[order], place[order], chosen[at][order]
    rank = np.arange(len(word)) - np.searchsorted(word, word)
    kept = rank <= bound[word]
    return word[kept], chosen[kept], place[kept], grams


def _letters(grams: Grams) -> np.ndarray:
    """Which letters a word has, as bits; one edit changes two of them at most."""
    bits = np.uint64(1) << (grams.chars % np.uint64(61))
    return np.bitwise_or.reduceat(np.where(grams.chars > 0, bits, np.uint64(0)), grams.first)


def postings(words: DataFrame, dictionary) -> DataFrame:
    """word, n, chars, letters, gram, place for the prefix grams of every word."""
    shared = words.sparkSession.sparkContext.broadcast(dictionary)
    schema = pa.schema([
        ("word", pa.string()), ("n", pa.int64()), ("chars", pa.int32()), ("letters", pa.int64()), ("gram", pa.int64()), ("place", pa.int32()),
    ])

    def post(stream):
        for batch in stream:
            if not batch.num_rows:
                continue
            word, gram, place, grams = decompose(batch.column(0).to_pylist(), shared.value)
            at = pa.array(word)
            yield common.batch_of(schema, [
                batch.column(0).take(at).cast(pa.string()), batch.column(1).take(at), grams.sizes[word].astype(np.int32),
                _letters(grams)[word].view(np.int64), gram.view(np.int64), place.astype(np.int32),
            ])

    rows = words.select("word", "n").mapInArrow(post, "word string, n bigint, chars int, letters bigint, gram bigint, place int")
    path = scratch(words.sparkSession, "grams")
    rows.write.parquet(path)
    return words.sparkSession.read.schema(rows.schema).parquet(path)


def near_pairs(words: DataFrame) -> DataFrame:
    """word, n, other, other_n: every two words of ``words`` (word, n) within one edit, in both directions."""
    posted = postings(words, gram_dictionary(words))
    # An equal gram stands at the same place of an equally long word, and at the same or the next of a longer one.
    ways = "stack(3, chars, place, chars + 1, place, chars + 1, place + 1) AS (at_chars, at_place)"
    asked = posted.selectExpr("word", "n", "chars", "letters", "gram AS at_gram", ways)
    held = posted.select(
        F.col("word").alias("other"), F.col("n").alias("other_n"), F.col("chars").alias("other_chars"),
        F.col("letters").alias("other_letters"), "gram", "place",
    )
    met = asked.join(
        held,
        (F.col("at_gram") == F.col("gram")) & (F.col("at_place") == F.col("place")) & (F.col("at_chars") == F.col("other_chars"))
        & ((F.col("at_chars") > F.col("chars")) | (F.col("word") < F.col("other")))
        & (F.bit_count(F.col("letters").bitwiseXOR(F.col("other_letters"))) <= 2)
        & (F.levenshtein("word", "other", 1) == 1),
    )
    pairs = met.select("word", "n", "other", "other_n").distinct()
    return pairs.selectExpr("stack(2, word, n, other, other_n, other, other_n, word, n) AS (word, n, other, other_n)")


def roots(forms: DataFrame) -> DataFrame:
    """word, root from (word, form): every round doubles the length of the path that a word has followed."""
    state = freeze(forms.select("word", F.col("form").alias("root")))
    while True:
        on = state.select(F.col("word").alias("at"), F.col("root").alias("next"))
        state = freeze(state.join(on, F.col("root") == F.col("at"), "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")
        ))
        if state.filter("moved").isEmpty():
            return state.select("word", "root")


def spelling_variants(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, every: int = EVERY) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of ``docs``."""
    if min_chars <= LONGEST:
        raise ValueError(f"words need more than {LONGEST} characters")
    words = freeze(word_counts(docs, every, min_chars, min_count))
    near = near_pairs(words).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other"))).alias("best")
    )
    joined = words.join(near, "word", "left").withColumn("largest", -F.col("best.less"))
    takes = F.col("largest") >= 2 * F.col("n")
    formed = freeze(joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(takes, F.col("best.other")).alias("form"), F.when(takes, F.col("largest")).alias("form_n"),
    ))
    ends = roots(formed.filter(F.col("form").isNotNull()))
    return formed.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
