"""Query tokens to index terms, with typo tolerance for tokens that have no postings.

Near terms are found by equality joins, never by comparing every token with every
term. Two strings of length >= 3 within two edits share one of three segments of
the indexed term, shifted by at most two places. Short strings either share a
character or belong to the short terms, of which only the best ``FUZZY_LIMIT`` can
be used: every term has at least one posting, so later ones are past the cut-off.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalogspark.session import broadcast_if_small

from .index import vocab_order

# Edit budget, and the postings gathered before expansion stops.
MAX_EDITS = 2
FUZZY_LIMIT = 200

_SHORT = "short"

PROBE_KEYS = 80  # at least the number of join keys of one query token


def _characters(text: Column, prefix: str) -> Column:
    return F.transform(
        F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))),
        lambda c: F.concat(F.lit(prefix), c),
    )


def _segment(length: Column, i: Column) -> tuple[Column, Column]:
    """Start and width of the i-th of three segments of a term."""
    width = F.floor(length / 3).cast("int")
    return i * width + 1, F.when(i < 2, width).otherwise(length - 2 * width)


def _key(length: Column, i: Column, text: Column) -> Column:
    return F.concat_ws("|", length.cast("string"), i.cast("string"), text)


def term_keys(term: Column) -> Column:
    """Join keys of an index term: at most three segments and four characters."""
    length = F.length(term)

    def segment(i: Column) -> Column:
        start, width = _segment(length, i)
        return _key(length, i, F.substring(term, start, width))

    segments = F.array(*[segment(F.lit(i)) for i in range(3)])
    return (
        F.when(length <= 2, _characters(term, "c2"))
        .when(length <= 4, F.concat(segments, _characters(term, "c4")))
        .otherwise(segments)
    )


def probe_keys(token: Column) -> Column:
    """Join keys of a query token: at most 75 shifted segments and four characters."""
    length = F.length(token)

    def of_length(n: Column) -> Column:
        def of_segment(i: Column) -> Column:
            start, width = _segment(n, i)
            shifts = F.filter(
                F.transform(F.sequence(F.lit(-MAX_EDITS), F.lit(MAX_EDITS)), lambda d: start + d),
                lambda s: (s >= 1) & (s + width - 1 <= length),
            )
            return F.transform(shifts, lambda s: _key(n, i, F.substring(token, s, width)))

        return F.flatten(F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), of_segment))

    lengths = F.sequence(F.greatest(F.lit(3), length - MAX_EDITS), length + MAX_EDITS)
    segments = F.array_distinct(F.flatten(F.transform(lengths, of_length)))
    return (
        F.when(length <= 2, F.concat(F.array(F.lit(_SHORT)), _characters(token, "c4")))
        .when(length <= 4, F.concat(segments, _characters(token, "c2")))
        .otherwise(segments)
    )


def near_terms(tokens: DataFrame, vocab: DataFrame, token_bytes: int | None = None) -> DataFrame:
    """All (scope, token, term, vocab columns) within the edit budget that can be used.

    With a known, small size of the tokens, the vocabulary is matched where it is read.
    """
    best_short = (
        vocab.filter(F.length("token") <= 2)
        .withColumn("_n", F.row_number().over(Window.partitionBy("scope").orderBy(*vocab_order())))
        .filter(F.col("_n") <= FUZZY_LIMIT)
        .select(*vocab.columns, F.lit(_SHORT).alias("key"))
    )
    keyed = vocab.select(*vocab.columns, F.explode(term_keys(F.col("token"))).alias("key"))
    terms = keyed.union(best_short).withColumnRenamed("token", "term")
    # A token has at most PROBE_KEYS keys, none longer than the token and its prefix.
    probe_bytes = None if token_bytes is None else 2 * PROBE_KEYS * token_bytes
    probes = tokens.select("scope", "token", F.explode(probe_keys(F.col("token"))).alias("key"))
    return (
        terms.join(broadcast_if_small(probes, probe_bytes), ["scope", "key"])
        .filter(F.levenshtein("token", "term", MAX_EDITS) >= 0)
        .select("scope", "token", "term", "df", "first_ord", "first_pos")
        .distinct()
    )


def fuzzy_terms(tokens: DataFrame, vocab: DataFrame, token_bytes: int | None = None) -> DataFrame:
    """Terms used for each unmatched token: (scope, token, term, term_pos, df).

    A term is used when the terms ranked before it hold fewer than ``FUZZY_LIMIT``
    postings, so the term that crosses the limit is still included.
    """
    near = near_terms(tokens, vocab, token_bytes)
    group = Window.partitionBy("scope", "token")
    rank = F.row_number().over(group.orderBy(*vocab_order("term")))
    ranked = (
        near.withColumn("rank", rank)
        .filter(F.col("rank") <= FUZZY_LIMIT)
        .withColumn("term_pos", F.col("rank") - 1)
    )
    before = F.sum("df").over(
        group.orderBy("term_pos").rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        ranked.withColumn("_before", F.coalesce(before, F.lit(0)))
        .filter(F.col("_before") < FUZZY_LIMIT)
        .select("scope", "token", "term", "term_pos", "df")
    )


def fuzzy_terms_of(token: str, vocab: DataFrame) -> DataFrame:
    """The same for one token over the vocabulary of one scope: a filter and a top-k."""
    length = len(token)
    near = vocab.filter(
        F.length("token").between(length - MAX_EDITS, length + MAX_EDITS)
        & (F.levenshtein(F.col("token"), F.lit(token), MAX_EDITS) >= 0)
    )
    best = near.orderBy(*vocab_order()).limit(FUZZY_LIMIT)
    # At most FUZZY_LIMIT rows reach this window.
    order = Window.partitionBy(F.lit(0)).orderBy(*vocab_order())
    before = F.sum("df").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return (
        best.withColumns(
            {"term_pos": F.row_number().over(order) - 1, "_before": F.coalesce(before, F.lit(0))}
        )
        .filter(F.col("_before") < FUZZY_LIMIT)
        .select(F.col("token").alias("term"), "term_pos", "df")
    )


def exact_terms(tokens: DataFrame, vocab: DataFrame, token_bytes: int | None = None) -> DataFrame:
    """(scope, token, df) of the distinct tokens; df is NULL where the index has none."""
    wanted = tokens.select("scope", "token").distinct()
    known = vocab.select("scope", "token", "df").join(
        broadcast_if_small(wanted, token_bytes), ["scope", "token"], "left_semi"
    )
    return wanted.join(known, ["scope", "token"], "left")


def with_stand_ins(looked_up: DataFrame, vocab: DataFrame, token_bytes: int | None = None) -> DataFrame:
    """Index terms of looked-up tokens: the token itself, or its fuzzy stand-ins."""
    exact = looked_up.filter("df IS NOT NULL").select(
        "scope", "token", F.col("token").alias("term"), F.lit(0).alias("term_pos"), "df"
    )
    return exact.union(fuzzy_terms(looked_up.filter("df IS NULL"), vocab, token_bytes))


def expand_tokens(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """Index terms of (scope, token) rows: (scope, token, term, term_pos, df)."""
    return with_stand_ins(exact_terms(tokens, vocab), vocab)
