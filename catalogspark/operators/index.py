"""Inverted index and ranked vocabulary in long form."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogspark.functions.text import tokens

from .ranking import sorted_position_in_group

SCOPES = ("all", "file")


def scope_text(scope: str):
    """Text that a scope indexes: the name alone, or the name and its folders."""
    name = F.coalesce(F.col("file"), F.lit(""))
    if scope == "file":
        return name
    return F.array_join(F.concat(F.array(name), F.col("folder")), " ")


def postings(catalog: DataFrame, scopes=SCOPES) -> DataFrame:
    """POSTINGS(scope, token, ord, pos); one scan feeds both scopes, no shuffle."""
    per_scope = F.array(
        *[
            F.struct(F.lit(s).alias("scope"), tokens(scope_text(s)).alias("tokens"))
            for s in scopes
        ]
    )
    return (
        catalog.select("ord", F.explode(per_scope).alias("s"))
        .select("ord", F.col("s.scope").alias("scope"), F.posexplode("s.tokens").alias("pos", "token"))
        .select("scope", "token", "ord", "pos")
    )


def vocabulary(posting_rows: DataFrame) -> DataFrame:
    """VOCAB(scope, token, df, first_ord, first_pos); hot tokens are combined map-side."""
    return (
        posting_rows.groupBy("scope", "token")
        .agg(
            F.count(F.lit(1)).alias("df"),
            F.min(F.struct("ord", "pos")).alias("first"),
        )
        .select(
            "scope", "token", "df",
            F.col("first.ord").alias("first_ord"), F.col("first.pos").alias("first_pos"),
        )
    )


def vocab_order(column: str = "token") -> list:
    """Frequency first; ties put canonical integers first (ascending), then first-seen order."""
    token = F.col(column)
    number = F.when(
        token.rlike("^(0|[1-9][0-9]{0,9})$"), token.try_cast("bigint")
    )
    # Fixed value: integers up to 2^32 - 2 sort as array indexes.
    index = F.when(number < 4294967295, number)
    return [F.desc("df"), index.asc_nulls_last(), F.asc("first_ord"), F.asc("first_pos")]


def ranked_vocabulary(vocab: DataFrame) -> DataFrame:
    """Add ``vocab_rank``, 1-based within each scope, by a distributed sort."""
    return sorted_position_in_group(vocab, ["scope"], vocab_order(), "vocab_rank")
