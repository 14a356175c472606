"""Blocked postings: sorted ords of a term, cut at fixed ranges of the record order.

A block is the postings of one term within ``BLOCK_SPAN`` consecutive ords, so equal block numbers of any two terms cover
the same ords, a frequent term is spread over many rows, and no row is longer than the span. Lists are
intersected in two steps: first the first and last ords of blocks, which are narrow columns, then the ords
of the blocks that all lists still have. A block outside that intersection is never read as a list of ords.

Terms are the tokens of the two scopes, and the text pieces (grams) of names and folder paths, under the scope ``gram``:
records that contain a text contain all its grams.
"""

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogspark.functions.paths import folder_path
from catalogspark.functions.text import standing_tokens, tokens
from catalogspark.session import broadcast_if_small

from .index import SCOPES, scope_text
from .matching import searchable, token_points

BLOCK_SPAN = 1 << 14
GRAM = 3
GRAM_SCOPE = "gram"

# Blocks that are named in the plan of a query; more of them are joined.
LISTED_BLOCKS = 1000


def block_of(ord_: Column, span: int = BLOCK_SPAN) -> Column:
    return F.floor(ord_ / span).cast("bigint")


def text_grams(text: Column, n: int = GRAM) -> Column:
    """Distinct pieces of ``n`` characters; the look-ahead yields overlapping ones in one pass."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))


def word_postings(catalog: DataFrame, scopes=SCOPES) -> DataFrame:
    """(scope, token, ord, points) of tokens, with the relevance that a query for the token gives the record.

    Whether a name contains its own tokens follows from its pieces, taken in one pass; the name is searched only for the runs that
    its folders add. So the work grows with the text, not with text times tokens, and no row of a token holds the name.
    """
    found = {f"in_{s}": tokens(scope_text(s)) for s in scopes}
    cut = catalog.withColumns({**searchable(), "standing": standing_tokens(F.col("file")), **found})
    # Characters and bigrams that a name contains all stand in it; a folder's run may be a part of a longer one.
    if "all" in scopes:
        cut = cut.withColumn("added", F.filter(
            F.array_except("in_all", "standing"), lambda t: t.rlike("^[a-z0-9]") & F.contains(F.col("file_lc"), t)
        ))
    sides = {}
    for s in scopes:
        held = F.array_intersect(f"in_{s}", "standing")
        if s == "all":
            held = F.array_union(held, "added")
        sides[s, True], sides[s, False] = held, F.array_except(F.col(f"in_{s}"), held)
    cut = cut.select("ord", "folder_lc", "repo_lc", *[t.alias(f"{s}_{own}") for (s, own), t in sides.items()])
    # An array of columns: Spark would test any other one for emptiness first, and derive all tokens again for that.
    rows = F.array(*[F.struct(F.lit(s).alias("scope"), F.lit(own).alias("own"), F.col(f"{s}_{own}").alias("tokens")) for s, own in sides])
    each = cut.select("ord", "folder_lc", "repo_lc", F.inline(rows)).select(
        "ord", "folder_lc", "repo_lc", "scope", "own", F.explode("tokens").alias("token")
    )
    points = token_points(F.col("token"), F.col("scope") == "all", F.col("own"))
    return each.select("scope", "token", "ord", points.alias("points"))


def gram_postings(catalog: DataFrame) -> DataFrame:
    """(scope, token, ord, points) of the grams of lower-cased names and folder paths; they have no points."""
    fields = (F.lower(F.coalesce(F.col("file"), F.lit(""))), F.lower(folder_path(F.col("folder"))))
    grams = F.array_distinct(F.concat(*[text_grams(f) for f in fields]))
    return catalog.select(F.lit(GRAM_SCOPE).alias("scope"), F.explode(grams).alias("token"), "ord", F.lit(0).alias("points"))


def blocked(rows: DataFrame, span: int = BLOCK_SPAN) -> DataFrame:
    """(scope, token, block, first_ord, last_ord, n, points, ords) from (scope, token, ord, points) rows.

    ``points`` is the most that a record of the block has.
    """
    ords = F.sort_array(F.collect_set("ord"))
    return (
        rows.groupBy("scope", "token", block_of(F.col("ord"), span).alias("block")).agg(ords.alias("ords"), F.max("points").alias("points"))
        .select("scope", "token", "block", F.get("ords", F.lit(0)).alias("first_ord"), F.element_at("ords", -1).alias("last_ord"),
                F.size("ords").alias("n"), "points", "ords")
    )


def blocked_postings(catalog: DataFrame, scopes=(*SCOPES, GRAM_SCOPE), span: int = BLOCK_SPAN) -> DataFrame:
    """Blocks of all terms of a catalog."""
    kinds = []
    words = tuple(s for s in scopes if s in SCOPES)
    if words:
        kinds.append(word_postings(catalog, words))
    if GRAM_SCOPE in scopes:
        kinds.append(gram_postings(catalog))
    return blocked(reduce(DataFrame.unionAll, kinds), span)


def _of(terms: list) -> Column:
    return F.col("token").isin(terms)


def common_blocks(blocks: DataFrame, scope: str, lists: list) -> DataFrame:
    """(block, most, bound) where every list of terms has postings whose ranges meet; reads no ords.

    ``most`` is the size of the shortest list there, an upper bound of the common ords. ``bound`` is the greatest
    relevance that a record there can have for a query of exactly these terms.
    """
    held = blocks.filter((F.col("scope") == scope) & _of(sorted({t for terms in lists for t in terms})))
    ranges = []
    for i, terms in enumerate(lists):
        mine = _of(terms)
        ranges += [
            F.min(F.when(mine, F.col("first_ord"))).alias(f"lo{i}"), F.max(F.when(mine, F.col("last_ord"))).alias(f"hi{i}"),
            F.sum(F.when(mine, F.col("n"))).alias(f"n{i}"), F.max(F.when(mine, F.col("points"))).alias(f"points{i}"),
        ]
    every = range(len(lists))
    met = held.groupBy("block").agg(*ranges)
    for i in every:
        met = met.filter(F.col(f"n{i}").isNotNull())
    if len(lists) > 1:
        lows, highs = ([F.col(f"{side}{i}") for i in every] for side in ("lo", "hi"))
        met = met.filter(F.greatest(*lows) <= F.least(*highs))
    sizes = [F.col(f"n{i}") for i in every]
    bound = reduce(add, [F.col(f"points{i}") for i in every])
    return met.select("block", (F.least(*sizes) if len(sizes) > 1 else sizes[0]).alias("most"), bound.cast("int").alias("bound"))


def intersect(blocks: DataFrame, scope: str, lists: list, chosen: list | DataFrame, chosen_bytes: int | None = None) -> DataFrame:
    """(block, ords) common to all lists of terms, for the ``chosen`` blocks: their numbers, or a table of them.

    A list stands for a record when any of its terms does.
    """
    every = sorted({t for terms in lists for t in terms})
    held = blocks.filter((F.col("scope") == scope) & _of(every))
    if isinstance(chosen, DataFrame):
        numbers = chosen.select(F.col("block").alias("of"))
        held = held.join(broadcast_if_small(numbers, chosen_bytes), F.col("block") == F.col("of"), "left_semi")
    else:
        held = held.filter(F.col("block").isin(chosen))
    found = held.groupBy("block").agg(
        *[F.flatten(F.collect_list(F.when(_of(terms), F.col("ords")))).alias(f"ords{i}") for i, terms in enumerate(lists)]
    )
    common = reduce(F.array_intersect, [F.col(f"ords{i}") for i in range(1, len(lists))], F.array_distinct("ords0"))
    return found.select("block", common.alias("ords")).filter(F.size("ords") > 0)


def first_held(blocks: DataFrame, scope: str, terms: list, chosen: list) -> DataFrame:
    """(ord, tie): for each ord in the chosen blocks the place of the first of ``terms`` that has it."""
    place = F.array_position(F.array(*[F.lit(t) for t in terms]), F.col("token")) - 1
    held = blocks.filter((F.col("scope") == scope) & _of(terms) & F.col("block").isin(chosen))
    return held.select(F.explode("ords").alias("ord"), place.cast("int").alias("tie")).groupBy("ord").agg(F.min("tie").alias("tie"))
