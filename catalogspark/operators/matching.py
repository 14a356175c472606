"""Query preparation, match tests, scores and orders.

The tests take a query as a dict of columns: literals for one query, columns of the
query table for a batch.
"""

from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogspark.functions.paths import folder_path
from catalogspark.functions.predicates import FOLDER_FIELDS, clean_list, is_unfiltered
from catalogspark.functions.text import CJK, search_mode, tokens, trim_space, wildcard_pattern

from .index import scope_text

# Page size limits and score weights.
MAX_PAGE_SIZE = 500
DEFAULT_PAGE_SIZE = 100
FILE_WEIGHT, FOLDER_WEIGHT, REPO_WEIGHT = 3, 2, 1

GRAM = 3  # length of the text pieces that literal batches are joined on


def page_number(page: Column) -> Column:
    return F.greatest(F.lit(1), F.coalesce(page, F.lit(1)))


def clamp_page_size(size: Column) -> Column:
    wanted = F.coalesce(F.nullif(size, F.lit(0)), F.lit(DEFAULT_PAGE_SIZE))
    return F.greatest(F.lit(1), F.least(F.lit(MAX_PAGE_SIZE), wanted))


def prepare_queries(queries: DataFrame) -> DataFrame:
    """Normalise QUERY rows and add mode, scope, tokens, pattern and page bounds."""
    trimmed = queries.withColumn("q", trim_space(F.col("q")))
    folders = F.coalesce("search_folders", F.lit(True))
    routed = trimmed.withColumns(
        {
            "search_folders": folders,
            "scope": F.when(folders, "all").otherwise("file"),
            "mode": search_mode(F.col("q"), F.col("exact")),
            "q_lc": F.lower("q"),
            "q_tokens": tokens(F.col("q")),
            "page": page_number(F.col("page")),
            "page_size": clamp_page_size(F.col("page_size")),
            **{f: clean_list(F.col(f)) for f in FOLDER_FIELDS},
        }
    )
    last = F.col("page").cast("bigint") * F.col("page_size")
    return routed.withColumns(
        {
            "pattern": F.when(F.col("mode") == "wildcard", wildcard_pattern(F.col("q"))),
            "gram": F.substring(longest_run(F.col("q_lc"), F.col("mode")), 1, GRAM),
            # Pieces that a wildcard hit must contain: cheap tests before the expression.
            "head_run": F.substring_index(F.translate("q_lc", "?", "*"), "*", 1),
            "tail_run": F.substring_index(F.translate("q_lc", "?", "*"), "*", -1),
            "first_row": last - F.col("page_size") + 1,
            "last_row": last,
        }
    ).withColumns(
        {
            "pairing": pairing(F.col("mode"), F.col("gram"), F.col("repos")),
            "unfiltered": is_unfiltered(),
        }
    )


def longest_run(q_lc: Column, mode: Column) -> Column:
    """Longest text that every match of a literal or wildcard query contains."""
    pieces = F.when(mode == "wildcard", F.split(q_lc, "[*?]+")).when(
        mode == "literal", F.array(q_lc)
    ).otherwise(F.array(F.lit("")))
    return F.aggregate(
        pieces, F.lit(""),
        lambda best, p: F.when(F.length(p) > F.length(best), p).otherwise(best),
    )


def pairing(mode: Column, gram: Column, repos: Column) -> Column:
    """What a query that is not a token query shares with its hits: (kind, keys).

    A piece of text where it has one, else a repo where it is limited to some; only
    open browsing is paired with every record.
    """

    def keys(kind: str, values: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), values.alias("keys"))

    return F.when(mode != "token", F.when(gram != "", keys("gram", F.array(gram)))
                  .when(F.size(repos) > 0, keys("repo", F.array_distinct(repos)))
                  .otherwise(keys("every", F.array(F.lit("")))))


def searchable() -> dict:
    """Lower-cased fields that queries look into; computed once per record."""
    return {
        "file_lc": F.lower("file"), "repo_lc": F.lower("repo"),
        "folder_lc": F.lower(folder_path(F.col("folder"))),
    }


def grams(lengths: list) -> Column:
    """Distinct pieces of the searchable fields of a record, of the given lengths."""
    # The look-ahead yields every overlapping piece in one pass over the text.
    pieces = [
        F.regexp_extract_all(field, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))
        for field in searchable().values() for n in lengths
    ]
    return F.array_distinct(F.concat(*pieces))


def field_hit(field: Column, query: dict, wildcard: Column) -> Column:
    """Whole query found in one lower-cased field."""
    pattern_hit = (
        F.contains(field, query["head_run"]) & F.contains(field, query["tail_run"])
        & F.rlike(field, query["pattern"])
    )
    return F.when(wildcard, pattern_hit).otherwise(F.contains(field, query["q_lc"]))


def literal_match(query: dict, wildcard: Column) -> Column:
    """Whole query found in file name, repo or (optionally) folder path."""
    file, repo, folder = (field_hit(F.col(c), query, wildcard) for c in searchable())
    return file | repo | (query["search_folders"] & folder)


# Longest token list whose tests are written out; longer ones use array functions with lambdas.
UNROLLED = 8


def _items(values: Column, at_most: int) -> list:
    return [F.get(values, F.lit(i)) for i in range(at_most)]


def terms_match(token_terms: Column, held: Column, at_most: int) -> Column:
    """Every query token has one of its terms among the record's tokens."""
    if at_most > UNROLLED:
        return F.forall(token_terms, lambda terms: F.arrays_overlap(held, terms))
    tests = [t.isNull() | F.arrays_overlap(held, t) for t in _items(token_terms, at_most)]
    return reduce(and_, tests, F.lit(True))


def first_held(terms: Column, held: Column) -> Column:
    """First of the terms that is among the record's tokens."""
    return F.get(F.array_intersect(terms, held), F.lit(0))


def match_tie(first_terms: Column, held: Column) -> Column:
    """Match order within equal scores: rank of the first token's first held term."""
    return (F.array_position(first_terms, first_held(first_terms, held)) - 1).cast("int")


def record_tokens(search_folders: Column) -> Column:
    return F.when(search_folders, tokens(scope_text("all"))).otherwise(tokens(scope_text("file")))


def token_held(text_lc: Column, token: str) -> Column:
    """Whether lower-cased text has an exact token, without listing all its tokens."""
    if token.isascii():
        edge = "[a-z0-9]"
        return F.contains(text_lc, F.lit(token)) & text_lc.rlike(f"(?<!{edge}){token}(?!{edge})")
    return text_lc.rlike(f"[^{CJK}]*".join(token))


def token_points(token: Column, search_folders: Column, in_file: Column | None = None) -> Column:
    """Weights of the fields that contain a token as a substring; ``in_file`` says it of the name where that is known."""
    file, repo, folder = (F.col(c) for c in searchable())
    return (
        F.when(F.contains(file, token) if in_file is None else in_file, FILE_WEIGHT).otherwise(0)
        + F.when(search_folders & F.contains(folder, token), FOLDER_WEIGHT).otherwise(0)
        + F.when(F.contains(repo, token), REPO_WEIGHT).otherwise(0)
    )


def relevance(query_tokens: Column, search_folders: Column, at_most: int) -> Column:
    """Sum over query tokens of their points."""

    def points(token: Column) -> Column:
        return token_points(token, search_folders)

    if at_most > UNROLLED:
        return F.aggregate(query_tokens, F.lit(0), lambda total, token: total + points(token))
    return reduce(add, map(points, _items(query_tokens, at_most)), F.lit(0))


def name_key(file: Column) -> Column:
    """Locale order of file names (Han by pinyin, before Latin)."""
    return F.collate(file, "zh")


def size_key(size: Column) -> Column:
    return F.coalesce(size, F.lit(0))


def result_order(sort: str | None) -> list:
    """Order of one result list; unknown sorts mean relevance, ties keep match order."""
    match_order = [F.asc("tie"), F.asc("ord")]
    if sort == "name":
        return [name_key(F.col("file")).asc(), *match_order]
    if sort == "size":
        return [size_key(F.col("size")).desc(), *match_order]
    return [F.desc("score"), *match_order]


def batch_result_order() -> list:
    """The same orders for rows whose query names its own sort."""
    sort = F.coalesce("sort", F.lit(""))
    return [
        F.when(sort == "name", name_key(F.col("file"))).asc(),
        F.when(sort == "size", size_key(F.col("size"))).desc(),
        F.when(~sort.isin("name", "size"), F.col("score")).desc(),
        F.asc("tie"), F.asc("ord"),
    ]
