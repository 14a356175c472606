"""Text columns: tokens, query routing, patterns, highlighting."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two CJK ranges that are indexed, and the white-space set.
CJK = r"\u4e00-\u9fff\u3400-\u4dbf"
SPACE = r"\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def tokens(text: Column) -> Column:
    """Distinct tokens in first-seen order: a-z0-9 runs, CJK characters, CJK bigrams.

    Bigrams pair neighbours of the CJK-only subsequence, so they jump over other text.
    """
    lowered = F.lower(F.coalesce(text, F.lit("")))
    runs = F.regexp_extract_all(lowered, F.lit("[a-z0-9]+"), F.lit(0))
    cjk = F.regexp_replace(lowered, f"[^{CJK}]+", "")
    # The look-ahead yields the overlapping pairs in one pass over the text.
    singles = F.regexp_extract_all(cjk, F.lit("."), F.lit(0))
    pairs = F.regexp_extract_all(cjk, F.lit("(?=(..))"), F.lit(1))
    found = F.when(lowered.rlike(f"[{CJK}]"), F.concat(runs, singles, pairs)).otherwise(runs)
    return F.array_distinct(found)


def standing_tokens(text: Column) -> Column:
    """The tokens of a text that stand in it as they are: all but the bigrams that jump over other text."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    runs = F.regexp_extract_all(lowered, F.lit("[a-z0-9]+"), F.lit(0))
    singles = F.regexp_extract_all(lowered, F.lit(f"[{CJK}]"), F.lit(0))
    pairs = F.regexp_extract_all(lowered, F.lit(f"(?=([{CJK}][{CJK}]))"), F.lit(1))
    return F.array_distinct(F.when(lowered.rlike(f"[{CJK}]"), F.concat(runs, singles, pairs)).otherwise(runs))


def trim_space(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"^[{SPACE}]+|[{SPACE}]+$", "")


def is_literal(query: Column) -> Column:
    """True when the query holds anything but letters, digits, CJK and white space."""
    return query.rlike(f"[^a-zA-Z0-9{CJK}{SPACE}]")


def search_mode(query: Column, exact: Column) -> Column:
    """Route a trimmed query: ``all``, ``wildcard``, ``literal`` or ``token``."""
    literal = F.coalesce(exact, F.lit(False)) | is_literal(query)
    return (
        F.when(query == "", "all")
        .when(literal & query.rlike("[*?]"), "wildcard")
        .when(literal, "literal")
        .otherwise("token")
    )


def wildcard_pattern(query: Column) -> Column:
    """Unanchored, case-blind regular expression of a ``*``/``?`` pattern."""
    any_char = r"[^\n\r\u2028\u2029]"
    # Stars at the ends of an unanchored pattern, or repeated, change nothing but the cost.
    lean = F.regexp_replace(F.regexp_replace(query, r"^[*]+|[*]+$", ""), r"[*]+", "*")
    escaped = F.regexp_replace(lean, r"[.+^${}()|\[\]\\]", r"\\$0")
    starred = F.replace(escaped, F.lit("*"), F.lit(any_char + "*"))
    # "?" must not touch the patterns just inserted; they contain none.
    return F.concat(F.lit("(?iu)"), F.replace(starred, F.lit("?"), F.lit(any_char)))


def html_escape(text: Column) -> Column:
    # "&" first, so that the entities added later stay intact.
    for char, entity in (
        ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"),
    ):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def highlight(text: Column, query: Column) -> Column:
    """Mark every query term in the escaped text, one term after the other."""
    terms = F.filter(F.split(F.coalesce(query, F.lit("")), f"[{SPACE}]+"), lambda t: t != "")

    def mark(acc: Column, term: Column) -> Column:
        quoted = F.regexp_replace(html_escape(term), r"[.*+?^${}()|\[\]\\]", r"\\$0")
        return F.regexp_replace(acc, F.concat(F.lit("(?iu)("), quoted, F.lit(")")), F.lit("<mark>$1</mark>"))

    return F.aggregate(terms, html_escape(F.coalesce(text, F.lit(""))), mark)
