"""Search: one query, or a table of queries, over a catalog."""

import re
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalogspark.functions.paths import folder_path
from catalogspark.functions.predicates import (
    FOLDER_FIELDS, passes_filters, passes_used_filters, up_paths, used_filters,
)
from catalogspark.functions.text import tokens
from catalogspark.operators import bitmaps
from catalogspark.operators import blocks as b
from catalogspark.operators import matching as m
from catalogspark.operators.fuzzy import exact_terms, fuzzy_terms_of, with_stand_ins
from catalogspark.operators.index import SCOPES, postings, scope_text, vocabulary
from catalogspark.operators.intervals import folder_interval, folder_numbers, with_folder_number
from catalogspark.operators.ranking import sorted_position, sorted_position_in_group
from catalogspark.schema import FILTER_FIELDS, QUERY
from catalogspark.session import BROADCAST_BYTES, broadcast_if_small, freeze, row_bytes

# Most postings that are fetched from the index and broadcast to the catalog scan.
FETCH_LIMIT = 1_000_000

RECORD = ("ord", "repo", "file", "ext", "folder", "size", "has_txt")


@dataclass(frozen=True)
class SearchIndex:
    """Postings and vocabulary of one catalog generation.

    Where it has them: its prepared orders, its blocked postings with the text pieces of names and folders,
    the names of its repos, bitmaps of its facets, and its records by folder with the numbers of folder paths.
    """

    postings: DataFrame
    vocab: DataFrame
    browse: DataFrame | None = None
    blocks: DataFrame | None = None
    repos: DataFrame | None = None
    bitmaps: DataFrame | None = None
    folder_numbers: DataFrame | None = None
    by_folder: DataFrame | None = None


@dataclass(frozen=True)
class SearchResult:
    """``rows``: the asked page of every query; ``totals``: hits of every query.

    ``matched`` holds all hits, unordered, for further work.
    """

    rows: DataFrame
    totals: DataFrame
    matched: DataFrame


def build_index(catalog: DataFrame, blocks: bool = False) -> SearchIndex:
    rows = postings(catalog)
    if not blocks:
        return SearchIndex(rows, vocabulary(rows))
    numbers = freeze(folder_numbers(catalog))
    return SearchIndex(
        rows, vocabulary(rows), blocks=freeze(b.blocked_postings(catalog)), repos=freeze(catalog.select("repo").distinct()),
        bitmaps=freeze(bitmaps.facet_bitmaps(catalog)), folder_numbers=numbers, by_folder=with_folder_number(catalog, numbers),
    )


def _record_columns(catalog: DataFrame) -> list:
    return [*RECORD, *[c for c in ("record_id", "generation") if c in catalog.columns]]


def _record() -> dict:
    return {
        "repo": F.col("repo"), "ext": F.col("ext"), "folder": F.col("folder"),
        "folder_path": folder_path(F.col("folder")), "size": F.col("size"),
    }


def token_plan(prepared: DataFrame, vocab: DataFrame, query_bytes: int | None = None) -> DataFrame:
    """Per token query whose tokens all have terms: the terms, and the rarest token.

    Columns: query_id, scope, token_terms (one list per token), first_terms,
    driver_terms, cost (postings of the driving token). Lists hold at most the
    fuzzy limit of terms per token. The result is stored.
    """
    words = prepared.filter("mode = 'token'").select(
        "query_id", "scope", F.size("q_tokens").alias("n_tokens"),
        F.posexplode("q_tokens").alias("token_pos", "token"),
    )
    looked_up = freeze(exact_terms(words, vocab, query_bytes))
    missing = looked_up.filter("df IS NULL").agg(row_bytes("scope", "token").alias("bytes")).first()
    if not missing["bytes"]:
        # No typo anywhere: the search for near terms is left out of the plan.
        terms = looked_up.select(
            "scope", "token", F.col("token").alias("term"), F.lit(0).alias("term_pos"), "df"
        )
    else:
        terms = with_stand_ins(looked_up, vocab, missing["bytes"])
    per_word = (
        words.join(terms, ["scope", "token"])
        .groupBy("query_id", "scope", "n_tokens", "token_pos")
        .agg(
            F.array_sort(F.collect_list(F.struct("term_pos", "term"))).alias("ranked"),
            F.sum("df").alias("cost"),
        )
        .withColumn("terms", F.col("ranked.term"))
    )
    return freeze(
        per_word.groupBy("query_id", "scope", "n_tokens")
        .agg(
            F.array_sort(F.collect_list(F.struct("token_pos", "terms"))).alias("words"),
            F.min(F.struct("cost", "token_pos", "terms")).alias("driver"),
        )
        .filter(F.size("words") == F.col("n_tokens"))
        .select(
            "query_id", "scope", F.col("words.terms").alias("token_terms"),
            F.get("words.terms", F.lit(0)).alias("first_terms"),
            F.col("driver.terms").alias("driver_terms"), F.col("driver.cost").alias("cost"),
        )
    )


_TERM_FIELDS = {
    "token_terms": "array<array<string>>", "first_terms": "array<string>", "driver_terms": "array<string>",
    "cost": "bigint",
}


def search_batch(
    catalog: DataFrame, index: SearchIndex | None, queries: DataFrame,
    candidate_limit: int = FETCH_LIMIT,
) -> SearchResult:
    """Answer every row of a QUERY table.

    All queries share one catalog scan. A record is paired only with queries that
    share a join key with it: a piece of text for literal and wildcard queries, a repo
    for browsing within repos, a term of the rarest token for token queries. Each pair
    is then verified in the row. Query ids must be unique. When the driving postings are few, they are fetched from the index instead.
    """
    prepared = freeze(m.prepare_queries(queries))
    profile = prepared.agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("query_id").alias("n_ids"),
        F.count_if(F.col("mode") == "token").alias("n_token"),
        F.collect_set(F.when(F.col("gram") != "", F.length("gram"))).alias("lengths"),
        F.collect_set("pairing.kind").alias("kinds"),
        F.coalesce(F.max(F.size("q_tokens")), F.lit(0)).alias("words"),
        F.coalesce(F.max("last_row"), F.lit(0)).alias("last_row"),
        row_bytes("*").alias("bytes"), *used_filters(),
    ).first().asDict()

    if profile["n_ids"] != profile["n"]:
        raise ValueError("query ids must be unique and not NULL")
    record = _record_columns(catalog)
    records = catalog.select(*record).withColumns(m.searchable())
    if any(profile["uses_" + f] for f in FOLDER_FIELDS):
        records = records.withColumn("up", up_paths(F.col("folder")))
    pairs, keys, probes = [], [], []
    full = prepared
    simple, plan_bytes, driver_bytes = True, 0, 0
    if profile["n_token"]:
        if index is None:
            raise ValueError("token queries need a search index")
        plan = token_plan(prepared, index.vocab, profile["bytes"])
        size = plan.agg(
            F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("cost"), F.lit(0)).alias("cost"),
            F.coalesce(F.max(F.size("token_terms")), F.lit(0)).alias("words"),
            F.coalesce(F.max(F.size("driver_terms")), F.lit(0)).alias("terms"),
            F.collect_set("scope").alias("scopes"),
            row_bytes("*").alias("bytes"), row_bytes("query_id", "scope", "driver_terms").alias("driver_bytes"),
            # Upper bound of the fetched rows: ids, and the longest term that can lead to them.
            F.coalesce(F.sum(F.col("cost") * (32 + F.length(F.array_join("driver_terms", "")))), F.lit(0))
            .alias("fetched_bytes"),
        ).first()
        # One exact token each: the join on that token is the whole match.
        simple = size["words"] <= 1 and size["terms"] <= 1
        full = prepared.join(plan.drop("scope"), "query_id", "left")
        driving = plan.select("query_id", "scope", F.explode("driver_terms").alias("term"))
        plan_bytes, driver_bytes = size["bytes"], 64 * size["n"] + 4 * size["driver_bytes"]
        if size["cost"] <= candidate_limit and size["fetched_bytes"] <= BROADCAST_BYTES:
            pairs.append(_fetched(records, index, driving, driver_bytes, simple))
        else:
            probes.append(driving.select(F.col("scope").alias("kind"), F.col("term").alias("key"), "query_id"))
            keys += [(s, tokens(scope_text(s))) for s in SCOPES if s in size["scopes"]]
    else:
        full = full.withColumns({n: F.lit(None).cast(kind) for n, kind in _TERM_FIELDS.items()})
    if profile["kinds"]:
        offered = {"repo": F.array("repo"), "every": F.array(F.lit(""))}
        if profile["lengths"]:
            offered["gram"] = m.grams(sorted(profile["lengths"]))
        keys += [(kind, offered[kind]) for kind in sorted(profile["kinds"])]
        probes.append(
            prepared.select("pairing.kind", F.explode("pairing.keys").alias("key"), "query_id")
        )
    if probes:
        pairs.append(_paired_by_key(records, keys, probes, driver_bytes + profile["bytes"], simple))
    if not pairs:
        nothing = {"query_id": "bigint", "term": "string", "held": "array<string>"}
        pairs.append(
            records.filter(F.lit(False)).withColumns({n: F.lit(None).cast(t) for n, t in nothing.items()})
        )
    paired = reduce(DataFrame.unionByName, pairs)

    asked = full.select(
        "query_id", "mode", "q_lc", "pattern", "head_run", "tail_run", "q_tokens", "search_folders",
        "sort", "page", "page_size", "first_row", "last_row", *FILTER_FIELDS, *_TERM_FIELDS,
        F.coalesce(F.col("unfiltered") & _one_exact_term(), F.lit(False)).alias("known"),
    )
    asked_bytes = profile["bytes"] + plan_bytes

    def hits(of: DataFrame) -> DataFrame:
        return _verified(paired.join(broadcast_if_small(of, asked_bytes), "query_id"), profile, simple)

    matched = hits(asked.drop("known"))
    # The vocabulary already counts the hits of one exact token without filters.
    counted = hits(asked.filter(~F.col("known")).drop("known"))
    totals = (
        asked.select("query_id", "page", "page_size", F.when(F.col("known"), F.col("cost")).alias("df"))
        .join(_hits_of(counted), "query_id", "left")
        .select("query_id", "page", "page_size", F.coalesce("df", "hits", F.lit(0)).alias("total"))
    )
    return SearchResult(_batch_page(matched, record, profile["last_row"]), totals, matched)


# Parts into which the hits of a popular query are dealt before they are counted.
COUNT_PARTS = 64


def _hits_of(counted: DataFrame) -> DataFrame:
    """query_id, hits. Counted by parts of the record order first, so no query has all its hits in one task."""
    part = F.pmod(F.xxhash64("ord"), F.lit(COUNT_PARTS)).alias("part")
    partial = counted.groupBy("query_id", part).agg(F.count(F.lit(1)).alias("n"))
    return partial.groupBy("query_id").agg(F.sum("n").alias("hits"))


def _one_exact_term():
    one = (F.size("token_terms") == 1) & (F.size("driver_terms") == 1)
    return one & (F.get("driver_terms", F.lit(0)) == F.get("q_tokens", F.lit(0)))


def _fetched(records, index, driving, size: int, simple: bool) -> DataFrame:
    """Records of the driving terms by way of the postings, when those are few."""
    terms = driving.withColumnRenamed("term", "token")
    found = index.postings.join(broadcast_if_small(terms, size), ["scope", "token"]).select(
        "query_id", "ord", "scope", F.col("token").alias("term")
    )
    pairs = records.join(F.broadcast(found), "ord")
    if simple:
        return pairs.drop("scope").withColumn("held", F.lit(None).cast("array<string>"))
    # Generating the one-element array fixes the tokens as a column, so that the
    # tests below read them instead of deriving them again.
    held = F.explode(F.array(m.record_tokens(F.col("scope") == "all")))
    return pairs.select("*", held.alias("held")).drop("scope")


def _paired_by_key(records, keys: list, probes: list, size: int, simple: bool) -> DataFrame:
    """Pair records and queries over the keys they share, in one pass over the catalog."""
    none = F.lit(None).cast("array<string>")
    kinds = F.array(
        *[F.struct(F.lit(kind).alias("kind"), values.alias("values")) for kind, values in keys]
    )
    keyed = records.select("*", F.explode(kinds).alias("k")).select(
        *records.columns, F.col("k.kind").alias("kind"),
        (none if simple else F.when(F.col("k.kind").isin(*SCOPES), F.col("k.values"))).alias("held"),
        F.explode("k.values").alias("key"),
    )
    wanted = broadcast_if_small(reduce(DataFrame.union, probes), size)
    return keyed.join(wanted, ["kind", "key"]).withColumn(
        "term", F.when(F.col("kind").isin(*SCOPES), F.col("key"))
    ).drop("kind", "key")


def _verified(joined: DataFrame, profile: dict, simple: bool) -> DataFrame:
    """Keep true matches that pass their query's filters; add score and tie."""
    query = {
        c: F.col(c)
        for c in ("q_lc", "pattern", "head_run", "tail_run", "q_tokens", "search_folders", *FILTER_FIELDS, *_TERM_FIELDS)
    }
    mode, held, words = F.col("mode"), F.col("held"), profile["words"]
    if simple:
        holds, tie = F.lit(True), F.lit(0)
    else:
        # A record found by several terms of the driving token counts for the first only.
        holds = m.terms_match(query["token_terms"], held, words) & (
            m.first_held(query["driver_terms"], held) == F.col("term")
        )
        tie = F.when(mode == "token", m.match_tie(query["first_terms"], held)).otherwise(0)
    hit = (
        F.when(mode == "all", F.lit(True))
        .when(mode == "token", holds)
        .otherwise(m.literal_match(query, mode == "wildcard"))
    )
    row = {**_record(), "up": F.col("up")}
    return joined.filter(passes_used_filters(row, query, profile)).filter(hit).withColumns(
        {"score": m.relevance(query["q_tokens"], query["search_folders"], words), "tie": tie}
    )


def _batch_page(matched: DataFrame, record: list, last_row: int) -> DataFrame:
    """The asked rows of every query, with their 1-based position."""
    wanted = matched.select(
        "query_id", *record, "score", "tie", "sort", "first_row", "last_row"
    )
    group_limit = int(
        matched.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")
    )
    if last_row <= group_limit:
        # The constant bound lets every task drop rows past it before the shuffle.
        by_query = Window.partitionBy("query_id").orderBy(*m.batch_result_order())
        placed = wanted.withColumn("position", F.row_number().over(by_query)).filter(
            F.col("position") <= max(last_row, 1)
        )
    else:
        placed = sorted_position_in_group(wanted, ["query_id"], m.batch_result_order(), "position")
    return placed.filter(F.col("position").between(F.col("first_row"), F.col("last_row"))).select(
        "query_id", F.col("position").cast("bigint").alias("position"), "score", *record
    )


# Postings whose ords are written into the plan of a single query.
LISTED_ORDS = 1000


# Blocks in which one record of so many is a candidate are read as ranges.
DENSE = 64
# Ords of an intersection that come back to be written into the plan; more are joined.
FETCHED_ORDS = 20_000


def _met_blocks(index: SearchIndex, scope: str, lists: list) -> list | None:
    """(block, most) rows where all lists meet; None if too much is left for the index to pay."""
    met = b.common_blocks(index.blocks, scope, lists).limit(b.LISTED_BLOCKS + 1).collect()
    if len(met) > b.LISTED_BLOCKS or sum(r["most"] for r in met) > FETCH_LIMIT:
        return None
    return met


def _in_ranges(numbers: list, span: int = b.BLOCK_SPAN):
    """Predicate on ord for blocks: neighbours become one range."""
    ranges = []
    for n in sorted(numbers):
        if ranges and ranges[-1][1] == n:
            ranges[-1][1] = n + 1
        else:
            ranges.append([n, n + 1])
    held = [(F.col("ord") >= low * span) & (F.col("ord") < high * span) for low, high in ranges]
    return reduce(or_, held, F.lit(False))


def _of_blocks(found: DataFrame, index: SearchIndex, scope: str, lists: list, met: list) -> tuple[DataFrame, int | None]:
    """The records whose ords stand in all lists, and their number where it is known."""
    numbers = [r["block"] for r in met]
    common = b.intersect(index.blocks, scope, lists, numbers)
    if sum(r["most"] for r in met) <= FETCHED_ORDS:
        ords = sorted(o for r in common.collect() for o in r["ords"])
        if len(ords) <= LISTED_ORDS:
            return found.filter(F.col("ord").isin(ords)), len(ords)
    ords = freeze(common.select(F.explode("ords").alias("of")))
    # FETCH_LIMIT of them at most.
    return found.filter(_in_ranges(numbers)).join(F.broadcast(ords), F.col("ord") == F.col("of"), "left_semi"), ords.count()


def _by_blocks(found: DataFrame, index: SearchIndex, asked, terms: dict) -> tuple | None:
    """:func:`_token_hits` by intersected blocks: records outside the intersection are not read."""
    words = list(asked["q_tokens"])
    lists = [[t for t, _ in terms[w]] for w in words]
    met = _met_blocks(index, asked["scope"], lists)
    if met is None:
        return None
    hits, total = _of_blocks(found, index, asked["scope"], lists, met)
    known = total if asked["unfiltered"] else None
    if lists == [[w] for w in words]:
        return hits, F.lit(0), known, met if total > LISTED_ORDS else None
    if len(lists[0]) == 1:
        return hits, F.lit(0), known, None
    ties = b.first_held(index.blocks, asked["scope"], lists[0], [r["block"] for r in met])
    size = 16 * sum(df for _, df in terms[words[0]])
    ranked = ties.select(F.col("ord").alias("tied"), F.col("tie").alias("place"))
    return hits.join(broadcast_if_small(ranked, size), F.col("ord") == F.col("tied")).drop("tied"), F.col("place"), known, None


# Blocks that the first round of a top list reads; every further round reads four times as many.
FIRST_BLOCKS = 1


def _best_ords(found: DataFrame, index: SearchIndex, asked, met: list, score) -> list:
    """(score, ord) of the asked page in order of relevance, from as few blocks as its scores allow.

    Blocks are read in the order of the greatest score that they can hold. Once the last row of the page is better than what any
    other block can hold (or as good and earlier in record order), the others are left out.
    """
    lists = [[w] for w in asked["q_tokens"]]
    waiting = sorted(met, key=lambda r: (-r["bound"], r["block"]))
    best, size, last = [], FIRST_BLOCKS, asked["last_row"]
    while waiting:
        part, waiting = waiting[:size], waiting[size:]
        size *= 4
        hits = _of_blocks(found, index, asked["scope"], lists, part)[0]
        top = hits.select((-score).alias("less"), "ord").orderBy("less", "ord").limit(last).collect()
        # No more than the rows up to the asked page are held.
        best = sorted(best + [(r["less"], r["ord"]) for r in top])[:last]
        if len(best) == last:
            less, ord_ = best[-1]
            waiting = [r for r in waiting if -r["bound"] < less or (-r["bound"] == less and r["block"] * b.BLOCK_SPAN <= ord_)]
    return [(-less, ord_) for less, ord_ in best[asked["first_row"] - 1:]]


def _listed_page(records: DataFrame, rows: list, first: int) -> DataFrame:
    """Records of (score, ord) rows, with positions from ``first`` on."""
    if not rows:
        return records.filter(F.lit(False)).select(F.lit(0).cast("bigint").alias("position"), F.lit(0).alias("score"), *records.columns)
    placed = {o: (first + i, score) for i, (score, o) in enumerate(rows)}
    position, score = (
        F.element_at(F.create_map(*[F.lit(x) for o, held in placed.items() for x in (o, held[at])]), F.col("ord")) for at in (0, 1)
    )
    chosen = records.filter(F.col("ord").isin(list(placed)))
    return chosen.select(position.cast("bigint").alias("position"), score.alias("score"), *records.columns)


def _text_pieces(asked) -> list:
    """Grams that a record must have to match a literal or wildcard query."""
    runs = re.split("[*?]+", asked["q_lc"]) if asked["mode"] == "wildcard" else [asked["q_lc"]]
    return sorted({run[i:i + b.GRAM] for run in runs for i in range(len(run) - b.GRAM + 1)})


def _by_grams(found: DataFrame, index: SearchIndex | None, asked, repo_hit) -> DataFrame:
    """Records that can match a literal or wildcard query, as far as the stored grams tell.

    A query that matches a repo name takes all its records, and one without a gram any record: those scan.
    """
    if index is None or index.blocks is None or index.repos is None:
        return found
    pieces = _text_pieces(asked)
    if not pieces or not index.repos.select(F.lower("repo").alias("repo_lc")).filter(repo_hit).isEmpty():
        return found
    lists = [[piece] for piece in pieces]
    met = _met_blocks(index, b.GRAM_SCOPE, lists)
    if met is None:
        return found
    most = sum(r["most"] for r in met)
    if most > LISTED_ORDS and most * DENSE > len(met) * b.BLOCK_SPAN:
        # Every block holds many candidates: reading its range is as good as looking them up.
        return found.filter(_in_ranges([r["block"] for r in met]))
    return _of_blocks(found, index, b.GRAM_SCOPE, lists, met)[0]


def _terms(index: SearchIndex, asked) -> dict | None:
    """(term, df) of every token of one query, near terms for those that have no postings; None if one has none."""
    words = list(asked["q_tokens"])
    vocab = index.vocab.filter(F.col("scope") == asked["scope"])
    # One row per query token, and at most the fuzzy limit per misspelt token, come back.
    exact = {r["token"]: r["df"] for r in vocab.filter(F.col("token").isin(words)).select("token", "df").collect()}
    terms = {w: [(w, exact[w])] for w in words if w in exact}
    for w in (w for w in words if w not in exact):
        used = fuzzy_terms_of(w, vocab).orderBy("term_pos").collect()
        if not used:
            return None
        terms[w] = [(r["term"], r["df"]) for r in used]
    return terms


def _token_hits(found: DataFrame, index: SearchIndex, asked) -> tuple:
    """Records holding all tokens of one query, their match order, their number if known, and blocks that bound scores."""
    scope, words = asked["scope"], list(asked["q_tokens"])
    terms = _terms(index, asked)
    # A query of no tokens (signs that are neither letters nor digits are none) has no hits either.
    if not terms:
        return found.filter(F.lit(False)), F.lit(0), None, None
    missing = [w for w in words if [t for t, _ in terms[w]] != [w]]
    if index.blocks is not None:
        hits = _by_blocks(found, index, asked, terms)
        if hits is not None:
            return hits
    cost = {w: sum(df for _, df in terms[w]) for w in words}
    driver = min(words, key=cost.get)
    if cost[driver] <= FETCH_LIMIT:
        ords = index.postings.filter(
            (F.col("scope") == scope) & F.col("token").isin([t for t, _ in terms[driver]])
        ).select("ord")
        if cost[driver] <= LISTED_ORDS:
            found = found.filter(F.col("ord").isin([r["ord"] for r in ords.collect()]))
        else:
            found = found.join(F.broadcast(ords), "ord", "left_semi")
    if not missing:
        text = F.lower(scope_text(scope))
        total = cost[driver] if len(words) == 1 and asked["unfiltered"] else None
        return found.filter(reduce(and_, [m.token_held(text, w) for w in words])), F.lit(0), total, None
    lists = [[t for t, _ in terms[w]] for w in words]
    held = found.withColumn("held", F.explode(F.array(tokens(scope_text(scope)))))
    hits = held.filter(m.terms_match(F.lit(lists), F.col("held"), len(words)))
    return hits, m.match_tie(F.lit(lists[0]), F.col("held")), None, None


def _only_repo(asked) -> str | None:
    """The repo of a browse query that has no other filter; the empty text if it has none at all."""
    if asked["unfiltered"]:
        return ""
    repos = set(asked["repos"] or [])
    others = any(asked[f] for f in ("extensions", *FOLDER_FIELDS)) or asked["min_size"] is not None or asked["max_size"] is not None
    return repos.pop() if len(repos) == 1 and not others else None


def _prepared_page(records: DataFrame, entries: DataFrame, asked, repo: str) -> SearchResult:
    """A page of everything, or of one repo, from the prepared orders: no scan and no sort of the catalog."""
    listing = asked["sort"] if asked["sort"] in ("name", "size") else "relevance"
    if not asked["unfiltered"]:
        listing = "repo_" + listing
        records = records.filter(F.col("repo") == repo)
    order = entries.filter((F.col("listing") == listing) & (F.col("repo") == repo))
    page = order.filter(F.col("rank").between(asked["first_row"], asked["last_row"])).select("ord", "rank")
    # One page of ords reaches the driver and becomes a predicate on the stored ranges.
    ords = [r["ord"] for r in page.collect()]
    scored = records.withColumns({"score": F.lit(0), "tie": F.lit(0)})
    rows = scored.filter(F.col("ord").isin(ords)).join(F.broadcast(page), "ord").select(
        F.col("rank").cast("bigint").alias("position"), "score", *records.columns
    )
    totals = order.agg(F.coalesce(F.max("rank"), F.lit(0)).cast("bigint").alias("total")).select(
        "total", F.lit(asked["page"]).alias("page"), F.lit(asked["page_size"]).alias("page_size")
    )
    return SearchResult(rows, totals, scored)


def _in_folders(catalog: DataFrame, index: SearchIndex | None, asked) -> DataFrame:
    """The catalog, or for a folder filter the ranges of the records by folder that it names."""
    if index is None or index.by_folder is None or not set(_record_columns(catalog)) <= set(index.by_folder.columns):
        return catalog
    inside = folder_interval(
        index.folder_numbers, asked["folder_match_mode"], *[asked[f] for f in FOLDER_FIELDS]
    )
    return catalog if inside is None else index.by_folder.filter(inside)


def search_facets(catalog: DataFrame, index: SearchIndex | None = None, has_text: bool = False, **params) -> DataFrame:
    """(facet, value, count) of the hits of one query: repos, extensions, and records with a text rendition.

    With bitmaps, and no other filters than repos, extensions and ``has_text``, neither browsing nor a token query reads records.
    """
    asked = _asked(catalog.sparkSession, params)
    plain = not any(asked[f] for f in FOLDER_FIELDS) and asked["min_size"] is None and asked["max_size"] is None
    if index is not None and index.bitmaps is not None and plain and asked["mode"] in ("all", "token"):
        known, hits = True, None
        if asked["mode"] == "token":
            terms = _terms(index, asked)
            lists = terms and [[t for t, _ in terms[w]] for w in asked["q_tokens"]]
            met = _met_blocks(index, asked["scope"], lists) if lists else []
            known = met is not None
            if known:
                common = b.intersect(index.blocks, asked["scope"], lists or [[]], [r["block"] for r in met])
                hits = bitmaps.ord_bitmaps(common.select(F.explode("ords").alias("ord")))
        if known:
            matched = bitmaps.matching_bitmaps(index.bitmaps, hits, asked["repos"], asked["extensions"], has_text)
            return bitmaps.facet_counts(index.bitmaps, matched)
    matched = search(catalog, index, **params).matched
    rows = matched.filter("has_txt") if has_text else matched
    held = F.array(
        F.struct(F.lit("repo").alias("facet"), F.col("repo").alias("value")),
        F.struct(F.lit("ext").alias("facet"), F.lower(F.coalesce("ext", F.lit(""))).alias("value")),
        F.when(F.col("has_txt"), F.struct(F.lit("text").alias("facet"), F.lit("").alias("value"))),
    )
    return rows.select(F.inline(F.array_compact(held))).groupBy("facet", "value").agg(F.count(F.lit(1)).alias("count"))


def _by_bitmaps(asked) -> bool:
    """Whether a query lists records in corpus order under filters that bitmaps hold."""
    others = any(asked[f] for f in FOLDER_FIELDS) or asked["min_size"] is not None or asked["max_size"] is not None
    return asked["mode"] == "all" and asked["sort"] not in ("name", "size") and not others


def _ranked_page(records: DataFrame, stored: DataFrame, asked) -> SearchResult:
    """A page of a filtered listing in corpus order: ranks come from counts of bits, records from one page of ords."""
    matched = bitmaps.matching_bitmaps(stored, None, asked["repos"], asked["extensions"])
    page = bitmaps.ords_between(matched, F.lit(asked["first_row"]), F.lit(asked["last_row"]))
    # At most one page of ords reaches the driver.
    rows = _listed_page(records, [(0, r["ord"]) for r in page.orderBy("position").collect()], asked["first_row"])
    totals = bitmaps.matched_count(matched).select(
        F.col("count").alias("total"), F.lit(asked["page"]).alias("page"), F.lit(asked["page_size"]).alias("page_size")
    )
    every = records.filter(passes_filters(_record(), {f: asked[f] for f in FILTER_FIELDS}))
    return SearchResult(rows, totals, every.withColumns({"score": F.lit(0), "tie": F.lit(0)}))


# Rows a single page query may skip before it ranks by a distributed sort instead.
DEEP_PAGE_ROWS = 1000


def _asked(spark, params: dict):
    """One prepared query row."""
    row = {"query_id": 0, **params}
    unknown = set(row) - {f.split()[0] for f in QUERY.split(", ")}
    if unknown:
        raise ValueError(f"unknown query fields: {sorted(unknown)}")
    fields = [f.split()[0] for f in QUERY.split(", ")]
    one = spark.createDataFrame([tuple(row.get(f) for f in fields)], QUERY)
    return m.prepare_queries(one).first()


def search(catalog: DataFrame, index: SearchIndex | None = None, **params) -> SearchResult:
    """Answer one query; ``params`` are fields of the QUERY schema.

    The query becomes literals of the plan, so repo, folder and size filters reach
    the Parquet scan and the page is a plain top-k.
    """
    spark = catalog.sparkSession
    asked = _asked(spark, params)
    record = _record_columns(catalog)
    if index is not None and index.browse is not None and asked["mode"] == "all" and _only_repo(asked) is not None:
        return _prepared_page(catalog.select(*record), index.browse, asked, _only_repo(asked))
    if index is not None and index.bitmaps is not None and _by_bitmaps(asked):
        return _ranked_page(catalog.select(*record), index.bitmaps, asked)
    folders = F.lit(asked["search_folders"])
    found = _in_folders(catalog, index, asked).select(*record).filter(
        passes_filters(_record(), {f: asked[f] for f in FILTER_FIELDS})
    ).withColumns(m.searchable())
    tie, total, bounds = F.lit(0), None, None
    every = found
    if asked["mode"] in ("literal", "wildcard"):
        literals = {c: F.lit(asked[c]) for c in ("q_lc", "pattern", "head_run", "tail_run")}
        wildcard = F.lit(asked["mode"] == "wildcard")
        found = _by_grams(found, index, asked, m.field_hit(F.col("repo_lc"), literals, wildcard))
        found = found.filter(m.literal_match({**literals, "search_folders": folders}, wildcard))
    elif asked["mode"] == "token":
        if index is None:
            raise ValueError("token queries need a search index")
        found, tie, total, bounds = _token_hits(found, index, asked)
    words = list(asked["q_tokens"])
    score = m.relevance(F.lit(words).cast("array<string>"), folders, len(words))
    matched = found.withColumns({"score": score, "tie": tie}).select(*record, "score", "tie")
    order = m.result_order(asked["sort"])
    first, last = asked["first_row"], asked["last_row"]
    if bounds is not None and asked["sort"] not in ("name", "size") and last <= DEEP_PAGE_ROWS:
        rows = _listed_page(catalog.select(*record), _best_ords(every, index, asked, bounds, score), first)
    elif last <= DEEP_PAGE_ROWS:
        page = matched.orderBy(*order).offset(first - 1).limit(asked["page_size"])
        # At most one page of rows reaches this window.
        in_page = Window.partitionBy(F.lit(0)).orderBy(*order)
        rows = page.withColumn("position", F.row_number().over(in_page) + F.lit(first - 1))
    else:
        rows = sorted_position(matched, order, "position").filter(
            F.col("position").between(first, last)
        )
    rows = rows.select(F.col("position").cast("bigint").alias("position"), "score", *record)
    counted = (
        matched.agg(F.count(F.lit(1)).alias("total")) if total is None
        else spark.range(1).select(F.lit(total).cast("bigint").alias("total"))
    )
    totals = counted.select(
        "total", F.lit(asked["page"]).alias("page"), F.lit(asked["page_size"]).alias("page_size")
    )
    return SearchResult(rows, totals, matched)
