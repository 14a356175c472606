"""Registered queries: every operator over whole test tables.

Keys start with the operator id of the survey. Results are flat columns, so that
they can be compared with SQL row by row.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalogspark.functions import categories, links, paths, predicates, sizes, text
from catalogspark.operators import catalog as records
from catalogspark.operators import bitmaps, facets, fuzzy, index, intervals, matching, sampling, tree
from catalogspark.plans import increments, publish, search
from catalogspark.schema import QUERY
from catalogspark.sources import compact, snapshots, tables
from catalogspark.streaming import recent

part = tables.part_catalog
SHARD_ROWS = 300


def _flat(df: DataFrame, *more: str) -> DataFrame:
    """Catalog rows with the folder as one string."""
    return df.select(
        "ord", "repo", "file", "ext", paths.folder_path(F.col("folder")).alias("folder_path"),
        "size", "has_txt", *more,
    )


def _with_path(df: DataFrame) -> DataFrame:
    return df.withColumn("folder_path", paths.folder_path(F.col("folder")))


def _ords(df: DataFrame) -> DataFrame:
    return df.select("ord", "repo", "file")


# --- sources and sinks -------------------------------------------------------------


def _stored_corpus(spark, sf_dir) -> DataFrame:
    path = tables.scratch(spark, "corpus")
    tables.write_compact(part(spark, sf_dir), path, SHARD_ROWS)
    return compact.read_compact(spark, path)


def src1(spark, sf_dir):
    return _stored_corpus(spark, sf_dir).select(
        "shard", F.col("v").alias("version"), F.size("rp").cast("bigint").alias("repos"),
        F.size("fd").cast("bigint").alias("folders"), F.size("rc").cast("bigint").alias("records"),
    )


def src2(spark, sf_dir):
    return _flat(compact.decode_compact(_stored_corpus(spark, sf_dir)))


def _first_pages(spark, sf_dir) -> DataFrame:
    path = tables.scratch(spark, "first-pages")
    publish.write_first_pages(part(spark, sf_dir), path)
    return snapshots.read_first_pages(spark, path)


def src3(spark, sf_dir):
    return _first_pages(spark, sf_dir).select(
        "mode", F.coalesce("page_repo", F.lit("")).alias("page_repo"), "total",
        F.col("row").cast("bigint").alias("row"), "repo", "file", "ext",
        paths.folder_path(F.col("folder")).alias("folder_path"), "size", "has_txt",
    )


def src4(spark, sf_dir):
    path = tables.scratch(spark, "listings")
    publish.write_root_listings(part(spark, sf_dir), path)
    listed = snapshots.read_root_listings(spark, f"{path}/repos")
    folders = listed.select("repo", F.explode("folders").alias("e")).select(
        "repo", F.lit("folder").alias("kind"), F.col("e.name").alias("name"),
        F.col("e.path").alias("path"), F.col("e.count").alias("count"),
        F.lit("").alias("ext"), F.lit(None).cast("boolean").alias("has_txt"), F.lit(None).cast("bigint").alias("size"),
    )
    files = listed.select("repo", F.explode("files").alias("e")).select(
        "repo", F.lit("file").alias("kind"), F.col("e.name").alias("name"), F.col("e.name").alias("path"),
        F.lit(None).cast("bigint").alias("count"), F.col("e.ext").alias("ext"),
        F.col("e.has_txt").alias("has_txt"), F.col("e.size").alias("size"),
    )
    return folders.union(files)


def src5(spark, sf_dir):
    root = tables.scratch(spark, "generations")
    catalog = part(spark, sf_dir)
    publish.replace_corpus(catalog.filter("has_txt"), root)
    generation = publish.replace_corpus(catalog, root)
    stored = publish.read_published(spark, root, "catalog", generation)
    return _flat(stored, F.col("generation").cast("bigint").alias("generation"))


def snk1(spark, sf_dir):
    return publish.first_pages(part(spark, sf_dir)).select(
        "version", "mode", F.coalesce("repo", F.lit("")).alias("page_repo"), "sort", "page", "page_size", "total",
        F.size("results").cast("bigint").alias("rows"),
        F.array_join(F.col("results.File"), "|").alias("files"),
    )


def snk2(spark, sf_dir):
    docs = publish.root_listings(part(spark, sf_dir), part_entries=25)
    return docs.select(
        "repo", "part",
        F.array_join(F.transform("folders", lambda f: F.concat(f["n"], F.lit("="), f["c"].cast("string"))), "|")
        .alias("folders"),
        F.array_join(F.transform("files", lambda f: F.concat(f["n"], F.lit("."), f["e"])), "|").alias("files"),
    )


def snk3(spark, sf_dir):
    path = tables.scratch(spark, "pages")
    publish.write_first_pages(part(spark, sf_dir), path)
    docs = publish.manifest(spark, path, "/data", part_entries=10)
    # File names differ by run. Names are escaped once as folders and once more as urls.
    name = F.url_decode(F.url_decode(F.regexp_extract("url", "page_name=([^/]*)/", 1)))
    return docs.select("part", "version", F.posexplode("urls").alias("row", "url")).select(
        "part", "version", F.col("row").cast("bigint").alias("row"),
        F.regexp_extract("url", "^(/data/page_set=[^/]*)/", 1).alias("page_set"), name.alias("page_name"),
    )


def snk4(spark, sf_dir):
    known = records.with_record_id(part(spark, sf_dir))
    chosen = known.filter("has_txt AND ext = 'pdf'").select("record_id")
    link = links.direct_link(F.col("repo"), F.col("folder"), F.col("file"), F.col("ext"))
    return records.selected_links(known, chosen, link)


# --- derived columns ---------------------------------------------------------------


def _columns(df: DataFrame, **columns) -> DataFrame:
    return df.select("ord", *[c.alias(n) for n, c in columns.items()])


def _cols(*names):
    return [F.col(n) for n in names]


def col1(spark, sf_dir):
    return _columns(part(spark, sf_dir), path=paths.relative_path(*_cols("folder", "file", "ext")))


def col2(spark, sf_dir):
    row = _cols("repo", "folder", "file", "ext")
    explicit = F.when(F.col("has_txt"), F.concat(F.lit("https://e.org/"), "file"))
    return _columns(
        part(spark, sf_dir), direct=links.direct_link(*row), browse=links.browse_link(*row),
        explicit=links.direct_link(*row, explicit),
    )


def col3(spark, sf_dir):
    targets = links.LinkTargets(primary_host="thther.example.org", mirror_host="mirror.example.org")
    pages = tables.table(spark, sf_dir, "pages")
    return pages.select("page_id", links.mirror_link(F.col("url"), targets).alias("mirror"))


def col4(spark, sf_dir):
    return _columns(
        part(spark, sf_dir), text=links.text_link(*_cols("folder", "file", "ext", "has_txt"))
    )


def col5(spark, sf_dir):
    name = F.when(F.col("has_txt"), F.upper(paths.full_name(*_cols("file", "ext")))).otherwise(F.col("file"))
    row = (F.col("repo"), paths.folder_path(F.col("folder")), name, F.col("ext"))
    return _columns(
        part(spark, sf_dir), name=links.browser_file_name(name, F.col("ext")),
        link=links.browser_file_link(*row),
    )


def col6(spark, sf_dir):
    spread = F.col("size") * F.element_at(F.array(*[F.lit(v) for v in (1, 1000, 1000000)]), F.pmod("ord", F.lit(3)).cast("int") + 1)
    return _columns(part(spark, sf_dir), small=sizes.human_size(F.floor(F.col("size") / 10000)), large=sizes.human_size(spread))


def col7(spark, sf_dir):
    wide = sizes.compact_size(F.col("size") * 1000)
    narrow = sizes.compact_size(F.floor(F.col("size") / 1000))
    return _columns(
        part(spark, sf_dir), value=wide["value"], unit=wide["unit"], narrow_value=narrow["value"],
        narrow_unit=narrow["unit"], glued=sizes.compact_size_text(F.col("size")),
    )


def col8(spark, sf_dir):
    unit = F.get(F.array(*[F.lit(u) for u in ("", "B", "kb", " MB", "Gb", " files", "x1")]), F.pmod("p_partkey", F.lit(7)).cast("int"))
    table = tables.table(spark, sf_dir, "part").withColumn("entry", F.concat(F.col("p_retailprice").cast("string"), unit))
    return table.select(
        F.col("p_partkey").alias("ord"), sizes.parse_size(F.col("entry")).alias("bytes"),
        sizes.size_from_input(F.col("p_size") - 10, F.lit("MB")).alias("entered"),
    )


def col9(spark, sf_dir):
    pages = tables.page_catalog(spark, sf_dir).select("ord", "ext", F.lit("pages").alias("origin"))
    parts = part(spark, sf_dir).select("ord", "ext", F.lit("part").alias("origin"))
    return pages.union(parts).select("origin", "ord", categories.file_category(F.col("ext")).alias("category"))


def col10(spark, sf_dir):
    return part(spark, sf_dir).select(
        "ord", F.posexplode(paths.breadcrumb(F.col("folder"))).alias("depth", "step")
    ).select("ord", F.col("depth").cast("bigint").alias("depth"), F.col("step.label").alias("label"), F.col("step.path").alias("path"))


def col11(spark, sf_dir):
    docs = tables.table(spark, sf_dir, "documents")
    return docs.select("doc_id", text.highlight(F.col("text"), F.lit(" An  th' ar ")).alias("marked"))


def col12(spark, sf_dir):
    return records.with_record_id(part(spark, sf_dir)).select("ord", "occurrence", "record_id")


def col12_hot(spark, sf_dir):
    """Thousands of copies of a few names, cut into narrow ord ranges."""
    return records.with_record_id(tables.event_catalog(spark, sf_dir), span=500).select(
        "ord", "occurrence", "record_id"
    )


def col13(spark, sf_dir):
    raw = F.concat(F.lit("//"), paths.folder_path(F.col("folder")), F.lit("/"), F.when(F.col("has_txt"), "/").otherwise(""))
    return _columns(part(spark, sf_dir), path=paths.clean_path(raw), missing=paths.clean_path(F.when(F.col("has_txt"), raw)))


# --- text analysis and index -------------------------------------------------------

CJK_LETTERS = ("aeiou", "资本论列宁")


def tok1(spark, sf_dir):
    docs = tables.table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.explode(text.tokens(F.col("text"))).alias("token"))


def tok1_cjk(spark, sf_dir):
    name = F.translate("file", *CJK_LETTERS)
    return part(spark, sf_dir).select("ord", F.posexplode(text.tokens(name)).alias("pos", "token")).select(
        "ord", F.col("pos").cast("bigint").alias("pos"), "token"
    )


def _postings(scope):
    def query(spark, sf_dir):
        return index.postings(tables.document_catalog(spark, sf_dir), (scope,)).select("ord", "token")

    return query


def _vocab(spark, sf_dir) -> DataFrame:
    return index.vocabulary(index.postings(part(spark, sf_dir)))


def idx3(spark, sf_dir):
    return index.ranked_vocabulary(_vocab(spark, sf_dir)).select("scope", "token", "df", "vocab_rank")


# --- filters -----------------------------------------------------------------------


def _filter(condition):
    def query(spark, sf_dir):
        return _flat(_with_path(part(spark, sf_dir)).filter(condition()))

    return query


flt1 = _filter(lambda: predicates.repo_in(F.col("repo"), ["shop/Brand#12", "shop/Brand#3"]))
flt1_short = _filter(
    lambda: predicates.repo_in(
        F.col("repo"), predicates.qualify_repos(F.array(F.lit("Brand#12"), F.lit("shop/Brand#3")), "shop")
    )
)
flt2 = _filter(lambda: predicates.extension_in(F.col("ext"), ["pdf", "DJVU", "txt"]))
flt3 = _filter(lambda: predicates.folder_exact(F.col("folder_path"), ["/ECONOMY/", "LARGE/size 7"]))
flt4 = _filter(lambda: predicates.folder_subtree(F.col("folder_path"), ["/ECONOMY/", "SMA", ""]))
flt5 = _filter(
    lambda: predicates.folder_mixed(F.col("folder"), F.col("folder_path"), ["SMALL", "", "LARGE/size 7"], ["/MEDIUM"])
)
flt6 = _filter(lambda: predicates.size_between(F.col("size"), 950000, 1000000))
flt7 = _filter(lambda: F.col("has_txt"))


def flt5_large(spark, sf_dir):
    """Path sets that come as tables: every brand-independent folder seen on pdf records."""
    catalog = _with_path(part(spark, sf_dir))
    own = catalog.filter("ext = 'pdf'").select(F.col("folder_path").alias("path"))
    below = catalog.filter("ext = 'epub' AND repo = 'shop/Brand#2'").select(F.col("folder_path").alias("path"))
    return _flat(tree.filter_mixed_by_table(catalog, own, below))


def flt_all(spark, sf_dir):
    """All filters of a query row at once, from columns of a query table."""
    brands = tables.table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand")).distinct()
    asked = brands.select(
        "brand", F.array(F.concat(F.lit("shop/"), "brand")).alias("repos"),
        F.array(F.lit("pdf"), F.lit("txt"), F.lit("epub")).alias("extensions"),
        F.array(F.lit("ECONOMY"), F.lit("/SMALL/")).alias("folders"), F.lit("subtree").alias("folder_match_mode"),
        F.array().cast("array<string>").alias("folder_selfs"), F.array().cast("array<string>").alias("folder_subtrees"),
        F.lit(910000).cast("bigint").alias("min_size"), F.lit(None).cast("bigint").alias("max_size"),
    )
    catalog = _with_path(part(spark, sf_dir))
    row = {c: F.col(c) for c in ("repo", "ext", "folder", "folder_path", "size")}
    args = {c: F.col(c) for c in asked.columns}
    joined = catalog.join(asked, F.concat(F.lit("shop/"), "brand") == F.col("repo"))
    return joined.filter(predicates.passes_filters(row, args)).select("brand", "ord")


# --- search ------------------------------------------------------------------------


def srch1(spark, sf_dir):
    q = F.get(
        F.array(F.col("file"), F.concat("file", F.lit("."), "ext"), F.lit(" 　 "), F.translate("file", "aeiou", "*?*?*"), F.translate("file", *CJK_LETTERS)),
        F.pmod("ord", F.lit(5)).cast("int"),
    )
    return _columns(
        part(spark, sf_dir), mode=text.search_mode(text.trim_space(q), F.lit(False)),
        exact_mode=text.search_mode(text.trim_space(q), F.lit(True)),
    )


def _hits(result: search.SearchResult) -> DataFrame:
    return result.matched.select(
        "ord", F.col("score").cast("bigint").alias("score"), F.col("tie").cast("bigint").alias("tie")
    )


def _search(source, blocks=False, **params):
    def query(spark, sf_dir):
        catalog = source(spark, sf_dir)
        return _hits(search.search(catalog, search.build_index(catalog, blocks), **params))

    return query


def _page(source, blocks=False, **params):
    def query(spark, sf_dir):
        catalog = source(spark, sf_dir)
        rows = search.search(catalog, search.build_index(catalog, blocks), **params).rows
        return rows.select("position", F.col("score").cast("bigint").alias("score"), "ord", "file")

    return query


def _facets_of(blocks=True, **params):
    def query(spark, sf_dir):
        catalog = part(spark, sf_dir)
        return search.search_facets(catalog, search.build_index(catalog, blocks), **params)

    return query


def flt4_interval(spark, sf_dir):
    """The subtree filter of a search, through the records by folder."""
    catalog = part(spark, sf_dir)
    found = search.search(catalog, search.build_index(catalog, True), q="", folders=["/ECONOMY/", "SMA", ""])
    return _flat(found.matched)


def flt5_interval(spark, sf_dir):
    catalog = part(spark, sf_dir)
    found = search.search(
        catalog, search.build_index(catalog, True), q="", folder_match_mode="mixed",
        folder_selfs=["SMALL", "", "LARGE/size 7"], folder_subtrees=["/MEDIUM"],
    )
    return _flat(found.matched)


def flt4_numbers(spark, sf_dir):
    """Every folder path with its number and that of its last descendant."""
    return intervals.folder_numbers(part(spark, sf_dir))


def hier1_interval(spark, sf_dir):
    catalog = part(spark, sf_dir)
    numbers = intervals.folder_numbers(catalog)
    folders, files = intervals.folder_listing(intervals.with_folder_number(catalog, numbers), numbers, "shop/Brand#13", "/MEDIUM/")
    return _contents(folders, files)


def src5_changes(spark, sf_dir):
    """Half the catalog, then two changes: some records go, others come; parts are merged on the way."""
    catalog = part(spark, sf_dir)
    first, last = catalog.agg(F.min("ord"), F.max("ord")).first()
    middle = (first + last) // 2
    corpus = increments.Corpus(spark, tables.scratch(spark, "increments"), fanout=2)
    generation = corpus.start(catalog.filter(F.col("ord") <= middle))
    step = 1 + (last - middle) // 2
    for i in range(2):
        low = middle + i * step
        generation = corpus.change(
            catalog.filter((F.col("ord") > low) & (F.col("ord") <= low + step)),
            catalog.filter((F.col("ord") <= low) & (F.col("ord") % 10 == i)).select("ord"),
        )
    return corpus, generation


def src5_records(spark, sf_dir):
    corpus, generation = src5_changes(spark, sf_dir)
    return corpus.records(generation).select("ord", "occurrence", "record_id")


def src5_vocabulary(spark, sf_dir):
    corpus, generation = src5_changes(spark, sf_dir)
    return corpus.vocabulary(generation).select("scope", "token", "df", "first_ord")


def src5_facets(spark, sf_dir):
    corpus, generation = src5_changes(spark, sf_dir)
    cube = corpus.cube(generation)
    return cube.select("repo", "ext", "count", "txt_count")


def srch5(spark, sf_dir):
    """Misspelt names: every part word with its middle letter dropped, or cut to two letters."""
    vocab = _vocab(spark, sf_dir)
    word = F.col("token")
    half = F.floor(F.length("token") / 2).cast("int")
    typo = F.concat(F.substring(word, F.lit(1), half), F.substring(word, half + 2, F.length("token")))
    asked = (
        vocab.select("scope", F.explode(F.array(typo, F.concat(word, F.lit("s")), F.substring(word, 1, 2))).alias("token"))
        .filter("token <> ''").distinct()
    )
    return fuzzy.expand_tokens(asked, vocab).select(
        "scope", "token", "term", F.col("term_pos").cast("bigint").alias("term_pos"), "df"
    )


def srch6(spark, sf_dir):
    """Edit distance of neighbouring names, 999 beyond two edits."""
    near = F.lead("p_name").over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    table = tables.table(spark, sf_dir, "part").withColumn("other", near).filter("other IS NOT NULL")
    bounded = F.levenshtein("p_name", "other", fuzzy.MAX_EDITS)
    return table.select(
        F.col("p_partkey").alias("ord"), F.when(bounded < 0, 999).otherwise(bounded).cast("bigint").alias("edits")
    )


def srch7(spark, sf_dir):
    asked = F.translate(F.lower("folder_path"), "/", " ")
    catalog = _with_path(part(spark, sf_dir)).withColumns(matching.searchable())
    words = text.tokens(F.concat(asked, F.lit(" shop "), F.substring("file", 1, 3)))
    # Short token lists are written out; "long_score" takes the form for long ones.
    return catalog.select(
        "ord", matching.relevance(words, F.lit(True), 5).cast("bigint").alias("score"),
        matching.relevance(words, F.lit(False), 5).cast("bigint").alias("file_score"),
        matching.relevance(words, F.lit(True), matching.UNROLLED + 1).cast("bigint").alias("long_score"),
    )


def _sort_of(number):
    """The three sorts, taking turns."""
    names = F.array(F.lit("relevance"), F.lit("name"), F.lit("size"))
    return F.get(names, F.pmod(number, F.lit(3)).cast("int"))



def _query_rows(df: DataFrame, **columns) -> DataFrame:
    """QUERY rows from computed columns; all other fields are NULL."""
    fields = [f.split() for f in QUERY.split(", ")]
    return df.select(
        *[columns.get(n, F.lit(None)).cast(kind).alias(n) for n, kind in fields]
    )


def _batch_rows(result: search.SearchResult) -> DataFrame:
    rows = result.rows.select("query_id", "position", "ord", F.col("score").cast("bigint").alias("score"))
    return rows.join(result.totals.select("query_id", "total"), "query_id")


def srch8_literal(spark, sf_dir):
    """One literal query per brand name, sorts taking turns."""
    brands = tables.table(spark, sf_dir, "part").select("p_brand").distinct()
    number = F.regexp_extract("p_brand", "([0-9]+)$", 1).cast("bigint")
    asked = _query_rows(
        brands, query_id=number, q=F.col("p_brand"), exact=F.lit(False), search_folders=F.lit(True),
        sort=_sort_of(number), page=F.lit(2), page_size=F.lit(20),
        extensions=F.array(F.lit("pdf"), F.lit("txt"), F.lit("epub"), F.lit("zip")),
    )
    return _batch_rows(search.search_batch(part(spark, sf_dir), None, asked))


def _logged_queries(spark, sf_dir) -> DataFrame:
    """One token query per number in the query log; absent numbers need fuzzy terms."""
    logged = tables.query_events(spark, sf_dir).select(F.col("q").cast("bigint").alias("k")).distinct()
    return _query_rows(
        logged, query_id=F.col("k"), q=F.concat(F.col("k").cast("string"), F.lit(" Size red")), exact=F.lit(False),
        search_folders=F.lit(True), sort=_sort_of(F.col("k")),
        page=F.lit(1), page_size=F.lit(25), min_size=F.lit(905000),
    )


def _srch8_tokens(limit):
    def query(spark, sf_dir):
        catalog = part(spark, sf_dir)
        asked = _logged_queries(spark, sf_dir)
        return _batch_rows(
            search.search_batch(catalog, search.build_index(catalog), asked, candidate_limit=limit)
        )

    return query


# --- orders and pages --------------------------------------------------------------


def sort5(spark, sf_dir):
    return publish.with_browse_ranks(part(spark, sf_dir)).select(
        "ord", "corpus_rank", "name_rank", "size_rank", "repo_corpus_rank", "repo_name_rank", "repo_size_rank"
    )


def page1_clamp(spark, sf_dir):
    size = F.col("p_size") * 20 - 100
    return tables.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("ord"), matching.clamp_page_size(size).cast("bigint").alias("page_size"),
        matching.page_number(F.col("p_size") - 10).cast("bigint").alias("page"),
    )


# --- facets ------------------------------------------------------------------------


def _facet(build):
    def query(spark, sf_dir):
        return build(facets.facet_cube(part(spark, sf_dir)))

    return query


def agg4(spark, sf_dir):
    facet = facets.text_facet(facets.facet_cube(part(spark, sf_dir)))
    return facet.select(F.coalesce("repo", F.lit("")).alias("repo"), "count", "available")


def agg5(spark, sf_dir):
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return facets.corpus_metadata(facets.facet_cube(part(spark, sf_dir))).select(
        "facet", blank("repo"), blank("name"), "count"
    )


def agg5_empty(spark, sf_dir):
    none = part(spark, sf_dir).filter("size < 0")
    return facets.corpus_metadata(facets.facet_cube(none)).select("facet", "count")


def sort5_page(spark, sf_dir):
    """Page 2 of all three orders, over everything and within one repo, through the stored tables."""
    root = tables.scratch(spark, "browse")
    generation = publish.replace_corpus(part(spark, sf_dir), root)
    stored = publish.read_published(spark, root, "catalog", generation)
    entries = publish.read_published(spark, root, "browse", generation)
    pages = None
    for sort in ("relevance", "name", "size"):
        for repo in ("", "shop/Brand#7"):
            rank = ("repo_" if repo else "") + publish.BROWSE_RANKS.get(sort, "corpus_rank")
            page = publish.browse_page(stored, entries, sort, repo, page=2, page_size=30).select(
                F.lit(sort).alias("sort"), F.lit(repo).alias("listed"), F.col(rank).cast("bigint").alias("position"), "ord"
            )
            pages = page if pages is None else pages.unionAll(page)
    return pages


def agg6(spark, sf_dir):
    """Extension panel of the catalog, with the page extensions as the selection."""
    counted = facets.extension_facet(facets.facet_cube(part(spark, sf_dir)))
    chosen = tables.page_catalog(spark, sf_dir).select(F.lower("ext").alias("ext"))
    return facets.extension_panel(counted, chosen).select(
        "position", "kind", F.coalesce("ext", F.lit("")).alias("ext"), "kinds", "count"
    )


def agg7(spark, sf_dir):
    cube = facets.facet_cube(part(spark, sf_dir))
    chosen = part(spark, sf_dir).filter("ext LIKE '%p%'").select(F.lower("ext").alias("ext"))
    return facets.facet_complement(facets.extension_facet(cube), chosen, "ext")


def agg7_folders(spark, sf_dir):
    catalog = part(spark, sf_dir)
    nodes = tree.folder_tree(tree.folder_counts(catalog))
    chosen = tree.selectable_paths(nodes).filter("kind = 'subtree' AND length(path) > 12")
    return tree.path_complement(nodes, chosen)


# --- hierarchy, sampling, query log ------------------------------------------------


def hier1(spark, sf_dir):
    return _contents(*tree.folder_contents(part(spark, sf_dir), "shop/Brand#13", "/MEDIUM/"))


def _contents(folders, files) -> DataFrame:
    return folders.select(
        F.lit("folder").alias("kind"), "name", "path", "count", F.lit("").alias("ext"),
        F.lit(None).cast("bigint").alias("size"),
    ).union(
        files.select(
            F.lit("file").alias("kind"), "name", F.lit("").alias("path"), F.lit(None).cast("bigint").alias("count"),
            "ext", "size",
        )
    )


def hier1_all(spark, sf_dir):
    return tree.listing_entries(part(spark, sf_dir)).select(
        "repo", "path", "kind", "name", "count", F.coalesce("ext", F.lit("")).alias("ext"), "size", "ord"
    )


def hier2(spark, sf_dir):
    nodes = tree.folder_tree(tree.folder_counts(part(spark, sf_dir)))
    return nodes.select(
        "repo", "path", F.coalesce("parent_path", F.lit("-")).alias("parent_path"), "name",
        F.col("depth").cast("bigint").alias("depth"), "count", "has_direct_files", "has_children",
        "show_self_toggle", "is_root",
    )


def hier3(spark, sf_dir):
    return part(spark, sf_dir).select("ord", F.explode(paths.ancestors(F.col("folder"))).alias("ancestor"))


def smp1(spark, sf_dir):
    return _ords(sampling.random_record_per_repo(part(spark, sf_dir), 0.37, span=128))


def smp1_text(spark, sf_dir):
    return _ords(sampling.random_record(part(spark, sf_dir), txt_only=True, value=0.81, span=128))


def smp1_bitmaps(spark, sf_dir):
    """One record of every repo, found by counts of bits."""
    catalog = part(spark, sf_dir)
    picked = bitmaps.random_ord_per_repo(bitmaps.facet_bitmaps(catalog), 0.37).select("ord")
    return _ords(catalog.join(picked, "ord", "left_semi"))


def smp1_text_bitmaps(spark, sf_dir):
    catalog = part(spark, sf_dir)
    picked = bitmaps.random_ord(bitmaps.facet_bitmaps(catalog), 0.81, txt_only=True)
    return _ords(catalog.join(picked, "ord", "left_semi"))


def log1(spark, sf_dir):
    return recent.recent_queries(tables.query_events(spark, sf_dir)).select(
        "user_id", "q", "ts", F.col("rank").cast("bigint").alias("rank")
    )


def log1_stream(spark, sf_dir):
    """The same history from a replay of the events as a stream."""
    folder = tables.scratch(spark, "history")
    source = tables.table(spark, sf_dir, "events")
    events = (
        spark.readStream.schema(source.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
        .selectExpr("user_id", "ts", "get_json_object(props, '$.k') AS q")
    )
    stream = recent.start_recent_queries(events, f"{folder}/rows", f"{folder}/state", availableNow=True)
    stream.awaitTermination()
    return recent.read_recent_queries(spark, f"{folder}/rows").select(
        "user_id", "q", "ts", F.col("rank").cast("bigint").alias("rank")
    )


QUERIES = {
    "src1_read_compact_corpus": src1,
    "src2_decode_compact": src2,
    "src3_read_first_pages": src3,
    "src4_read_root_listings": src4,
    "src5_replace_corpus": src5,
    "src5_changed_records": src5_records,
    "src5_changed_vocabulary": src5_vocabulary,
    "src5_changed_facets": src5_facets,
    "snk1_first_pages": snk1,
    "snk2_root_listings": snk2,
    "snk3_manifest": snk3,
    "snk4_selected_links": snk4,
    "col1_relative_path": col1,
    "col2_links": col2,
    "col3_mirror_link": col3,
    "col4_text_link": col4,
    "col5_browser_name": col5,
    "col6_human_size": col6,
    "col7_compact_size": col7,
    "col8_parse_size": col8,
    "col9_category": col9,
    "col10_breadcrumb": col10,
    "col11_highlight": col11,
    "col12_record_id": col12,
    "col12_record_id_hot_copies": col12_hot,
    "col13_clean_path": col13,
    "tok1_tokens": tok1,
    "tok1_tokens_cjk": tok1_cjk,
    "idx1_postings_all": _postings("all"),
    "idx2_postings_file": _postings("file"),
    "idx3_ranked_vocabulary": idx3,
    "flt1_repo": flt1,
    "flt1_repo_short_names": flt1_short,
    "flt2_extension": flt2,
    "flt3_folder_exact": flt3,
    "flt4_folder_subtree": flt4,
    "flt4_folder_subtree_by_interval": flt4_interval,
    "flt4_folder_numbers": flt4_numbers,
    "flt5_folder_mixed": flt5,
    "flt5_folder_mixed_by_interval": flt5_interval,
    "flt5_folder_mixed_tables": flt5_large,
    "flt6_size": flt6,
    "flt7_has_text": flt7,
    "flt_all_from_query_table": flt_all,
    "srch1_mode": srch1,
    "srch2_literal": _search(part, q="ED R", exact=True),
    "srch2_literal_by_blocks": _search(part, blocks=True, q="ED R", exact=True),
    "srch2_literal_documents": _search(tables.document_catalog, q="th.", search_folders=False),
    "srch2_literal_documents_by_blocks": _search(tables.document_catalog, blocks=True, q="th.", search_folders=False),
    "srch3_wildcard": _search(part, q="R?d*g"),
    "srch3_wildcard_by_blocks": _search(part, blocks=True, q="R?d*g"),
    "srch4_tokens": _search(part, q="Gear size promo"),
    "srch4_tokens_by_blocks": _search(part, blocks=True, q="Gear size promo"),
    "srch4_tokens_file_only": _search(tables.document_catalog, q="the en", search_folders=False),
    "srch4_tokens_file_only_by_blocks": _search(tables.document_catalog, blocks=True, q="the en", search_folders=False),
    "srch5_fuzzy_terms": srch5,
    "srch5_fuzzy_search": _search(part, q="rng bolts"),
    "srch5_fuzzy_search_by_blocks": _search(part, blocks=True, q="rng bolts"),
    "srch6_edit_distance": srch6,
    "srch7_relevance": srch7,
    "srch8_literal_batch": srch8_literal,
    "srch8_token_batch_by_postings": _srch8_tokens(1_000_000),
    "srch8_token_batch_by_scan": _srch8_tokens(-1),
    "sort1_relevance": _page(part, q="small gear", page_size=500),
    "sort2_name": _page(part, q="*e*", exact=True, sort="name", page_size=500),
    "sort3_size": _page(part, q="ECONOMY", exact=True, sort="size", page_size=500),
    "sort4_corpus_order": _page(part, q=" ", repos=["shop/Brand#7", "shop/Brand#8"], page_size=500),
    "sort5_browse_ranks": sort5,
    "sort5_browse_page": sort5_page,
    "page1_page": _page(part, q="", sort="size", page=3, page_size=40),
    "page1_filtered_by_bitmaps": _page(part, blocks=True, q="", repos=["shop/Brand#7", "shop/Brand#8"], extensions=["pdf", "txt", "zip"], page=2, page_size=4),
    "page1_clamp": page1_clamp,
    "agg1_repo": _facet(facets.repo_facet),
    "agg2_extension": _facet(facets.extension_facet),
    "agg3_extension_by_repo": _facet(facets.extension_by_repo_facet),
    "agg4_text": agg4,
    "agg3_facets_of_filtered": _facets_of(q="", repos=["shop/Brand#7", "shop/Brand#8", "shop/Brand#12"], extensions=["pdf", "epub"], has_text=True),
    "agg3_facets_of_tokens": _facets_of(q="gear size", extensions=["pdf", "txt", "zip"]),
    "agg3_facets_of_size_range": _facets_of(q="red", min_size=950000),
    "agg5_metadata": agg5,
    "agg5_metadata_empty": agg5_empty,
    "agg6_extension_panel": agg6,
    "agg7_complement": agg7,
    "agg7_folder_complement": agg7_folders,
    "hier1_folder_contents": hier1,
    "hier1_folder_contents_by_interval": hier1_interval,
    "hier1_all_listings": hier1_all,
    "hier2_folder_tree": hier2,
    "hier3_ancestors": hier3,
    "smp1_random_per_repo": smp1,
    "smp1_random_per_repo_by_bitmaps": smp1_bitmaps,
    "smp1_random_text": smp1_text,
    "smp1_random_text_by_bitmaps": smp1_text_bitmaps,
    "log1_recent_queries": log1,
    "log1_recent_queries_stream": log1_stream,
}
