"""Publishing jobs: catalog generations, ranks, first pages, listings, manifests."""

from dataclasses import replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catalogspark.operators.bitmaps import facet_bitmaps
from catalogspark.operators.blocks import blocked_postings
from catalogspark.operators.catalog import with_record_id
from catalogspark.operators.facets import by_name, corpus_metadata, facet_cube, repo_facet
from catalogspark.operators.index import postings, vocabulary
from catalogspark.operators.intervals import folder_numbers, with_folder_number
from catalogspark.operators.matching import DEFAULT_PAGE_SIZE, MAX_PAGE_SIZE, name_key
from catalogspark.operators.ranking import (
    position_by_ord, sorted_position, sorted_position_in_group,
)
from catalogspark.operators.tree import folder_counts, folder_tree, root_entries
from catalogspark.plans.search import RECORD, SearchIndex
from catalogspark.session import freeze

# Rows and version of a first page.
FIRST_PAGE_ROWS = 100
FIRST_PAGE_VERSION = 2

# Bytes of a row group of the tables that searches read a few rows of.
SEARCH_ROW_GROUP = 4 << 20

# Longest list put into one published document; longer ones continue in further parts.
PART_ENTRIES = 10_000


def with_browse_ranks(catalog: DataFrame) -> DataFrame:
    """Add 1-based corpus_rank, name_rank and size_rank, over everything and within each repo."""
    # Two sorts of a slim table; the catalog itself is joined once, at the end.
    slim = catalog.select("ord", "repo", "file", F.coalesce("size", F.lit(0)).alias("bytes"))
    ranks = sorted_position(slim, [name_key(F.col("file")), "ord"], "name_rank").drop("file")
    ranks = sorted_position(ranks, [F.desc("bytes"), "ord"], "size_rank").drop("bytes")
    # Overall ranks are dense numbers, so ranks within a repo need no further sort of names.
    sorted_rows = ranks
    for keys, column, out in (
        ([], "ord", "corpus_rank"), (["repo"], "ord", "repo_corpus_rank"),
        (["repo"], "name_rank", "repo_name_rank"), (["repo"], "size_rank", "repo_size_rank"),
    ):
        placed = position_by_ord(ranks, keys, out, ord_col=column, counted=sorted_rows)
        ranks = placed.withColumn(out, F.col(out) + 1)
    return catalog.join(ranks.drop("repo"), "ord")


# Stored order of each sort; unknown sorts mean relevance, which is corpus order here.
BROWSE_RANKS = {"name": "name_rank", "size": "size_rank"}


def browse(ranked: DataFrame, sort: str = "relevance", repo: str = "", page: int = 1, page_size: int = 100):
    """One page of the unfiltered listing: a range predicate on a stored rank."""
    column = ("repo_" if repo else "") + BROWSE_RANKS.get(sort, "corpus_rank")
    page = max(1, page or 1)
    page_size = max(1, min(MAX_PAGE_SIZE, page_size or DEFAULT_PAGE_SIZE))
    rows = ranked.filter(F.col("repo") == repo) if repo else ranked
    first = (page - 1) * page_size
    return rows.filter(F.col(column).between(first + 1, first + page_size)).orderBy(column)


def browse_entries(ranked: DataFrame) -> DataFrame:
    """Slim table of the prepared orders: listing, repo (empty: all), rank, ord."""
    entries = [
        F.struct(
            F.lit(sort).alias("listing"), (F.col("repo") if own else F.lit("")).alias("repo"),
            F.col(("repo_" if own else "") + column).alias("rank"), F.lit(own).alias("own"), F.col("ord"),
        )
        for sort, column in (("relevance", "corpus_rank"), *BROWSE_RANKS.items()) for own in (False, True)
    ]
    # A repo may have the empty name, so the kind of listing is part of its name.
    named = F.transform(F.array(*entries), lambda e: F.struct(
        F.concat(F.when(e["own"], F.lit("repo_")).otherwise(F.lit("")), e["listing"]).alias("listing"),
        e["repo"].alias("repo"), e["rank"].alias("rank"), e["ord"].alias("ord"),
    ))
    return ranked.select(F.explode(named).alias("e")).select("e.*")


def browse_page(stored: DataFrame, entries: DataFrame, sort: str = "relevance", repo: str = "", page: int = 1, page_size: int = 100):
    """One page of a prepared order, through the slim table.

    Both tables are stored by range: the page's ords come from few files of ``entries``, and the
    records of those ords (MAX_PAGE_SIZE at most) from the files of ``stored`` that hold them.
    """
    page = max(1, page or 1)
    page_size = max(1, min(MAX_PAGE_SIZE, page_size or DEFAULT_PAGE_SIZE))
    first = (page - 1) * page_size
    listing = ("repo_" if repo else "") + (sort if sort in BROWSE_RANKS else "relevance")
    wanted = entries.filter(
        (F.col("listing") == listing) & (F.col("repo") == repo) & F.col("rank").between(first + 1, first + page_size)
    )
    ords = [r["ord"] for r in wanted.select("ord").collect()]
    column = ("repo_" if repo else "") + BROWSE_RANKS.get(sort, "corpus_rank")
    return stored.filter(F.col("ord").isin(ords)).orderBy(column)


def publish(catalog: DataFrame, root: str, generation: int, search_tables: bool = True) -> None:
    """Write all tables of one generation; a row in ``complete``, written last, makes it visible.

    Rows are clustered by the columns that queries select on, so Parquet statistics
    prune; ord is part of each range key, so hot tokens and repos split over files.
    A generation is never written twice: its folders must not exist. Without ``search_tables``, blocked postings, bitmaps and
    the copy by folder are left out (searches then scan); :func:`publish_search_tables` can add them later.
    """

    def path(table: str) -> str:
        return f"{root}/{table}/generation={generation}"

    def write(df: DataFrame, table: str, *order: str) -> None:
        df.sortWithinPartitions(*order).write.parquet(path(table))

    def by_range(df: DataFrame, table: str, *order: str) -> None:
        write(df.repartitionByRange(*order), table, *order)

    spark = catalog.sparkSession
    # Files hold disjoint ranges of ords, so a list of ords opens few of them.
    ranked = freeze(with_browse_ranks(with_record_id(catalog)))
    by_range(ranked, "catalog", "ord")
    stored = spark.read.parquet(path("catalog"))
    by_range(browse_entries(stored), "browse", "listing", "repo", "rank")
    by_range(postings(stored), "postings", "scope", "token", "ord")
    by_range(vocabulary(spark.read.parquet(path("postings"))), "vocab", "scope", "token")
    by_range(folder_tree(folder_counts(stored)), "folder_nodes", "repo", "path")
    corpus_metadata(facet_cube(stored)).write.parquet(path("facets"))
    if search_tables:
        publish_search_tables(spark, root, generation)
    _mark(spark, path("complete"))


def publish_search_tables(spark: SparkSession, root: str, generation: int) -> None:
    """Write what searches can use besides postings, each in the order that queries select on.

    Blocked postings of tokens and text pieces, bitmaps of the facets, numbers of the folder paths, and a copy of the records
    clustered by folder.
    """
    stored = read_published(spark, root, "catalog", generation).drop("generation")

    def write(rows: DataFrame, table: str, *order: str) -> None:
        # Lists of ords and bitmaps are long; small row groups let a query read those of its own values only.
        rows.repartitionByRange(*order).sortWithinPartitions(*order).write.option(
            "parquet.block.size", SEARCH_ROW_GROUP
        ).parquet(f"{root}/{table}/generation={generation}")

    write(blocked_postings(stored), "blocks", "scope", "token", "block")
    write(facet_bitmaps(stored), "bitmaps", "facet", "value", "bucket")
    numbers = freeze(folder_numbers(stored))
    write(numbers, "folder_numbers", "path")
    records = stored.select(*RECORD, *[c for c in ("record_id",) if c in stored.columns])
    write(with_folder_number(records, numbers), "by_folder", "folder_no", "ord")


def _mark(spark: SparkSession, path: str) -> None:
    """One row below ``path``; fails if the path exists."""
    spark.range(1).coalesce(1).write.parquet(path)


def replace_corpus(catalog: DataFrame, root: str) -> int:
    """Publish a corpus as the next generation and return its number.

    A number is claimed before anything is written, so a crashed attempt is skipped by the next one.
    """
    spark = catalog.sparkSession
    generation = claim(spark, root, highest(spark, f"{root}/claimed") + 1)
    publish(catalog, root, generation)
    return generation


def claim(spark: SparkSession, root: str, generation: int) -> int:
    """Take a generation number; of several writers that want the same one, all but one fail.

    The lock is a file that is made by an exclusive create. That is atomic in HDFS; in an object store or on a plain disk,
    where a file system only looks first and creates then, writers have to take turns.
    """
    lock = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/locks/{generation}")
    try:
        lock.getFileSystem(spark._jsc.hadoopConfiguration()).create(lock, False).close()
    except Exception as error:
        raise FileExistsError(f"generation {generation} is taken") from error
    _mark(spark, f"{root}/claimed/generation={generation}")
    return generation


def highest(spark: SparkSession, path: str) -> int:
    """The largest generation with a row below ``path``; 0 when there is none."""
    try:
        marks = spark.read.parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            return 0
        raise
    return marks.agg(F.max("generation")).first()[0] or 0


def latest_generation(spark: SparkSession, root: str) -> int:
    """Number of the newest complete generation; 0 when there is none."""
    return highest(spark, f"{root}/complete")


def read_published(spark: SparkSession, root: str, table: str, generation: int) -> DataFrame:
    """A published table, with the generation as a column."""
    return spark.read.option("basePath", f"{root}/{table}").parquet(
        f"{root}/{table}/generation={generation}"
    )


def read_index(spark: SparkSession, root: str, generation: int) -> SearchIndex:
    def table(name: str) -> DataFrame:
        return read_published(spark, root, name, generation)

    index = SearchIndex(table("postings"), table("vocab"), table("browse"))
    try:
        blocks = table("blocks")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return index
    return replace(
        index, blocks=blocks, repos=table("facets").filter("facet = 'repo'").select("repo"), bitmaps=table("bitmaps"),
        folder_numbers=table("folder_numbers"), by_folder=table("by_folder"),
    )


def first_pages(catalog: DataFrame) -> DataFrame:
    """First-page documents: one over everything, one per repo."""
    record = F.struct(
        F.col("repo").alias("Repo"), F.col("file").alias("File"), F.col("ext").alias("Extension"),
        F.col("folder").alias("Folder"), F.col("size").alias("Size"), F.col("has_txt").alias("HasTxt"),
    )
    rows = catalog.select("repo", F.struct("ord", record.alias("record")).alias("entry"))
    in_repo = Window.partitionBy("repo").orderBy("entry.ord")
    listed = F.transform(F.array_sort(F.collect_list("entry")), lambda e: e["record"])
    head = rows.withColumn("n", F.row_number().over(in_repo)).filter(F.col("n") <= FIRST_PAGE_ROWS)
    counts = catalog.groupBy("repo").agg(F.count(F.lit(1)).alias("total"))
    repo_docs = head.groupBy("repo").agg(listed.alias("results")).join(counts, "repo")
    # The overall first rows are among the first rows of each repo.
    overall = head.orderBy("entry.ord").limit(FIRST_PAGE_ROWS).agg(listed.alias("results"))
    total = counts.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("total"))

    def document(df: DataFrame, mode: str, repo: Column, total: Column) -> DataFrame:
        return df.select(
            F.lit(FIRST_PAGE_VERSION).cast("bigint").alias("version"), F.lit(mode).alias("mode"),
            repo.alias("repo"), F.lit("relevance").alias("sort"), F.lit(1).cast("bigint").alias("page"),
            F.lit(FIRST_PAGE_ROWS).cast("bigint").alias("page_size"), total.alias("total"), "results",
        )

    everything = document(overall, "global", F.lit(None).cast("string"), total.scalar())
    return everything.union(document(repo_docs, "repo", F.col("repo"), F.col("total")))


def write_first_pages(catalog: DataFrame, path: str) -> None:
    """JSON files under page_set=global and page_set=repo/page_name=<repo>."""
    docs = first_pages(catalog).withColumns(
        {"page_set": F.col("mode"), "page_name": F.coalesce("repo", F.lit("all"))}
    )
    _write_json(docs, path, "page_set", "page_name")


def _write_json(df: DataFrame, path: str, *by: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).partitionBy(*by).json(path)


def _in_parts(placed: DataFrame, entries: int) -> DataFrame:
    return placed.withColumn("part", F.floor((F.col("position") - 1) / entries).cast("bigint"))


def root_listings(catalog: DataFrame, part_entries: int = PART_ENTRIES) -> DataFrame:
    """Root-folder documents of every repo; long listings continue in numbered parts."""
    is_folder = F.col("kind") == "folder"
    # Both lists are in code-unit order of the names.
    order = [F.desc("kind"), F.asc("name"), F.asc("ord")]
    placed = _in_parts(
        sorted_position_in_group(root_entries(catalog), ["repo"], order, "position"), part_entries
    )
    folder = F.struct("position", F.col("name").alias("n"), F.col("count").alias("c"))
    file = F.struct(
        "position", F.col("name").alias("n"), F.col("ext").alias("e"),
        F.col("has_txt").alias("t"), F.col("size").alias("s"),
    )

    def collected(when: Column, entry: Column, *fields: str) -> Column:
        ordered = F.array_sort(F.collect_list(F.when(when, entry)))
        return F.transform(ordered, lambda e: F.struct(*[e[f].alias(f) for f in fields]))

    return placed.groupBy("repo", "part").agg(
        F.lit("").alias("path"),
        collected(is_folder, folder, "n", "c").alias("folders"),
        collected(~is_folder, file, "n", "e", "t", "s").alias("files"),
    )


def repo_counts(catalog: DataFrame, part_entries: int = PART_ENTRIES) -> DataFrame:
    """Documents with the record count of every repo, in name order."""
    placed = _in_parts(
        sorted_position(repo_facet(facet_cube(catalog)), [by_name("repo"), "repo"], "position"),
        part_entries,
    )
    entry = F.struct("position", F.col("repo").alias("name"), "count")
    return placed.groupBy("part").agg(
        F.transform(
            F.array_sort(F.collect_list(entry)),
            lambda e: F.struct(e["name"].alias("name"), e["count"].alias("count")),
        ).alias("repos")
    )


def write_root_listings(catalog: DataFrame, path: str) -> None:
    _write_json(root_listings(catalog).withColumn("page_name", F.col("repo")), f"{path}/repos", "page_name")
    repo_counts(catalog).write.mode("overwrite").json(f"{path}/global")


# The end of a written document's path: its set, its name where it has one, and the file.
_DOCUMENT = r"((?:page_set=[^/]+/page_name=[^/]+|repos/page_name=[^/]+|global)/[^/]+)$"


def manifest_entries(spark: SparkSession, path: str, base: str) -> DataFrame:
    """(position, url) of the documents that were written below ``path``, in order of their urls.

    The files themselves are listed, so every url exists, long listings appear with all parts, and
    repos of equal short names stay apart.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json*")
        .load(path).select(F.regexp_extract("_metadata.file_path", _DOCUMENT, 1).alias("document"))
    )
    urls = files.filter("document <> ''").select(F.concat(F.lit(base + "/"), "document").alias("url"))
    return sorted_position(urls, ["url"], "position")


def manifest(spark: SparkSession, path: str, base: str, part_entries: int = PART_ENTRIES) -> DataFrame:
    """Manifest documents {version, urls} of the documents below ``path``."""
    return (
        _in_parts(manifest_entries(spark, path, base), part_entries)
        .groupBy("part")
        .agg(F.array_sort(F.collect_list(F.struct("position", "url"))).alias("entries"))
        .select(
            "part", F.lit(FIRST_PAGE_VERSION).cast("bigint").alias("version"),
            F.col("entries.url").alias("urls"),
        )
    )


def write_manifest(spark: SparkSession, path: str, base: str, out: str) -> None:
    manifest(spark, path, base).write.mode("overwrite").json(out)


def write_links(links: DataFrame, path: str) -> None:
    """Link list as text lines, in catalog order."""
    links.orderBy("ord").select("link").write.mode("overwrite").text(path)
