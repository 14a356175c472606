"""Facets. The catalog is aggregated once; every facet is a roll-up of that small cube."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogspark.operators.ranking import sorted_position

# Extensions shown by name, in display order; all others form one bucket.
EXTENSION_ORDER = [
    "pdf", "txt", "epub", "mobi", "azw3", "fb2", "djvu", "chm", "caj",
    "doc", "docx", "odt", "rtf", "ppt", "xlsx", "jpg", "png", "gif", "tif",
    "html", "htm", "aspx", "css", "js", "xml", "mht",
    "mp4", "flv", "swf", "rm", "rmvb", "mp3", "wav", "iso", "dat", "exe",
]


def by_name(column: str):
    """Order of names shown to people."""
    return F.collate(F.col(column), "UNICODE")


def facet_cube(catalog: DataFrame) -> DataFrame:
    """Records per (repo, lower-cased extension): the only pass over the catalog."""
    return catalog.groupBy("repo", F.lower(F.coalesce("ext", F.lit(""))).alias("ext")).agg(
        F.count(F.lit(1)).alias("count"), F.count_if("has_txt").alias("txt_count")
    )


def repo_facet(cube: DataFrame) -> DataFrame:
    return cube.groupBy("repo").agg(F.sum("count").alias("count")).orderBy(by_name("repo"), "repo")


def extension_facet(cube: DataFrame) -> DataFrame:
    return (
        cube.filter("ext <> ''").groupBy("ext").agg(F.sum("count").alias("count")).orderBy("ext")
    )


def extension_by_repo_facet(cube: DataFrame) -> DataFrame:
    return cube.filter("ext <> ''").select("repo", "ext", "count").orderBy("repo", "ext")


def text_facet(cube: DataFrame) -> DataFrame:
    """Records with a text rendition, overall (repo NULL) and per repo that has any."""
    count = F.coalesce(F.sum("txt_count"), F.lit(0)).alias("count")
    overall = cube.agg(count).select(F.lit(None).cast("string").alias("repo"), "count")
    per_repo = cube.groupBy("repo").agg(count).filter(F.col("count") > 0)
    return overall.union(per_repo).withColumn("available", F.col("count") > 0)


def corpus_metadata(cube: DataFrame) -> DataFrame:
    """All facets in long form (facet, repo, name, count), from one evaluation of the cube.

    Facets: total, repo, extension, extension_by_repo, text (repo NULL: overall).
    """
    none = F.lit(None).cast("string")

    def entry(facet: str, repo, name, count: str):
        return F.struct(
            F.lit(facet).alias("facet"), repo.alias("repo"), name.alias("name"), F.col(count).alias("n")
        )

    repo, ext = F.col("repo"), F.col("ext")
    always = F.array(
        entry("total", none, none, "count"), entry("repo", repo, none, "count"),
        entry("text", none, none, "txt_count"), entry("text", repo, none, "txt_count"),
    )
    named = F.array(
        entry("extension", none, ext, "count"), entry("extension_by_repo", repo, ext, "count")
    )
    entries = F.when(ext == "", always).otherwise(F.concat(always, named))
    # An empty catalog has a total and a text count as well: 0.
    zero = F.lit(0).cast("bigint").alias("n")
    least = cube.sparkSession.range(1).select(
        F.explode(F.array(F.lit("total"), F.lit("text"))).alias("facet"), none.alias("repo"), none.alias("name"), zero
    )
    return (
        cube.select(F.explode(entries).alias("e")).select("e.*").unionAll(least)
        .groupBy("facet", "repo", "name")
        .agg(F.sum("n").alias("count"))
        .filter("count > 0 OR repo IS NULL")
    )


def extension_panel(extensions: DataFrame, selected: DataFrame) -> DataFrame:
    """Display rows: known extensions by rank, then one "other" row with its children.

    ``extensions`` is (ext, count), ``selected`` is (ext). A selected extension that
    does not occur is shown with count 0. Columns: position, kind (known | other |
    other_child), ext, kinds, count.
    """
    merged = (
        extensions.join(selected.filter("ext <> ''").distinct(), "ext", "full")
        .select("ext", F.coalesce("count", F.lit(0)).alias("count"))
    )
    rank = F.array_position(F.array(*[F.lit(e) for e in EXTENSION_ORDER]), F.col("ext"))
    ranked = merged.withColumn("rank", rank)
    known = ranked.filter("rank > 0").select(
        F.col("rank").alias("major"), F.lit("known").alias("kind"), "ext",
        F.lit(1).cast("bigint").alias("kinds"), "count",
    )
    rest = ranked.filter("rank = 0")
    last = F.lit(len(EXTENSION_ORDER))
    other = rest.agg(F.count(F.lit(1)).alias("kinds"), F.sum("count").alias("count")).filter(
        "kinds > 0"
    ).select(
        (last + 1).alias("major"), F.lit("other").alias("kind"),
        F.lit(None).cast("string").alias("ext"), "kinds", "count",
    )
    children = rest.select(
        (last + 2).alias("major"), F.lit("other_child").alias("kind"), "ext",
        F.lit(1).cast("bigint").alias("kinds"), "count",
    )
    rows = known.union(other).union(children)
    placed = sorted_position(rows, ["major", by_name("ext"), "ext"], "position")
    return placed.select("position", "kind", "ext", "kinds", "count").orderBy("position")


def facet_complement(values: DataFrame, selected: DataFrame, column: str) -> DataFrame:
    """Inverted selection: the distinct facet values that are not selected."""
    return values.select(column).distinct().join(selected.select(column), column, "left_anti")
