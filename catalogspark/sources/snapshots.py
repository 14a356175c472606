"""Readers of published first pages and root listings."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogspark.schema import FIRST_PAGE, REPO_COUNTS, ROOT_LISTING


def read_first_pages(spark: SparkSession, path) -> DataFrame:
    """Records of first-page documents with their envelope and 0-based row number."""
    docs = spark.read.schema(FIRST_PAGE).option("multiLine", True).json(path)
    return docs.select(
        "mode", F.col("repo").alias("page_repo"), "sort", "page", "page_size", "total",
        F.posexplode("results").alias("row", "r"),
    ).select(
        "mode", "page_repo", "sort", "page", "page_size", "total", "row",
        F.col("r.Repo").alias("repo"), F.col("r.File").alias("file"),
        F.col("r.Extension").alias("ext"), F.col("r.Folder").alias("folder"),
        F.col("r.Size").alias("size"), F.col("r.HasTxt").alias("has_txt"),
    )


def read_root_listings(spark: SparkSession, path, parent: str = "") -> DataFrame:
    """Listings with full field names; folder paths are relative to ``parent``."""
    docs = spark.read.schema(ROOT_LISTING).option("multiLine", True).json(path)
    prefix = parent + "/" if parent else ""
    none = F.array()
    folders = F.transform(
        F.coalesce("folders", none),
        lambda x: F.struct(
            F.coalesce(x["n"], F.lit("")).alias("name"),
            F.concat(F.lit(prefix), F.coalesce(x["n"], F.lit(""))).alias("path"),
            F.coalesce(x["c"], F.lit(0)).alias("count"),
        ),
    )
    files = F.transform(
        F.coalesce("files", none),
        lambda x: F.struct(
            F.coalesce(x["n"], F.lit("")).alias("name"),
            F.coalesce(x["e"], F.lit("")).alias("ext"),
            F.coalesce(x["t"], F.lit(False)).alias("has_txt"),
            x["s"].alias("size"),
        ),
    )
    return docs.select(
        F.coalesce("repo", F.lit("")).alias("repo"),
        F.coalesce(F.nullif("path", F.lit("")), F.lit(parent)).alias("path"),
        folders.alias("folders"), files.alias("files"),
    )


def read_repo_counts(spark: SparkSession, path) -> DataFrame:
    docs = spark.read.schema(REPO_COUNTS).option("multiLine", True).json(path)
    return docs.select(F.explode("repos").alias("r")).select(
        F.col("r.name").alias("repo"), F.col("r.count").alias("count")
    )
