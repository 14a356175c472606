"""Catalogs and query logs derived from star-schema, document, page and event tables."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogspark.functions.paths import split_path
from catalogspark.operators.ranking import sorted_position
from catalogspark.session import shared_folder


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for one run, below the cluster's shared folder."""
    return f"{shared_folder(spark)}/catalogspark/{name}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _catalog(df: DataFrame) -> DataFrame:
    return df.select(
        "ord", "repo", "file", "ext", split_path(F.col("folder_path")).alias("folder"), "size", "has_txt"
    )


def part_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _catalog(
        table(spark, sf_dir, "part").selectExpr(
            "p_partkey AS ord", "concat('shop/', p_brand) AS repo", "p_name AS file",
            """CASE p_partkey % 7 WHEN 0 THEN 'PDF' WHEN 1 THEN 'pdf' WHEN 2 THEN 'txt' WHEN 3 THEN 'epub'
               WHEN 4 THEN 'zip' WHEN 5 THEN '' ELSE 'djvu' END AS ext""",
            """CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN p_type
               ELSE concat(p_type, '/size ', CAST(p_size AS STRING)) END AS folder_path""",
            """CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 13 = 0 THEN 0
               ELSE CAST(floor(p_retailprice * 1000) AS BIGINT) END AS size""",
            "p_partkey % 3 = 0 AS has_txt",
        )
    )


def document_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return _catalog(
        table(spark, sf_dir, "documents").join(labels, "doc_id", "left").selectExpr(
            "doc_id AS ord", "concat('corpus/', source) AS repo",
            "replace(text, chr(10), ' ') AS file", "'txt' AS ext",
            "concat(lang, '/b', CAST(doc_id % 7 AS STRING)) AS folder_path",
            "n_chars AS size", "coalesce(quality, 0) = 1 AS has_txt",
        )
    )


def page_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = r"regexp_replace(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/+$', '') AS p"
    return _catalog(
        table(spark, sf_dir, "pages").selectExpr("*", path).selectExpr(
            "page_id AS ord", "regexp_extract(url, '^https?://([^/?#]+)', 1) AS repo",
            "regexp_replace(regexp_extract(p, '([^/]*)$', 1), '[.][^.]*$', '') AS file",
            "regexp_extract(p, '[.]([^./]*)$', 1) AS ext",
            "regexp_replace(regexp_extract(p, '^(.*)/[^/]*$', 1), '^/+', '') AS folder_path",
            "CAST(length(html) AS BIGINT) AS size", "page_id % 2 = 0 AS has_txt",
        )
    )


def event_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few distinct names with many copies each: the skewed case of record ids."""
    return _catalog(
        table(spark, sf_dir, "events").selectExpr(
            "event_id AS ord", "concat('log/', event_type) AS repo", "event_type AS file", "'' AS ext",
            "'' AS folder_path", "CAST(NULL AS BIGINT) AS size", "false AS has_txt",
        )
    )


LINEITEM_KEYS = [
    "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
]


def lineitem_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The large catalog of the benchmarks."""
    lines = sorted_position(table(spark, sf_dir, "lineitem"), LINEITEM_KEYS, "ord")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name", "p_type")
    return _catalog(
        lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).selectExpr(
            "ord", "concat('shop/', p_brand) AS repo",
            "concat(p_name, ' ', CAST(l_orderkey AS STRING)) AS file",
            "CASE l_returnflag WHEN 'A' THEN 'pdf' WHEN 'N' THEN 'txt' ELSE 'EPUB' END AS ext",
            """concat(CAST(year(l_shipdate) AS STRING), '/', CAST(month(l_shipdate) AS STRING), '/', p_type)
               AS folder_path""",
            "CAST(floor(l_extendedprice) AS BIGINT) AS size", "l_linestatus = 'F' AS has_txt",
        )
    )


def query_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "user_id", "ts", "get_json_object(props, '$.k') AS q"
    )


def write_compact(catalog: DataFrame, path: str, shard_rows: int) -> None:
    """Store a catalog in the corpus form, ``shard_rows`` consecutive ords to a document."""
    shard = F.lpad(F.floor(F.col("ord") / shard_rows).cast("string"), 12, "0")
    repos, folders = F.sort_array(F.collect_set("repo")), F.sort_array(F.collect_set("folder"))
    record = F.struct("ord", "repo", "file", "ext", "folder", "size", "has_txt")
    docs = catalog.groupBy(shard.alias("piece")).agg(
        repos.alias("rp"), folders.alias("fd"), F.array_sort(F.collect_list(record)).alias("rows")
    )

    def encoded(row):
        size = F.when(row["size"].isNull(), F.lit("").cast("variant")).otherwise(row["size"].cast("variant"))
        return F.array(
            (F.array_position(F.col("rp"), row["repo"]) - 1).cast("variant"),
            row["file"].cast("variant"), row["ext"].cast("variant"),
            (F.array_position(F.col("fd"), row["folder"]) - 1).cast("variant"),
            size, row["has_txt"].cast("int").cast("variant"),
        )

    body = F.struct(
        F.lit(2).alias("v"), "rp", "fd", F.transform("rows", encoded).alias("rc")
    )
    docs.select("piece", F.to_json(body).alias("value")).write.partitionBy("piece").option(
        "compression", "gzip"
    ).text(path)
