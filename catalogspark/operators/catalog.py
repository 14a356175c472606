"""Derived catalog columns and stable record ids."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogspark.functions.paths import folder_path

from .ranking import ORD_SPAN, position_by_ord

# Fixed value: separator inside record ids.
UNIT_SEPARATOR = "\x1f"


def with_derived(catalog: DataFrame) -> DataFrame:
    """Joined path and lower-cased search columns."""
    path = folder_path(F.col("folder"))
    return catalog.withColumns(
        {
            "folder_path": path,
            "ext_lc": F.lower("ext"),
            "file_lc": F.lower("file"),
            "repo_lc": F.lower("repo"),
            "folder_lc": F.lower(path),
        }
    )


def with_record_id(catalog: DataFrame, span: int = ORD_SPAN) -> DataFrame:
    """Add ``occurrence`` (earlier records alike) and the stable ``record_id``."""
    keyed = catalog if "folder_path" in catalog.columns else catalog.withColumn(
        "folder_path", folder_path(F.col("folder"))
    )
    placed = position_by_ord(keyed, ["repo", "folder_path", "file", "ext"], "occurrence", span=span)
    path = F.array_join(F.concat("folder", F.array("file", "ext")), "/")
    return placed.withColumn(
        "record_id",
        F.concat_ws(UNIT_SEPARATOR, "repo", path, F.col("occurrence").cast("string")),
    )


def selected_links(catalog: DataFrame, record_ids: DataFrame, link) -> DataFrame:
    """Export list (name, link) of the records named in ``record_ids`` (one column)."""
    from catalogspark.functions.paths import full_name

    return catalog.join(record_ids.distinct(), "record_id", "left_semi").select(
        "ord", full_name(F.col("file"), F.col("ext")).alias("filename"), link.alias("link")
    )
