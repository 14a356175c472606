"""Interval numbering of folders: a subtree of paths is one range of numbers.

All distinct folder paths, of all repos together, are numbered in pre-order: a folder comes before what lies below it, and
its subtree without a gap. So a subtree filter is a range predicate on the number, an exact folder an equality, and a
copy of the records clustered by that number is read only where the range lies.
"""

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogspark.functions.paths import ancestors, folder_path

from .ranking import sorted_position


def folder_numbers(catalog: DataFrame) -> DataFrame:
    """(path, first, last) of every folder path and the empty one: its number, and that of its last descendant."""
    folders = catalog.select(F.array_remove("folder", "").alias("folder")).distinct()
    ups = folders.select(F.explode(F.concat(F.array(F.lit("")), ancestors(F.col("folder")))).alias("path")).distinct()
    # The separator sorts below all characters of names, so a subtree stays together.
    order = F.translate("path", "/", "\x01")
    placed = sorted_position(ups.withColumn("order", order), ["order", "path"], "first").drop("order")
    above = F.concat(F.array(F.lit("")), ancestors(F.when(F.col("path") == "", F.array().cast("array<string>")).otherwise(F.split("path", "/"))))
    sizes = placed.select(F.explode(above).alias("up")).groupBy("up").agg(F.count(F.lit(1)).alias("n"))
    return placed.join(sizes, F.col("path") == F.col("up")).select("path", "first", (F.col("first") + F.col("n") - 1).alias("last"))


def with_folder_number(catalog: DataFrame, numbers: DataFrame) -> DataFrame:
    """Add ``folder_no``, the number of a record's folder."""
    path = folder_path(F.array_remove("folder", ""))
    named = numbers.select(F.col("path").alias("numbered"), F.col("first").alias("folder_no"))
    return catalog.join(named, path == F.col("numbered")).drop("numbered")


def _ranges(numbers: DataFrame, paths: list) -> dict:
    """Intervals of the given paths; no more rows come back than paths were asked."""
    rows = numbers.filter(F.col("path").isin(sorted(set(paths)))).collect()
    return {r["path"]: (r["first"], r["last"]) for r in rows}


def folder_interval(numbers: DataFrame, mode, folders, selfs, subtrees) -> Column | None:
    """The folder filter of a query as ranges of ``folder_no``; None where it has none. Paths must be clean."""
    if mode == "mixed":
        exact, below = ([p for p in paths or [] if p] for paths in (selfs, subtrees))
    elif mode == "exact":
        exact, below = list(folders or []), []
    else:
        # The empty folder stands for root files alone.
        exact, below = [p for p in folders or [] if not p], [p for p in folders or [] if p]
    if not exact and not below:
        return None
    known = _ranges(numbers, exact + below)
    number = F.col("folder_no")
    tests = [number == known[p][0] for p in exact if p in known]
    tests += [number.between(*known[p]) for p in below if p in known]
    return reduce(or_, tests, F.lit(False))


def folder_listing(records: DataFrame, numbers: DataFrame, repo: str, path: str = "") -> tuple[DataFrame, DataFrame]:
    """Child folders with recursive counts, and files, of one folder: reads the range of its subtree only."""
    clean = path.strip("/")
    first, last = _ranges(numbers, [clean]).get(clean, (0, -1))
    here = records.filter((F.col("repo") == repo) & F.col("folder_no").between(first, last))
    depth = len(clean.split("/")) if clean else 0
    parts = F.array_remove("folder", "")
    name = F.get(parts, F.lit(depth))
    prefix = clean + "/" if clean else ""
    folders = (
        here.filter(F.col("folder_no") > first).groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("count"))
        .select("name", F.concat(F.lit(prefix), "name").alias("path"), "count")
    )
    files = here.filter(F.col("folder_no") == first).select(
        "ord", F.col("file").alias("name"), "ext", "has_txt", F.nullif("size", F.lit(0)).alias("size")
    )
    return folders, files
