"""Folder hierarchy: listings and roll-ups."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogspark.functions.paths import clean_path

from .facets import by_name


def _cleaned(catalog: DataFrame) -> DataFrame:
    """Folders without blank components, so files and nodes have the same paths."""
    return catalog.withColumn("folder", F.array_remove("folder", ""))


def folder_counts(catalog: DataFrame) -> DataFrame:
    """Records per (repo, folder): shrinks the catalog before prefixes multiply it."""
    return _cleaned(catalog).groupBy("repo", "folder").agg(F.count(F.lit(1)).alias("n"))


def folder_tree(counts: DataFrame) -> DataFrame:
    """FOLDER_NODE rows of every repo, one per distinct path, from :func:`folder_counts`."""
    depth = F.col("depth")
    prefixes = counts.select(
        "repo", "folder", "n", F.explode(F.sequence(F.lit(0), F.size("folder"))).alias("depth")
    ).select(
        "repo",
        F.when(depth > 0, F.array_join(F.slice("folder", F.lit(1), depth), "/")).otherwise("").alias("path"),
        F.when(depth > 1, F.array_join(F.slice("folder", F.lit(1), depth - 1), "/"))
        .when(depth == 1, "").alias("parent_path"),
        F.when(depth > 0, F.get("folder", depth - 1))
        .otherwise(F.substring_index("repo", "/", -1)).alias("name"),
        "depth", "n",
        (depth == F.size("folder")).alias("direct"),
    )
    nodes = prefixes.groupBy("repo", "path", "parent_path", "name", "depth").agg(
        F.sum("n").alias("count"),
        F.bool_or("direct").alias("has_direct_files"),
        F.bool_or(~F.col("direct")).alias("has_children"),
    )
    is_root = F.col("depth") == 0
    return nodes.withColumns(
        {
            "show_self_toggle": ~is_root & F.col("has_direct_files") & F.col("has_children"),
            "is_root": is_root,
        }
    )


def folder_contents(catalog: DataFrame, repo: str, path: str = "") -> tuple[DataFrame, DataFrame]:
    """Child folders with recursive counts, and the files directly in one folder."""
    parts = [p for p in [path.strip("/")] if p]
    parts = parts[0].split("/") if parts else []
    depth = len(parts)
    here = _cleaned(catalog).filter((F.col("repo") == repo) & (F.size("folder") >= depth))
    if depth:
        here = here.filter(
            F.slice("folder", 1, depth) == F.array(*[F.lit(p) for p in parts])
        )
    name = F.get("folder", F.lit(depth))
    folders = (
        here.filter(F.size("folder") > depth)
        .groupBy(name.alias("name"))
        .agg(F.count(F.lit(1)).alias("count"))
        .select("name", F.concat(F.lit("".join(p + "/" for p in parts)), "name").alias("path"), "count")
        .orderBy("name")
    )
    files = (
        here.filter(F.size("folder") == depth)
        .select("ord", F.col("file").alias("name"), "ext", "has_txt", F.nullif("size", F.lit(0)).alias("size"))
        .orderBy(by_name("name"), "ord")
    )
    return folders, files


def listing_entries(catalog: DataFrame) -> DataFrame:
    """Direct content of every folder of every repo in one pass, in long form.

    Columns: repo, path, kind (folder | file), name, count, ext, has_txt, size, ord.
    """
    counts = folder_tree(folder_counts(catalog)).filter("depth > 0")
    folders = counts.select(
        "repo", F.col("parent_path").alias("path"), F.lit("folder").alias("kind"), "name", "count",
        F.lit(None).cast("string").alias("ext"), F.lit(None).cast("boolean").alias("has_txt"),
        F.lit(None).cast("bigint").alias("size"), F.lit(None).cast("bigint").alias("ord"),
    )
    return folders.union(file_entries(catalog))


def file_entries(catalog: DataFrame) -> DataFrame:
    return _cleaned(catalog).select(
        "repo", F.array_join("folder", "/").alias("path"), F.lit("file").alias("kind"),
        F.col("file").alias("name"), F.lit(None).cast("bigint").alias("count"),
        "ext", "has_txt", "size", "ord",
    )


def root_entries(catalog: DataFrame) -> DataFrame:
    """Depth-1 listing of every repo: top folders with recursive counts, and root files."""
    catalog = _cleaned(catalog)
    top = F.get("folder", F.lit(0))
    folders = (
        catalog.filter(F.size("folder") > 0)
        .groupBy("repo", top.alias("name"))
        .agg(F.count(F.lit(1)).alias("count"))
        .select(
            "repo", F.lit("").alias("path"), F.lit("folder").alias("kind"), "name", "count",
            F.lit(None).cast("string").alias("ext"), F.lit(None).cast("boolean").alias("has_txt"),
            F.lit(None).cast("bigint").alias("size"), F.lit(None).cast("bigint").alias("ord"),
        )
    )
    return folders.union(file_entries(catalog.filter(F.size("folder") == 0)))


def selectable_paths(nodes: DataFrame) -> DataFrame:
    """(repo, kind, path) choices of a folder filter: every subtree, every folder with files."""
    inner = nodes.filter(~F.col("is_root"))
    subtree = inner.select("repo", F.lit("subtree").alias("kind"), "path")
    own = inner.filter("has_direct_files").select("repo", F.lit("self").alias("kind"), "path")
    return subtree.union(own)


def path_complement(nodes: DataFrame, selected: DataFrame) -> DataFrame:
    """Inverted folder selection; ``selected`` is (repo, kind, path)."""
    return selectable_paths(nodes).join(selected, ["repo", "kind", "path"], "left_anti")


def merge_selection(selfs: Column, subtrees: Column) -> Column:
    """Self paths followed by the subtree paths not already among them."""
    return F.array_union(selfs, subtrees)


def filter_mixed_by_table(catalog: DataFrame, selfs: DataFrame, subtrees: DataFrame) -> DataFrame:
    """Self/subtree filter for large path tables (one ``path`` column each).

    The distinct folders of the catalog are matched by equality joins; the records
    then need only a semi join on their folder.
    """
    from catalogspark.functions.paths import ancestors

    own = selfs.select(clean_path(F.col("path")).alias("path")).filter("path <> ''")
    below = subtrees.select(clean_path(F.col("path")).alias("path")).filter("path <> ''")
    if own.isEmpty() and below.isEmpty():
        return catalog
    folders = catalog.select("folder", "folder_path").distinct()
    by_self = folders.join(own, F.col("folder_path") == F.col("path"), "left_semi").select("folder_path")
    by_tree = (
        folders.select("folder_path", F.explode(ancestors(F.col("folder"))).alias("ancestor"))
        .join(below, F.col("ancestor") == F.col("path"), "left_semi")
        .select("folder_path")
    )
    return catalog.join(by_self.union(by_tree).distinct(), "folder_path", "left_semi")
