"""Filter predicates.

Arguments are either Python values (one query: plain comparisons that reach the
Parquet scan) or columns of a query table (a batch). An argument list that is
NULL or empty means "no filter".
"""

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import ancestors, clean_path


def _no_values(values: Column) -> Column:
    return F.coalesce(F.size(values), F.lit(0)) < 1


def _any(conditions: list) -> Column:
    return reduce(or_, conditions, F.lit(False))


def _member(value: Column, values) -> Column:
    """Membership test; always true for an absent list."""
    if isinstance(values, Column):
        return _no_values(values) | F.array_contains(values, value)
    return value.isin(list(values)) if values else F.lit(True)


def repo_in(repo: Column, repos) -> Column:
    return _member(repo, repos)


def qualify_repos(repos: Column, owner: str) -> Column:
    """Give short repository names their owner prefix."""
    return F.transform(
        repos, lambda r: F.when(F.contains(r, F.lit("/")), r).otherwise(F.concat(F.lit(owner + "/"), r))
    )


def extension_in(ext: Column, extensions) -> Column:
    """Only the record side is lower-cased; blank extensions never pass a list."""
    return _member(F.lower(F.coalesce(ext, F.lit(""))), extensions)


def _clean(path: str | None) -> str:
    return (path or "").strip("/")


def folder_exact(folder_path: Column, folders) -> Column:
    if isinstance(folders, Column):
        return _no_values(folders) | F.array_contains(F.transform(folders, clean_path), folder_path)
    return _member(folder_path, [_clean(f) for f in folders or []])


def folder_subtree(folder_path: Column, folders) -> Column:
    """At or below one of the folders; the empty folder selects root files only."""
    if isinstance(folders, Column):

        def below(folder: Column) -> Column:
            clean = clean_path(folder)
            prefix = F.concat(clean, F.lit("/"))
            return (folder_path == clean) | ((clean != "") & F.startswith(folder_path, prefix))

        return _no_values(folders) | F.exists(folders, below)
    if not folders:
        return F.lit(True)
    return _any([_at_or_below(folder_path, _clean(f)) for f in folders])


def _at_or_below(folder_path: Column, folder: str) -> Column:
    same = folder_path == folder
    return same | folder_path.startswith(folder + "/") if folder else same


def _clean_set(paths: Column) -> Column:
    cleaned = F.transform(F.coalesce(paths, F.array().cast("array<string>")), clean_path)
    return F.filter(cleaned, lambda p: p != "")


def folder_mixed(folder: Column, folder_path: Column, selfs, subtrees) -> Column:
    """In a chosen folder itself, or at or below a chosen subtree."""
    if isinstance(selfs, Column) or isinstance(subtrees, Column):
        self_set, subtree_set = _clean_set(selfs), _clean_set(subtrees)
        return (
            ((F.size(self_set) == 0) & (F.size(subtree_set) == 0))
            | F.array_contains(self_set, folder_path)
            | F.arrays_overlap(ancestors(folder), subtree_set)
        )
    self_list = [p for p in map(_clean, selfs or []) if p]
    subtree_list = [p for p in map(_clean, subtrees or []) if p]
    if not self_list and not subtree_list:
        return F.lit(True)
    return folder_path.isin(self_list) | _any([_at_or_below(folder_path, p) for p in subtree_list])


def folder_filter(folder, folder_path, mode, folders, selfs, subtrees) -> Column:
    if isinstance(mode, Column):
        return (
            F.when(mode == "mixed", folder_mixed(folder, folder_path, selfs, subtrees))
            .when(mode == "exact", folder_exact(folder_path, folders))
            .otherwise(folder_subtree(folder_path, folders))
        )
    if mode == "mixed":
        return folder_mixed(folder, folder_path, selfs, subtrees)
    if mode == "exact":
        return folder_exact(folder_path, folders)
    return folder_subtree(folder_path, folders)


def size_between(size: Column, min_size, max_size) -> Column:
    """Inclusive bounds; unknown and zero sizes always pass."""

    def bound(limit, test) -> Column:
        if isinstance(limit, Column):
            return limit.isNull() | test(limit)
        return F.lit(True) if limit is None else test(limit)

    low = bound(min_size, lambda v: size >= v)
    high = bound(max_size, lambda v: size <= v)
    return size.isNull() | (size <= 0) | (low & high)


def clean_list(paths: Column) -> Column:
    return F.transform(paths, clean_path)


def up_paths(folder: Column) -> Column:
    """A record's folder and all folders above it; the empty path alone for root files."""
    return F.when(F.size(folder) < 1, F.array(F.lit(""))).otherwise(ancestors(folder))


def folder_filter_by_paths(up: Column, folder_path, mode, folders, selfs, subtrees) -> Column:
    """:func:`folder_filter` over cleaned lists and :func:`up_paths`.

    Plain array functions only, so the test stays inside generated code.
    """
    mode = F.coalesce(mode, F.lit(""))
    # The empty path stands for "root files" in a folder list, and for nothing in a mixed set.
    own, below = (F.array_remove(F.coalesce(p, F.array().cast("array<string>")), "") for p in (selfs, subtrees))
    mixed = (
        ((F.size(own) == 0) & (F.size(below) == 0))
        | F.array_contains(own, folder_path) | F.arrays_overlap(up, below)
    )
    plain = F.when(mode == "exact", F.array_contains(folders, folder_path)).otherwise(
        F.arrays_overlap(up, folders)
    )
    return F.when(mode == "mixed", mixed).otherwise(_no_values(folders) | plain)


FOLDER_FIELDS = ("folders", "folder_selfs", "folder_subtrees")


def is_unfiltered() -> Column:
    """Whether a query row sets no filter at all (lists already cleaned)."""
    any_set = [~_no_values(F.col(f)) for f in ("repos", "extensions", *FOLDER_FIELDS)]
    bounded = F.col("min_size").isNotNull() | F.col("max_size").isNotNull()
    return ~(reduce(or_, any_set) | bounded)


def used_filters() -> list:
    """Aggregates that tell which filter fields any query of a table sets."""
    lists = ("repos", "extensions", *FOLDER_FIELDS)
    return [F.bool_or(~_no_values(F.col(f))).alias("uses_" + f) for f in lists] + [
        F.bool_or(F.col(f).isNotNull()).alias("uses_" + f) for f in ("min_size", "max_size")
    ]


def passes_used_filters(row: dict, query: dict, used: dict) -> Column:
    """The filters that some query of a batch sets; ``row`` holds ``up`` when folders are used."""
    tests = []
    if used["uses_repos"]:
        tests.append(repo_in(row["repo"], query["repos"]))
    if used["uses_extensions"]:
        tests.append(extension_in(row["ext"], query["extensions"]))
    if any(used["uses_" + f] for f in FOLDER_FIELDS):
        lists = [query[f] for f in FOLDER_FIELDS]
        tests.append(
            folder_filter_by_paths(row["up"], row["folder_path"], query["folder_match_mode"], *lists)
        )
    if used["uses_min_size"] or used["uses_max_size"]:
        tests.append(size_between(row["size"], query["min_size"], query["max_size"]))
    return reduce(and_, tests, F.lit(True))


def passes_filters(row: dict, query: dict) -> Column:
    """All filters of one query (or query row) over one record."""
    return (
        repo_in(row["repo"], query["repos"])
        & extension_in(row["ext"], query["extensions"])
        & folder_filter(
            row["folder"], row["folder_path"], query["folder_match_mode"],
            query["folders"], query["folder_selfs"], query["folder_subtrees"],
        )
        & size_between(row["size"], query["min_size"], query["max_size"])
    )
