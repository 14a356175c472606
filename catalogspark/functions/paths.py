"""Path columns: joined paths, ancestors, breadcrumbs."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def folder_path(folder: Column) -> Column:
    return F.array_join(folder, "/")


def split_path(path: Column) -> Column:
    """Inverse of :func:`folder_path`; the empty path has no components."""
    return F.when(path == "", F.array().cast("array<string>")).otherwise(F.split(path, "/"))


def clean_path(path: Column) -> Column:
    """Strip runs of slashes at both ends; NULL becomes the empty path."""
    return F.regexp_replace(F.coalesce(path, F.lit("")), "^/+|/+$", "")


def full_name(file: Column, ext: Column) -> Column:
    return F.when(F.coalesce(ext, F.lit("")) == "", file).otherwise(F.concat(file, F.lit("."), ext))


def relative_path(folder: Column, file: Column, ext: Column) -> Column:
    name = F.coalesce(full_name(file, ext), F.lit(""))
    return F.array_join(F.concat(folder, F.array(name)), "/")


def ancestors(folder: Column) -> Column:
    """All ancestor-or-self paths, shortest first; empty for a root file."""
    # sequence(1, 0) counts down instead of being empty, hence the guard.
    return F.when(F.size(folder) < 1, F.array().cast("array<string>")).otherwise(
        F.transform(
            F.sequence(F.lit(1), F.size(folder)),
            lambda depth: F.array_join(F.slice(folder, F.lit(1), depth), "/"),
        )
    )


def breadcrumb(folder: Column) -> Column:
    """One (label, path) struct per level, root level first."""
    return F.transform(
        F.arrays_zip(folder.alias("label"), ancestors(folder).alias("path")),
        lambda step: F.struct(step["label"].alias("label"), step["path"].alias("path")),
    )
