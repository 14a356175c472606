"""Random record."""

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import ORD_SPAN, pick_by_ord


def random_record(
    catalog: DataFrame, repo: str = "", txt_only: bool = False,
    value: float | None = None, span: int = ORD_SPAN,
) -> DataFrame:
    """One record, at index floor(value * n) of the candidates in catalog order.

    ``value`` is drawn on the driver when absent, so retried tasks agree on it.
    """
    candidates = catalog.filter("has_txt") if txt_only else catalog
    if repo:
        candidates = candidates.filter(F.col("repo") == repo)
    return pick_by_ord(candidates, [], _index(random.random() if value is None else value), span=span)


def random_record_per_repo(
    catalog: DataFrame, value: float, txt_only: bool = False, span: int = ORD_SPAN
) -> DataFrame:
    """The same pick for every repo in one job."""
    candidates = catalog.filter("has_txt") if txt_only else catalog
    return pick_by_ord(candidates, ["repo"], _index(value), span=span)


def _index(value: float):
    drawn = F.floor(F.lit(max(0.0, float(value))) * F.col("_total"))
    return F.least(F.col("_total") - 1, drawn)
