"""Exact positions without sorting a whole group in one task."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalogspark.session import freeze

# Width of the ord ranges that large groups are cut into: one range of one group
# is the most that a single window task sorts.
ORD_SPAN = 1 << 20

_OFFSET_BITS = 33  # layout of monotonically_increasing_id: partition number, row number


def position_by_ord(
    df: DataFrame, keys: list, out: str, ord_col: str = "ord", span: int = ORD_SPAN,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Add the 0-based position of each row in its group, in ``ord`` order.

    Groups are cut into ord ranges. A row's position is its rank in its own range
    plus the sizes of the group's earlier ranges, so a group holding a third of
    the table is still spread over many tasks. Only groups that really span
    several ranges reach the join. ``counted`` may name a cheaper source of the same
    rows for those sizes, when ``df`` is the end of a long plan.
    """

    def in_ranges(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_range", _range_start(ord_col, span))

    cut = in_ranges(df)
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        in_ranges(df if counted is None else counted).groupBy(*keys, "_range")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_offset", F.sum("_n").over(earlier))
        .filter(F.col("_offset") > 0)
        .select(*_renamed(keys), F.col("_range").alias("_at"), "_offset")
    )
    within = Window.partitionBy(*keys, "_range").orderBy(ord_col)
    ranked = cut.withColumn("_rank", F.row_number().over(within) - 1)
    return ranked.join(offsets, _same(keys), "left").select(
        *df.columns,
        (F.col("_rank") + F.coalesce("_offset", F.lit(0))).cast("bigint").alias(out),
    )


def _range_start(ord_col: str, span: int) -> Column:
    return F.col(ord_col) - F.pmod(F.col(ord_col), F.lit(span))


def _renamed(keys: list) -> list:
    return [F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)]


def _same(keys: list) -> list:
    # Null-safe: NULL is a group of its own for the window as well.
    return [F.col("_range") == F.col("_at")] + [
        F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)
    ]


def pick_by_ord(
    df: DataFrame, keys: list, wanted: Column, ord_col: str = "ord", span: int = ORD_SPAN
) -> DataFrame:
    """Keep, per group, the row whose 0-based position in ord order is ``wanted``.

    ``wanted`` may use ``_total``, the size of the group. Only the one ord range
    that holds the wanted row is ranked.
    """
    cut = df.withColumn("_range", _range_start(ord_col, span))
    group = Window.partitionBy(*keys)
    counts = cut.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
    target = (
        counts.withColumn("_total", F.sum("_n").over(group))
        .withColumn(
            "_before",
            F.sum("_n").over(group.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0))
            - F.col("_n"),
        )
        .withColumn("_wanted", wanted)
        .filter((F.col("_wanted") >= F.col("_before")) & (F.col("_wanted") < F.col("_before") + F.col("_n")))
        .select(
            *_renamed(keys), F.col("_range").alias("_at"),
            (F.col("_wanted") - F.col("_before")).alias("_within"),
        )
    )
    held = cut.join(target, _same(keys)).select(*df.columns, "_within")
    order = Window.partitionBy(*keys).orderBy(ord_col)
    return (
        held.withColumn("_rank", F.row_number().over(order) - 1)
        .filter(F.col("_rank") == F.col("_within"))
        .drop("_rank", "_within")
    )


def sorted_position(df: DataFrame, order: list, out: str) -> DataFrame:
    """Add the 1-based position of each row in a total order (the last key must be unique).

    A range-partitioned sort is stored once; partition sizes then turn row numbers
    within partitions into positions. No window without keys, no single-task sort.
    """
    numbered = freeze(
        df.orderBy(*order).withColumn("_row", F.monotonically_increasing_id())
    ).withColumn("_part", F.shiftright("_row", _OFFSET_BITS))
    sizes = numbered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # One row per sort partition, so this window and broadcast stay small.
    earlier = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start")
    )
    row_in_part = F.col("_row").bitwiseAND(F.lit((1 << _OFFSET_BITS) - 1))
    return (
        numbered.join(F.broadcast(starts), "_part")
        .withColumn(out, F.col("_start") + row_in_part + 1)
        .drop("_part", "_row", "_start")
    )


def sorted_position_in_group(df: DataFrame, keys: list, order: list, out: str) -> DataFrame:
    """Like :func:`sorted_position`, restarting at 1 for every group (keys must not be NULL)."""
    placed = sorted_position(df, [*keys, *order], "_place")
    starts = placed.groupBy(*keys).agg(F.min("_place").alias("_first"))
    return (
        placed.join(starts, keys)
        .withColumn(out, F.col("_place") - F.col("_first") + 1)
        .drop("_place", "_first")
    )
