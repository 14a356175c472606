"""Connected components of a link table, with joins and grouping only."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogspark.session import freeze

PARTITION_LINKS = 250_000


def _both_ways(links: DataFrame) -> DataFrame:
    return links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _state(links: DataFrame):
    # Equal link sets have equal counts and hash sums.
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % (1 << 30))).first())


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node in ``links`` (a, b: bigint).

    Alternates two steps until nothing changes: every node hands its larger neighbours to its
    smallest neighbour, then its smaller ones. Both keep components and number of links, and paths
    shrink to stars in about log(longest path) rounds. Minima are aggregated before the shuffle, and the
    join that hands neighbours on may be split where a node has very many.
    """
    links = freeze(
        links.filter(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    state = _state(links)
    while state[0]:
        around = _both_ways(links)
        low = around.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low")).withColumnRenamed("a", "of")
        large = (
            around.filter(F.col("b") > F.col("a")).join(low, F.col("a") == F.col("of"))
            .filter(F.col("b") != F.col("low")).select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        )
        # Now a > b in every link, so the smaller neighbours of a node are all its b.
        low = large.groupBy("a").agg(F.min("b").alias("low")).withColumnRenamed("a", "of")
        small = (
            large.join(low, F.col("a") == F.col("of"))
            .select(F.when(F.col("b") == F.col("low"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("low").alias("b"))
            .filter(F.col("a") != F.col("b")).distinct()
        )
        # Never more links than before: few links need few partitions (and files).
        links = freeze(small.coalesce(1 + state[0] // PARTITION_LINKS))
        after = _state(links)
        if after == state:
            break
        state = after
    top = links.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    return top.unionAll(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
