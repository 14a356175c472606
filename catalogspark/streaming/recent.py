"""Recent distinct queries per user, from a table or a stream of query events."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed value: queries kept per user.
HISTORY_MAX = 20


def last_use(events: DataFrame) -> DataFrame:
    """Latest time of every (user_id, q); blank queries are not history."""
    return (
        events.filter(F.col("q") != "").groupBy("user_id", "q").agg(F.max("ts").alias("ts"))
    )


def newest(uses: DataFrame, keep: int = HISTORY_MAX) -> DataFrame:
    """The ``keep`` newest queries of each user, ranked; ties by query text."""
    order = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.asc("q"))
    return uses.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep)


def recent_queries(events: DataFrame, keep: int = HISTORY_MAX) -> DataFrame:
    """Batch form over events (user_id, ts, q)."""
    return newest(last_use(events), keep)


def start_recent_queries(
    events: DataFrame, path: str, checkpoint: str, keep: int = HISTORY_MAX, **trigger
):
    """Stream form: every micro-batch adds its own newest queries per user.

    A batch overwrites only its own partition, so a replay changes nothing. Late
    events need no watermark: a query is in the overall top rows exactly if it is in
    the top rows of the batch that holds its last use.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        newest(last_use(batch), keep).drop("rank").write.mode("overwrite").parquet(
            f"{path}/batch={batch_id}"
        )

    writer = events.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def read_recent_queries(
    spark: SparkSession, path: str, keep: int = HISTORY_MAX,
    compacted: str | None = None, upto: int | None = None,
) -> DataFrame:
    """Current history: the per-batch rows merged, optionally on top of a compacted history.

    ``upto`` is the last batch that ``compacted`` holds; only later batches are read.
    """
    rows = spark.read.parquet(path)
    if compacted is not None:
        base = spark.read.parquet(compacted).select("user_id", "q", "ts")
        rows = rows.filter(F.col("batch") > upto).select("user_id", "q", "ts").union(base)
    return newest(last_use(rows), keep)


def compact_recent_queries(
    spark: SparkSession, path: str, target: str, keep: int = HISTORY_MAX,
    compacted: str | None = None, upto: int | None = None,
) -> int:
    """Store the merged history in the new folder ``target``; returns the last batch it holds.

    Batches up to that one are no longer read when both are passed to
    :func:`read_recent_queries`, and can be removed.
    """
    last = spark.read.parquet(path).agg(F.max("batch")).first()[0]
    merged = read_recent_queries(spark, path, keep, compacted, upto)
    merged.drop("rank").write.parquet(target)
    return last
