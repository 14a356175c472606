"""Session helpers: checkpoint folder and size-checked broadcasts."""

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Largest table this library broadcasts on its own; above it the planner decides.
BROADCAST_BYTES = 64 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Where it is unset, a session in this process alone gets a temporary one; on a cluster
    that would be a different folder on every machine, so it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="catalogspark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def freeze(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later plans read stored rows instead of repeating the work."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def row_bytes(*columns) -> Column:
    """Aggregate: size of the given columns over all rows, as JSON text."""
    return F.coalesce(F.sum(F.length(F.to_json(F.struct(*columns)))), F.lit(0))


def broadcast_if_small(df: DataFrame, size: int | None) -> DataFrame:
    """Broadcast ``df`` when its measured size (bytes) is known and within the limit."""
    return F.broadcast(df) if size is not None and size <= BROADCAST_BYTES else df
