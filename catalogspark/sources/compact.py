"""Reader of the dictionary-encoded corpus form (version 2)."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogspark.operators.ranking import sorted_position
from catalogspark.schema import COMPACT

# Records of shard s get ord = s * SHARD_STRIDE + position; one document cannot hold more.
SHARD_STRIDE = 1 << 32

# The one supported version, and fields per record.
VERSION = 2
RECORD_FIELDS = 6


def read_compact(spark: SparkSession, path) -> DataFrame:
    """Read a corpus: one JSON document (``.json`` or ``.json.gz``), or many shards.

    A JSON document is parsed by one task, so a large corpus comes as many files;
    their name order continues the record order.
    """
    raw = (
        spark.read.schema(COMPACT + ", _corrupt STRING")
        .option("multiLine", True)
        .option("columnNameOfCorruptRecord", "_corrupt")
        .json(path)
    )
    located = raw.withColumn("shard_file", F.col("_metadata.file_path"))
    # File names are read without parsing, and numbered by a distributed sort.
    names = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("shard_file"))
    shards = sorted_position(names, ["shard_file"], "place").select("shard_file", (F.col("place") - 1).alias("shard"))
    placed = located.join(shards, "shard_file", "left")
    lost = F.raise_error(F.lit("UNKNOWN_SHARD")).cast("bigint")
    return placed.withColumn("shard", F.coalesce("shard", lost)).drop("shard_file")


def decode_compact(raw: DataFrame) -> DataFrame:
    """CATALOG rows of raw corpus documents (columns v, rp, fd, rc and optionally shard)."""
    corrupt = F.col("_corrupt").isNotNull() if "_corrupt" in raw.columns else F.lit(False)
    supported = (
        (F.col("v") == VERSION)
        & F.col("rp").isNotNull() & F.col("fd").isNotNull() & F.col("rc").isNotNull()
    )
    checked = (
        F.when(corrupt, F.raise_error(F.lit("INVALID_CORPUS")).cast("array<variant>"))
        .when(supported, F.col("rc"))
        .otherwise(F.raise_error(F.lit("UNSUPPORTED_CORPUS")).cast("array<variant>"))
    )
    # Dictionaries are resolved inside the array, so they are never copied per record.
    # Each record is taken apart once; its fields are then read from the array.
    taken = F.transform(checked, lambda item: F.try_variant_get(item, "$", "array<variant>"))
    records = F.transform(taken, lambda fields: _record(fields, F.col("rp"), F.col("fd")))
    shard = F.col("shard") if "shard" in raw.columns else F.lit(0)
    return raw.select(shard.alias("shard"), F.posexplode(records).alias("pos", "r")).select(
        (F.col("shard") * SHARD_STRIDE + F.col("pos")).cast("bigint").alias("ord"), "r.*"
    )


def _record(fields: Column, repos: Column, folders: Column) -> Column:
    folder = F.coalesce(F.get(folders, _index(F.get(fields, 3))), F.array().cast("array<string>"))
    kept = F.filter(folder, lambda part: part.isNotNull() & (part != ""))
    size = F.get(fields, 4)
    decoded = F.struct(
        F.coalesce(F.get(repos, _index(F.get(fields, 0))), F.lit("")).alias("repo"),
        _text(F.get(fields, 1)).alias("file"),
        _text(F.get(fields, 2)).alias("ext"),
        kept.alias("folder"),
        F.when(_is_number(size), F.try_variant_get(size, "$", "bigint")).alias("size"),
        _truthy(F.get(fields, 5)).alias("has_txt"),
    )
    blank = F.struct(
        F.lit("").alias("repo"), F.lit("").alias("file"), F.lit("").alias("ext"),
        F.array().cast("array<string>").alias("folder"),
        F.lit(None).cast("bigint").alias("size"), F.lit(False).alias("has_txt"),
    )
    complete = F.coalesce(F.size(fields), F.lit(0)) >= RECORD_FIELDS
    return F.when(complete, decoded).otherwise(blank)


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def _is_number(value: Column) -> Column:
    return _kind(value).rlike("^(BIGINT|DECIMAL|DOUBLE)")


def _index(value: Column) -> Column:
    number = F.when(_is_number(value), F.try_variant_get(value, "$", "double"))
    return F.when(number == F.floor(number), number.try_cast("int"))


def _truthy(value: Column) -> Column:
    """NULL, false, 0 and the empty string are false; all else is true."""
    kind = _kind(value)
    return F.coalesce(
        F.when(value.isNull() | (kind == "VOID"), F.lit(False))
        .when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))
        .when(kind == "STRING", F.try_variant_get(value, "$", "string") != "")
        .when(_is_number(value), F.try_variant_get(value, "$", "double") != 0)
        .otherwise(F.lit(True)),
        F.lit(False),
    )


def _text(value: Column) -> Column:
    text = F.when(_truthy(value), F.try_variant_get(value, "$", "string"))
    return F.coalesce(text, F.lit(""))
