"""A corpus pipeline of five stages over the table of documents.

Every stage reads what its predecessor kept and applies its own decisions: rejected documents, repeated
lines and near duplicates go, sources are mixed to their target weights by repeating or leaving out
documents, and what is left is packed into training sequences. All but the last return the columns
of their input.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogspark.llm import jaccard_join, line_runs, mixing, packing, quality
from catalogspark.llm.common import read
from catalogspark.llm.queries import word_vocabulary
from catalogspark.sources.tables import scratch

# SQL has neither the models nor the packing of these stages; tests compare them with brute force.
ORACLE_SQL = None


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and score at least the fitted threshold."""
    judged = quality.quality_rules(docs, read(spark, sf_dir, "labels"))
    return judged.filter(F.col(f"`{judged.columns[-1]}`")).select(*_columns(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated lines; ``n_chars``, where there is one, counts the new text."""
    done = line_runs.dedup_lines(docs)
    text = F.col(f"`{done.columns[-1]}`")
    new = {"text": text, "n_chars": F.char_length(text).cast("bigint")}
    return done.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates."""
    return jaccard_join.one_per_group(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.apply_copies(docs, mixing.mix(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences."""
    return packing.pack(docs, word_vocabulary())


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("mix_sources", mix_sources),
    ("pack", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents; every result is stored and read again by the next."""
    docs = read(spark, sf_dir, "documents")
    root = scratch(spark, "pipeline")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{root}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
