"""Line deduplication with levelled sorted runs of line hashes.

A run holds one row per line key: in how many documents it was found, and the largest
``doc_id`` among them, sorted by hash. Documents come in batches. The keys of a batch are merge-anti-joined with the runs:
keys that no run holds become a run of their own, so runs never share a key; keys that a run already holds are
set aside as a batch of repetitions. Once a level has ``fanout`` runs they are compacted into one of the next level.
A key is repeated if it has repetitions or its first batch alone holds it often enough; its counts are those of its run
and its repetitions together, so the many keys that occur once are never aggregated again.

Every batch is as large as all before it, from ``BATCH_BYTES`` of text on: batches grow in number with the logarithm of the
input, and all anti-joins together read about twice the keys.

Defined results: a null or empty text is one empty line; rows without ``doc_id`` count as
documents but lose no line; repeated rows count one by one; lines of an eligible key that stand
several times in the keeping document all stay; an empty table gives an empty table. Only
``doc_id`` and the text column are read, other columns pass through whatever their names.
"""

import hashlib
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalogspark.llm.common import batch_of, filled, small_batches, small_side, tidy, unused
from catalogspark.sources.tables import scratch

MIN_CHARS = 40
MIN_DOCS = 5
FANOUT = 4
# Bytes of text in the first batch, about.
BATCH_BYTES = 32 << 20

_GAPS = b" \t\n\x0b\x0c\r"
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = bytes.maketrans(_UPPER, _UPPER.lower())
_KEYS = "h1 bigint, h2 bigint"


def _line_key(line: bytes, min_chars: int):
    """Hash of a line's key as two 64-bit numbers; None for keys that are too short."""
    key = line.strip(_GAPS)
    if len(key) < min_chars or len(key.decode()) < min_chars:
        return None
    digest = hashlib.blake2b(key.translate(_LOWER), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def batch_count(docs: DataFrame, batch_bytes: int = BATCH_BYTES) -> int:
    """Batches, each as large as all before it, of which the first has about ``batch_bytes``."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return 1 + (int(size) // batch_bytes).bit_length()


def line_keys(docs: DataFrame, batches: int, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per document and distinct eligible key: doc_id, h1, h2, batch."""
    schema = pa.schema([("doc_id", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64())])

    def keys(stream):
        for batch in stream:
            rows = []
            ids = batch.column(0).to_pylist()
            for doc, text in zip(ids, filled(batch.column(1))):
                found = {_line_key(line, min_chars) for line in text.as_py().encode().split(b"\n")}
                rows += [(doc, *k) for k in found if k is not None]
            yield batch_of(schema, list(zip(*rows)) or [[], [], []])

    found = docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(tidy(keys), f"doc_id bigint, {_KEYS}")
    # Half of all hashes are odd, half of the others end in 10, and so on: the last batch is the largest.
    hash_ = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 62))
    zeros = F.length(F.regexp_extract(F.bin(hash_), "(0*)$", 1))
    return found.withColumn("batch", F.lit(batches - 1) - F.least(zeros, F.lit(batches - 1)))


class LineRuns:
    """The runs of all batches so far, by level, stored below the cluster's shared folder."""

    def __init__(self, spark, fanout: int = FANOUT):
        self.spark, self.fanout, self.levels, self.again = spark, fanout, [[]], []
        self.root = scratch(spark, "line-runs")
        self.written = 0

    def _store(self, rows: DataFrame) -> DataFrame:
        path = f"{self.root}/{self.written:05d}"
        self.written += 1
        # Hash partitions, each sorted: parts of equal keys meet when runs are merged.
        rows.repartition("h1").sortWithinPartitions("h1", "h2").write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    @staticmethod
    def _merged(rows: DataFrame) -> DataFrame:
        return rows.groupBy("h1", "h2").agg(
            F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc")
        )

    def add(self, keys: DataFrame) -> None:
        """Add a batch of (doc_id, h1, h2) rows: unseen keys as a run, others as repetitions; then compact full levels."""
        rows = keys.select("h1", "h2", F.lit(1).cast("bigint").alias("n_docs"), F.col("doc_id").alias("last_doc"))
        rows = self._merged(rows)
        first = not any(self.levels)
        if not first:
            rows = self._store(rows)
        fresh = self._store(self.unseen(rows))
        if not first:
            self.again.append(self._store(rows.join(fresh.hint("merge"), ["h1", "h2"], "left_anti")))
        self.levels[0].append(fresh)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            if level + 1 == len(self.levels):
                self.levels.append([])
            # Runs share no keys, so compaction only sorts.
            self.levels[level + 1].append(self._store(self._union(self.levels[level])))
            self.levels[level] = []
            level += 1

    @staticmethod
    def _union(runs: list) -> DataFrame:
        out = runs[0]
        for run in runs[1:]:
            out = out.unionAll(run)
        return out

    def unseen(self, keys: DataFrame) -> DataFrame:
        """Rows of ``keys`` that no run holds: one merge anti-join per run."""
        for level in self.levels:
            for run in level:
                keys = keys.join(run.hint("merge"), ["h1", "h2"], "left_anti")
        return keys

    def all(self) -> DataFrame:
        """One row per key: its run's row, with its repetitions."""
        runs = [run for level in self.levels for run in level]
        if not runs:
            return self.spark.createDataFrame([], f"{_KEYS}, n_docs bigint, last_doc bigint")
        held = self._union(runs)
        if not self.again:
            return held
        again = self._merged(self._union(self.again)).select(
            F.col("h1").alias("k1"), F.col("h2").alias("k2"), F.col("n_docs").alias("more"), F.col("last_doc").alias("later")
        )
        same = (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2"))
        return held.join(again, same, "left").select(
            "h1", "h2", (F.col("n_docs") + F.coalesce("more", F.lit(0))).alias("n_docs"), F.greatest("last_doc", "later").alias("last_doc")
        )


def first_holders(spark, batches: Iterable[DataFrame], fanout: int = FANOUT):
    """Batch by batch: the keys of each batch that no earlier batch had (smallest doc_id holds them)."""
    runs = LineRuns(spark, fanout)
    for keys in batches:
        fresh = runs.unseen(keys)
        yield fresh.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"))
        runs.add(keys)


def dedup_lines(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int | None = None,
    fanout: int = FANOUT,
) -> DataFrame:
    """``docs`` with repeated lines cut from ``text``; adds n_lines, n_dropped and kept_text last.

    A key of ``min_chars`` code points found in ``min_docs`` documents keeps its lines only in
    the largest ``doc_id`` that holds it.
    """
    spark = small_batches(docs).sparkSession
    path = scratch(spark, "line-keys")
    batches = batches or batch_count(docs)
    # One file per task; its rows come sorted by batch, so a batch reads its own pages.
    line_keys(docs, batches, min_chars).sortWithinPartitions("batch").write.parquet(path)
    keys = spark.read.schema(f"doc_id bigint, {_KEYS}, batch int").parquet(path)
    runs = LineRuns(spark, fanout)
    for batch in range(batches):
        runs.add(keys.filter(F.col("batch") == batch))
    repeated = runs.all().filter(F.col("n_docs") >= min_docs)
    lost = (
        keys.join(small_side(repeated), ["h1", "h2"]).filter(F.col("doc_id") < F.col("last_doc"))
        .groupBy("doc_id").agg(F.collect_set("h1").alias("lost"))
    )
    return _without_lines(docs, lost, min_chars)


def _without_lines(docs: DataFrame, lost: DataFrame, min_chars: int) -> DataFrame:
    key, cut = unused(docs, "lost_doc"), unused(docs, "lost")
    columns = docs.columns
    at = columns.index("text")
    # Stored once: measuring it and joining it would otherwise repeat the work.
    spark = docs.sparkSession
    path = scratch(spark, "lost-lines")
    lost.write.parquet(path)
    lost = spark.read.schema("doc_id bigint, lost array<bigint>").parquet(path).toDF(key, cut)
    joined = docs.join(small_side(lost), F.col("doc_id").cast("bigint") == F.col(key), "left").select(
        *[docs[f"`{c}`"] for c in columns], cut
    )
    names = {n: unused(docs, n) for n in ("n_lines", "n_dropped", "kept_text")}
    schema = T.StructType([
        *docs.schema.fields, T.StructField(names["n_lines"], T.LongType()),
        T.StructField(names["n_dropped"], T.LongType()), T.StructField(names["kept_text"], T.StringType()),
    ])

    def apply(stream):
        for batch in stream:
            n_lines, n_dropped, kept = [], [], []
            for text, keys in zip(filled(batch.column(at)), batch.column(batch.num_columns - 1)):
                lines = text.as_py().encode().split(b"\n")
                n_lines.append(len(lines))
                if keys.is_valid:
                    gone = set(keys.as_py())
                    marks = [_line_key(line, min_chars) for line in lines]
                    left = [line for line, k in zip(lines, marks) if k is None or k[0] not in gone]
                else:
                    left = lines
                n_dropped.append(len(lines) - len(left))
                kept.append(b"\n".join(left).decode())
            out = batch.columns[:-1] + [
                pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())
            ]
            yield pa.RecordBatch.from_arrays(out, names=[*batch.schema.names[:-1], *names.values()])

    return joined.mapInArrow(tidy(apply), schema)
