"""Incremental generations: a change of a corpus is stored as a part beside the parts it changes.

A part holds the records that a change added (or whose copy number it changed), with their postings, the ords that
it takes out of earlier parts (tombstones), the vocabulary rows of the tokens it touched, and signed facet and folder
counts. A generation is a list of parts. Reading one unions its parts: a record or posting counts unless a
later part has a tombstone for its ord, of a token the latest row counts, and counts are summed.

Parts have levels. ``FANOUT`` consecutive parts of one level are merged into one of the next, so a corpus of many small
changes has few parts, and every record is rewritten once a level.

Ords of added records lie above all earlier ones, so record order, copy numbers and first occurrences are those of a full
publish of the same records. Nothing is overwritten: all parts of earlier generations stay readable.
"""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogspark.functions.paths import folder_path
from catalogspark.operators.catalog import with_record_id
from catalogspark.operators.facets import facet_cube
from catalogspark.operators.index import postings
from catalogspark.operators.tree import folder_counts
from catalogspark.plans.publish import claim, highest
from catalogspark.plans.search import RECORD, SearchIndex
from catalogspark.session import broadcast_if_small, freeze, row_bytes

FANOUT = 4
# The first part is as large as the corpus; small changes reach its level late.
FIRST_LEVEL = 3

# How the rows of each table are clustered when stored.
ORDER = {
    "records": ("ord",), "postings": ("scope", "token", "ord"), "vocab": ("scope", "token"), "tombstones": ("ord",),
    "cube": ("repo", "ext"), "folders": ("repo",),
}
KEY = ("repo", "folder_path", "file", "ext")


def _small(df: DataFrame) -> DataFrame:
    """``df``, stored, with a broadcast hint if its measured bytes allow."""
    df = freeze(df)
    return broadcast_if_small(df, df.select(row_bytes(*df.columns)).first()[0])


class Corpus:
    """A corpus below ``root`` that grows by parts."""

    def __init__(self, spark: SparkSession, root: str, fanout: int = FANOUT):
        self.spark, self.root, self.fanout = spark, root, fanout

    # --- generations and their parts -----------------------------------------------

    def latest(self) -> int:
        return highest(self.spark, f"{self.root}/parts")

    def parts(self, generation: int) -> list[tuple[int, int]]:
        """(part, level) of a generation, oldest first: a short list, as levels bound it."""
        rows = self.spark.read.parquet(f"{self.root}/parts/generation={generation}").collect()
        return sorted((r["part"], r["level"]) for r in rows)

    def _finish(self, generation: int, parts: list) -> int:
        """The list of parts, written last, makes the generation visible."""
        self.spark.createDataFrame(parts, "part bigint, level int").coalesce(1).write.parquet(
            f"{self.root}/parts/generation={generation}"
        )
        return generation

    def _begin(self) -> tuple[int, int]:
        """A claimed generation and the first of the part numbers that only it uses."""
        generation = claim(self.spark, self.root, max(self.latest(), highest(self.spark, f"{self.root}/claimed")) + 1)
        # A change writes one part, and one more for every level it fills.
        return generation, generation << 8

    def _write(self, table: str, part: int, rows: DataFrame) -> None:
        order = ORDER[table]
        rows.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(f"{self.root}/{table}/part={part}")

    def _stored(self, table: str, parts: list) -> DataFrame:
        paths = [f"{self.root}/{table}/part={part}" for part, _ in parts]
        return self.spark.read.option("basePath", f"{self.root}/{table}").parquet(*paths).withColumn("part", F.col("part").cast("bigint"))

    # --- reading -------------------------------------------------------------------

    def _live(self, table: str, parts: list) -> DataFrame:
        """Rows of records that no later part takes out."""
        rows = self._stored(table, parts)
        if len(parts) < 2:
            return rows
        gone = self._stored("tombstones", parts).groupBy(F.col("ord").alias("gone")).agg(F.max("part").alias("since"))
        return rows.join(_small(gone), (F.col("ord") == F.col("gone")) & (F.col("part") < F.col("since")), "left_anti")

    def records(self, generation: int) -> DataFrame:
        return self._live("records", self.parts(generation)).drop("part").withColumn("generation", F.lit(generation))

    def postings(self, generation: int) -> DataFrame:
        return self._live("postings", self.parts(generation)).drop("part")

    def _latest_words(self, parts: list) -> DataFrame:
        rows = self._stored("vocab", parts)
        if len(parts) < 2:
            return rows.drop("part")
        last = F.max_by(F.struct("df", "first_ord", "first_pos"), "part").alias("last")
        return rows.groupBy("scope", "token").agg(last).select("scope", "token", "last.*")

    def vocabulary(self, generation: int) -> DataFrame:
        return self._latest_words(self.parts(generation)).filter("df > 0")

    def index(self, generation: int) -> SearchIndex:
        return SearchIndex(self.postings(generation), self.vocabulary(generation))

    def cube(self, generation: int) -> DataFrame:
        return self._summed("cube", self.parts(generation)).filter("count > 0")

    def folder_counts(self, generation: int) -> DataFrame:
        return self._summed("folders", self.parts(generation)).filter("n > 0")

    def _summed(self, table: str, parts: list) -> DataFrame:
        rows = self._stored(table, parts).drop("part")
        keys = [c for c in ("repo", "ext", "folder") if c in rows.columns]
        return rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in rows.columns if c not in keys])

    # --- writing -------------------------------------------------------------------

    def start(self, catalog: DataFrame) -> int:
        """Store a whole catalog as the first part."""
        generation, part = self._begin()
        records = freeze(with_record_id(catalog.select(*RECORD)).drop("folder_path"))
        found = postings(records)
        words = found.groupBy("scope", "token").agg(F.count(F.lit(1)).alias("df"), F.min(F.struct("ord", "pos")).alias("first"))
        none = records.filter(F.lit(False)).select("ord")
        self._write_part(part, records, none, _word_rows(words), facet_cube(records), folder_counts(records))
        return self._finish(generation, [(part, FIRST_LEVEL)])

    def _write_part(self, part, records, gone, words, cube, folders) -> None:
        for table, rows in (("records", records), ("postings", postings(records)), ("tombstones", gone),
                            ("vocab", words), ("cube", cube), ("folders", folders)):
            self._write(table, part, rows)

    def change(self, added: DataFrame | None = None, removed: DataFrame | None = None) -> int:
        """Store the next generation: without the records of ``removed`` (ord), with those of ``added`` (a catalog).

        ``removed`` may name ords that are not there. Ords of ``added`` must lie above all that ever were.
        """
        generation, part = self._begin()
        before = self.parts(self.latest())
        current = self._live("records", before).drop("part")
        added = (current.filter(F.lit(False)) if added is None else added).select(*RECORD)
        added = freeze(added)
        highest_ord = self._stored("records", before).agg(F.max("ord")).first()[0]
        lowest_new = added.agg(F.min("ord")).first()[0]
        if lowest_new is not None and highest_ord is not None and lowest_new <= highest_ord:
            raise ValueError("added records need ords above all earlier ones")
        ords = _small((added.select("ord").filter(F.lit(False)) if removed is None else removed.select("ord")).distinct())
        gone = freeze(current.join(ords, "ord", "left_semi"))
        gone_ords = _small(gone.select(F.col("ord").alias("gone")))

        def left(rows: DataFrame) -> DataFrame:
            return rows.join(gone_ords, F.col("ord") == F.col("gone"), "left_anti")

        # Copy numbers change among records that share their names with added or removed ones.
        named = [df.withColumn("folder_path", folder_path(F.col("folder"))) for df in (current, gone, added)]
        touched = _small(named[1].select(*KEY).unionAll(named[2].select(*KEY)).distinct().toDF(*[f"key_{c}" for c in KEY]))
        same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"key_{c}")) for c in KEY])
        alike = left(named[0].join(touched, same, "left_semi"))
        none = F.lit(None).cast("string")
        numbered = with_record_id(
            alike.select(*RECORD, "folder_path", F.col("record_id").alias("old_id"))
            .unionAll(named[2].select(*RECORD, "folder_path", none.alias("old_id")))
        )
        written = freeze(
            numbered.filter(~F.col("record_id").eqNullSafe(F.col("old_id")))
            .select(*RECORD, "occurrence", "record_id", F.col("old_id").isNotNull().alias("renumbered"))
        )
        tombstones = gone.select("ord").unionAll(written.filter("renumbered").select("ord"))
        self._write_part(
            part, written.drop("renumbered"), tombstones, self._changed_words(before, gone, added, left),
            _signed(facet_cube(added), facet_cube(gone), "count", "txt_count"),
            _signed(folder_counts(added), folder_counts(gone), "n"),
        )
        return self._finish(generation, self._compacted([*before, (part, 0)], part))

    def _changed_words(self, before: list, gone: DataFrame, added: DataFrame, left) -> DataFrame:
        """Vocabulary rows of all tokens of added and removed records."""
        first = F.struct("ord", "pos")
        more = postings(added).groupBy("scope", "token").agg(F.count(F.lit(1)).alias("more"), F.min(first).alias("new_first"))
        less = postings(gone).groupBy("scope", "token").agg(F.count(F.lit(1)).alias("less"), F.min(first).alias("gone_first"))
        change = freeze(more.join(less, ["scope", "token"], "full"))
        known = self._latest_words(before).join(_small(change.select("scope", "token")), ["scope", "token"], "left_semi")
        joined = freeze(change.join(known, ["scope", "token"], "left").select(
            "scope", "token", (F.coalesce("df", F.lit(0)) + F.coalesce("more", F.lit(0)) - F.coalesce("less", F.lit(0))).alias("df"),
            "new_first", F.when(F.col("df") > 0, F.struct(F.col("first_ord").alias("ord"), F.col("first_pos").alias("pos"))).alias("old_first"),
            (F.col("gone_first.ord") == F.col("first_ord")).alias("lost"),
        ))
        # A token whose first record went looks its next one up in the postings.
        lost = _small(joined.filter("lost").select("scope", "token"))
        next_first = left(self._live("postings", before).join(lost, ["scope", "token"], "left_semi")).groupBy("scope", "token").agg(
            F.min(first).alias("next_first")
        )
        found = joined.join(next_first, ["scope", "token"], "left")
        old = F.when(F.coalesce("lost", F.lit(False)), F.col("next_first")).otherwise(F.col("old_first"))
        return _word_rows(found.select("scope", "token", "df", F.least(old, F.col("new_first")).alias("first")))

    def _compacted(self, parts: list, number: int) -> list:
        """Merge the last parts as long as ``fanout`` of them have one level."""
        while len(parts) >= self.fanout and len({level for _, level in parts[-self.fanout:]}) == 1:
            merged, parts = parts[-self.fanout:], parts[:-self.fanout]
            number += 1
            oldest = not parts
            words = self._latest_words(merged)
            gone = self._stored("tombstones", merged).select("ord").distinct()
            # Nothing older is left for tombstones and empty words to hide.
            tables = {
                "records": self._live("records", merged).drop("part"), "postings": self._live("postings", merged).drop("part"),
                "tombstones": gone.filter(F.lit(False)) if oldest else gone,
                "vocab": words.filter("df > 0") if oldest else words,
                "cube": self._summed("cube", merged), "folders": self._summed("folders", merged),
            }
            for table, rows in tables.items():
                self._write(table, number, rows)
            parts.append((number, merged[0][1] + 1))
        return parts


def _word_rows(words: DataFrame) -> DataFrame:
    return words.select("scope", "token", "df", F.col("first.ord").alias("first_ord"), F.col("first.pos").alias("first_pos"))


def _signed(more: DataFrame, less: DataFrame, *counts: str) -> DataFrame:
    """Counts of added rows, and of removed ones with a minus."""
    negative = less.select(*[(-F.col(c)).alias(c) if c in counts else F.col(c) for c in more.columns])
    keys = [c for c in more.columns if c not in counts]
    return more.unionAll(negative).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counts])
