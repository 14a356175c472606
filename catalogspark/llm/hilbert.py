"""Sharding along a Hilbert curve over several metadata dimensions.

Every dimension is quantised to ``2**BITS`` levels: texts by their rank among the distinct values,
numbers by approximate quantiles. Rows are sorted by their index on the Hilbert curve through that
grid and the sorted order is cut into runs of equal row counts, so each shard covers a compact block of
every dimension and a filter on any of them skips most files.

Only DataFrame functions are used. Defined results: null texts come before all others, null
numbers are level 0; documents of equal texts lie together, where the one with the smallest ``doc_id`` lies; equal
places on the curve are ordered by text checksum, then ``doc_id``, nulls first; repeated rows take places of
their own; an empty table gives an empty table. Row counts differ by one at most, also with fewer
rows than shards.
"""

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogspark.llm.common import small_side, unused
from catalogspark.operators.ranking import sorted_position
from catalogspark.session import freeze

SHARDS = 24
BITS = 5
# Bytes of a row besides its text.
ROW_BYTES = 8


def _curve_tables(n: int) -> dict:
    """Lookup tables of the curve in ``n`` dimensions, from its Gray-code rule."""
    side = 1 << n
    gray = [w ^ (w >> 1) for w in range(side)]

    def trailing(w):
        return (~w & (w + 1)).bit_length() - 1

    def turned(x, k):
        return ((x >> k) | (x << (n - k))) & (side - 1)

    def direction(w):
        if w == 0:
            return 0
        return trailing(w if w % 2 else w - 1) % n

    return {
        "place": [gray.index(x) for x in range(side)],
        "entry": [gray[2 * ((w - 1) // 2)] if w else 0 for w in range(side)],
        "direction": [direction(w) for w in range(side)],
        "right": [turned(x, (d + 1) % n) for d in range(n) for x in range(side)],
        "left": [turned(x, (n - (d + 1) % n) % n) for d in range(n) for x in range(side)],
    }


def hilbert_index(levels: list, bits: int) -> Column:
    """Index on the curve of a grid cell; ``levels`` are non-negative integers below ``2**bits``."""
    n = len(levels)
    side = 1 << n
    table = {k: F.array(*[F.lit(x) for x in v]) for k, v in _curve_tables(n).items()}

    def step(state, bit):
        corner = F.lit(0)
        for j, level in enumerate(levels):
            here = F.call_function("shiftright", level.cast("int"), bit).bitwiseAND(F.lit(1))
            corner = corner.bitwiseOR(F.shiftleft(here, j))
        turned = F.get(table["right"], state["d"] * side + corner.bitwiseXOR(state["e"]))
        w = F.get(table["place"], turned)
        entered = F.get(table["left"], state["d"] * side + F.get(table["entry"], w))
        return F.struct(
            state["e"].bitwiseXOR(entered).alias("e"),
            ((state["d"] + F.get(table["direction"], w) + 1) % n).alias("d"),
            (state["h"] * side + w).cast("bigint").alias("h"),
        )

    start = F.struct(F.lit(0).alias("e"), F.lit(0).alias("d"), F.lit(0).cast("bigint").alias("h"))
    order = F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1))
    return F.aggregate(order, start, step, lambda state: state["h"])


def _text_level(rows: DataFrame, name: str, bits: int, out: str) -> DataFrame:
    """Add the level of a text column: its rank among distinct values, scaled."""
    values = rows.groupBy(name).agg(F.count(F.lit(1)).alias("n")).select(
        F.col(name).isNull().alias("is_null"), F.coalesce(name, F.lit("")).alias("value")
    )
    # false sorts before true: null values take the first place.
    placed = freeze(sorted_position(values.withColumn("known", ~F.col("is_null")), ["known", "value"], "place"))
    total = max(placed.count(), 1)
    level = F.floor((F.col("place") - 1) * (1 << bits) / total).cast("int")
    ranks = placed.select(F.when(F.col("known"), F.col("value")).alias("level_of"), level.alias(out))
    return rows.join(small_side(ranks), F.col(name).eqNullSafe(F.col("level_of"))).drop("level_of")


def _number_level(rows: DataFrame, name: str, bits: int, out: str) -> DataFrame:
    """Add the level of a numeric column between approximate quantiles (2**bits - 1 numbers)."""
    share = [i / (1 << bits) for i in range(1, 1 << bits)]
    edges = rows.agg(F.percentile_approx(name, share).alias("edges")).first()["edges"] or []
    level = F.lit(0)
    for edge in edges:
        level = level + F.when(F.col(name) > F.lit(edge), 1).otherwise(0)
    return rows.withColumn(out, level.cast("int"))


def _together(leveled: DataFrame, curve: str, key: str, group: list) -> DataFrame:
    """Rows of a group take the curve index of the one with the smallest key."""
    names = [unused(leveled, f"group_{c}") for c in group]
    moved = unused(leveled, "moved")
    first = F.min(F.struct(F.col(key).isNull(), F.col(key), F.col(curve).alias("at"))).alias(moved)
    several = leveled.groupBy(*group).agg(F.count(F.lit(1)).alias("rows"), first).filter("rows > 1")
    several = freeze(several.select(*[F.col(c).alias(n) for c, n in zip(group, names)], F.col(moved)["at"].alias(moved)))
    same = reduce(and_, [F.col(c) == F.col(n) for c, n in zip(group, names)])
    joined = leveled.join(small_side(several), same, "left")
    return joined.withColumn(curve, F.coalesce(moved, curve)).drop(moved, *names)


def hilbert_shards(
    rows: DataFrame, key: str, texts: list, numbers: list, ties: list, shards: int = SHARDS, bits: int = BITS, group: list | None = None
) -> DataFrame:
    """``rows`` with ``curve``, ``shard`` and ``slot`` (place in the shard, from 0).

    ``rows`` should be narrow and stored: it is read several times. Rows of equal ``group`` columns lie together, where the
    row with the smallest key lies; of a group only what passes the end of a shard stands in the next.
    """
    leveled, levels = rows, []
    for make, names in ((_text_level, texts), (_number_level, numbers)):
        for name in names:
            level = unused(leveled, f"level_{name}")
            leveled = make(leveled, name, bits, level)
            levels.append(level)
    curve, place = unused(leveled, "curve"), unused(leveled, "place")
    leveled = leveled.withColumn(curve, hilbert_index([F.col(c) for c in levels], bits)).drop(*levels)
    if group:
        leveled = _together(leveled, curve, key, group)
    placed = sorted_position(leveled, [curve, *ties, key], place)
    total = max(rows.count(), 1)
    at = F.col(place) - 1
    shard = F.expr(f"cast((`{place}` - 1) * {shards} div {total} as int)")
    first = F.expr(f"(cast(`{unused(placed, 'shard')}` as bigint) * {total} + {shards - 1}) div {shards}")
    return placed.withColumn(unused(placed, "shard"), shard).withColumn(unused(placed, "slot"), at - first).drop(place)


def document_shards(docs: DataFrame, shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """doc_id, source, lang, size, text_crc32, curve, shard, slot for all documents."""
    body = F.coalesce("text", F.lit(""))
    narrow = freeze(docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "source", "lang",
        (F.octet_length(body) + ROW_BYTES).cast("bigint").alias("size"),
        F.crc32(body.cast("binary")).cast("bigint").alias("text_crc32"), F.xxhash64(body).alias("text_hash"),
    ))
    same_text = ["text_crc32", "text_hash"]
    return hilbert_shards(narrow, "doc_id", ["source", "lang"], ["size"], same_text, shards, bits, same_text).drop("text_hash")


def write_shards(docs: DataFrame, placed: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Write ``docs`` as one folder per shard, rows in curve order; ``doc_id`` must be unique."""
    plan = placed.select(F.col("doc_id").alias("shard_doc"), "shard", "slot")
    joined = docs.join(plan, F.col("doc_id").cast("bigint").eqNullSafe(F.col("shard_doc"))).drop("shard_doc")
    joined.repartitionByRange(shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
