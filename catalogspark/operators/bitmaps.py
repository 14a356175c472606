"""Bitmap index of the facet columns: which ords have a repo, an extension or a text rendition.

A row is one facet value within one bucket of ords (as many as a bitmap has bits), so a frequent value is spread over many
rows and no row grows. Filters become unions (values of one facet) and intersections (facets, search hits) of
bitmaps of equal buckets, and counts are numbers of bits: facets of a filtered search read no records.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Bits of one bitmap, as Spark makes them.
BUCKET = 32768


def _bits(ord_: Column) -> Column:
    return F.bitmap_construct_agg(F.bitmap_bit_position(ord_ + 1))


def _bucket(ord_: Column) -> Column:
    # Spark counts values and buckets from 1.
    return F.bitmap_bucket_number(ord_ + 1)


def facet_bitmaps(catalog: DataFrame) -> DataFrame:
    """(facet, value, bucket, bits); facet ``all`` has every record, ``text`` those with a text rendition."""
    entry = [
        F.struct(F.lit("all").alias("facet"), F.lit("").alias("value")),
        F.struct(F.lit("repo").alias("facet"), F.col("repo").alias("value")),
        F.struct(F.lit("ext").alias("facet"), F.lower(F.coalesce("ext", F.lit(""))).alias("value")),
    ]
    text = F.struct(F.lit("text").alias("facet"), F.lit("").alias("value"))
    held = F.when(F.col("has_txt"), F.array(*entry, text)).otherwise(F.array(*entry))
    return (
        catalog.select("ord", F.inline(held)).groupBy("facet", "value", _bucket(F.col("ord")).alias("bucket"))
        .agg(_bits(F.col("ord")).alias("bits"))
    )


def ord_bitmaps(ords: DataFrame) -> DataFrame:
    """(bucket, bits) of a table of ords."""
    return ords.groupBy(_bucket(F.col("ord")).alias("bucket")).agg(_bits(F.col("ord")).alias("bits"))


def _values(bitmaps: DataFrame, facet: str, values: list) -> DataFrame:
    """(bucket, bits) of records with any of the values."""
    held = bitmaps.filter((F.col("facet") == facet) & F.col("value").isin(list(values)))
    return held.groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def matching_bitmaps(
    bitmaps: DataFrame, hits: DataFrame | None = None, repos=None, extensions=None, has_text: bool = False,
) -> DataFrame:
    """(bucket, bits) of the records that pass all given filters; ``hits`` are (bucket, bits) of a search."""
    sides = []
    if hits is not None:
        sides.append(hits.select("bucket", "bits"))
    if repos:
        sides.append(_values(bitmaps, "repo", repos))
    if extensions:
        sides.append(_values(bitmaps, "ext", extensions))
    if has_text:
        sides.append(_values(bitmaps, "text", [""]))
    if not sides:
        return _values(bitmaps, "all", [""])
    met = sides[0]
    for side in sides[1:]:
        met = met.unionAll(side)
    return _common(met, ["bucket"], len(sides))


def _common(rows: DataFrame, keys: list, sides: int) -> DataFrame:
    """Intersection of the bitmaps of each key; a bucket that one of the sides lacks is empty."""
    found = rows.groupBy(*keys).agg(F.bitmap_and_agg("bits").alias("bits"), F.count(F.lit(1)).alias("sides"))
    return found.filter(F.col("sides") == sides).filter(F.bitmap_count("bits") > 0).drop("sides")


def facet_counts(bitmaps: DataFrame, matched: DataFrame) -> DataFrame:
    """(facet, value, count) of the matched records, for all values that occur among them."""
    asked = bitmaps.filter(F.col("facet") != "all")
    buckets = asked.select("facet", "value", "bucket", "bits").join(
        matched.select("bucket", F.col("bits").alias("wanted")), "bucket"
    )
    both = buckets.select("facet", "value", "bucket", F.explode(F.array("bits", "wanted")).alias("bits"))
    return (
        _common(both, ["facet", "value", "bucket"], 2)
        .groupBy("facet", "value").agg(F.sum(F.bitmap_count("bits")).alias("count"))
    )


def matched_count(matched: DataFrame) -> DataFrame:
    return matched.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("count"))


def matched_ords(matched: DataFrame) -> DataFrame:
    """The ords of (bucket, bits) rows, in long form; other columns are kept."""
    kept = [c for c in matched.columns if c != "bits"]
    first = (F.col("bucket") - 1) * BUCKET
    byte = F.conv(F.hex(F.substring("bits", F.col("at") + 1, F.lit(1))), 16, 10).cast("int")
    bytes_ = matched.select(*kept, "bits", F.explode(F.sequence(F.lit(0), F.octet_length("bits") - 1)).alias("at"))
    held = bytes_.select(*kept, (first + F.col("at") * 8).alias("first"), byte.alias("byte")).filter("byte > 0")
    bit = held.select("*", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("bit"))
    found = bit.filter(F.expr("(byte & shiftleft(1, bit)) > 0"))
    return found.select(*kept, (F.col("first") + F.col("bit")).alias("ord"))


# --- rank and select ---------------------------------------------------------------


def _ranked(matched: DataFrame, keys: list) -> DataFrame:
    """Bitmaps with the number of ords in earlier buckets (``_before``), here (``_n``) and in all (``_total``).

    Only counts pass the window; a bitmap stays where it is until its bucket is known to be needed.
    """
    counts = matched.select(*keys, "bucket", F.bitmap_count("bits").alias("_n"))
    group = Window.partitionBy(*(keys or [F.lit(0)]))
    before = F.sum("_n").over(group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    return counts.withColumns({"_before": F.coalesce(before, F.lit(0)), "_total": F.sum("_n").over(group)})


def ords_between(matched: DataFrame, first: Column, last: Column, keys: list | None = None) -> DataFrame:
    """(keys, position, ord) of the ``first``-th to ``last``-th ord (from 1) of every group of bitmaps.

    Both bounds may use ``_total``. Bitmaps of other buckets are not expanded.
    """
    keys = keys or []
    ranked = _ranked(matched, keys).withColumns({"_first": first, "_last": last}).filter(
        (F.col("_before") < F.col("_last")) & (F.col("_before") + F.col("_n") >= F.col("_first"))
    )
    names = [*keys, "bucket"]
    held = matched.join(ranked, names).select(*names, "bits", "_before", "_first", "_last")
    within = Window.partitionBy(*names).orderBy("ord")
    placed = matched_ords(held).withColumn("position", F.col("_before") + F.row_number().over(within))
    return placed.filter(F.col("position").between(F.col("_first"), F.col("_last"))).select(
        *keys, F.col("position").cast("bigint").alias("position"), "ord"
    )


def _drawn(value: float) -> Column:
    """Position (from 1) of the record at index floor(value * n)."""
    index = F.least(F.col("_total") - 1, F.floor(F.lit(max(0.0, float(value))) * F.col("_total")))
    return index + 1


def random_ord(bitmaps: DataFrame, value: float, repo: str = "", txt_only: bool = False) -> DataFrame:
    """(ord) of the record at index floor(value * n) of the candidates, in catalog order."""
    matched = matching_bitmaps(bitmaps, repos=[repo] if repo else None, has_text=txt_only)
    return ords_between(matched, _drawn(value), _drawn(value)).select("ord")


def random_ord_per_repo(bitmaps: DataFrame, value: float) -> DataFrame:
    """(repo, ord): the same pick for every repo."""
    repos = bitmaps.filter("facet = 'repo'").select(F.col("value").alias("repo"), "bucket", "bits")
    return ords_between(repos, _drawn(value), _drawn(value), ["repo"]).select("repo", "ord")
