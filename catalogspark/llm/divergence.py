"""Source divergence audit: how each source of a language differs from the others and from the language, term by term.

Every (lang, source) group gives each kept term of its language a smoothed share of a thousand million,
``p = 1 + SCALE * (count + 1) div (N + V)``, and the divergence of a term is ``(p - q)^2 div q``. Both depend on a
term only through its counts, so terms are collapsed into *cells* of equal counts and the arithmetic is done once per
cell:

- part ``term``: cells (group count, language count) are evaluated, cells of equal value are merged, and
  ranked by the running number of their terms; only cells that reach the wanted ranks are expanded to terms, in
  UTF-8 order. The ranking keeps ``top`` rows of a group before and after its shuffle.
- part ``pair``: terms of equal counts in all sources are one cell. Cells give the terms that two sources both hold;
  everything else follows from counts of one source, as ``f(a, b) = [f(a, b) - f(a, 0) - f(0, b) + f(0, 0)]
  + [f(a, 0) - f(0, 0)] + [f(0, b) - f(0, 0)] + f(0, 0)``. So terms that a source does not hold are never rows.

All sums are over whole numbers, so results do not depend on the partitioning. Work of part ``pair`` grows with
the pairs of sources within a language, as its result does; no task holds all terms of a group.

Defined results: null text, lang and source are empty; every row is a document of its own, also repeated ones and those
without ``doc_id``; a group without terms still has its pairs; a language without kept terms has pairs of value 0;
an empty table gives an empty table. Only ``text``, ``lang`` and ``source`` are read, whatever else there is.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalogspark.llm.common import lower_ascii, small_side
from catalogspark.session import freeze
from catalogspark.sources.tables import scratch

# What stands between terms. Splitting there costs a ninth of matching the terms one by one.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
MIN_DOCS = 3
TOP = 200
SCALE = 1_000_000_000
# Counts from here on are scaled as decimals: their product would not fit 64 bits.
LONG_COUNT = (1 << 63) // SCALE - 1


def _filled(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), n_docs; rows are combined before they are shuffled."""
    words = F.split(lower_ascii(F.col("text")), BETWEEN)
    split = _filled(docs).select("lang", "source", words.alias("words"))
    # A text's words once as they are, and once without repetition.
    twice = split.select("lang", "source", F.posexplode(F.array("words", F.array_distinct("words"))).alias("once", "words"))
    # A text that begins or ends between terms has an empty piece there.
    each = twice.select("lang", "source", "once", F.explode("words").alias("term")).filter("term <> ''")
    return each.groupBy("lang", "source", "term").agg(
        F.sum(F.lit(1) - F.col("once")).alias("n"), F.sum("once").alias("n_docs")
    )


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, term, n_lang, counts (source, n, by source) of terms in at least ``min_docs`` documents of the language."""
    spark = docs.sparkSession
    kept = (
        term_counts(docs).groupBy("lang", "term")
        .agg(F.sum("n").alias("n_lang"), F.sum("n_docs").alias("n_docs"),
             F.sort_array(F.collect_list(F.struct("source", "n"))).alias("counts"))
        .filter(F.col("n_docs") >= min_docs).drop("n_docs")
    )
    path = scratch(spark, "terms")
    kept.write.parquet(path)
    return spark.read.schema(kept.schema).parquet(path)


def _share(n: str, total: str, v: str) -> str:
    """SQL: smoothed share of a count; exact for counts of any size."""
    exact = f"CAST({SCALE} AS DECIMAL(10, 0)) * CAST({n} + 1 AS DECIMAL(20, 0))"
    return (
        f"1 + CASE WHEN {n} < {LONG_COUNT} THEN ({SCALE} * ({n} + 1)) div ({total} + {v})"
        f" ELSE ({exact}) div CAST({total} + {v} AS DECIMAL(20, 0)) END"
    )


def _far(p: str, q: str) -> str:
    """SQL: divergence of a share from another."""
    return f"((({p} - {q}) * ({p} - {q})) div {q})"


def _sum(column: Column) -> Column:
    return F.sum(column.cast("decimal(38,0)")).cast("bigint")


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank."""
    kept = kept_terms(docs, min_docs)
    single = kept.select("lang", "term", "n_lang", F.inline("counts"))
    cells = freeze(single.groupBy("lang", "source", "n", "n_lang").agg(F.count(F.lit(1)).alias("m")))
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("n_lang").alias("all_lang"))
    totals = cells.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("m")).alias("total"))
    groups = freeze(
        _filled(docs).select("lang", "source").distinct().join(langs, "lang", "left").join(totals, ["lang", "source"], "left")
        .na.fill(0, ["v", "all_lang", "total"])
    )
    return _terms(single, cells, groups, top).unionByName(_pairs(kept, cells, groups))


def _terms(single: DataFrame, cells: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    """The terms that a group holds more of than its language, first ``top`` ranks."""
    valued = cells.join(small_side(groups), ["lang", "source"]).withColumns({
        "p": F.expr(_share("n", "total", "v")), "q": F.expr(_share("n_lang", "all_lang", "v")),
    }).filter("p > q").withColumn("value", F.expr(_far("p", "q"))).select("lang", "source", "n", "n_lang", "m", "value")
    merged = valued.groupBy("lang", "source", "value").agg(F.sum("m").alias("m"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    # Every value has a term at least, so the first ``top`` values hold the first ``top`` ranks.
    first = merged.withColumn("place", F.row_number().over(by_value)).filter(F.col("place") <= top)
    before = F.coalesce(F.sum("m").over(by_value.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    reached = first.withColumn("before", before).filter(F.col("before") < top).select("lang", "source", "value")
    chosen = freeze(valued.join(small_side(freeze(reached)), ["lang", "source", "value"]).drop("m"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term")
    expanded = single.join(small_side(chosen), ["lang", "source", "n", "n_lang"])
    return expanded.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank"
    )


def _pairs(kept: DataFrame, cells: DataFrame, groups: DataFrame) -> DataFrame:
    """The distance of every source to every other of its language, over all kept terms."""
    groups = small_side(groups.select("lang", "source", "total", "v"))
    other = groups.select(F.col("lang").alias("in"), F.col("source").alias("other"), F.col("total").alias("other_total"))
    rows = ["lang", "source", "other"]

    def against(left: DataFrame) -> DataFrame:
        return left.join(other, (F.col("lang") == F.col("in")) & (F.col("source") != F.col("other"))).drop("in")

    zero = {"p0": F.expr(_share("0", "total", "v")), "q0": F.expr(_share("0", "other_total", "v"))}
    rest = against(groups).withColumns({
        name: F.when(F.col("v") > 0, share) for name, share in zero.items()
    }).select(*rows, F.coalesce(F.expr(f"v * {_far('p0', 'q0')}"), F.lit(0)).alias("value"))
    # Counts of one source while the other has none, both ways.
    alone = cells.groupBy("lang", "source", "n").agg(F.sum("m").alias("m")).join(groups, ["lang", "source"])
    one = against(alone).withColumns({"p": F.expr(_share("n", "total", "v")), **zero})
    one = one.selectExpr(
        f"stack(2, lang, source, other, m * ({_far('p', 'q0')} - {_far('p0', 'q0')}),"
        f" lang, other, source, m * ({_far('q0', 'p')} - {_far('q0', 'p0')}))"
    )
    # Counts that both have: terms of equal counts in all sources are paired once.
    alike = kept.filter(F.size("counts") > 1).groupBy("lang", "counts").agg(F.count(F.lit(1)).alias("m"))
    held = alike.select("lang", "m", "counts", F.posexplode("counts").alias("i", "a")).select(
        "lang", "m", "a", F.explode(F.expr("slice(counts, i + 2, size(counts))")).alias("b")
    )
    both = held.groupBy(
        "lang", F.col("a.source").alias("source"), F.col("b.source").alias("other"), F.col("a.n").alias("n"), F.col("b.n").alias("other_n")
    ).agg(F.sum("m").alias("m"))
    both = both.join(groups, ["lang", "source"]).join(
        other.withColumnRenamed("other", "of"), (F.col("lang") == F.col("in")) & (F.col("other") == F.col("of"))
    ).withColumns({
        "p": F.expr(_share("n", "total", "v")), "q": F.expr(_share("other_n", "other_total", "v")), **zero,
    })

    def crossed(p, q, p0, q0):
        return f"m * ({_far(p, q)} - {_far(p, q0)} - {_far(p0, q)} + {_far(p0, q0)})"

    both = both.selectExpr(
        f"stack(2, lang, source, other, {crossed('p', 'q', 'p0', 'q0')}, lang, other, source, {crossed('q', 'p', 'q0', 'p0')})"
    )
    parts = [x.toDF(*rows, "value") for x in (rest, one, both)]
    summed = parts[0].unionAll(parts[1]).unionAll(parts[2]).groupBy(*rows).agg(_sum(F.col("value")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "other")
    return summed.select(
        "lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value", F.row_number().over(order).alias("rank")
    )
