"""Mixing sources to target weights by entropy balancing.

Every token starts with rate 1. Among all rates that give each source its target number of tokens, the
ones of least relative entropy are exponential tilts, ``rate = exp(lambda[source])``, capped at
``MAX_RATE``; the lambdas solve a convex dual. Newton's method finds them: an iteration aggregates
gradient and curvature of the dual over the (source, size) classes of documents and takes one
step for every source. The rates are then rounded into copies of whole documents: all get the whole
part, and in a random but fixed order documents get one copy more until the fraction of the source is reached;
a small reserve of documents of all sizes then settles what is still open.

Only DataFrame functions are used. Defined results: a null text has size 0; a null source is a source
of its own, last in order; a source without tokens has target 0 and takes nothing; repeated rows
are documents of their own (they get the same treatment as far as their order allows); rows without
``doc_id`` take part like others; an empty table gives an empty table.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalogspark.llm.common import WORD, small_side, unused
from catalogspark.operators.ranking import sorted_position
from catalogspark.session import freeze

WEIGHTS = (1.0, 2.0, 3.0)
MAX_RATE = 3
ITERATIONS = 30
# The dual is solved once every source is this close to its target (share of it).
TOLERANCE = 1e-9
# Documents of a source and slice of the random order that one window task may sort, on average.
SLICE_ROWS = 50_000
# Rows of a table of sources that one partition holds (and that may be broadcast).
PARTITION_SOURCES = 250_000


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, cap: int = MAX_RATE) -> DataFrame:
    """source, source_size, target from rows of (source, source_size), one per source.

    Sources sorted by code point (null last) weigh ``weights`` in turn. With sources in order of
    ``cap * size / weight``, those before some place stop at their cap and the others share the
    rest by weight; the first place where the next source stays under its cap is the right one.
    """
    ranked = sorted_position(
        sizes.select(F.col("source").isNull().alias("is_null"), F.coalesce("source", F.lit("")).alias("name"),
                     "source_size"),
        ["is_null", "name"], "place",
    )
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    limited = ranked.withColumn("weight", weight).withColumn("most", F.lit(cap) * F.col("source_size"))
    # One row per source from here on: a window over all of them is small.
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("most") / F.col("weight"), "place")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0))) / F.sum("weight").over(after)
    staged = limited.withColumn("level", level)
    # The level that holds is the first one which the source at that place does not exceed.
    fits = F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct("place_", F.col("level")))
    staged = staged.withColumn("place_", F.row_number().over(order)).withColumn("first", F.min(fits).over(everything))
    target = F.when(
        F.col("first").isNull() | (F.col("place_") < F.col("first.place_")), F.col("most").cast("double")
    ).otherwise(F.col("first.level") * F.col("weight"))
    return staged.select(
        F.when(~F.col("is_null"), F.col("name")).alias("source"), "source_size",
        F.least(target, F.col("most").cast("double")).alias("target"),
    )


def tilts(classes: DataFrame, targets: DataFrame, cap: int = MAX_RATE) -> DataFrame:
    """source, rate: Newton iterations on the dual, from (source, size, n) classes of documents.

    Dual per source: sum of size * exp(lambda) minus lambda * target; its gradient is the token count
    of the rates minus the target, its curvature the token count.
    """
    state = freeze(
        targets.select("source", "target", "source_size").withColumn("lambda", F.lit(0.0)).withColumn("error", F.lit(1.0))
    )
    sources = state.count()
    parts = 1 + sources // PARTITION_SOURCES
    shared = F.broadcast if sources <= PARTITION_SOURCES else (lambda df: df)
    classes = classes.withColumnRenamed("source", "of")
    for _ in range(ITERATIONS):
        tokens = F.col("size") * F.col("n") * F.exp(F.col("lambda"))
        sums = (
            classes.join(shared(state), F.col("of").eqNullSafe(F.col("source")))
            .groupBy("source", "target", "source_size", "lambda")
            .agg(F.sum(tokens).alias("reached"), F.sum(tokens).alias("curvature"))
        )
        wanted = F.col("target") > 0
        step = F.when(wanted & (F.col("curvature") > 0), (F.col("target") - F.col("reached")) / F.col("curvature")).otherwise(F.lit(0.0))
        # A step of more than 1 in lambda (a factor e) would overshoot: the damped range of Newton's method.
        state = freeze(sums.select(
            "source", "target", "source_size",
            (F.col("lambda") + F.greatest(F.lit(-1.0), F.least(F.lit(1.0), step))).alias("lambda"),
            F.when(wanted, F.abs(F.col("reached") / F.col("target") - 1)).otherwise(F.lit(0.0)).alias("error"),
        ).coalesce(parts))
        worst = state.agg(F.max("error")).first()[0]
        if worst is None or worst <= TOLERANCE:
            break
    rate = F.when(F.col("target") > 0, F.least(F.exp("lambda"), F.lit(float(cap)))).otherwise(F.lit(0.0))
    return state.select("source", "source_size", "target", rate.alias("rate"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, cap: int = MAX_RATE, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies, taken for every row of ``docs``."""
    # Stored narrow: the whole texts are read once.
    sized = freeze(docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "source", size_of(F.col("text")).alias("size")
    ))
    classes = freeze(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    per_source = classes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    rated = tilts(classes, source_targets(per_source, weights, cap), cap)
    parts = 1 + rated.count() // PARTITION_SOURCES
    rated = small_side(rated).withColumnRenamed("source", "of")
    rows = classes.agg(F.sum("n")).first()[0] or 0
    slices = max(64, 1 << int(rows // slice_rows).bit_length())
    # A fixed random order of documents: by a hash of the id, cut into slices of a power of two.
    draw = F.xxhash64("doc_id", F.lit("mix"))
    placed = (
        sized.join(rated, F.col("source").eqNullSafe(F.col("of"))).drop("of")
        .withColumn("draw", draw).withColumn("slice", F.pmod("draw", F.lit(slices)))
    )
    whole = F.floor("rate")
    extra = placed.withColumn("copies", whole).withColumn(
        "short", F.col("target") - whole * F.col("source_size")
    )
    marked = _with_reserve(extra, parts)
    chosen = _prefix(marked.filter(~F.col("reserved"))).unionByName(
        marked.filter("reserved").withColumn("picked", F.lit(False))
    )
    filled = _fill(freeze(chosen), parts)
    copies = (F.col("copies") + F.col("picked").cast("bigint")).cast("bigint")
    return filled.select(
        "doc_id", "source", "size", "source_size", "target", "rate",
        F.when(F.col("size") > 0, F.least(copies, F.lit(cap))).otherwise(F.when(F.col("target") > 0, F.lit(1)).otherwise(F.lit(0))).cast("bigint").alias("copies"),
    ).withColumn("taken", F.col("copies") * F.col("size"))


def _prefix(rows: DataFrame) -> DataFrame:
    """Add ``picked``: the documents of a source, in random order, whose sizes add up to ``short`` at most.

    Slice sums tell which slice of a source holds the last document; only that slice is sorted.
    """
    sums = rows.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    earlier = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        F.col("source").alias("of"), F.col("slice").alias("at"), "slice_size",
        F.coalesce(F.sum("slice_size").over(earlier), F.lit(0)).alias("before"),
    )
    placed = rows.join(
        small_side(freeze(starts)), F.col("source").eqNullSafe(F.col("of")) & (F.col("slice") == F.col("at"))
    ).drop("of", "at")
    inside = F.col("before") + F.col("slice_size") <= F.col("short")
    border = ~inside & (F.col("before") < F.col("short"))
    keep = [*rows.columns]
    within = Window.partitionBy("source", "slice").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    last = (
        placed.filter(border).withColumn("upto", F.col("before") + F.sum("size").over(within))
        .select(*keep, (F.col("upto") <= F.col("short")).alias("picked"))
    )
    return placed.filter(~border).select(*keep, inside.alias("picked")).unionByName(last)


def _same_document() -> Column:
    return (F.col("doc_id") == F.col("had")) & F.col("source").eqNullSafe(F.col("from")) & (F.col("size") == F.col("of_size"))


def _with_reserve(rows: DataFrame, parts: int) -> DataFrame:
    """Add ``reserved``: one document of every size class (four per doubling) of each source.

    The reserve settles what whole slices leave open; it is small next to a large source.
    """
    usable = rows.filter((F.col("size") > 0) & F.col("doc_id").isNotNull())
    first = usable.groupBy("source", F.floor(4 * F.log2("size")).alias("class")).agg(
        F.min(F.struct("draw", "doc_id", "size")).alias("doc")
    )
    reserve = freeze(first.select(
        F.col("source").alias("from"), F.col("doc.doc_id").alias("had"), F.col("doc.size").alias("of_size")
    ).coalesce(parts))
    joined = rows.join(small_side(reserve), _same_document(), "left")
    return joined.withColumn("reserved", F.col("had").isNotNull()).drop("had", "from", "of_size")


def _fill(rows: DataFrame, parts: int) -> DataFrame:
    """Pick documents of the reserve: from the largest on, each that fits what its source still misses."""
    picked = F.sum(F.when(F.col("picked"), F.col("size")).otherwise(F.lit(0)))
    gaps = rows.groupBy("source").agg((F.max("short") - picked).alias("gap")).withColumnRenamed("source", "of")
    # Repeated rows of a document are picked together, so their sizes add up.
    held = rows.filter("reserved").groupBy("source", "doc_id", "size").agg(F.sum("size").alias("mass"))
    lists = held.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("mass", "doc_id", "size")), asc=False).alias("docs"))
    lists = lists.join(gaps, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    start = F.struct(F.col("gap").cast("double").alias("left"), F.slice("docs", 1, 0).alias("taken"))
    taken = F.aggregate(
        "docs", start,
        lambda state, doc: F.when(
            doc["mass"] <= state["left"],
            F.struct((state["left"] - doc["mass"]).alias("left"), F.concat(state["taken"], F.array(doc)).alias("taken")),
        ).otherwise(state),
        lambda state: state["taken"],
    )
    more = freeze(lists.select("source", F.explode(taken).alias("doc")).select(
        F.col("source").alias("from"), F.col("doc.doc_id").alias("had"), F.col("doc.size").alias("of_size")
    ).coalesce(parts))
    marked = rows.join(small_side(more), _same_document(), "left")
    return marked.withColumn("picked", F.col("picked") | F.col("had").isNotNull()).drop("had", "from", "of_size")


def apply_copies(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """``docs`` repeated as often as ``mixed`` says: the columns of ``docs``, one row per copy.

    A document's copies are found by id, source and size, so repeated rows of one document agree.
    """
    names = [unused(docs, n) for n in ("mix_doc", "mix_source", "mix_size", "mix_copies")]
    plan = mixed.groupBy("doc_id", "source", "size").agg(F.max("copies")).toDF(*names)
    size = unused(docs, "own_size")
    plan = freeze(plan.filter(F.col(names[3]) > 0))
    same = (
        F.col("doc_id").cast("bigint").eqNullSafe(F.col(names[0])) & F.col("source").eqNullSafe(F.col(names[1]))
        & (F.col(size) == F.col(names[2]))
    )
    joined = docs.withColumn(size, size_of(F.col("text"))).join(small_side(plan), same)
    copy = unused(joined, "copy")
    times = F.explode(F.sequence(F.lit(1), F.col(names[3]).cast("int")))
    return joined.withColumn(copy, times).select(*[F.col(f"`{c}`") for c in docs.columns])
