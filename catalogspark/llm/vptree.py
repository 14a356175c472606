"""Approximate nearest neighbours by cosine: one vantage-point tree per shard.

Vectors with equal values are one *class* (its ``k + 1`` smallest ids are enough for exact ties). Classes
go to the nearest of a few pivots, and every pivot's cell is cut into shards of bounded size. A task
builds the tree of a shard over unit vectors and walks it with all queries of a block at
once: the near side of a node first, the far side only if the triangle inequality allows a closer
neighbour there. That test is relaxed by ``factor``: a side is skipped once its distance bound exceeds ``factor``
times the distance of the neighbours found so far; factor 1 restores exact search. Cells are
skipped by the same test: queries search their nearest cells first and take the distance reached to the others.
Distances of unit vectors carry rounding noise, so every class within ``NOISE`` of the last place, however many
there are, gets its exact score in the task; the best ``k + 1`` by score, then id, leave it.

Queries and classes meet by shard number and block of queries; neither side is ever held whole.
The pivots are fitted on a sample of ``PIVOT_SAMPLE`` rows, every row is indexed.

Defined results: vectors that are null, all zero, of another length than the first valid one
in id order, or that hold null or non-finite components take no part as query or candidate; so do rows
without ``vec_id``; of rows with equal ``vec_id`` and vector one counts, and a query is never
its own neighbour; equal scores are ordered by ``vec_id``; with fewer candidates than ``k`` all are
returned; an empty table gives an empty table.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalogspark.llm import common
from catalogspark.session import freeze

NEIGHBOURS = 5
FACTOR = 0.5
PIVOTS = 32
PIVOT_SAMPLE = 20_000
SHARD_ROWS = 8192
QUERY_BLOCK = 65_536
FIRST_CELLS = 3
LEAF = 256
# Above the rounding noise of distances, which is largest near 0 (root of a rounding error of 1e-13 at most).
NOISE = 1e-6
# Pairs that are scored exactly at once.
SCORED = 1 << 16


def valid_vectors(rows: DataFrame) -> DataFrame:
    """vec_id, embedding of the rows that take part, each pair once."""
    kept = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = kept.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    kept = kept.filter(F.coalesce(finite, F.lit(False)) & F.exists("embedding", lambda x: x != 0))
    first = kept.agg(F.min_by(F.size("embedding"), "vec_id")).first()[0]
    return kept.filter(F.size("embedding") == F.lit(first or 0)).distinct()


def _raw(column) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of rows, summed in order."""
    return np.cumsum(a * b, axis=1)[:, -1]


def cosines(a: np.ndarray, at_a: np.ndarray, b: np.ndarray, at_b: np.ndarray) -> np.ndarray:
    """Cosines of pairs of rows in double precision, summed in order."""
    sizes_a, sizes_b = np.sqrt(_dots(a, a)), np.sqrt(_dots(b, b))
    parts = [slice(i, i + SCORED) for i in range(0, len(at_a), SCORED)]
    return np.concatenate([np.zeros(0), *[
        _dots(a[at_a[i]], b[at_b[i]]) / (sizes_a[at_a[i]] * sizes_b[at_b[i]]) for i in parts
    ]])


def _units(column) -> np.ndarray:
    raw = _raw(column)
    return raw / np.sqrt((raw * raw).sum(axis=1, keepdims=True))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


class Tree:
    """Vantage-point tree over unit vectors; a node is (vantage point, radius, inner, outer) or an index array."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points, self.leaf = points, leaf
        self.rng = np.random.default_rng(len(points))
        self.root = self._build(np.arange(len(points)))

    def _build(self, at: np.ndarray):
        if len(at) <= self.leaf:
            return at
        tried = self.points[self.rng.choice(at, min(8, len(at)), replace=False)]
        seen = self.points[self.rng.choice(at, min(256, len(at)), replace=False)]
        point = tried[np.argmax(_distances(tried, seen).var(axis=1))]
        d = _distances(point[None], self.points[at])[0]
        radius = np.median(d)
        inner = d <= radius
        if inner.all():
            inner = d < radius
        if not inner.any() or inner.all():
            return at
        return point, radius, self._build(at[inner]), self._build(at[~inner])

    def candidates(self, queries: np.ndarray, reach: np.ndarray, k: int, factor: float):
        """Pairs (query, point) within noise of the ``k``-th distance found, or of ``reach`` if that is less."""
        held = []
        best, _ = self.search(queries, reach, k, k, factor, held)
        limit = np.minimum(reach, best[:, k - 1])
        q, point, d = (np.concatenate(c) for c in zip(*held)) if held else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        near = d <= limit[q] + NOISE
        return q[near], point[near]

    def search(self, queries: np.ndarray, reach: np.ndarray, k: int, pruned_by: int, factor: float, held: list | None = None):
        """Distances and numbers of the ``k`` best points of every query; ``reach`` bounds the search.

        ``held`` collects (queries, points, distances) of all that may be within noise of the limit.
        """
        best = np.full((len(queries), k), np.inf)
        index = np.full((len(queries), k), -1)
        limit = reach.copy()

        def visit(node, q):
            if not len(q):
                return
            if isinstance(node, np.ndarray):
                here = _distances(queries[q], self.points[node])
                d = np.concatenate([best[q], here], axis=1)
                i = np.concatenate([index[q], np.broadcast_to(node, (len(q), len(node)))], axis=1)
                few = np.argpartition(d, k - 1, axis=1)[:, :k]
                order = np.take_along_axis(few, np.argsort(np.take_along_axis(d, few, 1), axis=1), 1)
                best[q], index[q] = np.take_along_axis(d, order, 1), np.take_along_axis(i, order, 1)
                limit[q] = np.minimum(reach[q], best[q, pruned_by - 1])
                if held is not None:
                    r, c = np.nonzero(here <= limit[q][:, None] + NOISE)
                    held.append((q[r], node[c], here[r, c]))
                return
            point, radius, inner, outer = node
            d = _distances(queries[q], point[None])[:, 0]
            near = d <= radius
            visit(inner, q[near])
            visit(outer, q[~near])
            far = np.abs(d - radius) <= factor * limit[q] + NOISE
            visit(outer, q[near & far])
            visit(inner, q[~near & far])

        visit(self.root, np.arange(len(queries)))
        return best, index


def _pivots(classes: DataFrame, rows: int, pivots: int) -> np.ndarray:
    """Pivots by farthest-first choice over a sample of PIVOT_SAMPLE rows at most."""
    sample = classes.orderBy(F.xxhash64("embedding")).limit(PIVOT_SAMPLE).select("embedding").toPandas()
    points = _units(sample["embedding"])
    chosen = [0]
    d = _distances(points[:1], points)[0]
    for _ in range(min(pivots, len(points), max(1, rows // SHARD_ROWS * 4)) - 1):
        chosen.append(int(np.argmax(d)))
        d = np.minimum(d, _distances(points[chosen[-1:]], points)[0])
    return points[chosen]


def nearest(
    rows: DataFrame, queries: Column, k: int = NEIGHBOURS, factor: float = FACTOR, pivots: int = PIVOTS,
    first_cells: int = FIRST_CELLS,
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest rows found for every row where ``queries`` holds."""
    spark = rows.sparkSession
    out = "query_id bigint, rank int, vec_id bigint, score double"
    vectors = freeze(valid_vectors(rows))
    if vectors.isEmpty():
        return spark.createDataFrame([], out)
    # Only k + 1 ids of a class pass the shuffle from each task.
    held = Window.partitionBy("embedding").orderBy("vec_id")
    classes = freeze(
        vectors.withColumn("place", F.row_number().over(held)).filter(F.col("place") <= k + 1)
        .groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    )
    total = classes.count()
    points = _pivots(classes, total, pivots)
    shared = spark.sparkContext.broadcast(points)

    def to_cells(frames):
        for frame in frames:
            d = _distances(_units(frame["embedding"]), shared.value) if len(frame) else np.zeros((0, 1))
            yield frame.assign(cell=d.argmin(axis=1).astype("int32"), distance=d.min(axis=1, initial=np.inf))

    placed = freeze(classes.mapInPandas(to_cells, "embedding array<float>, ids array<bigint>, cell int, distance double"))
    # Cells of one number each: the shards that hold it, and its radius (one row per pivot).
    cells = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("radius")).collect()
    radius, parts = np.full(len(points), -np.inf), np.zeros(len(points), int)
    for cell, n, reach in cells:
        radius[cell], parts[cell] = reach, -(-n // SHARD_ROWS)
    starts = np.cumsum(parts) - parts
    many, first = F.array(*[F.lit(int(max(x, 1))) for x in parts]), F.array(*[F.lit(int(x)) for x in starts])
    shard = F.get(first, F.col("cell")) + F.pmod(F.xxhash64("embedding"), F.get(many, F.col("cell")))
    asked = freeze(vectors.filter(queries).select(F.col("vec_id").alias("query_id"), "embedding"))
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")
    # Every block of queries meets a shard in a task of its own.
    stored = placed.select(shard.cast("int").alias("shard"), "embedding", "ids", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))

    def route(nearest_ones: bool):
        def to_shards(frames):
            for frame in frames:
                if not len(frame):
                    continue
                d = _distances(_units(frame["embedding"]), shared.value)
                bound = np.where(parts > 0, d - radius, np.inf)
                near = np.zeros(d.shape, bool)
                near[np.arange(len(d))[:, None], np.argsort(bound, axis=1)[:, :first_cells]] = True
                near &= parts > 0
                wanted = near if nearest_ones else ~near & (bound <= factor * frame["reach"].to_numpy()[:, None] + NOISE)
                row, cell = np.nonzero(wanted)
                n = parts[cell]
                again = np.repeat(np.arange(len(row)), n)
                shards = np.repeat(starts[cell], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                yield frame.iloc[row[again]].assign(shard=shards.astype("int32"))

        return to_shards

    def look(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame(columns=["query_id", "score", "ids"], dtype=object)
        right = right.assign(low=right["ids"].str[0]).sort_values("low", ignore_index=True)
        tree = Tree(_units(right["embedding"]))
        row, at = tree.candidates(_units(left["embedding"]), left["reach"].to_numpy(), k + 1, factor)
        score = cosines(_raw(left["embedding"]), row, _raw(right["embedding"]), at)
        # Classes are numbered by their smallest id; k + 1 of them hold k ids besides the query.
        order = np.lexsort((at, -score, row))
        row, at, score = row[order], at[order], score[order]
        kept = np.arange(len(row)) - np.searchsorted(row, row) <= k
        row, at, score = row[kept], at[kept], score[kept]
        return pd.DataFrame({
            "query_id": left["query_id"].to_numpy()[row], "score": score, "ids": right["ids"].to_numpy()[at],
        })

    def searched(sent: DataFrame) -> DataFrame:
        return freeze(
            sent.withColumn("block", block).groupBy("shard", "block").cogroup(stored.groupBy("shard", "block"))
            .applyInPandas(look, "query_id bigint, score double, ids array<bigint>")
        )

    sent = "query_id bigint, embedding array<float>, reach double, shard int"
    near = searched(asked.withColumn("reach", F.lit(float("inf"))).mapInPandas(route(True), sent))
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("ids")[0])
    distance = F.sqrt(F.greatest(2 - 2 * F.col("score"), F.lit(0.0)))
    reached = (
        near.withColumn("place", F.row_number().over(by_score)).filter(F.col("place") == k + 1)
        .select(F.col("query_id").alias("of"), distance.alias("reach"))
    )
    again = asked.join(reached, F.col("query_id") == F.col("of"), "left").drop("of").withColumn(
        "reach", F.coalesce("reach", F.lit(float("inf")))
    )
    far = searched(again.mapInPandas(route(False), sent))
    left = near.unionByName(far).withColumn("place", F.row_number().over(by_score)).filter(F.col("place") <= k + 1)
    scored = left.select("query_id", "score", F.explode("ids").alias("vec_id")).filter(F.col("vec_id") != F.col("query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
