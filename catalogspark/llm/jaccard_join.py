"""Grouped prefix join: near-duplicate documents by Jaccard similarity of word n-grams.

1. Documents with the same shingle set are one *node* (rows with equal texts, for example).
2. Shingles are counted, and ordered by frequency class, then by hash. Of every node the prefix of that order which
   any similar partner must share is taken; nodes of the same prefix and size are one *group*, which is posted once.
3. Tokens with the same list are taken together. Pairs of groups within a list pass the size, position and prefix-count filters; only then are they
   expanded to pairs of nodes (and each group to the pairs of its own nodes), which are verified on the whole sets. Sets
   reach the tasks block by block, not pair by pair.
4. Long lists of a token, and groups of many nodes, are not paired out: their nodes are first compared with a few common
   partners; nodes that are still in different components are then compared block by block.
5. Verified links give components over nodes, which are expanded to documents.

All counts cover all documents. The frequency table that reaches the tasks holds the most frequent
shingles, ``MAX_FREQUENT`` of them at most; it only orders shingles, so results do not depend on it.

Defined results: a null text or one without words has no shingles and links with nothing; fewer words
than ``n`` are one shingle; rows without ``doc_id`` link with nothing and have a null component; rows
that share a ``doc_id`` are compared text by text and have one component id per text; equal sets link
whatever the order of rows. An empty table gives an empty table.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalogspark.llm import common
from catalogspark.llm.components import components
from catalogspark.session import freeze

WORDS = 5
# Similarity as a ratio of whole numbers: 75 / 100.
NUM, DEN = 75, 100

# Shingles (all, of which about a quarter are posted) of one bucket, which one task handles; buckets grow with the corpus.
BUCKET_TOKENS = 1 << 19
# Bytes of text to a shingle, about.
SHINGLE_BYTES = 6
FLUSH_TOKENS = 1 << 20
# Shingles of at least this many documents are ordered last, if they are among the most frequent.
FREQUENT = 8
MAX_FREQUENT = 2_000_000
# Lists above this length are linked to common partners before they are paired.
LONG_LIST = 32
HUBS = 3
# Bytes of the sets that a task holds while it verifies pairs.
VERIFY_BYTES = 1 << 23
# Bytes of the sets that make one block of a cluster, and tokens that are compared at once.
BLOCK_BYTES = 1 << 20
PART_TOKENS = 1 << 22
# Tokens are shortened to 32 bits within a bucket; two of a document may fall together.
SLACK = 2


def shingle_sets(text, n: int = WORDS):
    """For each text of a filled Arrow column: the sorted distinct shingle hashes."""
    for _, _, data, offsets in common.pieces(text):
        data = common.lowered(data)
        starts, ends, bounds = common.word_spans(data, offsets)
        words = common.span_hashes(data, starts, ends)
        runs = common.chained(words, n)
        for first, last in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if last - first >= n:
                yield np.unique(runs[first:last - n + 1])
            elif last > first:
                yield common.chained(words[first:last], last - first)
            else:
                yield np.zeros(0, np.uint64)


def node_of(hashes: np.ndarray) -> int:
    """A 64-bit name of a shingle set."""
    total = np.add.reduce(hashes) + np.uint64(len(hashes))
    mixed = common.mixed(np.array([total ^ common.mixed(np.array([np.bitwise_xor.reduce(hashes)]))[0]]))
    return int(mixed.view(np.int64)[0])


def _least_common(size: int) -> int:
    """Shingles that a set of ``size`` has at least in common with any similar set."""
    return -(-NUM * size // DEN)


def prefix_length(size: int) -> int:
    return size - _least_common(size) + 1


def prefix_of(hashes: np.ndarray, shift, known: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The shortened shingles of a set's prefix, in the common order."""
    tokens = hashes >> shift
    if len(known):
        at = np.searchsorted(known, tokens)
        at[at == len(known)] = 0
        level = np.where(known[at] == tokens, levels[at], 0).astype(np.uint64)
        tokens = np.sort(tokens | (level << np.uint64(56))) % np.uint64(1 << 56)
    # A copy: a view would keep all tokens of the set alive.
    return tokens[:prefix_length(len(hashes))].copy()


def group_of(prefix: np.ndarray, size: int) -> int:
    """A 64-bit name of a prefix together with the size of its set."""
    name = np.array([node_of(prefix)], np.int64).view(np.uint64) + np.uint64(size)
    return int(common.mixed(name).view(np.int64)[0])


def _set_rows(docs: DataFrame, bits: int, frequent, n: int) -> DataFrame:
    """doc_id, n_shingles, node, grp of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)
    shift = np.uint64(32 - bits)
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "n_shingles", "node", "grp")])

    def rows(stream):
        for batch in stream:
            sizes, nodes, groups = [], [], []
            for hashes in shingle_sets(common.filled(batch.column(1)), n):
                sizes.append(len(hashes))
                nodes.append(node_of(hashes) if len(hashes) else None)
                groups.append(group_of(prefix_of(hashes, shift, *shared.value), len(hashes)) if len(hashes) else None)
            yield common.batch_of(schema, [batch.column(0), sizes, nodes, groups])

    return _texts(docs).mapInArrow(common.tidy(rows), "doc_id bigint, n_shingles bigint, node bigint, grp bigint")


def _texts(docs: DataFrame) -> DataFrame:
    return common.small_batches(docs).select(F.col("doc_id").cast("bigint"), "text")


def _cut(tokens: np.ndarray, buckets: int):
    """(bucket, first, last) slices of sorted tokens."""
    edges = np.searchsorted(tokens >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))
    return [(b, edges[b], edges[b + 1]) for b in range(buckets) if edges[b] < edges[b + 1]]


def frequent_tokens(docs: DataFrame, bits: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shortened shingles with their frequency classes (log2), sorted by token."""
    buckets = 1 << bits
    out = pa.schema([("bucket", pa.int32()), ("tokens", pa.binary()), ("counts", pa.binary())])
    shift = np.uint64(32 - bits)

    def count(stream):
        held, seen, total = [], set(), 0

        def rows():
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            low, counts = tokens.astype("<u4"), counts.astype("<u4")
            cuts = _cut(tokens, buckets)
            return common.batch_of(out, [
                [b for b, _, _ in cuts], [low[i:j].tobytes() for _, i, j in cuts], [counts[i:j].tobytes() for _, i, j in cuts],
            ])

        for batch in stream:
            for hashes in shingle_sets(common.filled(batch.column(1)), n):
                node = node_of(hashes) if len(hashes) else None
                if node is None or node in seen:
                    continue
                seen.add(node)
                held.append(hashes >> shift)
                total += len(hashes)
                if total >= FLUSH_TOKENS:
                    yield rows()
                    held, seen, total = [], set(), 0
        if held:
            yield rows()

    classes = pa.schema([("bucket", pa.int32()), ("class", pa.int32()), ("n", pa.int64()), ("tokens", pa.binary())])

    def frequent(table: pa.Table) -> pa.Table:
        tokens = np.frombuffer(b"".join(table["tokens"].to_pylist()), "<u4")
        counts = np.frombuffer(b"".join(table["counts"].to_pylist()), "<u4").astype(np.int64)
        order = np.argsort(tokens, kind="stable")
        tokens, counts = tokens[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        totals = np.add.reduceat(counts, first)
        high = totals >= FREQUENT
        tokens, level = tokens[first][high], np.log2(totals[high]).astype(int)
        bucket = table["bucket"][0].as_py()
        rows = [(bucket, c, int((level == c).sum()), tokens[level == c].tobytes()) for c in np.unique(level).tolist()]
        return pa.Table.from_batches([common.batch_of(classes, list(zip(*rows)) or [[], [], [], []])])

    counted = freeze(
        _texts(docs).mapInArrow(common.tidy(count), "bucket int, tokens binary, counts binary")
        .groupBy("bucket").applyInArrow(frequent, "bucket int, class int, n bigint, tokens binary")
    )
    sizes = {r["class"]: r["total"] for r in counted.groupBy("class").agg(F.sum("n").alias("total")).collect()}
    held, lowest = 0, 64
    for level in sorted(sizes, reverse=True):
        if held + sizes[level] > MAX_FREQUENT:
            break
        held, lowest = held + sizes[level], level
    tokens, levels = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint8)]
    for row in counted.filter(F.col("class") >= lowest).collect():
        low = np.frombuffer(row["tokens"], "<u4").astype(np.uint64)
        tokens.append(low | np.uint64(row["bucket"] << 32))
        levels.append(np.full(len(low), row["class"], np.uint8))
    tokens, levels = np.concatenate(tokens), np.concatenate(levels)
    order = np.argsort(tokens)
    return tokens[order], levels[order]


def postings(docs: DataFrame, bits: int, frequent, n: int) -> DataFrame:
    """Per task and bucket, the prefix tokens of its groups as packed columns."""
    buckets = 1 << bits
    shared = docs.sparkSession.sparkContext.broadcast(frequent)
    shift = np.uint64(32 - bits)
    out = pa.schema([("bucket", pa.int32()), *[(c, pa.binary()) for c in ("tokens", "groups", "sizes", "places")]])

    def post(stream):
        held, seen, total = [], set(), 0

        def rows():
            tokens = np.concatenate([t for t, _, _ in held])
            lengths = [len(t) for t, _, _ in held]
            groups = np.repeat(np.array([x for _, x, _ in held], "<i8"), lengths)
            sizes = np.repeat(np.array([x for _, _, x in held], "<u4"), lengths)
            places = np.concatenate([np.arange(x) for x in lengths]).clip(max=65535).astype("<u2")
            order = np.argsort((tokens >> np.uint64(32)).astype(np.uint32), kind="stable")
            cuts = _cut(tokens[order], buckets)
            low = tokens.astype("<u4")
            return common.batch_of(out, [
                [b for b, _, _ in cuts],
                *[[column[order[i:j]].tobytes() for _, i, j in cuts] for column in (low, groups, sizes, places)],
            ])

        for batch in stream:
            for hashes in shingle_sets(common.filled(batch.column(1)), n):
                if not len(hashes):
                    continue
                prefix = prefix_of(hashes, shift, *shared.value)
                group = group_of(prefix, len(hashes))
                if group in seen:
                    continue
                seen.add(group)
                held.append((prefix, group, len(hashes)))
                total += len(prefix)
                if total >= FLUSH_TOKENS // 2:
                    yield rows()
                    held, seen, total = [], set(), 0
        if held:
            yield rows()

    return _texts(docs).mapInArrow(common.tidy(post), "bucket int, tokens binary, groups binary, sizes binary, places binary")


def _token_lists(table: pa.Table, long_list: int) -> pa.Table:
    """Rows of a bucket: the groups of a token, smallest sets first (kind 0), and the entries of long lists one by one (kind 1).

    A row is a token's list, not a pair of groups, so the number of rows follows the tokens, whatever the sizes of groups and the
    number of buckets. Lists are cut where neighbours differ too much in size to be similar; entries that stand alone are left out.
    """
    listed = pa.list_(pa.int64())
    schema = pa.schema([("kind", pa.int32()), ("token", pa.int64()), ("groups", listed), ("sizes", listed), ("places", listed)])

    def column(name, kind):
        return np.frombuffer(b"".join(table[name].to_pylist()), kind)

    tokens, nodes = column("tokens", "<u4"), column("groups", "<i8")
    sizes, places = column("sizes", "<u4").astype(np.int64), column("places", "<u2").astype(np.int64)
    order = np.argsort(tokens, kind="stable")
    twin = np.zeros(len(tokens), bool)
    same = tokens[order][1:] == tokens[order][:-1]
    twin[order[1:][same]] = True
    twin[order[:-1][same]] = True
    at = np.flatnonzero(twin)
    at = at[np.lexsort((nodes[at], sizes[at], tokens[at]))]
    tokens, nodes, sizes, places = tokens[at], nodes[at], sizes[at], places[at]
    # The same group posted by several tasks counts once.
    new = np.ones(len(tokens), bool)
    new[1:] = (tokens[1:] != tokens[:-1]) | (nodes[1:] != nodes[:-1])
    tokens, nodes, sizes, places = tokens[new], nodes[new], sizes[new], places[new]
    first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])) if len(tokens) else np.zeros(0, int)
    lengths = np.diff(np.append(first, len(tokens)))
    long = np.repeat(lengths, lengths) > long_list
    # Whether an entry and the next one of its list may be similar by size.
    near = np.zeros(len(tokens) + 1, bool)
    near[1:-1] = (tokens[1:] == tokens[:-1]) & ~long[1:] & (DEN * sizes[:-1] >= NUM * sizes[1:])
    held = np.flatnonzero(long | near[1:] | near[:-1])
    begins = np.append(np.flatnonzero(~near[:-1][held]), len(held))
    lists = [pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(x[held], pa.int64())) for x in (nodes, sizes, places)]
    heads = held[begins[:-1]]
    named = tokens[heads].astype(np.int64) | (table["bucket"][0].as_py() << 32)
    return pa.table([pa.array(long[heads].astype(np.int32)), pa.array(named), *lists], schema=schema)


def _tidy_lists(table: pa.Table, long_list: int) -> pa.Table:
    found = _token_lists(table, long_list)
    common.release()
    return found


def _least_shared(size_a: str, size_b: str):
    """Common shingles of two similar sets, at least (names of columns)."""
    return F.expr(f"({NUM} * ({size_a} + {size_b}) + {NUM + DEN - 1}) div {NUM + DEN}")


def _may_be_first(size_a: str, size_b: str, place_a: str, place_b: str):
    """Position filter: whether a common token at these places may be the first of a similar pair.

    The tokens after it must still suffice. It says nothing of later common tokens, so those of a pair
    are counted whatever their places.
    """
    after = F.least(F.col(size_a) - F.col(place_a), F.col(size_b) - F.col(place_b))
    return after + SLACK >= _least_shared(size_a, size_b)


def _list_pairs(lists: DataFrame) -> DataFrame:
    """a, b, size_a, size_b, n (common tokens), early of the pairs of groups within the lists.

    Tokens with the same list are taken together first: all its groups have their lowest place at the same token.
    """
    alike = lists.groupBy("groups").agg(F.count(F.lit(1)).alias("n"), F.min("places").alias("places"), F.first("sizes").alias("sizes"))
    entry = F.arrays_zip(F.col("groups").alias("grp"), F.col("sizes").alias("size"), F.col("places").alias("place"))
    one = alike.select("n", entry.alias("entries")).select("n", "entries", F.posexplode("entries").alias("i", "x"))
    two = one.select("n", "x", F.explode(F.expr("slice(entries, i + 2, size(entries))")).alias("y")).filter(
        DEN * F.col("x.size") >= NUM * F.col("y.size")
    )
    first, second = F.least("x", "y"), F.greatest("x", "y")
    pairs = two.select("n", first.alias("one"), second.alias("two")).select("n", *[
        F.col(f"{side}.{c}").alias(f"{out}{end}") for side, end in (("one", "a"), ("two", "b"))
        for c, out in (("grp", ""), ("size", "size_"), ("place", "place_"))
    ])
    early = _may_be_first("size_a", "size_b", "place_a", "place_b").cast("int")
    return pairs.groupBy("a", "b", "size_a", "size_b").agg(F.sum("n").alias("n"), F.max(early).alias("early"))


def _sets(wanted: DataFrame, docs: DataFrame, rows: DataFrame, n: int) -> DataFrame:
    """node, hashes of the nodes in ``wanted`` (want), from one document of each."""
    one = (
        rows.join(wanted, F.col("node") == F.col("want"), "left_semi")
        .groupBy("node").agg(F.min("doc_id").alias("one_doc")).select("one_doc").distinct()
    )
    chosen = _texts(docs).join(common.small_side(freeze(one)), F.col("doc_id") == F.col("one_doc"), "left_semi")
    schema = pa.schema([("node", pa.int64()), ("hashes", pa.binary())])

    def sets(stream):
        for batch in stream:
            held, total = [], 0
            for hashes in shingle_sets(common.filled(batch.column(1)), n):
                if len(hashes):
                    held.append((node_of(hashes), hashes.tobytes()))
                    total += len(hashes)
                if total * 8 >= common.PIECE_BYTES:
                    yield common.batch_of(schema, list(zip(*held)))
                    held, total = [], 0
            if held:
                yield common.batch_of(schema, list(zip(*held)))

    return chosen.mapInArrow(common.tidy(sets), "node bigint, hashes binary").dropDuplicates(["node"])


def _placed(pairs: DataFrame) -> DataFrame:
    """Pairs with the place (key, low, high) where both sets are compared.

    Pairs of near copies meet at their smallest node, so a set travels there once, however many pairs it is in. Small
    meetings share a place; a meeting of more than VERIFY_BYTES is cut into pairs of blocks.
    """
    ends = pairs.select(F.col("a").alias("node"), F.col("b").alias("other")).unionAll(pairs.select("b", "a"))
    at = ends.groupBy("node").agg(F.least(F.first("node"), F.min("other")).alias("at"))
    met = freeze(pairs.join(at.withColumnRenamed("node", "of"), F.col("a") == F.col("of")).drop("of"))
    sides = met.select("at", F.col("a").alias("node"), F.col("size_a").alias("size")).unionAll(met.select("at", "b", "size_b"))
    sizes = sides.distinct().groupBy(F.col("at").alias("of")).agg((F.sum("size") * 8).alias("bytes"))
    sizes = freeze(sizes)
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    small = F.col("bytes") <= VERIFY_BYTES
    blocks = F.expr(f"1 + bytes div {VERIFY_BYTES}")
    first, second = (F.when(small, 0).otherwise(F.pmod(F.xxhash64(c), blocks)).cast("int") for c in ("a", "b"))
    shared = F.pmod(F.xxhash64("at"), F.lit(1 + total // VERIFY_BYTES))
    return met.join(sizes, F.col("at") == F.col("of")).select(
        "a", "b", small.alias("small"), F.when(small, shared).otherwise(F.col("at")).alias("key"),
        F.least(first, second).alias("low"), F.greatest(first, second).alias("high"),
    )


def _verified(pairs: DataFrame, docs: DataFrame, rows: DataFrame, n: int) -> DataFrame:
    """Pairs (a, b) of the given (a, b, size_a, size_b) whose whole sets are similar enough."""
    place = ["small", "key", "low", "high"]
    placed = freeze(_placed(pairs))
    sides = placed.select(*place, F.col("a").alias("want")).unionAll(placed.select(*place, "b")).distinct()
    sets_ = sides.join(_sets(sides.select("want").distinct(), docs, rows, n), F.col("want") == F.col("node")).drop("want")
    links = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def check(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        held = {node: h for node, h in zip(sets["node"].to_pylist(), sets["hashes"])}
        found = []
        for a, b in zip(pairs["a"].to_pylist(), pairs["b"].to_pylist()):
            x, y = (np.frombuffer(held[i].as_buffer(), np.uint64) for i in (a, b))
            at = np.searchsorted(x, y)
            at[at == len(x)] = 0
            same = int((x[at] == y).sum())
            if DEN * same >= NUM * (len(x) + len(y) - same):
                found.append((a, b))
        return pa.Table.from_batches([common.batch_of(links, list(zip(*found)) or [[], []])])

    # Both sides come from ``placed``; new names keep them apart.
    theirs = [f"{c}_of" for c in place]
    sets_ = sets_.select(*[F.col(c).alias(n) for c, n in zip(place, theirs)], "node", "hashes")
    return freeze(placed.groupBy(*place).cogroup(sets_.groupBy(*theirs)).applyInArrow(check, "a bigint, b bigint"))


def _named(links: DataFrame) -> DataFrame:
    return freeze(components(links))


def _with_component(lists: DataFrame, parts: DataFrame) -> DataFrame:
    """Long-list entries with the component of their node so far."""
    return lists.join(parts.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").select(
        "token", "node", "size", F.coalesce("component", "node").alias("component")
    )


def _column_filter(size_a, size_b, place_a, place_b):
    similar_sizes = DEN * F.least(size_a, size_b) >= NUM * F.greatest(size_a, size_b)
    return similar_sizes & _may_be_first(size_a, size_b, place_a, place_b)


def _hub_pairs(entries: DataFrame) -> DataFrame:
    """Each long-list entry with HUBS partners of its list: the smallest by hashes that differ by hub."""
    def order(number):
        return F.struct(F.xxhash64("node", F.lit(number)).alias("h"), "node", "size", "place")

    hubs = entries.groupBy("token").agg(F.array(*[F.min(order(i)) for i in range(HUBS)]).alias("hubs")).select(
        F.col("token").alias("at"), F.explode(F.array_distinct("hubs")).alias("hub")
    ).select("at", F.col("hub.node").alias("hub"), F.col("hub.size").alias("hub_size"), F.col("hub.place").alias("hub_place"))
    met = entries.join(hubs, F.col("token") == F.col("at")).filter(
        (F.col("node") != F.col("hub")) & _column_filter("size", "hub_size", "place", "hub_place")
    )
    ends = [F.struct(node, F.col(size).alias("size")) for node, size in ((F.col("node"), "size"), (F.col("hub").alias("node"), "hub_size"))]
    ordered = met.select(F.least(*ends).alias("one"), F.greatest(*ends).alias("two")).distinct()
    return ordered.select(
        F.col("one.node").alias("a"), F.col("two.node").alias("b"), F.col("one.size").alias("size_a"), F.col("two.size").alias("size_b")
    )


def _members_of(pairs: DataFrame, members: DataFrame, long_list: int) -> tuple[DataFrame, DataFrame]:
    """Pairs of nodes for pairs of groups (a, b), and lists of nodes in place of what would be too many pairs.

    A group's own nodes are paired too. Groups of more than ``long_list`` nodes, and pairs with such a group, become lists.
    """
    counted = members.groupBy("grp").agg(F.count(F.lit(1)).alias("n_nodes"))
    several = freeze(counted.filter("n_nodes > 1"))
    sized = pairs.select("a", "b")
    for side in ("a", "b"):
        sized = sized.join(
            common.small_side(several.toDF(f"of_{side}", f"n_{side}")), F.col(side) == F.col(f"of_{side}"), "left"
        ).drop(f"of_{side}")
    large = F.greatest(F.coalesce("n_a", F.lit(1)), F.coalesce("n_b", F.lit(1))) > long_list
    own = several.select(F.col("grp").alias("a"), F.col("grp").alias("b"), (F.col("n_nodes") > long_list).alias("large"))
    asked = freeze(sized.select("a", "b", large.alias("large")).unionAll(own))

    def side(name):
        return members.select(F.col("grp").alias(f"grp_{name}"), F.col("node").alias(f"node_{name}"), F.col("size").alias(f"size_{name}"))

    met = asked.filter(~F.col("large")).join(side("a"), F.col("a") == F.col("grp_a")).join(side("b"), F.col("b") == F.col("grp_b"))
    met = met.filter((F.col("a") != F.col("b")) | (F.col("node_a") < F.col("node_b")))
    swap = F.col("node_a") > F.col("node_b")
    nodes = met.select(*[
        F.when(swap, F.col(x)).otherwise(F.col(y)).alias(out)
        for x, y, out in (("node_b", "node_a", "a"), ("node_a", "node_b", "b"), ("size_b", "size_a", "size_a"), ("size_a", "size_b", "size_b"))
    ])
    listed = asked.filter("large").select(F.xxhash64("a", "b").alias("token"), F.explode(F.array_distinct(F.array("a", "b"))).alias("of"))
    lists = listed.join(members, F.col("of") == F.col("grp")).select("token", "node", "size", F.lit(0).cast("bigint").alias("place"))
    return nodes, lists


def _mixed_lists(entries: DataFrame) -> DataFrame:
    """Entries of lists that still hold several components."""
    mixed = entries.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    mixed = mixed.filter(F.col("low") != F.col("high")).select(F.col("token").alias("at"))
    return entries.join(mixed, F.col("token") == F.col("at"), "left_semi")


def _crossing_links(entries: DataFrame, docs: DataFrame, rows: DataFrame, n: int) -> DataFrame:
    """Links that join different components among nodes that share long lists.

    Nodes that lists connect form a cluster. A cluster is cut into blocks of bounded bytes; a task
    gets the sets of two blocks, compares what is still unconnected, and returns no more links than it has
    nodes. So pairs are never rows, and no cluster is held whole.
    """
    first = entries.groupBy("token").agg(F.min("node").alias("lead")).withColumnRenamed("token", "at")
    shared = entries.join(first, F.col("token") == F.col("at")).select(F.col("node").alias("a"), F.col("lead").alias("b"))
    clusters = components(shared).withColumnRenamed("node", "of").withColumnRenamed("component", "cluster")
    nodes = entries.select("node", "size", "component").distinct().join(clusters, F.col("node") == F.col("of")).drop("of")
    nodes = freeze(nodes)
    parts = nodes.groupBy(F.col("cluster").alias("in")).agg((1 + F.expr(f"sum(size) * 8 div {BLOCK_BYTES}")).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    placed = nodes.join(parts, F.col("cluster") == F.col("in")).withColumn("block", block).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    ).select("cluster", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "component")
    sets_ = _sets(nodes.select(F.col("node").alias("want")), docs, rows, n).withColumnRenamed("node", "of")
    links = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    return freeze(
        placed.join(sets_, F.col("node") == F.col("of")).drop("of")
        .groupBy("cluster", "low", "high").applyInArrow(lambda table: _block_links(table, links), "a bigint, b bigint")
    )


def _block_links(table: pa.Table, schema: pa.Schema) -> pa.Table:
    """Links between components within the sets of one or two blocks."""
    nodes, label, block = (table[c].to_numpy().copy() for c in ("node", "component", "block"))
    order = np.argsort(nodes)
    hashes = [np.frombuffer(h.as_buffer(), np.uint64) for h in table["hashes"]]
    hashes = [hashes[i] for i in order]
    nodes, label, block = nodes[order], label[order], block[order]
    size = np.array([len(h) for h in hashes])
    distinct, number = np.unique(np.concatenate(hashes), return_inverse=True)
    starts = np.cumsum(size) - size
    marked = np.zeros(len(distinct), np.int32)
    two = block.min() != block.max()
    found = []
    for a in range(len(nodes)):
        other = (label != label[a]) & (DEN * np.minimum(size, size[a]) >= NUM * np.maximum(size, size[a]))
        other[:a + 1] = False
        if two:
            # Pairs within a block are compared where the block meets itself.
            other &= block != block[a]
        b = np.flatnonzero(other)
        if not len(b):
            continue
        own = number[starts[a]:starts[a] + size[a]]
        marked[own] = 1
        for part in np.array_split(b, 1 + int(size[b].sum()) // PART_TOKENS):
            at = np.arange(size[part].sum()) + np.repeat(starts[part] - np.cumsum(size[part]) + size[part], size[part])
            same = np.add.reduceat(marked[number[at]], np.cumsum(size[part]) - size[part])
            linked = part[DEN * same >= NUM * (size[a] + size[part] - same)]
            for i in linked:
                if label[i] != label[a]:
                    found.append((nodes[a], nodes[i]))
                    label[label == label[i]] = label[a]
        marked[own] = 0
    return pa.Table.from_batches([common.batch_of(schema, list(zip(*found)) or [[], []])])


def near_duplicates(docs: DataFrame, n: int = WORDS, long_list: int = LONG_LIST) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs``."""
    return _decided(docs, n, long_list).select("doc_id", "n_shingles", "component_id")


def _decided(docs: DataFrame, n: int, long_list: int = LONG_LIST) -> DataFrame:
    """doc_id, n_shingles, component_id, node, stays for every row of ``docs``.

    ``stays`` marks the rows of one node and ``doc_id`` of each component, the smallest ``doc_id``.
    """
    linkable = docs.filter(F.col("doc_id").isNotNull())
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(24, max(4, int(size // (SHINGLE_BYTES * BUCKET_TOKENS)).bit_length()))
    frequent = frequent_tokens(linkable, bits, n)
    rows = freeze(_set_rows(docs, bits, frequent, n))
    known = rows.filter(F.col("doc_id").isNotNull() & F.col("node").isNotNull())
    members = freeze(known.select("grp", "node", F.col("n_shingles").alias("size")).distinct())
    met = freeze(postings(linkable, bits, frequent, n).groupBy("bucket").applyInArrow(
        lambda table: _tidy_lists(table, long_list),
        "kind int, token bigint, groups array<bigint>, sizes array<bigint>, places array<bigint>",
    ))
    lists = met.filter("kind = 1").select(
        "token", F.get("groups", F.lit(0)).alias("in_list"), F.get("places", F.lit(0)).alias("place")
    )
    # Tokens of a group in long lists are not counted pair by pair: they may all be common.
    in_long = common.small_side(freeze(lists.groupBy("in_list").agg(F.count(F.lit(1)).alias("n_long"))))
    pairs = _list_pairs(met.filter("kind = 0"))
    for side in ("a", "b"):
        more = in_long.select(F.col("in_list").alias(f"of_{side}"), F.col("n_long").alias(f"long_{side}"))
        pairs = pairs.join(more, F.col(side) == F.col(f"of_{side}"), "left")
    rest = F.greatest(*[F.expr(f"({NUM} * {s} + {DEN - 1}) div {DEN} - 1") for s in ("size_a", "size_b")])
    possible = F.col("n") + F.least(F.coalesce("long_a", F.lit(0)), F.coalesce("long_b", F.lit(0))) + rest + SLACK
    least = _least_shared("size_a", "size_b")
    # The first common token may also stand in a long list.
    in_both = F.col("long_a").isNotNull() & F.col("long_b").isNotNull()
    tried, more_lists = _members_of(pairs.filter((possible >= least) & ((F.col("early") == 1) | in_both)), members, long_list)
    entries = lists.join(members, F.col("in_list") == F.col("grp")).select("token", "node", "size", "place").unionAll(more_lists)
    entries = freeze(entries)
    has_lists = not entries.isEmpty()
    if has_lists:
        tried = tried.unionAll(_hub_pairs(entries)).distinct()
    links = _verified(tried, docs, known, n)
    parts = _named(links)
    if has_lists:
        mixed = freeze(_mixed_lists(_with_component(entries, parts)))
        if not mixed.isEmpty():
            links = links.unionAll(_crossing_links(mixed, docs, known, n))
            parts = _named(links)
    return _expanded(rows, known, parts)


def _expanded(rows: DataFrame, known: DataFrame, parts: DataFrame) -> DataFrame:
    """Component ids of documents: the smallest doc_id of all nodes in a component."""
    named = parts.withColumnRenamed("node", "of")
    nodes = known.groupBy("node").agg(F.min("doc_id").alias("low_doc"))
    joined = nodes.join(named, F.col("node") == F.col("of"), "left").select(
        "node", "low_doc", F.coalesce("component", "node").alias("component")
    )
    joined = freeze(joined)
    # Only components of several nodes need a second look.
    several = joined.groupBy("component").agg(F.min(F.struct("low_doc", "node")).alias("first"))
    named = joined.join(several.withColumnRenamed("component", "in"), F.col("component") == F.col("in")).select(
        F.col("node").alias("of_node"), F.col("first.low_doc").alias("lowest"), F.col("first.node").alias("first_node")
    )
    at = F.when(F.col("doc_id").isNotNull(), F.coalesce("lowest", "doc_id"))
    return rows.join(named, F.col("node") == F.col("of_node"), "left").select(
        "doc_id", "n_shingles", at.alias("component_id"), "node",
        ((F.col("doc_id") == F.col("lowest")) & (F.col("node") == F.col("first_node"))).alias("stays"),
    )


def one_per_group(docs: DataFrame, n: int = WORDS) -> DataFrame:
    """``docs`` without near duplicates: of each component the row of the smallest ``doc_id`` stays.

    Repeated rows of that document with the same shingle set count as copies too, so one row of them stays.
    Unlike texts under one ``doc_id`` are decided one by one. Rows without words, and rows without ``doc_id``, all stay.
    """
    found = _decided(docs, n).filter(F.col("doc_id").isNotNull())
    shared = freeze(found.groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    gone = freeze(found.filter(F.col("node").isNotNull() & ~F.col("stays")).select("doc_id").distinct())
    if shared.isEmpty():
        return _without(docs, gone)
    key = common.unused(docs, "shared_doc")
    shared = common.small_side(shared.toDF(key))
    same = F.col("doc_id").cast("bigint") == F.col(key)
    stay = found.filter("stays").join(shared, same, "left_semi").select("doc_id", "node").distinct()
    single = _without(docs.join(shared, same, "left_anti"), gone)
    return single.unionByName(_one_per_node(docs.join(shared, same, "left_semi"), stay, n))


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    key = common.unused(docs, "gone_doc")
    return docs.join(common.small_side(gone.toDF(key)), F.col("doc_id").cast("bigint") == F.col(key), "left_anti")


def _one_per_node(docs: DataFrame, stay: DataFrame, n: int) -> DataFrame:
    """Of rows that share a doc_id: those without words, and one of each (doc_id, node) in ``stay``."""
    node, doc, of = (common.unused(docs, c) for c in ("own_node", "stay_doc", "stay_node"))
    at = docs.columns.index("text")
    names = [*docs.columns, node]

    def with_node(stream):
        for batch in stream:
            nodes = [node_of(h) if len(h) else None for h in shingle_sets(common.filled(batch.column(at)), n)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nodes, pa.int64())], names=names)

    marked = docs.mapInArrow(with_node, T.StructType([*docs.schema.fields, T.StructField(node, T.LongType())]))
    met = (F.col("doc_id").cast("bigint") == F.col(doc)) & (F.col(node) == F.col(of))
    kept = marked.join(common.small_side(freeze(stay).toDF(doc, of)), met, "left_semi").dropDuplicates(["doc_id", node])
    return marked.filter(F.col(node).isNull()).unionByName(kept).drop(node)
