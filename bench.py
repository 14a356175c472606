"""Headline timings over the line-item catalog; prints one JSON line.

The catalog is published once (timed as ``publish``); every other query reads the
stored tables, as jobs on a cluster would. Each value is the median of BENCH_RUNS runs.
"""

import json
import os
import statistics
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from catalogspark.operators import catalog as records
from catalogspark.operators import bitmaps, facets, index, sampling, tree
from catalogspark.plans import increments, publish, search
from catalogspark.schema import QUERY
from catalogspark.sources import compact, tables
from catalogspark.streaming import recent

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "5"))


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g").config("spark.ui.showConsoleProgress", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="catalogspark-bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def noop(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def batch(spark, sf_dir, kind: str):
    """100 queries from the query log: token queries, or literal ones."""
    logged = tables.query_events(spark, sf_dir).select(F.col("q").cast("bigint").alias("k")).distinct()
    words = F.array(*[F.lit(w) for w in ("ring", "gear", "bolt", "red widget", "small rod", "anvl", "blue 1998")])
    word = F.get(words, F.pmod("k", F.lit(7)).cast("int"))
    q = word if kind == "token" else F.concat(F.substring(word, 1, 4), F.lit("*"), F.col("k").cast("string"))
    fields = {"query_id": F.col("k"), "q": q, "search_folders": F.lit(True), "page_size": F.lit(50)}
    return logged.select(
        *[fields.get(n, F.lit(None)).cast(t).alias(n) for n, t in (f.split() for f in QUERY.split(", "))]
    )


def main() -> None:
    spark = session()
    root = tables.scratch(spark, "bench")
    raw_path = f"{root}/raw"
    tables.lineitem_catalog(spark, SF_DIR).write.parquet(raw_path)
    raw = spark.read.parquet(raw_path)
    times = {}

    def timed(name, run, runs=RUNS):
        took = []
        for _ in range(runs):
            start = time.perf_counter()
            run()
            took.append(time.perf_counter() - start)
        times[name] = round(statistics.median(took), 3)

    timed("publish", lambda: publish.publish(raw, f"{root}/published", 1, search_tables=False), runs=1)
    timed("publish_search_tables", lambda: publish.publish_search_tables(spark, f"{root}/published", 1), runs=1)
    catalog = publish.read_published(spark, f"{root}/published", "catalog", 1)
    stored = publish.read_index(spark, f"{root}/published", 1)

    def one(**params):
        result = search.search(catalog, stored, **params)
        return lambda: (result.rows.collect(), result.totals.collect())

    def many(kind):
        def run():
            result = search.search_batch(catalog, stored, batch(spark, SF_DIR, kind))
            result.rows.collect()
            result.totals.collect()

        return run

    tables.write_compact(raw, f"{root}/compact", 20_000)
    timed("corpus_decode", lambda: noop(compact.decode_compact(compact.read_compact(spark, f"{root}/compact"))))
    timed("index_build", lambda: noop(index.vocabulary(index.postings(raw))))
    timed("record_ids", lambda: noop(records.with_record_id(raw)))
    timed("literal_query", lambda: one(q="ed r", exact=True)())
    timed("wildcard_query", lambda: one(q="r?d*7")())
    timed("token_query", lambda: one(q="red ring 1998")())
    timed("rare_token_query", lambda: one(q="small 4711")())
    timed("rare_text_query", lambda: one(q="ed ring 4711", exact=True)())
    timed("subtree_query", lambda: one(q="", folders=["1998/7"], sort="size")())
    timed("hit_facets", lambda: search.search_facets(catalog, stored, q="red 4711", extensions=["pdf"]).collect())
    timed("filtered_page", lambda: one(q="", repos=["shop/Brand#7", "shop/Brand#8"], extensions=["pdf"], page=20)())
    timed("fuzzy_query", lambda: one(q="rng blts")())
    timed("filtered_query", lambda: one(q="", repos=["shop/Brand#7"], extensions=["pdf"], folders=["1998"], min_size=40000, sort="size")())
    timed("name_sorted_query", lambda: one(q="gear", exact=True, sort="name")())
    timed("token_batch_100", many("token"))
    timed("literal_batch_100", many("literal"))
    entries = stored.browse
    timed("browse_page", lambda: publish.browse_page(catalog, entries, "name", page=50).collect())
    timed("facets", lambda: facets.corpus_metadata(facets.facet_cube(catalog)).collect())
    timed("folder_tree", lambda: noop(tree.folder_tree(tree.folder_counts(catalog))))
    timed("random_per_repo", lambda: sampling.random_record_per_repo(catalog, 0.5).collect())
    timed("random_per_repo_by_bitmaps", lambda: bitmaps.random_ord_per_repo(stored.bitmaps, 0.5).collect())
    corpus = increments.Corpus(spark, f"{root}/changes")
    timed("first_part", lambda: corpus.start(raw), runs=1)
    last = raw.agg(F.max("ord")).first()[0]
    more = raw.filter(F.col("ord") % 100 == 0).withColumn("ord", F.col("ord") + last)
    gone = raw.filter(F.col("ord") % 200 == 1).select("ord")
    timed("change_one_percent", lambda: corpus.change(more, gone), runs=1)
    timed("first_pages", lambda: noop(publish.first_pages(catalog)))
    timed("recent_queries", lambda: noop(recent.recent_queries(tables.query_events(spark, SF_DIR))))
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
