"""Registered queries: each operator over its whole table, with production parameters."""

from pyspark.sql import functions as F

from catalogspark.llm import (
    divergence, hilbert, jaccard_join, license_scan, line_runs, maxent, mixing, packing, quality, spelling, toxicity,
    trie_counts, vptree,
)
from catalogspark.llm.common import fold_of, read


def _documents(spark, sf_dir):
    return read(spark, sf_dir, "documents")


def word_vocabulary() -> str:
    """Path of the public word vocabulary that the packing contract names."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1(spark, sf_dir):
    return packing.pack(_documents(spark, sf_dir), word_vocabulary())


def op2(spark, sf_dir):
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return quality.quality_rules(docs, read(spark, sf_dir, "labels")).drop("text")


def op3(spark, sf_dir):
    return mixing.mix(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op4(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    scores = toxicity.toxicity(docs, read(spark, sf_dir, "labels"), fold_of("doc_id", 3) != 1)
    return scores.select("doc_id", (fold_of("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op5(spark, sf_dir):
    return maxent.language_model_scores(_documents(spark, sf_dir), fold_of("doc_id", 10) == 0)


def op6(spark, sf_dir):
    return jaccard_join.near_duplicates(_documents(spark, sf_dir))


def op7(spark, sf_dir):
    return vptree.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op8(spark, sf_dir):
    return hilbert.document_shards(_documents(spark, sf_dir)).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op9(spark, sf_dir):
    done = line_runs.dedup_lines(_documents(spark, sf_dir).select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10(spark, sf_dir):
    import public_tokenizers

    pieces = trie_counts.load_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    return trie_counts.token_counts(_documents(spark, sf_dir), pieces)


def op11(spark, sf_dir):
    return divergence.divergence(_documents(spark, sf_dir))


def op12(spark, sf_dir):
    return license_scan.license_scan(_documents(spark, sf_dir))


def op13(spark, sf_dir):
    return spelling.spelling_variants(_documents(spark, sf_dir))


QUERIES = {
    "op1_pack_sequences": op1,
    "op2_quality_rules": op2,
    "op3_mix_sources": op3,
    "op4_toxicity": op4,
    "op5_language_model": op5,
    "op6_near_duplicates": op6,
    "op7_nearest_vectors": op7,
    "op8_hilbert_shards": op8,
    "op9_line_dedup": op9,
    "op10_token_counts": op10,
    "op11_source_divergence": op11,
    "op12_license_scan": op12,
    "op13_spelling_variants": op13,
}
