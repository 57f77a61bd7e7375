"""The registered queries of the numbered operators: thin, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from weblens.llm import chat, context_tree, language, lexical, packing, pieces, prefix_trie, quality, secret_scan, simhash, substrings, toxicity, vectors
from weblens.llm.sql import SQL


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and the digest of what they decode to."""
    back = pieces.decode(pieces.encode(documents(spark, sf_dir)))
    return back.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", F.sha2("text", 256).alias("decoded_sha256"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that are left of every document without passages of 35 words that occur elsewhere too."""
    out = substrings.remove_repeats(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of all pieces of all documents in sequences of 4096 tokens."""
    return packing.pack_documents(documents(spark, sf_dir), with_ids=False)


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies of all vectors at a cosine of 0.95."""
    return vectors.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op5_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of all documents by a model of nine tenths of them."""
    return context_tree.score(documents(spark, sf_dir), "crc32(cast(cast(doc_id as string) as binary)) % 10 <> 0")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of near copies of every document."""
    out = simhash.near_duplicates(documents(spark, sf_dir))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document."""
    out = quality.rate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", *quality.COUNTS, "base_failed", "kept", F.col("quality").alias("quality_score"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as one training text, read back from it."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    out = chat.format_paths(chat.chains(rows.unionByName(planted)), branches=None)
    out = out.withColumn("turns", chat.turns_of(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("segments")))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return out.select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; every fifth is held out of training."""
    docs = documents(spark, sf_dir).withColumn("held_out", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    model = language.train(docs.where("not held_out"))
    return language.predict(docs, model, keep=("held_out",))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document by kind and place."""
    found = secret_scan.scan(documents(spark, sf_dir))
    join = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s.kind, s.start, s.past)), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s.kind != "random")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(join(base), 256).alias("base_sha256"), join(F.col("spans")).alias("spans"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability that a document is toxic; every fifth is held out of training."""
    learned = "crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0"
    rated = toxicity.rate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), train=learned)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return rated.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "votes")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct beginning of the conversations, rebuilt to share the first turns of their block's."""
    return prefix_trie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents that each benchmark item ranks highest."""
    return lexical.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_sentencepiece, op2_substring_dedup, op3_best_fit_packing, op4_embedding_dedup, op5_context_tree, op6_simhash, op7_quality, op8_chat, op9_language, op10_secrets, op11_toxicity, op12_prefix_trie, op13_lexical_search,
)}
QUERIES["pipeline"] = corpus_pipeline.run

__all__ = ["QUERIES", "SQL"]
