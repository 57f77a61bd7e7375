"""From raw documents to packed sequences: five stages, each over all rows that its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weblens.llm import language, packing, secret_scan, simhash, substrings
from weblens.llm.shared import passing, saved, sifted


def _set_aside(docs: DataFrame, *used: str) -> tuple[DataFrame, list[str], Callable[[DataFrame], DataFrame]]:
    """docs with all columns but the used ones under names of our own, these names, and what turns a result back into the columns of docs. So no column of a table can be mistaken for one of an operator."""
    names = docs.columns
    aside = {c: f"__kept_{k}" for k, c in enumerate(names) if c not in used}

    def back(out: DataFrame) -> DataFrame:
        return out.select(*(F.col(aside.get(c, c)).alias(c) for c in names))

    return docs.select(*(F.col(f"`{c}`").alias(aside.get(c, c)) for c in names)), list(aside.values()), back


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that are null, empty or without a letter. A missing lang becomes the language that the labelled texts make most probable; without any label it stays null."""
    model = language.train(docs)
    if not model[0]:
        return language.lettered(docs)
    own, aside, back = _set_aside(docs, "doc_id", "text", "lang")
    named = language.predict(own, model, keep=("text", "lang", *aside))
    return back(named.where("score > 0").withColumn("lang", F.coalesce("lang", "lang_pred")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8; candidates from SimHash fingerprints and, for pairs that these leave apart, rare shingles) keeps the document with the smallest id, once: of rows that repeat an id the one of least text (null first), then of least other columns. Rows without an id stay."""
    with passing() as tables:
        groups = simhash.near_duplicates(docs, width=5, similarity=0.8)
        gone = groups.where("doc_id <> component_id").select("doc_id").distinct()
        repeated = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
        repeated = saved(repeated.join(gone, "doc_id", "left_anti"))
        excluded = saved(gone.union(repeated))
        del tables[-2:]  # these two are read by the result
    own, aside, back = _set_aside(docs, "doc_id", "text")
    some, rest = sifted(own, "doc_id", excluded)
    least = some.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("text", *aside)).alias("least")).select("doc_id", "least.*")
    return back(rest.unionByName(some.join(excluded, "doc_id", "left_anti")).unionByName(least))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 35 words that occur more than once out of the texts; other texts stay as they are, byte for byte."""
    own, aside, back = _set_aside(docs, "doc_id", "text")
    cut = substrings.remove_repeats(own, keep=tuple(aside), with_text=True)
    return back(cut.withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))))


def secret_scan_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts by their kinds."""
    own, aside, back = _set_aside(docs, "doc_id", "text")
    scanned = secret_scan.scan(own, keep=tuple(aside), with_text=True)
    return back(scanned.withColumnRenamed("redacted_text", "text"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the texts' tokens in training sequences."""
    return packing.pack_documents(docs, with_ids=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("simhash_near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("secret_scan", secret_scan_stage),
    ("best_fit_packing", best_fit_packing),
]

#: Models, near copies and packing are not SQL; the tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = saved(docs)
    return docs
