"""A corpus through toxicity, language, near-duplicate, decontamination and token stages.

Every stage takes whatever columns documents have, under any names beside doc_id, text, lang and source, and decides by
row: rows without id, and rows that share one, go or stay by their own text. A null text is an empty one: it isn't
toxic, has no language, and so goes at the second stage. Of texts that tie the smallest doc_id stays. Empty tables of
any kind are fine: without labels no text is toxic, without languages to learn all with letters stay, without
benchmark items none is contaminated, without documents the result is empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import language, minhash, posindex, sentencepieces, toxicity
from plumbline.llm.store import drop_scratch, scratch_mark, scratch_path, table


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents whose text a classifier of toxicity rejects."""
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


def in_a_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that have no letters."""
    return language.reject(docs)


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8."""
    return minhash.deduplicate(docs, minhash.Settings(words=5))


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold ten words in a row of a benchmark item."""
    return posindex.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, round_trip): token ids of each document's text, and whether they decode to
    it. The text itself and other columns are left out."""
    ids = sentencepieces.encode(docs.select("doc_id", "lang", "source", "text"), round_trip="round_trip")
    return ids.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


STAGES = [("toxicity", clean), ("language", in_a_language), ("near_duplicates", unlike), ("decontamination", uncontaminated), ("tokens", tokens)]

#: The stages train classifiers and follow links, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents through all stages; each stage's rows are written to the shared folder and read again."""
    docs, before = table(spark, sf_dir, "documents"), scratch_mark()
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        path, held = scratch_path(spark, f"stage-{i}-{name}"), scratch_mark()
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        # what the stage and the one before it wrote isn't read again
        drop_scratch(spark, since=before, until=held - 1)
    return docs
