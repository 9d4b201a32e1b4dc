"""The corpus pipeline: stages that each take documents and give the documents that stay.

Every stage reads all that its predecessor kept. Rows with null, empty or very long texts pass through
each stage with the result that its operator defines for them; extra columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import decontamination, exact_dedup, mixing, near_dedup, quality
from lexmill.llm._common import cut, free, remove_folder, shared_folder, text_sha, without, without_repeats

#: Documents with a score under this are rejected.
LEAST_SCORE = 0.3


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: drops the documents that the quality classifier rejects."""
    trees = quality.train(docs, quality.read(spark, sf_dir, "labels"))
    score = free("_score", docs)
    return quality.with_score(docs, trees, score_col=score).where(F.col(score) >= LEAST_SCORE).drop(score)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: of documents with equal texts, the one with the largest doc_id stays."""
    found = cut(exact_dedup.exact_duplicates(docs))
    kept = without(docs, found.where("not kept and not doc_id <=> keep_id"), sha_col="text_sha256")
    # rows that repeat a doc_id along with its text have the same id as the row that stays
    return kept if found.where("not kept and doc_id <=> keep_id").isEmpty() else without_repeats(kept)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: of a class of near duplicates, one document with the smallest doc_id stays."""
    found = cut(near_dedup.near_duplicates(docs).where("not kept"))
    kept = without(docs, found.where("not (doc_id <=> class_id and sha = keep_sha)"))
    # rows that repeat the doc_id and the text of the row that stays
    return kept if found.where("doc_id <=> class_id and sha = keep_sha").isEmpty() else without_repeats(kept)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: drops the documents that share too much with the benchmark."""
    found = decontamination.contamination(docs, decontamination.read(spark, sf_dir, "benchmark"), extra={"sha": text_sha()})
    return without(docs, found.where((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: samples documents towards the target shares of sources, languages and topics."""
    return mixing.mix(docs, mixing.dimensions()).where("mix_sampled").drop("mix_sampled")


STAGES = [
    ("quality classifier", classify),
    ("exact dedup", drop_copies),
    ("minhash near-dedup", drop_near_copies),
    ("benchmark decontamination", decontaminate),
    ("mixing to target weights", mix_sources),
]
#: The classifier and the sketches have no SQL form; tests/llm hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; between stages, documents are a Parquet table.

    A stage's table goes once the next one is written; the last is read by the result, and stays in the shared folder.
    """
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = shared_folder(spark, "stage")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if last:
                remove_folder(spark, last)
            last = path
    return docs
