"""From raw documents to packed training sequences: five stages over the documents table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontamination, language, near_duplicates, packing, substring_dedup
from tidemark.llm.common import bounded_batches, table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: A document is rejected when no language covers this share of its letters.
LEAST_LANGUAGE_SHARE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in one language: text without letters and even mixtures of languages go.

    Null and empty texts go; texts of any length are judged whole; equal scores go to the language first by
    name; repeated rows stay repeated; an empty table stays empty; other columns are carried along.
    """
    bounded_batches(spark)
    found = language.identify(docs, language.learn(language.training_rows(docs)), with_spans=False, with_rows=True)
    return found.where((F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") >= LEAST_LANGUAGE_SHARE)).select("doc.*")


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: shingles of five words, similarity 0.8 or more.

    The smallest doc_id stays, a null one only where there is no other; of repeated rows one; documents
    without words (null, empty) stay, as they resemble nothing; other columns are carried along.
    """
    bounded_batches(spark)
    return near_duplicates.one_of_each(docs)


def substring_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes passages of 50 words that an earlier document has out of later ones; emptied documents go.

    Null texts and documents of fewer than 50 words are left as they are; rows of one doc_id, and rows without
    one, take nothing from each other; n_chars follows the text where it exists; other columns are carried along.
    """
    bounded_batches(spark)
    kept = substring_dedup.deduplicated(docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that share no window of ten words with a benchmark item.

    Null and empty texts are clean; an item of fewer words counts as a whole, one without words not at all; an
    empty benchmark keeps everything; repeated rows share their fate; other columns are carried along.
    """
    bounded_batches(spark)
    return decontamination.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def cost_balanced_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences with their token ids.

    Null text is empty text, a document of its end token; repeated rows are separate documents; of equally long
    documents the first read is placed first; an empty table gives no pieces; other columns are dropped.
    """
    bounded_batches(spark)
    return packing.packed(docs, packing.public_path())


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("substring_dedup", substring_deduplication),
    ("benchmark_decontamination", benchmark_decontamination),
    ("cost_balanced_packing", cost_balanced_packing),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
    return docs
