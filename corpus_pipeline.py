"""The corpus pipeline: five stages over the documents table.

Stages 1 to 4 take and give the columns of ``documents``; the last packs what
is left. A null doc_id names no document: such rows pass the stages that decide
by doc_id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireflow.llm.common import store, table
from quireflow.llm.line_dedup import without_lines
from quireflow.llm.ngram_join import ngram_jaccard_join
from quireflow.llm.packing import best_fit_packing, packing_items
from quireflow.llm.quality import kept_documents
from quireflow.llm.substring_dedup import duplicate_spans, remove_spans


def _recounted(docs: DataFrame, columns: list[str]) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).select(*columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return kept_documents(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that line dedup drops."""
    return _recounted(without_lines(docs), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    gone = ngram_jaccard_join(docs).where(~F.col("kept")).select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one keeps."""
    return _recounted(remove_spans(docs, duplicate_spans(docs)), docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bins of all pieces."""
    return best_fit_packing(packing_items(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("ngram_jaccard_join", near_duplicates),
    ("substring_dedup", substrings),
    ("best_fit_packing", packing),
]

#: Components, spans and packing are beyond one SQL statement; tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = store(docs)
    return docs
