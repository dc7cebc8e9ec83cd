"""The registered queries of this subpackage: name -> function of (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireflow.llm.chat import chat_format
from quireflow.llm.common import table
from quireflow.llm.html_text import html_text
from quireflow.llm.language_id import language_id
from quireflow.llm.line_dedup import line_dedup
from quireflow.llm.ngram_join import ngram_jaccard_join
from quireflow.llm.packing import best_fit_packing, packing_items
from quireflow.llm.pieces import Vocabulary, sample_pieces
from quireflow.llm.quality import quality_rules
from quireflow.llm.substring_dedup import duplicate_spans

from quireflow.llm.vectors import vector_near_dedup

#: The vocabulary of the token query; read by the driver alone.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_spans(table(spark, sf_dir, "documents"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_near_dedup(table(spark, sf_dir, "embeddings"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents"))


def op5_sampled_pieces(spark: SparkSession, sf_dir: str, vocabulary: str = PIECES) -> DataFrame:
    """The samples' sizes and a hash of their ids, in place of the ids."""
    sampled = sample_pieces(table(spark, sf_dir, "documents"), Vocabulary.load(vocabulary))
    return sampled.select("doc_id", "sample", F.size("ids").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), "log_prob", "perturbed", "log_inclusion")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(packing_items(table(spark, sf_dir, "documents")))


#: The tool of the derived turns; its schema rejects late turns.
SEARCH = {"search": {"type": "object", "required": ["query", "turn"], "additionalProperties": False, "properties": {"query": {"type": "string"}, "turn": {"type": "integer", "maximum": 4}}}}


def tool_turns(messages: DataFrame) -> DataFrame:
    """``messages`` at every fourth turn, and a call and its result derived from every user message, as the table has no tools.

    The call of a turn depends on the result two turns before; the result of every third turn stands before its call.
    """
    turn, call_id = F.col("turn"), F.concat_ws("-", "conv_id", "turn")
    base = messages.select("conv_id", (turn * 4).alias("turn"), "role", "text")
    user = messages.where("role = 'user'")
    call = F.struct(call_id.alias("id"), F.lit("search").alias("name"), F.to_json(F.struct(F.col("text").alias("query"), "turn")).alias("arguments"), F.array(F.concat_ws("-", F.col("conv_id"), turn - 2)).alias("depends_on"))
    calls = user.select("conv_id", (turn * 4 + 1).alias("turn"), F.lit("assistant").alias("role"), F.to_json(F.struct(F.array(call).alias("tool_calls"))).alias("text"))
    results = user.select("conv_id", (turn * 4 + F.when(turn % 3 == 2, -1).otherwise(2)).alias("turn"), F.lit("tool").alias("role"), F.to_json(F.struct(call_id.alias("tool_call_id"), F.col("text").alias("content"))).alias("text"))
    return base.union(calls).union(results)


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages of the table, and the tool calls and results derived from them."""
    out = chat_format(tool_turns(table(spark, sf_dir, "conversations")), SEARCH)
    return out.withColumn("problems", F.array_join("problems", "; "))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_embedding_near_dedup": op2_embedding_near_dedup,
    "op3_line_dedup": op3_line_dedup,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_sampled_pieces": op5_sampled_pieces,
    "op6_language_id": op6_language_id,
    "op7_quality_rules": op7_quality_rules,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_chat_formatting": op9_chat_formatting,
    "op10_html_extraction": op10_html_extraction,
}
