"""Registered queries of this subpackage: key -> callable(spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import (ann, conversation_trie, fingerprint, html_extract, langid, lexical, line_dedup, mixing, packing, sentencepiece_nbest,
               simhash, square_packing, token_counts)
from .common import table


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.op1_fingerprints(table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_nbest.op2_sentencepiece(table(spark, sf_dir, "documents"))


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.op3_ann(table(spark, sf_dir, "embeddings"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.op4_packing(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.op5_line_dedup(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op6_mixing(table(spark, sf_dir, "documents"))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.op7_langid(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.op8_token_counts(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.op9_simhash(table(spark, sf_dir, "documents"))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.op10_html(table(spark, sf_dir, "pages"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.op11_conversation_trie(table(spark, sf_dir, "conversations"))


def op12_square_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return square_packing.op12_square_packing(table(spark, sf_dir, "documents"))


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.op13_lexical(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (
    op1_fingerprints, op2_sentencepiece, op3_ann, op4_packing, op5_line_dedup, op6_mixing, op7_langid, op8_token_counts,
    op9_simhash, op10_html, op11_conversation_trie, op12_square_packing, op13_lexical)}

#: DuckDB SQL where SQL can express the query.
ORACLE = {
    "op5_line_dedup": line_dedup.ORACLE,
    "op6_mixing": mixing.ORACLE,
    "op11_conversation_trie": conversation_trie.ORACLE,
    "op13_lexical": lexical.ORACLE,
}
