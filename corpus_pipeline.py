"""Corpus pipeline: five stages over ``documents``, each one operator.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns
a DataFrame, which is written as Parquet and read again as the next one's docs.
With a folder of its own a run can be started again: stages that were written
completely are read, not made again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from panelcast.llm import langid, line_dedup, mixing, sentencepiece_nbest, simhash
from panelcast.llm.common import table
from panelcast.session import drop_path, ensure_checkpoint_dir, path_exists


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (no letters) go; lang becomes the predicted one."""
    return langid.stage_langid(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in at least 10 documents go."""
    return line_dedup.stage_line_dedup(docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies stays."""
    return simhash.stage_simhash(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated to the target weights of their sources."""
    return mixing.stage_mixing(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their piece ids, score and N-best alternatives."""
    return sentencepiece_nbest.stage_sentencepiece(docs)


STAGES = [
    ("language_id", keep_languages),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", dedup_near),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: SQL can't express language ID, SimHash and the piece lattice.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, base: str | None = None) -> DataFrame:
    """All stages over ``documents``. Each stage's result is a Parquet table in ``base``
    (a folder that driver and executors share; by default a new one below the checkpoint
    folder) and goes as soon as the next stage's is written. A run over the same ``base``
    goes on after the last stage that was written completely."""
    base = (base or f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex[:12]}").rstrip("/")
    places = [f"{base}/{k}-{name}" for k, (name, _) in enumerate(STAGES, 1)]
    done = max((k for k, place in enumerate(places, 1) if path_exists(spark, f"{place}/_SUCCESS")), default=0)
    docs = spark.read.parquet(places[done - 1]) if done else table(spark, sf_dir, "documents")
    for k in range(done, len(STAGES)):
        STAGES[k][1](spark, docs, sf_dir).write.mode("overwrite").parquet(places[k])
        docs = spark.read.parquet(places[k])
        if k:
            drop_path(spark, places[k - 1])
    return docs
