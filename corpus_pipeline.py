"""A training-corpus pipeline: language, toxicity, near duplicates, mixture, packing.

Each stage reads what its predecessor wrote.  All but the last return the columns of
``documents``; the last returns the pieces of the packed sequences.  A stage's intermediate tables
go when the next one begins, whose input is written by then.
"""

from __future__ import annotations

import functools
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.llm import jaccard, language, mixing, packing, queries, toxicity
from quadrat.llm.common import crc_fold, table
from quadrat.session import noting, release, shared_folder

# Stages are iterative or trained, so SQL cannot express the rows.
ORACLE_SQL = None


def keep_known_language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Drop texts without a letter, and those where no language has a quarter of the letters."""
    model = language.fit(table(spark, folder, "documents"), crc_fold("doc_id", 4) != 2)
    found = language.identify(docs, model)
    good: Column = (F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= 0.25)
    return found.where(good).select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Drop texts whose toxicity is a half or more."""
    learn = crc_fold("doc_id", 5) != 0
    scored = toxicity.score(docs, table(spark, folder, "labels"), learn)
    return scored.where("is_toxic = 0").select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of near-duplicate documents (five-word shingles, Jaccard 0.8) keep one."""
    return jaccard.similar_groups(docs).where("kept").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Repeat or drop documents as the mix takes them; rows are in training order.

    A document of which the mix takes more than its size appears again, at the moment of that
    pass; one that is cut by the end of its source's target appears whole, so that no text is
    truncated.
    """
    return mixing.training_order(docs, queries.WEIGHTS).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens."""
    return packing.pack(docs, queries.vocabulary())


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def in_turn(stages: list[tuple[str, Stage]]) -> list[tuple[str, Stage]]:
    """The stages, each of which first deletes the intermediate tables of the one before it.

    The one before it is the last that ran in its session and thread.
    """
    held: dict[tuple, list[str]] = {}

    def turn(stage: Stage, spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
        paths = held.setdefault((spark.sparkContext.applicationId, threading.get_ident()), [])
        release(spark, paths)
        with noting() as written:
            out = stage(spark, docs, folder)
        paths += written
        return out

    return [(name, functools.partial(turn, stage)) for name, stage in stages]


STAGES = in_turn([
    ("language_id", keep_known_language),
    ("toxicity", drop_toxic),
    ("jaccard_join", one_of_each_group),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
])


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply every stage to ``documents``; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
