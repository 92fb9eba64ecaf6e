"""The stages of the corpus pipeline: raw documents to packed training sequences, each stage one of the operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_id, packing, simhash, substring_dedup, toxicity
from .shared import cut, discard, free_name

MIN_LANGUAGE_SCORE = 0.5
TOXIC_FROM = 0.7
NEAR_SHINGLE = 5
NEAR_FROM = 0.8


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is one of the learned ones with at least even odds; columns stay as they are.

    Null, empty and letterless texts have no language and go. Repeated rows are judged alike, each by its own text.
    An empty table gives an empty table.
    """
    model = language_id.fit(docs)
    label, score = free_name(docs, "__lang_pred"), free_name(docs, "__lang_score")
    marked = language_id.identify(docs, model, label_as=label, score_as=score)
    return marked.where((F.col(label) != language_id.UNKNOWN) & (F.col(score) >= MIN_LANGUAGE_SCORE)).select(*docs.columns)


def by_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity under the threshold; the model learns from the labels of documents that are there.

    Null and empty texts have the score of the lowest margins and stay. Repeated rows are judged alike. Without
    labels nothing is learnt and every row stays.
    """
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = free_name(docs, "__toxicity")
    return toxicity.score(docs, model, score_as=name).where(F.col(name) < TOXIC_FROM).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked by SimHash or shared shingles, both verified.

    Null, empty and wordless texts are copies of each other. Rows that repeat an id stay or go together; rows with
    a null id stay.
    """
    return simhash.keep_one_similar(docs, shingle=NEAR_SHINGLE, similarity=NEAR_FROM)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the windows of 35 words that start anywhere else too; every row stays, a null text as an empty one."""
    return substring_dedup.drop_repeats(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens; null and empty texts are their end id alone."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", by_language),
    ("toxicity", by_toxicity),
    ("simhash_dedup", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("packing", packed),
]

#: SQL can express neither the trained stages nor the tokenizer; tests/llm holds the others against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            before, docs = docs, cut(docs, f"stage-{name}")
            discard(before)  # the written table of the stage before; the input itself is none
    return docs
