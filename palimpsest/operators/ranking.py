"""Order, selection and reports of matches: re-ranking, best match per chunk, batch comparison, overall report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def rerank(candidates: DataFrame, query: str, semantic: Column) -> DataFrame:
    """``rank`` of each candidate of a query by lexical score, phrases and word overlap; equal ones in order of ``semantic``."""
    order = [F.desc("lexical"), F.desc("phrases"), F.desc("word_overlap"), semantic.desc()]
    return candidates.withColumn("rank", F.row_number().over(W.partitionBy(query).orderBy(*order)))


def best_per_chunk(matches: DataFrame, chunk: str, source: str, least: float = 0.30, per_chunk: int = 20, most: int = 100) -> DataFrame:
    """Of each chunk's ``per_chunk`` matches of highest word overlap the best by (word_overlap, containment, similarity).

    Kept from a word overlap of ``least``, best first, ``most`` in all; ties are broken by source.
    """
    first = W.partitionBy(chunk).orderBy(F.desc("word_overlap"), source)
    best = W.partitionBy(chunk).orderBy(F.desc("word_overlap"), F.desc("containment"), F.desc("similarity"), source)
    listed = matches.withColumn("__k", F.row_number().over(first)).where(F.col("__k") <= per_chunk)
    kept = listed.withColumn("__k", F.row_number().over(best)).where((F.col("__k") == 1) & (F.col("word_overlap") >= least)).drop("__k")
    return kept.orderBy(F.desc("word_overlap"), F.desc("containment"), F.desc("similarity"), source, chunk).limit(most)


def batch_compare(compared: DataFrame, query: str, source: str, enhanced: bool = False, least: float = 0.2, sure: float = 0.3, k: int = 10) -> DataFrame:
    """The ``k`` best sources of each query from ``least`` on; enhanced ones also need a confidence, and no mere common topic."""
    rows = compared.where(F.col("score") >= least)
    if enhanced:
        rows = rows.where((F.col("confidence") >= sure) & (F.col("match_type") != "COMMON_TOPIC"))
    order = W.partitionBy(query).orderBy(F.desc("score"), source)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


#: Names of match types by what text comparison calls them; any other one is a paraphrase.
MATCH_KINDS = {"EXACT_COPY": "EXACT_COPY", "DIRECT_COPY": "DIRECT_COPY", "PARAPHRASE": "PARAPHRASE", "MOSAIC": "MOSAIC", "COMMON_KNOWLEDGE": "COMMON_KNOWLEDGE", "NO_MATCH": "NO_MATCH"}


def match_kind(name: Column) -> Column:
    out = F.lit("PARAPHRASE")
    for told, kind in MATCH_KINDS.items():
        out = F.when(F.upper(name) == told, kind).otherwise(out)
    return out


def overall(text: Column, image: Column, issues: Column, mode: str = "full") -> Column:
    """Score of a report: the higher of text and image score, one of them alone by mode, at least a half with integrity issues."""
    score = {"full": F.greatest(text, image), "text": text, "images": image}[mode]
    return F.when(issues & F.lit(mode != "text"), F.greatest(score, F.lit(0.5))).otherwise(score)
