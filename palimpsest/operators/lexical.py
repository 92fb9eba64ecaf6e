"""Lexical similarity of text pairs, candidates by shared shingles, classification and scores, all native."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions import text as T

from . import segments


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b)).cast("double")
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / F.size(F.array_union(a, b))).otherwise(0.0)


def containment(query: Column, source: Column) -> Column:
    return F.when(F.size(query) > 0, F.size(F.array_intersect(query, source)).cast("double") / F.size(F.array_distinct(query))).otherwise(0.0)


def set_overlap(query: Column, source: Column) -> Column:
    """Share of the query's different tokens that the source has."""
    return containment(F.array_distinct(query), source)


def multiset_overlap(query: Column, source: Column) -> Column:
    """Share of the query's tokens, with repeats, that the source has as often."""
    shared = F.aggregate(
        F.array_intersect(query, source), F.lit(0), lambda n, t: n + F.least(F.size(F.filter(query, lambda x: x == t)), F.size(F.filter(source, lambda x: x == t)))
    )
    return F.when(F.size(query) > 0, shared.cast("double") / F.size(query)).otherwise(0.0)


def long_similarity(a: Column, b: Column) -> Column:
    """Shared different words over the larger number of them: what character similarity is for long texts."""
    x, y = (F.array_distinct(T.words(F.lower(c))) for c in (a, b))
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)).cast("double") / F.greatest(F.size(x), F.size(y))).otherwise(0.0)


def best_scale(scores: dict[int, Column]) -> tuple[Column, Column]:
    """Highest containment over the n-gram scales and the first scale that has it."""
    best = F.greatest(*scores.values())
    which = F.lit(None).cast("int")
    for n in reversed(list(scores)):
        which = F.when(scores[n] == best, n).otherwise(which)
    return best, which


def shared_shingles(queries: DataFrame, sources: DataFrame, qid: str, sid: str, text: str = "text", n: int = 5, least: int = 3) -> DataFrame:
    """``(qid, sid, phrases)``: pairs that share at least ``least`` different n-grams.

    An inverted-index join: shingles are different per row before the shuffle, and shared counts add up in two
    steps, so no row of a pair is held with another.
    """
    def exploded(df: DataFrame, key: str) -> DataFrame:
        tokens = df.select(F.col(key), T.tokens_b(text).alias("__t"))  # once per row, not once per n-gram
        return tokens.select(key, F.explode(T.ngrams(F.col("__t"), n)).alias("shingle"))

    return exploded(queries, qid).join(exploded(sources, sid), "shingle").groupBy(qid, sid).agg(F.count("*").alias("phrases")).where(F.col("phrases") >= least)


def keep_rule(lexical: Column, overlap: Column, phrases: Column) -> Column:
    return ((lexical >= 0.25) & (phrases >= 3)) | (phrases >= 10) | ((overlap >= 0.70) & (phrases >= 5))


def combined_base(contained: Column, overlap: Column, char: Column, jac: Column) -> Column:
    return 0.4 * contained + 0.3 * overlap + 0.2 * char + 0.1 * jac


def combined_enhanced(best: Column, overlap: Column, char: Column, jac: Column) -> Column:
    return 0.35 * best + 0.35 * overlap + 0.20 * char + 0.10 * jac


def classify_base(contained: Column, overlap: Column, char: Column, jac: Column) -> Column:
    c = combined_base(contained, overlap, char, jac)
    return (
        F.when(c >= 0.95, F.when(char > 0.95, "EXACT_COPY").otherwise("DIRECT_COPY"))
        .when(c >= 0.80, F.when(overlap > 0.7, "DIRECT_COPY").otherwise("PARAPHRASE"))
        .when(c >= 0.50, F.when((contained > 0.6) & (overlap < 0.5), "MOSAIC").otherwise("PARAPHRASE"))
        .when((contained > 0.2) | (overlap > 0.2), "COMMON_KNOWLEDGE")
        .otherwise("NO_MATCH")
    )


def divergent(semantic: Column, lexical: Column, gap: float = 0.45) -> Column:
    return ((semantic > 0.70) & (lexical < 0.30)) | ((semantic > 0.85) & (lexical < 0.50)) | (semantic - lexical > gap)


def adjusted(semantic: Column, lexical: Column, is_divergent: Column, cited: Column, boilerplate: Column, common: Column) -> tuple[Column, Column]:
    """Adjusted score and confidence: a weighted mean, damped by divergence, citation, boilerplate and common phrases."""
    raw = 0.30 * semantic + 0.70 * lexical
    score = F.when((semantic >= 0.60) & (lexical >= 0.60), F.greatest(raw, (semantic + lexical) / 2 * 1.1)).otherwise(raw)
    confidence = F.lit(1.0)
    for factor_score, factor_conf, when in (
        (F.when(lexical >= 0.5, 0.85).when(lexical >= 0.35, 0.70).otherwise(0.5), F.when(lexical >= 0.5, 0.75).when(lexical >= 0.35, 0.60).otherwise(0.4), is_divergent),
        (F.lit(0.85), F.lit(0.85), cited),
        (F.lit(0.5), F.lit(0.5), boilerplate),
        (F.lit(0.85), F.lit(0.8), common),
    ):
        score = F.when(when, score * factor_score).otherwise(score)
        confidence = F.when(when, confidence * factor_conf).otherwise(confidence)
    return F.least(F.lit(1.0), score), F.least(F.lit(1.0), confidence)


def sentence_boost(score: Column, confidence: Column, best: Column, strong: Column) -> tuple[Column, Column]:
    """Raised score and confidence where the best sentence reaches 0.8; ``strong`` sentences reach 0.7."""
    return (
        F.when(best >= 0.8, F.greatest(score, 0.3 * best + 0.7 * score)).otherwise(score),
        F.when(best >= 0.8, F.least(F.lit(1.0), confidence + 0.1 * strong)).otherwise(confidence),
    )


def classify_enhanced(score: Column, confidence: Column, lexical: Column, semantic: Column, cited: Column, is_divergent: Column, strong: Column, exact: float = 0.95, high: float = 0.80, moderate: float = 0.50) -> Column:
    top = F.greatest(score, lexical)
    return (
        F.when(is_divergent & (lexical < 0.30), F.when(semantic > 0.75, "COMMON_TOPIC").otherwise("NO_MATCH"))
        .when(cited & (lexical < 0.35) & (semantic < 0.50), "PROPER_CITATION")
        .when(lexical >= 0.95, "EXACT_COPY")
        .when((lexical >= 0.85) | (top >= exact), "DIRECT_COPY")
        .when((lexical >= 0.70) | (top >= high), F.when(lexical > 0.75, "DIRECT_COPY").when(strong > 3, "MOSAIC").otherwise("PARAPHRASE"))
        .when((lexical >= 0.50) | (top >= moderate), F.when(strong > 2, "MOSAIC").when(confidence < 0.4, "COMMON_KNOWLEDGE").otherwise("PARAPHRASE"))
        .when((lexical > 0.30) | (top > 0.35), "COMMON_KNOWLEDGE")
        .otherwise("NO_MATCH")
    )


def match_spans(matches: DataFrame, keys: list[str], position: str = "pos", n: int = 5, least: int = 4) -> DataFrame:
    """Merge matching n-gram positions (gap of at most one) to token spans of at least ``least`` tokens."""
    w = W.partitionBy(*keys).orderBy(position)
    fresh = F.when(F.col(position) - F.lag(position).over(w) <= 1, 0).otherwise(1)
    island = matches.withColumn("__fresh", fresh).withColumn("__island", F.sum("__fresh").over(w))
    spans = island.groupBy(*keys, "__island").agg(F.min(position).alias("span_start"), (F.max(position) + n).alias("span_end"))
    return spans.where(F.col("span_end") - F.col("span_start") >= least).drop("__island")


def pair_metrics(pairs: DataFrame, query: str = "query_text", source: str = "source_text") -> DataFrame:
    """``pairs`` with base and enhanced metrics. Tokens are made once per row; character similarity is the long branch."""
    t = pairs.withColumn("__q", T.tokens_a(query)).withColumn("__s", T.tokens_a(source))
    for n in (3, 4, 5, 7):
        t = t.withColumn(f"__q{n}", T.ngrams(F.col("__q"), n)).withColumn(f"__s{n}", T.ngrams(F.col("__s"), n))
    scales = {n: containment(F.col(f"__q{n}"), F.col(f"__s{n}")) for n in (3, 4, 5, 7)}
    t = t.withColumns({f"containment_{n}": c for n, c in scales.items()})
    best, which = best_scale({n: F.col(f"containment_{n}") for n in scales})
    t = t.withColumn("jaccard", jaccard(F.col("__q5"), F.col("__s5"))).withColumn("word_overlap", multiset_overlap(F.col("__q"), F.col("__s"))).withColumn("char_similarity", long_similarity(F.col(query), F.col(source)))
    t = t.withColumn("best_containment", best).withColumn("best_scale", which)
    t = t.withColumn("combined", combined_base(F.col("containment_5"), F.col("word_overlap"), F.col("char_similarity"), F.col("jaccard"))).withColumn("lexical", combined_enhanced(F.col("best_containment"), F.col("word_overlap"), F.col("char_similarity"), F.col("jaccard")))
    return t.drop(*[c for c in t.columns if c.startswith("__")])


def reference_metrics(pairs: DataFrame, query: str = "query_text", source: str = "source_text") -> DataFrame:
    """As :func:`pair_metrics`, with the reference's character similarities: difflib for the base, by length for the enhanced."""
    t = pair_metrics(pairs, query, source).drop("char_similarity", "combined", "lexical")
    t = t.withColumn("base_char_similarity", segments.base_similarity(F.col(query), F.col(source))).withColumn("char_similarity", segments.char_similarity(F.col(query), F.col(source)))
    return t.withColumn("combined", combined_base(F.col("containment_5"), F.col("word_overlap"), F.col("base_char_similarity"), F.col("jaccard"))).withColumn("lexical", combined_enhanced(F.col("best_containment"), F.col("word_overlap"), F.col("char_similarity"), F.col("jaccard")))


def document_risk(matches: DataFrame, key: str) -> DataFrame:
    """Text score and risk per document from ``matches(key, overlap, match_type)``."""
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc("overlap"), "match_type"))
    o = F.col("overlap")
    weight = F.when(o >= 0.70, 1.0).when(o >= 0.50, 0.9).when(o >= 0.35, 0.7).otherwise(0.4)
    top = matches.withColumn("__rank", rank)
    agg = top.groupBy(key).agg(
        F.sum(F.when(F.col("__rank") <= 10, o * weight)).alias("__sum"), F.count("*").alias("n_matches"), F.bool_or(F.col("match_type").isin("EXACT_COPY", "DIRECT_COPY")).alias("__copied")
    )
    score = F.least(F.lit(1.0), F.col("__sum") / F.least(F.lit(5), F.least(F.lit(10), F.col("n_matches"))))
    scored = agg.withColumn("text_score", score)
    risk = F.when(F.col("__copied") | (F.col("text_score") > 0.8), "CRITICAL").when(F.col("text_score") > 0.5, "HIGH").when(F.col("text_score") > 0.3, "MEDIUM").otherwise("LOW")
    return scored.select(key, "n_matches", "text_score", risk.alias("risk_level"))
