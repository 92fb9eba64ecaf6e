"""Sentence matches of text pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import text as T

from . import lexical as L


def sentence_matches(pairs: DataFrame, query: str, source: str, least: float = 0.6, tokens: int = 5) -> DataFrame:
    """``pairs`` by matched query sentence: position, best source sentence (the first of equals), its overlap, citation.

    Both sentences have at least ``tokens`` tokens; the overlap is the share of the query sentence's tokens, with
    repeats. Sentences and tokens are made once per pair; texts without a sentence give no row.
    """
    long = lambda s: F.filter(F.transform(s, lambda x: F.struct(x.alias("text"), T.tokens_a(x).alias("tokens"))), lambda x: F.size(x["tokens"]) >= tokens)
    made = pairs.withColumn("__sources", long(T.sentences(source))).withColumn("__queries", long(T.sentences(query)))
    rest = [c for c in pairs.columns if c not in (query, source)]
    each = made.select(*rest, F.posexplode("__queries").alias("position", "__q"), "__sources")
    scored = F.transform("__sources", lambda s, i: F.struct(L.multiset_overlap(F.col("__q.tokens"), s["tokens"]).alias("overlap"), (-i).alias("first"), s["text"].alias("text")))
    best = each.select(*rest, "position", F.col("__q.text").alias("query_sentence"), F.array_max(scored).alias("__best"))
    kept = best.where(F.col("__best.overlap") >= least)
    return kept.select(*rest, "position", "query_sentence", F.col("__best.text").alias("source_sentence"), F.col("__best.overlap").alias("overlap"), T.has_citation("query_sentence").alias("is_cited"))
