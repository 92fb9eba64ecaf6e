"""Exact vector search: a bounded block of query vectors against all rows, in numpy, and windowed top-k."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MAX_QUERY_BYTES = 64 << 20


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; 0 if null, of zero norm or of different sizes."""
    x, y = a.cast("array<double>"), b.cast("array<double>")
    dot = F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v)) * F.sqrt(F.aggregate(y, F.lit(0.0), lambda s, v: s + v * v))
    return F.coalesce(F.when((norm > 0) & (F.size(x) == F.size(y)), dot / norm), F.lit(0.0))


def search(corpus: DataFrame, queries: DataFrame, limit: int, threshold: float, key: str = "vec_id", vector: str = "embedding", query_key: str = "query_id") -> DataFrame:
    """``(query, key, score)``: per query the ``limit`` best rows of cosine ``threshold`` or more, ties by key.

    Queries come in blocks of at most 64 MB, which the driver holds and broadcasts one after the other; each task
    keeps its own best rows, so what is shuffled is at most ``limit`` rows per task and query.
    """
    spark = corpus.sparkSession
    rows = queries.select(query_key, vector).toLocalIterator()
    out: DataFrame | None = None
    block: list[tuple] = []
    size = 0

    def run(block: list[tuple]) -> DataFrame:
        q = np.array([v for _, v in block], np.float64)
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
        shared = spark.sparkContext.broadcast(([k for k, _ in block], q))

        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names, q = shared.value
            for b in batches:
                b = b[b[vector].notna()]
                if not len(b):
                    continue
                x = np.stack(b[vector].to_list()).astype(np.float64)
                x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
                s = q @ x.T
                ids = b[key].to_numpy()
                for name, line in zip(names, s, strict=True):
                    hit = np.flatnonzero(line >= threshold)
                    best = hit[np.lexsort((ids[hit], -line[hit]))[:limit]]
                    if len(best):
                        yield pd.DataFrame({"q": name, "k": ids[best], "score": line[best]})

        return corpus.select(key, vector).mapInPandas(score, "q long, k long, score double")

    for r in rows:
        if r[1] is not None:
            block.append((r[0], r[1]))
            size += 8 * len(r[1])
        if size >= MAX_QUERY_BYTES:
            out = run(block) if out is None else out.unionByName(run(block))
            block, size = [], 0
    if block or out is None:
        out = run(block or [(-1, [0.0])]) if out is None else out.unionByName(run(block))
    w = W.partitionBy("q").orderBy(F.desc("score"), "k")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select(F.col("q").alias(query_key), F.col("k").alias(key), "score", "rank")


def payload_filter(**conditions) -> Column:
    """All conditions at once: a list means any of its values, anything else equality."""
    out = F.lit(True)
    for name, value in conditions.items():
        out = out & (F.col(name).isin(list(value)) if isinstance(value, (list, tuple, set)) else F.col(name) == F.lit(value))
    return out


def upsert(existing: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """``existing`` with the points of ``batch`` added or in place of those of the same key; columns are by name."""
    return existing.join(batch.select(key), key, "left_anti").unionByName(batch)


def delete(points: DataFrame, which: Column) -> DataFrame:
    """Points for which ``which`` isn't true."""
    return points.where(~F.coalesce(which, F.lit(False)))


def points(stored: DataFrame, wanted: DataFrame, key: str, *columns: str) -> DataFrame:
    """Each wanted key with whether it is stored, and its columns."""
    own = stored.select(key, *columns, F.lit(True).alias("there"))
    return wanted.join(own, key, "left").withColumn("there", F.coalesce("there", F.lit(False))).select(key, "there", *columns)
