"""Near-duplicate vectors by random-hyperplane sign hashing in several tables, with exact cosines.

A table's key is the signs of a vector against a few random hyperplanes; vectors of cosine c agree on one with
probability 1 - arccos(c) / pi. The key length follows log2 of the number of vectors, so buckets stay small, and
the number of tables is what the wanted recall at the threshold takes. Equal vectors are one node with a count.

Only keys, ids and 128 more signs of each vector are dealt to all tables. In a bucket the signs say who can be near
to whom; the few vectors that have such a partner are then fetched, dealt to their buckets again, and compared
exactly, in double precision. A pair that meets in several tables counts in the first. A bucket of many vectors is
cut to blocks, and every pair of blocks is a task's unit of its own. What leaves a bucket is one row per vector:
how many links it has there, and its group's smallest id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import connected_components
from .shared import cut, tidy, units_of

_SIGNS = 128


def shape(n: int, threshold: float, recall: float, bucket: int = 64) -> tuple[int, int]:
    """Hyperplanes per table and tables for n vectors, at ``bucket`` unrelated vectors in a bucket."""
    bits = max(6, min(40, round(math.log2(max(n, 2) / bucket))))
    meet = (1 - math.acos(min(1.0, threshold)) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log1p(-meet)))


def most_differing(threshold: float) -> int:
    """How many of the 128 signs may differ between vectors at the threshold: five deviations over the mean."""
    p = math.acos(min(1.0, threshold)) / math.pi
    return math.ceil(_SIGNS * p + 5 * math.sqrt(_SIGNS * p * (1 - p)))


def planes(dim: int, bits: int, tables: int, seed: int = 17) -> np.ndarray:
    return np.random.default_rng([seed, dim, bits, tables]).standard_normal((dim, bits * tables))


def keys_of(x: np.ndarray, bits: int, tables: int, seed: int = 17) -> np.ndarray:
    """(rows, tables) keys of the rows of x."""
    out = np.zeros((len(x), tables), np.int64)
    for at in range(0, len(x), 512):
        signs = (x[at : at + 512] @ planes(x.shape[1], bits, tables, seed) > 0).reshape(-1, tables, bits)
        out[at : at + 512] = (signs * (np.int64(1) << np.arange(bits, dtype=np.int64))).sum(2)
    return out


def signs_of(x: np.ndarray) -> np.ndarray:
    """128 further signs of each row of x, as two unsigned integers."""
    signs = x @ np.random.default_rng([29, x.shape[1]]).standard_normal((x.shape[1], _SIGNS)) > 0
    return np.packbits(signs, axis=1).view(np.uint64)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _usable(column: pa.Array, kind: type) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each dimension: lists without null or non-finite components and with one that isn't zero."""
    sizes = np.asarray(pc.list_value_length(column).fill_null(0))
    for dim in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == dim)
        own = column.take(pa.array(rows)).flatten()
        x = np.asarray(own.fill_null(np.nan), kind).reshape(len(rows), dim)
        good = np.isfinite(x).all(1) & (x != 0).any(1)
        if good.any():
            yield rows[good], x[good] + kind(0)  # the sum turns -0.0 to 0.0


def _labels(link: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Smallest id that each row reaches over the links of this block."""
    lab = ids.copy()
    top = np.iinfo(np.int64).max
    while True:
        new = np.minimum(lab, np.where(link, lab[None, :], top).min(1))
        if (new == lab).all():
            return lab
        lab = new


def _near(signs: np.ndarray, side: np.ndarray, most: int) -> np.ndarray:
    """Which rows of a bucket (or pair of blocks) can be near to which, by their signs."""
    near = sum(np.bitwise_count(s[:, None] ^ s[None, :]) for s in signs.T) <= most
    if side.any():  # a pair of different blocks: only links across
        near &= side[:, None] != side[None, :]
    np.fill_diagonal(near, False)
    return near


def _linked(ids: np.ndarray, copies: np.ndarray, side: np.ndarray, x: np.ndarray, table: int, bits: int, tables: int, threshold: float, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, links first met here, smallest id reached here) of the linked rows of a bucket, or of a pair of its blocks."""
    link = _near(signs_of(x), side, most)
    link &= x @ x.T >= threshold
    near = np.flatnonzero(link.any(1))
    link, own = link[np.ix_(near, near)], ids[near]
    fresh = link
    if table and len(near):
        earlier = keys_of(x[near], bits, tables)[:, :table]
        fresh = link.copy()
        for t in range(table):
            fresh &= earlier[:, t][:, None] != earlier[:, t][None, :]
    return own, fresh @ copies[near], _labels(link, own) if len(near) else own


def _dealt(rows: DataFrame, block: int, label: str) -> tuple[DataFrame, list[str]]:
    """``rows(key, id, ...)`` dealt and sorted by bucket; a bucket of over ``block`` rows as pairs of blocks."""
    hot = cut(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block).select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks")), label)
    cols = ["key", "a", "b"]
    rest = [c for c in rows.columns if c != "key"]
    if hot.limit(1).count():
        own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
        pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(j, F.col("own")).alias("a"), F.greatest(j, F.col("own")).alias("b")))
        out = rows.join(hot, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", own).withColumn("p", F.explode(pairs))
        side = F.when(F.col("p.a") == F.col("p.b"), 0).when(F.col("own") == F.col("p.a"), 1).otherwise(2)
        out = out.select("key", F.col("p.a").alias("a"), F.col("p.b").alias("b"), side.alias("side"), *rest)
    else:
        out = rows.select("key", F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("side"), *rest)
    return out.repartition(*cols).sortWithinPartitions(*cols), cols


class Nodes:
    """Different vectors, each under the smallest id that has it: ``vectors`` (id, copies, dim, body), ``members`` (id, content)."""

    def __init__(self, source: DataFrame, vector: str, key: str):
        element = source.schema[vector].dataType.elementType
        self.kind: type = np.float32 if isinstance(element, T.FloatType) else np.float64
        kind = self.kind
        rows = source.select(F.col(key).cast("long").alias("i"), F.col(vector) if isinstance(element, T.FloatType | T.DoubleType) else F.col(vector).cast("array<double>"))

        def hashed(with_body: bool):
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in (whole.slice(k, 2048) for whole in batches for k in range(0, whole.num_rows, 2048)):
                    b = b.filter(b.column(0).is_valid())
                    for at, x in _usable(b.column(1), kind):
                        bodies = [r.tobytes() for r in x]
                        contents = pa.array([blake2b(r, digest_size=16).digest() for r in bodies], pa.binary())
                        if with_body:
                            yield pa.RecordBatch.from_arrays([contents, pa.array([x.shape[1]] * len(x), pa.int32()), pa.array(bodies, pa.binary())], ["content", "dim", "body"])
                        else:
                            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), contents], ["id", "content"])
                tidy()

            return run

        self.members = cut(rows.mapInArrow(hashed(False), "id long, content binary").groupBy("id").agg(F.min("content").alias("content")), "members")
        self.least = self.members.groupBy("content").agg(F.min("id").alias("node"), F.count("*").alias("copies"))
        bodies = rows.mapInArrow(hashed(True), "content binary, dim int, body binary").groupBy("content").agg(F.first("dim").alias("dim"), F.first("body").alias("body"))
        self.vectors = cut(bodies.join(self.least, "content").select(F.col("node").alias("id"), "copies", "dim", "body"), "vectors")


def embedding_links(nodes: Nodes, threshold: float = 0.95, recall: float = 0.999, block: int = 1024) -> DataFrame:
    """``(id, n, low)``: links of each node by bucket, each pair in one bucket only, and the smallest id reached there."""
    kind = nodes.kind
    bits, tables = shape(nodes.vectors.count(), threshold, recall)
    most = most_differing(threshold)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(k, 4096) for whole in batches for k in range(0, whole.num_rows, 4096)):
            dims = np.asarray(b.column(1))
            for dim in np.unique(dims).tolist():
                own = b.filter(pa.array(dims == dim))
                x = _unit(np.frombuffer(b"".join(own.column(2).to_pylist()), kind).reshape(own.num_rows, dim))
                keys, signs = keys_of(x, bits, tables), [pa.array(s) for s in np.ascontiguousarray(signs_of(x).view(np.int64).T)]
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays([pa.array(keys[:, t] + (np.int64(dim * tables + t) << bits)), own.column(0), *signs], ["key", "id", "s", "t"])
        tidy()

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in units_of(batches):
            if b.num_rows > 1:
                signs = np.stack([np.asarray(b.column(k)).view(np.uint64) for k in (5, 6)], 1)
                found = _near(signs, np.asarray(b.column(3)), most).any(1)
                if found.any():
                    yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(found)), b.column(4).filter(pa.array(found))], ["key", "id"])
        tidy()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in units_of(batches):
            if b.num_rows > 1:
                key = b.column(0)[0].as_py()
                dim, table = divmod(key >> bits, tables)
                x = _unit(np.frombuffer(b"".join(b.column(6).to_pylist()), kind).reshape(b.num_rows, dim))
                found = _linked(np.asarray(b.column(4)), np.asarray(b.column(5)), np.asarray(b.column(3)), x, table, bits, tables, threshold, most)
                yield pa.RecordBatch.from_arrays([pa.array(f, pa.int64()) for f in found], ["id", "n", "low"])
        tidy()

    placed = nodes.vectors.select("id", "dim", "body").mapInArrow(spread, "key long, id long, s long, t long")
    rows, _ = _dealt(placed, 2 * block, "hot-buckets")
    met = cut(rows.mapInArrow(candidates, "key long, id long").distinct(), "met")
    full = met.join(nodes.vectors.select("id", "copies", "body"), "id").select("key", "id", "copies", "body")
    rows, _ = _dealt(full, block, "hot-vectors")
    return rows.mapInArrow(verify, "id long, n long, low long")


def embedding_components(vectors: DataFrame, threshold: float = 0.95, recall: float = 0.999, block: int = 1024, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """One row per key: the key, n_links (vectors at the threshold or above), component_id, kept.

    Vectors that are null, empty or zero, or hold null or non-finite components, and rows with a null key, link
    with nothing; vectors of different dimensions don't either. Rows that repeat a key are one vector (of its
    usable ones, that of the least content hash). Equal vectors link with each other and have the same other links.
    Other columns are not read. An empty table gives an empty table.
    """
    nodes = Nodes(vectors, vector, key)
    links = cut(embedding_links(nodes, threshold, recall, block), "links")
    counts = links.groupBy("id").agg(F.sum("n").alias("links"))
    groups = connected_components(links.select(F.col("id").alias("a"), F.col("low").alias("b")))
    of_node = nodes.least.join(counts.withColumnRenamed("id", "node"), "node", "left").join(groups, "node", "left")
    of_node = of_node.select("content", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "node").alias("component"))
    known = nodes.members.join(of_node, "content").select("id", "links", "component")
    ids = vectors.select(F.col(key).cast("long").alias("id")).distinct()
    out = ids.join(known, "id", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(key), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"))
