"""Bottom-k sketches of the word shingles of documents.

A sketch is the k smallest different 48-bit hashes of a text's shingles, ascending. Sketches of parts merge to
the sketch of the whole; two sketches estimate resemblance, containment and the number of different shingles.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import claim, strings, tidy
from .winnow import mixed, rolling

_SPACE = 1 << 48


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word) >> 1
        if len(word) <= 64:  # longer words are rare or junk
            if len(self) > 250_000:
                self.clear()
            self[word] = h
        return h


_hashes = _WordHashes()


def sketch(text: str | None, k: int = 128, shingle: int = 5) -> np.ndarray:
    """Bottom-k sketch of a whole text.

    Words are runs of bytes other than ASCII white space; fewer words than a shingle are one shingle together;
    without a word (null, empty) the sketch is empty.
    """
    words = (text or "").encode("utf-8", "surrogatepass").split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.int64, len(words)).astype(np.uint64)
    h = mixed(rolling(h, min(shingle, len(words))) + np.uint64(min(shingle, len(words)))) >> np.uint64(16)
    if len(h) > 8 * k:  # the least hashes hold the k least different ones, unless copies crowd them out
        least = np.unique(np.partition(h, 4 * k)[: 4 * k])
        if len(least) > k:
            return least[:k]
    return np.unique(h)[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = 128) -> np.ndarray:
    """Sketch of the union of what two sketches were made of."""
    return np.union1d(a, b)[:k]


def distinct(a: np.ndarray, k: int = 128) -> float:
    """Estimated number of different shingles; exact for fewer than k."""
    return float(len(a)) if len(a) < k else (k - 1) * _SPACE / float(a[k - 1] + 1)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = 128) -> float:
    """Estimated Jaccard similarity of the shingle sets; two empty sets are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = merge(a, b, k)
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.isin(union, both, assume_unique=True).sum()) / len(union)


def containment(a: np.ndarray, b: np.ndarray, k: int = 128) -> float:
    """Estimated share of a's shingles that b has too; 1 if a is empty."""
    if not len(a):
        return 1.0
    union = distinct(merge(a, b, k), k)
    return min(1.0, resemblance(a, b, k) * union / distinct(a, k))


def pack(a: np.ndarray) -> str:
    """A sketch as text: its hashes as six big-endian bytes each, in base 64."""
    return base64.b64encode(a.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def unpack(s: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(s), np.uint8).reshape(-1, 6)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, 2:] = raw
    return wide.view(">u8").ravel().astype(np.uint64)


@dataclass(frozen=True)
class Neighbours:
    """Documents dealt to id ranges in order, each with what its last document needs of the next range."""

    rows: DataFrame
    ranges: int


def _in_order(docs: DataFrame, text: str, key: str, range_chars: int) -> Neighbours:
    """One shuffle of compressed texts into id ranges of about ``range_chars``; a range's first document goes to
    the range before it too (to the last range, for the first of all), so that no range waits for another."""
    sizes = docs.agg(F.count("*").alias("n"), F.sum(F.length(text)).alias("chars"), F.min(key).alias("first")).first()
    ranges = max(1, min(1 << 15, (sizes["chars"] or 0) // range_chars))  # so that the bounds stay few; a larger range is streamed
    bounds = [sizes["first"]]
    if ranges > 1 and bounds[0] is not None:
        shares = [i / ranges for i in range(1, ranges)]
        bounds += docs.agg(F.percentile_approx(key, shares, max(10_000, 20 * ranges))).first()[0]
    edges = np.unique(np.array([b for b in bounds if b is not None], np.int64))
    known = docs.sparkSession.sparkContext.broadcast(edges)  # eight bytes for each range_chars of text
    n = max(1, len(edges))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=3)
        for b in batches:
            out: list[tuple] = []
            for i, t in ((i, t) for s in range(0, b.num_rows, 256) for i, t in zip(b.column(0).slice(s, 256).to_pylist(), strings(b.column(1).slice(s, 256)), strict=True)):
                body = zip_.compress(t.encode("utf-8", "surrogatepass"))
                at = n - 1 if i is None or not len(known.value) else int(np.searchsorted(known.value, i, "right")) - 1
                out.append((at, False, i, body))
                if i is None and not len(known.value):
                    out.append((n - 1, True, i, body))
                elif i is not None and known.value[at] == i:
                    out.append(((at - 1) % n, True, i, body))
            kinds = (pa.int32(), pa.bool_(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kinds[k]) for k in range(4)], ["at", "extra", "id", "body"])

    rows = docs.select(F.col(key).cast("long").alias("i"), F.col(text).alias("t")).mapInArrow(deal, "at int, extra boolean, id long, body binary")
    return Neighbours(rows.repartitionById(n, "at").sortWithinPartitions("at", "extra", F.col("id").asc_nulls_last(), "body"), n)


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", k: int = 128, shingle: int = 5, range_chars: int = 12_000_000) -> DataFrame:
    """Sketches of each text and of its edited text, and their likeness; one row per row of ``docs``.

    The edited text has its last floor(n / 4) code points replaced by the first as many (or all) of the next
    document by ascending key, after the last the first. Null text is empty. Null keys come last; rows of equal
    keys follow each other in an order that their content fixes. A single document is its own next one.
    Columns: the key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    n_shingles (estimated), edited_contained (estimated share of the text's shingles in the edited text).
    """
    dealt = _in_order(docs, text, key, range_chars)
    schema = pa.schema([(key, pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("n_shingles", pa.float64()), ("edited_contained", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("sketches", _hashes)
        unzip = zstandard.ZstdDecompressor()
        last: tuple | None = None
        done: list[tuple] = []

        def finish(next_text: str, next_sketch: np.ndarray) -> None:
            i, t, own = last
            cut = len(t) // 4
            edited = t[: len(t) - cut] + next_text[:cut]
            other = sketch(edited, k, shingle)
            done.append((i, len(t), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), pack(own), pack(other), resemblance(own, other, k), resemblance(own, next_sketch, k), distinct(own, k), containment(own, other, k)))

        for b in batches:
            for extra, i, body in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if extra and last is None:  # further rows of a key that repeats at a range's start
                    continue
                t = unzip.decompress(body).decode("utf-8", "surrogatepass")
                own = sketch(t, k, shingle)
                if last is not None:
                    finish(t, own)
                last = None if extra else (i, t, own)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
                done = []
        tidy()

    ddl = f"`{key}` long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_shingles double, edited_contained double"
    return dealt.rows.mapInArrow(run, ddl)
