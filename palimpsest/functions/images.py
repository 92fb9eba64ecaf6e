"""Comparison of image features: hashes, text regions, histograms, moments and combined scores, native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ORIENTATIONS = ("0", "90", "180", "270", "flip_h", "flip_v")
FIGURE_WEIGHTS = {"hash": 0.25, "cnn": 0.40, "ocr": 0.15, "structure": 0.20}
TABLE_WEIGHTS = {"hash": 0.10, "cnn": 0.15, "ocr": 0.55, "structure": 0.20}


def _blocks(h: Column, width: Column) -> Column:
    """Hexadecimal digits, padded with zeros in front, as numbers of 15 digits each."""
    padded = F.lpad(F.lower(h), F.ceil(width / 15).cast("int") * 15, "0")
    return F.transform(F.sequence(F.lit(0), F.ceil(width / 15).cast("int") - 1), lambda i: F.conv(F.substring(padded, i * 15 + 1, F.lit(15)), 16, 10).cast("long"))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two hexadecimal hashes of any width; 64 if one is missing. Both are padded to the wider."""
    width = F.greatest(F.length(a), F.length(b), F.lit(1))
    bits = F.aggregate(F.zip_with(_blocks(a, width), _blocks(b, width), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, v: s + v)
    return F.when((F.length(a) > 0) & (F.length(b) > 0), bits).otherwise(64)


def hash_similarity(a: Column, b: Column) -> Column:
    """1 - differing share of the wider hash's bits (at least 64)."""
    return F.greatest(F.lit(0.0), 1 - hamming(a, b) / F.greatest(F.lit(64), 4 * F.greatest(F.length(a), F.length(b))))


def best_orientation(query: Column, stored: Column) -> Column:
    """(distance, orientation) of the stored orientation hash (a map) nearest to the query's."""
    return F.array_min(F.transform(F.map_entries(stored), lambda e: F.struct(hamming(query, e["value"]).alias("distance"), e["key"].alias("orientation"))))


def ocr_similarity(a: Column, b: Column) -> Column:
    """Mean of Jaccard and containment in the smaller of two sets of trimmed, lower-cased texts."""
    x, y = (F.filter(F.array_distinct(F.transform(c, lambda s: F.lower(F.trim(s)))), lambda s: F.length(s) > 0) for c in (a, b))
    both = F.size(F.array_intersect(x, y)).cast("double")
    return F.when((F.size(x) > 0) & (F.size(y) > 0), (both / F.size(F.array_union(x, y)) + both / F.least(F.size(x), F.size(y))) / 2).otherwise(0.0)


def histogram_similarity(a: Column, b: Column) -> Column:
    shared = F.aggregate(F.zip_with(a, b, lambda x, y: F.least(x, y)), F.lit(0.0), lambda s, v: s + v)
    return shared / (F.aggregate(a, F.lit(0.0), lambda s, v: s + v) + 1e-8)


def moment_similarity(a: Column, b: Column) -> Column:
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, v: s + v * v))
    apart = F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))
    return F.coalesce(F.when(F.greatest(norm(a), norm(b)) > 0, F.greatest(F.lit(0.0), 1 - apart / F.greatest(norm(a), norm(b)))), F.lit(0.0))


def combined(hash_: Column, cnn: Column, ocr: Column, structure: Column, is_table: Column) -> Column:
    """Weighted mean over the features that are there (not null), by the weights of figures or tables."""
    num, den = F.lit(0.0), F.lit(0.0)
    for name, value in (("hash", hash_), ("cnn", cnn), ("ocr", ocr), ("structure", structure)):
        w = F.when(is_table, TABLE_WEIGHTS[name]).otherwise(FIGURE_WEIGHTS[name])
        num, den = num + F.coalesce(w * value, F.lit(0.0)), den + F.when(value.isNotNull(), w).otherwise(0.0)
    return F.coalesce(F.try_divide(num, den), F.lit(0.0))


def match_type(score: Column) -> Column:
    return F.when(score >= 0.99, "EXACT_DUPLICATE").when(score >= 0.95, "NEAR_DUPLICATE").when(score >= 0.85, "HIGH_SIMILARITY").when(score >= 0.75, "MODERATE_SIMILARITY").otherwise("LOW_SIMILARITY")


def accepted(score: Column, hash_: Column, ocr: Column, is_table: Column) -> Column:
    return (score >= 0.90) & ((score >= 0.98) | (hash_ >= 0.15) | (is_table & (ocr >= 0.30)))


def suspicious(score: Column, distance: Column, cnn: Column) -> Column:
    return (score > 0.75) | (distance < 10) | (cnn > 0.85)


def image_score(exact: Column, strong: Column) -> Column:
    """Document score from the numbers of exact copies and of matches over 0.85."""
    return F.when(exact > 0, F.least(F.lit(1.0), 0.5 + 0.15 * exact)).otherwise(F.least(F.lit(1.0), 0.2 * strong))


def table_score(cnn: Column, ocr: Column) -> Column:
    """Live score of tables with text on both sides: little shared text pulls it down."""
    return F.when(ocr < 0.1, 0.3 * cnn).otherwise(0.3 * cnn + 0.7 * ocr)
