"""Stylometric signs of machine-written text: indicators over Arrow batches, verdicts as native columns."""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import constants as K
from .pieces import struct_of


def _mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.size(a)


def _deviation(a: Column, mean: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(a, lambda v: (v - mean) * (v - mean)), F.lit(0.0), lambda s, v: s + v) / F.size(a))


_SPACE = " \t\n\x0b\f\r"  # \s of the JVM
_WORD = re.compile(rf"[^{_SPACE}]+")
_LETTERS = re.compile("[a-z]+")
_ENDS = re.compile("[.!?]+")
_PHRASES = K.AI_PHRASES + K.FILLER_PHRASES
INDICATORS = ("sentence_variation", "vocabulary", "phrases", "burstiness", "repetition", "uniformity")


def _trimmed(s: str) -> str:
    """As ``^\\s+|\\s+$`` deletes in the JVM, where $ is also before a last line end that \\s has not."""
    out = s.strip(_SPACE)
    return out[:-1].rstrip(_SPACE) + out[-1] if out and out[-1] in "\x85\u2028\u2029" and s[-1] == out[-1] else out


def _spread(values: list[float]) -> tuple[float, float]:
    """Mean and deviation, added up in order as the native fold does; not sum(), which compensates."""
    total = squares = 0.0
    for v in values:
        total += v
    mean = total / len(values)
    for v in values:
        squares += (v - mean) * (v - mean)
    return mean, math.sqrt(squares / len(values))


def _repeated(w: list[str]) -> float:
    grams = list(zip(w, w[1:], w[2:], strict=False))
    if len(grams) < 2 or len(set(grams)) == len(grams):
        return 0.0
    return min(1.0, sum(n > 1 for n in Counter(grams).values()) / len(grams) * 10)


def indicators(text: str | None) -> tuple:
    """The six indicators and the number of words; of a null text, what SQL's least() makes of nulls."""
    if text is None:
        return 1.0, 1.0, 1.0, 1.0, 0.0, 0.0, None
    low = text.lower()
    w = _LETTERS.findall(low)
    n_words = sum(1 for _ in _WORD.finditer(text))
    parts = [_WORD.findall(s) for s in map(_trimmed, _ENDS.split(text)) if len(s) > 10]
    variation = burst = uniform = 0.5
    if len(parts) >= 3:
        mean, deviation = _spread([float(len(s)) for s in parts])
        variation = min(1.0, deviation / mean / 0.6)
    if len(parts) >= 5:
        burst = min(1.0, _spread([sum(map(len, s)) / len(s) for s in parts])[1] / 1.5)
    vocabulary = 0.5 if len(w) < 50 else min(1.0, len(set(w)) / math.sqrt(len(w)) / 10)
    phrases = 0.0 if n_words < 50 else min(1.0, sum(p in low for p in _PHRASES) / n_words * 200)
    paragraphs = [float(len(_WORD.findall(p))) for p in map(_trimmed, text.split("\n\n")) if len(p) > 50]
    if len(paragraphs) >= 3:
        mean, deviation = _spread(paragraphs)
        uniform = 1 - min(deviation / mean, 1.0)
    return variation, vocabulary, phrases, burst, _repeated(w), uniform, n_words


def with_indicators(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the six indicators, each 0 to 1, and the number of words."""
    kinds = ", ".join(f"{name} double" for name in INDICATORS) + ", n_words int"
    d = docs.withColumn("__i", struct_of(indicators, kinds, F.col(text)))
    return d.withColumns({name: F.col(f"__i.{name}") for name in ("n_words", *INDICATORS)}).drop("__i")


#: Weight of each indicator.
WEIGHTS = {"sentence_variation": -0.2, "vocabulary": -0.15, "phrases": 0.25, "burstiness": -0.2, "repetition": 0.15, "uniformity": 0.15}


def with_verdict(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds probability, confidence and verdict; texts under 100 characters are uncertain."""
    raw = F.lit(0.5)
    for name, w in WEIGHTS.items():
        raw = raw + F.lit(w) * (F.col(name) - 0.5) * 2
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))
    values = F.array(*WEIGHTS)
    d = docs.withColumn("__v", values).withColumn("__vm", _mean(F.col("__v")))
    confidence = 0.4 * F.least(F.col("n_words") / 500.0, F.lit(1.0)) + 0.6 * (1 - F.least(2 * _deviation(F.col("__v"), F.col("__vm")), F.lit(0.5)))
    short = F.length(text) < 100
    d = d.withColumn("probability", F.when(short, 0.5).otherwise(F.round(p, 3))).withColumn("confidence", F.when(short, 0.0).otherwise(F.round(confidence, 3)))
    verdict = F.when(short, "uncertain").when(F.col("probability") >= 0.7, "likely_ai").when(F.col("probability") <= 0.3, "likely_human").otherwise("uncertain")
    return d.withColumn("verdict", verdict).drop("__v", "__vm")


def rollup(scored: DataFrame, *keys: str) -> DataFrame:
    """Mean probability by confidence; the plain mean where all confidences are 0."""
    return scored.groupBy(*keys).agg(F.coalesce(F.try_divide(F.sum(F.col("probability") * F.col("confidence")), F.sum("confidence")), F.avg("probability")).alias("probability"), F.count("*").alias("n"))
