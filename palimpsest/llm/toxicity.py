"""Toxicity by a support vector machine over a gap-weighted subsequence kernel with Nystroem landmarks.

K(s, t) sums, over all subsequences of three letters, lambda ** (span in s + span in t), so a gapped or padded
spelling keeps most of a word's similarity. Landmarks are short spans of labelled sentences; the machine is
linear in the Nystroem map of a span's kernel values with them. As every landmark has an explicit (sparse)
subsequence vector, the trained machine folds to one weight per three-letter subsequence: a span's margin is a
sum over its own subsequences divided by its own norm, with no landmark loop when whole corpora are scored.
Labels are of texts, so training goes in rounds: spans that toxic texts hold and clean ones hardly do give a first
machine, whose two highest spans of every labelled text, under the text's label, train the next, twice. A text's score
comes from its two highest margins and its number of different words, as long texts hold odd words by chance.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import claim, tidy

SYMBOLS = 31  # 0: a gap; 1-26: a-z; 27: a word begins; 28-30: other letters
_BEGIN = b"\x1b"
_DECAY = 0.7
_WINDOW, _STRIDE = 12, 3
#: Characters often written for a letter.
_FOLDS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
_AROUND = ".,;:!?\"'()*&%#|"
_SPACED = re.compile(r"(?:\s\S){4,}(?!\S)")
_LOWEST, _HIGHEST = -1.0, 1.5  # margins count up to here, so that one odd span decides nothing alone


@dataclass(frozen=True)
class ToxicityModel:
    weights: np.ndarray | None  # per subsequence; None: nothing was learnt
    bias: float
    slopes: tuple[float, float, float] = (0.0, 0.0, 0.0)  # of both margins and the logarithm of the different words
    offset: float = 0.0


class _Symbols(dict):
    def __missing__(self, code: int) -> str:
        c = _FOLDS.get(chr(code), chr(code))
        s = ord(c) - 96 if "a" <= c <= "z" else 28 + code % 3 if c.isalpha() else 0
        self[code] = chr(s)
        return self[code]


_symbols = _Symbols()


def _spans(word: str) -> list[bytes]:
    """A word's symbols after the mark of its beginning; a long word as overlapping windows."""
    s = _BEGIN + word.translate(_symbols).encode("latin-1").strip(b"\0")
    if len(s) <= _WINDOW + 1:
        return [s]
    return [s[k : k + _WINDOW] for k in range(0, len(s) - _WINDOW + _STRIDE, _STRIDE)]


def words_of(text: str | None) -> list[str]:
    """Lower-cased words, and letters that were written apart ("a b c d") joined to one more word."""
    low = (text or "").lower()
    out = low.split()
    return out + ["".join(m.group().split()) for m in _SPACED.finditer(" " + low)]


def _different(text: str | None) -> set[str]:
    """A text's different words without the marks around them, which are gaps to the kernel."""
    return {w.strip(_AROUND) for w in set(words_of(text))} - {""}


def _triples(n: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.array(list(combinations(range(n), 3)), np.int64).reshape(-1, 3)
    return at, _DECAY ** (at[:, 2] - at[:, 0] + 1.0)


def _codes(block: np.ndarray, at: np.ndarray) -> np.ndarray:
    a, b, c = (block[:, at[:, k]].astype(np.int32) for k in range(3))
    code = (a * SYMBOLS + b) * SYMBOLS + c
    code[(a == 0) | (b == 0) | (c == 0)] = 0
    return code


def _self_kernel(block: np.ndarray) -> np.ndarray:
    """K(s, s) of each row, exactly, by the two-dimensional recursion over its positions."""
    same = (block[:, :, None] == block[:, None, :]) & (block[:, :, None] > 0)
    d = same * _DECAY**2
    n = block.shape[1]
    for _ in range(2):
        p = np.zeros_like(d)
        for i in range(1, n):
            p[:, i] = _DECAY * (p[:, i - 1] + d[:, i - 1])
        s = np.zeros_like(d)
        for i in range(1, n):
            s[:, :, i] = _DECAY * (s[:, :, i - 1] + p[:, :, i - 1])
        d = same * s
    return d.sum((1, 2))


def _by_length(spans: list[bytes]) -> Iterator[tuple[list[int], np.ndarray]]:
    groups: dict[int, list[int]] = {}
    for k, s in enumerate(spans):
        groups.setdefault(len(s), []).append(k)
    for n, rows in groups.items():
        for at in range(0, len(rows), 4096):
            own = rows[at : at + 4096]
            yield own, np.frombuffer(b"".join(spans[k] for k in own), np.uint8).reshape(len(own), n)


def span_margins(model_weights: np.ndarray, bias: float, spans: list[bytes]) -> np.ndarray:
    out = np.full(len(spans), bias)
    for own, block in _by_length(spans):
        if block.shape[1] < 3:
            continue
        at, decay = _triples(block.shape[1])
        raw = (model_weights[_codes(block, at)] * decay).sum(1)
        out[own] += raw / np.sqrt(np.maximum(_self_kernel(block), 1e-12))
    return out


def subsequence_vectors(spans: list[bytes]) -> np.ndarray:
    """Normalised explicit vectors of a few spans (landmarks)."""
    out = np.zeros((len(spans), SYMBOLS**3))
    for own, block in _by_length(spans):
        if block.shape[1] >= 3:
            at, decay = _triples(block.shape[1])
            for k, code in zip(own, _codes(block, at), strict=True):
                np.add.at(out[k], code, decay)
    out[:, 0] = 0
    out /= np.maximum(np.sqrt(np.einsum("ij,ij->i", out, out))[:, None], 1e-12)  # in place: rows are long
    return out


def _kernel(spans: list[bytes], z: np.ndarray) -> np.ndarray:
    """Normalised kernel values of spans with the landmark vectors z, a block of spans at a time."""
    out = np.empty((len(spans), len(z)))
    for k in range(0, len(spans), 64):
        out[k : k + 64] = subsequence_vectors(spans[k : k + 64]) @ z.T
    return out


@dataclass(frozen=True)
class _Landmarks:
    """Landmark vectors, and the root that makes kernel values with them the Nystroem features."""

    z: np.ndarray
    root: np.ndarray

    def features(self, spans: list[bytes]) -> np.ndarray:
        return _kernel(spans, self.z) @ self.root

    def folded(self, w: np.ndarray) -> np.ndarray:
        """The weight of each subsequence in a machine that is linear in the features."""
        out = self.z.T @ (self.root @ w)
        out[0] = 0
        return out


def _variants(words: list[str]) -> list[bytes]:
    """Spans of words, padded at one place and everywhere."""
    marks = "._*x-"
    padded = [w[:k] + marks[(k + j) % 5] + w[k:] for j, w in enumerate(words) for k in range(1, len(w), 2)]
    spaced = ["".join(c + marks[j % 3] for c in w) for j, w in enumerate(words)]
    return [_spans(w)[0] for w in words + padded + spaced]


def _landmarks(positive: list[str], negative: list[bytes], landmarks: int) -> _Landmarks:
    """Up to half of the landmarks from positive words, best supported first; the rest half near to them, half spread."""
    pv = subsequence_vectors([_spans(w)[0] for w in positive[: landmarks // 2]])
    hard = np.argsort(-_kernel(negative, pv).max(1), kind="stable")[: (landmarks - len(pv)) // 2]
    easy = np.linspace(0, len(negative) - 1, min(len(negative), max(1, landmarks - len(pv) - len(hard)))).astype(int)
    z = np.concatenate((pv, subsequence_vectors([negative[k] for k in np.unique(np.concatenate((hard, easy)))])))
    val, vec = np.linalg.eigh(z @ z.T)
    keep = val > 1e-6
    return _Landmarks(z, vec[:, keep] / np.sqrt(val[keep]))


def _train(x: np.ndarray, y: np.ndarray, cost: np.ndarray, at: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Squared-hinge linear machine on features x, labels 1 and -1, and the cost of each row, by Newton steps.

    With ``at``, the k-th label and cost are those of row ``at[k]`` of x. The driver holds x once: rows are copied a block at a time.
    """
    at = np.arange(len(x)) if at is None else at
    cost = cost / cost.sum()
    ridge = np.diag([*np.full(x.shape[1], 1e-5), 1e-9])
    w = np.zeros(x.shape[1] + 1)

    def margins(v: np.ndarray) -> np.ndarray:
        return y * (x @ v[:-1] + v[-1])[at]

    for _ in range(40):
        short = np.flatnonzero((margins(w) < 1) & (cost > 0))
        left, right = ridge.copy(), np.zeros(len(w))
        for k in range(0, len(short), 1024):
            rows = short[k : k + 1024]
            part = np.column_stack((x[at[rows]], np.ones(len(rows))))
            own = part * cost[rows, None]
            left += own.T @ part
            right += own.T @ y[rows]
        new = np.linalg.solve(left, right)
        loss = [float(0.5 * v @ ridge @ v + 0.5 * cost @ np.maximum(0, 1 - margins(v)) ** 2) for v in (w + t * (new - w) for t in (1, 0.5, 0.25, 0.1, 0.02, 0))]
        t = (1, 0.5, 0.25, 0.1, 0.02, 0)[int(np.argmin(loss))]
        if not t:  # no step lowers it
            break
        w = w + t * (new - w)
    return w[:-1], float(w[-1])


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slopes and, last, offset of P(label 1 | columns of x), with a weak pull that keeps them finite."""
    x = np.column_stack((x, np.ones(len(x))))
    c = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        v = p * (1 - p) + 1e-9
        c = c - np.clip(np.linalg.solve(x.T @ (v[:, None] * x) + 0.01 * np.eye(len(c)), x.T @ (p - y) + 0.01 * c), -2, 2)
    return c


_margins: dict[str, float] = {}  # highest span margin of each word under the model of ``_margins_of``
_margins_of: list = [None]


def _learn(model: ToxicityModel, words: list[str], cache: dict) -> None:
    for at in range(0, len(words), 20_000):
        part = words[at : at + 20_000]
        spans = [_spans(w) for w in part]
        m = span_margins(model.weights, model.bias, [s for own in spans for s in own])
        starts = np.cumsum([0, *map(len, spans)][:-1])
        cache.update(zip(part, np.maximum.reduceat(m, starts).tolist(), strict=True))


def text_features(model: ToxicityModel, texts: list[str | None], cache: dict) -> np.ndarray:
    """The two highest margins over a text's different words, and the logarithm of the number of those."""
    if len(texts) > 200:  # a block may hold ten thousand texts
        return np.concatenate([text_features(model, texts[k : k + 200], cache) for k in range(0, len(texts), 200)])
    sets = [_different(t) for t in texts]
    if len(cache) > 250_000:
        cache.clear()
    _learn(model, list({w for s in sets for w in s if w not in cache}), cache)
    out = np.full((len(texts), 3), _LOWEST)
    for row, s in zip(out, sets, strict=True):
        row[2] = np.log1p(len(s))
        m = np.fromiter(map(cache.__getitem__, s), float, len(s))
        if len(m) > 1:
            row[0], row[1] = m.max(), np.partition(m, -2)[-2]
        elif len(m):
            row[0] = m[0]
    out[:, :2] = np.clip(out[:, :2], _LOWEST, _HIGHEST)
    for w in {w for s in sets for w in s if len(w) > 64}:  # not worth their room
        cache.pop(w, None)
    return out


def probabilities(model: ToxicityModel, features: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(features @ np.array(model.slopes) + model.offset, -30, 30)))


def _highest_spans(model: ToxicityModel, text: str | None, cache: dict) -> list[bytes]:
    """The best span of each of a text's two best words."""
    words = _different(text)
    _learn(model, [w for w in words if w not in cache], cache)
    best = []
    for w in sorted(words, key=lambda w: (-cache[w], w))[:2]:
        spans = _spans(w)
        best.append(spans[int(span_margins(model.weights, model.bias, spans).argmax())])
    return best


def fit(docs: DataFrame, labels: DataFrame, eligible: Column | None = None, max_rows: int = 16_000, landmarks: int = 240, max_words: int = 400, clean_words: int = 2500, letters: tuple[int, int] = (3, 24), text: str = "text", key: str = "doc_id", target: str = "toxic") -> ToxicityModel:
    """Learn from at most about ``max_rows`` labelled rows (the documented bound: those of lowest hashed key).

    Rows of ``labels`` with a null key or label, or for which ``eligible`` isn't true, are never used. A span
    is a positive example of the first round if at least three toxic sample texts and hardly a clean one hold it, more than chance allows
    (the ``max_words`` best supported ones, of ``letters[0]`` to ``letters[1]`` characters), and ``clean_words`` of those that
    clean texts hold, by hash, are the negative ones. Of the rounds after it every span of the sample's texts can be
    an example, of any length: the two highest of each text. Without any such span nothing is learnt and every score is 0.
    """
    spark = docs.sparkSession
    own = labels.where(F.col(target).isNotNull() & F.col(key).isNotNull() & (eligible if eligible is not None else F.lit(True))).select(F.col(key).alias("k"), (F.col(target) > 0).alias("y")).distinct()
    n = own.count()
    sample = own.where(F.pmod(F.xxhash64(F.col("k").cast("string")), F.lit(1 << 62)) < min(1 << 62, (1 << 62) * max_rows // max(n, 1) + 1))
    # The sample is bounded by max_rows, so it may be broadcast and its texts' words counted at once.
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.col("t").isNotNull()).join(F.broadcast(sample), "k")

    def words(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in (b[k : k + 200] for b in blocks for k in range(0, len(b), 200)):
            out = [(w, bool(y)) for t, y in zip(block.t, block.y, strict=True) for w in _different(t) if letters[0] <= len(w) <= letters[1]]
            yield pd.DataFrame(out, columns=["w", "y"])

    counted = rows.mapInPandas(words, "w string, y boolean").groupBy("w").agg(F.count_if("y").alias("n1"), F.count_if(~F.col("y")).alias("n0")).where("n1 + n0 >= 3").persist()
    rate = sample.agg(F.avg(F.col("y").cast("double"))).first()[0] or 0.0
    held = counted.count()
    ranked = [(r["w"], r["n1"], r["n0"]) for r in counted.where("n1 >= 3 and n0 <= 0.1 * n1").orderBy(F.desc("n1"), "w").limit(max_words).collect()]
    toxic = _beyond_chance(ranked, rate, held)
    clean = [r["w"] for r in counted.where("n0 >= 3 and n1 <= 0.4 * n0").orderBy(F.xxhash64("w"), "w").limit(clean_words).collect()]
    counted.unpersist()
    if not toxic or not clean:
        return ToxicityModel(None, 0.0)
    neg = [x for w in clean for x in _spans(w)]
    pos = _variants(toxic)
    basis = _landmarks(toxic, neg, landmarks)
    y = np.concatenate((np.ones(len(pos)), -np.ones(len(neg))))
    w, b = _train(basis.features(pos + neg), y, np.where(y > 0, 1 / len(pos), 1 / len(neg)))
    raw = ToxicityModel(basis.folded(w), b)
    # Texts of label 1 and 0 that hold a toxic word, or had a span on top.
    own = {_spans(w)[0]: np.array((n1, n0)) for w, n1, n0 in reversed(ranked) if w in set(toxic)}
    for _ in range(2):
        before = spark.sparkContext.broadcast(raw)

        def highest(blocks: Iterator[pd.DataFrame], before=before) -> Iterator[pd.DataFrame]:
            cache: dict = {}
            for block in blocks:
                out = [(x, bool(y)) for t, y in zip(block.t, block.y, strict=True) for x in _highest_spans(before.value, t, cache)]
                yield pd.DataFrame(out, columns=["s", "y"])

        # At most two spans of a dozen letters for each of max_rows texts.
        for s, n1, n0 in rows.mapInPandas(highest, "s binary, y boolean").groupBy("s").agg(F.count_if("y"), F.count_if(~F.col("y"))).collect():
            own[bytes(s)] = np.maximum(own.get(bytes(s), 0), (n1, n0))
        spans = sorted(own)
        x = basis.features(spans + pos + neg)
        n1, n0 = np.array([own[s] for s in spans], float).T
        some = 0.3 * n1.sum() / len(pos) * np.ones(len(pos))  # padded spellings, so that none is unlearnt
        rest = n0.sum() / len(neg) * np.ones(len(neg))
        y = np.concatenate((np.ones(len(spans)), -np.ones(len(spans)), np.ones(len(pos)), -np.ones(len(neg))))
        at = np.concatenate((np.arange(len(spans)), np.arange(len(x))))
        w, b = _train(x, y, np.concatenate((n1, n0, some, rest)), at)
        raw = ToxicityModel(basis.folded(w), b)
        del x
    del basis
    tidy()
    shared = spark.sparkContext.broadcast(raw)

    def features(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict = {}
        for block in blocks:
            f = text_features(shared.value, list(block.t), cache)
            yield pd.DataFrame({"a": f[:, 0], "b": f[:, 1], "c": f[:, 2], "y": block.y.astype(float)})

    seen = rows.mapInPandas(features, "a double, b double, c double, y double").toPandas().to_numpy()  # at most max_rows rows of numbers
    x, y = seen[:, :3], seen[:, 3]
    shown = (y == 0) | (x[:, 0] > -0.5)  # a toxic text whose spans weren't learnt says nothing about what a margin means
    *slopes, offset = map(float, _logistic(x[shown], y[shown]))
    return ToxicityModel(raw.weights, raw.bias, tuple(slopes), offset)


def _beyond_chance(ranked: list[tuple[str, int, int]], rate: float, candidates: int) -> list[str]:
    """Spans that, at the rate of toxic texts, fewer than one is expected to show by chance.

    In samples too small for that, the best supported spans.
    """
    sure = [w for w, n1, n0 in ranked if candidates * comb(n1 + n0, n0) * rate**n1 < 1]
    return sure or [w for w, n1, _ in ranked if n1 == ranked[0][1]]


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", score_as: str = "toxicity") -> DataFrame:
    """Append the toxicity (0 to 1, higher is likelier toxic) of every whole text; no other column is read.

    Null and empty texts get the score of the lowest margins. A column of that name is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(blocks: Iterator[pd.Series]) -> Iterator[pd.Series]:
        claim("toxicity", _margins)
        m, cache = shared.value, _margins
        if m is not _margins_of[0]:
            cache.clear()
            _margins_of[0] = m
        for block in blocks:
            if m.weights is None:
                yield pd.Series(np.zeros(len(block)))
            else:
                yield pd.Series(probabilities(m, text_features(m, list(block), cache)))
        tidy()

    return docs.withColumn(score_as, of.asNondeterministic()(F.col(text)))
