"""Language identification: multinomial naive Bayes over hashed character n-grams.

The log-probability matrix (buckets x languages, a few MB whatever the corpus) is broadcast; texts are
scored in numpy as a sparse (text, bucket) matrix times that matrix, a block of characters at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import claim, free_name, tidy

UNKNOWN = "und"
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BLOCK = 1 << 18


@dataclass(frozen=True)
class LanguageModel:
    labels: tuple[str, ...]
    log_prob: np.ndarray  # (1 << bits, labels), float32
    log_prior: np.ndarray
    bits: int
    orders: tuple[int, ...]


def _codes(text: str) -> np.ndarray:
    """Code points of the lower-cased text in which whatever isn't a letter is a space."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    odd = (c < 97) | ((c > 122) & (c < 170)) | (c == 215) | (c == 247)
    return np.where(odd, np.uint32(32), c)


def _buckets(c: np.ndarray, orders: tuple[int, ...], bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """(order, bucket of the n-gram that starts at each position); n-grams without a letter are in bucket 0."""
    wide = c.astype(np.uint64)
    h, n = np.zeros(len(c), np.uint64), 0
    for order in range(1, max(orders) + 1):
        size = len(c) - order + 1
        if size <= 0:
            return
        h = h[:size] * np.uint64(1_000_003) + wide[order - 1 :]
        n += 1
        if order in orders:
            x = ((h + np.uint64(order << 40)) * _MIX) >> np.uint64(64 - bits)
            yield order, x.astype(np.int32)


def _has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def score_texts(model: LanguageModel, texts: list[str]) -> tuple[list[str], np.ndarray]:
    """Label and posterior probability of every whole text; ``und`` and 0 for a text without a letter."""
    best, prob = [UNKNOWN] * len(texts), np.zeros(len(texts))
    live = [i for i, t in enumerate(texts) if t and _has_letter(t)]
    total = np.tile(model.log_prior, (len(texts), 1))
    columns = [np.ascontiguousarray(model.log_prob[:, k]) for k in range(len(model.labels))]
    group: list[np.ndarray] = []
    owner: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if not group:
            return
        c = np.concatenate(group)
        starts = np.cumsum([0, *map(len, group)][:-1])
        for _, b in _buckets(c, model.orders, model.bits):
            at = np.minimum(starts, len(b) - 1)
            for k, column in enumerate(columns):
                total[owner, k] += np.add.reduceat(column[b], at, dtype=np.float64)
        group.clear()
        owner.clear()
        size = 0

    pad = np.full(max(model.orders), 32, np.uint32)
    for i in live:
        c = _codes(texts[i])
        for s in range(0, len(c), _BLOCK):  # very long texts add up over blocks
            part = c[s : s + _BLOCK + max(model.orders) - 1] if s + _BLOCK < len(c) else c[s:]
            if owner and owner[-1] == i:
                flush()
            group += [np.concatenate((pad, part, pad[:1]))]  # n-grams across texts hold spaces only
            owner.append(i)
            size += len(part)
            if size >= _BLOCK:
                flush()
    flush()
    for i in live:
        z = total[i] - total[i].max()
        p = np.exp(z)
        k = int(p.argmax())
        best[i], prob[i] = model.labels[k], float(p[k] / p.sum())
    return best, prob


def fit(docs: DataFrame, eligible: Column | None = None, rows_per_language: int = 4000, bits: int = 16, orders: tuple[int, ...] = (2, 3), alpha: float = 0.5, max_labels: int = 200, text: str = "text", label: str = "lang", key: str = "doc_id") -> LanguageModel:
    """Fit on at most about ``rows_per_language`` rows of each label (documented bound of the sample).

    At most ``max_labels`` labels are learnt, the most frequent ones, so that the matrix has a bounded size.

    The sample takes the rows whose hashed key is lowest, the same share of each language's rows. Rows with
    null text or label, or for which ``eligible`` isn't true, are never read for it. With no labelled row the
    model has no label, and every prediction is ``und``.
    """
    rows = docs.where(F.col(text).isNotNull() & F.col(label).isNotNull() & (eligible if eligible is not None else F.lit(True))).select(F.col(label).alias("y"), F.col(text).alias("t"), F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << 62)).alias("u"))
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "y").limit(max_labels).collect()}
    labels = tuple(sorted(sizes))
    dim, index = 1 << bits, {y: k for k, y in enumerate(labels)}
    if not labels:
        return LanguageModel((), np.zeros((dim, 0), np.float32), np.zeros(0), bits, orders)
    share = F.create_map(*[x for y, n in sizes.items() for x in (F.lit(y), F.lit(min(1 << 62, (1 << 62) * rows_per_language // n + 1)))])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((len(labels), dim), np.int64)
        for rows in batches:
            for y, t in zip(rows.y, rows.t, strict=True):
                c = np.concatenate(([np.uint32(32)], _codes(t), [np.uint32(32)])).astype(np.uint32)
                for _, b in _buckets(c, orders, bits):
                    sums[index[y]] += np.bincount(b, minlength=dim)
        yield pd.DataFrame({"y": range(len(labels)), "v": [s.tobytes() for s in sums.astype("<i8")]})

    # The sample is bounded, so a few tasks add up its counts; each sends one vector per language.
    parts = rows.where(F.col("u") < F.try_element_at(share, F.col("y"))).select("y", "t").repartition(6).mapInPandas(count, "y int, v binary")
    sums = np.zeros((len(labels), dim), np.float64)
    for r in parts.toLocalIterator():
        sums[r["y"]] += np.frombuffer(r["v"], "<i8")
    prob = (sums + alpha) / (sums + alpha).sum(1, keepdims=True)
    prior = np.array([sizes[y] for y in labels], float)
    return LanguageModel(labels, np.log(prob).T.astype(np.float32), np.log(prior / prior.sum()), bits, orders)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", label_as: str = "lang_pred", score_as: str = "lang_score") -> DataFrame:
    """Append the predicted language and its posterior probability to every row; no other column is read.

    Null, empty and letterless texts get ``und`` and 0. Columns of the same names are replaced.
    """
    known = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("label string, score double")
    def predict(blocks: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        claim("language_id")
        for block in blocks:
            texts = [x or "" for x in block]
            if known.value.labels:
                labels, scores = score_texts(known.value, texts)
            else:
                labels, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            yield pd.DataFrame({"label": labels, "score": np.clip(scores, 0, 1)})
        tidy()

    name = free_name(docs, "__language")
    got = docs.withColumn(name, predict.asNondeterministic()(F.col(text)))
    return got.withColumns({label_as: F.col(f"{name}.label"), score_as: F.col(f"{name}.score")}).drop(name)
