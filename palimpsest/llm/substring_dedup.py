"""Removal of repeated word windows with a log-structured fingerprint index.

The index keeps the fingerprint of every historical window (its anchor's hash, see :mod:`.winnow`) in sorted
immutable runs. A new batch's sorted fingerprints are merge-joined with the runs, partition by partition of the
hash range; what matches is verified on the whole windows; the batch becomes a run of its own, and when runs are
many they are compacted to one. A log that is given a path stays there and takes further corpora. Everything that leaves a task is a sorted array of different hashes, so a window
that a third of all documents hold is one entry per segment, not one per copy.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import claim, cut, discard, keep, scratch, whole_tables
from .winnow import _B2, SEGMENT_BYTES, Anchors, by_segment, carried_rows, covered, member, mixed, rolling, rows_of, segments, split_parts, stretches, text_bytes, unpack

GRAM_WORDS = 8
PART_BYTES = 24 << 20
_ENTRY = "part int, seg long, hashes binary, flags binary"
_ANSWER = "kind string, part int, seg long, hashes binary, owners binary"
_ANSWER_NAMES = ["kind", "part", "seg", "hashes", "owners"]


class _WordHashes(dict):
    """Word -> hash, kept until there are many."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word) >> 1
        if len(word) <= 64:  # longer words are rare or junk
            if len(self) > 250_000:
                self.clear()
            self[word] = h
        return h


_hashes = _WordHashes()


def _words(bodies: list[bytes]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Words of each document, their number, and all their hashes."""
    claim("substring_dedup", _hashes)
    words = [b.split() for b in bodies]
    sizes = np.array(list(map(len, words)), np.int64)
    n = int(sizes.sum())
    return words, sizes, np.fromiter((_hashes[w] for ws in words for w in ws), np.int64, n).astype(np.uint64)


def _entries(seg: int, u: np.ndarray, flags: np.ndarray, parts: int) -> Iterator[tuple]:
    for p, s, e in split_parts(u, parts):
        yield p, seg, u[s:e].tobytes(), flags[s:e].tobytes()


def _frame(rows: list[tuple]) -> pa.RecordBatch:
    names = ("part", "seg", "hashes", "flags")
    kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(4)], names)


def _gather(rows: pd.DataFrame, flag: type = bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All hashes, their segment and their flag."""
    if not len(rows):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, flag)
    h = [np.frombuffer(x, np.uint64) for x in rows.hashes]
    return np.concatenate(h), np.repeat(rows.seg.to_numpy(np.int64), list(map(len, h))), np.concatenate([np.frombuffer(x, flag) for x in rows["flags"]])


def _answers(segs: np.ndarray, hashes: np.ndarray, kind: str, part: int) -> list[tuple]:
    order = np.lexsort((hashes, segs))
    segs, hashes = segs[order], hashes[order]
    return [(kind, part, int(segs[s]), hashes[s:e].tobytes(), None) for s, e in stretches(segs)]


class FingerprintLog:
    """Sorted immutable runs of window fingerprints in a folder, with the segments of texts that they are of.

    A run has one row per part of the hash range: sorted hashes and, for each, the segment that it was first
    seen in, or -1 once every holder is known as repeated. Of several records of a hash the newest counts. When
    there are over ``max_runs`` runs they are compacted to one.

    With a ``path`` the log stays there and a later log of the same path goes on with its runs and segments (the
    number of parts is the one it began with); a run or segment table counts once it is written whole, and runs keep
    who holds a repeated hash. Without one it lives in the shared folder and goes with :func:`.shared.scratch`.
    """

    def __init__(self, spark: SparkSession, parts: int, path: str | None = None, max_runs: int = 2):
        self.spark, self.parts, self.path, self.max_runs = spark, parts, path, max_runs
        self.runs: list[DataFrame] = []
        self.calls = 0
        self._next = 0
        if path is not None:
            names = whole_tables(spark, path)
            self.calls = sum(n.startswith("segments-") for n in names)
            runs = sorted((n for n in names if n.startswith("run-")), key=lambda n: int(n.split("-")[1]))
            if runs:
                self.parts = int(runs[0].split("-")[2])
                self._next = 1 + int(runs[-1].split("-")[1])
                self.runs = [self._open(n) for n in runs]

    def _open(self, name: str) -> DataFrame:
        out = self.spark.read.schema(_ANSWER).parquet(f"{self.path}/{name}")
        out._palimpsest_path = f"{self.path}/{name}"
        return out

    def _written(self, run: DataFrame) -> DataFrame:
        if self.path is None:
            return cut(run, "run")
        name = f"run-{self._next}-{self.parts}"
        self._next += 1
        run.write.option("compression", "zstd").parquet(f"{self.path}/{name}")
        return self._open(name)

    def history(self) -> DataFrame | None:
        """The segments of all earlier calls."""
        if not self.calls:
            return None
        return reduce(DataFrame.unionByName, [self.spark.read.parquet(f"{self.path}/segments-{k}") for k in range(self.calls)])

    def _history(self) -> DataFrame:
        none = self.spark.createDataFrame([], f"age int, {_ANSWER}")
        rows = [r if self.path is not None else r.where("kind = 'run'") for r in self.runs]
        return reduce(DataFrame.unionByName, [r.select(F.lit(k).alias("age"), *_ANSWER_NAMES) for k, r in enumerate(rows)], none).repartition(self.parts, "part")

    def add(self, entries: DataFrame) -> DataFrame:
        """Merge-join a batch's ``entries`` with all runs, append it as a run, and return the segments' repeated hashes."""

        def merge(key, new: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
            part = int(key[0])
            h, seg, multi = _gather(new)
            order = np.argsort(h, kind="stable")
            h, seg, multi = h[order], seg[order], multi[order]
            first = np.concatenate(([True], h[1:] != h[:-1])) if len(h) else np.zeros(0, bool)
            at = np.flatnonzero(first)
            u, group = h[at], np.cumsum(first) - 1
            owner = np.full(len(u), -2, np.int64)  # -2: never seen
            answers = old[old.kind == "answer"]
            for r in old[old.kind == "run"].sort_values("age").itertuples():  # the newest record is put last
                past, owners = np.frombuffer(r.hashes, np.uint64), np.frombuffer(r.owners, np.int64)
                hit = member(u, past)
                owner[hit] = owners[np.searchsorted(past, u[hit])]
            again = (np.diff(np.append(at, len(h))) > 1) | (np.logical_or.reduceat(multi, at) if len(at) else np.zeros(0, bool)) | (owner > -2)
            told = again[group] if len(group) else np.zeros(0, bool)
            out = _answers(np.concatenate((seg[told], owner[owner >= 0])), np.concatenate((h[told], u[owner >= 0])), "answer", part)
            known = u[owner == -1]  # holders of earlier calls, whom only the log remembers
            for r in answers.itertuples():
                past = np.frombuffer(r.hashes, np.uint64)
                if (hit := member(past, known)).any():
                    out.append(("answer", part, int(r.seg), past[hit].tobytes(), None))
            fresh = np.where(again, -1, seg[at]).astype(np.int64)
            if len(u):
                out.append(("run", part, 0, u.tobytes(), fresh.tobytes()))
            return pd.DataFrame(out, columns=_ANSWER_NAMES)

        run = self._written(entries.repartition(self.parts, "part").groupBy("part").cogroup(self._history().groupBy("part")).applyInPandas(merge, _ANSWER))
        self.runs.append(run)
        told = cut(run.where("kind = 'answer'").select("seg", "hashes"), "told")  # runs go when they are compacted
        if len(self.runs) > self.max_runs:
            self.compact()
        return told

    def compact(self) -> None:
        """Merge all runs to one; the newest record of each hash stays."""

        def merge(key, rows: pd.DataFrame) -> pd.DataFrame:
            answers = rows[rows.kind == "answer"]
            rows = rows[rows.kind == "run"].sort_values("age", ascending=False)
            h = np.concatenate([np.frombuffer(x, np.uint64) for x in rows.hashes])
            owner = np.concatenate([np.frombuffer(x, np.int64) for x in rows.owners])
            u, at = np.unique(h, return_index=True)  # the first of equals: the newest
            out = [("run", int(key[0]), 0, u.tobytes(), owner[at].tobytes())]
            for seg, own in answers.groupby("seg"):
                out.append(("answer", int(key[0]), int(seg), np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in own.hashes])).tobytes(), None))
            return pd.DataFrame(out, columns=_ANSWER_NAMES)

        before = self.runs
        self.runs = [self._written(self._history().groupBy("part").applyInPandas(merge, _ANSWER))]
        for run in before:
            discard(run)


def _anchor_entries(table: DataFrame, words: int, parts: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            _, sizes, h = _words(unpack(row)[2])
            out = list(_entries(row["seg"], *Anchors(h, sizes, words, min(GRAM_WORDS, words)).values(), parts))
            if out:
                yield _frame(out)

    return table.select("seg", "ids", "null_id", "sizes", "body").mapInArrow(run, _ENTRY)


def _whole_windows(h: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes (64 and 32 bits) of the window that starts at each word."""
    return mixed(rolling(h, words)), (mixed(rolling(mixed(h ^ np.uint64(_B2)), words, _B2 | 1)) >> np.uint64(32)).astype(np.uint32)


def _candidates(row: dict, words: int) -> tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, sizes, and start and hashes of the windows whose anchor repeats."""
    docs, sizes, h = _words(unpack(row)[2])
    found = Anchors(h, sizes, words, min(GRAM_WORDS, words))
    wanted = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in row["wanted"]])) if row["wanted"] else np.zeros(0, np.uint64)
    starts = found.starts[found.windows_at(wanted)]
    if not len(starts):
        return docs, sizes, starts, np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    h1, h2 = _whole_windows(h, words)
    return docs, sizes, starts, h1[starts], h2[starts]


def _window_entries(table: DataFrame, words: int, parts: int) -> DataFrame:
    """Different candidate windows of each segment; the flags column has the second hash and the repeat bit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            _, _, _, h1, h2 = _candidates(row, words)
            u, at, n = np.unique(h1, return_index=True, return_counts=True)
            out = list(_entries(row["seg"], u, (h2[at] & np.uint32(~np.uint32(1))) | (n > 1).astype(np.uint32), parts))
            if out:
                yield _frame(out)

    return table.mapInArrow(run, _ENTRY)


def _verify(key, rows: pd.DataFrame) -> pd.DataFrame:
    """Per segment, the windows that occur twice or more; both hashes must agree."""
    h, seg, check = _gather(rows, np.uint32)
    order = np.lexsort((check >> 1, h))
    h, seg, check = h[order], seg[order], check[order]
    same = (h[1:] == h[:-1]) & (check[1:] >> 1 == check[:-1] >> 1)
    again = (check & 1).astype(bool)
    again[1:] |= same
    again[:-1] |= same
    h, seg, check = h[again], seg[again], check[again]
    order = np.argsort(seg, kind="stable")
    h, seg, check = h[order], seg[order], check[order]
    return pd.DataFrame([(int(seg[s]), h[s:e].tobytes(), check[s:e].tobytes()) for s, e in stretches(seg)], columns=["seg", "hashes", "checks"])


def _repeats(h1: np.ndarray, h2: np.ndarray, told: list[dict]) -> np.ndarray:
    """Which windows are told of, by both hashes."""
    h = np.concatenate([np.frombuffer(x["hashes"], np.uint64) for x in told])
    c = np.concatenate([np.frombuffer(x["checks"], np.uint32) for x in told]) >> 1
    order = np.argsort(h, kind="stable")
    h, c = h[order], c[order]
    hit = np.zeros(len(h1), bool)
    live = np.flatnonzero(member(h1, h))
    at = np.searchsorted(h, h1[live])
    while len(live):  # further turns only where different windows share the first hash
        hit[live] |= c[at] == h2[live] >> 1
        at = at + 1
        on = at < len(h)
        on[on] = h[at[on]] == h1[live[on]]
        live, at = live[on], at[on]
    return hit


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = 35, batches: int = 3, carry: tuple[str, ...] = (), original: bool = False, segment_bytes: int = SEGMENT_BYTES, log_path: str | None = None) -> DataFrame:
    """Words covered by a window of ``words`` words that starts anywhere else too are removed, all copies of them.

    Returns per row: the key, ``n_words``, ``n_removed`` (long) and ``kept``, the kept words joined by one space
    (with ``original``, the text as it was where nothing is removed), then the columns of ``carry``. Windows are
    judged on the input. Null, empty and short texts lose nothing; repeated rows are copies of each other and
    lose every word that a window covers. Rows with a null key are handled like others. ``batches`` is the
    number of additions to the index; the result doesn't depend on it.

    With ``log_path``, a folder of a store that all executors see, the index and the compressed texts stay there,
    and windows also count as repeated that texts of earlier calls hold; those texts are not returned again.
    """
    spark = docs.sparkSession
    with scratch():
        log = FingerprintLog(spark, 0, log_path)
        if log_path is None:
            table = cut_segments = segments(docs, text, key, carry, segment_bytes)
        else:
            table = segments(docs, text, key, carry, segment_bytes, log.calls, f"{log_path}/segments-{log.calls}")
        total = text_bytes(table)
        log.parts = log.parts or min(1 << 16, max(8, -(-total // PART_BYTES)))
        told = [log.add(_anchor_entries(table.where(F.pmod(F.xxhash64("seg"), F.lit(batches)) == b), words, log.parts)) for b in range(batches)]
        wanted = reduce(DataFrame.unionByName, told).groupBy("seg").agg(F.collect_list("hashes").alias("wanted"))
        columns = ("seg", "ids", "null_id", "sizes", "body")
        past = log.history()
        every = table.select(*columns) if past is None else table.select(*columns).unionByName(past.select(*columns))
        suspects = by_segment(every, wanted, total, "inner")
        repeated = cut(_window_entries(suspects, words, log.parts).repartition(log.parts, "part").groupBy("part").applyInPandas(_verify, "seg long, hashes binary, checks binary"), "repeated", keep=True)
        if log_path is None:
            keep(cut_segments)
    answers = repeated.groupBy("seg").agg(F.collect_list(F.struct("hashes", "checks")).alias("told"))
    carried = [docs.schema[c] for c in carry]
    schema = T.StructType([T.StructField(key, T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType()), *carried])

    def finish(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(blocks):
            ids, nulls, bodies = unpack(row)
            found, sizes, h = _words(bodies)
            ends = np.cumsum(sizes).tolist()
            gone = np.zeros(len(h), bool)
            if row["told"] and len(h) >= words:
                edges = np.repeat(np.cumsum(sizes), sizes)
                h1, h2 = _whole_windows(h, words)
                starts = np.flatnonzero(_repeats(h1, h2, row["told"]) & (np.arange(len(h1)) + words <= edges[: len(h1)]))
                gone = covered(starts, starts + words, len(h))
            removed, kept = [], []
            for ws, n, e, body in zip(found, sizes.tolist(), ends, bodies, strict=True):
                mask = gone[e - n : e]
                k = int(mask.sum())
                removed.append(k)
                left = body if original and not k else b" ".join(ws if not k else [w for w, x in zip(ws, mask.tolist(), strict=True) if not x])
                kept.append(left.decode("utf-8", "replace"))
            columns = [pa.array([None if z else i for i, z in zip(ids.tolist(), nulls, strict=True)], pa.int64()), pa.array(sizes), pa.array(removed, pa.int64()), pa.array(kept, pa.string())]
            rest = carried_rows(row)
            columns += [rest.column(k).combine_chunks() for k in range(len(carry))] if rest is not None else []
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return by_segment(table, answers, total).mapInArrow(finish, schema)


def drop_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = 35) -> DataFrame:
    """``docs`` with the same columns and rows, its texts without repeated windows; untouched texts stay as they are.

    ``n_chars``, if there, is set to the new length. A text that is removed whole becomes empty; its row stays.
    """
    own = {c: f"__own_{c}" for c in docs.columns if c not in (text, key)}  # so that no column is named like a result's
    ready = docs.withColumn(key, F.col(key).cast("long")).withColumnsRenamed(own)
    out = remove_repeats(ready, text, key, words, carry=tuple(own.values()), original=True).drop("n_words", "n_removed")
    out = out.withColumnRenamed("kept", text).withColumnsRenamed({v: k for k, v in own.items()})
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
