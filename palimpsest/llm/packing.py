"""Packing of documents into fixed windows by non-negative least squares over length combinations.

Only the histogram of piece lengths (at most one entry per length up to the window, whatever the corpus) comes
to the driver. There, shallow combinations of lengths that fill the window are enumerated, their repeat counts
solved against the histogram by non-negative least squares and rounded down, and what is left is packed
greedily. The plan says which rank of which length goes where; each piece then finds its own place from its rank
among the pieces of its length, which the tasks number themselves: no piece is shuffled to be ranked.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .shared import claim, cut, strings, tidy
from .winnow import stretches


@dataclass(frozen=True)
class Plan:
    """Per length: first ranks, first sequence ids and offsets of the stretches of pieces, by rank."""

    ranks: dict[int, np.ndarray]
    sequences: dict[int, np.ndarray]
    offsets: dict[int, np.ndarray]
    total: int


def combinations_of(lengths: np.ndarray, window: int, fill: float = 0.985, spread: int = 8) -> list[tuple[int, ...]]:
    """Combinations of one, two or three present lengths that fill the window to at least ``fill``."""
    have = np.sort(lengths)
    ordered = have.tolist()

    def largest(most: int) -> int:
        k = bisect_right(ordered, most)
        return ordered[k - 1] if k else 0

    out: set[tuple[int, ...]] = set()
    for a in ordered:
        if a >= fill * window:
            out.add((a,))
        if b := largest(window - a):
            if a + b >= fill * window:
                out.add(tuple(sorted((a, b))))
            room = have[: bisect_right(ordered, window - a)]
            for b in np.unique(room[np.linspace(0, len(room) - 1, min(spread, len(room))).astype(int)]).tolist():
                c = largest(window - a - b)
                if c and a + b + c >= fill * window:
                    out.add(tuple(sorted((a, b, c))))
    return sorted(out)


def nnls(parts: np.ndarray, owner: np.ndarray, columns: int, target: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative x that minimises |A x - target|, A[parts, owner] += 1, by accelerated projected gradient."""
    forward = lambda x: np.bincount(parts, x[owner], len(target))
    back = lambda r: np.bincount(owner, r[parts], columns)
    v = np.ones(columns)
    for _ in range(30):
        v = back(forward(v))
        v /= max(np.linalg.norm(v), 1e-12)
    step = 1 / max(np.linalg.norm(back(forward(v))) * 1.05, 1e-12)
    x = y = np.zeros(columns)
    t = 1.0
    for _ in range(rounds):
        z = np.maximum(0, y - step * back(forward(y) - target))
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        x, y, t = z, z + (t - 1) / s * (z - x), s
    return x


def plan(histogram: dict[int, int], window: int) -> Plan:
    """Places for every piece of the histogram {length: pieces}; lengths are 1 to ``window``."""
    left = np.zeros(window + 1, np.int64)
    for n, k in histogram.items():
        left[n] = k
    given, total = np.zeros_like(left), 0
    stretches: dict[int, list[tuple[int, int, int]]] = {n: [] for n in histogram}

    def put(combo: tuple[int, ...], times: int) -> None:
        nonlocal total
        offset = 0
        for n in combo:
            stretches[n].append((int(given[n]), total, offset))
            given[n] += times
            left[n] -= times
            offset += n
        total += times

    lengths = np.flatnonzero(left)
    combos = combinations_of(lengths, window) if len(lengths) else []
    if combos:
        parts = np.array([n for c in combos for n in c])
        owner = np.repeat(np.arange(len(combos)), [len(c) for c in combos])
        x = nnls(parts, owner, len(combos), left.astype(float))
        for k in np.argsort(-x, kind="stable").tolist():
            if x[k] < 1:
                break
            c = combos[k]
            times = min(int(x[k]), *(int(left[n]) // c.count(n) for n in c))
            if times > 0:
                put(c, times)
    while (present := np.flatnonzero(left)).size:  # each turn uses up a length at least
        combo, room, free = [], window, {}
        ordered = present.tolist()
        while room:
            k = bisect_right(ordered, room)
            while k and free.get(ordered[k - 1], int(left[ordered[k - 1]])) == 0:
                k -= 1
            if not k:
                break
            n = ordered[k - 1]
            take = min(room // n, free.get(n, int(left[n])))
            free[n] = free.get(n, int(left[n])) - take
            combo += [n] * take
            room -= n * take
        put(tuple(combo), min(int(left[n]) // combo.count(n) for n in set(combo)))
    columns = [{n: np.array([s[k] for s in own], np.int64) for n, own in stretches.items()} for k in range(3)]
    return Plan(*columns, total)


class _Bytes(dict):
    """Word -> its ids as little-endian 32-bit bytes; unknown words go to the library.

    At most 450,000 words of at most 64 characters are kept, some 100 MB; a longer one goes after its block of texts.
    """

    def __init__(self, path: str):
        super().__init__()
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        vocab = self.library.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)  # ids that end a word
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def learn(self, words: set[str]) -> None:
        if len(self) > 450_000:
            self.clear()
        new = [w for w in words if w not in self]
        letters = [w for w in new if w.isalpha()]  # one token group each, so that many can be encoded as one text
        for at in range(0, len(letters), 1000):
            part = letters[at : at + 1000]
            ids = np.array(self.library.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
            stops = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(stops) != len(part):  # not split as expected: one by one
                self._single(part)
                continue
            raw = ids.tobytes()
            self.update(zip(part, [raw[s:e] for s, e in zip([0, *stops], stops, strict=False)], strict=True))
        self._single([w for w in new if not w.isalpha()])

    def _single(self, words: list[str]) -> None:
        for at in range(0, len(words), 2000):
            part = words[at : at + 2000]
            for w, e in zip(part, self.library.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self[w] = array("I", e.ids).tobytes()


_tokenizers: dict[str, _Bytes] = {}


def encode_texts(path: str, texts: list[str]) -> list[bytes]:
    """Ids of whole texts by the library, as bytes.

    The word tokenizer drops white space and never merges across it, so a text's ids are those of its pieces
    between ASCII white space; each different piece is encoded once and looked up afterwards.
    """
    if path not in _tokenizers:
        _tokenizers[path] = _Bytes(path)
    own = _tokenizers[path]
    split = [_pieces(t) for t in texts]
    words = set().union(*split)
    own.learn(words)
    out = [b"".join(map(own.__getitem__, ws)) for ws in split]
    for w in words:
        if len(w) > 64:
            del own[w]
    return out


_MARKS = re.compile(r"(?:[^\w\s]|_){2}")
#: Printable ASCII with tab and line ends, Latin letters and marks but the no-break space and the dotted capital I,
#: dashes and quotation marks: none combines with a neighbour, and each letter's lower case is one letter.
_PLAIN = re.compile("[\t\n\r -~\u00a1-\u00ac\u00ae-\u012f\u0131-\u024f\u2010-\u2027]*")


def _pieces(text: str) -> list[str]:
    """The text between spaces, tabs and line ends; other white space stays in a piece, for the library to drop.

    Composition, lower-casing, special tokens and the tokenizer's own split all stay within such pieces. A text of
    plain characters only, without a special token's opening, has fewer different pieces: it may be lower-cased
    first, and where no two marks follow each other, full stops and commas are tokens by themselves.
    """
    if "<|" not in text and _PLAIN.fullmatch(text):
        if not _MARKS.search(text):
            text = text.replace(".", " . ").replace(",", " , ")
        text = text.lower()
    return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")


def _encoded_rows(path: str, b: pa.RecordBatch) -> Iterator[tuple[int | None, bytes]]:
    for k in range(0, b.num_rows, 500):
        part = b.slice(k, 500)
        yield from zip(part.column(0).to_pylist(), encode_texts(path, strings(part.column(1))), strict=True)


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, window: int = 2048, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Written pieces of each document's ids (with the end id), with the task and the rank among its equals there."""
    schema = pa.schema([(key, pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("task", pa.int64()), ("rank", pa.int64())])
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("packing", _tokenizers)
        task, seen = TaskContext.get().partitionId(), np.zeros(window + 1, np.int64)
        for b in batches:
            out: list[list] = [[] for _ in schema]
            for i, raw in _encoded_rows(tokenizer, b):
                raw += end
                n = len(raw) // 4
                for s in range(0, n, window):
                    size = min(window, n - s)
                    for column, x in zip(out, (i, s, size, zlib.crc32(raw[4 * s : 4 * (s + size)]), n, task, int(seen[size])), strict=True):
                        column.append(x)
                    seen[size] += 1
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, schema, strict=True)], schema=schema)
        tidy()

    kinds = f"`{key}` long, start long, length long, ids_crc32 long, doc_tokens long, task long, rank long"
    return cut(docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).mapInArrow(run, kinds), "pieces")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, window: int = 2048, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text has the end id as its only one. A document is cut only where it is longer than the
    window. Rows with a null key or repeated rows are packed like others. An empty table gives no row.
    """
    cuts = pieces(docs, tokenizer, end_id, window, text, key)
    per_task = cuts.groupBy("task", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``window`` rows
    shared = docs.sparkSession.sparkContext.broadcast(plan(histogram, window))  # bounded by the window, not the corpus
    before = per_task.select("task", "length", (F.sum("n").over(W.partitionBy("length").orderBy("task")) - F.col("n")).alias("before"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for b in batches:
            length, rank = b.column(2).to_numpy(), b.column(5).to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for s, e in stretches(length[order]):
                rows = order[s:e]
                n = int(length[rows[0]])
                at = np.searchsorted(p.ranks[n], rank[rows], "right") - 1
                sequence[rows] = p.sequences[n][at] + rank[rows] - p.ranks[n][at]
                offset[rows] = p.offsets[n][at]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], [*b.schema.names[:5], "sequence_id", "offset"])

    ranked = cuts.join(before, ["task", "length"]).select(key, "start", "length", "ids_crc32", "doc_tokens", (F.col("rank") + F.col("before")).alias("rank"))
    return ranked.mapInArrow(place, f"`{key}` long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
