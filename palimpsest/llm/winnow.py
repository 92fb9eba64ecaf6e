"""Packed segments of documents, rolling window hashes and anchors.

An anchor of a window of L symbols is the k-gram in it whose hash ranks lowest (the leftmost of equals). Equal
windows have equal anchors at the same offset, so a window can only repeat if its anchor's k-gram does. That
turns the search for repeated windows into one for repeated anchors, of which there are about 2 / (L - k + 2)
per position, and an exact comparison of the few windows whose anchor repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, strings, tidy

SEGMENT_BYTES = 4 << 20
_POS_BITS = 28  # a segment holds under 2 ** 28 symbols; ranks use the other bits of the hash
_POS = np.uint64((1 << _POS_BITS) - 1)
_B1, _B2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
MISSING_ID = (1 << 63) - 1  # the place of a null id: after all others

SEGMENTS = pa.schema([("seg", pa.int64()), ("ids", pa.list_(pa.int64())), ("null_id", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int64())), ("body", pa.binary()), ("extra", pa.binary())])


def segments(docs: DataFrame, text: str = "text", key: str = "doc_id", carry: tuple[str, ...] = (), segment_bytes: int = SEGMENT_BYTES, call: int = 0, path: str | None = None) -> DataFrame:
    """Rows packed, as they come, to written segments of about ``segment_bytes`` of UTF-8: no shuffle, one compressed body each.

    A longer document is a segment of its own. Null text is empty; a null id is flagged and ranks last. The
    columns named in ``carry`` travel along in Arrow's stream format. ``call`` tells segments of several calls apart;
    ``path`` is where they stay, else they are a table of :func:`cut`.
    """
    carried = [f"c{k}" for k in range(len(carry))]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, n = call << 52 | TaskContext.get().partitionId() << 32, 0
        ids, bodies, total, extra = [], [], 0, []

        def out() -> pa.RecordBatch:
            body = zstandard.ZstdCompressor(level=3).compress(b"".join(bodies))
            return pa.RecordBatch.from_pydict({"seg": [base + n], "ids": [[MISSING_ID if i is None else i for i in ids]], "null_id": [[i is None for i in ids]], "sizes": [list(map(len, bodies))], "body": [body], "extra": [_stream(extra)]}, SEGMENTS)

        for b in (whole.slice(k, 256) for whole in batches for k in range(0, whole.num_rows, 256)):
            since = 0
            rest = b.select(carried) if carried else None
            for row, (i, t) in enumerate(zip(b.column(0).to_pylist(), strings(b.column(1)), strict=True)):
                raw = t.encode("utf-8", "surrogatepass")
                if bodies and total + len(raw) > segment_bytes:
                    if rest is not None and row > since:
                        extra.append(rest.slice(since, row - since))
                    since = row
                    yield out()
                    n += 1
                    ids, bodies, total, extra = [], [], 0, []
                ids.append(i)
                bodies.append(raw)
                total += len(raw)
            if rest is not None and rest.num_rows > since:
                extra.append(rest.slice(since))
        if bodies:
            yield out()
        bodies, extra = [], []
        tidy()

    chosen = docs.select(docs[key].cast("long").alias("i"), docs[text].alias("t"), *[docs[c].alias(k) for c, k in zip(carry, carried, strict=True)])
    packed = chosen.mapInArrow(pack, "seg long, ids array<long>, null_id array<boolean>, sizes array<long>, body binary, extra binary")
    if path is None:
        return cut(packed, "segments")
    packed.write.parquet(path)
    return docs.sparkSession.read.schema(packed.schema).parquet(path)


def _stream(batches: list[pa.RecordBatch]) -> bytes | None:
    if not batches:
        return None
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batches[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
        for b in batches:
            to.write_batch(b)
    return sink.getvalue().to_pybytes()


def carried_rows(row: dict) -> pa.Table | None:
    """The carried columns of a segment, in the order of its documents."""
    return pa.ipc.open_stream(row["extra"]).read_all() if row["extra"] else None


def unpack(row: dict) -> tuple[np.ndarray, list[bool], list[bytes]]:
    """Ids, null flags and UTF-8 bodies of the documents of a segment."""
    whole = zstandard.ZstdDecompressor().decompress(row["body"], max_output_size=max(1, sum(row["sizes"])))
    ends = np.cumsum([0, *row["sizes"]]).tolist()
    return np.array(row["ids"], np.int64), row["null_id"], [whole[s:e] for s, e in zip(ends, ends[1:], strict=False)]


def rolling(a: np.ndarray, n: int, base: int = _B1) -> np.ndarray:
    """Polynomial hash modulo 2**64 of the n symbols from each position, by doubling."""
    if len(a) < n:
        return np.zeros(0, np.uint64)
    power = a.astype(np.uint64, copy=False)
    width, out, done = 1, None, 0
    left = n
    while True:
        if left & 1:
            if out is None:
                out, done = power, width
            else:
                m = len(a) - done - width + 1
                out = out[:m] * np.uint64(pow(base, width, 1 << 64)) + power[done : done + m]
                done += width
        left >>= 1
        if not left:
            return out
        m = len(power) - width
        power = power[:m] * np.uint64(pow(base, width, 1 << 64)) + power[width : width + m]
        width *= 2


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over the word."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def sliding_min(a: np.ndarray, n: int) -> np.ndarray:
    """Least of the n values from each position."""
    if len(a) < n:
        return a[:0]
    width = 1
    while width * 2 <= n:
        a = np.minimum(a[:-width], a[width:])
        width *= 2
    return a if width == n else np.minimum(a[: len(a) - (n - width)], a[n - width :])


class Anchors:
    """Windows of ``length`` symbols of a segment that lie inside one document, and their anchors."""

    def __init__(self, symbols: np.ndarray, sizes: np.ndarray, length: int, gram: int):
        h = mixed(rolling(symbols, gram))
        at = sliding_min((h & ~_POS) | np.arange(len(h), dtype=np.uint64), length - gram + 1) & _POS
        ends = np.repeat(np.cumsum(sizes), sizes)  # end of the document that each symbol is in
        starts = np.flatnonzero(np.arange(len(at)) + length <= ends[: len(at)]) if len(at) else np.zeros(0, np.int64)
        self.starts, self.at = starts, at[starts].astype(np.int64)  # start and anchor position of each window
        self.places = self.at[np.concatenate(([True], self.at[1:] != self.at[:-1]))] if len(starts) else self.at
        self._h = h
        self.hashes = self._named(self.places)

    def _named(self, at: np.ndarray) -> np.ndarray:
        """Hashes of the anchors at ``at``, mixed anew: those that were chosen for ranking low are spread evenly again."""
        return mixed(self._h[at] + np.uint64(_B2))

    def values(self) -> tuple[np.ndarray, np.ndarray]:
        """Different anchor hashes, ascending, and whether they occur at several places of this segment."""
        u, n = np.unique(self.hashes, return_counts=True)
        return u, n > 1

    def windows_at(self, wanted: np.ndarray) -> np.ndarray:
        """Which windows have an anchor whose hash is in ``wanted`` (sorted)."""
        return member(self._named(self.at), wanted)

    def places_at(self, wanted: np.ndarray) -> np.ndarray:
        """Anchor places whose hash is in ``wanted`` (sorted)."""
        return self.places[member(self.hashes, wanted)]


def member(x: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Whether each value is in the sorted array ``of``."""
    if not len(of):
        return np.zeros(len(x), bool)
    return of[np.minimum(np.searchsorted(of, x), len(of) - 1)] == x


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Mask of the positions 0 <= i < n that lie in some [start, end)."""
    d = np.bincount(starts, minlength=n + 1)[: n + 1].astype(np.int64) - np.bincount(ends, minlength=n + 1)[: n + 1]
    return np.cumsum(d)[:n] > 0


def split_parts(values: np.ndarray, parts: int) -> list[tuple[int, int, int]]:
    """(part, start, end) of the slices of a sorted uint64 array in ``parts`` equal ranges of hash values; empty ones are left out."""
    part = np.minimum(values // np.uint64((1 << 64) // parts), np.uint64(parts - 1))
    return [(int(part[s]), s, e) for s, e in stretches(part)]


def stretches(x: np.ndarray) -> list[tuple[int, int]]:
    """Start and end of each stretch of equal neighbours; none of an empty array."""
    if not len(x):
        return []
    at = [0, *(np.flatnonzero(x[1:] != x[:-1]) + 1).tolist(), len(x)]
    return list(zip(at, at[1:], strict=False))


def text_bytes(table: DataFrame) -> int:
    """UTF-8 bytes of all texts of a table of segments."""
    return table.select(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0


def by_segment(table: DataFrame, answers: DataFrame, total: int, how: str = "left") -> DataFrame:
    """Segments with what was found for them, in tasks of about 32 MB of text."""
    n = min(1 << 17, max(8, total // (32 << 20)))
    return table.repartition(n, "seg").join(answers.repartition(n, "seg"), "seg", how)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one at a time (segments are large); memory is handed back at the end."""
    for b in batches:
        for k in range(b.num_rows):
            yield b.slice(k, 1).to_pylist()[0]
    tidy()
