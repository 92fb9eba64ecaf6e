"""Removal of repeated byte strings by a distributed, common-prefix-aware merge sort of suffixes.

Suffixes are sampled at anchors (:mod:`.winnow`): every string of the given length holds one, and equal strings
hold it at the same offset, so sorting the suffixes that start at anchors, each with the few bytes before it,
finds every repeat. Anchors whose k-gram is nowhere else are left out first. A segment sorts its suffixes to a
run, front-codes it (length of the prefix shared with the one before, then the rest) and sends each part of the
hash range to its task. That task merges all runs with a loser tree whose nodes keep common-prefix lengths with
the last output: a longer known prefix wins without looking at a byte, and equal ones are compared from there on.
Out come the different contexts in order, each with the smallest id that has it and the prefix it shares with the
one before; these lengths tell which contexts hold the same strings.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, discard, tidy
from .winnow import MISSING_ID, Anchors, by_segment, covered, mixed, rows_of, segments, split_parts, stretches, text_bytes, unpack

GRAM_BYTES = 24
SEGMENT_BYTES = 1 << 20
PART_BYTES = 12 << 20
LEAST_PARTS = 32


class Contexts:
    """Anchors of a segment of bodies and, on demand, the bytes around each."""

    def __init__(self, bodies: list[bytes], ids: np.ndarray, length: int):
        self.length, self.gram = length, min(GRAM_BYTES, length)
        self.left = length - self.gram
        self.width = length + self.left + 2
        self.raw = np.frombuffer(b"".join(bodies), np.uint8)
        self.sizes = np.fromiter(map(len, bodies), np.int64, len(bodies))
        self.ends = np.cumsum(self.sizes)
        self.ids = ids
        self.anchors = Anchors(self.raw.astype(np.uint64) + np.uint64(1), self.sizes, length, self.gram)

    def rows(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Suffix rows, document of each place, and how many bytes the row has before and after the anchor.

        A row is the bytes from the anchor on, then those before it backwards, then both counts.
        """
        doc = np.searchsorted(self.ends, places, "right")
        before = np.minimum(places - (self.ends[doc] - self.sizes[doc]), self.left)
        after = np.minimum(self.ends[doc] - places, self.length)
        out = np.zeros((len(places), self.width), np.uint8)
        last = len(self.raw) - 1
        for j in range(self.length):
            out[:, j] = np.where(j < after, self.raw[np.minimum(places + j, last)], 0)
        for j in range(self.left):
            out[:, self.length + j] = np.where(j < before, self.raw[np.maximum(places - 1 - j, 0)], 0)
        out[:, -2], out[:, -1] = after, before
        return out, doc, np.stack((before, after), 1)


def row_hashes(rows: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of bytes."""
    pad = (-rows.shape[1]) % 8
    words = np.ascontiguousarray(np.pad(rows, ((0, 0), (0, pad)))).view(np.uint64)
    h = np.zeros(len(rows), np.uint64)
    for j in range(words.shape[1]):
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + words[:, j] + np.uint64(j + 1))
    return h


def front_code(rows: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Shared-prefix length with the row before, and the rest of each row, of sorted rows."""
    width = rows.shape[1]
    shared = np.zeros(len(rows), np.uint8)
    if len(rows) > 1:
        other = rows[1:] != rows[:-1]
        shared[1:] = np.where(other.any(1), other.argmax(1), width)
    return shared, rows[np.arange(width)[None, :] >= shared[:, None]].tobytes()


def _decode(shared: bytes, rest: bytes, width: int) -> Iterator[tuple[bytes, int]]:
    row, at = b"", 0
    for s in shared:
        n = width - s
        row = row[:s] + rest[at : at + n]
        at += n
        yield row, s


def merge_runs(runs: list[tuple[bytes, bytes]], width: int) -> Iterator[tuple[int, int, bytes]]:
    """Merge front-coded sorted runs: (run, prefix shared with the output before, row), in order.

    Loser tree over common-prefix lengths. ``heads[r]`` is run r's next row and ``known[r]`` the length of the
    prefix that it is known to share with the last output; of two heads, the one that shares more comes first,
    and only equal lengths are compared, from that length on.
    """
    k = 1
    while k < max(1, len(runs)):
        k *= 2
    streams = [_decode(s, r, width) for s, r in runs]
    heads: list[bytes | None] = [next(s, (None, 0))[0] for s in streams] + [None] * (k - len(runs))
    known = [0] * k
    loser = [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser) of two runs; the loser's known prefix becomes the one with the winner where that is longer."""
        x, y = heads[a], heads[b]
        if x is None:
            return b, a
        if y is None:
            return a, b
        p, q = known[a], known[b]
        if p != q:
            return (a, b) if p > q else (b, a)
        while p < width and x[p] == y[p]:
            if x[p : p + 8] == y[p : p + 8]:
                p += 8
            else:
                p += 1
        p = min(p, width)
        if p == width:
            low, high = min(a, b), max(a, b)
            known[high] = width
            return low, high
        if x[p] < y[p]:
            known[b] = p
            return a, b
        known[a] = p
        return b, a

    winners = [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        winners[node], loser[node] = play(winners[2 * node], winners[2 * node + 1])
    first = winners[1] if k > 1 else 0
    while (row := heads[first]) is not None:
        yield first, known[first], row
        # The run's next row shares with this output what front coding says; losers on the path were beaten
        # by this output or by what came before it, and their known prefixes stand for it.
        heads[first], shared = next(streams[first], (None, 0))
        known[first] = shared
        node = (first + k) >> 1
        while node:
            first, loser[node] = play(first, loser[node])
            node >>= 1


def _anchor_entries(table: DataFrame, length: int, parts: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            ids, _, bodies = unpack(row)
            u, several = Contexts(bodies, ids, length).anchors.values()
            short = u >> np.uint64(16)
            u, at = np.unique(short, return_index=True)
            several = np.logical_or.reduceat(several, at) if len(at) else several
            slices = split_parts(u << np.uint64(16), parts)
            if slices:
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _, _ in slices], pa.int32()), pa.array([row["seg"]] * len(slices), pa.int64()), pa.array([_six(u[s:e]) for _, s, e in slices], pa.binary()), pa.array([np.packbits(several[s:e]).tobytes() for _, s, e in slices], pa.binary())], ["part", "seg", "hashes", "several"])

    return table.select("seg", "ids", "null_id", "sizes", "body").mapInArrow(run, "part int, seg long, hashes binary, several binary")


def _six(u: np.ndarray) -> bytes:
    return u.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _eight(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return wide.view("<u8").ravel()


def _repeated(key, rows: pd.DataFrame) -> pd.DataFrame:
    own = [_eight(x) for x in rows["hashes"]]
    h = np.concatenate(own)
    seg = np.repeat(rows["seg"].to_numpy(np.int64), list(map(len, own)))
    again = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(o)).astype(bool) for x, o in zip(rows["several"], own, strict=True)])
    order = np.argsort(h, kind="stable")
    h, seg, again = h[order], seg[order], again[order]
    same = h[1:] == h[:-1]
    again[1:] |= same
    again[:-1] |= same
    h, seg = h[again], seg[again]
    order = np.argsort(seg, kind="stable")
    h, seg = h[order], seg[order]
    return pd.DataFrame([(int(seg[s]), _six(h[s:e])) for s, e in stretches(seg)], columns=["seg", "hashes"])


def _runs(table: DataFrame, length: int, parts: int) -> DataFrame:
    """Sorted front-coded run of each segment and part: different suffix rows and the smallest id of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            ids, _, bodies = unpack(row)
            c = Contexts(bodies, ids, length)
            wanted = np.unique(np.concatenate([_eight(x) for x in row["wanted"]]))
            hit = np.searchsorted(wanted, short := c.anchors.hashes >> np.uint64(16)).clip(max=len(wanted) - 1)
            chosen = wanted[hit] == short
            places, hashes = c.anchors.places[chosen], c.anchors.hashes[chosen]
            if not len(places):
                continue
            rows, doc, _ = c.rows(places)
            owner = c.ids[doc]
            by_id = np.argsort(owner, kind="stable")
            order = by_id[np.argsort(rows[by_id].view(f"S{c.width}").ravel(), kind="stable")]
            rows, owner, hashes = rows[order], owner[order], hashes[order]
            first = np.concatenate(([True], (rows[1:] != rows[:-1]).any(1)))
            rows, owner, hashes = rows[first], owner[first], hashes[first]
            zip_ = zstandard.ZstdCompressor(level=3)
            part = (hashes // np.uint64((1 << 64) // parts + 1)).astype(np.int64)
            dealt = np.argsort(part, kind="stable")
            for s, e in stretches(part[dealt]):
                mine = dealt[s:e]
                shared, rest = front_code(rows[mine])
                yield pa.RecordBatch.from_arrays([pa.array([int(part[mine[0]])], pa.int32()), pa.array([row["seg"]], pa.int64()), pa.array([zip_.compress(shared.tobytes())]), pa.array([zip_.compress(rest)]), pa.array([zip_.compress(owner[mine].tobytes())])], ["part", "seg", "shared", "rest", "owner"])

    return table.mapInArrow(run, "part int, seg long, shared binary, rest binary, owner binary")


def _shared_prefix(rows: np.ndarray) -> np.ndarray:
    """Length of the prefix that each row has in common with the one before; 0 for the first."""
    out = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        other = rows[1:] != rows[:-1]
        out[1:] = np.where(other.any(1), other.argmax(1), rows.shape[1])
    return out


def _windows(rows: np.ndarray, shared: np.ndarray, least: np.ndarray, length: int) -> np.ndarray:
    """Bit o of a row: the string that starts o bytes before its anchor starts in a document of a smaller id too.

    ``rows`` are in merged order and ``shared`` are their common prefixes with the row before. Rows have the same
    length - o bytes from the anchor on where no prefix between them is shorter; a second order, of the bytes
    before the anchor read backwards, tells in the same way which have the same o bytes there. Rows that are
    together in both hold the same string: nothing is hashed or compared again.
    """
    left, n = rows.shape[1] - length - 2, len(rows)
    after, before = rows[:, -2].astype(np.int64), rows[:, -1].astype(np.int64)
    back = np.ascontiguousarray(rows[:, length : length + left])
    order = np.argsort(back.view(f"V{left}").ravel(), kind="stable") if left else np.arange(n)
    behind = _shared_prefix(back[order])
    bits = np.zeros(n, np.uint64)
    group = np.zeros(n, np.int64)
    for o in range(left + 1):
        at = np.flatnonzero((o <= before) & (length - o <= after))
        if not len(at):
            continue
        group[order] = np.cumsum(behind < o)
        same = (np.cumsum(shared < length - o) * (n + 1) + group)[at]
        by = np.argsort(same, kind="stable")
        starts = np.flatnonzero(np.concatenate(([True], same[by][1:] != same[by][:-1])))
        lowest = np.repeat(np.minimum.reduceat(least[at[by]], starts), np.diff(np.append(starts, len(by))))
        beaten = at[by[lowest < least[at[by]]]]
        bits[beaten] |= np.uint64(1 << o)
    return bits


def _merge_part(length: int, width: int):
    def merge(key, rows: pd.DataFrame) -> pd.DataFrame:
        unzip = zstandard.ZstdDecompressor()
        rows = rows.sort_values("seg")
        segs = rows["seg"].to_numpy(np.int64)
        runs = [(unzip.decompress(s), unzip.decompress(r)) for s, r in zip(rows["shared"], rows["rest"], strict=True)]
        owners = [np.frombuffer(unzip.decompress(x), np.int64) for x in rows["owner"]]
        gram = min(GRAM_BYTES, length)
        # Numbers and bytes are held packed: a part has hundreds of thousands of rows.
        run_list, class_list, group_list, prefixes, contexts = array("q"), array("q"), array("q"), array("q"), bytearray()
        group = number = -1
        for run, shared, row in merge_runs(runs, width):
            if shared < width or number < 0:
                if shared < gram or number < 0:
                    group += 1
                contexts += row
                group_list.append(group)
                prefixes.append(shared if number >= 0 else 0)
                number += 1
            run_list.append(run)
            class_list.append(number)
        run_of, class_of, groups = (np.array(x, np.int64) for x in (run_list, class_list, group_list))
        # Rows of a run come out in the run's order.
        owner = np.empty(len(run_of), np.int64)
        order = np.argsort(run_of, kind="stable")
        owner[order] = np.concatenate(owners)
        matrix = np.frombuffer(contexts, np.uint8).reshape(-1, width)
        least = np.full(len(matrix), MISSING_ID)
        np.minimum.at(least, class_of, owner)
        bits = np.zeros(len(matrix), np.uint64)
        many = np.flatnonzero(np.bincount(groups)[groups] > 1)
        if len(many):
            bits[many] = _windows(matrix[many], np.array(prefixes, np.int64)[many], least[many], length)
        told = np.flatnonzero((least[class_of] < owner) | (bits[class_of] > 0))
        hashes = row_hashes(matrix)
        out = []
        told = told[np.argsort(run_of[told], kind="stable")]
        for s, e in stretches(run_of[told]):
            c = class_of[told[s:e]]
            out.append((int(segs[run_of[told[s]]]), hashes[c].tobytes(), least[c].tobytes(), bits[c].tobytes()))
        tidy()
        return pd.DataFrame(out, columns=["seg", "hashes", "least", "bits"])

    return merge


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = 50, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Bytes covered by a string of ``length`` bytes that also starts in a document of a smaller key are removed.

    Returns per row: the key, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs), ``spans`` (their
    starts and ends) and ``kept`` (the remaining bytes). Matches don't cross documents; strings are judged on
    the input. Null and short texts lose nothing. Rows of equal keys don't count against each other; a null key
    is larger than any other.
    """
    table = segments(docs, text, key, segment_bytes=segment_bytes)
    total = text_bytes(table)
    parts = max(LEAST_PARTS, -(-total // PART_BYTES))
    known = cut(_anchor_entries(table, length, parts).repartition(parts, "part").groupBy("part").applyInPandas(_repeated, "seg long, hashes binary"), "anchors")
    suspects = by_segment(table.select("seg", "ids", "null_id", "sizes", "body"), known.groupBy("seg").agg(F.collect_list("hashes").alias("wanted")), total, "inner")
    width = 2 * length - min(GRAM_BYTES, length) + 2
    merged = cut(_runs(suspects, length, parts).repartition(parts, "part").groupBy("part").applyInPandas(_merge_part(length, width), "seg long, hashes binary, least binary, bits binary"), "contexts")
    discard(known)
    answers = merged.groupBy("seg").agg(F.collect_list(F.struct("hashes", "least", "bits")).alias("told"))
    names = [key, "n_bytes", "n_removed", "n_spans", "spans", "kept"]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            ids, nulls, bodies = unpack(row)
            c = Contexts(bodies, ids, length)
            gone = _gone(c, row["told"] or [])
            starts, ends = _edges(gone, c.ends)
            doc = np.searchsorted(c.ends, starts, "right")
            first = c.ends - c.sizes
            removed = np.bincount(doc, ends - starts, len(bodies)).astype(np.int64)
            runs = np.bincount(doc, minlength=len(bodies))
            pairs = np.stack((starts - first[doc], ends - first[doc]), 1).ravel()
            cuts = np.cumsum([0, *(2 * runs)])
            whole = c.raw[~gone].tobytes() if len(gone) else b""
            stops = np.cumsum([0, *(c.sizes - removed)]).tolist()
            kept = [whole[s:e] for s, e in zip(stops, stops[1:], strict=False)]
            spans = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(pairs, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([None if z else i for i, z in zip(ids.tolist(), nulls, strict=True)], pa.int64()), pa.array(c.sizes), pa.array(removed), pa.array(runs, pa.int64()), spans, pa.array(kept, pa.binary())], names)

    return by_segment(table.select("seg", "ids", "null_id", "sizes", "body"), answers, total).mapInArrow(finish, f"`{key}` long, n_bytes long, n_removed long, n_spans long, spans array<long>, kept binary")


def _edges(gone: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs inside one document."""
    if not len(gone):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    fresh = np.zeros(len(gone) + 1, bool)
    fresh[ends] = True
    prev = np.concatenate(([False], gone[:-1]))
    nxt = np.concatenate((gone[1:], [False]))
    return np.flatnonzero(gone & (~prev | fresh[:-1])), np.flatnonzero(gone & (~nxt | fresh[1:])) + 1


def _gone(c: Contexts, told: list[dict]) -> np.ndarray:
    places = c.anchors.places
    n = len(c.raw)
    if not len(places):
        return np.zeros(n, bool)
    rows, doc, around = c.rows(places)
    h = row_hashes(rows)
    del rows
    owner = c.ids[doc]
    u, inverse = np.unique(h, return_inverse=True)
    least = np.full(len(u), MISSING_ID)
    np.minimum.at(least, inverse, owner)
    bits = np.zeros(len(u), np.uint64)
    bits_of = np.full(len(u), MISSING_ID)
    if told:
        th = np.concatenate([np.frombuffer(x["hashes"], np.uint64) for x in told])
        tl = np.concatenate([np.frombuffer(x["least"], np.int64) for x in told])
        tb = np.concatenate([np.frombuffer(x["bits"], np.uint64) for x in told])
        at = np.searchsorted(u, th)
        least[at] = np.minimum(least[at], tl)
        bits[at], bits_of[at] = tb, tl
    later = owner > least[inverse]
    starts = [places[later] - around[later, 0]]
    ends = [places[later] + around[later, 1]]
    own = bits[inverse]
    for o in range(c.left + 1):
        at = places[(own >> np.uint64(o) & np.uint64(1)).astype(bool) & ~later]
        starts.append(at - o)
        ends.append(at - o + c.length)
    return covered(np.concatenate(starts), np.concatenate(ends), n)
