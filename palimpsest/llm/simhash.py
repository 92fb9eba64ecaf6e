"""SimHash near-duplicates by covering locality-sensitive hashing.

Bit i of a 64-bit fingerprint has a nonzero vector a(i) of r+1 bits; table v (a nonzero vector too) keeps the
bits with <a(i), v> = 1. Two fingerprints that differ in at most r bits meet in some table: the r or fewer
equations <a(i), v> = 0 over their differing bits have a nonzero solution v. No pair within the radius is
missed. A table's bucket that holds many fingerprints is divided by covering tables over the bits it leaves
open, which keeps the guarantee; each level leaves under half of them, so that a bucket of the last level holds
a bounded number of different fingerprints, however large a group of near copies is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import claim, cut, scratch, tidy, units_of
from .winnow import mixed

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingle_hashes(text: str | None, shingle: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of every word shingle of a whole text in order, repeats included; see :func:`simhash`."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - shingle + 1)
    starts = np.concatenate(([0], ends[: n - 1] + 1)).tolist()
    ends = (ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[s:e], seed) for s, e in zip(starts, ends, strict=True)), np.uint64, n)


def _print_of(h: np.ndarray) -> int:
    """Majority of each bit; a tie gives 0."""
    n, ones = len(h), np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        bits = np.unpackbits(h[at : at + (1 << 16)].byteswap().view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def simhash(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of a whole text: majority of each bit over the XXH64 of its word shingles, repeats included.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased. Fewer words than a shingle: the
    whole sequence is the one shingle. No word (null, empty, white space): 0. A tie of a bit gives 0.
    """
    return _print_of(shingle_hashes(text, shingle, seed))


def fingerprint_column(text: str = "text", shingle: int = 3):
    """Column of the SimHash as a signed long; see :func:`simhash` for null and short texts."""

    @F.pandas_udf("long")
    def of(blocks: Iterator[pd.Series]) -> Iterator[pd.Series]:
        claim("simhash")
        for block in blocks:
            yield pd.Series(np.fromiter((simhash(x, shingle) for x in block), np.uint64, len(block)).astype(np.int64))
        tidy()

    return of.asNondeterministic()(F.col(text))


def covering_masks(bits: list[int], radius: int) -> list[int]:
    """Masks over the given bit positions: any ``radius`` of them lie outside of some mask."""
    width = radius + 1
    a = {b: i % ((1 << width) - 1) + 1 for i, b in enumerate(bits)}
    return [sum(1 << b for b in bits if (a[b] & v).bit_count() & 1) for v in range(1, 1 << width)]


def _scattered() -> list[int]:
    """The 64 bit positions in a fixed mixed order, so that masks don't follow neighbouring bits."""
    return [i * 37 % 64 for i in range(64)]


def near_pairs(prints: DataFrame, radius: int = 2, small: int = 48, levels: int = 4) -> DataFrame:
    """``prints(fp long)``, distinct -> ``(a, b)``: every pair at ``radius`` or fewer differing bits, at least once.

    Buckets of up to ``small`` fingerprints are compared inside; larger ones go on to the next level. On the
    last level a bucket has at most a few open bits, thus a bounded number of members (with the defaults 64).
    """
    spark = prints.sparkSession
    found: list[DataFrame] = []
    # mask: bits fixed so far; ``way`` names the masks that led here.
    rows = prints.select("fp", F.lit(0).cast("long").alias("mask"), F.lit("").alias("way"))
    masks = {"": (0, _scattered())}
    for level in range(levels):
        nexts: dict[str, tuple[int, list[int]]] = {}
        table = []
        for way, (fixed, free) in masks.items():
            for v, m in enumerate(covering_masks(free, radius)):
                nexts[f"{way}{v}"] = (fixed | m, [b for b in free if not m >> b & 1])
                table.append((way, f"{way}{v}", _to_long(fixed | m)))
        # 7, 49, 343, 2401 constant rows at the default radius; grouped by way so that one map lookup expands a row.
        by_way: dict[str, list] = {}
        for way, child, m in table:
            by_way.setdefault(way, []).append(F.struct(F.lit(child).alias("way"), F.lit(m).cast("long").alias("mask")))
        if level == 0:
            kids = F.array(*by_way[""])
            rows = rows.select("fp", F.explode(kids).alias("k"))
        else:
            look = spark.createDataFrame([(w, c, m) for w, c, m in table], "parent string, way string, mask long")
            rows = rows.select("fp", F.col("way").alias("parent")).join(F.broadcast(look), "parent").select("fp", F.struct("way", "mask").alias("k"))
        rows = rows.select("fp", F.col("k.way").alias("way"), F.col("k.mask").alias("mask"), F.col("fp").bitwiseAND(F.col("k.mask")).alias("key"))
        last = level == levels - 1
        sizes = rows.groupBy("way", "key").agg(F.count("*").alias("n")).where("n > 1")
        kept = cut(rows.join(sizes, ["way", "key"]), "cover")
        few = kept if last else kept.where(F.col("n") <= small)
        inside = few.groupBy("way", "key").agg(F.sort_array(F.collect_list("fp")).alias("f"))
        pairs = inside.select(F.explode(F.expr(f"flatten(transform(f, (x, i) -> transform(filter(slice(f, i + 2, size(f)), y -> bit_count(x ^ y) <= {radius}), y -> struct(x as a, y as b))))")).alias("p")).select("p.a", "p.b")
        found.append(pairs)
        if last:
            break
        rows = kept.where(F.col("n") > small).select("fp", "mask", "way")
        if rows.limit(1).count() == 0:
            break
        used = {r["way"] for r in rows.select("way").distinct().collect()}  # at most 7 ** level names
        masks = {w: x for w, x in nexts.items() if w in used}
    return reduce(DataFrame.unionByName, found).distinct()


def simhash_components(docs: DataFrame, text: str = "text", key: str = "doc_id", radius: int = 2, shingle: int = 3) -> DataFrame:
    """``(key, fp long, component)`` for every row: the smallest key reachable over links of ``radius`` or fewer bits.

    Equal fingerprints are one node, so a group of copies costs one node whatever its size. The empty print 0
    links like any other. Rows with a null key get a component through their print like the rest; where a
    print has null keys only, its component is null. Repeated rows are returned repeated.
    """
    marked = cut(docs.select(F.col(key).alias("__key"), fingerprint_column(text, shingle).alias("fp")), "simhash")
    nodes = cut(marked.groupBy("fp").agg(F.min("__key").alias("least")), "simhash-nodes")
    pairs = near_pairs(nodes.select("fp"), radius)
    linked = connected_components(pairs)
    groups = nodes.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = groups.groupBy("component").agg(F.min("least").alias("smallest"))
    of_print = groups.join(least, "component").select("fp", "smallest")
    return marked.join(of_print, "fp").select(F.col("__key").alias(key), "fp", F.col("smallest").alias("component"))


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id", radius: int = 2, shingle: int = 3) -> DataFrame:
    """The rows of ``docs`` whose key is its component's smallest; all columns stay.

    Rows that share a key are one document and stay or go together; rows with a null key stay, as they can't be
    named. An empty table gives an empty table.
    """
    groups = simhash_components(docs.where(F.col(key).isNotNull()), text, key, radius, shingle)
    reps = groups.where(F.col(key) == F.col("component")).select(F.col(key).alias("__rep")).distinct()
    kept = docs.join(reps, docs[key] == reps["__rep"], "left_semi")
    return kept.unionByName(docs.where(F.col(key).isNull()))


def _frequent(docs: DataFrame, text: str, key: str, shingle: int, sample: int = 4000, least: int = 4, most: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
    """(hashes in ascending order, their ranks by frequency) of shingles that several texts of a sample hold.

    They only set an order of shingles: any order gives the same pairs, this one smaller buckets.
    """
    @F.pandas_udf("array<long>")
    def of(block: pd.Series) -> pd.Series:
        return pd.Series([np.unique(shingle_hashes(x, shingle)).view(np.int64) for x in block])

    share = max(1, docs.count() // sample)
    some = docs.where(F.pmod(F.xxhash64(F.col(key)), F.lit(share)) == 0)
    counted = some.select(F.explode(of.asNondeterministic()(F.col(text))).alias("h")).groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    h = np.asarray(counted.orderBy(F.desc("n"), "h").limit(most).select("h").toArrow()["h"], np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], len(h) - order


_MINIMA = 64
_FACTORS = np.random.default_rng(41).integers(1, 1 << 62, _MINIMA, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def _minima(u: np.ndarray) -> bytes:
    """64 bytes of minimum hashes of a set of shingle hashes: two sets agree on a byte with their Jaccard similarity or a bit more."""
    out = np.full(_MINIMA, np.iinfo(np.uint64).max)
    for at in range(0, len(u), 4096):
        out = np.minimum(out, (mixed(u[at : at + 4096])[:, None] * _FACTORS).min(0))
    return (mixed(out) >> np.uint64(56)).astype(np.uint8).tobytes()


def _least_alike(similarity: float) -> float:
    """Of the minimum hashes of two sets at ``similarity``, how many agree at least: five deviations under the mean."""
    return _MINIMA * similarity - 5 * math.sqrt(_MINIMA * similarity * (1 - similarity))


def _alike(pairs: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b, x, y) whose minima x and y agree often enough."""
    least = _least_alike(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint8).reshape(-1, _MINIMA) for k in (2, 3))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array((x == y).sum(1) >= least))

    return pairs.mapInArrow(run, "a long, b long")


def _parts(text: str, shingle: int, similarity: float, frequent: tuple[np.ndarray, np.ndarray]):
    """Column of a text's print, its set of shingles as one hash, that set's size, its minimum hashes, and its prefix.

    Two sets at Jaccard ``similarity`` or more share a shingle of their prefixes, the first ``n - ceil(similarity * n)
    + 1`` in one order of all shingles: by hash, with the frequent ones last.
    """
    known, ranks = frequent

    def one(x: str | None) -> tuple[int, int, int, bytes, np.ndarray]:
        h = shingle_hashes(x, shingle)
        u = np.unique(h)
        n = len(u)
        length = n - math.ceil(similarity * n - 1e-9) + 1 if n else 0
        prefix = u
        if len(known) and n:
            at = np.minimum(np.searchsorted(known, u), len(known) - 1)
            often = known[at] == u
            prefix = np.concatenate((u[~often], u[often][np.argsort(ranks[at[often]], kind="stable")]))
        whole = xxhash.xxh64_intdigest(u.tobytes(), 7)
        return _to_long(_print_of(h) if n else 0), _to_long(whole), n, _minima(u), prefix[:length].view(np.int64)

    @F.pandas_udf("fp long, node long, n int, minima binary, prefix array<long>")
    def of(blocks: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        claim("simhash")
        for block in blocks:
            yield pd.DataFrame([one(x) for x in block], columns=["fp", "node", "n", "minima", "prefix"])
        tidy()

    return of.asNondeterministic()(F.col(text))


def _to_long(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _resemble(a, b, shingle: int, similarity: float):
    """Whether the sets of shingles of two texts have a Jaccard similarity of at least ``similarity``."""
    @F.pandas_udf("boolean")
    def of(x: pd.Series, y: pd.Series) -> pd.Series:
        last, out = (None, None), []
        for s, t in zip(x, y, strict=True):
            u = last[1] if s == last[0] else np.unique(shingle_hashes(s, shingle))
            v = np.unique(shingle_hashes(t, shingle))
            last = (s, u)
            both = len(np.intersect1d(u, v, assume_unique=True))
            out.append(both >= similarity * (len(u) + len(v) - both) - 1e-9)
        return pd.Series(out, dtype=bool)

    return of.asNondeterministic()(a, b)


def _of_one_shingle(rows: DataFrame, similarity: float, small: int, reach: int) -> DataFrame:
    """Of rows (shingle, n, node): candidate pairs ``(shingle null, n null, a, b)``, and the rows ``(shingle, n, node, null)`` of large groups.

    One shuffle by ranges of (shingle, n, node), so that a shingle of very many texts is many tasks' work. Up to
    ``small`` rows of a shingle are paired; more, and those at a range's ends, which may go on in the next one,
    are chained to the next ``reach`` by size and given back as rows.
    """
    cols = ["shingle", "n", "node"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = tuple(np.zeros(0, np.int64) for _ in cols)  # the rows of the last shingle so far, or its last ones
        state = 1  # of the held rows: 0 a group that may be small, 1 one at the range's start, 2 a large one whose held rows are told

        def tell(s: np.ndarray, n: np.ndarray, node: np.ndarray, state: int, last: bool, told: int) -> pa.RecordBatch:
            new = np.concatenate(([True], s[1:] != s[:-1]))
            group = np.cumsum(new) - 1
            size = np.bincount(group)
            large = size > small
            large[0] |= state > 0
            large[-1] |= last
            pairs = []
            for k in range(1, min(small, len(s))):
                fit = (group[k:] == group[:-k]) & (n[:-k] >= similarity * n[k:] - 1e-9) & (node[k:] != node[:-k])
                if k > reach:
                    fit &= ~large[group[k:]]
                at = np.flatnonzero(fit)
                at = at[at + k >= told]
                pairs.append((np.minimum(node[at], node[at + k]), np.maximum(node[at], node[at + k])))
            a, b = (np.concatenate([p[i] for p in pairs]) if pairs else np.zeros(0, np.int64) for i in (0, 1))
            rest = np.flatnonzero(large[group])
            rest = rest[rest >= told]
            none = pa.nulls(len(a), pa.int64())
            columns = [pa.concat_arrays([none, pa.array(s[rest])]), pa.concat_arrays([none, pa.array(n[rest], pa.int64())]), pa.array(np.concatenate((a, node[rest]))), pa.concat_arrays([pa.array(b), pa.nulls(len(rest), pa.int64())])]
            return pa.RecordBatch.from_arrays(columns, ["shingle", "n", "a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            told = len(held[0]) if state == 2 else 0
            s, n, node = (np.concatenate((h, np.asarray(batch.column(k)))) for k, h in enumerate(held))
            start = int(np.searchsorted(s, s[-1]))  # of the last shingle
            if start:
                yield tell(s[:start], n[:start], node[:start], state, False, told)
                s, n, node, state, told = s[start:], n[start:], node[start:], 0, 0
            if len(s) > small:
                yield tell(s, n, node, 2, False, told)
                s, n, node, state = s[-reach:], n[-reach:], node[-reach:], 2
            held = s, n, node
        if len(held[0]):
            yield tell(*held, state, True, len(held[0]) if state == 2 else 0)

    return rows.select("shingle", F.col("n").cast("long").alias("n"), "node").repartitionByRange(*cols).sortWithinPartitions(*cols).mapInArrow(run, "shingle long, n long, a long, b long")


def _common(xs: list[np.ndarray], ys: list[np.ndarray], width: int = 2048) -> np.ndarray:
    """Sizes of the intersections of sets of hashes, one row for each of ``xs``, one column for each of ``ys``; sets of under 2**24."""
    hx, hy = np.concatenate(xs), np.concatenate(ys)
    shared = np.intersect1d(hx, hy)
    sides = []
    for sets, h in ((xs, hx), (ys, hy)):
        row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        at = np.minimum(np.searchsorted(shared, h), max(len(shared) - 1, 0))
        known = np.flatnonzero(shared[at] == h) if len(shared) else np.zeros(0, np.int64)
        known = known[np.argsort(at[known], kind="stable")]
        sides.append((len(sets), row[known], at[known]))
    out = np.zeros((len(xs), len(ys)), np.float32)
    for start in range(0, len(shared), width):
        blocks = []
        for count, row, at in sides:
            s, e = np.searchsorted(at, (start, start + width))
            m = np.zeros((count, width), np.float32)
            m[row[s:e], at[s:e] - start] = 1
            blocks.append(m)
        out += blocks[0] @ blocks[1].T
    return out.astype(np.int64)


def _forest(p: np.ndarray, q: np.ndarray) -> list[int]:
    """Positions of those of the links (p, q) that join what the links before them did not."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    out = []
    _, first = np.unique(np.stack((p, q)), axis=1, return_index=True)
    for k in first.tolist():
        r, s = root(int(p[k])), root(int(q[k]))
        if r != s:
            parent[max(r, s)] = min(r, s)
            out.append(k)
    return out


def _fitting(n: np.ndarray, component: np.ndarray, minima: np.ndarray, x: np.ndarray, y: np.ndarray, similarity: float) -> np.ndarray:
    """Which of rows x and rows y, of different components, have sizes and minima that allow ``similarity``."""
    least = _least_alike(similarity)
    fit = (component[x][:, None] != component[y][None, :]) & (np.minimum(n[x][:, None], n[y][None, :]) >= similarity * np.maximum(n[x][:, None], n[y][None, :]) - 1e-9)
    for k in range(0, len(x), 32):
        i, j = np.nonzero(fit[k : k + 32])
        fit[k + i, j] = (minima[x[k + i]] == minima[y[j]]).sum(1) >= least
    return fit


_LEAST = 8
_UNIT = ["shingle", "p", "q", "side", "n", "node", "component"]


def _unit_rows(b: pa.RecordBatch) -> tuple:
    """Of the rows of a unit: n, node, component, minima, and positions of those to be compared and of those they are compared with."""
    side, n, node, component = (np.asarray(b.column(k)) for k in range(3, 7))
    minima = np.frombuffer(b"".join(b.column(7).to_pylist()), np.uint8).reshape(-1, _MINIMA)
    return n, node, component, minima, np.flatnonzero(side != 1), np.flatnonzero(side != 0)


def _likely(rows: DataFrame, minima: DataFrame, similarity: float, block: int) -> DataFrame:
    """Rows (shingle, p, q, side, n, node, component, minima) of the blocks of :func:`_across` that have a partner there by size and minima.

    Of rows (shingle, n, node, component). Block (p, q) of a shingle holds rows to be compared (side 0) and those that they are
    compared with (side 1); where one block is enough for a shingle, a row is in it once (side 2: both). The largest
    component of a shingle is left to itself. Only minima travel here, so that sets need not follow for rows without a partner.
    A pair of nodes is looked for in one block of the least shingle that both have; to tell, a row has the ``_LEAST`` least ones of its
    node, and a pair that shares none of those below the block's own shingle is looked for there.
    """
    # Every shingle of a pair of different components is among the rows, so the least one that both have is, too.
    least = rows.groupBy("node").agg(F.slice(F.sort_array(F.collect_set("shingle")), 1, _LEAST).alias("least"))
    per = rows.groupBy("shingle", "component").agg(F.count("*").alias("c"))
    groups = per.groupBy("shingle").agg(F.sum("c").alias("all"), F.max_by("component", F.struct("c", "component")).alias("main"), F.max("c").alias("most")).where("all > most")
    groups = groups.select("shingle", "main", F.ceil((F.col("all") - F.col("most")) / block).cast("int").alias("few"), F.ceil(F.col("all") / block).cast("int").alias("many"))
    known = rows.join(groups, "shingle")
    own = F.xxhash64("node")
    whole = known.where("many = 1").withColumn("p", F.lit(0)).withColumn("q", F.lit(0)).withColumn("side", F.when(F.col("component") == F.col("main"), 1).otherwise(2))
    odd = known.where("many > 1 and component <> main").withColumn("p", F.pmod(own, "few")).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("many") - 1))).withColumn("side", F.lit(0))
    every = known.where("many > 1").withColumn("q", F.pmod(own, "many")).withColumn("p", F.explode(F.sequence(F.lit(0), F.col("few") - 1))).withColumn("side", F.lit(1))
    units = reduce(DataFrame.unionByName, [x.select(*[F.col(c).cast("long") for c in _UNIT]) for x in (whole, odd, every)])
    units = units.join(minima.join(least, "node"), "node").select(*_UNIT, "minima", F.filter("least", lambda x: x < F.col("shingle")).alias("least"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("simhash")
        for b in units_of(batches):
            n, _, component, known, x, y = _unit_rows(b)
            fit = _fitting(n, component, known, x, y, similarity)
            i, j = np.flatnonzero(fit.any(1)), np.flatnonzero(fit.any(0))
            if len(i):
                before = [np.array(v, np.int64) for v in b.column(8).to_pylist()]
                fit[np.ix_(i, j)] &= _common([before[k] for k in x[i]], [before[k] for k in y[j]]) == 0
            some = np.zeros(b.num_rows, bool)
            some[x[fit.any(1)]] = True
            some[y[fit.any(0)]] = True
            yield pa.RecordBatch.from_arrays(b.columns[:8], [*_UNIT, "minima"]).filter(pa.array(some))
        tidy()

    cols = _UNIT[:3]
    return units.repartition(*cols).sortWithinPartitions(*cols).mapInArrow(run, ", ".join(f"{c} long" for c in _UNIT) + ", minima binary")


def _across(likely: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``(a, b, sure)``: links between rows of :func:`_likely` that are in one block and in different components.

    ``sets`` (node, shingles) has the set of shingle hashes of each node where it is not too large, else null. Pairs whose
    sets are both there are decided in the block, and only links that join components are given, fewer than the block
    has components. Other pairs are given, not sure, where their minima agree often enough.
    """
    units = likely.join(sets, "node").select(*_UNIT, "minima", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("simhash")
        for b in units_of(batches):
            n, node, component, minima, x, y = _unit_rows(b)
            sets = [None if x is None else np.frombuffer(x, np.uint64) for x in b.column(8).to_pylist()]
            there = np.array([x is not None for x in sets])
            if not len(x) or not len(y):
                continue
            fit = _fitting(n, component, minima, x, y, similarity)
            decided = fit & there[x][:, None] & there[y][None, :]
            p, q = np.nonzero(fit & ~decided)
            s, t, sure = [node[x[p]]], [node[y[q]]], [np.zeros(len(p), bool)]
            i, j = np.flatnonzero(decided.any(1)), np.flatnonzero(decided.any(0))
            if len(i):
                both = _common([sets[k] for k in x[i]], [sets[k] for k in y[j]])
                p, q = np.nonzero(decided[np.ix_(i, j)] & (both >= similarity * (n[x[i]][:, None] + n[y[j]][None, :] - both) - 1e-9))
                p, q = x[i[p]], y[j[q]]
                of = _forest(component[p], component[q])
                s, t, sure = s + [node[p[of]]], t + [node[q[of]]], sure + [np.ones(len(of), bool)]
            s, t = np.concatenate(s), np.concatenate(t)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(s, t)), pa.array(np.maximum(s, t)), pa.array(np.concatenate(sure))], ["a", "b", "sure"])
        tidy()

    cols = _UNIT[:3]
    return units.repartition(*cols).sortWithinPartitions(*cols).mapInArrow(run, "a long, b long, sure boolean").distinct()


def _set_of(text: str, shingle: int, whole: int):
    """Column of a text's set of shingle hashes, ascending, eight bytes each; null where there are more than ``whole``."""
    @F.pandas_udf("binary")
    def of(block: pd.Series) -> pd.Series:
        sets = (np.unique(shingle_hashes(x, shingle)) for x in block)
        return pd.Series([u.tobytes() if len(u) <= whole else None for u in sets], dtype=object)

    return of.asNondeterministic()(F.col(text))


def keep_one_similar(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 5, similarity: float = 0.8, radius: int = 2, small: int = 16, reach: int = 4, block: int = 1024, whole: int = 1024) -> DataFrame:
    """The rows of ``docs`` whose key is the smallest of its group, linked by Jaccard ``similarity`` of whole texts' shingle sets.

    At such a similarity a SimHash of 64 bits differs in too many bits to be looked up, so candidates are prints within
    ``radius`` bits and, for the rest, texts that share a shingle of their prefixes, which misses no pair. Every
    candidate whose minimum hashes allow it is verified on the whole sets. Up to ``small`` texts of a shingle are paired;
    more are first linked in a chain by size, and what this did not put into one group is compared with all of the shingle
    in blocks: by the sets themselves, of which a block gives only the links that join groups, and for texts of over
    ``whole`` different shingles by verified pairs. Minimum hashes leave out what they put five deviations under the similarity (one
    pair in a million at the very similarity). Equal sets are one node. Rows with equal or null keys are treated as in :func:`keep_one`, null and
    empty texts are copies of each other, other columns are not read, and an empty table gives an empty one.
    """
    with scratch():
        named = docs.where(F.col(key).isNotNull())
        parts = _parts(text, shingle, similarity, _frequent(named, text, key, shingle))
        marked = cut(named.select(F.col(key).alias("__key"), F.xxhash64(text).alias("body"), parts.alias("p")).select("__key", "body", "p.*"), "similar")
        nodes = cut(marked.groupBy("node").agg(F.min(F.struct("__key", "body")).alias("first"), F.min("fp").alias("fp")).select("node", "first.*", "fp"), "similar-nodes")
        reps = nodes.select("node", "__key", "body")
        own = marked.join(reps, ["node", "__key", "body"], "left_semi")  # a row twice where its key and text are
        minima = cut(own.select("node", "minima").distinct(), "similar-minima")
        repeated = cut(own.groupBy("node").agg(F.count("*").alias("c")).where("c > 1").select("node", F.lit(True).alias("again")), "similar-repeated")
        any_repeated = repeated.limit(1).count() > 0  # only their texts need a shuffle to be one row each
        shared = cut(_of_one_shingle(own.select("node", "n", F.explode("prefix").alias("shingle")), similarity, small, reach), "similar-shingles")
        by_prefix = shared.where("b is not null").select("a", "b")
        of_print = nodes.groupBy("fp").agg(F.min("node").alias("first"))
        prints = near_pairs(of_print.select("fp"), radius)
        left, right = (of_print.select(F.col("fp").alias(c), F.col("first").alias(f"n{c}")) for c in "ab")
        by_print = prints.join(left, "a").join(right, "b").select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b"))
        often = shared.where("b is null").select("shingle", "n", F.col("a").alias("node"))
        pairs = cut(by_prefix.unionByName(by_print).distinct(), "similar-pairs")

        def texts_of(some: DataFrame) -> DataFrame:
            wanted = cut(reps.join(some, "node", "left_semi").join(repeated, "node", "left"), "similar-wanted")
            if wanted.count() <= 500_000:  # 24 bytes each; more go through a shuffle of the texts
                wanted = F.broadcast(wanted)
            found = named.select(F.col(key).alias("__key"), F.xxhash64(text).alias("body"), F.col(text).alias("t")).join(wanted, ["__key", "body"])
            if not any_repeated:
                return found.select("node", "t")
            return found.where("again is null").select("node", "t").union(found.where("again").dropDuplicates(["node"]).select("node", "t"))

        def verified(pairs: DataFrame) -> DataFrame:
            x, y = (minima.select(F.col("node").alias(c), F.col("minima").alias(m)) for c, m in (("a", "x"), ("b", "y")))
            alike = cut(_alike(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y"), similarity), "similar-alike")
            texts = cut(texts_of(alike.select(F.col("a").alias("node")).union(alike.select("b")).distinct()), "similar-texts")
            both = alike.join(texts.select(F.col("node").alias("a"), F.col("t").alias("ta")), "a").join(texts.select(F.col("node").alias("b"), F.col("t").alias("tb")), "b")
            return cut(both.where(_resemble(F.col("ta"), F.col("tb"), shingle, similarity)).select("a", "b"), "similar-links")

        links = verified(pairs)
        if often.limit(1).count():
            placed = often.join(connected_components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))
            split = placed.groupBy("shingle").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("shingle")
            open_ = cut(placed.join(split, "shingle", "left_semi"), "similar-open")
            likely = cut(_likely(open_, minima, similarity, block), "similar-likely")
            sets = texts_of(likely.select("node").distinct()).select("node", _set_of("t", shingle, whole).alias("shingles"))
            found = cut(_across(likely, cut(sets, "similar-sets"), similarity), "similar-found")
            links = links.unionByName(found.where("sure").select("a", "b"))
            more = cut(found.where("not sure").select("a", "b").join(pairs, ["a", "b"], "left_anti"), "similar-pairs")
            if more.limit(1).count():
                links = links.unionByName(verified(more))
        linked = connected_components(links)
        groups = nodes.select("node", F.col("__key").alias("least")).join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
        smallest = cut(groups.groupBy("component").agg(F.min("least").alias("__rep")).select("__rep").distinct(), "similar-kept", keep=True)
    kept = docs.join(smallest, docs[key] == smallest["__rep"], "left_semi")
    return kept.unionByName(docs.where(F.col(key).isNull()))
